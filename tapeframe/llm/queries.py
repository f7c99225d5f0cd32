"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeframe.llm import decontaminate, lines, maxent, pieces, progressive, sharding, simhash, substring, templates, toxicity
from tapeframe.llm.common import read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.digest(spark, docs, toxicity.learn(spark, docs, read(spark, sf_dir, "labels")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build_index(spark, read(spark, sf_dir, "documents"))
    return decontaminate.digest(decontaminate.phrase_matches(spark, index, read(spark, sf_dir, "benchmark")))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(spark, read(spark, sf_dir, "documents"), pieces.Model.load(spark))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_boilerplate(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read(spark, sf_dir, "documents"), sharding.lookup_table(spark))


def op6_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(spark, read(spark, sf_dir, "documents"))


def op7_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive.read_back(progressive.store_media(spark, read(spark, sf_dir, "documents")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(spark, read(spark, sf_dir, "documents")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(spark, read(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.digest(templates.extract(spark, read(spark, sf_dir, "pages")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontaminate": op2_decontaminate,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_line_dedup": op4_line_dedup,
    "op5_sharding": op5_sharding,
    "op6_maxent": op6_maxent,
    "op7_progressive_jpeg": op7_progressive_jpeg,
    "op8_simhash": op8_simhash,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_html_extraction": op10_html_extraction,
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": lines.oracle(),
    "op5_sharding": sharding.oracle(),
}
