"""From documents to token ids: each stage works on all that the stage before it kept.

Toxic documents go; boilerplate lines of a source are cut; one document of each near-duplicate group
stays; documents that hold a benchmark passage go; what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.llm import decontaminate, lines, pieces, simhash, toxicity
from tapeframe.llm.common import read, stored


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that score as toxic."""
    lexicon = toxicity.learn(spark, docs, read(spark, sf_dir, "labels"))
    return toxicity.scored(spark, docs, lexicon, "__score").where(F.col("__score") < toxicity.THRESHOLD).drop("__score")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the lines that are boilerplate of their source."""
    cut = lines.without_boilerplate(docs)
    changed = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", changed).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return simhash.representatives(spark, docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that hold a passage of the benchmark."""
    return decontaminate.clean(spark, docs, read(spark, sf_dir, "benchmark"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode; the text that is returned is decoded from the ids."""
    rows = pieces.encode(spark, docs.select("doc_id", "text", "lang", "source"), pieces.Model.load(spark), decoded="__decoded")
    return rows.select("doc_id", F.col("__decoded").alias("text"), "lang", "source", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Fingerprints, learned weights and piece merges are not expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
