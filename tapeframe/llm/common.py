"""Tables in the shared folder, and column handling that all operators of this subpackage use."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.functions.tables import new_path, shared_dir, stored, visible
from tapeframe.llm import bytetext as B

__all__ = ["bounded", "held_out", "lean", "new_path", "read", "shared_dir", "stored", "texts"]


#: Bytes of rows that go to a Python process at once; the process works on slices of them.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def bounded(spark: SparkSession) -> None:
    """Keep the batches that Python processes get small, whatever the rows' sizes (larger settings are lowered), and let them import this package."""
    visible(spark)
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(BATCH_SETTING))
    if now is None or not 0 < int(now[1]) <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


#: What a Python process keeps from one task to the next, by the operator that needs it.
HELD: dict[str, dict] = {}


def drop_held(keep: str | None) -> None:
    """Let go what other operators' tasks have left in this process."""
    for name, own in HELD.items():
        if name != keep:
            own.clear()


def give_back() -> None:
    """Return free memory to the system: a process that waits for its next task counts with all it has."""
    B._powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def lean(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: str | None = None) -> Callable:
    """``step`` for ``mapInArrow``, in a process that holds nothing of other operators before and no free memory afterwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held(keep)
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, *extra: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the columns an operator reads, under fixed names, so that others cannot clash."""
    bounded(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *extra)


def held_out(doc_id: str, modulus: int):
    """crc32 of the id as text has remainder 1; a row without an id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == 1, F.lit(False))
