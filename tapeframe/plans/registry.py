"""The registry of queries: a name, the inventory's operators it covers, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.functions.tables import visible

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}
#: Decimal places that results keep, so that engines agree.
PLACES = 6


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, fractions rounded: one type and one value in every engine."""

    def column(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind in ("tinyint", "smallint", "int"):
            return c.cast("long").alias(name)
        if kind in ("float", "double"):
            return (F.round(c.cast("double"), PLACES) + F.lit(0.0)).alias(name)
        return c

    return df.select(*(column(n, k) for n, k in df.dtypes))


def query(covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            visible(spark)
            return plain(f(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__], COVERS[f.__name__] = run, tuple(covers.split())
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return run

    return register
