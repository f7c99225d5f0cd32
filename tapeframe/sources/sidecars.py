"""JSON sidecars: the index of clusters, alignment maps and triage rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX = "caps array<string>, clusters array<array<struct<cap: int, frame: bigint>>>, `order` array<int>, stats map<string, bigint>"


def save_index(spark: SparkSession, caps: list[str], reads: DataFrame, path: str) -> None:
    """Write (pos, cap, frame) as one JSON row: captures, clusters in order, and counts."""
    clusters = reads.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct(F.col("cap").cast("int").alias("cap"), F.col("frame").cast("long").alias("frame")))).alias("reads"))
    whole = clusters.agg(F.array_sort(F.collect_list(F.struct("pos", "reads"))).alias("c"))
    names = F.array(*(F.lit(c) for c in caps)) if caps else F.expr("cast(array() as array<string>)")
    row = whole.select(names.alias("caps"), F.transform("c", lambda x: x["reads"]).alias("clusters"), F.transform("c", lambda x, i: i).alias("order"), F.create_map(F.lit("clusters"), F.size("c").cast("long")).alias("stats"))
    row.write.mode("overwrite").json(path)


def load_index(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """(pos, cap, path, frame) of a saved index; captures that are not there are named in the error."""
    raw = spark.read.schema(INDEX).json(path)
    if check:
        hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
        at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        missing = [p for p in raw.first()["caps"] if not at(p).getFileSystem(hadoop).exists(at(p))]
        if missing:
            raise FileNotFoundError(", ".join(missing))
    rows = raw.select("caps", F.posexplode("order").alias("pos", "k"), "clusters").select("caps", F.col("pos").cast("long").alias("pos"), F.explode(F.get("clusters", F.col("k"))).alias("r"))
    return rows.select("pos", "r.cap", F.get("caps", F.col("r.cap")).alias("path"), "r.frame")


def save_alignment(rows: DataFrame, path: str, **params) -> None:
    """Write (f, v, cost, margin, covered) keyed by a preset's parameters."""
    for k, v in sorted(params.items()):
        rows = rows.withColumn(f"param_{k}", F.lit(v))
    rows.write.mode("overwrite").parquet(path)


def load_alignment(spark: SparkSession, path: str, **params) -> DataFrame:
    """The stored alignment, if it was made with these parameters."""
    rows = spark.read.parquet(path)
    for k, v in params.items():
        rows = rows.where(F.col(f"param_{k}") == F.lit(v))
    if rows.isEmpty():
        raise ValueError("no alignment with these parameters")
    return rows.select("f", "v", "cost", "margin", "covered")


def save_places(places: DataFrame, path: str) -> None:
    """Keep the places of a profile's blocks."""
    places.write.mode("overwrite").parquet(path)


def load_places(spark: SparkSession, path: str) -> DataFrame:
    """The places kept at ``path``; an error that says so if there are none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(f"no places of blocks at {path}: calibrate first")
    return spark.read.parquet(path)
