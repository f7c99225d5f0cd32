"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


#: Where this package lies.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def visible(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started; executors need it at the same path."""
    environment = spark.sparkContext.environment
    known = [environment.get("PYTHONPATH", ""), os.environ.get("PYTHONPATH", "")]
    if ROOT not in os.pathsep.join(known).split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known[0]) if x)


_own: dict[str, str] = {}  # by application, where the cluster names no folder


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; one of our own only in a local session where that is unset, as in tests."""
    path = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if path:
        return path
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {SETTING} to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tapeframe-")
        atexit.register(shutil.rmtree, _own[app].removeprefix("file://"), ignore_errors=True)
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A new table's place: all of an application's tables lie in one folder, which can go when it has ended."""
    return f"{shared_dir(spark).rstrip('/')}/tapeframe-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage."""
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ours that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Bucketed:
    """A stored table dealt by ``by[0]`` to a fixed number of buckets, each one file sorted by ``by``.

    Two such tables with one number of buckets are joined on ``by`` or its head without an exchange or a sort.
    """

    def __init__(self, spark: SparkSession, df: DataFrame, name: str, by: list[str], buckets: int, dealt: bool = False) -> None:
        for key, value in (("spark.sql.legacy.bucketedTableScan.outputOrdering", "true"), ("spark.sql.requireAllClusterKeysForCoPartition", "false")):
            spark.conf.set(key, value)
        self.spark, self.path = spark, new_path(spark, name)
        self.table = f"default.tapeframe_{uuid.uuid4().hex[:16]}"
        rows = df if dealt else df.repartition(buckets, by[0])
        rows.write.bucketBy(buckets, by[0]).sortBy(*by).option("path", self.path).format("parquet").saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        discard(self.spark, self.path)
