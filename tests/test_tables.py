import os
import subprocess
import sys

CODE = """
import sys
from pyspark.sql import SparkSession
b = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1")
if len(sys.argv) > 1:
    b = b.config("spark.checkpoint.dir", sys.argv[1])
s = b.getOrCreate()
from tapeframe.functions.tables import shared_dir, stored
print("DIR", shared_dir(s), shared_dir(s) == shared_dir(s), stored(s, s.range(5), "t").count())
"""


def run(conf_dir, *args):
    """In a process of its own, without the machine's default settings."""
    out = subprocess.run([sys.executable, "-c", CODE, *args], capture_output=True, text=True, check=True, env=os.environ | {"SPARK_CONF_DIR": str(conf_dir)})
    return next(x for x in out.stdout.splitlines() if x.startswith("DIR")).split()[1:]


def test_the_named_folder_is_used(tmp_path):
    assert run(tmp_path, f"file://{tmp_path}") == [f"file://{tmp_path}", "True", "5"]
    assert len(list(tmp_path.glob("tapeframe-*/t-*"))) == 1


def test_own_folder_where_none_is_named(tmp_path):
    path, same, n = run(tmp_path)
    assert path.startswith("file://") and (same, n) == ("True", "5")


def test_other_masters_need_a_shared_folder(tmp_path):
    code = """
from types import SimpleNamespace as N
from tapeframe.functions.tables import shared_dir
conf = N(get=lambda *a: None)
for master in ("yarn", "spark://h:1", "local-cluster[1,1,512]"):
    try:
        shared_dir(N(conf=conf, sparkContext=N(getConf=lambda: conf, master=master, applicationId="a")))
    except RuntimeError:
        continue
    raise SystemExit(1)
"""
    subprocess.run([sys.executable, "-c", code], check=True, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)})


def test_bucketed_tables_join_without_exchange_or_sort(spark):
    from tapeframe.functions.tables import Bucketed

    a = Bucketed(spark, spark.range(100).selectExpr("id % 37 as k", "id"), "a", ["k", "id"], 4)
    b = Bucketed(spark, spark.range(50).selectExpr("id % 41 as k", "id"), "b", ["k", "id"], 4)
    for how, on in (("left_semi", ["k"]), ("full", ["k", "id"])):
        joined = a.read().hint("merge").join(b.read(), on, how)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort " not in plan, plan
        assert joined.count() == spark.range(100).selectExpr("id % 37 as k", "id").join(spark.range(50).selectExpr("id % 41 as k", "id"), on, how).count()
    path = a.path.removeprefix("file://").removeprefix("file:")
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) <= 4
    a.drop(), b.drop()
    assert not os.path.exists(path)
