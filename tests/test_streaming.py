from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeframe.streaming import timelines
from tests.conftest import SF


def stream(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").limit(300)
    rows = e.withColumn("part", F.ntile(3).over(Window.orderBy("ts"))).cache()
    for k in (1, 2, 3):
        rows.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return e, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def run(df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_windows_and_sessions(spark, tmp_path):
    e, s = stream(spark, tmp_path)
    got = run(timelines.sliding(s, late="30 days"), tmp_path, "sliding", "update")
    last = got.groupBy("start", "event_type").agg(F.max("events").alias("events"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, timelines.sliding(e).select("start", "event_type", "events").collect()))
    final = run(timelines.sessions(s, late="30 days"), tmp_path, "sessions", "complete")
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, timelines.sessions(e).collect()))


def test_frozen_values_go_from_batch_to_batch(spark, tmp_path):
    e, s = stream(spark, tmp_path)
    want, seen = {}, {}
    for r in e.orderBy("ts", "event_id").collect():
        if r.event_type != "error":
            seen[r.user_id] = (r.value, r.event_id)
        want[r.event_id] = seen.get(r.user_id, (None, None))
    got = {r.event_id: (r.value, r.shown) for r in run(timelines.frozen(s), tmp_path, "frozen", "append").collect()}
    assert {k: v for k, v in got.items() if v[1] is not None} == {k: v for k, v in want.items() if v[1] is not None}
    assert set(got) == set(want)
