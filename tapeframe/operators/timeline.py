"""Window operators along a capture's frames.  A timeline is (cap, f, ts, value, bad, kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def _by() -> WindowSpec:
    """A capture's frames in order."""
    return W.partitionBy("cap").orderBy("f")


def of_events(events: DataFrame) -> DataFrame:
    """Events of a user as the frames of a capture; errors are the damaged ones."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("cap"), (F.row_number().over(order) - 1).cast("long").alias("f"), "event_id", "ts", "value", (F.col("event_type") == "error").alias("bad"), F.col("event_type").alias("kind"))


def clip(timeline: DataFrame, start: int, count: int) -> DataFrame:
    """Rows of a range of frames; the range is cut to what there is."""
    return timeline.where(F.col("f").between(max(start, 0), start + count - 1))


def sample_frames(timeline: DataFrame, n: int = 8) -> DataFrame:
    """n frames at even distances, first and last included; all of them where there are fewer."""
    last = F.max("f").over(W.partitionBy("cap"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("last") / (n - 1)))
    return timeline.withColumn("last", last).where(F.array_contains(steps, F.col("f"))).drop("last")


def misplaced(timeline: DataFrame, ratio: float = 0.5, min_move: float = 20.0) -> DataFrame:
    """Frames far from both neighbours, which are close to each other."""
    p, n = F.lag("value").over(_by()), F.lead("value").over(_by())
    d = timeline.select("cap", "f", F.abs(F.col("value") - p).alias("before"), F.abs(n - F.col("value")).alias("after"), F.abs(n - p).alias("across"))
    least = F.least("before", "after")
    return d.where(F.col("before").isNotNull() & F.col("after").isNotNull() & (least > min_move) & (F.col("across") < ratio * least))


def successor_edges(timeline: DataFrame, cluster: Column) -> DataFrame:
    """(a, b, n): clusters of consecutive frames, where they differ."""
    rows = timeline.withColumn("a", cluster)
    return rows.withColumn("b", F.lead("a").over(_by())).where("b is not null and a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


def known_around(timeline: DataFrame) -> DataFrame:
    """The nearest healthy frame before and after each frame."""
    known = F.when(~F.col("bad"), F.col("f"))
    return timeline.select("cap", "f", F.last(known, True).over(_by().rowsBetween(W.unboundedPreceding, -1)).alias("previous"), F.first(known, True).over(_by().rowsBetween(1, W.unboundedFollowing)).alias("next"))


def largest_run(timeline: DataFrame, gap: int = 4) -> DataFrame:
    """The longest group of healthy frames whose neighbours are at most ``gap`` apart; the first of equals."""
    own = timeline.where(~F.col("bad"))
    new = (F.col("f") - F.lag("f").over(_by()) > gap).cast("int")
    groups = own.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("run", F.sum("new").over(_by()))
    sizes = groups.groupBy("cap", "run").agg(F.count("*").alias("frames"), F.min("f").alias("first"), F.max("f").alias("last"))
    rank = F.row_number().over(W.partitionBy("cap").orderBy(F.desc("frames"), "first"))
    return sizes.withColumn("rank", rank).where("rank = 1").select("cap", "frames", "first", "last")


def runs_above(timeline: DataFrame, threshold: float = 30.0, least: int = 2, k: int = 8) -> DataFrame:
    """The k longest runs of consecutive frames with a value of at least ``threshold``."""
    island = F.col("f") - F.row_number().over(_by())
    runs = timeline.where(F.col("value") >= threshold).withColumn("island", island).groupBy("cap", "island").agg(F.min("f").alias("first"), F.count("*").alias("frames")).where(F.col("frames") >= least)
    rank = F.row_number().over(W.partitionBy("cap").orderBy(F.desc("frames"), "first"))
    return runs.withColumn("rank", rank).where(F.col("rank") <= k).select("cap", "first", "frames", "rank")


def map_deltas(timeline: DataFrame, jump: int = 3) -> DataFrame:
    """Steps of a map of frames: skipped, repeated and jumping ones."""
    v = F.floor(F.col("value")).cast("long")
    d = timeline.withColumn("v", v).withColumn("d", F.col("v") - F.lag("v").over(_by())).where("d is not null")
    return d.groupBy("cap").agg(F.count_if(F.col("d") > 1).alias("skips"), F.count_if(F.col("d") == 0).alias("repeats"), F.count_if(F.abs("d") > jump).alias("jumps"), F.min("d").alias("least"), F.max("d").alias("most"))


def neighbour_trust(timeline: DataFrame, win: int = 4, q: float = 0.25) -> DataFrame:
    """A low percentile of the neighbours' cost without the frame's own; its own cost where there are none."""
    around = F.concat(F.collect_list("value").over(_by().rowsBetween(-win, -1)), F.collect_list("value").over(_by().rowsBetween(1, win)))
    rows = timeline.withColumn("s", F.array_sort(around)).withColumn("at", q * (F.size("s") - 1))
    lo, hi = F.floor("at").cast("int"), F.ceil("at").cast("int")
    value = lambda i: F.try_element_at("s", i + 1)
    between = value(lo) + (value(hi) - value(lo)) * (F.col("at") - F.floor("at"))
    return rows.select("cap", "f", F.when(F.size("s") > 0, between).otherwise(F.col("value")).alias("trust"))


def smooth_anchors(anchors: DataFrame, tolerance: int = 10, least: int = 7) -> DataFrame:
    """Drop anchors (cap, f, g) whose offset is far from the upper median of the three before and three after."""
    rows = anchors.withColumn("offset", F.col("g") - F.col("f"))
    around = F.array_sort(F.concat(F.collect_list("offset").over(_by().rowsBetween(-3, -1)), F.collect_list("offset").over(_by().rowsBetween(1, 3))))
    rows = rows.withColumn("s", around).withColumn("n", F.count("*").over(W.partitionBy("cap")))
    median = F.try_element_at("s", F.floor(F.size("s") / 2).cast("int") + 1)
    keep = (F.col("n") < least) | (F.size("s") == 0) | (F.abs(F.col("offset") - median) <= tolerance)
    return rows.where(keep).select("cap", "f", "g")


def freeze_last(timeline: DataFrame) -> DataFrame:
    """Missing frames show the last one before them; frames before the first known one stay missing."""
    known = F.when(~F.col("bad"), F.col("value"))
    at = F.when(~F.col("bad"), F.col("f"))
    w = _by().rowsBetween(W.unboundedPreceding, 0)
    return timeline.select("cap", "f", F.last(known, True).over(w).alias("value"), F.last(at, True).over(w).alias("shown"), F.col("bad").alias("missing"))


def sliding_windows(timeline: DataFrame, width: int = 30, step: int = 24) -> DataFrame:
    """Overlapping windows of frames: sizes, and the core each one is alone to emit."""
    first = F.greatest(F.lit(0), F.ceil((F.col("f") - width + 1) / step)).cast("long")
    rows = timeline.withColumn("window", F.explode(F.sequence(first, F.floor(F.col("f") / step).cast("long"))))
    start = F.col("window") * step
    margin = (width - step) // 2
    core = F.when((F.col("f") >= start + F.when(F.col("window") == 0, 0).otherwise(margin)) & (F.col("f") < start + step + margin), 1).otherwise(0)
    return rows.groupBy("cap", "window").agg(F.count("*").alias("frames"), F.sum(core).alias("core"), F.min("f").alias("first"), F.max("f").alias("last"), F.count_if("bad").alias("bad"))


def core_ranges(timeline: DataFrame, step: int = 24) -> DataFrame:
    """Where each window's core begins and ends: the first healthy frame at or after its boundary."""
    good = F.when(~F.col("bad"), F.col("f"))
    at = timeline.select("cap", "f", F.first(good, True).over(_by().rowsBetween(0, W.unboundedFollowing)).alias("k"), (F.max("f").over(W.partitionBy("cap")) + 1).alias("n")).where(F.col("f") % step == 0)
    # A window's end is the next one's beginning; the last one ends with the capture.
    following = F.lead("k").over(_by())
    return at.select("cap", (F.col("f") / step).cast("long").alias("window"), F.coalesce("k", "n").alias("k0"), F.coalesce(following, "n").alias("k1"))


def rebased(timeline: DataFrame) -> DataFrame:
    """Positions after the bad frames are dropped."""
    dropped = F.sum(F.col("bad").cast("int")).over(_by().rowsBetween(W.unboundedPreceding, 0))
    return timeline.withColumn("position", F.col("f") - dropped).where(~F.col("bad")).select("cap", "f", "position")


def interpolated_position(timeline: DataFrame) -> DataFrame:
    """Values of bad frames on the line between their known neighbours; outside, along the overall slope."""
    known_f, known_v = F.when(~F.col("bad"), F.col("f")), F.when(~F.col("bad"), F.col("value"))
    before, after = _by().rowsBetween(W.unboundedPreceding, -1), _by().rowsBetween(1, W.unboundedFollowing)
    whole = W.partitionBy("cap").orderBy("f").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = timeline.select(
        "cap", "f", "value", "bad",
        F.last(known_f, True).over(before).alias("f0"), F.last(known_v, True).over(before).alias("v0"), F.first(known_f, True).over(after).alias("f1"), F.first(known_v, True).over(after).alias("v1"),
        F.first(known_f, True).over(whole).alias("fa"), F.first(known_v, True).over(whole).alias("va"), F.last(known_f, True).over(whole).alias("fz"), F.last(known_v, True).over(whole).alias("vz"),
    )
    slope = (F.col("vz") - F.col("va")) / F.greatest(F.col("fz") - F.col("fa"), F.lit(1))
    inside = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("f") - F.col("f0")) / (F.col("f1") - F.col("f0"))
    est = F.when(~F.col("bad"), F.col("value")).when(F.col("f0").isNull(), F.col("va") - (F.col("fa") - F.col("f")) * slope).when(F.col("f1").isNull(), F.col("vz") + (F.col("f") - F.col("fz")) * slope).otherwise(inside)
    return rows.select("cap", "f", est.alias("position"))
