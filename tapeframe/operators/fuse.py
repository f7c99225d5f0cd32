"""Fusion of several reads of one unit, and imputation of what no read has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def _by() -> WindowSpec:
    """A capture's frames in order."""
    return W.partitionBy("cap").orderBy("f")

#: Read quality: marked damaged, healthy in an invalid segment, clean.
NONE, DOUBTFUL, CLEAN = 0, 2, 3


def reads_of_lineitem(lineitem: DataFrame) -> DataFrame:
    """Rows of one order line as reads (frame, slot, read, bad, false_ok, value) of one unit."""
    order = W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return lineitem.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").cast("long").alias("slot"), (F.row_number().over(order) - 1).cast("long").alias("read"), (F.col("l_returnflag") == "R").alias("bad"), (F.col("l_linestatus") == "F").alias("false_ok"), F.col("l_quantity").alias("value"))


def quality(reads: DataFrame) -> DataFrame:
    """3 clean, 2 healthy but its segment is invalid, 0 marked damaged."""
    return reads.withColumn("quality", F.when(F.col("bad"), NONE).when(F.col("false_ok"), DOUBTFUL).otherwise(CLEAN))


def source_order(reads: DataFrame) -> DataFrame:
    """Reads of each frame from the least damaged: (n_bad, n_false), then the read's index."""
    sums = reads.groupBy("frame", "read").agg(F.count_if("bad").alias("n_bad"), F.count_if(F.col("false_ok") & ~F.col("bad")).alias("n_false"))
    return sums.withColumn("rank", F.row_number().over(W.partitionBy("frame").orderBy("n_bad", "n_false", "read")))


def best_source(reads: DataFrame) -> DataFrame:
    """The best read of every slot; the lowest index among equals."""
    best = F.max_by(F.struct("read", "quality", "value"), F.struct(F.col("quality"), -F.col("read")))
    return quality(reads).groupBy("frame", "slot").agg(best.alias("b"), F.count("*").alias("reads")).select("frame", "slot", "reads", "b.read", "b.quality", "b.value")


def merge_frames(reads: DataFrame) -> DataFrame:
    """Each frame from one canvas: kept where the canvas is clean, else copied from the first clean read in order, else the best read.

    how: kept, copied, repacked, unresolved.
    """
    ranked = quality(reads).join(source_order(reads).select("frame", "read", "rank"), ["frame", "read"])
    canvas = F.max(F.when(F.col("rank") == 1, F.struct("quality", "value", "read")))
    clean = F.min(F.when(F.col("quality") == CLEAN, F.struct("rank", "read", "value")))
    best = F.max_by(F.struct("read", "quality", "value"), F.struct(F.col("quality"), -F.col("read")))
    s = ranked.groupBy("frame", "slot").agg(canvas.alias("canvas"), clean.alias("clean"), best.alias("best"))
    kept, copied, packed = F.coalesce(F.col("canvas.quality") == CLEAN, F.lit(False)), F.col("clean").isNotNull(), F.col("best.quality") > NONE
    how = F.when(kept, "kept").when(copied, "copied").when(packed, "repacked").otherwise("unresolved")
    pick = lambda c: F.when(kept, F.col(f"canvas.{c}")).when(copied, F.col(f"clean.{c}")).when(packed, F.col(f"best.{c}")).otherwise(F.coalesce(F.col(f"canvas.{c}"), F.col(f"best.{c}")))
    return s.select("frame", "slot", how.alias("how"), pick("read").alias("read"), pick("value").alias("value"))


def merge_report(merged: DataFrame) -> DataFrame:
    """Slots by how they came about, over all frames."""
    return merged.groupBy("how").agg(F.count("*").alias("slots"), F.countDistinct("frame").alias("frames"))


def canvas_flips(merged: DataFrame) -> DataFrame:
    """How often consecutive slots of a frame come from different reads."""
    w = W.partitionBy("frame").orderBy("slot")
    flips = merged.withColumn("before", F.lag("read").over(w))
    return flips.groupBy("frame").agg(F.count_if(F.col("before").isNotNull() & (F.col("before") != F.col("read"))).alias("flips"), F.count("*").alias("slots"))


# Gaps between anchors


def gap_policy(timeline: DataFrame, partner: DataFrame, max_gap: int = 40) -> DataFrame:
    """What to do between consecutive anchors (cap, f, g): keep the base, insert the donor's frames, or compare inside.

    ``timeline`` gives the captures' lengths; anchors are ``partner``.
    """
    rows = partner.withColumn("f1", F.lead("f").over(_by())).withColumn("g1", F.lead("g").over(_by())).where("f1 is not null")
    ga, gb = F.col("f1") - F.col("f") - 1, F.greatest(F.col("g1") - F.col("g") - 1, F.lit(0))
    rows = rows.withColumn("ga", ga).withColumn("gb", gb)
    rule = F.when(F.col("gb") == 0, "keep").when(F.col("ga") == 0, "insert").when(F.col("gb") > max_gap, "keep").otherwise("pair")
    length = timeline.groupBy("cap").agg((F.max("f") + 1).alias("n"))
    return rows.join(length, "cap").select("cap", "f", "f1", "ga", "gb", rule.alias("rule"), (F.when(F.col("gb") == 0, 0).when(F.col("ga") == 0, F.col("gb")).otherwise(0)).alias("inserted"), "n")


def gap_anti_join(timeline: DataFrame, reach: int = 60) -> DataFrame:
    """Donor frames without an equal healthy base frame in the next ``reach`` frames."""
    donor = timeline.where(~F.col("bad")).select((F.col("cap") - 1).alias("cap"), F.col("f").alias("g"), "kind")
    # Equal kinds meet in buckets of ``reach`` frames, so that the range is an equality on bucket.
    bucket = lambda c: F.floor(F.col(c) / reach).cast("long")
    base = timeline.where(~F.col("bad")).select("cap", "f", F.col("kind"), bucket("f").alias("b"))
    probe = donor.withColumn("b", F.explode(F.array(bucket("g"), bucket("g") + 1)))
    met = probe.join(base, ["cap", "kind", "b"]).where((F.col("f") >= F.col("g")) & (F.col("f") < F.col("g") + reach)).select("cap", "g").distinct()
    return donor.join(met, ["cap", "g"], "left_anti").select("cap", "g", "kind")


def orphan_drop(timeline: DataFrame, factor: float = 1.5, slack: float = 5.0) -> DataFrame:
    """Bad frames whose value is far above their healthy neighbours': ``value > factor * max(neighbours) + slack``."""
    good = F.when(~F.col("bad"), F.col("value"))
    rows = timeline.select("cap", "f", "bad", "value", F.last(good, True).over(_by().rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.first(good, True).over(_by().rowsBetween(1, W.unboundedFollowing)).alias("after"))
    limit = factor * F.greatest("before", "after") + slack
    return rows.where("bad and before is not null and after is not null").select("cap", "f", "value", limit.alias("limit"), (F.col("value") > limit).alias("dropped"))


# Imputation


def around(timeline: DataFrame) -> DataFrame:
    """Each frame with its nearest healthy frames before and after, and their values."""
    known = F.when(~F.col("bad"), F.struct("f", "value"))
    rows = timeline.select("cap", "f", "value", "bad", F.last(known, True).over(_by().rowsBetween(W.unboundedPreceding, -1)).alias("p"), F.first(known, True).over(_by().rowsBetween(1, W.unboundedFollowing)).alias("n"))
    return rows.select("cap", "f", "value", "bad", F.col("p.f").alias("j1"), F.col("p.value").alias("v1"), F.col("n.f").alias("j2"), F.col("n.value").alias("v2"))


def nearest_source(timeline: DataFrame, reach: int = 25) -> DataFrame:
    """The nearest healthy frame of every bad one, the earlier of two at one distance; null beyond ``reach``."""
    a = around(timeline).where("bad")
    d1, d2 = F.col("f") - F.col("j1"), F.col("j2") - F.col("f")
    near = F.when(d1 <= F.coalesce(d2, d1), F.col("j1")).otherwise(F.coalesce("j2", "j1"))
    a = a.withColumn("source", near)
    return a.select("cap", "f", F.when(F.abs(F.col("source") - F.col("f")) <= reach, F.col("source")).alias("source"))


def bridge(timeline: DataFrame) -> DataFrame:
    """The part of the movement between two healthy frames that falls to a frame between them, from the nearer one."""
    a = around(timeline).where("bad and j1 is not null and j2 is not null")
    near = F.when(F.col("f") - F.col("j1") <= F.col("j2") - F.col("f"), F.col("j1")).otherwise(F.col("j2"))
    move = (F.col("v2") - F.col("v1")) * F.abs(F.col("f") - near) / (F.col("j2") - F.col("j1"))
    return a.select("cap", "f", near.alias("near"), move.alias("move"))


def lerp(timeline: DataFrame, span: int = 10) -> DataFrame:
    """Bad frames on the line between healthy ones at less than ``span`` frames on either side; null otherwise."""
    a = around(timeline).where("bad")
    t = (F.col("f") - F.col("j1")) / (F.col("j2") - F.col("j1"))
    close = (F.col("f") - F.col("j1") < span) & (F.col("j2") - F.col("f") < span)
    return a.select("cap", "f", F.when(close, (1 - t) * F.col("v1") + t * F.col("v2")).alias("value"))


def conceal(timeline: DataFrame, reach: int = 25, threshold: float = 20.0, outlier: float = 3.0) -> DataFrame:
    """How each bad frame is filled: copied if its source is close in motion or the frame is an outlier, else rejected, else none."""
    a = around(timeline).where("bad").join(nearest_source(timeline, reach), ["cap", "f"])
    value = F.when(F.col("source") == F.col("j1"), F.col("v1")).when(F.col("source") == F.col("j2"), F.col("v2"))
    a = a.withColumn("candidate", value).withColumn("score", F.abs(F.col("v2") - F.col("v1")))
    keep = F.abs(F.col("value") - F.col("candidate"))
    how = F.when(F.col("candidate").isNull(), "none").when(F.coalesce("score", F.lit(0.0)) <= threshold, "copied").when(keep > outlier * F.greatest("score", F.lit(4.0)), "outlier").otherwise("rejected")
    return a.select("cap", "f", "source", how.alias("how"), F.when(how.isin("copied", "outlier"), F.col("candidate")).otherwise(F.col("value")).alias("value"))


def conceal_report(concealed: DataFrame) -> DataFrame:
    return concealed.groupBy("how").agg(F.count("*").alias("frames"), F.countDistinct("cap").alias("caps"))


def reference_rescue(concealed: DataFrame, reference: DataFrame, gate: float = 30.0) -> DataFrame:
    """Frames without a copy take the reference's value where it is within the gate of the frame's own."""
    r = concealed.join(reference.select("cap", "f", F.col("value").alias("ref")), ["cap", "f"], "left")
    use = F.col("how").isin("none", "rejected") & F.col("ref").isNotNull() & (F.abs(F.col("ref") - F.col("value")) <= gate)
    return r.select("cap", "f", F.when(use, "reference").otherwise(F.col("how")).alias("how"), F.when(use, F.col("ref")).otherwise(F.col("value")).alias("value"))


def write_back(merged: DataFrame, segment: int = 5) -> DataFrame:
    """Segments whose slots come from one read are copied whole, others are packed again; what was unresolved stays marked."""
    rows = merged.withColumn("segment", F.floor(F.col("slot") / segment).cast("long"))
    s = rows.groupBy("frame", "segment").agg(F.countDistinct("read").alias("reads"), F.count_if(F.col("how") == "unresolved").alias("marked"), F.count("*").alias("slots"))
    how = F.when((F.col("reads") == 1) & (F.col("marked") == 0), "whole").when(F.col("marked") == F.col("slots"), "untouched").otherwise("packed")
    return s.withColumn("written", how)
