"""Damage states, counts and reports.  Reads are (frame, slot, read, bad, false_ok, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeframe.operators.fuse import around

#: States of a unit.
OK, BAD, FALSE_OK, SUSPECT = 0, 1, 2, 3
SEGMENT = 5


def damage_counts(reads: DataFrame) -> DataFrame:
    return reads.groupBy("frame").agg(F.count("*").alias("units"), F.count_if("bad").alias("n_bad"), F.count_if(F.col("false_ok") & ~F.col("bad")).alias("n_false"))


def block_state(reads: DataFrame) -> DataFrame:
    """OK, BAD (marked), SUSPECT (healthy beside a marked unit of its segment), FALSE_OK (healthy and alone invalid)."""
    segment = F.floor(F.col("slot") / SEGMENT).cast("long")
    rows = reads.withColumn("segment", segment)
    near = F.max("bad").over(W.partitionBy("frame", "segment"))
    state = F.when(F.col("bad"), BAD).when(near, SUSPECT).when(F.col("false_ok"), FALSE_OK).otherwise(OK)
    return rows.select("frame", "slot", "read", "segment", state.alias("state"))


def scan_totals(states: DataFrame) -> DataFrame:
    return states.groupBy("state").agg(F.count("*").alias("units"), F.countDistinct("frame").alias("frames"))


def worst_frames(states: DataFrame, k: int = 10) -> DataFrame:
    """The k frames with the most false and then marked units, later frames first."""
    n = lambda s: F.count_if(F.col("state") == s)
    return states.groupBy("frame").agg(n(FALSE_OK).alias("n_false"), n(BAD).alias("n_bad"), n(SUSPECT).alias("n_suspect")).orderBy(F.desc("n_false"), F.desc("n_bad"), F.desc("frame")).limit(k)


def legend(states: DataFrame) -> DataFrame:
    """One line of text for each frame: how many units are in each state."""
    n = lambda s: F.count_if(F.col("state") == s).cast("string")
    return states.groupBy("frame").agg(F.concat_ws(" ", F.concat(F.lit("ok="), n(OK)), F.concat(F.lit("bad="), n(BAD)), F.concat(F.lit("false="), n(FALSE_OK)), F.concat(F.lit("suspect="), n(SUSPECT))).alias("legend"))


def drop_empty(reads: DataFrame, share: float = 0.95) -> DataFrame:
    """Frames that stay: all but those with one read that is almost wholly damaged."""
    sums = reads.groupBy("frame").agg(F.countDistinct("read").alias("reads"), F.count("*").alias("units"), F.count_if("bad").alias("n_bad"))
    return sums.where(~((F.col("reads") == 1) & (F.col("n_bad") >= share * F.col("units"))))


def threshold_sweep(timeline: DataFrame, thresholds: tuple[float, ...] = (2, 3, 4, 5, 6, 8, 10, 12, 16, 40, 80), least: int = 20, wrong: float = 20.0) -> DataFrame:
    """Error of filling healthy frames from their neighbours, by the motion that is let through."""
    a = around(timeline).where("not bad and j1 is not null and j2 is not null")
    t = (F.col("f") - F.col("j1")) / (F.col("j2") - F.col("j1"))
    a = a.select(F.abs((1 - t) * F.col("v1") + t * F.col("v2") - F.col("value")).alias("error"), F.abs(F.col("v2") - F.col("v1")).alias("score"))
    rows = a.select("error", "score", F.explode(F.array(*(F.lit(float(x)) for x in thresholds))).alias("threshold"))
    sums = rows.groupBy("threshold").agg(F.count("*").alias("total"), F.count_if(F.col("score") <= F.col("threshold")).alias("n"), *_errors(F.when(F.col("score") <= F.col("threshold"), F.col("error")), wrong))
    return sums.where(F.col("n") >= least).select("threshold", (100.0 * F.col("n") / F.col("total")).alias("coverage"), "median", "p90", (100.0 * F.col("wrong") / F.col("n")).alias("wrong"))


def _errors(error: Column, wrong: float) -> list[Column]:
    return [F.percentile(error, F.lit(0.5)).alias("median"), F.percentile(error, F.lit(0.9)).alias("p90"), F.count_if(error > wrong).alias("wrong")]


def quantiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    p = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy(by).agg(p.alias("p"), F.count("*").alias("n")).select(by, "n", F.col("p")[0].alias("p25"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p75"))


def winsorized(rows: DataFrame, by: str, value: str, q: float = 0.9) -> DataFrame:
    """Values cut at their row's quantile: mean before and after."""
    cut = rows.groupBy(by).agg(F.percentile(value, F.lit(q)).alias("cut"))
    return rows.join(cut, by).groupBy(by).agg(F.avg(value).alias("mean"), F.avg(F.least(value, "cut")).alias("cut_mean"), F.count_if(F.col(value) > F.col("cut")).alias("n_cut"))


def coverage_bands(timeline: DataFrame, covered: float = 20.0, uncovered: float = 50.0) -> DataFrame:
    band = F.when(F.col("value") < covered, "covered").when(F.col("value") >= uncovered, "uncovered").otherwise("doubtful")
    sums = timeline.groupBy("cap", band.alias("band")).agg(F.count("*").alias("frames"))
    return sums.withColumn("share", F.col("frames") / F.sum("frames").over(W.partitionBy("cap")))


def alignment_report(timeline: DataFrame, weak: float = 1.0) -> DataFrame:
    """Cost at both ends, median and p90, and steps that hardly differ."""
    w = W.partitionBy("cap").orderBy("f")
    rows = timeline.withColumn("margin", F.abs(F.col("value") - F.lag("value").over(w)))
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.9)))
    return rows.groupBy("cap").agg(F.min_by("value", "f").alias("first"), F.max_by("value", "f").alias("last"), p.alias("p"), F.count_if(F.col("margin") < weak).alias("weak"), F.count("*").alias("frames")).select("cap", "first", "last", F.col("p")[0].alias("median"), F.col("p")[1].alias("p90"), "weak", "frames")


def repair_report(merged: DataFrame) -> DataFrame:
    """Of the frames of each capture: damaged before and after, and the share recovered."""
    sums = merged.groupBy("cap").agg(F.count("*").alias("frames"), F.count_if(F.col("replaced") | F.col("still_bad")).alias("before"), F.count_if("still_bad").alias("after"))
    return sums.select("cap", "frames", "before", "after", F.when(F.col("before") > 0, 100.0 * (F.col("before") - F.col("after")) / F.col("before")).alias("recovered"))
