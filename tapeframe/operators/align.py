"""Signatures and their alignment.  Signatures are (seq, f, sig): vectors of a sequence in order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeframe.functions.tables import stored
from tapeframe.operators import sequence

#: Reference frames that are compared with the sampled frames of a sequence at once.
BLOCK = 256


def of_embeddings(embeddings: DataFrame) -> DataFrame:
    """Vectors of one label as the frames of a sequence, in the order of their ids."""
    return embeddings.select(F.col("label").cast("long").alias("seq"), (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("f"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("sig"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def normalized(rows: DataFrame) -> DataFrame:
    """Signatures less their mean, at unit length (at least 1e-6)."""
    centred = rows.withColumn("mean", _sum(F.col("sig")) / F.size("sig")).withColumn("sig", F.transform("sig", lambda x: x - F.col("mean")))
    norm = F.greatest(F.sqrt(_sum(F.transform("sig", lambda x: x * x))), F.lit(1e-6))
    return centred.withColumn("norm", norm).withColumn("sig", F.transform("sig", lambda x: x / F.col("norm")))


def dot(a: str, b: str) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def queries_of(rows: DataFrame, gain: float = 0.95, offset: float = 4.0) -> DataFrame:
    """A second recording of the sequence: its signatures, changed in gain and offset."""
    return rows.select("seq", "f", F.transform("sig", lambda x: x * gain + offset).alias("sig"))


def banded(reference: DataFrame, query: DataFrame, stride: float = 1.0, band: int = 6) -> DataFrame:
    """(seq, f, v, corr): correlations of query frames with reference frames near their expected place."""
    n = normalized(query).select("seq", "f", F.col("sig").alias("q"))
    near = n.withColumn("v", F.explode(F.sequence((F.col("f") * stride).cast("long") - band, (F.col("f") * stride).cast("long") + band)))
    r = normalized(reference).select("seq", F.col("f").alias("v"), F.col("sig").alias("r"))
    return near.join(r, ["seq", "v"]).select("seq", "f", "v", dot("q", "r").alias("corr"))


def anchor_argmax(corr: DataFrame, least: float = 0.9) -> DataFrame:
    """The best reference frame of each query frame, the first of equals, and whether it is an anchor."""
    best = corr.groupBy("seq", "f").agg(F.max_by(F.struct("v", "corr"), F.struct(F.round("corr", 9), -F.col("v"))).alias("b"))
    return best.select("seq", "f", "b.v", "b.corr", (F.col("b.corr") >= least).alias("anchor"))


def winsorized_cost(corr: DataFrame, q: float = 0.9) -> DataFrame:
    """Costs 1 - corr, cut at their row's quantile."""
    cost = corr.withColumn("cost", 1 - F.col("corr"))
    cut = cost.groupBy("seq", "f").agg(F.percentile("cost", F.lit(q)).alias("cut"))
    return cost.join(cut, ["seq", "f"]).select("seq", "f", "v", F.least("cost", "cut").alias("cost"))


def margins(cost: DataFrame, away: int = 3) -> DataFrame:
    """Best cost of each frame, and how much worse the best one more than ``away`` frames off is."""
    best = cost.groupBy("seq", "f").agg(F.min_by(F.struct("v", "cost"), F.struct(F.round("cost", 9), "v")).alias("b"))
    far = cost.join(best, ["seq", "f"]).where(F.abs(F.col("v") - F.col("b.v")) > away).groupBy("seq", "f").agg(F.min("cost").alias("second"))
    return best.join(far, ["seq", "f"], "left").select("seq", "f", "b.v", "b.cost", (F.col("second") - F.col("b.cost")).alias("margin"))


# The whole alignment: anchors against all of the reference, a band around them, and the cheapest path


def dense_anchors(reference: DataFrame, query: DataFrame, every: int = 25, least: float = 0.90, min_health: float = 0.30) -> DataFrame:
    """(seq, f, v, corr): the best of all reference frames for every ``every``-th frame that is healthy, the first of equals.

    The sampled frames of a sequence go to each block of its reference; a block yields one candidate for each of them,
    from one matrix product.  ``query`` is (seq, f, health, sig).
    """
    sampled = normalized(query.where((F.col("f") % every == 0) & (F.col("health") >= min_health)).select("seq", "f", "sig")).select("seq", "f", "sig")
    ref = normalized(reference).select("seq", F.col("f").alias("v"), "sig", F.floor(F.col("f") / BLOCK).cast("long").alias("block"))
    parts = ref.select(F.col("seq").alias("s"), (F.col("block") + 0).alias("part")).distinct()
    met = sampled.join(parts, F.col("seq") == F.col("s")).drop("s")

    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"seq": [], "f": [], "v": [], "corr": []}).astype({"seq": "int64", "f": "int64", "v": "int64"})
        r = r.sort_values("v")
        corr = np.stack(q["sig"].to_numpy()) @ np.stack(r["sig"].to_numpy()).T
        at = corr.round(9).argmax(axis=1)
        return pd.DataFrame({"seq": q["seq"], "f": q["f"], "v": r["v"].to_numpy()[at], "corr": corr[np.arange(len(q)), at]})

    found = met.groupBy("seq", "part").cogroup(ref.groupBy("seq", "block")).applyInPandas(best, "seq long, f long, v long, corr double")
    return anchor_argmax(found, least).where("anchor").drop("anchor")


def centres(query: DataFrame, anchors: DataFrame) -> DataFrame:
    """(seq, f, centre): places between the anchors on a line, and those of the first and the last beyond them."""
    w = W.partitionBy("seq").orderBy("f")
    at = query.select("seq", "f").join(anchors.select("seq", "f", "v"), ["seq", "f"], "left")
    known = F.when(F.col("v").isNotNull(), F.struct("f", "v"))
    both = at.withColumn("lo", F.last(known, True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("hi", F.first(known, True).over(w.rowsBetween(0, W.unboundedFollowing)))
    lo, hi = F.col("lo"), F.col("hi")
    between = lo["v"] + (hi["v"] - lo["v"]) * (F.col("f") - lo["f"]) / F.greatest(hi["f"] - lo["f"], F.lit(1))
    return both.where(lo.isNotNull() | hi.isNotNull()).select("seq", "f", F.rint(F.when(lo.isNull(), hi["v"]).when(hi.isNull(), lo["v"]).otherwise(between)).cast("long").alias("centre"))


def aligned(reference: DataFrame, query: DataFrame, band: int = 60, max_skip: int = 24, lam: float = 0.010, mu: float = 0.060, every: int = 25, no_match: float = 0.20, min_health: float = 0.05) -> DataFrame:
    """(seq, f, v, cost, margin): the reference frame of every frame of ``query`` (seq, f, health, sig).

    Anchors that rise together give a centre; costs 1 - corr of the 2 * band + 1 places around it are cut at their
    90 % quantile; frames that are blind or match nothing have no say in the path but keep their cost and margin.
    Sequences with fewer than two anchors are left out: the reference does not have their material.
    """
    spark = query.sparkSession
    anchors = sequence.max_weight_subsequence(dense_anchors(reference, query, every))
    anchors = stored(spark, anchors.withColumn("n", F.count("*").over(W.partitionBy("seq"))).where("n > 1").drop("n"), "anchors")
    size = reference.groupBy("seq").agg((F.max("f") + 1).alias("size"))
    # The band is moved inside the reference, not cut at its ends.
    low = F.greatest(F.least(F.col("centre") - band, F.col("size") - (2 * band + 1)), F.lit(0))
    around = centres(query, anchors).join(size, "seq").select("seq", "f", low.alias("low"))
    places = around.withColumn("v", F.explode(F.sequence(F.col("low"), F.col("low") + 2 * band))).drop("low")
    q = normalized(query.select("seq", "f", "sig")).select("seq", "f", F.col("sig").alias("q"))
    r = normalized(reference).select("seq", F.col("f").alias("v"), F.col("sig").alias("r"))
    corr = places.join(r, ["seq", "v"]).join(q, ["seq", "f"]).select("seq", "f", "v", dot("q", "r").alias("corr"))
    cost = stored(spark, winsorized_cost(corr), "costs")
    silent = cost.groupBy("seq", "f").agg(F.min("cost").alias("least")).join(query.select("seq", "f", "health"), ["seq", "f"])
    silent = silent.select("seq", "f", ((F.col("health") < min_health) | (F.col("least") > no_match)).alias("silent"), (F.col("health") < min_health).alias("blind"))
    said = cost.join(silent, ["seq", "f"]).select("seq", "f", "v", F.when(F.col("silent"), 0.0).otherwise(F.col("cost")).alias("say"), F.when(F.col("blind"), 0.0).otherwise(F.col("cost")).alias("cost"))
    path = sequence.viterbi_align(said.select("seq", "f", "v", F.col("say").alias("cost")), lam=lam, mu=mu, max_skip=max_skip)
    far = margins(said.select("seq", "f", "v", F.col("say").alias("cost"))).select("seq", "f", F.coalesce("margin", F.lit(0.0)).alias("margin"))
    return path.join(said.select("seq", "f", "v", "cost"), ["seq", "f", "v"]).join(far, ["seq", "f"])


def second_recording(rows: DataFrame, skip: int = 40, repeat: int = 55, blind: int = 31) -> DataFrame:
    """(seq, f, health, sig, truth): a sequence recorded again: every ``skip``-th frame is lost with the two after it, every
    ``repeat``-th stands twice, and every ``blind``-th is noise without health; gain and offset differ."""
    kept = rows.where(F.col("f") % skip > 2).select("seq", F.col("f").alias("truth"), "sig", F.explode(F.when(F.col("f") % repeat == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    f = F.row_number().over(W.partitionBy("seq").orderBy("truth", "copy")) - 1
    kept = kept.withColumn("f", f.cast("long"))
    noise = F.transform("sig", lambda x, i: F.pmod(F.xxhash64("f", i), F.lit(1000)) / 500.0 - 1)
    blind_ = (F.col("f") % blind == blind - 1)
    return kept.select("seq", "f", F.when(blind_, 0.0).otherwise(1.0).alias("health"), F.when(blind_, noise).otherwise(F.transform("sig", lambda x: x * 0.95 + 4)).alias("sig"), "truth")
