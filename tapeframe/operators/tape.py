"""The index of a tape: which frames of which captures are one frame of the tape, and in which order these stand.

Votes propose partners, verification decides, clusters never hold a capture twice, chains of frames order them;
a second pass looks for partners where the order leaves few places; filler that no other capture has goes.
Captures are taken in windows, each of which is ordered by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeframe.functions.tables import stored
from tapeframe.operators import link, sequence


def _named(pairs: DataFrame) -> DataFrame:
    """Edges (a, cap_a, b, cap_b, votes, turn), each once, from pairs of reads."""
    a, b = (F.struct(F.xxhash64("window", c, f).alias("id"), F.col(c).alias("cap")) for c, f in (("cap", "frame"), ("cap2", "frame2")))
    both = pairs.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), "votes", "turn")
    return both.groupBy("x", "y").agg(F.max("votes").alias("votes"), F.min("turn").alias("turn")).select(F.col("x.id").alias("a"), F.col("x.cap").alias("cap_a"), F.col("y.id").alias("b"), F.col("y.cap").alias("cap_b"), "votes", "turn")


def clustered(spark: SparkSession, reads: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((window, cap, frame, cluster) of every read, edges refused by component); a read without a partner is its own cluster.

    ``pairs`` is (window, cap, frame, cap2, frame2, votes, turn); earlier turns are joined first.
    """
    edges = stored(spark, _named(pairs), "edges")
    joined = stored(spark, sequence.constrained_components(edges, sequence.plain_components(spark, edges.select("a", "b")), ("turn",)), "clusters")
    node = F.xxhash64("window", "cap", "frame")
    out = reads.select("window", "cap", "frame").withColumn("node", node).join(joined.select("node", "cluster"), "node", "left")
    return stored(spark, out.select("window", "cap", "frame", F.coalesce("cluster", "node").alias("cluster")), "reads"), joined


def in_order(spark: SparkSession, reads: DataFrame) -> DataFrame:
    """``reads`` with the place ``k`` of their cluster in the window."""
    rows = reads.select("window", "cluster", "cap", F.col("frame").alias("f"))
    return stored(spark, reads.join(sequence.ordered(spark, rows).select("window", "cluster", F.col("rank").alias("k")), ["window", "cluster"]), "ordered")


def refined(placed: DataFrame, blocks: DataFrame, bad: DataFrame, window: int = 40, **how) -> DataFrame:
    """Pairs that a second pass finds: (window, cap, frame, cap2, frame2).

    For a place and a capture that has no frame there, the frames strictly between the capture's nearest frames with
    a partner on either side are tried, if they are ``window`` + 1 at most, against the least damaged read of the place.  The first that
    is verified wins.
    ``bad`` is (window, cap, frame, n_bad) of every read.
    """
    least = placed.join(bad, ["window", "cap", "frame"]).groupBy("window", "k").agg(F.min_by(F.struct("cap", "frame"), F.struct("n_bad", "cap", "frame")).alias("read"))
    caps = bad.groupBy("window", F.col("cap").alias("cap2")).agg(F.min("frame").alias("low"), F.max("frame").alias("high"))
    shared = F.count("*").over(W.partitionBy("window", "k")) > 1
    own = placed.select("window", "k", F.col("cap").alias("cap2"), F.col("frame").alias("own"), F.when(shared, F.col("frame")).alias("known"))
    grid = least.join(caps, "window").join(own, ["window", "k", "cap2"], "left")
    w = W.partitionBy("window", "cap2").orderBy("k")
    grid = grid.withColumn("before", F.last("known", True).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("after", F.first("known", True).over(w.rowsBetween(1, W.unboundedFollowing)))
    lo, hi = F.coalesce(F.col("before") + 1, "low"), F.coalesce(F.col("after") - 1, "high")
    gaps = grid.where("own is null").select("window", "k", "read.cap", "read.frame", "cap2", lo.alias("lo"), hi.alias("hi")).where((F.col("hi") >= F.col("lo")) & (F.col("hi") - F.col("lo") <= window))
    tried = gaps.withColumn("frame2", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")
    # Only frames that are there, each window's own.
    tried = tried.join(bad.select("window", F.col("cap").alias("cap2"), F.col("frame").alias("frame2")), ["window", "cap2", "frame2"])
    seen = link.verify(tried.select("cap", "frame", "cap2", "frame2").distinct(), blocks, **how)
    hits = tried.join(seen.where("ok"), ["cap", "frame", "cap2", "frame2"])
    return hits.groupBy("window", "k", "cap", "frame", "cap2").agg(F.min("frame2").alias("frame2")).select("window", "cap", "frame", "cap2", "frame2", "k")


def build_index(spark: SparkSession, blocks: DataFrame, reads: DataFrame, candidates: int = 40, limit: int = link.MAX_PER_KEY, refine: bool = True, window: int = 40, drop_empty: float | None = 0.95, **how) -> tuple[DataFrame, DataFrame]:
    """((window, pos, cap, frame) of the tape's frames in order, a row of counts).

    ``reads`` is (window, cap, frame, n_bad, n_blocks) of every frame of every capture; ``blocks`` is (cap, frame, blk,
    data).  Pairs of different windows do not count.  A frame that one capture alone has and of which nearly all
    is bad is filler and is left out.
    """
    at = reads.select("window", "cap", "frame")
    pairs = link.first_verified(blocks, candidates, limit, **how).join(at, ["cap", "frame"]).join(at.select("window", F.col("cap").alias("cap2"), F.col("frame").alias("frame2")), ["window", "cap2", "frame2"])
    pairs = stored(spark, pairs.select("window", "cap", "frame", "cap2", "frame2", "votes", F.lit(0).alias("turn")), "pairs")
    found, joined = clustered(spark, reads, pairs)
    placed = in_order(spark, found)
    more = None
    if refine:
        hits = refined(placed, blocks, reads, window, **how)
        more = stored(spark, hits.select("window", "cap", "frame", "cap2", "frame2", F.lit(0).cast("long").alias("votes"), (F.col("k") + 1).cast("int").alias("turn")), "refined")
        found, joined = clustered(spark, reads, pairs.unionByName(more))
        placed = in_order(spark, found)
    size = W.partitionBy("window", "cluster")
    full = placed.join(reads.select("window", "cap", "frame", "n_bad", "n_blocks"), ["window", "cap", "frame"]).withColumn("size", F.count("*").over(size))
    empty = (F.col("size") == 1) & (F.col("n_bad") >= F.lit(drop_empty if drop_empty is not None else 2.0) * F.col("n_blocks"))
    full = stored(spark, full.withColumn("empty", empty), "index")
    kept = full.where("not empty").withColumn("pos", F.dense_rank().over(W.partitionBy("window").orderBy("k")) - 1).select("window", F.col("pos").cast("long").alias("pos"), "cap", "frame")
    clusters = full.groupBy("window", "cluster").agg(F.first("size").alias("size"), F.first("empty").alias("empty"), (F.count("*") > F.countDistinct("cap")).alias("twice"))
    counts = clusters.agg(
        F.count("*").alias("clusters"), F.sum(F.col("size") - 1).alias("links"), F.count_if("twice").alias("conflicts"), F.sum("size").alias("total_reads"), F.count_if("empty").alias("dropped_empty"),
        F.count_if(~F.col("empty")).alias("emitted"), F.count_if(F.col("size") > 1).alias("shared"),
    )
    one = F.lit(1).alias("one")
    refused = joined.select("component", "refused").distinct().agg(F.coalesce(F.sum("refused"), F.lit(0)).alias("refused"))
    both = (F.struct("cap", "frame"), F.struct(F.col("cap2").alias("cap"), F.col("frame2").alias("frame")))
    added = more.select("window", F.least(*both).alias("x"), F.greatest(*both).alias("y")).distinct().agg(F.count("*").alias("refined")) if more is not None else spark.range(1).select(F.lit(0).cast("long").alias("refined"))
    return kept, counts.select("*", one).join(refused.select("*", one), "one").join(added.select("*", one), "one").drop("one")
