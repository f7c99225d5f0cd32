"""Record linkage: fingerprints, votes, verification, and what follows from verified pairs.

A *block* is (cap, frame, blk, data): a unit of a frame of one capture (source).  Frames link by the
blocks they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeframe.functions.tables import stored

#: Fingerprints with more postings than this are no evidence.
MAX_PER_KEY = 400


def text_blocks(docs: DataFrame, cap: str = "source", frame: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines of documents as blocks."""
    return docs.select(F.col(cap).alias("cap"), F.col(frame).alias("frame"), F.posexplode(F.split(text, "\n")).alias("blk", "data"))


def healthy(data: str = "data") -> Column:
    """A block with content."""
    return F.length(F.trim(data)) > 0


def postings(blocks: DataFrame) -> DataFrame:
    """(cap, frame, h) of every healthy block: its fingerprint and where it stands."""
    return blocks.where(healthy()).select("cap", "frame", F.xxhash64("data").alias("h"), "data")


def key_sizes(blocks: DataFrame, limit: int = MAX_PER_KEY) -> DataFrame:
    """Postings of each repeated block, and whether they count as evidence."""
    return blocks.where(healthy()).groupBy("data").agg(F.count("*").alias("postings")).where("postings > 1").withColumn("kept", F.col("postings") <= limit)


def votes(blocks: DataFrame, limit: int = MAX_PER_KEY) -> DataFrame:
    """(cap, frame, cap2, frame2, votes): shared fingerprints between frames of different captures.

    The position of a block is no part of the key, so repeated content multiplies votes.  Keys above
    the limit are dropped before the join, which bounds the pairs of a key.
    """
    p = postings(blocks).drop("data")
    rare = p.groupBy("h").agg(F.count("*").alias("n")).where((F.col("n") <= limit) & (F.col("n") > 1)).select("h")
    kept = p.join(rare, "h")
    other = kept.select(F.col("cap").alias("cap2"), F.col("frame").alias("frame2"), "h")
    return kept.join(other, "h").where("cap <> cap2").groupBy("cap", "frame", "cap2", "frame2").agg(F.count("*").alias("votes"))


def top_candidates(voted: DataFrame, k: int, by: tuple[str, ...] = ("cap", "frame")) -> DataFrame:
    """The k best voted partners of each frame; ties go to the smaller capture and frame."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("votes"), "cap2", "frame2"))
    return voted.withColumn("rank", rank).where(F.col("rank") <= k)


def verify(pairs: DataFrame, blocks: DataFrame, min_blocks: int = 20, min_ratio: float = 0.9, min_audio: int = 20, audio_every: int = 4) -> DataFrame:
    """Compare pairs of frames block by block: n healthy in both, same, aud, ok.

    Audio blocks are every ``audio_every``-th block; they are counted only where the other tests hold.
    """
    own = blocks.where(healthy()).select("cap", "frame", "blk", "data")
    left = pairs.select("cap", "frame", "cap2", "frame2").join(own, ["cap", "frame"])
    right = own.select(F.col("cap").alias("cap2"), F.col("frame").alias("frame2"), "blk", F.col("data").alias("data2"))
    both = left.join(right, ["cap2", "frame2", "blk"])
    counted = both.groupBy("cap", "frame", "cap2", "frame2").agg(
        F.count("*").alias("n"), F.count_if(F.col("data") == F.col("data2")).alias("same"),
        F.count_if((F.col("data") == F.col("data2")) & (F.col("blk") % audio_every == 0)).alias("equal_audio"),
    )
    close = (F.col("n") >= min_blocks) & (F.col("same") >= min_ratio * F.col("n"))
    aud = F.when(close, F.col("equal_audio")).otherwise(0)
    return counted.select("cap", "frame", "cap2", "frame2", "n", "same", aud.alias("aud"), (close & (aud >= min_audio)).alias("ok"))


def first_verified(blocks: DataFrame, candidates: int = 40, limit: int = MAX_PER_KEY, **how) -> DataFrame:
    """The best voted verified partner of each frame in each other capture."""
    best = top_candidates(votes(blocks, limit), candidates)
    good = verify(best, blocks, **how).where("ok").select("cap", "frame", "cap2", "frame2")
    return top_candidates(best.drop("rank").join(good, ["cap", "frame", "cap2", "frame2"]), 1, ("cap", "frame", "cap2")).drop("rank")


def base_matches(blocks: DataFrame, base: str, candidates: int = 40, limit: int = MAX_PER_KEY, **how) -> DataFrame:
    """The first verified frame of a base capture for each frame of the others.

    Only the base is indexed: its postings alone count for the limit, and donors meet nothing but the base.
    """
    p = postings(blocks).drop("data")
    own = p.where(F.col("cap") == base)
    rare = own.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") <= limit).select("h")
    build = own.join(rare, "h").select(F.col("cap").alias("cap2"), F.col("frame").alias("frame2"), "h")
    voted = p.where(F.col("cap") != base).join(build, "h").groupBy("cap", "frame", "cap2", "frame2").agg(F.count("*").alias("votes"))
    best = top_candidates(voted, candidates)
    good = verify(best, blocks, **how).where("ok").select("cap", "frame", "cap2", "frame2")
    return top_candidates(best.drop("rank").join(good, ["cap", "frame", "cap2", "frame2"]), 1).drop("rank")


def triage(matched: DataFrame) -> DataFrame:
    """What each donor has of a base capture, from ``base_matches``: matched frames and their ranges."""
    return matched.groupBy(F.col("cap").alias("donor")).agg(F.count("*").alias("matched"), F.min("frame2").alias("base_lo"), F.max("frame2").alias("base_hi"), F.min("frame").alias("don_lo"), F.max("frame").alias("don_hi"))


def triage_summary(triaged: DataFrame, least: int = 2) -> DataFrame:
    """Totals over the donors with enough matches."""
    return triaged.where(F.col("matched") >= least).agg(F.count("*").alias("donors"), F.coalesce(F.sum("matched"), F.lit(0)).alias("matched"), F.min("base_lo").alias("base_lo"), F.max("base_hi").alias("base_hi"))


def clip_ranges(matched: DataFrame, lengths: DataFrame, margin: int = 25) -> DataFrame:
    """Per pair of captures, the range of partner frames with a margin, inside the partner's frames."""
    found = matched.groupBy("cap", "cap2").agg(F.min("frame2").alias("lo"), F.max("frame2").alias("hi"), F.count("*").alias("matched"))
    size = lengths.select(F.col("cap").alias("cap2"), "first", "last")
    return found.join(size, "cap2").select("cap", "cap2", "matched", F.greatest(F.col("lo") - margin, "first").alias("start"), F.least(F.col("hi") + margin, "last").alias("stop"))


def lengths(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("cap").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))


def similarity_top(blocks: DataFrame, k: int = 10, limit: int = 200) -> DataFrame:
    """The k most similar frames of each frame: equal blocks at equal positions, over the smaller block count.

    All keys count, whatever their number of postings.  Frames with equal blocks throughout are one class: pairs are
    made between classes and given to their frames at the end, of which a frame needs k + 1 a class at most.

    Pairs come from keys with ``limit`` postings at most, whose number grows with the postings, and are counted in all
    keys.  What shares only more frequent keys is scored as the sets of those: frames with one such set and one size are
    one group, and of what groups share a group needs its k + 1 best frames.  For a pair with rarer keys in common this
    is too low a score, never too high, and the pair is also there with its own.
    """
    spark = blocks.sparkSession
    own = blocks.where(healthy()).where("frame is not null").select("frame", F.struct("blk", F.xxhash64("data").alias("h")).alias("key"))
    frames = own.groupBy("frame").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    frames = stored(spark, frames.select("frame", F.xxhash64("keys").alias("class"), F.size("keys").alias("size"), "keys"), "frames")
    classes = frames.groupBy("class").agg(F.min(F.struct("frame", "size", "keys")).alias("s"), F.count("*").alias("copies"))
    classes = stored(spark, classes.select("class", "s.size", "s.keys", "copies"), "classes")
    size = classes.select("class", "size")
    posted = classes.select("class", F.explode("keys").alias("key")).select("class", "key.blk", "key.h")
    postings = stored(spark, posted.groupBy("blk", "h").agg(F.count("*").alias("n")).where("n > 1"), "postings")
    rare = posted.join(postings.where(F.col("n") <= limit).drop("n"), ["blk", "h"])
    often = posted.join(postings.where(F.col("n") > limit).drop("n"), ["blk", "h"])

    # Sets of frequent keys, and what they share.
    held = often.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("blk", "h"))).alias("often"))
    held = stored(spark, held.select("class", F.xxhash64("often").alias("set"), "often").join(size, "class"), "sets")
    sets = held.groupBy("set").agg(F.min("often").alias("often")).select("set", F.explode("often").alias("key"))
    shared = sets.join(sets.withColumnRenamed("set", "set2"), "key").groupBy("set", "set2").agg(F.count("*").alias("also"))
    shared = stored(spark, shared, "shared")

    # Pairs of classes by rarer keys, with all they share.
    half = rare.join(rare.withColumnRenamed("class", "class2"), ["blk", "h"]).where("class < class2").groupBy("class", "class2").agg(F.count("*").alias("same"))
    mine = classes.select("class", "size").join(held.select("class", "set"), "class", "left")
    other = mine.select(*(F.col(c).alias(f"{c}2") for c in mine.columns))
    half = half.join(mine, "class").join(other, "class2").join(shared, ["set", "set2"], "left").withColumn("same", F.col("same") + F.coalesce("also", F.lit(0)))
    scored = half.select("class", "class2", "same", (F.col("same") / F.least("size", "size2")).alias("similarity"))
    scored = scored.unionByName(scored.select(F.col("class2").alias("class"), F.col("class").alias("class2"), "same", "similarity"))
    # A class with itself: a key that is m times in a frame (of several rows) counts m * m times.
    again = lambda a, x: F.when(a["key"] == x, a["m"]).otherwise(F.lit(0).cast("long"))
    runs = F.aggregate(
        "keys",
        F.struct(F.col("keys")[0].alias("key"), F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("same")),
        lambda a, x: F.struct(x.alias("key"), (again(a, x) + 1).alias("m"), (a["same"] + 2 * again(a, x) + 1).alias("same")),
    )
    itself = classes.where("copies > 1").select("class", F.col("class").alias("class2"), runs["same"].alias("same"), "size")
    scored = scored.unionByName(itself.withColumn("similarity", F.col("same") / F.col("size")).drop("size"))
    few = frames.select("class", "frame", F.row_number().over(W.partitionBy("class").orderBy("frame")).alias("n")).where(F.col("n") <= k + 1)
    near = scored.join(few.select(F.col("class").alias("class2"), F.col("frame").alias("frame2")), "class2").drop("class2")

    # The best frames of each group by frequent keys alone.
    def best(rows: DataFrame, by: tuple[str, ...], last: str, n: int) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("similarity"), F.desc("same"), last))
        return rows.withColumn("rank", rank).where(F.col("rank") <= n)

    number = F.row_number().over(W.partitionBy("set", "size").orderBy("frame"))
    first = frames.select("frame", "class").join(held.select("class", "set", "size"), "class").select("set", "size", "frame", number.alias("n"))
    first = stored(spark, first.where(F.col("n") <= k + 1), "first")
    group = first.where("n = 1").select("set", "size", F.col("frame").alias("least"))
    group2 = group.select(*(F.col(c).alias(f"{c}2") for c in group.columns))
    met = shared.join(group.drop("least"), "set").join(group2, "set2").select("set", "size", "set2", "size2", "least2", F.col("also").alias("same"), (F.col("also") / F.least("size", "size2")).alias("similarity"))
    met = best(met, ("set", "size"), "least2", k + 1).drop("rank", "least2")
    met = met.join(first.select(F.col("set").alias("set2"), F.col("size").alias("size2"), F.col("frame").alias("frame2")), ["set2", "size2"])
    met = best(met, ("set", "size"), "frame2", k + 1).select("set", "size", "frame2", "same", "similarity")
    near = near.unionByName(held.select("class", "set", "size").join(met, ["set", "size"]).drop("set", "size"))

    near = near.groupBy("class", "frame2").agg(F.max("same").alias("same"), F.max("similarity").alias("similarity"))
    rows = frames.select("frame", "class").join(best(near, ("class",), "frame2", k + 1).drop("rank"), "class").where("frame <> frame2")
    return best(rows, ("frame",), "frame2", k).select("frame", "frame2", "same", "similarity", "rank")


def offset_vote(voted: DataFrame, least: int = 2) -> DataFrame:
    """The offset between two captures with the most votes, from pairs with at least ``least``."""
    sums = voted.where(F.col("votes") >= least).groupBy("cap", "cap2", (F.col("frame") - F.col("frame2")).alias("offset")).agg(F.sum("votes").alias("votes"))
    rank = F.row_number().over(W.partitionBy("cap", "cap2").orderBy(F.desc("votes"), F.abs("offset"), "offset"))
    return sums.withColumn("rank", rank).where("rank = 1").drop("rank")


# Pairs of timelines (cap, f, ...): the partner of a capture is the next one


def positional_merge(timeline: DataFrame, base_start: int = 0, donor_start: int = 0) -> DataFrame:
    """Frame base_start + k beside donor_start + k: the donor's value where the base is bad and the donor is not."""
    donor = timeline.select((F.col("cap") - 1).alias("cap"), (F.col("f") - donor_start + base_start).alias("f"), F.col("value").alias("don_value"), F.col("bad").alias("don_bad"))
    joined = timeline.where(F.col("f") >= base_start).join(donor.where(F.col("f") >= base_start), ["cap", "f"], "left")
    take = F.col("bad") & (F.coalesce("don_bad", F.lit(True)) == F.lit(False))
    return joined.select("cap", "f", F.when(take, F.col("don_value")).otherwise(F.col("value")).alias("value"), take.alias("replaced"), (F.col("bad") & ~take).alias("still_bad"))


def offset_scan(timeline: DataFrame, reach: int = 4) -> DataFrame:
    """How well neighbouring captures agree at each small offset: frames healthy in both, and equal ones."""
    donor = timeline.where(~F.col("bad")).select((F.col("cap") - 1).alias("cap"), F.col("f").alias("f2"), F.col("kind").alias("kind2"))
    base = timeline.where(~F.col("bad")).select("cap", "f", "kind", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("offset")).withColumn("f2", F.col("f") + F.col("offset"))
    return base.join(donor, ["cap", "f2"]).groupBy("cap", "offset").agg(F.count("*").alias("both"), F.count_if(F.col("kind") == F.col("kind2")).alias("same"))


def diagnosis(timeline: DataFrame, offset: int = 14) -> DataFrame:
    """Donor frames beside the base at a fixed offset, with totals for each capture (f2 null)."""
    donor = timeline.select((F.col("cap") - 1).alias("cap"), F.col("f").alias("f2"), F.col("bad").alias("bad2"), F.col("kind").alias("kind2"))
    base = timeline.withColumn("f2", F.col("f") - offset)
    joined = base.join(donor, ["cap", "f2"])
    both = ~F.col("bad") & ~F.col("bad2")
    return joined.rollup("cap", "f2").agg(F.count_if(~F.col("bad")).alias("healthy_a"), F.count_if(~F.col("bad2")).alias("healthy_b"), F.count_if(both).alias("both"), F.count_if(both & (F.col("kind") == F.col("kind2"))).alias("equal")).where("cap is not null")


def refine_candidates(timeline: DataFrame, window: int = 40) -> DataFrame:
    """For each bad frame, the other capture's healthy frames strictly between its known neighbours in time.

    Both ends of every gap are sorted in among the other capture's frames, so that a gap's candidates
    follow from the frame after its beginning and the one before its end; gaps and frames never multiply.
    """
    w = W.partitionBy("cap").orderBy("f")
    known = F.when(~F.col("bad"), F.col("ts"))
    gaps = timeline.select("cap", "f", "bad", F.last(known, True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("lo"), F.first(known, True).over(w.rowsBetween(1, W.unboundedFollowing)).alias("hi")).where("bad and lo is not null and hi is not null")
    healthy_frames = timeline.where(~F.col("bad")).withColumn("r", F.row_number().over(w))
    # At one time an end stands before the frames, and a beginning after them: both are excluded.
    ends = gaps.select("cap", "f", F.explode(F.array(F.struct(F.col("hi").alias("t"), F.lit(0).alias("order")), F.struct(F.col("lo").alias("t"), F.lit(2).alias("order")))).alias("e")).select("cap", "f", "e.*", F.lit(None).cast("struct<g: bigint, r: int>").alias("donor"))
    donor = healthy_frames.select((F.col("cap") - 1).alias("cap"), F.lit(None).cast("long").alias("f"), F.col("ts").alias("t"), F.lit(1).alias("order"), F.struct(F.col("f").alias("g"), "r").alias("donor"))
    along = W.partitionBy("cap").orderBy("t", "order")
    met = ends.unionByName(donor).select(
        "cap", "f", "order",
        F.last("donor", True).over(along.rowsBetween(W.unboundedPreceding, 0)).alias("before"),
        F.first("donor", True).over(along.rowsBetween(0, W.unboundedFollowing)).alias("after"),
    ).where("f is not null")
    found = met.groupBy("cap", "f").agg(F.max(F.when(F.col("order") == 2, F.col("after"))).alias("a"), F.max(F.when(F.col("order") == 0, F.col("before"))).alias("z"))
    found = found.select("cap", "f", (F.col("z.r") - F.col("a.r") + 1).cast("long").alias("candidates"), F.col("a.g").alias("first"), F.col("z.g").alias("last"))
    return found.where((F.col("candidates") > 0) & (F.col("last") - F.col("first") <= window))
