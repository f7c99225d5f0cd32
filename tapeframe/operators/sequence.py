"""Algorithms that fold over a sequence or a graph component: one group each, on its own rows only.

They need the rows of a group in order and carry state from row to row, which no window frame can
express.  Groups are captures, sequences or components.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable
from graphlib import TopologicalSorter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeframe.functions.tables import stored

# Components


def plain_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(a, component): the smallest vertex reachable, by joins that halve distances until nothing changes."""
    both = stored(spark, edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    label, before = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")), None
    while True:
        label = stored(spark, label, "labels")
        now = label.agg(F.sum(F.col("component").cast("decimal(38,0)")), F.count("*")).first()
        if now == before:
            return label
        before = now
        near = both.join(label.select(F.col("a").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        jump = label.select(F.col("a").alias("component"), F.col("component").alias("root"))
        label = label.join(near, "a", "left").join(jump, "component", "left").select("a", F.least("component", F.coalesce("near", "component"), F.coalesce("root", "component")).alias("component"))


class Clusters:
    """Items joined in the order they are offered, as long as no capture would be twice in a cluster.

    A cluster is a list of members and a bit mask of their captures; the smaller list moves into the larger.
    """

    def __init__(self, captures: Iterable[object]) -> None:
        captures = list(captures)
        bit = {c: 1 << i for i, c in enumerate(dict.fromkeys(captures))}
        self.of = np.arange(len(captures))
        self.members = [[i] for i in range(len(captures))]
        self.mask = [bit[c] for c in captures]
        self.refused = self.linked = 0

    def join(self, a: int, b: int) -> bool:
        """Whether a and b are in one cluster now."""
        x, y = int(self.of[a]), int(self.of[b])
        if x == y:
            return True
        if self.mask[x] & self.mask[y]:
            self.refused += 1
            return False
        if len(self.members[x]) < len(self.members[y]):
            x, y = y, x
        self.of[self.members[y]] = x
        self.members[x] += self.members[y]
        self.mask[x] |= self.mask[y]
        self.members[y] = []
        self.linked += 1
        return True


def constrained_components(edges: DataFrame, component: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """(node, cap, cluster, component, refused): components in which no capture is twice, edge by edge from the most votes.

    ``edges`` is (a, cap_a, b, cap_b, votes); each plain component is one group.  ``refused`` is the number of
    edges that its component refused.  Columns in ``order`` come before the votes.
    """
    rows = edges.join(component.select("a", "component"), "a")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([*order, "votes", "a", "b"], ascending=[True] * len(order) + [False, True, True])
        captures = dict(zip(group["a"], group["cap_a"])) | dict(zip(group["b"], group["cap_b"]))
        names = sorted(captures)
        at = {n: i for i, n in enumerate(names)}
        clusters = Clusters(captures[n] for n in names)
        for a, b in zip(group["a"].map(at).tolist(), group["b"].map(at).tolist()):
            clusters.join(a, b)
        least = {int(k): names[min(clusters.members[k])] for k in set(clusters.of.tolist())}
        return pd.DataFrame({"node": names, "cap": [captures[n] for n in names], "cluster": [least[int(k)] for k in clusters.of], "component": group["component"].iloc[0], "refused": clusters.refused})

    return rows.groupBy("component").applyInPandas(run, "node long, cap string, cluster long, component long, refused long")


# Orders


def positions(spark: SparkSession, reads: DataFrame, rounds: int = 4) -> DataFrame:
    """(window, cluster, place): where each cluster stands on the scale of the window's first capture, its spine.

    Clusters with a frame of the spine stand at it.  In each round the others are placed along every capture with
    two placed clusters at least: between the nearest placed ones on either side, beyond the first and the
    last with the slope between these two.  Where captures differ the first one decides.  What is not placed
    after the rounds stands behind all others.
    """
    w = W.partitionBy("window", "cap").orderBy("f", "cluster")
    along = stored(spark, reads.select("window", "cluster", "cap", "f").withColumn("i", F.row_number().over(w) - 1).withColumn("spine", F.min("cap").over(W.partitionBy("window"))), "reads")
    place = stored(spark, along.groupBy("window", "cluster").agg(F.max(F.when(F.col("cap") == F.col("spine"), F.col("f").cast("double"))).alias("place")), "places")
    whole = W.partitionBy("window", "cap")
    line = lambda i, p, q: p["p"] + (q["p"] - p["p"]) * (i - p["i"]) / F.greatest(q["i"] - p["i"], F.lit(1))
    for _ in range(rounds):
        if place.where("place is null").isEmpty():
            break
        at = along.join(place, ["window", "cluster"])
        known = F.when(F.col("place").isNotNull(), F.struct("i", F.col("place").alias("p")))
        sides = at.select(
            "window", "cap", "cluster", "i", "place",
            F.last(known, True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("lo"), F.first(known, True).over(w.rowsBetween(1, W.unboundedFollowing)).alias("hi"),
            F.min(known).over(whole).alias("first"), F.max(known).over(whole).alias("last"), F.count("place").over(whole).alias("known"),
        ).where("place is null and known > 1")
        col = {c: F.col(c) for c in ("i", "lo", "hi", "first", "last")}
        slope = (col["last"]["p"] - col["first"]["p"]) / F.greatest(col["last"]["i"] - col["first"]["i"], F.lit(1))
        value = F.when(col["lo"].isNull(), col["first"]["p"] - (col["first"]["i"] - col["i"]) * slope).when(col["hi"].isNull(), col["last"]["p"] + (col["i"] - col["last"]["i"]) * slope).otherwise(line(col["i"], col["lo"], col["hi"]))
        found = sides.groupBy("window", "cluster").agg(F.min_by(value, F.struct("cap", "i")).alias("new"))
        place = stored(spark, place.join(found, ["window", "cluster"], "left").select("window", "cluster", F.coalesce("place", "new").alias("place")), "places")
    return place.select("window", "cluster", F.coalesce("place", F.max("place").over(W.partitionBy("window")) + 1, F.lit(0.0)).alias("place"))


def _tangled(after: dict[int, set[int]]) -> dict[int, int]:
    """The strongly connected component of each node, named by one of its nodes: by two walks through the graph."""
    back: dict[int, set[int]] = {k: set() for k in after}
    for a, bs in after.items():
        for b in bs:
            back[b].add(a)
    left, seen = [], set()
    for k in after:
        walk = [(k, iter(after[k]))] if k not in seen else []
        seen.add(k)
        while walk:
            node, rest = walk[-1]
            nxt = next((b for b in rest if b not in seen), None)
            if nxt is None:
                left.append(node)
                walk.pop()
            else:
                seen.add(nxt)
                walk.append((nxt, iter(after[nxt])))
    out: dict[int, int] = {}
    for k in reversed(left):
        waiting = [] if k in out else [k]
        while waiting:
            node = waiting.pop()
            if node not in out:
                out[node] = k
                waiting += [b for b in back[node] if b not in out]
    return out


def ranked(chains: list[list[int]], place: dict[int, float]) -> list[int]:
    """Nodes in an order that follows every chain, the smallest place first where there is a choice.

    Where chains contradict each other, which ties nodes into one knot, steps inside the knot that go back on
    the scale of places are left out.
    """
    after: dict[int, set[int]] = {k: set() for k in place}
    for chain in chains:
        for a, b in zip(chain, chain[1:]):
            if a != b:
                after[a].add(b)
    knot = _tangled(after)
    before: dict[int, set[int]] = {k: set() for k in place}
    for a, bs in after.items():
        for b in bs:
            if knot[a] != knot[b] or (place[a], a) < (place[b], b):
                before[b].add(a)
    sorter = TopologicalSorter(before)
    sorter.prepare()
    ready, out = [], []
    while sorter.is_active():
        for k in sorter.get_ready():
            heapq.heappush(ready, (place[k], k))
        _, k = heapq.heappop(ready)
        out.append(k)
        sorter.done(k)
    return out


def ordered(spark: SparkSession, reads: DataFrame) -> DataFrame:
    """(window, cluster, rank): the order of each window's clusters; reads are (window, cluster, cap, f)."""
    rows = reads.select("window", "cluster", "cap", "f").join(positions(spark, reads), ["window", "cluster"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["cap", "f", "cluster"])
        chains = [g["cluster"].tolist() for _, g in group.groupby("cap")]
        order = ranked(chains, dict(zip(group["cluster"], group["place"])))
        return pd.DataFrame({"window": group["window"].iloc[0], "cluster": order, "rank": range(len(order))})

    return rows.groupBy("window").applyInPandas(run, "window long, cluster long, rank long")


# Paths


def cheapest_path(first: np.ndarray, cost: np.ndarray, lam: float = 0.010, mu: float = 0.060, max_skip: int = 24) -> np.ndarray:
    """The cheapest non-decreasing path through rows of costs: staying costs mu, skipping g places lam * g; ends are free.

    Row f has the costs of the places first[f], first[f] + 1, ...; infinite where there is none.  Of equal ways the
    one from the smallest place is taken.  A row that no way reaches begins anew.
    """
    n, width = cost.shape
    steps = np.arange(max_skip + 1, -1, -1)
    price = np.where(steps == 0, mu, lam * (steps - 1))
    total, back = cost[0].astype(float), np.zeros((n, width), np.int64)
    for f in range(1, n):
        # from[k, j]: the total of the place ``steps[k]`` before place j of this row
        at = first[f] + np.arange(width)[None, :] - steps[:, None] - first[f - 1]
        inside = (at >= 0) & (at < width)
        ways = np.where(inside, total[np.clip(at, 0, width - 1)] + price[:, None], np.inf)
        # Sums of equal steps may differ in their last bits.
        best = ways.min(axis=0)
        pick = (ways <= best + 1e-12).argmax(axis=0)
        back[f] = at[pick, np.arange(width)]
        if not np.isfinite(best + cost[f]).any():
            best, back[f] = np.full(width, total.min()), int(total.argmin())
        total = best + cost[f]
    path = np.empty(n, np.int64)
    j = int(total.argmin())
    for f in range(n - 1, -1, -1):
        path[f] = first[f] + j
        j = int(back[f, j])
    return path


def viterbi_align(cost: DataFrame, **how) -> DataFrame:
    """(seq, f, v): the cheapest path of each sequence through its banded costs (seq, f, v, cost)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        names, row = np.unique(group["f"].to_numpy(), return_inverse=True)
        v = group["v"].to_numpy()
        first = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(first, row, v)
        table = np.full((len(names), int((v - first[row]).max()) + 1), np.inf)
        table[row, v - first[row]] = group["cost"].to_numpy()
        return pd.DataFrame({"seq": group["seq"].iloc[0], "f": names, "v": cheapest_path(first, table, **how)})

    return cost.groupBy("seq").applyInPandas(run, "seq long, f long, v long")


def heaviest_rise(values: list[int], weights: list[float]) -> list[int]:
    """Indices of the heaviest subsequence whose values do not fall; the earlier predecessor among equals.

    A tree of prefix maxima over the ranks of the values answers what ends best at a value or below.
    """
    if not len(values):
        return []
    rank = np.unique(values, return_inverse=True)[1] + 1
    size = int(rank.max())
    tree: list[tuple[float, int]] = [(0.0, 1)] * (size + 1)  # (weight, minus the index); weights of nothing are zero
    best, before = [], []
    for i, (r, w) in enumerate(zip(rank.tolist(), weights)):
        top, k = (0.0, 1), r
        while k:
            top = max(top, tree[k])
            k &= k - 1
        best.append(w + top[0])
        before.append(-top[1] if top[1] <= 0 else -1)
        own, k = (best[-1], -i), r
        while k <= size:
            tree[k] = max(tree[k], own)
            k += k & -k
    at = max(range(len(best)), key=lambda k: (best[k], -k))
    out = []
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def max_weight_subsequence(anchors: DataFrame) -> DataFrame:
    """(seq, f, v) of the anchors on each sequence's heaviest non-falling subsequence; anchors are (seq, f, v, corr)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("f").reset_index(drop=True)
        keep = heaviest_rise(g["v"].tolist(), g["corr"].tolist())
        return g.loc[keep, ["seq", "f", "v"]]

    return anchors.groupBy("seq").applyInPandas(run, "seq long, f long, v long")


# Folds


def fold(rows: DataFrame, by: str, order: list[str], schema: str, step: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Apply ``step`` to each group in order."""
    return rows.groupBy(by).applyInPandas(lambda g: step(g.sort_values(order)), schema)


def keep_canvas(damage: list[dict[int, int]], hysteresis: float = 0.2, slack: int = 8) -> list[int]:
    """The canvas of each frame: the one before, while its damage is at most best * (1 + hysteresis) + slack; else the best."""
    out: list[int] = []
    for row in damage:
        best = min(row, key=lambda k: (row[k], k))
        before = out[-1] if out else None
        out.append(before if before in row and row[before] <= row[best] * (1 + hysteresis) + slack else best)
    return out


def canvas_hysteresis(damage: DataFrame, hysteresis: float = 0.2, slack: int = 8) -> DataFrame:
    """(window, pos, canvas) from (window, pos, read, n_bad)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows = [(p, dict(zip(x["read"], x["n_bad"]))) for p, x in g.groupby("pos")]
        return pd.DataFrame({"window": g["window"].iloc[0], "pos": [p for p, _ in rows], "canvas": keep_canvas([r for _, r in rows], hysteresis, slack)})

    return fold(damage, "window", ["pos", "read"], "window long, pos long, canvas long", run)


def greedy(pairs: list[tuple[int, int]], monotone: bool) -> list[tuple[int, int]]:
    """Pairs taken in order, each base and donor once; a later donor only, if ``monotone``."""
    out, bases, donors, last = [], set(), set(), -1
    for f, g in pairs:
        if f not in bases and g not in donors and (not monotone or g > last):
            out.append((f, g))
            bases.add(f)
            donors.add(g)
            last = g
    return out


def _greedy(candidates: DataFrame, monotone: bool, order: list[str]) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        kept = greedy(list(zip(g["f"], g["g"])), monotone)
        return pd.DataFrame({"cap": g["cap"].iloc[0], "f": [f for f, _ in kept], "g": [x for _, x in kept]}).astype({"f": "int64", "g": "int64"})

    return fold(candidates, "cap", order, "cap long, f long, g long", run)


def monotone_anchors(candidates: DataFrame) -> DataFrame:
    """Anchors along the base in order, each donor frame after the one before; candidates are (cap, f, g)."""
    return _greedy(candidates, True, ["f", "g"])


def one_to_one(candidates: DataFrame) -> DataFrame:
    """Each donor frame in order takes the first free base frame among its candidates, the nearest to the offset first (``away``)."""
    return _greedy(candidates, False, ["g", "away", "f"])


def track(candidates: list[list[int]], window: int = 400) -> list[int]:
    """Per base frame, the donor: the one after the last if it is a candidate, else the candidate nearest to the last within the window, else -1."""
    out, last = [], None
    for c in candidates:
        if last is not None and last + 1 in c:
            pick = last + 1
        else:
            order = sorted(c, key=lambda g: (abs(g - last) if last is not None and abs(g - last) <= window else window + 1, c.index(g)))
            pick = order[0] if order else -1
        out.append(pick)
        last = pick if pick >= 0 else last
    return out


def tracked_pairs(candidates: DataFrame) -> DataFrame:
    """(cap, f, g) by tracking; several base frames may share a donor frame."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows = [(f, x["g"].tolist()) for f, x in g.groupby("f")]
        return pd.DataFrame({"cap": g["cap"].iloc[0], "f": [f for f, _ in rows], "g": track([r for _, r in rows])})

    return fold(candidates, "cap", ["f", "g"], "cap long, f long, g long", run)


def fit_segment(bits: list[list[int]], capacity: int, protected: set[int] = frozenset()) -> tuple[list[list[int]], int]:
    """Drop the last word of the block with the most words until a segment fits, unprotected blocks first; (words, dropped), -1 if it cannot."""
    left, dropped = [list(b) for b in bits], 0
    while sum(map(sum, left)) > capacity:
        pool = [i for i in range(len(left)) if i not in protected and left[i]] or [i for i in range(len(left)) if left[i]]
        if not pool:
            return left, -1
        left[max(pool, key=lambda i: (len(left[i]), -i))].pop()
        dropped += 1
    return left, dropped


def fitted_segments(words: DataFrame, capacity: int = 120) -> DataFrame:
    """(segment, words, dropped, bits) of segments whose blocks' words (segment, block, k, bits) are cut to a capacity.

    ``fit_segment`` as one running sum: the block with the most words loses its last one, so words go by their place in
    the block, last places first, and in one place by block.  From the other end, the words that stay are those up to
    the last one at which the sum of bits is within the capacity.  A null block is a block, null bits are none.
    """
    place = F.row_number().over(W.partitionBy("segment", "block").orderBy("k"))
    rows = words.select("segment", "block", F.coalesce(F.col("bits").cast("long"), F.lit(0)).alias("bits"), place.alias("place"))
    order = W.partitionBy("segment").orderBy("place", F.desc("block"))
    rows = rows.select("segment", F.row_number().over(order).alias("n"), F.sum("bits").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("total"))
    fits = F.when(F.col("total") <= capacity, F.struct("n", "total"))
    out = rows.groupBy("segment").agg(F.count("*").alias("all"), F.max(fits).alias("kept"))
    left = F.coalesce(F.col("kept.n").cast("long"), F.lit(0))
    dropped = F.when((left == 0) & F.lit(capacity < 0), F.lit(-1)).otherwise(F.col("all") - left)
    return out.select(F.col("segment").cast("long").alias("segment"), left.alias("words"), dropped.cast("long").alias("dropped"), F.coalesce("kept.total", F.lit(0)).alias("bits"))
