"""The composed alignment and the composed index against known maps and tapes."""

import random

import numpy as np
import pytest

from tapeframe.operators import align, tape


def recorded(corrupt):
    """Fixed case: 500 signatures with a run of near-equal ones, read again from 30 with steps at 80, 150 and 220."""
    rng = np.random.default_rng(11)
    ref = rng.normal(size=(500, 35 * 43))
    for i in range(200, 240):
        ref[i] = ref[200] + rng.normal(scale=0.01, size=35 * 43)
    truth, v = [], 30
    for f in range(300):
        truth.append(v)
        v += 1 + 3 * (f in (80, 150)) + 5 * (f == 220)
    query = ref[truth] * 0.95 + 4.0
    if corrupt:
        bad = [b for b in np.random.default_rng(99).choice(500, 25, replace=False) if b not in set(truth)]
        ref[bad] = rng.normal(size=(len(bad), 35 * 43))
    return ref, query, truth


@pytest.mark.parametrize("corrupt", [False, True])
def test_a_known_map_is_recovered(spark, corrupt):
    ref, query, truth = recorded(corrupt)
    health = np.ones(len(query))
    query[[40, 41, 99]] = np.random.default_rng(5).normal(size=(3, query.shape[1]))
    health[[40, 41]] = 0.0
    r = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(ref)], "seq long, f long, sig array<double>")
    q = spark.createDataFrame([(0, i, float(h), x.tolist()) for i, (x, h) in enumerate(zip(query, health))], "seq long, f long, health double, sig array<double>")
    rows = align.aligned(r, q, band=40, max_skip=8, every=10).toPandas().sort_values("f")
    assert rows["v"].tolist() == truth
    cost = dict(zip(rows["f"], rows["cost"]))
    assert cost[99] > 0.2 and cost[40] == 0 and cost[7] < 1e-6


def test_anchors_look_at_all_of_the_reference(spark):
    rng = np.random.default_rng(3)
    ref = rng.normal(size=(700, 30))
    r = spark.createDataFrame([(s, i, x.tolist()) for s in (0, 1) for i, x in enumerate(ref)], "seq long, f long, sig array<double>")
    places = {0: [610, 3, 257, 256], 1: [0, 699, 5, 5]}
    q = spark.createDataFrame([(s, 5 * k, h, (ref[v] * 2 + 1).tolist()) for s, vs in places.items() for k, v in enumerate(vs) for h in (1.0,)] + [(0, 20, 0.1, ref[9].tolist()), (0, 25, 1.0, rng.normal(size=30).tolist())], "seq long, f long, health double, sig array<double>")
    got = {(x.seq, x.f): x.v for x in align.dense_anchors(r, q, every=5).collect()}
    assert got == {(s, 5 * k): v for s, vs in places.items() for k, v in enumerate(vs)}


def test_centres_lie_between_anchors(spark):
    q = spark.createDataFrame([(0, f) for f in range(8)] + [(1, 0)], "seq long, f long")
    a = spark.createDataFrame([(0, 2, 10), (0, 6, 18)], "seq long, f long, v long")
    assert sorted(map(tuple, align.centres(q, a).collect())) == [(0, f, int(np.interp(f, [2, 6], [10, 18]))) for f in range(8)]


def captures(seed, frames=60, caps=3, blocks=30):
    """Captures of one tape: each misses a few frames and damages some blocks; (cap, frame, blk, data) and the true frame of each read."""
    r = random.Random(seed)
    rows, truth = [], {}
    for c in range(caps):
        at = 0
        for t in range(frames):
            if c and r.random() < 0.15:
                continue
            harm = 0.9 if c == 1 and t % 13 == 5 else 0.1
            for b in range(blocks):
                data = "" if r.random() < harm else f"frame {t} block {b}"
                rows.append((f"c{c}", at, b, data))
            truth[f"c{c}", at] = t
            at += 1
    # A frame of filler that no other capture has.
    rows += [("c2", at, b, "") for b in range(blocks)]
    return rows, truth, ("c2", at)


def test_index_of_a_tape(spark):
    rows, truth, filler = captures(2)
    blocks = spark.createDataFrame(rows, "cap string, frame long, blk long, data string")
    n_bad = {}
    for c, f, _, data in rows:
        n_bad[c, f] = n_bad.get((c, f), 0) + (not data)
    reads = spark.createDataFrame([(0, c, f, n, 30) for (c, f), n in n_bad.items()], "window long, cap string, frame long, n_bad long, n_blocks long")
    index, stats = tape.build_index(spark, blocks, reads, min_blocks=2, min_audio=0)
    got = {}
    for x in index.collect():
        got.setdefault(x.pos, set()).add((x.cap, x.frame))
    order = [got[k] for k in sorted(got)]
    assert filler not in set().union(*order) and sorted(got) == list(range(len(got)))
    assert all(len({truth[r] for r in reads_}) == 1 and len({c for c, _ in reads_}) == len(reads_) for reads_ in order)
    times = [truth[next(iter(reads_))] for reads_ in order]
    assert times == sorted(times)
    whole = {t: {r for r, x in truth.items() if x == t} for t in set(truth.values())}
    assert sum(reads_ == whole[t] for reads_, t in zip(order, times)) >= 0.9 * len(whole)
    s = stats.first()
    assert (s.total_reads, s.dropped_empty, s.conflicts, s.emitted) == (len(n_bad), 1, 0, len(order)) and s.links == len(n_bad) - s.clusters


def test_second_pass_finds_what_votes_do_not(spark):
    """A line of every frame that is above the posting limit gives no votes; its place in the order still leads to its partner."""
    rows = []
    for c in ("a", "b"):
        for t in range(9):
            for b in range(6):
                rows.append((c, t, b, f"common {b}" if t == 4 else f"frame {t} block {b}"))
    rows += [("z", k, b, f"common {b}") for k in range(4) for b in range(6)]
    blocks = spark.createDataFrame(rows, "cap string, frame long, blk long, data string")
    reads = blocks.where("cap <> 'z'").select("cap", "frame").distinct().selectExpr("0L as window", "cap", "frame", "0L as n_bad", "6L as n_blocks")
    sizes = []
    for refine in (False, True):
        index, stats = tape.build_index(spark, blocks, reads, limit=3, refine=refine, min_blocks=4, min_audio=0)
        sizes.append((index.select("pos").distinct().count(), stats.first().refined))
    assert sizes == [(10, 0), (9, 1)]
