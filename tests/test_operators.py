"""Known cases of the DataFrame operators."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeframe.functions import bits, blocks
from tapeframe.operators import fuse, grid, link, quality, timeline

T = "cap long, f long, value double, bad boolean"


def frames(spark, values, bad=()):
    return spark.createDataFrame([(0, i, float(v), i in bad) for i, v in enumerate(values)], T)


@pytest.mark.parametrize(("values", "want"), [([10, 20, 30], []), ([10, 90, 11], [1])])
def test_misplaced(spark, values, want):
    assert [r.f for r in timeline.misplaced(frames(spark, values)).collect()] == want


@pytest.mark.parametrize(("shift", "want"), [((0, -3), (0, -3)), ((2, 0), (2, 0)), ((0, 0), (0, 0))])
def test_best_shift(spark, shift, want):
    a = np.random.default_rng(4).integers(0, 200, (36, 45)).astype(float)
    b = np.roll(a, shift, (0, 1))
    rows = [(k, r, c, float(x[r, c]), True) for k, x in enumerate((a, b)) for r in range(36) for c in range(45)]
    got = {r.frame: (r.dr, r.dcol) for r in grid.best_shift(spark.createDataFrame(rows, "frame long, r long, c long, dc double, ok boolean")).collect()}
    assert got[0] == want


def test_trust(spark):
    cost = [0.002] * 120
    cost[30] = 0.45
    cost[60:100] = [0.40] * 40
    got = {r.f: r.trust for r in timeline.neighbour_trust(frames(spark, cost)).collect()}
    assert got[30] < 0.05 and got[80] > 0.2
    assert got[50] == pytest.approx(np.percentile(cost[46:50] + cost[51:55], 25))


def test_seam(spark):
    rng = np.random.default_rng(5)
    r, c = np.mgrid[0:36, 0:45]
    img = 60 + 0.12 * c + 0.05 * r + rng.normal(0, 0.3, (36, 45))
    img[12:16, 20:24] += 45
    rows = [(0, int(a), int(b), float(img[a, b]), True) for a in range(36) for b in range(45)]
    got = {(x.br, x.bc): x.seam for x in grid.seam(spark.createDataFrame(rows, "frame long, r long, c long, dc double, ok boolean")).collect()}
    clean = [v for k, v in got.items() if abs(k[0] - 3) > 1 or abs(k[1] - 5) > 1]
    assert max(clean) < 4 and got[3, 5] > 3 * max(clean)


def test_runs_and_run_splits(spark):
    levels = [0] * 64
    levels[40] = 7
    row = spark.createDataFrame([(levels, [0] * 64)], "a array<int>, b array<int>").select(bits.run_levels("a").alias("r"), bits.run_levels("b").alias("z"), bits.last_nonzero("b").alias("last"))
    row = row.select("*", bits.expand_runs("r").alias("back"), bits.expand_runs("z").alias("zero")).first()
    assert [(x.run, x.level) for x in row.r] == [(40, 7)] and row.back == levels and row.zero == [0] * 64 and row.last == -1


def test_transform_against_the_definition(spark):
    px = np.random.default_rng(1).normal(128, 40, 64)
    c = spark.createDataFrame([(px.tolist(),), (None,)], "px array<double>").select(blocks.forward("px").alias("c")).withColumn("back", blocks.inverse("c")).collect()
    assert c[1].c is None and np.allclose(c[0].back, px)
    u, v = 3, 2
    s = lambda k: np.sqrt((1 if k == 0 else 2) / 8)
    want = sum(px[y * 8 + x] * s(u) * s(v) * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * v * np.pi / 16) for y in range(8) for x in range(8))
    assert c[0].c[u * 8 + v] == pytest.approx(want)


def test_profiles():
    assert bits.frame_bytes("pal") == 144000 and bits.frame_bytes("ntsc") == 120000
    assert bits.profile_of(144000 * 3) == "pal" and bits.profile_of(120000) == "ntsc" and bits.profile_of(720000) == "pal"


def test_block_classes(spark):
    got = {(p, r.kind): r["count"] for p in ("pal", "ntsc") for r in bits.blocks_of_profile(spark, p).groupBy("kind").count().collect()}
    assert got["pal", "video"] == 1620 and got["pal", "audio"] == 108 and got["ntsc", "video"] == 1350 and got["ntsc", "audio"] == 90
    assert bits.blocks_of_profile(spark).where("kind = 'video'").agg(F.countDistinct("segment")).first()[0] == 324


def test_factor_table(spark):
    rows = bits.factor_table(spark, [[4, 6]], [0, 1], [[0, 1], [2, 3]], [0, -1, 1, 0])
    got = {(r.qno, r.cls, r.k): r.factor for r in rows.collect()}
    assert got[0, 0, 0] == 4 << 1 and got[0, 0, 1] == 6 << 2 and got[0, 1, 0] == 4 << 1 and got[0, 2, 1] == 6 << 4 and got[15, 3, 0] == 4 << 4


def test_states(spark):
    reads = spark.createDataFrame([(1, 0, 0, True, False, 1.0), (1, 1, 0, False, True, 1.0), (1, 5, 0, False, True, 1.0), (1, 6, 0, False, False, 1.0)], "frame long, slot long, read long, bad boolean, false_ok boolean, value double")
    assert {r.slot: r.state for r in quality.block_state(reads).collect()} == {0: quality.BAD, 1: quality.SUSPECT, 5: quality.FALSE_OK, 6: quality.OK}


def test_single_read_is_kept_as_it_is(spark):
    reads = spark.createDataFrame([(1, 0, 0, False, False, 7.0), (1, 1, 0, True, False, 8.0), (2, 0, 0, True, False, 1.0), (2, 0, 1, False, False, 2.0)], "frame long, slot long, read long, bad boolean, false_ok boolean, value double")
    got = {(r.frame, r.slot): (r.how, r.value) for r in fuse.merge_frames(reads).collect()}
    assert got == {(1, 0): ("kept", 7.0), (1, 1): ("unresolved", 8.0), (2, 0): ("kept", 2.0)}


def test_audio_counts_only_after_the_ratio_holds(spark):
    rows = [("a", 1, i, f"x{i}") for i in range(4)] + [("b", 2, i, f"x{i}" if i < 1 else "other") for i in range(4)] + [("c", 3, i, f"x{i}") for i in range(4)]
    b = spark.createDataFrame(rows, "cap string, frame long, blk long, data string")
    pairs = spark.createDataFrame([("a", 1, "b", 2), ("a", 1, "c", 3)], "cap string, frame long, cap2 string, frame2 long")
    got = {r.frame2: (r.n, r.same, r.aud, r.ok) for r in link.verify(pairs, b, min_blocks=3, min_audio=0).collect()}
    assert got == {2: (4, 1, 0, False), 3: (4, 4, 1, True)}


def test_hot_keys_do_not_vote(spark):
    rows = [("a", 1, 0, "hot"), ("b", 2, 0, "hot"), ("c", 3, 0, "hot"), ("a", 1, 1, "rare"), ("b", 2, 1, "rare")]
    b = spark.createDataFrame(rows, "cap string, frame long, blk long, data string")
    assert sorted((r.frame, r.frame2, r.votes) for r in link.votes(b, limit=2).collect()) == [(1, 2, 1), (2, 1, 1)]


def test_all_frames_bad(spark):
    t = frames(spark, [1, 2, 3], bad=(0, 1, 2))
    assert {r.value for r in timeline.freeze_last(t).collect()} == {None}
    assert {r.source for r in fuse.nearest_source(t).collect()} == {None}
    assert {r.how for r in fuse.conceal(t).collect()} == {"none"}
    assert timeline.largest_run(t).count() == 0


def test_similarity_top_makes_no_pairs_of_frequent_blocks(spark):
    r = random.Random(11)
    rows = [("A", f, b, f"line {int(r.paretovariate(0.7)) % 40}") for f in range(150) for b in range(r.randint(1, 4))]
    rows += [("A", 200 + f, *x[2:]) for f in range(8) for x in rows if x[1] == 3] + [x for x in rows if x[1] in (4, 5)]
    own = {f: Counter(x[2:] for x in rows if x[1] == f) for f in {x[1] for x in rows}}
    want = set()
    for a, keys in own.items():
        found = [(b, sum(n * other[x] for x, n in keys.items()), min(keys.total(), other.total())) for b, other in own.items() if b != a]
        found = sorted(((-same / size, -same, b) for b, same, size in found if same))[:5]
        want |= {(a, b, -same, round(-x, 9), i + 1) for i, (x, same, b) in enumerate(found)}
    blocks = spark.createDataFrame(rows, "cap string, frame long, blk int, data string")
    for limit in (1, 3, 1000):
        got = link.similarity_top(blocks, k=5, limit=limit)
        assert {(x.frame, x.frame2, x.same, round(x.similarity, 9), x.rank) for x in got.collect()} == want
