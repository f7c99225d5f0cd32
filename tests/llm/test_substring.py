import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tapeframe.llm import substring as S

SCHEMA = "doc_id long, text string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, size=50):
    key = lambda i: (i is None, i)
    first = {}
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - size + 1):
            x = tuple(w[a : a + size])
            first[x] = min(first.get(x, key(i)), key(i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for a in range(len(w) - size + 1):
            if first[tuple(w[a : a + size])] < key(i):
                gone.update(range(a, a + size))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "日本", "x y"]
    passages = [[r.choice(vocabulary) for _ in range(k)] for k in (49, 50, 51, 80, 130)]
    rows = []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(passages)
        rows.append((i, r.choice([" ", "\n", "\t "]).join(w)))
    near = rows[7][1].split()
    for i in range(n, n + 8):
        x = list(near)
        if x:
            x[r.randrange(len(x))] = "changed"
        rows.append((i, " ".join(x)))
    rows += [(n + 20, rows[3][1]), (n + 21, rows[3][1]), (5, rows[9][1]), (None, rows[4][1]), (None, rows[4][1]), (n + 30, None), (n + 31, ""), (n + 32, "the " * 400), (n + 33, "the " * 300), (n + 34, "a b " * 60), (n + 35, "a b " * 70), rows[2]]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_against_brute_force(spark, batches):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as fp", "'y' as k", "2 as doc").repartition(3)
    got = sorted(map(tuple, S.dedup(spark, docs, batches=batches).collect()), key=repr)
    assert got == brute(rows)


def test_kept_words_and_spans(spark):
    p = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(1, p), (2, f"a {p} b")], SCHEMA)
    got = {r.doc_id: r for r in S.dedup(spark, docs, digest=False).collect()}
    assert got[1].kept == p and got[1].n_removed == 0
    assert got[2].kept == "a b" and got[2].removed_starts == [1] and got[2].removed_ends == [61]


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, None)]])
def test_empty(spark, rows):
    got = sorted(map(tuple, S.dedup(spark, spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == brute(rows)


def test_runs_are_merged_by_levels(spark):
    rows = corpus(2, 30)
    index, got, levels = S.FingerprintIndex(spark, 3), [], []
    cuts = [0, 6, 12, 18, 24, 40, 1 << 62]
    key = lambda i: (1 << 61) if i is None else i
    for a, b in zip(cuts, cuts[1:]):
        batch = spark.createDataFrame([x for x in rows if a <= key(x[0]) < b], SCHEMA)
        got += map(tuple, S.without_repeats(batch, index.repeats(batch), digest=True).collect())
        levels.append(sorted(level for level, _ in index.runs))
    assert levels == [[0], [1], [0, 1], [2], [0, 2], [1, 2]]
    assert sorted(got, key=repr) == brute(rows)
    runs = [run.read() for _, run in index.runs]
    plan = runs[0].hint("merge").join(runs[1].select("fp"), "fp", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort " not in plan


def test_long_texts_go_part_by_part(spark, monkeypatch):
    """The functions of the workers on rows in parts give what they give on whole rows."""
    rows = corpus(4, 25)
    table = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "doc": [i or 0 for i, _ in rows], "k": list(range(len(rows))), "text": [t for _, t in rows], "begins": [[3, 60, 70] for _ in rows], "ends": [[55, 110, 140] for _ in rows]})
    size = [len(words(t)) for _, t in rows]
    spans = [[(a, min(b, n)) for a, b in ((3, 55), (60, 110), (70, 140)) if a < n] for n in size]
    table = table.set_column(4, "begins", pa.array([[a for a, _ in s] for s in spans], pa.list_(pa.int32()))).set_column(5, "ends", pa.array([[b for _, b in s] for s in spans], pa.list_(pa.int32())))
    flat = lambda f: [r for b in f(iter([table])) for r in b.to_pylist()]

    def windows():
        out = set()
        for r in flat(S._regions):
            for j, w in enumerate(np.frombuffer(r["wh"], np.int32).tolist()):
                out.add((r["doc"], r["k"], r["fp"], r["start"] + j, w))
        return out

    whole = flat(S._kept), flat(S._digest), windows()
    pieces = S.B.pieces
    monkeypatch.setattr(S.B, "LONG", 0)
    monkeypatch.setattr(S.B, "SLICE_BYTES", 1)
    monkeypatch.setattr(S.B, "row_slices", lambda offsets, limit=1: ((i, i + 1) for i in range(len(offsets) - 1)))
    monkeypatch.setattr(S.B, "pieces", lambda d, t, limit=60, overlap=0: pieces(d, t, 60, overlap))
    assert (flat(S._kept), flat(S._digest), windows()) == whole


def test_many_equal_rows_give_one_span(spark):
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(1, p), *[(2, p)] * 50, *[(3, p + " end")] * 50]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = S.FingerprintIndex(spark).repeats(docs).collect()
    assert len(found) == 2 and all(len(r.begins) <= 60 for r in found)
    assert sorted(map(tuple, S.dedup(spark, docs).collect())) == brute(rows)


@pytest.mark.parametrize("batches", [1, 2])
def test_passage_repeated_inside_the_smallest_document(spark, batches):
    """Regions whose words differ between documents, at several places and in several rows of their smallest one."""
    rows = []
    for c in range(6):
        core = [f"c{c}.{i}" for i in range(60)]
        alone = lambda name, n=30: [f"{name}{c}.{i}" for i in range(n)]  # noqa: B023, E731
        again = alone("x") + core + alone("y")
        rows.append((10 * c, " ".join(alone("b") + core + alone("d"))))
        rows.append((10 * c + 5, " ".join(again + alone("z") + again)))
        rows.append((10 * c + 5, " ".join(alone("q") + again + again)))
        rows.append((10 * c + 7, " ".join(again)))
    rows += [(None, rows[1][1]), (None, rows[2][1]), rows[1], (99, "la " * 300), (98, "la " * 60 + "le " + "la " * 200)]
    got = sorted(map(tuple, S.dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), batches=batches).collect()), key=repr)
    assert got == brute(rows)


def test_slices_and_windows_come_in_small_portions():
    r = random.Random(4)
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(5_000)]
    texts = [" ".join(r.choices(words, k=20_000)) for _ in range(20)]
    batch = pa.record_batch([pa.array(range(20)), pa.array(range(20)), pa.array(texts)], names=["doc", "k", "text"])
    S.B._powers.clear()
    regions = list(S._regions(iter([batch])))
    assert len(regions) > 8 and sum(a.nbytes + b.nbytes for a, b in S.B._powers.values()) < 20e6
    whole = pa.Table.from_batches(regions).combine_chunks().to_batches()[0]
    rows = list(S._windows({"fp": pa.int64(), "doc": pa.int64()})(iter([whole])))
    assert max(x.nbytes for x in rows) < 5e6 and sum(x.num_rows for x in rows) == 20 * (20_000 - 49)
