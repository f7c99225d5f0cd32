import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tapeframe.llm import maxent as M

SCHEMA = "doc_id long, text string"
ROWS = [(i, f"The cat{i % 3} sat on the mat {i % 7} Été\nand the {'dog' if i % 2 else 'cow'}{'g' * (i % 11)} ran") for i in range(60)]
ROWS += [(100, None), (101, ""), (102, " \t"), (None, "the unseen words"), (None, None), (7, "the twice"), (7, "the twice"), (103, "the " * 3000)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def brute(rows):
    c = Counter(w for i, t in rows if not out(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return sorted(((i, out(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)), 6)) for i, t in rows), key=repr)


def check(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as token", "2 as n", "3 as c").repartition(3)
    found = M.score(spark, docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=repr) == brute(rows)
    return found


def test_base_and_model(spark):
    found = check(spark, ROWS)
    held = [r for r in found if r.held_out and r.n_tokens > 1]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score <= 0 for r in found)


@pytest.mark.parametrize("heavy", [1, 40])
def test_join_gives_what_the_table_gives(spark, monkeypatch, heavy):
    monkeypatch.setattr(M, "HEAVY", heavy)
    check(spark, ROWS)


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, None)], [(4, "held out only"), (9, "x")]])
def test_small_tables(spark, rows):
    check(spark, rows)


def test_tables_grow_with_the_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(M, "BITS", 2)
    docs = spark.createDataFrame(ROWS, SCHEMA).selectExpr("text", "0 as turn")
    _, v = M.count_tokens(spark, docs)
    assert 4 ** (v.bits - 1) < 128 * v.distinct <= 4**v.bits and len(M.train(spark, docs, v, rounds=1).first) == 1 << v.bits
    check(spark, ROWS)
    monkeypatch.setattr(M, "MOST_BITS", 3)
    assert M.table_bits(v.distinct) == 3 and M.table_bits(0) == 2


def test_probabilities_of_a_context_sum_to_one(spark):
    rows = [r for r in ROWS if not out(r[0])]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("text", "0 as turn")
    table, v = M.count_tokens(spark, docs)
    w = M.train(spark, docs, v, rounds=1)
    assert np.abs(w.first).max() > 0
    known = sorted({x for _, t in rows for x in words(t) if x})
    total = 0.0
    texts = [f"the {x}" for x in known] + ["the"]
    parts = list(M._partial(pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array([False] * len(texts)), pa.array(texts)], names=["rid", "doc_id", "held_out", "text"]), v, w))
    # Of "the x <end>" only x varies here: take token probabilities one by one.
    token, shape, first = M.tokens(pa.array(texts))
    cls = v.classes(token, shape)
    log = M.class_log10(w, *M.features(token, cls, first, v.bits), cls) + np.where(cls < M.OWN_CLASSES, 0, np.log10(np.maximum(v.counts(token), 0) + 0.5) - v.class_log[cls])
    total = sum(10 ** log[first[i] + 1] for i in range(len(texts)))
    # The rest belongs to unseen words: 0.5 of each shape class.
    classes = np.arange(M.OWN_CLASSES, M.GROUPS * M.MEMBERS)
    token = np.array([token[0], M.U64(99)], M.U64)
    for c in classes:
        k = np.array([cls[0], c])
        total += 10 ** (M.class_log10(w, *M.features(token, k, np.array([0, 2]), v.bits), k)[1] + math.log10(0.5) - v.class_log[c])
    unused = M.OWN_CLASSES - len(v.own)
    empty = 0.0
    for c in range(len(v.own), M.OWN_CLASSES):
        k = np.array([cls[0], c])
        empty += 10 ** M.class_log10(w, *M.features(token, k, np.array([0, 2]), v.bits), k)[1]
    assert parts and unused >= 0
    assert total + empty == pytest.approx(1, abs=1e-4)
