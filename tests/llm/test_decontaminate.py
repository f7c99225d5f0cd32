import hashlib
import random
import re
from collections import Counter

import pytest

from tapeframe.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def stretches(w, q, span):
    """All smallest (first, end) of at most ``span`` words that hold the words of ``q`` as often as it does."""
    need = Counter(q)
    if not set(need) <= set(w):
        return []
    out = []
    for a in range(len(w)):
        if w[a] not in need:
            continue
        have = Counter()
        for b in range(a, min(a + span, len(w))):
            have[w[b]] += 1
            if all(have[x] >= k for x, k in need.items()):
                out.append((a, b + 1))
                break
    return [x for x in out if not any(y != x and y[0] >= x[0] and y[1] <= x[1] for y in out)]


def brute(docs, items):
    queries = []
    for item, text in items:
        w = words(text)
        m = min(10, len(w))
        queries += [(tuple(w[i : i + m]), str(item)) for i in range(len(w) - m + 1) if m]
    out = []
    for doc_id, text in docs:
        w, hit, found, close = words(text), set(), set(), set()
        for q, item in queries:
            for i in range(len(w) - len(q) + 1):
                if tuple(w[i : i + len(q)]) == q:
                    hit.update(range(i, i + len(q)))
                    found.add(item)
            if item not in close and stretches(w, q, len(q) + D.SLACK):
                close.add(item)
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), len(close)))
    return sorted(out, key=repr)


PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
DOCS = [
    (1, f"Start {PASSAGE.upper()} end"), (2, PASSAGE[:-7]), (3, None), (4, ""), (5, "short item"), (5, "short item"),
    (None, f"x {PASSAGE}"), (7, "one two three"), (8, "één é short-item, short item short item"), (9, "filler " * 5000 + PASSAGE + " " + PASSAGE),
    (10, "one two three four five six seven eight nine"), (11, "ten eleven twelve"), (12, "short"), (13, "item"),
]
ITEMS = [(1, PASSAGE), (2, "short item"), (3, ""), (4, None), (5, "É"), (10, PASSAGE), (11, "absent words here")]


def run(spark, docs, items, **conf):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as kind", "1 as n_hit", "2 as terms")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "0 as doc_id")
    index = D.build_index(spark, d.coalesce(1))
    return index, D.phrase_matches(spark, index, b, slack=D.SLACK)


def test_against_brute_force(spark):
    _, out = run(spark, DOCS, ITEMS)
    assert sorted(map(tuple, D.digest(out, near=True).collect()), key=repr) == brute(DOCS, ITEMS)


def test_several_turns_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(D, "QUERY_BYTES", 20)
    _, out = run(spark, DOCS, ITEMS)
    assert sorted(map(tuple, D.digest(out, near=True).collect()), key=repr) == brute(DOCS, ITEMS)


def test_several_segments(spark, monkeypatch):
    monkeypatch.setattr(D, "SEGMENT_BYTES", 50)
    index, out = run(spark, DOCS, ITEMS)
    assert sorted(map(tuple, D.digest(out, near=True).collect()), key=repr) == brute(DOCS, ITEMS)


@pytest.mark.parametrize(("docs", "items"), [([], ITEMS), (DOCS, []), ([], [])])
def test_empty_tables(spark, docs, items):
    _, out = run(spark, docs, items)
    assert sorted(map(tuple, D.digest(out, near=True).collect()), key=repr) == brute(docs, items)


def test_spans_stay_inside_documents(spark):
    docs = [(1, "short item"), (2, "short item short item")]
    _, out = run(spark, docs, ITEMS)
    assert {r.doc_id: (r.hit_starts, r.hit_ends, r.items) for r in out.collect()} == {1: ([0], [2], ["2"]), 2: ([0], [4], ["2"])}


def test_rows_of_one_id_keep_their_own_hits_in_several_turns(spark, monkeypatch):
    docs = [(5, "short item"), (5, "two words"), (None, "short item"), (None, "two words"), (5, "short item")]
    monkeypatch.setattr(D, "QUERY_BYTES", 5)
    _, out = run(spark, docs, ITEMS)
    assert sorted(map(tuple, D.digest(out, near=True).collect()), key=repr) == brute(docs, ITEMS)


def random_docs(seed, n=60):
    r = random.Random(seed)
    return [(i, " ".join(r.choice("a b c d e the of".split() + ["z"] * (i % 9 == 0)) for _ in range(r.randrange(60)))) for i in range(n)]


@pytest.mark.parametrize("bytes_", [4 << 20, 150, 40])
def test_proximity_is_the_same_whatever_the_segments(spark, monkeypatch, bytes_):
    monkeypatch.setattr(D, "SEGMENT_BYTES", bytes_)
    docs = random_docs(1) + [(100, "a b c d e f g"), (101, "a x x x x x x x x x g"), (102, "g a"), (103, "a"), (104, "the"), (105, "the x the"), (None, None)]
    queries = {"two": "a g", "none": "a zz", "twice": "the the", "many": "a b c z", "again": "a b a z", "rare": "z z e"}
    index = D.build_index(spark, spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    got = sorted(map(tuple, D.proximity_matches(spark, index, queries, span=8).collect()))
    assert got == sorted((i, name, a, b) for i, t in docs for name, q in queries.items() for a, b in stretches(words(t), words(q), 8))
    assert any(x[0] == 102 for x in got) and not any(x[0] in (101, 104) for x in got)


@pytest.mark.parametrize(("bytes_", "turn"), [(4 << 20, 1 << 20), (120, 1 << 20), (60, 30)])
def test_random_documents_in_parts_and_turns(spark, monkeypatch, bytes_, turn):
    """Documents longer than a segment go in parts; windows, spans and near items are those of the whole."""
    monkeypatch.setattr(D, "SEGMENT_BYTES", bytes_)
    monkeypatch.setattr(D, "QUERY_BYTES", turn)
    docs = random_docs(3, 40) + [(200, " ".join(t for _, t in random_docs(8)[:6]) + " " + PASSAGE)]
    items = [(1, "a b c"), (2, "the of the"), (3, "z a"), (4, docs[9][1]), (5, docs[5][1]), (6, "e d c b a")]
    _, out = run(spark, docs, items)
    assert sorted(map(tuple, D.digest(out, near=True).collect()), key=repr) == brute(docs, items)
    for r in out.collect():
        assert sum(b - a for a, b in zip(r.hit_starts, r.hit_ends)) == r.n_hit and all(b < c for b, c in zip(r.hit_ends, r.hit_starts[1:]))


def test_clean_keeps_any_columns(spark):
    docs = spark.createDataFrame([(1, "short item"), (2, "fine"), (2, "fine"), (None, None)], "doc_id long, text string").selectExpr("*", "1 as key", "2 as `row`", "3 as __key", "map(1, 2) as m")
    got = D.clean(spark, docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert got.schema == docs.schema and sorted((r.doc_id for r in got.collect()), key=repr) == [2, 2, None]


def test_tables(spark):
    from tapeframe.llm.common import read
    from tests.conftest import SF

    d, b = read(spark, SF, "documents"), read(spark, SF, "benchmark")
    docs = [(r.doc_id, r.text) for r in d.collect()]
    from tapeframe.llm.queries import QUERIES

    got = sorted(map(tuple, QUERIES["op2_decontaminate"](spark, SF).collect()), key=repr)
    assert got == sorted((x[:6] for x in brute(docs, [(r.item_id, r.text) for r in b.collect()])), key=repr)
