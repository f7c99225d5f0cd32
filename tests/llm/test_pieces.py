import functools
import random
import re

import pyarrow as pa
import pytest
import sentencepiece

from tapeframe.llm import pieces as P

with open(P.MODEL_PATH, "rb") as f:
    RAW = f.read()
LIB = sentencepiece.SentencePieceProcessor(model_proto=RAW)
MODEL = P.Model(RAW)


def as_unigram():
    """The same pieces and scores, declared a unigram model."""
    at = RAW.rindex(b"\x12\x06tok_v0\x18\x02") + 9
    return RAW[:at] + b"\x01" + RAW[at + 1 :]


def texts(seed, n):
    r = random.Random(seed)
    alphabet = ["ab", "the", "ing", " ", "  ", "c", "\n", "\t", "日", "本", "€", ".", ",", "e", "é", "𝕏", "\r\n", "12", "é", "\x00", "qz"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(n)]


EDGE = ["", " ", "a", "Hello world", " " * 40 + "x" + " " * 33, "abc" * 300, "日本" * 400, "x" * 1000, "é" * 300 + " end", "tail ", "a\x00b", "  ﬁ"]


def encoded(encoder, rows):
    ids, first = encoder.encode(*P.prepared(pa.array(rows, pa.string()), encoder.m.prefix))
    return [ids[a:b].tolist() for a, b in zip(first, first[1:])]


def test_ids_are_the_librarys():
    rows = texts(1, 1500) + EDGE
    assert encoded(P.Encoder(MODEL), rows) == [LIB.encode(t) for t in rows]


@pytest.mark.parametrize(("long", "chunk"), [(0, 7), (0, 64), (8, 3)])
def test_chunks_give_the_same_ids(monkeypatch, long, chunk):
    monkeypatch.setattr(P, "LONG", long)
    monkeypatch.setattr(P, "LONG_CHUNK", chunk)
    monkeypatch.setattr(P.Model, "merged", lambda *a: pytest.fail("not through the lattice"))
    rows = texts(2, 150) + EDGE[:8]
    assert encoded(P.Encoder(MODEL), rows) == [LIB.encode(t) for t in rows]


def test_unigram_paths_are_the_best(monkeypatch):
    """Against the best weight of all segmentations, by plain recursion."""
    monkeypatch.setattr(P, "LONG_CHUNK", 9)
    own = P.Encoder(P.Model(as_unigram()))
    assert not own.m.bpe

    @functools.cache
    def best(text):
        if not text:
            return 0.0
        arcs = [(own.m.scores[own.m.ids[text[:k]]], k) for k in range(1, len(text) + 1) if text[:k] in own.m.ids]
        return max(w + best(text[k:]) for w, k in arcs)

    for t in ["the quick brown fox", "unbelievably internationalization", "Straße und Häuser"]:
        got = encoded(own, [t])[0]
        assert LIB.decode(got) == t
        assert sum(own.weight(own.m.size, i) for i in got) == pytest.approx(sum(best(u.encode()) for u in re.findall(" [^ ]+", " " + t)))


def test_scan_is_associative():
    own = P.Encoder(MODEL)
    text = b" internationalizationinternationalization" * 3
    cuts = [0, 11, 23, 40, 41, 77, len(text)]
    m = [own.transfer(text, a, b) for a, b in zip(cuts, cuts[1:])]
    left = m[0]
    for k, x in enumerate(m[1:], 1):
        left = P.combine(left, x)
        assert P.prefixes(m)[k] == left
    assert P.combine(m[1], P.combine(m[2], m[3])) == P.combine(P.combine(m[1], m[2]), m[3])
    states = P.boundary_states(m)
    ids = [i for k in range(len(m)) for i in own.trace(text, cuts[k], cuts[k + 1], states[k], states[k + 1])]
    assert ids == LIB.encode(text[1:].decode())


ROWS = [(i, t) for i, t in enumerate([*texts(3, 120), *EDGE, "a▁b"])] + [(None, "null id"), (5, "same"), (5, "same"), (900, None)]
SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("giant", [P.GIANT, 30])
def test_documents_and_back(spark, monkeypatch, giant):
    monkeypatch.setattr(P, "GIANT", giant)
    monkeypatch.setattr(P, "CHUNK", 16)
    rows = ROWS if giant > 30 else [r for r in ROWS if r[1] is None or len(r[1]) < 200]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rid", "2 as k", "'x' as view").repartition(3)
    out = P.decode(spark, P.encode(spark, docs, MODEL), MODEL).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted(rows, key=repr)
    for r in out:
        assert (r.rid, r.k, r.view) == (1, 2, "x")
        if r.text is None:
            assert r.ids is None and r.decoded is None
        else:
            assert r.ids == LIB.encode(r.text) and r.decoded == LIB.decode(r.ids) == r.text.replace("▁", " ")


def test_digest(spark):
    out = P.digest(spark, spark.createDataFrame(ROWS, SCHEMA).repartition(2), MODEL).collect()
    assert len(out) == len(ROWS) and all(r.round_trip for r in out)
    n = sorted(((i, len(LIB.encode(t)) if t is not None else 0) for i, t in ROWS), key=repr)
    assert sorted(((r.doc_id, r.n_ids) for r in out), key=repr) == n
    assert P.digest(spark, spark.createDataFrame([], SCHEMA), MODEL).count() == 0


def test_broken_bytes_are_replaced(spark):
    ids = [MODEL.byte_ids[0xC3], MODEL.byte_ids[0x28], LIB.encode("ab")[-1]]
    rows = spark.createDataFrame([([int(i) for i in ids],), ([],), (None,)], "ids array<int>")
    assert [r.decoded for r in P.decode(spark, rows, MODEL).collect()] == [LIB.decode([int(i) for i in ids]), "", None]


def test_models_that_change_text_are_refused():
    with pytest.raises(ValueError):
        P.Model(RAW[: RAW.rindex(b"identity")] + b"nmt_nfkc" + RAW[RAW.rindex(b"identity") + 8 :])
