import re

import numpy as np
import pyarrow as pa
import pytest

from tapeframe.llm import bytetext as B
from tapeframe.llm import common

TEXTS = ["The  cat\tsat", "", None, "é1-2 Ab", " lead", "trail ", "x" * 300, "a b " * 90, "日本 語"]


def found(kind):
    data, offsets = B.column(pa.array(TEXTS))
    w = B.find_words(data, offsets, B.word_table(kind))
    raw = data.tobytes()
    return data, w, [[raw[a:b] for a, b in zip(w.start[i:j], w.end[i:j])] for i, j in zip(w.first, w.first[1:])]


def test_words():
    assert found("space")[2] == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in TEXTS]
    assert found("alnum")[2] == [re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode()) for t in TEXTS]


def test_sliced_columns_and_strings():
    array = pa.array(TEXTS).slice(3, 4)
    data, offsets = B.column(array)
    assert [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])] == TEXTS[3:7]
    d, w, words = found("space")
    assert B.strings(d, w.start, w.end).to_pylist() == [x.decode() for row in words for x in row]


@pytest.mark.parametrize("part", [B.PART, 16, 64])
def test_equal_spans_have_equal_hashes_wherever_they_stand(monkeypatch, part):
    data, w, words = found("space")
    whole = B.span_hash(data, w.start, w.end)
    monkeypatch.setattr(B, "PART", part)
    got = B.span_hash(data, w.start, w.end)
    assert (got == whole).all()
    flat = [x for row in words for x in row]
    assert len(set(got.tolist())) == len(set(flat)) and len({(a, b) for a, b in zip(flat, got.tolist())}) == len(set(flat))
    monkeypatch.setattr(B, "PART", B.SLICE_BYTES)
    wide = B.window_hash(whole, 3)
    monkeypatch.setattr(B, "PART", part)
    assert (B.window_hash(whole, 3) == wide).all() and len(wide) == len(whole) - 2
    assert len(set(wide.tolist())) == len({tuple(flat[i : i + 3]) for i in range(len(flat) - 2)})


def test_rows_are_cut_by_bytes():
    offsets = np.array([0, 5, 5, 50, 52, 60])
    assert list(B.row_slices(offsets, 10)) == [(0, 2), (2, 3), (3, 5)]
    assert list(B.row_slices(np.array([0]))) == []


def test_a_process_gives_back_what_a_task_held():
    def step(batches):
        B.powers(B.BYTE_BASE, 1 << 16)
        yield from batches

    other, own = common.HELD.setdefault("other", {1: 2}), common.HELD.setdefault("own", {3: 4})
    try:
        assert list(common.lean(step, "own")(iter([1, 2]))) == [1, 2]
        assert not B._powers and not other and own == {3: 4}
        assert next(common.lean(step)(iter([1, 2]))) == 1 and not own
    finally:
        del common.HELD["other"], common.HELD["own"]
