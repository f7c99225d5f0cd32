"""Reading and writing of segments against a plain bit-by-bit version."""

import random
import tracemalloc

import numpy as np
import pytest

from tapeframe.functions import segments as S

CODE = S.Code.sample()


def text(b):
    return "".join(f"{x:08b}" for x in b)


def slow(segment):
    """Words of the 30 blocks, and whether one does not end: strings of bits, block after block."""
    bits, names = text(segment), {f"{c:0{n}b}": i for i, (c, n) in enumerate(zip(CODE.code, CODE.length))}
    found, place = [[] for _ in range(30)], [0] * 30

    def feed(b, stream):
        word = ""
        for k, x in enumerate(stream):
            if place[b] >= 64:
                return stream[k:]
            word += x
            if word in names:
                i = names[word]
                found[b].append(i)
                place[b] += CODE.run[i] + 1
                word = ""
        return word

    rest = {}
    for b in range(30):
        at = (b // 6 * 80 + S.AREA_STARTS[b % 6]) * 8
        rest[b] = feed(b, bits[at + 12 : at + S.AREA_BITS[b % 6]])
    shared = ""
    for u in range(5):
        own = range(6 * u, 6 * u + 6)
        pool, late = "".join(rest[b] for b in own if place[b] >= 64), [b for b in own if place[b] < 64]
        for b in late:
            rest[b] = feed(b, rest[b] + pool)
            if place[b] < 64:
                pool = None
                break
            pool = rest[b]
        shared += pool or ""
    for b in range(30):
        if place[b] < 64:
            shared = feed(b, rest[b] + shared)
            if place[b] < 64:
                return found, True
    return found, False


def draws(n, seed=0):
    r = random.Random(seed)
    rows = [r.randbytes(400) for _ in range(n)]
    # Sparse and dense bits make blocks that end at once and blocks that hardly end.
    rows += [bytes(r.getrandbits(8) & r.getrandbits(8) for _ in range(400)) for _ in range(n)]
    rows += [bytes(r.getrandbits(8) | r.getrandbits(8) for _ in range(400)) for _ in range(n)]
    return rows + [bytes(400), b"\xff" * 400]


def test_parse_against_plain_reading():
    rows = draws(60)
    got = S.parse(rows, CODE)
    whole = 0
    for i, row in enumerate(rows):
        words, damaged = slow(row)
        assert bool(got["damaged"][i]) == damaged
        assert [[w for w in b if w >= 0] for b in got["words"][i].tolist()] == words
        whole += not damaged
        assert got["status"][i].tolist() == [row[80 * u + 3] >> 4 for u in range(5)]
    assert 20 < whole < len(rows)


def test_pack_is_the_inverse():
    rows = draws(300, 1)
    got = S.parse(rows, CODE)
    again, lost = S.pack(got, CODE, rows)
    whole = [i for i in range(len(rows)) if not got["damaged"][i]]
    assert whole and all(again[i] == rows[i] and lost[i] == 0 for i in whole)
    spilled = [i for i in whole if (np.where(got["words"][i] >= 0, np.array(CODE.length)[got["words"][i]], 0).sum(axis=1) + 12 > S._BITS).any()]
    assert len(spilled) > 20


def test_words_that_find_no_space_are_counted():
    rows = [bytes(400)]
    got = S.parse(rows, CODE)
    longest = int(np.argmax(CODE.length))
    got["words"][:] = longest
    got["count"][:] = 64
    _, lost = S.pack(got, CODE, rows)
    assert lost[0] == 5 * sum(64 - (a - 12) // CODE.length[longest] for a in S.AREA_BITS)


def test_levels_and_wrong_sizes():
    rows = draws(20, 2)
    got = S.parse(rows, CODE)
    out = S.levels(got, CODE)
    for i in range(len(rows)):
        for b in range(30):
            want, at = [0] * 64, 0
            for w in got["words"][i, b, : got["count"][i, b]]:
                at += CODE.run[w] + 1
                if at < 64:
                    want[at] = CODE.level[w]
            want[0] = got["value"][i, b]
            assert out[i, b].tolist() == want
    with pytest.raises(ValueError):
        S.parse([b"x"], CODE)
    with pytest.raises(ValueError):
        S.Code((0,), (1,), (127,), (0,))
    assert len(S.parse([], CODE)["damaged"]) == 0


def test_reading_and_writing_take_little_time_and_memory():
    # As many as are read together, most of whose blocks end in their own area; rows of bit places took 104 MB, ranges take 27 MB.
    r = random.Random(7)
    rows = [r.randbytes(400) for _ in range(S.TOGETHER)]
    S.pack(S.parse(rows[:4], CODE), CODE, rows[:4])
    tracemalloc.start()
    got = S.parse(rows, CODE)
    again, _ = S.pack(got, CODE, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(a == b for a, b, d in zip(again, rows, got["damaged"]) if not d)
    assert peak < 50e6
    none = S.parse([], CODE)
    assert S.pack(none, CODE, [])[0] == [] and S.levels(none, CODE).shape == (0, 30, 64)


def test_scan(spark):
    rows = [(i, bytearray(x)) for i, x in enumerate(draws(5))] + [(99, None)]
    got = {r.id: r for r in S.scan(spark.createDataFrame(rows, "id long, raw binary"), "id", "raw", CODE).collect()}
    assert len(got) == len(rows) and got[99].words is None and got[99].same is None
    for i, x in rows[:-1]:
        words, damaged = slow(bytes(x))
        assert got[i].words == sum(map(len, words)) and got[i].damaged == damaged and got[i].same is (None if damaged else True)
        assert got[i].nnz <= got[i].energy
