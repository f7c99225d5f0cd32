import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from tapeframe.llm import progressive as P

#: The order of the standard's figure, row by row of an 8 x 8 block.
FIGURE = """0 1 5 6 14 15 27 28 2 4 7 13 16 26 29 42 3 8 12 17 25 30 41 43 9 11 18 24 31 40 44 53
10 19 23 32 39 45 52 54 20 22 33 38 46 51 55 60 21 34 37 47 50 56 59 61 35 36 48 49 57 58 62 63"""
SCRIPT = [([0, 1, 2], 0, 0, 0, 1), ([0], 1, 5, 0, 2), ([2], 1, 63, 0, 1), ([1], 1, 63, 0, 1), ([0], 6, 63, 0, 2), ([0], 1, 63, 2, 1), ([0, 1, 2], 0, 0, 1, 0), ([2], 1, 63, 1, 0), ([1], 1, 63, 1, 0), ([0], 1, 63, 1, 0)]


def picture(width, height, sampling, seed=0, dense=0.2):
    r = np.random.default_rng(seed)
    top_h, top_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * top_h)), -(-height // (8 * top_v))
    parts = []
    for i, (h, v) in enumerate(sampling):
        blocks = r.integers(-40, 41, (down * v, across * h, 64)).astype(np.int32) * (r.random((down * v, across * h, 64)) < dense)
        blocks[..., 0] = r.integers(-300, 300, blocks.shape[:2])
        shown = (-(-(-(-height * v // top_v)) // 8), -(-(-(-width * h // top_h)) // 8))
        # Blocks outside the picture are coded only in interleaved scans, so they hold only a DC.
        blocks[shown[0] :, :, 1:] = 0
        blocks[:, shown[1] :, 1:] = 0
        parts.append(P.Component(i + 1, h, v, min(i, 1), blocks, shown))
    return P.Picture(width, height, parts, {0: r.integers(1, 30, 64), 1: np.ones(64, np.int64)})


def test_zigzag():
    order = [int(x) for x in FIGURE.split()]
    assert [order[n] for n in P.ZIGZAG] == list(range(64))


@pytest.mark.parametrize(("size", "sampling"), [((37, 21), [(2, 2), (1, 1), (1, 1)]), ((16, 16), [(1, 1)] * 3), ((50, 9), [(2, 1), (1, 1), (1, 1)]), ((9, 40), [(1, 2), (1, 1), (1, 2)])])
@pytest.mark.parametrize("interval", [0, 3])
def test_scans_accumulate(size, sampling, interval):
    want = picture(*size, sampling)
    got = P.Decoder(P.encode(want, SCRIPT, interval)).decode()
    for a, b in zip(want.components, got.components):
        assert (a.blocks == b.blocks).all()
    assert (got.rgb() == want.rgb()).all() and got.rgb().shape == (size[1], size[0], 3)


def test_end_runs_of_many_blocks():
    """One end-of-band code for several blocks, in a first and in a refinement scan."""
    want = picture(64, 8, [(1, 1)])
    c = want.components[0]
    c.blocks[..., 1:] = 0
    c.blocks[0, 0, 3], c.blocks[0, 7, 2] = 2, -3

    def value(x):
        return format(x, "b")

    def code(s):
        return format(P._code(s)[0], f"0{P._code(s)[1]}b")

    first = code(0x21) + "1" + code(0x20) + "11" + code(0x11) + "0" + code(0)  # 2>>1 after two zeros; a run of 7 ends; -3>>1 after one zero
    second = code(0x20) + "11" + "0" + code(0) + "1"
    build = lambda text: P._stuffed(P._packed(np.frombuffer(text.encode(), np.uint8) - 48))
    base = P.encode(want, [([0], 0, 0, 0, 0)])[:-2]
    file = base + P._marker(0xDA, bytes([1, 1, 0, 1, 63, 1])) + build(first) + P._marker(0xDA, bytes([1, 1, 0, 1, 63, 0x10])) + build(second) + b"\xff\xd9"
    got = P.Decoder(file).decode().components[0].blocks
    assert (got == c.blocks).all() and value(2) == "10"


def test_planes_and_colours_against_sums():
    pic = picture(16, 16, [(2, 2), (1, 1), (1, 1)], dense=0.05)
    y = pic.planes()[0]
    block = np.zeros(64)
    block[P.ZIGZAG] = pic.components[0].blocks[1, 0] * pic.quant[0]
    scale = lambda k: math.sqrt((1 if k == 0 else 2) / 8)
    for r in range(8):
        for c in range(8):
            s = sum(block[u * 8 + v] * scale(u) * scale(v) * math.cos((2 * r + 1) * u * math.pi / 16) * math.cos((2 * c + 1) * v * math.pi / 16) for u in range(8) for v in range(8))
            assert abs(float(y[8 + r, c]) - min(max(s + 128, 0), 255)) <= 0.51
    cb, cr = (p[3 // 2, 11 // 2] - 128.0 for p in pic.planes()[1:])
    want = [y[3, 11] + 1.402 * cr, y[3, 11] - 0.344136 * cb - 0.714136 * cr, y[3, 11] + 1.772 * cb]
    assert all(abs(float(a) - min(max(b, 0), 255)) <= 0.51 for a, b in zip(pic.rgb()[3, 11], want))


@pytest.mark.parametrize("n", [0, 1, 64, 65, 64 * 255, 64 * 256, 64 * 257, 64 * 600 + 5])
def test_payload(n, monkeypatch):
    data = P.padded(random.Random(n).randbytes(n) + b"")
    media = P.from_payload(data)
    fast = P.Decoder(media).decode()
    assert P.to_payload(fast) == data
    if n < 64 * 300:
        monkeypatch.setattr(P.Decoder, "_uniform", lambda *a: False)
        slow = P.Decoder(media).decode()
        assert all((a.blocks == b.blocks).all() for a, b in zip(slow.components, fast.components))
        assert (slow.rgb() == fast.rgb()).all() and len(np.unique(fast.planes()[1])) > 1 or not n


@pytest.mark.parametrize("byte", [0, 127, 128, 255])
def test_extreme_payloads(byte):
    data = bytes([byte]) * 640
    assert P.to_payload(P.Decoder(P.from_payload(data)).decode()) == data


TEXTS = [(1, "abc"), (2, "abc"), (2, "abc"), (None, "é" * 100), (3, None), (4, ""), (5, "\x00\xff日本" * 9000), (6, "x" * 64)]


def test_columns(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", "1 as media", "2 as feature")
    table = P.store_media(spark, docs)
    assert table.inputFiles()
    rows = P.read_back(table).collect()
    want = []
    for i, t in TEXTS:
        raw = (t or "").encode()
        p = P.padded(raw)
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    by_payload = {}
    for r in rows:
        assert by_payload.setdefault(r.payload_sha256, tuple(r)[5:]) == tuple(r)[5:]
    stored = {r.doc_id: r.media for r in P.store_texts(docs).collect()}
    assert all(hashlib.sha256(stored[r.doc_id]).hexdigest() == r.media_sha256 and len(stored[r.doc_id]) == r.media_bytes for r in rows)
    assert P.read_back(P.store_texts(docs.limit(0))).count() == 0


def test_tensors(spark):
    good = picture(20, 10, [(2, 2), (1, 1), (1, 1)])
    media = P.encode(good, SCRIPT)
    table = spark.createDataFrame([(1, media), (2, None), (3, b""), (4, media[:60]), (5, b"\xff\xd8\xff\xd9"), (5, b"junk"), (6, media[: len(media) // 2])], "id long, media binary").selectExpr("*", "1 as height")
    rows = {r.id: r for r in P.tensors(table, "id", "media").collect()}
    assert np.array_equal(np.frombuffer(rows[1].rgb, np.uint8).reshape(rows[1].height, rows[1].width, 3), good.rgb())
    assert rows[2].problem == "null" and all(rows[k].rgb is None and rows[k].problem for k in (3, 4, 5))
