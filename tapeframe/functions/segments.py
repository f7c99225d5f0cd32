"""Segments of five units: variable-length words that spill from a block's own area into shared space.

A segment is 400 bytes, five units of 80.  A unit is three bytes of identity, one of status and quantizer, and six
areas, one for each block.  A block is twelve bits of head (a signed value, a mode, a class) and words of a prefix code;
it has ended when its position has passed 63.  What does not fit a block's area goes on in the space that the ended blocks
of its unit leave, and then in the space that the units leave.

The code is a parameter: ``Code`` takes any complete prefix code.  All segments of a batch are read together: a lane is a
row of bit ranges still to be read, and all lanes take one word at a time.  Writing needs no steps: a block's bits go to
runs of places, which follow from running sums of the blocks' lengths.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: bytes of a unit, first byte of each area in it, bits of each area, bits of a block's head.
UNIT_BYTES, UNITS, BLOCKS = 80, 5, 6
AREA_STARTS = [4, 18, 32, 46, 60, 70]
AREA_BITS = [112, 112, 112, 112, 80, 80]
HEAD_BITS, LAST = 12, 64

SEGMENT_BYTES, LANES = UNIT_BYTES * UNITS, UNITS * BLOCKS
_BITS = np.tile(AREA_BITS, UNITS)
_STARTS = (np.arange(UNITS)[:, None] * UNIT_BYTES * 8 + np.array(AREA_STARTS) * 8).ravel()
_UNIT = np.repeat(np.arange(UNITS), BLOCKS)


@dataclass(frozen=True)
class Code:
    """A complete prefix code: word i is the low ``length[i]`` bits of ``code[i]`` and stands for ``run[i]`` zeros and a level."""

    code: tuple[int, ...]
    length: tuple[int, ...]
    run: tuple[int, ...]
    level: tuple[int, ...]

    def __post_init__(self) -> None:
        if sum(2.0**-n for n in self.length) != 1:
            raise ValueError("not a complete prefix code")

    @cached_property
    def longest(self) -> int:
        return max(self.length)

    @cached_property
    def words(self) -> np.ndarray:
        """The word that the next ``longest`` bits start with."""
        out = np.zeros(1 << self.longest, np.int32)
        for i, (code, n) in enumerate(zip(self.code, self.length)):
            out[code << (self.longest - n) : (code + 1) << (self.longest - n)] = i
        return out

    @cached_property
    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.array(x, np.int64) for x in (self.code, self.length, self.run, self.level))

    @classmethod
    def of_weights(cls, pairs: list[tuple[int, int]], weights: list[float]) -> Code:
        """The shortest code for (run, level) pairs of these weights."""
        heap = [(w, i, [i]) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        depth = [0] * len(pairs)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in a[2] + b[2]:
                depth[i] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        order, codes, at, n = sorted(range(len(pairs)), key=lambda i: (depth[i], i)), [0] * len(pairs), 0, 0
        for i in order:
            at <<= depth[i] - n
            n, codes[i], at = depth[i], at, at + 1
        return cls(tuple(codes), tuple(depth), tuple(r for r, _ in pairs), tuple(x for _, x in pairs))

    @classmethod
    def sample(cls) -> Code:
        """A code for tests and examples: an end, skips, and levels up to eight after up to seven zeros."""
        pairs = [(127, 0), *((r, 0) for r in range(8)), *((r, s * x) for r in range(8) for x in range(1, 9) for s in (1, -1))]
        return cls.of_weights(pairs, [0.15, *(0.002 for _ in range(8)), *(0.25 * 2.0 ** -(r * 0.8 + x) for r in range(8) for x in range(1, 9) for _ in (1, -1))])


class Lanes:
    """Blocks being read: their words, positions and whether they have ended."""

    def __init__(self, n: int, code: Code) -> None:
        self.code, self.position, self.ended, self.count = code, np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, np.int64)
        self.words = np.full((n, LAST), -1, np.int32)

    def read(self, data: np.ndarray, which: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Read blocks ``which`` (not ended) from ``size`` bits of ``data`` from bit ``begin`` on until they end or a word is cut off; the number of bits used."""
        _, length, run, _ = self.code.arrays
        longest = self.code.longest
        wide, kind = (4, np.uint32) if longest <= 25 else (8, np.uint64)
        padded = np.concatenate([data, np.zeros(wide, np.uint8)])
        window = np.zeros(len(data) + 1, kind)  # the next ``wide`` bytes of every byte
        for k in range(wide):
            window = window << kind(8) | padded[k : k + len(window)]
        shift, mask, words = kind(8 * wide - longest), kind((1 << longest) - 1), self.words.ravel()
        used = np.zeros(len(which), np.int64)
        row, block, at, end = np.arange(len(which)), which, begin, begin + size
        count, position = self.count[which], self.position[which]
        while len(row):
            word = self.code.words[(window[at >> 3] >> (shift - (at & 7).astype(kind))) & mask]
            after = at + length[word]
            whole = after <= end
            if not whole.all():
                cut = ~whole
                used[row[cut]], self.count[block[cut]], self.position[block[cut]] = at[cut] - begin[row[cut]], count[cut], position[cut]
                row, block, after, end, count, position, word = (x[whole] for x in (row, block, after, end, count, position, word))
            words[block * LAST + count] = word
            count, position, at = count + 1, position + run[word] + 1, after
            going = position < LAST
            if not going.all():
                out = ~going
                used[row[out]], self.count[block[out]], self.position[block[out]] = at[out] - begin[row[out]], count[out], position[out]
                self.ended[block[out]] = True
                row, block, at, end, count, position = (x[going] for x in (row, block, at, end, count, position))
        return used


def _cut(start: np.ndarray, size: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ranges without their first ``used`` bits."""
    gone = np.clip(used[:, None] - (np.cumsum(size, axis=1) - size), 0, size)
    return start + gone, size - gone


def _dense(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same ranges without columns that no row needs."""
    order = np.argsort(size == 0, axis=1, kind="stable")[:, : max(int((size > 0).sum(axis=1).max(initial=0)), 1)]
    return np.take_along_axis(start, order, axis=1), np.take_along_axis(size, order, axis=1)


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Every place of the ranges."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _read_ranges(lanes: Lanes, bits: np.ndarray, which: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Read blocks from rows of ranges of ``bits``; the ranges left."""
    total = size.sum(axis=1)
    data = np.packbits(bits[_places(start.ravel(), size.ravel())])
    return _cut(start, size, lanes.read(data, which, np.cumsum(total) - total, total))


def parse(segments: list[bytes], code: Code) -> dict[str, np.ndarray]:
    """value, mode, cls, count, ended (segments x 30), words (segments x 30 x 64, -1 beyond count), status and quantizer (segments x 5), damaged."""
    if any(len(s) != SEGMENT_BYTES for s in segments):
        raise ValueError(f"a segment has {SEGMENT_BYTES} bytes")
    n = len(segments)
    raw = np.frombuffer(b"".join(segments), np.uint8).reshape(n, SEGMENT_BYTES)
    bits = np.unpackbits(raw.ravel())
    first = _STARTS // 8
    head = raw[:, first].astype(np.int64) << 4 | raw[:, first + 1] >> 4
    value = head >> 3
    lanes = Lanes(n * LANES, code)

    # Own areas: every block at once.
    start = (np.arange(n)[:, None] * SEGMENT_BYTES * 8 + _STARTS).ravel() + HEAD_BITS
    size = np.tile(_BITS - HEAD_BITS, n)
    used = lanes.read(raw.ravel(), np.arange(n * LANES), start, size)
    start, size = start + used, size - used

    # Space of the unit: one lane a unit that needs it, its blocks one after the other.  Space is a row of ranges.
    ended = lanes.ended.copy()
    rows = lambda x: x.reshape(n * UNITS, BLOCKS)
    needy = np.flatnonzero(~rows(ended).all(axis=1))
    own_start, own_size = rows(start)[needy], rows(size)[needy]
    free_start, free_size = own_start, np.where(rows(ended)[needy], own_size, 0)
    #: What the block that did not end has left to read: all that was left of its unit.
    stuck, stuck_start, stuck_size = np.full(len(needy), -1), np.zeros((len(needy), 2 * BLOCKS), np.int64), np.zeros((len(needy), 2 * BLOCKS), np.int64)
    for j in range(BLOCKS):
        turn = np.flatnonzero((stuck < 0) & ~lanes.ended[needy * BLOCKS + j])
        mine = np.zeros(len(needy), np.int64)
        mine[turn] = own_size[turn, j]
        free_start, free_size = np.column_stack([own_start[:, j], free_start]), np.column_stack([mine, free_size])
        if len(turn):
            block = needy[turn] * BLOCKS + j
            left_start, left_size = _read_ranges(lanes, bits, block, free_start[turn], free_size[turn])
            done = lanes.ended[block]
            # The block that does not end keeps all that is left, and the unit has no space for later ones.
            free_start[turn], free_size[turn] = left_start, np.where(done[:, None], left_size, 0)
            cut = turn[~done]
            stuck[cut], stuck_start[cut, : left_start.shape[1]], stuck_size[cut, : left_size.shape[1]] = j, left_start[~done], left_size[~done]

    # Space of the segments that need it.
    damaged = np.zeros(n, bool)
    segment = np.flatnonzero(~lanes.ended.reshape(n, LANES).all(axis=1))
    if len(segment):
        width = 2 * BLOCKS
        all_start, all_size = (np.pad(rows(x), ((0, 0), (0, width - BLOCKS))) for x in (start, size))
        all_start[needy], all_size[needy] = free_start, free_size
        pool = all_start.reshape(n, -1)[segment], all_size.reshape(n, -1)[segment]
        heads_start, heads_size = np.zeros((n * LANES, width), np.int64), np.zeros((n * LANES, width), np.int64)
        heads_start[:, 0], heads_size[:, 0] = start, size
        late = np.flatnonzero(stuck >= 0)
        heads_start[needy[late] * BLOCKS + stuck[late]], heads_size[needy[late] * BLOCKS + stuck[late]] = stuck_start[late], stuck_size[late]
        for b in range(LANES):
            turn = np.flatnonzero(~damaged[segment] & ~lanes.ended[segment * LANES + b])
            if len(turn):
                block = segment[turn] * LANES + b
                stream = [np.column_stack([x[block], y[turn]]) for x, y in zip((heads_start, heads_size), pool)]
                left = _dense(*_read_ranges(lanes, bits, block, *stream))
                grown = max(pool[0].shape[1], left[0].shape[1])
                pool = tuple(np.pad(x, ((0, 0), (0, grown - x.shape[1]))) for x in pool)
                for x, y in zip(pool, left):
                    x[turn] = np.pad(y, ((0, 0), (0, grown - y.shape[1])))
                damaged[segment[turn]] = ~lanes.ended[block]
    shape = lambda x: x.reshape(n, LANES, *x.shape[1:])
    fourth = raw.reshape(n, UNITS, UNIT_BYTES)[:, :, 3]
    return {"value": np.where(value >= 256, value - 512, value), "mode": head >> 2 & 1, "cls": head & 3, "count": shape(lanes.count), "ended": shape(lanes.ended), "words": shape(lanes.words), "status": fourth >> 4, "quantizer": fourth & 15, "damaged": damaged}


def _matched(source: np.ndarray, spill: np.ndarray, target: np.ndarray, hole: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spilled bits of each row put into its holes, both in order: (first bit, first place, bits) of every run, and what is taken of each spill and hole."""
    both = np.minimum(spill.sum(axis=1), hole.sum(axis=1))[:, None]
    out, into = (np.clip(both - (np.cumsum(x, axis=1) - x), 0, x) for x in (spill, hole))
    # A row's spills and holes come to one length, so all rows lie behind one another on one line.
    a, b = np.flatnonzero(out), np.flatnonzero(into)
    a_end, b_end = np.cumsum(out.ravel()[a]), np.cumsum(into.ravel()[b])
    end = np.union1d(a_end, b_end)
    begin = np.concatenate([[0], end[:-1]])[: len(end)]
    i, j = np.searchsorted(a_end, begin, "right"), np.searchsorted(b_end, begin, "right")
    first = source.ravel()[a[i]] + begin - (a_end[i] - out.ravel()[a[i]])
    place = target.ravel()[b[j]] + begin - (b_end[j] - into.ravel()[b[j]])
    return first, place, end - begin, out, into


def pack(parsed: dict[str, np.ndarray], code: Code, padding: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """(segments, number of words of each that found no space); bits that nothing is written to, and identities, are those of ``padding``."""
    codes, length, _, _ = code.arrays
    n, count = len(parsed["count"]), parsed["count"].ravel()
    words = parsed["words"].reshape(n * LANES, parsed["words"].shape[2])[:, : int(count.max(initial=0))]
    own = words[np.arange(words.shape[1]) < count[:, None]]
    head = ((parsed["value"] & 0x1FF) << 3 | parsed["mode"] << 2 | parsed["cls"]).ravel()
    # Heads are first words of twelve bits, before the words of their block.
    first = np.cumsum(count) - count + np.arange(n * LANES)
    other = np.ones(len(own) + n * LANES, bool)
    other[first] = False
    number, size = np.empty(len(other), np.uint64), np.empty(len(other), np.int64)
    number[first], size[first] = head, HEAD_BITS
    number[other], size[other] = codes[own], length[own]
    width = next(w for w in (16, 32, 64) if w >= max(code.longest, HEAD_BITS))
    shown = (number << (width - size).astype(np.uint64)).astype(f">u{width // 8}")
    stream = np.unpackbits(shown.view(np.uint8)).reshape(len(other), width)[np.arange(width, dtype=np.int8) < size.astype(np.int8)[:, None]]

    ends = np.cumsum(size)
    begin = (ends - size)[first]
    total = np.append(begin[1:], len(stream))[: n * LANES] - begin
    # Own areas, then holes of the unit, then holes that the units leave.
    area = np.tile(_BITS, n)
    at = (np.arange(n)[:, None] * SEGMENT_BYTES * 8 + _STARTS).ravel()
    placed = np.minimum(total, area)
    runs = [(begin, at, placed)]
    source, spill, target, hole = begin + placed, total - placed, at + placed, area - placed
    for shape in ((n * UNITS, BLOCKS), (n, LANES)):
        *run, out, into = _matched(*(x.reshape(shape) for x in (source, spill, target, hole)))
        runs.append(run)
        out, into = out.ravel(), into.ravel()
        source, spill, target, hole, placed = source + out, spill - out, target + into, hole - into, placed + out

    bits = np.unpackbits(np.frombuffer(b"".join(padding), np.uint8))
    start, place, bits_of = (np.concatenate(x) for x in zip(*runs))
    bits[_places(place, bits_of)] = stream[_places(start, bits_of)]
    lost = np.zeros(n, np.int64)
    if spill.any():
        lane = np.repeat(np.arange(n * LANES), count + 1)
        lost = np.bincount(lane[ends > (begin + placed)[lane]] // LANES, minlength=n)
    raw = np.packbits(bits).reshape(n, SEGMENT_BYTES)
    raw.reshape(n, UNITS, UNIT_BYTES)[:, :, 3] = parsed["status"] << 4 | parsed["quantizer"]
    return [r.tobytes() for r in raw], lost


def levels(parsed: dict[str, np.ndarray], code: Code) -> np.ndarray:
    """segments x 30 x 64 quantized values in scan order; the first is the head's."""
    _, _, run, level = code.arrays
    words = parsed["words"][:, :, : int(parsed["count"].max(initial=0))]
    there = np.arange(words.shape[2]) < parsed["count"][:, :, None]
    at = np.cumsum(np.where(there, run[words] + 1, 0), axis=2)
    out = np.zeros((*words.shape[:2], LAST), np.int64)
    s, b, k = np.nonzero(there & (at < LAST))
    out[s, b, at[s, b, k]] = level[words[s, b, k]]
    out[:, :, 0] = parsed["value"]
    return out


#: Segments that are read together: some 30 MB in all.
TOGETHER = 512
SCANNED = "words long, nnz long, energy long, last_place long, damaged boolean, same boolean, lost long"


def scan(df: DataFrame, key: str, payload: str, code: Code) -> DataFrame:
    """Per segment: words, non-zero levels, their energy, the last place used, whether it is damaged, and for whole ones whether packing gives the same bytes.

    A null payload gives nulls; a wrong length raises.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (whole.iloc[i : i + TOGETHER] for whole in batches for i in range(0, len(whole), TOGETHER)):
            known = batch[batch["payload"].notna()]
            out = batch[["key"]].copy()
            raw = [bytes(x) for x in known["payload"]]
            parsed = parse(raw, code)
            again, lost = pack(parsed, code, raw)
            ac = levels(parsed, code)[:, :, 1:]
            same = pd.Series([None if d else a == b for d, a, b in zip(parsed["damaged"], again, raw)], known.index, dtype=object)
            last = np.where(ac != 0, np.arange(1, LAST), 0).max(axis=(1, 2), initial=0)
            found = {"words": parsed["count"].sum(axis=1), "nnz": (ac != 0).sum(axis=(1, 2)), "energy": np.abs(ac).sum(axis=(1, 2)), "last_place": last, "damaged": parsed["damaged"], "same": same, "lost": lost}
            for name, x in found.items():
                out[name] = pd.Series(list(x), known.index, dtype=object).reindex(out.index)
            yield out

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("key"), F.col(payload).alias("payload"))
    return rows.mapInPandas(run, f"key {kind}, {SCANNED}").withColumnRenamed("key", key)
