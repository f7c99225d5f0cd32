"""Whole columns of text as one byte buffer: words and hashes without a Python string per word.

An Arrow string column already is one UTF-8 buffer with offsets.  The functions here find words in
that buffer with a 256-entry table and hash them with a prefix sum, so a pass costs a few array
operations per byte however long or short the words are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the prefix hashes (odd numbers have an inverse modulo 2**64).
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Bytes handled at once: a batch is cut into row ranges of about this many bytes.
SLICE_BYTES = 1 << 20
#: Bytes or words hashed with one prefix sum; longer rows are hashed part by part.
PART = 4 << 20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (at least)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(n - 1, SLICE_BYTES >> 4).bit_length()  # few sizes, so that tables are seldom made anew
        inverse = pow(base, -1, 1 << 64)
        pair = []
        for b in (base, inverse):
            out = np.full(size, b, U64)
            out[0] = 1
            pair.append(np.cumprod(out, dtype=U64))
        have = _powers[base] = (pair[0], pair[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix64 finalizer)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def word_table(separators: str) -> np.ndarray:
    """bool[256]: which bytes belong to a word.

    ``"space"``: all but 0x20 and 0x09-0x0D.  ``"alnum"``: digits, a-z and every byte above 0x7F.
    """
    table = np.ones(256, bool)
    if separators == "space":
        table[[0x20, *range(0x09, 0x0E)]] = False
    elif separators == "alnum":
        table[:0x80] = False
        table[0x30:0x3A] = True
        table[0x61:0x7B] = True
    else:
        raise ValueError(separators)
    return table


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A copy with A-Z turned into a-z; other bytes stay."""
    out = data.copy()
    upper = (out >= 0x41) & (out <= 0x5A)
    out += upper.view(np.uint8) << np.uint8(5)
    return out


def column(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
    if array.null_count:
        array = array.fill_null("" if not pa.types.is_binary(array.type) else b"")
    array = array.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8) if len(array) else np.zeros(1, np.int64)
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; one longer row is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


#: Bytes of a row that goes through part by part.
LONG = 4 << 20


def pieces(data: np.ndarray, table: np.ndarray, limit: int = SLICE_BYTES, overlap: int = 0) -> Iterator[tuple[np.ndarray, Words, int]]:
    """One row in parts of about ``limit`` bytes that end between words: (bytes, their words, words met before).

    A part begins with the last ``overlap`` words of what came before, as far as there are any, so that every
    run of ``overlap + 1`` words lies within one part and ends behind the repeated words.
    """
    n, begin, pos, carried, seen = len(data), 0, 0, 0, 0
    while pos < n:
        end = min(pos + limit, n)
        while end < n and table[data[end]]:
            stop = min(end + limit, n)
            gap = np.flatnonzero(~table[data[end:stop]])
            end = end + int(gap[0]) if len(gap) else stop
        part = data[begin:end]
        words = find_words(part, np.array([0, len(part)]), table)
        count = len(words.start)
        yield part, words, seen - carried
        seen += count - carried
        carried = min(overlap, count)
        begin, pos = (begin + int(words.start[count - carried]) if carried else end), end


@dataclass
class Words:
    """Words of some rows: byte spans in ``data``, and for each row the index of its first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # len rows + 1

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Maximal runs of word bytes; rows are separate even where no separator stands between them."""
    n = len(data)
    inside = table[data]
    before = np.empty(n, bool)
    before[1:] = inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < n]
    if n:
        before[0] = False
        before[cuts] = False
    after = np.empty(n, bool)
    after[:-1] = inside[1:]
    if n:
        after[-1] = False
        after[cuts[cuts > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BYTE_BASE) -> np.ndarray:
    """64-bit hashes of byte spans (in the order of their starts); equal bytes have equal hashes wherever they stand."""
    if len(data) > PART and len(start):
        out = np.empty(len(start), U64)
        cuts = np.searchsorted(start, np.arange(0, len(data) + PART, PART))
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            if a < b:
                low = start[a]
                out[a:b] = _span_hash(data[low : end[a:b].max()], start[a:b] - low, end[a:b] - low, base)
        return out
    return _span_hash(data, start, end, base)


def _span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    if len(data) > 4 * PART:
        return np.array([_long_hash(data[a:b], base) for a, b in zip(start.tolist(), end.tolist())], U64)
    power, inverse = powers(base, len(data) + 1)
    prefix = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * power[: len(data)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64))


def _long_hash(span: np.ndarray, base: int) -> int:
    """The hash of one span, which may be very long."""
    total, mask = 0, (1 << 64) - 1
    for i in range(0, len(span), PART):
        part = span[i : i + PART]
        power, _ = powers(base, len(part) + 1)
        own = int(((part.astype(U64) + U64(1)) * power[: len(part)]).sum(dtype=U64))
        total = (total + own * pow(base, i, 1 << 64)) & mask
    return int(mix(np.array([(total + len(span)) & mask], U64))[0])


def window_hash(words: np.ndarray, size: int, base: int = WORD_BASE) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes (``len(words) - size + 1`` of them)."""
    n = len(words)
    if n < size:
        return np.zeros(0, U64)
    if n > PART + size:
        return np.concatenate([window_hash(words[i : i + PART + size - 1], size, base) for i in range(0, n - size + 1, PART)])
    power, inverse = powers(base, n + 1)
    prefix = np.zeros(n + 1, U64)
    np.cumsum(words * power[:n], out=prefix[1:])
    return mix((prefix[size:] - prefix[:-size]) * inverse[: n - size + 1])


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as an Arrow string array."""
    size = end - start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    take = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[take].tobytes())])
