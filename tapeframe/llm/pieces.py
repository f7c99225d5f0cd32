"""SentencePiece encoding and decoding as a max-plus scan.

A text's segmentations are the paths of a lattice whose arcs are vocabulary pieces.  For a unigram
model an arc weighs its piece's score.  For a BPE model a pair of neighbours weighs 0 if merging the
two pieces' characters by rank gives the two pieces back, and minus infinity otherwise; exactly one
path has a finite weight, and it is the BPE encoding.  The best path is found in the max-plus
semiring:

* Text is cut into units where no piece can reach across (a space after something else; characters
  outside the vocabulary).  Distinct units of a batch go through the lattice together, in numpy.
* Long units and documents of more than ``GIANT`` bytes are split into chunks.  A chunk yields a
  transfer matrix from boundary states to boundary states (the piece that ends at or reaches across
  the cut, and how far it reaches).  Matrices are combined associatively to all prefixes, which gives
  the state at every cut; then each chunk is traced back by itself.  Chunks of a giant document are
  rows of their own, so one document does not sit in one task until its ids are put together.

The model file's path is a parameter; its text must be taken as it is (identity normalization).

Defined cases: null text gives null ids and null text back; an empty text has no ids; U+2581 stands
for a space in the format, so it reads back as a space; repeated rows each give a row; an empty table
gives an empty result; other columns pass through.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.llm import bytetext as B
from tapeframe.llm.common import HELD, bounded, lean, stored

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of a document that goes by chunks, of a chunk, and of a unit that goes by chunks inside its task.
GIANT, CHUNK, LONG = 4 << 20, 1 << 18, 256
LONG_CHUNK = 4096
SPACE = "▁"
#: Units that go through the lattice together, units kept per process, and slots for pairs of pieces.
UNITS, KEPT, PAIR_SLOTS = 1 << 13, 1 << 20, 1 << 21
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
NEVER = float("-inf")

_space_bytes = SPACE.encode()


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message; 4-byte values are floats."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = struct.unpack("<f" if kind == 5 else "<d", data[at : at + size])[0], at + size
        yield key >> 3, value


class Model:
    """Vocabulary, and what is known of pairs of pieces."""

    def __init__(self, data: bytes) -> None:
        pieces, spec, normal = [], {}, {}
        for number, value in fields(data):
            if number == 1:
                f = dict(fields(value))
                pieces.append((f[1].decode(), f.get(2, 0.0), f.get(3, NORMAL)))
            elif number == 2:
                spec = dict(fields(value))
            elif number == 3:
                normal = dict(fields(value))
        if normal.get(1, b"identity") != b"identity" or normal.get(4, 1):
            raise ValueError("only models that keep the text as it is")
        self.bpe = spec.get(3, 1) == 2
        self.prefix = bool(normal.get(3, 1))
        self.size = n = len(pieces)
        self.scores = np.array([s for _, s, _ in pieces])
        raw = [p.replace(SPACE, " ").encode() for p, _, _ in pieces]
        self.ids = {b: i for i, (b, (_, _, k)) in enumerate(zip(raw, pieces)) if k in (NORMAL, USER)}
        self.unknown = next(i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN)
        self.byte_ids = np.full(256, -1, np.int64)
        self.text = list(raw)
        for i, (p, _, k) in enumerate(pieces):
            if k == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
                self.text[i] = bytes([int(p[3:5], 16)])
            elif k == CONTROL:
                self.text[i] = b""
            elif k == UNKNOWN:
                self.text[i] = " ⁇ ".encode()
        self.fallback = bool((self.byte_ids >= 0).all())
        self.longest = max(map(len, self.ids))
        if any(b"\0 " in p.replace(b" ", b"\0 ") and b" " in p.lstrip(b" ") for p in self.ids):
            raise ValueError("a piece goes on after a space that follows something else")
        #: Bytes that are characters outside the vocabulary: units end at them.
        self.barrier = np.array([b < 0x80 and bytes([b]) not in self.ids for b in range(256)])
        self.free = np.zeros(n + 1, bool)  # pieces that never merge, and the start
        self.free[[n, self.unknown, *self.byte_ids[self.byte_ids >= 0]]] = True
        self.unknown_score = float(self.scores[list(self.ids.values())].min() - 10)
        self._hash()
        if self.bpe:
            self._merges()

    @classmethod
    def load(cls, spark: SparkSession, path: str = MODEL_PATH) -> Model:
        """Read the file on the driver."""
        with open(path, "rb") as f:
            return cls(f.read())

    def _hash(self) -> None:
        entries = list(self.ids)
        data = np.frombuffer(b"".join(entries), np.uint8)
        end = np.cumsum([len(e) for e in entries])
        hashes = B.span_hash(data, end - [len(e) for e in entries], end)
        order = np.argsort(hashes)
        self.hashes, self.hash_ids = hashes[order], np.array(list(self.ids.values()))[order]
        self.heads = np.zeros(1 << 20, bool)
        self.heads[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Piece of each hash; -1 for none."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.heads[(hashes >> np.uint64(44)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            same = self.hashes[at] == hashes[maybe]
            out[maybe[same]] = self.hash_ids[at[same]]
        return out

    # Merging, as a definition: ranks, and how each piece comes about

    def _merges(self) -> None:
        n = self.size
        order = np.unique(-self.scores, return_inverse=True)[1].astype(np.int64)
        self.rank = np.append(order, 0)
        self.parts = np.full((n + 1, 2), -1, np.int64)
        self.stable_alone = np.zeros(n + 1, bool)
        for piece, i in self.ids.items():
            out, last = self.merged(piece, trace=True)
            self.stable_alone[i] = out == [i]
            if out == [i] and last:
                self.parts[i] = last
        #: The rank that merging has come to when a piece is there; characters are there from the start.
        self.formed = np.full(n + 1, -1, np.int64)
        for i in sorted((i for i in self.ids.values() if self.parts[i, 0] >= 0), key=lambda i: len(self.text[i])):
            self.formed[i] = max(self.rank[i], *self.formed[self.parts[i]])
        # Every way to put a piece together from two.
        keys, whole = [], []
        for piece, w in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    keys.append(a * (n + 1) + b)
                    whole.append(w)
        order = np.argsort(keys)
        self.pair_keys, self.pair_whole = np.array(keys)[order], np.array(whole)[order]
        self.right, self.left = self._spines(1), self._spines(0)

    def _spines(self, side: int) -> tuple[np.ndarray, np.ndarray]:
        """(pieces down one side of each piece, the piece each is merged into; -1 where there is none)."""
        rows, parents = [np.arange(self.size + 1)], [np.full(self.size + 1, -1)]
        while (rows[-1] >= 0).any():
            below = np.where(rows[-1] >= 0, self.parts[rows[-1], side], -1)
            parents.append(np.where(below >= 0, rows[-1], -1))
            rows.append(below)
        return np.stack(rows[:-1]), np.stack(parents[:-1])

    def merged(self, unit: bytes, trace: bool = False):
        """Merge the best-scored neighbours, the left ones first, until none merge."""
        chars = [c.encode() for c in unit.decode()]
        after, before = list(range(1, len(chars) + 1)), list(range(-1, len(chars) - 1))
        heap, last = [], None

        def offer(i: int) -> None:
            j = after[i]
            if j < len(chars) and (w := self.ids.get(chars[i] + chars[j])) is not None:
                heapq.heappush(heap, (-self.scores[w], i, chars[i], chars[j]))

        for i in range(len(chars) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if chars[i] != a or j >= len(chars) or chars[j] != b:
                continue
            last = (self.ids.get(a), self.ids.get(b))
            chars[i], chars[j] = a + b, None
            after[i] = after[j]
            if after[j] < len(chars):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out: list[int] = []
        for c in chars:
            if c is not None:
                w = self.ids.get(c)
                out += [w] if w is not None else self.byte_ids[list(c)].tolist() if self.fallback else [self.unknown]
        return (out, last if None not in (last or (None,)) else None) if trace else out

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether neighbours a and b stay apart: no pair of pieces at their border merges before both are in larger ones."""
        out = np.ones(len(a), bool)
        far = np.iinfo(np.int64).max
        rights, right_parents = self.right[0][:, a], self.right[1][:, a]
        lefts, left_parents = self.left[0][:, b], self.left[1][:, b]
        for u, pu in zip(rights, right_parents):
            for v, pv in zip(lefts, left_parents):
                k = np.flatnonzero(out & (u >= 0) & (v >= 0))
                if not len(k):
                    continue
                key = u[k] * (self.size + 1) + v[k]
                at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
                hit = self.pair_keys[at] == key
                k, w = k[hit], self.pair_whole[at[hit]]
                time, rank = np.maximum(self.rank[w], np.maximum(self.formed[u[k]], self.formed[v[k]])), self.rank[w]
                above = lambda p: (np.where(p[k] >= 0, self.formed[p[k]], far), np.where(p[k] >= 0, self.rank[p[k]], far))  # noqa: E731, B023
                (tu, ru), (tv, rv) = above(pu), above(pv)
                sooner = ((time < tu) | ((time == tu) & (rank < ru))) & ((time < tv) | ((time == tv) & (rank <= rv)))
                out[k[sooner]] = False
        return out


class Encoder:
    """A process's encoder: the model, units it has met, and pairs it has compared."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self.pair_key = np.full(PAIR_SLOTS, -1, np.int64)
        self.pair_ok = np.zeros(PAIR_SLOTS, bool)
        self._forget()

    def _forget(self) -> None:
        self.known, self.index = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and where their ids are
        self.first, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    # Neighbours

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``Model.stable`` with a table of pairs compared before."""
        out = self.m.free[a] | self.m.free[b]
        k = np.flatnonzero(~out)
        key = a[k] * (self.m.size + 1) + b[k]
        slot = (B.mix(key.view(np.uint64)) >> np.uint64(64 - 21)).astype(np.int64) % PAIR_SLOTS
        miss = np.flatnonzero(self.pair_key[slot] != key)
        if len(miss):
            new, at = np.unique(key[miss], return_index=True)
            ok = self.m.stable(a[k[miss[at]]], b[k[miss[at]]])
            value = np.empty(len(key), bool)
            value[miss] = ok[np.searchsorted(new, key[miss])]
            hit = np.ones(len(key), bool)
            hit[miss] = False
            value[hit] = self.pair_ok[slot[hit]]
            self.pair_key[slot[miss[at]]], self.pair_ok[slot[miss[at]]] = new, ok
            # Two new pairs may share a slot: the last one written is the one that stays.
            out[k] = value
            return out
        out[k] = self.pair_ok[slot]
        return out

    # Many short units at once

    def arcs(self, data: np.ndarray, owner_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, length, piece) of all pieces that lie within one unit."""
        n = len(data)
        power, inverse = B.powers(B.BYTE_BASE, n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
        lead = (data & 0xC0) != 0x80
        starts = np.flatnonzero(lead)
        width = np.diff(np.append(starts, n))
        outside = np.ones(n, bool)  # characters that are no pieces
        found = []
        for k in range(1, self.m.longest + 1):
            starts = starts[starts + k <= owner_end[starts]]
            if not len(starts):
                break
            piece = self.m.lookup(B.mix((prefix[starts + k] - prefix[starts]) * inverse[starts] + np.uint64(k)))
            hit = np.flatnonzero(piece >= 0)
            if self.m.bpe:
                hit = hit[self.m.stable_alone[piece[hit]]]
            found.append((starts[hit], np.full(len(hit), k), piece[hit]))
            outside[starts[hit]] &= False if k > 4 else lead_width(lead, starts[hit], n) != k
        heads = np.flatnonzero(lead)
        for a, w in zip(heads[outside[heads]].tolist(), width[outside[heads]].tolist()):
            if self.m.fallback:
                found.append((np.arange(a, a + w), np.ones(w, np.int64), self.m.byte_ids[data[a : a + w]]))
            else:
                found.append((np.array([a]), np.array([w]), np.array([self.m.unknown])))
        return tuple(np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3))

    def paths(self, units: list[bytes]) -> list[np.ndarray]:
        """Ids of BPE units, by the only path of neighbours that stay apart."""
        size = np.array([len(u) for u in units])
        data = np.frombuffer(b"".join(units), np.uint8)
        offset = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), size)
        start, length, piece = self.arcs(data, (offset + size)[owner])
        # A unit of n bytes has n + 1 places; arcs are taken in the order of the place where they end.
        slot = offset + np.arange(len(size))
        enter = start + owner[start]
        ends = enter + length - slot[owner[start]]
        order = np.argsort(ends.astype(np.uint16) if size.max(initial=0) < 1 << 16 else ends, kind="stable")
        enter, length, piece, ends = enter[order], length[order], piece[order], ends[order]
        last = np.full(len(data) + len(size), -1, np.int64)
        step = np.zeros(len(last), np.int64)
        last[slot] = self.m.size
        cuts = np.flatnonzero(np.diff(ends, prepend=-1, append=-1))
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            before = last[enter[a:b]]
            live = np.flatnonzero(before >= 0)
            live = live[self.apart(before[live], piece[a:b][live])] + a
            to = enter[live] + length[live]
            last[to], step[to] = piece[live], length[live]
        at, parts = size.copy(), []
        open_ = np.flatnonzero(last[slot + at] >= 0)
        failed = np.flatnonzero(last[slot + at] < 0)
        while len(open_):
            row = np.full(len(size), -1, np.int32)
            row[open_] = last[slot[open_] + at[open_]]
            at[open_] -= step[slot[open_] + at[open_]]
            parts.append(row)
            open_ = open_[at[open_] > 0]
        table = np.stack(parts[::-1], axis=1) if parts else np.zeros((len(size), 0), np.int32)
        used = table >= 0
        flat, edges = table[used], np.concatenate([[0], np.cumsum(used.sum(axis=1))]).tolist()
        out = [flat[a:b] for a, b in zip(edges, edges[1:])]
        for r in failed.tolist():
            out[r] = np.array(self.m.merged(units[r]), np.int32)
        return out

    # Chunks

    def weight(self, before: int, piece: int) -> float:
        if not self.m.bpe:
            return self.m.unknown_score if piece == self.m.unknown or self.m.free[piece] else float(self.m.scores[piece])
        return 0.0 if self.m.free[before] or self.m.free[piece] or self.apart(np.array([before]), np.array([piece]))[0] else NEVER

    def _arcs_at(self, text: bytes) -> list[list[tuple[int, int]]]:
        """(piece, end) of the arcs that start at each byte."""
        data = np.frombuffer(text, np.uint8)
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(text) + 1)]
        for a, k, piece in zip(*(x.tolist() for x in self.arcs(data, np.full(len(data), len(data))))):
            out[a].append((piece, a + k))
        return out

    def _key(self, piece: int) -> int:
        """What of the last piece the next one's weight depends on."""
        return piece if self.m.bpe else self.m.size

    def entries(self, arcs, start: int) -> list[tuple[int, int]]:
        """Boundary states at ``start``: (last piece, bytes it reaches across)."""
        if start == 0:
            return [(self.m.size, 0)]
        return sorted({(self._key(p), e - start) for a in range(max(0, start - self.m.longest), start) for p, e in arcs[a] if e >= start})

    def transfer(self, text: bytes, start: int, end: int) -> dict[tuple, dict[tuple, float]]:
        """The chunk's matrix: best weight from each boundary state at ``start`` to each at ``end``."""
        arcs = self._arcs_at(text)
        states = self.entries(arcs, start)
        nodes: dict[int, dict[int, np.ndarray]] = {}
        for i, (piece, over) in enumerate(states):
            row = nodes.setdefault(start + over, {}).setdefault(piece, np.full(len(states), NEVER))
            row[i] = 0.0
        for at in range(start, end):
            for piece, weights in nodes.get(at, {}).items():
                for nxt, stop in arcs[at]:
                    w = self.weight(piece, nxt)
                    if w > NEVER:
                        into, key = nodes.setdefault(stop, {}), self._key(nxt)
                        into[key] = np.maximum(into[key], weights + w) if key in into else weights + w
        out: dict[tuple, dict[tuple, float]] = {s: {} for s in states}
        for at in range(end, end + self.m.longest + 1):
            for piece, weights in nodes.get(at, {}).items():
                for i in np.flatnonzero(weights > NEVER).tolist():
                    out[states[i]][piece, at - end] = float(weights[i])
        return out

    def trace(self, text: bytes, start: int, end: int, enter: tuple, leave: tuple) -> list[int]:
        """Pieces that start in the chunk, on its best path between two boundary states."""
        arcs = self._arcs_at(text)
        nodes: dict[int, dict[int, tuple]] = {start + enter[1]: {enter[0]: (0.0, None)}}
        for at in range(start, end):
            for piece, (weight, _) in list(nodes.get(at, {}).items()):
                for nxt, stop in arcs[at]:
                    w = weight + self.weight(piece, nxt)
                    into, key = nodes.setdefault(stop, {}), self._key(nxt)
                    if w > NEVER and (key not in into or w > into[key][0]):
                        into[key] = (w, (at, piece, nxt))
        out, place = [], (end + leave[1], leave[0])
        while place != (start + enter[1], enter[0]) and (back := nodes[place[0]][place[1]][1]):
            out.append(back[2])
            place = back[:2]
        return out[::-1]

    def long_unit(self, unit: bytes) -> np.ndarray:
        """Ids of a long unit by chunks, here in one process."""
        cuts = [*range(0, len(unit), LONG_CHUNK), len(unit)]
        spans = list(zip(cuts, cuts[1:]))
        views = [(unit[max(0, a - self.m.longest) : b + self.m.longest], min(a, self.m.longest), min(a, self.m.longest) + b - a) for a, b in spans]
        states = boundary_states([self.transfer(*self._aligned(*v)) for v in views])
        if states is None:
            return np.array(self.m.merged(unit), np.int32)
        return np.array([i for v, a, b in zip(views, states, states[1:]) for i in self.trace(*self._aligned(*v), a, b)], np.int32)

    @staticmethod
    def _aligned(text: bytes, start: int, end: int) -> tuple[bytes, int, int]:
        """Without parts of characters at either end of the view."""
        skip = 0
        while skip < start and text[skip] & 0xC0 == 0x80:
            skip += 1
        tail = len(text)
        while tail > end:
            try:
                text[skip:tail].decode()
                break
            except UnicodeDecodeError as e:
                tail = skip + e.start if skip + e.start >= end else tail - 1
        return text[skip:tail], start - skip, end - skip

    # Texts

    def ids_of_units(self, units: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(units)
        short = [i for i, u in enumerate(units) if len(u) <= LONG and self.m.bpe]
        for a in range(0, len(short), UNITS):
            part = short[a : a + UNITS]
            for i, ids in zip(part, self.paths([units[i] for i in part])):
                out[i] = ids
        chosen = set(short)
        for i, u in enumerate(units):
            if i not in chosen:
                out[i] = self.long_unit(u)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, index of each row's first id) of prepared texts."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        start = unit_starts(data, offsets, self.m.barrier)
        end = np.append(start[1:], len(data))
        hashes = B.span_hash(data, start, end)
        unique, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > KEPT:
            self._forget()
        place = np.searchsorted(self.known, unique)
        index = np.full(len(unique), -1)
        met = np.flatnonzero(place < len(self.known))
        met = met[self.known[place[met]] == unique[met]]
        index[met] = self.index[place[met]]
        new = np.flatnonzero(index < 0)
        if len(new):
            raw = data.tobytes()
            ids = self.ids_of_units([raw[a:b] for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist())])
            length = np.array([len(x) for x in ids])
            base = len(self.length)
            self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.pool = np.concatenate([self.pool, *ids])
            index[new] = base + np.arange(len(new))
            self.known, self.index = np.insert(self.known, place[new], unique[new]), np.insert(self.index, place[new], index[new])
        own = index[inverse]
        size, first = self.length[own], self.first[own]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(first - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(start, offsets)]


def lead_width(lead: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Bytes of the characters that start at ``at``."""
    width = np.ones(len(at), np.int64)
    open_ = np.ones(len(at), bool)
    for k in range(1, 4):
        open_ &= (at + k < n) & ~lead[np.minimum(at + k, n - 1)]
        width += open_
    return width


def unit_starts(data: np.ndarray, offsets: np.ndarray, barrier: np.ndarray) -> np.ndarray:
    """Where units begin: at rows, at a space after something else, and on both sides of a barrier."""
    space, wall = data == 0x20, barrier[data]
    begin = np.zeros(len(data), bool)
    begin[1:] = (space[1:] & ~space[:-1]) | wall[1:] | wall[:-1]
    begin[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(begin)


def combine(a: dict, b: dict) -> dict:
    """Max-plus product of two transfer matrices."""
    out = {}
    for s, row in a.items():
        new: dict[tuple, float] = {}
        for t, w in row.items():
            for u, x in b.get(t, {}).items():
                if w + x > new.get(u, NEVER):
                    new[u] = w + x
        out[s] = new
    return out


def prefixes(matrices: list[dict]) -> list[dict]:
    """Products of the first 1, 2, ... matrices, by an associative scan (pairs first, then what lies between)."""
    if len(matrices) < 2:
        return list(matrices)
    pairs = prefixes([combine(a, b) for a, b in zip(matrices[::2], matrices[1::2])])
    out = [matrices[0]]
    for k in range(1, len(matrices)):
        out.append(pairs[k // 2] if k % 2 else combine(pairs[k // 2 - 1], matrices[k]))
    return out


def boundary_states(matrices: list[dict]) -> list[tuple] | None:
    """The best path's state at every cut, first and last included; None if there is no path."""
    start = next(iter(matrices[0]))
    done = prefixes(matrices)
    ends = {s: w for s, w in done[-1][start].items() if s[1] == 0}
    if not ends:
        return None
    out = [max(sorted(ends), key=lambda s: ends[s])]
    for k in range(len(matrices) - 1, 0, -1):
        before = {s: w + matrices[k][s][out[-1]] for s, w in done[k - 1][start].items() if out[-1] in matrices[k].get(s, {})}
        out.append(max(sorted(before), key=lambda s: before[s]))
    return [start, *out[::-1]]


def prepared(array, prefix: bool) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts as the model reads them: U+2581 as a space, and one space before each text that is not empty."""
    data, offsets = B.column(array)
    if _space_bytes in data.tobytes():
        array = pa.array([None if x is None else x.replace(SPACE, " ") for x in array.to_pylist()], pa.string())
        data, offsets = B.column(array)
    if not prefix:
        return data, offsets
    size = np.diff(offsets)
    full = size > 0
    new = np.concatenate([[0], np.cumsum(size + full)])
    out = np.full(int(new[-1]), 0x20, np.uint8)
    place = np.ones(len(out), bool)
    place[new[:-1][full]] = False
    out[place] = data
    return out, new


_encoders: dict[int, Encoder] = HELD.setdefault("pieces", {})


def _encoder(shared) -> Encoder:
    """One encoder for each process and model, so that units met by one task are known to the next."""
    if shared.id not in _encoders:
        _encoders.clear()
        _encoders[shared.id] = Encoder(shared.value)
    return _encoders[shared.id]


class _Shared:
    """A broadcast model with a key for the process's encoders."""

    def __init__(self, spark: SparkSession, model: Model) -> None:
        self.broadcast = spark.sparkContext.broadcast(model)
        self.id = self.broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self) -> Model:
        return self.broadcast.value


def _list(ids: np.ndarray, first: np.ndarray, null: np.ndarray | None) -> pa.Array:
    offsets = pa.array(first.astype(np.int32), mask=None if null is None else np.append(null, False))
    return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))


def _schema(docs: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *more])


def encode(spark: SparkSession, docs: DataFrame, model: Model, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the array of ids of the text, and what they decode to if ``decoded`` names a column for it."""
    bounded(spark)
    shared = _Shared(spark, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(shared)
        for batch in batches:
            column = batch.column(text)
            _, offsets = B.column(column)
            for i, j in B.row_slices(offsets):
                part = batch.slice(i, j - i)
                values, first = own.encode(*prepared(part.column(text), own.m.prefix))
                null = part.column(text).is_null().to_numpy(zero_copy_only=False)
                lists = _list(values, first, null if null.any() else None)
                more = [] if decoded is None else [_texts(own.m, lists)]
                yield pa.RecordBatch.from_arrays([*part.columns, lists, *more], names=[*part.schema.names, ids, *[decoded] * len(more)])

    more = [f"`{decoded}` string"] if decoded else []
    small = docs.where(F.col(text).isNull() | (F.octet_length(text) <= GIANT)).mapInArrow(lean(run, "pieces"), _schema(docs, f"`{ids}` array<int>", *more))
    giant = _giant(spark, docs.where(F.octet_length(text) > GIANT), shared, text, ids)
    return small.unionByName(decode(spark, giant, model, ids, decoded) if decoded else giant)


def _giant(spark: SparkSession, docs: DataFrame, shared: _Shared, text: str, ids: str) -> DataFrame:
    """The same for giant documents: chunks are rows, and meet only as matrices and as ids."""
    names = docs.columns
    rows = docs.withColumn("__rid", F.monotonically_increasing_id())
    chunk_schema = pa.schema([("rid", pa.int64()), ("k", pa.int32()), ("view", pa.binary()), ("start", pa.int32()), ("end", pa.int32())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for rid, one in zip(batch.column("rid").to_pylist(), batch.column("text")):
                data = prepared(pa.array([one.as_py()], pa.string()), m.prefix)[0].tobytes()
                for k, a in enumerate(range(0, len(data), CHUNK)):
                    b, skip = min(a + CHUNK, len(data)), min(a, m.longest)
                    yield pa.RecordBatch.from_pylist([{"rid": rid, "k": k, "view": data[a - skip : b + m.longest], "start": skip, "end": skip + b - a}], schema=chunk_schema)

    # Rows are stored, so that ids given to them hold in all later steps.
    rows = stored(spark, rows, "giant")
    chunks = rows.select(F.col("__rid").alias("rid"), F.col(text).alias("text")).mapInArrow(lean(split, "pieces"), "rid long, k int, view binary, start int, end int")
    chunks = stored(spark, chunks.repartition("rid", "k"), "chunks")

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(shared)
        for batch in batches:
            for r in batch.to_pylist():
                found = own.transfer(*own._aligned(r["view"], r["start"], r["end"]))
                flat = [(*s, *t, w) for s, row in found.items() for t, w in row.items()]
                yield pa.RecordBatch.from_pylist([{"rid": r["rid"], "k": r["k"], "cells": pa.scalar(flat and np.array(flat, np.float64).tobytes() or b"", pa.binary()).as_py(), "first": list(next(iter(found)))}], schema=pa.schema([("rid", pa.int64()), ("k", pa.int32()), ("cells", pa.binary()), ("first", pa.list_(pa.int32()))]))

    def states(table: pa.Table) -> pa.Table:
        found = []
        for r in sorted(table.to_pylist(), key=lambda r: r["k"]):
            out: dict[tuple, dict[tuple, float]] = {tuple(r["first"]): {}}
            for a, b, c, d, w in np.frombuffer(r["cells"], np.float64).reshape(-1, 5).tolist():
                out.setdefault((int(a), int(b)), {})[int(c), int(d)] = w
            found.append(out)
        path = boundary_states(found)
        rid = table.column("rid")[0].as_py()
        if path is None:
            raise ValueError("a text has no path through the vocabulary")
        flat = [{"rid": rid, "k": k, "enter": list(a), "leave": list(b)} for k, (a, b) in enumerate(zip(path, path[1:]))]
        return pa.Table.from_pylist(flat, schema=pa.schema([("rid", pa.int64()), ("k", pa.int32()), ("enter", pa.list_(pa.int32())), ("leave", pa.list_(pa.int32()))]))

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(shared)
        for batch in batches:
            for r in batch.to_pylist():
                got = own.trace(*own._aligned(r["view"], r["start"], r["end"]), tuple(r["enter"]), tuple(r["leave"]))
                yield pa.RecordBatch.from_pylist([{"rid": r["rid"], "k": r["k"], "part": got}], schema=pa.schema([("rid", pa.int64()), ("k", pa.int32()), ("part", pa.list_(pa.int32()))]))

    cells = chunks.mapInArrow(lean(matrix, "pieces"), "rid long, k int, cells binary, first array<int>")
    path = cells.groupBy("rid").applyInArrow(states, "rid long, k int, enter array<int>, leave array<int>")
    parts = chunks.join(path, ["rid", "k"]).mapInArrow(lean(trace, "pieces"), "rid long, k int, part array<int>")
    whole = parts.groupBy("rid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"])).alias("__ids"))
    return rows.join(whole, rows["__rid"] == whole["rid"]).select(*(rows[c] for c in names), F.col("__ids").alias(ids))


def _texts(m: Model, lists: pa.ListArray) -> pa.Array:
    """What lists of ids stand for."""
    size = np.array([len(t) for t in m.text])
    first, pool = np.cumsum(size) - size, np.frombuffer(b"".join(m.text), np.uint8)
    offsets = lists.offsets.to_numpy()
    values = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_numpy(zero_copy_only=False)
    own = size[values]
    place = np.concatenate([[0], np.cumsum(own)])
    raw = pool[np.repeat(first[values] - place[:-1], own) + np.arange(place[-1])].tobytes()
    cut = place[offsets - offsets[0]].tolist()
    null = lists.is_null().to_pylist()
    return pa.array([None if x else raw[a + (m.prefix and a < b and raw[a : a + 1] == b" ") : b].decode(errors="replace") for x, a, b in zip(null, cut, cut[1:])], pa.string())


def decode(spark: SparkSession, rows: DataFrame, model: Model, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``rows`` with the text that the ids stand for; broken byte sequences become U+FFFD."""
    bounded(spark)
    shared = _Shared(spark, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _encoder(shared).m
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, _texts(m, part.column(ids))], names=[*part.schema.names, decoded])

    return rows.mapInArrow(lean(run, "pieces"), _schema(rows, f"`{decoded}` string"))


def digest(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, number of ids, a hash of them, and whether they read back as the text."""
    rows = encode(spark, docs.select("doc_id", "text"), model, decoded="decoded")
    same = F.col("decoded").eqNullSafe(F.translate("text", SPACE, " "))
    return rows.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), same.alias("round_trip"))
