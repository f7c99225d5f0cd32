"""Media columns of progressive JPEG.

``Decoder`` reads progressive files: spectral-selection and successive-approximation scans accumulate
in coefficient arrays, blocks are dequantized and inverse-transformed in numpy, chroma is upsampled to
full resolution, and the result is an RGB tensor.  Scans are read bit by bit in general.  A scan whose
records all have one length (which is checked for every record) is read as a matrix of bits instead.

``encode`` writes coefficient arrays as a progressive file.  ``from_payload`` stores bytes as the
format's unit, the quantized coefficient: byte k of a block of 64 is coefficient k in zigzag order, as
256 + byte (DC: 512 + byte in a component's even blocks, byte - 768 in odd ones).  The first half of the
blocks is luma, the rest two chroma components of half its width.  DC goes in interleaved scans, luma in
two spectral bands of the upper bits and a refinement scan of the last bit, each chroma component in one
band.  In this range all codes of a scan have one length.

``store_media`` writes the media column as a table in the shared folder; ``read_back`` decodes what that
table holds and computes features of the RGB tensor, chroma upsampled.  Tensors are 1.5 bytes for each
payload byte and are made on reading (``tensors``), not kept beside the media.

Defined cases: a null text is empty; an empty text is one block of zeros; repeated rows each give a
row; an empty table gives an empty result; other columns are ignored.  ``tensors`` gives null tensors
and the reason for null or broken media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.functions.tables import new_path
from tapeframe.llm.common import texts

BLOCK = 64
#: Records that are turned into bits together (a multiple of 8, so that a part ends on a byte).
PART = 1 << 15


def zigzag() -> np.ndarray:
    """Natural index (row * 8 + column) of each zigzag position: diagonals in alternating directions."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = zigzag()


def _inverse_transform() -> np.ndarray:
    """64 x 64: natural-order coefficients to pixels of a block."""
    k = np.arange(8)
    basis = np.sqrt(np.where(k == 0, 1, 2) / 8) * np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16)
    return np.einsum("yu,xv->uvyx", basis, basis).reshape(64, 64)


INVERSE = _inverse_transform()
FROM_ZIGZAG = INVERSE[ZIGZAG].astype(np.float32)


@dataclass
class Component:
    key: int
    h: int
    v: int
    table: int
    blocks: np.ndarray  # rows x columns x 64, zigzag order
    shown: tuple[int, int] = (0, 0)  # rows and columns of blocks in scans of this component alone


@dataclass
class Picture:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    comment: bytes = b""

    def planes(self) -> list[np.ndarray]:
        """Each component's samples at its own resolution, 0 to 255."""
        out = []
        for c in self.components:
            rows, columns, _ = c.blocks.shape
            scaled = (c.blocks.reshape(-1, 64) * self.quant[c.table]).astype(np.float32)
            pixels = scaled @ FROM_ZIGZAG
            pixels += np.float32(128)
            pixels = np.clip(np.rint(pixels, out=pixels), 0, 255, out=pixels).astype(np.uint8)
            out.append(pixels.reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, columns * 8))
        return out

    def rgb(self) -> np.ndarray:
        """height x width x 3; chroma samples are repeated to full resolution."""
        top_h, top_v = max(c.h for c in self.components), max(c.v for c in self.components)
        full = [np.repeat(np.repeat(p, top_v // c.v, 0), top_h // c.h, 1)[: self.height, : self.width] for c, p in zip(self.components, self.planes())]
        if len(full) < 3:
            return np.broadcast_to(full[0][:, :, None], (*full[0].shape, 3))
        out = np.empty((*full[0].shape, 3), np.uint8)
        strip = max(PART * 8 // self.width, 1)
        for i in range(0, self.height, strip):
            y, cb, cr = (p[i : i + strip].astype(np.float32) for p in full[:3])
            cb -= 128
            cr -= 128
            for k, sample in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
                out[i : i + strip, :, k] = np.clip(np.rint(sample, out=sample), 0, 255, out=sample)
        return out


# Reading


class Broken(ValueError):
    """The file is not one that this decoder reads."""


@dataclass
class Huffman:
    """Symbol and code length for the next 16 bits."""

    symbol: np.ndarray = field(default_factory=lambda: np.zeros(1 << 16, np.int32))
    size: np.ndarray = field(default_factory=lambda: np.zeros(1 << 16, np.int32))

    @staticmethod
    @lru_cache(64)
    def of(counts: bytes, symbols: bytes) -> Huffman:
        out, code, k = Huffman(), 0, 0
        for bits in range(1, 17):
            for _ in range(counts[bits - 1]):
                a, b = code << (16 - bits), (code + 1) << (16 - bits)
                out.symbol[a:b], out.size[a:b] = symbols[k], bits
                code, k = code + 1, k + 1
            code <<= 1
        return out


class Bits:
    """Bits of one restart interval, after stuffing is taken out."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data + b"\xff\xff\xff\xff", 0, 8 * len(data)

    def peek16(self) -> int:
        byte, shift = divmod(self.at, 8)
        return int.from_bytes(self.data[byte : byte + 3].ljust(3, b"\xff"), "big") >> (8 - shift) & 0xFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        out = self.peek16() >> (16 - n)
        self.at += n
        if self.at > self.end:
            raise Broken("the data end early")
        return out

    def symbol(self, table: Huffman) -> int:
        head = self.peek16()
        size = int(table.size[head])
        if not size:
            raise Broken("no such code")
        self.at += size
        return int(table.symbol[head])

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x if not n or x >> (n - 1) else x - (1 << n) + 1


class Decoder:
    def __init__(self, data: bytes) -> None:
        self.data, self.raw = data, np.frombuffer(data, np.uint8)
        self.huffman: dict[tuple[int, int], Huffman] = {}
        self.quant: dict[int, np.ndarray] = {}
        self.picture: Picture | None = None
        self.interval, self.comment = 0, b""

    def decode(self) -> Picture:
        d = self.data
        if d[:2] != b"\xff\xd8":
            raise Broken("no start of image")
        at = 2
        while at + 4 <= len(d) or d[at : at + 2] == b"\xff\xd9":
            if d[at] != 0xFF:
                raise Broken("no marker")
            marker = d[at + 1]
            if marker == 0xD9:
                break
            if marker == 0xFF:
                at += 1
                continue
            size = struct.unpack(">H", d[at + 2 : at + 4])[0]
            body, at = d[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xC4:
                self._tables(body)
            elif marker == 0xDB:
                self._quant(body)
            elif marker in (0xC0, 0xC1, 0xC2):
                self._frame(body)
            elif marker == 0xDD:
                self.interval = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                at = self._scan(body, at, marker)
        if self.picture is None:
            raise Broken("no frame")
        self.picture.comment = self.comment
        return self.picture

    def _tables(self, body: bytes) -> None:
        while body:
            n = sum(body[1:17])
            self.huffman[body[0] >> 4, body[0] & 15] = Huffman.of(body[1:17], body[17 : 17 + n])
            body = body[17 + n :]

    def _quant(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            n = 128 if wide else 64
            self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
            body = body[1 + n :]

    def _frame(self, body: bytes) -> None:
        precision, height, width, n = struct.unpack(">BHHB", body[:6])
        if precision != 8 or not height or not width:
            raise Broken("not 8-bit samples of a known size")
        specs = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        top_h, top_v = max(s[1] for s in specs), max(s[2] for s in specs)
        across, down = -(-width // (8 * top_h)), -(-height // (8 * top_v))
        parts = []
        for key, h, v, table in specs:
            shown = (-(-(-(-height * v // top_v)) // 8), -(-(-(-width * h // top_h)) // 8))
            parts.append(Component(key, h, v, table, np.zeros((down * v, across * h, 64), np.int32), shown))
        self.picture = Picture(width, height, parts, self.quant)

    def _scan(self, body: bytes, at: int, _marker: int) -> int:
        if self.picture is None:
            raise Broken("a scan before its frame")
        n = body[0]
        chosen = [(next(c for c in self.picture.components if c.key == body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        # The data end at the next marker that is neither stuffing nor a restart.
        ff = np.flatnonzero(self.raw[at:-1] == 0xFF) + at
        after = self.raw[ff + 1]
        stops = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
        stop = int(stops[0]) if len(stops) else len(self.raw)
        restarts = ff[(after >= 0xD0) & (after <= 0xD7) & (ff < stop)].tolist()
        edges = [at, *(r + 2 for r in restarts)]
        segments = [self.data[a:b].replace(b"\xff\x00", b"\xff") for a, b in zip(edges, [*restarts, stop])]
        if len(segments) == 1 and (self._uniform(chosen[0], segments[0], first, last, high, low) if n == 1 else last == 0 and self._uniform_units(chosen, segments[0], high, low)):
            return stop
        self._general(chosen, segments, first, last, high, low)
        return stop

    def _units(self, chosen: list) -> Iterator[list[tuple[int, Component, np.ndarray]]]:
        """Blocks of each coded unit, in order: one, or all of an interleaved unit."""
        if len(chosen) == 1:
            c = chosen[0][0]
            for r in range(c.shown[0]):
                for k in range(c.shown[1]):
                    yield [(0, c, c.blocks[r, k])]
            return
        c = chosen[0][0]
        down, across = c.blocks.shape[0] // c.v, c.blocks.shape[1] // c.h
        for r in range(down):
            for k in range(across):
                yield [(i, c, c.blocks[r * c.v + y, k * c.h + x]) for i, (c, _, _) in enumerate(chosen) for y in range(c.v) for x in range(c.h)]

    def _general(self, chosen: list, segments: list[bytes], first: int, last: int, high: int, low: int) -> None:
        queue = iter(segments)
        bits, run, before, left = None, 0, [0] * len(chosen), 0
        for unit in self._units(chosen):
            if bits is None or (self.interval and not left):
                bits, run, before, left = Bits(next(queue, b"")), 0, [0] * len(chosen), self.interval
            left -= 1
            for i, _, block in unit:
                dc, ac = self.huffman.get((0, chosen[i][1])), self.huffman.get((1, chosen[i][2]))
                if first == 0 and high:
                    block[0] |= bits.take(1) << low
                elif first == 0:
                    before[i] += bits.signed(bits.symbol(dc))
                    block[0] = before[i] * (1 << low)
                if last:
                    run = (self._refine if high else self._spectral)(bits, ac, block, max(first, 1), last, low, run)

    @staticmethod
    def _spectral(bits: Bits, table: Huffman, block: np.ndarray, first: int, last: int, low: int, run: int) -> int:
        if run:
            return run - 1
        k = first
        while k <= last:
            zeros, size = divmod(bits.symbol(table), 16)
            if size:
                k += zeros
                if k > last:
                    raise Broken("a run goes past its band")
                block[k] = bits.signed(size) * (1 << low)
            elif zeros < 15:
                return (1 << zeros) - 1 + bits.take(zeros)
            else:
                k += 15
            k += 1
        return 0

    @staticmethod
    def _refine(bits: Bits, table: Huffman, block: np.ndarray, first: int, last: int, low: int, run: int) -> int:
        one, k = 1 << low, first

        def correct(k: int) -> None:
            if bits.take(1) and not abs(int(block[k])) & one:
                block[k] += one if block[k] > 0 else -one

        while not run and k <= last:
            zeros, size = divmod(bits.symbol(table), 16)
            value = 0
            if size:
                value = one if bits.take(1) else -one
            elif zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            while k <= last:
                if block[k]:
                    correct(k)
                elif not zeros:
                    block[k] = value
                    k += 1
                    break
                else:
                    zeros -= 1
                k += 1
        if run:
            for k in range(k, last + 1):
                if block[k]:
                    correct(k)
            return run - 1
        return 0

    def _uniform(self, chosen: tuple, data: bytes, first: int, last: int, high: int, low: int) -> bool:
        """Read a scan whose records all have one length; False (and nothing changed) if it is not such a scan."""
        c, dc, ac = chosen
        rows, columns = c.shown
        if c.blocks.shape[:2] != c.shown or (first == 0) != (last == 0):
            return False
        blocks = c.blocks.reshape(-1, 64)
        n, raw = rows * columns, np.frombuffer(data, np.uint8)
        if first == 0 and high:
            if len(raw) * 8 < n:
                return False
            blocks[:, 0] |= np.unpackbits(raw, count=n).astype(np.int32) << low
            return True
        table = self.huffman.get((0, dc) if first == 0 else (1, ac))
        if table is None:
            return False
        head = Bits(data).peek16()
        code, symbol, width = int(table.size[head]), int(table.symbol[head]), last - first + 1
        if not code:
            return False
        if high:
            if symbol != 0 or not blocks[:, first : last + 1].all():
                return False
            found = _records(raw, n, code + width)
            if found is None or not (_heads(found, table)[0] == 0).all():
                return False
            bit = found[:, code:].astype(np.int32) << low
            band = blocks[:, first : last + 1]
            band += np.where(band > 0, bit, -bit) * ((np.abs(band) & (1 << low)) == 0)
            return True
        values = _numbers(raw, n * width if first else n, table, head, spectral=bool(first))
        if values is None:
            return False
        if first:
            blocks[:, first : last + 1] = values.reshape(n, width) << low
        else:
            blocks[:, 0] = np.cumsum(values) << low
        return True

    def _uniform_units(self, chosen: list, data: bytes, high: int, low: int) -> bool:
        """The same for an interleaved DC scan: records of all components' blocks, unit by unit."""
        c = chosen[0][0]
        down, across = c.blocks.shape[0] // c.v, c.blocks.shape[1] // c.h
        sizes = [c.v * c.h for c, _, _ in chosen]
        raw, count = np.frombuffer(data, np.uint8), down * across * sum(sizes)
        if high:
            if len(raw) * 8 < count:
                return False
            values = np.unpackbits(raw, count=count).astype(np.int64)
        else:
            tables = {id(self.huffman.get((0, dc))): self.huffman.get((0, dc)) for _, dc, _ in chosen}
            table = tables.popitem()[1]
            if tables or table is None:
                return False
            values = _numbers(raw, count, table, Bits(data).peek16(), spectral=False)
            if values is None:
                return False
        units, at = values.reshape(down * across, -1), 0
        for (c, _, _), size in zip(chosen, sizes):
            own, at = units[:, at : at + size].ravel(), at + size
            place = np.arange(c.blocks.shape[0] * c.blocks.shape[1]).reshape(down, c.v, across, c.h).swapaxes(1, 2).ravel()
            blocks = c.blocks.reshape(-1, 64)
            if high:
                blocks[place, 0] |= (own << low).astype(np.int32)
            else:
                blocks[place, 0] = np.cumsum(own) << low
        return True


def _numbers(raw: np.ndarray, count: int, table: Huffman, head: int, spectral: bool) -> np.ndarray | None:
    """The numbers of ``count`` records (a code and as many bits as it says), if all records are as long as the first."""
    code, symbol = int(table.size[head]), int(table.symbol[head])
    length = code + (symbol & 15)
    if not code or length > 32 or (spectral and symbol >> 4):
        return None
    values = np.empty(count, np.int64)
    for i, part in _record_parts(raw, count, length):
        if part is None:
            return None
        if length <= 16:
            whole = _left(part) >> np.uint16(16 - length)
            if ((whole >> np.uint16(length - code)) == head >> (16 - code)).all():
                size = symbol & 15
                if spectral and not size:
                    return None
                value = (whole & np.uint16((1 << size) - 1)).astype(np.int64)
                values[i : i + len(part)] = value if not size else np.where(value >> (size - 1), value, value - (1 << size) + 1)
                continue
        symbols, codes = _heads(part, table)
        sizes = symbols & 15
        if (symbols >> 4).any() or (codes == 0).any() or (codes + sizes != length).any() or (spectral and (sizes == 0).any()):
            return None
        padded = np.zeros((len(part), 32), np.uint8)
        padded[:, 32 - length :] = part
        whole = np.packbits(padded, axis=1).view(">u4").ravel().astype(np.int64)
        value = whole & ((1 << sizes) - 1)
        values[i : i + len(part)] = np.where((value >> np.maximum(sizes - 1, 0)) > 0, value, value - (1 << sizes) + 1)
    return values


def _record_parts(raw: np.ndarray, count: int, length: int) -> Iterator[tuple[int, np.ndarray | None]]:
    """(first record, bits of records) in parts; None if the data are too short."""
    if len(raw) * 8 < count * length:
        yield 0, None
        return
    for i in range(0, count, PART):
        k = min(PART, count - i)
        yield i, np.unpackbits(raw[i * length // 8 :], count=k * length).reshape(k, length)


def _records(raw: np.ndarray, count: int, length: int) -> np.ndarray | None:
    parts = [p for _, p in _record_parts(raw, count, length)]
    return None if parts[0] is None else parts[0] if len(parts) == 1 else np.concatenate(parts)


def _left(part: np.ndarray) -> np.ndarray:
    """The first 16 bits of each record as a number."""
    if part.shape[1] == 16:
        return np.packbits(part, axis=1).view(">u2").ravel().astype(np.uint16)
    head = np.zeros((len(part), 16), np.uint8)
    k = min(16, part.shape[1])
    head[:, :k] = part[:, :k]
    return np.packbits(head).view(">u2").astype(np.uint16)


def _heads(part: np.ndarray, table: Huffman) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length of each record's first bits."""
    value = _left(part).astype(np.int64)
    return table.symbol[value], table.size[value]


# Writing


def _marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _stuffed(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\x00")


def _packed(bits: np.ndarray) -> bytes:
    """Bits as bytes; the last byte is filled with ones."""
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


#: A code for every symbol: 255 of eight bits, one of nine.
ANY_COUNTS = bytes([0] * 7 + [255, 1] + [0] * 7)
ANY_SYMBOLS = bytes(range(256))


def _code(symbol: int) -> tuple[int, int]:
    return (symbol, 8) if symbol < 255 else (0x1FE, 9)


def _value(x: int) -> tuple[int, int]:
    size = abs(x).bit_length()
    return (x if x > 0 else x + (1 << size) - 1, size)


def _toward_zero(x: int, low: int) -> int:
    return x >> low if x >= 0 else -(-x >> low)


def encode(picture: Picture, scans: list[tuple[list[int], int, int, int, int]], interval: int = 0) -> bytes:
    """A progressive file; scans are (component indices, first, last, high, low).  For tests and small pictures."""
    out = [b"\xff\xd8", *(_marker(0xDB, bytes([0x10 | k]) + q.astype(">u2").tobytes()) for k, q in picture.quant.items())]
    out.append(_marker(0xC2, struct.pack(">BHHB", 8, picture.height, picture.width, len(picture.components)) + b"".join(bytes([c.key, c.h << 4 | c.v, c.table]) for c in picture.components)))
    out += [_marker(0xC4, bytes([k << 4]) + ANY_COUNTS + ANY_SYMBOLS) for k in (0, 1)]
    if interval:
        out.append(_marker(0xDD, struct.pack(">H", interval)))
    if picture.comment:
        out.append(_marker(0xFE, picture.comment))
    units = Decoder(b"")
    for which, first, last, high, low in scans:
        chosen = [(picture.components[i], 0, 0) for i in which]
        out.append(_marker(0xDA, bytes([len(chosen)]) + b"".join(bytes([c.key, 0]) for c, _, _ in chosen) + bytes([first, last, high << 4 | low])))
        segments, bits, before = [], [], [0] * len(chosen)
        for at, unit in enumerate(units._units(chosen)):
            if interval and at and at % interval == 0:
                segments.append(bits)
                bits, before = [], [0] * len(chosen)
            for i, _, block in unit:
                block = block.tolist()
                if first == 0 and high:
                    bits.append((block[0] >> low & 1, 1))
                elif first == 0:
                    value, size = _value((block[0] >> low) - before[i])
                    bits += [_code(size), (value, size)]
                    before[i] = block[0] >> low
                elif not high:
                    bits += _first_pass([_toward_zero(x, low) for x in block[first : last + 1]])
                else:
                    bits += _second_pass([_toward_zero(x, low) for x in block[first : last + 1]])
        segments.append(bits)
        for k, segment in enumerate(segments):
            text = "".join(format(v, f"0{n}b") for v, n in segment if n)
            out.append((b"" if not k else bytes([0xFF, 0xD0 + (k - 1) % 8])) + _stuffed(_packed(np.frombuffer(text.encode(), np.uint8) - 48)))
    return b"".join([*out, b"\xff\xd9"])


def _first_pass(band: list[int]) -> list[tuple[int, int]]:
    out, zeros = [], 0
    for x in band:
        if not x:
            zeros += 1
            continue
        while zeros > 15:
            out.append(_code(0xF0))
            zeros -= 16
        value, size = _value(x)
        out += [_code(zeros << 4 | size), (value, size)]
        zeros = 0
    return out + [_code(0)] * (zeros > 0)


def _second_pass(band: list[int]) -> list[tuple[int, int]]:
    """Refinement of one bit: magnitudes over 1 were known before."""
    out, zeros, known = [], 0, []
    final = max((k for k, x in enumerate(band) if abs(x) == 1), default=-1)
    for k, x in enumerate(band):
        if not x and k < final:
            zeros += 1
            if zeros == 16:
                out += [_code(0xF0), *known]
                zeros, known = 0, []
        elif abs(x) == 1:
            out += [_code(zeros << 4 | 1), (int(x > 0), 1), *known]
            zeros, known = 0, []
        elif x:
            known.append((abs(x) & 1, 1))
    if known or final < len(band) - 1:
        out += [_code(0), *known]
    return out


# Bytes as coefficients

#: Units of four blocks (two of luma, one of each chroma component): across, and the most rows of a file.
UNIT, ACROSS, MOST = 4, 128, 8191
#: One-symbol tables and the DC table; in fixed order for every file.
_DC_TABLE = _marker(0xC4, bytes([0x00, 1, 1, *[0] * 14, 10, 9]))
_AC_TABLES = b"".join(_marker(0xC4, bytes([0x10 | k, 1, *[0] * 15, symbol])) for k, symbol in enumerate((0x08, 0x00, 0x09)))
_ONES = _marker(0xDB, bytes([0]) + bytes([1] * 64))
_COLOURS = bytes([1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0])


def _scan_header(components: tuple[int, ...], first: int, last: int, high: int, low: int, table: int = 0) -> bytes:
    return _marker(0xDA, bytes([len(components), *(x for c in components for x in (c, table)), first, last, high << 4 | low]))


def _number_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` (16 at most) bits of each value."""
    return np.unpackbits(values.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, 16 - width :]


def padded(data: bytes) -> bytes:
    """Zeros up to a positive multiple of a block."""
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def _dc(data: np.ndarray) -> np.ndarray:
    return data[:, 0].astype(np.int64) + np.where(np.arange(len(data)) % 2, -768, 512)


def _dc_codes(data: np.ndarray) -> np.ndarray:
    """Eleven bits for each block: the step of the upper bits, in ten bits after a code of one, nine after two for the first."""
    step = np.diff(_dc(data) >> 1, prepend=0)
    size = np.where(np.arange(len(data)) == 0, 9, 10)
    return np.where(step > 0, step, step + (1 << size) - 1) | np.where(size == 9, 2 << 9, 0)


def _band(values: np.ndarray, width: int) -> bytes:
    """A zero (the one code) and ``width`` bits of each value."""
    values, out = values.ravel(), []
    for i in range(0, len(values), PART):
        out.append(_packed(_number_bits(values[i : i + PART], width + 1).ravel()))
    return _stuffed(b"".join(out))


def from_payload(payload: bytes) -> bytes:
    """A progressive colour file whose coefficients are the payload (a positive multiple of 64 bytes)."""
    units = -(-len(payload) // (BLOCK * UNIT))
    across = max(min(units, ACROSS), -(-units // MOST))
    down = -(-units // across)
    units = down * across
    data = np.frombuffer(payload + bytes(units * UNIT * BLOCK - len(payload)), np.uint8).reshape(-1, BLOCK)
    parts = data[: 2 * units], data[2 * units : 3 * units], data[3 * units :]
    deal = lambda xs: np.concatenate([x.reshape(units, -1) for x in xs], axis=1).ravel()
    rest = np.zeros((2 * units, 64), np.uint8)
    rest[:, 1:] = parts[0][:, 1:] & 1
    upper = parts[0] >> 1 | 0x80
    every = (1, 2, 3)
    return b"".join([
        b"\xff\xd8", _marker(0xFE, b"bytes %d" % len(payload)), _ONES, _marker(0xC2, struct.pack(">BHHB", 8, down * 8, across * 16, 3) + _COLOURS), _DC_TABLE, _AC_TABLES,
        _scan_header(every, 0, 0, 0, 1), _stuffed(_packed(_number_bits(deal([_dc_codes(x) for x in parts]), 11).ravel())),
        _scan_header((1,), 1, 5, 0, 1), _band(upper[:, 1:6], 8), _scan_header((2,), 1, 63, 0, 0, 2), _band(parts[1][:, 1:].astype(np.uint16) | 256, 9),
        _scan_header((3,), 1, 63, 0, 0, 2), _band(parts[2][:, 1:].astype(np.uint16) | 256, 9), _scan_header((1,), 6, 63, 0, 1), _band(upper[:, 6:], 8),
        _scan_header(every, 0, 0, 1, 0), _stuffed(_packed(deal([x[:, 0] & 1 for x in parts]))), _scan_header((1,), 1, 63, 1, 0, 1), _stuffed(np.packbits(rest, axis=1).tobytes()), b"\xff\xd9",
    ])


def to_payload(picture: Picture) -> bytes:
    """The bytes that ``from_payload`` stored."""
    if not picture.comment.startswith(b"bytes "):
        raise Broken("not a payload")
    out = []
    for c in picture.components:
        blocks = c.blocks.reshape(-1, BLOCK)
        data = blocks - 256
        data[:, 0] = blocks[:, 0] - np.where(np.arange(len(blocks)) % 2, -768, 512)
        if data.min() < 0 or data.max() > 255:
            raise Broken("not a payload")
        out.append(data.astype(np.uint8).tobytes())
    return b"".join(out)[: int(picture.comment[6:])]


def feature(rgb: np.ndarray) -> str:
    """Size, mean, deviation and entropy of the green samples, and which of 4 x 4 fields are brighter than the mean."""
    grey = np.ascontiguousarray(rgb[:, :, 1])
    count = np.bincount(grey.ravel(), minlength=256).astype(np.float64)
    share = count / count.sum()
    level = np.arange(256)
    mean = float(share @ level)
    deviation = float(np.sqrt(max(share @ (level - mean) ** 2, 0)))
    seen = share[share > 0]
    rows, columns = (np.linspace(0, x, 5).astype(int) for x in grey.shape)
    bright = "".join("1" if grey[a:b, c:d].mean() > mean else "0" for a, b in zip(rows, rows[1:]) for c, d in zip(columns, columns[1:]))
    return f"{rgb.shape[1]}x{rgb.shape[0]} mean={mean:.4f} sd={deviation:.4f} bits={float(-(seen @ np.log2(seen))) + 0.0:.4f} map={int(bright, 2):04x}"


# Columns

_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column("text").cast(pa.binary())
        for i in range(0, batch.num_rows, 64):
            rows = [(d, x or b"") for d, x in zip(batch.column("doc_id").slice(i, 64).to_pylist(), raw.slice(i, 64).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([len(x) for _, x in rows], pa.int64()), pa.array([from_payload(padded(x)) for _, x in rows], pa.binary())], schema=_MEDIA)


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as a media column."""
    return texts(docs).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def store_media(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``store_texts`` as a table in the shared folder: what is read from it comes from stored bytes."""
    path, media = new_path(spark, "media"), store_texts(docs)
    media.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(media.schema).parquet(path)


_READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("rgb_sha256", pa.string())])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, n, media in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media")):
            media = media.as_py()
            picture = Decoder(media).decode()
            payload = to_payload(picture)
            rgb = picture.rgb()
            rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(rgb), hashlib.sha256(rgb).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(_READ)], schema=_READ)


def read_back(media: DataFrame) -> DataFrame:
    """What a media column of ``store_texts`` holds, from its stored bytes."""
    return media.mapInArrow(_read_back, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, rgb_sha256 string")


def tensors(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, height, width, rgb, problem): full-resolution tensors, row by row and three bytes a pixel."""
    schema = pa.schema([("id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary()), ("problem", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw, row = batch.column("media")[i].as_py(), {"id": batch.column("id")[i].as_py(), "problem": "null"}
                if raw is not None:
                    try:
                        rgb = Decoder(raw).decode().rgb()
                        row |= {"height": rgb.shape[0], "width": rgb.shape[1], "rgb": rgb.tobytes(), "problem": None}
                    except (ValueError, struct.error, IndexError, KeyError, StopIteration, AttributeError) as e:
                        row["problem"] = str(e) or type(e).__name__
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(run, "id long, height int, width int, rgb binary, problem string")
