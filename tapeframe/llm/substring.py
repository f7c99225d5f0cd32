"""Removal of repeated passages with a log-structured fingerprint index.

A window is 50 consecutive words of one document.  Its fingerprint is the smallest hash of the 26
25-word grams inside it, so equal windows have equal fingerprints wherever they stand.  A region is a
run of windows with one fingerprint (26 at most, about 13 on average).

The index is a list of immutable runs.  A run has a row for each distinct region: fingerprint, hash of
all its words, smallest and largest document that has it, and 32 more bits of each window's hash.  Runs are
tables with a fixed number of buckets by fingerprint, each bucket one file sorted by fingerprint and
word hash, so runs are merge-joined with each other as they lie, without an exchange or a sort.

A new batch becomes a run of level 0 and is merge-joined with the runs of history on the fingerprint:

* a region whose words stand in a smaller document as a whole is removed by its word hash;
* where one fingerprint has regions with different words, the windows of each distinct region (at every
  place in its smallest document) are compared one by one.

When ``FANOUT`` runs have one level they are merged, with a merge join, into one of the next level; what
they were made of is deleted.  A row is written again once for each level, whose number grows with the
logarithm of the batches.  Texts of history are not read again.

Words are compared by 64-bit hashes; regions by a second 64-bit hash of those and windows by 32 bits of
one, both on top of the 64-bit fingerprint.

Order: a window is removed when it also starts in a document with a smaller doc_id, in history or in
the batch.  A null doc_id counts as larger than all others.  Documents of history are not judged
again.  Null and empty texts have no words; repeated rows are equal documents and get equal results;
rows of one doc_id do not remove each other's words; texts of more than ``bytetext.LONG`` bytes go part
by part; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.functions.tables import Bucketed, discard
from tapeframe.llm import bytetext as B
from tapeframe.llm.common import new_path, stored, texts

WINDOW, GRAM = 50, 25
SPAN = WINDOW - GRAM + 1
FANOUT = 2
#: Bytes of text handled at once: a quarter of what other operators take, as joins leave this one's processes little memory.
SLICE_BYTES = B.SLICE_BYTES >> 2
#: Regions whose windows are made rows at once: up to 4 MB of them.
EXPANDED = 1 << 12
LAST_ID = (1 << 63) - 1

_SPACE = B.word_table("space")
_REGIONS = pa.schema([("doc", pa.int64()), ("k", pa.int64()), ("fp", pa.int64()), ("rh", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("wh", pa.binary())])
REGIONS = "doc long, k long, fp long, rh long, start int, n int, wh binary"
#: Bases of the prefix hashes over word hashes: grams, and regions and windows.
GRAM_BASE, REGION_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Smallest of each ``size`` consecutive values, by prefix and suffix minima of blocks."""
    n = len(x)
    if n < size:
        return x[:0]
    pad = -n % size
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, size)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - size + 1], prefix[size - 1 : n])


def regions_of(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, fingerprint, word hash, first window within the row, windows) of each region, and 32 bits of each of their windows."""
    none = (*(np.zeros(0, np.int64) for _ in range(5)), np.zeros(0, np.uint32))
    if len(hashes) < WINDOW:
        return none
    fingerprint = sliding_min(B.window_hash(hashes, GRAM, GRAM_BASE), SPAN)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(row[: len(fingerprint)] == row[WINDOW - 1 :])
    if not len(at):
        return none
    value, owner = fingerprint[at], row[at]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])
    begins = np.flatnonzero(new)
    length = np.diff(np.append(begins, len(at)))
    # Regions of repetitive text are cut so that none has more windows than a fingerprint can cover.
    pieces = -(-length // SPAN)
    offset = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begins = np.repeat(begins, pieces) + offset * SPAN
    length = np.minimum(np.repeat(length, pieces) - offset * SPAN, SPAN)
    start = at[begins]
    power, inverse = B.powers(REGION_BASE, len(hashes) + 1)
    prefix = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=prefix[1:])
    words = B.mix((prefix[start + length + WINDOW - 1] - prefix[start]) * inverse[start] + length.astype(np.uint64))
    windows = (B.window_hash(hashes, WINDOW, REGION_BASE)[at] >> np.uint64(32)).astype(np.uint32)
    return owner[begins], value[begins], words, start - first[owner[begins]], length, windows


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[np.ndarray, B.Words, int]]]]:
    """Row ranges of a batch with (bytes, words, words before); a long row comes in parts that share WINDOW - 1 words."""
    _, offsets = B.column(batch.column("text"))
    for i, j in B.row_slices(offsets, SLICE_BYTES):
        part = batch.slice(i, j - i)
        data, own = B.column(part.column("text"))
        yield part, B.pieces(data, _SPACE, SLICE_BYTES, WINDOW - 1) if len(data) > B.LONG else iter([(data, B.find_words(data, own, _SPACE), 0)])


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, pieces in _slices(batch):
            for data, words, before in pieces:
                row, fp, rh, start, n, windows = regions_of(B.span_hash(data, words.start, words.end), words.first)
                doc, k = (part.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc", "k"))
                columns = (doc, k, fp.view(np.int64), rh.view(np.int64), (start + before).astype(np.int32), n.astype(np.int32))
                ends = np.concatenate([[0], np.cumsum(n * 4)]).astype(np.int32)
                wh = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(windows.tobytes())])
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), wh], schema=_REGIONS)


RUN = "fp long, rh long, doc long, last long, wh binary"


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each region of a batch once, with its smallest and largest document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        fp, rh, doc = (batch.column(c).to_numpy() for c in ("fp", "rh", "doc"))
        order = np.lexsort((doc, rh, fp))
        new = np.flatnonzero(np.concatenate([[True], (fp[order][1:] != fp[order][:-1]) | (rh[order][1:] != rh[order][:-1])]))
        low, high = order[new], order[np.append(new[1:], len(order)) - 1]
        yield pa.RecordBatch.from_arrays([pa.array(fp[low]), pa.array(rh[low]), pa.array(doc[low]), pa.array(doc[high]), batch.column("wh").take(pa.array(low))], names=["fp", "rh", "doc", "last", "wh"])


def _windows(columns: dict[str, pa.DataType]):
    """A row for each window of the regions: the other columns, its bits ``w``, and its place ``at`` after ``start``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, EXPANDED):
                part = batch.slice(i, EXPANDED)
                data, offsets = B.column(part.column("wh"))
                size = np.diff(offsets) // 4
                row = np.repeat(np.arange(part.num_rows), size)
                at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                own = [part.column(c).take(pa.array(row)) for c in columns]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.frombuffer(data.tobytes(), np.int32)), pa.array(at.astype(np.int32))], names=[*columns, "w", "at"])

    return run


def _removed(part: pa.RecordBatch, pieces) -> Iterator[tuple[np.ndarray, B.Words, int, np.ndarray]]:
    """(bytes, words, words before, which of the words are removed) of what ``_slices`` yields; repeated words come once."""
    begins, ends = part.column("begins"), part.column("ends")
    row = np.repeat(np.arange(part.num_rows), np.diff(begins.offsets.to_numpy()))
    begin, end = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (begins, ends))
    seen = 0
    for data, words, before in pieces:
        size = np.diff(words.first)[row]
        a, b = np.clip(begin - before, 0, size), np.clip(end - before, 0, size)
        delta = np.zeros(len(words.start) + 1, np.int32)
        np.add.at(delta, words.first[row] + a, 1)
        np.add.at(delta, words.first[row] + b, -1)
        gone = np.cumsum(delta[:-1]) > 0
        skip = max(seen - before, 0)
        if skip:
            words = B.Words(words.data, words.start[skip:], words.end[skip:], np.array([0, len(words.start) - skip]))
            gone, before = gone[skip:], before + skip
        yield data, words, before, gone
        seen = before + len(words.start)


def _joined(data: np.ndarray, words: B.Words, keep: np.ndarray) -> bytes:
    return b" ".join([data[s:e].tobytes() for s, e in zip(words.start[keep].tolist(), words.end[keep].tolist())])


def _results(batches: Iterator[pa.RecordBatch], take) -> Iterator[pa.RecordBatch]:
    """For each slice what ``take`` makes of its rows: (row, words, removed, place of its first word, bytes of kept words) in parts."""
    for batch in batches:
        for part, pieces in _slices(batch):
            rows = [[i, 0, 0, take()] for i in part.column("doc_id").to_pylist()]
            for data, words, before, gone in _removed(part, pieces):
                for i, r in enumerate(rows):
                    a, b = words.first[i], words.first[i + 1]
                    mask = gone[a:b]
                    r[1], r[2] = r[1] + int(b - a), r[2] + int(mask.sum())
                    r[3].add(_joined(data, words, np.flatnonzero(~mask) + a), mask, before)
            yield rows


class _Text:
    """Kept words, and the ranges of removed ones."""

    def __init__(self) -> None:
        self.parts: list[bytes] = []
        self.begins: list[int] = []
        self.ends: list[int] = []

    def add(self, kept: bytes, mask: np.ndarray, before: int) -> None:
        if kept:
            self.parts.append(kept)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))) + before
        begins, ends = edges[::2].tolist(), edges[1::2].tolist()
        if begins and self.ends and self.ends[-1] == begins[0]:
            self.ends.pop()
            begins = begins[1:]
        self.begins += begins
        self.ends += ends


class _Hash:
    """Only the hash of the kept words, for results that do not need them."""

    def __init__(self) -> None:
        self.hash, self.any = hashlib.sha256(), False

    def add(self, kept: bytes, mask: np.ndarray, before: int) -> None:
        if kept:
            if self.any:
                self.hash.update(b" ")
            self.hash.update(kept)
            self.any = True


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("removed_starts", pa.list_(pa.int32())), ("removed_ends", pa.list_(pa.int32()))])
    for rows in _results(batches, _Text):
        out = [(*r[:3], b" ".join(r[3].parts).decode(), r[3].begins, r[3].ends) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], schema.field(c).type) for c in range(6)], schema=schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    for rows in _results(batches, _Hash):
        out = [(*r[:3], r[3].hash.hexdigest()) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], schema.field(c).type) for c in range(4)], schema=schema)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, the id that orders documents, and a hash of the text: what a row's result depends on."""
    return texts(docs).select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc"), F.xxhash64("text").alias("k"))


class FingerprintIndex:
    """Runs of the distinct regions of all documents added so far."""

    def __init__(self, spark: SparkSession, buckets: int | None = None) -> None:
        self.spark, self.runs = spark, []  # (level, run)
        #: The same for all runs ever made; ``spark.sql.shuffle.partitions`` when the index begins, if not given.
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _append(self, regions: DataFrame) -> Bucketed:
        """Write a batch's run.  Regions are made distinct before and after they are dealt, so a frequent one sends few rows."""
        rows = regions.select("fp", "rh", "doc", "wh").mapInArrow(_distinct, RUN).repartition(self.buckets, "fp")
        rows = rows.groupBy("fp", "rh").agg(F.min("doc").alias("doc"), F.max("last").alias("last"), F.first("wh").alias("wh"))
        run = Bucketed(self.spark, rows, "run", ["fp", "rh"], self.buckets, dealt=True)
        self.runs.append((0, run))
        return run

    def compact(self) -> None:
        """While ``FANOUT`` runs have one level, merge them into one of the next."""
        while True:
            level, same = next(((lv, own) for lv, _ in self.runs if len(own := [r for x, r in self.runs if x == lv]) >= FANOUT), (0, []))
            if not same:
                return
            rows = same[0].read()
            for r in same[1:]:
                other = r.read().select("fp", "rh", *(F.col(c).alias(f"{c}2") for c in ("doc", "last", "wh")))
                rows = rows.hint("merge").join(other, ["fp", "rh"], "full").select("fp", "rh", F.least("doc", "doc2").alias("doc"), F.greatest("last", "last2").alias("last"), F.coalesce("wh", "wh2").alias("wh"))
            merged = Bucketed(self.spark, rows, "run", ["fp", "rh"], self.buckets, dealt=True)
            self.runs = [(lv, r) for lv, r in self.runs if lv != level] + [(level + 1, merged)]
            for r in same:
                r.drop()

    def repeats(self, batch: DataFrame) -> DataFrame:
        """Add a batch; (doc, k, begins, ends): word ranges of its documents that stand in smaller ones."""
        path = new_path(self.spark, "regions")
        keyed(batch).select("doc", "k", "text").mapInArrow(_regions, REGIONS).write.parquet(path)
        places = self.spark.read.schema(REGIONS).parquet(path)
        old = [run for _, run in self.runs]
        mine = self._append(places).read()
        history = [run.read().hint("merge").join(mine.select("fp"), "fp", "left_semi") for run in old]
        ranges = lambda start, n: (F.col(start).alias("begin"), (F.col(start) + n + (WINDOW - 1)).alias("end"))
        # Fingerprints of more than one document, one of them new.
        # Stored, like all small sides here: a join of two exchanges lets Spark split the frequent fingerprints.
        short = mine.select("fp", "rh", "doc", F.col("last").alias("fresh"))
        for h in history:
            short = short.unionByName(h.select("fp", "rh", "doc", F.lit(None).cast("long").alias("fresh")))
        shared = short.groupBy("fp").agg(F.min("doc").alias("owner"), F.max("fresh").alias("last"), (F.min("rh") != F.max("rh")).alias("varies")).where("owner < last")
        shared = stored(self.spark, shared.select("fp", "owner", "varies"), "owners")
        found = stored(self.spark, places.hint("merge").join(shared, "fp"), "shared")
        whole = found.where("not varies and doc > owner").select("doc", "k", *ranges("start", F.col("n")))
        # Of each distinct region the smallest document stands for all; any larger one loses it whole.  What a
        # region's smallest document holds of it is judged window by window, at every place and in each of its rows.
        varied = shared.where("varies").select("fp")
        distinct = mine.select("fp", "rh", "doc", "wh")
        for h in history:
            distinct = distinct.unionByName(h.select("fp", "rh", "doc", "wh"))
        distinct = stored(self.spark, distinct.join(varied, "fp"), "distinct")
        first = stored(self.spark, distinct.groupBy("fp", "rh").agg(F.min("doc").alias("first")), "owners")
        met = found.where("varies").drop("owner", "varies").hint("merge").join(first, ["fp", "rh"])
        owned = met.where("doc > first").select("doc", "k", *ranges("start", F.col("n")))
        windows = distinct.select("fp", "doc", "wh").mapInArrow(_windows({"fp": pa.int64(), "doc": pa.int64()}), "fp long, doc long, w int, at int")
        earlier = windows.groupBy("fp", "w").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).where("owner < last").select("fp", "w", "owner")
        earlier = stored(self.spark, earlier, "owners")
        own = met.where("doc = first").select("fp", "doc", "k", "start", "wh").join(earlier.select("fp").distinct(), "fp", "left_semi")
        each = own.mapInArrow(_windows(dict.fromkeys(("fp", "doc", "k", "start"))), "fp long, doc long, k long, start int, w int, at int")
        single = each.hint("merge").join(earlier, ["fp", "w"]).where("doc > owner").select("doc", "k", (F.col("start") + F.col("at")).alias("begin")).select("doc", "k", *ranges("begin", F.lit(1)))
        # Rows that agree in id and text have the same spans: each is kept once.
        spans = whole.unionByName(owned).unionByName(single).distinct()
        spans = spans.groupBy("doc", "k").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("s")).select("doc", "k", F.col("s.begin").alias("begins"), F.col("s.end").alias("ends"))
        out = stored(self.spark, spans, "spans")
        discard(self.spark, path)
        self.compact()
        return out


def without_repeats(batch: DataFrame, repeats: DataFrame, digest: bool = False) -> DataFrame:
    """Rows of the batch with their kept words and removed word ranges (or only the hash of the former)."""
    empty: Column = F.expr("cast(array() as array<int>)")
    rows = keyed(batch).join(repeats, ["doc", "k"], "left").select("doc_id", "text", F.coalesce("begins", empty).alias("begins"), F.coalesce("ends", empty).alias("ends"))
    if digest:
        return rows.mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return rows.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string, removed_starts array<int>, removed_ends array<int>")


def dedup(spark: SparkSession, docs: DataFrame, batches: int = 3, digest: bool = True) -> DataFrame:
    """Take ``docs`` into an empty index in ``batches`` ranges of ascending doc_id; the ranges give the same result as one."""
    index, ids = FingerprintIndex(spark), texts(docs)
    order = F.coalesce("doc_id", F.lit(LAST_ID))
    low, high = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
    cuts = sorted({low + (high - low + 1) * i // batches for i in range(1, batches)}) if low is not None else []
    out = None
    for a, b in zip([None, *cuts], [*cuts, None]):
        batch = ids
        batch = batch.where(order >= a) if a is not None else batch
        batch = batch.where(order < b) if b is not None else batch
        part = without_repeats(batch, index.repeats(batch), digest)
        out = part if out is None else out.unionByName(part)
    return out
