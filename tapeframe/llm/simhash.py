"""SimHash fingerprints, and near-duplicate components with BK-trees.

A fingerprint is 64 bits over 3-word shingles; texts link when two bits or fewer differ.  Equal
fingerprints are one vertex from the start.  Two fingerprints that differ in two bits agree on two of
four 16-bit blocks at least, so each is sent to six shards, one for each pair of blocks, and linked
texts meet in a shard.  Shards of more than ``SHARD`` fingerprints are split once more by pairs of
the 8-bit blocks of the other 32 bits; such a part has 2**16 fingerprints at most.

A shard is a BK-tree: a child hangs below its parent under the integer Hamming distance between
them, and a search follows only edges whose distance is within the radius of the query's distance to
the node.  All trees of a task are built and searched together, level by level, in numpy.  A shard
yields no pairs but a star for each component inside it, so its output is at most its input.  Stars
are joined to components with alternating large-star and small-star steps, checkpointed each round.

A tree goes to its shard's task with the shard's rows, not to all tasks by broadcast: trees of all
documents have no size bound, and a broadcast would pass every fingerprint through the driver.

Groups for filtering (``similar_groups``) go further than two bits: SimHash over the distinct words of a
text proposes pairs within six bits, by the same trees; a second SimHash over its shingles screens them;
and a pair is linked if its five-word shingles have a Jaccard similarity of 0.8 or more.  First a forest
that holds together all proposed pairs is decided.  Where every pair of a tree is similar nothing is left
to do; in the other trees all proposed pairs between different groups are decided too, portion by portion.

Defined cases: null and empty texts have fingerprint zero and link with each other; a text of one or
two words is one shingle; repeated rows each give a row; a null doc_id has a component like any other
row, and is the smallest id only of nothing (the component_id is null where all ids are); an empty
table gives an empty result; texts of more than ``bytetext.LONG`` bytes go part by part.  Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.llm import bytetext as B
from tapeframe.llm.common import lean, stored, texts

SHINGLE, RADIUS, SEED = 3, 2, 42
SHARD = 4096
#: Pairs of a query and a node that are looked at together.
FRONTIER = 1 << 20

_SPACE = B.word_table("space")


# Fingerprints


def shingle_hashes(data: np.ndarray, words: B.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle, index of each row's first shingle)."""
    length = words.end - words.start
    after = np.cumsum(length + 1)
    begin = after - length - 1
    joined = np.full(int(after[-1]) if len(after) else 0, 0x20, np.uint8)
    shift = np.repeat(words.start - begin, length)
    place = np.arange(len(shift)) + np.repeat(np.arange(len(length)), length)
    joined[place] = data[place + shift]
    count = np.diff(words.first)
    per_row = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(per_row)])
    row = np.repeat(np.arange(len(count)), per_row)
    head = words.first[row] + np.arange(first[-1]) - first[row]
    last = np.minimum(head + size, words.first[row + 1]) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(begin[head].tolist(), (begin[last] + length[last]).tolist())), np.uint64, len(head))
    return hashes, first


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit values whose bits are set in over half of each row's hashes."""
    n = len(first) - 1
    sums = np.zeros((n, 64), np.int64)
    size = np.diff(first)
    full = np.flatnonzero(size)
    if len(full):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums[full] = np.add.reduceat(bits, first[full], axis=0, dtype=np.int32)
    return np.packbits(sums * 2 > size[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, the highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def _of_bits(counts: np.ndarray, n: int) -> np.uint64:
    return np.packbits(counts * 2 > n).view(">u8").astype(np.uint64)[0]


def long_fingerprint(data: np.ndarray) -> np.uint64:
    """The fingerprint of one long text, part by part."""
    counts, n, few = np.zeros(64, np.int64), 0, np.zeros(0, np.uint64)
    for part, words, _ in B.pieces(data, _SPACE, overlap=SHINGLE - 1):
        hashes, _ = shingle_hashes(B.lower_ascii(part), words)
        if len(words.start) < SHINGLE:
            few = hashes  # all words so far, or only repeated ones
        else:
            counts, n = counts + bit_counts(hashes), n + len(hashes)
    return _of_bits(counts, n) if n else _of_bits(bit_counts(few), len(few))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        _, offsets = B.column(text)
        out = [np.zeros(0, np.uint64)]
        for i, j in B.row_slices(offsets):
            data, own = B.column(text.slice(i, j - i))
            if len(data) > B.LONG:
                out.append(np.array([long_fingerprint(data)], np.uint64))
                continue
            data = B.lower_ascii(data)
            out.append(majority(*shingle_hashes(data, B.find_words(data, own, _SPACE))))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), *(batch.column(c) for c in batch.schema.names if c != "text")], names=["fp", *(c for c in batch.schema.names if c != "text")])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(fp, doc_id) of every row."""
    return texts(docs).select("text", "doc_id").mapInArrow(lean(_fingerprints), "fp long, doc_id long")


# BK-trees


class Forest:
    """A BK-tree for each group; ``group`` must be sorted, and a group's values distinct."""

    def __init__(self, group: np.ndarray, value: np.ndarray) -> None:
        n = len(value)
        self.value = value
        new = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.zeros(0, bool)
        self.root = np.flatnonzero(new)[np.cumsum(new) - 1] if n else np.zeros(0, np.int64)
        keys, nodes = [], []
        waiting = np.flatnonzero(~new)
        parent = self.root[waiting]
        while len(waiting):
            edge = parent * 65 + np.bitwise_count(value[waiting] ^ value[parent])
            order = np.argsort(edge, kind="stable")
            waiting, edge = waiting[order], edge[order]
            lead = np.concatenate([[True], edge[1:] != edge[:-1]])
            child = waiting[lead]
            keys.append(edge[lead])
            nodes.append(child)
            parent = child[np.cumsum(lead) - 1][~lead]
            waiting = waiting[~lead]
        key = np.concatenate([np.zeros(0, np.int64), *keys])
        order = np.argsort(key)
        self.key, self.node = key[order], np.concatenate([np.zeros(0, np.int64), *nodes])[order]

    def within(self, query: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, other item of its group within the radius), in parts; ``query`` names items."""
        stack = [(query[i : i + FRONTIER], self.root[query[i : i + FRONTIER]]) for i in range(0, len(query), FRONTIER)]
        while stack:
            item, node = stack.pop()
            distance = np.bitwise_count(self.value[item] ^ self.value[node]).astype(np.int64)
            near = distance <= radius
            yield item[near], node[near]
            low = np.searchsorted(self.key, node * 65 + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.key, node * 65 + np.minimum(distance + radius, 64), "right")
            size = high - low
            at = np.cumsum(size)
            start = 0
            while start < len(size):
                stop = max(start + 1, int(np.searchsorted(at, (at[start - 1] if start else 0) + FRONTIER, "right")))
                own = size[start:stop]
                if own.any():
                    first = np.repeat(low[start:stop] - (np.cumsum(own) - own), own)
                    stack.append((np.repeat(item[start:stop], own), self.node[first + np.arange(own.sum())]))
                start = stop


def smallest_reachable(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For items 0..n-1, the smallest item of each one's component."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                break
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    return label


def stars(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, centre) for each value that links with another of its group."""
    label = smallest_reachable(len(value), Forest(group, value).within(np.arange(len(value))))
    linked = np.flatnonzero(label != np.arange(len(value)))
    return value[linked], value[label[linked]]


_STARS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the shards; rows come sorted by shard, and a shard may go on in the next batch."""
    shard, rest = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)

    def answer(shard: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.concatenate([[0], (shard[1:] != shard[:-1]).any(axis=1)])) if len(shard) else np.zeros(0, np.int64)
        a, b = stars(group, value)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=_STARS)

    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([batch.column(c).to_numpy() for c in ("shard", "part")], axis=1)
        shard, rest = np.concatenate([shard, own]), np.concatenate([rest, batch.column("fp").to_numpy().view(np.uint64)])
        cut = int(np.flatnonzero((shard != shard[-1]).any(axis=1))[-1]) + 1 if (shard != shard[-1]).any() else 0
        if cut:
            yield answer(shard[:cut], rest[:cut])
            shard, rest = shard[cut:], rest[cut:]
    if len(rest):
        yield answer(shard, rest)


def _block_keys(value: str, width: int, shift: int = 0) -> str:
    """SQL array of the six keys that pairs of four ``width``-bit blocks of ``value`` make."""
    block = lambda i: f"(shiftrightunsigned({value}, {shift + i * width}) & {(1 << width) - 1}L)"
    pairs = [f"{k}L * {1 << (2 * width)}L + {block(i)} * {1 << width}L + {block(j)}" for k, (i, j) in enumerate(combinations(range(4), 2))]
    return f"array({', '.join(pairs)})"


def _rest_of(shard: str) -> str:
    """SQL for the 32 bits of fp that are not in the shard's key (which pair of blocks it is stands above them)."""
    block = lambda i: f"(shiftrightunsigned(fp, {16 * i}) & 65535L)"
    cases = []
    for k, pair in enumerate(combinations(range(4), 2)):
        i, j = (x for x in range(4) if x not in pair)
        cases.append(f"when {k} then {block(i)} * 65536L + {block(j)}")
    return f"case shiftright({shard}, 32) {' '.join(cases)} end"


def links(spark: SparkSession, values: DataFrame) -> DataFrame:
    """Stars (a, b) that connect the distinct fingerprints ``fp`` within the radius."""
    dealt = values.select(F.explode(F.expr(_block_keys("fp", 16))).alias("shard"), "fp")
    sizes = dealt.groupBy("shard").count().where("count > 1")
    met = dealt.join(sizes, "shard")
    small = met.where(F.col("count") <= SHARD).select("shard", F.lit(-1).cast("long").alias("part"), "fp")
    large = met.where(F.col("count") > SHARD).selectExpr("shard", "fp", f"{_rest_of('shard')} as rest")
    large = large.select("shard", F.explode(F.expr(_block_keys("rest", 8))).alias("part"), "fp")
    dealt_again = small.unionByName(large).repartition("shard", "part").sortWithinPartitions("shard", "part", "fp")
    return stored(spark, dealt_again.mapInArrow(lean(_link), "a long, b long").distinct(), "links")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(a, b): each vertex and the smallest vertex of its component, by large-star and small-star steps."""
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        edges = stored(spark, small, "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges
        before = now


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed 64 bits) and component_id of every row."""
    rows = stored(spark, fingerprints(docs), "fingerprints")
    values = rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    centre = components(spark, links(spark, values.select("fp"))).select(F.col("a").alias("fp"), F.col("b").alias("centre"))
    of = values.join(centre, "fp", "left").select("fp", "doc_id", F.coalesce("centre", "fp").alias("centre"))
    of = stored(spark, of, "vertices")
    least = of.groupBy("centre").agg(F.min("doc_id").alias("component_id"))
    classes = of.join(least, "centre").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


# Groups of similar texts: SimHash proposes, five-word shingles decide

NEAR_RADIUS, COMPARED, SIMILAR = 6, 5, 0.8
#: SimHashes of 128 bits over the shingle sets of two similar texts differ in 19 bits on average (24 where there are
#: only a few shingles), with a deviation of 4; those of unrelated texts in 64.  Pairs beyond this are not compared.
SCREEN = 44
#: Bytes of a long text whose distinct shingles are held at once; a longer text is gone over several times.
HELD = 64 << 20

_VERTEX = ("shard", "part", "fp", "s1", "s2", "n", "t", "centre")


def _sequence_hash(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each row's words in order."""
    power, inverse = B.powers(B.BYTE_BASE, len(hashes) + 1)
    prefix = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=prefix[1:])
    return B.mix((prefix[first[1:]] - prefix[first[:-1]]) * inverse[first[:-1]] + np.diff(first).astype(np.uint64))


def _shingle_parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the five-word shingles of one long text (of all its words, if they are fewer)."""
    few, several = np.zeros(0, np.uint64), False
    for part, words, _ in B.pieces(data, _SPACE, overlap=COMPARED - 1):
        part = B.lower_ascii(part)
        hashes = B.span_hash(part, words.start, words.end)
        if len(hashes) >= COMPARED:
            several = True
            yield B.window_hash(hashes, COMPARED)
        elif len(hashes):
            few = B.window_hash(hashes, len(hashes))
    if not several:
        yield few


def _word_parts(data: np.ndarray) -> Iterator[np.ndarray]:
    for part, words, _ in B.pieces(data, _SPACE):
        part = B.lower_ascii(part)
        yield B.span_hash(part, words.start, words.end)


def _distinct_parts(parts, data: np.ndarray) -> Iterator[np.ndarray]:
    """Distinct values of what ``parts`` yields for one long text, in portions of bounded size."""
    turns = 1 + len(data) // HELD
    for turn in range(turns):
        own = [h if turns == 1 else h[h % np.uint64(turns) == turn] for h in parts(data)]
        yield np.unique(np.concatenate([np.zeros(0, np.uint64), *own]))


def _shingles(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes of short rows, index of each row's first one)."""
    out = []
    size = np.diff(first)
    wide = B.window_hash(hashes, COMPARED)
    row = np.repeat(np.arange(len(size)), size)
    inside = row[: len(wide)] == row[COMPARED - 1 :] if len(wide) else np.zeros(0, bool)
    few = np.flatnonzero((size > 0) & (size < COMPARED))
    out = [B.window_hash(hashes[first[r] : first[r + 1]], int(size[r])) for r in few.tolist()]
    owner = np.concatenate([row[: len(wide)][inside], few])
    values = np.concatenate([wide[inside], *out])
    order = np.argsort(owner, kind="stable")
    return values[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(size)))]).astype(np.int64)


_SECOND = np.uint64(0x8CB92BA72F3D8DD7)
_WORDS = pa.schema([(c, pa.int64()) for c in ("fp", "s1", "s2", "n", "t")])


def _described(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Of each text: SimHash over its distinct words, two over its distinct shingles, their number, and a hash of its words in order."""
    if len(data) > B.LONG:
        total, seen, counts, n = 0, 0, np.zeros((3, 64), np.int64), [0, 0]
        for h in _word_parts(data):
            power, _ = B.powers(B.BYTE_BASE, len(h) + 1)
            total += int((h * power[: len(h)]).sum(dtype=np.uint64)) * pow(B.BYTE_BASE, seen, 1 << 64)
            seen += len(h)
        for h in _distinct_parts(_word_parts, data):
            counts[0], n[0] = counts[0] + bit_counts(h), n[0] + len(h)
        for h in _distinct_parts(_shingle_parts, data):
            counts[1], counts[2], n[1] = counts[1] + bit_counts(h), counts[2] + bit_counts(B.mix(h ^ _SECOND)), n[1] + len(h)
        t = B.mix(np.array([(total + seen) & 0xFFFFFFFFFFFFFFFF], np.uint64))
        return [np.array([_of_bits(counts[0], n[0])]), np.array([_of_bits(counts[1], n[1])]), np.array([_of_bits(counts[2], n[1])]), np.array([n[1]], np.uint64), t]
    data = B.lower_ascii(data)
    words = B.find_words(data, offsets, _SPACE)
    hashes = B.span_hash(data, words.start, words.end)
    sets, first = distinct(*_shingles(hashes, words.first))
    return [majority(*distinct(hashes, words.first)), majority(sets, first), majority(B.mix(sets ^ _SECOND), first), np.diff(first).astype(np.uint64), _sequence_hash(hashes, words.first)]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        _, offsets = B.column(text)
        for i, j in B.row_slices(offsets):
            columns = [pa.array(c.view(np.int64)) for c in _described(*B.column(text.slice(i, j - i)))]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c).slice(i, j - i) for c in ("doc_id", "k1", "k2"))], names=[*_WORDS.names, "doc_id", "k1", "k2"])


def distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's hashes once, in order, and the index of each row's first one."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, row))
    hashes = hashes[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])]) if len(hashes) else np.zeros(0, bool)
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(first) - 1))]).astype(np.int64)


_PAIRS_OF_BLOCKS = list(combinations(range(8), 2))


def _rest_masks() -> list[list[int]]:
    """For each pair of 8-bit blocks, seven masks that share out the other 48 bits."""
    out = []
    for pair in _PAIRS_OF_BLOCKS:
        bits = [8 * b + i for b in range(8) if b not in pair for i in range(8)]
        masks = [sum(1 << b for b in bits[k::7]) for k in range(7)]
        out.append([m - (1 << 64) if m >> 63 else m for m in masks])
    return out


def shards_of(fp: str) -> Column:
    """The 28 shards of a fingerprint, one for each pair of its 8-bit blocks; which pair it is stands above 16 bits."""
    block = lambda i: f"(shiftrightunsigned({fp}, {8 * i}) & 255L)"
    keys = ", ".join(f"{k}L * 65536L + {block(i)} * 256L + {block(j)}" for k, (i, j) in enumerate(_PAIRS_OF_BLOCKS))
    return F.expr(f"array({keys})")


def dealt(vertices: DataFrame) -> DataFrame:
    """(shard, part, fp, ...) for a search within NEAR_RADIUS, sorted.

    Of eight 8-bit blocks two agree at least, so a fingerprint goes to the shards of its 28 pairs of blocks.  Where
    more than ``SHARD`` meet they are dealt again: of seven portions of the other 48 bits one agrees at least.
    """
    rows = vertices.select(F.explode(shards_of("fp")).alias("shard"), *_VERTEX[2:])
    # At most 28 * 65,536 shards there are, whatever the input.
    large = rows.groupBy("shard").count().where(F.col("count") > SHARD).select("shard", F.lit(True).alias("large"))
    masks = F.array(*(F.array(*(F.lit(m).cast("long") for m in row)) for row in _rest_masks()))
    parts = F.transform(F.get(masks, F.shiftright("shard", 16).cast("int")), lambda m, k: F.xxhash64(k, F.col("fp").bitwiseAND(m)))
    met = rows.join(F.broadcast(large), "shard", "left")
    both = met.withColumn("part", F.explode(F.when(F.col("large"), parts).otherwise(F.array(F.lit(0).cast("long"))))).select(*_VERTEX)
    return both.repartition("shard", "part").sortWithinPartitions("shard", "part", "fp", "centre", "s1", "s2")


def _ends(new: np.ndarray, n: int) -> np.ndarray:
    return np.append(np.flatnonzero(new) + 1, n)


def proposed(group: np.ndarray, fp: np.ndarray, s1: np.ndarray, s2: np.ndarray, size: np.ndarray, centre: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (sorted by group, fp, centre) of one group and of different centres that may be similar, in parts.

    They are within NEAR_RADIUS and SCREEN, and their numbers of shingles do not rule similarity out.
    """
    n = len(fp)
    changes = (group[1:] != group[:-1]) | (fp[1:] != fp[:-1])
    last = _ends(changes, n)
    first = np.concatenate([[0], last[:-1]])
    runs = _ends(changes | (centre[1:] != centre[:-1]), n)
    run_end = np.repeat(runs, np.diff(runs, prepend=0))
    alone = run_end[first] == last  # fingerprints whose rows are of one centre
    value = fp[first]
    for a, b in Forest(group[first], value).within(np.arange(len(value)), NEAR_RADIUS):
        keep = (a < b) | ((a == b) & ~alone[a])
        keep &= ~(alone[a] & alone[b] & (centre[first[a]] == centre[first[b]])) | (a == b)
        a, b = a[keep], b[keep]
        rows = last[a] - first[a]
        i = np.repeat(first[a], rows) + np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
        a, b = np.repeat(a, rows), np.repeat(b, rows)
        begin = np.where(a == b, run_end[i], first[b])
        many = last[b] - begin
        upto, start = np.cumsum(many), 0
        while start < len(i):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + FRONTIER, "right")))
            own = many[start:stop]
            x = np.repeat(i[start:stop], own)
            y = np.repeat(begin[start:stop] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            low, high = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
            keep = (centre[x] != centre[y]) & (low >= SIMILAR * high)
            x, y = x[keep], y[keep]
            far = np.bitwise_count(s1[x] ^ s1[y]).astype(np.int64) + np.bitwise_count(s2[x] ^ s2[y])
            yield x[far <= SCREEN], y[far <= SCREEN]
            start = stop


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the pairs those that connect all which are connected, each of them joining two parts."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                break
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            high, take = np.unique(np.maximum(x, y), return_index=True)
            yield a[take], b[take]
            label[high] = np.minimum(x, y)[take]
            while (label[label] != label).any():
                label = label[label]


def spanning(group: np.ndarray, fp: np.ndarray, s1: np.ndarray, s2: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (sorted by group, fp, s1, s2) that connect all which may be similar: a forest.

    Rows with the same fingerprint and SimHashes are a chain; the first of them stands for it in the search.
    """
    n = len(fp)
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (fp[1:] != fp[:-1]) | (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]) | (size[1:] != size[:-1])])
    yield np.flatnonzero(~new) - 1, np.flatnonzero(~new)
    head = np.flatnonzero(new)
    for a, b in forest(proposed(group[head], fp[head], s1[head], s2[head], size[head], np.arange(len(head))), len(head)):
        yield head[a], head[b]


def _met(answer, names: tuple[str, ...]):
    """Run ``answer`` over whole parts; rows come sorted, and a part may go on in the next batch."""

    def whole(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        change = (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])
        alone = np.concatenate([[True], change, [True]]) if len(held[0]) else np.ones(1, bool)
        several = ~(alone[:-1] & alone[1:]) if len(held[0]) else np.zeros(0, bool)
        if several.any():
            held = [h[several] for h in held]
            change = (held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])
            row = dict(zip(_VERTEX, held))
            unsigned = (row[c].view(np.uint64) for c in ("fp", "s1", "s2"))
            for a, b in answer(np.concatenate([[0], np.cumsum(change)]), *unsigned, row["n"], row["centre"]):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row["t"][a], row["t"][b], row["centre"][a], row["centre"][b])][: len(names)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in _VERTEX]
        for batch in batches:
            if batch.num_rows:
                held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, _VERTEX)]
                other = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
                if len(other):
                    cut = int(other[-1]) + 1
                    yield from whole([h[:cut] for h in held])
                    held = [h[cut:] for h in held]
        yield from whole(held)

    return run


def spanning_pairs(spark: SparkSession, vertices: DataFrame) -> DataFrame:
    """(a, b): pairs of texts that connect all which may be similar, from (fp, s1, s2, n, t)."""
    answer = lambda group, fp, s1, s2, n, _: spanning(group, fp, s1, s2, n)
    rows = dealt(vertices.withColumn("centre", F.lit(0).cast("long")))
    pairs = rows.mapInArrow(lean(_met(answer, ("a", "b"))), "a long, b long")
    return stored(spark, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near")


#: Texts, and bytes of shingles, of a portion of a tree that is compared with the others.
PORTION, PORTION_BYTES = 512, 16 << 20

_LINKED = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of shingles, in order, have a similarity of SIMILAR."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILAR * (len(x) + len(y) - both)


def _linked(table: pa.Table) -> pa.Table:
    """(a, b): centres that similar texts of two portions of a tree link; each link joins two parts."""
    fp, s1, s2 = (table.column(c).to_numpy().view(np.uint64) for c in ("fp", "s1", "s2"))
    n, portion = (table.column(c).to_numpy() for c in ("n", "portion"))
    names, label = np.unique(table.column("centre").to_numpy(), return_inverse=True)
    both = table.column("i")[0].as_py() != table.column("j")[0].as_py()
    sets = [np.frombuffer(x.as_buffer(), np.uint32) for c in table.column("s").chunks for x in c]
    part, out = np.arange(len(names)), []
    for k in range(len(fp)):
        near = np.bitwise_count(fp[k + 1 :] ^ fp[k]) <= NEAR_RADIUS
        near &= np.bitwise_count(s1[k + 1 :] ^ s1[k]).astype(np.int64) + np.bitwise_count(s2[k + 1 :] ^ s2[k]) <= SCREEN
        near &= np.minimum(n[k + 1 :], n[k]) >= SIMILAR * np.maximum(n[k + 1 :], n[k])
        if both:
            near &= portion[k + 1 :] != portion[k]
        for m in (np.flatnonzero(near) + k + 1).tolist():
            x, y = part[label[k]], part[label[m]]
            if x != y and similar(sets[k], sets[m]):
                out.append((int(names[max(label[k], label[m])]), int(names[min(label[k], label[m])])))
                part[part == max(x, y)] = min(x, y)
    return pa.Table.from_arrays([pa.array([p[c] for p in out], pa.int64()) for c in range(2)], schema=_LINKED)


def links_within(spark: SparkSession, texts_: DataFrame) -> DataFrame:
    """(a, b): centres to be joined, from (tree, fp, s1, s2, n, t, centre, s): every proposed pair of a tree's texts is decided.

    A tree is cut into portions of bounded size and every two of them meet in a group of their own, where pairs
    are screened and decided in place.  What comes out are links that join, never pairs.
    """
    size = texts_.groupBy("tree").agg(F.greatest(F.ceil(F.count("*") / PORTION), F.ceil(F.sum(F.length("s")) / PORTION_BYTES), F.lit(1)).cast("int").alias("portions"))
    rows = texts_.join(stored(spark, size, "trees"), "tree").withColumn("portion", F.pmod(F.xxhash64("t"), F.col("portions")).cast("int"))
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)))
    met = other.select("tree", F.least("portion", "other").alias("i"), F.greatest("portion", "other").alias("j"), "portion", "fp", "s1", "s2", "n", "centre", "s")
    return stored(spark, met.groupBy("tree", "i", "j").applyInArrow(_linked, "a long, b long").distinct(), "more")


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """32-bit hashes of the distinct five-word shingles of each text, in order."""
    for batch in batches:
        text = batch.column("text")
        _, offsets = B.column(text)
        for i, j in B.row_slices(offsets):
            data, own = B.column(text.slice(i, j - i))
            if len(data) > B.LONG:
                parts = [np.unique((h >> np.uint64(32)).astype(np.uint32)) for h in _distinct_parts(_shingle_parts, data)]
                out = [np.unique(np.concatenate(parts)).tobytes()]
            else:
                data = B.lower_ascii(data)
                words = B.find_words(data, own, _SPACE)
                values, first = _shingles(B.span_hash(data, words.start, words.end), words.first)
                short = (values >> np.uint64(32)).astype(np.uint32)
                out = [np.unique(short[a:b]).tobytes() for a, b in zip(first.tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("t").slice(i, j - i), pa.array(out, pa.binary())], names=["t", "s"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
            keep.append(similar(x, y))
        yield batch.drop_columns(["x", "y"]).append_column("ok", pa.array(keep, pa.bool_()))


def row_key(docs: DataFrame) -> list[Column]:
    """128 bits that tell rows apart; rows that agree in all columns (maps aside) are copies of one row."""
    columns = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return [F.xxhash64(F.lit(k), *columns) for k in (1, 2)]


def similar_groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, centre) of every row: rows with one centre are a group of similar texts.

    Texts are linked if their five-word shingles are similar (SIMILAR, Jaccard) and SimHash proposes the
    pair; texts of the same words always are.  Groups are what links connect.
    """
    k1, k2 = row_key(docs)
    own = texts(docs, k1.alias("k1"), k2.alias("k2"))
    rows = stored(spark, own.select("text", "doc_id", "k1", "k2").mapInArrow(lean(_describe), "fp long, s1 long, s2 long, n long, t long, doc_id long, k1 long, k2 long"), "words")
    vertex = rows.groupBy("t").agg(*(F.min(c).alias(c) for c in ("fp", "s1", "s2", "n")), F.min(F.struct("k1", "k2")).alias("k"))
    vertex = stored(spark, vertex.select("fp", "s1", "s2", "n", "t", "k.k1", "k.k2"), "texts")
    pairs = spanning_pairs(spark, vertex)
    used = pairs.select("a").union(pairs.select("b")).distinct()
    need = stored(spark, vertex.join(used.withColumnRenamed("a", "t"), "t").select(*vertex.columns), "used")
    sets = own.join(need.select("t", "k1", "k2"), ["k1", "k2"]).select("t", "text").mapInArrow(lean(_shingle_sets), "t long, s binary").dropDuplicates(["t"])
    sets = stored(spark, sets, "shingles")

    def decided(p: DataFrame) -> DataFrame:
        x, y = (sets.select(F.col("t").alias(t), F.col("s").alias(s)) for t, s in (("a", "x"), ("b", "y")))
        columns = ", ".join(f"{c} long" for c in p.columns)
        return stored(spark, p.join(x, "a").join(y, "b").select(*p.columns, "x", "y").mapInArrow(lean(_similar), f"{columns}, ok boolean"), "similar")

    first = decided(pairs)
    centre = components(spark, first.where("ok").select("a", "b")).select(F.col("a").alias("t"), F.col("b").alias("centre"))
    if not first.where("not ok").isEmpty():
        # Where a pair of the forest is not similar, texts that it held together may still be so by another pair.
        whole = components(spark, pairs).select(F.col("a").alias("t"), F.col("b").alias("tree"))
        broken = first.where("not ok").select(F.col("a").alias("t")).join(whole, "t").select("tree").distinct()
        within = whole.join(broken, "tree").join(need, "t").join(centre, "t", "left").select("tree", "fp", "s1", "s2", "n", "t", F.coalesce("centre", "t").alias("centre"))
        more = links_within(spark, within.join(sets, "t"))
        joined = components(spark, more).select(F.col("a").alias("centre"), F.col("b").alias("least"))
        centre = need.select("t").join(centre, "t", "left").select("t", F.coalesce("centre", "t").alias("centre")).join(joined, "centre", "left").select("t", F.coalesce("least", "centre").alias("centre"))
    return rows.join(centre, "t", "left").select("doc_id", "k1", "k2", F.coalesce("centre", "t").alias("centre"))


def representatives(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and more) that stay: one of each group, the smallest doc_id.

    A null doc_id stays only where the group has no other.  Of several rows with that doc_id the one with the
    smallest hash of all columns stays; of rows that agree in every column, one.  Columns may have any names.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    stay = similar_groups(spark, docs).groupBy("centre").agg(F.min(order).alias("s")).select("s.k1", "s.k2")
    k1, k2 = row_key(docs)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), k1.alias("k1"), k2.alias("k2"))
    return rows.join(stored(spark, stay, "stay"), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
