"""Scoring texts with a hashed maximum-entropy language model.

Tokens are words and one end for each text.  The probability of a token is the product of three
factors: a softmax over 16 groups of classes, a softmax over the 16 classes of that group, both over
hashed n-gram and skip features of the three tokens before, and the token's smoothed share of its
class.  The end and the most frequent words are classes of their own; other words are dealt to
classes by their last bytes, so that a class is known for words never seen.

Training: token counts come from all training texts.  Weights are fitted in rounds; each round goes
over its own part of the training texts, so that every training text is used once.  Tasks start a
round from the broadcast weights, take gradient steps (Adagrad) on their rows, and yield the change
with the number of uses of each row; changes are averaged by use, block by block, while they stream
through the tasks that add them up.  Only the weights go to the driver.  The rows of a table grow
with the root of the number of distinct training tokens, for what tasks send grows with rows times
tasks: the power of two whose square is 128 times that number or more, 2**BITS at least and 2**MOST_BITS
(64 MB) at most, so that what is broadcast has a bound.

Scoring: tokens with at least 1/2**20 of all occurrences are in a broadcast table, which thus has
2**20 rows at most.  The other tokens of a text (few, and none of them frequent) meet their counts
in a join, which cannot be skewed.

Defined cases: null is empty; an empty text has one token, its end; with no training text all counts
are zero; a null doc_id is training; repeated rows each give a row and each count; an empty table
gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.llm import bytetext as B
from tapeframe.llm.common import held_out, stored, texts

#: Rows of a weight table are 2**BITS at least and 2**MOST_BITS at most; classes are GROUPS groups of MEMBERS.
BITS, MOST_BITS, GROUPS, MEMBERS = 14, 20, 16, 16
OWN_CLASSES = 128
ROUNDS, STEP, BATCH = 4, 0.25, 1 << 15
#: Largest weight: six of them stay below the largest exponent of a float.
CLIP = 12.0
HEAVY = 1 << 20
#: Rows of a table that travel together, and the tasks that add them up.
BLOCK, ADDERS = 1024, 32

U64 = np.uint64
END, START = U64(0x5BD1E9955BD1E995), U64(0x2545F4914F6CDD1D)
ODD = [U64(x | 1) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F)]
FIRST, SECOND = 5, 3  # features of the two softmaxes, without their bias

_SPACE = B.word_table("space")


def tokens(array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hash, class by last bytes, index of each row's first token); each row ends with END."""
    data, offsets = B.column(array)
    data = B.lower_ascii(data)
    words = B.find_words(data, offsets, _SPACE)
    n = len(words.first) - 1
    ends = words.first[1:] + np.arange(n)
    out = np.empty(len(words.start) + n, U64)
    shape = np.zeros(len(out), np.int64)
    place = np.ones(len(out), bool)
    place[ends] = False
    out[place] = B.span_hash(data, words.start, words.end)
    out[ends] = END
    last = np.stack([np.where(words.end - k >= words.start, data[np.maximum(words.end - k, 0)], 0) for k in (1, 2, 3)]).astype(np.int64) if len(words.start) else np.zeros((3, 0), np.int64)
    shape[place] = OWN_CLASSES + (last[0] * 5 + (last[0] >> 3)) % 8 * MEMBERS + (last[0] * 7 + last[1] * 31 + last[2] * 101) % MEMBERS
    return out, shape, words.first + np.arange(n + 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        _, offsets = B.column(text)
        for i, j in B.row_slices(offsets, 4 << 20):
            token, shape, _ = tokens(text.slice(i, j - i))
            value, at, count = np.unique(token, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(shape[at].astype(np.int32)), pa.array(count)], names=["token", "shape", "c"])


@dataclass
class Vocabulary:
    """What is known of tokens without a join: totals, frequent tokens, and classes."""

    total: int
    distinct: int
    heavy: np.ndarray  # sorted token hashes
    count: np.ndarray
    own: np.ndarray  # sorted tokens that are classes of their own
    own_class: np.ndarray
    class_log: np.ndarray  # log10 of what a class's counts are divided by
    bits: int  # rows of a weight table, as a power of two
    slots: tuple[np.ndarray, np.ndarray] | None = None  # made on first use

    def classes(self, token: np.ndarray, shape: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.own, token), len(self.own) - 1)
        return np.where(self.own[at] == token, self.own_class[at], shape)

    def counts(self, token: np.ndarray) -> np.ndarray:
        """Counts of frequent tokens; -1 for others."""
        if not len(self.heavy):
            return np.full(len(token), -1)
        if self.slots is None:
            self._fill()
        keys, values = self.slots
        mask = U64(len(keys) - 1)
        at = (token & mask).astype(np.int64)
        out = values[at]
        look = np.flatnonzero((keys[at] != token) & (out >= 0))
        while len(look):
            at[look] = (at[look] + 1) & int(mask)
            out[look] = values[at[look]]
            look = look[(keys[at[look]] != token[look]) & (out[look] >= 0)]
        return out

    def _fill(self) -> None:
        """An open table at most half full: a token stands at its low bits or in the next free slot."""
        size = 1 << int(2 * len(self.heavy)).bit_length()
        keys, values = np.zeros(size, U64), np.full(size, -1, np.int64)
        left, at = np.arange(len(self.heavy)), (self.heavy & U64(size - 1)).astype(np.int64)
        while len(left):
            free = left[values[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            own = free[first]
            keys[at[own]], values[at[own]] = self.heavy[own], self.count[own]
            left = left[keys[at[left]] != self.heavy[left]]
            at[left] = (at[left] + 1) & (size - 1)
        self.slots = keys, values

    def __getstate__(self) -> dict:
        return self.__dict__ | {"slots": None}


def table_bits(distinct: int) -> int:
    return min(max(BITS, ((128 * distinct - 1).bit_length() + 1) // 2), MOST_BITS)


def count_tokens(spark: SparkSession, train: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """(table of token, shape and count c; what of it is broadcast)."""
    counted = train.select("text").mapInArrow(_count, "token long, shape int, c long")
    table = stored(spark, counted.groupBy("token").agg(F.min("shape").alias("shape"), F.sum("c").alias("c")), "tokens")
    totals = table.groupBy("shape").agg(F.sum("c").alias("n"), F.count("*").alias("v")).toPandas()
    total, distinct = int(totals["n"].sum()), int(totals["v"].sum())
    frequent = table.where(F.col("c") * HEAVY >= total).toPandas()
    frequent["u"] = frequent["token"].to_numpy().view(U64)
    order = frequent[frequent["u"] != END].sort_values(["c", "token"], ascending=[False, True]).head(OWN_CLASSES - 1)
    own = np.concatenate([[END], order["u"].to_numpy()]).astype(U64)
    n, v = np.zeros(GROUPS * MEMBERS), np.zeros(GROUPS * MEMBERS)
    n[totals["shape"].to_numpy(int)], v[totals["shape"].to_numpy(int)] = totals["n"], totals["v"]
    np.add.at(n, order["shape"].to_numpy(int), -order["c"].to_numpy())
    np.add.at(v, order["shape"].to_numpy(int), -1)
    rank = np.argsort(own)
    frequent = frequent.sort_values("u")
    return table.select("token", "c"), Vocabulary(total, distinct, frequent["u"].to_numpy(), frequent["c"].to_numpy(), own[rank], rank, np.log10(n + 0.5 * (v + 1)), table_bits(distinct))


def _before(x: np.ndarray, k: int, place: np.ndarray, fill) -> np.ndarray:
    out = np.empty_like(x)
    out[k:] = x[:-k] if k < len(x) else x[:0]
    out[:k] = fill
    out[place < k] = fill
    return out


def features(token: np.ndarray, cls: np.ndarray, first: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the first table, rows of the second), each [features, tokens]; tables have 2**bits rows."""
    place = np.arange(len(token)) - np.repeat(first[:-1], np.diff(first))
    a, b = (_before(token, k, place, START) for k in (1, 2))
    c1, c2, c3 = (_before(cls, k, place, 0).astype(U64) for k in (1, 2, 3))
    shift = U64(64 - bits)
    pair = c1 * U64(256) + c2 + U64(1)
    raw = [a * ODD[0], b * ODD[1], (a * ODD[2]) ^ (b * ODD[3]), pair * ODD[4], (c2 * U64(256) + c3 + U64(1)) * ODD[5]]
    group = (cls // MEMBERS).astype(U64) + U64(1)
    second = [((x ^ (x >> U64(29))) + group * ODD[6]) * ODD[7] for x in (raw[0], raw[2], raw[3])]
    rows = lambda xs: np.stack([((x ^ (x >> U64(31))) * ODD[1] >> shift).astype(np.int32) for x in xs])
    return rows(raw), rows(second)


@dataclass
class Weights:
    first: np.ndarray  # 2**bits x GROUPS
    second: np.ndarray  # 2**bits x MEMBERS
    first_bias: np.ndarray  # 1 x GROUPS
    second_bias: np.ndarray  # GROUPS x MEMBERS

    @classmethod
    def zero(cls, bits: int) -> Weights:
        return cls(*(np.zeros((r, c), np.float32) for r, c in ((1 << bits, GROUPS), (1 << bits, MEMBERS), (1, GROUPS), (GROUPS, MEMBERS))))

    def tables(self) -> list[np.ndarray]:
        return [self.first, self.second, self.first_bias, self.second_bias]


def _logits(table: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the features' weights; weights are clipped so that their exponential is a float."""
    z = bias + table[rows[0]]
    for r in rows[1:]:
        z += table[r]
    return z


_ONES = np.ones(GROUPS, np.float32)


def class_log10(w: Weights, one: np.ndarray, two: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """log10 probability of each token's class in its context."""
    out = np.empty(len(cls))
    group, member = cls // MEMBERS, cls % MEMBERS
    for i in range(0, len(cls), BATCH):
        s = slice(i, i + BATCH)
        at = np.arange(len(cls[s]))
        z = _logits(w.first, w.first_bias, one[:, s])
        own = z[at, group[s]].astype(float)
        out[s] = own - np.log(np.exp(z, out=z) @ _ONES)
        z = _logits(w.second, w.second_bias[group[s]], two[:, s])
        own = z[at, member[s]].astype(float)
        out[s] += own - np.log(np.exp(z, out=z) @ _ONES)
    return out / np.log(10)


class Trainer:
    """Adagrad on one task's tokens, from shared weights."""

    def __init__(self, start: Weights, step: float) -> None:
        self.w = Weights(*(t.copy() for t in start.tables()))
        self.squares = [np.full(t.shape, 1.0, np.float32) for t in self.w.tables()]
        self.uses = [np.zeros(len(t), np.float32) for t in self.w.tables()]
        self.place = [np.zeros(len(t), np.int32) for t in self.w.tables()]
        self.step = step

    def _step(self, k: int, used: np.ndarray, gradient: np.ndarray, uses: np.ndarray) -> None:
        table = self.w.tables()[k]
        squares = self.squares[k][used] + gradient * gradient
        self.squares[k][used] = squares
        table[used] = np.clip(table[used] - self.step * gradient / np.sqrt(squares), -CLIP, CLIP)
        self.uses[k][used] += uses

    def _descend(self, k: int, rows: np.ndarray, error: np.ndarray) -> None:
        """One step of table ``k`` for the errors of tokens (classes x tokens) that use its rows."""
        flat, copies = rows.ravel(), rows.shape[0]
        uses = np.bincount(flat, minlength=len(self.uses[k]))
        used = np.flatnonzero(uses)
        self.place[k][used] = np.arange(len(used), dtype=np.int32)
        flat = self.place[k][flat]
        gradient = np.empty((len(used), len(error)), np.float32)
        for c, e in enumerate(error):
            gradient[:, c] = np.bincount(flat, np.tile(e, copies), len(used))
        self._step(k, used, gradient, uses[used])

    def learn(self, one: np.ndarray, two: np.ndarray, cls: np.ndarray) -> None:
        group, member = cls // MEMBERS, cls % MEMBERS

        def error(z: np.ndarray, own: np.ndarray) -> np.ndarray:
            e = np.exp(z, out=z)
            e /= (e @ _ONES)[:, None]
            e[np.arange(len(own)), own] -= 1
            return np.ascontiguousarray(e.T)

        for i in range(0, len(cls), BATCH):
            s = slice(i, i + BATCH)
            e = error(_logits(self.w.first, self.w.first_bias, one[:, s]), group[s])
            self._descend(0, one[:, s], e)
            self._step(2, np.zeros(1, int), e.sum(axis=1)[None, :], np.array([e.shape[1]]))
            e = error(_logits(self.w.second, self.w.second_bias[group[s]], two[:, s]), member[s])
            self._descend(1, two[:, s], e)
            self._descend(3, group[None, s], e)


CHANGES = "part int, block int, rows binary, uses binary, change binary"
_CHANGES = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("rows", pa.binary()), ("uses", pa.binary()), ("change", pa.binary())])


def _change(part: int, block: int, uses: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
    """The used rows of a block (numbers within it), their uses, and their changes, in half precision."""
    rows = np.flatnonzero(uses)
    return pa.RecordBatch.from_pylist([{"part": part, "block": block, "rows": rows.astype(np.uint16).tobytes(), "uses": uses[rows].astype(np.float32).tobytes(), "change": change[rows].astype(np.float16).tobytes()}], schema=_CHANGES)


def _changed(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, uses = np.frombuffer(row["rows"], np.uint16).astype(np.int64), np.frombuffer(row["uses"], np.float32)
    return rows, uses, np.frombuffer(row["change"], np.float16).reshape(len(rows), -1).astype(np.float64)


def train(spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Weights:
    """Fit the weights; ``docs`` has text and ``turn``, the round that uses a row."""
    bits = vocabulary.bits
    weights = Weights.zero(bits)
    known = spark.sparkContext.broadcast(vocabulary)
    for turn in range(rounds):
        start = spark.sparkContext.broadcast(weights)
        step = STEP / (1 + turn / 2)

        def learn(batches: Iterator[pa.RecordBatch], start=start, step=step) -> Iterator[pa.RecordBatch]:
            own = Trainer(start.value, step)
            for batch in batches:
                text = batch.column("text")
                _, offsets = B.column(text)
                for i, j in B.row_slices(offsets):
                    token, shape, first = tokens(text.slice(i, j - i))
                    cls = known.value.classes(token, shape)
                    own.learn(*features(token, cls, first, bits), cls)
            for k, (new, old, uses) in enumerate(zip(own.w.tables(), start.value.tables(), own.uses)):
                for b in range(0, len(new), BLOCK):
                    part = uses[b : b + BLOCK]
                    if part.any():
                        yield _change(k, b, part, new[b : b + BLOCK] - old[b : b + BLOCK])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], list[np.ndarray]] = {}
            for batch in batches:
                for r in batch.to_pylist():
                    rows, uses, change = _changed(r)
                    have = sums.setdefault((r["part"], r["block"]), [np.zeros(BLOCK), np.zeros((BLOCK, change.shape[1]))])
                    have[0][rows] += uses
                    have[1][rows] += change * uses[:, None]
            for (k, b), (uses, change) in sums.items():
                yield _change(k, b, uses, change / np.maximum(uses, 1)[:, None])

        changes = docs.where(F.col("turn") == turn).select("text").mapInArrow(learn, CHANGES).repartition(ADDERS, "part", "block").mapInArrow(add, CHANGES)
        tables = [t.copy() for t in weights.tables()]
        for r in changes.collect():
            rows, _, change = _changed(r.asDict())
            tables[r.part][r.block + rows] += change
        weights = Weights(*tables)
    return weights


SCORED = "rid long, token long, n long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
_SCORED = pa.schema([("rid", pa.int64()), ("token", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])


def _partial(part: pa.RecordBatch, v: Vocabulary, w: Weights) -> Iterator[pa.RecordBatch]:
    """A row for each text with what is known of it here (n = 0), and its other tokens with their numbers."""
    token, shape, first = tokens(part.column("text"))
    cls = v.classes(token, shape)
    score = class_log10(w, *features(token, cls, first, v.bits), cls)
    count = v.counts(token)
    rare = count < 0
    log = np.log10(np.maximum(count, 0) + 0.5)
    own_class = cls < OWN_CLASSES
    score += np.where(own_class, 0, np.where(rare, 0, log) - v.class_log[cls])
    base = np.where(rare, 0, log) - np.log10(v.total + 0.5 * (v.distinct + 1))
    size, total = np.diff(first), lambda x: np.add.reduceat(x, first[:-1]) if len(first) > 1 else x[:0]
    rid = part.column("rid").to_numpy()
    n = len(size)
    yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(B.mix(rid.view(U64)).view(np.int64)), pa.array(np.zeros(n, np.int64)), part.column("doc_id"), part.column("held_out"), pa.array(size.astype(np.int64)), pa.array(total((count > 0).astype(np.int64))), pa.array(total(base)), pa.array(total(score))], schema=_SCORED)
    row = np.repeat(np.arange(n), size)[rare]
    order = np.lexsort((token[rare], row))
    row, other = row[order], token[rare][order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (other[1:] != other[:-1])])) if len(row) else np.zeros(0, np.int64)
    number = np.diff(np.append(new, len(row)))
    none = lambda kind: pa.nulls(len(new), kind)
    yield pa.RecordBatch.from_arrays([pa.array(rid[row[new]]), pa.array(other[new].view(np.int64)), pa.array(number), none(pa.int64()), none(pa.bool_()), none(pa.int64()), none(pa.int64()), none(pa.float64()), none(pa.float64())], schema=_SCORED)


def score(spark: SparkSession, docs: DataFrame, modulus: int = 5) -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out, and score all rows."""
    rows = texts(docs).withColumn("held_out", held_out("doc_id", modulus))
    own = rows.where(~F.col("held_out")).withColumn("turn", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(ROUNDS)))
    table, vocabulary = count_tokens(spark, own)
    weights = spark.sparkContext.broadcast(train(spark, own, vocabulary))
    known = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = B.column(batch.column("text"))
            for i, j in B.row_slices(offsets):
                yield from _partial(batch.slice(i, j - i), known.value, weights.value)

    parts = rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "held_out", "text").mapInArrow(run, SCORED)
    met = parts.join(table, (parts["token"] == table["token"]) & (parts["n"] > 0), "left").drop(table["token"])
    log = F.when(F.col("n") > 0, F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).otherwise(0.0)
    one = lambda c: F.max(c).alias(c)
    sums = met.groupBy("rid").agg(one("doc_id"), one("held_out"), one("n_tokens"), one("n_known"), one("base"), one("score"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(log).alias("log"))
    return sums.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"), (F.col("base") + F.col("log")).alias("base_score"), (F.col("score") + F.col("log")).alias("score"))
