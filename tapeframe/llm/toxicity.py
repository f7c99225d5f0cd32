"""Toxicity by a weighted finite-state pattern grammar.

Words are read as symbols: insult, threat, target, negation, reported speech, or other.  Transducers
for negation, reported speech and targets rewrite the symbols of a clause and add weights; they are
composed into one machine, which reads only clauses that hold an insult or a threat.  A negated or
reported insult loses weight, one near a target gains some, and a threat counts only against a target.

Insults are learned: words and word beginnings that labelled toxic texts use and clean ones do not.
Support is the number of different words before an entry, so that copies of one text count once.  The
labelled sample has ``SAMPLE`` rows at most (the smallest hashes of doc_id); scoring has no limit.

A text's score is a logistic of its strongest clause, of how many clauses count and of its length,
fitted on the same sample; where no clause counts it is one half at most.  The fit starts from default
coefficients as its prior and moves away from them as far as the sample has evidence, however little that is.

A clause ends at ``.!?;:`` and line feeds, and at the first white space after ``CLAUSE`` bytes.  A long
text is read clause by clause and never decoded as a whole.

Defined cases: null and empty texts, and texts without entries, have the score ``QUIET``; labels that
are null are ignored, as are labels of unknown documents; without labels no insult is known; a
document with several labels counts once for each; repeated rows each give a row; an empty table
gives an empty result.  Other columns of the documents pass through ``scored`` untouched.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.llm import bytetext as B
from tapeframe.llm.common import bounded, held_out, lean, stored, texts

SAMPLE = 10_000
#: An entry needs this many different words before it in toxic texts, and this share of all of them.
SUPPORT, PRECISION = 7, 0.9
STEM_LENGTHS = (4, 5, 6, 7, 8)
#: Contexts that a process of the sample holds before it gives them on.
CONTEXTS = 1 << 16
#: Bytes after which a clause ends at white space.
CLAUSE = 1 << 16
#: How firmly the fit holds to the default coefficients: as this many texts of even odds would.
PRIOR = 0.1
QUIET, THRESHOLD = 0.01, 0.7

#: Weights of the transducers, in log odds.
NEGATED, REPORTED, AIMED, THREAT, LOUDEST = -6.0, -6.0, 1.0, 2.5, 6.0
SCOPE = 3

# Function words and verbs of the grammar, by symbol (en, de, fr, es).
WORDS = {
    "N": "not never no nor neither without isn't aren't wasn't don't doesn't didn't won't cannot can't nicht nie kein keine keinen niemals ne pas jamais sans ni nunca jamás sin tampoco",
    "R": "said says say saying told tells wrote writes claimed claims called quoted quotes reported reportedly allegedly sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó",
    "G": "you your yours you're he she they him her them everyone people du dich dir euch ihr sie er tu te toi vous ils elle elles il usted ustedes ellos ellas tú",
    "T": "kill killed killing murder murdered stab shoot strangle hang burn töten umbringen erschießen tuer tuerai égorger matar mataré degollar",
}
SYMBOLS = {w: s for s, ws in WORDS.items() for w in ws.split()}


# Transducers


@dataclass
class Transducer:
    """Deterministic weighted transducer; ``arcs[state, symbol]`` = (next state, output, weight).

    A missing symbol takes the arc of ``None``, whose output is the symbol itself.
    """

    start: object
    arcs: dict = field(default_factory=dict)

    def step(self, state, symbol: str) -> tuple[object, str, float]:
        if (state, symbol) in self.arcs:
            return self.arcs[state, symbol]
        nxt, _, weight = self.arcs.get((state, None), (state, None, 0.0))
        return nxt, symbol, weight

    def read(self, symbols: str) -> tuple[str, list[float]]:
        state, out, weights = self.start, [], []
        for s in symbols:
            state, o, w = self.step(state, s)
            out.append(o)
            weights.append(w)
        return "".join(out), weights


def compose(a: Transducer, b: Transducer, alphabet: str) -> Transducer:
    """The machine that feeds what ``a`` puts out to ``b``; weights add up."""
    start = (a.start, b.start)
    out, waiting, seen = Transducer(start), [start], {start}
    while waiting:
        state = waiting.pop()
        for symbol in alphabet:
            x, middle, u = a.step(state[0], symbol)
            y, last, v = b.step(state[1], middle)
            out.arcs[state, symbol] = ((x, y), last, u + v)
            if (x, y) not in seen:
                seen.add((x, y))
                waiting.append((x, y))
    return out


def negation() -> Transducer:
    """Insults (I) and threats (T) within SCOPE words of a negation become i and t."""
    m = Transducer(0)
    for k in range(SCOPE + 1):
        m.arcs[k, "N"] = (SCOPE, "N", 0.0)
        m.arcs[k, None] = (max(k - 1, 0), None, 0.0)
        if k:
            m.arcs[k, "I"] = (k - 1, "i", NEGATED)
            m.arcs[k, "T"] = (k - 1, "t", NEGATED)
    return m


def reported() -> Transducer:
    """What follows a verb of saying in its clause is reported."""
    m = Transducer(0)
    m.arcs[0, "R"] = (1, "R", 0.0)
    for s in "IiTt":
        m.arcs[1, s] = (1, s.lower(), REPORTED)
    return m


def target() -> Transducer:
    """Insults near a target weigh more; a threat near a target becomes K, which alone counts."""
    m = Transducer(0)
    for k in range(SCOPE + 1):
        m.arcs[k, "G"] = (SCOPE, "G", 0.0)
        m.arcs[k, None] = (max(k - 1, 0), None, 0.0)
        if k:
            m.arcs[k, "I"] = (k - 1, "I", AIMED)
            m.arcs[k, "T"] = (k - 1, "K", THREAT)
    # A threat that waits for its target: "kill all of them".
    for k in range(1, SCOPE + 1):
        m.arcs[("T", k), "G"] = (SCOPE, "K", THREAT)
        m.arcs[("T", k), None] = (("T", k - 1) if k > 1 else 0, None, 0.0)
    m.arcs[0, "T"] = (("T", SCOPE), "T", 0.0)
    return m


ALPHABET = "OITNRG"
GRAMMAR = compose(compose(negation(), reported(), ALPHABET), target(), ALPHABET)

_CLAUSE = re.compile(r"[^.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


# Lexicon


@dataclass
class Lexicon:
    """Log odds of learned entries: whole words, and beginnings of words."""

    words: dict[str, float]
    stems: dict[str, float]
    #: Of one, the strongest clause, the logarithm of the clauses that count, and of the words.
    coefficients: tuple[float, ...] = (0.0, 1.0, 0.5, 0.0)

    def weight(self, word: str) -> float | None:
        best = self.words.get(word)
        for n in STEM_LENGTHS:
            w = self.stems.get(word[:n]) if len(word) >= n else None
            if w is not None and (best is None or w > best):
                best = w
        return best


def units(word: str) -> Iterator[str]:
    """A word, and its beginnings marked with a star."""
    yield word
    for n in STEM_LENGTHS:
        if len(word) > n:
            yield word[:n] + "*"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, word before, label) of the sampled texts, ``CONTEXTS`` at once and some of them repeatedly."""
    hashed = lru_cache(1 << 14)(hash_of)
    found: set[tuple[str, int, int]] = set()
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            before = hashed("")
            for m in _WORD.finditer((text.as_py() or "").lower()):
                for u in units(m[0]):
                    found.add((u, before, toxic))
                before = hashed(m[0])
                if len(found) >= CONTEXTS:
                    yield _context_rows(found)
                    found.clear()
    yield _context_rows(found)


def _context_rows(found: set[tuple[str, int, int]]) -> pa.RecordBatch:
    rows = list(found)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32())], names=["unit", "before", "toxic"])


def hash_of(word: str) -> int:
    """A hash that all processes agree on."""
    h = 14695981039346656037
    for b in word.encode():
        h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return h >> 1


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, modulus: int | None = 3, sample: int = SAMPLE) -> Lexicon:
    """Entries from a bounded sample of the labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    if modulus is not None:
        known = known.where(~held_out("doc_id", modulus))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    # Of several documents with one id the one with the smallest hash is the sample's; so it has SAMPLE rows at most.
    met = texts(docs).join(F.broadcast(known.withColumn("n", F.lit(1)).groupBy("doc_id", "toxic").agg(F.sum("n").alias("n"))), "doc_id")
    one = met.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "n")).alias("s"))
    rows = stored(spark, one.select("doc_id", "toxic", F.col("s.text").alias("text"), F.col("s.n").alias("n")), "sample")
    seen = rows.mapInArrow(lean(_contexts), "unit string, before long, toxic int").distinct()
    counts = seen.groupBy("unit").agg(F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if(F.col("toxic") == 0).alias("neg"))
    share = (F.col("pos") + 0.5) / (F.col("pos") + F.col("neg") + 1)
    best = counts.where((F.col("pos") >= SUPPORT) & (share >= PRECISION)).collect()
    odds = {r.unit: min(LOUDEST, math.log((r.pos + 0.5) / (r.neg + 0.5))) for r in best}
    lexicon = Lexicon({u: w for u, w in odds.items() if u[-1] != "*"}, {u[:-1]: w for u, w in odds.items() if u[-1] == "*"})
    found = rows.mapInArrow(lean(_evidence(lexicon)), "toxic int, n int, strongest double, loud double, length double").collect()
    lexicon.coefficients = fit([(r.toxic, r.strongest, r.loud, r.length) for r in found for _ in range(r.n)])
    return lexicon


def _evidence(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            found = scorer.all_evidence(batch.column("text"))
            labels, times = batch.column("toxic").to_pylist(), batch.column("n").to_pylist()
            rows = [(labels[i], times[i], *x) for i, x in sorted(found.items())]
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["toxic", "n", "strongest", "loud", "length"])

    return run


def fit(rows: list[tuple]) -> tuple[float, ...]:
    """Logistic regression by Newton steps, with the default coefficients as its prior."""
    prior = np.array(Lexicon.coefficients)
    if not rows:
        return tuple(prior.tolist())
    y = np.array([r[0] for r in sorted(rows)], float)
    x = np.array([(1.0, *r[1:]) for r in sorted(rows)])
    ridge = PRIOR * np.eye(x.shape[1])
    loss = lambda w: float(np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)).sum() + 0.5 * PRIOR * ((w - prior) ** 2).sum())
    w = prior.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - PRIOR * (w - prior))
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        if size <= 1e-6 or np.abs(size * step).max() < 1e-9:
            break
        w = w + size * step
    return tuple(w.tolist())


# Scoring

_ASCII = np.zeros(256, bool)
_ASCII[0x61:0x7B] = True


@cache
def _unicode() -> tuple[np.ndarray, str]:
    """Which code points are letters to ``_WORD``, and those that Arrow and Python may turn into lower case differently."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    letters = np.zeros(0x110000, bool)
    for m in re.finditer(r"[^\W\d_]+", every):
        letters[ord(m[0][0]) : ord(m[0][-1]) + 1] = True
    letters[0xD800:0xE000] = False
    lower = pc.utf8_lower(pa.array([every]))[0].as_py()
    odd = {c for c, x in zip(every, lower) if c.lower() != x} if len(lower) == len(every) else {c for c in every if c.lower() != c}
    return letters, "".join(sorted(odd | {"\u03a3"}))


def _inside(data: np.ndarray) -> np.ndarray:
    """Which bytes of lower-case UTF-8 belong to letters."""
    inside = _ASCII[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        head = data[lead].astype(np.int64)
        size = 2 + (head >= 0xE0) + (head >= 0xF0)
        point = head & (0x7F >> size)
        for k in range(1, 4):
            more = size > k
            point[more] = (point[more] << 6) | (data[lead[more] + k] & 0x3F)
        letter = _unicode()[0][point]
        for k in range(4):
            inside[lead[letter & (size > k)] + k] = True
    return inside


class Scorer:
    """Finds texts that hold an entry in numpy, and reads only those with the grammar."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        threats = [w for w, s in SYMBOLS.items() if s == "T"]
        self.whole = self._table([w.encode() for w in [*lexicon.words, *threats]])
        self.stems = {n: self._table([s for s in (x.encode() for x in lexicon.stems) if len(s) == n]) for n in {len(x.encode()) for x in lexicon.stems}}

    @staticmethod
    def _table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(sorted hashes, which 16-bit beginnings of hashes occur)."""
        data = np.frombuffer(b"".join(entries), np.uint8)
        end = np.cumsum([len(e) for e in entries], dtype=np.int64)
        start = end - np.array([len(e) for e in entries], np.int64)
        hashes = np.sort(B.span_hash(data, start, end)) if entries else np.zeros(0, np.uint64)
        heads = np.zeros(1 << 16, bool)
        heads[(hashes >> np.uint64(48)).astype(np.int64)] = True
        return hashes, heads

    @staticmethod
    def _hits(hashes: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        maybe = np.flatnonzero(table[1][(hashes >> np.uint64(48)).astype(np.int64)])
        if not len(maybe):
            return maybe
        at = np.minimum(np.searchsorted(table[0], hashes[maybe]), len(table[0]) - 1)
        return maybe[table[0][at] == hashes[maybe]]

    def rows(self, text) -> np.ndarray:
        """Rows of a string array that may hold an entry: all that do, and few others."""
        lower = pc.utf8_lower(text)
        data, offsets = B.column(lower)
        w = B.find_words(_inside(data).view(np.uint8), offsets, np.arange(256) == 1)
        start, end = self._joined(data, w)
        power, inverse = B.powers(B.BYTE_BASE, len(data) + 1)
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=prefix[1:])
        span = lambda a, b: B.mix((prefix[b] - prefix[a]) * inverse[a] + (b - a).astype(np.uint64))
        found = [start[self._hits(span(start, end), self.whole)]]
        for n, table in self.stems.items():
            long = start[end - start >= n]
            found.append(long[self._hits(span(long, long + n), table)])
        hit = np.unique(np.concatenate(found))
        odd = pc.match_substring_regex(text, f"[{re.escape(_unicode()[1])}]").fill_null(False).to_numpy(zero_copy_only=False)
        return np.union1d(np.searchsorted(offsets, hit, "right") - 1, np.flatnonzero(odd))

    @staticmethod
    def _joined(data: np.ndarray, w: B.Words) -> tuple[np.ndarray, np.ndarray]:
        """Spans of all words, and of all two words of a row with an apostrophe between them."""
        gap = w.start[1:] - w.end[:-1]
        at = np.flatnonzero(((gap == 1) | (gap == 3)) & (w.row[1:] == w.row[:-1]))
        place = w.end[at]
        plain = (gap[at] == 1) & (data[place] == 0x27)
        curly = gap[at] == 3
        for k, byte in enumerate("’".encode()):
            curly &= data[np.minimum(place + k, len(data) - 1)] == byte
        at = at[plain | curly]
        return np.concatenate([w.start, w.start[at]]), np.concatenate([w.end, w.end[at + 1]])

    def clauses(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, log odds) of every clause that holds an insult, or a threat against a target."""
        out = []
        for start, clause in _clauses_of(text):
            words = _WORD.findall(clause.lower())
            weights = [self.lexicon.weight(w) for w in words]
            symbols = "".join("I" if x is not None else SYMBOLS.get(w, "O") for w, x in zip(words, weights))
            if "I" not in symbols and "T" not in symbols:
                continue
            read, extra = GRAMMAR.read(symbols)
            marks = [(x or 0.0) + e for s, x, e in zip(read, weights, extra) if s in "IiK"]
            if marks:
                out.append((start, start + len(clause), max(marks)))
        return out

    def portions(self, text) -> Iterator[tuple[int, pa.Array]]:
        """(row of the first, texts): short rows together; a long row in parts that end between clauses, one after the other."""
        _, offsets = B.column(text)
        for i, j in B.row_slices(offsets):
            part = text.slice(i, j - i)
            data, own = B.column(part)
            if len(data) <= B.LONG:
                yield i, part
                continue
            for a, b in clause_cuts(data):
                yield i, pa.array([data[a:b].tobytes().decode()], pa.string())

    def all_evidence(self, text) -> dict[int, tuple[float, float, float]]:
        """For rows of a string array where a clause matches: (strongest clause, logarithm of the clauses that count, of the words)."""
        found: dict[int, list] = {}
        words: dict[int, int] = {}
        for i, part in self.portions(text):
            alone = len(part) == 1
            near = self.rows(part).tolist()
            if alone:
                words[i] = words.get(i, 0) + (len(_WORD.findall(part[0].as_py() or "")) if near or i in words else self._count(part))
            for r in near:
                whole = part[r].as_py() or ""
                matched = [x for _, _, x in self.clauses(whole)]
                if matched:
                    if not alone:
                        words[i + r] = len(_WORD.findall(whole))
                    e = found.setdefault(i + r, [-math.inf, 0])
                    e[0], e[1] = max(e[0], *matched), e[1] + sum(x > 0 for x in matched)
        return {r: (e[0], math.log(max(e[1], 1)), math.log(1 + words[r])) for r, e in found.items()}

    @staticmethod
    def _count(part) -> int:
        return len(_WORD.findall(part[0].as_py() or ""))

    def evidence(self, text: str) -> tuple[float, float, float] | None:
        """The same for one text, read as a whole."""
        found = [x for _, _, x in self.clauses(text)]
        if not found:
            return None
        return max(found), math.log(max(sum(x > 0 for x in found), 1)), math.log(1 + len(_WORD.findall(text)))

    def _score(self, x: tuple[float, float, float] | None) -> float:
        if x is None:
            return QUIET
        z = sum(a * b for a, b in zip(self.lexicon.coefficients, (1.0, *x)))
        p = 1 / (1 + math.exp(-max(min(z, 30.0), -30.0)))
        return max(QUIET, p if x[0] > 0 else min(p, 0.5))

    def score(self, text: str) -> float:
        return self._score(self.evidence(text))

    def scores(self, text) -> np.ndarray:
        out = np.full(len(text), QUIET)
        for r, x in self.all_evidence(text).items():
            out[r] = self._score(x)
        return out


_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _clauses_of(text: str) -> Iterator[tuple[int, str]]:
    """(start, clause) of a text's clauses."""
    for c in _CLAUSE.finditer(text):
        if len(c[0]) * 4 <= CLAUSE or len(raw := c[0].encode()) <= CLAUSE:
            yield c.start(), c[0]
            continue
        at, start = 0, c.start()
        while at < len(raw):
            gap = _GAP.search(raw, at + CLAUSE)
            part = raw[at : gap.end() if gap else len(raw)].decode()
            yield start, part
            at, start = gap.end() if gap else len(raw), start + len(part)


#: ``.!?;:`` and line feed.
_STOPS = np.zeros(256, bool)
_STOPS[[0x2E, 0x21, 0x3F, 0x3B, 0x3A, 0x0A]] = True


def clause_cuts(data: np.ndarray, limit: int = B.SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Byte ranges of a long text of about ``limit`` bytes that end behind a clause (see ``CLAUSE``)."""
    n, at = len(data), 0
    while at < n:
        end = at + limit
        if end >= n:
            yield at, n
            return
        stops = np.flatnonzero(_STOPS[data[at:end]])
        if len(stops):
            cut = at + int(stops[-1]) + 1
        else:
            # One clause, as far as ``_clauses_of`` takes it.
            cut = n
            for k in range(at + CLAUSE, n, limit):
                part = data[k : k + limit]
                gap = np.flatnonzero((part == 0x20) | ((part >= 0x09) & (part <= 0x0D)))
                if len(gap):
                    cut = k + int(gap[0]) + 1
                    break
                if _STOPS[part].any():
                    cut = k + int(np.flatnonzero(_STOPS[part])[0]) + 1
                    break
        yield at, cut
        at = cut


def scored(spark: SparkSession, docs: DataFrame, lexicon: Lexicon, name: str = "toxicity", text: str = "text") -> DataFrame:
    """``docs`` with a score column, which replaces one of that name."""
    bounded(spark)
    docs = docs.drop(name)
    shared = spark.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            values = pa.array(scorer.scores(batch.column(text).cast(pa.string())))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lean(run), f"{columns}, `{name}` double")


def matched_clauses(spark: SparkSession, docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, start, end, clause, log_odds) of every clause that the grammar matches."""
    bounded(spark)
    shared = spark.sparkContext.broadcast(lexicon)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("clause", pa.string()), ("log_odds", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            text, ids = batch.column("text"), batch.column("doc_id").to_pylist()
            row, before = -1, 0
            for i, part in scorer.portions(text):
                before = before if i == row else 0
                rows = []
                for r in scorer.rows(part).tolist():
                    whole = part[r].as_py()
                    rows += [{"doc_id": ids[i + r], "start": a + before, "end": b + before, "clause": whole[a:b], "log_odds": x} for a, b, x in scorer.clauses(whole)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                row, before = i, before + (len(part[0].as_py() or "") if len(part) == 1 else 0)

    return texts(docs).mapInArrow(lean(run), "doc_id long, start long, end long, clause string, log_odds double")


def digest(spark: SparkSession, docs: DataFrame, lexicon: Lexicon, modulus: int = 3) -> DataFrame:
    """The contract's columns."""
    out = scored(spark, texts(docs), lexicon, "score")
    return out.select("doc_id", held_out("doc_id", modulus).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def lexicon_words(lexicon: Lexicon) -> Counter:
    """Entries and their weights, for reports."""
    return Counter({**lexicon.words, **{s + "*": w for s, w in lexicon.stems.items()}})
