"""Benchmark decontamination by a positional inverted index.

The index is split by documents: a segment holds all postings of a run of documents, so that a
phrase is found inside one segment and the search moves no postings between tasks.  A segment is a
row with its documents, sorted term hashes, list ends, and the word positions of every term in
ascending order; each document takes a stretch of positions of its own.  A document longer than a
segment takes several, each beginning with the last ``OVERLAP`` words of the one before.

All windows of the benchmark go through a segment together.  Terms are looked up once; a window with
a term that does not occur is done.  The positions of a window's rarest term, less its offset, are
candidate starts, which are intersected with the offset-adjusted lists of the others from the rarest
to the most frequent, in numpy.  Rarity is that in the segment: it decides the order of the
intersections, never the result.  A proximity match is a smallest stretch of words of one document
that holds all terms of a query, each as often as the query does, within a span.

The benchmark is taken to the segments in turns of bounded size; a turn's broadcast is freed before
the next one, and hits meet by the row of the index they come from.

Defined cases: null and empty texts have no words and no hits; an item without words or with a null
item_id is no query; repeated documents each give a row; repeated items count by distinct item_id; an
empty table gives an empty result (documents) or no hits (benchmark).  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.llm import bytetext as B
from tapeframe.llm.common import lean, new_path, stored, texts

WINDOW = 10
#: Words beyond a window's length within which its words count as near.
SLACK = 5
#: Bytes of text of a segment, and words that parts of a longer document share.
SEGMENT_BYTES, OVERLAP = 4 << 20, 64
#: Bytes of benchmark texts that one search takes to every segment; more are searched in turns.
QUERY_BYTES = 16 << 20
#: Candidates that are intersected at once.
CANDIDATES = 1 << 20

BLOBS = ("doc_ids", "first", "terms", "ends", "positions")
INDEX_SCHEMA = "rid long, base long, carried int, whole boolean, " + ", ".join(f"{f} binary" for f in BLOBS)
_INDEX_ARROW = pa.schema([("rid", pa.int64()), ("base", pa.int64()), ("carried", pa.int32()), ("whole", pa.bool_()), *((f, pa.binary()) for f in BLOBS)])
RESULT_SCHEMA = "rid long, doc_id long, n_words long, n_hit long, items array<string>, near_items array<string>, hit_starts array<long>, hit_ends array<long>"
_RESULT_ARROW = pa.schema([(c, pa.int64()) for c in ("rid", "doc_id", "n_words", "n_hit")] + [(c, pa.list_(pa.string())) for c in ("items", "near_items")] + [(c, pa.list_(pa.int64())) for c in ("hit_starts", "hit_ends")])

_ALNUM = B.word_table("alnum")
_ANY_CASE = _ALNUM.copy()
_ANY_CASE[0x41:0x5B] = True


def term_hashes(array) -> tuple[np.ndarray, np.ndarray]:
    """(term hash of every word, index of each row's first word)."""
    data, offsets = B.column(array)
    data = B.lower_ascii(data)
    words = B.find_words(data, offsets, _ALNUM)
    return B.span_hash(data, words.start, words.end), words.first


#: An id that stands for null inside a segment.
NO_ID = np.iinfo(np.int64).min


def segment_row(rid: int, ids: np.ndarray, terms: np.ndarray, first: np.ndarray, base: int = 0, carried: int = 0, whole: bool = True) -> dict:
    """One segment: its documents, sorted terms, list ends, and every term's positions in order.

    ``rid`` names the first document's row; ``base`` counts the words that a long document has before, and
    ``carried`` those at its head that the part before has too.
    """
    order = np.argsort(terms, kind="stable")
    ordered = terms[order]
    new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(terms) else np.zeros(0, np.int64)
    ends = np.append(new[1:], len(terms)) if len(terms) else new
    blobs = (ids, first.astype(np.int32), ordered[new], ends.astype(np.int32), order.astype(np.int32))
    return {"rid": rid, "base": base, "carried": carried, "whole": whole} | dict(zip(BLOBS, (x.tobytes() for x in blobs)))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    rid = (context.partitionId() if context else 0) << 40
    for batch in batches:
        ids = batch.column("doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)
        text = batch.column("text")
        _, offsets = B.column(text)
        for i, j in B.row_slices(offsets, SEGMENT_BYTES):
            if offsets[j] - offsets[i] <= SEGMENT_BYTES:
                terms, first = term_hashes(text.slice(i, j - i))
                yield pa.RecordBatch.from_pylist([segment_row(rid, ids[i:j], terms, first)], schema=_INDEX_ARROW)
            else:
                seen = 0
                for part, words, before in B.pieces(B.column(text.slice(i, 1))[0], _ANY_CASE, SEGMENT_BYTES, OVERLAP):
                    terms = B.span_hash(B.lower_ascii(part), words.start, words.end)
                    yield pa.RecordBatch.from_pylist([segment_row(rid, ids[i:j], terms, np.array([0, len(terms)]), before, seen - before, False)], schema=_INDEX_ARROW)
                    seen = before + len(terms)
            rid += j - i


def build_index(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Store the postings of every word of ``docs`` (doc_id, text) as a table in the shared folder."""
    path = path or new_path(spark, "postings")
    texts(docs).mapInArrow(lean(_index), INDEX_SCHEMA).write.parquet(path)
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """A stored index: a row for each segment."""
    return spark.read.schema(INDEX_SCHEMA).parquet(path)


class Segment:
    """Postings of a run of documents."""

    def __init__(self, row: dict) -> None:
        kinds = (np.int64, np.int32, np.uint64, np.int32, np.int32)
        self.ids, first, self.terms, ends, self.positions = (np.frombuffer(row[f], k) for f, k in zip(BLOBS, kinds))
        self.first, self.ends = first.astype(np.int64), ends.astype(np.int64)
        self.begins = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        self.rid, self.base, self.carried = row["rid"], row["base"], row["carried"]
        self.n = len(self.positions)
        self._keys: np.ndarray | None = None

    @property
    def keys(self) -> np.ndarray:
        """Every posting as one number, ascending: place of its term, then position."""
        if self._keys is None:
            self._keys = np.repeat(np.arange(len(self.terms)), self.ends - self.begins) * self.n + self.positions
        return self._keys

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of each term's list, its length; 0 for a term that does not occur)."""
        if not len(self.terms):
            return np.zeros(terms.shape, np.int64), np.zeros(terms.shape, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return at, np.where(self.terms[at] == terms, self.ends[at] - self.begins[at], 0)

    def listed(self, at: int) -> np.ndarray:
        return self.positions[self.begins[at] : self.ends[at]].astype(np.int64)

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, "right") - 1

    def centres(self, at: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Portions of (query, position of its rarest term, its terms' order from the rarest) for rows of list indices."""
        order = np.argsort(sizes, axis=1, kind="stable")
        least = sizes[np.arange(len(at)), order[:, 0]]
        upto, start = np.cumsum(least), 0
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + CANDIDATES, "right")))
            own = least[start:stop]
            query = np.repeat(np.arange(start, stop), own)
            low = self.begins[at[query, order[query, 0]]]
            yield query, self.positions[low + np.arange(len(query)) - np.repeat(np.cumsum(own) - own, own)].astype(np.int64), order
            start = stop

    def phrases(self, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, start) of every occurrence of phrases of one length inside one document, from the lists of their terms."""
        m = at.shape[1]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for query, position, order in self.centres(at, sizes):
            begin = position - order[query, 0]
            for step in range(1, m):
                k = order[query, step]
                want = at[query, k] * self.n + begin + k
                inside = (begin >= 0) & (begin + m <= self.n)
                have = np.minimum(np.searchsorted(self.keys, want), self.n - 1)
                ok = inside & (self.keys[have] == want)
                query, begin = query[ok], begin[ok]
                if not len(query):
                    break
            document = self.document(begin)
            ok = (begin >= 0) & (begin + m <= self.first[np.minimum(document + 1, len(self.first) - 1)])
            found.append((query[ok], begin[ok]))
        return tuple(np.concatenate(c) for c in zip(*found))

    def near_queries(self, at: np.ndarray, sizes: np.ndarray, span: int) -> np.ndarray:
        """Queries with a place where every term stands less than ``span`` words from the rarest one, in one document."""
        out = [np.zeros(0, np.int64)]
        for query, position, order in self.centres(at, sizes):
            document = self.document(position)
            low, high = np.maximum(position - span + 1, self.first[document]), np.minimum(position + span, self.first[document + 1])
            for step in range(1, at.shape[1]):
                term = at[query, order[query, step]] * self.n
                ok = np.searchsorted(self.keys, term + high) > np.searchsorted(self.keys, term + low)
                query, low, high = query[ok], low[ok], high[ok]
                if not len(query):
                    break
            out.append(np.unique(query))
        return np.unique(np.concatenate(out))

    def near(self, terms: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) position of every smallest stretch of at most ``span`` words with all terms, each as often as in ``terms``."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        wanted, times = np.unique(terms, return_counts=True)
        at, sizes = self.find(wanted)
        if not len(at) or (sizes < times).any():
            return none
        lists = [self.listed(a) for a in at]
        centre = lists[int(np.argmin(sizes))]
        ends = np.unique(np.concatenate(lists))
        nearest = np.searchsorted(centre, ends, "right") - 1
        ends = ends[(nearest >= 0) & (ends - centre[np.maximum(nearest, 0)] < span)]
        if not len(ends):
            return none
        begin = np.full(len(ends), self.n, np.int64)
        for own, k in zip(lists, times):
            which = np.searchsorted(own, ends, "right") - k
            begin = np.where(which >= 0, np.minimum(begin, own[np.maximum(which, 0)]), -1)
        ok = (begin >= self.first[self.document(ends)]) & (ends - begin < span) & (begin >= 0)
        begin, ends = begin[ok], ends[ok]
        # Ends ascend and so do beginnings: of equal beginnings the first end is the smallest stretch.
        new = np.concatenate([[True], begin[1:] != begin[:-1]]) if len(begin) else np.zeros(0, bool)
        begin, ends = begin[new], ends[new]
        new = ends >= self.carried
        return begin[new], ends[new]


class Queries:
    """Windows of the benchmark items: where they begin among all item words, by length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW, slack: int | None = None) -> None:
        if window > OVERLAP + 1 or window + (slack or 0) > OVERLAP + 1:
            raise ValueError("a window goes beyond what parts of a document share")
        self.names, self.slack = [i for i, _ in items], slack
        self.words, first = term_hashes(pa.array([t for _, t in items], pa.string()))
        self.terms, self.code = np.unique(self.words, return_inverse=True)
        size = np.diff(first)
        length = np.minimum(size, window)
        number = np.where(size > 0, size - length + 1, 0)
        item = np.repeat(np.arange(len(size)), number)
        start = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(number) - number, number)
        self.groups = [(int(m), start[length[item] == m], item[length[item] == m]) for m in np.unique(length[item])]


def _lists(values: pa.Array, row: np.ndarray, n: int) -> pa.ListArray:
    """Values, sorted by their row, as a list for each of ``n`` rows."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)), values)


def search(segment: Segment, queries: Queries) -> pa.RecordBatch:
    """A row for each document: words, hit words, items that occur or whose words are near, and the word spans that are hit."""
    n, n_docs = segment.n, len(segment.ids)
    delta = np.zeros(n + 1, np.int32)
    none = np.zeros(0, np.int64)
    found, close = [(none, none)], [(none, none)]
    at, sizes = segment.find(queries.terms)
    missing = np.concatenate([[0], np.cumsum(sizes[queries.code] == 0)])
    for m, start, item in queries.groups:
        alive = np.flatnonzero(missing[start + m] == missing[start])
        if not len(alive):
            continue
        code = queries.code[start[alive][:, None] + np.arange(m)]
        query, begin = segment.phrases(at[code], sizes[code])
        np.add.at(delta, begin, 1)
        np.add.at(delta, begin + m, -1)
        found.append((segment.document(begin), item[alive[query]]))
        if queries.slack is not None:
            for q in segment.near_queries(at[code], sizes[code], m + queries.slack).tolist():
                _, ends = segment.near(queries.terms[code[q]], m + queries.slack)
                document = np.unique(segment.document(ends))
                close.append((document, np.full(len(document), item[alive[q]])))
    hit = np.concatenate([[0], np.cumsum(delta[:-1]) > 0, [0]]).astype(np.int8)
    # A span ends where its document ends, though the next one may begin there.
    edge = np.diff(hit)
    inner = segment.first[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < n)])
    both = inner[(hit[inner] == 1) & (hit[inner + 1] == 1)]
    begins, ends = np.union1d(np.flatnonzero(edge == 1), both), np.union1d(np.flatnonzero(edge == -1), both)
    row = segment.document(begins)
    row = np.minimum(row, n_docs - 1)
    base = segment.first[row]
    shift = segment.base - (base if len(segment.first) > 2 else 0)
    n_hit = np.bincount(row, ends - np.maximum(begins, segment.carried), n_docs).astype(np.int64) if segment.carried == 0 else np.array([int(hit[1 + segment.carried : -1].sum())])

    def names(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.ListArray:
        document, item = (np.concatenate(c) for c in zip(*pairs))
        key = np.unique(document * max(len(queries.names), 1) + item)
        owner = key // max(len(queries.names), 1)
        out: list[list[str]] = [[] for _ in range(n_docs)]
        for d, k in zip(owner.tolist(), (key % max(len(queries.names), 1)).tolist()):
            out[d].append(queries.names[k])
        return pa.array([sorted(set(x)) for x in out], pa.list_(pa.string()))

    ids = pa.array(segment.ids, pa.int64(), mask=segment.ids == NO_ID)
    columns = [
        pa.array(segment.rid + np.arange(n_docs)), ids, pa.array(np.diff(segment.first) - segment.carried), pa.array(n_hit), names(found), names(close),
        _lists(pa.array(begins + shift), row, n_docs), _lists(pa.array(ends + shift), row, n_docs),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_RESULT_ARROW)


def _each_segment(answer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield answer(Segment(batch.slice(k, 1).to_pylist()[0]))

    return run


def _turns(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, str | None]]]:
    """The items in turns of at most QUERY_BYTES (a longer item is a turn of its own)."""
    turn, size = [], 0
    for r in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null").toLocalIterator():
        n = len((r.t or "").encode())
        if turn and size + n > QUERY_BYTES:
            yield turn
            turn, size = [], 0
        turn.append((r.i, r.t))
        size += n
    yield turn


def phrase_matches(spark: SparkSession, index: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text", slack: int | None = None) -> DataFrame:
    """For each document of the index: rid, doc_id, n_words, n_hit, items, near_items, hit_starts, hit_ends (word spans).

    ``near_items`` are those with a window whose words all stand within ``slack`` words more than its length, in
    any order (None: not searched; the search costs many times that for phrases).  One turn of the benchmark, the usual case, needs no shuffle but
    for documents of several segments.  With several turns only rows with hits are kept of each and united.
    """
    turns = _turns(benchmark, item_col, text_col)
    turn, following = next(turns), next(turns, None)
    found: list[DataFrame] = []
    while True:
        shared = spark.sparkContext.broadcast(Queries(turn, window, slack))
        every = index.mapInArrow(lean(_each_segment(lambda x, q=shared: search(x, q.value))), RESULT_SCHEMA)
        if following is None and not found:
            parts = index.where("not whole").mapInArrow(lean(_each_segment(lambda x, q=shared: search(x, q.value))), RESULT_SCHEMA)
            return index.where("whole").mapInArrow(lean(_each_segment(lambda x, q=shared: search(x, q.value))), RESULT_SCHEMA).unionByName(_united(parts))
        found.append(stored(spark, every.where("n_hit > 0 or size(near_items) > 0"), "hits"))
        shared.destroy()
        if following is None:
            break
        turn, following = following, next(turns, None)
    hits = found[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    plain = index.mapInArrow(lean(_each_segment(lambda x: search(x, Queries([], window, None)))), RESULT_SCHEMA)
    sizes = plain.groupBy("rid", "doc_id").agg(F.sum("n_words").alias("n_words"))
    more = _united(hits).drop("doc_id", "n_words")
    none, no_items = F.expr("cast(array() as array<bigint>)"), F.expr("cast(array() as array<string>)")
    joined = sizes.join(more, "rid", "left")
    return joined.select("rid", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), *(F.coalesce(c, no_items).alias(c) for c in ("items", "near_items")), *(F.coalesce(c, none).alias(c) for c in ("hit_starts", "hit_ends")))


#: Sorted spans, with those that touch or overlap made one.
_MERGE = """aggregate(
    transform(spans, x -> named_struct('a', x.hit_starts, 'b', x.hit_ends)), cast(array() as array<struct<a: bigint, b: bigint>>),
    (done, s) -> if(coalesce(try_element_at(done, -1).b >= s.a, false),
        concat(slice(done, 1, size(done) - 1), array(named_struct('a', try_element_at(done, -1).a, 'b', greatest(try_element_at(done, -1).b, s.b)))),
        concat(done, array(s))))"""


def _united(parts: DataFrame) -> DataFrame:
    """Results for one row of the documents, from several segments or turns, united: they hold only its own spans."""
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("hit_starts", "hit_ends"))))
    names = (F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items"))
    one = parts.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), *names, spans.alias("spans"))
    one = one.select("rid", "doc_id", "n_words", "items", "near_items", F.expr(_MERGE).alias("m"))
    return one.select("rid", "doc_id", "n_words", F.aggregate("m", F.lit(0).cast("long"), lambda t, s: t + (s["b"] - s["a"])).alias("n_hit"), "items", "near_items", F.col("m.a").alias("hit_starts"), F.col("m.b").alias("hit_ends"))


def proximity_matches(spark: SparkSession, index: DataFrame, queries: dict[str, str], span: int = 20) -> DataFrame:
    """(doc_id, query, start, end): word spans of the smallest stretches of at most ``span`` words that hold all words of a query.

    A word that the query has several times must be there as often.  A stretch holds no smaller one.
    ``queries`` is a small dictionary given by the caller: name to words.
    """
    if span > OVERLAP + 1:
        raise ValueError("a span goes beyond what parts of a document share")
    wanted = {k: term_hashes(pa.array([v], pa.string()))[0] for k, v in queries.items()}
    schema = pa.schema([("doc_id", pa.int64()), ("query", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def answer(segment: Segment) -> pa.RecordBatch:
        out = []
        for name, terms in wanted.items():
            begin, end = segment.near(terms, span)
            for a, b, d in zip(begin.tolist(), end.tolist(), segment.document(begin).tolist()):
                shift = segment.base - int(segment.first[d])
                out.append({"doc_id": None if segment.ids[d] == NO_ID else int(segment.ids[d]), "query": name, "start": a + shift, "end": b + 1 + shift})
        return pa.RecordBatch.from_pylist(out, schema=schema)

    return index.mapInArrow(lean(_each_segment(answer)), "doc_id long, query string, start long, end long")


def digest(matches: DataFrame, near: bool = False) -> DataFrame:
    """The contract's columns from the operator's; with ``near``, the number of items whose words are near."""
    more = [F.size("near_items").cast("long").alias("n_near_items")] if near else []
    return matches.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), *more,
    )


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and more, under any names) without an occurrence of a window.

    Rows are told apart by a 64-bit hash of their text; rows of one text share their fate.
    """
    key = F.xxhash64(F.col("text").cast("string"))
    index = build_index(spark, docs.select(key.alias("doc_id"), "text"))
    hit = stored(spark, phrase_matches(spark, index, benchmark).where("n_hit > 0").select(F.col("doc_id").alias("key")).distinct(), "contaminated")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"))
    return rows.join(hit, "key", "left_anti").select("row.*")
