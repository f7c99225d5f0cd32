"""Queries of record linkage, timelines and fusion, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeframe.operators import fuse, link, timeline
from tapeframe.plans.registry import query, read

BASE = "src0"
#: Documents have few lines, of which none is sound: smaller least counts than the operators' own.
FEW = {"min_blocks": 3, "min_audio": 0}

LINES = """lines AS (SELECT source AS cap, doc_id AS frame, unnest(string_split(text, chr(10))) AS data, unnest(range(len(string_split(text, chr(10))))) AS blk FROM documents),
own AS (SELECT * FROM lines WHERE length(trim(data, ' ')) > 0)"""
VOTES = f"""{LINES},
rare AS (SELECT data FROM own GROUP BY data HAVING count(*) BETWEEN 2 AND 400),
kept AS (SELECT own.* FROM own JOIN rare USING (data)),
votes AS (SELECT a.cap, a.frame, b.cap AS cap2, b.frame AS frame2, count(*) AS votes FROM kept a JOIN kept b USING (data) WHERE a.cap <> b.cap GROUP BY ALL)"""
VERIFIED = f"""{VOTES},
best AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY cap, frame ORDER BY votes DESC, cap2, frame2) <= 40),
compared AS (SELECT v.cap, v.frame, v.cap2, v.frame2, v.votes, count(*) AS n, count(*) FILTER (a.data = b.data) AS same, count(*) FILTER (a.data = b.data AND a.blk % 4 = 0) AS audio
    FROM best v JOIN own a ON a.cap = v.cap AND a.frame = v.frame JOIN own b ON b.cap = v.cap2 AND b.frame = v.frame2 AND b.blk = a.blk GROUP BY ALL),
good AS (SELECT * FROM compared WHERE n >= 3 AND same >= 0.9::DOUBLE * n),
matched AS (SELECT cap, frame, cap2, frame2, votes FROM good QUALIFY row_number() OVER (PARTITION BY cap, frame, cap2 ORDER BY votes DESC, cap2, frame2) = 1)"""
ON_BASE = f"""{LINES},
rare AS (SELECT data FROM own WHERE cap = '{BASE}' GROUP BY data HAVING count(*) <= 400),
votes AS (SELECT a.cap, a.frame, b.cap AS cap2, b.frame AS frame2, count(*) AS votes FROM own a JOIN own b USING (data) JOIN rare USING (data) WHERE a.cap <> '{BASE}' AND b.cap = '{BASE}' GROUP BY ALL),
best AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY cap, frame ORDER BY votes DESC, frame2) <= 40),
compared AS (SELECT v.cap, v.frame, v.frame2, v.votes, count(*) AS n, count(*) FILTER (a.data = b.data) AS same FROM best v JOIN own a ON a.cap = v.cap AND a.frame = v.frame JOIN own b ON b.cap = v.cap2 AND b.frame = v.frame2 AND b.blk = a.blk GROUP BY ALL),
onbase AS (SELECT cap, frame, frame2 FROM compared WHERE n >= 3 AND same >= 0.9::DOUBLE * n QUALIFY row_number() OVER (PARTITION BY cap, frame ORDER BY votes DESC, frame2) = 1)"""
TIMELINE = "t AS (SELECT user_id AS cap, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS f, event_id, ts, value, event_type = 'error' AS bad, event_type AS kind FROM events)"
BEFORE = "OVER (PARTITION BY cap ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
AFTER = "OVER (PARTITION BY cap ORDER BY f ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
BY = "OVER (PARTITION BY cap ORDER BY f)"
AROUND = f"""{TIMELINE}, around AS (SELECT cap, f, value, bad, last_value(CASE WHEN NOT bad THEN f END IGNORE NULLS) {BEFORE} AS j1, last_value(CASE WHEN NOT bad THEN value END IGNORE NULLS) {BEFORE} AS v1,
    first_value(CASE WHEN NOT bad THEN f END IGNORE NULLS) {AFTER} AS j2, first_value(CASE WHEN NOT bad THEN value END IGNORE NULLS) {AFTER} AS v2 FROM t)"""
NEAREST = f"""{AROUND}, near AS (SELECT *, CASE WHEN f - j1 <= coalesce(j2 - f, f - j1) THEN j1 ELSE coalesce(j2, j1) END AS s FROM around WHERE bad),
nearest AS (SELECT *, CASE WHEN abs(s - f) <= 25 THEN s END AS source FROM near)"""
ANCHORS = f"{TIMELINE}, k AS (SELECT cap, f, row_number() {BY} AS n FROM t WHERE kind = 'purchase'), anchors AS (SELECT a.cap, a.f, b.f AS g FROM k a JOIN k b ON b.cap = a.cap + 1 AND b.n = a.n)"
READS = """reads AS (SELECT l_orderkey AS frame, l_linenumber::BIGINT AS slot, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS read,
    l_returnflag = 'R' AS bad, l_linestatus = 'F' AS false_ok, l_quantity AS value, CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_linestatus = 'F' THEN 2 ELSE 3 END AS quality FROM lineitem)"""
RANKED = f"""{READS}, sums AS (SELECT frame, read, count(*) FILTER (bad) AS n_bad, count(*) FILTER (false_ok AND NOT bad) AS n_false FROM reads GROUP BY ALL),
ranks AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n_bad, n_false, read) AS rank FROM sums)"""
MERGED = f"""{RANKED}, slots AS (SELECT frame, slot, max(CASE WHEN rank = 1 THEN {{'quality': quality, 'value': value, 'read': read}} END) AS canvas, min(CASE WHEN quality = 3 THEN {{'rank': rank, 'read': read, 'value': value}} END) AS clean,
    max({{'quality': quality, 'back': -read, 'value': value, 'read': read}}) AS best FROM reads JOIN ranks USING (frame, read) GROUP BY ALL),
merged AS (SELECT frame, slot, CASE WHEN canvas.quality = 3 THEN 'kept' WHEN clean IS NOT NULL THEN 'copied' WHEN best.quality > 0 THEN 'repacked' ELSE 'unresolved' END AS how,
    CASE WHEN canvas.quality = 3 THEN canvas.read WHEN clean IS NOT NULL THEN clean.read WHEN best.quality > 0 THEN best.read ELSE coalesce(canvas.read, best.read) END AS read,
    CASE WHEN canvas.quality = 3 THEN canvas.value WHEN clean IS NOT NULL THEN clean.value WHEN best.quality > 0 THEN best.value ELSE coalesce(canvas.value, best.value) END AS value FROM slots)"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return link.text_blocks(read(spark, d, "documents"))


def _timeline(spark: SparkSession, d: str) -> DataFrame:
    return timeline.of_events(read(spark, d, "events"))


def _anchors(t: DataFrame) -> DataFrame:
    k = t.where("kind = 'purchase'").select("cap", "f", F.row_number().over(W.partitionBy("cap").orderBy("f")).alias("n"))
    return k.join(k.select((F.col("cap") - 1).alias("cap"), F.col("f").alias("g"), "n"), ["cap", "n"]).select("cap", "f", "g")


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return fuse.reads_of_lineitem(read(spark, d, "lineitem"))


@query("P6 F1 F3 J1 T1 J17", f"WITH {VOTES} SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY cap, frame ORDER BY votes DESC, cap2, frame2) = 1")
def fingerprint_votes(spark, d):
    """The best voted partner of every document in another source."""
    return link.top_candidates(link.votes(_blocks(spark, d)), 1).drop("rank")


@query("F3", f"WITH {LINES} SELECT data, count(*) AS postings, count(*) <= 400 AS kept FROM own GROUP BY data HAVING count(*) > 1")
def hot_key_filter(spark, d):
    return link.key_sizes(_blocks(spark, d))


@query("F2 J4 J18", f"WITH {VERIFIED} SELECT cap, frame, cap2, frame2, n, same, CASE WHEN n >= 3 AND same >= 0.9::DOUBLE * n THEN audio ELSE 0 END AS aud, n >= 3 AND same >= 0.9::DOUBLE * n AS ok FROM compared")
def verify_pair_ratio(spark, d):
    b = _blocks(spark, d)
    return link.verify(link.top_candidates(link.votes(b), 40), b, **FEW)


@query("T1 G2", f"WITH {VERIFIED} SELECT * FROM matched")
def first_verified_partner(spark, d):
    return link.first_verified(_blocks(spark, d), **FEW)


@query("J2", f"WITH {ON_BASE} SELECT cap AS donor, count(*) AS matched, min(frame2) AS base_lo, max(frame2) AS base_hi, min(frame) AS don_lo, max(frame) AS don_hi FROM onbase GROUP BY cap")
def triage_sources(spark, d):
    return link.triage(link.base_matches(_blocks(spark, d), BASE, **FEW))


@query("A21", f"WITH {ON_BASE}, donors AS (SELECT cap, count(*) AS matched, min(frame2) AS base_lo, max(frame2) AS base_hi FROM onbase GROUP BY cap HAVING count(*) >= 2) SELECT count(*) AS donors, coalesce(sum(matched), 0)::BIGINT AS matched, min(base_lo) AS base_lo, max(base_hi) AS base_hi FROM donors")
def triage_summary(spark, d):
    return link.triage_summary(link.triage(link.base_matches(_blocks(spark, d), BASE, **FEW)))


@query("J16", f"WITH {VERIFIED}, size AS (SELECT cap AS cap2, min(frame) AS first, max(frame) AS last FROM lines GROUP BY cap) SELECT m.cap, m.cap2, count(*) AS matched, greatest(min(m.frame2) - 25, any_value(first)) AS start, least(max(m.frame2) + 25, any_value(last)) AS stop FROM matched m JOIN size USING (cap2) GROUP BY m.cap, m.cap2")
def aligned_clip_ranges(spark, d):
    b = _blocks(spark, d)
    return link.clip_ranges(link.first_verified(b, **FEW), link.lengths(b))


@query(
    "J3 J20",
    f"""WITH {VERIFIED}, g AS (SELECT cap, cap2, frame, CASE WHEN frame - lag(frame) OVER w > 120 THEN 1 ELSE 0 END AS new FROM matched WINDOW w AS (PARTITION BY cap, cap2 ORDER BY frame)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY cap, cap2 ORDER BY frame) AS run FROM g), s AS (SELECT cap, cap2, run, count(*) AS frames, min(frame) AS first, max(frame) AS last FROM r GROUP BY ALL)
    SELECT cap, cap2, frames, first, last FROM s QUALIFY row_number() OVER (PARTITION BY cap, cap2 ORDER BY frames DESC, first) = 1""",
)
def window_clips(spark, d):
    """The largest contiguous run of matched frames of each pair of sources."""
    w = W.partitionBy("cap", "cap2").orderBy("frame")
    m = link.first_verified(_blocks(spark, d), **FEW)
    m = m.withColumn("new", F.coalesce((F.col("frame") - F.lag("frame").over(w) > 120).cast("int"), F.lit(0))).withColumn("run", F.sum("new").over(w))
    s = m.groupBy("cap", "cap2", "run").agg(F.count("*").alias("frames"), F.min("frame").alias("first"), F.max("frame").alias("last"))
    return s.withColumn("rank", F.row_number().over(W.partitionBy("cap", "cap2").orderBy(F.desc("frames"), "first"))).where("rank = 1").drop("rank", "run")


@query(
    "J14",
    f"""WITH {LINES}, size AS (SELECT frame, count(*) AS size FROM own GROUP BY frame),
    pairs AS (SELECT a.frame, b.frame AS frame2, count(*) AS same FROM own a JOIN own b USING (blk, data) WHERE a.frame <> b.frame GROUP BY ALL),
    scored AS (SELECT p.*, same / least(s.size, z.size)::DOUBLE AS x FROM pairs p JOIN size s ON s.frame = p.frame JOIN size z ON z.frame = p.frame2)
    SELECT frame, frame2, same, round(x, 6) AS similarity, row_number() OVER (PARTITION BY frame ORDER BY x DESC, same DESC, frame2) AS rank FROM scored QUALIFY rank <= 10""",
)
def similarity_topk(spark, d):
    return link.similarity_top(_blocks(spark, d))


@query("J7", f"WITH {VOTES} SELECT cap, cap2, frame - frame2 AS offset, sum(votes)::BIGINT AS votes FROM votes WHERE votes >= 2 GROUP BY cap, cap2, frame - frame2 QUALIFY row_number() OVER (PARTITION BY cap, cap2 ORDER BY sum(votes) DESC, abs(frame - frame2), frame - frame2) = 1")
def offset_vote(spark, d):
    return link.offset_vote(link.votes(_blocks(spark, d)))


@query("J9 M10", f"WITH {TIMELINE} SELECT a.cap, a.f, CASE WHEN a.bad AND NOT b.bad THEN b.value ELSE a.value END AS value, coalesce(a.bad AND NOT b.bad, false) AS replaced, a.bad AND NOT coalesce(NOT b.bad, false) AS still_bad FROM t a LEFT JOIN t b ON b.cap = a.cap + 1 AND b.f = a.f")
def positional_merge(spark, d):
    return link.positional_merge(_timeline(spark, d))


@query("J14", f"WITH {TIMELINE}, o AS (SELECT unnest(range(-4, 5)) AS o) SELECT a.cap, o AS offset, count(*) AS both, count(*) FILTER (a.kind = b.kind) AS same FROM t a, o JOIN t b ON b.cap = a.cap + 1 AND b.f = a.f + o WHERE NOT a.bad AND NOT b.bad GROUP BY ALL")
def offset_comparison(spark, d):
    return link.offset_scan(_timeline(spark, d))


@query("J19", f"WITH {TIMELINE} SELECT a.cap, b.f AS f2, count(*) FILTER (NOT a.bad) AS healthy_a, count(*) FILTER (NOT b.bad) AS healthy_b, count(*) FILTER (NOT a.bad AND NOT b.bad) AS both, count(*) FILTER (NOT a.bad AND NOT b.bad AND a.kind = b.kind) AS equal FROM t a JOIN t b ON b.cap = a.cap + 1 AND b.f = a.f - 14 GROUP BY ROLLUP (a.cap, b.f) HAVING a.cap IS NOT NULL")
def fixed_offset_report(spark, d):
    return link.diagnosis(_timeline(spark, d))


@query(
    "J5",
    f"""WITH {TIMELINE}, gaps AS (SELECT * FROM (SELECT cap, f, bad, last_value(CASE WHEN NOT bad THEN ts END IGNORE NULLS) {BEFORE} AS lo, first_value(CASE WHEN NOT bad THEN ts END IGNORE NULLS) {AFTER} AS hi FROM t) WHERE bad AND lo IS NOT NULL AND hi IS NOT NULL)
    SELECT g.cap, g.f, count(*) AS candidates, min(b.f) AS first, max(b.f) AS last FROM gaps g JOIN t b ON b.cap = g.cap + 1 AND NOT b.bad AND b.ts > g.lo AND b.ts < g.hi GROUP BY g.cap, g.f HAVING max(b.f) - min(b.f) <= 40""",
)
def refine_range_candidates(spark, d):
    return link.refine_candidates(_timeline(spark, d))


@query("W3 F5", f"WITH {TIMELINE}, x AS (SELECT cap, f, abs(value - lag(value) {BY}) AS before, abs(lead(value) {BY} - value) AS after, abs(lead(value) {BY} - lag(value) {BY}) AS across FROM t) SELECT cap, f, round(before, 6) AS before, round(after, 6) AS after, round(across, 6) AS across FROM x WHERE before IS NOT NULL AND after IS NOT NULL AND least(before, after) > 20 AND across < 0.5 * least(before, after)")
def misplaced_outliers(spark, d):
    return timeline.misplaced(_timeline(spark, d))


@query("W1", f"WITH {TIMELINE}, x AS (SELECT kind AS a, lead(kind) {BY} AS b FROM t) SELECT a, b, count(*) AS n FROM x WHERE b IS NOT NULL AND a <> b GROUP BY ALL")
def successor_edges(spark, d):
    return timeline.successor_edges(_timeline(spark, d), F.col("kind"))


@query("W2", f"WITH {TIMELINE} SELECT cap, f, last_value(CASE WHEN NOT bad THEN f END IGNORE NULLS) {BEFORE} AS previous, first_value(CASE WHEN NOT bad THEN f END IGNORE NULLS) {AFTER} AS next FROM t")
def prev_next_known(spark, d):
    return timeline.known_around(_timeline(spark, d))


@query("W4", f"WITH {TIMELINE}, g AS (SELECT cap, f, CASE WHEN f - lag(f) {BY} > 4 THEN 1 ELSE 0 END AS new FROM t WHERE NOT bad), r AS (SELECT *, sum(new) {BY} AS run FROM g), s AS (SELECT cap, run, count(*) AS frames, min(f) AS first, max(f) AS last FROM r GROUP BY ALL) SELECT cap, frames, first, last FROM s QUALIFY row_number() OVER (PARTITION BY cap ORDER BY frames DESC, first) = 1")
def largest_contiguous_run(spark, d):
    return timeline.largest_run(_timeline(spark, d))


@query("W5", f"WITH {TIMELINE}, g AS (SELECT cap, f, f - row_number() {BY} AS island FROM t WHERE value >= 30), s AS (SELECT cap, island, min(f) AS first, count(*) AS frames FROM g GROUP BY ALL HAVING count(*) >= 2) SELECT cap, first, frames, row_number() OVER (PARTITION BY cap ORDER BY frames DESC, first) AS rank FROM s QUALIFY rank <= 8")
def uncovered_runs(spark, d):
    return timeline.runs_above(_timeline(spark, d))


@query("W6", f"WITH {TIMELINE}, x AS (SELECT cap, floor(value)::BIGINT - lag(floor(value)::BIGINT) {BY} AS d FROM t) SELECT cap, count(*) FILTER (d > 1) AS skips, count(*) FILTER (d = 0) AS repeats, count(*) FILTER (abs(d) > 3) AS jumps, min(d) AS least, max(d) AS most FROM x WHERE d IS NOT NULL GROUP BY cap")
def map_deltas(spark, d):
    return timeline.map_deltas(_timeline(spark, d))


@query("W7", f"WITH {TIMELINE} SELECT a.cap, a.f, round(coalesce(quantile_cont(b.value, 0.25), any_value(a.value)), 6) AS trust FROM t a LEFT JOIN t b ON b.cap = a.cap AND b.f BETWEEN a.f - 4 AND a.f + 4 AND b.f <> a.f GROUP BY a.cap, a.f")
def neighbour_trust(spark, d):
    return timeline.neighbour_trust(_timeline(spark, d))


@query(
    "W9",
    f"""WITH {ANCHORS}, n AS (SELECT *, row_number() {BY} AS i, count(*) OVER (PARTITION BY cap) AS n FROM anchors), m AS (SELECT a.cap, a.f, a.g, a.n, list_sort(list(b.g - b.f)) AS s FROM n a JOIN n b ON b.cap = a.cap AND b.i BETWEEN a.i - 3 AND a.i + 3 AND b.i <> a.i GROUP BY ALL)
    SELECT a.cap, a.f, a.g FROM n a LEFT JOIN m USING (cap, f) WHERE a.n < 7 OR m.s IS NULL OR abs((a.g - a.f) - m.s[len(m.s) // 2 + 1]) <= 10""",
)
def smooth_anchors(spark, d):
    return timeline.smooth_anchors(_anchors(_timeline(spark, d)))


@query("K5 W11 K9", f"WITH {TIMELINE} SELECT cap, f, last_value(CASE WHEN NOT bad THEN value END IGNORE NULLS) OVER w AS value, last_value(CASE WHEN NOT bad THEN f END IGNORE NULLS) OVER w AS shown, bad AS missing FROM t WINDOW w AS (PARTITION BY cap ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def freeze_last(spark, d):
    return timeline.freeze_last(_timeline(spark, d))


@query("W14", f"WITH {TIMELINE}, x AS (SELECT cap, f, bad, unnest(range(greatest(0, ceil((f - 29) / 24.0)::BIGINT), f // 24 + 1)) AS w FROM t) SELECT cap, w AS window, count(*) AS frames, count(*) FILTER (f >= w * 24 + CASE WHEN w = 0 THEN 0 ELSE 3 END AND f < w * 24 + 27) AS core, min(f) AS first, max(f) AS last, count(*) FILTER (bad) AS bad FROM x GROUP BY ALL")
def sliding_core_windows(spark, d):
    return timeline.sliding_windows(_timeline(spark, d))


@query("W15", f"WITH {TIMELINE}, n AS (SELECT cap, max(f) + 1 AS n FROM t GROUP BY cap), w AS (SELECT cap, n, unnest(range(0, (n - 1) // 24 + 1)) AS w FROM n) SELECT w.cap, w.w AS window, coalesce(min(f) FILTER (f >= w.w * 24), any_value(n)) AS k0, coalesce(min(f) FILTER (f >= (w.w + 1) * 24), any_value(n)) AS k1 FROM w JOIN t ON t.cap = w.cap AND NOT t.bad GROUP BY ALL")
def core_ranges(spark, d):
    return timeline.core_ranges(_timeline(spark, d))


@query("W10", f"WITH {TIMELINE}, x AS (SELECT *, f - sum(bad::INT) OVER (PARTITION BY cap ORDER BY f) AS position FROM t) SELECT cap, f, position::BIGINT AS position FROM x WHERE NOT bad")
def rebased_positions(spark, d):
    return timeline.rebased(_timeline(spark, d))


@query(
    "T2 J13 S12",
    f"""WITH {AROUND}, e AS (SELECT cap, arg_min(f, f) AS fa, arg_min(value, f) AS va, arg_max(f, f) AS fz, arg_max(value, f) AS vz FROM t WHERE NOT bad GROUP BY cap)
    SELECT cap, f, round(CASE WHEN NOT bad THEN value WHEN j1 IS NULL THEN va - (fa - f) * ((vz - va) / greatest(fz - fa, 1)) WHEN j2 IS NULL THEN vz + (f - fz) * ((vz - va) / greatest(fz - fa, 1)) ELSE v1 + (v2 - v1) * (f - j1) / (j2 - j1) END, 6) AS position FROM around LEFT JOIN e USING (cap)""",
)
def interpolated_position(spark, d):
    return timeline.interpolated_position(_timeline(spark, d))


@query("S4", f"WITH {TIMELINE} SELECT cap, f, event_id FROM t WHERE f BETWEEN 10 AND 29")
def clip_range(spark, d):
    """A range of frames of every capture (the feature is the range)."""
    return timeline.clip(_timeline(spark, d), 10, 20).select("cap", "f", "event_id")


@query("T6", f"WITH {TIMELINE}, n AS (SELECT cap, max(f) AS last FROM t GROUP BY cap) SELECT DISTINCT cap, f, event_id FROM t JOIN n USING (cap), range(8) r(i) WHERE f = floor(i * last / 7.0)")
def linspace_sample(spark, d):
    """Frames at even distances (a sampling operator)."""
    return timeline.sample_frames(_timeline(spark, d)).select("cap", "f", "event_id")


@query("F7", f"WITH {READS} SELECT frame, slot, read, quality::BIGINT AS quality FROM reads")
def quality_rank(spark, d):
    return fuse.quality(_reads(spark, d)).select("frame", "slot", "read", "quality")


@query("T4", f"WITH {RANKED} SELECT * FROM ranks")
def source_order(spark, d):
    return fuse.source_order(_reads(spark, d))


@query("T5", f"WITH {READS}, b AS (SELECT frame, slot, count(*) AS reads, max({{'quality': quality, 'back': -read, 'value': value}}) AS b FROM reads GROUP BY ALL) SELECT frame, slot, reads, -b.back AS read, b.quality::BIGINT AS quality, b.value AS value FROM b")
def best_source_per_slot(spark, d):
    return fuse.best_source(_reads(spark, d))


@query("M1", f"WITH {MERGED} SELECT * FROM merged")
def merge_frames(spark, d):
    return fuse.merge_frames(_reads(spark, d))


@query("A4", f"WITH {MERGED} SELECT how, count(*) AS slots, count(DISTINCT frame) AS frames FROM merged GROUP BY how")
def merge_report(spark, d):
    return fuse.merge_report(fuse.merge_frames(_reads(spark, d)))


@query("A4", f"WITH {MERGED}, x AS (SELECT *, lag(read) OVER (PARTITION BY frame ORDER BY slot) AS before FROM merged) SELECT frame, count(*) FILTER (before <> read) AS flips, count(*) AS slots FROM x GROUP BY frame")
def canvas_flips(spark, d):
    return fuse.canvas_flips(fuse.merge_frames(_reads(spark, d)))


@query(
    "G6",
    f"""WITH {ANCHORS}, x AS (SELECT cap, f, g, lead(f) {BY} AS f1, lead(g) {BY} AS g1 FROM anchors), y AS (SELECT *, f1 - f - 1 AS ga, greatest(g1 - g - 1, 0) AS gb FROM x WHERE f1 IS NOT NULL), n AS (SELECT cap, max(f) + 1 AS n FROM t GROUP BY cap)
    SELECT cap, f, f1, ga, gb, CASE WHEN gb = 0 THEN 'keep' WHEN ga = 0 THEN 'insert' WHEN gb > 40 THEN 'keep' ELSE 'pair' END AS rule, CASE WHEN gb > 0 AND ga = 0 THEN gb ELSE 0 END AS inserted, n FROM y JOIN n USING (cap)""",
)
def gap_policy(spark, d):
    t = _timeline(spark, d)
    return fuse.gap_policy(t, _anchors(t))


@query("J15", f"WITH {TIMELINE} SELECT b.cap - 1 AS cap, b.f AS g, b.kind FROM t b WHERE NOT b.bad AND NOT EXISTS (SELECT 1 FROM t a WHERE a.cap = b.cap - 1 AND NOT a.bad AND a.kind = b.kind AND a.f >= b.f AND a.f < b.f + 60)")
def gap_anti_join(spark, d):
    return fuse.gap_anti_join(_timeline(spark, d))


@query("G7", f"WITH {AROUND} SELECT cap, f, value, round(1.5 * greatest(v1, v2) + 5.0, 6) AS limit, value > 1.5 * greatest(v1, v2) + 5.0 AS dropped FROM around WHERE bad AND v1 IS NOT NULL AND v2 IS NOT NULL")
def orphan_drop(spark, d):
    return fuse.orphan_drop(_timeline(spark, d))


@query("J10", f"WITH {NEAREST} SELECT cap, f, source FROM nearest")
def nearest_healthy_source(spark, d):
    return fuse.nearest_source(_timeline(spark, d))


@query("M3", f"WITH {AROUND} SELECT cap, f, CASE WHEN f - j1 <= j2 - f THEN j1 ELSE j2 END AS near, round((v2 - v1) * abs(f - CASE WHEN f - j1 <= j2 - f THEN j1 ELSE j2 END) / (j2 - j1), 6) AS move FROM around WHERE bad AND j1 IS NOT NULL AND j2 IS NOT NULL")
def bridge_estimate(spark, d):
    return fuse.bridge(_timeline(spark, d))


@query("M4 M5", f"WITH {AROUND} SELECT cap, f, round(CASE WHEN f - j1 < 10 AND j2 - f < 10 THEN (1 - (f - j1) / (j2 - j1)::DOUBLE) * v1 + (f - j1) / (j2 - j1)::DOUBLE * v2 END, 6) AS value FROM around WHERE bad")
def lerp_impute(spark, d):
    return fuse.lerp(_timeline(spark, d))


CONCEALED = f"""{NEAREST}, c AS (SELECT *, CASE WHEN source = j1 THEN v1 WHEN source = j2 THEN v2 END AS candidate, abs(v2 - v1) AS score FROM nearest),
concealed AS (SELECT cap, f, source, CASE WHEN candidate IS NULL THEN 'none' WHEN coalesce(score, 0) <= 20 THEN 'copied' WHEN abs(value - candidate) > 3 * greatest(score, 4) THEN 'outlier' ELSE 'rejected' END AS how, value AS own, candidate FROM c),
filled AS (SELECT cap, f, source, how, CASE WHEN how IN ('copied', 'outlier') THEN candidate ELSE own END AS value FROM concealed)"""


@query("M2", f"WITH {CONCEALED} SELECT * FROM filled")
def conceal_sequence(spark, d):
    return fuse.conceal(_timeline(spark, d))


@query("A5", f"WITH {CONCEALED} SELECT how, count(*) AS frames, count(DISTINCT cap) AS caps FROM filled GROUP BY how")
def conceal_report(spark, d):
    return fuse.conceal_report(fuse.conceal(_timeline(spark, d)))


@query("M6 F9", f"WITH {CONCEALED}, r AS (SELECT c.*, b.value AS ref FROM filled c LEFT JOIN t b ON b.cap = c.cap + 1 AND b.f = c.f AND NOT b.bad) SELECT cap, f, CASE WHEN how IN ('none', 'rejected') AND abs(ref - value) <= 30 THEN 'reference' ELSE how END AS how, CASE WHEN how IN ('none', 'rejected') AND abs(ref - value) <= 30 THEN ref ELSE value END AS value FROM r")
def reference_rescue(spark, d):
    t = _timeline(spark, d)
    return fuse.reference_rescue(fuse.conceal(t), t.where(~F.col("bad")).withColumn("cap", F.col("cap") - 1))
