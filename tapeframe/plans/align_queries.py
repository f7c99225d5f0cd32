"""Queries of signatures, components, orders and record fields, and the same in DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeframe.functions import bits, blocks, segments
from tapeframe.operators import align, link, sequence, tape
from tapeframe.plans.link_queries import FEW, VERIFIED, _blocks, _timeline
from tapeframe.plans.registry import query, read

SIG = """sig AS (SELECT label::BIGINT AS seq, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS f, embedding::DOUBLE[] AS s FROM embeddings),
norm AS (SELECT seq, f, list_avg(s) AS mean, list_transform(s, lambda x: x - list_avg(s)) AS c FROM sig), ref AS (SELECT seq, f, mean, greatest(sqrt(list_sum(list_transform(c, lambda x: x * x))), 1e-6) AS norm, c FROM norm)"""
CORR = f"""{SIG}, qs AS (SELECT seq, f, list_transform(s, lambda x: x * 0.95::DOUBLE + 4) AS s FROM sig), qc AS (SELECT seq, f, list_transform(s, lambda x: x - list_avg(s)) AS c FROM qs),
qn AS (SELECT seq, f, c, greatest(sqrt(list_sum(list_transform(c, lambda x: x * x))), 1e-6) AS norm FROM qc),
corr AS (SELECT q.seq, q.f, r.f AS v, list_dot_product(q.c, r.c) / (q.norm * r.norm) AS corr FROM qn q JOIN ref r ON r.seq = q.seq AND r.f BETWEEN q.f - 6 AND q.f + 6),
cut AS (SELECT seq, f, quantile_cont(1 - corr, 0.9) AS cut FROM corr GROUP BY ALL), cost AS (SELECT seq, f, v, least(1 - corr, cut) AS cost FROM corr JOIN cut USING (seq, f))"""


def _sig(spark, d):
    return align.of_embeddings(read(spark, d, "embeddings"))


def _corr(spark, d):
    s = _sig(spark, d)
    return align.banded(s, align.queries_of(s))


@query("P24", f"WITH {SIG} SELECT seq, f, round(mean, 6) AS mean, round(norm, 6) AS norm, round(c[1] / norm, 6) AS first, round(c[64] / norm, 6) AS last FROM ref")
def normalize_signature(spark, d):
    return align.normalized(_sig(spark, d)).select("seq", "f", "mean", "norm", F.col("sig")[0].alias("first"), F.col("sig")[63].alias("last"))


@query("J12", f"WITH {CORR} SELECT seq, f, v, round(corr, 6) AS corr FROM corr")
def band_correlation(spark, d):
    return _corr(spark, d)


@query("J12 G4", f"WITH {CORR} SELECT seq, f, v, round(corr, 6) AS corr, corr >= 0.9 AS anchor FROM corr QUALIFY row_number() OVER (PARTITION BY seq, f ORDER BY round(corr, 9) DESC, v) = 1")
def anchor_argmax(spark, d):
    return align.anchor_argmax(_corr(spark, d))


@query("W13", f"WITH {CORR} SELECT seq, f, v, round(cost, 6) AS cost FROM cost")
def banded_cost(spark, d):
    return align.winsorized_cost(_corr(spark, d))


@query(
    "W12",
    f"""WITH {CORR}, best AS (SELECT seq, f, v, cost FROM cost QUALIFY row_number() OVER (PARTITION BY seq, f ORDER BY round(cost, 9), v) = 1)
    SELECT b.seq, b.f, b.v, round(b.cost, 6) AS cost, round(min(c.cost) - b.cost, 6) AS margin FROM best b LEFT JOIN cost c ON c.seq = b.seq AND c.f = b.f AND abs(c.v - b.v) > 3 GROUP BY b.seq, b.f, b.v, b.cost""",
)
def band_margin(spark, d):
    return align.margins(align.winsorized_cost(_corr(spark, d)))


@query("G3")
def viterbi_align(spark, d):
    return sequence.viterbi_align(align.winsorized_cost(_corr(spark, d)))


@query("T7 G4")
def max_weight_subsequence(spark, d):
    return sequence.max_weight_subsequence(align.anchor_argmax(_corr(spark, d), 0.3))


@query("G1", f"WITH RECURSIVE {VERIFIED}, e AS (SELECT frame AS a, frame2 AS b FROM matched UNION SELECT frame2, frame FROM matched), reach(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b) SELECT a, min(b) AS component FROM reach GROUP BY a")
def plain_components(spark, d):
    m = link.first_verified(_blocks(spark, d), **FEW).select(F.col("frame").alias("a"), F.col("frame2").alias("b"))
    return sequence.plain_components(spark, m)


@query("A3", f"WITH RECURSIVE {VERIFIED}, e AS (SELECT frame AS a, frame2 AS b FROM matched UNION SELECT frame2, frame FROM matched), reach(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a), s AS (SELECT c, count(*) AS size FROM c GROUP BY c) SELECT size, count(*) AS clusters FROM s GROUP BY size")
def index_stats(spark, d):
    """How many components there are of each size."""
    return plain_components(spark, d).groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))


@query("G1 G2")
def constrained_components(spark, d):
    m = link.first_verified(_blocks(spark, d), **FEW).select(F.col("frame").alias("a"), F.col("cap").alias("cap_a"), F.col("frame2").alias("b"), F.col("cap2").alias("cap_b"), "votes")
    m = m.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.when(F.col("a") <= F.col("b"), F.col("cap_a")).otherwise(F.col("cap_b")).alias("cap_x"), F.when(F.col("a") <= F.col("b"), F.col("cap_b")).otherwise(F.col("cap_a")).alias("cap_y"), "votes").distinct()
    m = m.select(F.col("x").alias("a"), F.col("cap_x").alias("cap_a"), F.col("y").alias("b"), F.col("cap_y").alias("cap_b"), "votes")
    return sequence.constrained_components(m, sequence.plain_components(spark, m.select("a", "b"))).drop("component", "refused")


@query("G3 G4 J12 T7 W12 W13")
def reference_alignment(spark, d):
    """A second recording with lost, repeated and blind frames, aligned with the first; ``right``: found where it was taken."""
    again = align.second_recording(_sig(spark, d)).cache()
    found = align.aligned(_sig(spark, d), again.drop("truth"), band=20, every=4)
    return found.join(again.select("seq", "f", "truth"), ["seq", "f"]).select("seq", "f", "v", "cost", "margin", (F.col("v") == F.col("truth")).alias("right"))


def _tape(spark, d):
    """Documents of a source as the frames of a capture, in windows of 200 ids; blank lines are the bad blocks."""
    b = _blocks(spark, d)
    bad = (~link.healthy()).cast("long")
    reads = b.groupBy("cap", "frame").agg(F.sum(bad).alias("n_bad"), F.count("*").alias("n_blocks")).withColumn("window", F.floor(F.col("frame") / 200).cast("long"))
    return tape.build_index(spark, b, reads, **FEW)


@query("G2 J5 F4")
def tape_index(spark, d):
    return _tape(spark, d)[0]


@query("A3 G2")
def tape_index_stats(spark, d):
    return _tape(spark, d)[1]


@query("T3 T2")
def topo_order(spark, d):
    """Clusters of three captures at a time: the n-th event of a kind is one cluster."""
    t = _timeline(spark, d)
    n = F.row_number().over(W.partitionBy("cap", "kind").orderBy("f"))
    cluster = F.concat_ws(":", "kind", n.cast("string"))
    reads = t.select(F.floor(F.col("cap") / 3).cast("long").alias("window"), F.abs(F.xxhash64(cluster)).alias("cluster"), "cap", "f")
    return sequence.ordered(spark, reads)


@query("W8")
def canvas_hysteresis(spark, d):
    rows = read(spark, d, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 64).cast("long").alias("window"), F.col("l_orderkey").alias("pos"), F.col("l_linenumber").cast("long").alias("read")).agg(F.min("l_quantity").cast("long").alias("n_bad"))
    return sequence.canvas_hysteresis(rows)


def _candidates(spark, d, reach=6):
    """Healthy frames of one kind at most ``reach`` frames apart; buckets of that width make the range an equality."""
    t = _timeline(spark, d).where("not bad").withColumn("bucket", F.floor(F.col("f") / (reach + 1)).cast("long"))
    donor = t.select((F.col("cap") - 1).alias("cap"), F.col("f").alias("g"), "kind", F.explode(F.array(F.col("bucket") - 1, "bucket", F.col("bucket") + 1)).alias("bucket"))
    return t.select("cap", "f", "kind", "bucket").join(donor, ["cap", "kind", "bucket"]).where(F.abs(F.col("f") - F.col("g")) <= reach).select("cap", "f", "g", F.abs(F.col("f") - F.col("g")).alias("away"))


@query("J8")
def monotone_anchors(spark, d):
    return sequence.monotone_anchors(_candidates(spark, d))


@query("J7")
def one_to_one_pairs(spark, d):
    return sequence.one_to_one(_candidates(spark, d))


@query("J6")
def tracked_pairs(spark, d):
    return sequence.tracked_pairs(_candidates(spark, d))


@query("M9 A19")
def fitted_segments(spark, d):
    k = F.row_number().over(W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"))
    # Dealt once, by segment: its windows need no other exchange.
    items = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").repartition("l_orderkey")
    words = items.select(F.col("l_orderkey").alias("segment"), F.col("l_linenumber").cast("long").alias("block"), k.cast("long").alias("k"), F.col("l_quantity").cast("long").alias("bits"))
    return sequence.fitted_segments(words)


@query("A19", "SELECT l_orderkey AS segment, l_linenumber::BIGINT AS block, sum(l_quantity)::BIGINT AS bits, greatest(3040 - (sum(sum(l_quantity)) OVER (PARTITION BY l_orderkey) - sum(l_quantity)), 0)::BIGINT AS budget FROM lineitem GROUP BY l_orderkey, l_linenumber")
def segment_budget(spark, d):
    """Bits of each block, and what the others leave it of a segment's capacity."""
    s = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("segment"), F.col("l_linenumber").alias("block")).agg(F.sum("l_quantity").cast("long").alias("bits"))
    return s.withColumn("budget", F.greatest(3040 - (F.sum("bits").over(W.partitionBy("segment")) - F.col("bits")), F.lit(0)))


@query("P1 P2 P3 P4 J17", "WITH w AS (SELECT i AS word, i // 256 * 2 + i % 256 // 128 AS x, i % 256 AS low, i // 256 AS high FROM range(65536) r(i)) SELECT word, CASE WHEN x >= 256 THEN x - 512 ELSE x END AS dc, low // 64 % 2 AS mode, low // 16 % 4 AS cls, high // 16 AS sta, high % 16 AS qno FROM w")
def bytes_to_fields(spark, d):
    """All pairs of bytes."""
    w = spark.range(65536).select(F.col("id").alias("word"), F.shiftright("id", 8).cast("int").alias("high"), F.col("id").bitwiseAND(255).cast("int").alias("low"))
    return w.select("word", *bits.fields(F.col("high"), F.col("low")))


@query("P5", "SELECT l_orderkey AS frame, round(avg(l_quantity), 6) AS luma FROM lineitem GROUP BY l_orderkey")
def luma_mean(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("frame")).agg(F.avg("l_quantity").alias("luma"))


BCD = "((({0}) // 10) * 16 + ({0}) % 10)"
HEX = "lpad(upper(to_hex(({0})::BIGINT)), 2, '0')"


def _pack_sql(i: str) -> str:
    b = BCD.format
    parts = [b(f"{i} % 25"), f"{b(f'{i} // 25 % 60')} + 128", f"{b(f'{i} // 1500 % 60')} + 128", f"{b(f'{i} // 90000 % 24')} + 192"]
    return "'13' || " + " || ".join(HEX.format(p) for p in parts)


@query("P8", f"SELECT event_id, {_pack_sql('event_id')} AS pack FROM events")
def timecode_pack(spark, d):
    return read(spark, d, "events").select("event_id", bits.timecode_pack(F.col("event_id")).alias("pack"))


@query("P27", f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'AA' || {_pack_sql('event_id')} || 'FFFFFF' ELSE 'AA0102030405FFFFFF' END AS payload, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS written FROM events")
def timecode_rewrite(spark, d):
    """Records of which every third holds a time."""
    raw = F.unhex(F.when(F.col("event_id") % 3 == 0, "AA1302030405FFFFFF").otherwise("AA0102030405FFFFFF"))
    rows = read(spark, d, "events").select("event_id", raw.alias("payload"))
    out, written = bits.rewrite_timecode("payload", [1], bits.timecode_pack(F.col("event_id")))
    return rows.select("event_id", F.hex(out).alias("payload"), written.alias("written"))


@query("S3", "WITH b AS (SELECT i AS blk, i // 150 AS sequence, i % 150 - 6 AS p FROM range(1800) r(i)), k AS (SELECT *, CASE WHEN p < 0 THEN 'header' WHEN p % 16 = 0 THEN 'audio' ELSE 'video' END AS kind FROM b) SELECT blk, sequence, kind, blk * 80 AS offset, CASE WHEN kind <> 'header' THEN row_number() OVER (PARTITION BY kind ORDER BY blk) - 1 END AS ordinal, CASE WHEN kind = 'video' THEN (row_number() OVER (PARTITION BY kind ORDER BY blk) - 1) // 5 END AS segment FROM k")
def profile_blocks(spark, d):
    return bits.blocks_of_profile(spark)


@query("A20", "SELECT count(*) AS checked, 0::BIGINT AS mismatches FROM range(65536)")
def calibration(spark, d):
    """Fields of every pair of bytes put together again."""
    f = bytes_to_fields(spark, d)
    dc = F.when(F.col("dc") < 0, F.col("dc") + 512).otherwise(F.col("dc"))
    high = F.shiftright(dc.cast("int"), 1)
    low = F.shiftleft(dc.cast("int").bitwiseAND(1), 7).bitwiseOR(F.shiftleft(F.col("mode").cast("int"), 6)).bitwiseOR(F.shiftleft(F.col("cls").cast("int"), 4)).bitwiseOR(F.col("word").cast("int").bitwiseAND(15))
    return f.agg(F.count("*").alias("checked"), F.count_if((high * 256 + low != F.col("word")) | (F.col("sta") * 16 + F.col("qno") != high)).alias("mismatches"))


LEVELS = "x AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: round_even(v * 8, 0)::INT) AS l FROM embeddings)"


@query("P9 A16", f"WITH {LEVELS} SELECT vec_id, len(list_filter(l, lambda v: v <> 0)) AS nnz, list_sum(list_transform(l, lambda v: abs(v)))::BIGINT AS energy, coalesce(list_max(list_filter(list_transform(l, lambda v, i: CASE WHEN v <> 0 THEN i - 1 END), lambda i: i IS NOT NULL)), -1)::BIGINT AS maxpos, len(list_filter(l, lambda v: v <> 0)) AS runs, true AS same FROM x")
def run_levels(spark, d):
    """Quantized signatures as runs, and expanded again."""
    x = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e")).withColumn("l", bits.levels("e", 0.125)).withColumn("r", bits.run_levels("l"))
    return x.select("vec_id", bits.nonzero("l").alias("nnz"), bits.energy("l").alias("energy"), bits.last_nonzero("l").alias("maxpos"), F.size("r").alias("runs"), (bits.expand_runs("r") == F.col("l")).alias("same"))


BASIS = "k AS (SELECT u.u, x.x, CASE WHEN u.u = 0 THEN sqrt(0.125::DOUBLE) ELSE 0.5 END * cos((2 * x.x + 1) * u.u * pi() / 16) AS w FROM range(8) u(u), range(8) x(x))"
PIXELS = "px AS (SELECT vec_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, v FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) * 100 AS v, unnest(range(1, 65)) AS i FROM embeddings))"
DCT = f"{BASIS}, {PIXELS}, rows_ AS (SELECT vec_id, y, u, sum(v * w) AS v FROM px JOIN k USING (x) GROUP BY ALL), dct AS (SELECT vec_id, k.u AS u, r.u AS v, sum(r.v * w) AS c FROM rows_ r JOIN k ON k.x = r.y GROUP BY ALL)"


def _pixels(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 100).alias("px"))


@query("P13 P11", f"WITH {DCT} SELECT vec_id, u, v, round(c, 4) AS c FROM dct")
def forward_dct(spark, d):
    x = _pixels(spark, d).select("vec_id", F.posexplode(blocks.forward("px")).alias("k", "c"))
    return x.select("vec_id", F.floor(F.col("k") / 8).alias("u"), (F.col("k") % 8).alias("v"), F.round("c", 4).alias("c"))


@query("P11", f"WITH {PIXELS} SELECT vec_id, y, x, round(v, 4) AS px FROM px")
def inverse_dct(spark, d):
    """Transformed and transformed back."""
    x = _pixels(spark, d).withColumn("c", blocks.forward("px")).select("vec_id", F.posexplode(blocks.inverse("c")).alias("k", "v"))
    return x.select("vec_id", F.floor(F.col("k") / 8).alias("y"), (F.col("k") % 8).alias("x"), F.round("v", 4).alias("px"))


@query(
    "P14 P16",
    f"""WITH {DCT}, s AS (SELECT vec_id, list([count_over.a, count_over.b, count_over.c, count_over.d]) AS z FROM (SELECT vec_id, count(*) FILTER (abs(round_even(c, 0)) > 255) AS a, count(*) FILTER (abs(round_even(c / 2, 0)) > 255) AS b, count(*) FILTER (abs(round_even(c / 4, 0)) > 255) AS c, count(*) FILTER (abs(round_even(c / 8, 0)) > 255) AS d FROM dct GROUP BY vec_id) count_over GROUP BY vec_id)
    SELECT s.vec_id, (list_position(z[1], list_min(z[1])) - 1)::BIGINT AS cls, greatest(least(round_even((d.c - 1024) / 4, 0), 255), -256)::BIGINT AS dc, list_min(z[1])::BIGINT AS saturated FROM s JOIN dct d ON d.vec_id = s.vec_id AND d.u = 0 AND d.v = 0""",
)
def encode_block(spark, d):
    return blocks.encoded(_pixels(spark, d).withColumn("c", blocks.forward("px")), "c").select("vec_id", "cls", "dc", "saturated")


@query("P12", f"WITH {PIXELS}, k AS (SELECT vec_id // 4 AS unit FROM embeddings GROUP BY unit HAVING count(*) = 4 AND count(*) FILTER (vec_id % 7 = 0) = 0) SELECT vec_id // 4 AS unit, y + vec_id % 4 // 2 * 8 AS y, x + vec_id % 2 * 8 AS x, round(v, 4) AS px FROM px WHERE vec_id // 4 IN (SELECT unit FROM k)")
def unit_pixels(spark, d):
    """Four blocks as 16 x 16; every seventh block is in field mode, and its unit has no pixels."""
    rows = _pixels(spark, d).select(F.floor(F.col("vec_id") / 4).alias("unit"), (F.col("vec_id") % 4).alias("place"), "px", (F.col("vec_id") % 7 == 0).cast("int").alias("mode"))
    x = blocks.assembled(rows, "unit", "place", "px", "mode").select("unit", F.posexplode("px").alias("k", "v"))
    return x.select("unit", F.floor(F.col("k") / 16).alias("y"), (F.col("k") % 16).alias("x"), F.round("v", 4).alias("px"))


@query("B1 B2 B5 A16")
def segment_round_trip(spark, d):
    """Every order's hashes as a segment of 400 bytes: read, counted, and packed again."""
    digests = F.concat(*(F.unhex(F.sha2(F.concat_ws(":", "o_orderkey", F.lit(k)), 512)) for k in range(7)))
    # A table of few files is few tasks: the keys are dealt before the segments are made of them.
    keys = read(spark, d, "orders").select("o_orderkey").repartition(4 * spark.sparkContext.defaultParallelism, "o_orderkey")
    return segments.scan(keys.select("o_orderkey", F.substring(digests, 1, segments.SEGMENT_BYTES).alias("payload")), "o_orderkey", "payload", segments.Code.sample())


@query("P7", "SELECT l_partkey AS probe FROM (SELECT DISTINCT l_partkey, md5(l_partkey::VARCHAR || ':seed') AS h FROM lineitem) ORDER BY h, l_partkey LIMIT 162")
def probe_set(spark, d):
    """A seeded draw of 162 columns without replacement (a sampling operator)."""
    return read(spark, d, "lineitem").select(F.col("l_partkey").alias("probe")).distinct().orderBy(F.md5(F.concat(F.col("probe").cast("string"), F.lit(":seed")).cast("binary")), "probe").limit(162)


@query("G5", "WITH b AS (SELECT i AS blk, (i * 7 + 3) % 1620 AS place FROM range(1620) r(i)), p AS (SELECT blk, sum(((place >> k) & 1) << k)::BIGINT AS found FROM b, range(11) q(k) GROUP BY blk) SELECT blk, found FROM p")
def screen_permutation(spark, d):
    """Group testing: bit planes in which a block shows spell its place (a known permutation stands for the picture)."""
    b = spark.range(1620).select(F.col("id").alias("blk"), ((F.col("id") * 7 + 3) % 1620).alias("place"), F.explode(F.sequence(F.lit(0), F.lit(10))).alias("plane"))
    return b.withColumn("shown", F.expr("shiftright(place, plane) & 1")).groupBy("blk").agg(F.sum(F.expr("shiftleft(shown, plane)")).alias("found"))


SHIFTS = "[" + ", ".join(str(row) for row in bits.QUANTIZER_SHIFTS) + "]"
AREAS = [sum(k >= e for e in bits.AREA_ENDS) for k in range(64)]


@query(
    "P10",
    f"SELECT q AS qno, c AS cls, m AS mode, k, (CASE WHEN m = 0 THEN 64 - k ELSE 64 + k END)::BIGINT * (1::BIGINT << ({SHIFTS}[greatest(least(q + {bits.QUANTIZER_OFFSETS}[c + 1], 21), 0) + 1][{AREAS}[k + 1] + 1] + 1 + CASE WHEN c = 3 THEN 1 ELSE 0 END)) AS factor FROM range(16) a(q), range(4) b(c), range(2) e(m), range(64) d(k)",
)
def factor_table(spark, d):
    """Factors of all quantizers, classes and modes over falling and rising weights (weights are a parameter)."""
    return bits.factor_table(spark, [[64 - k for k in range(64)], [64 + k for k in range(64)]], AREAS, bits.QUANTIZER_SHIFTS, bits.QUANTIZER_OFFSETS)


@query("P15", f"WITH {LEVELS}, p AS (SELECT vec_id, list_filter(list_transform(l, lambda v, i: CASE WHEN v <> 0 THEN i END), lambda i: i IS NOT NULL) AS places FROM x), g AS (SELECT vec_id, unnest(list_transform(places, lambda i, k: i - CASE WHEN k > 1 THEN places[k - 1] ELSE 0 END - 1)) AS run FROM p) SELECT vec_id, count(*) + sum(run // 3)::BIGINT AS words, sum(run // 3)::BIGINT AS skips FROM g GROUP BY vec_id")
def run_split(spark, d):
    """Words of quantized signatures when runs of three zeros and more are split."""
    x = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e")).withColumn("l", bits.levels("e", 0.125)).withColumn("r", bits.run_levels("l"))
    x = x.where(F.size("r") > 0).withColumn("s", bits.split_runs("r", 3))
    return x.select("vec_id", F.size("s").alias("words"), F.size(F.filter("s", lambda w: w["level"] == 0)).alias("skips"))
