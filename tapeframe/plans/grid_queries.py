"""Queries of damage reports and of grids, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeframe.operators import fuse, grid, link, quality
from tapeframe.plans.link_queries import AROUND, BY, MERGED, READS, TIMELINE, _reads, _timeline
from tapeframe.plans.registry import query, read

STATES = f"{READS}, seg AS (SELECT *, slot // 5 AS segment FROM reads), states AS (SELECT frame, slot, read, segment, CASE WHEN bad THEN 1 WHEN max(bad) OVER (PARTITION BY frame, segment) THEN 3 WHEN false_ok THEN 2 ELSE 0 END::BIGINT AS state FROM seg)"
GRID = "g AS (SELECT l_linenumber::BIGINT AS frame, l_partkey % 36 AS r, l_suppkey % 45 AS c, avg(l_quantity) AS dc, count(*) FILTER (l_returnflag = 'R') * 2 < count(*) AS ok FROM lineitem GROUP BY ALL)"
PAIRS = f"{GRID}, p AS (SELECT a.frame, a.r, a.c, a.dc AS y, b.dc AS x FROM g a JOIN g b ON b.frame = a.frame + 1 AND b.r = a.r AND b.c = a.c WHERE a.ok AND b.ok)"
SEAM = f"""{GRID}, st AS (SELECT frame, r, c, r // 4 AS br, c // 4 AS bc, abs(dc - lag(dc) OVER v) AS up, abs(lead(dc, 1) OVER v - lead(dc, 2) OVER v) AS up_in, abs(dc - lag(dc) OVER h) AS lf, abs(lead(dc, 1) OVER h - lead(dc, 2) OVER h) AS lf_in,
    abs(dc - lead(dc) OVER h) AS rt, abs(lag(dc, 2) OVER h - lag(dc, 1) OVER h) AS rt_in FROM g WINDOW v AS (PARTITION BY frame, c ORDER BY r), h AS (PARTITION BY frame, r ORDER BY c)),
seam AS (SELECT frame, br, bc, coalesce(greatest(avg(up) FILTER (r % 4 = 0) / CASE WHEN avg(up_in) FILTER (r % 4 = 0) > 1 THEN avg(up_in) FILTER (r % 4 = 0) ELSE 1 END, avg(lf) FILTER (c % 4 = 0) / CASE WHEN avg(lf_in) FILTER (c % 4 = 0) > 1 THEN avg(lf_in) FILTER (c % 4 = 0) ELSE 1 END,
    avg(rt) FILTER (c % 4 = 3) / CASE WHEN avg(rt_in) FILTER (c % 4 = 3) > 1 THEN avg(rt_in) FILTER (c % 4 = 3) ELSE 1 END), 0) AS seam FROM st GROUP BY frame, br, bc)"""
BLOCKINESS = f"{SEAM}, blk AS (SELECT a.frame, a.br, a.bc, median(b.seam) AS blockiness FROM seam a JOIN seam b ON b.frame = a.frame AND b.br BETWEEN a.br - 2 AND a.br + 2 AND b.bc BETWEEN a.bc - 2 AND a.bc + 2 GROUP BY ALL)"
FIT = "fit AS (SELECT frame, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, count(*) AS n FROM p GROUP BY frame)"
DISAGREE = f"""{FIT}, res AS (SELECT frame, r // 4 AS br, c // 4 AS bc, r // 2 AS sr, c // 2 AS sc, y - a * x - b AS d FROM p JOIN fit USING (frame) WHERE n >= 300),
sm AS (SELECT frame, br, bc, sr, sc, avg(d) AS m, sum(d * d) AS q, count(*) AS n FROM res GROUP BY ALL),
dis AS (SELECT frame, br, bc, sqrt(avg(m * m)) AS low, sqrt(sum(q) / sum(n)) AS high, sum(n)::BIGINT AS cells FROM sm GROUP BY frame, br, bc HAVING sum(n) >= 6.4)"""


def _grid(spark, d):
    return grid.of_lineitem(read(spark, d, "lineitem"))


@query("A1", f"WITH {READS} SELECT frame, count(*) AS units, count(*) FILTER (bad) AS n_bad, count(*) FILTER (false_ok AND NOT bad) AS n_false FROM reads GROUP BY frame")
def damage_counts(spark, d):
    return quality.damage_counts(_reads(spark, d))


@query("F6", f"WITH {STATES} SELECT * FROM states")
def block_state(spark, d):
    return quality.block_state(_reads(spark, d))


@query("A2", f"WITH {STATES} SELECT state, count(*) AS units, count(DISTINCT frame) AS frames FROM states GROUP BY state")
def scan_report(spark, d):
    return quality.scan_totals(quality.block_state(_reads(spark, d)))


@query("A2", f"WITH {STATES} SELECT frame, count(*) FILTER (state = 2) AS n_false, count(*) FILTER (state = 1) AS n_bad, count(*) FILTER (state = 3) AS n_suspect FROM states GROUP BY frame ORDER BY n_false DESC, n_bad DESC, frame DESC LIMIT 10")
def worst_frames(spark, d):
    """The ten worst frames (a top-k report)."""
    return quality.worst_frames(quality.block_state(_reads(spark, d)))


@query("P26 K10", f"WITH {STATES} SELECT frame, 'ok=' || count(*) FILTER (state = 0) || ' bad=' || count(*) FILTER (state = 1) || ' false=' || count(*) FILTER (state = 2) || ' suspect=' || count(*) FILTER (state = 3) AS legend FROM states GROUP BY frame")
def state_legend(spark, d):
    return quality.legend(quality.block_state(_reads(spark, d)))


@query("F4", f"WITH {READS} SELECT frame, count(DISTINCT read) AS reads, count(*) AS units, count(*) FILTER (bad) AS n_bad FROM reads GROUP BY frame HAVING NOT (count(DISTINCT read) = 1 AND count(*) FILTER (bad) >= 0.95::DOUBLE * count(*))")
def drop_empty_filler(spark, d):
    return quality.drop_empty(_reads(spark, d))


@query(
    "A6",
    f"""WITH {AROUND}, e AS (SELECT abs((1 - (f - j1) / (j2 - j1)::DOUBLE) * v1 + (f - j1) / (j2 - j1)::DOUBLE * v2 - value) AS error, abs(v2 - v1) AS score FROM around WHERE NOT bad AND j1 IS NOT NULL AND j2 IS NOT NULL),
    x AS (SELECT unnest([2, 3, 4, 5, 6, 8, 10, 12, 16, 40, 80])::DOUBLE AS threshold)
    SELECT threshold, round(100.0 * count(*) FILTER (score <= threshold) / count(*), 6) AS coverage, round(quantile_cont(error, 0.5) FILTER (score <= threshold), 6) AS median, round(quantile_cont(error, 0.9) FILTER (score <= threshold), 6) AS p90,
    round(100.0 * count(*) FILTER (score <= threshold AND error > 20) / count(*) FILTER (score <= threshold), 6) AS wrong FROM e, x GROUP BY threshold HAVING count(*) FILTER (score <= threshold) >= 20""",
)
def threshold_sweep(spark, d):
    return quality.threshold_sweep(_timeline(spark, d))


@query("A5", "SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.75), 6) AS p75 FROM lineitem GROUP BY l_returnflag")
def quantile_report(spark, d):
    return quality.quantiles(read(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")


@query("W13", "WITH k AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.9) AS cut FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, round(avg(l_extendedprice), 4) AS mean, round(avg(least(l_extendedprice, cut)), 4) AS cut_mean, count(*) FILTER (l_extendedprice > cut) AS n_cut FROM lineitem JOIN k USING (l_suppkey) GROUP BY l_suppkey")
def winsorized_rows(spark, d):
    return quality.winsorized(read(spark, d, "lineitem"), "l_suppkey", "l_extendedprice").withColumns({c: F.round(c, 4) for c in ("mean", "cut_mean")})


@query("F8", f"WITH {TIMELINE}, s AS (SELECT cap, CASE WHEN value < 20 THEN 'covered' WHEN value >= 50 THEN 'uncovered' ELSE 'doubtful' END AS band, count(*) AS frames FROM t GROUP BY ALL) SELECT cap, band, frames, round(frames / sum(frames) OVER (PARTITION BY cap), 6) AS share FROM s")
def coverage_bands(spark, d):
    return quality.coverage_bands(_timeline(spark, d))


@query("A22", f"WITH {TIMELINE}, x AS (SELECT *, abs(value - lag(value) {BY}) AS margin FROM t) SELECT cap, arg_min(value, f) AS first, arg_max(value, f) AS last, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, count(*) FILTER (margin < 1) AS weak, count(*) AS frames FROM x GROUP BY cap")
def refalign_report(spark, d):
    return quality.alignment_report(_timeline(spark, d))


@query("A18", f"WITH {TIMELINE}, m AS (SELECT a.cap, a.bad AS before, a.bad AND NOT coalesce(NOT b.bad, false) AS after FROM t a LEFT JOIN t b ON b.cap = a.cap + 1 AND b.f = a.f), s AS (SELECT cap, count(*) AS frames, count(*) FILTER (before) AS before, count(*) FILTER (after) AS after FROM m GROUP BY cap) SELECT *, round(CASE WHEN before > 0 THEN 100.0 * (before - after) / before END, 6) AS recovered FROM s")
def repair_report(spark, d):
    return quality.repair_report(link.positional_merge(_timeline(spark, d)))


@query(
    "A13",
    f"""WITH {GRID}, s AS (SELECT dr, dcol FROM range(-2, 3) x(dr), range(-4, 5) y(dcol)), m AS (SELECT a.frame, dr, dcol, avg(abs(a.dc - b.dc)) AS error, count(*) AS cells FROM g a, s JOIN g b ON b.frame = a.frame + 1 AND b.r = a.r + dr AND b.c = a.c + dcol WHERE a.ok AND b.ok GROUP BY ALL HAVING count(*) >= 150),
    best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY frame ORDER BY round(error, 9), dr, dcol) = 1), f AS (SELECT DISTINCT frame FROM g)
    SELECT frame, coalesce(dr, 0) AS dr, coalesce(dcol, 0) AS dcol, round(error, 6) AS error, coalesce(cells, 0) AS cells FROM f LEFT JOIN best USING (frame)""",
)
def best_shift(spark, d):
    return grid.best_shift(_grid(spark, d))


@query("J11 M11", f"WITH {GRID} SELECT a.frame, a.r, a.c, round(coalesce(b.dc, 0), 6) AS dc, coalesce(b.ok, false) AS ok FROM g a LEFT JOIN g b ON b.frame = a.frame AND b.r = a.r + 1 AND b.c = a.c - 2")
def shifted_cells(spark, d):
    return grid.shifted(_grid(spark, d), 1, -2)


@query(
    "A12",
    f"""WITH {GRID}, q AS (SELECT a.frame, a.r, a.c, a.ok AND b.ok AS v, CASE WHEN a.ok AND b.ok THEN abs(a.dc - b.dc) END AS d FROM g a JOIN g b ON b.frame = a.frame + 1 AND b.r = a.r AND b.c = a.c), w AS (SELECT unnest([3, 6, 12])::BIGINT AS w)
    SELECT a.frame, a.r, a.c, w.w, count(b.d) AS n, round(avg(b.d), 6) AS motion FROM q a, w JOIN q b ON b.frame = a.frame AND b.r BETWEEN a.r - w.w AND a.r + w.w AND b.c BETWEEN a.c - w.w AND a.c + w.w GROUP BY ALL""",
)
def pair_motion_windows(spark, d):
    return grid.pair_motion(_grid(spark, d))


@query("A14", None)
def block_motion(spark, d):
    return grid.block_motion(_grid(spark, d))


@query("P25", f"WITH {GRID} SELECT frame, r // 4 AS br, c // 4 AS bc, round(avg(dc) + 1e-9, 6) AS mean, round(avg(ok::INT), 6) AS health, count(*) AS cells FROM g GROUP BY ALL")
def block_means(spark, d):
    return grid.block_means(_grid(spark, d)).withColumn("mean", F.col("mean") + 1e-9)  # a tie goes one way in every engine


@query("A11", f"WITH {GRID} SELECT a.frame, a.r, a.c, round(median(b.dc), 6) AS median, count(*) AS cells FROM g a JOIN g b ON b.frame = a.frame AND b.r BETWEEN a.r - 2 AND a.r + 2 AND b.c BETWEEN a.c - 2 AND a.c + 2 GROUP BY ALL")
def local_median(spark, d):
    return grid.local_median(_grid(spark, d))


@query(
    "A9",
    f"""WITH {PAIRS}, q AS (SELECT a.frame, a.r, a.c FROM g a JOIN g b ON b.frame = a.frame + 1 AND b.r = a.r AND b.c = a.c), n AS (SELECT q.frame, q.r, q.c, (p.y - p.x) * (p.y - p.x) AS s, greatest(abs(p.r - q.r), abs(p.c - q.c)) AS away FROM q JOIN p ON p.frame = q.frame AND p.r BETWEEN q.r - 8 AND q.r + 8 AND p.c BETWEEN q.c - 8 AND q.c + 8 WHERE p.r <> q.r OR p.c <> q.c),
    x AS (SELECT frame, r, c, unnest([1, 2, 4, 8]) AS radius, unnest([count(*) FILTER (away <= 1), count(*) FILTER (away <= 2), count(*) FILTER (away <= 4), count(*) FILTER (away <= 8)]) AS n, unnest([sum(s) FILTER (away <= 1), sum(s) FILTER (away <= 2), sum(s) FILTER (away <= 4), sum(s) FILTER (away <= 8)]) AS s FROM n GROUP BY frame, r, c)
    SELECT frame, r, c, radius::BIGINT AS radius, n, round(sqrt(s / n), 6) AS rmse FROM x WHERE n >= 12 OR radius = 8 AND n >= 6 QUALIFY row_number() OVER (PARTITION BY frame, r, c ORDER BY radius) = 1""",
)
def neighbour_rmse(spark, d):
    return grid.neighbour_rmse(_grid(spark, d))


@query("A10", f"WITH {SEAM} SELECT frame, br, bc, round(seam, 6) AS seam FROM seam")
def edge_seam(spark, d):
    return grid.seam(_grid(spark, d))


@query("A11", f"WITH {BLOCKINESS} SELECT frame, br, bc, round(blockiness, 6) AS blockiness FROM blk")
def local_blockiness(spark, d):
    return grid.local_blockiness(grid.seam(_grid(spark, d)))


@query(
    "A7 F10 M12",
    f"""WITH {PAIRS}, {FIT}, res AS (SELECT p.*, a, b, abs(y - a * x - b) AS res FROM p JOIN fit USING (frame) WHERE n >= 400), cut AS (SELECT frame, quantile_cont(res, 0.9) AS cut FROM res GROUP BY frame),
    two AS (SELECT frame, regr_slope(y, x) AS a2, regr_intercept(y, x) AS b2, count(*) AS kept FROM res JOIN cut USING (frame) WHERE res <= cut + 1e-9 GROUP BY frame), o AS (SELECT frame, n, kept, CASE WHEN kept >= 400 THEN a2 ELSE a END AS gain, CASE WHEN kept >= 400 THEN b2 ELSE b END AS offset FROM fit JOIN two USING (frame))
    SELECT frame, n, kept, round(gain, 6) AS gain, round("offset", 6) AS offset, gain BETWEEN 0.8 AND 1.2 AND "offset" BETWEEN -30 AND 30 AS passes FROM o""",
)
def photometric_fit(spark, d):
    return grid.photometric_fit(_grid(spark, d))


@query("A8", f"WITH {PAIRS}, {DISAGREE} SELECT frame, br, bc, round(low, 6) AS low, round(high, 6) AS high, cells FROM dis")
def disagreement(spark, d):
    return grid.disagreement(_grid(spark, d), least=300)


@query(
    "M8 F11",
    f"""WITH {BLOCKINESS}, p AS (SELECT a.frame, a.r, a.c, a.dc AS y, b.dc AS x FROM g a JOIN g b ON b.frame = a.frame + 1 AND b.r = a.r AND b.c = a.c WHERE a.ok AND b.ok), {DISAGREE}, w AS (SELECT * FROM dis JOIN seam USING (frame, br, bc) JOIN blk USING (frame, br, bc)),
    f AS (SELECT frame, median(low) / greatest(quantile_cont(blockiness, 0.75), 0.1) AS ratio FROM w GROUP BY frame), l AS (SELECT *, 20 - 16 * least(greatest((blockiness - 0.9) / 0.6, 0), 1) AS lim FROM w JOIN f USING (frame))
    SELECT frame, br, bc, round(low, 6) AS low, round(high, 6) AS high, round(seam, 6) AS seam, round(blockiness, 6) AS blockiness, round(lim, 6) AS limit, round(ratio, 6) AS ratio, ratio <= 2.5 AND low > lim AND NOT (high > 6 AND low < 0.6 * high AND seam < 1.6) AS flagged FROM l""",
)
def guarded_flags(spark, d):
    return grid.guarded_flags(_grid(spark, d), least=300)


GUARDED = f"""{BLOCKINESS}, p AS (SELECT a.frame, a.r, a.c, a.dc AS y, b.dc AS x FROM g a JOIN g b ON b.frame = a.frame + 1 AND b.r = a.r AND b.c = a.c WHERE a.ok AND b.ok), {DISAGREE}, w AS (SELECT * FROM dis JOIN seam USING (frame, br, bc) JOIN blk USING (frame, br, bc)),
    f AS (SELECT frame, median(low) / greatest(quantile_cont(blockiness, 0.75), 0.1) AS ratio FROM w GROUP BY frame), l AS (SELECT *, 20 - 16 * least(greatest((blockiness - 0.9) / 0.6, 0), 1) AS lim FROM w JOIN f USING (frame)),
    k AS (SELECT frame, 1 - corr(y, x) AS cost FROM p GROUP BY frame), tr AS (SELECT a.frame, quantile_cont(b.cost, 0.25) AS trust FROM k a JOIN k b ON abs(b.frame - a.frame) <= 1 GROUP BY a.frame),
    dec AS (SELECT frame, br, bc, low, trust, CASE WHEN trust >= 1 THEN 'untrusted' WHEN ratio > 2.5 THEN 'ratio' WHEN low <= lim THEN 'agrees' WHEN high > 6 AND low < 0.6 * high AND seam < 1.6 THEN 'seam' ELSE 'replaced' END AS decision FROM l JOIN tr USING (frame))"""


def _decisions(spark, d):
    """Few frames that hardly agree: each is judged with its two neighbours, and half a correlation is not asked."""
    return grid.clean_decisions(_grid(spark, d), trust_limit=1.0, win=1, least=300)


@query("M8 M13 W7", f"WITH {GUARDED} SELECT frame, br, bc, round(low, 6) AS low, round(trust, 6) AS trust, decision FROM dec")
def clean_decisions(spark, d):
    return _decisions(spark, d)


@query(
    "M8 M12 M13",
    f"""WITH {GUARDED} SELECT g.frame, g.r, g.c, round(CASE WHEN decision = 'replaced' AND h.dc IS NOT NULL THEN a * h.dc + b ELSE g.dc END, 6) AS dc, coalesce(decision = 'replaced', false) AND h.dc IS NOT NULL AS patched
    FROM g LEFT JOIN g h ON h.frame = g.frame + 1 AND h.r = g.r AND h.c = g.c AND h.ok LEFT JOIN fit ON fit.frame = g.frame LEFT JOIN dec ON dec.frame = g.frame AND dec.br = g.r // 4 AND dec.bc = g.c // 4""",
)
def cleaned_cells(spark, d):
    return grid.cleaned(_grid(spark, d), _decisions(spark, d))


@query(
    "A17 M13",
    f"""WITH {GUARDED}, n AS (SELECT frame, bool_or(decision = 'untrusted') AS u, bool_or(decision = 'ratio') AS q, count(*) FILTER (decision = 'replaced') AS w, count(*) FILTER (decision = 'seam') AS s, median(low) AS m FROM dec GROUP BY frame), z AS (SELECT * FROM (SELECT DISTINCT frame FROM g) LEFT JOIN n USING (frame))
    SELECT count(*) AS frames, count(*) FILTER (coalesce(u OR q, true)) AS skipped, count(*) FILTER (q) AS skipped_ratio, coalesce(sum(w + s), 0)::BIGINT AS flagged, coalesce(sum(s), 0)::BIGINT AS rejected_seam, coalesce(sum(w), 0)::BIGINT AS written, round(median(m) FILTER (NOT u), 6) AS median_disagreement FROM z""",
)
def clean_report(spark, d):
    return grid.clean_report(_grid(spark, d), _decisions(spark, d))


@query("P21", "SELECT ef, eq, el, fo, oq, ol, CASE WHEN ef = 0 AND fo = 0 AND 2 * el + eq = 2 * ol + oq - 1 THEN 2 * el + eq END AS shift FROM range(-1, 2) a(ef), range(2) b(eq), range(-2, 3) c(el), range(-1, 2) d(fo), range(2) e(oq), range(-2, 3) f(ol)")
def uniform_shift(spark, d):
    """Maps of fields up to one frame ahead and two lines on."""
    each = lambda lo, hi: F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi).cast("long")))
    rows = spark.range(1)
    for name, lo, hi in (("ef", -1, 1), ("eq", 0, 1), ("el", -2, 2), ("fo", -1, 1), ("oq", 0, 1), ("ol", -2, 2)):
        rows = rows.withColumn(name, each(lo, hi))
    return rows.drop("id").withColumn("shift", grid.uniform_shift((F.col("ef"), F.col("eq"), F.col("el")), (F.col("fo"), F.col("oq"), F.col("ol"))))


@query("P19 P21 S5", f"WITH {GRID}, n AS (SELECT frame, r, c, dc, lead(dc) OVER w AS other, lead(c) OVER w AS nc FROM g WINDOW w AS (PARTITION BY frame, r ORDER BY c)) SELECT frame, r + 1 AS r, c + 1 AS c, round(0.5 * dc + 0.5 * other, 6) AS dc FROM n WHERE r < 35 AND nc = c + 1 AND nc < 44")
def composed_fields(spark, d):
    """Fields swapped within a frame, one column on and half a column back."""
    return grid.compose_fields(_grid(spark, d), columns=1)


@query("P18", f"WITH {GRID} SELECT frame, r, c, round(0.5 * dc + 0.5 * coalesce(lead(dc) OVER (PARTITION BY frame, r ORDER BY c), dc), 6) AS dc FROM g")
def subpixel_shift(spark, d):
    return grid.subshift(_grid(spark, d))


@query("P22", f"WITH {GRID} SELECT a.frame, a.r, a.c, round(0.375 * a.dc + 0.375 * b.dc + 0.125 * e.dc + 0.125 * f.dc, 6) AS dc FROM g a JOIN g b ON b.frame = a.frame AND b.r = a.r AND b.c = a.c + 1 JOIN g e ON e.frame = a.frame AND e.r = a.r + 1 AND e.c = a.c JOIN g f ON f.frame = a.frame AND f.r = a.r + 1 AND f.c = a.c + 1")
def bilinear_sample(spark, d):
    return grid.bilinear(_grid(spark, d))


@query("P20 S5", f"WITH {GRID} SELECT frame, r, c, round(dc, 6) AS dc FROM (SELECT frame, r, c, dc FROM g WHERE r % 2 = 0 UNION ALL SELECT frame - 1, r, c, dc FROM g WHERE r % 2 = 1) WHERE r BETWEEN 1 AND 35 AND c BETWEEN 1 AND 43")
def field_interleave(spark, d):
    """Even rows of a frame with odd rows of the next (the fields are the feature)."""
    return grid.interleave(_grid(spark, d))


@query("P26", f"WITH {GRID}, b AS (SELECT frame, r, c FROM g WHERE NOT ok) SELECT frame, r, c, (SELECT count(*) FROM b z WHERE z.frame = b.frame AND abs(z.r - b.r) + abs(z.c - b.c) = 1) = 4 AS inner FROM b".replace(" AS inner ", ' AS "inner" '))
def damage_erosion(spark, d):
    return grid.shrink(_grid(spark, d))


@query("P26", f"WITH {GRID} SELECT frame, r, c, round(CASE WHEN ok THEN dc ELSE 0.45 * dc + 0.55 * 255 END, 6) AS dc FROM g")
def damage_overlay(spark, d):
    return grid.overlay(_grid(spark, d))


@query("A15 P24", f"WITH {GRID} SELECT frame, round(avg(ok::INT), 6) AS health, round(avg(dc), 6) AS mean, round(stddev_pop(dc), 6) AS spread, count(*) AS cells FROM g GROUP BY frame")
def frame_signatures(spark, d):
    return grid.signatures(_grid(spark, d))


@query("S6", f"WITH {GRID}, m AS (SELECT frame, r, c, 0.5 * (dc + lag(dc) OVER (PARTITION BY frame, c ORDER BY r)) AS v FROM g) SELECT a.frame, a.r, a.c, round(b.v, 6) AS cr, round(a.v, 6) AS cb FROM m a JOIN m b ON b.frame = a.frame + 1 AND b.r = a.r AND b.c = a.c WHERE a.r > 0")
def chroma_planes(spark, d):
    return grid.chroma_planes(_grid(spark, d))


@query(
    "P23",
    f"""WITH {GRID}, n AS (SELECT frame, r, c, dc, r // 9 AS br, c // 9 AS bc, CASE WHEN c % 9 = 0 THEN lag(dc) OVER h - dc END AS jl, CASE WHEN c % 9 = 8 THEN lead(dc) OVER h - dc END AS jr, CASE WHEN r % 9 = 0 THEN lag(dc) OVER v - dc END AS jt, CASE WHEN r % 9 = 8 THEN lead(dc) OVER v - dc END AS jb FROM g WINDOW h AS (PARTITION BY frame, r ORDER BY c), v AS (PARTITION BY frame, c ORDER BY r)),
    s AS (SELECT frame, r, c, dc, max(jl) OVER x AS jl, max(jr) OVER x AS jr, max(jt) OVER y AS jt, max(jb) OVER y AS jb, greatest(0, 1 - c % 9 / 6.0::DOUBLE) AS wl, greatest(0, 1 - (8 - c % 9) / 6.0::DOUBLE) AS wr, greatest(0, 1 - r % 9 / 6.0::DOUBLE) AS wt, greatest(0, 1 - (8 - r % 9) / 6.0::DOUBLE) AS wb FROM n WINDOW x AS (PARTITION BY frame, br, bc, r), y AS (PARTITION BY frame, br, bc, c)),
    z AS (SELECT frame, r, c, dc, CASE WHEN jl IS NULL THEN 0 ELSE wl END + CASE WHEN jr IS NULL THEN 0 ELSE wr END + CASE WHEN jt IS NULL THEN 0 ELSE wt END + CASE WHEN jb IS NULL THEN 0 ELSE wb END AS w, coalesce(jl * wl, 0) + coalesce(jr * wr, 0) + coalesce(jt * wt, 0) + coalesce(jb * wb, 0) AS k FROM s)
    SELECT frame, r, c, round(CASE WHEN w > 0 THEN dc + 0.6 * k / w ELSE dc END + 1e-9, 6) AS dc FROM z""",
)
def feather(spark, d):
    return grid.feather(_grid(spark, d)).withColumn("dc", F.col("dc") + 1e-9)


@query("M7", f"WITH {MERGED}, s AS (SELECT frame, slot // 5 AS segment, count(DISTINCT read) AS reads, count(*) FILTER (how = 'unresolved') AS marked, count(*) AS slots FROM merged GROUP BY ALL) SELECT *, CASE WHEN reads = 1 AND marked = 0 THEN 'whole' WHEN marked = slots THEN 'untouched' ELSE 'packed' END AS written FROM s")
def segment_write_back(spark, d):
    return fuse.write_back(fuse.merge_frames(_reads(spark, d)))


@query("K3", f"WITH {TIMELINE}, s AS (SELECT cap, max(f) + 1 AS n FROM t GROUP BY cap), b AS (SELECT cap, coalesce(sum(n) OVER (ORDER BY cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM s) SELECT t.event_id, (base + f)::BIGINT AS pos FROM t JOIN b USING (cap)")
def ordered_concat(spark, d):
    """Captures one after the other on one axis: only their sizes meet in one place."""
    t = _timeline(spark, d)
    sizes = t.groupBy("cap").agg((F.max("f") + 1).alias("n"))
    base = F.coalesce(F.sum("n").over(W.orderBy("cap").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return t.join(sizes.withColumn("base", base), "cap").select("event_id", (F.col("base") + F.col("f")).alias("pos"))
