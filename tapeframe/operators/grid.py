"""Operators on grids of cells (frame, r, c, dc, ok): shifts, window sums, seams, fits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS, COLUMNS = 36, 45


def of_lineitem(lineitem: DataFrame) -> DataFrame:
    """Quantities by line number as frames, part and supplier as rows and columns."""
    return lineitem.groupBy(F.col("l_linenumber").cast("long").alias("frame"), (F.col("l_partkey") % ROWS).alias("r"), (F.col("l_suppkey") % COLUMNS).alias("c")).agg(F.avg("l_quantity").alias("dc"), (F.count_if(F.col("l_returnflag") == "R") * 2 < F.count("*")).alias("ok"))


def next_frame(grid: DataFrame, dr: Column | int = 0, dc: Column | int = 0) -> DataFrame:
    """Cells of the frame after, keyed as the frame's own: (frame, r, c, dc2, ok2)."""
    return grid.select((F.col("frame") - 1).alias("frame"), (F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.col("dc").alias("dc2"), F.col("ok").alias("ok2"))


def shifts(max_r: int, max_c: int, step: int = 1) -> Column:
    """Array of (dr, dc) in ascending order."""
    pairs = [(r, c) for r in range(-max_r, max_r + 1, step) for c in range(-max_c, max_c + 1, step)]
    return F.array(*(F.struct(F.lit(r).cast("long").alias("dr"), F.lit(c).cast("long").alias("dcol")) for r, c in pairs))


def best_shift(grid: DataFrame, max_r: int = 2, max_c: int = 4, min_cells: int = 150) -> DataFrame:
    """The shift of whole cells that brings the next frame closest; the first of equals, (0, 0) if none has enough cells."""
    own = grid.where("ok").select("frame", "r", "c", "dc", F.explode(shifts(max_r, max_c)).alias("s")).select("frame", "dc", "s.dr", "s.dcol", (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dcol")).alias("c"))
    met = own.join(next_frame(grid).where("ok2"), ["frame", "r", "c"]).groupBy("frame", "dr", "dcol").agg(F.avg(F.abs(F.col("dc") - F.col("dc2"))).alias("error"), F.count("*").alias("cells"))
    best = met.where(F.col("cells") >= min_cells).groupBy("frame").agg(F.min_by(F.struct("dr", "dcol", "error", "cells"), F.struct(F.round("error", 9), "dr", "dcol")).alias("b"))
    zero = F.lit(0).cast("long")
    return grid.select("frame").distinct().join(best, "frame", "left").select("frame", F.coalesce("b.dr", zero).alias("dr"), F.coalesce("b.dcol", zero).alias("dcol"), F.col("b.error").alias("error"), F.coalesce("b.cells", zero).alias("cells"))


def shifted(grid: DataFrame, dr: int, dc: int) -> DataFrame:
    """Each cell shows the one (dr, dc) away; outside it is zero and not ok."""
    moved = grid.select("frame", (F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.col("dc").alias("dc2"), F.col("ok").alias("ok2"))
    return grid.select("frame", "r", "c").join(moved, ["frame", "r", "c"], "left").select("frame", "r", "c", F.coalesce("dc2", F.lit(0.0)).alias("dc"), F.coalesce("ok2", F.lit(False)).alias("ok"))


def pair_motion(grid: DataFrame, windows: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    """Mean difference to the next frame over square windows of cells healthy in both, from integral images.

    Two running sums make the integral of counts and of differences; a window is four corners of it.
    """
    cells = grid.join(next_frame(grid), ["frame", "r", "c"])
    both = F.col("ok") & F.col("ok2")
    cells = cells.select("frame", "r", "c", both.cast("long").alias("v"), F.when(both, F.abs(F.col("dc") - F.col("dc2"))).otherwise(0.0).alias("d"))
    across = W.partitionBy("frame", "r").orderBy("c")
    down = W.partitionBy("frame", "c").orderBy("r")
    line = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    spine = cells.select("frame").distinct().withColumn("r", line(ROWS)).withColumn("c", line(COLUMNS))
    full = spine.join(cells, ["frame", "r", "c"], "left").fillna({"v": 0, "d": 0.0})
    whole = full.withColumn("v", F.sum("v").over(across)).withColumn("d", F.sum("d").over(across)).withColumn("v", F.sum("v").over(down)).withColumn("d", F.sum("d").over(down))
    corners = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(s).alias("sign"), r.alias("r2"), c.alias("c2")) for w in windows for s, r, c in (
        (1, F.least(F.col("r") + w, F.lit(ROWS - 1)), F.least(F.col("c") + w, F.lit(COLUMNS - 1))), (-1, F.col("r") - w - 1, F.least(F.col("c") + w, F.lit(COLUMNS - 1))),
        (-1, F.least(F.col("r") + w, F.lit(ROWS - 1)), F.col("c") - w - 1), (1, F.col("r") - w - 1, F.col("c") - w - 1))))
    asked = cells.select("frame", "r", "c", F.explode(corners).alias("k")).select("frame", "r", "c", "k.*").where("r2 >= 0 and c2 >= 0")
    integral = whole.select("frame", F.col("r").alias("r2"), F.col("c").alias("c2"), "v", "d")
    sums = asked.join(integral, ["frame", "r2", "c2"]).groupBy("frame", "r", "c", "w").agg(F.sum(F.col("sign") * F.col("v")).alias("n"), F.sum(F.col("sign") * F.col("d")).alias("d"))
    return sums.select("frame", "r", "c", "w", "n", F.when(F.col("n") > 0, F.col("d") / F.col("n")).alias("motion"))


def _around(grid: DataFrame, reach: int) -> DataFrame:
    """Every cell with the cells at most ``reach`` away: (frame, r, c, dr, dcol, dc, ok)."""
    spread = grid.select("frame", "dc", "ok", F.col("r").alias("r2"), F.col("c").alias("c2"), F.explode(shifts(reach, reach)).alias("s"))
    return spread.select("frame", (F.col("r2") - F.col("s.dr")).alias("r"), (F.col("c2") - F.col("s.dcol")).alias("c"), "s.dr", "s.dcol", "dc", "ok")


def local_median(grid: DataFrame, win: int = 2) -> DataFrame:
    """Median of a window cut at the borders."""
    own = grid.select("frame", "r", "c")
    return own.join(_around(grid, win), ["frame", "r", "c"]).groupBy("frame", "r", "c").agg(F.median("dc").alias("median"), F.count("*").alias("cells"))


def neighbour_rmse(grid: DataFrame, radii: tuple[int, ...] = (1, 2, 4, 8), enough: int = 12, least: int = 6) -> DataFrame:
    """RMSE to the next frame over healthy neighbours without the cell itself: the first radius with enough of them."""
    diff = grid.join(next_frame(grid), ["frame", "r", "c"]).select("frame", "r", "c", (F.col("dc") - F.col("dc2")).alias("dc"), (F.col("ok") & F.col("ok2")).alias("ok"))
    near = diff.select("frame", "r", "c").join(_around(diff.where("ok"), max(radii)), ["frame", "r", "c"]).withColumn("away", F.greatest(F.abs("dr"), F.abs("dcol"))).where("away > 0")
    sums = near.groupBy("frame", "r", "c").agg(*(x for k in radii for x in (F.count_if(F.col("away") <= k).alias(f"n{k}"), F.sum(F.when(F.col("away") <= k, F.col("dc") * F.col("dc"))).alias(f"s{k}"))))
    pick = reduce(lambda rest, k: F.when(F.col(f"n{k}") >= enough, F.struct(F.lit(k).alias("radius"), F.col(f"n{k}").alias("n"), F.col(f"s{k}").alias("s"))).otherwise(rest), reversed(radii), F.when(F.col(f"n{radii[-1]}") >= least, F.struct(F.lit(radii[-1]).alias("radius"), F.col(f"n{radii[-1]}").alias("n"), F.col(f"s{radii[-1]}").alias("s"))))
    return sums.select("frame", "r", "c", pick.alias("p")).where("p is not null").select("frame", "r", "c", "p.radius", "p.n", F.sqrt(F.col("p.s") / F.col("p.n")).alias("rmse"))


def block_means(grid: DataFrame, size: int = 4) -> DataFrame:
    """Means of whole blocks of size x size cells."""
    block = lambda c: F.floor(F.col(c) / size).cast("long")
    return grid.groupBy("frame", block("r").alias("br"), block("c").alias("bc")).agg(F.avg("dc").alias("mean"), F.avg(F.col("ok").cast("double")).alias("health"), F.count("*").alias("cells"))


def seam(grid: DataFrame, size: int = 4) -> DataFrame:
    """Jump at a block's left, right and top edges over the gradient just inside, the largest of them."""
    by_r, by_c = W.partitionBy("frame", "r").orderBy("c"), W.partitionBy("frame", "c").orderBy("r")
    steps = grid.select(
        "frame", "r", "c", F.floor(F.col("r") / size).cast("long").alias("br"), F.floor(F.col("c") / size).cast("long").alias("bc"),
        F.abs(F.col("dc") - F.lag("dc").over(by_c)).alias("up"), F.abs(F.lead("dc", 1).over(by_c) - F.lead("dc", 2).over(by_c)).alias("up_in"),
        F.abs(F.col("dc") - F.lag("dc").over(by_r)).alias("left"), F.abs(F.lead("dc", 1).over(by_r) - F.lead("dc", 2).over(by_r)).alias("left_in"),
        F.abs(F.col("dc") - F.lead("dc").over(by_r)).alias("right"), F.abs(F.lag("dc", 2).over(by_r) - F.lag("dc", 1).over(by_r)).alias("right_in"),
    )
    at = lambda c, k: F.col(c) % size == k
    ratio = lambda name, where: F.avg(F.when(where, F.col(name))) / F.greatest(F.avg(F.when(where, F.col(f"{name}_in"))), F.lit(1.0))
    sums = steps.groupBy("frame", "br", "bc").agg(ratio("up", at("r", 0)).alias("top"), ratio("left", at("c", 0)).alias("left"), ratio("right", at("c", size - 1)).alias("right"))
    return sums.select("frame", "br", "bc", F.coalesce(F.greatest("top", "left", "right"), F.lit(0.0)).alias("seam"))


def local_blockiness(seams: DataFrame, win: int = 2) -> DataFrame:
    cells = seams.select("frame", F.col("br").alias("r"), F.col("bc").alias("c"), F.col("seam").alias("dc"), F.lit(True).alias("ok"))
    return local_median(cells, win).select("frame", F.col("r").alias("br"), F.col("c").alias("bc"), F.col("median").alias("blockiness"))


def _pairs(grid: DataFrame) -> DataFrame:
    return grid.join(next_frame(grid), ["frame", "r", "c"]).where("ok and ok2").select("frame", "r", "c", F.col("dc").alias("y"), F.col("dc2").alias("x"))


def photometric_fit(grid: DataFrame, trim: float = 0.10, least: int = 400) -> DataFrame:
    """Gain and offset of the next frame to this one, fitted again without the largest residuals; gated."""
    p = _pairs(grid)
    one = p.groupBy("frame").agg(F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b"), F.count("*").alias("n")).where(F.col("n") >= least)
    res = p.join(one, "frame").withColumn("res", F.abs(F.col("y") - F.col("a") * F.col("x") - F.col("b")))
    cut = res.groupBy("frame").agg(F.percentile("res", F.lit(1 - trim)).alias("cut"))
    near = res.join(cut, "frame").where(F.col("res") <= F.col("cut") + 1e-9)
    two = near.groupBy("frame").agg(F.regr_slope("y", "x").alias("a2"), F.regr_intercept("y", "x").alias("b2"), F.count("*").alias("kept"))
    enough = F.col("kept") >= least
    out = one.join(two, "frame").select("frame", "n", "kept", F.when(enough, F.col("a2")).otherwise(F.col("a")).alias("gain"), F.when(enough, F.col("b2")).otherwise(F.col("b")).alias("offset"))
    return out.withColumn("passes", F.col("gain").between(0.80, 1.20) & F.col("offset").between(-30.0, 30.0))


def disagreement(grid: DataFrame, size: int = 4, least: int = 1000, cover: float = 0.4) -> DataFrame:
    """Per block, RMSE to the fitted next frame: of 2 x 2 means (structure) and of cells (detail)."""
    p = _pairs(grid)
    fit = p.groupBy("frame").agg(F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b"), F.count("*").alias("n")).where(F.col("n") >= least)
    half = lambda c, k: F.floor(F.col(c) / k).cast("long")
    res = p.join(fit, "frame").select("frame", half("r", size).alias("br"), half("c", size).alias("bc"), half("r", size // 2).alias("sr"), half("c", size // 2).alias("sc"), (F.col("y") - F.col("a") * F.col("x") - F.col("b")).alias("d"))
    small = res.groupBy("frame", "br", "bc", "sr", "sc").agg(F.avg("d").alias("m"), F.sum(F.col("d") * F.col("d")).alias("q"), F.count("*").alias("n"))
    out = small.groupBy("frame", "br", "bc").agg(F.sqrt(F.avg(F.col("m") * F.col("m"))).alias("low"), F.sqrt(F.sum("q") / F.sum("n")).alias("high"), F.sum("n").alias("cells"))
    return out.where(F.col("cells") >= cover * size * size)


def guarded_flags(grid: DataFrame, ratio: float = 2.5, detail: float = 6.0, least: int = 1000) -> DataFrame:
    """Blocks to be replaced: structure disagrees beyond a threshold that falls with local blockiness, on frames that agree as a whole."""
    s = seam(grid)
    rows = disagreement(grid, least=least).join(s, ["frame", "br", "bc"]).join(local_blockiness(s), ["frame", "br", "bc"])
    whole = rows.groupBy("frame").agg((F.median("low") / F.greatest(F.percentile("blockiness", F.lit(0.75)), F.lit(0.1))).alias("ratio"))
    share = F.least(F.greatest((F.col("blockiness") - 0.9) / 0.6, F.lit(0.0)), F.lit(1.0))
    limit = 20.0 - 16.0 * share
    rows = rows.join(whole, "frame").withColumn("limit", limit)
    spare = (F.col("high") > detail) & (F.col("low") < 0.6 * F.col("high")) & (F.col("seam") < 1.6)
    flag = (F.col("ratio") <= ratio) & (F.col("low") > F.col("limit")) & ~spare
    return rows.select("frame", "br", "bc", "low", "high", "seam", "blockiness", "limit", "ratio", flag.alias("flagged"))


def frame_trust(grid: DataFrame, win: int = 4, share: float = 0.25) -> DataFrame:
    """(frame, trust): how badly the next frame fits, as 1 - correlation, and of that a low quantile of the frames around."""
    cost = _pairs(grid).groupBy("frame").agg((1 - F.corr("y", "x")).alias("cost"))
    around = cost.select(F.explode(F.sequence(F.col("frame") - win, F.col("frame") + win)).alias("frame"), "cost")
    return cost.select("frame").join(around, "frame").groupBy("frame").agg(F.percentile("cost", F.lit(share)).alias("trust"))


def clean_decisions(grid: DataFrame, trust_limit: float = 0.25, win: int = 4, ratio: float = 2.5, detail: float = 6.0, least: int = 1000) -> DataFrame:
    """What happens to each block: its frame is untrusted or disagrees as a whole (ratio), or it agrees, is spared for its seam, or is replaced."""
    rows = guarded_flags(grid, ratio, detail, least).join(frame_trust(grid, win), "frame")
    decision = F.when(F.col("trust") >= trust_limit, "untrusted").when(F.col("ratio") > ratio, "ratio").when(F.col("low") <= F.col("limit"), "agrees").when(F.col("flagged"), "replaced").otherwise("seam")
    return rows.select("frame", "br", "bc", "low", "trust", decision.alias("decision"))


def cleaned(grid: DataFrame, decisions: DataFrame, size: int = 4) -> DataFrame:
    """Cells of replaced blocks take the next frame's value with the fitted gain and offset; where that has none they stay."""
    fit = _pairs(grid).groupBy("frame").agg(F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b"))
    replaced = decisions.where("decision = 'replaced'").select("frame", "br", "bc", F.lit(True).alias("hit")).join(fit, "frame")
    cells = grid.select("frame", "r", "c", "dc", *(F.floor(F.col(x) / size).cast("long").alias(f"b{x}") for x in ("r", "c")))
    found = cells.join(replaced, ["frame", "br", "bc"], "left").join(next_frame(grid).where("ok2"), ["frame", "r", "c"], "left")
    patched = F.col("hit").isNotNull() & F.col("dc2").isNotNull()
    return found.select("frame", "r", "c", F.when(patched, F.col("a") * F.col("dc2") + F.col("b")).otherwise(F.col("dc")).alias("dc"), patched.alias("patched"))


def clean_report(grid: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: frames, those skipped, blocks flagged, spared and written, and the median of the frames' median disagreement."""
    is_ = lambda x: F.col("decision") == x
    frames = decisions.groupBy("frame").agg(F.bool_or(is_("untrusted")).alias("untrusted"), F.bool_or(is_("ratio")).alias("off"), F.count_if(is_("replaced")).alias("written"), F.count_if(is_("seam")).alias("spared"), F.median("low").alias("median"))
    rows = grid.select("frame").distinct().join(frames, "frame", "left")
    return rows.agg(
        F.count("*").alias("frames"), F.count_if(F.coalesce(F.col("untrusted") | F.col("off"), F.lit(True))).alias("skipped"), F.count_if("off").alias("skipped_ratio"),
        F.coalesce(F.sum(F.col("written") + F.col("spared")), F.lit(0)).alias("flagged"), F.coalesce(F.sum("spared"), F.lit(0)).alias("rejected_seam"), F.coalesce(F.sum("written"), F.lit(0)).alias("written"),
        F.median(F.when(~F.col("untrusted"), F.col("median"))).alias("median_disagreement"),
    )


def uniform_shift(even: tuple[Column, Column, Column], odd: tuple[Column, Column, Column]) -> Column:
    """Rows that a map of fields (frame ahead, field, line) moves both fields by; null if frames or rows differ."""
    rows = lambda m, parity: 2 * m[2] + m[1] - parity
    return F.when((even[0] == 0) & (odd[0] == 0) & (rows(even, 0) == rows(odd, 1)), rows(even, 0))


def compose_fields(grid: DataFrame, even: tuple[int, int, int] = (0, 1, -1), odd: tuple[int, int, int] = (0, 0, 0), columns: int = 8, by: float = 0.5) -> DataFrame:
    """Frames put together field by field: rows of a parity come from a field of the frame ``ahead``, ``line`` lines on.

    Cells move ``columns`` to the right and then by a part of a column to the left; what lies outside is absent.
    """
    parts = []
    for parity, (ahead, field, line) in enumerate((even, odd)):
        row = 2 * (F.floor(F.col("r") / 2) - line) + parity
        parts.append(grid.where(F.col("r") % 2 == field).select((F.col("frame") - ahead).alias("frame"), row.cast("long").alias("r"), (F.col("c") + columns).alias("c"), "dc"))
    whole = parts[0].unionByName(parts[1]).where((F.col("r") >= 0) & (F.col("r") < ROWS) & (F.col("c") < COLUMNS))
    if even[0] or odd[0]:
        whole = whole.join(grid.select("frame").distinct(), "frame", "left_semi")
    along = W.partitionBy("frame", "r").orderBy("c")
    moved = whole.withColumn("right", F.when(F.lead("c").over(along) == F.col("c") + 1, F.lead("dc").over(along)))
    return moved.where("right is not null").select("frame", "r", "c", ((1 - by) * F.col("dc") + by * F.col("right")).alias("dc"))


def subshift(grid: DataFrame, by: float = 0.5) -> DataFrame:
    """Cells moved by a part of a column; the last column repeats."""
    right = F.coalesce(F.lead("dc").over(W.partitionBy("frame", "r").orderBy("c")), F.col("dc"))
    return grid.select("frame", "r", "c", ((1 - by) * F.col("dc") + by * right).alias("dc"))


def bilinear(grid: DataFrame, oy: float = 0.25, ox: float = 0.5) -> DataFrame:
    """Values at (r + oy, c + ox); only where all four cells are there."""
    weight = {(0, 0): (1 - oy) * (1 - ox), (0, 1): (1 - oy) * ox, (1, 0): oy * (1 - ox), (1, 1): oy * ox}
    taps = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), F.lit(w).alias("w")) for (y, x), w in weight.items()))
    spread = grid.select("frame", "r", "c", "dc", F.explode(taps).alias("t")).select("frame", (F.col("r") - F.col("t.y")).alias("r"), (F.col("c") - F.col("t.x")).alias("c"), (F.col("dc") * F.col("t.w")).alias("part"))
    return spread.groupBy("frame", "r", "c").agg(F.sum("part").alias("dc"), F.count("*").alias("n")).where("n = 4").drop("n")


def interleave(grid: DataFrame) -> DataFrame:
    """Even rows of a frame with odd rows of the next one, where the picture covers the cell."""
    even = grid.where("r % 2 = 0").select("frame", "r", "c", "dc")
    odd = grid.where("r % 2 = 1").select((F.col("frame") - 1).alias("frame"), "r", "c", "dc")
    return even.unionByName(odd).where(covers(F.col("r"), F.col("c")))


def covers(r: Column, c: Column) -> Column:
    """Cells that the reference picture covers."""
    return (r >= 1) & (r < ROWS) & (c >= 1) & (c < COLUMNS - 1)


def shrink(grid: DataFrame) -> DataFrame:
    """Cells not ok whose four neighbours are not ok either, and the edges of what is not ok."""
    bad = grid.where("not ok").select("frame", "r", "c")
    taps = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in ((0, 1), (0, -1), (1, 0), (-1, 0))))
    near = bad.select("frame", F.explode(taps).alias("t"), "r", "c").select("frame", (F.col("r") + F.col("t.y")).alias("r"), (F.col("c") + F.col("t.x")).alias("c")).groupBy("frame", "r", "c").agg(F.count("*").alias("n"))
    return bad.join(near, ["frame", "r", "c"], "left").select("frame", "r", "c", (F.coalesce("n", F.lit(0)) == 4).alias("inner"))


def overlay(grid: DataFrame, alpha: float = 0.55, mark: float = 255.0) -> DataFrame:
    """Cells not ok blended with a mark."""
    return grid.select("frame", "r", "c", F.when(F.col("ok"), F.col("dc")).otherwise((1 - alpha) * F.col("dc") + alpha * mark).alias("dc"))


def block_motion(grid: DataFrame, size: int = 9, reach: int = 4) -> DataFrame:
    """Motion of blocks to the next frame: absolute differences on a coarse grid of shifts, then around its best."""
    block = lambda c: F.floor(F.col(c) / size).cast("long")
    own = grid.select("frame", block("r").alias("br"), block("c").alias("bc"), "r", "c", "dc")

    def best(rows: DataFrame) -> DataFrame:
        moved = rows.select("frame", "br", "bc", "dr", "dcol", "dc", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dcol")).alias("c"))
        sums = moved.join(next_frame(grid), ["frame", "r", "c"]).groupBy("frame", "br", "bc", "dr", "dcol").agg(F.avg(F.abs(F.col("dc") - F.col("dc2"))).alias("sad"), F.count("*").alias("n"))
        whole = sums.where(F.col("n") >= size * size / 2)
        return whole.groupBy("frame", "br", "bc").agg(F.min_by(F.struct("dr", "dcol", "sad"), F.struct(F.round("sad", 9), "dr", "dcol")).alias("b")).select("frame", "br", "bc", "b.*")

    coarse = best(own.select("*", F.explode(shifts(reach, reach, 2)).alias("s")).select("frame", "br", "bc", "r", "c", "dc", "s.dr", "s.dcol"))
    centre = coarse.select("frame", "br", "bc", F.col("dr").alias("r0"), F.col("dcol").alias("c0"))
    fine = own.join(centre, ["frame", "br", "bc"]).select("*", F.explode(shifts(1, 1)).alias("s")).select("frame", "br", "bc", "r", "c", "dc", (F.col("r0") + F.col("s.dr")).alias("dr"), (F.col("c0") + F.col("s.dcol")).alias("dcol"))
    return best(fine)


def signatures(grid: DataFrame) -> DataFrame:
    """Health, mean and spread of each frame, whose cells in order are its signature."""
    return grid.groupBy("frame").agg(F.avg(F.col("ok").cast("double")).alias("health"), F.avg("dc").alias("mean"), F.stddev_pop("dc").alias("spread"), F.count("*").alias("cells"))


def chroma_planes(grid: DataFrame) -> DataFrame:
    """Two planes in swapped order, each row the mean of it and the row above; the frame after stands for the second plane."""
    above = W.partitionBy("frame", "c").orderBy("r")
    mid = grid.select("frame", "r", "c", (0.5 * (F.col("dc") + F.lag("dc").over(above))).alias("v")).where("r > 0")
    second = mid.select((F.col("frame") - 1).alias("frame"), "r", "c", F.col("v").alias("cr"))
    return mid.select("frame", "r", "c", F.col("v").alias("cb")).join(second, ["frame", "r", "c"]).select("frame", "r", "c", "cr", "cb")


def feather(grid: DataFrame, size: int = 9, strength: float = 0.6, decay: float = 6.0) -> DataFrame:
    """Blocks eased into their neighbours: the jump at each border, faded over ``decay`` cells, weighted by the fades."""
    at = lambda c: (F.col(c) % size).cast("long")
    ramp = lambda d: F.greatest(F.lit(0.0), 1.0 - d / decay)
    by_r, by_c = W.partitionBy("frame", "r").orderBy("c"), W.partitionBy("frame", "c").orderBy("r")
    # The cell across each border, and the cell at the border, seen from every cell of the block.
    lines = {"left": (by_r, "c", 0, F.lag), "right": (by_r, "c", size - 1, F.lead), "top": (by_c, "r", 0, F.lag), "bottom": (by_c, "r", size - 1, F.lead)}
    rows = grid
    for name, (w, axis, edge, step) in lines.items():
        rows = rows.withColumn(f"jump_{name}", F.when(at(axis) == edge, step("dc").over(w) - F.col("dc")))
    block = {"r": F.floor(F.col("r") / size), "c": F.floor(F.col("c") / size)}
    rows = rows.withColumn("br", block["r"]).withColumn("bc", block["c"])
    for name, (_, axis, _, _) in lines.items():
        line = W.partitionBy("frame", "br", "bc", "r" if axis == "c" else "c")
        rows = rows.withColumn(f"jump_{name}", F.max(f"jump_{name}").over(line))
    away = {"left": at("c"), "top": at("r"), "right": size - 1 - at("c"), "bottom": size - 1 - at("r")}
    weight = sum((F.when(F.col(f"jump_{n}").isNotNull(), ramp(away[n])).otherwise(0.0) for n in lines), F.lit(0.0))
    corr = sum((F.coalesce(F.col(f"jump_{n}") * ramp(away[n]), F.lit(0.0)) for n in lines), F.lit(0.0))
    rows = rows.withColumn("weight", weight).withColumn("corr", corr)
    return rows.select("frame", "r", "c", F.when(F.col("weight") > 0, F.col("dc") + strength * F.col("corr") / F.col("weight")).otherwise(F.col("dc")).alias("dc"))
