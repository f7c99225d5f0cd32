"""Fields of fixed-width records: bit fields, packed times, block classes, run lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: shifts by quantizer step and area, offsets by class, ends of the areas in zigzag order.
QUANTIZER_SHIFTS = [
    [3, 3, 4, 4], [3, 3, 4, 4], [2, 3, 3, 4], [2, 3, 3, 4], [2, 2, 3, 3], [2, 2, 3, 3], [1, 2, 2, 3], [1, 2, 2, 3], [1, 1, 2, 2], [1, 1, 2, 2], [0, 1, 1, 2],
    [0, 1, 1, 2], [0, 0, 1, 1], [0, 0, 1, 1], [0, 0, 0, 1], [0, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0],
]
QUANTIZER_OFFSETS = [6, 3, 0, 1]
AREA_ENDS = [6, 21, 43, 64]
#: Blocks of a sequence: six of headers, then one of audio before every fifteen of video.
SEQUENCE, HEADERS, AUDIO_EVERY, AUDIO = 150, 6, 16, 9
#: Sequences, width and height of the two profiles.
PROFILES = {"pal": (12, 720, 576), "ntsc": (10, 720, 480)}
BLOCK_BYTES = 80
TIMECODE = 0x13


def frame_bytes(profile: str) -> int:
    return PROFILES[profile][0] * SEQUENCE * BLOCK_BYTES


def profile_of(size: int) -> str:
    """The profile whose frames a file of this size holds; the smaller rest decides, PAL among equals."""
    return min(PROFILES, key=lambda p: size % frame_bytes(p))


def byte_at(payload: str, i: int) -> Column:
    """Byte i (from 0) of a binary column, as a number."""
    return F.conv(F.hex(F.substring(payload, i + 1, 1)), 16, 10).cast("int")


def dc_raw(high: Column, low: Column) -> Column:
    """Nine bits, signed: all of the high byte and the top bit of the low one."""
    x = F.shiftleft(high, 1).bitwiseOR(F.shiftright(low, 7))
    return F.when(x >= 256, x - 512).otherwise(x)


def fields(high: Column, low: Column) -> list[Column]:
    """Signed value, transform mode, class, status and quantizer of a pair of bytes."""
    return [dc_raw(high, low).alias("dc"), F.shiftright(low, 6).bitwiseAND(1).alias("mode"), F.shiftright(low, 4).bitwiseAND(3).alias("cls"), F.shiftright(high, 4).alias("sta"), high.bitwiseAND(15).alias("qno")]


def luma_mean(*dc: Column) -> Column:
    return sum(dc[1:], dc[0]) / len(dc)


def bcd(value: Column) -> Column:
    return F.shiftleft(F.floor(value / 10).cast("int"), 4).bitwiseOR((value % 10).cast("int"))


def timecode_pack(index: Column, fps: int = 25) -> Column:
    """Five bytes as hex: the header, then frames, seconds, minutes and hours in BCD with their flag bits."""
    seconds = F.floor(index / fps)
    parts = [F.lit(TIMECODE), bcd(index % fps), bcd(seconds % 60).bitwiseOR(F.lit(0x80)), bcd(F.floor(seconds / 60) % 60).bitwiseOR(F.lit(0x80)), bcd(F.floor(seconds / 3600) % 24).bitwiseOR(F.lit(0xC0))]
    return F.concat(*(F.lpad(F.hex(p.cast("long")), 2, "0") for p in parts))


def rewrite_timecode(payload: str, slots: list[int], pack: Column, force: bool = False) -> tuple[Column, Column]:
    """(payload with the pack in each slot whose header says so, number written); slots are byte offsets."""
    out, written = F.col(payload), F.lit(0)
    for at in slots:
        hit = (byte_at(payload, at) == TIMECODE) | F.lit(force)
        out = F.when(hit, F.overlay(out, F.unhex(pack), F.lit(at + 1), F.lit(5))).otherwise(out)
        written = written + hit.cast("int")
    return out, written


def blocks_of_profile(spark: SparkSession, profile: str = "pal") -> DataFrame:
    """(blk, sequence, kind, offset, ordinal) of every block of a frame."""
    n = PROFILES[profile][0] * SEQUENCE
    at = F.col("blk") % SEQUENCE - HEADERS
    kind = F.when(at < 0, "header").when(at % AUDIO_EVERY == 0, "audio").otherwise("video")
    video = F.col("sequence") * (SEQUENCE - HEADERS - AUDIO) + at - F.floor(at / AUDIO_EVERY) - 1
    audio = F.col("sequence") * AUDIO + F.floor(at / AUDIO_EVERY)
    rows = spark.range(n).select(F.col("id").alias("blk"), F.floor(F.col("id") / SEQUENCE).cast("long").alias("sequence"))
    rows = rows.select("blk", "sequence", kind.alias("kind"), (F.col("blk") * BLOCK_BYTES).alias("offset"), F.when(kind == "video", video).when(kind == "audio", audio).alias("ordinal"))
    return rows.withColumn("ordinal", F.col("ordinal").cast("long")).withColumn("segment", F.when(F.col("kind") == "video", F.floor(F.col("ordinal") / 5).cast("long")))


def levels(values: str, step: float) -> Column:
    """Quantized values, halves to even."""
    return F.transform(values, lambda x: F.rint(x / step).cast("int"))


def nonzero(levels_: str) -> Column:
    return F.size(F.filter(levels_, lambda x: x != 0))


def energy(levels_: str) -> Column:
    return F.aggregate(levels_, F.lit(0), lambda t, x: t + F.abs(x))


def last_nonzero(levels_: str) -> Column:
    """Index of the last level that is not zero; -1 for none."""
    return F.array_max(F.concat(F.array(F.lit(-1)), F.filter(F.transform(levels_, lambda x, i: F.when(x != 0, i).otherwise(-1)), lambda i: i >= 0)))


def run_levels(levels_: str) -> Column:
    """(zeros before it, level) of each level that is not zero."""
    at = F.filter(F.transform(levels_, lambda x, i: F.when(x != 0, i).otherwise(-1)), lambda i: i >= 0)
    before = F.concat(F.array(F.lit(-1)), at)
    return F.transform(at, lambda i, k: F.struct((i - F.get(before, k) - 1).alias("run"), F.get(F.col(levels_), i).alias("level")))


def split_runs(runs: str, longest: int = 61) -> Column:
    """Runs of more than ``longest`` zeros as skips (level 0) and a rest that is short enough; a skip stands for its run alone."""
    part = lambda x: F.concat(F.transform(F.sequence(F.lit(1), F.floor(x["run"] / longest).cast("int")), lambda _: F.struct(F.lit(longest).alias("run"), F.lit(0).alias("level"))), F.array(F.struct((x["run"] % longest).alias("run"), x["level"].alias("level"))))
    short = lambda x: F.array(F.struct(x["run"].alias("run"), x["level"].alias("level")))
    return F.flatten(F.transform(runs, lambda x: F.when(x["run"] >= longest, part(x)).otherwise(short(x))))


def expand_runs(runs: str, size: int = 64) -> Column:
    """The levels that runs stand for."""
    filled = F.aggregate(runs, F.expr("cast(array() as array<int>)"), lambda t, x: F.concat(t, F.array_repeat(F.lit(0), x["run"]), F.array(x["level"])))
    return F.concat(filled, F.array_repeat(F.lit(0), F.lit(size) - F.size(filled)))


def factor_table(spark: SparkSession, weights: list[list[int]], areas: list[int], shifts: list[list[int]], offsets: list[int]) -> DataFrame:
    """(qno, cls, mode, k, factor): weight of position k in a mode shifted by its area's entry for the quantizer; class 3 doubles."""
    each = lambda n: F.explode(F.array(*map(F.lit, range(n))))
    grid = spark.range(16).select(F.col("id").cast("int").alias("qno"), each(4).alias("cls")).select("qno", "cls", each(len(weights)).alias("mode")).select("qno", "cls", "mode", each(len(weights[0])).alias("k"))
    pick = lambda table, i: F.get(F.array(*map(F.lit, table)), i)
    s = F.greatest(F.least(F.col("qno") + pick(offsets, F.col("cls")), F.lit(len(shifts) - 1)), F.lit(0))
    shift = F.get(F.get(F.array(*(F.array(*map(F.lit, row)) for row in shifts)), s), pick(areas, F.col("k")))
    weight = F.get(F.get(F.array(*(F.array(*map(F.lit, row)) for row in weights)), F.col("mode")), F.col("k"))
    return grid.select("qno", "cls", "mode", "k", shift.alias("shift"), weight.cast("long").alias("weight")).select("qno", "cls", "mode", "k", F.expr("shiftleft(weight, shift + 1 + if(cls = 3, 1, 0))").alias("factor"))
