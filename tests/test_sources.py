import os

import pytest
from pyspark.sql import functions as F

from tapeframe.functions import bits
from tapeframe.sources import rawframes, sidecars


def frame(k, size=144000):
    return bytes([k]) * size


def test_frames_are_read_in_ranges(spark, tmp_path):
    rawframes.register(spark)
    (tmp_path / "a.dv").write_bytes(b"".join(frame(k) for k in range(5)) + b"rest")
    df = spark.read.format("rawframes").option("profile", "pal").option("range", "2").load(str(tmp_path / "a.dv"))
    assert [(r.frame, r.payload == frame(r.frame)) for r in df.orderBy("frame").collect()] == [(k, True) for k in range(5)]
    assert df.rdd.getNumPartitions() == 3
    (tmp_path / "b.dv").write_bytes(frame(1, 120000))
    assert spark.read.format("rawframes").load(str(tmp_path / "b.dv")).count() == 1
    (tmp_path / "c.dv").write_bytes(b"short")
    with pytest.raises(Exception, match="no whole frame"):
        spark.read.format("rawframes").load(str(tmp_path / "c.dv")).count()


def test_written_frames_come_back_in_order(spark, tmp_path):
    rawframes.register(spark)
    rows = spark.createDataFrame([(k, bytearray(frame(k))) for k in (3, 1, 0, 2)], "pos long, payload binary")
    rawframes.write_frames(rows, str(tmp_path / "out"))
    names = sorted(f for f in os.listdir(tmp_path / "out"))
    assert names and all(n.startswith("part-") for n in names)
    whole = b"".join((tmp_path / "out" / n).read_bytes() for n in names)
    assert whole == b"".join(frame(k) for k in range(4))
    joined = rawframes.concat([rows, rows.where("pos < 2")])
    assert [r.pos for r in joined.orderBy("pos").collect()] == list(range(6))


def test_appended_frames_stand_behind_the_others(spark, tmp_path):
    rawframes.register(spark)
    rows = spark.createDataFrame([(k, bytearray(frame(k))) for k in range(4)], "pos long, payload binary")
    out = str(tmp_path / "out")
    for part, mode in ((rows.where("pos < 2"), "overwrite"), (rows.where("pos = 1"), "append"), (rows.where("pos = 3"), "append")):
        rawframes.write_frames(part, out, mode)
    whole = lambda: b"".join((tmp_path / "out" / n).read_bytes()[:1] for n in sorted(os.listdir(out)) for _ in [0])
    got = [p[0] for n in sorted(os.listdir(out)) for p in [(tmp_path / "out" / n).read_bytes()[i : i + 1] for i in range(0, (tmp_path / "out" / n).stat().st_size, 144000)]]
    assert got == [0, 1, 1, 3] and len(whole()) >= 3
    assert sorted(r.payload[0] for r in rawframes.frames_of(spark, out).collect()) == [0, 1, 1, 3]
    rawframes.write_frames(rows.where("pos = 2"), out)
    assert [r.payload[0] for r in spark.read.format("rawframes").load(out).collect()] == [2]


def test_overwriting_keeps_the_old_parts_until_the_new_are_there(tmp_path, monkeypatch):
    (tmp_path / "part-old.dv").write_bytes(b"old")
    writer = rawframes.FrameWriter({"path": str(tmp_path)}, True)
    monkeypatch.setattr(rawframes.os, "replace", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        writer.commit([rawframes.Part(".part-new.dv.1", 1)])
    assert (tmp_path / "part-old.dv").read_bytes() == b"old"


def test_blocks_of_frames(spark):
    payload = bytearray(144000)
    first = 7 * 80  # the first video block stands after six headers and one block of audio
    payload[first + 3] = 0xE5
    frames = spark.createDataFrame([(0, payload)], "frame long, payload binary")
    rows = rawframes.blocks(frames, bits.blocks_of_profile(spark))
    assert rows.count() == 1620
    assert [(r.ordinal, r.sta, r.qno) for r in rows.where("sta <> 0").collect()] == [(0, 14, 5)]


def test_index_round_trip(spark, tmp_path):
    a, b = tmp_path / "a.dv", tmp_path / "b.dv"
    a.write_bytes(b"x")
    b.write_bytes(b"x")
    reads = spark.createDataFrame([(0, 0, 5), (0, 1, 7), (1, 1, 8)], "pos long, cap int, frame long")
    sidecars.save_index(spark, [str(a), str(b)], reads, str(tmp_path / "index"))
    got = sidecars.load_index(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, got.collect())) == [(0, 0, str(a), 5), (0, 1, str(b), 7), (1, 1, str(b), 8)]
    b.unlink()
    with pytest.raises(FileNotFoundError, match="b.dv"):
        sidecars.load_index(spark, str(tmp_path / "index"))


def test_alignment_is_kept_by_its_parameters(spark, tmp_path):
    rows = spark.range(3).select(F.col("id").alias("f"), (F.col("id") + 5).alias("v"), F.lit(0.1).alias("cost"), F.lit(0.2).alias("margin"), F.lit(True).alias("covered"))
    sidecars.save_alignment(rows, str(tmp_path / "align"), band=60, lam=0.01)
    assert sidecars.load_alignment(spark, str(tmp_path / "align"), band=60, lam=0.01).count() == 3
    with pytest.raises(ValueError):
        sidecars.load_alignment(spark, str(tmp_path / "align"), band=80, lam=0.01)


def test_places_are_kept(spark, tmp_path):
    path = f"file://{tmp_path}/places"
    with pytest.raises(FileNotFoundError):
        sidecars.load_places(spark, path)
    rows = [(i, i // 45, i % 45) for i in range(90)]
    sidecars.save_places(spark.createDataFrame(rows, "blk long, r long, c long"), path)
    assert sorted(map(tuple, sidecars.load_places(spark, path).collect())) == rows
