"""Files of fixed-size frames as a Spark data source, for reading and writing.

Reading: ``spark.read.format("rawframes").option("profile", "pal").load(path)`` gives (path, frame,
payload).  Without a profile it is inferred from the file's size.  A partial frame at the end is
ignored; a file without a whole frame is an error.  A file is read in ranges of frames, so that a
large file is many tasks.  Writing takes (pos, payload) and leaves one part file for each partition,
which appear when the job commits; rows must come sorted by pos.  Every job's parts have names of their
own, later jobs' after earlier ones', so appending adds frames behind those that are there.  Overwriting
deletes the old parts only after the new ones are in place.

Python data sources run outside the JVM, so paths are those of a file system that driver and executors
have mounted at one place; ``frames_of`` reads files of any Hadoop file system through ``binaryFile``.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tapeframe.functions.bits import BLOCK_BYTES, byte_at, frame_bytes, profile_of

#: Frames of one task.
RANGE = 256


def plain_path(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


def files(path: str) -> list[str]:
    path = plain_path(path)
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if not f.startswith(("_", ".")))
    return [path]


@dataclass
class FrameRange(InputPartition):
    path: str
    size: int
    start: int
    stop: int


class FrameReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.profile, self.range = options["path"], options.get("profile"), int(options.get("range", RANGE))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for f in files(self.path):
            total = os.path.getsize(f)
            size = frame_bytes(self.profile or profile_of(total))
            if total < size:
                raise ValueError(f"{f} holds no whole frame")
            out += [FrameRange(f, size, a, min(a + self.range, total // size)) for a in range(0, total // size, self.range)]
        return out

    def read(self, partition: FrameRange) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start * partition.size)
            for k in range(partition.start, partition.stop):
                yield partition.path, k, f.read(partition.size)


@dataclass
class Part(WriterCommitMessage):
    name: str
    frames: int


class FrameWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = plain_path(options["path"]), overwrite
        #: Names of a job's parts sort behind those of the jobs before it.
        self.job = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def write(self, rows: Iterator) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        name, n, last = f"part-{self.job}-{context.partitionId():05d}.dv", 0, None
        with open(f"{self.path}/.{name}.{context.taskAttemptId()}", "wb") as f:
            for r in rows:
                if last is not None and r["pos"] < last:
                    raise ValueError("frames are not in order")
                last, n = r["pos"], n + 1
                f.write(r["payload"])
        return Part(f".{name}.{context.taskAttemptId()}", n)

    def commit(self, messages: list[Part | None]) -> None:
        old = files(self.path) if self.overwrite and os.path.isdir(self.path) else []
        for m in messages:
            if m is not None:
                target = m.name[1:].rpartition(".")[0]
                if m.frames:
                    os.replace(f"{self.path}/{m.name}", f"{self.path}/{target}")
                else:
                    os.remove(f"{self.path}/{m.name}")
        for f in old:
            os.remove(f)

    def abort(self, messages: list[Part | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(f"{self.path}/{m.name}"):
                os.remove(f"{self.path}/{m.name}")


class RawFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawframes"

    def schema(self) -> str:
        return "path string, frame long, payload binary"

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FrameWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawFrames)


def write_frames(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write (pos, payload) in order: ranges of positions are parts, sorted inside; mode "append" adds them behind the others."""
    rows.select("pos", "payload").repartitionByRange("pos").sortWithinPartitions("pos").write.format("rawframes").mode(mode).option("path", path).save()


def frames_of(spark: SparkSession, path: str, profile: str | None = None) -> DataFrame:
    """(path, frame, payload) of files on any Hadoop file system, each read as a whole in one task: for files of clips."""
    whole = spark.read.format("binaryFile").load(path)
    size = F.lit(frame_bytes(profile)) if profile else profile_bytes(F.col("length"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / F.col("size")) - 1))
    rows = whole.withColumn("size", size).where("length >= size").select("path", "content", "size", each.alias("frame"))
    return rows.select("path", "frame", F.expr("substring(content, int(frame * size) + 1, int(size))").alias("payload"))


def profile_bytes(length) -> Column:
    """Bytes of a frame by a file's length, as ``profile_of`` tells the profile."""
    pal, ntsc = frame_bytes("pal"), frame_bytes("ntsc")
    return F.when(length % pal == 0, pal).when(length % ntsc == 0, ntsc).when(length % ntsc < length % pal, ntsc).otherwise(pal)


def concat(parts: list[DataFrame]) -> DataFrame:
    """Windows' frames one after the other: (pos, payload), positions going on from part to part."""
    whole = None
    for k, p in enumerate(parts):
        own = p.select(F.lit(k).alias("window"), "pos", "payload")
        whole = own if whole is None else whole.unionByName(own)
    sizes = whole.groupBy("window").agg((F.max("pos") + 1).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("window").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return whole.join(F.broadcast(sizes), "window").select((F.col("base") + F.col("pos")).alias("pos"), "payload")


def blocks(frames: DataFrame, dim: DataFrame, frame: str = "frame") -> DataFrame:
    """(frame, blk, ordinal, segment, sta, qno, data) of the video blocks; ``dim`` is ``bits.blocks_of_profile``."""
    video = F.broadcast(dim.where("kind = 'video'"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.length("payload") / BLOCK_BYTES) - 1))
    rows = frames.select(frame, "payload", each.alias("blk")).join(video, "blk").select(frame, "blk", "ordinal", "segment", F.expr("substring(payload, int(offset) + 1, 80)").alias("data"))
    head = byte_at("data", 3)
    return rows.select(frame, "blk", "ordinal", "segment", F.shiftright(head, 4).alias("sta"), head.bitwiseAND(15).alias("qno"), "data")
