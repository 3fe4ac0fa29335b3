"""Captures of any size: every file is read as byte ranges by several tasks.

A first job finds where the records of each range begin: a range that starts inside a file looks for
the first offset from which several headers follow one another. What it finds is then checked
against the end of the range before it. A range that disagrees is walked again from there, and what its
neighbours found stands until they are checked in turn, so the offsets are exact and not a guess and
one wrong find costs one range. The second job cuts the ranges into frames.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.session import cut_lineage
from packetloom.sources.capture import (
    CLASSIC_MAGICS, FRAME_SCHEMA, FRAMES_PER_BATCH, PCAPNG_MAGIC, _block_records, _classic_records,
)

FRAME_TYPES = pa.schema([("path", pa.string()), ("frame_no", pa.int64()), ("epoch_micros", pa.int64()), ("wire_length", pa.int64()),
                         ("link_type", pa.int32()), ("frame", pa.binary()), ("cut", pa.bool_())])

SPLIT_BYTES = 64 << 20
CHAIN = 6  # headers that must follow one another
SECTION, INTERFACE = 0x0A0D0D0A, 1  # fixed values: block types
BLOCK_TYPES = (SECTION, INTERFACE, 2, 3, 4, 5, 6)
LARGEST_BLOCK = 16 << 20
INDEX = "path string, length long, part int, begin long, end long, start long, stop long, frames long, context binary, section boolean, big boolean, big_after boolean"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path, with the path in it; Spark writes local paths with one slash."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path)


class _File:
    """A capture opened for reading at offsets, through the file systems that Arrow knows."""

    def __init__(self, path: str, length: int):
        system, name = _opened(path)
        self.source, self.length = system.open_input_file(name), length
        self.head = self.read(0, 24)
        magic = self.head[:4].hex().upper()
        if magic != PCAPNG_MAGIC and magic not in CLASSIC_MAGICS:
            raise ValueError(f"no capture file: {path}")
        self.blocks = magic == PCAPNG_MAGIC
        big = self.head[8:12] == b"\x1a\x2b\x3c\x4d" if self.blocks else CLASSIC_MAGICS[magic][0] == "big"
        self.order = ">" if big else "<"
        self.nano = not self.blocks and CLASSIC_MAGICS[magic][1] == "nano"

    def read(self, begin: int, end: int) -> bytes:
        return self.source.read_at(max(0, min(end, self.length) - begin), begin)

    def _numbers(self, data: bytes) -> np.ndarray:
        """The unsigned 32-bit number at every offset."""
        raw = np.frombuffer(data, np.uint8).astype(np.uint32)
        parts = [raw[k:len(raw) - 3 + k] for k in range(4)]
        if self.order == ">":
            parts.reverse()
        return parts[0] | parts[1] << np.uint32(8) | parts[2] << np.uint32(16) | parts[3] << np.uint32(24)

    def first_record(self, begin: int, end: int) -> int | None:
        """The first offset of the range from which CHAIN headers, or as many as reach the file's end, follow one another."""
        data = self.read(begin, end + 16)
        if len(data) < 16:
            return None
        at = self._numbers(data)
        count = max(0, min(end - begin, len(at) - 12))
        if self.blocks:
            likely = np.isin(at[:count], BLOCK_TYPES) & (at[4:count + 4] >= 12) & (at[4:count + 4] <= LARGEST_BLOCK) & (at[4:count + 4] % 4 == 0)
            likely &= (np.arange(begin, begin + count) % 4) == 0
        else:
            largest = max(struct.unpack(self.order + "I", self.head[16:20])[0], 1 << 18) if len(self.head) == 24 else 1 << 18
            second, kept, wire = at[4:count + 4], at[8:count + 8], at[12:count + 12]
            likely = (second < (1_000_000_000 if self.nano else 1_000_000)) & (kept <= largest) & (wire >= kept) & (wire > 0)
        for k in np.flatnonzero(likely).tolist():
            if self._follows(begin + k):
                return begin + k
        return None

    def _follows(self, offset: int) -> bool:
        for _ in range(CHAIN):
            if offset == self.length:
                return True
            head = self.read(offset, offset + 16)
            if self.blocks:
                if len(head) < 12:
                    return False
                kind, size = struct.unpack_from(self.order + "II", head)
                if kind not in BLOCK_TYPES or size < 12 or size % 4 or size > LARGEST_BLOCK:
                    return False
                if self.read(offset + size - 4, offset + size) != head[4:8]:
                    return False
                offset += size
            else:
                if len(head) < 16:
                    return False
                _, fraction, kept, wire = struct.unpack(self.order + "IIII", head)
                if fraction >= (1_000_000_000 if self.nano else 1_000_000) or kept > wire or wire == 0:
                    return False
                offset += 16 + kept
                if offset > self.length:
                    return False
        return True

    def places(self, data: bytes, end: int) -> tuple[list[int], int]:
        """Where the records of a classic capture begin in ``data`` before ``end``, the first at 0, and where the last one stops; without a tail that is no record."""
        kept, at, found = struct.Struct(self.order + "8xI").unpack_from, 0, []
        last = min(end, len(data) - 15)
        while at < last:
            found.append(at)
            at += 16 + kept(data, at)[0]
        return found, at

    def walk(self, start: int, end: int) -> tuple[int, bytes, bool, int | None]:
        """Where the last record that starts before ``end`` stops, the interfaces described up to there, whether a section begins,
        and how many records a classic capture has up to there.

        ``order`` is then the byte order of the last section.
        """
        data, at, context, section = self.read(start, end + 16), start, [], False
        if not self.blocks:
            end = min(end, self.length)
            found, size = self.places(data, end - start)
            tail = start + size < end  # of fewer than 16 bytes
            return self.length if tail else min(start + size, self.length), b"", False, len(found) + tail
        while at < min(end, self.length):
            if data[at - start:at - start + 4] == b"\x0a\x0d\x0d\x0a":
                self.order = ">" if self.read(at + 8, at + 12) == b"\x1a\x2b\x3c\x4d" else "<"
            size = struct.unpack_from(self.order + "I", data, at - start + 4)[0] if at + 8 <= self.length else 0
            if size < 12 or size % 4 or at + size > self.length:
                return self.length, b"".join(context), section, None
            kind = struct.unpack_from(self.order + "I", data, at - start)[0]
            if kind == SECTION:
                context, section = [], True
            if kind in (SECTION, INTERFACE):
                context.append(self.read(at, at + size))
            at += size
        return min(at, self.length), b"".join(context), section, None

    def section(self) -> bytes:
        """A section header that only tells the byte order."""
        return struct.pack(self.order + "IIIHHqI", SECTION, 28, 0x1A2B3C4D, 1, 0, -1, 28) if self.blocks else b""

    def records(self, start: int, stop: int, context: bytes) -> Iterator:
        data = self.read(start, stop)
        return _block_records(context + data) if self.blocks else _classic_records(self.head + data)

    def columns(self, start: int, stop: int) -> Iterator[tuple]:
        """Batches of columns (micros, length on the wire, link type, frame, cut) of a classic capture, as ``_classic_records`` tells records."""
        data = self.read(start, stop)
        raw, link = np.frombuffer(data, np.uint8), struct.unpack(self.order + "I", self.head[20:24])[0] & 0xFFFF
        found, size = self.places(data, len(data))
        for begin in range(0, len(found), FRAMES_PER_BATCH):
            places = found[begin:begin + FRAMES_PER_BATCH]
            at = np.array(places, np.int64)
            heads = raw[at[:, None] + np.arange(16)].view(self.order + "u4").astype(np.int64)
            seconds, fraction, kept, wire = heads.T
            ends = at + 16 + kept
            frames = [data[a + 16:b] for a, b in zip(places, ends.tolist(), strict=True)]
            yield (pa.array(seconds * 1_000_000 + (fraction // 1000 if self.nano else fraction)), pa.array(wire), pa.array(np.full(len(at), link, np.int32)),
                   pa.array(frames, pa.binary()), pa.array(ends > len(data)))
        if size < len(data):
            yield pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([link], pa.int32()), pa.array([b""], pa.binary()), pa.array([True])


def _walked(batches: Iterator[pd.DataFrame], split: int, steps: int) -> Iterator[pd.DataFrame]:
    """Fill start, stop, frames and context of ranges; ``start`` is -1 to search, -2 for a range without records, or known.

    From a range's end the walk goes on, to ``steps`` ranges that records start in.
    """
    for batch in batches:
        done = []
        for row in batch.to_dict("records"):
            file = _File(row["path"], row["length"])
            start = row["start"]
            if row["begin"] == 0:
                start = 0 if file.blocks else 24
            elif start == -1:
                found = file.first_record(row["begin"], row["end"])
                start = -2 if found is None else found
            if row["big"] is not None and not pd.isna(row["big"]):
                file.order = ">" if row["big"] else "<"
            for _ in range(steps):
                big = file.order == ">"
                row = row | {"start": start, "stop": 0, "frames": 0, "context": b"", "section": False, "big": big, "big_after": big}
                if start >= 0 and len(file.head) < 24 and not file.blocks:
                    row |= {"start": 0, "stop": file.length, "frames": 1}
                elif start >= 0:
                    section = file.section()
                    row["stop"], row["context"], row["section"], number = file.walk(start, row["end"])
                    row["big_after"] = file.order == ">"
                    row["frames"] = sum(1 for _ in file.records(start, row["stop"], section)) if number is None else number
                done.append(row)
                start = row["stop"]
                if not 0 < start < file.length:
                    break
                part = start // split
                row = row | {"part": part, "begin": part * split, "end": min(part * split + split, file.length)}
        if done:
            yield pd.DataFrame(done)


def _chained(walks: pd.DataFrame) -> pd.DataFrame:
    """The walks of one file that follow one another from its beginning; ``missing`` where none does.

    Behind a missing one the chain goes on with what the next range has found by itself.
    """
    known, found, ends = {}, {}, {}
    for row in walks.sort_values("round", kind="stable").to_dict("records"):
        found.setdefault(row["part"], row)
        known.setdefault((row["part"], row["start"], row["big"]), row)
        ends[row["part"]] = row["end"]
    chain, due, big = [], None, None
    for part in sorted(ends):
        row = found[part]
        if due is not None:
            if due >= ends[part]:
                continue
            row = known.get((part, due, big))
        elif row["start"] < 0:
            continue
        chain.append((part, due, big, True) if row is None else (part, row["start"], row["big"], False))
        due, big = (None, None) if row is None else (row["stop"], row["big_after"])
    rows = pd.DataFrame(chain, columns=["part", "start", "big", "missing"])
    rows.insert(0, "path", walks["path"].iloc[0])
    return rows


def _tasks(ranges: DataFrame) -> int:
    """One task for each SPLIT_BYTES of the ranges, and for each range while there are few: a task walks several small ones."""
    number, size = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("end") - F.col("begin")), F.lit(0))).first()
    return max(1, min(number, max(ranges.sparkSession.sparkContext.defaultParallelism, -(-size // SPLIT_BYTES)), 10_000))


def capture_index(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, part, start, stop, frames, first_frame, context): exact byte ranges of whole records of all captures of a folder.

    Ranges without a record start have no row. ``first_frame`` numbers the frames of a file, ``context`` holds the
    section and interface blocks in force.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    cuts = files.select("path", "length", F.posexplode(F.sequence(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes))).alias("part", "begin"))
    ranges = cut_lineage(cuts.select("path", "length", "part", "begin", F.least(F.col("begin") + split_bytes, "length").alias("end"),
                                     F.lit(-1).cast("long").alias("start"), F.lit(None).cast("boolean").alias("big")))
    tasks = _tasks(ranges)
    blank = {"stop": F.lit(0).cast("long"), "frames": F.lit(0).cast("long"), "context": F.lit(None).cast("binary"), "section": F.lit(False),
             "big_after": F.lit(None).cast("boolean")}

    def walked(rows: DataFrame, number: int, steps: int) -> DataFrame:
        names = [c.split()[0] for c in INDEX.split(", ")]
        walk = partial(_walked, split=split_bytes, steps=steps)
        return cut_lineage(rows.withColumns(blank).select(*names).repartition(tasks, "path", "part").mapInPandas(walk, INDEX).withColumn("round", F.lit(number)))

    index, place = walked(ranges, 0, 1), ["path", "part", "start", "big"]
    for number in count(1):
        chain = cut_lineage(index.select(*place, "end", "stop", "big_after", "round").groupBy("path").applyInPandas(
            _chained, "path string, part int, start long, big boolean, missing boolean"))
        missing = chain.filter("missing").drop("missing")
        if missing.isEmpty():
            break
        again = walked(ranges.drop("start", "big").join(missing, ["path", "part"]), number, 1 << min(number - 1, 20))
        index = cut_lineage(index.unionByName(again))
    index = index.dropDuplicates(place).join(chain.drop("missing"), place)
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    kept = index.withColumn("first_frame", F.coalesce(F.sum("frames").over(before), F.lit(0)))
    last = F.max_by("part", F.when(F.col("section"), F.col("part"))).over(before)  # the range in which the section in force begins
    told = F.collect_list(F.when(F.octet_length("context") > 0, F.struct("part", "context"))).over(before)  # most ranges tell nothing
    context = F.aggregate(F.filter("__told", lambda c: c["part"] >= F.coalesce("__last", F.lit(0))), F.lit(b""), lambda a, c: F.concat(a, c["context"]))
    return kept.withColumns({"__last": last, "__told": told}).withColumn("context", context).filter("start >= 0").select(
        "path", "length", "part", "start", "stop", "frames", "first_frame", "context")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            file, at = _File(row["path"], row["length"]), row["first_frame"]
            if file.blocks or len(file.head) < 24:
                records = file.records(row["start"], row["stop"], b"" if row["part"] == 0 else row["context"]) if file.blocks else _classic_records(file.head)
                parts = iter(lambda records=records: list(islice(records, FRAMES_PER_BATCH)), [])
                columns = ([pa.array(c, t) for c, t in zip(zip(*p, strict=True), FRAME_TYPES.types[2:], strict=True)] for p in parts)
            else:
                columns = file.columns(row["start"], row["stop"])
            for part in columns:
                size = len(part[0])
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(row["path"]), size), pa.array(np.arange(at, at + size)), *part], schema=FRAME_TYPES)
                at += size


def read_capture_ranges(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """S5. Frames of a folder of captures, as :func:`capture.read_capture_frames` gives them, by several tasks per file.

    A task holds one range of about ``split_bytes`` at a time; a file may have any size. The path must lie in a file system that Arrow reads.
    """
    index = cut_lineage(capture_index(spark, path, split_bytes))
    tasks = _tasks(index.select(F.col("start").alias("begin"), F.col("stop").alias("end")))
    return index.repartition(tasks, "path", "part").mapInArrow(_cut, FRAME_SCHEMA)


def write_captures(frames: DataFrame, path: str, files: int, link_type: int = 1) -> None:
    """(epoch_micros, wire_length, frame) as ``files`` classic captures, frames in order of ``frame_no`` within a file.

    A task writes one file under a name of its attempt and renames it, so a repeated task replaces it whole.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, folder = _opened(path)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/part-{context.partitionId():05d}.pcap"
        count = 0
        with system.open_output_stream(f"{name}.{context.taskAttemptId()}") as out:
            out.write(struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 1 << 18, link_type))
            for batch in batches:
                micros, wire, frames = (batch.column(c) for c in ("epoch_micros", "wire_length", "frame"))
                if micros.null_count or wire.null_count or frames.null_count:
                    raise ValueError("a frame without time, length or bytes")
                size = pc.binary_length(frames).to_numpy(zero_copy_only=False).astype(np.int64)
                heads = np.stack([*np.divmod(micros.to_numpy().astype(np.int64), 1_000_000), size, np.maximum(wire.to_numpy().astype(np.int64), size)], axis=1)
                if len(heads) and (heads.min() < 0 or heads.max() > 0xFFFFFFFF):
                    raise ValueError("a time or length that a capture cannot hold")
                lines = heads.astype("<u4").tobytes()
                out.write(b"".join(x for k, frame in enumerate(frames.to_pylist()) for x in (lines[16 * k:16 * k + 16], frame)))
                count += batch.num_rows
        system.move(f"{name}.{context.taskAttemptId()}", name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count])], names=["name", "frames"])

    dealt = frames.select("frame_no", "epoch_micros", "wire_length", "frame").repartition(files, "frame_no").sortWithinPartitions("frame_no")
    dealt.mapInArrow(write, "name string, frames long").agg(F.sum("frames")).collect()
