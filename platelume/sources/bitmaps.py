"""Bitmaps (uncompressed BMP) in parts: written a line at a time, read in ranges of bytes, on any file system that pyarrow knows.

A path without a scheme, or with file:, is a folder that all executors share; hdfs:, s3:, gs: and the like need no mounted folder.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that are one task's, and pixel values of a batch of rows.
CHUNK, VALUES = 32 << 20, 1 << 18
#: What opening a file counts for, in bytes, where files are dealt out to tasks.
OPENING = 128 << 10
#: Header sizes of a bitmap, and bits a pixel that are read.
HEADER, DEPTHS = 54, (8, 24, 32)
PIXELS = "path string, channel int, z int, y int, x int, value double"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    local = re.sub("^file:/+", "/", uri)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(uri)


# ---- writing ----------------------------------------------------------------------------------


def header(height: int, width: int) -> bytes:
    body = height * stride(width, 24)
    return struct.pack("<2sIHHI", b"BM", HEADER + body, 0, 0, HEADER) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, body, 2835, 2835, 0, 0)


def stride(width: int, bits: int) -> int:
    """Bytes of a line, filled up to four."""
    return (width * bits + 31) // 32 * 4


def line_bytes(values: np.ndarray, channels: int) -> bytes:
    """x-major channel values (at most three channels, the first is red) as a line of 24 bits a pixel, blue first."""
    own = np.clip(values, 0, 255).reshape(-1, channels)
    wide = np.zeros(stride(len(own), 24), np.uint8)
    for c in range(channels):
        wide[2 - c : len(own) * 3 : 3] = own[:, c]
    return wide.tobytes()


def by_file(lines: DataFrame, channels: int) -> DataFrame:
    """lines with their file's height and width, a file's lines together in one partition, from the last to the first.

    Partitions go by a key of their own: Spark leaves out a partitioning that a join has already, and may then turn that join into one that keeps no key together.
    """
    size = lines.groupBy("image_id").agg((F.max("y") + 1).cast("int").alias("height"), (F.max(F.size("values")) / channels).cast("int").alias("width"))
    rows = lines.join(size, "image_id").select("image_id", "y", "height", "width", "values")
    return rows.repartition(F.xxhash64("image_id")).sortWithinPartitions("image_id", F.desc("y"))


def write_bitmaps(lines: DataFrame, root: str, channels: int = 2) -> str:
    """lines (image_id, y, values: of all channels, x by x) -> img_{id}.bmp under root. A file is one task's, which holds some lines of it at a time."""
    rows = by_file(lines, channels)
    place = root.rstrip("/")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out, last, n = None, None, None, 0
        for batch in batches:
            ids, height, width = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for k in range(len(batch)):
                if ids[k] != last:
                    if out:
                        out.close()
                    if own is None:
                        own, folder = file_system(place)
                        own.create_dir(folder)
                    out, last, n = own.open_output_stream(f"{folder}/img_{ids[k]}.bmp"), ids[k], n + 1
                    out.write(header(height[k], width[k]))
                out.write(line_bytes(np.asarray(batch.column(4)[k].values.to_numpy(zero_copy_only=False), np.int64), channels))
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows.mapInArrow(put, "n long").agg(F.sum("n")).first()
    return root


# ---- reading ----------------------------------------------------------------------------------


def pixel_rows(path: str, top: int, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Lines (lines, width, channels) from line top on as pixel rows; the channels, stored blue first, come out red first."""
    _, width, n = values.shape
    order = np.array([2 - c if n >= 3 and c < 3 else c for c in range(n)], np.int32)
    step = max(1, VALUES // max(1, width * n))
    for k in range(0, len(values), step):
        part = values[k : k + step]
        y, x, c = np.indices(part.shape, np.int32)
        yield pa.RecordBatch.from_arrays([pa.repeat(path, part.size), pa.array(order[c.ravel()]), pa.repeat(pa.scalar(0, pa.int32()), part.size), pa.array(y.ravel() + np.int32(top + k)), pa.array(x.ravel()), pa.array(part.ravel().astype(float))], names=["path", "channel", "z", "y", "x", "value"])


def _range_rows(path: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
    """The pixels of the lines that begin in bytes start to end (excluded) of a file; none of a file that is no such bitmap."""
    own, place = file_system(path)
    with own.open_input_file(place) as f:
        head = f.read(HEADER)
        if len(head) < HEADER or head[:2] != b"BM":
            return
        first, size, width, height, _, bits, packed = struct.unpack("<I", head[10:14]) + struct.unpack("<IiiHHI", head[14:34])
        if bits not in DEPTHS or packed or width <= 0 or not height:
            return
        wide, lines = stride(width, bits), abs(height)
        if f.size() < first + wide * lines:
            return  # cut off
        low, high = (min(lines, max(0, -((first - at) // wide))) for at in (start, end))
        palette = None
        if bits == 8:
            f.seek(14 + size)
            palette = np.zeros((256, 4), np.uint8)
            read = np.frombuffer(f.read(first - 14 - size), np.uint8)[: 256 * 4]
            palette[: len(read) // 4] = read[: len(read) // 4 * 4].reshape(-1, 4)
        step = max(1, VALUES // max(1, width))
        for k in range(low, high, step):
            n = min(step, high - k)
            f.seek(first + k * wide)
            raw = np.frombuffer(f.read(n * wide), np.uint8).reshape(n, wide)[:, : width * bits // 8]
            values = palette[raw][:, :, :3] if bits == 8 else raw.reshape(n, width, bits // 8)[:, :, :3]
            # a positive height: the last line comes first
            yield from pixel_rows(path, lines - k - n, values[::-1]) if height > 0 else pixel_rows(path, k, values)


def read_bmp(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(path, channel, z, y, x, value) of the BMP files under path, each in ranges of chunk bytes; files that are none give no rows."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[bB][mM][pP]").load(path).select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), "length")
    parts = found.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(chunk).cast("long"))).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, start in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                yield from _range_rows(p, start, start + chunk)

    # names are few bytes, whatever the files hold: without a number they would all be one task's
    work = parts.agg(F.count("*") * OPENING + F.sum(F.least(F.lit(chunk), F.col("length") - F.col("start")))).first()[0] or 0
    return parts.repartition(max(1, -(-work // CHUNK)), "path", "start").mapInArrow(read, PIXELS)
