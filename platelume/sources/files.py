"""File listings, bitmaps and pixel tables as sources."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitmaps

BITMAPS = (".png", ".jpg", ".jpeg", ".bmp", ".gif")


def extension(path) -> F.Column:
    """The last suffix, lower-cased, with its dot: a.ome.tif has .tif."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def basename(path) -> F.Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path) -> F.Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def select_files(listing: DataFrame, extensions: list[str], contains: str = "") -> DataFrame:
    """The listing's (path) with one of the extensions and contains in the file's name."""
    wanted = [e.lower() if e.startswith(".") else f".{e.lower()}" for e in extensions]
    out = listing.filter(extension(F.col("path")).isin(wanted))
    return out.filter(basename(F.col("path")).contains(contains)) if contains else out


def _path(column: str) -> F.Column:
    """Both readers' spelling of a local path: file:/."""
    return F.regexp_replace(column, "^file:/+", "file:/")


def scan_files(spark: SparkSession, root: str, extensions: list[str], contains: str = "", recursive: bool = True) -> DataFrame:
    """(path, length, modified) of the files under root, without reading their content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return select_files(found.select(_path("path").alias("path"), "length", F.col("modificationTime").alias("modified")), extensions, contains).orderBy("path")


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decoded images (path, height, width, nChannels, data) as pixel rows, some lines at a time."""
    for batch in batches:
        for i in range(len(batch)):
            path, *shape = (batch.column(c)[i].as_py() for c in range(4))
            yield from bitmaps.pixel_rows(path, 0, np.frombuffer(batch.column(4)[i].as_buffer(), np.uint8).reshape(shape))


def read_bitmaps(spark: SparkSession, path: str, chunk: int = bitmaps.CHUNK) -> DataFrame:
    """(path, channel, z, y, x, value) of the images under path; the channels come out red first. Files that can't be read give no rows.

    BMP files are read in ranges of chunk bytes, each a task's; what must be decoded as a whole (PNG, JPEG, GIF) by Spark's image source.
    """
    raw = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pPjJgG][nNpPiI]*").load(path)
    raw = raw.select(_path("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")
    return bitmaps.read_bmp(spark, path, chunk).unionByName(raw.mapInArrow(_laid_out, bitmaps.PIXELS))


def pixels_ingest(raw: DataFrame, scene: int = 0) -> DataFrame:
    """raw (image_id, [scene, t,] channel, z, y, x, value) -> pixels: first time point, one scene, doubles; missing axes are 0."""
    for axis in ("scene", "t", "channel", "z"):
        if axis not in raw.columns:
            raw = raw.withColumn(axis, F.lit(0))
    own = raw.filter((F.col("t") == 0) & (F.col("scene") == scene))
    return own.select("image_id", *[F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in ("channel", "z", "y", "x")], F.col("value").cast("double").alias("value"))


def channel_name(names, channel) -> F.Column:
    """The name at an index, or ch{index} where the list is too short."""
    return F.coalesce(F.get(names, channel), F.concat(F.lit("ch"), channel.cast("string")))


def image_info(px: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """A row an image: n_channels, n_z, height, width, is_z_stack, and the scales and names where images are given."""
    shape = px.groupBy("image_id").agg(
        (F.max("channel") + 1).cast("int").alias("n_channels"),
        (F.max("z") + 1).cast("int").alias("n_z"),
        (F.max("y") + 1).cast("int").alias("height"),
        (F.max("x") + 1).cast("int").alias("width"),
    )
    shape = shape.withColumn("is_z_stack", F.col("n_z") > 1)
    if images is None:
        return shape
    own = images.select("image_id", "channel_names", "pixel_size_um", "z_step_um")
    out = shape.join(own, "image_id", "left")
    names = F.transform(F.sequence(F.lit(0), F.col("n_channels") - 1), lambda i: channel_name(F.col("channel_names"), i))
    return out.select("image_id", "n_channels", "n_z", "height", "width", "is_z_stack", F.array_join(names, ",").alias("channels"), F.coalesce("pixel_size_um", F.lit(1.0)).alias("pixel_size_um"), F.coalesce("z_step_um", F.lit(1.0)).alias("z_step_um"))


def select_channel(px: DataFrame, images: DataFrame, channel: int | str) -> DataFrame:
    """One channel's pixels, by index or name. An image without that name fails the query when it is read."""
    if isinstance(channel, int):
        return px.filter(F.col("channel") == channel)
    own = images.select("image_id", F.array_position("channel_names", channel).alias("at"))
    known = F.assert_true(F.col("at") > 0, F.concat(F.lit(f"no channel {channel!r} in image "), F.col("image_id").cast("string"))).isNull()
    return px.join(own.filter(known), "image_id").filter(F.col("channel") == F.col("at") - 1).drop("at")
