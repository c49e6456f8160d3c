"""Images that arrive over time: the same job as a stream of pixel files, a micro-batch at a time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scratch import exists, keep, passing, remove
from ..plans.jobs import Frames, run_pipeline
from ..sources import results

PIXELS = "image_id long, channel int, z int, y int, x int, value double"


def run_name(spark: SparkSession, checkpoint: str) -> str:
    """The name of a checkpoint's runs, which lies beside it: another checkpoint, or one made anew, has another, so that its batches, which
    are counted from 0 again, are not taken for these."""
    if not exists(spark, f"{checkpoint}/run-name"):
        spark.createDataFrame([(uuid.uuid4().hex,)], "value string").coalesce(1).write.text(f"{checkpoint}/run-name")
    return spark.read.text(f"{checkpoint}/run-name").first().value


def _gathered(px: DataFrame, n: int, sizes: DataFrame, place: str) -> DataFrame:
    """The pixels, of this batch and of those before, of the images that this batch makes whole. Batches wait under place; ids of whole images are
    noted by batch, so that a batch that is run again finds what it found before."""
    spark = px.sparkSession
    px.withColumn("batch", F.lit(f"b{n}")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{place}/waiting")
    waiting = spark.read.parquet(f"{place}/waiting")
    held = waiting.groupBy("image_id").agg(F.count("*").alias("n")).join(sizes.select("image_id", "n_pixels"), "image_id").filter("n >= n_pixels").select("image_id")
    if exists(spark, f"{place}/whole"):
        known = spark.read.parquet(f"{place}/whole").filter(F.col("batch") != f"b{n}").select("image_id")
        held = held.join(known, "image_id", "left_anti")
    ready = keep(held, "ready")
    ready.withColumn("batch", F.lit(f"b{n}")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{place}/whole")
    return waiting.join(ready, "image_id", "left_semi").drop("batch")


def _let_go(spark: SparkSession, place: str, n: int) -> None:
    """Removes earlier batches whose images are all measured."""
    whole = spark.read.parquet(f"{place}/whole").select("image_id")
    waiting = spark.read.parquet(f"{place}/waiting").select("image_id", "batch").distinct()
    needed = {r.batch for r in waiting.join(whole, "image_id", "left_anti").select("batch").distinct().collect()}
    for r in waiting.select("batch").distinct().collect():  # a row a batch that waits
        if r.batch not in needed and r.batch != f"b{n}":
            remove(spark, f"{place}/waiting/batch={r.batch}")


def watch_folder(spark: SparkSession, folder: str, spec: dict, out: str, checkpoint: str, experiment: str = "", files_per_batch: int = 64, sizes: DataFrame | None = None) -> StreamingQuery:
    """Runs spec on each batch of new Parquet pixel files in folder and writes its result tables under out, a partition a batch.

    sizes (image_id, n_pixels), where it is given, says when an image is whole: its pixels may come in any number of files and batches,
    and wait beside the checkpoint until all are there; images that are not listed are never measured. Without it an image must lie in one file: one whose
    pixels come in two batches is measured twice, each time in part. The checkpoint remembers which files are
    done, so a restart takes up the rest; a batch that failed half-way is run again under its own name and replaces what it had written. Several
    streams, and plain writes, may share out.
    """
    arriving = spark.readStream.schema(PIXELS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    run, place = run_name(spark, checkpoint), f"{checkpoint}/images"

    def measure(px: DataFrame, n: int) -> None:
        own = keep(px if sizes is None else _gathered(px, n, sizes, place), "arrived")
        images = own.select("image_id").distinct().withColumns({"path": F.lit(folder), "channel_names": F.array().cast("array<string>"), "pixel_size_um": F.lit(1.0), "z_step_um": F.lit(1.0)})
        done = run_pipeline(spec, Frames(own, images))
        results.write_results({k: done.table(k) for k in done.tables}, out, experiment, batch=f"stream-{run}-{n}")
        if sizes is not None:
            _let_go(spark, place, n - 1)

    return arriving.writeStream.foreachBatch(lambda px, n: passing(lambda: measure(px, n))).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()
