"""Result tables: registration, append with defaults, export, schema evolution and the run log."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import basename

#: The result tables, their columns in order, and what a missing field becomes.
TABLES: dict[str, str] = {
    "images": "image_id long, path string, filename string, experiment string, n_channels int, height int, width int, n_z int, pixel_size_um double, z_step_um double, channel_names array<string>, run_timestamp timestamp, metadata map<string,string>",
    "particle_measurements": "image_id long, channel string, roi_mask string, roi_path string, label int, area_px long, area_um2 double, perimeter_px double, circularity double, eccentricity double, solidity double, mean_intensity double, max_intensity double, min_intensity double, centroid_row double, centroid_col double",
    "intensity_measurements": "image_id long, channel string, roi_mask string, roi_path string, mean_intensity double, sum_intensity double, std_intensity double, area_px long, area_um2 double",
    "colocalization_results": "image_id long, primary_channel string, secondary_channel string, roi_mask string, manders_m1 double, manders_m2 double, pearson_r double, manders_m1_random double, manders_m2_random double, n_primary_particles long",
    "colocalization_per_particle": "image_id long, primary_channel string, secondary_channel string, roi_mask string, primary_label int, primary_area_um2 double, n_secondary_pixels long, secondary_mean_intensity double, secondary_max_intensity double, overlap_fraction double",
    "pipeline_runs": "image_id long, pipeline_name string, pipeline_json string, run_timestamp timestamp, status string, error_message string",
}
DEFAULTS = {"roi_mask": "whole_image", "roi_path": "", "channel": "", "primary_channel": "", "secondary_channel": ""}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def schema_names(name: str) -> list[str]:
    return schema(name).names


def _default(field: T.StructField) -> Column:
    if field.name in DEFAULTS:
        return F.lit(DEFAULTS[field.name])
    return F.lit(0).cast(field.dataType) if isinstance(field.dataType, (T.NumericType,)) and field.name != "image_id" else F.lit(None).cast(field.dataType)


def with_defaults(df: DataFrame, name: str) -> DataFrame:
    """df in the table's columns, order and types; fields that are absent or null take their default."""
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.coalesce(F.col(f.name).cast(f.dataType), _default(f)) if f.name.lower() in have else _default(f)).alias(f.name) for f in schema(name).fields])


def schema_evolve(df: DataFrame, target: T.StructType) -> DataFrame:
    """df with the columns of target that it lacks, as nulls or their defaults; its own further columns stay behind them."""
    have = {c.lower() for c in df.columns}
    added = [_default(f).alias(f.name) for f in target.fields if f.name.lower() not in have and f.name in DEFAULTS]
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in target.fields if f.name.lower() not in have and f.name not in DEFAULTS]
    wide = df.select("*", *added, *nulls)
    order = [f.name for f in target.fields]
    return wide.select(*order, *[c for c in df.columns if c.lower() not in {o.lower() for o in order}])


def register_images(files: DataFrame, info: DataFrame, experiment: str = "", timestamp: Column | None = None) -> DataFrame:
    """files (path, image_id or not) and image_info -> images rows; an id is the path's hash where none is given."""
    ids = files if "image_id" in files.columns else files.withColumn("image_id", F.xxhash64("path"))
    out = ids.select("image_id", "path", basename(F.col("path")).alias("filename"), F.lit(experiment).alias("experiment"), *[c for c in ("metadata",) if c in ids.columns]).join(info, "image_id", "left")
    return with_defaults(out.withColumn("run_timestamp", timestamp if timestamp is not None else F.current_timestamp()), "images")


def write_results(tables: dict[str, DataFrame], out: str, experiment: str, batch: str | None = None) -> None:
    """Appends each table under out, a partition an experiment and a write; earlier rows stay. A batch of a stream that is written again replaces its own rows.

    batch: a name that only this write has, and that is no number; a new one where it is not given.
    """
    batch = batch or f"write-{uuid.uuid4().hex}"
    for name, df in tables.items():
        own = with_defaults(df, name).withColumns({"experiment": F.lit(experiment), "batch": F.lit(batch)})
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment", "batch").parquet(f"{out}/{name}")


def read_results(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(f"{out}/{name}")


def export_parquet(tables: dict[str, DataFrame], out: str) -> list[str]:
    """Writes each table but the run log, and leaves out empty ones; returns the names written."""
    done = []
    for name, df in tables.items():
        if name != "pipeline_runs" and not df.isEmpty():
            df.write.mode("overwrite").parquet(f"{out}/{name}")
            done.append(name)
    return done


def run_log(images: DataFrame, errors: DataFrame, name: str, spec: str, timestamp: Column | None = None) -> DataFrame:
    """A row an image: ok, or error and its message. Errors (image_id, error) of images that were not registered come with a null id."""
    first = errors.groupBy("image_id").agg(F.min("error").alias("error_message"))
    rows = images.select("image_id", F.lit(True).alias("known")).join(first, "image_id", "full_outer")
    return with_defaults(
        rows.select(
            F.when(F.col("known"), F.col("image_id")).alias("image_id"),
            F.lit(name).alias("pipeline_name"),
            F.lit(spec).alias("pipeline_json"),
            (timestamp if timestamp is not None else F.current_timestamp()).alias("run_timestamp"),
            F.when(F.col("error_message").isNull(), "ok").otherwise("error").alias("status"),
            F.coalesce("error_message", F.lit("")).alias("error_message"),
        ),
        "pipeline_runs",
    )
