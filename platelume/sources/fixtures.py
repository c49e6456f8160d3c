"""Image tables that Spark derives from the star-schema tables: a synthetic plate, one image stack a supplier (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import apart

SIDE = 32
#: Image stacks that are one task's.
STACKS = 128
VALUE = """CAST((x*3 + y*5 + z*7 + image_id*11 + channel*13) % 17
  + CASE WHEN (y-cy)*(y-cy)+(x-cx)*(x-cx) <= 25 + (image_id%3)*8 THEN 120 - 10*abs(z-1) ELSE 0 END
  + CASE WHEN (y-cy)*(y-cy)+(x-cx-9-channel)*(x-cx-9-channel) <= 16 THEN 90 ELSE 0 END
  + CASE WHEN channel = 0 AND (y-24)*(y-24)+(x-24)*(x-24) BETWEEN 9 AND 25 THEN 100 ELSE 0 END AS DOUBLE)"""


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("image_id"))


def _stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers in as many partitions as the pixels made of them are worth: their own file is a single task's, whatever it comes to hold.

    An image stays in one partition, so that what is grouped by image and place needs no exchange.
    """
    own = _suppliers(spark, sf_dir)
    return own.repartition(max(1, -(-own.count() // STACKS)), "image_id")


def _upto(df: DataFrame, name: str, n: int) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _suppliers(spark, sf_dir).select(
        "image_id",
        F.concat(F.lit("/plate/img_"), F.col("image_id").cast("string"), F.lit(".vsi")).alias("path"),
        F.array(F.lit("DAPI"), F.lit("GFP")).alias("channel_names"),
        F.lit(0.5).alias("pixel_size_um"),
        F.lit(1.0).alias("z_step_um"),
    )
    return apart(own)


def pixels(spark: SparkSession, sf_dir: str, joined: bool = True) -> DataFrame:
    """(image_id, channel, z, y, x, value), 2 channels of 3 slices of 32 x 32; joined: to be joined to other pixels, not only to rows a plane."""
    px = _upto(_upto(_upto(_upto(_stacks(spark, sf_dir), "channel", 2), "z", 3), "y", SIDE), "x", SIDE)
    px = px.withColumns({"cy": F.expr("(image_id*7)%9 + 9"), "cx": F.expr("(image_id*5)%7 + 9")})
    px = px.select("image_id", "channel", "z", "y", "x", F.expr(VALUE).alias("value"))
    return apart(px) if joined else px


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plate's file listing (path), with ROI files and names that are no wells."""
    w = _suppliers(spark, sf_dir).withColumnRenamed("image_id", "k")
    w = w.withColumns({"r": F.expr("chr(65 + CAST(floor(k/24) AS INT) % 16)"), "cf": F.expr("CAST(k%24+1 AS STRING) || '-' || CAST(1+CAST(floor(k/384) AS INT) AS STRING)")})
    acquired = _upto(w, "v", 3).filter("v=0 OR (v=1 AND k%10<>9) OR (v=2 AND k%13=0)")
    parts = [
        acquired.selectExpr("'/plate/__EXP_P1_' || r || cf || '_' || lpad(CAST(2*k+v+1 AS STRING),5,'0') || '.vsi' AS path"),
        w.filter("k%20=0").selectExpr("'/plate/overview_' || CAST(k AS STRING) || '.vsi' AS path"),
        w.filter("k%3=0").selectExpr("'/out/rois/_' || r || cf || '_hole.roi' AS path"),
        w.filter("k%6=0").selectExpr("'/out/rois/_' || r || cf || '_background.tif' AS path"),
        w.filter("k%4=0").selectExpr("'/plate/class' || CAST(1+k%2 AS STRING) || '___EXP_P1_' || CASE WHEN k%8=0 THEN lower(r) ELSE r END || cf || '_00002.roi' AS path"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def roi_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, ord, vrow, vcol): a diamond around each image's main disk."""
    d = _suppliers(spark, sf_dir).withColumns({"cy": F.expr("(image_id*7)%9 + 9"), "cx": F.expr("(image_id*5)%7 + 9")})
    corner = F.explode(F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for o, dy, dx in ((0, -8, 0), (1, 0, 8), (2, 8, 0), (3, 0, -8))]))
    return d.withColumn("c", corner).selectExpr("image_id", "c.ord AS ord", "CAST(cy+c.dy AS INT) AS vrow", "CAST(cx+c.dx AS INT) AS vcol")


def class_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, label, prob), as a pixel classifier would give them."""
    px = pixels(spark, sf_dir).filter("channel=0 AND z=1")
    return px.selectExpr("image_id", "y", "x", "CAST(CASE WHEN value>=100 THEN 2 WHEN value>=60 THEN 3 ELSE 1 END AS INT) AS label", "least(1.0D, value/128D) AS prob")


def noise_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 embeddings a 64-row image; the last image may have fewer rows than columns."""
    e = apart(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).selectExpr("vec_id", "posexplode(embedding) AS (x, v)")
    return e.selectExpr("CAST(floor(vec_id/64) AS BIGINT) AS image_id", "0 AS channel", "0 AS z", "CAST(vec_id%64 AS INT) AS y", "CAST(x AS INT) AS x", "CAST(floor((CAST(v AS DOUBLE)+1D)*128D) AS DOUBLE) AS value")


#: What a user would have chosen (label, source, existing_tag).
SELECTIONS = [("Whole image", "whole", ""), ("Hole ROI", "well_hole", ""), ("Back ground!", "well_background", ""), ("Class 1", "well_existing", "class1"), ("Class 2", "well_existing", "CLASS2"), ("Auto", "auto", "")]


def roi_selections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SELECTIONS, "label string, source string, existing_tag string")
