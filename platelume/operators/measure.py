"""Measurements of labelled particles, regions and channel pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import runs
from ..functions.neighbours import frame_of
from ..functions.scratch import apart
from ..sources.files import channel_name
from .intensity import z_project
from .segment import above, connected_components, dilate_mask, threshold_otsu


def apply_roi(rows: DataFrame, roi: DataFrame | None) -> DataFrame:
    """The rows inside the region; a label that it cuts stays one label."""
    return rows if roi is None else rows.join(apart(roi.select("image_id", "y", "x")), ["image_id", "y", "x"], "left_semi").select(*rows.columns)


def zero_outside(pl: DataFrame, roi: DataFrame | None) -> DataFrame:
    """Plane values, 0 outside the region."""
    if roi is None:
        return pl
    inside = roi.select("image_id", "y", "x").distinct().withColumn("in_roi", F.lit(True))
    return pl.join(apart(inside), ["image_id", "y", "x"], "left").withColumn("value", F.when(F.col("in_roi"), F.col("value")).otherwise(0.0)).select(*pl.columns)


def _label_key(lab: DataFrame) -> list[str]:
    return [c for c in lab.columns if c not in ("y", "x")]


def particle_stats(lab: DataFrame, pl: DataFrame) -> DataFrame:
    """A row a label: area, intensities, centroid and half-open bounding box."""
    key = _label_key(lab)
    on = ["image_id", *(["channel"] if "channel" in key else []), "y", "x"]
    own = lab.join(apart(pl.select(*on, "value")), on)
    return own.groupBy(*key).agg(
        F.count("*").alias("area_px"),
        F.avg("value").alias("mean_intensity"),
        F.max("value").alias("max_intensity"),
        F.min("value").alias("min_intensity"),
        F.avg("y").alias("centroid_row"),
        F.avg("x").alias("centroid_col"),
        F.min("y").alias("top"),
        F.min("x").alias("left"),
        (F.max("y") + 1).alias("bottom"),
        (F.max("x") + 1).alias("right"),
    )


#: What a border pixel adds to the perimeter, by 1 + 2 * border neighbours at its sides + 10 * at its corners.
PERIMETER = {5: 1.0, 7: 1.0, 15: 1.0, 17: 1.0, 25: 1.0, 27: 1.0, 21: math.sqrt(2), 33: math.sqrt(2), 13: (1 + math.sqrt(2)) / 2, 23: (1 + math.sqrt(2)) / 2}


def particle_perimeter(lab: DataFrame) -> DataFrame:
    """(.., label, perimeter_px), from the border pixels (those with a side outside the label) and how they adjoin."""
    return runs.perimeters(runs.encode(lab), PERIMETER).withColumnRenamed("perimeter", "perimeter_px")


def particle_circularity(stats: DataFrame) -> DataFrame:
    """stats (.., area_px, perimeter_px) with circularity, 0 without a perimeter; it may exceed 1."""
    p = F.nullif(F.coalesce("perimeter_px", F.lit(0.0)), F.lit(0.0))
    return stats.withColumns({"perimeter_px": F.coalesce("perimeter_px", F.lit(0.0)), "circularity": F.coalesce(4 * math.pi * F.col("area_px") / (p * p), F.lit(0.0))})


def particle_eccentricity(lab: DataFrame) -> DataFrame:
    """(.., label, eccentricity) of the ellipse with the label's second central moments (a pixel's own moment, 1/12, included)."""
    key = _label_key(lab)
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    m = lab.groupBy(*key).agg(F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(x).alias("sx"), F.sum(y * y).alias("syy"), F.sum(x * x).alias("sxx"), F.sum(y * x).alias("sxy"))
    n = F.col("n")
    m = m.withColumns({"a": F.col("syy") / n - (F.col("sy") / n) ** 2 + 1 / 12, "c": F.col("sxx") / n - (F.col("sx") / n) ** 2 + 1 / 12, "b": F.col("sxy") / n - F.col("sy") / n * (F.col("sx") / n)})
    root = F.sqrt(((F.col("a") - F.col("c")) / 2) ** 2 + F.col("b") ** 2)
    l1, l2 = (F.col("a") + F.col("c")) / 2 + root, (F.col("a") + F.col("c")) / 2 - root
    return m.select(*key, F.when(l1 <= 0, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 1 - l2 / l1))).alias("eccentricity"))


def particle_solidity(lab: DataFrame) -> DataFrame:
    """(.., label, solidity): area over the pixel area of the convex hull."""
    return runs.hull_areas(runs.encode(lab)).withColumn("solidity", F.col("area") / F.col("hull")).drop("area", "hull")


def particle_filter(stats: DataFrame, min_size_um2: float = 0.5, max_size_um2: float = 5000.0, min_circularity: float = 0.0) -> DataFrame:
    """Bounds are inclusive; one that is 0 is none."""
    for on, test in ((min_size_um2 > 0, F.col("area_um2") >= min_size_um2), (max_size_um2 > 0, F.col("area_um2") <= max_size_um2), (min_circularity > 0, F.col("circularity") >= min_circularity)):
        stats = stats.filter(test) if on else stats
    return stats


def fallback_labels(px: DataFrame, channel: int, mask: DataFrame | None, projection: str = "max") -> DataFrame:
    """Labels (image_id, label, y, x): without a mask Otsu's; images whose largest label is 1 are labelled anew, 8-connected."""
    if mask is None:
        pl = z_project(px, projection, channel)
        return connected_components(above(pl, threshold_otsu(pl)).select("image_id", "y", "x"), 8)
    if "label" not in mask.columns:
        return connected_components(mask.select("image_id", "y", "x"), 8)
    own = mask.select("image_id", "label", "y", "x")
    single = own.groupBy("image_id").agg(F.max("label").alias("m")).filter("m = 1")
    new = connected_components(own.join(single, "image_id", "left_semi").select("image_id", "y", "x"), 8)
    return own.join(single, "image_id", "left_anti").unionByName(new.select(*own.columns))


def _named(df: DataFrame, images: DataFrame, channel: int, name: str = "channel") -> DataFrame:
    return df.withColumn(name, channel_name(F.col("channel_names"), F.lit(channel)))


MEASURED = ["image_id", "channel", "roi_mask", "roi_path", "label", "area_px", "area_um2", "perimeter_px", "circularity", "eccentricity", "solidity", "mean_intensity", "max_intensity", "min_intensity", "centroid_row", "centroid_col"]


def particle_analysis(px: DataFrame, lab: DataFrame, images: DataFrame, channel: int = 0, roi: DataFrame | None = None, roi_name: str = "", roi_path: str = "", min_size_um2: float = 0.5, max_size_um2: float = 5000.0, min_circularity: float = 0.0, projection: str = "max") -> DataFrame:
    """A row a particle, in the columns of particle_measurements. Images without particles have no rows."""
    own = apply_roi(lab.select("image_id", "label", "y", "x"), roi)
    stats = particle_stats(own, z_project(px, projection, channel).drop("channel"))
    shape = [particle_perimeter(own), particle_eccentricity(own), particle_solidity(own)]
    for s in shape:
        stats = stats.join(apart(s), ["image_id", "label"], "left")
    stats = particle_circularity(stats).join(images.select("image_id", "channel_names", "pixel_size_um"), "image_id")
    stats = stats.withColumn("area_um2", F.col("area_px") * F.col("pixel_size_um") * F.col("pixel_size_um"))
    stats = _named(particle_filter(stats, min_size_um2, max_size_um2, min_circularity), images, channel)
    return stats.withColumns({"roi_mask": F.lit(roi_name or "whole_image"), "roi_path": F.lit(roi_path if roi_name else "")}).select(*MEASURED)


def surviving_labels(lab: DataFrame, particles: DataFrame) -> DataFrame:
    return lab.join(apart(particles.select("image_id", "label")), ["image_id", "label"], "left_semi").select(*lab.columns)


def intensity_measurement(px: DataFrame, images: DataFrame, channel: int = 0, projection: str = "max", roi: DataFrame | None = None, roi_name: str = "", roi_path: str = "") -> DataFrame:
    """A row an image: mean, sum, population deviation and area over the region or the frame; 0 where it is empty."""
    pl = z_project(px, projection, channel)
    got = apply_roi(pl, roi).groupBy("image_id").agg(F.avg("value").alias("m"), F.sum("value").alias("s"), F.stddev_pop("value").alias("d"), F.count("*").alias("n"))
    every = px.select("image_id").distinct().join(got, "image_id", "left").join(images, "image_id")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n = F.coalesce("n", F.lit(0))
    return _named(every, images, channel).select("image_id", "channel", F.lit(roi_name or "whole_image").alias("roi_mask"), F.lit(roi_path if roi_name else "").alias("roi_path"), zero("m").alias("mean_intensity"), zero("s").alias("sum_intensity"), zero("d").alias("std_intensity"), n.alias("area_px"), (n * F.col("pixel_size_um") * F.col("pixel_size_um")).alias("area_um2"))


# ---- pairs of channels -----------------------------------------------------------------------

_TINY = 1e-10


def _paired(p: DataFrame, s: DataFrame, lab: DataFrame | None = None) -> DataFrame:
    """(image_id, y, x, a, b): both planes' values, and on where lab has a pixel."""
    both = p.select("image_id", "y", "x", F.col("value").alias("a")).join(apart(s.select("image_id", "y", "x", F.col("value").alias("b"))), ["image_id", "y", "x"])
    return both if lab is None else both.join(apart(lab.select("image_id", "y", "x").distinct().withColumn("on", F.lit(True))), ["image_id", "y", "x"], "left")


def _shares() -> list[Column]:
    share = lambda c: F.coalesce(F.sum(F.when(F.col("on"), F.col(c))), F.lit(0.0)) / (F.sum(c) + _TINY)
    return [share("a").alias("m1"), share("b").alias("m2")]


def _correlation() -> Column:
    n, sa, sb = F.count("*"), F.sum("a"), F.sum("b")
    va, vb = F.sum(F.col("a") * F.col("a")) - sa * sa / n, F.sum(F.col("b") * F.col("b")) - sb * sb / n
    return ((F.sum(F.col("a") * F.col("b")) - sa * sb / n) / (F.sqrt(F.greatest(F.lit(0.0), va * vb)) + _TINY)).alias("r")


def manders(p: DataFrame, s: DataFrame, lab: DataFrame) -> DataFrame:
    """(image_id, m1, m2): the share of each plane's sum that lies in the primary mask."""
    return _paired(p, s, lab).groupBy("image_id").agg(*_shares())


def pearson(p: DataFrame, s: DataFrame) -> DataFrame:
    """(image_id, r) over all pixels; 0 for constant planes."""
    return _paired(p, s).groupBy("image_id").agg(_correlation())


def rotate90(pl: DataFrame, frame: DataFrame) -> DataFrame:
    """A counter-clockwise quarter turn: (y, x) goes to (width - 1 - x, y)."""
    own = pl.join(frame, "image_id")
    return own.withColumns({"y": (F.col("width") - 1 - F.col("x")).cast("int"), "x": F.col("y")}).select(*pl.columns)


def manders_random(p: DataFrame, s: DataFrame, lab: DataFrame, frame: DataFrame) -> DataFrame:
    """manders against the turned secondary plane; null for frames that are not square."""
    square = frame.filter("height = width").select("image_id")
    got = manders(p.join(square, "image_id", "left_semi"), rotate90(s.join(square, "image_id", "left_semi"), frame), lab)
    return frame.select("image_id").join(got, "image_id", "left")


def coloc_per_particle(px: DataFrame, lab: DataFrame, images: DataFrame, primary: int = 0, secondary: int = 1, dilation_um: float = 0.0, projection: str = "max", roi: DataFrame | None = None, roi_name: str = "", frame: DataFrame | None = None) -> DataFrame:
    """A row a primary label, grown by dilation_um: its area and what of the secondary plane it holds, zeros included."""
    frame = frame_of(px) if frame is None else frame
    own = apply_roi(lab.select("image_id", "label", "y", "x"), roi)
    grown = dilate_mask(own, dilation_um, images, frame) if dilation_um > 0 else own
    s = zero_outside(z_project(px, projection, secondary).select("image_id", "y", "x", "value"), roi)
    got = grown.join(apart(s), ["image_id", "y", "x"]).groupBy("image_id", "label").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 0).alias("hit"), F.avg("value").alias("m"), F.max("value").alias("top"))
    got = _named(_named(got.join(images, "image_id"), images, primary, "primary_channel"), images, secondary, "secondary_channel")
    return got.select("image_id", "primary_channel", "secondary_channel", F.lit(roi_name or "whole_image").alias("roi_mask"), F.col("label").alias("primary_label"), (F.col("n") * F.col("pixel_size_um") * F.col("pixel_size_um")).alias("primary_area_um2"), F.col("hit").alias("n_secondary_pixels"), F.col("m").alias("secondary_mean_intensity"), F.col("top").alias("secondary_max_intensity"), (F.col("hit") / F.col("n")).alias("overlap_fraction"))


def coloc_global(px: DataFrame, lab: DataFrame, images: DataFrame, primary: int = 0, secondary: int = 1, projection: str = "max", roi: DataFrame | None = None, roi_name: str = "", frame: DataFrame | None = None) -> DataFrame:
    """A row an image that has primary particles: Manders, Pearson, and Manders against the turned secondary."""
    frame = frame_of(px) if frame is None else frame
    own = apply_roi(lab.select("image_id", "label", "y", "x"), roi)
    p, s = (zero_outside(z_project(px, projection, c).select("image_id", "y", "x", "value"), roi) for c in (primary, secondary))
    n = own.groupBy("image_id").agg(F.countDistinct("label").alias("n_primary_particles"))
    both = _paired(p, s, own).groupBy("image_id").agg(*_shares(), _correlation())  # one join for all
    turned = manders_random(p, s, own, frame).withColumnsRenamed({"m1": "manders_m1_random", "m2": "manders_m2_random"})
    out = n.join(both.withColumnsRenamed({"m1": "manders_m1", "m2": "manders_m2", "r": "pearson_r"}), "image_id").join(turned, "image_id").join(images, "image_id")
    out = _named(_named(out, images, primary, "primary_channel"), images, secondary, "secondary_channel")
    return out.select("image_id", "primary_channel", "secondary_channel", F.lit(roi_name or "whole_image").alias("roi_mask"), "manders_m1", "manders_m2", "pearson_r", "manders_m1_random", "manders_m2_random", "n_primary_particles")


def particles_per_image(images: DataFrame, particles: DataFrame) -> DataFrame:
    n = particles.groupBy("image_id").agg(F.count("*").alias("n_particles"))
    return images.select("image_id").join(n, "image_id", "left").select("image_id", F.coalesce("n_particles", F.lit(0)).alias("n_particles"))


def centroids_um(particles: DataFrame, images: DataFrame) -> DataFrame:
    own = particles.join(images.select("image_id", "pixel_size_um"), "image_id")
    return own.select("image_id", "label", (F.col("centroid_row") * F.col("pixel_size_um")).alias("y_um"), (F.col("centroid_col") * F.col("pixel_size_um")).alias("x_um"))


def channel_pairs(images: DataFrame) -> DataFrame:
    """(image_id, primary, secondary): neighbouring channels."""
    own = images.select("image_id", F.posexplode("channel_names").alias("primary", "name"))
    return own.withColumn("secondary", F.lead("primary").over(Window.partitionBy("image_id").orderBy("primary"))).filter("secondary IS NOT NULL").select("image_id", "primary", "secondary")
