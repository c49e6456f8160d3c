"""Projections and intensity transforms: DataFrames of pixels (image_id, channel, z, y, x, value) or planes (without z)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.neighbours import TILE, ball_least, convolve, disk_extreme, gaussian_weights, lines, plane_keys, tiled, unline
from ..functions.ranges import running
from ..functions.scratch import beside, keep_pixels

PROJECTIONS = {"min": F.min, "max": F.max, "mean": F.avg, "sum": F.sum}
STATS = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "sd": F.stddev_samp, "median": F.median}


def z_project(px: DataFrame, method: str = "max", channel: int | None = None) -> DataFrame:
    """One plane a channel. An unknown method is an error."""
    return z_projections(px, {"value": method}, channel)


def z_projections(px: DataFrame, methods: dict[str, str], channel: int | None = None) -> DataFrame:
    """Several projections side by side, in one pass; methods: a method for each new column's name. Planes, which have no z, are their own projections."""
    for method in methods.values():
        if method not in PROJECTIONS:
            raise ValueError(f"unknown projection {method!r}; there are {', '.join(PROJECTIONS)}")
    own = px if channel in (None, -1) else px.filter(F.col("channel") == channel)
    if "z" not in px.columns:
        return own.select("image_id", "channel", "y", "x", *[F.col("value").alias(name) for name in methods])
    return own.groupBy("image_id", "channel", "y", "x").agg(*[PROJECTIONS[m]("value").alias(name) for name, m in methods.items()])


#: Distinct values of a channel that are ranked in one task; more are ranked in ranges.
RANKED = 1 << 18


def percentiles(px: DataFrame, shares: list[float], value: Column | None = None, ranked: int = RANKED) -> DataFrame:
    """(image_id, channel, p): exact percentiles of each channel's values that are not null, between neighbours linear.

    Values are counted before they are shuffled, and ranked by a running sum over the sorted counts: in one task where all channels
    are known to have few distinct values, else in ranges of them.
    """
    key = ["image_id", "channel"]
    counts = px.select(*key, (F.col("value") if value is None else value).alias("v")).groupBy(*key, "v").agg(F.count("*").alias("n"))
    # nulls go once they are counted: before, their test would be pushed to where pixels are made, and repeat the pixels' formula for each use in value
    counts = keep_pixels(counts, "counts").filter("v IS NOT NULL")
    totals = keep_pixels(counts.groupBy(*key).agg(F.sum("n").alias("total"), F.count("*").alias("distinct")), "totals")
    if totals.filter(F.col("distinct") > ranked).isEmpty():
        ranks = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    else:
        ranks = running(counts, key, "v", ["n"]).withColumnRenamed("upto_n", "upto")
    known = ranks.join(totals.drop("distinct"), key)
    place = lambda share: F.lit(share) * (F.col("total") - 1)
    at = lambda k: F.max(F.when((F.col("upto") - F.col("n") <= k) & (k < F.col("upto")), F.col("v")))
    both = [F.struct(at(F.floor(place(s))).alias("a"), at(F.ceil(place(s))).alias("b"), F.max(place(s) - F.floor(place(s))).alias("f")) for s in shares]
    return known.groupBy(*key).agg(F.array(*both).alias("s")).select(*key, F.transform("s", lambda x: x["a"] + x["f"] * (x["b"] - x["a"])).alias("p"))


def z_project_stats(px: DataFrame, methods: tuple[str, ...] = ()) -> DataFrame:
    """(image_id, channel, method, y, x, value); with no method chosen the maximum. One pass whatever the number."""
    methods = methods or ("max",)
    if set(methods) - set(STATS):
        raise ValueError(f"unknown statistics {sorted(set(methods) - set(STATS))}")
    wide = px.groupBy("image_id", "channel", "y", "x").agg(*[STATS[m]("value").cast("double").alias(m) for m in methods])
    return wide.unpivot(["image_id", "channel", "y", "x"], list(methods), "method", "value")


def _on(px: DataFrame, channel: int | None, change: Column) -> DataFrame:
    """change applied to one channel's values, or to all."""
    value = change if channel is None else F.when(F.col("channel") == channel, change).otherwise(F.col("value"))
    return px.withColumn("value", value)


def _put(px: DataFrame, channel: int | None, out: DataFrame) -> DataFrame:
    """px with out in place of one channel's pixels, or of all.

    There the channel is a constant, so that what reads another channel needs nothing of out; else each step of a job would do the work of those before it twice.
    """
    if channel is None:
        return out
    return px.filter(F.col("channel") != channel).unionByName(out.withColumn("channel", F.lit(channel).cast(px.schema["channel"].dataType)))


def _clip(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def channel_range(px: DataFrame, method: str = "minmax", low_pct: float = 1.0, high_pct: float = 99.0) -> DataFrame:
    """(image_id, channel, lo, hi) over the whole stack; percentiles are exact, between neighbours linear."""
    if method == "minmax":
        return px.groupBy("image_id", "channel").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    if method != "percentile":
        raise ValueError(f"unknown normalization method {method!r}")
    return percentiles(px, [low_pct / 100, high_pct / 100]).select("image_id", "channel", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))


def normalize(px: DataFrame, channel: int | None = None, method: str = "minmax", low_pct: float = 1.0, high_pct: float = 99.0) -> DataFrame:
    """Values to [0, 1]; a channel of one value becomes 0."""
    own = px if channel is None else px.filter(F.col("channel") == channel)
    known = px.join(beside(channel_range(own, method, low_pct, high_pct)), ["image_id", "channel"], "left")
    span = F.col("hi") - F.col("lo")
    return _on(known, channel, _clip((F.col("value") - F.col("lo")) / F.when(span > 0, span).otherwise(1.0))).drop("lo", "hi")


def brightness_contrast(px: DataFrame, channel: int | None = None, lo: float = 0.0, hi: float = 65535.0) -> DataFrame:
    return _on(px, channel, _clip((F.col("value") - lo) / F.lit(hi - lo if hi > lo else 1.0)))


def gaussian_blur(px: DataFrame, channel: int | None = None, sigma: float = 2.0, truncate: float = 4.0) -> DataFrame:
    """Separable blur, first along y and then along x. Two shuffles of line arrays whatever sigma is."""
    own = px if channel is None else px.filter(F.col("channel") == channel)
    out = own
    if sigma > 0:
        weights = gaussian_weights(sigma, truncate)
        for along in ("y", "x"):
            line, key = lines(out, along)
            out = unline(convolve(line, weights), key, along)
    return _put(px, channel, out.select(*px.columns))


def background_subtract(px: DataFrame, channel: int | None = None, radius: float = 50.0, method: str = "rolling_ball", tile: int = TILE) -> DataFrame:
    """Value less its background, per slice: a ball rolled under the surface (Sternberg 1983), or an opening by a disk."""
    if method not in ("rolling_ball", "tophat"):
        raise ValueError(f"unknown background method {method!r}")
    own = px if channel is None else px.filter(F.col("channel") == channel)
    def rolled(block: np.ndarray) -> np.ndarray:
        return np.maximum(0, block - ball_least(block, radius))

    def tophat(block: np.ndarray) -> np.ndarray:
        return block - disk_extreme(disk_extreme(block, int(radius)), int(radius), largest=True)

    halo = int(radius) * (2 if method == "tophat" else 1)
    return _put(px, channel, tiled(own, halo, tophat if method == "tophat" else rolled, tile).select(*px.columns))


def rescale_uint8(pl: DataFrame) -> DataFrame:
    """Values to whole numbers 0..255 per plane; a plane of one value becomes 0."""
    key = plane_keys(pl)
    known = pl.join(beside(pl.groupBy(*key).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))), key)
    span = F.col("hi") - F.col("lo")
    return known.withColumn("value", F.coalesce(F.floor((F.col("value") - F.col("lo")) / F.nullif(span, F.lit(0.0)) * 255), F.lit(0)).cast("int")).drop("lo", "hi")


def contrast_limits(px: DataFrame, low: float = 1.0, high: float = 99.5) -> DataFrame:
    """(image_id, channel, lo, hi): percentiles of the finite values, or their range, or lo and lo + 1; (0, 1) with none."""
    v = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    got = px.groupBy("image_id", "channel").agg(F.min(v).alias("a"), F.max(v).alias("b")).join(percentiles(px, [low / 100, high / 100], v), ["image_id", "channel"], "left")
    wide = F.col("p")[1] > F.col("p")[0]
    lo = F.when(F.col("a").isNull(), 0.0).when(wide, F.col("p")[0]).otherwise(F.col("a"))
    hi = F.when(F.col("a").isNull(), 1.0).when(wide, F.col("p")[1]).when(F.col("b") > F.col("a"), F.col("b")).otherwise(F.col("a") + 1)
    return got.select("image_id", "channel", lo.alias("lo"), hi.alias("hi"))


def contrast_stretch(pl: DataFrame, saturation: float = 1.0, cap: float = 0.0) -> DataFrame:
    """Values to [0, 1] for display: saturation percent of the pixels are clipped, half at each end; any positive cap is the upper limit."""
    half = saturation / 200
    rng = percentiles(pl, [half, 1 - half])
    hi = F.lit(float(cap)) if cap > 0 else F.col("p")[1]
    known = pl.join(beside(rng.select("image_id", "channel", F.col("p")[0].alias("lo"), hi.alias("hi"))), ["image_id", "channel"])
    span = F.col("hi") - F.col("lo")
    return known.withColumn("value", _clip((F.col("value") - F.col("lo")) / F.when(span > 0, span).otherwise(1.0))).drop("lo", "hi")


def focus_score(px: DataFrame) -> DataFrame:
    """(image_id, channel, z, score): the mean squared Laplacian of a slice's inner pixels, 0 without any."""
    key = plane_keys(px)
    row, col = Window.partitionBy(*key, "y").orderBy("x"), Window.partitionBy(*key, "x").orderBy("y")
    v = F.col("value")
    both = px.withColumns({"h": F.lag("value").over(row) + F.lead("value").over(row)}).withColumn("v2", F.lag("value").over(col) + F.lead("value").over(col))
    lap = 4 * v - F.col("h") - F.col("v2")
    return both.groupBy(*key).agg(F.coalesce(F.avg(lap * lap), F.lit(0.0)).alias("score"))


def sharpest_slice(px: DataFrame) -> DataFrame:
    """(image_id, channel, slice), from 1; the first of equals."""
    nth = F.row_number().over(Window.partitionBy("image_id", "channel").orderBy(F.col("score").desc(), "z"))
    return focus_score(px).withColumn("n", nth).filter("n = 1").select("image_id", "channel", (F.col("z") + 1).cast("int").alias("slice"))


def middle_slice(px: DataFrame, override: int = 0) -> DataFrame:
    """(image_id, slice), from 1; a positive override wins."""
    n = F.max("z") + 1
    return px.groupBy("image_id").agg((F.lit(override) if override > 0 else F.floor((n + 1) / 2)).cast("int").alias("slice"))


def crop_around_roi(px: DataFrame, lab: DataFrame, frame: DataFrame, radius: int = 100) -> DataFrame:
    """All channels and slices of a square of side 2 * radius around the mask's box, shifted into the frame; y and x count from its corner."""
    box = lab.groupBy("image_id").agg(F.min("y").alias("t"), F.max("y").alias("b"), F.min("x").alias("l"), F.max("x").alias("r"))
    corner = lambda lo, hi: F.expr(f"CAST({lo} + ({hi} + 1 - {lo}) / 2 - {radius} AS INT)")
    inside = lambda c, size: F.greatest(F.lit(0), F.least(c, F.col(size) - 2 * radius))
    box = box.join(frame, "image_id").select("image_id", inside(corner("t", "b"), "height").alias("y0"), inside(corner("l", "r"), "width").alias("x0"))
    own = px.join(box, "image_id").filter(F.col("y").between(F.col("y0"), F.col("y0") + 2 * radius - 1) & F.col("x").between(F.col("x0"), F.col("x0") + 2 * radius - 1))
    return own.withColumns({"y": (F.col("y") - F.col("y0")).cast("int"), "x": (F.col("x") - F.col("x0")).cast("int")}).select(*px.columns)


def extract_slice(px: DataFrame, idx: int) -> DataFrame:
    """One slice (from 1) in 8-bit grey."""
    return rescale_uint8(px.filter(F.col("z") == idx - 1)).drop("z")
