"""Thresholds, masks and regions of interest.

A plane is (image_id, [channel,] y, x, value); a mask or label table is sparse: (image_id, [..,] y, x, [label]) of the
pixels that are set. Ties are in raster order throughout.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import forest, runs
from ..functions.neighbours import frame_of
from ..functions.ranges import running
from ..functions.scratch import apart, beside, drop, keep, keep_pixels
from .intensity import gaussian_blur, z_project

BINS = 256

# ---- automatic thresholds --------------------------------------------------------------------


def _centre(at: Column) -> Column:
    return F.col("lo") + (at + 0.5) * (F.col("hi") - F.col("lo")) / BINS


def histogram(pl: DataFrame) -> DataFrame:
    """(image_id, channel, lo, hi, bin, n, centre): of the BINS bins of each plane's own range those that hold a pixel."""
    key = ["image_id", "channel"]
    rng = pl.groupBy(*key).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    span = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    at = F.least(F.lit(BINS - 1), F.coalesce(F.floor((F.col("value") - F.col("lo")) / span * BINS), F.lit(0))).cast("int")
    counts = pl.join(beside(rng), key).groupBy(*key, "lo", "hi", at.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("centre", _centre(F.col("bin")))


def _windows() -> tuple:
    """Bins up to and with this one, bins after it, and all bins of a plane."""
    whole = Window.partitionBy("image_id", "channel")
    # a frame that grows from the last bin on takes one step a bin; one that reaches to the end takes one for each bin after it
    return whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), whole.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1), whole


def _next() -> Column:
    """The next bin that holds a pixel, or the end."""
    return F.lead("bin", 1, BINS).over(Window.partitionBy("image_id", "channel").orderBy("bin"))


def _best(scored: DataFrame, score: Column, centre: Column | None = None) -> DataFrame:
    """The centre of the first bin of the highest score; a plane of one value has that value."""
    nth = F.row_number().over(Window.partitionBy("image_id", "channel").orderBy(F.col("score").desc_nulls_last(), "bin"))
    chosen = scored.withColumn("score", score).withColumn("nth", nth).filter("nth = 1")
    t = centre if centre is not None else F.col("centre")
    return chosen.select("image_id", "channel", F.when(F.col("hi") <= F.col("lo"), F.col("lo")).otherwise(t).alias("threshold"))


def threshold_otsu(pl: DataFrame) -> DataFrame:
    """(image_id, channel, threshold), Otsu 1979: the largest variance between classes. An empty bin parts the pixels as the bin before it does, so it is never the first."""
    upto, after, _ = _windows()
    nc = F.col("n") * F.col("centre")
    h = histogram(pl).withColumns({"w1": F.sum("n").over(upto), "w2": F.sum("n").over(after), "s1": F.sum(nc).over(upto), "s2": F.sum(nc).over(after)})
    gap = F.col("s1") / F.nullif(F.col("w1"), F.lit(0)) - F.col("s2") / F.nullif(F.col("w2"), F.lit(0))
    return _best(h.filter(f"bin < {BINS - 1}"), F.col("w1").cast("double") * F.col("w2") * gap * gap)


def threshold_yen(pl: DataFrame) -> DataFrame:
    """Yen 1995: the largest correlation criterion."""
    upto, after, whole = _windows()
    p = F.col("n") / F.sum("n").over(whole)
    h = histogram(pl).withColumn("p", p)
    h = h.withColumns({"p1": F.sum("p").over(upto), "q1": F.sum(F.col("p") * F.col("p")).over(upto), "q2": F.sum(F.col("p") * F.col("p")).over(after)})
    top = F.col("p1") * (1 - F.col("p1"))
    return _best(h.filter(f"bin < {BINS - 1}"), top * top / F.nullif(F.col("q1") * F.col("q2"), F.lit(0.0)))


def threshold_triangle(pl: DataFrame) -> DataFrame:
    """Zack 1977: the bin farthest from the line between the peak and the end of the longer tail."""
    whole = _windows()[2]
    h = histogram(pl)
    peak = F.first("bin").over(Window.partitionBy("image_id", "channel").orderBy(F.col("n").desc(), "bin"))
    h = h.withColumns({"peak": peak, "top": F.max("n").over(whole), "low": F.min("bin").over(whole), "high": F.max("bin").over(whole), "next": _next()})
    flip = (F.col("peak") - F.col("low")) < (F.col("high") - F.col("peak"))
    # of the empty bins up to the next one that is not, the one nearest to the peak is the farthest from the line
    own, end = F.struct("bin", "n"), F.struct(F.when(flip, F.col("bin") + 1).otherwise(F.col("next") - 1).alias("bin"), F.lit(0).cast("long").alias("n"))
    gap = (F.col("next") > F.col("bin") + 1) & (F.col("bin") < F.col("high"))
    h = h.withColumn("at", F.explode(F.when(gap, F.array(own, end)).otherwise(F.array(own)))).withColumns({"bin": F.col("at.bin"), "n": F.col("at.n")}).withColumn("centre", _centre(F.col("bin")))
    # seen from the longer tail, x bins from its end to the peak
    h = h.withColumns({"flip": flip, "x": F.when(flip, F.col("high") - F.col("bin")).otherwise(F.col("bin") - F.col("low")), "width": F.when(flip, F.col("high") - F.col("peak")).otherwise(F.col("peak") - F.col("low"))})
    inside = (F.col("x") >= 0) & (F.col("x") < F.greatest(F.lit(1), F.col("width")))
    norm = F.sqrt(F.col("top").cast("double") * F.col("top") + F.col("width") * F.col("width"))
    far = F.col("top") / norm * F.col("x") - F.col("width") / norm * F.col("n")
    nth = F.row_number().over(Window.partitionBy("image_id", "channel").orderBy(F.col("score").desc(), "x"))
    chosen = h.filter(inside).withColumn("score", far).withColumn("nth", nth).filter("nth = 1")
    return chosen.select("image_id", "channel", F.when(F.col("hi") <= F.col("lo"), F.col("lo")).otherwise(F.col("centre")).alias("threshold"))


def threshold_isodata(pl: DataFrame) -> DataFrame:
    """Ridler and Calvard 1978: the lowest bin that lies within a bin below the middle of its classes' means."""
    upto, after, _ = _windows()
    nc = F.col("n") * F.col("centre")
    h = histogram(pl).withColumns({"w1": F.sum("n").over(upto), "w2": F.sum("n").over(after), "s1": F.sum(nc).over(upto), "s2": F.sum(nc).over(after), "next": _next()})
    middle = (F.col("s1") / F.nullif(F.col("w1"), F.lit(0)) + F.col("s2") / F.nullif(F.col("w2"), F.lit(0))) / 2
    ok = lambda c: (middle - c >= 0) & (middle - c < (F.col("hi") - F.col("lo")) / BINS)
    # the classes are the same for the empty bins up to the next one that is not
    centres = F.filter(F.transform(F.sequence("bin", F.col("next") - 1), _centre), ok)
    return h.groupBy("image_id", "channel").agg(F.coalesce(F.min(F.array_min(centres)), F.min("lo")).alias("threshold"))


#: Distinct values of a plane that are one row of sums, which the fixed point looks its means up in.
BLOCK = 1 << 16


def _li_steps(t: float, tol: float, v: np.ndarray, n: np.ndarray, s: np.ndarray, end: float, total_n: float, total_s: float, done: int, most: int) -> tuple[float, int, bool]:
    """The fixed point's steps from t while it lies in this block, where n and s are the sums up to each of the values v and end is the next
    block's first value: (t, steps made, whether it has settled)."""
    while done < most:
        if not v[0] <= t < end:
            return t, done, False
        at = np.searchsorted(v, t, side="right") - 1
        back, fore = s[at] / n[at], (total_s - s[at]) / (total_n - n[at]) if total_n > n[at] else np.nan
        log = np.log(back) - np.log(fore) if back > 0 and fore > 0 else 0.0
        new = (back - fore) / log if log else t
        done += 1
        moved, t = abs(new - t), new
        if moved <= tol:
            return t, done, True
    return t, done, True


def threshold_li(pl: DataFrame, rounds: int = 200, block: int = BLOCK) -> DataFrame:
    """Li and Tam 1998: the fixed point of minimum cross entropy, from the mean; over each plane's distinct values and their counts.

    Counts and moments are summed up once, in ranges of values. A row holds the sums of block values, and a plane's steps go on in it until they leave
    it for another row: one look at a row for planes of up to block distinct values, and a few for others.
    """
    key = ["image_id", "channel"]
    lo = pl.groupBy(*key).agg(F.min("value").alias("lo"))
    counts = pl.groupBy(*key, "value").agg(F.count("*").cast("double").alias("n")).join(apart(lo), key)
    counts = keep_pixels(counts.select(*key, "lo", (F.col("value") - F.col("lo")).alias("v"), "n", ((F.col("value") - F.col("lo")) * F.col("n")).alias("s")), "values")
    sums = running(counts.select(*key, "v", "n", "s"), key, "v", ["n", "s"]).withColumn("block", F.floor((F.col("nth") - 1) / block))
    rows = sums.groupBy(*key, "block").agg(F.array_sort(F.collect_list(F.struct("v", F.col("upto_n").alias("n"), F.col("upto_s").alias("s")))).alias("r"))
    column = lambda c: F.transform("r", lambda x: x[c]).alias(c)
    rows = keep_pixels(rows.select(*key, "block", *map(column, ("v", "n", "s"))), "blocks")
    whole = counts.groupBy(*key).agg(F.min("lo").alias("lo"), F.sum("n").alias("total_n"), F.sum("s").alias("total_s"))
    # the least gap of values: within blocks, and from each block to the next
    edges = rows.select(*key, "block", F.col("v")[0].alias("first"), F.element_at("v", -1).alias("end"), F.array_min(F.zip_with(F.slice("v", 2, block), "v", lambda b, a: b - a)).alias("gap"))
    after = F.lead("first").over(Window.partitionBy(*key).orderBy("block"))
    edges = keep_pixels(edges.withColumn("next", after), "edges")  # a row a block
    tol = edges.groupBy(*key).agg((F.min(F.least("gap", F.col("next") - F.col("end"))) / 2).alias("tol"))
    now = whole.join(tol, key).select(*key, "lo", "total_n", "total_s", F.coalesce("tol", F.lit(0.0)).alias("tol"), (F.col("total_s") / F.col("total_n")).alias("t"), F.lit(0).alias("made"), F.lit(False).alias("settled"))
    now = keep_pixels(now, "state")

    @F.pandas_udf("t double, made int, settled boolean")
    def steps(t: pd.Series, tol: pd.Series, v: pd.Series, n: pd.Series, s: pd.Series, end: pd.Series, total_n: pd.Series, total_s: pd.Series, made: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_li_steps(*row, rounds) for row in zip(t, tol, v, n, s, end.fillna(np.inf), total_n, total_s, made, strict=True)], columns=["t", "made", "settled"])

    first = ["lo", "total_n", "total_s", "tol"]
    while not now.filter("NOT settled").isEmpty():
        # a plane waits in the block whose values t lies among
        here = now.filter("NOT settled").join(edges.select(*key, "block", "first", "next"), key).filter((F.col("t") >= F.col("first")) & (F.col("next").isNull() | (F.col("t") < F.col("next"))))
        done = here.join(rows, [*key, "block"]).withColumn("got", steps("t", "tol", "v", "n", "s", "next", "total_n", "total_s", "made"))
        state = now.filter("settled").unionByName(done.select(*key, *first, "got.t", "got.made", "got.settled"))
        before, now = now, keep_pixels(state, "state")
        drop(before)
    return now.select(*key, (F.col("lo") + F.col("t")).alias("threshold"))


THRESHOLDS = {"otsu": threshold_otsu, "yen": threshold_yen, "triangle": threshold_triangle, "isodata": threshold_isodata, "li": threshold_li}


def thresholds(pl: DataFrame, method: str) -> DataFrame:
    if method not in THRESHOLDS:
        raise ValueError(f"unknown threshold {method!r}; there are {', '.join(sorted(THRESHOLDS))}")
    return THRESHOLDS[method](pl)


def above(pl: DataFrame, found: DataFrame) -> DataFrame:
    """The pixels strictly above their plane's threshold, as a mask (image_id, channel, y, x)."""
    return pl.join(beside(found), ["image_id", "channel"]).filter(F.col("value") > F.col("threshold")).select("image_id", "channel", "y", "x")


def auto_threshold(px: DataFrame, channel: int | None = None, method: str = "otsu", projection: str = "max", min_size: int = 50) -> DataFrame:
    """The mask (image_id, channel, y, x) of what is above the threshold, without small objects."""
    return threshold_mask(keep(z_project(px, projection, channel), "plane"), method, min_size)


def threshold_mask(pl: DataFrame, method: str = "otsu", min_size: int = 50) -> DataFrame:
    """auto_threshold() of planes, which are read for their range, their histogram and their mask."""
    mask = above(pl, thresholds(pl, method))
    return remove_small_objects(mask, min_size) if min_size > 0 else mask


# ---- objects ---------------------------------------------------------------------------------


def remove_small_objects(mask: DataFrame, max_size: int) -> DataFrame:
    """mask without the 4-connected objects of max_size pixels or fewer."""
    key = runs.keys(mask)
    lab = runs.components(runs.encode(mask), 4)
    large = lab.groupBy(*key, "first").agg(F.sum(F.col("b") - F.col("a") + 1).alias("n")).filter(F.col("n") > max_size)
    return runs.decode(lab.join(large, [*key, "first"], "left_semi")).select(*mask.columns)


def connected_components(mask: DataFrame, connectivity: int = 8) -> DataFrame:
    """mask with label: 1..n in each image, in raster order of the objects' first pixels."""
    lab = runs.components(runs.encode(mask), connectivity)
    numbered = lab.withColumn("label", F.dense_rank().over(Window.partitionBy(*runs.keys(mask)).orderBy("first")))
    return runs.decode(numbered).select(*mask.columns, "label")


def fill_holes(mask: DataFrame, frame: DataFrame) -> DataFrame:
    """mask with the background that is not 4-connected to the frame's edge."""
    key = runs.keys(mask)
    own = keep_pixels(runs.encode(mask), "runs")
    out = runs.components(runs.gaps(own, frame), 4).join(frame, "image_id")
    edge = (F.col("y") == 0) | (F.col("a") == 0) | (F.col("y") == F.col("height") - 1) | (F.col("b") == F.col("width") - 1)
    open_ = out.groupBy(*key, "first").agg(F.max(edge).alias("open")).filter("open").drop("open")
    filled = out.join(open_, [*key, "first"], "left_anti").select(*own.columns)
    return runs.decode(own.unionByName(filled)).select(*mask.columns)


def envelope(g: np.ndarray) -> np.ndarray:
    """min over q of (x - q)^2 + g[q]^2 for each x of a line, by the lower envelope of its parabolas; NaN: no background in a column."""
    at = np.flatnonzero(~np.isnan(g)).tolist()
    if not at:
        return np.full(len(g), np.nan)
    f = (g * g).tolist()
    low, begins = [at[0]], [-np.inf]  # the parabolas of the envelope, and where each takes over
    for q in at[1:]:
        while True:
            p = low[-1]
            s = (f[q] + q * q - f[p] - p * p) / (2 * (q - p))
            if s > begins[-1]:
                break
            low.pop()
            begins.pop()
        low.append(q)
        begins.append(s)
    x = np.arange(len(g))
    own = np.array(low)[np.searchsorted(begins, x, side="right") - 1]
    return (x - own) ** 2 + g[own] ** 2


def _line_distances(xs: np.ndarray, gs: np.ndarray, width: int) -> np.ndarray:
    """d2 of a line's set pixels xs, whose distances to the background along y are gs. Background beyond a run's ends is never nearer than the ends themselves."""
    out = np.empty(len(xs))
    cut = np.flatnonzero(np.diff(xs) > 1) + 1
    for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(xs)], strict=True):
        left, right = int(xs[i] > 0), int(xs[j - 1] < width - 1)
        own = np.concatenate((np.zeros(left), gs[i:j], np.zeros(right)))
        out[i:j] = envelope(own)[left : len(own) - right]
    return out


def distance_transform(mask: DataFrame, frame: DataFrame) -> DataFrame:
    """mask with d2, the exact squared distance to the nearest background pixel of the frame; null in a frame without background.

    Two passes (Felzenszwalb and Huttenlocher 2012): down each column, where a run of set pixels tells all distances, then along each line, run by run.
    Only columns and lines that the mask touches are looked at.
    """
    key = runs.keys(mask)
    turned = runs.encode(mask.select(*key, F.col("x").alias("y"), F.col("y").alias("x"))).join(frame, "image_id")
    px = turned.select(*key, F.col("y").alias("x"), "a", "b", "height", "width", F.explode(F.sequence("a", "b")).alias("y"))
    g = F.least(F.when(F.col("a") > 0, F.col("y") - F.col("a") + 1), F.when(F.col("b") < F.col("height") - 1, F.col("b") - F.col("y") + 1)).cast("double")
    line = px.groupBy(*key, "y").agg(F.first("width").alias("width"), F.array_sort(F.collect_list(F.struct("x", F.coalesce(g, F.lit(float("nan"))).alias("g")))).alias("r"))

    @F.pandas_udf("array<double>")
    def best(xs: pd.Series, gs: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([_line_distances(np.asarray(x), np.asarray(v), w) for x, v, w in zip(xs, gs, width, strict=True)])

    xs, gs = F.transform("r", lambda s: s["x"]), F.transform("r", lambda s: s["g"])
    found = line.select(*key, "y", xs.alias("x"), best(xs, gs, "width").alias("d")).select(*key, "y", F.explode(F.arrays_zip("x", "d")).alias("p"))
    d = F.col("p.d")
    return found.select(*key, "y", F.col("p.x").alias("x"), F.when(~F.isnan(d), d).cast("long").alias("d2")).select(*mask.columns, "d2")


def local_peaks(mask: DataFrame, frame: DataFrame, min_distance: int = 5) -> DataFrame:
    """mask's distance peaks with their d2: see forest.peaks."""
    return forest.peaks(distance_transform(mask, frame).filter("d2 IS NOT NULL"), frame, min_distance)


def watershed_split(mask: DataFrame, frame: DataFrame, min_distance: int = 5, tile: int = forest.TILE) -> DataFrame:
    """mask with label: touching objects are split at their distance peaks; objects without a peak are left out. Labels 1..n in raster order of their peaks.

    Neighbouring peaks (by side) are one. Each pixel goes with the peak of its tree in the forest of the best edges, see forest.flood.
    """
    key = runs.keys(mask)
    heights = keep_pixels(distance_transform(mask, frame).withColumn("d2", F.coalesce("d2", F.lit(0).cast("long"))), "heights")
    found = runs.encode(forest.peaks(heights, frame, min_distance, tile).drop("d2"))
    seeds = runs.components(found, 4)
    at = F.col("first.y").cast("long") * (1 << 32) + F.col("first.x")
    marks = runs.decode(seeds.withColumn("mark", at)).select(*key, "y", "x", "mark")
    parts = forest.flood(heights.join(marks, [*key, "y", "x"], "left").select(*key, "y", "x", "d2", "mark"), tile)
    number = seeds.withColumn("mark", at).select(*key, "mark").distinct().withColumn("label", F.row_number().over(Window.partitionBy(*key).orderBy("mark")))
    return parts.join(number, [*key, "mark"]).select(*mask.columns, "label")


# ---- regions ---------------------------------------------------------------------------------


def extract_roi(px: DataFrame, channel: int, sigma: float = 20.0, method: str = "otsu", frame: DataFrame | None = None) -> DataFrame:
    """The mask (image_id, y, x) of a channel's bright region: projected, blurred, thresholded (unknown methods: Otsu) and filled. frame: px's, where it is known."""
    pl = keep(gaussian_blur(z_project(px, "max", channel), None, sigma))  # read for its range, its histogram and its mask
    found = THRESHOLDS.get(method, threshold_otsu)(pl)
    return fill_holes(above(pl, found).select("image_id", "y", "x"), frame_of(px) if frame is None else frame)


#: ROIs that hold for every image and are broadcast, at most.
EVERYWHERE = 10_000


def rasterize_polygons(rois: DataFrame, frame: DataFrame) -> DataFrame:
    """rois (image_id or none for every image, vertices array<struct<row, col>>) -> mask (image_id, y, x).

    Coordinates are cut to whole numbers inside the frame; a pixel is in by the even-odd rule or if it lies on the
    outline's vertices or edges; ROIs of fewer than three vertices are left out, and an image's ROIs are united.
    """
    own = rois.filter(F.size("vertices") >= 3)
    if "image_id" in rois.columns:
        own = own.join(frame, "image_id")
    else:  # ROIs for every image: sent to the frames if they are counted few
        few = own.limit(EVERYWHERE + 1).count() <= EVERYWHERE
        own = frame.crossJoin(F.broadcast(own) if few else own)
    clip = lambda v, size: F.greatest(F.lit(0), F.least(v.cast("int"), F.col(size) - 1))
    own = own.withColumn("vs", F.transform("vertices", lambda s: F.struct(clip(s["row"], "height").alias("r"), clip(s["col"], "width").alias("c"))))
    own = own.withColumn("edges", F.zip_with("vs", F.concat(F.slice("vs", 2, F.size("vs")), F.slice("vs", 1, 1)), lambda a, b: F.struct(a["r"].alias("r1"), a["c"].alias("c1"), b["r"].alias("r2"), b["c"].alias("c2"))))
    ext = lambda f, k: f(F.transform("vs", lambda s: s[k]))
    rows = own.select("image_id", "edges", F.explode(F.sequence(ext(F.array_min, "r"), ext(F.array_max, "r"))).alias("y"))
    # a line at a time: between its first and second crossing, third and fourth, .. a pixel is in; so is what lies on an edge
    y = F.col("y")
    place = lambda e: e["c1"] + (y - e["r1"]) * (e["c2"] - e["c1"]) / (e["r2"] - e["r1"])
    rows = rows.select(
        "image_id",
        "y",
        F.array_sort(F.transform(F.filter("edges", lambda e: (e["r1"] > y) != (e["r2"] > y)), place)).alias("cross"),
        F.transform(F.filter("edges", lambda e: (e["r1"] != e["r2"]) & y.between(F.least(e["r1"], e["r2"]), F.greatest(e["r1"], e["r2"]))), place).alias("hits"),
        F.transform(F.filter("edges", lambda e: (e["r1"] == y) & (e["r2"] == y)), lambda e: _run(F.least(e["c1"], e["c2"]), F.greatest(e["c1"], e["c2"]))).alias("flat"),
    )
    pairs = F.when(F.size("cross") > 0, F.transform(F.sequence(F.lit(0), (F.size("cross") / 2 - 1).cast("int")), lambda k: _run(F.ceil(F.get("cross", (2 * k).cast("int"))), F.floor(F.get("cross", (2 * k + 1).cast("int"))))))
    on = F.transform(F.filter("hits", lambda h: h == F.floor(h)), lambda h: _run(h, h))
    runs = rows.select("image_id", "y", F.explode(F.concat(F.coalesce(pairs, F.array().cast("array<struct<a:int,b:int>>")), on, "flat")).alias("run")).filter("run.a <= run.b")
    return runs.select("image_id", "y", F.explode(F.sequence("run.a", "run.b")).alias("x")).distinct()


def _run(a: Column, b: Column) -> Column:
    return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))


def rasterize_bbox(rois: DataFrame, frame: DataFrame) -> DataFrame:
    """rois (image_id, top, left, bottom, right), bottom and right excluded -> mask, cut to the frame."""
    own = rois.join(frame, "image_id")
    own = own.select("image_id", F.greatest(F.lit(0), "top").alias("t"), F.greatest(F.lit(0), "left").alias("l"), (F.least("bottom", "height") - 1).alias("b"), (F.least("right", "width") - 1).alias("r")).filter("t <= b AND l <= r")
    rows = own.select("image_id", F.explode(F.sequence("t", "b")).alias("y"), "l", "r")
    return rows.select("image_id", "y", F.explode(F.sequence("l", "r")).alias("x")).distinct()


def mask_from_image(px: DataFrame) -> DataFrame:
    return px.filter("z = 0 AND channel = 0 AND value > 0").select("image_id", "y", "x")


def resize_mask(mask: DataFrame, own_frame: DataFrame, frame: DataFrame) -> DataFrame:
    """mask, drawn on own_frame, at frame's size: each pixel takes the nearest source pixel."""
    sizes = own_frame.select("image_id", F.col("height").alias("h0"), F.col("width").alias("w0")).join(frame, "image_id")
    to = sizes.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    near = to.withColumns({"sy": F.floor((F.col("y") + 0.5) * F.col("h0") / F.col("height")).cast("int"), "sx": F.floor((F.col("x") + 0.5) * F.col("w0") / F.col("width")).cast("int")})
    return near.join(apart(mask.select("image_id", F.col("y").alias("sy"), F.col("x").alias("sx"))), ["image_id", "sy", "sx"]).select("image_id", "y", "x")


def _shapes(lab: DataFrame) -> DataFrame:
    from .measure import particle_circularity, particle_perimeter

    key = [c for c in lab.columns if c not in ("y", "x")]
    area = lab.groupBy(*key).agg(F.count("*").alias("area_px"))
    return particle_circularity(area.join(particle_perimeter(lab), key, "left"))


def best_component_roi(prob: DataFrame, threshold: float = 0.5, min_area: int = 500, min_circularity: float = 0.1) -> DataFrame:
    """prob (image_id, y, x, prob) -> mask of the 8-connected object of the largest area x circularity that passes; none: the largest object."""
    lab = connected_components(prob.filter(F.col("prob") >= threshold).select("image_id", "y", "x"), 8)
    ok = (F.col("area_px") >= min_area) & (F.col("circularity") >= min_circularity)
    order = Window.partitionBy("image_id").orderBy(ok.desc(), F.when(ok, F.col("area_px") * F.col("circularity")).otherwise(F.col("area_px")).desc(), "label")
    best = _shapes(lab).withColumn("n", F.row_number().over(order)).filter("n = 1")
    return lab.join(best, ["image_id", "label"], "left_semi").select("image_id", "y", "x")


def best_part_roi(lab: DataFrame) -> DataFrame:
    """lab (image_id, label, y, x): of each class the 8-connected part of the highest (area / largest area) x circularity."""
    parts = connected_components(lab.select("image_id", F.col("label").alias("cls"), "y", "x"), 8)
    score = F.col("area_px") / F.max("area_px").over(Window.partitionBy("image_id", "cls")) * F.col("circularity")
    best = _shapes(parts).withColumn("score", score).withColumn("n", F.row_number().over(Window.partitionBy("image_id", "cls").orderBy(F.col("score").desc(), "label"))).filter("n = 1")
    return parts.join(best, ["image_id", "cls", "label"], "left_semi").select("image_id", F.col("cls").alias("label"), "y", "x")


def hole_background_roi(classes: DataFrame, min_area: int = 500, min_circularity: float = 0.1) -> DataFrame:
    """classes (image_id, y, x, label) -> (image_id, kind, y, x): hole is the roundest of the classes' largest objects that passes, background the rest of the frame."""
    parts = connected_components(classes.filter("label <> 0").select("image_id", F.col("label").alias("cls"), "y", "x"), 8)
    shapes = _shapes(parts).withColumn("n", F.row_number().over(Window.partitionBy("image_id", "cls").orderBy(F.col("area_px").desc(), "label"))).filter("n = 1")
    shapes = shapes.filter((F.col("area_px") >= min_area) & (F.col("perimeter_px") > 0) & (F.col("circularity") >= min_circularity))
    best = shapes.withColumn("n", F.row_number().over(Window.partitionBy("image_id").orderBy(F.col("circularity").desc(), "cls"))).filter("n = 1")
    hole = parts.join(best, ["image_id", "cls", "label"], "left_semi").select("image_id", "y", "x")
    rest = classes.join(best.select("image_id"), "image_id", "left_semi").select("image_id", "y", "x").join(hole, ["image_id", "y", "x"], "left_anti")
    return hole.select("image_id", F.lit("hole").alias("kind"), "y", "x").unionByName(rest.select("image_id", F.lit("background").alias("kind"), "y", "x"))


def class_masks(classes: DataFrame, n: int = 3) -> DataFrame:
    """(image_id, label, y, x) of classes 1..n; empty classes have no rows."""
    return classes.filter(F.col("label").between(1, n)).select("image_id", "label", "y", "x")


def dilate_mask(lab: DataFrame, um: float, images: DataFrame, frame: DataFrame) -> DataFrame:
    """lab (image_id, label, y, x), each label grown by um in steps to the four neighbours; labels may overlap afterwards, and no pixel of a label comes out twice."""
    px = F.bround(F.lit(float(um)) / F.col("pixel_size_um"), 0).cast("int")
    own = runs.encode(lab).join(images.select("image_id", px.alias("n")), "image_id")
    return runs.decode(runs.dilate(own, frame)).select(*lab.columns)


def mask_coverage(mask: DataFrame, frame: DataFrame) -> DataFrame:
    """(image_id, coverage): percent of the frame, 0 for images without a mask."""
    n = mask.select("image_id", "y", "x").distinct().groupBy("image_id").agg(F.count("*").alias("n"))
    return frame.join(n, "image_id", "left").select("image_id", (F.coalesce("n", F.lit(0)) / (F.col("height") * F.col("width")) * 100).alias("coverage"))
