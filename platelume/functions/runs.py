"""Masks as runs: (.., y, a, b) is a stretch of set pixels of a line, both ends included, as long as it can be.

A mask's other columns (image_id, and a label, class or mask key) say which mask a run belongs to. What runs need of their
neighbours is worked out in tiles or in bands of lines with a halo, so that a task holds one of these, whatever an image's size; what crosses
their borders is joined in Spark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import contract
from .ranges import grouped, ints, keys_at
from .scratch import apart, keep_pixels

#: Side of a tile that components are labelled in, and lines of a band.
TILE = 512
BAND = 256


def keys(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("y", "x", "a", "b", "first")]


def ddl(df: DataFrame, names: list[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{c}` {types[c]}" for c in names)


def encode(mask: DataFrame) -> DataFrame:
    """mask (.., y, x) -> runs. Pixels that are there twice count once; one exchange, of a line's pixels as an array."""
    xs = F.col("xs")
    line = mask.groupBy(*keys(mask), "y").agg(F.array_sort(F.collect_set(F.col("x").cast("int"))).alias("xs"))
    begins = F.filter(xs, lambda x, i: (i == 0) | (F.get(xs, i - 1) < x - 1))
    ends = F.filter(xs, lambda x, i: (i == F.size(xs) - 1) | (F.get(xs, i + 1) > x + 1))
    both = line.select(*keys(mask), F.col("y").cast("int").alias("y"), F.explode(F.arrays_zip(begins.alias("a"), ends.alias("b"))).alias("r"))
    return both.select(*keys(mask), "y", F.col("r.a").alias("a"), F.col("r.b").alias("b"))


def decode(runs: DataFrame) -> DataFrame:
    """runs -> (.., y, x); further columns stay."""
    return runs.select(*[c for c in runs.columns if c not in ("a", "b")], F.explode(F.sequence("a", "b")).alias("x"))


def gaps(runs: DataFrame, frame: DataFrame) -> DataFrame:
    """The runs of what is not set in each mask's frame (image_id, height, width), lines without a run included."""
    key = keys(runs)
    every = runs.select(*key).distinct().join(frame, "image_id")
    every = every.select(*key, "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    held = runs.groupBy(*key, "y").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("r"))
    r = F.coalesce("r", F.array().cast("array<struct<a:int,b:int>>"))
    line = every.join(held, [*key, "y"], "left").select(*key, "y", F.concat(F.array(F.lit(0)), F.transform(r, lambda s: s["b"] + 1)).alias("a"), F.concat(F.transform(r, lambda s: s["a"] - 1), F.array(F.col("width") - 1)).alias("b"))
    out = line.select(*key, "y", F.explode(F.arrays_zip("a", "b")).alias("g")).select(*key, "y", F.col("g.a").cast("int").alias("a"), F.col("g.b").cast("int").alias("b"))
    return out.filter("a <= b")


# ---- components -------------------------------------------------------------------------------


def label_runs(y: np.ndarray, a: np.ndarray, b: np.ndarray, connectivity: int) -> np.ndarray:
    """For each run the place of its component's first run. Runs must be in raster order."""
    reach = 1 if connectivity == 8 else 0
    wide = np.int64(1) << 32
    begin, end = y.astype(np.int64) * wide + a, y.astype(np.int64) * wide + b
    # on the next line, runs from the first that ends late enough to the last that begins soon enough touch
    low = np.searchsorted(end, begin + wide - reach)
    high = np.searchsorted(begin, end + wide + reach, side="right")
    count = np.maximum(high - low, 0)
    one = np.repeat(np.arange(len(y)), count)
    two = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    up = np.arange(len(y))
    while True:
        ra, rb = up[one], up[two]
        differ = ra != rb
        if not differ.any():
            return up
        np.minimum.at(up, np.maximum(ra, rb)[differ], np.minimum(ra, rb)[differ])
        while (up[up] != up).any():
            up = up[up]


def components(runs: DataFrame, connectivity: int = 8, tile: int = TILE) -> DataFrame:
    """runs -> (.., y, a, b, first): first is a struct (y, x) of the first pixel, in raster order, of a run's component.

    Runs are cut at the borders of tiles, and come back in these pieces.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    key = keys(runs)
    at = lambda c: F.floor(F.col(c) / tile).cast("int")
    pieces = runs.select(*key, "y", "a", "b", at("y").alias("ty"), F.explode(F.sequence(at("a"), at("b"))).alias("tx"))
    pieces = pieces.withColumns({"a": F.greatest("a", F.col("tx") * tile), "b": F.least("b", F.col("tx") * tile + tile - 1)})

    def label(batch: pa.RecordBatch, first: np.ndarray) -> dict[str, pa.Array | np.ndarray]:
        y, left, right, ty = ints(batch, "y", "a", "b", "ty")
        # each tile of each mask has lines of its own, apart from the others'
        root = label_runs((np.cumsum(first) - 1) * (tile + 2) + y - ty * tile, left, right, connectivity)
        return {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names} | {"fy": y[root].astype(np.int32), "fx": left[root].astype(np.int32)}

    local = grouped(pieces, [*key, "ty", "tx"], ["y", "a"], label, ddl(runs, key) + ", y int, a int, b int, ty int, tx int, fy int, fx int")
    local = keep_pixels(local, "tiles")
    if not local.filter("ty <> 0 OR tx <> 0").isEmpty():  # with one tile an image all is said
        reach = 1 if connectivity == 8 else 0
        other = local.select(*key, F.col("y").alias("y2"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("ty").alias("ty2"), F.col("tx").alias("tx2"), F.struct("fy", "fx").alias("g"))
        right = local.filter(F.col("b") % tile == tile - 1).select(*key, F.explode(F.array(*[F.col("y") + d for d in range(-reach, reach + 1)])).alias("y2"), (F.col("b") + 1).alias("a2"), F.struct("fy", "fx").alias("f"))
        beside = right.join(other.filter(F.col("a2") % tile == 0).select(*key, "y2", "a2", "g"), [*key, "y2", "a2"])
        below = local.filter(F.col("y") % tile == tile - 1).select(*key, (F.col("y") + 1).alias("y2"), F.col("tx").alias("tx2"), "a", "b", F.struct("fy", "fx").alias("f"))
        under = below.join(other.filter(F.col("y2") % tile == 0), [*key, "y2", "tx2"]).filter((F.col("a2") <= F.col("b") + reach) & (F.col("b2") >= F.col("a") - reach))
        node = lambda f: F.struct(*[F.col(k) for k in key], F.col(f).alias("f"))
        pairs = beside.select(*key, "f", "g").unionByName(under.select(*key, "f", "g"))
        found = contract.components(pairs.select(node("f").alias("a"), node("g").alias("b")))
        merged = found.select(*[F.col(f"node.{k}").alias(k) for k in key], F.col("node.f.fy").alias("fy"), F.col("node.f.fx").alias("fx"), F.col("root.f").alias("g"))
        local = local.join(merged, [*key, "fy", "fx"], "left").withColumns({"fy": F.coalesce("g.fy", "fy"), "fx": F.coalesce("g.fx", "fx")})
    return apart(local.select(*key, "y", "a", "b", F.struct(F.col("fy").alias("y"), F.col("fx").alias("x")).alias("first")))


# ---- bands of lines ---------------------------------------------------------------------------


def in_bands(runs: DataFrame, halo: str | int = 0, band: int = BAND) -> DataFrame:
    """runs with the bands whose lines, or the halo's lines around them, hold a run; halo is a number or a column."""
    h = F.lit(halo) if isinstance(halo, int) else F.col(halo)
    return runs.withColumn("band", F.explode(F.sequence(F.floor((F.col("y") - h) / band).cast("int"), F.floor((F.col("y") + h) / band).cast("int"))))


def united(y: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches that may overlap or touch as runs: a sweep along each line that counts the stretches begun and not ended."""
    wide = np.int64(1) << 32
    at = np.concatenate((y.astype(np.int64) * wide + a, y.astype(np.int64) * wide + b + 1))
    step = np.concatenate((np.ones(len(a), np.int64), -np.ones(len(b), np.int64)))
    at, back = np.unique(at, return_inverse=True)
    open_ = np.cumsum(np.bincount(back, step).astype(np.int64))
    before = np.concatenate(([0], open_[:-1]))
    begin, end = at[(open_ > 0) & (before == 0)], at[(open_ == 0) & (before > 0)]
    return begin // wide, begin % wide, end % wide - 1


def dilate(runs: DataFrame, frame: DataFrame, band: int = BAND) -> DataFrame:
    """runs (image_id, .., n, y, a, b) grown by n steps to the four neighbours within frame. Each run is sent to the bands within its reach."""
    key = [c for c in keys(runs) if c != "n"]
    near = in_bands(runs.join(frame, "image_id"), "n", band).filter(f"band >= 0 AND band * {band} < height")

    def grow(batch: pa.RecordBatch, first: np.ndarray) -> dict[str, pa.Array | np.ndarray]:
        y, a, b, n, height, width, top = ints(batch, "y", "a", "b", "n", "height", "width", "band")
        start, group = np.flatnonzero(first), np.cumsum(first) - 1
        line = group * band + y - top * band  # groups lie one below the other
        low, high = group * band, group * band + np.minimum(band, height - top * band) - 1
        parts = []
        for d in range(-int(n.max()), int(n.max()) + 1):
            ok = (n >= abs(d)) & (line + d >= low) & (line + d <= high)
            reach = n[ok] - abs(d)
            parts.append((line[ok] + d, np.maximum(a[ok] - reach, 0), np.minimum(b[ok] + reach, width[ok] - 1)))
        line, a, b = united(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        of = start[line // band]
        return keys_at(batch, key, of) | {"y": (line % band + top[of] * band).astype(np.int32), "a": a.astype(np.int32), "b": b.astype(np.int32)}

    return grouped(near, [*key, "band"], ["y", "a"], grow, ddl(runs, key) + ", y int, a int, b int")


def line_sums(lines: dict[int, int], first: int, last: int, worth: dict[int, float]) -> float:
    """The worth of the border pixels on lines first to last, by 1 + 2 * border neighbours at their sides + 10 * at their corners.

    lines: by y, the set pixels as bits of a number. Neighbours are counted for a whole line at once, in three numbers of one bit of the counts each.
    """
    get = lines.get

    def border(y: int) -> int:
        own = get(y, 0)
        return own & ~(own << 1 & own >> 1 & get(y - 1, 0) & get(y + 1, 0))

    def counts(p: int, q: int, r: int, s: int) -> list[int]:
        """Where 0, 1, 2, 3 and 4 of these are set."""
        pq, rs, both, pair = p ^ q, r ^ s, p & q, r & s
        one, carry = pq ^ rs, pq & rs
        two, four = both ^ pair ^ carry, both & pair
        return [~(one | two | four), one & ~two, two & ~one & ~four, one & two, four]

    total = 0.0
    edge = {y: border(y) for y in range(first - 1, last + 2)}
    for y in range(first, last + 1):
        own = edge[y]
        if own:
            up, down = edge[y - 1], edge[y + 1]
            sides = counts(own << 1, own >> 1, up, down)
            corners = counts(up << 1, up >> 1, down << 1, down >> 1)
            for i in range(5):
                for j in range(5):
                    if (w := worth.get(1 + 2 * i + 10 * j, 0.0)) and (found := own & sides[i] & corners[j]):
                        total += w * found.bit_count()
    return total


def perimeters(runs: DataFrame, worth: dict[int, float], band: int = BAND) -> DataFrame:
    """(.., perimeter): the summed worth of each mask's border pixels."""
    key = keys(runs)

    def measure(batch: pa.RecordBatch, first: np.ndarray) -> dict[str, pa.Array | np.ndarray]:
        y, a, b, top = ints(batch, "y", "a", "b", "band")
        start = np.flatnonzero(first)
        left = np.minimum.reduceat(a, start) - 2
        parts = []
        ys, begin, size = y.tolist(), (a - np.repeat(left, np.diff(np.append(start, len(a))))).tolist(), (b - a + 1).tolist()
        for i, j in zip(start.tolist(), [*start[1:].tolist(), len(y)], strict=True):
            lines: dict[int, int] = {}
            for k in range(i, j):
                lines[ys[k]] = lines.get(ys[k], 0) | ((1 << size[k]) - 1) << begin[k]
            low = int(top[i]) * band
            parts.append(line_sums(lines, max(low, ys[i]), min(low + band - 1, ys[j - 1]), worth))
        return keys_at(batch, key, start) | {"part": np.array(parts)}

    parts = grouped(in_bands(runs, 2, band), [*key, "band"], ["y", "a"], measure, ddl(runs, key) + ", part double")
    return parts.groupBy(*key).agg(F.sum("part").alias("perimeter"))


def hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Corners of the convex hull, around it (Andrew 1979)."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def chain(ps: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(points) + chain(points[::-1])


def hull_pixels(points: list[tuple[int, int]]) -> int:
    """Pixels whose centre lies in the hull of points, whose coordinates (y, x) are doubled; line by line, in whole numbers."""
    corners = hull(points)
    lo = -(-min(y for y, _ in corners) // 2)
    hi = max(y for y, _ in corners) // 2
    least, most = np.full(hi - lo + 1, np.iinfo(np.int64).max), np.full(hi - lo + 1, np.iinfo(np.int64).min)
    for (y1, x1), (y2, x2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 > y2:
            y1, x1, y2, x2 = y2, x2, y1, x1
        y = np.arange(-(-y1 // 2), y2 // 2 + 1, dtype=np.int64)
        if y1 == y2:
            left, right = np.full(len(y), -(-min(x1, x2) // 2)), np.full(len(y), max(x1, x2) // 2)
        else:
            top, down = x1 * (y2 - y1) + (2 * y - y1) * (x2 - x1), 2 * (y2 - y1)
            left, right = -(-top // down), top // down
        least[y - lo] = np.minimum(least[y - lo], left)
        most[y - lo] = np.maximum(most[y - lo], right)
    return int(np.maximum(most - least + 1, 0).sum())


def hull_areas(runs: DataFrame, band: int = BAND) -> DataFrame:
    """(.., area, hull): each mask's pixels, and those in the convex hull of its pixels' edge midpoints. Bands give the corners of their parts' hulls."""
    key = keys(runs)

    def corners(batch: pa.RecordBatch, first: np.ndarray) -> dict[str, pa.Array | np.ndarray]:
        y, a, b = ints(batch, "y", "a", "b")
        start = np.flatnonzero(first)
        line = np.flatnonzero(first | np.concatenate(([True], y[1:] != y[:-1])))
        rows = list(zip(y[line].tolist(), np.minimum.reduceat(a, line).tolist(), np.maximum.reduceat(b, line).tolist(), strict=True))
        cut = np.searchsorted(line, np.append(start, len(y))).tolist()
        found = [hull([(2 * v + d, 2 * e + f) for v, p, q in rows[i:j] for e in (p, q) for d, f in ((1, 0), (-1, 0), (0, 1), (0, -1))]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        longs = pa.list_(pa.int64())
        return keys_at(batch, key, start) | {"area": np.add.reduceat(b - a + 1, start), "ys": pa.array([[p[0] for p in f] for f in found], longs), "xs": pa.array([[p[1] for p in f] for f in found], longs)}

    parts = grouped(in_bands(runs, 0, band), [*key, "band"], ["y", "a"], corners, ddl(runs, key) + ", area long, ys array<long>, xs array<long>")
    whole = parts.groupBy(*key).agg(F.sum("area").alias("area"), F.flatten(F.collect_list("ys")).alias("ys"), F.flatten(F.collect_list("xs")).alias("xs"))

    @F.pandas_udf("long")
    def count(ys: pd.Series, xs: pd.Series) -> pd.Series:
        return pd.Series([hull_pixels(list(zip(y.tolist(), x.tolist(), strict=True))) for y, x in zip(ys, xs, strict=True)])

    return whole.select(*key, "area", count("ys", "xs").alias("hull"))
