"""What image operators share: line arrays for separable neighbourhoods, tiles with a halo for others, frames."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import grouped, ints, keys_at, spans

#: Side of a tile: the unit of work of operators that need a neighbourhood in two dimensions.
TILE = 256
#: Pixels of lines of one length that are convolved together.
TOGETHER = 1 << 18


def plane_keys(df: DataFrame, *, with_z: bool = True) -> list[str]:
    return [c for c in ("image_id", "channel", *(("z",) if with_z else ())) if c in df.columns]


def frame_of(px: DataFrame) -> DataFrame:
    """(image_id, height, width)"""
    return px.groupBy("image_id").agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"))


def lines(df: DataFrame, along: str, value: str = "value") -> tuple[DataFrame, list[str]]:
    """Dense rows -> one row a line with vals, in order of along; and the line's key."""
    other = "y" if along == "x" else "x"
    key = [*plane_keys(df), other]
    return df.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(along, value))), lambda s: s[value]).alias("vals")), key


def unline(df: DataFrame, key: list[str], along: str, value: str = "value") -> DataFrame:
    return df.select(*key, F.posexplode("vals").alias(along, value))


def convolve(line: DataFrame, weights: list[float]) -> DataFrame:
    """line (key, vals) with vals' weighted window sums; beyond its ends a line is mirrored, the end value repeated (d c b a | a b c d | d c b a)."""
    r = len(weights) // 2

    @F.pandas_udf("array<double>")
    def sums(vals: pd.Series) -> pd.Series:
        size, out = vals.map(len).to_numpy(), np.empty(len(vals), object)
        for n in np.unique(size).tolist():
            own, most = np.flatnonzero(size == n), max(1, TOGETHER // max(1, n))
            for at in (own[i : i + most] for i in range(0, len(own), most)):
                wide = np.pad(np.array([vals.iat[i] for i in at], float), ((0, 0), (r, r)), mode="symmetric")
                done = wide[:, :n] * weights[0]
                for k in range(1, len(weights)):
                    done = done + wide[:, k : k + n] * weights[k]
                for i, line in zip(at.tolist(), done, strict=True):
                    out[i] = line
        return pd.Series(out, vals.index)

    return line.withColumn("vals", sums("vals"))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return (w / w.sum()).tolist()


def tile_places(c: str, halo: int, tile: int) -> Column:
    """The tiles along c, from 0, that hold the pixel or whose halo does."""
    return F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - halo) / tile).cast("int")), F.floor((F.col(c) + halo) / tile).cast("int"))


def tiled(df: DataFrame, halo: int, work: Callable[[np.ndarray], np.ndarray], tile: int = TILE) -> DataFrame:
    """work(block) on each tile of each plane, where the block has halo pixels of its neighbours around it and NaN outside the frame.

    A pixel goes to its own tile and to those whose halo holds it, so that a task holds one tile and its halo.
    """
    key = plane_keys(df)

    spread = df.select(*key, "y", "x", "value", F.explode(tile_places("y", halo, tile)).alias("ty")).withColumn("tx", F.explode(tile_places("x", halo, tile)))

    def run(batch: pa.RecordBatch, first: np.ndarray) -> dict[str, pa.Array | np.ndarray]:
        ys, xs, ty, tx = ints(batch, "y", "x", "ty", "tx")
        value = batch.column(batch.schema.get_field_index("value")).to_numpy(zero_copy_only=False)
        own = (ys // tile == ty) & (xs // tile == tx)
        out = np.full(len(ys), np.nan)
        for i, j in spans(first):
            if own[i:j].any():
                y, x = ys[i:j] - ys[i:j].min(), xs[i:j] - xs[i:j].min()
                block = np.full((y.max() + 1, x.max() + 1), np.nan)
                block[y, x] = value[i:j]
                out[i:j] = work(block)[y, x]
        at = np.flatnonzero(own)
        made = {c: v.cast(pa.int64() if c == "image_id" else pa.int32()) for c, v in keys_at(batch, [*key, "y", "x"], at).items()}
        return made | {"value": pa.array(out[at], from_pandas=True)}

    schema = ", ".join(f"{k} {'long' if k == 'image_id' else 'int'}" for k in [*key, "y", "x"]) + ", value double"
    return grouped(spread, [*key, "ty", "tx"], [], run, schema)


def shifted_extreme(block: np.ndarray, offsets: list[tuple[int, int, float]], largest: bool = False) -> np.ndarray:
    """At each place the least (or largest) of block[place + offset] + plus over the offsets inside the frame; NaN is outside."""
    h, w = block.shape
    far = -np.inf if largest else np.inf
    inside = np.where(np.isnan(block), far, block)
    out = np.full((h, w), far)
    pick = np.maximum if largest else np.minimum
    for dy, dx, plus in offsets:
        a, b, c, d = max(0, -dy), min(h, h - dy), max(0, -dx), min(w, w - dx)
        if a < b and c < d:
            view = out[a:b, c:d]
            pick(view, inside[a + dy : b + dy, c + dx : d + dx] + plus, out=view)
    out[np.isnan(block)] = np.nan
    return out


#: Offsets of a ball are looked at in squares of this side, but for those this near.
SQUARE, NEAR = 8, 6


def ball_least(block: np.ndarray, radius: float) -> np.ndarray:
    """At each place the least of value + height of a ball's lower side above its lowest point, inside the frame; NaN is outside.

    Near offsets come first, then squares of offsets from the flattest on: where a square's least value, found for all places at once, cannot
    lie below what is known even at the ball's least height in it, none of its offsets is tried.
    """
    h, w = block.shape
    r = int(radius)
    offsets = [(dy, dx, radius - math.sqrt(radius * radius - dy * dy - dx * dx)) for dy, dx in disk(radius)]
    near = [o for o in offsets if o[0] ** 2 + o[1] ** 2 <= NEAR * NEAR]
    outside = np.isnan(block)
    out = shifted_extreme(block, near)
    out[outside] = -np.inf
    wide = np.full((h + 2 * (r + SQUARE), w + 2 * (r + SQUARE)), np.inf)
    wide[r : r + h, r : r + w] = np.where(outside, np.inf, block)
    low, n = wide, 1
    while n < SQUARE:
        low = np.minimum(low[:-n], low[n:])
        low = np.minimum(low[:, :-n], low[:, n:])
        n *= 2
    squares: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    for dy, dx, height in offsets:
        if dy * dy + dx * dx > NEAR * NEAR:
            squares.setdefault(((dy + r) // SQUARE * SQUARE, (dx + r) // SQUARE * SQUARE), []).append((dy, dx, height))
    flat, source = out.ravel(), wide.ravel()
    place = (np.arange(h)[:, None] * wide.shape[1] + np.arange(w)).ravel()
    for (top, left), own in sorted(squares.items(), key=lambda s: min(o[2] for o in s[1])):
        at = np.flatnonzero((low[top : top + h, left : left + w] + min(o[2] for o in own) < out).ravel())
        if len(at):
            best, here = flat[at], place[at]
            for dy, dx, height in own:
                np.minimum(best, source[here + (dy + r) * wide.shape[1] + dx + r] + height, out=best)
            flat[at] = best
    out[outside] = np.nan
    return out


def disk_extreme(block: np.ndarray, radius: int, largest: bool = False) -> np.ndarray:
    """At each place the least (or largest) value of a flat disk inside the frame; NaN is outside.

    A disk is a chord on each line: extremes of windows of 1, 2, 4, .. places are made once, two of them overlap to a chord of any
    length, and lines are then shifted on each other, so that the work grows with the radius and not with the disk's area.
    """
    h, w = block.shape
    far = -np.inf if largest else np.inf
    pick = np.maximum if largest else np.minimum
    wide = np.full((h, w + 2 * radius), far)
    wide[:, radius : radius + w] = np.where(np.isnan(block), far, block)
    windows, n = [wide], 1
    while 2 * n <= 2 * radius + 1:
        windows.append(pick(windows[-1][:, :-n], windows[-1][:, n:]))
        n *= 2
    chords: dict[int, np.ndarray] = {}
    out = np.full((h, w), far)
    for dy in range(-radius, radius + 1):
        half = math.isqrt(radius * radius - dy * dy)
        if half not in chords:
            size, k = 2 * half + 1, (2 * half + 1).bit_length() - 1
            left = radius - half
            chords[half] = pick(windows[k][:, left : left + w], windows[k][:, left + size - (1 << k) : left + size - (1 << k) + w])
        a, b = max(0, -dy), min(h, h - dy)
        if a < b:
            pick(out[a:b], chords[half][a + dy : b + dy], out=out[a:b])
    out[np.isnan(block)] = np.nan
    return out


def disk(radius: float) -> list[tuple[int, int]]:
    r = int(radius)
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= radius * radius]
