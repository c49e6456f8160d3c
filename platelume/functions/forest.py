"""Peaks and floods over masks, in tiles: greedy spacing and minimum spanning forests without a queue over a whole image.

Both decide in a tile all that its own pixels (and a halo) decide, and leave the rest to rounds over what crosses tile borders.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import contract
from .neighbours import tile_places
from .ranges import grouped, ints, keys_at, spans
from .runs import ddl
from .scratch import drop, keep_pixels

TILE = 256


def _keys(df: DataFrame, other: tuple[str, ...]) -> list[str]:
    return [c for c in df.columns if c not in ("y", "x", *other)]


def _tiles(df: DataFrame, halo: int, tile: int) -> DataFrame:
    """Each pixel in its own tile and in those whose halo holds it."""
    return df.withColumn("ty", F.explode(tile_places("y", halo, tile))).withColumn("tx", F.explode(tile_places("x", halo, tile)))


# ---- peaks ------------------------------------------------------------------------------------


def _highest(y: np.ndarray, x: np.ndarray, d2: np.ndarray, own: np.ndarray, reach: int) -> np.ndarray:
    """Places of the own pixels that no pixel within reach (a square) is higher than."""
    top, left = y.min() - reach, x.min() - reach
    box = np.zeros((y.max() - top + reach + 1, x.max() - left + reach + 1), d2.dtype)
    box[y - top, x - left] = d2
    at = np.flatnonzero(own & (d2 > 0))
    steps = sorted(((dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1) if dy or dx), key=lambda s: max(map(abs, s)))
    for dy, dx in steps:  # near pixels first: few places are left after them
        at = at[box[y[at] - top + dy, x[at] - left + dx] <= d2[at]]
    return at


def peaks(heights: DataFrame, frame: DataFrame, spacing: int, tile: int = TILE) -> DataFrame:
    """heights (.., y, x, d2) -> its peaks: d2 above 0, nothing higher in the square of spacing around them, that far from the frame's edge, and, from the
    highest down (raster order among equals), at least spacing from those taken before.

    A place is taken once all before it that are too near are refused, refused once one of them is taken; a tile decides in
    order what its halo allows, and rounds go on while a place waits for another tile.
    """
    key = _keys(heights, ("d2",))
    group = [*key, "ty", "tx"]
    types, cell = ddl(heights, key), max(spacing, 1)

    def find(batch: pa.RecordBatch, first: np.ndarray) -> dict[str, pa.Array | np.ndarray]:
        y, x, d2, ty, tx = ints(batch, "y", "x", "d2", "ty", "tx")
        own = (y // tile == ty) & (x // tile == tx)
        at = np.concatenate([i + _highest(y[i:j], x[i:j], d2[i:j], own[i:j], spacing) for i, j in spans(first)])
        return keys_at(batch, key, at) | {"y": y[at].astype(np.int32), "x": x[at].astype(np.int32), "d2": d2[at]}

    found = grouped(_tiles(heights.filter("d2 > 0"), spacing, tile), group, [], find, f"{types}, y int, x int, d2 long").join(frame, "image_id")
    clear = (F.col("y") >= spacing) & (F.col("x") >= spacing) & (F.col("y") < F.col("height") - spacing) & (F.col("x") < F.col("width") - spacing)
    state = found.filter(clear).select(*key, "y", "x", "d2", F.lit(0).alias("state"))  # 0 waits, 1 is taken, 2 is refused

    def decide(batch: pa.RecordBatch, first: np.ndarray) -> dict[str, pa.Array | np.ndarray]:
        ys, xs, d2, state, ty, tx = ints(batch, "y", "x", "d2", "state", "ty", "tx")
        own = (ys // tile == ty) & (xs // tile == tx)
        of = np.cumsum(first)
        order = np.lexsort((xs, ys, -d2, of))
        y, x, g, status = ys.tolist(), xs.tolist(), of.tolist(), state.tolist()
        cells: dict[tuple[int, int, int], list[int]] = {}
        for i in order.tolist():
            if status[i] != 2:
                a, b = y[i] // cell, x[i] // cell
                near = [j for dy in (-1, 0, 1) for dx in (-1, 0, 1) for j in cells.get((g[i], a + dy, b + dx), ()) if max(abs(y[i] - y[j]), abs(x[i] - x[j])) < spacing]
                if status[i] == 0 and own[i]:
                    status[i] = 2 if any(status[j] == 1 for j in near) else 0 if near else 1
                if status[i] != 2:
                    cells.setdefault((g[i], a, b), []).append(i)
        at = np.flatnonzero(own)
        return keys_at(batch, key, at) | {"y": ys[at].astype(np.int32), "x": xs[at].astype(np.int32), "d2": d2[at], "state": np.array(status, np.int32)[at]}

    schema = f"{types}, y int, x int, d2 long, state int"
    while True:
        before, state = state, keep_pixels(grouped(_tiles(state, spacing, tile), group, [], decide, schema), "peaks")
        drop(before)
        if state.filter("state = 0").isEmpty():
            return state.filter("state = 1").select(*key, "y", "x", "d2")


# ---- floods -----------------------------------------------------------------------------------

#: An edge's place in the order: higher lower ends first, then higher upper ends, then the upper left end's place, then right before down.
_ORDER = ("lo", "hi", "py", "px", "down")


def _merge(n: int, u: np.ndarray, v: np.ndarray, free: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boruvka's rounds over n nodes and edges (u, v) in order, best first: every part without a mark goes where its best edge leads. Nodes that
    are not free (another tile's) end a part's progress. Returns each node's part (its least node) and the parts' marks (-1: none)."""
    part, mark = np.arange(n), mark.copy()
    rank = np.arange(len(u))
    while True:
        a, b = part[u], part[v]
        on = (a != b) & ((mark[a] < 0) | (mark[b] < 0))
        u, v, rank, a, b = u[on], v[on], rank[on], a[on], b[on]
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, a, rank)
        np.minimum.at(best, b, rank)
        own = np.concatenate((best[a] == rank, best[b] == rank)) & (mark[np.concatenate((a, b))] < 0) & free[np.concatenate((a, b))]
        one, two = np.concatenate((a, b))[own], np.concatenate((b, a))[own]
        one, two = one[free[two]], two[free[two]]
        if not len(one):
            return part, mark
        to = np.arange(n)
        to[one] = two
        both = to[to] == np.arange(n)
        to = np.where(both & (np.arange(n) < to), np.arange(n), to)  # of two that chose each other the lesser is the root
        while (to[to] != to).any():
            to = to[to]
        # a tree's least node stands for it, and it has the mark of its root at most
        least = np.arange(n)
        np.minimum.at(least, to, np.arange(n))
        marks = np.full(n, -1, mark.dtype)
        np.maximum.at(marks, least[to], mark)
        part, mark = least[to[part]], marks


def flood(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """pixels (.., y, x, d2, mark) -> (.., y, x, mark): each pixel has the mark (a long, not negative) of its tree in the minimum spanning forest
    whose trees hold one mark each; pixels that no mark can reach are left out.

    Edges join neighbours by side; the one whose lower end is higher comes first, then whose upper end is, then by place. Each tile
    contracts what its own edges decide; parts that wait for another tile go on as nodes of a small graph, in rounds.
    """
    key = _keys(pixels, ("d2", "mark"))
    types = ddl(pixels, key)
    schema = f"{types}, kind int, y int, x int, cy int, cx int, mark long, lo long, hi long, py int, px int, down int"

    def run(batch: pa.RecordBatch, first: np.ndarray) -> dict[str, pa.Array | np.ndarray]:
        y, x, d2, mark, ty, tx = ints(batch, "y", "x", "d2", "mark", "ty", "tx")
        own = (y // tile == ty) & (x // tile == tx)
        # tiles lie one below the other, a line and a column apart, and so share no edge
        wide = tile + 3
        place = (np.cumsum(first) * wide + y - ty * tile + 1) * wide + x - tx * tile + 1
        right, below = (np.searchsorted(place, place + step, side="right") - 1 for step in (1, wide))
        on, under = place[right] == place + 1, place[below] == place + wide
        u = np.concatenate((np.flatnonzero(on), np.flatnonzero(under)))
        v = np.concatenate((right[on], below[under]))
        down = np.repeat([0, 1], [int(on.sum()), int(under.sum())])
        some = own[u] | own[v]
        u, v, down = u[some], v[some], down[some]
        lo, hi = np.minimum(d2[u], d2[v]), np.maximum(d2[u], d2[v])
        order = np.lexsort((down, x[u], y[u], -hi, -lo))
        u, v, down, lo, hi = u[order], v[order], down[order], lo[order], hi[order]
        part, marks = _merge(len(y), u, v, own, np.where(own, mark, -1))
        got = marks[part]
        # what a part without a mark may still choose: its best edge to each other part or foreign pixel
        a, b = part[u], part[v]
        out = []
        for one, two in ((a, b), (b, a)):
            at = np.flatnonzero((one != two) & own[one] & (got[one] < 0))
            at = at[np.unique(one[at] * np.int64(len(y)) + two[at], return_index=True)[1]]  # edges are in order: the first is the best
            out.append((one[at], two[at], at))
        one, two, at = map(np.concatenate, zip(*out, strict=True))
        mine, none = np.flatnonzero(own), np.zeros(int(own.sum()), np.int64)
        node = np.concatenate((part[mine], one))
        made = {"kind": np.repeat([0, 1], [len(mine), len(one)]), "y": y[np.concatenate((mine, two))], "x": x[np.concatenate((mine, two))], "cy": y[node], "cx": x[node]}
        made |= {"py": np.concatenate((none, y[u[at]])), "px": np.concatenate((none, x[u[at]])), "down": np.concatenate((none, down[at]))}
        longs = {"mark": np.concatenate((got[mine], np.full(len(one), -1))), "lo": np.concatenate((none, -lo[at])), "hi": np.concatenate((none, -hi[at]))}
        return keys_at(batch, key, node) | {c: v.astype(np.int32) for c, v in made.items()} | longs

    pixels = pixels.withColumn("mark", F.coalesce("mark", F.lit(-1)).cast("long"))
    local = keep_pixels(grouped(_tiles(pixels, 1, tile), [*key, "ty", "tx"], ["y", "x"], run, schema), "parts")
    own = local.filter("kind = 0").withColumn("mark", F.when(F.col("mark") >= 0, F.col("mark")))
    if local.filter("kind = 1").isEmpty():
        return own.filter("mark IS NOT NULL").select(*key, "y", "x", "mark")
    node: Column = F.struct(*key, "cy", "cx")
    border = (F.col("y") % tile).isin(0, tile - 1) | (F.col("x") % tile).isin(0, tile - 1)
    other = own.filter(border | ((F.col("y") == F.col("cy")) & (F.col("x") == F.col("cx")))).select(*key, "y", "x", node.alias("b"), F.col("mark").alias("bmark"))
    edges = local.filter("kind = 1").select(*key, "y", "x", node.alias("a"), F.struct(*_ORDER).alias("e")).join(other, [*key, "y", "x"]).select("a", "b", "bmark", "e")
    edges = keep_pixels(edges, "edges")
    at = keep_pixels(edges.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root"), F.lit(None).cast("long").alias("mark")), "waiting")
    while not edges.isEmpty():
        picks = keep_pixels(edges.groupBy("a").agg(F.min(F.struct("e", "b", "bmark")).alias("s")).select("a", F.col("s.b").alias("b"), F.col("s.bmark").alias("bmark")), "picks")
        groups = contract.components(picks.filter("bmark IS NULL").select("a", "b"))
        known = picks.select("a", "bmark").join(groups.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
        marks = known.groupBy("root").agg(F.max("bmark").alias("mark"))
        now = keep_pixels(known.select("a", "root").join(marks, "root"), "now")  # (root, a, mark)
        here = now.select(F.col("a").alias("root"), F.col("root").alias("to"), F.col("mark").alias("more"))
        after = keep_pixels(at.join(here, "root", "left").select("node", F.coalesce("to", "root").alias("root"), F.coalesce("mark", "more").alias("mark")), "waiting")
        left = edges.join(now.filter("mark IS NULL").select("a", F.col("root").alias("ra")), "a")
        left = left.join(now.select(F.col("a").alias("b"), F.col("root").alias("rb"), F.col("mark").alias("mb")), "b", "left")
        left = left.select(F.col("ra").alias("a"), F.coalesce("rb", "b").alias("b"), F.coalesce("bmark", "mb").alias("bmark"), "e").filter("a <> b")
        left = keep_pixels(left, "edges")
        drop(edges, at, picks, now)
        edges, at = left, after
    waited = at.filter("mark IS NOT NULL").select(*[F.col(f"node.{c}").alias(c) for c in (*key, "cy", "cx")], F.col("mark").alias("found"))
    return own.join(waited, [*key, "cy", "cx"], "left").withColumn("mark", F.coalesce("mark", "found")).filter("mark IS NOT NULL").select(*key, "y", "x", "mark")
