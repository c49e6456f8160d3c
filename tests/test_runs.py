"""Runs, peaks and floods in tiles and bands against plain code, pixel by pixel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from platelume.functions import forest, runs
from platelume.operators import measure, segment


def table(spark, masks, more=""):
    """masks: by (image_id, label) sets of (y, x)."""
    rows = [(i, c, y, x) for (i, c), own in masks.items() for y, x in sorted(own)]
    return spark.createDataFrame(rows, "image_id long, label int, y int, x int")


def noise(seed, height=23, width=31, share=0.55):
    on = np.random.default_rng(seed).random((height, width)) < share
    return {(int(y), int(x)) for y, x in zip(*np.nonzero(on), strict=True)}


MASKS = {(0, 1): noise(1), (0, 2): noise(2, share=0.3), (1, 1): noise(3, share=0.8), (1, 2): {(5, 5)}, (2, None): {(y, x) for y in range(20) for x in range(20)} - {(9, 9), (0, 3)}}
SIZE = (23, 31)


def by_mask(rows, *values):
    out = {}
    for r in rows:
        out.setdefault((r.image_id, r.label), set()).add(tuple(r[v] for v in values))
    return out


def frames(spark, *ids):
    return spark.createDataFrame([(i, *SIZE) for i in ids], "image_id long, height int, width int")


def test_runs_and_gaps(spark):
    twice = table(spark, MASKS).unionByName(table(spark, MASKS).limit(9))
    coded = runs.encode(twice)
    rows = coded.collect()
    assert by_mask(runs.decode(coded).collect(), "y", "x") == MASKS and runs.decode(coded).count() == sum(map(len, MASKS.values()))
    assert not {(r.image_id, r.label, r.y, r.b + 1) for r in rows} & {(r.image_id, r.label, r.y, r.a) for r in rows}
    some = {k: v for k, v in MASKS.items() if k[1]}
    rest = by_mask(runs.decode(runs.gaps(runs.encode(table(spark, some)), frames(spark, 0, 1))).collect(), "y", "x")
    every = {(y, x) for y in range(SIZE[0]) for x in range(SIZE[1])}
    assert rest == {k: every - v for k, v in some.items()}
    assert runs.encode(twice.limit(0)).count() == 0


def _plain_components(own, connectivity):
    first, steps = {}, [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (connectivity == 8 or not a * b)]
    for p in sorted(own):
        if p not in first:
            stack = [p]
            first[p] = p
            while stack:
                y, x = stack.pop()
                for dy, dx in steps:
                    q = (y + dy, x + dx)
                    if q in own and q not in first:
                        first[q] = p
                        stack.append(q)
    return {(*p, *f) for p, f in first.items()}


@pytest.mark.parametrize("tile", [5, 512])
@pytest.mark.parametrize("connectivity", [4, 8])
def test_components(spark, tile, connectivity):
    found = runs.decode(runs.components(runs.encode(table(spark, MASKS)), connectivity, tile)).select("image_id", "label", "y", "x", F.col("first.y").alias("fy"), F.col("first.x").alias("fx"))
    want = {k: _plain_components(v, connectivity) for k, v in MASKS.items()}
    if tile < 512:  # over tiles null keys can't be joined: masks that are told apart are told apart by values
        found, want = found.filter("label IS NOT NULL"), {k: v for k, v in want.items() if k[1]}
    assert by_mask(found.collect(), "y", "x", "fy", "fx") == want


@pytest.mark.parametrize("band", [3, 256])
def test_dilation(spark, band):
    n = {0: 3, 1: 0, 2: 1}
    own = runs.encode(table(spark, {k: v if k != (0, 1) else set(sorted(v)[:9]) for k, v in MASKS.items()}))
    steps = spark.createDataFrame(list(n.items()), "image_id long, n int")
    got = runs.dilate(own.join(steps, "image_id"), frames(spark, 0, 1, 2), band)
    want = {}
    for k, v in MASKS.items():
        r = n[k[0]]
        v = v if k != (0, 1) else set(sorted(v)[:9])
        want[k] = {(y + a, x + b) for y, x in v for a in range(-r, r + 1) for b in range(-r + abs(a), r - abs(a) + 1) if 0 <= y + a < SIZE[0] and 0 <= x + b < SIZE[1]}
    pixels = runs.decode(got)
    assert by_mask(pixels.collect(), "y", "x") == want and pixels.count() == sum(map(len, want.values()))


@pytest.mark.parametrize("band", [2, 256])
def test_perimeter_and_hull(spark, band):
    coded = runs.encode(table(spark, MASKS))
    got = {(r.image_id, r.label): r.perimeter for r in runs.perimeters(coded, measure.PERIMETER, band).collect()}
    areas = {(r.image_id, r.label): (r.area, r.hull) for r in runs.hull_areas(coded, band).collect()}
    for k, own in MASKS.items():
        sides, corners = [(-1, 0), (1, 0), (0, -1), (0, 1)], [(-1, -1), (-1, 1), (1, -1), (1, 1)]
        border = {(y, x) for y, x in own if any((y + a, x + b) not in own for a, b in sides)}
        count = lambda p, steps: sum((p[0] + a, p[1] + b) in border for a, b in steps)  # noqa: B023, E731
        assert got[k] == pytest.approx(sum(measure.PERIMETER.get(1 + 2 * count(p, sides) + 10 * count(p, corners), 0.0) for p in border))
        points = runs.hull([(2 * y + a, 2 * x + b) for y, x in own for a, b in sides])
        inside = sum(all((q[0] - p[0]) * (2 * x - p[1]) - (q[1] - p[1]) * (2 * y - p[0]) >= 0 for p, q in zip(points, points[1:] + points[:1], strict=True)) for y in range(SIZE[0]) for x in range(SIZE[1]))
        assert areas[k] == (len(own), inside)


def _plain_peaks(d2, spacing):
    ok = [p for p, v in d2.items() if v > 0 and all(d2.get((p[0] + a, p[1] + b), 0) <= v for a in range(-spacing, spacing + 1) for b in range(-spacing, spacing + 1))]
    ok = [p for p in ok if spacing <= p[0] < SIZE[0] - spacing and spacing <= p[1] < SIZE[1] - spacing]
    taken = []
    for p in sorted(ok, key=lambda p: (-d2[p], p)):
        if all(max(abs(p[0] - q[0]), abs(p[1] - q[1])) >= spacing for q in taken):
            taken.append(p)
    return set(taken)


@pytest.mark.parametrize(("tile", "spacing"), [(4, 1), (6, 3), (256, 3)])
def test_peaks(spark, tile, spacing):
    """Plateaus over many tiles, where a place waits for others round after round."""
    rng = np.random.default_rng(spacing)
    heights = {0: {p: int(rng.integers(1, 4)) for p in noise(4, share=0.9)}, 1: dict.fromkeys([(y, x) for y in range(SIZE[0]) for x in range(SIZE[1])], 2), 2: {p: int(rng.integers(0, 40)) for p in noise(5)}}
    df = spark.createDataFrame([(i, y, x, v) for i, h in heights.items() for (y, x), v in h.items()], "image_id long, y int, x int, d2 long")
    got = {}
    for r in forest.peaks(df, frames(spark, 0, 1, 2), spacing, tile).collect():
        got.setdefault(r.image_id, set()).add((r.y, r.x))
        assert heights[r.image_id][r.y, r.x] == r.d2
    assert got == {i: _plain_peaks(h, spacing) for i, h in heights.items()}


def _plain_forest(d2, marks):
    edges = []
    for y, x in d2:
        for down, q in ((0, (y, x + 1)), (1, (y + 1, x))):
            if q in d2:
                edges.append((-min(d2[y, x], d2[q]), -max(d2[y, x], d2[q]), y, x, down, q))
    part = {p: {p} for p in d2}
    mark = {p: marks.get(p) for p in d2}
    for *_, y, x, _, q in sorted(edges):
        one, two = part[y, x], part[q]
        if one is not two and (mark[y, x] is None or mark[q] is None):
            both, m = one | two, mark[y, x] if mark[y, x] is not None else mark[q]
            for p in both:
                part[p], mark[p] = both, m
    return {(*p, m) for p, m in mark.items() if m is not None}


@pytest.mark.parametrize("tile", [5, 256])
def test_flood(spark, tile):
    """Ties everywhere, marks far apart so that parts wait over several tiles, and a mask that no mark reaches."""
    rng = np.random.default_rng(7)
    heights = {0: {p: int(rng.integers(0, 3)) for p in noise(6, share=0.75)}, 1: dict.fromkeys(noise(7, share=0.97), 5), 2: {p: int(rng.integers(0, 500)) for p in noise(8, share=0.8)}, 3: dict.fromkeys(noise(9), 1)}
    marks = {i: {p: k for k, p in enumerate(sorted(h)[:: (60, 300, 45, 10**6)[i]]) if i < 3} for i, h in heights.items()}
    df = spark.createDataFrame([(i, y, x, v, marks[i].get((y, x))) for i, h in heights.items() for (y, x), v in h.items()], "image_id long, y int, x int, d2 long, mark long")
    got = {i: set() for i in heights}
    for r in forest.flood(df, tile).collect():
        got[r.image_id].add((r.y, r.x, r.mark))
    assert got == {i: _plain_forest(h, marks[i]) for i, h in heights.items()}


def test_watershed_of_an_object_over_many_tiles(spark):
    """Two thousand pixels in one object with several peaks: tiles of 16 and 512 pixels a side give the same labels."""
    own = [(y, x) for y in range(4, 60) for x in range(4, 90) if min((y - cy) ** 2 + (x - cx) ** 2 for cy, cx in ((20, 20), (38, 42), (22, 66), (40, 78))) <= 225]
    assert len(own) > 2000
    mask = spark.createDataFrame([(1, y, x) for y, x in own], "image_id long, y int, x int")
    frame = spark.createDataFrame([(1, 64, 96)], "image_id long, height int, width int")
    small, large = ({tuple(r) for r in segment.watershed_split(mask, frame, 5, tile).collect()} for tile in (16, 512))
    assert small == large and len(small) == len(own) and len({r[-1] for r in small}) >= 4
