"""Shared parts against plain code: hub keys, contraction, scratch tables, percentiles, envelopes, peaks, polygons, bitmaps, streams."""

import dataclasses
import math
import os
import re
import struct
import tempfile
import threading

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from platelume.functions import contract, graph, neighbours, ranges, runs, scratch
from platelume.operators import intensity, measure, segment
from platelume.plans import jobs, queries
from platelume.sources import bitmaps, fixtures, results
from platelume.streaming import watch


def test_joins_of_hub_keys(spark):
    """A key with a third of the rows, null keys and keys without a right row: as a plain left join, nothing lost."""
    left = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.range(0, 4000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("b")).unionByName(spark.sql("SELECT 7L k, 1L b"))
    hot = contract.hot_keys(left, "k")
    assert [r.k for r in hot.collect()] == [7]
    same = lambda df: sorted(map(tuple, df.select("k", "a", "b").collect()), key=str)
    assert same(contract.join_by(left, right, "k", hot)) == same(left.join(right, "k", "left"))
    assert contract.hot_keys(left.limit(10), "k") is None and contract.hot_keys(spark.range(5000).withColumnRenamed("id", "k"), "k") is None


def test_contraction_of_a_hub_and_a_path(spark):
    edges = [(0, i) for i in range(1, 2500)] + [(5000 + i, 5001 + i) for i in range(40)] + [(9000, 9000), (8, 9)]
    got = {r.node: r.root for r in contract.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 2500)} | {i: 5000 for i in range(5001, 5041)}
    assert contract.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_scratch_is_given_back(spark):
    a = scratch.keep(spark.range(5), "a")
    path = scratch._OF[a].removeprefix("file:")
    assert os.path.isdir(path) and spark.sparkContext.applicationId in path
    made = scratch.written(lambda: scratch.keep(spark.range(3), "inner").withColumnRenamed("id", "x"), "outer")
    assert made.count() == 3 and not [p for p in scratch._PATHS if "/inner-" in p]
    scratch.drop(a, None, spark.range(2))
    assert not os.path.exists(path) and made.count() == 3


def test_scratch_of_threads(spark):
    """What one thread keeps stays while another gives its own tables back; nested calls hand their result to the outer one."""
    held, go, done = [], threading.Event(), threading.Event()

    def other():
        held.append(scratch.keep(spark.range(4), "theirs"))
        go.set()
        done.wait(60)

    t = threading.Thread(target=other)

    def make():
        t.start()
        go.wait(60)
        return scratch.written(lambda: scratch.keep(spark.range(3), "deep"), "nested").unionByName(scratch.keep(spark.range(2), "inner"))

    made = scratch.written(make, "outer")
    done.set()
    t.join()
    assert made.count() == 5 and held[0].count() == 4
    assert not [p for p in scratch._PATHS if any(f"/{n}-" in p for n in ("deep", "nested", "inner"))]
    scratch.passing(lambda: scratch.drop(scratch.keep(spark.range(2), "gone")))
    scratch.drop(made, held[0])


def test_percentiles(spark):
    rng = np.random.default_rng(4)
    groups = {1: rng.integers(0, 9, 200).astype(float), 2: rng.normal(0, 1, 77), 3: np.array([5.0]), 4: np.array([2.0, 4.0])}
    rows = [(g, 0, float(v)) for g, vs in groups.items() for v in vs] + [(1, 0, None), (5, 0, None)]
    out = {r.image_id: list(r.p) for r in intensity.percentiles(spark.createDataFrame(rows, "image_id long, channel int, value double"), [0.0, 0.01, 0.5, 0.995, 1.0]).collect()}
    assert set(out) == set(groups)
    for g, vs in groups.items():
        assert out[g] == pytest.approx(np.percentile(vs, [0, 1, 50, 99.5, 100]).tolist())


def test_envelope():
    rng = np.random.default_rng(6)
    for n in (1, 2, 7, 40):
        for _ in range(20):
            g = np.where(rng.random(n) < 0.5, np.nan, rng.integers(0, 9, n)).astype(float)
            want = [min(((x - q) ** 2 + g[q] ** 2 for q in range(n) if not math.isnan(g[q])), default=math.nan) for x in range(n)]
            assert np.array_equal(segment.envelope(g), np.array(want), equal_nan=True)


def test_polygons(spark):
    """Random polygons, crossing themselves too, against the even-odd rule pixel by pixel; ROIs without an image go to each."""
    rng = np.random.default_rng(9)
    shapes = {i: [(int(r), int(c)) for r, c in rng.integers(-2, 16, (int(rng.integers(3, 8)), 2))] for i in range(12)}
    shapes[90], shapes[91] = [(2, 2), (2, 9), (2, 5)], [(1, 1), (3, 3)]
    rows = [(i, [{"row": r, "col": c} for r, c in v]) for i, v in shapes.items()]
    rois = spark.createDataFrame(rows, "image_id long, vertices array<struct<row:int,col:int>>")
    frame = spark.createDataFrame([(i, 14, 12) for i in shapes], "image_id long, height int, width int")
    got: dict = {}
    for r in segment.rasterize_polygons(rois, frame).collect():
        got.setdefault(r.image_id, set()).add((r.y, r.x))
    for i, v in shapes.items():
        v = [(min(max(r, 0), 13), min(max(c, 0), 11)) for r, c in v] if len(v) > 2 else []
        want = set()
        for y in range(14):
            for x in range(12):
                odd = on = False
                for (r1, c1), (r2, c2) in zip(v, v[1:] + v[:1], strict=True):
                    side = (x - c1) * (r2 - r1) - (y - r1) * (c2 - c1)
                    on |= side == 0 and min(r1, r2) <= y <= max(r1, r2) and min(c1, c2) <= x <= max(c1, c2)
                    odd ^= (r1 > y) != (r2 > y) and (side < 0 if r2 > r1 else side > 0)
                if odd or on:
                    want.add((y, x))
        assert got.get(i, set()) == want, i
    every = segment.rasterize_polygons(rois.filter("image_id = 90").drop("image_id"), frame)
    assert every.groupBy("image_id").count().select("count").distinct().collect()[0][0] == 8 and every.count() == 8 * len(shapes)


def test_bitmap_lines():
    for channels, row in ((1, [5, 300, -2]), (2, [1, 2, 3, 4, 5, 6]), (3, [1, 2, 3, 4, 5, 6, 7, 8, 9])):
        first = bitmaps.line_bytes(np.array(row), channels)
        assert len(first) == 12  # 3 pixels of 3 bytes, filled up to 12
        for x in range(3):
            own = [min(255, max(0, v)) for v in row[x * channels : x * channels + channels]] + [0] * (3 - channels)
            assert list(first[3 * x : 3 * x + 3]) == own[::-1]


def test_bitmaps_in_ranges(spark, tmp_path):
    """Files of 24, 32 and 8 bits, top down too, in ranges of any size, as Spark's image source decodes them; broken and foreign files give no rows."""
    rng = np.random.default_rng(2)
    want = rng.integers(0, 256, (7, 5, 3))
    lines = spark.createDataFrame([(i, y, want[y].ravel().tolist()) for i in (1, 2) for y in range(7)], "image_id long, y int, values array<int>")
    bitmaps.write_bitmaps(lines.repartition(3), str(tmp_path / "in"), 3)
    raw = (tmp_path / "in" / "img_1.bmp").read_bytes()
    assert raw[:54] == bitmaps.header(7, 5)
    (tmp_path / "in" / "cut.bmp").write_bytes(raw[:-9])
    (tmp_path / "in" / "text.bmp").write_bytes(b"BM no bitmap")
    (tmp_path / "in" / "empty.bmp").write_bytes(b"")
    head = lambda bits, first, height: struct.pack("<2sIHHI", b"BM", 0, 0, 0, first) + struct.pack("<IiiHHIIiiII", 40, 5, height, 1, bits, 0, 0, 1, 1, 256 if bits == 8 else 0, 0)
    (tmp_path / "in" / "down.BMP").write_bytes(head(32, 54, -7) + np.concatenate((want[:, :, ::-1], np.full((7, 5, 1), 9)), 2).astype(np.uint8).tobytes())
    palette, at = rng.integers(0, 256, (256, 4)).astype(np.uint8), rng.integers(0, 256, (7, 8)).astype(np.uint8)
    (tmp_path / "in" / "eight.bmp").write_bytes(head(8, 54 + 1024, 7) + palette.tobytes() + at.tobytes())
    for chunk in (1, 37, 1 << 20):
        got = {}
        for r in bitmaps.read_bmp(spark, str(tmp_path / "in"), chunk).collect():
            assert (r.path, r.channel, r.y, r.x) not in got
            got[r.path.rsplit("/", 1)[1], r.channel, r.y, r.x] = r.value
        whole = {(n, c, y, x): float(want[y, x, c]) for n in ("img_1.bmp", "img_2.bmp", "down.BMP") for y in range(7) for x in range(5) for c in range(3)}
        whole |= {("eight.bmp", c, y, x): float(palette[at[6 - y, x], 2 - c]) for y in range(7) for x in range(5) for c in range(3)}
        assert got == whole
    image = spark.read.format("image").load(str(tmp_path / "in" / "img_1.bmp")).select("image.*").first()
    assert np.array_equal(np.frombuffer(image.data, np.uint8).reshape(7, 5, 3)[:, :, ::-1], want)


def test_components_of_large_frames(spark):
    """Frames wider than a tile's side: a line, a frame's edge and a diagonal that cross several tiles of the standard size."""
    side = runs.TILE * 2 + 40
    line = [(1, 3, x) for x in range(side)] + [(1, 4, x) for x in range(0, side, 2)] + [(2, i, i) for i in range(side)] + [(3, y, 7) for y in range(side)] + [(3, 600, 900)]
    mask = spark.createDataFrame(line, "image_id long, y int, x int")
    for connectivity, want in ((8, {1: 1, 2: 1, 3: 2}), (4, {1: 1, 2: side, 3: 2})):
        got = graph.components(mask, connectivity).groupBy("image_id").agg(F.count_distinct("first").alias("n")).collect()
        assert {r.image_id: r.n for r in got} == want


def test_streams_and_writes_share_a_folder(spark):
    """A batch that is run again replaces its rows; another stream, a checkpoint made anew and a plain write add theirs."""
    place = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    px = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").limit(2).selectExpr("s_suppkey AS image_id")
    px = px.selectExpr("image_id", "explode(sequence(0, 99)) AS i").selectExpr("image_id", "0 AS channel", "0 AS z", "CAST(i / 10 AS INT) AS y", "i % 10 AS x", "CAST(i * 1.0 AS DOUBLE) AS value")
    px.coalesce(1).write.parquet(f"{place}/in")
    px.selectExpr("image_id + 100 AS image_id", "channel", "z", "y", "x", "value").coalesce(1).write.parquet(f"{place}/other")
    spec = {"name": "s", "steps": [{"type": "AutoThreshold", "channel": 0, "min_size": 0}, {"type": "IntensityMeasurement", "channel": 0}]}
    name = "intensity_measurements"
    held = set(scratch._PATHS)

    def watched(folder, checkpoint):
        watch.watch_folder(spark, f"{place}/{folder}", spec, f"{place}/out", f"{place}/{checkpoint}").awaitTermination()
        return sorted(r.image_id for r in results.read_results(spark, f"{place}/out", name).collect())

    first = watched("in", "one")
    assert len(first) == 2 and watched("in", "one") == first
    # the state is lost, the checkpoint's name is not: the same batch once more, as after a failure between writing and noting it
    os.rename(f"{place}/one/state", f"{place}/lost")
    assert watched("in", "one") == first
    both = watched("other", "two")
    assert both == sorted([*first, *(i + 100 for i in first)])
    assert watched("other", "anew") == sorted([*both, *(i + 100 for i in first)])
    results.write_results({name: results.read_results(spark, f"{place}/out", name).limit(1).drop("batch")}, f"{place}/out", "")
    assert results.read_results(spark, f"{place}/out", name).count() == 7
    assert not set(scratch._PATHS) - held


def test_images_that_come_in_parts(spark):
    """Two images over three files, a batch each: each is measured once, when it is whole; what is measured no longer waits."""
    place = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [(i, 0, 0, y, x, float(10 * i + y)) for i in (1, 2, 3) for y in range(4) for x in range(3)]
    table = lambda part: spark.createDataFrame(part, watch.PIXELS).coalesce(1).write.mode("append").parquet(f"{place}/in")
    sizes = spark.createDataFrame([(1, 12), (2, 12), (3, 13)], "image_id long, n_pixels long")
    spec = {"name": "s", "steps": [{"type": "IntensityMeasurement", "channel": 0}]}
    seen = []
    for part in (rows[:20], rows[20:24], rows[24:]):
        table(part)
        watch.watch_folder(spark, f"{place}/in", spec, f"{place}/out", f"{place}/cp", files_per_batch=1, sizes=sizes).awaitTermination()
        seen.append({r.image_id: r.sum_intensity for r in results.read_results(spark, f"{place}/out", "intensity_measurements").collect()})
    want = {i: sum(r[5] for r in rows if r[0] == i) for i in (1, 2)}
    assert seen == [{1: want[1]}, want, want]
    assert results.read_results(spark, f"{place}/out", "intensity_measurements").count() == 2
    table([(3, 0, 0, 9, 9, 1.0)])
    watch.watch_folder(spark, f"{place}/in", spec, f"{place}/out", f"{place}/cp", files_per_batch=1, sizes=sizes).awaitTermination()
    got = {r.image_id: r.sum_intensity for r in results.read_results(spark, f"{place}/out", "intensity_measurements").collect()}
    assert got == {**want, 3: sum(r[5] for r in rows if r[0] == 3) + 1}
    assert {r.batch for r in spark.read.parquet(f"{place}/cp/images/waiting").select("batch").distinct().collect()} <= {"b2", "b3"}


def test_preview(spark):
    px = spark.createDataFrame([(i, 0, z, y, x, float(i + z + (y == x) * 50)) for i in (1, 2) for z in (0, 1) for y in range(5) for x in range(5)], watch.PIXELS)
    images = spark.createDataFrame([(i, "a", ["A"], 1.0, 1.0) for i in (1, 2)], "image_id long, path string, channel_names array<string>, pixel_size_um double, z_step_um double")
    spec = {"steps": [{"type": "AutoThreshold", "channel": 0, "min_size": 0}, {"type": "IntensityMeasurement", "channel": 0}]}
    seen = jobs.preview(spec, jobs.Frames(px, images), 2, 1, 1)
    assert not seen.tables and {(r.image_id, r.y, r.x) for r in seen.mask("mask_ch0").collect()} == {(2, k, k) for k in range(5)}
    assert {(r.image_id, r.z) for r in seen.px.collect()} == {(2, 0)}
    assert [r.image_id for r in jobs.preview(spec, jobs.Frames(px, images), 1).table("intensity_measurements").collect()] == [1]


@pytest.mark.parametrize("joined", [True, False])
def test_running_sums_over_ranges(spark, joined):
    rng = np.random.default_rng(3)
    rows = [(g, int(v), float(n), 1.0) for g, size in ((1, 900), (2, 1), (None, 40), (3, 300)) for v, n in zip(rng.permutation(5000)[:size], rng.integers(1, 9, size), strict=True)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(joined).lower())
    try:
        df = spark.createDataFrame(rows, "g int, v long, n double, one double")
        got = {(r.g, r.v): (r.nth, r.upto_n) for r in ranges.running(df, ["g"], "v", ["n"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for g in (1, 2, None, 3):
        total = 0.0
        for k, (_, v, n, _) in enumerate(sorted(r for r in rows if r[0] == g), 1):
            total += n
            want[g, v] = (k, total)
    assert got == want


def test_ranks_and_fixed_points_in_ranges(spark):
    """Many distinct values: ranks over ranges, and Li's steps from block to block, as with all values in one."""
    rng = np.random.default_rng(5)
    planes = {1: np.concatenate((rng.normal(20, 5, 400), rng.normal(90, 9, 200))), 2: rng.integers(0, 9, 300).astype(float), 3: np.full(50, 4.0)}
    pl = spark.createDataFrame([(i, 0, 0, k, float(v)) for i, vs in planes.items() for k, v in enumerate(vs)], "image_id long, channel int, y int, x int, value double")
    for ranked in (1, 1000):
        got = {r.image_id: list(r.p) for r in intensity.percentiles(pl, [0.01, 0.5, 0.995], ranked=ranked).collect()}
        assert all(got[i] == pytest.approx(np.percentile(vs, [1, 50, 99.5])) for i, vs in planes.items())
    whole, parts = ({r.image_id: r.threshold for r in segment.threshold_li(pl, block=b).collect()} for b in (1 << 16, 25))
    assert whole == pytest.approx(parts) and set(whole) == set(planes)


@pytest.mark.parametrize("radius", [0, 1, 2, 5, 17, 50])
def test_flat_disk_by_chords(radius):
    block = np.random.default_rng(radius).normal(0, 9, (61, 83))
    block[40:, :20] = np.nan
    flat = [(dy, dx, 0.0) for dy, dx in neighbours.disk(radius)]
    for largest in (False, True):
        assert np.array_equal(neighbours.disk_extreme(block, radius, largest), neighbours.shifted_extreme(block, flat, largest), equal_nan=True)


@pytest.mark.parametrize("radius", [1.0, 3.0, 6.5, 20.0, 50.0])
def test_ball_by_squares(radius):
    rng = np.random.default_rng(int(radius))
    ball = [(dy, dx, radius - math.sqrt(radius * radius - dy * dy - dx * dx)) for dy, dx in neighbours.disk(radius)]
    for block in (rng.normal(100, 3, (61, 83)), rng.integers(0, 255, (61, 83)).astype(float), np.where(rng.random((61, 83)) < 0.02, 5000.0, 7.0)):
        block[40:, :20] = np.nan
        assert np.array_equal(neighbours.ball_least(block, radius), neighbours.shifted_extreme(block, ball), equal_nan=True)


def test_threshold_plan_reads_pixels_once(spark, sf):
    plan = queries.QUERIES["auto_threshold"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "supplier.parquet" not in plan  # the plane is written once, and read from there


def test_bitmaps_of_a_changed_join(spark):
    """A file stays one task's where the join with the sizes is planned by sorting and turns out small."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        lines = spark.range(40 * 32, numPartitions=6).select(F.floor(F.col("id") / 32).alias("image_id"), (F.col("id") * 7 % 32).cast("int").alias("y"), F.array_repeat(F.lit(3), 10).alias("values"))
        lines = lines.repartition(5, "y").groupBy("image_id", "y").agg(F.first("values").alias("values"))
        at = lambda batches: (pa.RecordBatch.from_arrays([b.column(0), pa.array([TaskContext.get().partitionId()] * len(b), pa.int32())], names=["image_id", "part"]) for b in batches)
        rows = bitmaps.by_file(lines, 2).mapInArrow(at, "image_id long, part int").collect()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert len(rows) == 40 * 32 and len({(r.image_id, r.part) for r in rows}) == 40


def test_bitmaps_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """Names of files are few bytes; their content is still dealt out."""
    monkeypatch.setattr(bitmaps, "OPENING", bitmaps.CHUNK // 10, raising=False)
    lines = spark.range(60 * 4).select(F.floor(F.col("id") / 4).alias("image_id"), (F.col("id") % 4).cast("int").alias("y"), F.array_repeat(F.lit(3), 10).alias("values"))
    bitmaps.write_bitmaps(lines, str(tmp_path / "in"))
    rows = bitmaps.read_bmp(spark, str(tmp_path / "in")).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in rows) == 60 * 4 * 5 * 3 and len(rows) > 4


def test_pixels_are_many_tasks(spark, tmp_path):
    """A small file of many images makes as many tasks as their pixels need, and no image is in two."""
    spark.range(1000).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    px = fixtures.pixels(spark, str(tmp_path)).select("image_id", F.spark_partition_id().alias("part")).groupBy("image_id").agg(F.min("part").alias("a"), F.max("part").alias("b"))
    rows = px.collect()
    assert len({r.a for r in rows}) == 1000 // fixtures.STACKS + 1 and all(r.a == r.b for r in rows)


def test_pixels_are_not_broadcast(spark, sf):
    """The tables are small files, and what is made of them is not: no join of theirs sends pixels through the driver."""
    px = fixtures.pixels(spark, sf)
    pl = intensity.z_project(px, "max", 0)
    kept = scratch.keep_pixels(pl)
    mask = segment.above(kept, segment.threshold_otsu(kept))
    roi = segment.rasterize_bbox(kept.groupBy("image_id").agg(F.lit(1).alias("top"), F.lit(1).alias("left"), F.lit(9).alias("bottom"), F.lit(9).alias("right")), neighbours.frame_of(px))
    plane = lambda c: intensity.z_project(px, "max", c).drop("channel")
    made = [intensity.rescale_uint8(px), intensity.normalize(px), segment.thresholds(pl, "otsu"), segment.thresholds(pl, "isodata"), mask, measure.apply_roi(pl, roi), measure.pearson(measure.zero_outside(plane(0), roi), measure.zero_outside(plane(1), roi)), measure.manders_random(plane(0), plane(1), mask, neighbours.frame_of(px))]
    for df in made:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pixels_are_counted_by_compiled_code(spark, sf, monkeypatch):
    """The JVM compiles no method of over 8,000 bytes, and runs it some ten times slower: the pixels' formula isn't repeated for the test of nulls."""
    counted = []
    monkeypatch.setattr(intensity, "keep_pixels", lambda df, label="table": counted.append(df) or scratch.keep_pixels(df, label))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in [intensity.contrast_limits(fixtures.pixels(spark, sf)), *counted]:
            code = df._jdf.queryExecution().debug().codegenToSeq()
            assert code.size() and max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) <= 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(counted) == 2


def test_thresholds_sort_no_pixels(spark, sf):
    """What a row a plane is joined to is neither sorted nor broadcast: a task's memory doesn't go by the pixels it reads."""
    pl = scratch.keep(intensity.z_project(fixtures.pixels(spark, sf), "max", 0))
    plan = segment.above(pl, segment.threshold_otsu(pl))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == plan.count("BuildRight") == 2 and "SortMergeJoin" not in plan and "Broadcast" not in plan


def _all_bins(vs):
    """Isodata's and the triangle's thresholds of a plane, over all bins one by one."""
    lo, hi = min(vs), max(vs)
    if hi <= lo:
        return lo, lo
    n = np.zeros(256, int)
    for v in vs:
        n[min(255, math.floor((v - lo) / (hi - lo) * 256))] += 1
    c = [lo + (k + 0.5) * (hi - lo) / 256 for k in range(256)]
    off = lambda k: (n[: k + 1] @ c[: k + 1] / n[: k + 1].sum() + n[k + 1 :] @ c[k + 1 :] / n[k + 1 :].sum()) / 2 - c[k]
    iso = next((c[k] for k in range(255) if 0 <= off(k) < (hi - lo) / 256), lo)
    peak, low, high = int(n.argmax()), int(np.flatnonzero(n)[0]), int(np.flatnonzero(n)[-1])
    flip = peak - low < high - peak
    width = high - peak if flip else peak - low
    places = [(high - k if flip else k - low, k) for k in range(256)]
    norm = math.hypot(n[peak], width)
    far = max((n[peak] / norm * x - width / norm * n[k], -x, k) for x, k in places if 0 <= x < max(1, width))
    return iso, c[far[2]]


def test_thresholds_over_empty_bins(spark):
    """Isodata and the triangle, which may choose an empty bin, against all bins one by one."""
    rng = np.random.default_rng(8)
    planes = [rng.normal(50, 9, 300), rng.integers(0, 7, 90), np.r_[rng.normal(0, 1, 200), rng.normal(40, 2, 50)], np.r_[rng.normal(90, 3, 300), [0.0, 2.5]], np.full(5, 3.0), np.array([1.0, 9.0]), np.r_[np.zeros(30), 5.0, np.full(40, 100.0)], rng.exponential(20, 500)]
    rows = [(i, 0, float(v)) for i, vs in enumerate(planes) for v in vs]
    pl = spark.createDataFrame(rows, "image_id long, channel int, value double")
    for nth, method in enumerate(("isodata", "triangle")):
        got = {r.image_id: r.threshold for r in segment.thresholds(pl, method).collect()}
        assert got == pytest.approx({i: _all_bins([float(v) for v in vs])[nth] for i, vs in enumerate(planes)})


def test_empty_bins_are_no_rows(spark, sf):
    """A task's memory goes by the bins that hold pixels: no row for each of a plane's 256 bins is joined and sorted."""
    pl = scratch.keep(intensity.z_project(fixtures.pixels(spark, sf), "max", 0))
    for method in ("isodata", "triangle"):
        plan = segment.thresholds(pl, method)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ShuffledHashJoin") == 1 and "SortMergeJoin" not in plan


def test_threshold_queries_sort_no_pixels(spark, sf):
    for method in ("otsu", "yen", "triangle", "isodata"):
        plan = queries.QUERIES[f"threshold_{method}"](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ShuffledHashJoin") == 1 and "SortMergeJoin" not in plan and "Broadcast" not in plan


def test_pixels_pass_by_their_ranges(spark, sf):
    for name in ("rescale_uint8", "extract_slice", "contrast_stretch", "normalize_minmax", "normalize_percentile"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan()
        pixels = [line for line in plan.toString().split("\n") if "HashJoin" in line or "SortMergeJoin" in line][0]
        assert "ShuffledHashJoin" in pixels and "BuildRight" in pixels, name


def test_steps_on_channels_do_not_repeat_each_other(spark):
    rng = np.random.default_rng(4)
    rows = [(i, c, 0, y, x, float(rng.integers(0, 99))) for i in range(2) for c in range(2) for y in range(9) for x in range(9)]
    px = spark.createDataFrame(rows, "image_id long, channel int, z int, y int, x int, value double")
    steps = [lambda p, c: intensity.background_subtract(p, c, 3.0, tile=4), lambda p, c: intensity.gaussian_blur(p, c, 1.0)]
    done = px
    for step in steps:
        for c in (0, 1):
            done = step(done, c)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("MapInArrow|FlatMapGroupsInPandas", plan)) == 2 and plan.count("ArrowEvalPython") == 4
    assert done.schema["channel"].dataType == px.schema["channel"].dataType
    got = {tuple(r)[:-1]: r.value for r in done.collect()}
    want = {tuple(r)[:-1]: r.value for c in (0, 1) for r in steps[1](steps[0](px.filter(F.col("channel") == c), None), None).collect()}
    assert got == want and len(got) == len(rows)


def test_sizes_and_planes_are_of_the_same_pixels(spark):
    px = spark.createDataFrame([(0, c, z, y, x, 1.0 + c + z) for c in range(2) for z in range(2) for y in range(4) for x in range(5)], "image_id long, channel int, z int, y int, x int, value double")
    one = jobs.Frames(px, spark.createDataFrame([(0,)], "image_id long"))
    assert one.sizes() is one.sizes()
    cropped = dataclasses.replace(one, px=px.filter("y < 2 AND x < 3"))
    assert [tuple(r) for f in (one, cropped, one) for r in f.sizes().collect()] == [(0, 4, 5), (0, 2, 3), (0, 4, 5)]
    for f, n in ((one, 20), (cropped, 6)):
        both = f.plane(0, "max").unionByName(f.plane(1, "max"))
        for c in (0, 1):
            own = intensity.z_project(both, "max", c)
            assert {(r.channel, r.value) for r in own.collect()} == {(c, 2.0 + c)} and own.count() == n


def test_lines_of_any_length_are_convolved(spark):
    rng = np.random.default_rng(5)
    vals = [rng.random(int(n)).tolist() for n in rng.choice([1, 2, 7, 30], 40)]
    weights = neighbours.gaussian_weights(1.5)
    r = len(weights) // 2
    got = neighbours.convolve(spark.createDataFrame(list(enumerate(vals)), "id int, vals array<double>"), weights).collect()
    for row in got:
        wide = np.pad(np.array(vals[row.id]), r, mode="symmetric")
        want = wide[: len(vals[row.id])] * weights[0]
        for k in range(1, len(weights)):
            want = want + wide[k : k + len(vals[row.id])] * weights[k]
        assert row.vals == want.tolist()


def test_regions_before_an_empty_bin(spark, tmp_path):
    """Images whose best Otsu bin is followed by an empty one: on one thread, where its sums have one order, the SQL takes the lower bin too."""
    spark.createDataFrame([(k,) for k in (203, 248, 392, 1274, 1319, 1463)], "s_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    got = queries.QUERIES["extract_roi"](spark, str(tmp_path)).select("image_id", "y", "x").collect()
    rows = sorted(map(tuple, got))
    assert rows == sorted(con.sql(f"SELECT image_id, y, x FROM ({queries.ORACLE['extract_roi']})").fetchall())
    of = {k: [r[1:] for r in rows if r[0] == k] for k in (203, 248, 392, 1274, 1319, 1463)}
    assert all(of[k] and len(of[k]) == len(of[k + 1071]) for k in (203, 248, 392))


def test_a_job_projects_a_channel_once(spark, sf, monkeypatch):
    made = []
    monkeypatch.setattr(jobs, "keep", lambda df, label="table": made.append(label) or scratch.keep(df, label))
    steps = [s for s in queries.SPEC["steps"] if s["type"] in ("AutoThreshold", "ParticleAnalysis", "ColocalizationAnalysis")]
    px = fixtures.pixels(spark, sf).filter("image_id < 2")
    frames = jobs.Frames(px, fixtures.images(spark, sf))
    done = jobs.run_pipeline({"steps": [{k: v for k, v in s.items() if k != "roi_mask"} for s in steps]}, frames)
    assert done.table("colocalization_results").count() == 2
    assert sorted(made) == ["plane", "plane", "sizes"] and not frames.known
