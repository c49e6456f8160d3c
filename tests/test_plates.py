"""Image and plate operators: hand-made goldens, invariants, and the queries against their SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from platelume.functions import graph, neighbours
from platelume.operators import intensity, measure, plate, segment
from platelume.plans import jobs, queries
from platelume.sources import files, results
from platelume.streaming.watch import watch_folder

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def mask_of(spark, *pictures):
    rows = [(i, y, x) for i, p in enumerate(pictures) for y, line in enumerate(p.split()) for x, c in enumerate(line) if c == "#"]
    return spark.createDataFrame(rows, "image_id long, y int, x int")


def frame(spark, *sizes):
    return spark.createDataFrame([(i, h, w) for i, (h, w) in enumerate(sizes)], "image_id long, height int, width int")


def pixels_of(spark, *arrays, channel=0):
    rows = [(i, channel, 0, y, x, float(a[y, x])) for i, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id long, channel int, z int, y int, x int, value double")


def array_of(rows, shape):
    out = np.full(shape, np.nan)
    for r in rows:
        out[r.y, r.x] = r.value
    return out


@pytest.mark.parametrize("name", ["where_what", "pair_wells_by_serial", "resolve_well_roi", "z_project", "threshold_otsu", "threshold_triangle", "connected_components", "distance_transform", "local_peaks", "watershed_split", "fill_holes", "extract_roi", "threshold_li", "background_tophat", "mosaic_components", "mosaic_background", "particle_solidity", "particle_perimeter", "coloc_per_particle", "rotate90", "run_log"])
def test_query_agrees_with_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.ORACLE[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = [want.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_every_query_is_known():
    assert set(queries.ORACLE) <= set(queries.QUERIES)
    assert set(queries.QUERIES) - set(queries.ORACLE) == {"run_sample_job"}


SQUARE = "....... .#####. .#####. .#####. .#####. .#####. ......."
PLUS = ".#. ### .#."
PAIR = "#. .#"


def test_connectivity_and_small_objects(spark):
    m = mask_of(spark, PAIR, SQUARE, "###### ###### ######")
    count = lambda c: {r.image_id: r.n for r in segment.connected_components(m, c).groupBy("image_id").agg(F.max("label").alias("n")).collect()}
    assert count(8) == {0: 1, 1: 1, 2: 1} and count(4) == {0: 2, 1: 1, 2: 1}
    left = segment.remove_small_objects(m, 18).groupBy("image_id").count().collect()
    assert {r.image_id: r["count"] for r in left} == {1: 25}
    with pytest.raises(ValueError):
        graph.components(m, 6)


@pytest.mark.parametrize("tile", [2, 3, 8])
@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_over_tiles(spark, tile, connectivity):
    rng = np.random.default_rng(tile)
    pics = [" ".join("".join(rng.choice(list("#."), 9)) for _ in range(9)) for _ in range(2)]
    m = mask_of(spark, *pics)
    whole = {(r.image_id, r.y, r.x): tuple(r.first) for r in graph.components(m, connectivity, 64).collect()}
    assert {(r.image_id, r.y, r.x): tuple(r.first) for r in graph.components(m, connectivity, tile).collect()} == whole


def test_shapes(spark):
    lab = mask_of(spark, SQUARE, PLUS, "#", "### ###").withColumn("label", F.lit(1))
    per = {r.image_id: r.perimeter_px for r in measure.particle_perimeter(lab).collect()}
    assert per[0] == 16 and per[2] == 0 and per[1] == pytest.approx(4 * math.sqrt(2))
    sol = {r.image_id: r.solidity for r in measure.particle_solidity(lab).collect()}
    assert sol[0] == sol[2] == sol[3] == 1.0
    ecc = {r.image_id: r.eccentricity for r in measure.particle_eccentricity(lab).collect()}
    assert ecc[0] == pytest.approx(0) and ecc[3] == pytest.approx(math.sqrt(1 - (0.25 + 1 / 12) / (2 / 3 + 1 / 12)))


def test_distance_and_watershed(spark):
    two = ["." * 24] * 3 + ["".join("#" if (y - 8) ** 2 + (x - 7) ** 2 <= 20 or (y - 8) ** 2 + (x - 15) ** 2 <= 20 else "." for x in range(24)) for y in range(3, 14)] + ["." * 24] * 3
    m = mask_of(spark, " ".join(two))
    f = frame(spark, (17, 24))
    on = {(r.y, r.x): r.d2 for r in segment.distance_transform(m, f).collect()}
    off = [(y, x) for y in range(17) for x in range(24) if (y, x) not in on]
    assert all(d == min((y - a) ** 2 + (x - b) ** 2 for a, b in off) for (y, x), d in on.items())
    parts = segment.watershed_split(m, f, 3).collect()
    assert len(parts) == len(on) and {r.label for r in parts} == {1, 2}
    assert {r.label for r in parts if r.x < 10} == {1} and {r.label for r in parts if r.x > 12} == {2}
    full = segment.distance_transform(mask_of(spark, "## ##"), frame(spark, (2, 2))).collect()
    assert {r.d2 for r in full} == {None}


def test_holes_and_polygons(spark):
    ring = "..... .###. .#.#. .###. ....."
    assert segment.fill_holes(mask_of(spark, ring, PLUS), frame(spark, (5, 5), (3, 3))).groupBy("image_id").count().orderBy("image_id").collect() == [(0, 9), (1, 5)]
    roi = spark.createDataFrame([(0, [(1, 1), (1, 3), (3, 3), (3, 1)]), (1, [(-5, -5), (-5, 9), (9, 9), (9, -5)]), (1, [(0, 0), (1, 1)])], "image_id long, vertices array<struct<row:int,col:int>>")
    got = segment.rasterize_polygons(roi, frame(spark, (5, 5), (3, 3))).groupBy("image_id").count().orderBy("image_id").collect()
    assert got == [(0, 9), (1, 9)]


def test_dilation_is_the_l1_ball(spark):
    lab = mask_of(spark, "..... ..... ..#.. ..... #....").withColumn("label", F.lit(1)).select("image_id", "label", "y", "x")
    images = spark.createDataFrame([(0, 0.5)], "image_id long, pixel_size_um double")
    got = {(r.y, r.x) for r in segment.dilate_mask(lab, 1.0, images, frame(spark, (5, 5))).collect()}
    assert got == {(y, x) for y in range(5) for x in range(5) if abs(y - 2) + abs(x - 2) <= 2 or abs(y - 4) + x <= 2}


@pytest.mark.parametrize("tile", [4, 7, 64])
def test_tiles_do_not_show(spark, tile):
    a = np.random.default_rng(2).integers(0, 99, (13, 11)).astype(float)
    for method, r in (("rolling_ball", 3.0), ("tophat", 2.0)):
        got = array_of(intensity.background_subtract(pixels_of(spark, a), 0, r, method, tile).collect(), a.shape)
        flat = [(dy, dx) for dy in range(-3, 4) for dx in range(-3, 4) if dy * dy + dx * dx <= r * r]
        near = lambda f, b, h: np.array([[f(b[y + dy, x + dx] + h(dy, dx) for dy, dx in flat if 0 <= y + dy < 13 and 0 <= x + dx < 11) for x in range(11)] for y in range(13)])  # noqa: B023
        if method == "tophat":
            want = a - near(max, near(min, a, lambda *_: 0), lambda *_: 0)
        else:
            want = np.maximum(0, a - near(min, a, lambda dy, dx: 3 - math.sqrt(9 - dy * dy - dx * dx)))
        assert np.allclose(got, want)


def test_blur_and_ranges(spark):
    a = np.random.default_rng(1).integers(0, 50, (6, 9)).astype(float)
    w = np.array(neighbours.gaussian_weights(1.0))
    pad = lambda v: np.convolve(np.pad(v, len(w) // 2, mode="symmetric"), w, "valid")
    want = np.apply_along_axis(pad, 1, np.apply_along_axis(pad, 0, a))
    assert np.allclose(array_of(intensity.gaussian_blur(pixels_of(spark, a), 0, 1.0).collect(), a.shape), want)
    flat = pixels_of(spark, np.full((4, 4), 7.0))
    assert {r.value for r in intensity.normalize(flat).collect()} == {0.0}
    assert np.allclose([r.value for r in intensity.gaussian_blur(flat, None, 2.0).collect()], 7.0)
    assert [(r.lo, r.hi) for r in intensity.contrast_limits(flat).collect()] == [(7.0, 8.0)]
    assert [r.threshold for r in segment.threshold_otsu(intensity.z_project(flat)).collect()] == [7.0]
    assert segment.auto_threshold(flat, 0).count() == 0
    for bad in (lambda: intensity.z_project(flat, "mode"), lambda: segment.thresholds(flat, "x"), lambda: intensity.normalize(flat, None, "x"), lambda: intensity.background_subtract(flat, 0, 1, "x")):
        with pytest.raises(ValueError):
            bad()


def test_li_is_a_fixed_point(spark):
    a = np.concatenate((np.random.default_rng(4).integers(0, 30, 60), np.random.default_rng(5).integers(90, 120, 40))).reshape(10, 10).astype(float)
    t = segment.threshold_li(intensity.z_project(pixels_of(spark, a))).first().threshold
    v, lo = a - a.min(), a.min()
    cur, nxt, tol = -1e9, v.mean(), np.diff(np.unique(v)).min() / 2
    while abs(nxt - cur) > tol:
        cur = nxt
        f, b = v[v > cur].mean(), v[v <= cur].mean()
        nxt = (b - f) / (np.log(b) - np.log(f))
    assert t == pytest.approx(nxt + lo)


def test_pairs_of_channels(spark):
    a = np.arange(12, dtype=float).reshape(3, 4)
    p = pixels_of(spark, a).select("image_id", "y", "x", "value")
    f = frame(spark, (3, 4))
    assert measure.pearson(p, p).first().r == pytest.approx(1)
    assert measure.pearson(p, p.withColumn("value", F.lit(3.0))).first().r == 0
    turned = p
    h, w = 3, 4
    for _ in range(4):
        turned = measure.rotate90(turned, frame(spark, (h, w)))
        h, w = w, h
    assert sorted(map(tuple, turned.collect())) == sorted(map(tuple, p.collect()))
    assert measure.manders_random(p, p, p.limit(1), f).first().m1 is None
    once = {(r.y, r.x): r.value for r in measure.rotate90(p, f).collect()}
    assert all(once[y, x] == np.rot90(a)[y, x] for y in range(4) for x in range(3))


def test_wells(spark):
    names = ["/p/__E_P_A1-1_00003.vsi", "/p/__E_P_a1-1_00001.vsi", "/p/__E_P_A1-1_00007.vsi", "/p/__E_P_B2-1_00002.vsi", "/p/x_A1-1.vsi", "/p/_A1-1_hole.roi", "/p/c_B2-1_00001.roi", "/p/_C3-1_hole.roi", "/out/rois/_B2-1_hole.tif"]
    listed = spark.createDataFrame([(n,) for n in names], "path string")
    wells = plate.pair_wells_by_serial(plate.parse_well_names(listed))
    got = {r.well_id: r for r in wells.collect()}
    assert (got["A1"].bf_serial, got["A1"].fl_serial, got["A1"].extra_paths, got["A1"].is_complete) == (1, 3, ["/p/__E_P_A1-1_00007.vsi"], True)
    assert got["B2"].fl_path is None and set(got) == {"A1", "B2"}
    rois = plate.assign_rois_to_wells(wells, listed)
    assert {(r.well_id, r.kind, r.ord) for r in rois.collect()} == {("A1", "hole", 1), ("B2", "existing", 1), ("B2", "hole", 2)}
    assert [r.status for r in plate.pair_by_suffix(listed.filter("path LIKE '%B2%vsi'")).collect()] == ["no brightfield"]
    key = lambda label, source: spark.range(1).select(plate.roi_mask_key(F.lit(label), F.lit(source)).alias("k")).first().k
    assert (key("My Roi-1!", "auto"), key("!!", "auto"), key("x", "whole")) == ("roi_my_roi1", "roi", "")


def test_jobs(spark, sf, tmp_path):
    frames = jobs.Frames(pixels_of(spark, np.eye(6) * 50 + 1), spark.createDataFrame([(0, "a", ["A"], 1.0, 1.0)], "image_id long, path string, channel_names array<string>, pixel_size_um double, z_step_um double"))
    with pytest.raises(ValueError, match="unknown step"):
        jobs.run_pipeline({"steps": [{"type": "Nope"}]}, frames)
    with pytest.raises(KeyError):
        jobs.run_pipeline({"steps": [{"type": "WatershedSplit", "channel": 0}]}, frames)
    done = jobs.run_pipeline({"steps": [{"type": "AutoThreshold", "channel": 0, "min_size": 0}, {"type": "ParticleAnalysis", "channel": 0, "min_size_um2": 1.0}]}, frames)
    row = done.table("particle_measurements").first()
    assert (row.channel, row.label, row.area_px, row.roi_mask) == ("A", 1, 6, "whole_image")
    out = str(tmp_path / "out")
    results.write_results({"particle_measurements": done.table("particle_measurements")}, out, "e")
    results.write_results({"particle_measurements": done.table("particle_measurements").drop("roi_path")}, out, "e")
    back = results.read_results(spark, out, "particle_measurements").collect()
    assert len(back) == 2 and {r.roi_path for r in back} == {""}
    pixels_of(spark, np.eye(6) * 9).write.parquet(str(tmp_path / "in"))
    watch_folder(spark, str(tmp_path / "in"), {"steps": [{"type": "IntensityMeasurement", "channel": 0}]}, out, str(tmp_path / "cp")).awaitTermination()
    assert results.read_results(spark, out, "intensity_measurements").select(F.sum("sum_intensity")).first()[0] == 54


def test_specs(spark, tmp_path):
    place = str(tmp_path / "spec")
    jobs.save_spec(spark, queries.PLAIN, place)
    jobs.save_spec(spark, queries.SPEC, place)
    assert jobs.load_spec(spark, place) == queries.SPEC
    (tmp_path / "one.json").write_text('{"steps": []}')
    assert jobs.load_spec(spark, str(tmp_path / "one.json")) == {"steps": []}
    with pytest.raises(ValueError, match="step 0, GaussianBlur: .*sigmma.*step 1: unknown step 'Nope'.*step 2, Normalize: .*channel"):
        jobs.check_spec({"steps": [{"type": "GaussianBlur", "channel": 0, "sigmma": 1.0}, {"type": "Nope"}, {"type": "Normalize", "enabled": False}]})
    with pytest.raises(ValueError, match="list of steps"):
        jobs.check_spec("{}")
    (tmp_path / "none.json").write_text(" ")
    with pytest.raises(ValueError, match="no job spec"):
        jobs.load_spec(spark, str(tmp_path / "none.json"))


def test_channel_by_name(spark):
    px = pixels_of(spark, np.eye(2), channel=1)
    images = spark.createDataFrame([(0, ["A", "B"])], "image_id long, channel_names array<string>")
    assert files.select_channel(px, images, "B").count() == 4
    with pytest.raises(Exception, match="no channel"):
        files.select_channel(px, images, "C").collect()
