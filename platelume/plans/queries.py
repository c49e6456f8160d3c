"""A query for each operator over the whole tables, with SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.neighbours import frame_of
from ..functions.scratch import folder, keep, keep_pixels
from ..operators import intensity, measure, plate, segment
from ..sources import files, fixtures, results
from ..sources.bitmaps import write_bitmaps
from . import jobs
from .oracle import DOWN, MOSAIC, SPACING, STRIDE, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def put(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE[fn.__name__] = oracle
        return fn

    return put


def _r(c: str | Column, name: str = "") -> Column:
    return F.round(c, 6).alias(name or c)


def _plane(spark: SparkSession, d: str, channel: int | None = None) -> DataFrame:
    return intensity.z_project(fixtures.pixels(spark, d), "max", channel)


def _mask(spark: SparkSession, d: str) -> DataFrame:
    """What lies above Otsu's threshold in channel 0; written once, as what follows reads it several times."""
    pl = keep(_plane(spark, d, 0), "plane")
    return keep_pixels(segment.above(pl, segment.threshold_otsu(pl)).select("image_id", "y", "x"), "mask")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return keep_pixels(segment.connected_components(_mask(spark, d), 8).select("image_id", "label", "y", "x"), "labels")


def _mosaic(rows: DataFrame) -> DataFrame:
    """The rows of several images in one tall frame, larger than a tile."""
    y = F.col("image_id") % MOSAIC * STRIDE + F.col("y") + DOWN
    return rows.withColumn("y", y.cast("int")).withColumn("image_id", F.floor(F.col("image_id") / MOSAIC).cast("long"))


def _roi(spark: SparkSession, d: str) -> DataFrame:
    v = fixtures.roi_vertices(spark, d).groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("vrow").alias("row"), F.col("vcol").alias("col")))), lambda s: F.struct(s["row"].alias("row"), s["col"].alias("col"))).alias("vertices"))
    return segment.rasterize_polygons(v, frame_of(fixtures.pixels(spark, d)))


def _wells(spark: SparkSession, d: str) -> DataFrame:
    return plate.pair_wells_by_serial(plate.parse_well_names(fixtures.files(spark, d)))


def _well_rois(spark: SparkSession, d: str) -> DataFrame:
    return plate.assign_rois_to_wells(_wells(spark, d), fixtures.files(spark, d))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return plate.resolve_well_roi(_wells(spark, d), _well_rois(spark, d), fixtures.roi_selections(spark))


# ---- flagship --------------------------------------------------------------------------------


@query(
    sql(
        "m, p1, images",
        """SELECT image_id, 'GFP' AS channel, 'otsu_ch0' AS roi_mask, round(avg(value), 6) AS mean_intensity, sum(value) AS sum_intensity, count(*) AS area_px FROM p1 SEMI JOIN m USING (image_id, y, x) GROUP BY image_id""",
    )
)
def where_what(spark, d):
    """Mean intensity of channel 1 inside the Otsu region of channel 0, per image."""
    got = measure.intensity_measurement(fixtures.pixels(spark, d), fixtures.images(spark, d), 1, "max", _mask(spark, d), "otsu_ch0")
    return got.select("image_id", "channel", "roi_mask", _r("mean_intensity"), "sum_intensity", "area_px")


# ---- A: sources and sinks --------------------------------------------------------------------


@query(sql("files", "SELECT path FROM files WHERE path LIKE '%.roi' OR path LIKE '%.tif'"))
def scan_files(spark, d):
    return files.select_files(fixtures.files(spark, d), [".ROI", "tif"])


def _bitmaps(spark, d, place):
    """Each image's projected channels as a colour bitmap in a folder."""
    line = _plane(spark, d).groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "channel", F.col("value").cast("int").alias("v")))).alias("px"))
    return write_bitmaps(line.select("image_id", "y", F.transform("px", lambda p: p["v"]).alias("values")), place)


@query(sql("plane", "SELECT image_id, channel, count(*) AS n, sum(value) AS total FROM (SELECT * FROM plane UNION ALL SELECT image_id, 2, y, x, 0 FROM p0) GROUP BY ALL".replace("FROM p0", "FROM plane WHERE channel=0")))
def read_bitmaps(spark, d):
    """Bitmaps of the images read back as pixels, each in several tasks."""
    back = files.read_bitmaps(spark, _bitmaps(spark, d, f"{folder(spark)}/bitmaps/{uuid.uuid4().hex}"), 1024)
    return back.groupBy("path", "channel").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.regexp_extract("path", r"img_(\d+)", 1).cast("long").alias("image_id"), "channel", "n", "total")


@query(sql("pixels", "SELECT image_id, channel, z, count(*) AS n, sum(value) AS total FROM pixels GROUP BY ALL"))
def pixels_ingest(spark, d):
    raw = fixtures.pixels(spark, d).withColumns({"scene": F.lit(0), "t": F.lit(0), "value": F.col("value").cast("int")})
    other = raw.withColumn("t", F.lit(1)).unionByName(raw.withColumn("scene", F.lit(1)))
    return files.pixels_ingest(raw.unionByName(other)).groupBy("image_id", "channel", "z").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(sql("pixels", "SELECT image_id, 2 AS n_channels, 3 AS n_z, CAST(max(y)+1 AS INT) AS height, CAST(max(x)+1 AS INT) AS width, true AS is_z_stack, 'DAPI,GFP' AS channels, 0.5::DOUBLE AS pixel_size_um, 1.0::DOUBLE AS z_step_um FROM pixels GROUP BY image_id"))
def image_info(spark, d):
    return files.image_info(fixtures.pixels(spark, d), fixtures.images(spark, d))


@query(sql("pixels", "SELECT image_id, channel, z, y, x, value FROM pixels WHERE channel=1"))
def select_channel(spark, d):
    return files.select_channel(fixtures.pixels(spark, d), fixtures.images(spark, d), "GFP")


@query(sql("images", "SELECT image_id, path, regexp_extract(path, '[^/]*$') AS filename, 'exp1' AS experiment, 2 AS n_channels, 0.5::DOUBLE AS pixel_size_um FROM images"))
def register_images(spark, d):
    info = files.image_info(fixtures.pixels(spark, d), fixtures.images(spark, d))
    return results.register_images(fixtures.images(spark, d).select("image_id", "path"), info.drop("channels"), "exp1").select("image_id", "path", "filename", "experiment", "n_channels", "pixel_size_um")


def _intensities(spark, d):
    return measure.intensity_measurement(fixtures.pixels(spark, d), fixtures.images(spark, d), 0)


@query(sql("p0", "SELECT image_id, 'DAPI' AS channel, 'whole_image' AS roi_mask, '' AS roi_path, sum(value) AS sum_intensity, count(*) AS area_px, 'exp1' AS experiment FROM p0 GROUP BY image_id UNION ALL SELECT s_suppkey, '', 'whole_image', '', 0, 0, 'exp2' FROM supplier"))
def write_results(spark, d):
    out = f"{folder(spark)}/results/{uuid.uuid4().hex}"
    results.write_results({"intensity_measurements": _intensities(spark, d)}, out, "exp1")
    results.write_results({"intensity_measurements": fixtures.images(spark, d).select("image_id")}, out, "exp2")
    return results.read_results(spark, out, "intensity_measurements").select("image_id", "channel", "roi_mask", "roi_path", "sum_intensity", "area_px", F.col("experiment").cast("string").alias("experiment"))


@query(sql("p0", "SELECT image_id, sum(value) AS sum_intensity FROM p0 GROUP BY image_id"))
def export_parquet(spark, d):
    out = f"{folder(spark)}/export/{uuid.uuid4().hex}"
    tables = {"intensity_measurements": _intensities(spark, d), "particle_measurements": spark.createDataFrame([], results.schema("particle_measurements"))}
    done = results.export_parquet(tables, out)
    return spark.read.parquet(f"{out}/{done[0]}").select("image_id", "sum_intensity")


@query(sql("p0", "SELECT image_id, 'whole_image' AS roi_mask, '' AS roi_path, sum(value) AS sum_intensity FROM p0 GROUP BY image_id"))
def schema_evolve(spark, d):
    old = _intensities(spark, d).drop("roi_mask", "roi_path")
    return results.schema_evolve(old, results.schema("intensity_measurements")).select("image_id", "roi_mask", "roi_path", "sum_intensity")


@query("SELECT CASE WHEN s_suppkey%5=3 THEN NULL ELSE CAST(s_suppkey AS BIGINT) END AS image_id, 'job' AS pipeline_name, CASE WHEN s_suppkey%5 IN (3, 4) THEN 'error' ELSE 'ok' END AS status, CASE WHEN s_suppkey%5 IN (3, 4) THEN 'broken' ELSE '' END AS error_message FROM supplier")
def run_log(spark, d):
    img = fixtures.images(spark, d)
    bad = img.filter("image_id % 5 IN (3, 4)").select("image_id", F.lit("broken").alias("error"))
    return results.run_log(img.filter("image_id % 5 <> 3"), bad, "job", "{}").select("image_id", "pipeline_name", "status", "error_message")


# ---- B: plates -------------------------------------------------------------------------------

_W = "row, col, field"


@query(sql("parsed", "SELECT * FROM parsed"))
def parse_well_names(spark, d):
    return plate.parse_well_names(fixtures.files(spark, d))


@query(sql("wells", "SELECT *, fl_path IS NOT NULL AS is_complete FROM wells"))
def pair_wells_by_serial(spark, d):
    return _wells(spark, d).withColumn("extras", F.array_join("extra_paths", "|")).drop("extra_paths")


@query(
    sql(
        "files",
        """SELECT coalesce(a.k, b.k) AS well_key, a.path AS bf_path, b.path AS fl_path, CASE WHEN a.k IS NULL THEN 'no brightfield' WHEN b.k IS NULL THEN 'no fluorescence' ELSE 'paired' END AS status
        FROM (SELECT regexp_extract(path, '([^/]*)_00001\\.vsi$', 1) AS k, path FROM files WHERE path LIKE '%\\_00001.vsi' ESCAPE '\\') a
        FULL JOIN (SELECT regexp_extract(path, '([^/]*)_00002\\.vsi$', 1) AS k, path FROM files WHERE path LIKE '%\\_00002.vsi' ESCAPE '\\') b ON a.k=b.k""",
    )
)
def pair_by_suffix(spark, d):
    return plate.pair_by_suffix(fixtures.files(spark, d))


@query(sql("rois", "SELECT * FROM rois"))
def assign_rois_to_wells(spark, d):
    return _well_rois(spark, d)


@query(sql("files", "SELECT path, CASE WHEN regexp_matches(path, '_hole\\.[^.]*$') THEN 'hole' WHEN regexp_matches(path, '_background\\.[^.]*$') THEN 'background' ELSE 'existing' END AS kind FROM files"))
def classify_roi(spark, d):
    return fixtures.files(spark, d).select("path", plate.classify_roi(F.col("path")).alias("kind"))


@query(sql("resolved", "SELECT * FROM resolved"))
def resolve_well_roi(spark, d):
    return _resolved(spark, d)


@query(sql("wells, rois", f"SELECT {_W}, well_id, kind FROM wells CROSS JOIN (VALUES ('hole'), ('background')) AS k(kind) ANTI JOIN rois USING ({_W}, kind)"))
def wells_missing_roi(spark, d):
    return plate.wells_missing_roi(_wells(spark, d), _well_rois(spark, d))


@query(sql("resolved, wells", f"SELECT label, count(*) FILTER (roi_path IS NULL) AS n_missing, count(*) AS n_wells FROM resolved SEMI JOIN (SELECT * FROM wells WHERE fl_path IS NOT NULL) x USING ({_W}) GROUP BY label HAVING count(*) FILTER (roi_path IS NULL) > 0"))
def missing_roi_summary(spark, d):
    return plate.missing_roi_summary(_resolved(spark, d), _wells(spark, d))


@query(
    sql(
        "wells, rois",
        f"""SELECT row, col, coalesce(status, 'empty') AS status, coalesce(has, false) AS has_roi FROM (SELECT chr(CAST(65+range//24 AS INT)) AS row, CAST(range%24+1 AS INT) AS col FROM range(384))
        LEFT JOIN (SELECT row, col, arg_max(CASE WHEN fl_path IS NULL THEN 'bf_only' ELSE 'complete' END, field) AS status, arg_max(({_W}) IN (SELECT ({_W}) FROM rois), field) AS has FROM wells GROUP BY row, col) USING (row, col)""",
    )
)
def plate_grid(spark, d):
    return plate.plate_grid(spark, _wells(spark, d), _well_rois(spark, d))


@query(sql("wells, rois", f"SELECT count(*) AS n_wells, count(fl_path) AS n_complete, count(*)-count(fl_path) AS n_incomplete, (SELECT count(DISTINCT ({_W})) FROM rois) AS n_with_roi FROM wells"))
def plate_summary(spark, d):
    return plate.plate_summary(_wells(spark, d), _well_rois(spark, d))


@query(
    sql(
        "files",
        """SELECT DISTINCT r.path AS roi_path, w AS well, 'new_' || regexp_replace(regexp_extract(r.path, '[^/]*$'), '[^_]*$', '') || w || '.roi' AS new_name
        FROM (SELECT path, regexp_replace(split_part(regexp_extract(path, '[^/]*$'), '_', 6), '\\.[^.]*$', '') AS w FROM files WHERE path LIKE '%.roi' AND len(string_split(regexp_extract(path, '[^/]*$'), '_')) > 5) r
        JOIN (SELECT DISTINCT regexp_replace(split_part(regexp_extract(path, '[^/]*$'), '_', 5), '\\.[^.]*$', '') AS w2 FROM files WHERE path LIKE '%.vsi' AND len(string_split(regexp_extract(path, '[^/]*$'), '_')) > 4) i ON w=w2""",
    )
)
def roi_name_map(spark, d):
    f = fixtures.files(spark, d)
    return plate.roi_name_map(files.select_files(f, [".vsi"]), f, 4, 5, "new_")


@query(sql("files", "SELECT path AS roi_path, replace(regexp_extract(path, '[^/]*$'), '00002.roi', '00003.roi') AS new_name, replace(path, '/plate', '/copy') AS out_path FROM files WHERE path LIKE '%00002.roi'"))
def renumber_roi(spark, d):
    got = plate.renumber_roi(fixtures.files(spark, d), "00002.roi", "00003.roi")
    return got.withColumn("out_path", plate.output_path(F.col("roi_path"), "/plate", "/copy"))


@query(sql("resolved", "SELECT well_id, field, label, CASE WHEN regexp_replace(replace(lower(label), ' ', '_'), '[^a-z0-9_]', '', 'g')='' THEN 'roi' ELSE 'roi_' || regexp_replace(replace(lower(label), ' ', '_'), '[^a-z0-9_]', '', 'g') END AS mask_key FROM resolved"))
def roi_mask_key(spark, d):
    return _resolved(spark, d).select("well_id", "field", "label", plate.roi_mask_key(F.col("label"), F.col("source")).alias("mask_key"))


def _well_images(spark, d):
    """The plate's files as images: the nth acquired file is image n % suppliers' pixels."""
    w = _wells(spark, d)
    listed = w.select("bf_serial", F.col("bf_path").alias("path")).filter("path IS NOT NULL").unionByName(w.select(F.col("fl_serial").alias("bf_serial"), F.col("fl_path").alias("path")).filter("path IS NOT NULL"))
    own = fixtures.images(spark, d).drop("path")
    return listed.select("path", F.floor((F.col("bf_serial") - 1) / 2).cast("long").alias("image_id")).join(own, "image_id")


_WELL_IMAGES = "SELECT path, CAST(floor((s-1)/2) AS BIGINT) AS image_id FROM (SELECT bf_path AS path, bf_serial AS s FROM wells UNION ALL SELECT fl_path, fl_serial FROM wells) WHERE path IS NOT NULL"


@query(sql("wells, plane", f"SELECT {_W}, role, count(value) AS n, sum(value) AS total FROM (SELECT {_W}, 'bf' AS role, bf_path AS path FROM wells UNION ALL SELECT {_W}, 'fl', fl_path FROM wells) LEFT JOIN ({_WELL_IMAGES}) wi USING (path) LEFT JOIN plane USING (image_id) GROUP BY ALL"))
def read_well(spark, d):
    px = _plane(spark, d).withColumn("z", F.lit(0))
    return plate.read_well(_wells(spark, d), _well_images(spark, d), px).groupBy("row", "col", "field", "role").agg(F.count("value").alias("n"), F.sum("value").alias("total"))


@query(sql("wells", f"SELECT {_W}, '_' || well_id || '-' || field || '_hole.roi' AS name FROM wells"))
def roi_filename(spark, d):
    return _wells(spark, d).select("row", "col", "field", plate.roi_filename(F.col("row"), F.col("col"), F.col("field"), "hole").alias("name"))


@query(sql("sel, rois", "SELECT label, source, '' AS path FROM sel UNION ALL SELECT regexp_replace(regexp_extract(roi_path, '[^/]*$'), '\\.[^.]*$', ''), 'file', roi_path FROM rois"))
def detected_selections(spark, d):
    chosen = fixtures.roi_selections(spark).unionByName(spark.createDataFrame([("old", "file", "")], "label string, source string, existing_tag string"))
    return plate.detected_selections(chosen, _well_rois(spark, d))


# ---- C: intensity ----------------------------------------------------------------------------


@query(sql("pixels", "SELECT image_id, channel, y, x, max(value) AS vmax, min(value) AS vmin, round(avg(value), 6) AS vmean, sum(value) AS vsum FROM pixels GROUP BY ALL"))
def z_project(spark, d):
    out = intensity.z_projections(fixtures.pixels(spark, d), {f"v{m}": m for m in ("max", "min", "mean", "sum")})
    return out.withColumn("vmean", F.round("vmean", 6))


@query(sql("pixels", "SELECT image_id, channel, y, x, method, round(value, 6) AS value FROM (SELECT image_id, channel, y, x, avg(value) AS avg, min(value) AS min, max(value) AS max, sum(value) AS sum, stddev_samp(value) AS sd, median(value) AS median FROM pixels GROUP BY ALL) UNPIVOT (value FOR method IN (avg, min, max, sum, sd, median))"))
def z_project_stats(spark, d):
    return intensity.z_project_stats(fixtures.pixels(spark, d), ("avg", "min", "max", "sum", "sd", "median")).withColumn("value", F.round("value", 6))


@query(sql("pixels", "SELECT image_id, channel, z, y, x, round(greatest(0, least(1, (value-lo)/(CASE WHEN hi>lo THEN hi-lo ELSE 1 END))), 6) AS value FROM pixels JOIN (SELECT image_id, channel, min(value) AS lo, max(value) AS hi FROM pixels GROUP BY ALL) USING (image_id, channel)"))
def normalize_minmax(spark, d):
    return intensity.normalize(fixtures.pixels(spark, d, False)).withColumn("value", F.round("value", 6)).select("image_id", "channel", "z", "y", "x", "value")


@query(sql("pixels", "SELECT image_id, channel, z, y, x, round(greatest(0, least(1, (value-lo)/(CASE WHEN hi>lo THEN hi-lo ELSE 1 END))), 6) AS value FROM pixels JOIN (SELECT image_id, channel, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM pixels GROUP BY ALL) USING (image_id, channel)"))
def normalize_percentile(spark, d):
    return intensity.normalize(fixtures.pixels(spark, d, False), None, "percentile").withColumn("value", F.round("value", 6)).select("image_id", "channel", "z", "y", "x", "value")


@query(sql("pixels", "SELECT image_id, channel, z, y, x, CASE WHEN channel=0 THEN round(greatest(0, least(1, (value-10)/190)), 6) ELSE value END AS value FROM pixels"))
def brightness_contrast(spark, d):
    px = intensity.brightness_contrast(fixtures.pixels(spark, d), 0, 10.0, 200.0)
    return px.withColumn("value", F.when(F.col("channel") == 0, F.round("value", 6)).otherwise(F.col("value")))


@query(sql("blurred", "SELECT image_id, y, x, round(value, 6) AS value FROM blurred"))
def gaussian_blur(spark, d):
    return intensity.gaussian_blur(_plane(spark, d, 0), None, 2.0).select("image_id", "y", "x", _r("value"))


def _ball_sql(r: int) -> str:
    offs = [(a, b, r - (r * r - a * a - b * b) ** 0.5) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r]
    return f"SELECT a.image_id, a.y, a.x, round(greatest(0, any_value(a.value)-min(b.value+h)), 6) AS value FROM p0 a CROSS JOIN (VALUES {', '.join(f'({a}, {b}, CAST({h!r} AS DOUBLE))' for a, b, h in offs)}) AS o(dy, dx, h) JOIN p0 b ON b.image_id=a.image_id AND b.y=a.y+dy AND b.x=a.x+dx GROUP BY a.image_id, a.y, a.x"


@query(sql("p0", _ball_sql(5)))
def background_rolling_ball(spark, d):
    return intensity.background_subtract(_plane(spark, d, 0), None, 5.0).select("image_id", "y", "x", _r("value"))


#: The gaps of a mosaic are wider than the ball, so each image's part is what it is alone.
@query(sql("p0", f"SELECT CAST(image_id//{MOSAIC} AS BIGINT) AS image_id, CAST(image_id%{MOSAIC}*{STRIDE}+y+{DOWN} AS INT) AS y, x, value FROM ({_ball_sql(5)})"))
def mosaic_background(spark, d):
    """background_rolling_ball over the borders of tiles."""
    return intensity.background_subtract(_mosaic(_plane(spark, d, 0)), None, 5.0).select("image_id", "y", "x", _r("value"))


def _tophat_sql(r: int) -> str:
    """Erosion, then dilation, each by windows: along each line as wide as the disk is there, then over the lines of a column."""
    wide = [max(dx for dx in range(r + 1) if dy * dy + dx * dx <= r * r) for dy in range(r + 1)]

    def step(f: str, among: str, table: str) -> str:
        line = ", ".join(f"{f}(v) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN {w} PRECEDING AND {w} FOLLOWING) AS w{w}" for w in sorted(set(wide)))
        near = ", ".join(f"{side}(w{wide[dy]}, {dy}) OVER c" for dy in range(1, r + 1) for side in ("lag", "lead"))
        return f"SELECT image_id, y, x, value, {among}(w{wide[0]}, {near}) AS v FROM (SELECT *, {line} FROM ({table})) WINDOW c AS (PARTITION BY image_id, x ORDER BY y)"

    eroded = step("min", "least", "SELECT *, value AS v FROM p0")
    return f"SELECT image_id, y, x, round(value-v, 6) AS value FROM ({step('max', 'greatest', eroded)})"


@query(sql("p0", _tophat_sql(2)))
def background_tophat(spark, d):
    return intensity.background_subtract(_plane(spark, d, 0), None, 2.0, "tophat").select("image_id", "y", "x", _r("value"))


@query(sql("pixels", "SELECT image_id, channel, z, y, x, CAST(coalesce(floor((value-lo)/nullif(hi-lo, 0)*255), 0) AS INT) AS value FROM pixels JOIN (SELECT image_id, channel, z, min(value) AS lo, max(value) AS hi FROM pixels GROUP BY ALL) USING (image_id, channel, z)"))
def rescale_uint8(spark, d):
    return intensity.rescale_uint8(fixtures.pixels(spark, d, False)).select("image_id", "channel", "z", "y", "x", "value")


@query(sql("pixels", "SELECT image_id, channel, round(CASE WHEN q>p THEN p ELSE a END, 6) AS lo, round(CASE WHEN q>p THEN q WHEN b>a THEN b ELSE a+1 END, 6) AS hi FROM (SELECT image_id, channel, quantile_cont(value, 0.01) AS p, quantile_cont(value, 0.995) AS q, min(value) AS a, max(value) AS b FROM pixels GROUP BY ALL)"))
def contrast_limits(spark, d):
    return intensity.contrast_limits(fixtures.pixels(spark, d)).select("image_id", "channel", _r("lo"), _r("hi"))


@query(sql("plane", "SELECT image_id, channel, y, x, round(greatest(0, least(1, (value-lo)/(CASE WHEN hi>lo THEN hi-lo ELSE 1 END))), 6) AS value FROM plane JOIN (SELECT image_id, channel, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM plane GROUP BY ALL) USING (image_id, channel)"))
def contrast_stretch(spark, d):
    return intensity.contrast_stretch(keep(_plane(spark, d), "plane")).select("image_id", "channel", "y", "x", _r("value"))


_FOCUS = """SELECT image_id, channel, z, coalesce(avg((4*value-h-v)*(4*value-h-v)), 0) AS score FROM (SELECT *, lag(value) OVER a + lead(value) OVER a AS h, lag(value) OVER b + lead(value) OVER b AS v FROM pixels
  WINDOW a AS (PARTITION BY image_id, channel, z, y ORDER BY x), b AS (PARTITION BY image_id, channel, z, x ORDER BY y)) GROUP BY ALL"""


@query(sql("pixels", f"SELECT image_id, channel, z, round(score, 6) AS score FROM ({_FOCUS})"))
def focus_score(spark, d):
    return intensity.focus_score(fixtures.pixels(spark, d)).withColumn("score", F.round("score", 6))


@query(sql("pixels", f"SELECT image_id, channel, CAST(z+1 AS INT) AS slice FROM (SELECT *, row_number() OVER (PARTITION BY image_id, channel ORDER BY score DESC, z) AS n FROM ({_FOCUS})) WHERE n=1"))
def sharpest_slice(spark, d):
    return intensity.sharpest_slice(fixtures.pixels(spark, d))


@query(sql("pixels", "SELECT image_id, CAST((max(z)+2)//2 AS INT) AS slice FROM pixels GROUP BY 1"))
def middle_slice(spark, d):
    return intensity.middle_slice(fixtures.pixels(spark, d))


@query(
    sql(
        "pixels, m",
        """SELECT image_id, channel, z, CAST(y-y0 AS INT) AS y, CAST(x-x0 AS INT) AS x, value FROM pixels JOIN (SELECT image_id,
        greatest(0, least(32-16, CAST(trunc(min(y)+(max(y)+1-min(y))/2-8) AS INT))) AS y0, greatest(0, least(32-16, CAST(trunc(min(x)+(max(x)+1-min(x))/2-8) AS INT))) AS x0 FROM m GROUP BY 1) USING (image_id)
        WHERE y BETWEEN y0 AND y0+15 AND x BETWEEN x0 AND x0+15""",
    )
)
def crop_around_roi(spark, d):
    px = fixtures.pixels(spark, d)
    return intensity.crop_around_roi(px, _mask(spark, d), frame_of(px), 8)


@query(sql("pixels", "SELECT image_id, channel, y, x, CAST(floor((value-lo)/(hi-lo)*255) AS INT) AS value FROM pixels JOIN (SELECT image_id, channel, min(value) AS lo, max(value) AS hi FROM pixels WHERE z=1 GROUP BY ALL) USING (image_id, channel) WHERE z=1"))
def extract_slice(spark, d):
    return intensity.extract_slice(fixtures.pixels(spark, d, False), 2).select("image_id", "channel", "y", "x", "value")


# ---- D: segmentation -------------------------------------------------------------------------


def _thresholds(spark, d, method):
    pl = keep(_plane(spark, d), "plane")  # read for its range and its histogram; pixels pass by the ranges
    return segment.thresholds(pl, method).select("image_id", "channel", _r("threshold"))


@query(sql("otsu", "SELECT image_id, channel, round(threshold, 6) AS threshold FROM otsu"))
def threshold_otsu(spark, d):
    return _thresholds(spark, d, "otsu")


@query(
    sql(
        "hist",
        """SELECT image_id, channel, round(centre, 6) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_id, channel ORDER BY (p1*(1-p1))*(p1*(1-p1))/(q1*q2) DESC, bin) AS k FROM (
        SELECT *, sum(p) OVER u AS p1, sum(p*p) OVER u AS q1, sum(p*p) OVER a AS q2 FROM (SELECT *, n/sum(n) OVER (PARTITION BY image_id, channel) AS p FROM hist)
        WINDOW u AS (PARTITION BY image_id, channel ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY image_id, channel ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) WHERE bin<255) WHERE k=1""",
    )
)
def threshold_yen(spark, d):
    return _thresholds(spark, d, "yen")


@query(
    sql(
        "hist",
        """SELECT image_id, channel, round(centre, 6) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_id, channel ORDER BY top/sqrt(top*top+width*width)*x-width/sqrt(top*top+width*width)*n DESC, x) AS k FROM (
        SELECT *, CASE WHEN peak-low<high-peak THEN high-bin ELSE bin-low END AS x, CASE WHEN peak-low<high-peak THEN high-peak ELSE peak-low END AS width FROM (
        SELECT *, first(bin) OVER (PARTITION BY image_id, channel ORDER BY n DESC, bin) AS peak, CAST(max(n) OVER g AS DOUBLE) AS top, min(bin) FILTER (n>0) OVER g AS low, max(bin) FILTER (n>0) OVER g AS high
        FROM hist WINDOW g AS (PARTITION BY image_id, channel))) WHERE x>=0 AND x<width) WHERE k=1""",
    )
)
def threshold_triangle(spark, d):
    return _thresholds(spark, d, "triangle")


@query(sql("sums", "SELECT image_id, channel, round(min(centre), 6) AS threshold FROM sums WHERE (s1/w1+s2/w2)/2-centre >= 0 AND (s1/w1+s2/w2)/2-centre < (hi-lo)/256 GROUP BY ALL"))
def threshold_isodata(spark, d):
    return _thresholds(spark, d, "isodata")


@query(sql("li, rng", "SELECT image_id, channel, round(lo+arg_max(t, k), 6) AS threshold FROM li JOIN rng USING (image_id, channel) GROUP BY image_id, channel, lo"))
def threshold_li(spark, d):
    return _thresholds(spark, d, "li")


_SMALL = "SELECT image_id, y, x FROM cc4 JOIN (SELECT image_id, s FROM cc4 GROUP BY ALL HAVING count(*) > 5) USING (image_id, s)"


@query(sql("cc4", _SMALL))
def auto_threshold(spark, d):
    return segment.auto_threshold(fixtures.pixels(spark, d), 0, "otsu", "max", 5).drop("channel")


@query(sql("cc4", _SMALL.replace("> 5", "> 60")))
def remove_small_objects(spark, d):
    return segment.remove_small_objects(_mask(spark, d), 60)


@query(sql("lab", "SELECT * FROM lab"))
def connected_components(spark, d):
    return _labels(spark, d)


@query(sql("ccm", "SELECT image_id, y, x, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY s) AS INT) AS label FROM ccm"))
def mosaic_components(spark, d):
    """connected_components over the borders of tiles."""
    return segment.connected_components(_mosaic(_mask(spark, d)), 8)


@query(sql("dist", "SELECT * FROM dist"))
def distance_transform(spark, d):
    return segment.distance_transform(_mask(spark, d), frame_of(fixtures.pixels(spark, d)))


@query(sql("peaks", "SELECT * FROM peaks"))
def local_peaks(spark, d):
    return segment.local_peaks(_mask(spark, d), frame_of(fixtures.pixels(spark, d)), SPACING)


@query(sql("forest, nodes", "SELECT image_id, y, x, CAST(-part[i] AS INT) AS label FROM (SELECT image_id, arg_max(part, k) AS part FROM forest GROUP BY 1) JOIN nodes USING (image_id) WHERE part[i]<0"))
def watershed_split(spark, d):
    return segment.watershed_split(_mask(spark, d), frame_of(fixtures.pixels(spark, d)), SPACING)


@query(sql("filled", "SELECT * FROM filled"))
def fill_holes(spark, d):
    return segment.fill_holes(_mask(spark, d), frame_of(fixtures.pixels(spark, d)))


@query(sql("bfilled", "SELECT image_id, y, x FROM bfilled"))
def extract_roi(spark, d):
    return segment.extract_roi(fixtures.pixels(spark, d), 0, 2.0)


@query(sql("roi", "SELECT * FROM roi"))
def rasterize_polygons(spark, d):
    return _roi(spark, d)


@query(sql("vertices, frame", "SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT image_id, min(vrow) AS t, max(vrow) AS b, min(vcol) AS l, max(vcol) AS r FROM vertices GROUP BY 1) CROSS JOIN (SELECT range AS y FROM range(32)) CROSS JOIN (SELECT range AS x FROM range(32)) WHERE y>=t AND y<b AND x>=l AND x<r"))
def rasterize_bbox(spark, d):
    box = fixtures.roi_vertices(spark, d).groupBy("image_id").agg(F.min("vrow").alias("top"), F.min("vcol").alias("left"), F.max("vrow").alias("bottom"), F.max("vcol").alias("right"))
    return segment.rasterize_bbox(box, frame_of(fixtures.pixels(spark, d)))


@query(sql("pixels", "SELECT image_id, y, x FROM pixels WHERE z=0 AND channel=0 AND value>0"))
def mask_from_image(spark, d):
    return segment.mask_from_image(fixtures.pixels(spark, d))


@query(sql("m, frame", "SELECT f.image_id, f.y, f.x FROM (SELECT image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM frame CROSS JOIN (SELECT range AS y FROM range(48)) CROSS JOIN (SELECT range AS x FROM range(20))) f JOIN m ON m.image_id=f.image_id AND m.y=CAST(floor((f.y+0.5)*32/48) AS INT) AND m.x=CAST(floor((f.x+0.5)*32/20) AS INT)"))
def resize_mask(spark, d):
    own = frame_of(fixtures.pixels(spark, d))
    return segment.resize_mask(_mask(spark, d), own, own.withColumns({"height": F.lit(48), "width": F.lit(20)}))


@query(
    sql(
        "ccf, shapef",
        """SELECT image_id, y, x FROM ccf SEMI JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ok DESC, round(CASE WHEN ok THEN area_px*circularity ELSE area_px END, 9) DESC, s) AS n
        FROM (SELECT *, area_px>=40 AND circularity>=0.1 AS ok FROM shapef)) WHERE n=1) b USING (image_id, s)""",
    )
)
def best_component_roi(spark, d):
    return segment.best_component_roi(fixtures.class_image(spark, d).drop("label"), 0.5, 40, 0.1)


@query(
    sql(
        "ccc, shapec",
        """SELECT image_id, label, y, x FROM ccc SEMI JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY round(area_px/top*circularity, 9) DESC, s) AS n
        FROM (SELECT *, max(area_px) OVER (PARTITION BY image_id, label) AS top FROM shapec)) WHERE n=1) b USING (image_id, label, s)""",
    )
)
def best_part_roi(spark, d):
    return segment.best_part_roi(fixtures.class_image(spark, d).drop("prob"))


_HOLE = """SELECT image_id, label, s FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(circularity, 9) DESC, label) AS k FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY area_px DESC, s) AS n FROM shapec) WHERE n=1 AND area_px>=40 AND perimeter_px>0 AND circularity>=0.1) WHERE k=1"""


@query(sql("ccc, shapec", f"SELECT image_id, CASE WHEN c.label=h.label AND c.s=h.s THEN 'hole' ELSE 'background' END AS kind, y, x FROM ccc c JOIN ({_HOLE}) h USING (image_id)"))
def hole_background_roi(spark, d):
    return segment.hole_background_roi(fixtures.class_image(spark, d).drop("prob"), 40, 0.1)


@query(sql("classes", "SELECT image_id, label, y, x FROM classes WHERE label BETWEEN 1 AND 2"))
def class_masks(spark, d):
    return segment.class_masks(fixtures.class_image(spark, d), 2)


_GROWN = "SELECT DISTINCT image_id, label, CAST(y+dy AS INT) AS y, CAST(x+dx AS INT) AS x FROM lab CROSS JOIN (SELECT a.range AS dy, b.range AS dx FROM range(-2, 3) a, range(-2, 3) b WHERE abs(a.range)+abs(b.range)<=2) WHERE y+dy BETWEEN 0 AND 31 AND x+dx BETWEEN 0 AND 31"


@query(sql("lab", _GROWN))
def dilate_mask(spark, d):
    return segment.dilate_mask(_labels(spark, d), 1.0, fixtures.images(spark, d), frame_of(fixtures.pixels(spark, d)))


@query(sql("m, frame", "SELECT image_id, round(count(m.y)/1024*100, 6) AS coverage FROM frame LEFT JOIN m USING (image_id) GROUP BY 1"))
def mask_coverage(spark, d):
    return segment.mask_coverage(_mask(spark, d), frame_of(fixtures.pixels(spark, d))).withColumn("coverage", F.round("coverage", 6))


# ---- E: measurements -------------------------------------------------------------------------


@query(sql("lab, roi", "SELECT * FROM lab SEMI JOIN roi USING (image_id, y, x)"))
def apply_roi(spark, d):
    return measure.apply_roi(_labels(spark, d), _roi(spark, d))


@query(sql("stats", 'SELECT image_id, label, area_px, round(mean_intensity, 6) AS mean_intensity, max_intensity, min_intensity, round(centroid_row, 6) AS centroid_row, round(centroid_col, 6) AS centroid_col, "top", "left", bottom, "right" FROM stats'))
def particle_stats(spark, d):
    got = measure.particle_stats(_labels(spark, d), _plane(spark, d, 0).drop("channel"))
    return got.withColumns({c: F.round(c, 6) for c in ("mean_intensity", "centroid_row", "centroid_col")})


@query(sql("shape", "SELECT image_id, label, round(perimeter_px, 6) AS perimeter_px FROM shape"))
def particle_perimeter(spark, d):
    return measure.particle_perimeter(_labels(spark, d)).withColumn("perimeter_px", F.round("perimeter_px", 6))


@query(sql("shape", "SELECT image_id, label, round(circularity, 6) AS circularity FROM shape"))
def particle_circularity(spark, d):
    lab = _labels(spark, d)
    area = lab.groupBy("image_id", "label").agg(F.count("*").alias("area_px"))
    return measure.particle_circularity(area.join(measure.particle_perimeter(lab), ["image_id", "label"])).select("image_id", "label", _r("circularity"))


_MOMENTS = """SELECT image_id, label, CASE WHEN (a+c)/2+r<=0 THEN 0 ELSE sqrt(greatest(0, 1-((a+c)/2-r)/((a+c)/2+r))) END AS eccentricity FROM (SELECT *, sqrt(((a-c)/2)*((a-c)/2)+b*b) AS r FROM (
  SELECT image_id, label, sum(y*y)/count(*)-(sum(y)/count(*))*(sum(y)/count(*))+1/12 AS a, sum(x*x)/count(*)-(sum(x)/count(*))*(sum(x)/count(*))+1/12 AS c, sum(y*x)/count(*)-sum(y)/count(*)*(sum(x)/count(*)) AS b FROM lab GROUP BY ALL))"""


@query(sql("lab", f"SELECT image_id, label, round(eccentricity, 5) AS eccentricity FROM ({_MOMENTS})"))
def particle_eccentricity(spark, d):
    return measure.particle_eccentricity(_labels(spark, d)).withColumn("eccentricity", F.round("eccentricity", 5))


@query(sql("hull, lab", "SELECT image_id, label, round(n/sum(floor(r+1e-9)-ceil(l-1e-9)+1), 6) AS solidity FROM hull JOIN (SELECT image_id, label, count(*) AS n FROM lab GROUP BY ALL) USING (image_id, label) GROUP BY image_id, label, n"))
def particle_solidity(spark, d):
    return measure.particle_solidity(_labels(spark, d)).withColumn("solidity", F.round("solidity", 6))


_SIZED = "SELECT image_id, label, area_px, area_px*0.25 AS area_um2, circularity FROM shape"


@query(sql("shape", f"SELECT image_id, label, area_px, CAST(area_um2 AS DOUBLE) AS area_um2 FROM ({_SIZED}) WHERE area_um2>=10 AND area_um2<=40 AND circularity>=0.5"))
def particle_filter(spark, d):
    lab = _labels(spark, d)
    area = lab.groupBy("image_id", "label").agg(F.count("*").alias("area_px"))
    got = measure.particle_circularity(area.join(measure.particle_perimeter(lab), ["image_id", "label"])).withColumn("area_um2", F.col("area_px") * 0.25)
    return measure.particle_filter(got, 10.0, 40.0, 0.5).select("image_id", "label", "area_px", "area_um2")


_PARTICLES = f"SELECT image_id, 'DAPI' AS channel, 'whole_image' AS roi_mask, '' AS roi_path, label, stats.area_px, CAST(stats.area_px*0.25 AS DOUBLE) AS area_um2, round(perimeter_px, 6) AS perimeter_px, round(circularity, 6) AS circularity, round(eccentricity, 5) AS eccentricity, round(mean_intensity, 6) AS mean_intensity, max_intensity, min_intensity, round(centroid_row, 6) AS centroid_row, round(centroid_col, 6) AS centroid_col FROM stats JOIN shape USING (image_id, label) JOIN ({_MOMENTS}) mo USING (image_id, label) WHERE stats.area_px*0.25>=2"


def _particles(spark, d):
    return measure.particle_analysis(fixtures.pixels(spark, d), _labels(spark, d), fixtures.images(spark, d), 0, min_size_um2=2.0)


@query(sql("stats, shape, lab", _PARTICLES))
def particle_analysis(spark, d):
    got = _particles(spark, d).drop("solidity").withColumn("eccentricity", F.round("eccentricity", 5))
    return got.withColumns({c: F.round(c, 6) for c in ("perimeter_px", "circularity", "mean_intensity", "centroid_row", "centroid_col")})


@query(sql("lab", "SELECT * FROM lab"))
def particle_fallback_labels(spark, d):
    return measure.fallback_labels(fixtures.pixels(spark, d), 0, _mask(spark, d).withColumn("label", F.lit(1)))


@query(sql("lab", "SELECT * FROM lab SEMI JOIN (SELECT image_id, label FROM lab GROUP BY ALL HAVING count(*)*0.25>=10) k USING (image_id, label)"))
def surviving_labels(spark, d):
    lab = _labels(spark, d)
    stats = lab.groupBy("image_id", "label").agg((F.count("*") * 0.25).alias("area_um2"))
    return measure.surviving_labels(lab, measure.particle_filter(stats, 10.0, 0.0))


@query(sql("p1, roi, frame", "SELECT image_id, 'GFP' AS channel, 'roi_diamond' AS roi_mask, 'd.roi' AS roi_path, round(coalesce(avg(value), 0), 6) AS mean_intensity, coalesce(sum(value), 0) AS sum_intensity, round(coalesce(stddev_pop(value), 0), 6) AS std_intensity, count(value) AS area_px, CAST(count(value)*0.25 AS DOUBLE) AS area_um2 FROM frame LEFT JOIN (SELECT * FROM p1 SEMI JOIN roi USING (image_id, y, x)) USING (image_id) GROUP BY image_id"))
def intensity_measurement(spark, d):
    got = measure.intensity_measurement(fixtures.pixels(spark, d), fixtures.images(spark, d), 1, "max", _roi(spark, d), "roi_diamond", "d.roi")
    return got.withColumns({c: F.round(c, 6) for c in ("mean_intensity", "std_intensity")})


_BOTH = "SELECT image_id, y, x, p0.value AS a, p1.value AS b, m.y IS NOT NULL AS i FROM p0 JOIN p1 USING (image_id, y, x) LEFT JOIN m USING (image_id, y, x)"


@query(sql("p0, p1, m", f"SELECT image_id, round(coalesce(sum(a) FILTER (i), 0)/(sum(a)+1e-10), 6) AS m1, round(coalesce(sum(b) FILTER (i), 0)/(sum(b)+1e-10), 6) AS m2 FROM ({_BOTH}) GROUP BY 1".replace("m.y IS", "m.image_id IS").replace("LEFT JOIN m USING", "LEFT JOIN m USING")))
def manders(spark, d):
    return measure.manders(_plane(spark, d, 0), _plane(spark, d, 1), _mask(spark, d)).select("image_id", _r("m1"), _r("m2"))


_R = "(sum(a*b)-sum(a)*sum(b)/count(*))/(sqrt(greatest(0, (sum(a*a)-sum(a)*sum(a)/count(*))*(sum(b*b)-sum(b)*sum(b)/count(*))))+1e-10)"


@query(sql("p0, p1", f"SELECT image_id, round({_R}, 6) AS r FROM (SELECT image_id, p0.value AS a, p1.value AS b FROM p0 JOIN p1 USING (image_id, y, x)) GROUP BY 1"))
def pearson(spark, d):
    return measure.pearson(_plane(spark, d, 0), _plane(spark, d, 1)).select("image_id", _r("r"))


@query(sql("noise", "SELECT image_id, CAST(63-x AS INT) AS y, y AS x, value FROM noise"))
def rotate90(spark, d):
    px = fixtures.noise_pixels(spark, d)
    return measure.rotate90(px.select("image_id", "y", "x", "value"), frame_of(px))


@query(
    sql(
        "noise",
        """SELECT f.image_id, round(m1, 6) AS m1, round(m2, 6) AS m2 FROM (SELECT image_id, max(y)+1 AS h FROM noise GROUP BY 1) f LEFT JOIN (
        SELECT a.image_id, coalesce(sum(a.value) FILTER (a.value>128), 0)/(sum(a.value)+1e-10) AS m1, coalesce(sum(b.value) FILTER (a.value>128), 0)/(sum(b.value)+1e-10) AS m2
        FROM noise a JOIN noise b ON a.image_id=b.image_id AND a.y=63-b.x AND a.x=b.y GROUP BY 1) r ON r.image_id=f.image_id AND h=64""",
    )
)
def manders_random(spark, d):
    px = fixtures.noise_pixels(spark, d)
    pl = px.select("image_id", "y", "x", "value")
    return measure.manders_random(pl, pl, pl.filter("value > 128"), frame_of(px)).select("image_id", _r("m1"), _r("m2"))


@query(
    sql(
        "lab, p1",
        f"""SELECT image_id, 'DAPI' AS primary_channel, 'GFP' AS secondary_channel, 'whole_image' AS roi_mask, label AS primary_label, CAST(count(*)*0.25 AS DOUBLE) AS primary_area_um2, count(*) FILTER (value>0) AS n_secondary_pixels,
        round(avg(value), 6) AS secondary_mean_intensity, max(value) AS secondary_max_intensity, round(count(*) FILTER (value>0)/count(*), 6) AS overlap_fraction FROM ({_GROWN}) g JOIN p1 USING (image_id, y, x) GROUP BY image_id, label""",
    )
)
def coloc_per_particle(spark, d):
    got = measure.coloc_per_particle(fixtures.pixels(spark, d), _labels(spark, d), fixtures.images(spark, d), 0, 1, 1.0)
    return got.withColumns({c: F.round(c, 6) for c in ("secondary_mean_intensity", "overlap_fraction")})


@query(
    sql(
        "lab, p0, p1, m",
        f"""SELECT image_id, 'DAPI' AS primary_channel, 'GFP' AS secondary_channel, 'whole_image' AS roi_mask, round(m1, 6) AS manders_m1, round(m2, 6) AS manders_m2, round(r, 6) AS pearson_r, round(m1r, 6) AS manders_m1_random, round(m2r, 6) AS manders_m2_random, n AS n_primary_particles
        FROM (SELECT image_id, sum(a) FILTER (i)/(sum(a)+1e-10) AS m1, sum(b) FILTER (i)/(sum(b)+1e-10) AS m2, {_R} AS r FROM ({_BOTH.replace("m.y IS", "m.image_id IS")}) GROUP BY 1)
        JOIN (SELECT image_id, sum(a) FILTER (i)/(sum(a)+1e-10) AS m1r, sum(b) FILTER (i)/(sum(b)+1e-10) AS m2r FROM (SELECT p0.image_id, p0.value AS a, p1.value AS b, m.image_id IS NOT NULL AS i
          FROM p0 JOIN p1 ON p0.image_id=p1.image_id AND p0.y=31-p1.x AND p0.x=p1.y LEFT JOIN m ON m.image_id=p0.image_id AND m.y=p0.y AND m.x=p0.x) GROUP BY 1) USING (image_id)
        JOIN (SELECT image_id, count(DISTINCT label) AS n FROM lab GROUP BY 1) USING (image_id)""",
    )
)
def coloc_global(spark, d):
    got = measure.coloc_global(fixtures.pixels(spark, d), _labels(spark, d), fixtures.images(spark, d), 0, 1)
    return got.withColumns({c: F.round(c, 6) for c in ("manders_m1", "manders_m2", "pearson_r", "manders_m1_random", "manders_m2_random")})


@query(sql("images, lab", "SELECT image_id, count(label) AS n_particles FROM images LEFT JOIN (SELECT image_id, label FROM lab GROUP BY ALL HAVING count(*)>100) USING (image_id) GROUP BY 1"))
def particles_per_image(spark, d):
    big = _labels(spark, d).groupBy("image_id", "label").count().filter("count > 100")
    return measure.particles_per_image(fixtures.images(spark, d), big)


@query(sql("stats", "SELECT image_id, label, round(centroid_row*0.5, 6) AS y_um, round(centroid_col*0.5, 6) AS x_um FROM stats"))
def centroids_um(spark, d):
    stats = measure.particle_stats(_labels(spark, d), _plane(spark, d, 0).drop("channel"))
    return measure.centroids_um(stats, fixtures.images(spark, d)).select("image_id", "label", _r("y_um"), _r("x_um"))


# ---- J: jobs ---------------------------------------------------------------------------------

#: The sample job with radii that fit the frames.
SPEC = {
    "name": "spots of two channels",
    "steps": [
        {"type": "BackgroundSubtraction", "channel": 0, "radius": 5.0},
        {"type": "BackgroundSubtraction", "channel": 1, "radius": 5.0},
        {"type": "GaussianBlur", "channel": 0, "sigma": 1.0},
        {"type": "GaussianBlur", "channel": 1, "sigma": 1.0},
        {"type": "ExtractROI", "channel": 0, "blur_sigma": 2.0, "method": "otsu"},
        {"type": "AutoThreshold", "channel": 0, "method": "otsu", "z_projection": "max", "min_size": 5},
        {"type": "WatershedSplit", "channel": 0, "min_distance": 3},
        {"type": "AutoThreshold", "channel": 1, "method": "otsu", "z_projection": "max", "min_size": 5},
        {"type": "WatershedSplit", "channel": 1, "min_distance": 3},
        {"type": "ParticleAnalysis", "channel": 0, "min_size_um2": 0.5, "roi_mask": "roi"},
        {"type": "ParticleAnalysis", "channel": 1, "min_size_um2": 0.2, "max_size_um2": 2000.0, "roi_mask": "roi"},
        {"type": "ColocalizationAnalysis", "primary_channel": 0, "secondary_channel": 1, "dilation_um": 0.5},
    ],
}
#: Steps that SQL can follow.
PLAIN = {
    "name": "plain",
    "steps": [
        {"type": "BrightnessContrast", "channel": 1, "min_val": 0.0, "max_val": 255.0},
        {"type": "AutoThreshold", "channel": 0, "method": "otsu", "z_projection": "max", "min_size": 5},
        {"type": "Normalize", "channel": 1, "method": "minmax", "enabled": False},
        {"type": "IntensityMeasurement", "channel": 1, "z_projection": "max", "roi_mask": "mask_ch0"},
    ],
}


def _frames(spark, d):
    return jobs.Frames(fixtures.pixels(spark, d), fixtures.images(spark, d))


@query(sql("p1, cc4, frame", f"SELECT image_id, 'GFP' AS channel, 'mask_ch0' AS roi_mask, round(coalesce(avg(value/255), 0), 6) AS mean_intensity, count(value) AS area_px FROM frame LEFT JOIN (SELECT * FROM p1 SEMI JOIN ({_SMALL}) k USING (image_id, y, x)) USING (image_id) GROUP BY 1"))
def run_pipeline(spark, d):
    done = jobs.run_pipeline(PLAIN, _frames(spark, d))
    return done.table("intensity_measurements").select("image_id", "channel", "roi_mask", _r("mean_intensity"), "area_px")


@query()
def run_sample_job(spark, d):
    """The sample job's twelve steps; its colocalization rows."""
    return jobs.run_pipeline(SPEC, _frames(spark, d)).table("colocalization_results")


@query(sql("p1, cc4, frame", f"SELECT 'ok' AS status, count(*) AS n_runs, count(*) AS n_rows, sum(total) AS total FROM (SELECT image_id, coalesce(sum(value), 0) AS total FROM frame LEFT JOIN (SELECT * FROM p1 SEMI JOIN ({_SMALL}) k USING (image_id, y, x)) USING (image_id) GROUP BY 1)"))
def batch_directory(spark, d):
    """A folder of bitmaps through a job, written and read back."""
    place = f"{folder(spark)}/batch/{uuid.uuid4().hex}"
    jobs.batch_directory(spark, {**PLAIN, "steps": [s for s in PLAIN["steps"] if s["type"] != "BrightnessContrast"]}, _bitmaps(spark, d, f"{place}/in"), f"{place}/out", "exp1")
    runs = results.read_results(spark, f"{place}/out", "pipeline_runs").groupBy("status").agg(F.count("*").alias("n_runs"))
    rows = results.read_results(spark, f"{place}/out", "intensity_measurements").agg(F.count("*").alias("n_rows"), F.sum("sum_intensity").alias("total"))
    return runs.join(rows)


@query(
    sql(
        "wells, resolved, plane, roi, frame",
        f"""SELECT well_id, field, label, image_id, round(avg(value), 6) AS mean_intensity, sum(value) AS sum_intensity, count(*) AS area_px
        FROM (SELECT well_id, field, label, fl_path, roi_path FROM resolved JOIN wells USING ({_W}, well_id) WHERE roi_path IS NOT NULL AND fl_path IS NOT NULL
          UNION ALL SELECT well_id, field, 'Whole image', fl_path, NULL FROM wells WHERE fl_path IS NOT NULL) p
        JOIN (SELECT path AS fl_path, image_id FROM ({_WELL_IMAGES})) wi USING (fl_path) JOIN (SELECT * FROM plane WHERE channel=0) pl USING (image_id)
        WHERE roi_path IS NULL OR (y>=8 AND y<24 AND x>=8) GROUP BY ALL""",
    )
)
def batch_wells(spark, d):
    plan = jobs.well_plan(_wells(spark, d), _resolved(spark, d), fixtures.roi_selections(spark))
    paths = _resolved(spark, d).filter("roi_path IS NOT NULL").select("roi_path").distinct()
    masks = paths.withColumn("y", F.explode(F.sequence(F.lit(8), F.lit(23)))).withColumn("x", F.explode(F.sequence(F.lit(8), F.lit(31))))
    got = jobs.batch_wells(fixtures.pixels(spark, d), _well_images(spark, d).select("path", "image_id"), plan, masks)
    return got.withColumn("mean_intensity", F.round("mean_intensity", 6))


@query(
    sql(
        "pixels, cc4, frame",
        f"""WITH_SUM SELECT step, type, image_id, CASE WHEN step=0 THEN 0 ELSE n END AS n_mask_pixels, round(total, 6) AS value_sum FROM (VALUES (0, 'BrightnessContrast'), (1, 'AutoThreshold'), (3, 'IntensityMeasurement')) AS s(step, type)
        CROSS JOIN (SELECT image_id, sum(CASE WHEN channel=1 THEN value/255 ELSE value END) AS total FROM pixels GROUP BY 1)
        JOIN (SELECT image_id, count(k.y) AS n FROM frame LEFT JOIN ({_SMALL}) k USING (image_id) GROUP BY 1) USING (image_id)""".replace("WITH_SUM ", ""),
    )
)
def step_trace(spark, d):
    return jobs.step_trace(PLAIN, _frames(spark, d)).withColumn("value_sum", F.round("value_sum", 6))


@query(sql("p0", "SELECT image_id, channel, y, x, value*2 AS value FROM (SELECT image_id, 0 AS channel, y, x, value FROM p0) WHERE value*2>100"))
def register_step(spark, d):
    """A step of the user's own."""

    @jobs.register_step("Doubled")
    def doubled(f: jobs.Frames, channel: int, least: float = 0.0) -> jobs.Frames:
        return jobs.replace(f, px=f.px.filter(F.col("channel") == channel).withColumn("value", F.col("value") * 2).filter(F.col("value") > least))

    done = jobs.run_pipeline({"steps": [{"type": "ZProjection", "method": "max"}, {"type": "Doubled", "channel": 0, "least": 100.0}]}, _frames(spark, d))
    return done.px.select("image_id", "channel", "y", "x", "value")


@query(sql("images", "SELECT image_id, 0 AS \"primary\", 1 AS secondary FROM images"))
def channel_pairs(spark, d):
    return measure.channel_pairs(fixtures.images(spark, d))
