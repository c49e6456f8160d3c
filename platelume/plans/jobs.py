"""Analysis jobs: an ordered list of named steps over all images at once, and batches of it."""

from __future__ import annotations

import inspect
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.neighbours import frame_of
from ..functions.scratch import apart, beside, keep, keep_pixels, passing
from ..operators import intensity, measure, segment
from ..sources import files, results


@dataclass
class Frames:
    """What steps read and change. masks: label tables (image_id, label, y, x) by key; the latest writer of a key wins."""

    px: DataFrame
    images: DataFrame
    masks: dict[str, DataFrame] = field(default_factory=dict)
    paths: dict[str, str] = field(default_factory=dict)
    rois: DataFrame | None = None
    prob: DataFrame | None = None
    tables: dict[str, list[DataFrame]] = field(default_factory=dict)
    changed: bool = False
    known: dict[object, tuple[DataFrame, DataFrame]] = field(default_factory=dict)

    def settled(self) -> Frames:
        """Changed pixels are written once, before the first step that reads them more than once."""
        return replace(self, px=keep_pixels(self.px), changed=False) if self.changed else self

    def once(self, name: object, make: Callable[[], DataFrame]) -> DataFrame:
        """make() of these very pixels, worked out for the first step that asks; known has it beside the pixels that it is of."""
        if name not in self.known or self.known[name][0] is not self.px:
            self.known[name] = (self.px, make())
        return self.known[name][1]

    def sizes(self) -> DataFrame:
        return self.once("sizes", lambda: beside(keep(frame_of(self.px), "sizes")))

    def plane(self, channel: int, projection: str) -> DataFrame:
        """A channel's projection, which operators on pixels take as it is; -1: of all channels."""
        pl = self.once((channel, projection), lambda: keep(intensity.z_project(self.px, projection, channel), "plane"))
        return pl if channel == -1 else pl.withColumn("channel", F.lit(channel).cast(pl.schema["channel"].dataType))

    def mask(self, key: str) -> DataFrame:
        if key not in self.masks:
            raise KeyError(f"no mask {key!r}; there are {', '.join(sorted(self.masks)) or 'none'}")
        return self.masks[key]

    def roi(self, key: str) -> DataFrame | None:
        return self.mask(key).select("image_id", "y", "x") if key else None

    def with_mask(self, key: str, lab: DataFrame, path: str = "") -> Frames:
        return replace(self, masks={**self.masks, key: keep_pixels(lab)}, paths={**self.paths, key: path})

    def with_rows(self, table: str, rows: DataFrame) -> Frames:
        return replace(self, tables={**self.tables, table: [*self.tables.get(table, []), rows]})

    def table(self, name: str) -> DataFrame | None:
        parts = self.tables.get(name, [])
        out = parts[0] if parts else None
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


Step = Callable[..., Frames]
STEPS: dict[str, Step] = {}


def register_step(name: str) -> Callable[[Step], Step]:
    """Makes fn(frames, **params) -> Frames a step that job specs can name."""

    def put(fn: Step) -> Step:
        STEPS[name] = fn
        return fn

    return put


def _single(mask: DataFrame) -> DataFrame:
    return mask.select("image_id", F.lit(1).alias("label"), "y", "x")


@register_step("BackgroundSubtraction")
def _background(f: Frames, channel: int, radius: float = 50.0, method: str = "rolling_ball") -> Frames:
    return replace(f, px=intensity.background_subtract(f.px, channel, radius, method), changed=True)


@register_step("GaussianBlur")
def _blur(f: Frames, channel: int, sigma: float = 2.0) -> Frames:
    return replace(f, px=intensity.gaussian_blur(f.px, channel, sigma), changed=True)


@register_step("Normalize")
def _normalize(f: Frames, channel: int, method: str = "minmax", low_pct: float = 1.0, high_pct: float = 99.0) -> Frames:
    return replace(f, px=intensity.normalize(f.px, channel, method, low_pct, high_pct), changed=True)


@register_step("BrightnessContrast")
def _contrast(f: Frames, channel: int, min_val: float = 0.0, max_val: float = 65535.0) -> Frames:
    return replace(f, px=intensity.brightness_contrast(f.px, channel, min_val, max_val), changed=True)


@register_step("ZProjection")
def _project(f: Frames, channel: int = -1, method: str = "min") -> Frames:
    f = f.settled()
    flat = intensity.z_project(f.px, method, None if channel == -1 else channel).withColumn("z", F.lit(0)).select(*f.px.columns)
    return replace(f, px=flat if channel == -1 else f.px.filter(F.col("channel") != channel).unionByName(flat))


@register_step("AutoThreshold")
def _threshold(f: Frames, channel: int, method: str = "otsu", z_projection: str = "max", min_size: int = 50) -> Frames:
    f = f.settled()
    return f.with_mask(f"mask_ch{channel}", _single(segment.threshold_mask(f.plane(channel, z_projection), method, min_size)))


@register_step("WatershedSplit")
def _watershed(f: Frames, channel: int, min_distance: int = 5) -> Frames:
    f = f.settled()
    own = f.mask(f"mask_ch{channel}").select("image_id", "y", "x")
    return f.with_mask(f"mask_ch{channel}", segment.watershed_split(own, f.sizes(), min_distance).select("image_id", "label", "y", "x"))


@register_step("ExtractROI")
def _extract(f: Frames, channel: int, blur_sigma: float = 20.0, method: str = "otsu", roi_name: str = "roi") -> Frames:
    f = f.settled()
    return f.with_mask(roi_name, _single(segment.extract_roi(f.plane(channel, "max"), channel, blur_sigma, method, f.sizes())))


@register_step("LoadROI")
def _load(f: Frames, path: str, roi_name: str = "roi") -> Frames:
    f = f.settled()
    if f.rois is None:
        raise KeyError("the job has no table of regions")
    own = f.rois.filter(F.col("path") == path) if "path" in f.rois.columns else f.rois
    return f.with_mask(roi_name, _single(segment.rasterize_polygons(own, f.sizes())), path)


@register_step("ProbabilityROI")
def _probability(f: Frames, roi_name: str = "roi", threshold: float = 0.5, min_area_px: int = 500, min_circularity: float = 0.1) -> Frames:
    if f.prob is None:
        raise KeyError("the job has no table of probabilities")
    return f.with_mask(roi_name, _single(segment.best_component_roi(f.prob, threshold, min_area_px, min_circularity)))


@register_step("ParticleAnalysis")
def _particles(f: Frames, channel: int, min_size_um2: float = 0.5, max_size_um2: float = 5000.0, min_circularity: float = 0.0, z_projection: str = "max", roi_mask: str = "") -> Frames:
    f = f.settled()
    # several measures read the labels inside the region, so they are worked out once
    pl = f.plane(channel, z_projection)
    lab = keep_pixels(measure.apply_roi(measure.fallback_labels(pl, channel, f.masks.get(f"mask_ch{channel}"), z_projection), f.roi(roi_mask)))
    rows = keep_pixels(measure.particle_analysis(pl, lab, f.images, channel, None, roi_mask, f.paths.get(roi_mask, ""), min_size_um2, max_size_um2, min_circularity, z_projection))
    key = f"particles_ch{channel}"
    f = f.with_rows("particle_measurements", rows).with_mask(key, measure.surviving_labels(lab, rows))
    return replace(f, masks={**f.masks, f"{key}/{roi_mask}": f.masks[key]}, paths={**f.paths, f"{key}/{roi_mask}": ""})


@register_step("IntensityMeasurement")
def _intensity(f: Frames, channel: int, z_projection: str = "max", roi_mask: str = "") -> Frames:
    f = f.settled()
    return f.with_rows("intensity_measurements", measure.intensity_measurement(f.px, f.images, channel, z_projection, f.roi(roi_mask), roi_mask, f.paths.get(roi_mask, "")))


@register_step("ColocalizationAnalysis")
def _coloc(f: Frames, primary_channel: int, secondary_channel: int, dilation_um: float = 0.0, z_projection: str = "max", roi_mask: str = "") -> Frames:
    f = f.settled()
    key = f"particles_ch{primary_channel}"
    lab = f.masks.get(f"{key}/{roi_mask}") if roi_mask else None
    lab = f.mask(key) if lab is None else lab
    px = f.plane(primary_channel, z_projection)
    px = px if secondary_channel == primary_channel else px.unionByName(f.plane(secondary_channel, z_projection))
    each = measure.coloc_per_particle(px, lab, f.images, primary_channel, secondary_channel, dilation_um, z_projection, f.roi(roi_mask), roi_mask, f.sizes())
    whole = measure.coloc_global(px, lab, f.images, primary_channel, secondary_channel, z_projection, f.roi(roi_mask), roi_mask, f.sizes())
    return f.with_rows("colocalization_per_particle", each).with_rows("colocalization_results", whole)


def _params(step: dict) -> dict:
    return {k: v for k, v in step.items() if k not in ("type", "enabled")}


def check_spec(spec: dict | str) -> dict:
    """The spec, with its steps' names and parameters known to be right; the error names all that are wrong."""
    spec = json.loads(spec) if isinstance(spec, str) else spec
    if not isinstance(spec.get("steps"), list):
        raise ValueError("a job spec needs a list of steps")
    wrong = []
    for n, step in enumerate(spec["steps"]):
        kind = step.get("type")
        if kind not in STEPS:
            wrong.append(f"step {n}: unknown step {kind!r}; there are {', '.join(sorted(STEPS))}")
            continue
        try:
            inspect.signature(STEPS[kind]).bind(None, **_params(step))
        except TypeError as e:
            wrong.append(f"step {n}, {kind}: {e}")
    if wrong:
        raise ValueError("; ".join(wrong))
    return spec


def save_spec(spark: SparkSession, spec: dict, path: str) -> None:
    """spec as JSON in a folder of one text file, in place of what was there."""
    text = json.dumps(check_spec(spec), indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_spec(spark: SparkSession, path: str) -> dict:
    """The spec of a JSON file, or of a folder that save_spec wrote."""
    found = spark.read.text(path, wholetext=True).filter("trim(value) <> ''").head(2)
    if len(found) != 1:
        raise ValueError(f"{path} holds {'no' if not found else 'more than one'} job spec")
    return check_spec(found[0].value)


def run_pipeline(spec: dict | str, frames: Frames, trace: Callable[[int, str, Frames], None] | None = None) -> Frames:
    """The spec's steps in order; a later step sees what earlier ones made. Steps with "enabled": false are left out. A wrong spec fails before its first step."""
    spec, frames = check_spec(spec), replace(frames, known={})  # what a run has worked out is its own, and may go with it
    for n, step in enumerate(spec["steps"]):
        if step.get("enabled", True):
            frames = STEPS[step["type"]](frames, **_params(step))
            if trace:
                trace(n, step["type"], frames)
    return frames


def preview(spec: dict | str, frames: Frames, image_id: int, steps: int | None = None, z: int | None = None) -> Frames:
    """One image, or one slice of it, through the first steps of a job (all, if not said): only its rows are read, planned and written."""
    spec = check_spec(spec)
    one = lambda df: df.filter(F.col("image_id") == image_id) if df is not None and "image_id" in df.columns else df
    px = one(frames.px)
    px = px if z is None else px.filter(F.col("z") == z).withColumn("z", F.lit(0))
    own = replace(frames, px=px, images=one(frames.images), masks={k: one(m) for k, m in frames.masks.items()}, rois=one(frames.rois), prob=one(frames.prob))
    return run_pipeline({**spec, "steps": spec["steps"][:steps]}, own)


def step_trace(spec: dict | str, frames: Frames) -> DataFrame:
    """(step, type, image_id, n_mask_pixels, value_sum): what each step left, for a preview."""
    parts: list[DataFrame] = []

    def look(n: int, kind: str, f: Frames) -> None:
        px = f.px.groupBy("image_id").agg(F.sum("value").alias("value_sum"))
        out = px.withColumn("n", F.lit(0))
        for lab in {id(m): m for k, m in f.masks.items() if "/" not in k}.values():
            own = lab.groupBy("image_id").agg(F.count("*").alias("m"))
            out = out.join(own, "image_id", "left").withColumn("n", F.col("n") + F.coalesce("m", F.lit(0))).drop("m")
        parts.append(out.select(F.lit(n).alias("step"), F.lit(kind).alias("type"), "image_id", F.col("n").cast("long").alias("n_mask_pixels"), "value_sum"))

    run_pipeline(spec, frames, look)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def batch_directory(spark: SparkSession, spec: dict, root: str, out: str, experiment: str = "", export: bool = False) -> dict[str, DataFrame]:
    """The spec over all bitmaps under root: result tables and the run log are appended under out, and what was written is returned. Files that can't be read are logged as errors."""
    batch, names = f"folder-{uuid.uuid4().hex}", []

    def run() -> None:
        listed = files.scan_files(spark, root, list(files.BITMAPS))
        px = keep_pixels(files.read_bitmaps(spark, root).withColumn("image_id", F.xxhash64("path")))
        images = px.select("image_id", "path").distinct().withColumns({"channel_names": F.array().cast("array<string>"), "pixel_size_um": F.lit(1.0), "z_step_um": F.lit(1.0)})
        done = run_pipeline(spec, Frames(px.drop("path"), images))
        tables = {k: done.table(k) for k in done.tables}
        info = files.image_info(px.drop("path"), images).drop("channels")
        registered = results.register_images(images.select("path", "image_id"), info, experiment)
        failed = listed.withColumn("image_id", F.xxhash64("path")).join(images.select("image_id"), "image_id", "left_anti").select("image_id", F.concat(F.lit("not readable: "), "path").alias("error"))
        tables |= {"images": registered, "pipeline_runs": results.run_log(images, failed, spec.get("name", "pipeline"), json.dumps(spec))}
        results.write_results(tables, out, experiment, batch)
        if export:
            results.export_parquet(tables, f"{out}/export")
        names.extend(tables)

    passing(run)
    return {k: results.read_results(spark, out, k).filter(F.col("batch") == batch).drop("batch").select(*results.schema_names(k)) for k in names}


def well_plan(wells: DataFrame, resolved: DataFrame, selections: DataFrame) -> DataFrame:
    """(row, col, field, well_id, fl_path, label, source, roi_path) of what is to be measured: wells with fluorescence; per-well
    selections only where a file was found, and never unrestricted in its place."""
    key = ["row", "col", "field"]
    fl = wells.filter("fl_path IS NOT NULL").select(*key, "well_id", "fl_path")
    found = fl.join(resolved.filter("roi_path IS NOT NULL").select(*key, "label", "source", "roi_path"), key)
    fixed = selections.filter("source = 'whole'").select("label", "source")
    whole = fl.join(F.broadcast(fixed.agg(F.collect_list(F.struct("label", "source")).alias("s")))).select("*", F.explode("s").alias("sel"))
    whole = whole.select(*key, "well_id", "fl_path", "sel.label", "sel.source", F.lit(None).cast("string").alias("roi_path"))
    return found.select(*whole.columns).unionByName(whole)


def batch_wells(px: DataFrame, images: DataFrame, plan: DataFrame, roi_masks: DataFrame, channel: int = 0, projection: str = "max") -> DataFrame:
    """(well_id, label, image_id, mean_intensity, sum_intensity, area_px): all wells and regions in one pass, the region being a grouping column.

    roi_masks: (roi_path, y, x).
    """
    pl = intensity.z_project(px, projection, channel)
    asked = plan.join(images.select(F.col("path").alias("fl_path"), "image_id"), "fl_path")
    whole = pl.join(asked.filter("roi_path IS NULL").select("image_id", "well_id", "field", "label"), "image_id")
    part = asked.filter("roi_path IS NOT NULL").join(apart(roi_masks), "roi_path").select("image_id", "well_id", "field", "label", "y", "x")
    inside = pl.join(part, ["image_id", "y", "x"])
    both = whole.select("well_id", "field", "label", "image_id", "value").unionByName(inside.select("well_id", "field", "label", "image_id", "value"))
    return both.groupBy("well_id", "field", "label", "image_id").agg(F.avg("value").alias("mean_intensity"), F.sum("value").alias("sum_intensity"), F.count("*").alias("area_px"))
