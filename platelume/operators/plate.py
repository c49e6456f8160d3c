"""Well plates: pairing of acquisition files, and assignment of ROI files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import basename, extension, select_files, stem

#: The well coordinate in a file name, with and without a serial number.
WELL = r"_([A-Pa-p])(\d{1,2})-(\d+)_(\d+)$"
WELL_LOOSE = r"_([A-Pa-p])(\d{1,2})-(\d+)"
KEY = ["row", "col", "field"]


def _coordinates(path: Column, pattern: str, n: int) -> Column:
    parts = [F.regexp_extract(stem(path), pattern, i) for i in range(1, n + 1)]
    return F.when(stem(path).rlike(pattern), F.struct(F.upper(parts[0]).alias("row"), *[p.try_cast("int").alias(k) for p, k in zip(parts[1:], ("col", "field", "serial"), strict=False)]))


def parse_well_names(files: DataFrame, ext: str = ".vsi", contains: str = "") -> DataFrame:
    """files (path) -> (path, row, col, field, serial) of those whose name ends in a well coordinate."""
    own = select_files(files, [ext], contains).withColumn("w", _coordinates(F.col("path"), WELL, 4)).filter("w IS NOT NULL")
    return own.select("path", "w.row", "w.col", "w.field", "w.serial")


def pair_wells_by_serial(parsed: DataFrame) -> DataFrame:
    """The lowest serial of a well and field is brightfield, the next fluorescence, the others extras; ties go by path."""
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("serial", "path"))
    pick = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c)))
    wells = parsed.withColumn("n", nth).groupBy(*KEY).agg(
        pick(1, "path").alias("bf_path"),
        pick(2, "path").alias("fl_path"),
        pick(1, "serial").alias("bf_serial"),
        pick(2, "serial").alias("fl_serial"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("n") > 2, F.struct("n", "path")))), lambda s: s["path"]).alias("extra_paths"),
    )
    return wells.withColumns({"well_id": F.concat("row", F.col("col").cast("string")), "is_complete": F.col("fl_path").isNotNull()})


def pair_by_suffix(files: DataFrame, ext: str = ".vsi", bf: str = "00001", fl: str = "00002") -> DataFrame:
    """(well_key, bf_path, fl_path, status): the name before _{suffix}{ext} is the key; status says what is missing."""
    name = basename(F.col("path"))

    def side(suffix: str, out: str) -> DataFrame:
        end = f"_{suffix}{ext}"
        own = files.filter(name.endswith(end))
        return own.groupBy(F.expr(f"left(element_at(split(path, '/'), -1), length(element_at(split(path, '/'), -1)) - {len(end)})").alias("well_key")).agg(F.max("path").alias(out))

    both = side(bf, "bf_path").join(side(fl, "fl_path"), "well_key", "full_outer")
    return both.withColumn("status", F.when(F.col("bf_path").isNull(), "no brightfield").when(F.col("fl_path").isNull(), "no fluorescence").otherwise("paired"))


def classify_roi(path: Column) -> Column:
    return F.when(stem(path).endswith("_hole"), "hole").when(stem(path).endswith("_background"), "background").otherwise("existing")


def assign_rois_to_wells(wells: DataFrame, files: DataFrame, roi_dirs: tuple[str, ...] = ("/out/rois",), contains: str = "") -> DataFrame:
    """(row, col, field, well_id, roi_path, kind, ord): ROI files by coordinate, the strict pattern before the loose one.

    ord is their order in a well: .roi, then .zip of the plate; then each folder of roi_dirs, by extension and path.
    Files of these folders may be .tif as well. Files without a well are dropped.
    """
    ext, folder = extension(F.col("path")), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    place = F.when(folder.isin(list(roi_dirs)), F.array_position(F.array(*map(F.lit, roi_dirs)), folder)).otherwise(F.lit(0)).cast("int")
    kinds = F.array(*map(F.lit, (".roi", ".zip", ".tif", ".tiff")))
    own = files.withColumns({"place": place, "by": F.array_position(kinds, ext).cast("int")}).filter((F.col("by") > 0) & ((F.col("place") > 0) | (F.col("by") <= 2)))
    if contains:
        own = own.filter(basename(F.col("path")).contains(contains))
    strict, loose = _coordinates(F.col("path"), WELL, 4), _coordinates(F.col("path"), WELL_LOOSE, 3)
    own = own.withColumns({k: F.coalesce(strict[k], loose[k]) for k in KEY}).filter("row IS NOT NULL")
    found = wells.select(*KEY, "well_id").join(own, KEY).withColumn("ord", F.row_number().over(Window.partitionBy(*KEY).orderBy("place", "by", "path")))
    return found.select(*KEY, "well_id", F.col("path").alias("roi_path"), classify_roi(F.col("path")).alias("kind"), "ord")


#: The kind of ROI file that a per-well selection asks for.
KINDS = {"well_hole": "hole", "well_existing": "existing", "well_background": "background"}


def resolve_well_roi(wells: DataFrame, rois: DataFrame, selections: DataFrame) -> DataFrame:
    """(well, label, source, roi_path): for each well and per-well selection its first fitting ROI file, or null.

    selections is what a user has chosen, a handful of rows.
    """
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("source")]
    asked = selections.withColumn("kind", kind).filter("kind IS NOT NULL")
    listed = asked.agg(F.collect_list(F.struct("label", "source", "existing_tag", "kind")).alias("s"))
    each = wells.select(*KEY, "well_id").join(F.broadcast(listed)).select("*", F.explode("s").alias("sel")).select(*KEY, "well_id", "sel.*")
    tag = F.when(F.col("source") == "well_existing", F.lower("existing_tag")).otherwise("")
    fits = (tag == "") | F.contains(F.lower(stem(F.col("roi_path"))), tag)
    found = each.join(rois.select(*KEY, "kind", "roi_path", "ord"), [*KEY, "kind"], "left")
    first = F.min(F.when(fits & F.col("roi_path").isNotNull(), F.struct("ord", "roi_path")))
    return found.groupBy(*KEY, "well_id", "label", "source").agg(first.alias("f")).select(*KEY, "well_id", "label", "source", F.col("f.roi_path").alias("roi_path"))


def wells_missing_roi(wells: DataFrame, rois: DataFrame, kinds: tuple[str, ...] = ("hole", "background")) -> DataFrame:
    """(well, kind): the wells that lack an ROI file of a kind, which has to be made; others reuse theirs."""
    each = wells.select(*KEY, "well_id", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    return each.join(rois.select(*KEY, "kind"), [*KEY, "kind"], "left_anti").select(*KEY, "well_id", "kind")


def missing_roi_summary(resolved: DataFrame, wells: DataFrame) -> DataFrame:
    """(label, n_missing, n_wells), over wells with a fluorescence image."""
    fl = wells.filter("fl_path IS NOT NULL").select(*KEY)
    out = resolved.join(fl, KEY, "left_semi").groupBy("label").agg(F.count_if(F.col("roi_path").isNull()).alias("n_missing"), F.count("*").alias("n_wells"))
    return out.filter("n_missing > 0")


def plate_grid(spark: SparkSession, wells: DataFrame, rois: DataFrame) -> DataFrame:
    """The 16 x 24 positions: empty, complete or bf_only, and has_roi; a position's highest field counts."""
    cells = spark.range(16 * 24).select(F.expr("chr(65 + CAST(id DIV 24 AS INT))").alias("row"), (F.col("id") % 24 + 1).cast("int").alias("col"))
    some = rois.select(*KEY).distinct().withColumn("has", F.lit(True))
    own = wells.join(some, KEY, "left").groupBy("row", "col").agg(F.max(F.struct("field", F.col("is_complete"), F.coalesce("has", F.lit(False)).alias("has"))).alias("s"))
    status = F.when(F.col("s").isNull(), "empty").when(F.col("s.is_complete"), "complete").otherwise("bf_only")
    return cells.join(own, ["row", "col"], "left").select("row", "col", status.alias("status"), F.coalesce("s.has", F.lit(False)).alias("has_roi"))


def plate_summary(wells: DataFrame, rois: DataFrame) -> DataFrame:
    own = wells.join(rois.select(*KEY).distinct().withColumn("has", F.lit(True)), KEY, "left")
    return own.agg(F.count("*").alias("n_wells"), F.count_if("is_complete").alias("n_complete"), F.count_if(~F.col("is_complete")).alias("n_incomplete"), F.count_if("has").alias("n_with_roi"))


def _token(name: Column, n: int) -> Column:
    return F.regexp_replace(F.get(F.split(name, "_"), F.lit(n)), r"\.[^.]*$", "")


def roi_name_map(images: DataFrame, rois: DataFrame, pos_img: int, pos_roi: int, prefix: str = "") -> DataFrame:
    """(roi_path, well, new_name): ROI and image files with the same name part belong together; the ROI's last part becomes the well, with the prefix before."""
    img = images.select(_token(basename(F.col("path")), pos_img).alias("well")).filter("well IS NOT NULL").distinct()
    roi = rois.filter(extension(F.col("path")) == ".roi").select(F.col("path").alias("roi_path"), _token(basename(F.col("path")), pos_roi).alias("well"))
    last = F.regexp_replace(basename(F.col("roi_path")), r"[^_]*$", "")
    return roi.join(img, "well").select("roi_path", "well", F.concat(F.lit(prefix), last, F.col("well"), F.lit(".roi")).alias("new_name"))


def renumber_roi(rois: DataFrame, old: str = "00001.roi", new: str = "00002.roi") -> DataFrame:
    name = basename(F.col("path"))
    return rois.filter(name.endswith(old)).select(F.col("path").alias("roi_path"), F.replace(name, F.lit(old), F.lit(new)).alias("new_name"))


def output_path(path: Column, source: str, target: str, keep_folders: bool = True) -> Column:
    return F.replace(path, F.lit(source), F.lit(target)) if keep_folders else F.concat(F.lit(target + "/"), basename(path))


def roi_mask_key(label: Column, source: Column) -> Column:
    slug = F.regexp_replace(F.replace(F.lower(label), F.lit(" "), F.lit("_")), "[^a-z0-9_]", "")
    return F.when(source == "whole", "").when(slug == "", "roi").otherwise(F.concat(F.lit("roi_"), slug))


def read_well(wells: DataFrame, images: DataFrame, px: DataFrame, bf: bool = True, fl: bool = True) -> DataFrame:
    """(row, col, field, role, image_id, channel, z, y, x, value); either image may be absent, then its columns are null."""
    roles = [F.struct(F.lit(r).alias("role"), F.col(f"{r}_path").alias("path")) for r, on in (("bf", bf), ("fl", fl)) if on]
    each = wells.select(*KEY, F.explode(F.array(*roles)).alias("s")).select(*KEY, "s.role", "s.path")
    return each.join(images.select("path", "image_id"), "path", "left").join(px, "image_id", "left").select(*KEY, "role", "image_id", "channel", "z", "y", "x", "value")


def roi_filename(row: Column, col: Column, field: Column, kind: str, ext: str = ".roi") -> Column:
    return F.concat(F.lit("_"), row, col.cast("string"), F.lit("-"), field.cast("string"), F.lit(f"_{kind}{ext}"))


def detected_selections(selections: DataFrame, rois: DataFrame) -> DataFrame:
    """selections with one file-based row a detected ROI file, in place of the file-based ones that were there."""
    kept = selections.filter("source <> 'file'").select("label", "source", F.lit("").alias("path"))
    return kept.unionByName(rois.select(stem(F.col("roi_path")).alias("label"), F.lit("file").alias("source"), F.col("roi_path").alias("path")))
