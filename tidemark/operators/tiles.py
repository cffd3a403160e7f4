"""Tile catalogues: summaries of point cloud and raster files, one row per file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.diffing import change_type

SIDECAR = r"(?i)\.aux\.xml$"
#: Extensions of tile files (fixed values), longest first.
EXTENSIONS = r"(?i)(\.copc\.laz|\.copc\.las|\.laz|\.las|\.tiff|\.tif)$"


def is_sidecar(name: Column) -> Column:
    return name.rlike(SIDECAR)


def without_sidecars(tiles: DataFrame, name: str = "name") -> DataFrame:
    return tiles.filter(~is_sidecar(F.col(name)))


def tile_name(name: Column) -> Column:
    """File name without folder, sidecar suffix and extension."""
    base = F.element_at(F.split(name, "/"), -1)
    return F.regexp_replace(F.regexp_replace(base, SIDECAR, ""), EXTENSIONS, "")


def with_extension(name: Column, fmt: Column) -> Column:
    """File name with the extension its format calls for."""
    base = F.element_at(F.split(name, "/"), -1)
    plain = F.regexp_replace(F.regexp_replace(base, SIDECAR, ""), EXTENSIONS, "")
    raster = F.when(is_sidecar(base), ".tif.aux.xml").otherwise(".tif")
    cloud = F.concat(F.when(fmt.contains("copc"), ".copc.").otherwise("."), F.substring(fmt, 1, 3))
    return F.concat(plain, F.when(fmt.startswith("geotiff"), raster).otherwise(cloud))


def pointer_record(text: Column) -> Column:
    """``key value`` lines of a pointer file as a map."""
    lines = F.filter(F.split(text, "\n"), lambda ln: ln.contains(" "))
    return F.map_from_entries(
        F.transform(lines, lambda ln: F.struct(F.substring_index(ln, " ", 1).alias("key"), F.regexp_replace(ln, r"^\S+ ", "").alias("value")))
    )


def tile_summary(pointers: DataFrame, text: str = "pointer", keep: Sequence[str] = ()) -> DataFrame:
    """Summary row of each pointer record, its name given the proper extension."""
    rows = pointers.withColumn("_m", pointer_record(F.col(text)))
    m = F.col("_m")
    return rows.select(
        *keep,
        with_extension(m["name"], m["format"]).alias("name"),
        m["format"].alias("format"),
        m["oid"].alias("oid"),
        m["size"].cast("bigint").alias("size"),
        m["nativeExtent"].alias("native_extent"),
        m["crs84Extent"].alias("crs84_extent"),
    )


def native_box(extent: Column) -> Column:
    """2D box of ``minx,maxx,miny,maxy[,minz,maxz]`` or of polygon text."""
    numbers = F.split(extent, ",")
    plain = F.struct(
        numbers[0].cast("double").alias("minx"), numbers[2].cast("double").alias("miny"),
        numbers[1].cast("double").alias("maxx"), numbers[3].cast("double").alias("maxy"),
    )
    points = F.transform(F.split(F.regexp_replace(extent, r"[A-Za-z()]", ""), ","), lambda p: F.split(F.trim(p), r"\s+"))
    xs = F.transform(points, lambda p: F.get(p, F.lit(0)).try_cast("double"))
    ys = F.transform(points, lambda p: F.get(p, F.lit(1)).try_cast("double"))
    ring = F.struct(
        F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy")
    )
    return F.when(extent.startswith("POLYGON"), ring).otherwise(plain)


def corner_ring(box: Column, crs: str) -> Column:
    """Polygon text in degrees around the four corners of a native box, seven decimals."""
    from tidemark.functions.crs import to_lonlat

    corners = [("minx", "miny"), ("minx", "maxy"), ("maxx", "maxy"), ("maxx", "miny"), ("minx", "miny")]
    texts = []
    for cx, cy in corners:
        x, y = to_lonlat(crs, box[cx], box[cy])
        texts.append(F.concat_ws(" ", F.format_string("%.7f", x), F.format_string("%.7f", y)))
    return F.concat(F.lit("POLYGON(("), F.concat_ws(",", *texts), F.lit("))"))


def format_summary(compression: Column, version: Column, optimisation: Column, optimisation_version: Column) -> Column:
    """Such as ``laz-1.4/copc-1.0``."""
    base = F.concat_ws("-", compression, version)
    return F.when(optimisation.isNotNull(), F.concat(base, F.lit("/"), F.concat_ws("-", optimisation, optimisation_version))).otherwise(base)


def raster_format(cloud_optimised: Column) -> Column:
    return F.when(cloud_optimised, F.lit("geotiff/cog")).otherwise(F.lit("geotiff"))


def is_compatible(tile_format: Column, dataset_format: Column) -> Column:
    """A tile fits when its format equals or refines the dataset's."""
    return (tile_format == dataset_format) | tile_format.startswith(F.concat(dataset_format, F.lit("/")))


#: Parts of a format description that each relaxation drops (fixed values).
RELAXATIONS = {
    "drop_optimization": ["optimization", "optimizationVersion"],
    "drop_profile": ["profile"],
}


def relaxed_format(fmt: Column, how: str) -> Column:
    """Format description (a text map) as an import option sees it.

    ``drop_format`` forgets it, ``drop_optimization`` and ``drop_profile`` forget a part,
    ``as_copc`` and ``as_cog`` tell what it would be after conversion.
    """
    if how == "none":
        return fmt
    if how == "drop_format":
        return F.map_filter(fmt, lambda k, v: F.lit(False))
    if how in RELAXATIONS:
        return F.map_filter(fmt, lambda k, v: ~k.isin(RELAXATIONS[how]))
    if how == "as_cog":
        rest = F.map_filter(fmt, lambda k, v: k != "profile")
        return F.map_concat(rest, F.create_map(F.lit("profile"), F.lit("cloud-optimized")))
    if how == "as_copc":
        from tidemark.schema import POINT_FORMATS

        facts = F.create_map(*[x for p in POINT_FORMATS for x in (F.lit(p["pdrf"]), F.struct(F.lit(p["length"]).alias("n"), F.lit(p["copc_pdrf"]).alias("to")))])
        pdrf = fmt["pointDataRecordFormat"].cast("int")
        target = F.element_at(facts, pdrf)["to"]
        length = fmt["pointDataRecordLength"].cast("int") - F.element_at(facts, pdrf)["n"] + F.element_at(facts, target)["n"]
        changed = ["compression", "lasVersion", "optimization", "optimizationVersion", "pointDataRecordFormat", "pointDataRecordLength"]
        rest = F.map_filter(fmt, lambda k, v: k == "extraBytesVlr")
        return F.map_concat(
            rest,
            F.create_map(
                F.lit("compression"), F.lit("laz"), F.lit("lasVersion"), F.lit("1.4"), F.lit("optimization"), F.lit("copc"),
                F.lit("optimizationVersion"), F.lit("1.0"), F.lit(changed[4]), target.cast("string"), F.lit(changed[5]), length.cast("string"),
            ),
        )
    raise ValueError(f"no such relaxation: {how}")


def envisioned(tiles: DataFrame, target_format: str) -> DataFrame:
    """Summary after a conversion; whatever changes keeps its former value in ``source_*``.

    Names are put into standard form either way. The content of a converted file is not
    known yet, so its id and size are NULL.
    """
    convert = ~is_compatible(F.col("format"), F.lit(target_format))
    fmt = F.when(convert, F.lit(target_format)).otherwise(F.col("format"))
    renamed = tiles.withColumn("_name", with_extension(F.col("name"), fmt)).withColumn("_convert", convert)
    return renamed.select(
        F.col("_name").alias("name"),
        fmt.alias("format"),
        F.when(~F.col("_convert"), F.col("oid")).alias("oid"),
        F.when(~F.col("_convert"), F.col("size")).alias("size"),
        F.when(F.col("_name") != F.col("name"), F.col("name")).alias("source_name"),
        F.when(F.col("_convert"), F.col("format")).alias("source_format"),
        F.when(F.col("_convert"), F.col("oid")).alias("source_oid"),
        F.when(F.col("_convert"), F.col("size")).alias("source_size"),
    )


def with_sidecars(files: DataFrame) -> DataFrame:
    """Tiles with the id and size of the sidecar of the same name, case ignored."""
    tiles = files.filter(~is_sidecar(F.col("name"))).withColumn("_k", F.lower("name"))
    side = files.filter(is_sidecar(F.col("name"))).select(
        F.lower(F.regexp_replace("name", SIDECAR, "")).alias("_k"),
        F.col("name").alias("pam_name"), F.col("oid").alias("pam_oid"), F.col("size").alias("pam_size"),
    )
    return tiles.join(side, "_k", "left").drop("_k")


def scan(files: DataFrame, keep: Column | None = None) -> DataFrame:
    """Tiles that pass a filter on their own columns, each with its sidecar."""
    tiles = with_sidecars(files)
    return tiles if keep is None else tiles.filter(keep)


def tile_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tile deltas; a change in the sidecar alone is an update of the tile."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return with_sidecars(df).select(
            F.lower(tile_name(F.col("name"))).alias("tile"), F.struct("name", "oid", "pam_oid").alias(name)
        )

    both = side(old, "old").join(side(new, "new"), "tile", "full_outer")
    both = both.filter(~F.struct("old.oid", "old.pam_oid").eqNullSafe(F.struct("new.oid", "new.pam_oid")))
    kind = change_type(F.col("old").isNotNull(), F.col("new").isNotNull())
    return both.select("tile", kind.alias("change_type"), "old", "new")


def major_changes(delta: DataFrame, ignored: Sequence[str]) -> DataFrame:
    """Deltas whose halves differ in more than the ignored fields."""
    names = [f for f in delta.schema["old"].dataType.fieldNames() if f not in ignored]
    rest = [F.struct(*[F.col(f"{s}.{n}") for n in names]) for s in ("old", "new")]
    minor = (F.col("change_type") == "update") & rest[0].eqNullSafe(rest[1])
    return delta.filter(~minor)


def xml_without_statistics(xml: Column) -> Column:
    """Sidecar text without statistics, histograms and spacing between tags, for comparison."""
    out = F.regexp_replace(xml, r"(?s)<MDI key=\"STATISTICS_[^>]*>[^<]*</MDI>", "")
    out = F.regexp_replace(out, r"(?s)<Histograms>.*?</Histograms>", "")
    out = F.regexp_replace(out, r"(?s)<Metadata>\s*</Metadata>|<Metadata\s*/>", "")
    out = F.regexp_replace(out, r">\s+<", "><")
    return F.regexp_replace(out, r"(?s)<PAMRasterBand[^>]*>\s*</PAMRasterBand>", "")


def category_labels(xml: Column) -> Column:
    """Category names of a sidecar in order; their position is the category number."""
    return F.xpath(xml, F.lit("/PAMDataset/PAMRasterBand/CategoryNames/Category/text()"))


def is_optimised(fmt: Column) -> Column:
    return fmt.contains("copc") | fmt.contains("cog")


def not_yet_imported(incoming: DataFrame, existing: DataFrame, optimise: bool = False) -> DataFrame:
    """Incoming tiles (``name, oid, format, crs``) that an import cannot take over as they are.

    A tile is already there when the existing one of its name came from the same content
    (its id or its original id) and would end up with the same optimisation and system.
    """
    def facts(oid: str) -> DataFrame:
        return existing.filter(F.col(oid).isNotNull()).select(
            F.lower(tile_name(F.col("name"))).alias("_t"), F.col(oid).alias("_o"), is_optimised(F.col("format")).alias("_c"), F.col("crs").alias("_crs")
        )

    have = facts("oid").unionByName(facts("source_oid")) if "source_oid" in existing.columns else facts("oid")
    keyed = incoming.withColumn("_key", F.lower(tile_name(F.col("name")))).withColumn(
        "_will", F.lit(True) if optimise else is_optimised(F.col("format"))
    )
    same = (F.col("_key") == F.col("_t")) & (F.col("oid") == F.col("_o")) & (F.col("_will") == F.col("_c")) & (F.col("crs") == F.col("_crs"))
    return keyed.join(have.distinct(), same, "left_anti").drop("_key", "_will")


def import_tiles(incoming: DataFrame, existing: DataFrame, mode: str, delete: DataFrame | None = None) -> DataFrame:
    """The catalogue after an import: ``new``, ``replace`` or ``update``; named tiles may be deleted."""
    key = F.lower(tile_name(F.col("name")))
    keyed_in = incoming.select(*existing.columns, key.alias("_t"))
    keyed_old = existing.withColumn("_t", key)
    if mode in ("new", "replace"):
        out = keyed_in
    elif mode == "update":
        out = keyed_old.join(keyed_in.select("_t"), "_t", "left_anti").unionByName(keyed_in)
    else:
        raise ValueError(f"no such import mode: {mode}")
    if delete is not None:
        out = out.join(delete.select(F.lower(tile_name(F.col("name"))).alias("_t")), "_t", "left_anti")
    return out.select(*existing.columns)


def homogeneous(items: DataFrame) -> DataFrame:
    """Fails the job when a meta item (``item, value``) has more than one value."""
    from tidemark.operators.aggregates import merge_metadata

    merged = merge_metadata(items, [], "item", "value")
    bad = F.when(F.col("conflict"), F.raise_error(F.concat(F.lit("tiles disagree on "), F.col("item"))))
    return merged.withColumn("_e", bad.cast("string")).filter(F.col("_e").isNull()).select("item", "value")


def content_listing(objects: DataFrame, stored: DataFrame) -> DataFrame:
    """Referenced content with whether it is present, once per content id."""
    needed = objects.groupBy("oid").agg(F.min("path").alias("path"), F.max("size").alias("size"))
    have = stored.select("oid").distinct().withColumn("_h", F.lit(True))
    return needed.join(have, "oid", "left").select("oid", F.col("_h").isNotNull().alias("present"), "path", "size")


def content_gaps(needed: DataFrame, stored: DataFrame, kept: DataFrame) -> DataFrame:
    """Count and size of content that is needed but absent, and stored but not kept."""
    want = needed.select("oid", "size").dropDuplicates(["oid"])
    have = stored.select("oid", "size").dropDuplicates(["oid"])
    missing = want.join(have.select("oid"), "oid", "left_anti").withColumn("kind", F.lit("missing"))
    loose = have.join(kept.select("oid").distinct(), "oid", "left_anti").withColumn("kind", F.lit("unreferenced"))
    return missing.unionByName(loose).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total_size"))
