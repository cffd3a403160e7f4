"""Patches and renderings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import geometry, wkb
from tidemark.operators import algebra, diffing, patches, spatial
from tidemark.operators.ordering import delta_order
from tidemark.plans import fixtures as fx
from tidemark.plans.q_diff import COLS, META_DIFF, META_NEW, META_OLD, PK, WITH_DIFF, edit_diff, meta_sides
from tidemark.plans.registry import query
from tidemark.sinks import render
from tidemark.sources import patchdoc

ROW = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampNTZType()),
        T.StructField("o_orderpriority", T.StringType()),
    ]
)


def patch_rows(spark, sf):
    """The edit of ``orders`` as patch text, one change per row."""
    d = edit_diff(spark, sf)
    return d.select(render.change_json(d, advanced=True).alias("change"))


def star(change):
    return F.regexp_replace(F.regexp_replace(change, r'^\{"-":.*,"\+":', '{"+":'), r'^\{"\+"', '{"*"')


@query(
    "PAT1",
    WITH_DIFF
    + """SELECT coalesce(old_key, new_key) AS key, change_type, CAST(NULL AS STRING) AS invalid, CASE WHEN change_type <> 'delete' THEN new_o_orderpriority END AS new_priority FROM diff
UNION ALL SELECT NULL AS key, NULL AS change_type, 'star is not allowed' AS invalid, NULL AS new_priority FROM diff WHERE change_type = 'update'""",
)
def pat1(spark, sf):
    d = edit_diff(spark, sf)
    good = d.select(render.change_json(d, advanced=True).alias("change"))
    starred = d.filter("change_type = 'update'").select(star(render.change_json(d)).alias("change"))
    parsed = patches.parse_changes(good.unionByName(starred), ROW, "o_orderkey")
    return parsed.select(
        "key", "change_type", "invalid", F.coalesce("plus_plus", "plus")["o_orderpriority"].alias("new_priority")
    )


def patch_documents(spark, sf):
    """Patch documents of at most a few hundred changes each: one per range of keys."""
    d = edit_diff(spark, sf)
    at = F.coalesce("old_key", "new_key")
    doc = F.floor((at % 10000000) / 250).cast("bigint")
    rows = d.select(doc.alias("doc_id"), render.change_json(d, advanced=True).alias("change"))
    listed = rows.groupBy("doc_id").agg(F.concat_ws(",", F.collect_list("change")).alias("body"))
    return listed.select(
        "doc_id",
        F.concat(
            F.lit('{"tidemark.patch/v1":{"base":"v1"},"' + render.DIFF_TAG + '":{"orders":{"feature":['), "body", F.lit("]}}}")
        ).alias("doc"),
    )


@query("SRC12", WITH_DIFF + "SELECT 'v1' AS base, old_key, new_key, change_type, new_o_totalprice FROM diff")
def src12(spark, sf):
    parsed = patchdoc.read_documents(patch_documents(spark, sf), ROW, "o_orderkey", "orders")
    delta = patches.as_delta(parsed, "o_orderkey")
    return delta.select(F.lit("v1").alias("base"), "old_key", "new_key", "change_type", F.col("new.o_totalprice").alias("new_o_totalprice"))


SCHEMA_OLD, SCHEMA_NEW = '[{"name":"o_orderkey"},{"name":"o_totalprice"}]', '[{"name":"o_orderkey"},{"name":"price"}]'
SUPPLIER = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_name", T.StringType())])
WHOLE = fx.ctes(
    edited=fx.EDITED, diff=fx.EDIT_DIFF, mo=META_OLD, mn=META_NEW, m=META_DIFF, named="SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 4 = 0",
    parts=f"""SELECT 'orders' AS dataset, 'feature' AS part, CAST(NULL AS STRING) AS item, change_type, CAST(old_key AS STRING) AS old_value, CAST(new_key AS STRING) AS new_value FROM diff
UNION ALL SELECT 'orders', 'meta', 'schema.json', 'update', '{SCHEMA_OLD}', '{SCHEMA_NEW}' UNION ALL SELECT 'orders', 'meta', 'crs/EPSG:4326.wkt', 'insert', NULL, 'GEOGCS["a ""quoted"" name"]'
UNION ALL SELECT 'supplier', 'feature', NULL, 'delete', CAST(s_suppkey AS STRING), NULL FROM named UNION ALL SELECT dataset, 'meta', item, change_type, old_value, new_value FROM m""",
)


def whole_lines(spark, sf, base):
    """Rows of two datasets and meta items of many, in one document."""
    old, new = meta_sides(spark, sf)
    own = spark.createDataFrame(
        [("orders", "schema.json", "update", SCHEMA_OLD, SCHEMA_NEW), ("orders", "crs/EPSG:4326.wkt", "insert", None, 'GEOGCS["a ""quoted"" name"]')],
        "dataset string, item string, change_type string, old_value string, new_value string",
    )
    meta = diffing.diff_maps(old, new, ["dataset", "item"], "value").unionByName(own)
    gone = fx.table(spark, sf, "supplier").filter("s_suppkey % 4 = 0").select("s_suppkey", "s_name")
    return render.document({"orders": edit_diff(spark, sf), "supplier": diffing.all_rows(gone, ["s_suppkey"], "delete")}, meta, base=base)


def whole_parts(spark, sf, base):
    """The document written to files and read back line by line, in as many tasks as it has parts."""
    from tidemark.session import scratch_path

    path = scratch_path(spark, "document")
    whole_lines(spark, sf, base).write.parquet(path)
    parts = patchdoc.read_laid_document(spark.read.parquet(path))
    meta = patchdoc.meta_deltas(parts).select("dataset", F.lit("meta").alias("part"), "item", "change_type", "old_value", "new_value")
    for name, kind, pk in (("orders", ROW, "o_orderkey"), ("supplier", SUPPLIER, "s_suppkey")):
        d = patches.as_delta(patchdoc.feature_changes(parts, kind, pk, name), pk)
        meta = meta.unionByName(d.select(
            F.lit(name).alias("dataset"), F.lit("feature").alias("part"), F.lit(None).cast("string").alias("item"), "change_type",
            F.col("old_key").cast("string").alias("old_value"), F.col("new_key").cast("string").alias("new_value"),
        ))
    return meta


@query("SNK7_META", WHOLE + "SELECT * FROM parts")
def snk7_meta(spark, sf):
    """A patch with schema, reference system and titles of several datasets, written and read back."""
    return whole_parts(spark, sf, "v1")


@query("SNK2_META", WHOLE + "SELECT * FROM parts")
def snk2_meta(spark, sf):
    """The same as a plain diff."""
    return whole_parts(spark, sf, None)


@query(
    "PAT2",
    """SELECT c_name AS dataset, CASE WHEN c_custkey % 3 = 0 THEN 'create_dataset' WHEN c_custkey % 3 = 1 THEN 'delete_dataset' ELSE 'meta_update' END AS meta_change,
 CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'dataset exists' WHEN c_custkey % 3 <> 0 AND c_custkey % 2 <> 0 THEN 'no such dataset' END AS problem FROM customer""",
)
def pat2(spark, sf):
    c = fx.table(spark, sf, "customer")
    n = F.col("c_custkey") % 3
    meta = c.select(F.col("c_name").alias("dataset"), (n != 0).alias("has_old"), (n != 1).alias("has_new"))
    existing = c.filter("c_custkey % 2 = 0").select(F.col("c_name").alias("dataset"))
    return patches.classify_meta(meta, existing)


@query("PAT3", fx.EDITED)
def pat3(spark, sf):
    """A patch that fits, applied: checked first, then applied as a whole."""
    delta = patches.as_delta(patches.parse_changes(patch_rows(spark, sf), ROW, "o_orderkey"), "o_orderkey")
    return patches.apply_checked(delta, fx.orders(spark, sf), "o_orderkey")


CONFLICTS = fx.ctes(edited=fx.EDITED, again=fx.EDITED_AGAIN, diff=fx.EDIT_DIFF) + """, located AS (SELECT *, CASE WHEN change_type = 'insert' THEN new_key ELSE old_key END AS key FROM diff),
j AS (SELECT d.*, c.o_orderkey AS ck, c.o_custkey AS cc, c.o_orderstatus AS cs, c.o_totalprice AS cp, c.o_orderdate AS cd, c.o_orderpriority AS cq FROM located d LEFT JOIN again c ON d.key = c.o_orderkey),
found AS (SELECT key, change_type, CASE WHEN change_type = 'delete' AND ck IS NULL THEN 'delete of missing key' WHEN change_type = 'update' AND ck IS NULL THEN 'update of missing key'
 WHEN change_type = 'update' AND (cc IS DISTINCT FROM old_o_custkey OR cs IS DISTINCT FROM old_o_orderstatus OR cp IS DISTINCT FROM old_o_totalprice OR cd IS DISTINCT FROM old_o_orderdate OR cq IS DISTINCT FROM old_o_orderpriority)
 THEN 'update of changed row' WHEN change_type = 'insert' AND ck IS NOT NULL THEN 'insert of existing key' END AS reason FROM j)
"""


@query("PAT3_CONFLICTS", CONFLICTS + "SELECT * FROM found WHERE reason IS NOT NULL")
def pat3_conflicts(spark, sf):
    """The same patch against a version that has moved on."""
    return patches.conflicts(edit_diff(spark, sf), fx.edited_again(spark, sf), "o_orderkey")


@query("JOI9", CONFLICTS + "SELECT reason, CAST(count(*) AS BIGINT) AS n FROM found WHERE reason LIKE '%key' GROUP BY reason")
def joi9(spark, sf):
    found = patches.conflicts(edit_diff(spark, sf), fx.edited_again(spark, sf), "o_orderkey")
    return found.filter(F.col("reason").endswith("key")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def partial_patch(spark, sf):
    """Status edits that name only the key and the status."""
    d = edit_diff(spark, sf).filter("change_type = 'update' AND NOT (old.o_orderstatus <=> new.o_orderstatus)")

    def half(side: str):
        return F.to_json(F.struct(F.col(f"{side}.o_orderkey").alias("o_orderkey"), F.col(f"{side}.o_orderstatus").alias("o_orderstatus")))

    return d.select(F.concat(F.lit('{"-":'), half("old"), F.lit(',"+":'), half("new"), F.lit("}")).alias("change"))


FILLED = WITH_DIFF + """SELECT old_key, new_key, new_o_custkey AS o_custkey, new_o_orderstatus AS o_orderstatus, new_o_totalprice AS o_totalprice, old_o_orderstatus AS old_status
FROM diff WHERE change_type = 'update' AND old_o_orderstatus IS DISTINCT FROM new_o_orderstatus"""


def filled(spark, sf):
    parsed = patches.parse_changes(partial_patch(spark, sf), ROW, "o_orderkey")
    whole = patches.fill_partial(patches.as_delta(parsed, "o_orderkey"), fx.orders(spark, sf), "o_orderkey")
    return whole.select(
        "old_key", "new_key", F.col("new.o_custkey").alias("o_custkey"), F.col("new.o_orderstatus").alias("o_orderstatus"),
        F.col("new.o_totalprice").alias("o_totalprice"), F.col("old.o_orderstatus").alias("old_status"), "missing_fields",
    )


@query("PAT4", FILLED)
def pat4(spark, sf):
    return filled(spark, sf).drop("missing_fields")


@query(
    "JOI10",
    fx.ctes(edited=fx.EDITED)
    + """SELECT e.o_orderkey AS key, o.o_totalprice, CASE WHEN o.o_orderkey IS NULL THEN 'o_custkey,o_orderdate,o_orderpriority,o_totalprice' END AS missing_fields
FROM edited e LEFT JOIN orders o ON e.o_orderkey = o.o_orderkey""",
)
def joi10(spark, sf):
    """Partial inserts filled from the base, and the fields still missing where it has no row."""
    e = fx.edited(spark, sf)
    raw = e.select(F.concat(F.lit('{"+":'), F.to_json(F.struct("o_orderkey", "o_orderstatus")), F.lit("}")).alias("change"))
    delta = patches.as_delta(patches.parse_changes(raw, ROW, "o_orderkey"), "o_orderkey")
    whole = patches.fill_partial(delta, fx.orders(spark, sf), "o_orderkey")
    return whole.select(F.col("new_key").alias("key"), F.col("new.o_totalprice").alias("o_totalprice"), "missing_fields")


@query(
    "PAT5",
    fx.ctes(edited=fx.EDITED)
    + """SELECT c.o_orderkey AS key, 'insert' AS change_type, 'modified since patch' AS reason FROM edited c LEFT JOIN orders b ON b.o_orderkey = c.o_orderkey
WHERE b.o_orderkey IS NULL OR b.o_totalprice IS DISTINCT FROM c.o_totalprice OR b.o_orderpriority IS DISTINCT FROM c.o_orderpriority""",
)
def pat5(spark, sf):
    """Lone pluses on existing keys: fine where nothing but the patched field changed."""
    current, base = fx.edited(spark, sf), fx.orders(spark, sf)
    old_status = base.select("o_orderkey", F.col("o_orderstatus").alias("_s"))
    given = current.select("o_orderkey").join(old_status, "o_orderkey", "left")
    raw = given.select(
        F.concat(F.lit('{"+":'), F.to_json(F.struct("o_orderkey", F.coalesce("_s", F.lit("N")).alias("o_orderstatus"))), F.lit("}")).alias("change")
    )
    delta = patches.as_delta(patches.parse_changes(raw, ROW, "o_orderkey"), "o_orderkey")
    return patches.conflicts(delta, current, "o_orderkey", base)


META_CURRENT = META_OLD.replace("FROM customer", "FROM customer WHERE c_custkey % 4 <> 0").replace("'Region '", "'Area '")


@query(
    "PAT6",
    fx.ctes(mo=META_OLD, mn=META_NEW, cur=META_CURRENT, d=META_DIFF)
    + """SELECT * FROM (SELECT d.dataset, d.item, change_type, CASE WHEN change_type = 'delete' AND c.value IS NULL THEN 'delete of missing item'
 WHEN change_type = 'update' AND c.value IS NULL THEN 'update of missing item' WHEN change_type = 'insert' AND c.value IS NOT NULL THEN 'insert of existing item'
 WHEN change_type = 'update' AND c.value <> d.old_value THEN 'update of changed item' END AS reason FROM d LEFT JOIN cur c ON d.dataset = c.dataset AND d.item = c.item) f WHERE reason IS NOT NULL""",
)
def pat6(spark, sf):
    delta = diffing.diff_maps(*meta_sides(spark, sf), ["dataset", "item"], "value")
    return patches.meta_conflicts(delta, fx.derive(spark, sf, META_CURRENT), ["dataset", "item"])


@query("PAT6_APPLY", META_NEW)
def pat6_apply(spark, sf):
    old, new = meta_sides(spark, sf)
    delta = diffing.diff_maps(old, new, ["dataset", "item"], "value")
    return patches.apply_meta(delta, old, ["dataset", "item"])


@query("PAT7", fx.ctes(p=fx.POINTS) + "SELECT fid AS key, CAST(round(x, 6) AS DECIMAL(18,6)) AS x, CAST(round(y, 6) AS DECIMAL(18,6)) AS y FROM p WHERE abs(y) < 85")
def pat7(spark, sf):
    """A patch given in web mercator, brought into degrees."""
    p = fx.points(spark, sf).filter(F.abs("y") < 85)
    shape = spatial.reproject(spatial.point(F.col("x"), F.col("y")), "EPSG:4326", "EPSG:3857", F.col("fid"))
    given = p.select("fid", shape.alias("geom"))
    delta = patches.guard_reprojected(diffing.all_rows(given, ["fid"], "insert"), "EPSG:3857", p)
    back = spatial.reproject(F.col("new.geom"), "EPSG:3857", "EPSG:4326", F.col("new_key"))
    return delta.select(F.col("new_key").alias("key"), back.alias("g")).select(
        "key", F.round("g.minx", 6).cast("decimal(18,6)").alias("x"), F.round("g.miny", 6).cast("decimal(18,6)").alias("y")
    )


FILE_PATHS = "SELECT 'docs/' || CAST(page_id AS STRING) || '.html' AS path, html AS content, page_id FROM pages"


@query(
    "PAT8",
    fx.ctes(f=FILE_PATHS)
    + """SELECT path, CASE WHEN page_id % 4 = 1 THEN content || '!' ELSE content END AS content FROM f WHERE page_id % 4 <> 2
UNION ALL SELECT 'new/' || path AS path, content FROM f WHERE page_id % 4 = 3""",
)
def pat8(spark, sf):
    f = fx.derive(spark, sf, FILE_PATHS)
    n = F.col("page_id") % 4
    edits = f.filter(n == 1).select("path", F.concat("content", F.lit("!")).alias("content"))
    removals = f.filter(n == 2).select("path", F.lit(None).cast("string").alias("content"))
    additions = f.filter(n == 3).select(F.concat(F.lit("new/"), "path").alias("path"), "content")
    changes = edits.unionByName(removals).unionByName(additions)
    datasets = fx.table(spark, sf, "nation").select(F.col("n_name").alias("dataset"))
    return patches.apply_files(f.select("path", "content"), changes, datasets)


def in_order():
    return delta_order("_key", "bigint")


def read_back(lines, marks=("-", "+")):
    """Position and the keys a document's lines hold under each mark."""
    change = F.regexp_replace("line", "^,", "")
    body = F.when(F.col("line").rlike(r'^,?\{"[-+]{1,2}":'), change)
    names = {"-": "minus", "+": "plus", "--": "minus_minus", "++": "plus_plus"}
    return lines.select(
        F.col("position").cast("bigint").alias("position"),
        *[F.get_json_object(body, f"$['{m}'].o_orderkey").cast("bigint").alias(names[m]) for m in marks],
    )


POSITIONED = "numbered AS (SELECT *, CAST(row_number() OVER (ORDER BY coalesce(old_key, new_key)) AS BIGINT) AS position FROM diff)"
ENDS = "UNION ALL SELECT 0 AS position, {nulls} UNION ALL SELECT CAST(count(*) + 1 AS BIGINT) AS position, {nulls} FROM diff"
ADVANCED = """CASE WHEN change_type = 'delete' THEN old_key END AS minus_minus, CASE WHEN change_type = 'update' THEN new_key END AS plus, CASE WHEN change_type = 'insert' THEN new_key END AS plus_plus"""


@query(
    "PAT10",
    WITH_DIFF.rstrip() + ",\n" + POSITIONED
    + f" SELECT position, CASE WHEN change_type = 'update' THEN old_key END AS minus, {ADVANCED} FROM numbered "
    + ENDS.format(nulls="NULL, NULL, NULL, NULL"),
)
def pat10(spark, sf):
    """A patch document line by line, and the keys read back from it."""
    d = edit_diff(spark, sf).withColumn("_key", algebra.delta_key())
    return read_back(render.patch_lines(d, "orders", "v1", in_order(), "edit of orders"), ("-", "--", "+", "++"))


@query(
    "SNK7",
    WITH_DIFF.rstrip() + ",\n" + POSITIONED + f" SELECT position, CAST(NULL AS BIGINT) AS minus, {ADVANCED} FROM numbered " + ENDS.format(nulls="NULL, NULL, NULL, NULL"),
)
def snk7(spark, sf):
    """With a reference system, updates carry no old row."""
    d = edit_diff(spark, sf).withColumn("_key", algebra.delta_key())
    return read_back(render.patch_lines(d, "orders", "v1", in_order(), "edit of orders", crs="EPSG:4326"), ("-", "--", "+", "++"))


@query(
    "SNK2",
    WITH_DIFF.rstrip() + ",\n" + POSITIONED + " SELECT position, old_key AS minus, new_key AS plus FROM numbered " + ENDS.format(nulls="NULL, NULL"),
)
def snk2(spark, sf):
    d = edit_diff(spark, sf).withColumn("_key", algebra.delta_key())
    return read_back(render.json_diff(d, "orders", in_order()))


@query(
    "SNK3",
    fx.ctes(edited=fx.EDITED, diff=fx.EDIT_DIFF, mo=META_OLD, mn=META_NEW, m=META_DIFF)
    + """SELECT CAST(r AS INTEGER) AS rank, t AS type, CAST(NULL AS BIGINT) AS old_key, CAST(NULL AS BIGINT) AS new_key, CAST(NULL AS STRING) AS item FROM (SELECT 0 AS r, 'version' AS t UNION ALL SELECT 1, 'datasetInfo' UNION ALL SELECT 2, 'metaInfo') h
UNION ALL SELECT 3, 'meta', NULL, NULL, item FROM m UNION ALL SELECT 4, 'feature', old_key, new_key, NULL FROM diff""",
)
def snk3(spark, sf):
    from tidemark.schema import VersionedSchema

    schema = VersionedSchema.infer(fx.orders(spark, sf), PK, "orders").to_json()
    old, new = meta_sides(spark, sf)
    meta = diffing.diff_maps(old, new, ["dataset", "item"], "value")
    lines = render.jsonl_diff(edit_diff(spark, sf), "orders", schema, meta)
    return lines.select(
        "rank", F.get_json_object("line", "$.type").alias("type"),
        F.get_json_object("line", "$.change['-'].o_orderkey").cast("bigint").alias("old_key"),
        F.get_json_object("line", "$.change['+'].o_orderkey").cast("bigint").alias("new_key"),
        F.when(F.get_json_object("line", "$.type") == "meta", F.get_json_object("line", "$.key")).alias("item"),
    )


@query(
    "SNK4",
    WITH_DIFF
    + """SELECT 'orders:feature:' || CAST(old_key AS STRING) || CASE WHEN change_type = 'delete' THEN ':D' ELSE ':U-' END AS id, old_o_custkey AS o_custkey, old_o_orderpriority AS o_orderpriority FROM diff WHERE old_key IS NOT NULL
UNION ALL SELECT 'orders:feature:' || CAST(new_key AS STRING) || CASE WHEN change_type = 'insert' THEN ':I' ELSE ':U+' END AS id, new_o_custkey, new_o_orderpriority FROM diff WHERE new_key IS NOT NULL""",
)
def snk4(spark, sf):
    features = render.geojson_features(edit_diff(spark, sf), "orders")
    return features.select(
        F.get_json_object("feature", "$.id").alias("id"),
        F.get_json_object("feature", "$.properties.o_custkey").cast("bigint").alias("o_custkey"),
        F.get_json_object("feature", "$.properties.o_orderpriority").alias("o_orderpriority"),
    )


def _shown(side: str, name: str, sign: str) -> str:
    return f"'{sign} {name:>40} = ' || coalesce(CAST({side}_{name} AS STRING), '␀')"


TEXT_FIELDS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
TEXT_DIFF = fx.ctes(edited=fx.EDITED, diff=fx.diff_sql("orders", "edited", "o_orderkey", TEXT_FIELDS)) + f"""SELECT old_key, new_key, change_type,
 CASE change_type WHEN 'insert' THEN concat_ws(chr(10), '+++ orders:feature:' || CAST(new_key AS STRING), {', '.join(_shown('new', f, '+') for f in TEXT_FIELDS)})
 WHEN 'delete' THEN concat_ws(chr(10), '--- orders:feature:' || CAST(old_key AS STRING), {', '.join(_shown('old', f, '-') for f in TEXT_FIELDS)})
 ELSE concat_ws(chr(10), '--- orders:feature:' || CAST(old_key AS STRING), '+++ orders:feature:' || CAST(new_key AS STRING), {', '.join(
     f"CASE WHEN old_{f} IS DISTINCT FROM new_{f} THEN {_shown(side, f, sign)} END" for f in TEXT_FIELDS for side, sign in (('old', '-'), ('new', '+')))}) END AS text FROM diff"""


@query("SNK5", TEXT_DIFF)
def snk5(spark, sf):
    d = diffing.diff(fx.orders(spark, sf).select(*TEXT_FIELDS), fx.edited(spark, sf).select(*TEXT_FIELDS), PK)
    return render.text_diff(d, "orders")


@query("SNK8", fx.ctes(p=fx.POINTS) + "SELECT fid AS key, x, y, name FROM p")
def snk8(spark, sf):
    """Rows as GeoJSON features, read back."""
    p = fx.points(spark, sf).select("fid", "name", spatial.point(F.col("x"), F.col("y")).alias("geom"))
    features = render.rows_geojson(p, "fid")
    geom = geometry.from_geojson(F.get_json_object("feature", "$.geometry"))
    return features.select("key", geom["minx"].alias("x"), geom["miny"].alias("y"), F.get_json_object("feature", "$.properties.name").alias("name"))


@query("SNK8_JSON", fx.ctes(p=fx.POINTS) + "SELECT fid AS key, CAST(fid AS STRING) AS fid, name, x, y, TRUE AS whole FROM p")
def snk8_json(spark, sf):
    """Rows as JSON with geometry as hex WKB, read back."""
    p = fx.points(spark, sf).select("fid", "name", spatial.point(F.col("x"), F.col("y")).alias("geom"))
    rows = render.rows_json(p, "fid")
    text = [c for c in rows.columns if c != "key"][0]
    field = lambda n: F.get_json_object(text, f"$.{n}")
    shape = wkb.decode_hex(field("geom"))
    out = rows.select("key", field("fid").alias("fid"), field("name").alias("name"), shape.alias("g"), F.json_array_length(F.to_json(F.json_object_keys(text))).alias("n"))
    return out.select("key", "fid", "name", F.col("g.minx").alias("x"), F.col("g.miny").alias("y"), (F.col("n") == 3).alias("whole"))


@query("DIF19", fx.ctes(p=fx.POINTS) + "SELECT fid AS key, CAST(round(x * 111319.490793273572, 3) AS DECIMAL(18,3)) AS old_x, CAST(round((x + 1) * 111319.490793273572, 3) AS DECIMAL(18,3)) AS new_x FROM p WHERE abs(y) < 85 AND fid % 2 = 0")
def dif19(spark, sf):
    """A diff shown in another reference system."""
    p = fx.points(spark, sf).filter(F.abs("y") < 85)
    old = p.select("fid", spatial.point(F.col("x"), F.col("y")).alias("geom"))
    x = F.when(F.col("fid") % 2 == 0, F.col("x") + 1).otherwise(F.col("x"))
    new = p.select("fid", spatial.point(x, F.col("y")).alias("geom"))
    d = diffing.diff(old, new, ["fid"])
    shown = [spatial.reproject(F.col(f"{s}.geom"), "EPSG:4326", "EPSG:3857", F.col(f"{s}_key")).alias(s) for s in ("old", "new")]
    return d.select(F.col("old_key").alias("key"), *shown).select(
        "key", F.round("old.minx", 3).cast("decimal(18,3)").alias("old_x"), F.round("new.minx", 3).cast("decimal(18,3)").alias("new_x")
    )


@query(
    "DIF20",
    """SELECT page_id, 'text:' || html AS old_content, 'base64:' || base64(encode(html) || '\\x00'::BLOB) AS new_content FROM pages""",
)
def dif20(spark, sf):
    """File contents inline; a NUL byte makes a file binary."""
    pages = fx.table(spark, sf, "pages")
    raw = F.encode("html", "UTF-8")
    delta = pages.select("page_id", raw.alias("old_content"), F.concat(raw, F.unhex(F.lit("00"))).alias("new_content"))
    return render.file_delta_text(delta)
