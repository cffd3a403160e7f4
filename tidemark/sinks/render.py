"""Diffs, conflicts and rows as text, JSON, JSON lines and GeoJSON, one row of text per record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import geometry, wkb
from tidemark.functions.hashing import plain_base64
from tidemark.operators.numbering import number_all

#: Tags written at the head of documents. Readers look only at the part after the dot.
DIFF_TAG = "tidemark.diff/v1+hexwkb"
LINES_TAG = "tidemark.diff/v2"
PATCH_TAG = "tidemark.patch/v1"

NULL_TEXT = "␀"


def _is_geometry(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and "parts" in kind.fieldNames() and "kind" in kind.fieldNames()


def plain_row(struct: str, kind: T.StructType) -> Column:
    """A row struct with geometry as hex WKB and bytes as hex."""
    cols = []
    for f in kind.fields:
        value = F.col(struct)[f.name]
        if _is_geometry(f.dataType):
            value = wkb.to_hex_wkb(value)
        elif isinstance(f.dataType, T.BinaryType):
            value = F.lower(F.hex(value))
        cols.append(value.alias(f.name))
    return F.when(F.col(struct).isNotNull(), F.struct(*cols))


def row_json(df: DataFrame, struct: str) -> Column:
    """JSON of a row struct; NULL fields are kept."""
    return F.to_json(plain_row(struct, df.schema[struct].dataType), {"ignoreNullFields": "false"})


def row_geojson(df: DataFrame, struct: str, feature_id: Column) -> Column:
    """GeoJSON feature of a row struct: its geometry column becomes the geometry."""
    kind = df.schema[struct].dataType
    shapes = [f.name for f in kind.fields if _is_geometry(f.dataType)]
    rest = T.StructType([f for f in kind.fields if f.name not in shapes])
    properties = F.to_json(plain_row(struct, rest), {"ignoreNullFields": "false"})
    shape = F.coalesce(geometry.to_geojson(F.col(struct)[shapes[0]]), F.lit("null")) if shapes else F.lit("null")
    return F.concat(
        F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), properties,
        F.lit(',"id":'), F.to_json(F.array(feature_id)).substr(F.lit(2), F.length(F.to_json(F.array(feature_id))) - 2), F.lit("}"),
    )


def change_json(delta: DataFrame, advanced: bool = False, drop_old_of_updates: bool = False) -> Column:
    """``{"-": old, "+": new}`` of a delta, or with the marks ``--`` and ``++`` for whole rows."""
    kind = F.col("change_type")
    old_mark, new_mark = F.lit("-"), F.lit("+")
    if advanced:
        old_mark = F.when(kind == "delete", "--").otherwise("-")
        new_mark = F.when(kind == "insert", "++").otherwise("+")

    def half(mark: Column, struct: str) -> Column:
        return F.concat(F.lit('"'), mark, F.lit('":'), row_json(delta, struct))

    old = half(old_mark, "old")
    if drop_old_of_updates:
        old = F.when(kind != "update", old)
    return F.concat(F.lit("{"), F.concat_ws(",", old, half(new_mark, "new")), F.lit("}"))


def json_records(delta: DataFrame, dataset: str) -> DataFrame:
    """One JSON-lines feature record per delta."""
    line = F.concat(
        F.lit('{"type":"feature","dataset":"' + dataset + '","change":'), change_json(delta), F.lit("}")
    )
    return delta.select("old_key", "new_key", "change_type", line.alias("line"))


def jsonl_diff(
    delta: DataFrame,
    dataset: str,
    schema_json: str,
    meta: DataFrame | None = None,
    files: DataFrame | None = None,
) -> DataFrame:
    """All records of a JSON-lines diff: ``rank`` and ``line``; ranks give their order.

    Header, dataset facts, schema, changed meta items, features, files. No record waits
    for another, so lines can be written as tasks produce them.
    """
    spark = delta.sparkSession
    head = spark.createDataFrame(
        [
            (0, '{"type":"version","version":"' + LINES_TAG + '","outputFormat":"JSONL+hexwkb"}'),
            (1, '{"type":"datasetInfo","path":"' + dataset + '","value":{"type":"table","version":3}}'),
            (2, '{"type":"metaInfo","dataset":"' + dataset + '","key":"schema.json","value":' + schema_json + "}"),
        ],
        "rank int, line string",
    )
    out = head.unionByName(json_records(delta, dataset).select(F.lit(4).alias("rank"), "line"))
    if meta is not None:
        change = F.to_json(F.create_map(F.lit("-"), F.col("old_value"), F.lit("+"), F.col("new_value")))
        line = F.concat(F.lit('{"type":"meta","dataset":"' + dataset + '","key":"'), F.col("item"), F.lit('","change":'), change, F.lit("}"))
        out = out.unionByName(meta.select(F.lit(3).alias("rank"), line.alias("line")))
    if files is not None:
        change = F.to_json(F.create_map(F.lit("-"), F.col("old_value"), F.lit("+"), F.col("new_value")))
        line = F.concat(F.lit('{"type":"file","path":'), _quoted(F.col("path")), F.lit(',"change":'), change, F.lit("}"))
        out = out.unionByName(files.select(F.lit(5).alias("rank"), line.alias("line")))
    return out


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def json_diff(delta: DataFrame, dataset: str, order: Sequence[str | Column], tag: str = DIFF_TAG, advanced: bool = False) -> DataFrame:
    """A nested JSON diff as numbered lines: in order they are one document.

    The document is never assembled in one place: every delta is one line, the first
    without a comma before it.
    """
    body = number_all(delta.withColumn("_line", change_json(delta, advanced)), list(order), "position").select(
        "position", F.concat(F.when(F.col("position") > 1, F.lit(",")).otherwise(F.lit("")), "_line").alias("line")
    )
    spark = delta.sparkSession
    ends = spark.createDataFrame(
        [(0, '{"' + tag + '":{"' + dataset + '":{"feature":[')], "position bigint, line string"
    )
    tail = body.agg((F.coalesce(F.max("position"), F.lit(0)) + 1).alias("position")).select("position", F.lit("]}}}").alias("line"))
    return ends.unionByName(body).unionByName(tail)


def write_ordered(lines: DataFrame, path: str, order: str = "position") -> None:
    """Text files whose parts, in name order, are the document."""
    lines.repartitionByRange(F.col(order)).sortWithinPartitions(order).select("line").write.text(path)


def geojson_features(delta: DataFrame, dataset: str, part: str = "feature") -> DataFrame:
    """One or two GeoJSON features per delta, with ids ``ds:feature:key:{I,D,U-,U+}``."""
    kind = F.col("change_type")
    halves = []
    for struct, key, mark in (("old", "old_key", F.when(kind == "delete", "D").otherwise("U-")), ("new", "new_key", F.when(kind == "insert", "I").otherwise("U+"))):
        fid = F.concat_ws(":", F.lit(dataset), F.lit(part), F.col(key).cast("string"), mark)
        halves.append(F.when(F.col(struct).isNotNull(), F.struct(fid.alias("id"), row_geojson(delta, struct, fid).alias("feature"))))
    return delta.select(F.explode(F.array_compact(F.array(*halves))).alias("_f")).select("_f.id", "_f.feature")


def _field_text(struct: str, name: str, kind: T.DataType, prefix: str) -> Column:
    value = F.col(struct)[name]
    if _is_geometry(kind):
        shown = F.concat(geometry.type_name(value), F.when(value["empty"], " EMPTY").otherwise("(...)"))
    elif isinstance(kind, T.BinaryType):
        shown = F.when(value.isNotNull(), F.lit("BLOB(...)"))
    else:
        shown = value.cast("string")
    label = F.lpad(F.lit(name), 40, " ") if len(name) <= 40 else F.lit(name)
    return F.concat(F.lit(prefix), label, F.lit(" = "), F.coalesce(shown, F.lit(NULL_TEXT)))


def text_diff(delta: DataFrame, dataset: str, part: str = "feature") -> DataFrame:
    """Readable text per delta: whole rows for inserts and deletes, differing fields for updates."""
    old_kind, new_kind = delta.schema["old"].dataType, delta.schema["new"].dataType
    old_types = {f.name: f.dataType for f in old_kind.fields}
    new_types = {f.name: f.dataType for f in new_kind.fields}

    def title(sign: str, key: str) -> Column:
        return F.concat(F.lit(f"{sign} {dataset}:{part}:"), F.col(key).cast("string"))

    def whole(struct: str, types: dict, prefix: str) -> list[Column]:
        return [_field_text(struct, n, t, prefix) for n, t in types.items() if not n.startswith("__")]

    changed: list[Column] = []
    for name in [*old_types, *[n for n in new_types if n not in old_types]]:
        if name.startswith("__"):
            continue
        a = F.col("old")[name] if name in old_types else F.lit(None)
        b = F.col("new")[name] if name in new_types else F.lit(None)
        differs = ~a.eqNullSafe(b)
        if name in old_types:
            changed.append(F.when(differs, _field_text("old", name, old_types[name], "- ")))
        if name in new_types:
            changed.append(F.when(differs, _field_text("new", name, new_types[name], "+ ")))
    kind = F.col("change_type")
    text = (
        F.when(kind == "insert", F.concat_ws("\n", title("+++", "new_key"), *whole("new", new_types, "+ ")))
        .when(kind == "delete", F.concat_ws("\n", title("---", "old_key"), *whole("old", old_types, "- ")))
        .otherwise(F.concat_ws("\n", title("---", "old_key"), title("+++", "new_key"), *changed))
    )
    return delta.select("old_key", "new_key", "change_type", text.alias("text"))


def rows_json(df: DataFrame, pk: str) -> DataFrame:
    """Every row as JSON."""
    packed = df.select(F.col(pk).alias("key"), F.struct(*df.columns).alias("row"))
    return packed.select("key", row_json(packed, "row").alias("json"))


def rows_geojson(df: DataFrame, pk: str) -> DataFrame:
    """Every row as a GeoJSON feature."""
    packed = df.select(F.col(pk).alias("key"), F.struct(*df.columns).alias("row"))
    return packed.select("key", row_geojson(packed, "row", F.col("key").cast("string")).alias("feature"))


def patch_lines(delta: DataFrame, dataset: str, base: str, order: Sequence[str | Column], message: str = "", crs: str | None = None) -> DataFrame:
    """A patch document as numbered lines; updates lose their old half when a system is given."""
    import json

    head = {"base": base, "message": message, **({"crs": crs} if crs else {})}
    text = '{"' + PATCH_TAG + '":' + json.dumps(head) + ',"' + DIFF_TAG + '":{"' + dataset + '":{"feature":['
    lined = delta.withColumn("_line", change_json(delta, True, drop_old_of_updates=crs is not None))
    body = number_all(lined, list(order), "position").select(
        "position", F.concat(F.when(F.col("position") > 1, F.lit(",")).otherwise(F.lit("")), "_line").alias("line")
    )
    start = delta.sparkSession.createDataFrame([(0, text)], "position bigint, line string")
    tail = body.agg((F.coalesce(F.max("position"), F.lit(0)) + 1).alias("position")).select("position", F.lit("]}}}").alias("line"))
    return start.unionByName(body).unionByName(tail)


def json_text(value: Column) -> Column:
    """A text as a JSON string, NULL as NULL."""
    packed = F.to_json(F.array(value))
    return F.when(value.isNotNull(), packed.substr(F.lit(2), F.length(packed) - 2))


def meta_change_json(meta: DataFrame, advanced: bool = False) -> Column:
    """``{"-": old, "+": new}`` of a meta delta; values of ``.json`` items stand there as JSON, others as strings."""
    lone = lambda mark, kind: F.when(F.col("change_type") == kind, mark * 2).otherwise(mark) if advanced else F.lit(mark)

    def half(mark: Column, value: str) -> Column:
        shown = F.when(F.col("item").endswith(".json"), F.col(value)).otherwise(json_text(F.col(value)))
        return F.concat(F.lit('"'), mark, F.lit('":'), shown)

    return F.concat(F.lit("{"), F.concat_ws(",", half(lone("-", "delete"), "old_value"), half(lone("+", "insert"), "new_value")), F.lit("}"))


def document(deltas: dict[str, DataFrame], meta: DataFrame | None = None, *, base: str | None = None, message: str = "", crs: str | None = None) -> DataFrame:
    """A JSON diff, or with ``base`` a patch, of several datasets and their meta items as numbered lines (position, line).

    Each record is a line of its own: of a dataset first its meta items by name, then its features by key.
    Only lines that open a dataset end in ``: {``, so that tasks can read any stretch of a long document.
    Lines are numbered by ranges, so no task holds a whole document. Datasets with meta
    changes alone are in it too; without any change the document is empty but whole.
    """
    import json

    patch = base is not None
    nothing = "dataset string, rank int, number bigint, name string, line string"
    spark = next(iter(deltas.values())).sparkSession if deltas else meta.sparkSession
    lines = spark.createDataFrame([], nothing)
    for name, delta in deltas.items():
        key = F.coalesce("new_key", "old_key")
        numeric = isinstance(delta.schema["new_key"].dataType, T.IntegralType)
        number, text = (key.cast("bigint"), F.lit(None).cast("string")) if numeric else (F.lit(None).cast("bigint"), _key_json(delta, key))
        packed = delta.withColumn("_line", change_json(delta, patch, drop_old_of_updates=crs is not None))
        lines = lines.union(packed.select(F.lit(name), F.lit(5), number, text, "_line"))
    if meta is not None:
        one = F.concat(json_text(F.col("item")), F.lit(":"), meta_change_json(meta, patch))
        lines = lines.union(meta.select("dataset", F.lit(2), F.lit(None).cast("bigint"), "item", one))
    parts = lines.groupBy("dataset").agg(F.max((F.col("rank") == 2).cast("int")).alias("m"), F.max((F.col("rank") == 5).cast("int")).alias("f"))
    one_line = lambda rank, text: F.struct(F.lit(rank).alias("rank"), text.alias("line"))
    has_meta, has_features = F.col("m") == 1, F.col("f") == 1
    frame = F.array(
        one_line(0, F.concat(json_text(F.col("dataset")), F.lit(": {"))),
        F.when(has_meta, one_line(1, F.lit('"meta":{'))), F.when(has_meta, one_line(3, F.lit("}"))),
        F.when(has_features, one_line(4, F.when(has_meta, ',"feature":[').otherwise('"feature":['))), F.when(has_features, one_line(6, F.lit("]"))),
        one_line(7, F.lit("}")),
    )
    frames = parts.select("dataset", F.explode(F.filter(frame, lambda x: x.isNotNull())).alias("x")).select("dataset", "x.rank", F.lit(None).cast("bigint"), F.lit(None).cast("string"), "x.line")
    placed = number_all(lines.union(frames), ["dataset", "rank", "number", "name"], "position")
    # A record takes a comma unless it is the first of its section, a dataset unless it is the first of all.
    section = F.when(F.col("rank") == 0, F.lit("")).otherwise(F.col("dataset"))
    firsts = placed.filter(F.col("rank").isin(0, 2, 5)).groupBy(section.alias("s"), "rank").agg(F.min("position").alias("position")).select("position", F.lit(True).alias("_first"))
    comma = F.when(F.col("rank").isin(0, 2, 5) & F.col("_first").isNull(), F.lit(",")).otherwise(F.lit(""))
    body = placed.join(firsts, "position", "left").select("position", F.concat(comma, "line").alias("line"))
    head = {"base": base, "message": message, **({"crs": crs} if crs else {})}
    start = "{" + (f'"{PATCH_TAG}":{json.dumps(head)},' if patch else "") + f'"{DIFF_TAG}":{{'
    tail = body.agg((F.coalesce(F.max("position"), F.lit(0)) + 1).alias("position")).select("position", F.lit("}}").alias("line"))
    return spark.range(1).select(F.lit(0).cast("bigint").alias("position"), F.lit(start).alias("line")).unionByName(body).unionByName(tail)


def _key_json(delta: DataFrame, key: Column) -> Column:
    return F.to_json(key) if isinstance(delta.schema["new_key"].dataType, T.StructType) else key.cast("string")


def file_delta_text(delta: DataFrame, old: str = "old_content", new: str = "new_content") -> DataFrame:
    """File deltas with their contents inline: ``text:`` for UTF-8 without NUL, else ``base64:``."""
    def shown(name: str) -> Column:
        data = F.col(name)
        binary = ~F.is_valid_utf8(data.cast("string")) | F.hex(data).rlike("^(..)*00")
        return F.when(
            data.isNotNull(),
            F.when(binary, F.concat(F.lit("base64:"), plain_base64(data))).otherwise(F.concat(F.lit("text:"), F.decode(data, "UTF-8"))),
        )

    return delta.withColumns({old: shown(old), new: shown(new)})
