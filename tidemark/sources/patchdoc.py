"""Patch documents and JSON-lines patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.numbering import carried, number_all
from tidemark.operators.patches import parse_changes


def read_documents(docs: DataFrame, row_type: T.StructType, pk: str, dataset: str, text: str = "doc", keep: tuple[str, ...] = ()) -> DataFrame:
    """Feature changes of whole patch documents, one document per row.

    The diff is found by the form of its name, so documents of any writer are read.
    """
    top = F.from_json(text, "map<string,string>")
    body = F.element_at(F.map_values(F.map_filter(top, lambda k, v: k.contains(".diff/"))), 1)
    head = F.element_at(F.map_values(F.map_filter(top, lambda k, v: k.contains(".patch/"))), 1)
    of_dataset = F.element_at(F.from_json(body, "map<string,string>"), dataset)
    features = F.from_json(F.get_json_object(of_dataset, "$.feature"), "array<string>")
    raw = docs.select(
        *keep, F.get_json_object(head, "$.base").alias("base"), F.get_json_object(head, "$.crs").alias("crs"), F.explode(features).alias("change")
    )
    return parse_changes(raw, row_type, pk)


def read_parts(docs: DataFrame, text: str = "doc", keep: tuple[str, ...] = ()) -> DataFrame:
    """All changes of whole documents: ``base, crs, dataset, part, item, change``, one row per meta item and feature.

    ``part`` is ``meta`` or ``feature``; ``item`` names the meta item; ``change`` is JSON. Any number of
    datasets may stand in a document. A part of another name fails the job, so that nothing is
    lost in silence; a document without a diff gives no rows.
    """
    maps = "map<string,string>"
    top = F.from_json(text, maps)
    headed = docs.select(
        *keep,
        F.get(F.map_values(F.map_filter(top, lambda k, v: k.contains(".patch/"))), 0).alias("_head"),
        F.get(F.map_values(F.map_filter(top, lambda k, v: k.contains(".diff/"))), 0).alias("_body"),
    )
    of = headed.select(*keep, F.get_json_object("_head", "$.base").alias("base"), F.get_json_object("_head", "$.crs").alias("crs"), F.explode(F.from_json("_body", maps)).alias("dataset", "_parts"))
    parts = of.select(*keep, "base", "crs", "dataset", F.explode(F.from_json("_parts", maps)).alias("part", "_text"))
    item = lambda name, change: F.struct(name.alias("item"), change.alias("change"))
    meta = F.transform(F.map_entries(F.from_json("_text", maps)), lambda e: item(e["key"], e["value"]))
    feature = F.transform(F.from_json("_text", "array<string>"), lambda x: item(F.lit(None).cast("string"), x))
    unknown = F.raise_error(F.concat(F.lit("unknown part of a document: "), "part")).cast("array<struct<item:string,change:string>>")
    listed = F.when(F.col("part") == "meta", meta).when(F.col("part") == "feature", feature).otherwise(unknown)
    return parts.select(*keep, "base", "crs", "dataset", "part", F.explode(listed).alias("_c")).select(*keep, "base", "crs", "dataset", "part", "_c.item", "_c.change")


def read_laid_document(lines: DataFrame) -> DataFrame:
    """``read_parts`` of one document laid out a record a line, as ``render.document`` writes it.

    ``lines`` has the columns position (unique) and line, in any number of partitions: each line is parsed by
    itself, and which dataset and part it stands in is carried from the lines that open them. A document
    with another layout fails the job.
    """
    line = F.col("line")
    opens, first = line.endswith(": {"), line.startswith("{") & line.endswith(":{")
    bare = F.regexp_replace(line, "^,", "")
    part = F.when(bare == '"meta":{', "meta").when(bare == '"feature":[', "feature").when(opens, "dataset")
    name = F.when(opens, F.from_json(F.concat(F.lit("{"), F.regexp_replace(bare, ": [{]$", ":0}")), "map<string,string>"))
    head = F.when(first, F.from_json(F.concat(line, F.lit("}}")), "map<string,string>"))
    patch = F.get(F.map_values(F.map_filter(head, lambda k, v: k.contains(".patch/"))), 0)
    marked = lines.select("position", "line", part.alias("part"), F.map_keys(name)[0].alias("dataset"), F.get_json_object(patch, "$.base").alias("base"), F.get_json_object(patch, "$.crs").alias("crs"))
    frame = F.col("part").isNotNull() | first | line.isin("}", "]", "}}")
    placed = carried(marked.withColumn("_frame", frame), "position", ["part", "dataset", "base", "crs"]).filter(~F.col("_frame"))
    odd = F.raise_error(F.concat(F.lit("not a record of a document: "), "line")).cast("map<string,string>")
    record = F.when(F.col("part") == "meta", F.from_json(F.concat(F.lit("{"), bare, F.lit("}")), "map<string,string>")).when(F.col("part") == "feature", F.create_map(F.lit(""), bare)).otherwise(odd)
    read = placed.select("base", "crs", "dataset", "part", record.alias("_r"))
    item = F.when(F.col("part") == "meta", F.map_keys("_r")[0])
    return read.select("base", "crs", "dataset", "part", item.alias("item"), F.map_values("_r")[0].alias("change"))


def document_lines(spark: SparkSession, path: str) -> DataFrame:
    """(position, line) of a text file, read in splits: lines are numbered by the start of their split and their place in it."""
    rows = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    return number_all(rows, ["block", "at"]).select("position", "line")


def meta_deltas(parts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``dataset, item, change_type, old_value, new_value`` of the meta part; values of ``.json`` items are JSON text."""
    halves = F.from_json("change", "map<string,string>")
    old, new = (F.coalesce(F.element_at(halves, mark * 2), F.element_at(halves, mark)) for mark in ("-", "+"))
    rows = parts.filter(F.col("part") == "meta").select(*keep, "dataset", "item", old.alias("old_value"), new.alias("new_value"))
    kind = F.when(F.col("old_value").isNull(), "insert").when(F.col("new_value").isNull(), "delete").otherwise("update")
    return rows.select(*keep, "dataset", "item", kind.alias("change_type"), "old_value", "new_value")


def feature_changes(parts: DataFrame, row_type: T.StructType, pk: str, dataset: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parsed feature changes of one dataset of ``read_parts``."""
    raw = parts.filter((F.col("part") == "feature") & (F.col("dataset") == dataset)).select(*keep, "base", "crs", "change")
    return parse_changes(raw, row_type, pk)


def read_document_files(spark: SparkSession, path: str, row_type: T.StructType, pk: str, dataset: str) -> DataFrame:
    docs = spark.read.text(path, wholetext=True).withColumnRenamed("value", "doc")
    return read_documents(docs, row_type, pk, dataset)


def read_lines(spark: SparkSession, path: str, row_type: T.StructType, pk: str, dataset: str) -> DataFrame:
    """Feature changes of a JSON-lines diff, which splits over any number of tasks."""
    lines = spark.read.text(path).select(
        F.get_json_object("value", "$.type").alias("type"),
        F.get_json_object("value", "$.dataset").alias("dataset"),
        F.get_json_object("value", "$.change").alias("change"),
    )
    wanted = lines.filter((F.col("type") == "feature") & (F.col("dataset") == dataset)).select("change")
    return parse_changes(wanted, row_type, pk)
