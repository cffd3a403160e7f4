"""Patches are applied as a whole or not at all."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from tidemark.operators import patches

ROW = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType()), T.StructField("n", T.LongType())])


def parsed(spark, *changes):
    return patches.parse_changes(spark.createDataFrame([(c,) for c in changes], "change string"), ROW, "k")


def table(spark, *rows):
    return spark.createDataFrame(list(rows), ROW)


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ('{"*":{"k":1}}', "star"), ('{"++":{"k":1,"v":"a","n":1},"--":{"k":1,"v":"a","n":1}}', "both"), ("no json", "no JSON"), ("{}", "empty"),
        ('{"+":{"v":"a"}}', "key"), ('{"+":{"k":1,"v":"a","n":1,"extra":5}}', "unknown fields: extra"),
    ],
)
def test_one_invalid_change_fails_the_patch(spark, change, reason):
    p = parsed(spark, '{"+":{"k":7,"v":"a","n":1}}', change)
    assert [r.invalid for r in p.collect() if r.invalid and reason in r.invalid]
    with pytest.raises(PySparkException, match="invalid change"):
        patches.apply_checked(patches.as_delta(p, "k"), table(spark, (1, "a", 1)), "k").collect()


def test_lone_plus_is_filled_from_the_base(spark):
    rows = table(spark, (1, "a", 10), (2, "b", 20))
    delta = patches.as_delta(parsed(spark, '{"+":{"k":1}}', '{"+":{"k":2,"n":21}}'), "k")
    out = {tuple(r) for r in patches.apply_checked(delta, rows, "k", base=rows).collect()}
    assert out == {(1, "a", 10), (2, "b", 21)}


def test_partial_rows_without_a_base_are_a_conflict(spark):
    delta = patches.as_delta(parsed(spark, '{"+":{"k":5}}'), "k")
    for base in (None, table(spark, (1, "a", 10))):
        with pytest.raises(Exception):
            patches.apply_checked(delta, table(spark, (1, "a", 10)), "k", base=base).collect()


def test_partial_update_is_checked_against_whole_rows(spark):
    base = table(spark, (1, "a", 10))
    delta = patches.as_delta(parsed(spark, '{"-":{"k":1,"v":"a"},"+":{"k":1,"v":"z"}}'), "k")
    assert [tuple(r) for r in patches.apply_checked(delta, base, "k", base=base).collect()] == [(1, "z", 10)]
    with pytest.raises(Exception):
        patches.apply_checked(delta, table(spark, (1, "a", 11)), "k", base=base).collect()


def test_documents_with_meta_items(spark, tmp_path):
    """Written, read as one JSON value and line by line from a file: the same records."""
    from tidemark.operators import diffing
    from tidemark.sinks import render
    from tidemark.sources import patchdoc

    a = spark.createDataFrame([(1, "x"), (2, 'quote " and \n break')], "k long, v string")
    b = spark.createDataFrame([(2, "y"), (3, None)], "k long, v string")
    texts = spark.createDataFrame([("p", "q")], "id string, meta string")
    meta = spark.createDataFrame(
        [("a/t", "title", "update", "Old", 'New "title", with {braces}'), ("a/t", "schema.json", "update", "[1]", "[1,2]"), ("only meta", "description", "delete", "gone", None), ("meta", "tags", "insert", None, "")],
        "dataset string, item string, change_type string, old_value string, new_value string",
    )
    for base in (None, "v1"):
        lines = render.document({"a/t": diffing.diff(a, b, ["k"]), "feature": diffing.all_rows(texts, ["id"], "insert")}, meta, base=base)
        text = "\n".join(r.line for r in lines.orderBy("position").collect())
        whole = patchdoc.read_parts(spark.createDataFrame([(text,)], "doc string"))
        path = tmp_path / f"{base}.json"
        path.write_text(text)
        laid = patchdoc.read_laid_document(patchdoc.document_lines(spark, str(path)))
        as_set = lambda d: sorted(map(str, d.collect()))
        assert as_set(laid) == as_set(whole.select(*laid.columns)) and laid.count() == 8
        assert as_set(patchdoc.meta_deltas(laid)) == as_set(meta)
        kind = a.schema
        d = patches.as_delta(patchdoc.feature_changes(laid, kind, "k", "a/t"), "k")
        assert {(r.old_key, r.new_key, r.change_type) for r in d.collect()} == {(1, None, "delete"), (2, 2, "update"), (None, 3, "insert")}
        assert {r.base for r in laid.select("base").collect()} == {base}


def test_unknown_parts_of_documents_fail(spark):
    from tidemark.sources import patchdoc

    text = '{"tidemark.diff/v1+hexwkb":{"d":{"feature":[],"other":[1]}}}'
    with pytest.raises(Exception, match="unknown part"):
        patchdoc.read_parts(spark.createDataFrame([(text,)], "doc string")).collect()


def test_empty_documents(spark):
    from tidemark.operators import diffing
    from tidemark.sinks import render
    from tidemark.sources import patchdoc

    a = spark.createDataFrame([(1, "x")], "k long, v string")
    lines = render.document({"t": diffing.diff(a, a, ["k"])})
    text = "".join(r.line for r in lines.orderBy("position").collect())
    assert text == '{"tidemark.diff/v1+hexwkb":{}}'
    assert patchdoc.read_laid_document(lines).count() == 0
