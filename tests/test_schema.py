import pytest

from tidemark.operators.schemas import violations
from tidemark.schema import ColumnSpec, VersionedSchema, database_column, file_source_type


def schema(*cols):
    return VersionedSchema(tuple(ColumnSpec(*c) for c in cols))


def test_align_by_name_then_position():
    old = schema(("1", "ID", "integer", 0), ("2", "first_name", "text"), ("3", "last_name", "text"), ("4", "date_of_birth", "date"))
    new = schema(("a", "personnel_id", "integer", 0), ("b", "tax_file_number", "text"), ("c", "last_name", "text"), ("d", "first_name", "text"), ("e", "middle_names", "text"))
    got = {c.name: c.id for c in old.align(new).columns}
    assert got == {"personnel_id": "1", "tax_file_number": "b", "last_name": "3", "first_name": "2", "middle_names": "e"}
    assert old.pk_compatible(old.align(new))


def test_key_positions_must_be_contiguous():
    with pytest.raises(ValueError):
        schema(("1", "a", "integer", 1))


VALUES = [
    ("date", {}, "2020-01-01", "20-1-1"),
    ("time", {}, "10:20:30.5Z", "10:20"),
    ("timestamp", {}, "2020-01-01T10:20:30Z", "2020-01-01 10:20:30"),
    ("interval", {}, "P1Y2M3DT4H5M6.5S", "1 year"),
    ("text", {"length": 3}, "é€a", "abcd"),
]


@pytest.mark.parametrize("kind,info,good,bad", VALUES)
def test_text_rules(spark, kind, info, good, bad):
    s = VersionedSchema((ColumnSpec("1", "k", "integer", 0), ColumnSpec("2", "v", kind, None, info)))
    df = spark.createDataFrame([(1, good), (2, bad), (3, None)], "k long, v string")
    assert [r.key for r in violations(df, s).collect()] == ["2"]


def test_ranges_and_bytes(spark):
    s = VersionedSchema((ColumnSpec("1", "k", "integer", 0, {"size": 8}), ColumnSpec("2", "b", "blob", None, {"length": 2})))
    df = spark.createDataFrame([(-128, bytearray(b"ab")), (127, bytearray(b"abc")), (128, None), (-129, None)], "k long, b binary")
    assert sorted((r.key, r.column) for r in violations(df, s).collect()) == [("-129", "k"), ("127", "b"), ("128", "k")]


def test_database_types():
    c = database_column("postgresql", "v", "VARCHAR(40)")
    assert (c.data_type, c.info) == ("text", {"length": 40})
    assert database_column("mysql", "n", "NUMERIC(10,2)").info == {"precision": 10, "scale": 2}
    assert database_column("sqlserver", "t", "DATETIMEOFFSET").info["timezone"] == "UTC"
    with pytest.raises(ValueError):
        database_column("gpkg", "x", "POLYHEDRON")


def test_file_types():
    assert file_source_type("GPKG", "Real", 10, 2)["dataType"] == "numeric"
    assert file_source_type("ESRI Shapefile", "Real", 24, 15) == {"dataType": "float", "size": 64}
    assert file_source_type("ESRI Shapefile", "Integer", 9)["size"] == 32
    assert file_source_type("ESRI Shapefile", "Integer", 4)["dataType"] == "numeric"


def test_jdbc_options():
    from tidemark.sources.tables import jdbc_options

    o = jdbc_options("postgresql", "jdbc:postgresql://h/db", "t", "id", (1, 99), 8)
    assert (o["partitionColumn"], o["lowerBound"], o["upperBound"], o["numPartitions"]) == ("id", "1", "100", "8")
