"""Tables of databases and files as typed, keyed DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geometry, timetext
from tidemark.schema import ColumnSpec, VersionedSchema, database_column, spark_type

#: JDBC drivers of the supported databases (fixed values); their jars come with the cluster.
DRIVERS = {
    "gpkg": "org.sqlite.JDBC",
    "postgresql": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
}


def jdbc_options(store: str, url: str, table: str, pk: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 64) -> dict[str, str]:
    """Reader options; with the key's bounds the table is read in parallel by key range."""
    options = {"url": url, "dbtable": table, "driver": DRIVERS[store], "fetchsize": "10000"}
    if pk and bounds:
        options |= {
            "partitionColumn": pk, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1] + 1), "numPartitions": str(parts),
        }
    return options


def read_jdbc(spark: SparkSession, store: str, url: str, table: str, schema: VersionedSchema, parts: int = 64) -> DataFrame:
    """A database table or view, split over its integer key when it has one."""
    pk = schema.pk[0] if len(schema.pk) == 1 else None
    keyed = pk is not None and next(c for c in schema.columns if c.name == pk).data_type == "integer"
    bounds = None
    if keyed:
        ends = f"(SELECT MIN({pk}) AS lo, MAX({pk}) AS hi FROM {table}) ends"
        row = spark.read.format("jdbc").options(**jdbc_options(store, url, ends)).load().first()
        bounds = (int(row[0]), int(row[1])) if row and row[0] is not None else None
    raw = spark.read.format("jdbc").options(**jdbc_options(store, url, table, pk, bounds, parts)).load()
    return conform(raw, schema)


def list_jdbc_tables(spark: SparkSession, store: str, url: str) -> DataFrame:
    query = (
        "(SELECT table_name AS name, identifier AS title FROM gpkg_contents) t"
        if store == "gpkg"
        else "(SELECT table_name AS name, NULL AS title FROM information_schema.tables) t"
    )
    return spark.read.format("jdbc").options(**jdbc_options(store, url, query)).load()


def schema_of_columns(store: str, columns: list[tuple[str, str]], pk: list[str], salt: str = "") -> VersionedSchema:
    """Schema from ``(name, SQL type)`` pairs."""
    return VersionedSchema(
        tuple(database_column(store, n, t, pk.index(n) if n in pk else None, salt) for n, t in columns)
    )


def conform(df: DataFrame, schema: VersionedSchema) -> DataFrame:
    """Source rows as the stored form of their column types."""
    held = dict(df.dtypes)
    return df.select(*[_stored(c, F.col(c.name), held[c.name]).alias(c.name) for c in schema.columns])


def _stored(c: ColumnSpec, value: Column, held: str) -> Column:
    if c.data_type == "date" and held == "string":
        return F.to_date(timetext.stored_date(value))
    if c.data_type == "numeric":
        return value.cast(spark_type(c))
    if c.data_type in ("time", "interval"):
        return value.cast("string")
    if c.data_type == "timestamp" and held == "string":
        return F.to_timestamp(timetext.stored_timestamp(value)).cast(spark_type(c))
    return value if c.data_type == "geometry" else value.cast(spark_type(c))


def read_features(
    df: DataFrame, fields: dict[str, dict], geometry_text: str | None = None, promote: bool = False
) -> DataFrame:
    """Rows of a vector file by its typing rules; lines and polygons may become their multi kinds."""
    cols = []
    for name, facts in fields.items():
        spec = ColumnSpec(name, name, facts["dataType"], None, {k: v for k, v in facts.items() if k != "dataType"})
        cols.append(_stored(spec, F.col(name), dict(df.dtypes)[name]).alias(name))
    if geometry_text:
        shape = geometry.from_wkt(F.col(geometry_text))
        cols.append((geometry.promote(shape) if promote else shape).alias("geom"))
    return df.select(*cols)
