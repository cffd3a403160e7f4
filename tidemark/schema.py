"""Versioned schemas: columns keep a stable id through renames, moves and type changes."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column types and their Spark counterparts (fixed values). Types with a size, a
#: precision or a time zone are completed in :func:`spark_type`.
DATA_TYPES = {
    "boolean": T.BooleanType(),
    "blob": T.BinaryType(),
    "date": T.DateType(),
    "float": T.DoubleType(),
    "geometry": T.BinaryType(),
    "integer": T.LongType(),
    "interval": T.StringType(),
    "numeric": T.DecimalType(38, 18),
    "text": T.StringType(),
    "time": T.StringType(),
    "timestamp": T.TimestampNTZType(),
}


@dataclass(frozen=True)
class ColumnSpec:
    id: str
    name: str
    data_type: str
    pk_index: int | None = None
    info: dict[str, Any] = field(default_factory=dict, hash=False)

    def facts(self) -> dict[str, Any]:
        """Type and its details, without id, name and key position."""
        return {"dataType": self.data_type, **{k: v for k, v in self.info.items() if v is not None}}

    def to_dict(self) -> dict[str, Any]:
        out = {"id": self.id, "name": self.name, "dataType": self.data_type}
        if self.pk_index is not None:
            out["primaryKeyIndex"] = self.pk_index
        return {**out, **{k: v for k, v in self.info.items() if v is not None}}

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> ColumnSpec:
        info = {k: v for k, v in raw.items() if k not in ("id", "name", "dataType", "primaryKeyIndex")}
        return cls(raw["id"], raw["name"], raw["dataType"], raw.get("primaryKeyIndex"), info)


def spark_type(col: ColumnSpec) -> T.DataType:
    if col.data_type == "integer":
        return {8: T.ByteType(), 16: T.ShortType(), 32: T.IntegerType()}.get(col.info.get("size"), T.LongType())
    if col.data_type == "float":
        return T.FloatType() if col.info.get("size") == 32 else T.DoubleType()
    if col.data_type == "numeric" and col.info.get("precision"):
        return T.DecimalType(col.info["precision"], col.info.get("scale") or 0)
    if col.data_type == "timestamp":
        return T.TimestampType() if col.info.get("timezone") == "UTC" else T.TimestampNTZType()
    return DATA_TYPES[col.data_type]


def deterministic_id(salt: str, name: str, facts: dict[str, Any]) -> str:
    """A column id made from a salt and the column's facts, in the shape of a UUID."""
    text = json.dumps([salt, name, facts], sort_keys=True)
    h = hashlib.sha256(text.encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"


@dataclass(frozen=True)
class VersionedSchema:
    columns: tuple[ColumnSpec, ...]

    def __post_init__(self) -> None:
        ids = [c.id for c in self.columns]
        names = [c.name for c in self.columns]
        if len(set(ids)) != len(ids) or len(set(names)) != len(names):
            raise ValueError("column ids and names must be unique")
        keys = sorted(c.pk_index for c in self.columns if c.pk_index is not None)
        if keys != list(range(len(keys))):
            raise ValueError(f"primary key positions must be 0..n-1, got {keys}")

    @property
    def pk(self) -> list[str]:
        cols = [c for c in self.columns if c.pk_index is not None]
        return [c.name for c in sorted(cols, key=lambda c: c.pk_index)]

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def by_id(self) -> dict[str, ColumnSpec]:
        return {c.id: c for c in self.columns}

    def to_json(self) -> str:
        return json.dumps([c.to_dict() for c in self.columns])

    @classmethod
    def from_json(cls, text: str) -> VersionedSchema:
        return cls(tuple(ColumnSpec.from_dict(c) for c in json.loads(text)))

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, spark_type(c), True, {"id": c.id}) for c in self.columns])

    @classmethod
    def infer(cls, df: DataFrame, pk: list[str], salt: str = "") -> VersionedSchema:
        """Schema of a DataFrame; ids are taken from field metadata, else made from the facts."""
        cols = []
        for f in df.schema.fields:
            data_type, info = _type_facts(f.dataType)
            cid = f.metadata.get("id") or deterministic_id(salt, f.name, {"dataType": data_type, **info})
            cols.append(ColumnSpec(cid, f.name, data_type, pk.index(f.name) if f.name in pk else None, info))
        return cls(tuple(cols))

    def align(self, other: VersionedSchema) -> VersionedSchema:
        """``other`` with ids taken from here for columns that are the same column.

        First by name and type (a moved column), then by position and type (a renamed one).
        """
        ids: dict[int, str] = {}
        used: set[str] = set()

        def match(old: ColumnSpec | None, at: int) -> None:
            new = other.columns[at]
            if old is None or at in ids or old.id in used:
                return
            if old.pk_index == new.pk_index and same_type(old, new):
                ids[at] = old.id
                used.add(old.id)

        by_name = {c.name: c for c in self.columns}
        for at, col in enumerate(other.columns):
            match(by_name.get(col.name), at)
        for at, old in enumerate(self.columns[: len(other.columns)]):
            match(old, at)
        return VersionedSchema(tuple(replace(c, id=ids.get(i, c.id)) for i, c in enumerate(other.columns)))

    def pk_compatible(self, other: VersionedSchema) -> bool:
        def keys(s: VersionedSchema) -> list[str]:
            found = [c for c in s.columns if c.pk_index is not None]
            return [c.id for c in sorted(found, key=lambda c: c.pk_index)]

        return keys(self) == keys(other)

    def to_storage(self, df: DataFrame) -> DataFrame:
        """Rows with physical columns named by column id."""
        return df.select(*[F.col(c.name).alias(c.id) for c in self.columns])

    def read(self, stored: DataFrame) -> DataFrame:
        """Stored rows of any earlier schema seen through this one.

        Dropped columns vanish, columns that did not exist yet are NULL; one projection,
        so the scan reads only what the current schema names.
        """
        have = set(stored.columns)
        cols = []
        for c in self.columns:
            kind = spark_type(c)
            value = F.col(f"`{c.id}`").cast(kind) if c.id in have else F.lit(None).cast(kind)
            cols.append(value.alias(c.name))
        return stored.select(*cols)


#: Types whose details a file or database store may change without the user asking (fixed values).
APPROXIMATED = {
    ("interval", "text"),
    ("time", "text"),
    ("numeric", "text"),
}


def same_type(old: ColumnSpec, new: ColumnSpec) -> bool:
    return old.data_type == new.data_type or (old.data_type, new.data_type) in APPROXIMATED


def _type_facts(kind: T.DataType) -> tuple[str, dict[str, Any]]:
    sizes = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
    for cls, size in sizes.items():
        if isinstance(kind, cls):
            return "integer", {"size": size}
    if isinstance(kind, T.FloatType):
        return "float", {"size": 32}
    if isinstance(kind, T.DoubleType):
        return "float", {"size": 64}
    if isinstance(kind, T.DecimalType):
        return "numeric", {"precision": kind.precision, "scale": kind.scale}
    if isinstance(kind, T.TimestampType):
        return "timestamp", {"timezone": "UTC"}
    plain = {
        T.BooleanType: "boolean",
        T.BinaryType: "blob",
        T.DateType: "date",
        T.StringType: "text",
        T.TimestampNTZType: "timestamp",
    }
    for cls, name in plain.items():
        if isinstance(kind, cls):
            return name, {}
    raise ValueError(f"no column type for {kind.simpleString()}")


#: Type names of four databases and the column types they map to (fixed values).
DATABASE_TYPES: dict[str, dict[str, dict[str, Any]]] = {
    "gpkg": {
        "BOOLEAN": {"dataType": "boolean"},
        "BLOB": {"dataType": "blob"},
        "DATE": {"dataType": "date"},
        "FLOAT": {"dataType": "float", "size": 32},
        "DOUBLE": {"dataType": "float", "size": 64},
        "REAL": {"dataType": "float", "size": 64},
        "TINYINT": {"dataType": "integer", "size": 8},
        "SMALLINT": {"dataType": "integer", "size": 16},
        "MEDIUMINT": {"dataType": "integer", "size": 32},
        "INT": {"dataType": "integer", "size": 64},
        "INTEGER": {"dataType": "integer", "size": 64},
        "TEXT": {"dataType": "text"},
        "DATETIME": {"dataType": "timestamp", "timezone": "UTC"},
    },
    "postgresql": {
        "BOOLEAN": {"dataType": "boolean"},
        "SMALLINT": {"dataType": "integer", "size": 16},
        "INTEGER": {"dataType": "integer", "size": 32},
        "BIGINT": {"dataType": "integer", "size": 64},
        "REAL": {"dataType": "float", "size": 32},
        "DOUBLE PRECISION": {"dataType": "float", "size": 64},
        "BYTEA": {"dataType": "blob"},
        "CHARACTER VARYING": {"dataType": "text"},
        "VARCHAR": {"dataType": "text"},
        "TEXT": {"dataType": "text"},
        "DATE": {"dataType": "date"},
        "TIME": {"dataType": "time"},
        "TIMETZ": {"dataType": "time", "timezone": "UTC"},
        "TIMESTAMP": {"dataType": "timestamp"},
        "TIMESTAMPTZ": {"dataType": "timestamp", "timezone": "UTC"},
        "INTERVAL": {"dataType": "interval"},
        "NUMERIC": {"dataType": "numeric"},
        "GEOMETRY": {"dataType": "geometry"},
    },
    "mysql": {
        "BIT": {"dataType": "boolean"},
        "TINYINT": {"dataType": "integer", "size": 8},
        "SMALLINT": {"dataType": "integer", "size": 16},
        "INT": {"dataType": "integer", "size": 32},
        "BIGINT": {"dataType": "integer", "size": 64},
        "FLOAT": {"dataType": "float", "size": 32},
        "DOUBLE": {"dataType": "float", "size": 64},
        "DOUBLE PRECISION": {"dataType": "float", "size": 64},
        "NUMERIC": {"dataType": "numeric"},
        "DECIMAL": {"dataType": "numeric"},
        "BLOB": {"dataType": "blob"},
        "LONGBLOB": {"dataType": "blob"},
        "VARBINARY": {"dataType": "blob"},
        "CHAR": {"dataType": "text"},
        "VARCHAR": {"dataType": "text"},
        "TEXT": {"dataType": "text"},
        "LONGTEXT": {"dataType": "text"},
        "DATE": {"dataType": "date"},
        "TIME": {"dataType": "time"},
        "DATETIME": {"dataType": "timestamp"},
        "TIMESTAMP": {"dataType": "timestamp", "timezone": "UTC"},
        "GEOMETRY": {"dataType": "geometry"},
    },
    "sqlserver": {
        "BIT": {"dataType": "boolean"},
        "TINYINT": {"dataType": "integer", "size": 8},
        "SMALLINT": {"dataType": "integer", "size": 16},
        "INT": {"dataType": "integer", "size": 32},
        "BIGINT": {"dataType": "integer", "size": 64},
        "REAL": {"dataType": "float", "size": 32},
        "FLOAT": {"dataType": "float", "size": 64},
        "NUMERIC": {"dataType": "numeric"},
        "DECIMAL": {"dataType": "numeric"},
        "VARBINARY": {"dataType": "blob"},
        "BINARY": {"dataType": "blob"},
        "CHAR": {"dataType": "text"},
        "VARCHAR": {"dataType": "text"},
        "NCHAR": {"dataType": "text"},
        "NVARCHAR": {"dataType": "text"},
        "TEXT": {"dataType": "text"},
        "DATE": {"dataType": "date"},
        "TIME": {"dataType": "time"},
        "DATETIME": {"dataType": "timestamp"},
        "DATETIME2": {"dataType": "timestamp"},
        "DATETIMEOFFSET": {"dataType": "timestamp", "timezone": "UTC"},
        "GEOMETRY": {"dataType": "geometry"},
        "GEOGRAPHY": {"dataType": "geometry"},
    },
}


def database_column(store: str, name: str, sql_type: str, pk_index: int | None = None, salt: str = "") -> ColumnSpec:
    """Column spec of a database column such as ``VARCHAR(40)`` or ``NUMERIC(10,2)``."""
    m = re.fullmatch(r"\s*([A-Za-z ]+?)\s*(?:\((\d+|max)(?:\s*,\s*(\d+))?\))?\s*", sql_type)
    base = m.group(1).upper() if m else sql_type.upper()
    known = DATABASE_TYPES[store].get(base)
    if known is None:
        raise ValueError(f"no column type for {store} type {sql_type}")
    info = {k: v for k, v in known.items() if k != "dataType"}
    if m and m.group(2) and m.group(2).lower() != "max":
        if known["dataType"] in ("text", "blob"):
            info["length"] = int(m.group(2))
        elif known["dataType"] == "numeric":
            info["precision"] = int(m.group(2))
            info["scale"] = int(m.group(3) or 0)
    return ColumnSpec(deterministic_id(salt, name, {"dataType": known["dataType"], **info}), name, known["dataType"], pk_index, info)


#: Field widths shapefiles always report; they do not make a field a decimal (fixed values).
SHAPEFILE_WIDTHS = {"Real": {(24, 15)}, "Integer": {(5, 0), (9, 0), (10, 0)}, "Integer64": {(18, 0), (19, 0), (20, 0)}}

#: Field kinds of vector files and their column types (fixed values).
FILE_TYPES = {
    "Boolean": {"dataType": "boolean"},
    "Int16": {"dataType": "integer", "size": 16},
    "Integer": {"dataType": "integer", "size": 32},
    "Integer64": {"dataType": "integer", "size": 64},
    "Float32": {"dataType": "float", "size": 32},
    "Real": {"dataType": "float", "size": 64},
    "String": {"dataType": "text"},
    "Binary": {"dataType": "blob"},
    "Date": {"dataType": "date"},
    "Time": {"dataType": "time"},
    "DateTime": {"dataType": "timestamp"},
}


def file_source_type(driver: str, kind: str, width: int = 0, precision: int = 0) -> dict[str, Any]:
    """Typing rule for fields of vector files: a number with a declared width is a decimal."""
    if kind in SHAPEFILE_WIDTHS and width:
        usual = driver == "ESRI Shapefile" and (width, precision) in SHAPEFILE_WIDTHS[kind]
        if not usual:
            return {"dataType": "numeric", "precision": width, "scale": precision}
    out = dict(FILE_TYPES[kind])
    if kind == "String" and width:
        out["length"] = width
    return out


#: Point record formats: length in bytes and the format a cloud-optimised copy uses (fixed values).
POINT_FORMATS = [
    {"pdrf": 0, "length": 20, "copc_pdrf": 6},
    {"pdrf": 1, "length": 28, "copc_pdrf": 6},
    {"pdrf": 2, "length": 26, "copc_pdrf": 7},
    {"pdrf": 3, "length": 34, "copc_pdrf": 7},
    {"pdrf": 6, "length": 30, "copc_pdrf": 6},
    {"pdrf": 7, "length": 36, "copc_pdrf": 7},
    {"pdrf": 8, "length": 38, "copc_pdrf": 8},
]

#: Raster sample types (fixed values).
BAND_TYPES = {
    "Byte": {"dataType": "integer", "size": 8, "unsigned": True},
    "Int8": {"dataType": "integer", "size": 8},
    "Int16": {"dataType": "integer", "size": 16},
    "Int32": {"dataType": "integer", "size": 32},
    "Int64": {"dataType": "integer", "size": 64},
    "UInt16": {"dataType": "integer", "size": 16, "unsigned": True},
    "UInt32": {"dataType": "integer", "size": 32, "unsigned": True},
    "UInt64": {"dataType": "integer", "size": 64, "unsigned": True},
    "Float32": {"dataType": "float", "size": 32},
    "Float64": {"dataType": "float", "size": 64},
    "CInt16": {"dataType": "integer", "size": 16, "complex": True},
    "CInt32": {"dataType": "integer", "size": 32, "complex": True},
    "CFloat32": {"dataType": "float", "size": 32, "complex": True},
    "CFloat64": {"dataType": "float", "size": 64, "complex": True},
}
