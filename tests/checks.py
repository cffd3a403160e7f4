"""Compare a query with its SQL twin: names, types, and rows regardless of order."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os

import duckdb

FAMILY = {
    "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float", "double": "double",
    "string": "text", "boolean": "bool", "binary": "bytes", "date": "date", "timestamp": "ts", "timestamp_ntz": "ts",
    "TINYINT": "int8", "SMALLINT": "int16", "INTEGER": "int32", "BIGINT": "int64", "FLOAT": "float", "DOUBLE": "double",
    "VARCHAR": "text", "BOOLEAN": "bool", "BLOB": "bytes", "DATE": "date", "TIMESTAMP": "ts",
    "TIMESTAMP WITH TIME ZONE": "ts", "HUGEINT": "int128",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return repr(v + 0.0) if v == v else "nan"
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> list[str]:
    """Differences, an empty list when both agree."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    theirs = rel.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    for name, kind in df.dtypes:
        a, b = (FAMILY.get(k, k).lower() for k in (kind, described[name]))
        if a != b:
            problems.append(f"type of {name}: {kind} vs {described[name]}")
    ours = [tuple(r) for r in df.collect()]
    a, b = rows_of(df.columns, ours), rows_of(names, theirs)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} vs {len(b)}")
    if a != b:
        sa, sb = set(a), set(b)
        problems.append(f"only here {sorted(sa - sb)[:2]} only twin {sorted(sb - sa)[:2]}")
    return problems
