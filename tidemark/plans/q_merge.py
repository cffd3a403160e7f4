"""Three-way merges of ``orders`` and their conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import aggregates, merging, ordering
from tidemark.plans import fixtures as fx
from tidemark.plans.q_diff import PK
from tidemark.plans.registry import query
from tidemark.sinks import render

C = fx.ORDER_COLUMNS


def _row(alias: str) -> str:
    return "(" + ", ".join(f"{alias}.{c}" for c in C) + ")"


def _struct(alias: str) -> str:
    return "CASE WHEN " + f"{alias}.o_orderkey IS NOT NULL THEN struct_pack(" + ", ".join(f"{c} := {alias}.{c}" for c in C) + ") END"


#: The merge written as two outer joins over whole-row structs.
MERGED = fx.ctes(
    ours=fx.OURS,
    theirs=fx.THEIRS,
    joined=f"""SELECT coalesce(a.o_orderkey, o.o_orderkey, t.o_orderkey) AS key, {_struct('a')} AS a, {_struct('o')} AS o, {_struct('t')} AS t
FROM orders a FULL OUTER JOIN ours o ON a.o_orderkey = o.o_orderkey FULL OUTER JOIN theirs t ON coalesce(a.o_orderkey, o.o_orderkey) = t.o_orderkey""",
    merged="""SELECT key, a, o, t, CASE WHEN o IS NOT DISTINCT FROM a AND t IS NOT DISTINCT FROM a THEN 'unchanged' WHEN o IS NOT DISTINCT FROM t THEN 'same_change'
 WHEN t IS NOT DISTINCT FROM a THEN 'ours' WHEN o IS NOT DISTINCT FROM a THEN 'theirs' WHEN a IS NULL THEN 'conflict_insert_insert'
 WHEN o IS NULL OR t IS NULL THEN 'conflict_edit_delete' ELSE 'conflict_edit_edit' END AS outcome FROM joined""",
)


def merged(spark, sf):
    return merging.merge(fx.orders(spark, sf), fx.ours(spark, sf), fx.theirs(spark, sf), PK)


@query("JOI4", MERGED + "SELECT key, a.o_totalprice AS a_price, o.o_totalprice AS o_price, t.o_totalprice AS t_price FROM merged")
def joi4(spark, sf):
    rows = merging.three_way(fx.orders(spark, sf), fx.ours(spark, sf), fx.theirs(spark, sf), PK)
    return rows.select(
        "key", F.col("ancestor.o_totalprice").alias("a_price"), F.col("ours.o_totalprice").alias("o_price"), F.col("theirs.o_totalprice").alias("t_price")
    )


@query("MRG3", MERGED + "SELECT key, outcome FROM merged")
def mrg3(spark, sf):
    return merged(spark, sf).select("key", "outcome")


@query(
    "MRG4",
    MERGED + "SELECT 'orders:feature:' || CAST(key AS STRING) AS label, outcome, a.o_orderstatus AS a_status, o.o_orderstatus AS o_status, t.o_orderstatus AS t_status FROM merged WHERE outcome LIKE 'conflict%'",
)
def mrg4(spark, sf):
    found = merging.conflicts(merged(spark, sf))
    return found.select(
        merging.label("orders").alias("label"), "outcome", F.col("ancestor.o_orderstatus").alias("a_status"),
        F.col("ours.o_orderstatus").alias("o_status"), F.col("theirs.o_orderstatus").alias("t_status"),
    )


@query(
    "MRG5",
    MERGED
    + " UNION ALL ".join(
        f"SELECT 'orders:feature:' || CAST(key AS STRING) || ':{v}' AS label, {s}.o_totalprice AS price FROM merged WHERE outcome LIKE 'conflict%' AND {s} IS NOT NULL"
        for v, s in (("ancestor", "a"), ("ours", "o"), ("theirs", "t"))
    ),
)
def mrg5(spark, sf):
    flat = merging.flatten(merging.conflicts(merged(spark, sf)), "orders")
    return flat.select("label", F.col("row.o_totalprice").alias("price"))


@query(
    "MRG6",
    MERGED
    + " UNION ALL ".join(
        f"SELECT 'orders:feature:' || CAST(key AS STRING) || ':{v}' AS id, 'Feature' AS type, {s}.o_custkey AS o_custkey, {s}.o_orderpriority AS o_orderpriority FROM merged WHERE outcome LIKE 'conflict%' AND {s} IS NOT NULL"
        for v, s in (("ancestor", "a"), ("ours", "o"), ("theirs", "t"))
    ),
)
def mrg6(spark, sf):
    """Conflicts as GeoJSON features, one per version, read back."""
    flat = merging.flatten(merging.conflicts(merged(spark, sf)), "orders")
    feature = flat.select(render.row_geojson(flat, "row", F.col("label")).alias("f"))
    return feature.select(
        F.get_json_object("f", "$.id").alias("id"), F.get_json_object("f", "$.type").alias("type"),
        F.get_json_object("f", "$.properties.o_custkey").cast("bigint").alias("o_custkey"),
        F.get_json_object("f", "$.properties.o_orderpriority").alias("o_orderpriority"),
    )


@query("AGG7", MERGED + "SELECT 'orders' AS dataset, 'feature' AS part, CAST(count(*) AS BIGINT) AS conflicts FROM merged WHERE outcome LIKE 'conflict%'")
def agg7(spark, sf):
    found = merging.conflicts(merged(spark, sf)).select(F.lit("orders").alias("dataset"), F.lit("feature").alias("part"), "key")
    return aggregates.conflict_counts(found, ["dataset", "part"])


@query("AGG7_KEYS", MERGED + "SELECT 'orders' AS dataset, 'feature' AS part, key FROM merged WHERE outcome LIKE 'conflict%'")
def agg7_keys(spark, sf):
    found = merging.conflicts(merged(spark, sf)).select(F.lit("orders").alias("dataset"), F.lit("feature").alias("part"), "key")
    return aggregates.conflict_keys(found, ["dataset", "part"], "key")


LABELS = """SELECT lang AS dataset, CASE WHEN doc_id % 4 = 0 THEN 'meta' ELSE 'feature' END AS part,
 CASE WHEN doc_id % 4 = 0 THEN 'schema.json' || CAST(doc_id AS STRING) WHEN doc_id % 4 = 1 THEN CAST(doc_id AS STRING) WHEN doc_id % 4 = 2 THEN 'k' || CAST(doc_id AS STRING)
 ELSE CAST(doc_id AS STRING) || ',' || source END AS key FROM documents"""


@query(
    "ORD3",
    fx.ctes(labels_=LABELS)
    + """SELECT dataset, part, key, CAST(row_number() OVER (ORDER BY dataset, CASE part WHEN 'meta' THEN 0 ELSE 1 END, key LIKE '%,%', CASE WHEN regexp_full_match(key, '[0-9]+') THEN 0 ELSE 1 END,
 TRY_CAST(CASE WHEN regexp_full_match(key, '[0-9]+') THEN key END AS BIGINT), key) AS BIGINT) AS position FROM labels_""",
)
def ord3(spark, sf):
    from tidemark.operators.numbering import number_all

    return number_all(fx.derive(spark, sf, LABELS), ordering.conflict_order("dataset", "part", "key"))


@query(
    "MRG7",
    MERGED
    + """SELECT key, CASE WHEN outcome = 'conflict_edit_edit' THEN t.o_orderstatus WHEN outcome = 'conflict_insert_insert' THEN o.o_orderstatus END AS status, outcome = 'conflict_edit_delete' AS deleted
FROM merged WHERE outcome LIKE 'conflict%'""",
)
def mrg7(spark, sf):
    """Edits resolved with theirs, inserts with ours, edit against delete by deleting."""
    found = merging.conflicts(merged(spark, sf))

    def of(kind: str, version: str):
        return merging.resolve_with(found.filter(F.col("outcome") == kind), version)

    resolves = of("conflict_edit_edit", "theirs").unionByName(of("conflict_insert_insert", "ours")).unionByName(of("conflict_edit_delete", "delete"))
    return resolves.select("key", F.col("row.o_orderstatus").alias("status"), F.col("row").isNull().alias("deleted"))


@query(
    "MRG7_FILE",
    MERGED + "SELECT key, o.o_orderkey * 2 + n AS new_key, 'FILE' || CAST(n AS STRING) AS status FROM merged, (SELECT 0 AS n UNION ALL SELECT 1 AS n) c WHERE outcome = 'conflict_edit_edit'",
)
def mrg7_file(spark, sf):
    """Conflicts answered by rows from a file, two rows each."""
    found = merging.conflicts(merged(spark, sf)).filter("outcome = 'conflict_edit_edit'")
    rows = found.select("key", "ours.*").withColumn("n", F.explode(F.array(F.lit(0), F.lit(1))))
    edited = rows.select(
        F.col("key").alias("conflict_key"), (F.col("o_orderkey") * 2 + F.col("n")).alias("o_orderkey"), "o_custkey",
        F.concat(F.lit("FILE"), F.col("n").cast("string")).alias("o_orderstatus"), "o_totalprice", "o_orderdate", "o_orderpriority",
    )
    resolves = merging.resolve_from(found, edited, PK)
    return resolves.select("key", F.col("row.o_orderkey").alias("new_key"), F.col("row.o_orderstatus").alias("status"))


RENUMBERED = """top AS (SELECT max(k) + 1 AS start FROM (SELECT max(o_orderkey) AS k FROM ours UNION ALL SELECT max(o_orderkey) AS k FROM theirs) m),
moved AS (SELECT key, o, t, CAST(row_number() OVER (ORDER BY key) AS BIGINT) - 1 AS n FROM merged WHERE outcome = 'conflict_insert_insert')
"""


@query(
    "MRG8",
    MERGED.rstrip() + ",\n" + RENUMBERED
    + """SELECT key, 'ours' AS "from", o.o_orderkey AS new_key, o.o_orderstatus AS status FROM moved UNION ALL SELECT key, 'theirs' AS "from", start + n AS new_key, t.o_orderstatus AS status FROM moved, top""",
)
def mrg8(spark, sf):
    o, t = fx.ours(spark, sf), fx.theirs(spark, sf)
    resolves = merging.renumber(merging.conflicts(merged(spark, sf)), o, t, "o_orderkey", "theirs")
    return resolves.select("key", "from", F.col("row.o_orderkey").alias("new_key"), F.col("row.o_orderstatus").alias("status"))


SO_FAR = """SELECT CASE WHEN outcome = 'theirs' THEN t WHEN outcome = 'conflict_edit_edit' THEN t ELSE o END AS r FROM merged"""


@query(
    "MRG9",
    MERGED.rstrip() + f",\nso_far AS ({SO_FAR}) SELECT " + ", ".join(f"r.{c} AS {c}" for c in C) + " FROM so_far WHERE r IS NOT NULL",
)
def mrg9(spark, sf):
    """Edit conflicts resolved with theirs; the open ones count as ours."""
    m = merged(spark, sf)
    resolves = merging.resolve_with(merging.conflicts(m).filter("outcome = 'conflict_edit_edit'"), "theirs")
    return merging.merged_snapshot(m, resolves)


@query(
    "MRG10",
    MERGED.rstrip() + ",\nso_far AS (SELECT CASE WHEN outcome = 'ours' OR outcome IN ('unchanged', 'same_change') THEN o ELSE t END AS r FROM merged) SELECT " + ", ".join(f"r.{c} AS {c}" for c in C) + " FROM so_far WHERE r IS NOT NULL",
)
def mrg10(spark, sf):
    """Every conflict resolved with theirs, then finished."""
    m = merged(spark, sf)
    return merging.finish(m, merging.resolve_with(merging.conflicts(m), "theirs"))
