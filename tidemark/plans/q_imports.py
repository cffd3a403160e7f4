"""Imports, generated keys, schema operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.hashing import content_id, text_content_id
from tidemark.operators import aggregates, diffing, imports, keygen, ordering, schemas, workspace
from tidemark.plans import fixtures as fx
from tidemark.plans import q_history
from tidemark.plans.q_diff import COLS, PK, WITH_DIFF
from tidemark.plans.registry import query
from tidemark.schema import ColumnSpec, VersionedSchema
from tidemark.session import scratch_path
from tidemark.store import VersionStore

# -- generated keys -------------------------------------------------------------------

CONTENT = ["user_id", "event_type", "score"]
ROWS = "SELECT user_id, event_type, CAST(floor(value / 40) AS BIGINT) AS score, event_id FROM events"


def encoded(*names: str) -> str:
    """The text form content ids are made of, in SQL."""
    parts = [f"coalesce(CAST(length(CAST({n} AS STRING)) AS STRING) || ':' || CAST({n} AS STRING), '-')" for n in names]
    return f"substr(sha256({' || chr(44) || '.join(parts)}), 1, 40)"


KEY_MAP = f"SELECT event_id + 1 AS pk, {encoded(*CONTENT)} AS hash FROM rows_ WHERE event_id % 3 <> 0"
ASSIGNED = fx.ctes(
    rows_=ROWS,
    map_=KEY_MAP,
    incoming=f"SELECT user_id, event_type, score, {encoded(*CONTENT)} AS hash FROM rows_ WHERE event_id % 5 <> 0",
    contents="SELECT hash, user_id, event_type, score, count(*) AS copies FROM incoming GROUP BY ALL",
    ranked="SELECT hash, pk, row_number() OVER (PARTITION BY hash ORDER BY pk) AS r FROM map_",
    reused="SELECT r.hash, pk FROM ranked r JOIN contents c ON r.hash = c.hash WHERE r <= copies",
    extra="SELECT * FROM (SELECT c.hash, copies - coalesce((SELECT count(*) FROM map_ m WHERE m.hash = c.hash), 0) AS extra FROM contents c) e WHERE extra > 0",
    placed="SELECT hash, extra, coalesce(sum(extra) OVER (ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM extra",
    fresh="SELECT hash, CAST((SELECT max(pk) + 1 FROM map_) + before + unnest(range(CAST(extra AS BIGINT))) AS BIGINT) AS pk FROM placed",
    assigned="SELECT k.pk AS auto_pk, c.user_id, c.event_type, c.score, c.hash FROM (SELECT * FROM reused UNION ALL SELECT * FROM fresh) k JOIN contents c ON c.hash = k.hash",
)


def keyless(spark, sf):
    rows = fx.derive(spark, sf, ROWS)
    content = text_content_id(CONTENT)
    key_map = rows.filter("event_id % 3 <> 0").select((F.col("event_id") + 1).alias("pk"), content.alias("hash"))
    return rows.filter("event_id % 5 <> 0").select(*CONTENT), key_map, content


@query("IMP3", ASSIGNED + "SELECT * FROM assigned")
def imp3(spark, sf):
    rows, key_map, content = keyless(spark, sf)
    return keygen.assign_keys(rows, key_map, content)


@query("IMP3_MAP", ASSIGNED + "SELECT auto_pk AS pk, hash FROM assigned UNION ALL SELECT pk, hash FROM map_ WHERE pk NOT IN (SELECT auto_pk FROM assigned)")
def imp3_map(spark, sf):
    rows, key_map, content = keyless(spark, sf)
    return keygen.updated_map(keygen.assign_keys(rows, key_map, content), key_map)


@query("JOI6", ASSIGNED + "SELECT hash, pk FROM reused")
def joi6(spark, sf):
    """Only the rows that took an earlier key."""
    rows, key_map, content = keyless(spark, sf)
    keyed = keygen.assign_keys(rows, key_map, content, "pk")
    return keyed.join(key_map.select("pk"), "pk", "left_semi").select("hash", "pk")


@query("AGG11", fx.ctes(rows_=ROWS, map_=KEY_MAP) + "SELECT CAST(max(pk) + 1 AS BIGINT) AS next_pk FROM map_")
def agg11(spark, sf):
    return keygen.next_generated(keyless(spark, sf)[1])


@query("AGG10", "SELECT CAST(max(o_orderkey) + 1 AS BIGINT) AS next_key FROM orders")
def agg10(spark, sf):
    return aggregates.next_key(fx.orders(spark, sf), "o_orderkey")


#: Re-imported orders under new keys, most with one field changed, some with two.
SIMILAR_NEW = """SELECT o_orderkey + 10000000 AS o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 < 2 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus,
 CASE WHEN o_orderkey % 4 IN (1, 2) THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders"""
FIELDS = [c for c in COLS if c != "o_orderkey"]


def _variants(table: str, key: str) -> str:
    """Rows as a whole and without each single field."""
    out = []
    for left_out in [None, *FIELDS]:
        cols = ", ".join(f"CASE WHEN '{left_out}' = '{c}' THEN NULL ELSE {c} END AS {c}" for c in FIELDS)
        out.append(f"SELECT '{left_out}' AS left_out, o_orderkey AS {key}, {cols} FROM {table}")
    return " UNION ALL ".join(out)


PAIRS = fx.ctes(
    fresh=SIMILAR_NEW,
    vo=_variants("orders", "old_key"),
    vn=_variants("fresh", "new_key"),
    stacked="SELECT left_out, old_key, NULL AS new_key, " + ", ".join(FIELDS) + " FROM vo UNION ALL SELECT left_out, NULL, new_key, " + ", ".join(FIELDS) + " FROM vn",
    buckets="SELECT min(old_key) AS old_key, min(new_key) AS new_key FROM stacked GROUP BY left_out, " + ", ".join(FIELDS) + " HAVING count(old_key) = 1 AND count(new_key) = 1",
    meets="SELECT DISTINCT old_key, new_key FROM buckets",
    pairs="SELECT old_key, new_key FROM meets WHERE old_key IN (SELECT old_key FROM meets GROUP BY old_key HAVING count(*) = 1) AND new_key IN (SELECT new_key FROM meets GROUP BY new_key HAVING count(*) = 1)",
)


def similar(spark, sf):
    columns = {c: c for c in FIELDS}
    return keygen.similar_pairs(
        fx.orders(spark, sf), fx.derive(spark, sf, SIMILAR_NEW), "o_orderkey", "o_orderkey", columns, columns
    )


@query("JOI7", PAIRS + "SELECT * FROM pairs")
def joi7(spark, sf):
    return similar(spark, sf)


@query("IMP4", PAIRS + "SELECT coalesce(p.old_key, f.o_orderkey) AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM fresh f LEFT JOIN pairs p ON f.o_orderkey = p.new_key")
def imp4(spark, sf):
    """New rows take the keys of the deleted rows they are similar to."""
    return keygen.rekey_similar(fx.derive(spark, sf, SIMILAR_NEW), similar(spark, sf), "o_orderkey")


@query(
    "ORD7",
    fx.ctes(edited=fx.EDITED)
    + """SELECT 10000 AS work_limit, CAST(floor(greatest(10000 + (SELECT count(*) FROM edited) - (SELECT count(*) FROM orders), 0) / 2) AS BIGINT) AS insert_budget""",
)
def ord7(spark, sf):
    n_old = fx.orders(spark, sf).agg(F.count(F.lit(1)).alias("a"), F.lit(1).alias("_one"))
    n_new = fx.edited(spark, sf).agg(F.count(F.lit(1)).alias("b"), F.lit(1).alias("_one"))
    return n_old.join(n_new, "_one").select(
        F.lit(10000).alias("work_limit"), ordering.insert_budget(10000, F.col("a"), F.col("b")).alias("insert_budget")
    )


# -- imports --------------------------------------------------------------------------

CUSTOMER = VersionedSchema(
    (
        ColumnSpec("a1", "c_custkey", "integer", 0, {"size": 32}),
        ColumnSpec("a2", "c_name", "text", None, {"length": 18}),
        ColumnSpec("a3", "c_nationkey", "integer", None, {"size": 8}),
        ColumnSpec("a4", "c_acctbal", "float", None, {"size": 64}),
        ColumnSpec("a5", "c_mktsegment", "text", None, {"length": 9}),
    )
)


ROOMY = VersionedSchema(tuple(ColumnSpec(c.id, c.name, c.data_type, c.pk_index, {"length": 25} if c.data_type == "text" else c.info) for c in CUSTOMER.columns))


@query("IMP1", "SELECT * FROM customer")
def imp1(spark, sf):
    """A new dataset with declared text lengths and integer sizes, as the store gives it back."""
    store = new_store(spark)
    imports.import_new(store, "customer", fx.table(spark, sf, "customer"), ["c_custkey"], "import", schema=ROOMY)
    held = fx.table(spark, sf, "customer")
    return store.read("customer", "main").select(*[F.col(c).cast(t).alias(c) for c, t in held.dtypes])


def new_store(spark):
    return VersionStore(spark, scratch_path(spark, "store"))


@query("IMP2", WITH_DIFF + "SELECT change_type, CAST(count(*) AS BIGINT) AS n FROM diff GROUP BY change_type")
def imp2(spark, sf):
    """Net change of replacing a dataset."""
    return aggregates.type_counts(diffing.diff(fx.orders(spark, sf), fx.edited(spark, sf), PK, strategy="hash_first"))


@query(
    "IMP5",
    fx.ctes(edited=fx.EDITED, ids="SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_quantity < 3")
    + "SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ids) UNION ALL SELECT * FROM edited WHERE o_orderkey IN (SELECT o_orderkey FROM ids)",
)
def imp5(spark, sf):
    ids = fx.table(spark, sf, "lineitem").filter("l_quantity < 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return keygen.replace_ids(fx.orders(spark, sf), fx.edited(spark, sf), ids, "o_orderkey")


@query(
    "IMP6",
    "SELECT c_custkey, c_custkey % 6 NOT IN (0, 1) AS kept FROM customer",
)
def imp6(spark, sf):
    """A column was added and one dropped; rows equal in the rest keep their identity."""
    c = fx.table(spark, sf, "customer")
    n = F.col("c_custkey") % 6
    replaced = c.filter(n != 0).drop("c_acctbal")
    imported = c.withColumn("c_name", F.when(n == 1, F.lit("renamed")).otherwise(F.col("c_name"))).withColumn("extra", F.lit(1)).drop("c_mktsegment")
    return keygen.kept_rows(imported, replaced, "c_custkey", ["c_custkey", "c_name", "c_nationkey"])


@query("IMP2_STORE", WITH_DIFF + "SELECT change_type, CAST(count(*) AS BIGINT) AS n, 'Orders' AS title FROM diff GROUP BY change_type")
def imp2_store(spark, sf):
    """A dataset of a store replaced: the net change of the commit, and the title that stays."""
    store = new_store(spark)
    first = imports.import_new(store, "orders", fx.orders(spark, sf), PK, "import", meta={"title": "Orders"})
    imports.import_over(store, "orders", fx.edited(spark, sf), "again", meta={"description": "edited"})
    return store.counts("orders", first, "main").withColumn("title", F.lit(store.version("orders", "main").meta["title"]))


@query("IMP6_WALK", "SELECT c_custkey, CAST(CASE WHEN c_custkey % 7 = 0 THEN 2 WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS seq FROM customer")
def imp6_walk(spark, sf):
    """Two imports that change the schema: a column added, one dropped; each row keeps the commit its content came with."""
    c, key = fx.table(spark, sf, "customer"), F.col("c_custkey")
    store = new_store(spark)
    imports.import_new(store, "customer", c, ["c_custkey"], "import")
    noted = c.withColumn("note", F.when(key % 5 == 0, "n"))
    imports.import_over(store, "customer", noted, "a column more")
    renamed = noted.drop("c_acctbal").withColumn("c_name", F.when(key % 7 == 0, F.lit("renamed")).otherwise(F.col("c_name")))
    imports.import_over(store, "customer", renamed, "a column less")
    return imports.written(store, "customer").drop("commit_id")


@query("JOI14", fx.ctes(edited=fx.EDITED) + "SELECT e.o_orderkey, o.o_orderkey IS NOT NULL AND (" + " AND ".join(f"e.{c} IS NOT DISTINCT FROM o.{c}" for c in COLS) + ") AS kept FROM edited e LEFT JOIN orders o ON e.o_orderkey = o.o_orderkey")
def joi14(spark, sf):
    return keygen.kept_rows(fx.edited(spark, sf), fx.orders(spark, sf), "o_orderkey", COLS)


CANDIDATES = ["l_orderkey", "l_partkey", "l_linenumber"]


@query(
    "IMP7",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, CAST(count(*) - count({c}) AS BIGINT) AS n_null,
 count(*) = count({c}) AND count(*) = count(DISTINCT {c}) AS usable FROM lineitem"""
        for c in CANDIDATES
    )
    + """ UNION ALL SELECT 'o_orderkey' AS "column", CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS n_distinct, CAST(count(*) - count(o_orderkey) AS BIGINT) AS n_null, TRUE AS usable FROM orders""",
)
def imp7(spark, sf):
    lines = keygen.usable_keys(fx.table(spark, sf, "lineitem"), CANDIDATES)
    return lines.unionByName(keygen.usable_keys(fx.orders(spark, sf), ["o_orderkey"]))


@query(
    "IMP9",
    q_history.chain_sql(line=q_history.MAIN)
    + """SELECT dataset, key, max(seq) AS last_changed_seq FROM (SELECT *, lag(v) OVER (PARTITION BY dataset, key ORDER BY seq) AS p FROM (SELECT dataset, key, seq, CAST(floor(value / 50) AS BIGINT) AS v FROM line) a) b
WHERE v IS DISTINCT FROM p GROUP BY dataset, key""",
)
def imp9(spark, sf):
    """The last change of an item on the main line."""
    from tidemark.operators.history import previous_import

    items = q_history.main_changes(spark, sf).withColumn("v", F.floor(F.col("value") / 50).cast("bigint"))
    return previous_import(items, ["dataset", "key"], "v")


# -- schema ---------------------------------------------------------------------------

VIOLATIONS = """SELECT CAST(c_custkey AS STRING) AS key, 'c_mktsegment' AS "column", c_mktsegment AS value, 'length' AS rule FROM customer WHERE length(c_mktsegment) > 9
UNION ALL SELECT CAST(c_custkey AS STRING) AS key, 'stamp' AS "column", CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '2024-01-0' || CAST(c_custkey % 10 AS STRING) END AS value, 'pattern' AS rule FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT CAST(c_custkey AS STRING) AS key, 'small' AS "column", CAST(c_custkey AS STRING) AS value, 'range' AS rule FROM customer WHERE c_custkey > 127
UNION ALL SELECT CAST(c_custkey AS STRING) AS key, 'c_acctbal' AS "column", CAST(c_nationkey AS STRING) AS value, 'type' AS rule FROM customer"""


def checked_customers(spark, sf):
    c = fx.table(spark, sf, "customer")
    n = F.col("c_custkey")
    stamp = F.when(n % 3 == 0, F.col("c_name")).otherwise(F.concat(F.lit("2024-01-0"), (n % 10).cast("string")))
    rows = c.select("c_custkey", "c_mktsegment", stamp.alias("stamp"), n.alias("small"), F.col("c_nationkey").alias("c_acctbal"))
    schema = VersionedSchema(
        (
            ColumnSpec("b1", "c_custkey", "integer", 0, {"size": 64}),
            ColumnSpec("b2", "c_mktsegment", "text", None, {"length": 9}),
            ColumnSpec("b3", "stamp", "date"),
            ColumnSpec("b4", "small", "integer", None, {"size": 8}),
            ColumnSpec("b5", "c_acctbal", "text"),
        )
    )
    return rows, schema


@query("SCH1", VIOLATIONS)
def sch1(spark, sf):
    return schemas.violations(*checked_customers(spark, sf))


@query("AGG9", fx.ctes(v=VIOLATIONS) + """SELECT "column", CAST(count(*) AS BIGINT) AS n, min(key) AS key FROM v GROUP BY "column" """)
def agg9(spark, sf):
    return schemas.violation_examples(*checked_customers(spark, sf)).select("column", "n", "key")


@query("SCH4", f"SELECT event_id, {encoded('user_id', 'event_type', 'props')} AS row_hash FROM events")
def sch4(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", text_content_id(["user_id", "event_type", "props"]).alias("row_hash"))


@query("SCH4_JSON")
def sch4_json(spark, sf):
    """Content ids over JSON, with and without the key."""
    e = fx.table(spark, sf, "events")
    return e.select("event_id", content_id(e.columns).alias("with_pk"), content_id([c for c in e.columns if c != "event_id"]).alias("without_pk"))


COLUMNS_OLD = """SELECT 'ds' || CAST(p_partkey % 400 AS STRING) AS dataset, 'col' || CAST(p_partkey AS STRING) AS id, CAST(p_partkey AS BIGINT) AS position, p_name AS name,
 CASE WHEN p_partkey % 5 = 0 THEN 0 END AS pk_index, p_type AS facts FROM part"""
COLUMNS_NEW = """SELECT 'ds' || CAST(p_partkey % 400 AS STRING) AS dataset, 'col' || CAST(p_partkey + CASE WHEN p_partkey % 11 = 0 THEN 1000000 ELSE 0 END AS STRING) AS id,
 CAST(p_partkey + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS position, CASE WHEN p_partkey % 3 = 0 THEN p_name || '_2' ELSE p_name END AS name,
 CASE WHEN p_partkey % 5 = 0 AND p_partkey % 2 = 0 THEN 0 END AS pk_index, CASE WHEN p_partkey % 13 = 0 THEN 'text' ELSE p_type END AS facts FROM part WHERE p_partkey % 17 <> 0"""
SCHEMA_DIFF = """SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(a.id, b.id) AS id, a.id IS NULL AS inserted, b.id IS NULL AS deleted,
 a.id IS NOT NULL AND b.id IS NOT NULL AND a.position <> b.position AS moved, a.id IS NOT NULL AND b.id IS NOT NULL AND a.name <> b.name AS renamed,
 a.id IS NOT NULL AND b.id IS NOT NULL AND a.facts <> b.facts AS retyped, a.id IS NOT NULL AND b.id IS NOT NULL AND a.pk_index IS DISTINCT FROM b.pk_index AS rekeyed
FROM co a FULL OUTER JOIN cn b ON a.dataset = b.dataset AND a.id = b.id"""


def column_changes(spark, sf):
    return schemas.schema_diff(fx.derive(spark, sf, COLUMNS_OLD), fx.derive(spark, sf, COLUMNS_NEW), ["dataset"])


@query("SCH5", fx.ctes(co=COLUMNS_OLD, cn=COLUMNS_NEW) + SCHEMA_DIFF)
def sch5(spark, sf):
    return column_changes(spark, sf)


COUNTED = ", ".join(
    f"CAST(count(*) FILTER ({c}) AS BIGINT) AS {n}"
    for c, n in (("inserted", "inserts"), ("deleted", "deletes"), ("moved", "position_updates"), ("renamed", "name_updates"), ("retyped", "type_updates"), ("rekeyed", "pk_updates"))
)


@query("AGG8", fx.ctes(co=COLUMNS_OLD, cn=COLUMNS_NEW, d=SCHEMA_DIFF) + f"SELECT dataset, {COUNTED} FROM d GROUP BY dataset")
def agg8(spark, sf):
    return schemas.schema_change_counts(column_changes(spark, sf), ["dataset"])


PATHS = """SELECT CASE doc_id % 8 WHEN 0 THEN lang || '//' || source WHEN 1 THEN lang || '/.' || source WHEN 2 THEN source || ':' || lang WHEN 3 THEN 'con/' || source
 WHEN 4 THEN upper(lang) || '/' || CAST(doc_id AS STRING) WHEN 5 THEN lang || '/' || CAST(doc_id - 1 AS STRING) WHEN 6 THEN source || '/' || lang || ' ' ELSE lang || '/ok/' || CAST(doc_id AS STRING) END AS path FROM documents"""


@query(
    "SCH13",
    fx.ctes(p=PATHS, d="SELECT DISTINCT path FROM p", f="SELECT lower(path) AS folded, count(*) - 1 AS clashes FROM d GROUP BY lower(path)")
    + """SELECT path, CASE WHEN path LIKE '%//%' THEN 'empty component' WHEN path LIKE '%:%' THEN 'forbidden character' WHEN path LIKE '%/.%' OR path LIKE '% ' THEN 'bad component end'
 WHEN path LIKE 'con/%' THEN 'reserved name' END AS problem, CAST(clashes AS BIGINT) AS clashes FROM d JOIN f ON lower(path) = folded""",
)
def sch13(spark, sf):
    return schemas.path_report(fx.derive(spark, sf, PATHS))


@query(
    "SNK9",
    fx.ctes(edited=fx.EDITED) + "SELECT * FROM edited UNION ALL SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM edited)",
)
def snk9(spark, sf):
    return workspace.upsert(fx.orders(spark, sf), fx.edited(spark, sf), PK)
