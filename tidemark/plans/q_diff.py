"""Diffs, diff algebra, joins, counts, set operations and orders on versions of ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import aggregates, algebra, diffing, ordering, sets
from tidemark.plans import fixtures as fx
from tidemark.plans.registry import query

PK = ["o_orderkey"]
COLS = fx.ORDER_COLUMNS
WITH_DIFF = fx.ctes(edited=fx.EDITED, diff=fx.EDIT_DIFF)
NEW_VALUES = [c for c in COLS if c != "o_orderkey"]


META_OLD = """SELECT n_name AS dataset, 'title' AS item, 'Title of ' || n_name AS value FROM nation
UNION ALL SELECT n_name AS dataset, 'description' AS item, 'Region ' || CAST(n_regionkey AS STRING) AS value FROM nation
UNION ALL SELECT c_name AS dataset, 'title' AS item, c_mktsegment AS value FROM customer"""
META_NEW = """SELECT n_name AS dataset, 'title' AS item, CASE WHEN n_nationkey % 3 = 0 THEN 'New title' ELSE 'Title of ' || n_name END AS value FROM nation
UNION ALL SELECT n_name AS dataset, 'tags' AS item, 'a,b' AS value FROM nation WHERE n_nationkey % 5 = 0
UNION ALL SELECT c_name AS dataset, CASE WHEN c_custkey % 9 = 1 THEN 'description' ELSE 'title' END AS item,
  CASE WHEN c_custkey % 9 = 0 THEN 'changed' ELSE c_mktsegment END AS value FROM customer"""


def edit_diff(spark, sf, strategy="wide"):
    return diffing.diff(fx.orders(spark, sf), fx.edited(spark, sf), PK, strategy=strategy)


def columns(prefix: str = "", cols=COLS) -> str:
    return ", ".join(f"{prefix}{c}" for c in cols)


@query("DIF1", WITH_DIFF + "SELECT * FROM diff")
def dif1(spark, sf):
    return fx.flat(edit_diff(spark, sf), COLS)


@query("DIF1_HASH_FIRST", WITH_DIFF + "SELECT * FROM diff")
def dif1_hash_first(spark, sf):
    return fx.flat(edit_diff(spark, sf, "hash_first"), COLS)


def schemas_of(old, new, pk=PK):
    """Both schemas, the newer one with the ids of the older where columns are the same."""
    from tidemark.schema import VersionedSchema

    before = VersionedSchema.infer(old, pk, "orders")
    return before, before.align(VersionedSchema.infer(new, pk, "orders"))


@query("DIF1_REORDER", WITH_DIFF + "SELECT old_key, new_key, change_type, old_o_custkey, new_o_custkey, new_o_totalprice FROM diff")
def dif1_reorder(spark, sf):
    """Columns in another order are the same columns."""
    moved = fx.edited(spark, sf).select(*reversed(COLS))
    d = diffing.diff(fx.orders(spark, sf), moved, PK)
    return fx.flat(d, ["o_custkey", "o_totalprice"]).drop("old_o_totalprice")


@query("DIF1_RENAME", WITH_DIFF + "SELECT old_key, new_key, change_type, old_o_totalprice AS old_price, new_o_totalprice AS new_price FROM diff")
def dif1_rename(spark, sf):
    """A renamed column is known by its id; rows that differ in nothing else are unchanged."""
    old, new = fx.orders(spark, sf), fx.edited(spark, sf).withColumnRenamed("o_totalprice", "price")
    a, b = schemas_of(old, new)
    d = diffing.diff_versions(old, a, new, b)
    return d.select("old_key", "new_key", "change_type", F.col("old.price").alias("old_price"), F.col("new.price").alias("new_price"))


@query(
    "DIF1_ADD",
    WITH_DIFF.rstrip() + """ SELECT old_key, new_key, change_type, CASE WHEN new_key % 10 = 3 THEN 'x' END AS note FROM diff
UNION ALL SELECT e.o_orderkey, e.o_orderkey, 'update', 'x' FROM edited e JOIN orders o ON e.o_orderkey = o.o_orderkey WHERE e.o_orderkey % 10 = 3 AND e.o_orderkey NOT IN (SELECT new_key FROM diff WHERE new_key IS NOT NULL)""",
)
def dif1_add(spark, sf):
    """A new column is NULL in old rows: only rows that fill it are updates."""
    old, new = fx.orders(spark, sf), fx.edited(spark, sf).withColumn("note", F.when(F.col("o_orderkey") % 10 == 3, "x"))
    a, b = schemas_of(old, new)
    return diffing.diff_versions(old, a, new, b).select("old_key", "new_key", "change_type", F.col("new.note").alias("note"))


@query(
    "DIF1_DROP",
    WITH_DIFF + """SELECT old_key, new_key, change_type FROM diff WHERE change_type <> 'update' OR old_o_custkey IS DISTINCT FROM new_o_custkey OR old_o_orderstatus IS DISTINCT FROM new_o_orderstatus
 OR old_o_totalprice IS DISTINCT FROM new_o_totalprice OR old_o_orderdate IS DISTINCT FROM new_o_orderdate""",
)
def dif1_drop(spark, sf):
    """Rows that differ in a dropped column alone are no updates; fingerprints decide here."""
    old, new = fx.orders(spark, sf), fx.edited(spark, sf).drop("o_orderpriority")
    a, b = schemas_of(old, new)
    return diffing.diff_versions(old, a, new, b, strategy="hash_first").select("old_key", "new_key", "change_type")


@query(
    "DIF2_META",
    fx.ctes(edited=fx.EDITED, d1=fx.EDIT_DIFF, mo=META_OLD, mn=META_NEW)
    + """SELECT dataset, part, change_type, CAST(count(*) AS BIGINT) AS n FROM (
 SELECT 'orders' AS dataset, 'feature' AS part, change_type FROM d1 UNION ALL SELECT 'orders', 'meta', 'update'
 UNION ALL SELECT coalesce(a.dataset, b.dataset), 'meta', CASE WHEN a.item IS NULL THEN 'insert' WHEN b.item IS NULL THEN 'delete' ELSE 'update' END
 FROM mo a FULL OUTER JOIN mn b ON a.dataset = b.dataset AND a.item = b.item WHERE a.value IS DISTINCT FROM b.value) x GROUP BY 1, 2, 3""",
)
def dif2_meta(spark, sf):
    """Rows, schema and meta items of several datasets in one diff."""
    old, new = fx.orders(spark, sf), fx.edited(spark, sf).withColumnRenamed("o_totalprice", "price")
    a, b = schemas_of(old, new)
    met = old.withColumnRenamed("o_totalprice", "price")
    meta = diffing.diff_maps(fx.derive(spark, sf, META_OLD), fx.derive(spark, sf, META_NEW), ["dataset", "item"], "value")
    whole = diffing.repository_diff({"orders": (met, new, PK)}, meta.unionByName(diffing.schema_delta(F.lit("orders"), a, b, spark)))
    return whole.groupBy("dataset", "part", "change_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "JOI1",
    WITH_DIFF
    + """SELECT coalesce(old_key, new_key) AS key, change_type FROM diff""",
)
def joi1(spark, sf):
    changed = diffing.changed_keys(fx.orders(spark, sf), fx.edited(spark, sf), PK)
    return changed.select(F.coalesce("old_key", "new_key").alias("key"), "change_type")


@query(
    "JOI5",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS o_orderpriority
FROM orders""",
)
def joi5(spark, sf):
    """Rows written under two legends, told apart by which id-named columns they have."""
    from tidemark.operators.snapshots import scan
    from tidemark.schema import ColumnSpec, VersionedSchema

    ids = {"o_orderkey": "c1", "o_custkey": "c2", "o_orderstatus": "c3", "o_totalprice": "c4", "o_orderpriority": "c5"}
    kinds = {"o_orderkey": "integer", "o_custkey": "integer", "o_totalprice": "float"}
    schema = VersionedSchema(
        tuple(ColumnSpec(i, n, kinds.get(n, "text"), 0 if n == "o_orderkey" else None) for n, i in ids.items())
    )
    o = fx.orders(spark, sf)
    new = o.filter("o_orderkey % 3 = 0").select(*[F.col(n).alias(i) for n, i in ids.items()])
    old = o.filter("o_orderkey % 3 <> 0").select(*[F.col(n).alias(i) for n, i in ids.items() if i != "c5"], F.col("o_orderdate").alias("c9"))
    return scan([new, old], schema)


@query(
    "DIF2",
    fx.ctes(edited=fx.EDITED, d1=fx.EDIT_DIFF)
    + """SELECT 'orders' AS dataset, change_type, CAST(count(*) AS BIGINT) AS n FROM d1 GROUP BY change_type
UNION ALL SELECT 'customer' AS dataset, 'update' AS change_type, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT 'nation' AS dataset, 'delete' AS change_type, CAST(count(*) AS BIGINT) AS n FROM nation
UNION ALL SELECT 'supplier' AS dataset, 'insert' AS change_type, CAST(count(*) AS BIGINT) AS n FROM supplier""",
)
def dif2(spark, sf):
    customer = fx.table(spark, sf, "customer")
    renamed = customer.withColumn("c_name", F.when(F.col("c_custkey") % 4 == 0, F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name")))
    whole = diffing.repository_diff(
        {
            "orders": (fx.orders(spark, sf), fx.edited(spark, sf), PK),
            "customer": (customer, renamed, ["c_custkey"]),
            "region": (fx.table(spark, sf, "region"), fx.table(spark, sf, "region"), ["r_regionkey"]),
            "nation": (fx.table(spark, sf, "nation"), None, ["n_nationkey"]),
            "supplier": (None, fx.table(spark, sf, "supplier"), ["s_suppkey"]),
        }
    )
    return aggregates.type_counts(whole, ["dataset"])


META_DIFF = """SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(a.item, b.item) AS item,
 CASE WHEN a.item IS NULL THEN 'insert' WHEN b.item IS NULL THEN 'delete' ELSE 'update' END AS change_type, a.value AS old_value, b.value AS new_value
FROM mo a FULL OUTER JOIN mn b ON a.dataset = b.dataset AND a.item = b.item WHERE a.value IS DISTINCT FROM b.value"""


def meta_sides(spark, sf):
    return fx.derive(spark, sf, META_OLD), fx.derive(spark, sf, META_NEW)


@query("SET2", fx.ctes(mo=META_OLD, mn=META_NEW) + META_DIFF)
def set2(spark, sf):
    return diffing.diff_maps(*meta_sides(spark, sf), ["dataset", "item"], "value")


@query("DIF4", fx.ctes(mo=META_OLD, mn=META_NEW, d=META_DIFF) + "SELECT * FROM d WHERE item IN ('title', 'tags')")
def dif4(spark, sf):
    from tidemark.operators.filters import meta_selected

    shown = [side.filter(meta_selected(F.col("item"), ["title", "tags"])) for side in meta_sides(spark, sf)]
    return diffing.diff_maps(*shown, ["dataset", "item"], "value")


FILES_OLD = "SELECT url AS path, substr(sha256(html), 1, 40) AS oid FROM pages"
FILES_NEW = """SELECT CASE WHEN page_id % 6 = 1 THEN url || '.bak' ELSE url END AS path,
 substr(sha256(CASE WHEN page_id % 6 = 2 THEN html || ' ' ELSE html END), 1, 40) AS oid FROM pages WHERE page_id % 6 <> 3"""


@query(
    "DIF5",
    fx.ctes(
        p="SELECT page_id, url || '#' || CAST(page_id AS STRING) AS url, html FROM pages",
        mo=FILES_OLD.replace("FROM pages", "FROM p"),
        mn=FILES_NEW.replace("FROM pages", "FROM p"),
    )
    + """SELECT coalesce(a.path, b.path) AS path,
 CASE WHEN a.path IS NULL THEN 'insert' WHEN b.path IS NULL THEN 'delete' ELSE 'update' END AS change_type, a.oid AS old_value, b.oid AS new_value
FROM mo a FULL OUTER JOIN mn b ON a.path = b.path WHERE a.oid IS DISTINCT FROM b.oid""",
)
def dif5(spark, sf):
    from tidemark.functions.hashing import hex_hash

    pages = fx.table(spark, sf, "pages").withColumn("path", F.concat_ws("#", "url", F.col("page_id").cast("string")))
    n = F.col("page_id") % 6
    old = pages.select("path", hex_hash(F.col("html")).alias("oid"))
    new = pages.filter(n != 3).select(
        F.when(n == 1, F.concat("path", F.lit(".bak"))).otherwise(F.col("path")).alias("path"),
        hex_hash(F.when(n == 2, F.concat("html", F.lit(" "))).otherwise(F.col("html"))).alias("oid"),
    )
    return diffing.diff_maps(old, new, ["path"], "oid")


FIELDS = ["o_custkey", "o_orderstatus", "o_orderpriority"]


@query(
    "DIF6",
    WITH_DIFF
    + " UNION ALL ".join(
        f"""SELECT old_key, new_key, '{c}' AS field, CAST(old_{c} AS STRING) AS old_value, CAST(new_{c} AS STRING) AS new_value
FROM diff WHERE change_type = 'update' AND old_{c} IS DISTINCT FROM new_{c}"""
        for c in FIELDS
    ),
)
def dif6(spark, sf):
    keep = ["o_orderkey", *FIELDS]
    d = diffing.diff(fx.orders(spark, sf).select(*keep), fx.edited(spark, sf).select(*keep), PK)
    return diffing.field_changes(d)


@query(
    "DIF7",
    """SELECT NULL::BIGINT AS old_key, c_custkey AS new_key, 'insert' AS change_type, c_name AS name FROM customer
UNION ALL SELECT p_partkey AS old_key, NULL AS new_key, 'delete' AS change_type, p_name AS name FROM part""",
)
def dif7(spark, sf):
    added = diffing.all_rows(fx.table(spark, sf, "customer"), ["c_custkey"], "insert")
    dropped = diffing.all_rows(fx.table(spark, sf, "part"), ["p_partkey"], "delete")
    return added.select("old_key", "new_key", "change_type", F.col("new.c_name").alias("name")).unionByName(
        dropped.select("old_key", "new_key", "change_type", F.col("old.p_name").alias("name"))
    )


@query(
    "DIF8",
    fx.ctes(edited=fx.EDITED, again=fx.EDITED_AGAIN, diff=fx.diff_sql("orders", "again", "o_orderkey", COLS)) + "SELECT * FROM diff",
)
def dif8(spark, sf):
    """Base to first edit, then first to second edit, equals base to second edit."""
    base, one, two = fx.orders(spark, sf), fx.edited(spark, sf), fx.edited_again(spark, sf)
    both = algebra.concatenate(diffing.diff(base, one, PK), diffing.diff(one, two, PK))
    return fx.flat(both, COLS)


@query(
    "DIF16",
    fx.ctes(edited=fx.EDITED, again=fx.EDITED_AGAIN, diff=fx.diff_sql("orders", "again", "o_orderkey", ["o_orderkey", *NEW_VALUES]))
    + """, touched AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS k FROM edited a FULL OUTER JOIN again b ON a.o_orderkey = b.o_orderkey
  WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus <> b.o_orderstatus OR a.o_totalprice <> b.o_totalprice)
SELECT old_key, new_key, change_type, CASE WHEN t.k IS NULL THEN 0 ELSE 1 END AS flags FROM diff LEFT JOIN touched t ON coalesce(old_key, new_key) = t.k""".replace("WITH", "WITH"),
)
def dif16(spark, sf):
    """Base to head, then head to workspace, where the workspace half is flagged."""
    from tidemark.operators.workspace import workspace_diff

    base, head, ws = fx.orders(spark, sf), fx.edited(spark, sf), fx.edited_again(spark, sf)
    dirty = algebra.touched_keys(diffing.diff(head, ws, PK)).select(F.col("key").alias("pk"))
    both = algebra.concatenate(diffing.diff(base, head, PK), workspace_diff(head, ws, dirty, "o_orderkey"))
    return both.select("old_key", "new_key", "change_type", "flags")


@query(
    "DIF9",
    fx.ctes(edited=fx.EDITED, diff=fx.diff_sql("edited", "orders", "o_orderkey", COLS)) + "SELECT * FROM diff",
)
def dif9(spark, sf):
    return fx.flat(algebra.invert(edit_diff(spark, sf)), COLS)


@query("DIF10", WITH_DIFF + "SELECT old_key AS key FROM diff WHERE old_key IS NOT NULL UNION SELECT new_key FROM diff WHERE new_key IS NOT NULL")
def dif10(spark, sf):
    return algebra.touched_keys(edit_diff(spark, sf))


RENAMES = """keyed AS (SELECT *, old_key IS NOT NULL AND new_key IS NULL AS d, new_key IS NOT NULL AND old_key IS NULL AS i FROM diff),
dels AS (SELECT max(old_key) AS old_key, old_o_custkey AS c, old_o_orderstatus AS s, old_o_totalprice AS p, old_o_orderdate AS t, old_o_orderpriority AS q FROM keyed WHERE d GROUP BY ALL),
inss AS (SELECT max(new_key) AS new_key, new_o_custkey AS c, new_o_orderstatus AS s, new_o_totalprice AS p, new_o_orderdate AS t, new_o_orderpriority AS q FROM keyed WHERE i GROUP BY ALL),
pairs AS (SELECT old_key, new_key FROM dels JOIN inss ON dels.c IS NOT DISTINCT FROM inss.c AND dels.s IS NOT DISTINCT FROM inss.s AND dels.p IS NOT DISTINCT FROM inss.p
  AND dels.t IS NOT DISTINCT FROM inss.t AND dels.q IS NOT DISTINCT FROM inss.q)
"""
RENAMED = """SELECT old_key, new_key, 'update' AS change_type FROM pairs
UNION ALL SELECT old_key, new_key, change_type FROM diff WHERE change_type = 'update'
UNION ALL SELECT old_key, new_key, change_type FROM diff WHERE change_type = 'delete' AND old_key NOT IN (SELECT old_key FROM pairs)
UNION ALL SELECT old_key, new_key, change_type FROM diff WHERE change_type = 'insert' AND new_key NOT IN (SELECT new_key FROM pairs)"""


@query("DIF12", WITH_DIFF.rstrip() + ",\n" + RENAMES + RENAMED)
def dif12(spark, sf):
    return algebra.find_renames(edit_diff(spark, sf), NEW_VALUES).select("old_key", "new_key", "change_type")


@query("JOI8", WITH_DIFF.rstrip() + ",\n" + RENAMES + "SELECT * FROM pairs")
def joi8(spark, sf):
    found = algebra.find_renames(edit_diff(spark, sf), NEW_VALUES)
    return found.filter(algebra.is_rename()).select("old_key", "new_key")


@query(
    "DIF11",
    WITH_DIFF.rstrip() + ",\n" + RENAMES + f", renamed AS ({RENAMED}) SELECT old_key, new_key, change_type, change_type = 'update' AND old_key <> new_key AS is_rename FROM renamed",
)
def dif11(spark, sf):
    found = algebra.find_renames(edit_diff(spark, sf), NEW_VALUES)
    flag = F.coalesce(algebra.is_rename(), F.lit(False))
    return found.select("old_key", "new_key", "change_type", flag.alias("is_rename"))


@query(
    "DIF13",
    WITH_DIFF
    + """SELECT coalesce(old_key, new_key) AS key, CASE WHEN change_type = 'delete' THEN old_o_custkey END AS minus_minus,
 CASE WHEN change_type = 'update' THEN old_o_custkey END AS minus, CASE WHEN change_type = 'update' THEN new_o_custkey END AS plus,
 CASE WHEN change_type = 'insert' THEN new_o_custkey END AS plus_plus FROM diff""",
)
def dif13(spark, sf):
    halves = algebra.plus_minus(edit_diff(spark, sf), set(algebra.MARKS))
    return halves.select(
        F.coalesce("old_key", "new_key").alias("key"),
        *[F.col(n)["o_custkey"].alias(n) for n in algebra.MARKS.values()],
    )


@query("DIF14", WITH_DIFF + "SELECT old_key, new_key, change_type, old_o_orderstatus, new_o_orderstatus FROM diff")
def dif14(spark, sf):
    halves = algebra.plus_minus(edit_diff(spark, sf), set(algebra.MARKS))
    return fx.flat(algebra.from_plus_minus(halves, "o_orderkey"), ["o_orderstatus"])


@query(
    "FLT5",
    WITH_DIFF
    + """SELECT coalesce(old_key, new_key) AS key, CASE WHEN change_type = 'delete' THEN old_o_custkey END AS minus_minus,
 CAST(NULL AS BIGINT) AS minus, CASE WHEN change_type = 'update' THEN new_o_custkey END AS plus, CAST(NULL AS BIGINT) AS plus_plus FROM diff""",
)
def flt5(spark, sf):
    halves = algebra.plus_minus(edit_diff(spark, sf), {"--", "+"})
    return halves.select(
        F.coalesce("old_key", "new_key").alias("key"),
        *[F.col(n)["o_custkey"].alias(n) for n in algebra.MARKS.values()],
    )


# -- counts ---------------------------------------------------------------------------


@query("AGG1", WITH_DIFF + "SELECT 'orders' AS dataset, 'feature' AS part, change_type, CAST(count(*) AS BIGINT) AS n FROM diff GROUP BY change_type")
def agg1(spark, sf):
    changed = diffing.changed_keys(fx.orders(spark, sf), fx.edited(spark, sf), PK)
    tagged = changed.withColumn("dataset", F.lit("orders")).withColumn("part", F.lit("feature"))
    return aggregates.type_counts(tagged, ["dataset", "part"])


@query(
    "AGG2",
    WITH_DIFF
    + """SELECT 'forward' AS direction, CAST(count(*) FILTER (change_type = 'insert') AS BIGINT) AS inserts, CAST(count(*) FILTER (change_type = 'update') AS BIGINT) AS updates,
 CAST(count(*) FILTER (change_type = 'delete') AS BIGINT) AS deletes FROM diff
UNION ALL SELECT 'backward' AS direction, CAST(count(*) FILTER (change_type = 'delete') AS BIGINT), CAST(count(*) FILTER (change_type = 'update') AS BIGINT),
 CAST(count(*) FILTER (change_type = 'insert') AS BIGINT) FROM diff""",
)
def agg2(spark, sf):
    changed = diffing.changed_keys(fx.orders(spark, sf), fx.edited(spark, sf), PK)
    counts = aggregates.type_count_columns(changed)
    back = aggregates.invert_counts(counts)
    cols = ["direction", "inserts", "updates", "deletes"]
    return (
        counts.withColumn("direction", F.lit("forward")).select(*cols)
        .unionByName(back.withColumn("direction", F.lit("backward")).select(*cols))
    )


@query(
    "AGG4",
    WITH_DIFF + "SELECT 'orders' AS dataset, CAST(count(*) AS BIGINT) AS n FROM diff HAVING count(*) > 0",
)
def agg4(spark, sf):
    sides = {
        "orders": (fx.orders(spark, sf), fx.edited(spark, sf), PK),
        "part": (fx.table(spark, sf, "part"), fx.table(spark, sf, "part"), ["p_partkey"]),
    }
    out = None
    for path, (a, b, pk) in sides.items():
        one = diffing.changed_keys(a, b, pk).select(F.lit(path).alias("dataset"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query("AGG5")
def agg5(spark, sf):
    return aggregates.estimate_changed(fx.orders(spark, sf), fx.edited(spark, sf), PK, "good")


@query("AGG5_STORED", WITH_DIFF + "SELECT CAST(count(*) AS BIGINT) AS changed, TRUE AS few_buckets_read, TRUE AS within FROM diff")
def agg5_stored(spark, sf):
    """The estimate of a version store, from stored sums and a few buckets of rows, held against the exact count."""
    from tidemark.session import scratch_path
    from tidemark.store import VersionStore

    store = VersionStore(spark, scratch_path(spark, "store"))
    store.commit({"orders": fx.orders(spark, sf)}, "import", pks={"orders": PK})
    store.commit({"orders": fx.edited(spark, sf)}, "edit")
    found = store.estimate("orders", "main^", "main", "good")
    exact = store.counts("orders", "main^", "main").agg(F.sum("n").alias("changed"))
    near = F.abs(F.col("estimate") - F.col("changed")) <= F.greatest(F.col("changed") * 0.3, F.lit(5))
    few = F.col("exact") | (F.col("differing") > 64)
    both = found.withColumn("_one", F.lit(1)).join(exact.withColumn("_one", F.lit(1)), "_one")
    return both.select("changed", few.alias("few_buckets_read"), near.alias("within"))


@query("AGG5_EXACT", WITH_DIFF + "SELECT CAST(count(*) AS BIGINT) AS estimate, TRUE AS exact FROM diff")
def agg5_exact(spark, sf):
    """With no more buckets than are sampled, the estimate is the exact count."""
    found = aggregates.estimate_changed(fx.orders(spark, sf), fx.edited(spark, sf), PK, "good", buckets=64)
    return found.select("estimate", "exact")


@query("AGG6", WITH_DIFF + "SELECT CAST((SELECT count(*) FROM diff) + (SELECT count(*) FROM edited WHERE o_orderkey % 8 = 0) AS BIGINT) AS estimate")
def agg6(spark, sf):
    """The estimate plus the number of touched keys; rows in both are counted twice, by design."""
    found = aggregates.estimate_changed(fx.orders(spark, sf), fx.edited(spark, sf), PK, "good", buckets=64)
    dirty = fx.edited(spark, sf).filter("o_orderkey % 8 = 0").agg(F.count(F.lit(1)).alias("dirty"))
    both = found.withColumn("_one", F.lit(1)).join(dirty.withColumn("_one", F.lit(1)), "_one")
    return both.select((F.col("estimate") + F.col("dirty")).alias("estimate"))


@query(
    "AGG17",
    WITH_DIFF
    + """SELECT 'orders' AS dataset, count(*) > 0 AS data_changed FROM diff
UNION ALL SELECT 'part' AS dataset, count(*) > 0 AS data_changed FROM (SELECT * FROM part EXCEPT SELECT * FROM part) p""",
)
def agg17(spark, sf):
    part = fx.table(spark, sf, "part")
    same = part.repartition(3, "p_name").select(*part.columns)
    a = diffing.data_changed(fx.orders(spark, sf), fx.edited(spark, sf), PK).withColumn("dataset", F.lit("orders"))
    b = diffing.data_changed(part, same, ["p_partkey"]).withColumn("dataset", F.lit("part"))
    return a.unionByName(b).select("dataset", "data_changed")


@query("SNK6", WITH_DIFF + "SELECT count(*) > 0 AS has_changes FROM diff")
def snk6(spark, sf):
    return diffing.has_changes(fx.orders(spark, sf), fx.edited(spark, sf), PK)


# -- orders and limits ----------------------------------------------------------------


@query(
    "ORD1",
    WITH_DIFF + "SELECT old_key, new_key, change_type FROM diff",
)
def ord1(spark, sf):
    d = edit_diff(spark, sf).withColumn("_key", algebra.delta_key())
    return d.orderBy(*ordering.delta_order("_key", "bigint")).select("old_key", "new_key", "change_type")


@query(
    "ORD1_MIXED",
    """SELECT key, CAST(row_number() OVER (ORDER BY key_is_text, num, key) AS BIGINT) AS position FROM (
 SELECT CAST(c_custkey AS STRING) AS key, 0 AS key_is_text, c_custkey AS num FROM customer
 UNION ALL SELECT c_name AS key, 1 AS key_is_text, NULL AS num FROM customer) k""",
)
def ord1_mixed(spark, sf):
    """Numbers by value before text; positions show the order."""
    from tidemark.operators.numbering import number_all

    c = fx.table(spark, sf, "customer")
    keys = c.select(F.col("c_custkey").alias("num"), F.lit(None).cast("string").alias("text")).unionByName(
        c.select(F.lit(None).cast("bigint").alias("num"), F.col("c_name").alias("text"))
    )
    placed = number_all(keys, ordering.mixed_order("num", "text"))
    return placed.select(F.coalesce("text", F.col("num").cast("string")).alias("key"), "position")


@query("ORD2", WITH_DIFF + "SELECT old_key, new_key, change_type FROM diff")
def ord2(spark, sf):
    """The same rows in whatever order tasks produce them; the plan has no sort."""
    return diffing.changed_keys(fx.orders(spark, sf), fx.edited(spark, sf), PK)


@query("ORD4", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def ord4(spark, sf):
    return ordering.first_rows(fx.orders(spark, sf), ["o_orderdate", "o_orderkey"], 100).select("o_orderkey", "o_custkey")


@query(
    "ORD6",
    WITH_DIFF + "SELECT CAST(count(*) FILTER (change_type <> 'update') AS BIGINT) AS candidates, count(*) FILTER (change_type <> 'update') > 400 AS over_limit FROM diff",
)
def ord6(spark, sf):
    """The work limit of rename detection as a report; the join itself needs no limit."""
    changed = diffing.changed_keys(fx.orders(spark, sf), fx.edited(spark, sf), PK)
    n = F.sum((F.col("change_type") != "update").cast("bigint"))
    return changed.agg(n.alias("candidates")).withColumn("over_limit", F.col("candidates") > 400)


# -- set operations -------------------------------------------------------------------


@query(
    "SET1",
    "SELECT url AS path FROM pages UNION SELECT url || '/new' FROM pages WHERE page_id % 2 = 0",
)
def set1(spark, sf):
    pages = fx.table(spark, sf, "pages")
    old = pages.select(F.col("url").alias("path"))
    new = pages.filter("page_id % 2 = 0").select(F.concat("url", F.lit("/new")).alias("path")).unionByName(old)
    return sets.all_paths(old, new).orderBy("path")


@query(
    "SET3",
    fx.ctes(edited=fx.EDITED)
    + """(SELECT o_orderkey, o_orderstatus, 'old' AS side FROM (SELECT o_orderkey, o_orderstatus FROM orders EXCEPT SELECT o_orderkey, o_orderstatus FROM edited) a)
UNION ALL (SELECT o_orderkey, o_orderstatus, 'new' AS side FROM (SELECT o_orderkey, o_orderstatus FROM edited EXCEPT SELECT o_orderkey, o_orderstatus FROM orders) b)""",
)
def set3(spark, sf):
    return sets.symmetric_difference(fx.orders(spark, sf), fx.edited(spark, sf), ["o_orderkey", "o_orderstatus"])


LINES = "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem"
LINES_EDITED = """SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey % 11 <> 0
UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey % 13 = 0"""


@query(
    "SET6",
    fx.ctes(a=LINES, b=LINES_EDITED)
    + """SELECT l_orderkey, l_linenumber, l_returnflag, 'base' AS side, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) x GROUP BY ALL
UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag, 'workspace' AS side, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) y GROUP BY ALL""",
)
def set6(spark, sf):
    return sets.row_mismatch(fx.derive(spark, sf, LINES), fx.derive(spark, sf, LINES_EDITED))


@query("SET5", "SELECT c_name AS name FROM customer WHERE c_custkey % 2 = 1")
def set5(spark, sf):
    customer = fx.table(spark, sf, "customer")
    datasets = customer.filter("c_custkey % 2 = 0").select(F.col("c_name").alias("name"))
    return sets.untracked(customer.select(F.col("c_name").alias("name")), datasets)
