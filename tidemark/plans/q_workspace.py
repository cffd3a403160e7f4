"""Workspaces: an edited copy of ``orders`` with a list of touched keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import aggregates, workspace
from tidemark.plans import fixtures as fx
from tidemark.plans.q_diff import COLS, PK, columns
from tidemark.plans.registry import query

KEY = "o_orderkey"
#: Keys that were touched: all real edits and some rows that were changed back.
DIRTY = """SELECT DISTINCT CAST(k AS STRING) AS pk FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 20 IN (3, 5, 7, 9, 13, 2)
UNION ALL SELECT o_orderkey + 10000000 AS k FROM orders WHERE o_orderkey % 20 = 11 UNION ALL SELECT o_orderkey + 20000000 AS k FROM orders WHERE o_orderkey % 20 = 13) d"""
WITH = fx.ctes(edited=fx.EDITED, dirty=DIRTY, diff=fx.EDIT_DIFF)


def dirty(spark, sf):
    return fx.derive(spark, sf, DIRTY)


def ws_diff(spark, sf):
    return workspace.workspace_diff(fx.orders(spark, sf), fx.edited(spark, sf), dirty(spark, sf), KEY)


@query("JOI2", WITH + "SELECT d.pk AS key, e.o_totalprice AS price, e.o_orderkey IS NULL AS deleted FROM dirty d LEFT JOIN edited e ON d.pk = CAST(e.o_orderkey AS STRING)")
def joi2(spark, sf):
    rows = workspace.dirty_rows(fx.edited(spark, sf), dirty(spark, sf), PK)
    return rows.select("key", F.col("row.o_totalprice").alias("price"), F.col("row").isNull().alias("deleted"))


@query("JOI3", WITH + "SELECT old_key, new_key, change_type FROM diff")
def joi3(spark, sf):
    return ws_diff(spark, sf).select("old_key", "new_key", "change_type")


@query("DIF15", WITH + f"SELECT old_key, new_key, change_type, {columns('old_')}, {columns('new_')}, 1 AS flags FROM diff")
def dif15(spark, sf):
    return fx.flat(ws_diff(spark, sf), COLS, ["flags"])


@query("WSP1", fx.ctes(p=fx.POINTS) + "SELECT fid, x, y FROM p WHERE x > -50 AND x < 50 AND y > -30 AND y < 30")
def wsp1(spark, sf):
    """Rows inside an area written as a workspace table, and read back."""
    from tidemark.operators import spatial
    from tidemark.session import scratch_path

    area = spatial.Area([[[(-50.0, -30.0), (50.0, -30.0), (50.0, 30.0), (-50.0, 30.0), (-50.0, -30.0)]]])
    rows = fx.points(spark, sf).withColumn("geom", spatial.point(F.col("x"), F.col("y")))
    path = scratch_path(spark, "workspace")
    workspace.materialise(rows, area.matches(F.col("geom")), path)
    return spark.read.parquet(path).select("fid", "x", "y")


LOG = "SELECT event_id, user_id AS k, CASE WHEN event_id % 9 = 0 THEN user_id + 1 END AS old_k, event_type AS table_name FROM events"


@query(
    "WSP2",
    fx.ctes(l=LOG) + "SELECT DISTINCT table_name, CAST(k AS STRING) AS pk FROM (SELECT table_name, k FROM l UNION ALL SELECT table_name, old_k FROM l WHERE old_k IS NOT NULL) a",
)
def wsp2(spark, sf):
    return workspace.touched_by(fx.derive(spark, sf, LOG), "k", "old_k", ["table_name"])


@query("WSP3", WITH + "SELECT count(*) > 0 AS is_dirty FROM diff")
def wsp3(spark, sf):
    return workspace.is_dirty(fx.orders(spark, sf), fx.edited(spark, sf), dirty(spark, sf), KEY)


@query("WSP4", "SELECT event_type AS table_name, CAST(count(DISTINCT user_id) AS BIGINT) AS n FROM events GROUP BY 1")
def wsp4(spark, sf):
    touched = fx.table(spark, sf, "events").select(F.col("event_type").alias("table_name"), F.col("user_id").cast("string").alias("pk"))
    return workspace.tracked_counts(touched)


@query("WSP5", WITH + "SELECT * FROM edited WHERE CAST(o_orderkey AS STRING) NOT IN (SELECT pk FROM dirty WHERE CAST(pk AS BIGINT) % 3 = 0) UNION ALL SELECT * FROM orders WHERE CAST(o_orderkey AS STRING) IN (SELECT pk FROM dirty WHERE CAST(pk AS BIGINT) % 3 = 0)")
def wsp5(spark, sf):
    some = dirty(spark, sf).filter(F.col("pk").cast("bigint") % 3 == 0)
    return workspace.discard(fx.orders(spark, sf), fx.edited(spark, sf), some, KEY)


@query("WSP6", fx.ctes(edited=fx.EDITED) + fx.EDITED_AGAIN)
def wsp6(spark, sf):
    """A clean workspace at one version moved to the next."""
    return workspace.move_to(fx.edited(spark, sf), fx.edited_again(spark, sf), KEY)


@query(
    "WSP7",
    fx.ctes(edited=fx.EDITED, diff=fx.EDIT_DIFF)
    + "SELECT DISTINCT CAST(k AS STRING) AS pk FROM (SELECT old_key AS k FROM diff UNION ALL SELECT new_key AS k FROM diff) a WHERE k IS NOT NULL",
)
def wsp7(spark, sf):
    return workspace.restore(fx.orders(spark, sf), fx.edited(spark, sf), KEY)[1]


@query("WSP8", WITH + "SELECT pk FROM dirty WHERE pk NOT IN (SELECT CAST(coalesce(new_key, old_key) AS STRING) FROM diff WHERE change_type <> 'update')")
def wsp8(spark, sf):
    """Touched keys left after committing inserts and deletes."""
    committed = ws_diff(spark, sf).filter("change_type <> 'update'").select(F.coalesce("new_key", "old_key").cast("string").alias("pk"))
    return workspace.clear_committed(dirty(spark, sf), committed)


@query("WSP9", WITH + "SELECT change_type, CAST(count(*) AS BIGINT) AS n FROM diff GROUP BY change_type")
def wsp9(spark, sf):
    """Workspace edits committed to a store as a diff; the counts of the new commit are read from it."""
    store, first = ws_store(spark, sf)
    workspace.commit_edits(store, "orders", ws_diff(spark, sf), dirty(spark, sf), "workspace edits")
    return store.counts("orders", first, "main")


def ws_store(spark, sf):
    from tidemark.session import scratch_path
    from tidemark.store import VersionStore

    store = VersionStore(spark, scratch_path(spark, "store"))
    return store, store.commit({"orders": fx.orders(spark, sf)}, "import", pks={"orders": PK})


@query("WSP9_LEFT", WITH + "SELECT pk FROM dirty WHERE pk NOT IN (SELECT CAST(coalesce(new_key, old_key) AS STRING) FROM diff)")
def wsp9_left(spark, sf):
    """Touched keys after the commit: those of rows that ended as they began."""
    store, _ = ws_store(spark, sf)
    return workspace.commit_edits(store, "orders", ws_diff(spark, sf), dirty(spark, sf), "workspace edits")


@query("WSP10_COMMIT", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def wsp10_commit(spark, sf):
    """The untracked table as the store gives it back after its commit."""
    store, _ = ws_store(spark, sf)
    workspace.add_untracked(store, "customer", fx.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_custkey"], "add")
    return store.read("customer", "main")


@query("WSP10", "SELECT c_custkey AS new_key, 'insert' AS change_type, c_name AS name, 1 AS flags FROM customer")
def wsp10(spark, sf):
    """A table nobody tracked becomes a dataset."""
    from tidemark.operators.diffing import WORKSPACE_EDIT, all_rows

    added = all_rows(fx.table(spark, sf, "customer"), ["c_custkey"], "insert", WORKSPACE_EDIT)
    return added.select("new_key", "change_type", F.col("new.c_name").alias("name"), "flags")


CHECK = WITH.rstrip() + ",\n" + """part_dirty AS (SELECT pk FROM dirty WHERE CAST(pk AS BIGINT) % 20 <> 7)
SELECT 'base_rows' AS measure, CAST(count(*) AS BIGINT) AS n FROM orders UNION ALL SELECT 'workspace_rows', count(*) FROM edited UNION ALL SELECT 'dirty_keys', count(*) FROM part_dirty
UNION ALL SELECT 'changed_rows', count(*) FROM diff UNION ALL SELECT 'untracked_changes', count(*) FROM diff WHERE CAST(coalesce(old_key, new_key) AS STRING) NOT IN (SELECT pk FROM part_dirty)"""


@query("AGG16", CHECK)
def agg16(spark, sf):
    some = dirty(spark, sf).filter(F.col("pk").cast("bigint") % 20 != 7)
    return workspace.check(fx.orders(spark, sf), fx.edited(spark, sf), some, KEY)


@query(
    "WSP12",
    WITH
    + """SELECT d.pk AS key, CASE WHEN x.k IS NULL THEN 'R' WHEN x.change_type = 'insert' THEN 'I' WHEN x.change_type = 'delete' THEN 'D' ELSE 'U' END AS state
FROM dirty d LEFT JOIN (SELECT CAST(coalesce(old_key, new_key) AS STRING) AS k, change_type FROM diff) x ON d.pk = x.k""",
)
def wsp12(spark, sf):
    return workspace.dirty_report(fx.orders(spark, sf), fx.edited(spark, sf), dirty(spark, sf), KEY)


@query(
    "WSP13",
    WITH + "SELECT 'orders' AS dataset, CAST(count(*) FILTER (change_type = 'insert') AS BIGINT) AS inserts, CAST(count(*) FILTER (change_type = 'update') AS BIGINT) AS updates, CAST(count(*) FILTER (change_type = 'delete') AS BIGINT) AS deletes FROM diff",
)
def wsp13(spark, sf):
    return aggregates.type_count_columns(ws_diff(spark, sf).withColumn("dataset", F.lit("orders")), ["dataset"])


@query("WSP14", "SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def wsp14(spark, sf):
    keys = fx.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias(KEY))
    return workspace.delete_rows(fx.orders(spark, sf), keys, KEY)


@query("WSP11", "SELECT p_partkey, p_type FROM part WHERE p_type NOT IN ('ECONOMY', 'PROMO')")
def wsp11(spark, sf):
    """Datasets named as excluded are never written to a workspace."""
    from tidemark.operators.filters import exclude_datasets

    return exclude_datasets(fx.table(spark, sf, "part").select("p_partkey", "p_type"), ["ECONOMY", "PROMO"], "p_type")


@query(
    "WSP12_ERRORS",
    WITH + "SELECT CAST(coalesce(old_key, new_key) AS STRING) AS key, upper(substr(change_type, 1, 1)) AS state FROM diff WHERE CAST(coalesce(old_key, new_key) AS STRING) NOT IN (SELECT pk FROM dirty WHERE CAST(pk AS BIGINT) % 20 <> 7) ORDER BY key LIMIT 100",
)
def wsp12_errors(spark, sf):
    """The first hundred rows that differ and were not tracked."""
    some = dirty(spark, sf).filter(F.col("pk").cast("bigint") % 20 != 7)
    return workspace.row_errors(fx.orders(spark, sf), fx.edited(spark, sf), some, KEY)


@query(
    "WSP13_REPORT",
    WITH
    + """SELECT 'changes' AS section, 'orders' AS name, change_type AS what, CAST(count(*) AS BIGINT) AS n FROM diff GROUP BY change_type
 UNION ALL SELECT 'untracked', n_name, 'table', 1 FROM nation UNION ALL SELECT 'branch', 'origin', 'ahead', 1 UNION ALL SELECT 'branch', 'origin', 'behind', 0
 UNION ALL SELECT 'merge', 'main', 'conflicts', CAST(count(*) AS BIGINT) FROM diff WHERE change_type = 'update'""",
)
def wsp13_report(spark, sf):
    """A workspace in a merge, one commit ahead, with edits and with tables named after nations that nobody tracks."""
    store, first = ws_store(spark, sf)
    store.move_ref("origin", first)
    store.commit_delta("orders", None, "title", meta={"title": "Orders"})
    tables = fx.table(spark, sf, "nation").select(F.col("n_name").alias("name")).unionByName(store.datasets("main").select(F.col("path").alias("name")))
    edits = ws_diff(spark, sf)
    return workspace.status(store, {"orders": edits}, tables, upstream="origin", conflicts=edits.filter("change_type = 'update'"))
