"""History, refs, metadata and snapshots of a commit graph made from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import diffing, filters, history, ordering, patches, snapshots
from tidemark.operators.history import CommitGraph
from tidemark.plans import fixtures as fx
from tidemark.plans.registry import query

GRAPH = {
    "commits": fx.COMMITS,
    "refs": fx.REFS,
    "parents": """SELECT c.commit_id, c.p, c.nth FROM (SELECT commit_id, parent1 AS p, 1 AS nth FROM commits UNION ALL SELECT commit_id, parent2, 2 FROM commits) c JOIN commits k ON c.p = k.commit_id""",
    "reach": """SELECT name AS ref, commit_id AS tip, commit_id FROM refs UNION SELECT r.ref, r.tip, p.p AS commit_id FROM reach r JOIN parents p ON r.commit_id = p.commit_id""",
}


def graph_sql(**more: str) -> str:
    return fx.ctes(**GRAPH, **more).replace("WITH ", "WITH RECURSIVE ", 1)


def graph(spark, sf) -> CommitGraph:
    return CommitGraph(fx.commits(spark, sf))


def tips(spark, sf, *names: str):
    wanted = fx.refs(spark, sf).filter(F.col("name").isin(list(names)))
    return wanted.select(F.col("commit_id").alias("tip"))


def seqs_of(spark, sf, name: str, g: CommitGraph | None = None):
    """Seqs of the commits a ref reaches."""
    g = g or graph(spark, sf)
    reach = g.ancestors(tips(spark, sf, name)).select("commit_id")
    return g.commits.join(reach, "commit_id", "left_semi").select("seq")


def snapshot_sql(ref: str) -> str:
    """Rows of all datasets at a ref."""
    return f"""SELECT dataset, key, value FROM (SELECT dataset, key, max_by(op, seq) AS op, max_by(value, seq) AS value FROM changes
 WHERE seq IN (SELECT c.seq FROM commits c JOIN reach r ON c.commit_id = r.commit_id WHERE r.ref = '{ref}') GROUP BY dataset, key) s WHERE op = 'put'"""


def snapshot_at(spark, sf, ref: str, g: CommitGraph | None = None):
    seen = fx.changes(spark, sf).join(seqs_of(spark, sf, ref, g), "seq", "left_semi")
    return history.snapshot(seen, F.lit(1 << 60))


@query("HIS1", graph_sql() + """SELECT c.seq, c.commit_id, c.author, c.commit_time, (SELECT string_agg(name, ',' ORDER BY name) FROM refs f WHERE f.commit_id = c.commit_id) AS refs
FROM commits c WHERE commit_id IN (SELECT commit_id FROM reach WHERE ref IN ('main', 'release'))""")
def his1(spark, sf):
    out = history.log(graph(spark, sf), tips(spark, sf, "main", "release"), fx.refs(spark, sf))
    return out.select("seq", "commit_id", "author", "commit_time", "refs")


@query(
    "HIS2",
    graph_sql(changes=fx.CHANGES) + "SELECT seq, commit_id FROM commits WHERE seq IN (SELECT seq FROM changes WHERE dataset = 'click' AND key < 40)",
)
def his2(spark, sf):
    item = (F.col("dataset") == "click") & (F.col("key") < 40)
    return history.commits_touching(fx.commits(spark, sf), fx.changes(spark, sf), item).select("seq", "commit_id")


TREE_CHANGES = """SELECT coalesce(n.commit_id, o.commit_id) AS commit_id, coalesce(n.path, o.path) AS path, o.tree AS old_tree, n.tree AS new_tree
FROM trees n FULL OUTER JOIN (SELECT c.commit_id, t.path, t.tree FROM commits c JOIN trees t ON c.parent1 = t.commit_id) o ON n.commit_id = o.commit_id AND n.path = o.path
WHERE n.tree IS DISTINCT FROM o.tree"""


@query("HIS3", fx.ctes(commits=fx.COMMITS, trees=fx.TREES) + TREE_CHANGES)
def his3(spark, sf):
    return history.tree_changes(fx.commits(spark, sf), fx.trees(spark, sf)).select("commit_id", "path", "old_tree", "new_tree")


@query("JOI13", fx.ctes(commits=fx.COMMITS, trees=fx.TREES, d=TREE_CHANGES) + "SELECT commit_id, CAST(count(*) AS BIGINT) AS n_datasets FROM d GROUP BY commit_id")
def joi13(spark, sf):
    changed = history.tree_changes(fx.commits(spark, sf), fx.trees(spark, sf))
    return changed.groupBy("commit_id").agg(F.count(F.lit(1)).alias("n_datasets"))


#: For each commit the seqs of its strict ancestors on first parents, by walking parents.
CHAIN = {
    "own": "SELECT c.seq, c.commit_id, k.seq AS up FROM commits c LEFT JOIN commits k ON c.parent1 = k.commit_id",
    "chain": "SELECT seq AS tip, up AS anc FROM own WHERE up IS NOT NULL UNION ALL SELECT c.tip, o.up FROM chain c JOIN own o ON c.anc = o.seq WHERE o.up IS NOT NULL",
}
#: Changes against the first parent: the last change of the key on the chain tells what was there.
TYPED = """SELECT * FROM (SELECT seq, dataset, key, value, CASE WHEN op = 'put' AND was = 'put' THEN 'update' WHEN op = 'put' THEN 'insert' WHEN was = 'put' THEN 'delete' END AS change_type,
 CASE WHEN was = 'put' THEN old_value END AS old_value FROM (SELECT a.seq, a.dataset, a.key, max(a.op) AS op, max(a.value) AS value, max_by(b.op, b.seq) AS was, arg_max_null(b.value, b.seq) AS old_value
 FROM changes a LEFT JOIN (SELECT c.tip, x.* FROM chain c JOIN changes x ON x.seq = c.anc) b ON b.tip = a.seq AND b.dataset = a.dataset AND b.key = a.key GROUP BY a.seq, a.dataset, a.key) a) b WHERE change_type IS NOT NULL"""


def chain_sql(**more: str) -> str:
    return fx.ctes(commits=fx.COMMITS, changes=fx.CHANGES, **CHAIN, **more).replace("WITH ", "WITH RECURSIVE ", 1)


def main_changes(spark, sf):
    """Changes of the main line."""
    g = graph(spark, sf)
    return history.on_chain(fx.changes(spark, sf), g, tips(spark, sf, "main"))


#: Changes of the main line, as SQL: its tip and what the tip's chain holds.
MAIN = "SELECT x.* FROM changes x WHERE x.seq IN (SELECT max(seq) FROM commits WHERE seq % 5 <> 2) OR x.seq IN (SELECT anc FROM chain WHERE tip = (SELECT max(seq) FROM commits WHERE seq % 5 <> 2))"


def commit_at(spark, sf, seq: int):
    return fx.commits(spark, sf).filter(F.col("seq") == seq).select(F.col("commit_id").alias("tip"))


def seen_from(spark, sf, seq: int):
    """Seqs of a commit and all its ancestors."""
    g = graph(spark, sf)
    return g.commits.join(g.ancestors(commit_at(spark, sf, seq)).select("commit_id"), "commit_id", "left_semi").select("seq")


SEEN_FROM = "SELECT seq FROM commits WHERE seq = {0} UNION SELECT k.seq FROM seen s JOIN commits c ON c.seq = s.seq JOIN commits k ON k.commit_id = c.parent1 OR k.commit_id = c.parent2"


@query(
    "HIS4",
    chain_sql(typed=TYPED)
    + """SELECT seq, dataset, CAST(count(*) FILTER (change_type = 'insert') AS BIGINT) AS inserts, CAST(count(*) FILTER (change_type = 'update') AS BIGINT) AS updates,
 CAST(count(*) FILTER (change_type = 'delete') AS BIGINT) AS deletes FROM typed GROUP BY seq, dataset""",
)
def his4(spark, sf):
    return history.counts_per_commit(history.typed_changes(fx.changes(spark, sf), fx.commits(spark, sf)))


@query("HIS5", fx.ctes(commits=fx.COMMITS, changes=fx.CHANGES, seen=SEEN_FROM.format(17)).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT dataset, key, value FROM (SELECT dataset, key, max_by(op, seq) AS op, max_by(value, seq) AS value FROM changes WHERE seq IN (SELECT seq FROM seen) GROUP BY dataset, key) s WHERE op = 'put'")
def his5(spark, sf):
    """Rows at a commit: only what the commit and its ancestors changed."""
    seen = fx.changes(spark, sf).join(seen_from(spark, sf, 17), "seq", "left_semi")
    return history.snapshot(seen, 17)


@query("SRC4", graph_sql(changes=fx.CHANGES) + snapshot_sql("release"))
def src4(spark, sf):
    return snapshot_at(spark, sf, "release")


@query("HIS6", chain_sql(line=MAIN) + "SELECT dataset, key, seq, value, lag(value) OVER (PARTITION BY dataset, key ORDER BY seq) AS prev_value FROM line WHERE key % 2 = 0")
def his6(spark, sf):
    """Versions of rows on the main line."""
    out = history.row_history(main_changes(spark, sf), F.col("key") % 2 == 0)
    return out.select("dataset", "key", "seq", "value", "prev_value")


@query(
    "HIS7",
    graph_sql()
    + """SELECT a.name AS name, CAST((SELECT count(*) FROM reach r WHERE r.ref = a.name AND commit_id NOT IN (SELECT commit_id FROM reach WHERE ref = 'main')) AS BIGINT) AS ahead,
 CAST((SELECT count(*) FROM reach r WHERE r.ref = 'main' AND commit_id NOT IN (SELECT commit_id FROM reach s WHERE s.ref = a.name)) AS BIGINT) AS behind FROM refs a WHERE name <> 'main'""",
)
def his7(spark, sf):
    refs = fx.refs(spark, sf)
    main = refs.filter("name = 'main'").select("commit_id").scalar()
    pairs = refs.filter("name <> 'main'").select("name", F.col("commit_id").alias("branch"), main.alias("upstream"))
    counts = graph(spark, sf).ahead_behind(pairs.select("branch", "upstream"))
    return pairs.join(counts, ["branch", "upstream"]).select("name", "ahead", "behind")


@query("HIS9", fx.ctes(commits=fx.COMMITS, trees=fx.TREES, seen=SEEN_FROM.format(20)).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT path, max(seq) AS seq, max_by(tree, seq) AS tree FROM trees WHERE seq IN (SELECT seq FROM seen) GROUP BY path")
def his9(spark, sf):
    """Datasets at a commit: only versions that it and its ancestors made."""
    seen = fx.trees(spark, sf).join(seen_from(spark, sf, 20), "seq", "left_semi")
    versions = seen.withColumn("at", F.col("seq")).drop("commit_id")
    return snapshots.version_at(versions, 20).select("path", F.col("at").alias("seq"), "tree")


@query(
    "HIS10",
    graph_sql(changes=fx.CHANGES, rows_=snapshot_sql("main"))
    + "SELECT dataset, key AS old_key, 'delete' AS change_type, value FROM rows_ WHERE dataset IN ('click', 'view')",
)
def his10(spark, sf):
    gone = snapshot_at(spark, sf, "main").filter(F.col("dataset").isin("click", "view"))
    deltas = diffing.all_rows(gone, ["key"], "delete")
    return deltas.select(F.col("old.dataset").alias("dataset"), "old_key", "change_type", F.col("old.value").alias("value"))


@query(
    "HIS11",
    fx.ctes(trees=fx.TREES) + "SELECT CASE WHEN path = 'click' THEN 'archive/click' ELSE path END AS path, max_by(tree, seq) AS tree FROM trees GROUP BY path",
)
def his11(spark, sf):
    """A rename is a new path for the same tree."""
    now = snapshots.version_at(fx.trees(spark, sf).drop("commit_id"), 1 << 60)
    return now.withColumn("path", F.when(F.col("path") == "click", "archive/click").otherwise(F.col("path"))).select("path", "tree")


META_ITEMS = """SELECT p_name || '-' || CAST(p_partkey AS STRING) AS dataset, 'title' AS item, p_name AS value FROM part UNION ALL
SELECT p_name || '-' || CAST(p_partkey AS STRING) AS dataset, 'description' AS item, p_brand AS value FROM part UNION ALL
SELECT p_name || '-' || CAST(p_partkey AS STRING) AS dataset, 'schema.json' AS item, '[]' AS value FROM part"""


def meta_maps(spark, sf):
    part = fx.table(spark, sf, "part")
    meta = F.create_map(F.lit("title"), F.col("p_name"), F.lit("description"), F.col("p_brand"), F.lit("schema.json"), F.lit("[]"))
    return part.select(F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("dataset"), meta.alias("meta"))


@query("HIS12", fx.ctes(m=META_ITEMS) + "SELECT * FROM m WHERE item IN ('title', 'schema.json')")
def his12(spark, sf):
    wanted = F.map_filter("meta", lambda k, v: filters.meta_selected(k, ["title", "schema.json"]))
    return meta_maps(spark, sf).select("dataset", F.explode(wanted).alias("item", "value"))


@query(
    "HIS13",
    fx.ctes(m=META_ITEMS) + "SELECT dataset, item, CASE WHEN item = 'title' THEN 'New ' || value ELSE value END AS value FROM m WHERE item <> 'description'",
)
def his13(spark, sf):
    """Titles set anew, descriptions deleted by an empty value."""
    current = meta_maps(spark, sf).select("dataset", F.explode("meta").alias("item", "value"))
    wanted = current.filter("item <> 'schema.json'").select(
        "dataset", "item", F.col("value").alias("old_value"),
        F.when(F.col("item") == "title", F.concat(F.lit("New "), "value")).alias("new_value"),
    )
    delta = wanted.withColumn("change_type", F.when(F.col("new_value").isNull(), "delete").otherwise("update"))
    return patches.apply_meta(delta, current, ["dataset", "item"])


PAIRS_SQL = """SELECT event_type AS kind, 'c' || CAST(user_id AS STRING) AS base, 'c' || CAST(user_id + 1 + event_id % 3 AS STRING) AS target, CAST(max(event_id) AS STRING) AS data FROM events GROUP BY 1, 2, 3"""


@query(
    "HIS14",
    fx.ctes(p=PAIRS_SQL, cache="SELECT * FROM p WHERE CAST(data AS BIGINT) % 2 = 0", wanted="SELECT kind, target AS base, base AS target FROM p")
    + """SELECT w.kind, w.base, w.target, coalesce(a.data, b.data) AS data, a.data IS NULL AND b.data IS NOT NULL AS reversed FROM wanted w
 LEFT JOIN cache a ON w.kind = a.kind AND w.base = a.base AND w.target = a.target LEFT JOIN cache b ON w.kind = b.kind AND w.base = b.target AND w.target = b.base""",
)
def his14(spark, sf):
    pairs = fx.derive(spark, sf, PAIRS_SQL)
    cache = pairs.filter("CAST(data AS BIGINT) % 2 = 0")
    wanted = pairs.select("kind", F.col("target").alias("base"), F.col("base").alias("target"))
    return history.annotate(cache, wanted, symmetric=False)


@query(
    "HIS15",
    chain_sql(typed=TYPED)
    + """SELECT c.commit_id, t.dataset, CAST(count(*) AS BIGINT) AS n FROM commits c JOIN typed t ON c.seq = t.seq WHERE c.seq % 3 <> 0 GROUP BY 1, 2""",
)
def his15(spark, sf):
    commits = fx.commits(spark, sf)
    known = commits.filter("seq % 3 = 0").select("commit_id")
    todo = history.missing_annotations(commits, known)
    typed = history.typed_changes(fx.changes(spark, sf), commits)
    return todo.select("commit_id", "seq").join(typed, "seq").groupBy("commit_id", "dataset").agg(F.count(F.lit(1)).alias("n"))


@query(
    "DIF21",
    chain_sql(typed=TYPED)
    + """SELECT c.commit_id, c.author, t.dataset, t.key, t.change_type, t.old_value, CASE WHEN t.change_type <> 'delete' THEN t.value END AS new_value FROM typed t JOIN commits c ON c.seq = t.seq""",
)
def dif21(spark, sf):
    """Every commit against its first parent, with the commit's header."""
    commits = fx.commits(spark, sf)
    deltas = history.typed_changes(fx.changes(spark, sf), commits, values=["value"])
    return commits.select("seq", "commit_id", "author").join(deltas, "seq").select(
        "commit_id", "author", "dataset", "key", "change_type", F.col("prev_value").alias("old_value"),
        F.when(F.col("change_type") != "delete", F.col("value")).alias("new_value"),
    )


@query(
    "DIF3",
    graph_sql(
        changes=fx.CHANGES,
        base="SELECT max_by(commit_id, seq) AS commit_id FROM commits WHERE commit_id IN (SELECT commit_id FROM reach WHERE ref = 'main') AND commit_id IN (SELECT commit_id FROM reach WHERE ref = 'feature')",
        breach="SELECT commit_id FROM base UNION SELECT p.p AS commit_id FROM breach r JOIN parents p ON r.commit_id = p.commit_id",
        a=snapshot_sql("main"),
        b=snapshot_sql("feature"),
        m="""SELECT dataset, key, value FROM (SELECT dataset, key, max_by(op, seq) AS op, max_by(value, seq) AS value FROM changes
 WHERE seq IN (SELECT seq FROM commits JOIN breach USING (commit_id)) GROUP BY dataset, key) s WHERE op = 'put'""",
    )
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS form, coalesce(x.dataset, y.dataset) AS dataset, coalesce(x.key, y.key) AS key, CASE WHEN x.key IS NULL THEN 'insert' WHEN y.key IS NULL THEN 'delete' ELSE 'update' END AS change_type
FROM {left} x FULL OUTER JOIN b y ON x.dataset = y.dataset AND x.key = y.key WHERE x.key IS NULL OR y.key IS NULL OR x.value IS DISTINCT FROM y.value"""
        for name, left in (("A...B", "a"), ("A..B", "m"))
    ),
)
def dif3(spark, sf):
    """``main...feature`` compares the two; ``main..feature`` starts at their merge base."""
    g = graph(spark, sf)
    refs = fx.refs(spark, sf)
    named = refs.agg(
        F.max(F.when(F.col("name") == "main", F.col("commit_id"))).alias("a"), F.max(F.when(F.col("name") == "feature", F.col("commit_id"))).alias("b")
    )
    base = g.merge_bases(named).select(F.col("base").alias("tip"))
    below = g.ancestors(base).select("commit_id")
    at_base = fx.changes(spark, sf).join(g.commits.join(below, "commit_id", "left_semi").select("seq"), "seq", "left_semi")
    m = history.snapshot(at_base, F.lit(1 << 60))
    a, b = snapshot_at(spark, sf, "main", g), snapshot_at(spark, sf, "feature", g)
    out = []
    for name, left in (("A...B", a), ("A..B", m)):
        d = diffing.changed_keys(left, b, ["dataset", "key"])
        at = F.coalesce("old_key", "new_key")
        out.append(d.select(F.lit(name).alias("form"), at["dataset"].alias("dataset"), at["key"].alias("key"), "change_type"))
    return out[0].unionByName(out[1])


@query(
    "MRG1",
    graph_sql()
    + """SELECT a.name AS a_name, b.name AS b_name, (SELECT max_by(c.commit_id, c.seq) FROM commits c WHERE c.commit_id IN (SELECT commit_id FROM reach r WHERE r.ref = a.name) AND c.commit_id IN (SELECT commit_id FROM reach s WHERE s.ref = b.name)) AS base
FROM refs a, refs b WHERE a.name = 'main' AND b.name <> 'main'""",
)
def mrg1(spark, sf):
    refs = fx.refs(spark, sf)
    main = refs.filter("name = 'main'").select("commit_id").scalar()
    named = refs.filter("name <> 'main'").select(
        F.lit("main").alias("a_name"), main.alias("a"), F.col("name").alias("b_name"), F.col("commit_id").alias("b")
    )
    bases = graph(spark, sf).merge_bases(named.select("a", "b").distinct())
    return named.join(bases, ["a", "b"]).select("a_name", "b_name", "base")


@query(
    "SET4",
    graph_sql(up="SELECT p.commit_id AS tip, p.p AS commit_id FROM parents p JOIN refs f ON p.commit_id = f.commit_id UNION SELECT u.tip, p.p FROM up u JOIN parents p ON u.commit_id = p.commit_id")
    + "SELECT DISTINCT commit_id AS tip FROM refs WHERE commit_id NOT IN (SELECT commit_id FROM up)",
)
def set4(spark, sf):
    return graph(spark, sf).independent(fx.refs(spark, sf).select(F.col("commit_id").alias("tip")))


@query("ORD5", fx.ctes(commits=fx.COMMITS) + "SELECT seq, commit_id, commit_time FROM commits ORDER BY commit_time DESC, commit_id DESC LIMIT 10 OFFSET 3")
def ord5(spark, sf):
    return ordering.log_window(fx.commits(spark, sf), skip=3, max_count=10).select("seq", "commit_id", "commit_time")


OBJECTS = "SELECT seq, dataset, md5(dataset || '/' || CAST(key % 40 AS STRING) || '/' || CAST(CAST(floor(value / 25) AS BIGINT) AS STRING)) AS oid FROM changes WHERE op = 'put'"


@query(
    "SRC17",
    graph_sql(changes=fx.CHANGES, objects=OBJECTS, new="SELECT seq FROM commits WHERE commit_id IN (SELECT commit_id FROM reach WHERE ref = 'main') AND commit_id NOT IN (SELECT commit_id FROM reach WHERE ref = 'release')")
    + "SELECT oid, min(seq) AS seq, min_by(dataset, seq) AS dataset FROM objects WHERE seq IN (SELECT seq FROM new) GROUP BY oid",
)
def src17(spark, sf):
    """Objects that ``main`` has and ``release`` does not."""
    g = graph(spark, sf)
    new = seqs_of(spark, sf, "main", g).join(seqs_of(spark, sf, "release", g), "seq", "left_anti")
    value = F.floor(F.col("value") / 25).cast("bigint").cast("string")
    objects = fx.changes(spark, sf).filter("op = 'put'").select(
        "seq", "dataset", F.md5(F.concat_ws("/", "dataset", (F.col("key") % 40).cast("string"), value)).alias("oid")
    )
    return history.objects_between(objects, new)


CRS_HISTORY = "SELECT seq, event_type AS dataset, CASE WHEN seq < 6 THEN 'EPSG:4326' WHEN seq < 15 THEN 'EPSG:3857' ELSE 'EPSG:2193' END AS crs FROM (SELECT DISTINCT " + fx.SEQ + " AS seq, event_type FROM events) e"


@query(
    "JOI12",
    fx.ctes(changes=fx.CHANGES, h=CRS_HISTORY, last="SELECT dataset, crs, max(seq) AS last_seq FROM h GROUP BY 1, 2")
    + "SELECT c.seq, c.dataset, c.key, l.crs FROM changes c JOIN last l ON c.dataset = l.dataset AND l.last_seq >= c.seq",
)
def joi12(spark, sf):
    rows = fx.changes(spark, sf).select("seq", "dataset", "key")
    return history.crs_applicable(rows, fx.derive(spark, sf, CRS_HISTORY)).select("seq", "dataset", "key", "crs")


@query("SNK10", fx.ctes(edited=fx.EDITED, diff=fx.EDIT_DIFF) + "SELECT old_key, new_key, change_type, old_o_totalprice, new_o_totalprice, new_o_orderpriority FROM diff")
def snk10(spark, sf):
    """Two commits of ``orders`` to a store, and the diff read back from it."""
    from tidemark.session import scratch_path
    from tidemark.store import VersionStore

    store = VersionStore(spark, scratch_path(spark, "store"))
    first = store.commit({"orders": fx.orders(spark, sf)}, "import", pks={"orders": ["o_orderkey"]})
    store.commit({"orders": fx.edited(spark, sf)}, "edit")
    d = store.diff("orders", first, "main")
    return d.select(
        "old_key", "new_key", "change_type", F.col("old.o_totalprice").alias("old_o_totalprice"), F.col("new.o_totalprice").alias("new_o_totalprice"),
        F.col("new.o_orderpriority").alias("new_o_orderpriority"),
    )


@query("SNK10_DELTA", fx.ctes(edited=fx.EDITED, diff=fx.EDIT_DIFF) + "SELECT old_key, new_key, change_type, old_o_totalprice, new_o_totalprice, new_o_orderpriority FROM diff")
def snk10_delta(spark, sf):
    """A diff committed on the version it was made from, and read back from the store: the same row deltas."""
    from tidemark.operators.diffing import diff
    from tidemark.session import scratch_path
    from tidemark.store import VersionStore

    store = VersionStore(spark, scratch_path(spark, "store"))
    first = store.commit({"orders": fx.orders(spark, sf)}, "import", pks={"orders": ["o_orderkey"]})
    store.commit_delta("orders", diff(fx.orders(spark, sf), fx.edited(spark, sf), ["o_orderkey"]), "edit")
    d = store.diff("orders", first, "main")
    return d.select(
        "old_key", "new_key", "change_type", F.col("old.o_totalprice").alias("old_o_totalprice"), F.col("new.o_totalprice").alias("new_o_totalprice"),
        F.col("new.o_orderpriority").alias("new_o_orderpriority"),
    )


@query("HIS4_STORE", fx.ctes(edited=fx.EDITED, diff=fx.EDIT_DIFF) + """SELECT 'import' AS message, CAST(count(*) AS BIGINT) AS inserts, CAST(0 AS BIGINT) AS updates, CAST(0 AS BIGINT) AS deletes FROM orders
UNION ALL SELECT 'edit', CAST(count(*) FILTER (change_type = 'insert') AS BIGINT), CAST(count(*) FILTER (change_type = 'update') AS BIGINT), CAST(count(*) FILTER (change_type = 'delete') AS BIGINT) FROM diff""")
def his4_store(spark, sf):
    """Counts per commit of a dataset in a store."""
    from tidemark.session import scratch_path
    from tidemark.store import VersionStore

    store = VersionStore(spark, scratch_path(spark, "store"))
    store.commit({"orders": fx.orders(spark, sf)}, "import", pks={"orders": ["o_orderkey"]})
    store.commit({"orders": fx.edited(spark, sf)}, "edit")
    return store.commits().select("seq", "message").join(store.change_counts("orders"), "seq").select("message", "inserts", "updates", "deletes")


@query("HIS6_STORE", fx.ctes(edited=fx.EDITED, diff=fx.EDIT_DIFF) + """SELECT 'import' AS message, 'insert' AS change_type, CAST(NULL AS DOUBLE) AS old_price, o_totalprice AS new_price FROM orders WHERE o_custkey % 10 = 3
UNION ALL SELECT 'edit', change_type, old_o_totalprice, new_o_totalprice FROM diff WHERE coalesce(old_key, new_key) IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3)""")
def his6_store(spark, sf):
    """Every version of some rows of a dataset in a store."""
    from tidemark.session import scratch_path
    from tidemark.store import VersionStore

    store = VersionStore(spark, scratch_path(spark, "store"))
    store.commit({"orders": fx.orders(spark, sf)}, "import", pks={"orders": ["o_orderkey"]})
    store.commit({"orders": fx.edited(spark, sf)}, "edit")
    keys = fx.orders(spark, sf).filter("o_custkey % 10 = 3").select("o_orderkey")
    versions = store.row_history("orders", keys)
    shown = ["message", "change_type", F.col("old.o_totalprice").alias("old_price"), F.col("new.o_totalprice").alias("new_price")]
    return store.commits().select("seq", "message").join(versions, "seq").select(*shown)


@query("HIS11_STORE", "SELECT 'archive/customer' AS path, c_custkey, c_name || CASE WHEN c_custkey % 3 = 0 THEN '*' ELSE '' END AS c_name FROM customer")
def his11_store(spark, sf):
    """A dataset renamed in a store, then edited under its new path."""
    from tidemark.operators.diffing import diff
    from tidemark.session import scratch_path
    from tidemark.store import VersionStore

    customer = fx.table(spark, sf, "customer").select("c_custkey", "c_name")
    store = VersionStore(spark, scratch_path(spark, "store"))
    store.commit({"customer": customer}, "import", pks={"customer": ["c_custkey"]})
    store.rename("customer", "archive/customer", "rename")
    edited = customer.withColumn("c_name", F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name")))
    store.commit_delta("archive/customer", diff(customer, edited, ["c_custkey"]), "edit")
    named = store.datasets("main").select("path")
    return store.read("archive/customer", "main").join(named, F.lit(True)).select("path", "c_custkey", "c_name")


@query("SNK11", "SELECT url || '#' || CAST(page_id AS STRING) AS path, substr(sha256(html), 1, 40) AS oid, length(html) > 0 AS kept FROM pages WHERE page_id % 3 <> 0")
def snk11(spark, sf):
    """Files committed by path and content; empty ones are removed."""
    from tidemark.functions.hashing import hex_hash

    pages = fx.table(spark, sf, "pages").select(F.concat_ws("#", "url", F.col("page_id").cast("string")).alias("path"), "html", "page_id")
    files = pages.select("path", F.col("html").alias("content"))
    emptied = pages.filter("page_id % 3 = 0").select("path", F.lit(None).cast("string").alias("content"))
    datasets = fx.table(spark, sf, "nation").select(F.col("n_name").alias("dataset"))
    after = patches.apply_files(files, emptied, datasets)
    return after.select("path", hex_hash(F.col("content")).alias("oid"), (F.length("content") > 0).alias("kept"))


@query("SRC16", "SELECT split_part(path, '/', 1) AS dataset, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM (SELECT lang || '/' || source || '.txt' AS path, octet_length(encode(text)) AS n_bytes FROM documents) f GROUP BY 1")
def src16(spark, sf):
    """Attachments beside each dataset."""
    docs = fx.table(spark, sf, "documents").select(F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    beside = docs.withColumn("dataset", F.substring_index("path", "/", 1))
    return beside.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("content")).cast("bigint").alias("n_bytes"))

