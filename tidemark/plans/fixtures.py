"""Versions, edits and histories derived from the driver's tables.

Each is SQL that both Spark and DuckDB run unchanged, so a query and its SQL twin start
from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
_NAMES = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run fixture SQL over the tables of a folder."""
    used = {m.group(2) for m in _NAMES.finditer(sql)}
    text = _NAMES.sub(lambda m: f"{m.group(1)} {{{m.group(2)}}}", sql)
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in used})


def ctes(**parts: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in parts.items()) + "\n"


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

#: Deletes, single-column updates, a value set to NULL, inserts, and key changes.
EDITED = """
SELECT CASE WHEN o_orderkey % 20 = 13 THEN o_orderkey + 20000000 ELSE o_orderkey END AS o_orderkey, o_custkey,
       CASE WHEN o_orderkey % 20 = 7 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 20 = 5 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
       o_orderdate,
       CASE WHEN o_orderkey % 20 = 9 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders WHERE o_orderkey % 20 <> 3
UNION ALL
SELECT o_orderkey + 10000000 AS o_orderkey, o_custkey, 'N' AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderkey % 20 = 11
"""

#: A second round of edits on top of ``EDITED``: changes back, deletes of inserts, new updates.
EDITED_AGAIN = """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderstatus = 'X' AND o_orderkey % 40 = 7 THEN 'Y' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey < 10000000 AND o_orderkey % 40 = 5 THEN o_totalprice * 0.5 ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority
FROM edited WHERE NOT (o_orderkey >= 10000000 AND o_orderkey < 20000000 AND o_orderkey % 40 = 11)
  AND o_orderkey % 40 <> 9
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 60 = 3 THEN o_totalprice ELSE o_totalprice + 1 END AS o_totalprice,
       o_orderdate, o_orderpriority
FROM orders WHERE o_orderkey % 20 = 3 AND o_orderkey % 40 = 23
"""

OURS = """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 20 = 5 THEN 'O1' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 20 IN (1, 2) THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority
FROM orders WHERE o_orderkey % 20 NOT IN (3, 4)
UNION ALL
SELECT o_orderkey + 10000000 AS o_orderkey, o_custkey, 'OURS' AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderkey % 100 = 0
"""

THEIRS = """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderkey % 20 = 4 THEN 'T' WHEN o_orderkey % 20 = 6 THEN 'T1' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 20 = 1 THEN o_totalprice * 2 WHEN o_orderkey % 20 = 2 THEN o_totalprice * 0.5 ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority
FROM orders WHERE o_orderkey % 20 <> 3
UNION ALL
SELECT o_orderkey + 10000000 AS o_orderkey, o_custkey, 'THEIRS' AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderkey % 100 IN (0, 50)
"""

#: Day number of an event; one commit per day.
SEQ = (
    "CAST((EXTRACT(YEAR FROM ts) - 2024) * 372 + (EXTRACT(MONTH FROM ts) - 1) * 31 + EXTRACT(DAY FROM ts) - 1 AS BIGINT)"
)


def _commit(seq: str) -> str:
    return f"md5('commit-' || CAST({seq} AS STRING))"


#: In every five days: two commits on the main line, one on a side line, one more on the
#: main line, and a merge of both.
COMMITS = f"""
SELECT seq, {_commit('seq')} AS commit_id,
       CASE WHEN seq = 0 THEN NULL WHEN seq % 5 = 3 THEN {_commit('(seq - 2)')} ELSE {_commit('(seq - 1)')} END AS parent1,
       CASE WHEN seq % 5 = 4 THEN {_commit('(seq - 2)')} END AS parent2,
       'author' || CAST(seq % 3 AS STRING) AS author, 'committer' || CAST(seq % 2 AS STRING) AS committer,
       'Edit of ' || CAST(n AS STRING) || ' rows' AS message, commit_time
FROM (SELECT {SEQ} AS seq, count(*) AS n, max(ts) AS commit_time FROM events GROUP BY 1) days
"""

#: The last edit of a day counts; every seventh event deletes its row.
CHANGES = f"""
SELECT seq, dataset, key, CASE WHEN event_id % 7 = 0 THEN 'del' ELSE 'put' END AS op, value, event_id
FROM (SELECT {SEQ} AS seq, event_type AS dataset, user_id AS key, max_by(value, event_id) AS value, max(event_id) AS event_id
      FROM events GROUP BY 1, 2, 3) last_edits
"""

#: Tree ids that often equal those of the day before.
TREES = f"""
SELECT seq, {_commit('seq')} AS commit_id, path, md5(path || CAST(n % 4 AS STRING)) AS tree
FROM (SELECT {SEQ} AS seq, event_type AS path, count(*) AS n FROM events GROUP BY 1, 2) days
"""

REFS = """
SELECT 'main' AS name, max_by(commit_id, seq) AS commit_id FROM commits WHERE seq % 5 <> 2
UNION ALL SELECT 'feature' AS name, max_by(commit_id, seq) AS commit_id FROM commits WHERE seq % 5 = 2
UNION ALL SELECT 'release' AS name, max_by(commit_id, seq) AS commit_id FROM commits WHERE seq % 10 = 4
"""

#: Points made from customer keys.
POINTS = """
SELECT c_custkey AS fid, CAST(c_custkey % 360 - 180 AS DOUBLE) AS x, CAST(c_custkey % 180 - 90 AS DOUBLE) AS y, c_name AS name
FROM customer
"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, EDITED)


def edited_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, ctes(edited=EDITED) + EDITED_AGAIN)


def ours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, OURS)


def theirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, THEIRS)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = derive(spark, sf_dir, COMMITS)
    return flat.withColumn("parents", F.array_compact(F.array("parent1", "parent2")))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, CHANGES)


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, TREES)


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, ctes(commits=COMMITS) + REFS)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, POINTS)


def flat(delta: DataFrame, columns: list[str], extra: list[str] = []) -> DataFrame:
    """A delta frame as plain columns."""
    return delta.select(
        "old_key",
        "new_key",
        "change_type",
        *[F.col("old")[c].alias(f"old_{c}") for c in columns],
        *[F.col("new")[c].alias(f"new_{c}") for c in columns],
        *extra,
    )


def diff_sql(old: str, new: str, pk: str, columns: list[str]) -> str:
    """SQL of a diff between two relations, as :func:`flat` shows it."""
    rest = [c for c in columns if c != pk]
    sides = ", ".join([f"a.{c} AS old_{c}" for c in columns] + [f"b.{c} AS new_{c}" for c in columns])
    differs = " OR ".join([f"a.{c} IS DISTINCT FROM b.{c}" for c in rest])
    return f"""SELECT a.{pk} AS old_key, b.{pk} AS new_key,
       CASE WHEN a.{pk} IS NULL THEN 'insert' WHEN b.{pk} IS NULL THEN 'delete' ELSE 'update' END AS change_type, {sides}
FROM {old} a FULL OUTER JOIN {new} b ON a.{pk} = b.{pk}
WHERE a.{pk} IS NULL OR b.{pk} IS NULL OR {differs}"""


EDIT_DIFF = diff_sql("orders", "edited", "o_orderkey", ORDER_COLUMNS)
