"""A version store: commits, refs and datasets as Parquet tables in one folder.

Layout below the root::

    commits/            one row per commit, with its place in the commit graph: the seqs of its
                        parents, its lane, and where the lane hangs
    refs/               log of ref moves; the last move of a name counts
    versions/           dataset versions: commit, path, schema, meta, checksum
    data/<n>/changes/   rows changed by a commit, columns named by column id
    data/<n>/snapshots/ whole rows of some versions, so that replay stays short
    buckets/            per-bucket checksums of versions

Rows of ``changes`` and ``snapshots`` carry the bucket of their key and are written in its
order, so that a reader of a few keys or buckets skips most files and row groups by their
statistics. A commit of a diff reads the touched buckets only, and works out the new
checksums from the old ones: exclusive-or takes the hash of a replaced row out again.

A commit writes its data first and its ``commits`` row last, so a reader never sees half
of one. There is one writer; readers need no lock.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.hashing import fingerprint
from tidemark.operators import diffing, history
from tidemark.operators.aggregates import ACCURACY, bucket_of, bucket_sums, differing_buckets, type_counts
from tidemark.operators.history import CommitGraph
from tidemark.operators.schemas import path_problem, violation_examples
from tidemark.schema import VersionedSchema, spark_type
from tidemark.session import cut

COMMITS = T.StructType(
    [
        T.StructField("commit_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("parents", T.ArrayType(T.StringType())),
        T.StructField("author", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("commit_time", T.TimestampType()),
        T.StructField("offset_min", T.IntegerType()),
        T.StructField("ups", T.ArrayType(T.LongType())),
        T.StructField("lane", T.LongType()),
        T.StructField("up_lane", T.LongType()),
        T.StructField("fork_seq", T.LongType()),
    ]
)
REFS = T.StructType(
    [
        T.StructField("move", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("commit_id", T.StringType()),
    ]
)
VERSIONS = T.StructType(
    [
        T.StructField("commit_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("slot", T.StringType()),
        T.StructField("schema_json", T.StringType()),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
        T.StructField("row_count", T.LongType()),
        T.StructField("checksum", T.StringType()),
        T.StructField("dropped", T.BooleanType()),
    ]
)

#: A whole snapshot is written whenever this many change sets lie behind the last one.
SNAPSHOT_EVERY = 16
BUCKETS = 4096
#: Up to so many buckets are named in a filter that the scan can prune by.
PRUNED_BUCKETS = 1024


class NoChanges(Exception):
    """The commit would not change anything."""


class InvalidRows(Exception):
    """Rows break the rules of their schema."""


class DoesNotFit(Exception):
    """A diff was made from other rows than those it is to be committed on."""


@dataclass(frozen=True)
class Version:
    commit_id: str
    seq: int
    slot: str
    schema: VersionedSchema
    meta: dict[str, str]
    row_count: int
    checksum: str


def _literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType) and value:
        return F.array(*[F.lit(v) for v in value]).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map(*[F.lit(x) for pair in (value or {}).items() for x in pair]).cast(kind)
    return F.lit(value).cast(kind)


class VersionStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        # What a commit id stands for never changes, so it is worked out once.
        self._chains: dict[str, DataFrame] = {}
        self._versions: dict[tuple[str, str], Version | None] = {}
        self._stored_under: dict[tuple[str, int | None], list[tuple[VersionedSchema, list[int]]]] = {}

    # -- small tables ---------------------------------------------------------------

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        path = f"{self.root}/{name}"
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _append(self, name: str, row: tuple, schema: T.StructType) -> None:
        """One row as literals of a plan: nothing goes through Python workers."""
        cols = [_literal(v, f.dataType).alias(f.name) for v, f in zip(row, schema.fields)]
        self.spark.range(1, numPartitions=1).select(*cols).write.mode("append").parquet(f"{self.root}/{name}")

    def commits(self) -> DataFrame:
        return self._table("commits", COMMITS)

    def refs(self) -> DataFrame:
        moves = self._table("refs", REFS)
        last = moves.groupBy("name").agg(F.max_by("commit_id", "move").alias("commit_id"))
        return last.filter(F.col("commit_id").isNotNull())

    def versions(self) -> DataFrame:
        return self._table("versions", VERSIONS)

    def graph(self) -> CommitGraph:
        """The commit graph as the commits were written: nothing is worked out anew."""
        return CommitGraph(self.commits())

    def _record(self, commit_id: str, seq: int, parents: list[str], author: str, message: str) -> None:
        """Appends a commit. It takes its parent's lane further if it is the first to do so, else it opens a lane."""
        known = {r.commit_id: r for r in self.commits().filter(F.col("commit_id").isin(parents)).collect()} if parents else {}
        ups = [known[p].seq if p in known else None for p in parents]
        first = known.get(parents[0]) if parents else None
        place = (seq, None, None)
        if first is not None:
            last = self.commits().filter(F.col("lane") == first.lane).agg(F.max("seq")).first()[0]
            place = (first.lane, first.up_lane, first.fork_seq) if last == first.seq else (seq, first.lane, first.seq)
        now = self.spark.sql("SELECT current_timestamp()").first()[0]
        self._append("commits", (commit_id, seq, parents, author, message, now, 0, ups, *place), COMMITS)

    def resolve(self, revision: str) -> str | None:
        """Commit id of a ref, an id or a unique prefix of one, with ``^`` and ``~n`` suffixes."""
        if revision in self._chains:
            return revision
        base, steps = revision, 0
        while base and (base.endswith("^") or "~" in base):
            if base.endswith("^"):
                base, steps = base[:-1], steps + 1
            else:
                base, _, n = base.rpartition("~")
                steps += int(n or 1)
        if base == "[EMPTY]":
            return None
        found = self.refs().filter(F.col("name") == base).select("commit_id").limit(2).collect()
        if not found:
            found = self.commits().filter(F.col("commit_id").startswith(base)).select("commit_id").limit(2).collect()
        if len(found) != 1:
            raise KeyError(f"no such revision: {revision}" if not found else f"ambiguous revision: {revision}")
        commit = found[0][0]
        if steps:
            # Seqs fall along first parents, so the n-th commit down is the n-th of the chain.
            line = self.commits().join(self._chain(commit), "commit_id", "left_semi")
            down = line.orderBy(F.col("seq").desc()).offset(steps).select("commit_id").first()
            if down is None:
                raise KeyError(f"no such revision: {revision}")
            commit = down.commit_id
        return commit

    def move_ref(self, name: str, commit_id: str | None) -> None:
        self._append("refs", (time.time_ns(), name, commit_id), REFS)

    # -- datasets -------------------------------------------------------------------

    def _chain(self, commit: str) -> DataFrame:
        """Commits a version is made of: the commit, its first parent, and so on down."""
        if commit not in self._chains:
            row = self.commits().filter(F.col("commit_id") == commit).first()
            below = self._chains.get(row.parents[0]) if row.parents else None
            own = self.spark.createDataFrame([(commit,)], "commit_id string")
            if below is not None:
                self._chains[commit] = cut(below.unionByName(own).coalesce(1))
                return self._chains[commit]
            tips = self.spark.createDataFrame([(commit,)], "tip string")
            self._chains[commit] = cut(self.graph().first_parent_chain(tips).select("commit_id"))
        return self._chains[commit]

    def version(self, path: str, revision: str) -> Version | None:
        commit = self.resolve(revision)
        if commit is None:
            return None
        if (path, commit) not in self._versions:
            self._versions[path, commit] = self._find_version(path, commit)
        return self._versions[path, commit]

    def _find_version(self, path: str, commit: str) -> Version | None:
        found = self.versions().filter(F.col("path") == path).join(self._chain(commit), "commit_id", "left_semi")
        row = found.orderBy(F.col("seq").desc()).first()
        if row is None or row.dropped:
            return None
        schema = VersionedSchema.from_json(row.schema_json)
        return Version(row.commit_id, row.seq, row.slot, schema, dict(row.meta or {}), row.row_count, row.checksum)

    def datasets(self, revision: str) -> DataFrame:
        """``path`` and version facts of every dataset at a revision."""
        commit = self.resolve(revision)
        if commit is None:
            return self.versions().limit(0)
        seen = self.versions().join(self._chain(commit), "commit_id", "left_semi")
        facts = F.struct("seq", "commit_id", "slot", "schema_json", "row_count", "checksum", "dropped")
        latest = seen.groupBy("path").agg(F.max_by(facts, F.col("seq")).alias("_v"))
        return latest.filter(~F.col("_v.dropped")).select("path", "_v.*").drop("dropped")

    def read(self, path: str, revision: str) -> DataFrame:
        """Rows of a dataset at a revision, through the schema it had there."""
        v = self.version(path, revision)
        if v is None:
            raise KeyError(f"no dataset {path} at {revision}")
        stored = self._stored(v, self.resolve(revision))
        return v.schema.read(stored)

    def _legends(self, v: Version, upto: int | None) -> list[tuple[VersionedSchema, list[int]]]:
        """Schemas that rows of a layout were stored under, each with the seqs of its commits, up to a seq."""
        known = self._stored_under.get((v.slot, upto))
        if known is None:
            held = self.versions().filter((F.col("slot") == v.slot) & ~F.col("dropped"))
            held = held if upto is None else held.filter(F.col("seq") <= upto)
            known = [(VersionedSchema.from_json(r.schema_json), list(r.seqs)) for r in held.groupBy("schema_json").agg(F.collect_set("seq").alias("seqs")).collect()]
            if upto is not None:
                self._stored_under[v.slot, upto] = known
        return known

    def _change_log(self, v: Version, upto: int | None = None) -> DataFrame:
        """Stored changes of a layout, with the columns of a version, on all branches.

        The stored schemas say what the files hold, so no file is opened to learn it. Commits that stored a
        column as another type are read as they were written, and cast.
        """
        path = f"{self.root}/data/{v.slot}/changes"
        groups: dict[tuple, list[int]] = {}
        for schema, seqs in self._legends(v, upto):
            groups.setdefault(self._physical(v, schema), []).extend(seqs)
        if len(groups) == 1:
            return self.spark.read.schema(self._file_schema(v, next(iter(groups)), "_op string, _bucket int, seq bigint, commit_id string")).parquet(path)
        parts = []
        for kinds, seqs in groups.items():
            rows = self.spark.read.schema(self._file_schema(v, kinds, "_op string, _bucket int, seq bigint, commit_id string")).parquet(path)
            parts.append(self._as_now(v, rows.filter(F.col("seq").isin(seqs))))
        return reduce(DataFrame.unionByName, parts)

    @staticmethod
    def _physical(v: Version, schema: VersionedSchema) -> tuple:
        """Types in the files of another schema where they differ from those of a version."""
        there = schema.by_id()
        kinds = ((c.id, spark_type(there[c.id]).simpleString()) for c in v.schema.columns if c.id in there and spark_type(there[c.id]) != spark_type(c))
        return tuple(sorted(kinds))

    @staticmethod
    def _file_schema(v: Version, kinds: tuple, more: str) -> str:
        other = dict(kinds)
        own = [f"`{c.id}` {other.get(c.id, spark_type(c).simpleString())}" for c in v.schema.columns]
        return ", ".join([*own, more])

    @staticmethod
    def _as_now(v: Version, rows: DataFrame) -> DataFrame:
        return rows.withColumns({c.id: F.col(f"`{c.id}`").cast(spark_type(c)) for c in v.schema.columns})

    def _changes(self, v: Version, after: int, commit: str) -> DataFrame:
        """What the commits of a version stored after ``after``, as written."""
        return self._change_log(v, v.seq).filter((F.col("seq") > after) & (F.col("seq") <= v.seq)).join(self._chain(commit), "commit_id", "left_semi")

    def _stored(self, v: Version, commit: str, keys: DataFrame | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Latest stored row per key: the newest snapshot on the chain, then later changes.

        ``keys`` (columns by id) and ``buckets`` limit both before anything is gathered; a short
        list of buckets is a filter that the scan prunes files and row groups by.
        """
        chain = self._chain(commit)
        base = f"{self.root}/data/{v.slot}"
        pk = [c.id for c in v.schema.columns if c.pk_index is not None]
        snaps = f"{base}/snapshots"
        start, rows = -1, None
        if self._exists(snaps):
            marked = self.spark.read.schema("_bucket int, seq bigint, commit_id string").parquet(snaps)
            marks = marked.select("seq", "commit_id").distinct().join(chain, "commit_id", "left_semi")
            mark = marks.orderBy(F.col("seq").desc()).first()
            if mark is not None:
                start = mark.seq
                legend = next(schema for schema, seqs in self._legends(v, v.seq) if start in seqs)
                held = self._file_schema(v, self._physical(v, legend), "_bucket int")
                rows = self.spark.read.schema(held).parquet(f"{snaps}/seq={start}/commit_id={mark.commit_id}")
                rows = self._as_now(v, rows)
        later = self._changes(v, start, commit)
        if buckets is not None and len(buckets) <= PRUNED_BUCKETS:
            later = later.filter(F.col("_bucket").isin(buckets))
            rows = None if rows is None else rows.filter(F.col("_bucket").isin(buckets))
        elif buckets is not None:
            wanted = self.spark.createDataFrame([(b,) for b in buckets], "_bucket int")
            later = later.join(F.broadcast(wanted), "_bucket", "left_semi")
            rows = None if rows is None else rows.join(F.broadcast(wanted), "_bucket", "left_semi")
        later = later.drop("_bucket")
        rows = None if rows is None else rows.drop("_bucket")
        if keys is not None:
            later = later.join(keys, pk, "left_semi")
            rows = None if rows is None else rows.join(keys, pk, "left_semi")
        cols = [c for c in later.columns if c not in ("seq", "commit_id", "_op", *pk)]
        latest = later.groupBy(*pk).agg(F.max_by(F.struct("_op", *cols), F.col("seq")).alias("_l"))
        put = latest.filter(F.col("_l._op") == "put").select(*pk, *[F.col("_l")[c].alias(c) for c in cols])
        if rows is None:
            return put
        kept = rows.join(latest.select(*pk), pk, "left_anti")
        return kept.unionByName(put, allowMissingColumns=True)

    # -- writing --------------------------------------------------------------------

    def commit(
        self,
        tables: Mapping[str, DataFrame | None],
        message: str,
        *,
        ref: str = "main",
        pks: Mapping[str, list[str]] | None = None,
        metas: Mapping[str, Mapping[str, str]] | None = None,
        schemas: Mapping[str, VersionedSchema] | None = None,
        author: str = "",
        parents: list[str] | None = None,
        allow_empty: bool = False,
        amend: bool = False,
    ) -> str:
        """Record the given tables as the next version of ``ref`` (``None`` drops a dataset).

        Rows are checked against their schema, only changed rows are stored, and a commit
        without changes is an error unless ``allow_empty``. ``schemas`` declares narrower types
        than those of the DataFrame; their key columns are those of ``pks``.
        """
        try:
            head = self.resolve(ref)
        except KeyError:
            head = None
        if parents is None:
            if amend and head is not None:
                parents = list(self.commits().filter(F.col("commit_id") == head).first().parents or [])
            else:
                parents = [head] if head else []
        first = parents[0] if parents else None
        top = self.commits().agg(F.max("seq")).first()[0]
        seq = 0 if top is None else top + 1
        prepared = []
        for path, rows in tables.items():
            prepared.append(self._prepare(path, rows, first, (pks or {}).get(path), (metas or {}).get(path), (schemas or {}).get(path)))
        changed = [p for p in prepared if p["changed"]]
        if not changed and not allow_empty and len(parents) < 2:
            raise NoChanges("no changes to commit")
        sums = sorted((p["path"], p["checksum"]) for p in changed)
        identity = json.dumps([parents, sums, message, author, seq])
        commit_id = hashlib.sha256(identity.encode()).hexdigest()[:40]
        for p in changed:
            self._write(p, commit_id, seq)
        self._record(commit_id, seq, parents, author, message)
        self.move_ref(ref, commit_id)
        return commit_id

    def _prepare(self, path, rows, parent, pk, meta, declared=None):
        old = self.version(path, parent) if parent else None
        if rows is None:
            if old is None:
                raise KeyError(f"no dataset {path}")
            return {"path": path, "old": old, "rows": None, "changed": True, "checksum": "dropped", "parent": parent}
        pk = pk or (old.schema.pk if old else None)
        if not pk:
            raise ValueError(f"dataset {path} needs a primary key")
        schema = declared or VersionedSchema.infer(rows, pk, salt=path)
        if schema.pk != list(pk) or sorted(schema.names) != sorted(rows.columns):
            raise ValueError(f"{path}: the declared schema has other columns or keys than the rows")
        if old:
            schema = old.schema.align(schema)
        bad = violation_examples(rows, schema).limit(5).collect()
        if bad:
            raise InvalidRows("; ".join(f"{b.column}: {b.value!r} breaks {b.rule}" for b in bad))
        if declared:
            rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.struct()])
        # Replay keeps one row per key, so a key that comes twice or not at all would lose rows.
        counted = rows.groupBy(*pk).agg(F.count(F.lit(1)).alias("_n"))
        absent = [F.col(k).isNull() for k in pk]
        wrong = counted.filter(reduce(lambda x, y: x | y, absent, F.col("_n") > 1)).limit(5).collect()
        if wrong:
            raise InvalidRows(f"{path}: keys must be given and unique: " + "; ".join(repr(tuple(w[k] for k in pk)) for w in wrong))
        rekeyed = old is not None and not old.schema.pk_compatible(schema)
        # At most BUCKETS rows; they give the count and checksum of the whole as well.
        sums = cut(bucket_sums(rows.select(*schema.names), pk, BUCKETS).coalesce(1))
        n, digest = self._digest(sums, schema)
        meta = dict(meta if meta is not None else (old.meta if old else {}))
        changed = old is None or old.checksum != digest or old.meta != meta
        return {
            "path": path, "old": old, "rows": rows, "schema": schema, "meta": meta, "pk": pk, "parent": parent,
            "checksum": digest, "row_count": n, "changed": changed, "rekeyed": rekeyed, "sums": sums,
        }

    @staticmethod
    def _digest(sums: DataFrame, schema: VersionedSchema) -> tuple[int, str]:
        """Row count and checksum of a version from its bucket sums and schema."""
        facts = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.bit_xor("x1"), F.bit_xor("x2")).first()
        return facts[0], hashlib.sha256(repr((tuple(facts), schema.to_json())).encode()).hexdigest()[:40]

    def _write(self, p, commit_id: str, seq: int) -> None:
        old = p["old"]
        if p["rows"] is None:
            self._append(
                "versions",
                (commit_id, seq, p["path"], old.slot, old.schema.to_json(), old.meta, 0, "dropped", True),
                VERSIONS,
            )
            return
        slot = old.slot if old and not p["rekeyed"] else hashlib.sha256(f"{p['path']}:{commit_id}".encode()).hexdigest()[:16]
        schema = p["schema"]
        stored = schema.to_storage(p["rows"])
        key_ids = [c.id for c in schema.columns if c.pk_index is not None]
        if old is None or p["rekeyed"]:
            changes = stored.withColumn("_op", F.lit("put"))
        else:
            before = schema.to_storage(schema.read(self._stored(old, p["parent"])))
            changed = diffing.changed_keys(before, stored, key_ids)
            at = F.coalesce("old_key", "new_key")
            keyed = changed.select(at.alias("_k"), F.when(F.col("change_type") == "delete", "del").otherwise("put").alias("_op"))
            key = diffing.key_of(key_ids)
            rows = stored.withColumn("_k", key)
            names = [F.col("_k").alias(key_ids[0])] if len(key_ids) == 1 else [F.col("_k")[k].alias(k) for k in key_ids]
            changes = keyed.join(rows.drop(*key_ids), "_k", "left").select(
                *names, "_op", *[c for c in stored.columns if c not in key_ids]
            )
        self._store_version(p["path"], slot, seq, commit_id, schema, p["meta"], p["row_count"], p["checksum"], changes, p["sums"], lambda: stored)

    def _store_version(self, path, slot, seq, commit_id, schema, meta, row_count, checksum, changes, sums, stored) -> None:
        """Writes the changes (None: none), the sums and, when one is due, the snapshot ``stored`` of a version."""
        key_ids = [c.id for c in schema.columns if c.pk_index is not None]
        base = f"{self.root}/data/{slot}"

        def put(rows: DataFrame, name: str) -> None:
            # Ranges of buckets, as many as the size of the rows asks for: adaptive execution joins small ones.
            laid = rows.withColumn("_bucket", bucket_of(key_ids, BUCKETS)).repartitionByRange("_bucket").sortWithinPartitions("_bucket")
            laid = laid.withColumn("seq", F.lit(seq).cast("bigint")).withColumn("commit_id", F.lit(commit_id))
            laid.write.mode("append").partitionBy("seq", "commit_id").parquet(f"{base}/{name}")

        if changes is not None:
            put(changes, "changes")
        if self.versions().filter(F.col("slot") == slot).count() % SNAPSHOT_EVERY == SNAPSHOT_EVERY - 1:
            put(stored(), "snapshots")
        (
            sums.withColumn("slot", F.lit(slot)).withColumn("seq", F.lit(seq).cast("bigint"))
            .repartition(1).write.mode("append").partitionBy("slot", "seq").parquet(f"{self.root}/buckets")
        )
        self._append("versions", (commit_id, seq, path, slot, schema.to_json(), meta, row_count, checksum, False), VERSIONS)

    def commit_delta(
        self, path: str, delta: DataFrame | None, message: str, *, ref: str = "main", meta: Mapping[str, str] | None = None, author: str = "", parents: list[str] | None = None
    ) -> str:
        """Record a diff of one dataset as its next version, without reading the rows it does not touch.

        ``delta`` is a delta frame whose rows have the columns of the dataset, in any order
        (NULL or empty together with ``meta``: the items alone change). Every change must fit the
        version it is put on: an insert a free key, an update or delete the very row that stands
        there; else nothing is written and ``DoesNotFit`` names some of them. A key may come
        once on each side, so a key given up by one change can be taken by another. New rows are
        checked against the schema. ``parents`` makes it a merge (the first one is built on).

        Only row groups with buckets of touched keys are read. The checksum of the version is that of a
        commit of the whole table: the bucket sums of the rows that go are taken out of the
        old sums and those of the rows that come are put in.
        """
        head = self.resolve(ref)
        parents = [head] if parents is None else parents
        v = self.version(path, parents[0])
        if v is None:
            raise KeyError(f"no dataset {path} at {ref}")
        schema, pk = v.schema, v.schema.pk
        new_meta = dict(v.meta if meta is None else meta)
        old_sums = self._sums(v)
        changes, sums = None, old_sums
        if delta is not None:
            delta = cut(self._typed(delta, schema))
            gone = delta.filter("old IS NOT NULL").select("old.*")
            come = delta.filter("new IS NOT NULL").select("new.*")
            self._check_fit(v, parents[0], delta, gone, come)
            bad = violation_examples(come, schema).limit(5).collect()
            if bad:
                raise InvalidRows("; ".join(f"{b.column}: {b.value!r} breaks {b.rule}" for b in bad))
            minus, plus = bucket_sums(gone, pk, BUCKETS), bucket_sums(come, pk, BUCKETS)
            parts = old_sums.select("bucket", "n", "x1", "x2").union(minus.select("bucket", -F.col("n"), "x1", "x2")).union(plus.select("bucket", "n", "x1", "x2"))
            sums = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
            sums = cut(sums.filter("n > 0").coalesce(1))
            left = gone.select(*pk).join(come.select(*pk), pk, "left_anti")
            puts = schema.to_storage(come.select(*schema.names)).withColumn("_op", F.lit("put"))
            ids = {c.name: c.id for c in schema.columns}
            dels = left.select(*[F.col(k).alias(ids[k]) for k in pk]).withColumn("_op", F.lit("del"))
            changes = puts.unionByName(dels, allowMissingColumns=True)
        row_count, checksum = self._digest(sums, schema)
        if checksum == v.checksum and new_meta == v.meta and len(parents) < 2:
            raise NoChanges("no changes to commit")
        seq = self.commits().agg(F.max("seq")).first()[0] + 1
        identity = json.dumps([parents, [(path, checksum, sorted(new_meta.items()))], message, author, seq])
        commit_id = hashlib.sha256(identity.encode()).hexdigest()[:40]

        def whole() -> DataFrame:
            before = self._stored(v, parents[0])
            if changes is None:
                return before
            key_ids = [c.id for c in schema.columns if c.pk_index is not None]
            kept = before.join(changes.select(*key_ids), key_ids, "left_anti")
            return kept.unionByName(changes.filter("_op = 'put'").drop("_op"), allowMissingColumns=True)

        self._store_version(path, v.slot, seq, commit_id, schema, new_meta, row_count, checksum, changes, sums, whole)
        self._record(commit_id, seq, parents, author, message)
        self.move_ref(ref, commit_id)
        return commit_id

    def rename(self, path: str, to: str, message: str, *, ref: str = "main", dirty: DataFrame | None = None, author: str = "") -> str:
        """Record that a dataset has another path from now on; its rows, their layout and their history stay where they are.

        Refused if there is no such dataset, if ``to`` is taken or breaks the rules of paths, or
        if ``dirty`` (touched keys of a workspace) has rows: they name the old path.
        """
        head = self.resolve(ref)
        v = self.version(path, head)
        if v is None:
            raise KeyError(f"no dataset {path} at {ref}")
        self.check_new_path(to, head, besides=path)
        if dirty is not None and dirty.limit(1).count():
            raise DoesNotFit(f"{path} has edits that are not committed")
        seq = self.commits().agg(F.max("seq")).first()[0] + 1
        commit_id = hashlib.sha256(json.dumps([[head], path, to, message, author, seq]).encode()).hexdigest()[:40]
        self._store_version(to, v.slot, seq, commit_id, v.schema, v.meta, v.row_count, v.checksum, None, self._sums(v), lambda: self._stored(v, head))
        self._append("versions", (commit_id, seq, path, v.slot, v.schema.to_json(), v.meta, 0, "dropped", True), VERSIONS)
        self._record(commit_id, seq, [head], author, message)
        self.move_ref(ref, commit_id)
        return commit_id

    def check_new_path(self, path: str, revision: str | None, besides: str | None = None) -> None:
        """Refuses a path for a new dataset that is no valid one, is taken, or differs from a taken one in case alone."""
        problem = self.spark.range(1).select(path_problem(F.lit(path)).alias("p")).first().p
        if problem:
            raise ValueError(f"{path}: {problem}")
        if revision is None:
            return
        others = self.datasets(revision).filter((F.lower("path") == path.lower()) & (F.col("path") != F.lit(besides or "")))
        clash = others.select("path").first()
        if clash:
            raise ValueError(f"{path}: there is a dataset {clash.path}")

    def _sums(self, v: Version) -> DataFrame:
        """Bucket sums of a version; at most BUCKETS rows."""
        held = self.spark.read.schema("bucket int, n bigint, x1 bigint, x2 bigint, slot string, seq bigint").parquet(f"{self.root}/buckets")
        return held.filter((F.col("slot") == v.slot) & (F.col("seq") == v.seq)).select("bucket", "n", "x1", "x2")

    @staticmethod
    def _typed(delta: DataFrame, schema: VersionedSchema) -> DataFrame:
        """``old`` and ``new`` with the columns of the schema, in its order and types, and the keys taken from them."""

        def half(side: str) -> Column:
            there = delta.schema[side].dataType.fieldNames()
            if sorted(there) != sorted(schema.names):
                raise ValueError(f"columns of the diff {sorted(there)} are not those of the dataset {sorted(schema.names)}")
            fields = schema.struct()
            return F.when(F.col(side).isNotNull(), F.struct(*[F.col(side)[f.name].cast(f.dataType).alias(f.name) for f in fields]))

        return delta.select(half("old").alias("old"), half("new").alias("new"))

    def _check_fit(self, v: Version, commit: str, delta: DataFrame, gone: DataFrame, come: DataFrame) -> None:
        pk = v.schema.pk
        for rows in (gone, come):
            counted = rows.groupBy(*pk).agg(F.count(F.lit(1)).alias("_n"))
            wrong = counted.filter(reduce(lambda x, y: x | y, [F.col(k).isNull() for k in pk], F.col("_n") > 1)).limit(5).collect()
            if wrong:
                raise InvalidRows("keys must be given and unique: " + "; ".join(repr(tuple(w[k] for k in pk)) for w in wrong))
        current = self._rows_at(v, commit, gone.select(*pk).union(come.select(*pk)).distinct())
        a = gone.select(F.struct(*pk).alias("k"), F.struct(*v.schema.names).alias("said"))
        b = current.select(F.struct(*pk).alias("k"), F.struct(*v.schema.names).alias("there"))
        c = come.select(F.struct(*pk).alias("k"), F.lit(True).alias("come"))
        met = a.join(b, "k", "full_outer").join(c, "k", "full_outer")
        stale = F.col("said").isNotNull() & ~F.col("said").eqNullSafe(F.col("there"))
        taken = F.col("said").isNull() & F.col("there").isNotNull() & F.col("come")
        found = met.filter(stale | F.coalesce(taken, F.lit(False))).select("k", F.when(stale & F.col("there").isNull(), "no such row").when(stale, "row has changed").otherwise("key is taken").alias("why"))
        wrong = found.limit(5).collect()
        if wrong:
            raise DoesNotFit("; ".join(f"{tuple(w.k)!r}: {w.why}" for w in wrong))

    def _rows_at(self, v: Version, commit: str, keys: DataFrame) -> DataFrame:
        """Rows of a version at some keys (columns by name); the buckets of the keys, at most BUCKETS, prune the scan."""
        pk = v.schema.pk
        ids = {c.name: c.id for c in v.schema.columns}
        buckets = [r[0] for r in keys.select(bucket_of(pk, BUCKETS)).distinct().collect()]
        return v.schema.read(self._stored(v, commit, keys.select(*[F.col(k).alias(ids[k]) for k in pk]), buckets))

    def estimate(self, path: str, a: str, b: str, accuracy: str = "fast") -> DataFrame:
        """(estimate, differing, exact): the number of changed rows between two versions of one layout.

        Stored sums are read from the top down: sums of 64 groups of buckets, then the buckets of
        groups that differ. Of those buckets, the first ``ACCURACY`` in the order of a fixed hash are
        read from either version, and nothing else; their count is scaled up.
        """
        take = ACCURACY[accuracy]
        a, b = self.resolve(a), self.resolve(b)
        va, vb = self.version(path, a), self.version(path, b)
        if va is None or vb is None or va.slot != vb.slot or va.schema != vb.schema:
            raise ValueError(f"{path} has no common layout at {a} and {b}")
        tops = [self._sums(v).groupBy((F.col("bucket") % 64).alias("bucket")).agg(F.sum("n").alias("n"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2")) for v in (va, vb)]
        groups = [r.bucket for r in differing_buckets(*tops).collect()]
        below = [self._sums(v).filter((F.col("bucket") % 64).isin(groups)) for v in (va, vb)]
        found = differing_buckets(*below).orderBy(F.xxhash64("bucket", F.lit(0)), "bucket").collect() if groups else []
        sample = [r.bucket for r in found[:take]]
        scale, pk = F.lit(len(found) / max(1, len(sample))), va.schema.pk
        old, new = (v.schema.read(self._stored(v, c, None, sample)) for v, c in ((va, a), (vb, b)))
        changed = diffing.changed_keys(old, new, pk).agg(F.count(F.lit(1)).alias("c"))
        return changed.select(F.round(F.col("c") * scale).cast("bigint").alias("estimate"), F.lit(len(found)).cast("bigint").alias("differing"), F.lit(len(found) <= take).alias("exact"))

    # -- reading differences --------------------------------------------------------

    def diff(self, path: str, a: str, b: str) -> DataFrame:
        """Feature deltas between two revisions.

        Between a version and a later one on the same first-parent chain the stored changes tell
        which keys to look at, and only those are read from either version. Otherwise both
        are read through the newer schema, if the key did not change; when the stored bucket
        checksums agree on most buckets, only rows of the others are joined.
        """
        a, b = (self.resolve(r) or "[EMPTY]" for r in (a, b))
        va, vb = self.version(path, a), self.version(path, b)
        if va is None and vb is None:
            raise KeyError(f"no dataset {path} at {a} or {b}")
        if va is None:
            return diffing.diff(None, self.read(path, b), vb.schema.pk)
        if vb is None:
            return diffing.diff(self.read(path, a), None, va.schema.pk)
        ends = sorted([(va.seq, a, va), (vb.seq, b, vb)], key=lambda x: x[0])
        (_, _, low), (_, top, high) = ends
        if va.slot == vb.slot and va.schema.pk_compatible(vb.schema) and self._on_chain(low.commit_id, top):
            key_ids = [c.id for c in vb.schema.columns if c.pk_index is not None]
            # Read by both sides, and small next to them: written once.
            keys = cut(self._changes(high, low.seq, top).select(*key_ids).distinct())
            return diffing.diff(vb.schema.read(self._stored(va, a, keys)), vb.schema.read(self._stored(vb, b, keys)), vb.schema.pk)
        old = vb.schema.read(self._stored(va, self.resolve(a))) if va.schema.pk_compatible(vb.schema) else self.read(path, a)
        new = self.read(path, b)
        pk = vb.schema.pk
        if va.slot == vb.slot and va.schema == vb.schema:
            differing = differing_buckets(self._sums(va), self._sums(vb))
            old, new = (self._in_buckets(d, pk, differing) for d in (old, new))
        return diffing.diff(old, new, pk)

    # -- history --------------------------------------------------------------------

    def log(self, revision: str = "main") -> DataFrame:
        """Commits a revision reaches, with the refs that point at them."""
        tips = self.spark.createDataFrame([(self.resolve(revision),)], "tip string")
        return history.log(self.graph(), tips, self.refs())

    def change_counts(self, path: str, revision: str = "main") -> DataFrame:
        """``seq, commit_id, inserts, updates, deletes`` of every commit that stored rows of a dataset, on any branch.

        Each is held against its first parent, by the lanes kept with the commits. A dataset
        whose key was changed has a layout, and so a history, from that commit on.
        """
        v = self.version(path, revision)
        if v is None:
            raise KeyError(f"no dataset {path} at {revision}")
        rows = self._change_log(v).withColumnRenamed("_op", "op")
        ids = [c.id for c in v.schema.columns if c.pk_index is not None]
        typed = history.typed_changes(rows.select("seq", *ids, "op"), self.commits(), ids)
        counts = history.counts_per_commit(typed.withColumn("dataset", F.lit(path))).drop("dataset")
        return self.commits().select("seq", "commit_id").join(counts, "seq")

    def row_history(self, path: str, keys: DataFrame, revision: str = "main") -> DataFrame:
        """``seq, commit_id, change_type, old, new`` of the rows at ``keys`` (the key columns), in the commits below a revision.

        Row groups without the buckets of the keys, at most BUCKETS of them, are not read.
        """
        v = self.version(path, revision)
        if v is None:
            raise KeyError(f"no dataset {path} at {revision}")
        pk, schema = v.schema.pk, v.schema
        ids = {c.name: c.id for c in schema.columns}
        buckets = [r[0] for r in keys.select(bucket_of(pk, BUCKETS)).distinct().collect()]
        found = self._changes(v, -1, self.resolve(revision))
        if len(buckets) <= PRUNED_BUCKETS:
            found = found.filter(F.col("_bucket").isin(buckets))
        wanted = keys.select(*[F.col(k).alias(ids[k]) for k in pk]).distinct()
        found = found.join(wanted, [ids[k] for k in pk], "left_semi")
        have = set(found.columns)
        fields = [(F.col(ids[f.name]) if ids[f.name] in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.struct()]
        lines = found.select("seq", "commit_id", *[F.col(ids[k]).alias(f"_k_{k}") for k in pk], F.when(F.col("_op") == "put", F.struct(*fields)).alias("new"))
        seen = history.row_history(lines, F.lit(True), [f"_k_{k}" for k in pk], ["new"]).withColumnRenamed("prev_new", "old")
        kind = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update")
        return seen.filter("old IS NOT NULL OR new IS NOT NULL").select("seq", "commit_id", kind.alias("change_type"), "old", "new")

    def _on_chain(self, commit_id: str, tip: str) -> bool:
        return self._chain(tip).filter(F.col("commit_id") == commit_id).limit(1).count() > 0

    @staticmethod
    def _in_buckets(df: DataFrame, pk: list[str], buckets: DataFrame) -> DataFrame:
        # At most BUCKETS rows are broadcast.
        return df.withColumn("bucket", bucket_of(pk, BUCKETS)).join(F.broadcast(buckets), "bucket", "left_semi").drop("bucket")

    def counts(self, path: str, a: str, b: str) -> DataFrame:
        return type_counts(self.diff(path, a, b))

    def range_ends(self, spec: str) -> tuple[str, str]:
        """The two versions a range compares: ``A...B`` ends, ``A..B`` merge base and end, ``A`` and ``A^``."""
        if "..." in spec:
            a, b = spec.split("...")
            return self.resolve(a or "main"), self.resolve(b or "main")
        if ".." in spec:
            a, b = (self.resolve(x or "main") for x in spec.split(".."))
            pairs = self.spark.createDataFrame([(a, b)], "a string, b string")
            base = self.graph().merge_bases(pairs).first().base
            if base is None:
                raise ValueError(f"unrelated histories: {spec}")
            return base, b
        commit = self.resolve(spec)
        row = self.commits().filter(F.col("commit_id") == commit).first()
        return (row.parents[0] if row.parents else "[EMPTY]"), commit
