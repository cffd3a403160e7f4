"""Imports into a store: a new dataset, or the next version of one, with rows that did not change kept as they are stored."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schema import VersionedSchema
from tidemark.store import VersionStore


def _head(store: VersionStore, ref: str) -> str | None:
    try:
        return store.resolve(ref)
    except KeyError:
        return None


def import_new(
    store: VersionStore, path: str, rows: DataFrame, pk: list[str], message: str, *, schema: VersionedSchema | None = None,
    meta: Mapping[str, str] | None = None, ref: str = "main",
) -> str:
    """Commits ``rows`` as a dataset that was not there before.

    Refused at a path that is taken, or no valid one. ``schema`` declares types narrower than those of the
    DataFrame (text lengths, integer sizes); rows that break it, and keys that are NULL or come
    twice, refuse the import. An empty table makes an empty dataset.
    """
    store.check_new_path(path, _head(store, ref))
    declared = {} if schema is None else {path: schema}
    return store.commit({path: rows}, message, ref=ref, pks={path: pk}, metas={path: meta or {}}, schemas=declared)


def import_over(
    store: VersionStore, path: str, rows: DataFrame, message: str, *, pk: list[str] | None = None, schema: VersionedSchema | None = None,
    meta: Mapping[str, str] | None = None, ref: str = "main",
) -> str:
    """Commits ``rows`` in place of those of a dataset; an import that changes nothing raises ``NoChanges``.

    Meta items that are not given stay. Only changed rows are stored: one that is equal through
    the new schema, with added columns NULL and dropped ones gone, stays as it was written.
    Another ``pk`` keys the dataset anew, and all its rows are stored again.
    """
    old = store.version(path, ref)
    if old is None:
        raise KeyError(f"no dataset {path} at {ref}")
    kept = {**old.meta, **(meta or {})}
    declared = {} if schema is None else {path: schema}
    return store.commit({path: rows}, message, ref=ref, pks={path: pk} if pk else None, metas={path: kept}, schemas=declared)


@dataclass(frozen=True)
class SchemaChange:
    """The latest version whose schema is not that of an import, and how they differ."""

    commit_id: str
    inserts: int
    deletes: int
    key_changed: bool

    @property
    def comparable(self) -> bool:
        """Old rows may equal imported ones once seen through the new schema."""
        return not self.key_changed and self.inserts + self.deletes > 0


def last_schema_change(store: VersionStore, path: str, source: VersionedSchema, revision: str = "main") -> SchemaChange | None:
    """Walks a dataset's versions down the first parents to the last added or dropped column or change of key; None: there is none.

    ``source`` has the column ids of the dataset (:meth:`VersionedSchema.align`). Versions that differ in names,
    positions or types alone are passed over. Only the latest commit of each distinct schema is looked at.
    """
    commit = store.resolve(revision)
    # Versions below a commit that dropped the dataset belong to another one.
    line = store.versions().filter(F.col("path") == path).join(store._chain(commit), "commit_id", "left_semi")
    born = line.agg(F.max(F.when(F.col("dropped"), F.col("seq")))).first()[0]
    alive = line.filter(~F.col("dropped") & (F.col("seq") > (-1 if born is None else born)))
    seen = alive.groupBy("schema_json").agg(F.max(F.struct("seq", "commit_id")).alias("last")).orderBy(F.desc("last.seq"))
    new = source.by_id()
    for row in seen.collect():
        old = VersionedSchema.from_json(row.schema_json)
        ids = old.by_id().keys()
        change = SchemaChange(row.last.commit_id, len(new.keys() - ids), len(ids - new.keys()), not old.pk_compatible(source))
        if change.key_changed or change.comparable:
            return change
    return None


def written(store: VersionStore, path: str, revision: str = "main") -> DataFrame:
    """The commit that wrote each row of a dataset as it is stored now: key columns, ``seq``, ``commit_id``.

    A row that only saw columns added (NULL in it) or dropped since keeps its older commit. Nothing is older
    than the last change of key. Only keys and commits are read.
    """
    v = store.version(path, revision)
    if v is None:
        raise KeyError(f"no dataset {path} at {revision}")
    keys = sorted((c for c in v.schema.columns if c.pk_index is not None), key=lambda c: c.pk_index)
    changes = store._changes(v, -1, store.resolve(revision)).select(*[F.col(c.id).alias(c.name) for c in keys], "seq", "commit_id", "_op")
    names = [c.name for c in keys]
    last = changes.groupBy(*names).agg(F.max(F.struct("seq", "commit_id", "_op")).alias("_w"))
    return last.filter(F.col("_w._op") == "put").select(*names, "_w.seq", "_w.commit_id")
