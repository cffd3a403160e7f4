"""Change types from keyed state: what a commit did to a row follows from what the row was before.

The state of a row holds its operations since the watermark, one per commit, and above them only
what it was at the last older one. A commit that comes late changes the type of its own change and
of the one after it, so results are signed counts: what was reported before is taken back, the new
type is added, and the sums are right whatever the order of arrival.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Groups that rows are dealt to. A call of the worker costs far more than the work on one row, so a
#: call takes the rows of a group together; a group is touched once per batch, whatever it holds.
GROUPS = 1 << 14

#: One element per row of the group: its names, ``floors`` is the last commit folded away and ``alive``
#: what the row was then; the inner arrays have one entry per later commit, ascending: its seq, its
#: last edit's order, its time in ms, put or delete.
STATE = (
    "datasets array<string>, keys array<string>, floors array<bigint>, alive array<boolean>, "
    "seqs array<array<bigint>>, orders array<array<bigint>>, times array<array<bigint>>, puts array<array<boolean>>"
)

Entry = tuple[int, int, bool]  # order, time, put


def change_types(alive: bool, entries: dict[int, Entry]) -> dict[int, str]:
    """Type of the change in every commit, in order of commits; a delete of nothing has none."""
    out = {}
    for seq in sorted(entries):
        put = entries[seq][2]
        if put or alive:
            out[seq] = "delete" if not put else "update" if alive else "insert"
        alive = put
    return out


def fold(floor: int | None, alive: bool, entries: dict[int, Entry], watermark: int) -> tuple[int | None, bool]:
    """Drop from ``entries`` the first commits as long as they are older than the watermark."""
    for seq in sorted(entries):
        if entries[seq][1] >= watermark:
            break
        floor, alive = seq, entries.pop(seq)[2]
    return floor, alive


def _advance(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    columns = [list(c) for c in state.get] if state.exists else [[] for _ in range(8)]
    datasets, keys, floors, alives, *held = columns
    place = {name: i for i, name in enumerate(zip(datasets, keys))}
    touched: dict[int, dict[int, Entry]] = {}
    before = {}
    signed = []
    for batch in batches:
        names = [batch[c].astype(object).where(batch[c].notna(), None) for c in ("dataset", "key")]
        for dataset, key, seq, order, time, put in zip(*names, *(batch[c].tolist() for c in ("seq", "order", "ms", "put"))):
            i = place.setdefault((dataset, key), len(datasets))
            if i == len(datasets):
                for column, value in zip(columns, (dataset, key, None, False, [], [], [], [])):
                    column.append(value)
            if i not in touched:
                touched[i] = {s: (o, t, p) for s, o, t, p in zip(*(column[i] for column in held))}
                before[i] = change_types(alives[i], touched[i])
            entries = touched[i]
            if floors[i] is not None and seq <= floors[i]:
                signed.append((dataset, key, seq, "late", 1))
            elif seq not in entries or order > entries[seq][0]:
                entries[seq] = (order, time, put)
    watermark = state.getCurrentWatermarkMs()
    for i, entries in touched.items():
        after = change_types(alives[i], entries)
        for seq in sorted(entries):
            was, now = before[i].get(seq), after.get(seq)
            if was != now:
                signed += [(datasets[i], keys[i], seq, kind, n) for kind, n in ((was, -1), (now, 1)) if kind]
        floors[i], alives[i] = fold(floors[i], alives[i], entries, watermark)
        seqs = sorted(entries)
        for column, values in zip(held, (seqs, *([entries[s][k] for s in seqs] for k in range(3)))):
            column[i] = values
    state.update(tuple(columns))
    if signed:
        yield pd.DataFrame(signed, columns=["dataset", "key", "seq", "change_type", "n"])


def _key_text(key: Column, kind: str) -> Column:
    """A key as text, one text per key, whatever its type."""
    if kind == "binary":
        return F.base64(key)
    if kind == "timestamp":
        return F.unix_micros(key).cast("string")
    # Adding zero makes -0.0 and 0.0, which are one key, one text.
    return (key + F.lit(0).cast(kind) if kind in ("float", "double") else key).cast("string")


def _text_key(text: Column, kind: str) -> Column:
    if kind == "binary":
        return F.unbase64(text)
    return F.timestamp_micros(text.cast("bigint")) if kind == "timestamp" else text.cast(kind)


def typed_stream(changes: DataFrame, time: str, delay: str, order: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """Stream of changes (``dataset, key, seq, op`` and an event ``time``) to signed change types.

    Result: ``dataset, key, seq, change_type, n`` with ``n`` 1 or, where an earlier report is taken
    back, -1. Of several edits of a row in one commit the one of the greatest ``order`` counts, so a
    commit that comes again changes nothing. ``op`` ``del`` deletes, any other puts the row.

    Commits up to ``delay`` behind the latest may come in any order. Older ones are folded when their
    row is next touched; a change at or before the last folded commit has no place any more and is
    reported as type ``late`` instead of being lost, be it new or a repeat. Changes of ``known`` commits (column ``seq``) enter the state but are not reported.
    Rows without seq, order or time belong to no commit and take no part; a NULL dataset or key is a value.

    A row's state is bounded by its commits within ``delay``. Rows are dealt to GROUPS groups by the
    hash of dataset and key, and the state is kept by group. The rows of one key in a batch are read
    by one task, one Arrow batch after the other. ``known`` is read once, when the stream is made.
    """
    key_type = changes.schema["key"].dataType.simpleString()
    rows = changes.withColumn("_time", F.col(time).cast("timestamp")).select(
        F.col("dataset").cast("string").alias("dataset"), _key_text(F.col("key"), key_type).alias("key"), F.col("seq").cast("bigint").alias("seq"),
        (F.col(order) if order else F.lit(0)).cast("bigint").alias("order"),
        (~F.coalesce(F.col("op") == "del", F.lit(False))).alias("put"), "_time",
    ).withWatermark("_time", delay).withColumn("ms", F.unix_millis("_time")).dropna(subset=["seq", "order", "ms"])
    # Without a timeout late rows reach the function, which reports them.
    out = rows.withColumn("group", F.pmod(F.xxhash64("dataset", "key"), F.lit(GROUPS)).cast("int")).groupBy("group").applyInPandasWithState(
        _advance, "dataset string, key string, seq bigint, change_type string, n int", STATE, "append", GroupStateTimeout.NoTimeout
    )
    # A projection, since rows as they come out of Python cannot be shuffled.
    out = out.withColumn("key", _text_key(F.col("key"), key_type)).withColumn("n", F.col("n").cast("bigint"))
    return out if known is None else out.join(cut(known.select(F.col("seq").cast("bigint").alias("seq")).distinct()), "seq", "left_anti")
