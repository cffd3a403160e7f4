"""Streams: edit capture, growing indexes and annotations, and diff lines as they come.

Every ``foreachBatch`` writes to a folder named by its batch id and overwrites it, so a
batch that runs twice leaves one copy. Readers combine the folders.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.aggregates import type_count_columns
from tidemark.operators.spatial import index_entries
from tidemark.sinks.render import change_json
from tidemark.streaming.typed import typed_stream


def _run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    job = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    query = job.trigger(availableNow=True).start() if available_now else job.start()
    if available_now:
        query.awaitTermination()
    return query


def _has(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def capture_edits(edits: DataFrame, pk: str, order: str, target: str, checkpoint: str, available_now: bool = True):
    """Stream of an edit log (``pk``, ``order``, ``op``, values) to the latest edit per key and batch."""
    values = [c for c in edits.columns if c not in (pk,)]

    def write(batch: DataFrame, batch_id: int) -> None:
        latest = batch.groupBy(pk).agg(F.max_by(F.struct(*values), F.col(order)).alias("_e")).select(pk, "_e.*")
        latest.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return _run(edits, write, checkpoint, available_now)


def captured(spark: SparkSession, target: str, pk: str, order: str) -> DataFrame:
    """The latest captured edit of each key; its keys are the touched keys."""
    rows = spark.read.parquet(target).drop("batch")
    values = [c for c in rows.columns if c != pk]
    return rows.groupBy(pk).agg(F.max_by(F.struct(*values), F.col(order)).alias("_e")).select(pk, "_e.*")


def grow_index(objects: DataFrame, target: str, checkpoint: str, known: Sequence[str] = ("EPSG:4326",), available_now: bool = True):
    """Stream of ``oid, crs, geom`` to box index entries, each object once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch
        if _has(spark, target):
            entries = spark.read.parquet(target)
            fresh = batch.join(entries.filter(F.col("batch") != batch_id).select("oid"), "oid", "left_anti")
        index_entries(fresh, known=known).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return _run(objects, write, checkpoint, available_now)


def grow_annotations(typed: DataFrame, target: str, checkpoint: str, available_now: bool = True):
    """Stream of typed changes to change counts per commit and dataset; partial counts add up."""

    def write(batch: DataFrame, batch_id: int) -> None:
        type_count_columns(batch, ["seq", "dataset"]).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return _run(typed, write, checkpoint, available_now)


def annotate_changes(
    changes: DataFrame, time: str, target: str, checkpoint: str, delay: str, order: str | None = None,
    known: DataFrame | None = None, available_now: bool = True,
):
    """Stream of changes to change counts per commit and dataset, their types told by the state of each row.

    See :func:`tidemark.streaming.typed.typed_stream`; late changes are counted beside the others.
    """
    counts = [F.sum(F.when(F.col("change_type") == kind, F.col("n")).otherwise(0)).alias(f"{kind}s") for kind in ("insert", "update", "delete", "late")]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("seq", "dataset").agg(*counts).withColumnRenamed("lates", "late").write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return _run(typed_stream(changes, time, delay, order, known), write, checkpoint, available_now)


def annotations(spark: SparkSession, target: str) -> DataFrame:
    """Summed counts per commit and dataset; commits that changed nothing have no row."""
    rows = spark.read.parquet(target)
    sums = [F.sum(c).alias(c) for c in ("inserts", "updates", "deletes", "late") if c in rows.columns]
    totals = rows.groupBy("seq", "dataset").agg(*sums)
    return totals.filter(F.greatest(*[c for c in totals.columns if c not in ("seq", "dataset")]) > 0)


def stream_lines(deltas: DataFrame, dataset: Column, target: str, checkpoint: str, available_now: bool = True):
    """Stream of deltas to JSON lines; the first lines are out before the last delta is known."""
    line = F.concat(F.lit('{"type":"feature","dataset":"'), dataset, F.lit('","change":'), change_json(deltas), F.lit("}"))
    job = (
        deltas.select(line.alias("value")).writeStream.format("text").option("path", target)
        .option("checkpointLocation", checkpoint).outputMode("append")
    )
    query = job.trigger(availableNow=True).start() if available_now else job.start()
    if available_now:
        query.awaitTermination()
    return query
