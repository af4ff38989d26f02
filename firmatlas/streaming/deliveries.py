"""Extracts that arrive over time: each batch of new files is merged into a bucketed table."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from firmatlas.operators.staging import stage_table
from firmatlas.plans.loading import merge_mode
from firmatlas.sources import buckets as store
from firmatlas.sources.csv_files import arriving_files, read_extract
from firmatlas.sources.snapshots import read_snapshot


def merge_files(
    spark: SparkSession,
    paths: list[str],
    batch_id: int,
    table: str,
    root: str,
    load_time: datetime.datetime,
    upsert: bool,
    buckets: int = store.BUCKETS,
) -> list[int]:
    """Merge the rows of extract files; returns the buckets that were rewritten."""
    staged = stage_table(read_extract(spark, paths, table), table, load_time)
    return store.merge_into(spark, staged, root, table, batch_id, merge_mode(table, upsert), buckets)


def start_deliveries(
    spark: SparkSession,
    folder: str,
    table: str,
    root: str,
    checkpoint: str,
    load_time: datetime.datetime,
    upsert: bool = True,
    initial: str | None = None,
    buckets: int = store.BUCKETS,
    keep: int | None = None,
    at_once: int = 1000,
) -> StreamingQuery:
    """Merge all files that have arrived since the last run, then stop.

    State is the file log in ``checkpoint`` and the table's own in ``root``; both must be shared
    folders on a cluster. Files are read as ``read_extract`` reads them: fields may hold line breaks, and a
    ragged row or another header ends the run, before anything of its batch is merged. ``initial`` names a
    snapshot to start from, ``keep`` how many states stay readable (all, by default).
    """
    if initial and not store.batches(spark, root, table):
        store.start_table(spark, read_snapshot(spark, initial, [table])[table], root, table, buckets)

    def merge(batch: DataFrame, batch_id: int) -> None:
        # At most ``at_once`` names.
        paths = sorted(r["path"] for r in batch.distinct().collect())
        if paths:
            merge_files(spark, paths, batch_id, table, root, load_time, upsert, buckets)
        if keep is not None:
            store.expire(spark, root, table, keep)

    return (
        arriving_files(spark, folder, at_once)
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def last_batch(query: StreamingQuery) -> int | None:
    """Id of the newest finished batch, from the progress of a stopped query."""
    progress = query.lastProgress
    return None if progress is None else progress["batchId"]
