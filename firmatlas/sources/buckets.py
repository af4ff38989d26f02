"""Keyed tables in buckets: a delivery rewrites only the buckets that its keys fall into.

A table is a folder with ``data/batch=<n>/bucket=<b>``, the rows of a bucket as batch n left them, and
``state/batch=<n>``, which names for every bucket the batch that has its newest rows. Nothing is
overwritten while it is read: a batch reads the state before it, writes the buckets it touches under its own
number, and then its state. A batch that fails in between, or is repeated, writes the same folders again.
Older states stay readable until ``expire`` drops them and the rows that no state needs any more.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmatlas.operators.keyed import merge_rows
from firmatlas.schemas import TABLES
from firmatlas.session import work_folder
from firmatlas.sources.snapshots import empty_table, table_schema

BUCKETS = 256
#: Number of the rows that a table starts from.
START = -1
STATE_SCHEMA = "bucket int, batch long, buckets int"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _path(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, name: str) -> dict[int, str]:
    """Numbers in the names of the folders ``<name>=<number>`` below a path, with their paths."""
    folder, files = _path(spark, path)
    if not files.exists(folder):
        return {}
    found = {}
    for status in files.listStatus(folder):
        match = re.fullmatch(rf"{name}=(-?\d+)", status.getPath().getName())
        if match:
            found[int(match[1])] = status.getPath().toString()
    return found


def batches(spark: SparkSession, root: str, table: str) -> list[int]:
    """Numbers of the batches whose state is complete, in order."""
    states = _numbers(spark, f"{root}/{table}/state", "batch")
    complete = []
    for number, path in states.items():
        mark, files = _path(spark, f"{path}/_SUCCESS")
        if files.exists(mark):
            complete.append(number)
    return sorted(complete)


def state(spark: SparkSession, root: str, table: str, batch: int) -> tuple[dict[int, int], int]:
    """Batch that has the newest rows of each bucket as of ``batch``, and the number of buckets."""
    rows = spark.read.schema(STATE_SCHEMA).parquet(f"{root}/{table}/state/batch={batch}").collect()
    return {r["bucket"]: r["batch"] for r in rows if r["bucket"] is not None}, rows[0]["buckets"]


def _read(spark: SparkSession, root: str, table: str, places: dict[int, int]) -> DataFrame:
    if not places:
        return empty_table(spark, table)
    paths = [f"{root}/{table}/data/batch={n}/bucket={b}" for b, n in sorted(places.items())]
    return spark.read.schema(table_schema(table)).parquet(*paths)


def read_table(spark: SparkSession, root: str, table: str, batch: int | None = None) -> DataFrame:
    """The table as of a batch, or of the newest complete one."""
    if batch is None:
        known = batches(spark, root, table)
        if not known:
            return empty_table(spark, table)
        batch = known[-1]
    return _read(spark, root, table, state(spark, root, table, batch)[0])


def _write(spark: SparkSession, rows: DataFrame, root: str, table: str, batch: int, before: dict[int, int], touched: list[int], buckets: int) -> None:
    keys, columns = TABLES[table].key, TABLES[table].columns
    rows = rows.select(*columns).withColumn("bucket", bucket_of(keys, buckets))
    data = f"{root}/{table}/data/batch={batch}"
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
    places = {**{b: n for b, n in before.items() if b not in touched}, **{b: batch for b in touched}}
    # A row without bucket keeps the number of buckets of an empty table.
    entries = [(b, n, buckets) for b, n in sorted(places.items())] or [(None, batch, buckets)]
    spark.createDataFrame(entries, STATE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{root}/{table}/state/batch={batch}")


def start_table(spark: SparkSession, rows: DataFrame, root: str, table: str, buckets: int = BUCKETS) -> None:
    """Rows, unique by key, that deliveries to a table start from."""
    touched = _buckets_in(rows, table, buckets)
    _write(spark, rows, root, table, START, {}, touched, buckets)


def _buckets_in(rows: DataFrame, table: str, buckets: int) -> list[int]:
    return [r[0] for r in rows.select(bucket_of(TABLES[table].key, buckets)).distinct().collect()]


def merge_into(spark: SparkSession, incoming: DataFrame, root: str, table: str, batch: int, mode: str, buckets: int = BUCKETS) -> list[int]:
    """Merge rows, unique by key, into the state before ``batch``; returns the buckets that it rewrote."""
    earlier = [n for n in batches(spark, root, table) if n < batch]
    before, known = state(spark, root, table, earlier[-1]) if earlier else ({}, buckets)
    if known != buckets:
        raise ValueError(f"{table} has {known} buckets, not {buckets}")
    # The rows are asked for their buckets first, and then merged.
    folder = work_folder(spark, "delivery")
    incoming.write.parquet(folder)
    incoming = spark.read.schema(incoming.schema).parquet(folder)
    touched = _buckets_in(incoming, table, buckets)
    stored = _read(spark, root, table, {b: before[b] for b in touched if b in before})
    merged = merge_rows(stored.select(*TABLES[table].columns), incoming, TABLES[table].key, mode)
    _write(spark, merged, root, table, batch, before, touched, buckets)
    used, files = _path(spark, folder)
    files.delete(used, True)
    return sorted(touched)


def expire(spark: SparkSession, root: str, table: str, keep: int) -> None:
    """Drop all but the newest ``keep`` states, and the rows that these don't name."""
    known = batches(spark, root, table)
    kept = known[-max(keep, 1) :]
    needed = {(n, b) for batch in kept for b, n in state(spark, root, table, batch)[0].items()}
    doomed = [f"{root}/{table}/state/batch={n}" for n in known if n not in kept]
    for n, path in _numbers(spark, f"{root}/{table}/data", "batch").items():
        # Rows of a batch that has no state yet are still being written.
        if known and n <= known[-1]:
            found = _numbers(spark, path, "bucket")
            gone = [p for b, p in found.items() if (n, b) not in needed]
            doomed += [path] if len(gone) == len(found) else gone
    for path in doomed:
        folder, files = _path(spark, path)
        files.delete(folder, True)
