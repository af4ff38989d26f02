"""Keyed tables without transactions: first-row-wins dedupe and merge by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP = "keep"
REPLACE = "replace"
#: Bytes of stored input for which a task is made.
TASK_BYTES = 4 << 20


def task_count(df: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Number of tasks for a shuffle of df, which grows with the files that df reads.

    It is at least the session's number of shuffle partitions, and that where the size of a source isn't known.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return max(least, -(-sum(s for s in sizes if s < 1 << 50) // task_bytes))


def dealt(df: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """df by its keys in as many tasks as its input asks for, so that a task's share stays as it is when the
    input grows. A number that is given is kept by adaptive execution, which would put partitions together by
    their compressed size, however large they become when they are sorted or exploded."""
    return df.repartition(tasks or task_count(df), *keys)


def dedupe_first(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """One row per key: the lowest by ``order_by``, ties by the remaining columns.

    An aggregate rather than a window, so copies of a hot key collapse before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    if not rest and not order_by:
        return df.distinct()
    first = F.min(F.struct(*order_by, *rest)).alias("first")
    return (
        df.groupBy(*keys)
        .agg(first)
        .select(*[c if c in keys else F.col("first")[c].alias(c) for c in df.columns])
    )


def merge_rows(target: DataFrame, incoming: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """``keep``: stored rows win. ``replace``: incoming rows win. Both sides unique by key."""
    if mode == KEEP:
        return target.unionByName(incoming.join(target.select(*keys), keys, "left_anti"))
    if mode == REPLACE:
        return target.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)
    raise ValueError(f"unknown merge mode {mode!r}")

