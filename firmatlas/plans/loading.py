"""Load jobs: everything, one table, or the tables found incomplete."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmatlas.operators.audit import audit_load
from firmatlas.operators.keyed import KEEP, REPLACE, merge_rows
from firmatlas.operators.staging import stage_table
from firmatlas.schemas import TABLES
from firmatlas.sources.csv_files import read_extract
from firmatlas.sources.snapshots import copy_table, empty_table, read_snapshot, write_table


#: Tables whose jobs are given to Spark at the same time.
AT_ONCE = 4


def each_table(job: Callable[[str], object]) -> dict[str, object]:
    """Run a job for every table, a few at a time; the first failure is raised."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return dict(zip(TABLES, pool.map(job, TABLES)))


def merge_mode(table: str, upsert: bool) -> str:
    return REPLACE if upsert or TABLES[table].always_replace else KEEP


def reset_tables(spark: SparkSession, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Empty the tables a full load starts from; codes, branches and metadata stay."""
    return {
        name: empty_table(spark, name) if TABLES[name].cleared_on_reset else df
        for name, df in tables.items()
    }


def merged_table(
    current: DataFrame, raw: DataFrame, table: str, load_time: datetime.datetime, upsert: bool
) -> DataFrame:
    spec = TABLES[table]
    staged = stage_table(raw, table, load_time)
    return merge_rows(current.select(*spec.columns), staged, spec.key, merge_mode(table, upsert))


def load_table(
    spark: SparkSession,
    table: str,
    csv_path: str,
    target: str,
    load_time: datetime.datetime,
    current: str | None = None,
    upsert: bool = False,
) -> None:
    """Merge one extract into the table of the ``current`` snapshot, written to ``target``."""
    stored = (
        read_snapshot(spark, current, [table])[table] if current else empty_table(spark, table)
    )
    raw = read_extract(spark, csv_path, table)
    write_table(merged_table(stored, raw, table, load_time, upsert), target, table)


def load_all(
    spark: SparkSession,
    csv_folder: str,
    target: str,
    load_time: datetime.datetime,
    current: str | None = None,
    upsert: bool = False,
) -> None:
    """All nine extracts into a new snapshot. Tables that a full load empties start empty."""

    def load(table: str) -> None:
        spec = TABLES[table]
        kept = current if current and not spec.cleared_on_reset else None
        load_table(spark, table, f"{csv_folder}/{spec.file}", target, load_time, kept, upsert)

    each_table(load)


def load_missing(
    spark: SparkSession,
    csv_folder: str,
    current: str,
    target: str,
    load_time: datetime.datetime,
    upsert: bool = False,
) -> list[str]:
    """Merge the extracts of incomplete tables and copy the complete ones, into a whole snapshot.

    Returns the names of the incomplete tables.
    """
    incomplete = [
        row["table"]
        for row in audit_snapshot(spark, csv_folder, current).filter(F.col("incomplete")).collect()
    ]

    def load(table: str) -> None:
        if table in incomplete:
            load_table(spark, table, f"{csv_folder}/{TABLES[table].file}", target, load_time, current, upsert)
        else:
            copy_table(spark, current, target, table)

    each_table(load)
    return incomplete


def audit_snapshot(spark: SparkSession, csv_folder: str, snapshot: str) -> DataFrame:
    sources = each_table(lambda name: read_extract(spark, f"{csv_folder}/{TABLES[name].file}", name))
    return audit_load(sources, read_snapshot(spark, snapshot))
