"""Ranks and pages of sorted rows, without sorting or holding them in one task.

Rows are dealt to ranges of their order, sorted within each, and stored one folder per range. The ranges' row
counts, a few thousand numbers, added up give the rank at which each range begins: so a page at any depth
opens the folders that it lies in and no other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART, PLACE, RANK = "rangePart", "rangePlace", "rank"


def store_ranges(df: DataFrame, order: Sequence[Column], folder: str) -> None:
    """Store df in ranges of ``order``. Rows that are equal by it take ranks next to each other."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = placed.withColumn(PART, F.spark_partition_id()).withColumn(PLACE, place)
    spark = df.sparkSession
    # Without rows no file of ranges would tell the columns.
    spark.createDataFrame([], placed.schema).write.mode("overwrite").parquet(f"{folder}/columns")
    placed.write.mode("overwrite").partitionBy(PART).parquet(f"{folder}/rows")
    rows = spark.read.schema(placed.schema).parquet(f"{folder}/rows")
    rows.groupBy(PART).agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/counts")


def _starts(spark: SparkSession, folder: str) -> tuple[list[tuple[int, int, int]], int]:
    """Number, first rank and row count of every range, and the total."""
    counts = spark.read.schema(f"{PART} int, n long").parquet(f"{folder}/counts").orderBy(PART).collect()
    out, total = [], 0
    for r in counts:
        out.append((r[PART], total, r["n"]))
        total += r["n"]
    return out, total


def total(spark: SparkSession, folder: str) -> int:
    return _starts(spark, folder)[1]


def _ranked(spark: SparkSession, folder: str, starts: list[tuple[int, int, int]]) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/columns").schema
    begin = F.map_from_arrays(F.lit([s[0] for s in starts]).cast("array<int>"), F.lit([s[1] for s in starts]).cast("array<long>"))
    rows = spark.read.schema(schema).parquet(f"{folder}/rows")
    return rows.withColumn(RANK, F.col(PLACE) + F.try_element_at(begin, F.col(PART))).drop(PLACE)


def page(spark: SparkSession, folder: str, offset: int, limit: int) -> DataFrame:
    """Rows of ranks from ``offset`` on, with their rank from 0; only the ranges that hold them are read."""
    starts, _ = _starts(spark, folder)
    own = [s for s in starts if s[1] < offset + limit and s[1] + s[2] > offset]
    rows = _ranked(spark, folder, own).filter(F.col(PART).isin([s[0] for s in own]))
    return rows.filter(F.col(RANK).between(offset, offset + limit - 1)).drop(PART)


def with_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """All rows with their rank from 0."""
    return _ranked(spark, folder, _starts(spark, folder)[0]).drop(PART)
