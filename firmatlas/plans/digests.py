"""An audit that shuffles keys only where an extract has changed since its load.

A load keeps, beside its snapshot, a digest of every extract: per bucket of keys the number of rows, the sums of
both halves of the keys' hashes, which don't depend on order, and the number of distinct keys. An audit sums
the extract anew, which needs no shuffle beyond one row for each bucket and task, and counts distinct keys only
in buckets whose sums differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmatlas.operators.staging import source_filter
from firmatlas.plans.loading import each_table
from firmatlas.schemas import TABLES
from firmatlas.sources.csv_files import read_extract
from firmatlas.sources.snapshots import read_snapshot

BUCKETS = 64
SUMS = ("rows", "low", "high")
DIGEST_SCHEMA = "bucket int, rows long, low long, high long, keys long"


def _hashed(rows: DataFrame, table: str) -> DataFrame:
    hashed = F.xxhash64(*(F.coalesce(c, F.lit("\0")) for c in TABLES[table].source_key))
    return rows.withColumn("hash", hashed).withColumn("bucket", F.pmod("hash", F.lit(BUCKETS)).cast("int"))


def _keys(raw: DataFrame, table: str) -> DataFrame:
    return _hashed(raw.filter(source_filter(table)).select(*TABLES[table].source_key), table)


def source_sums(raw: DataFrame, table: str) -> DataFrame:
    """bucket, rows, low and high of the eligible rows of an extract."""
    low, high = F.col("hash").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("hash", 32)
    return _keys(raw, table).groupBy("bucket").agg(F.count("*").alias("rows"), F.sum(low).alias("low"), F.sum(high).alias("high"))


def distinct_keys(raw: DataFrame, table: str, buckets: list[int] | None = None) -> DataFrame:
    """bucket and number of distinct keys, in all buckets or in some."""
    rows = _keys(raw, table)
    if buckets is not None:
        rows = rows.filter(F.col("bucket").isin(buckets))
    return rows.select("bucket", *TABLES[table].source_key).distinct().groupBy("bucket").agg(F.count("*").alias("keys"))


def whole_digest(raw: DataFrame, table: str) -> DataFrame:
    """``source_sums`` and ``distinct_keys`` of all buckets, by one reading of the extract."""
    rows = raw.filter(source_filter(table)).groupBy(*TABLES[table].source_key).agg(F.count("*").alias("n"))
    low, high = F.col("hash").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("hash", 32)
    sums = [F.sum("n").alias("rows"), F.sum(low * F.col("n")).alias("low"), F.sum(high * F.col("n")).alias("high")]
    return _hashed(rows, table).groupBy("bucket").agg(*sums, F.count("*").alias("keys"))


def _path(snapshot: str, table: str) -> str:
    return f"{snapshot}/digests/{table}"


def keep_digests(spark: SparkSession, csv_folder: str, snapshot: str) -> None:
    """Digest all extracts as they were loaded into a snapshot."""

    def keep(table: str) -> None:
        raw = read_extract(spark, f"{csv_folder}/{TABLES[table].file}", table)
        whole_digest(raw, table).coalesce(1).write.mode("overwrite").parquet(_path(snapshot, table))

    each_table(keep)


def audit_digests(spark: SparkSession, csv_folder: str, snapshot: str) -> DataFrame:
    """Per table: expected and loaded rows, verdict, and the number of buckets whose keys were counted."""
    stored = read_snapshot(spark, snapshot)

    def audit(table: str) -> tuple:
        raw = read_extract(spark, f"{csv_folder}/{TABLES[table].file}", table)
        # BUCKETS rows each.
        kept = {r["bucket"]: r for r in spark.read.schema(DIGEST_SCHEMA).parquet(_path(snapshot, table)).collect()}
        now = {r["bucket"]: r for r in source_sums(raw, table).collect()}
        same = {b for b in now if b in kept and all(now[b][s] == kept[b][s] for s in SUMS)}
        expected = sum(kept[b]["keys"] for b in same)
        changed = sorted(set(now) - same)
        if changed:
            expected += distinct_keys(raw, table, changed).agg(F.coalesce(F.sum("keys"), F.lit(0))).first()[0]
        loaded = stored[table].count()
        return table, expected, loaded, "MATCH" if loaded == expected else "MISMATCH", loaded < expected, len(changed)

    rows = list(each_table(audit).values())
    return spark.createDataFrame(rows, "table string, expected long, loaded long, status string, incomplete boolean, counted int")
