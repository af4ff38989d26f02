"""The two report tables on storage, and the job that fills them.

Rows are written below a folder of their own attempt, ``rows/attempt=<attempt>``. A header is one row in one
file of ``runs``, added and never changed: a run is what its newest header says, and its rows are those
of the attempt that this header names. So readers see whole runs only, whoever else writes: rows of an
attempt that fails, or that another runner's header has overtaken, count for nothing, and a run saved again
with no rows has none. A reset adds headers; ``clean`` later removes what no header needs. Run ids are values,
not folder names, and may hold any character. All rows have one result struct with every field; what a run
did not select is null.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmatlas.operators.registry import NUMBER
from firmatlas.plans.stored_reports import (
    ALL_DATA,
    COMPLETED,
    FAILED,
    QUEUED,
    RUNNING,
    Selection,
    report_rows,
    run_header,
    save_rows,
    with_data_fields,
)

RUNS, ROWS = "runs", "rows"
#: State of a run that a reset has dropped; readers don't see such runs.
DROPPED = "dropped"
RUN_SCHEMA = (
    "createdAt timestamp_ntz, updatedAt timestamp_ntz, status string, naceCode string, naceVersion string, "
    "classification string, postalCode string, fiscalYears array<int>, fields array<string>, "
    "totalCompanies int, completedCompanies int, message string, id string"
)
#: What the store adds to a header: the attempt whose rows count, and the header's place among those of its run.
LOG_SCHEMA = RUN_SCHEMA + ", attempt string, turn long"


def row_schema() -> T.StructType:
    texts = [NUMBER, "name", "postalCode"]
    data = T.StructType([T.StructField(n, t) for n, t in ALL_DATA.items()])
    return T.StructType(
        [
            *[T.StructField(c, T.StringType()) for c in texts],
            T.StructField("fiscalYear", T.IntegerType()),
            T.StructField("status", T.StringType()),
            T.StructField("message", T.StringType()),
            T.StructField("data", data),
            T.StructField("runId", T.StringType()),
        ]
    )


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _headers(spark: SparkSession, folder: str) -> DataFrame:
    """The newest header of every run, dropped ones included."""
    log = _read(spark, f"{folder}/{RUNS}", LOG_SCHEMA)
    newest = F.max_by(F.struct(*log.columns), F.struct("turn", "updatedAt", F.coalesce("attempt", F.lit("")))).alias("run")
    return log.groupBy("id").agg(newest).select("run.*")


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    return _headers(spark, folder).filter(F.col("status") != DROPPED).drop("attempt", "turn")


def read_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the attempts that headers name."""
    schema = T.StructType([*row_schema().fields, T.StructField("attempt", T.StringType())])
    named = _headers(spark, folder).filter((F.col("status") != DROPPED) & F.col("attempt").isNotNull())
    named = named.select(F.col("id").alias("runId"), "attempt")
    return _read(spark, f"{folder}/{ROWS}", schema).join(named, ["runId", "attempt"], "left_semi").drop("attempt")


def new_attempt() -> str:
    # With a letter first, so that no reader takes the folder's value for a number.
    return f"a{uuid.uuid4().hex}"


def write_headers(headers: DataFrame, folder: str, attempt: Column) -> None:
    """Add headers, as one file, after the newest ones of their runs.

    ``attempt`` may refer to the newest header's, ``attempt``, which is null for a new run.
    """
    spark = headers.sparkSession
    before = _headers(spark, folder).select("id", "attempt", F.col("turn").alias("last"))
    found = headers.join(before, "id", "left").withColumn("attempt", attempt)
    found = found.withColumn("turn", F.coalesce(F.col("last") + 1, F.lit(0).cast("long")))
    names = T.StructType.fromDDL(LOG_SCHEMA).fieldNames()
    found.select(*names).coalesce(1).write.mode("append").parquet(f"{folder}/{RUNS}")


def write_rows(rows: DataFrame, folder: str, attempt: str) -> None:
    """Rows of an attempt, which count as soon as a header names it; an attempt that is repeated is written anew."""
    whole = with_data_fields(rows, ALL_DATA)
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in row_schema().fields]
    whole.select(*typed).write.mode("overwrite").parquet(f"{folder}/{ROWS}/attempt={attempt}")


def upsert_rows(spark: SparkSession, rows: DataFrame, folder: str) -> None:
    """Rows of stored runs merged with those that count, as a new attempt of these runs."""
    runs = rows.select("runId").distinct()
    stored = read_rows(spark, folder).join(runs, "runId", "left_semi")
    attempt = new_attempt()
    write_rows(save_rows(stored, rows), folder, attempt)
    headers = read_runs(spark, folder).join(runs.withColumnRenamed("runId", "id"), "id", "left_semi")
    write_headers(headers, folder, F.lit(attempt))


def keep_sources(folder: str, companies: DataFrame, financials: DataFrame, listed: DataFrame) -> list[DataFrame]:
    """The three inputs of ``run_report``, written once for all runs that read them.

    A run counts its companies for each of its headers, so inputs that are not stored are computed some five times
    in every run.
    """
    kept = []
    for name, df in (("companies", companies), ("financials", financials), ("listed", listed)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        kept.append(df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}"))
    return kept


def run_report(
    spark: SparkSession,
    folder: str,
    run_id: str,
    companies: DataFrame,
    financials: DataFrame,
    listed: DataFrame,
    selection: Selection,
    clock: Callable[[], datetime.datetime],
) -> str:
    """Run a report into the store: header queued, running, then completed or failed.

    Returns the last state. A failed run keeps its message, and the rows that it had before. Of two runners of
    one run the one that ends last counts, with all of its rows.
    """
    created, attempt = clock(), new_attempt()

    def header(status: str, rows: DataFrame | None = None, message: str | None = None) -> None:
        found = run_header(companies, run_id, selection, created, clock(), status, rows, message)
        write_headers(found, folder, F.lit(attempt) if status == COMPLETED else F.col("attempt"))

    header(QUEUED)
    header(RUNNING)
    try:
        write_rows(report_rows(run_id, companies, financials, listed, selection), folder, attempt)
        header(COMPLETED, spark.read.schema(row_schema()).parquet(f"{folder}/{ROWS}/attempt={attempt}"))
    except Exception as error:  # noqa: BLE001 - kept in the header, which is the job's report
        header(FAILED, message=str(error).splitlines()[0][:500])
        return FAILED
    return COMPLETED


def reset_selection(spark: SparkSession, folder: str, selection: Selection) -> list[str]:
    """Drop the finished runs of a selection, headers and rows at once; queued and running ones stay."""
    finished = read_runs(spark, folder).filter(selection.matches() & ~F.col("status").isin(QUEUED, RUNNING))
    ids = [r["id"] for r in finished.select("id").collect()]
    if ids:
        dropped = finished.filter(F.col("id").isin(ids)).withColumn("status", F.lit(DROPPED))
        write_headers(dropped, folder, F.lit(None).cast("string"))
    return ids


def clean(spark: SparkSession, folder: str) -> list[str]:
    """Remove the rows of attempts that no header names; returns these attempts.

    For a time at which nothing runs: an attempt that is being written is not named yet either.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{ROWS}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    named = {r["attempt"] for r in _headers(spark, folder).filter(F.col("status") != DROPPED).select("attempt").collect()}
    stored = {s.getPath().getName().removeprefix("attempt="): s.getPath() for s in files.listStatus(path) if s.getPath().getName().startswith("attempt=")}
    unnamed = sorted(set(stored) - named)
    for attempt in unnamed:
        files.delete(stored[attempt], True)
    return unnamed
