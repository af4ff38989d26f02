"""Measures of filings, kept as batches of account lines land.

Lines land in folders ``batch=<name>``, a filing whole. The store has the measures of each batch's filings in a
folder of the same name, written once, and a mark for each batch that is done. An update reads the lines of
new batches only; one that fails is repeated for the batches without a mark. A filing that lands again counts
as its newest batch, by name, has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmatlas.operators.keyed import dealt
from firmatlas.operators.rubrics import ALL_MEASURES, filing_measures

KEY, BATCH = "filing_id", "batch"
LINES, MEASURES, DONE = "lines", "measures", "done"


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _batches(spark: SparkSession, path: str) -> set[str]:
    folder, files = _folder(spark, path)
    if not files.exists(folder):
        return set()
    prefix = f"{BATCH}="
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return {n.removeprefix(prefix) for n in names if n.startswith(prefix)}


def land(lines: DataFrame, folder: str, batch: str) -> None:
    """Account lines (filing_id, code, value, period, pos) as a batch of the landing folder.

    Names are sorted as text: dates, or numbers of one length.
    """
    if not batch or not all(c.isalnum() or c in "-_" for c in batch):
        raise ValueError("a batch is named by letters, digits, - and _")
    lines.write.mode("overwrite").parquet(f"{folder}/{LINES}/{BATCH}={batch}")


def new_batches(spark: SparkSession, folder: str) -> list[str]:
    """Landed batches whose measures are not stored yet."""
    return sorted(_batches(spark, f"{folder}/{LINES}") - _batches(spark, f"{folder}/{DONE}"))


def new_lines(spark: SparkSession, folder: str, batches: list[str]) -> DataFrame:
    """Lines of some batches, each with its batch; other batches' folders are not opened."""
    paths = [f"{folder}/{LINES}/{BATCH}={b}" for b in batches]
    rows = spark.read.option("basePath", f"{folder}/{LINES}").parquet(*paths)
    return rows.withColumn(BATCH, F.col(BATCH).cast("string"))


def update(spark: SparkSession, folder: str) -> list[str]:
    """Add the measures of new batches; returns their names."""
    batches = new_batches(spark, folder)
    for batch in batches:
        # Dealt first: a filing's measures take some KB while they are gathered, in every task that meets it.
        lines = new_lines(spark, folder, [batch]).drop(BATCH)
        found = filing_measures(dealt(lines, KEY), [KEY])
        found.write.mode("overwrite").parquet(f"{folder}/{MEASURES}/{BATCH}={batch}")
        mark, files = _folder(spark, f"{folder}/{DONE}/{BATCH}={batch}")
        files.mkdirs(mark)
    return batches


def measures(spark: SparkSession, folder: str) -> DataFrame:
    """One row of measures for every filing of the batches that are done."""
    done = sorted(_batches(spark, f"{folder}/{DONE}"))
    if not done:
        numbers = [T.StructField(m, T.DoubleType()) for m in ALL_MEASURES]
        return spark.createDataFrame([], T.StructType([T.StructField(KEY, T.LongType()), T.StructField("lineCount", T.LongType()), *numbers]))
    paths = [f"{folder}/{MEASURES}/{BATCH}={b}" for b in done]
    rows = spark.read.option("basePath", f"{folder}/{MEASURES}").parquet(*paths).withColumn(BATCH, F.col(BATCH).cast("string"))
    newest = F.max_by(F.struct("lineCount", *ALL_MEASURES), BATCH).alias("newest")
    # A filing has one row in each of its batches, so little would be saved by grouping before the shuffle.
    return dealt(rows, KEY).groupBy(KEY).agg(newest).select(KEY, "newest.*")
