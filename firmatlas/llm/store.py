"""Cutting lineage with tables in the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from firmatlas.session import work_folder

#: Rows that a task hands to Python at a time. The default of 10,000 long texts would not fit in memory.
BATCH_ROWS = 512


def _bounded_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: Tables of the open scratches of this thread, innermost last.
_scratches: ContextVar[tuple[list[str], ...]] = ContextVar("scratches", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes on leaving the tables written within, but for those written with ``keep``.

    What is returned from it must rest on kept tables and on the inputs alone.
    """
    own: list[str] = []
    before = _scratches.set((*_scratches.get(), own))
    try:
        yield
    finally:
        _scratches.reset(before)
        for name in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    Unlike a cached block the table outlives the executors that made it. Its folder is
    named afresh for each call and stays until the checkpoint folder is cleaned, or until
    the scratch ends in which it is written.
    """
    spark = df.sparkSession
    _bounded_batches(spark)
    path = work_folder(spark, label)
    open_ = _scratches.get()
    level = len(open_) - 1 - keep
    if level >= 0:
        open_[level].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
