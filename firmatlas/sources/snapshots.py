"""Registry snapshots: one Parquet folder per table below a snapshot folder.

A load reads the current snapshot and writes a new one; nothing is overwritten while it is
read, and a load that is repeated after a failure writes the same snapshot again.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmatlas.schemas import TABLES

TIMESTAMP_COLUMNS = {"startDate", "dateStrikingOff"}
ACTIVITY_ORDER = ["naceVersion", "naceCode", "entityNumber"]


def table_schema(name: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField(c, T.TimestampNTZType() if c in TIMESTAMP_COLUMNS else T.StringType())
            for c in TABLES[name].columns
        ]
    )


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """No rows, known as such when a plan is made, so that a merge into it costs no join."""
    nothing = spark.range(1).filter(F.lit(False))
    return nothing.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in table_schema(name)])


def read_snapshot(spark: SparkSession, folder: str, names: Iterable[str] = TABLES) -> dict[str, DataFrame]:
    return {
        name: spark.read.schema(table_schema(name)).parquet(f"{folder}/{name}") for name in names
    }


def _layout(df: DataFrame, name: str) -> DataFrame:
    """File layout: activities are split by version and sorted by code, so that a code prefix
    touches few row groups. Range partitions over version, code and number also split a
    version or a single code that holds much of the data."""
    if name == "Activity":
        return df.repartitionByRange(*ACTIVITY_ORDER).sortWithinPartitions(*ACTIVITY_ORDER)
    return df


def write_table(df: DataFrame, folder: str, name: str) -> None:
    _write(_layout(df.select(*TABLES[name].columns), name), folder, name)


def copy_table(spark: SparkSession, source: str, folder: str, name: str) -> None:
    """A table of the snapshot ``source`` as it is. Its rows lie in ranges already, so they are sorted by the
    tasks that read them and not shuffled."""
    df = read_snapshot(spark, source, [name])[name]
    _write(df.sortWithinPartitions(*ACTIVITY_ORDER) if name == "Activity" else df, folder, name)


def _write(df: DataFrame, folder: str, name: str) -> None:
    writer = df.write.mode("overwrite")
    if name == "Activity":
        writer = writer.partitionBy("naceVersion")
    writer.parquet(f"{folder}/{name}")


def write_catalog(catalog: DataFrame, folder: str) -> None:
    """Activity codes, one folder per version, so that a search reads one version."""
    catalog.write.mode("overwrite").partitionBy("version").parquet(folder)


def write_bucketed(df: DataFrame, table_name: str, buckets: int, column: str) -> None:
    """As a catalog table bucketed and sorted by a column, so that joins and groups by it need no shuffle."""
    (
        df.repartition(buckets, F.col(column))
        .write.mode("overwrite")
        .bucketBy(buckets, column)
        .sortBy(column)
        .format("parquet")
        .saveAsTable(table_name)
    )


#: Tables whose rows belong to one company, and the column that holds its number.
COMPANY_TABLES = {"Enterprise": "enterpriseNumber", "Denomination": "enterpriseId", "KBOAddress": "enterpriseId", "KBOContact": "enterpriseId"}


def write_company_tables(tables: Mapping[str, DataFrame], prefix: str, buckets: int) -> None:
    """Store the tables of company profiles as catalog tables in equal buckets of companies.

    Rows without a company (names, addresses and contacts of establishments and branches) are left out:
    no profile shows them, and they would all fall in one bucket.
    """
    for name, column in COMPANY_TABLES.items():
        write_bucketed(tables[name].filter(F.col(column).isNotNull()), f"{prefix}_{name.lower()}", buckets, column)


def company_tables(spark: SparkSession, prefix: str, others: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables stored by ``write_company_tables``, and all others as they are."""
    stored = {name: spark.table(f"{prefix}_{name.lower()}") for name in COMPANY_TABLES}
    return {name: stored[name] if name in stored else others[name] for name in others}
