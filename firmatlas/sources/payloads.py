"""Landed JSON payloads: filing references, accounting data and deposit listings.

Each function takes a table with one payload text per row, however it was landed
(``read_payloads`` reads one file per payload).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmatlas.functions.dates import leading_year
from firmatlas.functions.identifiers import strip_blanks

# Payload fields.
REFERENCE_LISTS = ["References", "references", "Deposits", "deposits"]
REFERENCE_SCHEMA = (
    "array<struct<ReferenceNumber:string,DepositDate:string,"
    "ExerciseDates:struct<startDate:string,endDate:string>,EnterpriseName:string,AccountingDataURL:string>>"
)
ACCOUNTING_SCHEMA = (
    "struct<ReferenceNumber:string,EnterpriseName:string,"
    "Rubrics:array<struct<Code:string,Value:string,Period:string,DataType:string,TypeAmount:string>>>"
)
DEPOSIT_SCHEMA = (
    "struct<content:array<struct<id:string,reference:string,periodEndDateYear:int,"
    "depositDate:string,enterpriseName:string,importFileType:string>>>"
)


def read_payloads(spark: SparkSession, path: str | list[str], key: str) -> DataFrame:
    """One payload per file; the key is the file name without its ending."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return spark.read.text(path, wholetext=True).select(
        F.regexp_replace(name, r"\.[^.]*$", "").alias(key), F.col("value").alias("payload")
    )


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Filing texts, one file per filing."""
    return read_payloads(spark, path, "filing_id").withColumnRenamed("payload", "text")


def _with_reference_list(payloads: DataFrame) -> DataFrame:
    """Add ``listed``: the payload itself if it is a list, or the first of the listed object
    fields that holds one. The payload is parsed once for its fields and once for the list."""
    trimmed = payloads.withColumn("payload", strip_blanks(F.col("payload")))
    fields = trimmed.withColumn("fields", F.from_json("payload", "map<string,string>"))
    texts = F.array(*[F.try_element_at("fields", F.lit(name)) for name in REFERENCE_LISTS])
    found = F.get(F.filter(texts, lambda t: t.startswith("[")), F.lit(0))
    text = F.when(F.col("payload").startswith("["), F.col("payload")).otherwise(found)
    return fields.withColumn("listed", F.from_json(text, REFERENCE_SCHEMA))


def reference_rows(payloads: DataFrame) -> DataFrame:
    """Company payloads -> filing references; those without a number or an end year are dropped.

    ``filing_id`` is the reference number, the key of the accounting rubrics.
    """
    reference = F.col("col")
    rows = _with_reference_list(payloads).select("enterpriseNumber", F.posexplode("listed")).select(
        "enterpriseNumber",
        "pos",
        strip_blanks(reference["ReferenceNumber"]).alias("filing_id"),
        strip_blanks(reference["ReferenceNumber"]).alias("referenceNumber"),
        reference["DepositDate"].alias("depositDate"),
        leading_year(reference["ExerciseDates"]["endDate"]).alias("fiscalYear"),
        reference["EnterpriseName"].alias("enterpriseName"),
        reference["AccountingDataURL"].alias("accountingDataUrl"),
    )
    return rows.filter(
        (F.coalesce("referenceNumber", F.lit("")) != "") & F.col("fiscalYear").isNotNull()
    )


def accounting_rubrics(payloads: DataFrame) -> DataFrame:
    """Accounting payloads -> rubrics in payload order. An absent payload or list gives no rows."""
    data = F.from_json("payload", ACCOUNTING_SCHEMA)
    return (
        payloads.withColumn("data", data)
        .select(
            F.col("referenceNumber").alias("filing_id"),
            F.col("data")["EnterpriseName"].alias("payloadName"),
            F.posexplode(F.col("data")["Rubrics"]),
        )
        .select(
            "filing_id",
            "payloadName",
            "pos",
            F.col("col")["Code"].alias("code"),
            F.col("col")["Value"].alias("value"),
            F.col("col")["Period"].alias("period"),
        )
    )


def deposit_rows(payloads: DataFrame) -> DataFrame:
    """Listing payloads -> deposits in listing order. A company with an empty listing keeps one
    row without a filing, which tells it from a company that was never listed."""
    listing = F.from_json("payload", DEPOSIT_SCHEMA)
    entry = F.col("col")
    return payloads.select(
        "enterpriseNumber", F.posexplode_outer(listing["content"])
    ).select(
        "enterpriseNumber",
        "pos",
        entry["id"].alias("filing_id"),
        entry["reference"].alias("referenceNumber"),
        entry["periodEndDateYear"].alias("fiscalYear"),
        entry["depositDate"].alias("depositDate"),
        entry["enterpriseName"].alias("enterpriseName"),
        entry["importFileType"].alias("importFileType"),
    )


def export_rubrics(rows: DataFrame) -> DataFrame:
    """Key/value rows of rubric exports -> rubrics: keys that start with a digit."""
    return rows.filter(F.col("key").rlike("^[0-9]")).select(
        "filing_id",
        "pos",
        F.col("key").alias("code"),
        "value",
        F.lit("N").alias("period"),
    )


def export_headers(rows: DataFrame, name: str, reference: str) -> DataFrame:
    """Company name and reference of each export; the last of repeated rows counts."""

    def last(key: str) -> Column:
        return F.max_by("value", F.when(F.col("key") == key, F.col("pos")))

    return (
        rows.filter(F.col("value").isNotNull())
        .groupBy("filing_id")
        .agg(last(name).alias("enterpriseName"), last(reference).alias("referenceNumber"))
    )
