"""Stored report runs: header and result rows, retrieval and reset.

Tables are immutable snapshots; every function returns the next content of a table.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, StringType

from firmatlas.functions.identifiers import bare_digits
from firmatlas.operators.keyed import REPLACE, merge_rows
from firmatlas.operators.registry import NUMBER
from firmatlas.operators.rubrics import INSURER_MEASURES
from firmatlas.plans.financials import FETCH_FAILED
from firmatlas.plans.report import FIELDS, NO_ACCOUNT, OK, PARTIAL

ROW_KEY = ["runId", NUMBER, "fiscalYear"]
# Run states and texts.
QUEUED, RUNNING, COMPLETED, FAILED = "queued", "running", "completed", "failed"
NO_ACCOUNT_MESSAGE = "NBB returned no published annual account for the selected fiscal years."
FAILED_MESSAGE = "NBB retrieval failed."
REGISTRY_ATTRIBUTES = {
    "kboStatus": "status",
    "juridicalSituation": "juridicalSituation",
    "startDate": "startDate",
    "juridicalForm": "juridicalForm",
}


@dataclass(frozen=True)
class Selection:
    """What a run was asked for. Years and fields are kept in one normal order."""

    nace_code: str
    nace_version: str
    postal_code: str
    years: Sequence[int]
    fields: Sequence[str]
    classification: str | None = None
    options: dict[str, str] = field(
        default_factory=lambda: {option: measure for option, measure, _ in FIELDS}, repr=False
    )

    @property
    def normal_years(self) -> list[int]:
        return sorted({int(y) for y in self.years}, reverse=True)

    @property
    def normal_fields(self) -> list[str]:
        return sorted(set(self.fields))

    @property
    def measures(self) -> list[str]:
        return [self.options[f] for f in self.options if f in set(self.fields)]

    def matches(self) -> Column:
        """Equal selections; a missing classification equals a blank one."""
        return (
            (F.col("naceCode") == self.nace_code)
            & (F.col("naceVersion") == self.nace_version)
            & (F.coalesce("classification", F.lit("")) == (self.classification or ""))
            & (F.col("postalCode") == self.postal_code)
            & (F.col("fiscalYears") == F.array(*[F.lit(y) for y in self.normal_years]))
            & (F.col("fields") == F.array(*[F.lit(f) for f in self.normal_fields]))
        )


def report_rows(
    run_id: str, companies: DataFrame, financials: DataFrame, listed: DataFrame, selection: Selection
) -> DataFrame:
    """Result rows of a run: one per company and filed year, else one for the newest year.

    The status rule is simpler than the report's: a tagged year is partial, any other is ok.
    """
    keyed = companies.withColumn("digits", bare_digits(F.col(NUMBER)))
    years = (
        financials.filter(F.col("fiscalYear").isin(selection.normal_years))
        .drop("currency", "referenceNumber", "depositDate", "enterpriseName")
        .withColumnRenamed("enterpriseNumber", "digits")
    )
    landed = listed.select(F.col("enterpriseNumber").alias("digits")).distinct().withColumn(
        "landed", F.lit(True)
    )
    rows = keyed.join(years, "digits", "left").join(landed, "digits", "left")
    filed = F.col("fiscalYear").isNotNull()
    nothing = ~filed & F.col("landed").isNotNull()
    values = [F.col(m).alias(m) for m in (*selection.measures, *INSURER_MEASURES)]
    attributes = [F.col(source).alias(name) for name, source in REGISTRY_ATTRIBUTES.items()]
    return rows.select(
        F.lit(run_id).alias("runId"),
        NUMBER,
        "name",
        "postalCode",
        F.coalesce("fiscalYear", F.lit(selection.normal_years[0])).alias("fiscalYear"),
        F.when(nothing, NO_ACCOUNT)
        .when(~filed, FETCH_FAILED)
        .when(F.col("error").isNotNull(), PARTIAL)
        .otherwise(OK)
        .alias("status"),
        F.when(nothing, NO_ACCOUNT_MESSAGE)
        .when(~filed, FAILED_MESSAGE)
        .otherwise(F.col("error"))
        .alias("message"),
        F.struct(*values, *attributes).alias("data"),
    )


#: All fields that a stored row may have: every measure, then the registry attributes.
ALL_DATA: dict[str, DataType] = {
    **{measure: DoubleType() for _, measure, _ in FIELDS},
    **{measure: DoubleType() for measure in INSURER_MEASURES},
    **{name: StringType() for name in REGISTRY_ATTRIBUTES},
}


def data_fields(*tables: DataFrame) -> dict[str, DataType]:
    """Fields of the result structs of all tables, each once, in the order in which they come."""
    found: dict[str, DataType] = {}
    for rows in tables:
        for item in rows.schema["data"].dataType.fields:
            found.setdefault(item.name, item.dataType)
    return found


def with_data_fields(rows: DataFrame, fields: dict[str, DataType]) -> DataFrame:
    """Rows whose result struct has exactly these fields; a field that a run did not select is null."""
    own = data_fields(rows)
    values = [
        (F.col("data")[name] if name in own else F.lit(None)).cast(kind).alias(name)
        for name, kind in fields.items()
    ]
    return rows.withColumn("data", F.struct(*values))


def save_rows(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Stored rows with those of a run; runs may have selected different fields."""
    fields = data_fields(stored, rows)
    return merge_rows(with_data_fields(stored, fields), with_data_fields(rows, fields), ROW_KEY, REPLACE)


def run_header(
    companies: DataFrame,
    run_id: str,
    selection: Selection,
    created: datetime.datetime,
    updated: datetime.datetime,
    status: str,
    rows: DataFrame | None = None,
    message: str | None = None,
) -> DataFrame:
    """Run row with its counters: all zero while queued, companies of the selection after, and
    companies with result rows as they are stored."""
    total = F.lit(0) if status == QUEUED else F.count("*").cast("int")
    done = (
        F.lit(0)
        if rows is None
        else rows.agg(F.count_distinct(NUMBER).cast("int")).scalar()
    )

    def moment(value: datetime.datetime) -> Column:
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")

    return companies.agg(total.alias("totalCompanies")).select(
        F.lit(run_id).alias("id"),
        moment(created).alias("createdAt"),
        moment(updated).alias("updatedAt"),
        F.lit(status).alias("status"),
        F.lit(selection.nace_code).alias("naceCode"),
        F.lit(selection.nace_version).alias("naceVersion"),
        F.lit(selection.classification).cast("string").alias("classification"),
        F.lit(selection.postal_code).alias("postalCode"),
        F.array(*[F.lit(y) for y in selection.normal_years]).alias("fiscalYears"),
        F.array(*[F.lit(f) for f in selection.normal_fields]).alias("fields"),
        "totalCompanies",
        done.alias("completedCompanies"),
        F.lit(message).cast("string").alias("message"),
    )


def save_run(runs: DataFrame, header: DataFrame) -> DataFrame:
    return merge_rows(runs, header, ["id"], REPLACE)


def run_progress(rows: DataFrame) -> DataFrame:
    """Companies and rows per run and status."""
    return rows.groupBy("runId", "status").agg(
        F.count("*").alias("rowCount"), F.count_distinct(NUMBER).alias("companyCount")
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of every selection (ties: the highest id)."""
    keys = ["naceCode", "naceVersion", "classKey", "postalCode", "fiscalYears", "fields"]
    keyed = runs.withColumn("classKey", F.coalesce("classification", F.lit("")))
    newest = F.max_by(F.struct(*runs.columns), F.struct("updatedAt", "id")).alias("run")
    return keyed.groupBy(*keys).agg(newest).select("run.*")


def latest_run(runs: DataFrame, selection: Selection) -> DataFrame:
    return runs.filter(selection.matches()).orderBy(F.desc("updatedAt"), F.desc("id")).limit(1)


def _with_rows(runs: DataFrame, rows: DataFrame) -> DataFrame:
    headers = runs.select(
        F.col("id").alias("runId"), "naceCode", "naceVersion", "classification", "updatedAt"
    )
    return rows.join(headers, "runId")


def selected_rows(runs: DataFrame, rows: DataFrame, selection: Selection) -> DataFrame:
    """Rows of the newest run of a selection (one run row, so it may be broadcast)."""
    run = latest_run(runs, selection)
    headers = F.broadcast(run.select(F.col("id").alias("runId"), "naceCode"))
    return rows.join(headers, "runId").orderBy("name", F.desc("fiscalYear"))


def run_rows(runs: DataFrame, rows: DataFrame, run_id: str) -> DataFrame:
    """Rows of one run, none when the run is unknown."""
    found = _with_rows(runs.filter(F.col("id") == run_id), rows.filter(F.col("runId") == run_id))
    return found.orderBy("name", F.desc("fiscalYear"))


def completed_rows(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of all completed runs with their run's activity code, newest run first."""
    found = _with_rows(runs.filter(F.col("status") == COMPLETED), rows)
    return found.orderBy(F.desc("updatedAt"), "name", F.desc("fiscalYear"))


def reset_runs(
    runs: DataFrame, rows: DataFrame, selection: Selection
) -> tuple[DataFrame, DataFrame]:
    """Runs and rows without the finished runs of a selection; queued and running ones stay."""
    dropped = runs.filter(selection.matches() & ~F.col("status").isin(QUEUED, RUNNING)).select("id")
    kept_runs = runs.join(dropped, "id", "left_anti")
    kept_rows = rows.join(dropped.withColumnRenamed("id", "runId"), "runId", "left_anti")
    return kept_runs, kept_rows
