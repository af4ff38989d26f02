"""Analysis of stored results and of re-imported reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmatlas.functions.amounts import round_half_up
from firmatlas.operators.registry import NUMBER
from firmatlas.operators.rubrics import INSURER_MEASURES
from firmatlas.plans.report import OK

OLDEST, NEWEST = "oldest", "newest"

# Sizes of the result lists.
TOP_ROWS = 10
LISTED_ROWS = 250

# Export headers of stored results, and payload keys the export leaves out.
EXPORT_HEADERS = {
    "Enterprise number": NUMBER,
    "Company": "name",
    "Postal code": "postalCode",
    "KBO status": "data.kboStatus",
    "Legal situation": "data.juridicalSituation",
    "Start date": "data.startDate",
    "Legal form": "data.juridicalForm",
    "Fiscal year": "fiscalYear",
    "NBB status": "status",
}
NOT_EXPORTED = [
    "currency",
    "error",
    "referenceNumber",
    "depositDate",
    "fiscalYear",
    "kboStatus",
    "juridicalSituation",
    "startDate",
    "juridicalForm",
]


def processed(rows: DataFrame, nace_code: str = "", postal_code: str = "") -> DataFrame:
    """Rows with usable figures, optionally of one activity code and one postal code."""
    found = rows.filter(F.col("status") == OK)
    if nace_code:
        found = found.filter(F.col("naceCode") == nace_code)
    if postal_code:
        found = found.filter(F.col("postalCode") == postal_code)
    return found


def facets(rows: DataFrame, nace_code: str = "", postal_code: str = "") -> DataFrame:
    """Choices left for each filter, given the other one."""

    def choices(found: DataFrame, facet: str, column: str) -> DataFrame:
        return (
            found.filter(F.coalesce(column, F.lit("")) != "")
            .select(F.lit(facet).alias("facet"), F.col(column).alias("value"))
            .distinct()
        )

    return (
        choices(processed(rows, postal_code=postal_code), "naceCode", "naceCode")
        .unionByName(choices(processed(rows, nace_code=nace_code), "postalCode", "postalCode"))
        .orderBy("facet", "value")
    )


def measure_columns(rows: DataFrame) -> list[str]:
    fields = rows.schema["data"].dataType.fields
    return [f.name for f in fields if f.name not in NOT_EXPORTED]


def disclosed_measures(rows: DataFrame) -> DataFrame:
    """Per measure the number of values, and whether a result table shows it.

    Insurer measures are shown only when any row has one. One pass over the rows.
    """
    names = measure_columns(rows)
    counts = rows.agg(*[F.count(f"data.{n}").alias(n) for n in names])
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    insurer = F.col("measure").isin(INSURER_MEASURES)
    return counts.selectExpr(f"stack({len(names)}, {pairs}) as (measure, n)").withColumn(
        "shown", ~insurer | (F.col("n") > 0)
    )


def shown_measures(rows: DataFrame) -> list[str]:
    """Names of the measures a result table shows (at most one per measure is collected)."""
    return [r["measure"] for r in disclosed_measures(rows).filter("shown").collect()]


def company_year_pivot(
    rows: DataFrame, measure: str, years: Sequence[int], keep: str = OLDEST
) -> DataFrame:
    """One measure, companies by fiscal year.

    Where several runs hold the same company and year, the oldest run counts (or the newest);
    the name comes from the newest run. Years are a parameter, so no extra pass finds them.
    """
    age = F.struct("updatedAt", "runId")
    pick = F.min_by if keep == OLDEST else F.max_by
    wanted = [int(y) for y in sorted(set(years), reverse=True)]
    return (
        rows.filter(F.col("fiscalYear").isin(wanted))
        .groupBy(NUMBER)
        .agg(
            F.max_by("name", age).alias("name"),
            *[
                pick(F.col(f"data.{measure}"), F.when(F.col("fiscalYear") == y, age)).alias(str(y))
                for y in wanted
            ],
        )
        .select("name", NUMBER, *[F.col(f"`{y}`") for y in wanted])
    )


def pivot_years(rows: DataFrame) -> DataFrame:
    return rows.select("fiscalYear").distinct().orderBy(F.desc("fiscalYear"))


def stored_export(rows: DataFrame) -> DataFrame:
    """Stored results under their export headers, followed by the measures they hold."""
    return rows.select(
        *[F.col(source).alias(header) for header, source in EXPORT_HEADERS.items()],
        *[F.col(f"data.{name}").alias(name) for name in measure_columns(rows)],
    )


def financial_slice(
    rows: DataFrame, status: str = "", min_revenue: float = 0.0, profitable: bool = False
) -> DataFrame:
    """Imported report rows by status, least revenue and profit; unknown revenue never passes."""
    condition = F.coalesce("revenue", F.lit(-1.0)) >= F.lit(float(min_revenue))
    if status:
        condition &= F.col("`Financial data status`") == status
    if profitable:
        condition &= F.coalesce("netResult", F.lit(0.0)) > 0
    return rows.filter(condition)


def _amount(column: str) -> Column:
    """Sum of the known values in cents, so that the order of the rows does not show."""
    return F.coalesce(round_half_up(F.sum(column), 2), F.lit(0.0))


def financial_kpis(rows: DataFrame) -> DataFrame:
    """Row counts, sums of the known figures and the share of complete rows."""
    complete = F.col("`Financial data status`") == OK
    return rows.agg(
        F.count("*").alias("rowCount"),
        F.count_if(complete).alias("completeCount"),
        _amount("revenue").alias("revenue"),
        _amount("netResult").alias("netResult"),
        _amount("fte").alias("fte"),
    ).withColumn(
        "qualityPercent",
        F.coalesce(F.col("completeCount") / F.nullif("rowCount", F.lit(0)) * 100.0, F.lit(0.0)),
    )


def top_revenue(rows: DataFrame, limit: int = TOP_ROWS) -> DataFrame:
    """Largest revenues with a label; ties by company number and year."""
    named = [F.nullif(F.col(f"`{c}`"), F.lit("")) for c in ("KBO name", "NBB name")]
    label = F.coalesce(*named, "`Enterprise number`")
    return (
        rows.filter(F.col("revenue").isNotNull())
        .orderBy(F.desc("revenue"), "`Enterprise number`", "`Returned fiscal year`")
        .limit(limit)
        .select(label.alias("label"), "`Enterprise number`", "revenue")
    )


def listed_rows(rows: DataFrame, limit: int = LISTED_ROWS) -> DataFrame:
    return rows.orderBy("`Enterprise number`", F.desc("`Returned fiscal year`")).limit(limit)
