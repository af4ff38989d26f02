"""Financial histories of companies, from filing references or from published deposits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmatlas.operators.filings import (
    COMPANY,
    DEFAULT_YEARS,
    recent_filings,
    requested_filings,
)
from firmatlas.operators.keyed import dealt
from firmatlas.operators.rubrics import ALL_MEASURES, filing_measures
from firmatlas.operators.text_rubrics import text_rubrics

# Error tags and currency.
NO_JSON = "no_json"
UNSUPPORTED_FORMAT = "unsupported_format"
FETCH_FAILED = "fetch_failed"
CURRENCY = "EUR"
HISTORY_MEASURES = ["revenue", "netResult", "marginPercent", "employeeCount"]
STRUCTURED_TYPE = "XBRL"


def annual_summary(filings: DataFrame, rubrics: DataFrame) -> DataFrame:
    """Every filing with its measures; filings without lines keep nulls."""
    return filings.join(filing_measures(rubrics, ["filing_id"]), "filing_id", "left")


def company_history(
    refs: DataFrame,
    rubrics: DataFrame | None,
    n_years: int = DEFAULT_YEARS,
    years: Sequence[int] | None = None,
    failures: DataFrame | None = None,
    stored: DataFrame | None = None,
) -> DataFrame:
    """One row per company and fiscal year, from references and accounting rubrics.

    ``refs`` carries ``filing_id``, the key of ``rubrics``; ``failures`` (filing_id, error) tells
    which payloads could not be landed. ``stored`` (``measure_store.measures``) has measures that are known
    already, in place of lines. A company's name is the first one met on the way
    through its filings, newest year first: the reference's, then the payload's.
    """
    selected = recent_filings(refs, n_years, years)
    named = rubrics is not None and "payloadName" in rubrics.columns
    if stored is not None:
        found = stored
    else:
        # Only the chosen filings are aggregated, not all that ever landed.
        rubrics = rubrics.join(selected.select("filing_id").distinct(), "filing_id", "left_semi")
        found = filing_measures(rubrics, ["filing_id"])
    if named:
        names = rubrics.groupBy("filing_id").agg(F.max("payloadName").alias("payloadName"))
        found = found.join(names, "filing_id")
    rows = selected.join(found, "filing_id", "left")
    error = F.when(F.col("lineCount").isNull(), NO_JSON)
    if failures is not None:
        rows = rows.join(failures.withColumnRenamed("error", "failure"), "filing_id", "left")
        error = F.coalesce("failure", error)
    usable = F.col("error").isNull()
    payload_name = F.when(usable, F.col("payloadName")) if named else F.lit(None).cast("string")
    offered = F.coalesce(
        F.nullif("enterpriseName", F.lit("")), F.nullif(payload_name, F.lit(""))
    )
    whole = (
        rows.withColumn("error", error)
        .select(
            COMPANY,
            offered.alias("offered"),
            "fiscalYear",
            "referenceNumber",
            *[F.when(usable, F.col(c)).alias(c) for c in HISTORY_MEASURES],
            F.lit(CURRENCY).alias("currency"),
            "depositDate",
            "error",
        )
    )
    return dealt(whole, COMPANY).withColumn("enterpriseName", _newest("offered", ignore_nulls=True)).drop("offered")


def _newest(column: str, ignore_nulls: bool = False) -> Column:
    """Value of the newest year of a company. The rows hold one filing per company and year
    asked for, so a window holds no more than those."""
    years = Window.partitionBy(COMPANY).orderBy(F.desc("fiscalYear"))
    whole = years.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.first_value(column, F.lit(ignore_nulls)).over(whole)


def is_text_filing() -> Column:
    kind = F.coalesce("importFileType", F.lit(""))
    return (kind != "") & (F.upper(kind) != STRUCTURED_TYPE)


def published_financials(
    deposits: DataFrame,
    export_lines: DataFrame | None,
    texts: DataFrame,
    years: Sequence[int],
    companies: DataFrame | None = None,
    stored: DataFrame | None = None,
) -> DataFrame:
    """One row per company and requested year that has a deposit, with all measures.

    ``export_lines`` are all rows of the landed exports (filing_id, pos, code, value, period);
    ``texts`` the filing texts. Structured filings use the export, others the text.
    With ``companies`` only their rows are returned. Filings are chosen first: texts are parsed
    and export lines aggregated only for the chosen filings of the right format. With ``stored``
    (``measure_store.measures`` of the exports) export lines are not read at all.
    """
    if companies is not None:
        deposits = deposits.join(companies.select(COMPANY).distinct(), COMPANY, "left_semi")
    selected = dealt(requested_filings(deposits, years), COMPANY)
    selected = selected.withColumn("isText", is_text_filing()).withColumn(
        "enterpriseName", _newest("enterpriseName")
    )
    wanted = {
        text: selected.filter(F.col("isText") == text).select("filing_id").distinct() for text in (True, False)
    }
    texts = texts.join(wanted[True], "filing_id", "left_semi")
    columns = ["filing_id", "code", "value", "period"]
    order = F.col("pos").cast("decimal(38,0)").alias("pos")
    keys = ["filing_id", "isText"]
    lines = text_rubrics(texts).select(*columns, order, F.lit(True).alias("isText"))
    if stored is not None:
        known = stored.join(wanted[False], "filing_id", "left_semi").withColumn("isText", F.lit(False))
        found = known.unionByName(filing_measures(lines, keys))
    else:
        export_lines = export_lines.join(wanted[False], "filing_id", "left_semi")
        found = filing_measures(export_lines.select(*columns, order, F.lit(False).alias("isText")).unionByName(lines), keys)
    rows = selected.join(found, keys, "left")
    error = F.when(
        F.col("lineCount").isNull(),
        F.when(F.col("isText"), UNSUPPORTED_FORMAT).otherwise(FETCH_FAILED),
    )
    return rows.select(
        COMPANY,
        "enterpriseName",
        "fiscalYear",
        "referenceNumber",
        *ALL_MEASURES,
        F.lit(CURRENCY).alias("currency"),
        "depositDate",
        error.alias("error"),
    )
