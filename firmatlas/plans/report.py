"""Company financial report: every company of a selection with its years and a data status."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firmatlas.functions.amounts import margin_percent, plain_number
from firmatlas.functions.identifiers import bare_digits
from firmatlas.operators.registry import NUMBER
from firmatlas.plans.financials import FETCH_FAILED, NO_JSON, UNSUPPORTED_FORMAT, published_financials
from firmatlas.plans.market import companies_by_nace_postal

# Option, measure and report header of every financial field, in report order.
FIELDS = [
    ("revenue", "revenue", "Revenue EUR"),
    ("net-result", "netResult", "Net profit/loss EUR"),
    ("employees", "employeeCount", "Total employees FTE"),
    ("total-assets", "totalAssets", "Total assets EUR"),
    ("equity", "equity", "Equity EUR"),
    ("cash", "cashAndInvestments", "Cash and investments EUR"),
    ("financial-debt", "financialDebt", "Financial debt EUR"),
    ("receivables", "tradeReceivables", "Trade receivables EUR"),
    ("payables", "tradePayables", "Trade payables EUR"),
    ("profit-margin", "marginPercent", "Net profit margin %"),
    ("fixed-assets", "fixedAssets", "Fixed assets EUR"),
    ("current-assets", "currentAssets", "Current assets EUR"),
    ("current-liabilities", "currentLiabilities", "Current liabilities EUR"),
    ("provisions", "provisions", "Provisions and deferred taxes EUR"),
    ("operating-result", "operatingResult", "Operating result EUR"),
    ("depreciation", "depreciation", "Depreciation and impairments EUR"),
    ("retained-earnings", "retainedEarnings", "Retained earnings EUR"),
]

# Statuses and their messages.
OK = "ok"
PARTIAL = "partial_financial_data"
NO_ACCOUNT = "no_account_for_year"
NO_DATA = "no_accounting_data"
PDF_ONLY = "accounting_pdf_only"
PDF_MESSAGE = "NBB returned the annual account as PDF, not machine-readable accounting data."
EXPORT_MESSAGE = "NBB could not retrieve the published XBRL CSV export."
RETRY_MESSAGE = "NBB request did not complete; rerun the report to retry."

# Headers before and after the financial fields.
LEAD_HEADERS = [
    "Enterprise number",
    "KBO name",
    "NBB name",
    "Postal code",
    "NACE code",
    "NACE version",
    "Classification",
    "Requested fiscal year",
    "History years requested",
    "Returned fiscal year",
]
TAIL_HEADERS = ["Financial data status", "NBB message", "NBB reference", "NBB deposit date"]


def selected_fields(options: Sequence[str] | None = None) -> list[tuple[str, str, str]]:
    """Fields by option name, in catalogue order whatever the order asked for."""
    if options is None:
        return FIELDS
    wanted = {option.strip() for option in options}
    fields = [field for field in FIELDS if field[0] in wanted]
    if not fields:
        raise ValueError("fields must include at least one of: " + ", ".join(f[0] for f in FIELDS))
    return fields


def account_status() -> Column:
    """Status of one company-year from its error tag and its two lead measures."""
    complete = F.col("revenue").isNotNull() & F.col("employeeCount").isNotNull()
    return (
        F.when(F.col("error") == NO_JSON, NO_DATA)
        .when(F.col("error") == UNSUPPORTED_FORMAT, PDF_ONLY)
        .when(F.col("error") == FETCH_FAILED, FETCH_FAILED)
        .when(complete, OK)
        .otherwise(PARTIAL)
    )


def company_results(
    financials: DataFrame, listed: DataFrame, retry_whole: bool = True, companies: DataFrame | None = None
) -> DataFrame:
    """Status rows per company: its years, or one row if it has none among those requested.

    With ``companies`` (those of the report) only their listings are looked at.
    ``listed`` holds the companies whose deposit listing has landed. With ``retry_whole`` a
    company with any failed year gives no rows at all, so that the report asks for it again.
    """
    measures = [measure for _, measure, _ in FIELDS if measure != "marginPercent"]
    years = financials.withColumn("status", account_status())
    failed = F.col("status") == FETCH_FAILED
    known = F.col("status").isin(OK, PARTIAL)
    rows = years.select(
        "enterpriseNumber",
        F.when(~failed, F.col("enterpriseName")).alias("nbbName"),
        F.when(~failed, F.col("fiscalYear")).alias("returnedFiscalYear"),
        *[F.when(known, F.col(m)).alias(m) for m in measures],
        "status",
        F.when(F.col("status") == PDF_ONLY, PDF_MESSAGE)
        .when(failed, EXPORT_MESSAGE)
        .alias("message"),
        F.when(~failed, F.col("referenceNumber")).alias("referenceNumber"),
        F.when(~failed, F.col("depositDate")).alias("depositDate"),
        F.col("fiscalYear").alias("orderYear"),
    )
    if retry_whole:
        # A company's rows are its requested years, so the window stays small.
        company = Window.partitionBy("enterpriseNumber")
        rows = (
            rows.withColumn("anyFailed", F.max(failed).over(company))
            .withColumn("retry", F.col("anyFailed"))
            .drop("anyFailed")
        )
    else:
        rows = rows.withColumn("retry", F.lit(False))
    if companies is not None:
        digits = companies.select(bare_digits(F.col(NUMBER)).alias("enterpriseNumber"))
        listed = listed.join(digits, "enterpriseNumber", "left_semi")
    # One join marks the landed companies without any year, so the financials are read once.
    landed = listed.select("enterpriseNumber").distinct()
    rows = rows.join(landed, "enterpriseNumber", "full").withColumn("status", F.coalesce("status", F.lit(NO_ACCOUNT)))
    return rows.filter(~F.coalesce("retry", F.lit(False))).drop("retry")


def financial_report(companies: DataFrame, results: DataFrame) -> DataFrame:
    """All companies with their result rows; a company without any keeps one failed row."""
    keyed = companies.withColumn("digits", bare_digits(F.col(NUMBER)))
    found = results.withColumnRenamed("enterpriseNumber", "digits")
    missing = F.col("status").isNull()
    report = keyed.select("digits", NUMBER, "name", "postalCode").join(found, "digits", "left")
    return (
        report.withColumn("message", F.when(missing, RETRY_MESSAGE).otherwise(F.col("message")))
        .withColumn("status", F.coalesce("status", F.lit(FETCH_FAILED)))
        .withColumn("marginPercent", margin_percent(F.col("revenue"), F.col("netResult")))
        .drop("digits")
    )


def nace_report(
    tables: Mapping[str, DataFrame],
    deposits: DataFrame,
    export_lines: DataFrame,
    texts: DataFrame,
    code: str,
    postal_code: str,
    years: Sequence[int],
    work: str,
    version: str | None = None,
    classification: str | None = None,
    retry_whole: bool = True,
) -> DataFrame:
    """The whole report of one activity prefix and postal code.

    Its companies are written to ``work`` first: what follows reduces every table by them several times, and
    Spark knows the size of a stored list.
    """
    spark = deposits.sparkSession
    companies_by_nace_postal(tables, code, postal_code, version, classification).write.mode("overwrite").parquet(work)
    companies = spark.read.parquet(work)
    digits = companies.select(bare_digits(F.col(NUMBER)).alias("enterpriseNumber"))
    financials = published_financials(deposits, export_lines, texts, years, digits)
    results = company_results(financials, deposits.select("enterpriseNumber"), retry_whole, companies)
    return financial_report(companies, results)


def report_columns(
    report: DataFrame,
    code: str,
    version: str | None,
    classification: str | None,
    fiscal_year: int,
    history_years: int,
    options: Sequence[str] | None = None,
) -> DataFrame:
    """The report under its export headers, companies by number and years newest first."""
    lead = [
        F.col(NUMBER),
        F.col("name"),
        F.col("nbbName"),
        F.col("postalCode"),
        F.lit(code),
        F.lit(version).cast("string"),
        F.lit(classification).cast("string"),
        F.lit(fiscal_year),
        F.lit(history_years),
        F.col("returnedFiscalYear"),
    ]
    tail = [F.col(c) for c in ("status", "message", "referenceNumber", "depositDate")]
    ordered = report.orderBy(NUMBER, F.desc_nulls_last("orderYear"))
    return ordered.select(
        *[column.alias(header) for column, header in zip(lead, LEAD_HEADERS)],
        *[F.col(measure).alias(header) for _, measure, header in selected_fields(options)],
        *[column.alias(header) for column, header in zip(tail, TAIL_HEADERS)],
    )


def as_text(df: DataFrame) -> DataFrame:
    """Doubles as plain decimal text, for CSV."""
    return df.select(
        *[
            plain_number(F.col(f"`{name}`")).alias(name) if kind == "double" else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )


def remaining(companies: DataFrame, stored: DataFrame) -> DataFrame:
    """Companies without a stored result: what is left to do when a report is resumed."""
    return companies.join(stored.select(NUMBER).distinct(), NUMBER, "left_anti")
