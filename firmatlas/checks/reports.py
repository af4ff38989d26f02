"""Registered report and result-analysis queries."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmatlas.functions.identifiers import dotted_number
from firmatlas.operators.keyed import dedupe_first
from firmatlas.operators.registry import NUMBER, decode_companies, preferred_names, registered_offices
from firmatlas.operators.rubrics import INSURER_MEASURES
from firmatlas.plans import analysis, market, report, report_store, stored_reports
from firmatlas.plans.financials import published_financials
from firmatlas.plans.stored_reports import ROW_KEY, Selection
from firmatlas.sinks.csv_reports import POSTAL_HEADERS, write_postal_counts, write_report
from firmatlas.session import work_folder
from firmatlas.sources.csv_files import read_report, with_report_numbers
from firmatlas.sources.testviews import TestViews, company, with_views

from .filings import PUBLISHED_SQL, YEARS
from .market import COUNTS_SQL, DECODED_SQL, LIST_NAMES_SQL, MARKET_VIEWS, PREFIX, VERSION, hits_sql

RUN_POSTAL = "1001"
OPTIONS = ["employees", "revenue", "profit-margin", "equity"]
SELECTION = Selection("60", "2008", "1001", [1998, 1999], ["revenue", "net-result"])


def _companies(views: TestViews) -> DataFrame:
    """Every company with decoded attributes, name and registered-office postal code."""
    office = registered_offices(views.address).select(
        F.col("enterpriseId").alias(NUMBER), F.col("zipcode").alias("postalCode")
    )
    return (
        decode_companies(views.enterprise, views.code)
        .join(preferred_names(views.denomination), NUMBER, "left")
        .join(office, NUMBER, "left")
        .withColumn("name", F.coalesce("name", F.lit("")))
    )


def _published(views: TestViews, companies: DataFrame | None = None) -> DataFrame:
    return published_financials(views.filing_ref, views.rubric, views.filing_text, YEARS, companies)


def _listed(views: TestViews) -> DataFrame:
    return views.filing_ref.select("enterpriseNumber")


def _report(views: TestViews, retry_whole: bool) -> DataFrame:
    results = report.company_results(_published(views), _listed(views), retry_whole)
    return report.financial_report(_companies(views), results)


def financial_report(spark: SparkSession, folder: str) -> DataFrame:
    return _report(TestViews(spark, folder), retry_whole=False).drop("orderYear")


def financial_report_retry(spark: SparkSession, folder: str) -> DataFrame:
    rows = _report(TestViews(spark, folder), retry_whole=True)
    return report.report_columns(rows, PREFIX, VERSION, None, YEARS[0], len(YEARS), OPTIONS)


def nace_financial_report(spark: SparkSession, folder: str) -> DataFrame:
    """The whole job for one activity prefix and postal code."""
    views = TestViews(spark, folder)
    work = work_folder(spark, "report-companies")
    sources = (views.filing_ref, views.rubric, views.filing_text)
    found = report.nace_report(views.market_tables(), *sources, "1", RUN_POSTAL, YEARS, work, retry_whole=False)
    return found.drop("orderYear")


def report_status(spark: SparkSession, folder: str) -> DataFrame:
    rows = _report(TestViews(spark, folder), retry_whole=False)
    return rows.groupBy("status", "message").agg(F.count("*").alias("n"))


def report_remaining(spark: SparkSession, folder: str) -> DataFrame:
    views = TestViews(spark, folder)
    stored = views.filing_ref.filter(F.col("fiscalYear") == YEARS[0]).select(
        dotted_number(F.col("enterpriseNumber")).alias(NUMBER)
    )
    return report.remaining(views.enterprise.select(NUMBER, "KBOstatusCode"), stored)


def report_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The report written as CSV by all tasks and imported again."""
    path = work_folder(spark, "report")
    write_report(financial_report_retry(spark, folder), path)
    rows = read_report(spark, path)
    return rows.select(
        F.col("`Enterprise number`").alias("number"),
        F.col("`KBO name`").alias("name"),
        F.col("`Returned fiscal year`").cast("int").alias("fiscalYear"),
        F.col("`Financial data status`").alias("status"),
        F.col("`Equity EUR`").cast("double").alias("equity"),
        "revenue",
        "fte",
    )


def postal_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = work_folder(spark, "postal-counts")
    counts = market.postal_counts(TestViews(spark, folder).market_tables(), PREFIX, VERSION)
    write_postal_counts(counts, path)
    code, count = POSTAL_HEADERS.values()
    rows = read_report(spark, path)
    return rows.select(
        F.col(f"`{code}`").alias("postalCode"), F.col(f"`{count}`").cast("bigint").alias("n")
    )


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c != "data"], "data.*")


def report_rows(spark: SparkSession, folder: str) -> DataFrame:
    views = TestViews(spark, folder)
    selection = Selection(PREFIX, VERSION, "", YEARS, OPTIONS)
    rows = stored_reports.report_rows(
        "run", _companies(views), _published(views), _listed(views), selection
    )
    return _flat(rows)


def stored_report_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Three runs with different fields on storage; one is saved again, one is reset."""
    views, store = TestViews(spark, folder), work_folder(spark, "report-store")
    moments = iter(datetime.datetime(2024, 5, 6) + datetime.timedelta(minutes=i) for i in range(1000))
    wide, narrow = (Selection(PREFIX, VERSION, "", YEARS, options) for options in (OPTIONS, ["revenue"]))
    dropped = Selection(PREFIX, VERSION, "", YEARS[:1], ["equity"])
    sources = _companies(views), _published(views), _listed(views)
    companies, published, listed = report_store.keep_sources(work_folder(spark, "report-sources"), *sources)
    for run_id, selection in (("wide", wide), ("narrow", wide), ("dropped", dropped), ("narrow", narrow)):
        report_store.run_report(spark, store, run_id, companies, published, listed, selection, lambda: next(moments))
    report_store.reset_selection(spark, store, dropped)
    rows = stored_reports.completed_rows(report_store.read_runs(spark, store), report_store.read_rows(spark, store))
    return rows.select("runId", NUMBER, "fiscalYear", "status", "data.revenue", "data.equity", "data.kboStatus")


def run_header(spark: SparkSession, folder: str) -> DataFrame:
    views = TestViews(spark, folder)
    selection = Selection(PREFIX, VERSION, "1000", [1998, 1999, 1998], OPTIONS, "MAIN")
    moment = datetime.datetime(2024, 5, 6, 7, 8, 9)
    rows = _stored(views)
    header = stored_reports.run_header(
        views.enterprise, "run", selection, moment, moment, stored_reports.COMPLETED, rows
    )
    return header.select(
        "id", "status", "naceCode", "naceVersion", "classification", "postalCode",
        F.array_join(F.col("fiscalYears").cast("array<string>"), ",").alias("fiscalYears"),
        F.array_join("fields", ",").alias("fields"), "totalCompanies", "completedCompanies", "message",
    )


ROW_ORDER = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount"]


def _row_source(views: TestViews, condition: str = "true") -> DataFrame:
    """Stored result rows made of order lines: run = supplier, company = part."""
    rows = views.table("lineitem").where(condition).selectExpr(
        "concat('run-', l_suppkey) as runId", f"{company('l_partkey')} as {NUMBER}",
        "year(l_shipdate) as fiscalYear", "concat('Bedrijf ', l_partkey % 1000) as name",
        "cast(1000 + l_partkey % 50 as string) as postalCode",
        "case when l_linenumber <= 5 then 'ok' when l_linenumber = 6 then 'partial_financial_data' else 'fetch_failed' end as status",
        "if(l_linenumber = 7, 'failed', null) as message",
        "struct(l_extendedprice as revenue, if(l_linestatus = 'O', -l_quantity, l_quantity) as netResult,"
        " if(l_partkey % 3 = 0, null, l_quantity) as employeeCount, if(l_partkey % 97 = 0, l_tax, null) as insuranceInvestments,"
        " cast(null as double) as technicalProvisions, 'Actief' as kboStatus, cast(null as string) as juridicalSituation,"
        " '2000-01-01' as startDate, 'NV' as juridicalForm) as data", *ROW_ORDER,
    )
    kept = [c for c in rows.columns if c not in ROW_ORDER]
    return dedupe_first(rows, ROW_KEY, ROW_ORDER).select(*kept)


def _stored(views: TestViews) -> DataFrame:
    return _row_source(views)


def _runs(views: TestViews) -> DataFrame:
    created = "timestampadd(HOUR, cast(s_suppkey as int), timestamp_ntz'2024-01-01 00:00:00')"
    return views.table("supplier").selectExpr(
        "concat('run-', s_suppkey) as id", f"{created} as createdAt",
        f"timestampadd(MINUTE, cast((s_suppkey * 7919) % 1000 as int), {created}) as updatedAt",
        "case s_suppkey % 5 when 0 then 'queued' when 1 then 'failed' else 'completed' end as status",
        "cast(60 + s_nationkey % 4 as string) as naceCode", "'2008' as naceVersion",
        "case s_suppkey % 3 when 0 then null when 1 then '' else 'MAIN' end as classification",
        "cast(1000 + s_nationkey % 3 as string) as postalCode",
        "if(s_suppkey % 7 = 0, array(1999), array(1999, 1998)) as fiscalYears",
        "array('net-result', 'revenue') as fields", "0 as totalCompanies", "0 as completedCompanies",
        "cast(null as string) as message",
    )


def row_upsert(spark: SparkSession, folder: str) -> DataFrame:
    views = TestViews(spark, folder)
    stored = _row_source(views, "l_linestatus = 'O'")
    return _flat(stored_reports.save_rows(stored, _row_source(views, "l_linestatus = 'F'")))


def completed_rows(spark: SparkSession, folder: str) -> DataFrame:
    views = TestViews(spark, folder)
    return _flat(stored_reports.completed_rows(_runs(views), _stored(views))).drop("updatedAt")


def selected_rows(spark: SparkSession, folder: str) -> DataFrame:
    views = TestViews(spark, folder)
    return _flat(stored_reports.selected_rows(_runs(views), _stored(views), SELECTION))


def latest_runs(spark: SparkSession, folder: str) -> DataFrame:
    runs = stored_reports.latest_runs(_runs(TestViews(spark, folder)))
    return runs.select("id", "status", "naceCode", "classification", "postalCode")


def run_progress(spark: SparkSession, folder: str) -> DataFrame:
    return stored_reports.run_progress(_stored(TestViews(spark, folder)))


def run_reset(spark: SparkSession, folder: str) -> DataFrame:
    views = TestViews(spark, folder)
    runs, rows = stored_reports.reset_runs(_runs(views), _stored(views), SELECTION)
    kept = rows.groupBy(F.col("runId").alias("id")).agg(F.count("*").alias("n"))
    return runs.select("id", "status").join(kept, "id", "full")


def _results(views: TestViews) -> DataFrame:
    return stored_reports.completed_rows(_runs(views), _stored(views))


def company_year_pivot(spark: SparkSession, folder: str) -> DataFrame:
    rows = analysis.processed(_results(TestViews(spark, folder)))
    return analysis.company_year_pivot(rows, "revenue", [1997, 1998, 1999])


def company_year_pivot_newest(spark: SparkSession, folder: str) -> DataFrame:
    rows = analysis.processed(_results(TestViews(spark, folder)), nace_code="61")
    return analysis.company_year_pivot(rows, "employeeCount", [1996, 1998], analysis.NEWEST)


def pivot_years(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.pivot_years(analysis.processed(_results(TestViews(spark, folder)), "61", "1010"))


def facets(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.facets(_results(TestViews(spark, folder)), nace_code="61", postal_code="1010")


def disclosed_measures(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.disclosed_measures(_results(TestViews(spark, folder)))


def stored_export(spark: SparkSession, folder: str) -> DataFrame:
    rows = analysis.processed(_results(TestViews(spark, folder)), nace_code="61")
    return analysis.stored_export(rows)


def _imported(views: TestViews) -> DataFrame:
    """Rows of an imported report as text, with blanks, commas and unreadable cells."""
    rows = views.table("lineitem").selectExpr(
        "cast(l_orderkey as string) as `Enterprise number`", "if(l_partkey % 3 = 0, '', concat('K', l_partkey)) as `KBO name`",
        "if(l_partkey % 2 = 0, concat('N', l_partkey), null) as `NBB name`",
        "concat(year(l_shipdate), '-', l_linenumber, '-', l_suppkey) as `Returned fiscal year`",
        "case when l_partkey % 13 = 0 then null when l_partkey % 17 = 0 then 'n/a' when l_partkey % 5 = 0 then replace(cast(cast(l_extendedprice as decimal(18, 2)) as string), '.', ',')"
        " else cast(cast(l_extendedprice as decimal(18, 2)) as string) end as `Revenue EUR`",
        "concat(if(l_linestatus = 'O', '-', ' '), cast(cast(l_quantity as int) as string)) as `Net profit/loss EUR`",
        "if(l_partkey % 4 = 0, '', cast(cast(l_quantity as int) as string)) as `Total employees FTE`",
        "if(l_linenumber < 4, 'ok', 'partial_financial_data') as `Financial data status`",
    )
    return with_report_numbers(rows)


def _renamed(rows: DataFrame) -> DataFrame:
    short = {"Enterprise number": "number", "KBO name": "kbo", "NBB name": "nbb", "Returned fiscal year": "year", "Financial data status": "status"}
    return rows.select(*[F.col(f"`{c}`").alias(n) for c, n in short.items()], "revenue", "netResult", "fte")


def financial_slice(spark: SparkSession, folder: str) -> DataFrame:
    return _renamed(analysis.financial_slice(_imported(TestViews(spark, folder)), "ok", 50000, True))


def financial_kpis(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.financial_kpis(analysis.financial_slice(_imported(TestViews(spark, folder)), min_revenue=1000))


def top_revenue(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.top_revenue(_imported(TestViews(spark, folder))).withColumnRenamed("Enterprise number", "number")


def listed_rows(spark: SparkSession, folder: str) -> DataFrame:
    # Sums over the listed rows would hide a wrong list, numbers and years show it.
    return _renamed(analysis.listed_rows(_imported(TestViews(spark, folder)))).select("number", "year")


QUERIES = {
    "financial_report": financial_report,
    "financial_report_retry": financial_report_retry,
    "nace_financial_report": nace_financial_report,
    "report_status": report_status,
    "report_remaining": report_remaining,
    "report_csv": report_csv,
    "postal_csv": postal_csv,
    "report_rows": report_rows,
    "stored_report_runs": stored_report_runs,
    "run_header": run_header,
    "row_upsert": row_upsert,
    "completed_rows": completed_rows,
    "selected_rows": selected_rows,
    "latest_runs": latest_runs,
    "run_progress": run_progress,
    "run_reset": run_reset,
    "company_year_pivot": company_year_pivot,
    "company_year_pivot_newest": company_year_pivot_newest,
    "pivot_years": pivot_years,
    "facets": facets,
    "disclosed_measures": disclosed_measures,
    "stored_export": stored_export,
    "financial_slice": financial_slice,
    "financial_kpis": financial_kpis,
    "top_revenue": top_revenue,
    "listed_rows": listed_rows,
}

REPORT_VIEWS = "enterprise code denomination address filing_ref rubric filing_text"
_MEASURES = [m for _, m, _ in report.FIELDS if m != "marginPercent"]
_KNOWN = "p.error IS NULL"
_RESULTS = f"""companies AS (
  SELECT d.*, coalesce(n.name, '') AS name, a.zipcode AS "postalCode", replace(d."enterpriseNumber", '.', '') AS digits
  FROM decoded d LEFT JOIN names n USING ("enterpriseNumber")
  LEFT JOIN address a ON a."enterpriseId" = d."enterpriseNumber" AND a."typeOfAddressCode" = 'REGO'), results AS (
  SELECT p."enterpriseNumber" AS digits, CASE WHEN error IS DISTINCT FROM 'fetch_failed' THEN "enterpriseName" END AS "nbbName",
    CASE WHEN error IS DISTINCT FROM 'fetch_failed' THEN "fiscalYear" END AS "returnedFiscalYear",
    {", ".join(f'CASE WHEN {_KNOWN} THEN "{m}" END AS "{m}"' for m in _MEASURES)},
    CASE error WHEN 'unsupported_format' THEN 'accounting_pdf_only' WHEN 'fetch_failed' THEN 'fetch_failed'
      ELSE CASE WHEN revenue IS NULL OR "employeeCount" IS NULL THEN 'partial_financial_data' ELSE 'ok' END END AS status,
    CASE error WHEN 'unsupported_format' THEN '{report.PDF_MESSAGE}' WHEN 'fetch_failed' THEN '{report.EXPORT_MESSAGE}' END AS message,
    CASE WHEN error IS DISTINCT FROM 'fetch_failed' THEN "referenceNumber" END AS "referenceNumber",
    CASE WHEN error IS DISTINCT FROM 'fetch_failed' THEN "depositDate" END AS "depositDate"
  FROM published p
  UNION ALL BY NAME
  SELECT DISTINCT "enterpriseNumber" AS digits, 'no_account_for_year' AS status FROM filing_ref
  WHERE "enterpriseNumber" NOT IN (SELECT "enterpriseNumber" FROM published)), kept AS (
  SELECT * FROM results WHERE {{kept}}), report AS (
  SELECT c."enterpriseNumber", c.name, c."postalCode", k.* EXCLUDE (digits, status, message),
    coalesce(k.status, 'fetch_failed') AS status, CASE WHEN k.status IS NULL THEN '{report.RETRY_MESSAGE}' ELSE k.message END AS message,
    floor(k."netResult" / nullif(k.revenue, 0) * 10000 + 0.5) / 100 AS "marginPercent"
  FROM companies c LEFT JOIN kept k USING (digits))"""
_RETRY = "digits NOT IN (SELECT digits FROM results WHERE status = 'fetch_failed')"


def _report_sql(kept: str = "true") -> str:
    return f"{LIST_NAMES_SQL}, {DECODED_SQL}, {PUBLISHED_SQL}, {_RESULTS.replace('{kept}', kept)}"


_ROW_ORDER = ", ".join(ROW_ORDER)


def _stored_sql(condition: str = "true") -> str:
    return f"""
  SELECT 'run-' || l_suppkey AS "runId", '0' || regexp_replace(lpad(cast(l_partkey AS string), 9, '0'), '^(...)(...)(...)$', '\\1.\\2.\\3') AS "enterpriseNumber",
    cast(year(l_shipdate) AS integer) AS "fiscalYear", 'Bedrijf ' || l_partkey % 1000 AS name, cast(1000 + l_partkey % 50 AS string) AS "postalCode",
    CASE WHEN l_linenumber <= 5 THEN 'ok' WHEN l_linenumber = 6 THEN 'partial_financial_data' ELSE 'fetch_failed' END AS status,
    CASE WHEN l_linenumber = 7 THEN 'failed' END AS message, l_extendedprice AS revenue, CASE WHEN l_linestatus = 'O' THEN -l_quantity ELSE l_quantity END AS "netResult",
    CASE WHEN l_partkey % 3 <> 0 THEN l_quantity END AS "employeeCount", CASE WHEN l_partkey % 97 = 0 THEN l_tax END AS "insuranceInvestments",
    cast(NULL AS double) AS "technicalProvisions", 'Actief' AS "kboStatus", cast(NULL AS string) AS "juridicalSituation",
    '2000-01-01' AS "startDate", 'NV' AS "juridicalForm"
  FROM lineitem WHERE {condition}
  QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey, year(l_shipdate) ORDER BY {_ROW_ORDER}) = 1"""


_RUNS = """runs AS (
  SELECT 'run-' || s_suppkey AS id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(cast(s_suppkey * 60 + (s_suppkey * 7919) % 1000 AS integer)) AS "updatedAt",
    CASE s_suppkey % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'failed' ELSE 'completed' END AS status,
    cast(60 + s_nationkey % 4 AS string) AS "naceCode", '2008' AS "naceVersion",
    CASE s_suppkey % 3 WHEN 1 THEN '' WHEN 2 THEN 'MAIN' END AS classification, cast(1000 + s_nationkey % 3 AS string) AS "postalCode",
    CASE WHEN s_suppkey % 7 = 0 THEN [1999] ELSE [1999, 1998] END AS "fiscalYears"
  FROM supplier)"""
_CHOSEN = """"naceCode" = '60' AND coalesce(classification, '') = '' AND "postalCode" = '1001' AND "fiscalYears" = [1999, 1998]"""
_STORED = f"WITH stored AS ({_stored_sql()}), {_RUNS}"
_COMPLETED = f"""{_STORED}, done AS (
  SELECT s.*, r."naceCode", r."naceVersion", r.classification, r."updatedAt" FROM stored s JOIN runs r ON r.id = s."runId" WHERE r.status = 'completed')"""


def _pivot_sql(measure: str, years: list[int], direction: str, condition: str) -> str:
    picked = ", ".join(
        f"""(array_agg("{measure}" ORDER BY "updatedAt" {direction}, "runId" {direction}) FILTER ("fiscalYear" = {y}))[1] AS "{y}\""""
        for y in years
    )
    return f"""{_COMPLETED} SELECT (array_agg(name ORDER BY "updatedAt" DESC, "runId" DESC))[1] AS name, "enterpriseNumber", {picked}
FROM done WHERE status = 'ok' AND {condition} AND "fiscalYear" IN ({", ".join(map(str, years))}) GROUP BY "enterpriseNumber\""""


_IMPORTED = """WITH imported AS (
  SELECT cast(l_orderkey AS string) AS number, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'K' || l_partkey END AS kbo,
    CASE WHEN l_partkey % 2 = 0 THEN 'N' || l_partkey END AS nbb, year(l_shipdate) || '-' || l_linenumber || '-' || l_suppkey AS year,
    CASE WHEN l_linenumber < 4 THEN 'ok' ELSE 'partial_financial_data' END AS status,
    CASE WHEN l_partkey % 13 <> 0 AND l_partkey % 17 <> 0 THEN cast(cast(l_extendedprice AS decimal(18, 2)) AS double) END AS revenue,
    CASE WHEN l_linestatus = 'O' THEN -1.0 ELSE 1.0 END * floor(l_quantity) AS "netResult",
    CASE WHEN l_partkey % 4 <> 0 THEN floor(l_quantity) END AS fte FROM lineitem)"""
_COLUMNS = ", ".join(
    f"count(\"{m}\") AS \"{m}\""
    for m in ["revenue", "netResult", "employeeCount", "insuranceInvestments", "technicalProvisions"]
)

ORACLE = {
    "financial_report": with_views(REPORT_VIEWS, "SELECT * FROM report", _report_sql()),
    "financial_report_retry": with_views(
        REPORT_VIEWS,
        f"""
SELECT "enterpriseNumber" AS "Enterprise number", name AS "KBO name", "nbbName" AS "NBB name", "postalCode" AS "Postal code", '{PREFIX}' AS "NACE code",
  '{VERSION}' AS "NACE version", cast(NULL AS string) AS "Classification", {YEARS[0]} AS "Requested fiscal year", {len(YEARS)} AS "History years requested",
  "returnedFiscalYear" AS "Returned fiscal year", revenue AS "Revenue EUR", "employeeCount" AS "Total employees FTE", equity AS "Equity EUR",
  "marginPercent" AS "Net profit margin %", status AS "Financial data status", message AS "NBB message", "referenceNumber" AS "NBB reference",
  "depositDate" AS "NBB deposit date" FROM report""",
        _report_sql(_RETRY),
    ),
    "nace_financial_report": with_views(
        REPORT_VIEWS + " establishment activity",
        f"""SELECT * FROM report WHERE "postalCode" = '{RUN_POSTAL}' AND "enterpriseNumber" IN (SELECT * FROM hits)""",
        f"{_report_sql()}, {hits_sql('1', None)}",
    ),
    "report_status": with_views(
        REPORT_VIEWS, "SELECT status, message, count(*) AS n FROM report GROUP BY 1, 2", _report_sql()
    ),
    "report_remaining": with_views(
        "enterprise",
        f"""SELECT "enterpriseNumber", "KBOstatusCode" FROM enterprise WHERE replace("enterpriseNumber", '.', '') NOT IN (
  SELECT '0' || lpad(cast(o_custkey AS string), 9, '0') FROM orders WHERE year(o_orderdate) = {YEARS[0]})""",
    ),
    "report_csv": with_views(
        REPORT_VIEWS,
        """
SELECT "enterpriseNumber" AS number, nullif(name, '') AS name, "returnedFiscalYear" AS "fiscalYear", status, equity, revenue, "employeeCount" AS fte
FROM report""",
        _report_sql(_RETRY),
    ),
    "postal_csv": with_views(
        MARKET_VIEWS, 'SELECT "postalCode", "enterpriseCount" AS n FROM counts', f"{hits_sql()}, {COUNTS_SQL}"
    ),
    "report_rows": with_views(
        REPORT_VIEWS,
        f"""
SELECT 'run' AS "runId", c."enterpriseNumber", c.name, c."postalCode", coalesce(p."fiscalYear", {max(YEARS)}) AS "fiscalYear",
  CASE WHEN p."fiscalYear" IS NOT NULL THEN CASE WHEN p.error IS NULL THEN 'ok' ELSE 'partial_financial_data' END
    WHEN c.digits IN (SELECT "enterpriseNumber" FROM filing_ref) THEN 'no_account_for_year' ELSE 'fetch_failed' END AS status,
  CASE WHEN p."fiscalYear" IS NOT NULL THEN p.error WHEN c.digits IN (SELECT "enterpriseNumber" FROM filing_ref)
    THEN '{stored_reports.NO_ACCOUNT_MESSAGE}' ELSE '{stored_reports.FAILED_MESSAGE}' END AS message,
  revenue, "employeeCount", equity, "marginPercent", {", ".join(f'"{m}"' for m in INSURER_MEASURES)},
  c.status AS "kboStatus", c."juridicalSituation", c."startDate", c."juridicalForm"
FROM companies c LEFT JOIN published p ON p."enterpriseNumber" = c.digits""",
        _report_sql(),
    ),
    "stored_report_runs": with_views(
        REPORT_VIEWS,
        f"""
SELECT r.id AS "runId", c."enterpriseNumber", coalesce(p."fiscalYear", {max(YEARS)}) AS "fiscalYear",
  CASE WHEN p."fiscalYear" IS NOT NULL THEN CASE WHEN p.error IS NULL THEN 'ok' ELSE 'partial_financial_data' END
    WHEN c.digits IN (SELECT "enterpriseNumber" FROM filing_ref) THEN 'no_account_for_year' ELSE 'fetch_failed' END AS status,
  revenue, CASE WHEN r.id = 'wide' THEN equity END AS equity, c.status AS "kboStatus"
FROM (SELECT unnest(['wide', 'narrow']) AS id) r, companies c LEFT JOIN published p ON p."enterpriseNumber" = c.digits""",
        _report_sql(),
    ),
    "run_header": with_views(
        "enterprise",
        f"""
SELECT 'run' AS id, 'completed' AS status, '{PREFIX}' AS "naceCode", '{VERSION}' AS "naceVersion", 'MAIN' AS classification, '1000' AS "postalCode",
  '1999,1998' AS "fiscalYears", 'employees,equity,profit-margin,revenue' AS fields, cast(count(*) AS integer) AS "totalCompanies",
  (SELECT cast(count(DISTINCT "enterpriseNumber") AS integer) FROM ({_stored_sql()})) AS "completedCompanies", cast(NULL AS string) AS message
FROM enterprise""",
    ),
    "row_upsert": f"""WITH old AS ({_stored_sql("l_linestatus = 'O'")}), new AS ({_stored_sql("l_linestatus = 'F'")})
SELECT * FROM new UNION ALL SELECT o.* FROM old o ANTI JOIN new USING ("runId", "enterpriseNumber", "fiscalYear")""",
    "completed_rows": f'{_COMPLETED} SELECT * EXCLUDE ("updatedAt") FROM done',
    "selected_rows": f"""{_STORED} SELECT s.*, r."naceCode" FROM stored s JOIN (
  SELECT * FROM runs WHERE {_CHOSEN} ORDER BY "updatedAt" DESC, id DESC LIMIT 1) r ON r.id = s."runId\"""",
    "latest_runs": f"""WITH {_RUNS} SELECT id, status, "naceCode", classification, "postalCode" FROM runs
QUALIFY row_number() OVER (PARTITION BY "naceCode", coalesce(classification, ''), "postalCode", "fiscalYears" ORDER BY "updatedAt" DESC, id DESC) = 1""",
    "run_progress": f"""{_STORED} SELECT "runId", status, count(*) AS "rowCount", count(DISTINCT "enterpriseNumber") AS "companyCount" FROM stored GROUP BY 1, 2""",
    "run_reset": f"""{_STORED}, dropped AS (SELECT id FROM runs WHERE {_CHOSEN} AND status NOT IN ('queued', 'running'))
SELECT id, status, n FROM (SELECT id, status FROM runs WHERE id NOT IN (SELECT id FROM dropped)) FULL JOIN (
  SELECT "runId" AS id, count(*) AS n FROM stored WHERE "runId" NOT IN (SELECT id FROM dropped) GROUP BY 1) USING (id)""",
    "company_year_pivot": _pivot_sql("revenue", [1999, 1998, 1997], "ASC", "true"),
    "company_year_pivot_newest": _pivot_sql("employeeCount", [1998, 1996], "DESC", "\"naceCode\" = '61'"),
    "pivot_years": f"""{_COMPLETED} SELECT DISTINCT "fiscalYear" FROM done WHERE status = 'ok' AND "naceCode" = '61' AND "postalCode" = '1010'""",
    "facets": f"""{_COMPLETED} SELECT DISTINCT 'naceCode' AS facet, "naceCode" AS value FROM done WHERE status = 'ok' AND "postalCode" = '1010'
UNION ALL SELECT DISTINCT 'postalCode', "postalCode" FROM done WHERE status = 'ok' AND "naceCode" = '61'""",
    "disclosed_measures": f"""{_COMPLETED} SELECT measure, n, n > 0 OR measure NOT IN ('insuranceInvestments', 'technicalProvisions') AS shown FROM (
  UNPIVOT (SELECT {_COLUMNS} FROM done) ON COLUMNS(*) INTO NAME measure VALUE n)""",
    "stored_export": f"""{_COMPLETED} SELECT "enterpriseNumber" AS "Enterprise number", name AS "Company", "postalCode" AS "Postal code", "kboStatus" AS "KBO status",
  "juridicalSituation" AS "Legal situation", "startDate" AS "Start date", "juridicalForm" AS "Legal form", "fiscalYear" AS "Fiscal year", status AS "NBB status",
  revenue, "netResult", "employeeCount", "insuranceInvestments", "technicalProvisions" FROM done WHERE status = 'ok' AND "naceCode" = '61'""",
    "financial_slice": f"""{_IMPORTED} SELECT * FROM imported WHERE status = 'ok' AND revenue >= 50000 AND "netResult" > 0""",
    "financial_kpis": f"""{_IMPORTED} SELECT count(*) AS "rowCount", count(*) FILTER (status = 'ok') AS "completeCount",
  cast(sum(cast(revenue AS decimal(28, 4))) AS double) AS revenue, cast(sum(cast("netResult" AS decimal(28, 4))) AS double) AS "netResult",
  cast(sum(cast(fte AS decimal(28, 4))) AS double) AS fte,
  cast(count(*) FILTER (status = 'ok') AS double) / cast(count(*) AS double) * 100.0 AS "qualityPercent" FROM imported WHERE revenue >= 1000""",
    "top_revenue": f"""{_IMPORTED} SELECT coalesce(nullif(kbo, ''), nullif(nbb, ''), number) AS label, number, revenue FROM imported
WHERE revenue IS NOT NULL ORDER BY revenue DESC, number, year LIMIT 10""",
    "listed_rows": f"{_IMPORTED} SELECT number, year FROM imported ORDER BY number, year DESC LIMIT 250",
}
