"""Registered market queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmatlas.operators import ranges
from firmatlas.plans import code_bitmaps, market
from firmatlas.session import work_folder
from firmatlas.sources.testviews import TestViews, with_views

PREFIX, VERSION = "6", "2008"
POSTAL = "1101"


def hits_sql(prefix: str = PREFIX, version: str | None = VERSION, classification: str | None = None) -> str:
    condition = f"""starts_with("naceCode", '{prefix}')"""
    if version:
        condition += f""" AND "naceVersion" = '{version}'"""
    if classification:
        condition += f" AND classification = '{classification}'"
    return f"""hits AS (
  SELECT "enterpriseId" AS "enterpriseNumber" FROM activity
  WHERE {condition} AND "enterpriseId" IS NOT NULL
  UNION
  SELECT e."enterpriseNumber" FROM activity a JOIN establishment e ON e."establishmentNumber" = a."establishmentId"
  WHERE {condition})"""


COUNTS_SQL = """counts AS (
  SELECT coalesce(nullif(zipcode, ''), 'Unknown') AS "postalCode", count(*) AS "enterpriseCount"
  FROM hits LEFT JOIN address a ON a."enterpriseId" = hits."enterpriseNumber" AND a."typeOfAddressCode" = 'REGO'
  GROUP BY 1)"""

LIST_NAMES_SQL = """names AS (
  SELECT "enterpriseId" AS "enterpriseNumber", denomination AS name FROM denomination
  QUALIFY row_number() OVER (PARTITION BY "enterpriseId" ORDER BY
    CASE "languageCode" WHEN 'NL' THEN 0 WHEN 'FR' THEN 1 ELSE 2 END, "typeOfDenominationCode", "languageCode") = 1)"""

DECODED_SQL = """decoded AS (
  SELECT e."enterpriseNumber", s.description AS status, j.description AS "juridicalSituation",
    strftime(e."startDate", '%Y-%m-%d') AS "startDate", coalesce(f.description, c.description) AS "juridicalForm"
  FROM enterprise e
  LEFT JOIN code s ON s.category = 'Status' AND s.code = e."KBOstatusCode"
  LEFT JOIN code j ON j.category = 'JuridicalSituation' AND j.code = e."juridicalSituationCode"
  LEFT JOIN code f ON f.category = 'JuridicalForm' AND f.code = e."juridicalFormCode"
  LEFT JOIN code c ON c.category = 'JuridicalForm' AND c.code = e."juridicalFormCACCode")"""


def _views(spark: SparkSession, folder: str) -> TestViews:
    return TestViews(spark, folder)


def nace_hits(spark: SparkSession, folder: str) -> DataFrame:
    return market.hits_of(_views(spark, folder).market_tables(), PREFIX)


def postal_counts(spark: SparkSession, folder: str) -> DataFrame:
    return market.postal_counts(_views(spark, folder).market_tables(), PREFIX, VERSION)


def postal_counts_main(spark: SparkSession, folder: str) -> DataFrame:
    return market.postal_counts(_views(spark, folder).market_tables(), PREFIX, VERSION, "MAIN")


def postal_share(spark: SparkSession, folder: str) -> DataFrame:
    return market.postal_pivot(postal_counts(spark, folder), min_count=2, term="1")


def market_kpis(spark: SparkSession, folder: str) -> DataFrame:
    return market.market_kpis(postal_counts(spark, folder))


def nace_page(spark: SparkSession, folder: str) -> DataFrame:
    page = market.companies_by_nace(
        _views(spark, folder).market_tables(), PREFIX, VERSION, "MAIN", limit=40, offset=10
    )
    return page.withColumn("naceCodes", F.concat_ws(",", "naceCodes")).withColumn(
        "classifications", F.concat_ws(",", "classifications")
    )


def nace_postal_companies(spark: SparkSession, folder: str) -> DataFrame:
    return market.companies_by_nace_postal(_views(spark, folder).market_tables(), PREFIX, POSTAL)


def name_sorted(spark: SparkSession, folder: str) -> DataFrame:
    companies = market.companies_by_nace_postal(_views(spark, folder).market_tables(), PREFIX, POSTAL)
    return market.filter_companies(companies, "handel", descending=True)


def nace_catalog_search(spark: SparkSession, folder: str) -> DataFrame:
    catalog = market.nace_catalog(_views(spark, folder).nace_catalog)
    return market.search_nace(catalog, VERSION, "gearen")


def deep_page(spark: SparkSession, folder: str) -> DataFrame:
    """The page after the first half of all hits of a prefix, by its number."""
    tables, path = _views(spark, folder).market_tables(), work_folder(spark, "hit-pages")
    market.store_pages(tables, path, PREFIX)
    half = ranges.total(spark, path) // 2
    page = market.stored_page(tables, path, PREFIX, limit=60, offset=half)
    return page.withColumn("naceCodes", F.concat_ws(",", "naceCodes")).drop("classifications")


# Names that differ in case and accents only, or in the letter after them.
MIXED_NAMES = ["Élan", "elan", "ELÀN", "Eland", "zoë", "Zoe", "ångström", "Angstrom", "Cœur", "de Wit", "De  Wit", "Ñandu"]


def name_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """Companies with their rank in Dutch name order, in ranges."""
    enterprise, path = _views(spark, folder).enterprise, work_folder(spark, "name-ranks")
    names = ", ".join(f"'{n}'" for n in MIXED_NAMES)
    companies = enterprise.selectExpr(
        "enterpriseNumber", f"concat(element_at(array({names}), cast(substr(enterpriseNumber, 11, 3) as int) % {len(MIXED_NAMES)} + 1),"
        " ' ', cast(substr(enterpriseNumber, 11, 3) as int) % 7) as name"
    )
    found = market.filter_companies(companies, "an")
    ranges.store_ranges(found, market.name_order(), path)
    return ranges.with_ranks(spark, path)


def blank_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that each market job gives for a code or postal code of blanks only, and for a real one."""
    tables = _views(spark, folder).market_tables()
    jobs = {}
    for label, code, postal in (("blank", "  ", POSTAL), ("empty", "", POSTAL), ("no postal code", PREFIX, " \t"), ("real", f" {PREFIX} ", f" {POSTAL} ")):
        jobs[f"hits, {label}"] = market.hits_of(tables, code)
        jobs[f"counts, {label}"] = market.postal_counts(tables, code)
        jobs[f"total, {label}"] = market.nace_total(tables, code).filter("total > 0")
        jobs[f"postal companies, {label}"] = market.companies_by_nace_postal(tables, code, postal)
    counts = [df.agg(F.lit(job).alias("job"), F.count("*").alias("n")) for job, df in jobs.items()]
    return reduce(DataFrame.unionByName, counts)


# Prefixes of all lengths, with and without version and classification.
ASKED_CODES = [("6", None, None), (PREFIX, VERSION, None), (PREFIX, VERSION, "MAIN"), ("61", "2025", None), ("1234", None, "SECO"), ("79871", None, None), ("x", None, None)]


def bitmap_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Postal counts of several prefixes out of one stored table of bitmaps."""
    path = work_folder(spark, "code-bitmaps")
    code_bitmaps.write_bitmaps(_views(spark, folder).market_tables(), path)
    return code_bitmaps.many_postal_counts(spark, path, ASKED_CODES)


QUERIES = {
    "nace_hits": nace_hits,
    "postal_counts": postal_counts,
    "postal_counts_main": postal_counts_main,
    "postal_share": postal_share,
    "market_kpis": market_kpis,
    "nace_page": nace_page,
    "nace_postal_companies": nace_postal_companies,
    "name_sorted": name_sorted,
    "nace_catalog_search": nace_catalog_search,
    "deep_page": deep_page,
    "name_ranked": name_ranked,
    "blank_codes": blank_codes,
    "bitmap_counts": bitmap_counts,
}

MARKET_VIEWS = "establishment activity address"
_POSTAL_COMPANIES = f"""
SELECT h."enterpriseNumber", coalesce(n.name, '') AS name, '{POSTAL}' AS "postalCode", status, "juridicalSituation",
  "startDate", "juridicalForm"
FROM hits h JOIN decoded d USING ("enterpriseNumber")
JOIN address a ON a."enterpriseId" = h."enterpriseNumber" AND a."typeOfAddressCode" = 'REGO' AND a.zipcode = '{POSTAL}'
LEFT JOIN names n ON n."enterpriseNumber" = h."enterpriseNumber\""""

ORACLE = {
    "nace_hits": with_views(MARKET_VIEWS, "SELECT * FROM hits", hits_sql(version=None)),
    "postal_counts": with_views(MARKET_VIEWS, "SELECT * FROM counts", f"{hits_sql()}, {COUNTS_SQL}"),
    "postal_counts_main": with_views(
        MARKET_VIEWS, "SELECT * FROM counts", f"{hits_sql(classification='MAIN')}, {COUNTS_SQL}"
    ),
    "postal_share": with_views(
        MARKET_VIEWS,
        """
SELECT * FROM (SELECT *, cast("enterpriseCount" AS double) / cast(sum("enterpriseCount") OVER () AS double) * 100.0 AS "sharePercent"
  FROM counts)
WHERE "postalCode" <> 'Unknown' AND "enterpriseCount" >= 2 AND contains("postalCode", '1')""",
        f"{hits_sql()}, {COUNTS_SQL}",
    ),
    "market_kpis": with_views(
        MARKET_VIEWS,
        """
SELECT cast(sum("enterpriseCount") AS bigint) AS total, count(*) FILTER ("postalCode" <> 'Unknown') AS "postalMarkets",
  cast(sum("enterpriseCount") FILTER ("postalCode" <> 'Unknown') AS bigint) AS "mappedTotal",
  cast(coalesce(sum("enterpriseCount") FILTER ("postalCode" = 'Unknown'), 0) AS bigint) AS missing,
  (SELECT "postalCode" FROM counts WHERE "postalCode" <> 'Unknown' ORDER BY "enterpriseCount" DESC, "postalCode" LIMIT 1) AS "largestPostalCode",
  max("enterpriseCount") FILTER ("postalCode" <> 'Unknown') AS "largestCount",
  cast(max("enterpriseCount") FILTER ("postalCode" <> 'Unknown') AS double) / cast(sum("enterpriseCount") AS double) * 100.0 AS "largestSharePercent"
FROM counts""",
        f"{hits_sql()}, {COUNTS_SQL}",
    ),
    "nace_page": with_views(
        MARKET_VIEWS + " enterprise code denomination",
        f"""
SELECT p."enterpriseNumber", coalesce(n.name, '') AS name, nullif(c.city, '') AS city, status, "juridicalSituation", "startDate",
  "juridicalForm", '{PREFIX}' AS "naceCodes", 'MAIN' AS classifications, (SELECT count(*) FROM hits) AS total
FROM (SELECT * FROM hits ORDER BY 1 LIMIT 40 OFFSET 10) p
JOIN decoded USING ("enterpriseNumber") LEFT JOIN names n USING ("enterpriseNumber")
LEFT JOIN (SELECT "enterpriseId", coalesce("municipalityNL", "municipalityFR") AS city FROM address
  QUALIFY row_number() OVER (PARTITION BY "enterpriseId" ORDER BY "typeOfAddressCode" DESC) = 1) c
  ON c."enterpriseId" = p."enterpriseNumber\"""",
        f"{hits_sql(classification='MAIN')}, {LIST_NAMES_SQL}, {DECODED_SQL}",
    ),
    "nace_postal_companies": with_views(
        MARKET_VIEWS + " enterprise code denomination",
        _POSTAL_COMPANIES,
        f"{hits_sql(version=None)}, {LIST_NAMES_SQL}, {DECODED_SQL}",
    ),
    "name_sorted": with_views(
        MARKET_VIEWS + " enterprise code denomination",
        f"SELECT * FROM ({_POSTAL_COMPANIES}) WHERE contains(lower(name || ' ' || \"enterpriseNumber\"), 'handel')",
        f"{hits_sql(version=None)}, {LIST_NAMES_SQL}, {DECODED_SQL}",
    ),
    "nace_catalog_search": with_views(
        "nace_catalog",
        """
SELECT '2008' AS version, "Code" AS code, "Description" AS description FROM nace_catalog
WHERE "Category" = 'Nace2008' AND (contains(lower("Description"), 'gearen') OR contains(lower("Description"), 'gear'))
ORDER BY 2, 3 LIMIT 100""",
    ),
    "deep_page": with_views(
        MARKET_VIEWS + " enterprise code denomination",
        f"""
SELECT p."enterpriseNumber", coalesce(n.name, '') AS name, nullif(c.city, '') AS city, status, "juridicalSituation", "startDate",
  "juridicalForm", '{PREFIX}' AS "naceCodes", (SELECT count(*) FROM hits) AS total
FROM (SELECT * FROM hits QUALIFY row_number() OVER (ORDER BY "enterpriseNumber") - 1 BETWEEN (SELECT count(*) // 2 FROM hits) AND (SELECT count(*) // 2 + 59 FROM hits)) p
JOIN decoded USING ("enterpriseNumber") LEFT JOIN names n USING ("enterpriseNumber")
LEFT JOIN (SELECT "enterpriseId", coalesce("municipalityNL", "municipalityFR") AS city FROM address
  QUALIFY row_number() OVER (PARTITION BY "enterpriseId" ORDER BY "typeOfAddressCode" DESC) = 1) c
  ON c."enterpriseId" = p."enterpriseNumber\"""",
        f"{hits_sql(version=None)}, {LIST_NAMES_SQL}, {DECODED_SQL}",
    ),
    "name_ranked": with_views(
        "enterprise",
        f"""
SELECT "enterpriseNumber", name, row_number() OVER (ORDER BY lower(strip_accents(replace(name, 'œ', 'oe'))), "enterpriseNumber") - 1 AS rank
FROM (SELECT "enterpriseNumber", [{", ".join(f"'{n}'" for n in MIXED_NAMES)}][cast(substr("enterpriseNumber", 11, 3) AS integer) % {len(MIXED_NAMES)} + 1]
  || ' ' || cast(substr("enterpriseNumber", 11, 3) AS integer) % 7 AS name FROM enterprise)
WHERE contains(lower(name), 'an')""",
    ),
    "blank_codes": with_views(
        MARKET_VIEWS,
        f"""
SELECT job || ', ' || label AS job, CASE WHEN label = 'real' OR (label = 'no postal code' AND job <> 'postal companies') THEN n ELSE 0 END AS n
FROM (VALUES ('blank'), ('empty'), ('no postal code'), ('real')) l(label), (
  SELECT 'hits' AS job, count(*) AS n FROM hits UNION ALL SELECT 'counts', count(*) FROM counts UNION ALL SELECT 'total', 1
  UNION ALL SELECT 'postal companies', count(*) FROM hits JOIN address a ON a."enterpriseId" = hits."enterpriseNumber"
    AND a."typeOfAddressCode" = 'REGO' AND a.zipcode = '{POSTAL}')""",
        f"{hits_sql(version=None)}, {COUNTS_SQL}",
    ),
}


def _bitmap_sql() -> str:
    def text(value: str | None) -> str:
        return "cast(NULL AS string)" if value is None else f"'{value}'"

    parts = []
    for code, version, classification in ASKED_CODES:
        hits = hits_sql(code, version, classification).removeprefix("hits AS ")
        names = f"{text(code)} AS code, {text(version)} AS version, {text(classification)} AS classification"
        parts.append(f"""SELECT {names}, coalesce(nullif(zipcode, ''), 'Unknown') AS "postalCode", count(*) AS "enterpriseCount"
  FROM {hits} h LEFT JOIN address a ON a."enterpriseId" = h."enterpriseNumber" AND a."typeOfAddressCode" = 'REGO' GROUP BY ALL""")
    return " UNION ALL ".join(parts)


ORACLE["bitmap_counts"] = with_views(MARKET_VIEWS, _bitmap_sql())
