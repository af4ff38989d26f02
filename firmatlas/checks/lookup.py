"""Registered lookup queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmatlas.functions.identifiers import dotted_number, entity_kind, vat_digits
from firmatlas.operators import registry
from firmatlas.plans import lookup, name_index
from firmatlas.session import work_folder
from firmatlas.sources.snapshots import company_tables, write_company_tables
from firmatlas.sources.testviews import TestViews, with_views

from .market import DECODED_SQL, LIST_NAMES_SQL


def _flat(profile: DataFrame, *keep: str) -> DataFrame:
    """Nested parts as counts and sorted text, so that both engines can be compared."""

    def text(column: str, *fields: str):
        return F.array_join(
            F.array_sort(F.transform(column, lambda x: F.concat_ws("|", *[x[f] for f in fields]))), ";"
        )

    return profile.select(
        *keep,
        "enterpriseNumber",
        "name",
        F.size("addresses").cast("bigint").alias("addressCount"),
        text("addresses", "street", "houseNumber", "postalZone", "city", "country").alias("addressText"),
        F.size("contacts").cast("bigint").alias("contactCount"),
        text("contacts", "type", "value").alias("contactText"),
        "juridicalForm",
        "juridicalSituation",
        "startDate",
        "status",
    )


def company_profile(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(lookup.profiles(TestViews(spark, folder).tables()))


def company_profile_bucketed(spark: SparkSession, folder: str) -> DataFrame:
    """All profiles from tables stored in buckets of companies."""
    views = TestViews(spark, folder)
    prefix = f"profiles_{uuid.uuid4().hex}"
    write_company_tables(views.tables(), prefix, buckets=8)
    return _flat(lookup.profiles(company_tables(spark, prefix, views.tables())))


def preferred_names(spark: SparkSession, folder: str) -> DataFrame:
    return registry.preferred_names(TestViews(spark, folder).denomination)


def profile_names(spark: SparkSession, folder: str) -> DataFrame:
    return registry.profile_names(TestViews(spark, folder).denomination, "FR")


def decoded_companies(spark: SparkSession, folder: str) -> DataFrame:
    views = TestViews(spark, folder)
    return registry.decode_companies(views.enterprise, views.code)


def lookup_number(spark: SparkSession, folder: str) -> DataFrame:
    views = TestViews(spark, folder)
    queries = views.table("orders").selectExpr(
        "o_orderkey as queryId",
        "case when o_orderkey % 3 = 0 then concat('0', lpad(cast(o_custkey as string), 9, '0'))"
        " when o_orderkey % 3 = 1 then concat(' 0', substr(lpad(cast(o_custkey as string), 9, '0'), 1, 5), ' ',"
        " substr(lpad(cast(o_custkey as string), 9, '0'), 6, 4))"
        " else cast(o_custkey as string) end as number",
    )
    found = lookup.lookup_numbers(queries, views.tables())
    return found.select("queryId", "enterpriseNumber", "name", "status", F.size("contacts").cast("bigint").alias("contactCount"))


def lookup_vat(spark: SparkSession, folder: str) -> DataFrame:
    views = TestViews(spark, folder)
    queries = views.table("orders").selectExpr(
        "o_orderkey as queryId",
        "if(o_orderkey % 5 = 0, 'NL', if(o_orderkey % 2 = 0, 'be', 'BE')) as country",
        "case when o_orderkey % 4 = 0 then concat('BE ', lpad(cast(o_custkey as string), 9, '0'))"
        " when o_orderkey % 4 = 1 then concat('2', lpad(cast(o_custkey as string), 9, '0'))"
        " else concat('BE0', lpad(cast(o_custkey as string), 9, '0')) end as vat",
    )
    found = lookup.lookup_vats(queries, views.tables())
    return found.select("queryId", "enterpriseNumber", "name", "juridicalForm", F.size("addresses").cast("bigint").alias("addressCount"))


def number_formats(spark: SparkSession, folder: str) -> DataFrame:
    orders = TestViews(spark, folder).table("orders")
    digits = F.concat(F.lit("BE "), F.col("o_custkey") * 7919 + 100000000)
    return orders.select(
        F.col("o_orderkey").alias("queryId"),
        dotted_number(digits).alias("dotted"),
        vat_digits(digits).alias("vat"),
        dotted_number(vat_digits(digits)).alias("dottedVat"),
    )


def _name_queries(views: TestViews) -> DataFrame:
    return views.table("orders").selectExpr(
        "o_orderkey as queryId",
        "case o_orderkey % 5 when 0 then concat(' sa customer#', lpad(cast(o_custkey as string), 9, '0'), ' ')"
        " when 1 then concat('#', lpad(cast(o_custkey as string), 9, '0'), ' l')"
        " when 2 then concat('MER#', lpad(cast(o_custkey div 10 as string), 8, '0'))"
        " when 3 then cast(o_custkey as string) else concat('x%', cast(o_custkey as string)) end as name",
    )


#: Folders of the indexes that this process has stored, by application and data folder.
_indexes: dict[tuple[str, str], str] = {}


def _name_index(views: TestViews) -> str:
    """A stored index of the names in a data folder, built on first use."""
    key = (views.spark.sparkContext.applicationId, views.folder)
    if key not in _indexes:
        path = work_folder(views.spark, "name-index")
        name_index.write_index(views.denomination, path)
        _indexes[key] = path
    return _indexes[key]


def lookup_name(spark: SparkSession, folder: str) -> DataFrame:
    views = TestViews(spark, folder)
    asked = _name_queries(views).withColumnRenamed("name", "asked")
    found = lookup.lookup_names(asked, views.tables(), "asked", _name_index(views))
    return found.select("queryId", "asked", "enterpriseNumber", "name", "status")


def lookup_name_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The same lookup without a stored index."""
    views = TestViews(spark, folder)
    found = lookup.lookup_names(_name_queries(views).withColumnRenamed("name", "asked"), views.tables(), "asked")
    return found.select("queryId", "asked", "enterpriseNumber", "name", "status")


def entity_routing(spark: SparkSession, folder: str) -> DataFrame:
    rows = TestViews(spark, folder).activity_raw
    return rows.groupBy(entity_kind(F.col("entityNumber")).alias("kind"), "naceVersion").agg(
        F.count("*").alias("n"), F.min("entityNumber").alias("first"), F.max("entityNumber").alias("last")
    )


QUERIES = {
    "company_profile": company_profile,
    "company_profile_bucketed": company_profile_bucketed,
    "preferred_names": preferred_names,
    "profile_names": profile_names,
    "decoded_companies": decoded_companies,
    "lookup_number": lookup_number,
    "lookup_vat": lookup_vat,
    "lookup_name": lookup_name,
    "lookup_name_scan": lookup_name_scan,
    "number_formats": number_formats,
    "entity_routing": entity_routing,
}

PROFILE_NAMES_SQL = """profile_names AS (
  SELECT "enterpriseId" AS "enterpriseNumber", denomination AS name FROM denomination
  QUALIFY row_number() OVER (PARTITION BY "enterpriseId" ORDER BY
    CASE "languageCode" WHEN 'NL' THEN 0 ELSE 1 END, "typeOfDenominationCode", "languageCode") = 1)"""
PROFILE_SQL = f"""{DECODED_SQL}, {PROFILE_NAMES_SQL}, addresses AS (
  SELECT "enterpriseId" AS "enterpriseNumber", count(*) AS n, string_agg(t, ';' ORDER BY t) AS txt FROM (
    SELECT "enterpriseId", coalesce("streetNL", "streetFR", '') || '|' || coalesce("houseNumber", '') || '|' || coalesce(zipcode, '')
      || '|' || coalesce("municipalityNL", "municipalityFR", '') || '|' || coalesce("countryNL", "countryFR", 'BE') AS t
    FROM address) GROUP BY 1), contacts AS (
  SELECT "enterpriseId" AS "enterpriseNumber", count(*) AS n, string_agg(t, ';' ORDER BY t) AS txt FROM (
    SELECT "enterpriseId", coalesce(description, '') || '|' || value AS t
    FROM contact LEFT JOIN code ON category = 'ContactType' AND code.code = "conctactTypeCode") GROUP BY 1), profile AS (
  SELECT d."enterpriseNumber", coalesce(n.name, '') AS name, coalesce(a.n, 0) AS "addressCount", coalesce(a.txt, '') AS "addressText",
    coalesce(c.n, 0) AS "contactCount", coalesce(c.txt, '') AS "contactText", "juridicalForm", "juridicalSituation", "startDate", status
  FROM decoded d LEFT JOIN profile_names n USING ("enterpriseNumber") LEFT JOIN addresses a USING ("enterpriseNumber")
  LEFT JOIN contacts c USING ("enterpriseNumber"))"""
PROFILE_VIEWS = "enterprise code denomination address contact"
_DOTTED = "regexp_replace({0}, '^([0-9]{{4}})([0-9]{{3}})([0-9]{{3}})$', '\\1.\\2.\\3')"
_FORMATS = """SELECT o_orderkey AS "queryId", 'BE ' || (o_custkey * 7919 + 100000000) AS raw,
  cast(o_custkey * 7919 + 100000000 AS string) AS digits FROM orders"""

ORACLE = {
    "company_profile": with_views(PROFILE_VIEWS, "SELECT * FROM profile", PROFILE_SQL),
    "preferred_names": with_views("denomination", "SELECT * FROM names", LIST_NAMES_SQL),
    "profile_names": with_views(
        "denomination", "SELECT * FROM profile_names", PROFILE_NAMES_SQL.replace("'NL'", "'FR'")
    ),
    "decoded_companies": with_views("enterprise code", "SELECT * FROM decoded", DECODED_SQL),
    "lookup_number": with_views(
        PROFILE_VIEWS,
        f"""
SELECT q."queryId", q.number AS "enterpriseNumber", p.name, p.status, p."contactCount" FROM (
  SELECT o_orderkey AS "queryId", CASE WHEN o_orderkey % 3 < 2
    THEN {_DOTTED.format("'0' || lpad(cast(o_custkey AS string), 9, '0')")} ELSE cast(o_custkey AS string) END AS number FROM orders) q
LEFT JOIN profile p ON p."enterpriseNumber" = q.number""",
        PROFILE_SQL,
    ),
    "lookup_vat": with_views(
        PROFILE_VIEWS,
        f"""
SELECT q."queryId", q.number AS "enterpriseNumber", p.name, p."juridicalForm", p."addressCount" FROM (
  SELECT o_orderkey AS "queryId", CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 4 <> 1
    THEN {_DOTTED.format("'0' || lpad(cast(o_custkey AS string), 9, '0')")} END AS number FROM orders) q
LEFT JOIN profile p ON p."enterpriseNumber" = q.number""",
        PROFILE_SQL,
    ),
    "lookup_name": with_views(
        PROFILE_VIEWS,
        """
SELECT q."queryId", q.asked, h.hit AS "enterpriseNumber", p.name, p.status
FROM queries q LEFT JOIN hit h ON h.txt = lower(trim(q.asked)) LEFT JOIN profile p ON p."enterpriseNumber" = h.hit""",
        PROFILE_SQL
        + """, queries AS (
  SELECT o_orderkey AS "queryId", CASE o_orderkey % 5 WHEN 0 THEN ' sa customer#' || lpad(cast(o_custkey AS string), 9, '0') || ' '
    WHEN 1 THEN '#' || lpad(cast(o_custkey AS string), 9, '0') || ' l'
    WHEN 2 THEN 'MER#' || lpad(cast(o_custkey // 10 AS string), 8, '0')
    WHEN 3 THEN cast(o_custkey AS string) ELSE 'x%' || o_custkey END AS asked FROM orders),
asked AS (SELECT DISTINCT lower(trim(asked)) AS txt FROM queries),
exact AS (SELECT txt, min("enterpriseId") AS hit FROM asked JOIN denomination ON lower(denomination) = txt GROUP BY 1),
part AS (SELECT txt, min("enterpriseId") AS hit FROM asked JOIN denomination ON contains(lower(denomination), txt) GROUP BY 1),
hit AS (SELECT txt, coalesce(e.hit, p.hit) AS hit FROM asked LEFT JOIN exact e USING (txt) LEFT JOIN part p USING (txt))""",
    ),
    "number_formats": f"""
SELECT "queryId", CASE WHEN length(digits) = 10 THEN {_DOTTED.format("digits")} ELSE raw END AS dotted,
  CASE WHEN length(digits) = 9 THEN '0' || digits WHEN length(digits) = 10 AND digits[1] IN ('0', '1') THEN digits END AS vat,
  CASE WHEN length(digits) = 9 THEN {_DOTTED.format("'0' || digits")}
    WHEN length(digits) = 10 AND digits[1] IN ('0', '1') THEN {_DOTTED.format("digits")} END AS "dottedVat"
FROM ({_FORMATS})""",
    "entity_routing": with_views(
        "activity_raw",
        """
SELECT CASE WHEN regexp_matches("entityNumber", '^[0-9]{4}[.][0-9]{3}[.][0-9]{3}$') THEN 'Enterprise'
    WHEN "entityNumber" LIKE '9.%' THEN 'Branch' WHEN "entityNumber" LIKE '2.%' THEN 'Establishment' ELSE 'Unknown' END AS kind,
  "naceVersion", count(*) AS n, min("entityNumber") AS first, max("entityNumber") AS last
FROM activity_raw GROUP BY 1, 2""",
    ),
}
ORACLE["lookup_name_scan"] = ORACLE["lookup_name"]
ORACLE["company_profile_bucketed"] = ORACLE["company_profile"]
