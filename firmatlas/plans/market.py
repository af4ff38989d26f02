"""Market questions: companies by activity code, by postal code, and the activity catalogue."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmatlas.operators import ranges
from firmatlas.operators.registry import (
    NUMBER,
    clean,
    decode_companies,
    nace_hits,
    preferred_names,
    registered_offices,
)
from firmatlas.schemas import REGISTERED_OFFICE, UNKNOWN_POSTAL_CODE

# Page and catalogue sizes.
DEFAULT_PAGE = 50
LARGEST_PAGE = 500
CATALOG_ROWS = 100

Tables = Mapping[str, DataFrame]


def hits_of(
    tables: Tables, code: str, version: str | None = None, classification: str | None = None
) -> DataFrame:
    return nace_hits(tables["Activity"], tables["Establishment"], code, version, classification)


def postal_counts(
    tables: Tables, code: str, version: str | None = None, classification: str | None = None
) -> DataFrame:
    """Distinct companies per registered-office postal code; blank or missing is ``Unknown``."""
    office = registered_offices(tables["KBOAddress"]).select(
        F.col("enterpriseId").alias(NUMBER), "zipcode"
    )
    postal = F.coalesce(F.nullif("zipcode", F.lit("")), F.lit(UNKNOWN_POSTAL_CODE))
    return (
        hits_of(tables, code, version, classification)
        .join(office, NUMBER, "left")
        .groupBy(postal.alias("postalCode"))
        .agg(F.count("*").alias("enterpriseCount"))
        .orderBy("postalCode")
    )


def companies_by_nace(
    tables: Tables,
    code: str,
    version: str | None = None,
    classification: str | None = None,
    limit: int = DEFAULT_PAGE,
    offset: int = 0,
    after: str | None = None,
) -> DataFrame:
    """One page of companies ordered by number, each row with the total number of hits.

    ``limit`` is held between 1 and ``LARGEST_PAGE``. ``offset`` is held in memory by every task,
    so deep pages are read with ``after``, the last number of the page before, or by number with
    ``stored_page``; the cost of these does not grow. A page past the end has no rows; its total comes from
    ``nace_total``. The page is cut from the bare numbers first. It holds at most ``LARGEST_PAGE`` rows, so it
    may be broadcast against the wide tables, which are then reduced during their scan.
    """
    limit = min(max(limit, 1), LARGEST_PAGE)
    hits = hits_of(tables, code, version, classification)
    total = hits.agg(F.count("*").alias("total"))
    rest = hits if after is None else hits.filter(F.col(NUMBER) > after)
    page = rest.orderBy(F.asc_nulls_last(NUMBER)).offset(max(offset, 0)).limit(limit)
    return _page_rows(tables, page, total.scalar(), code, classification)


def _page_rows(tables: Tables, page: DataFrame, total: Column, code: str, classification: str | None) -> DataFrame:
    enterprise = tables["Enterprise"].join(F.broadcast(page), NUMBER, "left_semi")
    names = preferred_names(_of_page(tables["Denomination"], page))
    cities = _cities(_of_page(tables["KBOAddress"], page))
    code_text, class_text = clean(code), clean(classification)
    classes = F.array(F.lit(class_text)) if class_text else F.array().cast("array<string>")
    return (
        decode_companies(enterprise, tables["Code"])
        .join(F.broadcast(names), NUMBER, "left")
        .join(F.broadcast(cities), NUMBER, "left")
        .select(
            NUMBER,
            F.coalesce("name", F.lit("")).alias("name"),
            *[
                F.nullif(c, F.lit("")).alias(c)
                for c in ("city", "status", "juridicalSituation", "startDate", "juridicalForm")
            ],
            F.array(F.lit(code_text)).alias("naceCodes"),
            classes.alias("classifications"),
            total.alias("total"),
        )
        .orderBy(NUMBER)
    )


def store_pages(
    tables: Tables, folder: str, code: str, version: str | None = None, classification: str | None = None
) -> None:
    """Store the hits of a code prefix for ``stored_page``: bare numbers, in ranges."""
    ranges.store_ranges(hits_of(tables, code, version, classification), [F.col(NUMBER).asc_nulls_last()], folder)


def stored_page(
    tables: Tables, folder: str, code: str, classification: str | None = None, limit: int = DEFAULT_PAGE, offset: int = 0
) -> DataFrame:
    """The same page as ``companies_by_nace`` gives, at any depth, out of stored hits.

    Only the ranges that the page lies in are read, and no task holds what comes before it.
    """
    spark = tables["Enterprise"].sparkSession
    limit = min(max(limit, 1), LARGEST_PAGE)
    page = ranges.page(spark, folder, max(offset, 0), limit).select(NUMBER)
    return _page_rows(tables, page, F.lit(ranges.total(spark, folder)).cast("long"), code, classification)


def nace_total(
    tables: Tables, code: str, version: str | None = None, classification: str | None = None
) -> DataFrame:
    """One row with the total number of companies that the pages of a code prefix share."""
    return hits_of(tables, code, version, classification).agg(F.count("*").alias("total"))


def _of_page(df: DataFrame, page: DataFrame) -> DataFrame:
    keys = page.select(F.col(NUMBER).alias("enterpriseId"))
    return df.join(F.broadcast(keys), "enterpriseId", "left_semi")


def _cities(address: DataFrame) -> DataFrame:
    """City of the registered office, else of the lowest address type."""
    order = F.struct(F.col("typeOfAddressCode") != REGISTERED_OFFICE, "typeOfAddressCode")
    city = F.coalesce("municipalityNL", "municipalityFR")
    return address.groupBy(F.col("enterpriseId").alias(NUMBER)).agg(
        F.min_by(city, order).alias("city")
    )


def companies_by_nace_postal(
    tables: Tables,
    code: str,
    postal_code: str,
    version: str | None = None,
    classification: str | None = None,
) -> DataFrame:
    """All companies of a code prefix whose registered office is in one postal code."""
    postal = clean(postal_code)
    hits = hits_of(tables, code if postal else "", version, classification)
    office = registered_offices(tables["KBOAddress"]).filter(F.col("zipcode") == (postal or ""))
    wanted = hits.join(office.select(F.col("enterpriseId").alias(NUMBER)), NUMBER)
    companies = decode_companies(tables["Enterprise"].join(wanted, NUMBER), tables["Code"])
    return (
        companies.join(preferred_names(tables["Denomination"]), NUMBER, "left")
        .select(
            NUMBER,
            F.coalesce("name", F.lit("")).alias("name"),
            F.lit(postal or "").alias("postalCode"),
            "status",
            "juridicalSituation",
            "startDate",
            "juridicalForm",
        )
        .orderBy(NUMBER)
    )


def filter_companies(companies: DataFrame, term: str = "", descending: bool | None = None) -> DataFrame:
    """Companies whose ``name number`` contains the term; optionally in Dutch name order."""
    text = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), NUMBER))
    found = companies.filter(F.contains(text, F.lit(term.strip().lower())))
    if descending is None:
        return found
    return found.orderBy(*name_order(descending))


def name_order(descending: bool = False) -> list[Column]:
    """Dutch name order, without regard to case and accents; companies of one name by number."""
    name = F.collate(F.coalesce("name", F.lit("")), "nl_CI_AI")
    return [name.desc() if descending else name.asc(), F.col(NUMBER).asc()]


def _share(count: Column, total: Column) -> Column:
    return F.coalesce(count / F.nullif(total, F.lit(0)), F.lit(0.0)) * F.lit(100.0)


# Sort modes of the postal pivot.
POSTAL_ORDERS = {
    "count-desc": [F.desc, F.asc],
    "count-asc": [F.asc, F.asc],
    "code-asc": [None, F.asc],
    "code-desc": [None, F.desc],
}


def postal_pivot(
    counts: DataFrame, min_count: int = 1, term: str = "", sort: str = "count-desc"
) -> DataFrame:
    """Known postal codes with their share of all companies (unknown ones included below the line)."""
    total = counts.agg(F.sum("enterpriseCount")).scalar()
    by_count, by_code = POSTAL_ORDERS.get(sort, POSTAL_ORDERS["count-desc"])
    order = ([by_count("enterpriseCount")] if by_count else []) + [by_code("postalCode")]
    return (
        counts.withColumn("sharePercent", _share(F.col("enterpriseCount"), total))
        .filter(F.col("postalCode") != UNKNOWN_POSTAL_CODE)
        .filter(F.col("enterpriseCount") >= max(1, min_count))
        .filter(F.contains(F.lower("postalCode"), F.lit(term.strip().lower())))
        .orderBy(*order)
    )


def market_kpis(counts: DataFrame) -> DataFrame:
    """Total, mapped and missing companies, number of markets and the largest one."""
    known = F.col("postalCode") != UNKNOWN_POSTAL_CODE
    size = F.col("enterpriseCount")
    rank = F.when(known, F.struct(-size, F.col("postalCode")))
    totals = counts.agg(
        F.coalesce(F.sum(size), F.lit(0)).alias("total"),
        F.count_if(known).alias("postalMarkets"),
        F.coalesce(F.sum(F.when(known, size)), F.lit(0)).alias("mappedTotal"),
        F.coalesce(F.sum(F.when(~known, size)), F.lit(0)).alias("missing"),
        F.min(rank).alias("largest"),
    )
    largest_count = -F.col("largest")[F.lit("col1")]
    return totals.select(
        "total",
        "postalMarkets",
        "mappedTotal",
        "missing",
        F.col("largest")["postalCode"].alias("largestPostalCode"),
        largest_count.alias("largestCount"),
        _share(F.coalesce(largest_count, F.lit(0)), F.col("total")).alias("largestSharePercent"),
    )


def nace_catalog(code_rows: DataFrame) -> DataFrame:
    """Dutch activity codes with their version, from the raw code extract."""
    version = F.regexp_extract("Category", "^Nace(2003|2008|2025)$", 1)
    return (
        code_rows.filter(F.col("Language") == "NL")
        .select(version.alias("version"), F.col("Code").alias("code"), F.col("Description").alias("description"))
        .filter(F.col("version") != "")
    )


def search_nace(catalog: DataFrame, version: str, term: str = "", limit: int = CATALOG_ROWS) -> DataFrame:
    """Codes that start with the term or whose description contains it.

    A term ending in ``en`` is also tried without that ending.
    """
    term = term.strip().lower()
    rows = catalog.filter(F.col("version") == version)
    if term:
        terms = [term, term[:-2]] if term.endswith("en") else [term]
        found = F.lit(False)
        for text in terms:
            found |= F.col("code").startswith(text) | F.contains(
                F.lower("description"), F.lit(text)
            )
        rows = rows.filter(found)
    return rows.orderBy("code", "description").limit(limit)
