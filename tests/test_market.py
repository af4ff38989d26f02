import itertools

import pytest

from firmatlas.plans import code_bitmaps, market
from firmatlas.sources.snapshots import write_catalog

ACTIVITY = "entityNumber string, naceVersion string, naceCode string, classification string, enterpriseId string, establishmentId string"


@pytest.fixture(scope="module")
def tables(spark):
    def make(schema, *data):
        return spark.createDataFrame(list(data), schema)

    return {
        "Activity": make(
            ACTIVITY,
            ("a", "2008", "62010", "MAIN", "0001", None),
            ("a", "2008", "62020", "SECO", "0001", None),
            ("b", "2025", "6201", "MAIN", "0002", None),
            ("u1", "2008", "6201", "SECO", None, "2.1"),
            ("u2", "2008", "6201", "MAIN", None, "2.2"),
            ("u3", "2008", "6201", "MAIN", None, "2.3"),
            ("u4", "2008", "6201", "MAIN", None, "2.404"),
            ("x", "2008", "6_%", "MAIN", "0007", None),
            ("br", "2008", "6201", "MAIN", None, None),
        ),
        "Establishment": make(
            "establishmentNumber string, enterpriseNumber string",
            ("2.1", "0001"), ("2.2", "0003"), ("2.3", None),
        ),
        "Enterprise": make(
            "enterpriseNumber string, KBOstatusCode string, juridicalSituationCode string, juridicalFormCode string, juridicalFormCACCode string, startDate timestamp_ntz",
            ("0001", "AC", "000", None, "F1", None), ("0002", "XX", "000", "F1", "F2", None),
        ),
        "Code": make(
            "category string, code string, description string",
            ("Status", "AC", "Actief"), ("JuridicalForm", "F1", "NV"), ("JuridicalForm", "F2", "BV"),
            ("JuridicalSituation", "000", "Normaal"),
        ),
        "KBOAddress": make(
            "typeOfAddressCode string, zipcode string, municipalityNL string, municipalityFR string, enterpriseId string",
            ("REGO", "1000", None, "Bruxelles", "0001"), ("BAET", "2000", "Antwerpen", None, "0001"),
            ("BAET", "3000", "Leuven", None, "0002"), ("REGO", "", "Gent", None, "0003"),
        ),
        "Denomination": make(
            "languageCode string, typeOfDenominationCode string, denomination string, enterpriseId string",
            ("FR", "001", "Nom", "0001"), ("NL", "002", "Handel", "0001"), ("NL", "001", "Naam", "0001"),
            ("EN", "001", "Name", "0002"),
        ),
    }


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_hits_join_own_and_establishment_activities(tables):
    hits = {r[0] for r in market.hits_of(tables, "62", "2008").collect()}
    # A null owner stays a hit, a company that is not registered too; unknown units do not.
    assert hits == {"0001", "0003", None}


def test_prefix_is_literal(tables):
    assert {r[0] for r in market.hits_of(tables, "6_").collect()} == {"0007"}
    assert {r[0] for r in market.hits_of(tables, "%").collect()} == set()


@pytest.mark.parametrize("version, classification", list(itertools.product([None, " ", "2008", "2025"], [None, "MAIN", "SECO"])))
def test_optional_filters(tables, version, classification):
    rows = [r.asDict() for r in tables["Activity"].collect()]
    owners = {r["establishmentNumber"]: r["enterpriseNumber"] for r in tables["Establishment"].collect()}
    expected = set()
    for r in rows:
        if not r["naceCode"].startswith("62"):
            continue
        if (version or "").strip() and r["naceVersion"] != version:
            continue
        if classification and r["classification"] != classification:
            continue
        if r["enterpriseId"]:
            expected.add(r["enterpriseId"])
        if r["establishmentId"] in owners:
            expected.add(owners[r["establishmentId"]])
    hits = {r[0] for r in market.hits_of(tables, "62", version, classification).collect()}
    assert hits == expected


def test_blank_code_gives_nothing(tables):
    assert market.postal_counts(tables, "  ").count() == 0
    assert market.companies_by_nace(tables, "  ").count() == 0
    assert market.companies_by_nace_postal(tables, "62", " ").count() == 0


def test_postal_counts(tables):
    counts = market.postal_counts(tables, "62")
    assert values(counts, "postalCode", "enterpriseCount") == [("1000", 1), ("Unknown", 3)]


def test_pages_by_last_number_and_total(tables):
    numbers = [r["enterpriseNumber"] for r in market.companies_by_nace(tables, "62", limit=10).collect()]
    paged, after = [], None
    while part := [r["enterpriseNumber"] for r in market.companies_by_nace(tables, "62", limit=1, after=after).collect()]:
        paged += part
        after = part[-1]
    assert paged == numbers
    assert market.companies_by_nace(tables, "62", offset=1000).count() == 0
    total = market.companies_by_nace(tables, "62", limit=1).first()["total"]
    assert market.nace_total(tables, "62").first()["total"] == total
    assert market.nace_total(tables, " ").first()["total"] == 0


def test_page(tables):
    page = market.companies_by_nace(tables, "62", limit=10)
    assert values(page, "enterpriseNumber", "name", "city", "status", "juridicalForm", "total") == [
        ("0001", "Naam", "Bruxelles", "Actief", "NV", 4),
        ("0002", "Name", "Leuven", None, "NV", 4),
    ]
    assert page.first()["naceCodes"] == ["62"] and page.first()["classifications"] == []
    assert values(market.companies_by_nace(tables, "62", limit=0), "enterpriseNumber") == [("0001",)]
    assert values(market.companies_by_nace(tables, "62", limit=1, offset=1), "enterpriseNumber") == [("0002",)]


def test_postal_companies(tables):
    found = market.companies_by_nace_postal(tables, "62", "1000")
    assert values(found, "enterpriseNumber", "name", "postalCode", "juridicalSituation") == [
        ("0001", "Naam", "1000", "Normaal")
    ]


def test_pivot_orders_and_shares(rows):
    counts = rows("postalCode string, enterpriseCount long", ("1000", 2), ("2000", 5), ("3000", 2), ("Unknown", 1))

    def codes(**options):
        return [r["postalCode"] for r in market.postal_pivot(counts, **options).collect()]

    assert codes() == ["2000", "1000", "3000"]
    assert codes(sort="count-asc") == ["1000", "3000", "2000"]
    assert codes(sort="code-desc") == ["3000", "2000", "1000"]
    assert codes(min_count=3) == ["2000"]
    assert codes(term=" 10") == ["1000"]
    assert market.postal_pivot(counts).first()["sharePercent"] == 50.0


def test_kpis(rows):
    counts = rows("postalCode string, enterpriseCount long", ("3000", 4), ("2000", 4), ("Unknown", 2))
    row = market.market_kpis(counts).first()
    assert tuple(row) == (10, 2, 8, 2, "2000", 4, 40.0)
    empty = market.market_kpis(counts.limit(0)).first()
    assert tuple(empty) == (0, 0, 0, 0, None, None, 0.0)


def test_name_order_ignores_case_and_accents(rows):
    companies = rows("name string, enterpriseNumber string", ("émile", "3"), ("Zeta", "2"), ("Emil", "1"), ("alfa", "4"))
    ordered = market.filter_companies(companies, descending=False)
    assert values(ordered, "name") == [("alfa",), ("Emil",), ("émile",), ("Zeta",)]
    assert values(market.filter_companies(companies, "ZETA 2"), "name") == [("Zeta",)]


def test_catalog_search(rows):
    raw = rows(
        "Category string, Code string, Language string, Description string",
        ("Nace2008", "62010", "NL", "Ontwerpen van software"), ("Nace2008", "62010", "FR", "Programmation"),
        ("Nace2025", "62010", "NL", "Ontwerp"), ("Status", "AC", "NL", "Actief"), ("Nace2008", "01110", "NL", "Teelt van graan"),
    )
    catalog = market.nace_catalog(raw)
    assert catalog.count() == 3
    found = lambda term: values(market.search_nace(catalog, "2008", term), "code")
    assert found("62") == [("62010",)]
    assert found("GRANEN") == []
    assert found("graanen") == [("01110",)]
    assert found("") == [("01110",), ("62010",)]


def test_prefix_reaches_the_scan(spark, tables, tmp_path):
    path = str(tmp_path / "activity")
    tables["Activity"].write.partitionBy("naceVersion").parquet(path)
    stored = {**tables, "Activity": spark.read.parquet(path)}
    plan = market.hits_of(stored, "62", "2008")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(naceCode,62)" in plan
    assert "PartitionFilters: [isnotnull(naceVersion" in plan


def test_catalog_search_reads_one_version(spark, rows, tmp_path):
    catalog = rows("version string, code string, description string", ("2008", "1", "a"), ("2025", "1", "b"))
    write_catalog(catalog, str(tmp_path / "catalog"))
    stored = spark.read.schema(catalog.schema).parquet(str(tmp_path / "catalog"))
    found = market.search_nace(stored, "2025", "1")
    assert [r["description"] for r in found.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(version" in found._jdf.queryExecution().executedPlan().toString()


def test_bitmaps_of_short_prefixes_and_rows_of_longer_ones(spark, tables, tmp_path):
    path = str(tmp_path / "bitmaps")
    tables = {**tables, "Establishment": tables["Establishment"].filter("enterpriseNumber IS NOT NULL")}
    code_bitmaps.write_bitmaps(tables, path)
    for asked in [("6",), ("62", "2008"), (" 620", None, "SECO"), ("6201", "2008", "MAIN"), ("6_", "2008"), ("6_%",), ("x",), (" ",)]:
        found = values(code_bitmaps.postal_counts(spark, path, *asked), "postalCode", "enterpriseCount")
        assert found == values(market.postal_counts(tables, *asked), "postalCode", "enterpriseCount"), asked
    # A bitmap of 4 KB for every code and 32,768 companies would grow with their product.
    assert {len(r["prefix"]) for r in spark.read.parquet(f"{path}/prefixes").collect()} == {1, 2}
    assert not [f.name for f in spark.read.parquet(f"{path}/rows").schema if f.dataType.typeName() == "binary"]
