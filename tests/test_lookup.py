import random

import pytest
from pyspark.sql import functions as F

from firmatlas.operators.keyed import dealt, task_count
from firmatlas.plans import lookup
from firmatlas.plans import name_index
from firmatlas.plans.lookup import asked_texts, resolve_names
from firmatlas.sources.snapshots import COMPANY_TABLES, company_tables, write_company_tables

NAMES = "denomination string, enterpriseId string"


@pytest.fixture(scope="module")
def tables(spark):
    def make(schema, *data):
        return spark.createDataFrame(list(data), schema)

    return {
        "Enterprise": make(
            "enterpriseNumber string, KBOstatusCode string, juridicalSituationCode string, juridicalFormCode string, juridicalFormCACCode string, startDate timestamp_ntz",
            ("0123.456.789", "AC", "000", None, None, None), ("0200.000.001", "AC", "001", "F", None, None),
        ),
        "Code": make(
            "category string, code string, description string",
            ("Status", "AC", "Actief"), ("ContactType", "EMAIL", "E-mail"), ("JuridicalForm", "F", "NV"),
        ),
        "KBOAddress": make(
            "typeOfAddressCode string, streetNL string, streetFR string, houseNumber string, zipcode string, municipalityNL string, municipalityFR string, countryNL string, countryFR string, enterpriseId string",
            ("REGO", None, "Rue", "1", "1000", None, None, None, None, "0123.456.789"),
            ("BAET", "Straat", "Rue", None, None, "Gent", "Gand", "Nederland", None, "0123.456.789"),
        ),
        "KBOContact": make(
            "entityContactCode string, conctactTypeCode string, value string, enterpriseId string",
            ("ENT", "WEB", "a.example", "0123.456.789"), ("ENT", "EMAIL", "a@a.example", "0123.456.789"),
        ),
        "Denomination": make(
            "languageCode string, typeOfDenominationCode string, denomination string, enterpriseId string",
            ("FR", "001", "Acme SA", "0123.456.789"), ("NL", "003", "Acme", "0123.456.789"),
            ("FR", "002", "Beta Deux", "0200.000.001"), ("EN", "001", "Beta", "0200.000.001"),
            ("NL", "001", "Unit", None),
        ),
    }


def test_profile(tables):
    rows = {r["enterpriseNumber"]: r for r in lookup.profiles(tables).collect()}
    acme, beta = rows["0123.456.789"], rows["0200.000.001"]
    assert acme["name"] == "Acme" and acme["status"] == "Actief" and acme["juridicalForm"] is None
    assert [tuple(a) for a in acme["addresses"]] == [
        ("Straat", "", "", "Gent", "Nederland"),
        ("Rue", "1", "1000", "", "BE"),
    ]
    assert [tuple(c) for c in acme["contacts"]] == [("E-mail", "a@a.example"), ("", "a.example")]
    # No Dutch name: the first by type, whatever the language.
    assert beta["name"] == "Beta" and beta["addresses"] == [] and beta["contacts"] == []


def test_profiles_of_bucketed_tables_do_not_shuffle(spark, tables, rows):
    """Only code lists are broadcast; the four company tables are joined and grouped where they lie."""
    many = [(f"0{i:09d}", "AC") for i in range(3000)]
    wide = {
        **tables,
        "Enterprise": rows("enterpriseNumber string, KBOstatusCode string", *many).selectExpr("*", "'000' as juridicalSituationCode", "null as juridicalFormCode", "'F' as juridicalFormCACCode", "timestamp_ntz'2020-01-02 00:00:00' as startDate"),
        "Denomination": rows("enterpriseId string, denomination string", *[(n, f"Name {n}") for n, _ in many], (None, "Unit")).selectExpr("*", "'NL' as languageCode", "'001' as typeOfDenominationCode"),
    }
    write_company_tables(wide, "shuffled", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stored = company_tables(spark, "shuffled", wide)
        found = lookup.profiles({**stored, "Code": spark.createDataFrame(tables["Code"].collect(), tables["Code"].schema).hint("broadcast")})
        plan = found._jdf.queryExecution().executedPlan().toString()
        shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "enterprise" in line.lower()]
        assert not shuffles and "Bucketed: true" in plan
        got = {r["enterpriseNumber"]: r for r in found.collect()}
        assert len(got) == 3000 and got["0000000007"]["name"] == "Name 0000000007" and got["0000000007"]["juridicalForm"] == "NV"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        for name in COMPANY_TABLES:
            spark.sql(f"drop table shuffled_{name.lower()}")


def test_numbers_and_vats(rows, tables):
    asked = rows("number string", ("0123 456 789",), ("0123.456.789",), ("9",))
    found = lookup.lookup_numbers(asked, tables).orderBy("number").collect()
    assert [r["name"] for r in found] == ["Acme", "Acme", None]
    vats = rows("country string, vat string", ("be", "BE123456789"), ("NL", "123456789"), ("BE", "3"))
    assert sorted((r["country"], r["name"]) for r in lookup.lookup_vats(vats, tables).collect() if r["name"]) == [("be", "Acme")]


def test_names(rows, tables):
    asked = rows("name string", (" acme ",), ("ACME S",), ("eta",), ("%",), ("",), ("unit",))
    found = {r["q"]: r["enterpriseNumber"] for r in lookup.lookup_names(asked.withColumnRenamed("name", "q"), tables, "q").collect()}
    assert found == {
        " acme ": "0123.456.789", "ACME S": "0123.456.789", "eta": "0200.000.001", "%": None, "": None, "unit": None,
    }


def test_substring_search_against_brute_force(rows, tmp_path):
    """Random names over a tiny alphabet, a third of them the same, both ways of the search."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abC ") for _ in range(n)).strip() or "a"
    names = [(word(rng.randint(1, 9)), f"{i:04d}") for i in range(200)]
    names += [("hot name", f"{i:04d}") for i in range(200, 300)]
    queries = [word(rng.randint(1, 5)) for _ in range(120)] + ["hot", "t n", "zzz", "HOT NAME"]
    asked = asked_texts(rows("name string", *[(q,) for q in queries]))
    found = resolve_names(asked, rows(NAMES, *names))
    result = {r["text"]: r["enterpriseNumber"] for r in found.collect()}
    index = str(tmp_path / "index")
    name_index.write_index(rows(NAMES, *names, (None, "9999"), ("Unit", None), ("", "0000")), index)
    assert {r["text"]: r["enterpriseNumber"] for r in name_index.resolve(asked, index).collect()} == result
    for query in queries:
        text = query.strip().lower()
        exact = [n for name, n in names if name.lower() == text]
        part = [n for name, n in names if text in name.lower()]
        assert result[text] == min(exact or part, default=None), query


def test_places_of_names_are_not_broadcast(spark, rows, tmp_path):
    """Exploded places were taken for as small as the names and sent through the driver."""
    rows(NAMES, *[(f"Company {i:05d} Gent", f"{i:06d}") for i in range(300)]).write.parquet(str(tmp_path / "names"))
    asked = rows("name string", *[(f"{i:05d} g" if i < 300 else f"{i * 7919 % 10007:05d}{i:05d} unknown",) for i in range(6000)])
    asked.write.parquet(str(tmp_path / "asked"))
    found = resolve_names(asked_texts(spark.read.parquet(str(tmp_path / "asked"))), spark.read.parquet(str(tmp_path / "names")))
    result = {r["text"]: r["enterpriseNumber"] for r in found.collect() if r["enterpriseNumber"]}
    assert result == {f"{i:05d} g": f"{i:06d}" for i in range(300)}
    assert "BuildLeft" not in found._jdf.queryExecution().executedPlan().toString()


def test_rows_without_a_company_are_not_dealt_to_one_task(spark, rows, tables):
    asked = rows("country string, vat string", *[("NL", str(i)) for i in range(400)], ("BE", "123456789"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = lookup.lookup_vats(asked, tables)
        held = [n for n in found.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(held) > 1 and sum(held) == 401 and max(held) < 300
    assert [c for c in found.columns[:4]] == ["enterpriseNumber", "country", "vat", "name"]


def test_the_number_of_tasks_grows_with_the_input(spark, tmp_path):
    spark.range(200_000).write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert task_count(stored, 1 << 40) == least < task_count(stored, 10_000)
    assert dealt(stored, "id", tasks=7).filter("id < 3").count() == 3
    # A source of unknown size.
    assert task_count(spark.createDataFrame([(1,)], "id long"), 1) == least


def test_the_index_reads_only_postings_of_asked_pieces(spark, rows, tmp_path):
    index = str(tmp_path)
    names = [(f"Company {i:05d} Gent", f"{i:06d}") for i in range(2000)] + [("ÉCLAIR Zürich İ", "9")]
    name_index.write_index(rows(NAMES, *names), index)
    ask = lambda *texts: name_index.resolve(asked_texts(rows("name string", *[(t,) for t in texts])), index)
    one = ask("y 01234 g")
    assert [tuple(r) for r in one.collect()] == [("y 01234 g", "001234")]
    # The folders that the plan opens: that of the rarest piece.
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and len(set(f.split("part=")[1].split("/")[0] for f in one.inputFiles() if "part=" in f)) >= 1
    found = {r["text"]: r["enterpriseNumber"] for r in ask("gent", "zür", "éclair z", "ÿÿÿÿ", "company", "7 g", "00", "0", "x").collect()}
    assert found == {"gent": "000000", "zür": "9", "éclair z": "9", "ÿÿÿÿ": None, "company": "000000", "7 g": "000007", "00": "000000", "0": "000000", "x": None}
    wanted = name_index.rarest_pieces(asked_texts(rows("name string", ("company 01999 gent",))), name_index._grams(spark, index)).first()
    assert wanted["gram"] in ("199", "019", "999", "01 "[:3]) and name_index.resolve(asked_texts(rows("name string", ("",))), index).count() == 0


def test_an_empty_index(spark, rows, tmp_path):
    name_index.write_index(rows(NAMES), str(tmp_path))
    asked = asked_texts(rows("name string", ("abcd",), ("ab",)))
    assert {tuple(r) for r in name_index.resolve(asked, str(tmp_path)).collect()} == {("abcd", None), ("ab", None)}


def test_a_larger_index_is_built_by_more_tasks(spark, rows, tmp_path, monkeypatch):
    """A piece that every name holds is written by several tasks, each with its own names."""
    names = [(f"Company {i:05d}", f"{i:06d}") for i in range(3000)]
    rows(NAMES, *names).write.parquet(str(tmp_path / "names"))
    monkeypatch.setattr(name_index, "NAME_BYTES", 2000)
    monkeypatch.setattr(name_index, "PARTS", 2)
    index = str(tmp_path / "index")
    name_index.write_index(spark.read.parquet(str(tmp_path / "names")), index)
    held = name_index.postings(spark, index).filter("gram = 'omp'")
    assert held.count() == 3000 and held.select(F.input_file_name()).distinct().count() > 1
    twice = name_index.postings(spark, index).filter("gram = '000' and text = 'company 00000'").collect()
    assert [r["ats"] for r in twice] == [[9, 10, 11]]
    asked = asked_texts(rows("name string", ("pany 00017",)))
    assert [r["enterpriseNumber"] for r in name_index.resolve(asked, index).collect()] == ["000017"]
