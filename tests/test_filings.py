import json

import pytest

from firmatlas.checks.filings import insurer_texts
from firmatlas.operators.filings import latest_per_year, recent_filings, requested_filings, requested_years
from firmatlas.operators.rubrics import filing_measures
from firmatlas.operators.text_rubrics import INSURER_LABELS, text_rubrics
from firmatlas.plans import measure_store
from firmatlas.plans.financials import company_history, published_financials
from firmatlas.sources import testviews
from firmatlas.sources.csv_files import EXPORT_NAME, EXPORT_REFERENCE, read_rubric_exports
from firmatlas.sources.payloads import (
    accounting_rubrics,
    deposit_rows,
    export_headers,
    export_rubrics,
    read_payloads,
    read_texts,
    reference_rows,
)

RUBRIC = "filing_id string, pos int, code string, value string, period string"
REF = "enterpriseNumber string, filing_id string, referenceNumber string, depositDate string, fiscalYear int, enterpriseName string, importFileType string, pos int"


@pytest.fixture
def measured(rows):
    def measure(*lines):
        data = [("f", i, code, value, period) for i, (code, value, period) in enumerate(lines)]
        return filing_measures(rows(RUBRIC, *data), ["filing_id"]).first()

    return measure


def test_direct_codes(measured):
    row = measured(("70", "1000000", "N"), ("9904", "120000", "N"))
    assert (row["revenue"], row["netResult"], row["marginPercent"], row["employeeCount"]) == (1e6, 120000, 12, None)


def test_aggregate_line_comes_first(measured):
    row = measured(("70", "1000000", "N"), ("70/76A", "225353586.48", "N"), ("9904", "-2628674.22", "N"))
    assert (row["revenue"], row["netResult"], row["marginPercent"]) == (225353586.48, -2628674.22, -1.17)


def test_direct_code_beats_parts_and_parts_add_up(measured):
    assert measured(("70", "1000000", "N"), ("72", "200000", "N"), ("76A", "50000", "N"))["revenue"] == 1e6
    assert measured(("72", "200000", "N"), ("76A", "50000", "N"))["revenue"] == 250000
    assert measured(("9904", "1", "N"))["revenue"] is None


def test_employees_are_rounded(measured):
    assert measured(("1003", "1141.9", "N"))["employeeCount"] == 1141.9
    assert measured(("9146", "2,25", None))["employeeCount"] == 2.3


def test_only_the_first_current_line_of_a_code_counts(measured):
    row = measured(("9904", "7", "NM1"), ("9904", "n/a", "N"), ("9904", "5", "N"), ("990", "3", ""))
    assert row["netResult"] == 3 and row["lineCount"] == 4
    row = measured(("20/58", "1", "NM1"))
    assert row["totalAssets"] is None and row["lineCount"] == 1


def test_insurer_figures_stand_in(measured):
    row = measured(("INS_EQUITY", "5", "N"), ("INS_NET_RESULT", "-2", "N"), ("70", "10", "N"), ("INS_RECEIVABLES", "4", "N"))
    assert (row["equity"], row["netResult"], row["marginPercent"], row["insuranceReceivables"]) == (5, -2, -20, 4)
    assert measured(("INS_EQUITY", "5", "N"), ("10/15", "6", "N"))["equity"] == 6


def test_hot_filing_in_many_partitions(spark):
    lines = spark.range(0, 30000, 1, 8).selectExpr(
        "if(id % 3 = 0, 'hot', cast(id as string)) as filing_id", "cast(30000 - id as int) as pos",
        "if(id % 2 = 0, '70', '9904') as code", "cast(id as string) as value", "'N' as period",
    )
    row = filing_measures(lines, ["filing_id"]).filter("filing_id = 'hot'").first()
    assert (row["revenue"], row["netResult"], row["lineCount"]) == (29994, 29997, 10000)


@pytest.fixture
def rubrics_of(rows):
    def parse(text):
        found = text_rubrics(rows("filing_id string, text string", ("f", text))).orderBy("pos").collect()
        assert [r["pos"] for r in found] == list(range(len(found)))
        return [(r["code"], r["value"]) for r in found]

    return parse


def test_coded_lines(rubrics_of):
    text = "20/58 1.250.000 1.000.000\n10/15 450.000 400.000\r\n9904 ( 12.500 ) 10.000"
    assert rubrics_of(text) == [("20/58", "1250000"), ("10/15", "450000"), ("9904", "-12500")]


@pytest.mark.parametrize(
    "line, expected",
    [
        ("70/76A 12,50 x", [("70/76A", "12.50")]),
        ("76A 5", [("76A", "5")]),
        (f"20/58{chr(0xA0)}1.000", [("20/58", "1000")]),
        ("9904 -12.500", []),
        ("7 100", []),
        ("12345 100", []),
        ("1003 FTE 5", []),
        ("20/58", []),
        ("44 ...", []),
        ("44 (5", [("44", "-5")]),
    ],
)
def test_coded_line_shapes(rubrics_of, line, expected):
    assert rubrics_of(line) == expected


def test_insurer_labels(rubrics_of):
    text = "\n".join(
        [
            "C. Beleggingen (staten nrs. 1, 2 en 3)  14.117.997.323",
            'D. Beleggingen betreffende de verrichtingen verbonden aan een beleggingsfonds van de groep van activiteiten "Leven"',
            "8.421.173.909",
            "D.'bis. Deel van de herverzekeraars in de technische voorzieningen      1.436.029.873",
            "E. Vorderingen (staten nrs. 18 en 19)   541.614.168",
            "A. Eigen vermogen (staat nr.5)  709.721.385",
            "C. Technische voorzieningen (staat nr.7)        13.785.341.889",
            'II. Voorziening voor verzekering "leven"        9.912.975.255',
            "III. Voorziening voor te betalen schaden        3.413.538.378",
            "F. Deposito's ontvangen van herverzekeraars     1.139.542.368",
            "3. Resultaat van het boekjaar   99.291.520",
        ]
    )
    assert dict(rubrics_of(text)) == {
        "INS_INVESTMENTS": "14117997323",
        "INS_UNIT_LINKED_INVESTMENTS": "8421173909",
        "INS_REINSURANCE_SHARE_TECHNICAL_PROVISIONS": "1436029873",
        "INS_RECEIVABLES": "541614168",
        "INS_EQUITY": "709721385",
        "INS_TECHNICAL_PROVISIONS": "13785341889",
        "INS_LIFE_TECHNICAL_PROVISIONS": "9912975255",
        "INS_CLAIMS_PROVISIONS": "3413538378",
        "INS_REINSURANCE_DEPOSITS": "1139542368",
        "INS_NET_RESULT": "99291520",
    }
    assert [code for code, _ in rubrics_of(text)] == list(INSURER_LABELS)


def test_row_codes_are_skipped(rubrics_of):
    text = "A. Capitaux propres\n11\n1.459.687.316\nC. Placements\n22\n60.368.360.153"
    assert rubrics_of(text) == [("INS_EQUITY", "1459687316"), ("INS_INVESTMENTS", "60368360153")]


def test_label_details(rubrics_of):
    # Blank lines do not count, capital accents match, the earliest label with an amount wins.
    assert rubrics_of("E. CRÉANCES\n\n\n1\n2\n3\n4\n\n5.000") == [("INS_RECEIVABLES", "5000")]
    assert rubrics_of("E. Créances\n1\n2\n3\n4\n5\n6.000") == []
    assert rubrics_of("E. Créances\nA. x\nE. Créances 9.000\nE. Créances 8.000") == [("INS_RECEIVABLES", "9000")]
    assert rubrics_of("E. Vorderingenx 9.000") == []


def test_years():
    assert requested_years(explicit=[2023, 2025, 2023, 1800]) == [2025, 2023]
    assert requested_years(base=2024, history=3) == [2024, 2023, 2022]
    assert len(requested_years(base=2024, history=50)) == 10
    for wrong in ({"explicit": [1]}, {"base": 3}, {}):
        with pytest.raises(ValueError):
            requested_years(**wrong)


REFERENCES = [
    {"ReferenceNumber": f"{y}-1", "DepositDate": f"{y + 1}-04-10", "ExerciseDates": {"endDate": f"{y}-12-31"}, "EnterpriseName": "Acme BV"}
    for y in range(2024, 2018, -1)
]


@pytest.mark.parametrize("wrap", [lambda r: r, lambda r: {"References": r}, lambda r: {"x": 1, "deposits": r}])
def test_references_and_recent_years(rows, wrap):
    payload = rows("enterpriseNumber string, payload string", ("0123456789", json.dumps(wrap(REFERENCES))))
    refs = reference_rows(payload)
    chosen = recent_filings(refs).orderBy("pos").collect()
    assert [r["fiscalYear"] for r in chosen] == [2024, 2023, 2022, 2021, 2020]
    assert [r["fiscalYear"] for r in recent_filings(refs, years=[2019, 2024]).orderBy("pos").collect()] == [2024, 2019]


def test_latest_deposit_per_year(rows):
    refs = rows(
        REF,
        ("1", "a", "a", None, 2020, None, None, 0), ("1", "b", "b", "2021-01-01", 2020, None, None, 1),
        ("1", "c", "c", "2021-01-01", 2020, None, None, 2), ("1", "d", "d", None, 2019, None, None, 3),
        ("1", "e", "e", None, 2019, None, None, 4),
    )
    assert sorted(r["filing_id"] for r in latest_per_year(refs).collect()) == ["b", "d"]
    assert sorted(r["filing_id"] for r in requested_filings(refs, [2020, 2018]).collect()) == ["a"]


def test_history(rows):
    refs = reference_rows(rows("enterpriseNumber string, payload string", ("0123456789", json.dumps(REFERENCES))))
    payloads = [
        ("2024-1", json.dumps({"EnterpriseName": "Acme", "Rubrics": [{"Code": "70", "Value": "1000000", "Period": "N"}, {"Code": "9904", "Value": "120000", "Period": "N"}]})),
        ("2023-1", json.dumps({"Rubrics": []})),
        ("2022-1", None),
    ]
    rubrics = accounting_rubrics(rows("referenceNumber string, payload string", *payloads))
    failures = rows("filing_id string, error string", ("2021-1", "unsupported_format"))
    history = {r["fiscalYear"]: r for r in company_history(refs, rubrics, failures=failures).collect()}
    assert len(history) == 5
    assert history[2024]["revenue"] == 1e6 and history[2024]["marginPercent"] == 12
    assert history[2024]["employeeCount"] is None and history[2024]["error"] is None
    assert [history[y]["error"] for y in (2023, 2022, 2021)] == ["no_json", "no_json", "unsupported_format"]
    assert {r["enterpriseName"] for r in history.values()} == {"Acme BV"}


def test_published_financials(rows):
    content = [
        {"id": "pdf", "reference": "r1", "periodEndDateYear": 2024, "depositDate": "2025-05-21", "enterpriseName": "Insurer", "importFileType": "PDF"},
        {"id": "csv", "reference": "r2", "periodEndDateYear": 2023, "importFileType": "xbrl"},
        {"id": "late", "reference": "r3", "periodEndDateYear": 2023},
        {"id": "lost", "reference": "r4", "periodEndDateYear": 2022},
        {"id": "text", "reference": "r5", "periodEndDateYear": 2021, "importFileType": "PDF"},
    ]
    listing = rows("enterpriseNumber string, payload string", ("0403258197", json.dumps({"content": content})), ("0000000001", "{}"))
    deposits = deposit_rows(listing)
    assert deposits.filter("filing_id is null").count() == 1
    lines = rows(RUBRIC, ("csv", 0, "Entity name", "x", "N"), ("csv", 1, "70", "10", "N"), ("late", 0, "70", "99", "N"), ("pdf", 0, "70", "5", "N"))
    texts = rows("filing_id string, text string", ("text", "70 1.000\n1003 5"), ("csv", "70 7.777"))
    for companies in (None, rows("enterpriseNumber string", ("0403258197",), ("7",))):
        found = {r["fiscalYear"]: r for r in published_financials(deposits, lines, texts, [2024, 2023, 2022, 2021], companies).collect()}
        assert {y: r["error"] for y, r in found.items()} == {2024: "unsupported_format", 2023: None, 2022: "fetch_failed", 2021: None}
        assert found[2023]["revenue"] == 10 and found[2021]["revenue"] == 1000 and found[2021]["employeeCount"] == 5
        assert {r["enterpriseName"] for r in found.values()} == {"Insurer"}


def test_file_sources(spark, tmp_path):
    (tmp_path / "f1.csv").write_text('"Entity name","Acme"\n"Reference number","2024-1"\n"70","10,5"\n\n"Entity name","Acme BV"\n"x9","1"\n', encoding="utf-8")
    raw = read_rubric_exports(spark, str(tmp_path / "*.csv"))
    numbered = raw.withColumn("pos", raw["sourceRow"])
    assert [(r["filing_id"], r["code"], r["value"]) for r in export_rubrics(numbered).collect()] == [("f1", "70", "10,5")]
    assert tuple(export_headers(numbered, EXPORT_NAME, EXPORT_REFERENCE).first()) == ("f1", "Acme BV", "2024-1")
    (tmp_path / "f2.txt").write_text("70 1.000\n", encoding="utf-8")
    assert [(r["filing_id"], r["text"]) for r in read_texts(spark, str(tmp_path / "*.txt")).collect()] == [("f2", "70 1.000\n")]
    (tmp_path / "0123456789.json").write_text(json.dumps(REFERENCES, indent=1), encoding="utf-8")
    refs = reference_rows(read_payloads(spark, str(tmp_path / "*.json"), "enterpriseNumber"))
    assert refs.count() == 6 and refs.first()["enterpriseNumber"] == "0123456789"


def test_exports_from_files_to_financials(spark, rows, tmp_path):
    (tmp_path / "full.csv").write_text('"Entity name","Acme"\n"Reference number","r1"\n"70","1000,5"\n"9904","120"\n', encoding="utf-8")
    (tmp_path / "bare.csv").write_text('"Entity name","Acme"\n"Reference number","r2"\n', encoding="utf-8")
    content = [
        {"id": "full", "reference": "r1", "periodEndDateYear": 2024, "importFileType": "XBRL"},
        {"id": "bare", "reference": "r2", "periodEndDateYear": 2023, "importFileType": "XBRL"},
        {"id": "lost", "reference": "r3", "periodEndDateYear": 2022, "importFileType": "XBRL"},
    ]
    deposits = deposit_rows(rows("enterpriseNumber string, payload string", ("0403258197", json.dumps({"content": content}))))
    exports = read_rubric_exports(spark, str(tmp_path / "*.csv"))
    found = published_financials(deposits, exports, rows("filing_id string, text string"), [2024, 2023, 2022]).collect()
    assert {r["fiscalYear"]: (r["revenue"], r["netResult"], r["error"]) for r in found} == {
        2024: (1000.5, 120.0, None), 2023: (None, None, None), 2022: (None, None, "fetch_failed"),
    }


def test_texts_are_parsed_after_filings_are_chosen(spark, rows):
    deposits = deposit_rows(rows("enterpriseNumber string, payload string", ("1", "{}")))
    texts = spark.range(10).selectExpr("cast(id as string) as filing_id", "'70 1.000' as text")
    plan = published_financials(deposits, rows(RUBRIC), texts, [2024])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and plan.rindex("LeftSemi") > plan.index("Generate")


def test_measures_are_stored_by_batch(spark, rows, tmp_path):
    schema, folder = "filing_id long, code string, value string, period string, pos int", str(tmp_path)
    assert measure_store.measures(spark, folder).count() == 0 and measure_store.update(spark, folder) == []
    measure_store.land(rows(schema, (1, "70", "5", "N", 1), (2, "70", "7", "N", 1)), folder, "2024-01")
    assert measure_store.update(spark, folder) == ["2024-01"]
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("measures/**/*.parquet")}
    measure_store.land(rows(schema, (2, "70", "8", "N", 1), (3, "9904", "1", "N", 1)), folder, "2024-02")
    batches = measure_store.new_batches(spark, folder)
    assert batches == ["2024-02"]
    # An update opens the folders of new batches and leaves stored ones alone.
    assert all("batch=2024-02" in f for f in measure_store.new_lines(spark, folder, batches).inputFiles())
    assert measure_store.update(spark, folder) == ["2024-02"] and measure_store.update(spark, folder) == []
    assert before.items() <= {p: p.stat().st_mtime_ns for p in tmp_path.rglob("measures/**/*.parquet")}.items()
    found = {r["filing_id"]: (r["revenue"], r["netResult"], r["lineCount"]) for r in measure_store.measures(spark, folder).collect()}
    assert found == {1: (5.0, None, 1), 2: (8.0, None, 1), 3: (None, 1.0, 1)}
    # A batch that failed before its mark is done again.
    (tmp_path / "done" / "batch=2024-02").rmdir()
    assert measure_store.measures(spark, folder).count() == 2 and measure_store.update(spark, folder) == ["2024-02"]
    assert measure_store.measures(spark, folder).count() == 3
    with pytest.raises(ValueError):
        measure_store.land(rows(schema), folder, "a/b")


def test_measures_of_a_larger_store_take_more_tasks(spark, rows, tmp_path, monkeypatch):
    """A filing's measures are wide, so their number in a task must not grow with the lines that landed."""
    from firmatlas.operators import keyed

    folder = str(tmp_path)
    lines = [(i, code, str(i), "N", 1) for i in range(600) for code in ("70", "9904")]
    measure_store.land(rows("filing_id long, code string, value string, period string, pos int", *lines), folder, "2024-01")
    monkeypatch.setattr(keyed, "task_count", lambda df: 11)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        measure_store.update(spark, folder)
        found = measure_store.measures(spark, folder)
        assert found.rdd.getNumPartitions() == 11
        stored = spark.read.parquet(f"{folder}/measures/batch=2024-01")
        assert len(stored.inputFiles()) == 11 and stored.filter("revenue = filing_id and netResult = filing_id").count() == 600
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert found.count() == 600


def test_texts_are_dealt_in_tasks_that_grow_with_the_orders(spark, rows, tmp_path, monkeypatch):
    orders = rows("o_orderkey long, o_custkey long, o_orderstatus string", *[(i, i % 7, "F") for i in range(50)])
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(testviews, "PARSE_BYTES", 100)
    found = filing_measures(text_rubrics(insurer_texts(testviews.TestViews(spark, str(tmp_path)))), ["filing_id"])
    # No second shuffle, of measures, behind the parser; and more tasks than the one file has splits.
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert found.rdd.getNumPartitions() > 8 and found.count() == 50
    assert found.filter("equity is null or netResult is null or insuranceReceivables is null").count() == 0


def test_first_label_with_an_amount_counts(rubrics_of):
    text = "C. Beleggingen\nnote\n1.234\n5.678\nC. Placements 9.999\nA. Eigen vermogen\nx A. Eigen vermogen 7.777"
    assert rubrics_of(text) == [("INS_EQUITY", "7777"), ("INS_INVESTMENTS", "1234")]
