import datetime
import glob
import os

import pytest

from pyspark.sql import functions as F

from firmatlas.plans import analysis, report, report_store, stored_reports
from firmatlas.plans.stored_reports import Selection
from firmatlas.sinks.csv_reports import write_postal_counts, write_report
from firmatlas.sources.csv_files import read_report
from firmatlas.operators.rubrics import ALL_MEASURES

COMPANY = "enterpriseNumber string, name string, postalCode string, status string, juridicalSituation string, startDate string, juridicalForm string"
DATA = "struct<revenue:double,insuranceInvestments:double,technicalProvisions:double,kboStatus:string,juridicalSituation:string,startDate:string,juridicalForm:string>"
ROW = f"runId string, enterpriseNumber string, fiscalYear int, name string, postalCode string, status string, message string, data {DATA}"
NOW = datetime.datetime(2024, 5, 6)


@pytest.fixture
def companies(rows):
    return rows(COMPANY, *[(f"0000.000.00{i}", f"C{i}", "1000", "Actief", None, "2000-01-01", "NV") for i in range(1, 6)])


@pytest.fixture
def financials(rows):
    def make(*data):
        schema = "enterpriseNumber string, enterpriseName string, fiscalYear int, referenceNumber string, "
        schema += ", ".join(f"{m} double" for m in ALL_MEASURES) + ", currency string, depositDate string, error string"
        full = []
        for number, year, revenue, employees, error in data:
            values = {"revenue": revenue, "employeeCount": employees, "netResult": 10.0 if revenue else None}
            full.append((number, "N", year, "r", *[values.get(m) for m in ALL_MEASURES], "EUR", "2025-01-01", error))
        return rows(schema, *full)

    return make


@pytest.fixture
def years(financials):
    return financials(
        ("0000000001", 2024, 40.0, 2.0, None), ("0000000001", 2023, None, 2.0, None),
        ("0000000002", 2024, None, None, "unsupported_format"), ("0000000003", 2024, None, None, "no_json"),
        ("0000000003", 2023, None, None, "fetch_failed"),
    )


@pytest.fixture
def listed(rows):
    return rows("enterpriseNumber string", *[(f"000000000{i}",) for i in (1, 2, 3, 4)])


def statuses(df):
    return sorted((r["enterpriseNumber"][-1], r["returnedFiscalYear"] or 0, r["status"]) for r in df.collect())


def test_status_per_year(companies, years, listed):
    results = report.company_results(years, listed, retry_whole=False)
    assert statuses(report.financial_report(companies, results)) == [
        ("1", 2023, "partial_financial_data"), ("1", 2024, "ok"), ("2", 2024, "accounting_pdf_only"),
        ("3", 0, "fetch_failed"), ("3", 2024, "no_accounting_data"), ("4", 0, "no_account_for_year"), ("5", 0, "fetch_failed"),
    ]


def test_failed_year_asks_for_the_whole_company_again(companies, years, listed):
    full = report.financial_report(companies, report.company_results(years, listed))
    assert [s for s in statuses(full) if s[0] == "3"] == [("3", 0, "fetch_failed")]
    assert full.filter("enterpriseNumber like '%3'").first()["message"] == report.RETRY_MESSAGE
    assert full.filter("status = 'ok'").first()["marginPercent"] == 25.0


def test_remaining(companies, rows):
    left = report.remaining(companies, rows("enterpriseNumber string", ("0000.000.001",), ("0000.000.001",)))
    assert left.count() == 4


def test_field_selection():
    assert [f[0] for f in report.selected_fields(["equity", "revenue"])] == ["revenue", "equity"]
    assert len(report.selected_fields()) == 17
    with pytest.raises(ValueError):
        report.selected_fields(["nothing"])


def test_report_csv_and_back(spark, companies, years, listed, tmp_path):
    full = report.financial_report(companies, report.company_results(years, listed)).replace("C1", 'C "1", x', "name")
    columns = report.report_columns(full, "62", None, "MAIN", 2024, 2, ["revenue", "employees"])
    write_report(columns.coalesce(1), str(tmp_path / "out"))
    (path,) = glob.glob(str(tmp_path / "out" / "*.csv"))
    text = open(path, encoding="utf-8", newline="").read()
    lines = text.split("\r\n")
    assert text.startswith(chr(0xFEFF) + "Enterprise number,KBO name,NBB name,Postal code,NACE code,NACE version,")
    assert lines[0].endswith("Revenue EUR,Total employees FTE,Financial data status,NBB message,NBB reference,NBB deposit date")
    assert lines[1] == '0000.000.001,"C ""1"", x",N,1000,62,,MAIN,2024,2,2024,40,2,ok,,r,2025-01-01'
    assert lines[-1] == "" and len(lines) == 8
    back = read_report(spark, str(tmp_path / "out"))
    assert back.columns[0] == "Enterprise number"
    kpis = analysis.financial_kpis(analysis.financial_slice(back)).first()
    assert (kpis["rowCount"], kpis["completeCount"], kpis["revenue"], kpis["fte"]) == (1, 1, 40.0, 2.0)
    assert analysis.financial_kpis(back).first()["qualityPercent"] == pytest.approx(100 / 6)
    assert analysis.financial_slice(back, min_revenue=-1).count() == 6
    assert [tuple(r) for r in analysis.top_revenue(back).collect()] == [('C "1", x', "0000.000.001", 40.0)]


def test_report_is_written_in_order_by_many_tasks(spark, tmp_path):
    counts = spark.range(1000).selectExpr("lpad(cast(id as string), 4, '0') as postalCode", "id as enterpriseCount").orderBy("postalCode")
    write_postal_counts(counts, str(tmp_path / "out"))
    codes = []
    for path in sorted(glob.glob(str(tmp_path / "out" / "*.csv"))):
        lines = open(path, encoding="utf-8", newline="").read().split("\r\n")
        assert lines[0] == chr(0xFEFF) + "Postal code,Enterprise count"
        codes += [line.split(",")[0] for line in lines[1:-1]]
    assert codes == sorted(codes) and len(codes) == 1000


def test_stored_rows(companies, years, listed):
    selection = Selection("62", "2025", "1000", [2023, 2024, 2023], ["equity", "revenue"])
    stored = stored_reports.report_rows("r1", companies, years, listed, selection)
    found = {(r["enterpriseNumber"][-1], r["fiscalYear"]): r for r in stored.collect()}
    assert {k: r["status"] for k, r in found.items()} == {
        ("1", 2024): "ok", ("1", 2023): "ok", ("2", 2024): "partial_financial_data", ("3", 2024): "partial_financial_data",
        ("3", 2023): "partial_financial_data", ("4", 2024): "no_account_for_year", ("5", 2024): "fetch_failed",
    }
    assert found[("2", 2024)]["message"] == "unsupported_format"
    assert found[("1", 2024)]["data"]["revenue"] == 40 and found[("1", 2024)]["data"]["kboStatus"] == "Actief"
    assert list(found[("1", 2024)]["data"].asDict())[:2] == ["revenue", "equity"]
    queued = stored_reports.run_header(companies, "r1", selection, NOW, NOW, stored_reports.QUEUED).first()
    assert (queued["totalCompanies"], queued["completedCompanies"]) == (0, 0)
    done = stored_reports.run_header(companies, "r1", selection, NOW, NOW, stored_reports.COMPLETED, stored).first()
    assert (done["totalCompanies"], done["completedCompanies"], done["fiscalYears"]) == (5, 5, [2024, 2023])


def run(spark, selection, run_id, day, status="completed"):
    moment = NOW + datetime.timedelta(days=day)
    return stored_reports.run_header(spark.range(3), run_id, selection, moment, moment, status)


def test_runs_by_selection_and_reset(spark, rows):
    blank = Selection("62", "2025", "1000", [2023, 2024], ["equity", "revenue"], "")
    none = Selection("62", "2025", "1000", [2024, 2023], ["revenue", "equity"])
    other = Selection("62", "2025", "1000", [2024], ["revenue", "equity"])
    runs = run(spark, blank, "a", 1).unionByName(run(spark, none, "b", 2)).unionByName(run(spark, other, "c", 3))
    runs = runs.unionByName(run(spark, none, "d", 0, "running"))
    data = (1.0, None, None, None, None, None, None)
    stored = rows(ROW, *[(r, "1", 2024, "X", "1000", "ok", None, data) for r in "abcd"])
    assert stored_reports.latest_run(runs, none).first()["id"] == "b"
    assert [r["runId"] for r in stored_reports.selected_rows(runs, stored, none).collect()] == ["b"]
    assert {r["id"] for r in stored_reports.latest_runs(runs).collect()} == {"b", "c"}
    kept_runs, kept_rows = stored_reports.reset_runs(runs, stored, none)
    assert {r["id"] for r in kept_runs.collect()} == {"c", "d"}
    assert {r["runId"] for r in kept_rows.collect()} == {"c", "d"}
    assert [r["runId"] for r in stored_reports.completed_rows(runs, stored).collect()] == ["c", "b", "a"]
    assert stored_reports.run_rows(runs, stored, "zz").count() == 0
    again = stored_reports.save_rows(stored, rows(ROW, ("a", "1", 2024, "Y", "1000", "ok", None, data)))
    assert {(r["runId"], r["name"]) for r in again.collect()} == {("a", "Y"), ("b", "X"), ("c", "X"), ("d", "X")}


@pytest.fixture
def results(rows):
    def data(revenue, investments=None):
        return (revenue, investments, None, None, None, None, None)

    schema = ROW + ", naceCode string, updatedAt timestamp_ntz"
    day = lambda n: NOW + datetime.timedelta(days=n)
    return rows(
        schema,
        ("new", "1", 2024, "New name", "1000", "ok", None, data(9.0), "62", day(2)),
        ("old", "1", 2024, "Old name", "1000", "ok", None, data(None), "62", day(1)),
        ("old", "1", 2023, "Old name", "1000", "ok", None, data(3.0, 1.0), "62", day(1)),
        ("old", "2", 2023, "Two", "2000", "ok", None, data(4.0), "63", day(1)),
        ("old", "3", 2023, "Bad", "3000", "fetch_failed", "x", data(5.0), "64", day(1)),
    )


def test_pivot(results):
    rows = analysis.processed(results)
    oldest = {r["enterpriseNumber"]: r for r in analysis.company_year_pivot(rows, "revenue", [2023, 2024]).collect()}
    assert tuple(oldest["1"]) == ("New name", "1", None, 3.0) and tuple(oldest["2"]) == ("Two", "2", None, 4.0)
    newest = analysis.company_year_pivot(rows, "revenue", [2024], analysis.NEWEST).collect()
    assert [tuple(r) for r in newest] == [("New name", "1", 9.0)]
    assert [r[0] for r in analysis.pivot_years(rows).collect()] == [2024, 2023]


def test_facets_and_columns(results):
    found = [tuple(r) for r in analysis.facets(results, nace_code="62", postal_code="2000").collect()]
    assert found == [("naceCode", "63"), ("postalCode", "1000")]
    assert analysis.shown_measures(results) == ["revenue", "insuranceInvestments"]
    export = analysis.stored_export(results)
    assert export.columns[:2] == ["Enterprise number", "Company"]
    assert export.columns[-3:] == ["revenue", "insuranceInvestments", "technicalProvisions"]


def test_runs_on_storage(spark, companies, years, listed, tmp_path):
    folder, ticks = str(tmp_path / "store"), iter(range(100))

    def clock():
        return NOW + datetime.timedelta(minutes=next(ticks))

    one = Selection("62", "2025", "1000", [2023, 2024], ["equity", "revenue"])
    two = Selection("62", "2025", "1000", [2024], ["employees"])
    assert report_store.read_runs(spark, folder).count() == 0 and report_store.read_rows(spark, folder).count() == 0
    for run_id, selection in (("a", one), ("b", two), ("c", two)):
        assert report_store.run_report(spark, folder, run_id, companies, years, listed, selection, clock) == "completed"
    runs, stored = report_store.read_runs(spark, folder), report_store.read_rows(spark, folder)
    assert {(r["id"], r["status"], r["completedCompanies"]) for r in runs.collect()} == {(x, "completed", 5) for x in "abc"}
    found = {(r["runId"], r["enterpriseNumber"][-1], r["fiscalYear"]): r["data"] for r in stored.collect()}
    assert found["a", "1", 2024]["revenue"] == 40 and found["a", "1", 2024]["employeeCount"] is None
    assert found["b", "1", 2024]["revenue"] is None and found["b", "1", 2024]["employeeCount"] == 2
    before = {p: os.path.getmtime(p) for p in glob.glob(f"{folder}/rows/attempt=*/*")}
    changed = stored_reports.report_rows("b", companies, years, listed, two).filter("fiscalYear = 2024").withColumn("name", F.lit("new"))
    report_store.upsert_rows(spark, changed.limit(1), folder)
    names = [r["name"] for r in report_store.read_rows(spark, folder).filter("runId = 'b'").collect()]
    assert names.count("new") == 1 and len(names) == 5
    assert before.items() <= {p: os.path.getmtime(p) for p in glob.glob(f"{folder}/rows/attempt=*/*")}.items()
    bad = years.withColumn("fiscalYear", F.when(F.col("fiscalYear") > 0, F.raise_error(F.lit("lost"))).cast("int"))
    assert report_store.run_report(spark, folder, "d", companies, bad, listed, one, clock) == "failed"
    failed = report_store.read_runs(spark, folder).filter("id = 'd'").first()
    assert failed["status"] == "failed" and "lost" in failed["message"]
    assert sorted(report_store.reset_selection(spark, folder, two)) == ["b", "c"]
    assert {r["id"] for r in report_store.read_runs(spark, folder).collect()} == {"a", "d"}
    assert {r["runId"] for r in report_store.read_rows(spark, folder).select("runId").distinct().collect()} == {"a"}
    # Rows of b twice and of c; a's stay.
    assert len(report_store.clean(spark, folder)) == 3 and len(glob.glob(f"{folder}/rows/attempt=*")) == 1
    assert report_store.read_rows(spark, folder).count() == 7 and report_store.clean(spark, folder) == []


STORE = Selection("62", "2025", "1000", [2023, 2024], ["equity", "revenue"])


def clock():
    return datetime.datetime.now()


def test_run_ids_of_any_characters(spark, companies, years, listed, tmp_path):
    folder, ids = str(tmp_path), ["2024-01-01 10:00:00", "a/b=c%", "", "é?#"]
    for run_id in ids:
        assert report_store.run_report(spark, folder, run_id, companies, years, listed, STORE, clock) == "completed"
    assert {r["runId"] for r in report_store.read_rows(spark, folder).collect()} == set(ids)
    assert sorted(report_store.reset_selection(spark, folder, STORE)) == sorted(ids)
    assert report_store.read_runs(spark, folder).count() == report_store.read_rows(spark, folder).count() == 0
    # A dropped run may be run again.
    assert report_store.run_report(spark, folder, ids[0], companies, years, listed, STORE, clock) == "completed"
    assert {r["runId"] for r in report_store.read_rows(spark, folder).collect()} == {ids[0]}


def test_a_run_saved_again_without_rows_has_none(spark, companies, years, listed, tmp_path):
    folder = str(tmp_path)
    report_store.run_report(spark, folder, "r", companies, years, listed, STORE, clock)
    assert report_store.read_rows(spark, folder).count() == 7
    report_store.run_report(spark, folder, "r", companies.limit(0), years, listed, STORE, clock)
    header = report_store.read_runs(spark, folder).first()
    assert (header["status"], header["totalCompanies"], header["completedCompanies"]) == ("completed", 0, 0)
    assert report_store.read_rows(spark, folder).count() == 0


def test_failures_between_rows_and_header(spark, companies, years, listed, tmp_path, monkeypatch):
    folder = str(tmp_path)
    report_store.run_report(spark, folder, "r", companies, years, listed, STORE, clock)
    old = sorted(map(str, report_store.read_rows(spark, folder).collect()))
    whole = report_store.run_header

    def header(companies, run_id, selection, created, updated, status, *rest):
        if status == "completed":
            raise RuntimeError("lost before the header")
        return whole(companies, run_id, selection, created, updated, status, *rest)

    monkeypatch.setattr(report_store, "run_header", header)
    renamed = companies.withColumn("name", F.lit("new"))
    assert report_store.run_report(spark, folder, "r", renamed, years, listed, STORE, clock) == "failed"
    found = report_store.read_runs(spark, folder).first()
    assert (found["status"], found["message"]) == ("failed", "lost before the header")
    assert sorted(map(str, report_store.read_rows(spark, folder).collect())) == old


def test_two_runners_do_not_mix(spark, companies, years, listed, tmp_path):
    folder, one, two = str(tmp_path), companies.limit(2), companies.withColumn("name", F.lit("two"))
    seen = []

    def between():
        """The clock of the first runner, on whose third reading a second one runs from start to end."""
        if len(seen) == 2:
            seen.append(None)
            assert report_store.run_report(spark, folder, "r", two, years, listed, STORE, clock) == "completed"
            assert {r["name"] for r in report_store.read_rows(spark, folder).collect()} == {"two"}
        seen.append(None)
        return clock()

    assert report_store.run_report(spark, folder, "r", one, years, listed, STORE, between) == "completed"
    rows = report_store.read_rows(spark, folder).collect()
    assert {r["name"] for r in rows} == {r["name"] for r in one.collect()} and len({r["enterpriseNumber"] for r in rows}) == 2
    assert report_store.read_runs(spark, folder).count() == 1 and len(report_store.clean(spark, folder)) == 1


def test_rows_of_runs_with_other_fields_unite(companies, years, listed):
    one = Selection("62", "2025", "1000", [2024], ["revenue"])
    two = Selection("62", "2025", "1000", [2024], ["equity"])
    parts = [stored_reports.report_rows(i, companies, years, listed, s) for i, s in (("r1", one), ("r2", two))]
    both = stored_reports.save_rows(*parts)
    assert both.count() == sum(p.count() for p in parts)
    assert {"revenue", "equity"} <= set(stored_reports.data_fields(both))


def test_inputs_of_runs_are_computed_once(spark, companies, years, listed, tmp_path):
    kept = report_store.keep_sources(str(tmp_path / "sources"), companies, years, listed)
    for df, own in zip(kept, (companies, years, listed)):
        assert df.schema.fieldNames() == own.schema.fieldNames() and sorted(map(str, df.collect())) == sorted(map(str, own.collect()))
        assert df._jdf.queryExecution().analyzed().collectLeaves().size() == 1 and df.inputFiles()
