import datetime

import pytest

from firmatlas.operators.audit import orphan_check, orphan_check_filtered, split_references
from firmatlas.operators.keyed import dedupe_first, merge_rows
from firmatlas.operators.staging import stage_table
from firmatlas.plans import digests
from firmatlas.plans.loading import audit_snapshot, load_all, load_missing, load_table, merged_table
from firmatlas.schemas import TABLES, Relation
from firmatlas.sources.buckets import batches, expire, merge_into, read_table, state
from firmatlas.sources.csv_files import ragged_rows, read_extract
from firmatlas.sources.snapshots import copy_table, empty_table, read_snapshot, table_schema, write_bucketed, write_table
from firmatlas.streaming.deliveries import last_batch, start_deliveries

NOW = datetime.datetime(2024, 5, 6, 7, 8, 9)

FILES = {
    "code.csv": [
        "Category,Code,Language,Description",
        "Status,AC,NL,Actief", "Status,AC,FR,Actif", "Nace2008,62010,NL,Software", "Status,AC,NL,Later",
    ],
    "enterprise.csv": [
        "EnterpriseNumber,Status,JuridicalSituation,TypeOfEnterprise,JuridicalForm,JuridicalFormCAC,StartDate",
        '"0200.065.765","AC","000","2","","",09-08-1960', "", "0200.068.636,AC,000,2,014,,31-02-2020",
        "0200.065.765,ST,000,2,015,,01-01-2000", "0200.000.001,AC,,1,,,",
    ],
    "establishment.csv": ["EstablishmentNumber,StartDate,EnterpriseNumber", "2.000.000.339,01-11-1974,0200.065.765"],
    "branch.csv": ["Id,StartDate,EnterpriseNumber", "9.000.006.626,01-11-1974,0200.065.765"],
    "address.csv": [
        "EntityNumber,TypeOfAddress,CountryNL,CountryFR,Zipcode,MunicipalityNL,MunicipalityFR,StreetNL,StreetFR,HouseNumber,Box,ExtraAddressInfo,DateStrikingOff",
        '0200.065.765,REGO,,,9070,Destelbergen,,"Panhuis ""de"" straat",,1,,,', "2.000.000.339,BAET,Nederland,,,,,,,,,,05-03-2021",
        "0200.065.765,ABBR,,,1,,,,,,,,", "9.000.006.626,BAET,,,1000,,,,,,,,",
    ],
    "contact.csv": [
        "EntityNumber,EntityContact,ContactType,Value",
        "0200.065.765,ENT,EMAIL,a@example.org", "0200.065.765,EST,TEL,1", "0200.065.765,BRA,TEL,2", "0200.065.765,ENT,EMAIL,later@example.org",
    ],
    "denomination.csv": ["EntityNumber,Language,TypeOfDenomination,Denomination", "0200.065.765,2,001,Intergem", "2.000.000.339,2,003,Unit"],
    "activity.csv": [
        "EntityNumber,ActivityGroup,NaceVersion,NaceCode,Classification",
        "0200.065.765,006,2008,84130,MAIN", "0200.065.765,006,2008,84130,MAIN", "2.000.000.339,003,2025,62010,SECO",
        ",003,2025,62010,SECO", "2.000.000.339,003,2025,,SECO",
    ],
    "meta.csv": ["Value,Variable", "2024-05-06,SnapshotDate"],
}


@pytest.fixture
def folder(tmp_path):
    for name, lines in FILES.items():
        (tmp_path / name).write_text("\r\n".join(lines) + "\r\n", encoding="utf-8")
    return str(tmp_path)


def keyed(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_staging_rules(spark, folder):
    def staged(table):
        return stage_table(read_extract(spark, f"{folder}/{TABLES[table].file}", table), table, NOW)

    assert [tuple(r) for r in staged("Code").collect()] == [("Status", "AC", "Actief")]
    companies = keyed(staged("Enterprise"), "enterpriseNumber")
    first = companies[("0200.065.765",)]
    assert first["KBOstatusCode"] == "AC" and first["juridicalFormCode"] is None
    assert first["startDate"] == datetime.datetime(1960, 8, 9)
    assert companies[("0200.068.636",)]["startDate"] == datetime.datetime(2020, 3, 2)
    assert companies[("0200.000.001",)]["startDate"] == NOW
    assert companies[("0200.000.001",)]["juridicalSituationCode"] == ""
    addresses = keyed(staged("KBOAddress"), "entityNumber", "typeOfAddressCode")
    assert len(addresses) == 3
    office = addresses[("0200.065.765", "REGO")]
    assert office["countryNL"] == "BE" and office["streetNL"] == 'Panhuis "de" straat'
    assert (office["enterpriseId"], office["establishmentId"]) == ("0200.065.765", None)
    unit = addresses[("2.000.000.339", "BAET")]
    assert (unit["enterpriseId"], unit["establishmentId"]) == (None, "2.000.000.339")
    assert unit["countryNL"] == "Nederland" and unit["dateStrikingOff"] == datetime.datetime(2021, 3, 5)
    branch = addresses[("9.000.006.626", "BAET")]
    assert (branch["enterpriseId"], branch["establishmentId"]) == (None, None)
    contacts = keyed(staged("KBOContact"), "entityContactCode", "conctactTypeCode")
    assert contacts[("ENT", "EMAIL")]["value"] == "a@example.org"
    assert contacts[("EST", "TEL")]["establishmentId"] == "0200.065.765"
    assert len(contacts) == 2
    assert staged("Activity").count() == 2
    assert [tuple(r) for r in staged("Meta").collect()] == [("SnapshotDate", "2024-05-06")]


def test_fields_with_line_breaks(spark, tmp_path):
    path = tmp_path / "meta.csv"
    path.write_text('Variable,Value\na,"x\ny"\nb,z\n', encoding="utf-8")
    rows = read_extract(spark, str(path), "Meta")
    assert {(r["Variable"], r["Value"]) for r in rows.collect()} == {("a", "x\ny"), ("b", "z")}


def test_file_order_over_many_splits(spark, tmp_path):
    """The first row per key wins also when a file is read in many pieces."""
    lines = ["Variable,Value"] + [f"k{i % 50},{i}" for i in range(20000)]
    (tmp_path / "meta.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = read_extract(spark, str(tmp_path / "meta.csv"), "Meta")
        assert raw.rdd.getNumPartitions() > 4
        first = {r["variable"]: r["value"] for r in stage_table(raw, "Meta", NOW).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert first == {f"k{i}": str(i) for i in range(50)}


def test_merge_modes(rows):
    stored = rows("k int, v string", (1, "old"), (2, "old"))
    incoming = rows("k int, v string", (2, "new"), (3, "new"))
    assert {tuple(r) for r in merge_rows(stored, incoming, ["k"], "keep").collect()} == {(1, "old"), (2, "old"), (3, "new")}
    assert {tuple(r) for r in merge_rows(stored, incoming, ["k"], "replace").collect()} == {(1, "old"), (2, "new"), (3, "new")}
    with pytest.raises(ValueError):
        merge_rows(stored, incoming, ["k"], "other")


def test_dedupe_with_a_hot_key(spark):
    df = spark.range(30000).selectExpr("if(id % 3 = 0, 7, id) as k", "30000 - id as o", "cast(id as string) as v")
    first = {r["k"]: r["v"] for r in dedupe_first(df, ["k"], ["o"]).collect()}
    assert first[7] == "29997" and len(first) == 20000


def test_line_breaks_in_fields_and_ragged_rows(spark, folder, tmp_path):
    name = '"Acme ""X"",\r\nBV"'
    (tmp_path / "denomination.csv").write_text(
        f"EntityNumber,Language,TypeOfDenomination,Denomination\r\n0200.065.765,2,001,{name}\r\n", encoding="utf-8", newline=""
    )
    target = str(tmp_path / "loaded")
    load_all(spark, folder, target, NOW)
    names = read_snapshot(spark, target)["Denomination"].collect()
    assert [r["entityNumber"] for r in names] == ["0200.065.765"] and names[0]["denomination"].startswith('Acme "X",')
    audit = {r["table"]: r for r in audit_snapshot(spark, folder, target).collect()}
    assert len(audit) == len(TABLES) and not any(r["incomplete"] for r in audit.values())
    path = f"{folder}/denomination.csv"
    assert ragged_rows(spark, path).collect() == []
    with open(path, "a", encoding="utf-8") as file:
        file.write("0200.065.765,2,001\r\n")
    assert [r["rows"] for r in ragged_rows(spark, path).collect()] == [1]
    for job in (lambda: load_all(spark, folder, str(tmp_path / "x"), NOW), lambda: audit_snapshot(spark, folder, target).collect()):
        with pytest.raises(Exception, match="denomination.csv"):
            job()


def test_files_with_another_header_are_refused(spark, tmp_path):
    (tmp_path / "1.csv").write_text("Variable,Value\na,1\n")
    (tmp_path / "2.csv").write_text("Value,Variable\n2,b\n")
    with pytest.raises(Exception, match="header"):
        read_extract(spark, str(tmp_path), "Meta").collect()


def test_malformed_start_dates_are_null(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Id,StartDate,EnterpriseNumber\n1,soon,x\n2,,x\n3,01-02-2003,x\n")
    staged = stage_table(read_extract(spark, str(tmp_path / "b.csv"), "Branch"), "Branch", NOW)
    assert {r["id"]: r["startDate"] for r in staged.collect()} == {"1": None, "2": NOW, "3": datetime.datetime(2003, 2, 1)}


def test_load_all_then_audit_then_missing(spark, folder, tmp_path):
    first, second, third = (str(tmp_path / f"s{i}") for i in range(3))
    load_all(spark, folder, first, NOW)
    audit = keyed(audit_snapshot(spark, folder, first), "table")
    assert {r["status"] for r in audit.values()} == {"MATCH"} and len(audit) == 9
    assert load_missing(spark, folder, first, second, NOW) == []
    with open(f"{folder}/branch.csv", "a", encoding="utf-8") as file:
        file.write("9.000.006.627,01-11-1974,0200.065.765\r\n")
    audit = keyed(audit_snapshot(spark, folder, first), "table")
    assert audit[("Branch",)]["difference"] == -1 and audit[("Branch",)]["incomplete"]
    assert load_missing(spark, folder, first, second, NOW) == ["Branch"]
    assert read_snapshot(spark, second, ["Branch"])["Branch"].count() == 2
    # A full load starts from empty tables but keeps codes, branches and metadata.
    (tmp_path / "branch.csv").write_text(FILES["branch.csv"][0] + "\n", encoding="utf-8")
    load_all(spark, folder, third, NOW, current=first)
    assert read_snapshot(spark, third, ["Branch"])["Branch"].count() == 1


def test_unchanged_extracts_are_audited_without_their_keys(spark, folder, tmp_path, monkeypatch):
    snapshot = str(tmp_path / "s")
    load_all(spark, folder, snapshot, NOW)
    digests.keep_digests(spark, folder, snapshot)
    counted, whole = [], digests.distinct_keys
    monkeypatch.setattr(digests, "distinct_keys", lambda raw, table, buckets=None: counted.append((table, buckets)) or whole(raw, table, buckets))
    want = {r["table"]: (r["expected"], r["loaded"], r["status"]) for r in audit_snapshot(spark, folder, snapshot).collect()}
    found = {r["table"]: (r["expected"], r["loaded"], r["status"]) for r in digests.audit_digests(spark, folder, snapshot).collect()}
    assert found == want and counted == []
    # Only sums of buckets are shuffled for it.
    sums = digests.source_sums(read_extract(spark, f"{folder}/activity.csv", "Activity"), "Activity")
    assert "hashpartitioning(bucket" in sums._jdf.queryExecution().executedPlan().toString()
    # Another row, a repeated row and another order: keys of the buckets that differ are counted.
    lines = FILES["contact.csv"]
    (tmp_path / "contact.csv").write_text("\n".join([lines[0], *lines[:0:-1], lines[1], "9,ENT,TEL,3"]) + "\n", encoding="utf-8")
    found = {r["table"]: r for r in digests.audit_digests(spark, folder, snapshot).collect()}
    want = {r["table"]: r for r in audit_snapshot(spark, folder, snapshot).collect()}
    assert [t for t, _ in counted] == ["KBOContact"] and 1 <= found["KBOContact"]["counted"] <= 2
    assert all(found[t][c] == want[t][c] for t in TABLES for c in ("expected", "loaded", "status", "incomplete"))


def test_a_digest_is_made_by_one_reading(rows):
    raw = rows("EntityNumber string, EntityContact string, ContactType string, Value string", *[(f"e{i % 150}" if i % 7 else None, "ENT" if i % 5 else "BRA", "\0" if i % 2 else None, "v") for i in range(600)])
    digest = digests.whole_digest(raw, "KBOContact")
    want = digests.source_sums(raw, "KBOContact").join(digests.distinct_keys(raw, "KBOContact"), "bucket")
    columns = ["bucket", "rows", "low", "high", "keys"]
    found = sorted(map(tuple, digest.select(*columns).collect()))
    assert found == sorted(map(tuple, want.select(*columns).collect())) and len(found) > 40
    assert digest._jdf.queryExecution().executedPlan().toString().count("Scan") == 1


def test_merging_into_an_empty_table_joins_nothing(spark, rows):
    raw = rows("Id string, StartDate string, EnterpriseNumber string", ("9.000.006.626", "01-11-1974", "0200.065.765"))
    for upsert in (False, True):
        merged = merged_table(empty_table(spark, "Branch"), raw, "Branch", NOW, upsert)
        assert "Join" not in merged._jdf.queryExecution().optimizedPlan().toString() and merged.count() == 1
    assert empty_table(spark, "Branch").schema == table_schema("Branch")


def test_tables_are_copied_without_a_shuffle(spark, tmp_path):
    first, second = str(tmp_path / "first"), str(tmp_path / "second")
    given = [(f"{i % 90:04}", "001", ("2003", "2008")[i % 2], f"{i * 7919 % 997:05}", "MAIN", None, None) for i in range(2000)]
    write_table(spark.createDataFrame(given, table_schema("Activity")), first, "Activity")
    shuffled = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    copy_table(spark, first, second, "Activity")
    assert spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size() <= shuffled
    found = read_snapshot(spark, second, ["Activity"])["Activity"].select(*TABLES["Activity"].columns)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(given, key=str)
    for path in (tmp_path / "second" / "Activity").glob("*/*.parquet"):
        order = [(r["naceCode"], r["entityNumber"]) for r in spark.read.parquet(str(path)).collect()]
        assert order == sorted(order)


def test_upsert_replaces_and_plain_load_keeps(spark, folder, tmp_path):
    base, kept, replaced = (str(tmp_path / n) for n in ("base", "kept", "replaced"))
    load_table(spark, "Establishment", f"{folder}/establishment.csv", base, NOW)
    path = tmp_path / "new.csv"
    path.write_text("StartDate,EnterpriseNumber,EstablishmentNumber\n02-02-2002,0200.000.001,2.000.000.339\n", encoding="utf-8")
    load_table(spark, "Establishment", str(path), kept, NOW, current=base)
    load_table(spark, "Establishment", str(path), replaced, NOW, current=base, upsert=True)
    owner = lambda s: read_snapshot(spark, s, ["Establishment"])["Establishment"].first()["enterpriseNumber"]
    assert owner(kept) == "0200.065.765" and owner(replaced) == "0200.000.001"


def test_deliveries_are_merged_once(spark, tmp_path):
    inbox, root, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    (tmp_path / "in").mkdir()

    def deliver(name, *lines):
        (tmp_path / "in" / name).write_text("\n".join(["Variable,Value", *lines]) + "\n", encoding="utf-8")
        query = start_deliveries(spark, inbox, "Meta", root, log, NOW)
        query.awaitTermination()
        return query

    deliver("a.csv", "x,1", "x,2", "y,1")
    query = deliver("b.csv", "y,9", "z,9")
    assert last_batch(query) == 1
    assert {tuple(r) for r in read_table(spark, root, "Meta").collect()} == {("x", "1"), ("y", "9"), ("z", "9")}
    assert {tuple(r) for r in read_table(spark, root, "Meta", 0).collect()} == {("x", "1"), ("y", "1")}
    # Line breaks in fields are read, and a row without a field ends the run before it changes anything.
    deliver("c.csv", 'w,"1', '2"')
    with pytest.raises(Exception, match="another number of fields"):
        deliver("d.csv", "v,1", "u")
    rows = {tuple(r) for r in read_table(spark, root, "Meta").collect()}
    assert rows == {("x", "1"), ("y", "9"), ("z", "9"), ("w", "1\n2")}


def files_of(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("part-*.parquet") if "data" in p.parts}


def test_a_delivery_rewrites_only_its_buckets(spark, tmp_path):
    def rows(keys, value):
        return spark.createDataFrame([(f"k{k}", value) for k in keys], "variable string, value string")

    root = str(tmp_path)
    assert len(merge_into(spark, rows(range(200), "0"), root, "Meta", 0, "replace", buckets=16)) == 16
    before = files_of(tmp_path)
    touched = merge_into(spark, rows([7], "1"), root, "Meta", 1, "replace", buckets=16)
    fresh = files_of(tmp_path) - before
    assert before <= files_of(tmp_path) and len(touched) == 1
    assert len(fresh) == 1 and f"batch=1/bucket={touched[0]}/" in fresh.pop()
    got = {r["variable"]: r["value"] for r in read_table(spark, root, "Meta").collect()}
    assert got == {f"k{k}": "1" if k == 7 else "0" for k in range(200)}
    # The other buckets are read where they are, and an older state stays as it was.
    names = {f.split("/data/")[1] for f in read_table(spark, root, "Meta").inputFiles()}
    assert sum("batch=0/" in n for n in names) == 15 and sum("batch=1/" in n for n in names) == 1
    assert {r["value"] for r in read_table(spark, root, "Meta", 0).collect()} == {"0"}
    # A repeated batch gives the same state; a stored row wins where it is kept.
    assert merge_into(spark, rows([7], "1"), root, "Meta", 1, "replace", buckets=16) == touched
    merge_into(spark, rows([7, 300], "2"), root, "Meta", 2, "keep", buckets=16)
    got = {r["variable"]: r["value"] for r in read_table(spark, root, "Meta").collect()}
    assert (got["k7"], got["k300"], len(got)) == ("1", "2", 201)
    with pytest.raises(ValueError, match="buckets"):
        merge_into(spark, rows([1], "3"), root, "Meta", 3, "keep", buckets=8)


def test_expired_states_leave_what_newer_ones_need(spark, tmp_path):
    root = str(tmp_path)
    for n in range(5):
        rows = spark.createDataFrame([(f"k{k}", str(n)) for k in range(n, 40)], "variable string, value string")
        merge_into(spark, rows, root, "Meta", n, "replace", buckets=4)
    whole = {tuple(r) for r in read_table(spark, root, "Meta").collect()}
    # What a batch without a state has written is still wanted.
    (tmp_path / "Meta" / "data" / "batch=9" / "bucket=1").mkdir(parents=True)
    expire(spark, root, "Meta", keep=2)
    assert batches(spark, root, "Meta") == [3, 4]
    assert {tuple(r) for r in read_table(spark, root, "Meta").collect()} == whole and len(whole) == 40
    assert read_table(spark, root, "Meta", 3).count() == 40
    left = {p.name for p in (tmp_path / "Meta" / "data").iterdir()}
    assert left == {f"batch={n}" for n in {*state(spark, root, "Meta", 3)[0].values(), *state(spark, root, "Meta", 4)[0].values(), 9}}


def test_deliveries_go_on_from_a_snapshot(spark, folder, tmp_path):
    base = str(tmp_path / "base")
    load_table(spark, "Establishment", f"{folder}/establishment.csv", base, NOW)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("EstablishmentNumber,StartDate,EnterpriseNumber\n2.1,,x\n2.000.000.339,,y\n")
    start_deliveries(spark, str(tmp_path / "in"), "Establishment", str(tmp_path / "t"), str(tmp_path / "log"), NOW, initial=base, upsert=False, keep=1).awaitTermination()
    rows = {r["establishmentNumber"]: r["enterpriseNumber"] for r in read_table(spark, str(tmp_path / "t"), "Establishment").collect()}
    assert rows == {"2.000.000.339": "0200.065.765", "2.1": "x"}


def test_orphans(rows):
    tables = {
        "Enterprise": rows("enterpriseNumber string, KBOstatusCode string", ("1", "AC"), ("2", "XX"), ("3", "XX")),
        "Code": rows("category string, code string", ("Status", "AC"), ("Other", "XX")),
        "Branch": rows("enterpriseNumber string", ("1",), ("9",), (None,)),
    }
    relations = [Relation("Enterprise", "KBOstatusCode", "Code", "Status"), Relation("Branch", "enterpriseNumber", "Enterprise")]
    found = keyed(orphan_check(tables, relations), "relation")
    assert tuple(found[("Enterprise.KBOstatusCode",)])[2:] == (2, 1)
    assert tuple(found[("Branch.enterpriseNumber",)])[2:] == (1, 1)


def test_orphans_that_a_filter_denies_are_not_joined(spark, tmp_path):
    n = 3000
    tables = {
        "Enterprise": spark.range(n).selectExpr("cast(id * 2 as string) as enterpriseNumber"),
        "Branch": spark.range(n * 3).selectExpr("cast(id % 4000 as string) as enterpriseNumber").unionByName(spark.createDataFrame([(None,)], "enterpriseNumber string")),
    }
    relations = [Relation("Branch", "enterpriseNumber", "Enterprise")]
    denied, rest = split_references(tables, str(tmp_path / "a"), relations)
    # Every other of 4,000 values is an orphan; a filter admits few of them, and every known one.
    assert 1990 <= denied.count() <= 2000 and rest.filter("ref is not null").count() == 4000 - denied.count()
    assert denied.filter("cast(ref as int) % 2 = 0").count() == 0
    want = orphan_check(tables, relations).collect()
    assert orphan_check_filtered(tables, str(tmp_path / "b"), relations).collect() == want
    # A filter that is far too small denies little, and changes nothing.
    assert orphan_check_filtered(tables, str(tmp_path / "c"), relations, parts=1).collect() == want


def test_bucketed_tables_join_without_a_shuffle(spark, rows):
    df = rows("enterpriseNumber string, v int", *[(str(i), i) for i in range(100)])
    for name in ("bucketed_a", "bucketed_b"):
        write_bucketed(df, name, 4, "enterpriseNumber")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucketed_a").join(spark.table("bucketed_b"), "enterpriseNumber")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table bucketed_a")
        spark.sql("drop table bucketed_b")
