"""Registered load queries: staging rules, merges, audit and incremental load."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmatlas.functions.dates import iso_day
from firmatlas.operators.audit import audit_load, load_plan, orphan_check, orphan_check_filtered
from firmatlas.operators.keyed import KEEP, REPLACE, dedupe_first, merge_rows
from firmatlas.operators.staging import malformed_dates, stage_table
from firmatlas.plans import digests
from firmatlas.plans.loading import audit_snapshot, load_all, load_missing, merged_table, reset_tables
from firmatlas.schemas import TABLES
from firmatlas.session import work_folder
from firmatlas.sources.csv_files import read_extract
from firmatlas.sources.snapshots import read_snapshot
from firmatlas.sources.testviews import TestViews, with_views
from firmatlas.sources.buckets import read_table
from firmatlas.streaming.deliveries import start_deliveries

LOAD_TIME = datetime.datetime(2024, 5, 6, 7, 8, 9)
DAY_TEXT = (
    "case when {key} % 17 = 0 then '' when {key} % 19 = 0 then 'unknown' "
    "when {key} % 23 = 0 then '31-02-2020' else date_format({day}, 'dd-MM-yyyy') end"
)


class RawExtracts:
    """Extract-shaped rows made of the test tables, with rows that the load rules drop."""

    def __init__(self, views: TestViews):
        self.views = views

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name.lower())()

    def code(self) -> DataFrame:
        code = self.views.code
        return code.selectExpr(
            "category as Category", "code as Code", "'NL' as Language", "description as Description"
        ).unionByName(
            code.selectExpr("category as Category", "code as Code", "'FR' as Language", "upper(description) as Description")
        ).unionByName(self.views.nace_catalog)

    def enterprise(self) -> DataFrame:
        day = DAY_TEXT.format(key="c_custkey", day="date_add(date'1990-01-01', cast(c_custkey % 9000 as int))")
        return self.views.table("customer").selectExpr(
            "c_custkey", "c_name as EnterpriseNumber", "if(c_acctbal >= 0, 'AC', 'ST') as Status",
            "cast(c_nationkey as string) as JuridicalSituation", "c_mktsegment as TypeOfEnterprise",
            "if(c_custkey % 4 = 0, '', c_mktsegment) as JuridicalForm",
            "if(c_custkey % 8 = 0, c_mktsegment, null) as JuridicalFormCAC", f"{day} as StartDate",
        )

    def _unit(self, remainder: int, prefix: str, name: str) -> DataFrame:
        day = DAY_TEXT.format(key="o_orderkey", day="o_orderdate")
        return self.views.table("orders").where(f"o_orderkey % 3 = {remainder}").selectExpr(
            f"concat('{prefix}', o_orderkey) as {name}", f"{day} as StartDate",
            "concat('0.', o_custkey) as EnterpriseNumber",
        )

    def establishment(self) -> DataFrame:
        return self._unit(0, "2.", "EstablishmentNumber")

    def branch(self) -> DataFrame:
        return self._unit(2, "9.", "Id")

    def kboaddress(self) -> DataFrame:
        columns = TABLES["KBOAddress"].source_columns
        address = self.views.address
        renamed = {c: c[0].lower() + c[1:] for c in columns[2:12]}
        return address.selectExpr(
            "entityNumber as EntityNumber", "typeOfAddressCode as TypeOfAddress",
            *[f"{old} as {new}" for new, old in renamed.items()], "cast(null as string) as DateStrikingOff",
        ).unionByName(
            self.views.table("orders").selectExpr(
                f"concat('2.', regexp_replace(lpad(cast(o_orderkey as string), 9, '0'), '^(...)(...)(...)$', '$1.$2.$3')) as EntityNumber",
                "case o_orderkey % 3 when 0 then 'REGO' when 1 then 'BAET' else 'OTHER' end as TypeOfAddress",
                "if(o_orderkey % 2 = 0, '', 'Duitsland') as CountryNL", "cast(null as string) as CountryFR",
                "cast(o_custkey as string) as Zipcode", "'' as MunicipalityNL", "'Ville' as MunicipalityFR",
                "cast(null as string) as StreetNL", "'' as StreetFR", "'1' as HouseNumber", "'' as Box", "'' as ExtraAddressInfo",
                f"{DAY_TEXT.format(key='o_orderkey', day='o_orderdate')} as DateStrikingOff",
            )
        )

    def kbocontact(self) -> DataFrame:
        return self.views.table("orders").selectExpr(
            "concat('0.', o_custkey) as EntityNumber",
            "case o_orderkey % 3 when 0 then 'ENT' when 1 then 'EST' else 'BRA' end as EntityContact",
            "o_orderpriority as ContactType", "o_orderstatus as Value", "o_orderkey as sourceRow",
        )

    def denomination(self) -> DataFrame:
        return self.views.denomination.selectExpr(
            "entityNumber as EntityNumber", "languageCode as Language",
            "typeOfDenominationCode as TypeOfDenomination", "denomination as Denomination",
        )

    def activity(self) -> DataFrame:
        return self.views.activity_raw.selectExpr(
            "if(right(naceCode, 1) = '7', '', entityNumber) as EntityNumber", "activityGroupCode as ActivityGroup",
            "naceVersion as NaceVersion", "if(right(naceCode, 1) = '8', '', naceCode) as NaceCode",
            "classification as Classification",
        )

    def meta(self) -> DataFrame:
        return self.views.table("nation").selectExpr(
            "cast(n_regionkey as string) as Variable", "n_name as Value", "n_nationkey as sourceRow"
        )


def _raw(spark: SparkSession, folder: str) -> RawExtracts:
    return RawExtracts(TestViews(spark, folder))


def _days(df: DataFrame, *columns: str) -> DataFrame:
    for column in columns:
        df = df.withColumn(column, iso_day(F.col(column)))
    return df


def _staged(name: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        staged = stage_table(_raw(spark, folder)[name], name, LOAD_TIME)
        return _days(staged, *[c for c in staged.columns if c in ("startDate", "dateStrikingOff")])

    return query


def malformed_start_dates(spark: SparkSession, folder: str) -> DataFrame:
    return malformed_dates(_raw(spark, folder).enterprise())


LINE_ORDER = [
    "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
    "l_returnflag", "l_linestatus",
]


def _first_lines(views: TestViews) -> DataFrame:
    return dedupe_first(views.table("lineitem"), ["l_orderkey", "l_linenumber"], LINE_ORDER)


def _line_columns(df: DataFrame) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")


def load_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    return _line_columns(_first_lines(TestViews(spark, folder)))


def _merge(mode: str):
    """Stored: first part-ordered line per key of two order groups; incoming: the others, partly the same keys."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        lines = TestViews(spark, folder).table("lineitem")
        keys = ["l_orderkey", "l_linenumber"]
        stored = dedupe_first(lines.where("l_returnflag <> 'R'"), keys, LINE_ORDER)
        incoming = dedupe_first(lines.where("l_returnflag = 'R'"), keys, LINE_ORDER)
        return _line_columns(merge_rows(stored, incoming, keys, mode))

    return query


def _audit(spark: SparkSession, folder: str) -> DataFrame:
    views = TestViews(spark, folder)
    raw = RawExtracts(views)
    stored = views.tables()
    return audit_load({n: raw[n] for n in TABLES}, {n: stored[n] for n in TABLES})


def load_audit(spark: SparkSession, folder: str) -> DataFrame:
    return _audit(spark, folder)


def load_actions(spark: SparkSession, folder: str) -> DataFrame:
    return load_plan(_audit(spark, folder))


# Columns of the written extracts that get a comma, doubled quotes and a line break.
AWKWARD = {"Code": "Description", "Denomination": "Denomination", "KBOAddress": "StreetFR", "KBOContact": "Value", "Meta": "Value"}


def load_all_audit(spark: SparkSession, folder: str) -> DataFrame:
    """All nine extracts written as CSV with awkward texts, loaded into a snapshot and audited.

    ``awkward`` counts the loaded texts that came through whole.
    """
    raw, root = _raw(spark, folder), work_folder(spark, "extracts")
    for name, spec in TABLES.items():
        rows = raw[name].select(*spec.source_columns)
        if name in AWKWARD:
            rows = rows.withColumn(AWKWARD[name], F.concat(F.coalesce(AWKWARD[name], F.lit("")), F.lit(', "x"\ny')))
        rows.write.options(header="true", quote='"', escape='"').csv(f"{root}/in/{spec.file}")
    load_all(spark, f"{root}/in", f"{root}/out", LOAD_TIME)
    audit = audit_snapshot(spark, f"{root}/in", f"{root}/out")
    stored = read_snapshot(spark, f"{root}/out")
    whole = None
    for name, column in AWKWARD.items():
        own = column[0].lower() + column[1:]
        part = stored[name].agg(F.lit(name).alias("table"), F.count_if(F.col(own).endswith(', "x"\ny')).alias("awkward"))
        whole = part if whole is None else whole.unionByName(part)
    return audit.join(whole, "table", "left").select("table", "expected", "loaded", "status", "awkward")


def load_missing_audit(spark: SparkSession, folder: str) -> DataFrame:
    """A snapshot of extracts of which two lack rows, completed from the whole extracts; ``reloaded`` names these two."""
    raw, root = _raw(spark, folder), work_folder(spark, "missing")

    def deliver(name: str, rows: DataFrame) -> None:
        spec = TABLES[name]
        rows.select(*spec.source_columns).write.mode("overwrite").options(header="true", quote='"', escape='"').csv(f"{root}/in/{spec.file}")

    for name in TABLES:
        rows = raw[name]
        if name == "Branch":
            rows = rows.filter("StartDate <> ''")
        deliver(name, rows.filter("Status = 'AC'") if name == "Enterprise" else rows)
    load_all(spark, f"{root}/in", f"{root}/first", LOAD_TIME)
    for name in ("Branch", "Enterprise"):
        deliver(name, raw[name])
    reloaded = load_missing(spark, f"{root}/in", f"{root}/first", f"{root}/second", LOAD_TIME)
    audit = audit_snapshot(spark, f"{root}/in", f"{root}/second")
    return audit.withColumn("reloaded", F.col("table").isin(reloaded)).select("table", "expected", "loaded", "status", "reloaded")


def audit_of_digests(spark: SparkSession, folder: str) -> DataFrame:
    """A load with digests, audited after one extract has lost a row and another has new ones; ``whole`` is
    whether the keys of an extract were left uncounted."""
    raw, root = _raw(spark, folder), work_folder(spark, "digests")

    def deliver(name: str, rows: DataFrame) -> None:
        spec = TABLES[name]
        rows.select(*spec.source_columns).write.mode("overwrite").options(header="true", quote='"', escape='"').csv(f"{root}/in/{spec.file}")

    for name in TABLES:
        rows = raw[name]
        deliver(name, rows.filter("StartDate <> ''") if name == "Branch" else rows)
    load_all(spark, f"{root}/in", f"{root}/out", LOAD_TIME)
    digests.keep_digests(spark, f"{root}/in", f"{root}/out")
    deliver("Branch", raw["Branch"])
    first = raw["Establishment"].agg(F.min("EstablishmentNumber")).first()[0]
    deliver("Establishment", raw["Establishment"].filter(F.col("EstablishmentNumber") != first))
    found = digests.audit_digests(spark, f"{root}/in", f"{root}/out")
    return found.select("table", "expected", "loaded", "status", "incomplete", (F.col("counted") == 0).alias("whole"))


def orphans(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_check(TestViews(spark, folder).tables())


def orphans_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_check_filtered(TestViews(spark, folder).tables(), work_folder(spark, "orphans"))


def table_reset(spark: SparkSession, folder: str) -> DataFrame:
    views = TestViews(spark, folder)
    tables = reset_tables(spark, views.tables())
    parts = [df.agg(F.lit(n).alias("table"), F.count("*").alias("n")) for n, df in tables.items()]
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    return counts


def csv_load(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses written as CSV by Spark, read back, staged and merged into the stored table."""
    raw = _raw(spark, folder)
    path = work_folder(spark, "address-csv")
    raw.kboaddress().write.options(header="true", quote='"', escape='"').csv(path)
    merged = merged_table(raw.views.address, read_extract(spark, path, "KBOAddress"), "KBOAddress", LOAD_TIME, upsert=True)
    return _days(merged, "dateStrikingOff")


def incremental_load(spark: SparkSession, folder: str) -> DataFrame:
    """Two deliveries of establishments, merged by two runs of the streaming job; the second has line breaks in fields."""
    root = work_folder(spark, "deliveries")
    first = _raw(spark, folder).establishment()
    second = first.where("StartDate = ''").selectExpr(
        "EstablishmentNumber", "'01-02-2003' as StartDate", "concat(EnterpriseNumber, ',\n\"9\"') as EnterpriseNumber"
    )
    for delivery in (first, second):
        rows = delivery.select(*TABLES["Establishment"].source_columns).write.mode("append")
        rows.options(header="true", quote='"', escape='"').csv(f"{root}/in")
        start_deliveries(
            spark, f"{root}/in", "Establishment", f"{root}/out", f"{root}/checkpoint", LOAD_TIME
        ).awaitTermination()
    return _days(read_table(spark, f"{root}/out", "Establishment"), "startDate")


QUERIES = {
    "stage_code": _staged("Code"),
    "stage_enterprise": _staged("Enterprise"),
    "stage_establishment": _staged("Establishment"),
    "stage_branch": _staged("Branch"),
    "stage_address": _staged("KBOAddress"),
    "stage_contact": _staged("KBOContact"),
    "stage_denomination": _staged("Denomination"),
    "stage_activity": _staged("Activity"),
    "stage_meta": _staged("Meta"),
    "malformed_start_dates": malformed_start_dates,
    "load_dedupe": load_dedupe,
    "load_insert": _merge(KEEP),
    "load_upsert": _merge(REPLACE),
    "load_audit": load_audit,
    "load_all_audit": load_all_audit,
    "load_missing": load_missing_audit,
    "audit_digests": audit_of_digests,
    "load_actions": load_actions,
    "orphan_check": orphans,
    "orphan_check_filtered": orphans_filtered,
    "table_reset": table_reset,
    "csv_load": csv_load,
    "incremental_load": incremental_load,
}


def _day(key: str, day: str, blank: str) -> str:
    return (
        f"CASE WHEN {key} % 17 = 0 THEN {blank} WHEN {key} % 19 = 0 THEN NULL WHEN {key} % 23 = 0 THEN '2020-03-02' "
        f"ELSE strftime({day}, '%Y-%m-%d') END"
    )


def _unit_sql(remainder: int, prefix: str, name: str) -> str:
    return f"""SELECT '{prefix}' || o_orderkey AS "{name}", {_day("o_orderkey", "o_orderdate", "'2024-05-06'")} AS "startDate",
  '0.' || o_custkey AS "enterpriseNumber" FROM orders WHERE o_orderkey % 3 = {remainder}"""


def _filled(name: str) -> str:
    return f"coalesce(nullif(\"{name}\", ''), 'BE') AS \"{name}\""


ADDRESS_SQL = f"""
SELECT "entityNumber", "typeOfAddressCode", {_filled("countryNL")}, {_filled("countryFR")}, nullif(zipcode, '') AS zipcode,
  "municipalityNL", "municipalityFR", "streetNL", "streetFR", "houseNumber", cast(NULL AS string) AS box,
  cast(NULL AS string) AS "extraAddressInfo", cast(NULL AS string) AS "dateStrikingOff", "enterpriseId", cast(NULL AS string) AS "establishmentId"
FROM address
UNION ALL
SELECT n, CASE o_orderkey % 3 WHEN 0 THEN 'REGO' ELSE 'BAET' END, CASE WHEN o_orderkey % 2 = 0 THEN 'BE' ELSE 'Duitsland' END, 'BE',
  cast(o_custkey AS string), NULL, 'Ville', NULL, NULL, '1', NULL, NULL, {_day("o_orderkey", "o_orderdate", "NULL")}, NULL, n
FROM (SELECT *, '2.' || regexp_replace(lpad(cast(o_orderkey AS string), 9, '0'), '^(...)(...)(...)$', '\\1.\\2.\\3') AS n FROM orders)
WHERE o_orderkey % 3 < 2"""
_LINES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag"


def _first_sql(condition: str) -> str:
    return (
        f"SELECT {_LINES} FROM lineitem WHERE {condition} QUALIFY row_number() OVER "
        f"(PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(LINE_ORDER)}) = 1"
    )


_MERGE = f"""WITH stored AS ({_first_sql("l_returnflag <> 'R'")}), incoming AS ({_first_sql("l_returnflag = 'R'")})"""
_KEYS = "USING (l_orderkey, l_linenumber)"
_CONTACT_ROWS = """contacts AS (
  SELECT '0.' || o_custkey AS "entityNumber", CASE o_orderkey % 3 WHEN 0 THEN 'ENT' ELSE 'EST' END AS "entityContactCode",
    o_orderpriority AS "conctactTypeCode", o_orderstatus AS value, o_orderkey FROM orders WHERE o_orderkey % 3 < 2)"""
_ACTIVITY_ROWS = """rows AS (SELECT DISTINCT "entityNumber", "activityGroupCode", "naceVersion", "naceCode", classification FROM activity_raw
  WHERE right("naceCode", 1) NOT IN ('7', '8'))"""
_AUDIT = f"""audit AS (
  SELECT 'Enterprise' AS "table", (SELECT count(DISTINCT c_name) FROM customer) AS expected, (SELECT count(*) FROM enterprise) AS loaded
  UNION ALL SELECT 'Establishment', (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0), (SELECT count(*) FROM establishment)
  UNION ALL SELECT 'Branch', (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 2), (SELECT count(*) FROM branch)
  UNION ALL SELECT 'KBOContact', (SELECT count(*) FROM (SELECT DISTINCT "entityNumber", "entityContactCode", "conctactTypeCode" FROM contacts)), (SELECT count(*) FROM contact)
  UNION ALL SELECT 'Denomination', (SELECT count(*) FROM denomination), (SELECT count(*) FROM denomination)
  UNION ALL SELECT 'Activity', (SELECT count(*) FROM rows), (SELECT count(*) FROM activity)
  UNION ALL SELECT 'Code', (SELECT count(*) FROM code), (SELECT count(*) FROM code)
  UNION ALL SELECT 'KBOAddress', (SELECT count(*) FROM address) + (SELECT count(*) FROM orders WHERE o_orderkey % 3 < 2), (SELECT count(*) FROM address)
  UNION ALL SELECT 'Meta', (SELECT count(DISTINCT n_regionkey) FROM nation), (SELECT count(*) FROM meta))"""
_AUDIT_VIEWS = "code address enterprise establishment branch contact denomination activity meta"


def _orphan_sql() -> str:
    from firmatlas.schemas import RELATIONS

    alias = {
        "Code": "code", "Enterprise": "enterprise", "Establishment": "establishment", "Branch": "branch",
        "KBOAddress": "address", "KBOContact": "contact_all", "Denomination": "denomination_all", "Activity": "activity",
    }
    parts = []
    for r in RELATIONS:
        if r.category:
            keys = f"SELECT code FROM code WHERE category = '{r.category}'"
        elif r.parent == "Enterprise":
            keys = 'SELECT "enterpriseNumber" FROM enterprise'
        else:
            keys = 'SELECT "establishmentNumber" FROM establishment'
        parts.append(
            f"""SELECT '{r.name}' AS relation, '{r.parent}' AS parent, count(*) AS "orphanRows", count(DISTINCT "{r.column}") AS "orphanValues"
FROM {alias[r.child]} WHERE "{r.column}" IS NOT NULL AND "{r.column}" NOT IN ({keys})"""
        )
    return "\nUNION ALL ".join(parts)


ORACLE = {
    "stage_code": with_views("code", "SELECT * FROM code"),
    "stage_enterprise": f"""
SELECT c_name AS "enterpriseNumber", CASE WHEN c_acctbal >= 0 THEN 'AC' ELSE 'ST' END AS "KBOstatusCode",
  cast(c_nationkey AS string) AS "juridicalSituationCode", c_mktsegment AS "typeOfEnterpriseCode",
  CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS "juridicalFormCode", CASE WHEN c_custkey % 8 = 0 THEN c_mktsegment END AS "juridicalFormCACCode",
  {_day("c_custkey", "DATE '1990-01-01' + cast(c_custkey % 9000 AS integer)", "'2024-05-06'")} AS "startDate"
FROM customer""",
    "stage_establishment": _unit_sql(0, "2.", "establishmentNumber"),
    "stage_branch": _unit_sql(2, "9.", "id"),
    "stage_address": with_views("address", ADDRESS_SQL),
    "stage_contact": "WITH "
    + _CONTACT_ROWS
    + """
SELECT "entityNumber", "entityContactCode", "conctactTypeCode", arg_min(value, o_orderkey) AS value,
  CASE WHEN "entityContactCode" = 'ENT' THEN "entityNumber" END AS "enterpriseId",
  CASE WHEN "entityContactCode" = 'EST' THEN "entityNumber" END AS "establishmentId"
FROM contacts GROUP BY 1, 2, 3""",
    "stage_denomination": with_views("denomination", 'SELECT *, cast(NULL AS string) AS "establishmentId" FROM denomination'),
    "stage_activity": with_views(
        "activity",
        "SELECT * FROM activity WHERE right(\"naceCode\", 1) NOT IN ('7', '8')",
    ),
    "stage_meta": "SELECT cast(n_regionkey AS string) AS variable, arg_min(n_name, n_nationkey) AS value FROM nation GROUP BY 1",
    "malformed_start_dates": "SELECT count(*) AS malformed FROM customer WHERE c_custkey % 17 <> 0 AND c_custkey % 19 = 0",
    "load_dedupe": _first_sql("true"),
    "load_insert": f"{_MERGE} SELECT * FROM stored UNION ALL SELECT i.* FROM incoming i ANTI JOIN stored {_KEYS}",
    "load_upsert": f"{_MERGE} SELECT * FROM incoming UNION ALL SELECT s.* FROM stored s ANTI JOIN incoming {_KEYS}",
    "load_audit": with_views(
        _AUDIT_VIEWS,
        """SELECT *, loaded - expected AS difference, CASE WHEN loaded = expected THEN 'MATCH' ELSE 'MISMATCH' END AS status,
  loaded < expected AS incomplete FROM audit""",
        f"{_CONTACT_ROWS}, {_ACTIVITY_ROWS}, {_AUDIT}",
    ),
    "load_all_audit": with_views(
        _AUDIT_VIEWS,
        f"""SELECT "table", expected, expected AS loaded, 'MATCH' AS status,
  CASE WHEN "table" IN ({", ".join(f"'{t}'" for t in AWKWARD)}) THEN expected END AS awkward FROM audit""",
        f"{_CONTACT_ROWS}, {_ACTIVITY_ROWS}, {_AUDIT}",
    ),
    "load_missing": with_views(
        _AUDIT_VIEWS,
        """SELECT "table", expected, expected AS loaded, 'MATCH' AS status, "table" IN ('Branch', 'Enterprise') AS reloaded FROM audit""",
        f"{_CONTACT_ROWS}, {_ACTIVITY_ROWS}, {_AUDIT}",
    ),
    "load_actions": with_views(
        _AUDIT_VIEWS,
        """SELECT "table", expected, loaded, CASE WHEN loaded < expected THEN 'LOAD' ELSE 'skip' END AS action FROM audit""",
        f"{_CONTACT_ROWS}, {_ACTIVITY_ROWS}, {_AUDIT}",
    ),
    "orphan_check": with_views(
        "code enterprise establishment branch address contact denomination activity",
        _orphan_sql(),
        """contact_all AS (SELECT *, cast(NULL AS string) AS "establishmentId" FROM contact),
  denomination_all AS (SELECT *, cast(NULL AS string) AS "establishmentId" FROM denomination)""",
    ),
    "table_reset": with_views(
        "code branch meta",
        """SELECT 'Code' AS "table", count(*) AS n FROM code UNION ALL SELECT 'Branch', count(*) FROM branch
UNION ALL SELECT 'Meta', count(*) FROM meta
UNION ALL SELECT unnest(['Enterprise', 'Establishment', 'KBOAddress', 'KBOContact', 'Denomination', 'Activity']), 0""",
    ),
    "csv_load": with_views("address", ADDRESS_SQL),
    "incremental_load": f"""
SELECT "establishmentNumber", CASE WHEN o_orderkey % 17 = 0 THEN '2003-02-01' ELSE "startDate" END AS "startDate",
  CASE WHEN o_orderkey % 17 = 0 THEN "enterpriseNumber" || ',' || chr(10) || '"9"' ELSE "enterpriseNumber" END AS "enterpriseNumber"
FROM (SELECT o_orderkey, '2.' || o_orderkey AS "establishmentNumber", {_day("o_orderkey", "o_orderdate", "'2024-05-06'")} AS "startDate",
  '0.' || o_custkey AS "enterpriseNumber" FROM orders WHERE o_orderkey % 3 = 0)""",
}
ORACLE["orphan_check_filtered"] = ORACLE["orphan_check"]
ORACLE["audit_digests"] = with_views(
    _AUDIT_VIEWS,
    """SELECT "table", expected, loaded, CASE WHEN expected = loaded THEN 'MATCH' ELSE 'MISMATCH' END AS status, loaded < expected AS incomplete,
  "table" NOT IN ('Branch', 'Establishment') AS whole FROM (
  SELECT "table", expected - CASE WHEN "table" = 'Establishment' THEN 1 ELSE 0 END AS expected,
    expected - CASE WHEN "table" = 'Branch' THEN (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 2 AND o_orderkey % 17 = 0) ELSE 0 END AS loaded
  FROM audit)""",
    f"{_CONTACT_ROWS}, {_ACTIVITY_ROWS}, {_AUDIT}",
)
