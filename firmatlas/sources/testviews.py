"""The test tables shaped like the registry, once as DataFrames and once as SQL.

Narrow expressions over the given tables; only activities need a join (line -> order).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from firmatlas.operators.keyed import dealt, task_count

RUBRIC_POS = (
    "cast(concat(l_linenumber, lpad(l_partkey, 12, '0'), lpad(l_suppkey, 10, '0'), "
    "lpad(cast(round(l_extendedprice * 100) as bigint), 12, '0')) as decimal(38, 0))"
)
#: Bytes of stored orders whose texts one task parses.
PARSE_BYTES = 1 << 20
NACE_CODE = "cast(10000 + (p_key * 7919) % 89999 as string)"


def nine(key: str) -> str:
    digits = f"lpad(cast({key} as string), 9, '0')"
    return f"concat_ws('.', substr({digits}, 1, 3), substr({digits}, 4, 3), substr({digits}, 7, 3))"


def company(key: str) -> str:
    return f"concat('0', {nine(key)})"


def unit(prefix: str, key: str) -> str:
    return f"concat('{prefix}', {nine(key)})"


class RegistryTables(Mapping):
    """The nine registry tables by name, each built when it is first asked for."""

    ATTRIBUTES = {
        "Code": "code",
        "Enterprise": "enterprise",
        "Establishment": "establishment",
        "Branch": "branch",
        "KBOAddress": "address",
        "KBOContact": "contact",
        "Denomination": "denomination",
        "Activity": "activity",
        "Meta": "meta",
    }

    def __init__(self, views: TestViews, activity: str = "activity"):
        self.views = views
        self.attributes = {**self.ATTRIBUTES, "Activity": activity}

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self.views, self.attributes[name])

    def __iter__(self) -> Iterator[str]:
        return iter(self.attributes)

    def __len__(self) -> int:
        return len(self.attributes)


class TestViews:
    """Registry-shaped views of one data folder. Every view is lazy."""

    __test__ = False

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._read: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    def tables(self) -> RegistryTables:
        return RegistryTables(self)

    def market_tables(self) -> RegistryTables:
        """As ``tables``; activities keep repeated rows, which the hits make distinct anyway."""
        return RegistryTables(self, "activity_rows")

    @cached_property
    def enterprise(self) -> DataFrame:
        return self.table("customer").selectExpr(
            f"{company('c_custkey')} as enterpriseNumber",
            "if(c_acctbal >= 0, 'AC', 'ST') as KBOstatusCode",
            "lpad(cast(c_nationkey % 8 as string), 3, '0') as juridicalSituationCode",
            "if(c_custkey % 2 = 0, '2', '1') as typeOfEnterpriseCode",
            "if(c_custkey % 4 <> 0, c_mktsegment, null) as juridicalFormCode",
            "if(c_custkey % 8 = 0, c_mktsegment, null) as juridicalFormCACCode",
            "cast(date_add(date'1990-01-01', cast(c_custkey % 9000 as int)) as timestamp_ntz) as startDate",
        )

    @cached_property
    def establishment(self) -> DataFrame:
        return self.table("orders").where("o_orderkey % 3 = 0").selectExpr(
            f"{unit('2.', 'o_orderkey')} as establishmentNumber",
            "o_orderdate as startDate",
            f"{company('o_custkey')} as enterpriseNumber",
        )

    @cached_property
    def branch(self) -> DataFrame:
        return self.table("orders").where("o_orderkey % 3 = 2").selectExpr(
            f"{unit('9.', 'o_orderkey')} as id",
            "o_orderdate as startDate",
            f"{company('o_custkey')} as enterpriseNumber",
        )

    @cached_property
    def activity_raw(self) -> DataFrame:
        lines = self.table("lineitem").withColumnRenamed("l_partkey", "p_key")
        return lines.join(
            self.table("orders"), lines["l_orderkey"] == self.table("orders")["o_orderkey"]
        ).selectExpr(
            f"case o_orderkey % 3 when 0 then {unit('2.', 'o_orderkey')} when 1 then {company('o_custkey')}"
            f" else {unit('9.', 'o_orderkey')} end as entityNumber",
            "lpad(cast(l_linenumber as string), 3, '0') as activityGroupCode",
            "case l_returnflag when 'A' then '2003' when 'N' then '2008' else '2025' end as naceVersion",
            f"{NACE_CODE} as naceCode",
            "case when l_linenumber <= 3 then 'MAIN' when l_linenumber <= 5 then 'SECO' else 'ANCI' end"
            " as classification",
        )

    @cached_property
    def activity_rows(self) -> DataFrame:
        return self._linked(self.activity_raw)

    @cached_property
    def activity(self) -> DataFrame:
        return self._linked(self.activity_raw.distinct())

    @staticmethod
    def _linked(rows: DataFrame) -> DataFrame:
        return rows.selectExpr(
            "*",
            r"if(entityNumber rlike r'^[0-9]{4}[.][0-9]{3}[.][0-9]{3}$', entityNumber, null) as enterpriseId",
            "if(startswith(entityNumber, '2.'), entityNumber, null) as establishmentId",
        )

    @cached_property
    def address(self) -> DataFrame:
        def rows(kind: str, condition: str) -> DataFrame:
            return self.table("customer").where(condition).selectExpr(
                f"{company('c_custkey')} as entityNumber",
                f"'{kind}' as typeOfAddressCode",
                "if(c_custkey % 5 = 0, 'Nederland', null) as countryNL",
                "if(c_custkey % 7 = 0, 'Pays-Bas', null) as countryFR",
                "if(c_custkey % 11 = 0, '', cast(1000 + c_nationkey * 100 + c_custkey % 7 as string)) as zipcode",
                f"if(c_custkey % 3 <> 0, concat('Stad {kind} ', c_nationkey), null) as municipalityNL",
                f"if(c_custkey % 10 <> 0, concat('Ville {kind} ', c_nationkey), null) as municipalityFR",
                "if(c_custkey % 4 <> 0, concat('Straat ', c_custkey % 50), null) as streetNL",
                "if(c_custkey % 6 <> 0, concat('Rue ', c_custkey % 50), null) as streetFR",
                "cast(c_custkey % 200 + 1 as string) as houseNumber",
                "cast(null as string) as box",
                "cast(null as string) as extraAddressInfo",
                "cast(null as timestamp_ntz) as dateStrikingOff",
                f"{company('c_custkey')} as enterpriseId",
                "cast(null as string) as establishmentId",
            )

        return rows("REGO", "c_custkey % 13 <> 0").unionByName(rows("BAET", "c_custkey % 9 = 0"))

    @cached_property
    def code(self) -> DataFrame:
        fixed = self.spark.sql(
            "select * from values ('Status', 'AC', 'Actief'), ('Status', 'ST', 'Stopgezet'), "
            "('ContactType', 'EMAIL', 'E-mail'), ('ContactType', 'TEL', 'Telefoon') "
            "as t(category, code, description)"
        )
        situations = self.table("nation").where("n_nationkey < 7").selectExpr(
            "'JuridicalSituation' as category",
            "lpad(cast(n_nationkey as string), 3, '0') as code",
            "n_name as description",
        )
        forms = (
            self.table("customer")
            .where("c_mktsegment <> 'FURNITURE'")
            .select("c_mktsegment")
            .distinct()
            .selectExpr(
                "'JuridicalForm' as category",
                "c_mktsegment as code",
                "concat('Vorm ', c_mktsegment) as description",
            )
        )
        return fixed.unionByName(situations).unionByName(forms)

    @cached_property
    def denomination(self) -> DataFrame:
        def rows(condition: str, language: str, kind: str, text: str) -> DataFrame:
            return self.table("customer").where(condition).selectExpr(
                f"{company('c_custkey')} as entityNumber",
                f"'{language}' as languageCode",
                f"'{kind}' as typeOfDenominationCode",
                f"{text} as denomination",
                f"{company('c_custkey')} as enterpriseId",
                "cast(null as string) as establishmentId",
            )

        return (
            rows("c_custkey % 2 = 0", "FR", "001", "concat('SA ', c_name)")
            .unionByName(rows("c_custkey % 3 = 0", "NL", "001", "concat(c_name, ' NV')"))
            .unionByName(rows("c_custkey % 3 <> 2", "NL", "002", "concat('Handel ', c_name)"))
            .unionByName(rows("c_custkey % 5 <> 0", "EN", "003", "concat(c_name, ' Ltd')"))
        )

    @cached_property
    def contact(self) -> DataFrame:
        def rows(condition: str, kind: str, text: str) -> DataFrame:
            return self.table("customer").where(condition).selectExpr(
                f"{company('c_custkey')} as entityNumber",
                "'ENT' as entityContactCode",
                f"'{kind}' as conctactTypeCode",
                f"{text} as value",
                f"{company('c_custkey')} as enterpriseId",
                "cast(null as string) as establishmentId",
            )

        return rows("c_custkey % 2 = 0", "EMAIL", "concat('info', c_custkey, '@example.org')").unionByName(
            rows("c_custkey % 3 = 0", "WEB", "concat('example.org/', c_custkey)")
        )

    @cached_property
    def meta(self) -> DataFrame:
        return self.table("region").selectExpr(
            "r_name as variable", "cast(r_regionkey as string) as value"
        )

    @cached_property
    def filing_ref(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey as filing_id",
            "concat('0', lpad(cast(o_custkey as string), 9, '0')) as enterpriseNumber",
            "concat(year(o_orderdate), '-', lpad(cast(o_orderkey as string), 8, '0')) as referenceNumber",
            "date_format(o_orderdate, 'yyyy-MM-dd') as endDate",
            "if(o_orderkey % 10 <> 0, cast(date_add(cast(o_orderdate as date), 90) as string), null) as depositDate",
            "year(o_orderdate) as fiscalYear",
            "if(o_orderkey % 4 <> 0, concat('Naam 0', lpad(cast(o_custkey as string), 9, '0')), null)"
            " as enterpriseName",
            "case when o_orderstatus = 'O' then 'PDF' when o_orderkey % 7 <> 0 then 'XBRL' end as importFileType",
            "o_orderkey as pos",
        )

    @cached_property
    def rubric(self) -> DataFrame:
        """Account lines. ``pos`` packs line, part, supplier and price into one ordered number,
        so no filing has to be numbered in one task."""
        codes = ", ".join(f"'{code}'" for code in RUBRIC_CODES)
        return self.table("lineitem").selectExpr(
            "l_orderkey as filing_id",
            f"element_at(array({codes}), l_linenumber) as code",
            "cast(cast(l_extendedprice as decimal(18, 2)) as string) as value",
            "if(l_linestatus = 'O', 'N', 'NM1') as period",
            f"{RUBRIC_POS} as pos",
        )

    @staticmethod
    def texts_dealt(orders: DataFrame) -> DataFrame:
        """Orders by key, in tasks for the texts that are made of them: a file of small rows has so few splits
        that most of a cluster would wait while they parse. By key, a filing's lines need no further shuffle."""
        return dealt(orders, "o_orderkey", tasks=task_count(orders, PARSE_BYTES))

    @cached_property
    def filing_text(self) -> DataFrame:
        orders = self.texts_dealt(self.table("orders").where("o_orderstatus = 'O'"))
        return orders.selectExpr(
            "o_orderkey as filing_id",
            r"concat('20/58 ', 1 + o_orderkey % 9, '.250.000 1.000.000\nnote\n9904 ( ', 10 + o_orderkey % 80,"
            r" '.500 ) 10.000\nC. Beleggingen (staat 1)\n22\n', 10 + o_orderkey % 80, '.117.997.323') as text",
        )

    @cached_property
    def nace_catalog(self) -> DataFrame:
        return (
            self.table("part")
            .withColumnRenamed("p_partkey", "p_key")
            .selectExpr(
                "case p_size % 3 when 0 then 'Nace2003' when 1 then 'Nace2008' else 'Nace2025' end as Category",
                f"{NACE_CODE} as Code",
                "'NL' as Language",
                "p_name as Description",
            )
            .distinct()
        )


# Account codes of the seven line numbers.
RUBRIC_CODES = ["70", "9904", "1003", "70/76A", "20/58", "10/15", "54/58"]


def _nine(k: str) -> str:
    digits = f"lpad(cast({k} AS string), 9, '0')"
    return f"substr({digits}, 1, 3) || '.' || substr({digits}, 4, 3) || '.' || substr({digits}, 7, 3)"


def _company(k: str) -> str:
    return f"'0' || {_nine(k)}"


def _address(kind: str, condition: str) -> str:
    return f"""
  SELECT {_company("c_custkey")} AS "entityNumber", '{kind}' AS "typeOfAddressCode",
    CASE WHEN c_custkey % 5 = 0 THEN 'Nederland' END AS "countryNL",
    CASE WHEN c_custkey % 7 = 0 THEN 'Pays-Bas' END AS "countryFR",
    CASE WHEN c_custkey % 11 = 0 THEN '' ELSE cast(1000 + c_nationkey * 100 + c_custkey % 7 AS string) END AS zipcode,
    CASE WHEN c_custkey % 3 <> 0 THEN 'Stad {kind} ' || c_nationkey END AS "municipalityNL",
    CASE WHEN c_custkey % 10 <> 0 THEN 'Ville {kind} ' || c_nationkey END AS "municipalityFR",
    CASE WHEN c_custkey % 4 <> 0 THEN 'Straat ' || c_custkey % 50 END AS "streetNL",
    CASE WHEN c_custkey % 6 <> 0 THEN 'Rue ' || c_custkey % 50 END AS "streetFR",
    cast(c_custkey % 200 + 1 AS string) AS "houseNumber", {_company("c_custkey")} AS "enterpriseId",
    cast(NULL AS string) AS "establishmentId"
  FROM customer WHERE {condition}"""


def _name(condition: str, language: str, kind: str, text: str) -> str:
    return (
        f"""SELECT {_company("c_custkey")} AS "entityNumber", '{language}' AS "languageCode", """
        f"""'{kind}' AS "typeOfDenominationCode", {text} AS denomination, """
        f"""{_company("c_custkey")} AS "enterpriseId" FROM customer WHERE {condition}"""
    )


VIEW_SQL = {
    "enterprise": f"""
  SELECT {_company("c_custkey")} AS "enterpriseNumber",
    CASE WHEN c_acctbal >= 0 THEN 'AC' ELSE 'ST' END AS "KBOstatusCode",
    lpad(cast(c_nationkey % 8 AS string), 3, '0') AS "juridicalSituationCode",
    CASE WHEN c_custkey % 2 = 0 THEN '2' ELSE '1' END AS "typeOfEnterpriseCode",
    CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS "juridicalFormCode",
    CASE WHEN c_custkey % 8 = 0 THEN c_mktsegment END AS "juridicalFormCACCode",
    DATE '1990-01-01' + cast(c_custkey % 9000 AS integer) AS "startDate"
  FROM customer""",
    "establishment": f"""
  SELECT '2.' || {_nine("o_orderkey")} AS "establishmentNumber", o_orderdate AS "startDate",
    {_company("o_custkey")} AS "enterpriseNumber"
  FROM orders WHERE o_orderkey % 3 = 0""",
    "branch": f"""
  SELECT '9.' || {_nine("o_orderkey")} AS id, o_orderdate AS "startDate",
    {_company("o_custkey")} AS "enterpriseNumber"
  FROM orders WHERE o_orderkey % 3 = 2""",
    "activity_raw": f"""
  SELECT CASE o_orderkey % 3 WHEN 0 THEN '2.' || {_nine("o_orderkey")}
      WHEN 1 THEN {_company("o_custkey")} ELSE '9.' || {_nine("o_orderkey")} END AS "entityNumber",
    lpad(cast(l_linenumber AS string), 3, '0') AS "activityGroupCode",
    CASE l_returnflag WHEN 'A' THEN '2003' WHEN 'N' THEN '2008' ELSE '2025' END AS "naceVersion",
    cast(10000 + (l_partkey * 7919) % 89999 AS string) AS "naceCode",
    CASE WHEN l_linenumber <= 3 THEN 'MAIN' WHEN l_linenumber <= 5 THEN 'SECO' ELSE 'ANCI' END AS classification
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "activity": """
  SELECT DISTINCT *,
    CASE WHEN regexp_matches("entityNumber", '^[0-9]{4}[.][0-9]{3}[.][0-9]{3}$') THEN "entityNumber" END AS "enterpriseId",
    CASE WHEN "entityNumber" LIKE '2.%' THEN "entityNumber" END AS "establishmentId"
  FROM activity_raw""",
    "address": _address("REGO", "c_custkey % 13 <> 0") + "\n  UNION ALL" + _address("BAET", "c_custkey % 9 = 0"),
    "code": """
  SELECT * FROM (VALUES ('Status', 'AC', 'Actief'), ('Status', 'ST', 'Stopgezet'),
    ('ContactType', 'EMAIL', 'E-mail'), ('ContactType', 'TEL', 'Telefoon')) AS t(category, code, description)
  UNION ALL SELECT 'JuridicalSituation', lpad(cast(n_nationkey AS string), 3, '0'), n_name FROM nation WHERE n_nationkey < 7
  UNION ALL SELECT DISTINCT 'JuridicalForm', c_mktsegment, 'Vorm ' || c_mktsegment FROM customer WHERE c_mktsegment <> 'FURNITURE'""",
    "denomination": "\n  UNION ALL ".join(
        [
            _name("c_custkey % 2 = 0", "FR", "001", "'SA ' || c_name"),
            _name("c_custkey % 3 = 0", "NL", "001", "c_name || ' NV'"),
            _name("c_custkey % 3 <> 2", "NL", "002", "'Handel ' || c_name"),
            _name("c_custkey % 5 <> 0", "EN", "003", "c_name || ' Ltd'"),
        ]
    ),
    "contact": f"""
  SELECT {_company("c_custkey")} AS "entityNumber", 'ENT' AS "entityContactCode", 'EMAIL' AS "conctactTypeCode",
    'info' || c_custkey || '@example.org' AS value, {_company("c_custkey")} AS "enterpriseId"
  FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT {_company("c_custkey")}, 'ENT', 'WEB', 'example.org/' || c_custkey, {_company("c_custkey")}
  FROM customer WHERE c_custkey % 3 = 0""",
    "meta": """
  SELECT r_name AS variable, cast(r_regionkey AS string) AS value FROM region""",
    "filing_ref": """
  SELECT o_orderkey AS filing_id, '0' || lpad(cast(o_custkey AS string), 9, '0') AS "enterpriseNumber",
    strftime(o_orderdate, '%Y') || '-' || lpad(cast(o_orderkey AS string), 8, '0') AS "referenceNumber",
    strftime(o_orderdate, '%Y-%m-%d') AS "endDate",
    CASE WHEN o_orderkey % 10 <> 0 THEN strftime(o_orderdate + INTERVAL 90 DAY, '%Y-%m-%d') END AS "depositDate",
    cast(year(o_orderdate) AS integer) AS "fiscalYear",
    CASE WHEN o_orderkey % 4 <> 0 THEN 'Naam 0' || lpad(cast(o_custkey AS string), 9, '0') END AS "enterpriseName",
    CASE WHEN o_orderstatus = 'O' THEN 'PDF' WHEN o_orderkey % 7 <> 0 THEN 'XBRL' END AS "importFileType",
    o_orderkey AS pos
  FROM orders""",
    "rubric": """
  SELECT l_orderkey AS filing_id,
    CASE l_linenumber WHEN 1 THEN '70' WHEN 2 THEN '9904' WHEN 3 THEN '1003' WHEN 4 THEN '70/76A'
      WHEN 5 THEN '20/58' WHEN 6 THEN '10/15' WHEN 7 THEN '54/58' END AS code,
    cast(cast(l_extendedprice AS decimal(18, 2)) AS string) AS value,
    CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'NM1' END AS period,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
      l_quantity, l_discount, l_tax, l_shipdate) AS pos
  FROM lineitem""",
    "filing_text": """
  SELECT o_orderkey AS filing_id, '20/58 ' || (1 + o_orderkey % 9) || '.250.000 1.000.000' || chr(10) || 'note' || chr(10)
    || '9904 ( ' || (10 + o_orderkey % 80) || '.500 ) 10.000' || chr(10) || 'C. Beleggingen (staat 1)' || chr(10)
    || '22' || chr(10) || (10 + o_orderkey % 80) || '.117.997.323' AS text
  FROM orders WHERE o_orderstatus = 'O'""",
    "nace_catalog": """
  SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN 'Nace2003' WHEN 1 THEN 'Nace2008' ELSE 'Nace2025' END AS "Category",
    cast(10000 + (p_partkey * 7919) % 89999 AS string) AS "Code", 'NL' AS "Language", p_name AS "Description"
  FROM part""",
}

_NEEDS = {"activity": ["activity_raw"]}


def with_views(views: str, body: str, extra: str = "") -> str:
    """SQL text: the named views as CTEs, further CTEs in ``extra``, then the query."""
    names: list[str] = []
    for view in views.split():
        names += [v for v in [*_NEEDS.get(view, []), view] if v not in names]
    ctes = [f"{name} AS ({VIEW_SQL[name]})" for name in names]
    if extra:
        ctes.append(extra.strip())
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()
