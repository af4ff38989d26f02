"""Registered filing queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmatlas.functions.amounts import imported_number, leading_number
from firmatlas.operators.filings import latest_per_year, recent_filings, requested_filings
from firmatlas.operators.filings import requested_years as years_of
from firmatlas.operators.rubrics import (
    ALL_MEASURES,
    INSURER_CODES,
    INSURER_EQUITY,
    INSURER_NET_RESULT,
    MEASURE_CODES,
    REVENUE_AGGREGATE,
    REVENUE_DIRECT,
    REVENUE_PARTS,
    current_period,
    filing_measures,
)
from firmatlas.operators.text_rubrics import coded_rubrics, insurer_rubrics, text_rubrics, with_lines
from firmatlas.plans import measure_store
from firmatlas.plans.financials import (
    HISTORY_MEASURES,
    annual_summary,
    company_history,
    published_financials,
)
from firmatlas.session import work_folder
from firmatlas.sources.csv_files import EXPORT_NAME, EXPORT_REFERENCE
from firmatlas.sources.payloads import (
    accounting_rubrics,
    deposit_rows,
    export_headers,
    export_rubrics,
    reference_rows,
)
from firmatlas.sources.testviews import TestViews, with_views

YEARS = [1999, 1998, 1996]
REF_COLUMNS = ["enterpriseNumber", "fiscalYear", "filing_id", "referenceNumber", "depositDate"]


def _views(spark: SparkSession, folder: str) -> TestViews:
    return TestViews(spark, folder)


def reference_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Payload texts in all shapes: bare list, the four list fields, and an object without any."""
    good = (
        "named_struct('ReferenceNumber', concat(' ', o_orderkey, ' '), 'DepositDate', date_format(o_orderdate, 'yyyy-MM-dd'),"
        " 'ExerciseDates', named_struct('endDate', if(o_orderkey % 7 = 0, 'soon', date_format(o_orderdate, 'yyyy-MM-dd'))),"
        " 'EnterpriseName', concat('Naam ', o_custkey))"
    )
    blank = good.replace("concat(' ', o_orderkey, ' ')", "if(o_orderkey % 2 = 0, ' ', null)")
    listed = f"array({blank}, {good})"
    shape = (
        f"case o_orderkey % 6 when 0 then to_json({listed}) when 1 then to_json(named_struct('References', {listed}))"
        f" when 2 then to_json(named_struct('references', {listed})) when 3 then to_json(named_struct('References', 'none', 'Deposits', {listed}))"
        f" when 4 then to_json(named_struct('deposits', {listed})) else to_json(named_struct('other', {listed})) end"
    )
    payloads = _views(spark, folder).table("orders").selectExpr(
        "cast(o_custkey as string) as enterpriseNumber", f"{shape} as payload"
    )
    return reference_rows(payloads).drop("accountingDataUrl", "filing_id")


def accounting_payloads(spark: SparkSession, folder: str) -> DataFrame:
    payloads = _views(spark, folder).table("orders").selectExpr(
        "cast(o_orderkey as string) as referenceNumber",
        "case o_orderkey % 5 when 0 then null when 1 then to_json(named_struct('EnterpriseName', concat('N', o_custkey)))"
        " else to_json(named_struct('EnterpriseName', concat('N', o_custkey), 'Rubrics', array("
        "named_struct('Code', '70', 'Value', cast(cast(o_totalprice as decimal(18, 2)) as string), 'Period', if(o_orderkey % 2 = 0, 'N', 'NM1')),"
        "named_struct('Code', '9904', 'Value', cast(o_custkey as string), 'Period', null)))) end as payload",
    )
    return accounting_rubrics(payloads)


def deposit_listing(spark: SparkSession, folder: str) -> DataFrame:
    payloads = _views(spark, folder).table("orders").selectExpr(
        "cast(o_custkey as string) as enterpriseNumber",
        "if(o_orderkey % 4 = 0, '{}', to_json(named_struct('content', array("
        "named_struct('id', concat('a', o_orderkey), 'reference', 'r1', 'periodEndDateYear', year(o_orderdate), 'importFileType', 'PDF'),"
        "named_struct('id', concat('b', o_orderkey), 'reference', 'r2', 'periodEndDateYear', year(o_orderdate) - 1, 'importFileType', null)"
        ")))) as payload",
    )
    return deposit_rows(payloads)


def _export_rows(views: TestViews) -> DataFrame:
    rows = [
        f"named_struct('key', '{EXPORT_NAME}', 'value', concat('N', o_custkey))",
        f"named_struct('key', '{EXPORT_REFERENCE}', 'value', concat('R', o_orderkey))",
        "named_struct('key', '70', 'value', cast(cast(o_totalprice as decimal(18, 2)) as string))",
        f"named_struct('key', '{EXPORT_NAME}', 'value', concat('M', o_custkey))",
        "named_struct('key', if(o_orderkey % 3 = 0, 'A9904', '9904'), 'value', '5')",
    ]
    return views.table("orders").selectExpr(
        "o_orderkey as filing_id", f"posexplode(array({', '.join(rows)})) as (pos, entry)"
    ).select("filing_id", "pos", "entry.key", "entry.value")


def export_lines(spark: SparkSession, folder: str) -> DataFrame:
    return export_rubrics(_export_rows(_views(spark, folder)))


def export_summary(spark: SparkSession, folder: str) -> DataFrame:
    return export_headers(_export_rows(_views(spark, folder)), EXPORT_NAME, EXPORT_REFERENCE)


def latest_filing(spark: SparkSession, folder: str) -> DataFrame:
    return latest_per_year(_views(spark, folder).filing_ref).select(*REF_COLUMNS)


def recent_years(spark: SparkSession, folder: str) -> DataFrame:
    return recent_filings(_views(spark, folder).filing_ref, 3).select(*REF_COLUMNS)


def explicit_years(spark: SparkSession, folder: str) -> DataFrame:
    return recent_filings(_views(spark, folder).filing_ref, years=YEARS).select(*REF_COLUMNS)


def requested_years(spark: SparkSession, folder: str) -> DataFrame:
    return requested_filings(_views(spark, folder).filing_ref, YEARS).select(*REF_COLUMNS)


NOISY_VALUE = (
    "case when l_partkey % 11 = 0 then 'n/a' when l_partkey % 13 = 0 then '' "
    "when l_partkey % 7 = 0 then concat(' -', l_suppkey, ',50') when l_partkey % 5 = 0 then concat(l_suppkey, '.250.000') "
    "when l_partkey % 17 = 0 then concat(l_suppkey, 'e2 EUR') else {value} end"
)


def rubric_values(spark: SparkSession, folder: str) -> DataFrame:
    """Number parsing of coded lines and of imported cells, over every line."""
    lines = _views(spark, folder).table("lineitem")
    value = NOISY_VALUE.format(value="cast(l_quantity as string)")
    noisy = lines.selectExpr(f"{value} as value", "if(l_linestatus = 'O', 'N', 'NM1') as period")
    return (
        noisy.filter(current_period())
        .groupBy("value")
        .agg(F.count("*").alias("n"))
        .select(
            "value",
            "n",
            leading_number(F.col("value")).alias("leading"),
            imported_number(F.col("value")).alias("imported"),
        )
    )


def filing_measures_query(spark: SparkSession, folder: str) -> DataFrame:
    views = _views(spark, folder)
    rubric = views.rubric.withColumn("filing_id", F.col("filing_id"))
    noisy = rubric.withColumn(
        "value",
        F.expr("case when filing_id % 6 = 0 and code = '70/76A' then 'n/a' when filing_id % 5 = 0 then concat(' ', replace(value, '.', ',')) "
               "when filing_id % 7 = 0 and code = '9904' then concat('-', value) else value end"),
    )
    coded = noisy.withColumn(
        "code", F.expr("case when filing_id % 4 = 1 and code = '70' then '72' when filing_id % 4 = 1 and code = '20/58' then '76A' else code end")
    )
    return filing_measures(coded, ["filing_id"])


def annual_summary_query(spark: SparkSession, folder: str) -> DataFrame:
    views = _views(spark, folder)
    filings = views.filing_ref.select("filing_id", "enterpriseNumber", "fiscalYear")
    return annual_summary(filings, views.rubric)


def coded_text_lines(spark: SparkSession, folder: str) -> DataFrame:
    return coded_rubrics(with_lines(_views(spark, folder).filing_text)).select(
        "filing_id", F.posexplode("coded").alias("pos", "entry")
    ).select("filing_id", F.col("pos").cast("bigint").alias("pos"), "entry.code", "entry.value")


def insurer_lines(spark: SparkSession, folder: str) -> DataFrame:
    return insurer_rubrics(with_lines(_views(spark, folder).filing_text)).select(
        "filing_id", F.explode("insurer").alias("entry")
    ).select("filing_id", "entry.code", "entry.value")


def text_rubrics_query(spark: SparkSession, folder: str) -> DataFrame:
    return text_rubrics(_views(spark, folder).filing_text).withColumn("pos", F.col("pos").cast("bigint"))


def document_rubrics(spark: SparkSession, folder: str) -> DataFrame:
    """The text parser over the whole of every document, with account lines at its end."""
    text = (
        "concat(text, '\\n20/58 ', n_chars, '.000 1.000\\nC. Placements (note 3)\\n11\\n\\n( ',"
        " n_chars, '.459 )\\n70/76A ', doc_id, ',5')"
    )
    texts = _views(spark, folder).table("documents").selectExpr("doc_id as filing_id", f"{text} as text")
    return text_rubrics(texts).select("filing_id", "code", "value")


def company_history_query(spark: SparkSession, folder: str) -> DataFrame:
    views = _views(spark, folder)
    return company_history(views.filing_ref, views.rubric, 4)


def published(spark: SparkSession, folder: str) -> DataFrame:
    views = _views(spark, folder)
    return published_financials(views.filing_ref, views.rubric, views.filing_text, YEARS)


def _stored_measures(views: TestViews) -> DataFrame:
    """Measures of all lines, landed in three batches by filing and stored by two updates."""
    spark, folder = views.spark, work_folder(views.spark, "measure-store")
    for turn, batches in enumerate((("2024-01", "2024-02"), ("2024-03",))):
        for batch in batches:
            part = int(batch[-1])
            own = views.rubric.filter(F.col("filing_id") % 3 + 1 == part)
            # The second batch first has lines that a later one replaces.
            wrong = views.rubric.filter(F.lit(part == 2) & (F.col("filing_id") % 3 == 2)).withColumn("value", F.lit("1"))
            measure_store.land(own.unionByName(wrong), folder, batch)
        if measure_store.update(spark, folder) != list(batches):
            raise ValueError("an update must read the new batches and no others")
    return measure_store.measures(spark, folder)


def company_history_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The history out of measures that were stored as lines landed."""
    views = _views(spark, folder)
    return company_history(views.filing_ref, None, 4, stored=_stored_measures(views))


def published_stored(spark: SparkSession, folder: str) -> DataFrame:
    views = _views(spark, folder)
    return published_financials(views.filing_ref, None, views.filing_text, YEARS, stored=_stored_measures(views))


# Lists of years as jobs are asked for them: explicit, or a base with a length of history.
YEAR_LISTS = {
    "explicit": {"explicit": [1996, 1998, 1998, 1899, 2101]},
    "base alone": {"base": 1997},
    "three years": {"base": 1998, "history": 3},
    "too short": {"base": 1995, "history": 0},
    "too long": {"base": 1999, "history": 40},
}


def year_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Filings chosen for several lists of years."""
    refs = _views(spark, folder).filing_ref
    chosen = [
        recent_filings(refs, years=years_of(**asked)).select(F.lit(label).alias("list"), *REF_COLUMNS) for label, asked in YEAR_LISTS.items()
    ]
    return reduce(DataFrame.unionByName, chosen)


# Every account code that a measure may come from, and its place among the parts of all order lines.
EVERY_CODE = list(dict.fromkeys([*REVENUE_AGGREGATE, *REVENUE_DIRECT, *REVENUE_PARTS, *sum(MEASURE_CODES.values(), [])]))


def every_code(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of filings whose lines go over all account codes."""
    codes = ", ".join(f"'{c}'" for c in EVERY_CODE)
    lines = _views(spark, folder).table("lineitem").selectExpr(
        "l_orderkey as filing_id", f"element_at(array({codes}), cast((l_partkey + l_linenumber * 5) % {len(EVERY_CODE)} + 1 as int)) as code",
        "cast(cast(l_extendedprice as decimal(18, 2)) as string) as value", "if(l_linenumber % 3 = 0, '', 'N') as period",
        "l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + cast(l_quantity as bigint) as pos",
    )
    return filing_measures(lines, ["filing_id"])


#: Labels of insurer statements, Dutch then French, in the order of their codes.
LABEL_TEXTS = {
    "INS_EQUITY": ("A. Eigen vermogen", "A. Capitaux propres"),
    "INS_INVESTMENTS": ("C. Beleggingen (staat 1)", "C. Placements"),
    "INS_UNIT_LINKED_INVESTMENTS": ("D. Beleggingen betreffende de verrichtingen van groep 'leven'", "D. Placements relatifs aux operations de la branche 23"),
    "INS_REINSURANCE_SHARE_TECHNICAL_PROVISIONS": ("Dbis. Deel van de herverzekeraars in de technische voorzieningen", "D.bis. Part des réassureurs dans les provisions techniques"),
    "INS_RECEIVABLES": ("E. Vorderingen", "E. Créances"),
    "INS_TECHNICAL_PROVISIONS": ("C. Technische voorzieningen", "C. Provisions techniques"),
    "INS_LIFE_TECHNICAL_PROVISIONS": ("II. Voorziening voor verzekering leven", "II. Provision d'assurance vie"),
    "INS_CLAIMS_PROVISIONS": ("III. Voorziening voor te betalen schaden", "III. Provision pour sinistres"),
    "INS_REINSURANCE_DEPOSITS": ("F. Deposito's ontvangen van herverzekeraars", "F. Dépôts reçus des réassureurs"),
    "INS_NET_RESULT": ("3. Resultaat van het boekjaar", "3. Résultat de l'exercice"),
}


def insurer_texts(views: TestViews) -> DataFrame:
    """Statements with all ten labels, Dutch or French; an amount stands on its label's line or up to two lines below."""
    parts = []
    for i, texts in enumerate(LABEL_TEXTS.values()):
        dutch, french = (t.replace("'", "\\'") for t in texts)
        amount = f"concat(1 + (o_orderkey + {i}) % 900, '.', lpad(cast(o_custkey % 1000 as string), 3, '0'), '.{100 + i}')"
        signed = f"if((o_orderkey + {i}) % 4 = 0, concat('( ', {amount}, ' )'), {amount})"
        gap = f"element_at(array(' ', '\\n', '\\n{10 + i}\\n', ' (toel. {i})\\n\\n'), cast((o_orderkey + {i}) % 4 + 1 as int))"
        parts.append(f"if(o_custkey % 2 = 0, '{dutch}', '{french}'), {gap}, {signed}, '\\n'")
    orders = views.texts_dealt(views.table("orders").where("o_orderstatus <> 'O'"))
    return orders.selectExpr("o_orderkey as filing_id", f"concat({', '.join(parts)}) as text")


def insurer_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Measures that all ten labels give, through the text parser."""
    found = filing_measures(text_rubrics(insurer_texts(_views(spark, folder))), ["filing_id"])
    return found.select("filing_id", "lineCount", "netResult", "equity", *INSURER_CODES)


QUERIES = {
    "reference_payloads": reference_payloads,
    "accounting_payloads": accounting_payloads,
    "deposit_listing": deposit_listing,
    "export_rubrics": export_lines,
    "export_summary": export_summary,
    "latest_filing": latest_filing,
    "recent_years": recent_years,
    "explicit_years": explicit_years,
    "requested_years": requested_years,
    "rubric_values": rubric_values,
    "filing_measures": filing_measures_query,
    "annual_summary": annual_summary_query,
    "coded_text_lines": coded_text_lines,
    "insurer_rubrics": insurer_lines,
    "text_rubrics": text_rubrics_query,
    "document_rubrics": document_rubrics,
    "company_history": company_history_query,
    "published_financials": published,
    "company_history_stored": company_history_stored,
    "published_financials_stored": published_stored,
    "year_lists": year_lists,
    "every_code": every_code,
    "insurer_measures": insurer_measures,
}

NUMBER = "'^\\s*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)'"
_DOTTED_VALUE = "regexp_replace(value, ',', '.')"
LEADING_SQL = f"try_cast(nullif(regexp_extract({_DOTTED_VALUE}, {NUMBER}, 1), '') AS double)"


def measures_sql(source: str = "rubric", period: str = "period = 'N'") -> str:
    """CTEs: first current line per filing and code, one column per code, measures."""
    codes = ["70/76A", "70", "700", "7000", "701", "7010", "71", "72", "74", "76A"]
    codes += [c for group in MEASURE_CODES.values() for c in group]
    codes += [*INSURER_CODES.values(), "INS_NET_RESULT", "INS_EQUITY"]
    columns = ", ".join(f"max(v) FILTER (code = '{c}') AS \"{c}\"" for c in codes)
    parts = ["70", "71", "72", "74", "76A"]
    total = " + ".join(f'coalesce("{c}", 0.0)' for c in parts)

    def first(names: list[str]) -> str:
        return "coalesce(" + ", ".join(f'"{c}"' for c in [*names, *names][: max(2, len(names))]) + ")"

    special = {
        "netResult": 'coalesce("9904", "990", "9900", "9047", "INS_NET_RESULT")',
        "equity": 'coalesce("10/15", "INS_EQUITY")',
        "employeeCount": f"floor({first(MEASURE_CODES['employeeCount'])} * 10 + 0.5) / 10",
    }
    named = ", ".join(
        f"{special.get(name, first(group))} AS \"{name}\"" for name, group in MEASURE_CODES.items()
    )
    insurer = ", ".join(f'"{code}" AS "{name}"' for name, code in INSURER_CODES.items())
    return f"""firsts AS (
  SELECT filing_id, code, {LEADING_SQL} AS v FROM {source} WHERE {period}
  QUALIFY row_number() OVER (PARTITION BY filing_id, code ORDER BY pos) = 1), wide AS (
  SELECT filing_id, {columns} FROM firsts GROUP BY filing_id), plain AS (
  SELECT filing_id, coalesce("70/76A", "70", "700", "7000", "701", "7010",
      CASE WHEN coalesce({", ".join(f'"{c}"' for c in parts)}) IS NOT NULL THEN {total} END) AS revenue, {named}, {insurer}
  FROM wide), measured AS (
  SELECT *, floor("netResult" / nullif(revenue, 0) * 10000 + 0.5) / 100 AS "marginPercent" FROM plain), counted AS (
  SELECT filing_id, count(*) AS "lineCount" FROM {source} GROUP BY 1), summed AS (
  SELECT c.*, m.* EXCLUDE (filing_id) FROM counted c LEFT JOIN measured m USING (filing_id))"""


_LATEST = """latest AS (SELECT * FROM filing_ref QUALIFY row_number() OVER (
  PARTITION BY "enterpriseNumber", "fiscalYear" ORDER BY coalesce("depositDate", '') DESC, pos) = 1)"""
_REFS = ", ".join(f'"{c}"' for c in REF_COLUMNS)
_YEARS = ", ".join(map(str, YEARS))
REQUESTED_SQL = f"""requested AS (SELECT * FROM filing_ref WHERE "fiscalYear" IN ({_YEARS}) QUALIFY row_number() OVER (
  PARTITION BY "enterpriseNumber", "fiscalYear" ORDER BY pos) = 1)"""
_LINES = """lines AS (SELECT filing_id, row_number() OVER (PARTITION BY filing_id ORDER BY i) AS n, line FROM (
    SELECT filing_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {source})
  WHERE trim(line) <> '')"""
_CODE = "'^\\s*([0-9]{2,4}(?:/[0-9]{2,3}[A-Z]?)?|[0-9]{2,4}[A-Z]?)\\s+\\S'"
_AMOUNT = "'^\\s*(?:[0-9]{2,4}(?:/[0-9]{2,3}[A-Z]?)?|[0-9]{2,4}[A-Z]?)\\s+(\\(?\\s*[0-9.]+(?:,[0-9]+)?\\s*\\)?)'"


def _plain_amount(text: str) -> str:
    compact = f"regexp_replace({text}, '[\\s.]', '', 'g')"
    number = f"regexp_replace(regexp_replace({compact}, ',', '.'), '[()]', '', 'g')"
    return (
        f"CASE WHEN regexp_full_match({number}, '[0-9]+([.][0-9]+)?') THEN "
        f"(CASE WHEN contains({text}, '(') THEN '-' ELSE '' END) || {number} END"
    )


CODED_SQL = f"""coded AS (SELECT filing_id, n, code, value FROM (
  SELECT filing_id, n, regexp_extract(line, {_CODE}, 1) AS code, {_plain_amount(f"regexp_extract(line, {_AMOUNT}, 1)")} AS value FROM lines)
  WHERE code <> '' AND value IS NOT NULL)"""
_TAIL = "regexp_extract(line, '\\(?\\s*[0-9.]+(?:,[0-9]+)?\\s*\\)?\\s*$')"
INSURER_SQL = f"""amounts AS (SELECT filing_id, n, CASE WHEN regexp_matches(t, '[.,]') OR length(regexp_replace(t, '[^0-9]', '', 'g')) >= 4
    THEN {_plain_amount("t")} END AS value FROM (SELECT filing_id, n, {_TAIL} AS t FROM lines)),
insurer AS (SELECT l.filing_id, 'INS_INVESTMENTS' AS code, a.value FROM lines l JOIN amounts a
    ON a.filing_id = l.filing_id AND a.n BETWEEN l.n AND l.n + 5 AND a.value IS NOT NULL
  WHERE regexp_matches(l.line, '^C\\.\\s*(Beleggingen|Placements)\\b')
  QUALIFY row_number() OVER (PARTITION BY l.filing_id ORDER BY l.n, a.n) = 1)"""
_TEXT_LINES = _LINES.format(source="filing_text")
TEXT_SQL = f"""{_TEXT_LINES}, {CODED_SQL}, {INSURER_SQL}, text_rubric AS (
  SELECT filing_id, row_number() OVER (PARTITION BY filing_id ORDER BY n) - 1 AS pos, code, value, 'N' AS period
  FROM (SELECT filing_id, n, code, value FROM coded UNION ALL SELECT filing_id, 1000000, code, value FROM insurer))"""
_HISTORY = ", ".join(f'"{c}"' for c in HISTORY_MEASURES)
_ALL = ", ".join(f'"{c}"' for c in ALL_MEASURES)
PUBLISHED_SQL = f"""{TEXT_SQL}, {REQUESTED_SQL}, all_lines AS (
  SELECT filing_id, code, value, period, pos FROM rubric JOIN orders ON o_orderkey = filing_id WHERE o_orderstatus <> 'O'
  UNION ALL SELECT filing_id, code, value, period, pos FROM text_rubric), {measures_sql("all_lines")}, published AS (
  SELECT r."enterpriseNumber", first_value("enterpriseName") OVER (PARTITION BY r."enterpriseNumber" ORDER BY "fiscalYear" DESC) AS "enterpriseName",
    "fiscalYear", "referenceNumber", {_ALL}, 'EUR' AS currency, "depositDate",
    CASE WHEN "lineCount" IS NULL THEN CASE WHEN "importFileType" = 'PDF' THEN 'unsupported_format' ELSE 'fetch_failed' END END AS error
  FROM requested r LEFT JOIN summed s USING (filing_id))"""

def _insurer_measures_sql() -> str:
    """The amounts as they were written, without any parsing."""
    names = {code: name for name, code in INSURER_CODES.items()} | {INSURER_NET_RESULT: "netResult", INSURER_EQUITY: "equity"}
    values = ", ".join(
        f"""CASE WHEN (o_orderkey + {i}) % 4 = 0 THEN -1.0 ELSE 1.0 END * ((1 + (o_orderkey + {i}) % 900) * 1000000 + (o_custkey % 1000) * 1000 + {100 + i}) AS "{names[code]}\""""
        for i, code in enumerate(LABEL_TEXTS)
    )
    return f"""SELECT filing_id, 10 AS "lineCount", {", ".join(f'cast("{n}" AS double) AS "{n}"' for n in names.values())}
FROM (SELECT o_orderkey AS filing_id, {values} FROM orders WHERE o_orderstatus <> 'O')"""


ORACLE = {
    "reference_payloads": """
SELECT cast(o_custkey AS string) AS "enterpriseNumber", 1 AS pos, cast(o_orderkey AS string) AS "referenceNumber",
  strftime(o_orderdate, '%Y-%m-%d') AS "depositDate", cast(year(o_orderdate) AS integer) AS "fiscalYear", 'Naam ' || o_custkey AS "enterpriseName"
FROM orders WHERE o_orderkey % 6 < 5 AND o_orderkey % 7 <> 0""",
    "accounting_payloads": """
SELECT cast(o_orderkey AS string) AS filing_id, 'N' || o_custkey AS "payloadName", 0 AS pos, '70' AS code,
  cast(cast(o_totalprice AS decimal(18, 2)) AS string) AS value, CASE WHEN o_orderkey % 2 = 0 THEN 'N' ELSE 'NM1' END AS period
FROM orders WHERE o_orderkey % 5 > 1
UNION ALL SELECT cast(o_orderkey AS string), 'N' || o_custkey, 1, '9904', cast(o_custkey AS string), NULL FROM orders WHERE o_orderkey % 5 > 1""",
    "deposit_listing": """
SELECT cast(o_custkey AS string) AS "enterpriseNumber", pos, CASE pos WHEN 0 THEN 'a' WHEN 1 THEN 'b' END || o_orderkey AS filing_id,
  CASE pos WHEN 0 THEN 'r1' WHEN 1 THEN 'r2' END AS "referenceNumber", cast(CASE WHEN pos IS NOT NULL THEN year(o_orderdate) - pos END AS integer) AS "fiscalYear",
  cast(NULL AS string) AS "depositDate", cast(NULL AS string) AS "enterpriseName", CASE pos WHEN 0 THEN 'PDF' END AS "importFileType"
FROM (SELECT *, unnest(CASE WHEN o_orderkey % 4 = 0 THEN [NULL] ELSE [0, 1] END) AS pos FROM orders)""",
    "export_rubrics": """
SELECT o_orderkey AS filing_id, 2 AS pos, '70' AS code, cast(cast(o_totalprice AS decimal(18, 2)) AS string) AS value, 'N' AS period FROM orders
UNION ALL SELECT o_orderkey, 4, '9904', '5', 'N' FROM orders WHERE o_orderkey % 3 <> 0""",
    "export_summary": """
SELECT o_orderkey AS filing_id, 'M' || o_custkey AS "enterpriseName", 'R' || o_orderkey AS "referenceNumber" FROM orders""",
    "latest_filing": with_views("filing_ref", f"SELECT {_REFS} FROM latest", _LATEST),
    "recent_years": with_views(
        "filing_ref",
        f"""SELECT {_REFS} FROM latest QUALIFY row_number() OVER (PARTITION BY "enterpriseNumber" ORDER BY "fiscalYear" DESC) <= 3""",
        _LATEST,
    ),
    "explicit_years": with_views(
        "filing_ref", f'SELECT {_REFS} FROM latest WHERE "fiscalYear" IN ({_YEARS})', _LATEST
    ),
    "requested_years": with_views("filing_ref", f"SELECT {_REFS} FROM requested", REQUESTED_SQL),
    "rubric_values": f"""
SELECT value, count(*) AS n, any_value({LEADING_SQL}) AS leading,
  any_value(CASE WHEN regexp_full_match(regexp_replace(replace(value, ' ', ''), ',', '.'), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')
    THEN try_cast(regexp_replace(replace(value, ' ', ''), ',', '.') AS double) END) AS imported
FROM (SELECT {NOISY_VALUE.format(value="cast(l_quantity AS string)")} AS value FROM lineitem WHERE l_linestatus = 'O') GROUP BY 1""",
    "filing_measures": with_views(
        "rubric",
        f'SELECT filing_id, "lineCount", {_ALL} FROM summed',
        "noisy AS (SELECT * REPLACE (CASE WHEN filing_id % 4 = 1 AND code = '70' THEN '72' WHEN filing_id % 4 = 1 AND code = '20/58' THEN '76A' ELSE code END AS code, "
        "CASE WHEN filing_id % 6 = 0 AND code = '70/76A' THEN 'n/a' WHEN filing_id % 5 = 0 THEN ' ' || replace(value, '.', ',') "
        "WHEN filing_id % 7 = 0 AND code = '9904' THEN '-' || value ELSE value END AS value) FROM rubric), " + measures_sql("noisy"),
    ),
    "annual_summary": with_views(
        "filing_ref rubric",
        f'SELECT filing_id, "enterpriseNumber", "fiscalYear", "lineCount", {_ALL} FROM filing_ref LEFT JOIN summed USING (filing_id)',
        measures_sql(),
    ),
    "coded_text_lines": with_views(
        "filing_text",
        "SELECT filing_id, row_number() OVER (PARTITION BY filing_id ORDER BY n) - 1 AS pos, code, value FROM coded",
        f"{_TEXT_LINES}, {CODED_SQL}",
    ),
    "insurer_rubrics": with_views("filing_text", "SELECT * FROM insurer", f"{_TEXT_LINES}, {INSURER_SQL}"),
    "text_rubrics": with_views("filing_text", "SELECT * FROM text_rubric", TEXT_SQL),
    "document_rubrics": "WITH texts AS (SELECT doc_id AS filing_id, text || chr(10) || '20/58 ' || n_chars || '.000 1.000' || chr(10)"
    " || 'C. Placements (note 3)' || chr(10) || '11' || chr(10) || chr(10) || '( ' || n_chars || '.459 )' || chr(10)"
    " || '70/76A ' || doc_id || ',5' AS text FROM documents), "
    + _LINES.format(source="texts")
    + f", {CODED_SQL}, {INSURER_SQL} SELECT filing_id, code, value FROM coded UNION ALL SELECT filing_id, code, value FROM insurer",
    "company_history": with_views(
        "filing_ref rubric",
        f"""
SELECT "enterpriseNumber", n.name AS "enterpriseName", "fiscalYear", "referenceNumber", {_HISTORY}, 'EUR' AS currency, "depositDate",
  CASE WHEN "lineCount" IS NULL THEN 'no_json' END AS error
FROM chosen LEFT JOIN summed USING (filing_id)
LEFT JOIN (SELECT "enterpriseNumber", arg_max("enterpriseName", "fiscalYear") FILTER ("enterpriseName" <> '') AS name FROM chosen GROUP BY 1) n USING ("enterpriseNumber")""",
        f"""{_LATEST}, chosen AS (SELECT * FROM latest QUALIFY row_number() OVER (PARTITION BY "enterpriseNumber" ORDER BY "fiscalYear" DESC) <= 4),
{measures_sql()}""",
    ),
    "published_financials": with_views("filing_ref rubric filing_text", "SELECT * FROM published", PUBLISHED_SQL),
    "year_lists": with_views(
        "filing_ref",
        " UNION ALL ".join(
            f"SELECT '{label}' AS list, {_REFS} FROM latest WHERE \"fiscalYear\" IN ({years})"
            for label, years in {
                "explicit": "1996, 1998", "base alone": "1997", "three years": "1996, 1997, 1998", "too short": "1995",
                "too long": ", ".join(str(y) for y in range(1990, 2000)),
            }.items()
        ),
        _LATEST,
    ),
    "every_code": f"""WITH lines AS (
  SELECT l_orderkey AS filing_id, [{", ".join(f"'{c}'" for c in EVERY_CODE)}][(l_partkey + l_linenumber * 5) % {len(EVERY_CODE)} + 1] AS code,
    cast(cast(l_extendedprice AS decimal(18, 2)) AS string) AS value, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'N' END AS period,
    l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + cast(l_quantity AS bigint) AS pos FROM lineitem),
{measures_sql("lines", "period IN ('', 'N')")} SELECT filing_id, "lineCount", {_ALL} FROM summed""",
    "insurer_measures": _insurer_measures_sql(),
}
ORACLE["company_history_stored"] = ORACLE["company_history"]
ORACLE["published_financials_stored"] = ORACLE["published_financials"]
