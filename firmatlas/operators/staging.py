"""Raw extract rows -> typed table rows, one rule per table."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmatlas.functions.dates import is_malformed_day, parse_day
from firmatlas.functions.identifiers import is_company, is_establishment
from firmatlas.operators.keyed import dedupe_first
from firmatlas.schemas import (
    ADDRESS_TYPES,
    CODE_CATEGORIES,
    CODE_LANGUAGE,
    CONTACT_CODES,
    DEFAULT_COUNTRY,
    TABLES,
)
from firmatlas.sources.csv_files import FILE_ORDER


def text(name: str) -> Column:
    """A required text: an empty cell stays an empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def nullable(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def country(name: str) -> Column:
    return F.coalesce(nullable(name), F.lit(DEFAULT_COUNTRY))


def links(table: str) -> list[Column]:
    """Company and establishment a row belongs to, out of its key columns.

    The shape of the number decides, except for contacts, where the contact code does.
    """
    number = F.col("entityNumber")
    if table == "KBOContact":
        kind = F.col("entityContactCode")
        return [F.when(kind == "ENT", number), F.when(kind == "EST", number)]
    return [F.when(is_company(number), number), F.when(is_establishment(number), number)]


LINK_COLUMNS = ["enterpriseId", "establishmentId"]


def source_filter(table: str) -> Column:
    """Rows of an extract that belong into the table."""
    if table == "Code":
        return (F.col("Language") == CODE_LANGUAGE) & F.col("Category").isin(CODE_CATEGORIES)
    if table == "KBOAddress":
        return F.col("TypeOfAddress").isin(ADDRESS_TYPES)
    if table == "KBOContact":
        return F.col("EntityContact").isin(CONTACT_CODES)
    if table == "Activity":
        return (text("EntityNumber") != "") & (text("NaceCode") != "")
    return F.lit(True)


def _values(table: str, load_time: Column) -> list[Column]:
    start = F.when(text("StartDate") == "", load_time).otherwise(parse_day(F.col("StartDate")))
    rules: dict[str, Callable[[], list[Column]]] = {
        "Code": lambda: [text("Category"), text("Code"), text("Description")],
        "Enterprise": lambda: [
            text("EnterpriseNumber"),
            text("Status"),
            text("JuridicalSituation"),
            text("TypeOfEnterprise"),
            nullable("JuridicalForm"),
            nullable("JuridicalFormCAC"),
            start,
        ],
        "Establishment": lambda: [text("EstablishmentNumber"), start, text("EnterpriseNumber")],
        "Branch": lambda: [text("Id"), start, text("EnterpriseNumber")],
        "KBOAddress": lambda: [
            text("EntityNumber"),
            text("TypeOfAddress"),
            country("CountryNL"),
            country("CountryFR"),
            *[nullable(c) for c in TABLES["KBOAddress"].source_columns[4:12]],
            parse_day(F.col("DateStrikingOff")),
        ],
        "KBOContact": lambda: [
            text("EntityNumber"),
            text("EntityContact"),
            text("ContactType"),
            text("Value"),
        ],
        "Denomination": lambda: [
            text("EntityNumber"),
            text("Language"),
            text("TypeOfDenomination"),
            text("Denomination"),
        ],
        "Activity": lambda: [text(c) for c in TABLES["Activity"].source_columns],
        "Meta": lambda: [text("Variable"), text("Value")],
    }
    return rules[table]()


def stage_table(raw: DataFrame, table: str, load_time: datetime.datetime) -> DataFrame:
    """Filtered and typed rows of one extract, the first row per key in file order.

    Blank start dates become ``load_time``, a parameter, so that a repeated load is equal;
    malformed ones become null.
    """
    spec = TABLES[table]
    now = F.lit(load_time.isoformat(sep=" ")).cast("timestamp_ntz")
    columns = [c for c in spec.columns if c not in LINK_COLUMNS]
    # Where the key is the whole row, file order decides nothing.
    order = [c for c in FILE_ORDER if c in raw.columns] if columns != spec.key else []
    typed = raw.filter(source_filter(table)).select(
        *[v.alias(c) for v, c in zip(_values(table, now), columns)], *order
    )
    first = dedupe_first(typed, spec.key, order)
    if LINK_COLUMNS[0] in spec.columns:
        first = first.withColumns(dict(zip(LINK_COLUMNS, links(table))))
    return first.select(*spec.columns)


def malformed_dates(raw: DataFrame, column: str = "StartDate") -> DataFrame:
    """Number of non-blank dates that cannot be read."""
    return raw.agg(F.count_if(is_malformed_day(F.col(column))).alias("malformed"))
