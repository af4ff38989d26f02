import datetime

import pytest
from pyspark.sql import functions as F

from firmatlas.functions.amounts import (
    imported_number,
    leading_number,
    margin_percent,
    plain_number,
    round_half_up,
    trailing_amount,
)
from firmatlas.functions.dates import is_malformed_day, iso_day, leading_year, parse_day
from firmatlas.functions.identifiers import (
    dotted_number,
    entity_kind,
    remove_blanks,
    strip_blanks,
    vat_digits,
)

NBSP = chr(0xA0)


@pytest.mark.parametrize(
    "number, kind",
    [
        ("0200.065.765", "Enterprise"),
        ("2.000.000.339", "Establishment"),
        ("9.000.006.626", "Branch"),
        ("0200065765", "Unknown"),
        ("", "Unknown"),
    ],
)
def test_entity_kind(one, number, kind):
    assert one(entity_kind, number) == kind


@pytest.mark.parametrize(
    "vat, digits",
    [
        ("BE0123456789", "0123456789"),
        ("BE 123.456.789", "0123456789"),
        ("1123456789", "1123456789"),
        ("2123456789", None),
        ("12345678", None),
        ("", None),
        (None, None),
    ],
)
def test_vat_digits(one, vat, digits):
    assert one(vat_digits, vat) == digits


def test_dotted_number(one):
    assert one(dotted_number, "0123456789") == "0123.456.789"
    assert one(dotted_number, "0123.456.789") == "0123.456.789"
    assert one(dotted_number, "12345") == "12345"


def test_blanks_include_no_break_spaces(one):
    text = f"{NBSP} a b\t{NBSP}"
    assert one(strip_blanks, text) == "a b"
    assert one(remove_blanks, text) == "ab"


@pytest.mark.parametrize(
    "text, day",
    [
        ("05-03-2020", datetime.datetime(2020, 3, 5)),
        ("31-02-2020", datetime.datetime(2020, 3, 2)),
        ("01-13-2019", datetime.datetime(2020, 1, 1)),
        ("00-01-2020", datetime.datetime(2019, 12, 31)),
        ("", None),
        (None, None),
        ("unknown", None),
    ],
)
def test_parse_day(one, text, day):
    assert one(parse_day, text) == day


def test_malformed_days_are_told_from_blank_ones(one):
    assert one(is_malformed_day, "unknown") is True
    assert one(is_malformed_day, "") is False
    assert one(is_malformed_day, "31-02-2020") is False


def test_iso_day_and_year(one):
    assert one(lambda c: iso_day(parse_day(c)), "05-03-2020") == "2020-03-05"
    assert one(leading_year, "2024-12-31") == 2024
    assert one(leading_year, "soon") is None


@pytest.mark.parametrize(
    "text, value",
    [
        ("1000000", 1000000.0),
        ("12,5", 12.5),
        (" -3.25 EUR", -3.25),
        ("1.250.000", 1.25),
        ("1e3x", 1000.0),
        ("1e999", None),
        (".5", 0.5),
        ("n/a", None),
        ("", None),
        (None, None),
    ],
)
def test_leading_number(one, text, value):
    assert one(leading_number, text) == value


@pytest.mark.parametrize(
    "text, value",
    [("1 234,5", 1234.5), ("-2", -2.0), ("", None), ("12x", None), ("1,2,3", None), (f"1{NBSP}000", 1000.0)],
)
def test_imported_number(one, text, value):
    assert one(imported_number, text) == value


@pytest.mark.parametrize(
    "line, amount",
    [
        ("E. Vorderingen 541.614.168", "541614168"),
        ("11", ""),
        ("1459", "1459"),
        ("( 12.500 )", "-12500"),
        ("x 12,50", "12.50"),
        ("see ....", ""),
        (f"total 1.000{NBSP}", "1000"),
        ("100 EUR", ""),
    ],
)
def test_trailing_amount(one, line, amount):
    assert one(trailing_amount, line) == amount


def test_halves_round_up_also_below_zero(spark):
    row = spark.range(1).select(
        round_half_up(F.lit(-0.25), 1).alias("down"),
        round_half_up(F.lit(0.25), 1).alias("up"),
        round_half_up(F.lit(1141.9), 1).alias("same"),
        margin_percent(F.lit(225353586.48), F.lit(-2628674.22)).alias("margin"),
        margin_percent(F.lit(0.0), F.lit(100.0)).alias("zero"),
        margin_percent(F.lit(1000000.0), F.lit(120000.0)).alias("plain"),
    ).first()
    assert tuple(row) == (-0.2, 0.3, 1141.9, -1.17, None, 12.0)


def test_plain_number(spark):
    values = [1000000.0, 225353586.48, 0.0, -1.5, 1e12, 1e29, 1.5e-12, -0.0, -12345678.25, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(plain_number(F.col("v"))).collect()] == [
        "1000000",
        "225353586.48",
        "0",
        "-1.5",
        "1000000000000",
        "1" + "0" * 29,
        "0.0000000000015",
        "0",
        "-12345678.25",
        None,
    ]
