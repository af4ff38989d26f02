"""Amounts: coded exports, Belgian notation in texts, imported report cells.

Every source text is looked at once: an expression that names its input twice would evaluate
it twice, and nested ones would multiply.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from firmatlas.functions.identifiers import BLANK, BLANK_CHARACTERS, remove_blanks

LEADING_NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
WHOLE_NUMBER = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)$"
LARGEST_EXACT = float(2**53)

# A Belgian amount: dots between digits, one decimal comma, parentheses when negative.
AMOUNT = f"\\(?{BLANK}*\\.*[0-9][0-9.]*(?:,[0-9]+)?{BLANK}*\\)?"
# At the end of a line only with a separator or four digits: shorter numbers are row codes.
TRAILING_AMOUNT = (
    f"\\(?{BLANK}*(?:[0-9]{{4,}}|\\.+[0-9][0-9.]*(?:,[0-9]+)?|[0-9]+\\.[0-9.]*(?:,[0-9]+)?|[0-9]+,[0-9]+)"
    f"{BLANK}*\\)?{BLANK}*\\z"
)


def _number(text: Column) -> Column:
    """Matched text as a double; no match (empty text) and overflow give null."""
    value = F.array(text.try_cast("double"))
    for infinite in (float("inf"), float("-inf")):
        value = F.array_remove(value, infinite)
    return F.get(value, F.lit(0))


def leading_number(c: Column) -> Column:
    """The number a text starts with, else null. A comma is a decimal mark; a second mark ends
    the number."""
    return _number(F.regexp_extract(F.replace(c, F.lit(","), F.lit(".")), LEADING_NUMBER, 1))


def imported_number(c: Column) -> Column:
    """A cell of an exported report: blanks dropped, comma as decimal mark, blank is null."""
    return _number(F.regexp_extract(F.replace(remove_blanks(c), F.lit(","), F.lit(".")), WHOLE_NUMBER, 1))


def round_half_up(c: Column, digits: int) -> Column:
    """Halves go towards plus infinity, also for negative values."""
    scale = float(10**digits)
    scaled = c * F.lit(scale)
    return F.when(
        F.abs(scaled) < F.lit(LARGEST_EXACT), F.floor(scaled + F.lit(0.5)).cast("double") / scale
    ).otherwise(c)


def margin_percent(revenue: Column, net_result: Column) -> Column:
    ratio = net_result / F.nullif(revenue, F.lit(0.0))
    scaled = ratio * F.lit(10000.0)
    return F.when(
        F.abs(scaled) < F.lit(LARGEST_EXACT), F.floor(scaled + F.lit(0.5)).cast("double") / 100.0
    ).otherwise(scaled / 100.0)


def belgian_amount(matched: Column) -> Column:
    """Text matched as an amount -> plain number text: ``( 12.500 )`` -> ``-12500``.

    One pass: ``(`` becomes the sign, the comma the point, and everything else is dropped.
    """
    return F.translate(matched, "(,.)" + BLANK_CHARACTERS, "-.")


def trailing_amount(line: Column) -> Column:
    """The amount a line ends with, empty if there is none."""
    return belgian_amount(F.regexp_extract(line, TRAILING_AMOUNT, 0))


def plain_number(c: Column) -> Column:
    """A double as plain decimal text, for CSV reports: its shortest digits, without an exponent."""
    parts = F.split(c.cast("string"), "E")

    def spelled(p: Column) -> Column:
        """Sign, digits and exponent put together; the point is moved, not computed."""
        mantissa, power = F.get(p, F.lit(0)), F.coalesce(F.get(p, F.lit(1)).cast("int"), F.lit(0))
        sign = F.when(F.startswith(mantissa, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
        whole = F.replace(F.substring_index(mantissa, ".", 1), F.lit("-"), F.lit(""))
        fraction = F.substring_index(mantissa, ".", -1)
        digits, point = F.concat(whole, fraction), F.length(whole) + power
        left = F.when(point > 0, F.rpad(F.left(digits, point), point, "0")).otherwise(F.lit("0"))
        right = F.when(point > 0, F.substring(digits, point + 1, F.length(digits))).otherwise(
            F.concat(F.repeat(F.lit("0"), -point), digits)
        )
        right = F.regexp_replace(right, "0+$", "")
        text = F.when(right == "", left).otherwise(F.concat_ws(".", left, right))
        return F.when(text == "0", text).otherwise(F.concat(sign, text))

    return F.when(c.isNotNull(), F.get(F.transform(F.array(parts), spelled), F.lit(0)))
