"""Entity numbers and VAT numbers (all string expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number shapes of the registry.
COMPANY_NUMBER = r"^[0-9]{4}\.[0-9]{3}\.[0-9]{3}$"
UNIT_NUMBER = r"^[0-9]\.[0-9]{3}\.[0-9]{3}\.[0-9]{3}$"
BRANCH_PREFIX = "9."

# Fixed value: the characters trimmed as blank space in source texts.
BLANK = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


# The same characters one by one, for expressions that need no pattern.
BLANK_CHARACTERS = (
    " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def strip_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK_CHARACTERS))


def remove_blanks(c: Column) -> Column:
    return F.regexp_replace(c, BLANK, "")


def bare_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


# Exactly ten digits with anything else between them.
TEN_DIGITS = "^" + "[^0-9]*([0-9])" * 10 + "[^0-9]*$"


def dotted_number(c: Column) -> Column:
    """``0123456789`` -> ``0123.456.789``; text with another digit count stays as it is."""
    return F.regexp_replace(c, TEN_DIGITS, "$1$2$3$4.$5$6$7.$8$9$10")


def vat_digits(c: Column) -> Column:
    """Belgian VAT text -> ten digits starting with 0 or 1, else null. Nine digits get a zero."""
    ten = F.regexp_replace(bare_digits(c), "^([0-9]{9})$", "0$1")
    return F.nullif(F.regexp_extract(ten, "^[01][0-9]{9}$", 0), F.lit(""))


def is_company(c: Column) -> Column:
    return c.rlike(COMPANY_NUMBER)


def is_establishment(c: Column) -> Column:
    return ~c.startswith(BRANCH_PREFIX) & c.rlike(UNIT_NUMBER)


def entity_kind(c: Column) -> Column:
    return (
        F.when(is_company(c), "Enterprise")
        .when(is_establishment(c), "Establishment")
        .when(c.rlike(UNIT_NUMBER), "Branch")
        .otherwise("Unknown")
    )
