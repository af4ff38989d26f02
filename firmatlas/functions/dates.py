"""Registry dates: ``DD-MM-YYYY`` in, ``YYYY-MM-DD`` out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MONTH_YEAR = r"^\s*([0-9]{1,4})\s*-\s*([0-9]{1,4})\s*-\s*([0-9]{1,4})"


def parse_day(c: Column) -> Column:
    """``DD-MM-YYYY`` -> timestamp without zone.

    Days and months beyond their range roll over (``31-02-2020`` is 2 March 2020).
    Blank or malformed text gives null.
    """
    parts = [F.regexp_extract(c, DAY_MONTH_YEAR, i) for i in (1, 2, 3)]
    day, month, year = (F.when(part != "", part).cast("int") for part in parts)
    full_year = F.when(year < 100, year + 1900).otherwise(year)
    first = F.make_date(full_year, F.lit(1), F.lit(1))
    return F.date_add(F.add_months(first, month - 1), day - 1).cast("timestamp_ntz")


def is_malformed_day(c: Column) -> Column:
    return (F.coalesce(c, F.lit("")) != "") & ~c.rlike(DAY_MONTH_YEAR)


def iso_day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def leading_year(c: Column) -> Column:
    """The number at the start of the first four characters, as an int."""
    digits = F.regexp_extract(F.substring(c, 1, 4), r"^\s*([0-9]{1,4})", 1)
    return F.when(digits != "", digits.cast("int"))
