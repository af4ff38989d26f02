"""Which filing counts for which fiscal year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPANY = "enterpriseNumber"
DEFAULT_YEARS = 5

# Range of fiscal years and of history lengths.
FIRST_YEAR, LAST_YEAR = 1900, 2100
LONGEST_HISTORY = 10


def requested_years(
    explicit: Sequence[int] | None = None, base: int | None = None, history: int = 1
) -> list[int]:
    """Distinct years, newest first: an explicit list, or a number of years back from a base."""
    if explicit is not None:
        years = sorted({y for y in explicit if FIRST_YEAR <= y <= LAST_YEAR}, reverse=True)
        if not years:
            raise ValueError("years must hold at least one four-digit fiscal year")
        return years
    if base is None or not FIRST_YEAR <= base <= LAST_YEAR:
        raise ValueError("a four-digit fiscal year is needed")
    return [base - i for i in range(min(LONGEST_HISTORY, max(1, history)))]


def _best(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row with the lowest order per key, as an aggregate with a partial step."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), order).alias("best"))
        .select(*[c if c in keys else F.col("best")[c].alias(c) for c in df.columns])
    )


def latest_per_year(refs: DataFrame) -> DataFrame:
    """Per company and fiscal year the filing deposited last; the first listed on a tie.

    A missing deposit date counts as the lowest.
    """
    rest = [c for c in refs.columns if c not in (COMPANY, "fiscalYear")]
    order = F.struct(F.coalesce("depositDate", F.lit("")), -F.col("pos"))
    return (
        refs.groupBy(COMPANY, "fiscalYear")
        .agg(F.max_by(F.struct(*rest), order).alias("best"))
        .select(*[F.col("best")[c].alias(c) if c in rest else c for c in refs.columns])
    )


def recent_filings(
    refs: DataFrame, n_years: int = DEFAULT_YEARS, years: Sequence[int] | None = None
) -> DataFrame:
    """The filings of the newest fiscal years per company, or of the years asked for.

    Filings are cut to one per year first, so a window only ever holds a company's years.
    """
    if years is not None:
        return latest_per_year(refs.filter(F.col("fiscalYear").isin([int(y) for y in years])))
    newest = Window.partitionBy(COMPANY).orderBy(F.desc("fiscalYear"))
    return (
        latest_per_year(refs)
        .withColumn("rank", F.row_number().over(newest))
        .filter(F.col("rank") <= n_years)
        .drop("rank")
    )


def requested_filings(deposits: DataFrame, years: Sequence[int]) -> DataFrame:
    """Per company and requested year the deposit listed first. Only the exact year counts."""
    wanted = deposits.filter(F.col("fiscalYear").isin([int(y) for y in years]))
    return _best(wanted, [COMPANY, "fiscalYear"], F.col("pos"))

