"""Coded account lines -> one row of measures per filing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmatlas.functions.amounts import leading_number, margin_percent, round_half_up

# Account codes per measure, in order of priority.
MEASURE_CODES = {
    "netResult": ["9904", "990", "9900", "9047"],
    "employeeCount": ["1003", "9146"],
    "totalAssets": ["20/58"],
    "equity": ["10/15"],
    "cashAndInvestments": ["54/58"],
    "financialDebt": ["17/49"],
    "tradeReceivables": ["40/41"],
    "tradePayables": ["44"],
    "fixedAssets": ["20/28"],
    "currentAssets": ["29/58"],
    "currentLiabilities": ["42/48"],
    "provisions": ["16"],
    "operatingResult": ["9901"],
    "depreciation": ["630"],
    "retainedEarnings": ["14"],
}
REVENUE_AGGREGATE = ["70/76A"]
REVENUE_DIRECT = ["70", "700", "7000", "701", "7010"]
REVENUE_PARTS = ["70", "71", "72", "74", "76A"]

# Insurer measures and the label codes they come from.
INSURER_CODES = {
    "insuranceInvestments": "INS_INVESTMENTS",
    "unitLinkedInvestments": "INS_UNIT_LINKED_INVESTMENTS",
    "technicalProvisions": "INS_TECHNICAL_PROVISIONS",
    "lifeTechnicalProvisions": "INS_LIFE_TECHNICAL_PROVISIONS",
    "claimsProvisions": "INS_CLAIMS_PROVISIONS",
    "reinsuranceShareTechnicalProvisions": "INS_REINSURANCE_SHARE_TECHNICAL_PROVISIONS",
    "insuranceReceivables": "INS_RECEIVABLES",
    "reinsuranceDeposits": "INS_REINSURANCE_DEPOSITS",
}
INSURER_NET_RESULT = "INS_NET_RESULT"
INSURER_EQUITY = "INS_EQUITY"
CURRENT_PERIODS = ["", "N"]

MEASURES = ["revenue", "netResult", "marginPercent", *list(MEASURE_CODES)[1:]]
INSURER_MEASURES = list(INSURER_CODES)
ALL_MEASURES = [*MEASURES, *INSURER_MEASURES]


def current_period() -> Column:
    return F.col("period").isNull() | F.col("period").isin(CURRENT_PERIODS)


def rubric_values(rubrics: DataFrame, keys: list[str]) -> DataFrame:
    """Per filing the value of each known code's first current line, and the number of lines.

    Values are parsed before they are grouped, so the aggregate keeps fixed-width buffers and
    runs as a hash aggregate with a partial step: a filing with very many lines is reduced
    where its lines are read, and there is one shuffle in all. A code's first line counts even
    if it is not numeric (its value is then null).
    """
    account = dict.fromkeys(
        [*REVENUE_AGGREGATE, *REVENUE_DIRECT, *REVENUE_PARTS, *sum(MEASURE_CODES.values(), [])]
    )
    insurer = [*INSURER_CODES.values(), INSURER_NET_RESULT, INSURER_EQUITY]
    rows = rubrics.select(
        *keys,
        "code",
        "pos",
        leading_number(F.col("value")).alias("number"),
        F.when(current_period(), F.col("pos")).alias("currentPos"),
    )
    firsts = [
        F.expr(f"min_by(number, if(code = '{code}', {pos}, null)) as `{code}`")
        for codes, pos in ((account, "currentPos"), (insurer, "pos"))
        for code in codes
    ]
    return rows.groupBy(*keys).agg(F.count("*").alias("lineCount"), *firsts)


def _first_of(codes: list[str]) -> Column:
    return F.coalesce(*[F.col(f"`{c}`") for c in codes])


def revenue() -> Column:
    """The aggregate line, else the first direct line, else the sum of the parts present."""
    parts = [F.col(f"`{c}`") for c in REVENUE_PARTS]
    total = F.lit(0.0)
    for part in parts:
        total = total + F.coalesce(part, F.lit(0.0))
    any_part = F.when(F.coalesce(*parts).isNotNull(), total)
    return F.coalesce(_first_of(REVENUE_AGGREGATE), _first_of(REVENUE_DIRECT), any_part)


def measures(values: DataFrame, keys: list[str]) -> DataFrame:
    """All measures out of ``rubric_values``; insurer figures stand in for net result and equity."""
    base = values.select(
        *keys,
        "lineCount",
        revenue().alias("revenue"),
        F.coalesce(_first_of(MEASURE_CODES["netResult"]), F.col(INSURER_NET_RESULT)).alias(
            "netResult"
        ),
        round_half_up(_first_of(MEASURE_CODES["employeeCount"]), 1).alias("employeeCount"),
        F.coalesce(_first_of(MEASURE_CODES["equity"]), F.col(INSURER_EQUITY)).alias("equity"),
        *[
            _first_of(codes).alias(name)
            for name, codes in MEASURE_CODES.items()
            if name not in ("netResult", "employeeCount", "equity")
        ],
        *[F.col(code).alias(name) for name, code in INSURER_CODES.items()],
    )
    return base.withColumn(
        "marginPercent", margin_percent(F.col("revenue"), F.col("netResult"))
    ).select(*keys, "lineCount", *ALL_MEASURES)


def filing_measures(rubrics: DataFrame, keys: list[str]) -> DataFrame:
    return measures(rubric_values(rubrics, keys), keys)
