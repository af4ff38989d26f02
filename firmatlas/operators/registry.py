"""Registry steps shared by the market, lookup and report jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmatlas.functions.dates import iso_day
from firmatlas.schemas import NAME_LANGUAGES, REGISTERED_OFFICE

NUMBER = "enterpriseNumber"


def clean(text: str | None) -> str | None:
    """A job parameter without surrounding blanks; blank means absent."""
    text = (text or "").strip()
    return text or None


def activity_filter(code: str, version: str | None, classification: str | None) -> Column:
    """Literal code prefix, plus the filters that are given. All of it reaches the scan."""
    condition = F.col("naceCode").startswith(code)
    if version:
        condition &= F.col("naceVersion") == version
    if classification:
        condition &= F.col("classification") == classification
    return condition


def nace_hits(
    activity: DataFrame,
    establishment: DataFrame,
    code: str,
    version: str | None = None,
    classification: str | None = None,
) -> DataFrame:
    """Distinct companies active under a code prefix, themselves or through an establishment.

    Establishment numbers are made distinct before the join and owners after it, so neither a
    busy establishment nor a company with very many of them floods one task.
    """
    code, version, classification = clean(code), clean(version), clean(classification)
    if code is None:
        return establishment.select(NUMBER).limit(0)
    active = activity.filter(activity_filter(code, version, classification))
    own = active.filter(F.col("enterpriseId").isNotNull()).select(
        F.col("enterpriseId").alias(NUMBER)
    )
    units = (
        active.filter(F.col("establishmentId").isNotNull())
        .select(F.col("establishmentId").alias("establishmentNumber"))
        .distinct()
    )
    owners = units.join(
        establishment.select("establishmentNumber", NUMBER), "establishmentNumber"
    ).select(NUMBER)
    return own.unionByName(owners).distinct()


def registered_offices(address: DataFrame) -> DataFrame:
    return address.filter(
        (F.col("typeOfAddressCode") == REGISTERED_OFFICE) & F.col("enterpriseId").isNotNull()
    )


def language_rank(languages: Sequence[str]) -> Column:
    rank = F.lit(len(languages))
    for position in reversed(range(len(languages))):
        rank = F.when(F.col("languageCode") == languages[position], position).otherwise(rank)
    return rank


def preferred_names(denomination: DataFrame, languages: Sequence[str] = NAME_LANGUAGES) -> DataFrame:
    """List rule: language by priority, then denomination type, then language code."""
    order = F.struct(language_rank(languages), "typeOfDenominationCode", "languageCode")
    return _names(denomination, order)


def profile_names(denomination: DataFrame, language: str = NAME_LANGUAGES[0]) -> DataFrame:
    """Profile rule: the first name in one language, else the first name of any."""
    order = F.struct(language_rank([language]), "typeOfDenominationCode", "languageCode")
    return _names(denomination, order)


def _names(denomination: DataFrame, order: Column) -> DataFrame:
    return (
        denomination.filter(F.col("enterpriseId").isNotNull())
        .groupBy(F.col("enterpriseId").alias(NUMBER))
        .agg(F.min_by("denomination", order).alias("name"))
    )


def code_labels(code: DataFrame, category: str, key: str, label: str) -> DataFrame:
    return code.filter(F.col("category") == category).select(
        F.col("code").alias(key), F.col("description").alias(label)
    )


def decode_companies(enterprise: DataFrame, code: DataFrame) -> DataFrame:
    """Status, situation and legal form as text, start date as ISO day.

    The code list is joined without a hint: Spark broadcasts it as long as its size is below
    the broadcast threshold and otherwise shuffles, where the skew join splits frequent codes.
    """
    return (
        enterprise.join(code_labels(code, "Status", "KBOstatusCode", "status"), "KBOstatusCode", "left")
        .join(
            code_labels(code, "JuridicalSituation", "juridicalSituationCode", "juridicalSituation"),
            "juridicalSituationCode",
            "left",
        )
        .join(
            code_labels(code, "JuridicalForm", "juridicalFormCode", "formLabel"),
            "juridicalFormCode",
            "left",
        )
        .join(
            code_labels(code, "JuridicalForm", "juridicalFormCACCode", "cacLabel"),
            "juridicalFormCACCode",
            "left",
        )
        .select(
            NUMBER,
            "status",
            "juridicalSituation",
            iso_day(F.col("startDate")).alias("startDate"),
            F.coalesce("formLabel", "cacLabel").alias("juridicalForm"),
        )
    )

