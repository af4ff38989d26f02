"""Account lines out of filing texts.

Everything happens inside the row of a text (split, match, look ahead), so a text never
shuffles and long texts cost memory only where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmatlas.functions.amounts import AMOUNT, belgian_amount, trailing_amount
from firmatlas.functions.identifiers import BLANK, strip_blanks

# The account code a coded line starts with.
ACCOUNT_CODE = r"[0-9]{2,4}(?:/[0-9]{2,3}[A-Z]?)?|[0-9]{2,4}[A-Z]?"
# Code, blanks, first amount and the rest of the line.
CODED_LINE = rf"^({ACCOUNT_CODE}){BLANK}+({AMOUNT})[^\r\u2028\u2029]*\z"

# Labels of insurer statements, Dutch and French, and the code each one stands for.
INSURER_LABELS = {
    "INS_EQUITY": r"^A\.\s*(?:Eigen vermogen|Capitaux propres)\b",
    "INS_INVESTMENTS": r"^C\.\s*(?:Beleggingen|Placements)\b",
    "INS_UNIT_LINKED_INVESTMENTS": r"^D\.\s*(?:Beleggingen betreffende.*(?:leven|vie)|Placements.*(?:vie|branche))\b",
    "INS_REINSURANCE_SHARE_TECHNICAL_PROVISIONS": r"^D\.?(?:\s|[’'])?bis\.?\s*(?:Deel van de herverzekeraars.*technische voorzieningen|Part des réassureurs.*provisions techniques)\b",
    "INS_RECEIVABLES": r"^E\.\s*(?:Vorderingen|Créances)\b",
    "INS_TECHNICAL_PROVISIONS": r"^C\.\s*(?:Technische voorzieningen|Provisions techniques)\b",
    "INS_LIFE_TECHNICAL_PROVISIONS": r"""^II\.\s*(?:Voorziening voor verzekering\s*["“]?leven|Provision d'assurance\s*["“]?vie)\b""",
    "INS_CLAIMS_PROVISIONS": r"^III\.\s*(?:Voorziening voor te betalen schaden|Provision pour sinistres)\b",
    "INS_REINSURANCE_DEPOSITS": r"^F\.\s*(?:Deposito's ontvangen van herverzekeraars|Dépôts reçus des réassureurs)\b",
    "INS_NET_RESULT": r"^3\.\s*(?:Resultaat van het boekjaar|Résultat de l'exercice)\b",
}

# Lines after a label that may hold its amount.
LOOK_AHEAD = 5


def _pattern(text: str) -> str:
    """Blanks include no-break spaces; a word ends before anything but an ASCII letter or digit."""
    return text.replace(r"\s", BLANK).replace(r"\b", "(?![A-Za-z0-9_])")


def _label_pattern(text: str) -> str:
    return "(?iu)" + _pattern(text)


# Begins with its anchor, so that a line without a label is not searched at each of its characters.
ANY_LABEL = "(?iu)^(?:" + "|".join(f"(?:{_pattern(p.removeprefix('^'))})" for p in INSURER_LABELS.values()) + ")"


def with_lines(texts: DataFrame) -> DataFrame:
    """Add ``lines``: the non-blank lines of a text, without surrounding blanks."""
    return texts.withColumn(
        "lines", F.filter(F.transform(F.split("text", "\n"), strip_blanks), lambda x: x != "")
    )


def coded_rubrics(lines: DataFrame) -> DataFrame:
    """Add ``coded``: code and first amount of every coded line, in line order."""
    return lines.withColumn(
        "coded",
        F.transform(
            F.filter("lines", lambda line: line.rlike(CODED_LINE)),
            lambda line: F.struct(
                F.regexp_extract(line, CODED_LINE, 1).alias("code"),
                belgian_amount(F.regexp_extract(line, CODED_LINE, 2)).alias("value"),
            ),
        ),
    )


def insurer_rubrics(lines: DataFrame) -> DataFrame:
    """Add ``insurer``: per label the amount of its earliest line that has one.

    A line's own amount counts first, then those of the next lines.
    """
    # Label lines with the lines in reach; columns of an earlier step are read, not computed again.
    reach = lines.withColumn(
        "reach",
        F.filter(
            F.transform(
                "lines",
                lambda x, i: F.when(
                    x.rlike(ANY_LABEL), F.slice(F.col("lines"), i + 1, LOOK_AHEAD + 1)
                ),
            ),
            lambda found: found.isNotNull(),
        ),
    )
    priced = reach.withColumn(
        "priced",
        F.filter(
            F.transform(
                "reach",
                lambda x: F.struct(
                    F.get(x, F.lit(0)).alias("line"),
                    # Lines after the first amount are not looked at.
                    F.aggregate(
                        x, F.lit(""), lambda found, line: F.when(found != "", found).otherwise(trailing_amount(line))
                    ).alias("value"),
                ),
            ),
            lambda r: r["value"] != "",
        ),
    )

    def first(code: str, pattern: str) -> Column:
        # Lines after the first one of a label are not matched again.
        value = F.aggregate(
            "priced",
            F.lit(None).cast("string"),
            lambda found, r: F.when(found.isNull() & r["line"].rlike(_label_pattern(pattern)), r["value"]).otherwise(found),
        )
        return F.struct(F.lit(code).alias("code"), value.alias("value"))

    amounts = F.array(*[first(code, p) for code, p in INSURER_LABELS.items()])
    none = F.array().cast("array<struct<code:string,value:string>>")
    return priced.withColumn(
        "insurer",
        F.when(F.size("priced") > 0, F.filter(amounts, lambda r: r["value"].isNotNull())).otherwise(
            none
        ),
    ).drop("reach", "priced")


def text_rubrics(texts: DataFrame) -> DataFrame:
    """Texts -> rubrics: coded lines first, then insurer labels, numbered in that order."""
    parsed = insurer_rubrics(coded_rubrics(with_lines(texts)))
    return parsed.select("filing_id", F.posexplode(F.concat("coded", "insurer"))).select(
        "filing_id",
        "pos",
        F.col("col")["code"].alias("code"),
        F.col("col")["value"].alias("value"),
        F.lit("N").alias("period"),
    )
