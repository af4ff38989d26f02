"""CSV reports: CRLF lines, quotes only where needed, blanks for missing values.

A report is written by all tasks, one file per partition in report order. Every file has the
header; with ``excel`` the header starts with a byte order mark, so each opens in a spreadsheet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmatlas.plans.report import as_text

BYTE_ORDER_MARK = "\ufeff"
# Headers of the postal-code report.
POSTAL_HEADERS = {"postalCode": "Postal code", "enterpriseCount": "Enterprise count"}


def write_report(df: DataFrame, path: str, excel: bool = True) -> None:
    rows = as_text(df)
    if excel and rows.columns:
        first = rows.columns[0]
        rows = rows.withColumnRenamed(first, BYTE_ORDER_MARK + first)
    (
        rows.write.mode("overwrite")
        .options(
            header="true",
            lineSep="\r\n",
            quote='"',
            escape='"',
            nullValue="",
            emptyValue="",
            ignoreLeadingWhiteSpace="false",
            ignoreTrailingWhiteSpace="false",
        )
        .csv(path)
    )


def write_postal_counts(counts: DataFrame, path: str, excel: bool = True) -> None:
    named = counts.select(*[F.col(c).alias(header) for c, header in POSTAL_HEADERS.items()])
    write_report(named, path, excel)
