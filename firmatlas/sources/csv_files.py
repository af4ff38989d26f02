"""CSV sources: registry extracts, rubric exports and re-imported reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmatlas.functions.amounts import imported_number
from firmatlas.schemas import TABLES
from firmatlas.sources.csv_blocks import FILE_ORDER, csv_rows, header_line, header_names

def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


# Column that keeps the text of a row whose number of fields differs from the header's.
RAGGED = "raggedRow"


def csv_options() -> dict[str, str]:
    """Doubled quotes, and line breaks inside quoted fields."""
    return {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


def with_file(df: DataFrame) -> DataFrame:
    """Add the file and the block offset a row was read from."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias(FILE_ORDER[0]),
        F.col("_metadata.file_block_start").alias(FILE_ORDER[1]),
    )


def with_row(df: DataFrame) -> DataFrame:
    """Add the order of the rows within a block. A block is read by one task in row order, so
    file, block and this number give the order in the files, however splits are spread."""
    return df.withColumn(FILE_ORDER[2], F.monotonically_increasing_id())


def _fields(spark: SparkSession, path: str | list[str]) -> DataFrame | None:
    """``FILE_ORDER``, all columns as text, and ``RAGGED``; null where all files are empty."""
    header = header_line(spark, path)
    if header is None:
        return None
    names = [*header_names(header), RAGGED]
    ddl = ", ".join("`" + name.replace("`", "``") + "` string" for name in names)
    options = {**csv_options(), "header": "false", "columnNameOfCorruptRecord": RAGGED}
    rows = csv_rows(spark, path, header)
    # As a generator the parser runs once for each row, whatever is selected or filtered later.
    return rows.select(*FILE_ORDER, F.inline(F.array(F.from_csv("value", ddl, options))))


def ragged_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Number of rows per file that have more or fewer fields than the header."""
    rows = _fields(spark, path)
    if rows is None:
        return spark.createDataFrame([], f"{FILE_ORDER[0]} string, rows long")
    return rows.filter(F.col(RAGGED).isNotNull()).groupBy(FILE_ORDER[0]).agg(F.count("*").alias("rows"))


def read_extract(spark: SparkSession, path: str | list[str], table: str) -> DataFrame:
    """All columns of a registry extract as text, with their order in the files; a column that the
    file lacks is null. Large files are read by many tasks, also where fields hold line breaks
    (``csv_blocks``). Columns are found by their header name, so their order does not matter; several
    files must have one header. A row with more or fewer fields than the header ends the read
    with its file and text; ``ragged_rows`` counts such rows."""
    wanted = TABLES[table].source_columns
    raw = _fields(spark, path)
    if raw is None:
        return spark.createDataFrame([], ", ".join([*(f"{c} string" for c in wanted), f"{FILE_ORDER[0]} string, {FILE_ORDER[1]} long, {FILE_ORDER[2]} long"]))
    message = F.concat(F.lit("row with another number of fields than the header in "), F.col(FILE_ORDER[0]), F.lit(": "), F.col(RAGGED))
    # The check is a column of every row, so that no plan can leave it out by itself.
    first = F.when(F.col(RAGGED).isNotNull(), F.raise_error(message).cast("string")).otherwise(F.col(FILE_ORDER[0]))
    raw = raw.withColumn(FILE_ORDER[0], first).filter(F.col(FILE_ORDER[0]).isNotNull())
    return raw.select(
        *[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in wanted],
        *FILE_ORDER,
    )


def arriving_files(spark: SparkSession, folder: str, at_once: int) -> DataFrame:
    """Paths of the files that arrive in a folder, as a stream of at most ``at_once`` files a batch.

    Files are listed by their lines, so one without any line is left out; what they hold is for
    ``read_extract`` to read.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", at_once).text(folder)
    return lines.select(F.col("_metadata.file_path").alias("path"))


# Labelled rows of a rubric export.
EXPORT_NAME = "Entity name"
EXPORT_REFERENCE = "Reference number"
ACCOUNT_KEY = "^[0-9]"


def read_rubric_exports(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rubric exports without header: one file per filing, key and value per row.

    The filing id is the file name without its ending; ``pos`` is the order of a row in its file.
    All rows are returned with ``code`` and ``period`` as rubrics have them; the code of a row
    that is not an account line (company name, reference) is null. So these rows can be given to
    ``published_financials``, which tells a landed export without account lines from none.
    """
    rows = (
        spark.read.schema(text_schema(["key", "value"]))
        .options(header="false", quote='"', escape='"')
        .csv(path)
    )
    file_name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return with_row(with_file(rows)).select(
        F.regexp_replace(file_name, r"\.[^.]*$", "").alias("filing_id"),
        F.col(FILE_ORDER[2]).alias("pos"),
        "key",
        F.when(F.col("key").rlike(ACCOUNT_KEY), F.col("key")).alias("code"),
        "value",
        F.lit("N").alias("period"),
        *FILE_ORDER,
    )


def read_report(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """An exported company report, with a byte order mark or not, plus parsed numbers."""
    rows = spark.read.options(**csv_options()).csv(path)
    marked = rows.columns[0]
    return with_report_numbers(rows.withColumnRenamed(marked, marked.lstrip("\ufeff")))


# Report headers that hold numbers, and the columns they are parsed into.
REPORT_NUMBERS = {
    "Revenue EUR": "revenue",
    "Net profit/loss EUR": "netResult",
    "Total employees FTE": "fte",
}


def with_report_numbers(rows: DataFrame) -> DataFrame:
    return rows.select(
        "*",
        *[
            (
                imported_number(F.col(f"`{header}`"))
                if header in rows.columns
                else F.lit(None).cast("double")
            ).alias(name)
            for header, name in REPORT_NUMBERS.items()
        ],
    )
