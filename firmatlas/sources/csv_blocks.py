"""Rows of CSV files whose quoted fields may hold line breaks, read by many tasks.

A file is cut into blocks as any text file is, so a block may begin within a quoted field. Whether it does is
the parity of all quotes before it. One scan counts per block the lines with an odd number of quotes;
sums of these counts over the earlier blocks of a file give the state at each block's start. Blocks that
start outside a field and have no odd line hold one row per line, and these lines go to the parser where they
are. In the others the task that reads a block finds the lines that open and close a row and joins what
lies between them; rows that go over blocks are put together from one piece per block.

Only doubled quotes stand for a quote within a field (RFC 4180). A quote elsewhere would shift the state
of all that follows, so every line or row is checked: a quote that neither opens nor closes a field ends
the read with its file, and so does a field that is still open at the end of a file.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firmatlas.session import work_folder

# Columns that give the order of the rows in the files of one delivery.
FILE_ORDER = ["sourceFile", "sourceBlock", "sourceRow"]
FILE, BLOCK, ROW = FILE_ORDER
#: So many blocks fill some 100 MB of a broadcast: about 50 TB at the default size of 128 MB.
MOST_BROADCAST = 400_000


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Physical lines with their file, block and order within the block."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(ROW),
        "value",
    )


def _odd(text: Column) -> Column:
    """1 for a text with an odd number of quotes, else 0."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit('"')))) % 2


def _bare(line: Column) -> Column:
    """A line or row without byte order mark and carriage return."""
    # Patterns are for the lines that have one of these at all.
    marked = F.contains(line, F.lit("\r")) | F.startswith(line, F.lit("\ufeff"))
    return F.when(marked, F.regexp_replace(F.regexp_replace(line, "^\ufeff", ""), "\r$", "")).otherwise(line)


def _is_header(value: Column, header: str) -> Column:
    return _bare(value) == header


def header_line(spark: SparkSession, path: str | list[str]) -> str | None:
    """The first line of one of the files; null where all are empty."""
    first = _lines(spark, path).filter(F.col(BLOCK) == 0).select(_bare(F.col("value"))).first()
    return None if first is None else first[0]


def header_names(header: str) -> list[str]:
    return [name or f"_c{i}" for i, name in enumerate(next(csv.reader([header])))]


def blocks(spark: SparkSession, path: str | list[str], header: str) -> tuple[DataFrame, int, int, int]:
    """One row per block: whether it starts within a field, whether its rows are lines, and whether a row goes
    over one of its edges; and how many blocks there are, how many of lines, and how many start within a field.

    Ends with an error that names a file whose first line is not the header, or at whose end a field is open.
    """
    is_header = _is_header(F.col("value"), header)
    found = _lines(spark, path).groupBy(FILE, BLOCK).agg(
        F.sum(_odd(F.col("value"))).alias("odd"), F.count_if(is_header).alias("headers"), F.min_by(is_header, ROW).alias("right")
    )
    folder = work_folder(spark, "csv-blocks")
    found.write.parquet(folder)
    own = Window.partitionBy(FILE)
    found = spark.read.schema(found.schema).parquet(folder)
    found = found.withColumn("inside", (F.sum("odd").over(own.orderBy(BLOCK)) - F.col("odd")) % 2)
    ends_open = F.coalesce(F.lead("inside").over(own.orderBy(BLOCK)), F.lit(0)) == 1
    found = found.withColumn("edge", (F.col("inside") == 1) | ends_open)
    found = found.withColumn("open", F.sum("odd").over(own) % 2 == 1)
    simple = (F.col("inside") == 0) & (F.col("odd") == 0) & ((F.col(BLOCK) > 0) | (F.col("headers") == 1))
    found = found.withColumn("simple", simple)
    wrong = F.min(F.when((F.col(BLOCK) == 0) & ~F.col("right"), F.col(FILE)))
    inside = F.count_if(F.col("inside") == 1)
    n, lines, inside, wrong, open_ = found.agg(F.count("*"), F.count_if("simple"), inside, wrong, F.min(F.when(F.col("open"), F.col(FILE)))).first()
    if wrong:
        raise ValueError(f"a file has another header: {wrong}")
    if open_:
        raise ValueError(f"a quoted field is open at the end of {open_}")
    return found.select(FILE, BLOCK, "inside", "simple", "edge"), n, lines, inside


def _pieces(batches: Iterator[pa.RecordBatch], across: bool) -> Iterator[pa.RecordBatch]:
    """Rows of the blocks of a task, put together line by line: those that lie within their block, or else
    the pieces of those that go over blocks. A piece that began in an earlier block has no row number."""
    block, open_, first, parts = None, 0, None, []
    schema = pa.schema([(FILE, pa.string()), (BLOCK, pa.int64()), (ROW, pa.int64()), ("value", pa.string())])

    for batch in batches:
        out = []
        for file, start, row, value, inside in zip(*(batch.column(c).to_pylist() for c in (*FILE_ORDER, "value", "inside"))):
            odd = value.count('"') & 1
            if (file, start) != block:
                if parts and across:
                    out.append((*block, first, "\n".join(parts)))
                block, open_, first, parts = (file, start), inside, None, []
                if start == 0:
                    # The header.
                    open_ ^= odd
                    continue
            if open_:
                parts.append(value)
                if odd:
                    if (first is None) == across:
                        out.append((file, start, first, "\n".join(parts)))
                    open_, first, parts = 0, None, []
            elif odd:
                open_, first, parts = 1, row, [value]
            elif not across:
                out.append((file, start, row, value))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if parts and across:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*block, first, "\n".join(parts)), schema)], schema=schema)


def _rows_within(lines: DataFrame, ordered: bool, across: bool) -> DataFrame:
    """Rows of blocks in which some go over several lines, or that start within one.

    A block is read by one task in line order, so its rows are put together in that task; only
    pieces at the edges of blocks are shuffled, if there are any (``across``).
    """
    schema = f"{FILE} string, {BLOCK} long, {ROW} long, value string"
    if not ordered:
        lines = lines.repartition(FILE, BLOCK).sortWithinPartitions(*FILE_ORDER)
    given = [*FILE_ORDER, "value", "inside"]
    whole = lines.select(*given).mapInArrow(lambda batches: _pieces(batches, False), schema)
    if not across:
        return whole
    pieces = lines.filter("edge").select(*given).mapInArrow(lambda batches: _pieces(batches, True), schema)
    # One piece at most at a block's end, and one at its start.
    by_file = Window.partitionBy(FILE).orderBy(BLOCK, F.col(ROW).asc_nulls_first())
    pieces = pieces.withColumn("chain", F.count(ROW).over(by_file.rowsBetween(Window.unboundedPreceding, 0)))
    joined = pieces.groupBy(FILE, "chain").agg(F.array_sort(F.collect_list(F.struct(BLOCK, F.coalesce(ROW, F.lit(-1)).alias(ROW), "value"))).alias("parts"))
    joined = joined.select(
        FILE,
        F.col("parts")[0][BLOCK].alias(BLOCK),
        F.col("parts")[0][ROW].alias(ROW),
        F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"),
    )
    return whole.unionByName(joined)


def _misplaced(text: Column) -> Column:
    """Whether a quote stands where it neither opens nor closes a field, or a field is left open.

    There are no lambdas in it: with one, Spark would generate no code for the step that checks every row.
    """
    rest = F.replace(text, F.lit('""'), F.lit(""))
    # Each quoted text as one quote, which needs an edge or a comma on either side.
    marks = F.regexp_replace(rest, '"[^"]*"', '"')
    return F.contains(rest, F.lit('"')) & ((_odd(rest) == 1) | marks.rlike('[^,]"|"[^,]'))


def csv_rows(spark: SparkSession, path: str | list[str], header: str) -> DataFrame:
    """``FILE_ORDER`` and ``value``, the text of every row below the header; blank lines are left out.

    Row numbers rise within a block, whatever task reads it.
    """
    states, n, simple, inside = blocks(spark, path, header)
    known = F.broadcast(states) if n <= MOST_BROADCAST else states
    lines = _lines(spark, path).join(known, [FILE, BLOCK], "left")
    # Blocks are those of the first scan, unless the session's split size has changed since.
    message = F.concat(F.lit("files are split otherwise than before: "), F.col(FILE))
    lines = lines.withColumn("simple", F.coalesce("simple", F.raise_error(message).cast("boolean")))
    columns = [*FILE_ORDER, "value"]
    parts = []
    if simple:
        parts.append(lines.filter("simple").filter((F.col(BLOCK) > 0) | ~_is_header(F.col("value"), header)).select(*columns))
    if simple < n:
        parts.append(_rows_within(lines.filter(~F.col("simple")), n <= MOST_BROADCAST, inside > 0))
    if not parts:
        return lines.select(*columns)
    rows = reduce(DataFrame.unionByName, parts).withColumn("value", _bare(F.col("value"))).filter("value <> ''")
    message = F.concat(F.lit("a quote within an unquoted field in "), F.col(FILE), F.lit(": "), F.substring("value", 1, 500))
    return rows.withColumn("value", F.when(_misplaced(F.col("value")), F.raise_error(message).cast("string")).otherwise(F.col("value")))
