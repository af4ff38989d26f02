"""Extracts read by many tasks give the rows that one task reads."""

import contextlib
import csv
import random

import pytest
from pyspark.sql import functions as F

from firmatlas.sources.csv_blocks import _bare, _misplaced
from firmatlas.sources.csv_files import FILE_ORDER, ragged_rows, read_extract, text_schema

HEADER = "Variable,Value"


@contextlib.contextmanager
def split_size(spark, size):
    """Files are cut into blocks of so many bytes, and small blocks share a task or don't."""
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": str(max(1, size // 3))}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in keys:
            spark.conf.unset(key)


def in_one_task(spark, path):
    """Spark's own reader, which can't split a file with line breaks in fields."""
    options = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}
    rows = spark.read.schema(text_schema(["Variable", "Value"])).options(**options).csv(path)
    return [tuple(r) for r in rows.collect()]


def in_blocks(spark, path, table="Meta"):
    rows = read_extract(spark, path, table).collect()
    rows.sort(key=lambda r: tuple(r[c] for c in FILE_ORDER))
    return [(r["Variable"], r["Value"]) for r in rows]


def random_file(seed, rows, end="\n"):
    """Text of a file and the rows that it holds; an empty field is null."""
    rng = random.Random(seed)
    pieces = ["a", "é", ",", '"', "\n", "\r\n", "x y", "", "ß" * 9, "\n\n", '""', "\n,\n", "𝄞"]
    out, want = [HEADER], []
    for i in range(rows):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(6)))
        quoted = any(c in text for c in ',"\n\r') or rng.random() < 0.3
        escaped = text.replace('"', '""')
        out.append(f'k{i},"{escaped}"' if quoted else f"k{i},{text}")
        want.append((f"k{i}", text or None))
    return end.join(out) + end * rng.randrange(2), want


def test_breaks_at_every_block_edge(spark, tmp_path):
    path = tmp_path / "meta.csv"
    path.write_text('Variable,Value\na,"x\ny"\nb,z\n\n"c,\n\n""d""\n","\n"\ne,"1\n2\n3\n4"\nf,"""\n"""\ng,"",\n'.replace('g,"",\n', 'g,""\n'), encoding="utf-8")
    want = in_one_task(spark, str(path))
    assert len(want) == 6 and ("a", "x\ny") in want and ("f", '"\n"') in want
    for size in (3, 10, 37):
        with split_size(spark, size):
            assert in_blocks(spark, str(path)) == want, size


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\r\n")])
def test_random_files(spark, tmp_path, seed, end):
    text, want = random_file(seed, 50, end)
    (tmp_path / "meta.csv").write_text(text, encoding="utf-8", newline="")
    for size in (90, 333, 1 << 20):
        with split_size(spark, size):
            assert in_blocks(spark, str(tmp_path)) == want, size
    with split_size(spark, 333):
        raw = read_extract(spark, str(tmp_path), "Meta")
        assert raw.select(F.countDistinct(FILE_ORDER[1])).first()[0] > 2


def test_a_field_longer_than_many_blocks(spark, tmp_path):
    long = "\n".join(f"line {i}, said" for i in range(100))
    (tmp_path / "1.csv").write_text(f'{HEADER}\na,"{long}"\nb,"{long}"\nc,1\n')
    (tmp_path / "2.csv").write_text(f'{HEADER}\nd,"{long}\n"\n')
    (tmp_path / "3.csv").write_text("")
    for size in (300, 1 << 20):
        with split_size(spark, size):
            assert in_blocks(spark, str(tmp_path)) == [("a", long), ("b", long), ("c", "1"), ("d", long + "\n")]


def test_large_blocks_of_lines_are_not_shuffled(spark, tmp_path):
    lines = [HEADER, *(f'k{i},"v, {i}"' for i in range(1000))]
    path = tmp_path / "meta.csv"
    path.write_text("\n".join(lines) + "\n")
    with split_size(spark, 4000):
        rows = read_extract(spark, str(path), "Meta")
        # The one exchange is that of the table of blocks.
        assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert rows.rdd.getNumPartitions() > 2 and rows.count() == 1000
    # One row with a line break: only its block is ordered by itself.
    lines[500] = 'x,"1\n2"'
    path.write_text("\n".join(lines) + "\n")
    with split_size(spark, 4000):
        assert in_blocks(spark, str(path)) == in_one_task(spark, str(path))


def test_header_lines_within_the_file(spark, tmp_path):
    """A data row that equals the header stays; a byte order mark goes."""
    path = tmp_path / "meta.csv"
    path.write_text(f"﻿{HEADER}\na,1\n{HEADER}\nb,2\n", encoding="utf-8")
    for size in (16, 1 << 20):
        with split_size(spark, size):
            assert in_blocks(spark, str(path)) == [("a", "1"), ("Variable", "Value"), ("b", "2")]


def test_ragged_rows_after_line_breaks(spark, tmp_path):
    (tmp_path / "meta.csv").write_text(f'{HEADER}\na,"1\n2"\nb\nc,"3\n4",5\nd,6\n')
    for size in (9, 1 << 20):
        with split_size(spark, size):
            assert [r["rows"] for r in ragged_rows(spark, str(tmp_path)).collect()] == [2]
            with pytest.raises(Exception, match="another number of fields.*meta.csv"):
                read_extract(spark, str(tmp_path), "Meta").select("Variable").collect()


@pytest.mark.parametrize("text, message", [
    ('a,12" pipe\nb,1\nc,3" nail\n', "quote within an unquoted field"),
    ('a,x"y"z\n', "quote within an unquoted field"),
    ('a,"x" \n', "quote within an unquoted field"),
    ('a,"x\nb,1\n', "open at the end"),
])
def test_quotes_that_would_shift_the_rest_are_refused(spark, tmp_path, text, message):
    (tmp_path / "meta.csv").write_text(f"{HEADER}\n{text}")
    with pytest.raises(Exception, match=message):
        read_extract(spark, str(tmp_path / "meta.csv"), "Meta").collect()


def test_doubled_quotes_everywhere(spark, tmp_path):
    values = ['"', '""', 'a"', '"a', '","', '"\n"', "", ",", "\n", 'a""b', '",\n"']
    with open(tmp_path / "meta.csv", "w", newline="") as file:
        writer = csv.writer(file, quoting=csv.QUOTE_ALL, lineterminator="\n")
        writer.writerows([["Variable", "Value"], *([f"k{i}", v] for i, v in enumerate(values))])
    for size in (20, 1 << 20):
        with split_size(spark, size):
            assert in_blocks(spark, str(tmp_path)) == [(f"k{i}", v or None) for i, v in enumerate(values)]


def test_empty_files_give_no_rows(spark, tmp_path):
    (tmp_path / "meta.csv").write_text("")
    assert read_extract(spark, str(tmp_path / "meta.csv"), "Meta").collect() == []
    (tmp_path / "meta.csv").write_text(HEADER)
    assert read_extract(spark, str(tmp_path / "meta.csv"), "Meta").collect() == []


def test_blocks_with_line_breaks_are_not_shuffled(spark, tmp_path):
    """Rows over several lines are joined by the task that reads their block."""
    path = tmp_path / "meta.csv"
    path.write_text(f"{HEADER}\n" + "".join(f'k{i},"v\n{i}"\n' for i in range(100)))
    rows = read_extract(spark, str(path), "Meta")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and in_blocks(spark, str(path)) == in_one_task(spark, str(path))


def test_marks_are_taken_off_as_the_patterns_do(spark):
    """Lines without a carriage return or byte order mark are spared the patterns."""
    values = ["a", "", "a\r", "a\r\r", "a\rb", "﻿a", "a﻿", "﻿a\r", "\r", "a\r "]
    line = F.col("value")
    always = F.regexp_replace(F.regexp_replace(line, "^﻿", ""), "\r$", "")
    rows = spark.createDataFrame([(v,) for v in values], "value string").select(_bare(line).alias("found"), always.alias("want"))
    assert all(r["found"] == r["want"] for r in rows.collect())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quotes_are_checked_in_generated_code(spark, tmp_path):
    texts = {'a,"b"': 0, '"a","b"': 0, '"a,""b"","': 0, '""': 0, ',"",': 0, 'a""b': 0, '"a\nb",c': 0, 'a"b",c': 1, '"a"b,c': 1, '"a': 1, 'a"': 1, '"a" ,b': 1, '"a","b"c': 1}
    rows = spark.createDataFrame(list(texts.items()), "value string, want int")
    found = {r["value"]: int(r["found"]) for r in rows.select("value", _misplaced(F.col("value")).alias("found")).collect()}
    assert found == texts
    (tmp_path / "a.csv").write_text(f'{HEADER}\nk,"v"\n')
    # All steps from the file to the fields are one generated step.
    assert "lambda" not in plan_of(read_extract(spark, str(tmp_path), "Meta"))
