import random

from pyspark.sql import functions as F

from firmatlas.operators import ranges
from firmatlas.plans import market


def test_pages_open_only_their_ranges(spark, tmp_path):
    rng = random.Random(1)
    numbers = [f"{rng.randrange(10**9):09d}" for _ in range(5000)]
    df = spark.createDataFrame([(n,) for n in numbers], "n string")
    ranges.store_ranges(df, [F.col("n").asc()], str(tmp_path))
    ordered = sorted(numbers)
    assert ranges.total(spark, str(tmp_path)) == 5000
    for offset, limit in ((0, 5), (1234, 50), (4990, 50), (5000, 5), (0, 5000), (10**9, 5)):
        page = ranges.page(spark, str(tmp_path), offset, limit)
        got = sorted((r["rank"], r["n"]) for r in page.collect())
        assert got == list(enumerate(ordered[offset : offset + limit], start=offset))
    files = {f for f in ranges.page(spark, str(tmp_path), 2500, 5).inputFiles()}
    plan = ranges.page(spark, str(tmp_path), 2500, 5)._jdf.queryExecution().executedPlan().toString()
    assert files and "PartitionFilters: [" in plan and "rangePart" in plan
    ranked = {r["n"]: r["rank"] for r in ranges.with_ranks(spark, str(tmp_path)).collect()}
    assert [ranked[n] for n in ordered] == sorted(ranked.values())


def test_equal_rows_and_no_rows(spark, tmp_path):
    ranges.store_ranges(spark.range(300).select(F.lit("x").alias("n")), [F.col("n").asc()], str(tmp_path / "a"))
    assert sorted(r["rank"] for r in ranges.with_ranks(spark, str(tmp_path / "a")).collect()) == list(range(300))
    ranges.store_ranges(spark.createDataFrame([], "n string"), [F.col("n").asc()], str(tmp_path / "b"))
    assert ranges.total(spark, str(tmp_path / "b")) == 0
    assert ranges.page(spark, str(tmp_path / "b"), 0, 10).collect() == []
    assert ranges.with_ranks(spark, str(tmp_path / "b")).collect() == []


def test_dutch_name_order(spark, tmp_path):
    names = ["Zoë", "zoe", "Élan", "elan b", "Eland", "Ångström", "angstrom", "de Wit", "DE WIT", None]
    df = spark.createDataFrame([(n, f"{i}") for i, n in enumerate(names)], "name string, enterpriseNumber string")
    ranges.store_ranges(df, market.name_order(), str(tmp_path))
    got = [r["enterpriseNumber"] for r in sorted(ranges.with_ranks(spark, str(tmp_path)).collect(), key=lambda r: r["rank"])]
    assert got == [r["enterpriseNumber"] for r in market.filter_companies(df, descending=False).collect()]
    assert got == ["9", "5", "6", "7", "8", "2", "3", "4", "0", "1"]
