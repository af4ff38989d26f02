"""Companies per activity code, stored so that distinct counts of any code prefix come from few rows.

Companies are numbered by postal code; each postal code begins a new byte. Prefixes of up to ``SHORT`` characters
have, for every 32,768 numbers, a bitmap of the companies that are active under them, alone and over all
classifications and versions: the count of such a prefix in a postal code is the number of bits in its bytes.
A bitmap takes 4 KB however few companies it has, so longer codes, which are many and have few companies each,
are kept as rows sorted by code: what a longer prefix asks for lies together, and only that is counted.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firmatlas.operators import ranges
from firmatlas.operators.keyed import dealt
from firmatlas.operators.registry import NUMBER, clean, registered_offices
from firmatlas.schemas import UNKNOWN_POSTAL_CODE

Tables = Mapping[str, DataFrame]
EVERY = ""
BITS, BYTES = 32768, 4096
#: Characters of the longest prefixes that have bitmaps: some hundreds of prefixes, whatever the code list.
SHORT = 2


def active_companies(tables: Tables) -> DataFrame:
    """Distinct (version, classification, code, company), of companies and of their establishments."""
    keys = ["naceVersion", "classification", "naceCode"]
    activity = tables["Activity"].filter(F.col("naceCode").isNotNull())
    keyed = [F.coalesce(c, F.lit("\0")).alias(c) for c in keys[:2]] + [F.col("naceCode")]
    own = activity.filter(F.col("enterpriseId").isNotNull()).select(*keyed, F.col("enterpriseId").alias(NUMBER))
    units = activity.filter(F.col("establishmentId").isNotNull()).select(*keyed, F.col("establishmentId").alias("establishmentNumber")).distinct()
    owners = units.join(tables["Establishment"].select("establishmentNumber", NUMBER), "establishmentNumber")
    return own.unionByName(owners.select(*keys, NUMBER)).distinct()


def _numbered(hits: DataFrame, tables: Tables, folder: str) -> tuple[DataFrame, DataFrame]:
    """Postal code and place of every (company, postal code), and first byte and length of every postal code.

    A company counts in each registered office it has, as it does when hits are joined with addresses.
    """
    office = registered_offices(tables["KBOAddress"]).select(F.col("enterpriseId").alias(NUMBER), "zipcode")
    postal = F.coalesce(F.nullif("zipcode", F.lit("")), F.lit(UNKNOWN_POSTAL_CODE)).alias("postalCode")
    companies = hits.select(NUMBER).distinct().join(office, NUMBER, "left").select(NUMBER, postal)
    ranges.store_ranges(companies, [F.col("postalCode").asc(), F.col(NUMBER).asc_nulls_last()], f"{folder}/companies")
    ranked = ranges.with_ranks(hits.sparkSession, f"{folder}/companies")
    codes = ranked.groupBy("postalCode").agg(F.min(ranges.RANK).alias("first"), F.count("*").alias("n"))
    # One row for each postal code.
    before = Window.orderBy("postalCode").rowsBetween(Window.unboundedPreceding, -1)
    length = F.ceil(F.col("n") / 8)
    codes = codes.withColumn("bytes", length).withColumn("byte", F.coalesce(F.sum(length).over(before), F.lit(0)))
    placed = ranked.join(codes.select("postalCode", "first", "byte"), "postalCode")
    place = (F.col("byte") * 8 + F.col(ranges.RANK) - F.col("first")).alias("place")
    return placed.select(NUMBER, "postalCode", place), codes.select("postalCode", "byte", "bytes")


def write_bitmaps(tables: Tables, folder: str) -> None:
    """Write the bitmaps of short prefixes, where postal codes lie in them, and the rows of all codes."""
    spark = tables["Activity"].sparkSession
    hits = active_companies(tables)
    hits.write.mode("overwrite").parquet(f"{folder}/hits")
    hits = spark.read.schema(hits.schema).parquet(f"{folder}/hits")
    placed, codes = _numbered(hits, tables, folder)
    # The part of a postal code in each bitmap that it reaches into.
    first, last = F.floor(F.col("byte") / BYTES), F.floor((F.col("byte") + F.col("bytes") - 1) / BYTES)
    spans = codes.select("postalCode", "byte", "bytes", F.explode(F.sequence(first, last)).alias("bucket"))
    start = F.greatest(F.col("byte") - F.col("bucket") * BYTES, F.lit(0))
    end = F.least(F.col("byte") + F.col("bytes") - F.col("bucket") * BYTES, F.lit(BYTES))
    spans = spans.select("postalCode", F.col("bucket").cast("long").alias("bucket"), start.cast("int").alias("start"), (end - start).cast("int").alias("length"))
    spans.write.mode("overwrite").parquet(f"{folder}/spans")
    keys = ["naceVersion", "classification", "naceCode"]
    rows = hits.join(placed, NUMBER).select(*keys, "postalCode", "place")
    order = ["naceCode", "naceVersion", "classification", "place"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{folder}/rows")
    rows = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    # One bitmap for each longest prefix with its version and classification. Its rows are brought together first,
    # since a bitmap that is begun in every task takes more than the rows that it is made of.
    rows = rows.select(
        "naceVersion", "classification", F.substring("naceCode", 1, SHORT).alias("prefix"),
        F.floor(F.col("place") / BITS).cast("long").alias("bucket"), (F.col("place") % BITS).alias("bit"),
    ).filter("prefix <> ''")
    own = ["prefix", "naceVersion", "classification", "bucket"]
    leaves = dealt(rows.distinct(), *own).groupBy(*own).agg(F.bitmap_construct_agg("bit").alias("bits"))
    leaves.write.mode("overwrite").parquet(f"{folder}/leaves")
    leaves = spark.read.schema(leaves.schema).parquet(f"{folder}/leaves")
    # Every prefix in its own prefixes, with and without its classification and version.
    prefixes = F.transform(F.sequence(F.lit(1), F.length("prefix")), lambda n: F.substring(F.col("prefix"), F.lit(1), n))
    wide = leaves.select(F.explode(prefixes).alias("prefix"), "naceVersion", "classification", "bucket", "bits")
    for name in ("naceVersion", "classification"):
        others = [c for c in wide.columns if c != name]
        wide = wide.select(F.explode(F.array(name, F.lit(EVERY))).alias(name), *others)
    united = dealt(wide, *own).groupBy(*own).agg(F.bitmap_or_agg("bits").alias("bits"))
    united.repartitionByRange(*own).sortWithinPartitions(*own).write.mode("overwrite").parquet(f"{folder}/prefixes")


def _counts_by_rows(spark: SparkSession, folder: str, code: str, version: str | None, classification: str | None) -> DataFrame:
    """Companies of a longer prefix: its rows, found by pushed filters, each place once."""
    rows = spark.read.parquet(f"{folder}/rows").filter(F.col("naceCode").startswith(code))
    for name, value in (("naceVersion", version), ("classification", classification)):
        rows = rows.filter(F.col(name) == value) if value else rows
    return rows.select("postalCode", "place").distinct().groupBy("postalCode").agg(F.count("*").alias("enterpriseCount"))


def _counts_by_bits(spark: SparkSession, folder: str, code: str, version: str | None, classification: str | None) -> DataFrame:
    """Companies of a short prefix: as many bitmaps as there are 32,768 companies, found by pushed filters."""
    rows = spark.read.parquet(f"{folder}/prefixes")
    own = (F.col("prefix") == code) & (F.col("naceVersion") == (version or EVERY)) & (F.col("classification") == (classification or EVERY))
    found = rows.filter(own).select("bucket", "bits").join(spark.read.parquet(f"{folder}/spans"), "bucket")
    n = F.bitmap_count(F.substring(F.col("bits"), F.col("start") + 1, F.col("length")))
    return found.groupBy("postalCode").agg(F.sum(n).alias("enterpriseCount")).filter("enterpriseCount > 0")


def postal_counts(
    spark: SparkSession, folder: str, code: str, version: str | None = None, classification: str | None = None
) -> DataFrame:
    """What ``market.postal_counts`` gives, from the stored tables."""
    code, version, classification = clean(code) or "\0", clean(version), clean(classification)
    counts = _counts_by_bits if len(code) <= SHORT else _counts_by_rows
    return counts(spark, folder, code, version, classification).orderBy("postalCode")


def many_postal_counts(spark: SparkSession, folder: str, asked: list[tuple[str, str | None, str | None]]) -> DataFrame:
    """Counts of several (code, version, classification), told apart by these."""
    parts = [
        postal_counts(spark, folder, *one).select(*(F.lit(v).cast("string").alias(n) for n, v in zip(("code", "version", "classification"), one)), "postalCode", "enterpriseCount")
        for one in asked
    ]
    return reduce(DataFrame.unionByName, parts)
