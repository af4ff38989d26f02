"""A stored n-gram index of company names, so that a lookup by part of a name reads few of them.

``grams`` has every piece of one to three characters of all names (in lower case), with the number of
names that hold it, the lowest company whose name holds it and the lowest whose name is it. ``postings`` has
for every piece of three characters the names that hold it and where; it is partitioned by a hash of the
piece and sorted by it. A text of up to three characters is answered from ``grams``. A longer one asks for
its rarest piece, or is known to be in no name when one of its pieces is in none; only the postings of rarest
pieces are read, and at their places the names are cut as the texts asked for are, so that texts and names
meet by equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmatlas.operators.keyed import dealt, task_count
from firmatlas.operators.registry import NUMBER
from firmatlas.session import work_folder

GRAM = 3
#: Folders of postings; a piece lies in one of them.
PARTS = 64
#: Bytes of stored names for a task that takes them to pieces.
NAME_BYTES = 256 << 10
GRAMS_SCHEMA = "gram string, names long, lowest string, own string"
POSTINGS_SCHEMA = f"gram string, text string, {NUMBER} string, ats array<int>, part int"


def _part(gram: str):
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def known_names(denomination: DataFrame) -> DataFrame:
    """Every name in lower case once, with the lowest company that has it."""
    rows = denomination.filter(F.col("enterpriseId").isNotNull() & F.col("denomination").isNotNull())
    return rows.groupBy(F.lower("denomination").alias("text")).agg(F.min("enterpriseId").alias(NUMBER))


def _pieces(column: str, size: int):
    """All pieces of a size with their places (from 1); none of a shorter text."""
    places = F.when(F.length(column) >= size, F.sequence(F.lit(1), F.length(column) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda at: F.struct(F.substring(F.col(column), at, F.lit(size)).alias("gram"), at.alias("at")))


def write_index(denomination: DataFrame, folder: str) -> None:
    """Build the index of all company names below a folder."""
    known = known_names(denomination)
    tasks = task_count(known, NAME_BYTES)
    known = dealt(known, "text", tasks=tasks)
    # A name is one row, so its pieces are told apart in it.
    every = F.array_distinct(F.flatten(F.array(*(F.transform(_pieces("text", n), lambda p: p["gram"]) for n in range(1, GRAM + 1)))))
    pieces = known.select("text", NUMBER, F.explode(every).alias("gram"))
    own = F.min(F.when(F.col("text") == F.col("gram"), F.col(NUMBER)))
    grams = pieces.groupBy("gram").agg(F.count("*").alias("names"), F.min(NUMBER).alias("lowest"), own.alias("own"))
    grams.sort("gram").write.mode("overwrite").parquet(f"{folder}/grams")
    whole = known.select("text", NUMBER, _pieces("text", GRAM).alias("pieces"))
    held = whole.select("text", NUMBER, "pieces", F.explode(F.array_distinct(F.transform("pieces", lambda p: p["gram"]))).alias("gram"))
    ats = F.transform(F.filter("pieces", lambda p: p["gram"] == F.col("gram")), lambda p: p["at"])
    postings = held.select("gram", "text", NUMBER, ats.alias("ats"), _part("gram").alias("part"))
    # Each part is dealt by names, so that a piece that very many names hold is written by several tasks.
    share = F.pmod(F.xxhash64("text"), F.lit(-(-tasks // PARTS))).alias("share")
    order = ["part", "gram", "text"]
    placed = postings.withColumn("share", share).repartition(max(tasks, PARTS), "part", "share").drop("share")
    placed.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("part").parquet(f"{folder}/postings")


def _grams(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(GRAMS_SCHEMA).parquet(f"{folder}/grams")


def postings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(POSTINGS_SCHEMA).parquet(f"{folder}/postings")


def rarest_pieces(asked: DataFrame, grams: DataFrame) -> DataFrame:
    """text, gram and its place of every asked text of ``GRAM`` characters or more whose pieces all occur."""
    own = asked.filter(F.length("text") >= GRAM).select("text", F.explode(_pieces("text", GRAM)).alias("p")).select("text", "p.*")
    rated = own.join(grams.filter(F.length("gram") == GRAM).select("gram", "names"), "gram", "left")
    # A piece without a posting counts as the rarest.
    best = F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram", "at"))
    return rated.groupBy("text").agg(best.alias("best")).filter("best.names > 0").select("text", "best.gram", "best.at")


def resolve(asked: DataFrame, folder: str) -> DataFrame:
    """Distinct search texts (lower case, not empty) with the lowest company that carries the name.

    A text equal to a name wins; otherwise names that contain it count. Every task holds one row at a time:
    a piece is joined with the places and lengths at which some text asks for it, and names are cut there.
    """
    spark = asked.sparkSession
    grams = _grams(spark, folder)
    short = asked.filter(F.length("text") <= GRAM).join(grams.withColumnRenamed("gram", "text"), "text")
    short = short.select("text", F.coalesce("own", "lowest").alias(NUMBER))
    # Written, since three steps read it.
    path = work_folder(spark, "asked-pieces")
    rarest_pieces(dealt(asked.filter(F.length("text") > GRAM), "text"), grams).write.parquet(path)
    wanted = spark.read.schema("text string, gram string, at int").parquet(path)
    cuts = wanted.groupBy("gram").agg(F.collect_set(F.struct("at", F.length("text").alias("size"))).alias("cuts"))
    cuts = cuts.withColumn("part", _part("gram"))
    parts = sorted(r["part"] for r in cuts.select("part").distinct().collect())
    held = postings(spark, folder).filter(F.col("part").isin(parts)).join(cuts, ["part", "gram"])
    held = held.select(F.col("text").alias("name"), NUMBER, "ats", F.explode("cuts").alias("cut"))
    held = held.select("name", NUMBER, "cut.size", F.explode("ats").alias("at"), F.col("cut.at").alias("inset"))
    start = F.col("at") - F.col("inset") + 1
    pieces = held.filter((start >= 1) & (start + F.col("size") - 1 <= F.length("name"))).select(
        F.substring(F.col("name"), start, F.col("size")).alias("text"), NUMBER, (F.col("size") < F.length("name")).alias("within")
    )
    found = pieces.join(wanted.select("text").hint("merge"), "text", "left_semi").groupBy("text").agg(F.min_by(NUMBER, F.struct("within", NUMBER)).alias(NUMBER))
    return asked.join(short.unionByName(found).hint("merge"), "text", "left")
