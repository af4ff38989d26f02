"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows that the stage
before it kept. ``run`` writes every stage as Parquet in the shared folder that the session names in
``spark.checkpoint.dir`` and reads it again, so that a lost executor repeats one stage at most. All
stages but the last return the columns of their input, whatever further columns it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from firmatlas.llm import decontaminate, lines, minhash, mixing, toxicity
from firmatlas.llm.store import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier chain, trained on the labels, rejects."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).filter(~F.col("rejected")).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later copies of runs of lines of 50 words or more; a document that loses all its words goes."""
    found = lines.deduplicated(docs, min_words=50)
    found = found.filter((F.size("deleted") == 0) | F.col("text").rlike(r"[^ \t\n\x0B\f\r]"))
    return found.select(*(_column(c) for c in docs.columns))


def _column(name: str):
    changed = F.size("deleted") > 0
    if name == "text":
        return F.col("text")
    if name == "n_chars":
        return F.when(changed, F.length("text").cast("long")).otherwise(F.col("row.n_chars")).alias(name)
    return F.col(f"row.`{name}`").alias(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more).

    Every row is a document of its own, whatever its doc_id. Of a group the lowest doc_id stays (rows without
    one come last), of rows that share it the lowest hash of the text.
    """
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    if shared.limit(1).count():
        return _one_row_of_each(docs)
    kept = minhash.near_duplicates(docs, size=5, percent=80).filter("kept").select("doc_id")
    return docs.join(written(kept, "near-kept"), "doc_id", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def _one_row_of_each(docs: DataFrame) -> DataFrame:
    """The same where doc_ids don't name rows: rows are numbered in a copy first."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("text_key"))
    rows = written(docs.select(F.struct(*columns).alias("row"), key.alias("key"), F.monotonically_increasing_id().alias("place")), "near-rows")
    found = minhash.near_duplicates(rows.select(F.col("place").alias("doc_id"), F.col("row.text").alias("text")), size=5, percent=80)
    found = found.select(F.col("doc_id").alias("place"), "component_id")
    placed = found.join(rows.select("place", "key"), "place")
    kept = placed.groupBy("component_id").agg(F.min(F.struct("key", "place")).alias("first"))
    kept = written(kept.select(F.col("first.place").alias("place")), "near-kept")
    return rows.join(kept, "place", "left_semi").select("row.*")


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of ten words of a benchmark item."""
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"), size=10, mode="documents")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of copies and words it takes of each."""
    found = mixing.mixed(docs, share=1.0, passes=3).filter("copies > 0")
    return found.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in MIX), *MIX)


MIX = ("size", "source_size", "target", "copies", "taken")

STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_copies),
    ("mixing", mix_sources),
]

#: The first stage is a trained model and has no SQL form; tests/llm checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
