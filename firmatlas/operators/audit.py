"""Load audit and referential checks."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmatlas.operators.bloom import PARTS, admitted, bloom_filter
from firmatlas.operators.staging import source_filter
from firmatlas.schemas import RELATIONS, TABLES, Relation

Frames = Mapping[str, DataFrame]


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def audit_load(sources: Frames, tables: Frames) -> DataFrame:
    """Per table: eligible distinct source keys, loaded rows, difference and verdict.

    ``sources`` holds the raw extracts. All counts are one job.
    """
    counts = [
        _stack(
            [
                sources[name]
                .filter(source_filter(name))
                .select(*spec.source_key)
                .distinct()
                .agg(F.count("*").alias("expected"), F.lit(0).cast("bigint").alias("loaded")),
                tables[name].agg(
                    F.lit(0).cast("bigint").alias("expected"), F.count("*").alias("loaded")
                ),
            ]
        ).select(F.lit(position).alias("position"), F.lit(name).alias("table"), "*")
        for position, (name, spec) in enumerate(TABLES.items())
        if name in sources and name in tables
    ]
    return (
        _stack(counts)
        .groupBy("position", "table")
        .agg(F.sum("expected").alias("expected"), F.sum("loaded").alias("loaded"))
        .select(
            "position",
            "table",
            "expected",
            "loaded",
            (F.col("loaded") - F.col("expected")).alias("difference"),
            F.when(F.col("loaded") == F.col("expected"), "MATCH").otherwise("MISMATCH").alias("status"),
            (F.col("loaded") < F.col("expected")).alias("incomplete"),
        )
        .orderBy("position")
        .drop("position")
    )


def load_plan(audit: DataFrame) -> DataFrame:
    """Which tables an incremental load has to read again."""
    return audit.select(
        "table",
        "expected",
        "loaded",
        F.when(F.col("incomplete"), "LOAD").otherwise("skip").alias("action"),
    )


REFERENCE = ["parent", "category", "ref"]


def _references(tables: Frames, relations: list[Relation]) -> DataFrame:
    """Every distinct value of every foreign key, with the number of its rows.

    Each child table is read once, whatever the number of its relations.
    """
    parts = []
    for child in dict.fromkeys(r.child for r in relations):
        own = [r for r in relations if r.child == child]
        entries = [
            F.struct(
                F.lit(r.name).alias("relation"),
                F.lit(r.parent).alias("parent"),
                F.lit(r.category).cast("string").alias("category"),
                F.col(r.column).alias("ref"),
            )
            for r in own
        ]
        parts.append(tables[child].select(F.inline(F.array(*entries))))
    # Null references stay as one row per relation, so that every relation is reported.
    return _stack(parts).groupBy("relation", *REFERENCE).agg(F.count("*").alias("n"))


def _parents(tables: Frames, relations: list[Relation]) -> DataFrame:
    """Every value that a foreign key may point to."""
    keys = []
    for parent, category in dict.fromkeys((r.parent, r.category) for r in relations):
        key = "code" if category else TABLES[parent].key[0]
        rows = tables[parent].filter(F.col("category") == category) if category else tables[parent]
        keys.append(
            rows.select(
                F.lit(parent).alias("parent"),
                F.lit(category).cast("string").alias("category"),
                F.col(key).alias("ref"),
                F.lit(True).alias("known"),
            )
        )
    return _stack(keys)


def _with_parents(counted: DataFrame, known: DataFrame) -> DataFrame:
    """relation, parent, n and whether the value is an orphan."""
    counted, known = counted.alias("c"), known.alias("k")
    joined = counted.join(
        known,
        (F.col("c.parent") == F.col("k.parent"))
        & F.col("c.category").eqNullSafe(F.col("k.category"))
        & (F.col("c.ref") == F.col("k.ref")),
        "left",
    )
    orphan = F.col("known").isNull() & F.col("c.ref").isNotNull()
    return joined.select("relation", F.col("c.parent").alias("parent"), "n", orphan.alias("orphan"))


def _orphan_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("relation", "parent").agg(
        F.coalesce(F.sum(F.when(F.col("orphan"), F.col("n"))), F.lit(0)).alias("orphanRows"),
        F.count_if("orphan").alias("orphanValues"),
    )


def orphan_check(tables: Frames, relations: list[Relation] = RELATIONS) -> DataFrame:
    """Rows per foreign key whose parent is missing (nulls are allowed).

    References are counted per distinct value before the join, so a parent that very many rows point to
    costs one row.
    """
    return _orphan_counts(_with_parents(_references(tables, relations), _parents(tables, relations)))


def split_references(
    tables: Frames, work: str, relations: list[Relation] = RELATIONS, parts: int = PARTS
) -> tuple[DataFrame, DataFrame]:
    """Counted references that a Bloom filter of all parents denies, and those left for the join.

    They are written to ``work``, since both are read.
    """
    known, counted = _parents(tables, relations), _references(tables, relations)
    spark = counted.sparkSession
    table = bloom_filter(known, REFERENCE, parts)
    table.write.mode("overwrite").parquet(f"{work}/parents")
    table = spark.read.schema(table.schema).parquet(f"{work}/parents")
    marked = admitted(counted, REFERENCE, table, parts)
    marked.write.mode("overwrite").parquet(f"{work}/references")
    marked = spark.read.schema(marked.schema).parquet(f"{work}/references")
    denied = F.col("ref").isNotNull() & ~F.col("admitted")
    return marked.filter(denied).drop("admitted"), marked.filter(~denied).drop("admitted")


def orphan_check_filtered(
    tables: Frames, work: str, relations: list[Relation] = RELATIONS, parts: int = PARTS
) -> DataFrame:
    """``orphan_check`` for tables with many orphans: a value that no parent can have is counted where it
    is, and only the others are shuffled to their parents."""
    denied, rest = split_references(tables, work, relations, parts)
    sure = denied.select("relation", "parent", "n", F.lit(True).alias("orphan"))
    return _orphan_counts(sure.unionByName(_with_parents(rest, _parents(tables, relations))))
