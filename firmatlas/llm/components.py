"""Connected components of an edge table by alternating star contraction.

Every round replaces each edge by an edge to the smallest known neighbour: first for the
larger neighbours of a node, then for the smaller ones. It ends with one star per component,
after a number of rounds that grows with the logarithm of the node count. All steps are
grouped minima with partial aggregation and equality joins, so a hub with many edges is
pre-aggregated, and the join against its minimum is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from firmatlas.llm.store import scratch, written


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One contraction; edges hold (a, b) with a > b."""
    if larger:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        moved = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        pairs = edges.join(low, "a")
        moved = pairs.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
    return moved.filter(F.col("a") > F.col("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest node."""
    with scratch(edges.sparkSession):
        return written(_contracted(edges, a, b, rounds), "components", keep=True)


def _contracted(edges: DataFrame, a: str, b: str, rounds: int) -> DataFrame:
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct()
    edges = written(edges, "links")
    mark = None
    for _ in range(rounds):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        edges = written(_stars(_stars(edges, True), False), "links")
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
