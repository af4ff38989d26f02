"""A Merkle manifest of a dataset, and proofs of changed rows in versions that share what they don't change.

A leaf is the hash of a row's fields. Leaves of a group ascend by their order; every ``FANOUT`` consecutive
nodes of a level, and what is left over at its end, become the hash of their hex digests, until one is left,
the group's subroot. Subroots in order of their group (null first) become the root in the same way.

The tree is persistent: a changed leaf makes a version that copies the ancestors of that leaf and shares
every other node. Leaves are ranked by a range sort and dealt to blocks of ``BLOCK`` consecutive leaves, each
a whole subtree. A block holds its nodes once and copies paths for its changed leaves; block roots are
the leaves of the next tier of blocks, whose paths come down again as one row for each block. So a version goes
on through the upper levels where its leaf is, and no task holds more than a block and its path.

Defined cases: null fields count as ``-``; rows without doc_id come first in their group and are never
tampered with; rows that repeat a doc_id are ordered by their digest; equal rows have equal leaves at
places of their own; a group of one row has its leaf as subroot; an empty table gives an empty result;
columns besides the fields are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from firmatlas.llm.store import written

FANOUT = 8
#: Levels that a block spans, and so its leaves.
HEIGHT = 3
BLOCK = FANOUT**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(columns: list[Column]) -> Column:
    """Digest of fields in order: ``-`` for null, else the number of bytes, a colon and the value."""
    values = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values)), 256)


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with their rank (from 0) within the group by order, and the group's total.

    Equal rows may take each other's ranks. They are spread by a salt, so a third of the table may be equal.
    """
    salted = written(rows.withColumn("salt", F.monotonically_increasing_id() % 4096), "merkle-rows")
    keys = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order), F.col("salt")]
    placed = salted.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = written(placed.drop("salt").withColumn("part", F.spark_partition_id()).withColumn("at", at), "merkle-ranks")
    counts = placed.groupBy("part", group).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    # A group has a row for each range that it lies in.
    own = W.partitionBy(group)
    before = F.sum("n").over(own.orderBy("part")) - F.col("n")
    counts = counts.select("part", group, (before - F.col("first")).alias("shift"), F.sum("n").over(own).alias("total"))
    return placed.join(counts, ["part", group]).withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Block:
    """A subtree that nothing changes: its levels of digests from the leaves up."""

    def __init__(self, digests: list[str], height: int):
        self.levels = [digests]
        for _ in range(height):
            low = self.levels[-1]
            self.levels.append([_hash("".join(low[i : i + FANOUT])) for i in range(0, len(low), FANOUT)])

    def steps(self, index: int) -> list[tuple[str, str]]:
        """Digests before and after the node, level by level up to the block's root."""
        out = []
        for level in self.levels[:-1]:
            run, place = level[index - index % FANOUT :][:FANOUT], index % FANOUT
            out.append(("".join(run[:place]), "".join(run[place + 1 :])))
            index //= FANOUT
        return out


def copied(digest: str, steps) -> list[str]:
    """The nodes that a version with another leaf has of its own, from the leaf to the root."""
    nodes = [digest]
    for before, after in steps:
        nodes.append(_hash(before + nodes[-1] + after))
    return nodes


def _height(total: int) -> int:
    """Levels of a block in a tree of so many leaves; whole blocks in a larger one, also where one is short."""
    height = 0
    while height < HEIGHT and FANOUT**height < total:
        height += 1
    return height


def _block(table: pa.Table) -> tuple[list[dict], Block]:
    rows = sorted(table.to_pylist(), key=lambda r: r["rank"])
    return rows, Block([r["digest"] for r in rows], _height(rows[0]["total"]))


def _blocked(nodes: DataFrame):
    return nodes.withColumn("block", F.expr(f"rank div {BLOCK}")).groupBy("key", "block")


NODE = "key string, rank long, total long, digest string"
NODE_SCHEMA = pa.schema([("key", pa.string()), ("rank", pa.int64()), ("total", pa.int64()), ("digest", pa.string())])


def _root(table: pa.Table) -> pa.Table:
    _, block = _block(table.select(["rank", "total", "digest"]))
    first = table.slice(0, 1).to_pylist()[0]
    node = {"key": first["key"], "rank": first["rank"] // BLOCK, "total": -(-first["total"] // BLOCK), "digest": block.levels[-1][0]}
    return pa.Table.from_pylist([node], NODE_SCHEMA)


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """nodes (key, rank, total, digest), the roots of their blocks, and so on up to one root for each key."""
    out, columns = [nodes], ("key", "rank", "total", "digest")
    most = nodes.agg(F.max("total")).first()[0] or 0
    while most > 1:
        out.append(written(_blocked(out[-1].select(*columns)).applyInArrow(_root, NODE), "merkle-tier"))
        most = -(-most // BLOCK)
    return out


PATH = "key string, rank long, subroot string, before array<string>, after array<string>"
PATH_SCHEMA = pa.schema([("key", pa.string()), ("rank", pa.int64()), ("subroot", pa.string()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])
Steps = list[tuple[str, str]]


def _down(make: Callable[[dict, Steps, str | None], dict], schema: pa.Schema):
    """A cogroup body: rows of a block, and the path of the block's root, make rows with whole paths."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_pylist([], schema)
        rows, block = _block(left)
        above = right.to_pylist()[0]
        upper = list(zip(above["before"], above["after"]))
        return pa.Table.from_pylist([make(r, block.steps(i) + upper, above["subroot"]) for i, r in enumerate(rows)], schema)

    return run


def _path(row: dict, steps: Steps, subroot: str | None) -> dict:
    return {"key": row["key"], "rank": row["rank"], "subroot": subroot, "before": [a for a, _ in steps], "after": [b for _, b in steps]}


def _subroot_path(row: dict, steps: Steps, _: str | None) -> dict:
    return _path({"key": row["group"], "rank": 0}, steps, row["digest"])


def descend(nodes: DataFrame, paths: DataFrame, make, ddl: str, schema: pa.Schema) -> DataFrame:
    """Rows of nodes made with the path of each to where ``paths`` (of their block roots) end."""
    return _blocked(nodes).cogroup(paths.withColumnRenamed("rank", "block").groupBy("key", "block")).applyInArrow(_down(make, schema), ddl)


def paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """Paths of the block roots of ``levels[0]``, from those of the tree's roots (key, rank 0) down."""
    for nodes in reversed(levels[1:-1]):
        above = written(descend(nodes, above, _path, PATH, PATH_SCHEMA), "merkle-paths")
    return above


RESULT = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("copied", pa.list_(pa.string()))])
RESULT_DDL = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string, copied array<string>"


def _proved(copies: bool):
    def make(row: dict, steps: Steps, subroot: str | None) -> dict:
        changed = row["changed"]
        nodes = copied(row["digest"] if changed is None else changed, steps)
        return {
            "doc_id": row["doc_id"], "leaf": row["digest"], "subroot": subroot, "proof_sha256": _hash("".join(a + b for a, b in steps)),
            "folded_root": nodes[-1], "copied": nodes if copies and changed is not None else None,
        }

    return make


def manifest(docs: DataFrame, changed: Column | None = None, group: str = "lang", fields: tuple[str, ...] = FIELDS, copies: bool = False) -> DataFrame:
    """Leaf, subroot, root, proof and verdict of every row of docs.

    ``changed`` is the digest of the tampered row, or null where a row is not tampered with. ``folded_root``
    is the root of the version with that leaf; ``copied`` (with ``copies``) the nodes that the version does
    not share, from the leaf to the root. ``verified`` tells whether the folded root is the manifest's.
    """
    # Null sorts before any name, and is told from the empty one.
    key = F.when(F.col(group).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    changed = F.lit(None).cast("string") if changed is None else changed
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), leaf([F.col(c) for c in fields]).alias("digest"), changed.alias("changed"))
    leaves = written(ranked(rows, "key", "doc_id", "digest"), "merkle-leaves")
    groups = tiers(leaves)
    # The subroots are the leaves of one more tree.
    subroots = groups[-1].select(F.col("key").alias("group"), "digest", F.lit("").alias("key"))
    subroots = written(ranked(subroots, "key", "group"), "merkle-subroots")
    top = tiers(subroots)
    root = top[-1].select("digest").first()
    none = F.array().cast("array<string>")
    summit = top[-1].select("key", "rank", F.lit(None).cast("string").alias("subroot"), none.alias("before"), none.alias("after"))
    whole = written(descend(subroots, paths(top, summit), _subroot_path, PATH, PATH_SCHEMA), "merkle-paths")
    found = descend(leaves, paths(groups, whole), _proved(copies), RESULT_DDL, RESULT)
    found = found.withColumn("root", F.lit(root[0] if root else None).cast("string"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
