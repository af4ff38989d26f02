"""Near-duplicate documents by HyperMinHash.

Every document's set of distinct word shingles is sketched into ``BUCKETS`` registers: the leading
bits of a shingle hash choose the bucket, and of the smallest remainder in a bucket the register
keeps the count of leading zeros and ``MANTISSA`` bits after the leading one. An empty bucket takes
the register of another bucket in a fixed pseudo-random order. Registers are banded; documents that
share a band are candidates. The share of equal registers, corrected for registers that agree by
chance, estimates the Jaccard similarity; what the estimate leaves is verified on the full sets.

Groups of copies. Documents with equal sets become one class, represented by the smallest doc_id, by
a grouped minimum. Within a band, classes are not paired with each other: they are compared with a
leader, the class that shares most bands (``LEADER_ROUNDS`` times, with another leader each); then only classes that are still in different
components are compared. So a group of
n copies takes about n comparisons, and a link is left out only where both ends are in one component
already, which a link can't change. That last comparison finds its pairs by the rarest shingles that
two linked sets must share (prefix and position filters), so it is exact among the sets it sees.

Defined cases: a null or empty text, or one without words, has no shingles and is linked with
nothing; with fewer words than ``size`` the whole sequence is one shingle; rows that repeat a doc_id
are kept as rows and share one component, with the links of each of their texts; a row without doc_id has component_id null and is kept; an empty table gives an
empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from firmatlas.llm import kernel as K
from firmatlas.llm.components import components
from firmatlas.llm.membership import bitmap, inside
from firmatlas.llm.store import scratch, written

BUCKETS, MANTISSA, ROWS = 128, 10, 4
BUCKET_BITS = BUCKETS.bit_length() - 1
#: Below so many shingles an estimate is too coarse to reject a pair; it is verified at once.
SMALL_SET = 64
#: Standard errors of the estimate that are allowed before a pair is rejected without verification.
SLACK = 5.0
LEADER_ROUNDS = 1


def shingles(data, offsets, rows: int, size: int, lower: bool = True):
    """Distinct shingle hashes of a chunk, sorted by row and hash, and their rows."""
    data = K.LOWER[data] if lower else data
    start, end, row = K.words(data, offsets, ~K.SPACE)
    hashes, row, _ = K.windows(K.word_hash(data, start, end), row, size, rows)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], row[new]


def _borrowed() -> np.ndarray:
    """For every bucket the order in which it looks for a filled bucket."""
    grid = np.arange(BUCKETS * BUCKETS, dtype=np.uint64).reshape(BUCKETS, BUCKETS)
    return np.argsort(K.mix(grid + np.uint64(77)), axis=1)


def sketch(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Registers (rows x BUCKETS, uint16) of sets given as sorted distinct hashes by row."""
    registers = np.full((rows, BUCKETS), 0xFFFF, np.uint16)
    if not len(hashes):
        return registers
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    lowest = np.ones(len(hashes), bool)
    lowest[1:] = (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])
    rest = ((hashes[lowest] << np.uint64(BUCKET_BITS)) >> np.uint64(11)).astype(np.int64)  # 53 bits
    exponent = np.frexp(rest.astype(np.float64))[1]
    zeros = np.minimum(53 - exponent, 62)
    mantissa = ((rest << (zeros + 11)) >> (63 - MANTISSA)) & ((1 << MANTISSA) - 1)
    registers[row[lowest], bucket[lowest]] = (zeros << MANTISSA | mantissa).astype(np.uint16)
    some = np.unique(row)
    part, order = registers[some], _borrowed()
    missing = part == 0xFFFF
    filled = part.copy()
    for step in range(BUCKETS):
        if not missing.any():
            break
        filled = np.where(missing, part[:, order[:, step]], filled)
        missing = filled == 0xFFFF
    registers[some] = filled
    return registers


def _sketches(size: int):
    def one(batch):
        for first, stop, data, offsets in K.texts(batch.column("text")):
            rows = stop - first
            hashes, row = shingles(data, offsets, rows, size)
            counts = np.bincount(row, minlength=rows)
            registers = sketch(hashes, row, rows)
            bands = registers.astype(np.uint64).reshape(rows, BUCKETS // ROWS, ROWS)
            bands = K.mix(sum(bands[:, :, i] << np.uint64(16 * i) for i in range(ROWS)) ^ K.mix(np.arange(BUCKETS // ROWS, dtype=np.uint64)))
            digest = [np.zeros(rows, np.uint64) for _ in range(2)]
            for salt, out in enumerate(digest):
                sums = np.zeros(len(hashes) + 1, np.uint64)
                np.cumsum(K.mix(hashes + np.uint64(salt * 2 + 1)), out=sums[1:])
                ends = np.cumsum(counts)
                out[:] = sums[ends] - sums[ends - counts]
            some = np.where(counts > 0, BUCKETS // ROWS, 0)
            yield [
                batch.column("doc_id").slice(first, rows),
                counts.astype(np.int64),
                digest[0].view(np.int64),
                digest[1].view(np.int64),
                pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * BUCKETS), rows, [None, pa.py_buffer(registers.tobytes())]).cast(pa.binary()),
                K.lists(bands[counts > 0].ravel().view(np.int64), some),
            ]

    return K.batches(one, pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("registers", pa.binary()), ("bands", pa.list_(pa.int64()))]))


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of disjoint sets of n and m items agree."""
    level = 2.0 ** -np.arange(0, 46)
    a, b = np.maximum(n, 1)[:, None] / BUCKETS, np.maximum(m, 1)[:, None] / BUCKETS
    pa_ = np.exp(-a * level[1:]) - np.exp(-a * level[:-1])
    pb_ = np.exp(-b * level[1:]) - np.exp(-b * level[:-1])
    return (pa_ * pb_).sum(axis=1) / (1 << MANTISSA)


def estimate(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs of register rows, less the agreement by chance."""
    c = chance(n, m)
    return np.clip(((left == right).mean(axis=1) - c) / (1 - c), 0, 1)


def _estimates(threshold: float):
    bound = threshold - SLACK * np.sqrt(threshold * (1 - threshold) / BUCKETS)

    def registers(column):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BUCKETS)

    def one(batch):
        for at in range(0, len(batch), 2048):
            part = batch.slice(at, 2048)
            n, m = part.column("n_a").to_numpy(), part.column("n_b").to_numpy()
            sure = estimate(registers(part.column("r_a")), registers(part.column("r_b")), n, m)
            keep = pa.array((sure >= bound) | (np.minimum(n, m) < SMALL_SET))
            yield [part.column("a").filter(keep), part.column("b").filter(keep)]

    return K.batches(one, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _sets(size: int, shared):
    def one(batch):
        batch = batch.filter(pa.array(inside(shared.value, pc.fill_null(batch.column("doc_id"), -1).to_numpy())))
        for first, stop, data, offsets in K.texts(batch.column("text")):
            hashes, row = shingles(data, offsets, stop - first, size)
            yield [batch.column("doc_id").slice(first, stop - first), K.lists(hashes.view(np.int64), np.bincount(row, minlength=stop - first))]

    return K.batches(one, pa.schema([("doc_id", pa.int64()), ("items", pa.list_(pa.int64()))]))


class _Verifier:
    """Candidate pairs (a, b) of class representatives to true links."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, percent: int):
        self.docs, self.classes, self.size, self.percent = docs, classes, size, percent

    def sets(self, ids: DataFrame) -> DataFrame:
        """(doc_id, items) of the ids. Texts are not shuffled: tasks drop most others by a bitmap."""
        shared = self.docs.sparkSession.sparkContext.broadcast(bitmap(ids, "doc_id"))
        found = self.docs.mapInArrow(_sets(self.size, shared), "doc_id long, items array<long>")
        return written(found.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "items"]), "sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        sides = [self.classes.select(*(F.col(c).alias(d) for c, d in (("doc_id", x), ("n", f"n_{x}"), ("registers", f"r_{x}")))) for x in "ab"]
        both = pairs.join(sides[0], "a").join(sides[1], "b")
        both = both.filter(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
        likely = written(both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(_estimates(self.percent / 100), "a long, b long"), "candidates")
        sets = self.sets(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        shared = likely.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
        shared = shared.select("a", "b", (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("both"))
        return shared.filter(100 * F.col("both") >= self.percent * (F.col("total") - F.col("both"))).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id and n_members for every row of docs.

    Links are pairs with 100 * intersection >= percent * union of their shingle sets.
    ``class_id`` is the smallest doc_id with the same set.
    """
    with scratch(docs.sparkSession):
        members, groups = _grouped(docs, size, percent)
    out = members.join(groups, members.class_id == groups.node, "left")
    component = F.coalesce("component", "class_id", "doc_id")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_members", F.lit(1)).alias("n_members"),
    )


def _grouped(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Kept tables: (doc_id, n, class_id, n_members) of every row, and (node, component) of linked classes."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sketched = written(docs.mapInArrow(_sketches(size), "doc_id long, n long, d1 long, d2 long, registers binary, bands array<long>"), "sketches")
    keys = ["n", "d1", "d2"]
    owners = sketched.filter("n > 0 and doc_id is not null").groupBy(*keys).agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_members"))
    # Written, so that the join below has an exchange on both sides and a hot class can be split.
    owners = written(owners, "owners")
    members = written(sketched.select("doc_id", *keys).join(owners, keys, "left").select("doc_id", "n", "class_id", "n_members"), "members", keep=True)
    heads = owners.select(*keys, F.col("class_id").alias("doc_id"))
    classes = written(sketched.join(heads, [*keys, "doc_id"], "left_semi").dropDuplicates([*keys, "doc_id"]), "classes")
    entries = classes.select(F.col("doc_id").alias("node"), F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1")
    entries = written(entries.join(written(shared, "shared-bands"), "band"), "bands")
    weights = written(entries.groupBy("node").agg(F.sum("uses").alias("weight")), "weights")
    verifier = _Verifier(docs.filter("doc_id is not null"), classes.select("doc_id", "n", "registers"), size, percent)
    links = None
    labels = entries.select("node", F.col("node").alias("comp")).distinct()
    for turn in range(LEADER_ROUNDS):
        own = entries.select("band", "node").join(labels.join(weights, "node"), "node")
        # The set that shares most bands is nearest to what its group has in common. Later rounds vary the choice.
        rank = F.col("weight") * (1 - 0.1 * turn * F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(1024)) / 1024)
        lead = own.groupBy("band").agg(
            F.max(F.struct(rank.alias("rank"), F.col("node").alias("leader"), F.col("comp").alias("lead_comp"))).alias("top"),
            F.min("comp").alias("lo"), F.max("comp").alias("hi"),
        ).filter("lo < hi").select("band", "top.leader", "top.lead_comp")
        pairs = own.join(written(lead, "leaders"), "band").filter("comp <> lead_comp")
        found = verifier.links(pairs.select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct())
        links = written(found if links is None else links.union(found), "edges")
        groups = components(links)
        nodes = entries.select("node").distinct()
        labels = written(nodes.join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("comp")), "labels")
    rest = _open_pairs(entries.select("band", "node").join(labels, "node"), verifier)
    links = written(links.union(verifier.links(rest)), "edges")
    return members, written(components(links), "groups", keep=True)


def _open_pairs(own: DataFrame, verifier: _Verifier) -> DataFrame:
    """Pairs that may be links, among sets (band, node, comp) whose bands hold several components.

    Shingles are ordered from rare to frequent among these sets. Two sets that link share at least
    ``need`` shingles, so their first common one leaves that many in both from its place on; it lies
    among the first few of either. Sets are joined on these few shingles and tested on their places.
    What a large group has in common is frequent and comes late, so sets that only share that with the
    group are left out one by one, before the join.
    """
    percent = verifier.percent

    def need(n, m):
        return F.ceil(percent * (n + m) / F.lit(100 + percent))

    spread = own.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("band")
    nodes = written(own.join(written(spread, "open-bands"), "band", "left_semi").select("node", "comp").distinct(), "open")
    sets = verifier.sets(nodes.select(F.col("node").alias("doc_id")))
    items = sets.select(F.col("doc_id").alias("node"), F.size("items").alias("n"), F.explode("items").alias("item"))
    uses = written(items.groupBy("item").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1"), "item-uses")
    # A shingle of one set comes first in its order but joins with nothing.
    shared = items.join(uses, "item")
    order = W.partitionBy("node", "n").orderBy("uses", "item")
    placed = shared.withColumn("at", F.row_number().over(order)).withColumn("common", F.count(F.lit(1)).over(W.partitionBy("node", "n")))
    placed = placed.withColumn("left", F.col("common") - F.col("at") + 1).filter(F.col("left") >= F.ceil(percent * F.col("n") / F.lit(100)))
    placed = written(placed.join(nodes, "node").select("node", "comp", "n", "item", "left"), "open-items")
    for _ in range(2):
        group = placed.groupBy("item").agg(F.min("n").alias("least_n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
        placed = placed.join(written(group.select("item", "least_n"), "open-groups"), "item")
        smallest = F.greatest("least_n", F.ceil(percent * F.col("n") / F.lit(100)))
        placed = written(placed.filter(F.col("left") >= need(F.col("n"), smallest)).drop("least_n"), "open-items")
    left = placed.select("item", *(F.col(c).alias(f"{c}_a") for c in ("node", "comp", "n", "left")))
    right = placed.select(F.col("item").alias("item_b"), *(F.col(c).alias(f"{c}_b") for c in ("node", "comp", "n", "left")))
    fits = (F.col("node_a") > F.col("node_b")) & (F.col("comp_a") != F.col("comp_b")) & (F.least("left_a", "left_b") >= need(F.col("n_a"), F.col("n_b")))
    pairs = left.join(right, (F.col("item") == F.col("item_b")) & fits)
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
