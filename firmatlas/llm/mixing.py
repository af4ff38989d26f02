"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are put in a fixed pseudo-random order. The virtual finish time of a document is
the number of words its source has served up to its end, divided by the source's weight; a source may
be served up to ``passes`` times over. All copies are ordered by finish time over all sources, and the
order is cut where the total budget is used up: then every source has received its share.

Sources are weighed 1, 2, 3, 1, ... by code point of their name, null last. Targets share the budget
(``share`` of all words) by weight; a target stops at ``passes`` times its source's words, and what it
leaves goes to the others by weight. This level is found in one pass over the sources in the order in
which they fill up.

Running sums never see a source whole: documents are dealt into slices of the pseudo-random order, the
sums of slices give each slice its start, and a running sum runs within a slice. The cut is found from
sums of finish-time bins; only the bin that holds it is sorted. Both counts grow with the number of
documents, so that a slice or bin holds about ``PER_SLICE`` rows. The tables of sources, slices and
bins are sums, with one row for each.

Defined cases: null and empty texts have size 0 and take 0; null sources are one source; rows that
repeat a doc_id are rows of their own, and rows equal in doc_id, source and size are taken or left
together; an empty table gives an empty result; further columns, whatever their names, are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from firmatlas.llm.store import written

PER_SLICE = 20_000
#: Stands for a null doc_id where order keys are compared.
NO_ID = -(2**63)


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and U+0009 to U+000D; null counts 0."""
    parts = F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " ", -1)
    return F.coalesce(F.size(F.filter(parts, lambda w: w != "")), F.lit(0)).cast("long")


def levels(sources: DataFrame, share: float, passes: int) -> DataFrame:
    """Adds rank, weight, target and level to (no_name, name, words); level is the same in all rows."""
    by_name = W.orderBy("no_name", "name")
    s = sources.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", (F.col("rank") - 1) % 3 + 1)
    s = s.withColumn("cap", F.col("words") * passes).withColumn("full_at", F.col("cap") / F.col("weight"))
    everything = W.partitionBy()
    filling = W.orderBy("full_at", "rank")
    budget = F.sum("words").over(everything) * F.lit(share)
    s = s.withColumn("budget", budget)
    served = F.coalesce(F.sum("cap").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(filling.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("own_level", (F.col("budget") - served) / open_weight)
    # A source that fills up below the level it would see is full. The first other one sets the level;
    # those after it would see a lower one, because the full share of the first is more than its part.
    level = F.max(F.when(F.col("full_at") > F.col("own_level"), F.col("own_level"))).over(everything)
    s = s.withColumn("level", F.coalesce(level, F.max("full_at").over(everything)))
    target = F.when(F.col("full_at") <= F.col("level"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return s.withColumn("target", target).select("no_name", "name", F.col("words").alias("source_size"), "rank", "weight", "budget", "level", "target")


def mixed(docs: DataFrame, share: float = 1.0, passes: int = 3, seed: int = 17, size: Column | None = None) -> DataFrame:
    """Rows of docs as a struct ``row``, with size, source_size, target, copies, taken and finish.

    ``size`` is the number of words unless another column is given; ``finish`` holds the virtual
    finish times of the copies that the mix takes.
    """
    size = word_count(F.col("text")) if size is None else size
    key = F.md5(F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed))))
    rows = docs.select(
        "doc_id", F.col("source").isNull().alias("no_name"), F.coalesce("source", F.lit("")).alias("name"),
        size.alias("size"), key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
    )
    small = written(rows.drop("row"), "mix-sizes")
    sums = written(small.groupBy("no_name", "name", F.substring("key", 1, 4).alias("lot")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "mix-sums")
    total = sums.agg(F.sum("n")).first()[0] or 0
    digits = 1
    while digits < 4 and 16**digits * PER_SLICE < total:
        digits += 1
    sources = levels(sums.groupBy("no_name", "name").agg(F.sum("words").alias("words")), share, passes)
    sources = written(sources, "mix-sources")
    slices = sums.groupBy("no_name", "name", F.substring("lot", 1, digits).alias("slice")).agg(F.sum("words").alias("slice_words"))
    before = W.partitionBy("no_name", "name").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("start", F.coalesce(F.sum("slice_words").over(before), F.lit(0))).join(sources, ["no_name", "name"]).drop("slice_words")
    slices = written(slices, "mix-slices")
    level, budget = (sources.select("level", "budget").first() or (0.0, 0.0))
    within = W.partitionBy("no_name", "name", "slice").orderBy("key", "doc_id", "size")

    def placed(frame: DataFrame) -> DataFrame:
        """Finish times of a document's copies; documents without words have none."""
        frame = frame.withColumn("slice", F.substring("key", 1, digits)).withColumn("upto", F.sum("size").over(within))
        frame = frame.join(slices, ["no_name", "name", "slice"])
        finish = F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), lambda e: (e * F.col("source_size") + F.col("start") + F.col("upto")) / F.col("weight"))
        return frame.withColumn("finish", F.when(F.col("size") > 0, finish).otherwise(F.array().cast("array<double>")))

    cut = _cut(placed(small), level, budget, max(64, total // PER_SLICE))
    out = placed(rows)
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))

    def within_cut(x: Column) -> Column:
        if cut is None:
            return F.lit(False)
        last = [F.lit(v) for v in cut]
        rest = (F.col("rank") == last[1]) & ((F.col("key") < last[2]) | ((F.col("key") == last[2]) & (own_id <= last[3])))
        return (x < last[0]) | ((x == last[0]) & ((F.col("rank") < last[1]) | rest))

    taken = F.filter("finish", within_cut)
    out = out.withColumn("finish", taken).withColumn("copies", F.size("finish"))
    return out.select("row", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "finish")


def _cut(placed: DataFrame, level: float, budget: float, bins: int) -> tuple | None:
    """Order key (finish, rank, key, doc_id) of the last copy within the budget; None if there is none.

    The order is looked at up to twice the fair level; beyond it lie only copies that no share asks for.
    """
    if not level or not budget:
        return None
    copies = placed.select("size", "rank", "key", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.explode("finish").alias("x"))
    copies = copies.filter(F.col("x") <= 2 * level).withColumn("bin", F.floor(F.col("x") / F.lit(level) * bins))
    held = copies.groupBy("bin").agg(F.sum("size").alias("words"))
    upto = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    held = held.withColumn("upto", F.sum("words").over(upto))
    # The first bin that does not fit whole, or else the last.
    fits = F.col("upto") <= budget
    found = held.agg(
        F.min(F.when(~fits, F.col("bin"))).alias("open"), F.max(F.when(fits, F.col("bin"))).alias("full"), F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("used"),
    ).first()
    for at, used in ((found["open"], found["used"]), (found["full"], None)):
        if at is None:
            continue
        part = copies.filter(F.col("bin") == at)
        if used is not None:
            ranked = part.withColumn("run", F.sum("size").over(W.orderBy("x", "rank", "key", "id")))
            part = ranked.filter(F.col("run") + used <= budget)
        last = part.agg(F.max(F.struct("x", "rank", "key", "id")).alias("last")).first()["last"]
        if last is not None:
            return tuple(last)
    return None


def stream(docs: DataFrame, share: float = 1.0, passes: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself: rows of docs, repeated as often as taken, range-sorted by virtual finish time."""
    rows = mixed(docs, share, passes, seed)
    return rows.select("row", F.explode("finish").alias("finish")).sort("finish", "row.source", "row.doc_id").select("row.*")
