"""Line deduplication by winnowing over line hashes.

A passage is a run of consecutive lines (blank ones aside) that has ``min_words`` words or more. Lines
are compared by their words. From every line a window grows forward, and another backward, until it
holds ``min_words`` words. Of each window the line with the smallest hash is its fingerprint, so two
copies of a passage are guaranteed to share one. Neighbouring windows mostly choose the same line, so few
positions are fingerprints, and they are counted by position: only hashes that stand at two
positions or more go on. These positions are joined with the lines of their texts, and from each of them the
windows that chose it are extended forward and backward again: what a window holds is hashed, and a window
whose content stands earlier, in another document or above in the same one, is a later repeat. Every line
of a repeated run of ``min_words`` words lies in a forward or a backward window within the run, so
the union of the later windows is the whole of each repeated run, whichever earlier copy it shares most
with. These lines are deleted. Documents are ordered by doc_id (null last), then by a hash of their text.

No pairs of copies are made: each window content is reduced to its first position by a grouped
minimum, and later positions are joined with that one row. Texts are not shuffled unless they may lose lines.

Defined cases: null texts have no lines and stay null; blank lines are neither compared nor deleted;
lines keep their bytes; rows that repeat both doc_id and text count as one document and get the same
result; an empty table gives an empty result; further columns, whatever their names, are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from firmatlas.llm.membership import bit_table, with_maybe
from firmatlas.llm.store import scratch, written

BLANK = r"[ \t\n\x0B\f\r]+"


DOC = ["no_id", "id", "text_key"]


def _documents(docs: DataFrame) -> DataFrame:
    """One row per distinct (doc_id, text) with its lines that have words: position, hash, number of words."""
    split = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(i.alias("at"), F.filter(F.split(line, BLANK), lambda w: w != "").alias("words")))
    lines = F.transform(F.filter(split, lambda x: F.size(x["words"]) > 0), lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["words"]).alias("line_hash"), F.size(x["words"]).cast("long").alias("n_words")))
    rows = docs.select(*_key(F.col("doc_id"), F.col("text")), lines.alias("lines")).filter(F.size("lines") > 0)
    return rows.groupBy(*DOC).agg(F.first("lines").alias("lines"))


def _key(doc_id: Column, text: Column) -> list[Column]:
    return [doc_id.isNull().alias("no_id"), F.coalesce(doc_id.cast("long"), F.lit(0).cast("long")).alias("id"), F.xxhash64(text).alias("text_key")]


def _windows(rows: DataFrame, min_words: int, content: bool) -> DataFrame:
    """Forward and backward windows: document, first and last line, fingerprint (hash and position), and content keys."""
    lines = rows.select(*DOC, F.inline("lines"))
    doc = W.partitionBy(*DOC)
    upto = F.sum("n_words").over(doc.orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    lines = lines.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n_words"))
    ahead = doc.orderBy("before").rangeBetween(0, min_words - 1)
    back = doc.orderBy("upto").rangeBetween(-(min_words - 1), 0)

    def window(frame, first: Column, last: Column, words: Column) -> Column:
        parts = [first.alias("first"), last.alias("last"), words.alias("words"), F.min(F.struct("line_hash", "at")).over(frame).alias("print")]
        if content:
            hashes = F.collect_list("line_hash").over(frame)
            parts += [F.xxhash64(hashes).alias("k1"), F.xxhash64(F.lit(1), hashes).alias("k2")]
        return F.struct(*parts)

    at = F.col("at")
    grown = lines.select(
        *DOC,
        window(ahead, at, F.max("at").over(ahead), F.max("upto").over(ahead) - F.col("before")).alias("f"),
        window(back, F.min("at").over(back), at, F.col("upto") - F.min("before").over(back)).alias("b"),
    )
    both = grown.select(*DOC, F.explode(F.array("f", "b")).alias("w")).filter(F.col("w.words") >= min_words)
    both = both.select(*DOC, "w.first", "w.last", "w.words", F.col("w.print.line_hash").alias("print"), F.col("w.print.at").alias("at"), *(["w.k1", "w.k2"] if content else []))
    return both.distinct()


def fingerprints(rows: DataFrame, min_words: int) -> DataFrame:
    """Positions (document and line) of fingerprints whose hash stands at two positions or more."""
    chosen = written(_windows(rows, min_words, content=False).select(*DOC, "at", "print").distinct(), "line-prints")
    again = chosen.groupBy("print").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1").select("print")
    return chosen.join(written(again, "line-prints-again"), "print", "left_semi")


def repeated_windows(rows: DataFrame, min_words: int) -> DataFrame:
    """Windows, with content keys, around the positions of ``fingerprints``."""
    places = written(fingerprints(rows, min_words).select(*DOC, "at"), "line-places")
    near = rows.join(places.select(*DOC).distinct(), DOC, "left_semi")
    return _windows(near, min_words, content=True).join(places, [*DOC, "at"], "left_semi")


def repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """no_id, id, text_key and the sorted positions (from 0) of the deleted lines of a document."""
    rows = written(_documents(docs), "lines")
    near = written(repeated_windows(rows, min_words), "line-windows")
    place = F.struct(*DOC, "first")
    keys = ["print", "k1", "k2", "words"]
    origin = near.groupBy(*keys).agg(F.min(place).alias("origin"), F.max(place).alias("latest")).filter("origin <> latest").select(*keys, "origin")
    later = near.join(written(origin, "line-origins"), keys).filter(place != F.col("origin"))
    spans = later.select(*DOC, F.explode(F.sequence("first", "last")).alias("at")).distinct()
    return spans.groupBy(*DOC).agg(F.sort_array(F.collect_list("at")).alias("deleted"))


def deduplicated(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Rows of docs as a struct ``row``, with n_lines, deleted (line positions) and the text that is left."""
    with scratch(docs.sparkSession):
        found = written(repeats(docs, min_words), "line-repeats", keep=True)
        bits = written(bit_table(found.select(F.xxhash64(*DOC).alias("key")), "key"), "line-bits", keep=True)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_key(F.col("doc_id"), F.col("text")))
    rows = with_maybe(rows.withColumn("key", F.xxhash64(*DOC)), "key", bits)
    none = F.array().cast("array<int>")
    split = F.split("row.text", "\n", -1)
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(split)).alias("n_lines")
    # Most texts lose nothing and stay where they are.
    same = rows.filter(~F.col("maybe")).select("row", n_lines, none.alias("deleted"), F.col("row.text").alias("text"))
    less = rows.filter("maybe").join(found, DOC, "left").withColumn("gone", F.coalesce("deleted", none))
    left = F.array_join(F.filter(split, lambda line, i: ~F.array_contains("gone", i)), "\n")
    less = less.select("row", n_lines, F.col("gone").alias("deleted"), F.when(F.size("gone") > 0, left).otherwise(F.col("row.text")).alias("text"))
    return same.unionByName(less)
