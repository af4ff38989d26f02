"""Registered queries of the operators in this subpackage, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline

from firmatlas.llm import alignment, decontaminate, fertility, lines, merkle, minhash, mixing, ngram, quality, reputation, substrings, toxicity, warc
from firmatlas.llm.sql import ORACLE  # noqa: F401
from firmatlas.llm.store import table, written
from firmatlas.session import work_folder


def op1_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op2_substrings(spark, sf_dir):
    return substrings.without_repeats(table(spark, sf_dir, "documents"), length=400).drop("kept")


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return found.select("row.doc_id", *(F.col(c).alias(f"p_{c}") for c in toxicity.CATEGORIES), "rejected")


def op4_fertility(spark, sf_dir):
    found = fertility.judged(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *fertility.MEASURES)


def op5_decontaminate(spark, sf_dir):
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_lines(spark, sf_dir):
    found = lines.deduplicated(table(spark, sf_dir, "documents"), min_words=50)
    return found.select(
        F.col("row.doc_id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"),
        F.size("deleted").cast("long").alias("n_deleted"), F.array_join("deleted", ",").alias("deleted_lines"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op6_ngram(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", _fold(10) == 0)
    return ngram.scored(docs)


def op7_warc(spark, sf_dir):
    folder = work_folder(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder, min_bytes=0)
    full = warc.read_archives(spark, folder).filter("record_type = 'response'")
    full = full.mapInArrow(warc.measured, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    again = warc.read_archives(spark, folder, payload=False).filter("record_type = 'revisit'")
    return full.union(again.select(*full.columns))


def op8_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sizes = written(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "sizes")
    found = mixing.mixed(sizes, share=1.0, passes=3, size=F.col("size"))
    return found.select("row.doc_id", "size", "source_size", "target", "taken")


def _fold(n: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(0))


def op10_quality(spark, sf_dir):
    rows = quality.measured(table(spark, sf_dir, "documents"))
    model = quality.train(rows, table(spark, sf_dir, "labels").filter(_fold(3) != 1))
    found = quality.scored(rows, model)
    return found.select("doc_id", (_fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_alignment(spark, sf_dir):
    return alignment.alignments(table(spark, sf_dir, "documents"))


def op12_reputation(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    # The tables label pages by the id they share with documents.
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return reputation.judged(table(spark, sf_dir, "pages"), rules, outcomes)


def op13_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", reputation.UPPER, reputation.LOWER)
    tampered = merkle.leaf([lowered if c == "text" else F.col(c) for c in merkle.FIELDS])
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, tampered)
    found = merkle.manifest(docs, changed)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

QUERIES = {"pipeline": pipeline, "op1_minhash": op1_minhash, "op2_substrings": op2_substrings, "op3_toxicity": op3_toxicity, "op4_fertility": op4_fertility, "op5_decontaminate": op5_decontaminate, "op6_ngram": op6_ngram, "op7_warc": op7_warc, "op8_mixing": op8_mixing, "op9_lines": op9_lines, "op10_quality": op10_quality, "op11_alignment": op11_alignment, "op12_reputation": op12_reputation, "op13_merkle": op13_merkle}
