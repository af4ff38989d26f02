"""Quality rules on how well public tokenizers fit a text.

Base rules reject texts of fewer than 20 words and texts of which more than 30 % of the words lie in
8-word windows that occur twice or more. For the others three measures are taken with public
vocabularies: characters per token, the share of byte-fallback tokens, and the entropy of the tokens
relative to its maximum. Each language (of texts without one, each script) has bands for them: the
median over all its texts that pass the base rules, and a multiple of the distance of the quartile
from it on either side, but a least width (see ``BANDS``). Bands of few texts say little, so a group of
n texts counts for n / (n + ``min_texts``), and the bands of its script for the rest; these are drawn in
the same way towards the bands of all texts. A text outside a band is rejected.

A text is measured word by word: a word is encoded once, with the space before it, and kept in a cache
of ``CACHE_WORDS`` words for each tokenizer process; counts of words then give counts of tokens. The
vocabulary files lie in a folder that every executor has; its path is a parameter.

Defined cases: null and empty texts have no words and fail the base rules; texts with fewer than
``min_tokens`` tokens are judged by the base rules alone; a null language is a language by script; rows
that repeat a doc_id are judged each by its own text; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from firmatlas.llm import kernel as K
from firmatlas.llm.store import written
from firmatlas.llm.worker import kept

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECES = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"
# Fixed value: how the byte-level vocabulary expects a text to be cut before it is encoded.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 400_000
MEASURES = ("chars_per_token", "fallback_share", "entropy")

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
LINE = np.ones(256, bool)
LINE[10] = False
#: Scripts by the first byte of their characters in UTF-8, in the order in which they are counted.
SCRIPTS = {"latin": (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)), "greek": (0xCE, 0xCF), "cyrillic": range(0xD0, 0xD5), "hebrew": range(0xD6, 0xD8), "arabic": range(0xD8, 0xDC), "indic": (0xE0,), "cjk": range(0xE3, 0xEE)}
SCRIPT_NAMES = (*SCRIPTS, "other")


class Encoder:
    """Token counts of words, cached by word."""

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken

        with open(f"{folder}/{BYTE_BPE}", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECES}")
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.vocabulary = max(ranks.values()) + 1
        self.size = np.zeros(self.vocabulary, np.int64)
        self.size[list(ranks.values())] = [len(piece) for piece in ranks]
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)
        self.n_pieces = self.n_bytes = np.zeros(0, np.int32)

    def _tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Byte-BPE tokens of all words and their number by word.

        No token goes over a space, so the words are encoded at once and cut by their lengths.
        """
        ids = np.array(self.bpe.encode_ordinary(" " + " ".join(texts)), np.int32)
        ends = np.cumsum([len(t.encode()) + 1 for t in texts])
        place = np.searchsorted(got := np.cumsum(self.size[ids]), ends)
        if len(got) and got[-1] == ends[-1] and (got[place] == ends).all():
            return ids, np.diff(place, prepend=-1)
        one_by_one = [self.bpe.encode_ordinary(" " + t) for t in texts]
        return np.array([i for x in one_by_one for i in x], np.int32), np.array([len(x) for x in one_by_one])

    def words(self, words: list[bytes]) -> np.ndarray:
        """Place of each distinct word in the cache."""
        if len(self.known) + len(words) > CACHE_WORDS and self.known:
            self.clear()
        known = self.known
        fresh = [w for w in words if w not in known]
        if fresh:
            texts = [w.decode("utf-8", "replace") for w in fresh]
            ids, counts = self._tokens(texts)
            pieces = self.pieces.encode(texts, num_threads=1)
            n_pieces = np.fromiter(map(len, pieces), np.int32, len(pieces))
            owner = np.repeat(np.arange(len(pieces)), n_pieces)
            n_bytes = np.bincount(owner, weights=self.is_byte[np.fromiter(chain.from_iterable(pieces), np.int32)], minlength=len(pieces))
            known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
            self.flat = np.concatenate([self.flat, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
            self.n_pieces = np.concatenate([self.n_pieces, n_pieces])
            self.n_bytes = np.concatenate([self.n_bytes, n_bytes.astype(np.int32)])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def encoder(folder: str) -> Encoder:
    """The encoder of this process, with the words that earlier tasks have left in its cache."""
    return kept(("fertility", folder), lambda: Encoder(folder))


def _repeated(hashes: np.ndarray, row: np.ndarray, rows: int, size: int) -> np.ndarray:
    """Per row the number of words inside a window of ``size`` words that the row has twice or more."""
    counts = np.bincount(row, minlength=rows)
    limit = np.cumsum(counts)[row]
    start = np.flatnonzero(np.arange(len(row)) + size <= limit)
    key, home = K.span_hash(K.running(hashes), start, start + size), row[start]
    order = np.lexsort((key, home))
    same = (key[order][1:] == key[order][:-1]) & (home[order][1:] == home[order][:-1])
    twice = np.zeros(len(start), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(row) + 1, np.int64)
    np.add.at(edge, start[twice], 1)
    np.add.at(edge, start[twice] + size, -1)
    return np.bincount(row, weights=np.cumsum(edge[:-1]) > 0, minlength=rows).astype(np.int64)


def _lines(data, offsets, rows: int, size: np.ndarray) -> np.ndarray:
    """Per row the number of lines with a word that equal an earlier line."""
    start, end, row = K.words(data, offsets, LINE)
    hashes = K.word_hash(data, start, end)
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~K.SPACE[data], out=filled[1:])
    use = filled[end] > filled[start]
    hashes, row = hashes[use], row[use]
    order = np.lexsort((hashes, row))
    again = (hashes[order][1:] == hashes[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][1:][again], minlength=rows)


def _measure(folder: str):
    def one(batch):
        tool = encoder(folder)
        for first, stop, data, offsets in K.texts(batch.column("text")):
            rows = stop - first
            home = np.repeat(np.arange(rows), np.diff(offsets))

            def count(mask):
                return np.bincount(home[mask], minlength=rows)

            start, end, row = K.words(data, offsets, ~K.SPACE)
            hashes = K.word_hash(data, start, end)
            n_words = np.bincount(row, minlength=rows)
            chars = count(~K.SPACE[data] & ((data & 0xC0) != 0x80))
            script = np.column_stack([count(np.isin(data, list(v))) for v in SCRIPTS.values()])
            script = np.where(script.max(axis=1) > 0, script.argmax(axis=1), len(SCRIPTS))
            # Distinct words of the chunk are encoded; (row, word) counts give token counts.
            _, sample, word = np.unique(hashes, return_index=True, return_inverse=True)
            raw = data.tobytes()
            at = tool.words([raw[a:b] for a, b in zip(start[sample].tolist(), end[sample].tolist())])
            begin, n_tokens = tool.ends[at], np.diff(tool.ends)[at]
            tokens = np.bincount(row, weights=n_tokens[word], minlength=rows) if len(row) else np.zeros(rows)
            n_pieces = np.bincount(row, weights=tool.n_pieces[at][word], minlength=rows) if len(row) else np.zeros(rows)
            n_bytes = np.bincount(row, weights=tool.n_bytes[at][word], minlength=rows) if len(row) else np.zeros(rows)
            pairs, times = np.unique(row * (len(sample) + 1) + word, return_counts=True)
            pair_row, pair_word = pairs // (len(sample) + 1), pairs % (len(sample) + 1)
            size = n_tokens[pair_word]
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[pair_word], size)
            keys = np.repeat(pair_row, size) * tool.vocabulary + tool.flat[place]
            keys, inverse = np.unique(keys, return_inverse=True)
            held = np.bincount(inverse, weights=np.repeat(times, size), minlength=len(keys))
            logs = np.bincount(keys // tool.vocabulary, weights=held * np.log2(np.maximum(held, 1)), minlength=rows)
            entropy = np.where(tokens > 1, (np.log2(np.maximum(tokens, 1)) - logs / np.maximum(tokens, 1)) / np.log2(np.maximum(tokens, 2)), 1.0)
            yield [
                batch.column("doc_id").slice(first, rows), batch.column("lang").slice(first, rows), [SCRIPT_NAMES[i] for i in script],
                n_words, chars, count(SYMBOL[data]), _lines(data, offsets, rows, n_words), _repeated(hashes, row, rows, 8),
                tokens.astype(np.int64), chars / np.maximum(tokens, 1), n_bytes / np.maximum(n_pieces, 1), entropy,
            ]

    return one


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")
SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("script", pa.string()), *((c, pa.int64()) for c in COLUMNS), *((c, pa.float64()) for c in MEASURES)])


def measured(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """Counts and token measures of every row of docs, and base_failed."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text")
    ddl = "doc_id long, lang string, script string, " + ", ".join([*(f"{c} long" for c in COLUMNS), *(f"{c} double" for c in MEASURES)])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.mapInArrow(K.batches(_measure(folder), SCHEMA), ddl).withColumn("base_failed", failed)


#: Per measure: lower and upper quantile, how many times their distance from the median a band is wide, and its least width.
BANDS = {"chars_per_token": (0.25, 0.75, 5.0, 0.14), "fallback_share": (0.25, 0.75, 6.0, 0.02), "entropy": (0.25, 0.75, 6.0, 0.2)}


#: Bands of a text of n tokens are wider by this, divided by the root of n.
NOISE = 8.0


LIMITS = tuple(f"{m}_{side}" for m in BANDS for side in ("low", "high"))


def _bands(use: DataFrame, key: str, label: str) -> DataFrame:
    """Per value of key the number of texts, and the lower and upper bound of each measure."""
    found = use.groupBy(key).agg(F.count(F.lit(1)).alias("texts"), *(F.percentile_approx(m, [low, 0.5, high], 10_000).alias(m) for m, (low, high, _, _) in BANDS.items()))
    out = [F.col(key), F.col("texts").alias(f"{label}_texts")]
    for m, (_, _, times, least) in BANDS.items():
        out.append((F.col(m)[1] - F.greatest((F.col(m)[1] - F.col(m)[0]) * times, F.lit(least))).alias(f"{label}_{m}_low"))
        out.append((F.col(m)[1] + F.greatest((F.col(m)[2] - F.col(m)[1]) * times, F.lit(least))).alias(f"{label}_{m}_high"))
    return found.select(*out)


def bands(rows: DataFrame, min_tokens: int = 50, min_texts: int = 100) -> DataFrame:
    """Bounds of each measure by group and script, from all texts that pass the base rules.

    A group of ``min_texts`` texts weighs as much as its script, and a script of so many as all texts.
    """
    use = rows.filter((F.col("n_tokens") >= min_tokens) & ~F.col("base_failed")).withColumn("group", F.coalesce("lang", "script"))
    found = use.select("group", "script").distinct().join(_bands(use, "group", "own"), "group").join(_bands(use, "script", "wide"), "script")
    every = _bands(use.withColumn("every", F.lit(0)), "every", "all").first()
    found = found.withColumns({f"all_{c}": F.lit(every[f"all_{c}"] if every else None).cast("double") for c in LIMITS})

    def drawn(texts: str, own, wider):
        weight = F.col(texts) / (F.col(texts) + min_texts)
        return weight * own + (1 - weight) * wider

    return found.select("group", "script", *(drawn("own_texts", F.col(f"own_{c}"), drawn("wide_texts", F.col(f"wide_{c}"), F.col(f"all_{c}"))).alias(c) for c in LIMITS))


def judged(docs: DataFrame, folder: str = FOLDER, min_tokens: int = 50, min_texts: int = 100) -> DataFrame:
    """``measured`` with the bands of each row's group and script, and ``kept``."""
    rows = written(measured(docs, folder), "fertility")
    limits = written(bands(rows, min_tokens, min_texts), "bands")
    # Only rows that the base rules decide can be without bands.
    rows = rows.withColumn("group", F.coalesce("lang", "script")).join(limits, ["group", "script"], "left")
    # A short text gives a less exact measure, so bands are wider for it.
    spare = NOISE / F.sqrt(F.greatest("n_tokens", F.lit(1)))
    inside = F.lit(True)
    for m in MEASURES:
        more = (F.col(f"{m}_high") - F.col(f"{m}_low")) / 2 * spare
        inside = inside & F.col(m).between(F.col(f"{m}_low") - more, F.col(f"{m}_high") + more)
    fits = F.when(F.col("n_tokens") < min_tokens, True).otherwise(F.coalesce(inside, F.lit(True)))
    return rows.withColumn("kept", ~F.col("base_failed") & fits)
