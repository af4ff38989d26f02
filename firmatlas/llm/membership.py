"""Bitmaps of fixed size by which tasks skip rows that can't matter."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: 2**26 bits are 8 MB, whatever the number of keys. A full bitmap lets more rows through, never fewer.
BITS = 1 << 26


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """Bits of ``key mod BITS`` for every key of a long column."""
    bit = F.pmod(F.col(column), F.lit(BITS)) + 1
    parts = keys.filter(F.col(column).isNotNull()).select(bit.alias("bit")).distinct()
    parts = parts.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    rows = parts.toArrow()
    for part, bits in zip(rows.column("part").to_pylist(), rows.column("bits").to_pylist()):
        out[(part - 1) * 4096 : part * 4096] = np.frombuffer(bits, np.uint8)
    return out


def inside(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key (int64) may be one of the bitmap's."""
    low = keys.view(np.int64) % BITS
    return ((bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1).astype(bool)


def bit_table(keys: DataFrame, column: str) -> DataFrame:
    """The same bits as a table of at most BITS / 32768 rows: part and its 4,096 bytes."""
    bit = F.pmod(F.col(column), F.lit(BITS)) + 1
    parts = keys.filter(F.col(column).isNotNull()).select(bit.alias("bit"))
    return parts.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))


def with_maybe(rows: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """rows with ``maybe``: false only where the key is none of those in the table of bits, which is broadcast (8 MB at most)."""
    bit = F.pmod(F.col(column), F.lit(BITS)) + 1
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit_at div 8 + 1 as int), 1)")), 16, 10).cast("int")
    placed = rows.withColumn("part", F.bitmap_bucket_number(bit)).withColumn("bit_at", F.bitmap_bit_position(bit))
    found = placed.join(F.broadcast(bits), "part", "left")
    one = F.expr("shiftright(byte, cast(bit_at % 8 as int))").bitwiseAND(1) == 1
    return found.withColumn("byte", byte).withColumn("maybe", F.coalesce(one, F.lit(False))).drop("part", "bit_at", "bits", "byte")
