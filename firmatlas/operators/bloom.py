"""A Bloom filter of keys as a small table, for joins that most rows need not take part in.

A key belongs to one of ``parts`` blocks of 32,768 bits and sets ``HASHES`` bits of it, so the filter is a
table of at most ``parts`` rows of 4 KB, made by one aggregate, and a row is tested by one broadcast join. A key
that the filter denies is none of the keys; one that it admits nearly always is. Beyond some 2,000 keys a
block it admits more and more, and saves less; results don't depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2,048 blocks of 4 KB are 8 MB, whatever the number of keys.
PARTS = 2048
HASHES = 4
BLOCK_BITS = 32768


def _part(columns: list[Column], parts: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int")


def _position(columns: list[Column], n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(n), *columns), F.lit(BLOCK_BITS))


def bloom_filter(keys: DataFrame, columns: list[str], parts: int = PARTS) -> DataFrame:
    """part and bits of the filter of all keys."""
    key = [F.col(c) for c in columns]
    positions = F.array(*(_position(key, n) for n in range(HASHES)))
    set_bits = keys.select(_part(key, parts).alias("part"), F.explode(positions).alias("position"))
    return set_bits.groupBy("part").agg(F.bitmap_construct_agg("position").alias("bits"))


def admitted(rows: DataFrame, columns: list[str], table: DataFrame, parts: int = PARTS) -> DataFrame:
    """rows with ``admitted``: false only where the key is not among those of the filter."""
    key = [F.col(c) for c in columns]
    found = rows.withColumn("part", _part(key, parts)).join(F.broadcast(table), "part", "left")
    every = F.col("bits").isNotNull()
    for n in range(HASHES):
        at = _position(key, n)
        byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        every = every & (F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1)
    return found.withColumn("admitted", F.coalesce(every, F.lit(False))).drop("part", "bits")
