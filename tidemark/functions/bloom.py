"""Bloom filters over user keys."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codec import fnv1a64


def parameters(n: Column, bits: Column) -> tuple[Column, Column]:
    """(bits of the filter, number of hashes) for n keys at so many bits a key.

    n is at least 1, bits a key are held to 1..64, the filter is whole bytes, hashes are 1..30.
    """
    b = F.least(F.greatest(bits, F.lit(1)), F.lit(64)).cast("long")
    m = F.ceil(F.greatest(n, F.lit(1)).cast("long") * b / 8).cast("long") * 8
    k = F.least(F.greatest(F.round(b * F.lit(math.log(2))).cast("int"), F.lit(1)), F.lit(30))
    return m, k


def size(n: int, bits: int) -> tuple[int, int]:
    """parameters() of plain numbers."""
    b = min(max(bits, 1), 64)
    return -(-max(n, 1) * b // 8) * 8, min(max(math.floor(b * math.log(2) + 0.5), 1), 30)


def places(key: Column, m: int, k: int) -> Column:
    """The k bits of a key: FNV-1a halves h1, h2 give (h1 + i * h2) mod m."""
    h = fnv1a64(key.cast("binary"))
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    return F.array(*[F.pmod(low + F.lit(i) * high, F.lit(m)) for i in range(k)])


def built(keys: DataFrame, m: int, k: int) -> DataFrame:
    """The filter as a set of 64-bit words (word, bits): it grows with the keys and is never in one place."""
    bit = keys.select(F.explode(places(F.col("key"), m, k)).alias("bit")).distinct()
    word = F.floor(F.col("bit") / 64).cast("long")
    # distinct bits of a word add up to their union
    return bit.groupBy(word.alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("bits"))


def may_contain(probes: DataFrame, words: DataFrame, m: int, k: int) -> DataFrame:
    """probes (key) with maybe: whether all k bits are set. No key that was added gets false."""
    asked = probes.withColumn("bit", F.explode(places(F.col("key"), m, k))).withColumn("word", F.floor(F.col("bit") / 64).cast("long"))
    found = asked.join(words, "word", "left")
    is_set = F.coalesce(F.expr("shiftrightunsigned(bits, cast(bit % 64 AS int))"), F.lit(0)).bitwiseAND(F.lit(1)) == 1
    return found.groupBy(*probes.columns).agg(F.min(is_set).alias("maybe"))


def false_positive_rate(n: int, m: int, k: int) -> float:
    return (1 - math.exp(-k * n / m)) ** k




def packed(keys: DataFrame, m: int, k: int) -> DataFrame:
    """(filter, data) of keys (filter, key): a filter's bytes are k, then its bits; bit i is bit i mod 8 of byte i div 8.

    A filter's words meet in one task, as its bytes are one value: m / 8 of them, whatever the number of keys.
    """
    bit = keys.select("filter", F.explode(places(F.col("key"), m, k)).alias("bit")).distinct()
    words = bit.groupBy("filter", F.floor(F.col("bit") / 64).cast("long").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("bits"))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        table = np.zeros(-(-m // 64), "<u8")
        table[t.column("word").to_numpy()] = t.column("bits").to_numpy().view(np.uint64)
        return pa.table({"filter": pa.array([key[0].as_py()], pa.int64()), "data": [bytes([k]) + table.tobytes()[: m // 8]]})

    return words.groupBy("filter").applyInArrow(pack, "filter long, data binary")


def loaded(filters: DataFrame) -> DataFrame:
    """(filter, k, m, valid) of filters (filter, data): valid if there is a k from 1 to 30."""
    k = F.when(F.octet_length("data") >= 1, F.conv(F.hex(F.substring("data", 1, 1)), 16, 10).cast("int"))
    return filters.select("filter", k.alias("k"), (F.greatest(F.octet_length("data") - 1, F.lit(0)) * 8).cast("long").alias("m"), F.coalesce(k.between(1, 30), F.lit(False)).alias("valid"))


def packed_words(filters: DataFrame) -> DataFrame:
    """(filter, word, bits) of filters (filter, data), as built() makes them; empty words are left out."""

    def run(batches):
        for batch in batches:
            for f, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = (raw or b"\0")[1:]
                words = np.frombuffer(body + b"\0" * (-len(body) % 8), "<u8")
                at = np.flatnonzero(words)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), f, np.int64)), pa.array(at), pa.array(words[at].view(np.int64))], names=["filter", "word", "bits"])

    return filters.select(F.col("filter").cast("long"), "data").mapInArrow(run, "filter long, word long, bits long")
