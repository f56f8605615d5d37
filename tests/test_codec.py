import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions import bloom, codec
from tidemark.model import BadLog


def test_checksum_and_records(spark):
    assert codec.crc32c_bytes(b"123456789") == 0xE3069283
    rows = [(i, 1 + i % 3, i * 7, os.urandom(i % 9), os.urandom(i * 3)) for i in range(40)] + [(40, 1, 2**63 - 1, b"", b"")]
    df = spark.createDataFrame(rows, "log bigint, op int, ts bigint, key binary, value binary")
    coded = df.select("log", codec.record(F.col("op"), F.col("ts"), F.col("key"), F.col("value")).alias("data"), codec.crc32c(F.lit(b"123456789")).alias("crc"))
    raw = {r.log: bytes(r.data) for r in coded.collect()}
    assert {r.crc for r in coded.collect()} == {0xE3069283}
    for i, op, ts, key, value in rows:
        body = bytes([op]) + ts.to_bytes(8, "little") + len(key).to_bytes(4, "little") + len(value).to_bytes(4, "little") + key + value
        assert raw[i] == codec.crc32c_bytes(body).to_bytes(4, "little") + body
    whole = b"".join(raw[i] for i in range(41))
    broken = bytearray(whole)
    broken[-22] ^= 1  # the last byte of the last but one record, which has a value
    bad_op = bytearray(codec.crc32c_bytes(b"\x09" + bytes(16)).to_bytes(4, "little") + b"\x09" + bytes(16))
    logs = spark.createDataFrame([(0, whole), (1, whole[:-1]), (2, bytes(broken)), (3, bytes(bad_op)), (4, b""), (5, None)], "log bigint, data binary")
    got = codec.decoded_records(logs).collect()
    assert [(r.op, r.ts, bytes(r.key), bytes(r.value)) for r in sorted((r for r in got if r.log == 0), key=lambda r: r.offset)] == [(op, ts, k, v) for _, op, ts, k, v in rows]
    last = {r.log: r.status for r in sorted(got, key=lambda r: (r.log, r.offset))}
    assert last == {0: "ok", 1: "torn", 2: "corrupt", 3: "invalid_op"}


def test_versioned_keys_round_trip_and_order(spark):
    rows = [(k, t) for k in ("a", "ab", "") for t in (0, 1, 300, 2**63 - 1)]
    df = spark.createDataFrame(rows, "key string, ts bigint").withColumn("raw", codec.versioned_key(F.col("key"), F.col("ts")))
    for r in df.select("key", "ts", "raw", codec.user_key(F.col("raw")).cast("string").alias("k"), codec.key_ts(F.col("raw")).alias("t")).collect():
        assert bytes(r.raw) == r.key.encode() + (2**64 - 1 - r.ts).to_bytes(8, "big")
        assert (r.k, r.t) == (r.key, r.ts)


@pytest.mark.parametrize("bits, low, high", [(10, 0.003, 0.02), (8, 0.0, 0.04), (16, 0.0, 0.005)])
def test_bloom(spark, bits, low, high):
    keys = spark.range(4000).select(F.concat(F.lit("key"), F.col("id").cast("string")).alias("key"))
    m, k = bloom.size(4000, bits)
    words = bloom.built(keys, m, k).cache()
    assert bloom.may_contain(keys, words, m, k).where("NOT maybe").count() == 0
    other = spark.range(4000).select(F.concat(F.lit("other"), F.col("id").cast("string")).alias("key"))
    rate = bloom.may_contain(other, words, m, k).where("maybe").count() / 4000
    assert low <= rate <= high


def test_configurations(spark):
    df = spark.createDataFrame([(0, [3, -1, 3, 7]), (1, []), (2, [2**40])], "i int, m array<bigint>").select("i", codec.configuration(F.col("m")).alias("raw"))
    raw = {r.i: bytes(r.raw) for r in df.collect()}
    pack = lambda *ids: len(ids).to_bytes(4, "little") + b"".join(i.to_bytes(8, "little", signed=True) for i in ids)
    assert raw == {0: pack(-1, 3, 7), 1: pack(), 2: pack(2**40)}
    cut = spark.createDataFrame([(0, raw[0]), (1, raw[0][:-1]), (2, raw[0][:3]), (3, b""), (4, raw[1])], "i int, raw binary")
    assert {r.i: r.m for r in cut.select("i", codec.configuration_members(F.col("raw")).alias("m")).collect()} == {0: [-1, 3, 7], 1: [-1, 3], 2: [], 3: [], 4: []}


def test_log_files():
    frame = lambda term, kind, data: term.to_bytes(8, "little") + bytes([kind]) + len(data).to_bytes(4, "little") + data
    head = codec.LOG_MAGIC.to_bytes(8, "little") + (9).to_bytes(8, "little") + (2).to_bytes(8, "little")
    whole = head + frame(3, 0, b"abc") + frame(4, 1, b"")
    assert codec.log_entries(whole) == (9, 2, [(3, 0, b"abc"), (4, 1, b"")])
    assert codec.log_entries(whole[:-1]) == (9, 2, [(3, 0, b"abc")]) and codec.log_entries(head[:20]) == (0, 0, []) and codec.log_entries(b"xy") == (0, 0, [])
    with pytest.raises(BadLog):
        codec.log_entries(b"12345678")


def test_bloom_bytes(spark):
    keys = spark.range(300).select((F.col("id") % 3).alias("filter"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    m, k = bloom.size(100, 10)
    filters = bloom.packed(keys, m, k).cache()
    assert {(r.k, r.m, r.valid) for r in bloom.loaded(filters).collect()} == {(7, 1000, True)}
    for r in filters.collect():
        words = bloom.packed_words(filters).where(F.col("filter") == r.filter).select("word", "bits")
        own = keys.where(F.col("filter") == r.filter).select("key")
        assert bloom.may_contain(own, words, m, k).where("NOT maybe").count() == 0
        # bit i is bit i mod 8 of byte i div 8
        assert sum(bin(b).count("1") for b in bytes(r.data)[1:]) == words.select(F.sum(F.expr("bit_count(bits)"))).first()[0]
    odd = spark.createDataFrame([(0, b""), (1, b"\x00a"), (2, b"\x1f"), (3, b"\x1eab")], "filter bigint, data binary")
    assert {r.filter: r.valid for r in bloom.loaded(odd).collect()} == {0: False, 1: False, 2: False, 3: True}
