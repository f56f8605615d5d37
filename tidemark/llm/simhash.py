"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64-bit majorities of the XXH64 hashes of word shingles. Two fingerprints that differ in
at most 3 bits differ in at most 1 bit in one 32-bit half. Each half is covered by the code
"Hamming(31,26) and one free bit": its covering radius is 1, and its 2**27 codewords are the anchors.
A fingerprint is replicated to every anchor within radius + 1 of each half (17 at most a half), so both
ends of a link meet at the anchor nearest to either. Only members of one anchor are compared, and only
a spanning star of the links found there is sent on, never all pairs. Anchors with many members are cut
into blocks, and each pair of blocks is compared by its own task.

Exact copies share a fingerprint and take part once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, by_batch, components, raw_bytes, staged

MAX_BITS = 3
#: Members of an anchor that one task compares at once; beyond, the anchor is cut into blocks.
BUCKET = 4096


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the shingles' XXH64; 0 for null and for texts without words."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), seed)
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(tokens) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], seed) for s, e in zip(starts, ends[words - 1 :].tolist())]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 4096):
        part = hashes[start : start + 4096]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint16 if len(part) < 65536 else np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3) -> DataFrame:
    """(doc_id, fp): one row per document, fp as a signed long. ASCII A-Z is lower-cased."""

    def each(batch: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, words) for t in raw_bytes(batch.column("text"))], np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": pa.array(fps.view(np.int64))}

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return by_batch(narrow, "doc_id long, fp long", each)


# Flips that lead from a word of syndrome s to the codewords at distance 2: pairs i < j with i ^ j = s.
_PAIRS = np.zeros((32, 15), np.uint32)
for _s in range(1, 32):
    _PAIRS[_s] = [(1 << (i - 1)) | (1 << ((i ^ _s) - 1)) for i in range(1, 32) if i < i ^ _s]
_CHECKS = np.array([sum(1 << (p - 1) for p in range(1, 32) if p >> b & 1) for b in range(5)], np.uint32)
_FREE = np.uint32(1 << 31)


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor within covering radius + 1 of uint32 words; the nearest come first."""
    body = half & ~_FREE
    syndrome = sum(((np.bitwise_count(body & c) & 1).astype(np.int64) << b) for b, c in enumerate(_CHECKS))
    nearest = np.where(syndrome > 0, half ^ (np.uint32(1) << np.maximum(syndrome - 1, 0).astype(np.uint32)), half)
    far = np.flatnonzero(syndrome)
    row = np.arange(len(half))
    return (
        np.concatenate([row, row, np.repeat(far, 15)]),
        np.concatenate([nearest, nearest ^ _FREE, (half[far, None] ^ _PAIRS[syndrome[far]]).ravel()]),
    )


def stars(fps: np.ndarray, nodes: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links of at most `bits` bits among fps, as a star at the smallest node of each component."""
    order = np.argsort(nodes, kind="stable")
    fps, nodes = fps[order], nodes[order]
    label = np.arange(len(fps))
    while True:
        before = label.copy()
        for start in range(0, len(fps), 512):
            near = np.bitwise_count(fps[start : start + 512, None] ^ fps[None, :]) <= bits
            label[start : start + 512] = np.where(near, label[None, :], len(fps)).min(axis=1)
        label = label[label]
        if (label == before).all():
            break
    linked = label != np.arange(len(fps))
    return nodes[linked], nodes[label[linked]]


def _compare(batches: Iterator[pa.RecordBatch], schema: pa.Schema, bucket: int) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal keys of a stream sorted by key.

    Rows out: (key null, a, b) is a link of nodes a and b; a run of over `bucket` members is passed on
    as (key, a = fp, b = node) rows. A run without a member at home needs no comparison.
    """
    empty = np.zeros(0, np.int64)
    held = (empty, empty, empty, empty.astype(bool))

    def out(key, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key) if key is not None else pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], schema=schema)

    def runs(key, fp, node, home):
        """Links of complete runs."""
        starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1)) if len(key) else empty
        sizes = np.diff(starts, append=len(key))
        use = (sizes > 1) & (np.logical_or.reduceat(home, starts) if len(starts) else empty.astype(bool))
        u = fp.view(np.uint64)
        two = starts[use & (sizes == 2)]
        two = two[np.bitwise_count(u[two] ^ u[two + 1]) <= MAX_BITS]
        found = [(node[two], node[two + 1])]
        for s, n in zip(starts[use & (sizes > 2)].tolist(), sizes[use & (sizes > 2)].tolist()):
            if n > bucket:
                yield out(key[s : s + n], fp[s : s + n], node[s : s + n])
            else:
                found.append(stars(u[s : s + n], node[s : s + n]))
        a, b = (np.concatenate(x) for x in zip(*found))
        if len(a):
            yield out(None, a, b)

    passing = None
    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if passing is not None:  # the rest of a long run that is being passed on
            n = int(np.searchsorted(new[0], passing, side="right"))
            if n:
                yield out(*(x[:n] for x in new[:3]))
            new = [x[n:] for x in new]
            if not len(new[0]):
                continue
            passing = None
        held = tuple(np.concatenate(x) for x in zip(held, new))
        last = int(np.searchsorted(held[0], held[0][-1], side="left"))
        if last:
            yield from runs(*(x[:last] for x in held))
            held = tuple(x[last:] for x in held)
        if len(held[0]) > bucket:
            passing = held[0][-1]
            yield out(*held[:3])
            held = tuple(x[:0] for x in held)
    if len(held[0]):
        yield from runs(*held)


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that join all fingerprints of (fp, node) that reach each other in steps of <= 3 bits."""
    spark = nodes.sparkSession
    probe_schema = arrow_schema(spark, "key long, fp long, node long, home boolean")
    link_schema = arrow_schema(spark, "key long, a long, b long")

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, node = batch.column("fp").to_numpy(), batch.column("node").to_numpy()
            for half in (0, 1):
                word = (fp.view(np.uint64) >> np.uint64(32 * half)).astype(np.uint32)
                row, anchor = anchors(word)
                key = anchor.astype(np.int64) | (half << 32)
                home = np.arange(len(row)) < len(fp)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(node[row]), pa.array(home)], schema=probe_schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _compare(batches, link_schema, bucket)

    def compare_blocks(t: pa.Table) -> pa.Table:
        a, b = stars(t.column("fp").to_numpy().view(np.uint64), t.column("node").to_numpy())
        return pa.table({"a": a, "b": b})

    found = staged(
        nodes.mapInArrow(replicate, "key long, fp long, node long, home boolean")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(compare, "key long, a long, b long"),
        "links",
    )
    direct = found.where("key IS NULL").select("a", "b")
    large = found.where("key IS NOT NULL").select("key", F.col("a").alias("fp"), F.col("b").alias("node"))
    cut = large.groupBy("key").agg(F.ceil(F.count("*") / (bucket // 2)).cast("long").alias("n"))
    blocks = (
        large.join(cut, "key")
        .withColumn("i", F.pmod(F.xxhash64("fp"), "n"))
        .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .select("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "fp", "node")
    )
    return direct.union(blocks.groupBy("key", "lo", "hi").applyInArrow(compare_blocks, "a long, b long"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of docs; component_id is the smallest doc_id reachable.

    Null and word-less texts have fingerprint 0, which links like any other. Rows that repeat a doc_id
    keep a row each. Rows with a null doc_id take part in no link beyond their own fingerprint. Empty
    tables give no rows; other columns of docs are not read.
    """
    fps = staged(fingerprints(docs, text, doc_id, words), "simhash")
    nodes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    found = components(links(nodes.where("node IS NOT NULL")))
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")
