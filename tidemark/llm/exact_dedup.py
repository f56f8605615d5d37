"""Exact deduplication by exchange of Golomb-coded fingerprints.

1. Every row gets a 64-bit fingerprint and the SHA-256 of its normalised text. Rows are dealt to blocks of at
   most BLOCK_ROWS rows: a few neighbouring input partitions, or a part of one.
2. A block sends each owner (a range of the fingerprint space) its sorted distinct fingerprints as
   Golomb-Rice codes of their gaps. A text that fills a third of the corpus is sent once a block.
3. An owner answers each block with a bitmap of the fingerprints that occur more than once: the suspects.
4. A filter of the suspects (common.Membership: bounded) goes back to where the texts are scanned. Only texts
   that pass it are shuffled, and grouped by their bytes with map-side combining. A text that passes by chance
   is alone in its group, so the filter's size decides the cost only.

Blocks and owners hold about 4 million fingerprints each, so 5e10 rows exchange 1.4e8 messages of 350 codes.

Whitespace runs ([\\x20\\x09-\\x0D]+) count as one space, null as the empty text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Membership, arrow_schema, fresh, staged

#: Rows of a block and of an owner: some 200 MB of a task's memory.
BLOCK_ROWS = 1 << 22
CODED = "block long, owner long, n long, k int, quotients binary, remainders binary, repeated binary"
VERDICT = "block long, owner long, n long, bitmap binary"


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def rice_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Golomb-Rice code of sorted distinct uint64 values: (k, unary quotients, k-bit remainders)."""
    if not len(values):
        return 0, b"", b""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = int(values[-1]) / len(values)
    k = min(63, max(0, int(math.log2(mean)) if mean >= 1 else 0))
    q = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(q.sum()) + len(q), np.uint8)
    unary[np.cumsum(q + 1) - 1] = 1
    rest = (gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, :]) & np.uint64(1)
    return k, np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8)).tobytes()


def rice_decode(n: int, k: int, quotients: bytes, remainders: bytes) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(quotients, np.uint8)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(remainders, np.uint8), count=n * k).reshape(n, k)
        gaps |= bits.astype(np.uint64) @ (np.uint64(1) << np.arange(k, dtype=np.uint64))
    return np.cumsum(gaps, dtype=np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, sha, place), staged so that every later step sees the same places."""
    norm = normalised(text)
    return staged(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.xxhash64(norm).alias("fp"),
            F.unhex(F.sha2(norm, 256)).alias("sha"),
            F.monotonically_increasing_id().alias("place"),
        ),
        "fingerprints",
    )


def blocks(fps: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """(fp, block) of (fp, place), and the number of rows. A block is a run of places in each of a few partitions."""
    partition = F.shiftright("place", 33)
    n, parts = fps.agg(F.count("*"), F.coalesce(F.max(partition) + 1, F.lit(1))).first()
    together = 1 << max(0, math.floor(math.log2(max(1, block_rows * parts / max(1, n)))))
    together = min(together, block_rows)
    run = block_rows // together  # places of one partition in a block
    at = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    block = F.floor(partition / together).cast("long") * (1 << 33) + F.floor(at / run).cast("long")
    return fps.select("fp", block.alias("block")), n


def suspects(fps: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The fingerprints (fp) that occur more than once in (fp, place), each once a block that has it."""
    small, n = blocks(fps, block_rows)
    bits = max(0, math.ceil(math.log2(max(1, n) / block_rows)))
    shift = np.uint64(64 - bits)
    coded_schema, verdict_schema = (arrow_schema(fps.sparkSession, s) for s in (CODED, VERDICT))
    suspect_schema = arrow_schema(fps.sparkSession, "fp long")

    def hashes(t: pa.Table) -> np.ndarray:
        return t.column("fp").to_numpy().astype(np.int64).view(np.uint64)

    def encode(t: pa.Table) -> pa.Table:
        values, counts = np.unique(hashes(t), return_counts=True)
        owners = (values >> shift).astype(np.int64) if bits else np.zeros(len(values), np.int64)
        block, rows = t.column("block")[0].as_py(), []
        for owner in np.unique(owners):
            mine = owners == owner
            base = np.uint64(int(owner) << int(shift)) if bits else np.uint64(0)
            k, q, r = rice_encode(values[mine] - base)
            rows.append((block, int(owner), int(mine.sum()), k, q, r, np.packbits(counts[mine] > 1).tobytes()))
        return pa.table(dict(zip(coded_schema.names, zip(*rows))), schema=coded_schema)

    def answer(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        lists = [rice_decode(r["n"], r["k"], r["quotients"], r["remainders"]) for r in rows]
        values, counts = np.unique(np.concatenate(lists), return_counts=True)
        twice = counts > 1
        for r, own in zip(rows, lists):
            twice[np.searchsorted(values, own)] |= np.unpackbits(np.frombuffer(r["repeated"], np.uint8), count=r["n"]).astype(bool)
        out = [(r["block"], r["owner"], r["n"], np.packbits(twice[np.searchsorted(values, own)]).tobytes()) for r, own in zip(rows, lists)]
        return pa.table(dict(zip(verdict_schema.names, zip(*out))), schema=verdict_schema)

    def flagged(own: pa.Table, verdicts: pa.Table) -> pa.Table:
        values = np.unique(hashes(own))
        rows = sorted(verdicts.to_pylist(), key=lambda r: r["owner"])
        marks = np.concatenate([np.unpackbits(np.frombuffer(r["bitmap"], np.uint8), count=r["n"]) for r in rows])
        return pa.table({"fp": values[marks.astype(bool)].view(np.int64)}, schema=suspect_schema)

    coded = small.groupBy("block").applyInArrow(encode, CODED)
    verdicts = coded.groupBy("owner").applyInArrow(answer, VERDICT)
    return small.groupBy("block").cogroup(verdicts.groupBy("block")).applyInArrow(flagged, "fp long")


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Ties: keep_id is the smallest doc_id of the equal texts. Rows that repeat both doc_id and text
    all count in group_size and share keep_id, so all rows of the smallest doc_id are kept. A null
    doc_id never becomes keep_id unless all of its group are null. An empty table gives no rows.
    Other columns of docs are not read.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    fps = fingerprints(docs, "text", "doc_id")
    suspect = Membership(staged(suspects(fps, block_rows).distinct(), "suspects"))
    same = (
        docs.select("doc_id", normalised("text").alias("norm"))
        .where(suspect(F.xxhash64("norm")))
        .groupBy("norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    )
    alone = fps.where(~suspect(F.col("fp"))).select("doc_id", "sha", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
    rows = alone.unionByName(fps.where(suspect(F.col("fp"))).select("doc_id", "sha").join(same, "sha", "left"))
    return rows.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one of each set of equal texts: the rows that exact_duplicates() keeps, all columns.

    Rows that repeat both doc_id and text all stay, as they share an identity. Only rows that a filter of those
    that go lets pass are shuffled, for an exact anti-join by id and SHA-256; the others are kept as they are read.
    """
    gone_id, gone_sha = fresh(docs, "gone_id", "gone_sha")
    gone = exact_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias(gone_id), F.unhex("text_sha256").alias(gone_sha))
    gone = staged(gone.distinct(), "gone")
    sha, own_id = F.unhex(F.sha2(normalised("text"), 256)), F.col("doc_id").cast("long")
    may_go = Membership(gone.select(F.xxhash64(gone_id, gone_sha).alias("key")))(F.xxhash64(own_id, sha))
    left = docs.where(may_go).join(gone, own_id.eqNullSafe(F.col(gone_id)) & (sha == F.col(gone_sha)), "left_anti")
    return docs.where(~may_go).union(left)
