"""Byte formats as expressions: versioned keys, log records, checksums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..model import COMMIT, DELETE, NO_VOTE, PUT, BadLog

HEADER = 21
_CASTAGNOLI = 0x82F63B78


def _byte_table(polynomial: int) -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(polynomial), t >> 1)
    return t


def crc32c_bytes(data: bytes) -> int:
    table = _crc_list()
    crc = 0xFFFFFFFF
    for b in data:
        crc = table[(crc ^ b) & 0xFF] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


_crc_cache: list[int] = []


def _crc_list() -> list[int]:
    if not _crc_cache:
        _crc_cache.extend(_byte_table(_CASTAGNOLI).tolist())
    return _crc_cache


#: Bytes of a padded block of values that are hashed together.
_BLOCK = 4 << 20


def _blocks(values: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, padded bytes, lengths) of values of like lengths, in blocks of bounded size."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * int(sizes[order[stop]]) <= _BLOCK:
            stop += 1
        rows = order[at:stop]
        width = int(sizes[rows[-1]])
        raw = np.frombuffer(b"".join(values[i].ljust(width, b"\0") for i in rows.tolist()), np.uint8).reshape(len(rows), width)
        yield rows, raw, sizes[rows]
        at = stop


def crc32c_many(values: list[bytes]) -> np.ndarray:
    """CRC-32C of each value, all values of a block a byte at a time."""
    table, out = _byte_table(_CASTAGNOLI), np.zeros(len(values), np.int64)
    for rows, raw, lengths in _blocks(values):
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for k in range(raw.shape[1]):
            crc = np.where(k < lengths, table[(crc ^ raw[:, k]) & 0xFF] ^ (crc >> np.uint32(8)), crc)
        out[rows] = crc ^ np.uint32(0xFFFFFFFF)
    return out


@F.arrow_udf(LongType())
def crc32c(data: pa.Array) -> pa.Array:
    return pa.array(crc32c_many([x or b"" for x in data.to_pylist()]))


@F.arrow_udf(LongType())
def fnv1a64(data: pa.Array) -> pa.Array:
    """FNV-1a, 64 bits, as a signed long."""
    values = [x or b"" for x in data.to_pylist()]
    out = np.zeros(len(values), np.uint64)
    for rows, raw, lengths in _blocks(values):
        h = np.full(len(rows), 0xCBF29CE484222325, np.uint64)
        for k in range(raw.shape[1]):
            h = np.where(k < lengths, (h ^ raw[:, k]) * np.uint64(0x100000001B3), h)
        out[rows] = h
    return pa.array(out.view(np.int64))


def big_endian(x: Column, width: int = 8) -> Column:
    return F.unhex(F.lpad(F.hex(x.cast("long")), 2 * width, "0"))


def little_endian(x: Column, width: int) -> Column:
    """Binary reversed by its hex pairs."""
    h = F.lpad(F.hex(x.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * width - 1 - 2 * i, 2) for i in range(width)]))


def versioned_key(key: Column, ts: Column) -> Column:
    """key, then the complement of ts in 8 big-endian bytes: newer versions of one key sort first."""
    return F.concat(key.cast("binary"), big_endian(F.bitwise_not(ts.cast("long"))))


def user_key(encoded: Column) -> Column:
    return F.substring(encoded, F.lit(1), F.octet_length(encoded) - 8)


def key_ts(encoded: Column) -> Column:
    tail = F.hex(F.substring(encoded, F.octet_length(encoded) - 7, F.lit(8)))
    # two halves, as conv() of a full unsigned value would not fit a signed long
    high, low = F.conv(F.substring(tail, 1, 8), 16, 10).cast("long"), F.conv(F.substring(tail, 9, 8), 16, 10).cast("long")
    return F.bitwise_not(F.shiftleft(high, 32).bitwiseOR(low))


def record_body(op: Column, ts: Column, key: Column, value: Column) -> Column:
    """A log record without its checksum: op, ts, key and value lengths (little-endian), key, value."""
    key, value = (F.coalesce(x.cast("binary"), F.lit(b"")) for x in (key, value))
    return F.concat(little_endian(op, 1), little_endian(ts, 8), little_endian(F.octet_length(key), 4), little_endian(F.octet_length(value), 4), key, value)


def record(op: Column, ts: Column, key: Column, value: Column) -> Column:
    """A log record: CRC-32C of the body (little-endian), body."""
    body = record_body(op, ts, key, value)
    return F.concat(little_endian(crc32c(body), 4), body)


def decoded_records(logs: DataFrame, data: str = "data") -> DataFrame:
    """Rows (log, offset, op, ts, key, value, status) of whole logs (log, data binary), one log a row.

    status: ok, torn (the bytes end inside a record), corrupt (the checksum differs) or invalid_op. Reading
    stops at the first row that is not ok, as where the next record starts is not known.
    """
    schema = "log long, offset long, op int, ts long, key binary, value binary, status string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for log, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(log, *r) for r in frames(raw or b"")]
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pydict(checked(rows), schema=_RECORDS)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pydict(checked(rows), schema=_RECORDS)

    return logs.select(F.col("log").cast("long"), F.col(data).cast("binary")).mapInArrow(run, schema)


_RECORDS = pa.schema([("log", pa.int64()), ("offset", pa.int64()), ("op", pa.int32()), ("ts", pa.int64()), ("key", pa.binary()), ("value", pa.binary()), ("status", pa.string())])


def frames(raw: bytes) -> Iterator[tuple[int, bytes | None]]:
    """(offset, record) by the lengths in the headers; a last (offset, None) where the bytes end inside one."""
    at = 0
    while at < len(raw):
        head = raw[at : at + HEADER]
        end = at + HEADER + int.from_bytes(head[13:17], "little") + int.from_bytes(head[17:21], "little")
        if len(head) < HEADER or end > len(raw):
            yield at, None
            return
        yield at, raw[at:end]
        at = end


def checked(rows: list[tuple]) -> dict[str, list]:
    """Columns of framed rows (log, offset, record) of whole logs, each up to its first bad record."""
    sums = crc32c_many([r[2][4:] if r[2] else b"" for r in rows]).tolist()
    out, bad = [], None
    for (log, at, raw), crc in zip(rows, sums):
        if at == 0:
            bad = False
        if bad:
            continue
        if raw is None:
            out.append((log, at, None, None, None, None, "torn"))
            continue
        key = HEADER + int.from_bytes(raw[13:17], "little")
        status = "corrupt" if crc != int.from_bytes(raw[:4], "little") else "ok" if raw[4] in (PUT, DELETE, COMMIT) else "invalid_op"
        out.append((log, at, raw[4], int.from_bytes(raw[5:13], "little", signed=True), raw[HEADER:key], raw[key:], status))
        bad = status != "ok"
    return dict(zip(_RECORDS.names, map(list, zip(*out)))) if out else {n: [] for n in _RECORDS.names}


def from_little_endian(data: Column, at: Column | int, width: int) -> Column:
    """The integer of 1, 2, 4 or 8 little-endian bytes at an offset, as a long; 8 bytes are signed."""
    at = F.lit(at) if isinstance(at, int) else at
    pairs = F.hex(F.substring(data, at + 1, F.lit(width)))
    turned = [F.substring(pairs, 2 * i + 1, 2) for i in range(width - 1, -1, -1)]
    if width <= 4:
        return F.conv(F.concat(*turned), 16, 10).cast("long")
    # two halves, as conv() of a full unsigned value would not fit a signed long
    high, low = (F.conv(F.concat(*part), 16, 10).cast("long") for part in (turned[: width - 4], turned[width - 4 :]))
    return F.shiftleft(high, 32).bitwiseOR(low)


def configuration(members: Column) -> Column:
    """A voting configuration: count (4 bytes), then the sorted distinct ids (8 bytes each), little-endian."""
    ids = F.array_sort(F.array_distinct(members))
    each = F.array_join(F.transform(ids, lambda x: F.hex(little_endian(x, 8))), "")
    return F.concat(little_endian(F.size(ids), 4), F.unhex(each))


def configuration_members(data: Column) -> Column:
    """The ids of a configuration; what is cut off is left out, and fewer than 4 bytes are no members."""
    n = F.least(from_little_endian(data, 0, 4), F.floor((F.octet_length(data) - 4) / 8)).cast("int")
    ids = F.transform(F.sequence(F.lit(0), n - 1), lambda i: from_little_endian(data, 4 + 8 * i, 8))
    return F.when((F.octet_length(data) < 4) | (n < 1), F.array().cast("array<bigint>")).otherwise(F.array_sort(ids))


def hard_state(term: Column, voted_for: Column) -> Column:
    """A node's term and vote, 8 little-endian bytes each."""
    return F.concat(little_endian(term, 8), little_endian(voted_for, 8))


def read_hard_state(data: Column) -> Column:
    """struct(term, voted_for, present); a missing or short file is term 0 without a vote."""
    whole = F.coalesce(F.octet_length(data) >= 16, F.lit(False))
    return F.struct(
        F.when(whole, from_little_endian(data, 0, 8)).otherwise(F.lit(0)).cast("long").alias("term"),
        F.when(whole, from_little_endian(data, 8, 8)).otherwise(F.lit(NO_VOTE)).cast("long").alias("voted_for"),
        whole.alias("present"),
    )


# Fixed values of the replicated log's file: its magic number, bytes of the header and of a frame's header.
LOG_MAGIC = 0x524146544C4F4722
LOG_HEADER, FRAME_HEADER = 24, 13


def log_frame(term: Column, kind: Column, data: Column) -> Column:
    """One entry: term (8 bytes), kind (1), length (4), data."""
    return F.concat(little_endian(term, 8), little_endian(kind, 1), little_endian(F.octet_length(data), 4), data)


def log_header(base_idx: Column, base_term: Column) -> Column:
    return F.concat(little_endian(F.lit(LOG_MAGIC), 8), little_endian(base_idx, 8), little_endian(base_term, 8))


_ENTRIES = pa.schema([("log", pa.int64()), ("base_idx", pa.int64()), ("base_term", pa.int64()), ("idx", pa.int64()), ("term", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])


def log_entries(raw: bytes) -> tuple[int, int, list[tuple[int, int, bytes]]]:
    """(base_idx, base_term, entries (term, kind, data)) of a log file; a torn tail is left out."""
    if len(raw) < 8:
        return 0, 0, []  # not even the magic number: a header that was cut off
    if int.from_bytes(raw[:8], "little") != LOG_MAGIC:
        raise BadLog("a log file begins with another number")
    if len(raw) < LOG_HEADER:
        return 0, 0, []
    entries, at = [], LOG_HEADER
    while at + FRAME_HEADER <= len(raw):
        end = at + FRAME_HEADER + int.from_bytes(raw[at + 9 : at + 13], "little")
        if end > len(raw):
            break
        entries.append((int.from_bytes(raw[at : at + 8], "little"), raw[at + 8], raw[at + FRAME_HEADER : end]))
        at = end
    return int.from_bytes(raw[8:16], "little"), int.from_bytes(raw[16:24], "little"), entries


def decoded_logs(files: DataFrame, data: str = "data") -> DataFrame:
    """Rows (log, base_idx, base_term, idx, term, kind, data) of whole log files (log, data binary), one file a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for log, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base, base_term, entries = log_entries(raw or b"")
                rows = [(log, base, base_term, base + i, *e) for i, e in enumerate(entries, 1)]
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(_ENTRIES.names, map(list, zip(*rows)))), schema=_ENTRIES)

    return files.select(F.col("log").cast("long"), F.col(data).cast("binary")).mapInArrow(run, "log long, base_idx long, base_term long, idx long, term long, kind int, data binary")
