"""Flush, segment layout, compaction and version garbage collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import DELETE
from .folds import fold_sorted
from .prefix import running
from .snapshot import merged

#: Bytes of a memtable entry besides its encoded key and stored value.
ENTRY_OVERHEAD = 64
TRIGGER = 4


def watermark(active: DataFrame, versions: DataFrame) -> DataFrame:
    """min of the oldest active read_snap and the newest ts: reads below it are undefined after compaction."""
    return active.agg(F.min("read_snap").alias("m")).union(versions.agg(F.max("ts").alias("m"))).agg(F.min("m").alias("watermark"))


def collected(versions: DataFrame, low: int, bottom: bool) -> DataFrame:
    """Versions that compaction keeps under a watermark.

    Above the bottom all stay. At the bottom the newest version goes iff it is a delete at or below the
    watermark; an older one goes iff the next newer one is at or below the watermark.
    """
    if not bottom:
        return versions
    newer = F.lag("ts").over(Window.partitionBy("key").orderBy(F.desc("ts")))
    gone = F.when(F.col("_newer").isNull(), (F.col("op") == DELETE) & (F.col("ts") <= low)).otherwise(F.col("_newer") <= low)
    return versions.withColumn("_newer", newer).where(~gone).drop("_newer")


def compacted(layers: list[DataFrame], low: int, bottom: bool) -> DataFrame:
    """Layers from newest to oldest as one segment's rows."""
    return collected(merged(*layers).drop("layer"), low, bottom)


def plan(segments: DataFrame, trigger: int = TRIGGER) -> DataFrame:
    """Inputs of the next compaction: the oldest `trigger` segments once there are as many.

    (id, output_id, bottom): the output takes the newest input's id, so order by id stays order by age; it
    is the bottom iff the oldest segment is an input.
    """
    trigger = max(2, trigger)
    oldest = segments.select("id").orderBy("id").limit(trigger)
    limits = oldest.agg(F.count("*").alias("n"), F.max("id").alias("output_id"), F.min("id").alias("low"))
    least = segments.agg(F.min("id").alias("least"))
    one = limits.join(F.broadcast(least), F.lit(True)).where(F.col("n") >= trigger)  # one row each
    return oldest.join(F.broadcast(one), F.lit(True)).select("id", "output_id", (F.col("low") == F.col("least")).alias("bottom"))


def memtable_size(versions: DataFrame, key_len: Column, value_len: Column) -> DataFrame:
    """Bytes that versions take in memory: encoded key (8 more), stored value (1 more), overhead."""
    return versions.agg(F.coalesce(F.sum(key_len + 8 + value_len + 1 + ENTRY_OVERHEAD), F.lit(0)).cast("long").alias("bytes"), F.count("*").alias("n_entries"))


def segment_of(ts: Column, size: int) -> Column:
    """The flush a version belongs to, with a flush every `size` commits, from 1."""
    return (F.floor((ts - 1) / size) + 1).cast("long")


def segments(versions: DataFrame, size: int) -> DataFrame:
    """Manifest rows of flushes every `size` commits."""
    return versions.groupBy(segment_of(F.col("ts"), size).alias("id")).agg(
        F.count("*").alias("n_rows"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.min("key").alias("min_key"), F.max("key").alias("max_key")
    )


def order_violations(rows: DataFrame, position: str = "pos") -> DataFrame:
    """Rows of a segment (pos, key, ts) whose predecessor does not sort before them by key, then ts descending."""
    tagged = rows.select(F.col(position).alias("pos"), "key", "ts")
    after = tagged.select((F.col("pos") - 1).alias("pos"), F.col("key").alias("next_key"), F.col("ts").alias("next_ts"))
    pairs = tagged.join(after, "pos")
    wrong = F.when((F.col("key") == F.col("next_key")) & (F.col("ts") == F.col("next_ts")), "duplicate").when(
        (F.col("key") > F.col("next_key")) | ((F.col("key") == F.col("next_key")) & (F.col("ts") < F.col("next_ts"))), "out of order"
    )
    return pairs.withColumn("problem", wrong).where("problem IS NOT NULL").select((F.col("pos") + 1).alias("pos"), "problem")


def block_index(rows: DataFrame, record: int, block: int = 4096, position: str = "pos") -> DataFrame:
    """Sparse index of fixed-size records: a block is closed once it holds `block` bytes or more."""
    each = -(-block // record)
    cut = rows.withColumn("block", F.floor(F.col(position) / each).cast("long"))
    return cut.groupBy("block").agg(
        F.count("*").alias("n_records"), (F.min(position) * record).alias("offset"), (F.count("*") * record).alias("size"), F.min_by("key", position).alias("first_key")
    )


def sparse_index(rows: DataFrame, block: int = 4096) -> DataFrame:
    """Sparse index (segment, block, n_records, offset, size, first_key) of records of any length (segment, pos,
    key bigint, length): a block is closed once it holds `block` bytes or more. A segment streams through one task."""

    def step(s: dict, row: tuple):
        segment, _, key, length = row
        if s["size"] >= block:
            yield from close(s)
            s.update(block=s["block"] + 1, n=0, offset=s["offset"] + s["size"], size=0)
        if not s["n"]:
            s["first"], s["segment"] = key, segment
        s["n"] += 1
        s["size"] += length

    def close(s: dict):
        yield s["segment"], s["block"], s["n"], s["offset"], s["size"], s["first"]

    start = lambda key: {"block": 0, "n": 0, "offset": 0, "size": 0}
    rows = rows.select("segment", "pos", "key", "length")
    return fold_sorted(rows, ["segment"], ["pos"], "segment long, block long, n_records long, offset long, size long, first_key long", start, step, close)


def positions(versions: DataFrame, block: int = 1 << 16) -> DataFrame:
    """versions with pos: the place of each in segment order (key, ts descending), counted from 0.

    Per-key counts are accumulated over blocks of bigint keys, then versions are numbered within keys.
    """
    counts = versions.groupBy("key").agg(F.count("*").alias("n"))
    base = running(counts, "key", F.col("n"), "before", block=block)
    within = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts")))
    return versions.join(base.select("key", "before"), "key").withColumn("pos", (F.col("before") + within - 1).cast("long")).drop("before")
