"""Reads of a multi-version relation (key, ts, op, value...) as of a snapshot."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DELETE, PUT, KeyNotFound


def last_applied_ts(versions: DataFrame) -> int:
    """The newest committed ts; 0 for no versions."""
    return versions.agg(F.coalesce(F.max("ts"), F.lit(0))).first()[0]


def visible(versions: DataFrame, snapshot: int | None = None, start: Any = None, end: Any = None) -> DataFrame:
    """Versions with start <= key < end and ts <= snapshot; a bound of None is open. All predicates reach the scan."""
    if snapshot is not None:
        versions = versions.where(F.col("ts") <= snapshot)
    if start is not None:
        versions = versions.where(F.col("key") >= start)
    if end is not None:
        versions = versions.where(F.col("key") < end)
    return versions


def as_of(versions: DataFrame, snapshot: int | None = None, start: Any = None, end: Any = None) -> DataFrame:
    """The newest visible version of each key, deletes included: partial max_by, then one exchange on key."""
    rest = [c for c in versions.columns if c not in ("key", "ts")]
    return visible(versions, snapshot, start, end).groupBy("key").agg(F.max("ts").alias("ts"), *[F.max_by(c, "ts").alias(c) for c in rest])


def scan(versions: DataFrame, snapshot: int | None = None, start: Any = None, end: Any = None) -> DataFrame:
    """Live keys of [start, end) as of the snapshot. Deletes are dropped after the newest version is chosen."""
    return as_of(versions, snapshot, start, end).where(F.col("op") == PUT).drop("op")


def get(versions: DataFrame, key: Any, snapshot: int | None = None) -> DataFrame:
    """The live version of a key: one row or none."""
    return scan(versions.where(F.col("key") == key), snapshot)


def get_value(versions: DataFrame, key: Any, snapshot: int | None = None) -> Any:
    """The value of a key, or KeyNotFound."""
    row = get(versions, key, snapshot).first()
    if row is None:
        raise KeyNotFound(key)
    return row["value"]


def tristate(versions: DataFrame, snapshot: int | None = None) -> DataFrame:
    """as_of() with state: value or deleted. Keys without a visible version have no row."""
    return as_of(versions, snapshot).withColumn("state", F.when(F.col("op") == DELETE, "deleted").otherwise("value"))


def merged(*layers: DataFrame) -> DataFrame:
    """Layers from newest to oldest as one relation: of versions with equal (key, ts) the newest layer's stays."""
    return merged_rows(reduce(DataFrame.unionByName, [layer.withColumn("layer", F.lit(i)) for i, layer in enumerate(layers)]))


def merged_rows(tagged: DataFrame) -> DataFrame:
    """The same for rows that carry their layer (0 is the newest): one aggregate over one scan."""
    rest = [c for c in tagged.columns if c not in ("key", "ts", "layer")]
    return tagged.groupBy("key", "ts").agg(*[F.min_by(c, "layer").alias(c) for c in rest], F.min("layer").alias("layer"))


def snapshot_scan(versions: DataFrame, applied_index: int) -> DataFrame:
    """A full scan pinned at the newest commit, with the log index and ts it stands for."""
    pinned = last_applied_ts(versions)
    return scan(versions, pinned).withColumn("applied_index", F.lit(applied_index).cast("long")).withColumn("snapshot_ts", F.lit(pinned).cast("long"))


def newest_ts(versions: DataFrame) -> DataFrame:
    return versions.groupBy("key").agg(F.max("ts").alias("newest_ts"))


def version_count(versions: DataFrame) -> DataFrame:
    return versions.groupBy("key").agg(F.count("*").alias("n_versions"))


def seek(versions: DataFrame, target: Any) -> DataFrame:
    """The first key at or after target, with its newest version."""
    first = versions.where(F.col("key") >= target).agg(F.min("key").alias("key"))
    return as_of(versions.join(F.broadcast(first), "key"))  # one row


def build_snapshot(versions: DataFrame, snapshot: int) -> DataFrame:
    """The live rows of a snapshot, all stamped with its ts: a segment that replaces whatever it is installed over."""
    return scan(versions, snapshot).withColumn("ts", F.lit(snapshot).cast("long")).withColumn("op", F.lit(PUT))
