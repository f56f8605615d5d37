"""Write-ahead log: tail handling, offsets, replay, recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import COMMIT, DELETE, PUT, InvalidOp
from .prefix import running

#: Bytes of a record before its key.
HEADER = 21


def truncated_tail(log: DataFrame) -> DataFrame:
    """Rows before the first torn or corrupt one. An invalid op before that is refused, not skipped."""
    bad = log.where(F.col("status").isin("torn", "corrupt")).agg(F.min("offset")).first()[0]
    kept = log if bad is None else log.where(F.col("offset") < bad)
    if not kept.where("status = 'invalid_op'").isEmpty():
        raise InvalidOp("an operation before the torn tail is not known")
    return kept


def offsets(records: DataFrame, order: str = "seq") -> DataFrame:
    """records (seq, key_len, value_len) with the byte offset each is written at."""
    return running(records, order, F.lit(HEADER) + F.col("key_len") + F.col("value_len"), "offset")


def replayed(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(committed, aborted) data rows of a log: a row is visible once a marker of its group follows.

    A group is what stands between two markers. Rows of a group whose ts is not their marker's are orphans of
    a transaction that never committed; they and the rows after the last marker are aborted.
    """
    grouped = running(log, "offset", (F.col("op") == COMMIT).cast("long"), "grp")
    markers = grouped.where(F.col("op") == COMMIT).select("grp", F.col("ts").alias("marker_ts"))
    data = grouped.where(F.col("op").isin(PUT, DELETE)).join(markers, "grp", "left")
    good = F.coalesce(F.col("ts") == F.col("marker_ts"), F.lit(False))
    return data.where(good).drop("marker_ts"), data.where(~good).drop("marker_ts")


def next_ts(log: DataFrame, segments: DataFrame) -> DataFrame:
    """max over the log's ts and the segments' max_ts, plus 1."""
    both = log.agg(F.max("ts").alias("m")).union(segments.agg(F.max("max_ts").alias("m")))
    return both.agg((F.coalesce(F.max("m"), F.lit(0)) + 1).alias("next_ts"))


def applied_index(log: DataFrame, segments: DataFrame, base: int) -> DataFrame:
    """max of the segments' applied_index and base plus the log's markers."""
    marks = log.where(F.col("op") == COMMIT).agg((F.count("*") + base).alias("m"))
    return marks.union(segments.agg(F.max("applied_index").alias("m"))).agg(F.max("m").alias("applied_index"))
