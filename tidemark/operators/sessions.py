"""Exactly-once application by (session, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def session_table(entries: DataFrame) -> DataFrame:
    """The highest seq of each session."""
    return entries.groupBy("session").agg(F.max("seq").alias("last_seq"))


def merged_tables(*tables: DataFrame) -> DataFrame:
    """Session tables of a checkpoint and of a log tail: the larger seq wins."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("session").agg(F.max("last_seq").alias("last_seq"))


def deduplicated(entries: DataFrame) -> DataFrame:
    """entries (idx, session, seq) with applied: seq exceeds all earlier ones of the session, and 0.

    The running maximum of all seqs is that of the applied ones, so no recursion is needed.
    """
    before = Window.partitionBy("session").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("applied", F.col("seq") > F.coalesce(F.max("seq").over(before), F.lit(0)))


def counters(entries: DataFrame) -> DataFrame:
    """A counter for each session that every applied entry increments once, whatever the retries."""
    return deduplicated(entries).groupBy("session").agg(F.sum(F.col("applied").cast("long")).alias("counter"), F.count("*").alias("n_attempts"))
