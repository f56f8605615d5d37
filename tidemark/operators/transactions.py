"""Transactions: write buffers, read-your-writes, first-committer-wins, commit, prepare and apply.

txns      txn, read_snap, commit_order
writes    txn, stmt, key, op, value
actions   seq, txn, action (begin, put, delete, commit, rollback)
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import COMMIT, DELETE, PUT
from .folds import fold_sorted
from .prefix import running
from .sessions import deduplicated
from .shared import staged
from .snapshot import newest_ts, scan


def write_buffer(writes: DataFrame) -> DataFrame:
    """The last write of each (txn, key)."""
    return writes.groupBy("txn", "key").agg(F.max_by("op", "stmt").alias("op"), F.max_by("value", "stmt").alias("value"), F.max("stmt").alias("stmt"))


def read_your_writes(versions: DataFrame, buffer: DataFrame, snapshot: int) -> DataFrame:
    """What one transaction sees: its own buffer (key, op, value) over the snapshot."""
    own = buffer.select("key", F.col("op").alias("own_op"), F.col("value").alias("own_value"))
    seen = scan(versions, snapshot).select("key", "value").join(own, "key", "full")
    return seen.where(F.col("own_op").isNull() | (F.col("own_op") == PUT)).select(
        "key", F.when(F.col("own_op").isNotNull(), F.col("own_value")).otherwise(F.col("value")).alias("value"), F.col("own_op").isNotNull().alias("own")
    )


def conflicts(log: DataFrame, txns: DataFrame, writes: DataFrame) -> DataFrame:
    """Transactions that may not commit against a fixed log: a written key has a version newer than read_snap."""
    logged = writes.select("txn", "key").join(newest_ts(log), "key").distinct()
    newer = logged.join(txns, "txn").where("newest_ts > read_snap")
    return newer.groupBy("txn").agg(F.count("*").alias("n_conflicts"), F.max("newest_ts").alias("newest_ts"))


def first_committer_wins(txns: DataFrame) -> DataFrame:
    """(key, txn, committed) of one-key transactions (txn, key, ts, read_snap), decided in order of ts.

    Sequential: an aborted transaction writes no version, so it conflicts with nobody. Each key's
    transactions stream through one task; its state is the newest committed ts.
    """

    def step(state: list, row: tuple) -> Iterator[tuple]:
        key, txn, ts, read_snap = row
        won = state[0] <= read_snap
        if won:
            state[0] = ts
        yield key, txn, won

    rows = txns.select("key", "txn", "ts", "read_snap")
    return fold_sorted(rows, ["key"], ["ts", "txn"], "key long, txn long, committed boolean", lambda key: [0], step, lambda state: iter(()))


def first_committer_wins_all(txns: DataFrame, writes: DataFrame) -> DataFrame:
    """(txn, committed) of transactions (txn, ts, read_snap) that write several keys (writes: txn, key), in order of ts.

    A transaction commits iff none that committed before it wrote one of its keys at a ts beyond its read_snap.
    Decided in rounds: one that has a committed transaction in its way aborts, one that has no undecided one in
    its way commits, the others wait. The first undecided transaction never waits, so every round decides some;
    the number of rounds is that of the longest chain of transactions that wait for each other. A round takes the
    undecided, and those that won in the round before: whoever is left has older winners not in its way, so what is
    decided shrinks the rounds that follow.
    """
    rows = writes.select("txn", "key").join(txns.select("txn", "ts", "read_snap"), "txn").distinct().withColumn("won", F.lit(False))
    before = Window.partitionBy("key").orderBy("ts", "txn").rowsBetween(Window.unboundedPreceding, -1)
    of_txn, aborted = Window.partitionBy("txn"), []
    in_the_way = lambda which: F.coalesce(F.max(F.when(which, F.col("ts"))).over(before) > F.col("read_snap"), F.lit(False))
    while True:
        met = rows.withColumn("lost", in_the_way(F.col("won"))).withColumn("waits", in_the_way(~F.col("won") & ~F.col("lost"))).where("NOT won")
        fate = met.select("txn", "key", "ts", "read_snap", F.max("lost").over(of_txn).alias("lost"), F.max("waits").over(of_txn).alias("waits"))
        fate = staged(fate, "fate")
        aborted.append(fate.where("lost").select("txn"))
        rows = fate.where("NOT lost").select("txn", "key", "ts", "read_snap", (~F.col("waits")).alias("won"))
        if rows.where("NOT won").isEmpty():
            break
    lost = reduce(DataFrame.union, aborted).distinct().withColumn("lost", F.lit(True))
    return txns.select("txn").join(lost, "txn", "left").select("txn", F.col("lost").isNull().alias("committed"))


def commit(txns: DataFrame, buffer: DataFrame, log: DataFrame) -> DataFrame:
    """Log rows (ts, op, key, value) of transactions that began before any of them committed, and commit in
    commit_order against a log: each winner gets the next ts, its data rows and a marker. Transactions that
    conflict with the log or with an earlier winner, and empty ones, write nothing.
    """
    lost = conflicts(log, txns, buffer)
    standing = staged(txns.join(lost, "txn", "left_anti").join(buffer.select("txn"), "txn", "left_semi"), "standing")
    # an earlier winner's ts is beyond every snapshot of the batch
    decided = first_committer_wins_all(standing.select("txn", F.col("commit_order").alias("ts"), F.lit(-(1 << 62)).cast("long").alias("read_snap")), buffer)
    winners = staged(standing.join(decided.where("committed"), "txn", "left_semi"), "winners")
    base = log.agg(F.coalesce(F.max("ts"), F.lit(0))).first()[0]
    return _records(running(winners, "commit_order", F.lit(1), "n_before").withColumn("ts", F.col("n_before") + base + 1), buffer)


def _records(stamped: DataFrame, buffer: DataFrame) -> DataFrame:
    """Log rows of transactions with a ts: their data rows, and a marker each."""
    data = buffer.join(stamped.select("txn", "ts"), "txn").select("ts", "op", "key", "value")
    marker = stamped.select("ts", F.lit(COMMIT).alias("op"), F.lit(None).cast(dict(data.dtypes)["key"]).alias("key"), F.lit(None).cast(dict(data.dtypes)["value"]).alias("value"))
    return data.unionByName(marker)


def prepared(txns: DataFrame, buffer: DataFrame, log: DataFrame, sessions: DataFrame) -> DataFrame:
    """What a leader makes of transactions (txn, read_snap, commit_order, session, seq) before replication:
    (txn, status, ts), with status empty, duplicate, conflict or prepared.

    Asked in this order: no writes; a seq that its session (session, last_seq) has applied; a written key with a
    newer version in the log. Nothing is applied here, so prepared transactions do not conflict with each other;
    each gets the next ts in commit_order.
    """
    full = buffer.select("txn").distinct().withColumn("full", F.lit(True))
    lost = conflicts(log, txns, buffer).select("txn", F.lit(True).alias("lost"))
    joined = txns.join(full, "txn", "left").join(lost, "txn", "left").join(sessions, "session", "left")
    status = (
        F.when(F.col("full").isNull(), "empty")
        .when(F.coalesce(F.col("seq") <= F.coalesce("last_seq", F.lit(0)), F.lit(False)) & F.col("session").isNotNull(), "duplicate")
        .when(F.col("lost"), "conflict")
        .otherwise("prepared")
    )
    judged = joined.select("txn", "commit_order", status.alias("status"))
    base = log.agg(F.coalesce(F.max("ts"), F.lit(0))).first()[0]
    stamped = running(judged, "commit_order", (F.col("status") == "prepared").cast("long"), "n_before")
    return stamped.select("txn", "status", F.when(F.col("status") == "prepared", F.col("n_before") + base + 1).alias("ts"))


def entry_records(stamped: DataFrame, buffer: DataFrame, txns: DataFrame) -> DataFrame:
    """Records (txn, ts, op, key, value, session, seq) of prepared transactions; markers carry session and seq."""
    good = stamped.where("status = 'prepared'").select("txn", "ts")
    data = buffer.join(good, "txn").select("txn", "ts", "op", "key", "value")
    marker = good.join(txns.select("txn", "session", "seq"), "txn").withColumn("op", F.lit(COMMIT))
    return data.unionByName(marker, allowMissingColumns=True)


def control_marker(versions: DataFrame, idx: int) -> DataFrame:
    """The one record (idx, op, ts) of a no-op or of a membership change: a bare marker with the next ts."""
    return versions.agg((F.coalesce(F.max("ts"), F.lit(0)) + 1).alias("ts")).select(F.lit(idx).cast("long").alias("idx"), F.lit(COMMIT).alias("op"), "ts")


def lifecycles(actions: DataFrame) -> DataFrame:
    """actions with outcome: ok, finished (after the transaction's commit or rollback) or unknown (before its begin)."""
    before = Window.partitionBy("txn").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    began = F.coalesce(F.max(F.col("action") == "begin").over(before), F.lit(False))
    over = F.coalesce(F.max(F.col("action").isin("commit", "rollback") & F.col("_begun")).over(before), F.lit(False))
    begun = actions.withColumn("_begun", began | (F.col("action") == "begin"))
    return begun.withColumn("outcome", F.when(~F.col("_begun"), "unknown").when(over, "finished").otherwise("ok")).drop("_begun")


def active(actions: DataFrame, at: int) -> DataFrame:
    """(txn, begin_seq): transactions that have begun and not ended once all actions up to `at` are done."""
    done = lifecycles(actions.where(F.col("seq") <= at)).where("outcome = 'ok'")
    ends = F.max(F.col("action").isin("commit", "rollback"))
    return done.groupBy("txn").agg(F.min("seq").alias("begin_seq"), ends.alias("ended")).where("NOT ended").select("txn", "begin_seq")


def apply_entries(entries: DataFrame) -> DataFrame:
    """Verdicts (idx, applied, reason) on replicated entries (idx, session, seq, n_ops, ends_in_commit, n_ts, n_bad_ops).

    Malformed entries are refused first: they touch neither the session table nor the index. Of the others, a
    sessioned entry applies iff its seq exceeds all earlier ones of its session; a duplicate is a no-op that
    advances the index.
    """
    bad = F.when(F.col("n_ops") == 0, "empty").when(~F.col("ends_in_commit"), "no commit").when(F.col("n_ts") > 1, "two timestamps").when(F.col("n_bad_ops") > 0, "bad op")
    judged = entries.withColumn("bad", bad)
    plain = judged.where("bad IS NOT NULL OR session IS NULL").select("idx", F.coalesce("bad", F.lit("ok")).alias("reason"))
    fresh = deduplicated(judged.where("bad IS NULL AND session IS NOT NULL"))
    rows = plain.unionByName(fresh.select("idx", F.when(F.col("applied"), "ok").otherwise("duplicate").alias("reason")))
    return rows.select("idx", (F.col("reason") == "ok").alias("applied"), "reason")


def applied_through(verdicts: DataFrame) -> DataFrame:
    """(applied_index): the largest index that advanced, over the verdicts of apply_entries()."""
    return verdicts.where("reason IN ('ok', 'duplicate')").agg(F.coalesce(F.max("idx"), F.lit(0)).alias("applied_index"))


def tombstones(keys: DataFrame) -> DataFrame:
    """Deletes of keys as writes."""
    return keys.withColumn("op", F.lit(DELETE))
