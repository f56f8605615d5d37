"""The registered queries and their DuckDB equivalents.

Parameters follow from the data, so that every scale has results: snapshot S = max(ts) div 2, watermark
W = max(ts) - 100, key range [max(key) div 6, max(key) div 2), a flush every 2,500 commits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bloom, codec
from .model import COMMIT, PUT
from .operators import checker, compaction, log, replication, sessions, snapshot, transactions
from .operators.prefix import running
from .operators.shared import shared_dir, staged
from .plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

FLUSH = 2500


def query(sql: str | None = None, *ctes: str) -> Callable:
    """Register a function as a query, with the SQL that follows the given common table expressions."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql.strip()
        return f

    return add


def newest(v: DataFrame) -> Column:
    """The newest ts, as a subquery of the plan that uses it."""
    return v.agg(F.max("ts")).scalar()


def half(v: DataFrame) -> Column:
    """The snapshot S."""
    return v.agg(F.floor(F.max("ts") / 2).cast("long")).scalar()


def key_range(v: DataFrame) -> tuple[Column, Column]:
    keys = v.agg(F.max("key").alias("key"))
    return keys.select(F.floor(F.col("key") / 6).cast("long")).scalar(), keys.select(F.floor(F.col("key") / 2).cast("long")).scalar()


def bounds(v: DataFrame) -> tuple[int, int, int]:
    """(newest ts, low key, high key) as numbers, for what needs them before the plan is made."""
    r = v.agg(F.max("ts").alias("ts"), F.max("key").alias("key")).first()
    return r["ts"], r["key"] // 6, r["key"] // 2


P = "p AS (SELECT max(ts) AS now, max(ts) // 2 AS s, max(ts) - 100 AS w, max(key) // 6 AS lo, max(key) // 2 AS hi FROM versions)"
AS_OF = "ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS rn FROM versions, p WHERE ts <= s)"
NOW = "ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS rn FROM versions, p)"


# Reads


@query("SELECT key, ts, value FROM ranked WHERE rn = 1 AND op = 1 AND key = (SELECT min(key) FROM ranked WHERE rn = 1 AND op = 1)", views.VERSIONS, P, NOW)
def get_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least key that is live."""
    v = views.versions(spark, sf_dir)
    return snapshot.get(v, snapshot.scan(v).agg(F.min("key")).scalar())


@query("SELECT key, ts, value FROM ranked WHERE rn = 1 AND op = 1 AND key = (SELECT min(key) FROM ranked r WHERE rn = 1 AND op = 1 AND ts < (SELECT max(ts) FROM versions v WHERE v.key = r.key))", views.VERSIONS, P, AS_OF)
def get_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least key that is live at the snapshot and was written again later."""
    v = views.versions(spark, sf_dir)
    again = snapshot.scan(v, half(v)).join(snapshot.newest_ts(v), "key").where("ts < newest_ts")
    return snapshot.get(v, again.agg(F.min("key")).scalar(), half(v))


@query("SELECT key, ts, op, value, CASE WHEN op = 2 THEN 'deleted' ELSE 'value' END AS state FROM ranked WHERE rn = 1", views.VERSIONS, P, AS_OF)
def get_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.versions(spark, sf_dir)
    return snapshot.tristate(v, half(v))


def _layered(v: DataFrame, now: int) -> DataFrame:
    """Versions with the flush they are in as their layer, 0 the newest."""
    return v.withColumn("layer", compaction.segment_of(F.lit(now), FLUSH) - compaction.segment_of(F.col("ts"), FLUSH))


@query("SELECT key, ts, value FROM ranked WHERE rn = 1 AND op = 1", views.VERSIONS, P, AS_OF)
def layered_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.versions(spark, sf_dir)
    now = bounds(v)[0]
    return snapshot.scan(snapshot.merged_rows(_layered(snapshot.visible(v, now // 2), now)).drop("layer"))


@query("SELECT key, ts, value FROM ranked WHERE rn = 1 AND op = 1 AND key >= lo AND key < hi", views.VERSIONS, P, AS_OF)
def range_scan_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.versions(spark, sf_dir)
    return snapshot.scan(v, half(v), *key_range(v))


@query("SELECT key, ts, value FROM ranked WHERE rn = 1 AND op = 1 AND key >= lo AND key < hi", views.VERSIONS, P, NOW)
def range_scan_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.versions(spark, sf_dir)
    return snapshot.scan(v, None, *key_range(v))


@query("SELECT key, ts, value, (SELECT count(*) FROM wal WHERE op = 3) AS applied_index, now AS snapshot_ts FROM ranked WHERE rn = 1 AND op = 1", views.VERSIONS, views.WAL, P, NOW)
def snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.snapshot_scan(views.versions(spark, sf_dir), views.wal(spark, sf_dir).where(F.col("op") == COMMIT).count())


@query("SELECT key, ts, op, value FROM versions, p WHERE ts <= s AND key >= lo AND key < hi", views.VERSIONS, P)
def range_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.versions(spark, sf_dir)
    return snapshot.visible(v, half(v), *key_range(v))


@query("SELECT key, ts, op, value, row_number() OVER (ORDER BY key, ts DESC) - 1 AS pos FROM versions", views.VERSIONS)
def iterate_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.positions(views.versions(spark, sf_dir))


@query(
    "SELECT key, ts, CASE WHEN ts % 2500 = 0 AND ts < (SELECT now FROM p) THEN -value ELSE value END AS value, op FROM versions", views.VERSIONS, P
)
def merge_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each flush but the first also repeats the newest version of the one before, with another value."""
    v = views.versions(spark, sf_dir)
    now = bounds(v)[0]
    tagged = _layered(v, now)
    again = tagged.where((F.col("ts") % FLUSH == 0) & (F.col("ts") < now)).withColumns({"value": -F.col("value"), "layer": F.col("layer") - 1})
    return snapshot.merged_rows(tagged.unionByName(again)).drop("layer")


@query("SELECT key, max(ts) AS newest_ts FROM versions GROUP BY key", views.VERSIONS)
def newest_version_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.newest_ts(views.versions(spark, sf_dir))


@query("SELECT key, count(*) AS n_versions FROM versions GROUP BY key", views.VERSIONS)
def version_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.version_count(views.versions(spark, sf_dir))


@query("SELECT max(ts) AS last_applied_ts FROM versions", views.VERSIONS)
def last_applied_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.versions(spark, sf_dir).agg(F.max("ts").alias("last_applied_ts"))


@query("SELECT key, ts, op, value FROM ranked WHERE rn = 1 AND key = (SELECT min(key) FROM versions WHERE key >= (SELECT lo FROM p))", views.VERSIONS, P, NOW)
def seek_ge(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.versions(spark, sf_dir)
    return snapshot.seek(v, bounds(v)[1])


# Transactions

BUFFER = "buffer AS (SELECT txn, key, arg_max(op, stmt) AS op, arg_max(value, stmt) AS value, max(stmt) AS stmt FROM writes GROUP BY txn, key)"


@query("SELECT * FROM buffer", views.WRITES, BUFFER)
def txn_write_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.write_buffer(views.writes(spark, sf_dir))


@query(
    """, own AS (SELECT key, op AS own_op, value * 1.0 AS own_value FROM buffer WHERE txn = (SELECT min(txn) FROM buffer)),
snap AS (SELECT key, value FROM ranked WHERE rn = 1 AND op = 1)
SELECT key, CAST(CASE WHEN own_op IS NOT NULL THEN own_value ELSE value END AS DOUBLE) AS value, own_op IS NOT NULL AS own
FROM snap FULL JOIN own USING (key) WHERE own_op IS NULL OR own_op = 1""".lstrip(),
    views.VERSIONS, P, AS_OF, views.WRITES, BUFFER,
)
def txn_read_your_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, buffer = views.versions(spark, sf_dir), transactions.write_buffer(views.writes(spark, sf_dir))
    first = buffer.agg(F.min("txn")).first()[0]
    own = buffer.where(F.col("txn") == first).select("key", "op", F.col("value").cast("double").alias("value"))
    return transactions.read_your_writes(v, own, bounds(v)[0] // 2)


@query(
    """SELECT t.txn, count(*) AS n_conflicts, max(newest_ts) AS newest_ts FROM txns t
JOIN (SELECT key, max(ts) AS newest_ts FROM txns WHERE txn < (SELECT max(txn) // 2 FROM txns) GROUP BY key) n USING (key)
WHERE t.txn >= (SELECT max(txn) // 2 FROM txns) AND newest_ts > read_snap GROUP BY t.txn""",
    views.TXNS,
)
def txn_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the orders is the log; each later one is checked against it."""
    t = views.txns(spark, sf_dir)
    half = t.agg(F.max("txn")).first()[0] // 2
    later = t.where(F.col("txn") >= half)
    return transactions.conflicts(t.where(F.col("txn") < half).select("key", "ts"), later.select("txn", "read_snap"), later.select("txn", "key"))


@query(
    """SELECT key, txn, committed FROM (
WITH RECURSIVE
orders_of AS (SELECT txn, key, ts, read_snap, row_number() OVER (PARTITION BY key ORDER BY ts, txn) AS rn FROM txns),
fold AS (
  SELECT key, txn, rn, true AS committed, ts AS last FROM orders_of WHERE rn = 1
  UNION ALL
  SELECT o.key, o.txn, o.rn, f.last <= o.read_snap, CASE WHEN f.last <= o.read_snap THEN o.ts ELSE f.last END
  FROM fold f JOIN orders_of o ON o.key = f.key AND o.rn = f.rn + 1)
SELECT * FROM fold)""",
    views.TXNS,
)
def txn_fcw_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.first_committer_wins(views.txns(spark, sf_dir))


TXN_HEAD = "head AS (SELECT txn, min(read_snap) AS read_snap, min(txn) AS commit_order FROM (SELECT txn, 0 AS read_snap FROM writes) GROUP BY txn)"


#: Rounds of a table `it` (txn, key, ord, r, state 0 open, 1 won, 2 lost) in which the first of all its keys wins.
ROUNDS = """it AS (
  SELECT txn, key, ord, 0 AS r, 0 AS state FROM start
  UNION ALL
  SELECT txn, key, ord, r + 1, CASE WHEN state = 0 AND wins THEN 1 WHEN state = 0 AND beaten THEN 2 ELSE state END FROM (
    SELECT *, bool_or(met) OVER (PARTITION BY txn) AS beaten FROM (
      SELECT *, bool_or(state = 0 AND wins) OVER (PARTITION BY key) AND NOT wins AS met FROM (
        SELECT *, bool_and(ord = first) OVER (PARTITION BY txn) AS wins FROM (
          SELECT *, min(CASE WHEN state = 0 THEN ord END) OVER (PARTITION BY key) AS first FROM it))))
  WHERE (SELECT count(*) FROM it WHERE state = 0) > 0)"""


@query(
    f"""SELECT * FROM (
WITH RECURSIVE logged AS (SELECT DISTINCT key FROM buffer WHERE key % 50 = 0),
lost AS (SELECT DISTINCT txn FROM buffer JOIN logged USING (key)),
start AS (SELECT txn, key, txn AS ord FROM buffer WHERE txn NOT IN (SELECT txn FROM lost)),
{ROUNDS},
won AS (SELECT txn, row_number() OVER (ORDER BY txn) + 1 AS ts FROM (SELECT DISTINCT txn FROM it WHERE state = 1))
SELECT ts, op, key, value FROM buffer JOIN won USING (txn) UNION ALL SELECT ts, 3, NULL, NULL FROM won)""",
    views.WRITES, BUFFER,
)
def txn_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions began at snapshot 0 of a log that has one version of every 50th part, and share parts."""
    buffer = staged(transactions.write_buffer(views.writes(spark, sf_dir)).drop("stmt"), "buffer")
    logged = buffer.where(F.col("key") % 50 == 0).select("key", F.lit(1).cast("long").alias("ts")).distinct()
    txns = buffer.select("txn").distinct().select("txn", F.lit(0).cast("long").alias("read_snap"), F.col("txn").alias("commit_order"))
    return transactions.commit(txns, buffer, logged)


@query(
    """, judged AS (SELECT idx, session, seq, CASE WHEN idx % 11 = 0 THEN 'empty' WHEN idx % 7 = 0 THEN 'no commit' WHEN idx % 13 = 0 THEN 'two timestamps' WHEN idx % 17 = 0 THEN 'bad op' END AS bad FROM sessions),
fresh AS (SELECT idx, seq > coalesce(max(seq) OVER (PARTITION BY session ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fresh FROM judged WHERE bad IS NULL),
reasons AS (SELECT idx, coalesce(bad, CASE WHEN fresh THEN 'ok' ELSE 'duplicate' END) AS reason FROM judged LEFT JOIN fresh USING (idx))
SELECT idx, reason = 'ok' AS applied, reason FROM reasons""".lstrip(),
    views.SESSIONS,
)
def apply_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("idx")
    e = views.sessions(spark, sf_dir).withColumns(
        {"n_ops": i % 11, "ends_in_commit": i % 7 != 0, "n_ts": F.lit(1) + (i % 13 == 0).cast("int"), "n_bad_ops": (i % 17 == 0).cast("int")}
    )
    return transactions.apply_entries(e)


# Sessions

DEDUP = "dedup AS (SELECT *, seq > coalesce(max(seq) OVER (PARTITION BY session ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS applied FROM sessions)"


@query("SELECT session, max(seq) AS last_seq FROM sessions GROUP BY session", views.SESSIONS)
def session_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_table(views.sessions(spark, sf_dir))


@query("SELECT session, idx, seq, applied FROM dedup", views.SESSIONS, DEDUP)
def session_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.deduplicated(views.sessions(spark, sf_dir))


@query("SELECT session, CAST(sum(CAST(applied AS BIGINT)) AS BIGINT) AS counter, count(*) AS n_attempts FROM dedup GROUP BY session", views.SESSIONS, DEDUP)
def exactly_once_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.counters(views.sessions(spark, sf_dir))


@query("SELECT session, max(seq) AS last_seq FROM sessions GROUP BY session", views.SESSIONS)
def session_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The saved table of the first half of the log, and the second half's entries."""
    s = views.sessions(spark, sf_dir)
    half = s.agg(F.max("idx")).first()[0] // 2
    return sessions.merged_tables(*[sessions.session_table(s.where(w)) for w in (F.col("idx") <= half, F.col("idx") > half)])


# Log and recovery


@query("""SELECT "offset", op, key, value FROM wal WHERE "offset" < coalesce((SELECT min("offset") FROM wal WHERE status <> 'ok'), 1e18)""", views.WAL)
def wal_truncate_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.truncated_tail(views.wal(spark, sf_dir)).drop("status")


@query(
    """SELECT event_id AS seq, CAST(coalesce(sum(21 + length(event_type) + length(CAST(user_id AS VARCHAR)))
OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM events"""
)
def wal_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.length(F.col("user_id").cast("string")).alias("key_len"), F.length("event_type").alias("value_len"))
    return log.offsets(e).select("seq", "offset")


STAMPED = """grouped AS (SELECT *, coalesce(sum(CAST(op = 3 AS BIGINT)) OVER (ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM wal),
stamped AS (SELECT *, CASE WHEN op <> 3 AND "offset" % 97 = 0 THEN grp ELSE grp + 1 END AS ts FROM grouped),
marked AS (SELECT s.*, m.ts AS marker_ts FROM stamped s LEFT JOIN (SELECT grp, ts FROM stamped WHERE op = 3) m USING (grp) WHERE s.op <> 3)"""


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with a ts for each transaction; every 97th data record has the one before."""
    g = running(views.wal(spark, sf_dir), "offset", (F.col("op") == COMMIT).cast("long"), "g")
    return g.withColumn("ts", F.when((F.col("op") != COMMIT) & (F.col("offset") % 97 == 0), F.col("g")).otherwise(F.col("g") + 1)).drop("g")


@query('SELECT "offset", op, ts, key, value, CAST(grp AS BIGINT) AS grp FROM (SELECT *  EXCLUDE (ts), CAST(ts AS BIGINT) AS ts FROM marked) WHERE ts = marker_ts', views.WAL, STAMPED)
def wal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.replayed(_stamped(spark, sf_dir))[0].drop("status")


@query('SELECT "offset", op, CAST(ts AS BIGINT) AS ts, key, value, CAST(grp AS BIGINT) AS grp FROM marked WHERE marker_ts IS NULL OR ts <> marker_ts', views.WAL, STAMPED)
def wal_aborted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.replayed(_stamped(spark, sf_dir))[1].drop("status")


@query("SELECT max(ts) + 1 AS next_ts FROM versions", views.VERSIONS)
def recover_next_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.versions(spark, sf_dir)
    half = bounds(v)[0] // 2
    return log.next_ts(v.where(F.col("ts") > half), v.where(F.col("ts") <= half).agg(F.max("ts").alias("max_ts")))


@query("SELECT greatest(max(CASE WHEN \"offset\" < 100 THEN 100 END), 100 + count(*) FILTER (op = 3 AND \"offset\" >= 100)) AS applied_index FROM wal", views.WAL)
def recover_applied_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flush after 100 entries, then the rest of the log."""
    w = views.wal(spark, sf_dir)
    flushed = spark.range(1).select(F.lit(100).cast("long").alias("applied_index"))
    return log.applied_index(w.where("offset >= 100"), flushed, 100)


@query("SELECT \"offset\", op, key, value FROM wal WHERE \"offset\" = (SELECT max(\"offset\") // 3 FROM wal)", views.WAL)
def wal_read_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = views.wal(spark, sf_dir)
    return w.where(F.col("offset") == w.agg(F.max("offset")).first()[0] // 3).drop("status")


# Storage


@query("SELECT CAST(sum(length(CAST(key AS VARCHAR)) + 8 + 8 + 1 + 64) AS BIGINT) AS bytes, count(*) AS n_entries FROM versions", views.VERSIONS)
def memtable_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.memtable_size(views.versions(spark, sf_dir), F.length(F.col("key").cast("string")), F.lit(8))


@query("SELECT (ts - 1) // 2500 + 1 AS id, count(*) AS n_rows, min(ts) AS min_ts, max(ts) AS max_ts, min(key) AS min_key, max(key) AS max_key FROM versions GROUP BY 1", views.VERSIONS)
def flush_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.segments(views.versions(spark, sf_dir), FLUSH)


@query(
    """, seg AS (SELECT pos + CASE pos % 1000 WHEN 10 THEN 1 WHEN 11 THEN -1 ELSE 0 END AS pos, key, ts FROM placed),
pairs AS (SELECT pos, key, ts, lag(key) OVER w AS k0, lag(ts) OVER w AS t0 FROM seg WINDOW w AS (ORDER BY pos))
SELECT pos, CASE WHEN key = k0 AND ts = t0 THEN 'duplicate' ELSE 'out of order' END AS problem FROM pairs WHERE k0 > key OR (k0 = key AND t0 <= ts)""".lstrip(),
    views.VERSIONS, "placed AS (SELECT key, ts, row_number() OVER (ORDER BY key, ts DESC) - 1 AS pos FROM versions)",
)
def sstable_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment in which two neighbours of each thousand are swapped."""
    placed = compaction.positions(views.versions(spark, sf_dir))
    p = F.col("pos") % 1000
    n = placed.count()
    swapped = placed.withColumn("pos", F.col("pos") + F.when(p == 10, 1).when(p == 11, -1).otherwise(0))
    return compaction.order_violations(swapped.where(F.col("pos") <= n))


@query(
    "SELECT pos // 64 AS block, count(*) AS n_records, min(pos) * 64 AS \"offset\", count(*) * 64 AS size, arg_min(key, pos) AS first_key FROM placed GROUP BY 1",
    views.VERSIONS, "placed AS (SELECT key, ts, row_number() OVER (ORDER BY key, ts DESC) - 1 AS pos FROM versions)",
)
def sstable_block_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.block_index(compaction.positions(views.versions(spark, sf_dir)), 64)


@query("SELECT key, s AS ts, 1 AS op, value FROM ranked WHERE rn = 1 AND op = 1", views.VERSIONS, P, AS_OF)
def build_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.versions(spark, sf_dir)
    return snapshot.build_snapshot(v, bounds(v)[0] // 2).select("key", "ts", "op", "value")


@query(
    """, seg AS (SELECT DISTINCT (ts - 1) // 200 + 1 AS id FROM versions),
old AS (SELECT id FROM seg ORDER BY id LIMIT 4)
SELECT id, (SELECT max(id) FROM old) AS output_id, (SELECT min(id) FROM old) = (SELECT min(id) FROM seg) AS bottom FROM old WHERE (SELECT count(*) FROM old) >= 4""".lstrip(),
    views.VERSIONS,
)
def compaction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.plan(compaction.segments(views.versions(spark, sf_dir), 200))


@query(
    """, life AS (SELECT *, bool_or(action = 'begin') OVER w AS begun FROM actions WINDOW w AS (PARTITION BY txn ORDER BY seq)),
open AS (SELECT txn, min(seq) AS read_snap FROM life WHERE begun GROUP BY txn HAVING NOT bool_or(action IN ('commit', 'rollback')))
SELECT least((SELECT min(read_snap) FROM open), (SELECT max(ts) FROM versions)) AS watermark""".lstrip(),
    views.VERSIONS, views.ACTIONS,
)
def gc_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of transactions that are still open after all events; each reads as of its first action."""
    a, v = views.actions(spark, sf_dir), views.versions(spark, sf_dir)
    open_ = transactions.active(a, bounds(v)[0])
    return compaction.watermark(open_.select(F.col("begin_seq").alias("read_snap")), v)


@query(
    """, n AS (SELECT *, lag(ts) OVER (PARTITION BY key ORDER BY ts DESC) AS newer FROM versions, p)
SELECT key, ts, op, value FROM n WHERE (newer IS NULL AND NOT (op = 2 AND ts <= w)) OR newer > w""".lstrip(),
    views.VERSIONS, P,
)
def gc_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.versions(spark, sf_dir)
    return compaction.collected(v, newest(v) - 100, True)


@query("SELECT key, ts, op, CASE WHEN ts % 3 = 0 THEN -value ELSE value END AS value FROM versions", views.VERSIONS)
def gc_midlayer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers above the bottom: the newer repeats every third version with another value. Nothing is collected."""
    v = views.versions(spark, sf_dir)
    again = v.where("ts % 3 = 0").withColumn("value", -F.col("value"))
    return compaction.compacted([again, v], bounds(v)[0] - 100, False)


@query("SELECT key, ts, op, value FROM ranked WHERE rn = 1 AND op = 1", views.VERSIONS, P, NOW)
def store_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flush every fifth of the commits to a segment store, compact it, and read what is left."""
    from .sources.segments import SegmentStore

    v = views.versions(spark, sf_dir)
    now = bounds(v)[0]
    store = SegmentStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    for k in range(5):
        store.flush(v.where((F.col("ts") > now * k // 5) & (F.col("ts") <= now * (k + 1) // 5)), k + 1)
    store.compact(now)
    return snapshot.as_of(store.read()).where(F.col("op") == PUT).select("key", "ts", "op", "value")


# Codecs


@query(
    """, coded AS (SELECT key, ts, lower(hex(encode(CAST(key AS VARCHAR)))) || lower(printf('%016x', xor(CAST(ts AS UBIGINT), 18446744073709551615::UBIGINT))) AS encoded FROM versions)
SELECT key, ts, encoded, CAST(key AS VARCHAR) AS back_key, ts AS back_ts FROM coded""".lstrip(),
    views.VERSIONS,
)
def mvcc_key_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views.versions(spark, sf_dir).select("key", "ts")
    coded = v.withColumn("raw", codec.versioned_key(F.col("key").cast("string"), F.col("ts")))
    return coded.select("key", "ts", F.lower(F.hex("raw")).alias("encoded"), codec.user_key(F.col("raw")).cast("string").alias("back_key"), codec.key_ts(F.col("raw")).alias("back_ts"))


@query(
    """, b AS (SELECT n, least(greatest(bits, 1), 64) AS b FROM (SELECT event_id AS n, event_id % 70 AS bits FROM events))
SELECT n, CAST(b AS BIGINT) AS bits_a_key, CAST(ceil(greatest(n, 1) * b / 8.0) * 8 AS BIGINT) AS m, CAST(least(greatest(round(b * ln(2)), 1), 30) AS INTEGER) AS k FROM b""".lstrip(),
)
def bloom_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), (F.col("event_id") % 70).alias("bits"))
    m, k = bloom.parameters(F.col("n"), F.col("bits"))
    return e.select("n", F.least(F.greatest("bits", F.lit(1)), F.lit(64)).cast("long").alias("bits_a_key"), m.alias("m"), k.alias("k"))


ORACLE["bloom_params"] = ORACLE["bloom_params"].replace(", b AS", "WITH b AS", 1)


#: FNV-1a of a text, its k bit places for 10 bits a key, and the filters (filter, bit) of the users with an even number, by number mod 4.
FNV = """hashed AS (SELECT key, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length(CAST(key AS VARCHAR)) + 1), lambda i: ascii(substring(CAST(key AS VARCHAR), CAST(i AS INTEGER), 1))::UHUGEINT)),
    lambda h, b: xor(h, b) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT) AS h FROM probed),
sized AS (SELECT ((count(*) * 10 + 7) // 8 * 8)::UHUGEINT AS m FROM added),
placed AS (SELECT key, (h % 4294967296::UHUGEINT + i::UHUGEINT * (h // 4294967296::UHUGEINT)) % m AS bit FROM hashed, sized, range(7) AS t(i))"""
PROBED = "added AS (SELECT DISTINCT key FROM versions WHERE key % 2 = 0), probed AS (SELECT CAST(k AS BIGINT) AS key FROM range(2 * (SELECT max(key) FROM versions)) AS t(k))"


def _text(keys: DataFrame) -> DataFrame:
    return keys.select(F.col("key").cast("string").alias("key"))


@query(
    """, bits AS (SELECT DISTINCT bit FROM placed WHERE key IN (SELECT key FROM added))
SELECT key, bool_and(bit IN (SELECT bit FROM bits)) AS maybe FROM placed GROUP BY key""".lstrip(),
    views.VERSIONS, PROBED, FNV,
)
def bloom_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with an even number are added; all numbers up to twice the largest are probed."""
    v = views.versions(spark, sf_dir)
    keys = v.where("key % 2 = 0").select("key").distinct()
    probes = v.agg(F.max("key").alias("top")).select(F.explode(F.sequence(F.lit(0).cast("long"), 2 * F.col("top") - 1)).alias("key"))
    m, k = bloom.size(keys.count(), 10)
    words = bloom.built(_text(keys), m, k)
    return bloom.may_contain(_text(probes), words, m, k).select(F.col("key").cast("long").alias("key"), "maybe")


@query(
    """, bits AS (SELECT DISTINCT key % 4 AS filter, bit FROM placed WHERE key IN (SELECT key FROM added)),
bytes AS (SELECT filter, bit // 8 AS at, sum(1 << (bit % 8)::INTEGER) AS b FROM bits GROUP BY ALL),
filters AS (SELECT DISTINCT filter FROM bits),
all_bytes AS (SELECT f.filter, i, coalesce(b, 0) AS b FROM filters f, range((SELECT (m // 8)::BIGINT FROM sized)) AS t(i) LEFT JOIN bytes x ON x.filter = f.filter AND x.at = i)
SELECT filter, 7 AS k, (SELECT m::BIGINT FROM sized) AS m, true AS valid, sha256('07' || string_agg(printf('%02X', b::INTEGER), '' ORDER BY i)) AS sha,
  (SELECT count(*) FROM (SELECT DISTINCT filter, bit // 64 AS w FROM bits) x WHERE x.filter = a.filter) AS n_words FROM all_bytes a GROUP BY filter""".lstrip(),
    views.VERSIONS, PROBED, FNV,
)
def bloom_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters of the users with an even number, by number mod 4, as bytes and loaded again."""
    keys = views.versions(spark, sf_dir).where("key % 2 = 0").select("key").distinct()
    m, k = bloom.size(keys.count(), 10)
    filters = bloom.packed(keys.select((F.col("key") % 4).alias("filter"), F.col("key").cast("string").alias("key")), m, k)
    words = bloom.packed_words(filters).groupBy("filter").agg(F.count("*").alias("n_words"))
    return bloom.loaded(filters).join(filters, "filter").join(words, "filter").select("filter", "k", "m", "valid", F.sha2(F.hex("data"), 256).alias("sha"), "n_words")


@query()
def record_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as checksummed log records, decoded again: (event_id, ok)."""
    e = views.table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    coded = e.select(F.col("event_id").alias("log"), codec.record(F.lit(PUT), F.col("event_id"), F.col("event_type"), F.col("props")).alias("data"))
    back = codec.decoded_records(coded)
    ok = (F.col("status") == "ok") & (F.col("ts") == F.col("event_id")) & (F.col("key").cast("string") == F.col("event_type")) & (F.col("value").cast("string") == F.coalesce("props", F.lit("")))
    return back.join(e, back["log"] == e["event_id"]).select("event_id", ok.alias("ok"))


ORACLE["record_codec"] = "SELECT event_id, true AS ok FROM events"


# Replicated log

MATCH = """heads AS (SELECT node, max(idx) AS last, max(CASE WHEN f.term = l.term THEN idx END) AS match_idx FROM follower_logs f JOIN leader_log l USING (idx) GROUP BY node
  UNION ALL SELECT 0, max(idx), max(idx) FROM leader_log)"""


def _match(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead, follow = views.leader_log(spark, sf_dir), views.follower_logs(spark, sf_dir)
    same = follow.join(lead.select("idx", F.col("term").alias("lead_term")), "idx")
    held = same.groupBy("node").agg(F.max(F.when(F.col("term") == F.col("lead_term"), F.col("idx"))).alias("match_idx"))
    return held.unionByName(lead.select(F.lit(0).alias("node"), F.col("idx").alias("match_idx")).groupBy("node").agg(F.max("match_idx").alias("match_idx")))


@query(
    """, c AS (SELECT match_idx AS idx FROM heads ORDER BY match_idx DESC LIMIT 1 OFFSET 2)
SELECT CAST(CASE WHEN (SELECT term FROM leader_log WHERE idx = c.idx) = (SELECT max(term) FROM leader_log) THEN c.idx ELSE 0 END AS BIGINT) AS commit_index FROM c""".lstrip(),
    views.LEADER, views.FOLLOWERS, MATCH,
)
def raft_commit_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = views.leader_log(spark, sf_dir)
    return replication.commit_index(_match(spark, sf_dir), lead, lead.agg(F.max("term")).first()[0], 0)


@query("SELECT idx, CAST((3 + event_id % 3) // 2 + 1 AS INTEGER) AS majority, '1,2' || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN ',3' ELSE ',3,4' END AS peers FROM leader_log WHERE kind = 1", views.LEADER)
def raft_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("members")
    return views.leader_log(spark, sf_dir).where("kind = 1").select("idx", replication.majority(m).alias("majority"), F.array_join(replication.voting_peers(m, 0), ",").alias("peers"))


@query("SELECT seq, (last_term, last_idx) >= (own_term, own_idx) AS up_to_date FROM vote_requests", views.REQUESTS)
def raft_up_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return views.vote_requests(spark, sf_dir).select("seq", replication.up_to_date(c("last_term"), c("last_idx"), c("own_term"), c("own_idx")).alias("up_to_date"))


GRANTS = """grants AS (SELECT r.seq, r.voter, r.term, r.candidate, r.last_idx >= 50 AND r.candidate = c.chosen AS granted FROM vote_requests r
  LEFT JOIN (SELECT voter, term, arg_min(candidate, seq) AS chosen FROM vote_requests WHERE last_idx >= 50 GROUP BY voter, term) c USING (voter, term))"""


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    r = views.vote_requests(spark, sf_dir)
    return replication.votes(r.withColumn("eligible", replication.up_to_date(c("last_term"), c("last_idx"), c("own_term"), c("own_idx"))))


@query("SELECT seq, voter, term, candidate, coalesce(granted, false) AS granted FROM grants", views.REQUESTS, GRANTS)
def raft_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _votes(spark, sf_dir).select("seq", "voter", "term", "candidate", "granted")


@query("SELECT term, candidate AS winner, count(DISTINCT voter) AS n_votes FROM grants WHERE granted GROUP BY term, candidate HAVING count(DISTINCT voter) >= 3", views.REQUESTS, GRANTS)
def raft_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replication.winners(_votes(spark, sf_dir), 5)


@query("SELECT voter AS node, max(term) AS term FROM vote_requests GROUP BY voter", views.REQUESTS)
def raft_running_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replication.running_term(views.vote_requests(spark, sf_dir).select(F.col("voter").alias("node"), "term"))


@query(
    """, asked AS (SELECT CAST(node AS INTEGER) AS node, idx AS prev_idx, term AS prev_term FROM leader_log, unnest(range(1, 5)) AS t(node))
SELECT a.node, prev_idx, prev_term, coalesce(f.term = prev_term, false) AS ok FROM asked a LEFT JOIN follower_logs f ON f.node = a.node AND f.idx = prev_idx""".lstrip(),
    views.LEADER, views.FOLLOWERS,
)
def raft_matches_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = views.leader_log(spark, sf_dir).select(F.explode(F.sequence(F.lit(1), F.lit(4))).alias("node"), F.col("idx").alias("prev_idx"), F.col("term").alias("prev_term"))
    return replication.matches_prev(asked, views.follower_logs(spark, sf_dir))


@query(
    """, sent AS (SELECT CAST(node AS INTEGER) AS node, idx, term FROM leader_log, unnest(range(1, 5)) AS t(node) WHERE idx <= (SELECT max(idx) FROM leader_log) - 50 * node),
cuts AS (SELECT node, min(idx) AS cut FROM follower_logs f JOIN sent s USING (node, idx) WHERE f.term <> s.term GROUP BY node)
SELECT node, idx, CASE WHEN cut IS NULL OR idx < cut THEN coalesce(f.term, s.term) ELSE s.term END AS term
FROM follower_logs f FULL JOIN sent s USING (node, idx) LEFT JOIN cuts USING (node)
WHERE CASE WHEN cut IS NULL OR idx < cut THEN coalesce(f.term, s.term) ELSE s.term END IS NOT NULL""".lstrip(),
    views.LEADER, views.FOLLOWERS,
)
def raft_log_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node n gets the leader's entries up to N - 50 n: shorter than its own log."""
    lead = views.leader_log(spark, sf_dir)
    n = lead.agg(F.max("idx")).first()[0]
    sent = lead.select(F.explode(F.sequence(F.lit(1), F.lit(4))).alias("node"), "idx", "term").where(F.col("idx") <= n - 50 * F.col("node"))
    return replication.appended(views.follower_logs(spark, sf_dir), sent)


@query("SELECT b.idx AS base_idx, b.term AS base_term, l.idx, l.term FROM leader_log l, leader_log b WHERE b.idx = (SELECT max(idx) // 2 FROM leader_log) AND l.idx > b.idx", views.LEADER)
def raft_log_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = views.leader_log(spark, sf_dir)
    return replication.compacted_log(lead, lead.agg(F.max("idx")).first()[0] // 2)


@query(
    """, states AS (SELECT CAST(node AS INTEGER) AS node, CASE WHEN node % 2 = 0 THEN 1 ELSE 1000000 END AS term, CAST(node * 10 AS INTEGER) AS voted FROM unnest(range(1, 5)) AS t(node)),
logs AS (SELECT node, max(term) AS log_term FROM follower_logs GROUP BY node)
SELECT node, CAST(greatest(term, coalesce(log_term, 0)) AS BIGINT) AS term, CASE WHEN term >= coalesce(log_term, 0) THEN voted ELSE -1 END AS voted_for FROM states LEFT JOIN logs USING (node)""".lstrip(),
    views.LEADER, views.FOLLOWERS,
)
def raft_restart_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.col("id").cast("int")
    states = spark.range(1, 5).select(node.alias("node"), F.when(F.col("id") % 2 == 0, 1).otherwise(1_000_000).cast("long").alias("term"), (node * 10).alias("voted_for"))
    return replication.restart_state(states, views.follower_logs(spark, sf_dir))


@query(
    """, c AS (SELECT idx, coalesce(max(CASE WHEN kind = 1 THEN idx END) OVER (ORDER BY idx), 0) AS config_idx FROM leader_log)
SELECT idx, config_idx, CASE WHEN config_idx = 0 THEN '0,1,2' ELSE '0,1,2' || CASE (config_idx - 1) % 3 WHEN 0 THEN '' WHEN 1 THEN ',3' ELSE ',3,4' END END AS members FROM c""".lstrip(),
    views.LEADER,
)
def raft_config_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replication.config_as_of(views.leader_log(spark, sf_dir), [0, 1, 2]).withColumn("members", F.array_join("members", ","))


@query('SELECT idx AS "commit", (SELECT max(idx) FROM leader_log WHERE kind = 1) <= idx AS gate_open FROM leader_log', views.LEADER)
def raft_config_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = views.leader_log(spark, sf_dir)
    return replication.config_gate(lead, lead.select(F.col("idx").alias("commit")))


@query(
    """SELECT string_agg(CAST(server AS VARCHAR), ',' ORDER BY server) AS voters FROM (
SELECT user_id % 40 AS server, arg_max(event_type, event_id) AS last FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1) WHERE last = 'signup'"""
)
def raft_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups add a server, errors remove it."""
    e = views.table(spark, sf_dir, "events").where("event_type IN ('signup', 'error')")
    changes = e.select(F.col("event_id").alias("seq"), (F.col("user_id") % 40).alias("server"), F.when(F.col("event_type") == "signup", "add").otherwise("remove").alias("action"))
    return replication.members(changes).select(F.array_join("voters", ",").alias("voters"))


@query("SELECT arg_max(voter, term * 1000000000 + seq) AS leader, max(term) AS term FROM vote_requests WHERE role = 'leader'", views.REQUESTS)
def raft_current_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replication.current_leader(views.vote_requests(spark, sf_dir).select(F.col("voter").alias("node"), "term", "seq", "role"))


@query(
    """, k AS (SELECT max(idx) - 200 AS c FROM leader_log)
SELECT node, max(f.idx) AS applied, count(*) FILTER (f.idx <= c AND f.term = l.term) = max(c) AS equal,
  count(*) FILTER (f.idx <= c AND f.term = l.term) = max(c) AND max(f.idx) >= max(c) AS converged
FROM follower_logs f JOIN leader_log l USING (idx), k GROUP BY node""".lstrip(),
    views.LEADER, views.FOLLOWERS,
)
def replica_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = views.leader_log(spark, sf_dir)
    return replication.convergence(views.follower_logs(spark, sf_dir), lead, lead.agg(F.max("idx")).first()[0] - 200)


# Checker


@query(
    "SELECT key, CASE WHEN bool_or(kind = 'get' AND starts_with(coalesce(value, ''), 'x')) THEN 'violation' ELSE 'ok' END AS verdict, count(*) AS n_ops FROM history GROUP BY key", views.HISTORY
)
def lincheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checker.check(views.history(spark, sf_dir))


@query("SELECT * FROM history h WHERE kind = 'get' AND found AND NOT EXISTS (SELECT 1 FROM history w WHERE w.kind = 'put' AND w.key = h.key AND w.value = h.value)", views.HISTORY)
def lincheck_phantom_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checker.phantom_reads(views.history(spark, sf_dir)).select("key", "client", "kind", "value", "found", "call", "ret")


@query(
    """SELECT call, ret, client, 'client ' || client || ' [' || call || ', ' || ret || '] ' ||
CASE kind WHEN 'put' THEN 'put ' || value WHEN 'delete' THEN 'delete' ELSE 'get -> ' || coalesce(value, '(absent)') END AS line
FROM history WHERE key = (SELECT min(key) FROM history WHERE kind = 'get' AND starts_with(coalesce(value, ''), 'x'))""",
    views.HISTORY,
)
def lincheck_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = views.history(spark, sf_dir)
    first = checker.verdict(checker.check(h)).first()["first_violation"]
    return checker.witness(h, first or "")


@query("SELECT client, key, kind, call AS x, ret - call AS width, client AS lane FROM history", views.HISTORY)
def history_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checker.lanes(views.history(spark, sf_dir))


OUTCOMES = """tries AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'get' ELSE 'put' END AS kind, ['ok', 'maybe', 'timeout', 'conflict', 'failed'][1 + event_id % 5] AS result,
  event_id % 2 = 0 AS after_uncertain, event_id * 2 AS call, event_id * 2 + 1 AS ret FROM events),
outs AS (SELECT *, CASE WHEN result = 'ok' THEN ret WHEN kind <> 'get' AND (result IN ('maybe', 'timeout') OR (result = 'conflict' AND after_uncertain)) THEN 9223372036854775807 END AS effective_ret FROM tries)"""


@query("SELECT *, effective_ret IS NOT NULL AS recorded FROM outs", OUTCOMES)
def write_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = views.table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") == "view", "get").otherwise("put").alias("kind"), F.array(*map(F.lit, ("ok", "maybe", "timeout", "conflict", "failed")))[(i % 5).cast("int")].alias("result"),
        (i % 2 == 0).alias("after_uncertain"), (i * 2).alias("call"), (i * 2 + 1).alias("ret"),
    )
    return checker.write_outcomes(e)


# Streams


@query("SELECT session, idx, seq, applied FROM dedup", views.SESSIONS, DEDUP)
def stream_session_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.apply import deduplicated, run_available

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(views.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    entries = source.select(F.col("user_id").alias("session"), F.col("event_id").alias("idx"), F.floor("value").cast("long").alias("seq"))
    return run_available(deduplicated(entries), f"{at}/out", f"{at}/checkpoint")


@query("SELECT key, ts, op, value FROM ranked WHERE rn = 1", views.VERSIONS, P, NOW)
def stream_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.apply import latest_versions, run_available

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    e = spark.readStream.schema(views.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    versions = e.select(F.col("user_id").alias("key"), (F.col("event_id") + 1).alias("ts"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("op"), "value")
    return run_available(latest_versions(versions), f"{at}/out", f"{at}/checkpoint", "complete")


# Shell


@query(
    """, w AS (SELECT line_no, key, CASE WHEN verb = 'PUT' THEN value END AS stored FROM cmd WHERE verb IN ('PUT', 'DELETE'))
SELECT line_no, CASE verb WHEN 'PUT' THEN 'OK' WHEN 'DELETE' THEN 'OK' WHEN 'GET' THEN coalesce((SELECT arg_max(coalesce(stored, '(not found)'), w.line_no) FROM w WHERE w.key = c.key AND w.line_no < c.line_no), '(not found)')
  ELSE 'unknown command: CLICK (try HELP)' END AS output FROM cmd c""".lstrip(),
    "cmd AS (SELECT event_id AS line_no, CASE event_type WHEN 'purchase' THEN 'GET' WHEN 'view' THEN 'GET' WHEN 'error' THEN 'DELETE' WHEN 'click' THEN 'CLICK' ELSE 'PUT' END AS verb, 'k' || user_id AS key, 'v' || event_id AS value FROM events)",
)
def repl_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as shell lines: signups put, purchases and views get, errors delete, clicks are no command."""
    from .shell import script

    e = views.table(spark, sf_dir, "events")
    key, t = F.concat(F.lit("k"), F.col("user_id").cast("string")), F.col("event_type")
    line = (
        F.when(t.isin("purchase", "view"), F.concat(F.lit("get "), key))
        .when(t == "error", F.concat(F.lit(" DEL  "), key))
        .when(t == "click", F.concat(F.lit("click "), key))
        .otherwise(F.concat(F.lit("Put "), key, F.lit(" v"), F.col("event_id").cast("string")))
    )
    return script(e.select(F.col("event_id").alias("line_no"), line.alias("line")))


# Transactions of several keys, preparation, lifecycles

MULTI = "pairs AS (SELECT txn, key, ts, read_snap FROM txns UNION SELECT txn, 1000000 + txn * 31 % 700 AS key, ts, read_snap FROM txns)"


def _pairs(t: DataFrame) -> DataFrame:
    return t.select("txn", F.explode(F.array("key", F.lit(1000000) + F.col("txn") * 31 % 700)).alias("key"))


@query(
    f"""SELECT * FROM (
WITH RECURSIVE {MULTI},
it AS (
  SELECT txn, key, ts, read_snap, 0 AS r, 0 AS state FROM pairs
  UNION ALL
  SELECT txn, key, ts, read_snap, r + 1, CASE WHEN state <> 0 THEN state WHEN lost THEN 2 WHEN waits THEN 0 ELSE 1 END FROM (
    SELECT *, bool_or(behind_won) OVER (PARTITION BY txn) AS lost, bool_or(behind_open) OVER (PARTITION BY txn) AS waits FROM (
      SELECT *, coalesce(max(CASE WHEN state = 1 THEN ts END) OVER w > read_snap, false) AS behind_won,
        coalesce(max(CASE WHEN state = 0 THEN ts END) OVER w > read_snap, false) AS behind_open
      FROM it WINDOW w AS (PARTITION BY key ORDER BY ts, txn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
  WHERE (SELECT count(*) FROM it WHERE state = 0) > 0)
SELECT txn, max(state) = 1 AS committed FROM it GROUP BY txn)""",
    views.TXNS,
)
def txn_fcw_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order writes its customer and one of 700 other keys."""
    t = views.txns(spark, sf_dir)
    return transactions.first_committer_wins_all(t.select("txn", "ts", "read_snap"), _pairs(t))


def _asked(t: DataFrame) -> DataFrame:
    """The later half of the orders as transactions of 50 sessions, whose seq goes back now and then."""
    n = F.col("txn")
    session = F.when(n % 3 == 0, n % 50)
    return t.select("txn", "read_snap", n.alias("commit_order"), session.alias("session"), F.when(session.isNotNull(), n - n % 7 * 100).alias("seq"))


PREPARE = """, cut AS (SELECT max(txn) // 2 AS c FROM txns), log AS (SELECT key, ts FROM txns, cut WHERE txn < c),
asked AS (SELECT txn, key, read_snap, CASE WHEN txn % 3 = 0 THEN txn % 50 END AS session, txn - txn % 7 * 100 AS seq FROM txns, cut WHERE txn >= c),
had AS (SELECT txn % 50 AS session, max(txn) + 2000 AS last_seq FROM txns, cut WHERE txn < c AND txn % 3 = 0 GROUP BY 1),
judged AS (SELECT a.*, CASE WHEN a.txn % 9 = 0 THEN 'empty' WHEN session IS NOT NULL AND a.seq <= coalesce(last_seq, 0) THEN 'duplicate'
  WHEN EXISTS (SELECT 1 FROM log l WHERE l.key = a.key AND l.ts > a.read_snap) THEN 'conflict' ELSE 'prepared' END AS status FROM asked a LEFT JOIN had USING (session)),
stamped AS (SELECT *, CASE WHEN status = 'prepared' THEN (SELECT max(ts) FROM log) + row_number() OVER (PARTITION BY status ORDER BY txn) END AS ts FROM judged)"""


def _prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = views.txns(spark, sf_dir)
    cut = t.agg(F.max("txn")).first()[0] // 2
    past, later = t.where(F.col("txn") < cut), t.where(F.col("txn") >= cut)
    txns = _asked(later)
    buffer = later.where("txn % 9 <> 0").select("txn", "key", F.lit(PUT).alias("op"), F.col("txn").alias("value"))
    had = _asked(past).where("session IS NOT NULL").groupBy("session").agg((F.max("txn") + 2000).alias("last_seq"))
    return transactions.prepared(txns, buffer, past.select("key", "ts"), had), buffer, txns


@query(f"{PREPARE} SELECT txn, status, ts FROM stamped", views.TXNS)
def txn_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir)[0]


@query(
    f"""{PREPARE} SELECT txn, ts, 1 AS op, key, txn AS value, NULL::BIGINT AS session, NULL::BIGINT AS seq FROM stamped WHERE status = 'prepared'
UNION ALL SELECT txn, ts, 3, NULL, NULL, session, CASE WHEN session IS NOT NULL THEN seq END FROM stamped WHERE status = 'prepared'""",
    views.TXNS,
)
def txn_entry_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.entry_records(*_prepared(spark, sf_dir))


@query("SELECT (SELECT count(*) FROM wal WHERE op = 3) + 1 AS idx, 3 AS op, max(ts) + 1 AS ts FROM versions", views.VERSIONS, views.WAL)
def apply_control_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A no-op after all that the log has applied."""
    done = views.wal(spark, sf_dir).where(F.col("op") == COMMIT).count()
    return transactions.control_marker(views.versions(spark, sf_dir), done + 1)


LIFE = """begun AS (SELECT *, bool_or(action = 'begin') OVER (PARTITION BY txn ORDER BY seq) AS began FROM actions),
life AS (SELECT seq, txn, action, CASE WHEN NOT began THEN 'unknown'
  WHEN coalesce(bool_or(began AND action IN ('commit', 'rollback')) OVER (PARTITION BY txn ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'finished' ELSE 'ok' END AS outcome FROM begun)"""


@query("SELECT * FROM life", views.ACTIONS, LIFE)
def txn_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.lifecycles(views.actions(spark, sf_dir))


@query("SELECT txn, min(seq) AS begin_seq FROM life WHERE outcome = 'ok' GROUP BY txn HAVING NOT bool_or(action IN ('commit', 'rollback'))", views.ACTIONS, LIFE)
def txn_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = views.actions(spark, sf_dir)
    return transactions.active(a, a.agg(F.max("seq")).first()[0])


@query(
    """, bad AS (SELECT idx, session, seq FROM sessions WHERE NOT (idx % 11 = 0 OR idx % 7 = 0 OR idx % 13 = 0 OR idx % 17 = 0))
SELECT max(idx) AS applied_index FROM bad""".lstrip(),
    views.SESSIONS,
)
def apply_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions.applied_through(apply_entries(spark, sf_dir))


# Decisions of a replicated log with all their cases

ASKED = """asked AS (SELECT seq, voter, candidate, greatest(1, term + CASE WHEN seq % 7 = 0 THEN 3 ELSE 0 END - CASE WHEN seq % 11 = 0 THEN 2 ELSE 0 END) AS term,
  last_idx >= 50 AS eligible, seq % 13 = 0 AS in_contact, seq % 26 = 0 AS transfer, CASE WHEN voter = 0 THEN 2 ELSE 0 END AS start_term, CASE WHEN voter = 0 THEN 1 ELSE -1 END AS start_vote FROM vote_requests)"""


@query(
    f"""SELECT * FROM (
WITH RECURSIVE {ASKED},
numbered AS (SELECT *, row_number() OVER (PARTITION BY voter ORDER BY seq) AS rn FROM asked),
steps AS (
  SELECT voter, 0::BIGINT AS rn, start_term::BIGINT AS t, start_vote::BIGINT AS v, NULL::BIGINT AS seq, false AS granted FROM (SELECT DISTINCT voter, start_term, start_vote FROM asked)
  UNION ALL
  SELECT voter, rn, t, CASE WHEN g THEN candidate ELSE v END, seq, g FROM (
    SELECT *, heard AND term = t AND eligible AND (v = -1 OR v = candidate) AS g FROM (
      SELECT n.voter, n.rn, n.seq, n.candidate, n.term, n.eligible, h.heard, CASE WHEN h.heard THEN greatest(s.t, n.term) ELSE s.t END AS t, CASE WHEN h.heard AND n.term > s.t THEN -1 ELSE s.v END AS v
      FROM steps s JOIN numbered n ON n.voter = s.voter AND n.rn = s.rn + 1, LATERAL (SELECT NOT (n.in_contact AND NOT n.transfer) AS heard) h)))
SELECT seq, voter, t AS reply_term, granted FROM steps WHERE rn > 0)""",
    views.REQUESTS,
)
def raft_vote_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms jump ahead and fall back; some voters have just heard from a leader, some requests are transfers."""
    n = F.col("seq")
    term = F.greatest(F.lit(1), F.col("term") + F.when(n % 7 == 0, 3).otherwise(0) - F.when(n % 11 == 0, 2).otherwise(0))
    first = F.col("voter") == 0
    r = views.vote_requests(spark, sf_dir).withColumns(
        {"term": term, "eligible": F.col("last_idx") >= 50, "in_contact": n % 13 == 0, "transfer": n % 26 == 0, "start_term": F.when(first, 2).otherwise(0), "start_vote": F.when(first, 1).otherwise(-1)}
    )
    return replication.votes(r).select("seq", "voter", "reply_term", "granted")


MESSAGES = """, top AS (SELECT max(idx) AS n, max(term) AS t FROM leader_log),
states AS (SELECT CAST(node AS INTEGER) AS node, CASE WHEN node = 2 THEN t + 5 ELSE t - 1 END AS term, 10 AS commit_idx FROM top, unnest(range(1, 5)) AS x(node)),
ends AS (SELECT node, max(idx) AS last FROM follower_logs GROUP BY node),
requests AS (SELECT s.node, t AS leader_term, last - CASE s.node WHEN 3 THEN 100 WHEN 4 THEN 300 ELSE 0 END AS prev, n - 120 AS leader_commit, s.term AS own_term, last FROM states s JOIN ends USING (node), top),
sent AS (SELECT r.node, l.idx, l.term FROM requests r JOIN leader_log l ON l.idx > prev AND l.idx <= prev + 400),
judged AS (SELECT r.*, leader_term < own_term AS stale, coalesce(f.term = l.term, false) AS holds FROM requests r LEFT JOIN follower_logs f ON f.node = r.node AND f.idx = prev LEFT JOIN leader_log l ON l.idx = prev),
good AS (SELECT node FROM judged WHERE NOT stale AND holds),
cuts AS (SELECT node, min(f.idx) AS cut FROM follower_logs f JOIN sent s USING (node, idx) WHERE f.term <> s.term GROUP BY node),
merged AS (SELECT node, idx, CASE WHEN cut IS NULL OR idx < cut THEN coalesce(f.term, s.term) ELSE s.term END AS term
  FROM (SELECT * FROM follower_logs WHERE node IN (FROM good)) f FULL JOIN (SELECT * FROM sent WHERE node IN (FROM good)) s USING (node, idx) LEFT JOIN cuts USING (node)),
logs_after AS (SELECT * FROM merged WHERE term IS NOT NULL UNION ALL SELECT node, idx, term FROM follower_logs WHERE node NOT IN (FROM good))"""


def _messages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Node 1 gets what follows its log, node 2 hears from an older term, nodes 3 and 4 hold entries of another term."""
    lead, logs = views.leader_log(spark, sf_dir), views.follower_logs(spark, sf_dir)
    top = lead.agg(F.max("idx").alias("n"), F.max("term").alias("t")).first()
    node = F.col("node")
    ends = logs.groupBy("node").agg(F.max("idx").alias("last"))
    states = ends.select("node", F.when(node == 2, top.t + 5).otherwise(top.t - 1).alias("term"), F.lit(10).cast("long").alias("commit_idx"), F.lit(0).alias("base_idx"), F.lit(0).alias("base_term"))
    prev = F.col("last") - F.when(node == 3, 100).when(node == 4, 300).otherwise(0)
    heads = ends.select("node", F.lit(top.t).alias("term"), prev.alias("prev_idx"), F.lit(top.n - 120).alias("leader_commit"))
    requests = F.broadcast(heads).join(lead.select(F.col("idx").alias("prev_idx"), F.col("term").alias("prev_term")), "prev_idx")
    # a message has 400 entries at most
    sent = F.broadcast(heads.select("node", F.explode(F.sequence(F.col("prev_idx") + 1, F.least(F.col("prev_idx") + 400, F.lit(top.n)))).alias("idx"))).join(lead.select("idx", "term"), "idx")
    return replication.append_entries(states, logs, requests, sent)


@query(
    f"""{MESSAGES} SELECT node, NOT stale AND holds AS success, greatest(own_term, leader_term) AS term,
  CASE WHEN NOT stale AND holds THEN prev + (SELECT count(*) FROM sent s WHERE s.node = j.node) END AS match_idx, CASE WHEN NOT stale AND NOT holds THEN last + 1 END AS hint,
  CASE WHEN NOT stale AND holds THEN greatest(10, least(leader_commit, (SELECT max(idx) FROM logs_after a WHERE a.node = j.node))) ELSE 10 END AS commit_idx FROM judged j""",
    views.LEADER, views.FOLLOWERS,
)
def raft_append_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir)[0]


@query(f"{MESSAGES} SELECT node, idx, term FROM logs_after", views.LEADER, views.FOLLOWERS)
def raft_append_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir)[1]


@query(
    """, top AS (SELECT max(idx) AS n, max(term) AS t FROM leader_log),
offers AS (SELECT node, count(*) AS n_log, CASE WHEN node = 2 THEN t + 5 ELSE t - 1 END AS own_term, CASE WHEN node = 1 THEN n // 2 + 7 ELSE n // 4 END AS own_applied, t AS leader_term, n // 2 AS snap_idx,
  (SELECT term FROM leader_log WHERE idx = n // 2) AS snap_term FROM follower_logs, top GROUP BY node, n, t),
j AS (SELECT *, leader_term >= own_term AND snap_idx > own_applied AS takes FROM offers)
SELECT node, greatest(own_term, leader_term) AS term, CASE WHEN takes THEN snap_idx ELSE 0 END AS base_idx, CASE WHEN takes THEN snap_term ELSE 0 END AS base_term,
  CASE WHEN takes THEN snap_idx ELSE own_applied END AS commit_idx, leader_term >= own_term AS success, CASE WHEN takes THEN 0 ELSE n_log END AS n_left FROM j""".lstrip(),
    views.LEADER, views.FOLLOWERS,
)
def raft_install_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead, logs = views.leader_log(spark, sf_dir), views.follower_logs(spark, sf_dir)
    top = lead.agg(F.max("idx").alias("n"), F.max("term").alias("t")).first()
    at = lead.where(F.col("idx") == top.n // 2).select(F.col("idx").alias("snap_idx"), F.col("term").alias("snap_term"))
    node = F.col("node")
    offers = logs.select("node").distinct().select(
        "node", F.when(node == 2, top.t + 5).otherwise(top.t - 1).alias("own_term"), F.when(node == 1, top.n // 2 + 7).otherwise(top.n // 4).alias("own_applied"), F.lit(top.t).alias("leader_term")
    )
    return replication.installed_snapshot(logs, offers.join(F.broadcast(at), F.lit(True)))  # one row


CHANGES = """changes AS (SELECT event_id AS seq, event_type <> 'click' AS leads, user_id % 5 < 3 AS member, event_id - user_id % 40 AS match_idx, event_id - 20 AS target,
  event_id % 3 > 0 AS gate_open, user_id % 5 = 0 AS own, event_id % 9 = 0 AS under_way, event_id - 5 AS last_idx FROM events)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, u = F.col("event_id"), F.col("user_id")
    return views.table(spark, sf_dir, "events").select(
        n.alias("seq"), (F.col("event_type") != "click").alias("leads"), (u % 5 < 3).alias("member"), (n - u % 40).alias("match_idx"), (n - 20).alias("target"), (n % 3 > 0).alias("gate_open"),
        (u % 5 == 0).alias("own"), (n % 9 == 0).alias("under_way"), (n - 5).alias("last_idx"),
    )


@query(
    "SELECT seq, CASE WHEN NOT leads THEN 'not leader' WHEN member THEN 'already a voter' WHEN match_idx < target THEN 'catching up' WHEN NOT gate_open THEN 'change in progress' ELSE 'proposed' END AS outcome FROM changes",
    CHANGES,
)
def raft_add_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("seq", replication.add_outcome(*map(F.col, ("leads", "member", "match_idx", "target", "gate_open"))).alias("outcome"))


@query(
    """SELECT seq, CASE WHEN NOT leads THEN 'not leader' WHEN own THEN 'already leader' WHEN under_way THEN 'not leader' WHEN NOT member THEN 'not a voter' WHEN match_idx < last_idx THEN 'catching up'
  ELSE 'campaign now' END AS outcome FROM changes""",
    CHANGES,
)
def raft_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("seq", replication.transfer_outcome(*map(F.col, ("leads", "own", "under_way", "member", "match_idx", "last_idx"))).alias("outcome"))


@query(
    """, b AS (SELECT seq, voter AS node, term FROM vote_requests WHERE role = 'leader'),
n AS (SELECT b.seq, 1 + count(DISTINCT r.voter) AS n_acks FROM b LEFT JOIN vote_requests r ON r.term = b.term AND r.seq > b.seq AND r.voter <> b.node GROUP BY b.seq)
SELECT seq, node, term, n_acks, CASE WHEN n_acks >= 3 THEN 'served' ELSE 'not leader' END AS outcome FROM b JOIN n USING (seq)""".lstrip(),
    views.REQUESTS,
)
def raft_read_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases ask for a barrier; all later messages of the term acknowledge it."""
    r = views.vote_requests(spark, sf_dir).withColumnRenamed("voter", "node")
    return replication.read_barriers(r.where("role = 'leader'").select("seq", "node", "term"), r.select("seq", "node", "term"), 5)


# Byte formats of a replicated log

def _le(x: str, width: int) -> str:
    """SQL of a number's little-endian bytes as hex."""
    pairs = " || ".join(f"substring(h, {2 * i + 1}, 2)" for i in range(width - 1, -1, -1))
    return f"(SELECT {pairs} FROM (SELECT printf('%0{2 * width}X', ({x})::BIGINT) AS h))"


@query(
    f"""SELECT idx, {_le('3 + event_id % 3', 4)} || {_le('0', 8)} || {_le('1', 8)} || {_le('2', 8)} || CASE WHEN event_id % 3 > 0 THEN {_le('3', 8)} ELSE '' END || CASE WHEN event_id % 3 > 1 THEN {_le('4', 8)} ELSE '' END AS coded,
  '0,1,2' || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN ',3' ELSE ',3,4' END AS back, CASE event_id % 3 WHEN 0 THEN '0,1' WHEN 1 THEN '0,1,2' ELSE '0,1,2,3' END AS torn FROM leader_log WHERE kind = 1""",
    views.LEADER,
)
def config_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations as bytes, decoded again, and decoded without their last byte."""
    raw = views.leader_log(spark, sf_dir).where("kind = 1").select("idx", codec.configuration(F.reverse(F.col("members")).cast("array<bigint>")).alias("raw"))
    torn = F.substring(F.col("raw"), F.lit(1), F.octet_length("raw") - 1)
    return raw.select("idx", F.hex("raw").alias("coded"), F.array_join(codec.configuration_members(F.col("raw")), ",").alias("back"), F.array_join(codec.configuration_members(torn), ",").alias("torn"))


@query(f"SELECT event_id, {_le('event_id * 1000003', 8)} || {_le('user_id % 6 - 1', 8)} AS coded, event_id * 1000003 AS term, user_id % 6 - 1 AS voted_for, false AS torn FROM events")
def hard_state_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    raw = e.select("event_id", codec.hard_state(F.col("event_id") * 1000003, F.col("user_id") % 6 - 1).alias("raw"))
    back, torn = codec.read_hard_state(F.col("raw")), codec.read_hard_state(F.substring("raw", 1, 15))
    return raw.select("event_id", F.hex("raw").alias("coded"), back["term"].alias("term"), back["voted_for"].alias("voted_for"), torn["present"].alias("torn"))


@query(
    """SELECT user_id AS log, 100 AS base_idx, 7 AS base_term, 99 + row_number() OVER (PARTITION BY user_id ORDER BY event_id) + 1 AS idx, event_id // 50 AS term, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS kind, event_type AS data
FROM events QUALIFY user_id % 2 = 0 OR event_id < max(event_id) OVER (PARTITION BY user_id)"""
)
def raft_log_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as one log file, read again; files of odd users have lost their last byte."""
    e = views.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", 1).otherwise(0)
    frame = codec.log_frame(F.floor(F.col("event_id") / 50).cast("long"), kind, F.col("event_type").cast("binary"))
    frames = e.groupBy(F.col("user_id").alias("log")).agg(F.array_sort(F.collect_list(F.struct("event_id", F.hex(frame).alias("frame")))).alias("frames"))
    body = F.unhex(F.array_join(F.transform("frames", lambda f: f["frame"]), ""))
    whole = F.concat(codec.log_header(F.lit(100), F.lit(7)), body)
    files = frames.select("log", whole.alias("whole")).select("log", F.when(F.col("log") % 2 == 0, F.col("whole")).otherwise(F.substring(F.col("whole"), F.lit(1), F.octet_length("whole") - 1)).alias("data"))
    return codec.decoded_logs(files).withColumn("data", F.col("data").cast("string"))


@query(
    """SELECT * FROM (
WITH RECURSIVE numbered AS (SELECT user_id % 8 AS segment, event_id AS key, 21 + length(event_type) + length(coalesce(props, '')) AS length, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS rn FROM events),
it AS (
  SELECT segment, rn, key, 0::BIGINT AS block, 0::BIGINT AS "offset", length AS size FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.segment, n.rn, n.key, CASE WHEN i.size >= 4096 THEN i.block + 1 ELSE i.block END, CASE WHEN i.size >= 4096 THEN i."offset" + i.size ELSE i."offset" END, CASE WHEN i.size >= 4096 THEN n.length ELSE i.size + n.length END
  FROM it i JOIN numbered n ON n.segment = i.segment AND n.rn = i.rn + 1)
SELECT segment, block, count(*) AS n_records, min("offset") AS "offset", max(size) AS size, min(key) AS first_key FROM it GROUP BY segment, block)"""
)
def sstable_sparse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of eight segments, of the lengths they would be written with."""
    e = views.table(spark, sf_dir, "events")
    length = F.lit(21) + F.length("event_type") + F.length(F.coalesce("props", F.lit("")))
    return compaction.sparse_index(e.select((F.col("user_id") % 8).alias("segment"), F.col("event_id").alias("pos"), F.col("event_id").alias("key"), length.cast("long").alias("length")))


# Overlapping histories


@query(
    """, zones AS (SELECT key, value, min(CASE WHEN value IS NULL THEN -9e18 ELSE ret END) AS f, max(call) AS s, bool_or(kind = 'put') OR value IS NULL AS written,
    coalesce(min(CASE WHEN kind = 'get' THEN ret END) < min(CASE WHEN kind = 'put' THEN call END), false) AS early FROM overlapping GROUP BY key, value),
crossed AS (SELECT DISTINCT a.key FROM zones a JOIN zones b ON a.key = b.key AND a.value IS DISTINCT FROM b.value WHERE a.f < b.s AND b.f < a.s)
SELECT key, CASE WHEN bool_or(NOT written OR early) OR key IN (FROM crossed) THEN 'violation' ELSE 'ok' END AS verdict, (SELECT count(*) FROM overlapping o WHERE o.key = zones.key) AS n_ops FROM zones GROUP BY key""".lstrip(),
    views.OVERLAPPING,
)
def lincheck_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL decides by zones: every value is put once, and a history of such puts is a register's iff no read ends
    before its put begins and no two values' operations come before each other."""
    return checker.check(views.overlapping(spark, sf_dir))


for _name, _sql in list(ORACLE.items()):  # a query's own expressions follow the shared ones
    if _sql.startswith("WITH"):
        ORACLE[_name] = _sql.replace(") , ", "), ", 1)
