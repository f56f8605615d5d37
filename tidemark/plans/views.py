"""Derived views: each a DataFrame here and a common table expression of the same name in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import COMMIT, CONFIG, DATA, DELETE, PUT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions: key user_id, ts event_id + 1, errors are deletes."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), (F.col("event_id") + 1).alias("ts"), F.when(F.col("event_type") == "error", DELETE).otherwise(PUT).alias("op"), "value")


VERSIONS = "versions AS (SELECT user_id AS key, event_id + 1 AS ts, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op, value FROM events)"


def wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: purchases are markers; an event belongs to the marker that follows (ts), but every 97th is an orphan; every 4,999th record is corrupt."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("offset"),
        F.when(F.col("event_type") == "purchase", COMMIT).when(F.col("event_type") == "error", DELETE).otherwise(PUT).alias("op"),
        F.col("user_id").alias("key"),
        "value",
        F.when(F.col("event_id") % 4999 == 4998, "corrupt").otherwise("ok").alias("status"),
    )


WAL = "wal AS (SELECT event_id AS \"offset\", CASE WHEN event_type = 'purchase' THEN 3 WHEN event_type = 'error' THEN 2 ELSE 1 END AS op, user_id AS key, value, CASE WHEN event_id % 4999 = 4998 THEN 'corrupt' ELSE 'ok' END AS status FROM events)"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("idx"), F.floor("value").cast("long").alias("seq"))


SESSIONS = "sessions AS (SELECT user_id AS session, event_id AS idx, CAST(floor(value) AS BIGINT) AS seq FROM events)"


def txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    snap = F.greatest(F.lit(0), F.col("o_orderkey") - (F.col("o_orderkey") * 37) % 4001)
    return o.select(F.col("o_orderkey").alias("txn"), F.col("o_custkey").alias("key"), (F.col("o_orderkey") + 1).alias("ts"), snap.alias("read_snap"))


TXNS = "txns AS (SELECT o_orderkey AS txn, o_custkey AS key, o_orderkey + 1 AS ts, greatest(0, o_orderkey - (o_orderkey * 37) % 4001) AS read_snap FROM orders)"


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as writes of their order's transaction: key part, statement ((line, supplier) in one number), quantity as cents; rows that repeat are one."""
    x = table(spark, sf_dir, "lineitem")
    w = x.select(
        F.col("l_orderkey").alias("txn"),
        F.col("l_partkey").alias("key"),
        (F.col("l_linenumber").cast("long") * 1_000_000 + F.col("l_suppkey")).alias("stmt"),
        F.when(F.col("l_returnflag") == "R", DELETE).otherwise(PUT).alias("op"),
        F.floor(F.col("l_quantity")).cast("long").alias("value"),
    )
    # one exchange serves this aggregate and the write buffer's
    return w.repartition("txn", "key").groupBy("txn", "key", "stmt").agg(F.max("op").alias("op"), F.max("value").alias("value"))


WRITES = """writes AS (SELECT l_orderkey AS txn, l_partkey AS key, CAST(l_linenumber AS BIGINT) * 1000000 + l_suppkey AS stmt,
  max(CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END) AS op, max(CAST(floor(l_quantity) AS BIGINT)) AS value FROM lineitem GROUP BY ALL)"""


def leader_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    kind = F.when(F.col("event_type") == "signup", CONFIG).otherwise(DATA)
    return e.select((n + 1).alias("idx"), (1 + F.floor(n / 2000)).cast("long").alias("term"), kind.alias("kind"), F.when(kind == CONFIG, F.sequence(F.lit(0), (2 + n % 3).cast("int"))).alias("members"))


LEADER = "leader_log AS (SELECT event_id + 1 AS idx, 1 + event_id // 2000 AS term, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS kind, event_id FROM events)"


def follower_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes 1 to 4: node n holds idx <= N - 37 n; from node 3 on the last 200 entries are of another term."""
    lead = leader_log(spark, sf_dir)
    n = lead.agg(F.max("idx")).first()[0]
    rows = lead.select(F.explode(F.sequence(F.lit(1), F.lit(4))).alias("node"), "idx", "term").where(F.col("idx") <= n - 37 * F.col("node"))
    return rows.withColumn("term", F.when((F.col("node") >= 3) & (F.col("idx") > n - 37 * F.col("node") - 200), F.col("term") - 1).otherwise(F.col("term")))


FOLLOWERS = """follower_logs AS (SELECT CAST(node AS INTEGER) AS node, idx,
  CASE WHEN node >= 3 AND idx > (SELECT max(idx) FROM leader_log) - 37 * node - 200 THEN term - 1 ELSE term END AS term
  FROM leader_log, unnest(range(1, 5)) AS t(node) WHERE idx <= (SELECT max(idx) FROM leader_log) - 37 * node)"""


def vote_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    term = (1 + F.floor(F.col("event_id") / 50)).cast("long")
    return e.select(
        F.col("event_id").alias("seq"), (F.col("event_id") % 5).alias("voter"), (F.col("user_id") % 5).alias("candidate"), term.alias("term"), (term - 1).alias("last_term"), F.floor("value").cast("long").alias("last_idx"),
        (term - 1).alias("own_term"), F.lit(50).cast("long").alias("own_idx"), F.when(F.col("event_type") == "purchase", "leader").otherwise("follower").alias("role"),
    )


REQUESTS = """vote_requests AS (SELECT event_id AS seq, event_id % 5 AS voter, user_id % 5 AS candidate, 1 + event_id // 50 AS term, event_id // 50 AS last_term,
  CAST(floor(value) AS BIGINT) AS last_idx, event_id // 50 AS own_term, CAST(50 AS BIGINT) AS own_idx, CASE WHEN event_type = 'purchase' THEN 'leader' ELSE 'follower' END AS role FROM events)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequential history for each user: purchases read what the last write left, errors delete, others put.

    Every read of the users whose number ends in 3 from event 100 on returns a value that nobody wrote.
    """
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    is_get = F.col("event_type") == "purchase"
    kind = F.when(is_get, "get").when(F.col("event_type") == "error", "delete").otherwise("put")
    own = F.col("event_id").cast("string")
    last = F.last(F.when(~is_get, F.when(F.col("event_type") == "error", "").otherwise(own)), True).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    wrong = is_get & (F.col("user_id") % 10 == 3) & (F.col("event_id") >= 100)
    value = F.when(wrong, F.concat(F.lit("x"), own)).when(is_get, F.nullif(F.coalesce(F.col("last"), F.lit("")), F.lit(""))).when(kind == "put", own)
    rows = e.select(F.col("user_id").cast("string").alias("key"), "user_id", "event_id", "event_type", last.alias("last"))
    return rows.select("key", (F.col("event_id") % 4).alias("client"), kind.alias("kind"), value.alias("value"), (is_get & value.isNotNull()).alias("found"), (F.col("event_id") * 2).alias("call"), (F.col("event_id") * 2 + 1).alias("ret"))


HISTORY = """history AS (SELECT key, client, kind, value, kind = 'get' AND value IS NOT NULL AS found, call, ret FROM (
  SELECT CAST(user_id AS VARCHAR) AS key, event_id % 4 AS client, CASE event_type WHEN 'purchase' THEN 'get' WHEN 'error' THEN 'delete' ELSE 'put' END AS kind,
    CASE WHEN event_type = 'purchase' AND user_id % 10 = 3 AND event_id >= 100 THEN 'x' || event_id
         WHEN event_type = 'purchase' THEN nullif(coalesce(last_value(CASE event_type WHEN 'purchase' THEN NULL WHEN 'error' THEN '' ELSE CAST(event_id AS VARCHAR) END IGNORE NULLS)
           OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), '')
         WHEN event_type <> 'error' THEN CAST(event_id AS VARCHAR) END AS value,
    event_id * 2 AS call, event_id * 2 + 1 AS ret FROM events))"""


def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history of overlapping operations for each user: its k-th event takes effect at 1,000 k, inside its window;
    purchases and views read, others put their own number. Every fifth read of the users whose number ends in 7
    returns what was there four events before, which may or may not be explained by the overlaps."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    n, is_get = F.col("event_id"), F.col("event_type").isin("purchase", "view")
    by_user = Window.partitionBy("user_id").orderBy("event_id")
    put = F.when(~is_get, n)
    last, older = (F.max(put).over(by_user.rowsBetween(Window.unboundedPreceding, back)) for back in (-1, -4))
    seen = F.when((F.col("user_id") % 10 == 7) & (n % 5 == 0), older).otherwise(last)
    value = F.when(is_get, seen).otherwise(n).cast("string")
    at = 1000 * F.row_number().over(by_user).cast("long")
    return e.select(
        F.col("user_id").cast("string").alias("key"), (n % 4).alias("client"), F.when(is_get, "get").otherwise("put").alias("kind"), value.alias("value"),
        (is_get & value.isNotNull()).alias("found"), (at - n * 7919 % 1500).alias("call"), (at + n * 104729 % 1500 + 1).alias("ret"),
    )


OVERLAPPING = """overlapping AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, kind, CASE WHEN kind = 'put' THEN event_id WHEN user_id % 10 = 7 AND event_id % 5 = 0 THEN older ELSE last END AS value, call, ret FROM (
  SELECT user_id, event_id, CASE WHEN event_type IN ('purchase', 'view') THEN 'get' ELSE 'put' END AS kind,
    max(CASE WHEN event_type NOT IN ('purchase', 'view') THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last,
    max(CASE WHEN event_type NOT IN ('purchase', 'view') THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 4 PRECEDING) AS older,
    1000 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) - event_id * 7919 % 1500 AS call,
    1000 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) + event_id * 104729 % 1500 + 1 AS ret FROM events))"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps of transactions: a user's 7 transactions in turn; signups begin, purchases commit, errors roll back, others put."""
    e = table(spark, sf_dir, "events")
    t = F.col("event_type")
    kind = F.when(t == "signup", "begin").when(t == "purchase", "commit").when(t == "error", "rollback").otherwise("put")
    return e.select(F.col("event_id").alias("seq"), (F.col("user_id") * 7 + F.floor(F.col("event_id") / 997).cast("long") % 7).alias("txn"), kind.alias("action"))


ACTIONS = """actions AS (SELECT event_id AS seq, user_id * 7 + event_id // 997 % 7 AS txn,
  CASE event_type WHEN 'signup' THEN 'begin' WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'rollback' ELSE 'put' END AS action FROM events)"""
