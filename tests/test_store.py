"""Scenarios of a versioned store: reads, collection, logs, transactions, sessions, segments."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.model import InvalidOp, KeyNotFound
from tidemark.operators import compaction, log, prefix, sessions, snapshot, transactions
from tidemark.sources.segments import SegmentStore

V = "key string, ts bigint, op int, value string"


def versions(spark, *rows):
    """k@ts=value, or k@ts with None for a delete."""
    return spark.createDataFrame([(k, t, 2 if v is None else 1, v) for k, t, v in rows], V)


def live(df):
    return {r.key: r.value for r in df.collect()}


def test_snapshot_reads(spark):
    v = versions(spark, ("k", 1, "v1"), ("k", 2, "v2"), ("d", 1, "v"), ("d", 2, None), ("e", 3, ""))
    assert live(snapshot.scan(v, 0)) == {}
    assert live(snapshot.scan(v, 1)) == {"k": "v1", "d": "v"}
    assert live(snapshot.scan(v, 2)) == {"k": "v2"}
    assert live(snapshot.scan(v)) == {"k": "v2", "e": ""}
    assert snapshot.get_value(v, "k", 1) == "v1"
    with pytest.raises(KeyNotFound):
        snapshot.get_value(v, "d")
    assert {r.key: r.state for r in snapshot.tristate(v).collect()} == {"k": "value", "d": "deleted", "e": "value"}


def test_bounds_and_prefix_keys(spark):
    v = versions(spark, *[(k, i + 1, k) for i, k in enumerate(["a", "b", "c", "d", "e"])])
    assert sorted(live(snapshot.scan(v, None, "b", "d"))) == ["b", "c"]
    assert sorted(live(snapshot.scan(v, None, "d"))) == ["d", "e"]
    assert sorted(live(snapshot.scan(v, None, None, "c"))) == ["a", "b"]
    # a key that is a prefix of another sorts before it, whatever the ts
    w = versions(spark, ("a", 1, "x"), ("ab", 2, "y"))
    assert live(snapshot.scan(w, None, None, "ab")) == {"a": "x"}
    assert {r.key: r.newest_ts for r in snapshot.newest_ts(w).collect()} == {"a": 1, "ab": 2}
    assert snapshot.seek(w, "aa").first().key == "ab" and snapshot.seek(w, "b").first() is None


def test_merge_prefers_newer_layers(spark):
    old, new = versions(spark, ("k", 1, "old"), ("a", 2, "a")), versions(spark, ("k", 1, "new"))
    assert {(r.key, r.ts): r.value for r in snapshot.merged(new, old).collect()} == {("k", 1): "new", ("a", 2): "a"}


# Own values for the cases of version collection.
@pytest.mark.parametrize("rows, low, bottom, kept", [
    ([("a", 31, None), ("a", 12, "x")], 50, False, 2),
    ([("a", 31, None), ("a", 12, "x")], 50, True, 0),
    ([("a", 31, "y"), ("a", 12, "x")], 50, False, 2),
    ([("a", 31, "y"), ("a", 12, "x")], 50, True, 1),
    ([("a", 31, None), ("a", 12, "x")], 20, True, 2),
    ([("a", 31, None), ("a", 12, "x"), ("a", 4, None)], 12, True, 2),
])
def test_collection(spark, rows, low, bottom, kept):
    assert compaction.collected(versions(spark, *rows), low, bottom).count() == kept


def test_collection_preserves_reads(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abcde"), t, None if rng.random() < 0.3 else str(t)) for t in range(1, 80)]
    v = versions(spark, *rows)
    for low in (0, 20, 50, 79):
        left = compaction.collected(v, low, True)
        for s in (low, low + 7, 79):
            assert live(snapshot.scan(left, max(s, low))) == live(snapshot.scan(v, max(s, low)))


def test_log(spark):
    schema = "offset bigint, op int, ts bigint, key string, value string, status string"
    rows = [(0, 1, 5, "orphan", "x", "ok"), (1, 1, 6, "a", "1", "ok"), (2, 3, 6, None, None, "ok"), (3, 2, 7, "b", None, "ok"), (4, 1, 8, "c", "z", "torn"), (5, 3, 8, None, None, "ok")]
    kept = log.truncated_tail(spark.createDataFrame(rows, schema))
    assert kept.count() == 4
    done, lost = log.replayed(kept)
    assert [r.key for r in done.collect()] == ["a"] and {r.key for r in lost.collect()} == {"orphan", "b"}
    with pytest.raises(InvalidOp):
        log.truncated_tail(spark.createDataFrame([(0, 9, 1, "k", "v", "invalid_op"), *rows[1:]], schema))
    segments = spark.createDataFrame([(9, 3)], "max_ts bigint, applied_index bigint")
    assert log.next_ts(kept, segments).first()[0] == 10
    assert log.applied_index(kept, segments, 2).first()[0] == 3


@pytest.mark.parametrize("how", ["sum", "max"])
def test_running(spark, how):
    rng = random.Random(1)
    values = [rng.randrange(-5, 9) if rng.random() < 0.7 else None for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "i bigint, v bigint")
    got = {r.i: r.x for r in prefix.running(df, "i", F.col("v"), "x", how, block=16).collect()}
    for i in range(300):
        before = [v for v in values[:i] if v is not None]
        assert got[i] == (sum(before) if how == "sum" else max(before, default=None))


def test_first_committer_wins(spark):
    rng = random.Random(7)
    rows = [(i, rng.randrange(6), i + 1, max(0, i - rng.randrange(30))) for i in range(300)]
    got = {r.txn: r.committed for r in transactions.first_committer_wins(spark.createDataFrame(rows, "txn bigint, key bigint, ts bigint, read_snap bigint")).collect()}
    newest = {}
    for txn, key, ts, snap in rows:
        won = newest.get(key, 0) <= snap
        assert got[txn] == won
        if won:
            newest[key] = ts


def test_sessions(spark):
    rng = random.Random(9)
    rows = [(i, rng.randrange(4), rng.randrange(30)) for i in range(200)]
    got = {r.idx: r.applied for r in sessions.deduplicated(spark.createDataFrame(rows, "idx bigint, session bigint, seq bigint")).collect()}
    last = {}
    for idx, session, seq in rows:
        assert got[idx] == (seq > last.get(session, 0))
        last[session] = max(last.get(session, 0), seq)


def test_transaction_view_and_commit(spark):
    v = versions(spark, ("a", 1, "1"), ("b", 2, "2"))
    own = spark.createDataFrame([("a", 2, None), ("c", 1, "3")], "key string, op int, value string")
    assert live(transactions.read_your_writes(v, own, 2)) == {"b": "2", "c": "3"}
    txns = spark.createDataFrame([(1, 2, 10), (2, 1, 11), (3, 2, 12)], "txn bigint, read_snap bigint, commit_order bigint")
    writes = spark.createDataFrame([(1, "x", 1, "v"), (1, "y", 1, "v"), (2, "b", 1, "late")], "txn bigint, key string, op int, value string")
    rows = transactions.commit(txns, writes, v).collect()
    assert {(r.ts, r.op, r.key) for r in rows} == {(3, 1, "x"), (3, 1, "y"), (3, 3, None)}


def test_segments(spark, tmp_path):
    store = SegmentStore(spark, f"file://{tmp_path}/store")
    assert store.read().count() == 0
    for i, value in enumerate(["v1", "x1", "x2", "x3"]):
        store.flush(versions(spark, ("k", i + 1, value), (f"own{i}", i + 1, None if i == 2 else "y")), i)
    before = live(snapshot.scan(store.read()))
    assert store.compact(4) == [1, 2, 3, 4] and [e["id"] for e in store.manifest()] == [4]
    assert store.manifest()[0]["applied_index"] == 3
    assert live(snapshot.scan(SegmentStore(spark, f"file://{tmp_path}/store").read())) == before
    assert store.read().where("key = 'own2'").count() == 0
    store.replace(versions(spark, ("z", 9, "only")), 9)
    assert live(snapshot.scan(store.read())) == {"z": "only"}
    assert store.sessions().count() == 0 and store.members() is None
    store.replace(versions(spark, ("z", 9, "only")), 10, spark.createDataFrame([(4, 17)], "session bigint, last_seq bigint"), [0, 2, 5])
    for i in range(3):
        store.flush(versions(spark, (f"more{i}", 10 + i, "v")), 11 + i)
    assert store.compact(20) and len(store.manifest()) == 1
    assert [tuple(r) for r in store.sessions().collect()] == [(4, 17)] and store.members() == [0, 2, 5]


def test_order_check(spark):
    rows = spark.createDataFrame([(0, "a", 2), (1, "a", 1), (2, "a", 1), (3, "b", 5), (4, "ab", 9)], "pos bigint, key string, ts bigint")
    assert {(r.pos, r.problem) for r in compaction.order_violations(rows).collect()} == {(2, "duplicate"), (4, "out of order")}


def fold(txns, writes):
    """Transactions (txn, ts, read_snap) one after the other."""
    newest, out = {}, {}
    for txn, ts, snap in sorted(txns, key=lambda t: t[1]):
        out[txn] = all(newest.get(k, -1) <= snap for k in writes[txn])
        if out[txn]:
            newest |= dict.fromkeys(writes[txn], ts)
    return out


def test_first_committer_wins_over_several_keys(spark):
    rng = random.Random(3)
    txns = [(i, i + 1, max(0, i - rng.randrange(25))) for i in range(250)]
    writes = {i: rng.sample(range(12), rng.randrange(1, 4)) for i, _, _ in txns}
    rows = [(t, k) for t, own in writes.items() for k in own]
    got = transactions.first_committer_wins_all(spark.createDataFrame(txns, "txn bigint, ts bigint, read_snap bigint"), spark.createDataFrame(rows, "txn bigint, key bigint"))
    assert {r.txn: r.committed for r in got.collect()} == fold(txns, writes)


def test_rounds_take_what_is_undecided(spark, monkeypatch):
    """A chain of 12 transactions that wait for each other, beside 200 that wait for nobody and are decided at once."""
    txns = [(i, i + 1, 0) for i in range(12)] + [(i, i + 1, 0) for i in range(100, 300)]
    rows = [(i, k) for i in range(12) for k in (i, i + 1)] + [(i, i) for i in range(100, 300)]
    staged, sizes = transactions.staged, []

    def counted(df, name):
        sizes.append((out := staged(df, name)).count())
        return out

    monkeypatch.setattr(transactions, "staged", counted)
    got = transactions.first_committer_wins_all(spark.createDataFrame(txns, "txn bigint, ts bigint, read_snap bigint"), spark.createDataFrame(rows, "txn bigint, key bigint"))
    assert {r.txn: r.committed for r in got.collect()} == {i: i >= 100 or i % 2 == 0 for i, _, _ in txns}
    assert sum(sizes) <= 2 * len(rows)


def test_commit_reads_what_it_decided_once(spark, monkeypatch):
    """The winners are staged, so neither numbering nor both kinds of records decide anew."""
    staged, names = transactions.staged, []
    monkeypatch.setattr(transactions, "staged", lambda df, name: (names.append(name), staged(df, name))[1])
    txns = spark.createDataFrame([(i, 0, i) for i in range(6)], "txn bigint, read_snap bigint, commit_order bigint")
    writes = spark.createDataFrame([(i, f"k{i // 2}", 1, "v") for i in range(6)], "txn bigint, key string, op int, value string")
    rows = transactions.commit(txns, writes, versions(spark, ("z", 4, "old")))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.ts, r.op, r.key) for r in rows.collect() if r.key) == [(5, 1, "k0"), (6, 1, "k1"), (7, 1, "k2")]
    assert {"standing", "winners"} <= set(names) and "lost" not in plan


def test_transactions_of_a_batch_conflict_with_each_other(spark):
    log = versions(spark, ("z", 4, "old"))
    txns = spark.createDataFrame([(1, 4, 1), (2, 4, 2), (3, 4, 3), (4, 2, 4), (5, 4, 5)], "txn bigint, read_snap bigint, commit_order bigint")
    writes = [(1, "a", 1, "1"), (2, "a", 1, "2"), (2, "b", 1, "2"), (3, "b", 1, "3"), (3, "c", 2, None), (4, "z", 1, "4")]
    rows = transactions.commit(txns, spark.createDataFrame(writes, "txn bigint, key string, op int, value string"), log).collect()
    # 2 loses key a to 1, so 3 wins key b; 4 read before z's newest version; 5 writes nothing
    assert {(r.ts, r.op, r.key, r.value) for r in rows} == {(5, 1, "a", "1"), (5, 3, None, None), (6, 1, "b", "3"), (6, 2, "c", None), (6, 3, None, None)}


def test_refused_entries_touch_nothing(spark):
    schema = "idx bigint, session bigint, seq bigint, n_ops bigint, ends_in_commit boolean, n_ts int, n_bad_ops int"
    rows = [(1, 7, 10, 0, True, 1, 0), (2, 7, 10, 2, True, 1, 0), (3, 7, 10, 2, True, 1, 0), (4, None, None, 1, True, 1, 0), (5, 7, 12, 2, False, 1, 0), (6, 7, 11, 2, True, 1, 0), (7, 8, 1, 2, True, 2, 0)]
    got = transactions.apply_entries(spark.createDataFrame(rows, schema))
    assert {r.idx: r.reason for r in got.collect()} == {1: "empty", 2: "ok", 3: "duplicate", 4: "ok", 5: "no commit", 6: "ok", 7: "two timestamps"}
    assert transactions.applied_through(got).first()[0] == 6


def test_prepare(spark):
    log = versions(spark, ("a", 3, "x"), ("b", 9, "y"))
    txns = spark.createDataFrame([(1, 9, 1, 5, 4), (2, 3, 2, None, None), (3, 9, 3, 5, 5), (4, 9, 4, None, None), (5, 9, 5, None, None)], "txn bigint, read_snap bigint, commit_order bigint, session bigint, seq bigint")
    writes = spark.createDataFrame([(1, "a", 1, "v"), (2, "b", 1, "v"), (3, "a", 1, "v"), (5, "a", 1, "w")], "txn bigint, key string, op int, value string")
    got = transactions.prepared(txns, writes, log, spark.createDataFrame([(5, 4)], "session bigint, last_seq bigint"))
    assert {r.txn: (r.status, r.ts) for r in got.collect()} == {1: ("duplicate", None), 2: ("conflict", None), 3: ("prepared", 10), 4: ("empty", None), 5: ("prepared", 11)}
    records = {(r.txn, r.op, r.key, r.session, r.seq) for r in transactions.entry_records(got, writes, txns).collect()}
    assert records == {(3, 1, "a", None, None), (3, 3, None, 5, 5), (5, 1, "a", None, None), (5, 3, None, None, None)}
    assert tuple(transactions.control_marker(log, 8).first()) == (8, 3, 10)


def test_lifecycles(spark):
    rows = [(1, 1, "put"), (2, 1, "begin"), (3, 1, "put"), (4, 2, "begin"), (5, 1, "commit"), (6, 1, "put"), (7, 1, "rollback"), (8, 3, "commit"), (9, 3, "begin")]
    df = spark.createDataFrame(rows, "seq bigint, txn bigint, action string")
    assert {r.seq: r.outcome for r in transactions.lifecycles(df).collect()} == {1: "unknown", 2: "ok", 3: "ok", 4: "ok", 5: "ok", 6: "finished", 7: "finished", 8: "unknown", 9: "ok"}
    assert {(r.txn, r.begin_seq) for r in transactions.active(df, 9).collect()} == {(2, 4), (3, 9)}
    assert {(r.txn, r.begin_seq) for r in transactions.active(df, 4).collect()} == {(1, 2), (2, 4)}
