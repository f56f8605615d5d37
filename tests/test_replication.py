from pyspark.sql import functions as F

from tidemark.operators import replication as R

LOG = "node int, idx bigint, term bigint"


def lead(spark, *terms):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(terms)], "idx bigint, term bigint")


def match(spark, *held):
    return spark.createDataFrame([(i, x) for i, x in enumerate(held)], "node int, match_idx bigint")


def test_commit_needs_an_entry_of_the_current_term(spark):
    assert R.commit_index(match(spark, 1, 1, 0), lead(spark, 1), 2, 0).first()[0] == 0
    assert R.commit_index(match(spark, 2, 2, 0), lead(spark, 1, 2), 2, 0).first()[0] == 2
    assert R.commit_index(match(spark, 2, 0, 0), lead(spark, 1, 2), 2, 1).first()[0] == 1


def test_log_comparison(spark):
    rows = [((1, 1), (2, 2), False), ((2, 2), (2, 2), True), ((2, 3), (2, 2), True), ((2, 1), (1, 9), True), ((1, 9), (2, 1), False)]
    df = spark.createDataFrame([(*a, *b, want) for a, b, want in rows], "t bigint, i bigint, ot bigint, oi bigint, want boolean")
    c = F.col
    assert all(r.got == r.want for r in df.select(R.up_to_date(c("t"), c("i"), c("ot"), c("oi")).alias("got"), "want").collect())


def test_append(spark):
    have = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 1, 1), (2, 2, 1), (2, 3, 1)], LOG)
    sent = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 1), (3, 1, 1)], LOG)
    got = sorted((r.node, r.idx, r.term) for r in R.appended(have, sent).collect())
    # node 1: conflict at 2, its suffix goes; node 2: no conflict, its longer log stays; node 3: all are new
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 1), (2, 3, 1), (3, 1, 1)]


def test_votes_and_winner(spark):
    schema = "seq bigint, voter int, candidate int, term bigint, eligible boolean"
    rows = [(1, 0, 7, 1, False), (2, 0, 8, 1, True), (3, 0, 7, 1, True), (4, 0, 8, 1, True), (5, 1, 8, 1, True), (6, 2, 7, 1, True), (7, 0, 7, 2, True)]
    got = R.votes(spark.createDataFrame(rows, schema))
    assert {r.seq for r in got.where("granted").collect()} == {2, 4, 5, 6, 7}
    assert [(r.term, r.winner, r.n_votes) for r in R.winners(got, 3).collect()] == [(1, 8, 2)]


def test_membership_and_gate(spark):
    schema = "seq bigint, server bigint, action string"
    rows = [(1, 1, "add"), (2, 2, "add"), (3, 2, "add"), (4, 1, "remove"), (5, 1, "remove")]
    assert R.members(spark.createDataFrame(rows, schema)).first()[0] == [2]
    assert R.members(spark.createDataFrame([*rows, (6, 2, "remove")], schema)).first()[0] == [2]
    log = spark.createDataFrame([(1, 0, None), (2, 1, [0, 1]), (3, 0, None), (4, 1, [0])], "idx bigint, kind int, members array<int>")
    assert {(r.idx, r.config_idx, tuple(r.members)) for r in R.config_as_of(log, [9]).collect()} == {(1, 0, (9,)), (2, 2, (0, 1)), (3, 2, (0, 1)), (4, 4, (0,))}
    commits = spark.createDataFrame([(3,), (4,)], "commit bigint")
    assert {(r.commit, r.gate_open) for r in R.config_gate(log, commits).collect()} == {(3, False), (4, True)}


def test_restart_and_prev(spark):
    states = spark.createDataFrame([(0, 5, 2), (1, 1, 2), (2, 3, 1)], "node int, term bigint, voted_for int")
    log = spark.createDataFrame([(0, 1, 4), (1, 1, 4)], LOG)
    assert {(r.node, r.term, r.voted_for) for r in R.restart_state(states, log).collect()} == {(0, 5, 2), (1, 4, -1), (2, 3, 1)}
    asked = spark.createDataFrame([(0, 1, 4), (0, 1, 3), (0, 2, 4), (1, 0, 0)], "node int, prev_idx bigint, prev_term bigint")
    assert sorted((r.node, r.prev_idx, r.prev_term, r.ok) for r in R.matches_prev(asked, log).collect()) == [(0, 1, 3, False), (0, 1, 4, True), (0, 2, 4, False), (1, 0, 0, True)]


def test_vote_cases(spark):
    schema = "seq bigint, voter int, candidate int, term bigint, eligible boolean, in_contact boolean, transfer boolean, start_term bigint, start_vote int"
    rows = [
        (1, 0, 7, 5, True, True, False, 3, 9),  # ignored: the voter has a leader, so term 5 is not adopted
        (2, 0, 8, 3, True, False, False, 3, 9),  # it voted for 9 in term 3 before
        (3, 0, 9, 3, True, False, False, 3, 9),
        (4, 0, 7, 4, False, False, False, 3, 9),  # an old log: the term is adopted, the vote is not given
        (5, 0, 8, 3, True, False, False, 3, 9),  # a stale term
        (6, 0, 8, 4, True, True, True, 3, 9),  # a transfer is heard in spite of a leader
        (7, 0, 7, 4, True, False, False, 3, 9),
        (8, 0, 8, 4, True, False, False, 3, 9),
    ]
    got = {r.seq: (r.granted, r.reply_term) for r in R.votes(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (False, 3), 2: (False, 3), 3: (True, 3), 4: (False, 4), 5: (False, 4), 6: (True, 4), 7: (False, 4), 8: (True, 4)}


def test_messages(spark):
    states = spark.createDataFrame([(1, 5, 0, 0, 0), (2, 2, 1, 0, 0), (3, 2, 1, 2, 1), (4, 2, 0, 0, 0)], "node int, term bigint, commit_idx bigint, base_idx bigint, base_term bigint")
    logs = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (2, 2, 1), (2, 3, 1), (3, 3, 1), (4, 1, 1)], LOG)
    requests = spark.createDataFrame([(1, 3, 1, 1, 9), (2, 3, 1, 1, 2), (3, 3, 1, 1, 99), (4, 3, 3, 2, 9)], "node int, term bigint, prev_idx bigint, prev_term bigint, leader_commit bigint")
    entries = spark.createDataFrame([(1, 2, 3), (2, 2, 3), (3, 2, 1), (3, 3, 1), (3, 4, 3), (4, 4, 3)], LOG)
    answers, after = R.append_entries(states, logs, requests, entries)
    assert {r.node: tuple(r)[1:] for r in answers.collect()} == {1: (False, 5, None, None, 0), 2: (True, 3, 2, None, 2), 3: (True, 3, 4, None, 4), 4: (False, 3, None, 2, 0)}
    assert sorted((r.node, r.idx, r.term) for r in after.collect()) == [(1, 1, 1), (2, 1, 1), (2, 2, 3), (3, 3, 1), (3, 4, 3), (4, 1, 1)]


def test_snapshot_offers(spark):
    offers = spark.createDataFrame([(1, 2, 5, 3, 9, 2), (2, 4, 5, 3, 9, 2), (3, 2, 9, 3, 9, 2)], "node int, own_term bigint, own_applied bigint, leader_term bigint, snap_idx bigint, snap_term bigint")
    logs = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 1), (3, 2, 1)], LOG)
    got = {r.node: tuple(r)[1:] for r in R.installed_snapshot(logs, offers).collect()}
    assert got == {1: (3, 9, 2, 9, True, 0), 2: (4, 0, 0, 5, False, 1), 3: (3, 0, 0, 9, True, 2)}


def test_barriers(spark):
    asked = spark.createDataFrame([(5, 1, 2), (9, 1, 2), (1, 3, 7)], "seq bigint, node int, term bigint")
    acks = spark.createDataFrame([(6, 2, 2), (7, 1, 2), (10, 3, 2), (4, 4, 2)], "seq bigint, node int, term bigint")
    got = {r.seq: (r.n_acks, r.outcome) for r in R.read_barriers(asked, acks, 5).collect()}
    assert got == {5: (3, "served"), 9: (2, "not leader"), 1: (1, "not leader")}


def test_logs_are_not_dealt_by_node_alone(spark):
    """A log may be as long as the input: its rows meet others by (node, idx) or stay where they are."""
    import re

    states = spark.createDataFrame([(n, 1, 0, 0, 0) for n in (1, 2)], "node int, term bigint, commit_idx bigint, base_idx int, base_term int")
    log = spark.createDataFrame([(n, i, 1) for n in (1, 2) for i in range(1, 40)], LOG)
    requests = spark.createDataFrame([(n, 2, 30, 1, 35) for n in (1, 2)], "node int, term bigint, prev_idx bigint, prev_term bigint, leader_commit bigint")
    sent = spark.createDataFrame([(n, i, 2) for n in (1, 2) for i in range(31, 36)], LOG)
    _, after = R.append_entries(states, log, requests, sent)
    held, kind = {}, "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(kind)
    try:
        spark.conf.set(kind, "1g")
        wide = after._jdf.queryExecution().sparkPlan().toString()
        spark.conf.set(kind, "-1")
        _, after = R.append_entries(states, log, requests, sent)
        plan = after._jdf.queryExecution().sparkPlan().toString()
        for r in after.collect():
            held.setdefault(r.node, []).append((r.idx, r.term))
    finally:
        spark.conf.set(kind, old)
    # only what is known of a node, and so is small, may be joined by node alone
    assert len(re.findall(r"SortMergeJoin \[node#\d+, idx#\d+L\]", wide)) == 2  # nor is a log sent whole, however small it looks
    assert not re.search(r"SortMergeJoin \[node#\d+\], \[node#\d+\], Left", plan) and "FullOuter" in plan
    assert all(sorted(rows) == [(i, 1) for i in range(1, 31)] + [(i, 2) for i in range(31, 36)] for rows in held.values()) and set(held) == {1, 2}
