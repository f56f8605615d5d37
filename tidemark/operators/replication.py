"""Decisions of a replicated log, as queries over trace tables.

raft_log   node, idx (from 1), term, kind (0 data, 1 config), members (array<int> of a config entry)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import CONFIG, NO_VOTE
from .prefix import running


def majority(members: Column) -> Column:
    """Votes that decide among members."""
    return F.floor(F.size(members) / 2).cast("int") + 1


def voting_peers(members: Column, node: int) -> Column:
    return F.array_sort(F.array_except(members, F.array(F.lit(node))))


def up_to_date(last_term: Column, last_idx: Column, own_term: Column, own_idx: Column) -> Column:
    """Whether a candidate's log is at least as new as the voter's: by last term, then by last index."""
    return F.struct(last_term.alias("t"), last_idx.alias("i")) >= F.struct(own_term.alias("t"), own_idx.alias("i"))


def votes(requests: DataFrame) -> DataFrame:
    """requests (seq, voter, candidate, term, eligible) with granted and reply_term, each voter's in order of seq.

    eligible: the candidate's log is up to date. Optional columns: in_contact (the voter heard from a leader just
    now) makes it ignore the request, term and all, unless transfer is set; start_term and start_vote are what
    the voter had saved. A heard term beyond the voter's is adopted whether or not the vote is granted; a smaller
    one is refused. The first candidate that may have the vote of a term gets it, again when it asks again.
    """
    have = set(requests.columns)
    default = lambda name, value: F.col(name) if name in have else F.lit(value)
    rows = requests.withColumns(
        {
            "_heard": ~F.coalesce(default("in_contact", False) & ~F.coalesce(default("transfer", False), F.lit(False)), F.lit(False)),
            "_start": F.coalesce(default("start_term", 0), F.lit(0)).cast("long"),
            "_vote": F.nullif(default("start_vote", NO_VOTE), F.lit(NO_VOTE)),
        }
    )
    so_far = Window.partitionBy("voter").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("reply_term", F.greatest(F.coalesce(F.max(F.when(F.col("_heard"), F.col("term"))).over(so_far), F.lit(0)), F.col("_start")))
    rows = rows.withColumn("_may", F.col("_heard") & (F.col("term") == F.col("reply_term")) & F.col("eligible"))
    of_term = Window.partitionBy("voter", "term").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    chosen = F.coalesce(F.when(F.col("term") == F.col("_start"), F.col("_vote")), F.first(F.when(F.col("_may"), F.col("candidate")), True).over(of_term))
    return rows.withColumn("granted", F.coalesce(F.col("_may") & (F.col("candidate") == chosen), F.lit(False))).drop("_heard", "_start", "_vote", "_may")


def winners(granted: DataFrame, n_voters: int) -> DataFrame:
    """(term, winner, n_votes) of the terms in which a candidate has a majority of distinct voters."""
    tally = granted.where("granted").groupBy("term", "candidate").agg(F.countDistinct("voter").alias("n_votes"))
    return tally.where(F.col("n_votes") >= n_voters // 2 + 1).select("term", F.col("candidate").alias("winner"), "n_votes")


def running_term(messages: DataFrame) -> DataFrame:
    """The term each node has after all its messages (node, term)."""
    return messages.groupBy("node").agg(F.max("term").alias("term"))


def commit_index(match: DataFrame, leader_log: DataFrame, current_term: int, commit: int) -> DataFrame:
    """The new commit index from voters' match (node, match_idx): the largest index that a majority holds,
    if it is beyond commit and of the current term; else commit."""
    held = match.agg(F.sort_array(F.collect_list("match_idx"), asc=False).alias("m")).select(F.expr("m[size(m) div 2]").alias("idx"))  # one row for each voter
    entry = leader_log.select("idx", "term")
    found = held.join(entry, "idx", "left")
    ok = (F.col("idx") > commit) & (F.col("term") == current_term)
    return found.select(F.when(F.coalesce(ok, F.lit(False)), F.col("idx")).otherwise(F.lit(commit)).cast("long").alias("commit_index"))


def matches_prev(requests: DataFrame, log: DataFrame, base: int = 0, base_term: int = 0) -> DataFrame:
    """requests (node, prev_idx, prev_term) with ok: below the base true, at it equal terms, else present and equal."""
    own = log.select("node", F.col("idx").alias("prev_idx"), F.col("term").alias("own_term"))
    at = F.when(F.col("prev_idx") < base, True).when(F.col("prev_idx") == base, F.col("prev_term") == base_term).otherwise(F.coalesce(F.col("own_term") == F.col("prev_term"), F.lit(False)))
    return requests.join(own, ["node", "prev_idx"], "left").withColumn("ok", at).drop("own_term")


def appended(log: DataFrame, entries: DataFrame) -> DataFrame:
    """Followers' logs (node, idx, term) after they take a leader's entries (node, idx, term).

    From the first index of another term on, the follower's suffix is replaced; without a conflict its own
    entries all stay, even beyond the leader's, and only missing ones are added. Rows meet by (node, idx). What is
    known of a node is one row, which goes to the rows of its log and never the other way: the hints are there
    because compressed files look small enough to be sent whole to every task.
    """
    log, new = log.hint("merge"), entries.select("node", "idx", F.col("term").alias("new_term"))
    conflict = log.join(new, ["node", "idx"]).where("term <> new_term").groupBy("node").agg(F.min("idx").alias("cut"))
    both = log.select("node", "idx", F.col("term").alias("own_term")).join(new, ["node", "idx"], "full").join(F.broadcast(conflict), "node", "left")
    keeps_own = F.col("cut").isNull() | (F.col("idx") < F.col("cut"))
    term = F.when(keeps_own, F.coalesce("own_term", "new_term")).otherwise(F.col("new_term"))
    return both.withColumn("term", term).where("term IS NOT NULL").select("node", "idx", "term")


def append_entries(states: DataFrame, log: DataFrame, requests: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Followers' answers to one message each, and their logs (node, idx, term) after it.

    states: node, term, commit_idx, base_idx, base_term; requests: node, term, prev_idx, prev_term, leader_commit;
    entries: node, idx, term. Answers: node, success, term, match_idx, hint, commit_idx. A stale leader is refused
    with the follower's term; a log that does not hold the previous entry is refused with the index after its last
    one as a hint; else the entries beyond the base are taken as appended() does, and the commit index follows the
    leader's up to the log's end.
    """
    asked = requests.select("node", F.col("term").alias("leader_term"), "prev_idx", "prev_term", "leader_commit").join(states, "node")
    last = log.groupBy("node").agg(F.max("idx").alias("last_idx"))
    at_prev = log.select("node", F.col("idx").alias("prev_idx"), F.col("term").alias("own_prev_term"))
    at_prev = F.broadcast(at_prev.join(F.broadcast(requests.select("node", "prev_idx")), ["node", "prev_idx"]))  # a row a node
    n = entries.groupBy("node").agg(F.count("*").alias("n_entries"))
    known = asked.join(last, "node", "left").join(at_prev, ["node", "prev_idx"], "left").join(n, "node", "left")
    holds = (
        F.when(F.col("prev_idx") < F.col("base_idx"), True)
        .when(F.col("prev_idx") == F.col("base_idx"), F.col("prev_term") == F.col("base_term"))
        .otherwise(F.coalesce(F.col("own_prev_term") == F.col("prev_term"), F.lit(False)))
    )
    stale = F.col("leader_term") < F.col("term")
    judged = known.withColumns(
        {"stale": stale, "success": ~stale & holds, "last_idx": F.coalesce("last_idx", "base_idx"), "n_entries": F.coalesce("n_entries", F.lit(0))}
    )
    good = F.broadcast(judged.where("success").select("node", "base_idx"))  # one row a node
    taken = entries.join(good, "node").where("idx > base_idx").select("node", "idx", "term")
    merged = appended(log.join(good, "node", "left_semi"), taken)
    after = merged.unionByName(log.join(good, "node", "left_anti").select("node", "idx", "term"))
    new_last = merged.groupBy("node").agg(F.max("idx").alias("new_last"))
    reach = F.least("leader_commit", F.coalesce("new_last", "last_idx"))
    answers = judged.join(new_last, "node", "left").select(
        "node",
        "success",
        F.greatest("term", "leader_term").alias("term"),
        F.when(F.col("success"), F.col("prev_idx") + F.col("n_entries")).alias("match_idx"),
        F.when(~F.col("success") & ~F.col("stale"), F.col("last_idx") + 1).alias("hint"),
        F.when(F.col("success"), F.greatest("commit_idx", reach)).otherwise(F.col("commit_idx")).alias("commit_idx"),
    )
    return answers, after


def installed_snapshot(log: DataFrame, offers: DataFrame) -> DataFrame:
    """(node, term, base_idx, base_term, commit_idx, success, n_left) after a snapshot is offered to each node.

    offers: node, own_term, own_applied, leader_term, snap_idx, snap_term. A stale leader is refused. A snapshot
    that the node has applied already is acknowledged and changes nothing; another replaces the whole log (node,
    idx, term), sessions and configuration come with it (see sources/segments.py).
    """
    held = log.groupBy("node").agg(F.count("*").alias("n_log"))
    stale, known = F.col("leader_term") < F.col("own_term"), F.col("snap_idx") <= F.col("own_applied")
    return (
        offers.join(held, "node", "left")
        .withColumns({"stale": stale, "takes": ~stale & ~known})
        .select(
            "node",
            F.greatest("own_term", "leader_term").alias("term"),
            F.when(F.col("takes"), F.col("snap_idx")).otherwise(F.lit(0)).cast("long").alias("base_idx"),
            F.when(F.col("takes"), F.col("snap_term")).otherwise(F.lit(0)).cast("long").alias("base_term"),
            F.when(F.col("takes"), F.col("snap_idx")).otherwise(F.col("own_applied")).cast("long").alias("commit_idx"),
            (~F.col("stale")).alias("success"),
            F.when(F.col("takes"), F.lit(0)).otherwise(F.coalesce("n_log", F.lit(0))).cast("long").alias("n_left"),
        )
    )


def add_outcome(leads: Column, member: Column, match_idx: Column, target: Column, gate_open: Column) -> Column:
    """What becomes of a request to add a server: a learner is proposed as a voter once it holds the commit index
    of the time of asking, and no other change is under way."""
    return (
        F.when(~leads, "not leader")
        .when(member, "already a voter")
        .when(F.coalesce(match_idx, F.lit(0)) < target, "catching up")
        .when(~gate_open, "change in progress")
        .otherwise("proposed")
    )


def transfer_outcome(leads: Column, own: Column, under_way: Column, member: Column, match_idx: Column, last_idx: Column) -> Column:
    """What becomes of a request to hand leadership to a server: it is told to campaign once it holds the whole log."""
    return (
        F.when(~leads, "not leader")
        .when(own, "already leader")
        .when(under_way, "not leader")
        .when(~member, "not a voter")
        .when(F.coalesce(match_idx, F.lit(0)) < last_idx, "catching up")
        .otherwise("campaign now")
    )


def read_barriers(barriers: DataFrame, acks: DataFrame, n_voters: int) -> DataFrame:
    """barriers (seq, node, term) with outcome: served once a majority, the node included, has acknowledged an
    entry of the term after the barrier (acks: seq, node, term); else not leader."""
    last = acks.groupBy("term", "node").agg(F.max("seq").alias("seq"))
    of_term = last.groupBy("term").agg(F.collect_list(F.struct("node", "seq")).alias("heard"))  # one for each voter
    later = F.size(F.filter("heard", lambda a: (a["seq"] > F.col("seq")) & (a["node"] != F.col("node"))))
    n = F.when(F.col("heard").isNull(), 0).otherwise(later) + 1
    return barriers.join(of_term, "term", "left").select("seq", "node", "term", n.cast("long").alias("n_acks"), F.when(n >= n_voters // 2 + 1, "served").otherwise("not leader").alias("outcome"))


def config_as_of(log: DataFrame, base_members: list[int]) -> DataFrame:
    """(idx, config_idx, members): the newest config entry at or before each index; config_idx 0 is the base."""
    marked = running(log.select("idx", "kind", "members"), "idx", F.when(F.col("kind") == CONFIG, F.col("idx")), "config_idx", how="max", strict=False)
    configs = log.where(F.col("kind") == CONFIG).select(F.col("idx").alias("config_idx"), F.col("members").alias("found"))
    base = F.array(*[F.lit(x) for x in base_members])
    return marked.select("idx", F.coalesce("config_idx", F.lit(0)).cast("long").alias("config_idx")).join(configs, "config_idx", "left").select("idx", "config_idx", F.coalesce("found", base).alias("members"))


def config_gate(log: DataFrame, commits: DataFrame) -> DataFrame:
    """(commit, gate_open): a membership change may start iff the newest config entry is committed."""
    newest = log.where(F.col("kind") == CONFIG).agg(F.coalesce(F.max("idx"), F.lit(0)).alias("newest"))
    return commits.join(F.broadcast(newest), F.lit(True)).select("commit", (F.col("newest") <= F.col("commit")).alias("gate_open"))  # one row


def compacted_log(log: DataFrame, applied: int) -> DataFrame:
    """The entries after `applied`, with the base they stand on."""
    base = log.where(F.col("idx") == applied).select(F.col("term").alias("base_term"))
    return log.where(F.col("idx") > applied).join(F.broadcast(base), F.lit(True)).select(F.lit(applied).cast("long").alias("base_idx"), "base_term", "idx", "term")  # one row


def restart_state(states: DataFrame, log: DataFrame) -> DataFrame:
    """(node, term, voted_for) after a restart from saved state and log: the larger term; the vote is kept iff
    the saved term is not behind the log's."""
    last = log.groupBy("node").agg(F.max("term").alias("log_term"))
    joined = states.join(last, "node", "left").withColumn("log_term", F.coalesce("log_term", F.lit(0)))
    return joined.select("node", F.greatest("term", "log_term").alias("term"), F.when(F.col("term") >= F.col("log_term"), F.col("voted_for")).otherwise(F.lit(NO_VOTE)).alias("voted_for"))


def members(changes: DataFrame) -> DataFrame:
    """The voters after changes (seq, server, action add/remove): adding and removing again change nothing.

    A removal that would leave no voter is refused: if all servers' last change is a removal, the server
    removed last stays.
    """
    last = changes.groupBy("server").agg(F.max_by("action", "seq").alias("action"), F.max("seq").alias("seq"))
    summed = last.agg(
        F.array_sort(F.collect_list(F.when(F.col("action") == "add", F.col("server")))).alias("voters"), F.max_by("server", "seq").alias("latest")
    )  # one entry for each server
    return summed.select(F.when(F.size("voters") > 0, F.col("voters")).otherwise(F.array("latest")).alias("voters"))


def current_leader(claims: DataFrame) -> DataFrame:
    """The node that claims leadership in the highest term (node, term, seq, role); ties go to the latest claim."""
    return claims.where("role = 'leader'").agg(F.max_by("node", F.struct("term", "seq")).alias("leader"), F.max("term").alias("term"))


def convergence(logs: DataFrame, leader: DataFrame, commit: int) -> DataFrame:
    """(node, applied, equal, converged): each node's last index, whether its committed prefix is the leader's."""
    prefix = leader.where(F.col("idx") <= commit).select("idx", F.col("term").alias("leader_term"))
    same = logs.where(F.col("idx") <= commit).join(prefix, "idx").groupBy("node").agg(F.sum((F.col("term") == F.col("leader_term")).cast("long")).alias("n_same"))
    last = logs.groupBy("node").agg(F.max("idx").alias("applied"))
    joined = last.join(same, "node", "left")
    equal = F.coalesce(F.col("n_same"), F.lit(0)) == F.lit(commit)
    return joined.select("node", "applied", equal.alias("equal"), (equal & (F.col("applied") >= commit)).alias("converged"))
