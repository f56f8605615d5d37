"""Linearizability of register histories, per key.

history   key, client, kind (put, delete, get), value, found, call, ret (null or INFINITY: never returned)

Every operation is two events, its call and its return; a key's events stream through one task in order of time.
What is carried on is the set of configurations that explain all returns so far: a register value, and which of
the open operations have taken effect already. At a return, open operations take effect in every order until the
returning one has; configurations that cannot get there go, and if none is left the history is no register's.
So memory holds open operations and their configurations only, also where writes never return. The number of
configurations is exponential in the operations that are open at once, in the worst case.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import INFINITY
from .folds import fold_sorted


def effect(kind: str, arg: object, found: bool, value: object) -> tuple[bool, object]:
    """(legal, the value after it) of an operation on a register value; None is absent."""
    if kind == "put":
        return True, arg
    if kind == "delete":
        return True, None
    return (value is not None and value == arg if found else value is None), value


def returned(configurations: set, open_: dict, op: int, max_steps: int | None) -> set | None:
    """The configurations (value, operations in effect) after the return of op; None if the search is too long."""
    out, seen, stack, steps = set(), set(), list(configurations), 0
    while stack:
        state = stack.pop()
        if state in seen:
            continue
        seen.add(state)
        steps += 1
        if max_steps is not None and steps > max_steps:
            return None
        value, done = state
        if op in done:
            out.add((value, done - {op}))
            continue
        for i, (kind, arg, found) in open_.items():
            if i not in done:
                legal, after = effect(kind, arg, found, value)
                if legal:
                    stack.append((after, done | {i}))
    return out


def check(history: DataFrame, max_steps: int | None = None) -> DataFrame:
    """(key, verdict, n_ops): ok, violation, or, only if the steps of a return are limited, unknown for each key.

    An operation that returns when another is called overlaps it. Reads that never returned say nothing and are
    left out of n_ops.
    """

    def start(key: tuple) -> dict:
        return {"key": key[0], "configurations": {(None, frozenset())}, "open": {}, "n": 0, "verdict": "ok"}

    def step(s: dict, row: tuple) -> Iterator[tuple]:
        _, kind, value, found, _, ends, op = row
        if not ends:
            s["n"] += 1
        if s["verdict"] != "ok":
            return iter(())
        if not ends:
            s["open"][op] = (kind, value, found)
            return iter(())
        after = returned(s["configurations"], s["open"], op, max_steps)
        del s["open"][op]
        if not after:
            s["verdict"], s["open"] = "unknown" if after is None else "violation", {}
        s["configurations"] = after
        return iter(())

    def finish(s: dict) -> Iterator[tuple]:
        yield s["key"], s["verdict"], s["n"]

    rows = history.select("key", "kind", "value", F.coalesce("found", F.lit(False)).alias("found"), "call", F.coalesce("ret", F.lit(INFINITY)).alias("ret"), F.monotonically_increasing_id().alias("op"))
    called = F.struct(F.col("call").alias("at"), F.lit(False).alias("ends"))
    # a read that never returned says nothing
    events = F.when(F.col("ret") < INFINITY, F.array(called, F.struct(F.col("ret").alias("at"), F.lit(True).alias("ends")))).otherwise(F.array(called))
    rows = rows.where(f"kind <> 'get' OR ret < {INFINITY}").withColumn("e", F.explode(events)).select("key", "kind", "value", "found", "e.at", "e.ends", "op")
    return fold_sorted(rows, ["key"], ["at", "ends", "op"], "key string, verdict string, n_ops long", start, step, finish)


def verdict(checked: DataFrame) -> DataFrame:
    """The global verdict: the least failing key, and how many keys fail or are unknown."""
    return checked.agg(
        F.min(F.when(F.col("verdict") == "violation", F.col("key"))).alias("first_violation"),
        F.sum((F.col("verdict") == "violation").cast("long")).alias("n_violations"),
        F.sum((F.col("verdict") == "unknown").cast("long")).alias("n_unknown"),
    )


def phantom_reads(history: DataFrame) -> DataFrame:
    """Reads of a value that nobody ever put to the key: a necessary condition that needs no search."""
    written = history.where("kind = 'put'").select("key", "value").distinct()
    return history.where("kind = 'get' AND found").join(written, ["key", "value"], "left_anti")


def witness(history: DataFrame, key: str) -> DataFrame:
    """One line for each operation of a key, by call and return."""
    what = F.when(F.col("kind") == "put", F.concat(F.lit("put "), "value")).when(F.col("kind") == "delete", F.lit("delete")).when(F.col("found"), F.concat(F.lit("get -> "), "value")).otherwise(F.lit("get -> (absent)"))
    end = F.when(F.col("ret").isNull() | (F.col("ret") == INFINITY), F.lit("inf")).otherwise(F.col("ret").cast("string"))
    return history.where(F.col("key") == key).select("call", "ret", "client", F.concat(F.lit("client "), F.col("client").cast("string"), F.lit(" ["), F.col("call").cast("string"), F.lit(", "), end, F.lit("] "), what).alias("line"))


def lanes(history: DataFrame) -> DataFrame:
    """Geometry of a timeline: a lane for each client, x and width in units of time; open ends reach the last time."""
    last = history.agg(F.greatest(F.max("call"), F.max(F.when(F.col("ret") < INFINITY, F.col("ret")))).alias("last"))
    joined = history.join(F.broadcast(last), F.lit(True))  # one row
    end = F.when(F.col("ret").isNull() | (F.col("ret") == INFINITY), F.col("last") + 1).otherwise(F.col("ret"))
    return joined.select("client", "key", "kind", F.col("call").alias("x"), (end - F.col("call")).alias("width"), F.col("client").cast("long").alias("lane"))


def write_outcomes(attempts: DataFrame) -> DataFrame:
    """How an attempt (kind, result, after_uncertain, call, ret) enters a history: its return time, or not at all.

    ok: its return. maybe and timeout: never returned. conflict: dropped, or never returned after an
    uncertain try. A failed read is dropped.
    """
    unsure = F.col("result").isin("maybe", "timeout") | ((F.col("result") == "conflict") & F.col("after_uncertain"))
    ret = F.when(F.col("result") == "ok", F.col("ret")).when((F.col("kind") != "get") & unsure, F.lit(INFINITY))
    return attempts.withColumn("effective_ret", ret).withColumn("recorded", ret.isNotNull())


def hue(key: str) -> int:
    """A key's colour on the wheel, from its text alone."""
    return sum((i + 1) * b for i, b in enumerate(key.encode())) * 47 % 360


def timeline_html(history: DataFrame, title: str, ok: bool, limit: int | None = None) -> str:
    """A page with a table of operations by call: a row each, whose bar spans its time in percent of all.

    It is a report for people and meets on the driver; `limit` shows the first operations only, and says so.
    """
    from html import escape

    shown = lanes(history).orderBy("x", "client")
    total = history.count() if limit is not None else None
    rows = (shown if limit is None else shown.limit(limit)).collect()
    low = min((r["x"] for r in rows), default=0)
    span = max((r["x"] + r["width"] for r in rows), default=1) - low or 1
    lines = []
    for r in rows:
        what, left, wide = escape(f"{r['kind']} {r['key']}"), 100 * (r["x"] - low) / span, max(0.2, 100 * r["width"] / span)
        bar = f'<hr style="margin:0 0 0 {left:.2f}%;width:{wide:.2f}%;height:1em;border:0;background:hsl({hue(str(r["key"]))} 60% 55%)">'
        lines.append(f'<tr><th scope="row">{r["lane"]}</th><td>{what}</td><td>{r["x"]}</td><td style="width:70%">{bar}</td></tr>')
    note = f"<p>The first {len(rows)} of {total} operations.</p>" if total is not None and total > len(rows) else ""
    verdict_text = "The history is linearizable." if ok else "The history is NOT linearizable."
    head = "<tr><th>client</th><th>operation</th><th>call</th><th>time</th></tr>"
    return f"<!doctype html><title>{escape(title)}</title><h1>{escape(title)}</h1><p>{verdict_text}</p>{note}<table style=\"width:100%\">{head}{''.join(lines)}</table>"
