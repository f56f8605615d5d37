import json
import random

from pyspark.sql import functions as F

from tidemark.llm.toolcalls import exchanges, linked

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = "name string, field string, kind string, required boolean, minimum double, maximum double, choices array<string>"
RULES = [
    ("add", "x", "integer", True, 0.0, 10.0, None),
    ("add", "y", "number", False, None, None, None),
    ("say", "text", "string", True, 1.0, 5.0, None),
    ("say", "tone", "string", False, None, None, ["low", "high"]),
    ("say", "tags", "array", False, None, None, None),
    ("say", "more", "object", False, None, None, None),
    ("say", "loud", "boolean", False, None, None, None),
]


def run(spark, calls, results=(), rules=RULES):
    frames = spark.createDataFrame(list(calls), CALLS), spark.createDataFrame(list(results), RESULTS), spark.createDataFrame(rules, SCHEMAS)
    frames = [f.withColumn("least", F.lit(1)).withColumn("extra", F.lit("v")) for f in frames]
    return {(r.conv_id, r.call_id): r for r in linked(*frames).collect()}


def test_validation(spark):
    cases = [
        ("add", '{"x": 3, "y": 1.5}', []),
        ("add", '{"x": 3.5}', ["x: expected integer"]),
        ("add", '{"x": 11}', ["x: out of range"]),
        ("add", "{}", ["x: missing"]),
        ("add", '{"x": null}', ["x: expected integer"]),
        ("add", '{"x": 1, "z": 2}', ["z: unknown"]),
        ("add", "[1]", ["arguments: not an object"]),
        ("add", "{oops", ["arguments: not an object"]),
        ("add", None, ["arguments: not an object"]),
        ("add", '{"x":1,"x":2}', ["arguments: not an object"]),
        ("say", '{"text": "", "tone": "mid"}', ["text: bad length", "tone: not a choice"]),
        ("say", '{"text": "abc", "tone": "low", "tags": [1], "more": {"a": 1}, "loud": true}', []),
        ("say", '{"text": "abc", "tags": {}, "more": [], "loud": "y"}', ["loud: expected boolean", "more: expected object", "tags: expected array"]),
        ("nope", "{}", ["unknown tool"]),
        (None, "{}", ["unknown tool"]),
    ]
    got = run(spark, [(1, f"c{i}", i, n, a, []) for i, (n, a, _) in enumerate(cases)])
    for i, (_, _, errors) in enumerate(cases):
        assert got[1, f"c{i}"].errors == errors, cases[i]
        assert got[1, f"c{i}"].status == ("invalid" if errors else "no_result")


def test_linking_and_json(spark):
    calls = [(1, "a", 0, "add", '{ "y": 2, "x": 1 }', None), (1, "a", 5, "add", '{"x": 9}', []), (1, "b", 1, "add", '{"x":2}', ["a", "zz"]), (None, "n", 1, "add", "{}", []), (2, None, 1, "add", "{}", [])]
    results = [(1, "a", 3, "later"), (1, "a", 2, "é\n\"/"), (1, "q", 7, None)]
    got = run(spark, calls, results)
    assert set(got) == {(1, "a"), (1, "b"), (1, "q")}
    a = got[1, "a"]
    errors = ["several calls of one id", "several results of one id"]
    assert (a.status, a.n_calls, a.n_results, a.turn, a.errors) == ("invalid", 2, 2, 0, errors)
    want = {"arguments": {"x": 1, "y": 2}, "call_id": "a", "conv_id": 1, "depends_on": [], "errors": errors, "name": "add", "result": 'é\n"/', "status": "invalid"}
    assert a.json == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got[1, "b"].errors == ["zz: no such call"]
    q = got[1, "q"]
    assert (q.status, q.n_calls, q.order_turn) == ("orphan_result", 0, 7)


def test_topological_order(spark):
    rng = random.Random(4)
    calls, deps = [], {}
    for conv in range(12):
        n = rng.randrange(2, 14)
        rank = list(range(n))
        rng.shuffle(rank)  # the true order; turns disagree with it
        for i in range(n):
            deps[conv, f"c{i}"] = {f"c{j}" for j in range(n) if rank[j] < rank[i] and rng.random() < 0.3}
            calls.append((conv, f"c{i}", i, "add", '{"x":1}', sorted(deps[conv, f"c{i}"])))
    calls += [(99, "p", 0, "add", '{"x":1}', ["q"]), (99, "q", 1, "add", '{"x":1}', ["p"]), (99, "r", 2, "add", '{"x":1}', []), (98, "s", 0, "add", '{"x":1}', ["s"])]
    got = run(spark, calls)
    key = lambda c, i: (got[c, i].order_turn, got[c, i].order_hops)
    for (conv, call), own in deps.items():
        assert all(key(conv, d) < key(conv, call) for d in own)
        assert got[conv, call].errors == []
    assert got[99, "p"].errors == got[99, "q"].errors == got[98, "s"].errors == ["cycle"] and got[99, "r"].errors == []


def test_all_of_a_cycle_and_earlier_turns_that_depend_on_it_are_flagged(spark):
    ring = [(1, f"c{i}", i, "add", '{"x":1}', [f"c{(i + 1) % 5}"]) for i in range(5)]
    tail = [(1, "d", 2, "add", '{"x":1}', ["c2"]), (1, "e", 3, "add", '{"x":1}', ["d"]), (1, "f", 1, "add", '{"x":1}', ["g"]), (1, "g", 4, "add", '{"x":1}', [])]
    got = run(spark, ring + tail)
    assert {c for (_, c), r in got.items() if r.errors == ["cycle"]} == {"c0", "c1", "c2", "c3", "c4", "d", "e"}
    assert got[1, "f"].errors == got[1, "g"].errors == [] and (got[1, "f"].order_turn, got[1, "f"].order_hops) == (4, 1)


def test_repeated_rows_that_say_the_same(spark):
    got = run(spark, [(1, "a", 0, "add", '{"x":1}', []), (1, "a", 4, "add", '{"x":1}', [])], [(1, "a", 5, "r"), (1, "a", 6, "r"), (1, "a", 7, None)])
    assert (got[1, "a"].errors, got[1, "a"].n_calls, got[1, "a"].n_results) == (["several results of one id"], 2, 3)


def test_conversations(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "ho"), (1, 3, "user", ""), (2, 0, "user", None), (2, 1, "assistant", None), (3, None, "user", "x"), (None, 1, "user", "x"), (4, 0, "critic", "x"), (5, 4, "assistant", "lone")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.call_id): (r.status, r.errors) for r in linked(*exchanges(frame)).collect()}
    assert got == {
        (1, "c0"): ("no_result", []),  # it refers forward to c1
        (1, "c1"): ("ok", []),
        (1, "c3"): ("invalid", ["prompt: bad length"]),
        (2, "c0"): ("invalid", ["prompt: missing"]),
        (4, "c0"): ("invalid", ["unknown tool"]),
        (5, "c3"): ("orphan_result", []),
    }
    assert linked(*exchanges(frame.where("false"))).collect() == []
