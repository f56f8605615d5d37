import random

import pytest

from tidemark.operators import checker

H = "key string, client int, kind string, value string, found boolean, call bigint, ret bigint"
put = lambda k, v, a, b: (k, 0, "put", v, None, a, b)
get = lambda k, v, a, b: (k, 1, "get", v, v is not None, a, b)
delete = lambda k, a, b: (k, 2, "delete", None, None, a, b)

CASES = [
    ([put("x", "1", 0, 1), get("x", None, 2, 3)], "violation"),
    ([put("x", "1", 0, 5), put("x", "2", 1, 6), get("x", "1", 2, 3)], "ok"),
    ([put("x", "1", 0, None), get("x", "1", 1, 2)], "ok"),
    ([put("x", "1", 0, None), get("x", None, 1, 2)], "ok"),
    ([put("x", "1", 0, None), get("x", "1", 1, 2), get("x", None, 3, 4)], "violation"),
    ([put("x", "1", 0, 1), delete("x", 2, 3), get("x", None, 4, 5)], "ok"),
    ([put("x", "1", 0, 1), put("x", "2", 2, 3), get("x", "1", 4, 5)], "violation"),
    ([put("x", "1", 0, 3), get("x", "1", 1, 2), get("x", None, 4, 5)], "violation"),
    ([put("x", "", 0, 1), get("x", "", 2, 3)], "ok"),
    ([get("x", None, 0, 1)], "ok"),
    ([get("x", "9", 0, 1)], "violation"),
    ([put("x", "1", 0, 10), put("x", "2", 0, 10), get("x", "2", 11, 12), get("x", "1", 13, 14)], "violation"),
]


def test_hand_histories(spark):
    rows = [(f"{i:02d}", *op[1:]) for i, (ops, _) in enumerate(CASES) for op in ops]
    got = {r.key: (r.verdict, r.n_ops) for r in checker.check(spark.createDataFrame(rows, H)).collect()}
    assert got == {f"{i:02d}": (v, len(ops)) for i, (ops, v) in enumerate(CASES)}
    top = checker.verdict(checker.check(spark.createDataFrame(rows, H))).first()
    assert (top.first_violation, top.n_violations, top.n_unknown) == ("00", sum(v == "violation" for _, v in CASES), 0)


def sequential(seed):
    rng, value, rows = random.Random(seed), None, []
    for i in range(30):
        k = rng.random()
        if k < 0.4:
            value = str(i)
            rows.append(put("x", value, 2 * i, 2 * i + 1))
        elif k < 0.5:
            value = None
            rows.append(delete("x", 2 * i, 2 * i + 1))
        else:
            rows.append(get("x", value, 2 * i, 2 * i + 1))
    return rows


@pytest.mark.parametrize("corrupt", [False, True])
def test_random_histories(spark, corrupt):
    rows, n = [], 0
    for seed in range(100):
        own = sequential(seed)
        reads = [i for i, r in enumerate(own) if r[2] == "get"]
        if corrupt and reads:
            i = random.Random(seed).choice(reads)
            own[i] = get("x", "never", own[i][5], own[i][6])
        n += bool(reads)
        rows += [(str(seed), *r[1:]) for r in own]
    got = [r.verdict for r in checker.check(spark.createDataFrame(rows, H)).collect()]
    assert got.count("violation") == (n if corrupt else 0) and got.count("unknown") == 0


def test_overlapping_histories_that_did_happen(spark):
    """Operations take effect at a random moment inside their windows."""
    rng, rows = random.Random(2), []
    for key in range(60):
        at = sorted(rng.sample(range(1000), 14))
        value = None
        for i, t in enumerate(at):
            a, b = t - rng.randrange(1, 120), t + rng.randrange(1, 120)
            if rng.random() < 0.5:
                value = f"{i}"
                rows.append((str(key), i, "put", value, None, a, b))
            else:
                rows.append((str(key), i, "get", value, value is not None, a, b))
    assert {r.verdict for r in checker.check(spark.createDataFrame(rows, H)).collect()} == {"ok"}
    assert {r.verdict for r in checker.check(spark.createDataFrame(rows, H), max_steps=1).collect()} == {"unknown"}


def test_reports(spark):
    df = spark.createDataFrame([put("x", "<1>", 0, None), get("x", None, 1, 2), get("x", "zz", 3, 4)], H)
    assert checker.phantom_reads(df).count() == 1
    assert [r.line for r in checker.witness(df, "x").orderBy("call").collect()] == ["client 0 [0, inf] put <1>", "client 1 [1, 2] get -> (absent)", "client 1 [3, 4] get -> zz"]
    html = checker.timeline_html(df, "a <b>", False)
    assert "a &lt;b&gt;" in html and "NOT linearizable" in html and html.count("<hr") == 3 and "The first" not in html
    assert "The first 2 of 3" in checker.timeline_html(df, "t", True, 2)


def brute_force(ops):
    """Whether any order of a register's operations, those that never returned taken or left, explains them."""
    from itertools import permutations

    done = [o for o in ops if o[6] is not None]
    open_ = [o for o in ops if o[6] is None and o[2] != "get"]
    for take in range(1 << len(open_)):
        for order in permutations(done + [o for i, o in enumerate(open_) if take >> i & 1]):
            if any(b[6] is not None and b[6] < a[5] for i, a in enumerate(order) for b in order[i + 1 :]):
                continue
            value, good = None, True
            for _, _, kind, arg, found, _, _ in order:
                if kind == "get":
                    good &= value == arg if found else value is None
                else:
                    value = arg if kind == "put" else None
            if good:
                return True
    return False


def test_against_all_orders(spark):
    rng, rows, want = random.Random(8), [], {}
    for key in range(150):
        own = []
        for i in range(rng.randrange(1, 6)):
            a = rng.randrange(12)
            b = None if rng.random() < 0.2 else a + rng.randrange(8)
            kind = rng.choice(["put", "put", "get", "get", "delete"])
            value = rng.choice("123") if kind == "put" else rng.choice(["1", "2", None]) if kind == "get" else None
            own.append((str(key), i, kind, value, kind == "get" and value is not None, a, b))
        rows += own
        want[str(key)] = "ok" if brute_force(own) else "violation"
    got = {r.key: r.verdict for r in checker.check(spark.createDataFrame(rows, H)).collect()}
    left = {k: v for k, v in want.items() if k in got}
    assert got == left and set(want) - set(got) <= {k for k in want if all(r[2] == "get" and r[6] is None for r in rows if r[0] == k)}
    assert set(want.values()) == {"ok", "violation"}
