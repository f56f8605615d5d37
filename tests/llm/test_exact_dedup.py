import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.exact_dedup import deduplicated, exact_duplicates, rice_decode, rice_encode

from .helpers import AWKWARD, clashing, docs_frame


@given(st.sets(st.integers(0, 2**64 - 1), max_size=200))
@settings(max_examples=100, deadline=None)
def test_rice_round_trip(values):
    a = np.array(sorted(values), np.uint64)
    assert rice_decode(len(a), *rice_encode(a)).tolist() == a.tolist()


def brute(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    return {(i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def test_against_brute_force(spark):
    rng = random.Random(1)
    texts = AWKWARD + [rng.choice(["a b", "a  b", "c", "d e f", " a b"]) for _ in range(200)] + [f"own {i}" for i in range(50)]
    df = clashing(docs_frame(spark, texts)).repartition(5)
    for block_rows in (1 << 22, 16):
        got = [tuple(r) for r in exact_duplicates(df, block_rows=block_rows).collect()]
        assert len(got) == len(texts) and set(got) == brute(list(enumerate(texts)))


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (None, "x"), (None, "z")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 4, True), (1, 1, 4, True), (2, 1, 4, False), (None, 1, 4, False), (None, None, 1, True)], key=str)


def test_empty(spark):
    assert exact_duplicates(docs_frame(spark, [])).collect() == []


def test_stage_keeps_ties_and_clashing_columns(spark):
    rows = [(3, "a  b"), (5, "a b"), (5, "own"), (None, "a b"), (None, "c"), (3, "a  b"), (7, None), (8, "")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("*", "1 AS gone_id", "1 AS GONE_SHA", "1 AS _gone_id")
    got = deduplicated(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, "a  b"), (3, "a  b"), (5, "own"), (None, "c"), (7, None)], key=str)
    assert deduplicated(df.where("false")).count() == 0
