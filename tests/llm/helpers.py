"""Small documents tables for the operators' tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

AWKWARD = [None, "", " ", "\n\t ", "a", "A a", "b c", "é è ü", "The same words here again", "the  same words\nhere again", "x" * 5000, "word " * 3000]


def docs_frame(spark, texts, schema=DOCS, first=0):
    rows = [(first + i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def clashing(df):
    """df with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(1).alias(c) for c in ("fp", "sha", "block", "node", "key", "component", "ids", "spans", "items", "w", "h", "pos", "norm")])
