import zlib

import numpy as np

from tidemark.llm import langid

from .helpers import AWKWARD, clashing, docs_frame

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    got = langid.language_ids(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in got)
    kept = langid.identified(docs)
    assert kept.schema == docs.schema and kept.count() >= 0.99 * docs.count()


def test_awkward_rows(spark):
    texts = [*AWKWARD, "123 !!! 456", "\u00b2 \u00bd \u2167 _"]
    docs = docs_frame(spark, texts)
    got = {r.doc_id: r for r in langid.language_ids(clashing(docs)).collect()}
    for i, t in enumerate(texts):
        assert (got[i].lang_pred == "und") == (t is None or not any(c.isalpha() for c in t))
    assert langid.language_ids(docs_frame(spark, [])).collect() == []
    # no labelled row: nothing is learned
    none = docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in langid.language_ids(none).collect()} == {"und"}


def test_codes_are_apart():
    for k in (2, 3, 4, 5, 9, 30):
        code = langid.codebook(k)
        apart = (code[:, None] != code[None]).sum(axis=2) + 1000 * np.eye(k)
        assert apart.min() >= 1 and (k < 4 or apart.min() >= 4)


def test_ambiguous_mixture():
    rng = np.random.default_rng(0)
    words = {c: ["".join(rng.choice(list(s), 5)) for _ in range(50)] for c, s in (("x", "abcde"), ("y", "vwxyz"), ("z", "mnopq"))}
    text = lambda c: " ".join(rng.choice(words[c], 60))
    names = [c for c in "xyz" for _ in range(40)]
    model = langid.fit(langid.vectors([text(c) for c in names]), np.array(["xyz".index(c) for c in names]), list("xyz"))
    v = langid.verdicts(model, [text("x"), text("y"), text("z")])
    assert v["lang_pred"] == list("xyz") and not any(v["ambiguous"])
    p = model.probabilities(langid.vectors([text("x") + " " + text("y") + " " + text("z")]))
    assert p.max() < 0.99


def test_decoding_by_a_plain_loop():
    import math

    rng = np.random.default_rng(5)
    code = langid.codebook(5)
    m = langid.Model(list("abcde"), code, rng.normal(0, 1, (langid.DIM, code.shape[1])), rng.normal(0, 1, code.shape[1]), rng.uniform(0.2, 2, code.shape[1]))
    x = rng.uniform(0, 1, (4, langid.DIM)) * (rng.uniform(0, 1, (4, langid.DIM)) < 0.01)
    for row, p in zip(x, m.probabilities(x)):
        losses = []
        for word in code:
            bits = [sum(row[i] * m.weights[i, b] for i in np.flatnonzero(row)) + m.bias[b] for b in range(len(word))]
            losses.append(sum(t * math.log1p(math.exp(-f * c)) for f, c, t in zip(bits, word, m.trust)))
        e = [math.exp(min(losses) - v) for v in losses]
        assert np.allclose(p, [v / sum(e) for v in e]) and int(p.argmax()) == min(range(5), key=lambda i: losses[i])


def test_counts_by_a_plain_loop_and_in_slices(monkeypatch):
    text = "Añb c! Def\n12 gh"
    raw = b" " + " ".join("añb c def gh".split()).encode() + b" "
    m = 0xFFFFFFFF
    want = np.zeros(langid.DIM, int)
    for i in range(len(raw)):
        h = raw[i] * 2654435761 & m
        want[h >> 20] += 1
        for c, a, b in zip(raw[i + 1 : i + 3], (2246822519, 668265263), (3266489917, 374761393)):
            h = (h ^ (c * a & m)) * b & m
            want[h >> 20] += 1
    assert np.array_equal(langid.ngram_counts(text), want)
    long = text * 80_000
    whole = langid.ngram_counts(long)
    monkeypatch.setattr(langid, "_SLICE", 997)
    assert len(long) > 1 << 20 and np.array_equal(langid.ngram_counts(long), whole)


def test_many_languages_and_repeated_ids(spark):
    """Each of many languages is learned from rows of its own, and a doc_id that fills half of the table counts once."""
    rows = [(i, f"lang{i % 40} " * 5 + f"word{i}", f"l{i % 40:02d}") for i in range(400)] + [(3, "lang3 word", "l03")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.trained(docs, sample_rows=80)
    assert model.languages == [f"l{k:02d}" for k in range(40)]
