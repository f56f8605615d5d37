import numpy as np

from tidemark.llm import quality

from .helpers import AWKWARD, clashing, docs_frame

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    out = [r for r in got if r.held_out and r.quality is not None]
    assert sum(r.predicted == r.quality for r in out) >= 0.9 * len(out)


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)] + [(1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality.quality_scores(clashing(docs_frame(spark, AWKWARD)), labels).collect()}
    assert set(got) == set(range(len(AWKWARD))) and all(0 <= s <= 1 for s in got.values())
    assert quality.quality_scores(docs_frame(spark, []), labels).collect() == []
    none = labels.where("quality > 5")
    assert {r.score for r in quality.quality_scores(docs_frame(spark, AWKWARD), none).collect()} == {0.5}


def test_prior_and_risk_on_known_mixture():
    rng = np.random.default_rng(3)
    p = rng.normal(1, 1, (3000, 5)).astype(np.float32)
    u = np.vstack([rng.normal(1, 1, (2100, 5)), rng.normal(-2, 1, (900, 5))]).astype(np.float32)
    model = quality.fit(p, u)
    assert abs(model.prior - 0.7) < 0.08
    z = lambda x: np.clip((x - model.centre) * model.scale, -8, 8)
    bare = quality.Model(np.float32(0), np.float32(1), model.layers, model.prior)
    s = bare.scores(z(u))[:, 0]
    assert ((s > 0.5) == (np.arange(3000) < 2100)).mean() > 0.95


def slow_risk(w, p, u, prior):
    """The risk by its definition, one row at a time."""
    import math

    def out(x):
        h = [max(0.0, sum(a * b for a, b in zip(x, w[0][:, j])) + w[1][j]) for j in range(len(w[1]))]
        return sum(a * b for a, b in zip(h, w[2][:, 0])) + w[3][0]

    loss = lambda z: math.log1p(math.exp(-z))
    negative = sum(loss(-out(x)) for x in u) / len(u) - prior * sum(loss(-out(x)) for x in p) / len(p)
    return prior * sum(loss(out(x)) for x in p) / len(p) + negative if negative >= 0 else -negative


def test_risk_and_gradient_against_differences():
    rng = np.random.default_rng(1)
    signs = set()
    for prior, shift in ((0.3, 0.0), (0.9, -3.0)):
        w = [rng.normal(0, 1, (4, 3)), rng.normal(0, 1, 3), rng.normal(0, 1, (3, 1)), np.array([shift])]
        p, u = rng.normal(0.5, 1, (6, 4)), rng.normal(-0.5, 1, (7, 4))
        if shift:  # unlabelled rows all look negative, positives too: the bracket is below zero
            w[3] = np.array([-4.0])
            p = p + 3 * np.sign(w[0] @ w[2])[:, 0]
        value, grads = quality.risk(w, p, u, prior)
        assert abs(value - slow_risk(w, p, u, prior)) < 1e-9
        signs.add(bool(value >= 0 and quality.risk(w, p, u, prior)[0] == value))
        for i, g in enumerate(grads):
            for at in np.ndindex(w[i].shape):
                moved = []
                for step in (1e-6, -1e-6):
                    v = [a.copy() for a in w]
                    v[i][at] += step
                    moved.append(slow_risk(v, p, u, prior))
                assert abs((moved[0] - moved[1]) / 2e-6 - g[at]) < 1e-4


def test_scores_by_plain_loops():
    import math

    rng = np.random.default_rng(2)
    m = quality.Model(rng.normal(0, 1, 3), rng.uniform(0.5, 2, 3), [rng.normal(0, 1, (3, 2)), rng.normal(0, 1, 2), rng.normal(0, 1, (2, 1)), rng.normal(0, 1, 1)], 0.5)
    x = rng.normal(0, 1, (5, 3))
    for row, got in zip(x, m.scores(x)[:, 0]):
        h = [max(0.0, sum((row[i] - m.centre[i]) * m.scale[i] * m.layers[0][i, j] for i in range(3)) + m.layers[1][j]) for j in range(2)]
        z = sum(h[j] * m.layers[2][j, 0] for j in range(2)) + m.layers[3][0]
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-9


def test_measures_of_long_texts_do_not_depend_on_slices(monkeypatch):
    text = "Some words, some MORE; and 123 !!! \n" * 40_000
    want = quality.measures(text)
    monkeypatch.setattr(quality, "_SLICE", 1000)
    assert len(text) > 1 << 20 and np.array_equal(quality.measures(text), want)


def test_picked_ids(spark):
    """A doc_id that fills half of the rows counts once; labelled rows are never unlabelled ones."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)] + [(7, "text 7")] * 60, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(0, 40)] + [(500, 1, 0)], "doc_id long, quality int, toxic int")
    got = [tuple(r)[:2] for r in quality.sampled_ids(docs, labels, 5, 9).collect()]
    assert len(set(got)) == len(got) == 14
    assert all(i % 2 == 0 and i < 40 for i, positive in got if positive) and all(40 <= i < 60 for i, positive in got if not positive)
    assert quality.trained(docs, labels) is not None
