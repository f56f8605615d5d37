"""Quality classifier by positive-unlabelled learning.

Trusted positives are learnable rows labelled 1; unlabelled web text is every learnable row without a
label. A small network minimises the non-negative unbiased risk
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),
where the class prior is estimated from a first pass: the least ratio of the shares that unlabelled and
positive text have above a score. Rows labelled 0 are not used for the fit.

Inputs of a score are style measures of the whole text: shares of characters and of character-shape
trigrams, repetition of words and lines, and lengths. The fit reads at most SAMPLE_POSITIVE and
SAMPLE_UNLABELLED rows, whose measures are computed over whole texts on the executors.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch
from .sampling import held_out, learnable, matrix, share

#: Bounds of the rows that the network is fitted on.
SAMPLE_POSITIVE = 5000
SAMPLE_UNLABELLED = 7000
THRESHOLD = 0.7

_SLICE = 1 << 20
# Shapes of bytes: upper, lower, beyond ASCII, digit, white space, end of sentence, other marks.
_SHAPE = np.array([2 if c >= 128 else 0 if 65 <= c <= 90 else 1 if 97 <= c <= 122 else 3 if 48 <= c <= 57 else 4 if c == 32 or 9 <= c <= 13 else 5 if c in b".,;:" else 6 for c in range(256)], np.int64)
SHAPES = 7
#: Classes of bytes: ASCII marks one by one, then the seven shapes.
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
DIM = SHAPES**3 + len(_MARKS) + SHAPES + 10


def measures(text: str) -> np.ndarray:
    """Style measures in [0, 1] or so; shares are shrunk towards 0 in short texts."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = len(raw)
    counts, shapes = np.zeros(256, np.int64), np.zeros(SHAPES**3, np.int64)
    doubled = 0
    for start in range(0, n, _SLICE):  # slices overlap by two bytes
        a = raw[start : start + _SLICE + 2]
        counts += np.bincount(a[:_SLICE], minlength=256)
        s = _SHAPE[a]
        doubled += int(((s[1:] == 6) & (a[1:] == a[:-1]))[:_SLICE].sum())
        if len(s) > 2:
            shapes += np.bincount(s[:-2] * SHAPES**2 + s[1:-1] * SHAPES + s[2:], minlength=SHAPES**3)
    by_shape = np.bincount(_SHAPE, weights=counts, minlength=SHAPES)
    words = text.split()
    w = len(words)
    kinds = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    again = sum(map(str.__eq__, words, words[1:]))
    extra = [
        doubled / (n + 40),
        again / (w + 8),
        (w - len(kinds)) / (w + 8),
        max(kinds.values(), default=0) / (w + 8),
        (len(lines) - len(set(lines))) / (len(lines) + 2),
        min(1.0, np.log1p(n) / 12),
        min(1.0, np.log1p(w) / 10),
        min(1.0, n / (w + 1) / 20),
        min(1.0, w / (len(lines) + 1) / 100),
        1.0 if not w else 0.0,
    ]
    return np.concatenate([np.sqrt(shapes / (n + 40)), np.sqrt(counts[_MARKS] / (n + 40)), by_shape / (n + 40), extra]).astype(np.float32)


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.centre) * self.scale @ self.layers[0] + self.layers[1], 0)
        return 1 / (1 + np.exp(-np.clip(h @ self.layers[2] + self.layers[3], -30, 30)))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.5) -> float:
    """The share of positives among unlabelled scores.

    Above any score the unlabelled share is at least prior times the positive share; the bound is tight
    where negatives are rare. Scores with fewer than `least` of the positives above them are too noisy.
    """
    p, u = np.sort(positive), np.sort(unlabelled)
    cuts = p[: max(1, int(len(p) * (1 - least)))]
    above_p = 1 - np.searchsorted(p, cuts) / len(p)
    above_u = 1 - np.searchsorted(u, cuts) / len(u)
    return float(np.clip((above_u / above_p).min(), 0.01, 0.99))


def risk(w: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float | None) -> tuple[float, list[np.ndarray]]:
    """The value that a step lowers, and its gradient by the layers w, on positive and unlabelled measures.

    Without a prior: the logistic loss of telling positives from unlabelled. With one: prior * R_p(+) plus the
    unlabelled risk R_u(-) - prior * R_p(-); where that is below zero it is overfitted, and the step goes back:
    minus that part alone is lowered.
    """
    x = np.vstack([p, u])
    h = np.maximum(x @ w[0] + w[1], 0)
    out = np.clip(h @ w[2] + w[3], -30, 30)
    s = 1 / (1 + np.exp(-out))
    as_positive, as_negative = np.logaddexp(0, -out), np.logaddexp(0, out)
    n, m = len(p), len(u)
    # d(logistic loss)/d(output): s - 1 as a positive, s as a negative
    if prior is None:
        value = as_positive[:n].mean() + as_negative[n:].mean()
        g = np.vstack([(s[:n] - 1) / n, s[n:] / m])
    else:
        negative = as_negative[n:].mean() - prior * as_negative[:n].mean()
        g_negative = np.vstack([-prior * s[:n] / n, s[n:] / m])
        if negative >= 0:
            value = prior * as_positive[:n].mean() + negative
            g = g_negative + np.vstack([prior * (s[:n] - 1) / n, np.zeros((m, 1))])
        else:
            value, g = -negative, -g_negative
    gh = (g @ w[2].T) * (h > 0)
    return float(value), [x.T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0)]


def _descend(p: np.ndarray, u: np.ndarray, prior: float | None, hidden: int, epochs: int, seed: int) -> list[np.ndarray]:
    """Adam on mini-batches of risk(), with a little weight decay."""
    rng = np.random.default_rng(seed)
    d = p.shape[1]
    w = [rng.normal(0, d**-0.5, (d, hidden)).astype(np.float32), np.zeros(hidden, np.float32), rng.normal(0, hidden**-0.5, (hidden, 1)).astype(np.float32), np.zeros(1, np.float32)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    steps = max(1, -(-max(len(p), len(u)) // 256))
    epochs = max(epochs, 400 // steps)
    k = 0
    for _ in range(epochs):
        op, ou = rng.permutation(len(p)), rng.permutation(len(u))
        for b in range(steps):
            part = range(b * 256, b * 256 + 256)
            grads = risk(w, p[np.take(op, part, mode="wrap")], u[np.take(ou, part, mode="wrap")], prior)[1]
            k += 1
            rate = 3e-3 * (1 - 0.9 * k / (steps * epochs))
            for i, q in enumerate(grads):
                q = q + 1e-4 * w[i] * (i in (0, 2))
                m[i] = 0.9 * m[i] + 0.1 * q
                v[i] = 0.999 * v[i] + 0.001 * q * q
                w[i] = (w[i] - rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
    return w


def fit(p: np.ndarray, u: np.ndarray, hidden: int = 24, epochs: int = 12, seed: int = 5) -> Model | None:
    """A model of positive and unlabelled measures; None if either is missing."""
    if not len(p) or not len(u):
        return None
    both = np.vstack([p, u])
    centre = both.mean(axis=0)
    scale = 1 / np.maximum(both.std(axis=0), 0.02)
    p, u = (np.clip((a - centre) * scale, -8, 8) for a in (p, u))
    rng = np.random.default_rng(seed)
    p, u = rng.permutation(p), rng.permutation(u)
    half_p, half_u = len(p) // 2 + 1, len(u) // 2 + 1
    first = Model(np.zeros_like(centre), np.ones_like(scale), _descend(p[:half_p], u[:half_u], None, hidden, max(2, epochs // 3), seed), 0.5)
    rest_p, rest_u = (p[half_p:] if len(p) > half_p else p), (u[half_u:] if len(u) > half_u else u)
    prior = estimated_prior(first.scores(rest_p)[:, 0], first.scores(rest_u)[:, 0])
    return Model(centre, scale, _descend(p, u, prior, hidden, epochs, seed), prior)


def sampled_ids(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> DataFrame:
    """(doc_id, positive, share): at most so many learnable ids of either kind, those with the least shares.

    Only ids are read and joined; texts are fetched for the picked ones afterwards.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(learnable())
    n_docs = max(1, ids.count())
    trusted = known.where(learnable() & (F.col("quality") == 1)).join(ids, "doc_id", "left_semi")

    def least(frame: DataFrame, positive: bool, n: int) -> DataFrame:
        return frame.select("doc_id", F.lit(positive).alias("positive"), share().alias("share")).orderBy("share", "doc_id").limit(n)

    rate = min(1.0, 2 * unlabelled / n_docs)
    while True:
        free = ids.where(share() < rate).join(known, "doc_id", "left_anti").distinct()
        if rate == 1 or free.count() >= unlabelled:
            return least(trusted, True, positives).unionByName(least(free, False, unlabelled))
        rate = min(1.0, 8 * rate)  # most rows are labelled


def trained(docs: DataFrame, labels: DataFrame, positives: int = SAMPLE_POSITIVE, unlabelled: int = SAMPLE_UNLABELLED) -> Model | None:
    """A model from docs (doc_id, text) and labels (doc_id, quality); a row labelled twice is positive if all its labels are.

    Rows that repeat a picked doc_id are read in parallel and count once.
    """
    picked = sampled_ids(docs, labels, positives, unlabelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def each(batch: pa.RecordBatch) -> dict:
        x = [measures(t or "").astype(np.float16).tobytes() for t in batch.column("text").to_pylist()]
        return {c: batch.column(c) for c in ("doc_id", "share", "positive")} | {"x": x}

    # at most positives + unlabelled ids are broadcast
    found = by_batch(rows.join(F.broadcast(picked), "doc_id").select("doc_id", "share", "positive", "text"), "doc_id long, share double, positive boolean, x binary", each, 2 << 20)
    got = found.groupBy("doc_id", "positive").agg(F.min("share").alias("share"), F.min("x").alias("x")).toArrow()
    x, positive = matrix(got, "x", DIM), got.column("positive").to_numpy(zero_copy_only=False).astype(bool)
    order = np.lexsort((got.column("doc_id").to_numpy(), got.column("share").to_numpy()))
    return fit(x[[i for i in order if positive[i]]], x[[i for i in order if not positive[i]]])


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs, from whole texts.

    Null counts as the empty text, which is scored like any other. Without a model every score is 0.5.
    Rows that repeat a doc_id keep a row each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))

    def each(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        m = shared.value
        score = np.full(len(texts), 0.5)
        for start in range(0, len(texts) if m else 0, 2048):
            x = np.array([measures(t) for t in texts[start : start + 2048]], np.float32)
            z = np.clip((x - m.centre) * m.scale, -8, 8)
            score[start : start + 2048] = Model(np.float32(0), np.float32(1), m.layers, m.prior).scores(z)[:, 0]
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)}

    return by_batch(narrow, "doc_id long, held_out boolean, score double, predicted int", each, 2 << 20)


def quality_scores(docs: DataFrame, labels: DataFrame, positives: int = SAMPLE_POSITIVE, unlabelled: int = SAMPLE_UNLABELLED) -> DataFrame:
    """Fit on the learnable rows and score all rows: see trained() and scored()."""
    return scored(docs, trained(docs, labels, positives, unlabelled))
