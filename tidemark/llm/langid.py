"""Language ID with error-correcting output codes over hashed byte n-grams.

Every learned language has a codeword. One binary n-gram classifier a bit (logistic regression) predicts
the codeword's bits; a document gets the language whose codeword has the least logistic loss, with each
bit weighted by its reliability on the training sample. Documents whose two nearest codewords are about as
near as each other are flagged ambiguous.

The classifiers are fitted on at most SAMPLE_ROWS labelled rows, dealt evenly to the languages (a smaller
language gives all it has); their n-grams are counted over whole texts on the executors. Scoring reads
every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch
from .sampling import held_out, learnable, matrix, share

#: Bound of the labelled rows that the classifiers are fitted on.
SAMPLE_ROWS = 2400
#: Hashed n-gram counts a document.
DIM = 4096
#: Codewords of up to so many languages use all bipartitions; beyond, random ones.
EXHAUSTIVE = 5
#: A document is ambiguous if its best language has less than this probability.
MARGIN = 0.5

# A-Z and other ASCII that is not a letter becomes a space after lower-casing.
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_LETTER = regex.compile(r"\p{L}")
_SLICE = 1 << 20


def ngram_counts(text: str) -> np.ndarray:
    """Hashed counts of 1- to 3-byte grams of the lower-cased letters, words set apart by one space."""
    counts = np.zeros(DIM, np.int64)
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" ", np.uint8)
    for start in range(0, len(raw), _SLICE):  # slices overlap by two bytes
        a = raw[start : start + _SLICE + 2].astype(np.uint32)
        h1 = a * np.uint32(2654435761)
        counts += np.bincount(h1[:_SLICE] >> 20, minlength=DIM)
        if len(a) > 1:
            h2 = (h1[:-1] ^ a[1:] * np.uint32(2246822519)) * np.uint32(3266489917)
            counts += np.bincount(h2[:_SLICE] >> 20, minlength=DIM)
        if len(a) > 2:
            h3 = (h2[:-1] ^ a[2:] * np.uint32(668265263)) * np.uint32(374761393)
            counts += np.bincount(h3[:_SLICE] >> 20, minlength=DIM)
    return counts


def vectors(texts: list[str]) -> np.ndarray:
    """Unit vectors of square roots of the n-gram frequencies."""
    x = np.zeros((len(texts), DIM), np.float32)
    for i, t in enumerate(texts):
        x[i] = ngram_counts(t)
    return np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1))


def codebook(classes: int, seed: int = 7) -> np.ndarray:
    """Codewords of +1 and -1, one row a class: all bipartitions of few classes, random ones of many."""
    if classes < 2:
        return np.ones((classes, 1))
    if classes <= EXHAUSTIVE:
        columns = [[1 if c == 0 or not (k >> (c - 1)) & 1 else -1 for c in range(classes)] for k in range(1, 1 << (classes - 1))]
        return np.array(columns, float).T
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(classes)))
    best, far = None, -1
    for _ in range(50):  # of some random codes, the one whose nearest codewords are farthest apart
        code = np.stack([rng.permutation(np.where(np.arange(classes) % 2, 1.0, -1.0)) for _ in range(bits)], axis=1)
        apart = ((bits - code @ code.T) / 2 + bits * np.eye(classes)).min()
        if apart > far:
            best, far = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # DIM x bits
    bias: np.ndarray
    trust: np.ndarray  # a bit's reliability; they add up to the number of bits

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Languages' shares by loss-weighted decoding."""
        f = x @ self.weights + self.bias
        losses = np.logaddexp(0, -f[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(losses.min(axis=1, keepdims=True) - losses)
        return p / p.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], rounds: int = 120, decay: float = 1e-6) -> Model:
    """One logistic regression a bit, by accelerated descent; rows weigh alike over languages."""
    code = codebook(len(languages))
    target = code[y].astype(np.float32)
    share_of = 1 / np.maximum(np.bincount(y, minlength=len(languages)), 1)
    weight = (share_of[y] / share_of[y].sum()).astype(np.float32)[:, None]
    mean = (x * weight).sum(axis=0)
    x = x - mean
    top = np.random.default_rng(0).normal(size=DIM).astype(np.float32)
    for _ in range(40):  # the largest eigenvalue of the covariance sets the step
        top = x.T @ (x @ top[:, None] * weight)[:, 0]
        size = float(np.linalg.norm(top))
        top /= max(size, 1e-12)
    step = 2 / max(size, 1e-6)
    w, b = np.zeros((DIM, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = w, b
    for k in range(rounds):
        g = -target * weight / (1 + np.exp(np.clip(target * (x @ vw + vb), -60, 60)))
        nw, nb = vw - step * (x.T @ g + decay * vw), vb - 2 * g.sum(axis=0)
        m = k / (k + 3)
        vw, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    right = ((np.sign(x @ w + b) == target) * weight).sum(axis=0)
    trust = np.log((right + 0.01) / (1.01 - right).clip(1e-3)).clip(0.1)
    return Model(languages, code, w, b - mean @ w, trust * (len(trust) / trust.sum()))


def trained(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model of the languages of the learnable rows; None without any."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        learnable() & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return None
    most = max(1, sample_rows // len(languages))
    # so many more than needed that a language is not missed, as a threshold of shares is only near its rate
    rates = F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, (1.2 * most + 30) / counts[k]))])

    def each(batch: pa.RecordBatch) -> dict:
        x = vectors(batch.column("text").to_pylist()).astype(np.float16)
        return {c: batch.column(c) for c in ("doc_id", "share", "lang")} | {"x": [r.tobytes() for r in x]}

    picked = rows.withColumn("share", share()).where(F.col("share") < rates[F.col("lang")])
    found = by_batch(picked, "doc_id long, share double, lang string, x binary", each, 2 << 20)
    # rows that repeat a doc_id count once a language
    got = found.groupBy("doc_id", "lang").agg(F.min("share").alias("share"), F.min("x").alias("x")).toArrow()
    names = got.column("lang").to_pylist()
    order, taken = [], dict.fromkeys(languages, 0)
    for i in np.lexsort((got.column("doc_id").to_numpy(), got.column("share").to_numpy())).tolist():
        if taken[names[i]] < most:
            taken[names[i]] += 1
            order.append(i)
    languages = [k for k in languages if taken[k]]
    x = matrix(got, "x", DIM)[order]
    y = np.array([languages.index(names[i]) for i in order])
    return fit(x, y, languages)


def languages(docs: DataFrame, model: Model | None, columns: list[str] | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), one row per row of docs, from whole texts.

    Null texts, texts without a letter, and all texts if there is no model are `und` with score 0 and are
    not ambiguous. Ties go to the language that sorts first. Other columns of docs are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))

    def each(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out")} | verdicts(shared.value, batch.column("text").to_pylist())

    return by_batch(narrow, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean", each, 2 << 20)


def verdicts(model: Model | None, texts: list[str | None]) -> dict[str, list]:
    some = [i for i, t in enumerate(texts) if t and model and _LETTER.search(t)]
    lang, score, ambiguous = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
    for start in range(0, len(some), 512):
        part = some[start : start + 512]
        p = model.probabilities(vectors([texts[i] for i in part]))
        for i, best, s in zip(part, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
            lang[i], score[i], ambiguous[i] = model.languages[best], float(s), s < MARGIN
    return {"lang_pred": lang, "score": score, "ambiguous": ambiguous}


def language_ids(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Train on the learnable rows of docs (doc_id, text, lang) and predict all rows: see languages()."""
    return languages(docs, trained(docs, sample_rows))


def identified(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without the rows that language ID rejects: `und` or ambiguous. All columns stay as they are."""
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, sample_rows))
    names, text = docs.columns, docs.columns.index("text")

    def run(batches):
        from .common import chunks

        for batch in (c for b in batches for c in chunks(b, 2 << 20)):
            v = verdicts(model.value, batch.column(text).cast(pa.string()).to_pylist())
            keep = [p != "und" and not a for p, a in zip(v["lang_pred"], v["ambiguous"])]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))], schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
