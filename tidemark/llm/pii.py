"""Personal data by weak supervision.

1. Base spans (e-mail, IP, card, phone numbers) and further candidates (obfuscated e-mail, IPv6, local phone
   numbers, national ids, IBANs, person names, secrets such as keys and tokens) are found in whole texts.
2. Six labelers vote on every span: strict format, check rule, gazetteer, context words for, context words
   against, and token borders. A vote is 1 (personal), 0 (not) or none.
3. Votes are counted by (kind, vote pattern) on the executors: a bounded table. On it expectation-maximisation
   estimates the prior of each kind and the labelers' reliabilities: of format, check and gazetteer for each kind,
   drawn towards those over all kinds where a kind has few spans; of context and borders over all kinds.
4. A logistic span classifier is trained on at most SAMPLE_SPANS spans with their patterns' posteriors. It does
   not see the votes, but the span: its kind, the shapes of its tokens, character-shape trigrams, its length, and
   the words around it, hashed. Base spans always stay; candidates that it accepts are added.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, staged

BASE = ("email", "ip", "card", "phone")
ADDED = ("email_obfuscated", "ipv6", "phone_local", "national_id", "iban", "name", "secret")
KINDS = BASE + ADDED
LABELERS = 6
#: Format, check and gazetteer mean another rule for each kind; context and borders mean the same for all.
OF_KIND = np.array([True, True, True, False, False, False])
#: A candidate is added if the classifier gives it this probability.
ACCEPT = 0.6
#: Code points on either side of a span that count as its context, and words of it that the classifier sees.
CONTEXT = 48
NEAR = 3
#: Bound of the spans that the classifier is trained on, dealt evenly to the kinds.
SAMPLE_SPANS = 8000
#: Places of hashed features, and how many of a labeler's votes on a kind its rate over all kinds counts for.
DIM = 4096
BACK_OFF = 20.0

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is never entered in its middle, so possessive runs find the same spans in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_DIGIT = re.compile(r"[0-9]")

_OBFUSCATED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[\[({]\s?at\s?[\])}]\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[({]\s?dot\s?[\])}])\s?[A-Za-z0-9-]{1,63}){1,4}", re.I)
_MAYBE_OBFUSCATED = re.compile(r"[\[({]\s?at\s?[\])}]", re.I)
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::|[0-9A-Fa-f]{1,4})(?::[0-9A-Fa-f]{1,4}){0,5}(?![0-9A-Za-z:])")
_PHONE_LOCAL = re.compile(r"(?<![0-9A-Za-z.+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
# A value that a key word names, or one of a published form.
_MAYBE_SECRET = re.compile(r"key|token|secret|passw|pwd|auth|credential|AKIA|gh[pousr]_|xox|eyJ", re.I)
_NAMED_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:[A-Za-z0-9]+[_-])?(?:api[_-]?key|key|token|secret|passw(?:or)?d|pwd|auth|credentials?)[\"']?\s{0,3}(?:=>|[:=])\s{0,3}[\"']?(?P<value>(?=[A-Za-z+/_.=~-]*[0-9])[A-Za-z0-9+/_.=~-]{8,})", re.I)
_FORMED_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})(?![A-Za-z0-9])|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]{0,30}PRIVATE KEY-----")
_NAME = re.compile(r"\b(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra|Sr)\.? )?[A-Z][a-zà-öø-ÿ]{1,20} [A-Z][a-zà-öø-ÿ]{1,20}\b")

# Gazetteers and context words.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io co ai dev app me tv eu uk us de fr es it nl be ch at pl pt ru cn jp kr in br mx ar ca au nz se no fi dk ie cz".split())
GIVEN_NAMES = frozenset(
    "james john robert michael william david richard joseph thomas charles daniel matthew anthony mark paul steven andrew peter "
    "christopher george edward brian ronald kevin jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott brandon benjamin samuel "
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy emma anna laura betty sandra ashley emily kimberly donna michelle "
    "carol amanda melissa deborah stephanie rebecca sharon cynthia kathleen amy angela olivia alice "
    "hans klaus jürgen wolfgang stefan andreas michaela petra sabine ursula monika claudia günter helmut uwe dieter werner lukas jonas felix katharina "
    "pierre jean jacques michel philippe marie nathalie isabelle sophie claire julie françois louis henri antoine camille chloé "
    "josé juan antonio manuel francisco carlos luis maría carmen ana isabel lucía javier miguel pedro sofía elena pablo "
    "ahmed mohammed fatima ali omar aisha wei li chen yuki hiroshi kenji priya raj amit sanjay olga ivan dmitri natasha giulia marco luca".split()
)
HONORIFICS = frozenset("mr mrs ms miss dr prof herr frau monsieur madame mme señor señora sra sr".split())
CUES = {
    "email": "email e-mail mail contact write reach correo courriel adresse",
    "ip": "ip address host server client login adresse adresse",
    "card": "card visa mastercard amex credit debit payment tarjeta carte karte",
    "phone": "phone tel telephone call mobile cell fax contact teléfono téléphone telefon",
    "national_id": "ssn social security id identity tax",
    "iban": "iban account bank bic konto compte cuenta",
    "name": "name dear sincerely regards signed born nom nombre contact",
    "secret": "key token secret password passwd pwd auth credentials credential login bearer private",
}
CUES |= {"email_obfuscated": CUES["email"], "ipv6": CUES["ip"], "phone_local": CUES["phone"]}
AGAINST = frozenset("version release isbn issn order item page figure table chapter section line sku part model v build ratio score".split())

_CUE_SETS = {k: frozenset(v.split()) for k, v in CUES.items()}
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) << (i & 1)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def ip_parts(span: str) -> list[int]:
    """The numbers of a dotted span, 1000 for all beyond 999; a part may have any number of zeros before it."""
    significant = [p.lstrip("0") for p in span.split(".")]
    return [int(p or "0") if len(p) <= 3 else 1000 for p in significant]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping e-mail spans: every '@' has one run of local characters before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if max(ip_parts(m.group())) <= 255]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15]
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further spans that may be personal; those that overlap a base span or an earlier candidate are left out."""
    found: list[tuple[str, int, int]] = []
    if _MAYBE_OBFUSCATED.search(text):
        found += [("email_obfuscated", *m.span()) for m in _OBFUSCATED.finditer(text)]
    if _DIGIT.search(text):
        found += [("phone_local", *m.span()) for m in _PHONE_LOCAL.finditer(text)]
        found += [("national_id", *m.span()) for m in _NATIONAL.finditer(text)]
        found += [("iban", *m.span()) for m in _IBAN.finditer(text)]
    if ":" in text:
        found += [("ipv6", *m.span()) for m in _IPV6.finditer(text)]
    if _MAYBE_SECRET.search(text):
        found += [("secret", *m.span("value")) for m in _NAMED_SECRET.finditer(text)] + [("secret", *m.span()) for m in _FORMED_SECRET.finditer(text)]
    found += [("name", *m.span()) for m in _NAME.finditer(text)]
    if not found:
        return found
    order = {k: i for i, k in enumerate(KINDS)}
    taken = sorted((a, b) for _, a, b in base)
    out = []
    for span in sorted(found, key=lambda s: (order[s[0]], s[1])):
        k = _bisect(taken, span[1], span[2])
        if k is not None:
            taken.insert(k, (span[1], span[2]))
            out.append(span)
    return out


def _bisect(taken: list[tuple[int, int]], a: int, b: int) -> int | None:
    """Where [a, b) goes among sorted disjoint spans; None if it overlaps one."""
    lo, hi = 0, len(taken)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if taken[mid][0] < a else (lo, mid)
    if lo and taken[lo - 1][1] > a or lo < len(taken) and taken[lo][0] < b:
        return None
    return lo


def votes(text: str, kind: str, a: int, b: int) -> tuple[int, ...]:
    """The labelers' votes on a span: 1, 0 or -1 for none."""
    span = text[a:b]
    around = {w.lower() for w in _WORD.findall(text[max(0, a - CONTEXT) : a] + " " + text[b : b + CONTEXT])}
    digits = "".join(_DIGITS.findall(span))
    check = gazetteer = -1
    strict = 1
    if kind in ("email", "email_obfuscated"):
        last = re.split(r"[^A-Za-z0-9-]+", span.rstrip("])} "))[-1].lower()
        gazetteer = int(last in TOP_LEVEL)
        strict = int(bool(re.match(r"[A-Za-z0-9]", span)) and ".." not in span)
    elif kind == "ip":
        parts = ip_parts(span)
        check = int(parts[0] not in (0, 127, 255) and parts != [1, 2, 3, 4])
        strict = int(span == ".".join(map(str, parts)))
    elif kind == "ipv6":
        strict = int(span.count(":") >= 4)
        check = int(span.count("::") <= 1)
    elif kind == "card":
        check, gazetteer = 1, int(digits[0] in "3456")
    elif kind in ("phone", "phone_local"):
        strict = int(span.count("(") == span.count(")"))
        check = int(len(set(digits)) > 3)
    elif kind == "national_id":
        check = int(digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000")
    elif kind == "iban":
        flat = span.replace(" ", "")
        check = int(15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1)
    elif kind == "secret":
        strict = int(len(span) >= 16)
        check = int(_entropy(span) >= 3 and any(c.isdigit() for c in span) and any(c.isalpha() for c in span))
        gazetteer = 1 if _FORMED_SECRET.fullmatch(span) else -1
    elif kind == "name":
        words = [w.lower().rstrip(".") for w in span.split()]
        gazetteer = int(any(w in GIVEN_NAMES for w in words[:-1]) or words[0] in HONORIFICS)
        strict = -1
    cue = 1 if around & _CUE_SETS[kind] else -1
    against = 0 if around & AGAINST else -1
    before, after = text[a - 1 : a], text[b : b + 1]
    border = 0 if before.isalnum() or after.isalnum() else 1 if kind != "name" else -1
    return strict, check, gazetteer, cue, against, border


def _entropy(span: str) -> float:
    """Bits a character."""
    return -sum(n / len(span) * math.log2(n / len(span)) for n in Counter(span).values())


def pattern(kind: str, v: tuple[int, ...]) -> int:
    """One number for (kind, votes)."""
    code = KINDS.index(kind)
    for x in v:
        code = code * 3 + x + 1
    return code


def unpacked(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kind, votes) of pattern numbers."""
    rest = np.asarray(code, np.int64)
    v = np.zeros((len(rest), LABELERS), np.int64)
    for k in range(LABELERS - 1, -1, -1):
        v[:, k], rest = rest % 3 - 1, rest // 3
    return rest, v


_SHAPES = [(re.compile("[0-9]"), "0"), (re.compile(r"[^\W\d_a-z]"), "A"), (re.compile("[a-z]"), "a"), (re.compile(r"\s"), "_")]


def features(text: str, kind: str, a: int, b: int) -> list[int]:
    """Hashed features of a span: its kind, length, shapes of tokens, character-shape trigrams, and words around it."""
    shape = text[a : min(b, a + 64)]  # the start of a long key shows its form
    for p, sign in _SHAPES:
        shape = p.sub(sign, shape)
    said = [kind, f"n{(b - a).bit_length()}"]
    said += [f"t{x}" for x in {re.sub(r"(.)\1+", r"\1+", w) for w in shape.split("_")}]
    said += [f"c{x}" for x in {shape[i : i + 3] for i in range(max(1, len(shape) - 2))}]
    before, after = _WORD.findall(text[max(0, a - CONTEXT) : a]), _WORD.findall(text[b : b + CONTEXT])
    said += [f"b{w.lower()}" for w in before[-NEAR:]] + [f"f{w.lower()}" for w in after[:NEAR]]
    return sorted({zlib.crc32(f"{kind} {x}".encode("utf-8", "replace")) % DIM for x in said})


def with_silence(v: np.ndarray) -> np.ndarray:
    """Votes in which silence of the two one-sided labelers counts: context for votes 1 or says nothing, context
    against 0 or nothing, so whether they speak is what they say."""
    v = v.copy()
    v[:, 3], v[:, 4] = v[:, 3] == 1, v[:, 4] != 0
    return v


#: Where the rates of with_silence() start: half of what is personal has a word for it near, little has one against it.
START = np.array([[0.2, 0.8], [0.2, 0.8], [0.2, 0.8], [0.15, 0.5], [0.5, 0.95], [0.2, 0.8]])


def expectation_maximisation(kind: np.ndarray, v: np.ndarray, count: np.ndarray, rounds: int = 100, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of patterns, priors of kinds, and labelers' rates P(vote 1 | truth) as (kind, labeler, truth).

    Starts from labelers that are right four times in five, or from given rates (labeler, truth). A labeler's rate over all kinds, held from 0 and 1 by
    beta priors, counts for BACK_OFF votes in its rate for a kind, and is that rate if it is not OF_KIND.
    """
    prior, rate = np.full(len(KINDS), 0.5), np.tile([0.2, 0.8], (len(KINDS), LABELERS, 1)) if start is None else np.tile(start, (len(KINDS), 1, 1))
    post = np.full(len(count), 0.5)
    voted, one = v >= 0, v == 1
    own = np.eye(len(KINDS))[kind].T if len(kind) else np.zeros((len(KINDS), 0))  # kinds x patterns
    new = post
    for _ in range(rounds):
        like = [np.log(np.where(voted, np.where(one, rate[kind, :, t], 1 - rate[kind, :, t]), 1)).sum(axis=1) for t in (0, 1)]
        new = 1 / (1 + np.exp(-np.clip(like[1] - like[0] + np.log(prior[kind] / (1 - prior[kind])), -40, 40)))
        prior = (2 + own @ (count * new)) / (4 + own @ count)
        for truth, weight in ((0, count * (1 - new)), (1, count * new)):
            yes, all_ = own @ (weight[:, None] * one), own @ (weight[:, None] * voted)
            pooled = (yes.sum(axis=0) + (4 if truth else 1)) / (all_.sum(axis=0) + 5)
            rate[:, :, truth] = np.where(OF_KIND, (yes + BACK_OFF * pooled) / (all_ + BACK_OFF), pooled)
        # a labeler is never worse than chance, or two readings of the same votes would do as well
        worse = OF_KIND & (rate[:, :, 1] < rate[:, :, 0])
        rate = np.where(worse[:, :, None], rate.mean(axis=2, keepdims=True), rate)
        prior = np.clip(prior, 0.02, 0.98)
        if np.abs(new - post).max(initial=0) < 1e-6:
            break
        post = new
    return new, prior, rate


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    rates: np.ndarray
    priors: np.ndarray

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        """Of spans with these features."""
        z = np.array([self.weights[r].sum() for r in rows]) + self.bias if rows else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: list[list[int]], post: np.ndarray, weight: np.ndarray, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression of posteriors on features, by accelerated descent."""
    w, b = np.zeros(DIM), 0.0
    if not rows:
        return w, b
    at, size = np.concatenate(rows).astype(np.int64), np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(rows)), size)
    weight = weight / weight.sum()
    step = 4 / (1 + float(size.max()))
    vw, vb = w, b
    for k in range(rounds):
        z = np.bincount(row, vw[at], len(rows)) + vb
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - post)
        nw, nb = vw - step * (np.bincount(at, g[row], DIM) + 1e-5 * vw), vb - step * g.sum()
        m = k / (k + 3)
        vw, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return w, b


SPAN = "kind:string,start:int,end:int,pattern:int,features:array<int>"


def found(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end,pattern,features>>): base spans and candidates with their votes; staged."""

    def each(batch: pa.RecordBatch) -> dict:
        rows = []
        for t in batch.column("text").to_pylist():
            t = t or ""
            base = base_spans(t)
            rows.append([{"kind": k, "start": a, "end": b, "pattern": pattern(k, votes(t, k, a, b)), "features": features(t, k, a, b)} for k, a, b in base + candidates(t, base)])
        return {"doc_id": batch.column("doc_id"), "spans": rows}

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return staged(by_batch(narrow, f"doc_id long, spans array<struct<{SPAN}>>", each), "pii")


def trained(spans: DataFrame, sample: int = SAMPLE_SPANS) -> Model:
    """The label model of all spans of found(), and the classifier of at most `sample` of them."""
    each = spans.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    counts = each.groupBy("pattern").agg(F.count("*").alias("n")).toPandas().sort_values("pattern")
    codes, n = counts["pattern"].to_numpy(), counts["n"].to_numpy(float)
    kind, v = unpacked(codes)
    post, prior, rate = expectation_maximisation(kind, with_silence(v), n, start=START)
    if not len(codes):
        return Model(np.zeros(DIM), 0.0, rate, prior)
    of_kind = np.bincount(kind, n, len(KINDS))
    most = sample // max(1, int((of_kind > 0).sum()))
    # a threshold of shares is only near its rate, so the bound is kept by a limit a kind
    rates = F.create_map(*[F.lit(x) for k, c in zip(KINDS, of_kind) if c for x in (k, float(min(1.0, 1.2 * most / c + 1e-12)))])
    share = F.pmod(F.xxhash64("doc_id", "kind", "start", "end"), F.lit(1 << 40)) / float(1 << 40)
    picked = each.withColumn("share", share).where(F.col("share") < rates[F.col("kind")]).select("share", "pattern", "kind", "features")
    got = picked.orderBy("share", "pattern", "features").limit(2 * sample).toPandas()
    got = got.groupby("kind", sort=False).head(most)
    at = np.searchsorted(codes, got["pattern"].to_numpy())
    # every kind weighs alike
    share_of = got.groupby("kind")["pattern"].transform("size").to_numpy(float)
    w, b = train([list(f) for f in got["features"]], post[at], 1 / share_of)
    return Model(w, b, rate, prior)


def classified(spans: DataFrame) -> tuple[DataFrame, Model]:
    """The rows of found() with spans array<struct<kind,start,end,probability,base>>, and the model."""
    model = trained(spans)
    order = {k: i for i, k in enumerate(KINDS)}
    shared = spans.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, spans array<struct<kind:string,start:int,end:int,probability:double,base:boolean>>"

    def each(batch: pa.RecordBatch) -> dict:
        rows = []
        for own in batch.column("spans").to_pylist():
            p = shared.value.probabilities([s["features"] for s in own or ()])
            kept = [{"kind": s["kind"], "start": s["start"], "end": s["end"], "probability": x, "base": s["kind"] in BASE} for s, x in zip(own or (), p.tolist())]
            kept = [s for s in kept if s["base"] or s["probability"] >= ACCEPT]
            rows.append(sorted(kept, key=lambda s: (order[s["kind"]], s["start"])))
        return {"doc_id": batch.column("doc_id"), "spans": rows}

    return by_batch(spans, schema, each), model


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end,probability,base>>), one row per row of docs.

    Offsets are code points, ends exclusive; spans are sorted by kind, then start, and never overlap across
    added kinds. Null and empty texts have no spans. Rows that repeat a doc_id keep a row each. Empty tables
    give no rows. Other columns are not read.
    """
    return classified(found(docs, text, doc_id))[0]


def digest(spans: DataFrame) -> DataFrame:
    """The columns that op1 returns."""
    flat = lambda own: F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select(
        "doc_id",
        *map(count, BASE),
        F.sha2(flat(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        flat(F.col("spans")).alias("spans"),
    )
