import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.bpe import codec, decoded, encoded, round_trip

from .helpers import AWKWARD, clashing, docs_frame

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
TEXTS = [t for t in AWKWARD if t is not None] + [
    "Hello  world\r\n\r\n  x", "<|endoftext|> a <|endoftext|><|endoftext|>", "it's we'll I'd  x　y  z", "\x00a\x00 b", "\x1c\x1d \x85 x", "naïve 12345 ½ ٣٤ 🎉🎉 é", "aaaaaaaaaa" * 50, "   leading", "trailing   ", "a\tb\t\tc", "﻿x", "!!!???...", "\U0010ffff",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def ids(text):
    raw = next(codec(PATH).encode_batch([text]))
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


@pytest.mark.parametrize("text", TEXTS)
def test_against_library(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    raw = struct.pack(f"<{len(want)}I", *want)
    assert codec(PATH).decode(raw) == library.decode(want, skip_special_tokens=False)


@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text("aeinrst 'AZ09\n\t.!é ", max_size=80))
@settings(max_examples=300, deadline=None)
def test_random_texts(text):
    from tokenizers import Tokenizer

    t = test_random_texts.__dict__.setdefault("library", Tokenizer.from_file(PATH))
    assert ids(text) == t.encode(text, add_special_tokens=False).ids


def test_frames(spark, library):
    df = clashing(docs_frame(spark, [None, *TEXTS]))
    rows = {r.doc_id: r for r in round_trip(df, PATH).collect()}
    tokens = encoded(df, PATH)
    back = {r.doc_id: r.text for r in decoded(tokens, PATH).collect()}
    for i, text in enumerate([None, *TEXTS]):
        want = library.encode(text or "", add_special_tokens=False).ids
        text_back = library.decode(want, skip_special_tokens=False)
        r = rows[i]
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text_back.encode()).hexdigest() and back[i] == text_back
    assert round_trip(docs_frame(spark, []), PATH).collect() == []


def test_all_code_points(library):
    """Every code point of the planes that have letters, marks or numbers (the rest is unassigned or private: some of it),
    in seven contexts: before 's, after a letter, a number, a mark and white space, twice, and alone."""
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x3FFFF), *range(0x40000, 0x110000, 997), *range(0xE0000, 0xE0200)]]
    wrong = []
    for start in range(0, len(points), 50_000):
        part = [f"{c}'s\na{c}\n1{c}\n!{c}\n {c}x\n  {c}\n{c}{c} {c}" for c in points[start : start + 50_000]]
        want = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in library.encode_batch(part, add_special_tokens=False)]
        wrong += [t for t, w, g in zip(part, want, codec(PATH).encode_batch(part)) if w != g]
    assert wrong == []


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 2_000, "xyzzy" * 999, "日本語" * 3_000, "é" * 5_001, "0123456789" * 700, "=" * 3_000, "thequickbrownfox" * 500])
def test_long_pieces(library, text):
    assert ids(text) == library.encode(text, add_special_tokens=False).ids
    v = codec(PATH).vocabulary
    assert v.encode_long(text.encode()[:600]) == v.encode_pieces([text.encode()[:600]])[0]


def test_a_long_word_takes_linear_time():
    import random
    import time

    rng = random.Random(4)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)).encode()
    v = codec(PATH).vocabulary
    v.encode_long(word[:50_000])
    began = time.process_time()
    v.encode_long(word)
    assert time.process_time() - began < 20


def test_the_automaton_is_small():
    """Of each worker: with a row of 256 states for every state that leads on, it took 70 MB."""
    v = codec(PATH).vocabulary
    assert sum(x.nbytes for x in vars(v).values() if hasattr(x, "nbytes") and x is not v.pairs and x is not v.fits) < 20_000_000
