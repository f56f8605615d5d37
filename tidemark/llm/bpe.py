"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece the exact encoding has one last token. Candidates are the vocabulary's matches
that end at the prefix: an automaton with suffix links over the vocabulary (Aho-Corasick: only whole tokens
are of use, not all their substrings) leads from the longest to the shortest. The one that is compatible with the last token of the prefix before it is stored. Two tokens are compatible if no merge across their
border would have come before the merges that built them. Back-pointers then give the ids.

Pieces (the pre-tokenizer's words) are encoded once and kept in a bounded table of each Python worker.
Vocabulary files are read from a path on the executors that is a parameter, never copied.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

#: Entries of a worker's two piece tables: 16 MB or so each.
PIECES = 80_000
#: Bytes of text whose pieces are encoded together.
BATCH = 1 << 20
#: Pieces of more bytes are encoded one by one, in time linear in their length.
LONG = 512
#: Answers on pairs of tokens that a worker keeps for long pieces.
PAIRS = 100_000

# The published pre-tokenizer pattern, with its white space spelled out.
_SPACE = r"\t-\r \x85\xa0  -     　"
# Code points that the regex module calls letters or numbers and Unicode 16, which the
# tokenizers library follows, does not.
_NEWER_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 "
    "1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F "
    "2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
_NEWER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"


def _ranges(points: str) -> str:
    """Hexadecimal code points and ranges as the inside of a character set."""
    return "".join("-".join(rf"\U{int(x, 16):08X}" for x in r.split("-")) for r in points.split())


def _pattern(letter: str, number: str) -> regex.Pattern:
    other = rf"[[^{_SPACE}]--{letter}--{number}]"
    return regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


#: For texts without newer code points, and for all.
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
FULL_PATTERN = _pattern(rf"[\p{{L}}--[{_ranges(_NEWER_LETTERS)}]]", rf"[\p{{N}}--[{_ranges(_NEWER_NUMBERS)}]]")
_NEWER = re.compile(f"[{_ranges(_NEWER_LETTERS)}{_ranges(_NEWER_NUMBERS)}]")


def pretokenized(text: str) -> list[str]:
    """The pre-tokenizer's words of a text without special tokens."""
    return (PATTERN if text.isascii() or not _NEWER.search(text) else FULL_PATTERN).findall(text)


# Where cutting at single white spaces could part some that belong together (or the mark of a cut is in the text).
_RUN = re.compile(rf"[{_SPACE}][{_SPACE}]| \Z|\0")


def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merge ranks and the prefix automaton of a tokenizers file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        letters = byte_letters()
        as_bytes = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"]}
        self.id = {as_bytes[t]: i for t, i in spec["model"]["vocab"].items()}
        self.token = {i: t for t, i in self.id.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t.encode() for t, i in self.special.items()}
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pairs = [(self.id[as_bytes[a]], self.id[as_bytes[b]]) for a, b in merges]
        del spec, as_bytes, merges
        # rank of a merge; how a token was built, with the rank of that merge (single bytes: -1)
        self.rank = {p: r for r, p in reversed(list(enumerate(pairs)))}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for (a, b), r in sorted(self.rank.items(), key=lambda x: x[1]):
            self.parts.setdefault(self.id[self.token[a] + self.token[b]], (a, b, r))
        self._automaton()
        del self.id

    def _automaton(self) -> None:
        """Aho-Corasick automaton of all tokens, as arrays.

        blocks[row[s, byte >> 4], byte & 15] is the state after s. A state shares all blocks of its suffix but those
        that longer tokens change, so the table is a sixth of one with a full row a state.
        found_id[first[s]:first[s + 1]] are the tokens that end at s, longest first, with found_size bytes.
        """
        go: list[dict[int, int]] = [{}]
        own = [-1]
        for i, t in self.token.items():
            if i in self.special.values():
                continue
            s = 0
            for b in t:
                if b not in go[s]:
                    go[s][b] = len(go)
                    go.append({})
                    own.append(-1)
                s = go[s][b]
            own[s] = i
        self.row = np.zeros((len(go), 16), np.int32)
        # the root's blocks, and one for each set of bytes with equal first halves that lead on from a state
        self.blocks = np.zeros((16 + sum(len({b >> 4 for b in kids}) for kids in go), 16), np.int32)
        used = 16
        ends: list[list[int]] = [[] for _ in go]
        queue = [(0, 0)]
        for s, fail in queue:  # by depth, so fail's row is complete
            ends[s] = ([own[s]] if own[s] >= 0 else []) + (ends[fail] if s else [])
            self.row[s] = row = self.row[fail].tolist() if s else list(range(16))
            queue += [(t, int(self.blocks[row[b >> 4], b & 15]) if s else 0) for b, t in go[s].items()]
            for high in {b >> 4 for b in go[s]}:
                self.blocks[used] = self.blocks[row[high]]
                self.row[s, high], used = used, used + 1
            for b, t in go[s].items():
                self.blocks[self.row[s, b >> 4], b & 15] = t
            go[s] = {}
        self.first = np.cumsum([0, *map(len, ends)])
        self.found_id = np.array([i for e in ends for i in e], np.int64)
        self.size = np.zeros(max(self.token) + 1, np.int64)
        self.size[list(self.token)] = [len(t) for t in self.token.values()]
        self.found_size = self.size[self.found_id]
        self.pairs, self.fits = np.array([-1]), np.array([False])
        self.answers: dict[tuple[int, int], bool] = {}

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging left's and right's bytes keeps the border between them.

        Undo the later of the two tokens' last merges, step by step. At each point the two tokens that
        touch the border exist together until `until`, the rank of the merge undone last; a merge of them
        with a smaller rank would have come first.
        """
        until, side = len(self.rank), 0
        while True:
            r = self.rank.get((left, right))
            # of equal ranks the leftmost pair merges first: the border pair stands right of what
            # builds the left token and left of what builds the right token
            if r is not None and (r < until or r == until and side == 1):
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            # equal ranks are done from the left, so the right token's merge is the later one
            if b is None or a is not None and a[2] > b[2]:
                left, until, side = a[1], a[2], -1
            else:
                right, until, side = b[0], b[2], 1

    def _fitting(self, pairs: np.ndarray) -> np.ndarray:
        """compatible() of left << 32 | right; answers are kept in a sorted table."""
        at = np.searchsorted(self.pairs, pairs)
        new = np.unique(pairs[self.pairs[np.minimum(at, len(self.pairs) - 1)] != pairs])
        if len(new):
            if len(self.pairs) > 2_000_000:
                self.pairs, self.fits = self.pairs[:1], self.fits[:1]
                return self._fitting(pairs)
            answers = [self._compatible(x >> 32, x & 0xFFFFFFFF) for x in new.tolist()]
            to = np.searchsorted(self.pairs, new)
            self.pairs, self.fits = np.insert(self.pairs, to, new), np.insert(self.fits, to, answers)
            at = np.searchsorted(self.pairs, pairs)
        return self.fits[at]

    def encode_long(self, piece: bytes) -> bytes:
        """The exact ids of one piece: the same recurrence as encode_pieces(), byte by byte without arrays."""
        step, row = memoryview(self.blocks.reshape(-1)), memoryview(self.row.reshape(-1))
        first, found, sizes = memoryview(self.first), memoryview(self.found_id), memoryview(self.found_size)
        last, state, answers = [0] * (len(piece) + 1), 0, self.answers
        for i, byte in enumerate(piece, 1):
            state = step[row[state * 16 + (byte >> 4)] * 16 + (byte & 15)]
            at = first[state]
            while True:
                token, n = found[at], sizes[at]
                if n == i:
                    break
                pair = last[i - n], token
                fits = answers.get(pair)
                if fits is None:
                    if len(answers) >= PAIRS:
                        answers.clear()
                    fits = answers[pair] = self._compatible(*pair)
                if fits:
                    break
                at += 1
            last[i] = token
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at -= int(self.size[last[at]])
        return np.array(ids[::-1], "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Exact ids of pre-tokenized pieces, as little-endian 32-bit integers.

        All pieces advance together, byte by byte: last[i, p] is the last token of p's first i bytes.
        """
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-lengths, kind="stable")
        most = int(lengths.max(initial=0))
        out: list[bytes] = [b""] * len(pieces)
        if not most:
            return out
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        begin = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        active = np.searchsorted(-lengths, -np.arange(most + 1), side="right")  # pieces of i bytes or more
        last = np.zeros((most + 1, len(pieces)), np.int64)
        state = np.zeros(len(pieces), np.int32)
        for i in range(1, most + 1):
            m = active[i]
            byte = raw[begin[:m] + i - 1]
            state = self.blocks[self.row[state[:m], byte >> 4], byte & 15]
            open_, candidate = np.arange(m), self.first[state]
            while len(open_):
                token, n = self.found_id[candidate], self.found_size[candidate]
                fits = n == i
                rest = np.flatnonzero(~fits)
                fits[rest] = self._fitting(last[i - n[rest], open_[rest]] << 32 | token[rest])
                last[i, open_[fits]] = token[fits]
                open_, candidate = open_[~fits], candidate[~fits] + 1
        # back-pointers, from the right end of each row of ids
        ids, at, who, k = np.zeros((len(pieces), most), np.uint32), lengths.copy(), np.arange(len(pieces)), most
        count = np.zeros(len(pieces), np.int64)
        while len(who):
            k -= 1
            token = last[at[who], who]
            ids[who, k] = token
            count[who] += 1
            at[who] -= self.size[token]
            who = who[at[who] > 0]
        for p, c, row in zip(order.tolist(), count.tolist(), ids.astype("<u4", copy=False)):
            out[p] = row[most - c :].tobytes()
        return out


class Codec:
    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """Cut a text where the pre-tokenizer always cuts; a piece may still hold several of its words."""
        if _RUN.search(text):
            return pretokenized(text)
        # no two white spaces meet: a new line is a word, and a space starts one
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit integers. Special tokens in a text become their ids."""
        v = self.vocabulary
        if len(self.known) > PIECES:
            self.old, self.known = self.known, {"": b""}
        cut = []
        for text in texts:
            if v.split_special is not None and v.split_special.search(text):
                spans = [m.span() for m in v.split_special.finditer(text)]
                edges = [0, *(e for span in spans for e in span), len(text)]
                parts = [text[a:b] for a, b in zip(edges, edges[1:])]
                cut.append([x for k, p in enumerate(parts) for x in ([p] if k % 2 else self.pieces(p))])
            else:
                cut.append(self.pieces(text))
        self._learn({p for pieces in cut for p in pieces if p not in self.known})
        get = self.known.__getitem__
        for pieces in cut:
            yield b"".join(map(get, pieces))

    def _learn(self, new: set[str]) -> None:
        """Make known the pieces of a batch. Bounded: when full, what was used since the last time stays a round more."""
        v, known, again = self.vocabulary, self.known, [p for p in new if p in self.old]
        for p in again:
            known[p] = self.old[p]
        for text, i in v.special.items():
            known[text] = i.to_bytes(4, "little")
        words = {p: pretokenized(p) for p in new.difference(again, known)}
        single = []
        for w in {w for ws in words.values() for w in ws if w not in known}:
            raw = w.encode()
            if len(raw) > LONG:
                known[w] = v.encode_long(raw)
            else:
                single.append(w)
        at = 0
        while at < len(single):  # few long pieces, or many short ones, at a time
            size, stop = 0, at
            while stop < len(single) and (stop == at or max(size, len(single[stop])) * (stop - at + 1) < 400_000):
                size, stop = max(size, len(single[stop])), stop + 1
            part = single[at:stop]
            known.update(zip(part, v.encode_pieces([w.encode() for w in part])))
            at = stop
        for p, ws in words.items():
            if len(ws) != 1 or p != ws[0]:
                known[p] = b"".join(known[w] for w in ws)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.vocabulary.token.__getitem__, memoryview(ids).cast("I").tolist())).decode("utf-8", "replace")


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    """One codec a Python worker and vocabulary."""
    return Codec(path)


def id_lists(raw: list[bytes]) -> pa.Array:
    """Little-endian 32-bit ids of texts as an array of lists, without a Python number for each."""
    ends = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32)))


def encoded(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<int>): exact ids of whole texts; null texts have none. One row per row of docs."""

    def each(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "ids": id_lists(list(codec(path).encode_batch(_texts(batch))))}

    return by_batch(_narrow(docs, text, doc_id), "doc_id long, ids array<int>", each, BATCH)


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); special tokens stay, broken UTF-8 becomes U+FFFD, null ids the empty text."""

    def each(batch: pa.RecordBatch) -> dict:
        decode = codec(path).decode
        texts = [decode(np.array(ids or [], "<u4").tobytes()) for ids in batch.column("ids").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "text": texts}

    return by_batch(tokens.select("doc_id", "ids"), "doc_id long, text string", each, BATCH)


def tokenised(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<int>, n_tokens, exact): ids of whole texts, and whether they decode to the text again."""

    def each(batch: pa.RecordBatch) -> dict:
        c, texts = codec(path), _texts(batch)
        raw = list(c.encode_batch(texts))
        return {
            "doc_id": batch.column("doc_id"),
            "ids": id_lists(raw),
            "n_tokens": [len(x) // 4 for x in raw],
            "exact": [c.decode(x) == t for x, t in zip(raw, texts)],
        }

    return by_batch(_narrow(docs, text, doc_id), "doc_id long, ids array<int>, n_tokens long, exact boolean", each, BATCH)


def round_trip(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, exact): encode and decode in one pass, ids stay in the task.

    Null counts as empty. Rows that repeat a doc_id keep a row each; other columns are not read.
    """

    def each(batch: pa.RecordBatch) -> dict:
        c, rows, texts = codec(path), [], _texts(batch)
        for t, ids in zip(texts, c.encode_batch(texts)):
            back = c.decode(ids)
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == t))
        return {"doc_id": batch.column("doc_id")} | dict(zip(("n_tokens", "ids_sha256", "decoded_sha256", "exact"), zip(*rows) if rows else [[]] * 4))

    return by_batch(_narrow(docs, text, doc_id), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean", each, BATCH)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _narrow(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
