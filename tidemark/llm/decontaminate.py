"""Benchmark decontamination with a generalised suffix automaton of the benchmark's words.

The automaton of all items is built once from the normalised items and broadcast; each document's words
stream through it and every position learns the longest benchmark passage that ends there. Passages of
`window` words (or a whole shorter item) mark their words as hit. Words outside the benchmark's vocabulary
reset the automaton, so only runs of known words are walked.

A benchmark beyond `shard_words` words is dealt to shards by item; each shard has its own automaton, is
streamed in turn, and the hits are merged. So driver and executors hold one bounded shard at a time.
"""

from __future__ import annotations

import itertools
import math
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, chunks, fresh, raw_bytes, staged

WINDOW = 10
#: Bound of an automaton: 40 to 110 MB in each Python worker, depending on the vocabulary.
SHARD_WORDS = 500_000

HITS = "_row long, doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,stop:int>>, longest int"

# One pass: lower-case A-Z and turn every ASCII byte that is not a digit or letter into a space.
_WORDS = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items of every window.

    It is built with a table of steps a state; what is sent on are flat arrays: a state's first step (most have
    no other), the steps of the root by word, and one table for the further steps of states that branch.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW, shortest: int | None = None):
        """shortest: words of the shortest item, if there are others than these."""
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])
        ends: dict[int, set[str]] = {}
        whole: dict[int, list[tuple[int, str]]] = {}
        self.shortest = min(window, shortest or window)
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            state = 0
            for x in ids:
                state = self._extend(state, x)
                ends.setdefault(state, set()).add(item)
            if 0 < len(ids) < window:
                self.shortest = min(self.shortest, len(ids))
        # whole short items: where their words lead, once no state is split any more
        for item, words in items:
            if 0 < len(words) < window:
                state = 0
                for w in words:
                    state = self.step[state][self.vocabulary[w]]
                whole.setdefault(state, []).append((len(words), item))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for s in reversed(order):  # a state occurs wherever its longer extensions do
            if s in ends and self.length[self.link[s]] >= window:
                ends.setdefault(self.link[s], set()).update(ends[s])
            elif s in ends and self.link[s] and self.length[s] < window:
                ends.pop(s)
        # the items of the last `window` words, and whole short items on the way to the root
        self.sets: list[frozenset[str]] = [frozenset()]
        numbers: dict[frozenset[str], int] = {self.sets[0]: 0}
        self.items = array("i", bytes(4 * len(self.link)))
        self.short: dict[int, list[tuple[int, str]]] = {}
        for s in order:
            up = self.link[s]
            if self.length[up] >= window:
                self.items[s] = self.items[up]
            elif self.length[s] >= window:
                own = frozenset(ends.get(s, ()))
                self.items[s] = numbers.setdefault(own, len(self.sets))
                if self.items[s] == len(self.sets):
                    self.sets.append(own)
            if found := whole.get(s, []) + self.short.get(up, []):
                self.short[s] = found
        self._flatten()

    def _flatten(self) -> None:
        n = len(self.link)
        self.root = array("i", bytes(4 * len(self.vocabulary)))
        for x, t in self.step[0].items():
            self.root[x] = t
        self.first_word, self.first_next = array("i", [-1]) * n, array("i", bytes(4 * n))
        self.further: dict[int, int] = {}
        for s in range(1, n):
            for k, (x, t) in enumerate(self.step[s].items()):
                if k:
                    self.further[s << 32 | x] = t
                else:
                    self.first_word[s], self.first_next[s] = x, t
        del self.step

    def _extend(self, last: int, x: int) -> int:
        step, link, length = self.step, self.link, self.length
        if x in step[last]:
            q = step[last][x]
            return q if length[q] == length[last] + 1 else self._split(last, q, x)
        new = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and x not in step[p]:
            step[p][x] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = step[p][x]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, x)
        return new

    def _split(self, p: int, q: int, x: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.step[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.step[p].get(x) == q:
            self.step[p][x] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int, step: dict[int, int]) -> int:
        self.step.append(step)
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """(hit spans of word positions, items with occurring windows, longest match) of a document."""
        get = self.vocabulary.get
        known = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(known >= 0, prepend=False, append=False))
        starts, stops = edges[::2], edges[1::2]
        long = stops - starts >= self.shortest
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        longest = 0
        link, length, window = self.link, self.length, self.window
        root, first_word, first_next, further = self.root, self.first_word, self.first_next, self.further
        for start, stop in zip(starts[long].tolist(), stops[long].tolist()):
            s = n = 0
            for i, x in enumerate(known[start:stop].tolist(), start):
                while True:
                    if not s:  # every known word leaves the root
                        s = root[x]
                        break
                    if first_word[s] == x:
                        s = first_next[s]
                        break
                    if t := further.get(s << 32 | x):
                        s = t
                        break
                    s = link[s]
                    n = length[s]
                n += 1
                longest = max(longest, n)
                if n >= window:
                    found |= self.sets[self.items[s]]
                    _mark(spans, i - window + 1, i + 1)
                for size, item in self.short.get(s, ()):
                    if size <= n:
                        found.add(item)
                        _mark(spans, i - size + 1, i + 1)
        return spans, found, longest if longest >= self.shortest else 0


def _mark(spans: list[tuple[int, int]], start: int, stop: int) -> None:
    """Add [start, stop) to disjoint spans sorted by stop, merging those it touches."""
    while spans and spans[-1][1] >= start:
        start = min(start, spans.pop()[0])
    spans.append((start, stop))


def _shards(benchmark: DataFrame, shard_words: int, window: int) -> Iterator[Automaton]:
    items = benchmark.where("item_id IS NOT NULL").select(
        F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    # a word and what ends it take two bytes at least
    most = items.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0] / 2
    shards = max(1, math.ceil(most / shard_words))
    shortest = None
    if shards > 1:
        n_words = by_batch(items.select("text"), "n long", lambda batch: {"n": [len(words_of(t)) for t in raw_bytes(batch.column("text"))]})
        shortest = n_words.where("n > 0").agg(F.min("n")).first()[0]
    for k in range(shards):
        own = items if shards == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k)
        yield Automaton([(r.item_id, words_of(r.text.encode())) for r in own.toLocalIterator()], window, shortest)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, items array, spans array<struct<start,stop>>, longest) per row of docs.

    Spans are half-open word positions; longest is the longest match of at least a window or a whole item, else 0. Null texts have no words; items with null text or id never hit.
    Rows that repeat a doc_id, or have none, keep a row each. Other columns are not read. Empty tables give
    no rows or no hits. For several shards the documents are staged once with a row number, by which the
    shards' hits are merged.
    """
    shards = _shards(benchmark, shard_words, window)
    ahead = list(itertools.islice(shards, 2))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if len(ahead) == 1:
        return _hits(narrow, ahead[0]).drop("_row")
    return _merged(_numbered(narrow, "_row"), itertools.chain(ahead, shards)).drop("_row")


def _numbered(docs: DataFrame, row: str) -> DataFrame:
    """docs, staged, with a number of each row."""
    return staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")


def _hits(narrow: DataFrame, automaton: Automaton) -> DataFrame:
    """The hits of one shard per row of (doc_id, text), with _row if there is one."""
    if "_row" not in narrow.columns:
        narrow = narrow.withColumn("_row", F.lit(None).cast("long"))
    shared = narrow.sparkSession.sparkContext.broadcast(automaton)

    def each(batch: pa.RecordBatch) -> dict:
        rows = []
        for text in raw_bytes(batch.column("text")):
            words = words_of(text)
            spans, found, longest = shared.value.search(words)
            rows.append((len(words), sum(b - a for a, b in spans), sorted(found), [{"start": a, "stop": b} for a, b in spans], longest))
        names = ("n_words", "n_hit", "items", "spans", "longest")
        return {c: batch.column(c) for c in ("_row", "doc_id")} | dict(zip(names, zip(*rows) if rows else [[]] * 5))

    return by_batch(narrow, HITS, each)


def _merged(numbered: DataFrame, shards: Iterable[Automaton]) -> DataFrame:
    """The hits of all shards per row of (_row, doc_id, text); one shard is streamed at a time."""
    merged = None
    for automaton in shards:
        part = _hits(numbered, automaton)
        # a shard without hits may still have the longest match
        part = staged(part if merged is None else part.where("longest > 0"), "hits")
        merged = part if merged is None else merged.unionByName(part)
    lists = merged.groupBy("_row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.max("longest").alias("longest"),
    )

    def each(batch: pa.RecordBatch) -> dict:
        spans = [_union([(x["start"], x["stop"]) for x in row]) for row in batch.column("spans").to_pylist()]
        out = {c: batch.column(c) for c in ("_row", "doc_id", "n_words", "items", "longest")}
        return out | {"n_hit": [sum(b - a for a, b in own) for own in spans], "spans": [[{"start": a, "stop": b} for a, b in own] for own in spans]}

    return by_batch(lists, HITS, each)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of benchmark_hits that op2 returns."""
    return benchmark_hits(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = WINDOW, max_coverage: float = 0.5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs without benchmark passages: rows whose hit words exceed max_coverage go, hit spans of the rest are cut.

    Cut spans leave one space; texts without hits keep their bytes. All columns of docs stay; n_chars, if
    there is one, is set anew where the text changed. A benchmark of one shard is cut while the documents
    stream by; for several, the merged hits are joined on a row number first.
    """
    names = docs.columns
    shards = _shards(benchmark, shard_words, min_words)
    ahead = list(itertools.islice(shards, 2))
    if len(ahead) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(ahead[0])
        known, plan = docs, docs.schema

        def spans_of(batch: pa.RecordBatch, texts: list[bytes | None]) -> list[list[tuple[int, int]]]:
            return [shared.value.search(words_of(t))[0] for t in texts]

    else:
        row, own_spans = fresh(docs, "row", "spans")
        numbered = _numbered(docs, row)
        narrow = numbered.select(F.col(row).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        hits = _merged(narrow, itertools.chain(ahead, shards)).select(F.col("_row").alias(row), F.col("spans").alias(own_spans))
        known, plan = numbered.join(hits, row).select(*names, own_spans), docs.schema

        def spans_of(batch: pa.RecordBatch, texts: list[bytes | None]) -> list[list[tuple[int, int]]]:
            return [[(x["start"], x["stop"]) for x in row or ()] for row in batch.column(own_spans).to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (c for b in batches for c in chunks(b)):
            texts, keep = raw_bytes(batch.column(names.index("text")).cast(pa.string())), []
            cut: list[str | None] = []
            for text, spans in zip(texts, spans_of(batch, texts)):
                hit = sum(b - a for a, b in spans)
                keep.append(not hit or hit <= max_coverage * len(words_of(text)))
                cut.append(None if text is None else _without(text, spans) if spans else text.decode())
            columns = [batch.column(i) for i in range(len(names))]
            fields = [batch.schema.field(i) for i in range(len(names))]
            columns[names.index("text")] = pa.array(cut, fields[names.index("text")].type)
            if "n_chars" in names:
                at = names.index("n_chars")
                old = columns[at].to_pylist()
                same = [c is None or t == c.encode() for t, c in zip(texts, cut)]
                columns[at] = pa.array([o if s else len(c) for o, s, c in zip(old, same, cut)], fields[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields)).filter(pa.array(keep))

    return known.mapInArrow(run, plan)


def _without(text: bytes, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and what stands between them."""
    clean = np.frombuffer(text.translate(_WORDS), np.uint8) != 32
    edges = np.flatnonzero(np.diff(clean, prepend=False, append=False))
    starts, stops = edges[::2].tolist(), edges[1::2].tolist()
    out, at = [], 0
    for a, b in spans:
        part = text[at : starts[a]].rstrip()
        out.append(part.lstrip() if at else part)
        at = stops[b - 1]
    out.append(text[at:].lstrip() if at else text[at:])
    return b" ".join(x for x in out if x).decode()
