import hashlib
import random
import re

from tidemark.llm.decontaminate import benchmark_hits, contamination, decontaminated

from .helpers import AWKWARD, clashing, docs_frame, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = set()
    for doc, text in enumerate(texts):
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if x := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= x
        out.add((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def case():
    rng = random.Random(11)
    items = [(i, " ".join(prose(rng, rng.choice([0, 1, 3, 9, 10, 11, 40]), 30))) for i in range(40)]
    items += [(40, None), (41, items[5][1]), (42, "Word word WORD, word")]
    texts = list(AWKWARD)
    for _ in range(80):
        t = prose(rng, rng.randrange(0, 80), 60)
        if rng.random() < 0.5:
            own = words(rng.choice(items)[1])
            a = rng.randrange(len(own) + 1)
            t[5:5] = own[a : a + rng.randrange(1, 30)]
        texts.append(" ".join(t))
    return texts, items


def test_against_brute_force(spark):
    texts, items = case()
    docs = clashing(docs_frame(spark, texts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r)[:6] for r in contamination(docs, bench).collect()}
    assert got == brute(texts, items)
    sharded = {(r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in benchmark_hits(docs, bench, shard_words=100).collect()}
    assert sharded == {x[:4] for x in got}


def test_cutting(spark):
    texts = ["clean text stays  as\nit is", "before the long text one two three four five six seven eight nine ten after the text more and more words", "one two three four five six seven eight nine ten", None]
    bench = spark.createDataFrame([(1, "One two three four five six seven eight nine ten")], "item_id long, text string")
    for shard_words in (500_000, 8):
        got = {r.doc_id: (r.text, r.n_chars) for r in decontaminated(docs_frame(spark, texts), bench, shard_words=shard_words).collect()}
        left = "before the long text after the text more and more words"
        assert got == {0: (texts[0], len(texts[0])), 1: (left, len(left)), 3: (None, None)}


def test_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs_frame(spark, []), bench).collect() == []
    assert {r.n_hit for r in contamination(docs_frame(spark, AWKWARD), bench).collect()} == {0}
    assert decontaminated(docs_frame(spark, AWKWARD), bench).count() == len(AWKWARD)


def test_null_and_repeated_ids_in_several_shards(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(None, f"first text {item} and more words that stay in the text after it"), (None, "clean and short"), (None, None)]
    rows += [(5, "clean text of a repeated number"), (5, f"a b c d e f g h i j k l m n {item}"), (5, item), (6, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "red green blue grey pink black white brown cyan gold"), (3, "a b c d")], "item_id long, text string")

    def hits(shard_words):
        return sorted(repr(r) for r in benchmark_hits(docs, bench, shard_words=shard_words).collect())

    extra = docs.selectExpr("*", "1 AS _row", "2 AS ROW", "3 AS spans", "4 AS _spans", "5 AS _hit_id", "6 AS items")

    def left(shard_words):
        out = decontaminated(extra, bench, shard_words=shard_words)
        assert out.columns == extra.columns
        return sorted(repr(r) for r in out.collect())

    assert len(hits(8)) == len(rows) and hits(8) == hits(500_000)
    assert len(left(8)) == 5 and left(8) == left(500_000)


def test_any_number_of_shards_gives_the_same_rows(spark):
    texts, items = case()
    docs = docs_frame(spark, texts + texts[:30], first=0).unionByName(docs_frame(spark, texts[20:50]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = ([sorted(repr(r) for r in f(docs, bench, shard_words=k).collect()) for f in (benchmark_hits, decontaminated)] for k in (500_000, 250))
    assert one == many and len(one[0]) == docs.count()
