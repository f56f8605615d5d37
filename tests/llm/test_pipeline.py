import re

from .helpers import AWKWARD, DOCS, docs_frame
from .test_decontaminate import brute as leaks
from .test_decontaminate import words
from .test_near import brute as groups

SF = "/root/testdata/sf0.001"


def brute(docs, items, keep):
    """doc_ids and texts that the stages after language ID leave of (doc_id, text) rows."""
    seen, left = set(), []
    for i, t in sorted(docs):
        n = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        if i in keep and n not in seen:
            seen.add(n)
            left.append((i, t))
    label = groups([t for _, t in left])
    left = [left[k] for k in sorted(set(label))]
    out = {}
    for (i, t), hit in zip(left, sorted(leaks([t for _, t in left], items))):
        if hit[2] <= 0.5 * hit[1] or not hit[2]:
            out[i] = hit[1] - hit[2]
    return out


def test_against_brute_force(spark):
    import corpus_pipeline as p
    from tidemark.llm.bpe import decoded
    from tidemark.llm.queries import vocabulary_path

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    keep = {r.doc_id for r in p.language_id(spark, frame, SF).collect()}
    assert {i for i, t in docs if t and re.search(r"[^\W\d_]{20}", t)} <= keep
    got = p.run(spark, SF)
    want = brute(docs, items, keep)
    assert {r.doc_id for r in got.collect()} == set(want)
    texts = {r.doc_id: r.text for r in decoded(got, vocabulary_path()).collect()}
    assert {i: len(words(t)) for i, t in texts.items()} == want
    assert all(r.exact for r in got.collect())


def test_stages_keep_columns_and_awkward_rows(spark):
    import corpus_pipeline as p

    docs = docs_frame(spark, AWKWARD + AWKWARD, DOCS)
    for name, stage in p.STAGES[1:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        assert stage(spark, docs.where("false"), SF).count() == 0
    assert p.STAGES[0][1](spark, docs.where("false"), SF).count() == 0
    assert p.bpe(spark, docs, SF).count() == docs.count()


def test_batches_of_long_texts_are_bounded_in_bytes(spark):
    import corpus_pipeline as p
    import pyarrow as pa
    from tidemark.llm.common import ARROW_BYTES, short_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    try:
        docs = docs_frame(spark, ["ab " * 20_000] * 300).coalesce(1)
        for _, stage in p.STAGES:
            spark.conf.unset(key)
            stage(spark, docs_frame(spark, []), SF)
            assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) <= ARROW_BYTES + 100_000
        spark.conf.set(key, 1 << 20)
        short_batches(spark)
        assert spark.conf.get(key) in ("1048576", "1048576b")
    finally:
        spark.conf.set(key, before)
