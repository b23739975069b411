"""What the pipeline's Python workers hold at once while they work on a large batch of rows."""

import random
import tracemalloc

import corpus_pipeline
import pyarrow as pa
import pytest
from vecflow.llm import lsh_forest, packing, queries, shingles, tokens, toxicity

ROWS = 6000


@pytest.fixture(scope="module")
def texts():
    r = random.Random(8)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(3, 9))) for _ in range(3000)]
    return pa.array([" ".join(r.choices(words, k=260)) + "." for _ in range(ROWS)])  # some 11 MB


def held(work):
    """What work takes at its peak, in MB, and what it returns."""
    tracemalloc.start()
    try:
        got = work()
        return tracemalloc.get_traced_memory()[1] / 1e6, got
    finally:
        tracemalloc.stop()


def signed(texts):
    ids = pa.array(range(len(texts)), pa.int64())
    return next(lsh_forest._signatures([pa.RecordBatch.from_arrays([ids, ids, texts], names=["doc_id", "text_hash", "text"])]))


def test_signatures_hold_a_part_of_a_batch(texts, monkeypatch):
    most, got = held(lambda: signed(texts))
    assert most < 40
    monkeypatch.setattr(shingles, "CHUNK_BYTES", 2 << 20)
    assert got.equals(signed(texts))


def test_toxicity_holds_a_part_of_a_batch(spark, texts, monkeypatch):
    model = toxicity.Model(-6.0, {i: 0.5 for i in range(0, toxicity.DIMENSIONS, 50)})
    apply = toxicity.scorer(model).func
    few = texts.slice(0, 600)
    want = apply(few)
    most, _ = held(lambda: toxicity.scorer(model).func(pa.array(["a b " * 1000] * ROWS)))  # 24 MB of text
    assert most < 12
    monkeypatch.setattr(toxicity, "ROWS", 7)
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 10)
    assert toxicity.scorer(model).func(few).equals(want)


def test_training_starts_no_python_workers_for_its_sample(spark, monkeypatch):
    rows = [(i, f"calm word{i % 7}." + " horrid" * (i % 3 == 0)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    want = toxicity.fit(docs, labels)

    def refused(*_, **__):
        raise AssertionError("rows went through Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    assert toxicity.fit(docs, labels) == want and want.weights


class Table:
    """Stands for the rows, and keeps what mapInArrow is given."""

    def select(self, *_):
        return self

    def mapInArrow(self, work, schema):
        return work


def test_packing_holds_a_part_of_a_batch(spark, texts, monkeypatch):
    path = queries.vocabulary("word_bpe_49k.json")
    batch = pa.RecordBatch.from_arrays([pa.array(range(ROWS), pa.int64()), texts], names=["doc_id", "text"])
    work = packing.cut(Table(), path, 1, 4096, kept=corpus_pipeline.KEPT_PIECES)
    tokens.encoder.cache_clear()
    most, got = held(lambda: [sum(b.num_rows for b in work([batch]))])
    assert got == [ROWS] and most < 25
    first = lambda work: pa.Table.from_batches(work([batch.slice(0, 700)]))
    want = first(work)
    monkeypatch.setattr(packing, "ROWS", 5)
    assert first(packing.cut(Table(), path, 1, 4096, kept=20)).equals(want)
