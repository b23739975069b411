"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its distinct
features (words and word beginnings, hashed); the document's score is the noisy-or of them,
``1 - prod(1 - p_sentence)``. Only document labels are needed: the gradient of the document's
log-likelihood goes through the noisy-or to the sentences. A sparse penalty leaves weights on
the few features that matter, so single sentences can be pointed out afterwards.

Null and empty texts, and texts without letters, hold no sentence and score 0. Labels that are
null are ignored; a document labelled more than once counts as toxic if any of its labels says so.
Without any usable label every document scores 0. Training reads a sample of labelled documents
(in the order of a hash of their id) bounded by max_documents and by max_chars in all: a document
that would go beyond max_chars is left out, later ones that fit are not. Scoring reads every whole text. A row without an id is never held out and never learned from. Rows that repeat are
scored alike; other columns stay as they are; an empty table stays empty.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: Longer sentences are scored in pieces of so many words.
PIECE_WORDS = 64
DIMENSIONS = 1 << 18
BEGINNINGS = (4, 5)
MAX_TRAINING_DOCUMENTS, MAX_TRAINING_CHARS = 6000, 48_000_000
EPOCHS, STEP, PENALTY = 80, 0.2, 1e-4
#: Features that a training step holds in double precision at once, which bounds the driver's memory.
TRAINED_AT_ONCE = 1 << 19
OFFENDING = 0.2
FOLDS, HELD_OUT = 5, 0
#: Texts that a worker holds as Python objects at once, and words whose features it keeps.
ROWS, KEPT_WORDS = 256, 150_000

RESULT = "struct<score: double, predicted: int, offending: array<struct<start: int, end: int, score: double>>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def features(word: str) -> tuple[int, ...]:
    """Hashes of a lower-case word and of its beginnings."""
    parts = [word] + [f"^{word[:n]}" for n in BEGINNINGS if len(word) > n - 1]
    return tuple(zlib.crc32(p.encode()) % DIMENSIONS for p in parts)


def held_out(doc_id: Column) -> Column:
    """True for the rows that training must not see."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[int, float]


def sentences(text: str):
    """(start, end, words) of each sentence or piece of one; words are lower-case."""
    lower = text.lower()
    same = len(lower) == len(text)
    for m in SENTENCE.finditer(lower):
        words = list(WORD.finditer(m.group()))
        for i in range(0, len(words), PIECE_WORDS):
            part = words[i : i + PIECE_WORDS]
            a, b = m.start() + part[0].start(), m.start() + part[-1].end()
            yield (a if same else min(a, len(text)), b if same else min(b, len(text)), [w.group() for w in part])


def _bags(batches):
    memo: dict[str, tuple[int, ...]] = {}
    for batch in batches:
        ids, labels, texts = batch.columns
        sizes, bags = [], []
        for text in (t for i in range(0, len(texts), ROWS) for t in texts.slice(i, ROWS).to_pylist()):
            if len(memo) > KEPT_WORDS:
                memo.clear()
            size, bag = [], []
            for _, _, words in sentences(text or ""):
                got = set()
                for w in words:
                    if (f := memo.get(w)) is None:
                        f = memo[w] = features(w)
                    got.update(f)
                size.append(len(got))
                bag.extend(sorted(got))
            sizes.append(size)
            bags.append(bag)
        yield pa.RecordBatch.from_pydict({"doc_id": ids, "toxic": labels, "sizes": pa.array(sizes, pa.list_(pa.int32())), "features": pa.array(bags, pa.list_(pa.int32()))})


def train(labels: np.ndarray, sentence_counts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> Model:
    """Full-batch Adam with a proximal L1 step on the noisy-or likelihood.

    labels and sentence_counts are by document, sizes (distinct features) by sentence, flat holds
    all sentences' features one after another. Features seen less than three times are left out."""
    used = sentence_counts > 0
    if not used.any() or labels[used].min() == labels[used].max():
        return Model(-30.0, {})
    y, n = labels[used].astype(np.float32), int(used.sum())
    owner = np.repeat(np.arange(n, dtype=np.int32), sentence_counts[used])
    sentence = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    parts = lambda: range(0, len(flat), TRAINED_AT_ONCE)
    often = sum((np.bincount(flat[i : i + TRAINED_AT_ONCE], minlength=DIMENSIONS) for i in parts()), np.zeros(DIMENSIONS, np.int64)) >= 3
    used_features = often[flat]
    sentence, flat = sentence[used_features], flat[used_features]
    w, m, v = (np.zeros(DIMENSIONS) for _ in range(3))
    b, mb, vb = -6.0, 0.0, 0.0
    for k in range(1, EPOCHS + 1):
        z = np.full(len(sizes), b)
        for i in parts():
            z += np.bincount(sentence[i : i + TRAINED_AT_ONCE], w[flat[i : i + TRAINED_AT_ONCE]], minlength=len(sizes))
        z = np.clip(z, -30, 30)
        p = 1 / (1 + np.exp(-z))
        document = np.clip(-np.expm1(-np.bincount(owner, np.logaddexp(0, z), minlength=n)), 1e-6, 1 - 1e-6)
        back = np.where(y == 1, -(1 - document) / document, 1.0)[owner] * p
        g, gb = np.zeros(DIMENSIONS), back.sum() / n
        for i in parts():
            g += np.bincount(flat[i : i + TRAINED_AT_ONCE], back[sentence[i : i + TRAINED_AT_ONCE]], minlength=DIMENSIONS) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        scale = STEP / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
        w = w - scale * m / (1 - 0.9**k)
        w = np.where(often, np.sign(w) * np.maximum(np.abs(w) - PENALTY * scale, 0), 0.0)
        b -= 0.3 * STEP * mb / (1 - 0.9**k) / (np.sqrt(vb / (1 - 0.99**k)) + 1e-6)
    return Model(float(b), {int(i): float(w[i]) for i in np.flatnonzero(w)})


def fit(docs: DataFrame, labels: DataFrame, max_documents: int = MAX_TRAINING_DOCUMENTS, max_chars: int = MAX_TRAINING_CHARS) -> Model:
    """Learns from labels (doc_id, toxic) outside the held-out fold. The driver gets the hashed
    features of max_documents documents of max_chars characters in all at most."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_documents)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.sum(F.length("text")).alias("chars"))  # max_documents rows at most
    fitting, left = [], max_chars
    for x in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if (x.chars or 0) <= left:
            fitting.append((x.doc_id, x.toxic))
            left -= x.chars or 0
    # from Arrow, which starts no Python workers
    few = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array([i for i, _ in fitting], pa.int64()), "toxic": pa.array([t for _, t in fitting], pa.int32())}))
    bags = (
        texts.join(F.broadcast(few), "doc_id")
        .select("doc_id", "toxic", "text")
        .mapInArrow(_bags, "doc_id long, toxic int, sizes array<int>, features array<int>")
        .toArrow()
        .sort_by("doc_id")
    )
    toxic = (bags["toxic"].to_numpy() > 0).astype(int)
    sizes = bags["sizes"].combine_chunks()
    counts = sizes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes, flat = sizes.flatten().to_numpy(), bags["features"].combine_chunks().flatten().to_numpy()
    del bags
    model = train(toxic, counts, sizes, flat)
    del sizes, flat
    pa.default_memory_pool().release_unused()
    return model


def scorer(model: Model):
    """An Arrow function text -> RESULT."""
    bias, weights = model.bias, model.weights
    empty = float(np.logaddexp(0, bias))
    memo: dict[str, tuple[int, ...]] = {}

    def known(word: str) -> tuple[int, ...]:
        if (f := memo.get(word)) is None:
            if len(memo) > KEPT_WORDS:
                memo.clear()
            f = memo[word] = tuple(x for x in features(word) if x in weights)
        return f

    def score(text: str) -> tuple[float, list[dict]]:
        total, spans = 0.0, []
        lower = text.lower()
        for m in SENTENCE.finditer(lower):
            words = WORD.findall(m.group())
            if len(words) <= PIECE_WORDS:
                hits = set().union(*[f for f in map(known, words) if f]) if words else None
                if hits is None:
                    continue
                if not hits:
                    total += empty
                    continue
            elif not any(map(known, words)):
                total += empty * -(-len(words) // PIECE_WORDS)
                continue
            for a, b, part in sentences(m.group()):
                z = bias + sum(weights[x] for x in set().union(*map(known, part)))
                total += float(np.logaddexp(0, z))
                if (p := 1 / (1 + np.exp(-z))) >= OFFENDING:
                    spans.append({"start": min(m.start() + a, len(text)), "end": min(m.start() + b, len(text)), "score": float(p)})
        return -float(np.expm1(-total)), spans

    @F.arrow_udf(RESULT)
    def apply(texts: pa.Array) -> pa.Array:
        got = [score(t) if t else (0.0, []) for i in range(0, len(texts), ROWS) for t in texts.slice(i, ROWS).to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([s for s, _ in got], pa.float64()), pa.array([int(s >= 0.5) for s, _ in got], pa.int32()), pa.array([x for _, x in got], pa.list_(_SPAN))],
            names=["score", "predicted", "offending"],
        )

    return apply


def with_toxicity(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """docs with a column of RESULT; it replaces a column of that name. All other columns stay."""
    return docs.withColumn(column, scorer(model)(F.col("text").cast("string")))
