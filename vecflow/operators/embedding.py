"""Texts to vectors: what an embedder and a tokenizer have to do, and those that need no model."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


class Embedder(Protocol):
    """dimension, and texts to the rows of a matrix. Instances are sent to the workers, where a model is
    best loaded at the first call."""

    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class Tokenizer(Protocol):
    def tokens(self, text: Column) -> Column: ...


class HashEmbedder:
    """A random unit vector that depends on the text only: its generator's seed is the first half of
    the text's MD5 digest, modulo 2 ** 31."""

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), self.dimension), np.float32)
        random = np.random.RandomState(0)  # made once: to make one draws a seed from the system
        for i, text in enumerate(texts):
            seed = int(hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % 2**31
            random.seed(seed)
            row = random.randn(self.dimension).astype(np.float32)
            out[i] = row / max(float(np.linalg.norm(row)), 1e-12)
        return out


class _WordHashes(dict):
    """Words with the first 64 bits of their MD5 digests, made once. Emptied when there are MOST_WORDS."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[:8], "little")
        return h


#: Words that a worker knows at most, and texts whose words are counted at once.
MOST_WORDS, TERM_ROWS = 1 << 19, 1024
word_hashes = _WordHashes()


class TermEmbedder:
    """Words hashed to signed dimensions and summed, as a unit vector: texts that share words are near
    each other, without a model. An empty text is the zero vector."""

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for a in range(0, len(texts), TERM_ROWS):
            words = [text.lower().split() for text in texts[a : a + TERM_ROWS]]
            h = np.fromiter(map(word_hashes.__getitem__, itertools.chain.from_iterable(words)), np.uint64)
            places = np.repeat(np.arange(len(words)) * self.dimension, [len(w) for w in words]) + (h % np.uint64(self.dimension)).astype(np.int64)
            signs = np.where(h >> np.uint64(63), 1.0, -1.0)
            out[a : a + TERM_ROWS] = np.bincount(places, signs, len(words) * self.dimension).reshape(len(words), -1)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class WhitespaceTokenizer:
    def tokens(self, text: Column) -> Column:
        return T.tokens(text)


class WordSegmenter:
    """A slot for a segmenter (text -> words); without one, words are what blanks part."""

    def __init__(self, segment: Callable[[str], list[str]] | None = None):
        self.segment = segment

    def tokens(self, text: Column) -> Column:
        if self.segment is None:
            return T.tokens(text)
        segment = self.segment

        @F.arrow_udf("array<string>")
        def words(texts: pa.Array) -> pa.Array:
            return pa.array([segment(t) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

        return words(T.text_or_empty(text))


def embedded(rows: DataFrame, embedder: Embedder, text: str, name: str = "v") -> DataFrame:
    """rows with the vector of a text column; a null text is empty. Texts go to the workers in batches."""

    @F.arrow_udf("array<double>")
    def encode(texts: pa.Array) -> pa.Array:
        found = embedder.encode([t or "" for t in texts.to_pylist()]).astype(np.float64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * embedder.dimension, pa.int32()), pa.array(found.ravel()))

    return rows.withColumn(name, encode(F.col(text).cast("string")))
