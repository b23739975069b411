"""Hashes of word shingles, computed on whole Arrow batches.

Words are runs of letters and digits, in lower case; a shingle is five words in a row. A text of
one to four words is a single shingle, a text without words (or null) has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
#: Text hashed at once, which takes some sixty times its size.
CHUNK_BYTES = 1 << 18

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash and the length in bytes of each word."""
    offsets = np.frombuffer(words.buffers()[1], np.int32 if pa.types.is_string(words.type) else np.int64)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    length = np.diff(offsets)
    if not length.sum():
        return np.zeros(len(words), np.uint64), length
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets[:-1] - offsets[0]
    place = np.arange(len(data)) - np.repeat(starts, length)
    term = _BYTE[data] * powers(_STEP, int(length.max()))[place]
    full = length > 0
    out = np.zeros(len(words), np.uint64)
    out[full] = np.add.reduceat(term, starts[full])
    return mixed(out + length.astype(np.uint64)), length


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + CHUNK_BYTES)))
        yield texts.slice(at, to - at)
        at = to


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for part in _parts(texts.cast(pa.large_string()) if not len(texts) else texts):
        plain = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(part, "")), r"[^\p{L}\p{N}]+", " "))
        lists = pc.utf8_split_whitespace(plain)
        words, length = _word_hashes(lists.flatten())
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        rolled = np.zeros(len(words), np.uint64)
        for k, p in enumerate(powers(_NEXT, WORDS)):
            rolled[: len(words) - k] += words[k:] * p
        rolled = mixed(rolled)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= WORDS:
                yield np.unique(rolled[a : b - WORDS + 1])
            elif b > a and length[a:b].any():
                yield mixed(np.array([(words[a:b] * powers(_NEXT, WORDS)[: b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
