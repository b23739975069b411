"""Nearest neighbours by cosine: multi-index hashing over learned binary codes.

Vectors are centred, turned by their principal axes and ROTATIONS rotations that are learned
(iterative quantization) so that the signs lose little; the signs under all of them are the code.
Codes are cut into substrings of SUBSTRING_BITS bits and each substring is indexed. Two codes that
differ in at most r bits differ in at most r // substrings bits in one substring at least
(pigeonhole), so probing every substring's index up to a radius of s bits retrieves every code
within substrings * (s + 1) - 1 bits. What it retrieves is ranked by the exact cosine of the
original vectors.

A query's radius is found as it is searched. A bounded sample teaches how far codes of a given cosine
lie apart, and how much that varies: reach() is the distance that the wanted share of neighbours of
that cosine keep to. Probing begins with equal substrings and goes on bit by bit until all codes
within the reach of the k-th best cosine found so far are retrieved; whatever could still be better
is, with the wanted probability, among them. The nearer a table's neighbours are, the less is probed.
A query that finds fewer than k candidates is probed on, up to all rows, so every query gets k answers
where the table has them.

The index is held in shards of bounded size, each in one task; the queries lie in the shared folder
and every shard reads them block by block, so neither is copied. A query's answers of all shards, k
each, are merged at the end.

Vectors that are null, zero, or hold null or non-finite components take no part, neither do rows
whose id is null. Vectors of different lengths are tables of their own: each is searched among those
of its length. Ties go to the smaller id; rows that repeat an id are candidates of their own, but a
row with the query's id is never its neighbour. Rows that repeat a query's id are one query, which is
as near to a row as the nearest of them. No valid vector: an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import parquet_batches
from .storage import stored, workdir

SAMPLE = 6000
SAMPLE_QUERIES = 400
WANTED = 0.95
SUBSTRING_BITS = 16
#: Rotations that a code holds the signs of, and turns that each is learned in.
ROTATIONS, TURNS = 2, 30
SHARD_ROWS, QUERY_BLOCK = 16_384, 4096


@dataclass(frozen=True)
class Coder:
    mean: np.ndarray
    turn: np.ndarray
    #: How many standard deviations beyond the mean distance neighbours keep to.
    spread: float

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The substrings of the vectors' codes, padded to whole 64-bit words."""
        bits = (x / np.linalg.norm(x, axis=1, keepdims=True) - self.mean) @ self.turn > 0
        return np.ascontiguousarray(np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1)).view(np.uint16)

    def reach(self, cosine: float | np.ndarray) -> float | np.ndarray:
        """The distance that codes of vectors of that cosine keep to."""
        n = self.turn.shape[1]
        p = np.arccos(np.clip(cosine, -1, 1)) / np.pi
        return n * p + self.spread * np.sqrt(n * p * (1 - p) + 1)


def apart(code: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """In how many bits each of codes differs from code."""
    return np.bitwise_count(codes.view(np.uint64) ^ code.view(np.uint64)).sum(axis=1, dtype=np.int64)


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """einsum: equal vectors get equal sums, wherever they stand."""
    return np.einsum("ij,j->i", rows, query) / np.sqrt(np.einsum("ij,ij->i", rows, rows) * np.einsum("i,i->", query, query))


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best, ties to the smaller id."""
    if len(score) > 4 * k:
        among = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return among[np.lexsort((ids[among], -score[among]))[:k]]
    return np.lexsort((ids, -score))[:k]


def learn(sample: np.ndarray, k: int, wanted: float = WANTED, seed: int = 7) -> Coder:
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    z = unit - mean
    axes = np.linalg.eigh(z.T @ z)[1][:, ::-1]
    z = z @ axes
    random, turns = np.random.default_rng(seed), []
    for _ in range(ROTATIONS):
        rotation = np.linalg.qr(random.normal(size=(z.shape[1],) * 2))[0]
        for _ in range(TURNS):
            u, _, vt = np.linalg.svd(np.where(z @ rotation > 0, 1.0, -1.0).T @ z)
            rotation = (u @ vt).T
        turns.append(axes @ rotation)
    coder = Coder(mean, np.concatenate(turns, axis=1), 0.0)
    codes, ids = coder.codes(sample), np.arange(len(sample))
    off = []
    for q in np.unique(np.linspace(0, len(sample) - 1, min(len(sample), SAMPLE_QUERIES)).astype(int)):
        others = ids[ids != q]
        score = cosines(sample[q], sample[others])
        near = best(others, score, k)
        p = np.arccos(np.clip(score[near], -1, 1)) / np.pi
        n = coder.turn.shape[1]
        off.append((apart(codes[q], codes[others[near]]) - n * p) / np.sqrt(n * p * (1 - p) + 1))
    off = np.sort(np.concatenate(off)) if off else np.zeros(0)
    return Coder(coder.mean, coder.turn, float(off[min(len(off) - 1, math.ceil(wanted * len(off)))]) if len(off) else 0.0)


#: Numbers of SUBSTRING_BITS bits with 0, 1, 2, .. of them set.
_FLIPS = [np.array([sum(1 << i for i in c) for c in combinations(range(SUBSTRING_BITS), n)], np.uint16) for n in range(SUBSTRING_BITS + 1)]


class Index:
    """The substring indexes of a shard: for each substring the rows in order of its value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable").astype(np.int32)
        self.starts = [np.concatenate([[0], np.cumsum(np.bincount(c, minlength=1 << SUBSTRING_BITS))]) for c in codes.T]
        self.used = [m for m in range(codes.shape[1]) if codes[:, m].any()] or [0]  # not the padding

    def ring(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows with a substring that differs in exactly radius bits; a row may come more than once."""
        found = []
        for m in self.used:
            values = code[m] ^ _FLIPS[radius]
            first, n = self.starts[m][values], self.starts[m][values.astype(np.int64) + 1] - self.starts[m][values]
            first, n = first[n > 0], n[n > 0]
            places = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            found.append(self.order[places, m])
        return np.concatenate(found)

    def nearest(self, coder: Coder, code: np.ndarray, rank, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and cosines of the k best found, by rank (rows -> those that count, cosines); and how
        many rows were retrieved."""
        met = np.zeros(len(self.codes), bool)
        waiting, far = np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, score = np.zeros(0, np.int64), np.zeros(0)
        for s in range(SUBSTRING_BITS + 1):
            new = self.ring(code, s)
            new = np.unique(new[~met[new]])
            met[new] = True
            waiting, far = np.concatenate([waiting, new]), np.concatenate([far, apart(code, self.codes[new])])
            covered = len(self.used) * (s + 1) - 1
            while True:
                need = float(coder.reach(np.partition(score, len(score) - k)[len(score) - k])) if len(score) >= k else np.inf
                now = far <= min(covered, need)
                if not now.any():
                    break
                got, cosine = rank(waiting[now])
                rows, score = np.concatenate([rows, got]), np.concatenate([score, cosine])
                waiting, far = waiting[~now], far[~now]
            if covered >= need:
                break
        return rows, score, int(met.sum())


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    vectors = table["embedding"].combine_chunks()
    flat = vectors.flatten().to_numpy().astype(np.float64)
    return table["vec_id"].to_numpy(), flat.reshape(len(vectors), -1)


def _search(coders: dict[int, Coder], queries: str, k: int):
    """Rows (shard, n, vec_id, embedding) come shard by shard; each reads the queries of its length."""

    def answers(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.sort_by("vec_id")
        coder = coders[table["n"][0].as_py()]
        ids, rows = _matrix(table)
        numbers = table["row"].to_numpy()
        index = Index(coder.codes(rows))
        for block in parquet_batches(f"{queries}/n={rows.shape[1]}", QUERY_BLOCK):
            asked, points = _matrix(block)
            out: list[list] = [[], [], [], [], []]
            for i, (q, x, code) in enumerate(zip(asked, points, coder.codes(points))):

                def rank(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    places = places[ids[places] != q]
                    return places, cosines(x, rows[places])

                at, score, met = index.nearest(coder, code, rank, k)
                top = best(ids[at], score, k)
                out[0].append(np.full(len(top), q))
                out[1].append(ids[at[top]])
                out[2].append(numbers[at[top]])
                out[3].append(score[top])
                out[4].append(np.full(len(top), met))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["query_id", "vec_id", "row", "score", "met"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            shard = held["shard"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else [0]
            for a, e in zip(cuts[:-1], cuts[1:]):
                yield from answers(held.slice(int(a), int(e - a)))
            held = held.slice(int(cuts[-1]))
        if held is not None and held.num_rows:
            yield from answers(held)

    return run


def valid(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, embedding and n (its length) of the rows that take part."""
    own = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    own = own.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))
    return own.withColumn("n", F.size("embedding"))


def found_by_shard(vectors: DataFrame, query_filter, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, vec_id, row (a number of the candidate row), score, met: up to k answers of each shard for
    each query row, and how many of the shard's rows were retrieved for it."""
    spark = vectors.sparkSession
    own = stored(valid(vectors, id_column, vector_column).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = {r["n"]: r["count"] for r in own.groupBy("n").count().collect()}  # a row per length of vectors
    coders = {}
    for n in sizes:
        sample = own.filter(F.col("n") == n).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
        coders[n] = learn(_matrix(sample)[1], k)
    queries = workdir(spark, "queries")
    own.filter(query_filter).drop("row").dropDuplicates(["vec_id", "embedding"]).write.partitionBy("n").parquet(queries)
    shards = {n: max(1, math.ceil(rows / SHARD_ROWS)) for n, rows in sizes.items()}
    parts = F.lit(1)
    for n, count in shards.items():
        parts = F.when(F.col("n") == n, F.lit(count)).otherwise(parts)
    # shards are told by number, lengths by the higher bits
    shard = F.shiftleft(F.col("n").cast("long"), 32) + F.pmod(F.xxhash64("vec_id", F.lit(1)), parts)
    index = own.withColumn("shard", shard).repartition(max(1, sum(shards.values())), "shard").sortWithinPartitions("shard")
    return index.select("shard", "n", "vec_id", "row", "embedding").mapInArrow(_search(coders, queries, k), "query_id long, vec_id long, row long, score double, met long")


def search(vectors: DataFrame, query_filter, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that passes query_filter
    (a condition on vec_id), among all other rows. A row found by several vectors of one query id counts
    once, with its largest cosine."""
    found = found_by_shard(vectors, query_filter, k, id_column, vector_column)
    found = found.groupBy("query_id", "row", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
