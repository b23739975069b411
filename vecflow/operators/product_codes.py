"""Product codes searched by tables, and assignment to very many lists, in Arrow batches.

A query's squared distance to a coded vector is a sum over the code's places: each place looks its codeword
up in the query's table of distances. Vectors are never rebuilt. Codewords and centroids are small (their
number is bounded) and lie in the shared folder, where each worker reads them once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..workspace import parquet_batches, workdir
from . import search as S

#: Coded vectors compared at once with a block of queries, and vectors assigned at once.
CODED_CHUNK, ASSIGNED_CHUNK = 4096, 8192
#: More centroids than this are told apart in two levels.
ONE_LEVEL = 2048


@lru_cache(maxsize=4)
def _words(uri: str) -> list[np.ndarray]:
    """A codebook's codewords by sub-space."""
    rows = sorted((r["m"], r["code"], r["c"]) for t in parquet_batches(uri, 65_536) for r in t.to_pylist())
    return [np.array([c for m, _, c in rows if m == k], float) for k in sorted({m for m, _, _ in rows})]


def nearest_rows(x: np.ndarray, points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n nearest points of each row and their squared distances: by a matrix product, all that may be
    among them measured exactly. Ties go to the earlier point."""
    n = min(n, len(points))
    rough = np.square(points).sum(axis=1) - 2 * x @ points.T
    slack = 1e-9 * (1 + np.abs(rough).max(axis=1, initial=0) + np.square(x).sum(axis=1))
    edge = np.partition(rough, n - 1, axis=1)[:, n - 1]
    i, j = np.nonzero(rough <= (edge + slack)[:, None])
    d = np.square(x[i] - points[j]).sum(axis=1)
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    place = np.arange(len(i)) - np.searchsorted(i, np.arange(len(x)))[i]
    keep = place < n
    return j[keep].reshape(len(x), n), d[keep].reshape(len(x), n)


def encoded(vectors: DataFrame, book: DataFrame, *keep: str) -> DataFrame:
    """vec_id, the columns to keep, codes: the nearest codeword (book: m, code, c) of each sub-vector;
    null for a vector that the codebook does not fit."""
    uri = workdir(vectors.sparkSession, "codebook")
    book.select("m", "code", "c").write.parquet(uri)
    own = vectors.select("vec_id", *keep, "v")
    schema = StructType([*own.drop("v").schema.fields, StructField("codes", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(uri)
        cuts = np.cumsum([0, *(w.shape[1] for w in words)])
        for batch in (b.slice(a, ASSIGNED_CHUNK) for b in batches for a in range(0, b.num_rows, ASSIGNED_CHUNK)):
            codes: list = [None] * batch.num_rows
            for x, rows in S.by_length(batch.column("v")):
                if x.shape[1] == cuts[-1]:
                    found = np.stack([nearest_rows(x[:, a:e], w, 1)[0][:, 0] for w, a, e in zip(words, cuts, cuts[1:])], axis=1)
                    for r, c in zip(rows.tolist(), found.tolist()):
                        codes[r] = c
            columns = [batch.column(c) for c in ("vec_id", *keep)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(codes, pa.list_(pa.int32()))], names=["vec_id", *keep, "codes"])

    return own.mapInArrow(run, schema)


def distance_tables(queries: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """For each query and sub-space the squared distances to all codewords."""
    cuts = np.cumsum([0, *(w.shape[1] for w in words)])
    tables = np.full((len(queries), len(words), max(map(len, words))), np.inf)
    for m, (w, a, e) in enumerate(zip(words, cuts, cuts[1:])):
        for i in range(0, len(queries), 256):
            tables[i : i + 256, m, : len(w)] = np.square(queries[i : i + 256, None, a:e] - w[None]).sum(axis=2)
    return tables


def table_distances(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Distances of queries to coded vectors, looked up place by place."""
    total = np.zeros((len(tables), len(codes)))
    for m in range(codes.shape[1]):
        total += np.take(tables[:, m], codes[:, m], axis=1)
    return total


def nearest_coded(queries: DataFrame, coded: DataFrame, book: DataFrame, k: int, on: str | None = None) -> DataFrame:
    """query_id, rank, vec_id, distance of the k nearest coded rows (vec_id, codes) of each query
    (query_id, q), by tables; with on among those of the same value of it (a list: then q is the
    query's residual to that list). Distances count to nine places, ties go to the smaller id. A
    task gives k rows for each query and CODED_CHUNK rows. Null codes take no part."""
    spark = queries.sparkSession
    uri, asked_at = workdir(spark, "codebook"), workdir(spark, "queries")
    book.select("m", "code", "c").write.parquet(uri)
    asked = queries.select("query_id", "q", *([F.col(on).alias("on_")] if on else [])).filter("q is not null")
    (asked.filter("on_ is not null").write.partitionBy("on_") if on else asked.write).parquet(asked_at)
    block = S.QUERY_BLOCK

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(uri)
        dimension = sum(w.shape[1] for w in words)
        for batch in (b.slice(a, CODED_CHUNK) for b in batches for a in range(0, b.num_rows, CODED_CHUNK)):
            ids, keys = batch.column("vec_id").to_numpy(), batch.column("on_").to_numpy(zero_copy_only=False)
            codes = batch.column("codes").flatten().to_numpy().reshape(len(ids), -1)
            for key in np.unique(keys).tolist():
                own = np.flatnonzero(keys == key)
                for asked_ids, points in S._blocks(f"{asked_at}/on_={key}" if on else asked_at, block):
                    if points.shape[1] != dimension:
                        continue
                    d = np.round(table_distances(distance_tables(points, words), codes[own]), 9)
                    edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.inf
                    i, j = np.nonzero(d <= edge)
                    yield pa.RecordBatch.from_arrays([pa.array(asked_ids[i]), pa.array(ids[own[j]]), pa.array(d[i, j])], names=["query_id", "vec_id", "distance"])

    own = coded.select("vec_id", "codes", (F.col(on) if on else F.lit(0)).alias("on_")).filter("vec_id is not null and codes is not null and on_ is not null")
    found = own.mapInArrow(search, "query_id long, vec_id long, distance double")
    return S.ranked(found, k, F.col("distance")).select("query_id", "rank", "vec_id", "distance")


class CoarseLists:
    """Centroids in groups around fewer centres. A row's nearest centroids are looked for group by group
    in the order of the least distance a group can have; a group that cannot hold one of them is left out,
    so the answer is that of all centroids."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.argsort(ids, kind="stable")
        if not len(order):
            points = np.zeros((0, 1))
        self.ids, self.points = ids[order], points[order]
        few = len(points) <= ONE_LEVEL
        self.centres = (points if len(points) else np.zeros((1, 1))).mean(axis=0, keepdims=True) if few else S.kmeans(points[:: max(1, len(points) // 16_384)], int(len(points) ** 0.5), iterations=5)
        owner = np.zeros(len(points), int) if few else np.concatenate([nearest_rows(self.points[a : a + ASSIGNED_CHUNK], self.centres, 1)[0][:, 0] for a in range(0, len(points), ASSIGNED_CHUNK)])
        self.members = [np.flatnonzero(owner == g) for g in range(len(self.centres))]
        self.radius = np.array([np.sqrt(np.square(self.points[m] - c).sum(axis=1).max(initial=0)) for m, c in zip(self.members, self.centres)])

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """Ids of the n nearest centroids of each row, nearest first, ties to the smaller id."""
        n = min(n, len(self.ids))
        if len(self.centres) == 1:
            return self.ids[nearest_rows(x, self.points, n)[0]]
        away = np.sqrt(np.maximum(np.square(x).sum(axis=1)[:, None] + np.square(self.centres).sum(axis=1) - 2 * x @ self.centres.T, 0))
        least = np.maximum(away - self.radius, 0) * (1 - 1e-9)
        best_d, best_j = np.full((len(x), n), np.inf), np.full((len(x), n), len(self.ids))
        order = np.argsort(least, axis=1, kind="stable")
        for turn in range(len(self.centres)):  # each row's groups, the likeliest first
            group = order[:, turn]
            rows = np.flatnonzero(np.square(least[np.arange(len(x)), group]) <= best_d[:, -1] * (1 + 1e-9))
            if not len(rows):
                break
            by = rows[np.argsort(group[rows], kind="stable")]
            for own in np.split(by, np.flatnonzero(np.diff(group[by])) + 1):
                members = self.members[group[own[0]]]
                if not len(members):
                    continue
                j, d = nearest_rows(x[own], self.points[members], n)
                all_d, all_j = np.concatenate([best_d[own], d], axis=1), np.concatenate([best_j[own], members[j]], axis=1)
                pick = np.lexsort((all_j, all_d), axis=1)[:, :n]
                best_d[own], best_j[own] = np.take_along_axis(all_d, pick, 1), np.take_along_axis(all_j, pick, 1)
        return self.ids[best_j]


@lru_cache(maxsize=2)
def _lists(uri: str) -> CoarseLists:
    tables, n = [], 0
    for t in parquet_batches(uri, 16_384):
        n += t.num_rows
        if n > S.MOST_LISTS:
            raise ValueError(f"more than {S.MOST_LISTS} lists")
        tables.append((t["cid"].to_numpy(), S.lists_matrix(t["c"])[0]))
    return CoarseLists(*(np.concatenate(x) for x in zip(*tables))) if n else CoarseLists(np.zeros(0, np.int64), np.zeros((0, 0)))


def assigned(vectors: DataFrame, centroids: DataFrame, nprobe: int = 1) -> DataFrame:
    """Each row with cids, its nprobe nearest centroids (cid, c); nprobe is held to 1 .. all. Rows without
    a vector, or with one of another length than the centroids', have none."""
    uri = workdir(vectors.sparkSession, "centroids")
    centroids.select("cid", "c").write.parquet(uri)
    n = max(nprobe, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, ASSIGNED_CHUNK) for b in batches for a in range(0, b.num_rows, ASSIGNED_CHUNK)):
            lists, cids = _lists(uri), [[] for _ in range(batch.num_rows)]
            for x, rows in S.by_length(batch.column("v")):
                if x.shape[1] == lists.points.shape[1]:
                    for r, c in zip(rows.tolist(), lists.nearest(x, n).tolist()):
                        cids[r] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cids, pa.list_(pa.int32()))], names=[*batch.schema.names, "cids"])

    return vectors.mapInArrow(run, StructType([*vectors.schema.fields, StructField("cids", ArrayType(IntegerType()))]))
