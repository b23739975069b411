"""Indexes behind one interface: fit vectors, search queries, tell the bytes they need."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import stored, workdir
from . import layered as Y
from . import product_codes as C
from . import search as S


class Index(Protocol):
    """fit takes rows (vec_id, v); search takes rows (query_id, q) and gives query_id, rank, vec_id and
    distance, at most k for each query and fewer where fewer are found."""

    name: str

    def fit(self, vectors: DataFrame) -> Index: ...

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...

    def memory_bytes(self) -> int: ...


class _Sized:
    def _measure(self, vectors: DataFrame) -> None:
        row = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
        self.n, self.dimension = row["n"], row["d"]

    def memory_bytes(self) -> int:
        return S.index_bytes(self.n, self.dimension)[self.kind]


class FlatIndex(_Sized):
    """Exact search by squared l2, cosine or negated inner product."""

    name, kind = "flat", "flat"

    def __init__(self, metric: str = "l2"):
        if metric not in ("l2", "cosine", "ip"):
            raise ValueError(f"no such metric: {metric}")
        self.metric = metric

    def fit(self, vectors: DataFrame) -> FlatIndex:
        self.vectors = vectors.select("vec_id", "v")
        self._measure(self.vectors)
        return self

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return S.nearest(queries, self.vectors, k, self.metric)


class IvfPqIndex(_Sized):
    """Inverted lists of product codes of residuals, all fitted on a bounded sample. A query's distances
    come from its residuals to the nprobe nearest lists."""

    name, kind = "ivf_pq", "ivf_pq"

    def __init__(self, nlist: int = 16, parts: int = 8, codes: int = 256, nprobe: int = 4):
        self.nlist, self.parts, self.codes, self.nprobe = nlist, parts, codes, nprobe

    def fit(self, vectors: DataFrame) -> IvfPqIndex:
        self._measure(vectors)
        self.centroids = S.trained_lists(vectors, self.nlist)
        own = S.residuals(vectors, self.centroids)
        self.book = S.trained_codebook(own, self.parts, self.codes)
        self.coded = stored(C.encoded(own, self.book, "cid"), "codes", "cid")
        return self

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        asked = S.residuals(queries.select(F.col("query_id").alias("vec_id"), F.col("q").alias("v")), self.centroids, self.nprobe)
        return C.nearest_coded(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "cid"), self.coded, self.book, k, on="cid")


class GraphIndex(_Sized):
    """Shards of near vectors with a small-world graph each; queries walk the shards nearest to them."""

    name, kind = "graph", "graph"

    def __init__(self, m: int = 16, ef: int = 64, nprobe: int = 4, tau: int | None = None, epsilon: float = 1e-4):
        self.m, self.ef, self.nprobe, self.tau, self.epsilon = m, ef, nprobe, tau, epsilon

    def fit(self, vectors: DataFrame) -> GraphIndex:
        self._measure(vectors)
        self.centroids = S.trained_lists(vectors, max(1, -(-self.n // S.SHARD_ROWS)))
        self.graph = S.graph_index(vectors, self.centroids, self.m)
        return self

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return S.graph_search(queries, self.graph, self.centroids, k, self.nprobe, self.ef, self.tau, self.epsilon).drop("measured")


class LayeredIndex(_Sized):
    """Shards of near vectors with a layered graph each, which can be added to."""

    name, kind = "layered", "graph"

    def __init__(self, m: int = Y.M, ef: int = 64, nprobe: int = 4):
        self.m, self.ef, self.nprobe = m, ef, nprobe

    def fit(self, vectors: DataFrame) -> LayeredIndex:
        self._measure(vectors)
        spark = vectors.sparkSession
        self.store = Y.GraphStore(spark, workdir(spark, "layered"), self.m).create(S.trained_lists(vectors, max(1, -(-self.n // Y.SHARD_ROWS))))
        self.batches = 0
        return self.add(vectors, counted=True)

    def add(self, vectors: DataFrame, counted: bool = False) -> LayeredIndex:
        """Puts more vectors in."""
        if not counted:
            self.n += vectors.count()
        self.store.append(vectors, self.batches)
        self.batches += 1
        return self

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return self.store.search(queries, k, self.nprobe, self.ef).drop("measured")


class TwoTierIndex(_Sized):
    """A first tier walks graphs of coded vectors, a second ranks its pool by the whole ones. The pool
    holds factor times k rows, at least min_pool."""

    name, kind = "two_tier", "two_tier"

    def __init__(self, m: int = 16, ef: int = 40, factor: int = 3, min_pool: int = 30, tau: int | None = None, epsilon: float = 1e-4):
        self.graph, self.factor, self.min_pool = GraphIndex(m, ef, tau=tau, epsilon=epsilon), factor, min_pool

    def fit(self, vectors: DataFrame) -> TwoTierIndex:
        from ..functions import quantize as Q

        self._measure(vectors)
        self.vectors = vectors.select("vec_id", "v")
        ranges = stored(Q.as_arrays(Q.dimension_ranges(self.vectors)), "ranges")
        coded = self.vectors.crossJoin(F.broadcast(ranges))  # one row
        codes = Q.unsigned_codes(F.col("v"), F.col("lows"), F.col("scales"))
        self.graph.fit(coded.select("vec_id", Q.decoded(codes, F.col("lows"), F.col("scales")).alias("v")))
        return self

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        pool = self.graph.search(queries, max(k * self.factor, self.min_pool))
        return S.reranked(pool.select("query_id", "vec_id"), queries, self.vectors, k).select("query_id", "rank", "vec_id", "distance")
