"""Exact and approximate nearest-neighbour operators.

Distance work runs in Arrow batches against blocks of queries that lie in the shared folder; each task
keeps the k best of its rows, so the shuffle carries k rows per query and chunk, never all pairs.
"""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..workspace import parquet_batches, stored, workdir

#: Queries read at once beside up to CHUNK vectors, and distances that lie in a worker at once (16 MB).
QUERY_BLOCK, CHUNK, PRODUCT = 1024, 16_384, 1 << 21
#: Lists of an inverted file at most: what every worker reads grows with them.
MOST_LISTS = 131_072
#: Rows of a stored shard; rows that models are fitted on.
SHARD_ROWS, SAMPLE_ROWS = 8192, 65_536


def ranked(found: DataFrame, k: int, by: Column, query: str = "query_id", item: str = "vec_id") -> DataFrame:
    """Adds rank and keeps the k first of each query; ties go to the smaller id."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(by, item))).filter(F.col("rank") <= max(k, 0))


def lists_matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the commonest length as a matrix, and which rows they are of."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    if not (n >= 0).any():
        return np.zeros((0, 0)), np.zeros(0, np.int64)
    width = np.bincount(n[n >= 0]).argmax()
    rows = np.flatnonzero(n == width)
    flat = (column if len(rows) == len(n) else column.take(pa.array(rows))).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), width), rows


def by_length(column: pa.Array):
    """The vectors of each length as a matrix, and which rows they are of."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for width in np.unique(n[n > 0]).tolist():
        rows = np.flatnonzero(n == width)
        flat = (column if len(rows) == len(n) else column.take(pa.array(rows))).flatten()
        yield flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), width), rows


def _measure(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances row by row; equal rows give equal distances wherever they stand."""
    if metric == "l2":
        return np.square(q - x).sum(axis=1)
    dot = np.einsum("ij,ij->i", q, x)
    if metric == "ip":
        return -dot
    norm = lambda m: np.maximum(np.sqrt(np.einsum("ij,ij->i", m, m)), V.EPSILON)
    return 1 - dot / (norm(q) * norm(x))


def _near(metric: str, q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query and row of all pairs that may be among a query's k nearest, by matrix products of as many
    queries as PRODUCT distances have room for, with their exact distances. Pairs come query by query."""
    given, squares = (q, x), None
    if metric == "cosine":
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), V.EPSILON)
        q, x = unit(q), unit(x)
    elif metric == "l2":
        squares = np.square(x).sum(axis=1)
    step, found = max(1, PRODUCT // max(len(x), 1)), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for a in range(0, len(q), step):
        rough = -(q[a : a + step] @ x.T) if squares is None else squares - 2 * (q[a : a + step] @ x.T)
        rough[np.isnan(rough)] = np.inf
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(rough), rough, 0)).max(axis=1, initial=0))
        edge = np.partition(rough, k - 1, axis=1)[:, k - 1] if rough.shape[1] > k else np.full(len(rough), np.inf)
        i, j = np.nonzero((rough <= (edge + slack)[:, None]) & np.isfinite(rough))
        found.append((i + a, j, _measure(metric, given[0][i + a], given[1][j])))
    return tuple(np.concatenate(c) for c in zip(*found))


def _blocks(uri: str, rows: int):
    for table in parquet_batches(uri, rows):
        for points, own in by_length(table["q"]):
            yield table["query_id"].to_numpy()[own], points


def nearest(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2", on: str | None = None, decode=None, extra: tuple[str, ...] = (), by=None) -> DataFrame:
    """query_id, rank, vec_id, distance of the k nearest (l2 is squared, ip negated) of each query
    (query_id, q) among vectors (vec_id, v), of those with the same value of on if it is given.

    Vectors stay where they are. Queries are written to the shared folder, apart by on, and each task
    reads them block by block beside its own rows: matrix products, whose best are measured exactly. A
    task gives k rows for each query and CHUNK vectors. decode(matrix, *extra) makes vectors of
    coded rows. by orders the result (the distance, if it is not given); ties go to the smaller id.
    Null vectors take no part; a vector is compared with queries of its own length."""
    uri, block, chunk = workdir(queries.sparkSession, "queries"), QUERY_BLOCK, CHUNK
    asked = queries.select("query_id", "q", *([F.col(on).alias("on_")] if on else [])).filter(F.col("q").isNotNull())
    writer = asked.filter("on_ is not null").write.partitionBy("on_") if on else asked.write
    writer.parquet(uri)

    def search(batches):
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            if not held or (batch is not None and sum(b.num_rows for b in held) < chunk):
                continue
            table = pa.Table.from_batches(held)
            held = []
            for x, rows in by_length(table["v"]):
                ids = table["vec_id"].to_numpy()[rows]
                if decode:
                    x = decode(x, *(table[c].to_numpy()[rows] for c in extra))
                keys = table["on_"].to_numpy(zero_copy_only=False)[rows] if on else np.zeros(len(rows), int)
                for key in np.unique(keys).tolist():
                    own = np.flatnonzero(keys == key)
                    for asked_ids, points in _blocks(f"{uri}/on_={key}" if on else uri, block):
                        if points.shape[1] != x.shape[1]:
                            continue
                        i, j, d = _near(metric, points, x[own], k)
                        yield pa.RecordBatch.from_arrays([pa.array(asked_ids[i]), pa.array(ids[own[j]]), pa.array(d)], names=["query_id", "vec_id", "distance"])

    own = vectors.select("vec_id", "v", *extra, *([F.col(on).alias("on_")] if on else []))
    found = (own.filter("on_ is not null") if on else own).filter("vec_id is not null").mapInArrow(search, "query_id long, vec_id long, distance double")
    return ranked(found, k, F.col("distance") if by is None else by).select("query_id", "rank", "vec_id", "distance")


def knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """The k nearest of each query (query_id, q) among vectors (vec_id, v)."""
    return nearest(queries, vectors, k, metric)


def centroids_by_label(vectors: DataFrame) -> DataFrame:
    """cid, c: the mean vector of each label; a Lloyd step when labels are the assignment."""
    means = vectors.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("m"))
    found = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "m")))["m"].alias("c")).select(F.col("label").cast("int").alias("cid"), "c")
    return few_lists(stored(found, "centroids"))


def few_lists(centroids: DataFrame) -> DataFrame:
    """centroids, if they are few enough to be read by every worker."""
    if (n := centroids.count()) > MOST_LISTS:
        raise ValueError(f"{n} lists are more than {MOST_LISTS}")
    return centroids


def assigned(vectors: DataFrame, centroids: DataFrame, nprobe: int = 1) -> DataFrame:
    """Each row with cids, its nprobe nearest centroids (at most MOST_LISTS)."""
    from .product_codes import assigned as by_matrix

    return by_matrix(vectors, centroids, nprobe)


def probe(queries: DataFrame, vectors: DataFrame, centroids: DataFrame, k: int, nprobe: int) -> DataFrame:
    """Inverted-file search: only vectors of the nprobe lists nearest to the query are ranked."""
    lists = assigned(vectors, centroids).select("vec_id", "v", F.col("cids")[0].alias("cid"))
    asked = assigned(queries.withColumnRenamed("q", "v"), centroids, nprobe).select("query_id", F.col("v").alias("q"), F.explode("cids").alias("cid"))
    return nearest(asked, lists, k, on="cid")


def residuals(vectors: DataFrame, centroids: DataFrame, nprobe: int = 1) -> DataFrame:
    """vec_id, cid, v: each row's difference from each of its nprobe nearest centroids."""
    lists = assigned(vectors, centroids, nprobe).select("vec_id", "v", F.explode("cids").alias("cid"))
    return lists.join(F.broadcast(centroids), "cid").select("vec_id", "cid", V.residual(F.col("v"), F.col("c")).alias("v"))


def reranked(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact distances for candidates (query_id, vec_id); a missing vector is infinitely far."""
    full = candidates.join(vectors.select("vec_id", "v"), "vec_id", "left").join(queries, "query_id")
    distance = F.coalesce(V.l2_squared(F.col("q"), F.col("v")), F.lit(float("inf")))
    return ranked(full.select("query_id", "vec_id", distance.alias("distance")), k, F.col("distance"))


def neighbour_graph(vectors: DataFrame, m: int) -> DataFrame:
    """src, dst: each row's m nearest others, made symmetric, without loops."""
    near = nearest(vectors.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), vectors, m + 1)
    edges = near.filter("query_id <> vec_id")
    edges = edges.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).filter(F.col("rank") <= m).select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"))
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def recall(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """recall: the share of the true k that was found, over all queries."""
    want = truth.filter(F.col("rank") <= k).select("query_id", "vec_id")
    have = found.filter(F.col("rank") <= k).select("query_id", "vec_id", F.lit(1).alias("hit"))
    return want.join(have, ["query_id", "vec_id"], "left").agg(F.round(F.coalesce(F.sum("hit") / F.count("*"), F.lit(0.0)), 6).alias("recall"))


class EarlyExit:
    """Says when a search may end: the running minimum of its distances gained less than epsilon over
    the last tau steps, and min_steps are done."""

    def __init__(self, tau: int = 3, epsilon: float = 1e-4, min_steps: int = 5):
        if min(tau - 1, epsilon) < 0:
            raise ValueError("tau must be at least 1 and epsilon at least 0")
        self.tau, self.epsilon, self.min_steps = tau, epsilon, min_steps
        self.least: list[float] = []

    def update(self, value: float) -> bool:
        self.least.append(min([value, *self.least[-1:]]))
        lag = len(self.least) - self.tau - 1
        return len(self.least) >= max(self.min_steps, self.tau + 1) and self.least[lag] - self.least[-1] < self.epsilon


def kmeans(points: np.ndarray, k: int, iterations: int = 15, tolerance: float = 1e-4, seed: int = 42) -> np.ndarray:
    """k centroids by Lloyd's steps from random rows; an empty cluster takes the point that is farthest
    from its centroid. Fewer rows than k are repeated."""
    random = np.random.default_rng(seed)
    if len(points) <= k:
        return np.resize(points, (k, points.shape[1]))
    centroids = points[random.choice(len(points), k, replace=False)]
    for _ in range(iterations):
        d = np.square(points).sum(axis=1)[:, None] + np.square(centroids).sum(axis=1) - 2 * points @ centroids.T
        own, far = d.argmin(axis=1), d.min(axis=1)
        n = np.bincount(own, minlength=k)
        new = np.stack([np.bincount(own, points[:, i], k) for i in range(points.shape[1])], axis=1) / np.maximum(n, 1)[:, None]
        empty = np.flatnonzero(n == 0)
        new[empty] = points[np.argsort(-far, kind="stable")[: len(empty)]]
        still = np.allclose(new, centroids, atol=tolerance)
        centroids = new
        if still:
            break
    return centroids


def sample(vectors: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Up to so many vectors, chosen by a hash of their id: what models are fitted on."""
    some = vectors.filter("v is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select("v").toArrow()
    return lists_matrix(some["v"])[0]


def trained_lists(vectors: DataFrame, nlist: int, seed: int = 42) -> DataFrame:
    """cid, c: nlist centroids, fitted on a bounded sample."""
    if nlist > MOST_LISTS:
        raise ValueError(f"{nlist} lists are more than {MOST_LISTS}")
    centroids = kmeans(sample(vectors), nlist, seed=seed)
    return vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cid int, c array<double>")


def trained_codebook(vectors: DataFrame, parts: int, codes: int, seed: int = 42) -> DataFrame:
    """m, code, c: a product quantizer's codebook, each sub-space fitted on the same bounded sample; the
    last sub-space takes what is left over."""
    if not 1 <= codes <= 256:
        raise ValueError("codes are bytes: 1 to 256 of them")
    points = sample(vectors)
    width = points.shape[1] // parts
    cuts = [*range(0, width * parts, width), points.shape[1]]
    rows = [(m, i, c.tolist()) for m, (a, e) in enumerate(zip(cuts, cuts[1:])) for i, c in enumerate(kmeans(points[:, a:e], codes, seed=seed + m))]
    return vectors.sparkSession.createDataFrame(rows, "m int, code int, c array<double>")


def in_shards(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """vec_id, v, cid, part: the list of each row, and its part of a list that one task can't hold."""
    lists = stored(assigned(vectors, centroids).select("vec_id", "v", F.col("cids")[0].alias("cid")), "lists")
    parts = lists.groupBy("cid").agg(F.ceil(F.count("*") / SHARD_ROWS).alias("parts"))  # a row per list
    return lists.join(F.broadcast(parts), "cid").select("vec_id", "v", "cid", F.pmod(F.xxhash64("vec_id"), F.col("parts")).alias("part"))


def _linked(points: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Starts and targets of a graph of each point's m nearest others, made symmetric and connected, and
    its entry, the point nearest to the mean."""
    n = len(points)
    entry = int(np.square(points - points.mean(axis=0)).sum(axis=1).argmin())
    edges = [np.zeros((0, 2), np.int64)]
    for a in range(0, n, 1024):
        d = np.square(points).sum(axis=1) - 2 * points[a : a + 1024] @ points.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        k = min(m, n - 1)
        if k:
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            edges.append(np.stack([np.repeat(np.arange(a, a + len(d)), k), near.ravel()], axis=1))
    both = np.concatenate(edges)
    both = np.unique(np.concatenate([both, both[:, ::-1]]), axis=0)
    starts = np.searchsorted(both[:, 0], np.arange(n + 1))
    root, more = np.full(n, -1), []
    for first in [entry, *range(n)]:  # a way from the entry to every component
        if root[first] < 0:
            if first != entry:
                more += [(entry, first), (first, entry)]
            front = [first]
            root[first] = first
            while front:
                i = front.pop()
                new = [j for j in both[starts[i] : starts[i + 1], 1].tolist() if root[j] < 0]
                root[new] = first
                front += new
    if more:
        both = np.unique(np.concatenate([both, np.array(more)]), axis=0)
        starts = np.searchsorted(both[:, 0], np.arange(n + 1))
    return starts, both[:, 1], entry


def walk(points: np.ndarray, starts: np.ndarray, targets: np.ndarray, entry: int, x: np.ndarray, ef: int, rule: EarlyExit | None = None) -> tuple[list[tuple[float, int]], int]:
    """Best-first search from the entry with a beam of ef: (squared distance, point) of the best found,
    nearest first, and how many points were measured."""
    seen = np.zeros(len(points), bool)
    seen[entry] = True
    d = float(np.square(points[entry] - x).sum())
    front, best, measured = [(d, entry)], [(-d, -entry)], 1
    while front:
        d, i = heapq.heappop(front)
        if len(best) >= ef and d > -best[0][0]:
            break
        new = targets[starts[i] : starts[i + 1]]
        new = new[~seen[new]]
        seen[new] = True
        measured += len(new)
        for e, j in zip(np.square(points[new] - x).sum(axis=1).tolist(), new.tolist()):
            if len(best) < ef or (-e, -j) > best[0]:
                heapq.heappush(front, (e, j))
                heapq.heappush(best, (-e, -j))
                if len(best) > ef:
                    heapq.heappop(best)
        if rule and rule.update(-max(best)[0]):
            break
    return sorted((-d, -i) for d, i in best), measured


GRAPH = "cid int, part long, n int, entry int, ids binary, points binary, starts binary, targets binary"


def graph_index(vectors: DataFrame, centroids: DataFrame, m: int = 16) -> DataFrame:
    """GRAPH: a row per shard with its points and their graph, stored."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        points, rows = lists_matrix(table["v"])
        ids = table["vec_id"].to_numpy()[rows]
        starts, targets, entry = _linked(points, m)
        own = [key[0].as_py(), key[1].as_py(), len(ids), entry, ids.tobytes(), points.tobytes(), starts.astype(np.int64).tobytes(), targets.astype(np.int64).tobytes()]
        return pa.table({f.split()[0]: [v] for f, v in zip(GRAPH.split(", "), own)}, schema=pa.schema([("cid", pa.int32()), ("part", pa.int64()), ("n", pa.int32()), ("entry", pa.int32()), *((x, pa.binary()) for x in ("ids", "points", "starts", "targets"))]))

    rows = in_shards(vectors.filter("vec_id is not null and v is not null and size(v) > 0"), centroids)
    return stored(rows.groupBy("cid", "part").applyInArrow(build, GRAPH), "graph")


def graph_search(queries: DataFrame, index: DataFrame, centroids: DataFrame, k: int, nprobe: int = 3, ef: int = 64, tau: int | None = None, epsilon: float = 1e-4) -> DataFrame:
    """query_id, rank, vec_id, distance, measured: the nearest that a walk through the graphs of the
    nprobe lists nearest to the query meets, with how many points a shard's walk measured. With tau a
    walk may end early."""
    uri = workdir(queries.sparkSession, "queries")
    asked = assigned(queries.filter("q is not null").withColumnRenamed("q", "v"), centroids, nprobe)
    asked.select("query_id", F.col("v").alias("q"), F.explode("cids").alias("on_")).write.partitionBy("on_").parquet(uri)

    def search(batches):
        for row in (r for b in batches for r in b.to_pylist()):
            ids, starts, targets = (np.frombuffer(row[c], np.int64) for c in ("ids", "starts", "targets"))
            points = np.frombuffer(row["points"]).reshape(row["n"], -1)
            for asked_ids, block in _blocks(f"{uri}/on_={row['cid']}", QUERY_BLOCK):
                out = []
                for q, x in zip(asked_ids.tolist(), block):
                    best, measured = walk(points, starts, targets, row["entry"], x, max(ef, k), EarlyExit(tau, epsilon) if tau else None)
                    out += [(q, int(ids[i]), d, measured) for d, i in best[:k]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["query_id", "vec_id", "distance", "measured"])

    found = index.mapInArrow(search, "query_id long, vec_id long, distance double, measured long")
    return ranked(found, k, F.col("distance")).select("query_id", "rank", "vec_id", "distance", "measured")


def codebook(vectors: DataFrame, parts: int, codes: int, dimension: int) -> DataFrame:
    """m, code, c: the sub-vectors of the first ids as a product quantizer's codebook."""
    first = vectors.filter(F.col("vec_id") < codes)
    pieces = F.array(*V.subspaces(F.col("v"), parts, dimension))
    return first.select(F.posexplode(pieces).alias("m", "c"), F.col("vec_id").cast("int").alias("code")).select("m", "code", "c")


def index_bytes(n: int, dimension: int, m: int = 16, nlist: int = 16, parts: int = 8) -> dict[str, int]:
    """Bytes that each kind of index needs for n vectors."""
    return {"flat": 4 * n * dimension, "graph": 4 * n * dimension + 8 * n * m, "ivf_pq": 4 * nlist * dimension + 1024 * dimension + n * (parts + 8), "two_tier": n * dimension + 8 * n * m + 8 * dimension}
