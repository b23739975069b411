"""Layered small-world graphs that grow: built, searched and added to shard by shard.

A node's top layer is drawn from a hash of its id, each layer holding a fraction of the one below. A search
descends greedily from the entry through the sparse layers and walks the lowest with a beam. A new node is
put in by searching its neighbours on each of its layers; of those found it is linked with such that are
nearer to it than to one already chosen, in both directions, and a node with too many links chooses anew in
the same way. What no walk from the entry would meet any more is linked again (`mend`).

Vectors are dealt into lists and parts of bounded size, each a graph in one row of a stored table. New
vectors, of a stream too, are sent to the shard of their list; a batch writes the shards it touched as a new
version, and readers take each shard's newest. A batch that is tried again overwrites its own version.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import workdir
from . import search as S

M, BUILD_BEAM = 12, 64
#: Rows of a shard.
SHARD_ROWS = 4096
SHARD = "cid int, part long, n int, entry int, ids binary, points binary, levels binary, links binary"


def drawn_level(vec_id: int, m: int = M) -> int:
    """A layer from a hash of an id: layer l or above with probability m ** -l."""
    x = (vec_id + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return int(-math.log(((x ^ (x >> 31)) + 1) / 2**64) / math.log(m))


class LayeredGraph:
    """ids and points (a row each), levels, and for each layer its nodes' links."""

    def __init__(self, dimension: int, m: int = M, beam: int = BUILD_BEAM):
        self.m, self.beam, self.entry = m, beam, -1
        self.ids: list[int] = []
        self.levels: list[int] = []
        self.held = np.zeros((64, dimension))
        self.links: list[dict[int, list[int]]] = []

    @property
    def points(self) -> np.ndarray:
        return self.held[: len(self.ids)]

    def most(self, layer: int) -> int:
        return 2 * self.m if layer == 0 else self.m

    def _away(self, x: np.ndarray, nodes: list[int]) -> list[float]:
        return np.square(self.held[nodes] - x).sum(axis=1).tolist()

    def layer_walk(self, x: np.ndarray, entries: list[tuple[float, int]], beam: int, layer: int) -> tuple[list[tuple[float, int]], int]:
        """The best met by a beam from some nodes, nearest first, and how many nodes were measured."""
        seen = {i for _, i in entries}
        front, best, measured = list(entries), [(-d, -i) for d, i in entries], 0
        heapq.heapify(front)
        heapq.heapify(best)
        links = self.links[layer]
        while front:
            d, i = heapq.heappop(front)
            if len(best) >= beam and d > -best[0][0]:
                break
            new = [j for j in links[i] if j not in seen]
            if not new:
                continue
            seen.update(new)
            measured += len(new)
            for e, j in zip(self._away(x, new), new):
                if len(best) < beam or (-e, -j) > best[0]:
                    heapq.heappush(front, (e, j))
                    heapq.heappush(best, (-e, -j))
                    if len(best) > beam:
                        heapq.heappop(best)
        return sorted((-d, -i) for d, i in best), measured

    def chosen(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Of nodes, nearest first, those nearer to the centre than to any chosen before; then, to fill
        half of the places, the nearest of the others."""
        kept: list[int] = []
        for d, i in near:
            if len(kept) >= most:
                break
            if not kept or min(self._away(self.held[i], kept)) > d:
                kept.append(i)
        for _, i in near:
            if 2 * len(kept) >= most:
                break
            if i not in kept:
                kept.append(i)
        return kept

    def descend(self, x: np.ndarray, to: int) -> tuple[list[tuple[float, int]], int]:
        """Greedy from the entry down to above a layer: where it got to, nodes measured."""
        at, measured = [(self._away(x, [self.entry])[0], self.entry)], 1
        for layer in range(self.levels[self.entry], to, -1):
            at, n = self.layer_walk(x, at, 1, layer)
            measured += n
        return at, measured

    def insert(self, vec_id: int, point: np.ndarray) -> None:
        i, level = len(self.ids), drawn_level(vec_id, self.m)
        if i == len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[i] = point
        self.ids.append(vec_id)
        self.levels.append(level)
        while len(self.links) <= level:
            self.links.append({})
        if self.entry >= 0:
            at, _ = self.descend(point, level)
            for layer in range(min(level, self.levels[self.entry]), -1, -1):
                at, _ = self.layer_walk(point, at, self.beam, layer)
                own = self.links[layer][i] = self.chosen(at, self.m)
                for j in own:
                    back = self.links[layer][j]
                    back.append(i)
                    if len(back) > self.most(layer):
                        near = sorted(zip(self._away(self.held[j], back), back))
                        self.links[layer][j] = self.chosen(near, self.most(layer))
        for layer in range(level + 1):
            self.links[layer].setdefault(i, [])
        if self.entry < 0 or level > self.levels[self.entry]:
            self.entry = i

    def reached(self, layer: int) -> set[int]:
        """The nodes of a layer that a walk from the entry can meet."""
        start = self.entry
        seen, waiting = {start}, [start]
        while waiting:
            new = [j for j in self.links[layer][waiting.pop()] if j not in seen]
            seen.update(new)
            waiting += new
        return seen

    def mend(self) -> None:
        """Links to nodes that are not reached from the nearest found that is."""
        for layer, nodes in enumerate(self.links):
            if self.entry < 0 or self.entry not in nodes:
                continue
            seen = self.reached(layer)
            for i in sorted(nodes.keys() - seen):
                if i in seen:
                    continue
                near, _ = self.layer_walk(self.held[i], [(self._away(self.held[i], [self.entry])[0], self.entry)], self.beam, layer)
                nodes[near[0][1]].append(i)
                nodes[i].append(near[0][1])
                waiting = [i]
                seen.add(i)
                while waiting:
                    new = [j for j in nodes[waiting.pop()] if j not in seen]
                    seen.update(new)
                    waiting += new

    def extend(self, ids: np.ndarray, points: np.ndarray) -> None:
        for i, p in zip(ids.tolist(), points):
            self.insert(i, p)
        self.mend()

    def search(self, x: np.ndarray, k: int, ef: int) -> tuple[list[tuple[float, int]], int]:
        """(squared distance, node) of the best found, nearest first, and how many nodes were measured."""
        if self.entry < 0:
            return [], 0
        at, measured = self.descend(x, 0)
        best, n = self.layer_walk(x, at, max(ef, k), 0)
        return best[:k], measured + n

    def packed(self) -> dict:
        flat: list[int] = []
        for nodes in self.links:
            for i in sorted(nodes):
                flat += [i, len(nodes[i]), *nodes[i]]
            flat.append(-1)
        return {"n": len(self.ids), "entry": self.entry, "ids": np.array(self.ids, np.int64).tobytes(), "points": self.points.tobytes(), "levels": np.array(self.levels, np.int8).tobytes(), "links": np.array(flat, np.int32).tobytes()}

    @classmethod
    def unpacked(cls, row: dict, m: int = M, beam: int = BUILD_BEAM) -> LayeredGraph:
        points = np.frombuffer(row["points"]).reshape(row["n"], -1)
        graph = cls(points.shape[1], m, beam)
        graph.entry, graph.ids, graph.levels = row["entry"], np.frombuffer(row["ids"], np.int64).tolist(), np.frombuffer(row["levels"], np.int8).tolist()
        graph.held = np.concatenate([points, np.zeros((max(64, len(points)), points.shape[1]))])
        flat, at = np.frombuffer(row["links"], np.int32).tolist(), 0
        while at < len(flat):
            nodes: dict[int, list[int]] = {}
            while flat[at] >= 0:
                nodes[flat[at]] = flat[at + 2 : at + 2 + flat[at + 1]]
                at += 2 + flat[at + 1]
            graph.links.append(nodes)
            at += 1
        return graph


def counted_walk(away, links, entry: int, ef: int, tau: int = 3, epsilon: float = 1e-4) -> tuple[list[tuple[float, int]], int]:
    """Best-first from an entry, the failures counted at every neighbour: one that is not nearer than the
    best so far by epsilon is a failure, one that is sets the count to 0 and is the new best. At tau
    failures in a row the walk ends at that neighbour, which is not kept. away(node) is a distance,
    links(node) the neighbours in order. Gives the best ef, nearest first, and how many were visited."""
    best = away(entry)
    front, found, seen, fails = [(best, entry)], [(best, entry)], {entry}, 0
    while front and fails < tau:
        _, i = heapq.heappop(front)
        for j in links(i):
            if j in seen:
                continue
            seen.add(j)
            d = away(j)
            fails, best = (fails + 1, best) if best - d < epsilon else (0, d)
            if fails >= tau:
                break
            heapq.heappush(front, (d, j))
            found.append((d, j))
    return sorted(found)[:ef], len(seen)


def _rows(shards: Iterator[dict]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.Table.from_pylist(list(shards), schema=pa.schema([(n, kinds[t]) for n, t in (x.split() for x in SHARD.split(", "))]))


class GraphStore:
    """Layered graphs in a folder: centroids of the lists, and versions of the shards."""

    def __init__(self, spark: SparkSession, uri: str, m: int = M, beam: int = BUILD_BEAM):
        self.spark, self.uri, self.m, self.beam = spark, uri, m, beam

    def create(self, centroids: DataFrame) -> GraphStore:
        centroids.select("cid", "c").write.parquet(f"{self.uri}/centroids")
        return self

    @property
    def centroids(self) -> DataFrame:
        return self.spark.read.schema("cid int, c array<double>").parquet(f"{self.uri}/centroids")

    def shards(self, before: int | None = None) -> DataFrame:
        """The newest version of each shard, of versions below `before` if it is given."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/shards")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], SHARD)
        every = self.spark.read.schema(f"{SHARD}, version long").parquet(f"{self.uri}/shards")
        every = every if before is None else every.filter(F.col("version") < before)
        newest = every.groupBy("cid", "part").agg(F.max("version").alias("version"))
        return every.join(newest, ["cid", "part", "version"]).drop("version")

    def append(self, vectors: DataFrame, version: int) -> None:
        """Puts rows (vec_id, v) into their lists' shards. A list's rows go to its emptiest part while
        that has room, those beyond to new parts. The same version written again replaces itself."""
        own = S.assigned(vectors.filter("vec_id is not null and v is not null and size(v) > 0").select("vec_id", "v"), self.centroids)
        own = own.filter("size(cids) > 0").select("vec_id", "v", F.col("cids")[0].alias("cid"))
        old = self.shards(version)
        sizes = old.groupBy("cid").agg(F.min_by("part", "n").alias("open"), F.min("n").alias("used"), F.max("part").alias("last"))
        arrived = own.groupBy("cid").agg(F.count("*").alias("new"))
        plan = arrived.join(sizes, "cid", "left")  # a row per list
        room = F.coalesce(F.col("used"), F.lit(SHARD_ROWS)) + F.col("new") > SHARD_ROWS
        first = F.when(F.col("used") < SHARD_ROWS, F.col("open")).otherwise(F.coalesce(F.col("last") + 1, F.lit(0).cast("long")))
        begun = F.col("used") < SHARD_ROWS
        parts = F.when(room, F.greatest(F.lit(1), F.ceil((F.col("new") + F.when(begun, F.col("used")).otherwise(0)) / SHARD_ROWS))).otherwise(F.lit(1))
        plan = plan.select("cid", first.alias("first"), parts.cast("long").alias("parts"), F.coalesce(F.col("last"), F.lit(-1).cast("long")).alias("last"), F.coalesce(begun, F.lit(False)).alias("begun"))
        pick = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
        later = F.col("last") + pick + F.when(F.col("begun"), 0).otherwise(1)
        sent = own.join(F.broadcast(plan), "cid").select("cid", F.when(pick == 0, F.col("first")).otherwise(later).alias("part"), "vec_id", "v")
        m, beam = self.m, self.beam

        def grown(key: tuple, new: pa.Table, held: pa.Table) -> pa.Table:
            if not new.num_rows:
                return _rows(iter(()))
            points, rows = S.lists_matrix(new.sort_by("vec_id")["v"])
            ids = new.sort_by("vec_id")["vec_id"].to_numpy()[rows]
            graph = LayeredGraph.unpacked(held.to_pylist()[0], m, beam) if held.num_rows else LayeredGraph(points.shape[1], m, beam)
            graph.extend(ids, points)
            return _rows(iter([{"cid": key[0].as_py(), "part": key[1].as_py(), **graph.packed()}]))

        touched = sent.groupBy("cid", "part").cogroup(old.groupBy("cid", "part")).applyInArrow(grown, SHARD)
        touched.write.mode("overwrite").parquet(f"{self.uri}/shards/version={version}")

    def grow(self, stream: DataFrame, checkpoint: str, first_version: int = 1) -> None:
        """All rows of a stream (vec_id, v) that are there, batch by batch."""
        query = stream.writeStream.foreachBatch(lambda rows, n: self.append(rows, first_version + n))
        query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def search(self, queries: DataFrame, k: int, nprobe: int = 3, ef: int = 64) -> DataFrame:
        """query_id, rank, vec_id, distance, measured: the nearest met in the shards of the nprobe lists
        nearest to each query (query_id, q), and how many nodes a shard's search measured."""
        uri = workdir(self.spark, "queries")
        asked = S.assigned(queries.filter("q is not null").select("query_id", F.col("q").alias("v")), self.centroids, nprobe)
        asked.select("query_id", F.col("v").alias("q"), F.explode("cids").alias("on_")).write.partitionBy("on_").parquet(uri)
        m, beam, block = self.m, self.beam, S.QUERY_BLOCK

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
                graph = LayeredGraph.unpacked(row, m, beam)
                for asked_ids, points in S._blocks(f"{uri}/on_={row['cid']}", block):
                    out = []
                    for q, x in zip(asked_ids.tolist(), points):
                        best, measured = graph.search(x, k, ef)
                        out += [(q, graph.ids[i], d, measured) for d, i in best]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["query_id", "vec_id", "distance", "measured"])

        rows = self.shards().mapInArrow(found, "query_id long, vec_id long, distance double, measured long")
        return S.ranked(rows, k, F.col("distance")).select("query_id", "rank", "vec_id", "distance", "measured")
