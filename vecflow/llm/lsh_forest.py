"""N-gram Jaccard join by a MinHash LSH forest.

Each document's five-word shingles give a MinHash signature, cut into the labels of several trees.
A tree is a trie of labels: its documents in the order of their labels, those of one prefix beside
each other. Matching begins with whole labels. The documents of a node are compared by signature;
how often pairs of each likeness met, over all documents, tells how many such pairs there are (a pair
of likeness s shares a prefix of d hashes in s ** d of the trees) and so which share of them all was
found. While that share is below the target, the matched prefix is shortened, to the longest that is
expected to reach the target, and the share is measured again there. One more pair, at the threshold,
counts as unseen, so tables with few pairs match short prefixes.

Documents of a node that may be similar are connected, and each connected group is verified exactly:
all pairs of its texts, by the sizes of intersections of whole shingle sets, in blocks of bounded
size. Pairs whose signatures agree less than may_be() are not connected; a pair at the threshold
falls below that with probability 1e-12.

In a node of up to BLOCK documents each pair is compared. Documents of a larger one are dealt to
parts and compared with the leaders of their part: a document that no leader covers becomes one, and
is connected with every leader it is near enough to, so that by the triangle inequality of signatures
whoever may be similar to it is connected too. The leaders of the parts are compared in the same way.
Two edges for each document at most come of it, however many leaders there are.

Texts with equal shingle sets are one class from the start, of which one text is compared. Nothing
is emitted per pair: a document gets its number of links (documents of similarity at or above the
threshold, itself excluded) and its group, the connected documents.

Texts without words and null texts have no links. Rows that repeat an id and a text count as
documents of their own; so do rows with a null id. An empty table gives an empty result. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shingles import mixed, shingle_sets
from .skew import MOST, join_hot
from .storage import stored

THRESHOLD = 0.8
TREES, LABEL = 24, 7
#: The share of the pairs at or above the threshold that shall meet in some tree.
TARGET_RECALL = 1 - 1e-7
#: Chance that a pair at the threshold agrees too little to be compared.
UNLIKE = 1e-12
#: Nodes above this size are compared by leaders; groups are verified in blocks of this size.
BLOCK = 1024
#: A leader covers the documents whose signatures differ in this share at most.
COVER = 0.2

_SEEDS = np.random.default_rng(11).integers(1, 1 << 62, TREES * LABEL, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOUND = "kind int, a long, b long, prefix long, signature binary"
_EDGE, _SEEN, _LEADER = 0, 1, 2


def meeting(similarity: float | np.ndarray, depth: int) -> float | np.ndarray:
    """The chance that a pair shares a prefix of depth hashes in some tree."""
    return 1 - (1 - np.power(similarity, depth)) ** TREES


def may_be(threshold: float = THRESHOLD, hashes: int = TREES * LABEL, unlike: float = UNLIKE) -> float:
    """The least agreement of signatures that a pair at the threshold misses with chance unlike."""
    total, least = 0.0, 0
    while total <= unlike and least < hashes:
        log = math.lgamma(hashes + 1) - math.lgamma(least + 1) - math.lgamma(hashes - least + 1)
        total += math.exp(log + least * math.log(threshold) + (hashes - least) * math.log1p(-threshold)) if threshold < 1 else 0.0
        least += 1
    return max(least - 1, 0) / hashes


def recall(seen: np.ndarray, depth: int, at: int, threshold: float = THRESHOLD) -> float:
    """The share of pairs at or above the threshold that prefixes of length at find, as estimated from
    seen: how often compared pairs agreed in 0, 1, .. hashes when depth was matched. Signatures
    blur likeness, so pairs that seem up to a tenth below the threshold count as being at it."""
    agreement = np.arange(len(seen)) / (len(seen) - 1)
    near = agreement >= threshold - 0.1
    likeness = np.maximum(agreement[near], threshold)
    pairs = seen[near] / (TREES * likeness**depth)
    unseen = 1.0  # a pair at the threshold
    return float((np.dot(pairs, meeting(likeness, at)) + unseen * meeting(threshold, at)) / (pairs.sum() + unseen))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each of TREES * LABEL hash functions, 16 bits of it."""
    least = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 256):
        np.minimum(least, (shingles[i : i + 256, None] * _SEEDS).min(axis=0), out=least)
    return (mixed(least) >> np.uint64(48)).astype("<u2")


def _signatures(batches):
    for batch in batches:
        # a set goes as soon as it is signed
        found = [(xxhash.xxh3_128_digest(s.tobytes()), signature(s).tobytes()) if len(s) else (None, None) for s in shingle_sets(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_hash"),
                pa.array([k for k, _ in found], pa.binary()),
                pa.array([s for _, s in found], pa.binary()),
            ],
            names=["doc_id", "text_hash", "set_key", "signature"],
        )


def _groups(adjacent: np.ndarray) -> np.ndarray:
    """The first member of each one's connected group, given a symmetric matrix."""
    n = len(adjacent)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            front = np.array([i])
            root[i] = i
            while len(front):
                new = np.flatnonzero(adjacent[front].any(axis=0) & (root < 0))
                root[new] = i
                front = new
    return root


class _Out:
    """What a task found: edges, leaders, and how often pairs agreed in how many hashes."""

    def __init__(self) -> None:
        self.a, self.b, self.leaders = [], [], []
        self.seen = np.zeros(TREES * LABEL + 1, np.int64)

    def batch(self, last: bool) -> pa.RecordBatch:
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.a, self.b))
        bins = np.flatnonzero(self.seen) if last else np.zeros(0, np.int64)
        lead = self.leaders
        n = (len(a), len(bins), len(lead))
        columns = [
            pa.array(np.repeat([_EDGE, _SEEN, _LEADER], n), pa.int32()),
            pa.array(np.concatenate([a, bins, np.array([x[1] for x in lead], np.int64)]), pa.int64()),
            pa.array(np.concatenate([b, self.seen[bins], np.zeros(n[2], np.int64)]), pa.int64()),
            pa.array([0] * (n[0] + n[1]) + [x[0] for x in lead], pa.int64()),
            pa.array([None] * (n[0] + n[1]) + [x[2] for x in lead], pa.binary()),
        ]
        self.a, self.b, self.leaders = [], [], []
        return pa.RecordBatch.from_arrays(columns, names=["kind", "a", "b", "prefix", "signature"])


class _Leaders:
    """The leaders of a part of a large node, as its documents stream by, and which are connected."""

    def __init__(self) -> None:
        self.labels, self.nodes, self.group = np.zeros((64, TREES * LABEL), "<u2"), np.zeros(64, np.int64), np.zeros(64, np.int64)
        self.n = 0

    def add(self, node: int, labels: np.ndarray, link: float, out: _Out) -> bool:
        """Connects a document with the leaders that differ in link at most, by one edge to each group
        of them that is not connected yet; True if it becomes a leader."""
        agreed = (self.labels[: self.n] == labels).sum(axis=1)
        out.seen += np.bincount(agreed, minlength=len(out.seen))
        groups = np.unique(self.group[: self.n][agreed >= (1 - link) * len(labels)])
        out.a.append(np.full(len(groups), node))
        out.b.append(self.nodes[groups])
        if len(groups) > 1:
            self.group[: self.n][np.isin(self.group[: self.n], groups)] = groups[0]
        if self.n and agreed.max() >= (1 - COVER) * len(labels):
            return False
        if self.n == len(self.nodes):
            self.labels, self.nodes, self.group = np.resize(self.labels, (2 * self.n, len(labels))), np.resize(self.nodes, 2 * self.n), np.resize(self.group, 2 * self.n)
        self.labels[self.n], self.nodes[self.n], self.group[self.n] = labels, node, groups[0] if len(groups) else self.n
        self.n += 1
        return True


def _candidates(block: int, least: float, split: bool):
    """Rows (prefix, part, n, node, signature) come in the order of prefix and part. Nodes up to block
    are compared whole: their rows at a batch's end wait for the next one. Documents of larger ones
    are compared with leaders, which are rows of the result if the node was split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rest, lead = _Out(), None, (None, None)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest, lead = _connected(pa.concat_tables([rest, table]) if rest is not None else table, lead, out, False)
            yield out.batch(last=False)
        if rest is not None:
            _connected(rest, lead, out, True)
        yield out.batch(last=True)

    def _connected(table: pa.Table, lead: tuple, out: _Out, last: bool):
        prefix, part, node, n = (table[c].to_numpy() for c in ("prefix", "part", "node", "n"))
        if not len(node):
            return None, lead
        starts = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])])
        ends = np.r_[starts[1:], len(node)]
        keep = None
        if n[starts[-1]] <= block and not last:
            keep, starts, ends = table.slice(int(starts[-1])), starts[:-1], ends[:-1]
        signatures = table["signature"].combine_chunks()
        labels = np.frombuffer(b"".join(signatures.to_pylist()), "<u2").reshape(len(node), -1)
        two = ends - starts == 2
        i = starts[two & (n[starts] <= block)]  # most nodes, all at once
        agreed = (labels[i] == labels[i + 1]).sum(axis=1)
        out.seen += np.bincount(agreed, minlength=len(out.seen))
        i = i[agreed >= least * labels.shape[1]]
        out.a.append(node[i + 1])
        out.b.append(node[i])
        for i, j in zip(starts[~two | (n[starts] > block)].tolist(), ends[~two | (n[starts] > block)].tolist()):
            if n[i] > block:
                if lead[0] != (prefix[i], part[i]):
                    lead = ((prefix[i], part[i]), _Leaders())
                for k in range(i, j):
                    # the leaders of parts are each up to COVER from their documents
                    if lead[1].add(int(node[k]), labels[k], 1 - least + (COVER if split else 3 * COVER), out) and split:
                        out.leaders.append((int(prefix[k]), int(node[k]), signatures[k].as_py()))
            elif j - i > 1:
                agreed = np.stack([(labels[i:j] == x).sum(axis=1) for x in labels[i:j]])
                out.seen += np.bincount(agreed[np.triu_indices(j - i, 1)], minlength=len(out.seen))
                root = _groups(agreed >= least * labels.shape[1])
                linked = np.flatnonzero(root != np.arange(j - i))
                out.a.append(node[i:j][linked])
                out.b.append(node[i:j][root[linked]])
        return keep, lead

    return run


def _met(sets: DataFrame, n_sets: int, depth: int, least: float) -> DataFrame:
    """_FOUND of the documents (node, signature) that share a prefix of depth hashes in some tree."""
    label = lambda t: F.substring("signature", 2 * LABEL * t + 1, 2 * depth)
    tries = sets.select("node", F.posexplode(F.array(*[F.xxhash64(label(t), F.lit(t)) for t in range(TREES)])).alias("tree", "prefix"))
    shared = stored(tries.groupBy("prefix").agg(F.count("*").alias("n")).filter("n > 1"), "nodes")
    nodes = join_hot(tries, shared, "prefix", "n", n_sets * TREES).join(sets.select("node", "signature"), "node")
    parts = F.when(F.col("n") > BLOCK, F.ceil(F.col("n") / BLOCK)).otherwise(F.lit(1))
    members = nodes.withColumns({"part": F.pmod(F.xxhash64("node"), parts).cast("long"), "label": F.expr(f"substring(signature, {2 * LABEL} * tree + 1, {2 * LABEL})")}).drop("tree")
    order = lambda df, *by: df.repartition("prefix", "part").sortWithinPartitions("prefix", "part", *by, "node").select("prefix", "part", "n", "node", "signature")
    found = stored(order(members, "label").mapInArrow(_candidates(BLOCK, least, True), _FOUND), "met")
    leaders = found.filter(F.col("kind") == _LEADER).select("prefix", F.lit(0).cast("long").alias("part"), F.lit(BLOCK + 1).cast("long").alias("n"), F.col("a").alias("node"), "signature")
    if leaders.isEmpty():
        return found
    return found.filter(F.col("kind") != _LEADER).unionByName(stored(order(leaders).mapInArrow(_candidates(BLOCK, least, False), _FOUND), "met"))


def candidates(sets: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> tuple[DataFrame, int, float]:
    """Edges (a, b) between documents that may be similar, the length of the prefix that was matched
    in the end, and the share of pairs that is found with it, as measured there."""
    depth, least, n_sets = LABEL, may_be(threshold), sets.count()
    while True:
        found = _met(sets, n_sets, depth, least)
        seen = np.zeros(TREES * LABEL + 1)
        for row in found.filter(F.col("kind") == _SEEN).groupBy("a").agg(F.sum("b").alias("n")).collect():  # a row per number of hashes
            seen[row["a"]] = row["n"]
        got = recall(seen, depth, depth, threshold)
        if got >= target or depth == 1:
            return found.filter(F.col("kind") == _EDGE).select("a", "b"), depth, got
        depth = next((d for d in range(depth - 1, 1, -1) if recall(seen, depth, d, threshold) >= target), 1)


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set of hashes."""
    own = np.concatenate(left + right) if left or right else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    _, column, count = np.unique(own, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        i, j = np.searchsorted(column, [a, a + 2048])
        part = np.zeros((len(left) + len(right), 2048), np.float32)
        part[owner[i:j], column[i:j] - a] = 1
        out += part[: len(left)] @ part[len(left) :].T
    return out


def _verified(threshold: float):
    def verify(key: tuple, table: pa.Table) -> pa.Table:
        """Links and the local group of each document of a block, or of a pair of blocks."""
        nodes, weight, block = table["node"].to_numpy(), table["copies"].to_numpy(), table["block"].to_numpy()
        order = np.unique(nodes, return_index=True)[1]  # rows may repeat
        sets = list(shingle_sets(table["text"].combine_chunks().take(pa.array(order))))
        nodes, weight, block = nodes[order], weight[order], block[order]
        sizes = np.array([len(s) for s in sets])
        first, second = int(key[1].as_py()), int(key[2].as_py())
        left = np.flatnonzero(block == first)
        right = left if first == second else np.flatnonzero(block == second)
        shared = intersections([sets[i] for i in left], [sets[i] for i in right])
        union = sizes[left][:, None] + sizes[right][None, :] - shared
        similar = shared >= threshold * union - 1e-6
        links = np.zeros(len(nodes), np.int64)
        adjacent = np.zeros((len(nodes),) * 2, bool)
        if first == second:
            np.fill_diagonal(similar, False)
            links[left] = similar @ weight[left]
            adjacent[np.ix_(left, left)] = similar
        else:
            links[left] = similar @ weight[right]
            links[right] = similar.T @ weight[left]
            adjacent[np.ix_(left, right)] = similar
            adjacent[np.ix_(right, left)] = similar.T
        root = _groups(adjacent)
        return pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array(nodes[root], pa.int64()), "links": pa.array(links, pa.int64())})

    return verify


def joined(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_hash (64 bits), class_id (the least doc_id of the group), n_links, keeper (the
    group's first row by doc_id and text) for every row of docs."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    signed = stored(own.select("doc_id", "text_hash", "text").mapInArrow(_signatures, "doc_id long, text_hash long, set_key binary, signature binary").withColumn("uid", F.monotonically_increasing_id()), "signatures")
    # texts of one shingle set: the first stands for all
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash", "uid")).alias("first")
    sets = stored(
        signed.filter("set_key is not null").groupBy("set_key").agg(first, F.count("*").alias("copies"), F.first("signature").alias("signature")).select("set_key", "first.doc_id", "first.text_hash", F.col("first.uid").alias("node"), "copies", "signature"),
        "sets",
    )
    edges, _, _ = candidates(sets.select("node", "signature"), threshold)
    groups = stored(components(edges), "groups")
    # the documents of a group in blocks; each pair of blocks is verified by a task of its own
    large = groups.groupBy("root").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK)
    few = groups.count() <= BLOCK * MOST
    placed = groups.join(F.broadcast(large) if few else large, "root", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    texts = own.join(placed.join(sets.drop("signature", "set_key"), "node").select("doc_id", "text_hash", "node", "copies", "root", "blocks", "block").withColumnsRenamed({"doc_id": "known", "text_hash": "known_hash"}), F.col("doc_id").eqNullSafe(F.col("known")) & (F.col("text_hash") == F.col("known_hash")))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("first"), F.greatest(k, F.col("block")).alias("second")))
    units = texts.select("root", "node", "copies", "block", "text", F.explode(pairs).alias("pair")).select(F.col("root").alias("comp"), "pair.first", "pair.second", "node", "copies", "block", "text")
    checked = stored(units.groupBy("comp", "first", "second").applyInArrow(_verified(threshold), "node long, root long, links long"), "verified")
    found = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    described = stored(sets.drop("doc_id", "text_hash", "signature").join(links, "node", "left").join(found, "node", "left").select("set_key", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), "described")
    ids = signed.drop("signature")
    n_rows = ids.count()
    counted = join_hot(ids.filter("set_key is not null"), described, "set_key", "copies", n_rows).select("doc_id", "text_hash", "uid", "root", (F.col("copies") - 1 + F.col("links")).alias("n_links"))
    # a row without words is a group of its own
    alone = ids.filter("set_key is null").select("doc_id", "text_hash", "uid", (-1 - F.col("uid")).alias("root"), F.lit(0).cast("long").alias("n_links"))
    rows = stored(counted.unionByName(alone), "rows")
    classes = stored(rows.groupBy("root").agg(first, F.count("*").alias("members")).select("root", "members", F.col("first.doc_id").alias("class_id"), F.col("first.uid").alias("keeper_uid")), "classes")
    return join_hot(rows, classes, "root", "members", n_rows).select("doc_id", "text_hash", "class_id", "n_links", (F.col("uid") == F.col("keeper_uid")).alias("keeper"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs without all but the first of each group of similar documents."""
    kept = joined(docs, threshold).filter("keeper").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    # wordless rows that repeat are groups of their own: as many of them stay as were kept
    kept = kept.groupBy("kept_id", "kept_hash").agg(F.count("*").alias("kept_rows"))
    marked = docs.withColumn("kept_hash_", F.xxhash64(F.col("text").cast("string")))
    from pyspark.sql import Window

    same = F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")) & (F.col("kept_hash_") == F.col("kept_hash"))
    copy = F.row_number().over(Window.partitionBy("doc_id", "kept_hash_").orderBy(F.lit(0)))
    return marked.join(kept, same).withColumn("copy_", copy).filter("copy_ <= kept_rows").select(*docs.columns)
