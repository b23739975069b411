"""Removal of byte strings that an earlier document holds, over suffix arrays.

Every string of LENGTH bytes is decided, at every position of every text:

1. Texts are gathered into batches (a Parquet table in the shared folder).
2. A string's anchor is its q-gram with the least hash, so equal strings have the same anchor at
   the same place. Only anchors are shuffled: per batch their distinct hashes, packed, each to the
   partition of its value. What comes back tells each batch which of its anchors some other
   document has too.
3. Those anchors, with the bytes around them that their strings can reach, are sorted as suffixes, most
   significant bytes first: the q-gram (the anchor) gives the initial bucket, buckets of more than one
   suffix are refined by the words of bytes at later offsets. As a string is of fixed length, so is
   the window that is compared, and it is shorter than pointers to other suffixes' buckets would pay
   for: this is a fixed-width sort, not bucket-pointer refinement, which reuses refined pointers. The
   order and the common prefixes of neighbours give the class of every string that contains the
   anchor, and with it the least document id.
4. Each batch marks the bytes of strings whose least document id is smaller than its own.

Equal contexts of a batch travel as one, so a passage that all documents share costs an entry per
batch. A null text is empty; rows with a null id come after all ids; rows that repeat an id do not
remove each other's bytes. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mixed
from .storage import list_files, plan_bytes, read_bytes, remove, stored, workdir

LENGTH, GRAM = 50, 16
#: Bytes beside an anchor that a string can reach.
REACH = LENGTH - GRAM
BATCH_BYTES, SEGMENT = 6 << 20, 1 << 22
PLACE_BITS = np.uint64(24)
PARTITION_BYTES = 8 << 20
MOST_PARTITIONS = 4096
LAST = np.iinfo(np.int64).max
#: The folder of what is sorted, beside one of places for each batch.
ENTRIES = "entries"

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def grams(data: np.ndarray, at: int = 0, n: int | None = None) -> np.ndarray:
    """The 8-byte grams of data as integers, from each of n places on."""
    n = len(data) - at - 7 if n is None else n
    return np.ndarray((max(n, 0),), "<u8", data, at, (1,)).copy()


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, first, last, hash): each anchor and the strings, by their starts, that it stands for.

    data is padded by LENGTH bytes; ends are the documents' ends."""
    n = int(ends[-1]) if len(ends) else 0
    found = []
    for s in range(0, max(n - LENGTH + 1, 0), SEGMENT):
        count = min(SEGMENT, n - LENGTH + 1 - s)
        m = count + REACH
        h = mixed(grams(data, s, m) * _A ^ mixed(grams(data, s + 8, m) * _B))
        key = (h & ~((np.uint64(1) << PLACE_BITS) - np.uint64(1))) | np.arange(m, dtype=np.uint64)
        least, width = key, 1
        while 2 * width <= REACH + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < REACH + 1:
            least = np.minimum(least[: count + 0], least[REACH + 1 - width :][:count])
        starts = np.arange(s, s + count)
        whole = np.flatnonzero(starts + LENGTH <= ends[np.searchsorted(ends, starts, side="right")])
        if not len(whole):
            continue
        place = (least[whole] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], len(place)] - 1
        found.append((place[first] + s, whole[first] + s, whole[last] + s, h[place[first]]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import uuid

    ids, sizes, body, held = [], [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {
                "batch": [uuid.uuid4().hex],
                "ids": [pa.array(ids, pa.int64()).fill_null(LAST).to_numpy().tobytes()],
                "known": [np.array([i is not None for i in ids]).tobytes()],
                "sizes": [np.array(sizes, np.int64).tobytes()],
                "body": [zstandard.ZstdCompressor(level=3).compress(b"".join(body))],
            },
            schema=pa.schema([("batch", pa.string()), ("ids", pa.binary()), ("known", pa.binary()), ("sizes", pa.binary()), ("body", pa.binary())]),
        )

    for rows in batches:
        for key, text in zip(*(c.to_pylist() for c in rows.columns)):
            raw = (text or "").encode("utf-8", "surrogatepass")
            if ids and held + len(raw) > BATCH_BYTES:
                yield batch()
                ids, sizes, body, held = [], [], [], 0
            ids.append(key)
            sizes.append(len(raw))
            body.append(raw)
            held += len(raw)
    if ids:
        yield batch()


class Batch:
    """A row of the batch table, opened."""

    def __init__(self, row: dict):
        self.name = row["batch"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        raw = zstandard.ZstdDecompressor().decompress(row["body"])
        self.data = np.frombuffer(b"\xff" * REACH + raw + b"\xff" * LENGTH, np.uint8)
        self.own = self.data[REACH:]

    def anchors(self, partitions: int):
        """place, first, last, document, and the order and bounds of the distinct packed hashes."""
        place, first, last, h = anchors(self.own, self.ends)
        doc = np.searchsorted(self.ends, place, side="right")
        part = (h % np.uint64(partitions)).astype(np.int64)
        value = (h // np.uint64(partitions)) & np.uint64((1 << 40) - 1)
        order = np.lexsort((self.ids[doc], value, part))
        part, value = part[order], value[order]
        new = np.r_[True, (part[1:] != part[:-1]) | (value[1:] != value[:-1])] if len(order) else np.zeros(0, bool)
        return place, first, last, doc, order, part, value, new


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
    for rows in batches:
        for i in range(rows.num_rows):
            yield Batch(rows.slice(i, 1).to_pylist()[0])


def _hashes(partitions: int):
    def run(batches):
        for b in _opened(batches):
            _, _, _, doc, order, part, value, new = b.anchors(partitions)
            if not len(order):
                continue
            start = np.flatnonzero(new)
            end = np.r_[start[1:], len(order)] - 1
            ids = b.ids[doc[order]]
            several = ids[start] != ids[end]
            p, v = part[start], value[start]
            edge = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            stop = np.r_[edge[1:], len(p)]
            raw = v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            yield pa.RecordBatch.from_arrays(
                [pa.array(p[edge], pa.int64()), pa.array([b.name] * len(edge)), pa.array([raw[i:j].tobytes() for i, j in zip(edge, stop)], pa.binary()), pa.array([np.packbits(several[i:j]).tobytes() for i, j in zip(edge, stop)], pa.binary())],
                names=["part", "batch", "hashes", "several"],
            )

    return run


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    """For each batch which of its hashes another document has too, as bits."""
    raw = [np.frombuffer(x, np.uint8).reshape(-1, 5) for x in table["hashes"].to_pylist()]
    sizes = [len(x) for x in raw]
    wide = np.zeros((sum(sizes), 8), np.uint8)
    wide[:, :5] = np.concatenate(raw)
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[:n] for x, n in zip(table["several"].to_pylist(), sizes)]).astype(bool)
    _, inverse, count = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
    shared = several | (count[inverse] > 1)
    cuts = np.cumsum([0, *sizes])
    return pa.table({"batch": table["batch"], "part": pa.array([key[0].as_py()] * len(sizes), pa.int64()), "bits": pa.array([np.packbits(shared[i:j]).tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())})


def _side(folder: str) -> pa.Table | None:
    """What was written for a batch, read where the batch is at hand."""
    try:
        files = list_files(folder, ".parquet")
    except FileNotFoundError:
        return None
    return pa.concat_tables([pq.read_table(pa.BufferReader(read_bytes(f))) for f in files]).sort_by("part")


def _contexts(partitions: int, bits_uri: str):
    def run(batches):
        press = zstandard.ZstdCompressor(level=3).compress
        for b in _opened(batches):
            side = _side(f"{bits_uri}/batch={b.name}")
            if side is None:
                continue
            place, first, last, doc, order, part, value, new = b.anchors(partitions)
            rank = np.cumsum(new) - 1
            p = part[new]
            sizes = np.bincount(p, minlength=partitions)[side["part"].to_numpy()]
            shared = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[:n] for x, n in zip(side["bits"].to_pylist(), sizes)]).astype(bool)
            pick = np.flatnonzero(shared[rank])
            if not len(pick):
                continue
            at = order[pick]
            around = np.lib.stride_tricks.sliding_window_view(b.data, 2 * REACH + GRAM)[place[at]]
            # equal contexts with equal strings are one entry; those of a partition stay together
            lo, hi = (place[at] - last[at]).astype(np.uint8), (place[at] - first[at]).astype(np.uint8)
            rows = np.concatenate([part[pick].astype(">u4").view(np.uint8).reshape(-1, 4), around, lo[:, None], hi[:, None]], axis=1)
            entry, inverse = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), return_inverse=True)
            least = np.full(len(entry), LAST)
            np.minimum.at(least, inverse, b.ids[doc[at]])
            plain = entry.view(np.uint8).reshape(len(entry), -1)
            p = plain[:, :4].copy().view(">u4").ravel().astype(np.int64)
            edge = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            stop = np.r_[edge[1:], len(p)]
            where = np.stack([doc[at], place[at], lo, hi, inverse], axis=1).astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([-1, *p[edge].tolist()], pa.int64()),
                    pa.array([b.name] * (len(edge) + 1)),
                    pa.array([press(where.T.tobytes()), *(press(plain[i:j, 4:].tobytes()) for i, j in zip(edge, stop))], pa.binary()),
                    pa.array([None, *(press(least[i:j].tobytes()) for i, j in zip(edge, stop))], pa.binary()),
                ],
                names=["part", "batch", "body", "least"],
            )

    return run


def bucket_pointers(initial: np.ndarray, later: list[np.ndarray]) -> np.ndarray:
    """Sorts suffixes: buckets of the initial identifiers, refined by the identifiers at later
    offsets. A suffix's bucket pointer is where its bucket begins; only buckets of more than one
    suffix are sorted again. Returns the suffixes in order."""
    order = np.argsort(initial, kind="stable")
    ranked = initial[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    pointer = np.flatnonzero(new)[np.cumsum(new) - 1]  # by position
    for identifier in later:
        size = np.bincount(pointer, minlength=len(pointer))[pointer]
        open_ = np.flatnonzero(size > 1)
        if not len(open_):
            break
        own = order[open_]
        key = identifier[own]
        again = np.lexsort((key, pointer[open_]))
        order[open_] = own[again]
        bucket, key = pointer[open_][again], key[again]
        new = np.r_[True, (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])]
        pointer[open_] = open_[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return order


def prefix_classes(initial: np.ndarray, text: np.ndarray) -> Iterator[np.ndarray]:
    """For t = 0, 1, ..: the class of each row by its initial identifier and the first t bytes."""
    width = text.shape[1]
    padded = np.pad(text, ((0, 0), (0, -width % 8)))
    later = [padded[:, i : i + 8].copy().view(">u8").ravel().astype(np.uint64) for i in range(0, padded.shape[1], 8)]
    order = bucket_pointers(initial, later)
    sorted_text, sorted_initial = text[order], initial[order]
    equal = sorted_text[1:] == sorted_text[:-1]
    common = np.where(equal.all(axis=1), width, np.argmin(equal, axis=1)) if len(order) > 1 else np.zeros(0, int)
    common = np.where(sorted_initial[1:] == sorted_initial[:-1], common, -1)
    for t in range(width + 1):
        classes = np.empty(len(order), np.int64)
        classes[order] = np.cumsum(np.r_[0, common < t])
        yield classes


def _least(key: tuple, table: pa.Table) -> pa.Table:
    """The least document id of every string of every entry, in the entries' order, per batch."""
    out = zstandard.ZstdDecompressor().decompress
    width = 2 * REACH + GRAM + 2
    bodies = [np.frombuffer(out(x), np.uint8).reshape(-1, width) for x in table["body"].to_pylist()]
    least = np.concatenate([np.frombuffer(out(x), np.int64) for x in table["least"].to_pylist()])
    rows = np.concatenate(bodies)
    cuts = np.cumsum([0, *map(len, bodies)])
    lo, hi = rows[:, -2].astype(int), rows[:, -1].astype(int)
    gram = _pair_ranks(grams8(rows, REACH), grams8(rows, REACH + 8))
    right = list(prefix_classes(gram, rows[:, REACH + GRAM : -2]))
    result = np.full((len(rows), REACH + 1), LAST)
    for s, left in enumerate(prefix_classes(gram, rows[:, :REACH][:, ::-1])):
        have = np.flatnonzero((lo <= s) & (s <= hi))  # the string begins s bytes before the anchor
        if len(have):
            pair = left[have] * len(rows) + right[REACH - s][have]
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
            new = np.r_[True, pair[1:] != pair[:-1]]
            smallest = np.minimum.reduceat(least[have][order], np.flatnonzero(new))
            result[have[order], s] = smallest[np.cumsum(new) - 1]
    press = zstandard.ZstdCompressor(level=3).compress
    return pa.table({"batch": table["batch"], "part": pa.array([key[0].as_py()] * len(bodies), pa.int64()), "least": pa.array([press(result[i:j].tobytes()) for i, j in zip(cuts, cuts[1:])], pa.binary())})


def _pair_ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal pairs get equal numbers."""
    order = np.lexsort((b, a))
    new = np.r_[False, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(new)
    return out


def grams8(rows: np.ndarray, at: int) -> np.ndarray:
    return np.ascontiguousarray(rows[:, at : at + 8]).view("<u8").ravel()


def _marked(found_uri: str, least_uri: str):
    def run(batches):
        out = zstandard.ZstdDecompressor().decompress
        for row in (r for rows in batches for i in range(rows.num_rows) for r in rows.slice(i, 1).to_pylist()):
            b = Batch(row)
            n = int(b.sizes.sum())
            change = np.zeros(n + 1, np.int64)
            if (where := _side(f"{found_uri}/kind={b.name}")) is not None:
                doc, place, lo, hi, entry = np.frombuffer(out(where["body"][0].as_py()), "<i4").reshape(5, -1).astype(np.int64)
                side = _side(f"{least_uri}/batch={b.name}")
                least = np.concatenate([np.frombuffer(out(x), np.int64).reshape(-1, REACH + 1) for x in side["least"].to_pylist()])
                begins = []
                for s in range(REACH + 1):
                    pick = np.flatnonzero((lo <= s) & (s <= hi))
                    pick = pick[least[entry[pick], s] < b.ids[doc[pick]]]
                    begins.append(place[pick] - s)
                begins = np.concatenate(begins)
                change = np.bincount(begins, minlength=n + 1) - np.bincount(begins + LENGTH, minlength=n + 1)
            gone = np.cumsum(change)[:n] > 0
            raw = b.own[:n]
            offsets = b.ends - b.sizes
            columns = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            known = np.frombuffer(row["known"], bool)
            for i, (a, e) in enumerate(zip(offsets.tolist(), b.ends.tolist())):
                g = gone[a:e]
                columns["doc_id"].append(int(b.ids[i]) if known[i] else None)
                columns["n_bytes"].append(e - a)
                columns["n_removed"].append(int(g.sum()))
                columns["n_spans"].append(int((g[1:] & ~g[:-1]).sum() + g[0]) if e > a else 0)
                columns["kept_sha256"].append(hashlib.sha256(raw[a:e][~g].tobytes() if columns["n_removed"][-1] else raw[a:e].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in columns.items()], names=list(columns))

    return run


def deduplicated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = stored(own.mapInArrow(_packed, "batch string, ids binary, known binary, sizes binary, body binary"), "batches")
    partitions = int(min(MOST_PARTITIONS, max(4, (plan_bytes(docs) or 0) // PARTITION_BYTES)))
    hashes = texts.mapInArrow(_hashes(partitions), "part long, batch string, hashes binary, several binary")
    bits = workdir(spark, "shared")
    hashes.groupBy("part").applyInArrow(_shared, "batch string, part long, bits binary").repartition("batch").write.partitionBy("batch").parquet(bits)
    found_uri, least = workdir(spark, "contexts"), workdir(spark, "least")
    # a batch's places stay where its task writes them; only entries move on
    columns = "part long, batch string, body binary, least binary"
    kind = F.when(F.col("part") < 0, F.col("batch")).otherwise(ENTRIES).alias("kind")
    texts.mapInArrow(_contexts(partitions, bits), columns).select("*", kind).write.partitionBy("kind").option("compression", "zstd").parquet(found_uri)
    remove(spark, bits)
    entries = spark.read.schema(f"{columns}, kind string").parquet(found_uri).filter(F.col("kind") == ENTRIES).drop("kind")
    entries.groupBy("part").applyInArrow(_least, "batch string, part long, least binary").repartition("batch").write.partitionBy("batch").parquet(least)
    result = stored(texts.mapInArrow(_marked(found_uri, least), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "deduplicated")
    for uri in (found_uri, least, *{f.rsplit("/", 1)[0] for f in texts.inputFiles()}):
        remove(spark, uri)
    return result
