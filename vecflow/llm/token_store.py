"""Token files: one zstandard frame per document, a shared dictionary, an offset index.

A store is a folder of

* ``dictionary-<hash>.zdict``: a zstandard dictionary trained on the serialized id arrays of a
  bounded sample of documents;
* ``<shard>.tok``: the documents' frames one after another, in ascending document id;
* ``<shard>.idx``: Parquet with id, offset, bytes and n_tokens of each frame;
* ``manifest.json``: id type, dictionary hash and the shards in order with their counts. Readers
  open only files that it names, so what a lost or repeated task left behind does no harm.

Null texts count as empty; their only id is the end id. Null document ids come first and stay
null. Rows that repeat an id are all kept, ordered by text. An empty table gives a store of no
shards. Columns other than the two named ones are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import new_file, partitions_for, read_bytes
from .tokens import encoder

#: Bound of the dictionary's sample: so many documents, none longer than this.
SAMPLE_DOCUMENTS, SAMPLE_CHARACTERS = 1500, 8192
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3
#: Text that a shard holds, about.
SHARD_BYTES = 64 << 20
#: Documents encoded at once; the encoder takes them in runs of bounded size.
ROWS = 4096

READ_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def id_type(vocabulary_size: int, end_id: int) -> str:
    return "<u2" if max(vocabulary_size, end_id + 1) <= 1 << 16 else "<u4"


def serialized(ids: bytes, end_id: int, dtype: str) -> bytes:
    """The ids (unsigned 32-bit) and the end id, in dtype."""
    return np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)).astype(dtype).tobytes()


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary; where there is too little to train on, the samples' beginning."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def dictionary_hash(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()[:16]


@lru_cache(maxsize=8)
def _dictionary(uri: str, expected: str) -> zstandard.ZstdCompressionDict | None:
    raw = read_bytes(uri)
    if dictionary_hash(raw) != expected:
        raise ValueError(f"{uri} is not the dictionary {expected} that the store was written with")
    return zstandard.ZstdCompressionDict(raw) if raw else None


def _shards(uri: str, name: str, digest: str, dtype: str, vocabulary: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        encode = encoder(vocabulary).encode
        shard = uuid.uuid4().hex
        ids, offsets, sizes, counts = [], [], [], []
        at = 0
        frames = None
        batch = next(batches, None)
        while batch is not None and not batch.num_rows:
            batch = next(batches, None)
        if batch is None:
            return
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(f"{uri}/{name}", digest), write_content_size=True)
        with new_file(f"{uri}/{shard}.tok") as frames:
            while batch is not None:
                for i in range(0, batch.num_rows, ROWS):
                    part = batch.slice(i, ROWS)
                    for key, got in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()])):
                        raw = serialized(got, end_id, dtype)
                        frame = compressor.compress(raw)
                        frames.write(frame)
                        ids.append(key)
                        offsets.append(at)
                        sizes.append(len(frame))
                        counts.append(len(raw) // np.dtype(dtype).itemsize)
                        at += len(frame)
                batch = next(batches, None)
        index = pa.table({"id": pa.array(ids, pa.int64()), "offset": pa.array(offsets, pa.int64()), "bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
        with new_file(f"{uri}/{shard}.idx") as f:
            pq.write_table(index, f)
        known = [x for x in ids if x is not None]
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "documents": [len(ids)], "tokens": [sum(counts)], "bytes": [at], "nulls": [len(ids) - len(known)], "first": pa.array(known[:1] or [None], pa.int64()), "last": pa.array(known[-1:] or [None], pa.int64())},
        )

    return write


def write_tokens(docs: DataFrame, uri: str, vocabulary: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> dict:
    """Encodes every text and writes a store to uri; returns its manifest.

    The driver holds the sample for the dictionary (bounded) and a line per shard."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    # tasks send ids to the driver, not texts; then the chosen texts are read
    chosen = (
        docs.filter(F.length("text").between(1, SAMPLE_CHARACTERS) & F.col("doc_id").isNotNull())
        .select("doc_id")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(SAMPLE_DOCUMENTS)
    )
    found = docs.join(F.broadcast(chosen), "doc_id").filter(F.length("text").between(1, SAMPLE_CHARACTERS)).groupBy("doc_id").agg(F.min("text").alias("text")).toArrow()
    sample = found.sort_by("doc_id")["text"].to_pylist()
    encode = encoder(vocabulary)
    dtype = id_type(encode.vocabulary_size, end_id)
    raw = train_dictionary([serialized(x, end_id, dtype) for x in encode.encode(sample)])
    digest = dictionary_hash(raw)
    name = f"dictionary-{digest}.zdict"
    with new_file(f"{uri}/{name}") as f:
        f.write(raw)
    shards = (
        docs.repartitionByRange(partitions_for(docs, SHARD_BYTES), "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(_shards(uri, name, digest, dtype, vocabulary, end_id), "shard string, documents long, tokens long, bytes long, nulls long, first long, last long")
        .collect()
    )
    listed = sorted((s.asDict() for s in shards), key=lambda s: (s["nulls"] == 0, s["first"] if s["first"] is not None else 0))
    manifest = {"dtype": dtype, "end_id": end_id, "dictionary": name, "dictionary_hash": digest, "shards": listed}
    with new_file(f"{uri}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(uri: str) -> dict:
    return json.loads(read_bytes(f"{uri}/manifest.json"))


def _frames(uri: str, manifest: dict, shard: str, rows: pa.Table) -> Iterator[np.ndarray]:
    """The ids of the index rows, which must be in ascending offset; reads 8 MB at a time at most."""
    decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(f"{uri}/{manifest['dictionary']}", manifest["dictionary_hash"]))
    offsets, sizes = rows["offset"].to_pylist(), rows["bytes"].to_pylist()
    i = 0
    while i < len(offsets):
        j = i + 1
        while j < len(offsets) and offsets[j] + sizes[j] - offsets[i] <= 8 << 20:
            j += 1
        block = memoryview(read_bytes(f"{uri}/{shard}.tok", offsets[i], offsets[j - 1] + sizes[j - 1] - offsets[i]))
        for k in range(i, j):
            yield np.frombuffer(decompressor.decompress(block[offsets[k] - offsets[i] :][: sizes[k]]), manifest["dtype"]).astype("<u4")
        i = j


def _index(uri: str, shard: str) -> pa.Table:
    return pq.read_table(pa.BufferReader(read_bytes(f"{uri}/{shard}.idx")))


def read_document(uri: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents with that id: reads the manifest, one index and their frames."""
    manifest = read_manifest(uri)
    found = []
    for s in manifest["shards"]:
        if s["first"] is not None and s["first"] <= doc_id <= s["last"]:
            index = _index(uri, s["shard"])
            found += _frames(uri, manifest, s["shard"], index.filter(pa.compute.equal(index["id"], doc_id)))
    return found


def scan_tokens(spark: SparkSession, uri: str, what, schema: str) -> DataFrame:
    """Reads all documents of a store, a task for each shard. what(doc_ids, starts, arrays) gives
    the columns of schema for a group of documents; starts counts the ids of all before."""
    manifest = read_manifest(uri)
    rows, start = [], 0
    for s in manifest["shards"]:
        rows.append((s["shard"], start))
        start += s["tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, at in zip(*(c.to_pylist() for c in batch.columns)):
                index = _index(uri, shard)
                for i in range(0, index.num_rows, 1024):
                    part = index.slice(i, 1024)
                    arrays = list(_frames(uri, manifest, shard, part))
                    counts = part["n_tokens"].to_numpy()
                    yield pa.RecordBatch.from_arrays(what(part["id"].combine_chunks(), at + np.cumsum(counts) - counts, arrays), names=names)
                    at += int(counts.sum())

    names = [x.split()[0] for x in schema.split(", ")]
    shards = spark.createDataFrame(rows, "shard string, start long")
    return shards.repartition(max(1, len(rows)), "shard").mapInArrow(read, schema)


def read_tokens(spark: SparkSession, uri: str) -> DataFrame:
    """READ_SCHEMA: every document with its ids as little-endian unsigned 32-bit integers."""
    return scan_tokens(spark, uri, lambda ids, starts, arrays: [ids, pa.array(starts, pa.int64()), pa.array([len(a) for a in arrays], pa.int64()), pa.array([a.tobytes() for a in arrays], pa.binary())], READ_SCHEMA)


def token_digests(spark: SparkSession, uri: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of each document's ids, computed where they are read."""
    return scan_tokens(
        spark,
        uri,
        lambda ids, starts, arrays: [ids, pa.array(starts, pa.int64()), pa.array([len(a) for a in arrays], pa.int64()), pa.array([zlib.crc32(a.tobytes()) for a in arrays], pa.int64())],
        "doc_id long, start long, n_tokens long, ids_crc32 long",
    )
