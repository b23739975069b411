"""Vector files as Spark reads them: fvecs, ivecs, flat matrices, and a binary graph file."""

from __future__ import annotations

import fnmatch
import json
import struct
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..workspace import file_system

SPLIT_BYTES = 64 << 20
#: Fixed value: how a graph file begins.
GRAPH_MAGIC = b"AGYHNSW1"


@contextmanager
def opened(uri: str):
    system, path = file_system(uri)
    with system.open_input_file(path) as f:
        yield f


@contextmanager
def written(uri: str):
    """A file that is there under its name once all went well; each attempt writes one of its own."""
    system, path = file_system(uri)
    folder, name = path.rsplit("/", 1)
    system.create_dir(folder, recursive=True)
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as f:
        yield f
    system.move(own, path)


def listed(uri: str) -> list[tuple[str, int]]:
    """Address and size of a file, of the files of a folder, or of those that a name with * means."""
    from pyarrow import fs

    system, path = file_system(uri)
    folder, pattern = (path.rsplit("/", 1) if "*" in path else (path, "*"))
    info = system.get_file_info(folder)
    if info.type == fs.FileType.File:
        return [(uri, info.size)]
    found = system.get_file_info(fs.FileSelector(folder)) if info.type == fs.FileType.Directory else []
    scheme = uri[: uri.index(":") + 1] + "//" if ":" in uri else ""
    some = [x for x in found if x.is_file and fnmatch.fnmatch(x.base_name, pattern) and not x.base_name.startswith(("_", "."))]
    return sorted((f"{scheme}{x.path}", x.size) for x in some)


def encode_records(rows: np.ndarray, kind: str) -> bytes:
    """Records of a 32-bit dimension and that many 32-bit values (kind f or i)."""
    values = rows.astype("<f4" if kind == "f" else "<i4")
    return b"".join(struct.pack("<i", values.shape[1]) + r.tobytes() for r in values)


def decode_records(raw: bytes, kind: str, most: int = -1) -> np.ndarray:
    """The dimension is the first record's; a partial record at the end is dropped; a limit counts if positive."""
    if len(raw) < 4:
        return np.zeros((0, 0), "f4" if kind == "f" else "i8")
    d = struct.unpack_from("<i", raw)[0]
    n = len(raw) // (4 + 4 * d)
    n = min(n, most) if most > 0 else n
    whole = np.frombuffer(raw, "<i4", n * (d + 1)).reshape(n, d + 1)[:, 1:]
    return whole.view("<f4") if kind == "f" else whole.astype(np.int64)


class RecordReader(DataSourceReader):
    """Records of a file in splits of whole records; a split reads its own bytes only."""

    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "f")
        self.most, self.bytes = int(options.get("most", "-1")), int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        splits = []
        for uri, size in listed(self.path):
            with opened(uri) as f:
                head = f.read(4)
            if len(head) < 4:
                continue
            width = 4 + 4 * struct.unpack("<i", head)[0]
            n = size // width  # a partial record at the end is dropped
            n = min(n, self.most) if self.most > 0 else n
            each = max(1, self.bytes // width)
            splits += [InputPartition((uri, width, a, min(a + each, n))) for a in range(0, n, each)]
        return splits

    def read(self, partition: InputPartition | None):
        if partition is None:  # Spark asks so where there are no splits
            return
        uri, width, start, end = partition.value
        with opened(uri) as f:
            f.seek(start * width)
            for a in range(start, end, 4096):
                n = min(4096, end - a)
                rows = np.frombuffer(f.read(n * width), "<i4").reshape(n, -1)[:, 1:]
                flat = rows.copy().view("<f4").ravel() if self.kind == "f" else rows.astype(np.int64).ravel()
                offsets = pa.array(np.arange(n + 1) * rows.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([uri] * n), pa.array(np.arange(a, a + n)), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["path", "pos", "values"])


class RecordSource(DataSource):
    """spark.read.format("vecrecords").option("kind", "i").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "vecrecords"

    def schema(self) -> str:
        return f"path string, pos long, values array<{'float' if self.options.get('kind', 'f') == 'f' else 'long'}>"

    def reader(self, schema) -> RecordReader:
        return RecordReader(dict(self.options))


def read_records(spark: SparkSession, path: str, kind: str = "f", most: int = -1) -> DataFrame:
    """path, pos, values of every record of the files at path (a file, a folder, or a name with *), of the
    first most of each file if that is positive."""
    spark.dataSource.register(RecordSource)
    return spark.read.format("vecrecords").options(kind=kind, most=str(most)).load(path)


def matrix(values: pa.Array, dimension: int | None = None) -> np.ndarray:
    """Lists as a matrix. Files of vectors have no place for a null, nor for a vector of another length."""
    n = pc.list_value_length(values)
    if n.null_count or values.flatten().null_count or len(n.unique()) > 1 or (dimension is not None and len(n) and n[0].as_py() != dimension):
        raise ValueError("vectors of a file must be whole and of one length")
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def write_records(rows: DataFrame, uri: str, order: str, column: str, kind: str = "f") -> None:
    """A file of records for each partition, in the order of their names."""

    def write(batches):
        from pyspark import TaskContext

        part, data, width = TaskContext.get().partitionId(), [], None
        name = f"{uri}/part-{part:05d}.{kind}vecs"
        with written(name) as f:
            for batch in batches:
                values = batch.column(1)
                if batch.num_rows:
                    flat = matrix(values, width)
                    width = flat.shape[1]
                    f.write(encode_records(flat, kind))
                    data.append(batch.num_rows)
        yield pa.RecordBatch.from_pydict({"file": [name], "records": [sum(data)]})

    rows.repartitionByRange(order).sortWithinPartitions(order).select(order, column).mapInArrow(write, "file string, records long").collect()  # a row per file


def dataset(spark: SparkSession, folder: str, max_base: int = -1) -> dict[str, DataFrame]:
    """base, query and groundtruth of a benchmark folder; max_base holds for base only."""
    return {"base": read_records(spark, f"{folder}/base", "f", max_base), "query": read_records(spark, f"{folder}/query", "f"), "groundtruth": read_records(spark, f"{folder}/groundtruth", "i")}


def flat_type(name: str, size: int, dimension: int) -> str:
    """int8 if the name says so or the size fits only that; an empty file is an error."""
    if not size:
        raise ValueError(f"{name} is empty")
    return "<i1" if "int8" in name or (size % (4 * dimension) and size % dimension == 0) else "<f4"


class FlatReader(DataSourceReader):
    """Rows of a matrix without a header, in splits of whole rows; of a row only the wanted columns, and of a
    file only the wanted rows, are read."""

    def __init__(self, options: dict):
        self.path, self.dimension = options["path"], int(options["dimension"])
        self.kind, self.bytes = options.get("kind"), int(options.get("splitbytes", SPLIT_BYTES))
        self.rows = int(options.get("from", "0")), int(options.get("to", str(1 << 62)))
        self.columns = int(options.get("first", "0")), int(options.get("last", str(self.dimension)))
        if not 0 <= self.columns[0] < self.columns[1] <= self.dimension:
            raise ValueError("columns must lie in the matrix")

    def partitions(self) -> list[InputPartition]:
        splits = []
        for uri, size in listed(self.path):
            kind = self.kind or flat_type(uri.rsplit("/", 1)[1], size, self.dimension)
            width = np.dtype(kind).itemsize * self.dimension
            start, end = max(self.rows[0], 0), min(self.rows[1], size // width)
            each = max(1, self.bytes // width)
            splits += [InputPartition((uri, kind, a, min(a + each, end))) for a in range(start, end, each)]
        return splits

    def read(self, partition: InputPartition | None):
        if partition is None:
            return
        uri, kind, start, end = partition.value
        item, (first, last) = np.dtype(kind).itemsize, self.columns
        width, wide = item * self.dimension, item * (last - first)
        with opened(uri) as f:
            for a in range(start, end, 4096):
                n = min(4096, end - a)
                if 4 * (last - first) < self.dimension and width > 16_384:  # long rows: their wanted bytes alone
                    raw = b"".join(f.read_at(wide, (a + i) * width + first * item) for i in range(n))
                    rows = np.frombuffer(raw, kind).reshape(n, -1)
                else:
                    rows = np.frombuffer(f.read_at(n * width, a * width), kind).reshape(n, -1)[:, first:last]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * n), pa.array(np.arange(a, a + n)), lists_of(rows.astype("<f4"))], names=["path", "pos", "values"])


def lists_of(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


class FlatSource(DataSource):
    """spark.read.format("flatvectors").option("dimension", 64).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "flatvectors"

    def schema(self) -> str:
        return "path string, pos long, values array<float>"

    def reader(self, schema) -> FlatReader:
        return FlatReader(dict(self.options))


def read_flat(spark: SparkSession, path: str, dimension: int, kind: str | None = None, rows: tuple[int, int] | None = None, columns: tuple[int, int] | None = None) -> DataFrame:
    """path, pos, values of flat matrices (a file, a folder, or a name with *), int8 or float, told by name and
    size where kind (<i1 or <f4) is not given; of rows and columns a range each, ends excluded."""
    spark.dataSource.register(FlatSource)
    options = {"dimension": str(dimension)} | ({"kind": kind} if kind else {})
    options |= {"from": str(rows[0]), "to": str(rows[1])} if rows else {}
    options |= {"first": str(columns[0]), "last": str(columns[1])} if columns else {}
    return spark.read.format("flatvectors").options(**options).load(path)


def write_flat(rows: DataFrame, uri: str, order: str, column: str, kind: str = "<f4") -> None:
    """A flat matrix for each partition, in the order of their names."""

    def write(batches):
        from pyspark import TaskContext

        name, n, width = f"{uri}/part-{TaskContext.get().partitionId():05d}.{'int8' if kind == '<i1' else 'f32'}", 0, None
        with written(name) as f:
            for batch in batches:
                if batch.num_rows:
                    flat = matrix(batch.column(1), width)
                    width, n = flat.shape[1], n + len(flat)
                    f.write(flat.astype(kind).tobytes())
        yield pa.RecordBatch.from_pydict({"file": [name], "rows": [n]})

    rows.repartitionByRange(order).sortWithinPartitions(order).select(order, column).mapInArrow(write, "file string, rows long").collect()  # a row per file


def gathered(asked: DataFrame, path: str, dimension: int, kind: str = "<f4", gap_bytes: int = 4096) -> DataFrame:
    """pos, idx, v for requests (pos, idx) to the rows of flat matrices, numbered through in the order of the
    files' names. A task sorts its requests, reads each row once, and rows that lie near each other in one
    go; nothing else of the files is read. A row asked for twice comes twice; one that is not there (or
    null) has no row."""
    width = np.dtype(kind).itemsize * dimension
    files = [(uri, size // width) for uri, size in listed(path)]  # a number per file
    ends = np.cumsum([n for _, n in files])
    total = int(ends[-1]) if files else 0

    def read(batches):
        for batch in batches:
            idx = batch.column("idx").to_numpy()
            if not len(idx):
                continue
            wanted, place = np.unique(idx, return_inverse=True)
            rows = np.zeros((len(wanted), dimension), "<f4")
            file = np.searchsorted(ends, wanted, side="right")
            runs = np.flatnonzero(np.r_[True, (np.diff(wanted) * width > gap_bytes + width) | (np.diff(file) > 0), True])
            for a, e in zip(runs[:-1].tolist(), runs[1:].tolist()):
                uri, n = files[file[a]]
                at = wanted[a:e] - (ends[file[a]] - n)
                with opened(uri) as f:
                    raw = f.read_at(int(at[-1] - at[0] + 1) * width, int(at[0]) * width)
                rows[a:e] = np.frombuffer(raw, kind).reshape(-1, dimension)[at - at[0]]
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("idx"), lists_of(rows[place])], names=["pos", "idx", "v"])

    own = asked.select(F.col("pos").cast("long").alias("pos"), F.col("idx").cast("long").alias("idx")).filter((F.col("idx") >= 0) & (F.col("idx") < total))
    return own.repartitionByRange("idx").sortWithinPartitions("idx").mapInArrow(read, "pos long, idx long, v array<float>")


def encode_graph(header: dict, neighbours: list[list[int]]) -> bytes:
    head = json.dumps(header, sort_keys=True).encode()
    body = b"".join(struct.pack(f"<H{len(n)}I", len(n), *n) for n in neighbours)
    return GRAPH_MAGIC + struct.pack("<I", len(head)) + head + body


def decode_graph(raw: bytes) -> tuple[dict, list[list[int]]]:
    if raw[:8] != GRAPH_MAGIC:
        raise ValueError("not a graph file")
    n = struct.unpack_from("<I", raw, 8)[0]
    at, out = 12 + n, []
    while at < len(raw):
        k = struct.unpack_from("<H", raw, at)[0]
        out.append(list(struct.unpack_from(f"<{k}I", raw, at + 2)))
        at += 2 + 4 * k
    return json.loads(raw[12 : 12 + n]), out
