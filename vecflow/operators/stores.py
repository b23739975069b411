"""Stored tables: vectors, codes, shards of records, index artefacts, logs."""

from __future__ import annotations

import json
import math
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quantize as Q
from ..workspace import stored
from .dedup import numbered


def _exists(spark: SparkSession, uri: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


#: Rows of a list of a stored index that a task writes.
LIST_ROWS = 100_000


def _rows(spark: SparkSession, uri: str, schema: str) -> DataFrame:
    """The rows of a folder, none if nothing was written yet."""
    return spark.read.schema(schema).parquet(uri) if _exists(spark, uri) else spark.createDataFrame([], schema)


class VectorStore:
    """Vectors at dense positions from 0; batches are added behind each other.

    Appending a batch is one Parquet write, so a batch is there whole or not at all."""

    SCHEMA = "idx long, v array<float>"

    def __init__(self, spark: SparkSession, uri: str, dimension: int, capacity: int | None = None):
        self.spark, self.uri, self.dimension, self.capacity = spark, uri, dimension, capacity

    def rows(self) -> DataFrame:
        return _rows(self.spark, self.uri, self.SCHEMA)

    def count(self) -> int:
        return self.rows().count()

    def append(self, batch: DataFrame, order: str) -> tuple[int, int]:
        """Adds the vectors v of batch in ascending order; the positions they got, end excluded. The batch is
        made once and read from there, as it is looked at four times."""
        batch = stored(batch.select(order, "v"), "batch")
        if batch.filter(F.coalesce(F.size("v") != self.dimension, F.lit(True))).limit(1).count():
            raise ValueError(f"vectors must have {self.dimension} values")
        start, n = self.count(), batch.count()
        if self.capacity is not None and start + n > self.capacity:
            raise OverflowError(f"{start + n} vectors are more than {self.capacity}")
        own = numbered(batch, order, "idx")
        own.select((F.col("idx") + start).alias("idx"), F.col("v").cast("array<float>").alias("v")).write.mode("append").parquet(self.uri)
        return start, start + n

    def between(self, start: int, end: int) -> DataFrame:
        """Positions start to end, end excluded; the range reaches the scan."""
        return self.rows().filter((F.col("idx") >= start) & (F.col("idx") < end))

    def gather(self, asked: DataFrame) -> DataFrame:
        """pos, idx, v for requests (pos, idx); a position asked for twice comes twice, one that is not
        there has no row."""
        return asked.join(self.rows(), "idx").select("pos", "idx", "v")


class QuantizedStore:
    """Signed 8-bit codes at dense positions, with the ranges they decode by, fitted on the first batch."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.codes_uri, self.ranges_uri = spark, f"{uri}/codes", f"{uri}/ranges"

    def rows(self) -> DataFrame:
        return _rows(self.spark, self.codes_uri, "vector_idx long, id long, code array<tinyint>")

    def ranges(self) -> DataFrame:
        return _rows(self.spark, self.ranges_uri, "lows array<double>, scales array<double>")

    def append(self, batch: DataFrame, order: str, fit_on: DataFrame | None = None) -> None:
        """Adds the vectors v of batch in ascending order. Ranges come from fit_on (by default the batch)
        at the first call and stay; later values beyond them are clipped."""
        if self.ranges().isEmpty():
            Q.as_arrays(Q.dimension_ranges(batch if fit_on is None else fit_on)).write.parquet(self.ranges_uri)
        start = self.rows().count()
        coded = numbered(batch.select(order, "v"), order, "place").crossJoin(F.broadcast(self.ranges()))  # one row
        code = Q.signed_codes(F.col("v"), F.col("lows"), F.col("scales")).cast("array<tinyint>")
        coded.select((F.col("place") + start).alias("vector_idx"), F.col(order).cast("long").alias("id"), code.alias("code")).write.mode("append").parquet(self.codes_uri)

    def decoded(self) -> DataFrame:
        return self.rows().crossJoin(F.broadcast(self.ranges())).select("vector_idx", "id", Q.decoded(F.col("code"), F.col("lows"), F.col("scales"), 128).alias("v"))

    def manifest(self) -> DataFrame:
        """Totals and sizes: codes take a byte for each value, vectors four."""
        own = self.rows().agg(F.count("*").alias("total_vectors"), F.coalesce(F.max(F.size("code")), F.lit(0)).alias("vector_dimension"))
        values = F.col("total_vectors") * F.col("vector_dimension")
        return own.select("total_vectors", "vector_dimension", *size_columns(values))


def size_columns(values: Column) -> list[Column]:
    """Megabytes of so many values as 32-bit floats and as bytes, and the share that is saved."""
    return [F.round(values * 4 / 1048576, 2).alias("raw_float32_size_mb"), F.round(values / 1048576, 2).alias("quantized_size_mb"), F.lit(75.0).alias("ram_saving_percent")]


class ShardWriter:
    """Records as JSON lines in folders of per_file records; a run goes on in the last shard if that is
    not full."""

    def __init__(self, spark: SparkSession, uri: str, schema: str, per_file: int = 50_000):
        self.spark, self.uri, self.schema, self.per_file = spark, uri, schema, per_file

    def rows(self) -> DataFrame:
        columns = f"{self.schema}, shard_id long"
        return self.spark.read.schema(columns).json(self.uri) if _exists(self.spark, self.uri) else self.spark.createDataFrame([], columns)

    def write(self, rows: DataFrame, order: str) -> None:
        before = self.rows().count()
        placed = numbered(rows, order, "place_").withColumn("shard_id", F.floor((F.col("place_") + before) / self.per_file)).drop("place_")
        placed.repartition("shard_id").sortWithinPartitions("shard_id", order).write.mode("append").partitionBy("shard_id").json(self.uri)

    def manifest(self) -> DataFrame:
        """shard_id, records, files and bytes of each shard."""
        if not _exists(self.spark, self.uri):
            return self.spark.createDataFrame([], "shard_id long, records long, files long, bytes long")
        files = self.rows().groupBy("shard_id", F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), F.max("_metadata.file_size").alias("size"))
        return files.groupBy("shard_id").agg(F.sum("n").alias("records"), F.count("*").alias("files"), F.sum("size").alias("bytes"))


def merged(members: list[DataFrame], uri: str) -> DataFrame:
    """Members behind each other in one table, as it was written."""
    whole = members[0]
    for other in members[1:]:
        whole = whole.unionByName(other)
    whole.write.parquet(uri)
    return whole.sparkSession.read.schema(whole.schema).parquet(uri)


def save_index(shards: DataFrame, centroids: DataFrame, uri: str) -> None:
    """Centroids, vectors by list, and the size of each list. A list is written in parts of up to about
    LIST_ROWS rows, each by a task of its own."""
    centroids.write.parquet(f"{uri}/centroids")
    held = stored(shards, "lists")
    sizes = stored(held.groupBy("cid").agg(F.count("*").alias("n")), "list_sizes")  # a row per list
    part = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("list_rows_") / LIST_ROWS))
    dealt = held.join(F.broadcast(sizes.withColumnRenamed("n", "list_rows_")), "cid").withColumn("part_", part)
    dealt.repartition("cid", "part_").select(*shards.columns).write.partitionBy("cid").parquet(f"{uri}/shards")
    every = centroids.select("cid").join(sizes, "cid", "left").select("cid", F.coalesce("n", F.lit(0)).alias("n"))
    every.write.json(f"{uri}/router")


def load_index(spark: SparkSession, uri: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """shards (filters on cid prune folders), centroids and the router's sizes."""
    shards = spark.read.schema("vec_id long, v array<double>, cid int").parquet(f"{uri}/shards")
    return shards, spark.read.schema("cid int, c array<double>").parquet(f"{uri}/centroids"), spark.read.schema("cid int, n long").json(f"{uri}/router")


def log_queries(found: DataFrame, uri: str, at: datetime | None = None) -> DataFrame:
    """Appends a line for each query (query, results) and gives the log as it is now."""
    stamp = int((at or datetime.now(timezone.utc)).timestamp())
    name = F.concat(F.lit(f"query_{stamp}_"), F.substring(F.md5("query"), 1, 8))
    found.select(name.alias("name"), "query", "results").write.mode("append").json(uri)
    return found.sparkSession.read.schema("name string, query string, results long").json(uri)


def replaced(table: DataFrame, uri: str) -> DataFrame:
    """The changed table written to a new version beside the old ones. A version counts once its write is
    committed, which one file marks, so readers see the old table or the new one; two writers of the
    same version: the second fails."""
    spark = table.sparkSession
    begun = [n for n, _ in _versions(spark, uri)]
    table.write.parquet(f"{uri}/versions/{max(begun, default=-1) + 1:06d}")
    return current(spark, uri, table.schema)


def _versions(spark: SparkSession, uri: str) -> list[tuple[int, bool]]:
    """Number of each version, and whether it is committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    versions = path(f"{uri}/versions")
    system = versions.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in system.listStatus(versions)] if system.exists(versions) else []
    return [(int(p.getName()), system.exists(path(p, "_SUCCESS"))) for p in found if p.getName().isdigit()]


def current(spark: SparkSession, uri: str, schema) -> DataFrame:
    """The newest committed version."""
    n = max(n for n, whole in _versions(spark, uri) if whole)
    return spark.read.schema(schema).parquet(f"{uri}/versions/{n:06d}")


def newest(spark: SparkSession, uri: str, schema, before: int | None = None) -> DataFrame:
    """The newest committed version below `before`, no rows if there is none."""
    whole = [n for n, committed in _versions(spark, uri) if committed and (before is None or n < before)]
    return spark.read.schema(schema).parquet(f"{uri}/versions/{max(whole):06d}") if whole else spark.createDataFrame([], schema)


def cached_vectors(spark: SparkSession, uri: str, dimension: int, rows: int = 100, seed: int = 42) -> tuple[DataFrame, bool]:
    """vec_id, v of a cache at uri, and True; where there is none so many random unit vectors, and False."""
    if _exists(spark, uri):
        return spark.read.parquet(uri).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")), True
    random = np.random.default_rng(seed).normal(size=(rows, dimension))
    unit = random / np.maximum(np.linalg.norm(random, axis=1, keepdims=True), 1e-12)
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(unit)], "vec_id long, v array<double>"), False


def first_there(spark: SparkSession, places: list[tuple[str, str]], limit: int, stride: int = 20) -> tuple[DataFrame, str] | None:
    """Rows of the first of some places (address, kind) that is there, and its address; None if none is. A
    cache gives its first rows by vec_id, a corpus every stride-th one; up to limit of them, a report's
    sample."""
    for uri, kind in places:
        if _exists(spark, uri):
            rows = spark.read.parquet(uri)
            rows = rows.filter(F.col("vec_id") % stride == 0) if kind == "corpus" else rows
            return rows.orderBy("vec_id").limit(limit), uri
    return None


def to_markdown(rows: list[dict]) -> str:
    """A small report as a table."""
    if not rows:
        return ""
    names = list(rows[0])
    lines = [names, ["---"] * len(names), *([str(r[n]) for n in names] for r in rows)]
    return "\n".join(f"| {' | '.join(x)} |" for x in lines)


def to_latex(rows: list[dict]) -> str:
    if not rows:
        return ""
    escape = lambda x: str(x).replace("\\", r"\textbackslash{}").replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    names = list(rows[0])
    body = [" & ".join(map(escape, names)) + r" \\ \hline", *(" & ".join(escape(r[n]) for n in names) + r" \\" for r in rows)]
    return "\n".join([r"\begin{tabular}{" + "l" * len(names) + "}", *body, r"\end{tabular}"])


def to_json(rows: list[dict]) -> str:
    finite = lambda v: None if isinstance(v, float) and not math.isfinite(v) else v
    return json.dumps([{k: finite(v) for k, v in r.items()} for r in rows], ensure_ascii=False)
