"""Structured Streaming: ingestion with a checkpoint, near-real-time duplicates, telemetry windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import dedup, stores
from ..workspace import stored


def file_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def ingest(stream: DataFrame, target: str, checkpoint: str) -> None:
    """All files that are there, once; a rerun takes up only new ones."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def distinct_events(stream: DataFrame, keys: list[str], time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """First event of each key; state is dropped behind the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """start, event_type, n, total per window; batch or stream (with a watermark of one width)."""
    own = events.withWatermark("ts", width) if events.isStreaming else events
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = own.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """user_id, start, n of runs of events with pauses shorter than gap."""
    own = events.withWatermark("ts", gap) if events.isStreaming else events
    out = own.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def each_batch(stream: DataFrame, write, checkpoint: str) -> None:
    """Gives all that is there to write(rows), batch by batch; a rerun takes up only new files."""
    stream.writeStream.foreachBatch(lambda rows, _: write(rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def telemetry(stream: DataFrame, target: str, checkpoint: str, width: str, delay: str, mode: str = "append") -> dict[str, int]:
    """Windows of event time (ts, event_type, value) of all files that are there, written to target as
    Parquet: batch, start, event_type, n, total. With append a window is written once, when the watermark
    (delay behind the latest ts) has passed its end; with update at each batch in which it grew (`latest`
    reads the newest). Windows that wait are kept in the checkpoint, so a later run goes on with them.
    Gives the number of batches, and of groups of late rows (of a window and type within a task) that the
    watermark dropped."""
    if mode not in ("append", "update"):
        raise ValueError(f"no such mode: {mode}")
    own = stream.filter("ts is not null").withWatermark("ts", delay)
    windows = own.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    rows = windows.select(F.col("w.start").alias("start"), "event_type", "n", "total")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")  # a batch tried again replaces itself

    query = rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    dropped = [op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]]
    return {"batches": len(query.recentProgress), "dropped": sum(dropped)}


class Buffer:
    """Rows of a stream held back until there are `size` of them, changed (embedded, say) and written in lots
    of that many, in the order of a column within what is held; `close` writes the rest.

    What is held is a version per batch in the shared folder, so a restart goes on with it, and a batch
    that is tried again replaces what it wrote."""

    def __init__(self, spark: SparkSession, target: str, schema: str, size: int, change, order: str):
        self.spark, self.target, self.schema, self.size, self.change, self.order = spark, target, schema, max(1, size), change, order

    def _put(self, rows: DataFrame, number: int, least: int) -> int:
        held = stores.newest(self.spark, f"{self.target}/held", self.schema, number).unionByName(rows.select(*[x.split()[0] for x in self.schema.split(", ")]))
        placed = stored(dedup.numbered(held, self.order, "place_"), "held")
        n = placed.count()
        out = n - n % least
        if out:
            lots = placed.filter(F.col("place_") < out).withColumn("lot", F.floor(F.col("place_") / self.size)).drop("place_")
            self.change(lots).write.mode("overwrite").parquet(f"{self.target}/written/batch={number}")
        placed.filter(F.col("place_") >= out).drop("place_").write.mode("overwrite").parquet(f"{self.target}/held/versions/{number:06d}")
        return out

    def add(self, rows: DataFrame, number: int) -> int:
        """Batch number `number`; gives how many rows were written."""
        return self._put(rows, number, self.size)

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """All that is there in a stream."""
        stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def close(self) -> int:
        """Writes what is held; gives how many rows that were."""
        versions = [n for n, whole in stores._versions(self.spark, f"{self.target}/held") if whole]
        return self._put(self.spark.createDataFrame([], self.schema), max(versions, default=-1) + 1, 1)


WINDOWS = "start timestamp, event_type string, n long, total double, batch long"


def latest(spark: SparkSession, target: str) -> DataFrame:
    """Each window as its newest batch has it."""
    rows = spark.read.schema(WINDOWS).parquet(target)
    return rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("w")).select("start", "event_type", "w.n", "w.total")


def first_wins(stream: DataFrame, k: int = 1, reset_every: int = dedup.RESET_EVERY) -> DataFrame:
    """doc_id, kept of a stream of documents (doc_id, text, n: their number in the stream from 0, each batch
    behind the one before): `dedup.greedy_first_wins`, going on over batches and restarts.

    Memory is emptied every reset_every documents; the documents between are an epoch, the state's key.
    The state holds the buckets of an epoch's kept documents, and goes when all its documents were seen.
    Epochs are independent of each other and are worked on in parallel."""
    epoch = F.floor((F.col("n") + 1) / reset_every).cast("long")
    rows = stream.select("doc_id", "n", epoch.alias("epoch"), dedup.band_keys(F.col("text"), k).alias("keys"))

    def replay(key: tuple, parts, state: GroupState):
        held, seen = state.get if state.exists else (b"", 0)
        kept_keys = set(np.frombuffer(held, np.int64).tolist())
        part = pd.concat(list(parts)).sort_values("n")
        kept = []
        for keys in part["keys"]:
            own = set() if keys is None else set(np.asarray(keys, np.int64).tolist())
            kept.append(not own & kept_keys)
            if kept[-1]:
                kept_keys |= own
        seen += len(part)
        if seen >= reset_every - (key[0] == 0):
            state.remove()
        else:
            state.update((np.fromiter(kept_keys, np.int64, len(kept_keys)).tobytes(), seen))
        yield pd.DataFrame({"doc_id": part["doc_id"], "kept": kept})

    return rows.groupBy("epoch").applyInPandasWithState(replay, "doc_id long, kept boolean", "keys binary, seen long", "append", GroupStateTimeout.NoTimeout)
