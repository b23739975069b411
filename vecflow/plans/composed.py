"""Queries made of several operators: search with metadata, files, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import search as S
from ..streaming import ingest
from ..workspace import workdir
from .tables import query_set, table, vectors


def semantic_search(spark, d):
    v = vectors(spark, d)
    found = S.knn(query_set(v), v, 5, "cosine")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang", F.substring("text", 1, 200).alias("preview"))
    return found.join(docs, "vec_id", "left").select("query_id", "rank", "vec_id", F.round(V.similarity(F.col("distance"), "cosine"), 4).alias("score"), T.first_filled(F.col("lang"), F.lit("N/A")).alias("lang"), T.first_filled(F.col("preview")).alias("preview"))


def sharded_ip(spark, d):
    """Top lists of each chunk of vectors, then merged: the same as a global top list."""
    v = vectors(spark, d)
    return S.nearest(query_set(v), v, 10, "ip").select("query_id", "rank", "vec_id", F.round(-F.col("distance"), 6).alias("score"))


def parameter_grid(spark, d):
    """Every combination of the tuning values."""
    values = lambda name, given: spark.sql(f"SELECT {name} FROM VALUES {', '.join(f'({x})' for x in given)} AS t({name})")
    return values("tau", (2, 3, 4)).crossJoin(values("epsilon", ("1e-5D", "1e-4D", "1e-3D"))).crossJoin(values("rerank", (1, 2, 3)))


def stream_ingest(spark, d):
    """Documents through a file stream into a table; the second run finds nothing new."""
    docs = table(spark, d, "documents")
    source, target, state = (workdir(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    docs.select("doc_id", "lang", "source", "n_chars").write.parquet(source)
    for _ in range(2):
        ingest.ingest(ingest.file_stream(spark, source, "doc_id long, lang string, source string, n_chars long"), target, state)
    return spark.read.schema("doc_id long, lang string, source string, n_chars long").parquet(target)


def stream_distinct(spark, d):
    """Distinct users and types of events within the watermark, as a stream."""
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    source, target, state = (workdir(spark, n) for n in ("events-in", "events-out", "events-state"))
    events.unionByName(events).write.parquet(source)
    own = ingest.distinct_events(ingest.file_stream(spark, source, events.schema), ["event_id"], delay="1 hour")
    ingest.ingest(own, target, state)
    return spark.read.schema(events.schema).parquet(target).select("event_id", "user_id", "event_type")


def vector_files(spark, d):
    """Vectors through the binary record format and back, by their place in the files."""
    from ..operators.dedup import numbered
    from ..sources import vecfiles

    v, uri = vectors(spark, d), workdir(spark, "fvecs")
    vecfiles.write_records(v, uri, "vec_id", "v")
    back = numbered(vecfiles.read_records(spark, uri).withColumn("at", F.struct("path", "pos")), "at", "place")
    ids = numbered(v.select("vec_id"), "vec_id", "place")
    return back.join(ids, "place").select("vec_id", F.round(V.norm(F.col("values").cast("array<double>")), 6).alias("norm"), F.size("values").alias("dimension"))


QUERIES = {
    "semantic_search": (
        semantic_search,
        "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS q FROM v WHERE vec_id % 50 = 0), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM (SELECT query_id, vec_id, 1 - list_inner_product(q, v) / (greatest(sqrt(list_inner_product(q, q)), 1e-12) * greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS distance FROM v, q)) SELECT query_id, rank, vec_id, round(1 - distance, 4) AS score, coalesce(nullif(lang, ''), 'N/A') AS lang, coalesce(left(text, 200), '') AS preview FROM t LEFT JOIN documents ON doc_id = vec_id WHERE rank <= 5",
    ),
    "sharded_inner_product": (
        sharded_ip,
        "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS q FROM v WHERE vec_id % 50 = 0) SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM (SELECT query_id, vec_id, list_inner_product(q, v) AS score FROM v, q)) WHERE rank <= 10",
    ),
    "parameter_grid": (parameter_grid, "SELECT tau, epsilon, rerank FROM (VALUES (2), (3), (4)) a(tau), (VALUES (1e-5::DOUBLE), (1e-4::DOUBLE), (1e-3::DOUBLE)) b(epsilon), (VALUES (1), (2), (3)) c(rerank)"),
    "stream_ingest_checkpoint": (stream_ingest, "SELECT doc_id, lang, source, n_chars FROM documents"),
    "stream_dedup_watermark": (stream_distinct, "SELECT event_id, user_id, event_type FROM events"),
    "fvecs_roundtrip": (vector_files, "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, len(embedding)::INT AS dimension FROM embeddings"),
}
