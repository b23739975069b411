"""All queries of the engine with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import search as S
from . import composed, relational, retrieval, stores, texts, vectors
from .tables import query_set, table

ALL = vectors.QUERIES | texts.QUERIES | relational.QUERIES | composed.QUERIES | stores.QUERIES | retrieval.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic search: a coarse pass over coded vectors, exact re-ranking, metadata and scores."""
    v, q, found = vectors._two_tier(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source", F.substring("text", 1, 200).alias("preview"))
    return found.join(docs, "vec_id", "left").select("query_id", "rank", "vec_id", F.round(V.similarity(F.col("distance"), "l2_squared"), 4).alias("score"), "lang", "source", "preview")
