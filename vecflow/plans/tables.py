"""Input tables as the plans use them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERY_STRIDE = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, v, label"""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def query_set(vecs: DataFrame) -> DataFrame:
    """The stated query set: every row whose id the stride divides."""
    return vecs.filter(F.col("vec_id") % QUERY_STRIDE == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
