"""The subpackage's queries: each applies its operator to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, block_labeller, late_sessions, lsh_forest, mixing, multi_index, packing, pii, sql, suffix_dedup, token_store, toxicity, warc, weighted_sampling
from .storage import workdir


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = workdir(spark, "tokens")
    token_store.write_tokens(_table(spark, sf_dir, "documents"), uri, vocabulary("byte_bpe_50k.json"), end_id=2)
    return token_store.token_digests(spark, uri)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    found = toxicity.with_toxicity(docs, model)
    return found.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "toxicity.score",
        "toxicity.predicted",
        F.col("toxicity.offending").alias("offending"),
    )


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.joined(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated_bytes(_table(spark, sf_dir, "documents"))


#: Settings that name the pseudonyms' key, or a text file with it (which then shows in no plan).
KEY_SETTING, KEY_FILE_SETTING = "spark.vecflow.pseudonym.key", "spark.vecflow.pseudonym.keyFile"
#: Where neither is set: for tests and trials only, as everybody knows it.
TRIAL_KEY = "vecflow trial key"


def with_pseudonyms(docs: DataFrame) -> DataFrame:
    """docs with the session's key applied to their texts."""
    spark = docs.sparkSession
    if path := spark.conf.get(KEY_FILE_SETTING, None):
        key = spark.read.option("wholetext", "true").text(path).agg(F.first(F.trim("value")).alias("pseudonym_key_"))
        return pii.with_pseudonyms(docs.crossJoin(F.broadcast(key)), F.col("pseudonym_key_")).drop("pseudonym_key_")  # one row
    return pii.with_pseudonyms(docs, spark.conf.get(KEY_SETTING, TRIAL_KEY))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_pseudonyms(docs.withColumn("before", F.col("text")))
    return found.select("doc_id", "text", (~F.col("text").eqNullSafe(F.col("before"))).alias("changed"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), F.round("token_weight", 4).alias("token_weight"))


def op8_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.fingerprints(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = workdir(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), uri)
    return warc.page_records(warc.read_archives(spark, uri))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, size=4096)


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return block_labeller.extracted(pages, block_labeller.fit(pages))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = alignment.chunks(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return alignment.aligned(chunks, alignment.pair_counts(chunks))


def op13_late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_sessions.versions(late_sessions.events_of(_table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_store": op1_token_store,
        "op2_toxicity": op2_toxicity,
        "op3_multi_index": op3_multi_index,
        "op4_lsh_forest": op4_lsh_forest,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_pii": op6_pii,
        "op7_mixing": op7_mixing,
        "op8_weighted_sampling": op8_weighted_sampling,
        "op9_warc": op9_warc,
        "op10_packing": op10_packing,
        "op11_html_extraction": op11_html_extraction,
        "op12_alignment": op12_alignment,
        "op13_late_sessions": op13_late_sessions,
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
