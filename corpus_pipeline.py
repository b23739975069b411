"""Corpus pipeline: documents that are clean, distinct, free of personal data, mixed and packed.

Stages take documents (doc_id, text, lang, source, any other columns) and work on every row. Columns
other than these four are carried through untouched, whatever their names. Texts of any length are
read whole. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecflow.llm import lsh_forest, mixing, packing, queries, toxicity
from vecflow.llm.storage import stored

#: Part of the tokens that mixing keeps.
KEEP = 0.8
#: Pieces of text whose ids a worker of packing keeps: a quarter of what it keeps alone, as an executor also
#: holds what the stages before have left in its memory.
KEPT_PIECES = 200_000
OWN = ("doc_id", "text", "lang", "source")


def beside_others(docs: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """change of docs, which sees OWN and one column with all others; the columns of docs."""
    others = [c for c in docs.columns if c not in OWN]
    own = [c for c in docs.columns if c in OWN]
    held = docs.select(*own, F.struct(*others).alias("others_")) if others else docs
    return change(held).select(*[F.col(c if c in OWN else f"others_.{c}").alias(c) for c in docs.columns])


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents whose score says toxic go. Null and empty texts score 0 and stay; rows that
    repeat share their score."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    return beside_others(docs, lambda own: toxicity.with_toxicity(own, model, "toxicity_").filter("toxicity_.predicted = 0"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group of similar ones stays, the first by id (a known
    id before none), then text. Rows without words are similar to none, so all of them stay."""
    return beside_others(docs, lsh_forest.deduplicated)


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: values are replaced in their format, so n_chars stays true. Null texts stay null; equal values
    get equal pseudonyms in all rows."""
    return beside_others(docs, queries.with_pseudonyms)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a sample with even sources, languages and topics. Null sources and languages are values of
    their own, documents without tokens stay, rows that repeat an id share its lot."""
    return beside_others(docs, lambda own: mixing.mixed(own, keep=KEEP))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: every kept document's pieces with their places in sequences. Null and empty texts
    are documents of the end id alone; rows that repeat an id, or have none, are packed each for itself."""
    return packing.packed_documents(docs, queries.vocabulary("word_bpe_49k.json"), end_id=1, size=4096, kept=KEPT_PIECES)


STAGES = [
    ("toxicity", keep_clean),
    ("near_duplicates", keep_distinct),
    ("pii", pseudonymize),
    ("mixing", mix),
    ("packing", pack),
]

#: A trained model, a verified forest and subword tokens are beyond SQL; the stages are tested
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
