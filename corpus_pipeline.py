"""A training corpus from `documents`: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import chunks, minhash, mixing, packing, toxicity
from spanloom.llm.common import prepare, table
from spanloom.llm.queries import WORD_BPE, tokenizer
from spanloom.session import ship, store

# Learnt models, classes and cuts depend on the whole corpus, so no SQL gives the rows of run().
ORACLE_SQL = None
# Pieces that a worker remembers, few because the workers of all stages share the memory of an executor.
CACHE_PIECES = 50_000


def _ready(spark: SparkSession) -> None:
    ship(spark)
    prepare(spark)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject."""
    _ready(spark)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("bigint").alias("key"), "toxic")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("key"), "text")
    return toxicity.reject(docs, toxicity.train(texts, labels))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    _ready(spark)
    return minhash.keep_one(docs)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that another has; documents of which nothing is left go."""
    _ready(spark)
    cut = chunks.deduplicate(docs).where((F.col("removed_chars") == 0) | (F.trim("text") != ""))
    sized = F.when(F.col("removed_chars") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", sized).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of their sources takes them."""
    _ready(spark)
    return mixing.repeat(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    _ready(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("key"), "text")
    return packing.pack_texts(texts, tokenizer(WORD_BPE), cache_pieces=CACHE_PIECES).withColumnRenamed("key", "doc_id")


STAGES = [
    ("toxicity", toxic_out), ("minhash_near_dedup", near_duplicates_out), ("substring_dedup", repeats_out),
    ("mixing", mixed), ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
