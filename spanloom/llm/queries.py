"""One query per training-data operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.llm import (
    boilerplate, chunks, decontaminate, hamming, importance, infilling, minhash, mixing, packing, records, syncmers, toxicity,
    warc,
)
from spanloom.llm.common import table
from spanloom.session import shared_folder

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def tokenizer(name: str) -> str:
    """The path of a public tokenizer file, in the place where its package is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _texts(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("bigint").alias("key"), "text")


def op1_token_records(spark, sf):
    """The ids of each document from record files, which are written in doc_id order and read back."""
    folder = shared_folder(spark)
    path = tokenizer(BYTE_BPE)
    encoded = records.encode_texts(records.ordered(_texts(spark, sf)), path)
    records.write_records(encoded, folder, records.id_bytes(path))
    return records.read_records(spark, folder).select(
        F.col("key").alias("doc_id"), "start",
        (F.octet_length("payload").cast("bigint") / records.ID_BYTES).cast("bigint").alias("n_tokens"),
        F.crc32("payload").alias("ids_crc32"),
    )


def op2_min_cut_extraction(spark, sf):
    """The main text of each page."""
    pages = table(spark, sf, "pages").withColumnRenamed("page_id", "key")
    return boilerplate.extract(pages).withColumnRenamed("key", "page_id")


def op3_circulant_minhash(spark, sf):
    """The class of near-duplicates of each document."""
    return minhash.near_duplicates(_texts(spark, sf)).withColumnsRenamed({"key": "doc_id", "component": "component_id"})


def op4_pu_toxicity(spark, sf):
    """The toxicity of each document, learnt from the labels of four folds."""
    rows = _texts(spark, sf)
    labels = table(spark, sf, "labels").select(F.col("doc_id").cast("bigint").alias("key"), "toxic")
    scored = toxicity.score(rows, toxicity.train(rows, labels))
    return scored.select(F.col("key").alias("doc_id"), toxicity.held_out(F.col("key")).alias("held_out"), "score", "predicted")


def op5_best_fit_packing(spark, sf):
    """The pieces of each document in sequences of at most 2048 tokens."""
    return packing.pack_texts(_texts(spark, sf), tokenizer(WORD_BPE)).withColumnRenamed("key", "doc_id")


def op6_water_filling(spark, sf):
    """How many words of each document the mix takes."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "source", "text")
    return mixing.mix(rows).select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken")
    )


def op7_closed_syncmers(spark, sf):
    """The fingerprint of each document, beside those of its edited text and of the next document."""
    return syncmers.fingerprints(_texts(spark, sf)).withColumnRenamed("key", "doc_id")


def op8_content_defined_chunks(spark, sf):
    """Each document without the passages that documents with smaller ids have."""
    found = chunks.deduplicate(table(spark, sf, "documents"))
    return found.select("doc_id", "text", F.length("text").cast("bigint").alias("n_chars"), "removed_chars", "spans")


def op9_multi_index_hashing(spark, sf):
    """The ten nearest vectors of each hundredth one."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return hamming.search(rows, F.col("id") % 100 == 0, 10)


def op10_warc_source(spark, sf):
    """Each page as an archive record, read back."""
    folder = shared_folder(spark)
    pages = table(spark, sf, "pages").select(
        F.col("page_id").cast("bigint").alias("key"), F.col("url").alias("uri"), F.col("html").alias("payload")
    )
    warc.write_pages(pages, folder)
    return warc.read_pages(spark, folder).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_importance_resampling(spark, sf):
    """The quarter of the documents that is drawn towards the benchmark texts."""
    drawn = importance.resample(_texts(spark, sf), table(spark, sf, "benchmark"))
    return drawn.select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_fill_in_middle(spark, sf):
    """Each document cut at lines and reordered for infilling, and put together again."""
    made = infilling.transform(_texts(spark, sf))
    return made.select(
        F.col("row.key").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infilling.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_benchmark_decontamination(spark, sf):
    """The words of each document that lie in ten words of a benchmark text."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("item"), "text")
    found = decontaminate.report(table(spark, sf, "documents"), items)
    return found.select(
        F.col("key").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


QUERIES = {name: make for name, make in globals().items() if name.startswith("op")}
ORACLES = {
    "op6_water_filling": mixing.ORACLE, "op11_importance_resampling": importance.oracle(), "op12_fill_in_middle": infilling.oracle(),
    "op13_benchmark_decontamination": decontaminate.oracle(),
}
