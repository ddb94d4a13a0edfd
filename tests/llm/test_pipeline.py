import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from spanloom.llm import queries, toxicity
from spanloom.session import store
from tests.llm.test_dedup import classes, prose
from tests.llm.test_others import labelled, water

SF = "/root/testdata/sf0.001"
# The columns that each query must return.
COLUMNS = {
    "op1": ["doc_id", "start", "n_tokens", "ids_crc32"], "op2": ["page_id", "url", "text", "n_chars"],
    "op3": ["doc_id", "n_shingles", "component_id", "kept"], "op4": ["doc_id", "held_out", "score", "predicted"],
    "op5": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op6": ["doc_id", "size", "source_size", "target", "taken"],
    "op7": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op8": ["doc_id", "text"], "op9": ["query_id", "rank", "vec_id", "score"],
    "op10": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op11": ["doc_id", "n_features", "weight", "score", "rank"],
    "op12": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    "op13": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
}


def test_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == set(COLUMNS) and set(queries.ORACLES) <= set(queries.QUERIES)
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_returns_its_rows(spark, name):
    rows = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[name.split("_")[0]]) <= set(rows.columns)
    got = rows.collect()
    if name.startswith("op1_"):
        t = Tokenizer.from_file(queries.tokenizer(queries.BYTE_BPE))
        start, by_id = 0, {r.doc_id: r for r in got}
        for doc_id, text in duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall():
            ids = [*t.encode(text, add_special_tokens=False).ids, 0]
            assert tuple(by_id[doc_id]) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    if name in queries.ORACLES:
        base = duckdb.connect()
        for view in ("documents", "benchmark"):
            base.execute(f"CREATE VIEW {view} AS SELECT * FROM '{SF}/{view}.parquet'")
        assert sorted(map(tuple, got), key=repr) == sorted(base.execute(queries.ORACLES[name]).fetchall(), key=repr)
    if name.startswith(("op2_", "op10_")):
        assert len(got) == duckdb.sql(f"SELECT count(*) FROM '{SF}/pages.parquet'").fetchall()[0][0]
    elif not name.startswith(("op5_", "op9_")):
        assert len(got) == duckdb.sql(f"SELECT count(*) FROM '{SF}/documents.parquet'").fetchall()[0][0]


def test_stages(spark, tmp_path):
    """Each stage against a plain version of it, on rows with copies, toxic texts, shared passages and odd values."""
    import random

    rng = random.Random(11)
    clean, labels = labelled(300)
    toxic = {i for i, y in labels if y}
    passage = prose(rng, 60)
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in clean]
    rows += [(1_000 + i, prose(rng, 80) + " " + passage, "en", None, 7) for i in range(4)]
    long = prose(rng, 4_000)
    rows += [(2_000, long, "de", "a", len(long)), (2_001, long, "de", "a", len(long)), (2_002, None, None, "b", None), (2_003, "", "fr", "b", 0)]
    rows += [(None, prose(rng, 30), "en", "b", 1), (2_003, "", "fr", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held, tables = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        held = store(stage(spark, held, str(tmp_path)))
        tables[name] = held.collect()
        assert name == "best_fit_packing" or held.columns == docs.columns
    kept = {r.doc_id for r in tables["toxicity"]}
    assert len(toxic & kept) <= 0.1 * len(toxic) and {i for i, *_ in rows} - toxic - kept == set()
    after = [(r.doc_id, r.text) for r in tables["toxicity"] if r.doc_id is not None]
    want = {c for _, c in classes(after).values()} | {None}
    assert sorted((r.doc_id or -1) for r in tables["minhash_near_dedup"]) == sorted((i or -1) if i is not None else -1 for i in want)
    cut = {r.doc_id: r for r in tables["substring_dedup"]}
    assert passage in cut[1_000].text and all(passage not in cut[1_000 + i].text for i in (1, 2, 3))
    assert all(cut[i].text == t for i, t in clean if i in cut) and cut[2_002].text is None
    sizes = {}
    for r in tables["substring_dedup"]:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    aims, taken = water(sizes, (5, 2, 1), 1.5, 2), {}
    for r in tables["mixing"]:
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
    # The large document is one half of its source, so that source may miss its target by half of it.
    assert all(abs(taken.get(s, 0) - aims[s]) <= 2_100 for s in aims)
    pieces, ends = tables["best_fit_packing"], {}
    assert sum(r.piece == 0 for r in pieces) == len(tables["mixing"])
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2_048 and len(ends) <= sum(r.length for r in pieces) // 2_048 + 2


def test_stages_on_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, str(tmp_path)))
        assert docs.count() == 0


def test_scores_are_calibrated_on_held_out_rows(spark):
    found = queries.op4_pu_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = found.where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.9
    assert toxicity.FOLDS == 5
