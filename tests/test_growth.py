"""What holds the volume of a job to that of its input: sentences once, vectors where they are read, numbers in few bytes."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from spanloom.functions import plugins, vectors
from spanloom.operators import prepare
from spanloom.plans import index
from spanloom.session import number_rows
from spanloom.sources.corpora import CorpusStore

ENCODER = plugins.HashedTrigramEncoder()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_terms_are_sent_without_a_shuffle(spark):
    terms = spark.range(200_000).select(F.concat(F.lit("term"), "id").alias("term"))
    sentences = spark.createDataFrame([(1, "term7 and term199999 but not term200000"), (2, None), (3, "none")], "doc_id int, sentence string")
    rows = prepare.gazetteer_mentions(sentences, terms, "[a-z0-9]+")
    assert "Exchange" not in plan(rows) and plan(rows).count("ArrowEvalPython") == 1
    assert sorted((r.doc_id, r.clean_entity_mention, r.mention_start) for r in rows.collect()) == [(1, "term199999", 10), (1, "term7", 0)]
    kept = prepare.gazetteer_spans(sentences, terms, "[a-z0-9]+").where(F.size("spans") > 0)
    # The filter does not look the words up again.
    assert plan(kept).count("ArrowEvalPython") == 1 and [len(r.spans) for r in kept.collect()] == [2]


def test_texts_are_split_once(spark):
    documents = spark.createDataFrame([(1, "One. Two! Three"), (2, None), (3, ""), (4, " . ")], "doc_id int, text string")
    found = prepare.split_sentences(documents)
    assert plan(found).count("regexp_replace(") == 1
    assert [(r.doc_id, r.sentence_no, r.sentence) for r in found.orderBy("doc_id", "sentence_no").collect()] == [
        (1, 0, "One."), (1, 1, "Two!"), (1, 2, "Three"), (4, 0, "."),
    ]


def test_spans_of_many_rows_at_once():
    chance = random.Random(5)
    labels = ["O", "B-PER", "I-PER", "B-LOC", "I-LOC", "PER", "I-B-X", "X", ""]
    rows = [[(chance.choice(labels), s, s + chance.randint(0, 2)) for s in range(chance.randint(0, 12))] for _ in range(300)] + [None, []]
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    column = pa.array([None if r is None else [dict(zip(("label", "start", "end"), t)) for t in r] for r in rows], kind)
    assert prepare._merged(column).to_pylist() == [prepare.spans_of(r or []) for r in rows]
    assert prepare._merged(column.slice(40, 7)).to_pylist() == [prepare.spans_of(r) for r in rows[40:47]]
    assert prepare._merged(column[:0]).to_pylist() == [] and prepare._merged(column[-2:]).to_pylist() == [[], []]


def test_rounding_of_floats(spark):
    chance = random.Random(6)
    given = [0.0, -0.0, 0.0078125, -0.0078125, 0.5, 1e-7, -1e-7, 5e-7, 123456.78, 3e9, -2e20, float("nan"), float("inf"), None]
    given += [chance.uniform(-1, 1) * 10 ** chance.randint(-8, 5) for _ in range(3000)] + [k / 128 * 1e-3 for k in range(500)]
    rows = spark.createDataFrame([(x,) for x in given], "x double").select(F.col("x").cast("float"))
    both = rows.select(vectors.rounded(F.col("x")).alias("a"), F.round(F.col("x").cast("double"), 6).alias("b"))
    assert both.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0
    assert all(str(r.a) != "-0.0" for r in both.collect())


def test_numbers_of_unfolded_rows(spark):
    rows = [(d, s, f"text {d % 5}", [(p, p + 2, "T") for p in range(0, (d * s) % 4 * 2, 2)]) for d in [*range(40), 3, 3, 7] for s in range(4)]
    held = spark.createDataFrame(rows, "document_id int, sentence_no int, sentence string, spans array<struct<start:int,end:int,type:string>>")
    order = ["document_id", "sentence_no", "mention_start", "clean_entity_mention"]
    numbered = number_rows(held, order, unfold=prepare.mention_rows)
    assert all(f.endswith(".zstd.parquet") for f in numbered.inputFiles())
    got = [tuple(r) for r in numbered.orderBy("row_id").collect()]
    assert [r[-1] for r in got] == list(range(len(got)))
    want = number_rows(prepare.mention_rows(held), order)
    assert numbered.columns == want.columns and got == [tuple(r) for r in want.orderBy("row_id").collect()]


def test_vectors_are_made_where_they_are_read(spark):
    texts = [(i, f"The house number {i} stands", "house", 4, 9) for i in range(2500)] + [(-1, None, "x", 0, 1), (-2, "s", None, None, None)]
    rows = spark.createDataFrame(texts, "row_id int, clean_mention_sentence string, clean_entity_mention string, mention_start int, mention_end int").coalesce(1)
    whole = index.add_vectors(rows, ENCODER, 0.6)
    apart = index.add_vectors(rows, ENCODER, 0.6, apart=True)
    assert whole.columns == apart.columns
    assert list(map(tuple, whole.orderBy("row_id").collect())) == list(map(tuple, apart.orderBy("row_id").collect()))
    assert "ArrowEvalPython" not in plan(apart.select("row_id", "mention"))
    assert plan(apart.select("row_id", "mention_vec").where(F.col("mention_vec").isNotNull())).count("ArrowEvalPython") == 1


def test_batches_are_worked_on_in_slices():
    class Counting(plugins.HashedTrigramEncoder):
        def encode(self, texts):
            assert len(texts) <= plugins.ENCODE_ROWS
            return super().encode(texts)

    assert list(plugins._slices(0)) == [(0, 0)] and list(plugins._slices(2500)) == [(0, 1024), (1024, 1024), (2048, 452)]
    # Buckets are those of whole numbers of any size, also for a number of dimensions that is no power of two.
    for dim in (256, 100):
        matrix = Counting(dim).encode(["\U0010ffff\U0010fffe\U0010fffd", "abc"])
        points = [0x20, 0x10FFFF, 0x10FFFE, 0x10FFFD, 0x20]
        cells = {(961 * a + 31 * b + c) % dim for a, b, c in zip(points, points[1:], points[2:])}
        assert set(matrix[0].nonzero()[0]) == cells


def test_index_rows_unfold_behind_the_shuffle(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path))
    held = spark.createDataFrame(
        [("a", 1, "one two", [(0, 3, "T"), (4, 7, "T")]), ("b", 2, "three", [(0, 5, "T")])],
        "corpus_id string, document_id int, sentence string, spans array<struct<start:int,end:int,type:string>>",
    )
    store.save_index(held, unfold=prepare.mention_rows)
    assert sorted(r.clean_entity_mention for r in store.load_index("a").collect()) == ["one", "two"]
    assert store.load_index("b").count() == 1
