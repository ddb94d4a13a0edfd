import pytest
from pyspark.sql import functions as F

from spanloom.functions import plugins
from spanloom.options import Options
from spanloom.__main__ import main
from spanloom.plans import index, interrogate, preparation
from spanloom.sources import delimited
from spanloom.sources.corpora import CorpusStore, clean_corpus_id


@pytest.fixture()
def dataset(tmp_path):
    path = tmp_path / "mentions.csv"
    lines = ["text,entity,start,end,type,file"]
    for i, (sentence, entity) in enumerate(
        [
            ("the European Parliament met", "European Parliament"), ("a European Parliament vote", "European Parliament"),
            ("the Red Cross helped", "Red Cross"), ("Red Cross and European Parliament", "Red Cross"),
            ("Red Cross and European Parliament", "European Parliament"), ("nothing here", ""),
        ]
    ):
        start = sentence.find(entity) if entity else ""
        lines.append(f"{sentence},{entity},{start},{start + len(entity) if entity else ''},ORG,f{i}.txt")
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_ids():
    assert clean_corpus_id("  My Corpus ") == "my_corpus"
    with pytest.raises(ValueError):
        clean_corpus_id("  ")


def test_life_of_a_corpus(spark, tmp_path, dataset):
    store = CorpusStore(spark, str(tmp_path / "store"))
    assert store.list().count() == 0 and store.status().count() == 0
    options = Options(reduced_dimensions=4, similarity_threshold=0.5)
    first = index.create_corpus(spark, store, "First One", dataset, method="leader", options=options)
    index.create_corpus(spark, store, "second", dataset, index_now=False, column_mapping={"entity": "clean_mention_sentence"})
    assert first == "first_one"
    assert {r.corpus_id: (r.indexed, r.rows) for r in store.status().collect()} == {"first_one": (True, 6), "second": (False, 0)}
    rows = store.load_index(first)
    assert {"mention_vec", "context_vec", "combined_vec", "cluster_id", "cluster_canonical_mention"} <= set(rows.columns)
    assert rows.where("clean_entity_mention = 'Red Cross'").select("mention").distinct().count() == 1
    assert len(rows.first().combined_vec) == 4 and store.has_pca(first)

    before = store.get(first)
    assert store.get("second").last_updated is None and before.similarity_threshold == 0.5
    # The settings of the corpus hold, whatever the options of the call are.
    index.update_corpus(spark, store, first, Options())
    after = store.get(first)
    assert after.created_at == before.created_at and after.last_updated > before.last_updated
    assert len(store.load_index(first).first().combined_vec) == 4 and store.has_pca(first)
    assert store.status().where("corpus_id = 'first_one'").first().rows == 6

    terms = spark.createDataFrame([(1, "European Parliament")], "query_id int, term string")
    hits = interrogate.query_corpus(store, first, terms, k=3)
    assert {r.clean_entity_mention for r in hits.collect()} == {"European Parliament"} and hits.count() == 3
    reduced = interrogate.query_corpus(store, first, terms, k=2, entity_vector_only=False, min_score=-1.0)
    assert reduced.count() == 2
    reranked = interrogate.query_corpus(store, first, terms, k=1, reranker=plugins.JaccardReranker())
    assert reranked.first().similarity_score == 1.0
    entities, nodes, edges = interrogate.explore(store, first, hits, ignore_case=True, use_medoids=False)
    assert entities.first().entity_mention == "European Parliament" and nodes.count() == 2
    assert [(r.u, r.v, r.weight) for r in edges.collect()] == [("European Parliament", "Red Cross", 1)]
    # A build without a reduction leaves none behind.
    store.register(**{**after.asDict(), "reduced_dimensions": 10_000})
    index.update_corpus(spark, store, first)
    assert not store.has_pca(first)
    assert interrogate.query_corpus(store, first, terms, k=2, entity_vector_only=False, min_score=-1.0).count() == 2
    target = spark.createDataFrame([(1, "the Red Cross helped")], "query_id int, sentence string")
    assert interrogate.similar_to(store, first, target, 1).first().clean_mention_sentence == "the Red Cross helped"

    store.delete(first)
    assert [r.corpus_id for r in store.list().collect()] == ["second"] and not store.has_index(first)
    for call in (lambda: store.load_index(first), lambda: store.delete(first), lambda: index.update_corpus(spark, store, first)):
        with pytest.raises(LookupError):
            call()


def test_rows_without_text_are_kept(spark):
    rows = spark.createDataFrame(
        [(0, "the EP met", "EP"), (1, None, None), (2, "the EP left", "EP")],
        "row_id bigint, clean_mention_sentence string, clean_entity_mention string",
    )
    built, _ = index.build_index(rows, plugins.HashedTrigramEncoder(64), "agglomerative", Options(reduced_dimensions=128))
    found = {r.row_id: r for r in built.collect()}
    assert len(found) == 3 and found[1].cluster_id is None and found[1].mention_vec is None
    assert found[0].cluster_id == 0 and found[0].cluster_canonical_mention == "EP"


def test_options(tmp_path):
    path = tmp_path / "settings.json"
    path.write_text('{"top_k": 3, "alpha_span_weight": 0.5, "other": 1}')
    options = Options.from_json(str(path))
    assert (options.top_k, options.alpha_span_weight, options.similarity_threshold) == (3, 0.5, 0.70)


def test_folder_to_mentions(spark, tmp_path):
    class Capitals:
        def tag(self, sentences):
            return [
                [("B-X" if w[0].isupper() else "O", s.index(w), s.index(w) + len(w)) for w in s.rstrip(".").split()] for s in sentences
            ]

    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_text("we met Ada.\nthen Bob came. nobody else")
    (tmp_path / "in" / "deep" / "a.txt").write_text("Then Paris.")
    preparation.prepare_folder(spark, str(tmp_path / "in"), Capitals(), str(tmp_path / "out.tsv"))
    rows = delimited.load_mentions(spark, str(tmp_path / "out.tsv")).collect()
    assert sorted((r.clean_entity_mention, r.mention_start, r.mention_end, r.document_id) for r in rows) == [
        ("Ada", 7, 10, "a.txt"), ("Bob", 5, 8, "a.txt"), ("Then Paris", 0, 10, "a.txt"),
    ]


def test_command_line(spark, tmp_path, dataset, capsys):
    store = ["--store", str(tmp_path / "cli")]
    main(store + ["map", "--dataset", dataset])
    main(store + ["create", "News", "--dataset", dataset, "--clustering-method", "leader", "--alpha-span-weight", "0.5"])
    main(store + ["query", "news", "Red Cross", "--top-k", "2", "--reranker", "jaccard"])
    main(store + ["update", "news"])
    main(store + ["list"])
    main(store + ["delete", "news"])
    out = capsys.readouterr().out
    assert '"text": "clean_mention_sentence"' in out and "European Parliament" in out and "50.0%" in out
    assert CorpusStore(spark, str(tmp_path / "cli")).list().count() == 0


def test_a_failed_build_leaves_the_old_corpus_whole(spark, tmp_path, dataset, monkeypatch):
    store = CorpusStore(spark, str(tmp_path / "store"))
    index.create_corpus(spark, store, "c", dataset, method="leader", options=Options(reduced_dimensions=4))
    rows, build, updated = sorted(map(str, store.load_index("c").collect())), store.build_of("c"), store.get("c").last_updated
    with open(dataset, "a") as handle:
        handle.write("one more Red Cross,Red Cross,9,18,ORG,x.txt\n")
    with monkeypatch.context() as patch:
        # The index of the new build is written, its reduction is not.
        patch.setattr(CorpusStore, "pca_path", lambda *_: (_ for _ in ()).throw(OSError("disk")))
        with pytest.raises(OSError):
            index.update_corpus(spark, store, "c")
    assert len(store._children(f"{store.root}/index")) == 2
    assert (store.build_of("c"), store.get("c").last_updated) == (build, updated) and store.has_pca("c")
    assert sorted(map(str, store.load_index("c").collect())) == rows and store.index_rows().count() == len(rows)
    index.update_corpus(spark, store, "c")
    # What failed and what was replaced is gone.
    assert store._children(f"{store.root}/index") == store._children(f"{store.root}/pca") == [f"build={store.build_of('c')}"]
    assert store.load_index("c").count() == len(rows) + 1 and store.get("c").last_updated > updated and store.has_pca("c")
    store.delete("c")
    assert not store.has_index("c") and store.list().count() == 0


def test_builds_of_several_corpora(spark, tmp_path):
    store = CorpusStore(spark, str(tmp_path / "store"))
    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "corpus_id string, row_id bigint")
    store.save_index(first)
    store.save_index(first.where("corpus_id = 'a'").withColumn("row_id", F.col("row_id") + 10))
    assert sorted((r.corpus_id, r.row_id) for r in store.index_rows().collect()) == [("a", 11), ("a", 12), ("b", 3)]
    assert len(store._children(f"{store.root}/index")) == 2
