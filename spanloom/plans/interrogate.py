"""Query side: search terms against a stored corpus, with co-occurring entities and their network."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import plugins
from spanloom.operators import cooccur, search
from spanloom.options import Options
from spanloom.plans.index import reduce_vectors
from spanloom.sources.corpora import CorpusStore

DEFAULTS = Options()


def query_corpus(
    store: CorpusStore,
    corpus_id: str,
    terms: DataFrame,
    *,
    k: int | None = None,
    min_score: float | None = None,
    entity_vector_only: bool = True,
    reranker: plugins.Reranker | None = None,
    options: Options = DEFAULTS,
) -> DataFrame:
    """The hits of a table of search terms (query_id, term[, k]).

    By default terms are compared with the mention vectors; otherwise with the blended and reduced ones.
    """
    corpus = store.load_index(corpus_id)
    queries = search.encode_queries(terms, plugins.encoder_named(store.get(corpus_id).encoder))
    vector = "mention_vec"
    if not entity_vector_only:
        vector = "combined_vec"
        queries = reduced_queries(store, corpus_id, queries)
    return search.search(
        queries, corpus, k=k, min_score=min_score, vector=vector, reranker=reranker, options=options
    )


def reduced_queries(store: CorpusStore, corpus_id: str, queries: DataFrame) -> DataFrame:
    """The query vectors as the stored reduction of the corpus changes them; without one they stay."""
    if not store.has_pca(corpus_id):
        return queries
    return reduce_vectors(queries, PipelineModel.load(store.pca_path(corpus_id)), "query_vec")


def similar_to(store: CorpusStore, corpus_id: str, sentences: DataFrame, k: int | None = None) -> DataFrame:
    """Rows with contexts similar to the given sentences (query_id, sentence)."""
    encoder = plugins.encoder_named(store.get(corpus_id).encoder)
    targets = search.encode_queries(sentences, encoder, "sentence")
    return search.similar_sentences(targets, store.load_index(corpus_id), k)


def explore(
    store: CorpusStore, corpus_id: str, results: DataFrame, *, ignore_case: bool = False, use_medoids: bool = False,
    max_nodes: int = DEFAULTS.max_nodes,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Co-occurring entities, network nodes and network edges of a result."""
    corpus = store.load_index(corpus_id)
    entities = cooccur.ranked(cooccur.cooccurring_entities(corpus, results, ignore_case=ignore_case))
    nodes, edges = cooccur.network(
        corpus, results, max_nodes=max_nodes, use_medoids=use_medoids, ignore_case=ignore_case
    )
    return entities, nodes, edges
