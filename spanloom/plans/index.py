"""Build side: from a mention table to a stored, clustered index."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import plugins, text, vectors
from spanloom.operators import cluster, medoids
from spanloom.options import Options
from spanloom.session import cut
from spanloom.session import store as written
from spanloom.sources import delimited, schema
from spanloom.sources.corpora import CorpusStore, clean_corpus_id

DEFAULTS = Options()


def add_vectors(
    mentions: DataFrame, encoder: plugins.Encoder, alpha: float, distinct: bool = False, apart: bool = False
) -> DataFrame:
    """Mention, context and blended vectors of each row.

    By default one pass over the rows makes all three. `distinct` encodes each distinct text once, which is worth
    its shuffles for a slow model and texts that repeat a lot. `apart` makes each vector in a pass of its own, so that
    those nobody reads are not made; worth it for a fast model and rows that are not stored with their vectors.
    """
    rows = text.mention_context(mentions)
    if apart:
        # A row with a sentence has both texts, without one it has no context.
        spoken = F.when(F.col(schema.SENTENCE).isNotNull(), F.col("mention")), F.col("context")
        made = [plugins.encode_column(words, encoder, once=True) for words in spoken]
        blended = plugins.embed_columns(F.col("mention"), F.col("context"), encoder, alpha, once=True, blend_only=True)
        return rows.select("*", *(c.alias(n) for c, n in zip((*made, blended), ("mention_vec", "context_vec", "combined_vec"))))
    if not distinct:
        embedded = plugins.embed_columns(F.col("mention"), F.col("context"), encoder, alpha)
        return rows.withColumn("_vectors", embedded).select(*rows.columns, "_vectors.*")
    rows = plugins.encode_distinct(rows, "mention", "mention_vec", encoder)
    rows = plugins.encode_distinct(rows, "context", "context_vec", encoder)
    blended = vectors.blend(F.col("mention_vec"), F.col("context_vec"), alpha)
    return rows.withColumn("_blend", blended).withColumn("combined_vec", vectors.l2_normalize(F.col("_blend"))).drop("_blend")


def fit_reduction(rows: DataFrame, dimensions: int, vector: str = "combined_vec") -> PipelineModel | None:
    """The centred principal components of a vector column, or None if there is nothing to reduce.

    Spark's PCA does not centre on transform, so a scaler that only subtracts the mean comes first.
    """
    first = rows.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    if first is None or dimensions >= first[0]:
        return None
    size = rows.where(F.col(vector).isNotNull()).limit(dimensions + 1).count()
    wanted = max(1, min(dimensions, size - 1))
    steps = [
        StandardScaler(inputCol="_in", outputCol="_centred", withMean=True, withStd=False),
        PCA(k=wanted, inputCol="_centred", outputCol="_out"),
    ]
    return Pipeline(stages=steps).fit(_features(rows, vector))


def _features(rows: DataFrame, vector: str) -> DataFrame:
    return rows.where(F.col(vector).isNotNull()).withColumn("_in", array_to_vector(vector))


def reduce_vectors(rows: DataFrame, model: PipelineModel | None, vector: str = "combined_vec") -> DataFrame:
    """Rows with the vector column reduced and at unit length; rows without a vector pass."""
    if model is None:
        return rows
    reduced = model.transform(_features(rows, vector)).withColumn(
        vector, vectors.l2_normalize(vector_to_array("_out"))
    )
    empty = rows.where(F.col(vector).isNull())
    return reduced.select(*rows.columns).unionByName(empty)


def build_index(
    mentions: DataFrame,
    encoder: plugins.Encoder,
    method: str = DEFAULTS.clustering_method,
    options: Options = DEFAULTS,
    distinct: bool = False,
) -> tuple[DataFrame, PipelineModel | None]:
    """Mentions with row_id → the rows of an index, and the reduction that was fitted."""
    rows = written(add_vectors(mentions, encoder, options.alpha_span_weight, distinct).drop("context"))
    # Reduction, clusters and medoids see ids, one vector and the mention only; the texts meet them once, at the end.
    narrow = rows.select("row_id", "mention", "combined_vec")
    model = fit_reduction(narrow, options.reduced_dimensions)
    if model is not None:
        narrow = written(reduce_vectors(narrow, model))
        rows = rows.drop("combined_vec").join(narrow.select("row_id", "combined_vec"), "row_id")
    vecs = narrow.select("row_id", "mention", F.col("combined_vec").alias("vec"))
    found = cut(cluster.cluster(vecs.select("row_id", "vec"), method, options))
    total = found.count()
    best = cut(medoids.medoids(vecs.join(found, "row_id"), total))
    named = medoids.with_canonical_mention(found, best, total)
    return rows.join(named, "row_id", "left"), model


def create_corpus(
    spark: SparkSession,
    store: CorpusStore,
    name: str,
    dataset_path: str,
    *,
    method: str = DEFAULTS.clustering_method,
    encoder: str = DEFAULTS.encoder,
    column_mapping: dict[str, str] | None = None,
    delimiter: str | None = None,
    options: Options = DEFAULTS,
    index_now: bool = True,
    multi_line: bool = True,
) -> str:
    """Register a corpus with its settings, build its index and return its id."""
    corpus_id = clean_corpus_id(name)
    store.register(
        corpus_id=corpus_id,
        name=name.strip(),
        dataset_path=dataset_path,
        encoder=encoder,
        clustering_method=method,
        alpha=options.alpha_span_weight,
        column_mapping=column_mapping,
        delimiter=delimiter,
        multi_line=multi_line,
        similarity_threshold=options.similarity_threshold,
        reduced_dimensions=options.reduced_dimensions,
        neighbours=options.neighbours,
        created_at=_now(),
    )
    if index_now:
        update_corpus(spark, store, corpus_id, options)
    return corpus_id


def update_corpus(spark: SparkSession, store: CorpusStore, corpus_id: str, options: Options = DEFAULTS) -> None:
    """Build the index of a registered corpus again, with the settings it was created with; `options` has the others.

    Index and reduction belong to one build, which holds once both are written; until then the build before does.
    """
    meta = store.get(corpus_id)
    if meta is None:
        raise LookupError(f"corpus {corpus_id!r} not found")
    multi_line = meta.multi_line is not False
    mentions = delimited.load_mentions(spark, meta.dataset_path, meta.column_mapping, meta.delimiter, multi_line)
    kept = {
        "alpha_span_weight": meta.alpha, "similarity_threshold": meta.similarity_threshold,
        "reduced_dimensions": meta.reduced_dimensions, "neighbours": meta.neighbours,
    }
    settings = Options(**{**options.__dict__, **{k: v for k, v in kept.items() if v is not None}})
    rows, model = build_index(mentions, plugins.encoder_named(meta.encoder), meta.clustering_method, settings)
    build = store.new_build()
    store.save_index(rows, corpus_id, build)
    if model is not None:
        model.write().overwrite().save(store.pca_path(corpus_id, build))
    store.publish(build, spark.createDataFrame([(corpus_id,)], "corpus_id string"))


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()
