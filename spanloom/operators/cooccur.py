"""Entities that occur in the same sentences as the hits of a search, and the network of their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.options import Options
from spanloom.session import broadcast_if_small, cut
from spanloom.sources import schema

DEFAULTS = Options()


def hit_sentences(results: DataFrame) -> DataFrame:
    """The distinct sentences of a result."""
    return results.select(schema.SENTENCE).where(F.col(schema.SENTENCE).isNotNull()).distinct()


def _in_hits(corpus: DataFrame, hits: DataFrame | None) -> DataFrame:
    """All mention rows whose sentence is hit; without hits every row with a sentence."""
    if hits is None:
        return corpus.where(F.col(schema.SENTENCE).isNotNull())
    return corpus.join(broadcast_if_small(hits), schema.SENTENCE, "left_semi")


def _same(sentence: Column) -> Column:
    """32 bytes that stand for a sentence where only its identity counts, so that texts are not shuffled: its SHA-256."""
    return F.unhex(F.sha2(sentence, 256))


def _key(label: Column, ignore_case: bool) -> Column:
    return F.lower(label) if ignore_case else label


def _display(rows: DataFrame) -> DataFrame:
    """(key, display): the form of each key that most rows have, the first seen on ties."""
    forms = rows.groupBy("key", "form").agg(F.count(F.lit(1)).alias("_n"), F.min("_order").alias("_first"))
    # The smallest (-count, first row) is the most frequent form, first seen.
    return forms.groupBy("key").agg(F.min_by("form", F.struct((-F.col("_n")).alias("n"), "_first")).alias("display"))


def cooccurring_entities(
    corpus: DataFrame,
    results: DataFrame | None = None,
    *,
    ignore_case: bool = False,
    order_by: tuple[str, ...] = ("row_id",),
) -> DataFrame:
    """(entity_mention, absolute_count, frequency_pct, frequency_label) over the sentences of `results`.

    `absolute_count` is the number of hit sentences with the entity. `order_by` names the columns that give
    the order of the corpus rows; it decides ties. The order of the result is (absolute_count descending,
    first_seen); `ranked` sorts by it.
    """
    # The hits are written down: the result behind them is costly and read twice, and their size decides the join.
    hits = None if results is None else cut(hit_sentences(results))
    spread = corpus.where(F.col(schema.SENTENCE).isNotNull()).select(_same(F.col(schema.SENTENCE))).distinct() if hits is None else hits
    total = spread.agg(F.count(F.lit(1))).scalar()
    spoken = text.mention_context(_in_hits(corpus, hits), "_mention", "_context")
    both_offsets = text.is_present(spoken, schema.START) & text.is_present(spoken, schema.END)
    named = both_offsets | (F.col("_mention") != F.col(schema.SENTENCE))
    rows = spoken.where(named & ~F.col("_mention").isin("", "nan")).select(
        _same(F.col(schema.SENTENCE)).alias("_sentence"),
        _key(F.col("_mention"), ignore_case).alias("key"),
        F.col("_mention").alias("form"),
        F.struct(*order_by).alias("_order"),
    )
    # One row per (key, sentence) leaves each task, so a frequent entity is no hot key in the second step.
    pairs = rows.groupBy("key", "_sentence").agg(F.min("_order").alias("_first"))
    counts = pairs.groupBy("key").agg(
        F.count(F.lit(1)).alias("absolute_count"), F.min("_first").alias("first_seen")
    )
    if ignore_case:
        counts = counts.join(_display(rows), "key").withColumnRenamed("display", "entity_mention")
    else:
        counts = counts.withColumnRenamed("key", "entity_mention")
    share = F.col("absolute_count") / total * 100.0
    return counts.select(
        "entity_mention",
        "absolute_count",
        share.alias("frequency_pct"),
        F.format_string("%.1f%%", share).alias("frequency_label"),
        "first_seen",
    )


def ranked(cooccurring: DataFrame) -> DataFrame:
    """Most frequent first, ties as first seen."""
    return cooccurring.orderBy(F.desc("absolute_count"), "first_seen").drop("first_seen")


def _labels(corpus: DataFrame, hits: DataFrame | None, use_medoids: bool, ignore_case: bool, order_by) -> DataFrame:
    """(sentence, key, form) of all rows with a label."""
    medoid = use_medoids and "cluster_canonical_mention" in corpus.columns
    label = text.strip(F.col("cluster_canonical_mention" if medoid else schema.ENTITY))
    return (
        _in_hits(corpus, hits)
        .select(_same(text.strip(F.col(schema.SENTENCE))).alias("sentence"), label.alias("form"), F.struct(*order_by).alias("_order"))
        .where(~F.col("form").isin("", "nan"))
        .withColumn("key", _key(F.col("form"), ignore_case))
    )


def _top_keys(pairs: DataFrame, max_nodes: int) -> DataFrame:
    """(key, weight): the keys in most sentences, by name on ties."""
    return (
        pairs.groupBy("key").agg(F.count(F.lit(1)).alias("weight")).orderBy(F.desc("weight"), "key").limit(max_nodes)
    )


def network(
    corpus: DataFrame,
    results: DataFrame | None = None,
    *,
    max_nodes: int = DEFAULTS.max_nodes,
    use_medoids: bool = False,
    ignore_case: bool = False,
    order_by: tuple[str, ...] = ("row_id",),
) -> tuple[DataFrame, DataFrame]:
    """Nodes (label, weight, size) and edges (u, v, weight, width) of the labels that share sentences.

    Only the `max_nodes` heaviest labels are in the graph. A sentence has at most that many of them, and
    sentences with the same set of labels are counted together before any pair is made, so the number of
    pairs is bounded by the number of different label sets, not by the number of sentences.
    """
    hits = None if results is None else cut(hit_sentences(results))
    rows = _labels(corpus, hits, use_medoids, ignore_case, order_by)
    pairs = rows.select("sentence", "key").distinct()
    # Written down, as nodes, names and pairs all start from it; its size decides whether it is broadcast.
    top = cut(_top_keys(pairs, max_nodes))
    keys = broadcast_if_small(top.select("key"))
    if ignore_case:
        shown = _display(rows.join(keys, "key", "left_semi"))
        named = cut(top.join(shown, "key"))
    else:
        named = top.withColumn("display", F.col("key"))
    nodes = named.select(
        F.col("display").alias("label"), "weight", F.greatest(F.lit(300), F.least(F.lit(3000), F.col("weight") * 300)).alias("size")
    )
    sets = (
        pairs.join(keys, "key", "left_semi")
        .groupBy("sentence")
        .agg(F.sort_array(F.collect_list("key")).alias("keys"))
        .where(F.size("keys") > 1)
        .groupBy("keys")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    firsts = sets.select("keys", "n", F.posexplode("keys").alias("at", "a"))
    linked = firsts.select("a", "n", F.explode(F.expr("slice(keys, at + 2, size(keys))")).alias("b"))
    weights = cut(linked.groupBy("a", "b").agg(F.sum("n").alias("weight")))
    heaviest = weights.agg(F.max("weight")).scalar()
    names = broadcast_if_small(named.select("key", "display"))
    edges = (
        weights.join(names.toDF("a", "u"), "a")
        .join(names.toDF("b", "v"), "b")
        .select("u", "v", "weight", F.greatest(F.lit(1.0), F.col("weight") / heaviest * 4.0).alias("width"))
    )
    return nodes, edges
