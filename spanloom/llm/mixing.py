"""Mixing sources to target weights by capped water-filling.

The mix has a given share of all sizes. Each source wants its part by weight; one that would be repeated more than
`max_epochs` times is held there, and what it cannot take goes to the others by weight, until none is above. With the
sources in the order of cap / weight, the common level of the others is the largest of (budget - caps so far) / (weights
from here on), so one pass over the table of sources finds it. A document is repeated as often as whole epochs fit, and
once more if it lies within the remaining words in a seeded random order of its source. That order is cut in two steps,
by hash buckets and then inside the one bucket that the cut falls into, so a large source is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import ids_of
from spanloom.session import store

WORD = r"[^\x20\x09-\x0D]+"
# Fixed values of the mix: weights of the sources in code point order, share of all words, most repetitions.
WEIGHTS, SHARE, MAX_EPOCHS, SEED = (5, 2, 1), 1.5, 2, 17
# Hex digits of a hash that name its bucket: 4,096 buckets per source.
BUCKET_DIGITS = 3


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) of rows (source, size). NULL is a source of its own and comes last.

    The windows run over the table of sources, which has one row for each.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    capped = totals.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), F.asc_nulls_last("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    level = (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(onward)
    levelled = capped.withColumn("_level", level).withColumn("_level", F.max("_level").over(Window.partitionBy()))
    return levelled.select("source", "source_size", F.least("_cap", F.col("_level") * F.col("_weight")).alias("target"))


def mix(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """(key, size, source_size, target, repeats) of rows (key, source, text): how often the mix takes each document.

    The size is the number of words, 0 for a NULL text. Ties of the seeded order go to the smaller text; rows that agree
    in key and size are alike, so it does not matter which of them is taken. An empty table gives no rows.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))))
    sized = store(
        rows.select(
            "key", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            order.alias("_order"),
        ).withColumn("_bucket", F.substring("_order", 1, BUCKET_DIGITS))
    )
    aims = targets(sized, weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    aims = aims.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    buckets = sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_start", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    placed = _join(buckets, aims, "source").withColumn(
        "_cut", (F.col("_start") < F.col("_rest")) & (F.col("_start") + F.col("_words") > F.col("_rest"))
    )
    joined = _join(sized, placed, "source", "_bucket")
    taken = (F.col("_start") < F.col("_rest")).cast("int")
    inside = Window.partitionBy("source", "_bucket").orderBy("_order", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    # The document on the edge is taken if that comes nearer to the target.
    edge = (2 * start + F.col("size") <= 2 * F.col("_rest")).cast("int")
    clear = joined.where(~F.col("_cut")).withColumn("_extra", taken)
    cut = joined.where(F.col("_cut")).withColumn("_extra", edge)
    return clear.unionByName(cut).select(
        "key", "size", "source_size", "target", (F.col("_whole") + F.col("_extra")).cast("bigint").alias("repeats")
    )


def _join(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join where NULL equals NULL."""
    named = right.withColumnsRenamed({k: f"_r{k}" for k in keys})
    return left.join(named, [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys]).drop(*[f"_r{k}" for k in keys])


def repeat(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """`docs` with each row as often as the mix takes it; rows that share a key are taken alike, as often as one of them.

    A row without a key counts by its content.
    """
    own = ids_of(docs, key).own(F.col(key), F.col(text), F.col(source))
    marked = docs.select(own.alias("key"), F.col(source).alias("source"), F.col(text).alias("text"), F.struct(*docs.columns).alias("row"))
    taken = mix(marked.select("key", "source", "text"), **how)
    times = taken.groupBy("key").agg(F.max("repeats").alias("times")).where(F.col("times") > 0)
    repeated = marked.select("key", "row").join(times, "key").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return repeated.select("row.*")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS w
  FROM d GROUP BY source
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM s) * {SHARE}::DOUBLE
             - coalesce(sum(source_size * {MAX_EPOCHS}::DOUBLE) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW o AS (ORDER BY source_size * {MAX_EPOCHS}::DOUBLE / w, source NULLS LAST)
), t AS (
  SELECT source, source_size, least(source_size * {MAX_EPOCHS}::DOUBLE, (SELECT max(level) FROM l) * w) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), c AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN size > 0 AND 2 * start + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
