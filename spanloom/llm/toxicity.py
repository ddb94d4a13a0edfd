"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; labelled documents of any class, their label unread, are the unlabelled
mixture. With the class prior p, the risk of a scorer is

    p * E+[loss(score, toxic)] + max(0, Eu[loss(score, clean)] - p * E+[loss(score, clean)])

(Kiryo et al., "Positive-Unlabeled Learning with Non-Negative Risk Estimator", 2017): the clean part, which cannot be
negative, is turned back by a gradient step against it whenever the estimate falls below zero. The scorer is a logistic
model in numpy over words, stems and character 5-grams. Only features that are significantly more frequent among the positives
take part; Spark counts them. The sample to fit on is bounded by POSITIVES and UNLABELLED; every row is scored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import store

# Most documents to fit on, and most features: bounds of what reaches the driver.
POSITIVES, UNLABELLED, FEATURES = 4_000, 8_000, 4_096
# A feature takes part from this many positives and this many standard errors above its rate in the mixture.
LEAST_POSITIVES, LEAST_Z = 4, 3.5
GRAM, STEMS = 5, (5, 6, 7)
FOLDS, SEED = 5, 4
STEPS, RATE, DECAY = 600, 0.1, 1e-5
# Words whose features a worker remembers.
CACHE_WORDS = 100_000
_WORD = re.compile(r"[^\W_]+")


def held_out(key) -> "F.Column":
    """Whether a document is kept out of the fit: its crc32 modulo 5 is 0. A row without an id is never labelled."""
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS == 0, F.lit(False))


def features_of(word: str) -> list[str]:
    """The word itself, its character 5-grams with marks for its ends, and its first 5 to 7 characters."""
    marked = f"^{word}$"
    stems = [marked[: n + 1] for n in STEMS if n < len(word)]
    return [word, *stems, *(marked[i : i + GRAM] for i in range(len(marked) - GRAM + 1))]


def text_features(text: str | None) -> set[str]:
    return {f for w in set(_WORD.findall((text or "").lower())) for f in features_of(w)}


def fit(rows: list[list[int]], positive: list[bool], size: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic scorer for rows of feature numbers; rows that are not positive are the mixture."""
    lengths = np.array([len(r) for r in rows])
    columns = np.concatenate([np.array(r, np.int64) for r in rows]) if lengths.sum() else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    plus = np.array(positive)
    share = np.where(plus, 1 / max(1, plus.sum()), 1 / max(1, (~plus).sum()))
    odds = math.log(prior / (1 - prior))
    weights, bias = np.zeros(size), odds
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        scores = bias + np.bincount(owner, weights[columns], len(rows))
        chance = 1 / (1 + np.exp(-np.clip(scores, -50, 50)))
        as_clean = np.logaddexp(0, scores) * share
        clean_risk = as_clean[~plus].sum() - prior * as_clean[plus].sum()
        # Slopes of the losses by the score: chance - 1 for a toxic row, chance for a clean one.
        clean_slope = np.where(plus, -prior, 1.0) * share * chance
        slope = np.where(plus, prior * share * (chance - 1), 0.0) + clean_slope if clean_risk >= 0 else -clean_slope
        grad = np.append(np.bincount(columns, slope[owner], size) + DECAY * weights, slope.sum())
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


@dataclass(frozen=True)
class Scorer:
    """The fitted model; without a positive example it gives every text the score 0."""

    weights: dict[str, float]
    bias: float | None

    def score_all(self, texts: list[str | None], known: dict[str, tuple]) -> np.ndarray:
        if self.bias is None:
            return np.zeros(len(texts))
        scores = np.empty(len(texts))
        for i, text in enumerate(texts):
            found: set[str] = set()
            for word in set(_WORD.findall((text or "").lower())):
                has = known.get(word)
                if has is None:
                    has = known[word] = tuple(f for f in features_of(word) if f in self.weights)
                if has:
                    found.update(has)
            scores[i] = self.bias + sum(self.weights[f] for f in sorted(found))
        if len(known) > CACHE_WORDS:
            known.clear()
        return 1 / (1 + np.exp(-np.clip(scores, -50, 50)))


def train(rows: DataFrame, labels: DataFrame) -> Scorer:
    """Fit on rows (key, text) by labels (key, toxic); labels without key or value are left out, of several any 1 counts."""
    known = labels.where(F.col("key").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("key")))
    known = known.groupBy("key").agg(F.max("toxic").alias("toxic"))
    known = store(known.join(rows.select("key").distinct(), "key", "left_semi"))
    total, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("toxic").cast("bigint")), F.lit(0))).first()
    if not toxic:
        return Scorer({}, None)
    order = [F.xxhash64(F.lit(SEED), "key"), "key"]
    plus = known.where(F.col("toxic") == 1).orderBy(*order).limit(POSITIVES).select("key", F.lit(True).alias("positive"))
    mixture = known.orderBy(*order).limit(UNLABELLED).select("key", F.lit(False).alias("positive"))
    # At most POSITIVES + UNLABELLED keys are sent to the executors.
    chosen = store(plus.unionByName(mixture))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [sorted(text_features(t)) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("key"), pa.array(found, pa.list_(pa.string()))], names=["key", "features"])

    texts = rows.join(F.broadcast(chosen.select("key").distinct()), "key")
    # Of the texts of a repeated key always the same one.
    texts = texts.groupBy("key").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    texts = store(texts.select("key", "text").mapInArrow(run, "key bigint, features array<string>"))
    sampled = texts.join(F.broadcast(chosen), "key")
    n_plus, n_mixed = sampled.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    counts = sampled.select("positive", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count_if("positive").alias("a"), F.count_if(~F.col("positive")).alias("b")
    )
    rate = (F.col("a") + F.col("b")) / (n_plus + n_mixed)
    error = F.sqrt(rate * (1 - rate) * (1 / n_plus + 1 / n_mixed))
    best = counts.withColumn("z", (F.col("a") / n_plus - F.col("b") / n_mixed) / F.greatest(error, F.lit(1e-9)))
    best = best.where((F.col("a") >= LEAST_POSITIVES) & (F.col("z") >= LEAST_Z)).orderBy(F.desc("z"), "feature").limit(FEATURES)
    number = {r.feature: i for i, r in enumerate(best.select("feature").collect())}

    def numbered(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [sorted(number[f] for f in found if f in number) for found in batch.column("features").to_pylist()]
            yield pa.record_batch([batch.column("positive"), pa.array(rows, pa.list_(pa.int32()))], names=["positive", "f"])

    # Only the numbers of chosen features reach the driver, some dozens for each row of the sample.
    kept = sampled.select("positive", "features").mapInArrow(numbered, "positive boolean, f array<int>").toArrow()
    data = sorted(zip(kept.column("positive").to_pylist(), kept.column("f").to_pylist()))
    prior = min(max(toxic / total, 1e-3), 0.5)
    weights, bias = fit([f for _, f in data], [p for p, _ in data], len(number), prior)
    return Scorer({f: float(weights[i]) for f, i in number.items()}, bias)


def score(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """(key, score, predicted) for each of the rows (key, text); a NULL text counts as empty."""

    def run(batches):
        import pyarrow as pa

        known: dict[str, tuple] = {}
        for batch in batches:
            scores = scorer.score_all(batch.column("text").to_pylist(), known)
            predicted = pa.array((scores >= 0.5).astype(np.int32))
            yield pa.record_batch([batch.column("key"), pa.array(scores), predicted], names=["key", "score", "predicted"])

    return rows.select("key", "text").mapInArrow(run, "key bigint, score double, predicted int")


def reject(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """The documents that are not predicted to be toxic, with all their columns."""
    at = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        known: dict[str, tuple] = {}
        for batch in batches:
            yield batch.filter(pa.array(scorer.score_all(batch.column(at).to_pylist(), known) < 0.5))

    return docs.mapInArrow(run, docs.schema)
