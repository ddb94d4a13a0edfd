"""Exchangeable models: encoder, re-ranker and tagger, run in Arrow batches.

A model object is sent to the workers once and used for all batches of a task. Models that are costly to load
should load themselves on the first call.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray:
        """One unit vector per text, as a matrix."""


class Reranker(Protocol):
    def score(self, terms: list[str], sentences: list[str]) -> np.ndarray:
        """One relevance per pair of search term and sentence."""


class Tagger(Protocol):
    def tag(self, sentences: list[str]) -> list[list[tuple[str, int, int]]]:
        """Per sentence its tokens as (label, start, end)."""


# Texts that are encoded at once: with the work space of a model, what a worker holds besides its batch.
ENCODE_ROWS = 1_024


class HashedTrigramEncoder:
    """Counts of character trigrams of the lower-case text in `dim` buckets, at unit length.

    The text is padded with one space at each end. This compares spelling only; matching by meaning needs a
    model of the user.
    """

    # Weights of the three code points in the bucket number.
    weights = (961, 31, 1)

    def __init__(self, dim: int = 256):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        padded = [f" {t.lower()} " for t in texts]
        # The largest code point is 0x10FFFF, so with these weights 32 bits do.
        kind = np.int32 if sum(self.weights) * 0x10FFFF < 1 << 31 else np.int64
        points = np.frombuffer("".join(padded).encode("utf-32-le"), dtype="<u4").astype(kind)
        if len(points) < 3:
            return np.zeros((len(texts), self.dim))
        a, b, c = self.weights
        total = a * points[:-2] + b * points[1:-1] + c * points[2:]
        bucket = total & (self.dim - 1) if self.dim & (self.dim - 1) == 0 else total % self.dim
        lengths, size = np.array([len(p) for p in padded]), len(texts) * self.dim
        cells = np.repeat(np.arange(len(texts)) * self.dim, lengths)[:-2] + bucket
        # The last two places of a text reach into the next one; they are counted apart.
        ends = np.cumsum(lengths)[:-1]
        cells[ends - 2] = cells[ends - 1] = size
        counts = np.bincount(cells, minlength=size + 1)[:size].reshape(len(texts), self.dim).astype(float)
        lengths = np.sqrt(np.einsum("ij,ij->i", counts, counts))[:, None]
        return counts / np.where(lengths == 0, 1e-9, lengths)


class JaccardReranker:
    """Share of common lower-case words of term and sentence; runs as a plain expression."""

    def column(self, term: Column, sentence: Column) -> Column:
        def words(text: Column) -> Column:
            return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))

        a, b = words(term), words(sentence)
        union = F.size(F.array_union(a, b))
        return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def _float_lists(matrix: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Rows of `matrix` where `valid`, else NULL."""
    dim = matrix.shape[1]
    lengths = np.where(valid, dim, 0)
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), mask=np.concatenate([~valid, [False]]))
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.astype(np.float32).ravel()))


def _slices(length: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of the slices of a batch that are worked on one after the other; an empty batch is one."""
    return ((at, min(ENCODE_ROWS, length - at)) for at in range(0, max(1, length), ENCODE_ROWS))


def encode_column(text: Column, encoder: Encoder, once: bool = False) -> Column:
    """The vectors of a text column; NULL for NULL.

    `once` keeps a filter on the vectors from having them made a second time.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in (batch.slice(*place) for place in _slices(len(batch))):
                valid = np.asarray(part.is_valid())
                texts = part.drop_null().to_pylist()
                matrix = np.asarray(encoder.encode(texts)) if texts else np.zeros((0, encoder.dim))
                yield _float_lists(matrix.reshape(len(texts), encoder.dim), valid)

    made = F.arrow_udf(run, "array<float>")
    return (made.asNondeterministic() if once else made)(text)


def embed_columns(
    mention: Column, context: Column, encoder: Encoder, alpha: float, once: bool = False, blend_only: bool = False
) -> Column:
    """Mention, context and blended vector in one pass, as a struct; NULL where the text is NULL.

    The blend is alpha · mention + (1 - alpha) · context at unit length; a zero vector stays zero. `once` is that of
    `encode_column`. With `blend_only` the blend alone comes back, as a column.
    """
    vector = pa.list_(pa.float32())
    kind = pa.struct([("mention_vec", vector), ("context_vec", vector), ("combined_vec", vector)])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for whole in batches:
            for mentions, contexts in ([c.slice(*place) for c in whole] for place in _slices(len(whole[0]))):
                valid = np.asarray(mentions.is_valid()) & np.asarray(contexts.is_valid())
                texts = mentions.filter(pa.array(valid)).to_pylist(), contexts.filter(pa.array(valid)).to_pylist()
                a, b = (
                    np.asarray(encoder.encode(t)).astype(np.float32) if t else np.zeros((0, encoder.dim), np.float32)
                    for t in texts
                )
                blend = alpha * a.astype(float) + (1.0 - alpha) * b.astype(float)
                length = np.sqrt(np.einsum("ij,ij->i", blend, blend))[:, None]
                blend = blend / np.where(length == 0, 1e-9, length)
                if blend_only:
                    yield _float_lists(blend, valid)
                else:
                    yield pa.StructArray.from_arrays([_float_lists(m, valid).cast(vector) for m in (a, b, blend)], fields=list(kind))

    all_three = "struct<mention_vec:array<float>,context_vec:array<float>,combined_vec:array<float>>"
    made = F.arrow_udf(run, "array<float>" if blend_only else all_three)
    return (made.asNondeterministic() if once else made)(mention, context)


def encode_distinct(df: DataFrame, text: str, vector: str, encoder: Encoder) -> DataFrame:
    """As `encode_column`, but each distinct text is encoded once; worth its two shuffles for a slow model."""
    from spanloom.skew import lookup

    known = df.where(F.col(text).isNotNull())
    texts = known.groupBy(text).agg(F.count(F.lit(1)).alias("_rows"))
    vectors = texts.withColumn(vector, encode_column(F.col(text), encoder))
    empty = df.where(F.col(text).isNull()).withColumn(vector, F.lit(None).cast("array<float>"))
    return lookup(known, vectors, text, "_rows").unionByName(empty)


def rerank_column(term: Column, sentence: Column, reranker: Reranker) -> Column:
    """The relevance of each (term, sentence) pair."""
    if hasattr(reranker, "column"):
        return reranker.column(term, sentence)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for terms, sentences in batches:
            scores = reranker.score(terms.to_pylist(), sentences.fill_null("").to_pylist())
            yield pa.array(np.asarray(scores, dtype=float))

    return F.arrow_udf(run, "double")(term, sentence)


TOKENS = "array<struct<label:string,start:int,end:int>>"


def tag_column(sentence: Column, tagger: Tagger) -> Column:
    """The tagged tokens of each sentence; none for a blank sentence."""
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in (batch.slice(*place) for place in _slices(len(batch))):
                texts = part.fill_null("").to_pylist()
                spoken = [t for t in texts if t.strip()]
                tagged = iter(tagger.tag(spoken) if spoken else [])
                tokens = [next(tagged) if t.strip() else [] for t in texts]
                labels, starts, ends = zip(*(token for one in tokens for token in one)) if any(map(len, tokens)) else ((), (), ())
                columns = pa.array(labels, pa.string()), pa.array(map(int, starts), pa.int32()), pa.array(map(int, ends), pa.int32())
                flat = pa.StructArray.from_arrays(columns, fields=list(kind.value_type))
                yield pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(one) for one in tokens])], pa.int32()), flat, type=kind)

    return F.arrow_udf(run, TOKENS)(sentence)


class LengthTagger:
    """A tagger that labels the words between single blanks by their length; a stand-in where no model is at hand."""

    # The longest word of each label.
    KINDS = ((2, "O"), (3, "B-PER"), (5, "I-PER"), (7, "B-LOC"), (9, "I-LOC"))

    def tag(self, sentences):
        longest = self.KINDS[-1][0]
        names = [next(name for most, name in self.KINDS if length <= most) for length in range(longest + 1)]
        tagged = []
        for sentence in sentences:
            at, tokens = 0, []
            for length in map(len, sentence.split(" ")):
                tokens.append((names[length] if length <= longest else "ORG", at, at + length))
                at += length + 1
            tagged.append(tokens)
        return tagged


# Built-in models by name; a user registers own ones here.
ENCODERS = {"hashed_trigram": HashedTrigramEncoder}
RERANKERS = {"jaccard": JaccardReranker}


def encoder_named(name: str) -> Encoder:
    if name not in ENCODERS:
        raise ValueError(f"unknown encoder {name!r}; register it in ENCODERS")
    return ENCODERS[name]()


def reranker_named(name: str | None) -> Reranker | None:
    """The re-ranker of that name; None, "none", "null" and "" switch re-ranking off."""
    if name is None or name.lower() in ("none", "", "null"):
        return None
    if name not in RERANKERS:
        raise ValueError(f"unknown re-ranker {name!r}; register it in RERANKERS")
    return RERANKERS[name]()
