"""From raw documents to one row per entity mention."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import plugins, text
from spanloom.session import cut, store
from spanloom.sources import schema


# What a word that may be an abbreviation is made of.
LETTERS = "[A-Za-zÀ-ÿ]"
# Whole texts that a task holds as Python objects at once.
TEXTS = 256


def learn_abbreviations(
    documents: DataFrame, text_col: str = "text", least: int = 5, percent: int = 90, longest: int = 4
) -> DataFrame:
    """(word, dotted, plain): short words that nearly always have a full stop behind them, from all documents.

    After Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection", 2006: an abbreviation and its full stop
    go together wherever they stand, while a word that only ends sentences also stands inside them. Words are runs of
    letters, compared in lower case; `least` occurrences with the full stop and `percent` of all are asked.
    """
    found = F.regexp_extract_all(text.clean_text(F.col(text_col)), F.lit(rf"{LETTERS}+\.?"), F.lit(0))
    words = documents.select(F.explode(found).alias("_found")).select(
        F.lower(F.rtrim("_found", F.lit("."))).alias("word"), F.col("_found").endswith(".").alias("_dotted")
    )
    counted = words.where(F.length("word") <= longest).groupBy("word").agg(
        F.count_if("_dotted").alias("dotted"), F.count_if(~F.col("_dotted")).alias("plain")
    )
    return counted.where((F.col("dotted") >= least) & (100 * F.col("dotted") >= percent * (F.col("dotted") + F.col("plain"))))


def _joined(parts: Column, abbreviations: DataFrame) -> Column:
    """The parts of a text, each put together with the next one while it ends in an abbreviation and one full stop."""
    # Words of a few letters: one row for each that was learnt.
    known = frozenset(r.word for r in abbreviations.select("word").distinct().collect())
    last = re.compile(rf"(?<![^\W\d_])({LETTERS}+)\.$")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            # Whole texts are long, so few of them are Python objects at once.
            for at in range(0, max(1, len(batch)), TEXTS):
                rows = []
                for row in batch.slice(at, TEXTS).to_pylist():
                    whole: list[str] = []
                    open_end = False
                    for part in row or ():
                        if open_end:
                            whole[-1] += " " + part
                        else:
                            whole.append(part)
                        match = last.search(part)
                        open_end = match is not None and match.group(1).lower() in known
                    rows.append(None if row is None else whole)
                yield pa.array(rows, pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(parts)


def split_sentences(documents: DataFrame, text_col: str = "text", abbreviations: DataFrame | None = None) -> DataFrame:
    """One row per non-blank sentence, numbered by `sentence_no` within its document; no shuffle.

    A full stop behind one of the `abbreviations` (word) does not end a sentence.
    """
    others = [c for c in documents.columns if c != text_col]
    split = text.sentences_of(text.clean_text(F.col(text_col)))
    if abbreviations is not None:
        split = _joined(split, abbreviations)
    # Without `outer` Spark asks first whether there are parts at all, and splits each text a second time for it.
    parts = documents.select(*others, F.posexplode_outer(split).alias("sentence_no", "_part"))
    return parts.select(*others, "sentence_no", text.strip(F.col("_part")).alias("sentence")).where(
        F.length("sentence") > 0
    )


def _words(sentences: DataFrame, pattern: str) -> DataFrame:
    """Each distinct match of a pattern in each sentence, in its own row."""
    found = F.array_distinct(F.regexp_extract_all("sentence", F.lit(pattern), F.lit(0)))
    # `outer` for the reason given in `split_sentences`.
    return sentences.select("*", F.explode_outer(found).alias("_word")).where(F.col("_word").isNotNull())


PLACES = "array<struct<start: int, end: int>>"
SPANS = "array<struct<start: int, end: int, type: string>>"
# The largest term table that is sent to all executors, and what a term takes there besides its text: its hash, two
# offsets and its place in the order.
TERM_BYTES, TERM_ROW = 192 << 20, 24


def _places(pattern: str) -> Column:
    """The matches of a pattern in a sentence as (start, end), in their order."""
    compiled = re.compile(pattern)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [
                [{"start": m.start(), "end": m.end()} for m in compiled.finditer(sentence or "")] for sentence in batch.to_pylist()
            ]
            yield pa.array(found, kind)

    return F.arrow_udf(run, PLACES)(F.col("sentence"))


def _folded(word: str, ignore_case: bool) -> Column:
    return F.lower(word) if ignore_case else F.col(word)


def frequent_words(sentences: DataFrame, pattern: str, min_count: int, ignore_case: bool = False) -> DataFrame:
    """The matches of a pattern that occur at least `min_count` times, once per sentence: a term table from the texts."""
    terms = _words(sentences, pattern).groupBy(_folded("_word", ignore_case).alias("term"))
    return terms.agg(F.count(F.lit(1)).alias("sentences")).where(F.col("sentences") >= min_count)


def gazetteer_mentions(
    sentences: DataFrame, terms: DataFrame, pattern: str, ignore_case: bool = False, most_words: int = 1,
    term_bytes: int = TERM_BYTES,
) -> DataFrame:
    """One mention for each occurrence of a term of the table, at its own place.

    Words are the matches of `pattern`, which Spark and Python must read alike, so no term is found inside a word. A term may have up to `most_words` of them;
    what stands between the words must be the same in the term. Of terms that overlap all are found. `terms` has the
    column term and may have entity_type. Terms of at most `term_bytes`, as measured, are sent to all executors, and one
    pass over the sentences gives the mentions; larger tables are joined with all runs of words.
    """
    return mention_rows(gazetteer_spans(sentences, terms, pattern, ignore_case, most_words, term_bytes))


def gazetteer_spans(
    sentences: DataFrame, terms: DataFrame, pattern: str, ignore_case: bool = False, most_words: int = 1,
    term_bytes: int = TERM_BYTES,
) -> DataFrame:
    """As `gazetteer_mentions`, but one row per sentence with its mentions as `spans` (start, end, type).

    A sentence is held once, however many mentions it has; `mention_rows` makes their rows. Sentences without one may be
    left out.
    """
    kind = F.col("entity_type") if "entity_type" in terms.columns else F.lit("TERM")
    typed = cut(terms.select(_folded("term", ignore_case).alias("_term"), kind.alias(schema.TYPE)).where(F.col("_term").isNotNull()))
    row = F.octet_length("_term") + F.coalesce(F.octet_length(schema.TYPE), F.lit(0)) + TERM_ROW
    if (typed.agg(F.sum(row.cast("bigint"))).first()[0] or 0) <= term_bytes:
        return sentences.withColumn("spans", _known_places(sentences, typed, pattern, ignore_case, most_words))
    # Only the runs of words travel to the terms, and only the spans back to the sentences.
    held = store(sentences.withColumn("_sentence", F.monotonically_increasing_id()), codec="zstd")
    words = held.select("_sentence", "sentence").withColumn("_places", _places(pattern))
    runs = words.withColumn("_span", F.explode(F.concat(*[_runs(n) for n in range(most_words)])))
    runs = runs.withColumn("_word", _cut(F.col("_span")["start"], F.col("_span")["end"]))
    found = runs.select("_sentence", "_span", _folded("_word", ignore_case).alias("_term")).join(typed, "_term")
    span = F.struct(F.col("_span.start").alias("start"), F.col("_span.end").alias("end"), F.col(schema.TYPE).alias("type"))
    return held.join(found.groupBy("_sentence").agg(F.collect_list(span).alias("spans")), "_sentence").drop("_sentence")


def mention_rows(found: DataFrame) -> DataFrame:
    """One row per mention of sentences with `spans`."""
    return found.withColumn("_span", F.explode("spans")).select(
        *[c for c in found.columns if c not in ("sentence", "spans")],
        F.col("sentence").alias(schema.SENTENCE),
        _cut(F.col("_span")["start"], F.col("_span")["end"]).alias(schema.ENTITY),
        F.col("_span")["start"].alias(schema.START),
        F.col("_span")["end"].alias(schema.END),
        F.col("_span")["type"].alias(schema.TYPE),
    )


def _hashes(words: list[str]) -> np.ndarray:
    """64 bits of each word, the same in every process."""
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)


def _known_places(sentences: DataFrame, typed: DataFrame, pattern: str, ignore_case: bool, most_words: int) -> Column:
    """The places (start, end, type) of the terms in a sentence: each run of words is looked up where it stands.

    The terms are sent as columns in the order of their hashes, a few bytes each besides their texts; a run of words is
    compared with all terms of its hash.
    """
    compiled, known = re.compile(pattern), typed.toArrow()
    hashes = np.concatenate([np.zeros(0, np.uint64), *(_hashes(b.column(0).to_pylist()) for b in known.to_batches())])
    order = np.argsort(hashes, kind="stable")
    columns = [pa.concat_arrays([pa.array([], pa.string()), *known.column(i).chunks]).take(pa.array(order)) for i in (0, 1)]
    shared = sentences.sparkSession.sparkContext.broadcast((hashes[order], *columns))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes, terms, types = shared.value
        for batch in batches:
            rows, starts, ends, pieces = [], [], [], []
            for row, sentence in enumerate(batch.fill_null("").to_pylist()):
                folded = sentence.lower() if ignore_case else sentence
                # Places in the folded sentence are those of the sentence unless a letter grew; a final sigma hangs on its place.
                folded = folded if len(folded) == len(sentence) and "Σ" not in sentence else None
                words = [m.span() for m in compiled.finditer(sentence)]
                for number, (start, _) in enumerate(words):
                    for _, end in words[number : number + most_words]:
                        rows.append(row)
                        starts.append(start)
                        ends.append(end)
                        pieces.append(folded[start:end] if folded is not None else sentence[start:end].lower())
            asked = _hashes(pieces)
            first, behind = np.searchsorted(hashes, asked, "left"), np.searchsorted(hashes, asked, "right")
            counts = behind - first
            which = np.repeat(np.arange(len(pieces)), counts)
            term = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(len(which))
            same = pc.equal(terms.take(pa.array(term)), pa.array(pieces, pa.string()).take(pa.array(which)))
            same = same.to_numpy(zero_copy_only=False).astype(bool)
            which, term = which[same], term[same]
            found = np.bincount(np.array(rows, np.int64)[which], minlength=len(batch))
            spans = [pa.array(np.array(c, np.int32)[which]) for c in (starts, ends)] + [types.take(pa.array(term))]
            yield pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(found)], pa.int32()), pa.StructArray.from_arrays(spans, ["start", "end", "type"])
            )

    # Else a filter on the places, which Spark adds by itself, would have them looked up a second time.
    return F.arrow_udf(run, SPANS).asNondeterministic()(F.col("sentence"))


def _runs(more: int) -> Column:
    """The places of each word together with the `more` words after it."""
    firsts = F.slice("_places", F.lit(1), F.greatest(F.size("_places") - more, F.lit(0)))
    return F.transform(
        firsts, lambda first, i: F.struct(first["start"].alias("start"), F.get("_places", i + more)["end"].alias("end"))
    )


def _cut(start: Column, end: Column) -> Column:
    return F.substring(F.col("sentence"), (start + 1).cast("int"), (end - start).cast("int"))


def spans_of(tokens: Iterable[tuple[str, int, int]]) -> list[dict]:
    """The entity spans of the tokens (label, start, end) of one sentence.

    A zero-width token or the label O closes the open entity. A token goes on with it if its type equals the
    type of the entity or its label starts with I-; the entity keeps the type of its first token.
    """
    spans, extending = [], False
    for label, start, end in tokens:
        kind = label.rsplit("-", 1)[-1]
        if label == "O" or start == end:
            extending = False
        elif extending and (spans[-1]["type"] == kind or label[:2] == "I-"):
            spans[-1]["end"] = end
        else:
            spans.append({"start": start, "end": end, "type": kind})
            extending = True
    return spans


def merged_spans(tokens: Column) -> Column:
    """`spans_of` an array of tokens (label, start, end), in the row."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _merged(batch)

    return F.arrow_udf(run, SPANS)(tokens)


def _merged(tokens: pa.Array) -> pa.Array:
    """`spans_of` each row of a column of tokens, all rows at once.

    An entity has the type of the last token that could open one: the first after a gap, or one without I-. Such a token
    begins a new entity if it is the first, or its type is another than that before it.
    """
    flat = tokens.flatten()
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(tokens)), sizes)
    start, end = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("start", "end"))
    coded = flat.field("label").dictionary_encode()
    names = coded.dictionary.to_pylist()
    label = coded.indices.to_numpy(zero_copy_only=False)
    types = list(dict.fromkeys(name.rsplit("-", 1)[-1] for name in names))
    kind, inside, outside = (
        np.array(of, t)[label] if names else np.zeros(0, t)
        for of, t in (
            ([types.index(n.rsplit("-", 1)[-1]) for n in names], np.int64), ([n[:2] == "I-" for n in names], bool),
            ([n == "O" for n in names], bool),
        )
    )
    gap = outside | (start == end)
    first = ~gap & np.r_[True, gap[:-1] | (row[1:] != row[:-1])][: len(gap)]
    opens = first | (~gap & ~inside)
    opened = kind[np.maximum.accumulate(np.where(opens, np.arange(len(gap)), 0))]
    begins = first | (opens & np.r_[True, kind[1:] != opened[:-1]][: len(gap)])
    at, held = np.flatnonzero(begins), np.flatnonzero(~gap)
    entity = np.cumsum(begins)[held]
    last = held[np.r_[entity[1:] != entity[:-1], True][: len(held)]]
    found = [pa.array(start[at], pa.int32()), pa.array(end[last], pa.int32()), pa.array(types, pa.string()).take(pa.array(kind[at]))]
    counts = np.bincount(row[at], minlength=len(tokens))
    return pa.ListArray.from_arrays(
        pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.StructArray.from_arrays(found, ["start", "end", "type"])
    )


def merge_tag_spans(tokens: DataFrame, key: str | list[str] = "sent_id") -> DataFrame:
    """Join a table of tagged tokens (key, tok_idx, label, start, end) to entity spans (key, start, end, type).

    The rules are those of `spans_of`, as gaps and islands: a gap is a token without type or width. The type of an entity
    is that of the last token before that opened one, the first of an island or one not labelled I-; such a token begins
    a new entity where its type is another. The tokens of a sentence meet once, and no row leaves the JVM.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = Window.partitionBy(*keys).orderBy("tok_idx")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = (F.col("label") == "O") | (F.col("start") == F.col("end"))
    kind = F.substring_index("label", "-", -1)
    marked = tokens.select(
        *keys, "tok_idx", "label", "start", "end", gap.alias("_gap"), kind.alias("_kind"),
        (~gap & F.lag(gap, 1, True).over(order)).alias("_first"),
    )
    opens = F.col("_first") | (~F.col("_gap") & ~F.col("label").startswith("I-"))
    typed = marked.withColumn("_type", F.last(F.when(opens, F.col("_kind")), ignorenulls=True).over(so_far))
    begins = F.col("_first") | (opens & (F.col("_kind") != F.lag("_type").over(order)))
    numbered = typed.withColumn("_no", F.count_if(begins).over(so_far)).where(~F.col("_gap"))
    place = F.col("tok_idx")
    spans = numbered.groupBy(*keys, "_no").agg(
        F.min_by("start", place).alias("start"), F.max_by("end", place).alias("end"), F.min_by("_kind", place).alias("type")
    )
    return spans.drop("_no")


def tag_mentions(sentences: DataFrame, tagger: plugins.Tagger) -> DataFrame:
    """Run a tagger over the sentences and give one row per entity; tokens and spans stay in the row of the sentence."""
    return entity_rows(sentences, plugins.tag_column(F.col("sentence"), tagger))


def entity_rows(sentences: DataFrame, tokens: Column) -> DataFrame:
    """One row for each entity of the tokens of a sentence; blank ones are dropped."""
    kept = [c for c in sentences.columns if c != "sentence"]
    spans = sentences.withColumn("_span", F.explode(merged_spans(tokens)))
    return spans.select(
        *kept,
        F.col("sentence").alias(schema.SENTENCE),
        _cut(F.col("_span")["start"], F.col("_span")["end"]).alias(schema.ENTITY),
        F.col("_span")["start"].alias(schema.START),
        F.col("_span")["end"].alias(schema.END),
        F.col("_span")["type"].alias(schema.TYPE),
    ).where(F.length(text.strip(F.col(schema.ENTITY))) > 0)
