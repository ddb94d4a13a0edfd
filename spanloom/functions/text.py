"""Text expressions: cleaning, sentence boundaries, spans and marked contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.sources import schema

# The characters that count as blank at the ends of a text.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# A sentence ends after closing marks that are followed by a blank, or after a full-width mark.
SENTENCE_END = r"([.!?…]+)\s+|([。！？]+)\s*"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def clean_text(text: Column) -> Column:
    """Line breaks to spaces, one pass over double spaces, ends stripped."""
    spaced = F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    return strip(F.replace(spaced, F.lit("  "), F.lit(" ")))


def sentences_of(cleaned: Column) -> Column:
    """The sentences of a cleaned text, closing marks kept."""
    return F.split(F.regexp_replace(cleaned, SENTENCE_END, "$1$2\n"), "\n")


def offset(df: DataFrame, name: str) -> Column:
    """An offset as a whole number: numeric columns are truncated, texts must be whole numbers."""
    if name not in df.columns:
        return F.lit(None).cast("bigint")
    return F.col(name).try_cast("bigint")


def is_present(df: DataFrame, name: str) -> Column:
    """Whether an offset was given at all."""
    if name not in df.columns:
        return F.lit(False)
    kind = dict(df.dtypes)[name]
    present = F.col(name).isNotNull()
    return present & ~F.isnan(name) if kind in ("double", "float") else present


def mention_context(df: DataFrame, mention: str = "mention", context: str = "context") -> DataFrame:
    """Add the mention text and the sentence with the marked mention.

    A valid span decides the mention; otherwise the entity text; otherwise the whole sentence. The context is missing where
    the sentence is, and a row with a sentence has both.
    """
    sentence = F.col(schema.SENTENCE)
    start, end = offset(df, schema.START), offset(df, schema.END)
    given = is_present(df, schema.START) & is_present(df, schema.END)
    valid = F.coalesce(given & (start >= 0) & (start < end) & (end <= F.length(sentence)), F.lit(False))
    span = F.substring(sentence, (start + 1).cast("int"), (end - start).cast("int"))
    if schema.ENTITY in df.columns:
        entity = F.col(schema.ENTITY)
        named = F.when(entity.isNull() | entity.isin("", "nan"), sentence).otherwise(entity)
    else:
        named = sentence
    marked = F.concat(
        F.substring(sentence, F.lit(1), start.cast("int")),
        F.lit(" <mention> "), span, F.lit(" </mention> "),
        F.substring(sentence, (end + 1).cast("int"), F.lit((1 << 31) - 1)),
    )
    return df.withColumns(
        {mention: F.when(valid, span).otherwise(named), context: F.when(valid, marked).otherwise(sentence)}
    )


def provenance(df: DataFrame) -> Column:
    """The first of the provenance columns that says something."""
    names = [c for c in ("document_id", "source_document", "source_file") if c in df.columns]
    if not names:
        return F.lit(None).cast("string")
    texts = [F.col(c).cast("string") for c in names]
    return F.coalesce(*[F.when(~F.trim(t).isin("", "None", "nan"), t) for t in texts])
