"""Importance resampling towards a target distribution of hashed n-grams.

Xie et al., "Data Selection for Language Models via Importance Resampling", 2023. Every run of 1 to `order` words is a
feature and falls into a bucket by its checksum. What a bucket gains a document is the log ratio of its share in the
target texts and in all documents; a document weighs the mean gain of its features. Adding seeded Gumbel noise to the
weights and taking the highest sums draws without replacement in proportion to the exponentials of the weights.

Features of a batch: its texts are joined with separators between them, one pass of a regular expression finds all
words, and the document of each word is searched for among the offsets of the texts, so that runs across two documents
are masked before counting. Checksums of longer runs follow from those of their words by arithmetic on whole arrays, as
a CRC is linear. The corpus is read twice, once to count and once to weigh, and nothing but counts and one narrow row per
document is written.

Defined cases: a NULL or empty text has no words, no features and weight 0; a NULL key counts as an empty one in the
seeded noise; rows that agree in score and key are placed by their number of features, then by their place in the stored
table. An empty table gives no rows, and with no target texts all buckets are smoothed alike. A text of any length is
one row of one task and needs about thirty bytes a byte of text there.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.session import number_rows, store

# A-Z are lower-cased first. No byte of a character beyond ASCII is below 128, so bytes will do.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# Ends the last word of a text.
_SEPARATOR = b"\n"
# Bytes of text that are counted together, unless one text is longer.
_BLOCK = 1 << 20
# Lengths up to which words are hashed by columns; longer ones are rare.
_SHORT = 64
# Fixed value: the reversed polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320


@dataclass(frozen=True)
class Resampling:
    """What counts as a feature and how many documents are drawn: `percent` of those with `least_words`, rounded down."""

    order: int = 2
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 25
    seed: int = 7


@lru_cache(1)
def _crc_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table of CRC-32, and by parts of a checksum what it becomes behind n < _SHORT, and 2**b, further bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(_POLYNOMIAL), step >> 1)
    parts = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    behind = [parts]
    for _ in range(_SHORT):
        behind.append(step[behind[-1] & 255] ^ behind[-1] >> 8)
    doubled = [behind[1]]
    for _ in range(31):
        doubled.append(_shift(doubled[-1], doubled[-1]))
    return step, np.stack(behind[:_SHORT]), np.stack(doubled)


def _shift(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def _behind(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The share of each checksum in the one of its bytes and `sizes` further bytes."""
    _, short, doubled = _crc_tables()
    low = sizes % _SHORT
    found = (
        short[low, 0, crc & 255] ^ short[low, 1, crc >> 8 & 255] ^ short[low, 2, crc >> 16 & 255] ^ short[low, 3, crc >> 24]
    )
    for bit in range(6, int(sizes.max(initial=0)).bit_length()):
        long = np.flatnonzero(sizes >> bit & 1)
        found[long] = _shift(doubled[bit], found[long])
    return found


def word_crcs(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word: all first bytes, all second bytes and so on."""
    step = _crc_tables()[0]
    codes, sizes = np.frombuffer(data, np.uint8), ends - starts
    by_size = np.argsort(-np.minimum(sizes, _SHORT + 1).astype(np.int16), kind="stable")
    at, crc = starts[by_size], np.full(len(starts), 0xFFFFFFFF, np.uint32)
    # Words of more than k bytes come first.
    more = np.cumsum(np.bincount(np.minimum(sizes, _SHORT + 1), minlength=_SHORT + 2)[::-1])[::-1]
    for k in range(_SHORT):
        n = int(more[k + 1])
        if not n:
            break
        crc[:n] = step[(crc[:n] ^ codes[at[:n] + k]) & 255] ^ crc[:n] >> 8
    found = np.empty(len(starts), np.uint32)
    found[by_size] = ~crc
    for i in np.flatnonzero(sizes > _SHORT).tolist():
        found[i] = zlib.crc32(data[starts[i] : ends[i]])
    return found


def _features(texts: list[bytes], order: int, buckets: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each length of runs the bucket of every run and the number of its text."""
    data = _SEPARATOR.join(texts).lower()
    spans = np.fromiter((edge for word in _WORD.finditer(data) for edge in word.span()), np.int64).reshape(-1, 2)
    starts, ends = spans[:, 0], spans[:, 1]
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    document = np.searchsorted(offsets, starts, side="right") - 1
    words, sizes = word_crcs(data, starts, ends), ends - starts
    blank = np.uint32(zlib.crc32(b" "))
    after = words ^ _behind(np.full(len(words), blank), sizes)
    run, found, texts_of = words, [(words % buckets).astype(np.int64)], [document]
    for length in range(2, order + 1):
        last = slice(length - 1, None)
        run = _behind(run[: len(words) - length + 1], sizes[last] + 1) ^ after[last]
        inside = document[: len(run)] == document[last]
        found.append((run[inside] % buckets).astype(np.int64))
        texts_of.append(document[: len(run)][inside])
        if not len(run):
            break
    return found, texts_of


def _blocks(batches):
    """(batch, texts of a part of its rows as bytes); every row is in one part."""
    import pyarrow as pa

    for batch in batches:
        column = batch.column("text").cast(pa.binary())
        low, held, texts = 0, 0, []
        for high, text in enumerate(column.to_pylist(), 1):
            texts.append(text or b"")
            held += len(texts[-1])
            if held >= _BLOCK or high == batch.num_rows:
                yield batch.slice(low, high - low), texts
                low, held, texts = high, 0, []


def count_buckets(texts: DataFrame, how: Resampling = Resampling()) -> np.ndarray:
    """How many features of all texts of the column `text` fall into each bucket. At most `buckets` rows reach the driver."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(how.buckets, np.int64)
        for _, block in _blocks(batches):
            for buckets in _features(block, how.order, how.buckets)[0]:
                total += np.bincount(buckets, minlength=how.buckets)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    counted = texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(how.buckets, np.int64)
    for bucket, n in counted.collect():
        found[bucket] = n
    return found


def gains(documents: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    s, t = documents.astype(float), targets.astype(float)
    size = len(s)
    ratio = (t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(rows: DataFrame, gain: np.ndarray, how: Resampling = Resampling()) -> DataFrame:
    """`rows` without their column `text` but with `n_words`, `n_features` and `weight`, the floored mean gain."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches):
        import pyarrow as pa

        for batch, texts in _blocks(batches):
            found, documents = _features(texts, how.order, how.buckets)
            words = np.bincount(documents[0], minlength=len(texts))
            features = sum(np.bincount(d, minlength=len(texts)) for d in documents)
            # Sums of whole numbers, exact in doubles below 2**53.
            total = sum(np.bincount(d, gain[b], minlength=len(texts)) for b, d in zip(found, documents)).astype(np.int64)
            columns = [*(batch.column(c) for c in others), *map(pa.array, (words, features, total // np.maximum(features, 1)))]
            yield pa.record_batch(columns, names=[*others, "n_words", "n_features", "weight"])

    kept = rows.select(*others).schema
    for name in ("n_words", "n_features", "weight"):
        kept = kept.add(name, T.LongType())
    return rows.mapInArrow(run, kept)


def noise(key: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate that only seed and key decide, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _ranked(rows: DataFrame, targets: DataFrame, how: Resampling) -> tuple[DataFrame, DataFrame]:
    """The stored weighed rows with `score` and `place`, and (place, rank) of those that are drawn."""
    gain = gains(count_buckets(rows, how), count_buckets(targets, how))
    scored = weigh(rows, gain, how).withColumn("score", F.col("weight") + noise(F.col("key"), how.seed))
    # Written with the rows, so that the places stay the same whenever they are read.
    scored = store(scored.withColumn("place", F.monotonically_increasing_id()))
    able = scored.where(F.col("n_words") >= how.least_words)
    wanted = able.count() * how.percent // 100
    order = able.select((-F.col("score")).alias("less"), "key", "n_features", "place")
    numbered = number_rows(order, ["less", "key", "n_features", "place"], "before")
    return scored, numbered.where(F.col("before") < wanted).select("place", (F.col("before") + 1).alias("rank"))


def resample(rows: DataFrame, targets: DataFrame, how: Resampling = Resampling()) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) for rows (key, text); NULL ranks are not drawn.

    `targets` has a column `text`. Every row comes back, so rows that share a key each have their own line.
    """
    scored, drawn = _ranked(rows.select("key", "text"), targets, how)
    return scored.join(drawn, "place", "left").drop("place")


def draw(docs: DataFrame, targets: DataFrame, how: Resampling = Resampling(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that the resampling draws, with all their columns; `targets` has a column `text`."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    scored, drawn = _ranked(rows, targets, how)
    return scored.join(drawn.select("place"), "place", "left_semi").select("row.*")


def oracle(how: Resampling = Resampling()) -> str:
    """SQL for the rows of `resample` over documents and benchmark, for runs of up to two words."""
    words = (
        "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )
    runs = "list_concat(a, list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]))"
    return f"""
WITH step AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {_POLYNOMIAL}::BIGINT) ELSE c >> 1 END) AS v
    FROM range(256) r(i))
), d AS (SELECT doc_id, {words} AS a FROM documents
), b AS (SELECT {words} AS a FROM benchmark
), df AS (SELECT doc_id, unnest({runs}) AS f FROM d
), bf AS (SELECT unnest({runs}) AS f FROM b
), u AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf)
), c AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
                            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % {how.buckets} AS bucket
  FROM u, step
), s AS (SELECT bucket, count(*)::DOUBLE AS s FROM df JOIN c USING (f) GROUP BY bucket
), t AS (SELECT bucket, count(*)::DOUBLE AS t FROM bf JOIN c USING (f) GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + {how.buckets})
                                 / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + {how.buckets})))) AS gain
  FROM s LEFT JOIN t USING (bucket)
), m AS (SELECT doc_id, count(*) AS n, floor(sum(gain) / count(*)) AS w FROM df JOIN c USING (f) JOIN g USING (bucket) GROUP BY doc_id
), w AS (
  SELECT doc_id, len(a) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(w, 0)::BIGINT AS weight,
         (coalesce(w, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{how.seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                / 4294967296::DOUBLE))))::BIGINT AS score
  FROM d LEFT JOIN m USING (doc_id)
), r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able
  FROM w WHERE words >= {how.least_words}
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= able * {how.percent} // 100 THEN rank END AS rank
FROM w LEFT JOIN r USING (doc_id)
"""
