"""Benchmark decontamination: find word windows of test items in training texts, with DataFrame functions only.

A window is `size` consecutive words of an item; an item of fewer words, but not none, is one window. The distinct windows
form a hash set: 64-bit key, number of words, the words, and the items that hold them. It is broadcast, in parts of
bounded and measured size if it is large. Texts are scanned in place: each word position of a text gives the key of the
window that starts there (one for each number of words that windows have), and a position stays only if the set holds
the key and the words themselves are equal. One position of each text stays in any case, so one pass gives all texts, and
one shuffle of a row per text and hit brings the hits of a text together. Hits of a text are bounded by its words.

Defined cases: a NULL or empty text has no words and no hits. Rows that share an id, or are equal, are judged one by one.
Items that share an id count as one, items without an id as one that is named by an empty string. Items without words
are ignored; an empty benchmark finds nothing, an empty table gives no rows. Extra columns are kept by `decontaminate`,
whatever their names. A text of any length is one row; its words are held once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.session import store

SIZE = 10
# Fixed value: what a word is not made of, after A-Z are lower-cased.
GAP = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
# The same where A-Z stand.
_RAW_GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The largest part of the hash set that is broadcast at once.
PART_WINDOWS, PART_BYTES = 1_000_000, 128 << 20


def words(text: Column) -> Column:
    """The words of a text, A-Z as lower case."""
    # In ASCII texts `lower` changes nothing but A-Z, and is much faster.
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(F.coalesce(plain, F.lit("")), F.lit(f"[^{GAP}]+"), F.lit(0))


def _key(held: Column, at: Column, length: int) -> Column:
    """The hash of the `length` words from place `at` on; NULL if there are not so many."""
    parts = [F.get(held, at + k) for k in range(length)]
    return F.when(at + length <= F.size(held), F.xxhash64(*parts))


def windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """(key, length, words, items): the distinct windows of items (item, text), and the ids of their items in order."""
    held = items.select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
    held = held.where(F.size("w") > 0).withColumn("length", F.least(F.size("w"), F.lit(size)))
    each = held.select("item", "length", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("length"))).alias("at"))
    cut = each.select("item", "length", F.slice("w", F.col("at") + 1, F.col("length")).alias("words"))
    found = cut.groupBy("words", "length").agg(F.array_sort(F.collect_set("item")).alias("items"))
    key = reduce(
        lambda so_far, n: F.when(F.col("length") == n, _key(F.col("words"), F.lit(0), n)).otherwise(so_far),
        range(1, size + 1), F.lit(None).cast("bigint"),
    )
    return found.select(key.alias("key"), "length", "words", "items")


def _parts(found: DataFrame, part_windows: int, part_bytes: int) -> list[DataFrame]:
    """The stored windows in as many parts as keep each below the bounds, of rows and of bytes as measured."""
    size = sum((F.octet_length(F.array_join(c, " ")) for c in ("words", "items")), F.lit(64))
    rows, octets = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()
    # Keys are spread evenly, so parts of half the bound keep to it.
    parts = 1 if rows <= part_windows and octets <= part_bytes else -(-2 * max(rows * part_bytes, octets * part_windows) // (part_windows * part_bytes))
    return [found] if parts == 1 else [found.where(F.pmod("key", F.lit(parts)) == n) for n in range(parts)]


def scan(
    docs: DataFrame, items: DataFrame, text: str = "text", size: int = SIZE,
    part_windows: int = PART_WINDOWS, part_bytes: int = PART_BYTES, carry: tuple[str, ...] = (),
) -> DataFrame:
    """(row, n_words, hits, items) for each row of `docs`, of which `row` holds the columns `carry`, or else all.

    `hits` are the distinct (at, length) of found windows in order, `items` the sorted ids of the items that hold them.
    `items`, the table, has (item, text).
    """
    found = store(windows(items, size))
    # At most `size` numbers.
    lengths = sorted(r.length for r in found.select("length").distinct().collect())
    parts = _parts(found, part_windows, part_bytes)
    held = docs.select(F.struct(*(carry or docs.columns)).alias("row"), words(F.col(text)).alias("w"))
    numbered = held.withColumn("id", F.monotonically_increasing_id())
    if len(parts) > 1:
        # Read once for each part, so the ids must be the same each time.
        numbered = store(numbered)
    placed = numbered.select("id", "row", "w", F.posexplode_outer("w").alias("at", "_"))
    if len(lengths) > 1:
        placed = placed.withColumn("length", F.explode(F.array(*map(F.lit, lengths))))
    else:
        placed = placed.withColumn("length", F.lit(lengths[0] if lengths else size))
    at = F.col("at")
    key = reduce(
        lambda so_far, n: F.when(F.col("length") == n, _key(F.col("w"), at, n)).otherwise(so_far), lengths, F.lit(None).cast("bigint")
    )
    placed = placed.withColumn("key", key)
    met = []
    for number, part in enumerate(parts):
        known = part.select(F.col("key").alias("_key"), F.col("length").alias("_n"), F.col("words").alias("_words"), F.col("items").alias("_items"))
        # Verified behind the join, so that it looks up single numbers.
        hit = F.coalesce((F.col("length") == F.col("_n")) & (F.slice("w", at + 1, F.col("length")) == F.col("_words")), F.lit(False))
        # The first position of a text stands for the text.
        first = (F.coalesce(at, F.lit(0)) == 0) & (F.col("length") == (lengths[0] if lengths else size)) & F.lit(number == 0)
        joined = placed.join(F.broadcast(known), F.col("key") == F.col("_key"), "left").where(hit | first)
        met.append(joined.select(
            "id", F.when(first, F.col("row")).alias("row"), F.when(first, F.size("w")).alias("n_words"),
            F.when(hit, F.struct(at.alias("at"), F.col("length").alias("length"))).alias("hit"), F.when(hit, F.col("_items")).alias("_items"),
        ))
    together = reduce(DataFrame.unionByName, met)
    return together.groupBy("id").agg(
        F.first("row", ignorenulls=True).alias("row"), F.max("n_words").cast("bigint").alias("n_words"),
        F.array_sort(F.collect_list("hit")).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("items"),
    ).drop("id")


def covered(hits: Column) -> Column:
    """The number of words inside any of the hits, which are in order."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def add(so_far: Column, hit: Column) -> Column:
        end = F.greatest(so_far["end"], hit["at"] + hit["length"])
        fresh = end - F.greatest(so_far["end"], hit["at"])
        return F.struct(end.alias("end"), (so_far["n"] + F.greatest(fresh, F.lit(0))).alias("n"))

    return F.aggregate(hits, start, add, lambda done: done["n"])


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(key, n_words, n_hit, n_items, items, contaminated) for each row of `docs`."""
    found = scan(docs, items, text, carry=(key,), **how)
    n_hit = covered(F.col("hits"))
    return found.select(
        F.col("row")[key].alias("key"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), "items",
        (F.size("hits") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "spans", text: str = "text", **how) -> DataFrame:
    """`docs` without the found words and what follows each of them up to the next word, or without the documents.

    Texts without a hit stay as they are; so does a NULL text.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is 'spans' or 'documents', not {remove!r}")
    found = scan(docs, items, text, **how)
    if remove == "documents":
        return found.where(F.size("hits") == 0).select("row.*")
    value = F.col("row")[text]
    lead = F.regexp_extract(value, f"^[{_RAW_GAP}]+", 0)
    pieces = F.regexp_extract_all(value, F.lit(f"[^{_RAW_GAP}]+[{_RAW_GAP}]*"), F.lit(0))
    hit = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["length"] - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), hit)
    left = F.concat(lead, F.array_join(F.transform(kept, lambda i: F.get(pieces, i)), ""))
    cleaned = F.when(F.size("hits") > 0, left).otherwise(value)
    return found.select(*[(cleaned if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def oracle(size: int = SIZE) -> str:
    """SQL for the report over documents and benchmark."""
    cut = (
        "regexp_extract_all(translate(coalesce(text, ''), "
        f"'{_UPPER}', '{_LOWER}'), '[^{GAP}]+')"
    )
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS id, {cut} AS w FROM documents
), b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {cut} AS w FROM benchmark
), n AS (SELECT item, w, least(len(w), {size}) AS n FROM b WHERE len(w) > 0
), s AS (SELECT item, n, w, unnest(range(0, len(w) - n + 1)) AS i FROM n
), k AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(w[i + 1:i + n], ' ') AS t FROM s
), p AS (SELECT id, n, unnest(range(0, len(w) - n + 1)) AS i, w FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n
), h AS MATERIALIZED (SELECT id, i, p.n, item FROM p JOIN k ON p.n = k.n AND array_to_string(w[i + 1:i + p.n], ' ') = t
), c AS (SELECT id, count(DISTINCT place) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT id, i, n FROM h)) GROUP BY id
), m AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM h) GROUP BY id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (id) LEFT JOIN m USING (id)
"""
