"""Substring deduplication by content-defined chunks.

A gear hash rolls over the code points: it doubles and adds a fixed random value of the next code point, in 16 bits, so
it depends on the last 16 of them. A chunk ends where the hash is the smallest within `REACH` places on both sides.
Cuts depend on nearby text only, so an insertion moves no cut beyond it, and a passage that two documents share is cut
alike in both but for its first and last chunk. But for the ends of a text,
chunks have between REACH + 1 and some hundred code points, 33 on average.

A chunk is a copy if a document with a smaller key has a chunk of the same digest. A run of copies is an anchor: at both
ends it is extended exactly, code point by code point, over the text that it shares with the documents that hold its
digests first. The whole shared span is judged: with `LEAST_WORDS` words it is taken out, to whole words; shorter ones are
common phrases and stay. In scripts without blanks, `WORD_POINTS` code points count as a word, and a span may end anywhere.
The text beyond a run is shared no further than its next chunk and `WINDOW + REACH` code points, or that chunk were a copy
too; so only that much of it goes to the document it is compared with.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import own_id
from spanloom.llm.shingles import mix64
from spanloom.session import store
from spanloom.skew import HOT_NARROW_ROWS, lookup

WINDOW, REACH = 16, 16
LEAST_WORDS = 25
# Scripts without blanks between words (Thai to Myanmar, Khmer, kana, Chinese), and their code points that count as a word.
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
WORD_POINTS = 4
# Runs that are compared with one copy of the text of their document.
RUN_ROWS = 512
_GEAR = (mix64(np.arange(1, (1 << 16) + 1, dtype=np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _powers(size: int) -> list[np.ndarray]:
    """Powers of the base of the digests and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < size:
        grown = []
        for base in (_BASE, _INVERSE):
            steps = np.full(max(size, 1 << 16), base, np.uint64)
            steps[0] = 1
            grown.append(np.multiply.accumulate(steps))
        _POWERS[:] = grown
    return _POWERS


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values, by doubling."""
    have, low = 1, values
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[: len(values) - width + 1], low[width - have :]) if have < width else low


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each span of the points: a polynomial of its points from running sums, scrambled."""
    up, down = _powers(len(points) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], dtype=np.uint64)))
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def cuts(points: np.ndarray) -> np.ndarray:
    """The ends of the chunks, the last of which is the end of the text."""
    n = len(points)
    if n == 0:
        return np.empty(0, np.int64)
    gear = _GEAR[points & 0xFFFF]
    rolled = gear.copy()
    for back in range(1, min(WINDOW, n)):
        rolled[back:] += gear[:-back] << np.uint16(back)
    # Ties go to the last place, as text of one repeated character has them everywhere.
    wide = np.full(n + 2 * REACH, np.iinfo(np.uint16).max, np.uint16)
    wide[REACH : REACH + n] = rolled
    before, after = sliding_min(wide[: n + REACH - 1], REACH)[:n], sliding_min(wide[REACH + 1 :], REACH)[:n]
    found = np.flatnonzero((rolled <= before) & (rolled < after)) + 1
    return found if len(found) and found[-1] == n else np.append(found, n)


def chunk_digests(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(ends, digests) of the chunks of a text."""
    points = code_points(text)
    ends = cuts(points)
    if not len(ends):
        return ends, np.empty(0, np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    return ends, span_hashes(points, starts, ends).view(np.int64)


def copied_runs(ends: np.ndarray, digests: np.ndarray, copied) -> list[tuple[int, int]]:
    """(first, last) of the runs of chunks whose digests are in `copied`; the last is not part of it."""
    marked = np.fromiter((d in copied for d in digests.tolist()), bool, len(digests))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marked.astype(np.int8), [0]))))
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist()))


def word_count(text: str) -> int:
    """Runs without white space, where `WORD_POINTS` code points of a script without blanks count as one."""
    return sum(max(1, len(UNSPACED.findall(word)) // WORD_POINTS) for word in text.split())


def spans_to_cut(text: str, shared: list[tuple[int, int]], least_words: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """The spans of a text to take out: unions of its shared spans with enough words, to whole words."""
    merged: list[list[int]] = []
    for start, end in sorted(shared):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    blank = lambda at: text[at].isspace()
    alone = lambda at: UNSPACED.match(text[at]) is not None
    found = []
    for start, end in merged:
        # A word that only begins or ends inside stays.
        while 0 < start < end and not (blank(start - 1) or alone(start - 1)):
            start += 1
        while start < end < len(text) and not (blank(end - 1) or blank(end) or alone(end - 1) or alone(end)):
            end -= 1
        if word_count(text[start:end]) >= least_words:
            found.append((start, end))
    return found


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def copied_digests(rows: DataFrame) -> DataFrame:
    """(id, copied): the digests of those chunks of rows (id, text) that a smaller id has too, and the smallest such id.

    One row per id with any.
    """

    def digests(batches):
        import pyarrow as pa

        for batch in batches:
            ids, values = batch.column("id").to_numpy(), []
            for text in batch.column("text").to_pylist():
                values.append(np.unique(chunk_digests(text or "")[1]))
            if values:
                owners = np.repeat(ids, [len(v) for v in values])
                yield pa.record_batch([pa.array(owners), pa.array(np.concatenate(values), pa.int64())], names=["id", "digest"])

    chunks = rows.select("id", "text").mapInArrow(digests, "id bigint, digest bigint")
    first = chunks.groupBy("digest").agg(
        F.min("id").alias("first"), F.max("id").alias("_last"), F.count(F.lit(1)).alias("_rows")
    ).where(F.col("first") != F.col("_last")).drop("_last")
    shared = lookup(chunks, store(first), "digest", "_rows", hot_rows=HOT_NARROW_ROWS).where(F.col("id") != F.col("first"))
    # As many digests as the document has chunks at most.
    return shared.groupBy("id").agg(F.collect_set(F.struct("digest", "first")).alias("copied"))


RUN = "id bigint, tie bigint, start bigint, end bigint, first bigint, head bigint, tail bigint, before string, after string"


def runs_of(rows: DataFrame) -> DataFrame:
    """RUN of rows (id, tie, text, copied): the runs of copies of each text.

    Each run has a row without `first`, and one for each document that holds one of its digests first and may share more
    of the text beside it: the digests of its first and last chunk, and the text before and after it.
    """
    beyond = WINDOW + REACH

    def run(batches):
        import pyarrow as pa

        kind = pa.schema([
            *[(n, pa.int64()) for n in ("id", "tie", "start", "end", "first", "head", "tail")], ("before", pa.string()), ("after", pa.string()),
        ])
        for batch in batches:
            found = []
            for key, tie, text, copied in zip(*(batch.column(n).to_pylist() for n in ("id", "tie", "text", "copied"))):
                owner = {c["digest"]: c["first"] for c in copied}
                ends, digests = chunk_digests(text or "")
                for low, high in copied_runs(ends, digests, owner):
                    start, end = int(ends[low - 1]) if low else 0, int(ends[high - 1])
                    found.append((key, tie, start, end, None, None, None, None, None))
                    before = text[max(0, (int(ends[low - 2]) if low > 1 else 0) - beyond) : start]
                    after = text[end : int(ends[min(high, len(ends) - 1)]) + beyond]
                    if before or after:
                        edges = int(digests[low]), int(digests[high - 1])
                        owners = {owner[d] for d in digests[low:high].tolist()}
                        found += [(key, tie, start, end, first, *edges, before, after) for first in owners]
            columns = zip(*found) if found else [()] * len(kind)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

    return rows.mapInArrow(run, RUN)


def extended(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, tie, start, end): the runs with a `first`, with what they share beyond with that document of rows (id, text).

    Each text comes before the runs that are compared with it; many of them are split into several groups.
    """
    counts = runs.groupBy("first").agg(F.count(F.lit(1)).alias("_rows"))
    counts = store(counts.withColumn("salts", F.ceil(F.col("_rows") / RUN_ROWS).cast("int")))
    dealt = lookup(runs, counts, "first", "_rows", hot_rows=HOT_NARROW_ROWS)
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("id", "start"), F.col("salts")).cast("int")).drop("salts")
    heads = counts.select("first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    heads = heads.join(rows.select(F.col("id").alias("first"), "text"), "first")
    together = dealt.withColumn("text", F.lit(None).cast("string")).unionByName(heads, allowMissingColumns=True)
    together = together.repartition("first", "salt").sortWithinPartitions("first", "salt", F.asc_nulls_first("id"))

    def run(batches):
        import pyarrow as pa

        at, texts = None, []
        names = ["first", "salt", "id", "tie", "start", "end", "head", "tail", "before", "after", "text"]
        for batch in batches:
            found = []
            for first, salt, key, tie, start, end, head, tail, before, after, text in zip(*(batch.column(n).to_pylist() for n in names)):
                if key is None:
                    texts = texts if (first, salt) == at else []
                    at = (first, salt)
                    ends, digests = chunk_digests(text or "")
                    places: dict[int, list[int]] = {}
                    for number, digest in enumerate(digests.tolist()):
                        places.setdefault(digest, []).append(number)
                    texts = [*texts, (code_points(text or ""), ends, places)]
                    continue
                left, right = code_points(before)[::-1], code_points(after)
                lower = upper = 0
                for points, ends, places in texts:
                    for number in places.get(head, ()):
                        here = int(ends[number - 1]) if number else 0
                        lower = max(lower, common_length(left, points[max(0, here - len(left)) : here][::-1]))
                    for number in places.get(tail, ()):
                        here = int(ends[number])
                        upper = max(upper, common_length(right, points[here : here + len(right)]))
                if lower or upper:
                    found.append((key, tie, start - lower, end + upper))
            columns = zip(*found) if found else [()] * 4
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["id", "tie", "start", "end"])

    return together.mapInArrow(run, "id bigint, tie bigint, start bigint, end bigint")


def shared_spans(rows: DataFrame) -> DataFrame:
    """(id, tie, shared): the spans of rows (id, tie, text) that documents with smaller ids have, one row per text with any."""
    runs = store(runs_of(rows.select("id", "tie", "text").join(copied_digests(rows), "id")))
    spans = runs.where(F.col("first").isNull()).select("id", "tie", "start", "end")
    spans = spans.unionByName(extended(runs.where(F.col("first").isNotNull()), rows))
    # As many spans as the text has chunks and owners of them at most.
    return spans.groupBy("id", "tie").agg(F.collect_set(F.struct("start", "end")).alias("shared"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """`docs` without the passages that a document with a smaller key has; adds removed_chars and spans.

    `spans` are the code points that were taken out of the given text. NULL and empty texts stay as they are. A row
    without a key comes after all others; rows that share a key count as one document, so neither is cut for the other.
    All columns are kept; of those, only ones named like an added one are replaced.
    """
    docs = docs.drop("removed_chars", "spans")
    rows = docs.select(
        own_id(F.col(key), F.col(text)).alias("id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"), F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    )
    joined = rows.join(shared_spans(rows), ["id", "tie"], "left").select("text", "shared", "row")
    spans = "array<struct<start: bigint, end: bigint>>"
    kind = f"text string, removed_chars bigint, spans {spans}, row {rows.schema['row'].dataType.simpleString()}"

    def cut(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts, removed, spans = [], [], []
            for old, shared in zip(batch.column("text").to_pylist(), batch.column("shared").to_pylist()):
                found = spans_to_cut(old, [(s["start"], s["end"]) for s in shared], least_words) if old and shared else []
                ends = [0, *(e for _, e in found)]
                texts.append("".join(old[a:b] for a, b in zip(ends, [*(s for s, _ in found), len(old)])) if found else old)
                removed.append(sum(e - s for s, e in found))
                spans.append([{"start": s, "end": e} for s, e in found])
            columns = [pa.array(texts, pa.string()), pa.array(removed, pa.int64()), pa.array(spans, span), batch.column("row")]
            yield pa.record_batch(columns, names=["text", "removed_chars", "spans", "row"])

    done = joined.mapInArrow(cut, kind)
    columns = [F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    return done.select(*columns, "removed_chars", "spans")
