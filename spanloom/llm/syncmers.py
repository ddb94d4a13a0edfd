"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the smallest of its inner s-mers is the first or the last of them. That depends
on the k-mer alone, so equal passages have equal anchors wherever they stand. A fingerprint is the sequence of anchors of
the whole text: 24 bits of the hash of each k-mer, a bit that marks its scale, and the gap to the anchor before in seven
(anchors are at most k - s apart), four bytes per anchor in base64. Every text has the anchors of two scales, as few of
the coarse one would survive an edit of a short text; a text that has no anchor has one of the finer scale, itself. Two fingerprints are matched by position: the n-th occurrence of a hash meets the n-th in the other, and the longest
sequence of matches in the order of both counts. If only one of them has the finer scale, the anchors of the other count.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.chunks import code_points, sliding_min, span_hashes
from spanloom.llm.common import ids_of

# (k, s) of the two scales; every text has the anchors of both.
SCALES = ((32, 10), (12, 4))
# The bit of an anchor that marks the finer scale, and the largest gap beside it.
FINE, MOST_GAP = 0x80, 0x7F
# Rows of a part of the key range, and the most parts, whose bounds and first keys are known to the driver.
PART_ROWS, MOST_PARTS = 2_048, 8_192
RESULT = (
    "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double"
)


def fingerprint(text: str) -> bytes:
    """The anchors of a text in its order; empty for an empty text."""
    n = len(text)
    if not n:
        return b""
    points = code_points(text)
    places, hashes, marks = [], [], []
    for mark, (k, s) in zip((0, FINE), SCALES):
        if n < k:
            continue
        heads = np.arange(n - s + 1)
        inner = span_hashes(points, heads, heads + s)
        least = sliding_min(inner, k - s + 1)
        at = np.flatnonzero((inner[: n - k + 1] == least) | (inner[k - s :] == least))
        places.append(at)
        hashes.append(span_hashes(points, at, at + k))
        marks.append(np.full(len(at), mark, np.uint32))
    if not sum(map(len, places)):
        places, hashes = [np.zeros(1, np.int64)], [span_hashes(points, np.zeros(1, np.int64), np.array([n]))]
        marks = [np.full(1, FINE, np.uint32)]
    at, hashes, marked = np.concatenate(places), np.concatenate(hashes), np.concatenate(marks)
    if len(places) > 1:
        order = np.argsort(at, kind="stable")
        at, hashes, marked = at[order], hashes[order], marked[order]
    packed = (hashes >> np.uint64(40)).astype("<u4") << np.uint32(8)
    return (packed | marked | np.minimum(np.diff(at, prepend=0), MOST_GAP).astype("<u4")).astype("<u4").tobytes()


def _numbered(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of the anchors by ascending key: hash and scale of an anchor and how often they came before."""
    hashes = (anchors >> np.uint32(7)).astype(np.int64)  # the hash and the mark, without the gap
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    starts = np.flatnonzero(np.diff(ranked, prepend=-1))
    nth = np.arange(len(ranked)) - np.repeat(starts, np.diff(np.append(starts, len(ranked))))
    return (ranked << 32) | nth, order


def likeness(a: bytes, b: bytes) -> float:
    """Twice the matched anchors over all anchors of both, of the scales that both have.

    1 for equal fingerprints, 0 without a match.
    """
    if a == b:
        return 1.0
    one, two = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    fine_one, fine_two = (one & FINE) > 0, (two & FINE) > 0
    if fine_one.any() != fine_two.any():
        one, two = one[~fine_one], two[~fine_two]
    if not len(one) or not len(two):
        return 0.0
    (ka, pa), (kb, pb) = _numbered(one), _numbered(two)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    places = pb[ib][np.argsort(pa[ia])]
    if (np.diff(places) > 0).all():
        chain = len(places)
    else:
        tails: list[int] = []
        for place in places.tolist():
            at = bisect_left(tails, place)
            tails[at : at + 1] = [place]
        chain = len(tails)
    return 2 * chain / (len(ka) + len(kb))


def edited(text: str, following: str) -> str:
    """The text with its last quarter, rounded down, replaced by as much of the beginning of the following text."""
    change = len(text) // 4
    return text[: len(text) - change] + following[:change]


def fingerprints(rows: DataFrame) -> DataFrame:
    """RESULT with `key` for each of the rows (key, text), beside the edited text and the next document.

    The next document has the next larger key; after the last comes the first. NULL counts as empty. Rows without a key
    come last; equal keys follow each other in the order of a hash of their texts. A single row is followed by itself.
    """
    ids = ids_of(rows, "key")
    rows = rows.select(ids.own(F.col("key"), F.col("text")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    keys = rows.select("id", "tie")
    total = keys.count()
    parts = max(1, min(MOST_PARTS, total // PART_ROWS))
    # Bounds of the key range; at most MOST_PARTS numbers reach the driver, and as many first rows of a part.
    shares = [i / parts for i in range(1, parts)]
    bounds = keys.agg(F.percentile_approx("id", shares, 10 * MOST_PARTS)).first()[0] if shares and total else []
    limits = np.array(sorted(set(bounds or [])), np.int64)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            part = np.searchsorted(limits, batch.column("id").to_numpy(), side="right")
            yield pa.record_batch([pa.array(part.astype(np.int32)), *batch.columns], names=["part", *batch.schema.names])

    firsts = keys.mapInArrow(place, "part int, id bigint, tie bigint").groupBy("part").agg(F.min(F.struct("id", "tie")).alias("head"))
    heads = sorted((r.part, tuple(r.head)) for r in firsts.collect())
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}

    def deal(batches):
        """Each row to its part, and the first row of a part also to the end of the part before."""
        import pyarrow as pa

        names = ["part", "after", "id", "tie", "text"]
        for batch in place(batches):
            rows = zip(batch.column("id").to_pylist(), batch.column("tie").to_pylist())
            again = [(i, before[row]) for i, row in enumerate(rows) if row in before]
            own = [batch.column("part"), pa.array(np.zeros(batch.num_rows, bool)), *(batch.column(n) for n in names[2:])]
            yield pa.record_batch(own, names=names)
            if again:
                copies = batch.take(pa.array([i for i, _ in again]))
                moved = [pa.array([p for _, p in again], pa.int32()), pa.array(np.ones(len(again), bool))]
                yield pa.record_batch([*moved, *(copies.column(n) for n in names[2:])], names=names)

    dealt = rows.select("id", "tie", "text").mapInArrow(deal, "part int, after boolean, id bigint, tie bigint, text string")
    dealt = dealt.repartition("part").sortWithinPartitions("part", "after", "id", "tie", "text")

    def run(batches):
        import pyarrow as pa

        kind = pa.schema([
            ("id", pa.int64()), ("n_chars", pa.int64()), *[(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")],
            ("near_edited", pa.float64()), ("near_next", pa.float64()),
        ])
        held = None
        for batch in batches:
            found = []
            for part, after, key, text in zip(*(batch.column(n).to_pylist() for n in ("part", "after", "id", "text"))):
                if held and held[0] != part:
                    held = None
                if after and not held:
                    continue
                anchors = fingerprint(text)
                if held:
                    _, old_key, old, old_anchors = held
                    new = edited(old, text)
                    new_anchors = fingerprint(new)
                    found.append((
                        old_key, len(old), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
                        base64.b64encode(old_anchors).decode(), base64.b64encode(new_anchors).decode(),
                        likeness(old_anchors, new_anchors), likeness(old_anchors, anchors),
                    ))
                held = None if after else (part, key, text, anchors)
            if found:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*found), kind)], schema=kind)

    return dealt.mapInArrow(run, RESULT).withColumn("key", ids.given(F.col("id"))).drop("id")
