"""Best-fit packing with vector capacities: tokens, documents and attention cost of a sequence.

Documents are encoded, cut into pieces of at most a sequence and packed. The pieces are dealt into groups of bounded
size by a hash, so each group has the length mix of the whole; a group is packed by descending length in one task. A
piece goes into the open sequence that it fits under every capacity and that scores best: the smallest weighted norm of
what is left ("norm"), or the largest weighted dot product of the piece and what is left ("dot"). At most one sequence
per group is left underfilled by the dealing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.records import END_ID
from spanloom.llm.tokens import CACHE_PIECES, ID_BYTES, encoder, gathered
from spanloom.session import store

PIECES = "key bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"
# Pieces that one task packs.
GROUP_PIECES = 16_384


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds at most. Attention cost is the sum of the squared lengths of its pieces."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    score: str = "norm"


def cut_pieces(rows: DataFrame, path: str, tokens: int, end_id: int = END_ID, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """Pieces of rows (key, text): the ids of the whole text and the end id; a NULL text counts as empty.

    Only sequences of more than `tokens` ids are cut; the last piece may be shorter. The ids stay in the task.
    """

    def run(batches):
        import struct
        import zlib

        import pyarrow as pa

        step, end, known = tokens * ID_BYTES, struct.pack("<I", end_id), encoder(path, cache_pieces)
        for batch in gathered(batches, "text"):
            rows = []
            found = known.encode_all([text or "" for text in batch.column("text").to_pylist()])
            for key, ids in zip(batch.column("key").to_pylist(), found):
                payload = ids + end
                for number, at in enumerate(range(0, len(payload), step)):
                    part = payload[at : at + step]
                    rows.append((key, number, at // ID_BYTES, len(part) // ID_BYTES, zlib.crc32(part)))
            names, kinds = ["key", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), *[pa.int64()] * 3]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return rows.select("key", "text").mapInArrow(run, PIECES)


def best_fit(lengths, capacity: Capacity) -> tuple[list[int], list[int], int]:
    """(bin, offset) of each of the lengths, which must be descending and fit an empty sequence; and the number of bins."""
    import numpy as np

    full = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weight = np.array(capacity.weights, float)
    size = max(64, len(lengths))
    left = np.empty((size, 3))
    ids, bins, offsets = np.empty(size, np.int64), [], []
    opened = live = 0
    shortest = min(lengths, default=0)
    least = np.array([shortest, 1, shortest * shortest], float)
    for n, length in enumerate(lengths):
        need = np.array([length, 1.0, float(length) * length])
        open_now = left[:live]
        fits = (open_now >= need).all(axis=1)
        if fits.any():
            if capacity.score == "dot":
                score = -((open_now / full) * (need / full) * weight).sum(axis=1)
            else:
                score = (((open_now - need) / full) ** 2 * weight).sum(axis=1)
            at = int(np.argmin(np.where(fits, score, np.inf)))
        else:
            at, live = live, live + 1
            left[at], ids[at] = full, opened
            opened += 1
        bins.append(int(ids[at]))
        offsets.append(int(capacity.tokens - left[at, 0]))
        left[at] -= need
        if (left[at] < least).any():
            # Nothing that is still to come fits here; the order of the others is kept, as ties go to the oldest.
            left[at : live - 1], ids[at : live - 1] = left[at + 1 : live].copy(), ids[at + 1 : live].copy()
            live -= 1
    return bins, offsets, opened


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), group_pieces: int = GROUP_PIECES) -> DataFrame:
    """PIECES with the sequence of each and its place there. A piece must fit an empty sequence."""
    pieces = store(pieces)
    # Only the number of groups is taken to the driver.
    groups = max(1, -(-pieces.count() // group_pieces))
    # Pieces without a key may be many and alike; their place in the stored table tells them apart.
    place = F.when(F.col("key").isNull(), F.monotonically_increasing_id())
    dealt = pieces.withColumn("_place", place)
    dealt = dealt.withColumn("_group", F.pmod(F.xxhash64("key", "_place", "piece", "ids_crc32"), F.lit(groups))).drop("_place")
    ordered = dealt.repartition(groups, "_group").sortWithinPartitions(
        "_group", F.desc("length"), "key", "piece", "ids_crc32"
    )

    def run(batches):
        import pyarrow as pa

        names = ["key", "piece", "start", "length", "ids_crc32"]
        kind = pa.schema([
            ("key", pa.int64()), ("piece", pa.int32()), *[(n, pa.int64()) for n in (*names[2:], "sequence_id", "offset")],
        ])

        def packed(group, parts):
            rows = pa.Table.from_batches(parts)
            bins, offsets, _ = best_fit(rows.column("length").to_pylist(), capacity)
            # A group has fewer sequences than this, as it has fewer pieces.
            ids = [group * (1 << 32) + b for b in bins]
            columns = [rows.column(n).combine_chunks() for n in names]
            return pa.Table.from_arrays([*columns, pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], schema=kind).to_batches()

        at, parts = None, []
        for batch in batches:
            import numpy as np

            group = batch.column("_group").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if group[low] != at and parts:
                    yield from packed(at, parts)
                    parts = []
                at = int(group[low])
                parts.append(batch.slice(low, high - low))
        if parts:
            yield from packed(at, parts)

    return ordered.mapInArrow(run, PACKED)


def pack_texts(
    rows: DataFrame, path: str, capacity: Capacity = Capacity(), cache_pieces: int = CACHE_PIECES
) -> DataFrame:
    """PACKED for rows (key, text): encode by the tokenizer file, end each text with id 0, cut and pack."""
    return pack(cut_pieces(rows, path, capacity.tokens, cache_pieces=cache_pieces), capacity)
