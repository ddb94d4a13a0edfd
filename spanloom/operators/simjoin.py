"""Exact nearest neighbours between two tables of vectors.

Scores are inner products in double precision, rounded to 6 decimals; equal scores go by the smaller id.
Two physical forms give the same rows:

- scan: one side is small in rows and bytes and is sent to all executors; the other is scanned in place;
- blocks: both sides are dealt into blocks by a hash of the id, each pair of blocks meets in one task, and
  only the best `k` of a row leave the task. No pair of rows is ever written out beyond that.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import plugins
from spanloom.session import BROADCAST_ROWS

# Bytes of one block of vectors in double precision, and cells of one slab of scores: what a task holds at once.
BLOCK_BYTES = 64 << 20
SLAB_CELLS = 4 << 20
# Bytes of a side that is sent to all executors, and entries that a task keeps for such a side.
SIDE_BYTES = 64 << 20
SIDE_ENTRIES = 8 << 20
# Rows from which on bounds are worth their extra pass.
BOUNDED_ROWS = 65_536
# Buckets that share the work of ranking the rows of one query.
RANK_BUCKETS = 32
# Texts that a task remembers as near to nothing, and the longest of them.
KNOWN_TEXTS, KNOWN_LENGTH = 1 << 18, 64
# Pairs that are multiplied out at once, and entries that are held before they are thinned out.
VERIFY_PAIRS, KEPT_FRESH = 2_048, 1 << 13

EDGES = "src bigint, dst bigint, sim double"
_EDGE_TYPE = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("sim", pa.float64())])
DECIMALS = 6
# A true score may lie this much below a rounded one.
MARGIN = 1e-6
_EMPTY = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _matrix(column) -> np.ndarray:
    """An Arrow list column as a matrix in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def _ids(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _best(src: np.ndarray, dst: np.ndarray, sim: np.ndarray, k: int):
    """The best `k` entries of each source."""
    order = np.lexsort((dst, -sim, src))
    src, dst, sim = src[order], dst[order], sim[order]
    keep = _ranks(src) < k
    return src[keep], dst[keep], sim[keep]


def _candidates(scores, src_ids, dst_ids, k, floor, earlier, others, margin=MARGIN):
    """Cells (row, column) of a matrix of scores that include the best `k` of each row.

    Few cells at the floor are taken as they are; many are thinned out by the k-th best score of their row. Scores may be
    off by `margin`.
    """
    height, width = scores.shape
    if floor is not None:
        passed = scores >= floor - margin
        if np.count_nonzero(passed) <= 4 * k * height:
            return np.nonzero(passed)
    if earlier:
        scores = np.where(dst_ids[None, :] >= src_ids[:, None], -np.inf, scores)
    wanted = k + 1 if others else k
    if wanted >= width:
        return np.nonzero(scores > -np.inf)
    cutoff = np.partition(scores, width - wanted, axis=1)[:, width - wanted, None] - 2 * margin
    if floor is not None:
        cutoff = np.maximum(cutoff, floor - margin)
    return np.nonzero((scores >= cutoff) & (scores > -np.inf))


def _edges(scores, row, col, src_ids, dst_ids, k, floor, above, earlier, others):
    """The best `k` of each source among the candidates, by rounded score and then id."""
    src, dst, sim = src_ids[row], dst_ids[col], np.round(scores[row, col], DECIMALS)
    keep = np.ones(len(src), bool) if floor is None else (sim > floor) if above else (sim >= floor)
    if earlier:
        keep &= dst < src
    elif others:
        keep &= dst != src
    return _best(src[keep], dst[keep], sim[keep], k)


def _top(left_ids, left, right_ids, right, k, floor=None, above=False, earlier=False, others=False, both=False):
    """The best `k` right rows of every left row, as (src, dst, sim); with `both` also the other way round."""
    forward, backward = [_EMPTY], [_EMPTY]
    if len(left_ids) and len(right_ids):
        height = max(1, SLAB_CELLS // len(right_ids))
        for at in range(0, len(left_ids), height):
            ids = left_ids[at : at + height]
            scores = left[at : at + height] @ right.T
            row, col = _candidates(scores, ids, right_ids, k, floor, earlier, others)
            forward.append(_edges(scores, row, col, ids, right_ids, k, floor, above, earlier, others))
            if both:
                turned = np.ascontiguousarray(scores.T)
                row, col = _candidates(turned, right_ids, ids, k, floor, earlier, others)
                backward.append(_edges(turned, row, col, right_ids, ids, k, floor, above, earlier, others))
    found = tuple(np.concatenate(parts) for parts in zip(*forward))
    return (found, _best(*(np.concatenate(parts) for parts in zip(*backward)), k)) if both else found


def _ranks(src: np.ndarray) -> np.ndarray:
    """0, 1, 2 … within each run of equal sources."""
    starts = np.flatnonzero(np.r_[True, src[1:] != src[:-1]]) if len(src) else np.zeros(0, int)
    return np.arange(len(src)) - np.repeat(starts, np.diff(np.r_[starts, len(src)]))


def _batch(found) -> pa.RecordBatch:
    src, dst, sim = found
    return pa.RecordBatch.from_arrays(
        [pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(sim, pa.float64())], schema=_EDGE_TYPE
    )


def _small(df: DataFrame, kept: int = 1):
    """Ids and matrix of a table that is small enough to be sent to all executors, else None.

    It is bounded in rows, in bytes of its vectors, and in the entries that a task keeps, `kept` for each row.
    """
    most = max(1, min(BROADCAST_ROWS, SIDE_BYTES // (8 * _dimensions(df)), SIDE_ENTRIES // max(1, kept)))
    if df.limit(most + 1).count() > most:
        return None
    found = df.toArrow()
    return _ids(found.column(0).combine_chunks()), _matrix(found.column(1))


def rank_best(edges: DataFrame, k: int) -> DataFrame:
    """The best `k` edges of each source with their `rank`.

    One source may have an edge from every task, so edges are ranked in buckets first and only the winners
    of the buckets meet.
    """
    best = [F.desc("sim"), F.asc("dst")]
    bucket = F.pmod(F.xxhash64("dst"), F.lit(RANK_BUCKETS))
    by_bucket = Window.partitionBy("src", "_bucket").orderBy(*best)
    by_source = Window.partitionBy("src").orderBy(*best)
    winners = (
        edges.withColumn("_bucket", bucket).withColumn("_rank", F.row_number().over(by_bucket)).where(F.col("_rank") <= k)
    )
    return winners.select("src", "dst", "sim", F.row_number().over(by_source).alias("rank")).where(F.col("rank") <= k)


def _slots(df: DataFrame) -> int:
    return max(2, df.sparkSession.sparkContext.defaultParallelism)


def _dimensions(df: DataFrame) -> int:
    first = df.limit(1).toArrow()
    return max(1, len(first.column(1)[0])) if first.num_rows else 1


def _block_rows(df: DataFrame) -> int:
    return max(1_024, BLOCK_BYTES // (8 * _dimensions(df)))


def nearest(
    left: DataFrame,
    right: DataFrame,
    k: int,
    *,
    floor: float | None = None,
    above: bool = False,
    earlier: bool = False,
    form: str = "auto",
    encoder: plugins.Encoder | None = None,
) -> DataFrame:
    """For each row of `left` the best `k` rows of `right`, as edges (src, dst, sim, rank).

    Both tables are (id, vector). `floor` is the lowest score that counts, or the one to exceed with `above`;
    `earlier` allows only right rows with a smaller id. With an `encoder` `right` is (id, text), and the vectors of the
    texts are made where they are compared, so that no vector travels.
    """
    left = left.where(F.col(left.columns[1]).isNotNull())
    if encoder is not None:
        side = _small(left, k) if form in ("auto", "scan") else None
        if side is not None:
            texts = right.where(F.col(right.columns[1]).isNotNull())
            return rank_best(_scan_right(side, texts, k, floor, above, earlier, encoder), k)
        vector = plugins.encode_column(F.col(right.columns[1]), encoder, once=True)
        right = right.select(right.columns[0], vector.alias(right.columns[1]))
    right = right.where(F.col(right.columns[1]).isNotNull())
    if form in ("auto", "scan"):
        side = _small(right)
        if side is not None:
            return _scan_left(left, side, k, floor, above, earlier)
        side = _small(left, k)
        if side is not None:
            return rank_best(_scan_right(side, right, k, floor, above, earlier), k)
    return rank_best(_blocks(left, right, k, floor, above, earlier), k)


def _scan_left(left, right_side, k, floor, above, earlier):
    """All of `right` is at hand, so each batch of `left` gives its final edges: no shuffle."""
    shared = left.sparkSession.sparkContext.broadcast(right_side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right_ids, right = shared.value
        for batch in batches:
            src, dst, sim = _top(
                _ids(batch.column(0)), _matrix(batch.column(1)), right_ids, right, k, floor, above, earlier
            )
            rank = _ranks(src) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(sim), pa.array(rank, pa.int32())],
                names=["src", "dst", "sim", "rank"],
            )

    return left.mapInArrow(run, EDGES + ", rank int")


class _Kept:
    """The best `k` of the rows that pass by, for each of a few rows at hand.

    Single precision tells which rows can still be among them; only those are multiplied out in double precision.
    """

    def __init__(self, ids, vecs, k, floor, above, earlier):
        self.ids, self.vecs, self.quick = ids, vecs, vecs.astype(np.float32)
        self.k, self.floor, self.above, self.earlier = k, floor, above, earlier
        self.longest = float(np.sqrt(np.einsum("ij,ij->i", vecs, vecs).max(initial=0.0)))
        self.bound = np.full(len(ids), -np.inf if floor is None else floor)
        self.found, self.fresh, self.held = _EMPTY, [], 0
        self.order = np.argsort(ids, kind="stable")

    def add(self, vecs: np.ndarray, ids: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Vectors, each of the rows `ids` between two of the `stops`, in order of id; which of them came near to be kept."""
        near = np.zeros(len(vecs), bool)
        height = max(1, SLAB_CELLS // max(1, len(self.ids)))
        for at in range(0, len(vecs), height):
            part = slice(at, at + height)
            near[part] = self._slab(vecs[part], ids, stops[at : at + height + 1])
        return near

    def _slab(self, vecs, ids, stops) -> np.ndarray:
        if not len(vecs) or not len(self.ids):
            return np.zeros(len(vecs), bool)
        exact = vecs.astype(np.float64)
        longest = self.longest * float(np.sqrt(np.einsum("ij,ij->i", exact, exact).max(initial=0.0)))
        if longest < 1e30:
            scores, slack = self.quick @ vecs.astype(np.float32).T, MARGIN + 1.2e-7 * (vecs.shape[1] + 16) * longest
        else:
            scores, slack = self.vecs @ exact.T, MARGIN * (1 + longest)
        wanted = self.bound - slack
        passed = scores >= wanted[:, None]
        if self.k < len(vecs) and np.count_nonzero(passed) > 4 * self.k * len(self.ids):
            last = np.partition(scores, len(vecs) - self.k, axis=1)[:, len(vecs) - self.k]
            if not self.earlier:
                passed &= scores >= (last - 2 * slack)[:, None]
        row, col = np.divmod(np.flatnonzero(passed), len(vecs))
        sim = np.empty(len(row))
        for at in range(0, len(row), VERIFY_PAIRS):
            part = slice(at, at + VERIFY_PAIRS)
            sim[part] = np.einsum("ij,ij->i", self.vecs[row[part]], exact[col[part]])
        sim = np.round(sim, DECIMALS)
        # Of copies the first are taken; no more than `k` can be kept.
        counts = np.minimum(stops[col + 1] - stops[col], self.k)
        which = np.repeat(np.arange(len(row)), counts)
        place = stops[col][which] + np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        src, dst, sim = self.ids[row[which]], ids[place], sim[which]
        keep = sim >= self.bound[row[which]]
        if self.above:
            keep &= sim > self.floor
        if self.earlier:
            keep &= dst < src
        self.fresh.append((src[keep], dst[keep], sim[keep]))
        self.held += len(self.fresh[-1][0])
        if self.held > max(KEPT_FRESH, len(self.found[0])):
            self.thin()
        return passed.any(axis=0)

    def thin(self):
        """The best entries so far; a row with `k` of them only looks for those that are as good as the last."""
        self.found = _best(*(np.concatenate(parts) for parts in zip(self.found, *self.fresh)), self.k)
        self.fresh, self.held = [], 0
        src, _, sim = self.found
        last = np.flatnonzero(_ranks(src) == self.k - 1)
        at = self.order[np.searchsorted(self.ids, src[last], sorter=self.order)]
        self.bound[at] = np.maximum(self.bound[at], sim[last])
        return self.found


def _by_text(batch: pa.RecordBatch, hopeless: set[str]):
    """The distinct texts of a batch (id, text) that may count, the ids in their order, and where those of each begin and end."""
    coded, ids = batch.column(1).dictionary_encode(), _ids(batch.column(0))
    texts, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((ids, code))
    stops = np.r_[0, np.cumsum(np.bincount(code, minlength=len(texts)))]
    fresh = np.array([place for place, text in enumerate(texts) if text not in hopeless], np.int64)
    counts = (stops[1:] - stops[:-1])[fresh]
    places = np.repeat(stops[fresh] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return [texts[place] for place in fresh], ids[order][places], np.r_[0, np.cumsum(counts)]


def _scan_right(left_side, right, k, floor, above, earlier, encoder=None):
    """All of `left` is at hand: each task keeps the best of its part of `right` for every left row."""
    shared = right.sparkSession.sparkContext.broadcast(left_side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Kept(*shared.value, k, floor, above, earlier)
        # What a text lacked once it always lacks, as the scores to reach only rise.
        hopeless: set[str] = set()
        for batch in batches:
            if encoder is None:
                kept.add(_matrix(batch.column(1)), _ids(batch.column(0)), np.arange(batch.num_rows + 1))
                continue
            texts, ids, stops = _by_text(batch, hopeless)
            for at in range(0, len(texts), plugins.ENCODE_ROWS):
                part = texts[at : at + plugins.ENCODE_ROWS]
                # Stored vectors are in single precision.
                near = kept.add(np.asarray(encoder.encode(part)).astype(np.float32), ids, stops[at : at + len(part) + 1])
                if len(hopeless) < KNOWN_TEXTS:
                    hopeless.update(text for text, hit in zip(part, near) if not hit and len(text) <= KNOWN_LENGTH)
        found = kept.thin()
        if len(found[0]):
            yield _batch(found)

    return right.mapInArrow(run, EDGES)


def _blocks(left, right, k, floor, above, earlier):
    """Each pair of a left and a right block meets in one task."""
    rows = _block_rows(right)
    lefts, rights = ceil(left.count() / rows) or 1, ceil(right.count() / rows) or 1

    # Vectors travel as they came; they become doubles only where the two sides differ.
    kinds = [df.schema[df.columns[1]].dataType.simpleString() for df in (left, right)]
    kind = kinds[0] if kinds[0] == kinds[1] else "array<double>"

    def side(df, blocks, others, name, other, is_left):
        block = F.pmod(F.xxhash64(F.col(df.columns[0])), F.lit(blocks)).cast("int")
        return df.select(
            F.col(df.columns[0]).alias("id"),
            F.col(df.columns[1]).cast(kind).alias("vec"),
            block.alias(name),
            F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other),
            F.lit(is_left).alias("is_left"),
        )

    both = side(left, lefts, rights, "lb", "rb", True).unionByName(side(right, rights, lefts, "rb", "lb", False))
    pairs = both.repartition(_tasks(left, lefts * rights), "lb", "rb")

    def run(table):
        is_left = _ids(table.column("is_left")).astype(bool)
        ids, vecs = _ids(table.column("id")), _matrix(table.column("vec"))
        found = _top(ids[is_left], vecs[is_left], ids[~is_left], vecs[~is_left], k, floor, above, earlier)
        return pa.Table.from_batches([_batch(found)])

    return pairs.groupBy("lb", "rb").applyInArrow(run, EDGES)


def _tasks(df: DataFrame, pairs: int) -> int:
    """Tasks for the pairs of blocks: their work does not show in their bytes, so it is set, not left to AQE."""
    return max(_slots(df), min(pairs, 100_000))


def nearest_others(
    df: DataFrame,
    k: int,
    *,
    floor: float | None = None,
    above: bool = False,
    earlier: bool = False,
    any_one: bool = False,
    block_rows: int | None = None,
    bounded_rows: int | None = None,
) -> DataFrame:
    """For each row of `df` (id, vector) the best `k` other rows, as edges (src, dst, sim, rank).

    With `any_one` (and k = 1) any allowed row will do in place of the best. Tables below `bounded_rows` rows are dealt
    into blocks by a hash and all pairs of blocks are multiplied. Larger ones are dealt into blocks of near vectors, and
    bounds leave out what cannot reach the neighbours that a row already has (`spanloom.operators.bounded`).
    """
    df = df.where(F.col(df.columns[1]).isNotNull())
    size = df.count()
    rows = block_rows or _block_rows(df)
    if size >= (BOUNDED_ROWS if bounded_rows is None else bounded_rows):
        from spanloom.operators.bounded import nearest_bounded

        return nearest_bounded(df, size, k, floor, above, earlier, any_one, rows)
    # At least a block per two slots as soon as the table is worth it, so that all slots get a pair.
    blocks = max(ceil(size / rows), min(ceil(size / 512), ceil(_slots(df) ** 0.5)), 1)
    block = F.pmod(F.xxhash64(F.col(df.columns[0])), F.lit(blocks)).cast("int")
    dealt = df.select(
        F.col(df.columns[0]).alias("id"),
        F.col(df.columns[1]).alias("vec"),
        block.alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"),
    ).select("id", "vec", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    pairs = dealt.repartition(_tasks(df, blocks * (blocks + 1) // 2), "low", "high")

    def run(key, table):
        low, high = (part.as_py() for part in key)
        ids, vecs, owner = _ids(table.column("id")), _matrix(table.column("vec")), _ids(table.column("block"))
        a, b = owner == low, owner == high
        if low == high:
            found = [_top(ids, vecs, ids, vecs, k, floor, above, earlier, others=True)]
        else:
            found = _top(ids[a], vecs[a], ids[b], vecs[b], k, floor, above, earlier, others=True, both=True)
        return pa.Table.from_batches([_batch(one) for one in found])

    return rank_best(pairs.groupBy("low", "high").applyInArrow(run, EDGES), k)
