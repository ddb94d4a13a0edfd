"""Exact nearest neighbours within one large table, by prefix and remaining-length bounds.

The inner product of two vectors is at most the product of their first coordinates plus the product of the lengths of
what remains (Anastasiu and Karypis, "L2AP", 2014). Here the vectors are turned first, so that the first coordinates
carry most of their length, and the bound of all pairs of two blocks is one matrix product of few columns in single
precision, with a margin for its rounding. Only pairs whose bound reaches what one of the two rows still looks for are
multiplied out in double precision.

1. A sample of rows gives the turn (its principal axes) and pivots. Rows go to the block of their nearest pivot, so near
   rows share a block; a block has a bounded number of rows, and a pivot with more rows is split by a hash of the id.
2. Each row first looks for neighbours in its own block, nearest rows first. If it finds `k`, only a score at least as
   good as the worst of them is still of interest.
3. Blocks meet in pairs, each pair once for both directions. Pairs whose angles rule out what their rows look for are
   left out before anything is shipped, so a row is copied to the other blocks at most once each, never more than plain
   blocks do.

For data without structure every pair of blocks meets and the exact answer stays quadratic in the number of rows; the
bounds then save work in a pair, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.operators import simjoin
from spanloom.operators.simjoin import DECIMALS, EDGES, MARGIN, _batch, _best, _candidates, _ids, _matrix, _ranks, _slots, rank_best
from spanloom.session import BROADCAST_ROWS, store

# Pairs that are multiplied out at once, and what one costs against a column of the bounds of one pair.
VERIFY_PAIRS, VERIFY_COST = 2_048, 30
# Entries of a block that are kept before they are thinned out.
KEPT_ENTRIES = 1 << 20
SAMPLE_ROWS = 1_024
# Rows of a block that are compared in full, and rows of two sets that tell how many coordinates are to lead.
TILE_ROWS, CHOICE_ROWS = 2_048, 256
# Parts of rows of like bounds that have numbers of coordinates of their own.
BOUND_PARTS = 4
_EMPTY_PLACES = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


@dataclass
class _Plan:
    """The turn; pivots with the first block and the number of blocks of each."""

    turn: np.ndarray
    pivots: np.ndarray
    base: np.ndarray
    parts: np.ndarray


def _directions(vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.sqrt(np.einsum("ij,ij->i", vecs, vecs))
    return vecs / np.where(lengths == 0, 1.0, lengths)[:, None], lengths


def _quick(longest: float, dimensions: int) -> tuple[type, float]:
    """The type in which bounds are computed and how far one may lie below the true value."""
    if longest > 1e15:
        return np.float64, MARGIN * (1 + longest * longest)
    return np.float32, MARGIN + 1.2e-7 * (dimensions + 16) * longest * longest


def _dots(left: np.ndarray, right: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Rounded inner products of the given pairs of rows."""
    found = np.empty(len(row))
    for at in range(0, len(row), VERIFY_PAIRS):
        part = slice(at, at + VERIFY_PAIRS)
        found[part] = np.einsum("ij,ij->i", left[row[part]], right[col[part]])
    return np.round(found, DECIMALS)


def _best_places(src: np.ndarray, dst: np.ndarray, sim: np.ndarray, k: int):
    """As `_best`, by one sort of whole numbers where source, rounded score and place fit into 64 bits."""
    whole = np.rint(sim * 10**DECIMALS)
    if not len(src) or max(src.max(), dst.max()) >= 1 << 17 or np.abs(whole).max() >= 1 << 28:
        return _best(src, dst, sim, k)
    key = np.sort(src << 46 | ((1 << 28) - whole.astype(np.int64)) << 17 | dst)
    src = key >> 46
    keep = _ranks(src) < k
    key, src = key[keep], src[keep]
    return src, key & ((1 << 17) - 1), ((1 << 28) - (key >> 17 & ((1 << 29) - 1))) / 10**DECIMALS


class _Search:
    """The best `k` others of some rows, as far as sets of them have met. Rows are known by their place in order of id."""

    def __init__(self, ids, vecs, bound, turn, k, floor, above, earlier):
        self.ids, self.vecs, self.bound = ids, vecs, bound
        self.k, self.floor, self.above, self.earlier = k, floor, above, earlier
        self.kind, self.slack = _quick(float(np.sqrt(np.einsum("ij,ij->i", vecs, vecs).max(initial=0.0))), vecs.shape[1])
        self.turned = (vecs @ turn).astype(self.kind)
        self.found, self.held = [_EMPTY_PLACES], 0

    def _leading(self, rows: np.ndarray, lead: int) -> np.ndarray:
        """The leading coordinates and the length of what remains."""
        turned = self.turned[rows]
        rest = np.sqrt(np.einsum("ij,ij->i", turned[:, lead:], turned[:, lead:]))
        return np.column_stack((turned[:, :lead], rest))

    def _wanted(self, rows: np.ndarray) -> np.ndarray:
        return (self.bound[rows] - self.slack).astype(self.kind)

    def _choose_lead(self, a: np.ndarray, b: np.ndarray) -> int:
        a, b = a[:: max(1, len(a) // CHOICE_ROWS)], b[:: max(1, len(b) // CHOICE_ROWS)]
        width, costs = self.vecs.shape[1], []
        for lead in sorted({max(1, width * share // 16) for share in (2, 3, 4, 6, 8, 12, 16)}):
            upper = self._leading(a, lead) @ self._leading(b, lead).T
            passed = (upper >= self._wanted(a)[:, None]) | (upper >= self._wanted(b)[None, :])
            costs.append((lead + VERIFY_COST * width * passed.mean(), lead))
        return min(costs)[1]

    def within(self, rows: np.ndarray) -> None:
        """All pairs of a few rows."""
        scores = self.vecs[rows].astype(self.kind) @ self.vecs[rows].astype(self.kind).T
        row, col = _candidates(scores, rows, rows, self.k, self.floor, self.earlier, True, self.slack)
        self._add(rows[row], rows[col], _dots(self.vecs, self.vecs, rows[row], rows[col]))
        self.thin()

    def between(self, a: np.ndarray, b: np.ndarray) -> None:
        """All pairs of a row of `a` and one of `b`, both ways; no row is in both."""
        # Rows that look for much are kept from those that take little, as they need fewer coordinates.
        for one in self._by_bound(a):
            for other in self._by_bound(b):
                if len(one) and len(other):
                    self._meet(one, other)

    def _by_bound(self, rows: np.ndarray) -> list[np.ndarray]:
        parts = 1 + (BOUND_PARTS - 1) * (len(rows) >= TILE_ROWS)
        return np.array_split(rows[np.argsort(self.bound[rows], kind="stable")], parts)

    def _meet(self, a: np.ndarray, b: np.ndarray) -> None:
        lead = self._choose_lead(a, b)
        left, right = self._leading(a, lead), self._leading(b, lead).T
        height = max(1, simjoin.SLAB_CELLS // len(b))
        for at in range(0, len(a), height):
            part = a[at : at + height]
            upper = left[at : at + height] @ right
            cells = np.flatnonzero((upper >= self._wanted(part)[:, None]) | (upper >= self._wanted(b)[None, :]))
            one, other = part[cells // len(b)], b[cells % len(b)]
            sim = _dots(self.vecs, self.vecs, one, other)
            self._add(one, other, sim)
            self._add(other, one, sim)
            if self.held > KEPT_ENTRIES:
                self.thin()

    def _add(self, src: np.ndarray, dst: np.ndarray, sim: np.ndarray) -> None:
        keep = (dst < src) if self.earlier else (dst != src)
        keep &= sim >= self.bound[src]
        if self.floor is not None:
            keep &= (sim > self.floor) if self.above else (sim >= self.floor)
        self.found.append((src[keep], dst[keep], sim[keep]))
        self.held += len(self.found[-1][0])

    def thin(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best entries so far; a row with `k` of them only looks for those that are as good as the last."""
        src, dst, sim = _best_places(*(np.concatenate(c) for c in zip(*self.found)), self.k)
        self.found, self.held = [(src, dst, sim)], 0
        last = np.flatnonzero(_ranks(src) == self.k - 1)
        self.bound[src[last]] = np.maximum(self.bound[src[last]], sim[last])
        return src, dst, sim


def _make_plan(df: DataFrame, size: int, block_rows: int) -> tuple[_Plan, int]:
    wanted = min(BROADCAST_ROWS, max(SAMPLE_ROWS, ceil(2 * sqrt(size))))
    sample = _matrix(df.orderBy(F.xxhash64("id"), "id").limit(wanted).toArrow().column("vec"))
    turn = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
    pivots = np.unique(_directions(sample)[0][: max(1, min(len(sample), 4 * ceil(size / block_rows)))], axis=0)
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            total += np.bincount((_matrix(batch.column(0)) @ shared.value.T).argmax(axis=1), minlength=len(total))
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], names=["pivot", "n"])

    counted = df.select("vec").mapInArrow(nearest, "pivot bigint, n bigint").groupBy("pivot").agg(F.sum("n").alias("n"))
    rows = np.zeros(len(pivots), np.int64)
    for pivot, n in counted.collect():
        rows[pivot] = n
    base, parts = np.zeros(len(pivots), np.int64), np.maximum(1, -(-rows // block_rows))
    block, held = 0, 0
    # Pivots of few rows share a block with the next of those that are near them.
    for pivot in np.argsort((pivots @ pivots[0]) if len(pivots) else np.zeros(0), kind="stable").tolist():
        if held and held + rows[pivot] > block_rows:
            block, held = block + 1, 0
        base[pivot] = block
        if parts[pivot] > 1:
            block, held = block + int(parts[pivot]), 0
        else:
            held += int(rows[pivot])
    return _Plan(turn, pivots, base, parts), block + 1


def _by_number(df: DataFrame, name: str, numbers: int, work, schema) -> DataFrame:
    """`work` on the rows of each of the numbers 0 … `numbers` - 1 of a column; up to 100,000 of them have their own task."""
    tasks = max(1, min(numbers, 100_000))
    dealt = df.repartitionById(tasks, (F.col(name) % tasks).cast("int"))
    if numbers > tasks:
        dealt = dealt.sortWithinPartitions(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            column = batch.column(name).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                if held and column[low] != at:
                    yield from work(pa.Table.from_batches(held)).to_batches()
                    held = []
                at = column[low]
                held.append(batch.slice(low, high - low))
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return dealt.mapInArrow(run, schema)


def nearest_bounded(
    df: DataFrame, size: int, k: int, floor: float | None, above: bool, earlier: bool, any_one: bool, block_rows: int
) -> DataFrame:
    """Edges (src, dst, sim, rank) as of `nearest_others`; `size` is the number of rows of `df` (id, vector)."""
    df = df.toDF("id", "vec")
    slots = _slots(df)
    # Enough pairs of blocks for all slots.
    block_rows = max(2, min(block_rows, ceil(size / ceil(sqrt(6 * slots)))))
    plan, blocks = _make_plan(df, size, block_rows)
    shared = df.sparkSession.sparkContext.broadcast(plan)
    homes = store(_home(_deal(df, shared), k, floor, above, earlier, any_one, blocks, shared))
    at_home = homes.select(F.col("id").alias("src"), F.explode(F.arrays_zip("dsts", "sims")).alias("e")).select(
        "src", F.col("e.dsts").alias("dst"), F.col("e.sims").alias("sim")
    )
    return rank_best(at_home.unionByName(_across(homes, k, floor, above, earlier, shared)), k)


def _deal(df: DataFrame, plan) -> DataFrame:
    """(id, vec, block) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, base, parts = plan.value.pivots, plan.value.base, plan.value.parts
        for batch in batches:
            pivot = (_matrix(batch.column(1)) @ pivots.T).argmax(axis=1)
            mixed = _ids(batch.column(0)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            block = base[pivot] + (mixed % parts[pivot].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(block, pa.int64())], names=["id", "vec", "block"])

    return df.mapInArrow(run, T.StructType(df.schema.fields + [T.StructField("block", T.LongType())]))


def _home(dealt: DataFrame, k, floor, above, earlier, any_one, blocks: int, plan) -> DataFrame:
    """Each row with its neighbours in its own block and the score to reach elsewhere.

    One row of each block also has its centre, the largest angle to it, the largest length and the least score to reach.
    """
    extra = "bound double, dsts array<bigint>, sims array<double>, centre array<double>, radius double, longest double, least double"
    schema = T.StructType(dealt.schema.fields + T._parse_datatype_string(extra).fields)

    def run(table):
        table = table.take(np.argsort(_ids(table.column("id")), kind="stable"))
        ids, vecs = _ids(table.column("id")), _matrix(table.column("vec"))
        directions, lengths = _directions(vecs)
        search = _Search(ids, vecs, np.full(len(ids), -np.inf if floor is None else floor), plan.value.turn, k, floor, above, earlier)
        # Rows near the same row of the block come one after the other.
        seeds = directions[:: max(1, len(ids) // SAMPLE_ROWS)].astype(np.float32)
        order = np.argsort((directions.astype(np.float32) @ seeds.T).argmax(axis=1), kind="stable")
        tiles = [order[at : at + TILE_ROWS] for at in range(0, len(order), TILE_ROWS)]
        for tile in tiles:
            search.within(tile)
        for number, tile in enumerate(tiles):
            search.between(tile, order[(number + 1) * TILE_ROWS :])
        src, dst, sim = search.thin()
        bound, count = search.bound, np.bincount(src, minlength=len(ids))
        stops = np.concatenate([[0], np.cumsum(count)])
        if any_one:
            bound[count > 0] = np.inf
        mean = directions.mean(axis=0)
        centre = mean / (np.linalg.norm(mean) or 1.0)
        radius = np.arccos(np.clip(directions @ centre, -1.0, 1.0)).max()
        only = lambda value, type_: pa.array([value] + [None] * (len(ids) - 1), type_)
        return pa.table(
            {
                "id": table.column("id"), "vec": table.column("vec"), "block": table.column("block"), "bound": pa.array(bound),
                "dsts": pa.ListArray.from_arrays(stops.astype(np.int32), pa.array(ids[dst], pa.int64())),
                "sims": pa.ListArray.from_arrays(stops.astype(np.int32), pa.array(sim, pa.float64())),
                "centre": only(centre.tolist(), pa.list_(pa.float64())), "radius": only(radius, pa.float64()),
                "longest": only(lengths.max(), pa.float64()), "least": only(bound.min(), pa.float64()),
            }
        )

    return _by_number(dealt, "block", blocks, run, schema)


def _pairs(homes: DataFrame):
    """The pairs (low, high) of blocks that may hold something for each other. The driver gets one row per block."""
    found = homes.where(F.col("centre").isNotNull()).select("block", "centre", "radius", "longest", "least").toArrow()
    if not found.num_rows:
        return np.zeros((0, 2), np.int64)
    block, centre = _ids(found.column("block")), _matrix(found.column("centre"))
    radius, longest, least = (_ids(found.column(c)) for c in ("radius", "longest", "least"))
    pairs = []
    for i in range(len(block) - 1):
        rest = slice(i + 1, None)
        angle = np.arccos(np.clip(centre[rest] @ centre[i], -1.0, 1.0)) - radius[rest] - radius[i] - MARGIN
        most = longest[rest] * longest[i] * np.maximum(0.0, np.cos(np.clip(angle, 0.0, np.pi)))
        near = block[rest][most + MARGIN >= np.minimum(least[rest], least[i])]
        pairs.append(np.column_stack((np.minimum(near, block[i]), np.maximum(near, block[i]))))
    return np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)


def _across(homes: DataFrame, k, floor, above, earlier, plan) -> DataFrame:
    """Edges between rows of different blocks."""
    spark = homes.sparkSession
    pairs = _pairs(homes)
    numbers = pa.array(np.arange(len(pairs)))
    known = spark.createDataFrame(pa.table({"low": pa.array(pairs[:, 0]), "high": pa.array(pairs[:, 1]), "pair": numbers}))
    ends = known.select("pair", "low", "high", F.explode(F.array("low", "high")).alias("block"))
    met = homes.select("id", "vec", "bound", "block").join(ends, "block")

    def run(table):
        table = table.take(np.argsort(_ids(table.column("id")), kind="stable"))
        high = _ids(table.column("block")) != _ids(table.column("low"))
        ids, bound = _ids(table.column("id")), _ids(table.column("bound")).copy()
        search = _Search(ids, _matrix(table.column("vec")), bound, plan.value.turn, k, floor, above, earlier)
        search.between(np.flatnonzero(~high), np.flatnonzero(high))
        src, dst, sim = search.thin()
        return pa.Table.from_batches([_batch((ids[src], ids[dst], sim))])

    return _by_number(met, "pair", len(pairs), run, EDGES)
