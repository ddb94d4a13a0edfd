"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes: vectors are centred, projected on their main axes and turned by the rotation that brings the signs closest to the
values (iterative quantisation; Gong and Lazebnik, 2011), learnt on a bounded sample. A code of 64 bits is cut into 8
substrings, each with a table from value to rows (Norouzi, Punjani and Fleet, 2012). If two codes differ in at most r
bits, some substring differs in at most r // 8, so probing all values that near finds every code within the radius; these
are ranked by their exact distance. The radius is the one that holds nearly all true neighbours in the sample, where
neighbours are farther than among all rows, so it errs to the wide side; a query that finds too few widens it.

Work is dealt as blocks of queries against blocks of rows, each pair of blocks one group of bounded size, and only the
best `k` of a query leave a group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import store

BITS, TABLES = 64, 8
# Rows to learn the rotation on, sample queries to set the radius by, and the share of true neighbours to hold.
SAMPLE, PROBES, HOLD = 10_000, 256, 0.98
ROUNDS, SEED = 30, 9
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 2_048
# Bits by which a query that found too few widens its radius.
WIDEN = 4
_COUNT = np.array([bin(v).count("1") for v in range(256)])
_NEAR = [np.flatnonzero(_COUNT <= a).astype(np.uint8) for a in range(9)]


@dataclass(frozen=True)
class Coder:
    mean: np.ndarray
    turn: np.ndarray
    radius: int = 0

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, TABLES) bytes; bits beyond the dimensions of the vectors are zero."""
        bits = np.zeros((len(vectors), BITS), bool)
        bits[:, : self.turn.shape[1]] = (vectors - self.mean) @ self.turn > 0
        return np.packbits(bits, axis=1)


def learn(sample: np.ndarray, k: int) -> Coder:
    """The rotation and the radius for the `k` nearest, from sample rows."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, : min(BITS, sample.shape[1])]
    rng = np.random.default_rng(SEED)
    turn, _ = np.linalg.qr(rng.standard_normal((axes.shape[1], axes.shape[1])))
    reduced = centred @ axes
    for _ in range(ROUNDS):
        left, _, right = np.linalg.svd(np.where(reduced @ turn > 0, 1.0, -1.0).T @ reduced)
        turn = (left @ right).T
    coder = Coder(mean, axes @ turn)
    codes = coder.codes(sample)
    found = []
    for at in rng.permutation(len(sample))[:PROBES]:
        far = ((sample - sample[at]) ** 2).sum(axis=1)
        far[at] = np.inf
        nearest = np.argsort(far)[: min(k, len(sample) - 1)]
        found += _COUNT[codes[nearest] ^ codes[at]].sum(axis=1).tolist()
    radius = int(np.ceil(np.quantile(found, HOLD))) if found else BITS
    return Coder(mean, coder.turn, min(radius, BITS))


class Index:
    """Tables from the values of each substring to the rows that have them."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.whole = codes.view(np.uint64).ravel() if len(codes) else np.empty(0, np.uint64)
        self.rows = [np.argsort(codes[:, t], kind="stable") for t in range(TABLES)]
        values = np.arange(257)
        self.starts = [np.searchsorted(codes[self.rows[t], t], values) for t in range(TABLES)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose codes differ in at most `radius` bits, ascending."""
        least, more = divmod(radius, TABLES)
        seen = np.zeros(len(self.codes), bool)
        for t in range(TABLES):
            # If the first more + 1 substrings differ in over `least` bits each, the others have under `least` left.
            reach = least if t <= more else least - 1
            if reach < 0:
                continue
            for value in (_NEAR[min(reach, 8)] ^ code[t]).tolist():
                seen[self.rows[t][self.starts[t][value] : self.starts[t][value + 1]]] = True
        found = np.flatnonzero(seen)
        return found[np.bitwise_count(self.whole[found] ^ code.view(np.uint64)[0]) <= radius]


def valid(rows: DataFrame) -> DataFrame:
    """(id, vec) with doubles: one row per id; vectors that are NULL, zero or hold NULL or non-finite numbers take no part.

    Of several vectors with one id the smallest counts. Only vectors of the most frequent length are comparable.
    """
    inf = float("inf")
    vec = F.col("vec").cast("array<double>")
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(inf))) & F.exists(vec, lambda x: x != 0)
    kept = rows.select(F.col("id").cast("bigint").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & sound)
    kept = store(kept.groupBy("id").agg(F.min("vec").alias("vec")))
    sizes = kept.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return kept.where(F.size("vec") == sizes.n) if sizes else kept


def search(rows: DataFrame, is_query, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the `k` nearest found of each query: the rows (id, vec) that `is_query` picks.

    The score is the Euclidean distance in doubles; ties go to the smaller id, and no row finds itself. An empty table
    gives no rows; a query has fewer than `k` answers only if there are fewer other rows.
    """
    rows = valid(rows)
    sample = rows.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(SAMPLE).select("vec").collect()
    if not sample:
        return rows.select(
            F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")
        ).limit(0)
    coder = learn(np.array([r.vec for r in sample], float), k)
    total, asked = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    blocks, groups = max(1, -(-total // BLOCK_ROWS)), max(1, -(-asked // BLOCK_QUERIES))
    block, group = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = rows.where(is_query).withColumn("group", group).withColumn("block", every(blocks)).withColumn("kind", F.lit(0))
    asked_of = rows.withColumn("block", block).withColumn("group", every(groups)).withColumn("kind", F.lit(1))
    keys = ["block", "group"]
    met = asking.unionByName(asked_of).select(*keys, "kind", "id", "vec").repartition(*keys).sortWithinPartitions(*keys, "kind", "id")

    def nearest(parts):
        import pyarrow as pa

        held = pa.Table.from_batches(parts)
        kinds, ids = held.column("kind").to_numpy(), held.column("id").to_numpy()
        vectors = held.column("vec").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        n = int((kinds == 0).sum())
        ids, vectors, queries, query_ids = ids[n:], vectors[n:], vectors[:n], ids[:n]
        index, codes = Index(coder.codes(vectors)), coder.codes(queries)
        for query_id, query, code in zip(query_ids.tolist(), queries, codes):
            radius = coder.radius
            while True:
                found = index.within(code, radius)
                found = found[ids[found] != query_id]
                if len(found) >= k or radius >= BITS:
                    break
                radius = min(BITS, radius + WIDEN)
            far = np.sqrt(((vectors[found] - query) ** 2).sum(axis=1))
            best = np.lexsort((ids[found], far))[:k]
            if len(best):
                yield pa.record_batch(
                    [pa.array(np.full(len(best), query_id)), pa.array(ids[found][best]), pa.array(far[best])],
                    names=["query_id", "vec_id", "score"],
                )

    def run(batches):
        at, parts = None, []
        for batch in batches:
            held = [batch.column(c).to_numpy() for c in keys]
            steps = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0)) + 1
            edges = [0, *steps.tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                key = (int(held[0][low]), int(held[1][low]))
                if key != at and parts:
                    yield from nearest(parts)
                    parts = []
                at = key
                parts.append(batch.slice(low, high - low))
        if parts:
            yield from nearest(parts)

    found = met.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
