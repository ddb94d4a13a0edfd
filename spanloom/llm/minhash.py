"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Signature (Li and Li, "C-MinHash", 2022): shingles fall into `UNIVERSE` slots; one permutation deals the slots, a second
one, shifted circularly by k, gives coordinate k as its minimum over the set. The values at k, k + 1, … are neighbours
in the second permutation, so a coordinate row is one slice of it. 50 bands of 5 rows miss a pair at similarity 0.75
with probability 1.4e-6.

Links. Documents with equal sets form a class; one representative each goes on. In each bucket all members are compared
with the smallest, then links are followed to components. Only buckets that still hold several components are looked at
again, in blocks of bounded size: all pairs of members of different components, each pair in the first bucket that it
shares. A pair is dropped unread if the sizes of the sets or the signatures rule out the threshold (below 152 of 250
equal coordinates, which a pair at 0.75 has with probability 1e-7). The others are verified on full sets in the same
task, the most similar first, unless links found before have joined their components; only links that join some leave
the task. So no link between components is lost, and no pairs of a large group are ever written out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import ids_of
from spanloom.llm.shingles import mix64, shingle_sets
from spanloom.operators.components import connected_components
from spanloom.session import store
from spanloom.skew import HOT_NARROW_ROWS, lookup

BANDS, ROWS = 50, 5
COORDINATES = BANDS * ROWS
UNIVERSE = 1 << 20
SEED = 20_231
# Jaccard threshold as a percentage, and the equal coordinates below which a pair cannot reach it.
PERCENT, LEAST_EQUAL = 75, 152
# Members that share one copy of the text they are compared with.
STAR_ROWS = 512
# Members of a block of a bucket, and bytes of their texts.
BLOCK_ROWS, BLOCK_BYTES = 4_096, 16 << 20
SIGNATURE = "id bigint, n bigint, class binary, bands array<bigint>, sketch binary"


@lru_cache(1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """The permutation that deals the slots, and all circular slices of the other."""
    rng = np.random.default_rng(SEED)
    first = rng.permutation(UNIVERSE)
    second = rng.permutation(UNIVERSE).astype(np.uint32)
    turned = np.concatenate((second, second[:COORDINATES]))
    return first, np.lib.stride_tricks.sliding_window_view(turned, COORDINATES)


def signature(shingles: np.ndarray) -> np.ndarray:
    first, slices = _permutations()
    slots = first[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    least = slices[slots[:1_024]].min(axis=0)
    for at in range(1_024, len(slots), 1_024):
        least = np.minimum(least, slices[slots[at : at + 1_024]].min(axis=0))
    return least


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for row in coordinates.reshape(BANDS, ROWS).T.astype(np.uint64):
            total = mix64(total + row + np.uint64(1))
    return total.view(np.int64)


def signatures(rows: DataFrame) -> DataFrame:
    """SIGNATURE of rows (id, text). Texts without words have no class and no bands."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        kind = pa.schema([
            ("id", pa.int64()), ("n", pa.int64()), ("class", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary()),
        ])
        for batch in batches:
            found = []
            for shingles in shingle_sets(batch.column("text").to_pylist()):
                if len(shingles):
                    least = signature(shingles)
                    found.append((len(shingles), xxhash.xxh3_128_digest(shingles.tobytes()), band_keys(least), least.astype(np.uint8).tobytes()))
                else:
                    found.append((0, None, [], None))
            columns = [batch.column("id"), *(pa.array(c, f.type) for c, f in zip(zip(*found), list(kind)[1:]))]
            if found:
                yield pa.record_batch(columns, schema=kind)

    return rows.select("id", "text").mapInArrow(run, SIGNATURE)


def verify(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold. `texts` has (id, text).

    Each text of `a` comes before the texts that it is compared with; many of them are split into several groups.
    """
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_rows"))
    counts = store(counts.withColumn("salts", F.ceil(F.col("_rows") / STAR_ROWS).cast("int")))
    dealt = _join(pairs, counts, "a")
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    members = dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", "text")
    heads = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    heads = heads.join(texts.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(None).cast("bigint").alias("b"), "text")
    together = heads.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "b")

    def run(batches):
        import pyarrow as pa

        at, heads = None, []
        for batch in batches:
            found = []
            sets = shingle_sets(batch.column("text").to_pylist())
            for a, salt, b, one in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b")), sets):
                if b is None:
                    heads = [*heads, one] if (a, salt) == at else [one]
                    at = (a, salt)
                    continue
                if any(reaches(head, one) for head in heads):
                    found.append((a, b))
            columns = list(zip(*found)) if found else [(), ()]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return together.mapInArrow(run, "a bigint, b bigint")


def reaches(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets reach the threshold."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both)


def _join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of `left` with the stored table `right`, whose `_rows` counts the left rows of each key."""
    most = right.agg(F.max("_rows")).first()[0] or 0
    return lookup(left, right, key, "_rows", most, HOT_NARROW_ROWS)


def block_links(members: DataFrame, details: DataFrame) -> DataFrame:
    """Links (a, b) that join components of members of the same bucket, and with those of `members` all that there are.

    `members` has (band, no, id, component, size), where `no` is the number of the band and `size` the bytes of the text;
    `details` has (id, n, bands, sketch, text) and is brought to them last. A bucket is cut
    into blocks by rows and bytes; each pair of blocks is one small group. The first bucket that a pair shares is told by
    the keys of the buckets, as sketches may agree in a band whose coordinates differ.
    """
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("_rows"), F.sum("size").alias("_bytes"))
    blocks = F.greatest(F.ceil(F.col("_rows") / BLOCK_ROWS), F.ceil(F.col("_bytes") / BLOCK_BYTES)).cast("int")
    placed = _join(members, store(sizes.select("band", "_rows", blocks.alias("blocks"))), "band")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    keys = ["band", "low", "high"]
    met = met.join(details, "id").select(*keys, "no", "id", "component", "block", "n", "bands", "sketch", "text")
    met = met.repartition(*keys).sortWithinPartitions(*keys, "id")

    def links(parts):
        import pyarrow as pa

        rows = pa.Table.from_batches(parts)
        ids, comps, blocks, sizes = (rows.column(c).to_numpy() for c in ("id", "component", "block", "n"))
        sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        buckets = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), BANDS)
        crossing, number = rows.column("low")[0] != rows.column("high")[0], rows.column("no")[0].as_py()
        found = []
        for i in range(len(ids) - 1):
            rest = slice(i + 1, None)
            able = (comps[rest] != comps[i]) & (4 * np.minimum(sizes[rest], sizes[i]) >= 3 * np.maximum(sizes[rest], sizes[i]))
            if crossing:
                able &= blocks[rest] != blocks[i]
            near = np.flatnonzero(able) + i + 1
            if not len(near):
                continue
            alike = (sketches[near] == sketches[i]).sum(axis=1)
            near, alike = near[alike >= LEAST_EQUAL], alike[alike >= LEAST_EQUAL]
            first = (buckets[near] == buckets[i]).argmax(axis=1) == number
            if first.any():
                found.append((np.full(int(first.sum()), i), near[first], alike[first]))
        if not found:
            return
        left, right, alike = (np.concatenate(c) for c in zip(*found))
        wanted = np.unique(np.concatenate((left, right)))
        sets = dict(zip(wanted.tolist(), shingle_sets(rows.column("text").take(pa.array(wanted)).to_pylist())))
        top: dict[int, int] = {}

        def root(c: int) -> int:
            while top.get(c, c) != c:
                c = top[c]
            return c

        joined = []
        for at in np.argsort(-alike, kind="stable").tolist():
            i, j = int(left[at]), int(right[at])
            a, b = root(int(comps[i])), root(int(comps[j]))
            if a != b and reaches(sets[i], sets[j]):
                top[max(a, b)] = min(a, b)
                joined.append((int(ids[i]), int(ids[j])))
        if joined:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*joined)], names=["a", "b"])

    def run(batches):
        at, parts = None, []
        for batch in batches:
            held = [batch.column(k).to_numpy() for k in keys]
            steps = np.flatnonzero(np.any([np.diff(h) != 0 for h in held], axis=0)) + 1
            edges = [0, *steps.tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                key = tuple(int(h[low]) for h in held)
                if key != at and parts:
                    yield from links(parts)
                    parts = []
                at = key
                parts.append(batch.slice(low, high - low))
        if parts:
            yield from links(parts)

    return met.mapInArrow(run, "a bigint, b bigint")


def _still_open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members (band, no, id) of buckets with several components, with the component of each."""
    named = members.join(labels.withColumnsRenamed({"node": "id", "component": "_c"}), "id", "left")
    named = store(named.withColumn("component", F.coalesce("_c", "id")).drop("_c"))
    found = named.groupBy("band").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("component").alias("_low"), F.max("component").alias("_high")
    ).where(F.col("_low") != F.col("_high")).select("band", "_rows")
    return _join(named.select("band", "no", "id", "component"), store(found), "band")


def near_duplicates(rows: DataFrame) -> DataFrame:
    """(key, n_shingles, component, kept) for rows (key, text), one for each row.

    `component` is the smallest key that can be reached over links of at least 75 % Jaccard similarity, and the row with
    that key is kept. A text without words, or NULL, is alone. A row without a key takes part and comes after all
    others; if no member has a key, `component` is NULL and all its rows are kept. Rows that share a key count as one
    document.
    """
    ids = ids_of(rows, "key")
    found = classify(rows.select(ids.own(F.col("key"), F.col("text")).alias("id"), "text"))
    return found.select(
        ids.given(F.col("id")).alias("key"), F.col("n").alias("n_shingles"), ids.given(F.col("component")).alias("component"), "kept"
    )


def classify(rows: DataFrame) -> DataFrame:
    """(id, n, component, kept) for rows (id, text) whose ids are not NULL; see `near_duplicates`."""
    signed = store(signatures(rows))
    full = signed.where(F.col("n") > 0)
    classes = full.groupBy("class").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > 1)
    copies = _join(full.select("id", "class"), store(classes), "class")
    copies = store(copies.where(F.col("id") != F.col("rep")).select("id", "rep"))
    reps = full.join(copies.select("id"), "id", "left_anti")

    banded = reps.select("id", F.posexplode("bands").alias("no", "band"))
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("_rows"), F.min("id").alias("leader")).where(F.col("_rows") > 1)
    buckets = store(buckets.withColumn("size", F.col("_rows")))
    members = store(_join(banded, buckets, "band"))
    texts = store(rows.join(members.select("id").distinct(), "id"))
    pairs = members.where(F.col("id") != F.col("leader")).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = store(verify(texts, store(pairs)))

    # A bucket of two is settled; larger ones may hold links between members that are not linked to the smallest.
    large = members.where(F.col("size") > 2).select("band", "no", "id")
    labels = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    still = store(_still_open(large, labels).join(texts.select("id", F.octet_length("text").alias("size")), "id"))
    if not still.isEmpty():
        details = reps.select("id", "n", "bands", "sketch").join(texts, "id")
        links = store(links.unionByName(block_links(still, details)))

    edges = links.unionByName(copies.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    labels = connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    named = signed.select("id", "n").join(labels.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return named.select("id", "n", component.alias("component"), (component == F.col("id")).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each class the one with the smallest key, of equal rows one."""
    marked = docs.select(
        ids_of(docs, key).own(F.col(key), F.col(text)).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("hash"),
        F.struct(*docs.columns).alias("row"),
    )
    kept = classify(marked.select("id", "text")).where("kept").select("id").distinct()
    return marked.join(kept, "id", "left_semi").dropDuplicates(["id", "hash"]).select("row.*")
