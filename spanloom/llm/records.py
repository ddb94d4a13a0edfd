"""Token-id output: length-delimited binary records with masked checksums and a separate offset index.

One record is

    length    unsigned 64 bit, little endian: bytes of the payload
    check     unsigned 32 bit: masked CRC-32 of the eight length bytes
    payload   the ids, little endian, unsigned 16 bit each if every id of the tokenizer fits, else 32 bit
    check     unsigned 32 bit: masked CRC-32 of the payload

A mask keeps a checksum apart from the checksums of data that itself holds checksums: the value is turned right by 15
bits and a constant is added. Beside each shard `*.rec` lies its index `*.idx`, a Parquet file with a row per record:
key, offset, length, first (ids before it in the shard). `manifest.json` names the shards of the finished write with
their first ids; shards that it does not name were left by attempts that failed. Writing and reading are Python data
sources, so Spark runs, retries and commits the tasks; an attempt writes under a name of its own.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from spanloom.llm.common import open_fs
from spanloom.llm.tokens import CACHE_PIECES, ID_BYTES, encoder, gathered

FORMAT = "token_records"
SCHEMA = "key bigint, shard int, position bigint, start bigint, payload binary"
MANIFEST = "manifest.json"
END_ID = 0
MASK_DELTA = 0xA282EAD8
HEAD, TAIL = struct.Struct("<QI"), struct.Struct("<I")
# Rows of an Arrow batch that a reader yields, and bytes after which it yields one.
READ_ROWS, READ_BYTES = 1_024, 8 << 20
# Bytes of records that one read task takes.
SPLIT_BYTES = 64 << 20


class CorruptRecord(ValueError):
    """A record whose lengths or checksums do not agree."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, TAIL.pack(masked(size)), payload, TAIL.pack(masked(payload))))


def unframe(read) -> bytes | None:
    """The next payload of `read(n)`, or None at the end."""
    head = read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise CorruptRecord("the file ends within a record")
    length, check = HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise CorruptRecord("the checksum of a length is wrong")
    body = read(length + TAIL.size)
    if len(body) < length + TAIL.size:
        raise CorruptRecord("the file ends within a record")
    payload = body[:length]
    if masked(payload) != TAIL.unpack(body[length:])[0]:
        raise CorruptRecord("the checksum of a payload is wrong")
    return payload


@dataclass
class _Shard(WriterCommitMessage):
    number: int
    name: str
    records: int
    ids: int
    size: int


@dataclass
class _Split(InputPartition):
    number: int
    name: str
    base: int
    first: int
    records: int
    width: int


def narrow(payload: bytes, width: int) -> bytes:
    """The 32-bit ids of a payload in `width` bytes each."""
    import numpy as np

    if width == ID_BYTES:
        return payload
    ids = np.frombuffer(payload, "<u4")
    if len(ids) and int(ids.max()) >> (8 * width):
        raise ValueError(f"an id does not fit into {width} bytes")
    return ids.astype(f"<u{width}").tobytes()


def widen(payload: bytes, width: int) -> bytes:
    import numpy as np

    return payload if width == ID_BYTES else np.frombuffer(payload, f"<u{width}").astype("<u4").tobytes()


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.width = options["path"], int(options.get("id_bytes", ID_BYTES))

    def write(self, iterator):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        name = f"shard-{number:06d}-{uuid.uuid4().hex}"
        fs, folder = open_fs(self.path)
        fs.create_dir(folder, recursive=True)
        kind = pa.schema([("key", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("first", pa.int64())])
        records = ids = offset = 0
        with (
            fs.open_output_stream(f"{folder}/{name}.rec") as out,
            fs.open_output_stream(f"{folder}/{name}.idx") as side,
            pq.ParquetWriter(side, kind) as index,
        ):
            for batch in iterator:
                rows = {"key": [], "offset": [], "length": [], "first": []}
                for key, payload in zip(batch.column("key").to_pylist(), batch.column("payload")):
                    payload = narrow(payload.as_py() or b"", self.width)
                    out.write(frame(payload))
                    for column, value in zip(rows.values(), (key, offset, len(payload), ids)):
                        column.append(value)
                    records += 1
                    ids += len(payload) // self.width
                    offset += HEAD.size + len(payload) + TAIL.size
                index.write_batch(pa.record_batch(list(rows.values()), schema=kind))
        return _Shard(number, name, records, ids, offset)

    def commit(self, messages):
        shards, base = [], 0
        for m in sorted((m for m in messages if m), key=lambda m: m.number):
            shards.append({"name": m.name, "records": m.records, "ids": m.ids, "base": base, "size": m.size})
            base += m.ids
        fs, folder = open_fs(self.path)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps({"ids": base, "id_bytes": self.width, "shards": shards}).encode())

    def abort(self, messages):
        fs, folder = open_fs(self.path)
        for m in messages:
            if m:
                for end in ("rec", "idx"):
                    fs.delete_file(f"{folder}/{m.name}.{end}")


def read_manifest(path: str) -> dict:
    fs, folder = open_fs(path)
    with fs.open_input_stream(f"{folder}/{MANIFEST}") as source:
        return json.loads(source.read())


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        """A split of at most about SPLIT_BYTES each; the index tells a task where its records begin."""
        splits, manifest = [], read_manifest(self.path)
        for number, shard in enumerate(manifest["shards"]):
            parts = max(1, min(shard["records"], -(-shard["size"] // SPLIT_BYTES)))
            cuts = [shard["records"] * i // parts for i in range(parts + 1)]
            splits += [
                _Split(number, shard["name"], shard["base"], a, b - a, manifest["id_bytes"]) for a, b in zip(cuts, cuts[1:])
            ]
        return splits or [_Split(0, "", 0, 0, 0, ID_BYTES)]

    def read(self, partition):
        import pyarrow as pa
        import pyarrow.parquet as pq

        if not partition.records:
            return
        fs, folder = open_fs(self.path)
        index = pq.read_table(f"{folder}/{partition.name}.idx", filesystem=fs).slice(partition.first, partition.records)
        columns = [index.column(c).to_pylist() for c in ("key", "offset", "length", "first")]
        kind = pa.schema([
            ("key", pa.int64()), ("shard", pa.int32()), ("position", pa.int64()), ("start", pa.int64()), ("payload", pa.binary()),
        ])
        with fs.open_input_file(f"{folder}/{partition.name}.rec") as source:
            source.seek(columns[1][0])
            rows, size = [], 0
            for i, (key, _, length, first) in enumerate(zip(*columns)):
                payload = unframe(source.read)
                if payload is None or len(payload) != length:
                    raise CorruptRecord(f"{partition.name}: the index and record {partition.first + i} differ")
                rows.append((key, partition.number, partition.first + i, partition.base + first, widen(payload, partition.width)))
                size += length
                if len(rows) >= READ_ROWS or size >= READ_BYTES:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)


class TokenRecords(DataSource):
    """`spark.read.format("token_records").load(folder)`; rows to write have key and payload."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options))


def encode_texts(rows: DataFrame, path: str, end_id: int = END_ID, cache_pieces: int = CACHE_PIECES) -> DataFrame:
    """(key, payload) of rows (key, text): the ids of the whole text and the end id. A NULL text counts as empty.

    `cache_pieces` bounds what a worker remembers, and keeps until it ends; it has no effect on the ids.
    """

    def run(batches):
        import pyarrow as pa

        known, end = encoder(path, cache_pieces), struct.pack("<I", end_id)
        for batch in gathered(batches, "text"):
            payloads = [ids + end for ids in known.encode_all([text or "" for text in batch.column("text").to_pylist()])]
            yield pa.record_batch([batch.column("key"), pa.array(payloads, pa.binary())], names=["key", "payload"])

    return rows.select("key", "text").mapInArrow(run, "key bigint, payload binary")


def id_bytes(path: str) -> int:
    """The bytes that hold any id of a tokenizer file."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else ID_BYTES


def write_records(rows: DataFrame, folder: str, width: int = ID_BYTES) -> None:
    """Write rows (key, payload of 32-bit ids) as shards in the order of their partitions, `width` bytes for an id."""
    rows.sparkSession.dataSource.register(TokenRecords)
    rows.write.format(FORMAT).option("id_bytes", width).mode("append").save(folder)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records in any order, each with its shard, its position there and the ids of all records before it."""
    spark.dataSource.register(TokenRecords)
    return spark.read.format(FORMAT).load(folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(name, key, offset, length): where each record lies, for reading in another order."""
    names = [s["name"] for s in read_manifest(folder)["shards"]]
    kind = "key bigint, offset bigint, length bigint, first bigint"
    rows = spark.read.schema(kind).option("pathGlobFilter", "*.idx").parquet(folder)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.idx$", 1)
    kept = spark.createDataFrame([(n,) for n in names], "name string")
    return rows.select(name.alias("name"), "key", "offset", "length").join(F.broadcast(kept), "name", "left_semi")


def read_shuffled(spark: SparkSession, folder: str, seed: int) -> DataFrame:
    """(place, key, payload) in a seeded random order: the index rows are shuffled, and each record is fetched by offset."""
    order = F.xxhash64(F.lit(seed), "name", "offset")
    width = read_manifest(folder)["id_bytes"]
    rows = read_index(spark, folder).withColumn("place", order).repartitionByRange("place").sortWithinPartitions("place")

    def run(batches):
        import pyarrow as pa

        fs, base = open_fs(folder)
        for batch in batches:
            payloads = [b""] * batch.num_rows
            wanted = list(zip(batch.column("name").to_pylist(), batch.column("offset").to_pylist(), range(batch.num_rows)))
            name, source = None, None
            for file, offset, i in sorted(wanted):
                if file != name:
                    if source:
                        source.close()
                    name, source = file, fs.open_input_file(f"{base}/{file}.rec")
                source.seek(offset)
                payloads[i] = widen(unframe(source.read), width)
            if source:
                source.close()
            yield pa.record_batch(
                [batch.column("place"), batch.column("key"), pa.array(payloads, pa.binary())], names=["place", "key", "payload"]
            )

    return rows.mapInArrow(run, "place bigint, key bigint, payload binary")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows (key, text) in ascending key order over the partitions, NULL first; equal keys in the order of their text."""
    return (
        rows.withColumn("_tie", F.xxhash64("text")).repartitionByRange("key", "_tie")
        .sortWithinPartitions("key", "_tie", "text").drop("_tie")
    )
