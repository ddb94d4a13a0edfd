"""WARC archives as a Python data source, with revisit records for equal payloads.

Writing: a record per page; of pages with equal payloads the one with the smallest key is a response and the others are
revisits of it, without the payload. A task starts a new file after `file_bytes`, under a name of its own, and the files
of the tasks that ended well are named in `manifest.json`.

Reading: files are dealt into splits of about equal bytes. A task parses the headers of a record first. Filters on the
record type and on other header columns are pushed down and decide there; the block of an unwanted record is skipped by
a seek. With `.option("payload", "false")` no payload is read at all. Folders of other writers are read by listing them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull,
    StringStartsWith, WriterCommitMessage,
)

from spanloom.llm.common import ids_of, open_fs
from spanloom.session import broadcast_if_small, store
from spanloom.skew import HOT_NARROW_ROWS, lookup

FORMAT = "warc"
MANIFEST = "manifest.json"
HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type",
}
SCHEMA = ", ".join(f"{name} string" for name in HEADERS) + ", file string, offset bigint, payload_bytes bigint, payload binary"
# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE, REVISIT, INFO = "response", "revisit", "warcinfo"
ID_PREFIX = "urn:page:"
DATE = "2000-01-01T00:00:00Z"
FILE_BYTES, SPLIT_BYTES = 128 << 20, 64 << 20
READ_ROWS, READ_BYTES = 512, 8 << 20


class BadRecord(ValueError):
    """A record that breaks the format, or whose payload has another digest than its header says."""


def digest(payload: bytes) -> str:
    """The bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), *fields, ("Content-Length", str(len(block)))]
    # A line end inside a value would end its header, so blanks and control characters are percent-encoded.
    head = "".join(f"{name}: {_one_line(value)}\r\n" for name, value in lines)
    return b"".join((VERSION, head.encode(), b"\r\n", block, b"\r\n\r\n"))


def _one_line(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def page_record(key: int, uri: str, payload: bytes, original: int | None, date: str = DATE) -> bytes:
    """A response, or a revisit of the record `original`: its block has the HTTP headers of the payload only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", "sha1:" + digest(payload))]
    if original is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{ID_PREFIX}{original}>")]
    else:
        block += payload
    fields.append(("Content-Type", "application/http; msgtype=response"))
    return record(REVISIT if original is not None else RESPONSE, f"{ID_PREFIX}{key}", fields, block)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, int]]


@dataclass
class _Split(InputPartition):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.gzip = options["path"], options.get("compression", "none") == "gzip"
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator):
        fs, folder = open_fs(self.path)
        fs.create_dir(folder, recursive=True)
        files, out, size = [], None, 0

        def put(data: bytes) -> int:
            data = gzip.compress(data, 6, mtime=0) if self.gzip else data
            out.write(data)
            return len(data)

        for batch in iterator:
            for key, uri, html, original in zip(*(batch.column(n).to_pylist() for n in ("key", "uri", "payload", "original"))):
                if out is not None and size >= self.file_bytes:
                    out.close()
                    files[-1] = (files[-1][0], size)
                    out = None
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
                    files.append((name, 0))
                    out, size = fs.open_output_stream(f"{folder}/{name}", compression=None), 0
                    info = [("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
                    size += put(record(INFO, f"urn:uuid:{uuid.uuid4()}", info, b"format: WARC File Format 1.1\r\n"))
                size += put(page_record(key, uri or "", html or b"", original))
        if out is not None:
            out.close()
            files[-1] = (files[-1][0], size)
        return _Written(files)

    def commit(self, messages):
        fs, folder = open_fs(self.path)
        fs.create_dir(folder, recursive=True)
        files = sorted(f for m in messages if m for f in m.files)
        with fs.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages):
        fs, folder = open_fs(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                fs.delete_file(f"{folder}/{name}")


def _listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the archives of a folder, or of one file."""
    from pyarrow import fs as pafs

    fs, place = open_fs(path)
    if fs.get_file_info(place).type == pafs.FileType.File:
        return [(place, fs.get_file_info(place).size)]
    if fs.get_file_info(f"{place}/{MANIFEST}").type == pafs.FileType.File:
        with fs.open_input_stream(f"{place}/{MANIFEST}") as source:
            return [(f"{place}/{name}", size) for name, size in json.loads(source.read())]
    found = fs.get_file_info(pafs.FileSelector(place, recursive=True, allow_not_found=False))
    return sorted((f.path, f.size) for f in found if f.path.endswith((".warc", ".warc.gz")))


def _headers(source) -> dict[str, str] | None:
    """The headers of the next record, or None at the end."""
    line = source.readline()
    while line in (b"\r\n", b"\n"):
        line = source.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise BadRecord(f"no record begins with {line[:40]!r}")
    found, last = {}, None
    while (line := source.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise BadRecord("the file ends within the headers of a record")
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:
            found[last] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        last = name.strip().lower()
        found[last] = value.strip()
    return found


def _column(name: str, headers: dict[str, str]) -> str | None:
    value = headers.get(HEADERS[name])
    if value is None:
        return None
    if name in ("record_id", "refers_to"):
        return value.removeprefix("<").removesuffix(">")
    return value.removeprefix("sha1:") if name == "payload_digest" else value


def _keeps(test, headers: dict[str, str]) -> bool:
    value = _column(test.attribute[0], headers)
    if isinstance(test, EqualTo):
        return value is not None and value == test.value
    if isinstance(test, In):
        return value is not None and value in test.value
    if isinstance(test, StringStartsWith):
        return value is not None and value.startswith(test.value)
    return (value is None) == isinstance(test, IsNull)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payloads = options["path"], options.get("payload", "true").lower() != "false"
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.tests = []

    def pushFilters(self, filters):
        """Take tests of header columns; the others are left to Spark."""
        for test in filters:
            if isinstance(test, (EqualTo, In, IsNotNull, IsNull, StringStartsWith)) and test.attribute[0] in HEADERS:
                self.tests.append(test)
            else:
                yield test

    def partitions(self):
        splits, size = [], 0
        for name, its in _listed(self.path):
            if not splits or size + its > self.split_bytes:
                splits.append(_Split([]))
                size = 0
            splits[-1].files.append(name)
            size += its
        return splits or [_Split([])]

    def read(self, partition):
        import pyarrow as pa

        kind = pa.schema([
            *[(n, pa.string()) for n in HEADERS], ("file", pa.string()), ("offset", pa.int64()),
            ("payload_bytes", pa.int64()), ("payload", pa.binary()),
        ])
        fs, _ = open_fs(self.path)
        rows, size = [], 0
        for name in partition.files:
            with fs.open_input_file(name) as raw:
                packed = name.endswith(".gz")
                source = gzip.GzipFile(fileobj=raw) if packed else io.BufferedReader(raw, 1 << 20)
                for row in self._records(source, name.rsplit("/", 1)[-1]):
                    rows.append(row)
                    size += len(row[-1] or b"")
                    if len(rows) >= READ_ROWS or size >= READ_BYTES:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)
                        rows, size = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    def _records(self, source, name: str):
        while True:
            at = source.tell()
            headers = _headers(source)
            if headers is None:
                return
            length = int(headers["content-length"])
            if not all(_keeps(test, headers) for test in self.tests):
                source.seek(length, io.SEEK_CUR)
                continue
            size, payload = self._block(source, headers, length)
            yield (*(_column(n, headers) for n in HEADERS), name, at, size, payload)

    def _block(self, source, headers: dict[str, str], length: int) -> tuple[int, bytes | None]:
        """(bytes of the full payload, the payload), read no further than needed."""
        end = source.tell() + length
        size, http = length, headers.get("content-type", "").startswith("application/http")
        if http:
            said = None
            while (line := source.readline()) not in (b"\r\n", b"\n", b""):
                if line.lower().startswith(b"content-length:"):
                    said = int(line.split(b":", 1)[1])
            size = end - source.tell()
        payload = None
        revisit = headers.get("warc-type") == REVISIT
        if revisit and http and said is not None:
            size = said
        elif self.payloads and not revisit:
            payload = source.read(size)
            if len(payload) < size:
                raise BadRecord("the file ends within a payload")
            wanted = _column("payload_digest", headers)
            if wanted and len(wanted) == 32 and digest(payload) != wanted.upper():
                raise BadRecord(f"the payload of {headers.get('warc-record-id')} has another digest")
        source.seek(end)
        return size, payload


class Warc(DataSource):
    """`spark.read.format("warc").load(folder)`; rows to write have key, uri, payload and original."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known, and let Spark push filters into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def revisits(rows: DataFrame, least_bytes: int) -> DataFrame:
    """(key, digest, original) of those rows (key, payload) whose payload, of at least `least_bytes`, a smaller key has too."""
    digests = rows.select("key", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"))
    digests = store(digests).where(F.col("size") >= least_bytes).select("key", "digest")
    first = digests.groupBy("digest").agg(F.min("key").alias("original"), F.count(F.lit(1)).alias("_rows"))
    shared = lookup(digests, first.where(F.col("_rows") > 1), "digest", "_rows", hot_rows=HOT_NARROW_ROWS)
    return shared.where(F.col("key") != F.col("original")).select("key", "digest", "original").distinct()


def write_pages(pages: DataFrame, folder: str, least_bytes: int = 0, compression: str = "none") -> None:
    """Archive rows (key, uri, payload): text payloads in UTF-8, NULL as empty.

    A row without a key gets one from its content, after all others; rows with the same key and payload are all
    responses.
    """
    register(pages.sparkSession)
    ids = ids_of(pages, "key")
    rows = pages.select(
        ids.own(F.col("key"), F.col("uri"), F.col("payload")).alias("key"), "uri",
        F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"),
    )
    # Where revisits are few, the pages need no shuffle to learn of them.
    found = broadcast_if_small(store(revisits(rows, least_bytes)))
    marked = rows.withColumn("digest", F.sha1("payload")).join(found, ["key", "digest"], "left")
    # Made keys are no numbers in the archive, so that nobody takes them for given ones.
    name = lambda c: F.coalesce(ids.given(F.col(c)).cast("string"), F.concat(F.lit("none-"), c)).alias(c)
    marked = marked.select(name("key"), "uri", "payload", name("original"))
    marked.write.format(FORMAT).option("compression", compression).mode("append").save(folder)


def read_pages(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The page records of a folder: key, refers_to as keys again, and the other columns of SCHEMA."""
    register(spark)
    rows = spark.read.format(FORMAT).option("payload", str(payloads).lower()).load(folder)
    pages = rows.where(F.col("record_type").isin(RESPONSE, REVISIT))
    number = lambda c: F.regexp_extract(c, f"^{ID_PREFIX}(-?[0-9]+)$", 1).try_cast("bigint")
    return pages.withColumn("key", number("record_id")).withColumn("refers_to", number("refers_to"))
