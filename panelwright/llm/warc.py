"""WARC archives: a Python data source that writes and reads them.

`record_types` gives equal payloads one `response` record and a `revisit` record for every other page. The writer makes
files of about FILE_BYTES, each record a gzip member of its own, with the members' offsets in a file beside it, and
lists what was written when the job commits; files of lost or repeated task attempts are never listed.

The reader plans partitions of about SPLIT_BYTES of a file with offsets, and one for any other file. It takes equality
and membership filters on `record_type`, `target_uri`, `payload_digest`, `record_id` and `refers_to`, and decides them
by a record's headers, for which it inflates the beginning of a member alone. It steps over the rest of a record that it
doesn't return, or whose payload isn't asked for: to the next member's offset, by a seek in plain files, by inflating and
dropping in gzip files of others.

Defined results: a null html is the empty payload, a null url leaves out the target header. Of equal
payloads the largest page_id is the response (all rows with it, if it repeats); null ids come last and
are responses only among themselves. Payloads below min_bytes are all responses. Other columns are dropped.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from panelwright.llm.common import open_shared, shared_path, ship, stored

VERSION = b"WARC/1.0"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
#: WARC header names by column of the reader.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_bytes bigint, computed_digest string, payload binary, file string"
#: What the writer takes: digests are hexadecimal SHA-1, a null body is that of a revisit.
RECORD_COLUMNS = ("page", "url", "digest", "response", "body")
URN = "urn:page:"
FILE_BYTES = 1 << 30
SPLIT_BYTES = 1 << 26
#: Bytes of a member that are inflated at a time while its headers are read.
HEAD_BYTES = 1024
#: Compressed bytes of a record that are read at a time.
READ_BYTES = 1 << 14
_CONTROL = re.compile(r"[\x00-\x1F\x7F]")


def record_types(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", min_bytes: int = 0) -> DataFrame:
    """(page, url, digest, response, body): response is the key that a revisit refers to, null for responses; revisits have no body."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    marked = pages.select(F.col(key).alias("page"), F.col(url).alias("url"), body.alias("body")).withColumn("digest", F.sha1("body"))
    sizes = marked.withColumn("size", F.octet_length("body"))
    newest = sizes.groupBy(F.col("digest").alias("of"), "size").agg(F.max("page").alias("newest"), F.count(F.lit(1)).alias("copies"))
    repeated = newest.filter((F.col("copies") > 1) & (F.col("size") >= min_bytes)).select("of", "newest")
    joined = marked.join(repeated, F.col("digest") == F.col("of"), "left")
    other = F.col("newest").isNotNull() & ~F.col("page").eqNullSafe(F.col("newest"))
    return joined.select("page", "url", "digest", F.when(other, F.col("newest")).alias("response"), F.when(~other | other.isNull(), F.col("body")).alias("body"))


def record_bytes(page: object, url: str | None, digest: str, response: object, body: bytes | None) -> bytes:
    """One record; control characters of a url can't break its header line."""
    content = HTTP_HEAD + (body or b"")
    fields = [
        (HEADERS["record_type"], "response" if body is not None else "revisit"),
        (HEADERS["record_id"], f"<{URN}{'' if page is None else page}>"),
        ("WARC-Date", DATE),
        (HEADERS["target_uri"], None if url is None else _CONTROL.sub("%20", url)),
        (HEADERS["payload_digest"], "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        (HEADERS["refers_to"], None if response is None else f"<{URN}{response}>"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(content))),
    ]
    lines = [f"{name}: {value}\r\n".encode() for name, value in fields if value is not None]
    return b"".join([VERSION, b"\r\n", *lines, b"\r\n", content, b"\r\n\r\n"])


@dataclass
class _Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Rows of record_types as records, each a gzip member (option compression: gzip) or as it is (none)."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, sink, name, offsets, at = [], None, "", [], 0
        store, root = open_shared(self.path)
        store.create_dir(root, recursive=True)

        def close() -> None:
            sink.close()
            with store.open_output_stream(f"{root}/_{name}.offsets") as side:
                side.write(np.array([*offsets, at], "<u8").tobytes())
            files.append({"name": name, "size": at, "records": len(offsets)})

        for batch in iterator:
            for row in zip(*[batch.column(c).to_pylist() for c in RECORD_COLUMNS]):
                if sink is None:
                    name, offsets, at = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip, [], 0
                    sink = store.open_output_stream(f"{root}/{name}", compression=None)
                record = record_bytes(*row)
                if self.gzip:
                    member = zlib.compressobj(6, zlib.DEFLATED, 31)
                    record = member.compress(record) + member.flush()
                sink.write(record)
                offsets.append(at)
                at += len(record)
                if at >= self.file_bytes:
                    close()
                    sink = None
        if sink is not None:
            close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = open_shared(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as sink:
            sink.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        """Files that no manifest lists are never read."""


class _Slice(InputPartition):
    """The records of a file that begin in [start, stop); stop None: a file without offsets, whole."""

    def __init__(self, uri: str, start: int = 0, stop: int | None = None):
        self.uri, self.start, self.stop = uri, start, stop


class _Member:
    """A gzip member that is read and inflated as far as it is asked for. `taken` and `inflated` count bytes, for tests."""

    taken = inflated = 0

    def __init__(self, file: io.BufferedReader, size: int):
        self.file, self.left = file, size
        self.inflater, self.rest, self.buffer = zlib.decompressobj(31), b"", b""

    def upto(self, size: int) -> bytes:
        """The buffer, with at least size bytes if the member has so many."""
        while len(self.buffer) < size and not self.inflater.eof:
            if not self.rest:
                self.rest = self.file.read(min(self.left, READ_BYTES))
                self.left -= len(self.rest)
                _Member.taken += len(self.rest)
            part = self.inflater.decompress(self.rest, size - len(self.buffer))
            self.rest = self.inflater.unconsumed_tail
            if not part and not self.rest and not self.left:
                break
            self.buffer += part
            _Member.inflated += len(part)
        return self.buffer

    def head(self) -> bytes:
        """The bytes to the end of the record's headers, and some more."""
        size = HEAD_BYTES
        while (end := self.upto(size).find(b"\r\n\r\n")) < 0 and len(self.buffer) >= size:
            size *= 2
        if end < 0:
            raise ValueError(f"no end of headers: {self.buffer[:60]!r}")
        return self.buffer[: end + 4]


def _fields(lines: Iterable[bytes], uri: str) -> tuple[dict[str, str | None], int]:
    """(columns, length of the content) from a record's header lines."""
    lines = iter(lines)
    first = next(lines)
    if not first.startswith(b"WARC/"):
        raise ValueError(f"{uri}: not a WARC record: {first[:60]!r}")
    headers = {}
    for line in lines:
        name, _, value = line.partition(b":")
        headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    fields = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        fields[c] = fields[c] and fields[c].strip("<>")
    fields["payload_digest"] = fields["payload_digest"] and fields["payload_digest"].removeprefix("sha1:")
    return fields, int(headers["content-length"])


def _row(fields: dict, block: bytes | None, payload: str, uri: str) -> tuple:
    """A row of SCHEMA; block is the record's content where it was read."""
    size = computed = body = None
    if block is not None:
        body = block[block.find(b"\r\n\r\n") + 4 :]
        size, computed = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
    return (*[fields[c] for c in ("record_id", "record_type", "target_uri", "payload_digest", "refers_to")], size, computed, body if payload == "full" else None, uri)


def read_slice(part: _Slice, wanted: dict[str, set], payload: str) -> Iterator[tuple]:
    """Rows of SCHEMA for the records whose headers are in wanted; payload is none, digest or full."""
    store, path = open_shared(part.uri)
    if part.stop is None:
        yield from _read_whole(store, path, part.uri, wanted, payload)
        return
    folder, _, name = path.rpartition("/")
    with store.open_input_stream(f"{folder}/_{name}.offsets") as side:
        offsets = np.frombuffer(side.read(), "<u8").astype(np.int64)
    own = np.flatnonzero((offsets[:-1] >= part.start) & (offsets[:-1] < part.stop))
    with store.open_input_file(path) as source:
        file = io.BufferedReader(source, 1 << 16)
        for at, end in zip(offsets[own].tolist(), offsets[own + 1].tolist()):
            file.seek(at)
            member = _Member(file, end - at)
            head = member.head()
            fields, size = _fields(head[:-4].split(b"\r\n"), part.uri)
            if all(fields[c] in values for c, values in wanted.items()):
                block = None if payload == "none" else member.upto(len(head) + size)[len(head) : len(head) + size]
                yield _row(fields, block, payload, part.uri)


def _read_whole(store, path: str, uri: str, wanted: dict[str, set], payload: str) -> Iterator[tuple]:
    """The records of a file without offsets, plain or gzip."""
    with store.open_input_file(path) as source:
        lines = io.BufferedReader(gzip.GzipFile(fileobj=source) if path.endswith(".gz") else source, 1 << 18)
        while first := lines.readline():
            if not first.rstrip(b"\r\n"):
                continue
            head = [first]
            while line := lines.readline().rstrip(b"\r\n"):
                head.append(line)
            fields, size = _fields(head, uri)
            if payload == "none" or any(fields[c] not in values for c, values in wanted.items()):
                block = None
                lines.seek(size, io.SEEK_CUR)
            else:
                block = lines.read(size)
            if all(fields[c] in values for c, values in wanted.items()):
                yield _row(fields, block, payload, uri)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.payload = options.get("payload", "digest")
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, In)):
                values = set(f.value if isinstance(f, In) else [f.value])
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self):
        """Of a folder that this source has written, what its manifests list; of any other, all its files."""
        from pyarrow import fs

        store, path = open_shared(self.path)
        names = sorted(i.base_name for i in store.get_file_info(fs.FileSelector(path, recursive=False)) if i.is_file)
        manifests = [n for n in names if n.startswith("_manifest-")]
        out = []
        for manifest in manifests:
            with store.open_input_stream(f"{path}/{manifest}") as source:
                for file in json.loads(source.read()):
                    uri, indexed = f"{self.path}/{file['name']}", file["name"].endswith(".gz")
                    out += [_Slice(uri, a, a + self.split_bytes) for a in range(0, file["size"], self.split_bytes)] if indexed else [_Slice(uri)]
        if not manifests:
            out = [_Slice(f"{self.path}/{n}") for n in names if n[0] not in "._"]
        return out or [_Slice("")]

    def read(self, partition):
        if not partition.uri:
            return
        kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, SCHEMA.split(", "))])
        rows, held = [], 0
        for row in read_slice(partition, self.wanted, self.payload):
            rows.append(row)
            held += len(row[7] or b"")
            if len(rows) >= 8192 or held >= 1 << 24:
                yield _as_batch(rows, schema)
                rows, held = [], 0
        if rows:
            yield _as_batch(rows, schema)


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder), option payload (none, digest, full); df.write.format("warc").mode("append").save(folder)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(self.options)


def _registered(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write(records: DataFrame, folder: str, **options) -> None:
    """Appends the rows of record_types to a folder of WARC files."""
    _registered(records.sparkSession)
    records.select(*RECORD_COLUMNS).write.format("warc").options(**options).mode("append").save(folder)


def read(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The records of a folder of WARC files. Filters on header columns reach the reader."""
    _registered(spark)
    return spark.read.format("warc").options(**options).load(folder)


def archive_and_read(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", min_bytes: int = 0, **options) -> DataFrame:
    """pages written as archives in the shared folder and read back: (key, payload_bytes, payload_digest, record_type, refers_to).

    Responses are read with their payloads: a digest is computed from the payload and must be the one in the header.
    Revisits are read by their headers alone; their payload is as long as that of the response of the same digest.
    """
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    write(record_types(pages, key, html, url, min_bytes), folder, **options)
    kind = pages.schema[key].dataType.simpleString()
    page = lambda c: F.nullif(F.substring(c, len(URN) + 1, 100), F.lit("")).cast(kind)
    columns = ["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    digest = F.when(F.col("computed_digest") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged payload of "), "record_id")))
    responses = read(spark, folder, payload="digest").filter("record_type = 'response'").withColumn("payload_digest", digest)
    responses = stored(responses.select(*columns), "warc-responses")
    # Stored, so that the join has a plain exchange on each side and the revisits of one digest can be split.
    lengths = stored(responses.groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes")), "warc-lengths")
    revisits = read(spark, folder, payload="none").filter("record_type = 'revisit'").drop("payload_bytes").join(lengths, "payload_digest")
    records = responses.unionByName(revisits.select(*columns))
    return records.select(page("record_id").alias(key), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
