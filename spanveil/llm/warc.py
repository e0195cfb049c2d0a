"""WARC archives with a two-level capture index.

Pages become gzip members of WARC files, one file or more for each task, in a
folder that all executors share. Pages with equal payloads are one response and
revisits of it. The capture index has a line for each record, sorted by the URL
with its host reversed; lines are cut into compressed blocks, each index file ends
with a sparse directory of its blocks (first key, place, length), and a table of
the index files with their first and last keys is the level above. A look-up
finds files by their key range, binary-searches a file's directory, reads that
block, and then only the record's bytes.

Files have names of their own for each attempt of a task and are renamed when
complete: a lost executor's half-written files are never read, and a repeated
attempt can't change what the rows of the first refer to.

Defined cases: a null html is an empty payload, a null URL an empty one; control
characters and spaces in URLs are percent-encoded; payloads of any length are
allowed; a row with a null id is archived, and is a response only where no row
with an id has its payload; repeated rows (the same id) are archived each, those
with the smallest id all being responses; an empty table gives no records; other
columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm.repeats import look_up
from spanveil.storage import cut, shared_dir

#: Bytes after which a task begins another archive file; lines of an index block.
FILE_BYTES, BLOCK_LINES = 1 << 30, 1000
#: A record's date, unless another is given, so that reruns agree.
DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def sort_key(url: str) -> str:
    """The URL with its host reversed: ``com,example,www)/path?query``."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}){path}".lower() if host else url


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class _Writer:
    """A file with a name of its own for each attempt, which it gets when it is complete.

    So a second attempt never writes over a file that rows of the first refer to.
    """

    def __init__(self, folder: str, number: int, kind: str):
        self.system, root = _place(folder)
        self.system.create_dir(root, recursive=True)
        self.name = f"{TaskContext.get().partitionId():06d}-{number:04d}-{uuid.uuid4().hex}.{kind}"
        self.final, self.path = f"{root}/{self.name}", f"{root}/_{self.name}"
        self.out, self.at = self.system.open_output_stream(self.path, compression=None), 0

    def write(self, data: bytes) -> int:
        begin = self.at
        self.out.write(data)
        self.at += len(data)
        return begin

    def close(self) -> None:
        self.out.close()
        self.system.move(self.path, self.final)


def _record(page_id: int | None, url: str, payload: bytes, digest: str, size: int, response_id: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = response_id is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    head += [f"WARC-Target-URI: {url}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{response_id}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def plan_records(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """(page_id, url, payload, response_id): response_id is null for responses.

    Payloads are equal when their lengths and SHA-256 digests are.
    """
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("payload"))
    key = F.concat(F.sha2("payload", 256), F.length("payload").cast("string")).alias("key")
    keys = cut(pages.select(F.col(id_col).cast("long").alias("page_id"), body.alias("payload")).select("page_id", key, F.length("payload").alias("size")))
    first = keys.where(F.col("size") >= least).groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    found = look_up(rows.select("*", key), cut(first.where("n > 1")), "key", "n", keys.count())  # only repeated payloads are shuffled
    own = F.col("page_id").eqNullSafe(F.col("first"))
    return found.select("page_id", "url", "payload", F.when(~own, F.col("first")).alias("response_id"))


def write_archives(records: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Write the WARC files of ``plan_records``; (key, page_id, url, file, offset, length, mime type) of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, count = None, 0
        for batch in batches:
            lines: list[tuple] = []
            for page_id, url, payload, response_id in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None or out.at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    out = _Writer(folder, count, "warc.gz")
                    count += 1
                url = _UNSAFE.sub(lambda m: f"%{ord(m.group()):02X}", url)
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                data = _record(page_id, url, payload, digest, len(payload), response_id, date)
                lines.append((sort_key(url), page_id, url, out.name, out.write(data), len(data), digest))
            names = ["key", "page_id", "url", "file", "offset", "length", "digest"]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            columns = zip(*lines, strict=True) if lines else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
        if out is not None:
            out.close()

    return cut(records.mapInArrow(run, "key string, page_id long, url string, file string, offset long, length long, digest string"))


def write_index(captures: DataFrame, folder: str, files: int | None = None) -> DataFrame:
    """Write the capture index; its upper level: (first_key, last_key, file, lines), a row for each index file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, directory, held, lines, first, last = None, [], [], 0, None, None

        def block() -> None:
            data = gzip.compress("\n".join(line for _, line in held).encode(), 6, mtime=0)
            directory.append([held[0][0], out.write(data), len(data), len(held)])
            held.clear()

        for batch in batches:
            for row in batch.to_pylist():
                key = row.pop("key")
                if out is None:
                    out, first = _Writer(folder, 0, "cdxj.gz"), key
                held.append((key, f"{key} {json.dumps(row)}"))
                last, lines = key, lines + 1
                if len(held) == BLOCK_LINES:
                    block()
        if out is None:
            return
        if held:
            block()
        data = gzip.compress(json.dumps(directory).encode(), 6, mtime=0)
        at = out.write(data)
        out.write(at.to_bytes(8, "big"))  # the last bytes tell where the directory begins
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([last]), pa.array([out.name]), pa.array([lines], pa.int64())], names=["first_key", "last_key", "file", "lines"])

    parts = files or int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")
    return cut(ordered.mapInArrow(run, "first_key string, last_key string, file string, lines long"))


class IndexFile:
    """Blocks of one index file, read by range."""

    def __init__(self, folder: str, name: str):
        system, root = _place(folder)
        self.file = system.open_input_file(f"{root}/{name}")
        size = self.file.size()
        at = int.from_bytes(self.file.read_at(8, size - 8), "big")
        self.directory = json.loads(gzip.decompress(self.file.read_at(size - 8 - at, at)))
        self.keys = [entry[0] for entry in self.directory]
        self.last: tuple | None = None

    def block(self, i: int) -> Iterator[tuple[str, dict]]:
        _, at, length, _ = self.directory[i]
        for line in gzip.decompress(self.file.read_at(length, at)).decode().split("\n"):
            key, _, rest = line.partition(" {")
            yield key, json.loads("{" + rest)

    def _keys_and_entries(self, i: int) -> tuple[list[str], list[dict]]:
        """A block; the last one that was read is kept, as look-ups come in order."""
        if self.last is None or self.last[0] != i:
            keys, entries = zip(*self.block(i), strict=True)
            self.last = i, (list(keys), list(entries))
        return self.last[1]

    def find(self, key: str) -> Iterator[list[dict]]:
        """The captures of a key, block by block, from the one before the first that begins at it or beyond."""
        i = max(0, bisect.bisect_left(self.keys, key) - 1)
        while i < len(self.keys) and self.keys[i] <= key:
            keys, entries = self._keys_and_entries(i)
            if found := entries[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
                yield found
            i += 1


_ENTRY = "page_id long, url string, file string, offset long, length long, digest string"


def _entries(rows: list[dict]) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in kinds], names=[n for n, _ in kinds])


def all_captures(upper: DataFrame, folder: str) -> DataFrame:
    """Every entry of the index, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                index = IndexFile(folder, name)
                for i in range(len(index.keys)):
                    yield _entries([entry for _, entry in index.block(i)])

    return upper.select("file").mapInArrow(run, _ENTRY)


def find_captures(urls: DataFrame, upper: DataFrame, folder: str, url: str = "url") -> DataFrame:
    """The entries of the URLs in ``urls``, by look-up in the two levels of the index.

    The upper level (a row for each index file, of which there are as many as shuffle
    partitions at most) goes to every task; a null URL is an empty one.
    """
    level = sorted(tuple(r) for r in upper.select("first_key", "last_key", "file").collect())
    firsts, lasts = [x[0] for x in level], [x[1] for x in level]  # files cover ranges one after the other

    def key_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [sort_key(_UNSAFE.sub(lambda m: f"%{ord(m.group()):02X}", x or "")) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], names=["key"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(level[i][2], key) for key in batch.column(0).to_pylist() for i in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in range(2)], names=["file", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, IndexFile] | None = None
        for batch in batches:
            for name, key in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                if opened is None or opened[0] != name:
                    opened = name, IndexFile(folder, name)
                for k in opened[1].find(key):
                    yield _entries(k)

    keys = urls.select(url).distinct().mapInArrow(key_of, "key string").distinct()
    met = keys.mapInArrow(place, "file string, key string")
    return met.repartitionByRange("file", "key").sortWithinPartitions("file", "key").mapInArrow(run, _ENTRY)


def parse_record(data: bytes) -> dict:
    """Headers and payload of one gzip member."""
    head, _, block = zlib.decompress(data, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    fields["size"] = int(re.search(rb"Content-Length: (\d+)", http)[1])
    fields["payload"] = payload
    return fields


def read_records(entries: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload]) by range reads.

    A response whose payload has another length or digest than its record says is an error.
    """
    number = re.compile(r"<urn:page:(-?\d*)>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _place(folder)
        opened: tuple[str, pa.NativeFile] | None = None
        for batch in batches:
            rows: list[tuple] = []
            for name, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if opened is None or opened[0] != name:
                    opened = name, system.open_input_file(f"{root}/{name}")
                x = parse_record(opened[1].read_at(length, offset))
                digest = x["WARC-Payload-Digest"].removeprefix("sha1:")
                if x["WARC-Type"] == "response":
                    if base64.b32encode(hashlib.sha1(x["payload"]).digest()).decode() != digest or len(x["payload"]) != x["size"]:
                        raise ValueError(f"{name} at {offset}: the payload doesn't fit its digest")
                ids = [int(m[1]) if (m := number.match(x.get(k, ""))) and m[1] else None for k in ("WARC-Record-ID", "WARC-Refers-To")]
                rows.append((ids[0], x["WARC-Target-URI"], x["WARC-Type"], x["size"], digest, ids[1], *([x["payload"]] if with_payload else [])))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), *([pa.binary()] if with_payload else [])]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"][: len(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = entries.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload
    return ordered.mapInArrow(run, schema)


def new_archive(spark: SparkSession) -> str:
    """A folder of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
