"""WARC archives of pages with a two-level capture index.

``write`` puts a record per page into gzip-member archives; ``build_index`` sorts the captures by reversed-host URL keys into compressed
blocks of BLOCK captures and keeps a sparse directory with each block's first capture; ``lookup`` finds the captures of asked keys by
binary search in the directory, a range read of one block after another and binary search within it; ``read`` fetches records by
range reads and checks their digests.

Both levels are dealt by ranges: each index file has its own directory behind its blocks, and only the first capture of each file
(one row a file, MAX_FILES at most) is sent to all tasks. A key whose captures fill many blocks or files is read from all of them.

Files lie in the session's shared folder, in any file system that pyarrow opens by URI. They are written under another name and
moved when they are whole, and only files named in the captures count, so a task that is repeated does no harm.

Defined cases: a null or empty payload has length 0 and is a payload like others; a null URL has no target URI and an empty key; of
equal payloads of at least ``least`` bytes the record of the largest page_id is the response and the others revisit it; rows that
repeat that id are responses too, null ids come below all others and, where there is no other, are responses; an empty table
writes no archives; other columns are not looked at. Characters that a header can't hold are percent-encoded in the target URI.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, join_groups, shared_path, written

#: Captures of a compressed block, and index files at most.
BLOCK, MAX_FILES = 1024, 4096
#: Captures of an index file, bytes of an archive file before the next begins, bytes of an archive that are read together, and records of
#: a task that reads.
FILE_ROWS, ARCHIVE_BYTES, READ_BYTES = 1_000_000, 1 << 30, 16 << 20
READ_RECORDS = 10_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "Page-Id"  # extension field: the row's number
_FULL = "Payload-Length"  # extension field: bytes of the full payload, which a revisit doesn't hold
_CAPTURE = "key string, page_id long, file string, offset long, length long, kind string"
_FIELDS = ["key", "page_id", "file", "offset", "length", "kind"]


_PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))


def target_uri(url: str | None) -> str:
    """The URL as a header holds it: other characters than printable ASCII are percent-encoded."""
    return quote(url or "", safe=_PRINTABLE)


def url_key(url: str | None) -> str:
    """The host's labels in reverse with commas, ``)``, then path and query in lower case: pages of a domain stand together.
    A URL and its target URI have one key, in ASCII without white space."""
    url = target_uri(url)
    try:
        parts = urlparse(url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:  # no such port or host
        return url.lower()
    if not host:
        return url.lower()
    tail = (parts.path or "/") + (f";{parts.params}" if parts.params else "") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + tail.lower()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the key of the last column, a URL."""
    for batch in batches:
        yield batch.append_column("key", pa.array([url_key(u) for u in batch.column(batch.num_columns - 1).to_pylist()], pa.string()))


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload_digest}')}>"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers: tuple[int | None, str | None] | None, date: str = DATE) -> bytes:
    """One record: a response with the payload, or a revisit of ``refers`` (page_id, url) without it."""
    digest = _digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    head += [("WARC-Target-URI", target_uri(url))] * (url is not None) + [("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers[0], digest)), ("WARC-Refers-To-Date", date)] + [("WARC-Refers-To-Target-URI", target_uri(refers[1]))] * (refers[1] is not None)
        head += [(f"Refers-To-{_PAGE}", refers[0])]
    head += [(_PAGE, page_id)] * (page_id is not None) + [(_FULL, len(payload)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record starts here")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class _Part:
    """A file that gets its name when it is whole."""

    def __init__(self, base: str, kind: str) -> None:
        self.fs, folder = _store(base)
        self.fs.create_dir(folder, recursive=True)
        self.name = f"{kind}-{uuid.uuid4().hex}"
        self.path, self.hidden, self.size = f"{folder}/{self.name}", f"{folder}/.{self.name}", 0
        self.out = self.fs.open_output_stream(self.hidden, compression=None)

    def put(self, data: bytes) -> int:
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.hidden, self.path)


@dataclass(frozen=True)
class Archive:
    base: str
    captures: DataFrame


@dataclass(frozen=True)
class Index:
    """``files``: (name, rows, directory offset, its length, first capture) of each index file, in order."""

    base: str
    files: list[tuple]


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = DATE) -> Archive:
    """Archives of all pages in the shared folder, and their captures (key, page_id, file, offset, length, kind)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("same", F.unhex(F.sha2("payload", 256)))
    small = written(rows.select("page_id", "url", "same", F.octet_length("payload").alias("bytes")), "payloads")
    groups = small.where(F.col("bytes") >= least).groupBy("same").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("first")).where("n > 1")
    base = shared_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for batch in in_slices(batches, "payload", 8_000_000):
            found = []
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "n", "first_id", "first_url")]
            payloads = columns[2].cast(pa.large_binary())
            for page_id, url, payload, n, first_id, first_url in zip(columns[0].to_pylist(), columns[1].to_pylist(), payloads, *(c.to_pylist() for c in columns[3:]), strict=True):
                if part is not None and part.size >= ARCHIVE_BYTES:
                    part.close()
                    part = None
                part = part or _Part(base, "pages.warc.gz")
                refers = (first_id, first_url) if n is not None and page_id != first_id else None
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = member.compress(record(page_id, url, payload.as_py(), refers, date)) + member.flush()
                found.append((url_key(url), page_id, part.name, part.put(data), len(data), "revisit" if refers else "response"))
            yield _batch(found)
        if part is not None:
            part.close()

    joined = join_groups(rows, written(groups, "payload-groups"), "same", small.count())
    flat = joined.select("page_id", "url", "payload", "n", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    return Archive(base, written(flat.mapInArrow(run, _CAPTURE), "captures"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], _FIELDS)


def _line(row: tuple) -> str:
    return "\t".join("" if x is None else str(x) for x in row)


def _row(line: str) -> tuple:
    key, page_id, file, offset, length, kind = line.split("\t")
    return key, int(page_id) if page_id else None, file, int(offset), int(length), kind


def build_index(archive: Archive, block: int = BLOCK) -> Index:
    """Sorts the captures by key into blocks; a task writes the file of its range."""
    spark = archive.captures.sparkSession
    base = shared_path(spark, "captures")
    ranges = min(MAX_FILES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-archive.captures.count() // FILE_ROWS)))
    order = ["key", "page_id", "file", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, entries, rows = None, [], [], 0

        def flush() -> None:
            data = zlib.compress("\n".join(map(_line, held)).encode(), 6)
            entries.append(f"{_line(held[0])}\t{part.put(data)}\t{len(data)}")
            held.clear()

        first = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = part or _Part(base, "captures.idx")
                first = row[0] if first is None else first
                held.append(row)
                rows += 1
                if len(held) == block:
                    flush()
        if part is not None:
            if held:
                flush()
            data = zlib.compress("\n".join(entries).encode(), 6)
            at = part.put(data)
            part.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part.name, rows, at, len(data), first, row[0])], ["name", "n", "at", "length", "first", "last"])

    sorted_rows = archive.captures.select(*_FIELDS).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    files = written(sorted_rows.mapInArrow(run, "name string, n long, at long, length long, first string, last string"), "index-files")
    return Index(base, sorted((tuple(r) for r in files.collect()), key=lambda r: r[4:]))


class _Reader:
    """Directories and blocks of an index file by range reads."""

    def __init__(self, base: str, name: str, at: int, length: int) -> None:
        fs, folder = _store(base)
        self.file = fs.open_input_file(f"{folder}/{name}")
        self.entries = [x.rsplit("\t", 2) for x in self._text(at, length).split("\n")]
        self.firsts = [_row(e[0])[0] for e in self.entries]
        self.block: tuple[int, list[str], list[tuple]] = (-1, [], [])

    def _text(self, at: int, length: int) -> str:
        self.file.seek(at)
        return zlib.decompress(self.file.read(length)).decode()

    def _load(self, k: int) -> None:
        if self.block[0] != k:
            rows = [_row(x) for x in self._text(*map(int, self.entries[k][1:])).split("\n")]
            self.block = (k, [r[0] for r in rows], rows)

    def captures(self, key: str) -> Iterator[tuple]:
        for k in range(max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)):
            self._load(k)
            yield from self.block[2][bisect_left(self.block[1], key) : bisect_right(self.block[1], key)]


def lookup(index: Index, keys: DataFrame) -> DataFrame:
    """The captures of distinct ``keys`` (key), each with all columns of a capture."""
    if not index.files:
        return keys.sparkSession.createDataFrame([], _CAPTURE)
    firsts, lasts = [f[4] for f in index.files], [f[5] for f in index.files]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(key, k) for key in batch.column(0).to_pylist() for k in range(bisect_left(lasts, key), bisect_right(firsts, key))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.string()), pa.array([k for _, k in own], pa.int32())], ["key", "file"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last, found = None, None, []
        for batch in batches:
            for k, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != last:
                    name, _, at, length, *_ = index.files[k]
                    reader, last = _Reader(index.base, name, at, length), k
                for row in reader.captures(key):
                    found.append(row)
                    if len(found) == 4096:
                        yield _batch(found)
                        found = []
        yield _batch(found)

    routed = keys.select("key").distinct().mapInArrow(route, "key string, file int")
    return routed.select("file", "key").repartitionByRange(len(index.files), "file", "key").sortWithinPartitions("file", "key").mapInArrow(run, _CAPTURE)


_RECORD = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "refers_to_url": pa.string(), "payload": pa.binary()}


def _read(member: bytes) -> tuple:
    fields, payload = parsed(zlib.decompress(member, 31))
    digest, kind, full = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], int(fields[_FULL])
    if kind == "response" and (_digest(payload) != digest or len(payload) != full):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't what its header says")
    number = lambda name: int(fields[name]) if name in fields else None
    return number(_PAGE), fields.get("WARC-Target-URI"), full, digest, kind, number(f"Refers-To-{_PAGE}"), fields.get("WARC-Refers-To-Target-URI"), None if kind == "revisit" else payload


def read(archive: Archive, captures: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of captures: page_id, url (target URI), payload_bytes, payload_digest, record_type, refers_to, refers_to_url, and with
    ``payloads`` the payload (null for revisits). A payload that doesn't have its digest is an error."""
    base = archive.base
    names = [*_RECORD][: 7 + payloads]

    def records(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _RECORD[c]) for k, c in enumerate(names)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _store(base)
        file, last = None, None
        for batch in batches:
            rows, size = [], 0
            for name, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != last:
                    file, last = fs.open_input_file(f"{folder}/{name}"), name
                file.seek(at)
                rows.append(_read(file.read(length))[: len(names)])
                size += rows[-1][2]
                if size > 8_000_000:
                    yield records(rows)
                    rows, size = [], 0
            yield records(rows)

    # By what is read from the archives, which rows of captures don't show: about READ_RECORDS records a task.
    tasks = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-archive.captures.count() // READ_RECORDS))
    near = captures.select("file", "offset", "length").repartition(tasks, "file", F.expr(f"offset div {READ_BYTES}")).sortWithinPartitions("file", "offset")
    return near.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_to_url string" + ", payload binary" * payloads)


def resolved(archive: Archive, index: Index, revisits: DataFrame) -> DataFrame:
    """(page_id, payload, payload_digest) of the responses that revisits (refers_to, refers_to_url) point to, each once, by the index."""
    asked = revisits.select("refers_to", "refers_to_url").distinct().mapInArrow(_keys, "refers_to long, refers_to_url string, key string").select("refers_to", "key")
    captures = lookup(index, asked).where("kind = 'response'").join(asked, "key").where("page_id = refers_to")
    return read(archive, captures, payloads=True).select("page_id", "payload", "payload_digest")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Writes archives of all pages, indexes them, and reads every record back by the keys of the pages' URLs."""
    archive = write(pages, id_col, url_col, payload_col, least)
    asked = pages.select(F.col(url_col).cast("string").alias("url")).distinct().mapInArrow(_keys, "url string, key string")
    return read(archive, lookup(build_index(archive), asked))
