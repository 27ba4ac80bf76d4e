"""WARC archives with a two-level capture index.

Writing: one gzip member per record, so that a record can be read by offset and length. A
page whose payload equals that of a page with a smaller id becomes a revisit that names it.
Index: capture lines are sorted by key (host reversed, then path and query) and packed into
compressed blocks; the directory keeps only each block's first key, file, offset and length.
Lines a block grow with the index so that the directory never exceeds ``directory_rows``, and it
holds the first ``KEY_CHARS`` characters of a key, which bounds its bytes too: cutting keeps the
order, so a lookup reads at most a few blocks more.
Lookup: binary search in the directory, range read of the blocks that can hold the key, then
range reads of the records. Each distinct key is looked up once, whatever number of pages
share it.

Executors write through pyarrow's file systems (file, hdfs, s3, gs URIs) into a folder that all
of them share, each attempt of a task under names of its own; only files that a finished task
reports are referenced.

Defined results: a null html is an empty payload; a null url has an empty key and is written as
urn:tessera:none; a page without an id is a response unless an equal payload has an id; equal
payloads under the same id are all responses; records of payloads smaller than ``least_bytes``
are never revisits; no pages give an empty archive. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, Scratch, small_or_salted

NO_URL = "urn:tessera:none"
RECORD = "urn:tessera:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Characters of a key that the directory holds.
KEY_CHARS = 256
_PLAIN = "!#$%&'()*+,/:;=?@[]~|^{}\\\"<>`"  # printable ASCII stands as it is
_HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^#]*)", re.I | re.S)


def key_of(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, without scheme, user, leading www, default port and fragment.
    All but printable ASCII is percent-coded, so that a key is one word of one line."""
    if not url:
        return ""
    clean = quote(url.strip(), safe=_PLAIN, errors="replace")
    found = _HOST.match(clean)
    if not found or not found[1]:
        return clean.partition("#")[0]
    host = re.sub(r"^www\d*\.", "", quote(unquote(found[1]).lower(), safe=_PLAIN).rstrip("."))
    parts = host if host.startswith("[") else ",".join(reversed(host.split(".")))
    port = f":{found[2]}" if found[2] and found[2] not in ("80", "443") else ""
    return f"{parts}{port}){found[3] or '/'}"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A WARC/1.1 response or revisit record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else NO_URL
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{RECORD}{quote(page)}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{RECORD}{quote(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Page id, payload (None for a revisit), its length and digest, type and what it refers to."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or digest_of(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    plain = lambda x: unquote(x[1 + len(RECORD) : -1])
    refers = fields.get("WARC-Refers-To")
    return {
        "page": plain(fields["WARC-Record-ID"]),
        "url": None if fields["WARC-Target-URI"] == NO_URL else fields["WARC-Target-URI"],
        "payload": payload if kind == "response" else None,
        "bytes": length,
        "digest": digest,
        "kind": kind,
        "refers_to": plain(refers) if refers else None,
    }


class _Output:
    """Files of one task attempt; a new one begins when ``limit`` bytes are reached."""

    def __init__(self, base: str, stem: str, suffix: str, limit: int) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(base)
        self.fs.create_dir(self.path, recursive=True)
        context = TaskContext.get()
        self.stem = f"{stem}-{context.partitionId():05d}-{context.taskAttemptId()}"
        self.suffix, self.limit, self.count, self.out = suffix, limit, 0, None

    def write(self, data: bytes) -> tuple[str, int, int]:
        """File name, offset, length."""
        if self.out is not None and self.at + len(data) > self.limit:
            self.close()
        if self.out is None:
            self.name = f"{self.stem}-{self.count:03d}{self.suffix}"
            self.out, self.at, self.count = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None), 0, self.count + 1
        self.out.write(data)
        self.at += len(data)
        return self.name, self.at - len(data), len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class _Input:
    """Range reads; the last file stays open."""

    def __init__(self, base: str) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(base)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.path}/{name}")
        self.file.seek(offset)
        return zlib.decompress(self.file.read(length), 31)


def _gzip(data: bytes, level: int = 6) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


_CAPTURE = "key string, page string, file string, offset long, length long"
_DIRECTORY = "first string, file string, offset long, length long, lines long"


def _archiver(base: str, date: str, limit: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Output(base, "archive", ".warc.gz", limit)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                rows = []
                for row in batch.slice(i, 1000).to_pylist():
                    payload = (row["html"] or "").encode()
                    raw = record(row["page"] or "", row["url"], payload, digest_of(payload), row["refers_to"], date)
                    rows.append((key_of(row["url"]), row["page"] or "", *out.write(_gzip(raw))))
                yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "page", "file", "offset", "length"])
        out.close()

    return write


def _indexer(base: str, lines: int, limit: int):
    """mapInArrow over captures sorted by key: compressed blocks, and their directory."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Output(base, "index", ".cdx.gz", limit)
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            text = "".join(f"{k} {quote(p)} {f} {o} {n}\n" for k, p, f, o, n in held)
            row = (held[0][0][:KEY_CHARS], *out.write(_gzip(text.encode())), len(held))
            held.clear()
            return pa.record_batch([pa.array([x]) for x in row], names=["first", "file", "offset", "length", "lines"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) == lines:
                    yield block()
        if held:
            yield block()
        out.close()

    return write


def _lines(text: bytes) -> Iterator[tuple[str, str, str, int, int]]:
    for line in text.decode().split("\n")[:-1]:
        key, page, file, offset, length = line.split(" ")
        yield key, unquote(page), file, int(offset), int(length)


def write_archives(
    pages: DataFrame,
    base: str,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_bytes: int = 0,
    date: str = "2000-01-01T00:00:00Z",
    file_bytes: int = 1 << 30,
    block_lines: int = 3000,
    directory_rows: int = 200_000,
    broadcast_rows: int = BROADCAST_ROWS,
) -> None:
    """Archives, index blocks and ``directory`` (Parquet) under ``base``."""
    html_bytes = F.coalesce(F.col(html), F.lit("")).cast("binary")
    own = pages.select(
        F.col(page_id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), F.sha1(html_bytes).alias("sha1")
    )
    repeated = (
        pages.select(F.col(page_id).alias("id"), F.sha1(html_bytes).alias("sha1"), F.octet_length(html_bytes).alias("n"))
        .where(F.col("n") >= least_bytes)
        .groupBy("sha1", "n")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c"))
        .where((F.col("c") > 1) & F.col("first").isNotNull())
        .select("sha1", "first")
    )
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string"))
    rows = small_or_salted(own, repeated, ["sha1"], limit=broadcast_rows).select(F.col("id").cast("string").alias("page"), "url", "html", refers.alias("refers_to"))
    captures = rows.mapInArrow(_archiver(base, date, file_bytes), _CAPTURE)
    captures.write.mode("overwrite").parquet(f"{base}/captures")
    captures = pages.sparkSession.read.schema(captures.schema).parquet(f"{base}/captures")
    n = captures.count()
    lines = max(block_lines, -(-2 * n // directory_rows))
    tasks = max(1, min(directory_rows // 4, -(-n // (20 * lines))))
    ordered = captures.repartitionByRange(tasks, "key", "page", "file", "offset").sortWithinPartitions("key", "page", "file", "offset")
    ordered.mapInArrow(_indexer(base, lines, file_bytes), _DIRECTORY).write.mode("overwrite").parquet(f"{base}/directory")


class CaptureIndex:
    """Reads what ``write_archives`` wrote."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base
        rows = spark.read.parquet(f"{base}/directory").orderBy("first", "file", "offset").collect()  # at most directory_rows
        self.directory = [(r["first"], r["file"], r["offset"], r["length"]) for r in rows]

    def blocks_for(self, key: str) -> range:
        """Blocks that can hold the key: from the last that begins before it to the last that begins with it."""
        firsts, key = self._firsts(), key[:KEY_CHARS]
        return range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key))

    def _firsts(self) -> list[str]:
        if not hasattr(self, "_keys"):
            self._keys = [d[0] for d in self.directory]
        return self._keys

    def get(self, url: str) -> list[dict]:
        """All records of one URL, by binary search and range reads."""
        key, source = key_of(url), _Input(self.base)
        found = [x for b in self.blocks_for(key) for x in _lines(source.read(*self.directory[b][1:])) if x[0] == key]
        return [parse(source.read(f, o, n)) for _, _, f, o, n in found]

    def lookup(self, urls: DataFrame) -> DataFrame:
        """``key, page, file, offset, length`` of all captures of the URLs in the first column."""
        shared = self.spark.sparkContext.broadcast(self.directory)
        base = self.base

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            firsts = [d[0] for d in shared.value]
            for batch in batches:
                pairs = [
                    (k, b)
                    for k in {key_of(u) for u in batch.column(0).to_pylist()}
                    for b in range(max(0, bisect_left(firsts, k[:KEY_CHARS]) - 1), bisect_right(firsts, k[:KEY_CHARS]))
                ]
                yield pa.record_batch([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int64())], names=["key", "block"])

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            source, block, held, rows = _Input(base), None, {}, []
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())

            def out() -> pa.RecordBatch:
                columns = list(zip(*rows, strict=True))
                rows.clear()
                return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "page", "file", "offset", "length"])

            for batch in batches:
                for key, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if b != block:
                        block, held = b, {}
                        for x in _lines(source.read(*shared.value[b][1:])):
                            held.setdefault(x[0], []).append(x)
                    rows += held.get(key, ())
                    if len(rows) >= 10_000:  # a URL with many captures fills no batch
                        yield out()
            if rows:
                yield out()

        placed = urls.select(F.col(urls.columns[0]).alias("url")).distinct().mapInArrow(place, "key string, block long").distinct()
        return placed.repartition("block").sortWithinPartitions("block").mapInArrow(fetch, _CAPTURE)

    def read(self, captures: DataFrame) -> DataFrame:
        """The records of ``captures``: ``page, url, payload, bytes, digest, kind, refers_to``; files are read in order."""
        base = self.base

        def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            source = _Input(base)
            kinds = {"page": pa.string(), "url": pa.string(), "payload": pa.binary(), "bytes": pa.int64(), "digest": pa.string(), "kind": pa.string(), "refers_to": pa.string()}
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    part = batch.slice(i, 256).to_pylist()
                    rows = [parse(source.read(r["file"], r["offset"], r["length"])) for r in part]
                    yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))

        ordered = captures.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
        return ordered.mapInArrow(load, "page string, url string, payload binary, bytes long, digest string, kind string, refers_to string")


def archive_and_read(pages: DataFrame, *, url: str = "url", **options) -> DataFrame:
    """Write all pages, look every URL up again and return the records as read back."""
    scratch = Scratch(pages.sparkSession, "warc")
    write_archives(pages, scratch.path, url=url, **options)
    index = CaptureIndex(pages.sparkSession, scratch.path)
    return index.read(scratch.keep(index.lookup(pages.select(url)), "found"))
