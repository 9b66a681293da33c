"""WARC archives with revisit resolution.

1. Every page is written as a response record into gzip archives, one gzip
   member per record, as other WARC tools expect them.
2. The archives' headers are read back, with each record's place in its file.
3. Headers alone shuffle, by payload digest, to find the original of each group
   of equal payloads; the other records of a group become revisits of it.  The
   rows of a large group stay dealt over many slots.
4. The decisions return to the files they came from.  A task reads the payloads
   of the responses at their places, and writes new archives with fresh
   headers.  No payload goes through a shuffle, and those of revisits aren't
   read again.

Tasks write files under names of their own into a temporary folder; only those
that finished tasks report are moved into place, so a lost task leaves nothing
behind.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import each_slot, occupied, slices, slot_of, written

#: Fixed values of the format: line and block ends, and the profile of revisits.
LINE, END = b"\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
#: Compressed bytes of an archive, about.
FILE_BYTES = 64_000_000
#: Bytes read at a time, bytes of pages in a slice, and the effort of compression.
READ_BYTES, CHUNK_BYTES, LEVEL = 1 << 15, 4_000_000, 4

HEADERS = "file string, place long, length long, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long"
SCHEMA = pa.schema([("file", pa.string()), ("place", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64())])
MANIFEST = pa.schema([("file", pa.string()), ("records", pa.int64())])


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, of: bytes) -> str:
    """A version 8 UUID that holds the page's id: 64 bits of it, one that tells whether there is one, and 57 bits of a hash."""
    number = 0 if page_id is None else page_id & ((1 << 64) - 1)
    mark = int.from_bytes(hashlib.sha1(of).digest()[:8], "big") >> 7 | (page_id is not None) << 57
    value = (number >> 16) << 80 | 8 << 76 | (number >> 4 & 0xFFF) << 64 | 2 << 62 | (number & 0xF) << 58 | mark
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def page_of(name: str | None) -> int | None:
    """The page's id in a record id; null for none and for records of other makers."""
    if not name or not name.startswith("<urn:uuid:"):
        return None
    value = uuid.UUID(name[10:].rstrip(">")).int
    if value >> 76 & 0xF != 8 or not value >> 57 & 1:
        return None
    number = (value >> 80) << 16 | (value >> 64 & 0xFFF) << 4 | value >> 58 & 0xF
    return number - (1 << 64) if number >> 63 else number


def record(lines: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*lines, ("Content-Length", str(len(block)))])
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(b"".join([head.encode(), LINE, block, END])) + pack.flush()


def page_record(page_id: int | None, url: str, digest: str, size: int, date: str, payload: bytes | None, refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """The record of a page: a response, or without payload a revisit of the page ``refers_to``."""
    lines = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, f"{url} {digest}".encode())),
        ("WARC-Target-URI", url),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if payload is None:
        lines += [("WARC-Refers-To", record_id(refers_to, f"{refers_url} {digest}".encode())), ("WARC-Refers-To-Target-URI", refers_url or ""), ("WARC-Refers-To-Date", date), ("WARC-Profile", PROFILE)]
    lines.append(("Content-Type", "application/http; msgtype=response"))
    return record(lines, f"{HTTP}{size}".encode() + END + (payload or b""))


def clean_url(url: str | None) -> str:
    """White space and control characters as %20; urn:x-none for a missing URL."""
    return "".join("%20" if c <= " " or c == "\x7f" else c for c in url) if url is not None else "urn:x-none"


class Archives:
    """Archives that a task writes one after another."""

    def __init__(self, folder: str, date: str):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.date, self.out, self.made = date, None, []

    def add(self, member: bytes) -> None:
        if self.out is None:
            name = f"{uuid.uuid4().hex}.warc.gz"
            self.out = self.fs.open_output_stream(f"{self.folder}/{name}", compression=None)
            self.made.append([name, 0])
            self.out.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: rankweave\r\nformat: WARC File Format 1.1\r\n"))
        self.out.write(member)
        self.made[-1][1] += 1
        if self.out.tell() >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None

    def manifest(self) -> pa.RecordBatch:
        self.close()
        return pa.RecordBatch.from_arrays([pa.array([m[i] for m in self.made], f.type) for i, f in enumerate(MANIFEST)], schema=MANIFEST)


def _write_pages(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    out = Archives(folder, date)
    for part in slices(batches, "html", CHUNK_BYTES):
        for page_id, url, html in zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), part.column("html").cast(pa.binary())):
            payload = html.as_py() or b""
            out.add(page_record(page_id, clean_url(url), digest_of(payload), len(payload), date, payload))
    yield out.manifest()


def _move(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    fs, at = pafs.FileSystem.from_uri(path)
    for batch in batches:
        for name in batch.column("file").to_pylist():
            if fs.get_file_info(f"{at}/{name}").type == pafs.FileType.NotFound:  # a task that runs again finds some moved
                fs.move(f"{at}/_temporary/{name}", f"{at}/{name}")
        yield batch


def _committed(rows: DataFrame, write, path: str, date: str) -> None:
    """Let tasks write archives of ``rows``, and move those of finished tasks under ``path``."""
    fs, at = pafs.FileSystem.from_uri(path)
    fs.create_dir(f"{at}/_temporary")
    folder, kinds = f"{path}/_temporary", "file string, records long"
    made = written(rows.mapInArrow(lambda it: write(it, folder, date), kinds), "archives")
    made.mapInArrow(lambda it: _move(it, path), kinds).count()
    fs.delete_dir(f"{at}/_temporary")


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None) -> None:
    """Write every page as a response record to archives under ``path``; ``date`` (now, by default) is the records' date."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    _committed(rows, _write_pages, path, date or _now())


def members(f: pa.NativeFile) -> Iterator[tuple[int, int, bytes]]:
    """(place, length, bytes) of each gzip member of a file, one at a time."""
    place, rest = 0, b""
    while rest or (rest := f.read(READ_BYTES)):
        unpack, parts, length = zlib.decompressobj(31), [], 0
        while True:
            parts.append(unpack.decompress(rest))
            length += len(rest) - len(unpack.unused_data)
            if unpack.eof:
                rest = unpack.unused_data
                break
            if not (rest := f.read(READ_BYTES)):
                raise ValueError("an archive ends within a record")
        yield place, length, b"".join(parts)
        place += length


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = data.partition(END)
    named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])}
    size = int(named["content-length"])
    if rest[size:] != END:
        raise ValueError(f"record {named.get('warc-record-id')} doesn't end where its length says")
    return named, rest[:size]


def _payload(named: dict[str, str], block: bytes, verify: bool) -> tuple[int, bytes]:
    """The length of the full payload, and what the record holds of it."""
    http, _, payload = block.partition(END)
    if named["warc-type"] == "revisit":
        told = dict(x.partition(b":")[::2] for x in http.lower().split(LINE)[1:])
        return int(told[b"content-length"]), payload
    if verify and f"sha1:{digest_of(payload)}" != named["warc-payload-digest"]:
        raise ValueError(f"record {named.get('warc-record-id')} has another payload than its digest says")
    return len(payload), payload


def _read(batches: Iterator[pa.RecordBatch], verify: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            fs, at = pafs.FileSystem.from_uri(path)
            rows = []
            with fs.open_input_stream(at, compression=None) as f:
                for place, length, data in members(f):
                    named, block = parsed(data)
                    if named["warc-type"] in ("response", "revisit"):
                        size, _ = _payload(named, block, verify)
                        rows.append((path, place, length, page_of(named["warc-record-id"]), named["warc-target-uri"], named["warc-type"], named["warc-payload-digest"].removeprefix("sha1:"), size, page_of(named.get("warc-refers-to"))))
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SCHEMA)], schema=SCHEMA)


def read_headers(spark: SparkSession, path: str, verify: bool = False) -> DataFrame:
    """One row per response or revisit under ``path``: file, place, length, page_id, url, record_type, payload_digest, payload_bytes, refers_to.

    ``verify`` holds each response's payload against its digest.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path")
    return files.mapInArrow(lambda it: _read(it, verify), HEADERS)


def resolve_revisits(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``headers`` with refers_to and refers_url set where an equal payload of at least ``least_bytes`` has a smaller page_id.

    Only digests of two or more records take part in the join.
    """
    rows = headers.drop("refers_to").withColumn("slot", slot_of("file", "place"))
    original = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    parts = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "slot").agg(original.alias("original"), F.count("*").alias("n"))
    groups = parts.groupBy("payload_digest").agg(F.min("original").alias("original"), F.sum("n").alias("n"), occupied("slot").alias("slots")).filter("n > 1")
    groups = groups.select("payload_digest", "original", each_slot("slots").alias("slot"))
    joined = rows.join(groups, ["payload_digest", "slot"], "left")
    again = (F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("original.page_id"))
    return joined.withColumns({"refers_to": F.when(again, F.col("original.page_id")), "refers_url": F.when(again, F.col("original.url"))}).drop("original", "slot")


def _rewrite(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    """New archives from decisions in the order of files and places."""
    out, path, f = Archives(folder, date), None, None
    for batch in batches:
        for r in batch.to_pylist():
            payload = None
            if r["refers_to"] is None:
                if path != r["file"]:
                    if f is not None:
                        f.close()
                    path = r["file"]
                    fs, at = pafs.FileSystem.from_uri(path)
                    f = fs.open_input_file(at)
                _, payload = _payload(*parsed(zlib.decompress(f.read_at(r["length"], r["place"]), 31)), False)
            out.add(page_record(r["page_id"], r["url"], r["payload_digest"], r["payload_bytes"], date, payload, r["refers_to"], r["refers_url"]))
    if f is not None:
        f.close()
    yield out.manifest()


def deduplicated(spark: SparkSession, first: str, second: str, least_bytes: int = 0, date: str | None = None) -> None:
    """Write the archives under ``first`` anew under ``second``, with revisits for repeated payloads."""
    headers = written(read_headers(spark, first), "headers")
    decided = resolve_revisits(headers, least_bytes).select("file", "place", "length", "page_id", "url", "payload_digest", "payload_bytes", "refers_to", "refers_url")
    files = headers.agg(F.count_distinct("file").alias("n")).first()["n"]
    _committed(decided.repartitionByRange(max(files, 1), "file").sortWithinPartitions("file", "place"), _rewrite, second, date or _now())


def archived(pages: DataFrame, first: str, second: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write every page to archives under ``first``, deduplicated ones under ``second``, and return what these hold.

    One row per page: page_id, url, record_type, payload_digest,
    payload_bytes, refers_to.  A null html counts as empty.  Of equal payloads
    the smallest page_id is the response; rows that repeat that id are
    responses too.  A null id ranks last; a group without any id is all
    responses.  White space in a URL is written as %20; a missing one as
    urn:x-none.  Columns of other names are ignored.  A record is held whole
    by the task that writes or reads it, about three times its size.  No pages
    make no archives.
    """
    write_archives(pages, first, id_col, url_col, html_col)
    deduplicated(pages.sparkSession, first, second, least_bytes)
    return read_headers(pages.sparkSession, second, verify=True).drop("file", "place", "length")
