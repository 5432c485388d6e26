"""WARC archives: written from pages, and read back in byte ranges.

Writing: tasks write gzip archives with one member per record into a shared folder,
each task under names of its own, and report (path, length). That report is the manifest;
it is written as a table, so a lost or repeated task leaves at most an unlisted file. Of
records with equal payloads, that with the smallest page_id is a response; the others are
revisits that refer to it and carry no payload.

Reading: the manifest is cut into byte ranges, whatever the record boundaries. A task
searches its range for the gzip magic, takes the first place whose member decodes to a WARC
header as a record, and follows members from there on. A record belongs to the range
it starts in, and is read to its end beyond it.

Defined cases: a null html is an empty payload; a null page_id sorts after all others;
rows that repeat a payload's smallest page_id are all responses; a null url gives no
target URI, and blanks, line ends and non-ASCII characters in one are percent-encoded; an
empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import string
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_table, shared_dir

VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
EPOCH = "1970-01-01T00:00:00Z"
#: Archives are closed beyond this many bytes, and read in ranges of so many.
FILE_BYTES, RANGE_BYTES = 1 << 28, 1 << 23
_READ = 1 << 18
#: A payload of more pages than HOT, and of more than one page in SHARE, is told to all tasks.
HOT, SHARE = 10_000, 10_000
_URL_SAFE = "".join(c for c in string.printable if c not in string.whitespace)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, fields: dict[str, str], block: bytes = b"") -> bytes:
    """One WARC record as a gzip member."""
    head = [VERSION.decode(), f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}", "", ""]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode()) + squeeze.compress(block) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    own = f"<urn:page:{'' if page_id is None else page_id}>"
    fields = {"WARC-Record-ID": own, "WARC-Date": EPOCH}
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe=_URL_SAFE)
    fields |= {"WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}", "X-Payload-Length": str(len(payload))}
    if revisit:
        fields |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To": f"<urn:page:{refers_to}>",
            "Content-Type": "application/http;msgtype=response",
        }
        return record("revisit", fields, _HTTP + b"\r\n")
    fields["Content-Type"] = "application/http;msgtype=response"
    return record("response", fields, _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload) + payload)


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        path, out, size, done = "", None, 0, []
        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, size = f"{folder}/{name}", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    info = record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": EPOCH, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    size = len(info)
                member = page_record(page_id, url, (html or "").encode(), refers_to, revisit)
                out.write(member)
                size += len(member)
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "length"])

    return run


def write_archives(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) and returns the manifest (path, length).

    Payloads under `least_bytes` are never turned into revisits.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("key", F.when(F.octet_length("html") >= least_bytes, F.unhex(F.sha1(F.col("html").cast("binary")))))
    found = _revisits(rows.where("key IS NOT NULL").select("page_id", "key"))
    # a page's id is part of what it is joined by, so copies of one payload are spread over all tasks
    same = (rows["key"] == found["of_key"]) & rows["page_id"].eqNullSafe(found["of_page"])
    marked = rows.join(found, same, "left")
    out = marked.select("page_id", "url", "html", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))
    return as_table(out.mapInArrow(_writer(folder), "path string, length long"), "warc-manifest")


def _revisits(keyed: DataFrame) -> DataFrame:
    """(of_key, of_page, refers_to) of the pages (page_id, key) whose payload a smaller page_id has; each pair once.

    Only ids and keys are dealt by key, and those of the most frequent payloads not at all.
    """
    keyed = as_table(keyed, "warc-keys")
    # combined map-side: one row per payload and task, however often it is repeated
    first = keyed.groupBy("key").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    first = as_table(first, "warc-first")
    least = max(HOT, keyed.count() // SHARE)
    hot = F.broadcast(first.where(F.col("n") > least).drop("n"))  # fewer than SHARE: each has a larger share of the pages
    rest = keyed.join(hot, "key", "left_anti").join(first.where(F.col("n") <= least).drop("n"), "key")
    both = keyed.join(hot, "key").unionByName(rest).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return both.groupBy(F.col("key").alias("of_key"), F.col("page_id").alias("of_page")).agg(F.first("refers_to").alias("refers_to"))


class _Range:
    """Reads a file forward from a byte on, in blocks."""

    def __init__(self, path: str, start: int) -> None:
        store, name = pafs.FileSystem.from_uri(path)
        self.file, self.at, self.data = store.open_input_file(name), start, b""
        self.file.seek(start)

    def more(self) -> bool:
        block = self.file.read(_READ)
        self.data += block
        return bool(block)

    def drop(self, n: int) -> None:
        self.data = self.data[n:]
        self.at += n

    def starts_record(self) -> bool:
        """Whether the bytes from here on decode to a WARC header."""
        while len(self.data) < 4096 and self.more():
            pass
        try:
            return zlib.decompressobj(31).decompress(self.data[:4096], len(VERSION)).startswith(b"WARC/1.")
        except zlib.error:
            return False

    def seek_record(self, end: int) -> bool:
        """Move to the first record that starts before `end`."""
        while self.at < end:
            found = self.data.find(MAGIC)
            if found < 0:
                self.drop(max(0, len(self.data) - len(MAGIC) + 1))
                if not self.more():
                    return False
                continue
            self.drop(found)
            if self.at >= end:
                return False
            if self.starts_record():
                return True
            self.drop(1)
        return False

    def record(self) -> bytes:
        """The record here, decoded; moves on to the next member."""
        squeeze, parts = zlib.decompressobj(31), []
        while True:
            parts.append(squeeze.decompress(self.data))
            self.at += len(self.data) - len(squeeze.unused_data)
            self.data = squeeze.unused_data
            if squeeze.eof:
                return b"".join(parts)
            if not self.more():
                raise ValueError("an archive ends within a record")


def records(path: str, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of the records of an archive that start in [start, end)."""
    reader = _Range(path, start)
    if not reader.seek_record(end):
        return
    while True:
        head, _, rest = reader.record().partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")[1:]
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        yield fields, rest[: int(fields["content-length"])]
        if not reader.seek_record(end):  # the next member is validated too; padding between members is skipped
            return


_PAGE = re.compile(r"<urn:page:(-?\d*)>")


def _page(value: str | None) -> int | None:
    found = _PAGE.fullmatch(value or "")
    return int(found[1]) if found and found[1] else None


def _reader(payloads: bool):
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                for fields, block in records(path, start, end):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    size, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
                    payload = None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if (len(payload), base32_sha1(payload)) != (size, digest):
                            raise ValueError(f"the payload of {fields['warc-record-id']} does not match its digest")
                    rows.append((_page(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, size, digest, _page(fields.get("warc-refers-to")), payload if payloads else None))
                    held += len(block) if payloads else 200
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """Response and revisit records of the archives in a manifest (path, length)."""
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start")
    ranges = manifest.where("length > 0").select("path", cuts).withColumn("end", F.col("start") + range_bytes)
    many = ranges.count()
    spread = ranges.repartition(min(max(many, 1), 100_000))
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return spread.mapInArrow(_reader(payloads), schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives and read back in byte ranges."""
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), d AS (
  SELECT *, array_to_string(list_transform(range(0, 8), lambda g:
    array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(hex, (g * 5 + 1)::INT, 5))::BIGINT >> s) & 31)::INT + 1, 1)), '')), '') AS payload_digest FROM p
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d
"""
