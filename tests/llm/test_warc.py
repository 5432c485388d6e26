from __future__ import annotations

import pytest

from voxweave.llm import warc
from voxweave.llm.warc import base32_sha1, page_record, read_archives, record, records, write_archives

SCHEMA = "page_id long, url string, html string"
ROWS = [
    (1, "http://a/ü x\r\nEvil: 1", "same"), (5, None, "same"), (3, "http://c", "same"), (7, "u", None), (6, "u", ""), (8, "u", "\x1f\x8b\x08 WARC/1.1\r\n\r\n"),
    (9, "u", "long " * 200_000), (None, "u", "same"), (None, "u", "alone"), (1, "u", "same"), (10, "u", "é\U0001F600"),
]


@pytest.mark.parametrize(("size", "hot"), [(37, 1), (1000, 2), (1 << 23, 10_000)])
def test_round_trip(spark, monkeypatch, size, hot):
    monkeypatch.setattr(warc, "HOT", hot)
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(3).selectExpr("*", "'x' as key", "1 as n", "2 as refers_to", "true as revisit", "'y' as of_key")
    manifest = write_archives(pages)
    got = sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_archives(manifest, size).collect()), key=str)
    want = []
    for i, _, html in ROWS:
        raw = (html or "").encode()
        ids = [x for x, _, h in ROWS if (h or "") == (html or "") and x is not None]
        first = min(ids) if ids else None
        revisit = i != first
        want.append((str(i), len(raw), base32_sha1(raw), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)


def test_payloads_and_threshold(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    out = {(r.page_id, r.record_type): r.payload for r in read_archives(write_archives(pages, least_bytes=5)).collect()}
    assert all(kind == "response" for _, kind in out)
    assert bytes(out[9, "response"]).decode() == "long " * 200_000
    assert read_archives(write_archives(spark.createDataFrame([], SCHEMA))).count() == 0


def test_ranges_own_their_records(tmp_path):
    parts = [page_record(i, "u", b"x" * (i * 17), None, False) for i in range(40)]
    # padding, and the magic number where no record is
    raw = b"".join(parts[:20]) + b"\x1f\x8b\x08junk" + record("warcinfo", {}, b"z") + b"".join(parts[20:])
    (tmp_path / "a.gz").write_bytes(raw)
    for step in (1 << 20, 100, 33):
        seen = [f["warc-record-id"] for a in range(0, len(raw), step) for f, _ in records(f"file://{tmp_path}/a.gz", a, a + step) if f["warc-type"] == "response"]
        assert seen == [f"<urn:page:{i}>" for i in range(40)]
