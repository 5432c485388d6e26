from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest

import voxweave.llm.repeats as repeats
from voxweave.llm.repeats import NOBODY, least_documents, op2_repeats, remove_repeats
from voxweave.llm.suffixes import permuted_common_prefixes, suffix_array

LAST = 2**63 - 1


def brute(rows):
    first = {}
    for i, t in sorted(rows, key=lambda r: LAST if r[0] is None else r[0]):
        b = (t or "").encode()
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], LAST if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < (LAST if i is None else i):
                gone[j : j + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for q in range(len(gone)) if gone[q] and (q == 0 or not gone[q - 1]))
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def results(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("letters", [1, 2, 3, 200])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    for n in [0, 1, 2, 3, 10, 60]:
        for _ in range(15):
            x = rng.integers(0, letters, n).astype(np.uint8)
            array = suffix_array(x, 256)
            assert array.tolist() == sorted(range(n), key=lambda i: x[i:].tolist())
            if n:
                got = permuted_common_prefixes(x, array, 20)
                for a, b in zip(array[:-1], array[1:]):
                    k = 0
                    while k < 20 and max(a, b) + k < n and x[a + k] == x[b + k]:
                        k += 1
                    assert got[b] == k


def test_large_suffix_array_uses_blocks():
    x = np.random.default_rng(0).integers(97, 100, 256 * 256 + 5).astype(np.uint8)
    array = suffix_array(x, 256)
    raw = x.tobytes()
    some = array[:: 997]
    assert all(raw[a:] < raw[b:] for a, b in zip(some, some[1:])) and len(np.unique(array)) == len(x)


def test_least_documents():
    texts = [b"x" * 60, b"y" + b"x" * 55, b"z" * 50]
    body = np.frombuffer(b"".join(texts), np.uint8)
    best = least_documents(body, np.array([len(t) for t in texts]), np.array([5, 3, NOBODY]))
    assert best.tolist() == [3] * 11 + [3] * 7 + [NOBODY]


def test_odd_rows(odd, odd_rows, none):
    assert results(remove_repeats(odd)) == brute([(r[0], r[1]) for r in odd_rows])
    assert remove_repeats(none).count() == 0


def test_low_entropy_and_small_pieces(spark, monkeypatch):
    rng = random.Random(5)
    base = "".join(rng.choice("ab") for _ in range(400))
    rows = []
    for i in range(60):
        a = rng.randrange(300)
        t = base[a : a + rng.randrange(30, 200)] + "".join(rng.choice("ab") for _ in range(rng.randrange(90)))
        rows.append((rng.choice([i, i, i, None, 3]), rng.choice([t, t, t, t + t, "a" * rng.randrange(200), "é" * rng.randrange(60), None, ""])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert results(remove_repeats(df)) == brute(rows)
    # contexts of one anchor beyond the limit are taken apart
    body = np.frombuffer("".join((r[1] or "").ljust(60, "q") for r in rows).encode(), np.uint8)
    size = np.array([len((r[1] or "").ljust(60, "q").encode()) for r in rows])
    least = np.arange(len(rows))[::-1].copy()
    zero = np.zeros(len(rows), np.uint64)
    offset = np.full(len(rows), 15)
    whole = repeats._sort_contexts(zero, least, body, size, offset)
    monkeypatch.setattr(repeats, "SORT_BYTES", 16)
    apart = repeats._sort_contexts(zero, least, body, size, offset)
    strings = size - 49
    at = np.concatenate([np.arange(n) for n in strings])
    near = at <= 15  # strings that hold the anchor's place
    assert len(apart) == len(whole) and (apart[near] >= whole[near]).all()


def test_buckets_are_of_one_size():
    """The least hash of a window is small, so equal ranges of it held up to 16 times the mean."""
    text = np.random.default_rng(3).integers(97, 123, 300_000).astype(np.uint8)
    shard = repeats.Shard.__new__(repeats.Shard)
    shard.ids, shard.offsets, shard.data = np.array([7]), np.array([0, len(text)]), text
    shard._find_anchors()
    sizes = np.diff(shard.cuts(16))
    assert sizes.sum() == len(shard.lead) and sizes.max() < 1.2 * sizes.mean()


def test_answers_of_many_shards_take_one_pass():
    """3,000 reports of one bucket: each had all of the bucket's answers looked through."""
    rng, n, each = np.random.default_rng(4), 3000, 100
    anchors = rng.integers(0, 1 << 48, 50_000).astype(np.uint64)
    blobs, expected = [], {}
    which = np.stack([np.sort(rng.choice(len(anchors), each, replace=False)) for _ in range(n)])
    for s in range(n):
        h = np.sort(anchors[which[s]])
        least = np.full(each, s, dtype=np.int64)
        for x in h.tolist():
            expected.setdefault(x, s)
        values, place = repeats._narrow(least)
        six = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :6])
        blobs.append(repeats._bytes(np.array([place.itemsize], np.uint8), values, place, six, h))
    table = pa.table({"bucket": pa.array([0] * n, pa.int32()), "shard": pa.array(range(n), pa.int64()), "blob": pa.array(blobs, pa.binary())})
    began = time.process_time()
    rows = repeats._meet(table).to_pylist()
    assert time.process_time() - began < 4
    got = {}
    for r in rows:
        _, local, values, at, wanted = repeats._arrays(r["blob"], "u1", "<u4", "<i8", "<u2", "<u4")
        assert r["kind"] == 0 and not len(wanted)
        got[r["shard"]] = dict(zip(local.tolist(), values[at].tolist()))
    for s in range(n):
        h = np.sort(anchors[which[s]]).tolist()
        assert got.get(s, {}) == {i: expected[x] for i, x in enumerate(h) if expected[x] < s}


def test_long_groups_sort_one_of_equal_strings(monkeypatch):
    """A line that many texts have, between other lines: its anchor's contexts differ, most strings don't."""
    rng = np.random.default_rng(6)
    line = rng.integers(97, 123, 40).astype(np.uint8)
    n, size = 400, 80
    texts = np.concatenate([rng.integers(97, 99, (n, 20)).astype(np.uint8), np.tile(line, (n, 1)), rng.integers(97, 99, (n, 20)).astype(np.uint8)], axis=1)
    least = rng.permutation(n).astype(np.int64)
    args = np.zeros(n, np.uint64), least, texts.ravel(), np.full(n, size), np.full(n, 30)
    sorted_bytes, plain = [], repeats.least_documents

    def counted(body, size, least):
        sorted_bytes.append(len(body))
        return plain(body, size, least)

    monkeypatch.setattr(repeats, "least_documents", counted)
    whole = repeats._sort_contexts(*args)
    sorted_bytes.clear()
    monkeypatch.setattr(repeats, "SORT_BYTES", 1000)
    apart = repeats._sort_contexts(*args)
    first = {}
    for i in np.argsort(least).tolist():
        for j in range(size - 49):
            first.setdefault((j, texts[i, j : j + 50].tobytes()), int(least[i]))
    expected = [first[j, texts[i, j : j + 50].tobytes()] for i in range(n) for j in range(size - 49)]
    assert apart.tolist() == expected == whole.tolist()
    # each distinct string once, if it occurs again, not all of n * 31 strings
    assert 0 < sum(sorted_bytes) <= min(50 * len(first), 50 * n * 31 // 4)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert results(op2_repeats(spark, sf)) == brute(docs)
