from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxweave.llm import variants as V

SCHEMA = "doc_id long, text string"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    # candidates: equal without a code point, or without none
    lists = defaultdict(set)
    for w in words:
        for v in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            lists[v].add(w)
    met = defaultdict(set)
    for group in lists.values():
        for a in group:
            met[a] |= {b for b in group if near(a, b)}
    form = {}
    for w, others in met.items():
        if others:
            best = min(others, key=lambda o: (-words[o], o))
            if words[best] >= 10 * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(met[w]), words[form[w]] if w in form else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    """Words close to each other, with ties, chains of forms, letters beyond ASCII, long runs."""
    rng = random.Random(4)
    base = ["aaaaaaa", "aaaaaaaa", "aabbaabb", "verlöten", "straßenbahn", "élévation", "kettering", "ÿÿÿÿÿÿÿÿ", "x×y÷zabc"]
    letters = "abeßéx"
    pool = list(base)
    for _ in range(150):
        w = list(rng.choice(pool))
        i = rng.randrange(len(w))
        kind = rng.random()
        w = w[:i] + w[i + 1 :] if kind < 0.3 else w[:i] + [rng.choice(letters)] + w[i + (kind < 0.7) :]
        pool.append("".join(w))
    texts = [(i, " ".join(rng.choice(pool).upper() if rng.random() < 0.1 else rng.choice(pool) for _ in range(rng.randint(5, 60))) + ".,") for i in range(60)]
    chain = ["chainword"] * 2000 + ["chainwor"] * 200 + ["chainwo"] * 20 + ["chainworx"] * 2
    long = "".join(rng.choice("abc") for _ in range(3000))
    texts += [(100 + i, " ".join(chain[i::4])) for i in range(4)]
    texts += [(200, None), (201, ""), (202, "\n 12 ,"), (None, "kettering kettering"), (None, None), (203, f"{long} {long}x {long} {long}x"), (203, "kettering"), (203, "kettering")]
    return texts


def test_against_brute_force(spark, rows):
    clash = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("word", F.lit("mine")).withColumn("n", F.lit(1))
    result = got(V.spelling_variants(clash))
    assert result == brute(rows)
    assert any(r[1] and r[1] != r[2] for r in result)


def test_empty(spark):
    assert V.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert V.spelling_variants(spark.createDataFrame([(1, None)], SCHEMA)).collect() == []


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(V.op12_variants(spark, sf)) == brute(rows)


def test_equal_keys_of_unequal_strings(monkeypatch):
    """Strings decide where hashes are equal."""
    words = [b"abcdefg", b"abcdefh", b"zzzzzzzz", b"abcdefgh"]
    plain = V.deletion_keys

    def weak(flat, offsets):
        word, place, hashes, letters = plain(flat, offsets)
        return word, place, hashes % np.uint64(3), letters * np.uint64(0)

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words]), pa.array([5, 4, 3, 2])], names=["word", "n"])
    results = []
    for keys in (plain, weak):
        monkeypatch.setattr(V, "deletion_keys", keys)
        (out,) = V._meet(V._dealt(1)([batch]))
        totals = Counter()
        for w, n in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            totals[w] += n
        results.append(totals)
    assert results[0] == results[1] == {"abcdefg": 2, "abcdefh": 2, "abcdefgh": 2}
