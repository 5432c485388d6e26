from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxweave.llm import langid as L


def plain_grams(text):
    """n-grams as strings, in plain Python."""
    s = "".join(c if c.isalpha() else " " for c in text.lower())
    return [s[i : i + n] for n in range(1, L.ORDER + 1) for i in range(len(s) - n + 1)] if s.strip() else []


@pytest.mark.parametrize("text", ["", "a", "ab", "Été, 12 ab!", "x" * 30, "\U0001F600 你好 ßẞİ", " \n 12 "])
def test_grams(text, monkeypatch):
    whole = np.concatenate([np.zeros(0, np.int64), *L.grams(text)])
    assert len(whole) == len(plain_grams(text))
    monkeypatch.setattr(L, "STEP", 4)
    assert sorted(np.concatenate([np.zeros(0, np.int64), *L.grams(text)])) == sorted(whole)


def test_equal_grams_equal_hashes():
    one, two = L.counted("banana band"), L.counted("banana band banana band ")
    assert set(one[0]) <= set(two[0])
    ours = Counter(plain_grams("banana band"))
    assert sorted(one[1]) == sorted(ours.values()) or len(one[0]) < len(ours)


def test_frequencies(spark):
    rows = [("abc",), ("abd",), (None,), ("12",), ("abc abc",)]
    idf = L.inverse_frequencies(spark.createDataFrame(rows, "text string"))
    at = L.counted("abc")[0]
    df = Counter(g for (t,) in rows for g in set(plain_grams(t or "")))
    want = sorted(math.log(6 / (1 + n)) + 1 for g, n in df.items() if g in set(plain_grams("abc")))
    assert np.allclose(sorted(idf[at]), want)


def test_learning_by_hand():
    """One step of the update in plain loops."""
    z, n = np.full((4, 2), 0.3), np.full((4, 2), 0.2)
    z0, n0 = z.copy(), n.copy()
    at, value = np.array([1, 2]), np.array([0.6, 0.8])
    L.learn(z, n, at, value, 1)
    w = {}
    for i in (1, 2, 3):
        for c in (0, 1):
            w[i, c] = -(z0[i, c] - L.L1) / ((L.BETA + math.sqrt(n0[i, c])) / L.ALPHA + L.L2)
    x = {1: 0.6, 2: 0.8, 3: 1.0}
    s = [sum(x[i] * w[i, c] for i in x) for c in (0, 1)]
    p = [math.exp(v) / sum(map(math.exp, s)) for v in s]
    for i in x:
        for c in (0, 1):
            g = x[i] * (p[c] - (c == 1))
            sigma = (math.sqrt(n0[i, c] + g * g) - math.sqrt(n0[i, c])) / L.ALPHA
            assert math.isclose(z[i, c], z0[i, c] + g - sigma * w[i, c], rel_tol=1e-12)
            assert math.isclose(n[i, c], n0[i, c] + g * g, rel_tol=1e-12)
    assert (z[0] == z0[0]).all()
    assert (L._weights(np.array([0.01, -0.02, 0.5]), np.ones(3)) == 0).tolist() == [True, True, False]


def test_query(spark, sf):
    """Accuracy on the documents held out; scores are probabilities that fit."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = L.op13_langid(spark, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    right, scores = [], []
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if r.held_out:
            right.append(r.lang_pred == docs[r.doc_id].lang)
            scores.append(r.score)
    assert np.mean(right) >= 0.95
    assert abs(np.mean(right) - np.mean(scores)) < 0.1


def test_odd(spark, odd_rows):
    rows = [(i, t, lang, *r) for r in odd_rows for i, t, lang in [(r[0], r[1], ("en", "de", None)[len(r[1] or "") % 3])]]
    docs = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, lang string").repartition(3)
    clash = docs.withColumn("score", F.lit("mine")).withColumn("hash", F.lit(1))
    out = L.identify(clash).collect()
    assert len(out) == len(rows)
    for r in out:
        blank = not any(c.isalpha() for x in rows if x[0] == r.doc_id for c in x[1] or "")
        assert r.lang_pred in ("en", "de", "und") and (r.lang_pred != "und" or r.score == 0.0)
        if blank:
            assert r.lang_pred == "und"
    key = lambda rows: sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in rows)
    assert key(L.identify(clash.repartition(5)).collect()) == key(out)


def test_nothing_to_learn(spark, none):
    assert L.identify(none).collect() == []
    rows = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in L.identify(rows.where("doc_id = 1")).collect()}
    assert out[1].lang_pred == "und" and out[1].score == 0
    # one language only, learned from a document without text
    assert {r.lang_pred for r in L.identify(rows).collect()} <= {"und", "en"}
