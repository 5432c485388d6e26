from __future__ import annotations

import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from voxweave.llm import decontam
from voxweave.llm.decontam import MASKS, contaminated_pairs, decontaminate

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, items, least=13):
    """Pairs with an aligned stretch of `least` words, one substitution in five at most.

    Every alignment of every pair; a stretch counts if its words weigh 0 or less in sum, a substituted
    one weighing 4 and an equal one -1.
    """
    code = {}
    words_of = lambda t: np.array([code.setdefault(w.lower(), len(code)) for w in WORD.findall(t or "")], dtype=np.int64)
    texts, out = [(d, words_of(t)) for d, t in docs], set()
    for i, q in items:
        b = words_of(q)
        need = min(least, len(b))
        for d, a in texts:
            at, of = np.nonzero(a[:, None] == b)
            shifts, equal = np.unique(at - of, return_counts=True)
            for shift in shifts[5 * equal >= 4 * need]:
                lo, hi = max(0, shift), min(len(a), shift + len(b))
                if hi - lo < need:
                    continue
                sums = np.cumsum(np.concatenate(([0], 5 * (a[lo:hi] != b[lo - shift : hi - shift]) - 1)))
                if (np.maximum.accumulate(sums)[: len(sums) - need] >= sums[need:]).any():
                    out.add((d, i))
                    break
    return out


def test_brute_force_itself(words):
    """Against the definition, stretch by stretch."""
    rng = random.Random(5)
    for _ in range(300):
        b = [rng.choice(words[:4]) for _ in range(rng.randint(1, 20))]
        a = [w if rng.random() < 0.8 else "zz" for w in b[rng.randint(0, 3) :]] + ["yy"] * rng.randint(0, 3)
        need, want = min(13, len(b)), False
        for shift in range(-len(b) + 1, len(a)):
            lo, hi = max(0, shift), min(len(a), shift + len(b))
            wrong = [a[k] != b[k - shift] for k in range(lo, hi)]
            want = want or any(5 * sum(wrong[x:y]) <= y - x for x in range(len(wrong)) for y in range(x + need, len(wrong) + 1))
        assert brute([(1, " ".join(a))], [(2, " ".join(b))]) == ({(1, 2)} if want else set())


def test_masks_hit_every_stretch():
    """13 to 25 words with one substitution in five: some mask finds only equal words."""
    for n in range(13, 26):
        places = [sum(1 << at + k for k in m) for m in MASKS for at in range(n - m[-1])]
        for bad in itertools.combinations(range(n), n // 5):
            taken = sum(1 << k for k in bad)
            assert any(not p & taken for p in places), (n, bad)


def test_masks_of_short_items():
    """Wherever the allowed substitutions are, some mask leaves them all out and has words left."""
    for n in range(1, 13):
        for bad in itertools.combinations(range(n), n // 5):
            assert any(m and not set(m) & set(bad) for m in decontam.short_masks(n)), (n, bad)


def test_substitutions_in_items_of_any_length(spark, words):
    """Items of 5 to 30 words, each planted with as many substitutions as the rule allows, evenly or by chance."""
    rng = random.Random(9)
    items = [(n, " ".join(rng.choice(words) for _ in range(n))) for n in range(5, 31)]
    docs = []
    for n, text in items:
        for turn in range(8):
            part = text.split()
            bad = [5 * k + turn % 5 for k in range(n // 5)] if turn < 5 else rng.sample(range(n), n // 5)
            for k in bad:
                part[k] = "zz"
            docs.append((n * 10 + turn, " ".join(["yy", *part, "xx"])))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated_pairs(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items) and {(i, i // 10) for i, _ in docs} <= got


def cases(spark, words):
    rng = random.Random(4)
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(14, 30)))) for i in range(12)] + [(20, "tiny item"), (21, None), (22, ""), (3, "again another text of that item")]
    docs = []
    for i in range(40):
        q = WORD.findall(rng.choice(items[:12])[1])
        a = rng.randrange(0, max(1, len(q) - 13))
        part = q[a : a + rng.randint(8, 20)]
        for k in range(rng.randint(0, 3)):
            part[rng.randrange(len(part))] = "zz"
        docs.append((i, " ".join(say(rng.randint(0, 30)) + part + say(rng.randint(0, 30)))))
    docs += [(90, None), (91, ""), (92, "a TINY\titem here"), (5, docs[5][1]), (None, items[0][1]), (93, "the " * 20000)]
    schema = "doc_id long, text string"
    return docs, items, spark.createDataFrame(docs, schema).repartition(3), spark.createDataFrame(items, "item_id long, text string")


def test_pairs(spark, words, monkeypatch):
    docs, items, d, q = cases(spark, words)
    rows = contaminated_pairs(d.withColumn("item_id", F.lit("x")), q.withColumn("doc_id", F.lit(1))).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    want = brute(docs[:-1], items)
    assert got == want
    assert len(rows) == len(got) and all(5 * (r.n_words - r.n_equal) <= r.n_words for r in rows)
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 40)
    assert {(r.doc_id, r.item_id) for r in contaminated_pairs(d, q).collect()} == want
    kept = decontaminate(d, q)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in {a for a, _ in want})


def test_blocks_are_bounded_whatever_parts_the_words(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 100)
    texts = ["\t".join(["w"] * 60), "\n".join(["w"] * 60), "x" * 6000, None, "", " a  b "]
    blocks = list(decontam._blocks(spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").coalesce(1)))
    assert [list(b.items) for b, _ in blocks] == [[0, 1], [2], [3, 4, 5]]
    assert [last for _, last in blocks] == [False, False, True]


def test_empty(spark, none):
    q = spark.createDataFrame([], "item_id long, text string")
    assert contaminated_pairs(none, q).count() == 0
    assert decontaminate(none, spark.createDataFrame([(1, "x")], "item_id long, text string")).count() == 0


def test_query(spark, sf):
    """The registered query against brute force, over all documents."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {(r.doc_id, r.item_id) for r in decontam.op7_decontamination(spark, sf).collect()} == brute(docs, items)
