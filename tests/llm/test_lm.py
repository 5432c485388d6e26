from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from voxweave.llm import lm
from voxweave.llm.lm import Places, contexts, score, token_table, train
from voxweave.llm.tokens import word_hashes


def test_contexts_stay_within_texts():
    ctx = contexts(np.array([10, 11, 12, 20], np.uint16), np.array([3, 0, 1]))
    e = lm.EDGE
    assert ctx.tolist() == [[e, e, 11, 12], [e, 10, 12, e], [10, 11, e, e], [e, e, e, e]]


def zipf(number):
    """(counts, ties, words, counts of the words) of a corpus whose n-th word occurs 3 * number / n times."""
    each = np.maximum(3 * number // np.arange(1, number + 1), 1)
    n, ties = np.unique(each, return_counts=True)
    words = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, number)
    return n[::-1], ties[::-1], words, each


def test_probabilities_sum_to_one():
    """Over all words and the unseen one, for any context and any weights."""
    n, ties, words, each = zipf(70_000)
    places = Places(n, ties, words[: lm.HEAVY], each[: lm.HEAVY])
    assert places.slots > lm.BUCKETS
    cell, slot = places.of(words, each)
    assert slot[: places.own].tolist() != [0] and len(set(slot[: places.own])) == places.own and slot.max() <= places.slots
    mass = np.bincount(cell, weights=each + 1, minlength=lm.CLASSES * lm.CELLS)
    mass[-1] += 1
    own = np.flatnonzero(np.bincount(cell, minlength=len(mass)) == 1)
    assert len(np.intersect1d(own, cell[:90])) > 80  # frequent words have cells of their own
    w = lm.first_weights(mass.reshape(-1, lm.CELLS), places.slots)
    rng = np.random.default_rng(2)
    w = {k: (v + rng.standard_normal(v.shape) * 0.3).astype(np.float32) for k, v in w.items()}
    every = np.flatnonzero(mass)
    p = np.exp(lm.cell_logp(w, np.repeat([[1, 2, 3, 4]], len(mass), axis=0), np.arange(len(mass))))
    assert abs(p.sum() - 1) < 1e-4 and p[every].sum() <= p.sum()


def slow_scores(model, rows):
    """Each score by loops over words, from the weights and counts alone."""
    w = {k: v.astype(float) for k, v in model.weights.items()}
    known = {r.word: r.n for r in model.vocabulary.counted.collect()}
    mass, out = model.vocabulary.mass, {}
    for i, text in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        words = word_hashes(raw, np.array([0, len(raw)]))[0].view(np.int64)
        n = np.array([known.get(int(x), 0) for x in words], np.int64)
        cells, slots = model.vocabulary.places.of(words, n)
        total = 0.0
        for k in range(len(words)):
            h = w["hidden"].copy()
            for nth, off in enumerate((-2, -1, 1, 2)):
                h += w["embed"][slots[k + off] if 0 <= k + off < len(words) else lm.EDGE] * w["scale"][nth]
            h = np.tanh(h)
            kind, sub = divmod(int(cells[k]), lm.CELLS)
            first, second = h @ w["out"] + w["bias"], h @ w["cells"][kind] + w["cell_bias"][kind]
            total += first[kind] - math.log(np.exp(first).sum()) + second[sub] - math.log(np.exp(second).sum())
            total += math.log((n[k] + 1) / mass[kind][sub])
        out[i] = total
    return out


def test_scores_equal_slow_ones(spark, odd, odd_rows, monkeypatch):
    monkeypatch.setattr(lm, "HEAVY", 100)  # most words go through the join
    tokens = token_table(odd)
    model = train(tokens)
    n = {r.word: r.n for r in model.vocabulary.counted.collect()}
    raw = np.concatenate([word_hashes(np.frombuffer((r[1] or "").encode(), np.uint8), np.array([0, len((r[1] or "").encode())]))[0] for r in odd_rows]).view(np.int64)
    assert n == {int(a): int(b) for a, b in zip(*np.unique(raw, return_counts=True))}
    some = [(i, r[1]) for i, r in enumerate(odd_rows) if len(r[1] or "") < 3000] + [(1000, "junk that nobody wrote zzzz")]
    got = {r.doc_id: r.sum_logp for r in score(token_table(spark.createDataFrame(some, "doc_id long, text string")), model).collect()}
    want = slow_scores(model, some)
    assert all(abs(got[i] - want[i]) < 1e-3 * (1 + abs(want[i])) for i in want)


def test_held_out_text_beats_shuffled_words(spark):
    """Words that follow each other by a rule are likelier in their order, also in texts not trained on."""
    rng = random.Random(0)
    chain = {a: [f"w{(a * 7 + k) % 40}" for k in (1, 2)] for a in range(40)}

    def text():
        out = ["w0"]
        for _ in range(300):
            out.append(rng.choice(chain[int(out[-1][1:])]))
        return out

    docs = [(i, " ".join(text())) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    model = train(token_table(df))
    held = [text() for _ in range(10)]
    mixed = [rng.sample(t, len(t)) for t in held]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(held)] + [(100 + i, " ".join(t)) for i, t in enumerate(mixed)], "doc_id long, text string")
    got = {r.doc_id: r.mean_logp for r in score(token_table(rows), model).collect()}
    assert all(got[i] > got[100 + i] + 0.3 for i in range(10)), got


def test_odd_rows(odd, odd_rows, none):
    clash = odd.withColumn("ids", F.lit(1)).withColumn("n", F.lit(2))
    tokens = token_table(clash)
    rows = score(tokens, train(tokens)).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert (r.mean_logp is None) == (r.n_words == 0) and (r.n_words or r.sum_logp == 0)
    empty = token_table(none)
    assert score(empty, train(empty)).count() == 0


def test_every_word_is_a_training_target():
    counts = np.array([3, 0, 1, 8, 0, 5, 2])
    got = np.concatenate([lm.targets(counts, turn) for turn in range(lm.ROUNDS)])
    assert sorted(got) == list(range(19))
    assert lm.targets(np.zeros(3, np.int64), 0).size == 0


def test_training_covers_all_words(spark, odd):
    tokens = token_table(odd)
    model = train(tokens)
    assert model.targets == sum(r.n_words for r in score(tokens, model).collect())


def test_a_known_word_is_likelier_than_an_unseen_one(spark):
    rows = [(i, " ".join(f"w{i * 1000 + k} twice twice" for k in range(1000))) for i in range(60)]
    model = train(token_table(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)))
    held = [(k, f"twice w{k * 1000 + 5} twice") for k in range(50)] + [(100 + k, f"twice junk{k} twice") for k in range(50)]
    got = {r.doc_id: r.sum_logp for r in score(token_table(spark.createDataFrame(held, "doc_id long, text string")), model).collect()}
    unseen = {round(got[100 + k], 2) for k in range(50)}
    assert len(got) == 100 and max(unseen) < np.median([got[k] for k in range(50)])
