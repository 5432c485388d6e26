from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from voxweave.llm import minhash
from voxweave.llm.graph import components
from voxweave.llm.minhash import drop_near_duplicates, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, width):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, width):
    """Component of every row: least id reachable over similar texts."""
    sets = [grams(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[root(i)] = root(j)
    ids = {}
    for i in range(len(rows)):
        ids.setdefault(root(i), []).append(rows[i][0])
    out = []
    for i, (d, _) in enumerate(rows):
        known = [x for x in ids[root(i)] if x is not None]
        head = (min(known) if known else None) if sets[i] else d
        out.append((str(d), len(sets[i]), str(head), d == head))
    return sorted(out)


def results(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in df.collect())


def test_odd_rows(odd, odd_rows, none):
    assert results(near_duplicates(odd.withColumn("label", F.lit(1)).withColumn("a", F.lit(2)), width=4)) == brute([(r[0], r[1]) for r in odd_rows], 4)
    assert near_duplicates(none).count() == 0


@pytest.mark.parametrize("leaders", [1, 16])
def test_groups(spark, words, monkeypatch, leaders):
    """Near copies of one original, copies whose original is absent, and texts that share a passage."""
    monkeypatch.setattr(minhash, "FULL_LEADERS", leaders)
    rng = random.Random(1)
    say = lambda n: [rng.choice(words) for _ in range(n)]

    def edited(t, most):
        t = list(t)
        for _ in range(rng.randint(0, most)):
            t[rng.randrange(len(t))] = rng.choice(words)
        return t[: len(t) - rng.randint(0, 6)]

    rows, origin, absent, passage = [], say(120), say(150), say(60)
    rows += [(i, " ".join(edited(origin, 9))) for i in range(50)]
    rows += [(200 + i, " ".join(edited(edited(absent, 4), 5))) for i in range(40)]
    rows += [(100 + i, " ".join(say(rng.randint(5, 25)) + passage + say(rng.randint(0, 15)))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert results(near_duplicates(df, width=4)) == brute(rows, 4)


def changed(text, rng, words, n):
    text = list(text)
    for k in rng.sample(range(len(text)), n):
        text[k] = rng.choice(words)
    return text


def test_families_of_edits(spark, words):
    """Edits of edits: families that share differences, some linked within, some across."""
    rng = random.Random(21)
    origin, rows = [rng.choice(words) for _ in range(100)], []
    for family in range(12):
        base = changed(origin, rng, words, 4)
        for _ in range(rng.randint(1, 9)):
            rows.append((len(rows), " ".join(changed(base, rng, words, rng.randint(0, 3)))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = results(near_duplicates(df, width=4))
    assert got == brute(rows, 4) and 1 < len({c for _, _, c, _ in got}) < len(rows)


def test_no_pair_is_asked_twice(spark, words, monkeypatch):
    """Edits of an absent original: alike, but mostly not linked, so that rounds go to their end."""
    rng, n, asked = random.Random(8), 120, []
    origin = [rng.choice(words) for _ in range(60)]
    rows = [(i, " ".join(changed(origin, rng, words, 2))) for i in range(n)]

    def unasked(pairs, before):
        new = plain(pairs, before)
        asked.extend((min(r), max(r)) for r in new.collect())
        return new

    plain = minhash._unasked
    monkeypatch.setattr(minhash, "_unasked", unasked)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert results(near_duplicates(df, width=4)) == brute(rows, 4)
    assert asked and len(set(asked)) == len(asked) <= n * (n - 1) // 2


@pytest.mark.parametrize("width", [4, 5])
def test_query(spark, sf, width):
    """The whole given table, as the query and the pipeline's stage take it."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    df = minhash.op8_minhash(spark, sf) if width == 4 else near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))
    assert results(df) == brute(rows, width)


def test_postings_are_not_broadcast(spark, sf, monkeypatch):
    """Spark takes 48 postings for one row: they, or their counts, went through the driver."""
    plans, plain = {}, minhash.as_table

    def noted(df, label):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, label)

    monkeypatch.setattr(minhash, "as_table", noted)
    out = minhash.op8_minhash(spark, sf)
    plans["result"] = [out._jdf.queryExecution().executedPlan().toString()]
    for label in ("minhash-lists", "result"):
        assert "SortMergeJoin" in plans[label][0] and "Broadcast" not in plans[label][0]
    # arrays have a table of their own, so that Spark knows their size
    assert len(plans["minhash-sigs"]) == 1


def test_chain_of_near_copies(spark, words):
    """Each text is near the next one only, so a component has a long way through it."""
    rng = random.Random(9)
    text, rows = [rng.choice(words) for _ in range(100)], []
    for i in range(60):
        rows.append((59 - i, " ".join(text)))
        text = text[4:] + [rng.choice(words) for _ in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = results(near_duplicates(df, width=4))
    assert got == brute(rows, 4) and {c for _, _, c, _ in got} == {"0"}


def kept_rows(rows, width):
    """Indexes of one row of each group, judged row by row; which of several equal rows does not matter."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    sets = [grams(r[1], width) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    seen, out = set(), []
    for i in order:
        if not sets[i] or group[i] not in seen:
            out.append(i)
        if sets[i]:
            seen.add(group[i])
    return out


def test_stage_keeps_one_row_of_each_group(odd, odd_rows, none):
    out = drop_near_duplicates(odd, width=5)
    assert out.columns == odd.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(odd_rows[i][0]) for i in kept_rows(odd_rows, 5))
    assert drop_near_duplicates(none).count() == 0


def test_stage_judges_rows_not_ids(spark, words):
    rng = random.Random(6)
    a, b, c = (" ".join(rng.choice(words) for _ in range(60)) for _ in range(3))
    rows = [(1, a, "x"), (2, b, "x"), (2, a, "x"), (None, c, "x"), (None, c, "y"), (3, c + " more", "z"), (3, c + " more", "z"), (4, None, "x"), (4, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lead_id string").repartition(3)
    got = sorted((str(r.doc_id), r.text) for r in drop_near_duplicates(df).collect())
    assert got == sorted([("1", a), ("2", b), ("3", c + " more"), ("4", None), ("4", None)], key=str)
    ours = {(r.doc_id, r.text_hash): r for r in minhash.members(df).collect()}
    assert len(ours) == 6


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(1000)] + [(2000 + rng.randrange(30), 2000 + rng.randrange(30)) for _ in range(25)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {n: n for e in edges for n in e}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in sorted(edges, reverse=True):
        up[max(root(a), root(b))] = min(root(a), root(b))
    real = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {x: root(x) for x in real}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_thresholds_that_would_lose_links_are_refused(none):
    for call in (near_duplicates, drop_near_duplicates):
        with pytest.raises(ValueError, match="at least 80"):
            call(none, threshold=60)
