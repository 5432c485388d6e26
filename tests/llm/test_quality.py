from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from voxweave.llm.quality import BASE, POLICIES, RULES, ablations, apply_policy, ledger, mask, measure

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, t in enumerate(zip(w, w[1:], w[2:])) if tri[t] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered))


TEXTS = ["a b c a b c", "a a a a a", "x y", "a b c d\na b c d\n\n \nz", "# * $ %% & | <>", "a b c b c a b c", None, "", "one", "é \U0001F600 x é \U0001F600 x"]


def test_measures(spark, odd):
    extra = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for df in (extra, odd.select("doc_id", "text")):
        for r in measure(df).collect():
            assert tuple(r)[2:] == by_hand(r.text), r.text


def test_policies_and_ablations(odd):
    rows = ledger(odd)
    kept = apply_policy(rows, "strict-1").collect()
    names = [n for n, _ in RULES]
    for r in kept:
        n, rep = r.n_words, r.n_repeat_words
        assert bool(r.failed & mask(BASE)) == (n < 50 or 100 * rep > 50 * n)
        assert r.kept == (r.failed & mask(POLICIES["strict-1"]) == 0)
    table = {r.rule: r for r in ablations(rows, "strict-1").collect()}
    assert set(table) == set(names)
    for name in names:
        bit = mask((name,))
        assert table[name].fails == sum(bool(r.failed & bit) for r in kept)
        assert table[name].only_this == sum(r.failed == bit for r in kept)


def test_filter_keeps_plan_small(odd):
    assert apply_policy(ledger(odd), "strict-1").where("kept").count() > 0


def test_clashing_columns_and_empty(odd, none):
    out = ledger(odd.withColumn("N_Words", F.lit("mine")).withColumn("words", F.lit(1)).withColumn("failed", F.lit(9)))
    assert out.columns.count("n_words") == 1 and "N_Words" not in out.columns and "words" in out.columns
    assert ledger(none).count() == 0
