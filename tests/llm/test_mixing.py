from __future__ import annotations

import re

from pyspark.sql import functions as F

from voxweave.llm.mixing import mix, mix_plan, targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in names if s not in capped)
        level = {s: 3 * sizes[s] if s in capped else rest * weight[s] / open_ for s in names}
        over = {s for s in names if s not in capped and level[s] > 3 * sizes[s]}
        if not over:
            return level
        capped |= over


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 3}, {"a": 7}, {"a": 0, "b": 9, "Z": 4, "é": 1}, {"x": 0}):
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in targets(rows).collect()}
        want = filled(sizes)
        assert all(abs(got[s] - want[s]) < 1e-9 * max(1, want[s]) for s in sizes), (got, want)


def test_plan(odd, odd_rows):
    rows = mix_plan(odd, seed=1).collect()
    assert len(rows) == len(odd_rows)
    sizes, taken, longest = {}, {}, {}
    for r in rows:
        assert r["size"] == len(WORD.findall(r.text or ""))
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        longest[r.source] = max(longest.get(r.source, 0), r["size"])
    want = filled(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 3 * longest[s] for s in sizes)
    again = mix_plan(odd.repartition(6), seed=1).collect()
    key = lambda r: (str(r.doc_id), str(r.text)[:40], str(r.source), r.copies)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_mix_repeats_rows(odd, none):
    clash = odd.withColumn("copies", F.lit("mine")).withColumn("row", F.lit(1))
    out = mix(clash, seed=1)
    assert out.columns == clash.columns
    assert out.count() == mix_plan(odd, seed=1).agg(F.sum("copies")).first()[0]
    assert mix(none).count() == 0
