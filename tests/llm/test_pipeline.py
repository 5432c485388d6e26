from __future__ import annotations

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf):
    from test_decontam import brute as leaks
    from test_minhash import brute as groups
    from test_quality import by_hand
    from voxweave.llm.mixing import mix_plan

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    want = {}
    for i, r in rows.items():
        n, chars, symbols, lines, dup, rep = by_hand(r.text)
        want[i] = not (n < 50 or 2 * rep > n or chars < 2 * n or chars > 15 * n or symbols > n or (dup and 2 * dup > lines))
    out = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert out.columns == columns and sorted(r.doc_id for r in out.collect()) == sorted(i for i in want if want[i])
    kept = [(i, rows[i].text) for i in rows if want[i]]
    kept = [int(d) for d, _, _, k in groups(kept, 5) if k]
    out = corpus_pipeline.STAGES[1][1](spark, out, sf)
    assert out.columns == columns and sorted(r.doc_id for r in out.collect()) == sorted(kept)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {d for d, _ in leaks([(i, rows[i].text) for i in kept], items)}
    out = corpus_pipeline.STAGES[2][1](spark, out, sf)
    left = sorted(r.doc_id for r in out.collect())
    assert out.columns == columns and left == sorted(i for i in kept if i not in dirty)
    plan = {r.doc_id: r.copies for r in mix_plan(out, seed=3).collect()}
    mixed = sorted(i for i in left for _ in range(plan[i]))
    final = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in final) == mixed
    shards = [sum(r.shard == s for r in final) for s in range(corpus_pipeline.SHARDS)]
    assert max(shards) - min(shards) <= 1


CLASHES = ("row", "label", "lead_id", "text_hash", "copies", "size", "bin", "key", "kept", "n", "time", "total")


@pytest.fixture
def clashing(odd):
    return odd.select("*", *[F.col("doc_id").alias(c) for c in CLASHES])


def test_stages_on_odd_rows(spark, sf, clashing, none):
    """Nulls, blanks, repeated rows, null ids and clashing names, and an empty table, at each stage."""
    from voxweave.llm.common import as_table

    for name, stage in corpus_pipeline.STAGES:
        last = name == corpus_pipeline.STAGES[-1][0]
        out = as_table(stage(spark, clashing, sf), name)
        assert out.columns[: len(clashing.columns)] == clashing.columns and (last or out.columns == clashing.columns)
        if name in ("quality_rules", "minhash_near_dedup", "benchmark_decontamination"):
            assert out.exceptAll(clashing).isEmpty()  # rows go or stay; none is made or changed
        if name == "quality_rules":
            assert out.where("text is null or length(text) < 50").isEmpty()
        if last:
            assert out.count() == clashing.count()
        assert stage(spark, none, sf).count() == 0


def test_near_dedup_broadcasts_no_postings(spark, sf, monkeypatch):
    """The stage over documents: Spark takes 48 postings for one row, and sent them or their counts through the driver."""
    from voxweave.llm import minhash

    plans, plain = {}, minhash.as_table

    def noted(df, label):
        plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString())
        return plain(df, label)

    monkeypatch.setattr(minhash, "as_table", noted)
    corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert "SortMergeJoin" in plans["minhash-lists"] and "Broadcast" not in plans["minhash-lists"]
