from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from voxweave.llm.sharding import assign_shards, op1_sharding, permute


@pytest.mark.parametrize("n", [1, 2, 3, 7, 24, 97, 1000])
def test_permutation_is_one(spark, n):
    out = spark.range(n).select(permute(F.col("id"), F.lit(n).cast("long"), 5).alias("p")).collect()
    assert sorted(r.p for r in out) == list(range(n))
    assert n < 20 or [r.p for r in out] != list(range(n))


def test_law_rows_and_reproducible(odd):
    keys = ["doc_id", "source", F.xxhash64("text")]
    a = assign_shards(odd, 5, keys, seed=2).collect()
    b = assign_shards(odd.repartition(7), 5, keys, seed=2).collect()
    assert len(a) == odd.count()
    slots = {}
    for r in a:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(v) for v in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    place = lambda rows: sorted((str(r.doc_id), str(r.text)[:50], r.shard, r.slot) for r in rows)
    assert place(a) == place(b)


def test_empty_and_clashing_columns(odd, none):
    assert assign_shards(none, 3, ["doc_id"]).count() == 0
    out = assign_shards(odd.withColumn("Shard", F.lit("x")).withColumn("bin", F.lit(1)).withColumn("rank", F.lit(2)), 3, ["doc_id"])
    assert sorted(out.columns) == sorted([*odd.columns, "bin", "rank", "shard", "slot", "row_number"])
    with pytest.raises(ValueError):
        assign_shards(odd, 0, ["doc_id"])


def test_query(spark, sf):
    rows = op1_sharding(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    counts = [sum(r.shard == s for r in rows) for s in range(24)]
    assert max(counts) - min(counts) <= 1
