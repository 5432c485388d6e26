"""A training corpus from `documents`, in five stages.

Each stage is (name, function of (spark, docs, sf_dir)) and returns a DataFrame; all but
the last return the columns of the documents they got.

Defined cases, at every stage: an empty table gives an empty one; null ids and sources are
values like others; columns beyond those of `documents` pass through under any name, but for
`shard`, `slot` and `row_number`, which the last stage replaces. Null and blank texts go in
the first stage, as they have fewer words than the rules ask for; the later stages, when they
are given some, keep them (the fourth may leave out or repeat them like other rows of their
source). Of repeated rows the near-duplicate stage keeps one; the others judge each alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxweave.llm.common import as_table, col
from voxweave.llm.decontam import decontaminate
from voxweave.llm.minhash import drop_near_duplicates
from voxweave.llm.mixing import mix
from voxweave.llm.quality import apply_policy, ledger
from voxweave.llm.sharding import assign_shards

SHARDS = 24


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the strict policy rejects."""
    rows = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    kept = apply_policy(ledger(rows), "strict-1").where("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return drop_near_duplicates(docs, width=5, threshold=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, some repeated or left out, so that sources have their target shares."""
    return mix(docs, seed=3)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot in a reproducible shuffle."""
    return assign_shards(docs, SHARDS, ["doc_id", F.xxhash64("text")], seed=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = as_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Signatures and permutations have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None
