"""Sharding: a reproducible shuffle by a Feistel permutation of row numbers.

Every row gets a global row number, the number goes through a keyed Feistel
permutation of [0, rows) and the permuted position gives shard and slot:
``shard = position % shards`` and ``slot = position // shards``. So shards differ by
one row at most, slots have no gaps, and a reader computes where any row number
went without a table.

Row numbers come from hash bins of the rows' own values, one for each `ROWS_A_BIN` rows of the
table and `BINS` at least: bins are counted with map-side combine, their running sums are
joined on the bin, by which the rows are dealt already, and added to a row's rank within its
bin. The outcome depends on the rows, never on how they are partitioned.

The Feistel network works on pairs (left < a, right < b) with a*b barely above
rows, so a permuted number seldom falls outside; those that do walk their cycle
until they are inside. A walk visits outside points only once each and there
are fewer than `a` of them, which bounds its length.

Defined cases: null ids and texts are values like others; rows equal in all of the key
columns are interchangeable, so the output as a set of rows is the same in every run;
an empty table gives no rows; other columns pass through, and a column of
the caller's that has the name of a new one is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col

BINS = 4096
ROWS_A_BIN = 1 << 18
ROUNDS = 6
#: Walks beyond this do not happen: each leaves 1/b of what is outside, b > 30 for any table where it binds.
MOST_WALKS = 64


def permute(x: Column, rows: Column, seed: int) -> Column:
    """The position of row number x (0 <= x < rows) under the keyed permutation."""
    a = F.greatest(F.lit(1), F.ceil(F.sqrt(rows.cast("double")))).cast("long")
    b = F.expr("1L") * F.ceil(rows / a).cast("long")

    def once(v: Column) -> Column:
        def turn(s: Column, i: Column) -> Column:
            left = (s["l"] + F.pmod(F.xxhash64(s["r"], i, F.lit(seed)), a)) % a
            right = (s["r"] + F.pmod(F.xxhash64(s["l"], i, F.lit(seed)), b)) % b
            even = i % 2 == 0
            return F.struct(F.when(even, left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(right).alias("r"))

        first = F.struct(F.floor(v / b).cast("long").alias("l"), (v % b).alias("r"))
        return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), first, turn, lambda s: s["l"] * b + s["r"])

    walks = F.sequence(F.lit(1), F.least(a, F.lit(MOST_WALKS)).cast("int"))
    walked = F.aggregate(walks, once(x), lambda v, _: F.when(v < rows, v).otherwise(once(v)))
    return walked


def assign_shards(df: DataFrame, shards: int, keys: list[str | Column], seed: int = 0) -> DataFrame:
    """df with shard (int), slot (long) and row_number (long); keys order the rows."""
    if shards < 1:
        raise ValueError("shards must be positive")
    new = {"shard", "slot", "row_number"}
    kept = [c for c in df.columns if c.lower() not in new]
    order = [col(k) if isinstance(k, str) else k for k in keys]
    # the caller's columns travel in one struct, so no name of theirs can clash
    spread = F.pmod(F.xxhash64(*order, F.lit(seed)), F.lit(max(BINS, df.count() // ROWS_A_BIN))).cast("int")
    rows = df.select(F.struct(*[col(c) for c in kept]).alias("row"), F.struct(*order).alias("key"), spread.alias("bin"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        rows.groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(everything).alias("total"))
    )
    rank = F.row_number().over(Window.partitionBy("bin").orderBy("key")).cast("long")
    numbered = rows.withColumn("rank", rank).join(bins, "bin")
    numbered = numbered.withColumn("row_number", F.col("base") + F.col("rank") - 1)
    placed = numbered.withColumn("position", permute(F.col("row_number"), F.col("total"), seed))
    sound = F.when(F.col("position") < F.col("total"), F.col("position")).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long"))
    placed = placed.withColumn("position", sound)
    return placed.select(
        *[F.col("row").getField(c).alias(c) for c in kept],
        (F.col("position") % shards).cast("int").alias("shard"),
        F.floor(F.col("position") / shards).cast("long").alias("slot"),
        "row_number",
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 24 shards by the law `rows`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
    )
    out = assign_shards(docs, 24, ["doc_id", "size", "text_crc32", "text_hash"], seed=1)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
