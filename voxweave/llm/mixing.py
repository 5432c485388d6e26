"""Mixing sources to target weights by systematic sampling.

A source's target is its share of all words by weight, filled up to a cap of
`CAP` times what it has; the excess goes to the others by weight. Each of its
documents then expects target / source_size copies. In a fixed order of the
source's documents, expected copies are prefix-summed, one random offset is added
per source, and a document is emitted once per integer that its interval crosses.

The order within a source runs by length bin, then a salt, then length, so the
sample is spread evenly over long and short documents. There is a salt for each
`ROWS_A_SALT` rows of the table, `SALTS` at least, so each (source, bin, salt) stays small
enough for one sort at any size, even if a source has a third of all rows. Ranks start
from running sums over those groups' counts, which are combined map-side and written once.

Defined cases: a null source is a source, last in order; a null or blank text has
size 0 and expects as many copies as others of its source (it carries no words); a
source without words has target 0 and emits nothing; rows that are equal stay
separate rows; an empty table gives no rows; other columns pass through, but for
those named like a new column, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import as_table, col
from .tokens import pieces, word_spans

WEIGHTS = (5, 2, 1)
CAP = 3
SALTS = 16
ROWS_A_SALT = 1 << 20
#: Length bins per doubling of the length.
FINENESS = 4


@F.arrow_udf(LongType())
def word_count(texts: pa.Array) -> pa.Array:
    """Words of each text; a null text has none."""
    counts = [word_spans(data, offsets)[2] for _, _, data, offsets in pieces(texts)]
    return pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Water filling in closed form: sorted by cap / weight, the capped sources are the
    first k, for the least k whose remaining level stays below the next ratio.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nth = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    base = sources.withColumn("weight", nth.cast("long")).withColumn("cap", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = base.select(
        "*",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
    )
    # where a source is not capped, neither are those after it; the first of them sets the level
    free = F.col("left").cast("double") / F.col("open") * F.col("weight") <= F.col("cap")
    first = F.min(F.when(free, F.struct(F.col("cap") / F.col("weight"), F.col("left"), F.col("open")))).over(every)
    level = level.withColumn("free", free).withColumn("first", first)
    share = F.col("first")["left"].cast("double") / F.col("first")["open"] * F.col("weight")
    return level.select("source", "source_size", F.when(F.col("free"), share).otherwise(F.col("cap").cast("double")).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A uniform in [0, 1) from an md5 prefix, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def _planned(df: DataFrame, seed: int, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(row, size, source_size, target, copies), row being a struct of df's columns."""
    size = word_count(F.col("text"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = df.select(F.struct(*[col(c) for c in df.columns]).alias("row"), F.col("source").alias("source"), size.alias("size"), key.alias("key"))
    rows = rows.withColumn("bin", F.floor(F.log2(F.col("size") + F.lit(1.0)) * FINENESS).cast("int"))
    rows = rows.withColumn("salt", F.pmod(F.conv(F.substring("key", 9, 8), 16, 10).cast("long"), F.lit(max(SALTS, df.count() // ROWS_A_SALT))))
    rows = rows.withColumn("text_hash", F.xxhash64("row.text"))
    cells = rows.groupBy("source", "bin", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    cells = as_table(cells, "mix-cells")
    per_source = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    in_source = Window.partitionBy("source").orderBy("bin", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("base", F.coalesce(F.sum("n").over(in_source), F.lit(0))).select("source", "bin", "salt", "base")
    starts = starts.alias("a").join(per_source.alias("b"), F.expr("a.source <=> b.source")).select("a.*", "source_size", "target")
    starts = starts.select(F.col("source").alias("s"), F.col("bin").alias("b"), F.col("salt").alias("t"), "base", "source_size", "target")
    rank = F.row_number().over(Window.partitionBy("source", "bin", "salt").orderBy("size", "key", "row.doc_id", "text_hash"))
    ranked = rows.withColumn("rank", rank.cast("long"))
    joined = ranked.join(starts, F.expr("source <=> s AND bin = b AND salt = t"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = _uniform(F.lit(str(seed)), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))
    upto = F.col("base") + F.col("rank")
    crossed = F.floor(offset + rate * upto) - F.floor(offset + rate * (upto - 1))
    # rate <= cap bounds the crossings too; least() is for a last digit lost in doubles
    return joined.select("row", "size", "source_size", "target", F.least(crossed, F.lit(cap)).cast("long").alias("copies"))


def mix_plan(df: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """df, one row for each of its rows, with size, source_size, target, copies, taken."""
    new = {"size", "source_size", "target", "copies", "taken"}
    kept = [F.col("row").getField(c).alias(c) for c in df.columns if c.lower() not in new]
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return _planned(df, seed, weights, cap).select(*kept, "size", "source_size", "target", "copies", taken)


def mix(df: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixed table: each row of df as often as its copies, with df's columns."""
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("time")
    repeated = _planned(df, seed, weights, cap).where("copies > 0").select("row", times)
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by the weights 5, 2, 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_plan(docs, seed=3).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = """
WITH d AS (
  SELECT doc_id, source, text, md5('3|' || coalesce(doc_id::VARCHAR, '')) AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents
), c AS (
  SELECT *, floor(log2(size + 1.0::DOUBLE) * 4)::INT AS bin, ('0x' || substr(key, 9, 8))::BIGINT % greatest(16, (SELECT count(*) FROM documents) // 1048576) AS salt FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM c GROUP BY source
), w AS (
  SELECT *, 3 * source_size AS cap, (ARRAY[5, 2, 1])[((nth - 1) % 3 + 1)::INT] AS weight FROM s
), l AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w
), f AS (
  SELECT *, rest::DOUBLE / open::DOUBLE * weight <= cap AS free FROM l
), t AS (
  SELECT f.source, f.source_size, CASE WHEN free THEN x.rest::DOUBLE / x.open::DOUBLE * weight ELSE cap::DOUBLE END AS target
  FROM f CROSS JOIN (SELECT rest, open FROM f WHERE free ORDER BY cap / weight, rest, open LIMIT 1) x
), p AS (
  SELECT c.doc_id, c.size, t.source_size, t.target,
    row_number() OVER (PARTITION BY c.source ORDER BY bin, salt, size, key, doc_id) AS upto,
    ('0x' || substr(md5('3|' || coalesce('s' || c.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (least(floor(u + rate * upto) - floor(u + rate * (upto - 1)), 3) * size)::BIGINT AS taken
FROM p
"""
