"""Written tables, and exact ranks and batches over them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows are numbered within a partition in the low bits of monotonically_increasing_id: fixed value of Spark.
ROW_BITS = 33


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a temporary one is made for a local master only."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="voxweave-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: lineage ends there. The files are the caller's to clear."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


Order = Sequence[Column | str | tuple[Column | str, bool]]


def ranked(df: DataFrame, order: Order, name: str = "rank") -> DataFrame:
    """df with the exact rank of each row, from 0, in the order of some columns, each upwards unless it comes with False; nulls are least.

    Rows are dealt by ranges of the order and of a hash of the whole row, so that a frequent key is split like any
    other; each task sorts its range and the table is written with places within ranges. A range's first
    rank is the sum of the counts before it: one row a partition. Rows with equal order columns are ranked by
    the hash; equal rows are interchangeable.
    """
    pairs = [c if isinstance(c, tuple) else (c, True) for c in order]
    cols = [F.col(c) if isinstance(c, str) else c for c, _ in pairs]
    keys = [f"_key{k}" for k in range(len(cols))]
    by = [F.col(k).asc() if up else F.col(k).desc() for k, (_, up) in zip(keys, pairs)]
    keyed = df.withColumns(dict(zip(keys, cols))).withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith("map")]))
    dealt = keyed.repartitionByRange(*by, "_tie").sortWithinPartitions(*by, "_tie").drop(*keys, "_tie")
    placed = written(dealt.withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part, nth = F.shiftright("_place", ROW_BITS), F.col("_place").bitwiseAND((1 << ROW_BITS) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    joined = placed.withColumn("_part", part).join(F.broadcast(bases), "_part")  # a row a partition
    return joined.withColumn(name, F.col("_base") + nth).drop("_part", "_base", "_place")


def batches(df: DataFrame, order: Order, size: int, drop_remainder: bool = True) -> DataFrame:
    """df with `batch` and `place` (from 0) of each row: full batches in an order, the remainder left out or not."""
    if size < 1:
        raise ValueError("a batch has one row or more")
    numbered = ranked(df, order, "_rank")
    out = numbered.withColumns({"batch": F.expr(f"_rank div {size}"), "place": F.expr(f"cast(_rank % {size} as int)")})
    if drop_remainder:
        full = numbered.count() // size
        out = out.where(F.col("batch") < full)
    return out.drop("_rank")


def shuffled(seed: int, epoch: int, *keys: Column | str) -> Column:
    """An order that mixes rows, another for each epoch, the same in every run: the md5 of seed, epoch and keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), *[F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]))


def epochs(df: DataFrame, seed: int, epoch: int, size: int, *keys: str, shuffle: bool = True, drop_remainder: bool = True) -> DataFrame:
    """One epoch's batches: in shuffled order, or in that of the keys."""
    order = [shuffled(seed, epoch, *keys), *keys] if shuffle else list(keys)
    return batches(df, order, size, drop_remainder)
