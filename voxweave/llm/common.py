"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of code points other than these six blanks.
BLANKS = "\\x20\\x09-\\x0D"
WORD = f"[^{BLANKS}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    A temporary folder is made only for a local master whose session names none, as in tests; a
    cluster without the setting is an error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="voxweave-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def as_table(df: DataFrame, label: str) -> DataFrame:
    """Write once as Parquet in the shared folder, and read that copy from then on.

    Lineage ends there: a lost executor costs a read. The folder is the caller's to clear when
    the results that were read from it are no longer needed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def col(name: str) -> Column:
    """A top-level column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")

