"""Arrays in DataFrames: packed (a row an array) and long (a row a voxel).

Long columns: sample_id, d, h, w, c (int), v (double); channel last, 2D has d = 0. A batch has one
shape, which is known when the plan is built; rows of a sample are spread over partitions freely.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("d", "h", "w", "c")


@dataclass(frozen=True)
class Voxels:
    """A batch of arrays in long form."""

    df: DataFrame
    shape: tuple[int, int, int, int]

    def size(self, axis: str) -> int:
        return self.shape[AXES.index(axis)]

    def resized(self, **sizes: int) -> tuple[int, int, int, int]:
        return tuple(sizes.get(a, n) for a, n in zip(AXES, self.shape))

    def mapped(self, df: DataFrame, shape: tuple[int, int, int, int] | None = None) -> Voxels:
        return replace(self, df=df.select("sample_id", *AXES, "v"), shape=shape or self.shape)

    def values(self, v: Column) -> Voxels:
        return self.mapped(self.df.withColumn("v", v))


def spatial_axes(vox: Voxels) -> list[str]:
    """Axes that span space: (h, w), and d where there is depth."""
    return ["h", "w"] if vox.shape[0] == 1 else ["d", "h", "w"]


def unpack(packed: DataFrame, shape: tuple[int, ...], sample_id: str = "sample_id", data: str = "data") -> Voxels:
    """Row-major arrays, one a row, to voxels. Shapes of two or three axes get depth or channels of 1."""
    if not 2 <= len(shape) <= 4 or any(n < 1 for n in shape):
        raise ValueError(f"not a shape of an array: {shape}")
    full = {2: (1, *shape, 1), 3: (1, *shape), 4: tuple(shape)}[len(shape)]
    _, height, width, channels = full
    rows = packed.select(F.col(sample_id).alias("sample_id"), F.posexplode(data).alias("i", "x"))
    at = lambda step, n: F.expr(f"cast((i div {step}) % {n} as int)")
    return Voxels(
        rows.select(
            "sample_id",
            F.expr(f"cast(i div {height * width * channels} as int)").alias("d"),
            at(width * channels, height).alias("h"),
            at(channels, width).alias("w"),
            at(1, channels).alias("c"),
            F.col("x").cast("double").alias("v"),
        ),
        full,
    )


def pack(vox: Voxels) -> DataFrame:
    """Voxels to (sample_id, shape, data)."""
    _, h, w, c = vox.shape
    cell = F.struct((((F.col("d") * h + F.col("h")) * w + F.col("w")) * c + F.col("c")).alias("i"), "v")
    rows = vox.df.groupBy("sample_id").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    return rows.select("sample_id", F.array(*map(F.lit, vox.shape)).alias("shape"), F.transform("cells", lambda x: x["v"]).alias("data"))


def grid(ids: DataFrame, shape: tuple[int, int, int, int]) -> DataFrame:
    """Every index of the shape for every sample_id."""
    return reduce(lambda df, a: df.withColumn(a[0], F.explode(F.sequence(F.lit(0), F.lit(a[1] - 1)))), zip(AXES, shape), ids.select("sample_id").distinct())


def rounded(x: Column, digits: int = 6) -> Column:
    """A double that other engines agree on: rounded, and never -0.0."""
    return F.round(x, digits) + F.lit(0.0)
