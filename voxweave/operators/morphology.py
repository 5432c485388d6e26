"""Neighbourhood windows: soft morphology and pooling."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..voxels import AXES, Voxels, spatial_axes


def _along(axis: str):
    return Window.partitionBy("sample_id", *[a for a in AXES if a != axis]).orderBy(axis).rowsBetween(-1, 1)


def erode(vox: Voxels) -> Voxels:
    """Least of the three-long minima along each axis."""
    return vox.values(F.least(*[F.min("v").over(_along(a)) for a in spatial_axes(vox)]))


def dilate(vox: Voxels) -> Voxels:
    """Maximum over the neighbourhood of three along every axis at once."""
    for a in spatial_axes(vox):
        vox = vox.values(F.max("v").over(_along(a)))
    return vox


def opened(vox: Voxels) -> Voxels:
    return dilate(erode(vox))


def skeleton(vox: Voxels, iterations: int) -> Voxels:
    """Soft skeleton: what opening removes, gathered over successive erosions."""
    keys = ["sample_id", *AXES]
    relu = lambda x: F.greatest(x, F.lit(0.0))

    def lost(v: Voxels) -> DataFrame:
        return opened(v).df.withColumnRenamed("v", "o").join(v.df, keys).select(*keys, F.col("v"), relu(F.col("v") - F.col("o")).alias("delta"))

    state = lost(vox).withColumnRenamed("delta", "skel")
    for _ in range(iterations):
        thinner = erode(vox.mapped(state))
        step = lost(thinner).join(state.select(*keys, "skel"), keys)
        state = step.withColumn("skel", F.col("skel") + relu(F.col("delta") - F.col("skel") * F.col("delta"))).drop("delta")
    return vox.mapped(state.withColumn("v", F.col("skel")))


def adaptive_pool(vox: Voxels, kind: str = "avg", **sizes: int) -> Voxels:
    """Pool each axis to a size: window i is [floor(i n / m), ceil((i + 1) n / m))."""
    df = vox.df
    for a, m in sizes.items():
        n = vox.size(a)
        spans = [(i, i * n // m, math.ceil((i + 1) * n / m)) for i in range(m)]
        of = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, lo, hi in spans])
        inside = F.filter(of, lambda x: (x["lo"] <= F.col(a)) & (F.col(a) < x["hi"]))
        df = df.withColumn("t", F.explode(inside)).withColumn(a, F.col("t.i")).drop("t")
    agg = {"avg": F.avg, "max": F.max}[kind]
    return vox.mapped(df.groupBy("sample_id", *AXES).agg(agg("v").alias("v")), vox.resized(**sizes))


def zero_pad(vox: Voxels, **pads: tuple[int, int]) -> Voxels:
    from .spatial import uncrop

    shape = vox.resized(**{a: vox.size(a) + sum(p) for a, p in pads.items()})
    return uncrop(vox, shape, **{a: lo for a, (lo, _) in pads.items()})


def upsample(vox: Voxels, **times: int) -> Voxels:
    """Repeat each index of an axis."""
    df = vox.df
    for a, n in times.items():
        df = df.withColumn(a, F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.col(a) * n + k)))
    return vox.mapped(df, vox.resized(**{a: vox.size(a) * n for a, n in times.items()}))


def convolve(vox: Voxels, kernel: dict[tuple[int, int, int], float], stride: int = 1, dilation: int = 1) -> Voxels:
    """'Same' convolution by a spatial kernel {(dd, dh, dw): weight}, each channel alone.

    Every voxel is sent to the places that it contributes to, and these are summed.
    """
    taps = F.array(*[F.struct(*[F.lit(-k * dilation).alias(a) for k, a in zip(at, "dhw")], F.lit(float(x)).alias("x")) for at, x in kernel.items()])
    sent = vox.df.withColumn("t", F.explode(taps))
    place = {a: F.col(a) + F.col(f"t.{a}") for a in "dhw"}
    sent = sent.withColumns(place).withColumn("v", F.col("v") * F.col("t.x"))
    inside = reduce(lambda x, y: x & y, [(F.col(a) >= 0) & (F.col(a) < vox.size(a)) & (F.col(a) % stride == 0) for a in spatial_axes(vox)])
    inside = inside & (F.col("d") >= 0) & (F.col("d") < vox.size("d"))
    summed = sent.where(inside).groupBy("sample_id", *AXES).agg(F.sum("v").alias("v"))
    out = vox.mapped(summed)
    if stride == 1:
        return out
    moved = {a: F.expr(f"cast({a} div {stride} as int)") for a in spatial_axes(vox)}
    return out.mapped(out.df.withColumns(moved), out.resized(**{a: -(-out.size(a) // stride) for a in spatial_axes(out)}))


def convolve_channels(vox: Voxels, kernel: list, stride: int = 1, transpose: bool = False) -> Voxels:
    """A convolution that mixes channels, padded with zeros to the same size (divided by stride).

    kernel is nested as (h, w, in, out), or (d, h, w, in, out) for volumes. Transposed, each voxel is spread over
    its neighbourhood in an array `stride` times as large. The kernel, a parameter, is broadcast;
    contributions are summed before they are shuffled.
    """
    axes = spatial_axes(vox)
    weights = np.asarray(kernel, dtype=float)
    if weights.ndim != len(axes) + 2 or weights.shape[-2] != vox.size("c"):
        raise ValueError("the kernel does not fit the array")
    taps = [(*map(int, at[:-2]), int(at[-2]), int(at[-1]), float(weights[at])) for at in np.ndindex(*weights.shape)]
    names = [*[f"k_{a}" for a in axes], "k_in", "k_out"]
    table = vox.df.sparkSession.createDataFrame(taps, ", ".join(f"{n} int" for n in names) + ", weight double")
    df = vox.df.join(F.broadcast(table), F.col("c") == F.col("k_in"))  # as long as the kernel
    sizes, moved = {}, {}
    for a, width in zip(axes, weights.shape):
        if transpose:
            before = max(width - stride, 0) // 2
            sizes[a] = vox.size(a) * stride
            place = F.col(a) * stride + F.col(f"k_{a}") - before
        else:
            sizes[a] = -(-vox.size(a) // stride)
            before = max((sizes[a] - 1) * stride + width - vox.size(a), 0) // 2
            ahead = F.col(a) - F.col(f"k_{a}") + before
            df = df.where(F.pmod(ahead, F.lit(stride)) == 0)
            place = F.floor(ahead / stride).cast("int")
        df = df.where((place >= 0) & (place < sizes[a]))
        moved[a] = place
    rest = [a for a in ("d",) if a not in axes]
    sums = df.groupBy("sample_id", *rest, *[x.alias(a) for a, x in moved.items()], F.col("k_out").alias("c")).agg(F.sum(F.col("v") * F.col("weight")).alias("v"))
    return vox.mapped(sums, vox.resized(**sizes, c=weights.shape[-1]))
