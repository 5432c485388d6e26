"""Sliding windows: overlapping patches, and their weighted merge."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..voxels import AXES, Voxels, spatial_axes
from .spatial import crop


def scan_interval(image: int, roi: int, overlap: float) -> int:
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be in [0, 1)")
    return roi if roi == image else max(int(roi * (1 - overlap)), 1)


def patch_starts(image: int, roi: int, interval: int) -> list[int]:
    """Starts along one axis; the last patch ends with the axis."""
    return [k * interval - max(k * interval + roi - image, 0) for k in range(math.ceil(max(image - roi, 0) / interval) + 1)]


def importance(roi: int, mode: str = "constant", sigma_scale: float = 0.125) -> list[float]:
    """One axis of the separable weight map, before its floor."""
    if mode == "constant":
        return [1.0] * roi
    if mode != "gaussian":
        raise ValueError(f"no such mode: {mode}")
    center, sigma = (roi - 1) / 2, roi * sigma_scale
    return [math.exp(-((i - center) ** 2) / (2 * sigma * sigma)) for i in range(roi)]


def patch_table(vox: Voxels, roi: dict[str, int], overlap: float) -> DataFrame:
    """(patch_id, start_<axis>): the last axis fastest."""
    spark = vox.df.sparkSession
    table = spark.range(1).select(F.lit(0).alias("patch_id"))
    for a in spatial_axes(vox):
        starts = patch_starts(vox.size(a), roi[a], scan_interval(vox.size(a), roi[a], overlap))
        table = table.select("*", F.posexplode(F.array(*map(F.lit, starts))).alias("k", f"start_{a}"))
        table = table.withColumn("patch_id", F.col("patch_id") * len(starts) + F.col("k")).drop("k")
    return table


def pad(vox: Voxels, mode: str = "constant", fill: float = 0.0, **widths: tuple[int, int]) -> Voxels:
    """Cells added before and after the named axes: constant, edge, reflect, symmetric or wrap.

    Each added cell is copied from one voxel of the axis (constants hang on the first), so nothing is shuffled.
    """
    if mode not in ("constant", "edge", "reflect", "symmetric", "wrap"):
        raise ValueError(f"no such mode: {mode}")
    for axis, (before, after) in widths.items():
        n = vox.size(axis)
        source = np.zeros(before + n + after, int) if mode == "constant" else np.pad(np.arange(n), (before, after), mode=mode)
        source[before : before + n] = np.arange(n)
        to = F.array(*[F.array(*[F.lit(int(k)) for k in np.flatnonzero(source == j)]) for j in range(n)])
        df = vox.df.withColumn("to", F.explode(F.element_at(to, F.col(axis) + 1)))
        if mode == "constant":
            df = df.withColumn("v", F.when(F.col("to") - before == F.col(axis), F.col("v")).otherwise(F.lit(float(fill))))
        vox = vox.mapped(df.withColumn(axis, F.col("to")), vox.resized(**{axis: before + n + after}))
    return vox


def roi_padding(vox: Voxels, roi: dict[str, int]) -> dict[str, tuple[int, int]]:
    """Widths that bring axes shorter than the region up to it, as even as can be."""
    short = {a: max(roi[a] - vox.size(a), 0) for a in spatial_axes(vox)}
    return {a: (n // 2, n - n // 2) for a, n in short.items() if n}


def extract_patches(vox: Voxels, roi: dict[str, int], overlap: float = 0.25) -> DataFrame:
    """(sample_id, patch_id, axes within the patch, v): each voxel goes to the patches over it.

    Membership is listed per axis and exploded, so there is no range join.
    """
    df, count = vox.df.withColumn("patch_id", F.lit(0)), 1
    moved = {}
    for a in spatial_axes(vox):
        starts = patch_starts(vox.size(a), roi[a], scan_interval(vox.size(a), roi[a], overlap))
        member = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(starts)])
        inside = F.filter(member, lambda x: (x["s"] <= F.col(a)) & (F.col(a) < x["s"] + roi[a]))
        df = df.withColumn("m", F.explode(inside)).withColumn("patch_id", F.col("patch_id") * len(starts) + F.col("m.k")).withColumn(f"start_{a}", F.col("m.s")).drop("m")
        moved[a] = F.col(a) - F.col(f"start_{a}")
        count *= len(starts)
    return df.withColumns(moved).select("sample_id", "patch_id", *AXES, "v", *[f"start_{a}" for a in moved])


def weight_map(given: float | list, roi: dict[str, int]) -> np.ndarray:
    """A weight for each place of a patch: a scalar everywhere, or an array of the region's shape, with or without a batch and channel axis of 1."""
    shape, x = tuple(roi.values()), np.asarray(given, float)
    if x.ndim == 0:
        return np.full(shape, float(x))
    if x.shape not in (shape, (1, *shape, 1)):
        raise ValueError(f"a scalar, or weights of shape {shape} or {(1, *shape, 1)}, not {x.shape}")
    return x.reshape(shape)


def resized_weights(weights: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Weights at the size of a model's results, by the nearest place on a grid from corner to corner."""
    for axis, n in enumerate(shape):
        at = np.floor(np.arange(n) * ((weights.shape[axis] - 1) / (n - 1) if n > 1 else 0.0) + 0.5).astype(int)
        weights = np.take(weights, at, axis)
    return weights


def merge_patches(vox: Voxels, patches: DataFrame, roi: dict[str, int], mode: str = "constant", sigma_scale: float = 0.125, weights: float | list | None = None) -> Voxels:
    """Patches (with start_<axis>) back to arrays: sum of v * weight over sum of weights.

    Weights given from outside (see weight_map) take the place of the mode's; they are a table of a row a place, broadcast. Where
    all weights are 0 the result is 0.
    """
    axes = spatial_axes(vox)
    if weights is not None:
        cells = [(*map(int, at), float(w)) for at, w in np.ndenumerate(weight_map(weights, {a: roi[a] for a in axes}))]
        table = vox.df.sparkSession.createDataFrame(cells, ", ".join(f"{a} int" for a in axes) + ", weight double")
        weighted = patches.join(F.broadcast(table), axes).withColumns({a: F.col(a) + F.col(f"start_{a}") for a in axes})  # as long as a patch
        total = F.sum("weight")
        merged = weighted.groupBy("sample_id", *AXES).agg(F.when(total != 0, F.sum(F.col("v") * F.col("weight")) / total).otherwise(0.0).alias("v"))
        return vox.mapped(merged)
    floor = 0.0
    if mode == "gaussian":
        floor = max(reduce(lambda x, y: x * y, [min(importance(roi[a], mode, sigma_scale)) for a in axes]), 1e-3)
    weight = reduce(lambda x, y: x * y, [F.element_at(F.array(*map(F.lit, importance(roi[a], mode, sigma_scale))), F.col(a) + 1) for a in axes])
    weighted = patches.withColumn("weight", F.greatest(weight, F.lit(floor))).withColumns({a: F.col(a) + F.col(f"start_{a}") for a in axes})
    merged = weighted.groupBy("sample_id", *AXES).agg((F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("v"))
    return vox.mapped(merged)


def sliding_window(
    vox: Voxels, roi: dict[str, int], model: Callable[[DataFrame], DataFrame], overlap: float = 0.25, mode: str = "constant", padding: str = "constant", fill: float = 0.0, weights: float | list | None = None
) -> Voxels:
    """Patches through a model (DataFrame of patches to the same columns), merged.

    An array smaller than the region is padded before, and its result cropped after.
    """
    widths = roi_padding(vox, roi)
    padded = pad(vox, padding, fill, **widths)
    out = merge_patches(padded, model(extract_patches(padded, roi, overlap)), roi, mode, weights=weights)
    return crop(out, **{a: (n, n + vox.size(a)) for a, (n, _) in widths.items()}) if widths else out


def best_slices(vox: Voxels, axis: str = "d") -> DataFrame:
    """(sample_id, <axis>, total): of merged maps, the slice with the highest sum, the first of equals."""
    sums = vox.df.groupBy("sample_id", axis).agg(F.sum("v").alias("total"))
    best = sums.groupBy("sample_id").agg(F.max(F.struct("total", (-F.col(axis)).alias("at"))).alias("b"))
    return best.select("sample_id", (-F.col("b.at")).alias(axis), F.col("b.total").alias("total"))


def merged_maps(vox: Voxels, maps: DataFrame, roi: dict[str, int], mode: str = "gaussian") -> Voxels:
    """Activation maps of patches (with start_<axis>) merged, cut at 0 and divided by each array's maximum, where that is above 0."""
    merged = merge_patches(vox, maps, roi, mode).values(F.greatest(F.col("v"), F.lit(0.0)))
    top = merged.df.groupBy("sample_id").agg(F.max("v").alias("top"))
    return vox.mapped(merged.df.join(top, "sample_id").withColumn("v", F.when(F.col("top") > 0, F.col("v") / F.col("top")).otherwise(F.col("v"))), merged.shape)


def shift_mask(height: int, width: int, window: int, shift: int, spark: SparkSession) -> DataFrame:
    """(win, i, j, mask): -100 where two places of a shifted window come from different regions, else 0."""
    band = lambda x, n: F.when(x < n - window, 0).when(x < n - shift, 1).otherwise(2)
    h, w = F.floor(F.col("id") / width).cast("int"), (F.col("id") % width).cast("int")
    win = (F.floor(h / window) * (width // window) + F.floor(w / window)).cast("int")
    cells = spark.range(height * width).select(win.alias("win"), ((h % window) * window + w % window).alias("i"), (band(h, height) * 3 + band(w, width)).alias("region"))
    other = cells.select("win", F.col("i").alias("j"), F.col("region").alias("other"))
    return cells.join(other, "win").select("win", "i", "j", F.when(F.col("region") == F.col("other"), 0.0).otherwise(-100.0).alias("mask"))


def window_partition(vox: Voxels, **size: int) -> DataFrame:
    """Blocks that don't overlap: (sample_id, win, pos, c, v)."""
    win, pos = F.lit(0), F.lit(0)
    for a in spatial_axes(vox):
        if vox.size(a) % size[a]:
            raise ValueError(f"{a} is not a multiple of {size[a]}")
        win = win * (vox.size(a) // size[a]) + F.expr(f"cast({a} div {size[a]} as int)")
        pos = pos * size[a] + F.col(a) % size[a]
    return vox.df.select("sample_id", win.alias("win"), pos.alias("pos"), "c", "v")


def window_reverse(vox: Voxels, blocks: DataFrame, **size: int) -> Voxels:
    """Exact inverse of window_partition; vox gives the shape."""
    win, pos, cols = "win", "pos", {}
    for a in reversed(spatial_axes(vox)):
        n, s = vox.size(a) // size[a], size[a]
        cols[a] = F.expr(f"cast((({win}) % {n}) * {s} + ({pos}) % {s} as int)")
        win, pos = f"({win}) div {n}", f"({pos}) div {s}"
    return vox.mapped(blocks.withColumns({a: F.lit(0) for a in AXES if a not in cols and a != "c"} | cols))


def patch_merging(vox: Voxels) -> Voxels:
    """Each 2-wide phase of space becomes a set of channels of its own, at half the size."""
    axes, phase = spatial_axes(vox), F.lit(0)
    for a in axes:
        phase = phase + (F.col(a) % 2) * (1 << axes.index(a))
    moved = {a: F.expr(f"cast({a} div 2 as int)") for a in axes} | {"c": phase * vox.size("c") + F.col("c")}
    return vox.mapped(vox.df.withColumns(moved), vox.resized(**{a: vox.size(a) // 2 for a in axes}, c=vox.size("c") << len(axes)))
