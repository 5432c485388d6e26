"""Spatial operators: index arithmetic, range filters and gather joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import half_even
from ..voxels import AXES, Voxels, grid, spatial_axes


def flip(vox: Voxels, *axes: str) -> Voxels:
    """Reverse the given axes; flip is its own inverse."""
    changed = {a: F.lit(vox.size(a) - 1) - F.col(a) for a in axes}
    return vox.mapped(vox.df.withColumns(changed)) if changed else vox


def rotate90(vox: Voxels, k: int = 1, plane: tuple[str, str] = ("h", "w")) -> Voxels:
    """Quarter turns from the plane's first axis to its second; -k undoes k."""
    a, b = plane
    na, nb = vox.size(a), vox.size(b)
    moved = {
        0: (F.col(a), F.col(b), na, nb),
        1: (F.lit(nb - 1) - F.col(b), F.col(a), nb, na),
        2: (F.lit(na - 1) - F.col(a), F.lit(nb - 1) - F.col(b), na, nb),
        3: (F.col(b), F.lit(na - 1) - F.col(a), nb, na),
    }[k % 4]
    return vox.mapped(vox.df.withColumns({a: moved[0], b: moved[1]}), vox.resized(**{a: moved[2], b: moved[3]}))


def permute(vox: Voxels, order: tuple[str, str, str]) -> Voxels:
    """New axes d, h, w take their indices from `order`."""
    moved = {new: F.col(old) for new, old in zip(AXES, order)}
    return vox.mapped(vox.df.withColumns(moved), vox.resized(**{new: vox.size(old) for new, old in zip(AXES, order)}))


def crop_bounds(n: int, size: int, start: int | None = None, center: int | None = None) -> tuple[int, int]:
    """[start, end) of a crop of an axis of n: moved inside, and all of it if size <= 0."""
    size = n if size <= 0 else min(size, n)
    at = start if start is not None else max((center if center is not None else n // 2) - size // 2, 0)
    at = max(0, min(at, n - size))
    return at, at + size


def crop(vox: Voxels, **bounds: tuple[int, int]) -> Voxels:
    """Keep [start, end) of the named axes."""
    inside = reduce(lambda x, y: x & y, [(F.col(a) >= lo) & (F.col(a) < hi) for a, (lo, hi) in bounds.items()])
    moved = {a: F.col(a) - lo for a, (lo, _) in bounds.items()}
    return vox.mapped(vox.df.where(inside).withColumns(moved), vox.resized(**{a: hi - lo for a, (lo, hi) in bounds.items()}))


def uncrop(vox: Voxels, shape: tuple[int, int, int, int], **starts: int) -> Voxels:
    """Put a crop back into a canvas of zeros."""
    placed = vox.df.withColumns({a: F.col(a) + s for a, s in starts.items()})
    canvas = grid(vox.df, shape).join(placed, ["sample_id", *AXES], "left")
    return vox.mapped(canvas.withColumn("v", F.coalesce("v", F.lit(0.0))), shape)


def foreground_box(vox: Voxels, margin: int = 0, k_divisible: int = 1, select: Column | None = None) -> DataFrame:
    """(sample_id, start_<axis>, end_<axis>): the box around selected voxels of any channel.

    A sample without any has the whole array. Margins stop at the border; ends grow to a multiple of
    k_divisible, as far as the border allows.
    """
    chosen = F.col("v") > 0 if select is None else select
    axes = spatial_axes(vox)
    aggs = [f(F.when(chosen, F.col(a))).alias(f"{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))]
    out = vox.df.groupBy("sample_id").agg(*aggs)
    cols = []
    for a in axes:
        n = vox.size(a)
        start = F.greatest(F.coalesce(F.col(f"lo_{a}"), F.lit(0)) - margin, F.lit(0))
        end = F.least(F.coalesce(F.col(f"hi_{a}") + 1, F.lit(n)) + margin, F.lit(n))
        grown = start + F.ceil((end - start) / k_divisible).cast("int") * k_divisible
        cols += [start.cast("int").alias(f"start_{a}"), F.least(grown, F.lit(n)).cast("int").alias(f"end_{a}")]
    return out.select("sample_id", *cols)


def crop_foreground(vox: Voxels, margin: int = 0, k_divisible: int = 1) -> DataFrame:
    """Voxels inside each sample's foreground box, with indices from its corner."""
    box = foreground_box(vox, margin, k_divisible)
    joined = vox.df.join(box, "sample_id")
    for a in spatial_axes(vox):
        joined = joined.where((F.col(a) >= F.col(f"start_{a}")) & (F.col(a) < F.col(f"end_{a}"))).withColumn(a, F.col(a) - F.col(f"start_{a}"))
    return joined.select("sample_id", *AXES, "v")


def axis_taps(vox: Voxels, axis: str, n: int, mode: str, align_corners: bool = False) -> DataFrame:
    """(to, from, weight) along one axis: which indices make up each index of the result."""
    size = vox.size(axis)
    spark = vox.df.sparkSession
    to = spark.range(n).select(F.col("id").cast("int").alias("to"))
    x = F.col("to").cast("double")
    corner = x * F.lit((size - 1) / (n - 1) if n > 1 else 0.0)
    if mode == "nearest":
        return to.select("to", half_even(corner).alias("from"), F.lit(1.0).alias("weight"))
    if mode == "truncate":
        return to.select("to", F.floor(corner).cast("int").alias("from"), F.lit(1.0).alias("weight"))
    if mode == "linear":
        pos = corner if align_corners else F.least(F.greatest((x + 0.5) * F.lit(size / n) - 0.5, F.lit(0.0)), F.lit(float(size - 1)))
        low, f = F.floor(pos).cast("int"), pos - F.floor(pos)
        taps = F.array(F.struct(low.alias("from"), (1 - f).alias("weight")), F.struct(F.least(low + 1, F.lit(size - 1)).alias("from"), f.alias("weight")))
    elif mode == "cubic":
        low, f = F.floor(corner).cast("int"), corner - F.floor(corner)
        weights = [(-f + 2 * f * f - f * f * f) / 2, (2 - 5 * f * f + 3 * f * f * f) / 2, (f + 4 * f * f - 3 * f * f * f) / 2, (f * f * f - f * f) / 2]
        at = lambda k: F.least(F.greatest(low + k - 1, F.lit(0)), F.lit(size - 1))
        taps = F.array(*[F.struct(at(k).alias("from"), wt.alias("weight")) for k, wt in enumerate(weights)])
    else:
        raise ValueError(f"no such mode: {mode}")
    return to.select("to", F.explode(taps).alias("t")).select("to", "t.from", "t.weight")


def resize(vox: Voxels, mode: str = "linear", align_corners: bool = False, **sizes: int) -> Voxels:
    """Resample axes to new sizes, one axis at a time; each tap table is as long as the axis."""
    for axis, n in sizes.items():
        if n == vox.size(axis) and mode != "cubic":
            continue
        taps = F.broadcast(axis_taps(vox, axis, n, mode, align_corners))  # at most 4 n rows
        joined = vox.df.join(taps, F.col(axis) == F.col("from"))
        if mode in ("nearest", "truncate"):
            out = joined.withColumn(axis, F.col("to"))
        else:
            rest = [a for a in AXES if a != axis]
            out = joined.groupBy("sample_id", *rest, F.col("to").alias(axis)).agg(F.sum(F.col("v") * F.col("weight")).alias("v"))
        vox = vox.mapped(out, vox.resized(**{axis: n}))
    return vox


def sample_at(vox: Voxels, points: DataFrame, mode: str = "nearest", fill: float = 0.0) -> DataFrame:
    """Values at points (sample_id, point, x, y, z) in voxel coordinates: (sample_id, point, c, v).

    Nearest rounds half to even. Trilinear mixes the fill into voxels at the border.
    """
    if mode == "nearest":
        taps = points.select("sample_id", "point", *[half_even(F.col(p)).alias(a) for p, a in zip("xyz", "dhw")], F.lit(1.0).alias("weight"))
    else:
        corners = []
        for k in range(8):
            parts, weight = [], F.lit(1.0)
            for axis, (p, a) in enumerate(zip("xyz", "dhw")):
                low, f = F.floor(F.col(p)), F.col(p) - F.floor(F.col(p))
                up = k >> axis & 1
                parts.append((low + up).cast("int").alias(a))
                weight = weight * (f if up else 1 - f)
            corners.append(F.struct(*parts, weight.alias("weight")))
        taps = points.select("sample_id", "point", F.explode(F.array(*corners)).alias("t")).select("sample_id", "point", "t.*")
    taps = taps.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(vox.size("c") - 1))))
    found = taps.join(vox.df, ["sample_id", *AXES], "left")
    value = F.sum(F.col("weight") * F.coalesce(F.col("v"), F.lit(float(fill))))
    return found.groupBy("sample_id", "point", "c").agg(value.alias("v"))


def affine_resample(vox: Voxels, matrix: tuple[float, ...], shape: tuple[int, int, int], mode: str = "linear", fill: float = 0.0) -> Voxels:
    """A new grid whose voxel (d, h, w) is read at matrix * (d, h, w, 1); outside is fill."""
    d, h, w = shape
    cells = grid(vox.df, (d, h, w, 1))
    at = [sum((F.lit(float(matrix[r * 4 + k])) * F.col(a) for k, a in enumerate("dhw")), F.lit(float(matrix[r * 4 + 3]))) for r in range(3)]
    points = cells.select("sample_id", F.struct("d", "h", "w").alias("point"), *[x.alias(n) for x, n in zip(at, "xyz")])
    out = sample_at(vox, points, mode, fill).select("sample_id", "point.d", "point.h", "point.w", "c", "v")
    return vox.mapped(out, (d, h, w, vox.size("c")))


def repeat_channels(vox: Voxels, times: int) -> Voxels:
    """Each channel `times` over, side by side."""
    df = vox.df.withColumn("c", F.explode(F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda k: F.col("c") * times + k)))
    return vox.mapped(df, vox.resized(c=vox.size("c") * times))


def label_channels(labels: Voxels, groups: list[list[int]]) -> Voxels:
    """A channel of 0 and 1 for each group of class ids, which may overlap; one class a group is one-hot."""
    if labels.size("c") != 1:
        raise ValueError("labels have one channel")
    hits = F.array(*[F.col("v").isin([float(x) for x in g]).cast("double") for g in groups])
    return labels.mapped(labels.df.select("sample_id", *AXES[:3], F.posexplode(hits).alias("c", "v")), labels.resized(c=len(groups)))


def decode_for_training(image: Voxels, label: Voxels, size: dict[str, int], channels: int = 1, classes: int | None = None) -> tuple[Voxels, Voxels]:
    """An image and its label as a model takes them: resized between corners (labels by the nearest), repeated, one-hot."""
    seen = repeat_channels(resize(image, "linear", True, **size), channels) if image.size("c") != channels else resize(image, "linear", True, **size)
    truth = resize(label, "nearest", **size)
    return seen, truth if classes is None else label_channels(truth, [[k] for k in range(classes)])
