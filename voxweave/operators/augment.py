"""Seeded random operators: what happens to a sample depends on the seed and its id alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import gumbel, uniform
from ..voxels import AXES, Voxels, grid

def _hit(seed: int, draw: int, prob: float):
    if not 0 <= prob <= 1:
        raise ValueError("prob must be in [0, 1]")
    return uniform(seed, F.col("sample_id"), draw) < F.lit(float(prob))

def random_flip(vox: Voxels, seed: int, prob: float = 0.1, axes: tuple[str, ...] = ("w",)) -> Voxels:
    hit = _hit(seed, 0, prob)
    return vox.mapped(vox.df.withColumns({a: F.when(hit, F.lit(vox.size(a) - 1) - F.col(a)).otherwise(F.col(a)) for a in axes}))

def random_rotate90(vox: Voxels, seed: int, prob: float = 0.1, max_k: int = 3) -> Voxels:
    """A number of quarter turns in 1 .. max_k of square planes."""
    n = vox.size("h")
    if n != vox.size("w"):
        raise ValueError("the plane must be square, or rows would differ in shape")
    k = F.when(_hit(seed, 0, prob), 1 + F.floor(uniform(seed, F.col("sample_id"), 1) * max_k)).otherwise(0)
    h, w, last = F.col("h"), F.col("w"), F.lit(n - 1)
    df = vox.df.withColumn("k", k)
    turned = {
        "h": F.when(F.col("k") == 1, last - w).when(F.col("k") == 2, last - h).when(F.col("k") == 3, w).otherwise(h),
        "w": F.when(F.col("k") == 1, h).when(F.col("k") == 2, last - w).when(F.col("k") == 3, last - h).otherwise(w),
    }
    return vox.mapped(df.withColumns(turned))

def random_shift(vox: Voxels, seed: int, low: float, high: float, prob: float = 0.1, channel_wise: bool = False) -> Voxels:
    u = uniform(seed, F.col("sample_id"), 1, *([F.col("c")] if channel_wise else []))
    return vox.values(F.when(_hit(seed, 0, prob), F.col("v") + F.lit(low) + u * F.lit(high - low)).otherwise(F.col("v")))

def random_crop(vox: Voxels, seed: int, **size: int) -> Voxels:
    """A crop of fixed size at a random place of each sample."""
    df = vox.df
    for k, (a, n) in enumerate(sorted(size.items())):
        at = F.floor(uniform(seed, F.col("sample_id"), k) * (vox.size(a) - n + 1)).cast("int")
        df = df.withColumn("at", at).where((F.col(a) >= F.col("at")) & (F.col(a) < F.col("at") + n)).withColumn(a, F.col(a) - F.col("at"))
    return vox.mapped(df, vox.resized(**size))

def crop_centers(labels: Voxels, seed: int, positive: float, negative: float, samples: int = 1) -> DataFrame:
    """(sample_id, draw, d, h, w): voxels drawn evenly from label > 0, or with the rest of the odds from label = 0.

    A stratum without voxels leaves the other. Ranks come from hashes, so each draw is a top-1 per stratum.
    """
    draws = labels.df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    want = uniform(seed, F.col("sample_id"), F.col("draw"), -1) < F.lit(positive / (positive + negative))
    key = F.struct((want != (F.col("v") > 0)).alias("other"), uniform(seed, F.col("sample_id"), F.col("draw"), *[F.col(a) for a in AXES]).alias("u"), *[F.col(a) for a in AXES])
    best = draws.groupBy("sample_id", "draw").agg(F.min(key).alias("m"))
    return best.select("sample_id", "draw", "m.d", "m.h", "m.w")

def crop_around(vox: Voxels, centers: DataFrame, **size: int) -> DataFrame:
    """(sample_id, draw, axes within the crop, v): boxes of a size around centers, moved to lie inside."""
    places = centers.select("sample_id", "draw", *[F.greatest(F.least(F.greatest(F.col(a) - n // 2, F.lit(0)) + n, F.lit(vox.size(a))) - n, F.lit(0)).alias(f"start_{a}") for a, n in size.items()])
    rows = vox.df.join(places, "sample_id")
    for a, n in size.items():
        rows = rows.where((F.col(a) >= F.col(f"start_{a}")) & (F.col(a) < F.col(f"start_{a}") + n)).withColumn(a, F.col(a) - F.col(f"start_{a}"))
    return rows.select("sample_id", "draw", *AXES, "v")

def _noised(vox: Voxels, seed: int, deviation: float) -> DataFrame:
    """The voxels with x: normal noise, stretched to the range of the sample; only the ranges are joined."""
    at = [F.col(a) for a in ("sample_id", *AXES)]
    first, second = uniform(seed, F.lit("r"), *at), uniform(seed, F.lit("a"), *at)
    normal = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - first)) * F.cos(F.lit(2 * math.pi) * second) * F.lit(float(deviation))
    drawn = vox.df.withColumn("z", normal)
    spans = drawn.groupBy("sample_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("v", "z") for n, f in (("low", F.min), ("high", F.max))])
    scaled = (F.col("high_v") - F.col("low_v")) * (F.col("z") - F.col("low_z")) / (F.col("high_z") - F.col("low_z") + F.lit(1e-8)) + F.col("low_v")
    return drawn.join(spans, "sample_id").withColumn("x", scaled)


def noise(vox: Voxels, seed: int, deviation: float) -> Voxels:
    """Normal noise for every voxel, stretched to the range of its sample."""
    return vox.mapped(_noised(vox, seed, deviation).withColumn("v", F.col("x")))


def random_cutout(vox: Voxels, seed: int, size: dict[str, int], cuts: int, prob: float = 0.5, fill: float = 0.0, by_slice: bool = False, deviation: float | None = None) -> Voxels:
    """Boxes around random centers, set to fill, or to noise of a standard deviation; by_slice draws centers for each depth."""
    rows = vox.df.withColumn("x", F.lit(float(fill))) if deviation is None else _noised(vox, seed, deviation)
    where = [F.col("d")] if by_slice else []
    hit, cut = _hit(seed, 0, prob), F.lit(False)
    for k in range(cuts):
        inside = F.lit(True)
        for j, (a, n) in enumerate(sorted(size.items())):
            center = F.floor(uniform(seed, F.col("sample_id"), 1 + k * len(size) + j, *where) * vox.size(a))
            inside = inside & (F.col(a) >= center - n // 2) & (F.col(a) < center - n // 2 + n)
        cut = cut | inside
    return vox.mapped(rows.withColumn("v", F.when(hit & cut, F.col("x")).otherwise(F.col("v"))))

def random_choice(ids: DataFrame, seed: int, weights: list[float], choose: int) -> DataFrame:
    """(sample_id, place, choice): `choose` of the weighted choices, without replacement, in drawn order."""
    each = ids.select("sample_id").distinct().select("sample_id", F.posexplode(F.array(*[F.lit(float(w)) for w in weights])).alias("choice", "weight"))
    each = each.withColumn("key", gumbel(uniform(seed, F.col("sample_id"), F.col("choice")), F.col("weight")))
    place = F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("key"), "choice"))
    return each.withColumn("place", place).where((F.col("place") <= choose) & (F.col("weight") > 0)).select("sample_id", "place", "choice")

def random_choice_applied(vox: Voxels, seed: int, choices: list[dict[str, Column]], weights: list[float], choose: int) -> Voxels:
    """`choose` of the weighted choices applied to each sample in drawn order.

    A choice maps columns (axes of an unchanged size, or v) to expressions of them. Draws are those of random_choice, worked
    out within each row, so nothing is joined or shuffled.
    """
    keys = [F.struct((-gumbel(uniform(seed, F.col("sample_id"), F.lit(k)), F.lit(float(w)))).alias("key"), F.lit(k).alias("choice")) for k, w in enumerate(weights)]
    df = vox.df.withColumn("drawn", F.slice(F.array_sort(F.filter(F.array(*keys), lambda x: x["key"] < 1e9)), 1, choose))
    for place in range(choose):
        choice = F.get("drawn", F.lit(place))["choice"]
        new = {}
        for c in sorted({c for x in choices for c in x}):
            new[c] = F.col(c)
            for k, x in enumerate(choices):
                if c in x:
                    new[c] = F.when(choice == k, x[c]).otherwise(new[c])
        df = df.withColumns(new)
    return vox.mapped(df)

def drop_path(vox: Voxels, seed: int, rate: float) -> Voxels:
    """Samples dropped as a whole; those kept are scaled up."""
    return vox.values(F.when(uniform(seed, F.col("sample_id"), 0) < F.lit(1 - rate), F.col("v") / F.lit(1 - rate)).otherwise(0.0))

def random_rotate(vox: Voxels, seed: int, factor: float, prob: float = 0.8, fill: float = 0.0) -> Voxels:
    """Rotation of the (h, w) plane by an angle in [-factor, factor] radians, nearest neighbour, about the middle."""
    angle = F.when(_hit(seed, 0, prob), (uniform(seed, F.col("sample_id"), 1) * 2 - 1) * F.lit(factor)).otherwise(0.0)
    cells = grid(vox.df, vox.shape).withColumn("a", angle)
    ch, cw = vox.size("h") / 2, vox.size("w") / 2
    y, x = F.col("h") - F.lit(ch), F.col("w") - F.lit(cw)
    to = cells.withColumn("fh", F.rint(F.sin("a") * x + F.cos("a") * y + F.lit(ch)).cast("int")).withColumn("fw", F.rint(F.cos("a") * x - F.sin("a") * y + F.lit(cw)).cast("int"))
    source = vox.df.select("sample_id", "d", F.col("h").alias("fh"), F.col("w").alias("fw"), "c", "v")
    return vox.mapped(to.join(source, ["sample_id", "d", "fh", "fw", "c"], "left").withColumn("v", F.coalesce("v", F.lit(float(fill)))))
