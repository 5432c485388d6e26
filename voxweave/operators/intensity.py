"""Intensity operators: element-wise expressions, and scalar statistics by window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bound, clip
from ..voxels import Voxels

FLOAT_MAX = 3.4028234663852886e38


def _scaled(v: Column, a: float, b: float, low: float | None, high: float | None) -> Column:
    if a == b:
        return v - F.lit(float(a)) + F.lit(float(low or 0.0))
    unit = (v - F.lit(float(a))) / F.lit(float(b - a))
    return unit if low is None else unit * F.lit(float(high - low)) + F.lit(float(low))


def scale_range(vox: Voxels, input_min: float, input_max: float, output_min: float | None = None, output_max: float | None = None, clipped: bool = False) -> Voxels:
    """Map [input_min, input_max] to [output_min, output_max], or to [0, 1] if neither is given.

    An input range of length 0 only shifts, and is never clipped.
    """
    if (output_min is None) != (output_max is None):
        raise ValueError("output_min and output_max go together")
    v = _scaled(F.col("v"), input_min, input_max, output_min, output_max)
    if clipped and output_min is not None and input_min != input_max:
        v = clip(v, output_min, output_max)
    return vox.values(v)


def unscale_range(vox: Voxels, input_min: float, input_max: float, output_min: float | None = None, output_max: float | None = None, clipped: bool = False) -> Voxels:
    """Inverse of scale_range where it has one; otherwise nothing changes."""
    if clipped or input_min == input_max or output_min is not None and output_min == output_max:
        return vox
    low, high = (0.0, 1.0) if output_min is None else (output_min, output_max)
    return vox.values(_scaled(F.col("v"), low, high, input_min, input_max))


def shift(vox: Voxels, offset: float | list[float]) -> Voxels:
    """Add one offset, or one for each channel."""
    if isinstance(offset, (int, float)):
        return vox.values(F.col("v") + F.lit(float(offset)))
    if len(offset) != vox.size("c"):
        raise ValueError("one offset for each channel is needed")
    return vox.values(F.col("v") + F.element_at(F.array(*[F.lit(float(x)) for x in offset]), F.col("c") + 1))


def normalize(vox: Voxels, nonzero: bool = False, channel_wise: bool = False, offset: float | None = None, scale: float | None = None) -> Voxels:
    """Subtract the mean and divide by the population deviation of each sample (and channel).

    nonzero: zeros neither count nor change. A deviation of 0 divides by 1.
    """
    w = Window.partitionBy("sample_id", *(["c"] if channel_wise else []))
    counted = F.when(F.col("v") != 0, F.col("v")) if nonzero else F.col("v")
    mean = F.lit(float(offset)) if offset is not None else F.avg(counted).over(w)
    deviation = F.lit(float(scale)) if scale is not None else F.stddev_pop(counted).over(w)
    stats = vox.df.withColumn("mean", mean).withColumn("deviation", F.when(deviation == 0, 1.0).otherwise(deviation))
    v = (F.col("v") - F.col("mean")) / F.col("deviation")
    changed = (F.col("v") != 0) & F.col("mean").isNotNull() if nonzero else F.col("mean").isNotNull()
    return vox.mapped(stats.withColumn("v", F.when(changed, v).otherwise(F.col("v"))))


def fill_empty(vox: Voxels, fill: float = 0.0) -> Voxels:
    """Replace NaN by fill, and infinities by the largest finite floats."""
    v = F.col("v")
    inf = F.lit(float("inf"))
    return vox.values(F.when(F.isnan(v), F.lit(float(fill))).when(v == inf, F.lit(FLOAT_MAX)).when(v == -inf, F.lit(-FLOAT_MAX)).otherwise(v))


def normalize_packed(packed: DataFrame, nonzero: bool = False, channel_wise: bool = False) -> DataFrame:
    """`normalize` on packed rows (sample_id, shape, data): worked out within each row, nothing is shuffled.

    Arrays may differ in shape. Without a value that counts, or a null array, a row stays as it is. Other columns are kept.
    """
    channels = F.element_at("shape", -1) if channel_wise else F.lit(1)
    counts = lambda x: (x != 0) if nonzero else F.lit(True)

    def total(a: Column, of) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda t, x: t + of(x))

    def stats(k: Column) -> Column:
        own = F.filter("data", lambda x, i: (F.pmod(i, channels) == k) & counts(x))
        # equal values have their own mean, exactly
        mean = lambda a: F.when(F.array_min(a) == F.array_max(a), F.array_min(a)).otherwise(total(a, lambda x: x) / F.size(a))
        spread = lambda s: F.sqrt(total(s["own"], lambda x: (x - s["mean"]) * (x - s["mean"])) / F.size(s["own"]))
        both = lambda a: bound(F.struct(a.alias("own"), mean(a).alias("mean")), lambda s: F.struct(s["mean"].alias("mean"), spread(s).alias("deviation")))
        return bound(own, lambda a: F.when(F.size(a) > 0, both(a)))

    rows = packed.withColumn("_stats", F.transform(F.sequence(F.lit(0), channels - 1), stats))

    def value(x: Column, i: Column) -> Column:
        s = F.element_at("_stats", (F.pmod(i, channels) + 1).cast("int"))
        scaled = (x - s["mean"]) / F.when(s["deviation"] == 0, 1.0).otherwise(s["deviation"])
        return F.when(counts(x), F.coalesce(scaled, x)).otherwise(x)

    return rows.withColumn("data", F.transform("data", value)).drop("_stats")
