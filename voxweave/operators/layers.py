"""Layers as relational algebra: windows for normalisation, joins with weight tables for products."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import gelu, sigmoid, uniform
from ..voxels import AXES, Voxels
from .morphology import convolve

ACTIVATIONS = {
    "linear": lambda x: x,
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "leaky_relu": lambda x: F.when(x >= 0, x).otherwise(x * F.lit(0.2)),
    "elu": lambda x: F.when(x >= 0, x).otherwise(F.exp(x) - 1),
    "sigmoid": sigmoid,
    "tanh": F.tanh,
    "gelu": gelu,
}

#: What a norm's statistics are taken over, by what they are grouped on.
NORM_GROUPS = {"layer": ("sample_id", "d", "h", "w"), "instance": ("sample_id", "c"), "batch": ("c",)}


def activate(vox: Voxels, name: str) -> Voxels:
    return vox.values(ACTIVATIONS[name](F.col("v")))


def norm(vox: Voxels, kind: str, epsilon: float, groups: int = 1) -> Voxels:
    """(v - mean) / sqrt(variance + epsilon) over the kind's groups."""
    by: list[str | Column] = list(NORM_GROUPS[kind]) if kind != "group" else ["sample_id", F.expr(f"c div {vox.size('c') // groups}")]
    w = Window.partitionBy(*by)
    return vox.values((F.col("v") - F.avg("v").over(w)) / F.sqrt(F.var_pop("v").over(w) + F.lit(epsilon)))


def unit_norm(vox: Voxels, epsilon: float = 1e-12) -> Voxels:
    w = Window.partitionBy("sample_id", "d", "h", "w")
    return vox.values(F.col("v") / F.sqrt(F.greatest(F.sum(F.col("v") * F.col("v")).over(w), F.lit(epsilon))))


def softmax(vox: Voxels) -> Voxels:
    w = Window.partitionBy("sample_id", "d", "h", "w")
    e = F.exp(F.col("v") - F.max("v").over(w))
    out = vox.df.withColumn("v", e)
    return vox.mapped(out.withColumn("v", F.col("v") / F.sum("v").over(w)))


def global_pool(vox: Voxels, kind: str = "avg") -> DataFrame:
    """(sample_id, c, v) over space."""
    return vox.df.groupBy("sample_id", "c").agg({"avg": F.avg, "max": F.max}[kind]("v").alias("v"))


def weights(spark, matrix: list[list[float]]) -> DataFrame:
    """(c, o, x) of a small weight matrix [input][output]."""
    rows = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(o).alias("o"), F.lit(float(x)).alias("x")) for i, row in enumerate(matrix) for o, x in enumerate(row)])
    return spark.range(1).select(F.explode(rows).alias("t")).select("t.*")


def dense(vectors: DataFrame, matrix: list[list[float]], keys: tuple[str, ...] = ("sample_id",), bias: list[float] | None = None) -> DataFrame:
    """(keys, c, v) times a matrix over c."""
    table = F.broadcast(weights(vectors.sparkSession, matrix))  # a literal of the plan
    out = vectors.join(table, "c").groupBy(*keys, F.col("o").alias("c")).agg(F.sum(F.col("v") * F.col("x")).alias("v"))
    return out if bias is None else out.withColumn("v", F.col("v") + F.element_at(F.array(*map(F.lit, bias)), F.col("c") + 1))


def squeeze_excitation(vox: Voxels, down: list[list[float]], up: list[list[float]]) -> Voxels:
    """Channels scaled by two dense layers over their means."""
    small = dense(global_pool(vox), down).withColumn("v", F.greatest(F.col("v"), F.lit(0.0)))
    scale = dense(small, up).select("sample_id", "c", sigmoid(F.col("v")).alias("scale"))
    return vox.mapped(vox.df.join(scale, ["sample_id", "c"]).withColumn("v", F.col("v") * F.col("scale")))


def global_response_norm(vox: Voxels, gamma: float, beta: float, epsilon: float = 1e-6) -> Voxels:
    """v * (its channel's L2 norm over space / the mean of these) * gamma + beta + v."""
    space, voxel = Window.partitionBy("sample_id", "c"), Window.partitionBy("sample_id", "d", "h", "w")
    length = vox.df.withColumn("g", F.sqrt(F.sum(F.col("v") * F.col("v")).over(space)))
    share = F.col("g") / (F.avg("g").over(voxel) + F.lit(epsilon))
    return vox.mapped(length.withColumn("v", F.lit(gamma) * F.col("v") * share + F.lit(beta) + F.col("v")))


def attention_gate(x: Voxels, gate: Voxels, wx: float, wg: float, psi: float) -> Voxels:
    """x scaled by sigmoid(psi * relu(wx * x + wg * gate)), the gate at x's size."""
    both = x.df.join(gate.df.withColumnRenamed("v", "g"), ["sample_id", *AXES])
    alpha = sigmoid(F.lit(psi) * F.greatest(F.lit(wx) * F.col("v") + F.lit(wg) * F.col("g"), F.lit(0.0)))
    return x.mapped(both.withColumn("v", F.col("v") * alpha))


#: Fixed value: the largest factor of cosine scores.
MOST_SCALE = 100.0


def relative_bias(spark, window: tuple[int, int], table: list[list[float]], bounded: bool = False) -> DataFrame:
    """(head, i, j, bias) of a window's places from a table with a row for each relative place (the last axis fastest) and a column a head.

    Bounded, the table's values are taken through 16 * sigmoid, as for cosine scores.
    """
    h, w = window
    if len(table) != (2 * h - 1) * (2 * w - 1):
        raise ValueError("the table has a row for each relative place")
    cells = [(k, i, j, float(table[(i // w - j // w + h - 1) * (2 * w - 1) + i % w - j % w + w - 1][k])) for k in range(len(table[0])) for i in range(h * w) for j in range(h * w)]
    out = spark.createDataFrame(cells, "head int, i int, j int, bias double")
    return out.withColumn("bias", F.lit(16.0) * sigmoid(F.col("bias"))) if bounded else out


def window_attention(blocks: DataFrame, scale: float | list[float], head_size: int | None = None, mask: DataFrame | None = None, bias: DataFrame | None = None, cosine: bool = False) -> DataFrame:
    """Self-attention within blocks (sample_id, win, pos, c, v) of a fixed size: softmax(q k' * scale + bias + mask) v.

    Channels are taken by `head_size` into heads of their own. A mask (win, i, j, mask) and a bias (head, i, j, bias) are added to the
    scores; both are as large as a window or an array's windows, whatever the number of samples. Cosine scores are of queries and keys of length one in each head; scale
    then has the logarithm of a factor a head, MOST_SCALE at most.
    """
    if cosine:
        cut = F.lit(0) if head_size is None else F.expr(f"c div {head_size}")
        space = Window.partitionBy("sample_id", "win", "pos", "head")
        long = blocks.withColumn("head", cut).withColumn("u", F.col("v") / F.sqrt(F.greatest(F.sum(F.col("v") * F.col("v")).over(space), F.lit(1e-6))))
        factors = F.array(*[F.lit(min(math.exp(x), MOST_SCALE)) for x in (scale if isinstance(scale, list) else [scale])])
        return _attended(long, long.withColumn("v", F.col("u")), F.element_at(factors, (F.col("head") + 1).cast("int")), mask, bias)
    cut = blocks.withColumn("head", F.lit(0) if head_size is None else F.expr(f"c div {head_size}"))
    return _attended(cut, cut, F.lit(scale), mask, bias)


def _attended(values: DataFrame, blocks: DataFrame, scale: Column, mask: DataFrame | None, bias: DataFrame | None) -> DataFrame:
    key = ["sample_id", "win", "head"]
    q = blocks.select(*key, F.col("pos").alias("i"), "c", F.col("v").alias("q"))
    k = blocks.select(*key, F.col("pos").alias("j"), "c", F.col("v").alias("k"))
    scores = q.join(k, [*key, "c"]).groupBy(*key, "i", "j").agg(F.sum(F.col("q") * F.col("k")).alias("s")).withColumn("s", F.col("s") * scale)
    if bias is not None:
        scores = scores.join(F.broadcast(bias), ["head", "i", "j"]).withColumn("s", F.col("s") + F.col("bias"))  # heads x places x places
    if mask is not None:
        scores = scores.join(mask, ["win", "i", "j"]).withColumn("s", F.col("s") + F.col("mask"))
    row = Window.partitionBy(*key, "i")
    e = scores.withColumn("e", F.exp(F.col("s") - F.max("s").over(row)))
    p = e.withColumn("p", F.col("e") / F.sum("e").over(row))
    v = values.select(*key, F.col("pos").alias("j"), "c", F.col("v").alias("x"))
    out = p.join(v, [*key, "j"]).groupBy(*key, F.col("i").alias("pos"), "c").agg(F.sum(F.col("p") * F.col("x")).alias("v"))
    return out.drop("head")


def mlp(vectors: DataFrame, first: list[list[float]], second: list[list[float]], bias: tuple[list[float], list[float]], activation: str = "gelu", keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Two dense layers over c with an activation between them."""
    hidden = dense(vectors, first, keys, bias[0])
    return dense(hidden.withColumn("v", ACTIVATIONS[activation](F.col("v"))), second, keys, bias[1])


def separable_convolution(vox: Voxels, kernel: dict[tuple[int, int, int], float], pointwise: list[list[float]], stride: int = 1) -> Voxels:
    """A spatial kernel on each channel alone, then a matrix over channels."""
    deep = convolve(vox, kernel, stride)
    mixed = dense(deep.df, pointwise, ("sample_id", "d", "h", "w"))
    return deep.mapped(mixed, deep.resized(c=len(pointwise[0])))


def dropout(vox: Voxels, seed: int, rate: float) -> Voxels:
    """Voxels dropped one by one; those kept are scaled up."""
    kept = uniform(seed, *[F.col(a) for a in ("sample_id", *AXES)]) < F.lit(1 - rate)
    return vox.values(F.when(kept, F.col("v") / F.lit(1 - rate)).otherwise(0.0))


def spatial_dropout(vox: Voxels, seed: int, rate: float) -> Voxels:
    """Channels of a sample dropped as a whole; those kept are scaled up."""
    kept = uniform(seed, F.col("sample_id"), F.col("c")) < F.lit(1 - rate)
    return vox.values(F.when(kept, F.col("v") / F.lit(1 - rate)).otherwise(0.0))


def prelu(vox: Voxels, slopes: float | list[float]) -> Voxels:
    """Values below 0 times a learned slope, one for all or one a channel."""
    slope = F.lit(float(slopes)) if isinstance(slopes, (int, float)) else F.element_at(F.array(*[F.lit(float(x)) for x in slopes]), F.col("c") + 1)
    return vox.values(F.when(F.col("v") >= 0, F.col("v")).otherwise(F.col("v") * slope))


def class_target(scores: DataFrame, chosen: int | None = None) -> DataFrame:
    """(sample_id, target) of class scores (sample_id, c, v): the chosen class, or the highest score."""
    of = F.max("v") if chosen is None else F.max(F.when(F.col("c") == chosen, F.col("v")))
    return scores.groupBy("sample_id").agg(of.alias("target"))


def region_target(vox: Voxels, mask: str = "all", chosen: int | None = None) -> DataFrame:
    """(sample_id, target): the chosen class's scores summed over all voxels, over its highest ones, or over its object.

    The object is where that class is the predicted one (the first of equals); of one channel, where the score is above 0.
    """
    if mask not in ("all", "single", "object"):
        raise ValueError(f"no such mask: {mask}")
    if vox.size("c") == 1:
        score, inside = F.max("v"), F.max("v") > 0
    elif chosen is None:
        raise ValueError("several classes need a chosen one")
    else:
        score = F.max(F.when(F.col("c") == chosen, F.col("v")))
        inside = F.max_by("c", F.struct(F.col("v"), -F.col("c"))) == chosen
    cells = vox.df.groupBy("sample_id", "d", "h", "w").agg(score.alias("v"), inside.alias("inside"))
    if mask == "single":
        # all cells that share the maximum count: their number times it
        tops = cells.groupBy("sample_id", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("sample_id").agg(F.max(F.struct("v", "n")).alias("t"))
        return tops.select("sample_id", (F.col("t.v") * F.col("t.n")).alias("target"))
    taken = F.col("v") if mask == "all" else F.when(F.col("inside"), F.col("v")).otherwise(0.0)
    return cells.groupBy("sample_id").agg(F.sum(taken).alias("target"))


def concat_channels(*parts: Voxels) -> Voxels:
    """Channel-wise concatenation: a union with shifted channels."""
    df, channels = None, 0
    for part in parts:
        moved = part.df.withColumn("c", F.col("c") + channels)
        df = moved if df is None else df.unionByName(moved)
        channels += part.size("c")
    return parts[0].mapped(df, parts[0].resized(c=channels))


def grad_cam(activations: Voxels, gradients: Voxels) -> Voxels:
    """Activations weighted by their gradients' means over space, summed, cut at 0, scaled by the largest."""
    weight = global_pool(gradients).withColumnRenamed("v", "x")
    keys = ["sample_id", "d", "h", "w"]
    summed = activations.df.join(weight, ["sample_id", "c"]).groupBy(*keys).agg(F.greatest(F.sum(F.col("v") * F.col("x")), F.lit(0.0)).alias("v"))
    top = F.max("v").over(Window.partitionBy("sample_id"))
    scaled = summed.withColumn("top", top).withColumn("v", F.when(F.col("top") > 0, F.col("v") / F.col("top")).otherwise(0.0))
    return activations.mapped(scaled.withColumn("c", F.lit(0)), activations.resized(c=1))
