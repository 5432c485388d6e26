"""Overlap metrics and losses: mask, two-level aggregation, ratio.

Input rows are (sample_id, class, y_true, y_pred), one a voxel and class. The inner sums are by
(sample, class) and combine map-side; states of batches add up, so they also stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, sigmoid


def class_ids(ids: int | Sequence[int] | None, classes: int) -> list[int]:
    """Checked class ids; None stands for all."""
    if ids is None:
        return list(range(classes))
    out = [ids] if isinstance(ids, int) else list(ids)
    if not all(isinstance(i, int) for i in out):
        raise ValueError("class_ids must be integers")
    if any(not 0 <= i < classes for i in out):
        raise ValueError("class id out of the valid range")
    return out


def probabilities(pairs: DataFrame, kind: str, from_logits: bool, keys: Sequence[str] = ("sample_id", "h", "w")) -> DataFrame:
    """Logits to probabilities: sigmoid, or softmax over the classes of each voxel."""
    if not from_logits:
        return pairs
    if kind == "binary":
        return pairs.withColumn("y_pred", sigmoid(F.col("y_pred")))
    voxel = Window.partitionBy(*keys)
    shifted = pairs.withColumn("e", F.exp(F.col("y_pred") - F.max("y_pred").over(voxel)))
    return shifted.withColumn("y_pred", F.col("e") / F.sum("e").over(voxel)).drop("e")


def hard(pairs: DataFrame, kind: str, threshold: float = 0.5, keys: Sequence[str] = ("sample_id", "h", "w"), from_logits: bool = True) -> DataFrame:
    """Logits to decisions, or binary probabilities if not from_logits: above the threshold, or the largest class (the first of equals)."""
    if kind == "binary":
        p = sigmoid(F.col("y_pred")) if from_logits else F.col("y_pred")
        return pairs.withColumn("y_pred", (p > threshold).cast("double"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("y_pred"), "class"))
    return pairs.withColumn("y_pred", (best == 1).cast("double"))


def dice_state(pairs: DataFrame, targets: Sequence[int] | None = None, ignored: Sequence[int] = (), ignore_empty: bool = True) -> DataFrame:
    """(class, intersection, total, valid): what batches add up to.

    Voxels whose true class is ignored count nowhere. A sample without any selected truth is left out;
    with ignore_empty, so is a class that is predicted but absent.
    """
    if targets is not None:
        pairs = pairs.where(F.col("class").isin(list(targets)))
    if ignored:
        pairs = pairs.where(~F.col("true_class").isin(list(ignored)))
    each = pairs.groupBy("sample_id", "class").agg(
        F.sum(F.col("y_true") * F.col("y_pred")).alias("i"), F.sum("y_true").alias("t"), F.sum("y_pred").alias("p")
    )
    each = each.withColumn("truth", F.sum("t").over(Window.partitionBy("sample_id")))
    valid = F.col("truth") > 0
    if ignore_empty:
        valid = valid & ~((F.col("t") == 0) & (F.col("p") != 0))
    return each.groupBy("class").agg(
        F.sum(F.when(valid, F.col("i")).otherwise(0.0)).alias("intersection"),
        F.sum(F.when(valid, F.col("t") + F.col("p")).otherwise(0.0)).alias("total"),
        F.sum(valid.cast("long")).alias("valid"),
    )


def dice_by_class(state: DataFrame, smooth: float = 1e-6) -> DataFrame:
    ratio = (2 * F.col("intersection") + F.lit(smooth)) / (F.col("total") + F.lit(smooth))
    return state.select("class", F.when(F.col("valid") > 0, ratio).alias("dice"))


def dice_result(state: DataFrame, smooth: float = 1e-6) -> DataFrame:
    """One row: the mean over classes that any sample counted for, else 0."""
    return dice_by_class(state, smooth).agg(F.coalesce(F.avg("dice"), F.lit(0.0)).alias("dice"))


def sparse(pairs: DataFrame) -> DataFrame:
    """y_true from the voxel's class: one where it is the row's class."""
    return pairs.withColumn("y_true", (F.col("true_class") == F.col("class")).cast("double"))


def _sums(pairs: DataFrame, smooth: float, targets: Sequence[int] | None = None, ignored: Sequence[int] = ()) -> DataFrame:
    """Masked sums of each sample and class; every loss is a ratio of them.

    Only target classes have rows. Voxels whose true class is ignored count nowhere, yet their
    classes keep a row.
    """
    if targets is not None:
        pairs = pairs.where(F.col("class").isin(list(targets)))
    m = F.when(F.col("true_class").isin(list(ignored)), 0.0).otherwise(1.0) if ignored else F.lit(1.0)
    p, t = clip(F.col("y_pred"), smooth, 1 - smooth), F.col("y_true")
    cross, both = -(t * F.ln(p)), -(t * F.ln(p) + (1 - t) * F.ln(1 - p))
    return pairs.groupBy("sample_id", "class").agg(
        F.sum(m * t * p).alias("i"), F.sum(m * t).alias("t"), F.sum(m * p).alias("p"), F.sum(m * cross).alias("ce"), F.sum(m * both).alias("bce"), F.sum(m).alias("n")
    )


def _overlap(kind: str, smooth: float, alpha: float = 0.5, beta: float = 0.5) -> Column:
    i, t, p, e = F.col("i"), F.col("t"), F.col("p"), F.lit(smooth)
    score = {
        "dice": (2 * i + e) / (t + p + e),
        "iou": (i + e) / (t + p - i + e),
        "tversky": (i + e) / (i + F.lit(alpha) * (p - i) + F.lit(beta) * (t - i) + e),
    }[kind]
    return 1 - score


def _entropy(binary: bool) -> Column:
    return F.col("bce" if binary else "ce") / F.greatest(F.col("n"), F.lit(1.0))


def overlap_loss(pairs: DataFrame, kind: str = "dice", smooth: float = 1e-7, alpha: float = 0.5, beta: float = 0.5, targets: Sequence[int] | None = None, ignored: Sequence[int] = ()) -> DataFrame:
    """(sample_id, class, loss) of a Dice, IoU or Tversky loss."""
    return _sums(pairs, smooth, targets, ignored).select("sample_id", "class", _overlap(kind, smooth, alpha, beta).alias("loss"))


def generalized_dice_loss(pairs: DataFrame, weight: str = "square", smooth: float = 1e-7, targets: Sequence[int] | None = None, ignored: Sequence[int] = ()) -> DataFrame:
    """(sample_id, loss): classes weighted by the inverse of their volume; absent ones don't count."""
    t = F.col("t")
    w = {"square": 1 / (t * t + F.lit(smooth)), "simple": 1 / (t + F.lit(smooth)), "uniform": F.lit(1.0)}[weight]
    weighted = _sums(pairs, smooth, targets, ignored).withColumn("wt", F.when(t > 0, w).otherwise(0.0))
    sums = weighted.groupBy("sample_id").agg(F.sum(F.col("wt") * F.col("i")).alias("i"), F.sum(F.col("wt") * (t + F.col("p"))).alias("u"))
    score = F.when(F.col("u") > 0, (2 * F.col("i") + F.lit(smooth)) / (F.col("u") + F.lit(smooth))).otherwise(1.0)
    return sums.select("sample_id", (1 - score).alias("loss"))


def cross_entropy(pairs: DataFrame, binary: bool = False, smooth: float = 1e-7, targets: Sequence[int] | None = None, ignored: Sequence[int] = ()) -> DataFrame:
    """(sample_id, class, loss): mean over the voxels that count."""
    return _sums(pairs, smooth, targets, ignored).select("sample_id", "class", _entropy(binary).alias("loss"))


def dice_ce_loss(pairs: DataFrame, binary: bool = False, dice_weight: float = 1.0, ce_weight: float = 1.0, smooth: float = 1e-7, targets: Sequence[int] | None = None, ignored: Sequence[int] = ()) -> DataFrame:
    """(sample_id, class, loss): both losses from one aggregation."""
    if dice_weight < 0 or ce_weight < 0:
        raise ValueError("weights must not be negative")
    loss = F.lit(dice_weight) * _overlap("dice", smooth) + F.lit(ce_weight) * _entropy(binary)
    return _sums(pairs, smooth, targets, ignored).select("sample_id", "class", loss.alias("loss"))


def reduced(losses: DataFrame, reduction: str = "mean") -> DataFrame:
    """none; or one row: sum, mean, or sum over the number of samples."""
    value: dict[str, Column] = {
        "sum": F.sum("loss"),
        "mean": F.avg("loss"),
        "sum_over_batch_size": F.sum("loss") / F.countDistinct("sample_id"),
    }
    if reduction == "none":
        return losses
    if reduction not in value:
        raise ValueError(f"no such reduction: {reduction}")
    return losses.agg(value[reduction].alias("loss"))


def centerline_dice_loss(scores: DataFrame, smooth: float = 1e-7) -> DataFrame:
    """(sample_id, class, loss) from rows with y_true, y_pred and their skeletons s_true, s_pred."""
    sums = scores.groupBy("sample_id", "class").agg(
        F.sum(F.col("s_pred") * F.col("y_true")).alias("pt"), F.sum("s_pred").alias("sp"), F.sum(F.col("s_true") * F.col("y_pred")).alias("tp"), F.sum("s_true").alias("st")
    )
    precision, recall = (F.col("pt") + smooth) / (F.col("sp") + smooth), (F.col("tp") + smooth) / (F.col("st") + smooth)
    return sums.select("sample_id", "class", (1 - 2 * precision * recall / (precision + recall + smooth)).alias("loss"))


def best_scores(scores: DataFrame, interval: int = 5) -> DataFrame:
    """(epoch, score, saved): evaluated every `interval` epochs (0 elsewhere); saved where it beats all before."""
    evaluated = (F.col("epoch") + 1) % interval == 0
    shown = scores.select("epoch", F.when(evaluated, F.col("score")).otherwise(0.0).alias("score"), evaluated.alias("evaluated"))
    before = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)  # one row an epoch
    best = F.coalesce(F.max(F.when(F.col("evaluated"), F.col("score"))).over(before), F.lit(float("-inf")))
    return shown.select("epoch", "score", (F.col("evaluated") & (F.col("score") > best)).alias("saved"))
