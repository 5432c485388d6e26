"""Operators that need whole arrays at once: one packed array a row, NumPy inside tasks, no shuffle.

Rows are (sample_id, shape, data) as `pack` makes them. A task holds one array at a time, so the largest array, not the
number of them, must fit. Null arrays stay null.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tiles
from .scores import class_ids

#: Bytes of results that a task holds before it gives them back.
HELD = 64 << 20
PACKED = "sample_id long, shape array<int>, data array<double>"


def each_array(packed: DataFrame, fn: Callable[..., np.ndarray], with_id: bool = False) -> DataFrame:
    """fn on every array, and its sample_id if asked for; what it gives may have another shape."""

    schema = pa.schema([("sample_id", pa.int64()), ("shape", pa.list_(pa.int32())), ("data", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, new, shapes = 0, 0, [], []
            for row, (sample, shape, data) in enumerate(zip(*batch.columns)):
                shapes.append(shape.as_py())
                new.append(None)
                if shape.is_valid and data.is_valid:
                    x = data.values.to_numpy(zero_copy_only=False).astype(float).reshape(shapes[-1])
                    y = fn(x, sample.as_py()) if with_id else fn(x)
                    shapes[-1], new[-1] = list(y.shape), y.astype(float).ravel()
                    held += new[-1].nbytes
                if held >= HELD or row + 1 == batch.num_rows:
                    ids = batch.column(0).slice(first, row + 1 - first)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(shapes, schema.field(1).type), pa.array(new, schema.field(2).type)], schema=schema)
                    first, held, new, shapes = row + 1, 0, [], []

    return packed.select(F.col("sample_id").cast("long"), "shape", F.col("data").cast("array<double>")).mapInArrow(run, PACKED)


def each_stack(packed: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """fn on stacks of arrays of one shape, along a leading axis; it keeps their shape. A task holds a run of arrays, or one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = pc.and_(pc.is_valid(batch.column(1)), pc.is_valid(batch.column(2)))
            empty = batch.filter(pc.invert(there))
            if empty.num_rows:
                yield pa.RecordBatch.from_arrays([*empty.columns[:2], pa.nulls(empty.num_rows, tiles.ARRAYS.field(2).type)], schema=tiles.ARRAYS)
            for rows, _ in tiles._runs(iter([batch.filter(there)])):
                ids = tiles._ids(rows)
                for k, x in tiles._stacked(rows):
                    yield tiles._rows(tiles.ARRAYS, fn(x.astype(float)), ids[k])

    return packed.select(F.col("sample_id").cast("long"), F.col("shape").cast("array<int>"), F.col("data").cast("array<double>")).mapInArrow(run, PACKED)


def _shifts(x: np.ndarray, axes: tuple[int, ...], edge: float) -> Iterator[np.ndarray]:
    """x seen from each of the neighbours that touch, corners included."""
    wide = np.pad(x, [(1, 1) if k in axes else (0, 0) for k in range(x.ndim)], constant_values=edge)
    for at in itertools.product(*[range(3) if k in axes else (0,) for k in range(x.ndim)]):
        yield wide[tuple(slice(a, a + n) for a, n in zip(at, x.shape))]


def _space(x: np.ndarray) -> tuple[int, ...]:
    return (1, 2) if x.shape[0] == 1 else (0, 1, 2)


def _largest(x: np.ndarray, bridge: int) -> np.ndarray:
    mask = wide = x > 0
    space = _space(x)
    for _ in range(bridge):
        wide = np.logical_or.reduce(list(_shifts(wide, space, False)))
    label = np.where(wide, np.arange(1, x.size + 1).reshape(x.shape), 0)
    while True:
        # the highest label of a component spreads until nothing changes
        spread = np.where(wide, np.maximum.reduce(list(_shifts(label, space, 0))), 0)
        if (spread == label).all():
            break
        label = spread
    sizes = np.bincount(label.ravel(), minlength=2)
    sizes[0] = 0
    ties = np.flatnonzero(sizes == sizes.max())
    if sizes.max() == 0 or not mask.any():
        return mask
    flat = label.ravel()
    first = ties[np.argmin([int(np.argmax(flat == t)) for t in ties])]
    return mask & (label == first)


def largest_mask(mask: np.ndarray, bridge: int = 2) -> np.ndarray:
    """The largest component of a mask of two or three axes."""
    full = mask.reshape((1, *mask.shape) if mask.ndim == 2 else mask.shape)[..., None]
    return _largest(full.astype(float), bridge).reshape(mask.shape)


def largest_component(packed: DataFrame, bridge: int = 2) -> DataFrame:
    """1 where a cell above 0 is in the largest component, else 0.

    Cells that touch, by a corner too, are together; before, the mask is widened `bridge` times to close gaps. Of equally large
    components the one that comes first in row-major order is kept; an empty mask stays empty.
    """
    return each_array(packed, lambda x: _largest(x, bridge))


def _axes(x: np.ndarray) -> tuple[int, ...]:
    """The spatial axes of an array, or of a stack of them, from the end."""
    return (-3, -2) if x.shape[-4] == 1 else (-4, -3, -2)


def _along(x: np.ndarray, axis: int, fn: np.ufunc) -> np.ndarray:
    """fn of each place and its neighbours along an axis."""
    part = lambda y, a, b: y[(..., slice(a, b), *[slice(None)] * (-axis - 1))]
    out = x.copy()
    fn(part(out, 1, None), part(x, None, -1), out=part(out, 1, None))
    fn(part(out, None, -1), part(x, 1, None), out=part(out, None, -1))
    return out


def _eroded(x: np.ndarray) -> np.ndarray:
    return np.minimum.reduce([_along(x, a, np.minimum) for a in _axes(x)])


def _dilated(x: np.ndarray) -> np.ndarray:
    for a in _axes(x):
        x = _along(x, a, np.maximum)
    return x


def _opened(x: np.ndarray) -> np.ndarray:
    return _dilated(_eroded(x))


def _skeletons(x: np.ndarray, iterations: int) -> np.ndarray:
    """The soft skeleton of each array of a stack."""
    skeleton = np.maximum(x - _opened(x), 0)
    live = np.arange(len(x))
    for _ in range(iterations):
        before, x = x, _eroded(x)
        changed = (x != before).reshape(len(x), -1).any(axis=1)
        # where each channel is constant no later step adds anything
        live, x = live[changed], x[changed]
        if not len(live):
            break
        lost = np.maximum(x - _opened(x), 0)
        skeleton[live] += np.maximum(lost - skeleton[live] * lost, 0)
    return skeleton


def skeleton(packed: DataFrame, iterations: int = 50) -> DataFrame:
    """Soft skeleton: what opening removes, gathered over successive erosions."""
    return each_stack(packed, lambda x: _skeletons(x, iterations))


def _overlaps(true: np.ndarray, pred: np.ndarray, iterations: int, smooth: float) -> np.ndarray:
    """Centerline losses of each channel of stacked arrays: how much of each skeleton lies in the other array."""
    space = (1, 2, 3)
    thin_true, thin_pred = _skeletons(true, iterations), _skeletons(pred, iterations)
    precision = ((thin_pred * true).sum(space) + smooth) / (thin_pred.sum(space) + smooth)
    recall = ((thin_true * pred).sum(space) + smooth) / (thin_true.sum(space) + smooth)
    return 1 - 2 * precision * recall / (precision + recall + smooth)


def _readied(kind: str, true: np.ndarray, pred: np.ndarray, classes: list[int], from_logits: bool, ignored: Sequence[int], smooth: float) -> tuple[np.ndarray, np.ndarray]:
    """Truth and probabilities of the classes, 0 where the true class is ignored."""
    valid = ~np.isin(true, list(ignored)) if kind != "categorical" else np.array(1.0)
    if kind == "sparse":
        true = (true.astype(int) == np.arange(pred.shape[-1])).astype(float)
    if from_logits and kind == "binary":
        pred = 1 / (1 + np.exp(-pred))
    elif from_logits:
        e = np.exp(pred - pred.max(-1, keepdims=True))
        pred = e / e.sum(-1, keepdims=True)
    return (true * valid)[..., classes], (np.clip(pred, smooth, 1 - smooth) * valid)[..., classes]


def centerline_loss(
    pairs: DataFrame, kind: str = "binary", classes: int = 1, iterations: int = 50, from_logits: bool = False,
    targets: int | Sequence[int] | None = None, ignored: Sequence[int] = (), smooth: float = 1e-7,
) -> DataFrame:
    """(sample_id, class, loss) from packed rows (sample_id, shape, y_true, y_pred), worked out within each row.

    shape is y_pred's: (d, h, w, classes). kind says what y_true holds: `binary` (one class, 0 or 1), `categorical`
    (as y_pred, one-hot) or `sparse` (a class id a place; one that is no class counts for none). Places whose true class is ignored are
    0 in both before thinning; one-hot truth has no ids to ignore. A row with a null array has null losses;
    rows may differ in shape, and repeated ids are judged row by row.
    """
    if kind not in ("binary", "categorical", "sparse"):
        raise ValueError(f"no such kind: {kind}")
    if kind == "binary" and classes != 1:
        raise ValueError("binary truth has one class")
    if kind == "categorical" and ignored:
        raise ValueError("one-hot truth has no ids to ignore")
    chosen = class_ids(targets, classes)

    def losses(shape: tuple[int, ...], true: list[np.ndarray], pred: list[np.ndarray]) -> np.ndarray:
        if shape[-1] != classes:
            raise ValueError(f"{shape[-1]} channels for {classes} classes")
        of = shape if kind == "categorical" else (*shape[:-1], 1)
        stack = lambda arrays, shape: np.stack([np.asarray(x, float).reshape(shape) for x in arrays])
        return _overlaps(*_readied(kind, stack(true, of), stack(pred, shape), chosen, from_logits, ignored, smooth), iterations, smooth)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.full((len(batch), len(chosen)), np.nan)  # which Spark takes as null
            columns = [batch[c].tolist() for c in ("shape", "y_true", "y_pred")]
            alike: dict[tuple[int, ...], list[int]] = {}
            for k, row in enumerate(zip(*columns)):
                if all(x is not None for x in row):
                    alike.setdefault(tuple(map(int, row[0])), []).append(k)
            for shape, rows in alike.items():
                some = max(1, tiles.HELD // (8 * max(1, int(np.prod(shape)))))
                for at in range(0, len(rows), some):
                    part = rows[at : at + some]
                    found[part] = losses(shape, [columns[1][k] for k in part], [columns[2][k] for k in part])
            if len(batch):
                yield pd.DataFrame({"sample_id": batch["sample_id"].repeat(len(chosen)), "class": chosen * len(batch), "loss": found.ravel()})

    return pairs.select("sample_id", "shape", "y_true", "y_pred").mapInPandas(run, "sample_id long, class int, loss double")
