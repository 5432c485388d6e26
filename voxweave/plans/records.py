"""Pipelines over records: rows with several arrays, an affine and a trace of what was done to them.

A record is a row with sample_id, any number of array columns struct<shape array<int>, data array<double>> (channel
last; two or three spatial axes), affine array<double> of 16 (null: none), and trace. All steps of a
pipeline run in one Arrow pass, without a shuffle; other columns pass through. A batch of rows is given back as soon as
HELD bytes of it are done.

`trace` is an array of structs, one a step: its parameters as JSON, drawn ones included, whether it was applied, whether it is random and
whether it can be undone. Undoing takes the last entry of a step's name, wherever it stands, so steps may repeat.

A draw depends on the step's seed, sample_id and its name alone. Null arrays, shapes or data stay as they
are; a missing key is an error unless the step allows it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K

ENTRY = "struct<name: string, params: string, applied: boolean, random: boolean, invertible: boolean, kernel: string>"
HELD = 64 << 20


@dataclass
class Record:
    """One row within a task."""

    sample_id: object
    arrays: dict[str, np.ndarray | None]
    affine: np.ndarray | None
    trace: list[dict]

    def take(self, name: str, where: Callable[[dict], bool] = lambda entry: True) -> dict | None:
        """The last entry of a name that fits, removed; its parameters are parsed."""
        for k in range(len(self.trace) - 1, -1, -1):
            entry = self.trace[k] | {"params": json.loads(self.trace[k]["params"])}
            if entry["name"] == name and where(entry):
                del self.trace[k]
                return entry
        return None


@dataclass
class Step:
    """What a step does to a record; subclasses give run, and back if they can be undone."""

    keys: Sequence[str]
    seed: int = field(default=0, kw_only=True)
    prob: float | None = field(default=None, kw_only=True)
    allow_missing: bool = field(default=False, kw_only=True)

    random = False
    kernel: str | None = None

    def __post_init__(self) -> None:
        self.keys = (self.keys,) if isinstance(self.keys, str) else tuple(self.keys)
        if self.prob is not None and not 0 <= self.prob <= 1:
            raise ValueError("prob must be in [0, 1]")

    @property
    def name(self) -> str:
        return type(self).__name__

    @property
    def invertible(self) -> bool:
        return type(self).back is not Step.back

    def run(self, record: Record, draw: Callable[..., float]) -> dict:
        raise NotImplementedError

    def back(self, record: Record, params: dict) -> None:
        raise NotImplementedError

    def present(self, record: Record) -> list[str]:
        missing = [k for k in self.keys if k not in record.arrays]
        if missing and not self.allow_missing:
            raise KeyError(f"{self.name}: no {missing}")
        return [k for k in self.keys if k in record.arrays and record.arrays[k] is not None]

    def apply(self, record: Record) -> None:
        def draw(*parts: object) -> float:
            return K.drawn(self.seed, record.sample_id, *parts)

        params = {"keys": self.present(record)}
        applied = bool(params["keys"]) and (self.prob is None or draw("prob") < self.prob)
        if applied:
            params |= self.run(record, draw)
        self.record(record, params, applied)

    def record(self, record: Record, params: dict, applied: bool) -> None:
        record.trace.append({"name": self.name, "params": json.dumps(params), "applied": applied, "random": self.random or self.prob is not None, "invertible": self.invertible, "kernel": self.kernel})

    def undo(self, record: Record) -> None:
        """Undo this step's last run, if there is one and it can be undone."""
        if self.invertible and (entry := record.take(self.name, self.mine)) and entry["applied"]:
            self.back(record, entry["params"])

    def mine(self, entry: dict) -> bool:
        return True


def _spatial(x: np.ndarray) -> tuple[int, ...]:
    return x.shape[:-1]


def _per_axis(value: int | Sequence[int], n: int) -> list[int]:
    out = [value] * n if isinstance(value, int) else list(value)
    if len(out) != n:
        raise ValueError(f"{n} sizes are needed, not {out}")
    return out


def _cut(x: np.ndarray, start: Sequence[int], size: Sequence[int]) -> np.ndarray:
    return x[tuple(slice(s, s + n) for s, n in zip(start, size))]


def _put(x: np.ndarray, start: Sequence[int], shape: Sequence[int]) -> np.ndarray:
    """x in an array of zeros."""
    out = np.zeros((*shape, x.shape[-1]))
    out[tuple(slice(s, s + n) for s, n in zip(start, x.shape[:-1]))] = x
    return out


@dataclass
class Flip(Step):
    """Spatial axes reversed."""

    axes: Sequence[int] = (0,)

    def run(self, record, draw):
        for k in self.present(record):
            record.arrays[k] = np.flip(record.arrays[k], tuple(self.axes))
        return {"axes": list(self.axes)}

    def back(self, record, params):
        for k in params["keys"]:
            record.arrays[k] = np.flip(record.arrays[k], tuple(params["axes"]))


@dataclass
class Shift(Step):
    """An offset added, or one drawn from [low, high)."""

    low: float = 0.0
    high: float | None = None

    def run(self, record, draw):
        offset = self.low if self.high is None else self.low + draw("offset") * (self.high - self.low)
        for k in self.present(record):
            record.arrays[k] = record.arrays[k] + offset
        return {"offset": offset}

    def back(self, record, params):
        for k in params["keys"]:
            record.arrays[k] = record.arrays[k] - params["offset"]


@dataclass
class Apply(Step):
    """Any function of an array, with its inverse if it has one; `label` tells several apart."""

    fn: Callable[[np.ndarray], np.ndarray] = lambda x: x
    inverse: Callable[[np.ndarray], np.ndarray] | None = None
    label: str = ""

    @property
    def invertible(self):
        return self.inverse is not None

    def run(self, record, draw):
        for k in self.present(record):
            record.arrays[k] = np.asarray(self.fn(record.arrays[k]), float)
        return {"label": self.label}

    def record(self, record, params, applied):
        super().record(record, params | {"label": self.label}, applied)

    def mine(self, entry):
        return entry["params"].get("label") == self.label

    def back(self, record, params):
        for k in params["keys"]:
            record.arrays[k] = np.asarray(self.inverse(record.arrays[k]), float)


@dataclass
class Spacing(Step):
    """Another voxel spacing. Where voxel axes follow the world's, arrays are resized (half-pixel centres, clamped borders; nearest on a
    grid from corner to corner); otherwise they are read on the new grid, fill 0 outside. Without an affine the spacing is 1."""

    pixdim: Sequence[float] = (1.0, 1.0, 1.0)
    modes: str | Sequence[str] = "linear"

    def __post_init__(self):
        super().__post_init__()
        self.modes = [self.modes] * len(self.keys) if isinstance(self.modes, str) else list(self.modes)
        if len(self.pixdim) != 3 or min(self.pixdim) <= 0:
            raise ValueError("three spacings above 0 are needed")
        if len(self.modes) != len(self.keys) or not {*self.modes} <= {"linear", "nearest"}:
            raise ValueError("a mode a key: linear or nearest")

    def run(self, record, draw):
        from ..operators.geometry import new_grid, read_grid

        a, modes = record.affine, dict(zip(self.keys, self.modes))
        aligned = a is None or K.axis_aligned(a)
        old = np.ones(3) if a is None else K.spacing(a)
        to = None if a is None else new_grid(a, self.pixdim)
        shapes = {}
        for k in self.present(record):
            x = record.arrays[k]
            if x.ndim != 4:
                raise ValueError("Spacing takes three spatial axes")
            shapes[k] = list(_spatial(x))
            if aligned:
                record.arrays[k] = K.resized(x, K.respaced_shape(shapes[k], old, self.pixdim), modes[k])
            else:
                span = np.abs((np.linalg.inv(to) @ a)[:3, :3]) @ np.array(shapes[k])
                record.arrays[k] = read_grid(x, a, to, tuple(int(n) for n in np.maximum(np.floor(span + 0.5), 1)), modes[k], 0.0)
        record.affine = to
        return {"shapes": shapes, "modes": {k: modes[k] for k in shapes}, "affine": None if a is None else a.ravel().tolist(), "resized": aligned}

    def back(self, record, params):
        from ..operators.geometry import read_grid

        to = None if params["affine"] is None else np.array(params["affine"]).reshape(4, 4)
        for k, shape in params["shapes"].items():
            x, mode = record.arrays[k], params["modes"][k]
            record.arrays[k] = K.resized(x, shape, mode) if params["resized"] else read_grid(x, record.affine, to, tuple(shape), mode, 0.0)
        record.affine = to


@dataclass
class RandomSpatialCrop(Step):
    """A crop of a fixed size or one drawn up to `most`, in the middle, anywhere, or around a labelled place.

    With `invalid` the center is a place of the label (the second key, or `label`) with another value; with `ratio` as well,
    boxes with too small a share of other values are drawn anew, `attempts` times at most.
    """

    size: int | Sequence[int] = 0
    most: int | Sequence[int] | None = None
    random_center: bool = True
    random_shape: bool = False
    invalid: float | None = None
    ratio: float = 0.0
    attempts: int = 1

    random, kernel = True, "SpatialCrop"

    def __post_init__(self):
        super().__post_init__()
        if not 0 <= self.ratio <= 1:
            raise ValueError("ratio must be in [0, 1]")
        if self.attempts < 1:
            raise ValueError("attempts must be 1 or more")
        if self.ratio > 0 and self.invalid is None:
            raise ValueError("a ratio needs the invalid label")

    def run(self, record, draw):
        here = self.present(record)
        shape = _spatial(record.arrays[here[0]])
        rank = len(shape)
        most = None if self.most is None else _per_axis(self.most, rank)
        size = K.crop_size(shape, _per_axis(self.size, rank), most, draw if self.random_shape else None)

        def anywhere(k: int) -> list[int]:
            if not self.random_center:
                return [n // 2 for n in shape]
            return [int(draw("center", k, axis) * (n - s + 1)) + s // 2 for axis, (n, s) in enumerate(zip(shape, size))]

        if self.invalid is None:
            start = K.crop_starts(anywhere(0), size, shape)
        else:
            label = record.arrays[self.keys[1] if len(self.keys) > 1 else "label"]
            start = K.label_aware_start(label, size, self.invalid, self.ratio, self.attempts, anywhere, draw)
        shapes = {}
        for k in here:
            shapes[k] = list(_spatial(record.arrays[k]))
            record.arrays[k] = _cut(record.arrays[k], start, size)
        return {"start": start, "size": size, "shapes": shapes}

    def back(self, record, params):
        for k, shape in params["shapes"].items():
            record.arrays[k] = _put(record.arrays[k], params["start"], shape)


@dataclass
class RandomCropByLabel(Step):
    """Image and label (the two keys) cut around a place drawn from label > 0 with odds `positive`, or from label = 0 with `negative`.

    Positive places are drawn among voxels and channels, negative ones among voxels with any channel of 0; with a `reference` these
    must have a channel above `threshold` in it. Without any such place the center is anywhere. A size beyond the array gives
    what there is.
    """

    size: Sequence[int] = ()
    positive: float = 1.0
    negative: float = 1.0
    reference: str | None = None
    threshold: float = 0.0

    random, kernel = True, "SpatialCrop"

    def __post_init__(self):
        super().__post_init__()
        if len(self.keys) != 2:
            raise ValueError("an image and a label are needed")
        if min(self.positive, self.negative) < 0 or self.positive + self.negative == 0:
            raise ValueError("odds must not be negative, nor both 0")

    def run(self, record, draw):
        here = self.present(record)
        if len(here) < 2:
            return {"start": [], "size": [], "shapes": {}}
        label = record.arrays[self.keys[1]]
        shape = _spatial(record.arrays[self.keys[0]])
        size = _per_axis(tuple(self.size), len(shape))
        if draw("side") < self.positive / (self.positive + self.negative):
            found, of = np.flatnonzero(label > 0), label.shape
        else:
            free = (label == 0).any(axis=-1)
            if self.reference is not None:
                if record.arrays.get(self.reference) is None:
                    raise KeyError(f"{self.name}: no {self.reference}")
                free &= record.arrays[self.reference].max(axis=-1) > self.threshold
            found, of = np.flatnonzero(free), free.shape
        if len(found):
            center = [int(i) for i in np.unravel_index(found[int(draw("place") * len(found))], of)][: len(shape)]
        else:
            center = [int(draw("any", k) * n) for k, n in enumerate(shape)]
        start, shapes = K.crop_starts(center, size, shape), {}
        for k in here:
            shapes[k] = list(_spatial(record.arrays[k]))
            record.arrays[k] = _cut(record.arrays[k], start, size)
        return {"start": start, "size": size, "shapes": shapes}

    def back(self, record, params):
        for k, shape in params["shapes"].items():
            record.arrays[k] = _put(record.arrays[k], params["start"], shape)


@dataclass
class RandomRotate(Step):
    """Slices turned by an angle drawn from [-factor, factor): the first key linear with fill, others nearest with 0.

    In `crop` mode the largest rectangle without fill is cut out and resized back; this can't be undone. Otherwise
    turning back by the angle is the inverse, as far as reading between voxels allows.
    """

    factor: float = 0.1
    fill: float = 0.0
    mode: str = "constant"

    random, kernel = True, "rotate_volume"

    def __post_init__(self):
        super().__post_init__()
        if self.factor < 0 or self.mode not in ("constant", "crop"):
            raise ValueError("factor must not be negative, and mode constant or crop")
        if self.prob is None:
            self.prob = 0.8

    @property
    def invertible(self):
        return self.mode == "constant"

    def _turn(self, record, keys, angle):
        for k in keys:
            first = k == self.keys[0]
            how = "linear" if first else "nearest"
            x = record.arrays[k]
            if x.ndim != 4:
                raise ValueError("RandomRotate takes three spatial axes")
            x = K.rotated(x, angle, how, self.fill if first else 0.0)
            record.arrays[k] = K.cropped_to_inscribed(x, angle, how) if self.mode == "crop" else x

    def run(self, record, draw):
        angle = (draw("angle") * 2 - 1) * self.factor
        self._turn(record, self.present(record), angle)
        return {"angle": angle, "mode": self.mode}

    def back(self, record, params):
        self._turn(record, params["keys"], -params["angle"])


@dataclass
class CropForeground(Step):
    """All keys cut to the box around what `select` finds in the source, or in some of its channels.

    `clean` is a function of the mask, or `largest_component`.
    """

    source: str | None = None
    select: Callable[[np.ndarray], np.ndarray] = lambda x: x > 0
    channels: Sequence[int] | None = None
    margin: int | Sequence[int] = 0
    divisible: int | Sequence[int] = 1
    allow_smaller: bool = True
    clean: str | Callable[[np.ndarray], np.ndarray] | None = None

    kernel = "SpatialCrop"

    def __post_init__(self):
        super().__post_init__()
        if self.source is None:
            if len(self.keys) > 1:
                raise ValueError("several keys need a source")
            self.source = self.keys[0]
        if isinstance(self.clean, str) and self.clean != "largest_component":
            raise ValueError(f"no such mask step: {self.clean}")

    def run(self, record, draw):
        from ..operators.regions import largest_mask

        x = record.arrays.get(self.source)
        if x is None:
            if self.allow_missing:
                return {"shapes": {}, "start": [], "end": []}
            raise KeyError(f"{self.name}: no {self.source}")
        rank = x.ndim - 1
        mask = np.asarray(self.select(x if self.channels is None else x[..., list(self.channels)]), bool).any(axis=-1)
        if self.clean is not None:
            mask = largest_mask(mask) if isinstance(self.clean, str) else np.asarray(self.clean(mask), bool)
        start, end = K.foreground_bounds(mask, _per_axis(self.margin, rank), _per_axis(self.divisible, rank), self.allow_smaller)
        shapes = {}
        for k in self.present(record):
            shapes[k] = list(_spatial(record.arrays[k]))
            record.arrays[k] = _cut(record.arrays[k], start, [b - a for a, b in zip(start, end)])
        return {"shapes": shapes, "start": start, "end": end}

    def back(self, record, params):
        for k, shape in params["shapes"].items():
            record.arrays[k] = _put(record.arrays[k], params["start"], shape)


@dataclass
class RandomChoice(Step):
    """Some of the steps, as many as drawn from (least, most), in drawn order, without replacement.

    With weights the order is by Gumbel keys; a step of weight 0 is never taken. Without, all are alike. Each step taken leaves its own entry, before this one's.
    """

    keys: Sequence[str] = ()
    steps: Sequence[Step] = ()
    choices: int | tuple[int, int] = 1
    weights: Sequence[float] | None = None

    random, kernel = True, "RandomChoice"

    def __post_init__(self):
        super().__post_init__()
        least, most = (self.choices, self.choices) if isinstance(self.choices, int) else self.choices
        weights = [1.0] * len(self.steps) if self.weights is None else [float(w) for w in self.weights]
        if not self.steps or len(weights) != len(self.steps) or min(weights) < 0:
            raise ValueError("steps are needed, and a weight of 0 or more for each")
        if not 0 <= least <= most <= sum(w > 0 for w in weights):
            raise ValueError(f"can't take {least} to {most} steps")
        self.choices, self.weights = (least, most), weights

    @property
    def invertible(self):
        return any(s.invertible for s in self.steps)

    def apply(self, record):
        def draw(*parts):
            return K.drawn(self.seed, record.sample_id, *parts)

        least, most = self.choices
        taken = []
        if self.prob is None or draw("prob") < self.prob:
            n = least + int(draw("number") * (most - least + 1))
            # fixed values: the clamp of a uniform, and the key of weight 0
            key = lambda k, w: np.log(w) - np.log(-np.log(max(draw("choice", k), 1e-6))) if w > 0 else -1e9
            taken = sorted(range(len(self.steps)), key=lambda k: (-key(k, self.weights[k]), k))[:n]
        for k in taken:
            self.steps[k].apply(record)
        self.record(record, {"taken": taken, "names": [self.steps[k].name for k in taken]}, bool(taken))

    def back(self, record, params):
        for k in reversed(params["taken"]):
            self.steps[k].undo(record)


class Pipeline:
    """Steps in order, and their inverses from the last to the first."""

    def __init__(self, *steps: Step | Pipeline) -> None:
        self.steps = [s for x in steps for s in (x.steps if isinstance(x, Pipeline) else [x])]

    def __call__(self, df: DataFrame) -> DataFrame:
        steps = self.steps

        def work(record: Record) -> None:
            for s in steps:
                s.apply(record)

        return each_record(df, work)

    def inverse(self, df: DataFrame) -> DataFrame:
        steps = self.steps

        def work(record: Record) -> None:
            for s in reversed(steps):
                s.undo(record)

        return each_record(df, work)


def _array(cell: pa.Scalar) -> np.ndarray | None:
    shape = cell["shape"] if cell.is_valid else None
    if shape is None or not shape.is_valid or not cell["data"].is_valid:
        return None
    return cell["data"].values.to_numpy(zero_copy_only=False).astype(float).reshape(shape.as_py())


def each_record(df: DataFrame, work: Callable[[Record], None]) -> DataFrame:
    """df with arrays, affine and trace of every row as work leaves them."""
    if "trace" not in df.columns:
        df = df.withColumn("trace", F.array().cast(f"array<{ENTRY}>"))
    if "affine" not in df.columns:
        df = df.withColumn("affine", F.lit(None).cast("array<double>"))
    keys = [c for c, t in df.dtypes if t == "struct<shape:array<int>,data:array<double>>"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.schema.names.index(n) for n in (*keys, "sample_id", "affine", "trace")}
            new: dict[str, list] = {n: [] for n in (*keys, "affine", "trace")}
            first = held = 0

            def out(end: int) -> pa.RecordBatch:
                cols = [pa.array(new[f.name], f.type) if f.name in new else batch.column(i).slice(first, end - first) for i, f in enumerate(batch.schema)]
                for values in new.values():
                    values.clear()
                return pa.RecordBatch.from_arrays(cols, schema=batch.schema)

            for row in range(batch.num_rows):
                affine = batch.column(at["affine"])[row].as_py()
                if affine is not None and (len(affine) != 16 or not np.isfinite(affine).all() or affine[12:] != [0, 0, 0, 1]):
                    raise ValueError("not a 4x4 affine")
                arrays = {k: _array(batch.column(at[k])[row]) for k in keys}
                record = Record(batch.column(at["sample_id"])[row].as_py(), arrays, None if affine is None else np.array(affine).reshape(4, 4), batch.column(at["trace"])[row].as_py() or [])
                work(record)
                for k in keys:
                    x = record.arrays[k]
                    new[k].append(None if x is None else {"shape": list(x.shape), "data": np.ascontiguousarray(x).ravel()})
                    held += 0 if x is None else x.nbytes
                new["affine"].append(None if record.affine is None else record.affine.ravel())
                new["trace"].append(record.trace)
                if held >= HELD:
                    yield out(row + 1)
                    first, held = row + 1, 0
            if first < batch.num_rows:
                yield out(batch.num_rows)

    return df.mapInArrow(run, df.schema)


def resample_many(df: DataFrame, modes: dict[str, str], shape: Sequence[int], to: str = "to_affine", fill: float = 0.0) -> DataFrame:
    """Several arrays of each row on the grid of the row's column `to`: the coordinates are worked out once, and read with a mode a key."""
    from ..operators.geometry import read_grids

    if not {*modes.values()} <= {"linear", "nearest"}:
        raise ValueError("modes are linear or nearest")
    given = df.withColumn("trace", F.array(F.struct(F.lit("to").alias("name"), F.to_json(to).alias("params"), F.lit(True).alias("applied"), F.lit(False).alias("random"), F.lit(False).alias("invertible"), F.lit(None).alias("kernel"))).cast(f"array<{ENTRY}>"))

    def work(record: Record) -> None:
        grid = np.array(json.loads(record.trace[-1]["params"])).reshape(4, 4)
        if record.affine is None:
            raise ValueError("resampling needs an affine")
        here = {k: (record.arrays[k], m) for k, m in modes.items() if record.arrays[k] is not None}
        record.arrays |= read_grids(here, record.affine, grid, tuple(shape), fill)
        record.affine = grid

    return each_record(given, work).drop("trace")
