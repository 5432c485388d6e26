"""Operators on packed volumes, each row with a shape and an affine of its own.

Rows are (sample_id, shape array<int> of (d, h, w, c), data array<double> row-major, affine array<double> of
16), and any further columns, which pass through. Every operator reads within its row: an Arrow pass with a
NumPy kernel a volume, and no shuffle. `trace` holds what each operator needs for its inverse; the last
one is undone first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import axis_aligned, resized, respaced_shape, spacing

TRACE = "array<struct<name: string, perm: array<int>, flips: array<boolean>, shape: array<int>, affine: array<double>>>"
#: World axis and sign of each orientation code: fixed values.
WORLD = {"R": (0, 1), "L": (0, -1), "A": (1, 1), "P": (1, -1), "S": (2, 1), "I": (2, -1)}

#: Bytes of results that a task holds before it gives them back.
HELD = 64 << 20

Row = tuple[np.ndarray, np.ndarray, list[dict]]


def _each(df: DataFrame, kernel: Callable[[np.ndarray, np.ndarray, list[dict]], Row]) -> DataFrame:
    """df with voxels, affine and trace of every row as the kernel gives them; rows without an array or affine stay as they are."""
    if "trace" not in df.columns:
        df = df.withColumn("trace", F.array().cast(TRACE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(batch.schema.names.index(k)) for k in ("shape", "data", "affine", "trace")))
            new: dict[str, list] = {"shape": [], "data": [], "affine": [], "trace": []}
            first = held = 0

            def out(end: int) -> pa.RecordBatch:
                cols = [pa.array(new[f.name], f.type) if f.name in new else batch.column(i).slice(first, end - first) for i, f in enumerate(batch.schema)]
                for values in new.values():
                    values.clear()
                return pa.RecordBatch.from_arrays(cols, schema=batch.schema)

            for row, (shape, data, affine, trace) in enumerate(rows):
                if not (shape.is_valid and data.is_valid and affine.is_valid):
                    for k, v in (("shape", shape), ("data", data), ("affine", affine), ("trace", trace)):
                        new[k].append(v.as_py())
                    continue
                matrix = np.asarray(affine.as_py(), dtype=float)
                if matrix.size != 16 or not np.isfinite(matrix).all() or matrix[12:].tolist() != [0, 0, 0, 1]:
                    raise ValueError("not a 4x4 affine")
                x, a, kept = kernel(data.values.to_numpy(zero_copy_only=False).reshape(shape.as_py()), matrix.reshape(4, 4), trace.as_py())
                for k, v in (("shape", x.shape), ("data", x.ravel()), ("affine", a.ravel()), ("trace", kept)):
                    new[k].append(v)
                held += x.nbytes
                if held >= HELD:
                    yield out(row + 1)
                    first, held = row + 1, 0
            if first < batch.num_rows:
                yield out(batch.num_rows)

    return df.mapInArrow(run, df.schema)


def _entry(name: str, x: np.ndarray, a: np.ndarray, perm: list[int] | None = None, flips: list[bool] | None = None) -> dict:
    return {"name": name, "perm": perm, "flips": flips, "shape": list(x.shape), "affine": a.ravel().tolist()}


def _last(trace: list[dict], name: str) -> dict:
    if not trace or trace[-1]["name"] != name:
        raise ValueError(f"the last operator was not {name}")
    return trace[-1]


def orient(df: DataFrame, axcodes: str = "RAS") -> DataFrame:
    """Permute and flip each volume so that its axes (d, h, w) follow axcodes from last to first; the affine follows the voxels."""
    codes = axcodes.upper()
    if len(codes) != 3 or any(x not in WORLD for x in codes) or len({WORLD[x][0] for x in codes}) != 3:
        raise ValueError(f"not an orientation: {axcodes}")
    targets = [WORLD[x] for x in reversed(codes)]

    def kernel(x: np.ndarray, a: np.ndarray, trace: list[dict]) -> Row:
        along = np.abs(a[:3, :3]).argmax(axis=0)  # the world axis that each voxel axis follows most
        perm = [int((along == axis).argmax()) for axis, _ in targets]
        flips = [bool((a[along[k], k] < 0) != (sign < 0)) for k, (_, sign) in zip(perm, targets)]
        to = np.eye(4)
        to[:3, :3] = 0
        for j, (k, back) in enumerate(zip(perm, flips)):
            to[k, j] = -1 if back else 1
            to[k, 3] = x.shape[k] - 1 if back else 0
        y = np.flip(x.transpose(*perm, 3), [j for j in range(3) if flips[j]])
        return y, a @ to, [*trace, _entry("Orientation", x, a, perm, flips)]

    return _each(df, kernel)


def unorient(df: DataFrame) -> DataFrame:
    """Undo the last orient: voxels, shape and affine."""

    def kernel(x: np.ndarray, a: np.ndarray, trace: list[dict]) -> Row:
        done = _last(trace, "Orientation")
        y = np.flip(x, [j for j in range(3) if done["flips"][j]]).transpose(*np.argsort(done["perm"]), 3)
        return y, np.array(done["affine"]), trace[:-1]

    return _each(df, kernel)


def sampled(x: np.ndarray, points: np.ndarray, mode: str, fill: float) -> np.ndarray:
    """x (d, h, w, c) at points (3, ...) in voxel coordinates, channels last; see `resample`."""
    size = np.array(x.shape[:3]).reshape(3, *[1] * (points.ndim - 1))

    def at(places: np.ndarray) -> np.ndarray:
        inside = ((places >= 0) & (places < size)).all(axis=0)
        safe = np.clip(places, 0, size - 1).astype(np.int64)
        return np.where(inside[..., None], x[safe[0], safe[1], safe[2]], fill)

    if mode == "nearest":
        return at(np.rint(points))
    low = np.floor(points)
    part = points - low
    out = np.zeros((*points.shape[1:], x.shape[3]))
    for corner in product((0, 1), repeat=3):
        up = np.array(corner).reshape(size.shape)
        out += np.where(up == 1, part, 1 - part).prod(axis=0)[..., None] * at(low + up)
    return out


def read_grids(arrays: dict[str, tuple[np.ndarray, str]], a: np.ndarray, to: np.ndarray, shape: tuple[int, ...], fill: float) -> dict[str, np.ndarray]:
    """Arrays of one affine on the grid with affine `to`, each with its mode; a slab of coordinates at a time serves all."""
    m = np.linalg.inv(a) @ to
    out = {k: np.empty((*shape, x.shape[3])) for k, (x, _) in arrays.items()}
    cells = np.stack(np.meshgrid(np.arange(shape[1]), np.arange(shape[2]), indexing="ij"))
    for d in range(shape[0]):
        points = np.tensordot(m[:3, 1:3], cells, 1) + (m[:3, 0] * d + m[:3, 3]).reshape(3, 1, 1)
        for k, (x, mode) in arrays.items():
            out[k][d] = sampled(x, points, mode, fill)
    return out


def read_grid(x: np.ndarray, a: np.ndarray, to: np.ndarray, shape: tuple[int, ...], mode: str, fill: float) -> np.ndarray:
    return read_grids({"x": (x, mode)}, a, to, shape, fill)["x"]


def new_grid(a: np.ndarray, pixdim: Sequence[float], diagonal: bool = False) -> np.ndarray:
    """The affine of another spacing: the same origin, and the same axes, or the world's if diagonal."""
    to = np.eye(4)
    to[:3, :3] = (np.eye(3) if diagonal else a[:3, :3] / spacing(a)) * np.asarray(pixdim, dtype=float)
    to[:3, 3] = a[:3, 3]
    return to


def respace(df: DataFrame, pixdim: tuple[float, float, float], mode: str = "linear", fill: float = 0.0, diagonal: bool = False) -> DataFrame:
    """Each volume at another voxel spacing, from its own affine.

    Where voxel axes run along the world's, the volume is resized: linear with half-pixel centres and clamped borders, nearest on a grid from
    corner to corner. Otherwise, and if diagonal, the new grid starts at the same origin and runs along the same axes, or the
    world's. It spans the mapped corners of the volume; nearest rounds half to even; linear mixes the fill
    into voxels beyond the border.
    """
    if mode not in ("nearest", "linear"):
        raise ValueError(f"no such mode: {mode}")
    if len(pixdim) != 3 or min(pixdim) <= 0:
        raise ValueError("three spacings above 0 are needed")

    def kernel(x: np.ndarray, a: np.ndarray, trace: list[dict]) -> Row:
        to = new_grid(a, pixdim, diagonal)
        if not diagonal and axis_aligned(a):
            y = resized(x, respaced_shape(x.shape[:3], spacing(a), pixdim), mode)
            return y, to, [*trace, _entry("Spacing", x, a, flips=[])]
        span = np.abs((np.linalg.inv(to) @ a)[:3, :3]) @ np.array(x.shape[:3])
        shape = np.maximum(np.floor(span + 0.5), 1).astype(int)
        return read_grid(x, a, to, tuple(shape), mode, fill), to, [*trace, _entry("Spacing", x, a)]

    return _each(df, kernel)


def unspace(df: DataFrame, mode: str = "linear", fill: float = 0.0) -> DataFrame:
    """Undo the last respace, in the way that it was done."""

    def kernel(x: np.ndarray, a: np.ndarray, trace: list[dict]) -> Row:
        done = _last(trace, "Spacing")
        to, shape = np.array(done["affine"]).reshape(4, 4), tuple(done["shape"][:3])
        by_size = done["flips"] is not None  # no flips, but a list of them: it was resized
        return (resized(x, shape, mode) if by_size else read_grid(x, a, to, shape, mode, fill)), to, trace[:-1]

    return _each(df, kernel)


def resample(df: DataFrame, shape: tuple[int, int, int], mode: str = "linear", fill: float = 0.0, to: str = "to_affine") -> DataFrame:
    """Each volume on the grid of its column `to` (16 numbers), with one shape for all."""
    if mode not in ("nearest", "linear"):
        raise ValueError(f"no such mode: {mode}")
    held = df.withColumn("trace", F.array(F.struct(F.lit("Resample").alias("name"), F.lit(None).alias("perm"), F.lit(None).alias("flips"), F.lit(None).alias("shape"), F.col(to).alias("affine"))).cast(TRACE))

    def kernel(x: np.ndarray, a: np.ndarray, trace: list[dict]) -> Row:
        grid = np.array(trace[-1]["affine"]).reshape(4, 4)
        return read_grid(x, a, grid, shape, mode, fill), grid, trace

    return _each(held, kernel).drop("trace")
