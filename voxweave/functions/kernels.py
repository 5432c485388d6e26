"""NumPy kernels of one array (d, h, w, c), for operators that read within a row.

Draws are those of `scalars.uniform`: seed and parts alone decide, in any engine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np


def drawn(seed: int, *parts: object) -> float:
    """A uniform in [0, 1), equal to scalars.uniform(seed, *parts)."""
    text = "|".join([str(seed), *map(str, parts)])
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 4294967296.0


# ---- affines and grids -------------------------------------------------------------------------


def spacing(a: np.ndarray) -> np.ndarray:
    return np.linalg.norm(a[:3, :3], axis=0)


def axis_aligned(a: np.ndarray, tolerance: float = 1e-5) -> bool:
    """Whether voxel axes run along the world's, in order; signs may differ."""
    direction = a[:3, :3] / spacing(a)
    return bool((np.abs(direction - np.diag(np.diag(direction))) <= tolerance).all())


def resized(x: np.ndarray, shape: Sequence[int], mode: str) -> np.ndarray:
    """x with other sizes of its first axes: linear with half-pixel centres and clamped borders, or the nearest on a grid from corner to corner."""
    for axis, n in enumerate(shape):
        size = x.shape[axis]
        if mode == "nearest":
            at = np.rint(np.arange(n) * ((size - 1) / (n - 1) if n > 1 else 0.0)).astype(int)
            x = np.take(x, np.clip(at, 0, size - 1), axis)
            continue
        at = np.clip((np.arange(n) + 0.5) * (size / n) - 0.5, 0, size - 1)
        low = np.floor(at).astype(int)
        part = (at - low).reshape(-1, *[1] * (x.ndim - axis - 1))
        x = np.take(x, low, axis) * (1 - part) + np.take(x, np.minimum(low + 1, size - 1), axis) * part
    return x


def respaced_shape(shape: Sequence[int], old: Sequence[float], new: Sequence[float]) -> list[int]:
    return [int(n) for n in np.maximum(np.floor(np.asarray(shape) * np.asarray(old) / np.asarray(new) + 0.5), 1)]


# ---- rotation within the (h, w) plane ----------------------------------------------------------


def rotated(x: np.ndarray, angle: float, mode: str = "linear", fill: float = 0.0) -> np.ndarray:
    """Each slice turned about its middle: the result at (row, column) is read where the turned place falls; outside is fill."""
    _, h, w, _ = x.shape
    cos, sin = np.cos(angle), np.sin(angle)
    row, column = np.meshgrid(np.arange(h) - h / 2, np.arange(w) - w / 2, indexing="ij")
    across, down = cos * column + sin * row + w / 2, -sin * column + cos * row + h / 2

    def at(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        inside = (i >= 0) & (i < h) & (j >= 0) & (j < w)
        got = x[:, np.clip(i, 0, h - 1).astype(int), np.clip(j, 0, w - 1).astype(int)]
        return np.where(inside[None, :, :, None], got, fill)

    if mode == "nearest":
        away = lambda v: np.trunc(v + np.copysign(0.5, v))  # noqa: E731  halves go away from zero
        return at(away(down), away(across))
    i, j = np.floor(down), np.floor(across)
    y, z = (down - i)[None, :, :, None], (across - j)[None, :, :, None]
    upper = (1 - z) * at(i, j) + z * at(i, j + 1)
    lower = (1 - z) * at(i + 1, j) + z * at(i + 1, j + 1)
    return (1 - y) * upper + y * lower


def inscribed(h: int, w: int, angle: float) -> tuple[float, float]:
    """(height, width) of the largest upright rectangle of the plane's proportions within the turned plane, so that none of it is fill."""
    sin, cos = np.sin(abs(angle)), np.cos(angle)
    scale = min(h / (h * cos + w * sin), w / (w * cos + h * sin))
    return h * scale, w * scale


def cropped_to_inscribed(x: np.ndarray, angle: float, mode: str) -> np.ndarray:
    """The middle of a turned array that has no fill, at the size it had; 2 % are left as a margin."""
    _, h, w, _ = x.shape
    tall, wide = inscribed(h, w, angle)
    share = min(tall / h, wide / w) * 0.98
    start = [int((n - n * share) / 2) for n in (h, w)]
    part = x[:, start[0] : h - start[0], start[1] : w - start[1]]
    if mode == "linear":
        return resized(part, (x.shape[0], h, w), "linear")
    for axis, n in ((1, h), (2, w)):
        size = part.shape[axis]
        part = np.take(part, np.minimum(np.floor((np.arange(n) + 0.5) * (size / n)).astype(int), size - 1), axis)
    return part


# ---- crops -------------------------------------------------------------------------------------


def summed_area(counts: np.ndarray) -> np.ndarray:
    """Table whose corners give the sum over any box; one longer than counts along each axis."""
    table = np.zeros([n + 1 for n in counts.shape])
    table[tuple(slice(1, None) for _ in counts.shape)] = counts
    for axis in range(counts.ndim):
        table = table.cumsum(axis)
    return table


def box_sum(table: np.ndarray, start: Sequence[int], size: Sequence[int]) -> float:
    total = 0.0
    for corner in np.ndindex(*[2] * table.ndim):
        at = tuple(s + n * c for s, n, c in zip(start, size, corner))
        total += table[at] * (-1) ** (table.ndim - sum(corner))
    return total


def crop_starts(center: Sequence[int], size: Sequence[int], shape: Sequence[int]) -> list[int]:
    """Where a box around a center begins, once it is moved to lie inside."""
    return [max(min(max(c - n // 2, 0) + n, most) - n, 0) for c, n, most in zip(center, size, shape)]


def crop_size(shape: Sequence[int], least: Sequence[int], most: Sequence[int] | None, draw: Callable[..., float] | None) -> list[int]:
    """A size a axis, 0 and less meaning the whole; with a draw, one between least and most."""
    out = []
    for k, (n, a) in enumerate(zip(shape, least)):
        low = min(a, n) if a > 0 else n
        if draw is None:
            out.append(low)
            continue
        high = min(most[k], n) if most is not None and most[k] > 0 else n
        low = min(low, high)
        out.append(low + int(draw("size", k) * (high - low + 1)))
    return out


def label_aware_start(label: np.ndarray, size: Sequence[int], invalid: float, ratio: float, attempts: int, anywhere: Callable[[int], list[int]], draw: Callable[..., float]) -> list[int]:
    """Where a crop begins whose center is a labelled place, tried anew until enough of it is labelled.

    `anywhere(k)` is the k-th random center. What the last attempt puts in place is not looked at again.
    """
    shape = label.shape[:-1]
    valid = label != invalid
    places = np.flatnonzero(valid.any(axis=-1))
    if len(places):
        center = [int(i) for i in np.unravel_index(places[int(draw("label") * len(places))], shape)]
    else:
        center = anywhere(0)
    if ratio > 0:
        table = summed_area(valid.sum(axis=-1))
        cells = float(np.prod(size)) * label.shape[-1]
        for k in range(attempts):
            if box_sum(table, crop_starts(center, size, shape), size) / cells < ratio:
                center = anywhere(k + 1)
    return crop_starts(center, size, shape)


def foreground_bounds(mask: np.ndarray, margin: Sequence[int], divisible: Sequence[int], allow_smaller: bool) -> tuple[list[int], list[int]]:
    """(starts, ends) of the box around a mask; the whole if it is empty."""
    start, end = [], []
    for k, n in enumerate(mask.shape):
        line = np.flatnonzero(mask.any(axis=tuple(a for a in range(mask.ndim) if a != k)))
        low, high = (int(line[0]), int(line[-1]) + 1) if len(line) else (0, n)
        low, high = max(low - margin[k], 0), min(high + margin[k], n)
        if not allow_smaller:
            low, high = min(low, n - margin[k]), max(high, margin[k])
        high = min(high + -(high - low) % divisible[k], n)
        start.append(low)
        end.append(high)
    return start, end
