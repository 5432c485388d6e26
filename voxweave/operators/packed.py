"""Convolution, pooling, attention within windows, resampling and rotation on packed arrays.

Rows are (sample_id, shape, data) as `pack` makes them: (d, h, w, c), images with d = 1. An array is read within its row, a
matrix product a tap, so nothing is shuffled; rows may differ in shape. Null arrays stay null, other columns are left
out, repeated ids are worked out row by row. An array must fit in a task; `tiles` has the forms for those that do not.

A kernel or window of two sizes is for the (h, w) plane, and takes each slice of a volume alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame

from ..functions.kernels import drawn
from .geometry import sampled
from .layers import MOST_SCALE
from .regions import _dilated, _eroded, _opened, each_array

Sizes = tuple[int, int, int]


def erode(packed: DataFrame) -> DataFrame:
    """Least of the three-long minima along each axis."""
    return each_array(packed, _eroded)


def dilate(packed: DataFrame) -> DataFrame:
    """Maximum over the neighbourhood of three along every axis at once."""
    return each_array(packed, _dilated)


def opened(packed: DataFrame) -> DataFrame:
    return each_array(packed, _opened)


# ---- convolutions and pooling --------------------------------------------------------------------


def _sizes(value: int | Sequence[int], planar: bool) -> Sizes:
    """A size a spatial axis; along d it is 1 if only the plane is meant."""
    if isinstance(value, int):
        return (1 if planar else value, value, value)
    full = (1, *value) if len(value) == 2 else tuple(value)
    if len(full) != 3 or min(full) < 1:
        raise ValueError(f"not sizes: {value}")
    return full


def same_padding(n: int, width: int, stride: int) -> tuple[int, int, int]:
    """(places, before, after) so that places are n / stride, rounded up; an odd cell of padding is put behind."""
    places = -(-n // stride)
    total = max((places - 1) * stride + width - n, 0)
    return places, total // 2, total - total // 2


def centered_padding(sizes: Sequence[int], widths: Sequence[int]) -> list[tuple[int, int]]:
    """(before, after) an axis so that a 'valid' convolution of stride 2 keeps its middle, whether the size is odd or even."""
    return [(k // 2 - (1 - n % 2), k // 2) for n, k in zip(sizes, widths)]


def _windows(x: np.ndarray, widths: Sizes, strides: Sizes, dilation: Sizes, padding: str, edge: float) -> Callable[[Sequence[int]], np.ndarray]:
    """For a tap, the cells of x that it meets at every place, all at once."""
    if padding not in ("same", "valid"):
        raise ValueError(f"no such padding: {padding}")
    reach = [(k - 1) * r + 1 for k, r in zip(widths, dilation)]
    if padding == "same":
        plans = [same_padding(n, k, s) for n, k, s in zip(x.shape, reach, strides)]
    else:
        plans = [((n - k) // s + 1 if n >= k else 0, 0, 0) for n, k, s in zip(x.shape, reach, strides)]
    if any(p[0] < 1 for p in plans):
        raise ValueError("an array is smaller than the kernel")
    wide = np.pad(x, [*[p[1:] for p in plans], (0, 0)], constant_values=edge) if any(p[1] or p[2] for p in plans) else x

    def at(tap: Sequence[int]) -> np.ndarray:
        return wide[tuple(slice(t * r, t * r + (p[0] - 1) * s + 1, s) for t, r, p, s in zip(tap, dilation, plans, strides))]

    return at


def _kernel(kernel: object) -> tuple[np.ndarray, bool]:
    weights = np.asarray(kernel, dtype=float)
    if weights.ndim not in (4, 5):
        raise ValueError("a kernel is (h, w, in, out) or (d, h, w, in, out)")
    return (weights[None], True) if weights.ndim == 4 else (weights, False)


def _fits(x: np.ndarray, channels: int) -> None:
    if x.shape[-1] != channels:
        raise ValueError(f"{x.shape[-1]} channels for a kernel of {channels}")


def _convolved(x: np.ndarray, weights: np.ndarray, strides: Sizes, dilation: Sizes, padding: str, groups: int) -> np.ndarray:
    _fits(x, weights.shape[3] * groups)
    at = _windows(x, weights.shape[:3], strides, dilation, padding, 0.0)
    own, out = weights.shape[3], weights.shape[4] // groups
    parts = []
    for g in range(groups):
        total: np.ndarray | float = 0.0
        for tap in np.ndindex(*weights.shape[:3]):
            total = total + at(tap)[..., g * own : (g + 1) * own] @ weights[tap][:, g * out : (g + 1) * out]
        parts.append(total)
    return parts[0] if groups == 1 else np.concatenate(parts, -1)


def convolve(
    packed: DataFrame, kernel: list, stride: int | Sequence[int] = 1, dilation: int | Sequence[int] = 1, padding: str = "same",
    bias: Sequence[float] | None = None, groups: int = 1,
) -> DataFrame:
    """A convolution that mixes channels; kernel nested as (h, w, in, out) or (d, h, w, in, out).

    `same` pads with zeros to the size divided by stride, `valid` takes whole windows only. With groups, each part of the channels
    has outputs of its own, and `in` is a part's size.
    """
    weights, planar = _kernel(kernel)
    strides, spread = _sizes(stride, planar), _sizes(dilation, planar)
    if groups < 1 or weights.shape[4] % groups:
        raise ValueError("outputs are not a multiple of groups")
    more = np.zeros(weights.shape[4]) if bias is None else np.asarray(bias, dtype=float)
    return each_array(packed, lambda x: _convolved(x, weights, strides, spread, padding, groups) + more)


def convolve_transposed(packed: DataFrame, kernel: list, stride: int | Sequence[int] = 2) -> DataFrame:
    """Each voxel spread over its neighbourhood in an array `stride` times as large; the inverse shape of a `same` convolution."""
    weights, planar = _kernel(kernel)
    strides = _sizes(stride, planar)

    def kernel_of(x: np.ndarray) -> np.ndarray:
        _fits(x, weights.shape[3])
        sizes = [n * s for n, s in zip(x.shape, strides)]
        before = [max(k - s, 0) // 2 for k, s in zip(weights.shape, strides)]
        full = np.zeros((*[max((n - 1) * s + k, b + m) for n, s, k, b, m in zip(x.shape, strides, weights.shape, before, sizes)], weights.shape[4]))
        for tap in np.ndindex(*weights.shape[:3]):
            full[tuple(slice(t, t + (n - 1) * s + 1, s) for t, n, s in zip(tap, x.shape, strides))] += x @ weights[tap]
        return full[tuple(slice(b, b + m) for b, m in zip(before, sizes))]

    return each_array(packed, kernel_of)


def _deep(x: np.ndarray, weights: np.ndarray, strides: Sizes, dilation: Sizes, padding: str) -> np.ndarray:
    _fits(x, weights.shape[3])
    at = _windows(x, weights.shape[:3], strides, dilation, padding, 0.0)
    total: np.ndarray | float = 0.0
    for tap in np.ndindex(*weights.shape[:3]):
        total = total + at(tap)[..., None] * weights[tap]
    return total.reshape(*total.shape[:3], -1)


def depthwise(packed: DataFrame, kernel: list, stride: int | Sequence[int] = 1, dilation: int | Sequence[int] = 1, padding: str = "same") -> DataFrame:
    """Each channel alone; kernel nested as (h, w, in, times) or (d, h, w, in, times), a channel's outputs side by side."""
    weights, planar = _kernel(kernel)
    strides, spread = _sizes(stride, planar), _sizes(dilation, planar)
    return each_array(packed, lambda x: _deep(x, weights, strides, spread, padding))


def separable(
    packed: DataFrame, kernel: list, pointwise: list[list[float]], stride: int | Sequence[int] = 1, dilation: int | Sequence[int] = 1,
    padding: str = "same", bias: Sequence[float] | None = None,
) -> DataFrame:
    """A kernel on each channel alone, as `depthwise`, then a matrix over channels; one pass over the arrays."""
    weights, planar = _kernel(kernel)
    strides, spread = _sizes(stride, planar), _sizes(dilation, planar)
    matrix = np.asarray(pointwise, dtype=float)
    more = np.zeros(matrix.shape[1]) if bias is None else np.asarray(bias, dtype=float)
    if matrix.shape[0] != weights.shape[3] * weights.shape[4]:
        raise ValueError("the matrix does not fit the kernel's outputs")
    return each_array(packed, lambda x: _deep(x, weights, strides, spread, padding) @ matrix + more)


def _pooled(x: np.ndarray, kind: str, widths: Sizes, strides: Sizes, padding: str) -> np.ndarray:
    at = _windows(x, widths, strides, (1, 1, 1), padding, -np.inf if kind == "max" else 0.0)
    taps = list(np.ndindex(*widths))
    if kind == "max":
        return np.maximum.reduce([at(t) for t in taps])
    # padding counts for nothing in an average
    cells = _windows(np.ones((*x.shape[:3], 1)), widths, strides, (1, 1, 1), padding, 0.0)
    return sum(at(t) for t in taps) / sum(cells(t) for t in taps)


def pool(packed: DataFrame, kind: str = "max", size: int | Sequence[int] = 2, stride: int | Sequence[int] | None = None, padding: str = "valid", planar: bool = False) -> DataFrame:
    """The largest or mean value of each window, strides as long as windows unless given; planar leaves d as it is."""
    if kind not in ("max", "avg"):
        raise ValueError(f"no such pooling: {kind}")
    widths = _sizes(size, planar)
    strides = widths if stride is None else _sizes(stride, planar)
    return each_array(packed, lambda x: _pooled(x, kind, widths, strides, padding))


def global_pool(packed: DataFrame, kind: str = "avg") -> DataFrame:
    """One place: the largest or mean value of each channel."""
    fn = {"avg": np.mean, "max": np.max}[kind]
    return each_array(packed, lambda x: fn(x, axis=(0, 1, 2), keepdims=True))


def adaptive_pool(packed: DataFrame, kind: str, sizes: Sizes) -> DataFrame:
    """Pool (d, h, w) to sizes, whatever they were: window i of m is [floor(i n / m), ceil((i + 1) n / m)); 0 leaves an axis."""
    fn = {"avg": np.mean, "max": np.max}[kind]

    def kernel(x: np.ndarray) -> np.ndarray:
        for axis, m in enumerate(sizes):
            n = x.shape[axis]
            if m:
                x = np.stack([fn(np.take(x, range(i * n // m, -(-(i + 1) * n // m)), axis), axis=axis) for i in range(m)], axis)
        return x

    return each_array(packed, kernel)


# ---- attention within windows --------------------------------------------------------------------


def relative_bias(window: Sequence[int], table: list[list[float]], bounded: bool = False) -> np.ndarray:
    """(heads, places, places) from a table with a row for each relative place, the last axis fastest, and a column a head.

    Bounded, the table's values are taken through 16 * sigmoid, as for cosine scores.
    """
    values = np.asarray(table, dtype=float)
    if len(values) != math.prod(2 * n - 1 for n in window):
        raise ValueError("the table has a row for each relative place")
    place = np.stack(np.unravel_index(np.arange(math.prod(window)), window))
    row = np.zeros((place.shape[1],) * 2, dtype=int)
    for at, n in zip(place, window):
        row = row * (2 * n - 1) + at[:, None] - at[None, :] + n - 1
    values = 16 / (1 + np.exp(-values)) if bounded else values
    return values[row].transpose(2, 0, 1)


def _blocks(x: np.ndarray, window: Sizes) -> np.ndarray:
    """(windows, places, c) of an array whose sizes are multiples of the window's."""
    d, h, w, c = x.shape
    cut = x.reshape(d // window[0], window[0], h // window[1], window[1], w // window[2], window[2], c)
    return cut.transpose(0, 2, 4, 1, 3, 5, 6).reshape(-1, math.prod(window), c)


def _unblocked(blocks: np.ndarray, shape: Sequence[int], window: Sizes) -> np.ndarray:
    counts = [n // k for n, k in zip(shape, window)]
    return blocks.reshape(*counts, *window, -1).transpose(0, 3, 1, 4, 2, 5, 6).reshape(*shape[:3], -1)


def _regions(shape: Sequence[int], window: Sizes, shift: Sequence[int]) -> np.ndarray:
    """(windows, places): which cells were side by side before the array was rolled."""
    label = np.zeros((*shape[:3], 1), dtype=int)
    for axis, (n, k, s) in enumerate(zip(shape, window, shift)):
        part = np.zeros(n, dtype=int)
        if s:
            part[n - k :], part[n - s :] = 1, 2
        label = label * 3 + part.reshape([-1 if a == axis else 1 for a in range(4)])
    return _blocks(label, window)[..., 0]


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def window_attention(
    packed: DataFrame, window: Sequence[int], heads: int = 1, scale: float | Sequence[float] | None = None, shift: int | Sequence[int] = 0, bias: np.ndarray | None = None,
    cosine: bool = False, qkv: list[list[float]] | None = None, project: list[list[float]] | None = None, rolled: bool = True, masked: bool = True,
) -> DataFrame:
    """Self-attention within windows of an array, heads of equal shares of the channels: softmax(q k' * scale + bias + mask) v.

    Arrays are padded with zeros up to whole windows and cut back. With a shift, arrays are rolled back by it first and forth
    again after, and cells that lie together only because of that have a mask of -100; an axis no longer than its window isn't
    shifted. `rolled=False` leaves out the rolls, `masked=False` the mask. Scale is 1 / sqrt(channels a head) unless given.
    Cosine scores are of queries and keys of length one; scale then has the logarithm of a factor a head, MOST_SCALE at
    most. qkv (channels, three times as many) gives queries, keys and values, which are the cells themselves without it;
    project is applied to the result. Matrices and bias are parameters, as large as a window whatever the number of rows.
    """
    size = _sizes(tuple(window), len(window) == 2)
    moves = (0, *[shift] * 2) if isinstance(shift, int) and len(window) == 2 else (shift,) * 3 if isinstance(shift, int) else (0, *shift) if len(shift) == 2 else tuple(shift)
    if any(not 0 <= s < max(k, 1) for s, k in zip(moves, size)):
        raise ValueError("a shift is less than the window")
    into = None if qkv is None else np.asarray(qkv, dtype=float)
    out = None if project is None else np.asarray(project, dtype=float)
    if cosine:
        logs = np.atleast_1d(np.asarray(scale if scale is not None else math.log(10), dtype=float))
        factors = np.minimum(np.exp(logs), MOST_SCALE).reshape(-1, 1, 1)

    def kernel(x: np.ndarray) -> np.ndarray:
        c = x.shape[-1]
        if c % heads:
            raise ValueError("channels are not a multiple of heads")
        over = [-n % k for n, k in zip(x.shape, size)]
        y = np.pad(x, [*[(0, o) for o in over], (0, 0)]) if any(over) else x
        own = tuple(0 if n <= k else s for n, k, s in zip(y.shape, size, moves))
        moved = any(own)
        y = np.roll(y, [-s for s in own], (0, 1, 2)) if moved and rolled else y
        blocks = _blocks(y, size)
        parts = [blocks] * 3 if into is None else np.split(blocks @ into, 3, -1)
        q, k, v = (p.reshape(*p.shape[:2], heads, -1).transpose(0, 2, 1, 3) for p in parts)
        if cosine:
            q, k = (p / np.sqrt(np.maximum((p * p).sum(-1, keepdims=True), 1e-6)) for p in (q, k))
        scores = q @ k.swapaxes(-1, -2) * (factors if cosine else (c // heads) ** -0.5 if scale is None else scale)
        if bias is not None:
            scores = scores + bias
        if moved and masked:
            region = _regions(y.shape, size, own)
            scores = scores + np.where(region[:, :, None] == region[:, None, :], 0.0, -100.0)[:, None]
        said = (_softmax(scores) @ v).transpose(0, 2, 1, 3).reshape(*blocks.shape[:2], -1)
        z = _unblocked(said if out is None else said @ out, y.shape, size)
        z = np.roll(z, own, (0, 1, 2)) if moved and rolled else z
        return z[tuple(slice(0, n) for n in x.shape[:3])]

    return each_array(packed, kernel)


# ---- other grids ---------------------------------------------------------------------------------


def affine_resample(packed: DataFrame, matrix: Sequence[float], shape: Sizes, mode: str = "linear", fill: float = 0.0) -> DataFrame:
    """A new grid whose voxel (d, h, w) is read at matrix * (d, h, w, 1); outside is fill. A slab of places is held at a time.

    Nearest rounds half to even. Linear mixes the fill into voxels at the border.
    """
    if mode not in ("nearest", "linear"):
        raise ValueError(f"no such mode: {mode}")
    m = np.asarray(matrix, dtype=float).reshape(-1, 4)[:3]
    h, w = np.meshgrid(np.arange(shape[1]), np.arange(shape[2]), indexing="ij")

    def kernel(x: np.ndarray) -> np.ndarray:
        out = np.empty((*shape, x.shape[3]))
        for d in range(shape[0]):
            out[d] = sampled(x, np.stack([r[0] * d + r[1] * h + r[2] * w + r[3] for r in m]), mode, fill)
        return out

    return each_array(packed, kernel)


def random_rotate(packed: DataFrame, seed: int, factor: float, prob: float = 0.8, fill: float = 0.0, mode: str = "nearest") -> DataFrame:
    """Rotation of the (h, w) plane about the middle by an angle in [-factor, factor] radians, drawn by seed and id."""
    if not 0 <= prob <= 1:
        raise ValueError("prob must be in [0, 1]")
    if mode not in ("nearest", "linear"):
        raise ValueError(f"no such mode: {mode}")

    def kernel(x: np.ndarray, sample: int) -> np.ndarray:
        if drawn(seed, sample, 0) >= prob:
            return x
        angle = (drawn(seed, sample, 1) * 2 - 1) * factor
        _, h, w, _ = x.shape
        row, column = np.meshgrid(np.arange(h) - h / 2, np.arange(w) - w / 2, indexing="ij")
        down, across = np.sin(angle) * column + np.cos(angle) * row + h / 2, np.cos(angle) * column - np.sin(angle) * row + w / 2
        return np.stack([sampled(x, np.stack([np.full_like(down, d), down, across]), mode, fill) for d in range(len(x))])

    return each_array(packed, kernel, with_id=True)
