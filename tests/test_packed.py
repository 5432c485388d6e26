"""Operators on packed arrays against slow loops and the long forms; arrays of several shapes, nulls and empty tables."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from voxweave.operators import augment, morphology, packed, regions, spatial
from voxweave.voxels import pack, unpack

RNG = np.random.default_rng(11)
ARRAYS = [RNG.standard_normal(s) for s in ((1, 5, 6, 2), (3, 4, 5, 2), (2, 7, 3, 2), (4, 4, 4, 2))]


def table(spark, arrays):
    rows = [(i, None if a is None else list(a.shape), None if a is None else [float(x) for x in a.ravel()]) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "sample_id long, shape array<int>, data array<double>")


def back(rows):
    return [None if r["data"] is None else np.array(r["data"]).reshape(r["shape"]) for r in rows.orderBy("sample_id").collect()]


def slow_convolution(x, kernel, stride, dilation, padding):
    """One output cell, one tap and one pair of channels at a time."""
    reach = [(k - 1) * r + 1 for k, r in zip(kernel.shape, dilation)]
    if padding == "same":
        sizes = [-(-n // s) for n, s in zip(x.shape, stride)]
        before = [max((m - 1) * s + k - n, 0) // 2 for m, s, k, n in zip(sizes, stride, reach, x.shape)]
    else:
        sizes, before = [(n - k) // s + 1 for n, k, s in zip(x.shape, reach, stride)], [0, 0, 0]
    out = np.zeros((*sizes, kernel.shape[4]))
    for place in np.ndindex(*sizes):
        for tap in np.ndindex(*kernel.shape[:3]):
            at = [p * s + t * r - b for p, s, t, r, b in zip(place, stride, tap, dilation, before)]
            if all(0 <= a < n for a, n in zip(at, x.shape)):
                for i, o in np.ndindex(*kernel.shape[3:]):
                    out[place][o] += x[tuple(at)][i] * kernel[tap][i, o]
    return out


@pytest.mark.parametrize(
    ("widths", "stride", "dilation", "padding"),
    [((3, 3, 3), 1, 1, "same"), ((1, 2, 3), (1, 2, 2), 1, "same"), ((1, 3, 2), 1, (1, 2, 2), "same"), ((1, 2, 3), (1, 1, 3), 1, "valid"), ((2, 4, 5), 2, 1, "same")],
)
def test_convolutions(spark, widths, stride, dilation, padding):
    kernel = RNG.standard_normal((*widths, 2, 3))
    strides, spread = (s if isinstance(s, tuple) else (s, s, s) for s in (stride, dilation))
    got = back(packed.convolve(table(spark, ARRAYS), kernel.tolist(), stride, dilation, padding, [1.0, 2.0, 3.0]))
    for x, y in zip(ARRAYS, got):
        assert np.allclose(y, slow_convolution(x, kernel, strides, spread, padding) + [1, 2, 3])
    # each channel alone is a kernel with zeros between channels
    deep = RNG.standard_normal((*widths, 2, 2))
    full = np.zeros((*widths, 2, 4))
    for c, m in np.ndindex(2, 2):
        full[..., c, c * 2 + m] = deep[..., c, m]
    want = [slow_convolution(x, full, strides, spread, padding) for x in ARRAYS]
    assert all(np.allclose(a, b) for a, b in zip(back(packed.depthwise(table(spark, ARRAYS), deep.tolist(), stride, dilation, padding)), want))
    point = RNG.standard_normal((4, 2))
    assert all(np.allclose(a, b @ point) for a, b in zip(back(packed.separable(table(spark, ARRAYS), deep.tolist(), point.tolist(), stride, dilation, padding)), want))
    # groups are such a kernel too
    grouped = RNG.standard_normal((*widths, 1, 4))
    full = np.zeros((*widths, 2, 4))
    full[..., :1, :2], full[..., 1:, 2:] = grouped[..., :2], grouped[..., 2:]
    want = [slow_convolution(x, full, strides, spread, padding) for x in ARRAYS]
    assert all(np.allclose(a, b) for a, b in zip(back(packed.convolve(table(spark, ARRAYS), grouped.tolist(), stride, dilation, padding, groups=2)), want))


@pytest.mark.parametrize(("widths", "stride"), [((2, 2, 2), 2), ((3, 4, 1), (2, 3, 2)), ((3, 3, 3), 1)])
def test_transposed_convolution(spark, widths, stride):
    kernel = RNG.standard_normal((*widths, 2, 3))
    strides = stride if isinstance(stride, tuple) else (stride,) * 3
    for x, y in zip(ARRAYS, back(packed.convolve_transposed(table(spark, ARRAYS), kernel.tolist(), stride))):
        want = np.zeros((*[n * s for n, s in zip(x.shape, strides)], 3))
        for place, tap in itertools.product(np.ndindex(*x.shape[:3]), np.ndindex(*widths)):
            at = tuple(p * s + t - max(k - s, 0) // 2 for p, s, t, k in zip(place, strides, tap, widths))
            if all(0 <= a < n for a, n in zip(at, want.shape)):
                want[at] += x[place] @ kernel[tap]
        assert np.allclose(y, want)


def test_long_forms_agree(spark):
    x = ARRAYS[0]
    vox, rows = unpack(table(spark, [x]), x.shape), table(spark, [x])
    kernel = RNG.standard_normal((3, 3, 2, 3)).tolist()
    matrix = (0.9, 0.2, 0.0, -0.3, -0.1, 0.8, 0.1, 0.4, 0.0, 0.1, 1.1, -0.2)
    for long, short in (
        (morphology.convolve_channels(vox, kernel, 2), packed.convolve(rows, kernel, 2)),
        (morphology.convolve_channels(vox, kernel, 2, True), packed.convolve_transposed(rows, kernel, 2)),
        (morphology.opened(vox), packed.opened(rows)),
        (morphology.adaptive_pool(vox, "avg", h=3, w=4), packed.adaptive_pool(rows, "avg", (0, 3, 4))),
        (spatial.affine_resample(vox, matrix, (2, 4, 3), "linear", -2.0), packed.affine_resample(rows, matrix, (2, 4, 3), "linear", -2.0)),
        (augment.random_rotate(vox, 3, 0.7, 1.0), packed.random_rotate(rows, 3, 0.7, 1.0)),
    ):
        assert np.allclose(back(pack(long))[0], back(short)[0])


@pytest.mark.parametrize("kind", ["max", "avg"])
@pytest.mark.parametrize(("size", "stride", "padding"), [(2, None, "valid"), ((1, 3, 2), 1, "same"), (3, (1, 2, 2), "same")])
def test_pooling(spark, kind, size, stride, padding):
    arrays = [a for a in ARRAYS if len(a) > 1]
    widths = (size,) * 3 if isinstance(size, int) else size
    strides = widths if stride is None else (stride,) * 3 if isinstance(stride, int) else stride
    fn = {"max": np.max, "avg": np.mean}[kind]
    for x, y in zip(arrays, back(packed.pool(table(spark, arrays), kind, size, stride, padding))):
        for place in np.ndindex(*y.shape[:3]):
            start = [p * s - (packed.same_padding(n, k, s)[1] if padding == "same" else 0) for p, s, n, k in zip(place, strides, x.shape, widths)]
            window = x[tuple(slice(max(a, 0), a + k) for a, k in zip(start, widths))]
            assert np.allclose(y[place], fn(window, axis=(0, 1, 2)))
    assert all(np.allclose(y.ravel(), fn(x, axis=(0, 1, 2))) for x, y in zip(arrays, back(packed.global_pool(table(spark, arrays), kind))))


def slow_attention(x, window, heads, shift):
    """Cell by cell: the same window after the roll, and not apart before it."""
    sizes = [n + -n % k for n, k in zip(x.shape, window)]
    moves = [0 if n <= k else s for n, k, s in zip(sizes, window, shift)]
    wide = np.zeros((*sizes, x.shape[3]))
    wide[tuple(slice(0, n) for n in x.shape[:3])] = x
    at = lambda p: [(a - s) % n for a, s, n in zip(p, moves, sizes)]
    win = lambda p: [a // k for a, k in zip(at(p), window)]
    # rolled past the border, within the last window
    wrapped = lambda p: [s and a >= n - s for a, n, s in zip(at(p), sizes, moves)]
    out, per = np.zeros_like(wide), x.shape[3] // heads
    for p in np.ndindex(*sizes):
        near = [q for q in np.ndindex(*sizes) if win(q) == win(p)]
        for h in range(heads):
            cut = slice(h * per, (h + 1) * per)
            scores = np.array([wide[p][cut] @ wide[q][cut] / np.sqrt(per) + (0 if wrapped(q) == wrapped(p) else -100) for q in near])
            e = np.exp(scores - scores.max())
            out[p][cut] = e / e.sum() @ np.array([wide[q][cut] for q in near])
    return out[tuple(slice(0, n) for n in x.shape[:3])]


@pytest.mark.parametrize("shift", [(0, 0, 0), (1, 1, 2), (0, 2, 1)])
def test_window_attention(spark, shift):
    for x, y in zip(ARRAYS, back(packed.window_attention(table(spark, ARRAYS), (2, 3, 3), 2, shift=shift))):
        assert np.allclose(y, slow_attention(x, (2, 3, 3), 2, shift))


def test_projected_attention(spark):
    qkv, out = RNG.standard_normal((2, 6)), RNG.standard_normal((2, 2))
    x = ARRAYS[3]
    got = back(packed.window_attention(table(spark, [x]), (4, 4, 4), 1, 0.5, qkv=qkv.tolist(), project=out.tolist()))[0]
    q, k, v = np.split(x.reshape(-1, 2) @ qkv, 3, 1)
    e = np.exp(q @ k.T * 0.5)
    assert np.allclose(got.reshape(-1, 2), e / e.sum(1, keepdims=True) @ v @ out)
    bias = packed.relative_bias((2, 3, 2), [[float(i)] for i in range(3 * 5 * 3)])
    places = list(np.ndindex(2, 3, 2))
    for (i, p), (j, q) in itertools.product(enumerate(places), repeat=2):
        assert bias[0, i, j] == ((p[0] - q[0] + 1) * 5 + p[1] - q[1] + 2) * 3 + p[2] - q[2] + 1


def test_nulls_empty_tables_and_refusals(spark):
    kernel = np.ones((1, 1, 2, 1)).tolist()
    rows = table(spark, [None, ARRAYS[0], ARRAYS[0]]).selectExpr("sample_id", "shape", "data", "'x' as v", "1 as c")
    got = back(packed.convolve(rows.unionByName(rows.where("sample_id = 1")), kernel))
    assert got[0] is None and len(got) == 4 and all(np.allclose(y[..., 0], ARRAYS[0].sum(-1)) for y in got[1:])
    assert packed.convolve(rows.limit(0), kernel).count() == 0
    no_id = rows.selectExpr("cast(null as long) as sample_id", "shape", "data").where("data is not null")
    assert packed.random_rotate(no_id, 1, 0.5).count() == 2
    assert packed.centered_padding((8, 7), (3, 3)) == [(0, 1), (1, 1)]
    for bad in (
        lambda: packed.convolve(rows, [[1.0]]),
        lambda: packed.convolve(rows, kernel, groups=2),
        lambda: packed.pool(rows, "sum"),
        lambda: packed.window_attention(rows, (2, 2), shift=2),
        lambda: packed.relative_bias((2, 2), [[0.0]]),
        lambda: packed.separable(rows, kernel, [[1.0]]),
    ):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="channels"):
        packed.convolve(table(spark, [RNG.standard_normal((1, 2, 2, 3))]), kernel).collect()


def test_skeletons_of_stacks(spark):
    """Arrays of several shapes, constant ones, infinite cells and nulls in one table: each as if alone, many in one call."""
    rng = np.random.default_rng(4)
    arrays = [rng.random(s) for s in ((1, 5, 6, 2), (3, 4, 5, 1), (1, 5, 6, 2), (1, 1, 1, 1))] + [np.ones((1, 5, 6, 2)), None]
    arrays[0][0, 2, 2, 0] = np.inf

    def alone(x):
        opened = lambda y: regions._dilated(regions._eroded(y))
        out = np.maximum(x - opened(x), 0)
        for _ in range(50):
            before, x = x, regions._eroded(x)
            if (x == before).all():
                break
            lost = np.maximum(x - opened(x), 0)
            out = out + np.maximum(lost - out * lost, 0)
        return out

    rows = [(k, None if x is None else list(x.shape), None if x is None else x.ravel().tolist()) for k, x in enumerate(arrays)]
    got = {r.sample_id: r for r in regions.skeleton(spark.createDataFrame(rows, regions.PACKED).repartition(2)).collect()}
    assert len(got) == len(arrays) and got[5].data is None
    assert all(np.array_equal(np.array(got[k].data).reshape(x.shape), alone(x), equal_nan=True) for k, x in enumerate(arrays) if x is not None)
    calls, stack = [], np.stack([arrays[2]] * 300)
    before = regions._eroded
    try:
        regions._eroded = lambda x: calls.append(1) or before(x)
        assert np.array_equal(regions._skeletons(stack, 50)[7], alone(arrays[2]), equal_nan=True)
    finally:
        regions._eroded = before
    assert len(calls) < 300


def test_attention_queries_shuffle_nothing(spark, sf):
    """Bias and cosine scores on packed arrays: no exchange, and the values of the form with a row a voxel."""
    import __spark_entry__
    from voxweave.operators import layers, windows
    from voxweave.queries import load
    from voxweave.record_queries import _PLACES

    queries = __spark_entry__.queries()
    for name, scale, cosine in (("attention_bias", 0.5, False), ("attention_cosine", [1.5, 9.0], True)):
        df = queries[name](spark, sf)
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        long = layers.window_attention(windows.window_partition(load(spark, sf, "mc"), h=2, w=2), scale, 2, bias=layers.relative_bias(spark, (2, 2), _PLACES, cosine), cosine=cosine)
        want = {(r.sample_id, r.win, r.pos, r.c): r.v for r in long.where("sample_id < 5").collect()}
        got = {(r.sample_id, r.win, r.pos, r.c): r.v for r in df.where("sample_id < 5").collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-5 for k in want)
