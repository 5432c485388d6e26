"""Centerline losses of packed arrays against loops over single planes and volumes."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from voxweave.operators.regions import centerline_loss

SCHEMA = "sample_id long, shape array<int>, y_true array<double>, y_pred array<double>"


def around(x, place, fn, cross):
    """fn over a place's neighbours: along the axes only, or the whole box."""
    axes = [k for k in range(x.ndim) if x.shape[k] > 1 or k > 0]
    near = []
    for step in itertools.product((-1, 0, 1), repeat=len(axes)):
        at = list(place)
        for k, n in zip(axes, step):
            at[k] += n
        inside = all(0 <= a < n for a, n in zip(at, x.shape))
        if inside and (not cross or sum(map(abs, step)) <= 1):
            near.append(x[tuple(at)])
    return fn(near)


def moved(x, fn, cross):
    out = np.zeros_like(x)
    for place in np.ndindex(x.shape):
        out[place] = around(x, place, fn, cross)
    return out


def thinned(x, n):
    gone = lambda x: np.maximum(x - moved(moved(x, min, True), max, False), 0)
    out = gone(x)
    for _ in range(n):
        x = moved(x, min, True)
        out = out + np.maximum(gone(x) - out * gone(x), 0)
    return out


def plain(true, pred, n, e):
    st, sp = thinned(true, n), thinned(pred, n)
    p, r = ((sp * true).sum() + e) / (sp.sum() + e), ((st * pred).sum() + e) / (st.sum() + e)
    return 1 - 2 * p * r / (p + r + e)


def losses(spark, rows, *args, **kw):
    return [(r.sample_id, r["class"], r.loss) for r in centerline_loss(spark.createDataFrame(rows, SCHEMA).coalesce(1), *args, **kw).collect()]


@pytest.mark.parametrize("shape", [(3, 4, 5), (1, 6, 5)])
@pytest.mark.parametrize("e", [1e-7, 0.01])
def test_sparse_with_ignored_and_targets(spark, shape, e):
    rng = np.random.default_rng(4)
    ids, raw = rng.integers(-1, 4, shape), rng.standard_normal((*shape, 3))
    got = losses(spark, [(7, [*shape, 3], ids.ravel().astype(float).tolist(), raw.ravel().tolist())], "sparse", 3, 3, True, [2, 0], [1], e)
    p = np.exp(raw) / np.exp(raw).sum(-1, keepdims=True)
    on = ids != 1
    assert [g[:2] for g in got] == [(7, 2), (7, 0)]
    for _, k, loss in got:
        assert loss == pytest.approx(plain((ids == k) * on * 1.0, np.clip(p[..., k], e, 1 - e) * on, 3, e), abs=1e-9)


def test_categorical_equals_sparse_and_binary(spark):
    rng = np.random.default_rng(5)
    ids, pred = rng.integers(0, 2, (2, 4, 4)), rng.random((2, 4, 4, 2))
    hot = np.stack([ids == 0, ids == 1], -1).astype(float)
    shape, flat = [2, 4, 4, 2], pred.ravel().tolist()
    a = losses(spark, [(1, shape, ids.ravel().astype(float).tolist(), flat)], "sparse", 2, 4)
    assert a == losses(spark, [(1, shape, hot.ravel().tolist(), flat)], "categorical", 2, 4)
    assert a[1][2] == losses(spark, [(1, [2, 4, 4, 1], ids.ravel().astype(float).tolist(), pred[..., 1].ravel().tolist())], "binary", 1, 4)[0][2]


def test_nulls_repeats_shapes_and_none(spark):
    one, big = [0.0, 1.0, 1.0, 0.0], [1.0] * 9
    rows = [(1, [1, 2, 2, 1], one, one), (1, [1, 2, 2, 1], one, one), (2, [1, 3, 3, 1], big, big), (3, None, None, None), (None, [1, 2, 2, 1], one, None)]
    got = losses(spark, rows, iterations=2)
    assert [g[0] for g in got] == [1, 1, 2, 3, None] and [g[2] is None for g in got] == [False, False, False, True, True]
    assert got[0] == got[1]
    assert losses(spark, []) == []


@pytest.mark.parametrize("bad", [dict(kind="other"), dict(classes=2), dict(kind="categorical", classes=2, ignored=[1]), dict(kind="sparse", classes=2, targets=[2])])
def test_checks(spark, bad):
    with pytest.raises(ValueError):
        centerline_loss(spark.createDataFrame([], SCHEMA), **bad)
