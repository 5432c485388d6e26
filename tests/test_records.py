"""Steps of records: kernels against plain loops, odd rows, traces."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxweave.functions import kernels as K
from voxweave.operators import geometry
from voxweave.plans import records as R

STRUCT = "struct<shape: array<int>, data: array<double>>"


def test_draws_are_those_of_columns(spark):
    from voxweave.functions.scalars import uniform

    row = spark.range(1).select(uniform(7, F.lit(12), F.lit("size"), 3).alias("u")).first()
    assert row.u == K.drawn(7, 12, "size", 3)


def test_resize_formula():
    """Half-pixel centres with clamped borders, and the nearest on a grid between corners."""
    x = np.arange(4.0).reshape(4, 1, 1, 1)
    assert K.resized(x, (2, 1, 1), "linear").ravel().tolist() == [0.5, 2.5]
    assert K.resized(x, (8, 1, 1), "linear").ravel().tolist() == [0, 0.25, 0.75, 1.25, 1.75, 2.25, 2.75, 3]
    assert K.resized(x, (3, 1, 1), "nearest").ravel().tolist() == [0, 2, 3]
    assert K.resized(x, (1, 1, 1), "nearest").ravel().tolist() == [0]


def test_spacing_without_affine_and_back(spark):
    rows = [(1, ([4, 2, 2, 1], [float(i) for i in range(16)]), None), (2, None, [float(x) for x in (2, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)])]
    df = spark.createDataFrame(rows, f"sample_id long, image {STRUCT}, affine array<double>")
    p = R.Pipeline(R.Spacing("image", pixdim=(2.0, 1.0, 1.0)))
    out = {r.sample_id: r for r in p(df).collect()}
    assert out[1].image.shape == [2, 2, 2, 1] and out[1].affine is None and out[2].image is None
    back = {r.sample_id: r for r in p.inverse(p(df)).collect()}
    assert back[1].image.shape == [4, 2, 2, 1] and back[1].trace == [] and back[2].affine == rows[1][2]
    for bad in ((0.0, 1, 1), (1.0, 1)):
        with pytest.raises(ValueError):
            R.Spacing("image", pixdim=bad)
        with pytest.raises(ValueError):
            geometry.respace(df, bad)


def test_rotation_against_loops():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2, 5, 7, 2))
    for angle in (0.0, 0.3, -1.1):
        for mode in ("linear", "nearest"):
            got = K.rotated(x, angle, mode, -2.0)
            for i in range(5):
                for j in range(7):
                    u = np.cos(angle) * (j - 3.5) + np.sin(angle) * (i - 2.5) + 3.5
                    t = -np.sin(angle) * (j - 3.5) + np.cos(angle) * (i - 2.5) + 2.5
                    at = lambda a, b: x[:, a, b] if 0 <= a < 5 and 0 <= b < 7 else np.full((2, 2), -2.0)  # noqa: B023, E731
                    if mode == "nearest":
                        want = at(int(np.floor(t + 0.5)), int(np.floor(u + 0.5)))
                    else:
                        a, b = int(np.floor(t)), int(np.floor(u))
                        want = (1 - t + a) * ((1 - u + b) * at(a, b) + (u - b) * at(a, b + 1)) + (t - a) * ((1 - u + b) * at(a + 1, b) + (u - b) * at(a + 1, b + 1))
                    assert np.allclose(got[:, i, j], want)


def test_inscribed_rectangle_has_no_fill():
    """Its corners, turned back, lie within the plane, for wide and tall planes."""
    for h, w in ((40, 40), (40, 90), (90, 40)):
        for angle in (0.05, 0.3, -0.4):
            tall, wide = K.inscribed(h, w, angle)
            for sy in (-1, 1):
                for sx in (-1, 1):
                    y, x = sy * tall / 2, sx * wide / 2
                    u, t = np.cos(angle) * x + np.sin(angle) * y, -np.sin(angle) * x + np.cos(angle) * y
                    assert abs(u) <= w / 2 + 1e-9 and abs(t) <= h / 2 + 1e-9
    x = np.ones((1, 200, 450, 1))  # the margin of 2 % is more than a voxel
    out = K.cropped_to_inscribed(K.rotated(x, 0.3, "linear", -5.0), 0.3, "linear")
    assert out.shape == x.shape and np.allclose(out, 1)


def test_summed_area():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (4, 5, 6))
    table = K.summed_area(x)
    for _ in range(50):
        start = [int(rng.integers(0, n)) for n in x.shape]
        size = [int(rng.integers(1, n - s + 1)) for s, n in zip(start, x.shape)]
        assert K.box_sum(table, start, size) == x[tuple(slice(s, s + n) for s, n in zip(start, size))].sum()


def test_labelled_crops():
    """A box with labels enough stays; without any, centers are anywhere; the last attempt is not looked at again."""
    label = np.zeros((10, 10, 1))
    label[8:, 8:] = 1
    tried = []

    def anywhere(k):
        tried.append(k)
        return [5, 5]

    start = K.label_aware_start(label, (2, 2), 0, 0.25, 3, anywhere, lambda *p: 0.99)
    assert start == [8, 8] and not tried
    start = K.label_aware_start(label, (4, 4), 0, 0.9, 3, anywhere, lambda *p: 0.0)
    assert start == [3, 3] and tried == [1, 2, 3]
    tried.clear()
    assert K.label_aware_start(np.zeros((10, 10, 1)), (4, 4), 0, 0, 1, anywhere, lambda *p: 0.0) == [3, 3] and tried == [0]


def test_crop_by_label(spark):
    """Labels, references and sizes that leave nothing to choose from."""
    image, label = np.arange(12.0).reshape(3, 4, 1), np.zeros((3, 4, 2))
    label[2, 1, 1] = 1
    row = (5, (list(image.shape), image.ravel().tolist()), (list(label.shape), label.ravel().tolist()))
    df = spark.createDataFrame([row], f"sample_id long, image {STRUCT}, label {STRUCT}")
    cut = lambda **how: R.Pipeline(R.RandomCropByLabel(("image", "label"), **how))(df).first()
    assert cut(size=(1, 1), positive=1, negative=0).image.data == [9.0]
    assert cut(size=(1, 1), positive=0, negative=1, reference="image", threshold=10.5).image.data == [11.0]
    assert cut(size=(9, 2), positive=1, negative=0).image.shape == [3, 2, 1]
    assert cut(size=(1, 1), positive=0, negative=1, reference="image", threshold=99).image.shape == [1, 1, 1]
    p = R.Pipeline(R.RandomCropByLabel(("image", "label"), size=(2, 2), seed=4))
    back = p.inverse(p(df)).first()
    assert back.image.shape == [3, 4, 1] and back.trace == [] and sum(x != 0 for x in back.image.data) in (3, 4)
    for bad in ({"positive": 0, "negative": 0}, {"positive": -1}):
        with pytest.raises(ValueError):
            R.RandomCropByLabel(("image", "label"), **bad)


def test_foreground_bounds():
    mask = np.zeros((6, 7), bool)
    mask[2:4, 5] = True
    assert K.foreground_bounds(mask, [0, 0], [1, 1], True) == ([2, 5], [4, 6])
    assert K.foreground_bounds(mask, [1, 3], [4, 2], True) == ([1, 2], [5, 7])
    assert K.foreground_bounds(mask * False, [0, 0], [4, 4], True) == ([0, 0], [6, 7])
    assert K.foreground_bounds(mask, [0, 5], [1, 1], False) == ([2, 0], [4, 7])


def test_repeated_steps_and_last_in_first_out(spark):
    """Steps of one name undo their own runs; what can't be undone stays in the trace."""
    df = spark.createDataFrame([(k, ([3, 4, 1], [float(i) for i in range(12)])) for k in range(6)], f"sample_id long, image {STRUCT}")
    p = R.Pipeline(R.Shift("image", seed=1, prob=0.5, low=0.0, high=1.0), R.Apply("image", fn=np.abs, label="abs"), R.RandomSpatialCrop("image", seed=2, size=2), R.Flip("image", axes=(0, 1)), R.Shift("image", seed=3, prob=0.5, low=5.0))
    out = p(df).collect()
    assert {len(r.trace) for r in out} == {5} and {t.applied for r in out for t in r.trace} == {True, False}
    for r in p.inverse(p(df)).collect():
        assert [t.name for t in r.trace] == ["Apply"] and not r.trace[0].invertible
        # four cells come back; the others were cut off, and hold the pad less the offset
        kept = np.isclose(r.image.data, np.arange(12.0))
        assert r.image.shape == [3, 4, 1] and kept.sum() >= 4 and len({round(x, 9) for x in np.array(r.image.data)[~kept]}) == 1
    names = [json.loads(t.params)["keys"] for t in out[0].trace]
    assert names == [["image"]] * 5


def test_missing_keys_and_checks(spark):
    df = spark.createDataFrame([(1, ([2, 2, 1], [1.0, 2.0, 3.0, 4.0]))], f"sample_id long, image {STRUCT}")
    assert R.Pipeline(R.Flip(("image", "label"), allow_missing=True))(df).first().image.data == [3, 4, 1, 2]
    with pytest.raises(Exception, match="label"):
        R.Pipeline(R.Flip(("image", "label")))(df).collect()
    for bad in (lambda: R.RandomSpatialCrop("x", ratio=0.5), lambda: R.RandomSpatialCrop("x", attempts=0), lambda: R.RandomRotate("x", factor=-1), lambda: R.CropForeground(("a", "b")), lambda: R.RandomChoice(steps=[R.Flip("x")], choices=2), lambda: R.Flip("x", prob=2)):
        with pytest.raises(ValueError):
            bad()
    assert R.Pipeline(R.Flip("image"))(df.limit(0)).collect() == []


def test_held_rows_are_given_back(spark, monkeypatch):
    """Small batches of results keep every row, in order, with other columns."""
    rows = [(k, ([2, 1, 1], [float(k), 1.0]) if k % 5 else None, f"name {k}") for k in range(50)]
    df = spark.createDataFrame(rows, f"sample_id long, image {STRUCT}, name string").coalesce(1)
    monkeypatch.setattr(R, "HELD", 64)
    out = R.Pipeline(R.Shift("image", low=1.0))(df).collect()
    assert [(r.sample_id, r.name) for r in out] == [(r[0], r[2]) for r in rows]
    assert all((r.image is None) == (r.sample_id % 5 == 0) and (r.image is None or r.image.data[0] == r.sample_id + 1) for r in out)


def test_resample_many(spark):
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((3, 4, 5, 2)), rng.integers(0, 3, (3, 4, 5, 1)).astype(float)
    a = np.eye(4)
    a[:3, :3] = [[0.9, 0.1, 0], [0, 1.1, 0.2], [0.1, 0, 1]]
    to = np.eye(4)
    row = (1, (list(x.shape), x.ravel().tolist()), (list(y.shape), y.ravel().tolist()), a.ravel().tolist(), to.ravel().tolist())
    df = spark.createDataFrame([row], f"sample_id long, image {STRUCT}, label {STRUCT}, affine array<double>, to_affine array<double>")
    out = R.resample_many(df, {"image": "linear", "label": "nearest"}, (4, 4, 4), fill=-1.0).first()
    one = spark.createDataFrame([(1, row[1][0], row[1][1], row[3], row[4])], "sample_id long, shape array<int>, data array<double>, affine array<double>, to_affine array<double>")
    assert np.allclose(out.image.data, geometry.resample(one, (4, 4, 4), fill=-1.0).first().data)
    assert set(out.label.data) <= {-1.0, 0.0, 1.0, 2.0} and out.affine == row[4]
