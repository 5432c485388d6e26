"""Tiles, attention in blocks and exact batches, against whole arrays in NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from voxweave.operators import attention as A
from voxweave.operators import tiles as T
from voxweave.sources import readers, tables

PACKED = "sample_id long, shape array<int>, data array<double>"


def packed(spark, arrays):
    rows = [(k, None if x is None else list(x.shape), None if x is None else x.ravel().tolist()) for k, x in arrays.items()]
    return spark.createDataFrame(rows, PACKED).repartition(2)


def unpacked(df):
    return {r.sample_id: np.array(r.data).reshape(r.shape) for r in df.collect()}


def same_convolution(x, kernel, dilation):
    """Loops over voxels; zeros beyond the border."""
    out = np.zeros((*x.shape[:3], kernel.shape[4]))
    for at in np.ndindex(*x.shape[:3]):
        for tap in np.ndindex(*kernel.shape[:3]):
            i = [a + (t - n // 2) * dilation for a, t, n in zip(at, tap, kernel.shape)]
            if all(0 <= a < n for a, n in zip(i, x.shape)):
                out[at] += x[tuple(i)] @ kernel[tap]
    return out


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(6)
    return {1: rng.standard_normal((5, 7, 4, 2)), 2: rng.standard_normal((1, 6, 6, 2)), 3: rng.standard_normal((3, 1, 9, 2)), 4: None}


def test_tiles_of_several_shapes(spark, arrays):
    rng = np.random.default_rng(7)
    cut = T.cut(packed(spark, arrays), (2, 3, 4))
    back = unpacked(T.joined(cut))
    assert set(back) == {1, 2, 3} and all(np.array_equal(back[k], arrays[k]) for k in back)
    for shape, dilation in (((3, 3, 3), 1), ((3, 3, 3), 3), ((1, 5, 3), 2)):
        kernel = rng.standard_normal((*shape, 2, 3))
        got = unpacked(T.joined(T.convolution(cut, (2, 3, 4), kernel, dilation)))
        assert all(np.allclose(got[k], same_convolution(arrays[k], kernel, dilation)) for k in back)
    each, mix = rng.standard_normal((3, 3, 3, 2)), rng.standard_normal((2, 4))
    got = unpacked(T.joined(T.convolution(cut, (2, 3, 4), each, 2, mix)))
    full = each[..., None] * np.eye(2)
    assert all(np.allclose(got[k], same_convolution(arrays[k], full, 2) @ mix) for k in back)
    with pytest.raises(ValueError):
        T.convolution(cut, (2, 3, 4), np.zeros((2, 3, 3, 2, 1)))


def test_pyramid(spark, arrays):
    rng = np.random.default_rng(8)
    point, pooled, projection = rng.standard_normal((2, 3)), rng.standard_normal((2, 3)), rng.standard_normal((12, 3))
    one, two, mix = rng.standard_normal((3, 3, 3, 2, 3)), rng.standard_normal((3, 3, 3, 2)), rng.standard_normal((2, 3))
    norms = [(rng.standard_normal(3), rng.random(3) + 0.5, rng.standard_normal(3), rng.standard_normal(3)) for _ in range(5)]
    got = unpacked(T.joined(T.pyramid(T.cut(packed(spark, arrays), (2, 3, 4)), (2, 3, 4), point, [(1, one, None), (2, two, mix)], pooled, projection, norms)))
    for k in (1, 2, 3):
        x = arrays[k]
        act = lambda y, n: np.maximum((y - n[0]) / np.sqrt(n[1] + 1e-3) * n[2] + n[3], 0)
        parts = [act(x @ point, norms[0]), act(same_convolution(x, one, 1), norms[1]), act(same_convolution(x, two[..., None] * np.eye(2), 2) @ mix, norms[2])]
        parts.append(np.broadcast_to(act(x.mean(axis=(0, 1, 2)) @ pooled, norms[3]), parts[0].shape))
        assert np.allclose(got[k], act(np.concatenate(parts, -1) @ projection, norms[4]))


def softmax(x):
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def test_cross_attention_in_blocks(spark):
    """The same for every block size, masks and a fully masked query included."""
    rng = np.random.default_rng(9)
    heads, e = 2, 4
    keys = {1: rng.standard_normal((7, e)) * 3, 2: rng.standard_normal((5, e))}
    layers = [(rng.standard_normal((e, e)), rng.standard_normal(e)) for _ in range(4)]
    learned = rng.standard_normal((3, e))
    allowed = {k: (rng.random((3, len(x))) < 0.6).astype(float) for k, x in keys.items()}
    allowed[2][1] = 0
    norms = [(rng.standard_normal(e), rng.standard_normal(e)) for _ in range(2)]
    mlp = [(rng.standard_normal((e, 6)), rng.standard_normal(6)), (rng.standard_normal((6, e)), rng.standard_normal(e))]
    frame = packed(spark, keys)
    for size in (2, 100):
        blocks = A.blocks(frame, size)
        mask = spark.createDataFrame([(k, at, m[:, at : at + size].ravel().tolist()) for k, m in allowed.items() for at in range(0, m.shape[1], size)], "sample_id long, first long, data array<double>")
        queries = A.tiled_queries(frame, learned)
        got = unpacked(A.cross_attention(queries, blocks, heads, *layers, mask))
        block = unpacked(A.masked_cross_attention(queries, blocks, heads, tuple(layers), tuple(norms), tuple(mlp), mask))

        def whole(q, x, m):
            q, k, v = (y @ w + b for y, (w, b) in zip((q, x, x), layers))
            parts = [softmax(q[:, s] @ k[:, s].T / np.sqrt(2) + np.where(m > 0, 0, -1e9)) @ v[:, s] for s in (slice(0, 2), slice(2, 4))]
            return np.concatenate(parts, 1) @ layers[3][0] + layers[3][1]

        for k, x in keys.items():
            assert np.allclose(got[k], whole(learned, x, allowed[k]))
            mid = learned + whole(A.layer_normed(learned, *norms[0]), x, allowed[k])
            assert np.allclose(block[k], mid + A._gelu(A.layer_normed(mid, *norms[1]) @ mlp[0][0] + mlp[0][1]) @ mlp[1][0] + mlp[1][1])


def test_paired_attention_in_blocks(spark):
    rng = np.random.default_rng(10)
    n, c, heads, few = 6, 4, 2, 3
    xs = {1: rng.standard_normal((n, c)), 2: np.zeros((n, c))}
    qkvv, projection, warm = (rng.standard_normal((c, 4 * c)), None), rng.standard_normal((n, few)), ([0.7, 1.3], [2.0, 0.5])

    def whole(x):
        y = (x @ qkvv[0]).reshape(n, 4, heads, c // heads).transpose(1, 2, 3, 0)  # four of (head, within, token)
        q, k, v, w = y
        unit = lambda z: z / np.sqrt(np.maximum((z * z).sum(-1, keepdims=True), 1e-6))
        q, k = unit(q), unit(k)
        t1, t2 = (np.array(t).reshape(heads, 1, 1) for t in warm)
        channel = softmax(q @ k.transpose(0, 2, 1) * t1) @ v
        spatial = softmax(q.transpose(0, 2, 1) @ (k @ projection) * t2) @ (w @ projection).transpose(0, 2, 1)
        return channel.transpose(2, 0, 1).reshape(n, c) + spatial.transpose(2, 0, 1).reshape(n, c)

    for size in (1, 4, 6):
        out = A.paired_attention(A.blocks(packed(spark, xs), size), n, heads, qkvv, projection, warm)
        got = {k: np.zeros((n, c)) for k in xs}
        for r in out.collect():
            got[r.sample_id][r.first : r.first + r.shape[0]] = np.array(r.data).reshape(r.shape)
        assert all(np.allclose(got[k], whole(x)) for k, x in xs.items())


def test_batches_of_any_keys(spark):
    """Null, sparse, negative, text and very frequent keys; the count of full batches is exact."""
    rows = [(None if i % 5 == 0 else (i * 10**12 if i % 3 else -7), f"r{i % 40}") for i in range(103)]
    df = spark.createDataFrame(rows, "k long, s string").repartition(4)
    out = readers.batched(df, "k", 10).collect()
    assert len(out) == 100 and sorted({r.batch for r in out}) == list(range(10))
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for b in range(10):
        assert sorted(str(r.k) for r in out if r.batch == b) == sorted(str(k) for k, _ in ordered[10 * b : 10 * b + 10])
    whole = tables.batches(df, ["s", (F.col("k"), False)], 10, drop_remainder=False).collect()
    assert len(whole) == 103 and max(r.batch for r in whole) == 10 and {r.place for r in whole if r.batch == 10} == {0, 1, 2}
    assert readers.batched(df.limit(0), "k", 10).collect() == []
    with pytest.raises(ValueError):
        tables.batches(df, ["k"], 0)


def test_epochs_differ_and_repeat(spark):
    df = spark.range(50)
    order = lambda e, d=df: [r.id for r in sorted(tables.epochs(d, 3, e, 8, "id").collect(), key=lambda r: (r.batch, r.place))]
    assert order(0) == order(0, df.repartition(5)) != order(1)
    assert len(order(0)) == 48 and len(set(order(0))) == 48


def test_tiles_meet_over_batches_and_runs(spark, arrays, monkeypatch):
    """Groups that go on over Arrow batches, runs of a few tiles: the same arrays; many tiles are worked on in one call of Python."""
    many = {k: arrays[k % 3 + 1] + k for k in range(7)}
    kernel = np.random.default_rng(9).standard_normal((3, 3, 3, 2, 3))
    size, key = (2, 3, 4), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        df = T.joined(T.convolution(T.cut(packed(spark, many), size), size, kernel))
        got = unpacked(df)
    finally:
        spark.conf.set(key, before)
    assert set(got) == set(many) and all(np.allclose(got[k], same_convolution(x, kernel, 1)) for k, x in many.items())
    assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()
    tile = T._rows(T.SCHEMA, np.ones((5000, 1, 1, 1, 1)), np.arange(5000), (0, 0, 0), (1, 1, 1))
    monkeypatch.setattr(T, "HELD", 1 << 20)
    # rows of few numbers are held to a bound as well
    runs = list(T._runs(iter([tile, tile]), ["sample_id"]))
    assert max(rows.num_rows for rows, _ in runs) <= 1024 and sum(rows.num_rows for rows, _ in runs) == 10_000


@pytest.mark.parametrize("name", ["conv3d_channels_dilation1", "conv3d_channels_dilation2"])
def test_channel_convolutions_call_python_for_many_tiles(spark, sf, name):
    """The registered queries have no call of Python a group, and a kernel's calls follow shapes and tasks, not tiles."""
    df = __spark_entry__.queries()[name](spark, sf)
    assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()
    calls, size = spark.sparkContext.accumulator(0), (2, 3, 2)

    def kernel(x):
        calls.add(1)
        return x

    tiles = T.cut(packed(spark, {k: np.full((4, 4, 2, 2), float(k)) for k in range(60)}), size)
    grown = unpacked(T.joined(T._each(tiles, kernel)))
    assert set(grown) == set(range(60)) and all((x == k).all() for k, x in grown.items())
    # 240 tiles of two shapes, in two tasks
    assert 0 < calls.value <= 4
