from __future__ import annotations

import gzip
import itertools
import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxweave.functions import scalars
from voxweave.operators import augment, geometry, intensity, layers, morphology, regions, scores, spatial, windows
from voxweave.plans import catalog, transforms
from voxweave.queries import filled_grid
from voxweave.sources import readers
from voxweave.streaming.metrics import stream_dice, windowed_means
from voxweave.voxels import Voxels, pack, unpack


def make(spark, *arrays) -> Voxels:
    """Arrays of shape (d, h, w, c) as a batch."""
    rows = [(i, [float(x) for x in a.ravel()]) for i, a in enumerate(arrays)]
    return unpack(spark.createDataFrame(rows, "sample_id long, data array<double>"), arrays[0].shape)


def back(vox: Voxels) -> list[np.ndarray]:
    return [np.array(r["data"]).reshape(r["shape"]) for r in pack(vox).orderBy("sample_id").collect()]


RNG = np.random.default_rng(7)
IMAGE = RNG.standard_normal((1, 6, 5, 2))
VOLUME = RNG.standard_normal((3, 4, 5, 1))


def test_pack_round_trip(spark):
    assert all(np.array_equal(a, b) for a, b in zip(back(make(spark, VOLUME, VOLUME * 2)), [VOLUME, VOLUME * 2]))
    with pytest.raises(ValueError):
        unpack(spark.range(1).select(F.lit(0).alias("sample_id"), F.array(F.lit(1.0)).alias("data")), (1,))


def test_normalize(spark):
    x = np.array([[0.0, 1], [3, 0]]).reshape(1, 2, 2, 1)
    assert np.array_equal(back(intensity.normalize(make(spark, x), nonzero=True))[0] == 0, x == 0)
    fixed = back(intensity.normalize(make(spark, np.array([1.0, 5, 3, 9]).reshape(1, 1, 2, 2)), channel_wise=True, offset=1, scale=2))[0]
    assert fixed.ravel().tolist() == [0, 2, 1, 4]
    empty = np.array([0.0, 1, 0, 3]).reshape(1, 1, 2, 2)
    out = back(intensity.normalize(make(spark, empty), nonzero=True, channel_wise=True))[0]
    assert np.isfinite(out).all() and (out[..., 0] == 0).all()
    bad = np.array([np.nan, np.inf, -np.inf, 1]).reshape(1, 2, 2, 1)
    assert np.isfinite(back(intensity.fill_empty(make(spark, bad)))[0]).all()
    with pytest.raises(ValueError):
        intensity.scale_range(make(spark, x), 0, 1, output_min=0)


@pytest.mark.parametrize("k", range(-1, 5))
def test_rotations_and_flips(spark, k):
    assert np.array_equal(back(spatial.rotate90(make(spark, IMAGE), k))[0], np.rot90(IMAGE, k, (1, 2)))
    assert np.array_equal(back(spatial.flip(make(spark, VOLUME), "d", "w"))[0], VOLUME[::-1, :, ::-1])


@pytest.mark.parametrize("mode", ["nearest", "linear"])
def test_samplers(spark, mode):
    """Random places in and around a volume of two channels, and a sheared grid, against loops over corners."""
    rng = np.random.default_rng(12)
    x, fill = rng.standard_normal((3, 4, 5, 2)), 0.25
    cell = lambda i: x[tuple(i)] if all(0 <= a < n for a, n in zip(i, x.shape)) else np.full(2, fill)

    def read(p):
        if mode == "nearest":
            return cell([round(float(a)) for a in p])
        low = [math.floor(a) for a in p]
        corners = itertools.product((0, 1), repeat=3)
        return sum(math.prod(a - b if up else 1 - a + b for a, b, up in zip(p, low, c)) * cell([b + up for b, up in zip(low, c)]) for c in corners)

    points = rng.uniform(-1.4, 5.4, (40, 3))
    df = spark.createDataFrame([(0, k, *map(float, p)) for k, p in enumerate(points)], "sample_id long, point int, x double, y double, z double")
    got = spatial.sample_at(make(spark, x), df, mode, fill).orderBy("point", "c").collect()
    assert np.allclose([r.v for r in got], np.concatenate([read(p) for p in points]))
    m = np.hstack([np.eye(3) * [0.7, 1.2, 0.9] + rng.uniform(-0.2, 0.2, (3, 3)), rng.uniform(-1, 1, (3, 1))])
    grown = back(spatial.affine_resample(make(spark, x), tuple(m.ravel().tolist()), (2, 3, 4), mode, fill))[0]
    assert all(np.allclose(grown[i], read(m @ [*i, 1])) for i in np.ndindex(2, 3, 4))


def constant(m):
    return F.array(*[F.lit(float(x)) for x in np.asarray(m, dtype=float).ravel()])


def test_affines_against_numpy(spark):
    """Oblique, sheared and permuted affines: shape from the mapped corners, inverse, product, destination."""
    rng = np.random.default_rng(5)
    for k in range(2):
        a, b = np.eye(4), np.eye(4)
        a[:3] = rng.standard_normal((3, 4)) * [3, 2, 1, 9]
        b[:3] = rng.standard_normal((3, 4)) if k % 2 else np.hstack([np.diag(rng.random(3) + 0.5)[rng.permutation(3)], rng.random((3, 1))])
        shape = tuple(int(n) for n in rng.integers(3, 60, 3))
        for ends in (False, True):
            corners = np.array([[(n - ends) * (c >> j & 1) for j, n in enumerate(shape)] + [1] for c in range(8)])
            span = np.ptp((np.linalg.inv(b) @ a @ corners.T)[:3], axis=1)
            want = np.maximum(np.floor(span + 0.5) + ends, 1).astype(int).tolist()
            cols = [constant(a), constant(b)]
            r = spark.range(1).select(scalars.output_shape(*cols, shape, ends).alias("n"), scalars.invert(cols[0]).alias("i"), scalars.product(*cols).alias("p"), scalars.destination_affine(cols[0], constant([1, 2, 3])).alias("t")).first()
            assert r.n == want
        assert np.allclose(np.array(r.i).reshape(4, 4), np.linalg.inv(a)) and np.allclose(np.array(r.p).reshape(4, 4), a @ b)
        to = np.array(r.t).reshape(4, 4)
        assert np.allclose(np.linalg.norm(to[:3, :3], axis=0), [1, 2, 3]) and np.allclose(to[:3, 3], a[:3, 3])
    with pytest.raises(Exception, match="not a 4x4 affine"):
        spark.range(1).select(scalars.valid_affine(constant(np.ones(16)))).collect()


def test_volumes_of_several_shapes(spark):
    """Orientation and spacing with a shape and an affine in each row, and back."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for k, perm in enumerate([(0, 1, 2), (2, 0, 1), (1, 2, 0), (2, 1, 0)]):
        shape = tuple(int(n) for n in rng.integers(2, 6, 3)) + (1 + k % 2,)
        x = rng.standard_normal(shape)
        a = np.eye(4)
        a[:3, :3] = np.eye(3)[:, perm] * rng.choice([-1, 1], 3) * [1, 2, 1.5] + rng.standard_normal((3, 3)) * 0.05
        a[:3, 3] = rng.standard_normal(3)
        rows.append((k, list(shape), x.ravel().tolist(), a.ravel().tolist()))
        axes = np.abs(a[:3, :3]).argmax(axis=0)
        order = [int(np.flatnonzero(axes == t)[0]) for t in (2, 1, 0)]
        y = x.transpose(*order, 3)
        for j, (o, t) in enumerate(zip(order, (2, 1, 0))):
            if a[t, o] < 0:
                y = np.flip(y, j)
        want[k] = y
    df = spark.createDataFrame(rows, "sample_id long, shape array<int>, data array<double>, affine array<double>")
    turned = geometry.orient(df, "ras")
    for r in turned.collect():
        got = np.array(r.data).reshape(r.shape)
        assert np.array_equal(got, want[r.sample_id])
        # the voxel that went to the origin keeps its place in the world
        a, old = np.array(r.affine).reshape(4, 4), np.array(rows[r.sample_id][3]).reshape(4, 4)
        place = np.argwhere(np.array(rows[r.sample_id][2]).reshape(rows[r.sample_id][1]) == got[0, 0, 0, 0])[0][:3]
        assert np.allclose(a[:3, 3], old[:3, :3] @ place + old[:3, 3])
    spaced = geometry.respace(turned, (1.0, 1.0, 1.0))
    assert all(np.allclose(np.linalg.norm(np.array(r.affine).reshape(4, 4)[:3, :3], axis=0), 1) and len(r.trace) == 2 for r in spaced.collect())
    back_again = geometry.unorient(geometry.unspace(spaced))
    for r in back_again.collect():
        assert r.shape == rows[r.sample_id][1] and np.allclose(r.affine, rows[r.sample_id][3]) and r.trace == []
    there = geometry.resample(df.withColumn("to_affine", F.col("affine")), (2, 2, 2))
    assert all(np.allclose(np.array(r.data).reshape(r.shape), np.array(rows[r.sample_id][2]).reshape(rows[r.sample_id][1])[:2, :2, :2]) for r in there.collect())
    same = geometry.unorient(turned).collect()
    assert all(r.data == rows[r.sample_id][2] and r.shape == rows[r.sample_id][1] for r in same)
    with pytest.raises(ValueError):
        geometry.orient(df, "RAR")
    with pytest.raises(Exception, match="was not Spacing"):
        geometry.unspace(turned).collect()


def test_padding(spark):
    for mode in ("constant", "edge", "reflect", "symmetric", "wrap"):
        extra = {"constant_values": 7.0} if mode == "constant" else {}
        out = windows.pad(make(spark, VOLUME), mode, 7.0, d=(2, 1), w=(0, 3))
        assert np.array_equal(back(out)[0], np.pad(VOLUME, ((2, 1), (0, 0), (0, 3), (0, 0)), mode=mode, **extra))
    big = windows.sliding_window(make(spark, VOLUME), {"d": 5, "h": 9, "w": 2}, lambda p: p.withColumn("v", F.col("v") - 1), 0.5, "gaussian", "edge")
    assert big.shape == VOLUME.shape and np.allclose(back(big)[0], VOLUME - 1)


def test_convolution_over_channels(spark):
    kernel = RNG.standard_normal((3, 2, 2, 3))
    x = IMAGE[0]
    for stride in (1, 2):
        out = back(morphology.convolve_channels(make(spark, IMAGE), kernel, stride))[0][0]
        n = [-(-s // stride) for s in x.shape[:2]]
        lead = [max((m - 1) * stride + k - s, 0) // 2 for m, k, s in zip(n, kernel.shape, x.shape)]
        for i in range(n[0]):
            for j in range(n[1]):
                total = np.zeros(3)
                for p in range(3):
                    for q in range(2):
                        u, v = i * stride + p - lead[0], j * stride + q - lead[1]
                        if 0 <= u < x.shape[0] and 0 <= v < x.shape[1]:
                            total += x[u, v] @ kernel[p, q]
                assert np.allclose(out[i, j], total)
    with pytest.raises(ValueError):
        morphology.convolve_channels(make(spark, VOLUME), kernel)


def test_windows(spark):
    assert windows.patch_starts(8, 4, 3) == [0, 3, 4] and windows.scan_interval(8, 8, 0.5) == 8
    with pytest.raises(ValueError):
        windows.scan_interval(8, 4, 1.0)
    with pytest.raises(ValueError):
        windows.importance(3, "max")
    for mode in ("constant", "gaussian"):
        out = windows.sliding_window(make(spark, VOLUME), {"d": 2, "h": 3, "w": 4}, lambda p: p.withColumn("v", F.col("v") + 1), 0.5, mode)
        assert np.allclose(back(out)[0], VOLUME + 1)
    x = make(spark, RNG.standard_normal((4, 4, 6, 2)))
    assert np.allclose(back(windows.window_reverse(x, windows.window_partition(x, d=2, h=4, w=3), d=2, h=4, w=3))[0], back(x)[0])


def test_morphology_and_pooling(spark):
    x = np.zeros((1, 5, 5, 1))
    x[0, 1:4, 1:4] = 1
    assert back(morphology.erode(make(spark, x)))[0].sum() == 1
    assert np.array_equal(back(morphology.opened(make(spark, x)))[0], x)
    assert back(morphology.dilate(make(spark, x)))[0].sum() == 25
    assert np.allclose(back(morphology.adaptive_pool(make(spark, IMAGE), "avg", h=1, w=1))[0].ravel(), IMAGE.mean((0, 1, 2)))
    padded = back(morphology.zero_pad(make(spark, IMAGE), h=(1, 2)))[0]
    assert padded.shape == (1, 9, 5, 2) and np.array_equal(padded[:, 1:7], IMAGE)
    kernel = {(0, i - 1, j - 1): float(RNG.standard_normal()) for i in range(3) for j in range(3)}
    big = np.pad(IMAGE, ((0, 0), (1, 1), (1, 1), (0, 0)))
    want = sum(big[:, 1 + a : 7 + a, 1 + b : 6 + b] * x for (_, a, b), x in kernel.items())
    assert np.allclose(back(morphology.convolve(make(spark, IMAGE), kernel))[0], want)
    assert np.allclose(back(morphology.convolve(make(spark, IMAGE), kernel, stride=2))[0], want[:, ::2, ::2])


def test_skeleton_of_a_square_is_its_middle(spark):
    x = np.zeros((1, 5, 5, 1))
    x[0, 1:4, 1:4] = 1
    want = np.zeros_like(x)
    assert np.array_equal(back(morphology.skeleton(make(spark, x), 0))[0], want)
    want[0, 2, 2] = 1
    assert np.array_equal(back(morphology.skeleton(make(spark, x), 1))[0], want)
    assert np.array_equal(back(morphology.skeleton(make(spark, x), 3))[0], want)


def test_centerline_loss(spark):
    same = [(0, 0, 1.0, 1.0, 1.0, 1.0), (0, 0, 0.0, 0.0, 0.0, 0.0)]
    apart = [(1, 0, 1.0, 0.0, 1.0, 0.0), (1, 0, 0.0, 1.0, 0.0, 1.0)]
    half = [(2, 0, 1.0, 1.0, 1.0, 1.0), (2, 0, 0.0, 1.0, 0.0, 1.0)]
    rows = spark.createDataFrame(same + apart + half, "sample_id long, class int, y_true double, y_pred double, s_true double, s_pred double")
    got = {r.sample_id: r.loss for r in scores.centerline_dice_loss(rows).collect()}
    # precision 1/2 and recall 1 in the last: their harmonic mean is 2/3
    assert np.allclose([got[0], got[1], got[2]], [0, 1, 1 / 3], atol=1e-5)


def pairs(spark, true, pred):
    rows = [(s, h, w, c, int(np.argmax(true[s, h, w])), float(true[s, h, w, c]), float(pred[s, h, w, c])) for s in range(true.shape[0]) for h in range(true.shape[1]) for w in range(true.shape[2]) for c in range(true.shape[3])]
    return spark.createDataFrame(rows, "sample_id int, h int, w int, class int, true_class int, y_true double, y_pred double")


def test_scores(spark):
    true = np.eye(3)[np.array([[[0, 1], [1, 2]], [[0, 0], [0, 1]]])]
    perfect = pairs(spark, true, true)
    assert scores.dice_result(scores.dice_state(perfect)).first().dice == pytest.approx(1)
    # predictions are clipped to 1e-7, and sample 1 lacks class 2: 1e-7 over the 5e-7 of four voxels and the smoothing
    assert scores.reduced(scores.overlap_loss(perfect)).first().loss == pytest.approx((1 - 1 / 5) / 6, abs=1e-5)
    pred = RNG.random(true.shape)
    p = np.clip(pred, 1e-7, 1 - 1e-7)
    i, t, u = (true * p).sum((1, 2)), true.sum((1, 2)), p.sum((1, 2))
    got = {(r.sample_id, r["class"]): r.loss for r in scores.overlap_loss(pairs(spark, true, pred)).collect()}
    assert all(got[s, c] == pytest.approx(1 - (2 * i[s, c] + 1e-7) / (t[s, c] + u[s, c] + 1e-7)) for s in range(2) for c in range(3))
    w = np.where(t > 0, 1 / (t * t + 1e-7), 0)
    gdl = {r.sample_id: r.loss for r in scores.generalized_dice_loss(pairs(spark, true, pred)).collect()}
    assert all(gdl[s] == pytest.approx(1 - (2 * (w * i)[s].sum() + 1e-7) / ((w * (t + u))[s].sum() + 1e-7)) for s in range(2))
    with pytest.raises(ValueError, match="valid range"):
        scores.class_ids([3], 3)
    with pytest.raises(ValueError):
        scores.reduced(perfect, "median")
    losses = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 3.0), (1, 4.0)], "sample_id int, loss double")
    assert [scores.reduced(losses, r).first().loss for r in ("sum", "mean", "sum_over_batch_size")] == [10, 2.5, 5]


def test_layers(spark):
    x = RNG.standard_normal((1, 3, 3, 4))
    e = np.exp(x)
    assert np.allclose(back(layers.softmax(make(spark, x)))[0], e / e.sum(-1, keepdims=True))
    mean, var = x.mean((0, 1, 2)), x.var((0, 1, 2))
    assert np.allclose(back(layers.norm(make(spark, x), "instance", 1e-5))[0], (x - mean) / np.sqrt(var + 1e-5))
    g = np.sqrt((x**2).sum((0, 1, 2)))
    assert np.allclose(back(layers.global_response_norm(make(spark, x), 2.0, 0.5))[0], 2 * x * g / (g.mean() + 1e-6) + 0.5 + x)


def test_random_operators_are_seeded(spark):
    x = make(spark, *[RNG.standard_normal((1, 4, 4, 1)) for _ in range(30)])
    for run in (lambda s: augment.random_flip(x, s, 0.5), lambda s: augment.random_rotate90(x, s, 0.5), lambda s: augment.random_rotate(x, s, 0.5), lambda s: augment.random_cutout(x, s, {"h": 2, "w": 2}, 2)):
        a, b, c = back(run(1)), back(run(1)), back(run(2))
        assert all(np.array_equal(p, q) for p, q in zip(a, b)) and not all(np.array_equal(p, q) for p, q in zip(a, c))
    with pytest.raises(ValueError):
        augment.random_flip(x, 1, 1.5)
    centers = augment.crop_centers(make(spark, (IMAGE[..., :1] > 0).astype(float)), 1, 1, 0, 5).collect()
    assert len(centers) == 5 and all(IMAGE[0, r.h, r.w, 0] > 0 for r in centers)
    chosen = augment.random_choice(spark.range(50).withColumnRenamed("id", "sample_id"), 3, [1, 0, 2], 2).collect()
    assert all(r.choice != 1 for r in chosen) and len(chosen) == 100


def test_pipeline(spark):
    chain = transforms.Compose(transforms.flip("a", "h"), transforms.Compose(transforms.shift("a", 2)), transforms.crop("a", h=(1, 5)), transforms.rotate90("a", 3))
    batch = transforms.Batch({"a": make(spark, IMAGE), "b": make(spark, IMAGE)})
    out = chain(batch)
    assert [t["name"] for t in out.trace] == ["flip", "shift", "crop", "rotate90"] and out["b"] is batch["b"]
    undone = transforms.Compose.inverse(out)
    want = IMAGE.copy()
    want[:, [0, 5]] = -2
    assert undone.trace == () and np.allclose(back(undone["a"])[0], want)
    assert len(transforms.fused([transforms.flip("a", "h"), transforms.flip("a", "h"), transforms.rotate90("a", 4)])) == 0
    with pytest.raises(KeyError):
        transforms.shift("c", 1)(batch)
    with pytest.raises(ValueError):
        transforms.shift((), 1)
    with pytest.raises(TypeError):
        transforms.shift((1,), 1)


def test_catalog(spark):
    assert catalog.lookup(spark, "UNETR") == ("segmentor", ["vit"])
    with pytest.raises(KeyError):
        catalog.lookup(spark, "none")
    assert {r.encoder for r in catalog.compatible(spark).where("segmentor = 'segformer'").collect()} == set(catalog.BACKBONES["mit"].split())
    names = ["SoftJaccardScore", "Dice_Loss", "HTTPRangeReader", "Grid3DPool", "already_snake"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(scalars.camel_to_snake(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == ["soft_jaccard_score", "dice_loss", "http_range_reader", "grid3_d_pool", "already_snake"]


def test_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"training": [{"image": "a.nii", "label": "b.nii"}]}))
    assert [tuple(r) for r in readers.manifest(spark, str(tmp_path / "m.json")).collect()] == [("a.nii", "b.nii")]
    data = np.arange(24, dtype="<i2").reshape(2, 3, 4)
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, 2, 3, 4, 1, 1, 1, 1)
    struct.pack_into("<h", head, 70, 4)
    struct.pack_into("<8f", head, 76, 1, 2, 3, 4, 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352, 2, 1)
    (tmp_path / "x.nii.gz").write_bytes(gzip.compress(bytes(head) + data.tobytes(order="F")))
    row = readers.nifti(spark, str(tmp_path / "x.nii.gz")).first()
    assert row["shape"] == [2, 3, 4] and row.affine[:6] == [2, 0, 0, 0, 0, 3] and row["data"] == (data * 2.0 + 1).ravel().tolist()
    np.savez(tmp_path / "n.npz", x=np.arange(8, dtype=np.uint8).reshape(2, 2, 2), y=np.array([[3], [4]]))
    got = readers.npz(spark, str(tmp_path / "n.npz"), "x", "y").orderBy("i").collect()
    assert [r.label for r in got] == [3, 4] and got[1]["data"] == [4, 5, 6, 7]
    (tmp_path / "img").mkdir()
    for n in ("p.jpg", "q.jpg", "p_segmentation.png"):
        (tmp_path / "img" / n).write_bytes(b"x")
    assert [r.stem for r in readers.pair_files(spark, str(tmp_path / "img/*.jpg"), str(tmp_path / "img/*.png")).collect()] == ["p"]


def test_streams(spark, sf, tmp_path):
    rows = [(i % 3, float(i % 2), float(i % 5 > 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "class int, y_true double, y_pred double")
    df.repartition(4).write.parquet(str(tmp_path / "s"))
    q = stream_dice(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s")), "dice_state")
    q.awaitTermination(60)
    got = {r["class"]: (r.intersection, r.total, r.valid) for r in spark.table("dice_state").collect()}
    assert got == {c: (sum(t * p for k, t, p in rows if k == c), sum(t + p for k, t, p in rows if k == c), 20) for c in range(3)}
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert windowed_means(events.withColumn("ts", F.col("ts").cast("timestamp"))).count() > 0


def packed(spark, rows):
    return spark.createDataFrame([(i, None if x is None else list(x.shape), None if x is None else [float(v) for v in x.ravel()]) for i, x in rows], regions.PACKED)


def test_packed_normalisation(spark):
    """Arrays of several shapes, a constant one, zeros alone, a null; an empty table."""
    rng = np.random.default_rng(3)
    arrays = [(1, rng.normal(size=(2, 3, 4, 2))), (2, rng.normal(size=(1, 5, 2, 3)).round()), (3, np.full((1, 2, 3, 1), 0.1)), (4, np.zeros((1, 2, 2, 2))), (5, None)]
    for nonzero in (False, True):
        for channel_wise in (False, True):
            got = {r.sample_id: r.data for r in intensity.normalize_packed(packed(spark, arrays), nonzero, channel_wise).collect()}
            assert got[5] is None
            for i, x in arrays[:4]:
                want = x.copy()
                for part in [np.s_[..., k] for k in range(x.shape[-1])] if channel_wise else [np.s_[...]]:
                    own = x[part][x[part] != 0] if nonzero else x[part].ravel()
                    if own.size:
                        deviation = 0 if np.ptp(own) == 0 else own.std()
                        mean = own[0] if np.ptp(own) == 0 else own.mean()
                        scaled = (x[part] - mean) / (deviation or 1)
                        want[part] = np.where(x[part] != 0, scaled, 0) if nonzero else scaled
                assert np.allclose(got[i], want.ravel(), atol=1e-9), (i, nonzero, channel_wise)
    assert intensity.normalize_packed(packed(spark, [])).count() == 0


def test_largest_component(spark):
    """Gaps closed or not, ties by place, a volume's corner contact, nothing at all, a null."""
    line = np.zeros((1, 3, 12, 1))
    line[0, 1, [0, 1, 2, 5, 6, 11], 0] = 1
    tie = np.zeros((1, 1, 5, 1))
    tie[0, 0, [0, 4], 0] = 1
    corner = np.zeros((3, 3, 3, 1))
    corner[0, 0, 0], corner[1, 1, 1], corner[2, 0, 0] = 1, 1, 0
    rows = packed(spark, [(1, line), (2, tie), (3, corner), (4, np.zeros((1, 2, 2, 1))), (5, None)])
    got = {r.sample_id: r.data for r in regions.largest_component(rows, 0).collect()}
    assert [k for k, v in enumerate(got[1]) if v] == [12, 13, 14] and got[2] == [1.0, 0.0, 0.0, 0.0, 0.0]
    assert got[3] == list(corner.ravel()) and got[4] == [0.0] * 4 and got[5] is None
    wide = {r.sample_id: r.data for r in regions.largest_component(rows, 1).collect()}
    assert [k for k, v in enumerate(wide[1]) if v] == [12, 13, 14, 17, 18]
    assert regions.largest_component(packed(spark, [])).count() == 0


def test_packed_skeleton_is_that_of_voxels(spark):
    x = np.random.default_rng(5).random((2, 3, 5, 6, 1))
    want = back(morphology.skeleton(make(spark, *x), 2))
    got = {r.sample_id: r.data for r in regions.skeleton(packed(spark, list(enumerate(x))), 2).collect()}
    for i, w in enumerate(want):
        assert np.allclose(got[i], np.ravel(w), atol=1e-9)


def test_filled_grid_deals_a_row_an_order(spark):
    """A grid of seven lines an order; a line's sum is whole without an order, and an empty table has a grid, too."""
    rows = [(1, 1, 0.5), (1, 3, 0.25), (1, 3, 0.25), (2, 7, 1.0), (None, 2, 4.0), (2, 9, 8.0)]
    schema = "l_orderkey long, l_linenumber int, l_discount double"
    want = dict.fromkeys(range(1, 8), 0.0) | {1: 0.5, 2: 4.0, 3: 0.5, 7: 1.0}
    got = filled_grid(spark.createDataFrame(rows, schema).repartition(3))
    assert sorted(map(tuple, got.collect())) == [(k, 2, x) for k, x in want.items()]
    assert sorted(map(tuple, filled_grid(spark.createDataFrame([], schema)).collect())) == [(k, 0, 0.0) for k in want]
    # neither the cells of the grid nor the lines are joined or sorted by order and line
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
