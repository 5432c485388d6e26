"""Record files, streams into sinks, weight maps."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxweave.operators import windows
from voxweave.sources import tfrecords as R
from voxweave.streaming import evaluation as E
from voxweave.streaming import metrics
from voxweave.voxels import unpack


def slow_crc(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksum():
    assert R.crc32c(b"123456789") == 0xE3069283
    rng = random.Random(1)
    for n in (0, 1, 7, 64, 65, 1000):
        data = rng.randbytes(n)
        assert R.crc32c(data) == R.crc32c(data, 16) == slow_crc(data)


def test_examples():
    features = {"a": [b"\x00\xff", b""], "t": ["é"], "f": [1.5, -2.0], "i": [3, -1, 1 << 40], "none": []}
    back = R.decode_example(R.encode_example(features))
    assert back["a"]["bytes"] == [b"\x00\xff", b""] and back["t"]["bytes"] == ["é".encode()]
    assert back["f"]["floats"] == [1.5, -2.0] and back["i"]["ints"] == [3, -1, 1 << 40] and back["none"]["ints"] == []
    # values that are not packed
    single = R._field(1, R._field(1, R._field(1, b"x") + R._field(2, R._field(3, R._varint(1 << 3) + R._varint(7) + R._varint(1 << 3) + R._varint(8)))))
    assert R.decode_example(single)["x"]["ints"] == [7, 8]


def test_ranges_own_each_record_once(tmp_path):
    """For every size of ranges; records hold bytes that look like frames."""
    rng = random.Random(2)
    records = [rng.randbytes(rng.randint(0, 90)) for _ in range(40)]
    records[7] = R.frame(b"inside")[:-1] + R.frame(b"another")[:12]
    path = tmp_path / "x.tfrecord"
    path.write_bytes(b"".join(map(R.frame, records)))
    size = path.stat().st_size
    for step in (1, 13, 100, 1000, size):
        found = [d for start in range(0, size, step) for _, d in R.frames(str(path), start, start + step)]
        assert found == records
    broken = bytearray(path.read_bytes())
    broken[size // 2] ^= 1
    path.write_bytes(bytes(broken))
    with pytest.raises(ValueError, match="no whole record"):
        list(R.frames(str(path), 0, size))
    path.write_bytes(struct.pack("<Q", 5))
    with pytest.raises(ValueError):
        list(R.frames(str(path), 0, 8))


def test_round_trip(spark, tmp_path):
    rows = [(1, "text", [1.0, 2.0], None), (2, None, [], b"\x01"), (3, "", [0.5], b"")]
    df = spark.createDataFrame(rows, "id long, s string, f array<float>, b binary").repartition(2)
    manifest = R.write_records(df, f"file://{tmp_path}/out", 10)
    assert manifest.agg(F.sum("records")).first()[0] == 3
    back = {r.features["id"].ints[0]: r.features for r in R.read_records(spark, f"file://{tmp_path}/out", 11).collect()}
    assert bytes(back[1]["s"].bytes[0]) == b"text" and back[1]["f"].floats == [1.0, 2.0] and "b" not in back[1]
    assert "s" not in back[2] and bytes(back[2]["b"].bytes[0]) == b"\x01"
    row = spark.range(1).select(R.channels([F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4))]).alias("x")).first()
    assert row.x == [1, 3, 2, 4]


def test_evaluation_is_idempotent(spark, tmp_path):
    """Batches in order, then all again: the same history; weights only where the score is above all before."""
    h, w = f"file://{tmp_path}/history", f"file://{tmp_path}/weights"
    scores = [0.5, 0.5, 0.7, 0.1, 0.9]
    score = lambda batch: batch.agg(F.avg("v"))
    for _ in range(2):
        for k, v in enumerate(scores):
            E.evaluated(spark.createDataFrame([(v,)], "v double"), k, score, h, w, lambda batch: batch, 1)
    rows = E.history(spark, h).orderBy("batch_id").collect()
    assert [r.score for r in rows] == scores and [r.saved for r in rows] == [True, False, True, False, True]
    assert sorted(p.name for p in (tmp_path / "weights").iterdir()) == ["batch-0", "batch-2", "batch-4"]
    assert E.best_weights(spark, h, w).first().v == 0.9
    assert E.best_weights(spark, f"{h}-none", w) is None


def test_evaluation_of_a_stream(spark, tmp_path):
    """A batch a file; every second is evaluated; a second start goes on after the first."""
    def put(k, v):
        spark.createDataFrame([(v,)], "v double").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    args = (f"{tmp_path}/state", lambda batch: batch.agg(F.avg("v")), f"file://{tmp_path}/h")

    def run():
        stream = spark.readStream.schema("v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        E.evaluate(stream, *args, interval=2).awaitTermination()
        return [(r.batch_id, r.score, r.evaluated) for r in E.history(spark, args[2]).orderBy("batch_id").collect()]

    for k, v in enumerate((1.0, 2.0)):
        put(k, v)
    assert run() == [(0, 0.0, False), (1, 2.0, True)]
    put(2, 3.0)
    put(3, 3.0)
    assert [x[0] for x in run()] == [0, 1, 2, 3] and run()[3][1] == 3.0


def test_late_rows_are_dropped(spark, tmp_path):
    """A row that comes after the watermark has passed its window is in no result; one within the delay is."""
    def put(k, *hours):
        rows = [(f"2024-01-01 {h:02d}:10:00", "a", 1.0) for h in hours]
        spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    def run():
        stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/in/*")
        metrics.closed_windows(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return {r.start.hour: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    put(0, 1, 1, 5, 8)
    assert run() == {1: 2, 5: 1}
    put(1, 1, 7, 14)
    assert run() == {1: 2, 5: 1, 7: 1, 8: 1}


def test_weight_maps(spark):
    roi = {"h": 2, "w": 3}
    assert windows.weight_map(0.5, roi).tolist() == [[0.5] * 3] * 2
    assert windows.weight_map(np.ones((1, 2, 3, 1)), roi).shape == (2, 3)
    for bad in (np.ones((3, 2)), np.ones((2, 2, 3, 1)), np.ones(6)):
        with pytest.raises(ValueError):
            windows.weight_map(bad, roi)
    assert windows.resized_weights(np.array([[1.0, 2.0], [3.0, 4.0]]), (3, 4)).tolist() == [[1, 1, 2, 2], [3, 3, 4, 4], [3, 3, 4, 4]]
    vox = unpack(spark.createDataFrame([(1, [float(i) for i in range(12)])], "sample_id long, data array<double>"), (3, 4))
    same = windows.sliding_window(vox, roi, lambda p: p, 0.5, weights=0.8).df.orderBy("h", "w").collect()
    assert [round(r.v, 9) for r in same] == list(range(12))
    none = windows.sliding_window(vox, roi, lambda p: p, 0.5, weights=0.0).df.collect()
    assert {r.v for r in none} == {0.0}


def test_frames_of_many_records_and_few_tasks(spark, tmp_path):
    """Checksums side by side are those of each alone; small ranges are dealt to few tasks; files that no manifest names are not read."""
    rng = random.Random(3)
    records = [rng.randbytes(n) for n in (0, 1, 2, 3, 4, 5, 7, 8, 9, 31, 64, 300, 20_000, 301, 0)]
    assert R.framed(records) == [R.frame(r) for r in records] and R.frame(b"123456789")[-4:] == struct.pack("<I", R.masked(slow_crc(b"123456789")))
    rows = spark.range(400).selectExpr("id", "array(cast(id as float)) AS f")
    manifest = R.write_records(rows, f"file://{tmp_path}/out", 200)
    (tmp_path / "out" / "part-lost.tfrecord").write_bytes(R.frame(R.encode_example({"id": [-1], "f": [0.5]})))
    back = R.read_records(spark, manifest, 40)
    assert back.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert sorted(r.features["id"].ints[0] for r in back.collect()) == list(range(400))
