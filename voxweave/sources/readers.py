"""Sources of arrays: manifests, NIfTI files, NumPy archives and paired image folders."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import batches

# NIfTI-1 data type codes.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def manifest(spark: SparkSession, path: str, split: str = "training") -> DataFrame:
    """(image, label) pairs of a JSON manifest."""
    return spark.read.json(path, multiLine=True).select(F.explode(split).alias("p")).select("p.image", "p.label")


def pair_files(spark: SparkSession, images: str, masks: str, suffix: str = "_segmentation") -> DataFrame:
    """(stem, image, label) paths: x.jpg with x_segmentation.png, joined by stem."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+)\.[^./]+$", 1)
    a = spark.read.format("binaryFile").load(images).select(F.col("path").alias("image"), stem(F.col("path")).alias("stem"))
    b = spark.read.format("binaryFile").load(masks).select(F.col("path").alias("label"), F.regexp_replace(stem(F.col("path")), f"{suffix}$", "").alias("stem"))
    return a.join(b, "stem")


def decode_nifti(raw: bytes) -> tuple[list[int], list[float], list[float], np.ndarray]:
    """(shape, affine, pixdim, values) of a .nii or .nii.gz file; values row-major in file axes."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    order = "<" if int.from_bytes(raw[:4], "little") == 348 else ">"
    read = lambda kind, n, at: np.frombuffer(raw, order + kind, n, at)
    dim, pixdim = read("i2", 8, 40), read("f4", 8, 76)
    shape = [int(n) for n in dim[1 : dim[0] + 1]]
    slope, inter = (float(x) for x in read("f4", 2, 112))
    data = read(NIFTI_TYPES[int(read("i2", 1, 70)[0])], int(np.prod(shape)), int(read("f4", 1, 108)[0]))
    data = data.reshape(shape, order="F").astype(np.float64)
    if slope not in (0.0, 1.0) or slope == 1.0 and inter:
        data = data * slope + inter
    if int(read("i2", 1, 254)[0]) > 0:
        affine = [*(float(x) for x in read("f4", 12, 280)), 0.0, 0.0, 0.0, 1.0]
    else:
        affine = [float(x) for x in np.diag([*pixdim[1:4], 1.0]).ravel()]
    return shape, affine, [float(x) for x in pixdim], data


def nifti(spark: SparkSession, path: str) -> DataFrame:
    """(path, shape, affine, pixdim, data) of NIfTI files, one a row; files are read by Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"]):
                shape, affine, pixdim, data = decode_nifti(bytes(raw))
                yield pd.DataFrame({"path": [name], "shape": [shape], "affine": [affine], "pixdim": [pixdim], "data": [data.ravel()]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, shape array<int>, affine array<double>, pixdim array<double>, data array<double>")


def npz(spark: SparkSession, path: str, images: str, labels: str) -> DataFrame:
    """(path, i, shape, data, label) of the arrays in NumPy archives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"]):
                with np.load(io.BytesIO(bytes(raw)), allow_pickle=False) as stored:
                    x, y = stored[images], stored[labels].reshape(-1)
                for i in range(len(x)):
                    yield pd.DataFrame({"path": [name], "i": [i], "shape": [list(x[i].shape)], "data": [x[i].astype(np.float64).ravel()], "label": [int(y[i])]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, i long, shape array<int>, data array<double>, label long")


def batched(df: DataFrame, key: str, size: int) -> DataFrame:
    """df with `batch`: full batches in key order, nulls first; the remainder is dropped. Keys may be sparse, null or repeated."""
    return batches(df, [key], size).drop("place")
