"""Registered queries over the driver's tables, each with DuckDB SQL where it has a form.

`embeddings` rows, 64 numbers each, are images of 8x8 (2D), volumes of 4x4x4 (3D), or images of 4x4 with
four channels (MC).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .operators import augment, geometry, intensity, layers, morphology, packed, regions, scores, spatial, windows
from .plans import catalog, transforms
from .sources.readers import batched
from .voxels import Voxels, pack, rounded, unpack

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

V2 = "v AS (SELECT vec_id AS sample_id, 0 AS d, (i // 8)::INT AS h, (i % 8)::INT AS w, 0 AS c, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) t(i))"
V3 = "v AS (SELECT vec_id AS sample_id, (i // 16)::INT AS d, (i // 4 % 4)::INT AS h, (i % 4)::INT AS w, 0 AS c, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) t(i))"
MC = "v AS (SELECT vec_id AS sample_id, 0 AS d, (i // 16)::INT AS h, (i // 4 % 4)::INT AS w, (i % 4)::INT AS c, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) t(i))"
BASES = {"2d": ((8, 8), V2), "3d": ((4, 4, 4, 1), V3), "mc": ((1, 4, 4, 4), MC)}
IDX = "sample_id, d, h, w, c"


def load(spark: SparkSession, sf_dir: str, base: str = "2d") -> Voxels:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return unpack(rows, BASES[base][0], "vec_id", "embedding")


def pack_rows(spark: SparkSession, sf_dir: str, base: str = "2d", more: Sequence[Column] = ()) -> DataFrame:
    """The same arrays as `load`, still packed, and further columns of the table."""
    shape = BASES[base][0]
    full = (1, *shape, 1) if len(shape) == 2 else shape
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("sample_id"), F.array(*map(F.lit, full)).alias("shape"), F.col("embedding").cast("array<double>").alias("data"), *more)


def finish(df: DataFrame) -> DataFrame:
    """Doubles as other engines have them."""
    return df.select(*[rounded(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: finish(fn(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def vox(name: str, base: str, fn: Callable[[Voxels], Voxels], value: str | None = None, ctes: str = "", source: str = "v", idx: str = IDX) -> None:
    """A query of voxels to voxels: SQL gives the value, and the CTEs it stands on."""
    sql = None if value is None else f"WITH {BASES[base][1]}{', ' + ctes if ctes else ''} SELECT {idx}, round({value}, 6) + 0.0 AS v FROM {source}"
    query(name, sql)(lambda spark, sf_dir: fn(load(spark, sf_dir, base)).df)


def packed_vox(name: str, base: str, fn: Callable[[DataFrame], DataFrame], value: str, ctes: str = "", source: str = "v", idx: str = IDX, shape: tuple[int, ...] | None = None) -> None:
    """The same for packed arrays, each worked out within its row; results are of the base's shape unless given."""
    vox(name, base, lambda v: v, value, ctes, source, idx)
    query(name, ORACLES[name])(lambda spark, sf_dir: unpack(fn(pack_rows(spark, sf_dir, base)), shape or BASES[base][0]).df)


# ---- layouts and intensity ----------------------------------------------------------------------

vox("voxel_explode", "2d", lambda v: v, "v")
query("voxel_pack", "SELECT vec_id AS sample_id, array_to_string(list_transform(embedding, lambda x: (round(x::DOUBLE * 1000))::BIGINT::VARCHAR), ',') AS data FROM embeddings")(
    lambda s, d: pack(load(s, d)).select("sample_id", F.array_join(F.transform("data", lambda x: F.round(x * 1000).cast("long").cast("string")), ",").alias("data"))
)
vox("scale_range", "2d", lambda v: intensity.scale_range(v, -1, 1, 0, 255), "(v + 1) / 2 * 255")
vox("scale_range_clip", "2d", lambda v: intensity.scale_range(v, -0.1, 0.1, 0, 1, clipped=True), "least(greatest((v + 0.1) / 0.2, 0), 1)")
vox("scale_range_flat", "2d", lambda v: intensity.scale_range(v, 2, 2, 5, 6, clipped=True), "v - 2 + 5")
vox("scale_inverse", "2d", lambda v: intensity.unscale_range(intensity.scale_range(v, -1, 1, 0, 255), -1, 1, 0, 255), "v")
vox("shift", "2d", lambda v: intensity.shift(v, 0.25), "v + 0.25")
vox("shift_channel", "mc", lambda v: intensity.shift(v, [1, 2, 3, 4]), "v + c + 1")
_norm = "coalesce((v - avg({x}) OVER p) / CASE WHEN stddev_pop({x}) OVER p = 0 THEN 1 ELSE stddev_pop({x}) OVER p END, v)"
packed_vox("normalize_global", "2d", intensity.normalize_packed, _norm.format(x="v"), source="v WINDOW p AS (PARTITION BY sample_id)")
packed_vox("normalize_channel", "mc", lambda p: intensity.normalize_packed(p, channel_wise=True), _norm.format(x="v"), source="v WINDOW p AS (PARTITION BY sample_id, c)")
packed_vox(
    "normalize_nonzero", "2d", lambda p: intensity.normalize_packed(p.withColumn("data", F.transform("data", lambda x: F.greatest(x, F.lit(0.0)))), nonzero=True),
    "CASE WHEN x = 0 THEN x ELSE " + _norm.format(x="nullif(x, 0)").replace("(v -", "(x -").replace(", v)", ", x)") + " END",
    "z AS (SELECT *, greatest(v, 0) AS x FROM v)", "z WINDOW p AS (PARTITION BY sample_id)",
)
vox("fill_empty", "2d", lambda v: intensity.fill_empty(v.values(F.when(F.col("v") > 0, F.col("v")).otherwise(F.lit(float("nan")))), -1), "CASE WHEN v > 0 THEN v ELSE -1 END")

# ---- index permutations and crops ---------------------------------------------------------------

vox("flip_h", "2d", lambda v: spatial.flip(v, "h"), "v", idx="sample_id, d, 7 - h AS h, w, c")
vox("flip_hw", "2d", lambda v: spatial.flip(v, "h", "w"), "v", idx="sample_id, d, 7 - h AS h, 7 - w AS w, c")
for _k, _h, _w in ((1, "7 - w", "h"), (2, "7 - h", "7 - w"), (3, "w", "7 - h")):
    vox(f"rot90_k{_k}", "2d", lambda v, k=_k: spatial.rotate90(v, k), "v", idx=f"sample_id, d, {_h} AS h, {_w} AS w, c")
vox("permute_axes", "3d", lambda v: spatial.permute(v, ("w", "d", "h")), "v", idx="sample_id, w AS d, d AS h, h AS w, c")
vox("crop_start", "2d", lambda v: spatial.crop(v, h=spatial.crop_bounds(8, 4, start=6), w=spatial.crop_bounds(8, 5, start=1)), "v", source="v WHERE h >= 4 AND w BETWEEN 1 AND 5", idx="sample_id, d, h - 4 AS h, w - 1 AS w, c")
vox("crop_center", "2d", lambda v: spatial.crop(v, h=spatial.crop_bounds(8, 4, center=1), w=spatial.crop_bounds(8, 0)), "v", source="v WHERE h < 4")
vox("crop_inverse", "2d", lambda v: spatial.uncrop(spatial.crop(v, h=(2, 6), w=(1, 4)), v.shape, h=2, w=1), "CASE WHEN h BETWEEN 2 AND 5 AND w BETWEEN 1 AND 3 THEN v ELSE 0 END")
_box = """WITH {base}, b AS (SELECT sample_id, min(h) FILTER (v > 0.1) AS h0, max(h) FILTER (v > 0.1) AS h1, min(w) FILTER (v > 0.1) AS w0, max(w) FILTER (v > 0.1) AS w1 FROM v GROUP BY 1),
m AS (SELECT sample_id, greatest(coalesce(h0, 0) - {m}, 0) AS h0, least(coalesce(h1 + 1, 8) + {m}, 8) AS h1, greatest(coalesce(w0, 0) - {m}, 0) AS w0, least(coalesce(w1 + 1, 8) + {m}, 8) AS w1 FROM b)
SELECT sample_id, h0::INT AS start_h, least(h0 + (ceil((h1 - h0) / {k}.0) * {k})::INT, 8)::INT AS end_h, w0::INT AS start_w, least(w0 + (ceil((w1 - w0) / {k}.0) * {k})::INT, 8)::INT AS end_w FROM m"""
for _n, _m, _d in (("foreground_box", 0, 1), ("foreground_margin", 1, 1), ("foreground_divisible", 0, 4)):
    query(_n, _box.format(base=V2, m=_m, k=_d))(lambda s, d, m=_m, k=_d: spatial.foreground_box(load(s, d), m, k, F.col("v") > 0.1))
query("crop_foreground", f"""WITH {V2}, b AS (SELECT sample_id, min(h) AS h0, max(h) AS h1, min(w) AS w0, max(w) AS w1 FROM v WHERE v > 0 GROUP BY 1)
SELECT v.sample_id, d, (h - coalesce(h0, 0))::INT AS h, (w - coalesce(w0, 0))::INT AS w, c, round(v, 6) + 0.0 AS v FROM v LEFT JOIN b USING (sample_id)
WHERE h BETWEEN coalesce(h0, 0) AND coalesce(h1, 7) AND w BETWEEN coalesce(w0, 0) AND coalesce(w1, 7)""")(lambda s, d: spatial.crop_foreground(load(s, d)))

# ---- resampling ---------------------------------------------------------------------------------

_taps = "{t} AS (SELECT i::INT AS t, floor(p)::INT AS f, 1 - (p - floor(p)) AS x FROM (SELECT i, {pos} AS p FROM range({n}) r(i)) UNION ALL SELECT i::INT, least(floor(p) + 1, {m} - 1)::INT, p - floor(p) FROM (SELECT i, {pos} AS p FROM range({n}) r(i)))"


def _half(n: int, m: int) -> str:
    return f"least(greatest((i + 0.5::DOUBLE) * {m}.0::DOUBLE / {n} - 0.5::DOUBLE, 0), {m - 1})"


query("resize2d_bilinear", f"WITH {V2}, {_taps.format(t='a', pos=_half(5, 8), n=5, m=8)}, {_taps.format(t='b', pos=_half(12, 8), n=12, m=8)} SELECT sample_id, d, a.t AS h, b.t AS w, c, round(sum(v * a.x * b.x), 6) + 0.0 AS v FROM v JOIN a ON h = a.f JOIN b ON w = b.f GROUP BY ALL")(
    lambda s, d: spatial.resize(load(s, d), "linear", h=5, w=12).df
)
query("resize3d_trilinear", f"WITH {V3}, {_taps.format(t='a', pos=_half(3, 4), n=3, m=4)}, {_taps.format(t='b', pos=_half(6, 4), n=6, m=4)} SELECT sample_id, a.t AS d, b.t AS h, w, c, round(sum(v * a.x * b.x), 6) + 0.0 AS v FROM v JOIN a ON d = a.f JOIN b ON h = b.f GROUP BY ALL")(
    lambda s, d: spatial.resize(load(s, d, "3d"), "linear", d=3, h=6).df
)
query("resize_align_corners", f"WITH {V3}, {_taps.format(t='a', pos='i * 3.0::DOUBLE / 6', n=7, m=4)} SELECT sample_id, d, h, a.t AS w, c, round(sum(v * a.x), 6) + 0.0 AS v FROM v JOIN a ON w = a.f GROUP BY ALL")(
    lambda s, d: spatial.resize(load(s, d, "3d"), "linear", True, w=7).df
)
query("resize3d_nearest", f"WITH {V3} SELECT sample_id, i::INT AS d, h, w, c, round(v, 6) + 0.0 AS v FROM v JOIN (SELECT i, round_even(i * 3.0::DOUBLE / 5, 0)::INT AS f FROM range(6) r(i)) ON d = f")(
    lambda s, d: spatial.resize(load(s, d, "3d"), "nearest", d=6).df
)
query("depth_truncate", f"WITH {V3} SELECT sample_id, i::INT AS d, h, w, c, round(v, 6) + 0.0 AS v FROM v JOIN (SELECT i, floor(i * 3.0::DOUBLE / 6)::INT AS f FROM range(7) r(i)) ON d = f")(
    lambda s, d: spatial.resize(load(s, d, "3d"), "truncate", d=7).df
)
query("depth_cubic", f"""WITH {V3}, p AS (SELECT i, floor(i * 3.0::DOUBLE / 6)::INT AS l, i * 3.0::DOUBLE / 6 - floor(i * 3.0::DOUBLE / 6) AS f FROM range(7) r(i)),
t AS (SELECT i, least(greatest(l + k - 1, 0), 3) AS f, CASE k WHEN 0 THEN (-f + 2 * f * f - f * f * f) / 2 WHEN 1 THEN (2 - 5 * f * f + 3 * f * f * f) / 2 WHEN 2 THEN (f + 4 * f * f - 3 * f * f * f) / 2 ELSE (f * f * f - f * f) / 2 END AS x FROM p, range(4) r(k))
SELECT sample_id, i::INT AS d, h, w, c, round(sum(v * x), 6) + 0.0 AS v FROM v JOIN t ON d = t.f GROUP BY ALL""")(lambda s, d: spatial.resize(load(s, d, "3d"), "cubic", d=7).df)
_OBLIQUE = (0.9, 0.2, 0.0, -0.3, -0.1, 0.8, 0.1, 0.4, 0.0, 0.1, 1.1, -0.2)
_place = ", ".join(f"{_OBLIQUE[r * 4]}::DOUBLE * d + {_OBLIQUE[r * 4 + 1]}::DOUBLE * h + {_OBLIQUE[r * 4 + 2]}::DOUBLE * w + ({_OBLIQUE[r * 4 + 3]})::DOUBLE AS {n}" for r, n in enumerate("xyz"))
query("affine_trilinear", f"""WITH {V3}, g AS (SELECT vec_id AS sample_id, d::INT AS d, h::INT AS h, w::INT AS w, {_place} FROM embeddings, range(5) a(d), range(4) b(h), range(3) e(w)),
k AS (SELECT *, (floor(x) + i)::INT AS fx, (floor(y) + j)::INT AS fy, (floor(z) + l)::INT AS fz, CASE i WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END * CASE j WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END * CASE l WHEN 1 THEN z - floor(z) ELSE 1 - (z - floor(z)) END AS t FROM g, range(2) a(i), range(2) b(j), range(2) e(l))
SELECT k.sample_id, k.d, k.h, k.w, 0 AS c, round(sum(t * coalesce(v.v, -2)), 6) + 0.0 AS v FROM k LEFT JOIN v ON v.sample_id = k.sample_id AND v.d = fx AND v.h = fy AND v.w = fz GROUP BY ALL""")(
    lambda s, d: unpack(packed.affine_resample(pack_rows(s, d, "3d"), _OBLIQUE, (5, 4, 3), "linear", -2.0), (5, 4, 3, 1)).df
)
query("affine_nearest", f"""WITH {V3}, g AS (SELECT vec_id AS sample_id, d::INT AS d, h::INT AS h, w::INT AS w, {_place} FROM embeddings, range(5) a(d), range(4) b(h), range(3) e(w))
SELECT g.sample_id, g.d, g.h, g.w, 0 AS c, round(coalesce(v.v, -2), 6) + 0.0 AS v FROM g LEFT JOIN v ON v.sample_id = g.sample_id AND v.d = round_even(x, 0) AND v.h = round_even(y, 0) AND v.w = round_even(z, 0)""")(
    lambda s, d: unpack(packed.affine_resample(pack_rows(s, d, "3d"), _OBLIQUE, (5, 4, 3), "nearest", -2.0), (5, 4, 3, 1)).df
)


def _affines(s: SparkSession, d: str) -> DataFrame:
    """An affine per image: spacing 2 on the first axis, flipped; the others from the id."""
    rows = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id")
    step = (F.col("vec_id") % 3 + 1).cast("double")
    flat = [F.lit(0.0), F.lit(0.0), F.lit(-2.0), F.lit(5.0), step, F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(1.5), F.lit(0.0), F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    return rows.select("vec_id", F.array(*flat).alias("a"))


@query("affine_geometry", "SELECT vec_id, (vec_id % 3 + 1)::DOUBLE AS s0, 1.5::DOUBLE AS s1, 2.0::DOUBLE AS s2, false AS aligned, 'ASL' AS codes, 2.5::DOUBLE + 0.0 AS i2, round(-1.0::DOUBLE / (vec_id % 3 + 1), 6) + 0.0 AS i0 FROM embeddings")
def _geometry(s, d):
    out = _affines(s, d)
    sp, inv = scalars.spacing(F.col("a")), scalars.invert(F.col("a"))
    return out.select("vec_id", *[sp.getItem(k).alias(f"s{k}") for k in range(3)], scalars.axis_aligned(F.col("a")).alias("aligned"), scalars.axis_codes(F.col("a")).alias("codes"), inv.getItem(11).alias("i2"), inv.getItem(3).alias("i0"))


@query("affine_output_shape", "SELECT vec_id, 12 AS n0, (4 * (vec_id % 3 + 1))::INT AS n1, 9 AS n2 FROM embeddings")
def _shape(s, d):
    to = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 5, 0, 1, 0, 1, 0, 0, 1, 2, 0, 0, 0, 1)])
    n = scalars.output_shape(F.col("a"), to, (4, 6, 6))
    return _affines(s, d).select("vec_id", *[n.getItem(k).alias(f"n{k}") for k in range(3)])


def _volumes(s: SparkSession, d: str, even: list, odd: list) -> DataFrame:
    """Packed 4x4x4 volumes with one of two affines by vec_id; entries may be columns."""
    pick = lambda x: F.array(*[v.cast("double") if isinstance(v, Column) else F.lit(float(v)) for v in x])
    rows = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    affine = F.when(F.col("vec_id") % 2 == 0, pick(even)).otherwise(pick(odd))
    return rows.select(F.col("vec_id").alias("sample_id"), F.array(*map(F.lit, (4, 4, 4, 1))).alias("shape"), F.col("embedding").cast("array<double>").alias("data"), affine.alias("affine"))


#: Affines of the test volumes, row by row; "step" is vec_id % 3 + 1.
_TURNED = ([0, 0, -2, 5, "step", 0, 0, 1, 0, 1.5, 0, 2, 0, 0, 0, 1], [-1, 0, 0, 5, 0, 2, 0, 1, 0, 0, "step", 2, 0, 0, 0, 1])


def _turned(s: SparkSession, d: str) -> DataFrame:
    """Axes (A, S, L) for even ids and (L, A, S) for odd ones."""
    step = F.col("vec_id") % 3 + 1
    return _volumes(s, d, *[[step if x == "step" else x for x in row] for row in _TURNED])


def _oblique(s: SparkSession, d: str) -> DataFrame:
    """Spacing (1 to 3, 1.5, 2), the first two axes turned by half a right angle, or as in a 3-4-5 triangle."""
    step, r = F.col("vec_id") % 3 + 1, 0.5**0.5
    half = [step * r, -1.5 * r, 0, 5, step * r, 1.5 * r, 0, 1, 0, 0, 2, 2, 0, 0, 0, 1]
    third = [step * 0.6, -1.5 * 0.8, 0, 5, step * 0.8, 1.5 * 0.6, 0, 1, 0, 0, 2, 2, 0, 0, 0, 1]
    return _volumes(s, d, half, third)


_flat = lambda df: df.select("sample_id", F.posexplode("data").alias("i", "v"))
query("orientation", f"WITH {V3} SELECT sample_id, (CASE WHEN sample_id % 2 = 0 THEN h * 16 + d * 4 + 3 - w ELSE w * 16 + h * 4 + 3 - d END)::INT AS i, round(v, 6) + 0.0 AS v FROM v")(lambda s, d: _flat(geometry.orient(_turned(s, d))))
query("orientation_inverse", f"WITH {V3} SELECT sample_id, (d * 16 + h * 4 + w)::INT AS i, round(v, 6) + 0.0 AS v FROM v")(lambda s, d: _flat(geometry.unorient(geometry.orient(_turned(s, d), "LPS"))))


@query("orientation_affine", """SELECT vec_id AS sample_id, 'SAR' AS codes, CASE WHEN vec_id % 2 = 0 THEN 2.0::DOUBLE ELSE 1.0 END AS a2, CASE WHEN vec_id % 2 = 0 THEN -1.0::DOUBLE ELSE 2.0 END AS a3,
CASE WHEN vec_id % 2 = 0 THEN (vec_id % 3 + 1)::DOUBLE ELSE 2.0 END AS a5, CASE WHEN vec_id % 2 = 0 THEN 1.5::DOUBLE ELSE vec_id % 3 + 1 END AS a8, 0.0::DOUBLE AS back FROM embeddings""")
def _oriented_affine(s, d):
    out = geometry.orient(_turned(s, d))
    a = F.col("affine")
    then = geometry.unorient(out).join(_turned(s, d).select("sample_id", F.col("affine").alias("old")), "sample_id")
    same = then.select("sample_id", F.aggregate(F.zip_with("affine", "old", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, x: t + x).alias("back"))
    return out.select("sample_id", scalars.axis_codes(a).alias("codes"), *[a.getItem(k).alias(f"a{k}") for k in (2, 3, 5, 8)]).join(same, "sample_id")


_NEW = "n AS (SELECT vec_id AS sample_id, a, b, c, a * 0.8::DOUBLE / (vec_id % 3 + 1) AS x, b * 1.1::DOUBLE / 1.5 AS y, c * 1.7::DOUBLE / 2 AS z FROM embeddings, range(15) p(a), range(5) q(b), range(5) r(c) WHERE a < floor(4 * (vec_id % 3 + 1) / 0.8 + 0.5))"
query("spacing_nearest", f"""WITH {V3}, {_NEW} SELECT n.sample_id, ((a * 5 + b) * 5 + n.c)::INT AS i, round(coalesce(v.v, -1), 6) + 0.0 AS v
FROM n LEFT JOIN v ON v.sample_id = n.sample_id AND v.d = round_even(x, 0) AND v.h = round_even(y, 0) AND v.w = round_even(z, 0)""")(lambda s, d: _flat(geometry.respace(_oblique(s, d), (0.8, 1.1, 1.7), "nearest", -1.0)))
query("spacing_linear", f"""WITH {V3}, {_NEW}, t AS (SELECT n.*, floor(x) + i AS td, floor(y) + j AS th, floor(z) + k AS tw, abs(1 - i - (x - floor(x))) * abs(1 - j - (y - floor(y))) * abs(1 - k - (z - floor(z))) AS wt FROM n, range(2) f(i), range(2) g(j), range(2) h(k))
SELECT t.sample_id, ((a * 5 + b) * 5 + t.c)::INT AS i, round(sum(wt * coalesce(v.v, -1)), 6) + 0.0 AS v FROM t LEFT JOIN v ON v.sample_id = t.sample_id AND v.d = td AND v.h = th AND v.w = tw GROUP BY ALL""")(
    lambda s, d: _flat(geometry.respace(_oblique(s, d), (0.8, 1.1, 1.7), "linear", -1.0))
)


@query("affine_output_shape_oblique", """WITH e AS (SELECT vec_id, (vec_id % 3 + 1)::DOUBLE AS st, CASE WHEN vec_id % 2 = 0 THEN sqrt(0.5::DOUBLE) ELSE 0.6 END AS co, CASE WHEN vec_id % 2 = 0 THEN sqrt(0.5::DOUBLE) ELSE 0.8 END AS si FROM embeddings)
SELECT vec_id AS sample_id, floor(40 * st * co + 61 * 1.5 * si + 0.5)::INT AS n0, floor(40 * st * si + 61 * 1.5 * co + 0.5)::INT AS n1, 12 AS n2 FROM e""")
def _oblique_shape(s, d):
    world = F.array(*[F.lit(float(k % 5 == 0)) for k in range(16)])
    n = scalars.output_shape(F.col("affine"), world, (40, 61, 6))
    return _oblique(s, d).select("sample_id", *[n.getItem(k).alias(f"n{k}") for k in range(3)])


# ---- sliding windows ----------------------------------------------------------------------------

_starts = "p AS (SELECT (i * 4 + j)::INT AS patch_id, (i * 3 - greatest(i * 3 + 4 - 8, 0))::INT AS sh, (j * 2 - greatest(j * 2 + 3 - 8, 0))::INT AS sw FROM range(3) a(i), range(4) b(j))"
query("patch_slices", f"WITH {V2}, {_starts} SELECT sample_id, patch_id, sh AS start_h, sw AS start_w, round(sum(v), 6) + 0.0 AS total FROM v JOIN p ON h BETWEEN sh AND sh + 3 AND w BETWEEN sw AND sw + 2 GROUP BY ALL")(
    lambda s, d: windows.extract_patches(load(s, d), {"h": 4, "w": 3}).groupBy("sample_id", "patch_id").agg(F.sum("v").alias("total"))
    .join(F.broadcast(windows.patch_table(load(s, d), {"h": 4, "w": 3}, 0.25)), "patch_id")
)
query("patch_extract", f"WITH {V2}, {_starts} SELECT sample_id, patch_id, d, h - sh AS h, w - sw AS w, c, round(v, 6) + 0.0 AS v FROM v JOIN p ON h BETWEEN sh AND sh + 3 AND w BETWEEN sw AND sw + 2")(
    lambda s, d: windows.extract_patches(load(s, d), {"h": 4, "w": 3}).drop("start_h", "start_w")
)
_model = lambda p: p.withColumn("v", F.col("v") + F.col("patch_id"))
for _mode, _wt in (("constant", "1.0::DOUBLE"), ("gaussian", "greatest(exp(-power(h - sh - 1.5, 2) / (2 * 0.25::DOUBLE)) * exp(-power(w - sw - 1.0, 2) / (2 * 0.140625::DOUBLE)), greatest(exp(-2.25 / 0.5::DOUBLE) * exp(-1.0 / 0.28125::DOUBLE), 0.001))")):
    query(f"patch_merge_{_mode}", f"WITH {V2}, {_starts} SELECT sample_id, d, h, w, c, round(sum((v + patch_id) * {_wt}) / sum({_wt}), 6) + 0.0 AS v FROM v JOIN p ON h BETWEEN sh AND sh + 3 AND w BETWEEN sw AND sw + 2 GROUP BY ALL")(
        lambda s, d, m=_mode: windows.sliding_window(load(s, d), {"h": 4, "w": 3}, _model, 0.25, m).df
    )
vox("sliding_identity_3d", "3d", lambda v: windows.sliding_window(v, {"d": 3, "h": 2, "w": 4}, lambda p: p, 0.5, "gaussian"), "v")
for _m, _x in {"constant": "", "edge": "greatest(least(t - 2, 7), 0)", "reflect": "CASE WHEN t < 2 THEN 2 - t WHEN t > 9 THEN 16 - t ELSE t - 2 END", "symmetric": "CASE WHEN t < 2 THEN 1 - t WHEN t > 9 THEN 17 - t ELSE t - 2 END", "wrap": "(t + 6) % 8"}.items():
    _src = f"SELECT sample_id, d, t::INT AS h, w, c, round(v, 6) + 0.0 AS v FROM range(13) p(t) JOIN v ON h = {_x}"
    if _m == "constant":
        _src = "SELECT sample_id, d, t::INT AS h, w, c, round(CASE WHEN t BETWEEN 2 AND 9 THEN v ELSE -3 END, 6) + 0.0 AS v FROM range(13) p(t) JOIN v ON h = greatest(least(t - 2, 7), 0)"
    query(f"pad_{_m}", f"WITH {V2} {_src}")(lambda s, d, m=_m: windows.pad(load(s, d), m, -3.0, h=(2, 3)).df)
for _m in ("constant", "reflect"):
    vox(f"sliding_padded_{_m}", "2d", lambda v, m=_m: windows.sliding_window(v, {"h": 11, "w": 5}, lambda p: p.withColumn("v", F.col("v") * 2 + 1), 0.5, "gaussian", m), "v * 2 + 1")
query("shift_mask", f"""WITH {V2}, x AS (SELECT sample_id, (h // 4 * 2 + w // 4)::INT AS win, ((h % 4) * 4 + w % 4)::INT AS i, v, CASE WHEN h < 4 THEN 'a' WHEN h < 6 THEN 'b' ELSE 'c' END || CASE WHEN w < 4 THEN 'a' WHEN w < 6 THEN 'b' ELSE 'c' END AS r FROM v)
SELECT sample_id, win, i, count(*) AS seen, round(sum(v), 6) + 0.0 AS total FROM (SELECT x.sample_id, x.win, x.i, y.v FROM x JOIN x y ON x.sample_id = y.sample_id AND x.win = y.win AND x.r = y.r) GROUP BY ALL""")(
    lambda s, d: windows.window_partition(load(s, d), h=4, w=4).join(F.broadcast(windows.shift_mask(8, 8, 4, 2, s).where("mask = 0").withColumnRenamed("j", "pos")), ["win", "pos"])
    .groupBy("sample_id", "win", "i").agg(F.count(F.lit(1)).alias("seen"), F.sum("v").alias("total"))
)
query("window_partition", f"WITH {V2} SELECT sample_id, (h // 4 * 4 + w // 2)::INT AS win, (h % 4 * 2 + w % 2)::INT AS pos, c, round(v, 6) + 0.0 AS v FROM v")(lambda s, d: windows.window_partition(load(s, d), h=4, w=2))
vox("window_reverse", "3d", lambda v: windows.window_reverse(v, windows.window_partition(v, d=2, h=4, w=2), d=2, h=4, w=2), "v")
vox("patch_merging", "2d", windows.patch_merging, "v", idx="sample_id, d, (h // 2)::INT AS h, (w // 2)::INT AS w, (h % 2 + 2 * (w % 2))::INT AS c")

# ---- morphology, pooling, convolution -----------------------------------------------------------

_m3 = "{f}({x}) OVER (PARTITION BY sample_id, {o} ORDER BY {a} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
_er = "least(" + _m3.format(f="min", x="v", o="w", a="h") + ", " + _m3.format(f="min", x="v", o="h", a="w") + ")"
packed_vox("erode", "2d", packed.erode, _er)
packed_vox("dilate", "2d", packed.dilate, _m3.format(f="max", x="x", o="h", a="w"), f"y AS (SELECT *, {_m3.format(f='max', x='v', o='w', a='h')} AS x FROM v)", "y")
packed_vox("open", "2d", packed.opened, _m3.format(f="max", x="x", o="h", a="w"), f"e AS (SELECT {IDX}, {_er} AS v FROM v), y AS (SELECT *, {_m3.format(f='max', x='v', o='w', a='h')} AS x FROM e)", "y")
def _skeleton_sql(iterations: int, value: str = "v", name: str = "k") -> str:
    """CTEs up to <name>: the soft skeleton of `value`, one recursion step an iteration."""
    up = lambda f, x, o, a: f"{f}({x}) OVER (PARTITION BY sample_id, {o} ORDER BY {a} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
    thin = lambda x: f"least({up('min', x, 'w', 'h')}, {up('min', x, 'h', 'w')})"
    opened = lambda x, source: f"(SELECT *, {up('max', 'y', 'h', 'w')} AS o FROM (SELECT *, {up('max', 'e', 'w', 'h')} AS y FROM (SELECT *, {thin(x)} AS e FROM {source})))"
    start = f"SELECT 0 AS n, sample_id, h, w, x, greatest(x - o, 0) AS skel FROM {opened('x', f'(SELECT sample_id, h, w, {value} AS x FROM v)')}"
    step = f"SELECT n + 1, sample_id, h, w, x1, skel + greatest(lost - skel * lost, 0) FROM (SELECT *, greatest(x1 - o, 0) AS lost FROM {opened('x1', f'(SELECT *, {thin(chr(120))} AS x1 FROM {name}_all WHERE n < {iterations})')})"
    return f"{name}_all AS ({start} UNION ALL {step}), {name} AS (SELECT sample_id, h, w, skel FROM {name}_all WHERE n = {iterations})"


for _n in (2, 50):
    ORACLES[f"skeleton_{_n}it"] = f"WITH RECURSIVE {V2}, {_skeleton_sql(_n)} SELECT sample_id, 0 AS d, h, w, 0 AS c, round(skel, 6) + 0.0 AS v FROM k"
query("skeleton_2it")(lambda s, d: unpack(regions.skeleton(pack_rows(s, d), 2), (8, 8)).df)
query("skeleton_50it")(lambda s, d: unpack(regions.skeleton(pack_rows(s, d)), (8, 8)).df)
for _f in ("avg", "max"):
    query(f"adaptive_{_f}_pool", f"WITH {V2} SELECT sample_id, d, i::INT AS h, j::INT AS w, c, round({_f}(v), 6) + 0.0 AS v FROM v, range(3) a(i), range(5) b(j) WHERE h >= i * 8 // 3 AND h < ceil((i + 1) * 8 / 3.0) AND w >= j * 8 // 5 AND w < ceil((j + 1) * 8 / 5.0) GROUP BY ALL")(
        lambda s, d, f=_f: morphology.adaptive_pool(load(s, d), f, h=3, w=5).df
    )
vox("upsample", "2d", lambda v: morphology.upsample(v, h=2), "v", source="v, range(2) r(k)", idx="sample_id, d, (h * 2 + k)::INT AS h, w, c")
_K = {(0, i - 1, j - 1): (i + 1) * 0.5 - j * 0.25 for i in range(3) for j in range(3)}
_conv = f"WITH {V2}, k AS (SELECT (i - 1)::INT AS a, (j - 1)::INT AS b, (i + 1) * 0.5::DOUBLE - j * 0.25::DOUBLE AS x FROM range(3) p(i), range(3) q(j)) SELECT o.sample_id, o.d, o.h, o.w, o.c, round(sum(i.v * x), 6) + 0.0 AS v FROM v o, k JOIN v i ON i.sample_id = o.sample_id AND i.h = o.h + a AND i.w = o.w + b GROUP BY ALL"
query("conv3x3", _conv)(lambda s, d: morphology.convolve(load(s, d), _K).df)

_MIX = lambda n: [[[[(i + 1) * 0.5 - j * 0.25 + p * 0.125 - q * 0.375 for q in range(2)] for p in range(4)] for j in range(n)] for i in range(n)]
_mix = "k AS (SELECT i, j, p, q, (i + 1) * 0.5::DOUBLE - j * 0.25::DOUBLE + p * 0.125::DOUBLE - q * 0.375::DOUBLE AS x FROM range({n}) e(i), range({n}) f(j), range(4) g(p), range(2) h(q))"
_mixed = "SELECT sample_id, 0 AS d, oh::INT AS h, ow::INT AS w, q::INT AS c, round(sum(v * x), 6) + 0.0 AS v FROM v JOIN k ON c = p, range({m}) y(oh), range({m}) z(ow) WHERE {on} GROUP BY ALL"
query("conv_channels", f"WITH {MC}, {_mix.format(n=3)} {_mixed.format(m=4, on='h = oh + i - 1 AND w = ow + j - 1')}")(lambda s, d: unpack(packed.convolve(pack_rows(s, d, "mc"), _MIX(3)), (1, 4, 4, 2)).df)
query("conv_channels_stride2", f"WITH {MC}, {_mix.format(n=3)} {_mixed.format(m=2, on='h = oh * 2 + i AND w = ow * 2 + j')}")(lambda s, d: unpack(packed.convolve(pack_rows(s, d, "mc"), _MIX(3), 2), (1, 2, 2, 2)).df)
query("conv_transpose", f"WITH {MC}, {_mix.format(n=2)} {_mixed.format(m=8, on='oh = h * 2 + i AND ow = w * 2 + j')}")(lambda s, d: unpack(packed.convolve_transposed(pack_rows(s, d, "mc"), _MIX(2), 2), (1, 8, 8, 2)).df)

# ---- metrics and losses -------------------------------------------------------------------------


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """Truth and logits of four classes: the largest of four channels, and a shifted copy."""
    v = load(s, d, "mc").df
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("sample_id", "h", "w").orderBy(F.desc("v"), "c"))
    true = F.max(F.when(F.col("r") == 1, F.col("c"))).over(Window.partitionBy("sample_id", "h", "w"))
    logits = F.col("v") * 4 + (F.col("h") - F.col("w")) * F.lit(0.1) * F.col("c")
    return v.withColumn("r", rank).withColumn("true_class", true).select("sample_id", "h", "w", F.col("c").alias("class"), "true_class", (F.col("r") == 1).cast("double").alias("y_true"), logits.alias("y_pred"))


_P = f"""{MC}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, h, w ORDER BY v DESC, c) AS r FROM v),
q AS (SELECT sample_id, h, w, c AS class, max(c) FILTER (r = 1) OVER (PARTITION BY sample_id, h, w) AS true_class, (r = 1)::INT::DOUBLE AS y_true, v * 4 + (h - w) * 0.1::DOUBLE * c AS y_pred FROM r)"""
_SOFT = "e AS (SELECT *, exp(y_pred - max(y_pred) OVER x) AS e FROM q WINDOW x AS (PARTITION BY sample_id, h, w)), s AS (SELECT sample_id, class, true_class, y_true, e / sum(e) OVER (PARTITION BY sample_id, h, w) AS y_pred FROM e)"
_HARD = "s AS (SELECT sample_id, class, true_class, y_true, (row_number() OVER (PARTITION BY sample_id, h, w ORDER BY y_pred DESC, class) = 1)::INT::DOUBLE AS y_pred FROM q)"
_SIGM = "s AS (SELECT sample_id, class, true_class, y_true, (1 / (1 + exp(-y_pred)) > 0.5)::INT::DOUBLE AS y_pred FROM q)"
_DICE = """i AS (SELECT sample_id, class, sum(y_true * y_pred) AS i, sum(y_true) AS t, sum(y_pred) AS p FROM s {where} GROUP BY 1, 2),
f AS (SELECT *, sum(t) OVER (PARTITION BY sample_id) > 0 AND NOT ({empty} AND t = 0 AND p <> 0) AS ok FROM i),
k AS (SELECT class, CASE WHEN sum(ok::INT) > 0 THEN (2 * coalesce(sum(i) FILTER (ok), 0) + 1e-6) / (coalesce(sum(t + p) FILTER (ok), 0) + 1e-6) END AS dice FROM f GROUP BY class)
SELECT {out} FROM k"""
_MEAN = "round(coalesce(avg(dice), 0), 6) + 0.0 AS dice"
query("dice_categorical", f"WITH {_P}, {_HARD}, " + _DICE.format(where="", empty="true", out=_MEAN))(lambda s, d: scores.dice_result(scores.dice_state(scores.hard(_pairs(s, d), "categorical"))))
query("dice_by_class", f"WITH {_P}, {_HARD}, " + _DICE.format(where="", empty="false", out="class, round(dice, 6) + 0.0 AS dice"))(
    lambda s, d: scores.dice_by_class(scores.dice_state(scores.hard(_pairs(s, d), "categorical"), ignore_empty=False))
)
query("dice_binary", f"WITH {_P}, {_SIGM}, " + _DICE.format(where="", empty="true", out=_MEAN))(lambda s, d: scores.dice_result(scores.dice_state(scores.hard(_pairs(s, d), "binary"))))
query("dice_target_ids", f"WITH {_P}, {_SOFT}, " + _DICE.format(where="WHERE class IN (1, 2)", empty="true", out=_MEAN))(
    lambda s, d: scores.dice_result(scores.dice_state(scores.probabilities(_pairs(s, d), "categorical", True), scores.class_ids([1, 2], 4)))
)
query("dice_ignore_ids", f"WITH {_P}, {_HARD}, " + _DICE.format(where="WHERE true_class <> 0", empty="true", out=_MEAN))(
    lambda s, d: scores.dice_result(scores.dice_state(scores.hard(_pairs(s, d), "sparse"), ignored=[0]))
)
_SUMS = "l AS (SELECT *, least(greatest(y_pred, 1e-7), 1 - 1e-7) AS p FROM s), i AS (SELECT sample_id, class, sum(y_true * p) AS i, sum(y_true) AS t, sum(p) AS p, sum(-y_true * ln(p)) AS ce, sum(-(y_true * ln(p) + (1 - y_true) * ln(1 - p))) AS bce, count(*) AS n FROM l GROUP BY 1, 2)"
_LOSS = {"dice": "1 - (2 * i + 1e-7) / (t + p + 1e-7)", "iou": "1 - (i + 1e-7) / (t + p - i + 1e-7)", "tversky": "1 - (i + 1e-7) / (i + 0.3 * (p - i) + 0.7 * (t - i) + 1e-7)"}
_soft = lambda s, d: scores.probabilities(_pairs(s, d), "categorical", True)
for _n, _e in _LOSS.items():
    query(f"loss_{_n}", f"WITH {_P}, {_SOFT}, {_SUMS} SELECT sample_id, class, round({_e}, 6) + 0.0 AS loss FROM i")(lambda s, d, n=_n: scores.overlap_loss(_soft(s, d), n, alpha=0.3, beta=0.7))
for _n, _e in {"square": "1 / (t * t + 1e-7)", "simple": "1 / (t + 1e-7)", "uniform": "1"}.items():
    query(f"loss_gdl_{_n}", f"WITH {_P}, {_SOFT}, {_SUMS}, g AS (SELECT sample_id, sum(CASE WHEN t > 0 THEN {_e} ELSE 0 END * i) AS i, sum(CASE WHEN t > 0 THEN {_e} ELSE 0 END * (t + p)) AS u FROM i GROUP BY 1) SELECT sample_id, round(1 - CASE WHEN u > 0 THEN (2 * i + 1e-7) / (u + 1e-7) ELSE 1 END, 6) + 0.0 AS loss FROM g")(
        lambda s, d, n=_n: scores.generalized_dice_loss(_soft(s, d), n)
    )
query("loss_cross_entropy", f"WITH {_P}, {_SOFT}, {_SUMS} SELECT sample_id, class, round(ce / n, 6) + 0.0 AS loss FROM i")(lambda s, d: scores.cross_entropy(_soft(s, d)))
for _b, _n in ((False, "ce"), (True, "bce")):
    query(f"loss_dice_{_n}", f"WITH {_P}, {_SOFT}, {_SUMS} SELECT sample_id, class, round({_LOSS['dice']} + 0.5 * {_n} / n, 6) + 0.0 AS loss FROM i")(lambda s, d, b=_b: scores.dice_ce_loss(_soft(s, d), b, 1.0, 0.5))
for _n, _e in {"sum": "sum(l)", "mean": "avg(l)", "sum_over_batch_size": "sum(l) / count(DISTINCT sample_id)"}.items():
    query(f"reduction_{_n}", f"WITH {_P}, {_SOFT}, {_SUMS}, o AS (SELECT sample_id, {_LOSS['dice']} AS l FROM i) SELECT round({_e}, 6) + 0.0 AS loss FROM o")(lambda s, d, n=_n: scores.reduced(scores.overlap_loss(_soft(s, d)), n))


_PROB = "s AS (SELECT sample_id, class, true_class, y_true, 1 / (1 + exp(-y_pred)) AS y_pred FROM q)"
_MASKED = "l AS (SELECT *, least(greatest(y_pred, 1e-7), 1 - 1e-7) AS p, {mask} AS m FROM s {where}), i AS (SELECT sample_id, class, sum(m * y_true * p) AS i, sum(m * y_true) AS t, sum(m * p) AS p, sum(-m * y_true * ln(p)) AS ce, sum(-m * (y_true * ln(p) + (1 - y_true) * ln(1 - p))) AS bce, sum(m) AS n FROM l GROUP BY 1, 2)"
_VARIANTS = {
    "binary": (_PROB, _MASKED.format(mask="1.0::DOUBLE", where=""), lambda s, d: scores.probabilities(_pairs(s, d), "binary", True), {}),
    "sparse_ignored": (_SOFT, _MASKED.format(mask="CASE WHEN true_class IN (0, 3) THEN 0.0::DOUBLE ELSE 1.0 END", where=""), lambda s, d: scores.sparse(_soft(s, d).drop("y_true")), {"ignored": [0, 3]}),
    "targets": (_SOFT, _MASKED.format(mask="1.0::DOUBLE", where="WHERE class IN (1, 3)"), _soft, {"targets": [1, 3]}),
}
for _v, (_from, _sums, _rows, _of) in _VARIANTS.items():
    for _n, _e in _LOSS.items():
        query(f"loss_{_n}_{_v}", f"WITH {_P}, {_from}, {_sums} SELECT sample_id, class, round({_e}, 6) + 0.0 AS loss FROM i")(lambda s, d, n=_n, r=_rows, o=_of: scores.overlap_loss(r(s, d), n, alpha=0.3, beta=0.7, **o))
    query(f"loss_cross_entropy_{_v}", f"WITH {_P}, {_from}, {_sums} SELECT sample_id, class, round(bce / greatest(n, 1), 6) + 0.0 AS loss FROM i")(lambda s, d, r=_rows, o=_of: scores.cross_entropy(r(s, d), True, **o))
    query(f"loss_dice_ce_{_v}", f"WITH {_P}, {_from}, {_sums} SELECT sample_id, class, round({_LOSS['dice']} + 0.5 * ce / greatest(n, 1), 6) + 0.0 AS loss FROM i")(lambda s, d, r=_rows, o=_of: scores.dice_ce_loss(r(s, d), False, 1.0, 0.5, **o))
    query(f"loss_gdl_{_v}", f"WITH {_P}, {_from}, {_sums}, g AS (SELECT sample_id, sum(CASE WHEN t > 0 THEN 1 / (t + 1e-7) ELSE 0 END * i) AS i, sum(CASE WHEN t > 0 THEN 1 / (t + 1e-7) ELSE 0 END * (t + p)) AS u FROM i GROUP BY 1) SELECT sample_id, round(1 - CASE WHEN u > 0 THEN (2 * i + 1e-7) / (u + 1e-7) ELSE 1 END, 6) + 0.0 AS loss FROM g")(
        lambda s, d, r=_rows, o=_of: scores.generalized_dice_loss(r(s, d), "simple", **o)
    )


def _cldice_sql(iterations: int) -> str:
    true, pred = "(v > 0)::INT::DOUBLE", "1 / (1 + exp(-4 * v))"
    return f"""WITH RECURSIVE {V2}, {_skeleton_sql(iterations, true, 'kt')}, {_skeleton_sql(iterations, pred, 'kp')},
s AS (SELECT v.sample_id, sum(kp.skel * {true}) AS pt, sum(kp.skel) AS sp, sum(kt.skel * {pred}) AS tp, sum(kt.skel) AS st FROM v JOIN kt USING (sample_id, h, w) JOIN kp USING (sample_id, h, w) GROUP BY 1),
r AS (SELECT sample_id, (pt + 1e-7) / (sp + 1e-7) AS p, (tp + 1e-7) / (st + 1e-7) AS r FROM s) SELECT sample_id, 0 AS class, round(1 - 2 * p * r / (p + r + 1e-7), 6) + 0.0 AS loss FROM r"""


def _cldice(s: SparkSession, d: str, iterations: int) -> DataFrame:
    true, pred = F.transform("data", lambda x: (x > 0).cast("double")), F.transform("data", lambda x: scalars.sigmoid(x * 4))
    return regions.centerline_loss(pack_rows(s, d).select("*", true.alias("y_true"), pred.alias("y_pred")), iterations=iterations)


for _n, _name in ((1, "loss_centerline_dice"), (50, "loss_centerline_dice_50it")):
    query(_name, _cldice_sql(_n))(lambda s, d, n=_n: _cldice(s, d, n))
query("label_dice", """WITH s AS (SELECT lang AS class, toxic::DOUBLE AS t, (n_chars > 1500)::INT::DOUBLE AS p FROM labels JOIN documents USING (doc_id))
SELECT class, round((2 * sum(t * p) + 1e-6) / (sum(t + p) + 1e-6), 6) + 0.0 AS dice FROM s GROUP BY 1""")(
    lambda s, d: scores.dice_by_class(
        s.read.parquet(f"{d}/labels.parquet").join(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id").groupBy(F.col("lang").alias("class")).agg(
            F.sum(F.col("toxic") * (F.col("n_chars") > 1500).cast("int")).cast("double").alias("intersection"), F.sum(F.col("toxic") + (F.col("n_chars") > 1500).cast("int")).cast("double").alias("total"), F.count(F.lit(1)).alias("valid"))
    )
)

# ---- layers -------------------------------------------------------------------------------------

vox("softmax", "mc", layers.softmax, "exp(v - m) / sum(exp(v - m)) OVER (PARTITION BY sample_id, h, w)", "z AS (SELECT *, max(v) OVER (PARTITION BY sample_id, h, w) AS m FROM v)", "z")
_nrm = "(v - avg(v) OVER p) / sqrt(var_pop(v) OVER p + 1e-3)"
for _n, _g in (("layer", "sample_id, h, w"), ("instance", "sample_id, c"), ("batch", "c"), ("group", "sample_id, c // 2")):
    vox(f"norm_{_n}", "mc", lambda v, n=_n: layers.norm(v, n, 1e-3, 2), _nrm, source=f"v WINDOW p AS (PARTITION BY {_g})")
vox("unit_norm", "mc", layers.unit_norm, "v / sqrt(greatest(sum(v * v) OVER (PARTITION BY sample_id, h, w), 1e-12))")
for _n, _e in {"relu": "greatest(v, 0)", "leaky_relu": "CASE WHEN v >= 0 THEN v ELSE v * 0.2 END", "elu": "CASE WHEN v >= 0 THEN v ELSE exp(v) - 1 END", "sigmoid": "1 / (1 + exp(-v))"}.items():
    vox(f"act_{_n}", "2d", lambda v, n=_n: layers.activate(v, n), _e)
vox("grn", "mc", lambda v: layers.global_response_norm(v, 0.5, 0.1), "0.5 * v * g / (avg(g) OVER (PARTITION BY sample_id, h, w) + 1e-6) + 0.1 + v", "z AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY sample_id, c)) AS g FROM v)", "z")
_W = [[0.1 * (i + 1) - 0.05 * o for o in range(3)] for i in range(4)]
query("dense", f"WITH {MC}, g AS (SELECT sample_id, c, avg(v) AS v FROM v GROUP BY 1, 2) SELECT sample_id, o::INT AS c, round(sum(v * (0.1::DOUBLE * (c + 1) - 0.05::DOUBLE * o)), 6) + 0.0 AS v FROM g, range(3) r(o) GROUP BY ALL")(lambda s, d: layers.dense(layers.global_pool(load(s, d, "mc")), _W))
_U = [[0.2 * o - 0.1 * i for o in range(4)] for i in range(3)]
query("squeeze_excitation", f"""WITH {MC}, g AS (SELECT sample_id, c, avg(v) AS v FROM v GROUP BY 1, 2), a AS (SELECT sample_id, o, greatest(sum(v * (0.1::DOUBLE * (c + 1) - 0.05::DOUBLE * o)), 0) AS v FROM g, range(3) r(o) GROUP BY ALL),
b AS (SELECT sample_id, u::INT AS c, 1 / (1 + exp(-sum(v * (0.2::DOUBLE * u - 0.1::DOUBLE * o)))) AS x FROM a, range(4) r(u) GROUP BY ALL) SELECT sample_id, d, h, w, c, round(v * x, 6) + 0.0 AS v FROM v JOIN b USING (sample_id, c)""")(
    lambda s, d: layers.squeeze_excitation(load(s, d, "mc"), _W, _U).df
)
vox("attention_gate", "2d", lambda v: layers.attention_gate(v, spatial.flip(v, "w"), 0.7, 0.4, 1.5), "a.v / (1 + exp(-1.5 * greatest(0.7 * a.v + 0.4 * b.v, 0)))", source="v a JOIN v b ON a.sample_id = b.sample_id AND a.h = b.h AND a.w = 7 - b.w", idx="a.sample_id, a.d, a.h, a.w, a.c")
_said = lambda p: windows.window_partition(unpack(p, (1, 4, 4, 4)), h=2, w=2)
query("window_attention", f"""WITH {MC}, b AS (SELECT sample_id, (h // 2 * 2 + w // 2)::INT AS win, (h % 2 * 2 + w % 2)::INT AS pos, c, v FROM v),
s AS (SELECT q.sample_id, q.win, q.pos AS i, k.pos AS j, sum(q.v * k.v) * 0.5 AS s FROM b q JOIN b k ON q.sample_id = k.sample_id AND q.win = k.win AND q.c = k.c GROUP BY ALL),
e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY sample_id, win, i)) AS e FROM s), p AS (SELECT *, e / sum(e) OVER (PARTITION BY sample_id, win, i) AS p FROM e)
SELECT p.sample_id, p.win, p.i AS pos, k.c, round(sum(p * k.v), 6) + 0.0 AS v FROM p JOIN b k ON k.sample_id = p.sample_id AND k.win = p.win AND k.pos = p.j GROUP BY ALL""")(
    lambda s, d: _said(packed.window_attention(pack_rows(s, d, "mc"), (2, 2), scale=0.5))
)
query("channel_concat", f"WITH {V2} SELECT sample_id, d, h, w, 0 AS c, round(v, 6) + 0.0 AS v FROM v UNION ALL SELECT sample_id, d, h, 7 - w, 1, round(v, 6) + 0.0 FROM v")(lambda s, d: layers.concat_channels(load(s, d), spatial.flip(load(s, d), "w")).df)
query("grad_cam", f"""WITH {MC}, g AS (SELECT sample_id, c, avg(v * v) AS x FROM v GROUP BY 1, 2), m AS (SELECT sample_id, d, h, w, greatest(sum(v * x), 0) AS v FROM v JOIN g USING (sample_id, c) GROUP BY ALL)
SELECT sample_id, d, h, w, 0 AS c, round(CASE WHEN max(v) OVER p > 0 THEN v / max(v) OVER p ELSE 0 END, 6) + 0.0 AS v FROM m WINDOW p AS (PARTITION BY sample_id)""")(
    lambda s, d: layers.grad_cam(load(s, d, "mc"), load(s, d, "mc").values(F.col("v") * F.col("v"))).df
)

# ---- seeded random operators --------------------------------------------------------------------


def _u(*parts: str) -> str:
    return "(('0x' || substr(md5('7|' || " + " || '|' || ".join(f"({p})::VARCHAR" for p in parts) + "), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


vox("random_flip", "2d", lambda v: augment.random_flip(v, 7, 0.5), "v", idx=f"sample_id, d, h, CASE WHEN {_u('sample_id', '0')} < 0.5 THEN 7 - w ELSE w END AS w, c")
vox("random_rot90", "2d", lambda v: augment.random_rotate90(v, 7, 0.8), "v", f"z AS (SELECT *, CASE WHEN {_u('sample_id', '0')} < 0.8 THEN 1 + floor({_u('sample_id', '1')} * 3) ELSE 0 END AS k FROM v)", "z",
    idx="sample_id, d, CASE k WHEN 1 THEN 7 - w WHEN 2 THEN 7 - h WHEN 3 THEN w ELSE h END AS h, CASE k WHEN 1 THEN h WHEN 2 THEN 7 - w WHEN 3 THEN 7 - h ELSE w END AS w, c")
vox("random_shift", "mc", lambda v: augment.random_shift(v, 7, -0.5, 0.5, 0.6, True), f"CASE WHEN {_u('sample_id', '0')} < 0.6 THEN v - 0.5 + {_u('sample_id', '1', 'c')} ELSE v END")
vox("random_crop", "2d", lambda v: augment.random_crop(v, 7, h=3, w=5), "v", f"z AS (SELECT *, floor({_u('sample_id', '0')} * 6)::INT AS y, floor({_u('sample_id', '1')} * 4)::INT AS x FROM v)", "z WHERE h >= y AND h < y + 3 AND w >= x AND w < x + 5", "sample_id, d, h - y AS h, w - x AS w, c")
query("random_posneg", f"""WITH {V2}, z AS (SELECT *, k, {_u('sample_id', 'k', "'-1'")} < 0.75 AS want, {_u('sample_id', 'k', 'd', 'h', 'w', 'c')} AS u FROM v, range(2) r(k))
SELECT sample_id, k::INT AS draw, d, h, w FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, k ORDER BY want <> (v > 0), u, d, h, w) AS r FROM z) WHERE r = 1""")(lambda s, d: augment.crop_centers(load(s, d), 7, 3, 1, 2))
vox("random_cutout", "2d", lambda v: augment.random_cutout(v, 7, {"h": 3, "w": 4}, 1, 0.7, -9.0),
    f"CASE WHEN {_u('sample_id', '0')} < 0.7 AND h >= y - 1 AND h < y + 2 AND w >= x - 2 AND w < x + 2 THEN -9 ELSE v END", f"z AS (SELECT *, floor({_u('sample_id', '1')} * 8) AS y, floor({_u('sample_id', '2')} * 8) AS x FROM v)", "z")
query("random_choice", f"""WITH e AS (SELECT DISTINCT vec_id AS sample_id, k::INT AS choice, [3.0, 1.0, 0.0, 2.0][k + 1]::DOUBLE AS wt FROM embeddings, range(4) r(k)),
g AS (SELECT *, CASE WHEN wt > 0 THEN ln(wt) - ln(-ln(greatest({_u('sample_id', 'choice')}, 1e-6))) ELSE -1e9 END AS k FROM e)
SELECT sample_id, r::INT AS place, choice FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY k DESC, choice) AS r FROM g) WHERE r <= 2 AND wt > 0""")(
    lambda s, d: augment.random_choice(s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("sample_id")), 7, [3, 1, 0, 2], 2)
)
vox("drop_path", "2d", lambda v: augment.drop_path(v, 7, 0.5), f"CASE WHEN {_u('sample_id', '0')} < 0.5 THEN v / 0.5 ELSE 0 END")
query("random_rotate", f"""WITH {V2}, z AS (SELECT *, CASE WHEN {_u('sample_id', '0')} < 0.8 THEN ({_u('sample_id', '1')} * 2 - 1) * 0.5 ELSE 0 END AS a FROM v),
t AS (SELECT *, round_even(sin(a) * (w - 4) + cos(a) * (h - 4) + 4, 0) AS fh, round_even(cos(a) * (w - 4) - sin(a) * (h - 4) + 4, 0) AS fw FROM z)
SELECT t.sample_id, t.d, t.h, t.w, t.c, round(coalesce(v.v, 0), 6) + 0.0 AS v FROM t LEFT JOIN v ON v.sample_id = t.sample_id AND v.h = fh AND v.w = fw""")(lambda s, d: unpack(packed.random_rotate(pack_rows(s, d), 7, 0.5), (8, 8)).df)

# ---- pipelines, catalog, strings, batches -------------------------------------------------------


def _chain() -> transforms.Compose:
    return transforms.Compose(
        transforms.flip("image", "w"), transforms.flip("image", "w"), transforms.rotate90("image", 1), transforms.shift("image", 0.5),
        transforms.scale_range("image", -1, 1, 0, 10), transforms.crop("image", h=(1, 7), w=(2, 8)), transforms.flip("image", "h"), transforms.random_flip("image", 7, 0.5, "w"),
    )


vox("pipeline_apply", "2d", lambda v: _chain()(transforms.Batch({"image": v}))["image"], "(v + 0.5 + 1) / 2 * 10",
    f"z AS (SELECT sample_id, d, c, 7 - w - 1 AS h, h - 2 AS w, v, {_u('sample_id', '0')} < 0.5 AS hit FROM v)", "z WHERE h BETWEEN 0 AND 5 AND w BETWEEN 0 AND 5", "sample_id, d, 5 - h AS h, CASE WHEN hit THEN 5 - w ELSE w END AS w, c")
vox("pipeline_inverse", "2d", lambda v: transforms.Compose.inverse(_chain()(transforms.Batch({"image": v})))["image"], "CASE WHEN 7 - w BETWEEN 1 AND 6 AND h BETWEEN 2 AND 7 THEN v ELSE -1.5 END")
_b = " UNION ALL ".join(f"SELECT '{f}' AS family, '{n}' AS name" for f, ns in catalog.BACKBONES.items() for n in ns.split())
_s = " UNION ALL ".join(f"SELECT '{n}' AS name, '{f}' AS family" for n, fs in catalog.SEGMENTORS.items() for f in fs.split())
_families = sorted({f for fs in catalog.BACKBONES for f in fs.split()} | {f for fs in catalog.SEGMENTORS.values() for f in fs.split()})
_encoders, _heads = sorted({n for ns in catalog.BACKBONES.values() for n in ns.split()}), sorted(catalog.SEGMENTORS)
_pick = lambda names, key: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))
_asked = lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy(_pick(_families, "event_id").alias("family")).agg(F.count(F.lit(1)).alias("asked"))
_ASKED = f"""b AS ({_b}), s AS ({_s}), x AS (SELECT family, string_agg(name, ' ' ORDER BY name) AS backbones FROM b GROUP BY 1), y AS (SELECT family, string_agg(name, ' ' ORDER BY name) AS segmentors FROM s GROUP BY 1),
q AS (SELECT {_families}[event_id % {len(_families)} + 1] AS family, count(*) AS asked FROM events GROUP BY 1)"""
query("registry_catalog", f"WITH {_ASKED} SELECT family, asked, backbones, segmentors FROM q LEFT JOIN x USING (family) LEFT JOIN y USING (family)")(lambda s, d: _asked(s, d).join(catalog.by_family(s), "family", "left"))
query("registry_family", f"WITH {_ASKED} SELECT family, asked, backbones, segmentors FROM q LEFT JOIN x USING (family) LEFT JOIN y USING (family) WHERE family = 'vit'")(lambda s, d: _asked(s, d).join(catalog.by_family(s, "ViT"), "family"))
query("encoder_compat", f"WITH b AS ({_b}), s AS ({_s}), q AS (SELECT {_heads}[event_id % {len(_heads)} + 1] AS segmentor, {_encoders}[user_id % {len(_encoders)} + 1] AS encoder FROM events) SELECT segmentor, encoder, count(*) AS asked FROM q JOIN (SELECT DISTINCT s.name AS segmentor, b.name AS encoder FROM b JOIN s USING (family)) USING (segmentor, encoder) GROUP BY ALL")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select(_pick(_heads, "event_id").alias("segmentor"), _pick(_encoders, "user_id").alias("encoder")).join(F.broadcast(catalog.compatible(s)), ["segmentor", "encoder"]).groupBy("segmentor", "encoder").agg(F.count(F.lit(1)).alias("asked"))
)
query("camel_to_snake", "SELECT DISTINCT event_type, event_type || '_event_loss2_d' AS snake FROM events")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_type").distinct().select("event_type", scalars.camel_to_snake(F.concat(F.upper(F.substring("event_type", 1, 1)), F.expr("substr(event_type, 2)"), F.lit("EventLOSS2D"))).alias("snake"))
)
query("best_score", """WITH m AS (SELECT label AS epoch, avg(embedding[1]::DOUBLE) AS score FROM embeddings GROUP BY 1), e AS (SELECT epoch, (epoch + 1) % 2 = 0 AS ev, CASE WHEN (epoch + 1) % 2 = 0 THEN score ELSE 0 END AS score FROM m)
SELECT epoch, round(score, 6) + 0.0 AS score, ev AND score > coalesce(max(score) FILTER (ev) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-inf'::DOUBLE) AS saved FROM e""")(
    lambda s, d: scores.best_scores(s.read.parquet(f"{d}/embeddings.parquet").groupBy(F.col("label").alias("epoch")).agg(F.avg(F.col("embedding")[0].cast("double")).alias("score")), 2)
)
query("batch_drop_remainder", "SELECT vec_id, batch FROM (SELECT vec_id, ((row_number() OVER (ORDER BY vec_id) - 1) // 48)::BIGINT AS batch FROM embeddings) WHERE batch < (SELECT count(*) // 48 FROM embeddings)")(
    lambda s, d: batched(s.read.parquet(f"{d}/embeddings.parquet").select("vec_id"), "vec_id", 48)
)


def filled_grid(lines: DataFrame) -> DataFrame:
    """(l_linenumber, orders, discount) of a grid in which every order has lines 1 to 7, 0 where it has none.

    An order's lines are gathered as one array, so what is dealt and held is a row an order; the grid's cells are only streamed.
    Lines without an order have cells, but count as none.
    """
    cells = [F.coalesce(F.sum(F.when(F.col("l_linenumber") == k, F.col("l_discount").cast("double"))), F.lit(0.0)) for k in range(1, 8)]
    grid = lines.groupBy("l_orderkey").agg(F.array(*cells).alias("cells")).select("l_orderkey", F.posexplode("cells").alias("at", "x"))
    sums = grid.groupBy("at").agg(F.count("l_orderkey").alias("orders"), F.sum("x").alias("discount"))
    every = lines.sparkSession.range(7).select(F.col("id").cast("int").alias("at"))  # without lines, too
    none = lambda c, zero: F.coalesce(c, F.lit(zero)).alias(c)
    return every.join(F.broadcast(sums), "at", "left").select((F.col("at") + 1).alias("l_linenumber"), none("orders", 0), none("discount", 0.0))


query("sparse_grid_fill", "SELECT k::INT AS l_linenumber, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS orders, round(coalesce((SELECT sum(l_discount::DOUBLE) FROM lineitem l WHERE l.l_linenumber = k), 0), 6) + 0.0 AS discount FROM range(1, 8) r(k)")(
    lambda s, d: filled_grid(s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_discount"))
)


@query("flagship_normalized_dice", f"""WITH {V2}, n AS (SELECT v.*, label, (v - avg(v) OVER p) / CASE WHEN stddev_pop(v) OVER p = 0 THEN 1 ELSE stddev_pop(v) OVER p END AS z FROM v JOIN embeddings ON vec_id = sample_id WINDOW p AS (PARTITION BY sample_id)),
s AS (SELECT label AS class, (v > 0)::INT AS t, (1 / (1 + exp(-z)) > 0.5)::INT AS p FROM n) SELECT class, round((2 * sum(t * p) + 1e-6) / (sum(t + p) + 1e-6), 6) + 0.0 AS dice FROM s GROUP BY 1""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised images: Dice of their sign against the raw values' sign, by label."""
    rows = pack_rows(spark, sf_dir, more=[F.col("embedding").cast("array<double>").alias("raw"), F.col("label").alias("class")])
    one = lambda x: F.when(x, 1.0).otherwise(0.0)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    shown = intensity.normalize_packed(rows).select("class", F.transform("raw", lambda x: one(x > 0)).alias("t"), F.transform("data", lambda x: one(scalars.sigmoid(x) > 0.5)).alias("p"))
    state = shown.groupBy("class").agg(
        F.sum(add(F.zip_with("t", "p", lambda t, p: t * p))).alias("intersection"), F.sum(add("t") + add("p")).alias("total"), F.sum(F.size("t")).alias("valid")
    )
    return scores.dice_by_class(state)


for _n, _base, _how in (("global", "2d", {}), ("channel", "mc", {"channel_wise": True})):
    query(f"normalize_packed_{_n}", ORACLES[f"normalize_{_n}"])(lambda s, d, b=_base, h=_how: unpack(intensity.normalize_packed(pack_rows(s, d, b), **h), BASES[b][0]).df)
query("normalize_packed_nonzero", ORACLES["normalize_nonzero"])(
    lambda s, d: unpack(intensity.normalize_packed(pack_rows(s, d, "2d").withColumn("data", F.transform("data", lambda x: F.greatest(x, F.lit(0.0)))), nonzero=True), (8, 8)).df
)

# ---- whole arrays, and compositions of the operators above --------------------------------------


def _component_sql(bridge: int) -> str:
    return f"""WITH RECURSIVE {V2}, m AS (SELECT sample_id, h, w FROM v WHERE v > 0.1), x AS (SELECT a.h::INT AS h, b.w::INT AS w FROM range(8) a(h), range(8) b(w)),
g AS (SELECT DISTINCT m.sample_id, x.h, x.w FROM m JOIN x ON abs(x.h - m.h) <= {bridge} AND abs(x.w - m.w) <= {bridge}),
r AS (SELECT sample_id, h, w, h * 8 + w AS root FROM g UNION SELECT g.sample_id, g.h, g.w, r.root FROM r JOIN g ON g.sample_id = r.sample_id AND abs(g.h - r.h) <= 1 AND abs(g.w - r.w) <= 1),
l AS (SELECT sample_id, h, w, min(root) AS root FROM r GROUP BY ALL), n AS (SELECT sample_id, root, count(*) AS n FROM l GROUP BY ALL),
k AS (SELECT sample_id, root FROM n QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, root) = 1)
SELECT v.sample_id, (v.h * 8 + v.w)::INT AS i, CASE WHEN v.v > 0.1 AND k.root IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0 END AS v
FROM v LEFT JOIN l ON l.sample_id = v.sample_id AND l.h = v.h AND l.w = v.w LEFT JOIN k ON k.sample_id = l.sample_id AND k.root = l.root"""


for _n in (0, 1):
    query(f"largest_component_{_n}", _component_sql(_n))(lambda s, d, n=_n: _flat(regions.largest_component(pack(load(s, d).values((F.col("v") > 0.1).cast("double"))), n)))

_DRAWN = f"""z AS (SELECT *, k, {_u('sample_id', 'k', "'-1'")} < 0.75 AS want, {_u('sample_id', 'k', 'd', 'h', 'w', 'c')} AS u FROM v, range(2) r(k)),
p AS (SELECT sample_id, k::INT AS draw, h, w FROM z QUALIFY row_number() OVER (PARTITION BY sample_id, k ORDER BY want <> (v > 0), u, d, h, w) = 1)"""
query("crop_posneg", f"""WITH {V2}, {_DRAWN}, b AS (SELECT sample_id, draw, greatest(least(greatest(h - 1, 0), 5), 0) AS y, greatest(least(greatest(w - 2, 0), 4), 0) AS x FROM p)
SELECT sample_id, draw, d, (h - y)::INT AS h, (w - x)::INT AS w, c, round(v, 6) + 0.0 AS v FROM v JOIN b USING (sample_id) WHERE h - y BETWEEN 0 AND 2 AND w - x BETWEEN 0 AND 3""")(
    lambda s, d: augment.crop_around(load(s, d), augment.crop_centers(load(s, d), 7, 3, 1, 2), h=3, w=4)
)
vox("cutout_slices", "3d", lambda v: augment.random_cutout(v, 7, {"h": 2, "w": 2}, 1, 0.7, -9.0, by_slice=True),
    f"CASE WHEN {_u('sample_id', '0')} < 0.7 AND h >= y - 1 AND h < y + 1 AND w >= x - 1 AND w < x + 1 THEN -9 ELSE v END", f"z AS (SELECT *, floor({_u('sample_id', '1', 'd')} * 4) AS y, floor({_u('sample_id', '2', 'd')} * 4) AS x FROM v)", "z")
_NOISE = ", ".join(f"{_u(chr(39) + k + chr(39), 'sample_id', 'd', 'h', 'w', 'c')} AS {n}" for k, n in (("r", "u1"), ("a", "u2")))
vox("cutout_noise", "2d", lambda v: augment.random_cutout(v, 7, {"h": 3, "w": 4}, 1, 0.7, deviation=0.1),
    f"CASE WHEN {_u('sample_id', '0')} < 0.7 AND h >= y - 1 AND h < y + 2 AND w >= x - 2 AND w < x + 2 THEN (max(v) OVER q - min(v) OVER q) * (g - min(g) OVER q) / (max(g) OVER q - min(g) OVER q + 1e-8) + min(v) OVER q ELSE v END",
    f"n AS (SELECT *, {_NOISE} FROM v), z AS (SELECT *, sqrt(-2 * ln(1 - u1)) * cos(2 * pi() * u2) * 0.1 AS g, floor({_u('sample_id', '1')} * 8) AS y, floor({_u('sample_id', '2')} * 8) AS x FROM n)", "z WINDOW q AS (PARTITION BY sample_id)")
_CHOSEN = f"""e AS (SELECT vec_id AS sample_id, k::INT AS choice, [3.0, 1.0, 0.0, 2.0][k + 1]::DOUBLE AS wt FROM embeddings, range(4) r(k)),
o AS (SELECT sample_id, choice, row_number() OVER (PARTITION BY sample_id ORDER BY ln(wt) - ln(-ln(greatest({_u('sample_id', 'choice')}, 1e-6))) DESC, choice) AS r FROM e WHERE wt > 0),
z AS (SELECT v.*, a.choice AS a, b.choice AS b FROM v JOIN o a ON a.sample_id = v.sample_id AND a.r = 1 JOIN o b ON b.sample_id = v.sample_id AND b.r = 2),
y AS (SELECT *, CASE a WHEN 0 THEN v + 1 WHEN 1 THEN v * 2 ELSE v END AS x FROM z)"""
vox("random_choice_applied", "2d", lambda v: augment.random_choice_applied(v, 7, [{"v": F.col("v") + 1}, {"v": F.col("v") * 2}, {"v": F.lit(-9.0)}, {"w": F.lit(7) - F.col("w")}], [3, 1, 0, 2], 2),
    "CASE b WHEN 0 THEN x + 1 WHEN 1 THEN x * 2 ELSE x END", _CHOSEN, "y", "sample_id, d, h, CASE WHEN a = 3 OR b = 3 THEN 7 - w ELSE w END AS w, c")
_BIAS = ([0.1, -0.2, 0.3], [0.5, 0.25, 0.125, -0.5])
query("mlp", f"""WITH {MC}, g AS (SELECT sample_id, c, avg(v) AS v FROM v GROUP BY 1, 2), a AS (SELECT sample_id, o, sum(v * (0.1::DOUBLE * (c + 1) - 0.05::DOUBLE * o)) + max([0.1, -0.2, 0.3][o + 1]::DOUBLE) AS x FROM g, range(3) r(o) GROUP BY ALL),
b AS (SELECT sample_id, o, x / (1 + exp(-1.5957691216057308 * (x + 0.044715 * x * x * x))) AS v FROM a)
SELECT sample_id, u::INT AS c, round(sum(v * (0.2::DOUBLE * u - 0.1::DOUBLE * o)) + max([0.5, 0.25, 0.125, -0.5][u + 1]::DOUBLE), 6) + 0.0 AS v FROM b, range(4) r(u) GROUP BY ALL""")(
    lambda s, d: layers.mlp(layers.global_pool(load(s, d, "mc")), _W, _U, _BIAS)
)
query("conv_separable", f"""WITH {MC}, k AS (SELECT (i - 1)::INT AS a, (j - 1)::INT AS b, (i + 1) * 0.5::DOUBLE - j * 0.25::DOUBLE AS x FROM range(3) p(i), range(3) q(j)),
t AS (SELECT o.sample_id, o.d, o.h, o.w, o.c, sum(i.v * x) AS v FROM v o, k JOIN v i ON i.sample_id = o.sample_id AND i.c = o.c AND i.h = o.h + a AND i.w = o.w + b GROUP BY ALL)
SELECT sample_id, d, h, w, u::INT AS c, round(sum(v * (0.1::DOUBLE * (c + 1) - 0.05::DOUBLE * u)), 6) + 0.0 AS v FROM t, range(3) r(u) GROUP BY ALL""")(lambda s, d: unpack(packed.separable(pack_rows(s, d, "mc"), [[[[_K[0, i - 1, j - 1]]] * 4 for j in range(3)] for i in range(3)], _W), (1, 4, 4, 3)).df)
query("attention_heads_masked", f"""WITH {MC}, b AS (SELECT sample_id, (h // 2 * 2 + w // 2)::INT AS win, (h % 2 * 2 + w % 2)::INT AS pos, c, c // 2 AS hd, v,
CASE WHEN h < 2 THEN 'a' WHEN h < 3 THEN 'b' ELSE 'c' END || CASE WHEN w < 2 THEN 'a' WHEN w < 3 THEN 'b' ELSE 'c' END AS r FROM v),
s AS (SELECT q.sample_id, q.win, q.hd, q.pos AS i, k.pos AS j, sum(q.v * k.v) * 0.5 + CASE WHEN q.r = k.r THEN 0 ELSE -100 END AS s FROM b q JOIN b k ON q.sample_id = k.sample_id AND q.win = k.win AND q.c = k.c GROUP BY q.sample_id, q.win, q.hd, q.pos, k.pos, q.r, k.r),
e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY sample_id, win, hd, i)) AS e FROM s), p AS (SELECT *, e / sum(e) OVER (PARTITION BY sample_id, win, hd, i) AS p FROM e)
SELECT p.sample_id, p.win, p.i AS pos, k.c, round(sum(p * k.v), 6) + 0.0 AS v FROM p JOIN b k ON k.sample_id = p.sample_id AND k.win = p.win AND k.hd = p.hd AND k.pos = p.j GROUP BY ALL""")(
    lambda s, d: _said(packed.window_attention(pack_rows(s, d, "mc"), (2, 2), 2, 0.5, shift=1, rolled=False))
)
query("target_class", f"WITH {MC}, g AS (SELECT sample_id, c, avg(v) AS v FROM v GROUP BY 1, 2) SELECT sample_id, round(max(v), 6) + 0.0 AS top, round(max(v) FILTER (c = 2), 6) + 0.0 AS chosen FROM g GROUP BY 1")(
    lambda s, d: layers.class_target(layers.global_pool(load(s, d, "mc"))).withColumnRenamed("target", "top").join(layers.class_target(layers.global_pool(load(s, d, "mc")), 2).withColumnRenamed("target", "chosen"), "sample_id")
)
_CELLS = "t AS (SELECT sample_id, h, w, max(v) FILTER (c = 1) AS v, max(v) FILTER (c = 1) = max(v) AND coalesce(max(v) FILTER (c < 1) < max(v), true) AS hit FROM v GROUP BY 1, 2, 3)"
for _m, _e in {"all": "sum(v)", "object": "sum(CASE WHEN hit THEN v ELSE 0 END)", "single": "max(v) * count(*) FILTER (v = top)"}.items():
    query(f"target_region_{_m}", f"WITH {MC}, {_CELLS} SELECT sample_id, round({_e}, 6) + 0.0 AS target FROM (SELECT *, max(v) OVER (PARTITION BY sample_id) AS top FROM t) GROUP BY 1")(
        lambda s, d, m=_m: layers.region_target(load(s, d, "mc"), m, 1)
    )
query("target_region_binary", f"WITH {V2} SELECT sample_id, round(sum(CASE WHEN v > 0 THEN v ELSE 0 END), 6) + 0.0 AS target FROM v GROUP BY 1")(lambda s, d: layers.region_target(load(s, d), "object"))
_ids = lambda s, d: load(s, d).values(F.pmod(F.col("h") + F.col("sample_id"), F.lit(4)).cast("double"))
query("label_channels", f"WITH {V2} SELECT sample_id, d, h, w, k::INT AS c, CASE WHEN list_contains([[1, 3], [1, 2, 3], [3]][k + 1], (h + sample_id) % 4) THEN 1.0::DOUBLE ELSE 0.0 END AS v FROM v, range(3) r(k)")(
    lambda s, d: spatial.label_channels(_ids(s, d), [[1, 3], [1, 2, 3], [3]]).df
)
_corner = lambda t, n: _taps.format(t=t, pos=f"i * 3.0::DOUBLE / {n - 1}", n=n, m=4)
_decoded = lambda s, d: spatial.decode_for_training(load(s, d, "3d"), load(s, d, "3d").values((F.col("v") > 0).cast("double")), {"d": 6, "h": 5, "w": 3}, 2, 2)
query("decode_image", f"WITH {V3}, {_corner('a', 6)}, {_corner('b', 5)}, {_corner('e', 3)} SELECT sample_id, a.t AS d, b.t AS h, e.t AS w, k::INT AS c, round(sum(v * a.x * b.x * e.x), 6) + 0.0 AS v FROM v JOIN a ON d = a.f JOIN b ON h = b.f JOIN e ON w = e.f, range(2) r(k) GROUP BY ALL")(
    lambda s, d: _decoded(s, d)[0].df
)
query("decode_label", f"""WITH {V3} SELECT sample_id, i::INT AS d, j::INT AS h, l::INT AS w, k::INT AS c, ((v > 0)::INT = k)::INT::DOUBLE AS v FROM v JOIN (SELECT i, round_even(i * 3.0::DOUBLE / 5, 0)::INT AS f FROM range(6) r(i)) a ON d = a.f
JOIN (SELECT j, round_even(j * 3.0::DOUBLE / 4, 0)::INT AS f FROM range(5) r(j)) b ON h = b.f JOIN (SELECT l, round_even(l * 3.0::DOUBLE / 2, 0)::INT AS f FROM range(3) r(l)) e ON w = e.f, range(2) r(k)""")(lambda s, d: _decoded(s, d)[1].df)
vox("dropout", "2d", lambda v: layers.dropout(v, 7, 0.25), f"CASE WHEN {_u('sample_id', 'd', 'h', 'w', 'c')} < 0.75 THEN v / 0.75 ELSE 0 END")
for _n, _e in {"tanh": "tanh(v)", "gelu": "v / (1 + exp(-1.5957691216057308 * (v + 0.044715 * v * v * v)))"}.items():
    vox(f"act_{_n}", "2d", lambda v, n=_n: layers.activate(v, n), _e)

from . import packed_queries as _packed_queries  # noqa: E402, F401  both register their own
from . import record_queries as _record_queries  # noqa: E402, F401
