"""Registered queries of records and packed volumes, each with DuckDB SQL over the same tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .operators import attention as A
from .operators import geometry, layers, packed, regions
from .operators import tiles as T
from .operators import windows
from .plans import records as R
from .queries import MC, V2, V3, _component_sql, _flat, _skeleton_sql, _model, _NEW, _oblique, _starts, _u, _volumes, _said, load, pack_rows, query, vox
from .sources import tables, tfrecords
from .streaming import metrics


def cell(shape: tuple[int, ...], data: Column) -> Column:
    return F.struct(F.array(*map(F.lit, shape)).alias("shape"), data.cast("array<double>").alias("data"))


def recs(s: SparkSession, d: str, shape: tuple[int, ...] = (8, 8, 1), **keys: Column) -> DataFrame:
    """embeddings as records: an image, and further arrays of its shape made from it."""
    rows = s.read.parquet(f"{d}/embeddings.parquet")
    more = [cell(shape, x).alias(k) for k, x in keys.items()]
    return rows.select(F.col("vec_id").alias("sample_id"), cell(shape, F.col("embedding")).alias("image"), *more)


def label(low: float) -> Column:
    return F.transform("embedding", lambda x: (x > low).cast("double"))


def flat(df: DataFrame, key: str = "image") -> DataFrame:
    return df.select("sample_id", F.posexplode(f"{key}.data").alias("i", "v"))


# ---- spacing -----------------------------------------------------------------------------------

UP, DOWN = (0.8, 1.1, 1.7), (2.5, 3.0, 4.0)


def _diagonal(s: SparkSession, d: str) -> DataFrame:
    """Axes along the world's, one of them backwards; spacing (1 to 3, 1.5, 2)."""
    step = F.col("vec_id") % 3 + 1
    a = [step, 0, 0, 5, 0, -1.5, 0, 1, 0, 0, 2, 2, 0, 0, 0, 1]
    return _volumes(s, d, a, a)


def _sizes(pixdim: tuple[float, ...], where: str = "true") -> str:
    size = lambda old, new: f"greatest(floor(4 * {old}::DOUBLE / {new}::DOUBLE + 0.5), 1)::INT"
    return f"""n AS (SELECT vec_id AS sample_id, {size("(vec_id % 3 + 1)", pixdim[0])} AS n0, {size("1.5", pixdim[1])} AS n1, {size("2", pixdim[2])} AS n2 FROM embeddings WHERE {where}),
g AS (SELECT n.*, a, b, e FROM n, range(15) p(a), range(6) q(b), range(6) r(e) WHERE a < n0 AND b < n1 AND e < n2)"""


def _linear(pixdim: tuple[float, ...], where: str = "true") -> str:
    at = lambda i, n: f"least(greatest(({i} + 0.5::DOUBLE) * (4.0::DOUBLE / {n}) - 0.5::DOUBLE, 0), 3)"
    return f"""{_sizes(pixdim, where)}, x AS (SELECT *, {at("a", "n0")} AS x, {at("b", "n1")} AS y, {at("e", "n2")} AS z FROM g),
w AS (SELECT x.*, least(floor(x) + i, 3) AS td, least(floor(y) + j, 3) AS th, least(floor(z) + k, 3) AS tw, abs(1 - i - (x - floor(x))) * abs(1 - j - (y - floor(y))) * abs(1 - k - (z - floor(z))) AS wt FROM x, range(2) f(i), range(2) g(j), range(2) h(k)),
al AS (SELECT w.sample_id, ((a * n1 + b) * n2 + e)::INT AS i, round(sum(wt * v.v), 6) + 0.0 AS v FROM w JOIN v ON v.sample_id = w.sample_id AND v.d = td AND v.h = th AND v.w = tw GROUP BY ALL)"""


_near = lambda i, n, m: f"CASE WHEN {n} > 1 THEN round_even({i} * ({m}.0::DOUBLE / ({n} - 1)), 0) ELSE 0 END"
for _n, _p in (("up", UP), ("down", DOWN)):
    query(f"spacing_aligned_linear_{_n}", f"WITH {V3}, {_linear(_p)} SELECT * FROM al")(lambda s, d, p=_p: _flat(geometry.respace(_diagonal(s, d), p)))
    query(f"spacing_aligned_nearest_{_n}", f"""WITH {V3}, {_sizes(_p)} SELECT g.sample_id, ((a * n1 + b) * n2 + e)::INT AS i, round(v, 6) + 0.0 AS v
FROM g JOIN v ON v.sample_id = g.sample_id AND v.d = {_near("a", "n0", 3)} AND v.h = {_near("b", "n1", 3)} AND v.w = {_near("e", "n2", 3)}""")(lambda s, d, p=_p: _flat(geometry.respace(_diagonal(s, d), p, "nearest")))
# there and back: the places that the second resize takes from the first one's
_back = lambda i, n: _near(f"(round_even({i} * (({n} - 1)::DOUBLE / 3), 0))", n, 3)
query("spacing_inverse_aligned", f"""WITH {V3}, {_sizes(DOWN)}, o AS (SELECT n.*, a, b, e FROM n, range(4) p(a), range(4) q(b), range(4) r(e))
SELECT o.sample_id, ((a * 4 + b) * 4 + e)::INT AS i, round(v, 6) + 0.0 AS v FROM o JOIN v ON v.sample_id = o.sample_id AND v.d = {_back("a", "n0")} AND v.h = {_back("b", "n1")} AND v.w = {_back("e", "n2")}""")(
    lambda s, d: _flat(geometry.unspace(geometry.respace(_diagonal(s, d), DOWN, "nearest"), "nearest"))
)
query("spacing_mixed_affines", f"""WITH {V3}, {_linear(UP, "vec_id % 2 = 0")}, {_NEW.replace("n AS", "m AS", 1)},
t AS (SELECT m.*, floor(x) + i AS td, floor(y) + j AS th, floor(z) + k AS tw, abs(1 - i - (x - floor(x))) * abs(1 - j - (y - floor(y))) * abs(1 - k - (z - floor(z))) AS wt FROM m, range(2) f(i), range(2) g(j), range(2) h(k) WHERE sample_id % 2 = 1)
SELECT * FROM al UNION ALL SELECT t.sample_id, ((a * 5 + b) * 5 + t.c)::INT AS i, round(sum(wt * coalesce(v.v, 0)), 6) + 0.0 AS v FROM t LEFT JOIN v ON v.sample_id = t.sample_id AND v.d = td AND v.h = th AND v.w = tw GROUP BY ALL""")(
    lambda s, d: _flat(geometry.respace(_diagonal(s, d).where("sample_id % 2 = 0").unionByName(_oblique(s, d).where("sample_id % 2 = 1")), UP))
)


@query("spacing_record", f"""WITH {V3}, {_linear(UP)} SELECT sample_id, i, v, 0 AS steps_left, 64 AS n_back FROM al""")
def _spacing_record(s, d):
    """Spacing as a step of a record, which also undoes it."""
    rows = _diagonal(s, d).select("sample_id", F.struct("shape", "data").alias("image"), "affine")
    p = R.Pipeline(R.Spacing("image", pixdim=UP))
    there = p(rows)
    back = p.inverse(there).select("sample_id", F.size("trace").alias("steps_left"), F.size("image.data").alias("n_back"))
    return flat(there).join(back, "sample_id")


# ---- crops -------------------------------------------------------------------------------------

_size = lambda k, low, n: f"{low} + floor({_u('sample_id', chr(39) + 'size' + chr(39), str(k))} * ({n} - {low} + 1))"
_center = lambda attempt, k, size: f"floor({_u('sample_id', chr(39) + 'center' + chr(39), str(attempt), str(k))} * (8 - {size} + 1)) + {size} // 2"
_start = lambda c, n: f"greatest(least(greatest({c} - {n} // 2, 0) + {n}, 8) - {n}, 0)"
query("random_crop_shape", f"""WITH {V2}, s AS (SELECT vec_id AS sample_id, ({_size(0, 2, 6).replace("sample_id", "vec_id")})::INT AS sh, ({_size(1, 3, 8).replace("sample_id", "vec_id")})::INT AS sw FROM embeddings),
c AS (SELECT *, ({_center(0, 0, "sh")})::INT AS ch, ({_center(0, 1, "sw")})::INT AS cw FROM s), b AS (SELECT *, {_start("ch", "sh")} AS y, {_start("cw", "sw")} AS x FROM c)
SELECT v.sample_id, ((h - y) * sw + w - x)::INT AS i, round(v, 6) + 0.0 AS v FROM v JOIN b USING (sample_id) WHERE h >= y AND h < y + sh AND w >= x AND w < x + sw""")(
    lambda s, d: flat(R.Pipeline(R.RandomSpatialCrop("image", seed=7, size=(2, 3), most=(6, 0), random_shape=True))(recs(s, d)))
)
_ratio = lambda k: f"(SELECT count(*) FROM v WHERE v.sample_id = c{k}.sample_id AND v > 0.1 AND h >= {_start('ch', 3)} AND h < {_start('ch', 3)} + 3 AND w >= {_start('cw', 4)} AND w < {_start('cw', 4)} + 4)"
_LABELLED = f"""l AS (SELECT sample_id, h, w, row_number() OVER (PARTITION BY sample_id ORDER BY h, w) - 1 AS r, count(*) OVER (PARTITION BY sample_id) AS n FROM v WHERE v > 0.1),
c0 AS (SELECT vec_id AS sample_id, coalesce(l.h, {_center(0, 0, 3).replace("sample_id", "vec_id")})::INT AS ch, coalesce(l.w, {_center(0, 1, 4).replace("sample_id", "vec_id")})::INT AS cw
FROM embeddings LEFT JOIN l ON l.sample_id = vec_id AND r = floor({_u("vec_id", "'label'")} * n)),
c1 AS (SELECT sample_id, CASE WHEN ok THEN ch ELSE ({_center(1, 0, 3)})::INT END AS ch, CASE WHEN ok THEN cw ELSE ({_center(1, 1, 4)})::INT END AS cw FROM (SELECT *, {_ratio(0)} >= 6 AS ok FROM c0)),
c2 AS (SELECT sample_id, CASE WHEN ok THEN ch ELSE ({_center(2, 0, 3)})::INT END AS ch, CASE WHEN ok THEN cw ELSE ({_center(2, 1, 4)})::INT END AS cw FROM (SELECT *, {_ratio(1)} >= 6 AS ok FROM c1)),
b AS (SELECT sample_id, {_start("ch", 3)} AS y, {_start("cw", 4)} AS x FROM c2)"""
_crop = R.Pipeline(R.RandomSpatialCrop(("image", "label"), seed=7, size=(3, 4), invalid=0, ratio=0.5, attempts=2))
query("random_crop_labelled", f"WITH {V2}, {_LABELLED} SELECT v.sample_id, ((h - y) * 4 + w - x)::INT AS i, round(v, 6) + 0.0 AS v FROM v JOIN b USING (sample_id) WHERE h >= y AND h < y + 3 AND w >= x AND w < x + 4")(
    lambda s, d: flat(_crop(recs(s, d, label=label(0.1))))
)
query("random_crop_inverse", f"WITH {V2}, {_LABELLED} SELECT v.sample_id, (h * 8 + w)::INT AS i, CASE WHEN h >= y AND h < y + 3 AND w >= x AND w < x + 4 AND v > 0.1 THEN 1.0::DOUBLE ELSE 0.0 END AS v FROM v JOIN b USING (sample_id)")(
    lambda s, d: flat(_crop.inverse(_crop(recs(s, d, label=label(0.1)))), "label")
)

_side = f"{_u('vec_id', chr(39) + 'side' + chr(39))} < 0.6"
query("random_crop_by_label", f"""WITH {V2}, e AS (SELECT vec_id AS sample_id, {_side} AS pos, {_u('vec_id', chr(39) + 'place' + chr(39))} AS u, {_u('vec_id', chr(39) + 'any' + chr(39), '0')} AS u0, {_u('vec_id', chr(39) + 'any' + chr(39), '1')} AS u1 FROM embeddings),
f AS (SELECT v.sample_id, h, w, row_number() OVER (PARTITION BY v.sample_id ORDER BY h, w) - 1 AS r, count(*) OVER (PARTITION BY v.sample_id) AS n FROM v JOIN e USING (sample_id) WHERE CASE WHEN pos THEN v > 0.1 ELSE v <= 0.1 AND v > -0.05 END),
c AS (SELECT e.sample_id, coalesce(f.h, floor(u0 * 8))::INT AS ch, coalesce(f.w, floor(u1 * 8))::INT AS cw FROM e LEFT JOIN f ON f.sample_id = e.sample_id AND f.r = floor(u * n)), b AS (SELECT *, {_start("ch", 3)} AS y, {_start("cw", 4)} AS x FROM c)
SELECT v.sample_id, ((h - y) * 4 + w - x)::INT AS i, round(v, 6) + 0.0 AS v FROM v JOIN b USING (sample_id) WHERE h >= y AND h < y + 3 AND w >= x AND w < x + 4""")(
    lambda s, d: flat(R.Pipeline(R.RandomCropByLabel(("image", "label"), seed=7, size=(3, 4), positive=3, negative=2, reference="image", threshold=-0.05))(recs(s, d, label=label(0.1))))
)

_MASK = "m AS (SELECT sample_id, h, w FROM v WHERE c IN (1, 3) AND v > 0.15)"
_OPTIONS = f"""{_MASK}, b AS (SELECT vec_id AS sample_id, least(greatest(coalesce(min(h), 0) - 1, 0), 3) AS y, greatest(least(coalesce(max(h) + 1, 4) + 1, 4), 1) AS y1, coalesce(min(w), 0) AS x, coalesce(max(w) + 1, 4) AS x1 FROM embeddings LEFT JOIN m ON sample_id = vec_id GROUP BY 1),
k AS (SELECT sample_id, y, least(y1 + (y1 - y) % 2, 4) AS y1, x, least(x1 + (3 - (x1 - x) % 3) % 3, 4) AS x1 FROM b)"""
_foreground = R.Pipeline(R.CropForeground("image", select=lambda x: x > 0.15, channels=[1, 3], margin=(1, 0), divisible=(2, 3), allow_smaller=False))
query("foreground_options", f"WITH {MC}, {_OPTIONS} SELECT v.sample_id, (((h - y) * (x1 - x) + w - x) * 4 + c)::INT AS i, round(v, 6) + 0.0 AS v FROM v JOIN k USING (sample_id) WHERE h >= y AND h < y1 AND w >= x AND w < x1")(
    lambda s, d: flat(_foreground(recs(s, d, (4, 4, 4))))
)
query("foreground_inverse", f"WITH {MC}, {_OPTIONS} SELECT v.sample_id, ((h * 4 + w) * 4 + c)::INT AS i, CASE WHEN h >= y AND h < y1 AND w >= x AND w < x1 THEN round(v, 6) + 0.0 ELSE 0.0 END AS v FROM v JOIN k USING (sample_id)")(
    lambda s, d: flat(_foreground.inverse(_foreground(recs(s, d, (4, 4, 4)))))
)
query("foreground_component", f"""WITH RECURSIVE o AS ({_component_sql(2)}), b AS (SELECT sample_id, coalesce(min(i // 8) FILTER (v > 0), 0) AS y, coalesce(max(i // 8) FILTER (v > 0), 7) AS y1, coalesce(min(i % 8) FILTER (v > 0), 0) AS x, coalesce(max(i % 8) FILTER (v > 0), 7) AS x1 FROM o GROUP BY 1)
SELECT vec_id AS sample_id, ((t.i // 8 - y) * (x1 - x + 1) + t.i % 8 - x)::INT AS i, round(embedding[t.i + 1]::DOUBLE, 6) + 0.0 AS v FROM embeddings JOIN b ON sample_id = vec_id, range(64) t(i) WHERE t.i // 8 BETWEEN y AND y1 AND t.i % 8 BETWEEN x AND x1""")(
    lambda s, d: flat(R.Pipeline(R.CropForeground(("image", "label"), source="label", clean="largest_component"))(recs(s, d, label=label(0.1))))
)

# ---- rotation ----------------------------------------------------------------------------------

_ANGLE = f"a AS (SELECT vec_id AS sample_id, {_u('vec_id', chr(39) + 'prob' + chr(39))} < 0.8 AS hit, ({_u('vec_id', chr(39) + 'angle' + chr(39))} * 2 - 1) * 0.5::DOUBLE AS t FROM embeddings)"
_TURNED = f"""{_ANGLE}, g AS (SELECT a.*, y, x, cos(t) * (x - 4) + sin(t) * (y - 4) + 4 AS px, -sin(t) * (x - 4) + cos(t) * (y - 4) + 4 AS py FROM a, range(8) p(y), range(8) q(x)),
w AS (SELECT g.*, floor(py) + i AS th, floor(px) + j AS tw, abs(1 - i - (py - floor(py))) * abs(1 - j - (px - floor(px))) AS wt FROM g, range(2) r(i), range(2) s(j)),
r AS (SELECT w.sample_id, hit, t, y, x, CASE WHEN hit THEN sum(wt * coalesce(v.v, -1)) ELSE max(o.v) END AS v FROM w LEFT JOIN v ON v.sample_id = w.sample_id AND v.h = th AND v.w = tw JOIN v o ON o.sample_id = w.sample_id AND o.h = y AND o.w = x GROUP BY w.sample_id, hit, t, y, x)"""
_deep = lambda s, d: recs(s, d, (1, 8, 8, 1), label=label(0.1))
_rotate = R.RandomRotate(("image", "label"), seed=7, factor=0.5, fill=-1.0)
query("random_rotate_linear", f"WITH {V2}, {_TURNED} SELECT sample_id, (y * 8 + x)::INT AS i, round(v, 6) + 0.0 AS v FROM r")(lambda s, d: flat(R.Pipeline(_rotate)(_deep(s, d))))
query("random_rotate_label", f"""WITH {V2}, {_TURNED} SELECT g.sample_id, (y * 8 + x)::INT AS i, CASE WHEN coalesce(n.v, 0) > 0.1 THEN 1.0::DOUBLE ELSE 0.0 END AS v FROM g
LEFT JOIN v n ON n.sample_id = g.sample_id AND n.h = CASE WHEN hit THEN round(py) ELSE y END AND n.w = CASE WHEN hit THEN round(px) ELSE x END""")(lambda s, d: flat(R.Pipeline(_rotate)(_deep(s, d)), "label"))
# the plane is square, so the inscribed square has sides 8 / (sin + cos)
query("random_rotate_crop", f"""WITH {V2}, {_TURNED}, z AS (SELECT *, CASE WHEN hit THEN ((8 - 8 * (1 / (sin(abs(t)) + cos(t)) * 0.98::DOUBLE)) / 2)::DOUBLE ELSE 0 END AS cut FROM r), k AS (SELECT sample_id, floor(max(cut))::INT AS k FROM z GROUP BY 1),
e AS (SELECT k.*, y, x, least(greatest((y + 0.5::DOUBLE) * ((8.0::DOUBLE - 2 * k) / 8) - 0.5::DOUBLE, 0), 7 - 2 * k) AS py, least(greatest((x + 0.5::DOUBLE) * ((8.0::DOUBLE - 2 * k) / 8) - 0.5::DOUBLE, 0), 7 - 2 * k) AS px FROM k, range(8) p(y), range(8) q(x)),
f AS (SELECT e.*, least(floor(py) + i, 7 - 2 * k) + k AS th, least(floor(px) + j, 7 - 2 * k) + k AS tw, abs(1 - i - (py - floor(py))) * abs(1 - j - (px - floor(px))) AS wt FROM e, range(2) r(i), range(2) s(j))
SELECT f.sample_id, (f.y * 8 + f.x)::INT AS i, round(sum(wt * r.v), 6) + 0.0 AS v FROM f JOIN r ON r.sample_id = f.sample_id AND r.y = th AND r.x = tw GROUP BY ALL""")(
    lambda s, d: flat(R.Pipeline(R.RandomRotate("image", seed=7, factor=0.5, fill=-1.0, mode="crop"))(_deep(s, d)))
)

# ---- traces ------------------------------------------------------------------------------------

_lambda = R.Apply("image", seed=9, prob=0.5, fn=lambda x: x * 2, inverse=lambda x: x / 2, label="double")
_chain = R.Pipeline(R.Flip("image", axes=(1,)), R.Shift("image", seed=7, prob=0.6, low=-0.5, high=0.5), _lambda, R.Shift("image", low=1.0))
_n9 = lambda *p: _u(*p).replace("'7|'", "'9|'")
_DRAWS = f"z AS (SELECT vec_id AS sample_id, {_u('vec_id', chr(39) + 'prob' + chr(39))} < 0.6 AS a, {_u('vec_id', chr(39) + 'offset' + chr(39))} - 0.5::DOUBLE AS o, {_n9('vec_id', chr(39) + 'prob' + chr(39))} < 0.5 AS b FROM embeddings)"
query("record_chain", f"WITH {V2}, {_DRAWS} SELECT v.sample_id, (h * 8 + 7 - w)::INT AS i, round((v + CASE WHEN a THEN o ELSE 0 END) * CASE WHEN b THEN 2 ELSE 1 END + 1, 6) + 0.0 AS v FROM v JOIN z USING (sample_id)")(
    lambda s, d: flat(_chain(recs(s, d)))
)
query("record_chain_inverse", f"WITH {V2} SELECT sample_id, (h * 8 + w)::INT AS i, round(v, 6) + 0.0 AS v, 0 AS steps_left FROM v")(
    lambda s, d: _chain.inverse(_chain(recs(s, d))).select("sample_id", F.size("trace").alias("steps_left"), F.posexplode("image.data").alias("i", "v"))
)
query("record_trace", f"""WITH {_DRAWS}, t AS (SELECT sample_id, 0 AS place, 'Flip' AS name, true AS applied, false AS random, NULL::DOUBLE AS "offset" FROM z UNION ALL SELECT sample_id, 1, 'Shift', a, true, CASE WHEN a THEN o END FROM z
UNION ALL SELECT sample_id, 2, 'Apply', b, true, NULL FROM z UNION ALL SELECT sample_id, 3, 'Shift', true, false, 1.0 FROM z) SELECT sample_id, place, name, applied, random, round("offset", 6) + 0.0 AS "offset" FROM t""")(
    lambda s, d: _chain(recs(s, d)).select("sample_id", F.posexplode("trace").alias("place", "t")).select("sample_id", "place", "t.name", "t.applied", "t.random", F.get_json_object("t.params", "$.offset").cast("double").alias("offset"))
)
_some = R.RandomChoice(seed=7, prob=0.75, choices=(0, 2), weights=[3, 1, 0, 2], steps=[R.Shift("image", low=1.0), R.Apply("image", fn=lambda x: x * 2, inverse=lambda x: x / 2, label="twice"), R.Shift("image", low=-9.0), R.Flip("image", axes=(1,))])
_TAKEN = f"""e AS (SELECT vec_id AS sample_id, k::INT AS choice, [3.0, 1.0, 0.0, 2.0][k + 1]::DOUBLE AS wt FROM embeddings, range(4) r(k)),
o AS (SELECT sample_id, choice, row_number() OVER (PARTITION BY sample_id ORDER BY ln(wt) - ln(-ln(greatest({_u('sample_id', chr(39) + 'choice' + chr(39), 'choice')}, 1e-6))) DESC, choice) AS r FROM e WHERE wt > 0),
n AS (SELECT vec_id AS sample_id, CASE WHEN {_u('vec_id', chr(39) + 'prob' + chr(39))} < 0.75 THEN floor({_u('vec_id', chr(39) + 'number' + chr(39))} * 3) ELSE 0 END AS n FROM embeddings),
z AS (SELECT v.*, n >= 1 AND a.choice = 3 OR n >= 2 AND b.choice = 3 AS turned, CASE WHEN n >= 1 THEN a.choice ELSE -1 END AS a, CASE WHEN n >= 2 THEN b.choice ELSE -1 END AS b FROM v JOIN o a ON a.sample_id = v.sample_id AND a.r = 1 JOIN o b ON b.sample_id = v.sample_id AND b.r = 2 JOIN n ON n.sample_id = v.sample_id),
y AS (SELECT *, CASE a WHEN 0 THEN v + 1 WHEN 1 THEN v * 2 ELSE v END AS x FROM z)"""
query("random_choice_range", f"WITH {V2}, {_TAKEN} SELECT sample_id, (h * 8 + CASE WHEN turned THEN 7 - w ELSE w END)::INT AS i, round(CASE b WHEN 0 THEN x + 1 WHEN 1 THEN x * 2 ELSE x END, 6) + 0.0 AS v FROM y")(
    lambda s, d: flat(R.Pipeline(_some)(recs(s, d)))
)
query("random_choice_inverse", f"WITH {V2} SELECT sample_id, (h * 8 + w)::INT AS i, round(v, 6) + 0.0 AS v, 0 AS steps_left FROM v")(
    lambda s, d: R.Pipeline(_some).inverse(R.Pipeline(_some)(recs(s, d))).select("sample_id", F.size("trace").alias("steps_left"), F.posexplode("image.data").alias("i", "v"))
)

# ---- several arrays on one grid ----------------------------------------------------------------


def _pairs(s: SparkSession, d: str) -> DataFrame:
    rows = _oblique(s, d).select("sample_id", F.struct("shape", "data").alias("image"), F.struct("shape", F.transform("data", lambda x: (x > 0).cast("double")).alias("data")).alias("label"), "affine")
    # half a voxel along the first axis, and every second along the last
    to = np.array([1, 0, 0, 0.5, 0, 1, 0, 0, 0, 0, 2, 0, 0, 0, 0, 1.0]).reshape(4, 4)
    at = lambda r, k: sum((F.col("affine")[r * 4 + j] * F.lit(float(to[j, k])) for j in range(4)), F.lit(0.0))
    return R.resample_many(rows.withColumn("to_affine", F.array(*[at(r, k) for r in range(4) for k in range(4)])), {"image": "linear", "label": "nearest"}, (4, 4, 2), fill=-1.0)


query("resample_many_image", f"""WITH {V3}, t AS (SELECT a.sample_id, a.d, a.h, a.w, a.v, b.v AS u FROM v a LEFT JOIN v b ON b.sample_id = a.sample_id AND b.d = a.d + 1 AND b.h = a.h AND b.w = a.w WHERE a.w % 2 = 0)
SELECT sample_id, (d * 8 + h * 2 + w // 2)::INT AS i, round((v + coalesce(u, -1)) / 2, 4) + 0.0 AS v FROM t""")(lambda s, d: flat(_pairs(s, d)).withColumn("v", F.round("v", 4)))


# ---- tiles and blocks --------------------------------------------------------------------------

_arrays = lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("sample_id"), F.array(*map(F.lit, (4, 4, 2, 2))).alias("shape"), F.col("embedding").cast("array<double>").alias("data"))
VC = "v AS (SELECT vec_id AS sample_id, (i // 16)::INT AS d, (i // 4 % 4)::INT AS h, (i // 2 % 2)::INT AS w, (i % 2)::INT AS c, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) t(i))"
_TILE = (2, 3, 2)
# weights (d, h, w, in, out) of a 3x3x3 kernel, as SQL has them too
_KERNEL3 = np.fromfunction(lambda a, b, e, i, o: (a - 1) * 0.3 + (b - 1) * 0.2 - (e - 1) * 0.1 + (i + 1) * (o + 1) * 0.05, (3, 3, 3, 2, 3))
_W3 = "(a * 0.3::DOUBLE + b * 0.2::DOUBLE - e * 0.1::DOUBLE + (i.c + 1) * (o + 1) * 0.05::DOUBLE)"
_NEAR = "x AS (SELECT DISTINCT sample_id, d, h, w FROM v), k AS (SELECT (a - 1)::INT AS a, (b - 1)::INT AS b, (e - 1)::INT AS e FROM range(3) p(a), range(3) q(b), range(3) r(e))"


def _conv3(dilation: int) -> str:
    return f"SELECT x.sample_id, x.d, x.h, x.w, o::INT AS o, sum(i.v * {_W3}) AS v FROM x, k, range(3) r(o) JOIN v i ON i.sample_id = x.sample_id AND i.d = x.d + a * {dilation} AND i.h = x.h + b * {dilation} AND i.w = x.w + e * {dilation} GROUP BY ALL"


for _n in (1, 2):
    query(f"conv3d_channels_dilation{_n}", f"WITH {VC}, {_NEAR}, y AS ({_conv3(_n)}) SELECT sample_id, (((d * 4 + h) * 2 + w) * 3 + o)::INT AS i, round(v, 6) + 0.0 AS v FROM y")(
        lambda s, d, n=_n: _flat(T.joined(T.convolution(T.cut(_arrays(s, d), _TILE), _TILE, _KERNEL3, n)))
    )
_DEEP = np.fromfunction(lambda a, b, e, i: (a - 1) * 0.3 + (b - 1) * 0.2 - (e - 1) * 0.1 + (i + 1) * 0.05, (3, 3, 3, 2))
_MIX = np.fromfunction(lambda i, o: 0.1 * (i + 1) - 0.05 * o, (2, 3))
query("conv3d_separable", f"""WITH {VC}, {_NEAR}, t AS (SELECT x.sample_id, x.d, x.h, x.w, i.c, sum(i.v * (a * 0.3::DOUBLE + b * 0.2::DOUBLE - e * 0.1::DOUBLE + (i.c + 1) * 0.05::DOUBLE)) AS v FROM x, k JOIN v i ON i.sample_id = x.sample_id AND i.d = x.d + a AND i.h = x.h + b AND i.w = x.w + e GROUP BY ALL)
SELECT sample_id, (((d * 4 + h) * 2 + w) * 3 + o)::INT AS i, round(sum(v * (0.1::DOUBLE * (c + 1) - 0.05::DOUBLE * o)), 6) + 0.0 AS v FROM t, range(3) r(o) GROUP BY ALL""")(
    lambda s, d: _flat(T.joined(T.convolution(T.cut(_arrays(s, d), _TILE), _TILE, _DEEP, 1, _MIX)))
)
_NORM = [([0.1, -0.1, 0.2], [1.0, 2.0, 0.5], [1.0, -1.0, 0.5], [0.2, 0.1, 0.3])] * 5
_PROJECT = np.fromfunction(lambda i, o: ((i * 7 + o * 3) % 5 - 2) * 0.25, (12, 3))
_bn = "greatest(({x} - [0.1, -0.1, 0.2][o + 1]::DOUBLE) / sqrt([1.0, 2.0, 0.5][o + 1]::DOUBLE + 0.001::DOUBLE) * [1.0, -1.0, 0.5][o + 1]::DOUBLE + [0.2, 0.1, 0.3][o + 1]::DOUBLE, 0)".format
query("spatial_pyramid", f"""WITH {VC}, {_NEAR}, b0 AS (SELECT sample_id, d, h, w, o::INT AS o, sum(v * (0.1::DOUBLE * (c + 1) - 0.05::DOUBLE * o)) AS v FROM v, range(3) r(o) GROUP BY ALL), b1 AS ({_conv3(1)}), b2 AS ({_conv3(2)}),
g AS (SELECT sample_id, c, avg(v) AS v FROM v GROUP BY 1, 2), b3 AS (SELECT sample_id, o::INT AS o, sum(v * (0.1::DOUBLE * (c + 1) - 0.05::DOUBLE * o)) AS v FROM g, range(3) r(o) GROUP BY ALL),
u AS (SELECT sample_id, d, h, w, o AS n, {_bn(x="v")} AS v FROM b0 UNION ALL SELECT sample_id, d, h, w, o + 3, {_bn(x="v")} FROM b1 UNION ALL SELECT sample_id, d, h, w, o + 6, {_bn(x="v")} FROM b2 UNION ALL SELECT x.sample_id, d, h, w, o + 9, {_bn(x="v")} FROM x JOIN b3 USING (sample_id)),
z AS (SELECT sample_id, d, h, w, o::INT AS o, sum(v * (((n * 7 + o * 3) % 5 - 2) * 0.25::DOUBLE)) AS v FROM u, range(3) r(o) GROUP BY ALL)
SELECT sample_id, (((d * 4 + h) * 2 + w) * 3 + o)::INT AS i, round({_bn(x="v")}, 6) + 0.0 AS v FROM z""")(
    lambda s, d: _flat(T.joined(T.pyramid(T.cut(_arrays(s, d), _TILE), _TILE, _MIX, [(1, _KERNEL3, None), (2, _KERNEL3, None)], _MIX, _PROJECT, _NORM)))
)

# 16 tokens of four channels; two heads of two
_sequence = lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("sample_id"), F.array(F.lit(16), F.lit(4)).alias("shape"), F.col("embedding").cast("array<double>").alias("data"))
TOKENS = "v AS (SELECT vec_id AS sample_id, (i // 4)::INT AS n, (i % 4)::INT AS c, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) t(i))"
_LEARNED = np.fromfunction(lambda i, c: (i + 1) * 0.5 - c * 0.3, (3, 4))
_square = lambda k: (np.fromfunction(lambda i, o: ((i * 3 + o * 5 + k) % 7 - 3) * 0.4, (4, 4)), [0.1 * k] * 4)
_dense_sql = lambda k, x="v": f"sum({x} * (((c * 3 + o * 5 + {k}) % 7 - 3) * 0.4::DOUBLE)) + {0.1 * k}::DOUBLE"


def _masks(s: SparkSession, d: str) -> DataFrame:
    """Query i sees token n of a sample unless (sample + i + n) is a multiple of 3."""
    rows = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("sample_id"), F.explode(F.array(*[F.lit(x) for x in (0, 5, 10, 15)])).alias("first"))
    seen = [F.when(F.col("first") + j < 16, ((F.col("sample_id") + i + F.col("first") + j) % 3 != 0).cast("double")) for i in range(3) for j in range(5)]
    return rows.select("sample_id", F.col("first").cast("long").alias("first"), F.filter(F.array(*seen), lambda x: x.isNotNull()).alias("data"))


query("masked_cross_attention", f"""WITH {TOKENS}, q0 AS (SELECT i, o, sum(((i + 1) * 0.5::DOUBLE - c * 0.3::DOUBLE) * (((c * 3 + o * 5) % 7 - 3) * 0.4::DOUBLE)) AS v FROM range(3) p(i), range(4) q(c), range(4) r(o) GROUP BY ALL),
k AS (SELECT sample_id, n, o, {_dense_sql(1)} AS v FROM v, range(4) r(o) GROUP BY ALL),
u AS (SELECT sample_id, n, o, {_dense_sql(2)} AS v FROM v, range(4) r(o) GROUP BY ALL),
s AS (SELECT k.sample_id, i, n, k.o // 2 AS hd, sum(q0.v * k.v) / sqrt(2.0::DOUBLE) + max(CASE WHEN (k.sample_id + i + n) % 3 = 0 THEN -1e9 ELSE 0 END) AS s FROM q0 JOIN k ON k.o = q0.o GROUP BY ALL),
e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY sample_id, i, hd)) AS e FROM s), p AS (SELECT *, e / sum(e) OVER (PARTITION BY sample_id, i, hd) AS p FROM e),
a AS (SELECT p.sample_id, i AS j, u.o AS c, sum(p.p * u.v) AS v FROM p JOIN u ON u.sample_id = p.sample_id AND u.n = p.n AND u.o // 2 = p.hd GROUP BY ALL),
z AS (SELECT sample_id, j, o, {_dense_sql(3)} AS v FROM a, range(4) r(o) GROUP BY ALL) SELECT sample_id, (j * 4 + o)::INT AS i, round(v, 6) + 0.0 AS v FROM z""")(
    lambda s, d: _flat(A.cross_attention(A.tiled_queries(_sequence(s, d), _LEARNED), A.blocks(_sequence(s, d), 5), 2, *[_square(k) for k in range(4)], _masks(s, d)))
)
_QKVV = np.fromfunction(lambda i, o: ((i * 3 + o * 5) % 7 - 3) * 0.4, (4, 16))
_FEW = np.fromfunction(lambda n, k: ((n * 2 + k * 3) % 5 - 2) * 0.2, (16, 3))
query("paired_attention", f"""WITH {TOKENS}, y AS (SELECT sample_id, n, (o // 4)::INT AS part, (o % 4)::INT AS c, sum(v * (((c * 3 + o * 5) % 7 - 3) * 0.4::DOUBLE)) AS v FROM v, range(16) r(o) GROUP BY sample_id, n, o),
l AS (SELECT *, sqrt(greatest(sum(v * v) OVER (PARTITION BY sample_id, part, c), 1e-6::DOUBLE)) AS l FROM y), q AS (SELECT sample_id, n, c, v / l AS v FROM l WHERE part = 0), k AS (SELECT sample_id, n, c, v / l AS v FROM l WHERE part = 1),
g AS (SELECT q.sample_id, q.c AS a, k.c AS b, sum(q.v * k.v) AS s FROM q JOIN k ON q.sample_id = k.sample_id AND q.n = k.n AND q.c // 2 = k.c // 2 GROUP BY ALL),
ge AS (SELECT *, exp(s - max(s) OVER w) AS e FROM g WINDOW w AS (PARTITION BY sample_id, a)), gp AS (SELECT *, e / sum(e) OVER (PARTITION BY sample_id, a) AS p FROM ge),
ca AS (SELECT gp.sample_id, y.n * 4 + gp.a AS i, sum(p * y.v) AS v FROM gp JOIN y ON y.sample_id = gp.sample_id AND y.part = 2 AND y.c = gp.b GROUP BY ALL),
kp AS (SELECT sample_id, c, t, sum(v * (((n * 2 + t * 3) % 5 - 2) * 0.2::DOUBLE)) AS v FROM k, range(3) r(t) GROUP BY ALL), vp AS (SELECT sample_id, c, t, sum(v * (((n * 2 + t * 3) % 5 - 2) * 0.2::DOUBLE)) AS v FROM y, range(3) r(t) WHERE part = 3 GROUP BY ALL),
s AS (SELECT q.sample_id, q.n, q.c // 2 AS hd, t, sum(q.v * kp.v) AS s FROM q JOIN kp ON kp.sample_id = q.sample_id AND kp.c = q.c GROUP BY ALL),
se AS (SELECT *, exp(s - max(s) OVER (PARTITION BY sample_id, n, hd)) AS e FROM s), sp AS (SELECT *, e / sum(e) OVER (PARTITION BY sample_id, n, hd) AS p FROM se),
sa AS (SELECT sp.sample_id, ((vp.c % 2) * 2 + hd) * 16 + n AS i, sum(p * vp.v) AS v FROM sp JOIN vp ON vp.sample_id = sp.sample_id AND vp.c // 2 = hd AND vp.t = sp.t GROUP BY ALL)
SELECT ca.sample_id, ca.i::INT AS i, round(ca.v + sa.v, 6) + 0.0 AS v FROM ca JOIN sa USING (sample_id, i)""")(
    lambda s, d: A.paired_attention(A.blocks(_sequence(s, d), 5), 16, 2, (_QKVV, None), _FEW).select("sample_id", F.col("first"), F.posexplode("data").alias("j", "v")).select("sample_id", (F.col("first") * 4 + F.col("j")).cast("int").alias("i"), "v")
)

# ---- batches -----------------------------------------------------------------------------------

_keyed = lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.when(F.col("vec_id") % 3 > 0, F.col("vec_id") % 5 * 10**12).alias("key"))
_KEYED = "e AS (SELECT vec_id, CASE WHEN vec_id % 3 > 0 THEN vec_id % 5 * 1000000000000 END AS key FROM embeddings)"
query("batch_sparse_keys", f"WITH {_KEYED}, r AS (SELECT vec_id, row_number() OVER (ORDER BY key NULLS FIRST, vec_id) - 1 AS r, count(*) OVER () AS n FROM e) SELECT vec_id, r // 7 AS batch, (r % 7)::INT AS place FROM r WHERE r // 7 < n // 7")(
    lambda s, d: tables.batches(_keyed(s, d), ["key", "vec_id"], 7).drop("key")
)
query("batch_epoch", "WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY md5('7|2|' || vec_id::VARCHAR), vec_id) - 1 AS r FROM embeddings) SELECT vec_id, r // 7 AS batch, (r % 7)::INT AS place FROM r")(
    lambda s, d: tables.epochs(s.read.parquet(f"{d}/embeddings.parquet").select("vec_id"), 7, 2, 7, "vec_id", drop_remainder=False)
)

# ---- record files, streams and merging ---------------------------------------------------------


@query("tfrecord_round_trip", "SELECT vec_id AS sample_id, label::BIGINT AS label, array_to_string(list_transform(range(0, 32), lambda i: (round(embedding[i + 1]::DOUBLE * 1000))::BIGINT::VARCHAR || ':' || (round(embedding[i + 33]::DOUBLE * 1000))::BIGINT::VARCHAR), ',') AS pairs FROM embeddings")
def _records_back(s, d):
    """embeddings as record files, read in ranges smaller than a file; two halves put together as channels."""
    rows = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.slice("embedding", 1, 32).alias("first"), F.slice("embedding", 33, 32).alias("second"))
    folder = tables.shared_path(s, "tfrecords")
    manifest = tfrecords.write_records(rows, folder, 40_000)
    f = lambda name, kind: F.col("features")[name][kind]
    back = tfrecords.read_records(s, manifest, 7_000)
    both = tfrecords.channels([f("first", "floats"), f("second", "floats")])
    text = F.transform(both, lambda x: F.round(x.cast("double") * 1000).cast("long").cast("string"))
    # bound: text is worked out once, not for each of its places
    pair = scalars.bound(text, lambda t: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.concat_ws(":", F.get(t, 2 * i), F.get(t, 2 * i + 1))))
    return back.select(f("vec_id", "ints")[0].alias("sample_id"), f("label", "ints")[0].alias("label"), F.array_join(pair, ",").alias("pairs"))


def _event_stream(s: SparkSession, d: str) -> DataFrame:
    schema = s.read.parquet(f"{d}/events.parquet").schema
    # a stream reads folders or patterns, not one file by its name
    return s.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_closed_windows", """WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, value, max(ts) OVER () AS last FROM events)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, round(avg(value), 6) + 0.0 AS mean, count(*) AS n FROM e WHERE start + INTERVAL 1 HOUR <= last - INTERVAL 2 HOUR GROUP BY ALL""")
def _windows(s, d):
    path, checkpoint = tables.shared_path(s, "windows"), tables.shared_path(s, "windows-state")
    metrics.closed_windows(_event_stream(s, d), path, checkpoint).awaitTermination()
    return s.read.parquet(path).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "mean", "n")


@query("stream_sessions", """WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before, max(ts) OVER () AS last FROM events),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
r AS (SELECT user_id, k, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, count(*) AS n, any_value(last) AS last FROM g GROUP BY ALL)
SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, n FROM r WHERE b <= last - INTERVAL 2 HOUR""")
def _sessions(s, d):
    path, checkpoint = tables.shared_path(s, "sessions"), tables.shared_path(s, "sessions-state")
    metrics.sessions(_event_stream(s, d), path, checkpoint).awaitTermination()
    return s.read.parquet(path).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


_WEIGHTS = [[1.0, 2.0, 0.5], [0.0, 1.5, 1.0], [2.0, 0.25, 1.0], [1.0, 1.0, 3.0]]
query("patch_merge_weights", f"WITH {V2}, {_starts}, t AS (SELECT *, {_WEIGHTS}[h - sh + 1][w - sw + 1]::DOUBLE AS wt FROM v JOIN p ON h BETWEEN sh AND sh + 3 AND w BETWEEN sw AND sw + 2) SELECT sample_id, d, h, w, c, round(CASE WHEN sum(wt) <> 0 THEN sum((v + patch_id) * wt) / sum(wt) ELSE 0 END, 6) + 0.0 AS v FROM t GROUP BY ALL")(
    lambda s, d: windows.sliding_window(load(s, d), {"h": 4, "w": 3}, _model, 0.25, weights=_WEIGHTS).df
)
_D0 = "p AS (SELECT i::INT AS patch_id, (i * 2 - greatest(i * 2 + 3 - 4, 0))::INT AS sd FROM range(2) a(i))"
query("merged_map_slice", f"""WITH {V3}, {_D0}, m AS (SELECT sample_id, d, h, w, greatest(avg(v * (patch_id + 1)), 0) AS v FROM v JOIN p ON d BETWEEN sd AND sd + 2 GROUP BY ALL),
n AS (SELECT *, CASE WHEN max(v) OVER q > 0 THEN v / max(v) OVER q ELSE v END AS x FROM m WINDOW q AS (PARTITION BY sample_id)), s AS (SELECT sample_id, d, sum(x) AS total FROM n GROUP BY ALL)
SELECT sample_id, d, round(total, 6) + 0.0 AS total FROM s QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY total DESC, d) = 1""")(
    lambda s, d: windows.best_slices(windows.merged_maps(load(s, d, "3d"), windows.extract_patches(load(s, d, "3d"), {"d": 3, "h": 4, "w": 4}).withColumn("v", F.col("v") * (F.col("patch_id") + 1)), {"d": 3, "h": 4, "w": 4}, "constant"))
)

# ---- attention in windows, and small layers ----------------------------------------------------

_PLACES = [[((r * 3 + k * 5) % 7 - 3) * 0.2 for k in range(2)] for r in range(9)]
_rel = "(((i // 2 - j // 2 + 1) * 3 + i % 2 - j % 2 + 1) * 3 + hd * 5) % 7 * 0.2::DOUBLE - 0.6::DOUBLE"


def _attention(vectors: str, scale: str, bias: str) -> str:
    return f"""WITH {MC}, b AS (SELECT sample_id, (h // 2 * 2 + w // 2)::INT AS win, (h % 2 * 2 + w % 2)::INT AS pos, c, (c // 2)::INT AS hd, v FROM v), u AS ({vectors}),
s AS (SELECT q.sample_id, q.win, q.hd, q.pos AS i, k.pos AS j, sum(q.v * k.v) AS s FROM u q JOIN u k ON q.sample_id = k.sample_id AND q.win = k.win AND q.c = k.c GROUP BY ALL),
t AS (SELECT *, s * {scale} + {bias} AS t FROM s), e AS (SELECT *, exp(t - max(t) OVER (PARTITION BY sample_id, win, hd, i)) AS e FROM t), p AS (SELECT *, e / sum(e) OVER (PARTITION BY sample_id, win, hd, i) AS p FROM e)
SELECT p.sample_id, p.win, p.i AS pos, k.c, round(sum(p * k.v), 6) + 0.0 AS v FROM p JOIN b k ON k.sample_id = p.sample_id AND k.win = p.win AND k.hd = p.hd AND k.pos = p.j GROUP BY ALL"""


query("attention_bias", _attention("SELECT * FROM b", "0.5", _rel))(
    lambda s, d: _said(packed.window_attention(pack_rows(s, d, "mc"), (2, 2), 2, 0.5, bias=packed.relative_bias((2, 2), _PLACES)))
)
query("attention_cosine", _attention("SELECT sample_id, win, pos, c, hd, v / sqrt(greatest(sum(v * v) OVER (PARTITION BY sample_id, win, pos, hd), 1e-6::DOUBLE)) AS v FROM b", "CASE hd WHEN 0 THEN exp(1.5::DOUBLE) ELSE 100 END", f"16 / (1 + exp(-({_rel})))"))(
    lambda s, d: _said(packed.window_attention(pack_rows(s, d, "mc"), (2, 2), 2, [1.5, 9.0], bias=packed.relative_bias((2, 2), _PLACES, True), cosine=True))
)
vox("prelu", "mc", lambda v: layers.prelu(v, [0.1, 0.2, 0.3, 0.4]), "CASE WHEN v >= 0 THEN v ELSE v * 0.1::DOUBLE * (c + 1) END")
vox("spatial_dropout", "mc", lambda v: layers.spatial_dropout(v, 7, 0.25), f"CASE WHEN {_u('sample_id', 'c')} < 0.75 THEN v / 0.75 ELSE 0 END")

# ---- centerline losses of several classes -------------------------------------------------------


def _centerline(truth: str, pred: str, keep: str, classes: str) -> str:
    """Each (sample, class) is an array of its own to the skeleton's CTEs."""
    return f"""WITH RECURSIVE {MC.replace("v AS", "b AS", 1)}, o AS (SELECT *, (({truth}) % 4)::INT AS k, {pred} AS q FROM b),
v AS (SELECT sample_id * 4 + c AS sample_id, h, w, ({keep})::INT * (k = c)::INT::DOUBLE AS yt, ({keep})::INT * least(greatest(q, 1e-7), 1 - 1e-7) AS yp FROM o WHERE c IN {classes}),
{_skeleton_sql(50, "yt", "kt")}, {_skeleton_sql(50, "yp", "kp")},
s AS (SELECT v.sample_id, sum(kp.skel * yt) AS pt, sum(kp.skel) AS sp, sum(kt.skel * yp) AS tp, sum(kt.skel) AS st FROM v JOIN kt USING (sample_id, h, w) JOIN kp USING (sample_id, h, w) GROUP BY 1),
r AS (SELECT sample_id, (pt + 1e-7) / (sp + 1e-7) AS p, (tp + 1e-7) / (st + 1e-7) AS r FROM s)
SELECT sample_id // 4 AS sample_id, (sample_id % 4)::INT AS class, round(1 - 2 * p * r / (p + r + 1e-7), 6) + 0.0 AS loss FROM r"""


def _class_rows(s: SparkSession, d: str, of: Column, sparse: bool, pred: Column) -> DataFrame:
    """4x4 places with four channels; `of` is the place's class, by its index i."""
    truth = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.pmod(of + F.floor(i / 4) * 3 + F.floor(i % 4 / 2), F.lit(4)).cast("double"))
    hot = F.flatten(F.transform(truth, lambda k: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: (k == c).cast("double"))))
    rows = s.read.parquet(f"{d}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("sample_id"), F.array(*map(F.lit, (1, 4, 4, 4))).alias("shape"), (truth if sparse else hot).alias("y_true"), pred.alias("y_pred"))


query("loss_centerline_sparse", _centerline("sample_id + h * 3 + w // 2", "exp(4 * v) / sum(exp(4 * v)) OVER (PARTITION BY sample_id, h, w)", "k <> 3", "(0, 1, 2)"))(
    lambda s, d: regions.centerline_loss(_class_rows(s, d, F.col("vec_id"), True, F.transform("embedding", lambda x: x.cast("double") * 4)), "sparse", 4, from_logits=True, targets=[0, 1, 2], ignored=[3])
)
query("loss_centerline_categorical", _centerline("sample_id * 2 + h * 3 + w // 2", "1 / (1 + exp(-4 * v))", "true", "(1, 3)"))(
    lambda s, d: regions.centerline_loss(_class_rows(s, d, F.col("vec_id") * 2, False, F.transform("embedding", lambda x: scalars.sigmoid(x.cast("double") * 4))), "categorical", 4, targets=[1, 3])
)
