"""Queries of operators on packed arrays: volumes with channels, and arrays of several shapes in one table.

VC takes an `embeddings` row as a volume of 2x4x4 with two channels. In the mixed queries a row is an image of 8x8, a volume of 4x4x4 or
one of 2x4x4 with two channels by its id; results carry the row-major place i.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import packed
from .queries import BASES, pack_rows, query
from .voxels import unpack

VC = "v AS (SELECT vec_id AS sample_id, (i // 32)::INT AS d, (i // 8 % 4)::INT AS h, (i // 2 % 4)::INT AS w, (i % 2)::INT AS c, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) t(i))"
BASES["vc"] = ((2, 4, 4, 2), VC)
GROUPED = "sample_id, {d}::INT AS d, {h}::INT AS h, {w}::INT AS w"

def _unpacked(rows: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    return unpack(rows, shape).df


# ---- convolutions of volumes ---------------------------------------------------------------------

_TAP = "(i + 1) * 0.5::DOUBLE - j * 0.25::DOUBLE + l * 0.2::DOUBLE"
_tap = lambda i, j, k: (i + 1) * 0.5 - j * 0.25 + k * 0.2


def _volume_kernel(widths: tuple[int, int, int], ins: int, outs: int) -> list:
    d, h, w = widths
    return [[[[[_tap(i, j, k) + p * 0.125 - q * 0.375 for q in range(outs)] for p in range(ins)] for k in range(w)] for j in range(h)] for i in range(d)]


def _taps(widths: tuple[int, int, int], ins: int, outs: int) -> str:
    return f"k AS (SELECT i, j, l, p, q, {_TAP} + p * 0.125::DOUBLE - q * 0.375::DOUBLE AS x FROM range({widths[0]}) a(i), range({widths[1]}) b(j), range({widths[2]}) e(l), range({ins}) f(p), range({outs}) g(q))"


def _conv_sql(widths: tuple[int, int, int], outs: int, sizes: tuple[int, int, int], on: str, channel: str = "c = p", ins: int = 2, more: str = "0") -> str:
    grid = ", ".join(f"range({n}) {a}(o{a})" for a, n in zip("dhw", sizes))
    return f"WITH {VC}, {_taps(widths, ins, outs)} SELECT {GROUPED.format(d='od', h='oh', w='ow')}, q::INT AS c, round(sum(v * x) + max({more}), 6) + 0.0 AS v FROM v JOIN k ON {channel}, {grid} WHERE {on} GROUP BY ALL"


def _conv(name: str, sql: str, shape: tuple[int, int, int, int], fn) -> None:
    query(name, sql)(lambda s, d: _unpacked(fn(pack_rows(s, d, "vc")), shape))


_BIAS = [0.5, -0.25, 0.125]
_conv(
    "conv3d_channels", _conv_sql((3, 3, 3), 3, (2, 4, 4), "d = od + i - 1 AND h = oh + j - 1 AND w = ow + l - 1", more="[0.5, -0.25, 0.125][q + 1]::DOUBLE"), (2, 4, 4, 3),
    lambda p: packed.convolve(p, _volume_kernel((3, 3, 3), 2, 3), bias=_BIAS),
)
_conv(
    "conv3d_stride2_valid", _conv_sql((2, 3, 3), 3, (1, 1, 1), "d = od * 2 + i AND h = oh * 2 + j AND w = ow * 2 + l"), (1, 1, 1, 3),
    lambda p: packed.convolve(p, _volume_kernel((2, 3, 3), 2, 3), 2, padding="valid"),
)
_conv(
    "conv3d_dilated", _conv_sql((1, 3, 3), 2, (2, 4, 4), "d = od AND h = oh + j * 2 - 2 AND w = ow + l * 2 - 2"), (2, 4, 4, 2),
    lambda p: packed.convolve(p, _volume_kernel((1, 3, 3), 2, 2), dilation=(1, 2, 2)),
)
_conv(
    "conv3d_grouped", _conv_sql((1, 3, 3), 4, (2, 4, 4), "d = od AND h = oh + j - 1 AND w = ow + l - 1", "c = q // 2", 1), (2, 4, 4, 4),
    lambda p: packed.convolve(p, _volume_kernel((1, 3, 3), 1, 4), groups=2),
)
_conv(
    "conv3d_transpose", _conv_sql((2, 3, 2), 2, (4, 8, 8), "od = d * 2 + i AND oh = h * 2 + j AND ow = w * 2 + l"), (4, 8, 8, 2),
    lambda p: packed.convolve_transposed(p, _volume_kernel((2, 3, 2), 2, 2), 2),
)
_conv(
    "depthwise3d", _conv_sql((3, 3, 3), 2, (2, 2, 2), "d = od + i - 1 AND h = oh * 2 + j AND w = ow * 2 + l").replace("q::INT AS c", "(p * 2 + q)::INT AS c"), (2, 2, 2, 4),
    lambda p: packed.depthwise(p, _volume_kernel((3, 3, 3), 2, 2), (1, 2, 2)),
)
_POINT = [[0.1 * (i + 1) - 0.05 * o for o in range(3)] for i in range(4)]
_conv(
    "separable3d",
    f"WITH {VC}, {_taps((3, 3, 3), 2, 2)}, t AS (SELECT {GROUPED.format(d='od', h='oh', w='ow')}, p * 2 + q AS m, sum(v * x) AS v FROM v JOIN k ON c = p, range(2) y(od), range(4) z(oh), range(4) u(ow) WHERE d = od + i - 1 AND h = oh + j - 1 AND w = ow + l - 1 GROUP BY ALL) "
    "SELECT sample_id, d, h, w, o::INT AS c, round(sum(v * (0.1::DOUBLE * (m + 1) - 0.05::DOUBLE * o)), 6) + 0.0 AS v FROM t, range(3) r(o) GROUP BY ALL",
    (2, 4, 4, 3), lambda p: packed.separable(p, _volume_kernel((3, 3, 3), 2, 2), _POINT),
)

# ---- pooling -------------------------------------------------------------------------------------

for _f in ("max", "avg"):
    _conv(
        f"pool3d_{_f}", f"WITH {VC} SELECT {GROUPED.format(d='d // 2', h='h // 2', w='w // 2')}, c, round({_f}(v), 6) + 0.0 AS v FROM v GROUP BY ALL", (1, 2, 2, 2),
        lambda p, f=_f: packed.pool(p, f),
    )
    _conv(
        f"pool3d_{_f}_same",
        f"WITH {VC} SELECT {GROUPED.format(d='od', h='oh', w='ow')}, c, round({_f}(v), 6) + 0.0 AS v FROM v, range(2) a(od), range(2) b(oh), range(2) e(ow) WHERE abs(d - od) <= 1 AND h BETWEEN oh * 2 AND oh * 2 + 2 AND w BETWEEN ow * 2 AND ow * 2 + 2 GROUP BY ALL",
        (2, 2, 2, 2), lambda p, f=_f: packed.pool(p, f, 3, (1, 2, 2), "same"),
    )
    _conv(
        f"pool3d_{_f}_global", f"WITH {VC} SELECT sample_id, 0 AS d, 0 AS h, 0 AS w, c, round({_f}(v), 6) + 0.0 AS v FROM v GROUP BY ALL", (1, 1, 1, 2),
        lambda p, f=_f: packed.global_pool(p, f),
    )
    _conv(
        f"adaptive_{_f}_pool3d",
        f"WITH {VC} SELECT {GROUPED.format(d='i', h='j', w='k')}, c, round({_f}(v), 6) + 0.0 AS v FROM v, range(1) e(i), range(3) a(j), range(2) b(k) WHERE h >= j * 4 // 3 AND h < ceil((j + 1) * 4 / 3.0) AND w >= k * 2 AND w < (k + 1) * 2 GROUP BY ALL",
        (1, 3, 2, 2), lambda p, f=_f: packed.adaptive_pool(p, f, (1, 3, 2)),
    )

# ---- windows that are shifted --------------------------------------------------------------------

# the array is rolled by one along h and w: a cell's place there, its window, its region and its place in the window
_SHIFTED = """r AS (SELECT *, (h + 3) % 4 AS y, (w + 3) % 4 AS x FROM v),
b AS (SELECT sample_id, d, h, w, c, v, y // 2 * 2 + x // 2 AS win, (y % 2) * 2 + x % 2 AS pos, {heads} AS hd, CASE WHEN y < 2 THEN 0 WHEN y < 3 THEN 1 ELSE 2 END * 3 + CASE WHEN x < 2 THEN 0 WHEN x < 3 THEN 1 ELSE 2 END AS part FROM r),
n AS (SELECT *, {unit} AS u FROM b),
s AS (SELECT q.sample_id, q.d, q.win, q.hd, q.h, q.w, q.pos AS i, k.pos AS j, sum(q.u * k.u) * {scale} + {bias} + max(CASE WHEN q.part = k.part THEN 0 ELSE -100 END) AS s FROM n q JOIN n k USING (sample_id, d, win, hd, c) GROUP BY q.sample_id, q.d, q.win, q.hd, q.h, q.w, q.pos, k.pos),
e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY sample_id, d, win, hd, i)) AS e FROM s), p AS (SELECT *, e / sum(e) OVER (PARTITION BY sample_id, d, win, hd, i) AS p FROM e)
SELECT p.sample_id, p.d, p.h, p.w, k.c, round(sum(p * k.v), 6) + 0.0 AS v FROM p JOIN n k ON k.sample_id = p.sample_id AND k.d = p.d AND k.win = p.win AND k.hd = p.hd AND k.pos = p.j GROUP BY ALL"""
query("attention_shifted", f"WITH {BASES['mc'][1]}, " + _SHIFTED.format(heads="c // 2", unit="v", scale="0.5", bias="0"))(
    lambda s, d: _unpacked(packed.window_attention(pack_rows(s, d, "mc"), (2, 2), 2, 0.5, shift=1), (1, 4, 4, 4))
)
_TABLE = [[0.1 * k - 0.3, 0.2 - 0.05 * k] for k in range(9)]
_ROW = "((q.pos // 2 - k.pos // 2 + 1) * 3 + q.pos % 2 - k.pos % 2 + 1)"
query(
    "attention_shifted_cosine",
    f"WITH {BASES['mc'][1]}, "
    + _SHIFTED.format(
        heads="c // 2", unit="v / sqrt(greatest(sum(v * v) OVER (PARTITION BY sample_id, d, h, w, hd), 1e-6))", scale="CASE q.hd WHEN 0 THEN exp(1.0::DOUBLE) ELSE exp(2.0::DOUBLE) END",
        bias=f"16 / (1 + exp(-CASE q.hd WHEN 0 THEN 0.1::DOUBLE * {_ROW} - 0.3::DOUBLE ELSE 0.2::DOUBLE - 0.05::DOUBLE * {_ROW} END))",
    ),
)(lambda s, d: _unpacked(packed.window_attention(pack_rows(s, d, "mc"), (2, 2), 2, [1.0, 2.0], 1, packed.relative_bias((2, 2), _TABLE, True), True), (1, 4, 4, 4)))
# whole planes of the volume are windows of 1x2x2: each slice alone
query("attention_shifted_3d", f"WITH {VC}, " + _SHIFTED.format(heads="0", unit="v", scale="0.75", bias="0"))(
    lambda s, d: _unpacked(packed.window_attention(pack_rows(s, d, "vc"), (1, 2, 2), 1, 0.75, (0, 1, 1)), (2, 4, 4, 2))
)


# ---- arrays of several shapes in one table -------------------------------------------------------


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("data"))
    shapes = [F.array(*map(F.lit, s)) for s in ((1, 8, 8, 1), (4, 4, 4, 1), (2, 4, 4, 2))]
    kind = F.pmod("sample_id", F.lit(3))
    return rows.select("sample_id", F.when(kind == 0, shapes[0]).when(kind == 1, shapes[1]).otherwise(shapes[2]).alias("shape"), "data")


def _placed(rows: DataFrame) -> DataFrame:
    return rows.select("sample_id", F.array_join("shape", "x").alias("shape"), F.posexplode("data").alias("i", "v"))


MIXED = f"""{BASES['2d'][1].replace('v AS', 'a AS', 1)}, {BASES['3d'][1].replace('v AS', 'b AS', 1)}, {VC.replace('v AS', 'e AS', 1)},
v AS (SELECT 0 AS kind, * FROM a WHERE sample_id % 3 = 0 UNION ALL SELECT 1, * FROM b WHERE sample_id % 3 = 1 UNION ALL SELECT 2, * FROM e WHERE sample_id % 3 = 2)"""
_POOLED = "CASE kind WHEN 0 THEN h // 2 * 4 + w // 2 WHEN 1 THEN (d // 2 * 2 + h // 2) * 2 + w // 2 ELSE (h // 2 * 2 + w // 2) * 2 + c END"
query(
    "mixed_pool",
    f"WITH {MIXED} SELECT sample_id, CASE kind WHEN 0 THEN '1x4x4x1' WHEN 1 THEN '2x2x2x1' ELSE '1x2x2x2' END AS shape, ({_POOLED})::INT AS i, round(max(v), 6) + 0.0 AS v FROM v GROUP BY sample_id, kind, {_POOLED}",
)(lambda s, d: _placed(packed.pool(mixed(s, d), "max", 2, padding="same")))
query(
    "mixed_dilate",
    f"""WITH {MIXED} SELECT x.sample_id, CASE x.kind WHEN 0 THEN '1x8x8x1' WHEN 1 THEN '4x4x4x1' ELSE '2x4x4x2' END AS shape,
(CASE x.kind WHEN 0 THEN x.h * 8 + x.w WHEN 1 THEN (x.d * 4 + x.h) * 4 + x.w ELSE ((x.d * 4 + x.h) * 4 + x.w) * 2 + x.c END)::INT AS i, round(max(y.v), 6) + 0.0 AS v
FROM v x JOIN v y ON y.sample_id = x.sample_id AND y.c = x.c AND abs(y.d - x.d) <= 1 AND abs(y.h - x.h) <= 1 AND abs(y.w - x.w) <= 1 GROUP BY x.sample_id, x.kind, x.d, x.h, x.w, x.c""",
)(lambda s, d: _placed(packed.dilate(mixed(s, d))))
