"""Scalar expressions that operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *parts: Column | int) -> Column:
    """A uniform in [0, 1) from seed and parts; the same in any engine and partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def gumbel(u: Column, weight: Column) -> Column:
    """Key whose order samples without replacement in proportion to weight; 0 never comes first."""
    clamped = F.greatest(u, F.lit(1e-6))
    return F.when(weight > 0, F.log(weight) - F.log(-F.log(clamped))).otherwise(F.lit(-1e9))


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("int")


def half_even(x: Column) -> Column:
    return F.rint(x).cast("int")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def gelu(x: Column) -> Column:
    return x * sigmoid(F.lit(1.5957691216057308) * (x + F.lit(0.044715) * x * x * x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


#: Fixed patterns of the snake-case names, applied in this order.
SNAKE_PATTERNS = (r"([a-z0-9])([A-Z])", r"([A-Z]+)([A-Z][a-z])")


def camel_to_snake(name: Column) -> Column:
    """BinaryDiceLoss to binary_dice_loss."""
    for pattern in SNAKE_PATTERNS:
        name = F.regexp_replace(name, pattern, "$1_$2")
    return F.lower(name)


# ---- 4x4 affines as array<double> of 16, row-major ---------------------------------------------


def at(a: Column, row: int, column: int) -> Column:
    return a.getItem(row * 4 + column)


def spacing(a: Column) -> Column:
    """Lengths of the three voxel axes."""
    return F.array(*[F.sqrt(sum((at(a, r, k) * at(a, r, k) for r in range(3)), F.lit(0.0))) for k in range(3)])


def axis_aligned(a: Column, tolerance: float = 1e-5) -> Column:
    off = [F.abs(at(a, r, k)) <= F.lit(tolerance) for r in range(3) for k in range(3) if r != k]
    out = off[0]
    for x in off[1:]:
        out = out & x
    return out


def bound(x: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of x, with x evaluated once however often fn uses it."""
    return F.element_at(F.transform(F.array(x), fn), 1)


def invert(a: Column) -> Column:
    """Inverse of an affine by cofactors."""
    m = [[at(a, r, k) for k in range(3)] for r in range(3)]

    def minor(r: int, k: int) -> Column:
        i, j = [x for x in range(3) if x != r]
        p, q = [x for x in range(3) if x != k]
        return (m[i][p] * m[j][q] - m[i][q] * m[j][p]) * F.lit(float((-1) ** (r + k)))

    det = m[0][0] * minor(0, 0) + m[0][1] * minor(0, 1) + m[0][2] * minor(0, 2)

    def whole(inv: Column) -> Column:
        part = lambda r, k: inv.getItem(r * 3 + k)
        rows = [[*[part(r, k) for k in range(3)], -(part(r, 0) * at(a, 0, 3) + part(r, 1) * at(a, 1, 3) + part(r, 2) * at(a, 2, 3))] for r in range(3)]
        return F.array(*[x for row in rows for x in row], *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])

    return bound(bound(det, lambda d: F.array(*[minor(k, r) / d for r in range(3) for k in range(3)])), whole)


def apply_affine(a: Column, x: Column, y: Column, z: Column) -> list[Column]:
    return [at(a, r, 0) * x + at(a, r, 1) * y + at(a, r, 2) * z + at(a, r, 3) for r in range(3)]


def axis_codes(a: Column) -> Column:
    """RAS-like letters: for each voxel axis, the world axis it follows most, and its sign."""
    out = []
    for k in range(3):
        column = [at(a, r, k) for r in range(3)]
        best = F.array_position(F.transform(F.array(*column), F.abs), F.array_max(F.transform(F.array(*column), F.abs))).cast("int")
        up = F.element_at(F.array(*column), best) >= 0
        out.append(F.when(up, F.element_at(F.array(*map(F.lit, "RAS")), best)).otherwise(F.element_at(F.array(*map(F.lit, "LPI")), best)))
    return F.concat(*out)


def origin(a: Column) -> Column:
    return F.array(*[at(a, r, 3) for r in range(3)])


def direction(a: Column) -> Column:
    """The 3x3 direction cosines, row-major: voxel axes at unit length."""
    step = spacing(a)
    return F.array(*[at(a, r, k) / step.getItem(k) for r in range(3) for k in range(3)])


def build_affine(step: Column, cosines: Column, start: Column) -> Column:
    """Affine of a spacing, 3x3 direction cosines and an origin."""
    rows = [[*[cosines.getItem(r * 3 + k) * step.getItem(k) for k in range(3)], start.getItem(r)] for r in range(3)]
    return F.array(*[x for row in rows for x in row], *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])


def valid_affine(a: Column) -> Column:
    """a, or an error where it is not 16 finite numbers with the last row of an affine."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    last = F.slice(a, 13, 4) == F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])
    return F.when((F.size(a) == 16) & finite & last, a).otherwise(F.raise_error(F.lit("not a 4x4 affine")).cast("array<double>"))


def product(a: Column, b: Column) -> Column:
    """a after b."""
    return bound(F.struct(a.alias("a"), b.alias("b")), lambda x: F.array(*[sum((at(x["a"], r, j) * at(x["b"], j, k) for j in range(1, 4)), at(x["a"], r, 0) * at(x["b"], 0, k)) for r in range(4) for k in range(4)]))


def destination_affine(a: Column, step: Column, diagonal: bool = False) -> Column:
    """The affine of a grid with another spacing from the same origin, along the same axes or the world's."""
    world = F.array(*[F.lit(float(r == k)) for r in range(3) for k in range(3)])
    return build_affine(step, world if diagonal else direction(a), origin(a))


def output_shape(a: Column, b: Column, shape: tuple[int, int, int] | Column, align_corners: bool = False) -> Column:
    """Voxels that a grid with affine b needs to span one of this shape with affine a.

    The corners of the volume (of its outermost voxels, with align_corners) are mapped into b's grid.
    """
    n = shape if isinstance(shape, Column) else F.array(*map(F.lit, shape))
    far = [n.getItem(k).cast("double") - F.lit(1.0 if align_corners else 0.0) for k in range(3)]

    def sizes(m: Column) -> Column:
        # over a box's corners, a sum of axis terms ranges over the sum of their sizes
        into = lambda k, j: F.abs(at(m, k, 0) * at(a, 0, j) + at(m, k, 1) * at(a, 1, j) + at(m, k, 2) * at(a, 2, j))
        spans = [into(k, 0) * far[0] + into(k, 1) * far[1] + into(k, 2) * far[2] for k in range(3)]
        return F.array(*[F.greatest(half_up(x) + (1 if align_corners else 0), F.lit(1)) for x in spans])

    return bound(invert(b), sizes)
