"""Geometry on arrays of points (struct x, y, z) as column expressions: no Python in the rows' path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double,z:double>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def numbers(text: Column) -> Column:
    """The numbers of a coordinate text, separated by blanks or commas; empty for null and blank."""
    parts = F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s,]+", " ")), " ")
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: p.cast("double"))


def parse_points(text: Column, dimension: Column | None = None, swap: Column | None = None, close: bool = True) -> Column:
    """Points of a coordinate text.

    dimension: 2 or 3; where null, 3 if the count divides by three, else 2. Points of dimension 2 get z 0. swap: latitude
    comes first. close: three points or more that don't end where they start are closed. An incomplete last point is dropped.
    """
    return let(numbers(text), lambda n: _grouped(n, dimension, swap, close))


def _grouped(n: Column, dimension: Column | None, swap: Column | None, close: bool) -> Column:
    dim = F.when(F.size(n) % 3 == 0, 3).otherwise(2) if dimension is None else F.coalesce(dimension, F.when(F.size(n) % 3 == 0, 3).otherwise(2))
    count = F.floor(F.size(n) / dim).cast("int")
    at = lambda i, k: F.get(n, (i * dim + k).cast("int"))
    flip = F.lit(False) if swap is None else F.coalesce(swap, F.lit(False))

    def one(i: Column) -> Column:
        a, b = at(i, 0), at(i, 1)
        return point(F.when(flip, b).otherwise(a), F.when(flip, a).otherwise(b), F.when(dim == 3, at(i, 2)).otherwise(F.lit(0.0)))

    points = F.when(count >= 1, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array().cast(POINTS))
    return closed(points) if close else points


def closed(points: Column) -> Column:
    """``points`` with the first again at the end, if there are three or more and they aren't closed."""
    return let(points, lambda p: F.when((F.size(p) >= 3) & (F.try_element_at(p, F.lit(1)) != F.try_element_at(p, F.lit(-1))), F.concat(p, F.array(F.try_element_at(p, F.lit(1))))).otherwise(p))


def is_closed(points: Column) -> Column:
    """Four points or more, the last equal to the first."""
    return let(points, lambda p: (F.size(p) >= 4) & (F.try_element_at(p, F.lit(1)) == F.try_element_at(p, F.lit(-1))))


def shifted(points: Column, dx: Column, dy: Column, dz: Column) -> Column:
    """``points`` minus an origin."""
    return F.transform(points, lambda p: point(p["x"] - dx, p["y"] - dy, p["z"] - dz))


def affine(points: Column, matrix: Column) -> Column:
    """``points`` under a 4x4 matrix of 16 numbers by row (12 are enough), divided by w where w is neither 0 nor 1; a null matrix changes nothing."""
    m = lambda k: F.get(matrix, F.lit(k))

    def one(p: Column) -> Column:
        row = lambda k: m(k) * p["x"] + m(k + 1) * p["y"] + m(k + 2) * p["z"] + m(k + 3)
        w = F.when(F.size(matrix) >= 16, row(12)).otherwise(F.lit(1.0))
        d = F.when((w == 0) | (w == 1), F.lit(1.0)).otherwise(w)
        return point(row(0) / d, row(4) / d, row(8) / d)

    return F.when(matrix.isNull(), points).otherwise(F.transform(points, one))


def matrix_product(a: Column, b: Column) -> Column:
    """The product of two 4x4 matrices by row."""
    cell = lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0.0), lambda s, i: s + F.get(a, (F.floor(k / 4) * 4 + i).cast("int")) * F.get(b, (i * 4 + k % 4).cast("int")))
    return F.transform(F.sequence(F.lit(0), F.lit(15)), cell)


def newell(points: Column) -> Column:
    """Newell's normal of a ring (struct x, y, z), not of unit length; closed or not."""
    return let(points, _newell)


def _newell(points: Column) -> Column:
    n = F.size(points)
    zero = point(F.lit(0.0), F.lit(0.0), F.lit(0.0))

    def add(s: Column, i: Column) -> Column:
        p, q = F.get(points, i), F.get(points, (i + 1) % n)
        return point(s["x"] + (p["y"] - q["y"]) * (p["z"] + q["z"]), s["y"] + (p["z"] - q["z"]) * (p["x"] + q["x"]), s["z"] + (p["x"] - q["x"]) * (p["y"] + q["y"]))

    return F.when(n >= 3, F.aggregate(F.sequence(F.lit(0), n - 1), zero, add)).otherwise(zero)


def _length(v: Column) -> Column:
    return F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])


def area(points: Column) -> Column:
    """Area of a planar ring in space; 0 for fewer than three points."""
    return let(newell(points), _length) / 2


def unit_normal(points: Column) -> Column:
    """Unit normal of a ring; (0, 0, 1) for degenerate rings."""
    def unit(v: Column) -> Column:
        return let(_length(v), lambda d: F.when(d < 1e-12, point(F.lit(0.0), F.lit(0.0), F.lit(1.0))).otherwise(point(v["x"] / d, v["y"] / d, v["z"] / d)))

    return let(newell(points), unit)


def signed_area(points: Column) -> Column:
    """Shoelace area in the xy plane, positive against the clock."""
    return let(points, _signed_area)


def _signed_area(points: Column) -> Column:
    n = F.size(points)
    part = lambda s, i: s + F.get(points, i)["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * F.get(points, i)["y"]
    return F.when(n >= 3, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), part) / 2).otherwise(F.lit(0.0))


def inside(x: Column, y: Column, points: Column) -> Column:
    """Even-odd test of (x, y) against a ring in the xy plane; a point on an edge may fall on either side."""
    return let(points, lambda p: _inside(x, y, p))


def _inside(x: Column, y: Column, points: Column) -> Column:
    n = F.size(points)

    def flip(s: Column, i: Column) -> Column:
        p, q = F.get(points, i), F.get(points, (i + 1) % n)
        crosses = ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"])
        return F.when(F.coalesce(crosses, F.lit(False)), ~s).otherwise(s)

    return F.when(n >= 3, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), flip)).otherwise(F.lit(False))


def degenerate(points: Column, least_area: float = 1e-6) -> Column:
    """Why a ring is degenerate: 'few points', 'repeated point', 'no area', or null if it isn't."""

    def why(p: Column) -> Column:
        again = F.exists(F.sequence(F.lit(0), F.size(p) - 2), lambda i: F.get(p, i) == F.get(p, i + 1))
        return F.when(F.size(p) < 4, "few points").when(again, "repeated point").when(area(p) < least_area, "no area")

    return let(points, why)


def box(points: Column) -> Column:
    """Extent (min_x, min_y, min_z, max_x, max_y, max_z) of points; null for none."""

    def sides(points: Column) -> Column:
        low = lambda k: F.array_min(F.transform(points, lambda p: p[k]))
        high = lambda k: F.array_max(F.transform(points, lambda p: p[k]))
        parts = [f(k).alias(f"{n}_{k}") for n, f in (("min", low), ("max", high)) for k in ("x", "y", "z")]
        return F.when(F.size(points) > 0, F.struct(*parts))

    return let(points, sides)


def diagonal_ring(b: Column) -> Column:
    """The five points of an extent's ring: low corners first, then high ones, closed."""
    return F.array(
        point(b["min_x"], b["min_y"], b["min_z"]), point(b["max_x"], b["min_y"], b["min_z"]), point(b["max_x"], b["max_y"], b["max_z"]),
        point(b["min_x"], b["max_y"], b["max_z"]), point(b["min_x"], b["min_y"], b["min_z"]),
    )


def box_gap(a: Column, b: Column) -> Column:
    """Distance of two extents in space, 0 if they touch or overlap."""
    gap = lambda k: F.greatest(F.lit(0.0), a[f"min_{k}"] - b[f"max_{k}"], b[f"min_{k}"] - a[f"max_{k}"])
    return F.sqrt(gap("x") * gap("x") + gap("y") * gap("y") + gap("z") * gap("z"))


def barycentric(x: Column, y: Column, a: Column, b: Column, c: Column) -> Column:
    """Weights (u, v, w) of a point in a triangle of the xy plane; null if the triangle is flat."""
    d = (b["y"] - c["y"]) * (a["x"] - c["x"]) + (c["x"] - b["x"]) * (a["y"] - c["y"])
    u = ((b["y"] - c["y"]) * (x - c["x"]) + (c["x"] - b["x"]) * (y - c["y"])) / d
    v = ((c["y"] - a["y"]) * (x - c["x"]) + (a["x"] - c["x"]) * (y - c["y"])) / d
    return F.when(F.abs(d) > 1e-12, F.struct(u.alias("u"), v.alias("v"), (1 - u - v).alias("w")))


def circle(a: Column, b: Column, c: Column) -> Column:
    """Circle (x, y, r) through three points of the xy plane; null if they are on a line."""
    d = 2 * (a["x"] * (b["y"] - c["y"]) + b["x"] * (c["y"] - a["y"]) + c["x"] * (a["y"] - b["y"]))
    sq = lambda p: p["x"] * p["x"] + p["y"] * p["y"]
    x = (sq(a) * (b["y"] - c["y"]) + sq(b) * (c["y"] - a["y"]) + sq(c) * (a["y"] - b["y"])) / d
    y = (sq(a) * (c["x"] - b["x"]) + sq(b) * (a["x"] - c["x"]) + sq(c) * (b["x"] - a["x"])) / d
    return F.when(F.abs(d) > 1e-10, F.struct(x.alias("x"), y.alias("y"), F.sqrt((a["x"] - x) ** 2 + (a["y"] - y) ** 2).alias("r")))


def arc(x: Column, y: Column, r: Column, start: Column, end: Column, z0: Column, z1: Column, n: int = 16) -> Column:
    """n + 1 points on an arc from the angle ``start`` to ``end`` (radians), the height going evenly from z0 to z1."""
    step = lambda i: start + (end - start) * i / F.lit(float(n))
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: point(x + r * F.cos(step(i)), y + r * F.sin(step(i)), z0 + (z1 - z0) * i / F.lit(float(n))))


def unique_points(points: Column, digits: int = 9) -> Column:
    """``points`` without repetitions after rounding, the first kept, in order."""
    return F.array_distinct(F.transform(points, lambda p: point(F.bround(p["x"], digits), F.bround(p["y"], digits), F.bround(p["z"], digits))))


def signature(points: Column, digits: int = 6) -> Column:
    """The sorted rounded points: equal for rings that differ only in start and direction."""
    return F.array_sort(unique_points(points, digits))


def surface_by_normal(nz: Column) -> Column:
    """RoofSurface, GroundSurface or WallSurface by the upward part of the normal."""
    return F.when(nz > 0.7, "RoofSurface").when(nz < -0.7, "GroundSurface").otherwise("WallSurface")


def grid_point(origin: Column, along: Column, across: Column, row: Column, col: Column, value: Column) -> Column:
    """A vertex of a rectified grid; a missing value takes the height of the origin."""
    return point(
        origin["x"] + col * along["x"] + row * across["x"], origin["y"] + col * along["y"] + row * across["y"], F.coalesce(value.cast("double"), origin["z"])
    )


def box_faces(b: Column) -> Column:
    """The six faces of an extent, seen from outside against the clock, as an array of rings."""
    p = {k: point(b[f"{k[0]}_x"], b[f"{k[1]}_y"], b[f"{k[2]}_z"]) for k in [(i, j, k) for i in ("min", "max") for j in ("min", "max") for k in ("min", "max")]}
    lo, hi = "min", "max"
    ring = lambda *corners: F.array(*[p[c] for c in corners], p[corners[0]])
    return F.array(
        ring((lo, lo, lo), (lo, hi, lo), (hi, hi, lo), (hi, lo, lo)), ring((lo, lo, hi), (hi, lo, hi), (hi, hi, hi), (lo, hi, hi)), ring((lo, lo, lo), (hi, lo, lo), (hi, lo, hi), (lo, lo, hi)),
        ring((lo, hi, lo), (lo, hi, hi), (hi, hi, hi), (hi, hi, lo)), ring((lo, lo, lo), (lo, lo, hi), (lo, hi, hi), (lo, hi, lo)), ring((hi, lo, lo), (hi, hi, lo), (hi, hi, hi), (hi, lo, hi)),
    )
