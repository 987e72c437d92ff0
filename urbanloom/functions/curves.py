"""Arcs and circles as points, and fits of texture coordinates, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from urbanloom.functions.geometry import POINTS, arc, circle, let, point

_TURN = 2 * math.pi


def _turned(a: Column, b: Column, c: Column) -> Column:
    """Twice the area of a triangle of the xy plane: positive if b is passed against the clock."""
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def arc_through(a: Column, b: Column, c: Column, n: int = 16) -> Column:
    """n + 1 points from a over b to c on the circle through them, the height going evenly from a to c; the three points if they are on a line."""

    def bent(k: Column) -> Column:
        start, end = F.atan2(a["y"] - k["y"], a["x"] - k["x"]), F.atan2(c["y"] - k["y"], c["x"] - k["x"])
        ahead = F.pmod(end - start, F.lit(_TURN))
        sweep = F.when(_turned(a, b, c) > 0, ahead).otherwise(ahead - _TURN)
        return arc(k["x"], k["y"], k["r"], start, start + sweep, a["z"], c["z"], n)

    return let(circle(a, b, c), lambda k: F.when(k.isNull(), F.array(a, b, c).cast(POINTS)).otherwise(bent(k)))


def circle_through(a: Column, b: Column, c: Column, n: int = 32) -> Column:
    """n + 1 points of the whole circle through three points, from a on and back to it; the three points if they are on a line."""

    def round_(k: Column) -> Column:
        start = F.atan2(a["y"] - k["y"], a["x"] - k["x"])
        return arc(k["x"], k["y"], k["r"], start, start + _TURN, a["z"], a["z"], n)

    return let(circle(a, b, c), lambda k: F.when(k.isNull(), F.array(a, b, c).cast(POINTS)).otherwise(round_(k)))


def arc_string(points: Column, n: int = 16) -> Column:
    """The arcs through points 1 to 3, 3 to 5, ... as one line; what is left over at the end is joined straight on."""

    def joined(p: Column) -> Column:
        count = F.floor((F.size(p) - 1) / 2).cast("int")
        one = lambda i: F.slice(arc_through(F.get(p, 2 * i), F.get(p, 2 * i + 1), F.get(p, 2 * i + 2), n), F.lit(2), F.lit(n + 2))
        bent = F.concat(F.slice(p, F.lit(1), F.lit(1)), F.flatten(F.transform(F.sequence(F.lit(0), count - 1), one)))
        rest = F.when(F.size(p) % 2 == 0, F.slice(p, F.size(p), F.lit(1))).otherwise(F.array().cast(POINTS))
        return F.when(count >= 1, F.concat(bent, rest)).otherwise(p)

    return let(points, joined)


def segment_kind(kind: Column, points: Column) -> Column:
    """Kind of curve segment that a line of a kind (POLY, BEZIER, NURBS) with so many points is written as."""
    n = F.size(points)
    one = ((kind == "BEZIER") & (n == 3)) | ((kind == "NURBS") & (n.between(3, 5)))
    return F.when(one, "Arc").when(kind.isin("BEZIER", "NURBS") & (n >= 3), "ArcString").otherwise("LineStringSegment")


def inside_or_on(x: Column, y: Column, points: Column, tolerance: float = 1e-6) -> Column:
    """Whether (x, y) lies in a ring of the xy plane or within ``tolerance`` of its outline."""
    from urbanloom.functions.geometry import inside

    def near(p: Column) -> Column:
        n = F.size(p)

        def close(i: Column) -> Column:
            a, b = F.get(p, i), F.get(p, (i + 1) % n)
            dx, dy = b["x"] - a["x"], b["y"] - a["y"]
            t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((x - a["x"]) * dx + (y - a["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
            return F.hypot(x - a["x"] - t * dx, y - a["y"] - t * dy) <= tolerance

        return F.when(n >= 1, F.exists(F.sequence(F.lit(0), n - 1), close)).otherwise(F.lit(False))

    return let(points, lambda p: near(p) | inside(x, y, p))


def fitted_uvs(source: Column, targets: Column) -> Column:
    """Texture coordinates (u, v) of ``targets`` (x, y) by the affine map that fits ``source`` (x, y, u, v) best; (0, 0) if there is none."""
    total = lambda f: F.aggregate(source, F.lit(0.0), lambda s, p: s + f(p))
    sums = F.struct(*[
        total(f).alias(name)
        for name, f in {
            "xx": lambda p: p["x"] * p["x"], "xy": lambda p: p["x"] * p["y"], "yy": lambda p: p["y"] * p["y"], "x": lambda p: p["x"], "y": lambda p: p["y"], "n": lambda p: p["x"] * 0.0 + 1.0,
            "xu": lambda p: p["x"] * p["u"], "yu": lambda p: p["y"] * p["u"], "u": lambda p: p["u"], "xv": lambda p: p["x"] * p["v"], "yv": lambda p: p["y"] * p["v"], "v": lambda p: p["v"],
        }.items()
    ])

    def det(m: list[list[Column]]) -> Column:
        return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])

    def solved(s: Column) -> Column:
        m = [[s["xx"], s["xy"], s["x"]], [s["xy"], s["yy"], s["y"]], [s["x"], s["y"], s["n"]]]
        put = lambda k, right: [[right[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]
        u, v = [s["xu"], s["yu"], s["u"]], [s["xv"], s["yv"], s["v"]]
        cells = [det(put(k, right)) / det(m) for right in (u, v) for k in range(3)]
        return F.when(F.abs(det(m)) > 1e-12, F.array(*cells))

    zero = F.struct(F.lit(0.0).alias("u"), F.lit(0.0).alias("v"))
    at = lambda c, k: F.get(c, F.lit(k))
    mapped = lambda c: F.transform(targets, lambda t: F.when(c.isNull(), zero).otherwise(F.struct((at(c, 0) * t["x"] + at(c, 1) * t["y"] + at(c, 2)).alias("u"), (at(c, 3) * t["x"] + at(c, 4) * t["y"] + at(c, 5)).alias("v"))))
    return let(let(sums, solved), mapped)


def ordered_uvs(face: Column, ring: Column, uvs: Column, tolerance: float = 1e-6) -> Column:
    """``uvs`` of a ring's points in the order of a face's points, which starts elsewhere or turns the other way; null if they don't fit."""
    n = F.size(face)
    near = lambda p, q: (F.abs(p["x"] - q["x"]) <= tolerance) & (F.abs(p["y"] - q["y"]) <= tolerance) & (F.abs(p["z"] - q["z"]) <= tolerance)
    place = lambda start, step, i: F.pmod(start + step * i, n)
    every = F.sequence(F.lit(0), n - 1)
    fits = lambda start, step: F.forall(every, lambda i: near(F.get(face, i), F.get(ring, place(start, step, i))))
    starts = F.flatten(F.transform(every, lambda s: F.array(F.struct(s.alias("s"), F.lit(1).alias("d")), F.struct(s.alias("s"), F.lit(-1).alias("d")))))
    first = F.get(F.filter(starts, lambda c: fits(c["s"], c["d"])), F.lit(0))
    return let(first, lambda c: F.when((F.size(ring) == n) & (F.size(uvs) == n) & c.isNotNull(), F.transform(every, lambda i: F.get(uvs, place(c["s"], c["d"], i)))))


def centre_arc(centre: Column, radius: Column, start: Column, end: Column, n: int = 16) -> Column:
    """n + 1 points of an arc about a centre, from one angle to another (degrees)."""
    return arc(centre["x"], centre["y"], radius, F.radians(start), F.radians(end), centre["z"], centre["z"], n)


def straight(points: Column) -> Column:
    """Points as they are, in the type of points."""
    return F.transform(points, lambda p: point(p["x"], p["y"], p["z"]))
