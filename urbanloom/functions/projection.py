"""Coordinates between geographic systems and their transverse Mercator zones, as column arithmetic (Krueger's series, to a millimetre)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.functions.geometry import let, point

#: Axis and flattening of the ellipsoids of GRS80 and WGS84.
ELLIPSOIDS = {"grs80": (6378137.0, 1 / 298.257222101), "wgs84": (6378137.0, 1 / 298.257223563)}
_SCALE, _EAST, _NORTH = 0.9996, 500_000.0, 10_000_000.0


def system(code: int) -> tuple[str, int | None, bool]:
    """(ellipsoid, zone or None for degrees, south) of an EPSG code; ValueError for one that isn't known."""
    if code in (4326, 4979):
        return "wgs84", None, False
    if code in (4258, 4937):
        return "grs80", None, False
    if 25828 <= code <= 25838:
        return "grs80", code - 25800, False
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        return "wgs84", code % 100, code >= 32700
    raise ValueError(f"EPSG:{code} isn't known")


def is_known(code: Column) -> Column:
    """Whether ``transformed`` knows a code."""
    return F.coalesce(code.isin(4326, 4979, 4258, 4937) | code.between(25828, 25838) | code.between(32601, 32660) | code.between(32701, 32760), F.lit(False))


def system_info(code: Column) -> Column:
    """Struct (name, kind, is_3d) of a code, null if it isn't known."""
    geographic = code.isin(4326, 4979, 4258, 4937)
    base = F.when(code.isin(4326, 4979) | (code > 32000), "WGS 84").otherwise("ETRS89")
    zone = F.concat(base, F.lit(" / UTM zone "), (code % 100).cast("string"), F.when(code.between(32701, 32760), "S").otherwise("N"))
    return F.when(is_known(code), F.struct(F.when(geographic, base).otherwise(zone).alias("name"), F.when(geographic, "geographic").otherwise("projected").alias("kind"), code.isin(4979, 4937).alias("is_3d")))


def _series(ellipsoid: str) -> tuple[float, float, list[float], list[float]]:
    """(radius of the rectifying circle, first eccentricity, coefficients forward, coefficients back)."""
    a, f = ELLIPSOIDS[ellipsoid]
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return radius, math.sqrt(f * (2 - f)), forward, back


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def to_zone(p: Column, ellipsoid: str, zone: int, south: bool = False) -> Column:
    """Easting, northing and height of a point of longitude, latitude (degrees) and height."""
    radius, e, alpha, _ = _series(ellipsoid)

    def plane(q: Column) -> Column:
        xi, eta = q["x"], q["y"]
        north = _sum([xi, *[F.lit(c) * F.sin(2 * (k + 1) * xi) * F.cosh(2 * (k + 1) * eta) for k, c in enumerate(alpha)]])
        east = _sum([eta, *[F.lit(c) * F.cos(2 * (k + 1) * xi) * F.sinh(2 * (k + 1) * eta) for k, c in enumerate(alpha)]])
        return point(east * (_SCALE * radius) + _EAST, north * (_SCALE * radius) + (_NORTH if south else 0.0), q["z"])

    def conformal(q: Column) -> Column:
        return point(F.atan2(F.sinh(q["x"]), F.cos(q["y"])), F.atanh(F.sin(q["y"]) / F.cosh(q["x"])), q["z"])

    sine, turn = F.sin(F.radians(p["y"])), F.radians(p["x"] - (6 * zone - 183))
    psi = F.atanh(sine) - F.lit(e) * F.atanh(F.lit(e) * sine)
    return let(let(point(psi, turn, p["z"]), conformal), plane)


def from_zone(p: Column, ellipsoid: str, zone: int, south: bool = False) -> Column:
    """Longitude, latitude (degrees) and height of a point of easting, northing and height."""
    radius, e, _, beta = _series(ellipsoid)

    def sphere(q: Column) -> Column:
        xi = _sum([q["x"], *[F.lit(-c) * F.sin(2 * (k + 1) * q["x"]) * F.cosh(2 * (k + 1) * q["y"]) for k, c in enumerate(beta)]])
        eta = _sum([q["y"], *[F.lit(-c) * F.cos(2 * (k + 1) * q["x"]) * F.sinh(2 * (k + 1) * q["y"]) for k, c in enumerate(beta)]])
        return point(F.asin(F.sin(xi) / F.cosh(eta)), F.atan2(F.sinh(eta), F.cos(xi)), q["z"])

    def earth(q: Column) -> Column:
        psi = F.atanh(F.sin(q["x"]))
        step = lambda s: F.atanh(F.lit(e) * F.tanh(psi + F.lit(e) * s))
        inner = step(step(step(step(F.atanh(F.lit(e) * F.sin(q["x"]))))))
        return point(F.degrees(q["y"]) + (6 * zone - 183), F.degrees(F.asin(F.tanh(psi + F.lit(e) * inner))), q["z"])

    start = point((p["y"] - (_NORTH if south else 0.0)) / (_SCALE * radius), (p["x"] - _EAST) / (_SCALE * radius), p["z"])
    return let(let(start, sphere), earth)


def transformed(p: Column, source: int, target: int) -> Column:
    """A point (x: easting or longitude, y: northing or latitude, z) of one system in another; null stays null.

    Geographic systems, and the transverse Mercator zones of ETRS89 and WGS84, which are taken for the same datum. Heights stay.
    """
    a, b = system(source), system(target)
    if source == target:
        return p
    geographic = p if a[1] is None else from_zone(p, a[0], a[1], a[2])
    out = geographic if b[1] is None else let(geographic, lambda q: to_zone(q, b[0], b[1], b[2]))
    return F.when(p.isNotNull(), out)


def change_srid(df: DataFrame, column: str, source: int, target: int, transform: bool = True) -> DataFrame:
    """``df`` with the points of an array column in another system, or, without ``transform``, only its tag ``srid`` changed."""
    points = F.transform(column, lambda p: transformed(p, source, target)) if transform else F.col(column)
    return df.withColumn(column, points).withColumn("srid", F.lit(target))
