"""Labels of faces, planes and matrices as column expressions. A face is a ring; nz is the upward part of its unit normal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from urbanloom.functions.geometry import let, point

#: Thresholds of the labels (degrees from the vertical, parts of the unit normal).
ROOF_MAX_SLOPE, ROOF_MIN_SLOPE, WALL_MIN_SLOPE = 65.0, 10.0, 80.0
UPWARD, HORIZONTAL = 0.25, 0.97
FLOOR_TOP_MARGIN = 0.02


def slope(nz: Column) -> Column:
    """Degrees between the normal and the vertical."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), nz))))


def is_horizontal(nz: Column) -> Column:
    return F.abs(nz) >= HORIZONTAL


def is_vertical(nz: Column) -> Column:
    """Walls, and whatever looks down."""
    return slope(nz) >= WALL_MIN_SLOPE


def is_pitched(nz: Column) -> Column:
    """Whether a face has the slope of a roof."""
    return (nz >= UPWARD) & slope(nz).between(ROOF_MIN_SLOPE, ROOF_MAX_SLOPE)


def _first(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    return F.coalesce(*[F.when(c, label) for c, label in rules], F.lit(otherwise))


def building_label(nz: Column, z: Column, low: Column, area: Column) -> Column:
    """Label of a face of a building; z: height of its centre, low: that of the building's lowest point."""
    flat_up = is_horizontal(nz) & (nz > 0.9)
    rules = [(area == 0, "WallSurface"), (flat_up & (z < low + 0.3), "GroundSurface"), (is_pitched(nz), "RoofSurface"), (is_vertical(nz), "WallSurface"), (nz > 0, "RoofSurface")]
    return _first(rules, "WallSurface")


def bridge_label(nz: Column, z: Column, low: Column, area: Column) -> Column:
    """Label of a face of a bridge."""
    up, down = is_horizontal(nz) & (nz > 0), is_horizontal(nz) & (nz < 0)
    rules = [(area == 0, "WallSurface"), (up & (z <= low + 0.05), "GroundSurface"), (up, "OuterFloorSurface"), (down, "OuterCeilingSurface"), (is_pitched(nz), "RoofSurface")]
    return _first(rules, "WallSurface")


def corrected_building_label(label: Column, nz: Column, z: Column, low: Column, high: Column) -> Column:
    """A roof that looks down is a wall; a level wall that looks up is ground at the bottom, else roof."""

    def level(x: Column) -> Column:
        ground = (z < low + 0.05 * (high - low)) & (nz > 0)
        roof = (nz > 0) & (slope(nz) <= ROOF_MAX_SLOPE)
        return F.when((x == "WallSurface") & is_horizontal(nz), F.when(ground, "GroundSurface").when(roof, "RoofSurface").otherwise(x)).otherwise(x)

    return let(F.when((label == "RoofSurface") & (nz <= 0), "WallSurface").otherwise(label), level)


def corrected_bridge_label(label: Column, nz: Column, z: Column, low: Column, high: Column, on_top: Column, locked: Column) -> Column:
    """Corrections of a bridge's label in order; ``locked``: the upper one of a pair of plates, which stays an outer floor."""
    plate = F.when(nz > 0, "OuterFloorSurface").otherwise("OuterCeilingSurface")
    top = on_top | (z >= high - FLOOR_TOP_MARGIN * F.greatest(F.lit(1e-6), high - low))
    steps = [
        lambda x: F.when((x == "RoofSurface") & (nz <= 0), "WallSurface").otherwise(x),
        lambda x: F.when((x == "WallSurface") & is_horizontal(nz), plate).otherwise(x),
        lambda x: F.when((x == "OuterFloorSurface") & top & is_pitched(nz), "RoofSurface").otherwise(x),
        lambda x: F.when((x == "GroundSurface") & ~is_horizontal(nz), "WallSurface").otherwise(x),
        lambda x: F.when((x == "WallSurface") & ~is_vertical(nz), F.when(is_horizontal(nz), plate).when(is_pitched(nz), "RoofSurface").otherwise(x)).otherwise(x),
    ]
    return F.when(locked, "OuterFloorSurface").otherwise(reduce(let, steps, label))


def water_label(nz: Column, z: Column, mean_z: Column, height: Column) -> Column:
    """Label of a face of a water body; mean_z: of its vertices, height: from its lowest to its highest point."""
    level = F.abs(nz) > 0.9
    rules = [(level & (nz > 0), "WaterSurface"), (level, "WaterGroundSurface"), ((height > 0.5) & is_vertical(nz), "WaterClosureSurface"), (z < mean_z, "WaterGroundSurface")]
    return _first(rules, "WaterSurface")


def traffic_label(nz: Column, area: Column, mean_area: Column) -> Column:
    """Label of a face of a road: the large ones that look up carry traffic."""
    return F.when((nz > 0.9) & (area > 0.8 * mean_area), "TrafficArea").otherwise("AuxiliaryTrafficArea")


def interior_label(label: Column, nz: Column, z: Column, low: Column, high: Column) -> Column:
    """What a face between a fifth and four fifths of the height may be inside, else null."""
    span = F.greatest(F.lit(1e-6), high - low)
    middle = (z > low + 0.2 * span) & (z < high - 0.2 * span)
    floor = (nz > 0) & ~label.isin("OuterFloorSurface", "GroundSurface")
    flat = F.when(floor, "FloorSurface").when((nz <= 0) & (label != "OuterCeilingSurface"), "CeilingSurface")
    return F.when(middle & is_horizontal(nz), flat).when(middle & is_vertical(nz) & (label == "WallSurface"), "InteriorWallSurface")


#: Labels that only one type of feature has, in the order in which they decide.
OWN_LABELS = {
    "WATERBODY": ["WaterSurface", "WaterGroundSurface", "WaterClosureSurface"],
    "TRANSPORTATION": ["TrafficArea", "AuxiliaryTrafficArea", "Marking"],
    "CITYFURNITURE": ["CityFurniture"],
    "VEGETATION": ["VegetationObject", "PlantCover", "SolitaryVegetationObject"],
    "LANDUSE": ["LandUse"],
}


def type_of_labels(labels: Column) -> Column:
    """Type of feature that an array of distinct labels speaks for; null for none and for generic surfaces alone."""
    strings = lambda *names: F.array(*[F.lit(n) for n in names])
    has = lambda *names: F.arrays_overlap(labels, strings(*names))
    share = lambda *names: F.size(F.array_intersect(labels, strings(*names)))
    own = reduce(lambda c, kind: c.when(has(*OWN_LABELS[kind]), kind), OWN_LABELS, F.when(F.coalesce(F.size(labels), F.lit(0)) <= 0, F.lit(None).cast("string")))
    plates = has("OuterFloorSurface", "OuterCeilingSurface")
    bridge = share("OuterFloorSurface", "OuterCeilingSurface", "GroundSurface") >= share("GroundSurface", "WallSurface", "RoofSurface", "ClosureSurface")
    walls = has("GroundSurface", "WallSurface", "RoofSurface")
    return (
        own.when((F.size(labels) == 1) & has("GenericSurface"), F.lit(None).cast("string"))
        .when(plates & has("ClosureSurface"), F.when(bridge, "BRIDGE").otherwise("TUNNEL"))
        .when(plates, "BRIDGE")
        .when(walls & has("ClosureSurface"), "TUNNEL")
        .otherwise("BUILDING")
    )


def suggested_type(level_share: Column, height: Column, width: Column) -> Column:
    """Type of feature by its shape: flat ones are roads or, with some depth, water."""
    flat = F.when(height < 0.1 * width, "TRANSPORTATION").otherwise("WATERBODY")
    return F.when(level_share > 0.8, flat).otherwise("BUILDING")


def cross(a: Column, b: Column) -> Column:
    return point(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def minus(a: Column, b: Column) -> Column:
    return point(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def angle(a: Column, b: Column) -> Column:
    """Degrees between two unit vectors."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))))


def plane(a: Column, b: Column, c: Column) -> Column:
    """Plane (n, d) through three points, n of unit length and n.p + d = 0; null if they are on a line."""

    def unit(n: Column) -> Column:
        size = F.sqrt(dot(n, n))
        m = point(n["x"] / size, n["y"] / size, n["z"] / size)
        return F.when(size > 0, F.struct(m.alias("n"), (-dot(m, a)).alias("d")))

    return let(cross(minus(b, a), minus(c, a)), unit)


def plane_distance(p: Column, n: Column, d: Column) -> Column:
    """Distance of a point from a plane."""
    return F.abs(dot(n, p) + d)


def ring_turn(points: Column) -> Column:
    """1 if a ring turns against the clock in the plane of its two smaller extents, -1 if not, 0 for fewer than three points."""

    def turn(p: Column) -> Column:
        span = lambda k: F.array_max(F.transform(p, lambda q: q[k])) - F.array_min(F.transform(p, lambda q: q[k]))
        n = F.size(p)

        def area(u: str, v: str) -> Column:
            step = lambda s, i: s + F.get(p, i)[u] * F.get(p, (i + 1) % n)[v] - F.get(p, (i + 1) % n)[u] * F.get(p, i)[v]
            return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), step)

        rx, ry, rz = span("x"), span("y"), span("z")
        twice = F.when((rx >= ry) & (rx >= rz), area("y", "z")).when(ry >= rz, area("x", "z")).otherwise(area("x", "y"))
        return F.when(n < 3, 0).otherwise(F.when(twice > 0, 1).otherwise(-1))

    opened = F.when((F.size(points) > 1) & (F.try_element_at(points, F.lit(1)) == F.try_element_at(points, F.lit(-1))), F.slice(points, F.lit(1), F.size(points) - 1)).otherwise(points)
    return let(opened, turn)


def triangles(points: Column) -> Column:
    """A ring as a fan of triangles from its first point (array of arrays of three points); convex rings only come out whole."""

    def fan(p: Column) -> Column:
        return F.when(F.size(p) >= 3, F.transform(F.sequence(F.lit(1), F.size(p) - 2), lambda i: F.array(F.get(p, F.lit(0)), F.get(p, i), F.get(p, i + 1)))).otherwise(F.array().cast("array<array<struct<x:double,y:double,z:double>>>"))

    opened = F.when((F.size(points) > 1) & (F.try_element_at(points, F.lit(1)) == F.try_element_at(points, F.lit(-1))), F.slice(points, F.lit(1), F.size(points) - 1)).otherwise(points)
    return let(opened, fan)


def grid_triangles(rows: Column, cols: Column) -> Column:
    """Triangles (a, b, c) of a grid's vertex numbers, two to a cell, by row."""
    cell = lambda r, c: F.array(
        F.struct((r * cols + c).alias("a"), (r * cols + c + 1).alias("b"), (r * cols + c + cols + 1).alias("c")), F.struct((r * cols + c).alias("a"), (r * cols + c + cols + 1).alias("b"), (r * cols + c + cols).alias("c"))
    )
    every = F.flatten(F.flatten(F.transform(F.sequence(F.lit(0), rows - 2), lambda r: F.transform(F.sequence(F.lit(0), cols - 2), lambda c: cell(r, c)))))
    return F.when((rows >= 2) & (cols >= 2), every)


def rotation_matrix(rx: Column, ry: Column, rz: Column, sx: Column, sy: Column, sz: Column) -> Column:
    """4x4 matrix by row of a scaling, then rotations about x, y and z (radians)."""
    a, b, c = F.cos(rx), F.cos(ry), F.cos(rz)
    p, q, r = F.sin(rx), F.sin(ry), F.sin(rz)
    zero, one = F.lit(0.0), F.lit(1.0)
    cells = [
        c * b * sx, (c * q * p - r * a) * sy, (c * q * a + r * p) * sz, zero,
        r * b * sx, (r * q * p + c * a) * sy, (r * q * a - c * p) * sz, zero,
        -q * sx, b * p * sy, b * a * sz, zero, zero, zero, zero, one,
    ]
    return F.array(*cells)


def inverse_matrix(m: Column) -> Column:
    """Inverse of a 4x4 matrix by row, null if it has none."""
    at = lambda i, j: F.get(m, F.lit(4 * i + j))

    def minor(i: int, j: int) -> Column:
        r, c = [k for k in range(4) if k != i], [k for k in range(4) if k != j]
        two = lambda a, b, x, y: at(a, x) * at(b, y) - at(a, y) * at(b, x)
        return at(r[0], c[0]) * two(r[1], r[2], c[1], c[2]) - at(r[0], c[1]) * two(r[1], r[2], c[0], c[2]) + at(r[0], c[2]) * two(r[1], r[2], c[0], c[1])

    cofactors = F.array(*[(1 if (i + j) % 2 == 0 else -1) * minor(i, j) for i in range(4) for j in range(4)])

    def divide(k: Column) -> Column:
        det = sum((at(0, j) * F.get(k, F.lit(j)) for j in range(1, 4)), at(0, 0) * F.get(k, F.lit(0)))
        return F.when(F.abs(det) > 1e-300, F.array(*[F.get(k, F.lit(4 * j + i)) / det for i in range(4) for j in range(4)]))

    return let(cofactors, divide)


def snapped_matrix(m: Column, eps: float = 1e-9) -> Column:
    """A matrix whose numbers within ``eps`` of a whole number are that number."""
    return F.transform(m, lambda v: F.when(F.abs(v - F.round(v)) < eps, F.round(v) + 0.0).otherwise(v))


def reorigin_matrix(m: Column, ref: Column, origin: Column) -> Column:
    """A matrix moved by a reference point and then to another origin."""
    move = {3: ref["x"] - origin["x"], 7: ref["y"] - origin["y"], 11: ref["z"] - origin["z"]}
    return F.array(*[F.get(m, F.lit(k)) + move[k] if k in move else F.get(m, F.lit(k)) for k in range(16)])


def geometry_hash(points: Column) -> Column:
    """16 characters that are equal for equal points in equal order, to six digits."""
    text = F.array_join(F.transform(points, lambda p: F.concat_ws(" ", *[F.format_string("%.6f", F.bround(p[k], 6) + F.lit(0.0)) for k in ("x", "y", "z")])), ";")
    return F.substring(F.sha2(text, 256), 1, 16)


def batch_size(features: Column, memory_mb: Column) -> Column:
    """Features to handle at once: 25, 50 or 100 by their number, times 0.5 to 2 by the memory, from 10 to 200."""
    base = F.when(features < 100, 25).when(features < 1000, 50).otherwise(100)
    times = F.when(memory_mb < 1024, 0.5).when(memory_mb < 2048, 1.0).when(memory_mb < 4096, 1.5).otherwise(2.0)
    return F.greatest(F.lit(10), F.least(F.lit(200), F.floor(base * times))).cast("int")


def batch_size_for(memory_mb: Column, each_mb: Column, least: int = 10, most: int = 1000) -> Column:
    """Features of ``each_mb`` that fit four fifths of the memory, from ``least`` to ``most``."""
    fit = F.when(each_mb > 0, F.floor(memory_mb * 0.8 / each_mb)).otherwise(most)
    return F.greatest(F.lit(least), F.least(F.lit(most), fit)).cast("int")


def index_benefit(features: Column, part: Column) -> Column:
    """Struct (linear, indexed, speedup, saved_percent): rows looked at without and with a spatial index for a part of the extent."""
    indexed = 2.0 * F.sqrt(features) + features * part

    def out(x: Column) -> Column:
        speedup = F.when(x > 0, features / x).otherwise(1.0)
        return F.struct(features.cast("double").alias("linear"), F.floor(x).cast("long").alias("indexed"), speedup.alias("speedup"), F.when(speedup > 1, (1 - 1 / speedup) * 100).otherwise(0.0).alias("saved_percent"))

    return let(indexed, out)
