"""Faces of solids as a table: normals and labels, neighbours, groups of coplanar faces, pairs of plates, faces seen from above."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanloom.functions import mesh
from urbanloom.functions.geometry import area, box, inside, let, point, unit_normal
from urbanloom.session import cut

#: Thresholds of pairs of plates, coplanar groups and roof regions.
PAIR_LEAST, PAIR_MOST_OF_DIAGONAL, PAIR_SHIFT = 0.05, 0.08, 0.40
COPLANAR_DEGREES, COPLANAR_OF_DIAGONAL = 3.0, 0.01
REGION_DEGREES, REGION_HEIGHT = 12.0, 0.25
GROUND_BAND, GROUND_SUPPORT = 0.08, 0.02


def measured(faces: DataFrame, solid: str, face: str, ring: str) -> DataFrame:
    """(solid, face, ring, n, nz, area, c, low, high, diagonal, mean_area): each face with its solid's measures; rings of fewer than three points are no faces."""
    opened = F.when((F.size(ring) > 1) & (F.try_element_at(ring, F.lit(1)) == F.try_element_at(ring, F.lit(-1))), F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(F.col(ring))
    own = faces.select(F.col(solid).alias("solid"), F.col(face).alias("face"), opened.alias("ring")).filter(F.size("ring") >= 3)
    mean = lambda k: F.aggregate("ring", F.lit(0.0), lambda s, p: s + p[k]) / F.size("ring")
    own = own.withColumn("n", unit_normal(F.col("ring"))).withColumn("area", area(F.col("ring"))).withColumn("c", point(mean("x"), mean("y"), mean("z"))).withColumn("__b", box(F.col("ring")))
    low, high = [F.min(f"__b.min_{k}") for k in "xyz"], [F.max(f"__b.max_{k}") for k in "xyz"]
    span = F.sqrt(sum(((b - a) * (b - a) for a, b in zip(low[1:], high[1:], strict=True)), (high[0] - low[0]) * (high[0] - low[0])))
    width = F.greatest(high[0] - low[0], high[1] - low[1])
    of = own.groupBy("solid").agg(low[2].alias("low"), high[2].alias("high"), span.alias("diagonal"), width.alias("width"), F.avg("area").alias("mean_area"))
    return own.drop("__b").join(of, "solid").withColumn("nz", F.col("n.z"))


def _edges(faces: DataFrame, digits: int = 6) -> DataFrame:
    at = lambda p: F.struct(*[F.bround(p[k], digits).alias(k) for k in "xyz"])
    n = F.size("ring")
    ends = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_sort(F.array(at(F.get("ring", i)), at(F.get("ring", (i + 1) % n)))))
    return faces.select("solid", "face", F.explode(ends).alias("edge"))


def adjacency(faces: DataFrame) -> DataFrame:
    """(solid, a, b, dihedral): pairs of faces of a solid, a < b, that share an edge which only they have; degrees between their normals."""
    twos = _edges(faces).groupBy("solid", "edge").agg(F.count("*").alias("uses"), F.min("face").alias("a"), F.max("face").alias("b")).filter("uses = 2 and a <> b")
    pairs = twos.select("solid", "a", "b").distinct()
    of = lambda name: faces.select("solid", F.col("face").alias(name), F.col("n").alias(f"n{name}"))
    return pairs.join(of("a"), ["solid", "a"]).join(of("b"), ["solid", "b"]).select("solid", "a", "b", mesh.angle(F.col("na"), F.col("nb")).alias("dihedral"))


def open_faces(faces: DataFrame, most_area: float | None = None) -> DataFrame:
    """(solid, face) of faces with an edge that no other face has; with ``most_area`` only smaller ones, which may close a gap."""
    alone = _edges(faces).groupBy("solid", "edge").agg(F.count("*").alias("uses"), F.min("face").alias("face")).filter("uses = 1").select("solid", "face").distinct()
    return alone if most_area is None else alone.join(faces.filter(F.col("area") < most_area).select("solid", "face"), ["solid", "face"], "left_semi")


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, group) of ``nodes`` (node): group is the smallest node that can be reached over ``links`` (a, b) in any direction.

    Each round takes the smallest group among the neighbours, then that group's own group: the rounds grow with the
    logarithm of a chain's length, not with the length.
    """
    both = cut(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    group = cut(nodes.select("node").distinct().withColumn("group", F.col("node")))
    while True:
        near = both.join(group.select(F.col("node").alias("b"), "group"), "b").groupBy(F.col("a").alias("node")).agg(F.min("group").alias("near"))
        least = group.join(near, "node", "left").select("node", "group", F.least("group", "near").alias("new"))
        # a group whose own node has found a smaller one goes along
        up = least.groupBy("group").agg(F.min("new").alias("up"))
        moved = cut(least.join(up, "group").select("node", F.least("new", "up").alias("next"), (F.least("new", "up") < F.col("group")).alias("moved")))
        top = moved.select(F.col("node").alias("next"), F.col("next").alias("top"))
        group = cut(moved.join(top, "next", "left").select("node", F.coalesce("top", "next").alias("group")))
        if moved.filter("moved").isEmpty():
            return group


def _grouped(faces: DataFrame, linked: Column, among: DataFrame) -> DataFrame:
    """``faces`` with the group of neighbouring faces that ``linked`` holds for, over the pairs ``among``."""
    key = lambda name: F.struct("solid", F.col(name).alias("face"))
    of = lambda name: faces.select("solid", F.col("face").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("n", "c", "nz", "low", "high", "diagonal")])
    pairs = among.join(of("a"), ["solid", "a"]).join(of("b"), ["solid", "b"]).filter(linked).select(key("a").alias("a"), key("b").alias("b"))
    groups = connected(faces.select(F.struct("solid", "face").alias("node")), pairs)
    return faces.join(groups.select(F.col("node.solid").alias("solid"), F.col("node.face").alias("face"), F.col("group.face").alias("group")), ["solid", "face"])


def coplanar_groups(faces: DataFrame) -> DataFrame:
    """``faces`` with ``group``, the smallest face of those that neighbours in one plane lead to."""
    n, d = F.col("n_a"), -mesh.dot(F.col("n_a"), F.col("c_a"))
    flat = (mesh.angle(n, F.col("n_b")) <= COPLANAR_DEGREES) & (mesh.plane_distance(F.col("c_b"), n, d) <= F.greatest(F.lit(1e-5), COPLANAR_OF_DIAGONAL * F.col("diagonal_a")))
    return _grouped(faces, flat, adjacency(faces))


def majority_labels(groups: DataFrame, label: str) -> DataFrame:
    """``groups`` (see ``coplanar_groups``) with each face's label replaced by the commonest of its group, of equally common ones the first by name."""
    votes = groups.groupBy("solid", "group", label).agg(F.count("*").alias("__n"))
    best = votes.groupBy("solid", "group").agg(F.min_by(label, F.struct(-F.col("__n"), F.col(label))).alias("__label"))
    return groups.drop(label).join(best, ["solid", "group"]).withColumnRenamed("__label", label)


def roof_regions(faces: DataFrame, seeds: Column) -> DataFrame:
    """(solid, face) of roof regions: connected faces of like slope and height that hold a seed, three or more, that look up."""
    height = lambda k: (F.col(f"c_{k}.z") - F.col(f"low_{k}")) / F.greatest(F.lit(1e-6), F.col(f"high_{k}") - F.col(f"low_{k}"))
    like = (mesh.angle(F.col("n_a"), F.col("n_b")) <= REGION_DEGREES) & ~mesh.is_vertical(F.col("nz_a")) & ~mesh.is_vertical(F.col("nz_b")) & (F.abs(height("a") - height("b")) <= REGION_HEIGHT)
    regions = cut(_grouped(faces.withColumn("seed", seeds), like, adjacency(faces)))
    middle = regions.groupBy("solid", "group").agg(F.bool_or("seed").alias("seeded"), F.count("*").alias("n"), F.percentile(F.greatest(F.lit(0.0), F.col("nz")), F.lit(0.5)).alias("up"), F.percentile(mesh.slope(F.col("nz")), F.lit(0.5)).alias("slope"))
    good = middle.filter(F.col("seeded") & (F.col("n") >= 3) & (F.col("up") >= mesh.UPWARD) & (F.col("slope") <= mesh.ROOF_MAX_SLOPE))
    return regions.join(good.select("solid", "group"), ["solid", "group"], "left_semi").select("solid", "face")


def plate_pairs(faces: DataFrame) -> DataFrame:
    """(solid, upper, lower): level faces that look up with one that looks down a plate's thickness away and hardly aside.

    Met on a grid of the largest shift, so a face only meets those near it.
    """
    level = faces.filter(mesh.is_horizontal(F.col("nz"))).withColumn("gx", F.floor(F.col("c.x") / PAIR_SHIFT)).withColumn("gy", F.floor(F.col("c.y") / PAIR_SHIFT))
    around = F.explode(F.array(*[F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    up = level.filter("nz > 0").select("solid", F.col("face").alias("upper"), F.col("c").alias("cu"), "diagonal", around.alias("g")).select("solid", "upper", "cu", "diagonal", "g.gx", "g.gy")
    down = level.filter("nz < 0").select("solid", F.col("face").alias("lower"), F.col("c").alias("cd"), "gx", "gy")
    thick, aside = F.abs(F.col("cu.z") - F.col("cd.z")), F.hypot(F.col("cu.x") - F.col("cd.x"), F.col("cu.y") - F.col("cd.y"))
    most = F.greatest(F.lit(PAIR_LEAST), PAIR_MOST_OF_DIAGONAL * F.col("diagonal"))
    return up.join(down, ["solid", "gx", "gy"]).filter((thick >= PAIR_LEAST) & (thick <= most) & (aside <= PAIR_SHIFT)).select("solid", "upper", "lower").distinct()


def grid_step(faces: DataFrame, rays: int = 200) -> DataFrame:
    """(solid, step): median length of a solid's distinct edges, from 0.25 to 2, but so many that ``rays`` steps span the solid."""
    edge = _edges(faces).select("solid", "edge").distinct()
    a, b = F.col("edge")[0], F.col("edge")[1]
    length = F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 + (a["z"] - b["z"]) ** 2)
    step = edge.groupBy("solid").agg(F.least(F.lit(2.0), F.greatest(F.lit(0.25), F.percentile(length, F.lit(0.5)))).alias("step"))
    return step.join(faces.groupBy("solid").agg(F.max("width").alias("width")), "solid").select("solid", F.greatest("step", F.col("width") / rays).alias("step"))


def seen_faces(faces: DataFrame, steps: DataFrame) -> DataFrame:
    """(solid, face, from_above, from_below): whether a face is the first that vertical rays on the solid's grid meet.

    Rays are grid points in the middle of cells of ``steps`` (solid, step); a face meets those inside its outline, and of
    the faces that a ray meets the highest and the lowest are seen.
    """
    flat = faces.filter(F.abs("nz") > 1e-9).join(steps, "solid").withColumn("b", box(F.col("ring")))
    cells = lambda k: F.sequence(F.ceil(F.col(f"b.min_{k}") / F.col("step") - 0.5), F.floor(F.col(f"b.max_{k}") / F.col("step") - 0.5))
    some = flat.filter((F.ceil(F.col("b.min_x") / F.col("step") - 0.5) <= F.floor(F.col("b.max_x") / F.col("step") - 0.5)) & (F.ceil(F.col("b.min_y") / F.col("step") - 0.5) <= F.floor(F.col("b.max_y") / F.col("step") - 0.5)))
    rays = some.withColumn("i", F.explode(cells("x"))).withColumn("j", F.explode(cells("y")))
    x, y = (F.col("i") + 0.5) * F.col("step"), (F.col("j") + 0.5) * F.col("step")
    z = F.col("c.z") - ((x - F.col("c.x")) * F.col("n.x") + (y - F.col("c.y")) * F.col("n.y")) / F.col("nz")
    met = rays.filter(inside(x, y, F.col("ring"))).select("solid", "face", "i", "j", z.alias("z"))
    first = met.groupBy("solid", "i", "j").agg(F.max_by("face", F.struct("z", "face")).alias("above"), F.min_by("face", F.struct("z", "face")).alias("below"))
    sides = first.select("solid", F.col("above").alias("face"), F.lit(True).alias("up")).unionAll(first.select("solid", F.col("below").alias("face"), F.lit(False).alias("up")))
    return sides.groupBy("solid", "face").agg(F.bool_or("up").alias("from_above"), F.bool_or(~F.col("up")).alias("from_below"))


def ground_faces(faces: DataFrame, seen: DataFrame) -> DataFrame:
    """(solid, face) of level faces near the bottom that are seen from below and carry a neighbour that isn't level and stands higher."""
    span = F.greatest(F.lit(1e-6), F.col("high") - F.col("low"))
    near = faces.filter(mesh.is_horizontal(F.col("nz")) & (F.col("c.z") <= F.col("low") + GROUND_BAND * span)).join(seen.filter("from_below"), ["solid", "face"], "left_semi")
    pairs = adjacency(faces)
    both = pairs.select("solid", F.col("a").alias("face"), F.col("b").alias("other")).unionAll(pairs.select("solid", F.col("b").alias("face"), F.col("a").alias("other")))
    other = faces.filter(~mesh.is_horizontal(F.col("nz"))).select("solid", F.col("face").alias("other"), F.col("c.z").alias("z"))
    carried = near.join(both, ["solid", "face"]).join(other, ["solid", "other"]).filter(F.col("z") > F.col("c.z") + GROUND_SUPPORT * span)
    return carried.select("solid", "face").distinct()


def building_labels(faces: DataFrame) -> DataFrame:
    """(solid, face, label) of buildings: by normal and height, ground and roof regions found, coplanar neighbours alike, corrected."""
    faces = cut(faces)
    seen = seen_faces(faces, grid_step(faces))
    first = faces.withColumn("label", mesh.building_label(F.col("nz"), F.col("c.z"), F.col("low"), F.col("area")))
    ground = ground_faces(faces, seen).withColumn("ground", F.lit(True))
    roof = roof_regions(faces, mesh.is_pitched(F.col("nz"))).withColumn("roof", F.lit(True))
    told = first.join(ground, ["solid", "face"], "left").join(roof, ["solid", "face"], "left")
    told = told.withColumn("label", F.when(F.col("ground"), "GroundSurface").when(F.col("roof"), "RoofSurface").otherwise(F.col("label"))).drop("ground", "roof")
    groups = coplanar_groups(faces).select("solid", "face", "group")
    alike = majority_labels(told.join(groups, ["solid", "face"]), "label")
    return alike.select("solid", "face", mesh.corrected_building_label(F.col("label"), F.col("nz"), F.col("c.z"), F.col("low"), F.col("high")).alias("label"))


def bridge_labels(faces: DataFrame) -> DataFrame:
    """(solid, face, label) of bridges: by normal and height, upper plates of pairs locked, coplanar neighbours alike, corrected."""
    faces = cut(faces)
    seen = seen_faces(faces, grid_step(faces)).select("solid", "face", "from_above")
    plates = plate_pairs(faces).select("solid", F.col("upper").alias("face")).distinct().withColumn("plate", F.lit(True))
    first = faces.withColumn("label", mesh.bridge_label(F.col("nz"), F.col("c.z"), F.col("low"), F.col("area")))
    alike = majority_labels(first.join(coplanar_groups(faces).select("solid", "face", "group"), ["solid", "face"]), "label")
    told = alike.join(seen, ["solid", "face"], "left").join(plates, ["solid", "face"], "left")
    no = F.lit(False)
    label = mesh.corrected_bridge_label(F.col("label"), F.col("nz"), F.col("c.z"), F.col("low"), F.col("high"), F.coalesce("from_above", no), F.coalesce("plate", no))
    return told.select("solid", "face", label.alias("label"))


def suggested_types(faces: DataFrame) -> DataFrame:
    """(solid, type) by shape; see ``mesh.suggested_type``."""
    level = F.avg((F.abs("nz") > 0.9).cast("double"))
    return faces.groupBy("solid").agg(mesh.suggested_type(level, F.max("high") - F.max("low"), F.max("width")).alias("type"))


def inner_rings(faces: DataFrame, most_distance: float = 1e-3, most_degrees: float = 2.0) -> DataFrame:
    """(solid, outer, inner): for each face the smallest larger one of its solid that looks the other way, in one plane with it, and holds all its points.

    Faces meet by their plane (rounded normal and distance), not all with all.
    """
    down = lambda n: F.when((n["z"] < -1e-9) | ((F.abs(n["z"]) <= 1e-9) & ((n["y"] < -1e-9) | ((F.abs(n["y"]) <= 1e-9) & (n["x"] < 0)))), -1.0).otherwise(1.0)
    side = down(F.col("n"))
    planed = faces.filter("area > 1e-9").withColumn("side", side).withColumn("m", point(F.col("n.x") * side, F.col("n.y") * side, F.col("n.z") * side))
    far = mesh.dot(F.col("m"), F.col("c"))
    planed = planed.withColumn("far", far).withColumn("axis", F.when((F.abs("m.x") >= F.abs("m.y")) & (F.abs("m.x") >= F.abs("m.z")), "x").when(F.abs("m.y") >= F.abs("m.z"), "y").otherwise("z"))
    bin_ = F.floor(F.col("far") / (4 * most_distance))
    outer = planed.select("solid", "axis", F.explode(F.array(bin_ - 1, bin_, bin_ + 1)).alias("bin"), F.col("face").alias("outer"), F.col("ring").alias("ro"), F.col("area").alias("ao"), F.col("m").alias("mo"), F.col("far").alias("fo"), F.col("side").alias("so"))
    inner = planed.select("solid", "axis", bin_.alias("bin"), F.col("face").alias("inner"), F.col("ring").alias("ri"), F.col("area").alias("ai"), F.col("m").alias("mi"), F.col("side").alias("si"))
    plane = (F.col("outer") != F.col("inner")) & (F.col("so") != F.col("si")) & (F.col("ao") > F.col("ai") + 1e-9) & (mesh.angle(F.col("mo"), F.col("mi")) <= most_degrees)
    near = ~F.exists("ri", lambda p: F.abs(mesh.dot(F.col("mo"), p) - F.col("fo")) > most_distance)
    two = {"x": ("y", "z"), "y": ("x", "z"), "z": ("x", "y")}

    def holds(axis: str) -> Column:
        u, v = two[axis]
        flat = F.transform("ro", lambda p: point(p[u], p[v], F.lit(0.0)))
        return let(flat, lambda r: F.forall("ri", lambda p: inside(p[u], p[v], r)))

    held = F.when(F.col("axis") == "x", holds("x")).when(F.col("axis") == "y", holds("y")).otherwise(holds("z"))
    found = outer.join(inner, ["solid", "axis", "bin"]).filter(plane).filter(near).filter(held)
    return found.groupBy("solid", "inner").agg(F.min_by("outer", F.struct(F.col("ao") - F.col("ai"), F.col("outer"))).alias("outer")).select("solid", "outer", "inner")


def numbered_points(points: DataFrame, key: list[str], order: Column, digits: int = 9) -> DataFrame:
    """``points`` (key, x, y, z) with ``place``, the number from 0 on of each distinct rounded point of its key by first appearance."""
    at = [F.bround(k, digits).alias(f"__{k}") for k in "xyz"]
    named = points.withColumns({f"__{k}": c for k, c in zip("xyz", at, strict=True)}).withColumn("__order", order)
    firsts = named.groupBy(*key, "__x", "__y", "__z").agg(F.min("__order").alias("__first"))
    placed = firsts.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy("__first")) - 1)
    return named.join(placed, [*key, "__x", "__y", "__z"]).drop("__x", "__y", "__z", "__order", "__first")
