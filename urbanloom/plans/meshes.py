"""Queries on faces: the six faces of each feature's extent as a solid, with the SQL that follows from its measures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.functions import curves, geometry, mesh
from urbanloom.operators import mesh as solids
from urbanloom.session import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_SOLID = "(SELECT id, envelope[2].x - envelope[1].x AS w, envelope[2].y - envelope[1].y AS d, envelope[2].z - envelope[1].z AS h, envelope FROM feature WHERE envelope[2].x > envelope[1].x AND envelope[2].y > envelope[1].y AND envelope[2].z > envelope[1].z)"


def query(name: str, sql: str):
    """Registers a query of the faces of all features that have an extent in space."""

    def keep(f: Callable[[DataFrame, Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            feature = table(spark, sf_dir, "feature")
            low, high = F.col("envelope")[0], F.col("envelope")[1]
            solid = feature.filter((high["x"] > low["x"]) & (high["y"] > low["y"]) & (high["z"] > low["z"]))
            box = geometry.box(F.col("envelope").cast(geometry.POINTS))
            return f(solid.select("id", F.posexplode(geometry.box_faces(box)).alias("face", "ring")), lambda t: table(spark, sf_dir, t))

        QUERIES[name] = run
        SQL[name] = sql
        return f

    return keep


def _measured(faces: DataFrame) -> DataFrame:
    return solids.measured(faces, "id", "face", "ring")


@query("mesh_neighbours", f"SELECT id, 12 AS n, CAST(90 AS DOUBLE) AS dihedral FROM {_SOLID}")
def _(faces, t):
    pairs = solids.adjacency(_measured(faces))
    return pairs.groupBy(F.col("solid").alias("id")).agg(F.count("*").alias("n"), F.round(F.max("dihedral"), 6).alias("dihedral"))


@query("mesh_open_faces", f"SELECT id, 4 AS n FROM {_SOLID}")
def _(faces, t):
    return solids.open_faces(_measured(faces.filter("face <> 1"))).groupBy(F.col("solid").alias("id")).agg(F.count("*").alias("n"))


@query("mesh_closures", f"""SELECT id, f AS face FROM {_SOLID}, (SELECT unnest([2, 3, 4, 5]) AS f) WHERE CASE WHEN f < 4 THEN w * h ELSE d * h END < 40""")
def _(faces, t):
    return solids.open_faces(_measured(faces.filter("face <> 1")), 40.0).select(F.col("solid").alias("id"), "face")


_MIDDLE = "w + d + h - greatest(w, d, h) - least(w, d, h)"
_STEP = f"(SELECT *, greatest(least(2.0, greatest(0.25, {_MIDDLE})), greatest(w, d) / 200) AS step FROM {_SOLID})"
_RAY = " AND ".join(f"ceil(envelope[1].{k} / step - 0.5) <= floor(envelope[2].{k} / step - 0.5)" for k in "xy")


@query("mesh_seen_faces", f"SELECT id, f AS face, f = 1 AS from_above, f = 0 AS from_below FROM {_STEP}, range(2) AS r(f) WHERE {_RAY}")
def _(faces, t):
    own = cut(_measured(faces))
    step = own.groupBy("solid").agg(F.max("width").alias("width"), (F.max("high") - F.max("low")).alias("h"), F.max(F.array_max(F.transform("ring", lambda p: p["x"])) - F.array_min(F.transform("ring", lambda p: p["x"]))).alias("w"), F.max(F.array_max(F.transform("ring", lambda p: p["y"])) - F.array_min(F.transform("ring", lambda p: p["y"]))).alias("d"))
    # the middle of three edges, as the sum of all without the largest and the smallest: the same arithmetic as in SQL
    middle = F.col("w") + F.col("d") + F.col("h") - F.greatest("w", "d", "h") - F.least("w", "d", "h")
    steps = step.select("solid", F.greatest(F.least(F.lit(2.0), F.greatest(F.lit(0.25), middle)), F.greatest("w", "d") / 200).alias("step"))
    return solids.seen_faces(own, steps).select(F.col("solid").alias("id"), "face", "from_above", "from_below")


@query("mesh_building_labels", f"SELECT id, f AS face, CASE WHEN f = 0 THEN 'GroundSurface' WHEN f = 1 AND h >= 0.3 THEN 'RoofSurface' WHEN f = 1 THEN 'GroundSurface' ELSE 'WallSurface' END AS label FROM {_STEP}, range(6) AS r(f) WHERE h >= 0.31 AND w >= 2 * step AND d >= 2 * step")
def _(faces, t):
    own = cut(_measured(faces))
    sized = own.groupBy("solid").agg((F.max("high") - F.max("low")).alias("h"), F.max(F.array_max(F.transform("ring", lambda p: p["x"])) - F.array_min(F.transform("ring", lambda p: p["x"]))).alias("w"), F.max(F.array_max(F.transform("ring", lambda p: p["y"])) - F.array_min(F.transform("ring", lambda p: p["y"]))).alias("d"))
    middle = F.col("w") + F.col("d") + F.col("h") - F.greatest("w", "d", "h") - F.least("w", "d", "h")
    step = F.greatest(F.least(F.lit(2.0), F.greatest(F.lit(0.25), middle)), F.greatest("w", "d") / 200)
    wide = sized.filter((F.col("h") >= 0.31) & (F.col("w") >= 2 * step) & (F.col("d") >= 2 * step)).select("solid")
    return solids.building_labels(own).join(wide, "solid").select(F.col("solid").alias("id"), "face", "label")


@query("mesh_bridge_labels", f"SELECT label, count(*) AS n FROM (SELECT CASE WHEN f = 0 THEN 'OuterCeilingSurface' WHEN f > 1 THEN 'WallSurface' WHEN h > 0.051 THEN 'OuterFloorSurface' END AS label FROM {_SOLID}, range(6) AS r(f) WHERE h > 0.051) GROUP BY label")
def _(faces, t):
    own = _measured(faces).filter(F.col("high") - F.col("low") > 0.051)
    return solids.bridge_labels(own).groupBy("label").agg(F.count("*").alias("n"))


@query("mesh_plates", f"SELECT id FROM {_SOLID} WHERE h >= 0.05 AND h <= greatest(0.05, 0.08 * sqrt(w * w + d * d + h * h))")
def _(faces, t):
    return solids.plate_pairs(_measured(faces)).select(F.col("solid").alias("id"))


@query("mesh_types", f"SELECT id, CASE WHEN h < 0.1 * greatest(w, d) THEN 'TRANSPORTATION' ELSE 'WATERBODY' END AS type FROM {_SOLID}")
def _(faces, t):
    return solids.suggested_types(_measured(faces.filter("face < 2"))).select(F.col("solid").alias("id"), "type")


@query("mesh_traffic_labels", f"SELECT id, CASE WHEN w * d > 0.8 * ((2 * w * d + 2 * w * h + 2 * d * h) / 6) THEN 'TrafficArea' ELSE 'AuxiliaryTrafficArea' END AS top, 'AuxiliaryTrafficArea' AS side FROM {_SOLID}")
def _(faces, t):
    told = _measured(faces).withColumn("label", mesh.traffic_label(F.col("nz"), F.col("area"), F.col("mean_area")))
    return told.groupBy(F.col("solid").alias("id")).agg(F.max(F.when(F.col("face") == 1, F.col("label"))).alias("top"), F.max(F.when(F.col("face") > 1, F.col("label"))).alias("side"))


@query("mesh_water_labels", f"SELECT label, count(*) AS n FROM (SELECT CASE WHEN f = 0 THEN 'WaterGroundSurface' WHEN f = 1 THEN 'WaterSurface' ELSE 'WaterClosureSurface' END AS label FROM {_SOLID}, range(6) AS r(f) WHERE h > 0.5) GROUP BY label")
def _(faces, t):
    own = _measured(faces).filter(F.col("high") - F.col("low") > 0.5)
    return own.groupBy(mesh.water_label(F.col("nz"), F.col("c.z"), (F.col("low") + F.col("high")) / 2, F.col("high") - F.col("low")).alias("label")).agg(F.count("*").alias("n"))


@query("mesh_inner_rings", f"SELECT id, 1 AS \"outer\", 10 AS \"inner\" FROM {_SOLID} WHERE w > 1 AND d > 1")
def _(faces, t):
    low, high = (lambda k: F.array_min(F.transform("ring", lambda p: p[k]))), (lambda k: F.array_max(F.transform("ring", lambda p: p[k])))
    wide = faces.filter((F.col("face") == 1) & (high("x") - low("x") > 1) & (high("y") - low("y") > 1))
    shrunk = F.reverse(F.transform("ring", lambda p: geometry.point((p["x"] + (low("x") + high("x")) / 2) / 2, (p["y"] + (low("y") + high("y")) / 2) / 2, p["z"])))
    own = wide.select("id", "face", "ring").unionAll(wide.select("id", F.lit(10).alias("face"), shrunk.alias("ring")))
    return solids.inner_rings(_measured(own)).select(F.col("solid").alias("id"), "outer", "inner")


@query("label_types", """SELECT feature_id, CASE WHEN list_has_any(labels, ['WaterSurface', 'WaterGroundSurface', 'WaterClosureSurface']) THEN 'WATERBODY' WHEN list_contains(labels, 'CityFurniture') THEN 'CITYFURNITURE' WHEN list_contains(labels, 'PlantCover') THEN 'VEGETATION'
WHEN list_has_any(labels, ['GroundSurface', 'WallSurface', 'RoofSurface']) AND list_contains(labels, 'ClosureSurface') THEN 'TUNNEL' ELSE 'BUILDING' END AS type
FROM (SELECT p.feature_id, list_distinct(list(o.classname)) AS labels FROM property p JOIN feature f ON f.id = p.val_feature_id JOIN objectclass o ON o.id = f.objectclass_id WHERE p.val_relation_type = 1 GROUP BY p.feature_id)""")
def _(faces, t):
    kinds = t("feature").select(F.col("id").alias("val_feature_id"), "objectclass_id").join(t("objectclass").select(F.col("id").alias("objectclass_id"), "classname"), "objectclass_id")
    held = t("property").filter("val_relation_type = 1").select("feature_id", "val_feature_id").distinct().join(kinds, "val_feature_id")
    return held.groupBy("feature_id").agg(F.collect_set("classname").alias("labels")).select("feature_id", mesh.type_of_labels(F.col("labels")).alias("type"))


@query("matrix_inverses", f"SELECT id, true AS ok FROM {_SOLID}")
def _(faces, t):
    low, high = F.col("envelope")[0], F.col("envelope")[1]
    size = {k: high[k] - low[k] for k in "xyz"}
    solid = t("feature").filter((size["x"] > 0) & (size["y"] > 0) & (size["z"] > 0))
    turned = mesh.rotation_matrix(size["x"] / 7, size["y"] / 5, size["z"] / 3, F.lit(2.0), F.lit(0.5), F.lit(4.0))
    both = solid.select("id", turned.alias("m")).select("id", geometry.matrix_product(F.col("m"), mesh.inverse_matrix(F.col("m"))).alias("p"))
    one = F.array(*[F.lit(float(k % 5 == 0)) for k in range(16)])
    return both.select("id", (mesh.snapped_matrix(F.col("p")) == one).alias("ok"))


@query("batch_sizes", """SELECT objectclass_id, CAST(greatest(10, least(200, floor(CASE WHEN n < 100 THEN 25 WHEN n < 1000 THEN 50 ELSE 100 END * CASE WHEN mb < 1024 THEN 0.5 WHEN mb < 2048 THEN 1 WHEN mb < 4096 THEN 1.5 ELSE 2 END))) AS INTEGER) AS batch,
CAST(greatest(10, least(1000, floor(mb * 0.8 / 0.5))) AS INTEGER) AS fit, CAST(floor(2 * sqrt(n) + n * 0.1) AS BIGINT) AS looked_at, greatest(50.0, round_even(n / 1000.0 * 10 + n * 0.5, 1)) AS memory
FROM (SELECT objectclass_id, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) * 20 AS DOUBLE) AS mb FROM feature GROUP BY objectclass_id)""")
def _(faces, t):
    n, mb = F.col("n"), F.col("mb")
    sized = t("feature").groupBy("objectclass_id").agg(F.count("*").cast("double").alias("n")).withColumn("mb", n * 20)
    memory = F.greatest(F.lit(50.0), F.bround(n / 1000 * 10 + n * 0.5, 1))
    return sized.select("objectclass_id", mesh.batch_size(n, mb).alias("batch"), mesh.batch_size_for(mb, F.lit(0.5)).alias("fit"), mesh.index_benefit(n, F.lit(0.1))["indexed"].alias("looked_at"), memory.alias("memory"))


def _flat(t) -> DataFrame:
    """(id, l, h): corners of all extents with some width and depth."""
    low, high = F.col("envelope")[0], F.col("envelope")[1]
    return t("feature").filter((high["x"] > low["x"]) & (high["y"] > low["y"])).select("id", low.alias("l"), high.alias("h"))


_WIDE = "(SELECT id, envelope[1] AS l, envelope[2] AS h FROM feature WHERE envelope[2].x > envelope[1].x AND envelope[2].y > envelope[1].y)"


@query("arc_points", f"SELECT id, 17 AS n, true AS on_circle, true AS ends, 33 AS n_circle FROM {_WIDE}")
def _(faces, t):
    a, b, c = (lambda: geometry.point(F.col("l.x"), F.col("l.y"), F.col("l.z"))), (lambda: geometry.point(F.col("h.x"), F.col("l.y"), F.col("l.z"))), (lambda: geometry.point(F.col("h.x"), F.col("h.y"), F.col("l.z")))
    made = _flat(t).withColumn("arc", curves.arc_through(a(), b(), c())).withColumn("round", curves.circle_through(a(), b(), c()))
    x, y = (F.col("l.x") + F.col("h.x")) / 2, (F.col("l.y") + F.col("h.y")) / 2
    radius = F.hypot(F.col("h.x") - F.col("l.x"), F.col("h.y") - F.col("l.y")) / 2
    on = F.forall(F.concat("arc", "round"), lambda p: F.abs(F.hypot(p["x"] - x, p["y"] - y) - radius) < 1e-6)
    near = lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]) < 1e-6
    ends = near(F.get("arc", F.lit(0)), F.col("l")) & near(F.get("arc", F.lit(16)), F.col("h")) & near(F.get("round", F.lit(32)), F.col("l"))
    return made.select("id", F.size("arc").alias("n"), on.alias("on_circle"), ends.alias("ends"), F.size("round").alias("n_circle"))


@query("inside_or_on", f"SELECT id, h.x >= 10000 AND h.x <= 30000 AND h.y >= 10000 AND h.y <= 30000 AS corner, true AS own FROM {_WIDE}")
def _(faces, t):
    square = F.array(*[geometry.point(F.lit(float(x)), F.lit(float(y)), F.lit(0.0)) for x, y in ((10000, 10000), (30000, 10000), (30000, 30000), (10000, 30000))])
    own = F.array(*[geometry.point(x, y, F.col("l.z")) for x, y in ((F.col("l.x"), F.col("l.y")), (F.col("h.x"), F.col("l.y")), (F.col("h.x"), F.col("h.y")), (F.col("l.x"), F.col("h.y")))])
    both = _flat(t).withColumn("own", own)
    return both.select("id", curves.inside_or_on(F.col("h.x"), F.col("h.y"), square, 0.0).alias("corner"), curves.inside_or_on(F.col("h.x"), (F.col("l.y") + F.col("h.y")) / 2, F.col("own")).alias("own"))


@query("ring_signatures", f"SELECT id, true AS alike, false AS hashed_alike, 4 AS n_points FROM {_SOLID}")
def _(faces, t):
    turned = F.reverse(F.concat(F.slice("ring", F.lit(3), F.size("ring") - 2), F.slice("ring", F.lit(2), F.lit(2))))
    both = faces.filter("face = 1").withColumn("turned", turned)
    same = geometry.signature(F.col("ring")) == geometry.signature(F.col("turned"))
    hashed = mesh.geometry_hash(F.col("ring")) == mesh.geometry_hash(F.col("turned"))
    return both.select("id", same.alias("alike"), hashed.alias("hashed_alike"), F.size(geometry.unique_points(F.col("ring"))).alias("n_points"))


@query("moved_points", f"SELECT id, 2 * l.x + 5 - 7 AS x, 2 * l.y + 6 - 8 AS y, l.z - 9 AS z FROM {_WIDE}")
def _(faces, t):
    matrix = F.array(*[F.lit(float(v)) for v in (2, 0, 0, 5, 0, 2, 0, 6, 0, 0, 1, 0, 0, 0, 0, 1)])
    point = F.array(geometry.point(F.col("l.x"), F.col("l.y"), F.col("l.z")))
    moved = geometry.shifted(geometry.affine(point, matrix), F.lit(7.0), F.lit(8.0), F.lit(9.0))
    return _flat(t).select("id", F.get(moved, F.lit(0)).alias("p")).select("id", "p.*")


@query("fitted_uvs", f"SELECT id, true AS fits FROM {_WIDE} WHERE h.x - l.x > 1 AND h.y - l.y > 1")
def _(faces, t):
    w, d = F.col("h.x") - F.col("l.x"), F.col("h.y") - F.col("l.y")
    corner = lambda x, y, u, v: F.struct(x.alias("x"), y.alias("y"), F.lit(u).alias("u"), F.lit(v).alias("v"))
    zero = F.lit(0.0)
    source = F.array(corner(zero, zero, 0.0, 0.0), corner(w, zero, 1.0, 0.0), corner(w, d, 1.0, 1.0), corner(zero, d, 0.0, 1.0))
    middle = F.array(F.struct((w / 2).alias("x"), (d / 4).alias("y")))
    wide = _flat(t).filter((w > 1) & (d > 1)).withColumn("uv", F.get(curves.fitted_uvs(source, middle), F.lit(0)))
    return wide.select("id", ((F.abs(F.col("uv.u") - 0.5) < 1e-6) & (F.abs(F.col("uv.v") - 0.25) < 1e-6)).alias("fits"))


@query("grid_faces", f"SELECT id, 2 * (n - 1) * 3 AS triangles, n * 4 - 1 AS last FROM (SELECT id, 2 + id % 5 AS n FROM {_WIDE})")
def _(faces, t):
    made = _flat(t).select("id", (2 + F.col("id") % 5).alias("n")).withColumn("f", mesh.grid_triangles(F.col("n"), F.lit(4).cast("long")))
    return made.select("id", F.size("f").cast("long").alias("triangles"), F.array_max(F.transform("f", lambda x: F.greatest(x["a"], x["b"], x["c"]))).alias("last"))
