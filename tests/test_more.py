import math
import struct

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from urbanloom.functions import curves, geometry, mesh, projection
from urbanloom.operators import catalog, filters, relations, rollups
from urbanloom.operators import mesh as solids
from urbanloom.sources import city_attributes as parse
from urbanloom.sources import city_sink as sink
from urbanloom.sources import points


def pt(x, y, z=0.0):
    return geometry.point(F.lit(x), F.lit(y), F.lit(z))


def test_projection(spark):
    one = spark.range(1).select(
        projection.transformed(pt(9.0, 45.0, 7.0), 4258, 25832).alias("a"), projection.transformed(pt(500_000.0, 0.0), 25832, 4258).alias("b"), projection.transformed(projection.transformed(pt(11.5, 52.25), 4326, 32733), 32733, 4326).alias("c"),
        projection.transformed(pt(3.0, -45.0), 4326, 32731).alias("d"), projection.transformed(F.lit(None).cast("struct<x:double,y:double,z:double>"), 4326, 25832).alias("e"),
    ).first()
    assert (one["a"]["x"], one["a"]["z"]) == (500_000.0, 7.0) and abs(one["a"]["y"] - 0.9996 * 4_984_944.378) < 2e-3
    assert (abs(one["b"]["x"] - 9) < 1e-9, abs(one["b"]["y"]) < 1e-9) == (True, True)
    assert abs(one["c"]["x"] - 11.5) < 1e-9 and abs(one["c"]["y"] - 52.25) < 1e-9
    assert abs(one["d"]["y"] - (10_000_000 - 0.9996 * 4_984_944.378)) < 1 and one["e"] is None
    with pytest.raises(ValueError, match="31467"):
        projection.system(31467)


def test_planes_rings_and_matrices(spark):
    ring = F.array(pt(0.0, 0.0), pt(4.0, 0.0), pt(4.0, 3.0), pt(0.0, 3.0), pt(0.0, 0.0))
    wall = F.array(pt(0.0, 0.0, 0.0), pt(9.0, 0.0, 0.0), pt(9.0, 0.0, 2.0), pt(0.0, 0.0, 2.0))
    turn = mesh.rotation_matrix(F.lit(0.0), F.lit(0.0), F.lit(math.pi / 2), F.lit(2.0), F.lit(1.0), F.lit(1.0))
    flat = F.array(*[F.lit(0.0)] * 16)
    one = spark.range(1).select(
        mesh.plane(pt(0.0, 0.0, 5.0), pt(1.0, 0.0, 5.0), pt(0.0, 1.0, 5.0)).alias("plane"), mesh.plane(pt(0.0, 0.0), pt(1.0, 1.0), pt(2.0, 2.0)).alias("line"), F.size(mesh.triangles(ring)).alias("n"), mesh.ring_turn(F.array(pt(0.0, 0.0))).alias("few"),
        geometry.affine(F.array(pt(1.0, 0.0)), turn)[0].alias("turned"), mesh.inverse_matrix(flat).alias("none"), F.size(mesh.grid_triangles(F.lit(3), F.lit(4))).alias("grid"), mesh.grid_triangles(F.lit(1), F.lit(4)).alias("no"),
        (mesh.geometry_hash(ring) == mesh.geometry_hash(ring)).alias("same"), (mesh.geometry_hash(ring) != mesh.geometry_hash(wall)).alias("other"), mesh.reorigin_matrix(turn, pt(5.0, 6.0, 7.0), pt(1.0, 1.0, 1.0))[3].alias("moved"),
    ).first()
    assert (tuple(one["plane"]["n"]), one["plane"]["d"], one["line"], one["n"], one["few"]) == ((0.0, 0.0, 1.0), -5.0, None, 2, 0)
    assert abs(one["turned"]["y"] - 2) < 1e-12 and abs(one["turned"]["x"]) < 1e-12
    assert (one["none"], one["grid"], one["no"], one["same"], one["other"], one["moved"]) == (None, 12, None, True, True, 4.0)


def test_labels_of_pitched_and_coplanar_faces(spark):
    """A house with a ridge: two pitched halves, one of them split in two faces in one plane."""
    faces = [
        ("floor", [(0, 0, 0), (0, 6, 0), (8, 6, 0), (8, 0, 0)]), ("south", [(0, 0, 0), (8, 0, 0), (8, 0, 3), (4, 0, 3), (0, 0, 3)]), ("north", [(8, 6, 0), (0, 6, 0), (0, 6, 3), (8, 6, 3)]),
        ("west", [(0, 6, 0), (0, 0, 0), (0, 0, 3), (0, 3, 5), (0, 6, 3)]), ("east", [(8, 0, 0), (8, 6, 0), (8, 6, 3), (8, 3, 5), (8, 0, 3)]),
        ("roof1", [(0, 0, 3), (4, 0, 3), (4, 3, 5), (0, 3, 5)]), ("roof2", [(4, 0, 3), (8, 0, 3), (8, 3, 5), (4, 3, 5)]), ("roof3", [(8, 6, 3), (0, 6, 3), (0, 3, 5), (4, 3, 5), (8, 3, 5)]),
    ]
    df = spark.createDataFrame([("h", f, [tuple(float(v) for v in p) for p in r]) for f, r in faces], f"solid string, face string, ring {geometry.POINTS}")
    own = solids.measured(df, "solid", "face", "ring")
    want = {"floor": "GroundSurface", "roof1": "RoofSurface", "roof2": "RoofSurface", "roof3": "RoofSurface"}
    got = {r["face"]: r["label"] for r in solids.building_labels(own).collect()}
    assert got == {f: want.get(f, "WallSurface") for f, _ in faces}
    groups = {r["face"]: r["group"] for r in solids.coplanar_groups(own).collect()}
    assert groups["roof1"] == groups["roof2"] == "roof1" and len(set(groups.values())) == 7
    seen = {r["face"]: (r["from_above"], r["from_below"]) for r in solids.seen_faces(own, solids.grid_step(own)).collect()}
    assert seen["floor"] == (False, True) and seen["roof3"] == (True, False)
    assert solids.building_labels(solids.measured(df.limit(0), "solid", "face", "ring")).count() == 0


def test_connected_groups(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(51), 100, 101, 500]], "node long")
    assert rows(solids.connected(nodes, links)) == sorted([(i, 0) for i in range(51)] + [(100, 100), (101, 100), (500, 500)], key=repr)


def test_types_of_labels(spark):
    cases = [([], None), (["GenericSurface"], None), (["WaterSurface", "WallSurface"], "WATERBODY"), (["OuterFloorSurface", "ClosureSurface", "GroundSurface"], "BRIDGE"), (["OuterFloorSurface", "ClosureSurface", "WallSurface", "RoofSurface"], "TUNNEL"), (["WallSurface", "ClosureSurface"], "TUNNEL"), (["RoofSurface"], "BUILDING"), (["x"], "BUILDING")]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, labels array<string>")
    assert [r[1] for r in df.select("i", mesh.type_of_labels(F.col("labels"))).orderBy("i").collect()] == [w for _, w in cases]


def test_schemas(spark):
    catalog.drop_schema(spark, "city_a")
    catalog.create_schema(spark, "city_a", 25832, "ETRS89 / UTM zone 32N")
    try:
        before = catalog.current_schema(spark)
        catalog.set_current_schema(spark, "city_a")
        assert catalog.current_schema(spark) == "city_a" and catalog.schema_exists(spark, "city_a") and not catalog.schema_exists(spark, "default")
        spark.sql("insert into geometry_data values (4, array(named_struct('x', 500000D, 'y', 5000000D, 'z', 1D)), 1)")
        assert rows(catalog.next_ids(spark, "city_a", "geometry_data", 2)) == [(5,), (6,)] and rows(catalog.next_ids(spark, "city_a", "feature", 1)) == [(1,)]
        catalog.change_schema_srid(spark, "city_a", 25833, "ETRS89 / UTM zone 33N")
        assert spark.table("geometry_data").first()["geometry"][0]["x"] < 100_000
        assert rows(catalog.list_schemas(spark)) == [("city_a", 25833, "ETRS89 / UTM zone 33N", True)]
        catalog.cleanup_schema(spark, "city_a")
        assert spark.table("geometry_data").count() == 0 and spark.table("database_srs").count() == 1
        catalog.set_current_schema(spark, before)
    finally:
        spark.catalog.setCurrentDatabase("default")
        catalog.drop_schema(spark, "city_a")
    assert not catalog.schema_exists(spark, "city_a")


def test_names_rules_and_boxes(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x_2"), (4, "x"), (5, "x_2"), (6, "y")], "id int, base string")
    assert rows(rollups.unique_names(df, "base", "id", "name").select("id", "name")) == [(1, "x"), (2, "x_3"), (3, "x_2"), (4, "x_4"), (5, "x_2_2"), (6, "y")]
    assert filters.parse_bbox_srid("1,2,3,4, 25832") == ((1, 2, 3, 4), 25832) and filters.parse_bbox_srid("1,2,3,4") == ((1, 2, 3, 4), None) and filters.parse_bbox_srid("1,2,3,4,x") is None
    assert filters.parse_bbox(filters.format_bbox((1.0, 2.5, 3.0, 4.125))) == (1, 2.5, 3, 4.125)
    assert filters.chosen_bbox(True, (3, 0, 1, 1), "0,0,1,1") == (0, 0, 1, 1) and filters.chosen_bbox(False, (0, 0, 1, 1), None) is None
    owner = F.create_map(F.lit("Kind"), F.lit("Wall"), F.lit("note"), F.lit("  "))
    one = spark.range(1).select(
        rollups.custom_value(owner, "kind").alias("a"), rollups.custom_value(owner, "kind", True).alias("b"), rollups.has_semantics(owner, ["note", "x"]).alias("c"), rollups.has_semantics(owner, ["Kind"]).alias("d"),
        rollups.rule_holds({"object_property": "kind", "object_value": "w", "mode": "contains"}, owner, owner).alias("e"), rollups.rule_holds({"object_property": "", "material_property": " "}, owner, owner).alias("f"),
    ).first()
    assert tuple(one) == ("Wall", None, False, True, True, False)


def test_placed_templates_and_files(spark):
    shapes = spark.createDataFrame([("t", [(1.0, 0.0, 0.0)])], f"template string, points {geometry.POINTS}")
    made = [(1, "t", [float(v) for v in (2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 1)], 10.0, 20.0, 30.0), (2, "t", None, 0.0, 0.0, 1.0), (3, "none", None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(made, "id int, template string, matrix array<double>, x double, y double, z double")
    got = {r["id"]: r["points"] for r in relations.placed_templates(df, shapes).collect()}
    assert [tuple(p) for p in got[1]] == [(12.0, 20.0, 30.0)] and [tuple(p) for p in got[2]] == [(1.0, 0.0, 1.0)] and got[3] is None
    refs = spark.createDataFrame([(1, "a", "#k"), (2, "a", "b#k"), (3, "b", "k"), (4, "a", "c#k"), (5, "a", None)], "i int, base string, href string")
    targets = spark.createDataFrame([("a", "k", 1, 10), ("b", "k", 2, 20), ("b", "k", 1, 30)], "file string, id string, place int, value int")
    assert rows(relations.resolve_in_files(refs, "href", "base", targets, "file", "id", "place").select("i", "value")) == sorted([(1, 10), (2, 30), (3, 30), (4, None), (5, None)], key=repr)


def test_curves_and_fits(spark):
    a, b, c = pt(1.0, 0.0, 0.0), pt(0.0, 1.0, 9.0), pt(-1.0, 0.0, 4.0)
    square = F.array(pt(0.0, 0.0), pt(2.0, 0.0), pt(2.0, 2.0), pt(0.0, 2.0))
    pairs = lambda *rows_: F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("xyuv", r, strict=False)]) for r in rows_])
    one = spark.range(1).select(
        curves.arc_through(a, b, c, 4).alias("arc"), curves.arc_through(c, b, a, 4).alias("back"), curves.arc_through(pt(0.0, 0.0), pt(1.0, 1.0), pt(2.0, 2.0)).alias("line"), F.size(curves.circle_through(a, b, c, 8)).alias("n"),
        curves.arc_string(F.array(a, b, c, pt(-2.0, -1.0), pt(-3.0, 0.0), pt(-4.0, 0.0)), 2).alias("string"), curves.inside_or_on(F.lit(2.0), F.lit(1.0), square).alias("on"), curves.inside_or_on(F.lit(2.1), F.lit(1.0), square).alias("off"),
        curves.fitted_uvs(pairs((0, 0, 0, 1), (2, 0, 1, 1), (0, 2, 0, 0)), pairs((1, 1), (2, 2))).alias("uv"), curves.fitted_uvs(pairs((0, 0, 0, 1), (1, 1, 1, 1)), pairs((1, 1))).alias("none"),
        curves.ordered_uvs(square, F.array(pt(2.0, 0.0), pt(0.0, 0.0), pt(0.0, 2.0), pt(2.0, 2.0)), F.array(F.lit("b"), F.lit("a"), F.lit("d"), F.lit("c"))).alias("order"), curves.segment_kind(F.lit("NURBS"), square).alias("kind"),
    ).first()
    assert [(round(p["x"], 6), round(p["y"], 6), p["z"]) for p in one["arc"]][::2] == [(1.0, 0.0, 0.0), (0.0, 1.0, 2.0), (-1.0, 0.0, 4.0)]
    assert round(one["back"][2]["y"], 6) == 1.0 and len(one["line"]) == 3 and one["n"] == 9 and len(one["string"]) == 6
    assert (one["on"], one["off"], one["order"], one["kind"]) == (True, False, ["a", "b", "c", "d"], "Arc")
    assert [(round(p["u"], 9), round(p["v"], 9)) for p in one["uv"]] == [(0.5, 0.5), (1.0, 0.0)] and [tuple(p) for p in one["none"]] == [(0.0, 0.0)]


def test_point_files(spark, tmp_path):
    head = bytearray(227)
    head[:4], head[24:26], head[104] = b"LASF", b"\x01\x02", 2
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<HI", head, 105, 26, 2)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 100.0, 200.0, 0.0)
    record = lambda x, y, z: struct.pack("<iiiHBBbBH", x, y, z, 7, 0, 2, 0, 0, 0) + struct.pack("<3H", 65535, 256, 0)
    (tmp_path / "a.las").write_bytes(bytes(head) + record(100, 200, 300) + record(0, 0, -50))
    (tmp_path / "b.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n1 2 3 9 8 7\n4 5 6 0 0 1\n")
    (tmp_path / "c.ply").write_text("nothing")
    got = points.read_point_files(spark, str(tmp_path)).drop("file")
    assert rows(got.filter("error is null").drop("error")) == sorted([(101.0, 202.0, 3.0, 255, 1, 0, 7.0, 2), (100.0, 200.0, -0.5, 255, 1, 0, 7.0, 2), (1.0, 2.0, 3.0, 9, 8, 7, None, None), (4.0, 5.0, 6.0, 0, 0, 1, None, None)], key=repr)
    assert got.filter("error is not null").count() == 1


def test_grids_lines_and_looks_through_xml(spark):
    frame = spark.range(1).select(
        sink.grid_xml(F.lit(2), F.lit(3), pt(1.0, 2.0, 3.0), pt(1.0, 0.0), pt(0.0, 1.0), F.lit("5 6 7 8 9 10")).alias("grid"), sink.curve_xml(F.array(F.struct(F.lit("Arc").alias("kind"), F.array(pt(0.0, 0.0), pt(1.0, 1.0), pt(2.0, 0.0)).alias("points")))).alias("curve"),
        sink.composite_xml(F.array(sink.polygon_xml(F.array(pt(0.0, 0.0)), F.array(F.array(pt(1.0, 1.0))), F.lit("p"))), F.lit("c")).alias("composite"), sink.solid_xml(F.array(F.lit("p&q"))).alias("solid"), sink.type_attribute("bldg", "measuredHeight", F.lit(3.5), F.lit("m")).alias("height"),
    )
    made = frame.select(F.lit("f").alias("file"), F.concat(F.lit('<x:Thing gml:id="t">'), "grid", "curve", "composite", "solid", "height", F.lit("</x:Thing>")).alias("body"))
    assert [tuple(r)[1:4] for r in parse.grids(made).collect()] == [("t", 2, 3)] and parse.grids(made).first()["coordinates"] == "5 6 7 8 9 10"
    assert rows(parse.lines(made).filter("kind = 'Arc'").select("feature_id", "coordinates")) == [("t", "0.0 0.0 0.0 1.0 1.0 0.0 2.0 0.0 0.0")]
    assert rows(parse.type_attributes(made).select("name", "number", "uom")) == [("measuredHeight", 3.5, "m")] and parse.member_links(made).first()["target"] == "p&q"
    faces = spark.createDataFrame([("t", "p1", 1.0, 0.0, 0.5), ("t", "p2", 1.0, 0.0, 0.5), ("t", "p3", 0.0, 0.0, 2.0)], "feature_id string, target string, r double, g double, b double")
    rings = spark.createDataFrame([("t", "a.png", "p1", "r1", [0.0, 0.0, 1.0, 0.0, 1.0, 1.0])], "feature_id string, image string, target string, ring string, uv array<double>")
    looks = sink.materials_xml(faces).withColumnRenamed("xml", "m").join(sink.textures_xml(rings), "feature_id").select(F.lit("f").alias("file"), sink.appearance_xml(F.lit("day"), F.col("m"), F.col("xml")).alias("body"))
    assert rows(parse.materials(looks).select("theme", "target", "r", "b")) == [("day", "p1", 1.0, 0.5), ("day", "p2", 1.0, 0.5), ("day", "p3", 0.0, 1.0)]
    assert rows(parse.textures(looks).select("image", "target", "ring", "uv")) == [("a.png", "p1", "r1", [0.0, 0.0, 1.0, 0.0, 1.0, 1.0])]
    grid = spark.createDataFrame([("g", float(i % 3), float(i // 3) + 0.001 * (i % 2), float(i)) for i in range(6)] + [("h", 0.0, 0.0, 1.0), ("h", 1.0, 0.0, 1.0), ("h", 0.0, 1.0, 1.0)], "k string, x double, y double, z double")
    assert rows(rollups.grid_texts(grid, "k", "y", "x", "z")) == [("g", 2, 3, "0.0 1.0 2.0 3.0 4.0 5.0")]
