import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.conftest import rows
from urbanloom.functions import geometry, text
from urbanloom.functions import crs
from urbanloom.operators import deletion, filters, relations, rollups, spatial

SF = "/root/testdata/sf0.001"
SAMPLE = ["p1_found", "p1_hierarchy", "p7_found", "type_histogram", "bbox_intersects_keep_missing", "type_filter_closure", "lod_mode_and", "validity_between", "cql2_filter", "code_validity", "touching_pairs", "nearest_three", "watertight", "regular_grids", "snapshot_changes", "crs_names", "findings"]


def test_contract():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", SAMPLE)
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = __spark_entry__.queries()[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    want = con.sql(f"select {columns} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert rows(df) == sorted(want, key=repr)


def test_deletion_by_brute_force(spark):
    links = [(1, 2), (1, 3), (9, 3), (2, 4), (4, 5), (5, 4), (3, 6), (7, 1), (2, 8), (10, 8)]
    contains = spark.createDataFrame(links, "p long, c long")
    start = spark.createDataFrame([(1,), (10,)], "node long")
    # 3 stays, as 9 holds it, and 6 with it; 4 and 5 only hold each other; both holders of 8 go
    assert rows(deletion.deletable(contains, start)) == [(1,), (10,), (2,), (4,), (5,), (8,)]


def test_filters():
    assert filters.parse_ids(" a, ,b-c,a") == ["a", "b-c"]
    assert filters.parse_bbox("1, 2.5, 3, 4.75") == (1, 2.5, 3, 4.75)
    for bad in (None, "", "1,2,3", "1,2,3,4,5", "1,two,3,4", "4,2,1,3", "1,3,4,2"):
        assert filters.parse_bbox(bad) is None


def test_cql(spark):
    df = spark.createDataFrame([(1, "a'b", 2.5), (2, None, 1.0), (3, "abc", None)], "i int, s string, d double")
    ask = lambda q: [r["i"] for r in df.filter(filters.cql(q)).orderBy("i").collect()]
    assert ask("s = 'a''b' OR d < 2") == [1, 2]
    assert ask("NOT (i IN (1, 2)) AND s LIKE 'ab%'") == [3]
    assert ask("d IS NULL") == [3] and ask("i BETWEEN 2 AND 3 AND d IS NOT NULL") == [2]
    for bad in ("i =", "i = 1 AND", "(i = 1", "i ! 2", "i 1"):
        with pytest.raises((ValueError, IndexError)):
            filters.cql(bad)


def test_geometry(spark):
    ring = geometry.parse_points(F.lit("2 0 0 2 1 0 2 1 1 2 0 1"))
    matrix = F.array(*[F.lit(float(v)) for v in (2, 0, 0, 10, 0, 2, 0, 20, 0, 0, 2, 30, 0, 0, 0, 1)])
    moved = geometry.affine(geometry.parse_points(F.lit("0 0 0 1 0 0 1 1 0"), close=False), matrix)
    one = spark.range(1).select(
        geometry.area(ring).alias("area"), geometry.is_closed(ring).alias("closed"), F.size(ring).alias("n"), geometry.unit_normal(ring)["x"].alias("nx"), moved.alias("moved"),
        geometry.degenerate(geometry.parse_points(F.lit("0 0 1 1"), F.lit(2))).alias("few"), geometry.inside(F.lit(0.5), F.lit(0.5), geometry.parse_points(F.lit("0 0 1 0 1 1 0 1"), F.lit(2))).alias("inside"),
        geometry.circle(*[geometry.point(F.lit(x), F.lit(y), F.lit(0)) for x, y in ((0, 0), (2, 0), (1, 1))])["r"].alias("r"), F.size(geometry.parse_points(F.lit(None).cast("string"))).alias("none"),
    ).first()
    assert (one["area"], one["closed"], one["n"], abs(one["nx"]), one["few"], one["inside"], one["r"], one["none"]) == (1.0, True, 5, 1.0, "few points", True, 1.0, 0)
    assert [tuple(p) for p in one["moved"]] == [(10, 20, 30), (12, 20, 30), (12, 22, 30)]


def test_texts(spark):
    df = spark.createDataFrame([("#a b.c",), ("9x",), ("",), (None,)], "s string")
    got = [tuple(r) for r in df.select(text.xs_id(F.col("s")), text.xs_datetime(F.lit("2020-01-01T02:00:00+02:00")), text.ifc_guid(F.lit("ifc:guid:0123456789012345678901"))).collect()]
    assert [g[0][:6] for g in got] == ["a_b_c", "ID_9x", "ID_e3b", "ID_e3b"]
    assert got[0][1:] == ("2020-01-01T00:00:00Z", "0123456789012345678901")


def test_empty_tables(spark):
    box = "struct<min_x:double,min_y:double,min_z:double,max_x:double,max_y:double,max_z:double>"
    empty = spark.createDataFrame([], f"k long, b {box}")
    assert spatial.touching_pairs(empty, "k", "b").count() == spatial.nearest(empty, empty, "k", "b").count() == 0
    assert rollups.open_edges(spark.createDataFrame([], f"s long, ring {geometry.POINTS}"), "s", "ring").count() == 0
    assert relations.reached(spark.createDataFrame([], "p long, c long"), spark.createDataFrame([(1,)], "node long")).count() == 1


def test_full_deletion(spark):
    """Feature 1 goes with 2, its geometry, its appearance and what only that used; 3 is held by 9, template 60 by 9's property."""
    df = spark.createDataFrame
    tables = {
        "feature": df([(1,), (2,), (3,), (9,)], "id long"),
        "property": df(
            [(10, 1, None, "a", 0, 2, 1, None, None, None, None), (11, 1, None, "a", 0, 3, 1, None, None, None, None), (12, 9, None, "a", 0, 3, 1, None, None, None, None), (13, 2, None, "g", 0, None, None, 50, None, None, None),
             (14, 2, None, "i", 0, None, None, None, 60, None, None), (15, 9, None, "i", 0, None, None, None, 60, None, None), (16, 1, None, "i", 0, None, None, None, 61, None, None), (17, 1, None, "l", 0, None, None, None, None, 70, None),
             (18, 9, None, "r", 0, None, None, None, None, None, None), (19, 9, 18, "r", 0, 1, 0, None, None, None, None), (20, 9, 18, "s", 0, None, None, None, None, None, 80), (21, 9, None, "s", 0, None, None, None, None, None, 81), (22, 1, None, "s", 0, None, None, None, None, None, 81)],
            "id long, feature_id long, parent_id long, name string, namespace_id int, val_feature_id long, val_relation_type int, val_geometry_id long, val_implicitgeom_id long, val_appearance_id long, val_address_id long",
        ),
        "address": df([(80,), (81,)], "id long"), "geometry_data": df([(50, 2), (51, 1), (52, 9), (53, None)], "id long, feature_id long"), "implicit_geometry": df([(60, 52), (61, 53)], "id long, relative_geometry_id long"),
        "appearance": df([(70, 1, None), (71, None, 61), (72, 9, None)], "id long, feature_id long, implicit_geometry_id long"), "appear_to_surface_data": df([(70, 90), (70, 91), (71, 92), (72, 91)], "appearance_id long, surface_data_id long"),
        "surface_data": df([(90, 100), (91, 101), (92, 101)], "id long, tex_image_id long"), "tex_image": df([(100,), (101,)], "id long"),
    }
    left = {name: rows(t) for name, t in deletion.delete_features(tables, df([(1,)], "node long")).items()}
    assert left["feature"] == [(3,), (9,)] and [r[0] for r in left["property"]] == [12, 15, 21] and left["address"] == [(81,)]
    assert left["geometry_data"] == [(51, None), (52, 9)] and left["implicit_geometry"] == [(60, 52)] and [r[0] for r in left["appearance"]] == [72]
    assert left["appear_to_surface_data"] == [(72, 91)] and left["surface_data"] == [(91, 101)] and left["tex_image"] == [(101,)]
    empty = {name: t.limit(0) for name, t in tables.items()}
    assert all(t.count() == 0 for t in deletion.delete_features(empty, df([], "node long")).values())


def test_crs_names(spark):
    cases = {
        "URN:ADV:CRS:ETRS89_UTM32*DE_DHHN2016_NH": ("EPSG:25832", "7837"), "urn:adv:crs:etrs89_utm33*de_dhhn92_nh": ("EPSG:25833+5783", "5783"), "EPSG 25832": ("EPSG:25832", ""), " EPSG:4979 ": ("EPSG:4979", ""),
        "urn:adv:crs:DE_DHDN_3GK5*DE_DHN92_NH": ("EPSG:31469+5783", "5783"), "x urn:adv:crs:ETRS89_UTM31 y": ("EPSG:25831", ""), "": ("Unknown CRS", ""), None: ("Unknown CRS", ""), "invalid": ("Unknown CRS", ""),
        "urn:ogc:def:crs,crs:EPSG:6.12:31466,crs:EPSG:6.12:5783": ("EPSG:31466+5783", "5783"), "epsg_code=25833": ("EPSG:25833", ""),
    }
    df = spark.createDataFrame([(n,) for n in cases], "n string")
    got = df.select("n", crs.normal_crs(F.col("n")), crs.height_code(F.col("n"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == cases
