import glob

from pyspark.sql import functions as F

from tests.conftest import rows
from urbanloom.functions import text
from urbanloom.functions.geometry import area, parse_points, point
from urbanloom.sources import city_attributes as parse
from urbanloom.sources.citygml import boxes_in, count_features, feature_boxes, features, file_origins, file_profile, foreign_namespaces, promoted, read_features, read_members, rings, scan_file
from urbanloom.sources.city_sink import write_buildings
from urbanloom.sources.points import grid_points, read_points
from urbanloom.streaming.changes import changes_by_window, current_state, log_changes

FILE = """<?xml version="1.0"?><CityModel xmlns="http://www.opengis.net/citygml/2.0" xmlns:gml="http://www.opengis.net/gml" xmlns:h="http://www.opengis.net/citygml/building/2.0" xmlns:noise="http://example.org/noise" xmlns:unused="http://example.org/u">
<cityObjectMember gml:id="m1" ><h:Building gml:id="mill"><gml:name>Mill &amp; weir</gml:name><creationDate>2011-05-06</creationDate>
<g:stringAttribute name="colour"><g:value>red</g:value></g:stringAttribute><g:intAttribute name="rooms"><g:value>7</g:value></g:intAttribute><g:intAttribute name="rooms"><g:value>eight</g:value></g:intAttribute><g:doubleAttribute name="share"><g:value>0.25</g:value></g:doubleAttribute>
<externalReference><informationSystem>land register</informationSystem><externalObject><uri>parcel-9</uri></externalObject></externalReference><h:function>1000</h:function><h:measuredHeight uom="ft">31</h:measuredHeight>
<h:boundedBy><h:RoofSurface gml:id="mill-roof"><h:lod3MultiSurface><gml:MultiSurface><gml:surfaceMember><gml:Polygon gml:id="mill-p"><gml:exterior><gml:LinearRing><gml:posList>40 20 9 46 20 9 46 25 9 40 25 9 40 20 9</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember></gml:MultiSurface></h:lod3MultiSurface></h:RoofSurface></h:boundedBy>
<h:consistsOfBuildingPart><h:BuildingPart gml:id="mill-shed"/></h:consistsOfBuildingPart>
<h:address><Address><xalAddress><x:AddressDetails><x:Country><x:CountryName>Norland</x:CountryName><x:Locality><x:LocalityName>Sund</x:LocalityName><x:Thoroughfare><x:ThoroughfareNumber>4b</x:ThoroughfareNumber><x:ThoroughfareName>Weir Lane</x:ThoroughfareName></x:Thoroughfare><x:PostalCode><x:PostalCodeNumber>0815</x:PostalCodeNumber></x:PostalCode></x:Locality></x:Country></x:AddressDetails></xalAddress></Address></h:address>
<noise:level>3</noise:level></h:Building></cityObjectMember
>
<cityObjectMember><h:Building gml:id="lost"><broken></h:Building></cityObjectMember >
<cityObjectMember xlink:href="other.gml#far"/>
<cityObjectMember><f:CityFurniture gml:id="lamp"><f:lod1ImplicitRepresentation><ImplicitGeometry><transformationMatrix>1 0 0 0 0 1 0 0 0 0 1 0 0 0 0 1</transformationMatrix><relativeGMLGeometry xlink:href="#lamp-shape"/><referencePoint><gml:Point><gml:pos>3 4 5</gml:pos></gml:Point></referencePoint></ImplicitGeometry></f:lod1ImplicitRepresentation></f:CityFurniture></cityObjectMember>
<cityObjectMember><h:Building gml:id="mill"><gml:name>again</gml:name></h:Building></cityObjectMember>
<cityObjectMember><q:CityObjectGroup gml:id="group"><q:groupMember xlink:href="#mill"/><q:groupMember xlink:href="#lamp"/></q:CityObjectGroup></cityObjectMember>
<gml:boundedBy><gml:Envelope srsName="urn:ogc:def:crs:EPSG::25833"><gml:lowerCorner>3 4 5</gml:lowerCorner><gml:upperCorner>46 25 9</gml:upperCorner></gml:Envelope></gml:boundedBy></CityModel>"""

LOOKS = """<a:Appearance><a:theme>summer</a:theme><a:surfaceDataMember><a:X3DMaterial gml:id="mat"><a:diffuseColor>0.5 1.5 -1</a:diffuseColor><a:target>#mill-p</a:target><a:target>#mill-roof</a:target></a:X3DMaterial></a:surfaceDataMember>
<a:surfaceDataMember><a:ParameterizedTexture><a:imageURI>roof.png</a:imageURI><a:target uri="#mill-p"><a:TexCoordList><a:textureCoordinates ring="#r1">0 0 1 0 1 1 0 0</a:textureCoordinates></a:TexCoordList></a:target></a:ParameterizedTexture></a:surfaceDataMember>
<a:surfaceDataMember><a:GeoreferencedTexture><a:imageURI>air.png</a:imageURI><a:referencePoint><gml:Point><gml:pos>7 8</gml:pos></gml:Point></a:referencePoint><a:orientation>2 0 0 2</a:orientation><a:target>#field</a:target></a:GeoreferencedTexture></a:surfaceDataMember></a:Appearance>"""


def test_reading_a_city_file(spark, tmp_path):
    (tmp_path / "a.gml").write_text(FILE)
    path = str(tmp_path / "a.gml")
    members = read_members(spark, path)
    assert members.count() == 5
    got = features(members)
    assert rows(got.filter("error is null").select("feature_id", "feature_type", "parent_id", "depth", "name", "lods")) == sorted(
        [("mill", "Building", None, 0, "Mill & weir", []), ("mill-roof", "RoofSurface", "mill", 1, None, [3]), ("mill-shed", "BuildingPart", "mill", 1, None, []), ("lamp", "CityFurniture", None, 0, None, [1]), ("mill", "Building", None, 0, "again", []), ("group", "CityObjectGroup", None, 0, None, [])],
        key=repr,
    )
    assert got.filter("error is not null").count() == 1
    ring = rings(members).withColumn("area", area(parse_points(F.col("text"), F.col("dimension"))))
    assert rows(ring.select("feature_id", "label", "lod", "polygon_id", "is_interior", "area")) == [("mill-roof", "RoofSurface", 3, "mill-p", False, 30.0)]
    assert rows(file_profile(spark, path).select("version", "gml_version", "modules", "srs", "lower", "upper")) == [("2.0", "3.1", {"building": "2.0"}, "urn:ogc:def:crs:EPSG::25833", "3 4 5", "46 25 9")]
    assert rows(foreign_namespaces(spark, path).select("prefix", "uri")) == [("noise", "http://example.org/noise")]
    scan = scan_file(spark, path)
    assert rows(scan["profile"].select("n_features", "memory_mb")) == [(6, 50.0)]
    assert rows(scan["types"].select("feature_type", "n")) == sorted([("Building", 2), ("BuildingPart", 1), ("RoofSurface", 1), ("CityFurniture", 1), ("CityObjectGroup", 1)], key=repr)
    assert rows(scan["lods"].select("lod", "n")) == [(0, 0), (1, 1), (2, 0), (3, 1), (4, 0)]


def test_filters_of_a_city_file(spark, tmp_path):
    (tmp_path / "a.gml").write_text(FILE)
    path = str(tmp_path / "a.gml")
    names = lambda df: sorted(r["feature_id"] for r in df.collect())
    assert names(read_features(spark, path)) == ["group", "lamp", "mill", "mill-roof", "mill-shed"]
    assert names(read_features(spark, path, types=["bldg:BuildingPart", "CityFurniture"])) == ["lamp", "mill-shed"]
    assert names(read_features(spark, path, ids=spark.createDataFrame([("mill",), ("nobody",)], "id string"))) == ["mill"]
    assert names(read_features(spark, path, bbox=(0, 0, 41, 21))) == ["mill", "mill-roof", "mill-shed"]
    assert names(read_features(spark, path, bbox=(0, 0, 1, 1))) == [] and "lamp" in names(read_features(spark, path, bbox=(0, 0, 1, 1), missing="keep"))
    assert names(promoted(read_features(spark, path))) == ["group", "lamp", "mill", "mill-shed"]


def test_places_of_a_city_file(spark, tmp_path):
    (tmp_path / "a.gml").write_text(FILE)
    path = str(tmp_path / "a.gml")
    boxes = feature_boxes(read_members(spark, path))
    assert rows(boxes.drop("file")) == [("mill-roof", "RoofSurface", 40.0, 20.0, 9.0, 46.0, 25.0, 9.0)]
    assert boxes_in(boxes, (46, 25, 50, 50)).count() == 1 and boxes_in(boxes, (46, 25, 50, 50), ["WallSurface"]).count() == boxes_in(boxes, (0, 0, 39, 50)).count() == 0
    assert rows(file_origins(spark, path).drop("file")) == [(3.0, 4.0, 5.0, "urn:ogc:def:crs:EPSG::25833")]
    assert count_features(spark, path) == 5 and count_features(spark, path, spark.createDataFrame([("lamp",)], "id string")) == 1
    df = spark.createDataFrame([("/d/a.gml", "tex\\x.png"), ("/d/a.gml", "./b.png"), ("/d/a.gml", "http://h/x"), ("/d/a.gml", "/abs"), ("/d/a.gml", " ")], "f string, u string")
    assert [r[0] for r in df.select(text.resolved_path(F.col("f"), F.col("u"))).collect()] == ["/d/tex/x.png", "/d/b.png", "http://h/x", "/abs", None]
    one = spark.range(1).select(text.in_schema_order(F.array(*map(F.lit, "zbab")), ["a", "b"]), text.without_suffixes(F.array(F.lit("x_geom"), F.lit(" x "), F.lit(""), F.lit("y_outer")), ["_outer", "_geom"])).first()
    assert (one[0], one[1]) == (["a", "b", "b", "z"], ["x", "y"])


def test_attributes_of_a_city_file(spark, tmp_path):
    (tmp_path / "a.gml").write_text(FILE)
    members = read_members(spark, str(tmp_path / "a.gml"))
    assert rows(parse.generic_attributes(members).drop("file")) == sorted([("mill", "colour", "string", "red", None), ("mill", "rooms", "string", "eight", None), ("mill", "share", "double", "0.25", 0.25)], key=repr)
    assert rows(parse.type_attributes(members).drop("file")) == sorted([("mill", "Building", "function", "1000", None, None, None), ("mill", "Building", "measuredHeight", "31", 31.0, "ft", None)], key=repr)
    assert rows(parse.addresses(members).select("feature_id", "country", "city", "street", "house_number", "zip_code", "po_box")) == [("mill", "Norland", "Sund", "Weir Lane", "4b", "0815", None)]
    assert rows(parse.external_references(members).drop("file")) == [("mill", "parcel-9", "land register", None)]
    assert rows(parse.implicit_geometries(members).select("feature_id", "lod", "template", "x", "y", "z")) == [("lamp", 1, "lamp-shape", 3.0, 4.0, 5.0)]
    assert rows(parse.member_links(members).filter("feature_id = 'group'").drop("file")) == [("group", "groupMember", "lamp"), ("group", "groupMember", "mill")]
    looks = spark.createDataFrame([("a.gml", LOOKS), ("b.gml", "<broken>")], "file string, body string")
    assert rows(parse.materials(looks).select("theme", "material", "target", "r", "g", "b")) == [("summer", "mat", "mill-p", 0.5, 1.0, 0.0), ("summer", "mat", "mill-roof", 0.5, 1.0, 0.0)]
    assert rows(parse.textures(looks).drop("file")) == [("summer", "roof.png", "mill-p", "r1", [0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 0.0])]
    assert rows(parse.georeferenced_textures(looks).drop("file")) == [("air.png", "field", 7.0, 8.0, 0.0, [2.0, 0.0, 0.0, 2.0])]
    assert rows(parse.image_paths(parse.textures(looks), parse.georeferenced_textures(looks))) == [("air.png",), ("roof.png",)]
    empty = members.limit(0)
    assert all(f(empty).count() == 0 for f in (parse.generic_attributes, parse.type_attributes, parse.addresses, parse.external_references, parse.implicit_geometries, parse.member_links, parse.series, parse.materials, parse.textures))


def test_writing_and_reading_again(spark, tmp_path):
    lines = [("B<1>", 0, 0, False, "0 0 0 4 0 0 4 4 0 0 4 0 0 0 0"), ("B<1>", 0, 1, True, "1 1 0 1 2 0 2 2 0 2 1 0 1 1 0"), ("B2", 0, 0, False, "0 0 1 1 0 1 1 1 1 0 0 1"), (None, 0, 0, False, "0 0 0")]
    df = spark.createDataFrame(lines, "feature_id string, polygon int, ring int, is_interior boolean, line string").withColumn("points", parse_points(F.col("line"), F.lit(3)))
    write_buildings(df, str(tmp_path / "out"))
    (tmp_path / "whole.gml").write_text("".join(open(p).read() for p in sorted(glob.glob(str(tmp_path / "out/part-*")))))
    back = rings(read_members(spark, str(tmp_path / "whole.gml")))
    assert rows(back.select("feature_id", "polygon", "ring", "is_interior", area(parse_points(F.col("text"), F.col("dimension"))))) == sorted([("B<1>", 0, 0, False, 16.0), ("B<1>", 0, 1, True, 1.0), ("B2", 0, 0, False, 0.5)], key=repr)


def test_points_and_grids(spark, tmp_path):
    (tmp_path / "p.xyz").write_text("# head\n1 2 3\n1,2,3,10,20,30,0.5,6\n1 2 3 0.25\n\nx y z\n1 2\n")
    assert rows(read_points(spark, str(tmp_path)).drop("file")) == sorted([(1.0, 2.0, 3.0, None, None, None, None, None), (1.0, 2.0, 3.0, 10, 20, 30, 0.5, 6), (1.0, 2.0, 3.0, None, None, None, 0.25, None)], key=repr)
    grid = spark.createDataFrame([(1, "5 6, 7 8")], "k int, v string")
    p = lambda x, y, z: point(F.lit(x), F.lit(y), F.lit(z))
    got = grid_points(grid, "k", F.lit(2), p(10, 20, 0), p(1, 0, 0), p(0, 1, 0), "v").select("row", "col", "point.*")
    assert rows(got) == [(0, 0, 10.0, 20.0, 5.0), (0, 1, 11.0, 20.0, 6.0), (1, 0, 10.0, 21.0, 7.0), (1, 1, 11.0, 21.0, 8.0)]


def test_change_feed_as_a_stream(spark, tmp_path):
    schema = "id long, k long, at long, kind string, ts timestamp"
    first = [(2, 1, 20, "U"), (4, 2, 5, "I")]
    second = [(1, 1, 10, "INSERT"), (3, 2, 9, "delete"), (4, 2, 5, "I")]
    for n, part in enumerate((first, second)):
        spark.createDataFrame(part, "id long, k long, at long, kind string").withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    log_changes(stream, str(tmp_path / "log"), str(tmp_path / "cp"), once=True).awaitTermination(60)
    state = current_state(spark, str(tmp_path / "log"), "k", "at", "id", "kind")
    assert rows(state) == [(1, "present", 2), (2, "absent", 3)]
    counts = changes_by_window(spark.readStream.schema(schema).parquet(str(tmp_path / "in/*")), "ts", "kind", "1 minute")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("by_window").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select sum(n) from by_window").first()[0] == 5
