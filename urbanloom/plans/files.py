"""Queries through city files: tables are written as files in both versions and read again, with the SQL on the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.functions import geometry
from urbanloom.operators.relations import placed_templates
from urbanloom.sources import city_attributes as parse
from urbanloom.sources import city_sink as sink
from urbanloom.sources.citygml import promoted, read_features, read_members, rings, scan_file
from urbanloom.session import scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_KNOWN = [n for _, (_, names) in sink.MODULES.items() for n in names if n != "GenericOccupiedSpace"] + ["GenericOccupiedSpace"]
_LISTED = ", ".join(f"'{n}'" for n in _KNOWN)
_TYPED = f"CASE WHEN o.classname IN ({_LISTED}) THEN o.classname ELSE 'GenericCityObject' END"
_LOW, _HIGH = "envelope[1]", "envelope[2]"
_FLAT = f"envelope IS NOT NULL AND {_HIGH}.x > {_LOW}.x AND {_HIGH}.y > {_LOW}.y"


def city_file(spark: SparkSession, sf_dir: str, version: str) -> str:
    """Path of a file with all features: name, date, generic attributes, references, addresses and the floor of the extent."""
    t = lambda name: table(spark, sf_dir, name)
    key = F.concat(F.lit("F"), F.col("feature_id").cast("string")).alias("feature_id")
    prop = t("property").filter(F.col("feature_id").isNotNull())
    names = prop.filter("name = 'name' and val_string is not null").groupBy("feature_id").agg(F.min_by("val_string", "id").alias("name"))
    feature = t("feature").withColumnRenamed("id", "feature_id").join(t("objectclass").select(F.col("id").alias("objectclass_id"), F.col("classname").alias("feature_type")), "objectclass_id")
    rows = feature.join(names, "feature_id", "left").select(key, "feature_type", "name", "creation_date", "envelope")
    place = lambda n: F.lit(n).alias("place")
    order = F.format_string("%020d", "id").alias("key")
    attributes = prop.filter("name in ('status', 'value', 'yearOfConstruction')")
    kind = F.when(F.col("val_int").isNotNull(), "int").when(F.col("val_double").isNotNull(), "double").otherwise("string")
    made = sink.generic_attribute(F.col("name"), kind, F.coalesce(F.col("val_int").cast("string"), F.col("val_double").cast("string"), "val_string"), version)
    inside = attributes.select(key, place(1), order, made.alias("xml"))
    uris = prop.filter("name = 'externalReference'")
    inside = inside.unionByName(uris.select(key, place(2), order, sink.external_reference(F.col("val_uri"), F.lit("register"), version).alias("xml")))
    homes = prop.filter("val_address_id is not null").select("feature_id", F.col("val_address_id").alias("id")).distinct().join(t("address"), "id")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    postal = sink.address_xml(blank("street"), blank("house_number"), blank("zip_code"), blank("city"), blank("country"), version)
    inside = inside.unionByName(homes.select(key, place(4), order, postal.alias("xml")))
    low, high = F.col("envelope")[0], F.col("envelope")[1]
    floor = F.array(*[geometry.point(x, y, low["z"]) for x, y in ((low["x"], low["y"]), (high["x"], low["y"]), (high["x"], high["y"]), (low["x"], high["y"]), (low["x"], low["y"]))])
    flat = rows.filter((high["x"] > low["x"]) & (high["y"] > low["y"])).select("feature_id", "feature_type", F.lit(1).alias("lod"), F.lit(0).alias("polygon"), F.lit(0).alias("ring"), F.lit(False).alias("is_interior"), floor.alias("points"))
    shapes = sink.surfaces(flat, version).join(rows.select("feature_id", "feature_type"), "feature_id")
    inside = inside.unionByName(shapes.select("feature_id", place(3), F.lit("").alias("key"), sink.level_property(F.col("feature_type"), F.col("lod"), F.col("xml"), version).alias("xml")))
    extent = rows.filter("envelope is not null").agg(*[F.min(low[k]).alias(f"min_{k}") for k in "xyz"], *[F.max(high[k]).alias(f"max_{k}") for k in "xyz"])
    path = scratch(spark, "city")
    sink.write_city(sink.members(rows.drop("envelope"), inside, version), path, version, "EPSG:25832", extent)
    return path


def query(name: str, version: str, sql: str):
    """Registers a query of the members of a file in ``version``."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(spark, city_file(spark, sf_dir, version))
        SQL[name] = sql
        return f

    return keep


for _version in ("2.0", "3.0"):
    _v = _version[0]

    @query(f"file_features_v{_v}", _version, f"""SELECT 'F' || f.id AS feature_id, {_TYPED} AS feature_type, n.name, strftime(f.creation_date, '{"%Y-%m-%d" if _v == "2" else "%Y-%m-%dT%H:%M:%S"}') AS creation_date
FROM feature f JOIN objectclass o ON o.id = f.objectclass_id LEFT JOIN (SELECT feature_id, nullif(trim(arg_min(val_string, id)), '') AS name FROM property WHERE name = 'name' AND val_string IS NOT NULL GROUP BY feature_id) n ON n.feature_id = f.id""")
    def _(spark, path):
        return read_features(spark, path).select("feature_id", "feature_type", "name", "creation_date")

    @query(f"file_attributes_v{_v}", _version, """SELECT 'F' || feature_id AS feature_id, name, arg_max(CASE WHEN val_int IS NOT NULL THEN 'int' WHEN val_double IS NOT NULL THEN 'double' ELSE 'string' END, id) AS kind, arg_max(coalesce(CAST(val_int AS DOUBLE), val_double), id) AS number
FROM property WHERE name IN ('status', 'value', 'yearOfConstruction') AND coalesce(CAST(val_int AS VARCHAR), CAST(val_double AS VARCHAR), val_string) IS NOT NULL AND feature_id IN (SELECT f.id FROM feature f JOIN objectclass o ON o.id = f.objectclass_id) GROUP BY feature_id, name""")
    def _(spark, path):
        return parse.generic_attributes(read_members(spark, path)).select("feature_id", "name", "kind", "number")

    @query(f"file_addresses_v{_v}", _version, """SELECT DISTINCT 'F' || p.feature_id AS feature_id, nullif(trim(a.street), '') AS street, nullif(trim(a.house_number), '') AS house_number, nullif(trim(a.zip_code), '') AS zip_code
FROM property p JOIN address a ON a.id = p.val_address_id JOIN feature f ON f.id = p.feature_id JOIN objectclass o ON o.id = f.objectclass_id WHERE nullif(trim(a.city), '') IS NOT NULL""")
    def _(spark, path):
        found = parse.addresses(read_members(spark, path))
        return found.filter("city is not null").select("feature_id", "street", "house_number", "zip_code").distinct()

    @query(f"file_rings_v{_v}", _version, f"SELECT 'F' || f.id AS feature_id, ({_HIGH}.x - {_LOW}.x) * ({_HIGH}.y - {_LOW}.y) AS area FROM feature f JOIN objectclass o ON o.id = f.objectclass_id WHERE {_FLAT}")
    def _(spark, path):
        found = rings(read_members(spark, path))
        box = geometry.box(geometry.parse_points(F.col("text"), F.col("dimension")))
        return found.select("feature_id", box.alias("b")).select("feature_id", ((F.col("b.max_x") - F.col("b.min_x")) * (F.col("b.max_y") - F.col("b.min_y"))).alias("area"))


@query("file_references", "3.0", "SELECT 'F' || p.feature_id AS feature_id, trim(p.val_uri) AS target, count(*) AS n FROM property p JOIN feature f ON f.id = p.feature_id JOIN objectclass o ON o.id = f.objectclass_id WHERE p.name = 'externalReference' AND trim(p.val_uri) <> '' GROUP BY ALL")
def _(spark, path):
    return parse.external_references(read_members(spark, path)).groupBy("feature_id", "target").agg(F.count("*").alias("n"))


@query("file_bbox", "2.0", f"SELECT 'F' || f.id AS feature_id FROM feature f JOIN objectclass o ON o.id = f.objectclass_id WHERE {_FLAT} AND {_LOW}.x <= 30000 AND {_HIGH}.x >= 10000 AND {_LOW}.y <= 30000 AND {_HIGH}.y >= 10000")
def _(spark, path):
    return read_features(spark, path, bbox=(10000.0, 10000.0, 30000.0, 30000.0)).select("feature_id")


@query("file_types", "3.0", f"SELECT {_TYPED} AS feature_type, count(*) AS n FROM feature f JOIN objectclass o ON o.id = f.objectclass_id WHERE o.classname IN ('Bridge', 'BuildingPart', 'CityFurniture') GROUP BY 1")
def _(spark, path):
    return read_features(spark, path, types=["brid:Bridge", "bldg:BuildingPart", "CityFurniture"]).groupBy("feature_type").agg(F.count("*").alias("n"))


@query("file_top_level", "2.0", "SELECT count(*) AS n FROM feature f JOIN objectclass o ON o.id = f.objectclass_id")
def _(spark, path):
    return promoted(read_features(spark, path)).agg(F.count("*").alias("n"))


@query("file_profile", "3.0", "SELECT '3.0' AS version, '3.2' AS gml_version, 'EPSG:25832' AS srs, count(*) AS n_features FROM feature f JOIN objectclass o ON o.id = f.objectclass_id")
def _(spark, path):
    found = scan_file(spark, path)["profile"]
    return found.agg(F.max(F.when(F.col("version") != "unknown", F.col("version"))).alias("version"), F.max("gml_version").alias("gml_version"), F.max(F.when(F.col("lower").isNotNull(), F.col("srs"))).alias("srs"), F.sum("n_features").alias("n_features"))


@query("file_lods", "2.0", f"SELECT l AS lod, CASE WHEN l = 1 THEN (SELECT count(*) FROM feature f JOIN objectclass o ON o.id = f.objectclass_id WHERE {_FLAT}) ELSE 0 END AS n FROM range(5) AS r(l)")
def _(spark, path):
    return scan_file(spark, path)["lods"].groupBy(F.col("lod").cast("long").alias("lod")).agg(F.sum("n").alias("n"))


def _looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, body): an appearance for each feature: a colour for two targets and a texture for a ring."""
    f = table(spark, sf_dir, "feature").select("id", F.concat(F.lit("F"), F.col("id").cast("string")).alias("feature_id"))
    n = F.col("id").cast("string")
    colours = f.select("feature_id", F.explode(F.array(F.concat(F.lit("P"), n), F.concat(F.lit("Q&"), n))).alias("target"), (F.col("id") % 5 / 4).alias("r"), (F.col("id") % 3 / 2).alias("g"), F.lit(0.5).alias("b"))
    rings_ = f.select("feature_id", F.concat(F.lit("img"), (F.col("id") % 7).cast("string"), F.lit(".png")).alias("image"), F.concat(F.lit("P"), n).alias("target"), F.concat(F.lit("R"), n).alias("ring"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(1.0), F.col("id") % 10 / 10).alias("uv"))
    made = sink.materials_xml(colours).withColumnRenamed("xml", "m").join(sink.textures_xml(rings_), "feature_id")
    return made.select(F.lit("looks").alias("file"), sink.appearance_xml(F.lit("day"), F.col("m"), F.col("xml")).alias("body"))


def look_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of targets, written as appearances and read again."""
    return parse.materials(_looks(spark, sf_dir)).select("theme", "target", "r", "g", "b")


def look_textures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texture coordinates of rings, written as appearances and read again."""
    return parse.textures(_looks(spark, sf_dir)).select("image", "target", "ring", F.size("uv").alias("n"), F.get("uv", F.lit(5)).alias("v"))


def implicit_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of templates in members, with the template's point under the matrix and moved to the reference point."""
    f = table(spark, sf_dir, "feature").filter("envelope is not null").select("id", F.col("envelope")[0].alias("l"))
    at = F.concat_ws(" ", *[F.col(f"l.{k}").cast("string") for k in "xyz"])
    shape = sink.element("core:relativeGMLGeometry", attributes={"xlink:href": F.concat(F.lit("#T"), (F.col("id") % 3).cast("string"))})
    matrix = sink.text_element("core:transformationMatrix", F.lit("2 0 0 0 0 2 0 0 0 0 2 0 0 0 0 1"))
    place = sink.element("core:referencePoint", sink.element("gml:Point", sink.element("gml:pos", at)))
    body = sink.element("frn:CityFurniture", sink.element("frn:lod1ImplicitRepresentation", sink.element("core:ImplicitGeometry", matrix, shape, place)), attributes={"gml:id": F.concat(F.lit("F"), F.col("id").cast("string"))})
    found = parse.implicit_geometries(f.select(F.lit("implicit").alias("file"), body.alias("body")))
    shapes = spark.range(2).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("template"), F.array(geometry.point(F.col("id") + 1.0, F.lit(0.0), F.lit(0.0))).alias("points"))
    placed = placed_templates(found, shapes)
    return placed.select("feature_id", "lod", "template", F.get("points", F.lit(0)).alias("p")).select("feature_id", "lod", "template", "p.x", "p.y", "p.z")


QUERIES |= {"look_materials": look_materials, "look_textures": look_textures, "implicit_places": implicit_places}
SQL |= {
    "look_materials": "SELECT 'day' AS theme, p || id AS target, (id % 5) / 4 AS r, (id % 3) / 2 AS g, CAST(0.5 AS DOUBLE) AS b FROM feature, (SELECT unnest(['P', 'Q&']) AS p)",
    "look_textures": "SELECT 'img' || (id % 7) || '.png' AS image, 'P' || id AS target, 'R' || id AS ring, 6 AS n, (id % 10) / 10 AS v FROM feature",
    "implicit_places": "SELECT 'F' || id AS feature_id, 1 AS lod, 'T' || (id % 3) AS template, CASE WHEN id % 3 < 2 THEN 2 * (id % 3 + 1) + envelope[1].x END AS x, CASE WHEN id % 3 < 2 THEN envelope[1].y END AS y, CASE WHEN id % 3 < 2 THEN envelope[1].z END AS z FROM feature WHERE envelope IS NOT NULL",
}
