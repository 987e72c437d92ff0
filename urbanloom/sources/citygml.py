"""City files: members out of XML.

Files are cut at their member tags by the text source itself, so one large file is read by many tasks and no task holds more
than a member at a time.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.functions.geometry import box, parse_points

#: Types of boundary surfaces and of fillings.
SURFACES = ["RoofSurface", "WallSurface", "GroundSurface", "ClosureSurface", "FloorSurface", "CeilingSurface", "InteriorWallSurface", "OuterCeilingSurface", "OuterFloorSurface", "WaterSurface", "TrafficArea", "AuxiliaryTrafficArea", "Door", "Window"]

_TAG_PREFIX = re.compile(r"<(/?)[A-Za-z_][\w.-]*:")
_ATTRIBUTE_PREFIX = re.compile(r"(\s)[A-Za-z_][\w.-]*:([\w.-]+\s*=)")
_LOD = re.compile(r"^lod([0-4])")
_RING_SCHEMA = "file string, member_id string, feature_id string, feature_type string, label string, lod int, polygon_id string, polygon int, ring int, is_interior boolean, srs string, dimension int, text string"
_FEATURE_SCHEMA = "file string, member_id string, feature_id string, feature_type string, parent_id string, depth int, name string, creation_date string, termination_date string, lods array<int>, hrefs array<string>, error string"


def _parts(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(file, part): the text between the mentions of the member tag's name; the text source cuts files there, so no task holds a file."""
    return spark.read.text(path, lineSep=tag).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("part"))


#: The end of a part before the name in a closing tag: such a part is what stands in a member.
_CLOSING = r"</([A-Za-z_][\w.-]*:)?$"


def read_members(spark: SparkSession, path: str, tag: str = "cityObjectMember") -> DataFrame:
    """(file, body): the XML inside each member of the files in ``path``; attributes and blanks in the member tags don't matter.

    A member that only refers to one elsewhere (``<cityObjectMember xlink:href=.../>``) has no body.
    """
    parts = _parts(spark, path, tag).filter(F.col("part").rlike(_CLOSING))
    return parts.select("file", F.regexp_replace(F.regexp_replace("part", _CLOSING, ""), r"^[^>]*>", "").alias("body"))


def file_profile(spark: SparkSession, path: str, tag: str = "cityObjectMember") -> DataFrame:
    """(file, version, gml_version, modules, srs, lower, upper): what the texts around the members say, before or behind them.

    modules: versions by module name. Where there is no envelope around the members, srs is the first that a member names,
    and the corners are null.
    """
    parts = _parts(spark, path, tag)
    around = parts.filter(~F.col("part").rlike(_CLOSING) & F.col("part").contains("CityModel") | F.col("part").contains("lowerCorner") & ~F.col("part").rlike(_CLOSING))
    found = lambda pattern: F.max(F.nullif(F.trim(F.regexp_extract("part", pattern, 1)), F.lit("")))
    spaces = F.max(F.when(F.col("part").contains("xmlns"), F.array_distinct(F.regexp_extract_all("part", F.lit(r"xmlns(?::[\w.-]+)?=[\"']([^\"']+)[\"']"), F.lit(1)))))
    heads = around.groupBy("file").agg(spaces.alias("spaces"), found(r"schemaLocation=[\"']([^\"']+)").alias("schemas"), found(r"Envelope[^>]*srsName=[\"']([^\"']*)").alias("srs"), found(r"lowerCorner[^>]*>([^<]*)<").alias("lower"), found(r"upperCorner[^>]*>([^<]*)<").alias("upper"))
    named = parts.filter(F.col("part").rlike(_CLOSING) & F.col("part").contains("srsName")).groupBy("file").agg(F.min(F.nullif(F.regexp_extract("part", r"srsName=[\"']([^\"']*)", 1), F.lit(""))).alias("member_srs"))
    modules = F.map_from_entries(F.array_distinct(F.transform(F.filter("spaces", lambda u: u.rlike(r"/citygml/[a-zA-Z]+/\d")), lambda u: F.struct(F.regexp_extract(u, r"/citygml/([a-zA-Z]+)/", 1).alias("key"), F.regexp_extract(u, r"/citygml/[a-zA-Z]+/([\d.]+)", 1).alias("value")))))
    gml = F.when(F.array_contains("spaces", "http://www.opengis.net/gml/3.2"), "3.2").when(F.array_contains("spaces", "http://www.opengis.net/gml"), "3.1")
    return heads.join(named, "file", "left").select("file", version_of(F.col("spaces"), F.col("schemas")).alias("version"), gml.alias("gml_version"), modules.alias("modules"), F.coalesce("srs", "member_srs").alias("srs"), "lower", "upper")


def version_of(spaces: Column, schemas: Column) -> Column:
    """``2.0``, ``3.0`` or ``unknown`` by the namespaces of a file (array), else its schema locations, else its GML version."""
    core = lambda v: F.array_contains(spaces, f"http://www.opengis.net/citygml/{v}")
    module = lambda v: F.exists(spaces, lambda u: u.contains("/citygml/") & u.contains(f"/{v}"))
    schema = lambda v: F.coalesce(F.lower(schemas).contains(f"citygml/{v}"), F.lit(False))
    rules = [(core("3.0"), "3.0"), (core("2.0"), "2.0"), (module("3.0"), "3.0"), (module("2.0"), "2.0"), (schema("3.0"), "3.0"), (schema("2.0"), "2.0")]
    rules += [(F.array_contains(spaces, "http://www.opengis.net/gml/3.2"), "3.0"), (F.array_contains(spaces, "http://www.opengis.net/gml"), "2.0")]
    return F.coalesce(*[F.when(c, v) for c, v in rules], F.lit("unknown"))


def foreign_namespaces(spark: SparkSession, path: str, tag: str = "cityObjectMember") -> DataFrame:
    """(file, prefix, uri) of the namespaces of extensions: neither of the standards, nor of XML itself, and used by an element."""
    parts = _parts(spark, path, tag)
    names = parts.filter(F.col("part").contains("xmlns:")).select("file", F.explode(F.regexp_extract_all("part", F.lit(r"xmlns:([\w.-]+=[\"'][^\"']+)"), F.lit(1))).alias("n")).distinct()
    split = names.select("file", F.substring_index("n", "=", 1).alias("prefix"), F.regexp_replace("n", r"^[^=]*=[\"']", "").alias("uri"))
    foreign = split.filter(~F.col("uri").rlike(r"^http://(www\.opengis\.net/|www\.w3\.org/)|oasis:names:tc:ciq"))
    used = parts.select("file", F.explode(F.array_distinct(F.regexp_extract_all("part", F.lit(r"<([A-Za-z_][\w.-]*):"), F.lit(1)))).alias("prefix")).distinct()
    return foreign.join(used, ["file", "prefix"], "left_semi").select("file", "prefix", "uri")


def scan_file(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What files hold, without building anything of it.

    profile: see ``file_profile``, with n_features, mb and memory_mb; types: features by file and type; lods: geometries by
    file and level 0 to 4, zeros included. Sizes come from the file listing.
    """
    found = features(read_members(spark, path))
    sizes = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), (F.col("length") / 1048576).alias("mb"))
    counts = found.filter(F.col("feature_id").isNotNull()).groupBy("file").agg(F.count("*").alias("n_features"))
    memory = F.greatest(F.lit(50.0), F.bround(F.col("mb") * 10 + F.col("n_features") * 0.5, 1))
    profile = file_profile(spark, path).join(counts, "file", "left").join(sizes, "file", "left").fillna(0, ["n_features", "mb"]).withColumn("memory_mb", memory)
    every = counts.select("file", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("lod"))
    lods = found.select("file", F.explode("lods").alias("lod")).groupBy("file", "lod").agg(F.count("*").alias("n"))
    return {
        "profile": profile, "types": found.filter(F.col("feature_id").isNotNull()).groupBy("file", "feature_type").agg(F.count("*").alias("n")),
        "lods": every.join(lods, ["file", "lod"], "left").select("file", "lod", F.coalesce("n", F.lit(0)).alias("n")),
    }


def feature_boxes(members: DataFrame) -> DataFrame:
    """(file, feature_id, feature_type, min_x, ... max_z): the extent of each feature's own rings, as an index to look places up in."""
    corners = [f"{n}_{k}" for n in ("min", "max") for k in "xyz"]
    each = rings(members).select("file", "feature_id", "feature_type", box(parse_points(F.col("text"), F.col("dimension"))).alias("b")).filter(F.col("b").isNotNull())
    return each.groupBy("file", "feature_id", "feature_type").agg(*[getattr(F, c[:3])(f"b.{c}").alias(c) for c in corners])


def boxes_in(boxes: DataFrame, bbox: tuple[float, float, float, float], types: list[str] | None = None) -> DataFrame:
    """Rows of ``feature_boxes`` that meet an extent in the plane, edges included, of the given types or of all."""
    out = boxes.filter((F.col("min_x") <= bbox[2]) & (F.col("max_x") >= bbox[0]) & (F.col("min_y") <= bbox[3]) & (F.col("max_y") >= bbox[1]))
    return out.filter(F.col("feature_type").isin(types)) if types else out


def file_origins(spark: SparkSession, path: str) -> DataFrame:
    """(file, x, y, z, srs): the lower corner of each file's envelope, or else the smallest coordinates of its rings."""
    corner = parse_points(F.col("lower"), F.when(F.size(F.split("lower", r"\s+")) >= 3, 3).otherwise(2), close=False)
    heads = file_profile(spark, path).select("file", "srs", F.get(corner, F.lit(0)).alias("low"))
    least = feature_boxes(read_members(spark, path)).groupBy("file").agg(*[F.min(f"min_{k}").alias(k) for k in "xyz"])
    return heads.join(least, "file", "left").select("file", *[F.coalesce(F.col(f"low.{k}"), F.col(k)).alias(k) for k in "xyz"], "srs")


def count_features(spark: SparkSession, path: str, ids: DataFrame | None = None) -> int:
    """How many features the files in ``path`` hold, by ``ids`` or all; of one id in a file one counts."""
    return read_features(spark, path, ids).count()


#: Feature types that stay beside their promoted parts, and types that aren't promoted out of them.
KEPT_PARENTS = ["Building", "Bridge", "Tunnel"]
NOT_PROMOTED = ["BridgeInstallation", "TunnelInstallation"]


def read_features(spark: SparkSession, path: str, ids: DataFrame | None = None, types: list[str] | None = None, bbox: tuple[float, float, float, float] | None = None, missing: str = "drop") -> DataFrame:
    """Features of the files in ``path`` (see ``features``) by id, type and extent; of several with one id the first in its file wins.

    ids: (id) to keep; missing: whether features without id (``ids``) or without coordinates (``bbox``) are kept or dropped.
    bbox meets the extent of a feature's own rings, or else that of the member it stands in.
    """
    members = read_members(spark, path)
    out = features(members).filter(F.col("error").isNull())
    if types is not None:
        out = out.filter(F.col("feature_type").isin([t.rpartition(":")[2] for t in types]))
    if ids is not None:
        hit = out.join(ids.select(F.col("id").alias("feature_id")).distinct(), "feature_id", "left_semi")
        out = hit.select(*out.columns) if missing == "drop" else hit.select(*out.columns).unionByName(out.filter(F.col("feature_id").isNull()))
    if bbox is not None:
        points = rings(members).select("file", "member_id", "feature_id", box(parse_points(F.col("text"), F.col("dimension"))).alias("b"))
        extent = [F.min("b.min_x").alias("x0"), F.min("b.min_y").alias("y0"), F.max("b.max_x").alias("x1"), F.max("b.max_y").alias("y1")]
        own = points.groupBy("file", "feature_id").agg(F.struct(*extent).alias("own"))
        whole = points.groupBy("file", "member_id").agg(F.struct(*extent).alias("whole"))
        placed = out.join(own, ["file", "feature_id"], "left").join(whole, ["file", "member_id"], "left").withColumn("e", F.coalesce("own", "whole"))
        meets = (F.col("e.x0") <= bbox[2]) & (F.col("e.x1") >= bbox[0]) & (F.col("e.y0") <= bbox[3]) & (F.col("e.y1") >= bbox[1])
        out = placed.filter(F.coalesce(meets, F.lit(missing == "keep"))).select(*out.columns)
    first = out.filter(F.col("feature_id").isNotNull()).groupBy("file", "feature_id").agg(F.min_by(F.struct(*out.columns), F.struct("depth", "member_id", F.hash(*out.columns))).alias("r"))
    return first.select("r.*").unionByName(out.filter(F.col("feature_id").isNull()))


def promoted(found: DataFrame) -> DataFrame:
    """Features at the top of a member as an import gives them: the kinds of KEPT_PARENTS with their parts and installations, others replaced by what is in them, if anything is."""
    parents = found.select("file", F.col("feature_id").alias("parent_id"), F.col("feature_type").alias("parent_type"), F.col("depth").alias("parent_depth")).filter("parent_depth = 0")
    inner = found.filter("depth = 1").join(parents, ["file", "parent_id"])
    chosen = inner.filter(F.when(F.col("parent_type").isin(KEPT_PARENTS), F.col("feature_type").rlike("(Part|Installation)$") & ~F.col("feature_type").isin(NOT_PROMOTED)).otherwise(~F.col("feature_type").isin(SURFACES)))
    replaced = chosen.filter(~F.col("parent_type").isin(KEPT_PARENTS)).select("file", F.col("parent_id").alias("feature_id")).distinct()
    return found.filter("depth = 0").join(replaced, ["file", "feature_id"], "left_anti").select(*found.columns).unionByName(chosen.select(*found.columns))


def plain_tree(body: str) -> ET.Element:
    """The element of a member without namespace prefixes; raises ParseError if it isn't well-formed."""
    return ET.fromstring("<member>" + _ATTRIBUTE_PREFIX.sub(r"\1\2", _TAG_PREFIX.sub(r"<\1", body)) + "</member>")


def _is_feature(e: ET.Element) -> bool:
    return e.get("id") is not None and e.tag[:1].isupper() and e.tag not in ("Polygon", "LinearRing", "MultiSurface", "Solid", "CompositeSurface", "MultiCurve", "LineString", "Point", "MultiPoint", "Surface", "Shell", "TriangulatedSurface", "Tin")


def _features(root: ET.Element) -> Iterator[tuple]:
    stack = [(root, None, None, 0, False)]
    rows: dict[int, dict] = {}
    while stack:
        e, owner, member, depth, direct = stack.pop()
        feature = _is_feature(e)
        if feature:
            member = member or e.get("id")
            rows[id(e)] = {"id": e.get("id"), "type": e.tag, "parent": rows[owner]["id"] if owner else None, "depth": depth, "member": member, "lods": set(), "hrefs": [], "text": {}}
            owner, depth = id(e), depth + 1
        elif owner:
            row = rows[owner]
            if m := _LOD.match(e.tag):
                row["lods"].add(int(m[1]))
            if e.get("href"):
                row["hrefs"].append(e.get("href"))
            if direct and e.tag in ("name", "creationDate", "terminationDate") and e.tag not in row["text"]:
                row["text"][e.tag] = (e.text or "").strip()
        stack += [(c, owner, member, depth, feature) for c in reversed(e)]
    for r in rows.values():
        yield r["member"], r["id"], r["type"], r["parent"], r["depth"], r["text"].get("name"), r["text"].get("creationDate"), r["text"].get("terminationDate"), sorted(r["lods"]), r["hrefs"], None


def _rings(root: ET.Element) -> Iterator[tuple]:
    stack = [(root, None, None, None, None, None, None, None)]
    count = 0
    while stack:
        e, member, owner, kind, label, lod, srs, dimension = stack.pop()
        srs, dimension = e.get("srsName", srs), e.get("srsDimension", dimension)
        if _is_feature(e):
            member, owner, kind = member or e.get("id"), e.get("id"), e.tag
        if e.tag in SURFACES:
            label = e.tag
        if m := _LOD.match(e.tag):
            lod = int(m[1])
        if e.tag in ("Polygon", "PolygonPatch", "Triangle", "Rectangle"):
            ring = 0
            for part in e:
                if part.tag not in ("exterior", "interior"):
                    continue
                text = " ".join(" ".join((x.text or "").split()) for x in part.iter() if x.tag in ("posList", "pos", "coordinates"))
                of = next((x.get("srsDimension") for x in part.iter() if x.get("srsDimension")), e.get("srsDimension", dimension))
                yield member, owner, kind, label, lod, e.get("id"), count, ring, part.tag == "interior", srs, int(of) if of else None, text
                ring += 1
            count += 1
            continue
        stack += [(c, member, owner, kind, label, lod, srs, dimension) for c in reversed(e)]


def _parsed(members: DataFrame, schema: str, rows_of) -> DataFrame:
    kinds = [pa.string() if x.split()[1] == "string" else pa.int32() if x.split()[1] == "int" else pa.bool_() if x.split()[1] == "boolean" else pa.list_(pa.int32() if "int" in x else pa.string()) for x in schema.split(", ")]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for file, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(file, *r) for r in rows_of(body)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return members.select("file", "body").mapInArrow(run, schema)


def features(members: DataFrame) -> DataFrame:
    """Features of the members: id, type, parent, dates, levels of detail and references. A member that isn't well-formed gives one row with its error."""

    def rows_of(body: str) -> Iterator[tuple]:
        try:
            yield from _features(plain_tree(body))
        except ET.ParseError as e:
            yield (None, None, None, None, None, None, None, None, None, None, str(e))

    return _parsed(members, _FEATURE_SCHEMA, rows_of)


def rings(members: DataFrame) -> DataFrame:
    """Rings of all polygons and triangles with the feature, surface and level they belong to; members that aren't well-formed give none."""

    def rows_of(body: str) -> Iterator[tuple]:
        try:
            yield from _rings(plain_tree(body))
        except ET.ParseError:
            return

    return _parsed(members, _RING_SCHEMA, rows_of)
