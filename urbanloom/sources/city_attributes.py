"""Attributes, addresses, references, templates and appearances out of the members of city files (see ``citygml.read_members``)."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.sources.citygml import _is_feature, plain_tree

_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
#: Attributes of feature types by how they are read.
TEXT_ATTRIBUTES = ["class", "function", "usage", "species", "roofType", "yearOfConstruction", "storeysAboveGround", "storeysBelowGround"]
TRUTH_ATTRIBUTES = ["isMovable", "isStructuralElement"]
MEASURE_ATTRIBUTES = ["height", "measuredHeight", "trunkDiameter", "crownDiameter", "averageHeight", "minHeight", "maxHeight"]


def _read(members: DataFrame, schema: str, rows_of: Callable[[ET.Element], Iterator[tuple]]) -> DataFrame:
    """Rows (file, ...) that ``rows_of`` gives for each member's tree; members that aren't well-formed give none."""
    columns = [c.rsplit(" ", 1) for c in schema.split(", ")]
    fields = [("file", pa.string()), *[(n, _ARROW[t]) for n, t in columns]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for file, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out += [(file, *r) for r in rows_of(plain_tree(body))]
                except ET.ParseError:
                    continue
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    return members.select("file", "body").mapInArrow(run, "file string, " + schema)


def _owned(root: ET.Element) -> Iterator[tuple[ET.Element, ET.Element]]:
    """(feature, element) of all elements inside features, each with the nearest one around it."""
    stack: list[tuple[ET.Element, ET.Element | None]] = [(root, None)]
    while stack:
        e, owner = stack.pop()
        if owner is not None:
            yield owner, e
        if _is_feature(e):
            owner = e
        stack += [(c, owner) for c in reversed(e)]


def _text(e: ET.Element | None) -> str | None:
    return (e.text or "").strip() or None if e is not None else None


def _first(e: ET.Element, *names: str) -> str | None:
    """The first text that isn't blank of the elements ``names`` in ``e``, by name, then by place."""
    return next((t for n in names for x in e.iter(n) if (t := _text(x))), None)


def _number(text: str | None, kind: type = float):
    try:
        return kind(text) if text is not None else None
    except ValueError:
        return None


def generic_attributes(members: DataFrame) -> DataFrame:
    """(file, feature_id, place, name, kind, value, number): generic attributes of either version; of one name the last counts.

    kind: string, int, double, date, uri, ...; what isn't a number for its kind is a string. number: value of int and double.
    """

    def rows_of(root: ET.Element) -> Iterator[tuple]:
        for place, (owner, e) in enumerate(_owned(root)):
            low = e.tag.lower()
            if not low.endswith("attribute") or low in ("genericattribute", "attribute"):
                continue
            name, value = e.get("name") or _text(e.find("name")), _text(e.find("value")) or ""
            if name:
                kind = low.removesuffix("attribute")
                number = _number(value, int if kind == "int" else float) if kind in ("int", "double") else None
                yield owner.get("id"), place, name, kind if number is not None or kind not in ("int", "double") else "string", value, None if number is None else float(number)

    read = _read(members, "feature_id string, place int, name string, kind string, value string, number double", rows_of)
    return read.groupBy("file", "feature_id", "name").agg(F.max_by(F.struct("place", "kind", "value", "number"), "place").alias("a")).select("file", "feature_id", "name", "a.kind", "a.value", "a.number")


def type_attributes(members: DataFrame) -> DataFrame:
    """(file, feature_id, feature_type, name, value, number, uom, truth): attributes of the types of features.

    Measures have their number, if they are one, and unit (metres by default); true, 1, false and 0 their truth.
    """

    def rows_of(root: ET.Element) -> Iterator[tuple]:
        for owner, e in _owned(root):
            if len(e) or not (value := _text(e)):
                continue
            if e.tag in TEXT_ATTRIBUTES:
                yield owner.get("id"), owner.tag, e.tag, value, None, None, None
            elif e.tag in MEASURE_ATTRIBUTES:
                yield owner.get("id"), owner.tag, e.tag, value, _number(value), e.get("uom") or "m", None
            elif e.tag in TRUTH_ATTRIBUTES:
                yield owner.get("id"), owner.tag, e.tag, value, None, None, {"true": True, "1": True, "false": False, "0": False}.get(value.lower())

    return _read(members, "feature_id string, feature_type string, name string, value string, number double, uom string, truth boolean", rows_of)


def addresses(members: DataFrame) -> DataFrame:
    """(file, feature_id, country, country_code, state, city, district, street, house_number, building_name, unit, zip_code, po_box): xAL 2 and 3."""

    def part(e: ET.Element, tag: str, *names: str) -> str | None:
        return next((t for x in e.iter(tag) if (t := _first(x, *names))), None)

    def rows_of(root: ET.Element) -> Iterator[tuple]:
        for owner, e in _owned(root):
            if e.tag != "Address" or any(x.tag == "Address" for x in e if x is not e):
                continue
            yield (
                owner.get("id"), part(e, "Country", "CountryName", "NameElement"), part(e, "Country", "CountryNameCode", "Code"), part(e, "AdministrativeArea", "AdministrativeAreaName", "NameElement"),
                part(e, "Locality", "LocalityName", "NameElement"), part(e, "DependentLocality", "DependentLocalityName", "NameElement"), part(e, "Thoroughfare", "ThoroughfareName", "NameElement"),
                part(e, "Thoroughfare", "ThoroughfareNumber", "Number") or part(e, "Premises", "PremisesNumber", "Number"), part(e, "Premises", "PremisesName", "NameElement"), part(e, "SubPremises", "SubPremisesNumber", "Number"),
                part(e, "PostalCode", "PostalCodeNumber") or part(e, "PostCode", "Identifier"), part(e, "PostBox", "PostBoxNumber", "Identifier"),
            )

    return _read(members, ", ".join(f"{c} string" for c in ("feature_id", "country", "country_code", "state", "city", "district", "street", "house_number", "building_name", "unit", "zip_code", "po_box")), rows_of).distinct()


def external_references(members: DataFrame) -> DataFrame:
    """(file, feature_id, target, system, relation): references to objects of other systems; without a target they are none."""

    def rows_of(root: ET.Element) -> Iterator[tuple]:
        for owner, e in _owned(root):
            if e.tag == "externalReference" and (target := _first(e, "targetResource", "uri", "name")):
                yield owner.get("id"), target, _first(e, "informationSystem"), _first(e, "relationType")

    return _read(members, "feature_id string, target string, system string, relation string", rows_of)


def implicit_geometries(members: DataFrame) -> DataFrame:
    """(file, feature_id, lod, template, library, matrix, x, y, z): instances of templates with their matrix and reference point.

    template: id of the geometry that is referred to or stands in the instance; library: address of an object elsewhere.
    """

    def rows_of(root: ET.Element) -> Iterator[tuple]:
        lod: dict[int, int] = {}
        for owner, e in _owned(root):
            if m := re.match(r"lod([0-4])", e.tag):
                lod |= {id(x): int(m[1]) for x in e.iter("ImplicitGeometry")}
            if e.tag != "ImplicitGeometry":
                continue
            shape = next((x for n in ("relativeGMLGeometry", "relativeGeometry") for x in e.iter(n)), None)
            template = None if shape is None else (shape.get("href") or "").rpartition("#")[2] or next((x.get("id") for x in shape.iter() if x.get("id")), None)
            matrix = [n for t in (_first(e, "transformationMatrix") or "").split() if (n := _number(t)) is not None]
            point = [n for x in e.iter("referencePoint") for t in (_first(x, "pos", "coordinates") or "").replace(",", " ").split() if (n := _number(t)) is not None]
            at = (*point, 0.0)[:3] if len(point) >= 2 else (None, None, None)
            yield owner.get("id"), lod.get(id(e)), template, _first(e, "libraryObject"), matrix if len(matrix) >= 12 else None, *at

    return _read(members, "feature_id string, lod int, template string, library string, matrix array<double>, x double, y double, z double", rows_of)


def member_links(members: DataFrame) -> DataFrame:
    """(file, feature_id, relation, target): references from a feature to others by address: group and version members, parts, relations."""

    def rows_of(root: ET.Element) -> Iterator[tuple]:
        for owner, e in _owned(root):
            if (href := (e.get("href") or "").strip()) and "#" in href or e.tag in ("groupMember", "member", "versionMember") and (e.get("href") or "").strip():
                yield owner.get("id"), e.tag, (e.get("href") or "").strip().rpartition("#")[2]

    return _read(members, "feature_id string, relation string, target string", rows_of)


def series(members: DataFrame) -> DataFrame:
    """(file, feature_id, series_id, kind, attribute): series of values and what holds them; kind: atomic or composite."""

    def rows_of(root: ET.Element) -> Iterator[tuple]:
        for owner, e in _owned(root):
            if e.tag == "Dynamizer" or owner.tag == "Dynamizer":
                d = e if e.tag == "Dynamizer" else owner
                if e.tag.endswith("Timeseries"):
                    yield d.get("id"), e.get("id"), "composite" if e.tag == "CompositeTimeseries" else "atomic", _first(d, "attributeRef")

    return _read(members, "feature_id string, series_id string, kind string, attribute string", rows_of)


def lines(members: DataFrame) -> DataFrame:
    """(file, feature_id, kind, place, coordinates, radius, start, end): points, lines and curve segments, with the text of their coordinates.

    kind: Point, MultiPoint, LineString, LineStringSegment, Arc, ArcString, Circle or ArcByCenterPoint, whose centre the
    coordinates are. Points of a MultiPoint come as one text, those of two dimensions with 0 as their height.
    """
    kinds = ("LineString", "LineStringSegment", "Arc", "ArcString", "Circle", "ArcByCenterPoint", "Point", "MultiPoint")

    def rows_of(root: ET.Element) -> Iterator[tuple]:
        for place, (owner, e) in enumerate(_owned(root)):
            if e.tag not in kinds or e.tag == "Point" and any(e in list(m.iter("Point")) for m in owner.iter("MultiPoint")):
                continue
            texts = [" ".join((x.text or "").replace(",", " ").split()) for x in e.iter() if x.tag in ("pos", "posList", "coordinates")]
            if e.tag == "MultiPoint":
                texts = [t + " 0" if len(t.split()) == 2 else t for t in texts]
            yield owner.get("id"), e.tag, place, " ".join(t for t in texts if t), *(_number(_first(e, n)) for n in ("radius", "startAngle", "endAngle"))

    return _read(members, "feature_id string, kind string, place int, coordinates string, radius double, start double, end double", rows_of)


def point_clouds(members: DataFrame) -> DataFrame:
    """(file, feature_id, mime_type, point_file, srs, points_id): where the points of a cloud are."""

    def rows_of(root: ET.Element) -> Iterator[tuple]:
        for owner, e in _owned(root):
            if e.tag == "PointCloud" or (owner.tag == "PointCloud" and e.tag in ("pointFile", "points")):
                c = e if e.tag == "PointCloud" else owner
                yield c.get("id"), _first(c, "mimeType"), _first(c, "pointFile"), _first(c, "pointFileSrsName"), next((x.get("id") for x in c.iter("MultiPoint")), None)

    return _read(members, "feature_id string, mime_type string, point_file string, srs string, points_id string", rows_of).distinct()


def grids(members: DataFrame) -> DataFrame:
    """(file, feature_id, rows, columns, x, y, z, ux, uy, uz, vx, vy, vz, coordinates): rectified grids with origin, steps and the text of their values.

    Grids without limits, origin or two steps aren't grids; values in a file elsewhere give an empty text.
    """

    def three(text: str | None) -> tuple[float, float, float] | None:
        found = [_number(t) for t in (text or "").split()]
        return (*found, 0.0)[:3] if len(found) >= 2 and None not in found else None

    def rows_of(root: ET.Element) -> Iterator[tuple]:
        for owner, e in _owned(root):
            if e.tag != "RectifiedGrid":
                continue
            low, high = ([_number(t, int) for t in (_first(e, n) or "").split()] for n in ("low", "high"))
            origin, steps = next((p for x in e.iter("origin") if (p := three(_first(x, "pos")))), None), [p for x in e.iter("offsetVector") if (p := three(x.text))]
            if len(low) < 2 or len(high) < 2 or None in low + high or origin is None or len(steps) < 2:
                continue
            values = " ".join((_first(owner, "tupleList", "doubleOrNilReasonTupleList", "QuantityList") or "").replace(",", " ").split())
            yield owner.get("id"), high[1] - low[1] + 1, high[0] - low[0] + 1, *origin, *steps[0], *steps[1], values

    names = ["x", "y", "z", "ux", "uy", "uz", "vx", "vy", "vz"]
    return _read(members, "feature_id string, rows int, columns int, " + ", ".join(f"{n} double" for n in names) + ", coordinates string", rows_of)


def _targets(e: ET.Element) -> list[str]:
    found = [(x.get("href") or x.get("uri") or x.text or "").strip() for x in e.iter() if x.tag in ("target", "uri")]
    return [t.rpartition("#")[2] for t in found if t]


def materials(parts: DataFrame) -> DataFrame:
    """(file, theme, material, target, r, g, b, transparency, shininess): colours of X3D materials, one row per target.

    A colour that can't be read is grey; numbers are clamped to 0 and 1. Targets are ids of polygons or of what holds them.
    """

    def rows_of(root: ET.Element) -> Iterator[tuple]:
        for look in [root, *root.iter("Appearance")][1:] or [root]:
            for m in look.iter("X3DMaterial"):
                if not (colour := _first(m, "diffuseColor")):
                    continue
                rgb = [_number(t) for t in colour.split()][:3]
                rgb = [0.8, 0.8, 0.8] if len(rgb) < 3 or None in rgb else [max(0.0, min(1.0, v)) for v in rgb]
                for t in dict.fromkeys(_targets(m)):
                    yield _first(look, "theme"), m.get("id"), t, *rgb, _number(_first(m, "transparency")), _number(_first(m, "shininess"))

    return _read(parts, "theme string, material string, target string, r double, g double, b double, transparency double, shininess double", rows_of)


def textures(parts: DataFrame) -> DataFrame:
    """(file, theme, image, target, ring, uv): coordinates of parameterised textures, one row per ring; ring null: of the whole target.

    The ring stands in an attribute, in the list, or behind it; uv holds u and v in turn. The first texture of a ring counts.
    """

    def rows_of(root: ET.Element) -> Iterator[tuple]:
        for look in [root, *root.iter("Appearance")][1:] or [root]:
            for t in look.iter("ParameterizedTexture"):
                image = _first(t, "imageURI")
                scopes = list(t.iter("TextureAssociation")) or [x for x in t.iter("target") if len(x)] or [t]
                for scope in scopes:
                    targets = [x for x in [(scope.get("uri") or "").rpartition("#")[2], *_targets(scope)] if x]
                    for lists in scope.iter("TexCoordList"):
                        kids = list(lists)
                        rings = [(_text(k) or k.get("href") or "").rpartition("#")[2] for k in kids if k.tag == "ring"]
                        for k in [k for k in kids if k.tag == "textureCoordinates"]:
                            numbers = [n for x in (k.text or "").replace(",", " ").split() if (n := _number(x)) is not None]
                            own = k.get("ring") or _first(k, "ring")
                            ring = own.rpartition("#")[2] if own else rings.pop(0) if rings else None
                            if image and len(numbers) >= 6:
                                yield _first(look, "theme"), image, targets[0] if targets else None, ring, numbers[: len(numbers) // 2 * 2]

    read = _read(parts, "theme string, image string, target string, ring string, uv array<double>", rows_of)
    return read.groupBy("file", "target", "ring").agg(F.min_by(F.struct("theme", "image", "uv"), F.struct("theme", "image")).alias("t")).select("file", "t.theme", "t.image", "target", "ring", "t.uv")


def georeferenced_textures(parts: DataFrame) -> DataFrame:
    """(file, image, target, x, y, z, orientation): images laid over their targets by a reference point and a 2x2 matrix; the first image of a target counts."""

    def rows_of(root: ET.Element) -> Iterator[tuple]:
        for t in root.iter("GeoreferencedTexture"):
            point = [n for x in (_first(t, "pos", "posList", "referencePoint") or "").split() if (n := _number(x)) is not None]
            turn = [n for x in (_first(t, "orientation") or "").split() if (n := _number(x)) is not None]
            if (image := _first(t, "imageURI")) and len(point) >= 2:
                m = turn[:4] if len(turn) >= 4 else [turn[0], 0.0, 0.0, turn[1]] if len(turn) >= 2 else [1.0, 0.0, 0.0, 1.0]
                for target in _targets(t):
                    yield image, target, *(*point, 0.0)[:3], m

    read = _read(parts, "image string, target string, x double, y double, z double, orientation array<double>", rows_of)
    return read.groupBy("file", "target").agg(F.min_by(F.struct("image", "x", "y", "z", "orientation"), "image").alias("t")).select("file", "t.image", "target", "t.x", "t.y", "t.z", "t.orientation")


def image_paths(of_textures: DataFrame, of_georeferenced: DataFrame) -> DataFrame:
    """(image) of all textures, each once."""
    return of_textures.select("image").union(of_georeferenced.select("image")).distinct()
