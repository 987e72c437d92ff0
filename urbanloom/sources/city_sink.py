"""City files out of tables: features with names, dates, attributes, addresses, references and surfaces, in version 2.0 or 3.0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Modules of feature types; the namespace of a module is that of its version.
MODULES = {
    "bldg": ("building", ["Building", "BuildingPart", "BuildingInstallation", "BuildingRoom", "BuildingFurniture", "Storey"]),
    "brid": ("bridge", ["Bridge", "BridgePart"]), "tun": ("tunnel", ["Tunnel", "TunnelPart"]), "tran": ("transportation", ["Road", "Railway", "Track", "Square"]),
    "veg": ("vegetation", ["PlantCover", "SolitaryVegetationObject"]), "wtr": ("waterbody", ["WaterBody"]), "frn": ("cityfurniture", ["CityFurniture"]), "luse": ("landuse", ["LandUse"]),
    "dem": ("relief", ["ReliefFeature"]), "grp": ("cityobjectgroup", ["CityObjectGroup"]), "gen": ("generics", ["GenericCityObject", "GenericOccupiedSpace"]),
}
CORE = {"2.0": "http://www.opengis.net/citygml/2.0", "3.0": "http://www.opengis.net/citygml/3.0"}
GML = {"2.0": "http://www.opengis.net/gml", "3.0": "http://www.opengis.net/gml/3.2"}
XAL = {"2.0": "urn:oasis:names:tc:ciq:xsdschema:xAL:2.0", "3.0": "urn:oasis:names:tc:ciq:xal:3"}
XLINK = "http://www.w3.org/1999/xlink"
#: Elements of generic attributes by their kind, version 2.0.
ATTRIBUTE_TAGS = {"string": "stringAttribute", "int": "intAttribute", "double": "doubleAttribute", "date": "dateAttribute", "uri": "uriAttribute"}


def escaped(column: Column | str) -> Column:
    """Text with the marks of XML written as entities."""
    out = F.col(column) if isinstance(column, str) else column
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def element(tag: str | Column, *inside: Column, attributes: dict[str, Column] | None = None) -> Column:
    """``<tag a="...">inside</tag>``; parts that are null are left out."""
    name = F.lit(tag) if isinstance(tag, str) else tag
    marks = [F.when(v.isNotNull(), F.concat(F.lit(f' {k}="'), escaped(v.cast("string")), F.lit('"'))) for k, v in (attributes or {}).items()]
    return F.concat_ws("", F.lit("<"), name, *marks, F.lit(">"), *inside, F.lit("</"), name, F.lit(">"))


def text_element(tag: str, value: Column, attributes: dict[str, Column] | None = None) -> Column:
    """An element with a text in it, null if the text is."""
    return F.when(value.isNotNull(), element(tag, escaped(value.cast("string")), attributes=attributes))


def feature_tag(kind: Column) -> Column:
    """Prefixed tag of a type of feature; types of no module are generic objects."""
    out = F.lit("gen:GenericCityObject")
    for prefix, (_, names) in MODULES.items():
        out = F.when(kind.isin(names), F.concat(F.lit(f"{prefix}:"), kind)).otherwise(out)
    return out


def generic_attribute(name: Column, kind: Column, value: Column, version: str) -> Column:
    """A generic attribute (kind: string, int, double, date or uri), null without a name or value."""
    tag = F.coalesce(*[F.when(kind == k, t) for k, t in ATTRIBUTE_TAGS.items()], F.lit("stringAttribute"))
    if version == "2.0":
        made = element(F.concat(F.lit("gen:"), tag), text_element("gen:value", value), attributes={"name": name})
    else:
        made = element("core:genericAttribute", element(F.concat(F.lit("gen:"), F.initcap(F.substring(tag, 1, 1)), F.substring(tag, 2, 100)), text_element("gen:name", name), text_element("gen:value", value)))
    return F.when(name.isNotNull() & value.isNotNull(), made)


def address_xml(street: Column, number: Column, code: Column, city: Column, country: Column, version: str) -> Column:
    """A postal address in xAL 2 or 3; parts that are null are left out."""
    if version == "2.0":
        way = F.when(street.isNotNull() | number.isNotNull(), element("xAL:Thoroughfare", text_element("xAL:ThoroughfareNumber", number), text_element("xAL:ThoroughfareName", street)))
        place = element("xAL:Locality", text_element("xAL:LocalityName", city), way, F.when(code.isNotNull(), element("xAL:PostalCode", text_element("xAL:PostalCodeNumber", code))))
        whole = element("xAL:AddressDetails", element("xAL:Country", text_element("xAL:CountryName", country), place))
        return element("bldg:address", element("core:Address", element("core:xalAddress", whole)))
    named = lambda tag, name, *more: F.when(name.isNotNull(), element(tag, text_element("xAL:NameElement", name), *more))
    way = F.when(street.isNotNull() | number.isNotNull(), element("xAL:Thoroughfare", text_element("xAL:NameElement", street), text_element("xAL:Number", number)))
    whole = element("xAL:Address", named("xAL:Country", country), named("xAL:Locality", city), way, F.when(code.isNotNull(), element("xAL:PostCode", text_element("xAL:Identifier", code))))
    return element("core:address", element("core:Address", element("core:xalAddress", whole)))


def external_reference(target: Column, system: Column, version: str, relation: Column | None = None) -> Column:
    """A reference to an object of another system, null without a target."""
    if version == "2.0":
        made = element("core:externalReference", text_element("core:informationSystem", system), element("core:externalObject", text_element("core:uri", target)))
    else:
        more = [] if relation is None else [text_element("core:relationType", relation)]
        made = element("core:externalReference", element("core:ExternalReference", text_element("core:targetResource", target), text_element("core:informationSystem", system), *more))
    return F.when(target.isNotNull(), made)


def pos_list(points: Column) -> Column:
    """Points as the text of a coordinate list."""
    return F.array_join(F.flatten(F.transform(points, lambda p: F.array(p["x"], p["y"], p["z"]))).cast("array<string>"), " ")


def polygon_xml(outer: Column, inner: Column, polygon_id: Column | None = None) -> Column:
    """A polygon of an outer ring and an array of inner rings."""
    ring = lambda tag, p: element(tag, element("gml:LinearRing", element("gml:posList", pos_list(p), attributes={"srsDimension": F.lit(3)})))
    holes = F.array_join(F.transform(inner, lambda p: ring("gml:interior", p)), "")
    return element("gml:Polygon", ring("gml:exterior", outer), holes, attributes={} if polygon_id is None else {"gml:id": polygon_id})


def composite_xml(polygons: Column, composite_id: Column | None = None) -> Column:
    """A composite surface of an array of polygons in XML."""
    inside = F.array_join(F.transform(polygons, lambda p: F.concat(F.lit("<gml:surfaceMember>"), p, F.lit("</gml:surfaceMember>"))), "")
    return element("gml:CompositeSurface", inside, attributes={} if composite_id is None else {"gml:id": composite_id})


def solid_xml(polygon_ids: Column) -> Column:
    """A solid whose shell refers to polygons by their ids."""
    inside = F.array_join(F.transform(polygon_ids, lambda i: F.concat(F.lit('<gml:surfaceMember xlink:href="#'), escaped(i), F.lit('"/>'))), "")
    return element("gml:Solid", element("gml:exterior", element("gml:CompositeSurface", inside)))


def curve_xml(segments: Column) -> Column:
    """A curve of segments (kind, points): LineStringSegment, Arc (its first three points) or ArcString."""
    one = lambda s: element(F.concat(F.lit("gml:"), s["kind"]), element("gml:posList", pos_list(F.when(s["kind"] == "Arc", F.slice(s["points"], F.lit(1), F.lit(3))).otherwise(s["points"]))))
    return element("gml:Curve", element("gml:segments", F.array_join(F.transform(segments, one), "")))


def grid_xml(rows: Column, columns: Column, origin: Column, along: Column, across: Column, values: Column) -> Column:
    """A rectified grid coverage with the text of its values by row."""
    vector = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"), p["z"].cast("string"))
    high = F.concat_ws(" ", (columns - 1).cast("string"), (rows - 1).cast("string"))
    limits = element("gml:limits", element("gml:GridEnvelope", element("gml:low", F.lit("0 0")), element("gml:high", high)))
    grid = element("gml:RectifiedGrid", limits, element("gml:origin", element("gml:Point", element("gml:pos", vector(origin)))), element("gml:offsetVector", vector(along)), element("gml:offsetVector", vector(across)), attributes={"dimension": F.lit(2)})
    return element("gml:RectifiedGridCoverage", element("gml:domainSet", grid), element("gml:rangeSet", element("gml:DataBlock", element("gml:tupleList", values))))


def type_attribute(prefix: str, name: str, value: Column, uom: Column | None = None) -> Column:
    """An attribute of a type of feature, with its unit if it is a measure; null if the value is."""
    return text_element(f"{prefix}:{name}", value, {} if uom is None else {"uom": uom})


def materials_xml(df: DataFrame) -> DataFrame:
    """(feature_id, xml) of X3D materials for faces (feature_id, target, r, g, b): one for each colour of a feature, with its targets in order."""
    colours = df.dropna(subset=["feature_id", "target", "r", "g", "b"]).groupBy("feature_id", "r", "g", "b").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    colour = F.concat_ws(" ", *[F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))).cast("string") for c in "rgb"])
    targets = F.array_join(F.transform("targets", lambda t: element("app:target", F.concat(F.lit("#"), escaped(t)))), "")
    one = element("app:surfaceData", element("app:X3DMaterial", element("app:diffuseColor", colour), targets))
    return colours.select("feature_id", "r", "g", "b", one.alias("xml")).groupBy("feature_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "g", "b", "xml"))), lambda x: x["xml"]), "").alias("xml"))


def textures_xml(df: DataFrame) -> DataFrame:
    """(feature_id, xml) of textures for rings (feature_id, image, target, ring, uv): one for each image of a feature."""
    uv = F.array_join(F.transform("uv", lambda v: v.cast("string")), " ")
    one = element("app:target", element("app:TexCoordList", element("app:textureCoordinates", uv, attributes={"ring": F.concat(F.lit("#"), F.col("ring"))})), attributes={"uri": F.concat(F.lit("#"), F.col("target"))})
    rows = df.dropna(subset=["feature_id", "image", "target", "ring", "uv"]).select("feature_id", "image", "target", "ring", one.alias("xml"))
    images = rows.groupBy("feature_id", "image").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("target", "ring", "xml"))), lambda x: x["xml"]), "").alias("inside"))
    made = images.select("feature_id", "image", element("app:surfaceData", element("app:ParameterizedTexture", text_element("app:imageURI", F.col("image")), F.col("inside"))).alias("xml"))
    return made.groupBy("feature_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("image", "xml"))), lambda x: x["xml"]), "").alias("xml"))


def appearance_xml(theme: Column, *data: Column) -> Column:
    """The appearance of a feature under a theme."""
    return element("app:appearance", element("app:Appearance", text_element("app:theme", theme), *data))


def surfaces(polygons: DataFrame, version: str) -> DataFrame:
    """(feature_id, lod, xml) of polygons (feature_id, lod, polygon, ring, is_interior, points): one multi-surface per level.

    Rows without feature or points are left out; only the polygons of one feature and level are gathered at a time.
    """
    whole = polygons.dropna(subset=["feature_id", "points"])
    rings = F.transform(F.array_sort(F.collect_list(F.struct("is_interior", "ring", "points"))), lambda r: r)
    one = whole.groupBy("feature_id", "lod", "polygon").agg(rings.alias("rings"))
    parts = one.withColumn("outer", F.get("rings", F.lit(0))["points"]).withColumn("inner", F.transform(F.slice("rings", F.lit(2), F.greatest(F.size("rings") - 1, F.lit(0))), lambda r: r["points"]))
    made = parts.select("feature_id", "lod", "polygon", element("gml:surfaceMember", polygon_xml(F.col("outer"), F.col("inner"))).alias("xml"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("polygon", "xml"))), lambda r: r["xml"]), "")
    return made.groupBy("feature_id", "lod").agg(element("gml:MultiSurface", joined).alias("xml"))


def members(features: DataFrame, inside: DataFrame, version: str) -> DataFrame:
    """(feature_id, xml): a member for each feature (feature_id, feature_type, name, creation_date), in the order of the schema.

    inside: (feature_id, place, key, xml) of what goes into the feature: place is its order in the schema, key among equals.
    """
    day = F.date_format("creation_date", "yyyy-MM-dd" if version == "2.0" else "yyyy-MM-dd'T'HH:mm:ss")
    parts = inside.dropna(subset=["feature_id", "xml"]).groupBy("feature_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "key", "xml"))), lambda r: r["xml"]), "").alias("__inside"))
    head = [text_element("gml:name", F.col("name")), text_element("core:creationDate", day)]
    made = element(feature_tag(F.col("feature_type")), *head, F.col("__inside"), attributes={"gml:id": F.col("feature_id")})
    return features.dropna(subset=["feature_id"]).join(parts, "feature_id", "left").select("feature_id", element("core:cityObjectMember", made).alias("xml"))


def level_property(feature_type: Column, lod: Column, xml: Column, version: str) -> Column:
    """The property that holds a multi-surface: of the feature's module in 2.0, of the core in 3.0."""
    prefix = F.lit("core") if version == "3.0" else F.substring_index(feature_tag(feature_type), ":", 1)
    return element(F.concat(prefix, F.lit(":lod"), lod.cast("string"), F.lit("MultiSurface")), xml)


def write_city(made: DataFrame, path: str, version: str = "2.0", srs: str | None = None, extent: DataFrame | None = None) -> None:
    """Writes members (feature_id, xml) as text parts that make one file when joined in order.

    Head and foot are the first and the last row; with ``extent`` (one row: min_x, ... max_z) the head has the envelope.
    """
    spark = made.sparkSession
    spaces = {"core": CORE[version], "gml": GML[version], "xAL": XAL[version], "xlink": XLINK, "app": f"http://www.opengis.net/citygml/appearance/{version}"} | {p: f"http://www.opengis.net/citygml/{m}/{version}" for p, (m, _) in MODULES.items()}
    head = f'<?xml version="1.0" encoding="UTF-8"?><core:CityModel {" ".join(f'xmlns:{k}="{v}"' for k, v in spaces.items())}>'
    first = spark.createDataFrame([(0, "", head), (3, "", "</core:CityModel>")], "part int, key string, value string")
    rows = first.unionByName(made.select(F.lit(2).alias("part"), F.col("feature_id").cast("string").alias("key"), F.col("xml").alias("value")))
    if extent is not None:
        corner = lambda tag, side: element(tag, F.concat_ws(" ", *[F.col(f"{side}_{k}").cast("string") for k in "xyz"]))
        box = element("gml:boundedBy", element("gml:Envelope", corner("gml:lowerCorner", "min"), corner("gml:upperCorner", "max"), attributes={"srsName": F.lit(srs).cast("string"), "srsDimension": F.lit(3)}))
        rows = rows.unionByName(extent.filter(F.col("min_x").isNotNull()).select(F.lit(1).alias("part"), F.lit("").alias("key"), box.alias("value")))
    rows.orderBy("part", "key").select("value").write.mode("errorifexists").text(path)


def write_buildings(polygons: DataFrame, path: str, version: str = "2.0", srs: str = "EPSG:25832", lod: int = 2) -> None:
    """Writes buildings that are polygons alone (feature_id, polygon, ring, is_interior, points), with the envelope of all."""
    whole = polygons.dropna(subset=["feature_id", "points"]).withColumn("feature_id", F.col("feature_id").cast("string")).withColumn("lod", F.lit(lod))
    kind = F.lit("Building")
    inside = surfaces(whole, version).select("feature_id", F.lit(9).alias("place"), F.lit("").alias("key"), level_property(kind, F.col("lod"), F.col("xml"), version).alias("xml"))
    features = whole.select("feature_id", kind.alias("feature_type"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("timestamp").alias("creation_date")).distinct()
    extent = whole.select(F.explode("points").alias("p")).agg(*[f(f"p.{k}").alias(f"{n}_{k}") for n, f in (("min", F.min), ("max", F.max)) for k in "xyz"])
    write_city(members(features, inside, version), path, version, srs, extent)
