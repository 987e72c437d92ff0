"""Names of coordinate reference systems as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: National names and their codes, with a height code after the plus where one is given.
NATIONAL = {
    "urn:adv:crs:ETRS89_UTM32*DE_DHHN92_NH": "EPSG:25832+5783",
    "urn:adv:crs:ETRS89_UTM33*DE_DHHN92_NH": "EPSG:25833+5783",
    "urn:adv:crs:ETRS89_UTM31*DE_DHHN92_NH": "EPSG:25831+5783",
    "urn:adv:crs:ETRS89_UTM32*DE_DHHN2016_NH": "EPSG:25832",
    "urn:adv:crs:ETRS89_UTM33*DE_DHHN2016_NH": "EPSG:25833",
    "urn:adv:crs:ETRS89_UTM32": "EPSG:25832",
    "urn:adv:crs:ETRS89_UTM33": "EPSG:25833",
    "urn:adv:crs:ETRS89_UTM31": "EPSG:25831",
    "urn:adv:crs:DE_DHDN_3GK2*DE_DHN92_NH": "EPSG:31466+5783",
    "urn:adv:crs:DE_DHDN_3GK3*DE_DHN92_NH": "EPSG:31467+5783",
    "urn:adv:crs:DE_DHDN_3GK4*DE_DHN92_NH": "EPSG:31468+5783",
    "urn:adv:crs:DE_DHDN_3GK5*DE_DHN92_NH": "EPSG:31469+5783",
}
#: Height codes of national names whose code above has none.
HEIGHTS = {
    "urn:adv:crs:ETRS89_UTM32*DE_DHHN2016_NH": "7837",
    "urn:adv:crs:ETRS89_UTM33*DE_DHHN2016_NH": "7837",
}
UNKNOWN = "Unknown CRS"


def epsg_codes(name: Column) -> Column:
    """The EPSG codes that a name mentions, in order: per mention the last run of three to six digits.

    Where no mention holds one, a run that follows ``epsg`` within twelve other characters counts.
    """
    mentions = F.regexp_extract_all(name, F.lit(r"(?i)(epsg[^,\s]*)"), F.lit(1))
    runs = F.transform(mentions, lambda m: F.try_element_at(F.regexp_extract_all(m, F.lit(r"(?<![0-9])([0-9]{3,6})(?![0-9])"), F.lit(1)), F.lit(-1)))
    near = F.filter(runs, lambda c: c.isNotNull())
    far = F.regexp_extract_all(name, F.lit(r"(?i)epsg[^0-9]{0,12}([0-9]{3,6})"), F.lit(1))
    return F.when(F.size(near) > 0, near).otherwise(far)


def _named(name: Column, values: dict[str, str]) -> Column:
    """Value of the first key that ``name`` is, or else that it contains in any case; null if there is none."""
    low = F.lower(name)
    whole = [F.when(name == key, value) for key, value in values.items()]
    part = [F.when(F.contains(low, F.lit(key.lower())), value) for key, value in values.items()]
    return F.coalesce(*whole, *part)


def normal_crs(name: Column) -> Column:
    """``EPSG:h`` or ``EPSG:h+v`` of any way to name a system; 'Unknown CRS' for null, blank or unknown names."""
    text = F.trim(name)
    codes = epsg_codes(text)
    mentioned = F.when(F.size(codes) >= 2, F.concat(F.lit("EPSG:"), codes[0], F.lit("+"), codes[1])).when(F.size(codes) == 1, F.concat(F.lit("EPSG:"), codes[0]))
    return F.coalesce(_named(text, NATIONAL), mentioned, F.lit(UNKNOWN))


def height_code(name: Column) -> Column:
    """EPSG code of the height system in a name, '' if there is none."""
    text = F.trim(name)
    codes = epsg_codes(text)
    national = F.regexp_extract(_named(text, NATIONAL), r"\+(\d+)$", 1)
    return F.coalesce(_named(text, HEIGHTS), national, F.when(F.size(codes) >= 2, codes[1]), F.lit(""))


def epsg_number(name: Column) -> Column:
    """The number after ``EPSG:`` or ``EPSG::``, null if there is none."""
    return F.nullif(F.regexp_extract(name, r"(?i)EPSG:+([0-9]{1,9})", 1), F.lit("")).cast("int")


def latitude_first(name: Column) -> Column:
    """Whether coordinates come as latitude, longitude: only for http names that end in EPSG/.../4326 and plain epsg:4326."""
    return F.coalesce((F.lower(F.trim(name)) == "epsg:4326") | F.lower(name).rlike(r"^https?://.*/epsg/.*/4326$"), F.lit(False))


def same_crs(a: Column, b: Column) -> Column:
    """Whether two names denote the same known system."""
    x, y = normal_crs(a), normal_crs(b)
    return (x == y) & (x != UNKNOWN)


def known_3d(code: Column) -> Column:
    """The three-dimensional twin of a geographic system, other codes unchanged."""
    return F.when(code == 4326, 4979).when(code == 4258, 4937).otherwise(code)


def envelope_srs(horizontal: Column, vertical: Column, has_height: Column) -> Column:
    """Struct (name, dimension) for an envelope: compound with a height code, else the horizontal system with 3 or 2 axes."""
    urn = F.concat(F.lit("urn:ogc:def:crs:EPSG::"), horizontal.cast("string"))
    compound = F.concat(F.lit("urn:ogc:def:crs,crs:EPSG::"), horizontal.cast("string"), F.lit(",crs:EPSG::"), vertical.cast("string"))
    return F.struct(F.when(vertical.isNotNull(), compound).otherwise(urn).alias("name"), F.when(vertical.isNotNull() | has_height, 3).otherwise(2).alias("dimension"))
