"""Identifiers, names, codes and attribute texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_name(tag: Column) -> Column:
    """A tag without its ``{namespace}``."""
    return F.regexp_replace(tag, r"^\{[^}]*\}", "")


def reference_id(href: Column) -> Column:
    """The id that a reference names: the part behind ``#``; of web addresses without one, ''; null gives ''."""
    text = F.coalesce(F.trim(href), F.lit(""))
    behind = F.regexp_extract(text, "#(.*)$", 1)
    return F.when(text.contains("#"), behind).when(F.lower(text).rlike("^https?://"), "").otherwise(text)


def plain_id(text: Column) -> Column:
    """Trimmed, without one leading ``#``; null gives ''."""
    return F.regexp_replace(F.coalesce(F.trim(text), F.lit("")), "^#", "")


def xs_id(text: Column, prefix: str = "ID") -> Column:
    """A valid XML id: one ``#`` off, other characters than letters, digits, ``_`` and ``-`` become ``_``, a start that isn't a letter or ``_`` gets the prefix.

    Blank and null give the prefix and a hash of the text, not a random value: the same row gives the same id each time.
    """
    clean = F.regexp_replace(plain_id(text), "[^A-Za-z0-9_-]", "_")
    safe = F.when(clean.rlike("^[A-Za-z_]"), clean).otherwise(F.concat(F.lit(f"{prefix}_"), clean))
    return F.when(clean == "", F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 12))).otherwise(safe)


def material_name(name: Column) -> Column:
    """A name without characters that files can't have, 63 characters at most; blank gives ``Material``."""
    clean = F.substring(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r'[<>:"/\\|?*]', "_"), 1, 63)
    return F.when(clean == "", "Material").otherwise(clean)


def is_ifc_guid(text: Column) -> Column:
    """Whether a text is a 22-character IFC id."""
    return F.coalesce(text.rlike("^[0-9A-Za-z_$]{22}$"), F.lit(False))


def ifc_uri(guid: Column) -> Column:
    """The address of an IFC id."""
    return F.concat(F.lit("ifc://guid/"), guid)


def ifc_guid(uri: Column) -> Column:
    """The IFC id in an address (``ifc://guid/X``, ``ifc:guid:X``) or alone, else null."""
    found = F.regexp_extract(F.trim(uri), r"^(?:ifc://guid/|ifc:guid:)?([0-9A-Za-z_$]{22})$", 1)
    return F.nullif(found, F.lit(""))


def truth(text: Column) -> Column:
    """true and 1, false and 0, in any case and with blanks; else null."""
    word = F.lower(F.trim(text))
    return F.when(word.isin("true", "1"), True).when(word.isin("false", "0"), False)


def lod(text: Column) -> Column:
    """0 to 4 of ``lodN`` or ``N``, else null."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(text)), "^(?:lod)?([0-4])$", 1), F.lit("")).cast("int")


def measure(text: Column, uom: Column) -> Column:
    """Struct (value, raw, uom): the number if it is one, the text, and the unit, metres by default."""
    number = F.when(F.trim(text).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"), F.trim(text)).cast("double")
    return F.struct(number.alias("value"), text.alias("raw"), F.coalesce(F.nullif(F.trim(uom), F.lit("")), F.lit("m")).alias("uom"))


def surface_type(label: Column) -> Column:
    """Type of surface in a label: blank gives Unknown, an ending Roof-, Wall- or GroundSurface counts, others stay."""
    found = F.regexp_extract(label, "(RoofSurface|WallSurface|GroundSurface)$", 1)
    return F.when(F.coalesce(F.trim(label), F.lit("")) == "", "Unknown").when(found != "", found).otherwise(label)


def clamped(text: Column) -> Column:
    """A number between 0 and 1 as text; 0 for what is no number."""
    number = F.when(F.trim(text).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), F.trim(text)).cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.0)))).cast("string")


def text_chunks(text: Column, size: int) -> Column:
    """``text`` in pieces of ``size`` characters; none for null and empty texts."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def typed_entry(name: Column, value: Column, kind: Column) -> Column:
    """Struct (name, kind, value): an attribute whose text doesn't fit its kind becomes a string."""
    fits = F.when(kind == "int", value.rlike("^[+-]?[0-9]{1,18}$")).when(kind == "double", value.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$")).when(kind == "date", value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")).otherwise(True)
    return F.struct(name.alias("name"), F.when(fits, kind).otherwise("string").alias("kind"), value.alias("value"))


def date_text(value: Column, kind: str) -> Column:
    """ISO text as a date (its first ten characters) or a date-time (midnight where it has no time); null stays."""
    if kind == "date":
        return F.substring(value, 1, 10)
    return F.when(F.length(value) == 10, F.concat(value, F.lit("T00:00:00"))).otherwise(value)


def xs_datetime(value: Column) -> Column:
    """ISO text to the second: with an offset as UTC and ``Z``, without one as it is; '' for what is no date-time."""
    text = F.trim(value)
    shape = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?(Z|[+-][0-9]{2}:[0-9]{2})?$")
    moment = F.try_to_timestamp(F.when(shape, F.regexp_replace(text, " ", "T")))
    shown = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(moment.isNull(), "").when(text.rlike("(Z|[+-][0-9]{2}:[0-9]{2})$") & (F.length(text) > 10), F.concat(shown, F.lit("Z"))).otherwise(shown)


def resolved_path(file: Column, uri: Column) -> Column:
    """Where ``uri`` leads from a file: web and absolute addresses as they are, others beside the file; null for blank ones."""
    text = F.nullif(F.replace(F.trim(uri), F.lit("\\"), F.lit("/")), F.lit(""))
    own = F.regexp_replace(text, "^(\\./)+", "")
    return F.when(text.rlike("^([A-Za-z][A-Za-z0-9+.-]*:|/)"), text).otherwise(F.concat(F.regexp_replace(file, "[^/]*$", ""), own))


def in_schema_order(children: Column, order: list[str]) -> Column:
    """Names of children in the order of a schema, unknown ones last; equal ones stay in their order."""
    places = F.create_map(*[v for k, n in enumerate(order) for v in (F.lit(n), F.lit(k))]) if order else F.create_map().cast("map<string,int>")
    keyed = F.transform(children, lambda c, i: F.struct(F.coalesce(F.try_element_at(places, c), F.lit(9999)).alias("p"), i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda x: x["c"])


def without_suffixes(ids: Column, suffixes: list[str]) -> Column:
    """An array of ids without blank ones and the endings ``suffixes``, each once, in order of their first place."""
    ending = "(" + "|".join(suffixes) + ")$"
    cut = F.transform(ids, lambda i: F.regexp_replace(F.trim(i), ending, ""))
    return F.array_distinct(F.filter(cut, lambda i: F.coalesce(i, F.lit("")) != ""))
