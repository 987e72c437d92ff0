"""Deleting and ending features with all that goes with them.

Sets of ids are computed first, by joins on the frontier of what is new; each table is then filtered once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.operators.relations import reached
from urbanloom.session import cut


def _contains(prop: DataFrame) -> DataFrame:
    return prop.filter(F.col("val_relation_type") == 1).select(F.col("feature_id").alias("p"), F.col("val_feature_id").alias("c")).dropna().distinct()


def _without(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``df`` without the rows whose ``column`` is in ``ids`` (node)."""
    return df.join(ids.select(F.col("node").alias(column)), column, "left_anti").select(*df.columns)


def _only(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    return df.join(ids.select(F.col("node").alias(column)), column, "left_semi").select(*df.columns)


def _ids(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("node")).dropna().distinct()


def deletable(contains: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes that go with ``start`` (node): all it contains, but what something that stays contains as well.

    contains: links (p, c). A group of nodes that only contain each other goes when all that leads to it goes.
    """
    contains = cut(contains.select("p", "c").dropna().distinct())
    first = cut(_ids(start, "node"))
    all_ = cut(reached(contains, first))
    inner = cut(_without(all_, "node", first))
    held = _without(_only(contains, "c", inner), "p", all_).select(F.col("c").alias("node"))
    stays = reached(_only(_only(contains, "p", inner), "c", inner), held)
    return cut(_without(all_, "node", stays))


def property_rows(prop: DataFrame, owners: DataFrame, referred: DataFrame) -> DataFrame:
    """Ids (node) of the properties that go: those of ``owners``, those that refer to ``referred``, and what hangs below them.

    A property that refers takes along the one it hangs under if that bears the same name and namespace, and so on upwards.
    """
    up = prop.select(F.col("id").alias("p"), "parent_id", "name", "namespace_id")
    of = up.select(F.col("p").alias("parent_id"), F.col("name").alias("n"), F.col("namespace_id").alias("s"))
    same = up.filter(F.col("parent_id").isNotNull()).join(of, "parent_id").filter((F.col("name") == F.col("n")) & (F.col("namespace_id") == F.col("s"))).select("p", F.col("parent_id").alias("c"))
    refers = reached(same, _ids(_only(prop, "val_feature_id", referred), "id"))
    hit = _ids(_only(prop, "feature_id", owners), "id").unionAll(refers)
    return cut(reached(prop.select(F.col("parent_id").alias("p"), F.col("id").alias("c")), hit))


def delete_tex_images(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the images ``ids`` (node)."""
    return tables | {"tex_image": _without(tables["tex_image"], "id", ids)}


def delete_surface_data(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the surface data ``ids``, and without the images that only these showed."""
    data = tables["surface_data"]
    left = _without(data, "id", ids)
    images = _without(_ids(_only(data, "id", ids), "tex_image_id"), "node", _ids(left, "tex_image_id"))
    return delete_tex_images(tables | {"surface_data": left}, images)


def delete_appearances(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the appearances ``ids``, and without the surface data that only these used."""
    links = tables["appear_to_surface_data"]
    left = _without(links, "appearance_id", ids)
    data = _without(_ids(_only(links, "appearance_id", ids), "surface_data_id"), "node", _ids(left, "surface_data_id"))
    return delete_surface_data(tables | {"appear_to_surface_data": left, "appearance": _without(tables["appearance"], "id", ids)}, data)


def delete_geometries(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the geometries ``ids``."""
    return tables | {"geometry_data": _without(tables["geometry_data"], "id", ids)}


def delete_implicit_geometries(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the templates ``ids``, and without their appearances and their own geometry."""
    templates = tables["implicit_geometry"]
    looks = _ids(_only(tables["appearance"], "implicit_geometry_id", ids), "id")
    shapes = _ids(_only(templates, "id", ids), "relative_geometry_id")
    return delete_geometries(delete_appearances(tables | {"implicit_geometry": _without(templates, "id", ids)}, looks), shapes)


def delete_addresses(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the addresses ``ids``."""
    return tables | {"address": _without(tables["address"], "id", ids)}


def delete_properties(tables: dict[str, DataFrame], rows: DataFrame) -> dict[str, DataFrame]:
    """The tables without the properties ``rows`` (node) and what only they referred to.

    Addresses and templates that other properties refer to stay; geometries and appearances belong to one property.
    Tables and columns that aren't there are passed over.
    """
    prop = tables["property"]
    lost, left = cut(_only(prop, "id", rows)), _without(prop, "id", rows)
    out = tables | {"property": left}
    for column, name, shared, delete in (
        ("val_address_id", "address", True, delete_addresses), ("val_geometry_id", "geometry_data", False, delete_geometries),
        ("val_implicitgeom_id", "implicit_geometry", True, delete_implicit_geometries), ("val_appearance_id", "appearance", False, delete_appearances),
    ):
        if name in tables and column in prop.columns:
            ids = _ids(lost, column)
            out = delete(out, cut(_without(ids, "node", _ids(left, column)) if shared else ids))
    return out


def delete_features(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables (by name: feature, property, and where there are any address, geometry_data, ...) without the features ``ids``.

    Contained features go unless something that stays contains them; their properties go, and so do properties that refer
    to a feature that went, with all below them and all that only these referred to. What belongs to a feature that went by
    ``feature_id`` alone (geometries, appearances) stays without it.
    """
    gone = deletable(_contains(tables["property"]), ids)
    out = delete_properties(tables, property_rows(tables["property"], gone, gone))
    out |= {"feature": _without(tables["feature"], "id", gone)}
    for name in ("geometry_data", "appearance"):
        if name in out and "feature_id" in out[name].columns:
            held = out[name].join(gone.select(F.col("node").alias("feature_id"), F.lit(True).alias("__gone")), "feature_id", "left")
            out[name] = held.withColumn("feature_id", F.when(F.col("__gone").isNull(), F.col("feature_id"))).select(*out[name].columns)
    return out


def ending(feature: DataFrame, prop: DataFrame, ids: DataFrame) -> DataFrame:
    """Features (node) that end with ``ids``: step by step, what they contain, once nothing live contains it any more."""
    contains = cut(_contains(prop))
    live = cut(_ids(feature.filter(F.col("termination_date").isNull()), "id"))
    there = cut(_ids(feature, "id"))
    ended = frontier = cut(_only(_ids(ids, "node"), "node", there))
    while True:
        below = _without(_only(contains, "p", frontier).select(F.col("c").alias("node")).distinct(), "node", ended)
        holders = _without(_only(_only(contains, "c", below), "p", live), "p", ended)
        frontier = cut(_only(_without(below, "node", holders.select(F.col("c").alias("node"))), "node", there))
        if frontier.isEmpty():
            return ended
        ended = cut(ended.unionAll(frontier))


def terminate_features(feature: DataFrame, prop: DataFrame, ids: DataFrame, at: Column, by: str, cascade: bool = True, reason: str | None = None) -> DataFrame:
    """``feature`` with the features ``ids`` ended at ``at``, and with cascade what ends with them; see ``ending``.

    What is ended already stays as it is. The end is also the last modification, if there is such a column; reason replaces
    the reason for the update.
    """
    gone = ending(feature, prop, ids) if cascade else _ids(ids, "node")
    marked = feature.join(gone.select(F.col("node").alias("id"), F.lit(True).alias("__gone")), "id", "left")
    now = F.col("__gone") & F.col("termination_date").isNull()
    new = {"updating_person": F.lit(by), "last_modification_date": at, **({"reason_for_update": F.lit(reason)} if reason else {}), "termination_date": at}
    return marked.select(*[F.when(now, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in feature.columns])
