"""Schemas of city tables as databases of the catalog: making, listing, choosing, emptying and dropping them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that hold data, with their columns, and tables of metadata, which emptying leaves as they are.
POINTS = "array<struct<x:double,y:double,z:double>>"
DATA_TABLES = {
    "feature": f"id long, objectclass_id int, objectid string, envelope {POINTS}, last_modification_date timestamp, updating_person string, reason_for_update string, lineage string, creation_date timestamp, termination_date timestamp, valid_from timestamp, valid_to timestamp",
    "property": "id long, feature_id long, parent_id long, datatype_id int, namespace_id int, name string, val_int long, val_double double, val_string string, val_timestamp timestamp, val_uri string, val_codespace string, val_uom string, val_lod string, val_geometry_id long, val_implicitgeom_id long, val_appearance_id long, val_address_id long, val_feature_id long, val_relation_type int",
    "address": "id long, objectid string, street string, house_number string, po_box string, zip_code string, city string, state string, country string",
    "geometry_data": f"id long, geometry {POINTS}, feature_id long", "implicit_geometry": "id long, objectid string, mime_type string, relative_geometry_id long", "appearance": "id long, objectid string, theme string, feature_id long, implicit_geometry_id long",
    "appear_to_surface_data": "id long, surface_data_id long, appearance_id long", "surface_data": "id long, objectid string, objectclass_id int, tex_image_id long", "tex_image": "id long, image_uri string, mime_type string",
    "feature_changelog": "id long, feature_id long, objectclass_id int, objectid string, transaction_type string, transaction_date timestamp, db_user string, reason_for_update string",
}
METADATA_TABLES = {
    "objectclass": "id int, superclass_id int, classname string, is_abstract int, is_toplevel int", "datatype": "id int, supertype_id int, typename string", "namespace": "id int, alias string, namespace string",
    "database_srs": "srid int, srs_name string", "codelist": "id long, codelist_type string, url string, mime_type string", "codelist_entry": "id long, codelist_id long, code string, definition string", "ade": "id int, name string",
}


def create_schema(spark: SparkSession, name: str, srid: int, srs_name: str) -> None:
    """A database with all tables, empty but for its reference system. It must not exist."""
    spark.sql(f"CREATE DATABASE `{name}`")
    for table, columns in (DATA_TABLES | METADATA_TABLES).items():
        spark.createDataFrame([], columns).write.format("parquet").saveAsTable(f"`{name}`.`{table}`")
    spark.createDataFrame([(srid, srs_name)], METADATA_TABLES["database_srs"]).write.insertInto(f"`{name}`.`database_srs`")


def drop_schema(spark: SparkSession, name: str) -> None:
    """Drops a database with all its tables, if it exists."""
    spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")


def schema_exists(spark: SparkSession, name: str) -> bool:
    """Whether there is a database with the tables of a city schema."""
    return spark.catalog.databaseExists(name) and spark.catalog.tableExists(f"{name}.database_srs")


def current_schema(spark: SparkSession) -> str:
    """The database that table names without one mean."""
    return spark.catalog.currentDatabase()


def set_current_schema(spark: SparkSession, name: str) -> None:
    """Makes table names without a database mean those of ``name``."""
    spark.catalog.setCurrentDatabase(name)


def list_schemas(spark: SparkSession) -> DataFrame:
    """(schema_name, srid, srs_name, has_changelog) of all city schemas, in order of their names."""
    rows = []
    for name in sorted(d.name for d in spark.catalog.listDatabases()):
        if schema_exists(spark, name):
            srs = spark.table(f"`{name}`.database_srs").select("srid", "srs_name").first()
            rows.append((name, srs and srs["srid"], srs and srs["srs_name"], spark.catalog.tableExists(f"{name}.feature_changelog")))
    return spark.createDataFrame(rows, "schema_name string, srid int, srs_name string, has_changelog boolean")


def cleanup_schema(spark: SparkSession, name: str) -> None:
    """Empties the tables of data; tables of metadata stay as they are."""
    for table in DATA_TABLES:
        if spark.catalog.tableExists(f"{name}.{table}"):
            spark.sql(f"TRUNCATE TABLE `{name}`.`{table}`")


def next_ids(spark: SparkSession, name: str, table: str, count: int) -> DataFrame:
    """(id): ``count`` ids above the largest one of a table."""
    top = spark.table(f"`{name}`.`{table}`").agg(F.max("id")).first()[0] or 0
    return spark.range(top + 1, top + 1 + count)


def change_schema_srid(spark: SparkSession, name: str, srid: int, srs_name: str, transform: bool = True) -> None:
    """Changes the reference system of a schema; with ``transform`` all columns of points are computed anew, table by table."""
    from urbanloom.functions.projection import change_srid

    old = spark.table(f"`{name}`.database_srs").first()["srid"]
    for table, columns in DATA_TABLES.items():
        found = [c.split(" ")[0] for c in columns.split(", ") if c.endswith(POINTS)]
        if transform and found:
            df = spark.table(f"`{name}`.`{table}`")
            for column in found:
                df = change_srid(df, column, old, srid).drop("srid")
            df.write.mode("overwrite").saveAsTable(f"`{name}`.`{table}__new`")
            spark.sql(f"DROP TABLE `{name}`.`{table}`")
            spark.sql(f"ALTER TABLE `{name}`.`{table}__new` RENAME TO `{name}`.`{table}`")
    spark.createDataFrame([(srid, srs_name)], METADATA_TABLES["database_srs"]).write.insertInto(f"`{name}`.`database_srs`", overwrite=True)
