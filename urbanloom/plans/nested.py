"""Problem 4: nested feature records as flat feature and property tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.operators.shred import containment, entities, entity_table, owned_scalars, shred
from urbanloom.session import cut, table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each object with an id and the objects with an id directly inside it."""
    nodes = shred(table(spark, sf_dir, "feature_record"), "record_id", "body", scalars=["id"])
    return containment(cut(entities(nodes)))


def p4_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat properties: one row per feature, path and value, however often the record was delivered, with the path and place around it."""
    kind = F.col("kind")
    nodes = cut(shred(table(spark, sf_dir, "feature_record"), "record_id", "body"))
    return (
        owned_scalars(nodes)
        .filter(F.col("path") != "id")
        .select(
            "feature_id", F.col("path").alias("name"), F.regexp_replace("path", r"(^|\.)[^.\[]*$|\[\d+\]$", "").alias("parent_name"), "ordinal", F.when(kind == "string", F.col("scalar")).alias("val_string"),
            F.when(kind == "number", F.expr("try_cast(scalar as double)")).alias("val_double"), F.when(kind == "boolean", F.expr("try_cast(scalar as boolean)")).alias("val_boolean"),
        )
        .distinct()
    )


def p4_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat features: one row per feature with a column for each of its values, as last delivered."""
    records = table(spark, sf_dir, "feature_record")
    nodes = cut(shred(records, "record_id", "body"))
    when = records.groupBy("record_id").agg(F.max("received_at").alias("received_at"))
    told = owned_scalars(nodes).join(when, "record_id").withColumn("order", F.struct("received_at", "record_id"))
    return entity_table(cut(told.select("feature_id", "path", "scalar", "order")), "order")


QUERIES = {"p4_found": p4_found, "p4_properties": p4_properties, "p4_features": p4_features}
SQL: dict[str, str] = {
    # a string that is the JSON text of an object or array is opened on the way; own is the id of the nearest object with one
    "p4_found": r"""WITH RECURSIVE o AS (SELECT DISTINCT body FROM feature_record WHERE json_valid(body)),
r(v, own) AS (SELECT CAST(body AS JSON), CAST(NULL AS VARCHAR) FROM o WHERE json_type(body) IN ('OBJECT', 'ARRAY')
 UNION ALL SELECT CASE WHEN json_type(k.value) = 'VARCHAR' THEN CAST(k.value ->> '$' AS JSON) ELSE k.value END,
  CASE WHEN json_type(r.v) = 'OBJECT' AND json_exists(r.v, '$.id') THEN r.v ->> '$.id' ELSE r.own END
 FROM r, LATERAL (SELECT value FROM json_each(r.v)) k
 WHERE json_type(k.value) IN ('OBJECT', 'ARRAY') OR (json_type(k.value) = 'VARCHAR' AND regexp_matches(k.value ->> '$', '^\s*[{\[]') AND json_valid(k.value ->> '$')))
SELECT DISTINCT feature_id, val_feature_id FROM (SELECT TRY_CAST(own AS BIGINT) AS feature_id, TRY_CAST(v ->> '$.id' AS BIGINT) AS val_feature_id FROM r WHERE json_type(v) = 'OBJECT' AND json_exists(v, '$.id'))
WHERE feature_id IS NOT NULL AND val_feature_id IS NOT NULL""",
    "p4_properties": r"""WITH RECURSIVE o AS (SELECT DISTINCT body FROM feature_record WHERE json_valid(body)),
r(v, own, path) AS (SELECT CAST(body AS JSON), CAST(NULL AS VARCHAR), '' FROM o WHERE json_type(body) IN ('OBJECT', 'ARRAY')
 UNION ALL SELECT CASE WHEN json_type(k.value) = 'VARCHAR' THEN CAST(k.value ->> '$' AS JSON) ELSE k.value END,
  CASE WHEN json_type(r.v) = 'OBJECT' AND json_exists(r.v, '$.id') THEN r.v ->> '$.id' ELSE r.own END,
  CASE WHEN json_type(r.v) = 'ARRAY' THEN r.path || '[' || k.key || ']' WHEN r.path = '' OR json_exists(r.v, '$.id') THEN k.key ELSE r.path || '.' || k.key END
 FROM r, LATERAL (SELECT key, value FROM json_each(r.v)) k
 WHERE json_type(k.value) IN ('OBJECT', 'ARRAY') OR (json_type(k.value) = 'VARCHAR' AND regexp_matches(k.value ->> '$', '^\s*[{\[]') AND json_valid(k.value ->> '$'))),
s AS (SELECT CASE WHEN json_type(r.v) = 'OBJECT' AND json_exists(r.v, '$.id') THEN r.v ->> '$.id' ELSE r.own END AS own, json_type(k.value) AS kind, k.value ->> '$' AS txt,
  CASE WHEN json_type(r.v) = 'ARRAY' THEN r.path || '[' || k.key || ']' WHEN r.path = '' OR json_exists(r.v, '$.id') THEN k.key ELSE r.path || '.' || k.key END AS name,
  CAST(CASE WHEN json_type(r.v) = 'ARRAY' THEN CAST(k.key AS INTEGER) ELSE list_position(json_keys(r.v), k.key) - 1 END AS INTEGER) AS ordinal
 FROM r, LATERAL (SELECT key, value FROM json_each(r.v)) k
 WHERE json_type(k.value) NOT IN ('OBJECT', 'ARRAY') AND NOT (json_type(k.value) = 'VARCHAR' AND regexp_matches(k.value ->> '$', '^\s*[{\[]') AND json_valid(k.value ->> '$')))
SELECT DISTINCT TRY_CAST(own AS BIGINT) AS feature_id, name, regexp_replace(name, '(^|\.)[^.\[]*$|\[\d+\]$', '') AS parent_name, ordinal, CASE WHEN kind = 'VARCHAR' THEN txt END AS val_string,
 CASE WHEN kind NOT IN ('VARCHAR', 'BOOLEAN', 'NULL') THEN TRY_CAST(txt AS DOUBLE) END AS val_double, CASE WHEN kind = 'BOOLEAN' THEN txt = 'true' END AS val_boolean
FROM s WHERE TRY_CAST(own AS BIGINT) IS NOT NULL AND name <> 'id'""",
}
