"""Problem 3: members whose fields change from file to file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from urbanloom.operators.drift import field_changes, unified_members, unified_table
from urbanloom.session import cut, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change of a file against the file before it in its series."""
    return field_changes(table(spark, sf_dir, "city_object_member"), table(spark, sf_dir, "delivery_file"))


def p3_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All members with one name per field: file, place, gml_id, field, JSON type and value."""
    members, files = table(spark, sf_dir, "city_object_member"), table(spark, sf_dir, "delivery_file")
    return unified_members(members, files, cut(field_changes(members, files)))


def _unified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    members, files = table(spark, sf_dir, "city_object_member"), table(spark, sf_dir, "delivery_file")
    return unified_table(members, files, cut(field_changes(members, files)))


def p3_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All members in one table with a column for each field under its first name, in one type; unreadable ones are marked."""
    return _unified(spark, sf_dir)[0]


def p3_misfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that don't fit the type of their column in ``p3_table``."""
    return _unified(spark, sf_dir)[1]


QUERIES = {"p3_found": p3_found, "p3_members": p3_members, "p3_table": p3_table, "p3_misfits": p3_misfits}

_READABLE = """SELECT m.file_id, m.pos, m.member_id, t.key AS top, t.value AS inner_value FROM (SELECT * FROM city_object_member WHERE json_valid(body) AND json_type(body) = 'OBJECT') m,
LATERAL (SELECT key, value FROM json_each(m.body)) t WHERE json_type(t.value) = 'OBJECT'"""
SQL: dict[str, str] = {
    "p3_found": f"""WITH r AS ({_READABLE}),
f AS (SELECT file_id, lag(file_id) OVER (PARTITION BY series_code ORDER BY delivery_no, file_id) AS prev FROM delivery_file),
v AS (SELECT r.file_id, r.pos, r.inner_value ->> '$.gml_id' AS gml_id, k.key AS field, k.value ->> '$' AS txt,
 CASE k.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind
 FROM r, LATERAL (SELECT key, value, type FROM json_each(r.inner_value)) k),
n AS (SELECT file_id, field, kind, count(*) AS n FROM v GROUP BY ALL),
p AS (SELECT file_id, field, kind FROM (SELECT *, row_number() OVER (PARTITION BY file_id, field ORDER BY kind IS NULL, n DESC, kind) AS rank FROM n) WHERE rank = 1),
b AS (SELECT f.file_id, f.prev, x.field FROM f JOIN p x ON x.file_id IN (f.file_id, f.prev) WHERE f.prev IS NOT NULL GROUP BY ALL),
s AS (SELECT b.*, y.kind AS new_kind, y.field IS NOT NULL AS is_new, z.kind AS old_kind, z.field IS NOT NULL AS is_old FROM b LEFT JOIN p y ON y.file_id = b.file_id AND y.field = b.field LEFT JOIN p z ON z.file_id = b.prev AND z.field = b.field),
g AS (SELECT * FROM s WHERE NOT is_new), w AS (SELECT * FROM s WHERE NOT is_old),
u AS (SELECT file_id, gml_id, field, arg_min(txt, pos) AS txt FROM v WHERE kind IS NOT NULL AND gml_id IS NOT NULL GROUP BY ALL),
c AS (SELECT g.file_id, g.field AS old_field, w.field AS new_field, any_value(g.old_kind) AS old_kind, any_value(w.new_kind) AS new_kind, count(*) AS n, count(*) FILTER (a.txt = d.txt) AS agree
 FROM g JOIN w ON w.file_id = g.file_id JOIN u a ON a.file_id = g.prev AND a.field = g.field JOIN u d ON d.file_id = g.file_id AND d.field = w.field AND d.gml_id = a.gml_id GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY file_id, old_field ORDER BY agree / n DESC) AS k, row_number() OVER (PARTITION BY file_id, new_field ORDER BY agree / n DESC) AS j FROM c WHERE 2 * agree > n),
renamed AS (SELECT * FROM h WHERE k = 1 AND j = 1),
t AS (SELECT DISTINCT file_id, top FROM r),
tg AS (SELECT f.file_id, t.top FROM f JOIN t ON t.file_id = f.prev WHERE (f.file_id, t.top) NOT IN (SELECT file_id, top FROM t)),
tw AS (SELECT f.file_id, t.top FROM f JOIN t ON t.file_id = f.file_id WHERE f.prev IS NOT NULL AND (f.prev, t.top) NOT IN (SELECT file_id, top FROM t))
SELECT file_id, 'renamed' AS change_kind, old_field, new_field FROM renamed
UNION ALL SELECT file_id, 'removed', field, '' FROM g WHERE (file_id, field) NOT IN (SELECT file_id, old_field FROM renamed)
UNION ALL SELECT file_id, 'added', '', field FROM w WHERE (file_id, field) NOT IN (SELECT file_id, new_field FROM renamed)
UNION ALL SELECT file_id, 'type_changed', field, field FROM s WHERE is_new AND is_old AND old_kind <> new_kind
UNION ALL SELECT file_id, 'type_changed', new_field, new_field FROM renamed WHERE old_kind <> new_kind
UNION ALL SELECT coalesce(tg.file_id, tw.file_id), CASE WHEN tg.top IS NULL THEN 'added' WHEN tw.top IS NULL THEN 'removed' ELSE 'renamed' END, coalesce(tg.top, ''), coalesce(tw.top, '') FROM tg FULL JOIN tw ON tg.file_id = tw.file_id""",
}
