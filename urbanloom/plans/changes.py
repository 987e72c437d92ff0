"""Problems 5, 6 and 7: points of time, the change feed, and references to nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.functions.instants import MONTHS, ZONE_MINUTES, with_instant
from urbanloom.operators.change_feed import apply_changes, resolve_key
from urbanloom.operators.references import orphans
from urbanloom.session import small, table


def _feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "feed").select("feed_id", "db_user", "time_zone", "day_order")


def changelog_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature_changelog with ``utc_micros``, null where transaction_date denotes no point of time."""
    feeds = small(_feeds(spark, sf_dir).drop("feed_id").dropna(subset=["db_user"]).dropDuplicates(["db_user"]))
    rows = table(spark, sf_dir, "feature_changelog").join(feeds, "db_user", "left")
    return with_instant(rows, "transaction_date", "utc_micros", F.col("time_zone"), F.col("day_order"))


def member_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """city_object_member with ``utc_micros``, null where creation_date denotes no point of time."""
    feeds = _feeds(spark, sf_dir).drop("db_user").dropna(subset=["feed_id"]).dropDuplicates(["feed_id"])
    files = table(spark, sf_dir, "delivery_file").select("file_id", "feed_id").dropna().dropDuplicates(["file_id"]).join(small(feeds), "feed_id", "left")
    rows = table(spark, sf_dir, "city_object_member").select("member_id", "file_id", "creation_date").join(small(files), "file_id", "left")
    return with_instant(rows, "creation_date", "utc_micros", F.col("time_zone"), F.col("day_order"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each text that denotes a point of time. A row that occurs twice in full comes out once per occurrence's id."""
    members = member_instants(spark, sf_dir).select(F.lit("city_object_member").alias("src"), F.col("member_id").alias("row_id"), "utc_micros")
    changes = changelog_instants(spark, sf_dir).select(F.lit("feature_changelog").alias("src"), F.col("id").alias("row_id"), "utc_micros")
    return members.unionAll(changes).filter(F.col("utc_micros").isNotNull()).distinct()


def p6_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every feature that the change feed names: status, the change that took effect last, and its columns."""
    values = ["objectclass_id", "objectid", "db_user", "reason_for_update"]
    feed = changelog_instants(spark, sf_dir).select("id", "feature_id", "transaction_type", "utc_micros", *values)
    return apply_changes(resolve_key(feed, "feature_id", "objectid"), "feature_id", "utc_micros", "id", "transaction_type", values)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that are present and not terminated after all changes."""
    feed = changelog_instants(spark, sf_dir).select("id", "feature_id", "objectid", "transaction_type", "utc_micros")
    state = apply_changes(resolve_key(feed, "feature_id", "objectid"), "feature_id", "utc_micros", "id", "transaction_type")
    return state.filter(F.col("status") == "present").select("feature_id", F.col("last_id").alias("change_id"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of property and codelist_entry whose target doesn't exist, with the month of loading (null if that is unknown)."""
    period = F.date_format("loaded_at", "yyyy-MM").alias("period")
    prop = table(spark, sf_dir, "property").select(F.lit("property").alias("tab"), F.col("id").alias("row_id"), period, F.col("val_feature_id").alias("key"))
    entry = table(spark, sf_dir, "codelist_entry").select(F.lit("codelist_entry").alias("tab"), F.col("id").alias("row_id"), period, F.col("codelist_id").alias("key"))
    parents = table(spark, sf_dir, "feature").select(F.lit("property").alias("tab"), F.col("id").alias("key")).unionAll(
        table(spark, sf_dir, "codelist").select(F.lit("codelist_entry").alias("tab"), F.col("id").alias("key"))
    )
    return orphans(prop.unionAll(entry), parents)


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table and month of loading."""
    return p7_found(spark, sf_dir).groupBy("tab", "period").agg(F.count("*").alias("n_orphans"))


QUERIES = {"p5_found": p5_found, "p6_found": p6_found, "p6_state": p6_state, "p7_found": p7_found, "p7_report": p7_report}

_P7 = """
SELECT 'property' AS tab, p.id AS row_id, strftime(p.loaded_at, '%Y-%m') AS period FROM property p
WHERE p.val_feature_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM feature f WHERE f.id = p.val_feature_id)
UNION ALL
SELECT 'codelist_entry', e.id, strftime(e.loaded_at, '%Y-%m') FROM codelist_entry e
WHERE e.codelist_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM codelist c WHERE c.id = e.codelist_id)
"""

# The notations of the test tables, each rewritten as year|month|day|hour|minute|second|fraction|am or pm|zone|offset; a
# region in brackets stands behind an offset there, which decides.
_CLOCK = r"(\d{2}):(\d{2})(?::(\d{2}))?"
_NOTATIONS = [
    (r"^(\d{4})-(\d{2})-(\d{2})(?:[t ](\d{2}):(\d{2}):(\d{2})(?:[.,](\d+))?)?\s*([a-z]{1,4})?([+-]\d{2}(?::?\d{2})?)?(?:\[[^\]]+\])?$", r"\1|\2|\3|\4|\5|\6|\7||\8|\9"),
    (r"^(\d{4})(\d{2})(\d{2})(?:t(\d{2})(\d{2})(\d{2})(z)?)?$", r"\1|\2|\3|\4|\5|\6|||\7|"),
    (r"^[a-z]{3}, (\d{2}) ([a-z]+) (\d{4}) (\d{2}):(\d{2}):(\d{2}) ([+-]\d{4})$", r"\3|\2|\1|\4|\5|\6||||\7"),
    (rf"^(\d{{1,2}})\.? ([a-zäöü]+) (\d{{4}}),? {_CLOCK}(?: uhr)?$", r"\3|\2|\1|\4|\5|\6||||"),
    (rf"^([a-z]+) (\d{{1,2}}), (\d{{4}}) {_CLOCK}$", r"\3|\1|\2|\4|\5|\6||||"),
]
_NUMBERS = rf"^(\d{{2}})[./](\d{{2}})[./](\d{{4}})(?: {_CLOCK})?(?: ([ap])m)?(?: ([a-z]+))?$"
_WHEN = "\n".join(f"WHEN regexp_matches(t, '{p}') THEN regexp_replace(t, '{p}', '{r}')" for p, r in _NOTATIONS)
_MONTH = "CASE left(f[2], 3) " + " ".join(f"WHEN '{name}' THEN {n}" for name, n in MONTHS.items()) + " ELSE TRY_CAST(f[2] AS INTEGER) END"
_ZONE = "CASE upper(f[9]) " + " ".join(f"WHEN '{name}' THEN {n}" for name, n in ZONE_MINUTES.items()) + " END"
_TEXTS = """SELECT 'city_object_member' AS src, m.member_id AS row_id, m.creation_date AS x, f.time_zone AS tz, f.day_order FROM city_object_member m LEFT JOIN delivery_file d ON d.file_id = m.file_id LEFT JOIN feed f ON f.feed_id = d.feed_id
UNION SELECT 'feature_changelog', c.id, c.transaction_date, f.time_zone, f.day_order FROM feature_changelog c LEFT JOIN feed f ON f.db_user = c.db_user"""
_INSTANTS = f"""x0 AS ({_TEXTS}), x1 AS (SELECT *, lower(trim(x)) AS t FROM x0),
x2 AS (SELECT *, string_split(CASE WHEN regexp_matches(t, '{_NUMBERS}') THEN regexp_replace(t, '{_NUMBERS}', CASE WHEN day_order = 'mdy' THEN '\\3|\\1|\\2' ELSE '\\3|\\2|\\1' END || '|\\4|\\5|\\6||\\7|\\8|')
{_WHEN} END, '|') AS f, CASE WHEN regexp_matches(t, '^(\\d{{10}}|\\d{{13}}|\\d{{16}})$') THEN CAST(rpad(t, 16, '0') AS BIGINT) END AS epoch,
CASE WHEN regexp_matches(t, '^\\d{{4}}-\\d{{3}}t\\d{{2}}:\\d{{2}}:\\d{{2}}z$') THEN epoch_us(TRY_CAST(left(t, 4) || '-01-01 ' || substr(t, 10, 8) AS TIMESTAMP)) + (CAST(substr(t, 6, 3) AS BIGINT) - 1) * 86400000000 END AS by_day FROM x1),
x3 AS (SELECT *, TRY_CAST(f[1] || '-' || lpad(CAST({_MONTH} AS VARCHAR), 2, '0') || '-' || lpad(f[3], 2, '0') || ' ' ||
 lpad(CAST(CASE f[8] WHEN 'p' THEN CAST(f[4] AS INTEGER) % 12 + 12 WHEN 'a' THEN CAST(f[4] AS INTEGER) % 12 ELSE coalesce(TRY_CAST(f[4] AS INTEGER), 0) END AS VARCHAR), 2, '0') || ':' || coalesce(nullif(f[5], ''), '00') || ':' || coalesce(nullif(f[6], ''), '00') || '.' || left(rpad(f[7], 6, '0'), 6) AS TIMESTAMP) AS clock,
 {_ZONE} AS named, CASE WHEN f[10] <> '' THEN (CASE WHEN f[10][1] = '-' THEN -1 ELSE 1 END) * (CAST(substr(f[10], 2, 2) AS INTEGER) * 60 + coalesce(TRY_CAST(right(replace(f[10], ':', ''), length(replace(f[10], ':', '')) - 3) AS INTEGER), 0)) END AS east FROM x2),
x4 AS (SELECT *, CASE WHEN named IS NULL AND east IS NULL AND f[9] = '' THEN epoch_us(timezone(tz, clock)) END AS there FROM x3),
instants AS (SELECT src, row_id, coalesce(epoch, by_day, CASE WHEN there IS NOT NULL THEN CASE WHEN timezone(tz, make_timestamptz(there - 3600000000)) = clock THEN there - 3600000000 ELSE there END
 WHEN named IS NOT NULL OR east IS NOT NULL THEN epoch_us(clock) - CAST(coalesce(named, 0) + coalesce(east, 0) AS BIGINT) * 60000000 END) AS utc_micros FROM x4)"""
_FEED = f"""{_INSTANTS}, names AS (SELECT objectid, min(feature_id) AS known FROM feature_changelog WHERE feature_id IS NOT NULL AND objectid IS NOT NULL GROUP BY 1),
c AS (SELECT DISTINCT l.*, coalesce(l.feature_id, n.known) AS k, i.utc_micros AS ts, CASE left(upper(trim(transaction_type)), 1) WHEN 'I' THEN 'INSERT' WHEN 'U' THEN 'UPDATE' WHEN 'D' THEN 'DELETE' WHEN 'T' THEN 'TERMINATE' END AS kind
 FROM feature_changelog l LEFT JOIN names n ON n.objectid = l.objectid JOIN instants i ON i.src = 'feature_changelog' AND i.row_id = l.id AND i.utc_micros IS NOT NULL),
o AS (SELECT k, ts, kind, min(id) AS id, arg_min(objectclass_id, id) AS objectclass_id, first(objectid ORDER BY id) AS objectid, first(db_user ORDER BY id) AS db_user, first(reason_for_update ORDER BY id) AS reason_for_update FROM c WHERE k IS NOT NULL AND kind IS NOT NULL GROUP BY k, ts, kind),
r AS (SELECT k, arg_max(kind, (ts, id)) AS kind, max((ts, id)) AS place FROM o WHERE kind IN ('INSERT', 'DELETE') GROUP BY k),
e AS (SELECT o.k, min((o.ts, o.id)) AS ended FROM o JOIN r ON r.k = o.k WHERE o.kind = 'TERMINATE' AND r.kind = 'INSERT' AND (o.ts, o.id) > r.place GROUP BY o.k),
u AS (SELECT o.*, r.kind AS reset, e.ended FROM o JOIN r ON r.k = o.k LEFT JOIN e ON e.k = o.k WHERE (r.kind = 'INSERT' AND (o.ts, o.id) >= r.place AND (e.ended IS NULL OR (o.ts, o.id) <= e.ended)) OR (r.kind = 'DELETE' AND (o.ts, o.id) = r.place))"""
_LAST = ", ".join(f"arg_max({c}, (ts, id)) FILTER (reset = 'INSERT' AND {c} IS NOT NULL) AS {c}" for c in ("objectclass_id", "objectid", "db_user", "reason_for_update"))
SQL = {
    "p5_found": f"WITH {_INSTANTS} SELECT DISTINCT src, row_id, utc_micros FROM instants WHERE utc_micros IS NOT NULL",
    "p6_found": f"WITH {_FEED} SELECT k AS feature_id, arg_max(id, (ts, id)) AS change_id FROM u WHERE reset = 'INSERT' AND ended IS NULL GROUP BY k",
    "p6_state": f"""WITH {_FEED}, s AS (SELECT k, CASE WHEN any_value(reset) = 'DELETE' THEN 'absent' WHEN max(ended) IS NOT NULL THEN 'terminated' ELSE 'present' END AS status, arg_max(id, (ts, id)) AS last_id, {_LAST} FROM u GROUP BY k)
SELECT x.k AS feature_id, coalesce(s.status, 'absent') AS status, s.last_id, s.objectclass_id, s.objectid, s.db_user, s.reason_for_update FROM (SELECT DISTINCT k FROM o) x LEFT JOIN s ON s.k = x.k""",
    "p7_found": _P7,
    "p7_report": f"SELECT tab, period, count(*) AS n_orphans FROM ({_P7}) GROUP BY tab, period",
}
