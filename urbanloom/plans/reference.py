"""Queries of a city database, each with the SQL that must agree: scans, filters, joins, aggregations, closures and changes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.functions import crs, geometry, projection, text
from urbanloom.operators import deletion, filters, relations, rollups, spatial, validation
from urbanloom.operators.change_feed import normal_kind
from urbanloom.operators.hierarchy import build, links, rolled_up
from urbanloom.plans.query import Query
from urbanloom.session import small, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Parameters of the queries: a quarter of the town, a day, a span of days.
BBOX = (10000.0, 10000.0, 30000.0, 30000.0)
DAY, SPAN = "2018-06-01 00:00:00", ("2018-01-01 00:00:00", "2019-01-01 00:00:00")


class _Corner:
    """A corner of the extent; columns are made when a session is there."""

    def __init__(self, at: int) -> None:
        self.at = at

    def __getitem__(self, axis: str) -> Column:
        return F.col("envelope")[self.at][axis]


LOW, HIGH = _Corner(0), _Corner(1)


def query(name: str, sql: str | None = None):
    """Registers a query of (feature, property, ... by name) under ``name`` with its SQL."""

    def keep(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: table(spark, sf_dir, t))
        if sql:
            SQL[name] = sql
        return f

    return keep


def _box():
    return F.when(F.col("envelope").isNotNull(), geometry.box(F.col("envelope").cast(geometry.POINTS)))


_ENV = ", ".join(f"min(envelope[1].{k}) AS min_{k}" for k in "xyz") + ", " + ", ".join(f"max(envelope[2].{k}) AS max_{k}" for k in "xyz")
_MEETS = "envelope[1].x <= 30000 AND envelope[2].x >= 10000 AND envelope[1].y <= 30000 AND envelope[2].y >= 10000"

# scans and profiles


@query("scan_profile", f"SELECT count(*) AS n, count(envelope) AS n_with_extent, count(DISTINCT objectclass_id) AS n_types, CAST(count(*) * 0.5 AS DOUBLE) AS kb, {_ENV} FROM feature")
def _(t):
    return t("feature").agg(F.count("*").alias("n"), F.count("envelope").alias("n_with_extent"), F.countDistinct("objectclass_id").alias("n_types"), (F.count("*") * F.lit(0.5)).alias("kb"), *rollups.extent_of(LOW, HIGH))


@query("type_histogram", "SELECT classname, count(*) AS n FROM feature JOIN objectclass o ON o.id = objectclass_id GROUP BY classname")
def _(t):
    return t("feature").groupBy("objectclass_id").agg(F.count("*").alias("n")).join(small(t("objectclass").select(F.col("id").alias("objectclass_id"), "classname")), "objectclass_id").groupBy("classname").agg(F.sum("n").alias("n"))


@query("lod_histogram", "SELECT l AS val_lod, (SELECT count(*) FROM property WHERE val_lod = l) AS n FROM (SELECT unnest(['0', '1', '2', '3', '4']) AS l)")
def _(t):
    return rollups.histogram(t("property"), "val_lod", ["0", "1", "2", "3", "4"])


@query("surrogate_ids", "SELECT objectid, row_number() OVER (ORDER BY objectid) + 1000 AS new_id FROM (SELECT DISTINCT objectid FROM feature_changelog WHERE objectid IS NOT NULL AND objectid NOT IN (SELECT objectid FROM feature WHERE objectid IS NOT NULL))")
def _(t):
    unknown = t("feature_changelog").select("objectid").dropna().distinct().join(t("feature").select("objectid").dropna(), "objectid", "left_anti")
    return rollups.numbered(unknown.withColumn("all", F.lit(0)), "all", "objectid", "k").select("objectid", (F.col("k") + 1000).alias("new_id"))


@query("import_estimate", "SELECT classname, n, CAST(greatest(50.0, round_even(n * 0.5, 1)) AS DOUBLE) AS mb FROM (SELECT classname, count(*) AS n FROM feature JOIN objectclass o ON o.id = objectclass_id GROUP BY classname)")
def _(t):
    return t("feature").join(small(t("objectclass").select(F.col("id").alias("objectclass_id"), "classname")), "objectclass_id").groupBy("classname").agg(F.count("*").alias("n")).withColumn("mb", F.greatest(F.lit(50.0), F.bround(F.col("n") * F.lit(0.5), 1)).cast("double"))


# filters


@query("id_filter", "SELECT id FROM feature WHERE objectid IN (SELECT objectid FROM feature_changelog WHERE transaction_type = 'DELETE')")
def _(t):
    return filters.by_id(t("feature"), "objectid", t("feature_changelog").filter("transaction_type = 'DELETE'").select("objectid")).select("id")


for _mode, _sql in {"intersects": _MEETS, "contains": "envelope[1].x >= 10000 AND envelope[2].x <= 30000 AND envelope[1].y >= 10000 AND envelope[2].y <= 30000", "on_tile": "(envelope[1].x + envelope[2].x) / 2 >= 10000 AND (envelope[1].x + envelope[2].x) / 2 < 30000 AND (envelope[1].y + envelope[2].y) / 2 >= 10000 AND (envelope[1].y + envelope[2].y) / 2 < 30000"}.items():
    for _missing in ("keep", "drop"):

        @query(f"bbox_{_mode}_{_missing}_missing", f"SELECT id FROM feature WHERE coalesce({_sql}, {'true' if _missing == 'keep' else 'false'})")
        def _(t, mode=_mode, missing=_missing):
            return t("feature").filter(filters.in_bbox(LOW, HIGH, BBOX, mode, missing)).select("id")


_SUB = "WITH RECURSIVE s AS (SELECT id FROM objectclass WHERE superclass_id = (SELECT id FROM objectclass WHERE classname = 'Space') UNION ALL SELECT o.id FROM objectclass o JOIN s ON o.superclass_id = s.id)"


@query("subclass_closure", f"{_SUB} SELECT id FROM s WHERE id IN (SELECT id FROM objectclass WHERE is_abstract = 0)")
def _(t):
    return filters.subclasses(t("objectclass"), "Space", skip_abstract=True)


@query("type_filter_closure", f"{_SUB} SELECT id FROM feature WHERE objectclass_id IN (SELECT id FROM s) AND {_MEETS}")
def _(t):
    return Query(t("feature"), t("objectclass")).types("core:Space").bbox(BBOX).df().select("id")


@query("lod_filter", "SELECT id FROM property WHERE val_lod IS NULL OR val_lod IN ('1', '2')")
def _(t):
    return t("property").filter(filters.lod_allowed(F.col("val_lod").cast("int"), [1, 2])).select("id")


for _mode, _sql in {"or": "bool_or(val_lod IN ('1', '2'))", "and": "bool_or(val_lod = '1') AND bool_or(val_lod = '2')", "minimum": "min(val_lod) IN ('1', '2')", "maximum": "max(val_lod) IN ('1', '2')"}.items():

    @query(f"lod_mode_{_mode}", f"SELECT id FROM feature WHERE id IN (SELECT feature_id FROM property WHERE val_lod IS NOT NULL GROUP BY feature_id HAVING {_sql})")
    def _(t, mode=_mode):
        return Query(t("feature"), t("objectclass"), t("property")).lods([1, 2], mode).df().select("id")


for _mode, _sql in {
    "latest": "termination_date IS NULL", "terminated": "termination_date IS NOT NULL", "terminated_at": f"termination_date <= TIMESTAMP '{DAY}'",
    "at": f"creation_date <= TIMESTAMP '{DAY}' AND (termination_date IS NULL OR termination_date > TIMESTAMP '{DAY}')",
    "between": f"creation_date < TIMESTAMP '{SPAN[1]}' AND (termination_date IS NULL OR termination_date > TIMESTAMP '{SPAN[0]}')",
}.items():

    @query(f"validity_{_mode}", f"SELECT id FROM feature WHERE {_sql}")
    def _(t, mode=_mode):
        at, until = (SPAN if mode == "between" else (DAY, DAY))
        return Query(t("feature"), t("objectclass")).valid(mode, F.lit(at).cast("timestamp"), F.lit(until).cast("timestamp")).df().select("id")


@query("validity_world_lenient", f"SELECT id FROM feature WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '{DAY}') AND (valid_to IS NULL OR valid_to > TIMESTAMP '{DAY}')")
def _(t):
    return Query(t("feature"), t("objectclass")).valid("at", F.lit(DAY).cast("timestamp"), reference="validity", lenient=True).df().select("id")


@query("cql2_filter", f"SELECT id FROM feature WHERE objectclass_id IN (68, 75, 138) AND NOT (reason_for_update LIKE 'sur%' OR lineage IS NULL) AND {_MEETS}")
def _(t):
    return Query(t("feature"), t("objectclass")).cql("objectclass_id IN (68, 75, 138) AND NOT (reason_for_update LIKE 'sur%' OR lineage IS NULL) AND s_intersects(core:envelope, bbox(10000, 10000, 30000, 30000))").df().select("id")


@query("sort_limit_offset", "SELECT id FROM feature ORDER BY creation_date DESC NULLS LAST, id LIMIT 25 OFFSET 10")
def _(t):
    return Query(t("feature"), t("objectclass")).page([F.col("creation_date").desc_nulls_last(), F.col("id")], 25, 10).df().select("id")


@query("property_exists", "SELECT DISTINCT feature_id FROM property WHERE val_feature_id IS NOT NULL AND val_relation_type = 1")
def _(t):
    return t("property").filter("val_feature_id is not null and val_relation_type = 1").select("feature_id").distinct()


_RULES = "CASE WHEN lower(name) = 'height' THEN 'measure' WHEN val_uom IS NOT NULL THEN 'measure' WHEN regexp_matches(lower(name), 'of|to$') THEN 'link' WHEN val_string LIKE '%1%' THEN 'text with one' WHEN val_string IS NOT NULL THEN 'text' END"


@query("rule_first_match", f"SELECT label, count(*) AS n FROM (SELECT {_RULES} AS label FROM property) GROUP BY label")
def _(t):
    m = rollups.value_matches
    rules = [(m(F.col("name"), "HEIGHT"), "measure"), (F.col("val_uom").isNotNull(), "measure"), (m(F.col("name"), "of|to$", "regex"), "link"), (m(F.col("val_string"), "1", "contains"), "text with one"), (F.col("val_string").isNotNull() & m(F.col("val_string"), "*"), "text")]
    return rollups.first_rule(t("property"), rules, "label").groupBy("label").agg(F.count("*").alias("n"))


# joins


@query("code_lookup", "SELECT p.id, c.id AS codelist_id, c.codelist_type FROM property p LEFT JOIN (SELECT url, min(id) AS id, arg_min(codelist_type, id) AS codelist_type FROM codelist WHERE url IS NOT NULL GROUP BY url) c ON c.url = p.val_codespace WHERE p.val_codespace IS NOT NULL")
def _(t):
    lists = t("codelist").filter("url is not null").groupBy("url").agg(F.min("id").alias("codelist_id"), F.min_by("codelist_type", "id").alias("codelist_type"))
    return t("property").filter("val_codespace is not null").select("id", F.col("val_codespace").alias("url")).join(lists, "url", "left").select("id", "codelist_id", "codelist_type")


@query("code_validity", "SELECT p.id, (l.url IS NULL OR EXISTS (SELECT 1 FROM codelist_entry e JOIN codelist c ON c.id = e.codelist_id WHERE c.url = p.val_codespace AND e.code = p.val_string)) AS known FROM property p LEFT JOIN (SELECT DISTINCT url FROM codelist WHERE url IS NOT NULL) l ON l.url = p.val_codespace WHERE p.val_codespace IS NOT NULL")
def _(t):
    used = t("property").filter("val_codespace is not null").select("id", F.col("val_codespace").alias("url"), F.col("val_string").alias("code"))
    lists = t("codelist").filter("url is not null")
    codes = t("codelist_entry").filter("code is not null").join(lists.select(F.col("id").alias("codelist_id"), "url"), "codelist_id").select("url", "code", F.lit(True).alias("hit")).distinct()
    return used.join(lists.select("url", F.lit(True).alias("list")).distinct(), "url", "left").join(codes, ["url", "code"], "left").select("id", (F.col("list").isNull() | F.coalesce("hit", F.lit(False))).alias("known"))


@query("codelist_search", "SELECT id, code FROM codelist_entry WHERE contains(lower(definition), 'roof')")
def _(t):
    return t("codelist_entry").filter(F.lower("definition").contains("roof")).select("id", "code")


@query("common_codes", "SELECT codelist_id, id, code FROM (SELECT *, row_number() OVER (PARTITION BY codelist_id ORDER BY id) AS k FROM codelist_entry WHERE codelist_id IS NOT NULL) WHERE k <= 10")
def _(t):
    from pyspark.sql import Window as W

    return t("codelist_entry").filter("codelist_id is not null").withColumn("k", F.row_number().over(W.partitionBy("codelist_id").orderBy("id"))).filter("k <= 10").select("codelist_id", "id", "code")


@query("xlink_resolve", "SELECT p.id, f.objectclass_id FROM property p LEFT JOIN feature f ON f.id = p.val_feature_id WHERE p.val_feature_id IS NOT NULL")
def _(t):
    refs = t("property").filter("val_feature_id is not null").select("id", F.concat(F.lit("#"), F.col("val_feature_id").cast("string")).alias("href"))
    return relations.resolve(refs, "href", t("feature").select(F.col("id").cast("string").alias("target"), "objectclass_id"), "target").select("id", "objectclass_id")


@query("xlink_dangling", "SELECT id FROM property WHERE val_feature_id IS NOT NULL AND val_feature_id NOT IN (SELECT id FROM feature)")
def _(t):
    refs = t("property").filter("val_feature_id is not null").select("id", F.concat(F.lit("model.gml#"), F.col("val_feature_id").cast("string")).alias("href"))
    return relations.dangling(refs, "href", t("feature").select(F.col("id").cast("string").alias("target")), "target").select("id")


@query("referrers", "SELECT val_feature_id, count(DISTINCT feature_id) AS n_sources, min(feature_id) AS first_source FROM property WHERE val_feature_id IS NOT NULL AND feature_id IS NOT NULL GROUP BY val_feature_id")
def _(t):
    return relations.referrers(t("property"), "feature_id", "val_feature_id")


@query("relation_edges", "SELECT name, val_relation_type, count(*) AS n FROM (SELECT DISTINCT feature_id, val_feature_id, name, val_relation_type FROM property WHERE val_feature_id IS NOT NULL) GROUP BY ALL")
def _(t):
    return t("property").filter("val_feature_id is not null").select("feature_id", "val_feature_id", "name", "val_relation_type").distinct().groupBy("name", "val_relation_type").agg(F.count("*").alias("n"))


@query("group_members", "SELECT g.id AS group_id, f.objectclass_id, count(*) AS n FROM feature g JOIN property p ON p.feature_id = g.id AND p.name = 'groupMember' JOIN feature f ON f.id = p.val_feature_id GROUP BY ALL")
def _(t):
    member = t("property").filter("name = 'groupMember'").select(F.col("feature_id").alias("group_id"), F.col("val_feature_id").alias("id"))
    return member.join(t("feature").select("id", "objectclass_id"), "id").join(t("feature").select(F.col("id").alias("group_id")), "group_id").groupBy("group_id", "objectclass_id").agg(F.count("*").alias("n"))


@query("property_and_parent", "SELECT c.id AS child, p.id AS parent, p.name FROM property c JOIN property p ON c.parent_id = p.id AND c.feature_id = p.feature_id")
def _(t):
    p = t("property").select(F.col("id").alias("parent"), "feature_id", "name")
    return t("property").filter("parent_id is not null").select(F.col("id").alias("child"), F.col("parent_id").alias("parent"), "feature_id").join(p, ["parent", "feature_id"]).select("child", "parent", "name")


@query("touching_pairs", "WITH b AS (SELECT id, envelope[1] AS l, envelope[2] AS h FROM feature WHERE envelope IS NOT NULL) SELECT p.id AS a, q.id AS b, sqrt(" + " + ".join(f"pow(greatest(0, p.l.{k} - q.h.{k}, q.l.{k} - p.h.{k}), 2)" for k in "xyz") + ") AS gap FROM b p JOIN b q ON p.id < q.id AND p.l.x <= q.h.x + 5 AND q.l.x <= p.h.x + 5 AND p.l.y <= q.h.y + 5 AND q.l.y <= p.h.y + 5 WHERE gap <= 5")
def _(t):
    return spatial.touching_pairs(t("feature").select("id", _box().alias("box")), "id", "box", 5.0)


@query("nearest_three", "WITH b AS (SELECT id, envelope[1] AS l, envelope[2] AS h FROM feature WHERE envelope IS NOT NULL), g AS (SELECT p.id AS query, q.id AS neighbour, sqrt(" + " + ".join(f"pow(greatest(0, p.l.{k} - q.h.{k}, q.l.{k} - p.h.{k}), 2)" for k in "xyz") + ") AS gap FROM b p JOIN b q ON p.id <> q.id WHERE p.id % 50 = 0) SELECT query, neighbour, gap, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY gap, neighbour) AS k FROM g) WHERE k <= 3")
def _(t):
    boxes = t("feature").select("id", _box().alias("box"))
    return spatial.nearest(boxes.filter("id % 50 = 0"), boxes, "id", "box", 3)


@query("in_polygon", "SELECT id FROM (SELECT id, (envelope[1].x + envelope[2].x) / 2 AS x, (envelope[1].y + envelope[2].y) / 2 AS y FROM feature) WHERE y > 5000 AND y < 25000 AND x > y AND x < 60000 - y")
def _(t):
    corners = [(5000, 5000), (55000, 5000), (35000, 25000), (25000, 25000)]
    ring = F.expr("array(" + ", ".join(f"named_struct('x', {x}D, 'y', {y}D, 'z', 0D)" for x, y in corners) + ")")
    x, y = (LOW["x"] + HIGH["x"]) / 2, (LOW["y"] + HIGH["y"]) / 2
    centres = t("feature").filter("envelope is not null").select("id", x.alias("x"), y.alias("y"))
    x, y = F.col("x"), F.col("y")
    return centres.filter(y.between(5000, 25000)).filter(geometry.inside(x, y, ring)).filter((y != 5000) & (x != y) & (x != 60000 - y) & (y != 25000)).select("id")


# aggregations


@query("extent_by_type", f"SELECT objectclass_id, {_ENV} FROM feature GROUP BY objectclass_id")
def _(t):
    return t("feature").groupBy("objectclass_id").agg(*rollups.extent_of(LOW, HIGH))


@query("extent_rollup")
def _(t):
    contains = t("property").filter("val_relation_type = 1")
    _, paths, extra = build(links(contains, "feature_id", "val_feature_id"))
    own = t("feature").select("id", *[LOW[k].alias(f"min_{k}") for k in "xyz"], *[HIGH[k].alias(f"max_{k}") for k in "xyz"])
    return rolled_up(own, "id", paths, extra, {c: c[:3] for c in rollups.CORNERS})


SQL["extent_rollup"] = f"""WITH RECURSIVE e AS (SELECT DISTINCT feature_id AS p, val_feature_id AS c FROM property WHERE val_relation_type = 1), r(a, b) AS (SELECT p, c FROM e UNION SELECT r.a, e.c FROM r JOIN e ON r.b = e.p),
x AS (SELECT a FROM r WHERE a = b), f AS (SELECT * FROM e WHERE p NOT IN (SELECT a FROM x) AND c NOT IN (SELECT a FROM x)), q(a, b) AS (SELECT p, c FROM f UNION SELECT q.a, f.c FROM q JOIN f ON q.b = f.p),
m AS (SELECT id AS a, id AS b FROM feature UNION SELECT a, b FROM q) SELECT m.a AS id, {_ENV} FROM m JOIN feature g ON g.id = m.b GROUP BY m.a"""


@query("extent_under_matrix", "SELECT id, 2 * envelope[1].x + 10 AS min_x, 2 * envelope[1].y + 20 AS min_y, envelope[1].z + 30 AS min_z, 2 * envelope[2].x + 10 AS max_x, 2 * envelope[2].y + 20 AS max_y, envelope[2].z + 30 AS max_z FROM feature WHERE envelope IS NOT NULL")
def _(t):
    matrix = F.array(*[F.lit(float(v)) for v in (2, 0, 0, 10, 0, 2, 0, 20, 0, 0, 1, 30, 0, 0, 0, 1)])
    moved = t("feature").filter("envelope is not null").select("id", geometry.affine(geometry.diagonal_ring(_box()), matrix).alias("ring"))
    return moved.select("id", geometry.box(F.col("ring")).alias("b")).select("id", "b.*")


@query("duplicate_objects", "SELECT objectid, count(*) AS n, string_agg(DISTINCT CAST(objectclass_id AS VARCHAR), ',' ORDER BY CAST(objectclass_id AS VARCHAR)) AS shown FROM feature_changelog WHERE objectid IS NOT NULL GROUP BY objectid HAVING count(*) > 1")
def _(t):
    return rollups.duplicates(t("feature_changelog"), "objectid", "objectclass_id")


@query("first_of_repeated", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY feature_id, parent_id, name, val_int, val_double, val_string, val_timestamp, val_uri, val_address_id, val_feature_id, val_lod ORDER BY id) AS k FROM property) WHERE k = 1")
def _(t):
    key = ["feature_id", "parent_id", "name", "val_int", "val_double", "val_string", "val_timestamp", "val_uri", "val_address_id", "val_feature_id", "val_lod"]
    return t("property").groupBy(*key).agg(F.min("id").alias("id")).select("id")


@query("commonest_lod", "SELECT feature_id, val_lod AS lod FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY n DESC, val_lod DESC) AS k FROM (SELECT feature_id, val_lod, count(*) AS n FROM property WHERE val_lod IS NOT NULL GROUP BY ALL)) WHERE k = 1")
def _(t):
    return rollups.commonest(t("property"), ["feature_id"], "val_lod", "lod")


@query("lod_of_root", "WITH RECURSIVE e AS (SELECT DISTINCT feature_id AS p, val_feature_id AS c FROM property WHERE val_relation_type = 1), r(a, b) AS (SELECT p, c FROM e UNION SELECT r.a, e.c FROM r JOIN e ON r.b = e.p), x AS (SELECT a FROM r WHERE a = b), f AS (SELECT c, min(p) AS p FROM e WHERE p NOT IN (SELECT a FROM x) AND c NOT IN (SELECT a FROM x) GROUP BY c), n AS (SELECT p AS n FROM e UNION SELECT c FROM e), h AS (SELECT n, n AS root FROM n WHERE n NOT IN (SELECT a FROM x) AND n NOT IN (SELECT c FROM f) UNION ALL SELECT f.c, h.root FROM h JOIN f ON f.p = h.n) SELECT root, max(val_lod) AS lod, count(DISTINCT val_lod) > 1 AS mixed FROM h JOIN property ON feature_id = h.n WHERE val_lod IS NOT NULL GROUP BY root")
def _(t):
    _, paths, _ = build(links(t("property").filter("val_relation_type = 1"), "feature_id", "val_feature_id"))
    root = paths.select(F.col("node").alias("feature_id"), F.col("segments")[0]["chain"].alias("root"))
    levels = t("property").filter("val_lod is not null").select("feature_id", "val_lod").distinct()
    return levels.join(root, "feature_id").groupBy("root").agg(F.max("val_lod").alias("lod"), (F.countDistinct("val_lod") > 1).alias("mixed"))


@query("median_step", "SELECT objectclass_id, least(40.0, greatest(5.0, coalesce(quantile_cont(w, 0.5), 20))) AS step FROM (SELECT objectclass_id, envelope[2].x - envelope[1].x AS w FROM feature) GROUP BY objectclass_id")
def _(t):
    width = F.percentile(HIGH["x"] - LOW["x"], F.lit(0.5))
    return t("feature").groupBy("objectclass_id").agg(F.least(F.lit(40.0), F.greatest(F.lit(5.0), F.coalesce(width, F.lit(20.0)))).alias("step"))


@query("large_surfaces", "SELECT id, CASE WHEN a > 0.8 * avg(a) OVER (PARTITION BY objectclass_id) THEN 'TrafficArea' ELSE 'AuxiliaryTrafficArea' END AS kind FROM (SELECT id, objectclass_id, (envelope[2].x - envelope[1].x) * (envelope[2].y - envelope[1].y) AS a FROM feature WHERE envelope IS NOT NULL)")
def _(t):
    a = (HIGH["x"] - LOW["x"]) * (HIGH["y"] - LOW["y"])
    sized = t("feature").filter("envelope is not null").select("id", "objectclass_id", a.alias("a"))
    mean = sized.groupBy("objectclass_id").agg(F.avg("a").alias("mean"))  # one row per class: no window over a hot class
    return sized.join(small(mean), "objectclass_id").select("id", F.when(F.col("a") > 0.8 * F.col("mean"), "TrafficArea").otherwise("AuxiliaryTrafficArea").alias("kind"))


@query("regular_grids", "WITH p AS (SELECT objectclass_id, envelope[1].x AS x, round_even(envelope[1].y / 5000, 0) AS y FROM feature WHERE envelope IS NOT NULL), r AS (SELECT objectclass_id, y, count(*) AS n FROM p GROUP BY ALL) SELECT objectclass_id, count(*) AS n_rows, min(n) = max(n) AS regular FROM r GROUP BY objectclass_id")
def _(t):
    points = t("feature").filter("envelope is not null").select("objectclass_id", LOW["x"].alias("x"), F.bround(LOW["y"] / 5000, 0).alias("y"))
    return rollups.regular_grids(points, "objectclass_id", "y")


@query("watertight", "SELECT id, CASE WHEN envelope[2].z > envelope[1].z THEN 6 ELSE 5 END AS n_faces, CASE WHEN envelope[2].z > envelope[1].z THEN 0 ELSE 4 END AS n_bad_edges FROM feature WHERE envelope IS NOT NULL AND envelope[2].x > envelope[1].x AND envelope[2].y > envelope[1].y AND envelope[2].z > envelope[1].z UNION ALL SELECT -id, 5, 4 FROM feature WHERE envelope[2].x > envelope[1].x AND envelope[2].y > envelope[1].y AND envelope[2].z > envelope[1].z")
def _(t):
    solid = t("feature").filter((HIGH["x"] > LOW["x"]) & (HIGH["y"] > LOW["y"]) & (HIGH["z"] > LOW["z"]))
    faces = solid.select("id", F.posexplode(geometry.box_faces(_box())).alias("face", "ring"))
    lidless = faces.filter("face <> 1").select((-F.col("id")).alias("id"), "face", "ring")
    return rollups.open_edges(faces.unionAll(lidless), "id", "ring")


@query("model_report", "SELECT classname, CAST(ended AS INTEGER) AS ended, count(*) AS n FROM (SELECT classname, termination_date IS NOT NULL AS ended FROM feature JOIN objectclass o ON o.id = objectclass_id) GROUP BY ROLLUP (classname, ended)")
def _(t):
    named = t("feature").join(small(t("objectclass").select(F.col("id").alias("objectclass_id"), "classname")), "objectclass_id")
    return named.withColumn("ended", F.col("termination_date").isNotNull().cast("int")).rollup("classname", "ended").agg(F.count("*").alias("n"))


@query("attribute_pivot", "SELECT feature_id, min(val_string) FILTER (name = 'function') AS function, min(val_string) FILTER (name = 'usage') AS usage, min(val_int) FILTER (name = 'yearOfConstruction') AS year, min(val_string) FILTER (name = 'roofType') AS roof FROM property WHERE name IN ('function', 'usage', 'yearOfConstruction', 'roofType') GROUP BY feature_id")
def _(t):
    at = lambda name, column: F.min(F.when(F.col("name") == name, F.col(column)))
    return t("property").filter(F.col("name").isin("function", "usage", "yearOfConstruction", "roofType")).groupBy("feature_id").agg(at("function", "val_string").alias("function"), at("usage", "val_string").alias("usage"), at("yearOfConstruction", "val_int").alias("year"), at("roofType", "val_string").alias("roof"))


@query("values_by_codespace", "SELECT val_codespace, count(*) AS n, count(DISTINCT val_string) AS n_values FROM property WHERE val_codespace IS NOT NULL GROUP BY val_codespace")
def _(t):
    return t("property").filter("val_codespace is not null").groupBy("val_codespace").agg(F.count("*").alias("n"), F.countDistinct("val_string").alias("n_values"))


# sets and closures


@query("intersect_then_union", "SELECT feature_id AS id FROM property WHERE val_relation_type = 1 INTERSECT SELECT id FROM feature WHERE termination_date IS NOT NULL UNION SELECT val_feature_id FROM property WHERE val_relation_type = 0 AND val_feature_id IS NOT NULL")
def _(t):
    a = t("property").filter("val_relation_type = 1").select(F.col("feature_id").alias("id"))
    return a.intersect(t("feature").filter("termination_date is not null").select("id")).union(t("property").filter("val_relation_type = 0 and val_feature_id is not null").select(F.col("val_feature_id").alias("id"))).distinct()


@query("property_tree", "WITH RECURSIVE r AS (SELECT id FROM property WHERE name = 'height' UNION SELECT p.id FROM property p JOIN r ON p.parent_id = r.id) SELECT id FROM r")
def _(t):
    p = t("property")
    return relations.reached(p.select(F.col("parent_id").alias("p"), F.col("id").alias("c")), p.filter("name = 'height'").select(F.col("id").alias("node"))).select(F.col("node").alias("id"))


@query("unused_addresses", "SELECT id FROM address WHERE id NOT IN (SELECT val_address_id FROM property WHERE val_address_id IS NOT NULL)")
def _(t):
    return t("address").select("id").join(t("property").select(F.col("val_address_id").alias("id")).dropna().distinct(), "id", "left_anti")


# changes


def _ended(t) -> DataFrame:
    return t("feature").filter("termination_date is not null").select(F.col("id").alias("node"))


_CONTAINS = "SELECT DISTINCT feature_id AS p, val_feature_id AS c FROM property WHERE val_relation_type = 1 AND feature_id IS NOT NULL AND val_feature_id IS NOT NULL"


@query("delete_features", f"""WITH RECURSIVE e AS ({_CONTAINS}), f AS (SELECT id AS n FROM feature WHERE termination_date IS NOT NULL),
r(n) AS (SELECT n FROM f UNION SELECT e.c FROM r JOIN e ON e.p = r.n), i AS (SELECT n FROM r WHERE n NOT IN (SELECT n FROM f)),
s(n) AS (SELECT c FROM e WHERE c IN (SELECT n FROM i) AND p NOT IN (SELECT n FROM r) UNION SELECT e.c FROM s JOIN e ON e.p = s.n WHERE e.c IN (SELECT n FROM i)),
gone AS (SELECT n FROM r WHERE n NOT IN (SELECT n FROM s)),
up(id, parent_id, name, namespace_id) AS (SELECT id, parent_id, name, namespace_id FROM property WHERE val_feature_id IN (SELECT n FROM gone)
 UNION SELECT p.id, p.parent_id, p.name, p.namespace_id FROM up c JOIN property p ON p.id = c.parent_id AND p.name = c.name AND p.namespace_id = c.namespace_id),
x(id) AS (SELECT id FROM property WHERE feature_id IN (SELECT n FROM gone) UNION SELECT id FROM up UNION SELECT p.id FROM x JOIN property p ON p.parent_id = x.id),
l AS (SELECT * FROM property WHERE id NOT IN (SELECT id FROM x)),
a AS (SELECT val_address_id AS id FROM property WHERE id IN (SELECT id FROM x) AND val_address_id IS NOT NULL AND val_address_id NOT IN (SELECT val_address_id FROM l WHERE val_address_id IS NOT NULL))
SELECT 'feature' AS tab, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM feature WHERE id NOT IN (SELECT n FROM gone)
UNION ALL SELECT 'property', count(*), CAST(sum(id) AS BIGINT) FROM l UNION ALL SELECT 'address', count(*), CAST(sum(id) AS BIGINT) FROM address WHERE id NOT IN (SELECT id FROM a)""")
def _(t):
    left = deletion.delete_features({name: t(name) for name in ("feature", "property", "address")}, _ended(t))
    rows = [df.agg(F.count("*").alias("n"), F.sum("id").alias("id_sum")).select(F.lit(name).alias("tab"), "n", "id_sum") for name, df in left.items()]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


_KINDS = "objectclass_id IN (68, 82, 96)"
_ENDING = ", ".join(f"t{k + 1} AS MATERIALIZED (SELECT n FROM t{k} UNION SELECT e.c FROM e JOIN t{k} ON t{k}.n = e.p WHERE e.c IN (SELECT id FROM feature) AND NOT EXISTS (SELECT 1 FROM e h JOIN feature g ON g.id = h.p WHERE h.c = e.c AND g.termination_date IS NULL AND h.p NOT IN (SELECT n FROM t{k})))" for k in range(150))


@query("terminate_cascade", f"""WITH e AS MATERIALIZED ({_CONTAINS}), t0 AS MATERIALIZED (SELECT id AS n FROM feature WHERE {_KINDS}), {_ENDING}
SELECT id, CASE WHEN id IN (SELECT n FROM t150) AND termination_date IS NULL THEN TIMESTAMP '2024-01-01' ELSE CAST(termination_date AS TIMESTAMP) END AS termination_date FROM feature""")
def _(t):
    ids = t("feature").filter(_KINDS).select(F.col("id").alias("node"))
    done = deletion.terminate_features(t("feature"), t("property"), ids, F.lit("2024-01-01 00:00:00").cast("timestamp"), "nobody")
    return done.select("id", F.col("termination_date").cast("timestamp_ntz").alias("termination_date"))


@query("delete_property_tree", "WITH RECURSIVE r AS (SELECT id FROM property WHERE name = 'height' UNION SELECT p.id FROM property p JOIN r ON p.parent_id = r.id) SELECT id FROM property WHERE id NOT IN (SELECT id FROM r)")
def _(t):
    p = t("property")
    gone = relations.reached(p.select(F.col("parent_id").alias("p"), F.col("id").alias("c")), p.filter("name = 'height'").select(F.col("id").alias("node")))
    return p.select("id").join(gone.select(F.col("node").alias("id")), "id", "left_anti")


@query("terminate_features", "SELECT id, CASE WHEN objectclass_id = 180 AND termination_date IS NULL THEN TIMESTAMP '2024-01-01' ELSE CAST(termination_date AS TIMESTAMP) END AS termination_date FROM feature")
def _(t):
    ids = t("feature").filter("objectclass_id = 180").select(F.col("id").alias("node"))
    done = deletion.terminate_features(t("feature"), t("property"), ids, F.lit("2024-01-01 00:00:00").cast("timestamp"), "nobody", cascade=False)
    return done.select("id", F.col("termination_date").cast("timestamp_ntz").alias("termination_date"))


_CUT = "TIMESTAMP '2020-01-01'"


_KIND = "upper(trim(transaction_type))"


@query("snapshot_changes", f"""WITH d AS (SELECT DISTINCT feature_id AS id FROM feature_changelog WHERE {_KIND} IN ('D', 'DELETE', 'DELETED') AND feature_id IS NOT NULL), u AS (SELECT feature_id AS id, max(received_at) AS changed FROM feature_changelog WHERE {_KIND} IN ('U', 'UPDATE', 'UPDATED') GROUP BY 1),
a AS (SELECT id, last_modification_date AS m FROM feature WHERE loaded_at < {_CUT}), b AS (SELECT id, coalesce(changed, last_modification_date) AS m, termination_date AS e FROM feature LEFT JOIN u USING (id) WHERE id NOT IN (SELECT id FROM d))
SELECT * FROM (SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'DELETE' WHEN a.id IS NOT NULL AND a.m IS NOT DISTINCT FROM b.m THEN NULL WHEN e IS NOT NULL THEN 'TERMINATE' WHEN a.id IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS change FROM a FULL JOIN b ON a.id = b.id) WHERE change IS NOT NULL""")
def _(t):
    f, log = t("feature"), t("feature_changelog").withColumn("kind", normal_kind(F.col("transaction_type"))).filter("feature_id is not null").withColumnRenamed("feature_id", "key")
    before = f.filter(F.col("loaded_at") < F.lit("2020-01-01 00:00:00").cast("timestamp"))
    updated = log.filter("kind = 'UPDATE'").groupBy(F.col("key").alias("id")).agg(F.max("received_at").alias("at"))
    after = f.join(log.filter("kind = 'DELETE'").select(F.col("key").alias("id")).distinct(), "id", "left_anti").join(updated, "id", "left").withColumn("last_modification_date", F.coalesce("at", "last_modification_date"))
    return relations.snapshot_changes(before, after, "id", "last_modification_date", "termination_date")


for _mode, _sql in {
    "import_all": "SELECT id, n FROM (SELECT objectid AS id, count(*) AS n FROM (SELECT objectid FROM feature UNION ALL SELECT objectid FROM feature_changelog WHERE objectid IS NOT NULL) GROUP BY 1)",
    "skip": "SELECT objectid AS id, count(*) AS n FROM (SELECT objectid FROM feature UNION ALL SELECT objectid FROM feature_changelog WHERE objectid IS NOT NULL AND objectid NOT IN (SELECT objectid FROM feature WHERE objectid IS NOT NULL)) GROUP BY 1",
    "delete": "SELECT objectid AS id, count(*) AS n FROM (SELECT objectid FROM feature WHERE objectid IS NULL OR objectid NOT IN (SELECT objectid FROM feature_changelog WHERE objectid IS NOT NULL) UNION ALL SELECT objectid FROM feature_changelog WHERE objectid IS NOT NULL) GROUP BY 1",
}.items():

    @query(f"load_{_mode}", _sql)
    def _(t, mode=_mode):
        new = t("feature_changelog").filter("objectid is not null").select("objectid")
        return relations.load_features(t("feature").select("objectid"), new, "objectid", mode).groupBy(F.col("objectid").alias("id")).agg(F.count("*").alias("n"))


# scalars


#: Ways to write the name of a system with code {h} and height {v}.
_NOTATIONS = [
    "EPSG:{h}", "epsg:{h}", "EPSG {h}", "urn:ogc:def:crs:EPSG::{h}", "urn:x-ogc:def:crs:EPSG:6.18.3:{h}", "http://www.opengis.net/gml/srs/epsg.xml#{h}", "http://www.opengis.net/def/crs/EPSG/0/{h}",
    "urn:ogc:def:crs,crs:EPSG::{h},crs:EPSG::{v}", "urn:ogc:def:crs,crs:EPSG:6.12:{h},crs:EPSG:6.12:{v}", "local grid {h}", "urn:adv:crs:ETRS89_UTM{z}", "URN:ADV:CRS:etrs89_utm{z}*DE_DHHN92_NH", "urn:adv:crs:ETRS89_UTM{z}*de_dhhn2016_nh",
    "urn:adv:crs:DE_DHDN_3GK{g}*DE_DHN92_NH",
]
_CASE = "CASE " + " ".join(f"WHEN k = {k} THEN '{n}'" for k, n in enumerate(_NOTATIONS)) + " END"
_FILLED = "replace(replace(replace(replace(" + _CASE + ", '{h}', CAST(20000 + id % 9000 AS VARCHAR)), '{v}', CAST(5700 + id % 200 AS VARCHAR)), '{z}', CAST(31 + id % 3 AS VARCHAR)), '{g}', CAST(2 + id % 4 AS VARCHAR))"
_SPELLED = f"SELECT id, k, {_FILLED} AS name FROM (SELECT id, id % {len(_NOTATIONS)} AS k FROM feature)"


@query("crs_names", rf"""SELECT id, CASE WHEN low LIKE 'urn:adv%utm%dhhn92%' THEN 'EPSG:258' || zone || '+5783' WHEN low LIKE 'urn:adv%utm%' THEN 'EPSG:258' || zone
WHEN low LIKE 'urn:adv%3gk%' THEN 'EPSG:3146' || CAST(CAST(regexp_extract(low, '3gk(\d)', 1) AS INTEGER) + 4 AS VARCHAR) || '+5783' WHEN low LIKE 'local%' THEN 'Unknown CRS'
WHEN low LIKE '%,crs:epsg%,crs:epsg%' THEN 'EPSG:' || regexp_extract(low, ':(\d{{5}}),', 1) || '+' || regexp_extract(low, ':(\d{{4}})$', 1) ELSE 'EPSG:' || regexp_extract(low, '(\d{{5}})$', 1) END AS horizontal,
CASE WHEN low LIKE 'urn:adv%dhhn2016%' THEN CASE WHEN zone IN ('32', '33') THEN '7837' ELSE '' END WHEN low LIKE 'urn:adv%dhhn92%' OR low LIKE 'urn:adv%dhn92%' THEN '5783' WHEN low LIKE '%,crs:epsg%,crs:epsg%' THEN regexp_extract(low, ':(\d{{4}})$', 1) ELSE '' END AS height
FROM (SELECT *, lower(name) AS low, regexp_extract(lower(name), 'utm(\d\d)', 1) AS zone FROM ({_SPELLED}))""")
def _(t):
    names = t("feature").select("id", (F.col("id") % len(_NOTATIONS)).alias("k")).select("id", F.expr(_FILLED.replace("VARCHAR", "STRING")).alias("name"))
    return names.select("id", crs.normal_crs(F.col("name")).alias("horizontal"), crs.height_code(F.col("name")).alias("height"))


@query("codespace_ids", r"SELECT id, regexp_replace(regexp_replace(trim(val_uri), '^#', ''), '[^A-Za-z0-9_-]', '_', 'g') AS xml_id, CASE WHEN contains(val_uri, '#') THEN regexp_extract(val_uri, '#(.*)$', 1) ELSE trim(val_uri) END AS reference FROM property WHERE val_uri IS NOT NULL")
def _(t):
    return t("property").filter("val_uri is not null").select("id", text.xs_id(F.col("val_uri")).alias("xml_id"), text.reference_id(F.col("val_uri")).alias("reference"))


@query("material_names", r"SELECT id, CASE WHEN trim(coalesce(val_string, '')) = '' THEN 'Material' ELSE regexp_replace(substr(trim(val_string), 1, 63), '[<>:\"/\\|?*]', '_', 'g') END AS material FROM property WHERE name = 'name'")
def _(t):
    return t("property").filter("name = 'name'").select("id", text.material_name(F.col("val_string")).alias("material"))


@query("unique_ids", r"""WITH b AS (SELECT id, regexp_replace(v, '[^A-Za-z0-9_.-]', '_', 'g') AS base FROM (SELECT id, name || '_' || (id % 7) AS v FROM property UNION ALL SELECT -id, val_string FROM property WHERE name = 'name' AND val_string <> '')),
t AS (SELECT regexp_replace(base, '_[1-9][0-9]*$', '') AS stem, list(DISTINCT TRY_CAST(regexp_extract(base, '_([1-9][0-9]*)$', 1) AS BIGINT)) AS taken FROM b WHERE TRY_CAST(regexp_extract(base, '_([1-9][0-9]*)$', 1) AS BIGINT) >= 2 GROUP BY 1),
p AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS k FROM b)
SELECT id, CASE WHEN k = 1 THEN base ELSE base || '_' || CAST(CASE WHEN taken IS NULL THEN k ELSE list_filter(range(2, k + len(taken) + 2), lambda x: NOT list_contains(taken, x))[k - 1] END AS VARCHAR) END AS gml_id FROM p LEFT JOIN t ON t.stem = p.base""")
def _(t):
    p = t("property")
    text_ = p.select("id", F.concat_ws("_", "name", (F.col("id") % 7).cast("string")).alias("v")).unionAll(p.filter("name = 'name' and val_string <> ''").select(-F.col("id"), "val_string"))
    named = text_.select("id", F.regexp_replace("v", "[^A-Za-z0-9_.-]", "_").alias("base"))
    return rollups.unique_names(named, "base", "id", "gml_id").select("id", "gml_id")


@query("typed_values", "SELECT id, val_int BETWEEN 0 AND 4 AS as_lod_ok, CASE WHEN val_int BETWEEN 0 AND 4 THEN val_int END AS lod, CASE WHEN val_int IN (0, 1) THEN val_int = 1 END AS truth, least(1.0, greatest(0.0, val_int / 10.0)) AS part FROM property WHERE val_int IS NOT NULL")
def _(t):
    shown = F.col("val_int").cast("string")
    return t("property").filter("val_int is not null").select("id", text.lod(F.concat(F.lit("lod"), shown)).isNotNull().alias("as_lod_ok"), text.lod(shown).cast("long").alias("lod"), text.truth(shown).alias("truth"), text.clamped((F.col("val_int") / 10.0).cast("string")).cast("double").alias("part"))


@query("date_texts", "SELECT id, strftime(val_timestamp, '%Y-%m-%d') AS day, strftime(val_timestamp, '%Y-%m-%dT00:00:00') AS midnight FROM property WHERE val_timestamp IS NOT NULL")
def _(t):
    day = F.date_format("val_timestamp", "yyyy-MM-dd")
    return t("property").filter("val_timestamp is not null").select("id", text.date_text(F.concat(day, F.lit("T12:00:00")), "date").alias("day"), text.date_text(day, "dateTime").alias("midnight"))


@query("text_chunks", "SELECT id, len(feature_id_text) // 4 + CASE WHEN len(feature_id_text) % 4 > 0 THEN 1 ELSE 0 END AS n, substr(feature_id_text, 1, 4) AS first FROM (SELECT id, objectid AS feature_id_text FROM feature)")
def _(t):
    pieces = text.text_chunks(F.col("objectid"), 4)
    return t("feature").select("id", F.size(pieces).cast("long").alias("n"), F.get(pieces, F.lit(0)).alias("first"))


@query("ring_measures", "SELECT id, (envelope[2].x - envelope[1].x) * (envelope[2].y - envelope[1].y) AS area, (envelope[2].x - envelope[1].x) * (envelope[2].y - envelope[1].y) AS signed, CASE WHEN envelope[2].x > envelope[1].x AND envelope[2].y > envelope[1].y THEN 'RoofSurface' END AS kind FROM feature WHERE envelope IS NOT NULL")
def _(t):
    corners = F.concat_ws(" ", *[c.cast("string") for c in (LOW["x"], LOW["y"], HIGH["x"], LOW["y"], HIGH["x"], HIGH["y"], LOW["x"], HIGH["y"])])
    ring = t("feature").filter("envelope is not null").select("id", geometry.parse_points(corners, F.lit(2)).alias("ring"))
    flat = geometry.area(F.col("ring")) > 0
    return ring.select("id", geometry.area(F.col("ring")).alias("area"), geometry.signed_area(F.col("ring")).alias("signed"), F.when(flat, geometry.surface_by_normal(geometry.unit_normal(F.col("ring"))["z"])).alias("kind"))


@query("parsed_points", "SELECT id, envelope[1].y AS x, envelope[1].x AS y, envelope[1].z AS z, CAST(2 AS INTEGER) AS n FROM feature WHERE envelope IS NOT NULL")
def _(t):
    line = F.concat_ws(" ", *[c.cast("string") for c in (LOW["x"], LOW["y"], LOW["z"], HIGH["x"], HIGH["y"], HIGH["z"])])
    points = geometry.parse_points(line, F.lit(3), F.lit(True))
    return t("feature").filter("envelope is not null").select("id", points.alias("p")).select("id", F.col("p")[0]["x"].alias("x"), F.col("p")[0]["y"].alias("y"), F.col("p")[0]["z"].alias("z"), F.size("p").alias("n"))


@query("surface_labels", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN f = 0 THEN 'GroundSurface' WHEN f = 1 THEN 'RoofSurface' ELSE 'WallSurface' END AS kind FROM feature, range(6) AS r(f) WHERE envelope[2].x > envelope[1].x AND envelope[2].y > envelope[1].y AND envelope[2].z > envelope[1].z) GROUP BY kind")
def _(t):
    solid = t("feature").filter((HIGH["x"] > LOW["x"]) & (HIGH["y"] > LOW["y"]) & (HIGH["z"] > LOW["z"]))
    faces = solid.select("id", F.explode(geometry.box_faces(_box())).alias("ring"))
    return faces.groupBy(geometry.surface_by_normal(geometry.unit_normal(F.col("ring"))["z"]).alias("kind")).agg(F.count("*").alias("n"))


# validation


@query("findings", "SELECT 'duplicate_id' AS \"check\", 'ERROR' AS severity, count(*) AS n FROM (SELECT objectid FROM feature_changelog WHERE objectid IS NOT NULL GROUP BY 1 HAVING count(*) > 1) HAVING n > 0 UNION ALL SELECT 'missing_target', 'ERROR', count(*) FROM property WHERE val_feature_id IS NOT NULL AND val_feature_id NOT IN (SELECT id FROM feature) HAVING count(*) > 0 UNION ALL SELECT 'no_component', 'ERROR', count(*) FROM feature WHERE objectclass_id = 68 AND id NOT IN (SELECT feature_id FROM property WHERE val_relation_type = 1) HAVING count(*) > 0 UNION ALL SELECT 'lod_gap', 'WARNING', count(*) FROM (SELECT feature_id FROM property WHERE val_lod IS NOT NULL GROUP BY 1 HAVING max(val_lod) >= '2' AND NOT bool_or(val_lod = '1')) HAVING count(*) > 0")
def _(t):
    contains = t("property").filter("val_relation_type = 1")
    levels = t("property").filter("val_lod is not null").groupBy("feature_id").agg(F.collect_set(F.col("val_lod").cast("int")).alias("lods")).withColumn("has", F.lit(False))
    found = validation.report([
        validation.duplicate_ids(t("feature_changelog"), "objectid"), validation.missing_targets(t("property"), "id", "val_feature_id", t("feature"), "id"),
        validation.without_parts(t("feature").filter("objectclass_id = 68"), "id", contains, "feature_id"), validation.surfaces_by_lod(levels, "feature_id", "lods", "has"),
    ])
    return validation.summary(found)


# more filters, rules and systems


@query("mapping_rules", """SELECT rule, count(*) AS n FROM (SELECT CASE WHEN m_status = 'planned' THEN 'planned' WHEN contains(lower(m_roof), '1') AND m_function IS NOT NULL THEN 'roofed' WHEN regexp_matches(lower(m_usage), '^[0-9]*5') THEN 'five' END AS rule
FROM (SELECT feature_id, max(val_string) FILTER (name = 'status') AS m_status, max(val_string) FILTER (name = 'roofType') AS m_roof, max(val_string) FILTER (name = 'function') AS m_function, max(val_string) FILTER (name = 'usage') AS m_usage
FROM property WHERE val_string IS NOT NULL AND feature_id IS NOT NULL GROUP BY feature_id)) GROUP BY rule""")
def _(t):
    values = t("property").filter("val_string is not null and feature_id is not null and name in ('status', 'roofType', 'function', 'usage')").groupBy("feature_id", "name").agg(F.max("val_string").alias("v"))
    every = t("property").filter("val_string is not null and feature_id is not null").select("feature_id").distinct()
    maps = values.groupBy("feature_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("m"))
    owner = every.join(maps, "feature_id", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<string,string>")))
    rules = [
        ({"object_property": "STATUS", "object_value": "Planned"}, "planned"), ({"enabled": False, "object_property": "status"}, "never"), ({"object_property": "rooftype", "object_value": "1", "material_property": "function", "mode": "contains"}, "roofed"),
        ({"material_property": "usage", "material_value": "^[0-9]*5", "mode": "regex"}, "five"), ({}, "nothing"),
    ]
    return rollups.first_rule(owner, [(rollups.rule_holds(r, F.col("m"), F.col("m")), label) for r, label in rules], "rule").groupBy("rule").agg(F.count("*").alias("n"))


@query("xlink_in_files", """WITH m AS (SELECT member_id, file_id, pos, inner_value ->> '$.gml_id' AS gml_id FROM (SELECT *, json_extract(body, '$.*')[1] AS inner_value FROM city_object_member WHERE json_valid(body) AND json_type(body) = 'OBJECT')),
t AS (SELECT file_id, gml_id, arg_min(member_id, (pos, member_id)) AS target FROM m WHERE gml_id IS NOT NULL GROUP BY ALL)
SELECT m.member_id, t.target FROM m LEFT JOIN t ON t.file_id = m.file_id - m.pos % 2 AND t.gml_id = m.gml_id WHERE m.gml_id IS NOT NULL""")
def _(t):
    inner = F.get(F.map_values(F.from_json("body", "map<string,string>")), F.lit(0))
    members = t("city_object_member").select("member_id", "file_id", "pos", F.get_json_object(inner, "$.gml_id").alias("gml_id")).filter("gml_id is not null")
    there = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("#"), "gml_id")).otherwise(F.concat((F.col("file_id") - 1).cast("string"), F.lit("#"), "gml_id"))
    targets = members.select(F.col("file_id").alias("of"), F.col("gml_id").alias("id"), F.struct("pos", "member_id").alias("place"), F.col("member_id").alias("target"))
    return relations.resolve_in_files(members.withColumn("href", there), "href", "file_id", targets, "of", "id", "place").select("member_id", "target")


@query("change_srid", "SELECT id, true AS same, 25833 AS srid FROM feature WHERE envelope IS NOT NULL")
def _(t):
    moved = t("feature").filter("envelope is not null").select("id", F.transform("envelope", lambda p: geometry.point(p["x"] + 400000, p["y"] + 5700000, p["z"])).alias("points"))
    there = projection.change_srid(moved.withColumn("old", F.col("points")), "points", 25832, 25833)
    back = there.withColumn("again", F.transform("points", lambda p: projection.transformed(p, 25833, 25832)))
    near = lambda p, q: (F.abs(p["x"] - q["x"]) < 1e-3) & (F.abs(p["y"] - q["y"]) < 1e-3) & (p["z"] == q["z"])
    same = F.forall(F.zip_with("old", "again", near), lambda x: x)
    return back.select("id", (same & (F.col("points")[0]["x"] != F.col("old")[0]["x"])).alias("same"), "srid")


@query("label_alerts", """SELECT feature_id, array_to_string(list_filter([CASE WHEN w / n > 0.8 THEN 'mostly walls' END, CASE WHEN g = 0 THEN 'no ground' END, CASE WHEN r = 0 THEN 'no roof' END], lambda x: x IS NOT NULL), ', ') AS alerts
FROM (SELECT p.feature_id, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (o.classname = 'WallSurface') AS w, count(*) FILTER (o.classname = 'GroundSurface') AS g, count(*) FILTER (o.classname = 'RoofSurface') AS r FROM property p JOIN feature f ON f.id = p.val_feature_id JOIN objectclass o ON o.id = f.objectclass_id WHERE p.name = 'boundary' GROUP BY p.feature_id)""")
def _(t):
    kinds = t("feature").select(F.col("id").alias("val_feature_id"), "objectclass_id").join(small(t("objectclass").select(F.col("id").alias("objectclass_id"), "classname")), "objectclass_id")
    held = t("property").filter("name = 'boundary'").select("feature_id", "val_feature_id").join(kinds, "val_feature_id")
    return rollups.label_alerts(held, "feature_id", "classname").select("feature_id", F.array_join("alerts", ", ").alias("alerts"))


@query("system_info", "SELECT id, CASE WHEN c IN (4326, 4979) THEN 'WGS 84' WHEN c IN (4258, 4937) THEN 'ETRS89' WHEN c BETWEEN 25828 AND 25838 THEN 'ETRS89 / UTM zone ' || (c % 100) || 'N' END AS name, c IN (4979, 4937) AS is_3d FROM (SELECT id, CASE id % 5 WHEN 0 THEN 4326 WHEN 1 THEN 4979 WHEN 2 THEN 4937 WHEN 3 THEN 25828 + id % 11 ELSE 4258 END AS c FROM feature)")
def _(t):
    five = F.col("id") % 5
    code = F.when(five == 0, 4326).when(five == 1, 4979).when(five == 2, 4937).when(five == 3, 25828 + F.col("id") % 11).otherwise(4258)
    return t("feature").select("id", projection.system_info(code).alias("s")).select("id", "s.name", "s.is_3d")


@query("lod_search_depth", """WITH e AS (SELECT DISTINCT feature_id AS p, val_feature_id AS c FROM property WHERE val_relation_type = 1 AND val_feature_id IS NOT NULL), o AS (SELECT DISTINCT feature_id AS n, val_lod FROM property WHERE val_lod IS NOT NULL),
l AS (SELECT * FROM o UNION SELECT e.p, o.val_lod FROM e JOIN o ON o.n = e.c UNION SELECT e.p, o.val_lod FROM e JOIN e f ON f.p = e.c JOIN o ON o.n = f.c) SELECT id FROM feature WHERE id IN (SELECT n FROM l GROUP BY n HAVING max(val_lod) IN ('1', '3'))""")
def _(t):
    return Query(t("feature"), t("objectclass"), t("property")).lods([1, 3], "maximum", depth=2).df().select("id")


@query("code_descriptions", """SELECT p.id, d.definition FROM property p LEFT JOIN (SELECT c.url, e.code, arg_min(e.definition, e.id) AS definition FROM codelist_entry e JOIN codelist c ON c.id = e.codelist_id WHERE c.url IS NOT NULL AND e.code IS NOT NULL AND e.definition IS NOT NULL GROUP BY ALL) d
ON d.url = p.val_codespace AND d.code = p.val_string WHERE p.val_codespace IS NOT NULL""")
def _(t):
    lists = t("codelist").filter("url is not null").select(F.col("id").alias("codelist_id"), "url")
    known = t("codelist_entry").filter("code is not null and definition is not null").join(lists, "codelist_id").groupBy("url", "code").agg(F.min_by("definition", "id").alias("definition"))
    used = t("property").filter("val_codespace is not null").select("id", F.col("val_codespace").alias("url"), F.col("val_string").alias("code"))
    return used.join(known, ["url", "code"], "left").select("id", "definition")


@query("database_report", f"""SELECT 'features' AS section, CASE WHEN termination_date IS NULL THEN 'active' ELSE 'terminated' END AS name, count(*) AS n FROM feature GROUP BY 2
UNION ALL SELECT 'types', classname, count(*) FROM feature JOIN objectclass o ON o.id = objectclass_id WHERE termination_date IS NULL GROUP BY 2
UNION ALL SELECT 'lods', val_lod, count(DISTINCT feature_id) FROM property WHERE val_lod IS NOT NULL GROUP BY 2 UNION ALL SELECT 'attributes', name, count(*) FROM property GROUP BY 2
UNION ALL SELECT 'addresses', 'all', count(*) FROM address UNION ALL SELECT 'codelists', codelist_type, count(*) FROM codelist GROUP BY 2
UNION ALL SELECT 'extent', 'width', CAST(floor(max(envelope[2].x) - min(envelope[1].x)) AS BIGINT) FROM feature""")
def _(t):
    f, p = t("feature"), t("property")
    part = lambda df, section, name, n: df.groupBy(name.cast("string").alias("name")).agg(n.alias("n")).select(F.lit(section).alias("section"), "name", "n")
    count, none = F.count("*"), F.lit(None).cast("timestamp")
    named = f.filter(F.col("termination_date").isNull()).join(small(t("objectclass").select(F.col("id").alias("objectclass_id"), "classname")), "objectclass_id")
    parts = [
        part(f, "features", F.when(F.col("termination_date").isNull() | (F.col("termination_date") == none), "active").otherwise("terminated"), count), part(named, "types", F.col("classname"), count),
        part(p.filter("val_lod is not null").select("feature_id", "val_lod"), "lods", F.col("val_lod"), F.count_distinct("feature_id")), part(p, "attributes", F.col("name"), count),
        t("address").agg(count.alias("n")).select(F.lit("addresses").alias("section"), F.lit("all").alias("name"), "n"), part(t("codelist"), "codelists", F.col("codelist_type"), count),
        f.agg(F.floor(F.max(HIGH["x"]) - F.min(LOW["x"])).alias("n")).select(F.lit("extent").alias("section"), F.lit("width").alias("name"), "n"),
    ]
    return reduce(DataFrame.unionAll, parts)


@query("attached_parts", """WITH new AS (SELECT DISTINCT feature_id AS parent, val_feature_id AS child, name FROM property WHERE val_relation_type = 0 AND name = 'relatedTo' AND val_feature_id IS NOT NULL AND feature_id IS NOT NULL),
k AS (SELECT id, feature_id, val_feature_id, name FROM property WHERE coalesce(NOT (val_relation_type = 1 AND val_feature_id IN (SELECT child FROM new)), true))
SELECT id, feature_id, val_feature_id, name FROM k UNION ALL SELECT 9999999 + row_number() OVER (ORDER BY parent, child, name), parent, child, name FROM new""")
def _(t):
    p = t("property")
    parts = p.filter("val_relation_type = 0 and name = 'relatedTo' and val_feature_id is not null and feature_id is not null").select(F.col("feature_id").alias("parent"), F.col("val_feature_id").alias("child"), "name")
    return relations.attach_parts(p, parts, 10_000_000).select("id", "feature_id", "val_feature_id", "name")


@query("next_suffixes", r"""SELECT base, base || '_' || (coalesce(max(n), 0) + 1) AS next FROM (SELECT DISTINCT name AS base FROM property) LEFT JOIN (SELECT name AS b, id % 90 AS n FROM property WHERE id % 90 > 4) ON b = base GROUP BY base""")
def _(t):
    p = t("property")
    ids = p.select(F.when(F.col("id") % 90 > 4, F.concat_ws("_", "name", (F.col("id") % 90).cast("string"))).otherwise(F.col("name")).alias("i"))
    return relations.next_suffixes(ids, "i", p.select(F.col("name").alias("base")), "base")


@query("load_terminate", """SELECT objectid AS id, count(*) AS n, count(termination_date) AS n_ended FROM (SELECT objectid, CASE WHEN objectid IN (SELECT objectid FROM feature_changelog WHERE objectid IS NOT NULL) AND termination_date IS NULL THEN TIMESTAMP '2024-01-01' ELSE CAST(termination_date AS TIMESTAMP) END AS termination_date
FROM feature UNION ALL SELECT objectid, NULL FROM feature_changelog WHERE objectid IS NOT NULL) GROUP BY 1""")
def _(t):
    new = t("feature_changelog").filter("objectid is not null").select("objectid", F.lit(None).cast("timestamp").alias("termination_date"))
    done = relations.load_features(t("feature").select("objectid", "termination_date"), new, "objectid", "terminate", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return done.groupBy(F.col("objectid").alias("id")).agg(F.count("*").alias("n"), F.count("termination_date").alias("n_ended"))


@query("id_filter_keep_missing", "SELECT id FROM feature_changelog WHERE objectid IS NULL OR objectid IN (SELECT objectid FROM feature)")
def _(t):
    return filters.by_id(t("feature_changelog"), "objectid", t("feature").select("objectid"), "keep").select("id")


@query("crs_codes", rf"""SELECT id, CAST(nullif(regexp_extract(lower(name), 'epsg:+([0-9]+)', 1), '') AS INTEGER) AS code, name LIKE 'local%' = false AND name NOT LIKE '%grid%' AS known FROM ({_SPELLED})""")
def _(t):
    names = t("feature").select("id", (F.col("id") % len(_NOTATIONS)).alias("k")).select("id", F.expr(_FILLED.replace("VARCHAR", "STRING")).alias("name"))
    return names.select("id", crs.epsg_number(F.col("name")).alias("code"), crs.same_crs(F.col("name"), F.upper("name")).alias("known"))


_GUID = "substr(sha256(CAST(id AS VARCHAR)), 1, CASE WHEN id % 4 = 0 THEN 21 ELSE 22 END)"


@query("ifc_ids", f"SELECT id, id % 4 <> 0 AS valid, CASE WHEN id % 4 <> 0 THEN {_GUID} END AS guid, 'ifc://guid/' || {_GUID} AS uri FROM feature")
def _(t):
    guid = F.substring(F.sha2(F.col("id").cast("string"), 256), F.lit(1), F.when(F.col("id") % 4 == 0, 21).otherwise(22))
    uri = F.when(F.col("id") % 3 == 0, text.ifc_uri(F.col("g"))).when(F.col("id") % 3 == 1, F.concat(F.lit("ifc:guid:"), "g")).otherwise(F.col("g"))
    return t("feature").select("id", guid.alias("g")).select("id", text.is_ifc_guid(F.col("g")).alias("valid"), text.ifc_guid(uri).alias("guid"), text.ifc_uri(F.col("g")).alias("uri"))


@query("tag_texts", """SELECT id, name AS local, CASE WHEN val_string IS NULL OR trim(val_string) = '' THEN 'Unknown' WHEN id % 3 = 0 THEN 'WallSurface' ELSE val_string END AS surface, TRY_CAST(val_double AS DOUBLE) AS number, coalesce(nullif(trim(val_uom), ''), 'm') AS uom,
CASE WHEN id % 2 = 0 THEN strftime(loaded_at, '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS loaded FROM property""")
def _(t):
    p = t("property")
    label = F.when((F.col("id") % 3 == 0) & (F.trim("val_string") != ""), F.concat("val_string", F.lit("WallSurface"))).otherwise(F.col("val_string"))
    measure = text.measure(F.col("val_double").cast("string"), F.col("val_uom"))
    shown = F.when(F.col("id") % 2 == 0, F.date_format("loaded_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise("no time")
    return p.select("id", text.local_name(F.concat(F.lit("{http://x/y}"), "name")).alias("local"), text.surface_type(label).alias("surface"), measure["value"].alias("number"), measure["uom"].alias("uom"), text.xs_datetime(shown).alias("loaded"))


@query("degenerate_rings", "SELECT id, CASE WHEN w = 0 OR d = 0 THEN 'repeated point' WHEN w * d < 1e-6 THEN 'no area' END AS why FROM (SELECT id, envelope[2].x - envelope[1].x AS w, envelope[2].y - envelope[1].y AS d FROM feature WHERE envelope IS NOT NULL)")
def _(t):
    corners = [geometry.point(x, y, LOW["z"]) for x, y in ((LOW["x"], LOW["y"]), (HIGH["x"], LOW["y"]), (HIGH["x"], HIGH["y"]), (LOW["x"], HIGH["y"]), (LOW["x"], LOW["y"]))]
    return t("feature").filter("envelope is not null").select("id", F.array(*corners).alias("ring")).select("id", geometry.degenerate(F.col("ring")).alias("why"))


@query("turned_surfaces", """SELECT severity, message, count(*) AS n FROM (SELECT 'WARNING' AS severity, CASE WHEN f = 0 THEN 'RoofSurface looks down' ELSE 'GroundSurface looks up' END AS message FROM feature, range(2) AS r(f)
WHERE id % 2 = 1 AND envelope[2].x > envelope[1].x AND envelope[2].y > envelope[1].y AND envelope[2].z > envelope[1].z) GROUP BY ALL""")
def _(t):
    solid = t("feature").filter((HIGH["x"] > LOW["x"]) & (HIGH["y"] > LOW["y"]) & (HIGH["z"] > LOW["z"]))
    faces = solid.select("id", F.posexplode(geometry.box_faces(_box())).alias("face", "ring")).filter("face < 2")
    turned = (F.col("id") % 2 == 1) == (F.col("face") == 0)
    named = faces.select("id", F.when(turned, "RoofSurface").otherwise("GroundSurface").alias("kind"), geometry.unit_normal(F.col("ring"))["z"].alias("nz"))
    return validation.turned_surfaces(named, "id", "kind", "nz").groupBy("severity", "message").agg(F.count("*").alias("n"))
