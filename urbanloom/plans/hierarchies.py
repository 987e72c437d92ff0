"""Problem 1: containment of features, to unknown depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanloom.operators.hierarchy import build, cycles, descendants, hierarchy, links
from urbanloom.session import cut, table


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    contains = table(spark, sf_dir, "property").filter(F.col("val_relation_type") == 1)
    return links(contains, "feature_id", "val_feature_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that contain themselves, by the smallest feature of their group."""
    found = cycles(cut(_links(spark, sf_dir)))
    return found.select(F.col("cycle").alias("cycle_id"), F.col("node").alias("feature_id"))


def p1_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth, root and number of descendants of each feature that is on no cycle."""
    _, paths, _ = build(_links(spark, sf_dir))
    return hierarchy(paths).select(
        F.col("node").alias("feature_id"), F.col("parent").alias("parent_id"), F.col("root").alias("root_id"), "depth", "n_descendants", F.concat_ws("/", F.col("path").cast("array<string>")).alias("path")
    )


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a feature and what it contains, directly or not, without features on cycles."""
    _, paths, extra = build(_links(spark, sf_dir))
    return descendants(paths, extra).select(F.col("node").alias("feature_id"), F.col("descendant").alias("descendant_id"))


QUERIES = {"p1_found": p1_found, "p1_hierarchy": p1_hierarchy, "p1_descendants": p1_descendants}

_E = "SELECT DISTINCT feature_id AS p, val_feature_id AS c FROM property WHERE val_relation_type = 1 AND feature_id IS NOT NULL AND val_feature_id IS NOT NULL"
_REACH = f"WITH RECURSIVE e AS ({_E}), r(a, b) AS (SELECT p, c FROM e UNION SELECT r.a, e.c FROM r JOIN e ON r.b = e.p)"
_FREE = f"""{_REACH}, x AS (SELECT a AS n FROM r WHERE a = b), f AS (SELECT * FROM e WHERE p NOT IN (SELECT n FROM x) AND c NOT IN (SELECT n FROM x)),
t AS (SELECT c, min(p) AS p FROM f GROUP BY c), n AS (SELECT p AS n FROM e UNION SELECT c FROM e)"""
SQL = {
    "p1_found": f"""{_REACH} SELECT least(x.a, min(y.b)) AS cycle_id, x.a AS feature_id FROM r x JOIN r y ON y.a = x.a JOIN r z ON z.a = y.b AND z.b = y.a
WHERE x.a = x.b GROUP BY x.a""",
    "p1_hierarchy": f"""{_FREE}, h AS (
SELECT n AS feature_id, CAST(NULL AS BIGINT) AS parent_id, n AS root_id, CAST(0 AS BIGINT) AS depth, CAST(n AS VARCHAR) AS path FROM n WHERE n NOT IN (SELECT n FROM x) AND n NOT IN (SELECT c FROM t)
UNION ALL SELECT t.c, t.p, h.root_id, h.depth + 1, h.path || '/' || t.c FROM h JOIN t ON t.p = h.feature_id)
SELECT h.feature_id, h.parent_id, h.root_id, h.depth, (SELECT count(*) FROM h g WHERE starts_with(g.path, h.path || '/')) AS n_descendants, h.path FROM h""",
    "p1_descendants": f"{_FREE}, q(a, b) AS (SELECT p, c FROM f UNION SELECT q.a, f.c FROM q JOIN f ON q.b = f.p) SELECT a AS feature_id, b AS descendant_id FROM q",
}
