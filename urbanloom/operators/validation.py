"""Checks of a city model, each a table of findings (check, severity, object_id, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.functions.geometry import degenerate


def finding(df: DataFrame, check: str, severity: str, object_id: Column, message: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), object_id.cast("string").alias("object_id"), message.alias("message"))


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once."""
    twice = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    return finding(twice, "duplicate_id", "ERROR", F.col(key), F.concat(F.col("n").cast("string"), F.lit(" objects")))


def missing_targets(refs: DataFrame, source: str, target: str, targets: DataFrame, target_id: str) -> DataFrame:
    """References to nothing."""
    lost = refs.filter(F.col(target).isNotNull()).join(targets.select(F.col(target_id).alias(target)).distinct(), target, "left_anti")
    return finding(lost, "missing_target", "ERROR", F.col(source), F.concat(F.lit("refers to "), F.col(target).cast("string")))


def bad_rings(rings: DataFrame, key: str, points: str) -> DataFrame:
    """Degenerate rings."""
    why = rings.withColumn("__why", degenerate(F.col(points))).filter(F.col("__why").isNotNull())
    return finding(why, "degenerate_ring", "ERROR", F.col(key), F.col("__why"))


def turned_surfaces(surfaces: DataFrame, key: str, kind: str, nz: str) -> DataFrame:
    """Grounds that look up and roofs that look down."""
    up = (F.col(kind) == "GroundSurface") & (F.col(nz) > 0.1)
    down = (F.col(kind) == "RoofSurface") & (F.col(nz) < -0.1)
    return finding(surfaces.filter(up | down), "turned_surface", "WARNING", F.col(key), F.concat(F.col(kind), F.when(up, " looks up").otherwise(" looks down")))


def surfaces_by_lod(levels: DataFrame, key: str, lods: str, has_surfaces: str) -> DataFrame:
    """Features with nothing above LoD 1 that have boundary surfaces; features with LoD 2 or more but no LoD 1."""
    low = levels.filter((F.array_max(lods) <= 1) & F.col(has_surfaces))
    gap = levels.filter((F.array_max(lods) >= 2) & ~F.array_contains(lods, 1))
    return finding(low, "surface_below_lod2", "ERROR", F.col(key), F.lit("boundary surfaces below LoD 2")).unionAll(finding(gap, "lod_gap", "WARNING", F.col(key), F.lit("LoD 2 or more without LoD 1")))


def without_parts(parents: DataFrame, key: str, links: DataFrame, parent: str) -> DataFrame:
    """Objects that need a component and have none."""
    alone = parents.join(links.select(F.col(parent).alias(key)).distinct(), key, "left_anti")
    return finding(alone, "no_component", "ERROR", F.col(key), F.lit("no component"))


def outside_unit(uvs: DataFrame, key: str, uv: str) -> DataFrame:
    """Texture coordinates outside 0 to 1."""
    off = uvs.filter(F.exists(uv, lambda p: (p["u"] < 0) | (p["u"] > 1) | (p["v"] < 0) | (p["v"] > 1)))
    return finding(off, "texture_outside", "WARNING", F.col(key), F.lit("texture coordinates outside 0 to 1"))


def report(findings: list[DataFrame]) -> DataFrame:
    """All findings."""
    return reduce(DataFrame.unionAll, findings)


def summary(findings: DataFrame) -> DataFrame:
    """Findings by check and severity; a missing check counts as unknown."""
    return findings.groupBy(F.coalesce("check", F.lit("unknown")).alias("check"), "severity").agg(F.count("*").alias("n"))
