"""References between objects, closures along them, and changes between states of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.functions.geometry import affine, shifted
from urbanloom.functions.text import reference_id
from urbanloom.operators.rollups import numbered
from urbanloom.session import cut


def resolve(refs: DataFrame, href: str, targets: DataFrame, target_id: str) -> DataFrame:
    """``refs`` with the columns of the target that ``href`` names, null if it dangles; a target counts once."""
    row = F.struct(*targets.columns)
    names = targets.filter(F.col(target_id).isNotNull()).groupBy(F.col(target_id).alias("__id")).agg(F.min(row).alias("__row")).select("__row.*")
    return refs.withColumn("__ref", reference_id(F.col(href))).join(names, F.col("__ref") == F.col(target_id), "left").drop("__ref")


def resolve_in_files(refs: DataFrame, href: str, base: str, targets: DataFrame, file: str, target_id: str, order: str) -> DataFrame:
    """``refs`` with the columns of the target that ``href`` names in its file, null if it dangles.

    ``file#id`` names an id of that file; ``#id`` and a bare id one of the file ``base`` that the reference stands in. Of
    several targets with one id in a file the first by ``order`` counts.
    """
    row = F.struct(*targets.columns)
    keyed = targets.select(F.col(file).cast("string").alias("__file"), F.col(target_id).alias("__id"), F.col(order).alias("__order"), row.alias("__row")).dropna(subset=["__file", "__id"])
    first = keyed.groupBy("__file", "__id").agg(F.min_by("__row", F.struct("__order", "__row")).alias("__target"))
    text = F.trim(F.col(href))
    named = F.when(text.contains("#"), F.nullif(F.substring_index(text, "#", 1), F.lit("")))
    asked = refs.withColumn("__file", F.coalesce(named, F.col(base).cast("string"))).withColumn("__id", reference_id(text))
    return asked.join(first, ["__file", "__id"], "left").drop("__file", "__id").select("*", *[F.col(f"__target.{c}").alias(c) for c in targets.columns if c not in refs.columns]).drop("__target")


def placed_templates(instances: DataFrame, shapes: DataFrame) -> DataFrame:
    """``instances`` (template, matrix, x, y, z, ...) with ``points``: each ring (template, points) of the template under the matrix, moved to the reference point.

    A null matrix changes nothing; an instance whose template isn't there, or has no reference point, has null points.
    """
    both = instances.join(shapes.select("template", F.col("points").alias("__ring")), "template", "left")
    turned = affine(F.col("__ring"), F.col("matrix"))
    moved = F.when(F.col("x").isNotNull() & F.col("__ring").isNotNull(), shifted(turned, -F.col("x"), -F.col("y"), -F.col("z")))
    return both.withColumn("points", moved).drop("__ring")


def dangling(refs: DataFrame, href: str, targets: DataFrame, target_id: str) -> DataFrame:
    """``refs`` that name no target; null and empty references aren't cases."""
    named = refs.withColumn("__ref", reference_id(F.col(href))).filter(F.col("__ref") != "")
    return named.join(targets.select(F.col(target_id).alias("__ref")).distinct(), "__ref", "left_anti").drop("__ref")


def referrers(refs: DataFrame, source: str, target: str) -> DataFrame:
    """(target, n_sources, first_source): how many different sources refer to each target, and the smallest of them."""
    pairs = refs.select(F.col(source).alias("s"), F.col(target).alias("t")).dropna().distinct()
    return pairs.groupBy(F.col("t").alias(target)).agg(F.count("*").alias("n_sources"), F.min("s").alias("first_source"))


def reached(links: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes that can be reached from ``start`` (node) over ``links`` (p, c), the start included; cycles end it.

    Works on the frontier alone: a round costs one join of the new nodes with the links.
    """
    links = cut(links.select("p", "c").dropna().distinct())
    seen = frontier = cut(start.select("node").dropna().distinct())
    while True:
        frontier = cut(links.join(frontier.select(F.col("node").alias("p")), "p").select(F.col("c").alias("node")).distinct().join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionAll(frontier))


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, modified: str, ended: str) -> DataFrame:
    """(key, change) between two states of a table: INSERT, DELETE, UPDATE or TERMINATE.

    A row of both states is a change only if ``modified`` differs (null equals null); it is TERMINATE if ``ended`` is set
    now, as is a new row that is ended.
    """
    a = before.select(F.col(key).alias("k"), F.col(modified).alias("m0"), F.lit(1).alias("has0"))
    b = after.select(F.col(key).alias("k"), F.col(modified).alias("m1"), F.col(ended).alias("e1"), F.lit(1).alias("has1"))
    both = a.join(b, "k", "full")
    change = (
        F.when(F.col("has1").isNull(), "DELETE")
        .when(F.col("has0").isNotNull() & F.col("m0").eqNullSafe(F.col("m1")), F.lit(None))
        .when(F.col("e1").isNotNull(), "TERMINATE")
        .when(F.col("has0").isNull(), "INSERT")
        .otherwise("UPDATE")
    )
    return both.select(F.col("k").alias(key), change.alias("change")).filter(F.col("change").isNotNull())


def load_features(target: DataFrame, new: DataFrame, key: str, mode: str, at: Column | None = None) -> DataFrame:
    """``target`` after loading ``new`` (same columns): import_all appends; skip leaves out known keys; delete replaces rows of known keys; terminate ends them and appends."""
    new = new.select(*target.columns)
    known = new.select(key).dropna().distinct()
    if mode == "import_all":
        return target.unionByName(new)
    if mode == "skip":
        return target.unionByName(new.join(target.select(key).dropna().distinct(), key, "left_anti").select(*target.columns))
    if mode == "delete":
        return target.join(known, key, "left_anti").select(*target.columns).unionByName(new)
    if mode == "terminate":
        hit = target.join(known.withColumn("__hit", F.lit(True)), key, "left")
        ended = hit.withColumn("termination_date", F.when(F.col("__hit") & F.col("termination_date").isNull(), at).otherwise(F.col("termination_date")))
        return ended.select(*target.columns).unionByName(new)
    raise ValueError(mode)


def attach_parts(prop: DataFrame, parts: DataFrame, first_id: int) -> DataFrame:
    """``prop`` with a containing property for each of ``parts`` (parent, child, name); a child that is contained elsewhere is moved.

    New rows are numbered from ``first_id`` in the order of (parent, child); columns that they don't have are null.
    """
    free = detach_parts(prop, parts.select("child"))
    placed = numbered(parts.select("parent", "child", "name").distinct().withColumn("all", F.lit(0)).withColumn("order", F.struct("parent", "child", "name")), "all", "order", "k")
    new = placed.select((F.col("k") + (first_id - 1)).alias("id"), F.col("parent").alias("feature_id"), F.col("child").alias("val_feature_id"), "name", F.lit(1).alias("val_relation_type"))
    kinds = dict(prop.dtypes)
    return free.unionByName(new.select(*[F.col(c).cast(kinds[c]) for c in new.columns if c in kinds]), allowMissingColumns=True).select(*prop.columns)


def detach_parts(prop: DataFrame, parts: DataFrame) -> DataFrame:
    """``prop`` without the properties that contain one of ``parts`` (child)."""
    gone = parts.select(F.col("child").alias("val_feature_id"), F.lit(1).alias("val_relation_type")).distinct()
    return prop.join(gone, ["val_feature_id", "val_relation_type"], "left_anti").select(*prop.columns)


def next_suffixes(ids: DataFrame, column: str, bases: DataFrame, base: str) -> DataFrame:
    """(base, next): for each id of ``bases`` the first ``base_N`` above all that there are, from 1 on."""
    last = F.regexp_extract(column, "_([0-9]{1,9})$", 1)
    used = ids.select(F.regexp_replace(column, "_[0-9]{1,9}$", "").alias(base), F.nullif(last, F.lit("")).cast("int").alias("n")).dropna().groupBy(base).agg(F.max("n").alias("n"))
    return bases.select(base).distinct().join(used, base, "left").select(base, F.concat(base, F.lit("_"), (F.coalesce("n", F.lit(0)) + 1).cast("string")).alias("next"))


def by_theme(looks: DataFrame, themes: list[str] | None) -> DataFrame:
    """Appearances (theme) of the given themes; an empty list keeps none, None keeps all, an empty name stands for those without a theme."""
    if themes is None:
        return looks
    return looks.filter(F.coalesce("theme", F.lit("")).isin(themes)) if themes else looks.limit(0)
