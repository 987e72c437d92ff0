"""Aggregations: extents, histograms, modes, grids, edges, and rules by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanloom.session import cut, partitions

CORNERS = ["min_x", "min_y", "min_z", "max_x", "max_y", "max_z"]


def extent_of(low: Column, high: Column) -> list[Column]:
    """Aggregates of the extent over rows with corners ``low`` and ``high``."""
    return [F.min(low[k]).alias(f"min_{k}") for k in "xyz"] + [F.max(high[k]).alias(f"max_{k}") for k in "xyz"]


def merge_extents(prefix: str = "") -> list[Column]:
    """Aggregates of the extent over rows that have the columns CORNERS."""
    return [(F.min if c.startswith("min") else F.max)(prefix + c).alias(c) for c in CORNERS]


def histogram(df: DataFrame, column: str, values: list, out: str = "n") -> DataFrame:
    """Counts of ``values`` in a column, zeros included."""
    every = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} {dict(df.dtypes)[column]}")
    counts = df.filter(F.col(column).isin(values)).groupBy(column).agg(F.count("*").alias(out))
    return every.join(counts, column, "left").select(column, F.coalesce(out, F.lit(0)).cast("long").alias(out))


def commonest(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """The commonest value by group, of equally common ones the highest; nulls don't count."""
    return df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("__n")).groupBy(*group).agg(F.max_by(value, F.struct("__n", value)).alias(out))


def first_rows(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``; combines before the shuffle, so repeated keys don't pile up in a task."""
    every = F.struct(*df.columns)
    return df.groupBy(*[F.col(c).alias(f"__{c}") for c in key]).agg(F.min_by(every, F.struct(*order)).alias("__row")).select("__row.*")


def numbered(df: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """``df`` with the place of each row among those of its key, from 1 on, by ``order`` (unique within a key).

    Ranges of (key, order) spread a hot key over tasks: each range numbers its own rows, and a small table of the ranges'
    counts gives what comes before.
    """
    parts = cut(df.repartitionByRange(partitions(df.sparkSession), key, order).withColumn("__part", F.spark_partition_id()))
    counts = parts.groupBy(key, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(key).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(key).alias("__key"), F.col("__part").alias("__of"), before.alias("__before"))
    local = parts.withColumn("__k", F.row_number().over(W.partitionBy(key, "__part").orderBy(order)))
    placed = local.join(starts, local[key].eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__of")))
    return placed.withColumn(out, (F.col("__before") + F.col("__k")).cast("long")).drop("__part", "__n", "__key", "__of", "__before", "__k")


def duplicates(df: DataFrame, key: str, shown: str) -> DataFrame:
    """Keys that occur more than once, how often, and the distinct values of ``shown`` in order."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col(shown).cast("string"))), ",").alias("shown")).filter("n > 1")


def grid_rows(points: DataFrame, group: str, y: str, tolerance: float = 0.01) -> DataFrame:
    """(group, y, n, row): rows of a point grid by group: heights in order are one row until the next is more than ``tolerance`` further.

    Heights are counted first; ranges of (group, height) then spread a hot group over tasks, and a small table of the
    ranges' ends gives what comes before each.
    """
    counted = points.groupBy(F.col(group).alias("g"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    parts = cut(counted.repartitionByRange(partitions(points.sparkSession), "g", "y").withColumn("part", F.spark_partition_id()))
    inside = W.partitionBy("g", "part").orderBy("y")
    ends = parts.groupBy("g", "part").agg(F.max("y").alias("end"))
    before = W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(F.col("g").alias("g1"), F.col("part").alias("p1"), F.max("end").over(before).alias("before"))
    placed = parts.withColumn("last", F.lag("y").over(inside)).join(ends, F.col("g").eqNullSafe(F.col("g1")) & (F.col("part") == F.col("p1"))).drop("g1", "p1")
    jumped = cut(placed.withColumn("jump", F.when(F.col("y") - F.coalesce("last", "before") > tolerance, 1).otherwise(0)))
    sums = jumped.groupBy("g", "part").agg(F.sum("jump").alias("jumps"))
    sums = sums.select(F.col("g").alias("g1"), F.col("part").alias("p1"), F.coalesce(F.sum("jumps").over(before), F.lit(0)).alias("ahead"))
    local = jumped.withColumn("k", F.sum("jump").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    out = local.join(sums, F.col("g").eqNullSafe(F.col("g1")) & (F.col("part") == F.col("p1")))
    return out.select(F.col("g").alias(group), F.col("y").alias(y), "n", (F.col("k") + F.col("ahead")).alias("row"))


def regular_grids(points: DataFrame, group: str, y: str, tolerance: float = 0.01) -> DataFrame:
    """(group, n_rows, regular): whether all rows of the grid have as many points."""
    sizes = grid_rows(points, group, y, tolerance).groupBy(group, "row").agg(F.sum("n").alias("n"))
    return sizes.groupBy(group).agg(F.count("*").alias("n_rows"), (F.min("n") == F.max("n")).alias("regular"))


def grid_texts(points: DataFrame, group: str, y: str, x: str, z: str, tolerance: float = 0.01) -> DataFrame:
    """(group, n_rows, n_columns, values) of regular grids: the heights z as one text, by row and then by x; other groups have none.

    A grid's text is one value of the result; irregular groups are dropped before anything is gathered.
    """
    regular = regular_grids(points, group, y, tolerance).filter("regular").select(group, "n_rows")
    rows_ = grid_rows(points, group, y, tolerance).select(group, y, "row")
    placed = points.join(regular, group).join(rows_, [group, y])
    values = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", x, z))), lambda p: p[z].cast("string")), " ")
    return placed.groupBy(group).agg(F.max("n_rows").alias("n_rows"), (F.count("*") / F.max("n_rows")).cast("int").alias("n_columns"), values.alias("values"))


def open_edges(rings: DataFrame, solid: str, points: str, digits: int = 6) -> DataFrame:
    """(solid, n_faces, n_bad_edges): edges that don't belong to exactly two faces of their solid. Direction doesn't matter."""
    at = lambda p: F.struct(F.bround(p["x"], digits).alias("x"), F.bround(p["y"], digits).alias("y"), F.bround(p["z"], digits).alias("z"))
    edges = F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda i: F.array_sort(F.array(at(F.element_at(points, i)), at(F.element_at(points, i + 1)))))
    each = rings.filter(F.size(points) >= 2).select(solid, F.explode(edges).alias("edge"))
    uses = each.groupBy(solid, "edge").agg(F.count("*").alias("uses"))
    bad = uses.groupBy(solid).agg(F.count_if(F.col("uses") != 2).alias("n_bad_edges"))
    return rings.groupBy(solid).agg(F.count("*").alias("n_faces")).join(bad, solid, "left").select(solid, "n_faces", F.coalesce("n_bad_edges", F.lit(0)).alias("n_bad_edges"))


def first_rule(df: DataFrame, rules: list[tuple[Column, str]], out: str) -> DataFrame:
    """``df`` with the label of the first rule that holds, null if none does. Rules are (condition, label) in order."""
    return df.withColumn(out, F.coalesce(*[F.when(condition, label) for condition, label in rules]) if rules else F.lit(None).cast("string"))


def value_matches(actual: Column, expected: str, mode: str = "exact", case_sensitive: bool = False) -> Column:
    """Whether a value fits: blank and ``*`` fit all; exact, contains or regex; a missing value fits nothing else."""
    if expected.strip() in ("", "*"):
        return F.lit(True)
    left, right = (actual, expected) if case_sensitive else (F.lower(actual), expected.lower())
    if mode == "exact":
        met = left == right
    elif mode == "contains":
        met = left.contains(right)
    else:
        met = actual.rlike(expected if case_sensitive else f"(?i){expected}")
    return F.coalesce(met, F.lit(False))


def custom_value(properties: Column, name: str, case_sensitive: bool = False) -> Column:
    """Value of a property in a map of texts: under its own name, else under the first name that differs in case only; null if there is none."""
    own = F.try_element_at(properties, F.lit(name))
    if case_sensitive:
        return own
    like = F.array_sort(F.filter(F.map_keys(properties), lambda k: F.lower(k) == name.lower()))
    return F.coalesce(own, F.try_element_at(properties, F.try_element_at(like, F.lit(1))))


def criterion_holds(properties: Column, name: str, expected: str, mode: str = "exact", case_sensitive: bool = False) -> Column:
    """Whether a property fits (see ``value_matches``); a criterion without a name holds, a property that isn't there doesn't fit."""
    if not name.strip():
        return F.lit(True)
    found = custom_value(properties, name.strip(), case_sensitive)
    return F.coalesce(found.isNotNull() & value_matches(found, expected, mode, case_sensitive), F.lit(False))


def rule_holds(rule: dict, owner: Column, material: Column) -> Column:
    """Whether a rule (enabled, object_property, object_value, material_property, material_value, mode, case_sensitive) holds for both maps; one without any property never does."""
    of = lambda k, default="": rule.get(k, default)
    if not of("enabled", True) or not (of("object_property").strip() or of("material_property").strip()):
        return F.lit(False)
    more = (of("mode", "exact"), of("case_sensitive", False))
    return criterion_holds(owner, of("object_property"), of("object_value"), *more) & criterion_holds(material, of("material_property"), of("material_value"), *more)


def has_semantics(properties: Column, names: list[str]) -> Column:
    """Whether any of the properties ``names`` has a value that isn't blank."""
    return F.exists(F.array(*[F.lit(n) for n in names]), lambda k: F.coalesce(F.trim(F.try_element_at(properties, k)), F.lit("")) != "")


def unique_names(df: DataFrame, base: str, order: str, out: str) -> DataFrame:
    """``df`` with a name of its own for each row: the first of a base keeps it, others get _2, _3, ... but no name that is a base itself.

    order: unique among the rows of a base. A hot base is numbered in ranges; see ``numbered``.
    """
    bases = cut(df.select(F.col(base).alias("__base")).distinct())
    number = F.expr("try_cast(regexp_extract(__base, '_([1-9][0-9]*)$', 1) as long)")
    taken = bases.select(F.regexp_replace("__base", "_[1-9][0-9]*$", "").alias("__stem"), number.alias("__n")).filter("__n >= 2")
    taken = taken.groupBy("__stem").agg(F.array_sort(F.collect_set("__n")).alias("__taken"))
    placed = numbered(df, base, order, "__place").join(taken, F.col(base) == F.col("__stem"), "left")
    free = F.aggregate(F.coalesce("__taken", F.array().cast("array<bigint>")), F.col("__place"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    return placed.withColumn(out, F.when(F.col("__place") == 1, F.col(base)).otherwise(F.concat(base, F.lit("_"), free.cast("string")))).drop("__place", "__stem", "__taken")


def timing_stats(df: DataFrame, operation: str, seconds: str) -> DataFrame:
    """(operation, n, total, mean, least, most) of measured times."""
    return df.groupBy(operation).agg(F.count(seconds).alias("n"), F.sum(seconds).alias("total"), F.avg(seconds).alias("mean"), F.min(seconds).alias("least"), F.max(seconds).alias("most"))


def label_alerts(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, alerts) of objects by their faces' labels: mostly walls, no ground, no roof."""
    n, count = F.count("*"), lambda k: F.count_if(F.col(label) == k)
    alerts = F.array_compact(F.array(F.when(count("WallSurface") / n > 0.8, "mostly walls"), F.when(count("GroundSurface") == 0, "no ground"), F.when(count("RoofSurface") == 0, "no roof")))
    return labels.groupBy(key).agg(alerts.alias("alerts"))
