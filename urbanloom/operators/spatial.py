"""Joins by place: extents that touch, nearest extents, points in polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanloom.functions.geometry import box_gap
from urbanloom.session import cut, small as sized


def _levelled(df: DataFrame, b: Column, reach: float, cell: float) -> DataFrame:
    """``df`` with its own grid level: that of the smallest cell as long as the extent with ``reach`` around it."""
    size = F.greatest(b["max_x"] - b["min_x"], b["max_y"] - b["min_y"]) + 2 * reach
    return df.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(size / F.lit(cell)))).cast("int"))


def _cells(b: Column, level: Column, reach: float, cell: float) -> Column:
    """Cells of a level that an extent with ``reach`` around it meets, as array of (cx, cy)."""
    side = F.lit(cell) * F.pow(F.lit(2.0), level)
    at = lambda v: F.floor(v / side).cast("long")
    xs, ys = F.sequence(at(b["min_x"] - reach), at(b["max_x"] + reach)), F.sequence(at(b["min_y"] - reach), at(b["max_y"] + reach))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def touching_pairs(boxes: DataFrame, key: str, box: str, tolerance: float = 0.0, cell: float = 16.0) -> DataFrame:
    """Pairs (a, b, gap), a < b, of extents that are at most ``tolerance`` apart in space.

    A grid of levels: an extent lies in a few cells of the level of its own size, and meets smaller ones that are lifted to
    that level, so neither large extents nor mixed sizes make many copies. Each pair is found in exactly one cell (that of
    the larger of the two low corners), so no deduplication is needed. Rows without key or extent meet nothing.
    """
    slim = _levelled(boxes.select(F.col(key).alias("k"), F.col(box).alias("b")).dropna(), F.col("b"), tolerance, cell)
    slim = cut(slim)
    levels = slim.select("level").distinct()  # a few dozen at most: sizes differ by powers of two
    own = slim.withColumn("c", F.explode(_cells(F.col("b"), F.col("level"), tolerance, cell)))
    lifted = slim.join(sized(levels.select(F.col("level").alias("at"))), F.col("at") >= F.col("level")).withColumn("c", F.explode(_cells(F.col("b"), F.col("at"), tolerance, cell)))
    big = own.select(F.col("k").alias("k1"), F.col("b").alias("b1"), F.col("level").alias("at"), "c")
    small = lifted.select(F.col("k").alias("k2"), F.col("b").alias("b2"), F.col("level").alias("l2"), "at", "c")
    side = F.lit(cell) * F.pow(F.lit(2.0), F.col("at"))
    home = lambda v: F.floor(v / side).cast("long")
    first = (F.col("c.cx") == home(F.greatest(F.col("b1.min_x"), F.col("b2.min_x")) - tolerance)) & (F.col("c.cy") == home(F.greatest(F.col("b1.min_y"), F.col("b2.min_y")) - tolerance))
    once = (F.col("k1") != F.col("k2")) & ((F.col("l2") < F.col("at")) | (F.col("k1") < F.col("k2")))
    gap = box_gap(F.col("b1"), F.col("b2"))
    pairs = big.join(small, ["at", "c"]).filter(once & first).withColumn("gap", gap).filter(F.col("gap") <= tolerance)
    return pairs.select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b"), "gap")


def nearest(queries: DataFrame, boxes: DataFrame, key: str, box: str, k: int = 3, start: float | None = None) -> DataFrame:
    """(query, neighbour, gap, rank): the ``k`` extents nearest to each query extent, itself left out; ties by key.

    The reach doubles until every query has ``k`` others within it, or all; only queries that lack some go on. A reach is a
    join on grid cells of that size, so that no query meets all rows unless it must. ``start``: the first reach; by default
    the side of a square in which ``k`` extents would lie if they were spread evenly.
    """
    asked = cut(queries.select(F.col(key).alias("query"), F.col(box).alias("qb")).dropna())
    all_ = cut(boxes.select(F.col(key).alias("neighbour"), F.col(box).alias("b")).dropna())
    done = None
    span = all_.agg(F.max(F.greatest(F.abs("b.max_x"), F.abs("b.max_y"), F.abs("b.min_x"), F.abs("b.min_y"), F.abs("b.max_z"), F.abs("b.min_z")))).first()[0] or 0.0
    total = all_.count()
    reach = start or max(1.0, 2 * span * ((k + 1) / max(1, total)) ** 0.5)
    while not asked.isEmpty():
        zero = F.lit(0)
        cells = all_.withColumn("c", F.explode(_cells(F.col("b"), zero, 0.0, reach)))
        # the home cell of a pair: the larger low corner, as far as the query reaches
        home = lambda q, b: F.floor(F.greatest(q - reach, b) / reach).cast("long")  # noqa: E731, B023
        near = (
            asked.withColumn("c", F.explode(_cells(F.col("qb"), zero, reach, reach))).join(cells, "c")
            .filter((F.col("query") != F.col("neighbour")) & (F.col("c.cx") == home(F.col("qb.min_x"), F.col("b.min_x"))) & (F.col("c.cy") == home(F.col("qb.min_y"), F.col("b.min_y"))))
            .withColumn("gap", box_gap(F.col("qb"), F.col("b"))).filter(F.col("gap") <= reach)
        )
        # a rank up to k is cut off before the shuffle, however many extents crowd around a query
        rank = F.row_number().over(W.partitionBy("query").orderBy("gap", "neighbour"))
        top = cut(near.select("query", "neighbour", "gap", rank.alias("rank")).filter(F.col("rank") <= k))
        last = reach > 4 * span
        enough = top.groupBy("query").agg(F.count("*").alias("n")).filter(F.lit(True) if last else (F.col("n") >= min(k, max(0, total - 1))))
        full = cut(top.join(enough.select("query"), "query", "left_semi"))
        done = full if done is None else done.unionAll(full)
        if last:
            break
        asked = cut(asked.join(full.select("query").distinct(), "query", "left_anti"))
        reach *= 2
    if done is None:
        done = asked.select("query", F.col("query").alias("neighbour"), F.lit(0.0).alias("gap"), F.lit(0).alias("rank"))
    return done
