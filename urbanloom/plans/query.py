"""A builder of queries on the feature table: every filter becomes part of one declarative plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.operators.filters import by_id, cql, in_bbox, lod_mode, subclasses, valid


class Query:
    """Filters, order and window over features; each method returns a new query.

    feature: id, objectclass_id, objectid, envelope, dates; classes: objectclass; prop: property, for levels of detail.
    """

    def __init__(self, feature: DataFrame, classes: DataFrame, prop: DataFrame | None = None) -> None:
        self.feature, self.classes, self.prop = feature, classes, prop

    def _with(self, feature: DataFrame) -> Query:
        return Query(feature, self.classes, self.prop)

    def types(self, *names: str, concrete: bool = True) -> Query:
        """Features of the classes ``names`` and of all classes below them (without abstract ones)."""
        found = self.classes.filter(F.col("classname").isin(*[n.rpartition(":")[2] for n in names])).select("id")
        for name in names:
            found = found.unionAll(subclasses(self.classes, name.rpartition(":")[2], concrete))
        return self._with(self.feature.join(found.select(F.col("id").alias("objectclass_id")).distinct(), "objectclass_id", "left_semi"))

    def ids(self, ids: DataFrame, missing: str = "drop") -> Query:
        """Features whose objectid is in ``ids``."""
        return self._with(by_id(self.feature, "objectid", ids, missing))

    def bbox(self, bbox: tuple[float, float, float, float], mode: str = "intersects", missing: str = "drop") -> Query:
        """Features by extent; see ``in_bbox``."""
        return self._with(self.feature.filter(in_bbox(F.col("envelope")[0], F.col("envelope")[1], bbox, mode, missing)))

    def lods(self, levels: list[int], mode: str = "or", depth: int = 0) -> Query:
        """Features by the levels of detail that their properties have, and those of what they contain down to ``depth``; see ``lod_mode``."""
        own = self.prop.filter(F.col("val_lod").isNotNull()).select(F.col("feature_id").alias("n"), F.col("val_lod").cast("int").alias("lod")).distinct()
        contains = self.prop.filter(F.col("val_relation_type") == 1).select(F.col("feature_id").alias("p"), F.col("val_feature_id").alias("n")).dropna().distinct()
        every = step = own
        for _ in range(depth):
            step = step.join(contains, "n").select(F.col("p").alias("n"), "lod").distinct()
            every = every.unionAll(step)
        of = every.groupBy(F.col("n").alias("id")).agg(F.collect_set("lod").alias("__lods"))
        fit = of.filter(lod_mode(F.col("__lods"), levels, mode)).select("id")
        return self._with(self.feature.join(fit, "id", "left_semi"))

    def valid(self, mode: str = "latest", at: Column | None = None, until: Column | None = None, reference: str = "transaction", lenient: bool = False) -> Query:
        """Features by their dates: of the record (transaction) or of the world (validity); see ``filters.valid``."""
        start, end = ("creation_date", "termination_date") if reference == "transaction" else ("valid_from", "valid_to")
        return self._with(self.feature.filter(valid(F.col(start), F.col(end), at, until, mode, lenient)))

    def cql(self, text: str) -> Query:
        """Features by a CQL2 text."""
        return self._with(self.feature.filter(cql(text, {"objectId": F.col("objectid"), "core:envelope": F.col("envelope")})))

    def where(self, sql: str) -> Query:
        """Features by an SQL condition."""
        return self._with(self.feature.filter(F.expr(sql)))

    def page(self, order: list[Column], limit: int | None = None, start: int = 0) -> Query:
        """Features in order, from ``start`` on, ``limit`` at most."""
        out = self.feature.orderBy(*order)
        out = out.offset(start) if start > 0 else out
        return self._with(out if limit is None else out.limit(limit))

    def df(self) -> DataFrame:
        """The features found."""
        return self.feature
