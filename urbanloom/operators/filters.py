"""Predicates on features: ids, types, extents, levels of detail, validity, and a CQL2 subset."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_ids(text: str | None) -> list[str]:
    """Ids in a comma-separated text, trimmed, without blanks and repetitions; hyphens belong to an id."""
    return list(dict.fromkeys(x.strip() for x in (text or "").split(",") if x.strip()))


def parse_bbox(text: str | None) -> tuple[float, float, float, float] | None:
    """Four numbers, each lower one strictly below its upper one, else None."""
    try:
        x0, y0, x1, y1 = (float(x) for x in (text or "").split(","))
    except ValueError:
        return None
    return (x0, y0, x1, y1) if x0 < x1 and y0 < y1 else None


def format_bbox(bbox: tuple[float, float, float, float]) -> str:
    """The text of an extent, as ``parse_bbox`` reads it."""
    return ", ".join(f"{v:g}" if v == int(v) else repr(v) for v in bbox)


def parse_bbox_srid(text: str | None) -> tuple[tuple[float, float, float, float], int | None] | None:
    """(extent, srid or None) of four numbers and perhaps a code, else None."""
    parts = [p.strip() for p in (text or "").split(",")]
    bbox = parse_bbox(",".join(parts[:4]))
    if bbox is None or len(parts) > 5 or (len(parts) == 5 and not parts[4].isdigit()):
        return None
    return bbox, int(parts[4]) if len(parts) == 5 else None


def chosen_bbox(enabled: bool, numbers: tuple[float, float, float, float] | None, text: str | None) -> tuple[float, float, float, float] | None:
    """The extent of a filter: of its numbers if they are one, else of its text; None if it isn't enabled."""
    if not enabled:
        return None
    return numbers if numbers and numbers[0] < numbers[2] and numbers[1] < numbers[3] else parse_bbox(text)


def by_id(df: DataFrame, column: str, ids: DataFrame, missing: str = "drop") -> DataFrame:
    """Rows whose id is in ``ids`` (one column); rows without id stay with missing='keep'."""
    name = ids.columns[0]
    wanted = ids.select(F.col(name).alias("__id")).dropna().distinct()
    kept = df.join(wanted, df[column] == F.col("__id"), "left_semi")
    return kept.unionByName(df.filter(F.col(column).isNull())) if missing == "keep" else kept


def in_bbox(low: Column, high: Column, bbox: tuple[float, float, float, float], mode: str = "intersects", missing: str = "drop") -> Column:
    """Whether an extent with corners ``low`` and ``high`` (struct x, y) meets ``bbox``.

    mode: intersects (closed), contains (the extent lies in the box), on_tile (its centre lies in the half-open box).
    missing: what a row without extent gives: drop or keep.
    """
    x0, y0, x1, y1 = (F.lit(float(v)) for v in bbox)
    if mode == "intersects":
        met = (low["x"] <= x1) & (high["x"] >= x0) & (low["y"] <= y1) & (high["y"] >= y0)
    elif mode == "contains":
        met = (low["x"] >= x0) & (high["x"] <= x1) & (low["y"] >= y0) & (high["y"] <= y1)
    elif mode == "on_tile":
        cx, cy = (low["x"] + high["x"]) / 2, (low["y"] + high["y"]) / 2
        met = (cx >= x0) & (cx < x1) & (cy >= y0) & (cy < y1)
    else:
        raise ValueError(mode)
    return F.coalesce(met, F.lit(missing == "keep"))


def subclasses(classes: DataFrame, root: Column | str, skip_abstract: bool = False) -> DataFrame:
    """Ids of all strict subclasses of ``root`` (a class name) in ``classes`` (id, superclass_id, classname, is_abstract).

    The class tree is a small table of fixed size; the loop ends at its height, cycles included.
    """
    found = frontier = classes.filter(F.col("classname") == root).select("id")
    links = classes.select(F.col("id").alias("child"), F.col("superclass_id").alias("id"))
    below = None
    while True:
        frontier = links.join(frontier, "id").select(F.col("child").alias("id")).distinct().join(found, "id", "left_anti")
        if frontier.isEmpty():
            break
        found = found.unionAll(frontier)
        below = frontier if below is None else below.unionAll(frontier)
    below = frontier if below is None else below
    return below.join(classes.filter(F.coalesce(F.col("is_abstract"), F.lit(0)) == 0), "id", "left_semi") if skip_abstract else below


def lod_allowed(level: Column, wanted: list[int]) -> Column:
    """Levels in ``wanted``; what has no level stays."""
    return level.isNull() | level.isin(wanted)


def lod_mode(levels: Column, wanted: list[int], mode: str) -> Column:
    """Whether a feature with an array of ``levels`` fits: or (some wanted one), and (all), minimum or maximum (its lowest or highest is wanted)."""
    asked = F.array(*[F.lit(x) for x in wanted])
    if mode == "or":
        return F.arrays_overlap(levels, asked)
    if mode == "and":
        return F.size(F.array_except(asked, levels)) == 0
    return (F.array_min(levels) if mode == "minimum" else F.array_max(levels)).isin(wanted)


def valid(start: Column, end: Column, at: Column | None = None, until: Column | None = None, mode: str = "at", lenient: bool = False) -> Column:
    """Validity of an interval [start, end), an open end being null.

    mode: latest (not ended), at (holds at ``at``), between (overlaps [at, until)), terminated (ended), terminated_at
    (ended at or before ``at``), all. lenient: a missing start counts as early enough.
    """
    begun = lambda t: (start <= t) | (start.isNull() if lenient else F.lit(False))
    if mode == "all":
        return F.lit(True)
    if mode == "latest":
        return end.isNull()
    if mode == "terminated":
        return end.isNotNull()
    if mode == "terminated_at":
        return F.coalesce(end <= at, F.lit(False))
    if mode == "at":
        return F.coalesce(begun(at) & (end.isNull() | (end > at)), F.lit(False))
    if mode == "between":
        return F.coalesce(((start < until) | (start.isNull() if lenient else F.lit(False))) & (end.isNull() | (end > at)), F.lit(False))
    raise ValueError(mode)


_CQL = re.compile(r"\s*(?:('(?:[^']|'')*')|([-+]?\d+(?:\.\d+)?)|([A-Za-z_][\w.:]*)|(<>|<=|>=|[=<>(),]))")


class Cql:
    """A CQL2 text filter as a column: comparisons, IN, LIKE, BETWEEN, IS NULL, AND, OR, NOT and s_intersects(p, bbox(...)).

    Names are columns; ``columns`` maps names to expressions, extents to arrays of two corner structs. Anything else raises
    ValueError: a filter is never ignored.
    """

    def __init__(self, text: str, columns: dict[str, Column] | None = None) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            m = _CQL.match(text, at)
            if not m:
                raise ValueError(f"no CQL2 at {text[at:at + 20]!r}")
            kind = ("text", "number", "name", "mark")[[i for i in range(4) if m[i + 1] is not None][0]]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.at, self.columns = 0, columns or {}

    def _next(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][1].lower() in wanted and self.tokens[self.at][0] in ("name", "mark"):
            self.at += 1
            return self.tokens[self.at - 1][1].lower()
        return None

    def _need(self, wanted: str) -> None:
        if not self._next(wanted):
            raise ValueError(f"{wanted!r} expected at token {self.at}")

    def column(self) -> Column:
        out = self._or()
        if self.at != len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def _or(self) -> Column:
        out = self._and()
        while self._next("or"):
            out = out | self._and()
        return out

    def _and(self) -> Column:
        out = self._not()
        while self._next("and"):
            out = out & self._not()
        return out

    def _not(self) -> Column:
        if self._next("not"):
            return ~self._not()
        if self._next("("):
            out = self._or()
            self._need(")")
            return out
        if self._next("s_intersects"):
            self._need("(")
            extent = self._value()
            self._need(",")
            self._need("bbox")
            self._need("(")
            box = []
            while True:
                box.append(float(self.tokens[self.at][1]))
                self.at += 1
                if not self._next(","):
                    break
            self._need(")")
            self._need(")")
            if len(box) == 6:
                box = [box[0], box[1], box[3], box[4]]
            return in_bbox(extent[0], extent[1], tuple(box))
        left = self._value()
        negated = bool(self._next("not"))
        if self._next("in"):
            self._need("(")
            values = [self._value()]
            while self._next(","):
                values.append(self._value())
            self._need(")")
            out = left.isin(*values)
        elif self._next("like"):
            pattern = self._value()
            out = F.like(left, pattern)
        elif self._next("between"):
            low = self._value()
            self._need("and")
            out = (left >= low) & (left <= self._value())
        elif self._next("is"):
            no = bool(self._next("not"))
            self._need("null")
            out = left.isNotNull() if no else left.isNull()
        else:
            sign = self._next("=", "<>", "<", "<=", ">", ">=")
            if not sign:
                raise ValueError(f"a comparison is expected at token {self.at}")
            right = self._value()
            out = {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[sign]
        return ~out if negated else out

    def _value(self) -> Column:
        if self.at >= len(self.tokens):
            raise ValueError("the filter ends too early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return F.lit(text[1:-1].replace("''", "'"))
        if kind == "number":
            return F.lit(float(text) if "." in text else int(text))
        if kind == "name":
            return self.columns[text] if text in self.columns else F.col(text)
        raise ValueError(f"a value is expected, not {text!r}")


def cql(text: str, columns: dict[str, Column] | None = None) -> Column:
    """The condition that a CQL2 text states; see ``Cql``."""
    return Cql(text, columns).column()
