"""Shredding nested JSON into an adjacency table, and pivoting that into flat entity tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "record_id long, body_key long, node int, parent int, label string, ordinal int, kind string, scalar string, entity int, path string"
_ARROW = pa.schema(
    [("record_id", pa.int64()), ("body_key", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("label", pa.string()), ("ordinal", pa.int32())]
    + [("kind", pa.string()), ("scalar", pa.string()), ("entity", pa.int32()), ("path", pa.string())]
)
_BATCH_NODES = 50_000
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)(?![\w.+-]))')


class _Number(str):
    """A JSON number as it is written."""


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} isn't JSON")


def _by_stack(text: str):
    """``text`` parsed without recursion, for bodies that are nested deeper than the parser's stack."""
    at, end = 0, len(text.rstrip(" \t\n\r"))
    holders: list = []
    value, want, key = None, "value", None
    while True:
        m = _TOKEN.match(text, at, end)
        if not m:
            raise ValueError("not JSON")
        at = m.end()
        mark, string, plain = m.groups()
        done = False
        if want in ("value", "first") and mark in ("{", "["):
            holders.append(([] if mark == "[" else {}, key))
            want = "first" if mark == "[" else "key0"
            continue
        if (mark == "]" and want in ("first", "next") and holders and isinstance(holders[-1][0], list)) or (mark == "}" and want in ("key0", "next") and holders and isinstance(holders[-1][0], dict)):
            value, key = holders.pop()
            done = True
        elif mark == "," and want == "next" and holders:
            want = "value" if isinstance(holders[-1][0], list) else "key"
            continue
        elif string is not None and want in ("key", "key0"):
            key, want = json.loads(string), "colon"
            continue
        elif mark == ":" and want == "colon":
            want = "value"
            continue
        elif mark is None and want in ("value", "first"):
            value = json.loads(string) if string is not None else {"true": True, "false": False, "null": None}.get(plain, _Number(plain))
            done = True
        if not done:
            raise ValueError("not JSON")
        if not holders:
            if at != end:
                raise ValueError("not JSON")
            return value
        holder = holders[-1][0]
        if isinstance(holder, list):
            holder.append(value)
        else:
            holder[key] = value
        want = "next"


def read_json(text: str | None):
    """(True, value) of a JSON text with numbers kept as written, else (False, None)."""
    if not text:
        return False, None
    try:
        return True, json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_no_constant)
    except RecursionError:
        pass
    except ValueError:
        return False, None
    try:
        return True, _by_stack(text)
    except ValueError:
        return False, None


def shred_value(value, wanted: set[str] | None = None) -> Iterator[tuple]:
    """Nodes (node, parent, label, ordinal, kind, scalar, entity, path) of a parsed value, parents first.

    entity is the nearest object around the node that has a key ``id``; path leads there from that object. A string that
    holds the JSON text of an object or array is a node of kind text, with the parsed value as its child. ``wanted``: labels
    of the scalars to give; objects, arrays and texts then only come out if they are objects with an id.
    """
    stack = [(value, -1, "", 0, -1, "")]
    count = 0
    while stack:
        v, parent, label, ordinal, entity, path = stack.pop()
        node, count = count, count + 1
        if isinstance(v, dict):
            own = "id" in v
            if wanted is None or own:
                yield node, parent, label, ordinal, "object", None, entity, path
            inner, prefix = (node, "") if own else (entity, path)
            for k, (name, child) in enumerate(reversed(v.items())):
                stack.append((child, node, name, len(v) - 1 - k, inner, f"{prefix}.{name}" if prefix else name))
        elif isinstance(v, list):
            if wanted is None:
                yield node, parent, label, ordinal, "array", None, entity, path
            for k in range(len(v) - 1, -1, -1):
                stack.append((v[k], node, label, k, entity, f"{path}[{k}]"))
        else:
            if isinstance(v, str) and not isinstance(v, _Number) and v.lstrip()[:1] in ("{", "["):
                ok, inside = read_json(v)
                if ok:
                    if wanted is None:
                        yield node, parent, label, ordinal, "text", None, entity, path
                    stack.append((inside, node, label, 0, entity, path))
                    continue
            if wanted is None or label in wanted:
                kind = "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, _Number) else "string"
                scalar = None if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v)
                if kind == "string":
                    scalar = scalar.encode("utf-8", "replace").decode("utf-8")  # lone surrogates can't be stored
                yield node, parent, label, ordinal, kind, scalar, entity, path


def shred(df: DataFrame, record_id: str, body: str, scalars: Iterable[str] | None = None) -> DataFrame:
    """Adjacency table of the JSON in ``body``, one row per node; a body that isn't valid JSON, is null or empty gives none.

    (record_id, body_key, node) is the key: body_key tells rows apart that repeat a record_id. One pass over each body,
    no shuffle, a bounded batch at a time. See ``shred_value`` for the columns and for ``scalars``.
    """
    wanted = None if scalars is None else set(scalars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for rid, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ok, value = read_json(text)
                if not ok:
                    continue
                for node, parent, label, ordinal, kind, scalar, entity, path in shred_value(value, wanted):
                    rows.append((rid, key, node, parent, label, ordinal, kind, scalar, entity, path))
                    if len(rows) >= _BATCH_NODES:
                        yield _rows(rows)
                        rows = []
        if rows:
            yield _rows(rows)

    return df.select(F.col(record_id).cast("long").alias("record_id"), F.xxhash64(body).alias("body_key"), F.col(body).alias("body")).mapInArrow(run, SCHEMA)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def entities(nodes: DataFrame) -> DataFrame:
    """Objects with an id: record_id, body_key, node, entity (the object with an id around it, -1 for none) and feature_id.

    Object nodes meet their scalar children in one aggregation over (record, object). An id that is no integer gives a
    null feature_id.
    """
    at = F.when(F.col("kind") == "object", F.col("node")).otherwise(F.col("parent"))
    is_id = (F.col("label") == "id") & F.col("kind").isin("string", "number", "boolean", "null")
    return (
        nodes.filter((F.col("kind") == "object") | is_id)
        .groupBy("record_id", "body_key", at.alias("node"))
        .agg(
            F.max(F.when(F.col("kind") == "object", F.col("entity"))).alias("entity"),
            F.max(F.when(is_id & (F.col("kind") != "object"), F.expr("try_cast(trim(scalar) as bigint)"))).alias("feature_id"),
            F.bool_or(is_id).alias("has_id"),
        )
        .filter(F.col("has_id"))
        .drop("has_id")
    )


def containment(found: DataFrame) -> DataFrame:
    """Distinct pairs (feature_id, val_feature_id) of an object with an id and the objects with an id directly inside it."""
    inner = found.filter((F.col("entity") >= 0) & F.col("feature_id").isNotNull()).select("record_id", "body_key", F.col("entity").alias("node"), F.col("feature_id").alias("val_feature_id"))
    outer = found.filter(F.col("feature_id").isNotNull()).select("record_id", "body_key", "node", "feature_id")
    return inner.join(outer, ["record_id", "body_key", "node"]).select("feature_id", "val_feature_id").distinct()


def owned_scalars(nodes: DataFrame) -> DataFrame:
    """Scalars of every object with an id: those between it and the objects with an id inside it, with its feature_id."""
    owner = entities(nodes).select("record_id", "body_key", F.col("node").alias("entity"), "feature_id").dropna(subset=["feature_id"])
    return nodes.filter(F.col("kind").isin("string", "number", "boolean", "null")).join(owner, ["record_id", "body_key", "entity"])


def entity_table(scalars: DataFrame, order: str) -> DataFrame:
    """One row per feature_id with a column for every path that leads to a scalar without passing a list; text, as written.

    Columns are the paths with ``_`` for ``.``, in order, ``~`` behind names that are taken in any case. Of several
    deliveries the value of the latest by ``order`` counts (of equal ones the largest text); a null there is no value. As many columns as there are
    such paths go to the driver by name, nothing else.
    """
    direct = scalars.filter(~F.col("path").contains("[") & (F.col("path") != "id") & F.col("scalar").isNotNull())
    paths = [r["path"] for r in direct.select("path").distinct().orderBy("path").collect()]
    taken, names = {"feature_id"}, []
    for p in paths:
        name = p.replace(".", "_")
        while name.lower() in taken:
            name += "~"
        taken.add(name.lower())
        names.append(name)
    value = lambda p: F.when(F.col("path") == p, F.col("scalar"))
    place = lambda p: F.when(F.col("path") == p, F.struct(order, "scalar"))
    every = scalars.select("feature_id").distinct()
    wide = direct.groupBy("feature_id").agg(*[F.max_by(value(p), place(p)).alias(n) for p, n in zip(paths, names, strict=True)]) if paths else every
    return every.join(wide, "feature_id", "left") if paths else every
