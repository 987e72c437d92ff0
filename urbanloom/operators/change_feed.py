"""Applying a feed of inserts, updates, deletes and terminations in the order of its points of time.

A range partitioning by (key, instant, id) sorts the feed; it also splits the timeline of a hot key over several
partitions. Each partition is replayed by a state machine in one streaming pass and leaves one *segment summary* per key:
what the segment does to any state that enters it. The few summaries of a key are then folded in order, so no key's
whole history is ever held in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanloom.session import partitions

#: First letters of the ways to write a transaction type.
KINDS = {"I": "INSERT", "U": "UPDATE", "D": "DELETE", "T": "TERMINATE"}


def normal_kind(kind: Column) -> Column:
    """INSERT, UPDATE, DELETE or TERMINATE for any way to write it (case, blanks, first letter only), else null."""
    word = F.upper(F.trim(kind))
    out = F.lit(None).cast("string")
    for letter, name in KINDS.items():
        out = F.when((word == letter) | (word == name) | (word == name + "D") | (word == name + "ED"), name).otherwise(out)
    return out


def resolve_key(df: DataFrame, key: str, alias: str) -> DataFrame:
    """``df`` with null ``key`` filled by the key that other rows give for the same ``alias`` (the smallest, if several).

    Rows whose alias names no key keep null. Only rows without key are joined; the map holds one row per alias.
    """
    whole = df.filter(F.col(key).isNotNull())
    names = whole.filter(F.col(alias).isNotNull()).groupBy(F.col(alias).alias("__alias")).agg(F.min(key).alias("__key"))
    rest = df.filter(F.col(key).isNull()).join(names, F.col(alias) == F.col("__alias"), "left")
    return whole.unionByName(rest.withColumn(key, F.col("__key")).drop("__alias", "__key"))


def _fold(state: list, kind: str, row_id: int, values: list) -> None:
    """One step of the state machine; ``state`` is [status, last id, ended, values, resets].

    status: None (as on entry), 'present', 'terminated' or 'absent'. While status is None the segment hasn't met an
    INSERT or DELETE: last id and values then hold what its UPDATEs do to a present feature, ended what a TERMINATE does.
    """
    status = state[0]
    if kind == "INSERT":
        state[:] = ["present", row_id, False, list(values)]
    elif kind == "DELETE":
        state[:] = ["absent", row_id, False, [None] * len(values)]
    elif status in (None, "present") and not state[2]:
        state[1] = row_id
        state[3] = [old if new is None else new for old, new in zip(state[3], values, strict=True)]
        if kind == "TERMINATE":
            state[2] = True
            if status == "present":
                state[0] = "terminated"


def _replay(n_values: int):
    """Streams a sorted partition of (key, at, id, kind, values...) into one summary per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, state, out = None, None, None, []

        def close() -> None:
            out.append((key, first[0], first[1], state[0], state[1], state[2], *state[3]))

        names = None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            names = batch.schema
            for k, at, row_id, kind, *values in zip(*columns, strict=True):
                if k != key or state is None:
                    if state is not None:
                        close()
                    key, first, state = k, (at, row_id), [None, None, False, [None] * n_values]
                _fold(state, kind, row_id, values)
            if len(out) >= 10_000:
                yield _batch(out, names, n_values)
                out = []
        if state is not None:
            close()
        if out:
            yield _batch(out, names, n_values)

    return run


def _batch(rows: list[tuple], schema: pa.Schema, n_values: int) -> pa.RecordBatch:
    kinds = [schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), *[schema.field(4 + i).type for i in range(n_values)]]
    names = ["key", "at", "id", "status", "last_id", "ended", *[schema.field(4 + i).name for i in range(n_values)]]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def apply_changes(feed: DataFrame, key: str, at: str, row_id: str, kind: str, values: list[str] | None = None) -> DataFrame:
    """State of each key after all changes: key, status (present, terminated, absent), last_id and ``values``.

    ``at`` is a comparable integer, ``kind`` any way to write a type. Rows with null key, point of time, id or type can't
    be placed and are left out. Changes of one key with the same type and point of time are one change, under the
    smallest id (with that row's values). Changes apply by (at, id). INSERT always takes effect, and so does DELETE;
    UPDATE and TERMINATE only on a feature that is present and not terminated. An UPDATE replaces only columns that it
    doesn't leave null. Keys that were never present come out as absent. An empty feed gives an empty table.
    """
    values = values or []
    spark = feed.sparkSession
    names = [f"v{i}" for i in range(len(values))]
    slim = feed.select(
        F.col(key).alias("key"), F.col(at).cast("long").alias("at"), normal_kind(F.col(kind)).alias("kind"), F.col(row_id).cast("long").alias("id"),
        *[F.col(c).alias(n) for c, n in zip(values, names, strict=True)],
    ).dropna(subset=["key", "at", "kind", "id"])
    once = slim.groupBy("key", "at", "kind").agg(F.min("id").alias("id"), *[F.min_by(n, F.struct("id", *names[:i], n)).alias(n) for i, n in enumerate(names)])
    types = {f.name: f.dataType for f in once.schema}
    ordered = once.select("key", "at", "id", "kind", *names).repartitionByRange(partitions(spark), "key", "at", "id").sortWithinPartitions("key", "at", "id")
    summary = T.StructType(
        [T.StructField("key", types["key"]), T.StructField("at", T.LongType()), T.StructField("id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("last_id", T.LongType()), T.StructField("ended", T.BooleanType())]
        + [T.StructField(n, types[n]) for n in names]
    )
    parts = ordered.mapInArrow(_replay(len(names)), summary)
    # a key has at most one summary per partition; only keys cut by a boundary have more than one
    start = F.struct(F.lit("absent").alias("status"), F.lit(None).cast("long").alias("last_id"), *[F.lit(None).cast(types[n]).alias(n) for n in names])

    def step(acc: Column, seg: Column) -> Column:
        alive = acc["status"] == "present"
        reset = seg["status"].isNotNull()
        acts = alive & seg["last_id"].isNotNull()
        return F.struct(
            F.when(reset, seg["status"]).when(alive & seg["ended"], "terminated").otherwise(acc["status"]).alias("status"),
            F.when(reset | acts, seg["last_id"]).otherwise(acc["last_id"]).alias("last_id"),
            *[F.when(reset, seg[n]).when(acts, F.coalesce(seg[n], acc[n])).otherwise(acc[n]).alias(n) for n in names],
        )

    folded = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "id", "status", "last_id", "ended", *names))).alias("segments"))
    done = folded.select("key", F.aggregate("segments", start, step).alias("s"))
    return done.select(F.col("key").alias(key), F.col("s.status").alias("status"), F.col("s.last_id").alias("last_id"), *[F.col(f"s.{n}").alias(c) for n, c in zip(names, values, strict=True)])
