"""References to records that don't exist.

Keys and references share one set of ranges, cut at quantiles of both sides, so that every range holds a similar number
of rows. A key that is hot enough to fill several quantiles owns several ranges: its references are dealt over them and
the key itself is copied to each. In each range the keys are one sorted array which batches of references probe by
binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.session import partitions


#: Quantiles that the first look at the tables takes.
FIRST_QUANTILES = 512


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (slot, is_ref, key, tab, row_id, period) in; references without key out.

    The keys of a slot come before its references. Only one slot's keys are held at a time.
    """
    slot, chunks, keys = None, [], np.empty(0, np.int64)
    for batch in batches:
        slots, refs, values = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cuts = np.flatnonzero(np.diff(slots)) + 1
        miss = np.zeros(len(slots), bool)
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(slots)], strict=True):
            if slots[lo] != slot:
                slot, chunks, keys = slots[lo], [], np.empty(0, np.int64)
            first = lo + int(np.searchsorted(refs[lo:hi], 1))
            if first > lo:
                chunks.append(values[lo:first])
            if first < hi:
                if chunks:
                    keys, chunks = np.concatenate([keys, *chunks]), []  # the keys come sorted
                at = np.searchsorted(keys, values[first:hi])
                found = at < len(keys)
                found[found] = keys[at[found]] == values[first:hi][found]
                miss[first:hi] = ~found
        out = batch.filter(pa.array(miss)).select([3, 4, 5])
        if out.num_rows:
            yield out


def orphans(refs: DataFrame, parents: DataFrame, rows_per_range: int = 250_000, max_ranges: int = 32_768) -> DataFrame:
    """Rows of ``refs`` (tab S, row_id L, period S, key L) whose key isn't in ``parents`` (tab S, key L).

    A reference with null key refers to nothing and isn't a case; null parents are ignored; repeated rows come out as
    often as they went in. Keys are compared within the same ``tab``. ``rows_per_range`` sizes the sorted arrays (8 bytes a
    key); up to ``max_ranges`` cut points, 8 bytes each, go to the driver. Empty tables are allowed on either side.
    """
    spark = refs.sparkSession
    refs, parents = refs.filter(F.col("key").isNotNull()), parents.filter(F.col("key").isNotNull()).select("tab", "key")
    both = parents.select("tab", "key").unionAll(refs.select("tab", "key"))
    grid = lambda n: [(i + 1) / n for i in range(n - 1)]
    quantiles = lambda n: F.percentile_approx("key", grid(n), 10 * n).alias("cuts")
    # one look at both tables for their size and for quantiles that are fine enough for most sizes
    known = both.groupBy("tab").agg(F.count("*").alias("n"), quantiles(FIRST_QUANTILES)).collect()
    if not known:
        return refs.select("tab", "row_id", "period")
    total = sum(r["n"] for r in known)
    ranges = int(min(max_ranges, max(4 * partitions(spark), total // rows_per_range)))
    if ranges <= FIRST_QUANTILES:
        cuts = {r["tab"]: [r["cuts"][round((i + 1) * FIRST_QUANTILES / ranges) - 1] for i in range(ranges - 1)] for r in known}
    else:
        cuts = {r["tab"]: r["cuts"] for r in both.groupBy("tab").agg(quantiles(ranges)).collect()}
    # slot of a key: how many cut points lie below it. With equal cut points a hot key owns more than one slot.
    bounds = spark.sparkContext.broadcast({t: np.array(c, np.int64) for t, c in cuts.items()})

    def slots_of(side: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = {t: i for i, t in enumerate(sorted(bounds.value, key=str))}
            for b in batches:
                tabs, keys = b.column("tab").to_pylist(), b.column("key").to_numpy(zero_copy_only=False)
                first, last = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
                names = np.array([number[t] for t in tabs], np.int64)
                for t, i in number.items():
                    own = names == i
                    cut = bounds.value[t]
                    first[own], last[own] = np.searchsorted(cut, keys[own], "left"), np.searchsorted(cut, keys[own], "right")
                if side == "refs":
                    row = b.column("row_id").to_numpy(zero_copy_only=False).astype(np.int64)
                    slot = first + (row * 2654435761 % (1 << 31)) % (last - first + 1)
                    take = np.arange(len(keys))
                else:
                    times = last - first + 1
                    take = np.repeat(np.arange(len(keys)), times)
                    slot = first[take] + np.arange(len(take)) - np.repeat(np.cumsum(times) - times, times)
                one = pa.array(np.full(len(take), int(side == "refs"), np.int8))
                slot_id = pa.array(names[take] * (1 << 32) + slot)
                tail = [b.column(c).take(pa.array(take)) if side == "refs" else pa.nulls(len(take), t) for c, t in (("tab", pa.string()), ("row_id", pa.int64()), ("period", pa.string()))]
                yield pa.RecordBatch.from_arrays([slot_id, one, pa.array(keys[take]), *tail], names=["slot", "is_ref", "key", "tab", "row_id", "period"])

        return run

    schema = "slot long, is_ref byte, key long, tab string, row_id long, period string"
    dealt = parents.mapInArrow(slots_of("parents"), schema).unionAll(refs.select("tab", "row_id", "period", "key").mapInArrow(slots_of("refs"), schema))
    ordered = dealt.repartition(partitions(spark), "slot").sortWithinPartitions("slot", "is_ref", "key")
    return ordered.mapInArrow(_probe, "tab string, row_id long, period string")
