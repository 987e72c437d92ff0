import random
from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from urbanloom.functions.instants import with_instant
from urbanloom.operators.change_feed import apply_changes, resolve_key
from urbanloom.operators.references import orphans

BERLIN = ZoneInfo("Europe/Berlin")
CASES = [
    ("2018-07-16T01:44:29Z", "dmy", "2018-07-16T01:44:29"), ("2018-07-16t01:44:29z", "dmy", "2018-07-16T01:44:29"), (" 2018-07-16T01:44:29Z ", "dmy", "2018-07-16T01:44:29"),
    ("2014-11-22T04:44:15-05:00", "dmy", "2014-11-22T09:44:15"), ("2015-07-07T21:40:12.249312-0400", "dmy", "2015-07-08T01:40:12.249312"), ("2015-02-19 00:43:13,1239", "dmy", "2015-02-18T23:43:13.123900"),
    ("2018-01-08 06:16:25", "dmy", "2018-01-08T05:16:25"), ("07/02/2013 12:58 PM", "mdy", "2013-07-02T10:58:00"), ("07/02/2013 12:58 AM", "dmy", "2013-02-06T23:58:00"), ("2014-06-01", "dmy", "2014-05-31T22:00:00"),
    ("1412557553", "dmy", "2014-10-06T01:05:53"), ("1412557553123", "dmy", "2014-10-06T01:05:53.123"), ("1412557553123456", "dmy", "2014-10-06T01:05:53.123456"), ("2016-01-20 06:13:07 EST", "dmy", "2016-01-20T11:13:07"),
    ("May 20, 2012 10:31", "mdy", "2012-05-20T08:31:00"), ("20170717", "dmy", "2017-07-16T22:00:00"), ("20150417T095202Z", "dmy", "2015-04-17T09:52:02"), ("10. März 2018, 13:50 Uhr", "dmy", "2018-03-10T12:50:00"),
    ("2020-W53-1", "dmy", "2020-12-27T23:00:00"), ("2015-W53-7", "dmy", "2016-01-02T23:00:00"), ("2021-W53-1", "dmy", None), ("2019-W53", "dmy", None), ("2021-W52-7", "dmy", "2022-01-01T23:00:00"),
    ("Sat, 21 Feb 2015 17:49:35 +0100", "dmy", "2015-02-21T16:49:35"), ("2015-058T00:34:20Z", "dmy", "2015-02-27T00:34:20"), ("2015-03-25T22:29:59.000000773Z", "dmy", "2015-03-25T22:29:59"),
    ("2012-08-18T10:10:27+02:00[Europe/Berlin]", "dmy", "2012-08-18T08:10:27"), ("2012-08-18T10:10:27[Asia/Kolkata]", "dmy", "2012-08-18T04:40:27"), ("24.04.2015 05:54", "dmy", "2015-04-24T03:54:00"),
    ("2020-W53-5", "dmy", "2020-12-31T23:00:00"), ("2016-02-29T24:00:00Z", "dmy", "2016-03-01T00:00:00"), ("2021-10-31 02:30:00", "dmy", "2021-10-31T00:30:00"), ("2021-03-28 02:30:00", "dmy", "2021-03-28T01:30:00"),
    ("2018-06-31T25:61:00Z", "dmy", None), ("2015-02-30", "dmy", None), ("2017-13-04", "dmy", None), ("0000-00-00", "dmy", None), ("31.04.2014 10:00", "dmy", None), ("", "dmy", None), ("n/a", "dmy", None),
    (None, "dmy", None), ("tbd 2019", "dmy", None), ("2015-366", "dmy", None), ("2015-01-01 10:00 XYZ", "dmy", None), ("2015-01-01T10:00:00[Nowhere/Town]", "dmy", None), ("13:00 PM" * 2000, "dmy", None),
    ("2015-01-01 13:00 PM", "dmy", None), ("2015-01-01T10:00:00+25:00", "dmy", None), ("9999999999999999999", "dmy", None),
]


def test_points_of_time(spark):
    df = spark.createDataFrame([(i, t, o) for i, (t, o, _) in enumerate(CASES)], "i int, text string, o string")
    got = {r["i"]: r["u"] for r in with_instant(df, "text", "u", F.lit("Europe/Berlin"), F.col("o")).collect()}
    for i, (t, _, want) in enumerate(CASES):
        micros = None if want is None else round(datetime.fromisoformat(want).replace(tzinfo=UTC).timestamp() * 1e6)
        assert got[i] == micros, (t, got[i], micros)


def test_local_clocks_agree_with_the_zone_database(spark):
    rnd = random.Random(3)
    texts = [datetime(2000 + rnd.randrange(30), rnd.randrange(1, 13), rnd.randrange(1, 29), rnd.randrange(24), rnd.randrange(60), rnd.randrange(60)) for _ in range(200)]
    df = spark.createDataFrame([(t.isoformat(), round(t.replace(tzinfo=BERLIN).timestamp() * 1e6)) for t in texts], "text string, want long")
    assert with_instant(df, "text", "u", F.lit("Europe/Berlin")).filter("u is null or u <> want").count() == 0


def test_no_zone_gives_no_point(spark):
    df = spark.createDataFrame([("2015-01-01 10:00",), ("2015-01-01T10:00Z",)], "text string")
    assert [r["u"] is None for r in with_instant(df, "text", "u").collect()] == [True, False]


def replay(feed):
    keyed = {}
    for i, k, at, kind, v in feed:
        if None in (k, at, i) or kind is None:
            continue
        letter = kind.strip().upper()[0]
        old = keyed.setdefault(k, {}).get((at, letter))
        if old is None or i < old[0]:
            keyed[k][at, letter] = (i, v)
    out = []
    for k, events in keyed.items():
        status, last, value = "absent", None, None
        for (_, letter), (i, v) in sorted(events.items(), key=lambda e: (e[0][0], e[1][0])):
            if letter == "I":
                status, last, value = "present", i, v
            elif letter == "D":
                status, last, value = "absent", i, None
            elif status == "present":
                last, value = i, value if v is None else v
                status = "terminated" if letter == "T" else "present"
        out.append((k, status, last, value))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_replay_with_a_hot_key(spark, seed):
    rnd = random.Random(seed)
    kinds = ["INSERT", " insert", "U", "Update", "DELETE", "d", "TERMINATE", "t", None]
    weights = [2, 2, 9, 9, 1, 1, 1, 1, 1]
    feed = [(i, 1 if rnd.random() < 0.5 else rnd.choice([2, 3, 4, None]), rnd.randrange(60) if rnd.random() > 0.05 else None, rnd.choices(kinds, weights)[0], rnd.choice(["a", "b", None])) for i in range(400)]
    feed += feed[:40]
    df = spark.createDataFrame(feed, "id long, k long, at long, kind string, v string")
    assert rows(apply_changes(df, "k", "at", "id", "kind", ["v"])) == replay(feed)


def test_change_feed_edges(spark):
    empty = spark.createDataFrame([], "id long, k long, at long, kind string, v string, segments int, key int")
    assert apply_changes(empty, "k", "at", "id", "kind", ["v"]).count() == 0
    df = spark.createDataFrame([(1, None, "a"), (2, 7, "a"), (3, None, "b"), (4, None, None), (5, 6, "a")], "id long, k long, o string")
    assert rows(resolve_key(df, "k", "o")) == sorted([(1, 6, "a"), (2, 7, "a"), (3, None, "b"), (4, None, None), (5, 6, "a")], key=repr)


def test_orphans_with_hot_and_missing_keys(spark):
    rnd = random.Random(1)
    parents = [("a", rnd.randrange(-500, 500)) for _ in range(300)] + [("b", 1), ("a", None)]
    refs = [("a", i, "2020-01", 77 if i % 3 == 0 else 9_000_000_000 if i % 7 == 0 else rnd.randrange(-600, 600)) for i in range(3000)] + [("b", 1, None, 1), ("b", 2, None, 2), ("c", 3, "x", 5), ("a", 4, "x", None), ("b", 2, None, 2)]
    p = spark.createDataFrame(parents, "tab string, key long")
    r = spark.createDataFrame(refs, "tab string, row_id long, period string, key long")
    known = set(parents)
    want = sorted(((t, i, m) for t, i, m, k in refs if k is not None and (t, k) not in known), key=repr)
    assert rows(orphans(r, p, rows_per_range=100)) == want
    assert rows(orphans(r, p.limit(0))) == sorted(((t, i, m) for t, i, m, k in refs if k is not None), key=repr)
    assert orphans(r.limit(0), p).count() == orphans(r.limit(0), p.limit(0)).count() == 0
