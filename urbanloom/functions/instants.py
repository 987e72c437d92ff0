"""Points of time in mixed notations, as one column expression without Python in the rows' path.

All notations are alternatives of ONE regular expression with named groups. A single ``regexp_replace`` writes the
groups out as a delimited record, so every text passes the matcher once; ranges are then checked and the instant is
assembled with integer day arithmetic.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Zone abbreviations and their minutes east of Greenwich.
ZONE_MINUTES = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
#: Month names by their first three letters, English and German.
MONTHS = {
    "jan": 1, "jän": 1, "feb": 2, "mar": 3, "mär": 3, "mrz": 3, "mae": 3, "apr": 4, "may": 5, "mai": 5, "jun": 6, "jul": 7,
    "aug": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12,
}

_MARK, _SEP = "\u001e", "\u001f"
_WORD = r"[a-zäöü]{3,9}"
_TH = r"(?:st|nd|rd|th|\.)?"
_DATES = [
    r"(?<ya>\d{4})[-/.](?<ma>\d{1,2})[-/.](?<da>\d{1,2})",
    r"(?<yb>\d{4})(?<mb>\d{2})(?<db>\d{2})",
    r"(?<yc>\d{4})-?(?<doy>\d{3})",
    r"(?<yd>\d{4})-?w(?<wk>\d{2})(?:-?(?<wd>[1-7]))?",
    r"(?<na>\d{1,2})[./-](?<nb>\d{1,2})[./-](?<ye>\d{4})",
    rf"(?<df>\d{{1,2}}){_TH}[\s-]*(?<wf>{_WORD})\.?,?[\s-]+(?<yf>\d{{4}})",
    rf"(?<wg>{_WORD})\.?\s+(?<dg>\d{{1,2}}){_TH},?\s+(?<yg>\d{{4}})",
]
_TIME = (
    r"(?:(?:\s*[t,]\s*|\s+)(?:(?<ha>\d{1,2}):(?<ia>\d{2})(?::(?<sa>\d{2})(?:[.,](?<fa>\d+))?)?"
    r"|(?<hb>\d{2})(?<ib>\d{2})(?:(?<sb>\d{2})(?:[.,](?<fb>\d+))?)?)"
    r"(?:\s*(?<ap>[ap])\.?m\.?|\s*(?:uhr|h))?"
    r"(?:\s*(?<zn>[a-z]{1,4}(?![a-z]))?(?<zo>[+-]\d{1,2}(?::?\d{2})?)?)(?:\s*\[(?<rg>[^\]]+)\])?)?"
)
#: Every notation: epoch counts, 12 or 14 digits, or a date with an optional time, zone and region.
PATTERN = (
    r"(?iu)^\s*(?:(?<ep>-?\d{9,10}|\d{13}|\d{16}|\d{19})"
    r"|(?<yh>\d{4})(?<mh>\d{2})(?<dh>\d{2})(?<hh>\d{2})(?<ih>\d{2})(?<sh>\d{2})?"
    r"|(?:(?:" + _WORD + r")\.?,?\s+)??(?:" + "|".join(_DATES) + ")" + _TIME + r")\s*$"
)
_FIELDS = {
    "ep": ["ep"], "y": ["ya", "yb", "yc", "yd", "ye", "yf", "yg", "yh"], "m": ["ma", "mb", "mh"], "d": ["da", "db", "df", "dg", "dh"],
    "na": ["na"], "nb": ["nb"], "word": ["wf", "wg"], "doy": ["doy"], "wk": ["wk"], "wd": ["wd"], "h": ["ha", "hb", "hh"],
    "i": ["ia", "ib", "ih"], "s": ["sa", "sb", "sh"], "f": ["fa", "fb"], "ap": ["ap"], "zn": ["zn"], "zo": ["zo"], "rg": ["rg"],
}
_REPLACEMENT = _MARK + _SEP + _SEP.join("".join(f"${{{g}}}" for g in groups) for groups in _FIELDS.values())


def _lookup(values: dict[str, int], key: Column) -> Column:
    return F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")")[key]


def _fence(value: Column) -> Column:
    return F.explode_outer(F.array(value))


def _leap(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic (years from 0 on)."""
    shifted = y + F.when(m <= 2, 399).otherwise(400)  # never negative
    return shifted * 365 + _div(shifted, 4) - _div(shifted, 100) + _div(shifted, 400) + _div((m + 9) % 12 * 153 + 2, 5) + d - 1 - 719468 - 146097


def known_zone(column: str) -> Column:
    """The column if it is a region of the time zone database, else null (a wrong name must not end the job)."""
    names = ", ".join(f"'{z}'" for z in sorted(zoneinfo.available_timezones()))
    return F.expr(f"CASE WHEN `{column}` IN ({names}) THEN `{column}` END")


def with_instant(df: DataFrame, text: str, out: str, zone: Column | None = None, day_order: Column | None = None) -> DataFrame:
    """``df`` and the column ``out``: microseconds since 1970 (UTC) of the notation in ``text``, null if it denotes none.

    zone: region whose clocks hold where the text has no zone; null there gives null, unless the text has a zone.
    day_order: ``mdy`` or ``dmy`` (also for null) where day and month are both numbers. Impossible dates and times, zones
    that aren't known and null, empty or blank texts give null. A local reading that occurs twice means its first
    occurrence; a skipped one moves forward by the skip. Digits beyond microseconds are cut off.
    """
    parts, v = f"__{out}_parts", f"__{out}_v"
    zone = F.lit(None).cast("string") if zone is None else zone
    day_order = F.lit("dmy") if day_order is None else day_order
    at = {name: k + 1 for k, name in enumerate(_FIELDS)}
    # Every stage is fenced by a generator of one row: each is a small compiled method, and filters on the result don't
    # copy the expressions of the stages.
    df = df.withColumn(parts, _fence(F.split(F.regexp_replace(F.col(text), PATTERN, _REPLACEMENT), _SEP)))
    text_of = lambda n: F.nullif(F.col(parts)[at[n]], F.lit(""))
    # an empty group becomes null first: a failing cast is slow
    number = lambda n: F.expr(f"try_cast(nullif(`{parts}`[{at[n]}], '') as bigint)")
    matched = (F.size(parts) == len(_FIELDS) + 1) & (F.col(parts)[0] == _MARK)
    mdy = F.coalesce(F.lower(day_order), F.lit("dmy")) == "mdy"
    one = lambda x: x.cast("long")
    # stages hold arrays of integers, not structs: the optimizer can't take them apart again
    numbers = {
        "ep": number("ep"), "ep_len": one(F.length(F.ltrim(F.col(parts)[at["ep"]], F.lit("-")))), "y": number("y"), "m": number("m"), "d": number("d"), "na": number("na"), "nb": number("nb"),
        "mdy": one(mdy), "word": one(_lookup(MONTHS, F.lower(F.substring(F.col(parts)[at["word"]], 1, 3)))), "doy": number("doy"), "wk": number("wk"), "wd": F.coalesce(number("wd"), one(F.lit(1))),
    }
    clock = {
        "h": F.coalesce(number("h"), one(F.lit(0))), "i": F.coalesce(number("i"), one(F.lit(0))), "s": F.coalesce(number("s"), one(F.lit(0))),
        "f": F.coalesce(one(F.rpad(F.substring(text_of("f"), 1, 6), 6, "0")), one(F.lit(0))), "ap": one(F.when(F.lower(text_of("ap")) == "p", 12).when(text_of("ap").isNotNull(), 0)),
    }
    zones = {"zn": F.upper(text_of("zn")), "zo": F.translate(text_of("zo"), ":", ""), "rg": text_of("rg")}
    for mark, stage in (("d", numbers), ("c", clock), ("z", zones)):
        df = df.withColumn(v + mark, _fence(F.when(matched, F.array(*stage.values()))))
    df = df.drop(parts)
    place = {n: F.col(v + mark)[k] for mark, stage in (("d", numbers), ("c", clock), ("z", zones)) for k, n in enumerate(stage)}
    c = place.__getitem__
    year = c("y")
    swap = c("mdy") == 1
    month = F.coalesce(c("m"), F.when(swap, c("na")).otherwise(c("nb")), c("word"))
    df = df.withColumn(v + "1", _fence(F.array(month, F.coalesce(c("d"), F.when(swap, c("nb")).otherwise(c("na"))), one(_leap(year)))))
    m, d, leap = (F.col(v + "1")[k] for k in range(3))
    leap = leap == 1
    length = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    civil = F.when(c("doy").isNotNull() | c("wk").isNotNull(), days_from_civil(year, F.lit(1), F.lit(1))).when(m.between(1, 12) & d.between(1, length), days_from_civil(year, m, d))
    df = df.withColumn(v + "2", _fence(civil))
    jan1 = F.col(v + "2")
    # ISO week 1 holds 4 January; Monday is 0 in (days + 3) % 7
    week1 = jan1 + 3 - F.pmod(jan1 + 6, F.lit(7))
    # a year has a week 53 if it starts on a Thursday, or on a Wednesday and is a leap year
    first = F.pmod(jan1 + 3, F.lit(7))
    weeks = F.when((first == 3) | (leap & (first == 2)), 53).otherwise(52)
    day = (
        F.when(c("doy").isNotNull(), F.when(c("doy").between(1, F.when(leap, 366).otherwise(365)), jan1 + c("doy") - 1))
        .when(c("wk").isNotNull(), F.when(c("wk").between(1, weeks), week1 + (c("wk") - 1) * 7 + c("wd") - 1))
        .otherwise(jan1)
    )
    hour = F.when(c("ap").isNull(), c("h")).when(c("h").between(1, 12), c("h") % 12 + c("ap"))
    df = df.withColumn(v + "3", _fence(F.array(one(F.when(year >= 1, day)), one(hour))))
    day, hour = F.col(v + "3")[0], F.col(v + "3")[1]
    possible = ((hour < 24) & (c("i") < 60) & (c("s") < 60)) | ((hour == 24) & (c("i") == 0) & (c("s") == 0) & (c("f") == 0))
    local = F.when(possible, (day * 86400 + hour * 3600 + c("i") * 60 + c("s")) * F.lit(1000000).cast("long") + c("f"))
    shown = one(F.substring(c("zo"), 2, 4))
    east = F.when(F.length(c("zo")) <= 3, shown * 60).when(shown % 100 < 60, _div(shown, 100) * 60 + shown % 100)
    east = F.when(east <= 18 * 60, F.when(c("zo").startswith("-"), -east).otherwise(east))
    df = df.withColumn(v + "4", _fence(F.array(one(local), one(east), one(_lookup(ZONE_MINUTES, c("zn"))))))
    local, east, named = (F.col(v + "4")[k] for k in range(3))
    fixed = F.when(c("zn").isNull(), east).when(c("zo").isNull(), named).otherwise(east + named)
    df = df.withColumn(v + "5", F.coalesce(c("rg"), zone))
    in_region = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), known_zone(v + "5")))
    epoch = F.when(c("ep_len") <= 10, c("ep") * 1000000).when(c("ep_len") == 13, c("ep") * 1000).when(c("ep_len") == 16, c("ep")).otherwise(_div(c("ep"), 1000))
    value = F.when(c("ep").isNotNull(), epoch).when(c("zo").isNotNull() | c("zn").isNotNull(), local - fixed.cast("long") * 60000000).otherwise(in_region)
    return df.withColumn(out, _fence(value.cast("long"))).drop(*[v + x for x in ("d", "c", "z", "1", "2", "3", "4", "5")])
