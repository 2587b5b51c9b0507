"""Dates as MJD days, and their parts and texts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.parser import UNITS, LanguageError, date_value
from ..plans.values import Value, lift, literal, need, to_float


def _days(v: Value) -> Value:
    """Epochs in other time units become days."""
    need(("int", "float"), "a date function", v)
    f = to_float(v)
    if v.unit in UNITS and UNITS[v.unit][0] == "time" and v.unit != "d":
        return lift(lambda x: x * (UNITS[v.unit][1] / 86400), "float", f)
    return f


def day_of(x: Column) -> Column:
    return F.date_add(F.lit("1858-11-17").cast("date"), F.floor(x).cast("int"))


def _milliseconds(x: Column) -> Column:
    """Milliseconds of the day, rounded half to even; the day after starts over."""
    return F.pmod(F.rint((x - F.floor(x)) * 86400000.0).cast("bigint"), F.lit(86400000))


def _parse(s: Column) -> Column:
    """MJD days of the texts that literals may have, without fixed layout."""
    iso = F.regexp_replace(s, r"[/T ](?=\d{1,2}:)", " ")
    iso = F.regexp_replace(iso, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    stamp = F.coalesce(F.try_to_timestamp(iso, F.lit("yyyy-M-d H:m:s")), F.try_to_timestamp(iso, F.lit("yyyy-M-d H:m")), F.try_to_timestamp(iso, F.lit("yyyy-M-d")), F.try_to_timestamp(iso, F.lit("dMMMyyyy")), F.try_to_timestamp(iso, F.lit("d-MMM-yyyy")), F.try_to_timestamp(iso))
    days = F.unix_micros(stamp).cast("double") / 86400e6 + 40587.0
    return F.when(stamp.isNull(), F.raise_error(F.concat(F.lit("cannot parse date "), s))).otherwise(days)


def _datetime(v: Value | None = None) -> Value:
    if v is None:
        return Value(F.unix_micros(F.current_timestamp()).cast("double") / 86400e6 + 40587.0, "float", unit="d")
    if v.type == "string":
        if isinstance(v.literal, str):
            x = date_value(v.literal)
            if x is None:
                raise LanguageError(f"cannot parse date {v.literal!r}")
            return literal(x)
        return lift(_parse, "float", v)
    return _days(v)


def _date(v: Value | None = None) -> Value:
    return lift(lambda x: F.floor(x).cast("double"), "float", _datetime(v))


def _time(v: Value | None = None) -> Value:
    return lift(lambda x: (x - F.floor(x)) * (2 * math.pi), "float", _datetime(v))


def _part(f):
    return lambda v: lift(lambda x: f(day_of(x)).cast("bigint"), "int", _datetime(v))


def _iso_weekday(d: Column) -> Column:
    return F.weekday(d) + 1


def _week(d: Column) -> Column:
    """Weeks that end with the year's fourth day and the weekday; not ISO, and 0 is possible."""
    day = F.dayofyear(d) - 4
    week = F.when(day + 7 >= 0, F.floor((day + 7) / 7)).otherwise(F.ceil((day + 7) / 7))
    rest = F.when(day >= 0, day % 7).otherwise(-((-day) % 7))
    later = ((rest >= 0) & (rest >= _iso_weekday(d))) | ((rest < 0) & (rest + 7 >= _iso_weekday(d)))
    return week + F.when(later, 1).otherwise(0)


def _clock(x: Column) -> Column:
    ms = _milliseconds(x)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(two(F.floor(ms / 3600000)), F.lit(":"), two(F.floor(ms / 60000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def _text(f):
    return lambda v: lift(f, "string", _datetime(v))


_cdate = _text(lambda x: F.date_format(day_of(x), "dd-MMM-yyyy"))
_ctime = _text(_clock)
_cdow = _text(lambda x: F.date_format(day_of(x), "E"))
_ctod = _text(lambda x: F.concat(F.date_format(day_of(x), "yyyy/MM/dd"), F.lit("/"), _clock(x)))

FUNCTIONS = {
    "datetime": (0, 1, _datetime), "mjd": (0, 1, _datetime), "mjdtodate": (1, 1, _datetime), "date": (0, 1, _date), "time": (0, 1, _time),
    "year": (1, 1, _part(F.year)), "month": (1, 1, _part(F.month)), "day": (1, 1, _part(F.dayofmonth)), "week": (1, 1, _part(_week)),
    "weekday": (1, 1, _part(_iso_weekday)), "dow": (1, 1, _part(_iso_weekday)),
    "cdate": (1, 1, _cdate), "ctime": (1, 1, _ctime), "cmonth": (1, 1, _text(lambda x: F.date_format(day_of(x), "MMM"))), "cdow": (1, 1, _cdow), "cweekday": (1, 1, _cdow), "ctod": (1, 1, _ctod), "cdatetime": (1, 1, _ctod),
}
