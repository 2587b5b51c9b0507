"""Conversions of epochs and positions in closed form: ``meas.epoch``, ``meas.itrfxyz``, ``meas.wgs``."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.parser import LanguageError
from ..plans.values import Value, lift, to_float

#: TAI - UTC in seconds from the first day (MJD) of each step since 1972.
LEAP_SECONDS = [
    (41317, 10), (41499, 11), (41683, 12), (42048, 13), (42413, 14), (42778, 15), (43144, 16), (43509, 17), (43874, 18), (44239, 19), (44786, 20), (45151, 21), (45516, 22), (46247, 23),
    (47161, 24), (47892, 25), (48257, 26), (48804, 27), (49169, 28), (49534, 29), (50083, 30), (50630, 31), (51179, 32), (53736, 33), (54832, 34), (56109, 35), (57204, 36), (57754, 37),
]
#: The WGS84 ellipsoid, semi-major axis in metres and flattening.
_AXIS, _FLATTENING = 6378137.0, 1 / 298.257223563


def tai_minus_utc(day: Column) -> Column:
    """Leap seconds at an MJD day of UTC."""
    out = F.when(day < LEAP_SECONDS[0][0], F.lit(float(LEAP_SECONDS[0][1])))
    for (_, n), (end, _) in zip(LEAP_SECONDS[:-1], LEAP_SECONDS[1:], strict=True):
        out = out.when(day < end, F.lit(float(n)))
    return out.otherwise(F.lit(float(LEAP_SECONDS[-1][1])))


def to_tai(kind: str, seconds: Column) -> Column:
    if kind in ("TT", "TDT"):
        return seconds - 32.184
    return seconds + tai_minus_utc(seconds / 86400) if kind == "UTC" else seconds


def from_tai(kind: str, tai: Column) -> Column:
    if kind in ("TT", "TDT"):
        return tai + 32.184
    if kind == "UTC":
        first = tai - tai_minus_utc(tai / 86400)
        return tai - tai_minus_utc(first / 86400)
    return tai


def sidereal(ut1: Column) -> Column:
    """Greenwich mean sidereal time (1982) in radians, of seconds of UT1."""
    day = F.floor(ut1 / 86400)
    t = (day - 51544.5) / 36525
    fraction = ut1 / 86400 - day
    s = 24110.54841 + 8640184.812866 * t + 0.093104 * t * t - 6.2e-6 * t * t * t
    turns = s / 86400 + fraction * (1.002737909350795 + 5.9006e-11 * t - 5.9e-15 * t * t)
    return (turns - F.floor(turns)) * (2 * math.pi)


def epoch(ctx, *args) -> Value:
    """meas.epoch('TAI', t[, 'UTC']): seconds in, seconds out."""
    from ..plans.lower import lower

    names = [a[1].upper() for a in args if a[0] == "lit" and isinstance(a[1], str)]
    values = [to_float(lower(a, ctx)) for a in args if not (a[0] == "lit" and isinstance(a[1], str))]
    if not names or len(values) != 1:
        raise LanguageError("meas.epoch takes a time scale, a time and its time scale")
    to, of = names[0], names[1] if len(names) > 1 else "UTC"
    if to in ("GMST", "GMST1"):
        return lift(lambda x: sidereal(from_tai("UTC", to_tai(of, x))) * (43200 / math.pi), "float", values[0])
    for k in (to, of):
        if k == "UT1" and to != of:
            raise LanguageError("UT1 differs from UTC by up to 0.9 s: converting it needs a table of the Earth's orientation")
        if k not in ("UTC", "UT1", "TAI", "TT", "TDT"):
            raise LanguageError(f"no conversion to or from {k}")
    return values[0] if to == of else lift(lambda x: from_tai(to, to_tai(of, x)), "float", values[0])


def xyz(lon: Value, lat: Value, height: Value) -> Value:
    """Geodetic longitude, latitude and height to geocentric metres."""
    l, b, h = (to_float(v).col for v in (lon, lat, height))
    e2 = _FLATTENING * (2 - _FLATTENING)
    n = F.lit(_AXIS) / F.sqrt(1 - e2 * F.sin(b) * F.sin(b))
    return Value(F.array((n + h) * F.cos(b) * F.cos(l), (n + h) * F.cos(b) * F.sin(l), (n * (1 - e2) + h) * F.sin(b)), "float", 1)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _geodetic(p: pd.Series) -> pd.Series:
    x, y, z = np.array(p.tolist(), float).reshape(-1, 3).T
    e2 = _FLATTENING * (2 - _FLATTENING)
    r = np.hypot(x, y)
    lat = np.arctan2(z, r * (1 - e2))
    for _ in range(8):  # each round gains some five digits
        n = _AXIS / np.sqrt(1 - e2 * np.sin(lat) ** 2)
        lat = np.arctan2(z + e2 * n * np.sin(lat), r)
    n = _AXIS / np.sqrt(1 - e2 * np.sin(lat) ** 2)
    height = r * np.cos(lat) + z * np.sin(lat) - _AXIS * _AXIS / n
    return pd.Series(list(np.stack([np.arctan2(y, x), lat, height], axis=1)))


def wgs(p: Value) -> Value:
    """Geocentric metres to [longitude, latitude, height]."""
    return Value(_geodetic(to_float(p).col), "float", 1)


epoch.raw = True
FUNCTIONS = {"meas.epoch": (2, 3, epoch), "meas.itrfxyz": (3, 3, xyz), "meas.wgs": (1, 1, wgs)}
