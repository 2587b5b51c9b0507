"""Angles, positions on the sky and primary beams."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.parser import LanguageError, angle_value
from ..plans.values import nan, Value, lift, literal, to_float
from .scalar import C_LIGHT, is_finite


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def hms_text(x: Column) -> Column:
    ms = F.pmod(F.rint(F.pmod(x * (12 / math.pi), F.lit(24.0)) * 3_600_000).cast("bigint"), F.lit(86_400_000))
    text = F.concat(_two(F.floor(ms / 3_600_000)), F.lit("h"), _two(F.floor(ms / 60_000) % 60), F.lit("m"), _two(F.floor(ms / 1000) % 60), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
    return F.when(is_finite(x) & (F.abs(x) <= 1e9), text).otherwise(F.lit("00h00m00.000"))


def dms_text(x: Column) -> Column:
    mas = F.rint(F.abs(x) * (180 / math.pi) * 3_600_000).cast("bigint")
    d = F.floor(mas / 3_600_000)
    degrees = F.when(d > 999, F.lit("***")).otherwise(F.lpad(d.cast("string"), 3, "0"))
    text = F.concat(F.when(x < 0, "-").otherwise("+"), degrees, F.lit("d"), _two(F.floor(mas / 60_000) % 60), F.lit("m"), _two(F.floor(mas / 1000) % 60), F.lit("."), F.lpad((mas % 1000).cast("string"), 3, "0"))
    return F.when(is_finite(x) & (F.abs(x) <= 1e9), text).otherwise(F.lit("+000d00m00.000"))


def _hdms(v: Value) -> Value:
    f = to_float(v)
    return Value(F.transform(f.col, lambda x, i: F.when(i % 2 == 0, hms_text(x)).otherwise(dms_text(x))), "string", 1)


def _normal(x: Column) -> Column:
    return x - 2 * math.pi * F.rint(x / (2 * math.pi))


def _angle(v: Value) -> Value:
    if isinstance(v.literal, str):
        x = angle_value(v.literal)
        if x is None:
            raise LanguageError(f"cannot parse angle {v.literal!r}")
        return literal(x)
    raise LanguageError("angle needs a literal")


def angular_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    d = lon2 - lon1
    x = F.cos(lat2) * F.sin(d)
    y = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(d)
    z = F.sin(lat1) * F.sin(lat2) + F.cos(lat1) * F.cos(lat2) * F.cos(d)
    fine = is_finite(lon1) & is_finite(lat1) & is_finite(lon2) & is_finite(lat2)
    return F.when(fine, F.atan2(F.hypot(x, y), z)).otherwise(nan())


def _angdist(*vs: Value) -> Value:
    if len(vs) == 4:
        return lift(angular_distance, "float", *(to_float(v) for v in vs))
    if len(vs) != 2 or not all(v.is_array for v in vs):
        raise LanguageError("angdist takes four angles or two [lon, lat] arrays")
    a, b = (to_float(v).col for v in vs)
    return Value(angular_distance(F.element_at(a, 1), F.element_at(a, 2), F.element_at(b, 1), F.element_at(b, 2)), "float")


#: Geocentric positions of observatories, in metres.
OBSERVATORIES = {
    "ACA": (2225066.246, -5440107.534, -2481532.701),
    "ALMA": (2225142.180, -5440307.370, -2481029.852),
    "AMI-LA": (3911868.736, 5037665.689, 6542.364),
    "APEX": (2225035.295, -5441203.575, -2479295.528),
    "ARECIBO": (2390453.918, -5564823.910, 1994645.864),
    "ASKAP": (-2558266.718, 5095672.177, -2849020.838),
    "ASTE": (2230809.332, -5440193.145, -2475719.544),
    "ATA": (-2524087.896, -4123458.942, 4147779.692),
    "ATCA": (-4750915.837, 2792906.182, -3200483.747),
    "ATF": (-1601322.656, -5042206.592, 3554529.675),
    "BIMA": (-2523862.038, -4123592.799, 4147750.369),
    "CARMA": (-2397389.652, -4482068.563, 3843528.415),
    "CLRO": (-2358329.000, -4773813.000, 3503132.000),
    "DRAO": (-2019457.524, -3643335.279, 4814486.489),
    "DSA2000": (-2213052.895, -4485368.237, 3947303.822),
    "DWL": (3839243.707, 430428.149, 5058010.560),
    "EOVSA": (-2409879.570, -4478074.657, 3838758.218),
    "EVLA": (-1601156.673, -5041988.986, 3554879.237),
    "EFFELSBERG": (4033947.697, 486990.503, 4900430.644),
    "FAST": (-1668557.206, 5506838.527, 2744934.965),
    "GB": (882838.012, -4924481.883, 3944157.371),
    "GBT": (882590.375, -4924873.657, 3943729.069),
    "GMRT": (1657069.565, 5797969.000, 2073044.092),
    "HERA": (5109700.537, 2005356.584, -3240144.370),
    "IRAM PDB": (4524009.323, 468046.370, 4460320.529),
    "IRAM_PDB": (4523998.400, 468045.240, 4460309.760),
    "JCMT": (-5464591.766, -2492693.980, 2150963.055),
    "KAT-7": (5109207.818, 2006793.903, -3239127.738),
    "LWA1": (-1602199.957, -5042310.014, 3553970.000),
    "MERLIN2": (3834492.015, -173905.311, 5068199.884),
    "MOPRA": (-4682767.900, 2802617.500, -3291765.600),
    "MOST": (-4483189.535, 2648887.219, -3671990.767),
    "MUSER": (-2018698.604, 4280059.873, 4263974.852),
    "MWA": (-2559454.080, 5095372.146, -2849057.186),
    "MWA32T": (-2559453.959, 5095372.205, -2849057.190),
    "MEERKAT": (5109217.421, 2006797.675, -3239133.867),
    "NOEMA": (4523932.577, 468134.733, 4460286.496),
    "NRAO12M": (-1995960.489, -5037404.779, 3357054.606),
    "NRAO_GBT": (882587.973, -4924860.403, 3943718.437),
    "NRO": (-3862451.858, 3420134.194, 3740234.903),
    "OSF": (2202229.615, -5445184.762, -2485382.116),
    "OVRO-LWA": (-2409247.204, -4477889.562, 3839327.828),
    "PAPER_GB": (881663.872, -4925025.380, 3943718.410),
    "PAPER_SA": (5109700.537, 2005356.584, -3240144.370),
    "PKS": (-4554231.650, 2816759.097, -3454036.085),
    "SAO SMA": (-5462448.938, -2491969.937, 2164446.110),
    "SKA-LOW": (-2565044.430, 5085763.697, -2861062.440),
    "SKA-MID": (5109272.111, 2006809.134, -3239131.128),
    "SMA": (-5462448.949, -2491969.917, 2164446.105),
    "SMT": (-1828782.656, -5054436.839, 3427878.905),
    "VLA": (-1601185.365, -5041977.547, 3554875.870),
    "WSRT": (3828488.864, 443253.420, 5064977.777),
    "E-MERLIN": (3834492.015, -173905.311, 5068199.884),
}


def _observatory(v: Value) -> Value:
    xyz = OBSERVATORIES.get(str(v.literal).strip().upper())
    if xyz is None:
        raise LanguageError(f"unknown observatory {v.literal!r}")
    return Value(F.array(*(F.lit(x) for x in xyz)), "float", 1)


def _gaussian(x: Value, width: Value) -> Value:
    return lift(lambda t, h: F.exp(-4 * math.log(2) * (t / h) * (t / h)), "float", to_float(x), to_float(width))


def _ellipse(*vs: Value) -> Value:
    def f(dlon: Column, dlat: Column, major: Column, minor: Column, pa: Column) -> Column:
        u = dlon * F.sin(pa) + dlat * F.cos(pa)
        v = dlon * F.cos(pa) - dlat * F.sin(pa)
        return F.exp(-4 * math.log(2) * ((u / major) * (u / major) + (v / minor) * (v / minor)))

    return lift(f, "float", *(to_float(v) for v in vs))


def bessel_j1(x: np.ndarray) -> np.ndarray:
    """J1 by its integral: (1/pi) int_0^pi cos(t - x sin t) dt; the periodic rule converges geometrically."""
    x = np.atleast_1d(np.asarray(x, np.float64))
    n = int(64 + 2 * np.ceil(np.max(np.abs(x), initial=0.0)))
    t = (np.arange(n) + 0.5) * (np.pi / n)
    return np.cos(t[None, :] - x[:, None] * np.sin(t)[None, :]).mean(axis=1)


def airy_power(theta: np.ndarray, diameter: np.ndarray, freq: np.ndarray, blockage: np.ndarray) -> np.ndarray:
    x = np.pi * diameter * freq / C_LIGHT * np.sin(theta)

    def somb(z: np.ndarray) -> np.ndarray:
        safe = np.where(np.abs(z) < 1e-8, 1.0, z)
        return np.where(np.abs(z) < 1e-8, 1.0, 2 * bessel_j1(safe) / safe)

    e = blockage / diameter
    return ((somb(x) - e * e * somb(e * x)) / (1 - e * e)) ** 2


@F.pandas_udf(T.DoubleType())
def _airy_udf(theta: pd.Series, diameter: pd.Series, freq: pd.Series, blockage: pd.Series) -> pd.Series:
    return pd.Series(airy_power(*(x.to_numpy(np.float64) for x in (theta, diameter, freq, blockage))))


def _airy(theta: Value, diameter: Value, freq: Value, blockage: Value | None = None) -> Value:
    if any(v.is_array for v in (theta, diameter, freq)):
        raise LanguageError("pbairy takes scalars")
    return Value(_airy_udf(to_float(theta).col, to_float(diameter).col, to_float(freq).col, to_float(blockage).col if blockage is not None else F.lit(0.0)), "float")


FUNCTIONS = {
    "hms": (1, 1, lambda v: lift(hms_text, "string", to_float(v))), "dms": (1, 1, lambda v: lift(dms_text, "string", to_float(v))), "hdms": (1, 1, _hdms),
    "normangle": (1, 1, lambda v: lift(_normal, "float", to_float(v))), "angle": (1, 1, _angle),
    **{n: (2, 4, _angdist) for n in ("angdist", "angdistx", "angulardistance", "angulardistancex")},
    "observatory": (1, 1, _observatory), "pbgaussian": (2, 2, _gaussian), "pbellipse": (5, 5, _ellipse), "pbairy": (3, 4, _airy),
}
