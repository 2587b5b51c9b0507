"""Doppler conventions in closed form.

Each convention is defined by the ratio of observed to rest frequency; a conversion goes through that ratio.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.parser import LanguageError
from ..plans.values import Value, lift, to_float
from .scalar import C_LIGHT

NAMES = {"doppler", "radialvelocity", "shiftfreq", "restfrequency"}
_KIND = {"radio": "radio", "optical": "optical", "z": "optical", "ratio": "ratio", "beta": "beta", "true": "beta", "relativistic": "beta", "gamma": "gamma"}


def _checked(good: Column, value: Column, what: str) -> Column:
    return F.when(good, value).otherwise(F.raise_error(F.lit(what)))


def ratio_of(kind: str, d: Column) -> Column:
    """Observed over rest frequency."""
    if kind == "radio":
        return 1 - d
    if kind == "optical":
        return 1 / (d + 1)
    if kind == "ratio":
        return d
    if kind == "beta":
        return _checked(F.abs(d) <= 1, F.sqrt((1 - d) / (1 + d)), "a velocity over c must lie in [-1, 1]")
    return _checked(F.abs(d) >= 1, d * (1 - F.sqrt(1 - 1 / (d * d))), "a Lorentz factor must be at least 1")


def shift_of(kind: str, f: Column) -> Column:
    """The shift in a convention, from the ratio."""
    return {"radio": 1 - f, "optical": 1 / f - 1, "ratio": f, "beta": (1 - f * f) / (1 + f * f), "gamma": (1 + f * f) / (2 * f)}[kind]


def call(ctx, name: str, args: list) -> Value:
    from ..plans.lower import lower

    if name == "meas.doppler":
        names = [a[1] for a in args if a[0] == "lit" and isinstance(a[1], str)]
        values = [to_float(lower(a, ctx)) for a in args if not (a[0] == "lit" and isinstance(a[1], str))]
        if len(names) != 2 or len(values) != 1 or any(n.lower() not in _KIND for n in names):
            raise LanguageError("meas.doppler takes the new convention, a value and its convention")
        to, of = (_KIND[n.lower()] for n in names)
        return values[0] if to == of else lift(lambda x: shift_of(to, ratio_of(of, x)), "float", values[0])
    v = [to_float(lower(a, ctx)) for a in args]
    if name == "doppler":
        return lift(lambda f, r: shift_of("beta", f / r), "float", *v)
    if name == "radialvelocity":
        return lift(lambda f, r: shift_of("beta", f / r) * C_LIGHT, "float", *v) if len(v) == 2 else lift(lambda d: d * C_LIGHT, "float", *v)
    factor = ratio_of
    if name == "shiftfreq":
        return lift(lambda d, f: factor("beta", d) * f, "float", *v)
    return lift(lambda f, d: f / factor("beta", d), "float", *v)
