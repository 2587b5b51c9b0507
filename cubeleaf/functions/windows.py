"""Windows over the elements of array cells: running (centred, edges zero) and boxed (bins, the last partial)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.parser import LanguageError
from ..plans.values import Value, need, to_float
from .arrays import REDUCE, _ints, _windows, fractile, in_numpy, reducer, result_type

_NAMES = ["average", "mean", "avg", "median", "min", "max", "variance", "stddev", "samplevariance", "samplestddev", "sum", "avdev", "rms", "sumsqr", "sumsquare", "product", "fractile", "any", "all", "ntrue", "nfalse"]


def _window(name: str, boxed: bool):
    def g(v: Value, *args: Value) -> Value:
        if not v.is_array:
            raise LanguageError("windows need an array")
        fraction, width = (args[0], args[1]) if name == "fractile" else (None, args[0])
        if name in ("any", "all", "ntrue", "nfalse"):
            need("bool", name, v)
        kind = result_type(name, v)
        if v.rank == 1 and v.mask is None and not width.is_array:
            return _flat(name, v, width, fraction, kind, boxed)
        f = reducer(name, float(fraction.literal) if fraction is not None else None)
        return in_numpy(v, lambda x, m, k: _windows(f, x, m, k, boxed), _ints((width,)), kind)

    return g


def _flat(name: str, v: Value, width: Value, fraction: Value | None, kind: str, boxed: bool) -> Value:
    """One-dimensional windows as slices of the array."""
    n, w = F.size(v.col), width.col.cast("int")
    inner = v if kind == "int" or v.type == "bool" else to_float(v)

    def one(cut):
        part = Value(cut, inner.type, 1)
        return (fractile(cut, to_float(fraction).col) if fraction is not None else REDUCE[name](part).col).cast({"int": "bigint", "float": "double", "bool": "boolean"}[kind])

    empty = F.array().cast({"int": "array<bigint>", "float": "array<double>", "bool": "array<boolean>"}[kind])
    if boxed:
        step = F.when(w <= 0, F.greatest(n, F.lit(1))).otherwise(w)
        starts = F.when(n > 0, F.sequence(F.lit(1), n, step))
        out = F.transform(starts, lambda i: one(F.slice(inner.col, i, step)))
    else:
        zero = F.lit(False) if kind == "bool" else F.lit(0).cast("bigint" if kind == "int" else "double")
        places = F.when(n > 0, F.sequence(F.lit(1), n))
        out = F.transform(places, lambda i: F.when((i > w) & (i <= n - w), one(F.slice(inner.col, F.greatest(i - w, F.lit(1)), 2 * w + 1))).otherwise(zero))
        out = F.when(w < 0, F.raise_error(F.lit("a window's half-width must not be negative"))).otherwise(out)
    return Value(F.when(n > 0, out).otherwise(empty), kind, 1)


FUNCTIONS = {f"{p}{n}": ((3, 3) if n == "fractile" else (2, 2)) + (_window(n, p == "boxed"),) for p in ("running", "boxed") for n in _NAMES}
