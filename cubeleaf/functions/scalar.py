"""Numeric, complex and conditional functions, element by element."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.parser import LanguageError
from ..plans.values import inf, nan, NUMBERS, Value, complex_of, lift, literal, need, to_complex, to_float

#: Fixed value: the speed of light in m/s.
C_LIGHT = 299792458.0


def raw(f):
    """Marks a function that takes unlowered arguments."""
    f.raw = True
    return f


def modulus(x: Column) -> Column:
    return F.sqrt(x["re"] * x["re"] + x["im"] * x["im"])


def _real(f: Callable[[Column], Column], of_complex: Callable[[Column], Column] | None = None) -> Callable[[Value], Value]:
    def g(v: Value) -> Value:
        if v.type == "complex":
            if of_complex is None:
                raise LanguageError("the function isn't defined for complex numbers")
            return lift(of_complex, "complex", v)
        return lift(f, "float", to_float(v))

    return g


def _log(base10: bool) -> Callable[[Column], Column]:
    f = F.log10 if base10 else F.ln
    return lambda x: F.when(x > 0, f(F.when(x > 0, x))).when(x == 0, -inf()).otherwise(nan())


def _exp_complex(x: Column) -> Column:
    e = F.exp(x["re"])
    return complex_of(e * F.cos(x["im"]), e * F.sin(x["im"]))


def _log_complex(scale: float) -> Callable[[Column], Column]:
    return lambda x: complex_of(_log(False)(modulus(x)) * scale, F.atan2(x["im"], x["re"]) * scale)


def _sqrt_complex(x: Column) -> Column:
    r, t = F.sqrt(modulus(x)), F.atan2(x["im"], x["re"]) / 2
    return complex_of(r * F.cos(t), r * F.sin(t))


def _abs(v: Value) -> Value:
    if v.type == "complex":
        return lift(modulus, "float", v)
    need(NUMBERS, "abs", v)
    return replace(lift(F.abs, v.type, v), unit=v.unit)


def _times(n: int) -> Callable[[Value], Value]:
    def g(v: Value) -> Value:
        if v.type == "complex":
            def f(x: Column) -> Column:
                out = x
                for _ in range(n - 1):
                    out = complex_of(out["re"] * x["re"] - out["im"] * x["im"], out["re"] * x["im"] + out["im"] * x["re"])
                return out

            return lift(f, "complex", v)
        need(NUMBERS, "a power", v)
        return lift(lambda x: x * x if n == 2 else x * x * x, v.type, v)

    return g


def _norm(v: Value) -> Value:
    if v.type == "complex":
        return lift(lambda x: x["re"] * x["re"] + x["im"] * x["im"], "float", v)
    return _times(2)(v)


def _sign(v: Value) -> Value:
    need(NUMBERS, "sign", v)
    return lift(lambda x: F.when(x > 0, 1).when(x < 0, -1).otherwise(0).cast("bigint" if v.type == "int" else "double") if v.type == "int" else F.when(F.isnan(x), 0.0).when(x > 0, 1.0).when(x < 0, -1.0).otherwise(0.0), v.type, v)


def _large(x: Column, f: Column) -> Column:
    """f where x has a fraction at all; above 2**52 doubles are whole."""
    return F.when(F.abs(x) < F.lit(2.0**52), f).otherwise(x)


def _rounding(f: Callable[[Column], Column]) -> Callable[[Value], Value]:
    def g(v: Value) -> Value:
        need(NUMBERS, "rounding", v)
        return v if v.type == "int" else lift(lambda x: _large(x, f(x).cast("double")), "float", v)

    return g


def round_half_away(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5))


def truncated(x: Column) -> Column:
    """A double as bigint: cut, saturated, NaN to 0."""
    top = F.lit(float(2**63))
    inside = F.when((x < top) & (x >= -top), x).otherwise(F.lit(0.0)).cast("bigint")
    return F.when(F.isnan(x), F.lit(0).cast("bigint")).when(x >= top, F.lit(2**63 - 1)).when(x < -top, F.lit(-(2**63) + 1) - 1).otherwise(inside)


def _int(v: Value) -> Value:
    need((*NUMBERS, "bool"), "int", v)
    if v.type == "int":
        return v
    return lift(truncated, "int", v) if v.type == "float" else lift(lambda x: x.cast("bigint"), "int", v)


def _part(name: str) -> Callable[[Value], Value]:
    def g(v: Value) -> Value:
        if v.type == "complex":
            return lift(lambda x: x[name], "float", v)
        f = to_float(v)
        return f if name == "re" else lift(lambda x: x * 0.0, "float", f)

    return g


def _arg(v: Value) -> Value:
    z = to_complex(v)
    return lift(lambda x: F.atan2(x["im"], x["re"]), "float", z)


def _conj(v: Value) -> Value:
    return lift(lambda x: complex_of(x["re"], -x["im"]), "complex", v) if v.type == "complex" else v


def _complex(a: Value, b: Value) -> Value:
    return lift(complex_of, "complex", to_float(a), to_float(b))


def _is(f: Callable[[Column], Column], any_part: bool = True) -> Callable[[Value], Value]:
    def g(v: Value) -> Value:
        if v.type == "complex":
            return lift(lambda x: f(x["re"]) | f(x["im"]), "bool", v)
        return lift(f, "bool", to_float(v))

    return g


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != inf())


def _nonfinite(v: Value) -> Value:
    if v.type == "complex":
        return lift(lambda x: ~(is_finite(x["re"]) | is_finite(x["im"])), "bool", v)
    return lift(lambda x: ~is_finite(x), "bool", to_float(v))


def _pow(a: Value, b: Value) -> Value:
    from ..plans.lower import _arithmetic

    return _arithmetic("**", a, b)


def _fmod(a: Value, b: Value) -> Value:
    need(NUMBERS, "fmod", a, b)
    if a.type == b.type == "int":
        return lift(lambda x, y: F.when(y == 0, x).otherwise(x % F.when(y != 0, y)), "int", a, b)
    return lift(lambda x, y: F.when(y == 0, nan()).otherwise(x % F.when(y != 0, y)), "float", to_float(a), to_float(b))


def _iif(c: Value, a: Value, b: Value) -> Value:
    need("bool", "iif", c)
    if a.type != b.type:
        if a.type in ("int", "float", "bool") and b.type in ("int", "float", "bool"):
            a, b = (to_float(v) if "float" in (a.type, b.type) else v.of(v.col.cast("array<bigint>" if v.is_array else "bigint"), "int") for v in (a, b))
        elif "complex" in (a.type, b.type):
            a, b = to_complex(a), to_complex(b)
        elif "null" not in (a.type, b.type):
            raise LanguageError("iif needs two values of one type")
    kind = a.type if a.type != "null" else b.type
    if not c.is_array and (a.is_array or b.is_array):
        shaped = a if a.is_array else b
        fill = lambda v: v.col if v.is_array else F.transform(shaped.col, lambda _: v.col)
        return replace(shaped, col=F.when(c.col, fill(a)).when(~c.col, fill(b)), type=kind, literal=None)
    return lift(lambda t, x, y: F.when(t, x).when(~t, y), kind, c, a, b)


def _near(absolute: bool):
    def g(a: Value, b: Value, tolerance: Value | None = None) -> Value:
        from ..plans.lower import near

        return near(to_float(a), to_float(b), tolerance.col.cast("double") if tolerance is not None else F.lit(1e-13), absolute)

    return g


def _min_max(name: str):
    def g(a: Value, b: Value | None = None) -> Value:
        if b is None:
            from .arrays import REDUCE

            return REDUCE[name](a)
        less = name == "min"
        if "complex" in (a.type, b.type):
            return lift(lambda x, y: F.when((modulus(x) <= modulus(y)) if less else (modulus(x) >= modulus(y)), x).otherwise(y), "complex", to_complex(a), to_complex(b))
        need(NUMBERS, name, a, b)
        if a.type == b.type == "int":
            return lift(F.least if less else F.greatest, "int", a, b)
        f = F.least if less else F.greatest
        return lift(lambda x, y: F.when(F.isnan(x) | F.isnan(y), nan()).otherwise(f(x, y)), "float", to_float(a), to_float(b))

    return g


@raw
def _rownumber(ctx) -> Value:
    if ctx.row is None:
        raise LanguageError("the table has no row numbers")
    return Value(ctx.row + 1, "int")


@raw
def _rowid(ctx) -> Value:
    if ctx.row is None:
        raise LanguageError("the table has no row numbers")
    return Value(ctx.row + 0, "int")


@raw
def _grouping(ctx, key) -> Value:
    if ctx.grouping is None or key[0] != "col":
        raise LanguageError("grouping() needs a key of a grouped select")
    return Value(ctx.grouping(key[1]), "bool")


@raw
def _iscolumn(ctx, name) -> Value:
    return literal(name[1] in ctx.columns)


@raw
def _iskeyword(ctx, name) -> Value:
    table, _, key = name[1].rpartition("::")
    at = ctx.keywords if not table else ctx.keywords.get("columns", {}).get(table, {})
    for part in key.split("."):
        if not isinstance(at, dict) or part not in at:
            return literal(False)
        at = at[part]
    return literal(True)


def _atan2(a: Value, b: Value) -> Value:
    return lift(lambda x, y: F.atan2(x, y), "float", to_float(a), to_float(b))


_ONE = {
    "abs": _abs, "amplitude": _abs, "ampl": _abs, "norm": _norm, "square": _times(2), "sqr": _times(2), "cube": _times(3),
    "sqrt": _real(lambda x: F.when(x >= 0, F.sqrt(F.when(x >= 0, x))).when(F.isnan(x) | (x < 0), nan()), _sqrt_complex), "exp": _real(F.exp, _exp_complex),
    "log": _real(_log(False), _log_complex(1.0)), "ln": _real(_log(False), _log_complex(1.0)), "log10": _real(_log(True), _log_complex(1 / math.log(10))),
    "sin": _real(F.sin), "cos": _real(F.cos), "tan": _real(F.tan), "asin": _real(F.asin), "acos": _real(F.acos), "atan": _real(F.atan), "sinh": _real(F.sinh), "cosh": _real(F.cosh), "tanh": _real(F.tanh),
    "sign": _sign, "floor": _rounding(F.floor), "ceil": _rounding(F.ceil), "round": _rounding(round_half_away), "int": _int, "integer": _int,
    "real": _part("re"), "imag": _part("im"), "arg": _arg, "phase": _arg, "conj": _conj,
    "isnan": _is(F.isnan), "isinf": _is(lambda x: F.abs(x) == inf()), "isfinite": _is(is_finite), "nonfinite": _nonfinite, "isnonfinite": _nonfinite,
}

FUNCTIONS = {name: (1, 1, f) for name, f in _ONE.items()} | {
    "pow": (2, 2, _pow), "atan2": (2, 2, _atan2), "fmod": (2, 2, _fmod), "complex": (2, 2, _complex), "iif": (3, 3, _iif), "near": (2, 3, _near(False)), "nearabs": (2, 3, _near(True)),
    "min": (1, 2, _min_max("min")), "max": (1, 2, _min_max("max")), "pi": (0, 0, lambda: literal(math.pi)), "e": (0, 0, lambda: literal(math.e)), "c": (0, 0, lambda: literal(C_LIGHT)),
    "rownumber": (0, 0, _rownumber), "rownr": (0, 0, _rownumber), "rowid": (0, 0, _rowid), "grouping": (1, 1, _grouping), "iscolumn": (1, 1, _iscolumn), "iskeyword": (1, 1, _iskeyword),
}
