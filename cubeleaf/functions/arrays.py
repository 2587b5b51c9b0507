"""Functions of array cells: reductions, collapses along axes, reshaping and masks.

Reductions and everything one-dimensional are built-in expressions over flat arrays.  What needs the shape of
cells of any rank (collapse, transpose, windows) goes through one vectorised numpy function.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.parser import LanguageError
from ..plans.values import nan, Value, complex_of, lift, need, to_float
from .scalar import modulus


def valid(v: Value) -> Column:
    """The elements that no mask excludes."""
    if not v.is_array:
        return F.array(v.col)
    if v.mask is None:
        return v.col
    kept = F.filter(F.arrays_zip(v.col.alias("x"), v.mask.alias("m")), lambda s: ~s["m"])
    return F.transform(kept, lambda s: s["x"])


def total(a: Column, zero: Column, f: Callable[[Column, Column], Column] = lambda x, y: x + y) -> Column:
    return F.aggregate(a, zero, f)


def mean(a: Column) -> Column:
    n = F.size(a)
    return F.when(n > 0, total(a, F.lit(0.0)) / F.when(n > 0, n)).otherwise(nan())


def variance(a: Column, sample: bool = False) -> Column:
    n, m = F.size(a), mean(a)
    squares = total(F.transform(a, lambda x: (x - m) * (x - m)), F.lit(0.0))
    d = n - 1 if sample else n
    return F.when(d > 0, squares / F.when(d > 0, d)).otherwise(nan())


def average_deviation(a: Column) -> Column:
    m = mean(a)
    return mean(F.transform(a, lambda x: F.abs(x - m)))


def fractile(a: Column, f: Column) -> Column:
    s = F.sort_array(a)
    at = F.floor((F.size(a) - 1) * f + 0.01).cast("int") + 1
    return F.when(F.size(a) == 0, F.raise_error(F.lit("fractile of an empty array"))).when((f < 0) | (f > 1), F.raise_error(F.lit("a fractile must lie in [0, 1]"))).otherwise(F.element_at(s, at).cast("double"))


def median(a: Column) -> Column:
    """Averages the middle two only of an even number of at most 100."""
    s, n = F.sort_array(a), F.size(a)
    low = F.floor((n - 1) / 2).cast("int") + 1
    two = (n % 2 == 0) & (n <= 100)
    value = F.when(two, (F.element_at(s, low) + F.element_at(s, low + 1)) / 2).otherwise(F.element_at(s, low)).cast("double")
    return F.when(n == 0, F.raise_error(F.lit("median of an empty array"))).otherwise(value)


def extreme(a: Column, greatest: bool, float_: bool) -> Column:
    out = F.array_max(a) if greatest else F.array_min(a)
    return F.when(F.exists(a, F.isnan), nan()).otherwise(out) if float_ else out


def _numbers(name: str, f: Callable[[Column], Column], keep_int: bool = False) -> Callable[[Value], Value]:
    def g(v: Value) -> Value:
        need(("int", "float", "bool"), name, v)
        if not (keep_int and v.type == "int"):
            v = to_float(v)
        return Value(f(valid(v)), v.type, unit=v.unit)

    return g


def _sum(v: Value) -> Value:
    if v.type == "complex":
        zero = complex_of(F.lit(0.0), F.lit(0.0))
        return Value(total(valid(v), zero, lambda x, y: complex_of(x["re"] + y["re"], x["im"] + y["im"])), "complex")
    if v.type == "int":
        return Value(total(valid(v), F.lit(0).cast("bigint")), "int")
    return Value(total(valid(to_float(v)), F.lit(0.0)), "float", unit=v.unit)


def _product(v: Value) -> Value:
    if v.type == "complex":
        one = complex_of(F.lit(1.0), F.lit(0.0))
        return Value(total(valid(v), one, lambda x, y: complex_of(x["re"] * y["re"] - x["im"] * y["im"], x["re"] * y["im"] + x["im"] * y["re"])), "complex")
    zero, kind = (F.lit(1).cast("bigint"), "int") if v.type == "int" else (F.lit(1.0), "float")
    return Value(total(valid(v if v.type == "int" else to_float(v)), zero, lambda x, y: x * y), kind)


def _sum_squares(v: Value) -> Value:
    if v.type == "complex":
        return Value(total(valid(lift(lambda x: x["re"] * x["re"] + x["im"] * x["im"], "float", v)), F.lit(0.0)), "float")
    zero = F.lit(0).cast("bigint") if v.type == "int" else F.lit(0.0)
    v = v if v.type == "int" else to_float(v)
    return Value(total(valid(v), zero, lambda s, x: s + x * x), v.type)


def _mean(v: Value) -> Value:
    if v.type == "complex":
        n = F.size(valid(v)).cast("double")
        s = _sum(v).col
        part = lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))  # noqa: E731  as the real mean of nothing
        return Value(complex_of(part(s["re"]), part(s["im"])), "complex")
    return Value(mean(valid(to_float(v))), "float", unit=v.unit)


def _extreme(greatest: bool) -> Callable[[Value], Value]:
    def g(v: Value) -> Value:
        if v.type == "complex":
            v = lift(modulus, "float", v)
        need(("int", "float"), "min or max", v)
        a = valid(v)
        out = extreme(a, greatest, v.type == "float")
        if v.mask is not None:
            out = F.when(F.size(a) == 0, F.lit(0).cast("bigint" if v.type == "int" else "double")).otherwise(out)
        return Value(out, v.type, unit=v.unit)

    return g


def _bools(name: str, f: Callable[[Column], Column], type_: str) -> Callable[[Value], Value]:
    def g(v: Value) -> Value:
        if v.type != "bool":
            raise LanguageError(f"{name} needs booleans, not {v.type}")
        return Value(f(valid(v)), type_)

    return g


def _rms(a: Column) -> Column:
    return F.sqrt(mean(F.transform(a, lambda x: x * x)))


#: Reductions of a cell to one value.
REDUCE: dict[str, Callable[[Value], Value]] = {
    "sum": _sum, "product": _product, "sumsqr": _sum_squares, "sumsquare": _sum_squares, "mean": _mean, "avg": _mean, "average": _mean, "min": _extreme(False), "max": _extreme(True),
    "median": _numbers("median", median), "variance": _numbers("variance", variance), "stddev": _numbers("stddev", lambda a: F.sqrt(variance(a))),
    "samplevariance": _numbers("samplevariance", lambda a: variance(a, True)), "samplestddev": _numbers("samplestddev", lambda a: F.sqrt(variance(a, True))),
    "rms": _numbers("rms", _rms), "avdev": _numbers("avdev", average_deviation),
    "any": _bools("any", lambda a: F.exists(a, lambda x: x), "bool"), "all": _bools("all", lambda a: F.forall(a, lambda x: x), "bool"),
    "ntrue": _bools("ntrue", lambda a: F.size(F.filter(a, lambda x: x)).cast("bigint"), "int"), "nfalse": _bools("nfalse", lambda a: F.size(F.filter(a, lambda x: ~x)).cast("bigint"), "int"),
}


def _fractile(v: Value, f: Value) -> Value:
    return Value(fractile(valid(to_float(v)), to_float(f).col), "float")


def _nelements(v: Value) -> Value:
    return Value((F.size(v.col) if v.is_array else F.lit(1)).cast("bigint"), "int")


def _ndim(v: Value) -> Value:
    return Value((F.size(v.shape) if v.shape is not None else F.lit(v.rank)).cast("bigint"), "int")


def shape_of(v: Value) -> Column:
    if not v.is_array:
        return F.array().cast("array<int>")
    return v.shape if v.shape is not None else F.array(F.size(v.col))


def _shape(v: Value) -> Value:
    return Value(shape_of(v).cast("array<bigint>"), "int", 1)


# --- cells of any rank, in numpy ------------------------------------------------------------------------------

_NUMPY: dict[str, Callable[[np.ndarray], object]] = {
    "sum": np.sum, "product": np.prod, "mean": np.mean, "avg": np.mean, "average": np.mean, "min": np.min, "max": np.max, "variance": np.var, "stddev": np.std,
    "samplevariance": lambda x: np.var(x, ddof=1) if len(x) > 1 else np.nan, "samplestddev": lambda x: np.std(x, ddof=1) if len(x) > 1 else np.nan,
    "rms": lambda x: np.sqrt(np.mean(np.square(x))), "avdev": lambda x: np.mean(np.abs(x - np.mean(x))), "sumsqr": lambda x: np.sum(np.square(x)), "sumsquare": lambda x: np.sum(np.square(x)),
    "any": np.any, "all": np.all, "ntrue": np.count_nonzero, "nfalse": lambda x: len(x) - np.count_nonzero(x),
}


def _np_median(x: np.ndarray) -> float:
    s = np.sort(x)
    k = (len(s) - 1) // 2
    return (s[k] + s[k + 1]) / 2 if len(s) % 2 == 0 and len(s) <= 100 else s[k]


_NUMPY["median"] = _np_median


#: What numpy gives along an axis exactly as for each row alone.
_EXACT = (np.min, np.max, np.any, np.all, np.count_nonzero)


def reducer(name: str, fraction: float | None = None) -> Callable[[np.ndarray], object]:
    if name == "fractile":
        return lambda x: np.sort(x)[int(np.floor((len(x) - 1) * fraction + 0.01))]
    return _NUMPY[name]


def _collapse(f, x: np.ndarray, m: np.ndarray, axes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    axes = sorted({a - 1 for a in axes if 1 <= a <= x.ndim})
    left = [d for d in range(x.ndim) if d not in axes]
    shape = tuple(x.shape[d] for d in left) or (1,)
    flat = np.transpose(x, left + axes).reshape(int(np.prod(shape)), -1)
    flags = np.transpose(m, left + axes).reshape(flat.shape)
    if f in _EXACT and flat.size and not flags.any():
        return np.asarray(f(flat, axis=1), np.float64).reshape(shape), np.zeros(shape, bool)
    out, none = np.zeros(len(flat)), np.zeros(len(flat), bool)
    for i, (row, flag) in enumerate(zip(flat, flags, strict=True)):
        good = row[~flag]
        none[i] = not len(good)
        out[i] = f(good) if len(good) else 0
    return out.reshape(shape), none.reshape(shape)


def _windows(f, x: np.ndarray, m: np.ndarray, widths: list[int], boxed: bool) -> tuple[np.ndarray, np.ndarray]:
    pad = 1 if boxed else 0
    w = [*widths, *[pad] * x.ndim][: x.ndim]
    if boxed:
        w = [max(n, 1) if k <= 0 else k for k, n in zip(w, x.shape, strict=True)]
        size = tuple(-(-n // k) for n, k in zip(x.shape, w, strict=True))
        cut = lambda at: tuple(slice(i * k, (i + 1) * k) for i, k in zip(at, w, strict=True))
        places = list(np.ndindex(size))
    else:
        size = x.shape
        cut = lambda at: tuple(slice(i - k, i + k + 1) for i, k in zip(at, w, strict=True))
        places = [at for at in np.ndindex(size) if all(k <= i < n - k for i, k, n in zip(at, w, size, strict=True))]
    out, none = np.zeros(size), np.ones(size, bool)
    for at in places:
        good = x[cut(at)].ravel()[~m[cut(at)].ravel()]
        if len(good):
            out[at], none[at] = f(good), False
    return out, none


_CELL = T.StructType([T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.ArrayType(T.DoubleType())), T.StructField("mask", T.ArrayType(T.BooleanType()))])


class _Cells:
    """The lists of an Arrow array, as views of one flat array."""

    def __init__(self, a: pa.Array):
        self.offsets, self.valid = a.offsets.to_numpy(), a.is_valid().to_numpy(zero_copy_only=False)
        flat = a.values
        self.flat = (flat.fill_null(False) if pa.types.is_boolean(flat.type) else flat).to_numpy(zero_copy_only=False)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.offsets[i] : self.offsets[i + 1]] if self.valid[i] else self.flat[:0]

    def is_null(self, i: int) -> bool:
        return not self.valid[i]


def _struct(made: list[tuple | None]) -> pa.Array:
    """Shapes, data and masks of cells as an array of _CELL; None for a missing one."""
    kind = to_arrow_type(_CELL)
    missing = np.array([c is None for c in made], bool)
    columns = []
    for at, numpy_type in enumerate((np.int32, np.float64, np.bool_)):
        parts = [np.asarray(c[at], numpy_type) if c is not None else np.zeros(0, numpy_type) for c in made]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        flat = pa.array(np.concatenate(parts) if parts else np.zeros(0, numpy_type), kind.field(at).type.value_type)
        columns.append(pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(missing, False)), flat, type=kind.field(at).type))
    return pa.StructArray.from_arrays(columns, fields=[kind.field(i) for i in range(3)])


def in_numpy(v: Value, f: Callable[[np.ndarray, np.ndarray, list[int]], tuple[np.ndarray, np.ndarray]], args: Column, type_: str) -> Value:
    """A cell function of (data, mask, whole numbers); data in the cell's shape, first axis fastest when flat."""

    @F.arrow_udf(_CELL)
    def run(shape: pa.Array, data: pa.Array, mask: pa.Array, ints: pa.Array) -> pa.Array:
        s, d, m, k = (_Cells(a) for a in (shape, data, mask, ints))
        made = []
        for i in range(len(data)):
            if d.is_null(i) or s.is_null(i):
                made.append(None)
                continue
            x = d[i].reshape(tuple(s[i]), order="F")
            flags = m[i]
            y, none = f(x, flags.reshape(x.shape, order="F") if len(flags) else np.zeros(x.shape, bool), [int(n) for n in k[i]])
            made.append((y.shape, y.ravel(order="F"), none.ravel(order="F")))
        return _struct(made)

    data = v.col.cast("array<int>").cast("array<double>") if v.type == "bool" else v.col.cast("array<double>")
    out = run(shape_of(v), data, v.mask if v.mask is not None else F.array().cast("array<boolean>"), args)
    cell = out["data"]
    if type_ == "bool":
        cell = F.transform(cell, lambda x: x != 0)
    elif type_ == "int":
        cell = cell.cast("array<bigint>")
    return Value(cell, type_, 2, out["shape"], out["mask"] if v.mask is not None else None)


def result_type(name: str, v: Value) -> str:
    if name in ("any", "all"):
        return "bool"
    if name in ("ntrue", "nfalse"):
        return "int"
    return "int" if v.type == "int" and name in ("sum", "product", "min", "max", "sumsqr", "sumsquare") else "float"


def _plural(name: str):
    def g(v: Value, *axes: Value) -> Value:
        if not v.is_array:
            raise LanguageError(f"{name}s needs an array")
        if name in ("any", "all", "ntrue", "nfalse"):
            need("bool", name, v)
        fraction = None
        if name == "fractile":
            fraction, axes = float(axes[0].literal), axes[1:]
        f = reducer(name, fraction)
        ints = axes[0].col if len(axes) == 1 and axes[0].is_array else F.array(*(a.col for a in axes))
        return in_numpy(v, lambda x, m, k: _collapse(f, x, m, k), ints.cast("array<int>"), result_type(name, v))

    return g


def _transpose(v: Value) -> Value:
    if v.rank == 1:
        return v
    return in_numpy(v, lambda x, m, k: (x.T, m.T), F.array().cast("array<int>"), v.type)


def _reverse(v: Value, *axes: Value) -> Value:
    if v.rank == 1:
        return replace(v, col=F.reverse(v.col), mask=None if v.mask is None else F.reverse(v.mask))

    def f(x: np.ndarray, m: np.ndarray, k: list[int]) -> tuple[np.ndarray, np.ndarray]:
        inside = [a for a in k if a <= x.ndim]
        odd = tuple(d for d in range(x.ndim) if not inside or inside.count(d + 1) % 2)
        return np.flip(x, odd), np.flip(m, odd)

    return in_numpy(v, f, F.array(*(a.col for a in axes)).cast("array<int>"), v.type)


def _flatten(v: Value) -> Value:
    return Value(valid(v), v.type, 1)


def _ints(args: tuple[Value, ...]) -> Column:
    return (args[0].col if len(args) == 1 and args[0].is_array else F.array(*(a.col for a in args))).cast("array<int>")


def _array(v: Value, *shape: Value) -> Value:
    size = _ints(shape)
    n = F.aggregate(size, F.lit(1), lambda x, y: x * y)
    if not v.is_array:
        cell = F.array_repeat(v.col, n)
    else:
        cell = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.element_at(v.col, (i % F.size(v.col) + 1).cast("int")))
    one = len(shape) == 1 and not shape[0].is_array
    return Value(cell, v.type, 1) if one else Value(cell, v.type, 2, size)


def _resize(v: Value, shape: Value) -> Value:
    def f(x: np.ndarray, m: np.ndarray, k: list[int]) -> tuple[np.ndarray, np.ndarray]:
        out, flags = np.zeros(k), np.zeros(k, bool)
        extra = x[(slice(None),) * min(x.ndim, len(k)) + (0,) * (x.ndim - len(k))] if x.ndim > len(k) else x.reshape(x.shape + (1,) * (len(k) - x.ndim))
        marks = m[(slice(None),) * min(x.ndim, len(k)) + (0,) * (x.ndim - len(k))] if x.ndim > len(k) else m.reshape(extra.shape)
        at = tuple(slice(0, min(a, b)) for a, b in zip(extra.shape, k, strict=True))
        out[at], flags[at] = extra[at], marks[at]
        return out, flags

    return in_numpy(v, f, _ints((shape,)), v.type)


def _diagonals(v: Value, first: Value | None = None) -> Value:
    def f(x: np.ndarray, m: np.ndarray, k: list[int]) -> tuple[np.ndarray, np.ndarray]:
        if x.ndim < 2 or x.shape[0] != x.shape[1]:
            raise ValueError("diagonals needs two first axes of equal length")
        i = np.arange(x.shape[0])
        return x[i, i], m[i, i]

    return in_numpy(v, f, F.array().cast("array<int>"), v.type)


def _null_array(v: Value) -> Value:
    return replace(v, col=F.slice(v.col, 1, 0) if v.is_array else F.slice(F.array(v.col), 1, 0), rank=1, shape=None, mask=None, literal=None)


def _isdefined(v: Value) -> Value:
    return Value(F.size(v.col) > 0 if v.is_array else v.col.isNotNull(), "bool")


def _isnull(v: Value) -> Value:
    return Value(F.size(v.col) == 0 if v.is_array else v.col.isNull(), "bool")


# --- masks ----------------------------------------------------------------------------------------------------


def _marray(v: Value, m: Value) -> Value:
    need("bool", "marray", m)
    return replace(v, mask=F.when(F.size(v.col) != F.size(m.col), F.raise_error(F.lit("mask and array differ in shape"))).otherwise(m.col), literal=None)


def _mask(v: Value) -> Value:
    flags = v.mask if v.mask is not None else F.transform(v.col, lambda _: F.lit(False))
    return replace(v, col=flags, type="bool", mask=None, unit=None)


def _negate(v: Value) -> Value:
    return replace(v, mask=F.transform(_mask(v).col, lambda x: ~x))


def _replaced(masked: bool):
    def g(v: Value, by: Value) -> Value:
        flags = _mask(v).col
        if by.type != v.type:
            v, by = to_float(v), to_float(by)
        if by.is_array:
            both = F.zip_with(v.col, by.col, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
            cell = F.zip_with(both, flags, lambda s, m: F.when(m if masked else ~m, s["y"]).otherwise(s["x"]))
        else:
            cell = F.zip_with(v.col, flags, lambda x, m: F.when(m if masked else ~m, by.col).otherwise(x))
        return replace(v, col=cell)

    return g


FUNCTIONS = {
    **{n: (1, 1, REDUCE[n]) for n in ("sum", "product", "sumsqr", "sumsquare", "mean", "avg", "median", "variance", "stddev", "rms", "avdev", "any", "all", "ntrue", "nfalse")},
    "fractile": (2, 2, _fractile), "nelements": (1, 1, _nelements), "count": (1, 1, _nelements), "ndim": (1, 1, _ndim), "shape": (1, 1, _shape),
    **{f"{n}s": (2, 8, _plural(n)) for n in ("sum", "product", "mean", "avg", "min", "max", "median", "stddev", "samplestddev", "avdev", "sumsqr", "sumsquare", "any", "all", "ntrue", "nfalse", "variance", "samplevariance")},
    "rmss": (2, 8, _plural("rms")), "fractiles": (3, 9, _plural("fractile")), "variances": (2, 8, _plural("variance")), "samplevariances": (2, 8, _plural("samplevariance")),
    "transpose": (1, 1, _transpose), "reversearray": (1, 8, _reverse), "flatten": (1, 1, _flatten), "arrayflatten": (1, 1, _flatten), "array": (2, 9, _array), "resize": (2, 2, _resize),
    "diagonals": (1, 2, _diagonals), "diagonal": (1, 2, _diagonals), "nullarray": (1, 1, _null_array), "isdefined": (1, 1, _isdefined), "isnull": (1, 1, _isnull),
    "marray": (2, 2, _marray), "arraydata": (1, 1, lambda v: replace(v, mask=None)), "arraymask": (1, 1, _mask), "mask": (1, 1, _mask), "negatemask": (1, 1, _negate),
    "replacemasked": (2, 2, _replaced(True)), "replaceunmasked": (2, 2, _replaced(False)),
}
