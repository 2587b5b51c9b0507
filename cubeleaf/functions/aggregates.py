"""Aggregates of grouped selects.

A missing value poisons an aggregate (it is not skipped), arrays pool all their elements that no mask excludes,
and the per-element aggregates (plural names) reduce each position of the cells.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.parser import LanguageError
from ..plans.values import nan, Value, complex_of, need, to_float
from . import arrays

_POOLED = {
    "gcount", "gsum", "gproduct", "gmean", "gavg", "gsumsqr", "gsumsquare", "gmin", "gmax", "gmedian", "gvariance", "gsamplevariance", "gstddev", "gsamplestddev", "grms",
    "gany", "gall", "gntrue", "gnfalse",
}
PLURAL = {f"{n}s" for n in ("gsum", "gproduct", "gsumsqr", "gsumsquare", "gmean", "gavg", "gvariance", "gsamplevariance", "gstddev", "gsamplestddev", "grms", "gmin", "gmax", "gany", "gall", "gntrue", "gnfalse")}
NAMES = _POOLED | PLURAL | {"countall", "gfractile", "gfirst", "glast", "growid", "gaggr", "gstack", "ghist", "ghistogram"}


def poisoned(v: Value, agg: Column) -> Column:
    """agg, or null if any value of the group is missing."""
    return F.when(F.count(v.col) == F.count(F.lit(1)), agg) if v.nullable and not v.is_array else agg


def _type(name: str, v: Value) -> str:
    if name in ("gany", "gall"):
        return "bool"
    if name in ("gntrue", "gnfalse", "gcount"):
        return "int"
    return "int" if v.type in ("int", "bool") and name in ("gsum", "gproduct", "gsumsqr", "gsumsquare", "gmin", "gmax") else "float"


def _extreme(c: Column, least: bool, float_: bool) -> Column:
    if not least:
        return F.max(c)  # NaN is the largest
    return F.when(F.max(F.isnan(c)), nan()).otherwise(F.min(c)) if float_ else F.min(c)


def _scalar(ctx, name: str, v: Value) -> Column:
    kind = _type(name, v)
    if name in ("gany", "gall", "gntrue", "gnfalse"):
        need("bool", name, v)
        return {"gany": F.bool_or(v.col), "gall": F.bool_and(v.col), "gntrue": F.count_if(v.col), "gnfalse": F.count_if(~v.col)}[name]
    if v.type == "complex":
        if name in ("gsum", "gmean", "gavg"):
            f = F.sum if name == "gsum" else F.avg
            return complex_of(f(v.col["re"]), f(v.col["im"]))
        raise LanguageError(f"{name} isn't defined for complex numbers")
    if v.type == "bool":
        v = v.of(v.col.cast("bigint"), "int")
    c = v.col if kind == "int" else to_float(v).col
    if name == "gproduct":
        return F.product(c).cast("bigint") if kind == "int" else F.product(c)
    table = {
        "gsum": lambda: F.sum(c), "gmean": lambda: F.avg(c), "gavg": lambda: F.avg(c), "gsumsqr": lambda: F.sum(c * c), "gsumsquare": lambda: F.sum(c * c),
        "gmin": lambda: _extreme(c, True, kind == "float"), "gmax": lambda: _extreme(c, False, kind == "float"), "gvariance": lambda: F.var_pop(c), "gstddev": lambda: F.stddev_pop(c),
        "gsamplevariance": lambda: F.coalesce(F.var_samp(c), F.lit(0.0)), "gsamplestddev": lambda: F.coalesce(F.stddev_samp(c), F.lit(0.0)), "grms": lambda: F.sqrt(F.avg(c * c)),
        "gmedian": lambda: _percentile(ctx, c, 0.5),
    }
    return table[name]()


#: Fractions for which the discrete percentile is the value at floor((n - 1) f + 0.01).
_DISCRETE = (0.0, 0.1, 0.25, 0.5, 1.0)


def _percentile(ctx, c: Column, f: float) -> Column:
    """The value at floor((n - 1) f + 0.01), as a double.

    The discrete percentile counts equal values where the rows lie; other fractions need the sorted list.
    """
    if f in _DISCRETE and ctx.hide is not None:
        return F.expr(f"percentile_disc({f}D) WITHIN GROUP (ORDER BY `{ctx.hide(c)}`)").cast("double")
    return arrays.fractile(F.collect_list(c), F.lit(f))


def _moments(v: Value) -> tuple[Column, Column, Column]:
    """Number, sum and sum of squares of the pooled elements."""
    a = arrays.valid(to_float(v))
    n = F.sum(F.size(a))
    return n, F.sum(arrays.total(a, F.lit(0.0))), F.sum(arrays.total(a, F.lit(0.0), lambda s, x: s + x * x))


def _pooled(ctx, name: str, v: Value) -> Column:
    """The aggregate of all elements of a group's cells; partial results of a cell are combined."""
    a = arrays.valid(v)
    if name in ("gany", "gall", "gntrue", "gnfalse"):
        need("bool", name, v)
        trues, falses = F.size(F.filter(a, lambda x: x)).cast("bigint"), F.size(F.filter(a, lambda x: ~x)).cast("bigint")
        return {"gany": F.max(trues) > 0, "gall": F.max(falses) == 0, "gntrue": F.sum(trues), "gnfalse": F.sum(falses)}[name]
    if name == "gsum":
        return F.sum(arrays.REDUCE["sum"](v).col) if v.type != "complex" else _scalar(ctx, "gsum", arrays.REDUCE["sum"](v))
    if name == "gproduct":
        return F.product(arrays.REDUCE["product"](v).col.cast("double")).cast("bigint" if v.type == "int" else "double")
    if name in ("gsumsqr", "gsumsquare"):
        return F.sum(arrays.REDUCE["sumsqr"](v).col)
    if name in ("gmin", "gmax"):
        return _extreme(arrays.extreme(a, name == "gmax", v.type == "float"), name == "gmin", v.type == "float")
    if name == "gmedian":
        return arrays.fractile(F.flatten(F.collect_list(arrays.valid(to_float(v)))), F.lit(0.5))
    n, s, q = _moments(v)
    if name in ("gmean", "gavg"):
        return s / n
    if name == "grms":
        return F.sqrt(q / n)
    # the parallel formula for variances: within cells and between them
    f = arrays.valid(to_float(v))
    within = F.sum(F.coalesce(F.nanvl(arrays.variance(f), F.lit(0.0)), F.lit(0.0)) * F.size(f))
    m = arrays.mean(f)
    m = F.when(F.size(f) > 0, m).otherwise(0.0)
    between = F.sum(F.size(f) * m * m) - s * s / n
    spread = F.greatest(within + between, F.lit(0.0))
    if "sample" in name:
        out = F.when(n > 1, spread / (n - 1)).otherwise(0.0)
    else:
        out = spread / n
    return F.sqrt(out) if "stddev" in name else out


def _per_element(ctx, name: str, v: Value) -> Value:
    """Each position of the group's cells reduced over its rows; masked elements are skipped.

    Positions are exploded and aggregated by keys and position, so partial results are combined where the rows lie and
    no group is listed.  Each group has the length of its own cells; cells of several lengths in one are an error.
    """
    base = name[:-1]
    if not v.is_array:
        raise LanguageError(f"{name} needs arrays")
    if ctx.per_element is None:
        raise LanguageError(f"{name} can't stand here")
    kind = _type(base, v)
    inner = v if v.type == "bool" or kind == "int" else to_float(v)
    empty = F.lit(False) if kind == "bool" else F.lit(0).cast("bigint") if kind == "int" else F.lit(0.0) if base in ("gsum", "gsumsqr", "gsumsquare") else nan()
    x = F.col("__e.x") if v.mask is None else F.when(~F.col("__e.m"), F.col("__e.x"))
    cell, shape = ctx.per_element(replace(v, col=inner.col), F.coalesce(_scalar(ctx, base, Value(x, inner.type, nullable=False)), empty))
    return Value(cell, kind, v.rank, shape)


def _histogram(v: Value, bins: Value, low: Value, high: Value) -> Value:
    n, a, b = int(bins.literal), float(low.literal), float(high.literal)
    f = to_float(v)
    width = (b - a) / n
    tests = [lambda x: x < a, *((lambda x, k=k: (x >= a + k * width) & (x < a + (k + 1) * width)) for k in range(n)), lambda x: x >= b]
    if v.is_array:
        good = arrays.valid(f)
        counts = [F.sum(F.size(F.filter(good, t)).cast("bigint")) for t in tests]
    else:
        counts = [F.count_if(t(f.col)) for t in tests]
    return Value(F.array(*counts), "int", 1)


def call(ctx, name: str, args: list) -> Value:
    from ..plans.lower import Context, lower

    if ctx.keys is None:
        raise LanguageError(f"{name} needs a grouped select")
    inner = Context(ctx.columns, ctx.keywords, None, ctx.row, None, ctx.resolve)
    if name in ("gcount", "countall"):
        return Value(F.count(F.lit(1)), "int", nullable=False)
    if name == "growid":
        return Value(F.array_sort(F.collect_list(ctx.row)), "int", 1)
    v = lower(args[0], inner)
    if name in ("gfirst", "glast"):
        f = F.min_by if name == "gfirst" else F.max_by
        parts = f(F.struct(v.col.alias("c"), *([v.shape.alias("s")] if v.shape is not None else []), *([v.mask.alias("m")] if v.mask is not None else [])), ctx.row)
        return replace(v, col=parts["c"], shape=parts["s"] if v.shape is not None else None, mask=parts["m"] if v.mask is not None else None, literal=None)
    if name in ("gaggr", "gstack"):
        order = F.array_sort(F.collect_list(F.struct(ctx.row.alias("r"), v.col.alias("x"))))
        cells = F.transform(order, lambda s: s["x"])
        if not v.is_array:
            return Value(cells, v.type, 1)
        size = F.any_value(arrays.shape_of(v))
        same = F.count_distinct(arrays.shape_of(v)) <= 1
        flat = F.when(~same, F.raise_error(F.lit("cells of different shapes"))).otherwise(F.flatten(cells))
        return Value(flat, v.type, 2, F.concat(size, F.array(F.count(F.lit(1)).cast("int"))))
    if name in ("ghist", "ghistogram"):
        return _histogram(v, *(lower(a, inner) for a in args[1:]))
    if name == "gfractile":
        f = lower(args[1], inner)
        if not isinstance(f.literal, (int, float)):
            raise LanguageError("gfractile needs a literal fraction")
        g = to_float(v)
        pooled = F.flatten(F.collect_list(arrays.valid(g))) if v.is_array else None
        return Value(poisoned(v, arrays.fractile(pooled, F.lit(float(f.literal))) if v.is_array else _percentile(ctx, g.col, float(f.literal))), "float")
    if name in PLURAL:
        return _per_element(ctx, name, v)
    kind = "complex" if v.type == "complex" else _type(name, v)
    return Value(_pooled(ctx, name, v) if v.is_array else poisoned(v, _scalar(ctx, name, v)), kind, unit=v.unit)
