"""Lowering: expression trees to typed Spark columns, one function per node."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parser import UNITS, LanguageError, parse
from .values import inf, nan, NUMBERS, Value, complex_of, from_column, lift, literal, need, to_complex, to_float

#: The hidden row number of tables.
ROW = "__rowid"


@dataclass
class Context:
    """Names that an expression may use, and whether it stands in a grouped select."""

    columns: dict[str, Value]
    keywords: dict = field(default_factory=dict)
    keys: dict[str, Value] | None = None  # grouped: the keys; other columns give the group's last row
    row: Column | None = None
    grouping: Callable[[str], Column] | None = None
    resolve: Callable[[str, list, Context], Value | None] | None = None  # for functions of other namespaces
    hide: Callable[[Column], str] | None = None  # grouped: puts a column below the aggregation, gives its name
    per_element: Callable[[Value, Column], tuple[Column, Column | None]] | None = None  # grouped: cells (and shapes) of an aggregate of each position, whose elements are __e.x and __e.m

    @classmethod
    def of(cls, df: DataFrame, keywords: dict | None = None, alias: str | None = None) -> Context:
        columns = {}
        for f in df.schema.fields:
            if f.name == ROW:
                continue
            try:
                columns[f.name] = from_column(F.col(f"`{f.name}`"), f.dataType, f.nullable, f.metadata)
            except LanguageError:
                continue
        return cls(columns, keywords or {}, row=F.col(ROW) if ROW in df.columns else None)

    def column(self, name: str) -> Value:
        if name in self.columns:
            return self.columns[name]
        short = name.rpartition(".")[2]
        if short in self.columns:
            return self.columns[short]
        raise LanguageError(f"no column {name!r}")


def lower(tree, ctx: Context) -> Value:
    """The value of a tree."""
    if isinstance(tree, str):
        tree = parse(tree)
    return _NODES[tree[0]](ctx, *tree[1:])


def condition(tree, ctx: Context) -> Column:
    """A predicate; anything but a scalar boolean is an error."""
    v = lower(tree, ctx)
    if v.type not in ("bool", "null") or v.is_array:
        raise LanguageError("a condition must be a boolean scalar")
    return v.col.cast("boolean")


def _lit(ctx: Context, x) -> Value:
    return literal(x)


def _date(ctx: Context, x: float) -> Value:
    return replace(literal(x), unit="d")


def _quantity(ctx: Context, x: float, unit: str) -> Value:
    return replace(literal(x), unit=unit)


def _col(ctx: Context, name: str) -> Value:
    if ctx.keys is not None:
        if name in ctx.keys:
            return ctx.keys[name]
        v = ctx.column(name)
        if ctx.row is None:
            raise LanguageError(f"{name!r} is neither a key nor aggregated")
        # the group's last row; all parts come from that row
        parts = F.max_by(F.struct(v.col.alias("c"), *([v.shape.alias("s")] if v.shape is not None else []), *([v.mask.alias("m")] if v.mask is not None else [])), ctx.row)
        return replace(v, col=parts["c"], shape=parts["s"] if v.shape is not None else None, mask=parts["m"] if v.mask is not None else None, literal=None)
    return ctx.column(name)


def _kw(ctx: Context, column: str | None, name: str) -> Value:
    at = ctx.keywords if column is None else ctx.keywords.get("columns", {}).get(column, {})
    for part in name.split("."):
        if not isinstance(at, dict) or part not in at:
            raise LanguageError(f"no keyword {name!r}")
        at = at[part]
    return array_of([literal(x) for x in at]) if isinstance(at, list) else literal(at)


def array_of(items: list[Value]) -> Value:
    if not items:
        return Value(F.array().cast("array<bigint>"), "int", 1)
    kinds = {v.type for v in items if v.type != "null"}
    if kinds <= set(NUMBERS) and len(kinds) > 1:
        items = [to_float(v) for v in items]
    elif "complex" in kinds and kinds <= {"complex", *NUMBERS}:
        items = [to_complex(v) for v in items]
    elif len(kinds) > 1:
        raise LanguageError("array items of different types")
    kind = next((v.type for v in items if v.type != "null"), "int")
    if any(v.is_array for v in items):
        if not all(v.rank == 1 for v in items):
            raise LanguageError("an array literal needs items of one rank")
        shape = F.array(F.size(items[0].col), F.lit(len(items)))
        return Value(F.flatten(F.array(*(v.col for v in items))), kind, 2, shape)
    return Value(F.array(*(v.col for v in items)), kind, 1)


# --- comparison -----------------------------------------------------------------------------------------------


def _ordered(v: Value) -> Value:
    """Complex numbers compare by magnitude."""
    return lift(lambda x: F.sqrt(x["re"] * x["re"] + x["im"] * x["im"]), "float", v) if v.type == "complex" else v


def scaled_to(v: Value, unit: str | None) -> Value:
    """v in another unit of the same kind; a value without unit stays as it is."""
    if not unit or not v.unit or v.unit == unit:
        return v
    a, b = UNITS.get(v.unit), UNITS.get(unit)
    if a is None or b is None:
        return v
    if a[0] != b[0]:
        if {a[0], b[0]} == {"time", "angle"}:  # 24 h are a full turn
            turn = 2 * math.pi / 86400
            factor = a[1] * (turn if a[0] == "time" else 1 / turn) / b[1]
        else:
            raise LanguageError(f"{v.unit} and {unit} don't conform")
    else:
        factor = a[1] / b[1]
    out = lift(lambda x: x * F.lit(factor), "float", to_float(v))
    return replace(out, unit=unit, literal=v.literal * factor if isinstance(v.literal, (int, float)) else None)


def _same_unit(a: Value, b: Value) -> tuple[Value, Value]:
    return (a, scaled_to(b, a.unit)) if a.unit and b.unit else (a, b)


def _guarded(compare: Callable[[Column, Column], Column], a: Value, b: Value, *, nan: bool) -> Value:
    """compare, with the result nan wherever an operand is NaN, as IEEE has it."""

    def f(x: Column, y: Column) -> Column:
        out = compare(x, y)
        for v, c in ((a, x), (b, y)):
            if v.type == "float" and v.literal is None:
                out = out | F.isnan(c) if nan else out & ~F.isnan(c)
        return out

    return lift(f, "bool", a, b)


def compare(op: str, a: Value, b: Value) -> Value:
    if a.pattern or b.pattern:
        subject, pattern = (b, a) if a.pattern else (a, b)
        need("string", op, subject)
        out = lift(lambda x: F.rlike(x, pattern.col), "bool", subject)
        return out if op == "==" else lift(lambda x: ~x, "bool", out)
    kinds = {a.type, b.type} - {"null"}
    if len(kinds) > 1 and not kinds <= {"int", "float", "complex", "bool"}:
        raise LanguageError(f"{op} can't compare {a.type} with {b.type}")
    if "bool" in kinds and len(kinds) > 1:
        a, b = (v.of(v.col.cast("array<bigint>" if v.is_array else "bigint"), "int") if v.type == "bool" else v for v in (a, b))
    a, b = _same_unit(a, b)
    if "complex" in kinds:
        if op in ("==", "!="):
            a, b = to_complex(a), to_complex(b)
            same = lift(lambda x, y: (x["re"] == y["re"]) & (x["im"] == y["im"]) & ~F.isnan(x["re"]) & ~F.isnan(x["im"]), "bool", a, b)
            return same if op == "==" else lift(lambda x: ~x, "bool", same)
        a, b = _ordered(a), _ordered(b)
    if {a.type, b.type} == {"int", "float"}:
        a, b = to_float(a), to_float(b)
    if op in ("~=", "!~="):
        out = near(to_float(a), to_float(b), F.lit(1e-5))
        return out if op == "~=" else lift(lambda x: ~x, "bool", out)
    f = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    return _guarded(f, a, b, nan=op == "!=")


def near(a: Value, b: Value, tolerance: Column, absolute: bool = False) -> Value:
    """Whether a and b differ by no more than tolerance, relative to the larger unless absolute."""

    def f(x: Column, y: Column) -> Column:
        d = F.abs(x - y)
        if absolute:
            return (d <= tolerance) & ~F.isnan(d)
        close = d <= tolerance * F.greatest(F.abs(x), F.abs(y))
        zero = (x == 0) | (y == 0)
        return ((x == y) | F.when(tolerance <= 0, F.lit(False)).when(zero, d <= (1 + tolerance) * F.lit(2.2250738585072014e-308)).when((x > 0) != (y > 0), F.lit(False)).otherwise(close)) & ~F.isnan(d)

    return lift(f, "bool", a, b)


def _logic(op: str, a: Value, b: Value) -> Value:
    need("bool", op, a, b)
    a, b = (v.of(v.col.cast("boolean"), "bool") if v.type == "null" else v for v in (a, b))
    return lift((lambda x, y: x & y) if op == "and" else (lambda x, y: x | y), "bool", a, b)


# --- arithmetic -----------------------------------------------------------------------------------------------


def _divide(x: Column, y: Column) -> Column:
    zero = F.when(F.isnan(x) | (x == 0), nan()).when(x > 0, inf()).otherwise(-inf())
    return F.when(y == 0, zero).otherwise(x / F.when(y != 0, y))


def _arithmetic(op: str, a: Value, b: Value) -> Value:
    if op == "+" and a.type == b.type == "string":
        return lift(lambda x, y: F.concat(x, y), "string", a, b)
    need(("int", "float", "complex", "bool"), op, a, b)
    units = (a.unit, b.unit)
    if op in ("+", "-"):
        a, b = _same_unit(a, b)
    if "complex" in (a.type, b.type):
        return _complex_arithmetic(op, to_complex(a), to_complex(b))
    a, b = (v.of(v.col.cast("array<bigint>" if v.is_array else "bigint"), "int") if v.type in ("bool", "null") and (a.type, b.type) != ("float", "float") else v for v in (a, b))
    whole = a.type == b.type == "int"
    nonzero = isinstance(b.literal, (int, float)) and b.literal != 0
    if op == "/":
        a, b = to_float(a), to_float(b)
        out = lift((lambda x, y: x / y) if nonzero else _divide, "float", a, b)
    elif op == "//":
        a, b = to_float(a), to_float(b)
        out = lift(lambda x, y: _floor(x / y if nonzero else _divide(x, y)), "float", a, b)
    elif op == "%":
        if whole:
            f = (lambda x, y: ((x % y) + y) % y) if nonzero else (lambda x, y: F.when(y == 0, x).otherwise(((x % F.when(y != 0, y)) + y) % F.when(y != 0, y)))
            out = lift(f, "int", a, b)
        else:
            a, b = to_float(a), to_float(b)
            f = lambda x, y: x - y * _floor(x / y)
            out = lift(f if nonzero else lambda x, y: F.when(y == 0, x).otherwise(f(x, F.when(y != 0, y))), "float", a, b)
    elif op == "**":
        out = lift(lambda x, y: F.pow(x, y), "float", to_float(a), to_float(b))
        if whole and isinstance(b.literal, int) and 0 <= b.literal <= 62:
            out = lift(lambda x: F.pow(x.cast("double"), F.lit(float(b.literal))).cast("bigint"), "int", a) if b.literal > 3 else lift(lambda x: _product([x] * b.literal), "int", a)
    else:
        if not whole:
            a, b = to_float(a), to_float(b)
        f = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y}[op]
        out = lift(f, "int" if whole else "float", a, b)
    return replace(out, unit=_unit_of(op, *units))


def _product(xs: list[Column]) -> Column:
    out = F.lit(1).cast("bigint")
    for x in xs:
        out = out * x
    return out


def _unit_of(op: str, a: str | None, b: str | None) -> str | None:
    if op in ("+", "-", "%"):
        return a or b
    if op == "*":
        return f"{a}.{b}" if a and b else a or b
    if op == "/":
        return None if a == b else f"{a or ''}/{b}" if b else a
    return None


def _floor(x: Column) -> Column:
    """floor as a double, also of what is no bigint."""
    return F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x)


def _complex_arithmetic(op: str, a: Value, b: Value) -> Value:
    def times(x: Column, y: Column) -> Column:
        return complex_of(x["re"] * y["re"] - x["im"] * y["im"], x["re"] * y["im"] + x["im"] * y["re"])

    def over(x: Column, y: Column) -> Column:
        d = y["re"] * y["re"] + y["im"] * y["im"]
        return complex_of(_divide(x["re"] * y["re"] + x["im"] * y["im"], d), _divide(x["im"] * y["re"] - x["re"] * y["im"], d))

    def power(x: Column, y: Column) -> Column:
        r, t = F.sqrt(x["re"] * x["re"] + x["im"] * x["im"]), F.atan2(x["im"], x["re"])
        scale = F.pow(r, y["re"]) * F.exp(-y["im"] * t)
        angle = y["re"] * t + y["im"] * F.when(r > 0, F.ln(r)).otherwise(0.0)
        return complex_of(scale * F.cos(angle), scale * F.sin(angle))

    table = {
        "+": lambda x, y: complex_of(x["re"] + y["re"], x["im"] + y["im"]),
        "-": lambda x, y: complex_of(x["re"] - y["re"], x["im"] - y["im"]),
        "*": times, "/": over, "**": power,
    }
    if op not in table:
        raise LanguageError(f"{op} isn't defined for complex numbers")
    return lift(table[op], "complex", a, b)


def _bits(op: str, a: Value, b: Value) -> Value:
    need("int", op, a, b)
    f = {"&": lambda x, y: x.bitwiseAND(y), "|": lambda x, y: x.bitwiseOR(y), "^": lambda x, y: x.bitwiseXOR(y)}[op]
    return lift(f, "int", a, b)


def _bin(ctx: Context, op: str, left, right) -> Value:
    a, b = lower(left, ctx), lower(right, ctx)
    if op in ("and", "or"):
        return _logic(op, a, b)
    if op in ("==", "!=", "<", "<=", ">", ">=", "~=", "!~="):
        return compare(op, a, b)
    if op in ("&", "|", "^"):
        return _bits(op, a, b)
    return _arithmetic(op, a, b)


def _un(ctx: Context, op: str, inner) -> Value:
    v = lower(inner, ctx)
    if op == "not":
        need("bool", "NOT", v)
        return lift(lambda x: ~x, "bool", v.of(v.col.cast("boolean"), "bool") if v.type == "null" else v)
    if op == "~":
        need("int", "~", v)
        return lift(lambda x: F.bitwise_not(x), "int", v)
    if v.type == "complex":
        return lift(lambda x: complex_of(-x["re"], -x["im"]), "complex", v)
    need(NUMBERS, "-", v)
    if isinstance(v.literal, (int, float)):
        return replace(literal(-v.literal), unit=v.unit)
    return replace(lift(lambda x: -x, v.type, v), unit=v.unit)


# --- membership -----------------------------------------------------------------------------------------------


def _in(ctx: Context, tree, items, negated: bool) -> Value:
    v = lower(tree, ctx)
    if items[0] == "query":
        raise LanguageError("a sub-query must be resolved before lowering")
    plain: list[Value] = []
    tests: list[Value] = []
    for item in items[1]:
        if item[0] == "range":
            tests.append(_lattice(ctx, v, item))
            continue
        x = lower(item, ctx)
        if x.is_array:
            need((v.type,) if v.type not in NUMBERS else NUMBERS, "IN", x)
            a, c = (to_float(v), to_float(x)) if {v.type, x.type} == {"int", "float"} else (v, x)
            tests.append(lift(lambda s, c=c: F.array_contains(c.col, s), "bool", a))
        else:
            plain.append(x)
    if plain:
        if v.type not in NUMBERS and any(x.type not in (v.type, "null") for x in plain):
            raise LanguageError(f"IN can't compare {v.type} with other types")
        if v.type in NUMBERS and any(x.type not in (*NUMBERS, "null") for x in plain):
            raise LanguageError("IN can't compare numbers with other types")
        subject = to_float(v) if v.type == "int" and any(x.type == "float" for x in plain) else v
        values = [to_float(x) if subject.type == "float" else x for x in plain]
        tests.append(lift(lambda s: s.isin(*(x.col for x in values)), "bool", subject))
    if not tests:
        tests = [lift(lambda s: F.lit(False), "bool", v)]
    out = tests[0]
    for t in tests[1:]:
        out = lift(lambda x, y: x | y, "bool", out, t)
    return lift(lambda x: ~x, "bool", out) if negated else out


def _lattice(ctx: Context, v: Value, item) -> Value:
    """lo:hi:step holds lo, lo + step, ... and not what lies between."""
    low, high, step = (lower(x, ctx) if x is not None else None for x in item[1:])
    need(NUMBERS, "IN", v, *(x for x in (low, high, step) if x is not None))
    whole = all(x is None or x.type == "int" for x in (v, low, high, step))
    grid = step if step is not None else literal(1)

    def f(x: Column) -> Column:
        out = F.lit(True)
        if low is not None:
            out = out & (x >= low.col)
        if high is not None:
            out = out & (x <= high.col)
        start = low.col if low is not None else F.lit(0)
        if whole:
            return out & ((x - start) % grid.col == 0) if step is not None else out
        k = (x - start) / grid.col
        return out & (F.abs(k - F.rint(k)) <= F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs(k)))

    return lift(f, "bool", v)


def _between(ctx: Context, tree, low, high, negated: bool) -> Value:
    v, a, b = (lower(x, ctx) for x in (tree, low, high))
    out = _logic("and", compare(">=", v, a), compare("<=", v, b))
    return lift(lambda x: ~x, "bool", out) if negated else out


def _match(ctx: Context, tree, regex: str, negated: bool) -> Value:
    v = lower(tree, ctx)
    need("string", "a pattern", v)
    out = lift(lambda x: F.rlike(x, F.lit(regex)), "bool", v)
    return lift(lambda x: ~x, "bool", out) if negated else out


# --- subscripts -----------------------------------------------------------------------------------------------


def _index(ctx: Context, tree, size: Column) -> Column:
    """A 1-based index; 0 and negative ones count from the end."""
    if tree == ("end",):
        return size.cast("int")
    has_end = _mentions_end(tree)
    v = lower(_replace_end(tree), replace_columns(ctx, {"__end": Value(size.cast("bigint"), "int")})) if has_end else lower(tree, ctx)
    if v.type != "int" or v.is_array:
        raise LanguageError("a subscript must be a whole number")
    if isinstance(v.literal, int):
        return F.lit(v.literal) if v.literal > 0 else (size + F.lit(v.literal)).cast("int")
    return F.when(v.col > 0, v.col).otherwise(size + v.col).cast("int")


def _mentions_end(tree) -> bool:
    return tree == ("end",) or isinstance(tree, (tuple, list)) and any(_mentions_end(x) for x in tree)


def _replace_end(tree):
    if tree == ("end",):
        return ("col", "__end")
    if isinstance(tree, tuple):
        return tuple(_replace_end(x) for x in tree)
    return [_replace_end(x) for x in tree] if isinstance(tree, list) else tree


def replace_columns(ctx: Context, more: dict[str, Value]) -> Context:
    return Context({**ctx.columns, **more}, ctx.keywords, None if ctx.keys is None else {**ctx.keys, **more}, ctx.row, ctx.grouping, ctx.resolve, ctx.hide, ctx.per_element)


def _sub(ctx: Context, tree, subs) -> Value:
    v = lower(tree, ctx)
    if not v.is_array:
        raise LanguageError("only arrays have subscripts")
    if len(subs) == 1 and subs[0][0] not in ("range", "end"):
        at = None if _mentions_end(subs[0]) else lower(subs[0], ctx)
        if at is not None and at.is_array and at.type == "bool":
            same = F.when(F.size(at.col) != F.size(v.col), F.raise_error(F.lit("mask and array differ in shape"))).otherwise(at.col)
            return replace(v, mask=same, literal=None)
    if v.rank == 1 and len(subs) == 1:
        size = F.size(v.col)
        if subs[0][0] != "range":
            i = _index(ctx, subs[0], size)
            return Value(F.element_at(v.col, i), v.type, unit=v.unit)
        cut, _ = _slice(ctx, subs[0], size)
        pick = lambda c: None if c is None else F.transform(cut, lambda i: F.element_at(c, i))
        return replace(v, col=pick(v.col), mask=pick(v.mask), literal=None)
    return _sub_nd(ctx, v, subs)


def _slice(ctx: Context, item, size: Column) -> tuple[Column, Column]:
    """The indices of lo:hi:step, and how many they are; out of range or reversed is an error."""
    low, high, step, bad = bounds(ctx, item, size)
    if bad is None:
        cut = F.when(size > 0, F.sequence(low, high.cast("int"), step)).otherwise(F.array().cast("array<int>"))
        return cut, F.size(cut)
    cut = F.when(bad, F.raise_error(F.lit("subscript out of range"))).otherwise(F.sequence(low.cast("int"), high.cast("int"), step))
    return cut, F.size(cut)


def bounds(ctx: Context, item, size: Column) -> tuple[Column, Column, Column, Column | None]:
    """First and last index and step of lo:hi:step, and whether they are wrong; None for a whole axis."""
    low = _index(ctx, item[1], size) if item[1] is not None else F.lit(1)
    high = _index(ctx, item[2], size) if item[2] is not None else size
    step = lower(item[3], ctx).col.cast("int") if item[3] is not None else F.lit(1)
    return low, high, step, None if item[1] is None and item[2] is None else (low < 1) | (high > size) | (low > high)


def _spread(outer: Column, inner: Column, size: Column) -> Column:
    """Flat places of one more axis of the given size, which varies faster."""
    return F.flatten(F.transform(outer, lambda o: F.transform(inner, lambda i: o * size + i - 1)))


def _sub_nd(ctx: Context, v: Value, subs) -> Value:
    shape = v.shape if v.shape is not None else F.array(F.size(v.col))
    cuts, kept = [], []
    for k, item in enumerate(subs):
        size = F.element_at(shape, k + 1)
        if item[0] == "range":
            cut, _ = _slice(ctx, item, size)
            kept.append(True)
        else:
            i = _index(ctx, item, size)
            cut = F.array(F.when((i < 1) | (i > size), F.raise_error(F.lit("subscript out of range"))).otherwise(i).cast("int"))
            kept.append(False)
        cuts.append(cut)
    # column-major: the last axis varies slowest
    flat = F.transform(cuts[-1], lambda i: i - 1)
    for k in range(len(subs) - 2, -1, -1):
        flat = _spread(flat, cuts[k], F.element_at(shape, k + 1))
    pick = lambda c: None if c is None else F.transform(flat, lambda i: F.element_at(c, (i + 1).cast("int")))
    right = F.when(F.size(shape) != len(subs), F.raise_error(F.lit("wrong number of subscripts"))).otherwise(v.col)
    if not any(kept):
        return Value(F.element_at(right, (F.element_at(flat, 1) + 1).cast("int")), v.type, unit=v.unit)
    return replace(v, col=F.transform(flat, lambda i: F.element_at(right, (i + 1).cast("int"))), mask=pick(v.mask), shape=F.array(*(F.size(c) for c in cuts)), rank=2, literal=None)


def _array(ctx: Context, items) -> Value:
    return array_of([lower(x, ctx) for x in items])


def _call(ctx: Context, name: str, args) -> Value:
    from ..functions import call

    return call(ctx, name, args)


def _end(ctx: Context) -> Value:
    raise LanguageError("'end' has a meaning in subscripts only")


def _exists(ctx: Context, select) -> Value:
    raise LanguageError("a sub-query must be resolved before lowering")


_NODES = {
    "lit": _lit, "date": _date, "quantity": _quantity, "col": _col, "kw": _kw, "bin": _bin, "un": _un, "in": _in, "between": _between,
    "match": _match, "sub": _sub, "array": _array, "call": _call, "end": _end, "exists": _exists, "value": lambda ctx, v: v,
}
