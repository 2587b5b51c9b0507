"""Typed columns: what an expression stands for while it is being lowered.

A value has an element type (int, float, bool, string, complex, null) and a rank: 0 for scalars, 1 for arrays, 2
for cells of any shape, whose elements are kept flat and column-major beside their shape.  A masked value carries
flags, true where an element is excluded.  Parts stay apart until the value is output, so element-wise work is
always transform or zip_with over flat arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .parser import LanguageError

NUMBERS = ("int", "float")


def nan() -> Column:
    return F.lit(float("nan"))


def inf() -> Column:
    return F.lit(float("inf"))


@dataclass(frozen=True)
class Value:
    col: Column
    type: str
    rank: int = 0
    shape: Column | None = None
    mask: Column | None = None
    literal: object = None
    unit: str | None = None
    pattern: bool = False
    nullable: bool = True

    def of(self, col: Column, type_: str | None = None) -> Value:
        """The same cells with other elements."""
        return replace(self, col=col, type=type_ or self.type, literal=None)

    @property
    def is_array(self) -> bool:
        return self.rank > 0


COMPLEX = T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])


def element_type(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(kind, (T.StringType,)):
        return "string"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(kind, T.NullType):
        return "null"
    if isinstance(kind, T.StructType) and [f.name for f in kind.fields][:2] == ["re", "im"]:
        return "complex"
    raise LanguageError(f"columns of type {kind.simpleString()} can't be used in expressions")


def mjd_of(c: Column) -> Column:
    """A timestamp as MJD days."""
    return F.unix_micros(c.cast("timestamp")).cast("double") / F.lit(86400e6) + F.lit(40587.0)


def _wide(c: Column, type_: str) -> Column:
    if type_ == "int":
        return c.cast("bigint")
    if type_ == "float":
        return c.cast("double")
    if type_ == "time":
        return mjd_of(c)
    if type_ == "complex":
        return F.struct(c["re"].cast("double").alias("re"), c["im"].cast("double").alias("im"))
    return c


def from_column(c: Column, kind: T.DataType, nullable: bool = True, metadata: dict | None = None) -> Value:
    """A table's column, numbers widened to 64 bits and timestamps to MJD days."""
    unit = (metadata or {}).get("unit")
    names = [f.name for f in kind.fields] if isinstance(kind, T.StructType) else []
    if names == ["data", "mask"]:
        inner = from_column(c["data"], kind["data"].dataType)
        return replace(inner, mask=c["mask"], unit=unit)
    if names in (["shape", "data"], ["shape", "data", "mask"]):
        e = element_type(kind["data"].dataType.elementType)
        return Value(_array(c["data"], e, kind["data"].dataType), "float" if e == "time" else e, 2, c["shape"], c["mask"] if "mask" in names else None, unit=unit)
    if isinstance(kind, T.ArrayType):
        e = element_type(kind.elementType)
        return Value(_array(c, e, kind), "float" if e == "time" else e, 1, unit=unit)
    e = element_type(kind)
    return Value(_wide(c, e), "float" if e == "time" else e, unit=unit, nullable=nullable)


def _array(c: Column, e: str, kind: T.ArrayType) -> Column:
    if e in ("int", "float") and not isinstance(kind.elementType, T.DecimalType):
        return c.cast(f"array<{'bigint' if e == 'int' else 'double'}>")
    return F.transform(c, lambda x: _wide(x, e)) if e in ("time", "complex", "float") else c


def literal(x: object) -> Value:
    if x is None:
        return Value(F.lit(None), "null", literal=None)
    kind = "bool" if isinstance(x, bool) else "int" if isinstance(x, int) else "float" if isinstance(x, float) else "string"
    c = F.lit(x).cast("bigint") if kind == "int" else F.lit(x)
    return Value(c, kind, literal=x, nullable=False)


def output(v: Value) -> Column:
    """The column that a result holds."""
    if v.pattern:
        raise LanguageError("a pattern can't be a result")
    if v.rank == 2:
        parts = [v.shape.alias("shape"), v.col.alias("data")]
        return F.struct(*parts, v.mask.alias("mask")) if v.mask is not None else F.struct(*parts)
    return F.struct(v.col.alias("data"), v.mask.alias("mask")) if v.mask is not None else v.col


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def to_float(v: Value) -> Value:
    if v.type == "float":
        return v
    if v.type == "null":
        return v.of(v.col.cast("double"), "float")
    if v.type not in ("int", "bool"):
        raise LanguageError(f"a number is needed, not {v.type}")
    if v.literal is not None:
        return replace(literal(float(v.literal)), unit=v.unit)
    c = v.col.cast("array<double>") if v.is_array else v.col.cast("double")
    return v.of(c, "float")


def to_complex(v: Value) -> Value:
    if v.type == "complex":
        return v
    f = to_float(v)
    return lift(lambda x: complex_of(x, F.lit(0.0)), "complex", f)


def lift(f: Callable[..., Column], type_: str, *vs: Value) -> Value:
    """f over scalars, or over the elements of those that are arrays (of the same length)."""
    arrays = [v for v in vs if v.is_array]
    if not arrays:
        return Value(f(*(v.col for v in vs)), type_, nullable=any(v.nullable for v in vs))
    head = max(arrays, key=lambda v: v.rank)
    mask = None
    for v in arrays:
        if v.mask is not None:
            mask = v.mask if mask is None else F.zip_with(mask, v.mask, lambda a, b: a | b)
    if len(arrays) == 1:
        at = vs.index(head)
        c = F.transform(head.col, lambda x: f(*(x if k == at else v.col for k, v in enumerate(vs))))
    elif len(arrays) == 2:
        i, j = (k for k, v in enumerate(vs) if v.is_array)
        same = F.size(vs[i].col) == F.size(vs[j].col)
        if vs[i].shape is not None and vs[j].shape is not None:
            same = vs[i].shape == vs[j].shape
        zipped = F.zip_with(vs[i].col, vs[j].col, lambda x, y: f(*(x if k == i else y if k == j else v.col for k, v in enumerate(vs))))
        c = F.when(~same, F.raise_error(F.lit("arrays of different shapes"))).otherwise(zipped)
    else:
        names = [f"_{k}" for k in range(len(vs))]
        zipped = F.arrays_zip(*(v.col.alias(n) for v, n in zip(vs, names, strict=True) if v.is_array))
        order = [k for k, v in enumerate(vs) if v.is_array]
        c = F.transform(zipped, lambda s: f(*(s.getField(str(order.index(k))) if v.is_array else v.col for k, v in enumerate(vs))))
    return Value(c, type_, head.rank, head.shape, mask)


def need(type_: str | tuple[str, ...], what: str, *vs: Value) -> None:
    kinds = (type_,) if isinstance(type_, str) else type_
    for v in vs:
        if v.type not in kinds and v.type != "null":
            raise LanguageError(f"{what} needs {' or '.join(kinds)}, not {v.type}")
