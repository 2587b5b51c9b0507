"""Changes of tables.  Tables are immutable: each operator gives a new one and the number of rows it concerns."""

from __future__ import annotations


from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import truncated
from ..plans.lower import ROW, Context, lower, scaled_to
from ..plans.parser import LanguageError, parse
from ..plans.values import Value, from_column, output, to_complex
from ..table import Table
from .query import limited, next_row, order_items, predicate, sort_columns


def _target(t: Table, where, orderby, limit, resolve=None) -> Column | None:
    """Which rows a change concerns; None for all."""
    ctx = Context.of(t.df, t.keywords)
    ctx.resolve = resolve
    test = None if where is None else predicate(where, ctx, t)
    if limit is None:
        return test
    rows = t.df if test is None else t.df.where(test)
    items = order_items(orderby)
    chosen = limited(rows.orderBy(*sort_columns(items, ctx)), limit, 0, sort_columns(items, ctx)).select(F.col(ROW).alias("__r"))
    marked = t.df.join(chosen, t.df[ROW] == chosen["__r"], "left")
    t.df = marked.withColumn("__hit", F.col("__r").isNotNull()).drop("__r")
    return F.col("__hit")


def assigned(v: Value, kind: T.DataType, old: Column) -> Column:
    """A value as a column's type: cut and saturated from float to int, wrapped among ints, spread over a cell."""
    if isinstance(kind, T.ArrayType):
        if not v.is_array:
            return F.transform(old, lambda _: assigned(v, kind.elementType, old))
        return F.transform(output(replace(v, mask=None)), lambda x: assigned(Value(x, v.type), kind.elementType, old))
    if v.is_array:
        raise LanguageError("an array can't go into a scalar column")
    whole = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
    if type(kind) in whole:
        if v.type == "float":
            bits = whole[type(kind)]
            c = truncated(v.col)
            low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
            return c if bits == 64 else F.greatest(F.least(c, F.lit(high).cast("bigint")), F.lit(low).cast("bigint")).cast(kind)
        if v.type == "int":
            bits = whole[type(kind)]
            return v.col if bits == 64 else F.shiftright(F.shiftleft(v.col, 64 - bits), 64 - bits).cast(kind)
        if v.type == "bool":
            return v.col.cast(kind)
    elif isinstance(kind, (T.FloatType, T.DoubleType)) and v.type in ("int", "float", "bool"):
        return v.col.cast(kind)
    elif isinstance(kind, T.BooleanType) and v.type == "bool" or isinstance(kind, T.StringType) and v.type == "string":
        return v.col
    elif isinstance(kind, T.StructType) and v.type in ("int", "float", "complex"):
        return to_complex(v).col.cast(kind)
    elif v.type == "null":
        return v.col.cast(kind)
    raise LanguageError(f"a {v.type} can't go into a column of type {kind.simpleString()}")


def _set_items(set_) -> list[tuple[object, object]]:
    items = list(set_.items()) if isinstance(set_, dict) else list(set_)
    out = []
    for target, value in items:
        t = parse(target) if isinstance(target, str) else target
        out.append((t, parse(value) if isinstance(value, str) else value))
    return out


def update(t: Table | DataFrame, set_, where=None, *, orderby=None, limit=None, resolve=None) -> tuple[Table, DataFrame]:
    """The table with changed cells, and a DataFrame with the number of rows that where selects.

    Items of the list are carried out one after the other: later ones see what earlier ones have written, while
    the rows are those that where selects before.  Targets are columns, slices ``V[1:3]``, masks ``V[flags]`` or
    pairs (data column, mask column).
    """
    t = Table.of(t)
    t = Table(t.df, t.keywords, t.name)
    hit = _target(t, where, orderby, limit, resolve)
    names = t.df.columns
    df = t.df.withColumn("__hit", F.coalesce(hit, F.lit(False)) if hit is not None else F.lit(True))
    for target, tree in _set_items(set_):
        pair = target if isinstance(target, tuple) and target and target[0] == "pair" else None
        ctx = Context.of(df.drop("__hit"), t.keywords)
        ctx.resolve = resolve
        v = lower(tree, ctx) if not isinstance(tree, Column) else Value(tree, "null")
        if pair:
            flags = v.mask if v.mask is not None else F.transform(v.col, lambda _: F.lit(False))
            df = _write(df, pair[2], Value(flags, "bool", v.rank), ctx)
            df = _write(df, pair[1], replace(v, mask=None), ctx)
        elif target[0] == "sub":
            df = _write_part(df, target, v, ctx)
        else:
            df = _write(df, target[1], v, ctx)
    count = t.df.where(hit).agg(F.count(F.lit(1)).alias("rows")) if hit is not None else t.df.agg(F.count(F.lit(1)).alias("rows"))
    return Table(df.select(*(n for n in names if n != "__hit")), t.keywords, t.name), count


def _write(df: DataFrame, name: str, v: Value, ctx: Context) -> DataFrame:
    if name not in df.columns:
        raise LanguageError(f"no column {name!r}")
    kind, unit = df.schema[name].dataType, df.schema[name].metadata.get("unit")
    v = scaled_to(v, unit)
    old = F.col(f"`{name}`")
    new = assigned(v, kind, old)
    return df.withColumn(name, F.when(F.col("__hit"), new).otherwise(old)).withMetadata(name, df.schema[name].metadata)


def _bound(values: list[Column], f: Callable[[list[Column]], Column]) -> Column:
    """f of values that are computed once for a row: within a lambda an expression is computed for each element."""
    names = [f"v{i}" for i in range(len(values))]
    return F.element_at(F.transform(F.array(F.struct(*(v.alias(n) for v, n in zip(values, names, strict=True)))), lambda s: f([s[n] for n in names])), 1)


def _write_part(df: DataFrame, target, v: Value, ctx: Context) -> DataFrame:
    """A slice or the elements of a mask: each element of the cell is replaced where the subscript selects it.

    Slices of slices are a first place, a step and a number of places, so an element is tested by arithmetic.
    """
    chain = []
    while target[0] == "sub":
        chain.append(target[2])
        target = target[1]
    name = target[1]
    kind = df.schema[name].dataType
    if not isinstance(kind, T.ArrayType):
        raise LanguageError("only one-dimensional cells can be set in part")
    old = F.col(f"`{name}`")
    cell = from_column(old, kind)
    cuts, mask = [], None
    from ..plans.lower import _index, bounds

    for subs in reversed(chain):
        if len(subs) != 1:
            raise LanguageError("one subscript is needed")
        if subs[0][0] != "range" and subs[0] != ("end",):
            flags = lower(subs[0], ctx)
            if flags.is_array and flags.type == "bool":
                mask = flags.col
                continue
        cuts.append(subs[0])

    def cut_to(k: int, first: Column, step: Column, n: Column, last: Callable[[Column, Column, Column], Column]) -> Column:
        """last of the places that are left after the cuts from the k-th on."""
        if k == len(cuts):
            return last(first, step, n)
        if cuts[k][0] == "range":
            low, high, by, bad = bounds(ctx, cuts[k], n)
        else:
            low = high = _index(ctx, cuts[k], n)
            by, bad = F.lit(1), (low < 1) | (low > n)
        by = F.when(high == low, 1).when(by > 0, by).otherwise(F.raise_error(F.lit("a step must be positive")))
        size = F.floor((high - low) / by).cast("int") + 1
        size = F.when(n == 0, 0).otherwise(size) if bad is None else F.when(bad, F.raise_error(F.lit("subscript out of range"))).otherwise(size)
        return _bound([first + (low - 1) * step, step * by, size], lambda s: cut_to(k + 1, *s, last))

    def written(first: Column, step: Column, n: Column) -> Column:
        once = [c for c in (mask, None if v.literal is not None and not v.is_array else v.col) if c is not None]

        def cells(s: list[Column]) -> Column:
            flags = s[0] if mask is not None else None
            value = s[-1] if v.is_array or v.literal is None else v.col

            def element(x: Column, i: Column) -> Column:
                at = i + 1 - first
                chosen = (at >= 0) & (at <= (n - 1) * step) & (at % step == 0) if cuts else F.lit(True)
                if mask is not None:
                    chosen = chosen & F.element_at(flags, i + 1)
                one = value if not v.is_array else F.element_at(value, i + 1) if mask is not None else F.get(value, F.floor(at / step).cast("int"))
                return F.when(chosen, assigned(replace(v, col=one, rank=0, mask=None), kind.elementType, x)).otherwise(x)

            return F.transform(old, element)

        return _bound(once, cells) if once else cells([])

    assert cell.rank == 1
    n = F.size(old)
    new = F.when(n > 0, cut_to(0, F.lit(1), F.lit(1), n, written)).otherwise(old)
    return df.withColumn(name, F.when(F.col("__hit"), new.cast(kind)).otherwise(old))


def delete(t: Table | DataFrame, where=None, *, orderby=None, limit=None, resolve=None) -> tuple[Table, DataFrame]:
    """The table without the rows that where (and limit in an order) selects, and their number."""
    t = Table.of(t)
    t = Table(t.df, t.keywords, t.name)
    names = t.df.columns
    hit = _target(t, where, orderby, limit, resolve)
    gone = t.df.where(hit) if hit is not None else t.df
    left = t.df.where(~F.coalesce(hit, F.lit(False))) if hit is not None else t.df.limit(0)
    return Table(left.select(*names), t.keywords, t.name), gone.agg(F.count(F.lit(1)).alias("rows"))


def _default(kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.StructType):
        return F.struct(*(_default(f.dataType).alias(f.name) for f in kind.fields))
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return F.lit("1858-11-17").cast(kind)
    return F.lit(0).cast(kind)


def insert(t: Table | DataFrame, rows, *, columns: Sequence[str] | None = None, limit: int | None = None, resolve=None) -> Table:
    """The table with more rows at its end.

    rows: lists of expressions, dicts, or another table or DataFrame (matched by position with columns, else by
    name).  Columns without a value get their type's default.  limit takes the given rows in turn, so many times.
    """
    t = Table.of(t)
    schema = t.data().schema
    spark = t.df.sparkSession
    if isinstance(rows, (Table, DataFrame)):
        src = Table.of(rows)
        given = dict(zip(columns, src.columns, strict=False)) if columns else {c: c for c in src.columns if c in schema.names}
        new = src.df.select(*((assigned(from_column(F.col(f"`{given[f.name]}`"), src.df.schema[given[f.name]].dataType), f.dataType, _default(f.dataType)) if f.name in given and not isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType, T.DateType)) else F.col(f"`{given[f.name]}`") if f.name in given else _default(f.dataType)).alias(f.name) for f in schema.fields), F.col(ROW))
    else:
        rows = [rows] if isinstance(rows, dict) else list(rows)
        count = len(rows) if limit is None else limit if limit >= 0 else max(0, t.nrow() + limit)
        if not rows or not count:
            return t
        ctx = Context({}, t.keywords)
        ctx.resolve = resolve
        given = []
        for r in rows[:count]:
            values = r if isinstance(r, dict) else dict(zip(columns or schema.names, r, strict=True))
            if unknown := set(values) - set(schema.names):
                raise LanguageError(f"no column {sorted(unknown)[0]!r}")
            cells = []
            for f in schema.fields:
                if f.name in values:
                    x = values[f.name]
                    v = lower(parse(x) if isinstance(x, str) else x, ctx)
                    v = scaled_to(v, f.metadata.get("unit"))
                    cells.append(assigned(v, f.dataType, _default(f.dataType)).alias(f.name))
                else:
                    cells.append(_default(f.dataType).alias(f.name))
            given.append(F.struct(*(c.cast(f.dataType).alias(f.name) for c, f in zip(cells, schema.fields, strict=True))))
        # one relation, whose rows take the given ones in turn
        row = F.element_at(F.array(*given), (F.col("id") % len(given) + 1).cast("int"))
        new = spark.range(count).select(row.alias("__row"), F.col("id").alias(ROW)).select("__row.*", ROW)
    new = new.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields), F.col(ROW))
    # rows of the table keep their numbers; the new ones follow
    return Table(t.df.unionByName(new.withColumn(ROW, F.col(ROW) + F.lit(next_row(t.df)))), t.keywords, t.name)
