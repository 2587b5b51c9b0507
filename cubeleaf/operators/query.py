"""Selection, projection, order, limits and distinct rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lower import ROW, Context, condition, lower
from ..plans.parser import LanguageError, parse
from ..plans.values import lift, output, to_float
from ..table import Table

Order = list[tuple[object, bool]]


def order_items(text: str | Sequence | None) -> Order:
    """(tree, descending) of an ORDER BY list; a leading direction holds for all keys without one."""
    if not text:
        return []
    if not isinstance(text, str):
        return [x if isinstance(x, tuple) and len(x) == 2 and isinstance(x[1], bool) else (parse(x) if isinstance(x, str) else x, False) for x in text]
    default = False
    if m := re.match(r"\s*(ASC|DESC)\s+", text, re.I):
        default, text = m[1].upper() == "DESC", text[m.end() :]
    out = []
    for part in split_list(text):
        m = re.match(r"(.*?)(?:\s+(ASC|DESC))?\s*$", part, re.I | re.S)
        out.append((parse(m[1]), m[2].upper() == "DESC" if m[2] else default))
    return out


def split_list(text: str) -> list[str]:
    """The parts of a list at its outer commas."""
    out, depth, start, quote = [], 0, 0, ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*out, text[start:]] if p.strip()]


def sort_columns(items: Order, ctx: Context) -> list[Column]:
    """Missing values last, or first if descending; ties in the table's order, reversed if all keys descend."""
    out = []
    for tree, down in items:
        v = lower(tree, ctx)
        c = output(lift(lambda x: F.sqrt(x["re"] * x["re"] + x["im"] * x["im"]), "float", v) if v.type == "complex" else v)
        out.append(c.desc_nulls_first() if down else c.asc_nulls_last())
    if ctx.row is not None:
        out.append(ctx.row.desc() if items and all(d for _, d in items) else ctx.row.asc())
    return out


def ordered(t: Table, items: Order, ctx: Context | None = None) -> DataFrame:
    return t.df.orderBy(*sort_columns(items, ctx or Context.of(t.df, t.keywords)))


def limited(df: DataFrame, limit: tuple | None, offset: int = 0, by: list[Column] | None = None) -> DataFrame:
    """LIMIT n or a:b:s and OFFSET; 0 is no limit, negative numbers count from the end."""
    start, stop, step = limit if isinstance(limit, tuple) else (0, limit, 1)
    if isinstance(limit, tuple) and offset:
        raise LanguageError("a LIMIT range takes no OFFSET")
    if not isinstance(limit, tuple):
        n = df.count() if (limit or 0) < 0 or offset < 0 else None
        if offset < 0:
            offset = max(0, n + offset)
        if limit and limit < 0:
            limit = max(0, n - offset + limit) if n - offset + limit > 0 else None
            if limit is None:
                return df.limit(0)
        out = df.offset(offset) if offset else df
        return out.limit(limit) if limit else out
    if (start or 0) < 0 or (stop or 0) < 0:
        n = df.count()
        start = max(0, n + start) if start and start < 0 else start
        stop = n + stop if stop is not None and stop < 0 else stop
    start, step = start or 0, step or 1
    if step <= 0:
        raise LanguageError("a LIMIT step must be positive")
    if stop is not None and step == 1:
        return df.offset(start).limit(max(0, stop - start))
    rows = (df.limit(max(0, stop)) if stop is not None else df).withColumn("__i", F.row_number().over(Window.orderBy(*(by or [F.col(ROW)]))) - 1)
    return rows.where((F.col("__i") >= start) & ((F.col("__i") - start) % step == 0)).drop("__i")


def select_items(select, columns: list[str]) -> list[tuple[str | tuple[str, str], object]]:
    """(output name or pair of names, tree) of a select list: names, "OUT=expr", mappings or pairs."""
    if select is None:
        return [(c, ("col", c)) for c in columns]
    if isinstance(select, dict):
        select = list(select.items())
    out = []
    for k, item in enumerate(select):
        if isinstance(item, tuple) and len(item) == 2:
            out.append((item[0], parse(item[1]) if isinstance(item[1], str) else item[1]))
        elif isinstance(item, str):
            tree = parse(item)
            out.append((tree[1].rpartition(".")[2] if tree[0] == "col" else f"Col_{k + 1}", tree))
        else:
            out.append((f"Col_{k + 1}", item))
    names = [n for name, _ in out for n in (name if isinstance(name, tuple) else (name,))]
    if len(set(names)) < len(names):
        raise LanguageError("two results have one name")
    return out


def result_columns(items, ctx: Context, schema: T.StructType | None = None) -> list[Column]:
    """Columns of a select list; bare columns keep their type, expressions are 64 bits wide."""
    out = []
    for name, tree in items:
        if isinstance(tree, Column):
            out.append(tree.alias(name))
            continue
        if isinstance(name, tuple):
            v = lower(tree, ctx)
            flags = v.mask
            if flags is None:
                flags = lift(lambda x: F.isnan(x) | (F.abs(x) == float("inf")), "bool", to_float(v)).col
            out += [v.col.alias(name[0]), flags.alias(name[1])]
            continue
        if schema is not None and ctx.keys is None and tree[0] == "col" and tree[1] in schema.names:
            out.append(F.col(f"`{tree[1]}`").alias(name))
            continue
        v = lower(tree, ctx)
        out.append(output(v).alias(name, metadata={"unit": v.unit}) if v.unit else output(v).alias(name))
    return out


def query(
    t: Table | DataFrame, where: str | Column | Callable | None = None, *, select=None, orderby=None, limit=None, offset: int = 0, distinct: bool = False, cols: Sequence[str] | None = None, resolve=None
) -> Table:
    """Rows of t that satisfy where, in its order or that of orderby.

    where may be text ("WHERE A > 3 ORDER BY B"), a Column, or a Python function of a row (with cols: of these
    columns only); the last runs as a vectorised function and is the slow way.
    """
    t = Table.of(t)
    if isinstance(where, str):
        m = re.match(r"(?:\s*WHERE\s+)?(.*?)(?:\s*\bORDER\s+BY\s+(.*))?$", where.strip(), re.I | re.S)
        where, orderby = m[1].strip() or None, orderby or m[2]
    ctx = Context.of(t.df, t.keywords)
    ctx.resolve = resolve
    df = t.df
    if where is not None:
        df = df.where(predicate(where, ctx, t, cols))
    items = order_items(orderby)
    if select is not None:
        named = {n: tree for n, tree in select_items(select, t.columns) if isinstance(n, str)}
        items = [(named[x[1]] if isinstance(x, tuple) and x[0] == "col" and x[1] not in ctx.columns and x[1] in named else x, d) for x, d in items]
    if distinct:
        return _distinct(Table(df, t.keywords), items, select, limit, offset, ctx)
    sorting = sort_columns(items, ctx) if items else None
    if items:
        df = df.orderBy(*sorting)
    elif limit is not None or offset:
        df = df.orderBy(F.col(ROW))
    if limit is not None or offset:
        df = limited(df, limit, offset, sorting)
    if select is not None:
        df = df.select(*result_columns(select_items(select, t.columns), ctx, df.schema), ROW)
    return Table(df, t.keywords)


def predicate(where, ctx: Context, t: Table, cols: Sequence[str] | None = None) -> Column:
    if isinstance(where, Column):
        return where
    if callable(where):
        names = list(cols or t.columns)

        @F.pandas_udf(T.BooleanType())
        def keep(rows: pd.DataFrame) -> pd.Series:
            return pd.Series([bool(where(r)) for r in rows.to_dict("records")])

        return keep(F.struct(*names))
    return condition(where, ctx)


def _distinct(t: Table, items: Order, select, limit, offset: int, ctx: Context) -> Table:
    """The first row of each tuple in the order, then the limit."""
    chosen = select_items(select, t.columns)
    columns = result_columns(chosen, ctx, t.df.schema)
    names = [n for name, _ in chosen for n in (name if isinstance(name, tuple) else (name,))]
    if not items:
        rows = t.df.select(*columns, ROW).groupBy(*names).agg(F.min(ROW).alias(ROW))
    else:
        keys = [lower(tree, ctx) for tree, _ in items]
        with_keys = t.df.select(*columns, ROW, *(output(v).alias(f"__k{i}") for i, v in enumerate(keys)))
        # rank every row by the order, then keep the first of each tuple: a window over tuples, not over the table
        by = [F.col(f"__k{i}").desc_nulls_first() if d else F.col(f"__k{i}").asc_nulls_last() for i, (_, d) in enumerate(items)]
        by.append(F.col(ROW).desc() if all(d for _, d in items) else F.col(ROW).asc())
        rows = with_keys.withColumn("__first", F.row_number().over(Window.partitionBy(*names).orderBy(*by))).where("__first = 1").orderBy(*by)
    out = rows if items else rows.orderBy(ROW) if limit is not None or offset else rows
    if limit is not None or offset:
        out = limited(out, limit, offset)
    return Table(out.select(*names, ROW), t.keywords)


def concat(*tables: Table | DataFrame) -> Table:
    """The rows of all tables one after the other; row numbers go on after the largest of the part before."""
    parts = [Table.of(t) for t in tables]
    out, start = None, 0
    for k, p in enumerate(parts):
        df = p.df.withColumn(ROW, F.col(ROW) + F.lit(start))
        out = df if out is None else out.unionByName(df)
        if k < len(parts) - 1:
            start += next_row(p.df)
    return Table(out, parts[0].keywords)


def next_row(df: DataFrame) -> int:
    """The row number after the last; a scan of that column alone."""
    last = df.agg(F.max(ROW).alias("m")).first()["m"]
    return 0 if last is None else last + 1
