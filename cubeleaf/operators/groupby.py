"""Grouped selects: keys, aggregates, HAVING, order, ROLLUP, CUBE and grouping sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates
from ..plans.lower import ROW, Context, condition, lower
from ..plans.parser import LanguageError, parse, walk
from ..plans.values import Value, output
from ..table import Table
from .query import limited, order_items, predicate, select_items


def is_aggregate(tree) -> bool:
    return any(n and n[0] == "call" and n[1] in aggregates.NAMES for n in walk(tree))


def groupby(
    t: Table | DataFrame, keys: Sequence | None = None, *, select=None, where=None, having=None, orderby=None, limit=None, offset: int = 0, rollup: bool = False, cube: bool = False,
    grouping_sets: Sequence[Sequence[str]] | None = None, resolve=None,
) -> Table:
    """One row for each group, in the order of first appearance unless orderby says otherwise.

    Keys are names, expressions or (name, expression) pairs.  Without keys all rows are one group, and no rows
    give no group.  Columns that are neither keys nor aggregated give the group's last row.
    """
    t = Table.of(t)
    rows = Context.of(t.df, t.keywords)
    rows.resolve = resolve
    df = t.df if where is None else t.df.where(predicate(where, rows, t))
    if rollup + cube + (grouping_sets is not None) > 1:
        raise LanguageError("only one of ROLLUP, CUBE and GROUPING SETS")
    named = []
    for k, key in enumerate(keys or []):
        name, tree = key if isinstance(key, tuple) else (None, key)
        tree = parse(tree) if isinstance(tree, str) else tree
        named.append((name or (tree[1] if tree[0] == "col" else f"__key{k}"), tree))
    values = {name: lower(tree, rows) for name, tree in named}
    hidden = {name: f"__g{k}" for k, name in enumerate(values)}
    below: dict[str, Column] = {hidden[n]: output(v) for n, v in values.items()}

    def hide(c: Column) -> str:
        name = f"__h{len(below)}"
        below[name] = c
        return name

    trees = {str(tree): name for name, tree in named}
    many = rollup or cube or grouping_sets is not None

    def grouping(name: str) -> Column:
        if name not in hidden:
            raise LanguageError(f"{name!r} is no key")
        return F.grouping(hidden[name]) == 1 if many else F.lit(False)

    keyed = {n: Value(F.col(hidden[n]), v.type, v.rank, unit=v.unit) for n, v in values.items()}

    pieces: list[Column] = []  # what a select with per-element aggregates takes from the other aggregates
    elements: list[tuple[str, str | None, Column]] = []  # hidden cells and masks, and the aggregate of a position

    def piece(c: Column | None) -> Column | None:
        if c is None:
            return None
        pieces.append(c.alias(f"__a{len(pieces)}"))
        return F.col(f"__a{len(pieces) - 1}")

    def per_element(v: Value, reduced: Column) -> tuple[Column, Column | None]:
        h, m = hide(v.col), hide(v.mask) if v.mask is not None else None
        elements.append((h, m, reduced))
        low, high = piece(F.min(F.size(h))), piece(F.max(F.size(h)))
        cell = F.coalesce(F.col(f"__p{len(elements) - 1}"), F.array())
        return F.when(low == high, cell).otherwise(F.raise_error(F.lit("cells of different shapes"))), piece(F.any_value(v.shape) if v.shape is not None else None)

    group = Context(rows.columns, rows.keywords, keyed, F.col(ROW), grouping, resolve, hide, per_element)

    def as_key(tree):
        """A select expression that equals a key expression is that key."""
        if isinstance(tree, tuple) and str(tree) in trees:
            return ("value", keyed[trees[str(tree)]])
        if isinstance(tree, tuple) and tree[:1] == ("call",) and (tree[1] in aggregates.NAMES or tree[1] == "grouping"):
            return tree
        if isinstance(tree, tuple):
            return tuple(as_key(x) for x in tree)
        return [as_key(x) for x in tree] if isinstance(tree, list) else tree

    chosen = select_items(select, []) if select is not None else [(n, ("col", n)) for n, _ in named]
    aliases = {name: tree for name, tree in chosen if isinstance(name, str)}

    def resolved(tree):
        """Aliases of the select list may stand in HAVING and ORDER BY."""
        if isinstance(tree, tuple) and tree[:1] == ("col",) and tree[1] in aliases and tree[1] not in values:
            return aliases[tree[1]]
        if isinstance(tree, tuple):
            return tuple(resolved(x) for x in tree)
        return [resolved(x) for x in tree] if isinstance(tree, list) else tree

    having = parse(having) if isinstance(having, str) else having
    items = order_items(orderby)
    split = any(n and n[0] == "call" and n[1] in aggregates.PLURAL for tree in [*(x for _, x in chosen), having, *(x for x, _ in items)] if tree is not None for n in walk(resolved(tree)))
    seen: dict[str, tuple] = {}

    def lifted(tree):
        """With aggregates and last rows as values that are there after the aggregation."""
        if isinstance(tree, tuple) and tree[:1] == ("value",):
            return tree
        if isinstance(tree, tuple) and (tree[:1] == ("col",) or (tree[:1] == ("call",) and (tree[1] in aggregates.NAMES or tree[1] == "grouping"))):
            if str(tree) not in seen:
                v = lower(tree, group)
                done = (tree[0] == "col" and tree[1] in values) or tree[1] in aggregates.PLURAL
                seen[str(tree)] = ("value", v if done else replace(v, col=piece(v.col), mask=piece(v.mask), shape=piece(v.shape)))
            return seen[str(tree)]
        if isinstance(tree, tuple):
            return tuple(lifted(x) for x in tree)
        return [lifted(x) for x in tree] if isinstance(tree, list) else tree

    def final(tree):
        return lifted(as_key(tree)) if split else as_key(tree)

    out, pairs = [], []
    for k, (name, tree) in enumerate(chosen):
        v = lower(final(tree), group)
        if isinstance(name, tuple):
            pairs.append(name)
            out += [v.col.alias(name[0]), (v.mask if v.mask is not None else F.lit(False)).alias(name[1])]
        else:
            c = output(v)
            out.append(c.alias(name, metadata={"unit": v.unit}) if v.unit else c.alias(name))
    counts = [F.min(ROW).alias("__first"), F.count(F.lit(1)).alias("__n")]
    extra: list[Column] = []
    if having is not None:
        extra.append(condition(final(resolved(having)), group).alias("__having"))
    for k, (tree, _) in enumerate(items):
        extra.append(output(lower(final(resolved(tree)), group)).alias(f"__o{k}"))
    names = [n for name, _ in chosen for n in (name if isinstance(name, tuple) else (name,))]
    source = df.withColumns(below) if below else df
    ids = [F.col(h) for h in hidden.values()]
    if grouping_sets is not None:
        index = {n: F.col(hidden[n]) for n in values}
        grouped = source.groupingSets([[index[k] for k in s] for s in grouping_sets], *ids)
    elif rollup or cube:
        grouped = source.rollup(*ids) if rollup else source.cube(*ids)
    else:
        grouped = source.groupBy(*ids)
    if split:
        done = grouped.agg(*pieces, *counts, (F.grouping_id() if many else F.lit(0)).cast("bigint").alias("__gid"))
        sets = [list(s) for s in grouping_sets] if grouping_sets is not None else [list(values)[:k] for k in range(len(values) + 1)] if rollup else [list(s) for k in range(len(values) + 1) for s in combinations(values, k)]
        for k, (h, m, reduced) in enumerate(elements):
            masked = lambda x, i: F.struct(x.alias("x"), (F.lit(False) if m is None else F.get(F.col(m), i)).alias("m"))  # noqa: B023, E731
            cells = F.transform(h, masked)
            apart = source.select(*ids, F.posexplode(cells).alias("__pos", "__e"))
            if many:
                distinct = {tuple(sorted(s)): s for s in sets}.values()
                apart = apart.groupingSets([[*(F.col(hidden[n]) for n in s), F.col("__pos")] for s in distinct], *ids, F.col("__pos"))
            else:
                apart = apart.groupBy(*ids, "__pos")
            # the position is the last bit of the id
            apart = apart.agg(reduced.alias("__v"), (F.shiftright(F.grouping_id(), 1) if many else F.lit(0)).cast("bigint").alias("__gid"))
            apart = apart.groupBy(*ids, "__gid").agg(F.array_sort(F.collect_list(F.struct("__pos", "__v"))).alias("__all"))
            apart = apart.select(*(F.col(i).alias(f"__k{k}_{i}") for i in hidden.values()), F.col("__gid").alias(f"__k{k}"), F.col("__all.__v").alias(f"__p{k}"))
            on = F.col("__gid") == F.col(f"__k{k}")
            for i in hidden.values():
                on = on & F.col(i).eqNullSafe(F.col(f"__k{k}_{i}"))
            done = done.join(apart, on, "left")
        done = done.where(F.col("__n") > 0).select(*out, *extra, "__first", "__n")
    else:
        done = grouped.agg(*out, *extra, *counts)
    done = done.where(F.col("__n") > 0) if not ids or many else done  # no rows, no group
    if having is not None:
        done = done.where("__having")
    if items:
        by = [F.col(f"__o{k}").desc_nulls_first() if d else F.col(f"__o{k}").asc_nulls_last() for k, (_, d) in enumerate(items)]
        done = done.orderBy(*by, F.col("__first").desc() if all(d for _, d in items) else F.col("__first"))
    elif limit is not None or offset:
        done = done.orderBy("__first")
    if limit is not None or offset:
        done = limited(done, limit, offset, [F.col("__first")])
    return Table(done.select(*names, F.col("__first").alias(ROW)), t.keywords)


def groups_apply(t: Table | DataFrame, keys: Sequence[str], f: Callable, schema: str) -> DataFrame:
    """A Python function of each group's rows (a pandas DataFrame), for what no aggregate expresses."""
    return Table.of(t).df.groupBy(*keys).applyInPandas(f, schema)
