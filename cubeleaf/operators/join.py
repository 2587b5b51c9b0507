"""Joins: by row index, by equal keys, by any predicate, and as-of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lower import ROW, Context, condition
from ..plans.parser import LanguageError, parse
from ..plans.values import Value
from ..table import Table
from .query import order_items, predicate, sort_columns

#: Right tables of at most so many bytes, by the optimiser's estimate, are sent to every executor.
BROADCAST_BYTES = 64 << 20


def _small(df: DataFrame) -> DataFrame:
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= BROADCAST_BYTES else df


def _pairs(on) -> list[tuple[str, str]]:
    if isinstance(on, str):
        return [(on, "")]
    if isinstance(on, tuple):
        return [on]
    return [x if isinstance(x, tuple) else (x, x) for x in on]


def join(
    left: Table | DataFrame, right: Table | DataFrame, on, *, leftcols=None, rightcols=None, multi: bool = False, unmatched: str = "error", where=None, orderby=None, oncols: Sequence[str] | None = None
) -> Table:
    """Rows of left with what belongs to them in right.

    on: "FK" (its value is the row number in right), ("L", "R") or a list of such pairs (equal keys, missing equal
    to missing), a text with L. and R. names, a function of two dicts of Columns, or a Column.
    Without multi each left row has one partner at most, and a key that right has twice is an error.
    unmatched: "error", "drop", "missing" or "left" (keep left rows), "right", "full".
    """
    left, right = Table.of(left), Table.of(right)
    if unmatched not in ("error", "drop", "missing", "left", "right", "full"):
        raise LanguageError(f"unknown unmatched={unmatched!r}")
    lnames, rnames = _names(leftcols, left.columns), _names(rightcols, right.columns)
    twice = set(lnames.values()) & set(rnames.values())
    if rightcols is None:
        rnames = {c: o for c, o in rnames.items() if o not in twice}
    elif twice:
        raise LanguageError(f"both sides give {sorted(twice)}")
    l = left.df.select(*(F.col(f"`{c}`").alias(f"l.{c}") for c in left.columns), F.col(ROW).alias("l.#"))
    r = right.df.select(*(F.col(f"`{c}`").alias(f"r.{c}") for c in right.columns), F.col(ROW).alias("r.#"))
    how = {"drop": "inner", "error": "left", "missing": "left", "left": "left", "right": "right", "full": "full"}[unmatched]
    if isinstance(on, str) and "." not in on and on in left.columns:
        test = F.col(f"`l.{on}`").cast("bigint") == F.col("`r.#`")
        r = _small(r)
    elif isinstance(on, (tuple, list)):
        pairs = _pairs(on)
        test = None
        for a, b in pairs:
            same = F.col(f"`l.{a}`").eqNullSafe(F.col(f"`r.{b}`"))
            test = same if test is None else test & same
        if not multi:
            keys = [F.col(f"`r.{b}`") for _, b in pairs]
            r = _unique(r, keys)
        r = _small(r)
    elif isinstance(on, str):
        test = condition(parse(on), _two_sided(left, right))
        band = _band(parse(on), left, right)
        if band is not None and how == "inner":
            return _finish(_band_join(l, r, band, test), left, lnames, rnames, where, orderby)
    elif callable(on):
        test = on({c: F.col(f"`l.{c}`") for c in left.columns}, {c: F.col(f"`r.{c}`") for c in right.columns})
    else:
        test = on
    out = l.join(r, test, how)
    if unmatched == "error":
        # a filter, so that it is carried out whatever columns are asked for
        out = out.where(F.assert_true(F.coalesce(F.col("`r.#`"), F.lit(-1)) >= 0, "a left row has no match").isNull())
    return _finish(out, left, lnames, rnames, where, orderby)


def _finish(out: DataFrame, left: Table, lnames: dict, rnames: dict, where, orderby) -> Table:
    columns = [F.col(f"`l.{c}`").alias(o) for c, o in lnames.items()] + [F.col(f"`r.{c}`").alias(o) for c, o in rnames.items()]
    # the order of the left rows, then that of the right ones
    t = Table.of(out.select(*columns, F.col("`l.#`").alias("__l"), F.col("`r.#`").alias("__r")).withColumn(ROW, F.coalesce("__l", F.lit((1 << 62)) + F.col("__r"))), left.keywords)
    df = t.df
    ctx = Context.of(df.drop("__l", "__r"), left.keywords)
    if where is not None:
        df = df.where(predicate(where, ctx, Table(df.drop("__l", "__r"))))
    items = order_items(orderby)
    if items:
        df = df.orderBy(*sort_columns(items, ctx), F.col("__r").asc_nulls_last())
    return Table(df.drop("__l", "__r"), left.keywords)


def _names(cols, columns: list[str]) -> dict[str, str]:
    """Source to output name."""
    if cols is None:
        return {c: c for c in columns}
    if isinstance(cols, dict):
        return {src: out for out, src in cols.items()}
    return {c if isinstance(c, str) else c[1]: c if isinstance(c, str) else c[0] for c in cols}


def _unique(r: DataFrame, keys: list[Column]) -> DataFrame:
    """r, failing where a key occurs twice: the first of each key carries the check, without a job of its own."""
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return r.withColumn("__n", n).where(F.assert_true(F.col("__n") <= 1, "the right table has a key twice").isNull()).drop("__n")


def _two_sided(left: Table, right: Table) -> Context:
    from dataclasses import replace

    from ..plans.values import from_column

    columns: dict[str, Value] = {}
    for side, t in (("l", left), ("r", right)):
        for f in t.df.schema.fields:
            if f.name != ROW:
                try:
                    v = from_column(F.col(f"`{side}.{f.name}`"), f.dataType, f.nullable, f.metadata)
                except LanguageError:
                    continue
                columns[f"{side.upper()}.{f.name}"] = replace(v, nullable=True)
                columns[f"{side}.{f.name}"] = columns[f"{side.upper()}.{f.name}"]
    return Context(columns)


def _band(tree, left: Table, right: Table) -> tuple[str, str, str] | None:
    """(left column, right low, right high) of a plain ``L.x BETWEEN R.a AND R.b`` over numbers."""
    if tree[0] != "between" or tree[4] or any(t[0] != "col" for t in tree[1:4]):
        return None
    (a, x), (b, lo), (c, hi) = (t[1].split(".", 1) if "." in t[1] else ("", "") for t in tree[1:4])
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    types = dict(left.df.dtypes), dict(right.df.dtypes)
    if a.upper() == "L" and b.upper() == c.upper() == "R" and types[0].get(x) in numeric and types[1].get(lo) in numeric and types[1].get(hi) in numeric:
        return x, lo, hi
    return None


def _band_join(l: DataFrame, r: DataFrame, band: tuple[str, str, str], test: Column) -> DataFrame:
    """A range join by buckets of the median interval's length; longer intervals go to wider grids, where they span a
    few buckets, and each left row meets each interval in one bucket only.  Ends beyond all left values, infinite
    ones too, count as the last of these.  Left values that no interval can hold are left out before the join."""
    x, lo, hi = (F.col(f"`{n}`") for n in (f"l.{band[0]}", f"r.{band[1]}", f"r.{band[2]}"))
    finite = F.when(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), x.cast("double"))
    ends = l.agg(F.min(finite).alias("a"), F.max(finite).alias("b"), F.max(F.abs(x.cast("double")) == float("inf")).alias("inf")).first()
    # without finite left values there are no buckets, and an infinite one lies in intervals open on its side only
    if ends["a"] is None or ends["inf"]:
        return l.join(r, test)
    r = r.withColumns({"__lo": F.greatest(lo.cast("double"), F.lit(ends["a"])), "__hi": F.least(hi.cast("double"), F.lit(ends["b"]))})
    whole_low, whole_high, lo, hi = lo, hi, F.col("__lo"), F.col("__hi")
    good = r.where((whole_low <= whole_high) & (lo <= hi))
    span = good.agg(F.percentile_approx((hi - lo).cast("double"), 0.5).alias("w"), F.min(lo).alias("a"), F.max(hi).alias("b")).first()
    width = float(span["w"]) if span["w"] and span["w"] > 0 else 1.0
    # a grid for each power of 16: an interval goes to the finest grid in which it spans at most 17 buckets
    level = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.greatest((hi - lo) / F.lit(width * 16), F.lit(1.0))))).cast("int")
    placed = good.withColumn("__level", level).withColumn("__w", F.lit(width) * F.pow(F.lit(16.0), F.col("__level")))
    placed = placed.withColumn("__bucket", F.explode(F.sequence(F.floor(lo / F.col("__w")), F.floor(hi / F.col("__w"))))).drop("__w", "__lo", "__hi")
    # a power of 16 of a double: a few hundred at most
    levels = [row["__level"] for row in placed.select("__level").distinct().collect()]
    inside = l.where(x.cast("double").between(F.lit(span["a"]), F.lit(span["b"])))
    grid = inside.withColumn("__level", F.explode(F.array(*(F.lit(k) for k in levels)) if levels else F.array().cast("array<int>")))
    grid = grid.withColumn("__bucket", F.floor(x / (F.lit(width) * F.pow(F.lit(16.0), F.col("__level")))))
    return _meet(grid, placed, ["__level", "__bucket"]).where(test).drop("__level", "__bucket")


#: A task of a range join compares so many pairs, or more where that would take over MOST_TASKS tasks.
PAIRS_A_TASK, MOST_TASKS = 2_000_000, 1_000


def _meet(l: DataFrame, r: DataFrame, keys: list[str]) -> DataFrame:
    """The join by keys, with the pairs of frequent keys spread over tasks: each such key's left and right rows are
    dealt into chunks, near to equal ones, and every left chunk meets every right one."""
    counts = l.groupBy(*keys).agg(F.count(F.lit(1)).alias("nl")).join(r.groupBy(*keys).agg(F.count(F.lit(1)).alias("nr")), keys)
    pairs = F.col("nl").cast("double") * F.col("nr")
    total = counts.agg(F.sum(pairs).alias("n")).first()["n"] or 0.0
    if total <= PAIRS_A_TASK:
        return l.join(r, keys)
    target = max(PAIRS_A_TASK, total / MOST_TASKS)
    tasks = max(int(total / target) + 1, int(l.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    right = F.greatest(F.lit(1.0), F.round(F.col("nr") / target**0.5))
    frequent = counts.where(pairs > target).select(*keys, F.ceil(pairs / (right * target)).cast("int").alias("__nl"), right.cast("int").alias("__nr"))
    frequent = F.broadcast(l.sparkSession.createDataFrame(frequent.collect(), frequent.schema))  # fewer than MOST_TASKS
    chunk = lambda row, n: F.pmod(F.xxhash64(f"`{row}`"), F.coalesce(F.col(n), F.lit(1)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(n), F.lit(1)).cast("bigint") - 1))
    l = l.join(frequent, keys, "left").withColumn("__cl", chunk("l.#", "__nl")).withColumn("__cr", every("__nr")).drop("__nl", "__nr")
    r = r.join(frequent, keys, "left").withColumn("__cr", chunk("r.#", "__nr")).withColumn("__cl", every("__nl")).drop("__nl", "__nr")
    dealt = [*keys, "__cl", "__cr"]
    return l.repartition(tasks, *dealt).join(r.repartition(tasks, *dealt), dealt).drop("__cl", "__cr")


def lookup_asof(left: DataFrame, right: DataFrame, *, keys: Sequence[str], time: str, right_time: str, columns: Sequence[str]) -> DataFrame:
    """Each left row with the latest right row of its keys at or before its time, else the first one.

    Both sides are merged and ordered by time within the keys; the last row seen is carried forward.
    """
    from pyspark.sql import Window

    rows = left.withColumn("__id", F.monotonically_increasing_id())
    a = rows.select(*keys, F.col(time).alias("__t"), F.lit(1).alias("__side"), "__id", F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("__v"))
    b = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast("bigint").alias("__id"), F.struct(*columns).alias("__v"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side")
    seen = F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    both = a.unionByName(b).withColumn("__v", F.coalesce(seen, first)).where("__side = 1").select("__id", "__v")
    return rows.join(both, "__id", "left").select(*left.columns, *(F.col("__v")[c].alias(c) for c in columns))
