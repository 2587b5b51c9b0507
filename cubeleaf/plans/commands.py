"""Commands: SELECT, UPDATE, DELETE, INSERT, CREATE, ALTER and DROP as text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import operators as ops
from ..operators.groupby import groupby, is_aggregate
from ..table import Table
from .lower import ROW
from .parser import LanguageError, Parser, Token, tokens, walk

_CLAUSES = ["FROM", "INTO", "JOIN", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "GIVING"]


@dataclass
class Select:
    """The parts of a SELECT, as text and trees."""

    items: list = field(default_factory=list)
    distinct: bool = False
    source: object = None
    alias: str = ""
    joins: list = field(default_factory=list)
    where: object = None
    group: list = field(default_factory=list)
    mode: str = ""
    sets: list | None = None
    having: object = None
    order: list = field(default_factory=list)
    limit: object = None
    offset: int = 0
    into: str | None = None


class Statement(Parser):
    """Clauses over the expression parser."""

    def __init__(self, text: str):
        toks = tokens(text)
        while len(toks) > 1 and toks[-2].kind == "op" and toks[-2].text == ";":
            toks.pop(-2)
        super().__init__(text, toks, subquery=lambda p: select_of(p))

    def name(self) -> str:
        t: Token = self.tok
        if t.kind not in ("name", "str"):
            raise LanguageError(f"a name is needed at {t.at} in {self.text!r}")
        self.i += 1
        return t.value if t.kind == "str" else t.text

    def number(self) -> int:
        sign = -1 if self.take("-") else 1
        if self.tok.kind != "num":
            raise LanguageError("a whole number is needed")
        self.i += 1
        return sign * int(self.toks[self.i - 1].value)


def _source(p) -> tuple[object, str]:
    if p.take("("):
        inner = select_of(p)
        p.need(")")
        src = inner
    elif p.take("["):
        inner = select_of(p)
        p.need("]")
        src = inner
    elif p.take("$"):
        t = p.tok
        p.i += 1
        if t.kind == "quantity":  # "$1 d" looks like a number with a unit
            return ("$", int(t.value[0])), t.value[1]
        src = ("$", int(t.value))
    else:
        src = ("name", p.tok.value if p.tok.kind == "str" else p.tok.text)
        p.i += 1
    alias = ""
    p.take_word("AS")
    if p.tok.kind == "name" and p.tok.text.upper() not in (*_CLAUSES, "ON", "SET", "AS", "VALUES", "SELECT"):
        alias = p.tok.text
        p.i += 1
    return src, alias


def _limit(p):
    def bound():
        if p.op(":") or p.tok.kind == "end" or p.tok.kind == "name":
            return None
        sign = -1 if p.take("-") else 1
        p.i += 1
        return sign * int(p.toks[p.i - 1].value)

    first = bound()
    if not p.take(":"):
        return first
    stop = bound()
    return (first, stop, bound() if p.take(":") else 1)


def _order(p) -> list:
    default = None
    if p.word("ASC", "DESC"):
        default = p.tok.text.upper() == "DESC"
        p.i += 1
    out = []
    while True:
        tree = p.expression()
        down = default or False
        if p.word("ASC", "DESC"):
            down = p.tok.text.upper() == "DESC"
            p.i += 1
        out.append((tree, down))
        if not p.take(","):
            return out


def select_of(p) -> Select:
    """A SELECT; the parser stands on it."""
    if not p.take_word("SELECT"):
        raise LanguageError("SELECT is needed")
    s = Select(distinct=p.take_word("DISTINCT"))
    p.take_word("ALL")
    while not (p.tok.kind == "end" or p.word(*_CLAUSES) or p.op(")", "]")):
        if p.take("*"):
            s.items.append(("*", ""))
        else:
            tree = p.expression()
            name = None
            if p.take_word("AS"):
                if p.take("("):
                    a = p.name()
                    p.need(",")
                    name = (a, p.name())
                    p.need(")")
                else:
                    name = p.name()
            s.items.append((tree, name))
        if not p.take(","):
            break
    if p.take_word("INTO"):
        s.into = p.name()
    if p.take_word("FROM"):
        s.source, s.alias = _source(p)
    while p.take_word("JOIN"):
        src, alias = _source(p)
        if not p.take_word("ON"):
            raise LanguageError("JOIN needs ON")
        s.joins.append((src, alias, p.expression()))
    if p.take_word("WHERE"):
        s.where = p.expression()
    if p.take_word("GROUP"):
        if not p.take_word("BY") and not p.take_word("GROUPBY"):
            raise LanguageError("GROUP needs BY")
        _group(p, s)
    if p.take_word("HAVING"):
        s.having = p.expression()
    if p.take_word("ORDER"):
        if not p.take_word("BY"):
            raise LanguageError("ORDER needs BY")
        s.order = _order(p)
    if p.take_word("LIMIT"):
        s.limit = _limit(p)
    if p.take_word("OFFSET"):
        s.offset = _limit(p) or 0
    if p.take_word("GIVING"):
        s.into = p.name()
    return s


def _group(p, s: Select) -> None:
    if p.word("ROLLUP", "CUBE"):
        s.mode = p.tok.text.upper()
        p.i += 1
        p.need("(")
        close = True
    elif p.take_word("GROUPING"):
        if not p.take_word("SETS"):
            raise LanguageError("GROUPING needs SETS")
        p.need("(")
        s.sets = []
        while not p.op(")"):
            one = []
            if p.take("("):
                while not p.op(")"):
                    one.append(p.expression())
                    if not p.take(","):
                        break
                p.need(")")
            else:
                one.append(p.expression())
            s.sets.append(one)
            if not p.take(","):
                break
        p.need(")")
        seen = []
        for one in s.sets:
            for tree in one:
                if tree not in seen:
                    seen.append(tree)
        s.group = seen
        return
    else:
        close = False
    while True:
        s.group.append(p.expression())
        if not p.take(","):
            break
    if close:
        p.need(")")


class Runner:
    """Carries commands out over tables given by name or by position ($1, $2, ...)."""

    def __init__(self, tables: dict[str, Table], positional: list[Table], resolve=None, catalog=None):
        self.tables, self.positional, self.resolve, self.catalog = tables, positional, resolve, catalog

    def table(self, src) -> Table:
        if isinstance(src, Select):
            return self.select(src)
        kind, name = src if src is not None else ("$", 1)
        if kind == "$":
            if not 1 <= name <= len(self.positional):
                raise LanguageError(f"no table ${name}")
            return self.positional[name - 1]
        if name in self.tables:
            return self.tables[name]
        if self.catalog is not None and self.catalog.exists(name):
            return self.catalog.table(name)
        raise LanguageError(f"no table {name!r}")

    # --- SELECT -----------------------------------------------------------------------------------------------

    def select(self, s: Select) -> Table:
        t = self.table(s.source)
        qualified = {s.alias} if s.alias else set()
        for src, alias, test in s.joins:
            t = self._lookup(t, self.table(src), alias, test)
            qualified.add(alias)
        where, t = self._subqueries(s.where, t)
        hidden = [c for c in t.columns if c.startswith("__")]
        plain = [c for c in t.columns if not c.startswith("__") and "." not in c]
        items = []
        for k, (tree, name) in enumerate(s.items or [("*", "")]):
            if tree == "*":
                items += [(c, ("col", c)) for c in plain]
            elif name is None:
                items.append((tree[1].rpartition(".")[2] if tree[0] == "col" else f"Col_{k + 1}", tree))
            else:
                items.append((name, tree))
        having, t = self._subqueries(s.having, t)
        order = s.order
        if s.group or any(is_aggregate(tree) for _, tree in items) or (having is not None and is_aggregate(having)):
            keys = [(tree[1] if tree[0] == "col" else f"__key{k}", tree) for k, tree in enumerate(s.group)]
            sets = None
            if s.sets is not None:
                sets = [[keys[s.group.index(tree)][0] for tree in one] for one in s.sets]
            out = groupby(t, keys, select=items, where=where, having=having, orderby=_Ordered(order), limit=s.limit, offset=s.offset, rollup=s.mode == "ROLLUP", cube=s.mode == "CUBE", grouping_sets=sets, resolve=self.resolve)
            if s.distinct:
                out = ops.query(out, distinct=True)
        else:
            out = ops.query(t, _tree(where, t, self.resolve), select=items, orderby=_Ordered(order), limit=s.limit, offset=s.offset, distinct=s.distinct, resolve=self.resolve)
        if hidden:
            out = Table(out.df.drop(*hidden), out.keywords)
        if s.into and self.catalog is not None:
            self.catalog.save(s.into, out)
        return out

    def _lookup(self, left: Table, right: Table, alias: str, test) -> Table:
        """JOIN of a command: the first right row of each key, unmatched cells filled with stand-ins."""
        pairs = []
        for part in _conjuncts(test):
            if part[0] not in ("bin", "in") or part[0] == "bin" and part[1] != "==":
                raise LanguageError("JOIN takes equalities only")
            a, b = (part[2], part[3]) if part[0] == "bin" else (part[1], part[2][1][0])
            if _belongs(a, alias):
                a, b = b, a
            if not _belongs(b, alias):
                raise LanguageError("one side of a JOIN condition must be of the joined table")
            pairs.append((a, b))
        from .lower import Context, lower
        from .values import output

        lctx, rctx = Context.of(left.df, left.keywords), Context.of(right.df, right.keywords)
        lctx.resolve = rctx.resolve = self.resolve
        keys = [f"__j{i}" for i in range(len(pairs))]
        marked = left.df.withColumns({k: output(lower(a, lctx)) for k, (a, _) in zip(keys, pairs, strict=True)})
        rkeys = [output(lower(b, rctx)).alias(f"{k}r") for k, (_, b) in zip(keys, pairs, strict=True)]
        cells = F.struct(*(F.col(f"`{c}`") for c in right.columns))
        first = right.df.groupBy(*rkeys).agg(F.min_by(cells, ROW).alias("__right"), F.lit(True).alias("__has"))
        from ..operators.join import _small

        same = None
        for k in keys:
            one = F.col(k).eqNullSafe(F.col(f"{k}r"))
            same = one if same is None else same & one
        both = marked.join(_small(first), same, "left")
        taken = set(left.columns)
        cols = []
        for f in right.data().schema.fields:
            cell = F.when(F.col("__has"), F.col("__right")[f.name]).otherwise(_stand_in(f.dataType))
            cell = cell if not isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)) else F.when(F.col("__has"), F.col("__right")[f.name].cast("bigint")).otherwise(F.lit(2**63 - 1))
            cols.append(cell.alias(f"{alias}.{f.name}"))
            if f.name not in taken:
                cols.append(cell.alias(f.name))
        return Table(both.select(*(F.col(f"`{c}`") for c in left.columns), *cols, F.col(ROW)), left.keywords)

    def _subqueries(self, tree, t: Table):
        """The tree with its sub-queries carried out: IN becomes a semi join's flag, EXISTS a literal."""
        if tree is None or not any(isinstance(n, tuple) and n and n[0] in ("in", "exists") for n in walk(tree)):
            return tree, t
        state = [t]

        def go(node):
            if isinstance(node, tuple) and node[:1] == ("exists",):
                sub = node[1]
                n = sub.limit if isinstance(sub.limit, int) and sub.limit > 0 else 1
                return ("lit", self.select(sub).df.select(ROW).limit(n).count() >= n)
            if isinstance(node, tuple) and node[:1] == ("in",) and node[2][0] == "query":
                return self._in_query(go(node[1]), node[2][1], node[3], state)
            if isinstance(node, tuple):
                return tuple(go(x) for x in node)
            return [go(x) for x in node] if isinstance(node, list) else node

        out = go(tree)
        return out, state[0]

    def _in_query(self, subject, sub: Select, negated: bool, state: list):
        from .lower import Context, lower
        from .values import output

        t = state[0]
        ctx = Context.of(t.df, t.keywords)
        ctx.resolve = self.resolve
        found = self.select(sub)
        name, key = f"__in{len(t.df.columns)}", f"__key{len(t.df.columns)}"
        values = Context.of(found.df, found.keywords)
        right = found.df.select(output(lower(("col", found.columns[0]), values)).alias(key)).distinct()
        # SQL's three values: a null among them makes a miss unknown
        nulls = right.agg(F.coalesce(F.bool_or(F.col(key).isNull()), F.lit(False)).alias("__null"))
        some = right.where(F.col(key).isNotNull()).withColumn(name, F.lit(True))
        left = t.df.withColumn(f"{key}l", output(lower(subject, ctx)))
        both = left.join(some, left[f"{key}l"] == some[key], "left").join(F.broadcast(nulls))
        empty_or_hit = F.coalesce(F.col(name), F.when(F.col(f"{key}l").isNull() | F.col("__null"), F.lit(None).cast("boolean")).otherwise(F.lit(False)))
        state[0] = Table(both.withColumn(name, empty_or_hit).drop(key, f"{key}l", "__null"), t.keywords)
        return ("un", "not", ("col", name)) if negated else ("col", name)

    # --- changes ----------------------------------------------------------------------------------------------

    def update(self, p: Statement):
        src, _ = _source(p)
        if not p.take_word("SET"):
            raise LanguageError("UPDATE needs SET")
        items = []
        while True:
            if p.take("("):
                a = p.name()
                p.need(",")
                target = ("pair", a, p.name())
                p.need(")")
            else:
                target = p.postfix()
            p.need("=")
            items.append((target, p.expression()))
            if not p.take(","):
                break
        where, order, limit = _tail(p)
        t = self.table(src)
        where, t2 = self._subqueries(where, t)
        out, n = ops.update(t2, items, where, orderby=_Ordered(order), limit=limit, resolve=self.resolve)
        return self._commit(src, Table(out.df.select(*t.df.columns), t.keywords, t.name), n, same_rows=True)

    def delete(self, p: Statement):
        p.take_word("FROM")
        src, _ = _source(p)
        where, order, limit = _tail(p)
        t = self.table(src)
        where, t2 = self._subqueries(where, t)
        out, n = ops.delete(t2, where, orderby=_Ordered(order), limit=limit, resolve=self.resolve)
        return self._commit(src, Table(out.df.select(*t.df.columns), t.keywords, t.name), n)

    def insert(self, p: Statement):
        limit = None
        if p.take_word("LIMIT"):
            limit = _limit(p)
        p.take_word("INTO")
        src, _ = _source(p)
        t = self.table(src)
        if p.take_word("SET"):
            row = {}
            while True:
                name = p.name()
                p.need("=")
                row[name] = p.expression()
                if not p.take(","):
                    break
            return self._commit(src, ops.insert(t, [row], limit=limit, resolve=self.resolve), None)
        columns = None
        if p.take("(") or (p.op("[") and p.take("[")):
            columns = [p.name()]
            while p.take(","):
                columns.append(p.name())
            if not p.take(")"):
                p.need("]")
        if p.word("SELECT"):
            return self._commit(src, ops.insert(t, self.select(select_of(p)), columns=columns), None)
        if not p.take_word("VALUES", "VALUE"):
            raise LanguageError("INSERT needs VALUES, SET or SELECT")
        rows = []
        while True:
            close = {"(": ")", "[": "]"}[p.take("(", "[") or p.need("(")]
            row = [p.expression()]
            while p.take(","):
                row.append(p.expression())
            p.need(close)
            rows.append(row)
            if not p.take(","):
                break
        if p.take_word("LIMIT"):
            limit = _limit(p)
        return self._commit(src, ops.insert(t, rows, columns=columns, limit=limit, resolve=self.resolve), None)

    def _commit(self, src, out: Table, n: DataFrame | None, *, same_rows: bool = False) -> Table:
        """Saves a changed table where it has a name in a catalog."""
        if self.catalog is not None and src and src[0] == "name" and self.catalog.exists(src[1]):
            # what a row selection or a concatenation shows has numbers of its own
            plain = self.catalog.manifest(src[1])["kind"] == "data"
            self.catalog.save(src[1], out, same_rows=same_rows and plain)
            return self.catalog.table(src[1])
        if src and src[0] == "name":
            self.tables[src[1]] = out
        return out

    def create(self, p: Statement) -> Table:
        if not p.take_word("TABLE"):
            raise LanguageError("CREATE needs TABLE")
        name = p.name()
        opened = p.take("(", "[")
        fields = []
        while opened and not p.op(")", "]"):
            fields.append(_column(p))
            if not p.take(","):
                break
        if opened:
            p.need({"(": ")", "[": "]"}[opened])
        limit = _limit(p) if p.take_word("LIMIT") else 0
        while p.tok.kind != "end":  # storage hints have no meaning here
            p.i += 1
        spark = self.catalog.spark
        from ..operators.dml import _default

        rows = spark.range(limit or 0)
        t = Table(rows.select(*(_default(f.dataType).alias(f.name, metadata=f.metadata) for f in fields), F.col("id").alias(ROW)))
        self.catalog.save(name, t, new=True)
        return self.catalog.table(name)

    def drop(self, p: Statement) -> None:
        if not p.take_word("TABLE"):
            raise LanguageError("DROP needs TABLE")
        while True:
            self.catalog.drop(p.name())
            if not p.take(","):
                return

    def alter(self, p: Statement) -> Table:
        """All parts are tried on the table before anything is saved."""
        if not p.take_word("TABLE"):
            raise LanguageError("ALTER needs TABLE")
        name = p.name()
        t = self.catalog.table(name)
        df, words = t.df, {**t.keywords}
        from ..operators.dml import _default

        while p.tok.kind != "end":
            if p.take_word("ADD"):
                p.take_word("COLUMN")
                while True:
                    f = _column(p)
                    if f.name in df.columns:
                        raise LanguageError(f"column {f.name!r} is there already")
                    df = df.withColumn(f.name, _default(f.dataType).alias(f.name, metadata=f.metadata))
                    if not p.take(","):
                        break
            elif p.take_word("DROP"):
                keyword = p.take_word("KEYWORD")
                p.take_word("COLUMN")
                while True:
                    x = p.name()
                    if keyword:
                        words = _without(words, x)
                    elif x not in t.columns and x not in df.columns:
                        raise LanguageError(f"no column {x!r}")
                    else:
                        df = df.drop(x)
                    if not p.take(","):
                        break
            elif p.take_word("RENAME"):
                keyword = p.take_word("KEYWORD")
                p.take_word("COLUMN")
                while True:
                    a = p.name()
                    if not p.take_word("TO"):
                        raise LanguageError("RENAME needs TO")
                    b = p.name()
                    if keyword:
                        if a not in words or b in words:
                            raise LanguageError(f"can't rename keyword {a!r}")
                        words = {(b if k == a else k): v for k, v in words.items()}
                    elif a not in df.columns or b in df.columns:
                        raise LanguageError(f"can't rename column {a!r}")
                    else:
                        df = df.withColumnRenamed(a, b)
                    if not p.take(","):
                        break
            elif p.take_word("SET"):
                if not p.take_word("KEYWORD"):
                    raise LanguageError("SET needs KEYWORD")
                while True:
                    x = p.name()
                    p.need("=")
                    value = _constant(p.expression())
                    if x in words and isinstance(words[x], str) != isinstance(value, str):
                        raise LanguageError(f"keyword {x!r} has a value of another class")
                    words = {**words, x: value}
                    if not p.take(","):
                        break
            else:
                raise LanguageError(f"unexpected {p.tok.text!r}")
        self.catalog.save(name, Table(df, words))
        return self.catalog.table(name)


def _without(words: dict, name: str) -> dict:
    if name not in words:
        raise LanguageError(f"no keyword {name!r}")
    return {k: v for k, v in words.items() if k != name}


def _constant(tree):
    if tree[0] in ("lit", "date"):
        return tree[1]
    if tree[0] == "array":
        return [_constant(x) for x in tree[1]]
    if tree[0] == "un" and tree[1] == "-":
        return -_constant(tree[2])
    raise LanguageError("a constant is needed")


#: Type names of CREATE and ALTER.
_TYPES = {
    "BOOL": T.BooleanType(), "B": T.BooleanType(), "UCHAR": T.ShortType(), "UC": T.ShortType(), "SHORT": T.ShortType(), "I2": T.ShortType(), "USHORT": T.IntegerType(), "U2": T.IntegerType(),
    "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "I4": T.IntegerType(), "UINT": T.LongType(), "U4": T.LongType(), "INT64": T.LongType(), "I8": T.LongType(), "BIGINT": T.LongType(),
    "FLOAT": T.FloatType(), "R4": T.FloatType(), "DOUBLE": T.DoubleType(), "R8": T.DoubleType(), "STRING": T.StringType(), "S": T.StringType(),
}


def _column(p) -> T.StructField:
    """NAME TYPE [NDIM=n SHAPE=[..] UNIT='..' COMMENT='..']"""
    name, kind = p.name(), p.name().upper()
    if kind in ("COMPLEX", "C4", "DCOMPLEX", "C8"):
        e: T.DataType = T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])
    elif kind in _TYPES:
        e = _TYPES[kind]
    else:
        raise LanguageError(f"no type {kind!r}")
    meta, bracket = {}, p.take("[", "(")
    rank = 0
    while p.word("NDIM", "SHAPE", "UNIT", "COMMENT"):
        what = p.tok.text.upper()
        p.i += 1
        p.need("=")
        value = _constant(p.expression())
        meta[what.lower()] = value
        rank = value if what == "NDIM" else len(value) if what == "SHAPE" else rank
        if not bracket or not p.take(","):
            continue
    if bracket:
        p.need({"[": "]", "(": ")"}[bracket])
    if rank == 1:
        e = T.ArrayType(e)
    elif rank:
        e = T.StructType([T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.ArrayType(e))])
    return T.StructField(name, e, True, meta)


class _Ordered(list):
    """Order items that are trees already."""


def _tree(where, t: Table, resolve):
    if where is None:
        return None
    from .lower import Context, condition

    ctx = Context.of(t.df, t.keywords)
    ctx.resolve = resolve
    return condition(where, ctx)


def _tail(p):
    where = p.expression() if p.take_word("WHERE") else None
    order = []
    if p.take_word("ORDER"):
        if not p.take_word("BY"):
            raise LanguageError("ORDER needs BY")
        order = _order(p)
    limit = _limit(p) if p.take_word("LIMIT") else None
    return where, order, limit


def _conjuncts(tree) -> list:
    return _conjuncts(tree[2]) + _conjuncts(tree[3]) if tree[:2] == ("bin", "and") else [tree]


def _belongs(tree, alias: str) -> bool:
    return any(n[0] == "col" and n[1].startswith(f"{alias}.") for n in walk(tree) if n) or tree[:2] == ("call", f"{alias}.rowid")


def _stand_in(kind: T.DataType):
    """What an unmatched cell holds."""
    if isinstance(kind, T.LongType):
        return F.lit(2**63 - 1)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.lit(float("nan")).cast(kind)
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.StringType):
        return F.lit("none")
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    return F.lit(None).cast(kind)


def execute(command: str, *others: Table | DataFrame, tables: dict | None = None, catalog=None, resolve=None) -> Table | None:
    """Carries a command out.  others are $1, $2, ...; without FROM a command is about $1."""
    named = {k: Table.of(v) for k, v in (tables or {}).items()}
    runner = Runner(named, [Table.of(t) for t in others], resolve, catalog)
    p = Statement(command)
    verb = p.tok.text.upper()
    if verb == "SELECT":
        out = runner.select(select_of(p))
        if p.tok.kind != "end":
            raise LanguageError(f"unexpected {p.tok.text!r} in {command!r}")
        return out
    p.i += 1
    actions = {"UPDATE": runner.update, "DELETE": runner.delete, "INSERT": runner.insert, "CREATE": runner.create, "DROP": runner.drop, "ALTER": runner.alter}
    if verb not in actions:
        raise LanguageError(f"no command {verb!r}")
    out = actions[verb](p)
    if tables is not None:
        tables.update(named)
    return out

