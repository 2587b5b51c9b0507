import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Row
from pyspark.sql import functions as F

from cubeleaf import operators as ops
from cubeleaf.plans.commands import execute
from cubeleaf.plans.lower import ROW
from cubeleaf.plans.parser import LanguageError
from cubeleaf.sources import Catalog
from cubeleaf.sources.catalog import Conflict
from cubeleaf.table import Table


def one(spark, expression, **cells):
    t = Table.of(spark.createDataFrame([Row(**(cells or {"Z": 0}))]))
    return execute(f"SELECT {expression} AS r FROM $1", t).data().first()["r"]


def numbers(spark, n=20):
    return Table.of(spark.createDataFrame([(i, float(i - 1), "xy"[i % 2], i % 3 == 0) for i in range(1, n + 1)], "A int, B double, C string, D boolean").coalesce(1))


def test_division_and_modulo(spark):
    assert one(spark, "7 % -3") == -2
    assert one(spark, "-7 % 3") == 2
    assert one(spark, "7 % 0") == 7
    assert one(spark, "7 // 2") == 3.0
    assert one(spark, "-7 // 2") == -4.0
    assert one(spark, "1 / X", X=0) == math.inf
    assert math.isnan(one(spark, "0 / X", X=0))
    assert one(spark, "fmod(-7, 3)") == -1


def test_nan_is_ieee(spark):
    assert one(spark, "X == X", X=math.nan) is False
    assert one(spark, "X > 1", X=math.nan) is False
    assert one(spark, "X != 1", X=math.nan) is True


def test_types_are_checked(spark):
    for text in ("'5' == 5", "NOT 5", "1 + 'a'", "any(V)", "iif(1, 2, 3)"):
        with pytest.raises(LanguageError):
            one(spark, text, V=[1, 2])
    with pytest.raises(LanguageError):
        ops.query(numbers(spark), "A")


def test_rounding_and_conversion(spark):
    assert one(spark, "round(X)", X=-2.5) == -3.0
    assert one(spark, "round(X)", X=2.5) == 3.0
    assert one(spark, "int(X)", X=1e300) == 2**63 - 1
    assert one(spark, "int(X)", X=-1e300) == -(2**63)
    assert one(spark, "int(X)", X=math.nan) == 0
    assert one(spark, "sign(X)", X=math.nan) == 0
    assert one(spark, "log(X)", X=0.0) == -math.inf
    assert math.isnan(one(spark, "log(X)", X=-1.0))
    assert one(spark, "string(X)", X=1.5) == "1.5"


def test_strings_count_bytes(spark):
    assert one(spark, "strlength(S)", S="é") == 2
    assert one(spark, "upper(S)", S="aé") == "Aé"
    assert one(spark, "substr(S, 1, 2)", S="hello") == "el"
    assert one(spark, "capitalize(S)", S="two wORDS-here") == "Two Words-Here"
    assert one(spark, "S LIKE 'a%'", S="a\nb") is False
    assert one(spark, "S ~ m/b/", S="a\nb") is True


def test_dates(spark):
    assert one(spark, "mjdtodate(58891.5)") == 58891.5
    assert one(spark, "ctod(2020-02-12/12:30:00)") == "2020/02/12/12:30:00.000"
    assert one(spark, "weekday(2020-02-12)") == 3
    assert one(spark, "week(2020-01-01)") in (0, 1)
    assert one(spark, "hms(pi())") == "12h00m00.000"
    assert one(spark, "dms(-pi()/4)") == "-045d00m00.000"


def test_arrays(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    assert one(spark, "V[2:3]", V=v) == [2.0, 3.0]
    assert one(spark, "V[0]", V=v) == 4.0
    assert one(spark, "V[end-1]", V=v) == 3.0
    assert one(spark, "median(V)", V=v) == 2.5
    assert one(spark, "fractile(V, 0.5)", V=v) == 2.0
    assert one(spark, "runningsum(V, 1)", V=v) == [0.0, 6.0, 9.0, 0.0]
    assert one(spark, "boxedsum(V, 3)", V=v) == [6.0, 4.0]
    assert one(spark, "sum(V[V > 2])", V=v) == 3.0  # the mask excludes
    assert one(spark, "V[V > 2]", V=v).asDict() == {"data": v, "mask": [False, False, True, True]}
    assert one(spark, "nelements(V[V > 2])", V=v) == 4
    assert one(spark, "replacemasked(V[V > 2], 0)", V=v).asDict()["data"] == [1.0, 2.0, 0.0, 0.0]
    with pytest.raises(PySparkException):
        one(spark, "V[3:2]", V=v)


def test_cells_of_any_shape(spark):
    x = Row(shape=[2, 3], data=[1.0, 2.0, 3.0, 4.0, 5.0, 6.0])
    assert one(spark, "X[1, 2]", X=x) == 3.0
    assert one(spark, "X[1, ]", X=x).asDict() == {"shape": [1, 3], "data": [1.0, 3.0, 5.0]}
    assert one(spark, "sums(X, 1)", X=x).asDict() == {"shape": [3], "data": [3.0, 7.0, 11.0]}
    assert one(spark, "transpose(X)", X=x).asDict() == {"shape": [3, 2], "data": [1.0, 3.0, 5.0, 2.0, 4.0, 6.0]}
    assert one(spark, "shape(X)", X=x) == [2, 3]
    assert one(spark, "sum(X + 1)", X=x) == 27.0


def test_complex(spark):
    z = one(spark, "complex(1, 2) * complex(3, -1)")
    assert (z.re, z.im) == (5.0, 5.0)
    assert one(spark, "abs(complex(3, 4))") == 5.0
    assert one(spark, "complex(3, 4) > complex(0, 1)") is True


def test_units(spark):
    assert one(spark, "1km + 5m > 1004m") is True
    with pytest.raises(LanguageError):
        one(spark, "1km > 1s")


def test_order_ties_and_limits(spark):
    t = numbers(spark)
    up = [r.A for r in ops.query(t, orderby="C").data().collect()]
    down = [r.A for r in ops.query(t, orderby="C DESC").data().collect()]
    assert up == [*range(2, 21, 2), *range(1, 20, 2)]
    assert down == up[::-1]  # ties turn too if all keys descend
    assert [r.A for r in execute("SELECT A FROM $1 ORDER BY A LIMIT -17", t).data().collect()] == [1, 2, 3]
    assert [r.A for r in execute("SELECT A FROM $1 ORDER BY A LIMIT 1:10:4", t).data().collect()] == [2, 6, 10]
    assert execute("SELECT A FROM $1 LIMIT 0", t).data().count() == 20


def test_predicates_of_three_kinds(spark):
    t = numbers(spark)
    expected = [2, 4]
    for where in ("A < 5 AND C == 'x'", (F.col("A") < 5) & (F.col("C") == "x"), lambda r: r["A"] < 5 and r["C"] == "x"):
        assert [r.A for r in ops.query(t, where).df.orderBy("A").collect()] == expected


def test_groups(spark):
    t = numbers(spark)
    rows = ops.groupby(t, ["C"], select=["C", ("n", "gcount()"), ("last", "A"), ("m", "gmedian(B)"), ("ids", "growid()")], orderby="C").data().collect()
    assert [(r.C, r.n, r.last, r.m) for r in rows] == [("x", 10, 20, 9.0), ("y", 10, 19, 8.0)]
    empty = ops.query(t, "A > 100")
    assert ops.groupby(empty, [], select=[("n", "gcount()")]).data().count() == 0
    assert ops.groupby(t, [], select=[("v", "gsamplevariance(B)")], where="A == 1").data().first().v == 0.0


def test_missing_poisons_aggregates(spark):
    t = Table.of(spark.createDataFrame([(1, 1.0), (1, None), (2, 3.0)], "K int, X double"))
    rows = {r.K: r.s for r in ops.groupby(t, ["K"], select=["K", ("s", "gsum(X)")]).data().collect()}
    assert rows == {1: None, 2: 3.0}


def test_joins(spark):
    left = Table.of(spark.createDataFrame([(0, "a"), (2, "b"), (9, "c")], "FK int, L string").coalesce(1))
    right = Table.of(spark.createDataFrame([(10,), (11,), (12,)], "R int").coalesce(1)).numbered()
    got = ops.join(left, right, "FK", unmatched="missing").df.orderBy("L").collect()
    assert [(r.L, r.R) for r in got] == [("a", 10), ("b", 12), ("c", None)]
    with pytest.raises(PySparkException):
        ops.join(left, right, "FK").df.collect()
    twice = Table.of(spark.createDataFrame([(0, 1), (0, 2)], "K int, V int"))
    with pytest.raises(PySparkException):
        ops.join(left, twice, ("FK", "K"), unmatched="drop").df.collect()
    assert ops.join(left, twice, ("FK", "K"), multi=True, unmatched="drop").df.count() == 2
    assert ops.join(left, twice, ("FK", "K"), multi=True, unmatched="full").df.count() == 4


def test_range_join_equals_nested_loop(spark):
    l = Table.of(spark.range(200).select(F.col("id").alias("i"), (F.col("id") * 0.37).alias("x")))
    r = Table.of(spark.range(40).select(F.col("id").alias("j"), (F.col("id") * 2.0 - 5).alias("a"), (F.col("id") * 2.0 - 5 + F.when(F.col("id") == 7, 60.0).otherwise(F.col("id") % 5)).alias("b")))
    fast = {(p.i, p.j) for p in ops.join(l, r, "L.x BETWEEN R.a AND R.b", multi=True, unmatched="drop").df.collect()}
    slow = {(p.i, p.j) for p in l.df.join(r.df, F.col("x").between(F.col("a"), F.col("b"))).collect()}
    assert fast == slow


def test_changes_are_sequential(spark):
    t = Table.of(spark.createDataFrame([(1, 10, [1, 2, 3]), (2, 20, [4, 5, 6])], "A int, B int, V array<int>").coalesce(1))
    out, n = ops.update(t, [("A", "B"), ("B", "A"), ("V[2:3]", "0"), ("V[V > 3]", "9")], "A == 1")
    assert n.first().rows == 1
    assert [tuple(r) for r in out.data().collect()] == [(10, 10, [1, 0, 0]), (2, 20, [4, 5, 6])]
    out, n = ops.update(t, [("A", "3e9")])
    assert {r.A for r in out.df.collect()} == {2**31 - 1} and n.first().rows == 2
    left, n = ops.delete(t, orderby="A DESC", limit=1)
    assert [r.A for r in left.df.collect()] == [1]
    more = ops.insert(t, [{"A": "7"}, {"A": "8"}], limit=3).data().collect()
    assert [r.A for r in more] == [1, 2, 7, 8, 7]
    with pytest.raises(LanguageError):
        ops.update(t, [("A", "'text'")])


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}")
    c.save("t", numbers(spark), keywords={"K": 3})
    execute("UPDATE t SET B = A * ::K WHERE A < 3", catalog=c)
    assert c.versions("t") == [1, 2] and c.is_stale("t", 1)
    assert [r.B for r in c.table("t").df.orderBy("A").limit(3).collect()] == [3.0, 6.0, 2.0]
    assert [r.B for r in c.table("t", 1).df.orderBy("A").limit(1).collect()] == [0.0]
    c.save_rows("few", "t", ops.query(c.table("t"), "A > 18"), {"X": "A"})
    assert sorted(r.X for r in c.table("few").df.collect()) == [19, 20]
    c.save_parts("both", ["t", "t"])
    assert c.table("both").nrow() == 40
    execute("ALTER TABLE t ADD COLUMN N DOUBLE RENAME COLUMN C TO S SET KEYWORD Q='x'", catalog=c)
    assert "N" in c.table("t").columns and c.manifest("t")["keywords"]["Q"] == "x"
    with pytest.raises(LanguageError):
        c.set_keyword("t", "Q", 5)
    with pytest.raises(Conflict):
        c._folder("t").create("manifest-1.json", "{}")
    execute("DROP TABLE few", catalog=c)
    assert c.names() == ["both", "t"]


def test_lookup_asof(spark):
    from cubeleaf.operators.join import lookup_asof

    a = spark.createDataFrame([(1, 5.0), (1, 0.0), (2, 9.0)], "k int, t double")
    b = spark.createDataFrame([(1, 1.0, "p"), (1, 4.0, "q"), (2, 3.0, "r")], "k int, s double, v string")
    got = {(r.k, r.t): r.v for r in lookup_asof(a, b, keys=["k"], time="t", right_time="s", columns=["v"]).collect()}
    assert got == {(1, 5.0): "q", (1, 0.0): "p", (2, 9.0): "r"}


def test_index_join_is_broadcast(spark, tmp_path):
    for name, n in (("left", 20), ("right", 5)):
        numbers(spark, n).data().write.parquet(f"file://{tmp_path}/{name}")
    left, right = (Table.read(spark, f"file://{tmp_path}/{n}") for n in ("left", "right"))
    plan = ops.join(left, right, "A", unmatched="drop", rightcols={"X": "B"}).df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_row_numbers_stay_apart(spark):
    t = numbers(spark, 3)
    twice = ops.concat(ops.concat(t, t), t)
    more = ops.insert(ops.insert(twice, [{"A": "7"}]), [{"A": "8"}])
    rows = ops.query(more, select=[("A", "A"), ("r", "rowid()")], orderby="rowid()").data().collect()
    assert [r.A for r in rows] == [1, 2, 3] * 3 + [7, 8] and len({r.r for r in rows}) == 11


def test_registered_range_join_takes_every_part(spark, tmp_path):
    from cubeleaf.queries import QUERIES

    lines = [(i, i % 3, float(q)) for i, q in enumerate([1, 2, 5, 5, 7, 50])]
    parts = [(k, k % 9) for k in range(1, 25)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(tuple, QUERIES["J7_range"](spark, str(tmp_path)).collect()))
    assert got == sorted((o, n, k) for o, n, q in lines for k, size in parts if size <= q <= size + 1)


def test_per_element_aggregates_of_any_length(spark):
    rows = [(1, [1.0, 5.0]), (1, [4.0, 2.0]), (2, [1.0, 2.0, 3.0]), (2, [0.0, 7.0, 1.0]), (3, [float(i) for i in range(5000)])]
    t = Table.of(spark.createDataFrame(rows, "K int, X array<double>").coalesce(1))
    select = ["K", ("m", "gmaxs(X)"), ("n", "gcount()"), ("s", "gsums(X)[1] + gcount()"), ("l", "X[1]")]
    got = {r.K: r for r in ops.groupby(t, ["K"], select=select, orderby="K").data().collect()}
    assert got[1].m == [4.0, 5.0] and got[2].m == [1.0, 7.0, 3.0] and got[3].m == rows[4][1]
    assert [(got[k].n, got[k].l) for k in (1, 2, 3)] == [(2, 4.0), (2, 0.0), (1, 0.0)] and got[1].s == 7.0
    few = ops.query(t, "K == 1")
    assert [(r.K, r.m) for r in ops.groupby(few, ["K"], select=["K", ("m", "gsums(X)")], rollup=True).data().collect()].count((None, [5.0, 7.0])) == 1
    assert ops.groupby(few, [], select=[("m", "gmins(X)")]).data().first().m == [1.0, 2.0]
    with pytest.raises(PySparkException):
        ops.groupby(t, [], select=[("m", "gmaxs(X)")]).data().collect()


def test_registered_computed_column_takes_every_line(spark, tmp_path):
    from cubeleaf.queries import QUERIES

    lines = [(i, i % 3 + 1, 10.0 * i, 0.5) for i in range(6)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_extendedprice double, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(map(tuple, QUERIES["P5_computed"](spark, str(tmp_path)).collect())) == [(i, 5.0 * i) for i in range(6)]


def test_row_numbers_of_many_files(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("v")).repartitionByRange(7, "v").sortWithinPartitions("v").write.parquet(f"{tmp_path}/many")
    t = Table.read(spark, f"{tmp_path}/many")
    rows = ops.query(t, select=["v", ("r", "rowid()")], orderby="v").data().collect()
    assert [(r.v, r.r) for r in rows] == [(i, i) for i in range(100)]
    plan = t.df._jdf.queryExecution().optimizedPlan().toString()
    assert "map(" not in plan and "Sort" not in plan
    loose = Table.of(spark.range(50, numPartitions=6)).numbered()
    assert [r[0] for r in ops.query(loose, select=[("r", "rowid()")], orderby="id").data().collect()] == list(range(50))


def test_a_row_selection_keeps_to_its_version(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}")
    c.save("t", Table.of(spark.range(6).select(F.col("id").alias("v")).coalesce(1)))
    c.save_rows("few", "t", ops.query(c.table("t"), "v >= 4"))
    c.save_rows("fewer", "few", ops.query(c.table("few"), "v == 5"))
    execute("DELETE FROM t WHERE v == 0", catalog=c)
    execute("UPDATE t SET v = v + 10", catalog=c)
    assert sorted(r.v for r in c.table("few").df.collect()) == [4, 5] and [r.v for r in c.table("fewer").df.collect()] == [5]
    assert ops.query(c.table("t"), select=["v", ("r", "rowid()")], orderby="v").data().collect() == [Row(v=v, r=v - 11) for v in range(11, 16)]


def test_range_join_with_open_ends(spark):
    inf = math.inf
    l = Table.of(spark.createDataFrame([(i, x) for i, x in enumerate([0.0, 1.5, 2.0, 1e6, math.nan, None])], "i int, x double"))
    r = Table.of(spark.createDataFrame([(0, -inf, 1.5), (1, 2.0, inf), (2, -inf, inf), (3, 5.0, 4.0), (4, None, 9.0)] + [(10 + k, 1.9, 1.9 + 10.0**k) for k in range(-90, 90, 2)], "j int, a double, b double"))
    on = lambda l: {(p.i, p.j) for p in ops.join(l, r, "L.x BETWEEN R.a AND R.b", multi=True, unmatched="drop").df.collect()}
    got = on(l)
    assert {p for p in got if p[1] < 10} == {(0, 0), (1, 0), (2, 1), (3, 1), (0, 2), (1, 2), (2, 2), (3, 2)}
    assert {p for p in got if p[1] >= 10} == {(i, 10 + k) for k in range(-90, 90, 2) for i, x in ((2, 2.0), (3, 1e6)) if x <= 1.9 + 10.0**k}
    beyond = Table.of(spark.createDataFrame([(7, inf)], "i int, x double"))
    assert {j for _, j in on(beyond) if j < 10} == {1, 2} and on(ops.query(l, "i > 90")) == set()


def test_inserted_rows_are_one_relation(spark):
    t = numbers(spark, 2)
    out = ops.insert(t, [{"A": str(k)} for k in range(40)], limit=100)
    assert out.df._jdf.queryExecution().optimizedPlan().toString().count("Range") <= 2
    assert [r.A for r in out.df.orderBy("__rowid").collect()][2:] == [k % 40 for k in range(100)]


def test_mean_of_no_complex_numbers(spark):
    z = Row(re=1.0, im=2.0)
    t = Table.of(spark.createDataFrame([(1, [z]), (2, [])], "K int, Z array<struct<re:double,im:double>>"))
    got = {r.K: r.m for r in execute("SELECT K, mean(Z) AS m FROM $1", t).data().collect()}
    assert tuple(got[1]) == (1.0, 2.0) and tuple(got[2]) == (0.0, 0.0)


def test_rows_keep_their_numbers_when_partitions_are_cut_anew(spark, tmp_path):
    wide = Table.of(spark.range(60000, numPartitions=3).select((F.col("id") * 7919 % 60000).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("s")))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    for k, v in zip(before, ("40", "200k", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        c = Catalog(spark, f"file://{tmp_path}")
        c.save("t", wide)
        c.save_rows("few", "t", ops.query(c.table("t"), "v % 3 == 0"), {"x": "v"})
        execute("DELETE FROM t WHERE v < 100", catalog=c)
        assert sorted(r.x for r in c.table("few").df.collect()) == list(range(0, 60000, 3))
        for t, n in ((c.table("t", 1), 60000), (c.table("t"), 59900), (ops.query(wide, orderby="v").numbered(), 60000)):
            assert t.df.agg(F.count("*"), F.count_distinct(ROW), F.min(ROW), F.max(ROW)).first() == (n, n, 0, n - 1)
        assert ops.query(wide, orderby="v").numbered().df.where(F.col(ROW) != F.col("v")).count() == 0
        assert c.table("t").df.join(c.table("t", 1).df.withColumnRenamed(ROW, "old"), ["v", "s"]).orderBy("old").select(ROW).limit(500).collect() == [Row(**{ROW: i}) for i in range(500)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_pairs_of_one_bucket_are_spread_over_tasks(spark, monkeypatch):
    import importlib

    monkeypatch.setattr(importlib.import_module("cubeleaf.operators.join"), "PAIRS_A_TASK", 500, raising=False)
    l = Table.of(spark.range(300).coalesce(1).select(F.col("id").alias("i"), (F.col("id") % 3).cast("double").alias("x")))
    r = Table.of(spark.range(90).coalesce(1).select(F.col("id").alias("j"), (F.col("id") % 2).cast("double").alias("a"), (F.col("id") % 2 + 1.0).alias("b")))
    out = ops.join(l, r, "L.x BETWEEN R.a AND R.b", multi=True, unmatched="drop").df
    slow = l.df.join(r.df, F.col("x").between(F.col("a"), F.col("b"))).select("i", "j")
    assert sorted(map(tuple, out.select("i", "j").collect())) == sorted(map(tuple, slow.collect()))
    sizes = [x["count"] for x in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 10 and max(sizes) < sum(sizes) / 4


def test_left_values_beyond_all_intervals_are_not_joined(spark):
    l = Table.of(spark.range(1000).select(F.col("id").alias("i"), F.col("id").cast("double").alias("x")))
    r = Table.of(spark.createDataFrame([(0, 10.0, 11.5), (1, 12.0, 13.0)], "j int, a double, b double"))
    out = ops.join(l, r, "L.x BETWEEN R.a AND R.b", multi=True, unmatched="drop").df
    assert {(p.i, p.j) for p in out.collect()} == {(10, 0), (11, 0), (12, 1), (13, 1)}
    assert "<= 13.0" in out._jdf.queryExecution().optimizedPlan().toString()


def test_parts_of_cells_are_set_by_arithmetic(spark):
    t = Table.of(spark.createDataFrame([(1, list(range(1, 11))), (2, []), (3, None), (4, [5, -1])], "A int, V array<int>").coalesce(1))
    cell = lambda target, value, row=1: {r.A: r.V for r in ops.update(t, [(target, value)], f"A == {row} OR A > 1 AND A < 4")[0].df.collect()}
    base = list(range(1, 11))
    for target, places in (("V[2:5]", [2, 3, 4, 5]), ("V[1:9:3]", [1, 4, 7]), ("V[-3:10]", [7, 8, 9, 10]), ("V[3:9:2][2:4:2]", [5, 9]), ("V[end]", [10]), ("V[2:8][3]", [4]), ("V[6:6:0]", [6]), ("V[V > 4 && V < 7]", [5, 6]), ("V[3:8][V % 2 == 0]", [4, 6, 8]), ("V[:3]", [1, 2, 3])):
        got = cell(target, "0")
        assert got == {1: [0 if x in places else x for x in base], 2: [], 3: None, 4: [5, -1]}, target
    assert cell("V[2:5]", "V[4:7]*10")[1] == [1, 40, 50, 60, 70, *base[5:]]
    assert cell("V[V > 8]", "V*10")[1] == [*base[:8], 90, 100] and cell("V[1:3]", "sum(V)")[1] == [55, 55, 55, *base[3:]]
    with pytest.raises(PySparkException):
        cell("V[2:5]", "0", 4)
    plan = ops.update(t, [("V[2:5]", "0"), ("V[V > 4]", "9")])[0].df._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan and "array_contains" not in plan


def test_cells_pass_through_python_once(spark, tmp_path):
    from cubeleaf.queries import QUERIES

    spark.createDataFrame([(i, [float(x * i) for x in range(64)]) for i in range(3)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES["F12_collapse_second"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == [(i, k, float((k - 1) * i)) for i in range(3) for k in range(1, 9)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("EvalPython") == 1


def test_cell_functions_of_missing_and_masked_cells(spark):
    t = Table.of(spark.createDataFrame([(1, [1.0, math.nan, 3.0, 4.0]), (2, None), (3, [5.0, 6.0, 7.0, 8.0])], "K int, V array<double>").coalesce(1))
    run = lambda e: {r.K: r.r for r in execute(f"SELECT K, {e} AS r FROM $1 WHERE K != 2", t).data().collect()}
    assert run("flatten(maxs(array(V, 2, 2), 1))")[3] == [6.0, 8.0] and math.isnan(run("flatten(maxs(array(V, 2, 2), 1))")[1][0])
    assert run("flatten(sums(array(V, 2, 2), 2))")[3] == [12.0, 14.0]
    assert run("arraydata(maxs(marray(array(V, 2, 2), array(V, 2, 2) > 6), 1))")[3].data == [6.0, 0.0]
    assert run("flatten(maxs(marray(array(V, 2, 2), array(V, 2, 2) > 6), 1))")[3] == [6.0]
    assert run("flatten(anys(array(V, 2, 2) > 7, 1))")[3] == [False, True]
    assert run("runningmax(V, 1)")[3] == [0.0, 7.0, 8.0, 0.0]
    whole = {r.K: r.r for r in execute("SELECT K, arraydata(runningmax(V, 1)) AS r FROM $1", t).data().collect()}
    assert whole[2] == [] and whole[3] == [0.0, 7.0, 8.0, 0.0]
