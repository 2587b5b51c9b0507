"""More registered queries: cells as whole arrays, joins of every kind, changes, stored tables and selections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as ops
from .functions.selection import Selections
from .operators.groupby import groups_apply
from .operators.join import lookup_asof
from .plans.commands import execute
from .sources import Catalog
from .table import Table

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> Table:
    return Table.read(spark, f"{sf_dir}/{name}.parquet")


#: name: (command, tables, the same in SQL)
COMMANDS: dict[str, tuple[str, tuple[str, ...], str]] = {
    "E10_regex": ("SELECT p_partkey FROM $1 WHERE p_type ~ m/o+[mn]/i AND p_name !~ f/.*z.*/", ("part",), "select p_partkey from part where regexp_matches(p_type, 'o+[mn]', 'i') and not regexp_matches(p_name, 'z')"),
    "Q3_not_in": ("SELECT c_custkey FROM $1 WHERE c_custkey NOT IN (SELECT o_custkey FROM $2 WHERE o_totalprice > 250000)", ("customer", "orders"), "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 250000)"),
    "Q4_exists": (
        "SELECT n_name FROM $1 WHERE n_regionkey == 2 && EXISTS (SELECT r_name FROM $2 WHERE r_regionkey == 1) || n_regionkey == 3 && EXISTS (SELECT r_name FROM $2 WHERE r_regionkey == 77) || n_nationkey == 0 && NOT EXISTS (SELECT r_name FROM $2 WHERE r_regionkey > 4)",
        ("nation", "region"),
        "select n_name from nation where (n_regionkey = 2 and exists (select 1 from region where r_regionkey = 1)) or (n_regionkey = 3 and exists (select 1 from region where r_regionkey = 77)) or (n_nationkey = 0 and not exists (select 1 from region where r_regionkey > 4))",
    ),
    "P9_star": ("SELECT * FROM $1 WHERE s_acctbal < 5000", ("supplier",), "select * from supplier where s_acctbal < 5000"),
    "P11_expression_order": ("SELECT o_orderkey FROM $1 ORDER BY DESC o_totalprice % 1000, o_orderkey LIMIT 30", ("orders",), "select o_orderkey from orders order by o_totalprice - 1000*floor(o_totalprice/1000) desc, o_orderkey desc limit 30"),
    "E2_literals": ("SELECT n_nationkey, 0x1F + n_nationkey AS h, 1.5e3 AS e, 2.5e-1 AS f, 'a' + \"b\" AS s FROM $1", ("nation",), "select n_nationkey, (31 + n_nationkey)::BIGINT as h, 1500.0::DOUBLE as e, 0.25::DOUBLE as f, 'ab' as s from nation"),
    "E16_literal": ("SELECT n_nationkey, sum([n_nationkey, n_regionkey, 7]) AS s, [3, 1, 2][n_regionkey % 3 + 1] AS e FROM $1", ("nation",), "select n_nationkey, (n_nationkey + n_regionkey + 7)::BIGINT as s, ([3, 1, 2])[n_regionkey % 3 + 1]::BIGINT as e from nation"),
    "E18_quantity": ("SELECT p_partkey FROM $1 WHERE p_size*1km + 5m > 20005m", ("part",), "select p_partkey from part where p_size*1000.0 + 5 > 20005"),
    "E20_exists": ("SELECT n_name FROM $1 WHERE isdefined(n_name) AND n_regionkey > 2", ("nation",), "select n_name from nation where n_regionkey > 2"),
    "F2_trig": (
        "SELECT p_partkey, round(1e9*sin(p_size)) AS s, round(1e9*cos(p_size)) AS c, round(1e9*atan2(p_size, 7)) AS a, round(1e9*tanh(p_size/50)) AS h, round(1e9*asin(p_size/50)) AS i FROM $1",
        ("part",),
        "select p_partkey, floor(0.5+1e9*sin(p_size)) as s, floor(0.5+1e9*cos(p_size)) as c, floor(0.5+1e9*atan2(p_size, 7)) as a, floor(0.5+1e9*((exp(2*p_size/50)-1)/(exp(2*p_size/50)+1))) as h, floor(0.5+1e9*asin(p_size/50)) as i from part",
    ),
    "F5_finite": ("SELECT p_partkey, isfinite(p_retailprice/(p_size-20)) AS f, isinf(p_retailprice/(p_size-20)) AS i, isnan((p_size-20)/(p_size-20)) AS n, near(p_size/3*3, p_size) AS e FROM $1", ("part",), "select p_partkey, p_size <> 20 as f, p_size = 20 as i, p_size = 20 as n, true as e from part"),
    "F7_constants": ("SELECT r_name, pi() AS p, c() AS c, round(1e12*e()) AS e FROM $1", ("region",), "select r_name, pi() as p, 299792458.0::DOUBLE as c, floor(0.5+1e12*exp(1.0)) as e from region"),
    "F11_shape": ("SELECT vec_id, ndim(array(embedding, 8, 8)) AS d, shape(array(embedding, 4, 16))[2] AS s, nelements(embedding[3:20]) AS n FROM $1", ("embeddings",), "select vec_id, 2::BIGINT as d, 16::BIGINT as s, 18::BIGINT as n from embeddings"),
    "F14_defined": ("SELECT doc_id, isdefined(text) AS d, isnull(lang) AS n FROM $1", ("documents",), "select doc_id, text is not null as d, lang is null as n from documents"),
    "F29_angles": ("SELECT n_nationkey, hms(n_nationkey*pi()/30) AS h, dms(n_regionkey*pi()/18) AS d, round(1e9*normangle(n_nationkey*2)) AS a FROM $1", ("nation",), "select n_nationkey, lpad((n_nationkey*24//60)::BIGINT::VARCHAR, 2, '0') || 'h' || lpad(((n_nationkey*24*60//60) % 60)::BIGINT::VARCHAR, 2, '0') || 'm00.000' as h, '+' || lpad((n_regionkey*10)::BIGINT::VARCHAR, 3, '0') || 'd00m00.000' as d, floor(0.5+1e9*(n_nationkey*2 - 2*pi()*ceil((n_nationkey*2 - pi())/(2*pi())))) as a from nation"),
    "F32_beam": ("SELECT p_partkey, round(1e9*pbgaussian(p_size/100, 0.3)) AS g FROM $1", ("part",), "select p_partkey, floor(0.5+1e9*exp(-4*ln(2.0)*power(p_size/100/0.3, 2))) as g from part"),
    "U5_time_angle": ("SELECT p_partkey FROM $1 WHERE p_size*15deg > 12.5h", ("part",), "select p_partkey from part where p_size > 12.5"),
    "X2_epoch": ("SELECT n_nationkey, round(1e3*(meas.epoch('TAI', 5e9+n_nationkey, 'UTC') - 5e9)) AS a, round(1e3*(meas.epoch('TT', 5e9, 'TAI') - 5e9)) AS b FROM $1", ("nation",), "select n_nationkey, 1e3*(37.0+n_nationkey) as a, 32184.0::DOUBLE as b from nation"),
    "X7_geodetic": ("SELECT n_nationkey, round(1e6*meas.wgs(meas.itrfxyz(n_nationkey/10, n_regionkey/10, 100))[1]) AS lon, round(1e3*meas.wgs(meas.itrfxyz(n_nationkey/10, n_regionkey/10, 100))[3]) AS h FROM $1", ("nation",), "select n_nationkey, floor(0.5+1e6*(n_nationkey/10)) as lon, 100000.0::DOUBLE as h from nation"),
    "A22_gaggr_size": ("SELECT c_nationkey, nelements(gaggr(c_custkey)) AS n, sum(gaggr(c_custkey)) AS s FROM $1 GROUP BY c_nationkey", ("customer",), "select c_nationkey, count(*) as n, sum(c_custkey)::BIGINT as s from customer group by 1"),
    "A26_masked": ("SELECT label, gmax(embedding[embedding > 0.1]) AS m, gntrue(embedding > 0.1) AS n FROM $1 GROUP BY label", ("embeddings",), "select label, max(list_max(list_filter(embedding, lambda x: not (x::DOUBLE > 0.1))))::DOUBLE as m, sum(len(list_filter(embedding, lambda x: x::DOUBLE > 0.1)))::BIGINT as n from embeddings group by 1"),
}

#: name: (array expression, table, key, the cells i, v of a row in SQL)
CELLS: dict[str, tuple[str, str, str, str]] = {
    "F12_collapse_first": ("flatten(maxs(array(embedding, 8, 8), 1))", "embeddings", "vec_id", "select vec_id, i, list_max(embedding[8*(i-1)+1 : 8*i])::DOUBLE as v from embeddings, range(1, 9) r(i)"),
    "F12_collapse_second": ("flatten(mins(array(embedding, 8, 8), 2))", "embeddings", "vec_id", "select vec_id, i, list_min(list_transform(range(0, 8), lambda k: embedding[i+8*k]))::DOUBLE as v from embeddings, range(1, 9) r(i)"),
    "F13_transpose": ("flatten(transpose(array(embedding, 8, 8)))", "embeddings", "vec_id", "select vec_id, i, embedding[((i-1)%8)*8 + (i-1)//8 + 1]::DOUBLE as v from embeddings, range(1, 65) r(i)"),
    "F13_reverse": ("reversearray(embedding)", "embeddings", "vec_id", "select vec_id, i, embedding[65-i]::DOUBLE as v from embeddings, range(1, 65) r(i)"),
    "F13_diagonal": ("diagonal(array(embedding, 8, 8))", "embeddings", "vec_id", "select vec_id, i, embedding[9*i-8]::DOUBLE as v from embeddings, range(1, 9) r(i)"),
    "F15_running_whole": ("runningmax(embedding, 2)", "embeddings", "vec_id", "select vec_id, i, case when i between 3 and 62 then list_max(embedding[i-2:i+2])::DOUBLE else 0.0 end as v from embeddings, range(1, 65) r(i)"),
    "F16_boxed_whole": ("boxedmin(embedding, 10)", "embeddings", "vec_id", "select vec_id, i, list_min(embedding[10*i-9:least(10*i, 64)])::DOUBLE as v from embeddings, range(1, 8) r(i)"),
    "F17_replaced": ("replacemasked(marray(embedding, embedding < 0), 0)", "embeddings", "vec_id", "select vec_id, i, greatest(embedding[i], 0)::DOUBLE as v from embeddings, range(1, 65) r(i)"),
    "E14_stride": ("embedding[2:60:7]", "embeddings", "vec_id", "select vec_id, i, embedding[7*i-5]::DOUBLE as v from embeddings, range(1, 10) r(i)"),
}


def _cells(expression: str, table: str, key: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = execute(f"SELECT {key}, arraydata({expression}) AS a FROM $1", _table(spark, sf_dir, table)).data()
        data = F.col("a.data") if out.schema["a"].dataType.typeName() == "struct" else F.col("a")
        # an inner explode would add a filter on the cell's size, for which a Python function is run once more
        return out.select(key, F.posexplode_outer(data).alias("i", "v")).where("i is not null").withColumn("i", (F.col("i") + 1).cast("bigint"))

    return run


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = execute("SELECT l_linestatus, ghist(l_quantity, 5, 0, 45) AS h FROM $1 GROUP BY l_linestatus", _table(spark, sf_dir, "lineitem")).data()
    return out.select("l_linestatus", F.posexplode("h").alias("i", "n")).withColumn("i", F.col("i").cast("bigint"))


def _growid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.groupby(_table(spark, sf_dir, "customer"), ["c_nationkey"], select=["c_nationkey", ("ids", "growid()")]).data()
    return out.select("c_nationkey", F.explode("ids").alias("id"))


def _gaggr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.groupby(_table(spark, sf_dir, "customer"), ["c_mktsegment"], select=["c_mktsegment", ("k", "gaggr(c_custkey)")]).data()
    data = F.col("k.data") if out.schema["k"].dataType.typeName() == "struct" else F.col("k")
    return out.select("c_mktsegment", F.posexplode(data).alias("i", "k")).withColumn("i", (F.col("i") + 1).cast("bigint"))


def _closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "customer")
    return ops.query(t, lambda r: r["c_acctbal"] > 100 * r["c_nationkey"], select=["c_custkey"], cols=["c_acctbal", "c_nationkey"]).data()


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = ops.query(_table(spark, sf_dir, "orders"), "o_totalprice > 100000", select=["o_orderkey", ("half", "o_totalprice/2")])
    return ops.query(few, "half < 100000", select=["o_orderkey"]).data()


def _pair_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.query(_table(spark, sf_dir, "embeddings"), select=["vec_id", (("v", "m"), "embedding[embedding > 0.2]")]).data()
    return out.select("vec_id", F.posexplode(F.arrays_zip("v", "m")).alias("i", "p")).select("vec_id", (F.col("i") + 1).cast("bigint").alias("i"), "p.v", "p.m")


def _groups_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "customer")
    return groups_apply(t, ["c_nationkey"], lambda g: g.groupby("c_nationkey", as_index=False).agg(n=("c_custkey", "size"), top=("c_acctbal", "max")), "c_nationkey int, n long, top double")


def _composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ops.query(_table(spark, sf_dir, "customer"), select=["c_custkey", ("a", "c_nationkey"), ("b", "c_custkey % 5")])
    n = ops.query(_table(spark, sf_dir, "nation"), select=["n_name", "n_nationkey", "n_regionkey"])
    return ops.join(c, n, [("a", "n_nationkey"), ("b", "n_regionkey")], leftcols=["c_custkey"], rightcols=["n_name"], unmatched="drop").data()


def _many(unmatched: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        l = ops.query(_table(spark, sf_dir, "labels"), "quality == 1")
        d = ops.query(_table(spark, sf_dir, "documents"), "n_chars > 500", select=["doc_id", "source"])
        return ops.join(l, d, [("doc_id", "doc_id")], leftcols={"l": "doc_id"}, rightcols={"d": "doc_id", "source": "source"}, multi=True, unmatched=unmatched).data()

    return run


def _must_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.join(_table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation"), ("c_nationkey", "n_nationkey"), leftcols=["c_custkey"], rightcols=["n_name"]).data()


def _two_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "nation")
    on = lambda l, r: (l["s_nationkey"] == r["n_nationkey"]) & (l["s_acctbal"] > 100 * r["n_regionkey"])
    return ops.join(s, n, on, leftcols=["s_suppkey"], rightcols=["n_name"], multi=True, unmatched="drop").data()


def _interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = ops.query(_table(spark, sf_dir, "part"), select=["p_partkey", ("lo", "p_retailprice - 1"), ("hi", "p_retailprice + 1")])
    return ops.join(_table(spark, sf_dir, "lineitem"), near, "L.l_extendedprice BETWEEN R.lo AND R.hi", leftcols=["l_orderkey", "l_linenumber"], rightcols=["p_partkey"], multi=True, unmatched="drop").data()


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").data()
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen_at"), F.col("event_id").alias("view_id"))
    return lookup_asof(bought, seen, keys=["user_id"], time="ts", right_time="seen_at", columns=["view_id"]).select("event_id", "view_id")


def _slice_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.update(_table(spark, sf_dir, "embeddings"), [("embedding[2:5]", "1.5"), ("embedding[embedding < 0]", "0")], "label % 2 == 0")[0].data()
    return out.select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", (F.col("i") + 1).cast("bigint").alias("i"), F.col("v").cast("double").alias("v"))


def _masked_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "embeddings")
    wide = Table.of(t.df.withColumns({"d": F.col("embedding").cast("array<double>"), "m": F.transform("embedding", lambda _: F.lit(False))}))
    out = ops.update(wide, [(("pair", "d", "m"), "embedding[embedding > 0.1]")], "label > 0")[0].data()
    return out.select("vec_id", F.posexplode(F.arrays_zip("d", "m")).alias("i", "p")).select("vec_id", (F.col("i") + 1).cast("bigint").alias("i"), "p.d", "p.m")


def _ordered_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.update(_table(spark, sf_dir, "customer"), [("c_acctbal", "0")], "c_nationkey == 3", orderby="c_acctbal DESC, c_custkey", limit=5)[0].data()
    return out.select("c_custkey", "c_acctbal")


def _ordered_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.delete(_table(spark, sf_dir, "orders"), "o_orderstatus == 'F'", orderby="o_totalprice, o_orderkey", limit=100)[0].data().select("o_orderkey")


def _insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation")
    return ops.insert(n, ops.query(n, "n_regionkey == 1", select=[("n_nationkey", "n_nationkey + 100"), "n_name", "n_regionkey"])).data()


def _catalog(spark: SparkSession) -> Catalog:
    """A catalog in a folder of its own beside the session's checkpoints; a temporary one only where all tasks run here."""
    import tempfile
    import uuid

    at = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/checkpoints"
    return Catalog(spark, f"{at.rstrip('/')}/catalog-{uuid.uuid4().hex}")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _catalog(spark)
    c.save("n", _table(spark, sf_dir, "nation"), keywords={"ADD": 7})
    execute("UPDATE n SET n_regionkey = n_regionkey + ::ADD WHERE n_nationkey > 9", catalog=c)
    execute("DELETE FROM n WHERE n_nationkey == 24", catalog=c)
    execute("ALTER TABLE n ADD COLUMN extra DOUBLE RENAME COLUMN n_name TO name", catalog=c)
    return c.table("n").data().select("n_nationkey", "name", "n_regionkey")


def _rows_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _catalog(spark)
    c.save("o", _table(spark, sf_dir, "orders"))
    c.save_rows("few", "o", ops.query(c.table("o"), "o_totalprice > 400000"), {"key": "o_orderkey", "price": "o_totalprice"})
    execute("DELETE FROM o WHERE o_orderkey < 100", catalog=c)  # the selection keeps to the version it was made of
    return c.table("few").data()


def _concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _catalog(spark)
    c.save("a", ops.query(_table(spark, sf_dir, "nation"), "n_regionkey < 2"))
    c.save("b", ops.query(_table(spark, sf_dir, "nation"), "n_regionkey > 3"))
    c.save_parts("both", ["a", "b"])
    return c.table("both").data()


def _observation(spark: SparkSession, sf_dir: str) -> tuple[Table, dict[str, Table]]:
    """lineitem as the main table of an observation; nation gives antennas, region fields, part spectral windows."""
    lines = _table(spark, sf_dir, "lineitem").df
    main = lines.select(
        "*",
        F.col("l_linenumber").alias("SCAN_NUMBER"), (F.col("l_suppkey") % 5).cast("int").alias("FIELD_ID"), (F.col("l_suppkey") % 25).cast("int").alias("ANTENNA1"), (F.col("l_partkey") % 25).cast("int").alias("ANTENNA2"),
        (F.col("l_partkey") % 4).cast("int").alias("DATA_DESC_ID"), F.array(F.col("l_quantity") * 10, F.col("l_tax") * 1000, F.lit(0.0)).alias("UVW"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6 + 40587 * 86400.0).alias("TIME"), F.lit(86400.0).alias("EXPOSURE"),
    )
    small = lambda rows, schema: Table.of(spark.createDataFrame(rows, schema).coalesce(1)).numbered()
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    tables = {
        "ANTENNA": ops.query(n, select=[("NAME", "n_name")]).numbered(),
        "FIELD": ops.query(r, select=[("NAME", "r_name")]).numbered(),
        "DATA_DESCRIPTION": small([(k % 3, k % 2) for k in range(4)], "SPECTRAL_WINDOW_ID int, POLARIZATION_ID int"),
        "SPECTRAL_WINDOW": small([(f"w{k}", 1e9 * (k + 1), [1e9 * (k + 1) + 1e6 * i for i in range(4)]) for k in range(3)], "NAME string, REF_FREQUENCY double, CHAN_FREQ array<double>"),
        "POLARIZATION": small([([9, 12],), ([5, 6, 7, 8],)], "CORR_TYPE array<int>"),
    }
    return Table(main), {**tables, "MAIN": Table(main)}


#: name: (selection, the same in SQL over lineitem)
SELECTIONS: dict[str, tuple[str, str]] = {
    "M15_baseline": ("mscal.baseline('NATION_1&NATION_2*;!3,24')", "a <> b and ((a = 1 and (b = 2 or b between 20 and 24)) or (b = 1 and (a = 2 or a between 20 and 24))) and not (a <> b and (a in (3, 24) or b in (3, 24)))"),
    "M15_autos": ("mscal.baseline('2~5&&&;7&&7,8')", "(a = b and a between 2 and 5) or (a = 7 and b in (7, 8)) or (a in (7, 8) and b = 7)"),
    "M15_pattern": ("mscal.baseline('/NATION_.&NATION_1./')", "a < 10 and b between 10 and 19"),
    "M16_field": ("mscal.field('/[AE]$/,>3')", "(select regexp_matches(r_name, '[AE]$') from region where r_regionkey = l_suppkey % 5) or l_suppkey % 5 > 3"),
    "M17_scan": ("mscal.scan('1,3~4,>6')", "l_linenumber in (1, 3, 4) or l_linenumber > 6"),
    "M18_spw": ("mscal.spw('w1,2:3')", "(l_partkey % 4) % 3 in (1, 2)"),
    "M18_spw_frequency": ("mscal.spw('*:2.0015~2.9GHz')", "(l_partkey % 4) % 3 = 1"),
    "M19_time": ("mscal.time('1995/3/1~1995/4/15/12:0:0,>1998/6/1,1996/2/29/0:0:0')", "l_shipdate between timestamp '1995-03-01' and timestamp '1995-04-15 12:00:00' or l_shipdate >= timestamp '1998-06-01' or abs(epoch(l_shipdate) - epoch(timestamp '1996-02-29')) <= 43200"),
    "M20_uvdist": ("mscal.uvdist('100~201m,0.4km:5%')", "d between 100 and 201 or d between 380 and 420"),
    "M20_wavelengths": ("mscal.uvdist('<1.5klambda')", "d * (1e9*((l_partkey % 4) % 3 + 1)) / 299792458.0 <= 1500"),
    "M21_corr": ("mscal.corr('RL,YX')", "(l_partkey % 4) % 2 = 1"),
}


def _selection(where: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        main, tables = _observation(spark, sf_dir)
        return execute(f"SELECT l_orderkey, l_linenumber FROM $1 WHERE {where}", main, resolve=Selections(tables)).data()

    return run


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a cell of four linear products by 16 channels."""
    cell = F.transform("embedding", lambda x, i: F.struct(x.cast("double").alias("re"), F.get(F.col("embedding"), 63 - i).cast("double").alias("im")))
    main = Table(_table(spark, sf_dir, "embeddings").df.withColumn("DATA", F.struct(F.array(F.lit(4), F.lit(16)).alias("shape"), cell.alias("data"))))
    setups = Table.of(spark.createDataFrame([([9, 10, 11, 12],)], "CORR_TYPE array<int>").coalesce(1))
    found = execute("SELECT vec_id, mscal.stokes(DATA) AS s FROM $1", main, resolve=Selections({"POLARIZATION": setups})).data()
    return found.select("vec_id", F.posexplode("s.data").alias("i", "z")).select("vec_id", "i", F.col("z.re").alias("re"), F.col("z.im").alias("im"))


def _wavelengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    main, tables = _observation(spark, sf_dir)
    return execute("SELECT l_orderkey, l_linenumber, mscal.uvwwvl()[1] AS u, mscal.uvwwvls()[1,4] AS u4 FROM $1", main, resolve=Selections(tables)).data()


_LINES = "select l_orderkey, l_linenumber from (select *, l_suppkey % 25 as a, l_partkey % 25 as b, sqrt(power(l_quantity*10, 2) + power(l_tax*1000, 2)) as d from lineitem) where "
_MANY = "select l.doc_id as l, d.doc_id as d, source from (select * from labels where quality = 1) l {} join (select * from documents where n_chars > 500) d on l.doc_id = d.doc_id"

FUNCTIONS: dict[str, tuple[Query, str]] = {
    "A23_ghist_whole": (_histogram, "select l_linestatus, i, n from (select l_linestatus, [count(*) filter (where l_quantity < 0)] || list_transform(range(0, 5), lambda k: 0) as x, count(*) filter (where l_quantity < 0) as c0, count(*) filter (where l_quantity >= 0 and l_quantity < 9) as c1, count(*) filter (where l_quantity >= 9 and l_quantity < 18) as c2, count(*) filter (where l_quantity >= 18 and l_quantity < 27) as c3, count(*) filter (where l_quantity >= 27 and l_quantity < 36) as c4, count(*) filter (where l_quantity >= 36 and l_quantity < 45) as c5, count(*) filter (where l_quantity >= 45) as c6 from lineitem group by 1) h, lateral (select unnest([0,1,2,3,4,5,6])::BIGINT as i, unnest([c0,c1,c2,c3,c4,c5,c6])::BIGINT as n)"),
    "A21_growid": (_growid, "select c_nationkey, row_number() over () - 1 as id from customer"),
    "A22_gaggr": (_gaggr, "select c_mktsegment, row_number() over (partition by c_mktsegment order by r) as i, c_custkey as k from (select *, row_number() over () as r from customer)"),
    "A10_group_closure": (_groups_apply, "select c_nationkey, count(*) as n, max(c_acctbal) as top from customer group by 1"),
    "P2_closure": (_closure, "select c_custkey from customer where c_acctbal > 100*c_nationkey"),
    "P3_on_result": (_nested, "select o_orderkey from orders where o_totalprice > 100000 and o_totalprice/2 < 100000"),
    "P6_pair": (_pair_output, "select vec_id, i, embedding[i]::DOUBLE as v, embedding[i]::DOUBLE > 0.2 as m from embeddings, range(1, 65) r(i)"),
    "J3_composite": (_composite, "select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey and c_custkey % 5 = n_regionkey"),
    "J4_inner": (_many("drop"), _MANY.format("inner")),
    "J4_left": (_many("left"), _MANY.format("left")),
    "J4_right": (_many("right"), _MANY.format("right")),
    "J5_must_match": (_must_match, "select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey"),
    "J6_two_rows": (_two_rows, "select s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey and s_acctbal > 100*n_regionkey"),
    "J7_interval": (_interval, "select l_orderkey, l_linenumber, p_partkey from lineitem join part on l_extendedprice between p_retailprice - 1 and p_retailprice + 1"),
    "J11_asof": (_asof, "select p.event_id, coalesce((select max_by(v.event_id, v.ts) from events v where v.event_type = 'view' and v.user_id = p.user_id and v.ts <= p.ts), (select min_by(v.event_id, v.ts) from events v where v.event_type = 'view' and v.user_id = p.user_id)) as view_id from events p where p.event_type = 'purchase'"),
    "D2_slice": (_slice_update, "select vec_id, i, case when label % 2 <> 0 then embedding[i]::DOUBLE when i between 2 and 5 then 1.5 else greatest(embedding[i], 0)::DOUBLE end as v from embeddings, range(1, 65) r(i)"),
    "D3_masked": (_masked_update, "select vec_id, i, embedding[i]::DOUBLE as d, label > 0 and embedding[i]::DOUBLE > 0.1 as m from embeddings, range(1, 65) r(i)"),
    "P12_ordered_update": (_ordered_update, "select c_custkey, case when c_custkey in (select c_custkey from customer where c_nationkey = 3 order by c_acctbal desc, c_custkey limit 5) then 0 else c_acctbal end as c_acctbal from customer"),
    "P12_ordered_delete": (_ordered_delete, "select o_orderkey from orders where o_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F' order by o_totalprice, o_orderkey limit 100)"),
    "D7_insert_select": (_insert_rows, "select n_nationkey, n_name, n_regionkey from nation union all select n_nationkey + 100, n_name, n_regionkey from nation where n_regionkey = 1"),
    "W1_stored": (_stored, "select n_nationkey, n_name as name, n_regionkey + case when n_nationkey > 9 then 7 else 0 end as n_regionkey from nation where n_nationkey <> 24"),
    "W9_rows": (_rows_reference, "select o_orderkey as key, o_totalprice as price from orders where o_totalprice > 400000"),
    "M14_stokes": (_products, "select vec_id, (4*k + o)::INTEGER as i, case o when 0 then r1 + r4 when 1 then r1 - r4 when 2 then r2 + r3 else i2 - i3 end as re, case o when 0 then i1 + i4 when 1 then i1 - i4 when 2 then i2 + i3 else r3 - r2 end as im from (select vec_id, k, embedding[4*k + 1]::DOUBLE as r1, embedding[4*k + 2]::DOUBLE as r2, embedding[4*k + 3]::DOUBLE as r3, embedding[4*k + 4]::DOUBLE as r4, embedding[64 - 4*k]::DOUBLE as i1, embedding[63 - 4*k]::DOUBLE as i2, embedding[62 - 4*k]::DOUBLE as i3, embedding[61 - 4*k]::DOUBLE as i4 from embeddings, range(0, 16) t(k)), range(0, 4) u(o)"),
    "M7_wavelengths": (_wavelengths, "select l_orderkey, l_linenumber, l_quantity*10 * (1e9*((l_partkey % 4) % 3 + 1) / 299792458.0) as u, l_quantity*10 * ((1e9*((l_partkey % 4) % 3 + 1) + 3e6) / 299792458.0) as u4 from lineitem"),
    "W10_concatenation": (_concatenation, "select * from nation where n_regionkey < 2 or n_regionkey > 3"),
}
FUNCTIONS |= {name: (_cells(expression, table, key), sql) for name, (expression, table, key, sql) in CELLS.items()}
FUNCTIONS |= {name: (_selection(where), _LINES + sql) for name, (where, sql) in SELECTIONS.items()}
