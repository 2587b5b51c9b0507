"""Registered queries of the engine, each over whole tables, with the same results as SQL where SQL has them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import more_queries
from . import operators as ops
from .plans.commands import execute
from .table import Table

Query = Callable[[SparkSession, str], DataFrame]


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[Table]:
    return [Table.read(spark, f"{sf_dir}/{n}.parquet") for n in names]


def _command(text: str, *names: str) -> Query:
    return lambda spark, sf_dir: execute(text, *_tables(spark, sf_dir, *names)).data()


#: name: (command, tables, the same in SQL)
_COMMANDS: dict[str, tuple[str, tuple[str, ...], str]] = {
    "A0_pricing": (
        "SELECT l_returnflag, gcount() AS n, gsum(l_extendedprice*(1-l_discount)) AS rev FROM $1 WHERE l_quantity BETWEEN 10 AND 40 GROUP BY l_returnflag HAVING gcount() > 10 ORDER BY rev DESC",
        ("lineitem",),
        "select l_returnflag, count(*) as n, sum(l_extendedprice*(1-l_discount)) as rev from lineitem where l_quantity between 10 and 40 group by 1 having count(*) > 10",
    ),
    "P1_filter": ("SELECT l_orderkey, l_linenumber FROM $1 WHERE l_quantity > 45 AND l_returnflag == 'R'", ("lineitem",), "select l_orderkey, l_linenumber from lineitem where l_quantity > 45 and l_returnflag = 'R'"),
    "P5_computed": ("SELECT l_orderkey, l_extendedprice*(1-l_discount) AS net FROM $1", ("lineitem",), "select l_orderkey, l_extendedprice*(1-l_discount) as net from lineitem"),
    "P8_names": ("SELECT p_partkey, p_size*2 FROM $1", ("part",), "select p_partkey, (p_size*2)::BIGINT as Col_2 from part"),
    "P10_topk": ("SELECT o_orderkey, o_totalprice FROM $1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", ("orders",), "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25"),
    "P13_offset": ("SELECT o_orderkey FROM $1 ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 5", ("orders",), "select o_orderkey from orders order by o_totalprice, o_orderkey limit 10 offset 5"),
    "P14_range": ("SELECT o_orderkey FROM $1 ORDER BY o_totalprice, o_orderkey LIMIT 2:20:3", ("orders",), "select o_orderkey from (select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) - 1 as i from orders) where i >= 2 and i < 20 and (i-2) % 3 = 0"),
    "P16_distinct": ("SELECT DISTINCT l_returnflag, l_linestatus FROM $1", ("lineitem",), "select distinct l_returnflag, l_linestatus from lineitem"),
    "P17_rownumber": ("SELECT rownumber() AS r, rowid() AS i, n_name FROM $1", ("nation",), "select row_number() over () as r, row_number() over () - 1 as i, n_name from nation"),
    "E4_compare": ("SELECT o_orderkey FROM $1 WHERE o_orderpriority != '1-URGENT' && !(o_totalprice <= 100000)", ("orders",), "select o_orderkey from orders where o_orderpriority <> '1-URGENT' and not (o_totalprice <= 100000)"),
    "E5_approximate": ("SELECT l_orderkey, l_linenumber FROM $1 WHERE l_extendedprice/l_quantity ~= 1000.0 OR nearabs(l_tax, 0.05, 0.001)", ("lineitem",), "select l_orderkey, l_linenumber from lineitem where abs(l_extendedprice/l_quantity - 1000) <= 1e-5*greatest(abs(l_extendedprice/l_quantity), 1000) or abs(l_tax - 0.05) <= 0.001"),
    "E7_lattice": ("SELECT l_orderkey FROM $1 WHERE l_linenumber IN [1:7:3]", ("lineitem",), "select l_orderkey from lineitem where l_linenumber in (1,4,7)"),
    "E7_in": ("SELECT l_orderkey, l_linenumber FROM $1 WHERE l_returnflag IN ['A','N'] AND l_quantity NOT IN [1:10, 20, 30]", ("lineitem",), "select l_orderkey, l_linenumber from lineitem where l_returnflag in ('A','N') and not (l_quantity in (1,2,3,4,5,6,7,8,9,10,20,30))"),
    "E8_between": ("SELECT l_orderkey FROM $1 WHERE l_discount BETWEEN 0.02 AND 0.04", ("lineitem",), "select l_orderkey from lineitem where l_discount between 0.02 and 0.04"),
    "E9_like": ("SELECT p_partkey FROM $1 WHERE p_name LIKE 'small%'", ("part",), r"select p_partkey from part where regexp_matches(p_name, '^small[^\n]*$')"),
    "E9_ilike": ("SELECT c_custkey FROM $1 WHERE c_mktsegment ILIKE 'b_il%' OR c_name NOT LIKE '%1%'", ("customer",), "select c_custkey from customer where c_mktsegment ilike 'b_il%' or c_name not like '%1%'"),
    "E10_glob": ("SELECT p_partkey FROM $1 WHERE p_brand ~ p/Brand#1{3,4}*/", ("part",), "select p_partkey from part where regexp_matches(p_brand, '^Brand#1[34].*$')"),
    "E11_pattern": ("SELECT p_partkey FROM $1 WHERE p_brand == pattern('Brand#?2') OR p_name == sqlpattern('%r_d%')", ("part",), "select p_partkey from part where regexp_matches(p_brand, '^Brand#.2$') or p_name like '%r_d%'"),
    "E12_floormod": ("SELECT p_partkey, (p_size-20) % 7 AS m, (p_size-20) // 7 AS d FROM $1", ("part",), "select p_partkey, ((p_size-20) - 7*floor((p_size-20)/7.0))::BIGINT as m, floor((p_size-20)/7.0)::DOUBLE as d from part"),
    "E12_divide": ("SELECT p_partkey, p_retailprice/(p_size-20) AS x, p_size**2 AS y, p_name+'/'+p_brand AS z FROM $1", ("part",), "select p_partkey, case when p_size = 20 then 'inf'::DOUBLE else p_retailprice/(p_size-20) end as x, (p_size*p_size)::BIGINT as y, p_name||'/'||p_brand as z from part"),
    "E13_bits": ("SELECT p_partkey, p_size & 6 AS a, p_size | 9 AS o, p_size ^ 3 AS x, ~p_size AS n FROM $1", ("part",), "select p_partkey, (p_size & 6)::BIGINT as a, (p_size | 9)::BIGINT as o, xor(p_size, 3)::BIGINT as x, (~p_size)::BIGINT as n from part"),
    "E14_slice": ("SELECT vec_id, sum(embedding[2:4]) AS s, embedding[-1] AS z, embedding[end] AS e FROM $1", ("embeddings",), "select vec_id, embedding[2]::DOUBLE + embedding[3]::DOUBLE + embedding[4]::DOUBLE as s, embedding[len(embedding)-1]::DOUBLE as z, embedding[len(embedding)]::DOUBLE as e from embeddings"),
    "E15_mask": ("SELECT vec_id, nelements(embedding) AS n, max(embedding[embedding > 0.1]) AS m FROM $1", ("embeddings",), "select vec_id, len(embedding) as n, list_max(list_filter(embedding, lambda x: not (x::DOUBLE > 0.1)))::DOUBLE as m from embeddings"),
    "E17_iif": ("SELECT c_custkey, iif(c_acctbal < 0, 0, c_acctbal) AS v FROM $1", ("customer",), "select c_custkey, case when c_acctbal < 0 then 0.0::DOUBLE else c_acctbal end as v from customer"),
    "F1_math": ("SELECT p_partkey, sqrt(p_retailprice) AS s, abs(p_size-25) AS a, square(p_size) AS q, cube(p_size) AS c, round(1e6*log10(p_retailprice)) AS l, round(1e6*exp(p_size/50)) AS e FROM $1", ("part",), "select p_partkey, sqrt(p_retailprice) as s, abs(p_size-25)::BIGINT as a, (p_size*p_size)::BIGINT as q, (p_size*p_size*p_size)::BIGINT as c, floor(1e6*log10(p_retailprice)+0.5) as l, floor(1e6*exp(p_size/50.0)+0.5) as e from part"),
    "F3_round": ("SELECT l_orderkey, l_linenumber, round(l_extendedprice/1000) AS r, floor(l_quantity/7) AS f, ceil(l_tax*100) AS c, int(l_extendedprice) AS i, sign(l_quantity-25) AS s FROM $1", ("lineitem",), "select l_orderkey, l_linenumber, floor(l_extendedprice/1000+0.5) as r, floor(l_quantity/7) as f, ceil(l_tax*100) as c, trunc(l_extendedprice)::BIGINT as i, sign(l_quantity-25)::DOUBLE as s from lineitem"),
    "F4_complex": ("SELECT p_partkey, real(complex(p_size, 2)*complex(1, p_size)) AS r, imag(conj(complex(p_size, 2))) AS i, norm(complex(p_size, 3)) AS n FROM $1", ("part",), "select p_partkey, (p_size - 2*p_size)::DOUBLE as r, -2.0::DOUBLE as i, (p_size*p_size + 9)::DOUBLE as n from part"),
    "F6_minmax": ("SELECT l_orderkey, l_linenumber, min(l_quantity, 10) AS a, max(l_linenumber, 3) AS b FROM $1", ("lineitem",), "select l_orderkey, l_linenumber, least(l_quantity, 10) as a, greatest(l_linenumber, 3)::BIGINT as b from lineitem"),
    "F8_cell": ("SELECT vec_id, max(embedding) AS m, min(embedding) AS n, ntrue(embedding > 0) AS p, any(embedding > 0.4) AS a, all(embedding < 0.5) AS l FROM $1", ("embeddings",), "select vec_id, list_max(embedding)::DOUBLE as m, list_min(embedding)::DOUBLE as n, len(list_filter(embedding, lambda x: x > 0)) as p, len(list_filter(embedding, lambda x: x::DOUBLE > 0.4)) > 0 as a, len(list_filter(embedding, lambda x: not (x::DOUBLE < 0.5))) = 0 as l from embeddings"),
    "F9_median": ("SELECT vec_id, median(embedding) AS m, fractile(embedding, 0.25) AS q FROM $1", ("embeddings",), "select vec_id, (list_sort(embedding)[32]::DOUBLE + list_sort(embedding)[33]::DOUBLE)/2 as m, list_sort(embedding)[16]::DOUBLE as q from embeddings"),
    "F15_running": ("SELECT vec_id, runningmax(embedding, 2)[3] AS a, runningmax(embedding, 2)[1] AS e, boxedmin(embedding, 10)[7] AS b FROM $1", ("embeddings",), "select vec_id, list_max(embedding[1:5])::DOUBLE as a, 0.0::DOUBLE as e, list_min(embedding[61:64])::DOUBLE as b from embeddings"),
    "F18_strlength": ("SELECT doc_id, strlength(text) AS n FROM $1", ("documents",), "select doc_id, strlen(text) as n from documents"),
    "F19_case": ("SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, capitalize(p_type) AS c, sreverse(p_name) AS r, trim(' '+p_name+'\t ') AS t FROM $1", ("part",), "select p_partkey, upper(p_name) as u, lower(p_brand) as l, array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as c, reverse(p_name) as r, p_name as t from part"),
    "F22_substr": ("SELECT c_custkey, substr(c_name, 0, 8) AS s, substr(c_name, -3) AS e, replace(c_name, '0', 'o') AS r FROM $1", ("customer",), "select c_custkey, substring(c_name, 1, 8) as s, right(c_name, 3) as e, replace(c_name, '0', 'o') as r from customer"),
    "F23_convert": ("SELECT p_partkey, bool(p_size-20) AS b, string(p_size) AS s, string(p_size > 20) AS t FROM $1", ("part",), "select p_partkey, p_size <> 20 as b, p_size::VARCHAR as s, case when p_size > 20 then 'True ' else 'False' end as t from part"),
    "F26_dates": ("SELECT o_orderkey, mjd(o_orderdate) AS m, date(o_orderdate) AS d FROM $1 WHERE o_orderdate >= 1995-01-01", ("orders",), "select o_orderkey, epoch_us(o_orderdate)/86400e6 + 40587 as m, floor(epoch_us(o_orderdate)/86400e6 + 40587) as d from orders where o_orderdate >= timestamp '1995-01-01'"),
    "F27_year": ("SELECT year(o_orderdate) AS y, gcount() AS n FROM $1 GROUP BY year(o_orderdate)", ("orders",), "select year(o_orderdate) as y, count(*) as n from orders group by 1"),
    "F27_parts": ("SELECT o_orderkey, month(o_orderdate) AS m, day(o_orderdate) AS d, weekday(o_orderdate) AS w, cdate(o_orderdate) AS c FROM $1", ("orders",), "select o_orderkey, month(o_orderdate) as m, day(o_orderdate) as d, isodow(o_orderdate) as w, strftime(o_orderdate, '%d-%b-%Y') as c from orders"),
    "F30_angdist": ("SELECT n_nationkey, round(1e9*angdist(n_nationkey/10, 0.1, 0.2, n_regionkey/10)) AS a FROM $1", ("nation",), "select n_nationkey, floor(0.5 + 1e9*atan2(sqrt(power(cos(b)*sin(0.2-l),2) + power(cos(0.1)*sin(b)-sin(0.1)*cos(b)*cos(0.2-l),2)), sin(0.1)*sin(b)+cos(0.1)*cos(b)*cos(0.2-l))) as a from (select n_nationkey, n_nationkey/10 as l, n_regionkey/10 as b from nation)"),
    "X5_doppler": ("SELECT p_partkey, meas.doppler('optical', p_size/100, 'radio') AS z FROM $1", ("part",), "select p_partkey, 1/(1 - p_size/100) - 1 as z from part"),
    "A1_groupby": ("SELECT l_returnflag, gcount() AS n, gsum(l_quantity) AS q FROM $1 GROUP BY l_returnflag", ("lineitem",), "select l_returnflag, count(*) as n, sum(l_quantity) as q from lineitem group by 1"),
    "A2_whole": ("SELECT gcount() AS n, gmin(l_extendedprice) AS a, gmax(l_extendedprice) AS b FROM $1", ("lineitem",), "select count(*) as n, min(l_extendedprice) as a, max(l_extendedprice) as b from lineitem"),
    "A3_expression": ("SELECT l_linenumber % 3 AS k, gcount() AS n FROM $1 GROUP BY l_linenumber % 3", ("lineitem",), "select (l_linenumber % 3)::BIGINT as k, count(*) as n from lineitem group by 1"),
    "A4_having": ("SELECT l_suppkey, gmean(l_quantity) AS m FROM $1 GROUP BY l_suppkey HAVING gmean(l_quantity) > 25", ("lineitem",), "select l_suppkey, avg(l_quantity) as m from lineitem group by 1 having avg(l_quantity) > 25"),
    "A6_rollup": ("SELECT l_returnflag, l_linestatus, gsum(l_quantity) AS q FROM $1 GROUP BY ROLLUP(l_returnflag, l_linestatus)", ("lineitem",), "select l_returnflag, l_linestatus, sum(l_quantity) as q from lineitem group by rollup(l_returnflag, l_linestatus)"),
    "A7_cube": ("SELECT l_returnflag, l_linestatus, gcount() AS n FROM $1 GROUP BY CUBE(l_returnflag, l_linestatus)", ("lineitem",), "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube(l_returnflag, l_linestatus)"),
    "A8_sets": ("SELECT l_returnflag, l_linestatus, gcount() AS n, grouping(l_linestatus) AS g FROM $1 GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", ("lineitem",), "select l_returnflag, l_linestatus, count(*) as n, grouping(l_linestatus) = 1 as g from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())"),
    "A12_last": ("SELECT c_nationkey, c_name, gfirst(c_custkey) AS f, glast(c_custkey) AS l FROM $1 GROUP BY c_nationkey", ("customer",), "select c_nationkey, max_by(c_name, c_custkey) as c_name, min(c_custkey) as f, max(c_custkey) as l from customer group by 1"),
    "A16_gmedian": ("SELECT l_returnflag, gmedian(l_quantity) AS m, gfractile(l_quantity, 0.25) AS q FROM $1 GROUP BY l_returnflag", ("lineitem",), "select l_returnflag, quantile_disc(l_quantity, 0.5) as m, quantile_disc(l_quantity, 0.25) as q from lineitem group by 1"),
    "A18_bool": ("SELECT l_returnflag, gany(l_discount > 0.09) AS a, gall(l_tax >= 0) AS b, gntrue(l_discount > 0.05) AS n FROM $1 GROUP BY l_returnflag", ("lineitem",), "select l_returnflag, bool_or(l_discount > 0.09) as a, bool_and(l_tax >= 0) as b, count(*) filter (where l_discount > 0.05) as n from lineitem group by 1"),
    "A23_ghist": ("SELECT ghist(l_quantity,5,0,50)[1] AS b0, ghist(l_quantity,5,0,50)[2] AS b1, ghist(l_quantity,5,0,50)[7] AS b6 FROM $1 GROUP BY l_linestatus == 'x'", ("lineitem",), "select count(*) filter (where l_quantity < 0) as b0, count(*) filter (where l_quantity >= 0 and l_quantity < 10) as b1, count(*) filter (where l_quantity >= 50) as b6 from lineitem"),
    "J8_sentinel": ("SELECT d.doc_id, l.quality AS q FROM $1 d JOIN $2 l ON d.doc_id == l.doc_id", ("documents", "labels"), "select d.doc_id, coalesce(cast(quality as bigint), 9223372036854775807) as q from documents d left join labels l on d.doc_id = l.doc_id"),
    "J8_chain": ("SELECT c.c_custkey, n.n_name, r.r_name FROM $1 c JOIN $2 n ON c.c_nationkey == n.n_nationkey JOIN $3 r ON n.n_regionkey == r.r_regionkey WHERE r.r_regionkey > 1", ("customer", "nation", "region"), "select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_regionkey > 1"),
    "Q2_in": ("SELECT o_orderkey FROM $1 WHERE o_custkey IN (SELECT c_custkey FROM $2 WHERE c_acctbal > 5000)", ("orders", "customer"), "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 5000)"),
    "Q5_from": ("SELECT k, gmax(price) AS m FROM (SELECT o_custkey % 10 AS k, o_totalprice AS price FROM $1 WHERE o_orderstatus != 'F') GROUP BY k", ("orders",), "select (o_custkey % 10) as k, max(o_totalprice) as m from orders where o_orderstatus <> 'F' group by 1"),
}


def _j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = _tables(spark, sf_dir, "customer", "nation")
    return ops.join(c, n, "c_nationkey", leftcols=["c_custkey"], rightcols=["n_name"]).data()


def _j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _tables(spark, sf_dir, "orders", "customer")
    return ops.join(o, c, ("o_custkey", "c_custkey"), leftcols=["o_orderkey"], rightcols=["c_name"], unmatched="drop").data()


def _j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = _tables(spark, sf_dir, "documents", "labels")
    return ops.join(d, l, [("doc_id", "doc_id")], leftcols={"d": "doc_id"}, rightcols={"l": "doc_id", "quality": "quality"}, multi=True, unmatched="full").data()


def _j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, p = _tables(spark, sf_dir, "lineitem", "part")
    sizes = ops.query(p, select=["p_partkey", ("lo", "p_size"), ("hi", "p_size+1")])
    return ops.join(l, sizes, "L.l_quantity BETWEEN R.lo AND R.hi", leftcols=["l_orderkey", "l_linenumber"], rightcols=["p_partkey"], multi=True, unmatched="drop").data()


def _d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    (c,) = _tables(spark, sf_dir, "customer")
    return ops.update(c, [("c_acctbal", "c_acctbal/2"), ("c_acctbal", "iif(c_acctbal < 0, 0, c_acctbal)")], "c_nationkey < 10")[0].data().select("c_custkey", "c_acctbal")


def _d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = _tables(spark, sf_dir, "lineitem")
    return ops.delete(l, "l_tax > 0.05")[0].data().select("l_orderkey", "l_linenumber")


def _d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    (n,) = _tables(spark, sf_dir, "nation")
    return ops.insert(n, [{"n_nationkey": "100", "n_name": "'NEW'"}]).data()


def _q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    (n,) = _tables(spark, sf_dir, "nation")
    return ops.concat(ops.query(n, "n_regionkey == 0"), ops.query(n, "n_regionkey == 1")).data().select("n_nationkey", "n_name")


def _a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    (l,) = _tables(spark, sf_dir, "lineitem")
    out = ops.groupby(l, ["l_returnflag"], select=["l_returnflag", ("vp", "gvariance(l_quantity)"), ("vs", "gsamplevariance(l_quantity)"), ("r", "grms(l_quantity)")]).data()
    return out.select("l_returnflag", *(F.round(c, 6).alias(c) for c in ("vp", "vs", "r")))


def _a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    (e,) = _tables(spark, sf_dir, "embeddings")
    out = ops.groupby(e, ["label"], select=["label", ("m", "gmaxs(embedding)")]).data()
    return out.select("label", F.posexplode("m").alias("i", "m")).withColumn("i", (F.col("i") + 1).cast("bigint"))


_MORE: dict[str, tuple[Query, str]] = {
    "J1_index": (_j1, "select c_custkey, n_name from customer join (select *, row_number() over () - 1 as rid from nation) n on c_nationkey = n.rid"),
    "J2_equal": (_j2, "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey"),
    "J4_full": (_j4, "select d.doc_id as d, l.doc_id as l, quality from documents d full join labels l on d.doc_id = l.doc_id"),
    "D1_update": (_d1, "select c_custkey, case when c_nationkey < 10 then greatest(c_acctbal/2, 0) else c_acctbal end as c_acctbal from customer"),
    "D6_delete": (_d6, "select l_orderkey, l_linenumber from lineitem where not (l_tax > 0.05)"),
    "D7_insert": (_d7, "select n_nationkey, n_name, n_regionkey from nation union all select 100, 'NEW', 0"),
    "Q1_concat": (_q1, "select n_nationkey, n_name from nation where n_regionkey = 0 union all select n_nationkey, n_name from nation where n_regionkey = 1"),
    "A17_gvariance": (_a17, "select l_returnflag, round(var_pop(l_quantity), 6) as vp, round(var_samp(l_quantity), 6) as vs, round(sqrt(avg(l_quantity*l_quantity)), 6) as r from lineitem group by 1"),
    "A20_gmaxs": (_a20, "select label, i, max(embedding[i])::DOUBLE as m from embeddings, range(1, 65) r(i) group by 1, 2"),
}

_COMMANDS |= more_queries.COMMANDS
_MORE |= more_queries.FUNCTIONS

QUERIES: dict[str, Query] = {k: _command(text, *names) for k, (text, names, _) in _COMMANDS.items()} | {k: q for k, (q, _) in _MORE.items()}
#: Millions of rows at sf0.01, too many to compare by SQL: the tests hold it against a nested loop.
QUERIES["J7_range"] = _j7
ORACLES: dict[str, str] = {k: sql for k, (_, _, sql) in _COMMANDS.items()} | {k: sql for k, (_, sql) in _MORE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pricing summary."""
    return QUERIES["A0_pricing"](spark, sf_dir)
