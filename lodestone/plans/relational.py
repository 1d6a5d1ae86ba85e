"""Scans, predicates, joins, aggregates, windows, sorting, set operations and subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import stats as A
from ..operators import relations as R
from ..operators import windows as W
from .registry import Tables, query, sql

# --- scans and sinks -----------------------------------------------------
sql("scan", "select r_regionkey, r_name from region")
sql("values", "select * from (values (1, 'a'), (2, 'b'), (3, null)) as v(id, label)")
sql("scan_pruned", "select l_orderkey, l_quantity from lineitem where l_shipdate >= timestamp '1998-01-01 00:00:00' and l_quantity > 45")
query("series", "select range::bigint as value from range(5, -6, -2) union all select range::bigint from range(1, 1001)")(lambda t: R.series(t.spark, 5, -5, -2).union(R.series(t.spark, 1, 1000)).union(R.series(t.spark, 1, 5, -1)))
query("array_tvf", "select unnest([3, 1, 2])::bigint as value")(lambda t: t.spark.range(1).select(F.explode(F.array(*[F.lit(x).cast("long") for x in (3, 1, 2)])).alias("value")))


@query("catalog_introspection", "select 'orders' as tbl, column_name as name, (row_number() over (order by ordinal_position))::bigint as pos from (select unnest(['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority']) as column_name, unnest([1,2,3,4,5,6]) as ordinal_position)")
def catalog_introspection(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("orders", c, i) for i, c in enumerate(t.orders.columns, 1)], "tbl string, name string, pos long")


sql("attach", "select n.n_name, r.r_name from nation n join region r on n.n_regionkey = r.r_regionkey")


@query("sink", "select o_orderstatus, count(*) as n from orders where o_totalprice > 1000 group by 1")
def sink(t: Tables) -> DataFrame:
    """INSERT .. SELECT into a table and its count; the table lies in the shared folder."""
    at = t.spark.conf.get("spark.checkpoint.dir", None)
    o = t.orders.where("o_totalprice > 1000").select("o_orderkey", "o_orderstatus")
    if at:
        import uuid

        path = f"{at.rstrip('/')}/lodestone/sink-{uuid.uuid4().hex}"
        o.write.mode("append").parquet(path)
        o = t.spark.read.parquet(path)
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


# --- predicates and conditionals -----------------------------------------
sql("where_cmp", "select o_orderkey from orders where o_totalprice between 1000 and 90000 and o_orderstatus in ('O', 'F') and o_orderpriority not in ('5-LOW') and o_custkey is not null and o_custkey <> 7")
query("like", "select p_partkey from part where p_type ilike '%promo%'")(lambda t: t.part.where(S.sql_like(F.col("p_type"), "%Promo%")).select("p_partkey"))
query("like_escape", "select p_partkey from part where p_name ilike '%!_%' escape '!' or p_name ilike '%a%'")(lambda t: t.part.where(S.sql_like(F.col("p_name"), "%!_%", "!") | S.sql_like(F.col("p_name"), "%A%")).select("p_partkey"))
sql("case_sensitive_like", "select p_partkey from part where p_type like 'PROMO%'")
query("glob", "select c_custkey from customer where c_name glob '*[0-4]?'")(lambda t: t.customer.where(S.glob(F.col("c_name"), "*[0-4]?")).select("c_custkey"))
sql("is_distinct", "select count(*) as n from (select nullif(c_nationkey, 3) a, nullif(c_nationkey, 4) b from customer) x where a is distinct from b")
sql("alias", "select o_orderkey as k, o_totalprice * 2 as twice from orders")
sql("case", "select o_orderkey, case o_orderstatus when 'O' then 'open' when 'F' then 'done' else 'other' end as s, case when o_totalprice > 100000 then 'big' when o_totalprice > 10000 then 'mid' end as size from orders")
sql("iif", "select o_orderkey, if(o_totalprice > 50000, 1, 0) as big from orders")
sql("coalesce", "select o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'was O') as c, ifnull(nullif(o_custkey, 1), -1) as i from orders")
sql("nullif", "select count(nullif(o_orderstatus, 'O')) as n from orders")
_KIND = "case when p_partkey % 4 = 0 then {0} when p_partkey % 4 = 1 then {1} when p_partkey % 4 = 2 then {2} else {3} end"
query("typeof", f"select p_partkey, {_KIND.format(chr(39) + 'integer' + chr(39), chr(39) + 'real' + chr(39), chr(39) + 'text' + chr(39), chr(39) + 'null' + chr(39))} as k from part")(lambda t: t.part.select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.to_json(F.struct(F.col("p_size").cast("long").alias("v")))).when(F.col("p_partkey") % 4 == 1, F.to_json(F.struct((F.col("p_retailprice") + 0.123).alias("v")))).when(F.col("p_partkey") % 4 == 2, F.to_json(F.struct(F.col("p_name").alias("v")))).otherwise('{"v":null}').alias("j")).select("p_partkey", S.json_type(F.col("j"), "$.v").alias("k")))
sql("cast", "select p_partkey, try_cast(p_brand as int) as bad, cast(p_size as double) as d, cast(p_partkey as string) as s from part")
query("int_div", "select l_orderkey, l_linenumber, (l_orderkey // l_linenumber)::bigint as d from lineitem")(lambda t: t.lineitem.select("l_orderkey", "l_linenumber", S.int_div(F.col("l_orderkey"), F.col("l_linenumber")).alias("d")))
sql("generated_col", "select *, round(net * 2, 4) as twice from (select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem) x")

# --- joins ---------------------------------------------------------------
sql("inner_join", "select o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey")
sql("left_join", "select c.c_custkey, o.o_orderkey, n.n_name from customer c left join orders o on o.o_custkey = c.c_custkey and o.o_totalprice > 200000 left join nation n on n.n_nationkey = c.c_nationkey")
sql("right_join", "select n.n_name, s.s_suppkey from supplier s right join nation n on s.s_nationkey = n.n_nationkey")
sql("full_join", "select a.k as a, b.k as b from (select n_nationkey as k from nation where n_nationkey < 15) a full join (select n_nationkey as k from nation where n_nationkey > 5) b on a.k = b.k")
sql("cross_join", "select r_name, n_name from region cross join nation")
sql("using_join", "select k, a, b from (select n_nationkey as k, n_name as a from nation) x join (select c_nationkey as k, c_custkey as b from customer) y using (k)")
sql("self_join", "select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
sql("theta_join", "select a.n_nationkey as a, r.r_regionkey as b from nation a join region r on a.n_nationkey < r.r_regionkey * 4")
sql("semi_join", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 100000)")
sql("anti_join", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")

# --- aggregates ----------------------------------------------------------
sql("count_star", "select count(*) as n, count(nullif(o_orderstatus, 'O')) as c, count(distinct o_custkey) as d from orders")
sql("count_distinct", "select o_orderstatus, count(distinct o_custkey) as d from orders group by o_orderstatus")
sql("sum", "select round(sum(o_totalprice), 2) as s, cast(sum(o_custkey) as bigint) as k, sum(case when o_orderkey < 0 then o_totalprice end) as nothing from orders")
query("total", "select 0.0::double as nothing, round(sum(o_totalprice), 2) as s from orders")(lambda t: t.orders.agg(A.total(F.when(F.col("o_orderkey") < 0, F.col("o_totalprice"))).alias("nothing"), F.round(A.total(F.col("o_totalprice")), 2).alias("s")))
sql("avg_min_max", "select o_orderstatus, round(avg(o_totalprice), 4) as a, min(o_totalprice) as lo, max(o_totalprice) as hi from orders group by o_orderstatus")
query("group_concat", "select n_regionkey, string_agg(n_name, ';' order by n_name) as names from nation group by 1")(lambda t: t.nation.groupBy("n_regionkey").agg(F.expr("listagg(n_name, ';') within group (order by n_name)").alias("names")))
sql("agg_filter", "select o_orderstatus, count(*) filter (where o_totalprice > 50000) as big, count(*) as n from orders group by o_orderstatus")
sql("agg_distinct", "select cast(sum(distinct p_size) as bigint) as s from part")
sql("group_by", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus")
sql("having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12")
sql("distinct", "select distinct o_orderstatus, o_orderpriority from orders")
query("json_group_array", "select n_regionkey, to_json(list(n_nationkey order by n_nationkey))::varchar as a from nation group by 1")(lambda t: t.nation.groupBy("n_regionkey").agg(A.json_group_array(F.col("n_nationkey")).alias("a")))
query("json_group_object", "select n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' order by n_name) || '}' as o from nation group by 1")(lambda t: t.nation.groupBy("n_regionkey").agg(A.json_group_object(F.col("n_name"), F.col("n_nationkey")).alias("o")))
sql("variance", "select l_returnflag, round(var_pop(l_quantity), 6) as vp, round(var_samp(l_quantity), 6) as vs, round(stddev_pop(l_quantity), 6) as sp, round(stddev_samp(l_quantity), 6) as ss from lineitem group by l_returnflag")
query("skewness_pop", "with a as (select event_type, avg(value) as m, var_pop(value) as v from events group by 1) select e.event_type, round(avg(power(e.value - a.m, 3)) / power(any_value(a.v), 1.5), 5) as s from events e join a using (event_type) group by 1")(lambda t: t.events.groupBy("event_type").agg(F.round(A.skewness_pop(F.col("value")), 5).alias("s")))
query("skewness_samp", "select event_type, round(skewness(value), 5) as s from events group by 1")(lambda t: t.events.groupBy("event_type").agg(F.round(A.skewness_samp(F.col("value")), 5).alias("s")))
query("kurtosis_pop", "select event_type, round(kurtosis_pop(value), 4) as k from events group by 1")(lambda t: t.events.groupBy("event_type").agg(F.round(A.kurtosis_pop(F.col("value")), 4).alias("k")))
query("kurtosis_samp", "select event_type, round(kurtosis(value), 4) as k from events group by 1")(lambda t: t.events.groupBy("event_type").agg(F.round(A.kurtosis_samp(F.col("value")), 4).alias("k")))
sql("covar", "select l_returnflag, round(covar_pop(l_extendedprice, l_quantity), 3) as p, round(covar_samp(l_extendedprice, l_quantity), 3) as s from lineitem group by l_returnflag")
query("corr", "select l_returnflag, round(corr(l_extendedprice, l_quantity), 6) as c from lineitem group by 1")(lambda t: t.lineitem.groupBy("l_returnflag").agg(F.round(A.corr(F.col("l_extendedprice"), F.col("l_quantity")), 6).alias("c")))
sql("regr", "select l_returnflag, cast(regr_count(l_extendedprice, l_quantity) as bigint) as n, round(regr_avgx(l_extendedprice, l_quantity), 6) as ax, round(regr_avgy(l_extendedprice, l_quantity), 4) as ay, round(regr_sxx(l_extendedprice, l_quantity), 1) as sxx, round(regr_slope(l_extendedprice, l_quantity), 5) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as icept from lineitem group by l_returnflag")
query("regr_r2", "select l_returnflag, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem group by 1")(lambda t: t.lineitem.groupBy("l_returnflag").agg(F.round(A.regr_r2(F.col("l_extendedprice"), F.col("l_quantity")), 6).alias("r2")))
query("regr_json", "select l_returnflag, regr_count(l_extendedprice, l_quantity)::bigint as n, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 2) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2, round(regr_avgx(l_extendedprice, l_quantity), 6) as ax from lineitem group by 1")(lambda t: t.lineitem.groupBy("l_returnflag").agg(A.regr_json(F.col("l_extendedprice"), F.col("l_quantity")).alias("j")).select("l_returnflag", F.get_json_object("j", "$.count").cast("long").alias("n"), *[F.round(F.get_json_object("j", f"$.{k}").cast("double"), d).alias(n) for n, k, d in (("slope", "slope", 4), ("intercept", "intercept", 2), ("r2", "r2", 6), ("ax", "avgx", 6))]))
sql("median", "select event_type, round(median(value), 6) as m from events group by event_type")
query("percentile", "select event_type, round(quantile_cont(value, 0.9), 6) as p from events group by 1")(lambda t: t.events.groupBy("event_type").agg(F.round(F.percentile("value", 0.9), 6).alias("p")))
query("percentile_disc", "select event_type, list_sort(list(value))[floor(0.9 * (count(*) - 1))::int + 1] as p from events group by 1")(lambda t: t.events.groupBy("event_type").agg(A.percentile_disc(F.col("value"), 0.9).alias("p")))
query("percentile_array", "select event_type, round(quantile_cont(value, 0.25), 6) as a, round(quantile_cont(value, 0.75), 6) as b from events group by 1")(lambda t: t.events.groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("p")).select("event_type", F.round(F.col("p")[0], 6).alias("a"), F.round(F.col("p")[1], 6).alias("b")))
sql("every_some", "select o_custkey, bool_and(o_totalprice > 1000) as every_, bool_or(o_totalprice > 200000) as some_ from orders group by o_custkey")
query("mode", "select o_custkey, (select s from (select o_orderpriority as s, count(*) as n from orders i where i.o_custkey = o.o_custkey group by 1 order by n desc, s limit 1)) as m from (select distinct o_custkey from orders) o")(lambda t: t.orders.groupBy("o_custkey").agg(A.mode(F.col("o_orderpriority")).alias("m")))
query("decimal_sum", "select l_returnflag, trim(trailing '.' from trim(trailing '0' from sum(l_tax::decimal(28, 6))::varchar)) as s from lineitem group by 1")(lambda t: t.lineitem.groupBy("l_returnflag").agg(A.decimal_sum(F.col("l_tax")).alias("s")))
sql("rollup", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
sql("cube", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")

# --- windows -------------------------------------------------------------
_W = "partition by o_custkey order by o_orderdate, o_orderkey"
sql("row_number", f"select o_orderkey, cast(row_number() over ({_W}) as bigint) as rn from orders")
sql("rank", "select o_orderkey, cast(rank() over (partition by o_orderstatus order by o_orderpriority) as bigint) as r, cast(dense_rank() over (partition by o_orderstatus order by o_orderpriority) as bigint) as d from orders")
sql("percent_rank", "select o_orderkey, round(percent_rank() over (partition by o_orderstatus order by o_orderpriority), 8) as p, round(cume_dist() over (partition by o_orderstatus order by o_orderpriority), 8) as c from orders")
sql("ntile", "select o_orderkey, cast(ntile(4) over (partition by o_orderstatus order by o_orderkey) as bigint) as q from orders")
sql("lag_lead", f"select o_orderkey, lag(o_orderkey, 1, -1) over ({_W}) as before, lead(o_orderkey, 2, -1) over ({_W}) as after from orders")
sql("first_last_nth", f"select o_orderkey, first_value(o_orderkey) over ({_W}) as f, last_value(o_orderkey) over ({_W} rows between unbounded preceding and unbounded following) as l, nth_value(o_orderkey, 2) over ({_W} rows between unbounded preceding and unbounded following) as n from orders")
sql("agg_over", f"select o_orderkey, round(sum(o_totalprice) over ({_W} rows between unbounded preceding and current row), 2) as s from orders")
sql("rows_frame", f"select o_orderkey, round(avg(o_totalprice) over ({_W} rows between 1 preceding and 1 following), 4) as a from orders")
sql("range_frame", "select o_orderkey, count(*) over (partition by o_orderstatus order by o_custkey range between 5 preceding and current row) as n from orders")
query("groups_frame", "select o_orderkey, count(*) over (partition by o_orderstatus order by o_orderpriority groups between 1 preceding and current row) as n from orders")(lambda t: W.groups_frame(t.orders, ["o_orderstatus"], "o_orderpriority", 1, 0, F.count("*"), "n").select("o_orderkey", "n"))
query("exclude", f"select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following exclude current row), 2) as s from orders")(lambda t: t.orders.select("o_orderkey", F.round(W.sum_excluding_current(F.col("o_totalprice"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), 2).alias("s")))
query("filter_over", f"select o_orderkey, count(*) filter (where o_orderstatus = 'O') over ({_W}) as n from orders")(lambda t: t.orders.select("o_orderkey", W.filter_over(F.count, F.col("o_orderstatus") == "O", F.lit(1), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("n")))
sql("named_window", "select o_orderkey, cast(row_number() over w as bigint) as rn, count(*) over w as n from orders window w as (partition by o_custkey order by o_orderkey)")
sql("stats_over", f"select o_orderkey, round(stddev_pop(o_totalprice) over ({_W} rows between 3 preceding and current row), 3) as v from orders")
query("sliding_percentile", f"select o_orderkey, round(quantile_cont(o_totalprice, 0.5) over ({_W} rows between 4 preceding and current row), 4) as m from orders")(lambda t: t.orders.select("o_orderkey", F.round(W.sliding_percentile(F.col("o_totalprice"), 0.5, Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-4, 0)), 4).alias("m")))

# --- sorting -------------------------------------------------------------
sql("order_by", "select c_custkey, cast(row_number() over (order by nullif(c_mktsegment, 'BUILDING') desc nulls last, c_acctbal, c_custkey) as bigint) as place from customer order by place")
query("collate", "select p_partkey from part where lower(p_brand) = 'brand#11' or rtrim(p_type) = 'PROMO'")(lambda t: t.part.where((F.collate("p_brand", "UTF8_LCASE") == F.collate(F.lit("BRAND#11"), "UTF8_LCASE")) | (F.collate("p_type", "UTF8_BINARY_RTRIM") == F.collate(F.lit("PROMO  "), "UTF8_BINARY_RTRIM"))).select("p_partkey"))
query("nocase_accent", "select count(*) as n from documents where contains(strip_accents(lower(text)), 'eaux de')")(lambda t: t.documents.where(F.contains(F.collate("text", "UNICODE_CI_AI"), F.collate(F.lit("ÉAUX DÉ"), "UNICODE_CI_AI"))).agg(F.count("*").alias("n")))
sql("limit_offset", "select o_orderkey from orders order by o_orderkey limit 10 offset 5")
sql("topk", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")

# --- set operations, CTEs, subqueries, views ------------------------------
sql("union", "select c_nationkey as k from customer union select s_nationkey from supplier")
sql("union_all", "select c_nationkey as k from customer union all select s_nationkey from supplier")
sql("intersect", "select c_custkey as k from customer intersect select o_custkey from orders")
sql("except", "select c_custkey as k from customer except select o_custkey from orders")
sql("cte", "with a as (select o_custkey, sum(o_totalprice) as s from orders group by o_custkey), b as (select max(s) as m from a) select o_custkey, round(s, 2) as s from a, b where s > 0.8 * m")
sql("recursive_cte", "with recursive fib(n, a, b) as (select 1, cast(0 as bigint), cast(1 as bigint) union all select n + 1, b, a + b from fib where n < 40) select n, a from fib")
query("recursive_union", "with recursive d(id) as (select 5::bigint union select (id * 2) % 17 from d) select id from d")(lambda t: R.recursive_union(t.spark.range(1).select(F.lit(5).cast("long").alias("id")), lambda d: d.select((F.col("id") * 2 % 17).alias("id"))))
sql("scalar_subquery", "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) * 1.8 from orders)")
sql("correlated", "select o.o_orderkey from orders o where o.o_totalprice = (select max(i.o_totalprice) from orders i where i.o_custkey = o.o_custkey)")
sql("in_subquery", "select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1) and c_custkey not in (select o_custkey from orders)")


@query("view", "select region, count(*) as n from (select n_name as nation, r_name as region from nation join region on n_regionkey = r_regionkey) group by 1")
def view(t: Tables) -> DataFrame:
    v = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").toDF("nation", "region")
    v.createOrReplaceTempView("nation_regions")
    return t.spark.sql("select region, count(*) as n from nation_regions group by region")


# --- derived tables ------------------------------------------------------
@query("closure", "with recursive t(id, depth) as (select 1::bigint, 0::bigint union all select d.doc_id, t.depth + 1 from t join documents d on d.doc_id // 2 = t.id and d.doc_id > 1) select id, min(depth) as depth from t group by 1")
def closure(t: Tables) -> DataFrame:
    """Documents as a tree: the parent of n is n div 2."""
    e = t.documents.where("doc_id > 1").select(F.col("doc_id").alias("id"), F.expr("doc_id div 2").alias("parent"))
    return R.closure(e, t.spark.range(1, 2), "id", "parent").select("id", "depth")


@query("closure_graph", "with recursive t(id, depth) as (select 150::bigint, 0::bigint union all select id // 2, depth + 1 from t where id > 1 and depth < 3) select id, depth from t")
def closure_graph(t: Tables) -> DataFrame:
    e = t.documents.where("doc_id > 1").select(F.col("doc_id").alias("id"), F.expr("doc_id div 2").alias("parent"))
    return R.closure(e, t.spark.range(150, 151), "id", "parent", max_depth=3, reverse=True).select("id", "depth")


query("pivot", "select cast(ts as date) as day, count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'view') as view from events group by 1")(lambda t: R.pivot(t.events.withColumn("day", F.to_date("ts")), ["day"], "event_type", ["click", "view"], F.count(F.lit(1))).na.fill(0))


@query("statement", "select o_orderkey from orders where o_orderstatus = 'O' and o_totalprice > 150000")
def statement(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("orders")
    return R.statement(t.spark, "select o_orderkey from orders where o_orderstatus = :status and o_totalprice > :least", status="O", least=150000)


@query("eval", "select 'AFRICA,AMERICA,ASIA,EUROPE,MIDDLE EAST' as v")
def eval_(t: Tables) -> DataFrame:
    t.region.createOrReplaceTempView("region")
    return t.spark.createDataFrame([(R.eval_sql(t.spark, "select r_name from region order by r_name", ","),)], "v string")


@query("udtf", "select n_nationkey::bigint as k, unnest(range(0, n_regionkey + 1))::bigint as i from nation")
def udtf(t: Tables) -> DataFrame:
    """A table function in Python, one call per row."""

    @F.udtf(returnType="i: bigint")
    class Count:
        def eval(self, n: int):
            for i in range(n + 1):
                yield (i,)

    t.spark.udtf.register("count_to", Count)
    t.nation.createOrReplaceTempView("nation")
    return t.spark.sql("select cast(n_nationkey as bigint) as k, c.i from nation, lateral count_to(n_regionkey) c")


# --- changes -------------------------------------------------------------
_OLD, _NEW = "o_orderkey % 5 <> 0", "o_orderkey % 7 <> 0"


def _copies(t: Tables) -> tuple[DataFrame, DataFrame]:
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_custkey")
    return o.where(_OLD), o.where(_NEW).withColumn("o_custkey", F.when(F.col("o_orderkey") % 11 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))


_DIFF = f"(select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when a.o_orderkey is null then 'insert' when b.o_orderkey is null then 'delete' when a.o_custkey <> b.o_custkey then 'update' end as op from (select * from orders where {_OLD}) a full join (select o_orderkey, case when o_orderkey % 11 = 0 then o_custkey + 1 else o_custkey end as o_custkey from orders where {_NEW}) b on a.o_orderkey = b.o_orderkey)"


@query("changeset_diff", f"select op, o_orderkey from {_DIFF} where op is not null")
def changeset_diff(t: Tables) -> DataFrame:
    return R.diff(*_copies(t), ["o_orderkey"]).select("op", "o_orderkey")


@query("changeset_apply", f"select o_orderkey, o_orderstatus, case when o_orderkey % 11 = 0 then o_custkey + 1 else o_custkey end as o_custkey from orders where {_NEW}")
def changeset_apply(t: Tables) -> DataFrame:
    a, b = _copies(t)
    return R.apply_changes(a, R.diff(a, b, ["o_orderkey"]), ["o_orderkey"])


@query("changeset_invert", f"select o_orderkey, o_orderstatus, o_custkey from orders where {_OLD}")
def changeset_invert(t: Tables) -> DataFrame:
    a, b = _copies(t)
    return R.apply_changes(b, R.invert(R.diff(a, b, ["o_orderkey"])), ["o_orderkey"])


@query("upsert", f"select o_orderkey, case when {_OLD} and {_NEW} then o_custkey + 1000 when {_OLD} then o_custkey when o_orderkey % 11 = 0 then o_custkey + 1 else o_custkey end as o_custkey from orders where {_OLD} or {_NEW}")
def upsert(t: Tables) -> DataFrame:
    a, b = (x.drop("o_orderstatus") for x in _copies(t))
    return R.upsert(a, b, ["o_orderkey"], {"o_custkey": F.col("old.o_custkey") + 1000})


sql("returning", "select o_orderkey, o_totalprice * 2 as o_totalprice from orders where o_orderstatus = 'P'")
sql("delete", "select o_orderkey from orders where not (o_totalprice < 50000)")
sql("constraint_check", "select l_orderkey, l_linenumber from lineitem where l_quantity <= 0 union all select l_orderkey, l_linenumber from lineitem l where not exists (select 1 from orders where o_orderkey = l.l_orderkey)")
query("exclude_group", "select l_orderkey, l_linenumber, round(sum(l_quantity) over (partition by l_suppkey order by l_shipdate range between unbounded preceding and unbounded following exclude group), 2) as s from lineitem")(lambda t: W.sum_excluding(t.lineitem, "l_quantity", ["l_suppkey"], ["l_shipdate"], "group", "s").select("l_orderkey", "l_linenumber", F.round("s", 2).alias("s")))
query("exclude_ties", "select l_orderkey, l_linenumber, round(sum(l_quantity) over (partition by l_suppkey order by l_shipdate range between unbounded preceding and unbounded following exclude ties), 2) as s from lineitem")(lambda t: W.sum_excluding(t.lineitem, "l_quantity", ["l_suppkey"], ["l_shipdate"], "ties", "s").select("l_orderkey", "l_linenumber", F.round("s", 2).alias("s")))
sql("stats_over_more", f"select o_orderkey, regr_count(o_orderkey, o_totalprice) over w as v, round(case when count(*) over w > 1 then avg(o_totalprice) over w - min(o_totalprice) over w end, 5) as c, round(case when count(*) over w > 1 then regr_count(o_totalprice, o_orderkey) over w end, 4) as r from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between 3 preceding and current row)")
sql("like_escape_only", "select p_partkey from part where replace(p_name, 'a', '_') like '%!_%' escape '!'")


@query("upsert_where", f"select o_orderkey, case when {_OLD} and {_NEW} and o_orderkey % 11 = 0 then o_custkey + 1 when {_OLD} then o_custkey when o_orderkey % 11 = 0 then o_custkey + 1 else o_custkey end as o_custkey from orders where {_OLD} or {_NEW}")
def upsert_where(t: Tables) -> DataFrame:
    """On conflict the new value is taken only where it differs."""
    a, b = (x.drop("o_orderstatus") for x in _copies(t))
    return R.upsert(a, b, ["o_orderkey"], {"o_custkey": F.col("new.o_custkey")}, F.col("new.o_custkey") != F.col("old.o_custkey"))


@query("insert_or_ignore", f"select o_orderkey, case when {_OLD} then o_custkey when o_orderkey % 11 = 0 then o_custkey + 1 else o_custkey end as o_custkey from orders where {_OLD} or {_NEW}")
def insert_or_ignore(t: Tables) -> DataFrame:
    """ON CONFLICT DO NOTHING."""
    a, b = (x.drop("o_orderstatus") for x in _copies(t))
    return R.upsert(a, b, ["o_orderkey"], None)


@query("changeset_concat", f"select op, o_orderkey from (select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when a.o_orderkey is null then 'insert' when b.o_orderkey is null then 'delete' when a.o_custkey <> b.o_custkey then 'update' end as op from (select o_orderkey, o_custkey from orders where {_OLD}) a full join (select o_orderkey, case when o_orderkey % 11 = 0 then o_custkey + 1 else o_custkey end as o_custkey from orders where {_NEW} and o_orderkey % 13 <> 0) b on a.o_orderkey = b.o_orderkey) where op is not null")
def changeset_concat(t: Tables) -> DataFrame:
    """Two change sets in turn as one: to a second state, and from it to one with fewer rows."""
    a, b = _copies(t)
    c = b.where("o_orderkey % 13 <> 0")
    both = R.concat_changes(R.diff(a, b, ["o_orderkey"]), R.diff(b, c, ["o_orderkey"]), ["o_orderkey"])
    return both.select("op", "o_orderkey")


@query("view_on_view", "select region, n from (select r_name as region, count(*) as n from nation join region on n_regionkey = r_regionkey group by 1) where n > 4")
def view_on_view(t: Tables) -> DataFrame:
    """A view with a column list over another view; the first is dropped when the second has been read."""
    t.nation.createOrReplaceTempView("nation")
    t.region.createOrReplaceTempView("region")
    t.spark.sql("create or replace temporary view nations_by_region (region, n) as select r_name, count(*) from nation join region on n_regionkey = r_regionkey group by r_name")
    t.spark.sql("create or replace temporary view large_regions as select region, n from nations_by_region where n > 4")
    out = t.spark.sql("select region, n from large_regions")
    t.spark.sql("drop view nations_by_region")
    return out


sql("constraint_unique", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 1 union all select null, count(*) from orders where o_orderkey is null")
sql("update", "select o_orderkey, case when o_orderstatus = 'P' then o_totalprice * 2 else o_totalprice end as o_totalprice from orders")
query("stats_var_over", "select l_orderkey, l_linenumber, round(var_pop(l_quantity) over w, 4) as v, round(kurtosis_pop(l_quantity) over w, 3) as k from lineitem window w as (partition by l_suppkey)")(lambda t: t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.var_pop("l_quantity").over(Window.partitionBy("l_suppkey")), 4).alias("v"), F.round(F.kurtosis("l_quantity").over(Window.partitionBy("l_suppkey")), 3).alias("k")))
