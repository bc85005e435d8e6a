"""The engine's queries on the driver's tables, each with SQL that another engine can run.

The tables lack a date dimension, line orders, part categories and cities. The star queries derive them: a line
order is a line item with its order; d_year comes from the order's date, and predicates on years, months and weeks
are ranges of it, which reach the scan; a category is the
part's type, a manufacturer the first character of the brand's number; a city is the nation and the last digit
of the key; revenue is price after discount and supply cost six tenths of the price.
TPC-H queries drop what the tables lack (ship mode and instruction, containers, commit and receipt dates, part
suppliers) and take literals from the data's ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import extract, int_div, or_identity, shift
from ..operators import clustering, monoids, nested, relational
from ..session import table
from .builder import Rel
from .sqlfront import SqlFront

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Registers a query that is built with the DataFrame API, and SQL for the same result."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def from_sql(name: str, sql: str, oracle: str | None = None, dealt: str | None = None) -> None:
    """Registers a query in SQL; the views it names are the driver's tables. {tasks} in it is the number of tasks for the rows of the table dealt."""
    from ..session import TABLES, register

    used = tuple(t for t in TABLES if t in sql)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, used)
        # The tables' times have no zone; a literal with one would need a cast of the column, which no scan can use.
        text = sql.replace("timestamp '", "timestamp_ntz '")
        return SqlFront(spark).sql(text.replace("{tasks}", str(relational.tasks_for(table(spark, sf_dir, dealt)))) if dealt else text)

    QUERIES[name], ORACLE[name] = run, oracle or sql


def _r(column, digits: int = 2):
    return F.round(column, digits)


# Scan, project, filter


@query("select o_orderkey, o_totalprice, o_orderpriority from orders")
def scan_project(spark, d):
    return Rel.scan(table(spark, d, "orders")).project("o_orderkey", "o_totalprice", "o_orderpriority").df


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 45 and l_discount <= 0.02 and l_shipdate >= timestamp '1997-01-01'")
def filter_cmp(spark, d):
    return table(spark, d, "lineitem").filter("l_quantity > 45 and l_discount <= 0.02 and l_shipdate >= timestamp_ntz '1997-01-01'").select("l_orderkey", "l_linenumber", "l_quantity")


@query("select p_partkey, p_size, p_type from part where p_size between 5 and 15 and p_type in ('PROMO', 'LARGE')")
def filter_between_in(spark, d):
    return table(spark, d, "part").filter(F.col("p_size").between(5, 15) & F.col("p_type").isin("PROMO", "LARGE")).select("p_partkey", "p_size", "p_type")


from_sql("filter_or_and", "select o_orderkey, o_orderstatus, o_totalprice from orders where (o_orderstatus = 'F' and o_totalprice > 200000) or (o_orderstatus = 'O' and o_totalprice < 20000)")
from_sql("filter_null_test", "select event_id, nullif(event_type, 'view') as kind from events where nullif(event_type, 'view') is not null and not (nullif(event_type, 'click') is null)")


@query("select * from (values (1, 'a', 1.5), (2, 'b', 2.5), (3, null, null)) as v(k, s, x)")
def values_scan(spark, d):
    return Rel.values(spark, [(1, "a", 1.5), (2, "b", 2.5), (3, None, None)], "k int, s string, x double").df


ORACLE["values_scan"] = "select k::int as k, s, x::double as x from (values (1, 'a', 1.5), (2, 'b', 2.5), (3, null, null)) as v(k, s, x)"
from_sql("count_star", "select count(*) as n from lineitem")
from_sql("constant_select", "select 1 + 1 as two, 'x' as s")


@query("select distinct p_type from part where regexp_full_match(p_type, '(S|P).*')")
def dictionary_scan(spark, d):
    return relational.dictionary_scan(table(spark, d, "part"), "p_type", "(S|P).*")


# Scalars


@query("select o_orderkey, (o_custkey // 7)::bigint as q, (-o_custkey % 7)::bigint as m, (-o_custkey // 7)::bigint as nq, case when o_custkey % 3 = 0 then null else (o_orderkey // (o_custkey % 3))::bigint end as z from orders")
def arith_int_div_mod(spark, d):
    key = F.col("o_custkey")
    return table(spark, d, "orders").select("o_orderkey", int_div(key, F.lit(7)).alias("q"), (-key % 7).alias("m"), int_div(-key, F.lit(7)).alias("nq"), int_div(F.col("o_orderkey"), key % 3).alias("z"))


from_sql("arith_float", "select l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) as charge, l_extendedprice / l_quantity as unit from lineitem")
from_sql("case_when", "select o_orderkey, case when o_totalprice > 200000 then 'high' when o_totalprice > 100000 then 'mid' else 'low' end as band from orders")
from_sql("cast_numeric", "select l_orderkey, l_linenumber, cast(l_quantity as int) as q, cast(l_linenumber as double) as f, cast(l_orderkey as int) as k from lineitem")
_UNITS = ("year", "quarter", "month", "day", "hour", "minute", "second", "doy", "week", "isodow")


@query("select event_id, " + ", ".join(f"extract({u} from ts)::int as {u}_" for u in _UNITS) + ", (extract(dow from ts) + 1)::int as dow_ from events")
def extract_calendar(spark, d):
    return table(spark, d, "events").select("event_id", *[extract(u, F.col("ts")).alias(f"{u}_") for u in (*_UNITS, "dow")])


@query("select o_orderkey, extract(decade from o_orderdate)::int as decade_, extract(century from o_orderdate)::int as century_, extract(millennium from o_orderdate)::int as millennium_, (extract(millisecond from o_orderdate)::int % 1000)::int as millisecond_ from orders")
def extract_decade_century(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *[extract(u, F.col("o_orderdate")).alias(f"{u}_") for u in ("decade", "century", "millennium", "millisecond")])


from_sql("date_interval", "select count(*) as n from lineitem where l_shipdate >= timestamp '1996-01-01' + interval '1' year and l_shipdate < timestamp '1998-03-31' - interval '3' month")


@query("select l_orderkey, l_linenumber, (l_orderkey << 3)::bigint as sl, (-l_orderkey >> 2)::bigint as sr, xor(l_orderkey, l_partkey)::bigint as x from lineitem")
def shift_xor(spark, d):
    key = F.col("l_orderkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", shift(key, 3).alias("sl"), shift(-key, 2, "right").alias("sr"), key.bitwiseXOR(F.col("l_partkey")).alias("x"))


@query("select o_orderkey, ((o_orderkey << 40) >> 45)::bigint as u from orders")
def shift_logical(spark, d):
    return table(spark, d, "orders").select("o_orderkey", shift(shift(F.col("o_orderkey"), 40), 45, "logical").alias("u"))


from_sql("greatest_least", "select l_orderkey, l_linenumber, greatest(l_discount, l_tax) as hi, least(l_discount, l_tax) as lo from lineitem")
from_sql("neg", "select c_custkey, -c_acctbal as owed from customer")
from_sql("string_eq_ne", "select c_custkey, c_mktsegment from customer where c_mktsegment <> 'BUILDING' and c_name <> 'Customer#000000001' and c_mktsegment >= 'FURNITURE'")
from_sql("like_prefix", "select p_partkey, p_name from part where p_name like 'red%'")
from_sql("like_contains", "select p_partkey, p_name from part where p_name like '%ring%' or p_name like '_lue%'")
from_sql("not_like", "select p_partkey, p_brand from part where p_brand not like 'Brand#1%'")


@query("select count(*)::bigint as n, count(distinct o_custkey)::bigint as customers from orders")
def hash_partition_count(spark, d):
    """Hashes deal each key to one of 16 partitions: the parts' counts add up to the whole."""
    parts = table(spark, d, "orders").withColumn("part", F.pmod(F.xxhash64("o_custkey"), F.lit(16)))
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers")).agg(F.sum("n").alias("n"), F.sum("customers").alias("customers"))


# Joins


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where c_acctbal > 5000")
def join_inner(spark, d):
    return Rel.scan(table(spark, d, "orders")).join(Rel.scan(table(spark, d, "customer")).filter("c_acctbal > 5000"), "c_custkey", "o_custkey").project("o_orderkey", "c_name").df


@query("select c_custkey, s_suppkey from customer join supplier on c_nationkey = s_nationkey and c_custkey % 10 = s_suppkey % 10")
def join_composite_key(spark, d):
    c = Rel(table(spark, d, "customer").withColumn("ck", F.col("c_custkey") % 10))
    s = Rel(table(spark, d, "supplier").withColumn("sk", F.col("s_suppkey") % 10))
    return c.join(s, ["s_nationkey", "sk"], ["c_nationkey", "ck"], strategy="many").project("c_custkey", "s_suppkey").df


from_sql("join_residual", "select o_orderkey, l_linenumber from orders join lineitem on o_orderkey = l_orderkey and l_extendedprice > o_totalprice * 0.5 and l_shipdate > o_orderdate + interval '60' day")
from_sql("join_star", "select n_name, cast(extract(year from o_orderdate) as int) as o_year, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from lineitem, orders, customer, nation, region where l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA' and l_quantity < 24 group by 1, 2 order by 1, 2")


@query("select s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey")
def join_broadcast(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    return relational.join(s, n, s["s_nationkey"] == n["n_nationkey"], strategy="broadcast").select("s_suppkey", "n_name")


@query("select o_orderstatus, count(*) as n from lineitem join orders on l_orderkey = o_orderkey group by 1")
def join_shuffle_hash(spark, d):
    o, i = table(spark, d, "orders"), table(spark, d, "lineitem")
    return relational.join(i, o, i["l_orderkey"] == o["o_orderkey"], strategy="shuffle_hash").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("select o_orderstatus, round(sum(l_quantity), 2) as q from lineitem join orders on l_orderkey = o_orderkey group by 1")
def join_sort_merge(spark, d):
    o, i = table(spark, d, "orders"), table(spark, d, "lineitem")
    return relational.join(i, o, i["l_orderkey"] == o["o_orderkey"], strategy="merge").groupBy("o_orderstatus").agg(_r(F.sum("l_quantity")).alias("q"))


from_sql("semi_exists", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)")
from_sql("anti_not_exists", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
from_sql("in_subquery_having", "select o_orderkey, o_totalprice from orders where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 200)")
from_sql("scalar_subquery_corr", "select l_orderkey, l_linenumber from lineitem l join part on p_partkey = l_partkey where l_quantity < (select 0.4 * avg(l_quantity) from lineitem x where x.l_partkey = p_partkey) and p_size < 10")
from_sql("join_left_outer", "select c_count, count(*) as custdist from (select c_custkey, count(o_orderkey) as c_count from customer left join orders on c_custkey = o_custkey and o_orderpriority <> '1-URGENT' group by c_custkey) t group by c_count")
from_sql("join_full_outer", "select coalesce(cn, sn) as nationkey, c, s from (select c_nationkey as cn, count(*) as c from customer where c_acctbal > 9000 group by 1) a full outer join (select s_nationkey as sn, count(*) as s from supplier where s_acctbal > 0 group by 1) b on cn = sn")
from_sql("join_or_factor", "select round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from lineitem, part where (p_partkey = l_partkey and p_brand = 'Brand#12' and l_quantity between 1 and 11 and p_size between 1 and 15) or (p_partkey = l_partkey and p_brand = 'Brand#23' and l_quantity between 10 and 20 and p_size between 1 and 30)")
from_sql("cross_join", "select r_name, count(*) as n from region cross join nation group by r_name")


@query("select l_orderkey, l_linenumber from lineitem where l_partkey in (select p_partkey from part where p_type = 'PROMO' and p_size < 5)")
def bloom_semi(spark, d):
    p = table(spark, d, "part").filter("p_type = 'PROMO' and p_size < 5").select(F.col("p_partkey").alias("l_partkey"))
    return relational.bloom_semi(table(spark, d, "lineitem"), p, "l_partkey").select("l_orderkey", "l_linenumber")


@query("select e.event_id, p.value as last_value from (select * from events where event_type = 'click') e asof left join (select user_id, ts, max(value) as value from events where event_type = 'purchase' group by user_id, ts) p on e.user_id = p.user_id and e.ts >= p.ts")
def as_of_join(spark, d):
    e = table(spark, d, "events")
    right = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return relational.as_of_join(e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", ["last_value"]).select("event_id", "last_value")


# Aggregation


@query("select sum(l_linenumber)::bigint as s, count(*) as n, min(l_quantity) as lo, max(l_quantity) as hi, round(avg(l_discount), 6) as a from lineitem")
def reduce_multi(spark, d):
    df = monoids.reduce(table(spark, d, "lineitem"), s=("sum", "l_linenumber"), n=("count", F.lit(1)), lo=("min", "l_quantity"), hi=("max", "l_quantity"), a=("avg", "l_discount"))
    return df.withColumn("a", _r("a", 6))


@query("select l_orderkey, product(l_linenumber)::double as p from lineitem group by l_orderkey")
def reduce_product(spark, d):
    return monoids.group_by(table(spark, d, "lineitem"), ["l_orderkey"], p=("multiply", "l_linenumber"))


@query("select o_orderstatus, bool_or(o_totalprice > 300000) as some, bool_and(o_totalprice > 1000) as every, bit_or(o_custkey)::bigint as bo, bit_and(o_custkey)::bigint as ba from orders group by 1")
def reduce_bool(spark, d):
    return monoids.group_by(table(spark, d, "orders"), ["o_orderstatus"], some=("or", F.col("o_totalprice") > 300000), every=("and", F.col("o_totalprice") > 1000), bo=("bitor", "o_custkey"), ba=("bitand", "o_custkey"))


@query("select 0::bigint as s, 0::bigint as n, 1::double as p")
def reduce_identity(spark, d):
    """The identities of monoids over no rows."""
    return table(spark, d, "orders").filter("o_orderkey < 0").agg(or_identity(F.sum("o_custkey"), 0).alias("s"), F.count("*").alias("n"), or_identity(F.product("o_totalprice"), 1.0).alias("p"))


from_sql("groupby_multi", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as q, min(l_shipdate) as first_ship, max(l_extendedprice) as top from lineitem group by l_returnflag, l_linestatus")
from_sql("groupby_avg", "select o_orderpriority, round(avg(o_totalprice), 4) as a from orders group by o_orderpriority")


@query("select distinct l_returnflag, l_linestatus from lineitem")
def groupby_distinct(spark, d):
    return monoids.group_by(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


from_sql("count_distinct", "select event_type, count(distinct user_id) as users, count(*) as n from events group by event_type")
from_sql("having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12")


@query("select o_custkey, array_to_string(list_sort(list(o_orderpriority)), ',') as bag from orders group by 1")
def collect_bag(spark, d):
    return monoids.group_by(table(spark, d, "orders"), ["o_custkey"], bag=("bagunion", "o_orderpriority")).withColumn("bag", F.concat_ws(",", "bag"))


@query("select o_custkey, array_to_string(list_sort(list(distinct o_orderpriority)), ',') as kinds from orders group by 1")
def collect_set(spark, d):
    return monoids.group_by(table(spark, d, "orders"), ["o_custkey"], kinds=("union", "o_orderpriority")).withColumn("kinds", F.concat_ws(",", "kinds"))


from_sql("minmax_date", "select o_orderstatus, min(o_orderdate) as first_day, max(o_orderdate) as last_day from orders group by o_orderstatus")
from_sql("rollup_superset", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by rollup(l_returnflag, l_linestatus)")
from_sql("cube_superset", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube(l_returnflag, l_linestatus)")


@query("select event_type, count(*)::bigint as n, max(value) as top from events group by 1")
def partial_final(spark, d):
    """Two-step aggregation for hot keys: partial results of salted groups, then the whole."""
    return monoids.group_by_salted(table(spark, d, "events"), ["event_type"], 16, n=("count", F.lit(1)), top=("max", "value"))


# Nested data


def _orders_lines(spark, d):
    return nested.nest(table(spark, d, "lineitem"), ["l_orderkey"], "lines", ["l_linenumber", "l_quantity", "l_extendedprice"])


@query("select l_orderkey, count(*) as n, round(sum(l_quantity), 2) as q, min(l_linenumber) as first_line from lineitem group by 1")
def nest_orders_lines(spark, d):
    return _orders_lines(spark, d).select("l_orderkey", F.size("lines").cast("long").alias("n"), _r(F.aggregate("lines", F.lit(0.0), lambda a, x: a + x["l_quantity"])).alias("q"), F.col("lines")[0]["l_linenumber"].alias("first_line"))


@query("select l_orderkey, l_linenumber, l_quantity from lineitem")
def unnest_roundtrip(spark, d):
    return nested.unnest(_orders_lines(spark, d), "lines", "x").select("l_orderkey", "x.l_linenumber", "x.l_quantity")


@query("select o.l_orderkey, l_linenumber from (select distinct l_orderkey from lineitem) o left join (select * from lineitem where l_quantity > 40) x on o.l_orderkey = x.l_orderkey")
def outer_unnest_pred(spark, d):
    return nested.outer_unnest(_orders_lines(spark, d), "lines", "x", lambda x: x["l_quantity"] > 40).select("l_orderkey", F.col("x.l_linenumber").alias("l_linenumber"))


@query("select event_id, (props ->> '$.k')::int as k from events where (props ->> '$.k')::int > 50")
def struct_path(spark, d):
    return table(spark, d, "events").withColumn("p", F.from_json("props", "k int")).filter("p.k > 50").select("event_id", F.col("p.k").alias("k"))


@query("select count(*)::bigint as n from lineitem where l_extendedprice > 10000")
def unnest_count(spark, d):
    return nested.unnest(_orders_lines(spark, d), "lines", "x", lambda x: x["l_extendedprice"] > 10000).agg(F.count("*").alias("n"))


@query("select label, sum(len(embedding))::bigint as n, round(max(list_max(embedding)), 5) as top from embeddings group by label")
def unnest_embeddings(spark, d):
    """UNNEST in SQL text, as the front rewrites it."""
    table(spark, d, "embeddings").createOrReplaceTempView("embeddings")
    return SqlFront(spark).sql("select label, count(*) as n, round(max(cast(x as float)), 5) as top from embeddings, unnest(embeddings.embedding) as x group by label").withColumn("top", F.col("top").cast("float"))


# Sort, limits, sets


@query("select c_custkey, c_mktsegment, c_acctbal from customer order by c_mktsegment, c_acctbal desc, c_custkey")
def sort_multi_dir(spark, d):
    return relational.sort(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), ("c_mktsegment", "asc"), ("c_acctbal", "desc"), ("c_custkey", "asc"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def topk(spark, d):
    return relational.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 20, ("o_totalprice", "desc"), ("o_orderkey", "asc"))


from_sql("limit_offset", "select o_orderkey from orders order by o_orderkey limit 10 offset 25")


@query("select c_nationkey as nationkey, c_acctbal as bal from customer union all select s_nationkey, s_acctbal from supplier")
def union_all(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("bal"))
    return relational.union_all(c, table(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("bal")))


@query("select l_returnflag, count(*)::bigint as n from lineitem group by 1")
def split_union(spark, d):
    parts = relational.split(table(spark, d, "lineitem").select("l_orderkey", "l_returnflag"), 2, key="l_orderkey")
    counted = [p.groupBy("l_returnflag").agg(F.count("*").alias("n")) for p in parts]
    return relational.union_all(*counted).groupBy("l_returnflag").agg(F.sum("n").alias("n"))


@query("select p_type, count(*) as n from part group by 1")
def router_hash(spark, d):
    return Rel.scan(table(spark, d, "part")).router(4, "hash", "p_type").group_by(["p_type"], n=("count", F.lit(1))).df


from_sql("union_distinct", "select c_nationkey as k from customer union select s_nationkey from supplier")
from_sql("intersect_superset", "select c_nationkey as k from customer where c_acctbal > 9500 intersect select s_nationkey from supplier")
from_sql("except_superset", "select n_nationkey as k from nation except select s_nationkey from supplier where s_acctbal > 0")
from_sql("window_superset", "select * from (select o_custkey, o_orderkey, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as bigint) as r from orders) t where r <= 3")


# Changes


@query("select o_orderkey, case when o_orderstatus = 'F' then o_totalprice * 2 else o_totalprice end as o_totalprice from orders where not o_custkey % 2 = 0")
def update_delete(spark, d):
    from ..sources.sinks import delete, update

    o = table(spark, d, "orders")
    return delete(update(o, F.col("o_orderstatus") == "F", o_totalprice=F.col("o_totalprice") * 2), F.col("o_custkey") % 2 == 0).select("o_orderkey", "o_totalprice")


# Suites

_STAR = """with lineorder as (
  select l_orderkey, l_linenumber, o_custkey as lo_custkey, l_suppkey as lo_suppkey, l_partkey as lo_partkey, l_quantity as lo_quantity,
    l_extendedprice as lo_extendedprice, cast(round(l_discount * 100) as int) as lo_discount, l_extendedprice * (1 - l_discount) as lo_revenue,
    l_extendedprice * 0.6 as lo_supplycost, o_orderdate as lo_orderdate, cast(extract(year from o_orderdate) as int) as d_year,
    cast(extract(year from o_orderdate) * 100 + extract(month from o_orderdate) as int) as d_yearmonthnum,
    cast(extract(week from o_orderdate) as int) as d_weeknuminyear
  from lineitem join orders on l_orderkey = o_orderkey),
cust as (select c_custkey, n_name as c_nation, r_name as c_region, concat(n_name, '-', cast(c_custkey % 10 as varchar(10))) as c_city
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
supp as (select s_suppkey, n_name as s_nation, r_name as s_region, concat(n_name, '-', cast(s_suppkey % 10 as varchar(10))) as s_city
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
prt as (select p_partkey, p_brand as p_brand1, p_type as p_category, substr(p_brand, 7, 1) as p_mfgr from part)
"""


def _days(first: str, end: str) -> str:
    """A range of days, which the scan of orders can use; years, months and weeks that follow from a date can't be pushed to it."""
    return f"lo_orderdate >= timestamp '{first}' and lo_orderdate < timestamp '{end}' and "


_SUM1 = "select round(sum(lo_extendedprice * lo_discount), 2) as revenue from lineorder where "
_FLIGHT2 = "select round(sum(lo_revenue), 4) as lo_revenue, d_year, p_brand1 from lineorder join prt on lo_partkey = p_partkey join supp on lo_suppkey = s_suppkey where {} group by d_year, p_brand1 order by d_year, p_brand1"
_FLIGHT3 = "select {0}, d_year, round(sum(lo_revenue), 4) as lo_revenue from lineorder join cust on lo_custkey = c_custkey join supp on lo_suppkey = s_suppkey where {1} group by {0}, d_year order by d_year, lo_revenue desc, {0}"
_FLIGHT4 = "select {0}, round(sum(lo_revenue - lo_supplycost), 4) as profit from lineorder join cust on lo_custkey = c_custkey join supp on lo_suppkey = s_suppkey join prt on lo_partkey = p_partkey where {1} group by {0} order by {0}"
for _name, _sql in {
    "ssb_q1_1": _SUM1 + _days("1996-01-01", "1997-01-01") + "lo_discount between 1 and 3 and lo_quantity < 25",
    "ssb_q1_2": _SUM1 + _days("1996-01-01", "1996-02-01") + "lo_discount between 4 and 6 and lo_quantity between 26 and 35",
    "ssb_q1_3": _SUM1 + _days("1996-02-05", "1996-02-12") + "d_weeknuminyear = 6 and d_year = 1996 and lo_discount between 5 and 7 and lo_quantity between 26 and 35",
    "ssb_q2_1": _FLIGHT2.format("p_category = 'PROMO' and s_region = 'AMERICA'"),
    "ssb_q2_2": _FLIGHT2.format("p_brand1 between 'Brand#20' and 'Brand#25' and s_region = 'ASIA'"),
    "ssb_q2_3": _FLIGHT2.format("p_brand1 = 'Brand#22' and s_region = 'EUROPE'"),
    "ssb_q3_1": _FLIGHT3.format("c_nation, s_nation", _days("1996-01-01", "2001-01-01") + "c_region = 'ASIA' and s_region = 'ASIA'"),
    "ssb_q3_2": _FLIGHT3.format("c_city, s_city", _days("1996-01-01", "2001-01-01") + "c_nation = 'NATION_7' and s_nation = 'NATION_7'"),
    "ssb_q3_3": _FLIGHT3.format("c_city, s_city", _days("1996-01-01", "2001-01-01") + "c_city in ('NATION_7-1', 'NATION_7-5') and s_city in ('NATION_3-1', 'NATION_3-5', 'NATION_7-1')"),
    "ssb_q3_4": _FLIGHT3.format("c_city, s_city", _days("1996-12-01", "1997-01-01") + "c_city in ('NATION_7-1', 'NATION_7-5') and s_nation in ('NATION_3', 'NATION_7')"),
    "ssb_q4_1": _FLIGHT4.format("d_year, c_nation", "c_region = 'AMERICA' and s_region = 'AMERICA' and p_mfgr in ('1', '2')"),
    "ssb_q4_2": _FLIGHT4.format("d_year, s_nation, p_category", _days("1997-01-01", "1999-01-01") + "c_region = 'AMERICA' and s_region = 'AMERICA' and p_mfgr in ('1', '2')"),
    "ssb_q4_3": _FLIGHT4.format("d_year, s_city, p_brand1", _days("1997-01-01", "1999-01-01") + "s_nation = 'NATION_6' and p_category = 'SMALL'"),
}.items():
    from_sql(_name, _STAR + _sql)

for _name, _sql in {
    "tpch_q1": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge, round(avg(l_quantity), 4) as avg_qty, round(avg(l_extendedprice), 4) as avg_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order from lineitem where l_shipdate <= timestamp '2001-12-01' - interval '90' day group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus",
    "tpch_q4": "select o_orderpriority, count(*) as order_count from orders where o_orderdate >= timestamp '1996-07-01' and o_orderdate < timestamp '1996-07-01' + interval '3' month and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_shipdate > o_orderdate + interval '30' day) group by o_orderpriority order by o_orderpriority",
    "tpch_q5": "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from customer, orders, lineitem, supplier, nation, region where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA' and o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1996-01-01' + interval '1' year group by n_name order by revenue desc, n_name",
    "tpch_q6": "select round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1997-01-01' and l_discount between 0.045 and 0.075 and l_quantity < 24",
    "tpch_q7": "select supp_nation, cust_nation, l_year, round(sum(volume), 4) as revenue from (select n1.n_name as supp_nation, n2.n_name as cust_nation, cast(extract(year from l_shipdate) as int) as l_year, l_extendedprice * (1 - l_discount) as volume from supplier, lineitem, orders, customer, nation n1, nation n2 where s_suppkey = l_suppkey and o_orderkey = l_orderkey and c_custkey = o_custkey and s_nationkey = n1.n_nationkey and c_nationkey = n2.n_nationkey and ((n1.n_name = 'NATION_3' and n2.n_name = 'NATION_7') or (n1.n_name = 'NATION_7' and n2.n_name = 'NATION_3')) and l_shipdate between timestamp '1996-01-01' and timestamp '1997-12-31') shipping group by supp_nation, cust_nation, l_year order by supp_nation, cust_nation, l_year",
    "tpch_q9": "select nation_name, o_year, round(sum(amount), 2) as sum_profit from (select n_name as nation_name, cast(extract(year from o_orderdate) as int) as o_year, l_extendedprice * (1 - l_discount) - 0.6 * p_retailprice * l_quantity as amount from part, supplier, lineitem, orders, nation where s_suppkey = l_suppkey and p_partkey = l_partkey and o_orderkey = l_orderkey and s_nationkey = n_nationkey and p_name like '%ring%') profit group by nation_name, o_year order by nation_name, o_year desc",
    "tpch_q17": "select round(sum(l_extendedprice) / 7.0, 2) as avg_yearly from lineitem, part where p_partkey = l_partkey and p_brand = 'Brand#23' and l_quantity < (select 0.4 * avg(l_quantity) from lineitem where l_partkey = p_partkey)",
    "tpch_q18": "select c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) as q from customer, orders, lineitem where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 180) and c_custkey = o_custkey and o_orderkey = l_orderkey group by c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice order by o_totalprice desc, o_orderdate, o_orderkey limit 100",
    "tpch_q19": "select round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue from lineitem, part where (p_partkey = l_partkey and p_brand = 'Brand#12' and p_type in ('SMALL', 'PROMO') and l_quantity >= 1 and l_quantity <= 11 and p_size between 1 and 25) or (p_partkey = l_partkey and p_brand = 'Brand#23' and p_type in ('MEDIUM', 'LARGE') and l_quantity >= 10 and l_quantity <= 20 and p_size between 1 and 30)",
}.items():
    from_sql(_name, _sql)


# Frontends


@query("with s as (select min(l_quantity) as ql, max(l_quantity) as qh, min(l_extendedprice) as pl, max(l_extendedprice) as ph from lineitem), c as (select i, ql + (qh - ql) * (i + 0.5) / 3 as q, pl + (ph - pl) * (i + 0.5) / 3 as p from s, (values (0), (1), (2)) v(i)), a as (select l_orderkey, l_linenumber, l_quantity, l_extendedprice, arg_min(i, (power(l_quantity - q, 2) + power(l_extendedprice - p, 2), i)) as cluster from lineitem, c group by all) select cluster::int as cluster, count(*) as n, round(avg(l_quantity), 4) as l_quantity, round(avg(l_extendedprice), 4) as l_extendedprice from a group by 1")
def kmeans_step(spark, d):
    x, columns = table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]
    step = clustering.kmeans_step(x, columns, clustering.seeds(x, columns, 3))
    return step.select("cluster", "n", *[_r(c, 4).alias(c) for c in columns])


@query("select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_totalprice > 100000 group by 1")
def prepared_statement(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    front = SqlFront(spark)
    label = front.prepare("select /*+ QUERY_INFO(name='prepared') */ o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_totalprice > :least group by 1")
    return front.execute(label, {"least": 100000})
