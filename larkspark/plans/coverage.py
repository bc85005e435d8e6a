"""Queries that run the engine's sources, sinks, plans, functions and frontends on the driver's tables, each with SQL for the same result.

What a query writes goes to the shared folder, under a new path each time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import element, extract, merge
from ..operators import clustering, monoids, nested, relational
from ..scratch import scratch_path
from ..session import table
from ..sources import sinks
from ..sources.catalog import Catalog, read, register_format
from ..streaming.snapshots import propagate
from .builder import Rel
from .planjson import plan
from .sqlfront import SqlFront

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def from_sql(name: str, sql: str, oracle: str | None = None, dealt: str | None = None) -> None:
    from .suite import ORACLE as oracles
    from .suite import QUERIES as queries
    from .suite import from_sql as add

    add(name, sql, oracle, dealt)
    QUERIES[name], ORACLE[name] = queries.pop(name), oracles.pop(name)


# Sources and sinks

_NATIONS = "select n_nationkey, n_name, n_regionkey from nation"


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation")


def _relation(path: str, kind: str, columns: dict[str, str | dict], **options) -> dict:
    attributes = [{"attrName": c, "type": t if isinstance(t, dict) else {"type": t}} for c, t in columns.items()]
    return {"path": path, "plugin": {"type": kind, **options}, "type": {"type": "bag", "inner": {"type": "record", "attributes": attributes}}}


_NATION = {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}


def _round_trip(spark: SparkSession, d: str, kind: str, write: str, **options) -> DataFrame:
    path = scratch_path(spark, kind)
    sinks.write(_nations(spark, d), path, write, **({"sep": options["delimiter"]} if "delimiter" in options else {"sep": "\t"} if kind == "tsv" else {}))
    return Catalog(spark, {"nation": _relation(path, kind, _NATION, **options)}).table("nation")


@query(_NATIONS)
def csv_scan(spark, d):
    return _round_trip(spark, d, "pm-csv", "pm-csv", delimiter=";")


@query(_NATIONS)
def csv_plain(spark, d):
    return _round_trip(spark, d, "csv", "csv", delimiter="|")


@query(_NATIONS)
def tsv_scan(spark, d):
    return _round_trip(spark, d, "tsv", "csv")


@query("select n_nationkey, n_name, n_regionkey from nation")
def csv_inferred(spark, d):
    """Names from the header and types from the values."""
    path = scratch_path(spark, "csv")
    sinks.write(_nations(spark, d), path, "csv", header=True)
    return read(spark, path, "csv", delimiter=",", header=True)


@query(_NATIONS)
def json_lines_scan(spark, d):
    return _round_trip(spark, d, "json", "json")


@query(_NATIONS)
def json_document_scan(spark, d):
    path = scratch_path(spark, "document")
    sinks.write_json_document(_nations(spark, d), path)
    return Catalog(spark, {"nation": _relation(path, "json-document", _NATION)}).table("nation")


@query("select region, count(*)::bigint as n, sum(n_nationkey)::bigint as s from (select n_regionkey as region, n_nationkey from nation where n_regionkey in (1, 3)) group by region")
def distributed_block_scan(spark, d):
    """Files in a folder for each region: the filter decides which are read."""
    path = scratch_path(spark, "parts")
    _nations(spark, d).withColumnRenamed("n_regionkey", "region").write.partitionBy("region").parquet(path)
    return read(spark, path, "distributed-block").filter("region in (1, 3)").groupBy("region").agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("s"))


@query(_NATIONS)
def binary_row_scan(spark, d):
    return _round_trip(spark, d, "binrow", "block")


@query("select n_regionkey, max(n_name) as last from nation group by n_regionkey")
def binary_column_scan(spark, d):
    return _round_trip(spark, d, "bincol", "bincol").groupBy("n_regionkey").agg(F.max("n_name").alias("last"))


@query(_NATIONS)
def registry_scan(spark, d):
    _nations(spark, d).createOrReplaceTempView("registered_nation")
    return Catalog(spark, {"nation": _relation("registered_nation", "registry", _NATION)}).table("nation")


@query(_NATIONS)
def dynamic_scan(spark, d):
    """The kind follows from the path."""
    return Catalog(spark, {"nation": _relation(f"{d}/nation.parquet", "dynamic", _NATION)}).table("nation")


@query("select n_nationkey, upper(n_name) as n_name from nation")
def user_plugin_scan(spark, d):
    """A kind of source that its user has registered."""
    register_format("loud", lambda spark, path, columns: spark.read.schema(columns).parquet(path).withColumn("n_name", F.upper("n_name")))
    return Catalog(spark, {"nation": _relation(f"{d}/nation.parquet", "loud", {"n_nationkey": "int", "n_name": "string"})}).table("nation")


@query("select o_orderpriority, n, (n * 100 // sum(n) over ())::bigint as share from (select o_orderpriority, count(*) as n from orders group by 1)")
def intermediate_result_scan(spark, d):
    """An intermediate result is written once and read twice."""
    path = scratch_path(spark, "intermediate")
    table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).write.parquet(path)
    parts = read(spark, path, "binary-block")
    return parts.crossJoin(F.broadcast(parts.agg(F.sum("n").alias("all")))).select("o_orderpriority", "n", F.expr("(n * 100) div all").alias("share"))


def _versions(spark: SparkSession, d: str) -> str:
    """Three versions of a table, which a stream has made of three files."""
    source, out = scratch_path(spark, "arrivals"), scratch_path(spark, "versions")
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    for i in range(3):
        rows.filter(F.col("o_orderkey") % 3 == i).coalesce(1).write.mode("append").parquet(source)
        propagate(spark.readStream.schema(rows.schema).parquet(source), out, f"{out}-log").awaitTermination()
    return out


@query("select count(*)::bigint as n, round(sum(o_totalprice), 2) as total from orders where o_orderkey % 3 < 2")
def htap_snapshot(spark, d):
    """A query on the second version of a table that goes on growing."""
    entry = _relation(_versions(spark, d), "snapshots", {"o_orderkey": "int64", "o_totalprice": "float"}, version=1)
    return Catalog(spark, {"orders": entry}).table("orders").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select count(*)::bigint as n, round(sum(o_totalprice), 2) as total from orders")
def snapshot_latest(spark, d):
    return read(spark, _versions(spark, d), "snapshots").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select n_regionkey, count(*) as n from nation group by 1")
def result_scan(spark, d):
    """A result that is written and read back."""
    path = scratch_path(spark, "result")
    sinks.write(_nations(spark, d).groupBy("n_regionkey").agg(F.count("*").alias("n")), path, "json")
    return read(spark, path, "result").select(F.col("n_regionkey").cast("int"), F.col("n").cast("long"))


@query("select n_nationkey, n_name, n_regionkey from nation union all select n_nationkey + 100, n_name, n_regionkey from nation where n_regionkey = 2")
def insert_into(spark, d):
    path = scratch_path(spark, "table")
    _nations(spark, d).write.parquet(path)
    name = "inserted_nation"
    spark.sql(f"drop table if exists {name}")
    spark.catalog.createTable(name, path, "parquet")
    sinks.insert_into(_nations(spark, d).filter("n_regionkey = 2").select("n_regionkey", "n_name", (F.col("n_nationkey") + 100).alias("n_nationkey")), name)
    spark.sql(f"drop table {name}")
    return read(spark, path, "block")


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey = 7")
def keyed_get(spark, d):
    """One key of a table that is indexed by folders: a lookup reads one of them."""
    path = scratch_path(spark, "indexed")
    sinks.write_indexed(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path, "o_orderkey", 16)
    return sinks.lookup(spark, path, "o_orderkey", 7, 16)


@query("select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def print_sink(spark, d):
    path = scratch_path(spark, "printed")
    joined = Rel.scan(_nations(spark, d)).join(Rel.scan(table(spark, d, "region")), "r_regionkey", "n_regionkey").project("n_name", "r_name")
    joined.print(path)
    return spark.read.schema("n_name string, r_name string").csv(path)


# Relational operators


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_totalprice > 250000)")
def bloom_filter(spark, d):
    """Filters of two halves of the build side, merged; what passes is held against the keys."""
    dear = table(spark, d, "orders").filter("o_totalprice > 250000").select(F.col("o_orderkey").alias("l_orderkey"))
    halves = [relational.bloom_build(dear.filter(F.col("l_orderkey") % 2 == i), "l_orderkey") for i in range(2)]
    passed = relational.bloom_probe(table(spark, d, "lineitem"), relational.bloom_merge(*halves), "l_orderkey")
    return relational.bloom_semi(passed, dear, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("select r_name, count(*) as n from nation join region on n_regionkey = r_regionkey group by 1")
def row_count_hint(spark, d):
    return Rel.scan(_nations(spark, d)).join(Rel.scan(table(spark, d, "region")).hint_rows(5), "r_regionkey", "n_regionkey").group_by(["r_name"], n=("count", F.lit(1))).df


@query("select event_id, nullif(event_type, 'view') as kind from events order by kind nulls first, event_id limit 50")
def nulls_first(spark, d):
    kinds = table(spark, d, "events").select("event_id", F.nullif("event_type", F.lit("view")).alias("kind"))
    return relational.sort(kinds, ("kind", "asc"), ("event_id", "asc"), nulls="first").limit(50)


@query("select l_orderkey, string_agg(l_returnflag, '' order by l_quantity desc, l_linenumber, l_returnflag) as flags from lineitem group by 1")
def append_ordered(spark, d):
    flags = monoids.append("l_returnflag", -F.col("l_quantity"), "l_linenumber")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat_ws("", flags).alias("flags"))


@query("select o_custkey, count(case when o_totalprice > 200000 then 1 end) as n, coalesce(sum(case when o_totalprice > 200000 then o_orderkey end), 0)::bigint as s, max(case when o_totalprice > 200000 then o_orderkey end) as top from orders group by 1")
def nest_multi_aggregate(spark, d):
    """Several aggregates in one nest, with a predicate and zeros for groups that it leaves without rows."""
    return nested.nest_aggregates(table(spark, d, "orders"), ["o_custkey"], F.col("o_totalprice") > 200000, n=("count", "o_orderkey"), s=("sum", "o_orderkey"), top=("max", "o_orderkey"))


@query("select l_returnflag, count(*)::bigint as n from lineitem group by 1")
def split_random(spark, d):
    parts = relational.split(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), 3, "random")
    return relational.union_all(*parts).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("select l_returnflag, count(*)::bigint as n from lineitem group by 1")
def split_local(spark, d):
    parts = Rel.scan(table(spark, d, "lineitem"), columns=["l_returnflag"]).split(3, policy="local")
    return parts[0].union_all(*parts[1:]).group_by(["l_returnflag"], n=("count", F.lit(1))).df


@query("select p_type, count(*) as n from part group by 1")
def router_random(spark, d):
    return Rel.scan(table(spark, d, "part")).router(4).group_by(["p_type"], n=("count", F.lit(1))).df


@query("select p_type, count(*) as n from part group by 1")
def router_local(spark, d):
    return Rel.scan(table(spark, d, "part")).router(2, "local").group_by(["p_type"], n=("count", F.lit(1))).df


# Expressions

from_sql("is_true_false", "select event_id from events where (value > 50) is true or (event_type = 'view') is not false and (nullif(event_type, 'click') = 'view') is not true and (value < 10) is false")
from_sql("null_comparisons", "select event_id, nullif(event_type, 'view') is not distinct from 'click' as same from events")
from_sql("filter_aggregates", "select event_type, count(*) filter (where value > 50) as high, round(stddev_samp(value), 6) as spread, round(var_pop(value), 6) as v from events group by event_type")
from_sql("percentile", "select event_type, round(percentile_cont(0.5) within group (order by value), 6) as middle from events group by event_type")


@query("select event_id, extract(isoyear from ts)::int as iso_year from events")
def extract_isoyear(spark, d):
    return table(spark, d, "events").select("event_id", extract("isoyear", F.col("ts")).alias("iso_year"))


@query("select count(*) as n, true as inside, true as varied from orders")
def rand_seeded(spark, d):
    """Numbers from 0 on and below 1, the same for a seed."""
    x = table(spark, d, "orders").select(F.rand(7).alias("x"))
    return x.agg(F.count("*").alias("n"), F.bool_and((F.col("x") >= 0) & (F.col("x") < 1)).alias("inside"), (F.count_distinct("x") > 1).alias("varied"))


@query("select l_orderkey, list_extract(list(l_partkey order by l_linenumber, l_partkey), 1) as first_part, case when count(*) > 2 then list_extract(list(l_partkey order by l_linenumber, l_partkey), 3) end as third_part from lineitem group by 1")
def element_at_position(spark, d):
    parts = monoids.append("l_partkey", "l_linenumber")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(parts.alias("p")).select("l_orderkey", element(F.col("p"), 0).alias("first_part"), element(F.col("p"), 2).alias("third_part"))


@query("select o_custkey, count(*)::int * 2 as n from orders group by 1")
def merge_collections(spark, d):
    keys = monoids.monoid("bagunion", "o_orderkey")
    return table(spark, d, "orders").groupBy("o_custkey").agg(keys.alias("k")).select("o_custkey", F.size(merge(F.col("k"), F.col("k"))).alias("n"))


@query("with w as (select l_quantity as x, l_extendedprice / 1000 as y from lineitem), d as (select x, y, 0.5 * exp(-power(x - 10.0, 2) / 200.0 - ln(100.0) / 2 - power(y - 20.0, 2) / 800.0 - ln(400.0) / 2) as a, 0.5 * exp(-power(x - 40.0, 2) / 200.0 - ln(100.0) / 2 - power(y - 50.0, 2) / 800.0 - ln(400.0) / 2) as b from w), r as (select x, y, 0 as part, a / (a + b) as r from d union all select x, y, 1, b / (a + b) from d) select part::int as part, round(sum(r) / count(*), 6) as weight, round(sum(r * x) / sum(r), 5) as mean_x, round(sum(r * y) / sum(r), 5) as mean_y, round(sum(r * x * x) / sum(r) - power(sum(r * x) / sum(r), 2), 4) as var_x, round(sum(r * y * y) / sum(r) - power(sum(r * y) / sum(r), 2), 4) as var_y from r group by part")
def mixture_step(spark, d):
    """One step of expectation maximisation for two normals."""
    points = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    step = clustering.mixture_step(points, ["x", "y"], [(0.5, [10.0, 20.0], [100.0, 400.0]), (0.5, [40.0, 50.0], [100.0, 400.0])])
    return step.select("part", F.round("weight", 6).alias("weight"), *[F.round(c, n).alias(c) for c, n in (("mean_x", 5), ("mean_y", 5), ("var_x", 4), ("var_y", 4))])


# SQL front


def _declared(spark: SparkSession, d: str, front: SqlFront) -> None:
    plugin = json.dumps({"file": f"{d}/orders.parquet", "plugin": {"type": "block"}})
    front.sql(f"create table if not exists declared_orders (o_orderkey bigint not null, o_custkey bigint, o_totalprice double, dear boolean as (o_totalprice > 200000), primary key (o_orderkey), foreign key (o_custkey) references customer (c_custkey)) jplugin '{plugin}'")


@query("select o_totalprice > 200000 as dear, count(*) as n from orders group by 1")
def create_table_jplugin(spark, d):
    """A table that SQL declares, with constraints and a column that is worked out."""
    front = SqlFront(spark)
    _declared(spark, d, front)
    return front.sql("select dear, count(*) as n from declared_orders group by dear")


@query("select o_orderkey, (o_custkey * 2 + 1)::bigint as x from orders")
def create_function(spark, d):
    front = SqlFront(spark)
    table(spark, d, "orders").createOrReplaceTempView("orders")
    front.sql("create or replace temporary function odd_of(x bigint) returns bigint return x * 2 + 1")
    return front.sql("select o_orderkey, odd_of(o_custkey) as x from orders")


@query("select o_custkey, max(o_totalprice) - min(o_totalprice) as spread from orders group by 1")
def user_aggregate(spark, d):
    front = SqlFront(spark)
    table(spark, d, "orders").createOrReplaceTempView("orders")

    def spread(x: pd.Series) -> float:
        return x.max() - x.min()

    front.aggregate("spread_of", spread, "double")
    return front.sql("select o_custkey, spread_of(o_totalprice) as spread from orders group by o_custkey")


@query("select n_nationkey, i::int as i from nation, generate_series(1, n_regionkey) as g(i)")
def user_table_function(spark, d):
    front = SqlFront(spark)
    _nations(spark, d).createOrReplaceTempView("nation")

    class Count:
        def eval(self, n: int) -> Iterator[tuple[int]]:
            for i in range(1, n + 1):
                yield (i,)

    front.table_function("count_to", Count, "i int")
    return front.sql("select n_nationkey, i from nation, lateral count_to(n_regionkey) as g")


@query("select 'a' as query_name, 'select' as cmd_type, 'cpuonly' as hwmode, true as timed union all select 'b', 'select', 'cpuonly', true")
def session_timings(spark, d):
    front = SqlFront(spark)
    _nations(spark, d).createOrReplaceTempView("nation")
    front.run("select /*+ QUERY_INFO(name='a') */ count(*) from nation")
    front.sql("set timings = off")
    front.run("select /*+ QUERY_INFO(name='unseen') */ count(*) from nation")
    front.sql("set timings = 'text'")
    front.run("select /*+ QUERY_INFO(name='b') */ max(n_name) from nation")
    return front.sql("select query_name, cmd_type, hwmode, execution_time >= 0 and total_time >= planning_time as timed from SessionTimings where query_name <> ''")


@query("select 4 as parts, count(*) as n from orders")
def set_dop(spark, d):
    front = SqlFront(spark)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    table(spark, d, "orders").createOrReplaceTempView("orders")
    try:
        front.sql("alter session set cpudop = 4")
        return front.sql(f"select {spark.conf.get('spark.sql.shuffle.partitions')} as parts, count(*) as n from orders")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


@query("select l_orderkey, count(*) as n, round(sum(l_quantity), 2) as q from lineitem where l_quantity > 30 group by 1")
def unnest_sql_records(spark, d):
    """UNNEST of records with columns, beside a string that looks like one."""
    nested.nest(table(spark, d, "lineitem"), ["l_orderkey"], "lines", ["l_linenumber", "l_quantity"]).createOrReplaceTempView("nested_orders")
    return SqlFront(spark).sql("select l_orderkey, count(*) as n, round(sum(q), 2) as q from nested_orders o cross join unnest(o.lines) as e(k, q) where q > 30 and ', unnest(o.lines) x' <> '' -- , unnest(o.lines)\n group by l_orderkey")


@query("select label, count(*) as n from embeddings, unnest(embedding) as e(x) where x > 0.2 group by label")
def unnest_sql_values(spark, d):
    table(spark, d, "embeddings").createOrReplaceTempView("embeddings")
    return SqlFront(spark).sql("select label, count(*) as n from embeddings, unnest(embeddings.embedding) as e(x) where x > 0.2 group by label")


# JSON plans


def at(name: str, relation: str | None = None, of: dict | None = None) -> dict:
    """A plan's expression for an attribute."""
    attribute = {"attrName": name} | ({"relName": relation} if relation else {})
    return {"expression": "recordProjection", "e": of or {"expression": "argument", "argNo": -1}, "attribute": attribute}


def named(e: dict, name: str, relation: str = "out") -> dict:
    return {**e, "register_as": {"attrName": name, "relName": relation}}


def whole(v: int) -> dict:
    return {"expression": "int", "v": v}


def two(kind: str, left: dict, right: dict) -> dict:
    return {"expression": kind, "left": left, "right": right}


_TRUE = {"expression": "bool", "v": True}
_RELATIONS = {
    "orders": {"o_orderkey": "int64", "o_custkey": "int64", "o_orderstatus": "string", "o_totalprice": "float", "o_orderpriority": "string", "o_orderdate": "datetime"},
    "customer": {"c_custkey": "int64", "c_nationkey": "int", "c_acctbal": "float", "c_mktsegment": "string"},
    "lineitem": {"l_orderkey": "int64", "l_partkey": "int64", "l_linenumber": "int", "l_quantity": "float", "l_extendedprice": "float", "l_returnflag": "string"},
    "nation": _NATION,
    "region": {"r_regionkey": "int", "r_name": "string"},
    "part": {"p_partkey": "int64", "p_type": "string", "p_size": "int"},
}


def _catalog(spark: SparkSession, d: str) -> Catalog:
    return Catalog(spark, {name: _relation(f"{d}/{name}.parquet", "block", columns) for name, columns in _RELATIONS.items()})


def scan(name: str, *columns: str) -> dict:
    return {"operator": "scan", "plugin": {"type": "block", "name": name, "projections": [{"relName": name, "attrName": c} for c in columns or _RELATIONS[name]]}}


def plan_query(sql: str) -> Callable[[Callable[[], dict]], Query]:
    """Registers a plan on the driver's tables."""

    def add(f: Callable[[], dict]) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            return plan(json.dumps(f()), _catalog(spark, d))

        QUERIES[f.__name__], ORACLE[f.__name__] = run, sql
        return run

    return add


@plan_query("select o_orderpriority, count(*) as n, max(o_totalprice) as top from orders join customer on o_custkey = c_custkey where c_acctbal > 0 group by 1")
def json_plan() -> dict:
    rich = {"operator": "select", "p": two("gt", at("c_acctbal", "customer"), {"expression": "float", "v": 0.0}), "input": scan("customer", "c_custkey", "c_acctbal")}
    joined = {"operator": "hashjoin-chained", "hash_bits": 10, "maxBuildInputSize": 1 << 20, "build_input": rich, "probe_input": scan("orders"), "build_k": at("c_custkey", "customer"), "probe_k": at("o_custkey", "orders"), "build_e": [], "probe_e": [{"e": named(at(c, "orders"), c, "joined"), "packet": i, "offset": 0} for i, c in enumerate(("o_orderpriority", "o_totalprice"))]}
    return {"operator": "hashgroupby-chained", "hash_bits": 10, "maxInputSize": 100, "input": joined, "k": [named(at("o_orderpriority", "joined"), "o_orderpriority")], "e": [{"m": "count", "e": named(whole(1), "n"), "packet": 0, "offset": 0}, {"m": "max", "e": named(at("o_totalprice", "joined"), "top"), "packet": 1, "offset": 0}]}


@plan_query("select max(o_orderkey) as top, sum(o_custkey)::bigint as s, count(*) as n from orders where o_totalprice > 100000 and o_orderstatus = 'F'")
def json_plan_reduce() -> dict:
    picked = {"operator": "select", "input": scan("orders"), "p": two("and", two("gt", at("o_totalprice", "orders"), {"expression": "float", "v": 100000.0}), two("eq", at("o_orderstatus", "orders"), {"expression": "string", "v": "F"}))}
    return {"operator": "reduce", "input": picked, "accumulator": ["max", "sum", "count"], "p": _TRUE, "e": [named(at("o_orderkey", "orders"), "top"), named(at("o_custkey", "orders"), "s"), named({"expression": "int64", "v": 1}, "n")]}


@plan_query("select o_orderkey, l_linenumber from orders join lineitem on o_orderkey = l_orderkey and o_custkey = l_partkey")
def json_plan_join() -> dict:
    p = two("and", two("eq", at("o_orderkey", "orders"), at("l_orderkey", "lineitem")), two("eq", at("o_custkey", "orders"), at("l_partkey", "lineitem")))
    joined = {"operator": "join", "p": p, "leftInput": scan("orders"), "rightInput": scan("lineitem"), "leftFields": [at("o_orderkey", "orders")], "rightFields": [at("l_linenumber", "lineitem")]}
    return {"operator": "print", "plugin": {"type": "json", "name": "joined"}, "input": joined, "e": [named(at("o_orderkey", "orders"), "o_orderkey"), named(at("l_linenumber", "lineitem"), "l_linenumber")]}


@plan_query("select n_name, count(*) as n from nation join customer on n_nationkey = c_nationkey group by 1")
def json_plan_partitioned_join() -> dict:
    joined = {"operator": "partitioned-hashjoin-chained", "build_input": scan("nation"), "probe_input": scan("customer"), "build_k": {"expression": "recordConstruction", "attributes": [{"name": "k", "e": at("n_nationkey", "nation")}]}, "probe_k": {"expression": "recordConstruction", "attributes": [{"name": "k", "e": at("c_nationkey", "customer")}]}, "build_w": [64], "probe_w": [64], "build_e": [{"e": named(at("n_name", "nation"), "n_name", "j"), "packet": 0, "offset": 0}], "probe_e": [], "maxBuildInputSize": 100, "maxProbeInputSize": 100000}
    return {"operator": "groupby", "hash_bits": 5, "maxInputSize": 100, "input": joined, "k": [named(at("n_name", "j"), "n_name")], "e": [{"m": "count", "e": named(whole(1), "n"), "packet": 0, "offset": 0}]}


@plan_query("select count(*) as n, sum(c_custkey)::bigint as s from nation join customer on n_nationkey = c_nationkey")
def json_plan_external_join() -> dict:
    side = lambda name, key, columns: [{"original": at(c, name), "hashed": named(at(c, name), c), "hashed-block": named(at(c, name), c), "join": {"e": at(c, name), "packet": 0, "offset": 0}} for c in (key, *columns)]
    joined = {"operator": "out-of-gpu-join", "build_input": scan("nation"), "probe_input": scan("customer"), "build_e": side("nation", "n_nationkey", ()), "probe_e": side("customer", "c_nationkey", ("c_custkey",)), "build_hash": {"attribute": {"relName": "nation", "attrName": "n_nationkey"}}, "probe_hash": {"attribute": {"relName": "customer", "attrName": "c_nationkey"}}, "numOfBuckets": 8, "numPartitioners": 2, "numConcurrent": 2, "maxBuildInputSize": 100, "maxProbeInputSize": 1000, "slack": 8}
    return {"operator": "reduce", "input": joined, "accumulator": ["count", "sum"], "e": [named(whole(1), "n"), named(at("c_custkey", "customer"), "s")]}


def _nested_catalog(spark: SparkSession, d: str) -> Catalog:
    """Orders with their lines as a list of records, in a file of JSON lines."""
    path = scratch_path(spark, "nested")
    nested.nest(table(spark, d, "lineitem").filter("l_orderkey < 200"), ["l_orderkey"], "lines", ["l_linenumber", "l_quantity"]).write.json(path)
    line = {"type": "record", "attributes": [{"attrName": "l_linenumber", "type": {"type": "int"}}, {"attrName": "l_quantity", "type": {"type": "float"}}]}
    return Catalog(spark, {"nested": _relation(path, "json", {"l_orderkey": "int64", "lines": {"type": "list", "inner": line}})})


def _unnest(kind: str, p: dict) -> dict:
    source = {"operator": "scan", "plugin": {"type": "json", "name": "nested", "projections": [{"relName": "nested", "attrName": c} for c in ("l_orderkey", "lines")]}}
    return {"operator": kind, "input": source, "p": p, "argNo": 0, "path": {"name": "nested.lines", "e": at("lines", "nested")}}


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey < 200 and l_quantity > 25")
def json_plan_unnest(spark, d):
    node = _unnest("unnest", two("gt", at("l_quantity", "nested.lines"), whole(25)))
    out = [named(at("l_orderkey", "nested"), "l_orderkey"), named(at("l_linenumber", "nested.lines"), "l_linenumber"), named(at("l_quantity", of=at("lines", "nested")), "l_quantity")]
    return plan({"operator": "project", "input": node, "e": out}, _nested_catalog(spark, d))


@query("select o.l_orderkey, l_linenumber from (select distinct l_orderkey from lineitem where l_orderkey < 200) o left join (select * from lineitem where l_quantity > 40) x on o.l_orderkey = x.l_orderkey")
def json_plan_outer_unnest(spark, d):
    node = _unnest("outer_unnest", two("gt", at("l_quantity", "nested.lines"), whole(40)))
    return plan({"operator": "project", "input": node, "e": [named(at("l_orderkey", "nested"), "l_orderkey"), named(at("l_linenumber", "nested.lines"), "l_linenumber")]}, _nested_catalog(spark, d))


def _nest(*made: tuple[str, str, dict], p: dict = _TRUE) -> dict:
    key = at("o_custkey", "orders")
    nest = {"operator": "nest", "input": scan("orders"), "accumulator": [m for m, _, _ in made], "aggrLabels": [f"_{n}" for _, n, _ in made], "e": [e for _, _, e in made], "p": p, "f": key, "g": key, "fields": [key]}
    return {"operator": "project", "input": nest, "e": [named(key, "o_custkey"), *[named(at(f"_{n}", "radixNest"), n) for _, n, _ in made]]}


@plan_query("select o_custkey, count(*) as n from orders group by 1")
def json_plan_nest() -> dict:
    return _nest(("sum", "n", {"expression": "int64", "v": 1}))


@plan_query("select o_custkey, count(*) filter (where o_totalprice > 150000) as n, max(case when o_totalprice > 150000 then o_orderkey end) as top from orders group by 1")
def json_plan_multinest() -> dict:
    return _nest(("sum", "n", {"expression": "int64", "v": 1}), ("max", "top", at("o_orderkey", "orders")), p=two("gt", at("o_totalprice", "orders"), {"expression": "float", "v": 150000.0}))


@query("select n_nationkey, n_name, n_regionkey from nation union all select n_nationkey + 1000, n_name, n_regionkey from nation where n_regionkey < 2")
def json_plan_insert(spark, d):
    path = scratch_path(spark, "nation")
    _nations(spark, d).write.parquet(path)
    catalog = Catalog(spark, {"nation": _relation(path, "block", _NATION)})
    few = {"operator": "select", "input": scan("nation"), "p": two("lt", at("n_regionkey", "nation"), whole(2))}
    moved = named(two("add", at("n_nationkey", "nation"), whole(1000)), "n_nationkey")
    plan({"operator": "insert-into", "name": "nation", "plugin": {"type": "block"}, "input": few, "e": [moved, named(at("n_name", "nation"), "n_name"), named(at("n_regionkey", "nation"), "n_regionkey")]}, catalog)
    return catalog.table("nation")


@plan_query("select k, s, n_name from (values (1, 10::bigint), (3, 30::bigint), (4, 40::bigint)) v(k, s) join nation on k = n_nationkey")
def json_plan_values() -> dict:
    values = {"operator": "values", "relName": "v", "values": [{"attrName": "k", "type": {"type": "int"}, "v": [1, 3, 4]}, {"attrName": "s", "type": {"type": "int64"}, "v": [10, 30, 40]}]}
    shared = {"operator": "mem-broadcast-device", "input": values, "projections": []}
    joined = {"operator": "hashjoin-chained", "build_input": shared, "probe_input": scan("nation"), "build_k": at("k", "v"), "probe_k": at("n_nationkey", "nation")}
    return {"operator": "project", "input": joined, "e": [named(at("k", "v"), "k"), named(at("s", "v"), "s"), named(at("n_name", "nation"), "n_name")]}


@plan_query("select distinct p_type from part where regexp_full_match(p_type, '(S|P).*')")
def json_plan_dict_scan() -> dict:
    return {"operator": "dict-scan", "relName": "part", "attrName": "p_type", "regex": "(S|P).*"}


@plan_query("select l_returnflag, count(*)::bigint as n from lineitem group by 1")
def json_plan_split() -> dict:
    """A split whose parts are counted apart, united, repartitioned by their key and counted together."""
    split = {"operator": "split", "split_id": 3, "numOfParents": 2, "input": scan("lineitem"), "target": at("l_orderkey", "lineitem")}
    count = lambda node: {"operator": "hashgroupby-chained", "hash_bits": 5, "maxInputSize": 10, "input": node, "k": [named(at("l_returnflag", "lineitem"), "l_returnflag", "c")], "e": [{"m": "count", "e": named(whole(1), "n", "c"), "packet": 0, "offset": 0}]}
    both = {"operator": "union-all", "input": [count(split), count({"operator": "split", "split_id": 3})]}
    dealt = {"operator": "exchange", "input": {"operator": "pack", "input": {"operator": "hash-rearrange", "buckets": 4, "input": both, "e": at("l_returnflag", "c"), "projections": [{"relName": "c", "attrName": "l_returnflag"}, {"relName": "c", "attrName": "n"}], "hashProject": {"relName": "c", "attrName": "bucket"}}}, "numOfParents": 4, "target": at("bucket", "c")}
    return {"operator": "groupby", "input": {"operator": "unpack", "input": dealt}, "k": [named(at("l_returnflag", "c"), "l_returnflag")], "e": [{"m": "sum", "e": named(at("n", "c"), "n")}]}


@plan_query("select c_mktsegment, c_custkey, c_acctbal from customer order by c_mktsegment, c_acctbal desc")
def json_plan_sort() -> dict:
    keys = [{"direction": d, "expression": at(c, "customer")} for c, d in (("c_mktsegment", "ASC"), ("c_acctbal", "DESC"), ("c_custkey", "NONE"))]
    return {"operator": "print", "input": {"operator": "sort", "input": scan("customer", "c_mktsegment", "c_custkey", "c_acctbal"), "e": keys}}


@plan_query("select o_orderkey, extract(year from o_orderdate)::int as y, (o_custkey // 7)::bigint as q, (o_custkey % 7)::bigint as m, -o_totalprice as owed, case when o_orderstatus = 'F' and o_totalprice is not null then 1 else 0 end as done, o_custkey::double as f, xor(o_custkey, 5)::bigint as x, (o_custkey << 2)::bigint as sh, o_orderdate >= timestamp '1996-07-01' as late from orders")
def json_plan_expressions() -> dict:
    key = at("o_custkey", "orders")
    seven = {"expression": "int64", "v": 7}
    done = two("and", two("eq", at("o_orderstatus", "orders"), {"expression": "dstring", "v": "F"}), {"expression": "is_not_null", "e": at("o_totalprice", "orders")})
    made = {
        "o_orderkey": at("o_orderkey", "orders"),
        "y": {"expression": "extract", "unitrange": "YEAR", "e": at("o_orderdate", "orders")},
        "q": two("div", key, seven),
        "m": two("mod", key, seven),
        "owed": {"expression": "neg", "e": at("o_totalprice", "orders")},
        "done": {"expression": "if", "cond": done, "then": whole(1), "else": whole(0)},
        "f": {"expression": "cast", "type": {"type": "float"}, "e": key},
        "x": two("xor", key, {"expression": "int64", "v": 5}),
        "sh": two("shl", key, whole(2)),
        "late": two("ge", at("o_orderdate", "orders"), {"expression": "datetime", "v": 836179200000}),
    }
    return {"operator": "project", "input": scan("orders"), "e": [named(e, n) for n, e in made.items()]}


@plan_query("select o_orderkey, o_custkey as k, o_totalprice as p from orders")
def json_plan_record() -> dict:
    """A record is made, and its fields are taken out again."""
    record = {"expression": "recordConstruction", "attributes": [{"name": "k", "e": at("o_custkey", "orders")}, {"name": "p", "e": at("o_totalprice", "orders")}]}
    made = {"operator": "project", "input": scan("orders"), "e": [named(at("o_orderkey", "orders"), "o_orderkey", "r"), named(record, "both", "r")]}
    return {"operator": "project", "input": made, "e": [named(at("o_orderkey", "r"), "o_orderkey"), *[named(at(c, of=at("both", "r")), c) for c in ("k", "p")]]}


@query("select count(*) as n from orders where o_totalprice > 123456.0 and o_orderstatus = 'O'")
def json_plan_placeholder(spark, d):
    p = two("and", two("gt", at("o_totalprice"), {"expression": "placeholder", "index": 0, "type": {"type": "float"}}), two("eq", at("o_orderstatus"), {"expression": "placeholder", "index": 1, "type": {"type": "string"}}))
    node = {"operator": "reduce", "input": {"operator": "select", "input": scan("orders"), "p": p}, "accumulator": ["count"], "e": [named(whole(1), "n")]}
    return plan(node, _catalog(spark, d), [123456.0, "O"])


# More of the suites' texts, on what the tables hold

for _name, _sql in {
    "tpch_q3": "select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue, o_orderdate from customer, orders, lineitem where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate < timestamp '1997-03-15' and l_shipdate > timestamp '1997-03-15' group by l_orderkey, o_orderdate order by revenue desc, o_orderdate, l_orderkey limit 10",
    "tpch_q8": "select o_year, round(sum(case when nation = 'NATION_7' then volume else 0 end) / sum(volume), 6) as mkt_share from (select cast(extract(year from o_orderdate) as int) as o_year, l_extendedprice * (1 - l_discount) as volume, n2.n_name as nation from part, supplier, lineitem, orders, customer, nation n1, nation n2, region where p_partkey = l_partkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n1.n_nationkey and n1.n_regionkey = r_regionkey and r_name = 'ASIA' and s_nationkey = n2.n_nationkey and p_type = 'SMALL') all_nations group by o_year order by o_year",
    "tpch_q10": "select c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue, c_acctbal, n_name from customer, orders, lineitem, nation where c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate >= timestamp '1996-10-01' and o_orderdate < timestamp '1997-01-01' and l_returnflag = 'R' and c_nationkey = n_nationkey group by c_custkey, c_name, c_acctbal, n_name order by revenue desc, c_custkey limit 20",
    "tpch_q13": "select c_count, count(*) as custdist from (select c_custkey, count(o_orderkey) as c_count from customer left join orders on c_custkey = o_custkey and o_orderpriority not like '%URGENT%' group by c_custkey) c_orders group by c_count order by custdist desc, c_count desc",
    "tpch_q14": "select round(100.00 * sum(case when p_type = 'PROMO' then l_extendedprice * (1 - l_discount) else 0 end) / sum(l_extendedprice * (1 - l_discount)), 6) as promo_revenue from lineitem, part where l_partkey = p_partkey and l_shipdate >= timestamp '1996-09-01' and l_shipdate < timestamp '1996-10-01'",
    "tpch_q15": "with revenue as (select l_suppkey as supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 4) as total_revenue from lineitem where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1996-04-01' group by l_suppkey) select s_suppkey, s_name, total_revenue from supplier, revenue where s_suppkey = supplier_no and total_revenue = (select max(total_revenue) from revenue)",
    "tpch_q22": "select c_nationkey, count(*) as numcust, round(sum(c_acctbal), 2) as totacctbal from customer where c_nationkey in (3, 7, 11, 13) and c_acctbal > (select avg(c_acctbal) from customer where c_acctbal > 0.00) and not exists (select * from orders where o_custkey = c_custkey and o_totalprice > 300000) group by c_nationkey order by c_nationkey",
    # The transactional schema's analytic texts: an order line is a line item, an entry date the order's, a delivery date the shipping date.
    "ch_q1": "select l_linenumber as ol_number, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_amount, round(avg(l_quantity), 4) as avg_qty, round(avg(l_extendedprice), 4) as avg_amount, count(*) as count_order from lineitem where l_shipdate > timestamp '1996-01-02' group by l_linenumber order by l_linenumber",
    "ch_q4": "select l_count as o_ol_cnt, count(*) as order_count from (select o_orderkey, count(*) as l_count from orders join lineitem on l_orderkey = o_orderkey where o_orderdate >= timestamp '1996-01-02' and o_orderdate < timestamp '1999-01-02' and l_shipdate >= o_orderdate group by o_orderkey) t group by l_count order by l_count",
    "ch_q6": "select round(sum(l_extendedprice), 2) as revenue from lineitem where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1998-01-01' and l_quantity between 1 and 40",
    "ch_q12": "select l_linenumber, sum(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end) as high_line_count, sum(case when o_orderpriority not in ('1-URGENT', '2-HIGH') then 1 else 0 end) as low_line_count from orders, lineitem where l_orderkey = o_orderkey and o_orderdate <= l_shipdate and l_shipdate < timestamp '2000-01-01' group by l_linenumber order by l_linenumber",
    "ch_q18": "select c_name, c_custkey, o_orderkey, o_orderdate, round(sum(l_extendedprice), 2) as amount from customer, orders, lineitem where c_custkey = o_custkey and l_orderkey = o_orderkey group by o_orderkey, c_custkey, c_name, o_orderdate having sum(l_extendedprice) > 300000 order by amount desc, o_orderdate, o_orderkey",
    "ch_q21": "select s_name, count(*) as numwait from supplier, lineitem l1, orders, nation where s_suppkey = l1.l_suppkey and o_orderkey = l1.l_orderkey and l1.l_shipdate > o_orderdate + interval '60' day and not exists (select * from lineitem l2 where l2.l_orderkey = l1.l_orderkey and l2.l_shipdate > l1.l_shipdate) and s_nationkey = n_nationkey and n_regionkey < 3 group by s_name order by numwait desc, s_name",
}.items():
    from_sql(_name, _sql)

# The other texts of that schema. An item's stock at a supplier is what all its line items there add up to, an open
# order is a new one, and a customer's nation stands for the state. Anti joins are written as not exists: a join by
# `not in` would have to broadcast its right side, whatever its size.

_STOCK = "stock as (select l_partkey as st_part, l_suppkey as st_supp, sum(l_quantity) as st_quantity, count(*) as st_orders from lineitem group by l_partkey, l_suppkey)"
#: The same in Spark's text. Nearly each row has a pair of its own, so tasks get a number of rows that their hash
#: tables hold; dealt by part alone, a join by part needs no other exchange.
_DEALT = _STOCK.replace("from lineitem", "from (select /*+ repartition({tasks}, l_partkey) */ l_partkey, l_suppkey, l_quantity from lineitem) dealt")
#: Texts that count suppliers by kinds of part: the kinds' names, and how they are made. Nearly each pair of kind and supplier is distinct, too, so these are dealt as well.
_KINDS = {"ch_q16": ("p_name, brand, p_size", "p_name, substr(p_brand, 1, 7) as brand, p_size"), "tpch_q16": ("p_brand, p_type, p_size", "p_brand, p_type, p_size")}

for _name, _sql in {
    "ch_q2": f"with {_STOCK}, least as (select st_part as m_part, min(st_quantity) as m_quantity from stock join supplier on st_supp = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name like 'EUROP%' group by st_part) select s_suppkey, s_name, n_name, p_partkey, p_name from part join stock on p_partkey = st_part join least on st_part = m_part and st_quantity = m_quantity join supplier on st_supp = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where p_type = 'SMALL' and r_name like 'EUROP%'",
    "ch_q3": "select o_orderkey, round(sum(l_extendedprice), 2) as revenue, o_orderdate from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment like 'A%' and o_orderstatus = 'O' and o_orderdate > timestamp '1997-01-02' group by o_orderkey, o_orderdate",
    "ch_q5": "select n_name, round(sum(l_extendedprice), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey and s_nationkey = c_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'EUROPE' and o_orderdate >= timestamp '1996-01-02' group by n_name",
    "ch_q7": "select n1.n_name as supp_nation, n2.n_name as cust_nation, cast(extract(year from o_orderdate) as int) as l_year, round(sum(l_extendedprice), 2) as revenue from supplier join lineitem on s_suppkey = l_suppkey join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey join nation n1 on s_nationkey = n1.n_nationkey join nation n2 on c_nationkey = n2.n_nationkey where ((n1.n_name = 'NATION_3' and n2.n_name = 'NATION_8') or (n1.n_name = 'NATION_8' and n2.n_name = 'NATION_3')) and l_shipdate between timestamp '1995-01-02' and timestamp '1999-01-02' group by n1.n_name, n2.n_name, extract(year from o_orderdate)",
    "ch_q8": "select cast(extract(year from o_orderdate) as int) as l_year, round(sum(case when n2.n_name = 'NATION_3' then l_extendedprice else 0 end) / sum(l_extendedprice), 6) as mkt_share from part join lineitem on p_partkey = l_partkey join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey join customer on c_custkey = o_custkey join nation n1 on c_nationkey = n1.n_nationkey join region on n1.n_regionkey = r_regionkey join nation n2 on s_nationkey = n2.n_nationkey where r_name = 'EUROPE' and l_partkey < 1000 and p_name like '%t' and o_orderdate between timestamp '1995-01-02' and timestamp '1999-01-02' group by extract(year from o_orderdate)",
    "ch_q9": "select n_name, cast(extract(year from o_orderdate) as int) as l_year, round(sum(l_extendedprice), 2) as sum_profit from part join lineitem on p_partkey = l_partkey join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey join nation on s_nationkey = n_nationkey where p_name like '%ring' group by n_name, extract(year from o_orderdate)",
    "ch_q10": "select c_custkey, c_name, round(sum(l_extendedprice), 2) as revenue, c_mktsegment, n_name from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join nation on c_nationkey = n_nationkey where o_orderdate >= timestamp '1997-01-02' and o_orderdate <= l_shipdate group by c_custkey, c_name, c_mktsegment, n_name",
    "ch_q11": f"with {_STOCK}, held as (select st_part, st_orders from stock join supplier on st_supp = s_suppkey join nation on s_nationkey = n_nationkey where n_name = 'NATION_3') select st_part, cast(sum(st_orders) as bigint) as ordercount from held group by st_part having sum(st_orders) > (select sum(st_orders) * 0.001 from held)",
    "ch_q13": "select c_count, count(*) as custdist from (select c_custkey, count(o_orderkey) as c_count from customer left join orders on c_custkey = o_custkey and o_orderpriority > '3' group by c_custkey) c_orders group by c_count",
    "ch_q14": "select round(100.00 * sum(case when p_type like 'PR%' then l_extendedprice else 0 end) / (1 + sum(l_extendedprice)), 6) as promo_revenue from lineitem join part on l_partkey = p_partkey where l_shipdate >= timestamp '1996-01-02' and l_shipdate < timestamp '2000-01-02'",
    "ch_q15": "with revenue as (select l_suppkey as supplier_no, round(sum(l_extendedprice), 2) as total_revenue from lineitem where l_shipdate >= timestamp '1997-01-02' group by l_suppkey) select s_suppkey, s_name, total_revenue from supplier join revenue on s_suppkey = supplier_no where total_revenue = (select max(total_revenue) from revenue)",
    "ch_q16": f"with {_STOCK} select p_name, substr(p_brand, 1, 7) as brand, p_size, count(distinct st_supp) as supplier_cnt from stock join part on p_partkey = st_part where p_name not like 'red%' and not exists (select * from supplier where s_suppkey = st_supp and s_acctbal < 0) group by p_name, substr(p_brand, 1, 7), p_size",
    "ch_q17": "select round(sum(l_extendedprice), 2) / 2.0 as avg_yearly from lineitem join (select p_partkey as t_part, avg(l_quantity) as a from part join lineitem on l_partkey = p_partkey where p_name like '%ring' group by p_partkey) t on l_partkey = t_part where l_quantity < a",
    "ch_q19": "select round(sum(l_extendedprice), 2) as revenue from lineitem join part on l_partkey = p_partkey where l_quantity between 1 and 10 and p_retailprice between 1 and 400000 and ((p_name like '%ring' and l_linenumber in (1, 2, 3)) or (p_name like '%widget' and l_linenumber in (1, 2, 4)) or (p_name like '%t' and l_linenumber in (1, 5, 3)))",
    "ch_q20": f"with {_STOCK} select s_name from supplier join nation on s_nationkey = n_nationkey where n_name in ('NATION_3', 'NATION_7') and s_suppkey in (select st_supp from stock join lineitem on l_partkey = st_part and l_suppkey = st_supp where st_part in (select p_partkey from part where p_name like 'red%') and l_shipdate > timestamp '1997-05-23' group by st_supp, st_part, st_quantity having 2 * sum(l_quantity) > st_quantity)",
    "ch_q22": "select c_nationkey, count(*) as numcust, round(sum(c_acctbal), 2) as totacctbal from customer where c_nationkey between 1 and 7 and c_acctbal > (select avg(c_acctbal) from customer where c_acctbal > 0.00 and c_nationkey between 1 and 7) and not exists (select * from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT') group by c_nationkey",
    "tpch_q2": f"with {_STOCK} select s_acctbal, s_name, n_name, p_partkey from part join stock on p_partkey = st_part join supplier on st_supp = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where p_size = 15 and r_name = 'ASIA' and st_quantity = (select min(least.st_quantity) from stock least join supplier ls on least.st_supp = ls.s_suppkey join nation ln on ls.s_nationkey = ln.n_nationkey join region lr on ln.n_regionkey = lr.r_regionkey where least.st_part = p_partkey and lr.r_name = 'ASIA') order by s_acctbal desc, n_name, s_name, p_partkey limit 100",
    "tpch_q11": f"with {_STOCK}, held as (select st_part, st_quantity * p_retailprice as worth from stock join part on st_part = p_partkey join supplier on st_supp = s_suppkey join nation on s_nationkey = n_nationkey where n_name = 'NATION_7') select st_part, round(sum(worth), 2) as value from held group by st_part having sum(worth) > (select sum(worth) * 0.001 from held)",
    "tpch_q16": f"with {_STOCK} select p_brand, p_type, p_size, count(distinct st_supp) as supplier_cnt from stock join part on p_partkey = st_part where p_brand <> 'Brand#5' and p_type not like 'MED%' and p_size in (49, 14, 23, 45, 19, 3, 36, 9) and not exists (select * from supplier where s_suppkey = st_supp and s_acctbal < 0) group by p_brand, p_type, p_size",
    "tpch_q20": f"with {_STOCK} select s_name, s_acctbal from supplier join nation on s_nationkey = n_nationkey where n_name = 'NATION_3' and s_suppkey in (select st_supp from stock where st_part in (select p_partkey from part where p_name like 'small%') and st_quantity > (select 0.5 * sum(l_quantity) from lineitem where l_partkey = st_part and l_suppkey = st_supp and l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1998-01-01'))",
    "tpch_q21": "select s_name, count(*) as numwait from supplier join lineitem l1 on s_suppkey = l1.l_suppkey join orders on o_orderkey = l1.l_orderkey join nation on s_nationkey = n_nationkey where o_orderstatus = 'F' and l1.l_shipdate > o_orderdate + interval '90' day and n_name = 'NATION_7' and exists (select * from lineitem l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey) and not exists (select * from lineitem l3 where l3.l_orderkey = l1.l_orderkey and l3.l_suppkey <> l1.l_suppkey and l3.l_shipdate > o_orderdate + interval '90' day) group by s_name order by numwait desc, s_name limit 100",
}.items():
    _text = _sql.replace(_STOCK, _DEALT)
    if _name in _KINDS:
        _keys, _made = _KINDS[_name]
        _held = _text[_text.index(" from stock ") : _text.rindex(" group by ")]
        _text = f"with {_DEALT} select {_keys}, count(distinct st_supp) as supplier_cnt from (select /*+ repartition({{tasks}}, {_keys}, st_supp) */ {_made}, st_supp{_held}) kinds group by {_keys}"
    from_sql(_name, _text, _sql, "lineitem" if _STOCK in _sql else None)
for _name in ("ch_q12",):
    ORACLE[_name] = ORACLE[_name].replace("sum(case", "cast(sum(case").replace("end) as high", "end) as bigint) as high").replace("end) as low", "end) as bigint) as low")
