"""Sources, sinks, nested data, the builder, the SQL front, plans, clustering and snapshots on small fixtures."""

import io
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from larkspark.functions.scalars import extract, int_div
from larkspark.operators import clustering, monoids, nested, relational
from larkspark.plans import coverage, suite
from larkspark.plans.builder import Rel
from larkspark.plans.cli import serve
from larkspark.plans.coverage import _STOCK, _TRUE, at, named, two, whole
from larkspark.plans.planjson import plan
from larkspark.plans.sqlfront import SqlFront, rewrite
from larkspark.sources import sinks
from larkspark.sources.catalog import Catalog, read
from larkspark.streaming.snapshots import propagate, snapshot


def attributes(**columns):
    return {"type": "bag", "inner": {"type": "record", "attributes": [{"attrName": c, "type": t if isinstance(t, dict) else {"type": t}} for c, t in columns.items()]}}


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("fixtures")
    (d / "people.csv").write_text("1;ann;7;45.0\n2;bob;3;31.5\n3;cat;9;63.5\n")
    (d / "trips.tsv").write_text("1\t10\n1\t11\n3\t10\n")
    (d / "families.json").write_text('{"name":"a","age":20,"kids":[{"k":1},{"k":5}]}\n{"name":"b","age":48,"kids":[]}\n{"name":"c","age":66}\n')
    kids = {"type": "list", "inner": {"type": "record", "attributes": [{"attrName": "k", "type": {"type": "int"}}]}}
    return Catalog(
        spark,
        json.dumps({
            "people": {"path": str(d / "people.csv"), "type": attributes(pid="int", pname="string", score="int", age="float"), "plugin": {"type": "pm-csv", "delimiter": ";"}},
            "trips": {"path": str(d / "trips.tsv"), "type": attributes(pid="int", tid="int"), "plugin": {"type": "tsv"}},
            "families": {"path": str(d / "families.json"), "type": attributes(name="string", age="int", kids=kids), "plugin": {"type": "json"}},
        }),
    )


def test_catalog_and_builder(catalog):
    people = Rel.scan(catalog, "people")
    assert people.reduce(top=("max", "pid"), s=("sum", "pid"), n=("count", F.lit(1))).df.collect() == [(3, 6, 3)]
    trips = people.filter("age > 40").join(Rel.scan(catalog, "trips"), "pid", "pid").group_by(["pname"], n=("count", F.lit(1))).sort(("n", "desc"))
    assert trips.df.collect() == [("ann", 2), ("cat", 1)]
    assert people.project("pid").union_all(people.project("pid")).df.count() == 6


def test_catalog_rejects_other_types(catalog):
    bad = Catalog(catalog.spark, {"x": {"path": "x", "type": {"type": "list", "inner": {"type": "int"}}, "plugin": {"type": "csv"}}})
    with pytest.raises(ValueError):
        bad.table("x")


def test_unnest_and_outer_unnest(catalog):
    f = catalog.table("families")
    assert sorted(r["k"] for r in nested.unnest(f, "kids", "x").select("x.k").collect()) == [1, 5]
    outer = nested.outer_unnest(f, "kids", "x", lambda x: x["k"] > 4).select("name", "x.k").collect()
    assert sorted(outer, key=str) == [("a", 5), ("b", None), ("c", None)]


def test_nest_keeps_an_order(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 3)], "k int, s string, n int")
    assert [tuple(x) for x in nested.nest(df, ["k"], "c", ["s", "n"], ["n"]).first()["c"]] == [("b", 2), ("a", 3)]


def test_sql_front(catalog):
    catalog.register()
    front = SqlFront(catalog.spark)
    assert front.sql("select sum(k) as s from families, unnest(families.kids) as e(k)").first()["s"] == 6
    assert rewrite("select x from t, unnest(t.c) as x")[0] == "select x from t, LATERAL explode(t.c) AS x(x)"
    kept = "select ', unnest(t.c) x' as s, \"unnest\" /* , unnest(t.c) x */ from t -- , unnest(t.c)"
    assert rewrite(kept) == (kept, 0)
    assert rewrite("select 1 from t, unnest(t.c) where x > 1")[0] == "select 1 from t, LATERAL explode(t.c) AS element(element) where x > 1"
    assert front.sql("select count(*) as n from families cross join unnest(kids) e where e.k > 1").first()["n"] == 1
    label = front.prepare("select count(*) as n from people where age > ?")
    assert front.execute(label, [40.0]).first()["n"] == 2
    assert "Filter" in front.explain("select * from people where pid = 1") and front.session_timings().count() == 4


def test_json_plans(catalog):
    """Plans in the grammar on own data, with attributes named by relation, by path and not at all."""
    scan = lambda name, kind: {"operator": "scan", "plugin": {"type": kind, "name": name}}
    top = {"operator": "reduce", "accumulator": ["max", "sum", "count"], "e": [named(at("pid", "people"), "top"), named(at("pid"), "s"), named(whole(1), "n")], "p": _TRUE}
    assert plan({**top, "input": scan("people", "pm-csv")}, catalog).collect() == [(3, 6, 3)]
    older = {"operator": "select", "input": scan("people", "pm-csv"), "p": two("gt", at("age", "people"), {"expression": "float", "v": 40.0})}
    assert plan(json.dumps({**top, "input": older}), catalog).collect() == [(3, 4, 2)]
    bag = {"operator": "reduce", "input": older, "accumulator": ["bagunion"], "e": [named(at("pid"), "ids")]}
    assert plan(bag, catalog).collect() == [([1, 3],)]
    joined = {"operator": "join", "p": two("eq", at("pid", "people"), at("pid", "trips")), "leftInput": scan("people", "pm-csv"), "rightInput": scan("trips", "tsv")}
    assert sorted(map(tuple, plan({"operator": "project", "input": joined, "e": [named(at("pname", "people"), "pname"), named(at("tid", "elsewhere"), "tid")]}, catalog).collect())) == [("ann", 10), ("ann", 11), ("cat", 10)]
    assert plan(joined, catalog).columns == ["pid", "pname", "score", "age", "trips.pid", "tid"]
    with pytest.raises(ValueError):
        plan({"operator": "project", "input": joined, "e": [named(at("pid", "elsewhere"), "pid")]}, catalog)
    over4 = two("gt", at("k", "families.kids"), whole(4))
    for kind, want in (("unnest", [("a", 5)]), ("outer_unnest", [("a", 5), ("b", None), ("c", None)])):
        node = {"operator": kind, "input": scan("families", "json"), "p": over4, "path": {"name": "families.kids", "e": at("kids", "families")}}
        node = {"operator": "project", "input": node, "e": [named(at("name", "families"), "name"), named(at("k", of=at("kids", "families")), "k")]}
        assert sorted(map(tuple, plan(node, catalog).collect())) == want
    for bad in ({"operator": "nonsense"}, {"operator": "select", "input": scan("people", "pm-csv"), "p": {"expression": "nonsense", "left": whole(1), "right": whole(2)}}, scan("nobody", "csv")):
        with pytest.raises(ValueError):
            plan(bad, catalog)


def test_plans_say_what_a_file_holds(catalog):
    fields = [{"attrName": c, "type": {"type": t}, "attrNo": i} for i, (c, t) in enumerate((("a", "int"), ("b", "string"), ("c", "int"), ("d", "float")))]
    node = {"operator": "scan", "plugin": {"type": "csv", "name": catalog.entries["people"]["path"], "delimiter": ";", "schema": fields, "projections": [{"attrName": "b"}, {"attrName": "d"}]}}
    assert plan(node, catalog).collect() == [("ann", 45.0), ("bob", 31.5), ("cat", 63.5)]


def test_plans_of_odd_values(catalog):
    values = {"operator": "values", "relName": "v", "values": [{"attrName": "x", "type": {"type": "int"}, "v": [7, -7, None]}, {"attrName": "d", "type": {"type": "string"}, "v": ["a", None, "b"]}]}
    made = {"q": two("div", at("x", "v"), whole(2)), "n": {"expression": "int", "isNull": True}, "day": {"expression": "date", "v": 86400000}, "z": {"expression": "datetime", "v": 0}, "none": {"expression": "is_null", "e": at("d", "v")}, "u": two("shr_logical", at("x", "v"), whole(28))}
    rows = plan({"operator": "project", "input": values, "e": [named(e, n) for n, e in made.items()]}, catalog).collect()
    assert [r["q"] for r in rows] == [3, -3, None] and [r["u"] for r in rows] == [0, 15, None] and rows[0]["n"] is None
    assert str(rows[0]["day"]) == "1970-01-02" and str(rows[0]["z"]) == "1970-01-01 00:00:00" and [r["none"] for r in rows] == [False, True, False]
    keyed = lambda name: {"operator": "project", "input": values, "e": [named(at("x", "v"), "x", name), named(at("d", "v"), "d", name)]}
    key = lambda name: {"expression": "recordConstruction", "attributes": [{"name": c, "e": at(c, name)} for c in "xd"]}
    node = {"operator": "partitioned-hashjoin-chained", "build_input": keyed("b"), "probe_input": keyed("p"), "build_k": key("b"), "probe_k": key("p")}
    assert plan(node, catalog).count() == 1  # a null within a key is equal to nothing
    first = {"operator": "sort", "input": values, "e": [{"direction": "ASC", "expression": at("x", "v"), "nulls": "FIRST"}]}
    assert [r["x"] for r in plan(first, catalog).collect()] == [None, -7, 7]


def test_plans_write(catalog, tmp_path):
    scan = {"operator": "scan", "plugin": {"type": "pm-csv", "name": "people"}}
    plan({"operator": "print", "input": scan, "plugin": {"type": "json", "name": "out"}, "e": [named(at("pname"), "who")]}, catalog, folder=str(tmp_path))
    assert sorted(r["who"] for r in catalog.spark.read.json(str(tmp_path / "out")).collect()) == ["ann", "bob", "cat"]
    for _ in range(2):
        plan({"operator": "insert-into", "name": "table", "input": scan, "plugin": {"type": "block"}, "e": [named(at("pid"), "pid")]}, catalog, folder=str(tmp_path))
    assert read(catalog.spark, str(tmp_path / "table"), "block").count() == 6
    with pytest.raises(ValueError):
        plan({"operator": "insert-into", "name": "table", "input": scan, "e": [named(at("pid"), "pid")]}, catalog)


def test_line_protocol(catalog, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"operator": "reduce", "input": {"operator": "scan", "plugin": {"type": "pm-csv", "name": "people"}}, "accumulator": ["count"], "e": [named(whole(1), "n")]}))
    bad.write_text(json.dumps({"operator": "nonsense"}))
    out = io.StringIO()
    lines = [f"prepare plan from file {good}", "execute plan from statement stmt0", "echo results on", f"execute plan from file {good}", f"execute plan from file {bad}", "nonsense", "codegen print on", "unloadall", "execute plan from statement stmt0", "quit", "never read"]
    serve(catalog, str(tmp_path), lines, out)
    said = out.getvalue().splitlines()
    assert said[:2] == ["ready", "prepared statement with label stmt0"] and said[2] == f"result in file {tmp_path}/result0"
    assert said[3:6] == ["done", '{"n":3}', f"result in file {tmp_path}/result1"]
    assert [x.split()[0] for x in said[6:]] == ["error", "error", "done", "done", "error", "quiting..."]


def test_front_settings_and_cases(catalog):
    front = SqlFront(catalog.spark, case_sensitive=True)
    catalog.register()
    with pytest.raises(AnalysisException):
        front.sql("select PID from people")
    assert SqlFront(catalog.spark).sql("select PID from people").count() == 3
    front.sql("set hwmode = gpuonly")
    assert front.settings["hwmode"] == "gpuonly"
    front.sql(f"""create table declared (pid integer, pname varchar(20), score int, age double, twice int as (pid * 2), unique (pid)) jplugin '{{"file": "{catalog.entries["people"]["path"]}", "plugin": {{"type": "csv", "delimiter": ";"}}}}'""")
    assert [r["twice"] for r in front.sql("select twice from declared order by pid").collect()] == [2, 4, 6]
    assert front.catalog.constraints("declared") == ["unique ( pid )"]


def test_bloom_filters_miss_nothing(spark):
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    halves = [relational.bloom_build(keys.filter(F.col("k") % 2 == i), "k", 1 << 16) for i in range(2)]
    passed = relational.bloom_probe(spark.range(6000).withColumnRenamed("id", "k"), relational.bloom_merge(*halves), "k", 1 << 16)
    got = {r["k"] for r in passed.collect()}
    assert got >= set(range(0, 3000, 3)) and len(got) < 1100
    assert relational.bloom_probe(keys, relational.bloom_build(keys.filter("false"), "k"), "k").count() == 0


def test_tables_of_the_session(spark, tmp_path):
    sinks.create_table_as(spark.range(3), "made_table")
    sinks.insert_into(spark.range(5), "made_table")
    assert spark.table("made_table").count() == 8
    spark.sql("drop table made_table")
    sinks.write_indexed(spark.range(1000).withColumnRenamed("id", "k"), str(tmp_path / "ix"), "k", 8)
    assert [r["k"] for r in sinks.lookup(spark, str(tmp_path / "ix"), "k", 17, 8).collect()] == [17]
    assert sinks.lookup(spark, str(tmp_path / "ix"), "k", -1, 8).count() == 0
    assert Rel.scan(spark.range(4)).not_null("id").bloom_probe(Rel.scan(spark.range(2)), "id").df.count() == 2


def test_sinks_and_changes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    for kind in ("csv", "json", "block"):
        sinks.write(df, str(tmp_path / kind), kind)
    assert read(spark, str(tmp_path / "json"), "json", df.schema).count() == 2
    assert read(spark, str(tmp_path / "block"), "block").count() == 2
    assert sinks.delete(df, F.col("s") == "a").collect() == [(2, None)]
    assert sinks.update(df, F.col("k") == 2, s=F.lit("z")).orderBy("k").collect() == [(1, "a"), (2, "z")]


def test_empty_and_null_inputs(spark):
    df = spark.createDataFrame([(None, None), (1, 7), (1, None)], "k int, v int")
    assert monoids.group_by(df, ["k"], s=("sum", "v"), n=("count", "v")).orderBy("k").collect() == [(None, None, 0), (1, 7, 1)]
    assert monoids.reduce(df.filter("false"), s=("sum", "v"), n=("count", "v")).collect() == [(None, 0)]
    assert relational.top_k(df, 1, ("v", "asc")).collect() == [(1, 7)]
    assert df.select(int_div(F.lit(-7), F.lit(2)).alias("a"), int_div(F.lit(7), F.lit(0)).alias("b")).first() == (-3, None)
    with pytest.raises(ValueError):
        extract("fortnight", F.col("k"))


@pytest.mark.parametrize("policy", ["hash", "random", "local"])
def test_split_is_a_partition(spark, policy):
    df = spark.range(1000)
    parts = relational.split(df, 3, policy)
    assert relational.union_all(*parts).orderBy("id").collect() == df.orderBy("id").collect()
    assert all(p.count() > 200 for p in parts)


def test_joins_of_repeated_keys_deal_their_pairs(spark):
    """A join's pairs may be many where its sides are small: no task makes them all, even of one key and of copies."""
    keys = [(1, 1)] * 2000 + [(2, 0), (None, 1), (1, None), (3, 3)] * 5
    probe = spark.createDataFrame([(*k, i % 50) for i, k in enumerate(keys)], "k int, kk bigint, p int")
    build = spark.createDataFrame([(*k, i) for i, k in enumerate(keys[1900:])], "j int, jj bigint, b int")
    want = probe.join(build, [probe["k"] == build["j"], probe["kk"] == build["jj"]])
    got = relational.join_many(probe, build, ["k", "kk"], ["j", "jj"], task_pairs=10000)
    assert got.columns == want.columns
    assert sorted(got.collect()) == sorted(want.collect())
    dealt = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(dealt) == 200050 and max(dealt) <= 60000
    for none in (probe.filter("k = 9"), probe.filter("k = 3")):
        assert relational.join_many(none, build.filter("j = 1"), ["k", "kk"], ["j", "jj"]).count() == 0
    with pytest.raises(ValueError):
        relational.join_many(probe, build, ["k"], ["jj"])
    with pytest.raises(ValueError):
        Rel(probe).join(Rel(build), "j", "k", "left", strategy="many")


def test_composite_key_join_is_dealt(spark):
    """Left to the sizes of its tables, the join would run in as many tasks as these have files."""
    plan = suite.QUERIES["join_composite_key"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "SortMergeJoin" in plan


def test_stock_is_dealt_by_rows(spark):
    """Stock has nearly as many rows as line items: a task gets a number of them, not a number of packed bytes."""
    assert [relational.tasks_for(spark.range(n), 500) for n in (0, 500, 1001)] == [1, 1, 3]
    users = [n for n, sql in coverage.ORACLE.items() if _STOCK in sql]
    assert len(users) == 8
    for name in users:
        plan = coverage.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_NUM") >= 1 + name.endswith("q16"), name


def test_mixture_steps_converge(spark):
    df = spark.createDataFrame([(x % 5 + 100.0 * (x % 2),) for x in range(400)], "x double")
    parts = [(0.5, [20.0], [900.0]), (0.5, [70.0], [900.0])]
    for _ in range(12):
        parts = [(r["weight"], [r["mean_x"]], [max(r["var_x"], 1e-3)]) for r in clustering.mixture_step(df, ["x"], parts).orderBy("part").collect()]
    assert [round(m[0]) for _, m, _ in parts] == [2, 102] and [round(w, 2) for w, _, _ in parts] == [0.5, 0.5]


def test_kmeans(spark):
    df = spark.createDataFrame([(x + c,) for c in (0.0, 100.0) for x in range(5)], "x double")
    assert sorted(clustering.kmeans(df, ["x"], 2)) == [[2.0], [102.0]]
    assert clustering.kmeans(df.filter("false"), ["x"], 2) == []
    many = spark.createDataFrame([(x % 5 + 100.0 * (x % 2),) for x in range(400)], "x double")
    means = sorted(g["mean"][0] for g in clustering.normal_mixture(many, ["x"], 2).gaussiansDF.collect())
    assert means == pytest.approx([2, 102], abs=0.5)


def test_snapshots(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in (1, 2):
        spark.range(n * 10).write.mode("append").parquet(source)
        propagate(spark.readStream.schema("id long").parquet(source), out, str(tmp_path / "ck")).awaitTermination()
    assert snapshot(spark, out).count() == 30
    assert snapshot(spark, out, 0).count() == 10


@pytest.mark.parametrize("name", ["ssb_q1_1", "ssb_q1_2", "ssb_q1_3", "ssb_q3_1", "ssb_q3_4", "ssb_q4_2", "ssb_q4_3", "tpch_q4", "tpch_q6"])
def test_dates_reach_the_scan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = suite.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate," in text or "GreaterThanOrEqual(l_shipdate," in text


def test_plans_push_down(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").filter("l_quantity > 45").select("l_orderkey")
    text = df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text
