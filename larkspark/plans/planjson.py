"""Reads JSON plans into DataFrames.

A node is {"operator": kind, "input": node, ...}; joins have two inputs, unions a list, and a split that is named
again by its split_id has none. An expression is {"expression": kind, ...}; attributes are pairs of a relation
and a name, and "register_as" gives an expression's result one. Columns of intermediate DataFrames carry both, so
attributes of the same name from two relations stay apart; a result has the plain names.

What only moves data between devices passes through: exchanges, codegen and spilling are the engine's.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import extract, int_div, or_identity, shift
from ..operators import monoids, relational
from ..sources import sinks
from ..sources.catalog import Catalog, data_type, read

#: Between a relation's name and an attribute's; a dot would be a path to the engine.
_MARK = "\x1f"
#: Operators that only move or repack data.
PASSED = ("pack", "unpack", "block-to-tuples", "tuples-to-block", "mem-move-device", "mem-move-local-to", "cpu-to-gpu", "gpu-to-cpu")
JOINS = ("hashjoin-chained", "partitioned-hashjoin-chained", "out-of-gpu-join")
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda a, b: a == b,
    "neq": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "mod": lambda a, b: a % b,
    "like": F.like,
    "xor": lambda a, b: a.bitwiseXOR(b),
    "max": F.greatest,
    "min": F.least,
}
UNARY: dict[str, Callable[[Column], Column]] = {
    "neg": lambda a: -a,
    "not": lambda a: ~a,
    "is_null": lambda a: a.isNull(),
    "is_not_null": lambda a: a.isNotNull(),
    "hash": lambda a: F.xxhash64(a),
}
SHIFTS = {"shl": "left", "shr": "right", "shr_logical": "logical"}


class Scope:
    """The attributes that an expression may name: those of a DataFrame, and within a collection those of an element."""

    def __init__(self, df: DataFrame, element: tuple[str, Column, T.DataType] | None = None):
        self.df, self.element = df, element

    def names(self, relation: str | None, name: str) -> list[str]:
        exact = f"{relation}{_MARK}{name}"
        if exact in self.df.columns:
            return [exact]
        return [c for c in self.df.columns if c.rpartition(_MARK)[2] == name]

    def find(self, relation: str | None, name: str) -> Column:
        if self.element:
            path, value, kind = self.element
            if name == path or (relation in (path, None) and name == path.rpartition(".")[2]):
                return value
            if isinstance(kind, T.StructType) and name in kind.names and relation in (path, None):
                return value[name]
        found = self.names(relation, name)
        if len(found) != 1:
            raise ValueError(f"{len(found)} attributes {name} for relation {relation}")
        return F.col(f"`{found[0]}`")


class PlanReader:
    """Reads one plan. args are the values of its placeholders; folder is where its sinks write relative names."""

    def __init__(self, catalog: Catalog, args: list | None = None, folder: str | None = None):
        self.catalog, self.args, self.folder = catalog, args or [], folder
        self.splits: dict[int, list[DataFrame]] = {}

    # Expressions

    def expression(self, e: dict, scope: Scope) -> Column:
        kind = e["expression"]
        if kind in ("bool", "int", "int64", "float", "string", "dstring", "date", "datetime"):
            return self.literal(kind, None if e.get("isNull") else e["v"])
        if kind == "recordProjection":
            return self.projection(e, scope)
        if kind == "recordConstruction":
            return F.struct(*[self.expression(a["e"], scope).alias(a["name"]) for a in e["attributes"]])
        if kind == "if":
            cond, then, other = (self.expression(e[x], scope) for x in ("cond", "then", "else"))
            return F.when(cond, then).otherwise(other)
        if kind == "cast":
            return self.expression(e["e"], scope).cast(data_type(e["type"]))
        if kind == "extract":
            return extract(e["unitrange"].lower(), self.expression(e["e"], scope))
        if kind == "placeholder":
            return F.lit(self.args[e["index"]]).cast(data_type(e["type"]))
        if kind == "rand":
            return F.rand(e.get("seed", 0))
        if kind == "argument":
            return F.struct(*[F.col(f"`{c}`").alias(c.rpartition(_MARK)[2]) for c in scope.df.columns])
        if kind in UNARY:
            return UNARY[kind](self.expression(e["e"], scope))
        left, right = (self.expression(e[x], scope) for x in ("left", "right"))
        if kind == "div":  # of whole numbers the quotient is cut towards zero
            whole = all(isinstance(f.dataType, T.IntegralType) for f in self.types(scope, left, right))
            return int_div(left, right) if whole else left / right
        if kind in SHIFTS:
            return shift(left, e["right"]["v"], SHIFTS[kind])
        if kind in BINARY:
            return BINARY[kind](left, right)
        raise ValueError(f"unknown expression {kind}")

    def types(self, scope: Scope, *columns: Column) -> list[T.StructField]:
        if scope.element:  # types within a collection: those of its elements
            columns = tuple(F.transform(F.array(F.lit(None).cast(scope.element[2])), lambda x, c=c: c)[0] for c in columns)
        return scope.df.select(*[c.alias(f"x{i}") for i, c in enumerate(columns)]).schema.fields

    @staticmethod
    def literal(kind: str, value: object) -> Column:
        if kind in ("date", "datetime") and isinstance(value, int):  # milliseconds since 1970
            stamp = F.timestamp_millis(F.lit(value))
            return F.to_date(stamp) if kind == "date" else F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(stamp, F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSS"))
        return F.lit(value).cast(data_type(kind))

    def projection(self, e: dict, scope: Scope) -> Column:
        attribute = e["attribute"]
        relation, name = (attribute.get("relName"), attribute["attrName"]) if isinstance(attribute, dict) else (None, attribute)
        if e["e"]["expression"] == "argument":
            return scope.find(relation, name)
        return self.expression(e["e"], scope)[name]

    def named(self, e: dict, scope: Scope, i: int = 0) -> Column:
        """An expression under the name that it is registered as, or else that of the attribute that it is."""
        to = e.get("register_as")
        if not to:
            attribute = e.get("attribute")
            to = attribute if isinstance(attribute, dict) else {"attrName": attribute or f"_{i}"}
        return self.expression(e, scope).alias(f"{to.get('relName')}{_MARK}{to['attrName']}")

    def keys(self, e: dict, scope: Scope) -> list[Column]:
        """A key's parts: one that is a record is compared part by part, so a null in it is equal to nothing."""
        if e["expression"] == "recordConstruction":
            return [k for a in e["attributes"] for k in self.keys(a["e"], scope)]
        return [self.expression(e, scope)]

    # Operators

    def read(self, node: dict) -> DataFrame:
        kind = node["operator"]
        if kind in PASSED:
            return self.read(node["input"])
        if kind in JOINS:
            return self.equi_join(node, kind)
        method = getattr(self, "op_" + kind.replace("-", "_"), None)
        if method is None:
            raise ValueError(f"unknown operator {kind}")
        return method(node)

    def op_scan(self, node: dict) -> DataFrame:
        plugin = node["plugin"]
        name, wanted = plugin["name"], [p["attrName"] for p in plugin.get("projections", [])]
        df = self.relation(plugin)
        return df.select(*[F.col(f"`{c}`").alias(f"{name}{_MARK}{c}") for c in wanted or df.columns])

    def relation(self, plugin: dict) -> DataFrame:
        name = plugin["name"]
        entry = self.catalog.find(name)
        if plugin.get("schema"):  # the plan says what the file holds
            fields = T.StructType([T.StructField(a["attrName"], data_type(a["type"])) for a in sorted(plugin["schema"], key=lambda a: a.get("attrNo", 0))])
            path = self.catalog.entries[entry]["path"] if entry else name
            return read(self.catalog.spark, path, plugin["type"], fields, **self.catalog.options(plugin))
        if entry is None:
            raise ValueError(f"unknown relation {name}")
        return self.catalog.table(entry)

    def op_values(self, node: dict) -> DataFrame:
        columns = node["values"]
        kinds = T.StructType([T.StructField(f"{node['relName']}{_MARK}{c['attrName']}", data_type(c["type"])) for c in columns])
        return self.catalog.spark.createDataFrame([*zip(*[c["v"] for c in columns], strict=True)], kinds)

    def op_dict_scan(self, node: dict) -> DataFrame:
        name, attribute = node["relName"], node["attrName"]
        df = relational.dictionary_scan(self.relation({"name": name}), attribute, node["regex"])
        return df.select(F.col(attribute).alias(f"{name}{_MARK}{attribute}"))

    def op_select(self, node: dict) -> DataFrame:
        df = self.read(node["input"])
        return df.filter(self.expression(node["p"], Scope(df)))

    def op_project(self, node: dict) -> DataFrame:
        df = self.read(node["input"])
        return df.select(*[self.named(e, Scope(df), i) for i, e in enumerate(node["e"])])

    def op_print(self, node: dict) -> DataFrame:
        df = self.op_project(node) if node.get("e") else self.read(node["input"])
        plugin = node.get("plugin") or {}
        if self.folder and plugin.get("name"):
            sinks.write(plain(df), f"{self.folder}/{plugin['name']}", plugin.get("type", "pm-csv"))
        return df

    def op_insert_into(self, node: dict) -> DataFrame:
        """Appends to a relation of the catalog, or else to a name in the folder; returns what it inserts."""
        df = self.op_project(node)
        entry = self.catalog.find(node["name"])
        if entry is None and not self.folder:
            raise ValueError(f"unknown relation {node['name']}")
        path = self.catalog.entries[entry]["path"] if entry else f"{self.folder}/{node['name']}"
        sinks.write(plain(df), path, (node.get("plugin") or {}).get("type", "pm-csv"), "append")
        return df

    def op_reduce(self, node: dict) -> DataFrame:
        df = self.read(node["input"])
        scope = Scope(df)
        df = df.filter(self.expression(node["p"], scope)) if node.get("p") else df
        made = [self.aggregate(m, e, scope, i) for i, (m, e) in enumerate(zip(node["accumulator"], node["e"], strict=True))]
        return df.agg(*made)

    def aggregate(self, name: str, e: dict, scope: Scope, i: int) -> Column:
        to = e.get("register_as") or {"attrName": f"_{i}"}
        return monoids.monoid(name, self.expression(e, scope)).alias(f"{to.get('relName')}{_MARK}{to['attrName']}")

    def op_groupby(self, node: dict) -> DataFrame:
        df = self.read(node["input"])
        scope = Scope(df)
        keys = [self.named(k, scope, i) for i, k in enumerate(node["k"])]
        made = [self.aggregate(a["m"], a["e"], scope, i) for i, a in enumerate(node.get("e", []))]
        return df.groupBy(*keys).agg(*made) if made else df.select(*keys).distinct()

    op_hashgroupby_chained = op_groupby

    def op_nest(self, node: dict) -> DataFrame:
        """Groups by f; an aggregate of rows that p leaves out, or whose g is null, is its monoid's zero."""
        df = self.read(node["input"])
        scope = Scope(df)
        takes = self.expression(node["p"], scope)
        if node.get("g"):
            takes &= fold(lambda a, b: a & b, [k.isNotNull() for k in self.keys(node["g"], scope)])
        made = []
        for m, label, e in zip(node["accumulator"], node["aggrLabels"], node["e"], strict=True):
            one = monoids.monoid(m, F.when(takes, self.expression(e, scope)))
            made.append((or_identity(one, monoids.ZEROS[m]) if m in monoids.ZEROS else one).alias(f"radixNest{_MARK}{label}"))
        return df.groupBy(*self.group_keys(node["f"], scope)).agg(*made)

    def group_keys(self, f: dict, scope: Scope) -> list[Column]:
        if f["expression"] == "recordConstruction":
            return [self.expression(a["e"], scope).alias(f"radixNest{_MARK}{a['name']}") for a in f["attributes"]]
        return [self.named(f, scope)]

    def equi_join(self, node: dict, kind: str) -> DataFrame:
        build, probe = self.read(node["build_input"]), self.read(node["probe_input"])
        sides = []
        for side, df in (("build", build), ("probe", probe)):
            scope = Scope(df)
            key = {"expression": "recordProjection", "e": {"expression": "argument"}, "attribute": node[f"{side}_hash"]["attribute"]} if kind == "out-of-gpu-join" and f"{side}_k" not in node else node[f"{side}_k"]
            keys = self.keys(key, scope)
            if node.get(f"{side}_k_minor"):
                keys += self.keys(node[f"{side}_k_minor"], scope)
            kept = [x.get("original") or x["e"] for x in node.get(f"{side}_e", [])]
            columns = [self.named(e, scope, i) for i, e in enumerate(kept)] if kept else [F.col(f"`{c}`") for c in df.columns]
            sides.append(df.select(*columns, *[k.alias(f"key{_MARK}{side}{i}") for i, k in enumerate(keys)]))
        return self.joined(*sides, [(f"key{_MARK}build{i}", f"key{_MARK}probe{i}") for i in range(len(keys))], strategy={"hashjoin-chained": "auto"}.get(kind, "shuffle_hash"))

    def op_join(self, node: dict) -> DataFrame:
        """p is an equality, or several: each has an attribute of the left input on its left side."""
        left, right = self.read(node["leftInput"]), self.read(node["rightInput"])
        pairs, todo = [], [node["p"]]
        while todo:
            p = todo.pop()
            if p["expression"] == "and":
                todo += [p["right"], p["left"]]
            elif p["expression"] == "eq":
                pairs.append((p["left"], p["right"]))
            else:
                raise ValueError("a join's predicate is made of equalities")
        sides = []
        for df, side, i in ((left, "leftFields", 0), (right, "rightFields", 1)):
            scope = Scope(df)
            columns = [self.named(e, scope, k) for k, e in enumerate(node[side])] if node.get(side) else [F.col(f"`{c}`") for c in df.columns]
            sides.append(df.select(*columns, *[k.alias(f"key{_MARK}{i}{n}_{m}") for n, p in enumerate(pairs) for m, k in enumerate(self.keys(p[i], scope))]))
        own, other = ([c for c in s.columns if c.startswith(f"key{_MARK}")] for s in sides)
        return self.joined(sides[1], sides[0], [*zip(other, own, strict=True)])

    @staticmethod
    def joined(build: DataFrame, probe: DataFrame, on: list[tuple[str, str]], strategy: str = "auto") -> DataFrame:
        condition = fold(lambda a, b: a & b, [F.col(f"`{p}`") == F.col(f"`{b}`") for b, p in on])
        out = relational.join(probe, build, condition, "inner", strategy)
        kept = [c for c in out.columns if not c.startswith(f"key{_MARK}")]
        return out.select(*[F.col(f"`{c}`") for c in kept])

    def op_unnest(self, node: dict, outer: bool = False) -> DataFrame:
        """A row for each element that satisfies p; the element has the path's name, and its fields that relation."""
        df = self.read(node["input"])
        scope, alias = Scope(df), node["path"].get("name") or "element"
        items = self.expression(node["path"]["e"], scope)
        kind = df.select(items.alias("x")).schema["x"].dataType.elementType
        if node.get("p"):  # inside, so that in the outer form a record without such an element stays
            items = F.filter(items, lambda x: self.expression(node["p"], Scope(df, (alias, x, kind))))
        relation, _, name = alias.rpartition(".")
        out = df.select("*", (F.explode_outer if outer else F.explode)(items).alias("__element"))
        fields = [F.col(f"__element.`{c}`").alias(f"{alias}{_MARK}{c}") for c in kind.names] if isinstance(kind, T.StructType) else []
        kept = [F.col(f"`{c}`") for c in df.columns if c != f"{relation}{_MARK}{name}"]
        return out.select(*kept, F.col("__element").alias(f"{relation or alias}{_MARK}{name}"), *fields)

    def op_outer_unnest(self, node: dict) -> DataFrame:
        """Like unnest, but a record without such an element gives one row with nulls; one whose inner record is null none."""
        df, path = node["input"], node["path"]["e"]
        inner = path.get("e", {})
        if inner.get("expression") == "recordProjection":
            df = {"operator": "select", "input": df, "p": {"expression": "is_not_null", "e": inner}}
        return self.op_unnest({**node, "input": df}, outer=True)

    def op_sort(self, node: dict) -> DataFrame:
        df = self.read(node["input"])
        scope, order = Scope(df), []
        for s in node["e"]:
            column, nulls = self.expression(s["expression"], scope), s.get("nulls", "LAST")
            if s["direction"] != "NONE":
                order.append({("ASC", "LAST"): column.asc_nulls_last, ("DESC", "LAST"): column.desc_nulls_last, ("ASC", "FIRST"): column.asc_nulls_first, ("DESC", "FIRST"): column.desc_nulls_first}[s["direction"], nulls]())
        return df.orderBy(*order) if order else df

    def op_union_all(self, node: dict) -> DataFrame:
        first, *others = [self.read(x) for x in node["input"]]
        return fold(lambda a, b: a.union(b), others, first)

    def op_split(self, node: dict) -> DataFrame:
        """The next part of the split with this id; the node that names it first has its input."""
        n = node["split_id"]
        if n not in self.splits:
            df = self.read(node["input"])
            key = self.expression(node["target"], Scope(df)) if node.get("target") else None
            self.splits[n] = relational.split(df, node["numOfParents"], "hash" if key is not None else "local" if node.get("numa_local") or node.get("rand_local_cpu") else "random", key)
        return self.splits[n].pop(0)

    def op_exchange(self, node: dict) -> DataFrame:
        df = self.read(node["input"])
        n = node.get("numOfParents", 8)
        if node.get("target"):
            return df.repartition(n, self.expression(node["target"], Scope(df)))
        return relational.exchange(df, n, "local" if node.get("numa_local") or node.get("rand_local_cpu") else "random")

    op_router = op_exchange

    def op_hash_rearrange(self, node: dict) -> DataFrame:
        """Deals rows to buckets by the hash of e; hashProject names the bucket's number."""
        df = self.read(node["input"])
        scope, n = Scope(df), node.get("buckets", 64)
        bucket = F.pmod(F.xxhash64(self.expression(node["e"], scope)), F.lit(n)).cast("int")
        columns = [self.named(p, scope, i) if "expression" in p else F.col(f"`{scope.names(p.get('relName'), p['attrName'])[0]}`") for i, p in enumerate(node["projections"])]
        to = node.get("hashProject") or {"relName": "hash", "attrName": "__bucket"}
        name = f"{to.get('relName')}{_MARK}{to['attrName']}"
        out = df.select(*columns, bucket.alias(name)).repartition(n, F.col(f"`{name}`"))
        return out if node.get("hashProject") else out.drop(name)

    op_hash_pack = op_hash_rearrange

    def op_mem_broadcast_device(self, node: dict) -> DataFrame:
        """A copy for every task, if the optimizer's estimate of its size is small; else it stays dealt out."""
        df = self.read(node["input"])
        return F.broadcast(df) if relational.size_estimate(df) <= relational.BROADCAST_BYTES else df


def plain(df: DataFrame) -> DataFrame:
    """df with attributes' names alone; of equal ones the later ones keep their relation."""
    seen: set[str] = set()
    names = []
    for c in df.columns:
        relation, _, name = c.rpartition(_MARK)
        names.append(f"{relation}.{name}" if name in seen else name)
        seen.add(name)
    return df.toDF(*names)


def plan(node: dict | str, catalog: Catalog, args: list | None = None, folder: str | None = None) -> DataFrame:
    """The result of a plan. Its sinks write when it is read: prints only into a folder that is given."""
    return plain(PlanReader(catalog, args, folder).read(json.loads(node) if isinstance(node, str) else node))
