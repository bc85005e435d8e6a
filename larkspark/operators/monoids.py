"""Aggregation by monoids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONOIDS = {
    "sum": F.sum,
    "count": F.count,
    "multiply": F.product,
    "max": F.max,
    "min": F.min,
    "avg": F.avg,
    "or": F.bool_or,
    "and": F.bool_and,
    "bitor": F.bit_or,
    "bitand": F.bit_and,
    "bagunion": lambda c: F.array_sort(F.collect_list(c)),
    "union": lambda c: F.array_sort(F.collect_set(c)),
    "append": lambda c: F.array_sort(F.collect_list(c)),
}


def append(column: Column | str, *order: Column | str) -> Column:
    """The values as a list in the order of other columns; without any in that of the values themselves."""
    value = F.col(column) if isinstance(column, str) else column
    if not order:
        return F.array_sort(F.collect_list(value))
    keys = [(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)]
    return F.transform(F.array_sort(F.collect_list(F.struct(*keys, value.alias("v")))), lambda r: r["v"])


#: A monoid's result over nothing.
ZEROS = {"sum": 0, "count": 0, "multiply": 1, "or": False, "and": True}


def monoid(name: str, column: Column | str) -> Column:
    if name not in MONOIDS:
        raise ValueError(f"unknown monoid {name}")
    return MONOIDS[name](F.col(column) if isinstance(column, str) else column)


def reduce(df: DataFrame, **outputs: tuple[str, Column | str]) -> DataFrame:
    """One row: several monoids in one pass, output=(monoid, expression)."""
    return df.agg(*[monoid(m, c).alias(name) for name, (m, c) in outputs.items()])


def group_by(df: DataFrame, keys: list[str], **outputs: tuple[str, Column | str]) -> DataFrame:
    """Keys and monoids. Without outputs the distinct keys. Partial aggregates run before the shuffle."""
    if not outputs:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*[monoid(m, c).alias(name) for name, (m, c) in outputs.items()])


def group_by_salted(df: DataFrame, keys: list[str], salts: int, **outputs: tuple[str, Column | str]) -> DataFrame:
    """Like group_by for monoids whose partial results are combined by themselves, in two steps: a hot key's partial sums meet in several tasks first."""
    again = {"count": "sum"}
    if any(m not in ("sum", "count", "min", "max", "or", "and", "bitor", "bitand", "multiply") for m, _ in outputs.values()):
        raise ValueError("only monoids of fixed size are combined in two steps")
    part = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts))).groupBy(*keys, "__salt").agg(*[monoid(m, c).alias(n) for n, (m, c) in outputs.items()])
    return part.groupBy(*keys).agg(*[monoid(again.get(m, m), n).alias(n) for n, (m, _) in outputs.items()])
