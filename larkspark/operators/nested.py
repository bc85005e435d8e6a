"""Nested collections: unnest, outer unnest and nest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .monoids import ZEROS, monoid


def unnest(df: DataFrame, path: str, alias: str, where: Callable[[Column], Column] | None = None) -> DataFrame:
    """A row for each element of the collection at path that satisfies where; a null or empty collection gives none."""
    items = F.filter(path, where) if where else F.col(path)
    return df.select("*", F.explode(items).alias(alias))


def outer_unnest(df: DataFrame, path: str, alias: str, where: Callable[[Column], Column] | None = None) -> DataFrame:
    """Like unnest, but a record without such an element gives one row with a null element. If the struct that holds the collection is null, the record gives none."""
    parent, _, _ = path.rpartition(".")
    if parent:
        df = df.filter(F.col(parent).isNotNull())
    items = F.filter(path, where) if where else F.col(path)
    return df.select("*", F.explode_outer(items).alias(alias))


def nest(df: DataFrame, keys: list[str], alias: str, fields: list[str], order: list[str] | None = None) -> DataFrame:
    """The inverse of unnest: the records of a key as a collection, in the order of fields, or of order first."""
    first = [f for f in order or [] if f in fields]
    record = F.struct(*first, *[f for f in fields if f not in first])
    ordered = F.array_sort(F.collect_list(record))
    if first:
        ordered = F.transform(ordered, lambda r: F.struct(*[r[f].alias(f) for f in fields]))
    return df.groupBy(*keys).agg(ordered.alias(alias))


def nest_aggregates(df: DataFrame, keys: list[str], where: Column | None = None, zeros: bool = True, **outputs: tuple[str, Column | str]) -> DataFrame:
    """A nest that aggregates: several monoids for each key, output=(monoid, expression).

    Rows that don't satisfy where still make their group; with zeros a group without any has the monoids' zeros
    (0 for sum and count, 1 for multiply, false and true for or and and), else nulls.
    """
    made = []
    for name, (m, c) in outputs.items():
        value = F.col(c) if isinstance(c, str) else c
        one = monoid(m, value if where is None else F.when(where, value))
        made.append((F.coalesce(one, F.lit(ZEROS[m])) if zeros and m in ZEROS else one).alias(name))
    return df.groupBy(*keys).agg(*made)
