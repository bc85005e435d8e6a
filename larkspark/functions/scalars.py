"""Scalar functions that Spark has no single function for."""

from __future__ import annotations

import inspect
import itertools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Integer division that truncates towards zero; null for a zero divisor."""
    whole = F.try_divide(a.cast("long") - a.cast("long") % F.nullif(b.cast("long"), F.lit(0)), b.cast("long"))
    return whole.cast("long")


def extract(unit: str, ts: Column) -> Column:
    """A calendar unit of a date or timestamp as an int. dow: Sunday is 1; isodow: Monday is 1; millisecond: of the second."""
    year = F.year(ts)
    units = {
        "year": lambda: year,
        "quarter": lambda: F.quarter(ts),
        "month": lambda: F.month(ts),
        "week": lambda: F.weekofyear(ts),
        "day": lambda: F.dayofmonth(ts),
        "dow": lambda: F.dayofweek(ts),
        "isodow": lambda: F.weekday(ts) + 1,
        "doy": lambda: F.dayofyear(ts),
        "isoyear": lambda: F.extract(F.lit("yearofweek"), ts),
        "hour": lambda: F.hour(ts),
        "minute": lambda: F.minute(ts),
        "second": lambda: F.second(ts),
        "millisecond": lambda: (F.extract(F.lit("second"), ts) * 1000).cast("long") % 1000,
        "decade": lambda: F.floor(year / 10),
        "century": lambda: F.floor((year + 99) / 100),
        "millennium": lambda: F.floor((year + 999) / 1000),
    }
    if unit not in units:
        raise ValueError(f"unknown unit {unit}")
    return units[unit]().cast("int")


def or_identity(aggregate: Column, identity) -> Column:
    """An aggregate that gives the monoid's identity instead of null for no input."""
    return F.coalesce(aggregate, F.lit(identity))


def shift(a: Column, bits: int, kind: str = "left") -> Column:
    return {"left": F.shiftleft, "right": F.shiftright, "logical": F.shiftrightunsigned}[kind](a, bits)


def merge(*collections: Column) -> Column:
    """Several lists or bags as one; null if one of them is."""
    return F.concat(*collections)


def element(collection: Column, i: int | Column) -> Column:
    """The element at a position, from 0; null beyond the ends."""
    return F.get(collection, F.lit(i) if isinstance(i, int) else i)


def register_scalar(spark: SparkSession, name: str, f: Callable, returns: str) -> None:
    """A function of pandas Series, a batch at a time."""
    spark.udf.register(name, F.pandas_udf(_typed(f, pd.Series), returns))


def register_aggregate(spark: SparkSession, name: str, f: Callable, returns: str) -> None:
    """A function of a group's pandas Series to one value: a group has to fit into a task, so prefer monoids."""
    own = dict(zip(inspect.signature(f).parameters, itertools.repeat(pd.Series), strict=False))
    f.__annotations__ = own | {"return": float}
    spark.udf.register(name, F.pandas_udf(f, returns))


def register_table(spark: SparkSession, name: str, handler: type, returns: str) -> None:
    """A class whose eval yields rows."""
    spark.udtf.register(name, F.udtf(handler, returnType=returns))


def _typed(f: Callable, kind: type) -> Callable:
    f.__annotations__ = dict.fromkeys([*inspect.signature(f).parameters, "return"], kind)
    return f
