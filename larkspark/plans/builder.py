"""A fluent builder of relations. Each step is a DataFrame step, so the optimizer sees the whole plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import monoids, nested, relational
from ..sources import catalog, sinks


class Rel:
    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def scan(cls, source: DataFrame | catalog.Catalog, name: str | None = None, columns: list[str] | None = None) -> Rel:
        df = source if isinstance(source, DataFrame) else source.table(name)
        return cls(df.select(*columns) if columns else df)

    @classmethod
    def values(cls, spark: SparkSession, rows: list[tuple], columns: str) -> Rel:
        return cls(catalog.values(spark, rows, columns))

    def filter(self, condition: Column | str) -> Rel:
        return Rel(self.df.filter(condition))

    def not_null(self, column: str) -> Rel:
        return Rel(self.df.filter(F.col(column).isNotNull()))

    def project(self, *expressions: str | Column, **named: Column | str) -> Rel:
        extra = [(F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in named.items()]
        return Rel(self.df.select(*expressions, *extra))

    def join(self, build: Rel, build_key, probe_key, how: str = "inner", strategy: str = "auto") -> Rel:
        """Equi join on one key or a list of keys a side. Strategy many is for inner joins whose keys repeat on both sides."""
        build_key, probe_key = ([k] if isinstance(k, str) else list(k) for k in (build_key, probe_key))
        if strategy == "many":
            if how != "inner":
                raise ValueError("strategy many is for inner joins")
            return Rel(relational.join_many(self.df, build.df, probe_key, build_key))
        on = None
        for b, p in zip(build_key, probe_key, strict=True):
            on = (self.df[p] == build.df[b]) if on is None else on & (self.df[p] == build.df[b])
        return Rel(relational.join(self.df, build.df, on, how, strategy))

    def bloom_probe(self, build: Rel, key: str) -> Rel:
        return Rel(relational.bloom_semi(self.df, build.df, key))

    def unnest(self, path: str, alias: str, where=None) -> Rel:
        return Rel(nested.unnest(self.df, path, alias, where))

    #: The names that dplyr-like frontends give to unnest and to its outer form.
    def for_each(self, path: str, alias: str, where=None) -> Rel:
        return self.unnest(path, alias, where)

    def for_all(self, path: str, alias: str, where=None) -> Rel:
        return self.outer_unnest(path, alias, where)

    def hint_rows(self, rows: int) -> Rel:
        return Rel(relational.row_count_hint(self.df, rows))

    def outer_unnest(self, path: str, alias: str, where=None) -> Rel:
        return Rel(nested.outer_unnest(self.df, path, alias, where))

    def nest(self, keys: list[str], alias: str, fields: list[str]) -> Rel:
        return Rel(nested.nest(self.df, keys, alias, fields))

    def nest_aggregates(self, keys: list[str], where: Column | None = None, zeros: bool = True, **outputs) -> Rel:
        return Rel(nested.nest_aggregates(self.df, keys, where, zeros, **outputs))

    def reduce(self, **outputs) -> Rel:
        return Rel(monoids.reduce(self.df, **outputs))

    def group_by(self, keys: list[str], **outputs) -> Rel:
        return Rel(monoids.group_by(self.df, keys, **outputs))

    def sort(self, *keys: tuple[str, str], nulls: str = "last") -> Rel:
        return Rel(relational.sort(self.df, *keys, nulls=nulls))

    def limit(self, n: int, offset: int = 0) -> Rel:
        return Rel(self.df.offset(offset).limit(n) if offset else self.df.limit(n))

    def union_all(self, *others: Rel) -> Rel:
        return Rel(relational.union_all(self.df, *[o.df for o in others]))

    def split(self, n: int, key: str | None = None, policy: str = "hash") -> list[Rel]:
        return [Rel(x) for x in relational.split(self.df, n, policy, key)]

    def router(self, n: int, policy: str = "random", key: str | None = None) -> Rel:
        return Rel(relational.exchange(self.df, n, policy, key))

    def update(self, where: Column, **values: Column) -> Rel:
        return Rel(sinks.update(self.df, where, **values))

    def print(self, path: str, kind: str = "csv") -> None:
        sinks.write(self.df, path, kind)

    def explain(self) -> str:
        return self.df._jdf.queryExecution().toString()

    def prepare(self) -> DataFrame:
        return self.df
