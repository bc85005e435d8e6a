"""Sinks, and changes to tables of immutable files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, kind: str = "csv", mode: str = "errorifexists", **options) -> None:
    known = {"pm-csv": "csv", "block": "parquet", "bincol": "parquet", "distributed-block": "parquet"}
    df.write.format(known.get(kind, kind)).mode(mode).options(**options).save(path)


def write_json_document(df: DataFrame, path: str) -> None:
    """One array of records in one file, for results: all rows meet in one task."""
    rows = F.array_sort(F.collect_list(F.struct(*df.columns)))
    df.agg(F.to_json(rows).alias("value")).write.text(path)


def write_indexed(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """A table in folders by the hash of its key, sorted by it: lookup reads one folder, and of that the row groups that may hold the key."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    df.withColumn("__bucket", bucket).repartition("__bucket").sortWithinPartitions("__bucket", key).write.partitionBy("__bucket").parquet(path)


def lookup(spark: SparkSession, path: str, key: str, value: object, buckets: int = 64) -> DataFrame:
    """The rows of write_indexed's table with a key's value. The value has to be of the key's type."""
    df = spark.read.parquet(path)
    kind = df.schema[key].dataType
    number = spark.range(1).select(F.pmod(F.xxhash64(F.lit(value).cast(kind)), F.lit(buckets))).first()[0]
    return df.filter((F.col("__bucket") == int(number)) & (F.col(key) == F.lit(value).cast(kind))).drop("__bucket")


def create_table_as(df: DataFrame, name: str, kind: str = "parquet") -> None:
    df.write.format(kind).saveAsTable(name)


def insert_into(df: DataFrame, name: str) -> None:
    """Appends by column names, not by positions."""
    df.select(*df.sparkSession.table(name).columns).write.insertInto(name)


def update(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """df with new values in the rows where the condition is true. Files are immutable: write the result to another path."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def delete(df: DataFrame, where: Column) -> DataFrame:
    """The rows for which the condition isn't true."""
    return df.filter(~F.coalesce(where, F.lit(False)))
