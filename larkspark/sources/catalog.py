"""Catalogs: relations that are declared by JSON types, and their readers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Type names of plans and catalogs.
SCALARS = {"bool": T.BooleanType(), "int": T.IntegerType(), "int64": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "dstring": T.StringType(), "date": T.DateType(), "datetime": T.TimestampNTZType()}


def data_type(spec: dict | str) -> T.DataType:
    """The Spark type of a JSON type. Bags, lists and sets are arrays; a missing path reads as null."""
    name = spec if isinstance(spec, str) else spec["type"]
    if name in SCALARS:
        return SCALARS[name]
    if name in ("bag", "list", "set"):
        return T.ArrayType(data_type(spec["inner"]))
    if name == "record":
        return T.StructType([T.StructField(a.get("attrName") or a["name"], data_type(a["type"])) for a in spec["attributes"]])
    raise ValueError(f"unknown type {name}")


#: SQL names of types that aren't the engine's.
_SQL = {"integer": "int", "varchar": "string", "char": "string", "text": "string", "datetime": "timestamp_ntz", "real": "double"}


def ddl_schema(columns: str) -> T.StructType:
    """A schema from column declarations of SQL, such as "a integer, b varchar(5)"."""
    fields = []
    for name, kind in re.findall(r"(\S+)\s+((?:\([^)]*\)|[^,(])+)(?:,|$)", columns):
        word = re.match(r"\w+", kind)[0].lower()
        fields.append(f"{name} {_SQL.get(word, kind)}")
    return T.StructType.fromDDL(", ".join(fields))


def schema(spec: dict) -> T.StructType:
    """A relation's schema: its type has to be a bag of records."""
    if spec["type"] != "bag" or spec["inner"]["type"] != "record":
        raise ValueError("a relation is a bag of records")
    return data_type(spec["inner"])


#: Names of columnar and row formats of other engines, which are Parquet here.
_PARQUET = ("block", "distributed-block", "bincol", "binrow", "binary-block", "registered-block")
_REGISTERED: dict[str, Callable[[SparkSession, str, T.StructType | None], DataFrame]] = {}


def register_format(kind: str, reader: Callable[[SparkSession, str, T.StructType | None], DataFrame]) -> None:
    """Adds a kind of source: reader(spark, path, columns) gives its DataFrame."""
    _REGISTERED[kind] = reader


def read(spark: SparkSession, path: str, kind: str, columns: T.StructType | None = None, **options) -> DataFrame:
    """Reads a source.

    kind: csv, tsv, json (a record a line), json-document, block (Parquet; distributed: a folder of files, with
    columns from folders named column=value), snapshots (versions of a stream), registry (a table or view of the
    session), result (what a query wrote), dynamic (by the path's ending), a kind that was registered, or any format
    that Spark knows. Without columns a csv has a header or numbered columns, and types are inferred.
    """
    if kind in _REGISTERED:
        return _REGISTERED[kind](spark, path, columns)
    if kind == "dynamic":
        ending = path.rstrip("/").rpartition(".")[2]
        kind = {"csv": "csv", "tbl": "csv", "tsv": "tsv", "json": "json", "orc": "orc", "txt": "text"}.get(ending, "block")
    if kind == "registry":
        df = spark.table(path)
        return df.select(*columns.names) if columns is not None else df
    if kind == "snapshots":
        from ..streaming.snapshots import snapshot

        df = snapshot(spark, path, options.get("version"))
        return df.select(*columns.names) if columns is not None else df
    reader = spark.read if columns is None else spark.read.schema(columns)
    if kind in ("csv", "pm-csv", "tsv"):
        sep = "\t" if kind == "tsv" else options.pop("delimiter", ";")
        header = options.pop("header", False)
        quote = options.pop("quote", '"')
        return reader.csv(path, sep=sep, header=header, quote=quote, inferSchema=columns is None, **options)
    if kind in ("json", "result"):
        return reader.json(path, **options)
    if kind == "json-document":
        return reader.json(path, multiLine=True, **options)
    known = {"binary": "binaryFile"} | dict.fromkeys(_PARQUET, "parquet")
    return reader.format(known.get(kind, kind)).options(**options).load(path)


def values(spark: SparkSession, rows: list[tuple], columns: str | T.StructType) -> DataFrame:
    return spark.createDataFrame(rows, columns)


class Catalog:
    """Named relations: {name: {path, type, plugin: {type, ...}, constraints}}."""

    def __init__(self, spark: SparkSession, entries: dict | str):
        self.spark = spark
        self.entries = json.loads(entries) if isinstance(entries, str) else entries

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        """Reads a catalog file through Spark, so the path may be in any store it knows."""
        return cls(spark, spark.read.text(path, wholetext=True).first()[0])

    def table(self, name: str) -> DataFrame:
        entry = self.entries[name]
        plugin = entry.get("plugin") or {"type": "block"}
        return read(self.spark, entry["path"], plugin["type"], schema(entry["type"]) if entry.get("type") else None, **self.options(plugin))

    @staticmethod
    def options(plugin: dict) -> dict:
        return {("header" if k == "hasHeader" else k): v for k, v in plugin.items() if k in ("delimiter", "header", "hasHeader", "quote", "version")}

    def find(self, name: str) -> str | None:
        """The entry of that name, or the one whose path or attributes have it for a relation's name."""
        if name in self.entries:
            return name
        for key, entry in self.entries.items():
            attributes = (entry.get("type") or {}).get("inner", {}).get("attributes", [])
            if entry.get("path") == name or any(a.get("relName") == name for a in attributes):
                return key
        return None

    def register(self) -> None:
        for name in self.entries:
            self.table(name).createOrReplaceTempView(name)

    def constraints(self, name: str) -> list[dict]:
        """Keys and ranges, as information; Spark's statistics come from ANALYZE TABLE."""
        return list(self.entries[name].get("constraints") or [])
