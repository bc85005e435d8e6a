"""Runs a query's SQL in DuckDB and compares rows."""

import datetime
import math

import duckdb

from larkspark.session import TABLES


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


#: DuckDB's type -> Spark's.
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "FLOAT": "float", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "TIMESTAMP_NS": "timestamp_ntz"}


def same(df, connection, sql):
    cursor = connection.execute(sql)
    theirs = rows([c[0] for c in cursor.description], cursor.fetchall())
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    assert ours[0] == theirs[0]
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    assert {c: KINDS.get(k.upper(), k) for c, k in kinds.items()} == dict(df.dtypes)
    assert len(ours[1]) == len(theirs[1])
    assert ours[1] == theirs[1]
