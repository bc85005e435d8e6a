"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts that a worker turns into Python objects at once. The Arrow batches themselves are bounded by the
#: session's spark.sql.execution.arrow.maxBytesPerBatch (64 MB unless set), whatever the texts' lengths.
ROWS_AT_ONCE = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    A session on one machine that has none (as in tests) gets a folder of this machine; on a cluster such a
    folder would hold a part of each table only, so there the setting is needed.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="larkspark-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def _file(spark: SparkSession, path: str) -> tuple:
    """(file system, path) in the store that the path is in."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/larkspark-{uuid.uuid4().hex}/{name}"
    system, where = _file(spark, path.rpartition("/")[0])
    system.deleteOnExit(where)
    return path


def plain_files(spark: SparkSession, path: str) -> tuple[dict[str, str], dict[str, str]]:
    """Options to write and to read tables at path without checksum files, where the stock local store has no native code.

    There every file made on an executor starts chmod, and for that moment the executor's memory counts twice to
    those who add up processes; a checksum file is one more. Parquet's own page checksums are verified instead.
    Other stores get no options.
    """
    system, _ = _file(spark, path)
    stock = system.getClass().getName() in ("org.apache.hadoop.fs.LocalFileSystem", "org.apache.hadoop.hive.ql.io.ProxyLocalFileSystem")
    if not stock or spark.sparkContext._jvm.org.apache.hadoop.io.nativeio.NativeIO.isAvailable():
        return {}, {}
    return {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}, {"parquet.page.verify-checksum.enabled": "true"}


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: its lineage ends here, and a lost executor loses nothing of it."""
    path = shared_path(df.sparkSession, name)
    write, read = plain_files(df.sparkSession, path)
    df.write.options(**write).parquet(path)
    out = df.sparkSession.read.options(**read).schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut wrote, as soon as nothing reads them any more."""
    for df in tables:
        path = getattr(df, "shared_path", None)
        if path:
            system, where = _file(df.sparkSession, path.rpartition("/")[0])
            with suppress(Exception):  # what stays goes when the application ends
                system.delete(where, True)


Work = Callable[[list], tuple["np.ndarray | None", list[pa.Array]]]


def map_texts(docs: DataFrame, id_col: str, text_col: str, columns: str, work: Work) -> DataFrame:
    """id and columns ("name type, ..."), made from whole texts without a shuffle.

    work takes some texts (None for null) and returns (rows, arrays): an array for each column and the number
    of the text that each row belongs to, or None if there is one row for each text. Ids stay Arrow values on
    their way, so longs next to nulls keep all their digits.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(at, ROWS_AT_ONCE)
                rows, arrays = work(part.column(1).to_pylist())
                ids = part.column(0) if rows is None else part.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *arrays], ["id", *names])

    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, {columns}")


_turn: list = ["", ()]


def turn(name: str, *clear: Callable[[], None]) -> None:
    """Frees what the operator before has kept in this worker, which the next ones use, too; clear says how to free this one's."""
    if _turn[0] != name:
        for f in _turn[1]:
            f()
    _turn[:] = [name, clear]


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of rows that are sorted by their first columns (longs without nulls), one after the other."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([np.asarray(b.column(i)) for i in range(keys)], axis=1)
        edges = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
        for at, to in zip(edges, edges[1:], strict=False):
            if last is not None and not (k[at] == last).all():
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(at, to - at))
            last = k[at]
    if held:
        yield pa.Table.from_batches(held)
