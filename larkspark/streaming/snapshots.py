"""Versioned snapshots: an append stream becomes immutable versions that queries read consistently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def propagate(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Writes each batch of a stream as one version of the table at path. Without an interval all that is there is written once.

    The batch's number is the version, and a version is written whole or not at all, so a repeated batch doesn't repeat rows.
    """

    def version(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    writer = stream.writeStream.foreachBatch(version).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of a version (the latest without one): all versions up to it."""
    df = spark.read.parquet(path)
    return (df if version is None else df.filter(F.col("version") <= version)).drop("version")
