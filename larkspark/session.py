"""Sessions and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session. On a cluster the session comes from outside; the settings here are what its owner should also have: AQE with skew joins, and UTC."""
    conf = {"spark.sql.shuffle.partitions": shuffle_partitions, "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    return SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Temp views of the tables; only those a query names are read."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
