"""Parquet tables of a test-data directory (``<dir>/<name>.parquet``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.operators.parallel import spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str,
          fan_out: bool = False) -> DataFrame:
    """Read one table; naming the columns up front keeps the scan's ReadSchema minimal.

    ``fan_out`` marks scans that feed Python stages; they are dealt over the tasks that
    ``spark.vellum.scanPartitions`` names, if it is set (see ``operators.parallel``)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return spread(df) if fan_out else df


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Temp views named like the tables, for SQL users."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
