"""Snapshot directories: every write goes to a new ``snap-<n>`` folder under a base path
and readers take the highest one, so a reader never sees a half-written table and a path
is never overwritten while it is being read. Listing goes through the Hadoop FileSystem
of the session, so it works on any shared store the cluster can reach."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession

_SNAP = re.compile(r"^snap-(\d{20})$")


def _fs(spark: SparkSession, base: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def snapshots(spark: SparkSession, base: str) -> list[str]:
    fs, path = _fs(spark, base)
    if not fs.exists(path):
        return []
    names = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if _SNAP.match(name) and fs.exists(st.getPath().suffix("/_SUCCESS")):
            names.append(name)
    return [f"{base.rstrip('/')}/{n}" for n in sorted(names)]


def latest(spark: SparkSession, base: str) -> str | None:
    snaps = snapshots(spark, base)
    return snaps[-1] if snaps else None


def write_snapshot(df: DataFrame, base: str, max_records_per_file: int | None = None) -> str:
    spark = df.sparkSession
    prev = snapshots(spark, base)
    seq = max([int(_SNAP.match(p.rsplit("/", 1)[-1]).group(1)) for p in prev] + [time.time_ns() // 1000])
    target = f"{base.rstrip('/')}/snap-{seq + 1:020d}"
    w = df.write.mode("errorifexists")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    w.parquet(target)
    return target


def read_latest(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """Latest snapshot, or an empty frame of ``schema`` when there is none."""
    p = latest(spark, base)
    if p is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(p)
