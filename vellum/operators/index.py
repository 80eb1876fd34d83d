"""Incremental index maintenance.

The index is a table keyed by ``id``. Changes are keyed merges written as a new snapshot
(see ``vellum.sources.index_store``); nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum import config


def changed_files(files: DataFrame, manifest: DataFrame, path: str = "path",
                  md5: str = "md5", force: bool = False) -> DataFrame:
    """Files whose ``(path, md5)`` is not in the manifest (all files if ``force``).
    A left-anti equi-join; Spark hashes both sides on the key."""
    if force:
        return files
    return files.join(manifest.select(path, md5), [path, md5], "left_anti")


def corpus_diff(files: DataFrame, manifest: DataFrame, path: str = "path",
                md5: str = "md5") -> DataFrame:
    """``(path, state)`` with state new / changed / unchanged / deleted (full outer)."""
    cur = files.select(F.col(path).alias("_p"), F.col(md5).alias("_new"))
    old = manifest.select(F.col(path).alias("_p"), F.col(md5).alias("_old"))
    j = cur.join(old, "_p", "full_outer")
    state = (F.when(F.col("_old").isNull(), "new")
             .when(F.col("_new").isNull(), "deleted")
             .when(F.col("_old") == F.col("_new"), "unchanged")
             .otherwise("changed"))
    return j.select(F.col("_p").alias(path), state.alias("state"))


def upsert(index: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``batch`` replace index rows with the same key; others are kept.
    ``batch`` must hold one row per key (see ``dedup_latest``)."""
    cols = index.columns
    return index.join(batch.select(key), key, "left_anti").unionByName(batch.select(*cols))


def replace_source(index: DataFrame, batch: DataFrame, source: str = "source",
                   key: str = "id") -> DataFrame:
    """Every index row of a source present in ``batch`` is removed (orphans of a
    shrunk or edited file go too), then the batch is added."""
    cols = index.columns
    return (index.join(batch.select(source).distinct(), source, "left_anti")
            .join(batch.select(key), key, "left_anti")
            .unionByName(batch.select(*cols)))


def delete_sources(index: DataFrame, deleted: DataFrame, source: str = "source") -> DataFrame:
    """Remove all rows of deleted files."""
    return index.join(deleted.select(source).distinct(), source, "left_anti")


def index_count(index: DataFrame | None) -> DataFrame:
    """``n`` = number of rows; -1 when there is no index."""
    if index is None:
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
        return spark.createDataFrame([(-1,)], "n bigint")
    return index.agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def peek_sources(index: DataFrame, key: str = "id", source: str = "source",
                 category: str = "file_category", limit: int | None = None) -> DataFrame:
    """The category of each source's first row by id (missing values -> ``N/A``), over
    the whole index: one aggregate with map-side partial states. With ``limit`` only the first
    rows by id are looked at (``config.PEEK_LIMIT`` is the size of a quick look), planned as a
    top-``limit`` that keeps ``limit`` rows per task before one final merge."""
    first = index.select(key, source, category)
    if limit is not None:
        first = first.orderBy(key).limit(limit)
    return (first.select(key, F.coalesce(F.col(source), F.lit(config.MISSING_META)).alias(source),
                         F.coalesce(F.col(category), F.lit(config.MISSING_META)).alias(category))
            .groupBy(source).agg(F.min_by(category, key).alias(category)))
