"""The vector index as a table keyed by ``id``, bucketed by ``source``.

Updates replace only the buckets of the sources they touch (see ``sources/buckets.py``),
so adding or changing a few files does not rewrite the index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum import config
from vellum.sources.buckets import BUCKET, _exists, overwrite_all, read_bucketed, replace_buckets

INDEX_SCHEMA = ("id STRING, source STRING, page STRING, chunk_index INT, start_index INT, "
                "text STRING, file_type STRING, file_category STRING, metadata STRING, embedding ARRAY<FLOAT>")
INDEX_COLUMNS = [c.split(" ")[0] for c in INDEX_SCHEMA.split(", ")]


def open_index(spark: SparkSession, base: str) -> DataFrame:
    """The index, or an empty one when none exists (open-or-create)."""
    return read_bucketed(spark, base, INDEX_SCHEMA).drop(BUCKET)


def has_index(spark: SparkSession, base: str) -> bool:
    return _exists(spark, base)


def _checked(rows: DataFrame, width: int) -> DataFrame:
    """Every vector must have ``width`` entries; a wrong width fails the write job."""
    return rows.withColumn("embedding", F.when(
        F.size("embedding") == width, F.col("embedding")).otherwise(
        F.raise_error(F.concat(F.lit(f"vector width differs from {width} for id "),
                               F.col("id"))))).select(*INDEX_COLUMNS)


def write_index(rows: DataFrame, base: str, width: int = config.VECTOR_WIDTH,
                buckets: int | None = None) -> str:
    """A8 (rebuild): replace the whole index with ``rows``; width and bucket count are recorded."""
    overwrite_all(_checked(rows, width), base, "source", buckets, width=width)
    return base


def update_index(spark: SparkSession, base: str, rows: DataFrame,
                 deleted_sources: DataFrame | None = None, purge_orphans: bool = True,
                 width: int = config.VECTOR_WIDTH, buckets: int | None = None) -> int:
    """A8 (incremental): merge ``rows`` into the index, reading and rewriting only the
    buckets of their sources and of ``deleted_sources``. With ``purge_orphans`` all rows of
    a batch source are replaced (J2b), else only equal ids (J2). Returns buckets replaced.
    A width or bucket count other than the index's recorded one raises ``ValueError``."""
    from vellum.operators.index import delete_sources, replace_source, upsert

    batch = _checked(rows, width)
    touched = batch.select("source")
    if deleted_sources is not None:
        touched = touched.unionByName(deleted_sources.select("source"))

    def merge(current: DataFrame) -> DataFrame:
        cur = current.select(*INDEX_COLUMNS)
        if deleted_sources is not None:
            cur = delete_sources(cur, deleted_sources)
        return replace_source(cur, batch) if purge_orphans else upsert(cur, batch)

    return replace_buckets(spark, base, INDEX_SCHEMA, "source", touched, merge, buckets, width=width)


def reset_index(spark: SparkSession, base: str) -> str:
    """An empty index."""
    overwrite_all(spark.createDataFrame([], INDEX_SCHEMA), base, "source")
    return base
