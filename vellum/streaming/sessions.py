"""Persist chat turns as they arrive.

New message rows (parquet files dropped into a folder) are merged into the ``messages``
table keyed by ``(session_id, turn)``; the table is bucketed by session and only the
buckets of the batch's sessions are rewritten. A replayed micro-batch rewrites the same
rows, so the store stays exactly-once in content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources.buckets import BUCKET, read_bucketed, replace_buckets
from vellum.sources.sessions_io import MESSAGES_SCHEMA


def merge_messages(current: DataFrame, batch: DataFrame, sequence: str = "_seq") -> DataFrame:
    """Rows of ``batch`` replace those of equal (session_id, turn); of several in the batch the one with the
    highest ``sequence`` wins (ties: the greatest row, so the choice never depends on the plan)."""
    keys = ["session_id", "turn"]
    others = [c for c in current.columns if c not in keys]
    order = [F.col(sequence)] if sequence in batch.columns else []
    new = (batch.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order, *others)).alias("_r"))
           .select(*keys, *[F.col("_r")[c].alias(c) for c in others]))
    return current.join(new.select(*keys), keys, "left_anti").unionByName(
        new.select(*current.columns))


def stream_sessions(spark: SparkSession, incoming_dir: str, store_base: str,
                    checkpoint_location: str, available_now: bool = True):
    """Start the persistence stream; returns the ``StreamingQuery``. ``checkpoint_location`` is the stream's own
    and must outlive the application. Of duplicate turns the row of the latest file wins."""
    target = store_base.rstrip("/") + "/messages"

    def per_batch(batch: DataFrame, epoch: int) -> None:
        replace_buckets(batch.sparkSession, target, MESSAGES_SCHEMA, "session_id",
                        batch.select("session_id"), lambda cur: merge_messages(cur, batch))

    src = spark.readStream.schema(MESSAGES_SCHEMA).parquet(incoming_dir)
    src = src.select("*", F.struct(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("p")).alias("_seq"))
    w = src.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_messages(spark: SparkSession, store_base: str) -> DataFrame:
    return read_bucketed(spark, store_base.rstrip("/") + "/messages", MESSAGES_SCHEMA).drop(BUCKET)
