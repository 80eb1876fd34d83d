"""Keep an index at the state of a corpus folder, by a stream.

The folder's changes (:mod:`vellum.sources.changes`) feed ``foreachBatch``; each micro-batch reads the files that
came or changed, once, extracts, classifies, chunks, embeds and merges them into the index by source (J2b), and
removes the chunks of files that went; only the index buckets of the batch's sources are read and rewritten, in one
commit. Replaying a batch after a failure yields the same content, since the merge is keyed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum import config


def stream_build(spark: SparkSession, corpus_root: str, index_base: str,
                 checkpoint_location: str, manifest_base: str | None = None,
                 dead_letter_base: str | None = None, available_now: bool = True,
                 keywords=None, embedder=None, dim: int = config.VECTOR_WIDTH,
                 size: int = config.CHUNK_SIZE, overlap: int = config.CHUNK_OVERLAP, extractors=None, parts: int = 8,
                 vectors: str | None = None, model: str | None = None):
    """Start the ingest stream; returns the ``StreamingQuery``.

    ``checkpoint_location`` is the stream's own, is shared by driver and executors (the source keeps its listings
    in it) and must outlive the application. With ``manifest_base`` the files (failed ones marked, deleted ones
    removed) enter the manifest of the batch build, which then agrees with the stream; with ``dead_letter_base``
    files that did not load are kept there, a folder per micro-batch, so that a replay overwrites its own.
    ``parts``: tasks that compare listings. ``vectors`` and ``model``: see :func:`vellum.plans.build.index_rows`."""
    from vellum.plans.build import extract_changed, index_rows
    from vellum.session import cut_lineage
    from vellum.sources.changes import DELETED, stream_changes
    from vellum.sources.index_store import update_index
    from vellum.sources.manifest import merge_manifest

    def per_batch(batch: DataFrame, epoch: int) -> None:
        own = batch.sparkSession
        changes = cut_lineage(batch)
        gone = changes.where(F.col("event") == DELETED).select("path")
        todo = changes.where(F.col("event") != DELETED).drop("event").withColumn("was", F.lit(None).cast("string"))
        texts, dead, read = extract_changed(todo, extractors)
        rows = cut_lineage(index_rows(texts.withColumnRenamed("path", "source"), keywords, size, overlap,
                                      embedder, dim, vectors=vectors, model=model))
        failed = dead.select("path").distinct()
        update_index(own, index_base, rows, gone.unionByName(failed).select(F.col("path").alias("source")), width=dim)
        if dead_letter_base:
            dead.write.mode("overwrite").parquet(f"{dead_letter_base.rstrip('/')}/batch={epoch}")
        if manifest_base:
            merge_manifest(own, manifest_base, todo.join(read, "path", "left"), gone)

    state = f"{checkpoint_location.rstrip('/')}/listings"
    w = (stream_changes(spark, corpus_root, state, parts=parts).writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
