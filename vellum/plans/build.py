"""Build or update the knowledge base.

listing, saved once -> candidates (path, length or time differ from the manifest's) -> their contents, read once by
the tasks that extract them -> those of another fingerprint -> classify -> chunk -> ids -> embed -> rows, saved
once -> keyed merge per bucket -> manifest. An unchanged corpus is listed, not read. Joins carry paths,
never contents. The manifest is written last, from the listing taken at the start, so a file edited meanwhile is
read again next time; a file that failed stays in it with a mark, so it is retried, and noticed when it is
deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vellum import config
from vellum.functions.metadata import scalar_json
from vellum.operators.chunk import chunk_ids, chunk_recursive
from vellum.operators.classify import classify_parts
from vellum.operators.embed import embed
from vellum.session import cut_lineage
from vellum.sources.vectors import embed_by_content


def index_rows(parts: DataFrame, keywords=None, size: int = config.CHUNK_SIZE,
               overlap: int = config.CHUNK_OVERLAP, embedder=None,
               dim: int = config.VECTOR_WIDTH, classify: str = "keyword",
               generate=None, vectors: str | None = None, model: str | None = None) -> DataFrame:
    """Parts ``(source, part_idx, page, text, file_type[, metadata])`` -> index rows ``(id, source, page,
    chunk_index, start_index, text, file_type, file_category, metadata, embedding)``. ``metadata`` is a JSON
    object per part; its scalar entries reach every chunk (NULL without one).

    Chunk ids follow the part order of each file, then chunk order; a repeated id keeps its
    latest chunk (W3), chosen among keys alone, so that chunk texts are shuffled once. With ``vectors``, a
    table of vectors by content, and the name of the ``model``, only texts that the model has not met are embedded."""
    meta = scalar_json("metadata") if "metadata" in parts.columns else F.lit(None).cast("string")
    classified = classify_parts(parts.withColumn("metadata", meta), "source", "part_idx", "text", keywords, classify, generate)
    chunks = chunk_recursive(classified, key="source", text="text", size=size, overlap=overlap,
                             keep=("part_idx", "page", "file_type", "file_category", "metadata"))
    # Read twice (keys, then rows), so the chunks are saved, not made again.
    chunks = cut_lineage(chunks)
    place = ["part_idx", "chunk_index"]
    ided = chunk_ids(chunks.select("source", "page", *place), "source", "page", place)
    latest = ided.groupBy("source", "id").agg(F.max_by(F.struct(*place), F.struct(*place)).alias("_p")).select(
        F.col("source").alias("_source"), "id", *[F.col("_p")[c].alias(f"_{c}") for c in place])
    own = chunks["source"].eqNullSafe(latest["_source"])
    for c in place:
        own = own & chunks[c].eqNullSafe(latest[f"_{c}"])
    rows = chunks.join(latest, own).select("id", "source", F.col("page").cast("string").alias("page"),
                                           "chunk_index", "start_index", "text", "file_type", "file_category", "metadata")
    if vectors is None:
        return embed(rows, "text", "embedding", embedder, dim)
    return embed_by_content(rows, vectors, model or f"hashed-{dim}", "text", "embedding", embedder, dim)


def documents_as_parts(docs: DataFrame) -> DataFrame:
    """The documents table as one-part files: ``source`` = source/doc_id, page := lang."""
    return docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source"),
                       F.lit(0).alias("part_idx"), F.col("lang").alias("page"), "text",
                       F.lit("txt").alias("file_type"))


def build_metrics(parts: DataFrame, rows: DataFrame) -> DataFrame:
    """D10 as a table ``(metric, value)``: parts, files and chunks indexed. One aggregate over the parts,
    one over the rows."""
    counted = parts.agg(F.count(F.lit(1)).alias("parts"), F.countDistinct("source").alias("files"))
    return (counted.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("parts", "files")])))
            .unionByName(rows.agg(F.lit("chunks").alias("metric"), F.count(F.lit(1)).alias("value"))))


def observed(rows: DataFrame, name: str = "build") -> tuple[DataFrame, Observation]:
    """Attach ``Observation`` metrics (chunks, characters) collected by the write itself."""
    obs = Observation(name)
    return rows.observe(obs, F.count(F.lit(1)).alias("chunks"),
                        F.sum(F.length("text")).alias("chars")), obs


def build_knowledge_base(spark, corpus_root: str, index_base: str, manifest_base: str,
                         force: bool = False, purge_orphans: bool = True, keywords=None,
                         embedder=None, dim: int = config.VECTOR_WIDTH,
                         size: int = config.CHUNK_SIZE, overlap: int = config.CHUNK_OVERLAP,
                         extractors=None, classify: str = "keyword", generate=None,
                         buckets: int | None = None, vectors: str | None = None, model: str | None = None) -> dict:
    """List -> skip unchanged (manifest) -> extract -> classify -> chunk -> ids ->
    embed -> merge into the index -> new manifest. Returns metrics.

    ``force`` rebuilds from an empty index. With ``purge_orphans`` every chunk of a changed
    or deleted file is replaced (J2b); otherwise only equal ids are (J2). Chunks of files that
    were deleted or no longer load are removed. ``vectors`` and ``model``: see :func:`index_rows`."""
    import time

    from vellum.sources.files import candidates, list_corpus
    from vellum.sources.index_store import update_index, write_index
    from vellum.sources.manifest import MANIFEST_SCHEMA, read_manifest, write_manifest

    started = time.perf_counter()
    listing = cut_lineage(list_corpus(spark, corpus_root))
    manifest = (spark.createDataFrame([], MANIFEST_SCHEMA) if force
                else read_manifest(spark, manifest_base))
    todo = cut_lineage(candidates(listing, manifest))
    parts, dead, read = extract_changed(todo, extractors)
    rows = index_rows(parts.withColumnRenamed("path", "source"), keywords, size, overlap,
                      embedder, dim, classify, generate, vectors, model)
    rows, obs = observed(rows, "index")
    rows = cut_lineage(rows)  # read by the merge and the list of touched buckets
    failed = dead.select("path").distinct()
    if force:
        write_index(rows, index_base, dim, buckets)
        replaced = None
    else:
        gone = manifest.join(listing, "path", "left_anti").select("path").unionByName(failed)
        replaced = update_index(spark, index_base, rows, gone.select(F.col("path").alias("source")), purge_orphans, dim, buckets)
    known = manifest.select("path", F.col("md5").alias("_was"))
    write_manifest(listing.join(read, "path", "left").join(known, "path", "left").withColumn("md5", F.coalesce("md5", "_was")),
                   manifest_base)
    m = obs.get
    return {"index": index_base, "chunks_indexed": int(m.get("chunks") or 0),
            "buckets_replaced": replaced, "files_failed": failed.count(),
            "seconds": round(time.perf_counter() - started, 3)}


def extract_changed(todo: DataFrame, extractors=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts and dead letters of the candidates whose fingerprint is not ``was``, and ``(path, md5)`` of these files
    (``FAILED`` for one that did not load). Each candidate is read once; what was extracted is saved."""
    from vellum.sources.extract import extract_text, split_dead_letter
    from vellum.sources.files import read_contents
    from vellum.sources.manifest import FAILED

    changed = lambda rows: read_contents(rows).where(~F.col("md5").eqNullSafe(F.col("was")) | F.col("md5").isNull())
    extracted = cut_lineage(extract_text(todo, extractors, load=changed, keep=("md5",)))
    parts, dead = split_dead_letter(extracted.drop("md5"))
    mark = F.when(F.col("error").isNotNull(), F.lit(FAILED)).otherwise(F.col("md5"))
    return parts, dead, extracted.groupBy("path").agg(F.max(mark).alias("md5"))
