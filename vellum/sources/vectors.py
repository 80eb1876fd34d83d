"""Vectors by content: a text is embedded once per model, however often it comes back.

The table's key is the digest of the model's name and the text. A build joins its chunks' digests
with the table (digests only), calls the model for texts that are new, appends their vectors in
one commit and joins the vectors back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum import config
from vellum.operators.embed import embed
from vellum.session import cut_lineage
from vellum.sources.commits import DATA, Version, commit, current, new_folder

SCHEMA = "content STRING, embedding ARRAY<FLOAT>"
#: Appends after which the table is written anew as one.
MAX_APPENDS = 32


def read_vectors(spark: SparkSession, base: str) -> DataFrame:
    """``(content, embedding)``. Two builds that met a text at the same time may both have appended it."""
    version = current(spark, base)
    if not version or not version.folders:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(*[f"{base.rstrip('/')}/{DATA}/{f}" for f in sorted(version.folders.values())])


def _write(rows: DataFrame, base: str) -> str:
    folder = new_folder()
    rows.write.mode("errorifexists").parquet(f"{base.rstrip('/')}/{DATA}/{folder}")
    return folder


def append_vectors(rows: DataFrame, base: str, max_appends: int = MAX_APPENDS) -> None:
    """Add ``(content, embedding)`` in one commit; after ``max_appends`` of them the table becomes one folder."""
    spark = rows.sparkSession
    folder = _write(rows, base)
    entered = lambda before: {**(before.folders if before else {}), folder: folder}
    version = commit(spark, base, lambda before: Version(0, before.numbers if before else {}, entered(before)))
    if len(version.folders) <= max_appends:
        return
    merged = {f: f for f in version.folders}
    whole = _write(read_vectors(spark, base).groupBy("content").agg(F.first("embedding").alias("embedding")), base)
    commit(spark, base, lambda before: Version(0, before.numbers, {
        **{f: f for f in before.folders if f not in merged}, whole: whole}))


def embed_by_content(df: DataFrame, base: str, model: str, text: str = "text", out: str = "embedding", embedder=None,
                     dim: int = config.VECTOR_WIDTH) -> DataFrame:
    """``df`` with ``out``, the vector of ``text`` by the model of that name; the table at ``base`` is read first
    and gets what it lacks. A NULL text counts as empty. Equal texts are embedded once, also a hot one: only one
    row per digest goes to the model."""
    spark = df.sparkSession
    key = "_content"
    while key in df.columns:
        key += "_"
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{model}\n"), body), 256)
    keyed = cut_lineage(df.withColumn(key, digest))
    known = read_vectors(spark, base)
    lacking = keyed.select(key).distinct().join(known.select(F.col("content").alias(key)), key, "left_anti")
    # Texts of new digests only; a task keeps one per digest before they move.
    texts = keyed.join(lacking, key, "left_semi").groupBy(key).agg(F.first(body).alias("_text"))
    fresh = cut_lineage(embed(texts, "_text", "embedding", embedder, dim).select(F.col(key).alias("content"), "embedding"))
    if not fresh.isEmpty():
        append_vectors(fresh.select("content", F.col("embedding").cast("array<float>").alias("embedding")), base)
    wanted = (read_vectors(spark, base).join(keyed.select(F.col(key).alias("content")).distinct(), "content", "left_semi")
              .groupBy("content").agg(F.first("embedding").alias(out)))
    return keyed.join(wanted.withColumnRenamed("content", key), key).select(*df.columns, out)
