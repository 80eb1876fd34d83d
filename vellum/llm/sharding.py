"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Rows with equal texts form a group; a group is placed whole unless it exceeds one shard's share.
Each group goes to the shard where the dot product of its (bytes, tokens, rows), each as a part
of a shard's capacity, with the shard's residual capacity is highest, largest group first.

Placement itself is sequential, so what it places is bounded: groups above 1/``FINE`` of a
capacity (at most 3 * shards * ``FINE``) are placed one by one, all smaller ones are first
dealt by hash into ``FINE`` lots a shard, whose summed vectors are placed like groups. A group
above one capacity (a text that makes up a third of all rows, say) is split by the number of the saved row into
pieces of about an eighth of a capacity, also where its rows are equal in all columns. Everything that grows with the rows (figures, group
sums, slots) stays in Spark.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, read, word_array

FINE = 512
PIECES = 8
#: Rows of one numbering bucket, about.
BUCKET_ROWS = 20_000


def place(vectors: np.ndarray, shards: int, weights: tuple[float, ...] = (4.0, 1.0, 1.0)) -> np.ndarray:
    """Shard of every vector (rows: units, columns: dimensions): largest first, each where the
    weighted dot product with the residual capacity is highest; ties to the lowest shard."""
    capacity = np.maximum(vectors.sum(axis=0) / shards, 1e-9)
    part = vectors / capacity
    residual = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), np.int32)
    scaled = part * np.array(weights)
    for k in np.argsort(-scaled.sum(axis=1), kind="stable"):
        out[k] = s = int(np.argmax(residual @ scaled[k]))
        residual[s] -= part[k]
    return out


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size (UTF-8 bytes plus 8), text_crc32, n_tokens (words),
    shard, slot (gapless from 0 in each shard).

    A null text counts as empty; null and empty texts are one group. Repeated rows are rows of
    their own. An empty table gives none. Ties in placement go to the lowest shard, ties in
    numbering (rows equal in id and text) to either row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sharding")
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = scratch.save(docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(raw) + F.lit(8)).cast("bigint").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"), F.size(word_array(F.col(text))).cast("bigint").alias("n_tokens"),
        F.xxhash64(raw).alias("g1"), F.xxhash64(F.lit(1), raw).alias("g2"), F.xxhash64(F.monotonically_increasing_id()).alias("h")), "rows")

    groups = scratch.save(rows.groupBy("g1", "g2").agg(
        F.sum("size").alias("size"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n")), "groups")
    total = groups.agg(F.sum("size"), F.sum("n_tokens"), F.sum("n")).first()
    if not total[2]:
        return rows.select("doc_id", "size", "text_crc32", "n_tokens", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    ratio = F.greatest(*(F.col(c) * (shards / max(1, t)) for c, t in zip(("size", "n_tokens", "n"), total, strict=True)))
    large = groups.select("g1", "g2", ratio.alias("ratio")).where(F.col("ratio") > 1 / FINE).orderBy("g1", "g2").toPandas()
    large["pieces"] = np.where(large.ratio > 1, np.ceil(large.ratio * PIECES), 1).astype(np.int64)
    large["base"] = shards * FINE + np.concatenate([[0], np.cumsum(large.pieces)[:-1]]).astype(np.int64) if len(large) else 0
    large_df = spark.createDataFrame(large[["g1", "g2", "pieces", "base"]].values.tolist(),
                                     "g1 bigint, g2 bigint, pieces bigint, base bigint")
    unit = F.coalesce(F.col("base") + F.pmod(F.col("h"), F.col("pieces")), F.pmod(F.col("g1"), F.lit(shards * FINE)))
    united = rows.join(F.broadcast(large_df), ["g1", "g2"], "left").withColumn("unit", unit)

    sums = united.groupBy("unit").agg(F.sum("size"), F.sum("n_tokens"), F.count("*")).orderBy("unit").toPandas()
    placed = place(sums.iloc[:, 1:].to_numpy(float), shards)
    where = spark.createDataFrame(list(zip(sums["unit"].tolist(), placed.tolist(), strict=True)), "unit bigint, shard int")
    buckets = max(1, total[2] // BUCKET_ROWS)
    put = scratch.save(united.join(F.broadcast(where), "unit").select(
        "doc_id", "size", "text_crc32", "n_tokens", "g1", "shard", F.pmod("h", F.lit(buckets)).alias("bucket")), "placed")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = put.groupBy("shard", "bucket").count().select(
        "shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "g1")
    return put.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "n_tokens", "shard", (F.col("offset") + F.row_number().over(inside) - 1).alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
