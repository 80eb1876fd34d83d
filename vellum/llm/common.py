"""Shared helpers: table readers, scratch tables in the cluster's shared folder, Arrow slices."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.session import bounded_batches

#: White space between words: the ASCII characters 0x20 and 0x09 to 0x0D.
SEPARATOR = "[\\x20\\x09-\\x0D]+"
SEPARATOR_CHARS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Scratch:
    """Intermediate tables in a fresh folder below ``spark.checkpoint.dir``, the folder that
    the driver and all executors share. A saved table cuts the lineage: its files outlive the
    executors that wrote them. The folder is removed when the application ends.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        bounded_batches(spark)
        self.spark = spark
        self.root = f"{base.rstrip('/')}/vellum-{label}-{uuid.uuid4().hex}"
        self._fs(self.root)[0].deleteOnExit(self._fs(self.root)[1])

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``df`` as Parquet (with the writer's ``options``) and return the written table. The shuffle files of the job go
        when it ends: nothing reads them again, as the table cuts the lineage."""
        path, conf, key = f"{self.root}/{name}", self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key, None)
        conf.set(key, "true")
        try:
            df.write.mode("overwrite").options(compression="zstd", **options).parquet(path)
        finally:
            conf.unset(key) if before is None else conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        for name in names:
            fs, target = self._fs(f"{self.root}/{name}")
            fs.delete(target, True)


def unused(name: str, columns: list[str]) -> str:
    """``name``, longer by underscores while a column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Positions of one bitmap of Spark's bitmap functions.
_BITMAP = 32_768


def bit_filter(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """``(bucket, bitmap)``: which of ``bits`` (a power of two) positions the 64-bit hashes in ``column`` take.
    ``bits`` / 32768 rows of 4 KB at most, whatever the input: a filter that lets every member pass,
    and a non-member with the probability that its position is taken."""
    place = F.col(column).bitwiseAND(F.lit(bits - 1)) + 1
    return keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))


def bit_array(bitmaps: DataFrame, bits: int) -> np.ndarray:
    """The filter as an array of ``bits`` / 8 bytes, for numpy."""
    out = np.zeros(bits // 8, np.uint8)
    for r in bitmaps.collect():  # at most bits / 32768 rows
        own = np.frombuffer(r["bitmap"], np.uint8)
        out[(r["bucket"] - 1) * (_BITMAP // 8):][:min(len(own), len(out))] = own[:len(out)]
    return out


def in_bits(array: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes (uint64) pass the filter."""
    place = (h & np.uint64(len(array) * 8 - 1)).astype(np.int64)
    return (array[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def passing(df: DataFrame, column: str, bitmaps: DataFrame, bits: int) -> DataFrame:
    """The rows of ``df`` that pass the filter; its few rows are broadcast."""
    place = F.col(column).bitwiseAND(F.lit(bits - 1))
    inside = place.bitwiseAND(F.lit(_BITMAP - 1)).cast("int")
    at = F.floor(inside / 8).cast("int")
    byte = F.conv(F.hex(F.substring("bitmap", at + 1, F.lit(1))), 16, 10).cast("int")
    marked = df.withColumn("bucket", F.shiftright(place, 15) + 1)
    return (marked.join(F.broadcast(bitmaps), "bucket").where(F.getbit(byte, (inside - at * 8).cast("int")) == 1)
            .drop("bucket", "bitmap"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    """Words between ASCII white space; a null or blank text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATOR_CHARS))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>"))
               .otherwise(F.split(t, SEPARATOR)))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges holding about ``max_bytes`` of ``column`` each; one row at least."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(column))
    ends = offsets_of(col)[1:]
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def offsets_of(col: pa.Array) -> np.ndarray:
    """Byte offsets of a string column, from 0; a null has no bytes of its own."""
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    raw = np.frombuffer(col.buffers()[1], kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    return raw - raw[0]


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, texts end to end, and their offsets. Nulls are empty."""
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    raw = np.frombuffer(col.buffers()[1], kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    if data is None or raw[-1] == raw[0]:
        return np.zeros(0, np.uint8), raw - raw[0]
    return np.frombuffer(data, np.uint8)[raw[0]:raw[-1]], raw - raw[0]
