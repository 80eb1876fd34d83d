"""A1/A2: the corpus: listing, candidates for a change, contents.

A listing carries no contents: Spark's ``binaryFile`` reads a file's bytes only where its content or
fingerprint is asked for. What a listing shows to be unchanged (path, length, time) is not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum import config
from vellum.functions.text import path_type

BINARY_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def _keep(df: DataFrame, extensions) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    exts = [e.lower().lstrip(".") for e in extensions]
    return (df.withColumn("file_type", path_type("path"))
            .where(F.col("file_type").isin(exts) & ~name.startswith(".")
                   & (name != config.MANIFEST_NAME)))


def scan_corpus(spark: SparkSession, root: str,
                extensions=config.SUPPORTED_EXTENSIONS) -> DataFrame:
    """``(path, modificationTime, length, content, file_type, md5)`` of every supported
    file under ``root`` (recursive; extension compared case-insensitively; dot-files and
    the manifest skipped). Spark's file listing also skips ``_``-prefixed files and
    dot-directories. A missing root raises ``FileNotFoundError``."""
    try:
        raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
               .load(root))
        raw.schema  # noqa: B018 - resolve now so a missing path fails here
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            raise FileNotFoundError(f"corpus path {root} not found") from e
        raise
    return _keep(raw, extensions).withColumn("md5", F.md5("content"))


#: A file whose time is within so many seconds of the listing may change again without a sign of it
#: (same length, same time), so it stays a candidate.
SETTLE_SECONDS = 2


def list_corpus(spark: SparkSession, root: str, extensions=config.SUPPORTED_EXTENSIONS) -> DataFrame:
    """``(path, length, modified, listed)`` of the files that :func:`scan_corpus` finds; none is opened."""
    from datetime import datetime, timezone

    before = datetime.now(timezone.utc)
    return scan_corpus(spark, root, extensions).select(
        "path", "length", F.col("modificationTime").alias("modified"), F.lit(before).cast("timestamp").alias("listed"))


def candidates(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """The listed files that may differ from the manifest, with ``was`` (the manifest's fingerprint; NULL for a new
    file): new ones, those of another length or time, those that failed, those that had not settled when they
    were listed. One equi-join of paths."""
    from vellum.sources.manifest import FAILED

    old = manifest.select(F.col("path"), F.col("md5").alias("was"), F.col("length").alias("_length"),
                          F.col("modified").alias("_modified"), F.col("listed").alias("_listed"), F.lit(True).alias("_known"))
    settled = (F.col("_length").eqNullSafe(F.col("length")) & F.col("_modified").eqNullSafe(F.col("modified"))
               & (F.col("was") != FAILED) & (F.col("modified") < F.col("_listed") - F.expr(f"INTERVAL {SETTLE_SECONDS} SECONDS")))
    return (listing.join(old, "path", "left").where(F.col("_known").isNull() | ~F.coalesce(settled, F.lit(False)))
            .select(*listing.columns, "was"))


#: Bytes of contents that a task holds before it hands them on; a larger file goes alone.
READ_BYTES = 16 << 20
#: Bytes of contents one task reads, about.
TASK_BYTES = 128 << 20


def filesystem(path: str):
    """The ``pyarrow`` file system of a path as Spark writes it, the path within it, and what to put before
    such a path to write it as Spark does."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        rest = rest if scheme == "file" and colon else path
        return fs.LocalFileSystem(), "/" + rest.lstrip("/"), "file:"
    authority, _, inner = rest.lstrip("/").partition("/")
    if scheme in ("s3", "s3a", "s3n"):
        found, _ = fs.FileSystem.from_uri(f"s3://{authority}")
        return found, f"{authority}/{inner}", f"{scheme}://"
    found, _ = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return found, f"/{inner}", f"{scheme}://{authority}"


def open_bytes(path: str) -> bytes:
    found, inner, _ = filesystem(path)
    with found.open_input_stream(inner) as stream:
        return stream.read()


def read_contents(files: DataFrame, reader: Callable[[str], bytes] = open_bytes, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``files`` (with ``path`` and ``length``) and their ``content`` and ``md5``, both NULL for a file that cannot be
    read (it went meanwhile). Paths are rows: they are dealt over tasks by their bytes and opened there; none
    passes through the driver. ``reader(path)`` gives a file's bytes."""
    total = files.agg(F.sum("length")).first()[0] or 0  # one number
    dealt = files.repartition(max(1, min(100_000, -(-total // task_bytes), files.sparkSession.sparkContext.defaultParallelism * 64)),
                              F.xxhash64("path"))
    names = files.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, start = [], 0, 0

            def block(stop: int) -> pa.RecordBatch:
                own = batch.slice(start, stop - start)
                md5 = [None if c is None else hashlib.md5(c).hexdigest() for c in held]
                return pa.RecordBatch.from_arrays([*own.columns, pa.array(held, pa.binary()), pa.array(md5, pa.string())], names=[*names, "content", "md5"])

            for at, path in enumerate(batch.column(names.index("path")).to_pylist()):
                try:
                    content = reader(path)
                except OSError:
                    content = None
                if held and size + len(content or b"") > READ_BYTES:
                    yield block(at)
                    held, size, start = [], 0, at
                held.append(content)
                size += len(content or b"")
            if held:
                yield block(batch.num_rows)

    return dealt.mapInArrow(run, types + ", content BINARY, md5 STRING")
