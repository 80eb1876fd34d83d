"""A5: the file manifest as snapshot tables: each file's fingerprint, and the length, time and hour of listing
that tell whether it has to be read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources.snapshots import read_latest, write_snapshot

MANIFEST_SCHEMA = "path STRING, md5 STRING, length BIGINT, modified TIMESTAMP, listed TIMESTAMP"
MANIFEST_COLUMNS = [c.split()[0] for c in MANIFEST_SCHEMA.split(", ")]
#: In place of the fingerprint of a file that did not load: differs from any, so the file is
#: retried, and it is seen as deleted once it is gone.
FAILED = "failed"


def read_manifest(spark: SparkSession, base: str) -> DataFrame:
    """Latest manifest; empty when none was written yet."""
    return read_latest(spark, base, MANIFEST_SCHEMA)


def _entries(files: DataFrame) -> DataFrame:
    """Columns that ``files`` lacks are NULL: such a file is read again the next time."""
    return files.select(*[F.col(c) if c in files.columns else F.lit(None).cast(kind).alias(c)
                          for c, kind in (x.split() for x in MANIFEST_SCHEMA.split(", "))]).dropDuplicates(["path"])


def write_manifest(files: DataFrame, base: str) -> str:
    return write_snapshot(_entries(files), base)


def merge_manifest(spark: SparkSession, base: str, batch: DataFrame, deleted: DataFrame | None = None) -> str:
    """Replace or add the batch's entries and remove those of ``deleted`` paths (the latest manifest keeps the others)."""
    new = _entries(batch)
    gone = new.select("path") if deleted is None else new.select("path").unionByName(deleted.select("path"))
    old = read_manifest(spark, base)
    return write_snapshot(old.join(gone, "path", "left_anti").unionByName(new), base)
