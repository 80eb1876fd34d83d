"""Bucketed tables with per-bucket replacement, committed by a log.

A row lies in the bucket its key hashes to. An update reads only the buckets its batch touches,
merges them with the batch and writes the result into folders of its own; one log entry
(see :mod:`vellum.sources.commits`) then puts the new buckets, the emptied ones and the layout in
place at once. Readers see the version before or after it, never a part of it. Work per update grows
with the touched buckets, not with the table.

Buckets grow by linear hashing: the count need not be a power of two, and an update that finds more than
``bucket_rows`` rows a bucket splits the next buckets in turn, each into itself and one new bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources.commits import DATA, Version, commit, current, new_folder

BUCKET = "bucket"
#: Buckets of a new table, unless asked otherwise.
DEFAULT_BUCKETS = 64
#: Rows a bucket holds on average before the table gets more buckets.
BUCKET_ROWS = 200_000


def settled(spark: SparkSession, base: str, **asked: int | None) -> dict[str, int]:
    """The table's recorded numbers, checked against those asked for (None: whatever is recorded). ``buckets``
    is the count the table started with, ``now`` the count it has grown to."""
    version = current(spark, base)
    return _checked(base, version, asked)


def _checked(base: str, version: Version | None, asked: dict[str, int | None]) -> dict[str, int]:
    known = version.numbers if version else {}
    for key, value in asked.items():
        if value is not None and key in known and known[key] != value:
            raise ValueError(f"{base} was written with {key} {known[key]}, not {value}")
    return known


def _round(first: int, n: int) -> int:
    """The buckets of the last whole doubling of ``first`` within ``n``."""
    size = first
    while size * 2 <= n:
        size *= 2
    return size


def bucket_of(key: str | Column, n: int = DEFAULT_BUCKETS, first: int | None = None) -> Column:
    """Linear hashing: of ``n`` buckets that grew from ``first``; a bucket that was not yet split in this
    doubling still holds the keys of its later twin."""
    k = F.xxhash64(F.col(key) if isinstance(key, str) else key)
    size = _round(first or n, n)
    wide = F.pmod(k, F.lit(2 * size))
    return F.when(wide < n, wide).otherwise(wide - size).cast("int")


def parent(bucket: int, first: int, n: int) -> int:
    """The bucket of a table of ``n`` that holds the keys of ``bucket``, one of a table grown further."""
    while bucket >= n:
        bucket -= _round(first, bucket)
    return bucket


def _exists(spark: SparkSession, base: str) -> bool:
    return current(spark, base) is not None


def _read(spark: SparkSession, base: str, schema: str, version: Version | None, buckets=None) -> DataFrame:
    full = f"{schema}, {BUCKET} INT"
    names = version.folders if version else {}
    chosen = [f for b, f in sorted(names.items()) if buckets is None or int(b) in buckets]
    if not chosen:
        return spark.createDataFrame([], full)
    data = f"{base.rstrip('/')}/{DATA}"
    return (spark.read.schema(full).option("basePath", data).parquet(*[f"{data}/{f}" for f in chosen])
            .select(*[c.split()[0] for c in full.split(", ")]))


def read_bucketed(spark: SparkSession, base: str, schema: str) -> DataFrame:
    """The whole table with its ``bucket`` column, as of now; empty when nothing was written yet."""
    return _read(spark, base, schema, current(spark, base))


def _write(rows: DataFrame, base: str) -> tuple[dict[str, str], dict[str, int]]:
    """``rows`` with their bucket, into new folders: bucket -> folder, bucket -> rows. Clustered by bucket, so that a
    bucket is few files however many tasks there are; a hot bucket is split over tasks."""
    folder = new_folder()
    target = f"{base.rstrip('/')}/{DATA}/{folder}"
    rows.hint("rebalance", BUCKET).write.mode("errorifexists").partitionBy(BUCKET).parquet(target)
    # One row per bucket; an empty write has no bucket folder and no schema to read.
    written = rows.sparkSession.read.schema(rows.schema).parquet(target).groupBy(BUCKET).count().collect()
    return ({str(r[BUCKET]): f"{folder}/{BUCKET}={r[BUCKET]}" for r in written},
            {str(r[BUCKET]): r["count"] for r in written})


def replace_buckets(spark: SparkSession, base: str, schema: str, key: str,
                    touched_keys: DataFrame, merge: Callable[[DataFrame], DataFrame],
                    n: int | None = None, bucket_rows: int = BUCKET_ROWS, **layout: int | None) -> int:
    """Re-write the buckets holding any key of ``touched_keys`` with ``merge(current rows of
    those buckets)``, in one commit. Returns the number of buckets touched. The bucket count and further
    ``layout`` numbers are recorded with the table's first rows and hold from then on, but that the table
    grows by splitting buckets. ``merge`` must keep rows of keys that it does not replace.

    A writer that loses to another one enters its buckets again if the other changed none that it
    read, else it merges again."""
    done: dict = {}

    def change(before: Version | None) -> Version:
        known = _checked(base, before, {"buckets": n, **layout})
        first = known.get("buckets", n or DEFAULT_BUCKETS)
        now = known.get("now", first)
        same = done and done["now"] == now and all(
            (before.folders if before else {}).get(str(b)) == done["read"].get(str(b)) for b in done["buckets"])
        if not same:
            # Bucket numbers only: at most ``now``.
            touched = {r[0] for r in touched_keys.select(bucket_of(key, now, first)).distinct().collect()}
            full = -(-sum(before.rows.values()) // bucket_rows) if before else 0
            grown = max(now, min(full, 2 * now))
            buckets = touched | {parent(b, first, now) for b in range(now, grown)}
            merged = merge(_read(spark, base, schema, before, buckets).drop(BUCKET))
            folders, rows = _write(merged.withColumn(BUCKET, bucket_of(key, grown, first)), base)
            done.update(now=now, grown=grown, first=first, buckets=buckets, touched=len(touched), folders=folders, rows=rows,
                        read=dict(before.folders) if before else {})
        gone = {str(b) for b in done["buckets"]}
        keep = lambda d: {b: x for b, x in d.items() if b not in gone}
        numbers = {**known, **{k: v for k, v in layout.items() if v is not None}, "buckets": done["first"], "now": done["grown"]}
        return Version(0, numbers, {**keep(before.folders if before else {}), **done["folders"]},
                       {**keep(before.rows if before else {}), **done["rows"]})

    commit(spark, base, change)
    return done["touched"]


def overwrite_all(df: DataFrame, base: str, key: str, n: int | None = None, **layout: int | None) -> None:
    """Replace the whole table (a rebuild or a reset) by ``df``, which may read the version before."""
    n = n or DEFAULT_BUCKETS
    folders, rows = _write(df.withColumn(BUCKET, bucket_of(key, n)), base)
    numbers = {"buckets": n, "now": n, **{k: v for k, v in layout.items() if v is not None}}
    commit(df.sparkSession, base, lambda before: Version(0, numbers, folders, rows))
