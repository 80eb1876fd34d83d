"""Top-k per group and global row numbers without single-task bottlenecks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.session import cut_lineage


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int,
                    rank_col: str = "rank", salt_on: str | None = None,
                    salt_buckets: int = 1) -> DataFrame:
    """Keep the first ``k`` rows of each group under ``order`` and number them 1..k.

    ``row_number() <= k`` becomes a partial ``WindowGroupLimit`` before the exchange, so each
    map task ships at most ``k`` rows per group. With ``salt_buckets > 1`` a first round keeps
    ``k`` per (group, salt) so that a hot group is reduced by many tasks before one task
    ranks at most ``k * salt_buckets`` survivors.
    """
    if salt_buckets > 1 and salt_on:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salt_buckets)))
        w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (salted.withColumn("_r1", F.row_number().over(w1))
              .where(F.col("_r1") <= k).drop("_r1", "_salt"))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def global_row_number(df: DataFrame, order: list[Column], out: str = "position",
                      partitions: int | None = None) -> DataFrame:
    """1-based row number over the whole frame in ``order``, computed without pulling the
    frame into one task: range-partition by the order, number rows inside each partition,
    then add the row count of all earlier partitions (a table with one row per partition).
    """
    spark = df.sparkSession
    n = partitions or _spark_conf_int(spark, "spark.sql.shuffle.partitions")
    # Checkpointed so that both uses below see the same range boundaries and partition ids
    # (two range exchanges could sample different boundaries) and executor loss is survived.
    ranged = cut_lineage(df.repartitionByRange(n, *order)
                         .withColumn("_pid", F.spark_partition_id()))
    local = ranged.withColumn("_lrn", F.row_number().over(
        Window.partitionBy("_pid").orderBy(*order)))
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))).select("_pid", "_off")
    # ``offsets`` has one row per partition: bounded by the partition count, not the data.
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn(out, (F.col("_off") + F.col("_lrn")).cast("bigint"))
            .drop("_pid", "_lrn", "_off"))


def _spark_conf_int(spark, key: str) -> int:
    return int(spark.conf.get(key))


def lead_within(df: DataFrame, group: str, order: str, value: str, out: str,
                partitions: int | None = None) -> DataFrame:
    """``out`` = ``value`` of the next row of the same ``group`` in ``order`` (NULL for the
    last row), like ``lead`` over a window partitioned by group.

    Rows are range-partitioned by (group, order), so no group gathers in one task; each
    partition receives a copy of the first row of the next non-empty partition (a halo), so that
    its last row finds its successor locally."""
    spark = df.sparkSession
    n = partitions or _spark_conf_int(spark, "spark.sql.shuffle.partitions")
    ranged = cut_lineage(df.repartitionByRange(n, group, order)
                         .withColumn("_pid", F.spark_partition_id()))
    pids = ranged.select("_pid").distinct()
    prev = pids.select("_pid", F.lag("_pid").over(Window.orderBy("_pid")).alias("_to"))
    first = (ranged.withColumn("_r", F.row_number().over(
        Window.partitionBy("_pid").orderBy(group, order))).where(F.col("_r") == 1)
        .join(F.broadcast(prev), "_pid").where(F.col("_to").isNotNull())
        .select(F.col("_to").alias("_pid"), group, order, value, F.lit(True).alias("_halo")))
    own = ranged.withColumn("_halo", F.lit(False))
    w = Window.partitionBy("_pid").orderBy(group, order, "_halo")
    nxt = F.lead(F.struct(F.col(group).alias("g"), F.col(value).alias("v"))).over(w)
    return (own.unionByName(first, allowMissingColumns=True)
            .withColumn(out, F.when(nxt["g"] == F.col(group), nxt["v"]))
            .where(~F.col("_halo")).drop("_halo", "_pid"))
