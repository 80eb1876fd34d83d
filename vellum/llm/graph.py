"""Connected components of a link table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``links`` (columns a and b, of one type that sorts); root is the
    least node reachable.

    Every round takes the least label among a node's neighbours, then its label's label, so
    the number of rounds grows with the logarithm of the longest path. Rounds are written
    tables, joined on keys without a window or group that gathers a component.
    """
    both = scratch.save(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-links")
    labels = scratch.save(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), f"{name}-0")
    turn = 0
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
                .withColumnRenamed("a", "node"))
        step = scratch.save(labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")), f"{name}-step")
        far = step.select(F.col("node").alias("root"), F.col("root").alias("far"))
        turn += 1
        jumped = scratch.save(step.join(far, "root").select("node", "old", F.least("root", "far").alias("root")), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        labels = jumped.select("node", "root")
        if jumped.where("root != old").isEmpty():
            return labels
