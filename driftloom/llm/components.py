"""Connected components of a link table by iterated Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.shared import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "labels") -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b): root is the least node reachable.

    Each round takes the least label among a node's neighbours (a join and a partially
    aggregated minimum) and then the label of its label (pointer jumping). Each round is a
    written table, so a hot node's joins are between fresh shuffles that Spark can split.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a != b").distinct()
    both = scratch.cut(both, f"{name}-links")
    labels = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), f"{name}-0")
    done = 0
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = scratch.cut(
            labels.join(seen, "node").select("node", F.least("root", "near").alias("root"), (F.col("near") < F.col("root")).alias("moved")),
            f"{name}-{done}-hooked",
        )
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        jumped = hooked.join(up, "root").select("node", F.least("root", "higher").alias("root"), "moved")
        after = scratch.cut(jumped, f"{name}-{done + 1}")
        scratch.drop(f"{name}-{done}")
        scratch.drop(f"{name}-{done}-hooked")
        labels, done = after.select("node", "root"), done + 1
        if after.filter("moved").isEmpty():
            return labels
