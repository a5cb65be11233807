"""Connected components of a graph of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import _runtime as R


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b), (node, root): root is the least node that links reach from node.

    Every round each node takes the least label of its neighbours and then the label of that
    label, so a chain shortens by half; rounds are written to the shared folder.  A hub's
    links are combined before they are shuffled."""
    both = R.written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = R.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(seen, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        lower = lower.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("further", "root")).alias("root"))
        moved = Observation()  # counted while the round is written
        last, labels = labels, R.written(lower.observe(moved, F.count_if(F.col("was") != F.col("root")).alias("n")).select("node", "root"), "labels")
        R.drop(last)
        if not moved.get["n"]:
            R.drop(both)
            return labels
