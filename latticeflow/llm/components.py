"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): for every node of a link the smallest node that it can reach.

    Each round takes the least label among a node and its neighbours, then the label's own label.
    A node with many links costs its tasks a partial minimum only.  Links and labels stay tables;
    the driver sees one number a round.  Null ends and links from a node to itself are left out.
    """
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    both = cut(ends.unionByName(ends.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), F.col("label").alias("l")), "y").groupBy(F.col("x").alias("node")).agg(F.min("l").alias("l"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        nxt = cut(step.join(far, "label").select("node", "old", F.least("label", "far").alias("label")), "labels")
        labels = nxt.select("node", "label")
        if not nxt.filter("old <> label").limit(1).count():
            return labels
