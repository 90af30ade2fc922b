"""Shortest paths and equal splits as joins, for graphs that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .failure import written


def shortest_costs(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(origin, node, cost): the least whole cost from each origin to every node that it reaches.

    Only nodes whose cost fell in the last round are joined again.  Costs below zero are refused, as
    rounds would not end.
    """
    if edges.filter("cost < 0").limit(1).count():
        raise ValueError("costs must not be below zero")
    e = written(edges.select("src", "dst", F.col("cost").cast("long").alias("w")).groupBy("src", "dst").agg(F.min("w").alias("w")))
    best = moved = written(sources.select(F.col("name").alias("origin"), F.col("name").alias("node"), F.lit(0).cast("long").alias("cost")))
    while True:
        ahead = moved.join(e, moved["node"] == e["src"]).groupBy("origin", F.col("dst").alias("node")).agg(F.min(F.col("cost") + F.col("w")).alias("new"))
        step = written(best.join(ahead, ["origin", "node"], "full").select("origin", "node", "cost", "new", F.least("cost", "new").alias("least")))
        moved = step.filter("cost is null or new < cost").select("origin", "node", F.col("least").alias("cost"))
        best = step.select("origin", "node", F.col("least").alias("cost"))
        if not moved.limit(1).count():
            return best


def group_costs(costs: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(src_label, dst_label, cost): the least between any two nodes of two groups."""
    s, t = sources.select(F.col("label").alias("src_label"), F.col("name").alias("origin")), targets.select(F.col("label").alias("dst_label"), F.col("name").alias("node"))
    return costs.join(s, "origin").join(t, "node").groupBy("src_label", "dst_label").agg(F.min("cost").alias("cost"))


def equal_split(edges: DataFrame, origin: str, target: str) -> DataFrame:
    """(src, dst, link_id, share): how a unit flow from origin to target splits over shortest paths.

    Distances go forward and backward; an edge is on a shortest path if both and its cost add up.
    Shares then move on level by level.
    """
    spark = edges.sparkSession
    one = lambda x: spark.createDataFrame([(x,)], "name string")
    fwd = shortest_costs(edges, one(origin)).select(F.col("node").alias("src"), F.col("cost").alias("a"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost")
    bwd = shortest_costs(back, one(target)).select(F.col("node").alias("dst"), F.col("cost").alias("b"))
    total = fwd.filter(F.col("src") == target).select(F.col("a").alias("t"))
    dag = edges.join(fwd, "src").join(bwd, "dst").join(F.broadcast(total)).filter(F.col("a") + F.col("cost").cast("long") + F.col("b") == F.col("t")).select("src", "dst", "link_id", "a")
    fan = dag.groupBy("src").agg(F.count("*").alias("fan"))
    dag = written(dag.join(fan, "src"))
    here = spark.createDataFrame([(origin, 1.0)], "src string, load double")
    out = None
    levels = [r.a for r in dag.select("a").distinct().orderBy("a").collect()]
    loads = here
    for a in levels:
        step = written(dag.filter(F.col("a") == a).join(loads.groupBy("src").agg(F.sum("load").alias("load")), "src").select("src", "dst", "link_id", (F.col("load") / F.col("fan")).alias("share")))
        out = step if out is None else out.unionByName(step)
        loads = loads.unionByName(step.select(F.col("dst").alias("src"), F.col("share").alias("load")))
    return out if out is not None else spark.createDataFrame([], "src string, dst string, link_id string, share double")
