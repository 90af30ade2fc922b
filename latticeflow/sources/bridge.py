"""To and from graph objects of other libraries, by the methods that such objects share.

A graph has ``nodes(data=True)``, ``edges(data=True)`` (with keys, if it is a multigraph),
``is_directed()`` and ``is_multigraph()``; no library is imported.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Network


def from_graph(spark: SparkSession, graph, capacity: str = "capacity", cost: str = "cost", default_capacity: float = 1.0, default_cost: float = 1.0, bidirectional: bool = False) -> Network:
    """Nodes in the order of their names as text; edges keep their attributes."""
    attrs = {str(n): dict(d) for n, d in graph.nodes(data=True)}
    rows = []
    for a, b, *key, data in graph.edges(data=True, **({"keys": True} if graph.is_multigraph() else {})):
        one = {"source": str(a), "target": str(b), "capacity": float(data.get(capacity, default_capacity)), "cost": float(int(data.get(cost, default_cost))), "attrs": {k: v for k, v in data.items() if k not in (capacity, cost)} | ({"key": key[0]} if key else {})}
        rows.append(one)
        if bidirectional:
            rows.append({**one, "source": str(b), "target": str(a)})
    return Network.of(spark, [{"name": n, "attrs": attrs[n]} for n in sorted(attrs)], rows)


def to_graph(network: Network, make: Callable):
    """Fills the multigraph that make() returns with enabled nodes and links."""
    g = make()
    for r in network.nodes.filter("not disabled").orderBy("name").collect():
        g.add_node(r.name)
    for r in network.links.filter("not disabled").orderBy("link_id").collect():
        g.add_edge(r.source, r.target, key=r.link_id, capacity=r.capacity, cost=r.cost)
    return g


def dense_ids(df: DataFrame, name: str = "name", id_name: str = "id") -> DataFrame:
    """Names with whole numbers from 0 in their order, without one task that sees all.

    Ranges of names are counted, then each range numbers its own from where the others end.
    """
    parts = df.select(name).distinct().repartitionByRange(df.sparkSession.sparkContext.defaultParallelism, name).withColumn("part", F.spark_partition_id())
    from ..operators.failure import written

    parts = written(parts)
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))  # one row a range
    within = F.row_number().over(Window.partitionBy("part").orderBy(name)) - 1
    return parts.withColumn("k", within).join(F.broadcast(starts), "part").select(name, (F.col("start") + F.col("k")).alias(id_name))
