"""Statistics of networks and of flow results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def alive(nodes: DataFrame, links: DataFrame, include_disabled: bool = False, excluded_nodes=(), excluded_links=()) -> tuple[DataFrame, DataFrame]:
    """Nodes and links that count: enabled, not excluded, links with such ends."""
    n = nodes.filter(~F.col("name").isin(list(excluded_nodes)))
    k = links.filter(~F.col("link_id").isin(list(excluded_links)))
    if not include_disabled:
        n, k = n.filter("not disabled"), k.filter("not disabled")
    ends = n.select("name")
    k = k.join(ends.withColumnRenamed("name", "source"), "source", "left_semi").join(ends.withColumnRenamed("name", "target"), "target", "left_semi")
    return n, k


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(name, degree): ends of links at each node, with zeros."""
    ends = links.select(F.col("source").alias("name")).union(links.select("target")).groupBy("name").agg(F.count("*").alias("degree"))
    return nodes.select("name").join(ends, "name", "left").select("name", F.coalesce("degree", F.lit(0)).alias("degree"))


def network_stats(nodes: DataFrame, links: DataFrame, include_disabled: bool = False, excluded_nodes=(), excluded_links=()) -> DataFrame:
    """One row: counts, and statistics of capacity, cost and degree."""
    n, k = alive(nodes, links, include_disabled, excluded_nodes, excluded_links)
    five = lambda c, p: [F.avg(c).alias(f"mean_{p}"), F.median(c).alias(f"median_{p}"), F.min(c).alias(f"min_{p}"), F.max(c).alias(f"max_{p}")]
    a = k.agg(F.count("*").alias("link_count"), F.coalesce(F.sum("capacity"), F.lit(0.0)).alias("total_capacity"), *five("capacity", "capacity"), *five("cost", "cost"))
    b = degrees(n, k).agg(F.count("*").alias("node_count"), *five("degree", "degree"))
    return a.join(b)


def prefixes(name: Column, drop_empty: bool = True) -> Column:
    """The path prefixes of a name, from the root ('') on, as (level, path)."""
    parts = F.filter(F.split(name, "/"), lambda x: x != "") if drop_empty else F.split(name, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("level"), F.array_join(F.slice(parts, 1, i), "/").alias("path")))


def rollup(df: DataFrame, name: str, sums: dict[str, str | Column], most_level: int | None = None) -> DataFrame:
    """Sums by every prefix of a hierarchical name: one pass, one partial aggregate."""
    levels = prefixes(F.col(name))
    if most_level is not None:
        levels = F.filter(levels, lambda x: x["level"] <= most_level)
    each = df.withColumn("_p", F.explode(levels))
    return each.groupBy(F.col("_p.level").alias("level"), F.col("_p.path").alias("path")).agg(*(F.sum(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in sums.items()))


def node_counts(nodes: DataFrame) -> DataFrame:
    """(level, path, node_count, active_count) for every prefix."""
    return rollup(nodes, "name", {"node_count": F.lit(1), "active_count": F.when(F.col("disabled"), 0).otherwise(1)})


def link_locality(links: DataFrame) -> DataFrame:
    """(path, internal_count, internal_capacity, external_count, external_capacity) by prefix.

    A link lies inside a prefix that both ends have, and crosses the border of one that one end has.
    """
    a, b = (F.transform(prefixes(F.col(c)), lambda x: x["path"]) for c in ("source", "target"))
    both, one = F.array_intersect(a, b), F.array_union(F.array_except(a, b), F.array_except(b, a))
    each = links.select("capacity", F.explode(F.array_union(F.transform(both, lambda p: F.struct(p.alias("path"), F.lit(True).alias("inside"))), F.transform(one, lambda p: F.struct(p.alias("path"), F.lit(False).alias("inside"))))).alias("x"))
    inside = F.col("x.inside")
    return each.groupBy(F.col("x.path").alias("path")).agg(
        F.count(F.when(inside, 1)).alias("internal_count"),
        F.coalesce(F.sum(F.when(inside, F.col("capacity"))), F.lit(0.0)).alias("internal_capacity"),
        F.count(F.when(~inside, 1)).alias("external_count"),
        F.coalesce(F.sum(F.when(~inside, F.col("capacity"))), F.lit(0.0)).alias("external_capacity"),
    )


def external_breakdown(links: DataFrame) -> DataFrame:
    """(path, far_end, link_count, link_capacity): what crosses a prefix's border, by the far node."""
    out = None
    for near, far in (("source", "target"), ("target", "source")):
        a, b = (F.transform(prefixes(F.col(c)), lambda x: x["path"]) for c in (near, far))
        part = links.select(F.explode(F.array_except(a, b)).alias("path"), F.col(far).alias("far_end"), "capacity")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("path", "far_end").agg(F.count("*").alias("link_count"), F.sum("capacity").alias("link_capacity"))


# Envelopes and summaries ------------------------------------------------------------------------


def frequencies(results: DataFrame, keys: list[str], value: str, times: str | None = None) -> DataFrame:
    """How often each value comes, by key: the first level of an envelope."""
    return results.groupBy(*keys, F.col(value).alias("value")).agg(F.sum(F.col(times) if times else F.lit(1)).alias("n"))


def envelope(freq: DataFrame, keys: list[str]) -> DataFrame:
    """Count, least, greatest, mean and population deviation from frequencies."""
    n, v = F.col("n"), F.col("value")
    base = freq.groupBy(*keys).agg(F.sum("n").alias("total_samples"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), (F.sum(n * v) / F.sum("n")).alias("mean_value"))
    # Squares of deviations, not of values: large capacities would lose their digits.
    mean = base.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("mean_value").alias("_mean"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    off = freq.join(mean, same).groupBy(*(f"_{k}" for k in keys)).agg(F.sqrt(F.sum(n * (v - F.col("_mean")) * (v - F.col("_mean"))) / F.sum("n")).alias("stdev_value"))
    return base.join(off, same).drop(*(f"_{k}" for k in keys))


def envelope_percentile(freq: DataFrame, keys: list[str], p: float) -> DataFrame:
    """The smallest value that covers p percent of the samples.  Windows run over distinct values."""
    w = Window.partitionBy(*keys).orderBy("value")
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(*keys))
    marked = freq.withColumn("upto", upto).withColumn("total", total)
    return marked.filter(F.col("upto") >= F.col("total") * (p / 100.0)).groupBy(*keys).agg(F.min("value").alias("percentile"))


def expand_values(freq: DataFrame) -> DataFrame:
    return freq.select(*[c for c in freq.columns if c != "n"], F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("one")).drop("one")


def flow_summary(flows: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of demand and placed flow; the ratio is 1 without demand."""
    total, placed = F.sum("demand"), F.sum("placed")
    return flows.groupBy(*keys).agg(total.alias("total_demand"), placed.alias("total_placed"), F.when(total == 0, F.lit(1.0)).otherwise(placed / total).alias("overall_ratio"), F.count(F.when(F.col("placed") < F.col("demand") - 1e-9, 1)).alias("dropped_flows"), F.count("*").alias("num_flows"))


def merge_costs(costs: DataFrame, keys: list[str]) -> DataFrame:
    """Volumes by cost, summed and as one map in order of cost."""
    each = costs.groupBy(*keys, "cost").agg(F.sum("volume").alias("volume"))
    return each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cost", "volume")))).alias("cost_distribution"))


def cost_statistics(costs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cost, mean, min, max, total_samples): the volumes that results put on each cost."""
    return envelope(frequencies(costs, [*keys, "cost"], "volume"), [*keys, "cost"]).select(*keys, "cost", F.col("mean_value").alias("mean"), F.col("min_value").alias("min"), F.col("max_value").alias("max"), "total_samples")


def edge_frequency(cuts: DataFrame, keys: list[str], edges: str) -> DataFrame:
    """How often each edge lies in a cut."""
    return cuts.select(*keys, F.explode(edges).alias("edge")).groupBy(*keys, "edge").agg(F.count("*").alias("n"))


def weighted_sensitivity(rows: DataFrame, keys: list[str], score: str, times: str) -> DataFrame:
    """Mean weighted by occurrences, least, greatest and number."""
    s, n = F.col(score), F.col(times)
    return rows.groupBy(*keys).agg((F.sum(s * n) / F.sum(n)).alias("mean"), F.min(s).alias("min"), F.max(s).alias("max"), F.sum(n).alias("count"))
