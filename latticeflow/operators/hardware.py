"""Components and what hardware costs, draws, and can carry."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .aggregate import rollup

COMPONENTS = "root string, path string, name string, cum_count double, component_type string, capex double, power_watts double, power_watts_max double, capacity double, ports long"
#: The keys of a component; any other key is an attribute.
KEYS = ("component_type", "description", "capex", "power_watts", "power_watts_max", "capacity", "ports", "count", "attrs", "children")


def flatten(library: Mapping[str, Mapping]) -> list[tuple]:
    """Rows of a nested library; counts multiply on the way down."""
    out = []

    def walk(root: str, path: str, name: str, c: Mapping, times: float) -> None:
        times *= float(c.get("count", 1))
        number = lambda k: float(c.get(k) or 0.0)
        out.append((root, path, name, times, c.get("component_type", "generic"), number("capex"), number("power_watts"), number("power_watts_max"), number("capacity"), int(c.get("ports") or 0)))
        for n, child in (c.get("children") or {}).items():
            walk(root, f"{path}/{n}", n, child, times)

    for name, c in library.items():
        walk(name, name, name, c, 1.0)
    return out


def library_frame(spark: SparkSession, library: Mapping[str, Mapping]) -> DataFrame:
    return spark.createDataFrame(flatten(library), COMPONENTS)


def merge_libraries(base: Mapping, other: Mapping, override: bool = True) -> dict:
    """Both libraries' components; of one name the other's, or the base's without override."""
    return {**base, **other} if override else {**other, **base}


def component(library: Mapping, name: str) -> Mapping | None:
    """A component by its name at the top of the library."""
    return library.get(name)


def library_dict(library: Mapping) -> dict:
    """A copy of its own, as plain data with the defaults filled in."""

    def one(c: Mapping) -> dict:
        numbers = {k: float(c.get(k) or 0.0) for k in ("capex", "power_watts", "power_watts_max", "capacity")}
        return {"component_type": c.get("component_type", "generic"), "description": c.get("description", ""), **numbers, "ports": int(c.get("ports") or 0), "count": int(c.get("count", 1)), "attrs": dict(c.get("attrs") or {}), "children": {n: one(x) for n, x in (c.get("children") or {}).items()}}

    return {n: one(c) for n, c in library.items()}


def totals(components: DataFrame) -> DataFrame:
    """(component, capex, power_watts, power_watts_max, capacity): own and children's, times counts."""
    times = lambda c: F.sum(F.col(c) * F.col("cum_count")).alias(c)
    return components.groupBy(F.col("root").alias("component")).agg(times("capex"), times("power_watts"), times("power_watts_max"), times("capacity"), F.max(F.when(F.col("path") == F.col("root"), F.col("ports"))).alias("ports"))


def _spec(attrs: str, where: str):
    v = F.try_parse_json(F.col(attrs))
    name = F.try_variant_get(v, f"{where}.component", "string")
    count = F.coalesce(F.try_variant_get(v, f"{where}.count", "double"), F.lit(1.0))
    return name, F.when(count > 0, count).otherwise(F.lit(1.0)), F.coalesce(F.try_variant_get(v, f"{where}.exclusive", "boolean"), F.lit(False))


def node_hardware(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """(name, disabled, component, count, and the totals times the count)."""
    name, count, _ = _spec("attrs", "$.hardware")
    t = totals(components)
    n = nodes.select("name", "disabled", name.alias("component"), count.alias("hw_count"))
    j = n.join(F.broadcast(t), "component", "left")
    return j.select("name", "disabled", "component", "hw_count", *((F.coalesce(c, F.lit(0.0)) * F.col("hw_count")).alias(c) for c in ("capex", "power_watts", "power_watts_max", "capacity")), (F.coalesce("ports", F.lit(0)) * F.col("hw_count")).alias("ports"))


def link_hardware(links: DataFrame, nodes: DataFrame, components: DataFrame) -> DataFrame:
    """(link_id, end, name, component, count, totals): optics at ends whose node has hardware.

    An exclusive component is counted in whole pieces.
    """
    t, out = totals(components), None
    has = nodes.select("name", "disabled", _spec("attrs", "$.hardware")[0].alias("hw")).filter("hw is not null").select("name", F.col("disabled").alias("node_disabled"))
    for end in ("source", "target"):
        name, count, exclusive = _spec("attrs", f"$.hardware.{end}")
        part = links.select("link_id", F.lit(end).alias("end"), F.col(end).alias("name"), "disabled", "capacity", name.alias("component"), F.when(exclusive, F.ceil(count).cast("double")).otherwise(count).alias("hw_count"))
        out = part if out is None else out.unionByName(part)
    out = out.filter("component is not null").withColumnRenamed("capacity", "link_capacity").join(has, "name").join(F.broadcast(t), "component")
    return out.select("link_id", "end", "name", F.expr("disabled or node_disabled").alias("disabled"), "component", "hw_count", "link_capacity", *((F.col(c) * F.col("hw_count")).alias(c) for c in ("capex", "power_watts", "power_watts_max", "capacity")), (F.col("ports") * F.col("hw_count")).alias("ports"))


def _bought(nodes: DataFrame, links: DataFrame, components: DataFrame, include_disabled: bool) -> DataFrame:
    cols = ["name", "component", "hw_count", "capex", "power_watts", "disabled"]
    both = node_hardware(nodes, components).filter("component is not null").select(cols).unionByName(link_hardware(links, nodes, components).select(cols))
    return both if include_disabled else both.filter("not disabled")


def cost_power(nodes: DataFrame, links: DataFrame, components: DataFrame, level: int = 2, include_disabled: bool = False) -> DataFrame:
    """(level, path, capex, power_watts) for each prefix down to a level."""
    return rollup(_bought(nodes, links, components, include_disabled), "name", {"capex": "capex", "power_watts": "power_watts"}, level)


def bill_of_materials(nodes: DataFrame, links: DataFrame, components: DataFrame, include_disabled: bool = True) -> DataFrame:
    """(path, component, pieces) for each prefix."""
    from .aggregate import prefixes

    each = _bought(nodes, links, components, include_disabled).withColumn("p", F.explode(prefixes(F.col("name"))))
    return each.groupBy(F.col("p.path").alias("path"), "component").agg(F.sum("hw_count").alias("pieces"))


def utilization(nodes: DataFrame, links: DataFrame, components: DataFrame) -> DataFrame:
    """Attached capacity and ports against what enabled nodes' hardware has."""
    hw = node_hardware(nodes, components).filter("not disabled and capacity > 0").select("name", "component", F.col("capacity").alias("node_capacity"), "ports")
    on = links.filter("not disabled").join(nodes.filter("not disabled").select(F.col("name").alias("source")), "source", "left_semi").join(nodes.filter("not disabled").select(F.col("name").alias("target")), "target", "left_semi")
    ends = on.select(F.col("source").alias("name"), "capacity").union(on.select("target", "capacity")).groupBy("name").agg(F.sum("capacity").alias("attached"))
    used = link_hardware(on, nodes, components).groupBy("name").agg(F.sum("ports").alias("ports_used"))
    j = hw.join(ends, "name", "left").join(used, "name", "left").na.fill(0.0, ["attached", "ports_used"])
    return j.select("name", "component", "node_capacity", "attached", (F.col("attached") / F.col("node_capacity")).alias("capacity_utilization"), "ports", "ports_used", (F.col("attached") > F.col("node_capacity")).alias("capacity_violation"), ((F.col("ports") > 0) & (F.col("ports_used") > F.col("ports") + 1e-9)).alias("ports_violation"))


def validate(nodes: DataFrame, links: DataFrame, components: DataFrame) -> None:
    """Raises ValueError for nodes that more is attached to than they carry."""
    bad = utilization(nodes, links, components).filter("capacity_violation or ports_violation").limit(5).collect()
    if bad:
        raise ValueError("over capacity or ports: " + ", ".join(f"{r.name} ({r.attached:g} of {r.node_capacity:g})" for r in bad))


def link_issues(links: DataFrame, nodes: DataFrame, components: DataFrame) -> DataFrame:
    """Links with more capacity than the hardware at their ends has."""
    least = link_hardware(links, nodes, components).filter("capacity > 0").groupBy("link_id", "link_capacity").agg(F.min("capacity").alias("end_capacity"))
    return least.filter("link_capacity > end_capacity")
