"""The network as immutable frames, and the graph that kernels work on."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .plans.kernels import LARGE, Graph

NODES = "name string, disabled boolean, risk_groups array<string>, attrs string, node_ord long"
LINKS = "link_id string, source string, target string, capacity double, cost double, disabled boolean, risk_groups array<string>, attrs string, link_ord long"
GROUPS = "name string, disabled boolean, attrs string, is_top_level boolean"
CHILDREN = "parent string, child string"
MEMBERS = "group string, scope string, entity_id string"
#: What a graph may weigh before it is collected for kernels.
MOST_EDGES = 20_000_000


@dataclass(frozen=True)
class Network:
    """Nodes, links and risk groups; every change gives a new network."""

    nodes: DataFrame
    links: DataFrame
    risk_groups: DataFrame
    children: DataFrame
    members: DataFrame
    attrs: dict = field(default_factory=dict)

    @classmethod
    def of(cls, spark: SparkSession, nodes: list[dict], links: list[dict], groups: list[dict] = (), children=(), members=(), attrs=None) -> Network:
        """From rows; a link without an id is named source|target|ordinal among its parallels."""
        names = [n["name"] for n in nodes]
        if len(set(names)) < len(names):
            raise ValueError(f"node {next(x for x in names if names.count(x) > 1)!r} is there twice")
        known, seen, lrows = set(names), {}, []
        for i, x in enumerate(links):
            for end in ("source", "target"):
                if x[end] not in known:
                    raise ValueError(f"link end {x[end]!r} is not a node")
            pair = (x["source"], x["target"])
            k = seen[pair] = seen.get(pair, -1) + 1
            lrows.append((x.get("link_id") or f"{pair[0]}|{pair[1]}|{k}", *pair, float(x.get("capacity", 1.0)), float(x.get("cost", 1.0)), bool(x.get("disabled", False)), sorted(set(x.get("risk_groups") or ())), json.dumps(x.get("attrs") or {}), i))
        nrows = [(n["name"], bool(n.get("disabled", False)), sorted(set(n.get("risk_groups") or ())), json.dumps(n.get("attrs") or {}), i) for i, n in enumerate(nodes)]
        grows = [(g["name"], bool(g.get("disabled", False)), json.dumps(g.get("attrs") or {}), bool(g.get("is_top_level", True))) for g in groups]
        make = spark.createDataFrame
        return cls(make(nrows, NODES), make(lrows, LINKS), make(grows, GROUPS), make(list(children), CHILDREN), make(list(members), MEMBERS), attrs or {})

    @classmethod
    def from_edges(cls, df: DataFrame, source: str = "source", target: str = "target", capacity: str | None = None, cost: str | None = None, default_capacity: float = 1.0, default_cost: float = 1.0, reverse: bool = False) -> Network:
        """From a table of edges of any size; nodes are the ends, ordered by name."""
        get = lambda c, d: F.coalesce(F.col(c).cast("double"), F.lit(d)) if c in df.columns else F.lit(d)
        e = df.select(F.col(source).cast("string").alias("source"), F.col(target).cast("string").alias("target"), get(capacity, default_capacity).alias("capacity"), get(cost, default_cost).alias("cost"))
        if reverse:
            e = e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"), "capacity", "cost"))
        nth = F.row_number().over(Window.partitionBy("source", "target").orderBy("capacity", "cost")) - 1
        none, blank = F.array().cast("array<string>"), F.lit("{}")
        links = e.withColumn("k", nth).select(F.concat_ws("|", "source", "target", "k").alias("link_id"), "source", "target", "capacity", "cost", F.lit(False).alias("disabled"), none.alias("risk_groups"), blank.alias("attrs"), F.xxhash64("source", "target", "k").alias("link_ord"))
        nodes = e.select(F.col("source").alias("name")).union(e.select("target")).distinct()
        nodes = nodes.select("name", F.lit(False).alias("disabled"), none.alias("risk_groups"), blank.alias("attrs"), F.xxhash64("name").alias("node_ord"))
        make = df.sparkSession.createDataFrame
        return cls(nodes, links, make([], GROUPS), make([], CHILDREN), make([], MEMBERS))

    def _flag(self, frame: str, key: str, ids, value: bool) -> Network:
        df = getattr(self, frame)
        if ids is not None:
            found = {r[0] for r in df.filter(F.col(key).isin(list(ids))).select(key).collect()}
            if set(ids) - found:
                raise ValueError(f"no such {frame}: {sorted(set(ids) - found)}")
            df = df.withColumn("disabled", F.when(F.col(key).isin(list(ids)), F.lit(value)).otherwise(F.col("disabled")))
        else:
            df = df.withColumn("disabled", F.lit(value))
        return replace(self, **{frame: df})

    def disable_nodes(self, *names: str) -> Network:
        return self._flag("nodes", "name", names, True)

    def enable_nodes(self, *names: str) -> Network:
        return self._flag("nodes", "name", names, False)

    def disable_links(self, *ids: str) -> Network:
        return self._flag("links", "link_id", ids, True)

    def enable_links(self, *ids: str) -> Network:
        return self._flag("links", "link_id", ids, False)

    def enable_all(self) -> Network:
        return self._flag("nodes", "name", None, False)._flag("links", "link_id", None, False)

    def disable_all(self) -> Network:
        return self._flag("nodes", "name", None, True)._flag("links", "link_id", None, True)

    def flag_risk_group(self, name: str, disabled: bool = True, recursive: bool = True) -> Network:
        """Flags the nodes and links that share the group or, with recursive, one below it."""
        from .operators.failure import descendants

        groups = descendants(self.children, [name]) if recursive else self.nodes.sparkSession.createDataFrame([(name,)], "group string")
        names = [r[0] for r in groups.collect()]
        hit = F.arrays_overlap("risk_groups", F.array(*map(F.lit, names)))
        change = lambda df: df.withColumn("disabled", F.when(hit, F.lit(disabled)).otherwise(F.col("disabled")))
        return replace(self, nodes=change(self.nodes), links=change(self.links))

    def edges(self) -> DataFrame:
        """Both directions of every link whose link and ends are enabled."""
        from .operators.topology import directed

        return directed(self.links)

    def graph(self, extra: list[tuple[str, str, float, float]] = ()) -> Graph:
        """The working graph: sorted names, then those of extra edges; costs cut to whole numbers.

        It is collected to be broadcast, so its size is checked first; ``operators.paths`` has the
        relational way for larger ones.
        """
        size = self.links.count()
        if 2 * size > MOST_EDGES:
            raise ValueError(f"{2 * size} edges; kernels take at most {MOST_EDGES}. Use the relational operators")
        names = sorted(r.name for r in self.nodes.select("name").collect())
        rows = self.links.select("link_id", "source", "target", "capacity", "cost").orderBy("link_id").collect()
        names += sorted({x for e in extra for x in e[:2]} - set(names))
        at = {n: i for i, n in enumerate(names)}
        edges = [(at[a], at[b], r.capacity, int(r.cost), r.link_id, way) for r in rows for a, b, way in ((r.source, r.target, "fwd"), (r.target, r.source, "rev"))]
        edges += [(at[a], at[b], c, int(k), None, None) for a, b, c, k in extra]
        cols = list(zip(*edges, strict=True)) if edges else [(), (), (), (), (), ()]
        return Graph(names, np.array(cols[0], dtype=np.int32), np.array(cols[1], dtype=np.int32), np.array(cols[2], dtype=float), np.array(cols[3], dtype=np.int64), list(cols[4]), list(cols[5]))

    def off(self) -> tuple[list[str], list[str]]:
        """Names of disabled nodes and links."""
        return [r[0] for r in self.nodes.filter("disabled").select("name").collect()], [r[0] for r in self.links.filter("disabled").select("link_id").collect()]
