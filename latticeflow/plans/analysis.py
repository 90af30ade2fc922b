"""Capacity questions over a network: kernels on a broadcast graph, one row of work each.

Work is rows of (failure pattern, pair of groups); every row is independent, so patterns and pairs
spread over all tasks.  What comes back is a DataFrame.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import failure_id
from ..model import Network
from ..operators import demand as dm
from ..operators import failure as fl
from ..operators.select import select_nodes
from . import kernels as kn

ROWS = 4096  # that a task holds before it passes them on
BASE = [("", [], [], 1, "")]
PATTERNS = "failure_id string, excluded_nodes array<string>, excluded_links array<string>, occurrence_count long, trace string"
FLOW = PATTERNS + ", src_label string, dst_label string, total_flow double, cost_distribution map<double,double>, saturated array<struct<link_id:string,direction:string,less:double>>"
PATHS = "src_label string, dst_label string, cost double, hops array<struct<node:string,edges:array<struct<link_id:string,direction:string>>>>"
PLACED = PATTERNS + ", demand_id string, src string, dst string, priority int, demand double, placed double, cost_distribution map<double,double>, edges array<string>"


class Analysis:
    """Questions about one network, with or without nodes and links taken out."""

    def __init__(self, network: Network, partitions: int | None = None) -> None:
        self.network = network
        self.spark = network.nodes.sparkSession
        self.partitions = partitions or self.spark.sparkContext.defaultParallelism
        self.off_nodes, self.off_links = network.off()
        self._graphs: dict[tuple, kn.Graph] = {}

    # Groups -------------------------------------------------------------------------------------

    def groups(self, selector, mode: str) -> dict[str, list[str]]:
        rows = select_nodes(self.network.nodes, selector, "workflow").orderBy("node_ord").collect()
        if not rows:
            raise ValueError(f"no node meets {selector!r}")
        out: dict[str, list[str]] = {}
        for r in rows:
            out.setdefault(r.label, []).append(r.name)
        if mode not in ("combine", "pairwise"):
            raise ValueError(f"unknown mode {mode!r}")
        return out if mode == "pairwise" else {"|".join(out): [n for x in out.values() for n in x]}

    def pairs(self, source, target, mode: str) -> list[tuple[str, str, list[str], list[str]]]:
        s, t = self.groups(source, mode), self.groups(target, mode)
        return [(a, b, s[a], t[b]) for a in s for b in t]

    def baseline(self) -> DataFrame:
        return self.spark.createDataFrame(BASE, PATTERNS)

    def patterns(self, excluded_nodes: Sequence[str] = (), excluded_links: Sequence[str] = ()) -> DataFrame:
        """One pattern from explicit exclusions."""
        n, k = sorted(excluded_nodes), sorted(excluded_links)
        return self.spark.createDataFrame([(failure_id(n, k), n, k, 1, "")], PATTERNS)

    def monte_carlo(self, policy: Mapping | None, iterations: int, seed: int | None) -> DataFrame:
        """The baseline and each distinct pattern of so many draws, with how often it came."""
        if not policy or not any(m.get("rules") for m in policy.get("modes", [])):
            return self.baseline()
        @F.pandas_udf("string")
        def named(nodes: pd.Series, links: pd.Series) -> pd.Series:
            return pd.Series([failure_id(list(n), list(k)) for n, k in zip(nodes, links, strict=True)], dtype=object)

        drawn = fl.distinct_patterns(fl.sample(self.network, policy, iterations, seed))
        rows = drawn.select(named("excluded_nodes", "excluded_links").alias("failure_id"), "excluded_nodes", "excluded_links", "occurrence_count", "trace")
        return self.baseline().unionByName(rows.filter("failure_id <> ''")).unionByName(rows.filter("failure_id = ''").withColumn("failure_id", F.lit("none")))

    def graph(self, extra: Sequence = ()) -> kn.Graph:
        """The working graph, collected once for each set of extra edges."""
        key = tuple(extra)
        if key not in self._graphs:
            self._graphs[key] = self.network.graph(list(extra))
        return self._graphs[key]

    # Work ---------------------------------------------------------------------------------------

    def _over(self, patterns: DataFrame, units: list, graph: kn.Graph, kernel, schema: str) -> DataFrame:
        """kernel(graph, nodes, edges, unit) gives rows; units and patterns are crossed on purpose:
        both are question-sized, and each combination is one piece of work."""
        sent = self.spark.sparkContext.broadcast((graph, units, self.off_nodes, self.off_links))
        work = patterns.withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(max(0, len(units) - 1))))) if units else patterns.withColumn("unit", F.lit(0)).limit(0)
        def run(batches):
            g, units, off_n, off_l = sent.value
            for pdf in batches:
                rows = []
                for r in pdf.itertuples(index=False):
                    nodes, edges = g.masks([*off_n, *r.excluded_nodes], [*off_l, *r.excluded_links])
                    head = (r.failure_id, list(r.excluded_nodes), list(r.excluded_links), r.occurrence_count, r.trace)
                    head = head if schema.startswith(PATTERNS) else ()
                    for x in kernel(g, nodes, edges, units[r.unit]):
                        rows.append((*head, *x))
                        if len(rows) == ROWS:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                yield pd.DataFrame(rows, columns=columns)

        columns = [f.name for f in self.spark.createDataFrame([], schema).schema]
        return work.repartition(self.partitions).mapInPandas(run, schema)

    def ask(self, kernel, schema: str, units: list | None = None, patterns: DataFrame | None = None, extra: list = ()) -> DataFrame:
        """A user's own kernel(graph, nodes, edges, unit) over all units and patterns.

        It gives rows of the schema; a schema that begins with PATTERNS gets the pattern in front.
        extra lists more edges (from, to, capacity, cost).
        """
        return self._over(patterns if patterns is not None else self.baseline(), units or [None], self.graph(extra), kernel, schema)

    def max_flow(self, source, target, mode: str = "combine", shortest_path: bool = False, require_capacity: bool = True, placement: str = kn.PROPORTIONAL, patterns: DataFrame | None = None, sensitivity: bool = False) -> DataFrame:
        """Flow between groups; overlapping groups have none.  With sensitivity, also the full edges
        without which less would flow."""
        units, extra = [], []
        for k, (a, b, s, t) in enumerate(self.pairs(source, target, mode)):
            units.append((a, b, f"_s{k}", f"_t{k}", bool(set(s) & set(t))))
            extra += [(f"_s{k}", n, kn.LARGE, 0) for n in s] + [(n, f"_t{k}", kn.LARGE, 0) for n in t]
        how = {"placement": placement, "shortest_path": shortest_path, "require_capacity": require_capacity}

        def kernel(g, nodes, edges, unit):
            a, b, s, t, overlap = unit
            if overlap:
                return [(a, b, 0.0, {}, [])]
            f = kn.max_flow(g, g.index[s], g.index[t], nodes, edges, **how)
            less = kn.sensitivity(g, g.index[s], g.index[t], nodes, edges, **how) if sensitivity else {}
            return [(a, b, f.total, f.by_cost, [{"link_id": g.link[e], "direction": g.direction[e], "less": x} for e, x in less.items()])]

        return self._over(patterns if patterns is not None else self.baseline(), units, self.graph(extra), kernel, FLOW)

    def sensitivity(self, source, target, mode: str = "combine", **how) -> DataFrame:
        """(src_label, dst_label, link_id, direction, less) and the pattern."""
        rows = self.max_flow(source, target, mode, sensitivity=True, **how)
        return rows.select("failure_id", "occurrence_count", "src_label", "dst_label", F.explode("saturated").alias("x")).select("failure_id", "occurrence_count", "src_label", "dst_label", "x.*")

    def _path_units(self, source, target, mode: str):
        return [(a, b, s, t) for a, b, s, t in self.pairs(source, target, mode)]

    def shortest_costs(self, source, target, mode: str = "combine", patterns: DataFrame | None = None) -> DataFrame:
        """(src_label, dst_label, cost); infinite where groups overlap or nothing leads there."""

        def kernel(g, nodes, edges, unit):
            a, b, s, t = unit
            return [(a, b, float(_nearest(g, nodes, edges, s, t)[0]))]

        return self._over(patterns if patterns is not None else self.baseline(), self._path_units(source, target, mode), self.graph(), kernel, PATTERNS + ", src_label string, dst_label string, cost double")

    def shortest_paths(self, source, target, mode: str = "combine", split_parallel_edges: bool = False, patterns: DataFrame | None = None) -> DataFrame:
        """All cheapest paths between groups, in order of nodes."""

        def kernel(g, nodes, edges, unit):
            a, b, s, t = unit
            best, ends = _nearest(g, nodes, edges, s, t)
            for x, same in itertools.groupby(ends, lambda e: e[0]):
                _, pred = kn.spf(g, x, nodes, edges)
                for p in heapq.merge(*(kn.dag_paths(g, pred, x, y, split_parallel_edges) for _, y in same)):
                    yield a, b, float(best), _hops(g, p)

        return self._over(patterns if patterns is not None else self.baseline(), self._path_units(source, target, mode), self.graph(), kernel, PATHS)

    def k_shortest_paths(self, source, target, k: int = 3, mode: str = "pairwise", most_cost: float = math.inf, factor: float | None = None, patterns: DataFrame | None = None) -> DataFrame:
        """Up to k loop-free paths between the nearest two nodes of each pair of groups."""

        def kernel(g, nodes, edges, unit):
            a, b, s, t = unit
            _, ends = _nearest(g, nodes, edges, s, t)
            if not ends:
                return []
            x, y = ends[0]
            return [(a, b, float(c), _hops(g, p)) for c, p in kn.k_shortest(g, x, y, nodes, edges, k, most_cost, factor)]

        return self._over(patterns if patterns is not None else self.baseline(), self._path_units(source, target, mode), self.graph(), kernel, PATHS)

    def single(self, policy: Mapping | None, seed: int | None) -> DataFrame:
        """The one pattern that a policy draws first, for a run of a single scenario."""
        drawn = self.monte_carlo(policy, 1, seed)
        return drawn.filter("failure_id <> ''") if policy else drawn

    def place(self, demands: Sequence[Mapping], alpha: float = 1.0, patterns: DataFrame | None = None, details: bool = True) -> DataFrame:
        """Places demands by priority on shared capacity, for each pattern on its own.

        Demands are expanded on the whole network, so what failed nodes can't send counts as dropped.
        """
        concrete, extra = dm.expand(self.network.nodes, demands)
        return self._place([(concrete, alpha)], extra, patterns, details).drop("alpha")

    def _place(self, units: list, extra: list, patterns: DataFrame | None, details: bool) -> DataFrame:
        def kernel(g, nodes, edges, unit):
            demands, alpha = unit
            rows = [(g.index[d["src"]], g.index[d["dst"]], d["volume"] * alpha, d["preset"]) for d in demands]
            out = []
            for d, (placed, costs, on) in zip(demands, kn.place_demands(g, rows, nodes, edges), strict=True):
                used = [f"{g.link[e]}:{g.direction[e]}" for e in sorted(on) if g.link[e]] if details else []
                out.append((d["demand_id"], d["src"], d["dst"], d["priority"], d["volume"] * alpha, placed, costs, used, alpha))
            return out

        return self._over(patterns if patterns is not None else self.baseline(), units, self.graph(extra), kernel, PLACED + ", alpha double")

    def maximum_supported_demand(self, demands: Sequence[Mapping], alpha_start: float = 1.0, growth: float = 2.0, alpha_min: float = 1e-6, alpha_max: float = 1e9, resolution: float = 0.01, max_bracket: int = 32, max_bisect: int = 32, width: int = 8, probes: dict | None = None) -> float:
        """The largest factor at which all demands are placed whole.

        Several factors are tried in each job, as rows of work, to save rounds; probes gets them all.
        """
        concrete, extra = dm.expand(self.network.nodes, demands)

        def feasible(alphas: list[float]) -> dict[float, bool]:
            rows = self._place([(concrete, a) for a in alphas], extra, None, False).groupBy("alpha").agg(F.sum("demand").alias("d"), F.sum("placed").alias("p")).collect()
            found = {r.alpha: r.d == 0 or r.p / r.d >= 1 - 1e-12 for r in rows}
            if probes is not None:
                probes.update(found)
            return found

        return search(feasible, alpha_start, growth, alpha_min, alpha_max, resolution, max_bracket, max_bisect, width)


def search(feasible, start: float = 1.0, growth: float = 2.0, least: float = 1e-6, most: float = 1e9, resolution: float = 0.01, max_bracket: int = 32, max_bisect: int = 32, width: int = 8) -> float:
    """Brackets by the growth factor, then narrows; gives the feasible lower end.

    feasible takes a list of factors and says which are; ValueError if none is.
    """
    ups = [start]
    while len(ups) <= max_bracket and ups[-1] < most:
        ups.append(min(most, ups[-1] * growth))
    low = high = None
    for i in range(0, len(ups), width):
        got = feasible(ups[i : i + width])
        for a in ups[i : i + width]:
            if got[a]:
                low = a
            else:
                high = a
                break
        if high is not None:
            break
    if low is None:
        downs = [start]
        while len(downs) <= max_bracket and downs[-1] > least:
            downs.append(max(least, downs[-1] / growth))
        for i in range(1, len(downs), width):
            got = feasible(downs[i : i + width])
            for a in downs[i : i + width]:
                if got[a]:
                    low = a
                    break
                high = a
            if low is not None:
                break
        if low is None:
            raise ValueError("no factor is feasible")
    if high is None:
        return low
    for _ in range(max_bisect):
        if high - low <= resolution:
            break
        points = [low + (high - low) * (k + 1) / (width + 1) for k in range(width)]
        got = feasible(points)
        for a in points:
            if not got[a]:
                high = a
                break
            low = a
    return low


def _nearest(g: kn.Graph, nodes, edges, s: list[str], t: list[str]):
    """The least cost between two groups, and the node pairs that have it."""
    if set(s) & set(t):
        return math.inf, []
    best, ends = math.inf, []
    for x in sorted(g.index[n] for n in s):
        dist, _ = kn.spf(g, x, nodes, edges)
        for y in sorted(g.index[n] for n in t):
            if dist[y] < best:
                best, ends = dist[y], [(x, y)]
            elif dist[y] == best and not math.isinf(best):
                ends.append((x, y))
    return best, ends


def _hops(g: kn.Graph, path) -> list[dict]:
    return [{"node": g.names[u], "edges": [{"link_id": g.link[e], "direction": g.direction[e]} for e in es]} for u, es in path]
