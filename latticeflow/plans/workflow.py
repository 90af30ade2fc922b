"""Workflow steps: each asks the network one kind of question and stores plain results."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from ..functions.names import number_key
from ..functions.report import logger
from ..operators import aggregate as ag
from ..operators import hardware as hw
from .analysis import Analysis

log = logger("workflow")
STEPS: dict[str, Callable] = {}
#: What a step may be told, by its type.
OPTIONS = {
    "NetworkStats": {"include_disabled", "excluded_nodes", "excluded_links"},
    "BuildGraph": {"add_reverse"},
    "MaxFlow": {"source", "target", "mode", "failure_policy", "iterations", "parallelism", "shortest_path", "require_capacity", "flow_placement", "store_failure_patterns", "include_flow_details", "include_min_cut"},
    "TrafficMatrixPlacement": {"demand_set", "failure_policy", "iterations", "parallelism", "placement_rounds", "alpha", "alpha_from_step", "alpha_from_field", "store_failure_patterns", "include_flow_details", "include_used_edges"},
    "MaximumSupportedDemand": {"demand_set", "acceptance_rule", "alpha_start", "growth_factor", "alpha_min", "alpha_max", "resolution", "max_bracket_iters", "max_bisect_iters", "seeds_per_alpha", "placement_rounds"},
    "CostPower": {"include_disabled", "aggregation_level"},
}


#: How the search for the maximum supported demand goes, unless told otherwise.
SEARCH = {"alpha_start": 1.0, "growth_factor": 2.0, "alpha_min": 1e-6, "alpha_max": 1e9, "resolution": 0.01, "max_bracket_iters": 32, "max_bisect_iters": 32}


def step(name: str):
    def add(f):
        STEPS[name] = f
        return f

    return add


def run_steps(scenario) -> dict:
    """Runs the steps in order; data and metadata go to the scenario's results."""
    out = scenario.results
    for order, s in enumerate(scenario.steps):
        if s["type"] not in STEPS:
            raise ValueError(f"unknown step type {s['type']!r}")
        extra = set(s) - {"type", "name", "seed", "seed_source"} - OPTIONS.get(s["type"], set(s))
        if extra:
            raise ValueError(f"step {s['name']}: unknown keys {sorted(extra)}")
        began = time.time()
        log.info("step %d, %s (%s) begins", order, s["name"], s["type"])
        out.enter(s["name"], step_type=s["type"], seed=s["seed"], scenario_seed=scenario.seed, seed_source=s.get("seed_source", "none"))
        try:
            got = STEPS[s["type"]](scenario, s)
            out.put("metadata", {**got.get("metadata", {}), "duration_sec": time.time() - began})
            out.put("data", got["data"])
        except Exception as e:
            log.error("step %s (%s) failed after %.1f s: %s", s["name"], s["type"], time.time() - began, e)
            e.add_note(f"in step {s['name']!r} of type {s['type']}")
            raise
        finally:
            out.leave()
        log.info("step %s took %.1f s", s["name"], time.time() - began)
    return out


@step("NetworkStats")
def network_stats(scenario, s):
    n = scenario.network
    row = ag.network_stats(n.nodes, n.links, s.get("include_disabled", False), s.get("excluded_nodes", ()), s.get("excluded_links", ())).first()
    return {"data": row.asDict()}


@step("BuildGraph")
def build_graph(scenario, s):
    from ..sources.scenario import node_link

    return {"data": {"graph": node_link(scenario.network, s.get("add_reverse", True))}}


@step("CostPower")
def cost_power(scenario, s):
    n = scenario.network
    library = hw.library_frame(n.nodes.sparkSession, scenario.components)
    hw.validate(n.nodes, n.links, library)
    rows = hw.cost_power(n.nodes, n.links, library, int(s.get("aggregation_level", 2)), s.get("include_disabled", False)).orderBy("level", "path").collect()
    levels: dict = {}
    for r in rows:
        levels.setdefault(str(r.level), []).append({"path": r.path, "platform_capex": r.capex, "capex_total": r.capex, "power_total_watts": r.power_watts})
    return {"data": {"levels": levels, "context": {"aggregation_level": int(s.get("aggregation_level", 2))}}}


def _analysis(scenario, s) -> Analysis:
    """parallelism says into how many tasks the work is cut; 'auto' is as many as there are cores."""
    n = s.get("parallelism", "auto")
    if n != "auto" and (not isinstance(n, int) or n < 1):
        raise ValueError(f"step {s['name']}: parallelism must be auto or a positive number")
    return Analysis(scenario.network, None if n == "auto" else n)


def _patterns(scenario, s, a: Analysis):
    name = s.get("failure_policy")
    if name and name not in scenario.policies:
        raise ValueError(f"no failure policy {name!r}")
    policy = scenario.policies.get(name)
    seed = s["seed"] if s["seed"] is not None else (policy or {}).get("seed")
    return a.monte_carlo(policy, int(s.get("iterations", 1)), seed)


def _results(rows, entry, traces: bool = False) -> tuple[dict, list[dict]]:
    """The baseline and one result for each pattern, with its flows and their summary; with traces,
    also how the pattern was drawn the first time."""
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r.failure_id, []).append(r)
    out = []
    for key, flows in by.items():
        f = flows[0]
        made = [entry(r) for r in flows]
        demand, placed = sum(x["demand"] for x in made), sum(x["placed"] for x in made)
        out.append({"failure_id": key, "failure_state": {"excluded_nodes": sorted(f.excluded_nodes), "excluded_links": sorted(f.excluded_links)}, "occurrence_count": f.occurrence_count, "flows": made, "summary": {"total_demand": demand, "total_placed": placed, "overall_ratio": placed / demand if demand else 1.0, "dropped_flows": sum(x["placed"] < x["demand"] - 1e-9 for x in made), "num_flows": len(made)}})
        if traces:
            out[-1]["failure_trace"] = json.loads(f.trace) if f.trace else None
    base = next((x for x in out if x["failure_id"] == ""), None)
    return base, [x for x in out if x is not base]


def _rounds(s) -> int | str:
    """placement_rounds, checked and reported.  A placement here ends when nothing more fits, so there
    is nothing left to a further round."""
    n = s.get("placement_rounds", "auto")
    if n != "auto" and (not isinstance(n, int) or isinstance(n, bool) or n < 1):
        raise ValueError(f"step {s['name']}: placement_rounds must be auto or a positive number")
    return n


def _costs(r) -> dict:
    return {number_key(k): v for k, v in sorted((r.cost_distribution or {}).items())}


@step("MaxFlow")
def max_flow(scenario, s):
    a = _analysis(scenario, s)
    rows = a.max_flow(s["source"], s["target"], s.get("mode", "combine"), s.get("shortest_path", False), s.get("require_capacity", True), s.get("flow_placement", "PROPORTIONAL"), _patterns(scenario, s, a), s.get("include_min_cut", False)).collect()
    entry = lambda r: {"source": r.src_label, "destination": r.dst_label, "priority": 0, "demand": r.total_flow, "placed": r.total_flow, "dropped": 0.0, "cost_distribution": _costs(r) if s.get("include_flow_details") else {}, "data": {"edges": [f"{x.link_id}:{x.direction}" for x in r.saturated], "edges_kind": "min_cut"} if s.get("include_min_cut") else {}}
    base, results = _results(rows, entry, s.get("store_failure_patterns", False))
    return {"data": {"baseline": base, "flow_results": results, "context": {k: s.get(k) for k in ("source", "target", "mode")}}, "metadata": {"iterations": int(s.get("iterations", 1)), "unique_patterns": len(results)}}


@step("TrafficMatrixPlacement")
def traffic_matrix_placement(scenario, s):
    a = _analysis(scenario, s)
    alpha = float(s.get("alpha", 1.0))
    if s.get("alpha_from_step"):
        at = scenario.results["steps"].get(s["alpha_from_step"])
        for k in str(s.get("alpha_from_field", "data.alpha_star")).split("."):
            if not isinstance(at, dict) or k not in at:
                raise ValueError(f"step {s['alpha_from_step']!r} has no {s.get('alpha_from_field', 'data.alpha_star')!r}")
            at = at[k]
        alpha = float(at)
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    rows = a.place(scenario.demand_set(s.get("demand_set", "default")), alpha, _patterns(scenario, s, a)).collect()
    entry = lambda r: {"source": r.src, "destination": r.dst, "priority": r.priority, "demand": r.demand, "placed": r.placed, "dropped": r.demand - r.placed, "cost_distribution": _costs(r) if s.get("include_flow_details") else {}, "data": {"edges": list(r.edges), "edges_kind": "used"} if s.get("include_used_edges") else {}}
    base, results = _results(rows, entry, s.get("store_failure_patterns", False))
    return {"data": {"baseline": base, "flow_results": results, "context": {"demand_set": s.get("demand_set", "default"), "alpha": alpha, "placement_rounds": _rounds(s)}}, "metadata": {"iterations": int(s.get("iterations", 1)), "unique_patterns": len(results)}}


@step("MaximumSupportedDemand")
def maximum_supported_demand(scenario, s):
    demands = scenario.demand_set(s.get("demand_set", "default"))
    names = {"alpha_start": "alpha_start", "growth_factor": "growth", "alpha_min": "alpha_min", "alpha_max": "alpha_max", "resolution": "resolution", "max_bracket_iters": "max_bracket", "max_bisect_iters": "max_bisect"}
    how = {names[k]: s[k] for k in names if k in s}
    rule, seeds = s.get("acceptance_rule", "hard"), s.get("seeds_per_alpha", 1)
    if rule != "hard":
        raise ValueError(f"step {s['name']}: acceptance_rule {rule!r} is not there; 'hard' is")
    if not isinstance(seeds, int) or isinstance(seeds, bool) or seeds < 1:
        raise ValueError(f"step {s['name']}: seeds_per_alpha must be a positive number")
    probes: dict[float, bool] = {}
    alpha = Analysis(scenario.network).maximum_supported_demand(demands, probes=probes, **how)
    # Placement draws nothing at random: every seed would answer alike.
    context = {"demand_set": s.get("demand_set", "default"), "acceptance_rule": rule, "seeds_per_alpha": seeds, "placement_rounds": _rounds(s)}
    context |= {k: s.get(k, d) for k, d in SEARCH.items()}
    return {"data": {"alpha_star": alpha, "context": context, "base_demands": demands, "probes": [{"alpha": a, "feasible": ok} for a, ok in sorted(probes.items())]}}
