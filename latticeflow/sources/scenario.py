"""Scenarios in YAML: checked, expanded and turned into a network, demands, policies and steps."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.names import derive_seed, expand_block, expand_brackets, expand_refs, join_path
from ..model import Network
from ..operators import failure as fl
from ..operators import hardware as hw
from ..operators.demand import check as check_demand
from ..plans.results import Results

#: The keys that each part of a scenario may have.
TOP = {"vars", "seed", "blueprints", "network", "risk_groups", "failures", "demands", "workflow", "components"}
NETWORK = {"name", "version", "nodes", "links", "node_rules", "link_rules"}
NODE = {"count", "template", "blueprint", "params", "nodes", "attrs", "disabled", "risk_groups"}
LINK = {"source", "target", "pattern", "count", "capacity", "cost", "disabled", "risk_groups", "attrs", "expand", "bidirectional"}
NODE_RULE = {"path", "match", "disabled", "risk_groups", "attrs", "expand"}
LINK_RULE = {"source", "target", "link_match", "bidirectional", "capacity", "cost", "disabled", "risk_groups", "attrs", "expand"}
DEMAND = {"id", "source", "target", "volume", "priority", "mode", "group_mode", "flow_policy", "attrs", "expand"}


#: What kind of value a key takes, wherever it stands.
KINDS = {
    "number": {"capacity", "cost", "volume", "weight", "probability"},
    "whole number": {"count", "priority"},
    "truth value": {"disabled", "bidirectional", "active_only"},
    "list": {"risk_groups", "conditions", "children"},
    "mapping": {"attrs", "params", "nodes", "link_match", "expand"},
    "text": {"pattern", "template", "blueprint", "group_mode", "logic"},
}
TESTS = {
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "whole number": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "truth value": lambda v: isinstance(v, bool),
    "list": lambda v: isinstance(v, list),
    "mapping": lambda v: isinstance(v, Mapping),
    "text": lambda v: isinstance(v, str),
}


def keys(part: Mapping, allowed: set[str], where: str) -> None:
    if not isinstance(part, Mapping):
        raise ValueError(f"{where} must be a mapping")
    if extra := set(part) - allowed:
        raise ValueError(f"{where}: unknown keys {sorted(map(str, extra))}")
    for kind, names in KINDS.items():
        for k in names & set(part):
            v = part[k]
            if v is not None and not TESTS[kind](v) and not (isinstance(v, str) and v.startswith("$")):
                raise ValueError(f"{where}: {k} must be a {kind}, not {v!r}")


def text_keys(value):
    """All keys as text; YAML's booleans as keys read True and False."""
    if isinstance(value, Mapping):
        return {str(k): text_keys(v) for k, v in value.items()}
    return [text_keys(v) for v in value] if isinstance(value, list) else value


def load(text: str) -> dict:
    """Parsed and checked for unknown keys and wrong shapes."""
    data = text_keys(yaml.safe_load(text) or {})
    keys(data, TOP, "scenario")
    net = data.get("network") or {}
    keys(net, NETWORK, "network")
    for name, kind, of in (("nodes", Mapping, net), ("links", list, net), ("node_rules", list, net), ("link_rules", list, net), ("blueprints", Mapping, data), ("demands", Mapping, data), ("failures", Mapping, data), ("components", Mapping, data), ("risk_groups", list, data), ("workflow", list, data)):
        if of.get(name) is not None and not isinstance(of[name], kind):
            raise ValueError(f"{name} must be a {'list' if kind is list else 'mapping'}")
    for name, n in (net.get("nodes") or {}).items():
        keys(n or {}, NODE, f"node {name}")
    for allowed, part in ((LINK, "links"), (NODE_RULE, "node_rules"), (LINK_RULE, "link_rules")):
        for x in net.get(part) or []:
            keys(x, allowed, part)
    for name, b in (data.get("blueprints") or {}).items():
        keys(b, {"nodes", "links"}, f"blueprint {name}")
        for x in b.get("links") or []:
            keys(x, LINK, f"blueprint {name} links")
    for name, ds in (data.get("demands") or {}).items():
        for d in ds or []:
            keys(d, DEMAND, f"demands {name}")
            if not d.get("source") or not d.get("target"):
                raise ValueError(f"demands {name}: source and target are needed")
    for g in data.get("risk_groups") or []:
        if not isinstance(g, str) and "generate" not in g and not g.get("name"):
            raise ValueError("a risk group needs a name")
    for s in data.get("workflow") or []:
        if not s.get("type"):
            raise ValueError("a step needs a type")
    limits(data)
    return data


#: The words that a key may have, and the least numbers.
WORDS = {"mode": {"pairwise", "combine", "per_group", "group_pairwise", "all", "random", "choice"}, "group_mode": {"flatten", "per_group", "group_pairwise"}, "pattern": {"mesh", "one_to_one"}, "logic": {"and", "or"}, "scope": {"node", "link", "risk_group"}}
LEAST = {"capacity": 0, "cost": 0, "volume": 0, "weight": 0, "probability": 0, "count": 0, "iterations": 0}


def limits(part, where: str = "scenario") -> None:
    """Words and numbers out of range are refused wherever they stand, but for free attributes."""
    if isinstance(part, list):
        for k, x in enumerate(part):
            limits(x, f"{where}[{k}]")
    if not isinstance(part, Mapping):
        return
    for k, v in part.items():
        if isinstance(v, str) and not v.startswith("$"):
            if k in WORDS and v not in WORDS[k]:
                raise ValueError(f"{where}: {k} is one of {sorted(WORDS[k])}, not {v!r}")
        elif k in LEAST and isinstance(v, (int, float)) and not isinstance(v, bool) and v < LEAST[k]:
            raise ValueError(f"{where}: {k} must not be below {LEAST[k]}, is {v}")
        elif k not in ("attrs", "vars", "params", "expand", "components"):
            limits(v, f"{where}.{k}")


# Expansion ---------------------------------------------------------------------------------------


class _Plan:
    """Nodes and links in the making.  Config decides its size, so it lives on the driver."""

    def __init__(self, blueprints: Mapping) -> None:
        self.blueprints, self.nodes, self.links, self.later = blueprints, {}, [], []

    def add(self, name: str, spec: Mapping | None, parent: str = "", given: Mapping | None = None, stack: tuple = ()) -> None:
        """One node group: a blueprint, nested groups, or plain nodes; children inherit."""
        spec = dict(spec or {})
        given = given or {}
        attrs = {**(given.get("attrs") or {}), **(spec.get("attrs") or {})}
        down = {"attrs": attrs, "disabled": bool(given.get("disabled")) or bool(spec.get("disabled")), "risk_groups": expand_refs([*(given.get("risk_groups") or []), *(spec.get("risk_groups") or [])])}
        for one in expand_brackets(name):
            path = join_path(parent, one)
            if spec.get("blueprint"):
                use = spec["blueprint"]
                if use not in self.blueprints:
                    raise ValueError(f"unknown blueprint {use!r}")
                if use in stack:
                    raise ValueError(f"blueprint {use!r} contains itself")
                groups = _with_params(self.blueprints[use].get("nodes") or {}, spec.get("params") or {})
                for n, s in groups.items():
                    self.add(n, s, path, down, (*stack, use))
                for x in self.blueprints[use].get("links") or []:
                    self.later += [(path, y) for y in expand_block(x)]
            elif spec.get("nodes"):
                for n, s in spec["nodes"].items():
                    self.add(n, s, path, down, stack)
            else:
                count = spec.get("count")
                template = spec.get("template", f"{one.rsplit('/', 1)[-1]}-{{n}}")
                names = [path] if count is None and "template" not in spec else [join_path(path, template.replace("{n}", str(i))) for i in range(1, int(count or 1) + 1)]
                for n in names:
                    if n in self.nodes:
                        raise ValueError(f"node {n!r} is there twice")
                    self.nodes[n] = {"name": n, "disabled": down["disabled"], "risk_groups": down["risk_groups"], "attrs": {"type": "node", **attrs}}


def _with_params(groups: Mapping, params: Mapping) -> dict:
    """Blueprint groups with dotted overrides such as spine.attrs.hw."""
    out = json.loads(json.dumps(groups))
    for dotted, value in params.items():
        *way, last = dotted.split(".")
        at = out
        for k in way:
            at = at.setdefault(k, {})
        if not way:
            raise ValueError(f"parameter {dotted!r} needs a group and a key")
        at[last] = value
    return out


def _match_nodes(nodes: list[dict], selector, parent: str = "") -> list[str]:
    """The driver's form of selection, for links between the nodes of a plan."""
    import re

    s = {"path": selector} if isinstance(selector, str) else dict(selector)
    out = nodes
    if s.get("path"):
        rx = re.compile(join_path(parent, s["path"]) if parent else s["path"].removeprefix("/"))
        out = [n for n in out if rx.match(n["name"])]
    elif parent:
        out = [n for n in out if n["name"].startswith(parent + "/")]
    if s.get("match"):
        out = [n for n in out if holds({**n["attrs"], **{k: n[k] for k in ("name", "disabled", "risk_groups")}}, s["match"].get("conditions", []), s["match"].get("logic", "or"))]
    if s.get("group_by"):
        out = [n for n in out if n["attrs"].get(s["group_by"], n.get(s["group_by"])) is not None]
    return [n["name"] for n in out if not (s.get("active_only") and n["disabled"])]


def holds(values: Mapping, items: list, logic: str = "and") -> bool:
    """Conditions on plain values, with the same meaning as their column form."""

    def one(c: Mapping) -> bool:
        v, op, x = values, c["op"], c.get("value")
        for k in c["attr"].split("."):
            v = v.get(k) if isinstance(v, Mapping) else None
        if op in ("exists", "not_exists"):
            return (v is not None) == (op == "exists")
        if v is None:
            return op == "not_contains"
        if op in ("==", "!="):
            return (v == x) == (op == "==")
        if op in ("in", "not_in"):
            return (v in x) == (op == "in")
        if op in ("contains", "not_contains"):
            return (isinstance(v, (str, list, tuple, set)) and x in v) == (op == "contains")
        try:
            a, b = float(v), float(x)
        except (TypeError, ValueError):
            return False
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    if not items:
        return True
    return (all if logic == "and" else any)(one(c) for c in items)


def _link(plan: _Plan, spec: Mapping, parent: str = "") -> None:
    nodes = list(plan.nodes.values())
    s, t = _match_nodes(nodes, spec["source"], parent), _match_nodes(nodes, spec["target"], parent)
    pattern = spec.get("pattern", "mesh")
    if pattern == "mesh":
        pairs = [(a, b) for a in s for b in t]
    elif pattern == "one_to_one":
        if not s or not t:
            return
        if max(len(s), len(t)) % min(len(s), len(t)):
            raise ValueError(f"one_to_one: {len(s)} and {len(t)} are no multiples")
        pairs = [(s[i % len(s)], t[i % len(t)]) for i in range(max(len(s), len(t)))]
    else:
        raise ValueError(f"unknown pattern {pattern!r}")
    seen = set()
    for a, b in pairs:
        if a == b or frozenset((a, b)) in seen:
            continue
        seen.add(frozenset((a, b)))
        for _ in range(int(spec.get("count", 1))):
            plan.links.append({"source": a, "target": b, "capacity": float(spec.get("capacity", 1.0)), "cost": float(spec.get("cost", 1.0)), "disabled": bool(spec.get("disabled", False)), "risk_groups": expand_refs(spec.get("risk_groups") or []), "attrs": dict(spec.get("attrs") or {})})


def _change(x: dict, rule: Mapping) -> None:
    for k in ("capacity", "cost"):
        if rule.get(k) is not None and k in x:
            x[k] = float(rule[k])
    if rule.get("disabled") is not None:
        x["disabled"] = bool(rule["disabled"])
    if rule.get("risk_groups") is not None:
        x["risk_groups"] = expand_refs(rule["risk_groups"])
    x["attrs"] = {**x["attrs"], **(rule.get("attrs") or {})}


def expand_network(data: Mapping) -> tuple[list[dict], list[dict]]:
    """Nodes and links in order: nodes, node rules, blueprint links, links, link rules."""
    net = data.get("network") or {}
    plan = _Plan(data.get("blueprints") or {})
    for name, spec in (net.get("nodes") or {}).items():
        plan.add(name, spec)
    for rule in net.get("node_rules") or []:
        for r in expand_block(rule):
            for n in _match_nodes(list(plan.nodes.values()), {k: r[k] for k in ("path", "match") if r.get(k)}):
                _change(plan.nodes[n], r)
    for parent, x in plan.later:
        _link(plan, x, parent)
    for x in net.get("links") or []:
        for y in expand_block(x):
            _link(plan, y)
    for rule in net.get("link_rules") or []:
        for r in expand_block(rule):
            s, t = (set(_match_nodes(list(plan.nodes.values()), r[e])) for e in ("source", "target"))
            for x in plan.links:
                hit = (x["source"] in s and x["target"] in t) or (r.get("bidirectional", True) and x["source"] in t and x["target"] in s)
                if hit and (not r.get("link_match") or holds({**x["attrs"], **x}, r["link_match"].get("conditions", []), r["link_match"].get("logic", "or"))):
                    _change(x, r)
    return list(plan.nodes.values()), plan.links


def expand_groups(specs: list) -> tuple[list[dict], list[tuple[str, str]], list[dict], list[dict]]:
    """Risk groups, (parent, child) pairs, membership rules and rules that generate groups."""
    groups, kids, rules, generate = {}, [], [], []

    def add(spec, top: bool) -> list[str]:
        spec = {"name": spec} if isinstance(spec, str) else spec
        names = expand_brackets(spec["name"])
        for n in names:
            old = groups.get(n)
            groups[n] = {"name": n, "disabled": bool(spec.get("disabled", old["disabled"] if old else False)), "attrs": {**(old["attrs"] if old else {}), **(spec.get("attrs") or {})}, "is_top_level": top or bool(old and old["is_top_level"])}
            if spec.get("membership"):
                rules.append({"name": n, **spec["membership"]})
            for c in spec.get("children") or []:
                kids.extend((n, x) for x in add(c, False))
        return names

    for s in specs or []:
        if not isinstance(s, str) and "generate" in s:
            generate.append(s["generate"])
        else:
            add(s, True)
    return list(groups.values()), sorted(set(kids)), rules, generate


@dataclass
class Scenario:
    """All that a scenario says, ready to run."""

    network: Network
    demands: dict[str, list[dict]]
    policies: dict[str, dict]
    components: dict
    steps: list[dict]
    seed: int | None = None
    results: Results = field(default_factory=Results)

    @classmethod
    def from_yaml(cls, spark: SparkSession, text: str, components: Mapping | None = None) -> Scenario:
        data = load(text)
        seed = data.get("seed")
        nodes, links = expand_network(data)
        groups, kids, rules, generate = expand_groups(data.get("risk_groups"))
        network = _grouped(spark, nodes, links, groups, kids, rules, generate)
        policies = {}
        for name, p in (data.get("failures") or {}).items():
            policies[name] = fl.check_policy({**p, "seed": derive_seed(seed, "failure_policy", f"failure_policy:{name}")})
        demands = {name: [x for d in ds or [] for x in expand_block(d)] for name, ds in (data.get("demands") or {}).items()}
        for d in (d for ds in demands.values() for d in ds):
            check_demand(d)
        steps, seen = [], set()
        for i, s in enumerate(data.get("workflow") or []):
            name = s.get("name") or f"{s['type']}_{i}"
            if name in seen:
                raise ValueError(f"step name {name!r} is there twice")
            seen.add(name)
            own = s.get("seed") is not None
            steps.append({**s, "name": name, "seed": s["seed"] if own else derive_seed(seed, "workflow_step", name), "seed_source": "explicit-step" if own else "scenario-derived" if seed is not None else "none"})
        out = cls(network, demands, policies, hw.merge_libraries(components or {}, data.get("components") or {}), steps, seed)
        out.results["scenario"] = {"seed": seed, "failures": {k: fl.policy_dict(v) for k, v in policies.items()}, "demands": demands}
        return out

    def demand_set(self, name: str = "default") -> list[dict]:
        if name in self.demands:
            return self.demands[name]
        if name == "default" and len(self.demands) == 1:
            return next(iter(self.demands.values()))
        raise ValueError(f"no demand set {name!r}")

    def run(self) -> dict:
        from ..plans.workflow import run_steps

        return run_steps(self)


def _grouped(spark, nodes, links, groups, kids, rules, generate) -> Network:
    """Attaches, disables, adds members by rule, checks for cycles, generates, checks references."""
    import re

    below: dict[str, set] = {}

    def under(g: str, on: tuple = ()) -> set[str]:
        if g in on:
            raise ValueError(f"risk groups run in a circle: {' > '.join([*on[on.index(g):], g])}")
        if g not in below:
            below[g] = {g}.union(*(under(c, (*on, g)) for p, c in kids if p == g))
        return below[g]

    for g in [g["name"] for g in groups]:
        under(g)
    off = {x for g in groups if g["disabled"] for x in below[g["name"]]}
    for x in [*nodes, *links]:
        if off & set(x["risk_groups"]):
            x["disabled"] = True
    flat = {"node": lambda n: {**n["attrs"], **n}, "link": lambda x: {**x["attrs"], **x}, "risk_group": lambda g: {**g["attrs"], **g}}
    of = {"node": nodes, "link": links, "risk_group": groups}
    on = {"node": lambda n: n["name"], "link": lambda x: f"{x['source']}|{x['target']}", "risk_group": lambda g: g["name"]}
    for r in rules:
        scope, match = r["scope"], r.get("match") or {}
        for x in of[scope]:
            if (not r.get("path") or re.match(r["path"], on[scope](x))) and holds(flat[scope](x), match.get("conditions", []), match.get("logic", "and")):
                if scope == "risk_group":
                    if x["name"] != r["name"]:
                        kids = [*kids, (r["name"], x["name"])]
                else:
                    x["risk_groups"] = sorted({*x["risk_groups"], r["name"]})
    known = {g["name"] for g in groups}
    for g in generate:
        made = {}
        for x in of[g["scope"]]:
            v = flat[g["scope"]](x)
            for k in g["group_by"].split("."):
                v = v.get(k) if isinstance(v, Mapping) else None
            if isinstance(v, (list, dict)):
                raise ValueError(f"{g['group_by']} holds lists; groups need single values")
            if v is not None and (not g.get("path") or re.match(g["path"], on[g["scope"]](x))):
                made.setdefault(g["name"].replace("${value}", str(v)), []).append(x)
        for name, xs in made.items():
            if name in known:
                raise ValueError(f"generated risk group {name!r} is there already")
            known.add(name)
            groups.append({"name": name, "disabled": False, "attrs": dict(g.get("attrs") or {}), "is_top_level": True})
            for x in xs:
                x["risk_groups"] = sorted({*x["risk_groups"], name})
    lost = [(x.get("name") or f"{x['source']}|{x['target']}", g) for x in [*nodes, *links] for g in x["risk_groups"] if g not in known]
    if lost:
        raise ValueError("undefined risk groups: " + ", ".join(f"{a}: {g}" for a, g in lost[:10]))
    below.clear()
    for g in known:
        under(g)
    return Network.of(spark, nodes, links, groups, sorted(set(kids)))


# Results -----------------------------------------------------------------------------------------


def plain(x):
    """Only what JSON holds; numbers must be finite."""
    if hasattr(x, "asDict"):
        x = x.asDict(True)
    if isinstance(x, Mapping):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [plain(v) for v in x]
    if isinstance(x, float) and not math.isfinite(x):
        raise ValueError("a result is not finite")
    return x


def write_results(results: Mapping, scenario: str | Path, out: str | Path | None = None, only: list[str] | None = None) -> Path:
    """<stem>.results.json beside the scenario or in a folder; only some steps if named."""
    scenario = Path(scenario)
    path = Path(out) if out else scenario.with_name(f"{scenario.stem}.results.json")
    path.parent.mkdir(parents=True, exist_ok=True)
    steps = {k: v for k, v in results["steps"].items() if not only or k in only}
    path.write_text(json.dumps(plain({**results, "steps": steps}), indent=2))
    return path


def node_link(network: Network, add_reverse: bool = True) -> dict:
    """The multigraph as nodes and links, reverse links named <id>_reverse."""
    nodes = [{"id": r.name, "disabled": r.disabled, "attr": json.loads(r.attrs)} for r in network.nodes.orderBy("node_ord").collect()]
    links = network.links.select("link_id", "source", "target", "capacity", "cost", "disabled")
    if add_reverse:
        links = links.unionByName(links.select(F.concat("link_id", F.lit("_reverse")).alias("link_id"), F.col("target").alias("source"), F.col("source").alias("target"), "capacity", "cost", "disabled"))
    return {"directed": True, "multigraph": True, "nodes": nodes, "links": [{"key": r.link_id, "source": r.source, "target": r.target, "attr": {"capacity": r.capacity, "cost": r.cost, "disabled": r.disabled}} for r in links.orderBy("link_id").collect()]}
