"""Known answers for selection, flow, placement, failures, hardware and scenarios."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeflow.__main__ import main
from latticeflow.functions.conditions import condition, label
from latticeflow.functions.names import combinations, derive_seed, expand_brackets, expand_block, failure_id, number_key, substitute
from latticeflow.model import Network
from latticeflow.operators import aggregate, demand, failure, hardware, paths, topology
from latticeflow.operators.select import normalize, select_nodes
from latticeflow.plans import kernels as kn
from latticeflow.plans.analysis import Analysis, search
from latticeflow.sources.scenario import Scenario, expand_network, holds, load, node_link, plain


def net(spark, text, **attrs):
    """'A>B 5/1, B>C 3' as a network; attrs by node name."""
    links, names = [], {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        ends, _, rest = part.partition(" ")
        a, b = ends.split(">")
        cap, _, cost = rest.partition("/")
        names |= {a: 1, b: 1}
        links.append({"source": a, "target": b, "capacity": float(cap or 1), "cost": float(cost or 1)})
    return Network.of(spark, [{"name": n, "attrs": attrs.get(n, {})} for n in sorted({*names, *attrs})], links)


def graph(text):
    edges, names = [], {}
    for i, part in enumerate(p.strip() for p in text.split(",")):
        ends, _, rest = part.partition(" ")
        a, b = ends.split(">")
        cap, _, cost = rest.partition("/")
        names |= {a: 1, b: 1}
        edges += [(a, b, float(cap or 1), int(cost or 1), f"{a}|{b}|{i}", "fwd"), (b, a, float(cap or 1), int(cost or 1), f"{a}|{b}|{i}", "rev")]
    names = sorted(names)
    at = {n: i for i, n in enumerate(names)}
    return kn.Graph(names, np.array([at[e[0]] for e in edges]), np.array([at[e[1]] for e in edges]), np.array([e[2] for e in edges]), np.array([e[3] for e in edges]), [e[4] for e in edges], [e[5] for e in edges])


def flow(text, a, b, off=(), **how):
    g = graph(text)
    nodes, edges = g.masks(off)
    return kn.max_flow(g, g.index[a], g.index[b], nodes, edges, **how)


TIERS = "S>A1 20/5, A1>T 20/5, S>A2 40/5, A2>T 40/5, S>B1 30/10, B1>T 30/10, S>B2 60/10, B2>T 60/10"
SPREAD = "S>A 10, A>T 10, S>B 30, B>T 30, S>C 50, C>T 50"
DOC = "A>B 1, A>B 2, B>C 1, B>C 2, A>D 3/2, D>C 3/2"


@pytest.mark.parametrize(
    ("text", "ends", "how", "total"),
    [
        ("A>B 5, B>C 3", "AC", {}, 3),
        ("A>B 5, B>C 5, A>D 5, D>C 5", "AC", {}, 10),
        ("A>B 2, B>C 1, A>C 1", "AC", {}, 2),
        ("A>B 5/1, B>D 5/1, A>C 3/2, C>D 3/2", "AD", {}, 8),
        ("A>B 5/1, B>D 5/1, A>C 3/2, C>D 3/2", "AD", {"shortest_path": True}, 5),
        (SPREAD, "ST", {"shortest_path": True, "placement": "EQUAL_BALANCED"}, 30),
        (SPREAD, "ST", {"shortest_path": True}, 90),
        (SPREAD, "ST", {"placement": "EQUAL_BALANCED"}, 90),
        (SPREAD, "ST", {}, 90),
        (TIERS, "ST", {"shortest_path": True, "placement": "EQUAL_BALANCED"}, 40),
        (TIERS, "ST", {"shortest_path": True}, 60),
        (TIERS, "ST", {"placement": "EQUAL_BALANCED"}, 150),
        (TIERS, "ST", {"off": ["A1"]}, 130),
        ("S>A 0/1, A>T 10/1, S>B 100/2, B>T 100/2", "ST", {"shortest_path": True}, 100),
        ("S>A 0/1, A>T 10/1, S>B 100/2, B>T 100/2", "ST", {"shortest_path": True, "require_capacity": False}, 0),
        ("A>B 0/1, B>C 10/1, A>C 5/3", "AC", {}, 5),
        (DOC, "AC", {}, 6),
        (DOC, "AC", {"shortest_path": True}, 3),
        (DOC, "AC", {"shortest_path": True, "placement": "EQUAL_BALANCED"}, 2),
    ],
)
def test_max_flow_values(text, ends, how, total):
    assert flow(text, *ends, **how).total == pytest.approx(total)


def test_cost_tiers_and_unknown_placement():
    assert flow(DOC, "A", "C").by_cost == {2.0: 3.0, 4.0: 3.0}
    assert flow(TIERS, "S", "T").by_cost == {10.0: 60.0, 20.0: 90.0}
    with pytest.raises(ValueError):
        flow(DOC, "A", "C", placement="x")


def test_flow_never_beats_the_minimum_cut():
    rnd = random.Random(4)
    for _ in range(60):
        names = "ABCDEF"
        text = ", ".join(f"{a}>{b} {rnd.randint(1, 9)}/{rnd.randint(1, 4)}" for a, b in (rnd.sample(names, 2) for _ in range(9))) + ", A>B 1, E>F 1"
        g = graph(text)
        got = flow(text, "A", "F")
        cut = min(sum(g.capacity[e] for e in range(len(g.src)) if side >> g.src[e] & 1 and not side >> g.dst[e] & 1) for side in range(1 << len(g.names)) if side >> g.index["A"] & 1 and not side >> g.index["F"] & 1)
        assert got.total <= cut + 1e-9
        balance = np.zeros(len(g.names))
        for e, x in got.on_edge.items():
            assert x <= g.capacity[e] + 1e-9
            balance[g.src[e]] += x
            balance[g.dst[e]] -= x
        assert balance[g.index["A"]] == pytest.approx(got.total) and all(abs(balance[i]) < 1e-6 for i, n in enumerate(g.names) if n not in "AF")


def place(text, demands):
    g = graph(text)
    nodes, edges = g.masks()
    return [x[0] for x in kn.place_demands(g, [(g.index[a], g.index[b], v, p) for a, b, v, p in demands], nodes, edges)]


def lsp(caps, volume, n):
    g = graph(", ".join(f"S>M{i:02} {c}, M{i:02}>T {c}" for i, c in enumerate(caps)))
    nodes, edges = g.masks()
    return kn.place_lsps(g, g.index["S"], g.index["T"], volume, g.capacity.tolist(), nodes, edges, n, n)[0]


def test_tunnels():
    assert lsp(range(10, 50, 5), 1000, 4) == pytest.approx(120)
    assert lsp(range(10, 60, 10), 500, 2) == pytest.approx(80)
    assert lsp([1] * 15, 1000, 16) == pytest.approx(8)


def test_placement_values():
    e, w, t = "SHORTEST_PATHS_ECMP", "SHORTEST_PATHS_WCMP", "TE_WCMP_UNLIM"
    assert place("A>B 60, A>C 60, B>D 60, C>D 60", [("A", "D", 50, e)]) == [50]
    assert place("S1>R 100, S2>R 100, S3>R 100, R>D1 200, R>D2 200", [("S1", "D1", 50, w), ("S2", "D1", 50, w), ("S3", "D2", 50, w)]) == [50, 50, 50]
    assert place("A>B 30", [("A", "B", 50, e)]) == [30]
    assert place("A>B, C>D", [("A", "D", 50, t)]) == [0]
    assert place("A>B 50/1, B>D 50/1, A>C 50/2, C>D 50/2", [("A", "D", 80, t)]) == [80]
    assert place("A>B 30/1, B>D 30/1, A>C 30/2, C>D 30/2", [("A", "D", 25, e), ("A", "D", 50, t)]) == [25, 35]


def test_k_shortest_paths():
    g = graph("A>B 10/1, B>C 10/1, A>C 10/3")
    nodes, edges = g.masks()
    costs = lambda *a, **k: [c for c, _ in kn.k_shortest(g, 0, 2, *a, **k)]
    assert costs(nodes, edges, 3) == [2, 3] and costs(nodes, edges, 1) == [2] and costs(nodes, edges, 3, factor=1.4) == [2]
    assert costs(*g.masks(["B"]), 3) == [3]


def test_analysis_pairs_and_exclusions(spark):
    n = net(spark, "S1>X 3, X>T1 3, S2>X 1, X>T2 1")
    a = Analysis(n)
    got = {(r.src_label, r.dst_label): r.total_flow for r in a.max_flow(r"^(S\d)$", r"^(T\d)$", "pairwise").collect()}
    assert got == {("S1", "T1"): 3, ("S1", "T2"): 1, ("S2", "T1"): 1, ("S2", "T2"): 1}
    assert a.max_flow("S", "T", patterns=a.patterns(["S1"])).first().total_flow == 1
    assert a.max_flow("^(S1|X)$", "^(X|T1)$").first().total_flow == 0
    assert a.max_flow("S1", "T1").first().failure_id == ""
    with pytest.raises(ValueError):
        a.max_flow("nothing", "T1")
    off = Analysis(n.disable_nodes("S2"))
    assert off.max_flow("S", "T").first().total_flow == 3
    with pytest.raises(ValueError):
        n.disable_nodes("none")


def test_sensitivity_lists_edges_that_matter(spark):
    two = net(spark, "S>A, A>T, S>B, B>T")
    rows = Analysis(two).sensitivity("S", "T").collect()
    assert len(rows) == 4 and {r.less for r in rows} == {1.0}
    tiers = net(spark, "S>A 10/1, A>T 10/1, S>B 5/2, B>T 5/2")
    assert Analysis(tiers).sensitivity("S", "T").count() == 4
    assert Analysis(tiers).sensitivity("S", "T", shortest_path=True).count() == 2


def test_paths(spark):
    n = net(spark, "A>B 10/1, B>C 10/1, A>C 10/3, A>B 10/1, Z>Y 1/1")
    a = Analysis(n)
    assert a.shortest_costs("A", "C").first().cost == 2
    assert math.isinf(a.shortest_costs("A", "Z").first().cost)
    assert a.shortest_paths("A", "C").count() == 1 and a.shortest_paths("A", "C", split_parallel_edges=True).count() == 2
    assert [r.cost for r in a.k_shortest_paths("A", "C").collect()] == [2, 3]
    assert [r.cost for r in a.k_shortest_paths("A", "C", patterns=a.patterns(["B"])).collect()] == [3]
    assert a.k_shortest_paths("A", "Z").count() == 0


def test_all_equal_cost_paths_are_listed(spark):
    # 14 diamonds in a row: 2 ** 14 cheapest paths.
    chain = ", ".join(f"N{i:02}>X{i:02}, N{i:02}>Y{i:02}, X{i:02}>N{i + 1:02}, Y{i:02}>N{i + 1:02}" for i in range(14))
    rows = Analysis(net(spark, chain)).shortest_paths("N00", "N14").select(F.transform("hops", lambda h: h["node"]).alias("p")).collect()
    got = [tuple(r.p) for r in rows]
    assert got == sorted(set(got)) and len(got) == 2**14
    g = graph("A>B 1, A>B 2, B>C 1, B>C 2, A>D 3, D>C 3")
    _, pred = kn.spf(g, 0, *g.masks())
    assert [[(g.names[u], len(es)) for u, es in p] for p in kn.dag_paths(g, pred, 0, 2)] == [[("A", 2), ("B", 2), ("C", 0)], [("A", 1), ("D", 1), ("C", 0)]]
    split = list(kn.dag_paths(g, pred, 0, 2, True))
    assert len(split) == 5 and split == sorted(split)


def test_relational_paths_agree_with_kernels(spark):
    rnd = random.Random(9)
    names = [f"n{i}" for i in range(12)]
    text = ", ".join(f"{a}>{b} 5/{rnd.randint(1, 5)}" for a, b in (rnd.sample(names, 2) for _ in range(22)))
    n = net(spark, text)
    g = n.graph()
    dist, pred = kn.spf(g, 0, *g.masks())
    start = g.names[0]
    got = {r.node: r.cost for r in paths.shortest_costs(n.edges(), spark.createDataFrame([(start,)], "name string")).collect()}
    assert got == {g.names[i]: d for i, d in enumerate(dist) if not math.isinf(d)}
    far = max((d, i) for i, d in enumerate(dist) if not math.isinf(d))[1]
    scale, on = kn.place_equal(g, pred, 0, far, [1.0] * len(g.src))
    shares = {r.link_id: r.share for r in paths.equal_split(n.edges(), start, g.names[far]).collect()}
    assert shares == pytest.approx({g.link[e]: x / scale for e, x in on.items()})


def test_maximum_supported_demand(spark):
    assert Analysis(net(spark, "A>B 10")).maximum_supported_demand([{"source": "A", "target": "B", "volume": 5}]) == pytest.approx(2, abs=0.02)
    upto = lambda x: lambda alphas: {a: a <= x for a in alphas}
    assert search(upto(1.3)) == pytest.approx(1.3, abs=0.02)
    assert search(upto(1e18), most=10) == 10 and search(upto(500), most=1e6, max_bracket=40) == pytest.approx(500, abs=0.02)
    assert search(upto(0.01)) == pytest.approx(0.01, abs=0.02)
    with pytest.raises(ValueError):
        search(upto(-1))


def test_conditions_as_columns_match_plain_values(spark):
    rows = [{"x": 1, "y": "abc", "z": {"w": [1, "q"]}, "b": True}, {"x": "2", "y": None}, {"x": 2.5, "b": False, "z": {"w": "list"}}, {}]
    df = spark.createDataFrame([(str(i), json.dumps(r)) for i, r in enumerate(rows)], "name string, attrs string")
    for attr in ("x", "y", "z.w", "b", "none"):
        for op, values in (("==", [1, "2", "abc", True, 2.5]), ("!=", [1, "abc", False]), ("<", [2, "3"]), (">=", [1, "x"]), ("contains", ["b", "q"]), ("not_contains", ["b", "q"]), ("in", [[1, "abc", True]]), ("not_in", [[1, "abc"]]), ("exists", [None]), ("not_exists", [None])):
            for v in values:
                if attr == "b" and op in ("<", ">=") or (isinstance(v, bool) and attr == "x") or (attr == "b" and v == 1 and v is not True):
                    continue
                got = {int(r.name) for r in df.filter(condition(df, attr, op, v)).collect()}
                plainly = [{"attr": attr, "op": op, "value": v}]
                if op in ("in", "not_in") and attr in ("x", "b"):
                    continue
                assert got == {i for i, r in enumerate(rows) if holds(r, plainly)}, (attr, op, v)
    with pytest.raises(ValueError):
        condition(df, "x", "~", 1)
    with pytest.raises(ValueError):
        condition(df, "x", "in", 1)


def test_labels_and_selectors(spark):
    n = net(spark, "dc1/leaf/a>dc1/spine/b, dc2/leaf/a>dc1/spine/b", **{"dc1/leaf/a": {"role": "leaf"}, "dc2/leaf/a": {"role": "leaf"}})
    pick = lambda s, **k: sorted(tuple(r)[:2] for r in select_nodes(n.nodes, s, **k).collect())
    assert pick("(dc[12])/(leaf)") == [("dc1|leaf", "dc1/leaf/a"), ("dc2|leaf", "dc2/leaf/a")]
    assert pick("dc1/.*") == [("dc1/.*", "dc1/leaf/a"), ("dc1/.*", "dc1/spine/b")]
    assert pick("(?P<d>dc\\d)/(x)?") == [("dc1", "dc1/leaf/a"), ("dc1", "dc1/spine/b"), ("dc2", "dc2/leaf/a")]
    assert pick({"group_by": "role"}) == [("leaf", "dc1/leaf/a"), ("leaf", "dc2/leaf/a")]
    assert pick("dc", excluded=["dc1/leaf/a", "dc2/leaf/a"]) == [("dc", "dc1/spine/b")]
    for bad in ({}, {"nodes": 1}, 5):
        with pytest.raises(ValueError):
            normalize(bad)
    assert n.nodes.select(label("^dc2").alias("x")).filter("x is not null").count() == 1


def test_names():
    assert expand_brackets("fa[1-3]") == ["fa1", "fa2", "fa3"] and expand_brackets("dc[1,3,5-6]") == ["dc1", "dc3", "dc5", "dc6"]
    assert expand_brackets("fa[1-2]_plane[5-6]") == ["fa1_plane5", "fa1_plane6", "fa2_plane5", "fa2_plane6"]
    for bad in ("a[3-1]", "a[x-y]"):
        with pytest.raises(ValueError):
            expand_brackets(bad)
    assert substitute({"a": ["$x", "${y}z"]}, {"x": 1, "y": "q"}) == {"a": ["1", "qz"]}
    with pytest.raises(KeyError):
        substitute("$no", {})
    assert combinations({"b": [1, 2], "a": [3]}) == [{"a": 3, "b": 1}, {"a": 3, "b": 2}]
    assert combinations({"a": [1, 2], "b": [3, 4]}, "zip") == [{"a": 1, "b": 3}, {"a": 2, "b": 4}]
    for bad in (({"a": [1], "b": [1, 2]}, "zip"), ({"a": range(101), "b": range(100)}, "cartesian"), ({"a": [1]}, "x")):
        with pytest.raises(ValueError):
            combinations(*bad)
    assert expand_block({"path": "n$i", "expand": {"vars": {"i": [1, 2]}}}) == [{"path": "n1"}, {"path": "n2"}]
    assert [number_key(x) for x in (2.0, 0.1, 1e-10, -0.0)] == ["2", "0.1", "0", "0"]
    assert derive_seed(None, "a") is None and 0 <= derive_seed(42, "a", 1) < 2**31 and derive_seed(42, "a") != derive_seed(42, "b")
    assert failure_id([], []) == "" and len(failure_id(["a"], [])) == 16 and failure_id(["b", "a"], []) == failure_id(["a", "b"], [])


def test_link_patterns(spark):
    nodes = Network.of(spark, [{"name": n} for n in ("a1", "a2", "b1", "b2", "b3", "b4")], []).nodes
    side = lambda p: select_nodes(nodes, p, "adjacency")
    pairs = lambda df: {(r.source, r.target) for r in df.collect()}
    assert len(pairs(topology.mesh(side("a"), side("b")))) == 8 and len(pairs(topology.mesh(side("b"), side("b")))) == 6
    assert pairs(topology.one_to_one(side("a"), side("b"))) == {("a1", "b1"), ("a2", "b2"), ("a1", "b3"), ("a2", "b4")}
    with pytest.raises(ValueError):
        topology.one_to_one(side("a"), side("b[1-3]"))
    with pytest.raises(ValueError):
        Network.of(spark, [{"name": "a"}, {"name": "a"}], [])
    with pytest.raises(ValueError):
        Network.of(spark, [{"name": "a"}], [{"source": "a", "target": "b"}])


def test_demand_expansion(spark):
    nodes = net(spark, "N1>N2, N3>N4").nodes
    got, extra = demand.expand(nodes, [{"source": "^N([1-4])$", "target": "^N([1-4])$", "volume": 12, "mode": "pairwise"}])
    assert len(got) == 12 and {d["volume"] for d in got} == {1.0} and not extra
    three = net(spark, "a1>b1, b1>c1, a2>b2").nodes
    per, _ = demand.expand(three, [{"source": "([abc])", "target": "([abc])", "volume": 1000, "group_mode": "per_group"}])
    assert len(per) == 6 and {d["volume"] for d in per} == {1000.0}
    each, _ = demand.expand(three, [{"source": "([abc])", "target": "([abc])", "volume": 1000, "group_mode": "group_pairwise"}])
    assert len(each) == 6 and sum(d["volume"] for d in each) == pytest.approx(1000)
    with pytest.raises(ValueError):
        demand.expand(nodes, [{"source": "zz", "target": "N", "volume": 1}])
    late = demand.expand(nodes, [{"source": "N1", "target": "N2", "volume": 1, "priority": 2}, {"source": "N2", "target": "N3", "volume": 1, "priority": 1}])[0]
    assert [d["priority"] for d in late] == [1, 2]


def test_failure_sampling(spark):
    rule = {"scope": "link", "mode": "choice", "count": 2, "weight_by": "w"}
    links = [{"source": "A", "target": "B", "attrs": {"w": w}, "link_id": f"L{i}"} for i, w in enumerate((10, 0, 5))]
    n = Network.of(spark, [{"name": "A"}, {"name": "B"}], links)
    for seed in range(5):
        assert failure.sample(n, {"modes": [{"rules": [rule]}]}, 1, seed).first().excluded_links == ["L0", "L2"]
    rows = failure.sample(n, {"modes": [{"weight": 0, "rules": [rule]}, {"weight": 1, "rules": [{"scope": "node", "mode": "random", "probability": 0.5}]}]}, 200, 3).collect()
    assert all(not r.excluded_links for r in rows)
    hits = sum(len(r.excluded_nodes) for r in rows)
    assert 150 < hits < 250
    for r in rows[:20]:
        rng = random.Random(3 + r.iteration)
        rng.random()
        assert r.excluded_nodes == [x for x in ("A", "B") if rng.random() < 0.5]
    patterns = failure.distinct_patterns(spark.createDataFrame(rows, failure.PATTERN))
    assert patterns.count() == 4 and patterns.agg(F.sum("occurrence_count")).first()[0] == 200
    for bad in ({"modes": []}, {"modes": [{"rules": [{"scope": "x"}]}]}, {"modes": [{"rules": [{"probability": 2}]}]}):
        with pytest.raises(ValueError):
            failure.check_policy(bad)


def test_shared_risk_and_children(spark):
    nodes = [{"name": "N1", "risk_groups": ["rg1"]}, {"name": "N2", "risk_groups": ["kid"]}]
    links = [{"source": "N1", "target": "N2", "link_id": "L1", "risk_groups": ["rg1"]}, {"source": "N1", "target": "N2", "link_id": "L2"}]
    n = Network.of(spark, nodes, links, [{"name": "rg1"}, {"name": "top"}, {"name": "kid", "is_top_level": False}], [("top", "kid")])
    one = {"modes": [{"rules": [{"scope": "node", "path": "N1"}]}]}
    r = failure.sample(n, {**one, "expand_groups": True}, 1, 1).first()
    assert (r.excluded_nodes, r.excluded_links) == (["N1"], ["L1"])
    r = failure.sample(n, {"modes": [{"rules": [{"scope": "risk_group", "path": "top"}]}]}, 1, 1).first()
    assert r.excluded_nodes == ["N2"]
    kids = spark.createDataFrame([("p", "c"), ("c", "g"), ("x", "y")], "parent string, child string")
    assert {r[0] for r in failure.descendants(kids, ["p"]).collect()} == {"p", "c", "g"}
    assert failure.cycles(kids).count() == 0
    assert failure.cycles(spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string")).count() == 2
    assert {r[0] for r in n.flag_risk_group("top").nodes.filter("disabled").select("name").collect()} == {"N2"}


def test_envelopes(spark):
    rows = spark.createDataFrame([("a", 10.0), ("a", 10.0), ("a", 5.0)], "k string, v double")
    freq = aggregate.frequencies(rows, ["k"], "v")
    e = aggregate.envelope(freq, ["k"]).first()
    assert (e.total_samples, e.min_value, e.max_value) == (3, 5, 10) and e.mean_value == pytest.approx(25 / 3) and e.stdev_value == pytest.approx(math.sqrt(50 / 9))
    assert [aggregate.envelope_percentile(freq, ["k"], p).first().percentile for p in (0, 50, 100)] == [5, 10, 10]
    assert aggregate.expand_values(freq).count() == 3
    s = spark.createDataFrame([("f", 0.8, 5), ("f", 0.2, 1)], "k string, s double, n int")
    w = aggregate.weighted_sensitivity(s, ["k"], "s", "n").first()
    assert (w["mean"], w["min"], w["max"], w["count"]) == (pytest.approx(0.7), 0.2, 0.8, 6)


def test_network_stats(spark):
    n = Network.of(spark, [{"name": x} for x in "ABC"], [{"source": "A", "target": "B", "capacity": 10, "cost": 1}, {"source": "A", "target": "C", "capacity": 5, "cost": 2}, {"source": "C", "target": "A", "capacity": 7, "cost": 1.5}])
    s = aggregate.network_stats(n.nodes, n.links).first()
    assert (s.node_count, s.link_count, s.total_capacity, s.min_capacity, s.max_capacity, s.mean_cost) == (3, 3, 22, 5, 10, 1.5)
    assert s.mean_capacity == pytest.approx(22 / 3)
    s = aggregate.network_stats(n.nodes, n.links, excluded_nodes=["A"]).first()
    assert (s.node_count, s.link_count) == (2, 0)


def test_hardware(spark):
    lib = {"box": {"capex": 100, "power_watts": 10, "capacity": 200}, "optic": {"capex": 5, "power_watts": 1}}
    nodes = [{"name": "A", "attrs": {"hardware": {"component": "box", "count": 2}}}, {"name": "B"}]
    optics = {"hardware": {"source": {"component": "optic", "count": 4}, "target": {"component": "optic", "count": 4}}}
    n = Network.of(spark, nodes, [{"source": "A", "target": "B", "attrs": optics}])
    frame = hardware.library_frame(spark, lib)
    root = hardware.cost_power(n.nodes, n.links, frame).filter("level = 0").first()
    assert (root.capex, root.power_watts) == (220, 24)
    over = Network.of(spark, [{"name": "A", "attrs": {"hardware": {"component": "box"}}}, {"name": "B"}], [{"source": "A", "target": "B", "capacity": 100}] * 3)
    with pytest.raises(ValueError):
        hardware.validate(over.nodes, over.links, frame)
    nested = hardware.totals(hardware.library_frame(spark, {"r": {"capex": 1, "count": 2, "children": {"c": {"capex": 3, "count": 4}}}})).first()
    assert nested.capex == 26


SCENARIO = """
seed: 7
blueprints:
  fabric:
    nodes:
      leaf: {count: 2, template: "leaf-{n}", attrs: {role: leaf}}
      spine: {count: 2, template: "spine-{n}"}
    links:
      - {source: /leaf, target: /spine, pattern: mesh, capacity: 10, cost: 1}
network:
  nodes:
    dc[1-2]: {blueprint: fabric, attrs: {site: x}, risk_groups: ["power"]}
    hub: {}
  links:
    - {source: "dc${d}/spine", target: hub, capacity: 100, expand: {vars: {d: [1, 2]}}}
  link_rules:
    - {source: hub, target: "dc2/", cost: 5}
  node_rules:
    - {path: hub, attrs: {kind: core}, risk_groups: [cool]}
risk_groups:
  - power
  - {name: cool, children: [{name: fan}]}
  - generate: {scope: node, group_by: role, name: "role_${value}"}
failures:
  one:
    modes:
      - rules: [{scope: node, mode: choice, count: 1, path: "dc1/leaf"}]
demands:
  default:
    - {source: "^dc1/leaf.*", target: "^dc2/leaf.*", volume: 10, mode: combine}
components:
  box: {capex: 1}
workflow:
  - {type: NetworkStats, name: stats}
  - {type: BuildGraph}
  - {type: MaximumSupportedDemand, name: msd}
  - {type: TrafficMatrixPlacement, name: tm, alpha_from_step: msd, alpha_from_field: data.alpha_star, failure_policy: one, iterations: 20, include_flow_details: true}
  - {type: MaxFlow, name: mf, source: "^(dc1)/leaf", target: "^(dc2)/leaf", failure_policy: one, iterations: 20, include_min_cut: true}
  - {type: CostPower, name: cost}
"""


def test_scenario_runs(spark, tmp_path):
    s = Scenario.from_yaml(spark, SCENARIO)
    assert s.network.nodes.count() == 9 and s.network.links.count() == 12
    assert s.network.links.filter("cost = 5").count() == 2
    assert s.network.nodes.filter("array_contains(risk_groups, 'role_leaf')").count() == 4
    steps = s.run()["steps"]
    assert steps["stats"]["data"]["node_count"] == 9 and len(steps["BuildGraph_1"]["data"]["graph"]["links"]) == 24
    assert steps["mf"]["data"]["baseline"]["summary"]["total_placed"] == 40
    worst = steps["mf"]["data"]["flow_results"]
    assert len(worst) == 2 and sum(x["occurrence_count"] for x in worst) == 20 and {x["summary"]["total_placed"] for x in worst} == {20}
    assert steps["msd"]["data"]["alpha_star"] == pytest.approx(4, abs=0.02)
    assert steps["tm"]["data"]["baseline"]["summary"]["overall_ratio"] == pytest.approx(1)
    assert all(x["summary"]["overall_ratio"] == pytest.approx(0.5, abs=0.01) for x in steps["tm"]["data"]["flow_results"])
    json.dumps(plain(s.results))
    path = tmp_path / "s.yml"
    path.write_text(SCENARIO.split("workflow:")[0] + "workflow:\n  - {type: NetworkStats, name: stats}\n")
    assert main(["run", str(path)]) == 0 and main(["inspect", str(path), "--detail"]) == 0 and main(["run", str(tmp_path / "no.yml")]) == 1
    assert json.loads((tmp_path / "s.results.json").read_text())["steps"]["stats"]["data"]["link_count"] == 12


@pytest.mark.parametrize(
    "text",
    [
        "other: 1",
        "network: {nodes: {a: {colour: 1}}}",
        "network: {nodes: {a: {blueprint: none}}}",
        "network: {nodes: {'a[1-2]': {}, a1: {}}}",
        "network: {nodes: {'a[1-2]': {}, 'b[1-3]': {}}, links: [{source: a, target: b, pattern: one_to_one}]}",
        "network: {nodes: {a: {risk_groups: [none]}}}",
        "risk_groups: [{name: a, children: [{name: b, children: [{name: a}]}]}]",
        "network: {nodes: {a: {attrs: {k: g}}}}\nrisk_groups: [g, {generate: {scope: node, group_by: k, name: '${value}'}}]",
        "workflow: [{type: MaxFlow, name: x}, {type: MaxFlow, name: x}]",
        "workflow: [{name: x}]",
        "demands: {d: [{source: a, target: b, volume: -1}]}",
        "failures: {f: {modes: []}}",
    ],
)
def test_bad_scenarios(spark, text):
    with pytest.raises(ValueError):
        Scenario.from_yaml(spark, text)


def test_boolean_keys_and_parameters():
    assert load("components: {on: {capex: 1}}")["components"] == {"True": {"capex": 1}}
    data = load("blueprints: {f: {nodes: {s: {count: 4, attrs: {hw: a}}}}}\nnetwork: {nodes: {x: {blueprint: f, params: {s.count: 6, s.attrs.hw: b}}}}")
    nodes, _ = expand_network(data)
    assert len(nodes) == 6 and {n["attrs"]["hw"] for n in nodes} == {"b"}


def test_edge_table_import_and_export(spark):
    df = spark.createDataFrame([("a", "b", 3.0), ("b", "c", None)], "u string, v string, cap double")
    n = Network.from_edges(df, "u", "v", "cap", reverse=True)
    assert n.nodes.count() == 3 and n.links.count() == 4 and n.links.filter("capacity = 1").count() == 2
    assert len(node_link(n)["links"]) == 8
    assert Analysis(n).max_flow("a", "c").first().total_flow == 2
