"""Round trips of networks and small helpers."""

import logging

from pyspark.sql import functions as F

from latticeflow.functions import hops, report
from latticeflow.model import Network
from latticeflow.plans.analysis import PATTERNS, Analysis
from latticeflow.sources import bridge, outputs, tables


class Multi:
    """As much of a multigraph as the bridge asks for."""

    def __init__(self):
        self.n, self.e = {}, []

    def add_node(self, n, **data):
        self.n[n] = data

    def add_edge(self, a, b, key=None, **data):
        self.e.append((a, b, key, data))

    def nodes(self, data):
        return list(self.n.items())

    def edges(self, data, keys):
        return self.e

    def is_multigraph(self):
        return True


def small(spark):
    return Network.of(spark, [{"name": n, "attrs": {"x": n}} for n in "abc"], [{"source": "a", "target": "b", "capacity": 3}, {"source": "b", "target": "c", "capacity": 2, "cost": 4}], [{"name": "g"}], attrs={"name": "t"})


def test_tables_round_trip(spark, tmp_path):
    tables.save(small(spark), f"{tmp_path}/net")
    back = tables.open_network(spark, f"{tmp_path}/net")
    assert back.attrs == {"name": "t"} and back.risk_groups.count() == 1
    assert sorted(map(tuple, back.links.collect())) == sorted(map(tuple, small(spark).links.collect()))


def test_bridge_round_trip(spark):
    g = bridge.to_graph(small(spark), Multi)
    assert len(g.n) == 3 and {(a, b, d["capacity"]) for a, b, _, d in g.e} == {("a", "b", 3.0), ("b", "c", 2.0)}
    n = bridge.from_graph(spark, g, bidirectional=True)
    assert n.links.count() == 4 and Analysis(n).max_flow("a", "c").first().total_flow == 4
    ids = {r.name: r.id for r in bridge.dense_ids(n.nodes).collect()}
    assert ids == {"a": 0, "b": 1, "c": 2}


def test_own_kernel_runs_on_every_pattern(spark):
    a = Analysis(small(spark))
    count = lambda g, nodes, edges, unit: [(sum(nodes), sum(edges))]
    rows = a.ask(count, PATTERNS + ", nodes int, edges int", patterns=a.patterns(["a"], ["b|c|0"])).first()
    assert (rows.nodes, rows.edges) == (2, 2)


def test_path_columns(spark):
    p = Analysis(small(spark)).shortest_paths("a", "c")
    r = p.select(hops.source("hops").alias("s"), hops.target("hops").alias("t"), hops.nodes_of(F.col("hops")).alias("n"), F.size(hops.edges_of(F.col("hops"))).alias("e"), hops.sub_path(F.col("hops"), F.lit("b")).alias("b"), hops.sub_path(F.col("hops"), F.lit("z")).alias("z")).first()
    assert (r.s, r.t, r.n, r.e, r.z) == ("a", "c", ["a", "b", "c"], 2, None)
    assert [h.node for h in r.b] == ["a", "b"] and r.b[-1].edges == []


def test_outputs_and_reports(tmp_path, capsys):
    assert str(outputs.results_path("x/s.yml")) == "s.results.json" and outputs.results_path("s.yml", tmp_path) == tmp_path / "s.results.json"
    assert outputs.results_path("s.yml", tmp_path, "a.json") == tmp_path / "a.json" and outputs.profiles_folder("s.yml").name == "s.profiles"
    assert outputs.ensure_parent(tmp_path / "q/r.json").parent.exists()
    assert report.money(1234.5) == "1,234.50" and report.duration(0.5) == "500 ms" and report.duration(125) == "2 min 5 s" and report.plural(2, "link") == "2 links"
    assert report.table(["a", "bb"], [[1, 22], [333, 4]]).splitlines()[1] == "----+---"
    report.setup(logging.DEBUG)
    report.logger("x").debug("seen")
    assert "seen" in capsys.readouterr().err
    report.reset()
