"""Results by step, workflow options, checks of scenarios, and what the command line shows."""

import pytest
from pyspark.sql import functions as F

from latticeflow import __main__ as cli
from latticeflow.functions import hops
from latticeflow.operators import aggregate as ag
from latticeflow.operators import failure as fl
from latticeflow.operators import hardware as hw
from latticeflow.plans.results import Results
from latticeflow.sources.scenario import Scenario

NET = """
seed: 5
network:
  nodes: {a: {}, b: {}, c: {}, d: {disabled: true}}
  links:
    - {source: a, target: b, capacity: 10, cost: 1}
    - {source: b, target: c, capacity: 10, cost: 1}
    - {source: a, target: c, capacity: 4, cost: 5}
failures:
  one: {modes: [{weight: 1, attrs: {kind: cut}, rules: [{scope: link, mode: choice, count: 1}]}]}
demands:
  default: [{source: ^a$, target: ^c$, volume: 7, mode: pairwise, flow_policy: TE_WCMP_UNLIM}]
workflow:
"""


def scenario(spark, step):
    return Scenario.from_yaml(spark, NET + f"  - {step}\n")


def test_results_keep_data_in_the_scope_of_a_step():
    r = Results()
    with pytest.raises(RuntimeError):
        r.put("data", {})
    r.enter("x", step_type="T", seed=1)
    r.put("data", {"n": 1})
    assert r.of("data") == {"n": 1} and r.of("metadata", 0) == 0
    with pytest.raises(ValueError, match="other"):
        r.put("other", {})
    r.leave()
    r.enter("y", step_type="T", seed=None)
    assert r.in_order() == ["x", "y"] and r.about("y")["execution_order"] == 1
    assert r.step("x") == {"data": {"n": 1}} and r.step("none") == {}
    with pytest.raises(ValueError, match="already"):
        r.enter("x")


def test_failure_traces_are_stored_on_request(spark):
    step = "{type: MaxFlow, name: f, source: ^a$, target: ^c$, failure_policy: one, iterations: 6"
    got = scenario(spark, step + ", store_failure_patterns: true}").run()["steps"]["f"]["data"]["flow_results"]
    assert got and sum(x["occurrence_count"] for x in got) == 6
    for x in got:
        t = x["failure_trace"]
        assert t["mode_index"] == 0 and t["mode_attrs"] == {"kind": "cut"}
        assert t["selections"][0]["selected_ids"] == x["failure_state"]["excluded_links"] and t["selections"][0]["matched_count"] == 3
        assert t["expansion"] == {"nodes": [], "links": [], "risk_groups": []}
    bare = scenario(spark, step + "}").run()["steps"]["f"]["data"]["flow_results"]
    assert all("failure_trace" not in x for x in bare)


def test_maximum_supported_demand_reports_its_search(spark):
    run = scenario(spark, "{type: MaximumSupportedDemand, name: m, resolution: 0.25}").run()
    data = run["steps"]["m"]["data"]
    assert 1.7 <= data["alpha_star"] <= 2.0
    assert data["context"]["acceptance_rule"] == "hard" and data["context"]["growth_factor"] == 2.0
    assert any(p["feasible"] for p in data["probes"]) and any(not p["feasible"] for p in data["probes"])
    assert run["workflow"]["m"]["seed_source"] == "scenario-derived"
    for bad in ("acceptance_rule: soft", "seeds_per_alpha: 0", "placement_rounds: -1"):
        with pytest.raises(ValueError, match=bad.split(":")[0]):
            scenario(spark, f"{{type: MaximumSupportedDemand, name: m, {bad}}}").run()


@pytest.mark.parametrize("bad", ["{source: a, target: b, capacity: -1}", "{source: a, target: b, cost: -2}", "{source: a, target: b, pattern: ring}"])
def test_numbers_and_words_out_of_range_are_refused(spark, bad):
    with pytest.raises(ValueError, match="must not be below|is one of"):
        Scenario.from_yaml(spark, f"network: {{nodes: {{a: {{}}, b: {{}}}}, links: [{bad}]}}")


def test_policies_and_libraries_as_plain_data():
    p = fl.policy_dict({"modes": [{"rules": [{"scope": "link", "path": "x"}]}]})
    assert p["modes"][0]["rules"][0] == {"scope": "link", "conditions": [], "logic": "or", "mode": "all", "probability": 1.0, "count": 1, "path": "x"}
    one, two = {"box": {"capex": 1, "children": {"card": {"count": 2}}}}, {"box": {"capex": 5}, "rack": {}}
    assert hw.component(hw.merge_libraries(one, two), "box")["capex"] == 5
    assert hw.component(hw.merge_libraries(one, two, override=False), "box")["capex"] == 1
    copy = hw.library_dict(one)
    assert copy["box"]["children"]["card"]["count"] == 2 and copy["box"]["ports"] == 0
    copy["box"]["children"].clear()
    assert one["box"]["children"]


def test_paths_compare_by_cost_and_hops(spark):
    hop = "array<struct<node:string,edges:array<string>>>"
    a, b = [("x", ["e1", "e2"]), ("y", ["e3"]), ("z", [])], [("x", ["e1"]), ("z", [])]
    df = spark.createDataFrame([(1, 5.0, a), (2, 4.0, b), (3, 4.0, a), (4, 1.0, [("x", [])])], f"k int, cost double, hops {hop}")
    assert [r.k for r in df.orderBy(*hops.in_order(F.col("cost"), F.col("hops"))).collect()] == [4, 3, 2, 1]
    rows = {r.k: r.s for r in df.select("k", hops.edge_sequence(F.col("hops")).alias("s")).collect()}
    assert rows[1] == [["e1", "e2"], ["e3"]] and rows[4] == []
    both = df.alias("l").join(df.alias("r"), hops.same_path(F.col("l.hops"), F.col("l.cost"), F.col("r.hops"), F.col("r.cost")))
    assert both.count() == 4


def test_envelopes_of_large_values_keep_their_digits(spark):
    rows = [("p", None, 1e9 + x) for x in (0, 1, 2, 3)] + [(None, "q", 5.0)]
    freq = ag.frequencies(spark.createDataFrame(rows, "s string, t string, v double"), ["s", "t"], "v")
    got = {(r.s, r.t): r for r in ag.envelope(freq, ["s", "t"]).collect()}
    assert got["p", None].stdev_value == pytest.approx(1.118033988749895, rel=1e-9) and got[None, "q"].stdev_value == 0


def test_command_line_output_folder_and_inspection(spark, tmp_path, capsys):
    path = tmp_path / "net.yml"
    path.write_text(NET + "  - {type: MaxFlow, name: f, source: ^a$, target: ^c$}\n")
    assert cli.main(["run", str(path), "--output", str(tmp_path / "out"), "--quiet", "--profile-memory"]) == 0
    assert (tmp_path / "out" / "net.results.json").exists()
    assert "driver's peak memory" in capsys.readouterr().err
    assert cli.main(["inspect", str(path)]) == 0
    shown = capsys.readouterr().out
    assert "enabled nodes: 3 of 4 (75.0 %)" in shown and "demand to capacity: 7 / 24 = 0.292" in shown
    assert "1 groups, 1 nodes, 1 enabled" in shown
