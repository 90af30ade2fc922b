"""python -m latticeflow run|inspect scenario.yml"""

from __future__ import annotations

import argparse
import json
import logging
import resource
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import report
from .operators.aggregate import network_stats, node_counts
from .operators.select import select_nodes
from .sources.scenario import Scenario, plain, write_results


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="latticeflow")
    sub = top.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run a scenario's workflow")
    run.add_argument("scenario", type=Path)
    run.add_argument("--results", type=Path)
    run.add_argument("--no-results", action="store_true")
    run.add_argument("--stdout", action="store_true")
    run.add_argument("--keys", nargs="+")
    run.add_argument("--profile", action="store_true")
    run.add_argument("--profile-memory", action="store_true", help="also the driver's memory after each step")
    run.add_argument("--output", type=Path, help="folder for all that is written")
    show = sub.add_parser("inspect", help="show what a scenario holds")
    show.add_argument("scenario", type=Path)
    show.add_argument("--detail", action="store_true")
    for p in (run, show):
        loud = p.add_mutually_exclusive_group()
        loud.add_argument("-v", "--verbose", action="store_true")
        loud.add_argument("--quiet", action="store_true")
    args = top.parse_args(argv)
    report.setup(logging.DEBUG if args.verbose else logging.WARNING if args.quiet else logging.INFO)
    if not args.scenario.exists():
        print(f"no file {args.scenario}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("latticeflow").getOrCreate()
    scenario = Scenario.from_yaml(spark, args.scenario.read_text())
    if args.command == "inspect":
        inspect(scenario, args.detail)
        return 0
    results = scenario.run()
    if args.profile or args.profile_memory:
        print(profile(results, args.profile_memory), file=sys.stderr)
    if not args.no_results:
        out = args.results
        if args.output:
            name = out.name if out else f"{args.scenario.stem}.results.json"
            out = args.output / name
        path = write_results(results, args.scenario, out, args.keys)
        if not args.quiet:
            print(f"results: {path}", file=sys.stderr)
    if args.stdout:
        print(json.dumps(plain({**results, "steps": {k: v for k, v in results["steps"].items() if not args.keys or k in args.keys}}), indent=2))
    return 0


def profile(results, memory: bool = False) -> str:
    """Seconds and shares by step, the longest first; steps over a tenth of all are marked."""
    steps = {k: x["metadata"] for k, x in results["steps"].items()}
    total = sum(m["duration_sec"] for m in steps.values()) or 1.0
    rows = [(k, results["workflow"][k]["step_type"], report.duration(m["duration_sec"]), f"{100 * m['duration_sec'] / total:.0f} %", "*" if m["duration_sec"] > 0.1 * total else "") for k, m in sorted(steps.items(), key=lambda x: -x[1]["duration_sec"])]
    text = report.table(["step", "type", "time", "share", "over 10 %"], rows)
    if memory:
        text += f"\ndriver's peak memory: {resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024:.0f} MB"
    return text


def shares(scenario: Scenario) -> list[str]:
    """How much of the network is enabled, its capacities, and what demands ask of them."""
    n = scenario.network
    lines = []
    for what, df in (("nodes", n.nodes), ("links", n.links)):
        r = df.agg(F.count("*").alias("n"), F.count(F.when(~F.col("disabled"), 1)).alias("on")).first()
        lines.append(f"enabled {what}: {r.on} of {r.n} ({100 * r.on / r.n if r.n else 0:.1f} %)")
    on = n.links.filter("not disabled")
    by = on.groupBy("capacity").agg(F.count("*").alias("links"), F.sum("capacity").alias("total")).orderBy(F.col("capacity").desc()).collect()
    if by:
        lines.append(report.table(["capacity", "links", "total"], [(report.money(r.capacity), r.links, report.money(r.total)) for r in by]))
    total = sum(r.total for r in by)
    volume = sum(float(d.get("volume", 0)) for ds in scenario.demands.values() for d in ds)
    if scenario.demands:
        lines.append(f"demand to capacity: {volume:g} / {total:g}" + (f" = {volume / total:.3f}" if total else ""))
    return lines


def inspect(scenario: Scenario, detail: bool) -> None:
    n = scenario.network
    stats = network_stats(n.nodes, n.links, include_disabled=True).first().asDict()
    for k, v in stats.items():
        print(f"{k}: {v}")
    print("\n".join(shares(scenario)))
    print(f"seed: {scenario.seed}\nrisk groups: {n.risk_groups.count()}\ncomponents: {len(scenario.components)}")
    counts = node_counts(n.nodes).orderBy("path")
    for r in (counts if detail else counts.filter("level <= 1")).collect():
        print(f"{'  ' * r.level}{r.path or '.'}: {r.node_count} nodes, {r.active_count} enabled")
    for name, p in scenario.policies.items():
        print(f"failure policy {name}: {len(p['modes'])} modes")
    for name, ds in scenario.demands.items():
        print(f"demand set {name}: {len(ds)} demands, volume {sum(float(d.get('volume', 0)) for d in ds):g}")
        for d in sorted(ds, key=lambda d: -float(d.get("volume", 0)))[: None if detail else 5]:
            print(f"  {d['source']} > {d['target']}: {float(d.get('volume', 0)):g}")
    for s in scenario.steps:
        print(f"step {s['name']}: {s['type']}")
        for k in ("source", "target"):
            if s.get(k):
                got, on = (select_nodes(n.nodes, s[k], how).agg(F.countDistinct("label").alias("g"), F.count("*").alias("n")).first() for how in ("adjacency", "workflow"))
                print(f"  {k} {s[k]}: {got.g} groups, {got.n} nodes, {on.n} enabled")


if __name__ == "__main__":
    sys.exit(main())
