"""Demand expansion: selectors to concrete pairs with volumes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.kernels import LARGE, preset_name
from .select import select_nodes

SCHEMA = "demand_id string, src string, dst string, volume double, priority int, preset string, demand_ord long, pair_ord long"


def pairwise(sources: DataFrame, targets: DataFrame, volume: float) -> DataFrame:
    """Every ordered pair but a node with itself; the volume is shared equally."""
    s, t = sources.select(F.col("name").alias("src"), F.col("node_ord").alias("so")), targets.select(F.col("name").alias("dst"), F.col("node_ord").alias("to"))
    pairs = s.join(t, F.col("src") != F.col("dst"))
    n = pairs.groupBy().agg(F.count("*").alias("n"))
    return pairs.join(F.broadcast(n)).select("src", "dst", (F.lit(float(volume)) / F.col("n")).alias("volume"), "so", "to")


def label_pairs(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Ordered pairs of different labels."""
    s, t = sources.select(F.col("label").alias("src_label")).distinct(), targets.select(F.col("label").alias("dst_label")).distinct()
    return s.join(t, F.col("src_label") != F.col("dst_label"))


def grouped(sources: DataFrame, targets: DataFrame, volume: float, share: bool) -> DataFrame:
    """(src_label, dst_label, volume): the whole volume for each pair of labels, or an equal share."""
    pairs = label_pairs(sources, targets)
    if not share:
        return pairs.withColumn("volume", F.lit(float(volume)))
    n = pairs.groupBy().agg(F.count("*").alias("n"))
    return pairs.join(F.broadcast(n)).select("src_label", "dst_label", (F.lit(float(volume)) / F.col("n")).alias("volume"))


def grouped_pairwise(sources: DataFrame, targets: DataFrame, volume: float, share: bool) -> DataFrame:
    """Each label pair's volume over its node pairs."""
    pairs = grouped(sources, targets, volume, share)
    s, t = sources.select(F.col("label").alias("src_label"), F.col("name").alias("src")), targets.select(F.col("label").alias("dst_label"), F.col("name").alias("dst"))
    each = pairs.join(s, "src_label").join(t, "dst_label").filter("src <> dst")
    n = F.count("*").over(Window.partitionBy("src_label", "dst_label"))
    return each.select("src_label", "dst_label", "src", "dst", (F.col("volume") / n).alias("volume"))


def check(demand: Mapping) -> dict:
    """A demand with its defaults; combine and flatten unless it says otherwise."""
    d = {"volume": 0.0, "priority": 0, "mode": "combine", "group_mode": "flatten", "flow_policy": None, **demand}
    if d["mode"] not in ("combine", "pairwise"):
        raise ValueError(f"unknown mode {d['mode']!r}")
    if d["group_mode"] not in ("flatten", "per_group", "group_pairwise"):
        raise ValueError(f"unknown group_mode {d['group_mode']!r}")
    if float(d["volume"]) < 0 or int(d["priority"]) < 0:
        raise ValueError("volume and priority must not be negative")
    d["preset"] = preset_name(d["flow_policy"])
    return d


def expand(nodes: DataFrame, demands: Sequence[Mapping]) -> tuple[list[dict], list[tuple[str, str, float, float]]]:
    """Concrete demands in order of priority, and the edges of pseudo nodes for combined ones.

    All demands' selections are one job; what comes back is the pairs to place, which the kernels
    need on one machine anyway.
    """
    out, extra, frames = [], [], []
    checked = [check(d) for d in demands]
    for i, d in enumerate(checked):
        for side in ("source", "target"):
            frames.append(select_nodes(nodes, d[side], "demand").select(F.lit(i).alias("i"), F.lit(side).alias("side"), "label", "name", "node_ord"))
    picked: dict[tuple[int, str], list] = {}
    if frames:
        every = frames[0]
        for f in frames[1:]:
            every = every.unionByName(f)
        for r in sorted(every.collect(), key=lambda r: r.node_ord):
            picked.setdefault((r.i, r.side), []).append((r.label, r.name))
    for i, d in enumerate(checked):
        src, dst = picked.get((i, "source")), picked.get((i, "target"))
        if not src or not dst:
            continue
        base = d.get("id") or f"demand_{i}"
        for name, a, b, volume in _groups(d, base, src, dst):
            if not a or not b:
                continue
            if d["mode"] == "combine":
                s, t = f"_src_{name}", f"_snk_{name}"
                extra += [(s, x, LARGE, 0) for x in a] + [(x, t, LARGE, 0) for x in b]
                pairs = [(s, t)]
            else:
                pairs = [(x, y) for x in a for y in b if x != y]
            out += [{"demand_id": name, "src": x, "dst": y, "volume": volume / len(pairs), "priority": int(d["priority"]), "preset": d["preset"]} for x, y in pairs]
    if not out and demands:
        raise ValueError("no demand selects any pair")
    return sorted(out, key=lambda x: x["priority"]), extra


def _groups(d: Mapping, base: str, src: list, dst: list):
    """(name, source nodes, target nodes, volume) for each part of a demand."""
    volume = float(d["volume"])
    if d["group_mode"] == "flatten":
        yield base, [n for _, n in src], [n for _, n in dst], volume
        return
    by = lambda rows: {k: [n for x, n in rows if x == k] for k in dict.fromkeys(x for x, _ in rows)}
    s, t = by(src), by(dst)
    pairs = [(a, b) for a in s for b in t if a != b]
    for a, b in pairs:
        yield f"{base}|{a}|{b}", s[a], t[b], volume / (len(pairs) if d["group_mode"] == "group_pairwise" else 1)
