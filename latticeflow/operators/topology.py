"""Building links: patterns, parallels, rules, directions, pseudo nodes."""

from __future__ import annotations

import json
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .select import match_column, select_nodes

PSEUDO = 1e15


def ordered(df: DataFrame, by: str = "node_ord", name: str = "ord") -> DataFrame:
    """A dense position from 0; for the config-sized sides of a link rule."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(by)) - 1)


def mesh(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target) of all pairs but loops; of both orientations the first in order stays."""
    s, t = sources.select(F.col("name").alias("source"), F.col("node_ord").alias("so")), targets.select(F.col("name").alias("target"), F.col("node_ord").alias("to"))
    pairs = s.join(t, F.col("source") != F.col("target"))
    first = F.min_by(F.struct("source", "target", "so", "to"), F.struct("so", "to"))
    out = pairs.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(first.alias("p"))
    return out.select("p.source", "p.target", F.col("p.so").alias("so"), F.col("p.to").alias("to"))


def one_to_one(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target) by position, the shorter side repeated; its size must divide the other's."""
    n, m = sources.count(), targets.count()
    if not n or not m:
        return mesh(sources, targets).limit(0)
    if max(n, m) % min(n, m):
        raise ValueError(f"one_to_one: {n} and {m} are no multiples")
    s = ordered(sources).select(F.col("name").alias("source"), F.col("node_ord").alias("so"), F.col("ord").alias("i"))
    t = ordered(targets).select(F.col("name").alias("target"), F.col("node_ord").alias("to"), F.col("ord").alias("j"))
    key = (F.col("i") == F.col("j") % n) if m >= n else (F.col("i") % m == F.col("j"))
    pairs = s.join(t, key).filter("source <> target")
    first = F.min_by(F.struct("source", "target", "so", "to"), F.greatest("i", "j"))
    out = pairs.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(first.alias("p"))
    return out.select("p.source", "p.target", F.col("p.so").alias("so"), F.col("p.to").alias("to"))


def parallel(pairs: DataFrame, count: int = 1, capacity: float = 1.0, cost: float = 1.0) -> DataFrame:
    """count links for each pair with ids source|target|ordinal."""
    p = pairs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return p.select(F.concat_ws("|", "source", "target", "k").alias("link_id"), "source", "target", F.lit(capacity).alias("capacity"), F.lit(cost).alias("cost"))


def _merge_attrs(new: Mapping):
    """attrs with first-level keys replaced."""
    text = json.dumps(dict(new))

    @F.pandas_udf("string")
    def merge(attrs: pd.Series) -> pd.Series:
        more = json.loads(text)
        return attrs.map(lambda x: json.dumps({**(json.loads(x) if x else {}), **more}))

    return merge(F.col("attrs"))


def node_rules(nodes: DataFrame, rules: list[Mapping]) -> DataFrame:
    """Applies rules in order: disabled, risk_groups (replaced) and attrs (merged)."""
    for rule in rules:
        picked = select_nodes(nodes, {k: rule[k] for k in ("path", "match") if rule.get(k)}, "override").select("name", F.lit(True).alias("hit"))
        nodes = _apply(nodes.join(F.broadcast(picked), "name", "left").withColumn("hit", F.coalesce("hit", F.lit(False))), rule)
    return nodes


def link_rules(links: DataFrame, nodes: DataFrame, rules: list[Mapping]) -> DataFrame:
    """Applies rules in order to links between selected ends, in either direction by default."""
    for rule in rules:
        ends = []
        for end in ("source", "target"):
            names = select_nodes(nodes, rule[end], "override").select("name").distinct()
            ends.append([F.broadcast(names.select(F.col("name").alias(f"_{c}"), F.lit(True).alias(f"_{end}_{c}"))) for c in ("s", "t")])
        df = links
        for end, (a, b) in zip(("source", "target"), ends, strict=True):
            df = df.join(a, df["source"] == a["_s"], "left").drop("_s").join(b, F.col("target") == F.col("_t"), "left").drop("_t")
            del end
        flag = lambda c: F.coalesce(F.col(c), F.lit(False))
        hit = flag("_source_s") & flag("_target_t")
        if rule.get("bidirectional", True):
            hit |= flag("_source_t") & flag("_target_s")
        df = df.withColumn("hit", hit & match_column(links, rule.get("link_match")))
        links = _apply(df.drop("_source_s", "_source_t", "_target_s", "_target_t"), rule)
    return links


def _apply(df: DataFrame, rule: Mapping) -> DataFrame:
    new = {}
    for key in ("capacity", "cost", "disabled", "risk_groups"):
        if rule.get(key) is not None and key in df.columns:
            value = F.array_sort(F.array_distinct(F.array(*map(F.lit, rule[key])))).cast("array<string>") if key == "risk_groups" else F.lit(rule[key]).cast(df.schema[key].dataType)
            new[key] = F.when(F.col("hit"), value).otherwise(F.col(key))
    if rule.get("attrs"):
        new["attrs"] = F.when(F.col("hit"), _merge_attrs(rule["attrs"])).otherwise(F.col("attrs"))
    return df.withColumns(new).drop("hit") if new else df.drop("hit")


def directed(links: DataFrame) -> DataFrame:
    """(link_id, direction, src, dst, capacity, cost): each link forth and back."""
    f = links.select("link_id", F.lit("fwd").alias("direction"), F.col("source").alias("src"), F.col("target").alias("dst"), "capacity", "cost")
    return f.unionByName(links.select("link_id", F.lit("rev").alias("direction"), F.col("target").alias("src"), F.col("source").alias("dst"), "capacity", "cost"))


def active_edges(links: DataFrame, nodes: DataFrame, excluded_nodes=(), excluded_links=()) -> DataFrame:
    """Directed edges that are enabled, not excluded, and have such ends."""
    alive = nodes.filter(~F.col("disabled") & ~F.col("name").isin(list(excluded_nodes))).select("name")
    ok = links.filter(~F.col("disabled") & ~F.col("link_id").isin(list(excluded_links)))
    ok = ok.join(alive.withColumnRenamed("name", "source"), "source", "left_semi").join(alive.withColumnRenamed("name", "target"), "target", "left_semi")
    return directed(ok)


def group_pairs(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(src_label, dst_label) of groups without a node in common."""
    s, t = sources.select(F.col("label").alias("src_label"), "name"), targets.select(F.col("label").alias("dst_label"), "name")
    common = s.join(t, "name").select("src_label", "dst_label").distinct()
    pairs = s.select("src_label").distinct().join(t.select("dst_label").distinct())
    return pairs.join(common, ["src_label", "dst_label"], "left_anti")


def pseudo_edges(sources: DataFrame, targets: DataFrame, mode: str = "combine") -> DataFrame:
    """(src, dst, capacity, cost) from super sources and to super sinks, one for each label."""
    name = (lambda kind, c: F.lit(f"__{kind}__")) if mode == "combine" else (lambda kind, c: F.concat(F.lit(f"__{kind}_"), c, F.lit("__")))
    big, zero = F.lit(PSEUDO).alias("capacity"), F.lit(0.0).alias("cost")
    s = sources.select(name("PSEUDO_SRC", F.col("label")).alias("src"), F.col("name").alias("dst"), big, zero)
    return s.unionByName(targets.select(F.col("name").alias("src"), name("PSEUDO_SNK", F.col("label")).alias("dst"), big, zero)).distinct()


def fill_missing(pairs: DataFrame, found: DataFrame, value: str, default: float = 0.0) -> DataFrame:
    """Every pair, with a default where nothing was found."""
    return pairs.join(found, ["src_label", "dst_label"], "left").withColumn(value, F.coalesce(value, F.lit(default)))
