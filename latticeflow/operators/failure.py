"""Risk groups and failure policies: closures, generated groups, sampling, patterns."""

from __future__ import annotations

import json
import random
import uuid
from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.conditions import attribute, conditions


def written(df: DataFrame) -> DataFrame:
    """Cuts a loop's lineage by a table in the shared folder."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        where = f"file://{tempfile.gettempdir()}/latticeflow-scratch"
    path = f"{where.rstrip('/')}/network/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def descendants(children: DataFrame, names: Sequence[str]) -> DataFrame:
    """(group): the groups and all that lie below them; cycles end."""
    spark = children.sparkSession
    found = spark.createDataFrame([(n,) for n in names], "group string")
    new = found
    while True:
        new = children.join(new.withColumnRenamed("group", "parent"), "parent").select(F.col("child").alias("group")).distinct().join(found, "group", "left_anti")
        new = written(new)
        if not new.limit(1).count():
            return found
        found = written(found.unionByName(new))


def closure(children: DataFrame) -> DataFrame:
    """(ancestor, group): every group with itself and what lies below it."""
    ends = children.select(F.col("parent").alias("g")).union(children.select("child")).distinct()
    found = new = ends.select(F.col("g").alias("ancestor"), F.col("g").alias("group"))
    while True:
        new = new.join(children.withColumnRenamed("parent", "group"), "group").select("ancestor", F.col("child").alias("group")).distinct()
        new = written(new.join(found, ["ancestor", "group"], "left_anti"))
        if not new.limit(1).count():
            return found
        found = written(found.unionByName(new))


def cycles(children: DataFrame) -> DataFrame:
    """(group): those that lie below themselves, at any depth."""
    below = closure(children)
    return children.join(below.select(F.col("ancestor").alias("child"), F.col("group").alias("parent")), ["parent", "child"]).select(F.col("parent").alias("group")).distinct()


def shared_risk(memberships: DataFrame, failed: Sequence[str]) -> DataFrame:
    """(entity): all that share a risk group with a failed entity, and so on, to the end.

    memberships has (entity, group) for nodes and links.
    """
    spark = memberships.sparkSession
    found = new = spark.createDataFrame([(x,) for x in failed], "entity string")
    while True:
        groups = memberships.join(new, "entity").select("group").distinct()
        new = written(memberships.join(groups, "group").select("entity").distinct().join(found, "entity", "left_anti"))
        if not new.limit(1).count():
            return found
        found = written(found.unionByName(new))


def undefined_groups(entities: DataFrame, key: str, risk_groups: DataFrame) -> DataFrame:
    """(entity, group): references to groups that nobody defined."""
    refs = entities.select(F.col(key).alias("entity"), F.explode("risk_groups").alias("name"))
    return refs.join(risk_groups.select("name"), "name", "left_anti").select("entity", F.col("name").alias("group"))


def generate_groups(entities: DataFrame, key: str, group_by: str, template: str, path: str | None = None) -> DataFrame:
    """(group, entity): one group for each distinct value, named by the template; nulls are left out."""
    value, kind = attribute(entities, group_by)
    if kind.startswith("array"):
        raise ValueError(f"{group_by} holds lists; groups need single values")
    text = F.try_variant_get(value, "$", "string") if kind == "variant" else value.cast("string")
    rows = entities if path is None else entities.filter(F.col(key).rlike(f"^(?:{path})"))
    named = rows.select(F.replace(F.lit(template), F.lit("${value}"), text).alias("group"), F.col(key).alias("entity"))
    return named.filter("group is not null")


def membership(entities: DataFrame, key: str, group: str, items: Sequence[Mapping], logic: str = "and") -> DataFrame:
    """(group, entity) for the entities that meet a group's conditions."""
    return entities.filter(conditions(entities, items, logic)).select(F.lit(group).alias("group"), F.col(key).alias("entity"))


# Sampling ---------------------------------------------------------------------------------------


def check_policy(policy: Mapping) -> dict:
    modes = policy.get("modes") or []
    if not modes:
        raise ValueError("a failure policy needs modes")
    for m in modes:
        if float(m.get("weight", 1.0)) < 0:
            raise ValueError("weights must not be negative")
        for r in m.get("rules") or []:
            if r.get("scope", "node") not in ("node", "link", "risk_group"):
                raise ValueError(f"unknown scope {r.get('scope')!r}")
            if r.get("mode", "all") not in ("all", "random", "choice"):
                raise ValueError(f"unknown selection {r.get('mode')!r}")
            if not 0 <= float(r.get("probability", 1.0)) <= 1:
                raise ValueError("a probability lies between 0 and 1")
    return dict(policy)


def policy_dict(policy: Mapping) -> dict:
    """A policy as plain data, with every default filled in."""
    rule = lambda r: {"scope": r.get("scope", "node"), "conditions": [dict(c) for c in (r.get("match") or {}).get("conditions", [])], "logic": (r.get("match") or {}).get("logic", "or"), "mode": r.get("mode", "all"), "probability": float(r.get("probability", 1.0)), "count": int(r.get("count", 1)), **{k: r[k] for k in ("weight_by", "path") if r.get(k)}}
    modes = [{"weight": float(m.get("weight", 1.0)), "rules": [rule(r) for r in m.get("rules") or []], "attrs": dict(m.get("attrs") or {})} for m in policy.get("modes") or []]
    return {"attrs": dict(policy.get("attrs") or {}), "expand_groups": bool(policy.get("expand_groups")), "expand_children": bool(policy.get("expand_children")), "seed": policy.get("seed"), "modes": modes}


def pick_mode(weights: Sequence[float], rng: random.Random) -> int:
    """By cumulative weight; the first without a draw where none is positive."""
    total = sum(w for w in weights if w > 0)
    if total <= 0:
        return 0
    x = rng.random() * total
    for i, s in enumerate(accumulate(max(0.0, w) for w in weights)):
        if x < s:
            return i
    return len(weights) - 1


def weighted_choice(ids: Sequence[str], weights: Sequence[float], k: int, rng: random.Random) -> list[str]:
    """k without replacement by the keys u ** (1 / w); those without weight only fill up."""
    heavy = [(i, w) for i, w in zip(ids, weights, strict=True) if w > 0]
    keyed = sorted(((rng.random() ** (1.0 / w), i) for i, w in heavy), reverse=True)
    out = [i for _, i in keyed[:k]]
    light = [i for i, w in zip(ids, weights, strict=True) if w <= 0]
    return out + rng.sample(light, min(k - len(out), len(light))) if len(out) < k else out


def sample_once(policy: Mapping, matched: Mapping[tuple[int, int], list[tuple[str, float]]], seed: int | None) -> tuple[dict, dict]:
    """What one draw fails, by scope, and its trace.  matched lists (id, weight) by mode and rule."""
    rng = random.Random(seed)
    modes = policy["modes"]
    m = pick_mode([float(x.get("weight", 1.0)) for x in modes], rng)
    failed: dict[str, set] = {"node": set(), "link": set(), "risk_group": set()}
    trace = {"mode_index": m, "mode_attrs": dict(modes[m].get("attrs") or {}), "selections": [], "expansion": {"nodes": [], "links": [], "risk_groups": []}}
    for k, rule in enumerate(modes[m].get("rules") or []):
        rows = matched.get((m, k), [])
        ids, how = [i for i, _ in rows], rule.get("mode", "all")
        if how == "random":
            hit = [i for i in ids if rng.random() < float(rule.get("probability", 1.0))]
        elif how == "choice":
            n = min(int(rule.get("count", 1)), len(ids))
            if rule.get("weight_by"):
                hit = weighted_choice(ids, [w for _, w in rows], n, rng)
            else:
                hit = rng.sample(ids, n)
        else:
            hit = ids
        failed[rule.get("scope", "node")] |= set(hit)
        if hit:
            trace["selections"].append({"rule_index": k, "scope": rule.get("scope", "node"), "mode": how, "matched_count": len(ids), "selected_ids": sorted(hit)})
    return failed, trace


def match_rules(network, policy: Mapping) -> dict[tuple[int, int], list[tuple[str, float]]]:
    """(id, weight) of what each rule matches, in the order of ids."""
    links = network.links
    frames = {"node": (network.nodes, "name", "name"), "link": (links, "link_id", None), "risk_group": (network.risk_groups, "name", "name")}
    out = {}
    for m, mode in enumerate(policy["modes"]):
        for k, rule in enumerate(mode.get("rules") or []):
            df, key, path_on = frames[rule.get("scope", "node")]
            match = rule.get("match") or {}
            rows = df.filter(conditions(df, match.get("conditions", []), match.get("logic", "or")))
            if rule.get("path"):
                on = F.col(path_on) if path_on else F.concat_ws("|", "source", "target")
                rows = rows.filter(on.rlike(f"^(?:{rule['path']})"))
            weight = F.lit(0.0)
            if rule.get("weight_by"):
                value, kind = attribute(df, rule["weight_by"], dotted=False)
                weight = F.coalesce(F.try_variant_get(value, "$", "double") if kind == "variant" else value.try_cast("double"), F.lit(0.0))
            out[m, k] = [(r[0], r[1]) for r in rows.select(F.col(key), weight).orderBy(key).collect()]
    return out


PATTERN = "iteration int, excluded_nodes array<string>, excluded_links array<string>, trace string"


def sample(network, policy: Mapping, iterations: int, seed: int | None) -> DataFrame:
    """One row for each draw: what it excludes.  Draw i uses seed + i, on whatever task it runs."""
    policy = check_policy(policy)
    spark: SparkSession = network.nodes.sparkSession
    node_groups = {r[0]: list(r[1]) for r in network.nodes.select("name", "risk_groups").collect()}
    link_groups = {r[0]: list(r[1]) for r in network.links.select("link_id", "risk_groups").collect()}
    kids: dict[str, list[str]] = {}
    for r in network.children.collect():
        kids.setdefault(r[0], []).append(r[1])
    top = {r[0] for r in network.risk_groups.filter("is_top_level").select("name").collect()}
    held: dict[str, set[str]] = {}
    for where in (node_groups, link_groups):
        for x, gs in where.items():
            for g in gs:
                held.setdefault(g, set()).add(x)
    sent = spark.sparkContext.broadcast((policy, match_rules(network, policy), node_groups, link_groups, kids, top, held))

    def below(start, kids):
        seen, stack = set(), list(start)
        while stack:
            g = stack.pop()
            if g not in seen:
                seen.add(g)
                stack += kids.get(g, [])
        return seen

    def draw(batches):
        import pyarrow as pa

        policy, matched, node_groups, link_groups, kids, top, held = sent.value
        for batch in batches:
            rows = []
            for i in batch.column(0).to_pylist():
                failed, trace = sample_once(policy, matched, None if seed is None else seed + i)
                nodes, links, groups = set(failed["node"]), set(failed["link"]), set(failed["risk_group"])
                drawn = [set(x) for x in (nodes, links, groups)]
                if policy.get("expand_groups"):
                    stack = [*nodes, *links]
                    while stack:
                        x = stack.pop()
                        for g in [*node_groups.get(x, ()), *link_groups.get(x, ())]:
                            for y in held.get(g, ()):
                                if y not in nodes and y not in links:
                                    (nodes if y in node_groups else links).add(y)
                                    stack.append(y)
                if policy.get("expand_children"):
                    groups = below(groups, kids)
                trace["expansion"] = {k: sorted(x - y) for k, x, y in zip(("nodes", "links", "risk_groups"), (nodes, links, groups), drawn, strict=True)}
                # A failed group at the top takes the members of all groups below it.
                for g in below(groups & top, kids):
                    for x in held.get(g, ()):
                        (nodes if x in node_groups else links).add(x)
                rows.append((i, sorted(nodes), sorted(links), json.dumps(trace)))
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            kinds = (pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["iteration", "excluded_nodes", "excluded_links", "trace"])

    return spark.range(iterations).select(F.col("id").cast("int")).mapInArrow(draw, PATTERN)


def distinct_patterns(samples: DataFrame) -> DataFrame:
    """One row for each distinct exclusion, with how often it came and the first trace."""
    return samples.groupBy("excluded_nodes", "excluded_links").agg(F.count("*").alias("occurrence_count"), F.min("iteration").alias("first_iteration"), F.min_by("trace", "iteration").alias("trace"))


def weighted_top_k(df: DataFrame, key: str, u: str, weight: str, k: int) -> DataFrame:
    """The relational form: k rows with the largest u ** (1 / weight), rows without weight last."""
    score = F.when(F.col(weight) > 0, F.pow(F.col(u), F.lit(1.0) / F.col(weight))).otherwise(F.lit(-1.0))
    return df.withColumn("score", score).orderBy(F.col("score").desc(), F.col(key)).limit(k)


def cumulative_weights(modes: DataFrame, order: str, weight: str) -> DataFrame:
    """Running sums of weights, for picking a mode by a draw.

    The sums run in two levels, over ranges of the order and within each, so that no task sees all rows.
    """
    n = int(modes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(modes.repartitionByRange(n, order).withColumn("_block", F.spark_partition_id()))
    w = F.greatest(F.col(weight), F.lit(0))
    before = F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy("_block").agg(F.sum(w).alias("_sum")).select("_block", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum(w).over(Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(F.broadcast(blocks), "_block").withColumn("upto", F.col("_before") + within).drop("_block", "_before")
