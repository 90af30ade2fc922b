"""Selection and grouping of nodes and links."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import attribute, conditions, java_pattern, label, python_text


def normalize(selector, context: str = "workflow") -> dict:
    """A path, or a mapping with path, match or group_by, as a mapping with defaults."""
    if isinstance(selector, str):
        selector = {"path": selector}
    if not isinstance(selector, Mapping):
        raise ValueError(f"a selector is text or a mapping, not {selector!r}")
    unknown = set(selector) - {"path", "match", "group_by", "active_only"}
    if unknown:
        raise ValueError(f"unknown selector keys {sorted(unknown)}")
    if not any(selector.get(k) for k in ("path", "match", "group_by")):
        raise ValueError("a selector needs path, match or group_by")
    default = {"adjacency": False, "override": False, "demand": True, "workflow": True}
    if context not in default:
        raise ValueError(f"unknown context {context!r}")
    active = selector.get("active_only")
    return {**selector, "active_only": default[context] if active is None else bool(active)}


def match_column(df: DataFrame, match: Mapping | None, default_logic: str = "or") -> Column:
    if not match:
        return F.lit(True)
    if not isinstance(match, Mapping) or not isinstance(match.get("conditions", []), Sequence):
        raise ValueError("match needs a list of conditions")
    return conditions(df, match.get("conditions", []), match.get("logic", default_logic))


def select_nodes(nodes: DataFrame, selector, context: str = "workflow", excluded: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """(label, name, node_ord): path, then match, then what is active and not excluded, then groups."""
    s = normalize(selector, context)
    df = nodes
    if s.get("path"):
        df = df.withColumn("label", label(s["path"])).filter(F.col("label").isNotNull())
    else:
        df = df.withColumn("label", F.lit(".*"))
    df = df.filter(match_column(nodes, s.get("match")))
    if s["active_only"]:
        df = df.filter(~F.col("disabled"))
    if excluded is not None:
        df = df.join(excluded.toDF("name"), "name", "left_anti") if isinstance(excluded, DataFrame) else df.filter(~F.col("name").isin(list(excluded)))
    if s.get("group_by"):
        value, kind = attribute(nodes, s["group_by"], dotted=False)
        df = df.withColumn("label", python_text(value, kind)).filter(F.col("label").isNotNull())
    return df.select("label", "name", "node_ord")


def match_ids(df: DataFrame, key: str, items: Sequence[Mapping], logic: str = "and") -> DataFrame:
    """Ids of the rows that meet the conditions."""
    return df.filter(conditions(df, items, logic)).select(key)


def find_links(links: DataFrame, source: str | None = None, target: str | None = None, any_direction: bool = False) -> DataFrame:
    """Links whose ends hold the patterns anywhere."""

    def has(column: str, pattern: str | None) -> Column:
        if pattern is None:
            return F.lit(True)
        text = java_pattern(pattern)
        if text is None:
            raise ValueError(f"pattern {pattern!r} has no form for Spark")
        return F.col(column).rlike(text)

    test = has("source", source) & has("target", target)
    if any_direction:
        test |= has("source", target) & has("target", source)
    return links.filter(test)


def links_between(links: DataFrame, a: str, b: str) -> DataFrame:
    return links.filter((F.col("source") == a) & (F.col("target") == b))
