"""Paths as columns: what one can ask of an array of hops (node, edges onward)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nodes_of(hops: Column) -> Column:
    return F.transform(hops, lambda h: h["node"])


def edges_of(hops: Column) -> Column:
    """All edges that any of the path's parallel choices uses."""
    return F.array_distinct(F.flatten(F.transform(hops, lambda h: h["edges"])))


def edge_sequence(hops: Column) -> Column:
    """The parallel choices from each node to the next; none for a path of one node."""
    return F.transform(F.slice(hops, F.lit(1), F.greatest(F.size(hops) - 1, F.lit(0))), lambda h: h["edges"])


def same_path(hops: Column, cost: Column, other_hops: Column, other_cost: Column) -> Column:
    """Equal in every hop and in cost."""
    return (hops == other_hops) & (cost == other_cost)


def in_order(cost: Column, hops: Column) -> list[Column]:
    """What to order paths by: the cost, then the nodes."""
    return [cost, nodes_of(hops)]


def source(hops: Column) -> Column:
    return F.element_at(hops, 1)["node"]


def target(hops: Column) -> Column:
    return F.element_at(hops, -1)["node"]


def sub_path(hops: Column, to: Column) -> Column:
    """The path up to a node on it, without edges onward from there; null if it is not on it."""
    place = F.array_position(nodes_of(hops), to)
    head = F.slice(hops, F.lit(1), F.greatest(place.cast("int") - 1, F.lit(0)))
    last = F.transform(F.filter(hops, lambda h: h["node"] == to), lambda h: h.withField("edges", F.slice(h["edges"], 1, 0)))
    return F.when(place > 0, F.concat(head, F.slice(last, 1, 1)))
