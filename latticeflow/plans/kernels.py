"""Graph kernels in plain Python and numpy, run inside Spark tasks over a broadcast graph.

A graph is arrays of directed edges.  Costs are whole numbers.  Masks say which nodes and edges take
part.  Flow goes by tiers: shortest paths over what has capacity left, then the next cost.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

MIN_FLOW = 2.0**-12
TINY = 1e-9
LARGE = 1e15
PROPORTIONAL, EQUAL_BALANCED = "PROPORTIONAL", "EQUAL_BALANCED"


@dataclass
class Graph:
    """Nodes by name, edges by position; link and direction name the edge outside."""

    names: list[str]
    src: np.ndarray
    dst: np.ndarray
    capacity: np.ndarray
    cost: np.ndarray
    link: list[str | None]
    direction: list[str | None]
    index: dict[str, int] = field(init=False)
    out: list[list[int]] = field(init=False)

    def __post_init__(self) -> None:
        self.index = {n: i for i, n in enumerate(self.names)}
        self.out = [[] for _ in self.names]
        for e, s in enumerate(self.src.tolist()):
            self.out[s].append(e)
        self._src, self._dst, self._cost = self.src.tolist(), self.dst.tolist(), self.cost.tolist()

    def masks(self, no_nodes=(), no_links=()) -> tuple[list[bool], list[bool]]:
        nodes = [True] * len(self.names)
        for n in no_nodes:
            if n in self.index:
                nodes[self.index[n]] = False
        gone = set(no_links)
        return nodes, [x is None or x not in gone for x in self.link]


def spf(g: Graph, s: int, nodes, edges, room=None, least: float = MIN_FLOW, target: int | None = None):
    """Distances and, for each node, the edges that arrive on a shortest path."""
    dist, pred = [math.inf] * len(g.names), [[] for _ in g.names]
    if not nodes[s]:
        return dist, pred
    dist[s], queue, done = 0, [(0, s)], [False] * len(g.names)
    while queue:
        d, u = heapq.heappop(queue)
        if done[u]:
            continue
        if target is not None and d > dist[target]:
            break
        done[u] = True
        for e in g.out[u]:
            v = g._dst[e]
            if not edges[e] or not nodes[v] or (room is not None and room[e] < least):
                continue
            x = d + g._cost[e]
            if x < dist[v]:
                dist[v], pred[v] = x, [e]
                heapq.heappush(queue, (x, v))
            elif x == dist[v] and v != s and not done[v]:
                pred[v].append(e)
    return dist, pred


def _dag(g: Graph, pred, s: int, t: int) -> tuple[list[int], list[int]]:
    """Edges of the shortest-path DAG that lead to t, and its nodes from s on in topological order."""
    seen, stack, used = {t}, [t], []
    while stack:
        v = stack.pop()
        for e in pred[v]:
            used.append(e)
            u = g._src[e]
            if u not in seen:
                seen.add(u)
                stack.append(u)
    into = defaultdict(int)
    out = defaultdict(list)
    for e in used:
        into[g._dst[e]] += 1
        out[g._src[e]].append(e)
    order, ready = [], deque([s])
    while ready:
        u = ready.popleft()
        order.append(u)
        for e in out[u]:
            v = g._dst[e]
            into[v] -= 1
            if not into[v]:
                ready.append(v)
    return used, order


def place_equal(g: Graph, pred, s: int, t: int, room, most: float = math.inf) -> tuple[float, dict[int, float]]:
    """Splits equally over each node's edges; one scale for all, so that none is over its room."""
    used, order = _dag(g, pred, s, t)
    out = defaultdict(list)
    for e in used:
        out[g._src[e]].append(e)
    share, each = defaultdict(float), {}
    share[s] = 1.0
    for u in order:
        for e in out[u]:
            each[e] = share[u] / len(out[u])
            share[g._dst[e]] += each[e]
    scale = min((room[e] / x for e, x in each.items() if x > 0), default=0.0)
    scale = max(0.0, min(scale, most))
    return scale, {e: x * scale for e, x in each.items() if x * scale > 0}


def place_proportional(g: Graph, pred, s: int, t: int, room, most: float = math.inf) -> tuple[float, dict[int, float]]:
    """The largest flow over the DAG, up to most; parallel edges share by what they can take."""
    used, _ = _dag(g, pred, s, t)
    groups = defaultdict(list)
    for e in used:
        if room[e] > 0:
            groups[g._src[e], g._dst[e]].append(e)
    left = {k: sum(room[e] for e in v) for k, v in groups.items()}
    for u, v in list(left):
        left.setdefault((v, u), 0.0)
    near = defaultdict(list)
    for u, v in left:
        near[u].append(v)
    total = 0.0
    while total < most - TINY * 1e-3:
        level, queue = {s: 0}, deque([s])
        while queue and t not in level:
            u = queue.popleft()
            for v in near[u]:
                if v not in level and left[u, v] > 1e-12:
                    level[v] = level[u] + 1
                    queue.append(v)
        if t not in level:
            break
        at = dict.fromkeys(near, 0)
        while total < most - TINY * 1e-3:
            path, u = [], s
            while u != t:
                while at.get(u, 0) < len(near[u]):
                    v = near[u][at[u]]
                    if left[u, v] > 1e-12 and level.get(v, -1) == level[u] + 1:
                        path.append((u, v))
                        u = v
                        break
                    at[u] += 1
                else:
                    if not path:
                        break
                    u, _ = path.pop()
                    at[u] += 1
                    continue
            if u != t:
                break
            push = min(min(left[p] for p in path), most - total)
            for u, v in path:
                left[u, v] -= push
                left[v, u] += push
            total += push
    flow = {}
    for (u, v), group in groups.items():
        able = sum(room[e] for e in group)
        taken = able - left[u, v]
        if taken > 1e-12:
            for e in group:
                flow[e] = taken * room[e] / able
    return total, flow


PLACERS = {PROPORTIONAL: place_proportional, EQUAL_BALANCED: place_equal}


@dataclass
class Flow:
    total: float
    by_cost: dict[float, float]
    on_edge: dict[int, float]
    room: list[float]


def max_flow(g: Graph, s: int, t: int, nodes, edges, placement: str = PROPORTIONAL, shortest_path: bool = False, require_capacity: bool = True) -> Flow:
    """Flow by cost tiers; shortest_path stops after one, require_capacity routes around full edges."""
    if placement not in PLACERS:
        raise ValueError(f"unknown placement {placement!r}")
    room, total, by_cost, on_edge = g.capacity.tolist(), 0.0, {}, defaultdict(float)
    while s != t:
        dist, pred = spf(g, s, nodes, edges, room if require_capacity else None, target=t)
        if math.isinf(dist[t]):
            break
        placed, flow = PLACERS[placement](g, pred, s, t, room)
        if placed < MIN_FLOW:
            break
        total += placed
        by_cost[float(dist[t])] = by_cost.get(float(dist[t]), 0.0) + placed
        for e, x in flow.items():
            room[e] -= x
            on_edge[e] += x
        if shortest_path:
            break
    return Flow(total, by_cost, dict(on_edge), room)


def sensitivity(g: Graph, s: int, t: int, nodes, edges, **how) -> dict[int, float]:
    """For each full edge that carries flow: how much less flows without it."""
    base = max_flow(g, s, t, nodes, edges, **how)
    out = {}
    for e in sorted(base.on_edge):
        if base.room[e] < MIN_FLOW and g.link[e] is not None:
            without = list(edges)
            without[e] = False
            less = base.total - max_flow(g, s, t, nodes, without, **how).total
            if less > TINY:
                out[e] = less
    return out


def dag_paths(g: Graph, pred, s: int, t: int, split: bool = False) -> Iterator[tuple[tuple[int, tuple[int, ...]], ...]]:
    """Yields all paths as (node, edges onward), in order; parallel edges stay together unless split."""
    by_ends = defaultdict(list)
    for e in _dag(g, pred, s, t)[0]:
        by_ends[g._src[e], g._dst[e]].append(e)
    onward = defaultdict(list)
    for (u, v), es in by_ends.items():
        onward[u] += [((e,), v) for e in es] if split else [(tuple(sorted(es)), v)]
    for ways in onward.values():
        ways.sort()
    head, stack = [], [iter([((), s)])]
    while stack:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if head:
                head.pop()
            continue
        group, u = step
        if stack[1:]:
            head[-1] = (head[-1][0], group)
        if u == t:
            yield (*head, (t, ()))
        else:
            head.append((u, ()))
            stack.append(iter(onward[u]))


def k_shortest(g: Graph, s: int, t: int, nodes, edges, k: int, most_cost: float = math.inf, factor: float | None = None):
    """Yen's loop-free node paths as (cost, path), cheapest first, then by nodes."""

    def best(a: int, nodes, banned: set[tuple[int, int]]):
        allowed = [ok and (g._src[e], g._dst[e]) not in banned for e, ok in enumerate(edges)]
        dist, pred = spf(g, a, nodes, allowed, target=t)
        if math.isinf(dist[t]):
            return None
        path, v = [t], t
        while v != a:
            v = min(g._src[e] for e in pred[v])
            path.insert(0, v)
        return dist[t], path

    def cost(path: list[int]) -> int:
        return sum(min(g._cost[e] for e in g.out[u] if edges[e] and g._dst[e] == v) for u, v in itertools.pairwise(path))

    first = best(s, nodes, set())
    if first is None or s == t:
        return []
    limit = min(most_cost, first[0] * factor if factor is not None else math.inf)
    found, queue, seen = [], [(first[0], first[1])], {tuple(first[1])}
    while queue and len(found) < k:
        c, path = heapq.heappop(queue)
        if c > limit + TINY:
            break
        found.append((c, path))
        for i in range(len(path) - 1):
            root = path[: i + 1]
            banned = {(p[i], p[i + 1]) for _, p in found if p[: i + 1] == root}
            open_nodes = list(nodes)
            for n in root[:-1]:
                open_nodes[n] = False
            more = best(path[i], open_nodes, banned)
            if more and tuple(root[:-1] + more[1]) not in seen:
                whole = root[:-1] + more[1]
                seen.add(tuple(whole))
                heapq.heappush(queue, (cost(whole), whole))
    out = []
    for c, path in found:
        hops = [(u, tuple(e for e in g.out[u] if edges[e] and g._dst[e] == v and g._cost[e] == min(g._cost[x] for x in g.out[u] if edges[x] and g._dst[x] == v))) for u, v in itertools.pairwise(path)]
        out.append((c, [*hops, (path[-1], ())]))
    return out


#: Flow policy presets and what each one means.
PRESETS = {
    "SHORTEST_PATHS_ECMP": {"placement": EQUAL_BALANCED, "require_capacity": False, "lsps": None, "rounds": 1},
    "SHORTEST_PATHS_WCMP": {"placement": PROPORTIONAL, "require_capacity": False, "lsps": None, "rounds": 1},
    "TE_WCMP_UNLIM": {"placement": PROPORTIONAL, "require_capacity": True, "lsps": None, "rounds": 100},
    "TE_ECMP_UP_TO_256_LSP": {"placement": EQUAL_BALANCED, "require_capacity": True, "lsps": (1, 256), "rounds": 1},
    "TE_ECMP_16_LSP": {"placement": EQUAL_BALANCED, "require_capacity": True, "lsps": (16, 16), "rounds": 1},
}


def preset_name(value) -> str:
    """A preset from its name in any case, its number, or None for the default."""
    if value is None or value == "":
        return "SHORTEST_PATHS_ECMP"
    if isinstance(value, int) or str(value).isdigit():
        names = list(PRESETS)
        if not 1 <= int(value) <= len(names):
            raise ValueError(f"unknown flow policy {value!r}")
        return names[int(value) - 1]
    if str(value).upper() not in PRESETS:
        raise ValueError(f"unknown flow policy {value!r}")
    return str(value).upper()


def _single_path(g: Graph, s: int, t: int, nodes, edges, load, least: float):
    """One shortest path by cost; of equals the one whose narrowest edge has most room."""
    dist, pred = spf(g, s, nodes, edges, load, max(least, MIN_FLOW), target=t)
    if math.isinf(dist[t]):
        return None
    wide, take = {s: math.inf}, {}
    _, order = _dag(g, pred, s, t)
    for v in order[1:]:
        wide[v], take[v] = max((min(wide[g._src[e]], load[e]), -e) for e in pred[v] if g._src[e] in wide)
    path, v = [], t
    while v != s:
        path.append(-take[v])
        v = g._src[-take[v]]
    return dist[t], path[::-1]


def place_lsps(g: Graph, s: int, t: int, volume: float, room: list[float], nodes, edges, fewest: int, most: int):
    """Single-path tunnels of equal volume; the number that carries most is used."""

    def tunnels(n: int):
        """n paths chosen one by one, each on the widest of the cheapest given those before."""
        count, chosen = defaultdict(int), []
        for _ in range(n):
            share = [room[e] / (count.get(e, 0) + 1) if room[e] >= MIN_FLOW else 0.0 for e in range(len(room))]
            got = _single_path(g, s, t, nodes, edges, share, MIN_FLOW)
            if got is None:
                return None
            # A dearer path may leave each tunnel more than the cheapest one does.
            best = min(share[e] for e in got[1])
            for c, hops in alternatives:
                wide = min(share[e] for e in hops)
                if wide > best + TINY:
                    got, best = (c, hops), wide
            chosen.append(got)
            for e in got[1]:
                count[e] += 1
        each = min([volume / n, *(room[e] / c for e, c in count.items())])
        return each * n, each, chosen

    alternatives = []
    blocked = list(edges)
    while (got := _single_path(g, s, t, nodes, blocked, room, MIN_FLOW)) and len(alternatives) < most:
        alternatives.append(got)
        narrow = min(got[1], key=lambda e: room[e])
        blocked[narrow] = False
    best = (0.0, 0.0, [])
    for n in sorted({fewest, most, *range(fewest, min(most, max(fewest, len(alternatives))) + 1)}):
        got = tunnels(n)
        if got and got[0] > best[0] + TINY:
            best = got
        if best[0] >= volume - TINY:
            break
    total, each, chosen = best
    by_cost, on_edge = defaultdict(float), defaultdict(float)
    for c, hops in chosen:
        by_cost[float(c)] += each
        for e in hops:
            on_edge[e] += each
    return total, dict(by_cost), dict(on_edge)


def place_demands(g: Graph, demands: list[tuple[int, int, float, str]], nodes, edges) -> list[tuple[float, dict, dict]]:
    """Places (from, to, volume, preset) one after the other on shared capacity, in the given order.

    Shortest paths by cost alone are found once for each source.
    """
    room, memo, out = g.capacity.tolist(), {}, []
    for s, t, volume, preset in demands:
        p = PRESETS[preset]
        placed, by_cost, on_edge = 0.0, defaultdict(float), defaultdict(float)
        if s != t and nodes[s] and nodes[t]:
            if p["lsps"]:
                placed, costs, flow = place_lsps(g, s, t, volume, room, nodes, edges, *p["lsps"])
                by_cost.update(costs)
                for e, x in flow.items():
                    room[e] -= x
                    on_edge[e] += x
            else:
                for turn in range(p["rounds"]):
                    if volume - placed <= TINY:
                        break
                    if p["require_capacity"]:
                        dist, pred = spf(g, s, nodes, edges, room, TINY, target=t)
                    else:
                        if s not in memo:
                            memo[s] = spf(g, s, nodes, edges)
                        dist, pred = memo[s]
                    if math.isinf(dist[t]):
                        break
                    got, flow = PLACERS[p["placement"]](g, pred, s, t, room, volume - placed)
                    if got <= TINY:
                        break
                    placed += got
                    by_cost[float(dist[t])] += got
                    for e, x in flow.items():
                        room[e] -= x
                        on_edge[e] += x
        out.append((placed, dict(by_cost), dict(on_edge)))
    return out
