"""Street networks with buildings, and how they percolate. Kernels over one window, in plain Python and numpy.

The graph depends on the order of its input (a building may attach to a node
that an earlier one made), so a window is built in one task; windows are many.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Sequence

import numpy as np

Point = tuple[float, float]
Line = tuple[float, list[Point]]


class Network:
    """An undirected simple graph: ``nodes[id] = (x, y, kind)``, ``links[a][b] = (length, kind)``."""

    def __init__(self, snap: float = 1.0):
        self.snap = snap
        self.nodes: list[tuple[float, float, str]] = []
        self.links: list[dict[int, tuple[float, str | None]]] = []
        self.at: dict[Point, int] = {}
        self.streets: list[int] = []
        self._xy = np.empty((64, 2))

    def key(self, p: Point) -> Point:
        """The grid point that ``p`` snaps to; halves go to the even neighbour."""
        return round(p[0] / self.snap) * self.snap, round(p[1] / self.snap) * self.snap

    def add(self, x: float, y: float, kind: str) -> int:
        self.nodes.append((x, y, kind))
        self.links.append({})
        return len(self.nodes) - 1

    def street_node(self, p: Point) -> int:
        """The street node at ``p``'s grid point, made when first seen."""
        key = self.key(p)
        if key not in self.at:
            self.at[key] = self.add(*key, "road")
            if len(self.streets) == len(self._xy):
                self._xy = np.vstack([self._xy, np.empty_like(self._xy)])
            self._xy[len(self.streets)] = key
            self.streets.append(self.at[key])
        return self.at[key]

    def link(self, a: int, b: int, length: float, kind: str | None = None) -> None:
        self.links[a][b] = self.links[b][a] = (length, kind)

    def unlink(self, a: int, b: int) -> None:
        self.links[a].pop(b, None)
        self.links[b].pop(a, None)

    def edges(self) -> list[tuple[int, int, float, str | None]]:
        return [(a, b, *self.links[a][b]) for a in range(len(self.nodes)) for b in self.links[a] if a < b]

    def nearest_street(self, p: Point, upto: int) -> tuple[int | None, float]:
        """Nearest of the first ``upto`` street nodes, the earliest of equals."""
        if not upto:
            return None, math.inf
        away = np.hypot(self._xy[:upto, 0] - p[0], self._xy[:upto, 1] - p[1])
        k = int(away.argmin())
        return self.streets[k], float(away[k])


def _pieces(lines: Sequence[Line]) -> np.ndarray:
    """Straight pieces of all lines: line, place in the line, x1, y1, x2, y2."""
    rows = [(n, i, *p, *q) for n, (_, points) in enumerate(lines) for i, (p, q) in enumerate(zip(points, points[1:]))]
    return np.array(rows, float).reshape(len(rows), 6)


def build(lines: Sequence[Line], buildings: Sequence[Point], *, snap: float = 1.0, reach: float = 10.0, use_width: bool = True) -> Network:
    """Streets, links between ends of different streets, and buildings attached to their nearest street.

    Without streets the graph is empty, whatever the buildings. Lines of fewer than two points are left out.
    """
    g = Network(snap)
    lines = [(w, pts) for w, pts in lines if len(pts) > 1]
    if not lines:
        return g
    for _, points in lines:
        for p, q in zip(points, points[1:]):
            a, b, length = g.street_node(p), g.street_node(q), math.dist(p, q)
            if a != b and length < g.links[a].get(b, (math.inf,))[0]:
                g.link(a, b, length)
    _link_ends(g, lines, reach, use_width)
    homes = [g.add(x, y, "building") for x, y in buildings]
    pieces = _pieces(lines)
    for home, p in zip(homes, buildings):
        _attach(g, home, p, lines, pieces)
    return g


def _link_ends(g: Network, lines: Sequence[Line], reach: float, use_width: bool) -> None:
    ends = [(points[e], width, n) for n, (width, points) in enumerate(lines) for e in (0, -1)]
    most = max(w for _, w, _ in ends) + reach if use_width else reach
    squares: dict[tuple[int, int], list[int]] = {}
    for i, (p, _, _) in enumerate(ends):
        squares.setdefault((math.floor(p[0] / most), math.floor(p[1] / most)), []).append(i)
    for i, (p, width, n) in enumerate(ends):
        cx, cy = math.floor(p[0] / most), math.floor(p[1] / most)
        for j in sorted(k for dx in (-1, 0, 1) for dy in (-1, 0, 1) for k in squares.get((cx + dx, cy + dy), ()) if k > i):
            q, other, m = ends[j]
            a, b = g.street_node(p), g.street_node(q)
            if n == m or a == b or b in g.links[a]:
                continue
            away = math.dist(p, q)
            if away <= ((width + other) / 2 + reach if use_width else reach):
                g.link(a, b, away, "connection")


def _attach(g: Network, home: int, p: Point, lines: Sequence[Line], pieces: np.ndarray) -> None:
    known = len(g.streets)
    x1, y1, x2, y2 = pieces[:, 2:].T
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = np.clip(np.divide((p[0] - x1) * dx + (p[1] - y1) * dy, size, out=np.zeros_like(size), where=size > 0), 0, 1)
    away = np.hypot(p[0] - (x1 + t * dx), p[1] - (y1 + t * dy))
    k = int(away.argmin())
    hit = (float(x1[k] + t[k] * dx[k]), float(y1[k] + t[k] * dy[k]))
    node, gap = g.nearest_street(hit, known)
    if node is not None and gap <= g.snap:
        g.link(home, node, math.dist(p, hit), "virtual")
        return
    node = g.street_node(hit)
    ends = (float(x1[k]), float(y1[k])), (float(x2[k]), float(y2[k]))
    to = [math.dist(hit, e) for e in ends]
    if min(to) > g.snap:
        a, b = (g.street_node(e) for e in ends)
        g.unlink(a, b)
        g.link(a, node, to[0], "road")
        g.link(node, b, to[1], "road")
    else:
        near, gap = g.nearest_street(hit, known)
        if near is not None:
            g.link(node, near, gap, "road")
    g.link(home, node, float(away[k]), "virtual")


def statistics(edges: Sequence[tuple], n: int) -> dict[str, float]:
    """Nodes, edges, components, mean degree and lengths; zeros for an empty graph."""
    lengths = [e[2] for e in edges]
    parts = n - len(_forest(sorted((0.0, e[0], e[1]) for e in edges), n))
    return {
        "n_nodes": n, "n_edges": len(edges), "n_components": parts, "mean_degree": 2 * len(edges) / n if n else 0.0,
        "total_length": float(sum(lengths)), "mean_length": float(np.mean(lengths)) if lengths else 0.0, "max_length": float(max(lengths, default=0.0)),
    }


class _Sets:
    def __init__(self, n: int):
        self.up, self.size = list(range(n)), [1] * n

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.up[b] = a
        self.size[a] += self.size[b]
        return True


def _forest(edges: Iterable[tuple[float, int, int]], n: int) -> list[tuple[float, int, int]]:
    sets = _Sets(n)
    return [e for e in edges if sets.join(e[1], e[2])]


def distance_forest(edges: Sequence[tuple], n: int, terminals: Sequence[int]) -> list[tuple[float, int, int]]:
    """Minimum spanning forest of the shortest-path distances between ``terminals``, without their matrix.

    One search from all terminals labels every node with its nearest; an edge
    between two cells is worth the path through it, and the least of those span
    the same components at every threshold as all pairs do. Time is that of one
    search, memory that of the graph. Indices are into ``terminals``; edges
    without a length count 1, none is shorter than 1e-12.
    """
    around: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, length, *_ in edges:
        w = max(1.0 if length is None else length, 1e-12)
        around[a].append((b, w))
        around[b].append((a, w))
    away, cell = [math.inf] * n, [-1] * n
    heap = []
    for i, t in enumerate(terminals):
        away[t], cell[t] = 0.0, i
        heap.append((0.0, t))
    heapq.heapify(heap)
    while heap:
        d, v = heapq.heappop(heap)
        if d > away[v]:
            continue
        for u, w in around[v]:
            if d + w < away[u]:
                away[u], cell[u] = d + w, cell[v]
                heapq.heappush(heap, (d + w, u))
    crossing = [(away[a] + max(1.0 if length is None else length, 1e-12) + away[b], cell[a], cell[b]) for a, b, length, *_ in edges if cell[a] != cell[b] and -1 not in (cell[a], cell[b])]
    return _forest(sorted(crossing), len(terminals))


def sweep(forest: Sequence[tuple[float, int, int]], n: int, thresholds: Sequence[float], counted: Sequence[bool] | None = None) -> list[tuple[float, int, int, float]]:
    """``(d, largest, clusters, giant)`` of the components under each threshold.

    ``counted`` limits what is measured to some nodes while all of them connect.
    """
    weight = [1] * n if counted is None else [int(c) for c in counted]
    total, sets = sum(weight), _Sets(n)
    mass, clusters, largest, out, k = list(weight), sum(weight), max(weight, default=0), [], 0
    ordered = sorted(forest)
    for d in thresholds:
        while k < len(ordered) and ordered[k][0] <= d:
            a, b = sets.find(ordered[k][1]), sets.find(ordered[k][2])
            k += 1
            if sets.join(a, b):
                root = sets.find(a)
                clusters -= mass[a] > 0 and mass[b] > 0
                mass[root] = mass[a] + mass[b]
                largest = max(largest, mass[root])
        out.append((float(d), largest, clusters, largest / total if total else 0.0))
    return out


def percolation(edges: Sequence[tuple], n: int, terminals: Sequence[int], thresholds: Sequence[float], mode: str = "path") -> list[tuple[float, int, int, float]]:
    """Clusters of terminals by path distance, or (``mode='edge'``) of the graph without its longer edges."""
    if not n or not len(terminals):
        raise ValueError("the graph has no nodes to analyse")
    if mode == "path":
        return sweep(distance_forest(edges, n, terminals), len(terminals), thresholds)
    chosen = set(terminals)
    forest = _forest(sorted((1.0 if e[2] is None else e[2], e[0], e[1]) for e in edges), n)
    return sweep(forest, n, thresholds, [i in chosen for i in range(n)])


def simple_paths(edges: Sequence[tuple], n: int, source: int, target: int, *, tolerance: float = 1.2, most: int = 5, hops: int = 50) -> tuple[int, float]:
    """How many simple paths are at most ``tolerance`` times the shortest (counted up to ``most``), and the shortest length.

    The search is pruned by the distance that is left to the target, so it only
    walks paths that can still qualify.
    """
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, length, *_ in edges:
        around[a][b] = around[b][a] = 1.0 if length is None else length
    left, heap = [math.inf] * n, [(0.0, target)]
    left[target] = 0.0
    while heap:
        d, v = heapq.heappop(heap)
        if d > left[v]:
            continue
        for u, w in around[v].items():
            if d + w < left[u]:
                left[u] = d + w
                heapq.heappush(heap, (d + w, u))
    shortest = left[source]
    if not math.isfinite(shortest):
        return 0, math.inf
    limit, found = shortest * tolerance + 1e-9, 0
    stack = [(source, 0.0, (source,))]
    while stack and found < most:
        v, d, path = stack.pop()
        if v == target:
            found += 1
            continue
        if len(path) > hops:
            continue
        stack += [(u, d + w, (*path, u)) for u, w in around[v].items() if u not in path and d + w + left[u] <= limit]
    return found, shortest


def path_diversity(edges: Sequence[tuple], n: int, nodes: Sequence[int], *, pairs: int | None = None, seed: int = 0, **options) -> dict[str, float]:
    """Totals over all pairs of ``nodes``, or a seeded sample of them."""
    nodes = sorted(nodes)
    every = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :]]
    if pairs is not None and pairs < len(every):
        every = [every[i] for i in sorted(np.random.default_rng(seed).choice(len(every), pairs, replace=False))]
    found = [simple_paths(edges, n, a, b, **options) for a, b in every]
    joined = [(k, d) for k, d in found if math.isfinite(d)]
    return {
        "n_pairs": len(every), "n_connected": len(joined), "n_paths": sum(k for k, _ in joined),
        "diversity": sum(k for k, _ in joined) / len(joined) if joined else 0.0, "mean_distance": float(np.mean([d for _, d in joined])) if joined else math.inf,
    }
