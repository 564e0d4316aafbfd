"""Array kernels of the randomized-shortest-path model; they run inside tasks on a broadcast graph.

A ``Graph`` is a set of flat arrays. Nodes are the active cells in ascending order, edges are sorted by
source. Every function takes a block of targets, so that tasks work on blocks independently.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

LARGEST = np.finfo(float).max
#: Bytes of the inverted blocks of one factorisation, at most; a 700 x 700 lattice takes 2.7 GB.
SOLVER_BYTES = 3 << 30


@dataclass
class Graph:
    cell: np.ndarray  # cell number of each node
    col: np.ndarray  # raster column of each node
    qs: np.ndarray
    qt: np.ndarray
    targets: np.ndarray  # node positions
    src: np.ndarray
    dst: np.ndarray
    affinity: np.ndarray
    cost: np.ndarray
    pref: np.ndarray
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    theta: float = 0.0
    row: np.ndarray | None = None  # raster row of each node

    def __getstate__(self) -> dict:  # what was derived stays behind
        return {k: self.__dict__[k] for k in self.__dataclass_fields__}

    @property
    def n(self) -> int:
        return len(self.cell)


def starts_of(sorted_ids: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(sorted_ids, np.arange(n + 1))


def reference_walk(n: int, src: np.ndarray, affinity: np.ndarray) -> np.ndarray:
    """Each edge's share of its source's affinity."""
    total = np.bincount(src, weights=affinity, minlength=n)
    with np.errstate(all="ignore"):
        return affinity / total[src]


def boltzmann(pref: np.ndarray, cost: np.ndarray, theta: float) -> np.ndarray:
    """pref * exp(-theta * cost), with NaN as 0."""
    with np.errstate(all="ignore"):
        return np.nan_to_num(pref * np.exp(-theta * np.nan_to_num(cost, nan=0.0, posinf=np.inf)), nan=0.0)


def edge_product(g: Graph, values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The sparse matrix of ``values`` on the edges times ``x`` (n x k)."""
    out = np.zeros((g.n, x.shape[1]))
    begin = starts_of(g.src, g.n)
    some = np.flatnonzero(begin[1:] > begin[:-1])
    if len(some):
        out[some] = np.add.reduceat(values[:, None] * x[g.dst], begin[some])
    return out


class Band:
    """A sparse matrix: the edges between two neighbouring blocks."""

    def __init__(self, shape: tuple[int, int], i: np.ndarray, j: np.ndarray, v: np.ndarray):
        self.shape, self.entries = shape, (i, j, v)
        by = np.argsort(i, kind="stable")
        self.rows, self.begin = np.unique(i[by], return_index=True)
        self.j, self.v = j[by], v[by][:, None]

    @property
    def t(self) -> Band:
        i, j, v = self.entries
        return Band(self.shape[::-1], j, i, v)

    def dot(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[0], x.shape[1]))
        if len(self.rows):
            out[self.rows] = np.add.reduceat(self.v * x[self.j], self.begin)
        return out


def blocks_of(src: np.ndarray, dst: np.ndarray, axes: list[np.ndarray]) -> np.ndarray:
    """Block numbers with edges between neighbouring blocks only and the fewest squares of block sizes."""
    best, cost = np.zeros(len(axes[0]), int), float(len(axes[0])) ** 2
    for axis in axes:
        block = np.unique(axis, return_inverse=True)[1]
        size = float((np.bincount(block).astype(float) ** 2).sum()) if len(block) else 0.0
        if size < cost and not (np.abs(block[src] - block[dst]) > 1).any():
            best, cost = block, size
    return best


class Solver:
    """Solves (I - W) X = B and its transpose from one factorisation.

    On a lattice the nodes of one raster column (or row: the shorter ones are taken) only meet those of the next
    ones, so I - W is block tridiagonal and is eliminated block by block; it is an M-matrix and needs no exchanges
    between blocks. Only the inverses of the blocks are dense. Other graphs are one block. More than SOLVER_BYTES
    of inverses raise an error: ``DistributedModel`` needs none.
    """

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, *axes: np.ndarray):
        block = blocks_of(src, dst, list(axes))
        sizes = np.bincount(block, minlength=1)
        if 8 * float((sizes.astype(float) ** 2).sum()) > SOLVER_BYTES:
            raise ValueError(f"blocks of up to {sizes.max()} nodes are too large to factorise in a task: use DistributedModel")
        order = np.argsort(block, kind="stable")
        place = np.empty(n, int)
        place[order] = np.arange(n)
        self.order, self.n = order, n
        self.cuts = np.concatenate([[0], np.cumsum(sizes)])
        inner = place - self.cuts[block]
        m = len(sizes)
        step = block[dst] - block[src]
        by = np.lexsort((step, block[src]))
        runs = np.searchsorted((block[src] * 3 + step + 1)[by], np.arange(3 * m + 1))
        part = lambda b, s: by[runs[3 * b + s + 1] : runs[3 * b + s + 2]]
        band = lambda b, s: Band((sizes[b], sizes[b + s]), inner[src[part(b, s)]], inner[dst[part(b, s)]], -w[part(b, s)])
        self.up = [band(k, 1) for k in range(m - 1)]
        self.low = [band(k + 1, -1) for k in range(m - 1)]
        self.inv: list[np.ndarray] = []
        for k in range(m):
            d, own = np.eye(sizes[k]), part(k, 0)
            np.subtract.at(d, (inner[src[own]], inner[dst[own]]), w[own])
            if k:
                d -= self.low[k - 1].dot(self.up[k - 1].t.dot(self.inv[k - 1].T).T)
            self.inv.append(np.linalg.inv(d))

    def _run(self, b: np.ndarray, inv: list, low: list, up: list) -> np.ndarray:
        x = b[self.order].astype(float)
        part = [x[a:c] for a, c in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        for k in range(1, len(part)):
            part[k] = part[k] - low[k - 1].dot(inv[k - 1] @ part[k - 1])
        part[-1] = inv[-1] @ part[-1]
        for k in range(len(part) - 2, -1, -1):
            part[k] = inv[k] @ (part[k] - up[k].dot(part[k + 1]))
        out = np.empty_like(x)
        out[self.order] = np.concatenate(part)
        return out

    def solve(self, b: np.ndarray) -> np.ndarray:
        return self._run(b, self.inv, self.low, self.up)

    def solve_transposed(self, b: np.ndarray) -> np.ndarray:
        return self._run(b, [i.T for i in self.inv], [u.t for u in self.up], [x.t for x in self.low])


def solver(g: Graph) -> Solver:
    """The graph's factorisation, made once in a worker for all blocks of targets that it gets."""
    if "solver" not in g.__dict__:
        g.__dict__["solver"] = Solver(g.n, g.src, g.dst, g.w, g.col, *([] if g.row is None else [g.row]))
    return g.__dict__["solver"]


def fundamental(g: Graph, s: Solver, targets: np.ndarray) -> np.ndarray:
    """Columns of (I - W)^-1 at the targets."""
    unit = np.zeros((g.n, len(targets)))
    unit[targets, np.arange(len(targets))] = 1.0
    return s.solve(unit)


def own(x: np.ndarray, targets: np.ndarray) -> np.ndarray:
    return x[targets, np.arange(len(targets))]


def survival(z: np.ndarray, targets: np.ndarray) -> np.ndarray:
    return z / own(z, targets)


def free_energy(z: np.ndarray, targets: np.ndarray, theta: float) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return -np.log(survival(z, targets)) / theta + 0.0


def power_mean(z: np.ndarray, targets: np.ndarray, theta: float) -> np.ndarray:
    return survival(z, targets) ** (1.0 / theta)


def expected_cost(g: Graph, s: Solver, z: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Mean cost of the walks to each target; unreachable is infinite."""
    with np.errstate(all="ignore"):
        quotient = s.solve(edge_product(g, g.cost_weight, z)) / z
        quotient[np.isnan(quotient)] = np.inf
        return quotient - own(quotient, targets)


def _cost_weight(g: Graph) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.nan_to_num(g.cost, nan=0.0, posinf=np.inf) * g.w


Graph.cost_weight = property(_cost_weight)

DISTANCES = ("expected_cost", "free_energy_distance", "least_cost_distance")
PROXIMITIES = ("survival_probability", "power_mean_proximity")
MEASURES = DISTANCES + PROXIMITIES


def measure(g: Graph, name: str, s: Solver | None, z: np.ndarray | None, targets: np.ndarray) -> np.ndarray:
    """The n x k matrix of a connectivity function."""
    if name == "expected_cost":
        return expected_cost(g, s, z, targets)
    if name == "free_energy_distance":
        return free_energy(z, targets, g.theta)
    if name == "survival_probability":
        return survival(z, targets)
    if name == "power_mean_proximity":
        return power_mean(z, targets, g.theta)
    if name == "least_cost_distance":
        return np.stack([dijkstra(g, t)[0] for t in targets], axis=1) if len(targets) else np.zeros((g.n, 0))
    raise ValueError(f"unknown connectivity function {name!r}; there are {', '.join(MEASURES)}")


def proximity(g: Graph, name: str, s: Solver, z: np.ndarray, targets: np.ndarray, transform: Callable | None, diagonal: float | None) -> np.ndarray:
    """A connectivity function as a proximity: distances are transformed, proximities are not."""
    p = measure(g, name, s, z, targets)
    if name in DISTANCES:
        p = transform(p)
    if diagonal is not None:
        p = p.copy()
        p[targets, np.arange(len(targets))] = diagonal
    return p


# --- flow --------------------------------------------------------------------------------------


def _reciprocal(z: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        r = 1.0 / z
    return np.where(np.isfinite(r), r, LARGEST)


def _adjoint(g: Graph, s: Solver, z: np.ndarray, targets: np.ndarray, prox: np.ndarray | None) -> tuple[np.ndarray, float]:
    """(X, scale): the adjoint solution of the weights K / Z less each target's own total."""
    k = np.outer(g.qs, g.qt[targets])
    if prox is not None:
        k = k * prox
    scale = max(1.0, float(k.max(initial=0.0)))
    k = k / scale
    r = _reciprocal(z)
    m = k * r
    m[targets, np.arange(len(targets))] -= k.sum(0) * own(r, targets)
    return s.solve_transposed(m), scale


def node_flow(g: Graph, s: Solver, z: np.ndarray, targets: np.ndarray, prox: np.ndarray | None = None) -> np.ndarray:
    """Flow through each node from all sources to these targets; weights are qualities, times ``prox`` if given."""
    x, scale = _adjoint(g, s, z, targets, prox)
    return (z * x).sum(1) * scale


def edge_flow(g: Graph, s: Solver, z: np.ndarray, targets: np.ndarray, prox: np.ndarray | None = None) -> np.ndarray:
    """Flow over each edge."""
    x, scale = _adjoint(g, s, z, targets, prox)
    out = np.empty(len(g.src))
    for a in range(0, len(g.src), 65_536):  # edges x targets in bounded pieces
        e = slice(a, a + 65_536)
        out[e] = (z[g.dst[e]] * x[g.src[e]]).sum(1)
    return g.w * out * scale


# --- least cost --------------------------------------------------------------------------------


class Heap:
    """A binary heap of items by priority with decrease-key.

    Of equal priorities a child on the right rises first and nothing overtakes an equal parent; this fixes
    the order in which ties leave, and with it the trees of ``first_found_tree``.
    """

    def __init__(self):
        self.items: list[int] = []
        self.rank: dict[int, float] = {}
        self.place: dict[int, int] = {}

    def put(self, item: int, rank: float) -> None:
        if item not in self.place:
            self.place[item] = len(self.items)
            self.items.append(item)
        self.rank[item] = rank
        at = self.place[item]
        while at and rank < self.rank[self.items[up := (at - 1) // 2]]:
            self._set(at, self.items[up])
            at = up
        self._set(at, item)

    def pop(self) -> int:
        first, last = self.items[0], self.items.pop()
        del self.place[first]
        size = len(self.items)
        if size:
            at, rank = 0, self.rank[last]
            while (child := 2 * at + 1) < size:
                if child + 1 < size and not self.rank[self.items[child]] < self.rank[self.items[child + 1]]:
                    child += 1
                if not self.rank[self.items[child]] < rank:
                    break
                self._set(at, self.items[child])
                at = child
            self._set(at, last)
        return first

    def _set(self, at: int, item: int) -> None:
        self.items[at] = item
        self.place[item] = at


def first_found_tree(g: Graph, root: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """As ``dijkstra``, but of several parents the first one found with the least floating-point sum stays."""
    out = out_edges(g)
    dist, parent, order, heap = [np.inf] * g.n, [-1] * g.n, [], Heap()
    dist[root] = 0.0
    heap.put(root, 0.0)
    while heap.items:
        u = heap.pop()
        order.append(u)
        for v, c in out[u]:
            if (x := dist[u] + c) < dist[v]:
                dist[v], parent[v] = x, u
                heap.put(v, x)
    return np.array(dist), np.array(parent), order


def out_edges(g: Graph) -> list[list[tuple[int, float]]]:
    if "out" not in g.__dict__:
        begin = starts_of(g.src, g.n)
        g.__dict__["out"] = [list(zip(g.dst[a:b].tolist(), g.cost[a:b].tolist(), strict=True)) for a, b in zip(begin[:-1], begin[1:], strict=True)]
    return g.__dict__["out"]


def dijkstra(g: Graph, root: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(distance from the root to each node, parent, nodes in the order they are reached) by edge costs.

    Of several parents on least-cost paths (within 1e-12) the least node is taken.
    """
    out = out_edges(g)
    dist = [np.inf] * g.n
    parent, done, order = [-1] * g.n, [False] * g.n, []
    dist[root] = 0.0
    heap = [(0.0, root)]
    while heap:
        d, u = heapq.heappop(heap)
        if done[u]:
            continue
        done[u] = True
        order.append(u)
        for v, c in out[u]:
            if c != c or done[v]:
                continue
            x = d + c
            room = 1e-12 * max(1.0, x)
            if x < dist[v] - room:
                dist[v], parent[v] = x, u
                heapq.heappush(heap, (x, v))
            elif x <= dist[v] + room and u < parent[v]:
                parent[v] = u
    return np.array(dist), np.array(parent), order


def least_cost_kl(g: Graph, root: int, ties: str = "first") -> np.ndarray:
    """Sum of -log reference probability over the steps node -> parent of the least-cost tree; NaN if unreached.

    Where least-cost paths tie, the tree is that of the order of search (``first``) or takes the least node (``least``).
    """
    if ties not in ("first", "least"):
        raise ValueError("ties are 'first' or 'least'")
    _, parent, order = (first_found_tree if ties == "first" else dijkstra)(g, root)
    begin = starts_of(g.src, g.n)
    kl = np.full(g.n, np.nan)
    kl[root] = 0.0
    for v in order[1:]:
        p = parent[v]
        a, b = begin[v], begin[v + 1]
        at = a + np.searchsorted(g.dst[a:b], p)
        if at == b or g.dst[at] != p:
            kl[v] = np.inf  # the walk can't step back
            continue
        kl[v] = kl[p] - np.log(g.pref[at])
    return kl


def brandes(g: Graph, root: int) -> np.ndarray:
    """Dependencies of one source on each node over all shortest paths by cost (ties within 1e-12)."""
    out = out_edges(g)
    dist, sigma = np.full(g.n, np.inf), np.zeros(g.n)
    dist[root], sigma[root] = 0.0, 1.0
    before: list[list[int]] = [[] for _ in range(g.n)]
    done, order, heap = np.zeros(g.n, bool), [], [(0.0, root)]
    while heap:
        d, u = heapq.heappop(heap)
        if done[u]:
            continue
        done[u] = True
        order.append(u)
        for v, c in out[u]:
            if done[v]:
                continue
            x = d + c
            room = 1e-12 * max(1.0, x)
            if x < dist[v] - room:
                dist[v], sigma[v], before[v] = x, sigma[u], [u]
                heapq.heappush(heap, (x, v))
            elif x <= dist[v] + room:
                sigma[v] += sigma[u]
                before[v].append(u)
    delta = np.zeros(g.n)
    for v in reversed(order):
        for u in before[v]:
            delta[u] += sigma[u] / sigma[v] * (1.0 + delta[v])
    delta[root] = 0.0
    return delta


# --- Bellman-Ford form -------------------------------------------------------------------------


def sweep_distances(g: Graph, target: int, approx: bool = False, tol: float = 1e-8, most: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """(free energy, expected cost) to one target by sweeps of the soft-minimum equation.

    Nodes are updated in order of their least-cost distance from the target, those at equal distance
    together from the values before. ``approx`` stops after one sweep. Raises where a node has no finite way to the
    target, as in graphs that aren't strongly connected, and where ``most`` sweeps don't settle.
    """
    dist, _, order = dijkstra(g, target)
    begin = starts_of(g.src, g.n)
    phi, mean = np.full(g.n, np.inf), np.full(g.n, np.inf)
    phi[target] = mean[target] = 0.0
    groups: list[list[int]] = []
    for v in order:
        if v == target:
            continue
        if groups and dist[groups[-1][0]] == dist[v]:
            groups[-1].append(v)
        else:
            groups.append([v])
    theta = g.theta

    def update(v: int) -> tuple[float, float]:
        e = np.arange(begin[v], begin[v + 1])
        e = e[np.isfinite(phi[g.dst[e]]) & (g.pref[e] > 0)]
        if not len(e):
            raise ValueError(f"cell {g.cell[v]} has no successor with a finite distance to cell {g.cell[target]}")
        to, c, p = g.dst[e], g.cost[e], g.pref[e]
        if len(e) == 1:
            return float(c[0] + phi[to[0]] - np.log(p[0]) / theta), float(mean[to[0]] + c[0])
        energy = c + phi[to]
        least = energy.min()
        new = float(least - np.log((p * np.exp(theta * (least - energy))).sum()) / theta)
        if not np.isfinite(new):
            raise ValueError(f"the distance from cell {g.cell[v]} to cell {g.cell[target]} is not finite")
        q = p * np.exp(theta * (new - energy))
        return new, float((q * (c + mean[to])).sum())

    for sweep in range(most):
        old_phi, old_mean = phi.copy(), mean.copy()
        for group in groups:
            values = [update(v) for v in group]
            for v, (a, b) in zip(group, values, strict=True):
                phi[v], mean[v] = a, b
        if approx:
            break
        if sweep:
            ok = np.isfinite(phi) & np.isfinite(old_phi)
            change = [np.abs(x[ok] - y[ok]).max(initial=0.0) / max(x[ok].max(initial=0.0), 1e-300) for x, y in ((phi, old_phi), (mean, old_mean))]
            if max(change) < tol:
                break
    else:
        raise RuntimeError(f"distances to cell {g.cell[target]} did not settle in {most} sweeps")
    return phi, mean


# --- strong components -------------------------------------------------------------------------


def strong_components(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The least node of each node's strong component, by an iterative depth-first search."""
    by = np.argsort(src, kind="stable")
    begin, to = starts_of(src[by], n), dst[by].tolist()
    index, low = [-1] * n, [0] * n
    on, label = [False] * n, np.full(n, -1)
    stack: list[int] = []
    count = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, int(begin[root]))]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        on[root] = True
        while work:
            v, at = work[-1]
            if at < begin[v + 1]:
                work[-1] = (v, at + 1)
                u = to[at]
                if index[u] < 0:
                    index[u] = low[u] = count
                    count += 1
                    stack.append(u)
                    on[u] = True
                    work.append((u, int(begin[u])))
                elif on[u]:
                    low[v] = min(low[v], index[u])
                continue
            work.pop()
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[v])
            if low[v] == index[v]:
                members = []
                while True:
                    u = stack.pop()
                    on[u] = False
                    members.append(u)
                    if u == v:
                        break
                label[members] = min(members)
    return label
