"""The randomized-shortest-path model: distances, proximities, flows, habitat, divergences, spectrum.

The graph is broadcast (its size is checked by ``Landscape.arrays``); blocks of targets, or cells, are
dealt to tasks. A task solves for its block and emits either pairs or sums over its block, so that only
node-sized partial results are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landweave.functions import transforms
from landweave.operators import kernels
from landweave.operators.landscape import Landscape

BLOCK = 64
SMALLEST = float(np.finfo(float).tiny)


def dealt(spark: SparkSession, graph: kernels.Graph, count: int, size: int, work: Callable[[kernels.Graph, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``work(graph, positions)`` for blocks of ``size`` of the numbers below ``count``, a task each or several."""
    shared = spark.sparkContext.broadcast(graph)
    blocks = max(1, -(-count // size))
    tasks = min(blocks, max(1, spark.sparkContext.defaultParallelism * 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("id").to_pylist():
                at = np.arange(k * size, min((k + 1) * size, count))
                if len(at):
                    yield from work(shared.value, at).to_batches(max_chunksize=100_000)

    return spark.range(0, blocks, 1, tasks).mapInArrow(run, schema)


def _long(g: kernels.Graph, targets: np.ndarray, values: np.ndarray) -> pa.Table:
    return pa.table({"node": np.tile(g.cell, len(targets)), "target": np.repeat(g.cell[targets], g.n), "value": values.T.ravel()})


PAIRS = "node long, target long, value double"


def pairs(land: Landscape, f: Callable[[kernels.Graph, int], np.ndarray], theta: float | None = None) -> DataFrame:
    """node, target, value of a function of one target."""
    g = land.arrays if theta is None else replace(land.arrays, theta=theta)

    def work(g: kernels.Graph, at: np.ndarray) -> pa.Table:
        targets = g.targets[at]
        return _long(g, targets, np.stack([f(g, t) for t in targets], axis=1))

    return dealt(land.spark, g, len(g.targets), 8, work, PAIRS)


class RspModel:
    """A landscape at a temperature."""

    def __init__(self, landscape: Landscape, theta: float):
        if theta is None:
            raise ValueError("theta is needed")
        self.landscape, self.theta = landscape, float(theta)
        self.spark = landscape.spark

    def __repr__(self) -> str:
        return f"RspModel at theta {self.theta} of a {self.landscape!r}"

    def _repr_html_(self) -> str:
        return f"<h4>{self!r}</h4>"

    # --- the walk as tables ------------------------------------------------------------------

    @cached_property
    def walk(self) -> DataFrame:
        """src, dst, affinity, cost, pref, w."""
        share = F.col("affinity") / F.sum("affinity").over(Window.partitionBy("src"))
        cost = F.coalesce("cost", F.lit(0.0))
        return self.landscape.edges.withColumn("pref", share).withColumn("w", F.nanvl(F.col("pref") * F.exp(-self.theta * cost), F.lit(0.0)))

    @cached_property
    def graph(self) -> kernels.Graph:
        g = self.landscape.arrays
        return replace(g, theta=self.theta, w=kernels.boltzmann(g.pref, g.cost, self.theta))

    # --- pairs -------------------------------------------------------------------------------

    def _pairs(self, f: Callable) -> DataFrame:
        def work(g: kernels.Graph, at: np.ndarray) -> pa.Table:
            targets = g.targets[at]
            s = kernels.solver(g)
            z = kernels.fundamental(g, s, targets)
            return _long(g, targets, f(g, s, z, targets))

        return dealt(self.spark, self.graph, len(self.graph.targets), BLOCK, work, PAIRS)

    def fundamental_matrix(self) -> DataFrame:
        """node, target, value of (I - W)^-1 in the targets' columns."""
        return self._pairs(lambda g, s, z, t: z)

    def _measure(self, name: str) -> DataFrame:
        return self._pairs(lambda g, s, z, t: kernels.measure(g, name, s, z, t))

    def expected_cost(self) -> DataFrame:
        return self._measure("expected_cost")

    def free_energy_distance(self) -> DataFrame:
        return self._measure("free_energy_distance")

    def survival_probability(self) -> DataFrame:
        return self._measure("survival_probability")

    def power_mean_proximity(self) -> DataFrame:
        return self._measure("power_mean_proximity")

    def least_cost_distance(self) -> DataFrame:
        return self.landscape.least_cost_distance()

    def underflow(self) -> bool:
        """Whether some entry of the fundamental matrix is 0 or below double precision."""
        return bool(self.fundamental_matrix().agg(F.min("value")).first()[0] < SMALLEST)

    def _transform(self, connectivity: str, transform) -> Callable | None:
        if connectivity not in kernels.MEASURES:
            raise ValueError(f"unknown connectivity function {connectivity!r}")
        if connectivity in kernels.PROXIMITIES:
            return None
        if transform is None:
            if self.landscape.cost_name is None:
                raise ValueError("no transformation to proximities is given, and none follows from a cost table")
            transform = transforms.inverse(self.landscape.cost_name)
        return transforms.array_form(transform)

    def _cell(self, row: int, col: int) -> int:
        nrows, ncols = self.landscape.size
        if not (1 <= row <= nrows and 1 <= col <= ncols):
            raise ValueError(f"({row}, {col}) is outside the grid")
        return (col - 1) * nrows + row

    # --- flow --------------------------------------------------------------------------------

    def _flow(self, edge: bool, connectivity: str | None, transform, diagonal: float | None) -> DataFrame:
        change = self._transform(connectivity, transform) if connectivity else None

        def work(g: kernels.Graph, at: np.ndarray) -> pa.Table:
            targets = g.targets[at]
            s = kernels.solver(g)
            z = kernels.fundamental(g, s, targets)
            prox = kernels.proximity(g, connectivity, s, z, targets, change, diagonal) if connectivity else None
            if edge:
                return pa.table({"src": g.cell[g.src], "dst": g.cell[g.dst], "value": kernels.edge_flow(g, s, z, targets, prox)})
            return pa.table({"cell": g.cell, "value": kernels.node_flow(g, s, z, targets, prox)})

        keys = ["src", "dst"] if edge else ["cell"]
        part = dealt(self.spark, self.graph, len(self.graph.targets), BLOCK, work, "src long, dst long, value double" if edge else "cell long, value double")
        total = part.groupBy(*keys).agg(F.sum("value").alias("value"))
        return total if edge else self.landscape.canvas(total)

    def betweenness_qweighted(self) -> DataFrame:
        """row, col, value: flow through each cell, weighted by qualities."""
        return self._flow(False, None, None, None)

    def betweenness_kweighted(self, connectivity: str = "expected_cost", transform=None, diagonal: float | None = None) -> DataFrame:
        """The same, weighted by qualities and proximity."""
        return self._flow(False, connectivity, transform, diagonal)

    def edge_betweenness_qweighted(self) -> DataFrame:
        """src, dst, value."""
        return self._flow(True, None, None, None)

    def edge_betweenness_kweighted(self, transform=None, diagonal: float | None = None) -> DataFrame:
        return self._flow(True, "expected_cost", transform, diagonal)

    # --- habitat -----------------------------------------------------------------------------

    def connected_habitat(self, connectivity: str = "expected_cost", transform=None, diagonal: float | None = None) -> DataFrame:
        """row, col, value: quality of each cell times the quality it is connected to."""
        change = self._transform(connectivity, transform)

        def work(g: kernels.Graph, at: np.ndarray) -> pa.Table:
            targets = g.targets[at]
            s = kernels.solver(g)
            prox = kernels.proximity(g, connectivity, s, kernels.fundamental(g, s, targets), targets, change, diagonal)
            return pa.table({"cell": g.cell, "value": g.qs * (prox @ g.qt[targets])})

        part = dealt(self.spark, self.graph, len(self.graph.targets), BLOCK, work, "cell long, value double")
        return self.landscape.canvas(part.groupBy("cell").agg(F.sum("value").alias("value")))

    def habitat_of(self, proximities: DataFrame, diagonal: float | None = None) -> DataFrame:
        return self.landscape.habitat_of(proximities, diagonal)

    def _degraded(self, cells: list[int] | None, transform, diagonal, avalue: float, qs_value: float, qt_value: float) -> DataFrame:
        """cell, node, value: the habitat of every node after one of ``cells`` is degraded; or, where it is None, cell, after: the total of each target cell.

        Each cell is factorised anew: with a low-rank update of one factorisation the tiny entries of a closed cell
        would be differences of large ones.
        """
        if not avalue > 0:
            raise ValueError("the affinity of a degraded cell must be positive")
        change = self._transform("expected_cost", transform)
        cost = transforms.named(self.landscape.cost_name).array if self.landscape.cost_name else None
        g = self.graph
        which = g.targets if cells is None else np.searchsorted(g.cell, cells)
        if cells is not None and not np.isin(which, g.targets).all():
            raise ValueError("only targets can be degraded")
        total = cells is None

        def work(g: kernels.Graph, at: np.ndarray) -> pa.Table:
            out = []
            for c in which[at]:
                got = habitat(degrade(g, c, cost, avalue, qs_value, qt_value), change, diagonal)
                out.append(pa.table({"cell": [g.cell[c]], "after": [float(got.sum())]}) if total else pa.table({"cell": np.full(g.n, g.cell[c]), "node": g.cell, "value": got}))
            return pa.concat_tables(out)

        return dealt(self.spark, g, len(which), 4, work, "cell long, after double" if total else "cell long, node long, value double")

    def connected_habitat_degraded(self, row: int, col: int, transform=None, diagonal: float | None = None, avalue: float = SMALLEST, qs_value: float = 0.0, qt_value: float = 0.0) -> DataFrame:
        """The habitat canvas after one cell is degraded: its edges nearly closed, its qualities replaced."""
        cell = self._cell(row, col)
        if cell not in self.graph.cell[self.graph.targets]:
            raise ValueError(f"({row}, {col}) is no target")
        found = self._degraded([cell], transform, diagonal, avalue, qs_value, qt_value)
        return self.landscape.canvas(found.select(F.col("node").alias("cell"), "value"))

    def criticality(self, transform=None, diagonal: float | None = None, avalue: float = SMALLEST, qs_value: float = 0.0, qt_value: float = 0.0, strict_nan: bool = False) -> DataFrame:
        """row, col, value: the loss of total habitat when a cell is degraded, for every target cell.

        Totals are over active cells. With ``strict_nan`` an inactive cell anywhere makes all values NaN.
        """
        change = self._transform("expected_cost", transform)
        part = lambda g, at: pa.table({"value": [float(habitat(replace(g, targets=g.targets[at]), change, diagonal).sum())]})
        base = dealt(self.spark, self.graph, len(self.graph.targets), BLOCK, part, "value double").agg(F.sum("value").alias("base"))
        if strict_nan and self.graph.n < self.landscape.nrows * self.landscape.ncols:
            base = base.select(F.lit(float("nan")).alias("base"))
        after = self._degraded(None, transform, diagonal, avalue, qs_value, qt_value)
        return self.landscape.canvas(after.crossJoin(base).select("cell", (F.col("base") - F.col("after")).alias("value")))  # the base is one row

    # --- divergences -------------------------------------------------------------------------

    def mean_kl_divergence(self) -> DataFrame:
        """One row: theta times the quality-weighted sum of free energy less expected cost."""
        def work(g: kernels.Graph, at: np.ndarray) -> pa.Table:
            targets = g.targets[at]
            s = kernels.solver(g)
            z = kernels.fundamental(g, s, targets)
            gap = kernels.free_energy(z, targets, g.theta) - kernels.expected_cost(g, s, z, targets)
            return pa.table({"value": [float(g.theta * (g.qs @ gap @ g.qt[targets]))]})

        return dealt(self.spark, self.graph, len(self.graph.targets), BLOCK, work, "value double").agg(F.sum("value").alias("value"))

    def least_cost_kl(self, ties: str = "first") -> DataFrame:
        """node, target, value of the divergence of the least-cost path from the reference walk."""
        return pairs(self.landscape, lambda g, t: kernels.least_cost_kl(g, t, ties))

    def least_cost_kl_divergence(self, row: int, col: int, ties: str = "first") -> DataFrame:
        """The canvas of that divergence to one cell."""
        cell = self._cell(row, col)
        g = self.landscape.arrays
        at = int(np.searchsorted(g.cell, cell))
        if at == g.n or g.cell[at] != cell:
            raise ValueError(f"({row}, {col}) is not an active cell")
        found = dealt(self.spark, g, 1, 1, lambda g, _: _long(g, np.array([at]), kernels.least_cost_kl(g, at, ties)[:, None]), PAIRS)
        return self.landscape.canvas(found.select(F.col("node").alias("cell"), "value"))

    def mean_lc_kl_divergence(self, ties: str = "first") -> DataFrame:
        """One row: the quality-weighted sum over sources and targets."""
        def work(g: kernels.Graph, at: np.ndarray) -> pa.Table:
            return pa.table({"value": [float(sum(g.qt[t] * np.nansum(g.qs * kernels.least_cost_kl(g, t, ties)) for t in g.targets[at]))]})

        g = self.landscape.arrays
        return dealt(self.spark, g, len(g.targets), 8, work, "value double").agg(F.sum("value").alias("value"))

    # --- spectrum ----------------------------------------------------------------------------

    def proximities(self, connectivity: str = "expected_cost", transform=None, diagonal: float | None = None) -> DataFrame:
        """node, target, value."""
        change = self._transform(connectivity, transform)
        return self._pairs(lambda g, s, z, t: kernels.proximity(g, connectivity, s, z, t, change, diagonal))

    def quality_scaled(self, **options) -> DataFrame:
        """node, target, qs * proximity * qt."""
        node, target = self._qualities()
        found = self.proximities(**options).join(node, "node").join(target, "target")
        return found.select("node", "target", (F.col("qs") * F.col("value") * F.col("qt")).alias("value"))

    def _qualities(self) -> tuple[DataFrame, DataFrame]:
        nodes = self.landscape.nodes
        return nodes.select(F.col("cell").alias("node"), "qs"), nodes.where("is_target").select(F.col("cell").alias("target"), F.coalesce("qt", F.lit(0.0)).alias("qt"))

    def eigmax_value(self, *args, **options) -> float:
        return self.eigmax(*args, **options)[1]

    def eigmax_left(self, *args, **options) -> DataFrame:
        return self.eigmax(*args, **options)[0]

    def eigmax_right(self, *args, **options) -> DataFrame:
        return self.eigmax(*args, **options)[2]

    def eigmax(self, connectivity: str = "expected_cost", transform=None, diagonal: float | None = None, tol: float = 1e-14) -> tuple[DataFrame, float, DataFrame]:
        """(left, value, right): the dominant eigenvalue of the quality-scaled proximities and its vectors (cell, value).

        Columns off the targets are zero, so the value and the vectors' target entries come from the
        target rows alone. The right vector has length 1, the left one 1 at the first target.
        """
        g = self.graph
        change = self._transform(connectivity, transform)

        def scaled(g: kernels.Graph, at: np.ndarray) -> np.ndarray:
            targets = g.targets[at]
            s = kernels.solver(g)
            p = kernels.proximity(g, connectivity, s, kernels.fundamental(g, s, targets), targets, change, diagonal)
            return g.qs[:, None] * p * g.qt[targets]

        def inside(g: kernels.Graph, at: np.ndarray) -> pa.Table:
            return pa.table({"target": g.targets[at], "column": list(scaled(g, at)[g.targets].T)})

        rows = dealt(self.spark, g, len(g.targets), BLOCK, inside, "target long, column array<double>")
        # k columns of k numbers: a check of the table form, for few targets
        found = {r["target"]: np.array(r["column"]) for r in rows.toLocalIterator()}
        inner = np.stack([found[t] for t in g.targets], axis=1)
        value, v0 = dominant(inner, tol)
        _, u0 = dominant(inner.T, tol)
        left = np.zeros(g.n)
        left[g.targets] = u0 / u0[0] if u0[0] else u0
        part = dealt(self.spark, g, len(g.targets), BLOCK, lambda g, at: pa.table({"cell": g.cell, "value": scaled(g, at) @ v0[at]}), "cell long, value double")
        right = part.groupBy("cell").agg((F.sum("value") / value).alias("value"))
        length = float(right.agg(F.sqrt(F.sum(F.col("value") * F.col("value")))).first()[0])
        return self.spark.createDataFrame(pa.table({"cell": g.cell, "value": left})), value, right.withColumn("value", F.col("value") / length)


def dominant(a: np.ndarray, tol: float, rounds: int = 2000) -> tuple[float, np.ndarray]:
    """(value, vector) of the Perron root of a non-negative matrix, by power iteration or else all eigenvalues."""
    v, value = np.ones(len(a)), 0.0
    for _ in range(rounds):
        moved = a @ v
        now = float(np.abs(moved).max())
        if not now:
            break
        moved /= now
        if abs(now - value) <= tol * now and np.abs(moved - v).max() <= 1e-12:
            return now, moved
        v, value = moved, now
    values, vectors = np.linalg.eig(a)
    k = int(np.argmax(values.real))
    return float(values[k].real), np.abs(vectors[:, k].real)


def habitat(g: kernels.Graph, change: Callable | None, diagonal: float | None, connectivity: str = "expected_cost") -> np.ndarray:
    """The habitat of every node, targets taken in blocks."""
    s = kernels.solver(g)
    out = np.zeros(g.n)
    for a in range(0, len(g.targets), 4 * BLOCK):
        targets = g.targets[a : a + 4 * BLOCK]
        prox = kernels.proximity(g, connectivity, s, kernels.fundamental(g, s, targets), targets, change, diagonal)
        out += g.qs * (prox @ g.qt[targets])
    return out


def degrade(g: kernels.Graph, node: int, cost: Callable | None, avalue: float, qs_value: float, qt_value: float) -> kernels.Graph:
    """The graph with one node degraded; costs follow where they are a function of affinities."""
    hit = (g.src == node) | (g.dst == node)
    affinity = np.where(hit, avalue, g.affinity)
    costs = g.cost if cost is None else np.where(hit, cost(affinity), g.cost)
    qs, qt = g.qs.copy(), g.qt.copy()
    qs[node], qt[node] = qs_value, qt_value
    pref = kernels.reference_walk(g.n, g.src, affinity)
    return replace(g, affinity=affinity, cost=costs, pref=pref, w=kernels.boltzmann(pref, costs, g.theta), qs=qs, qt=qt)


# --- composites ---------------------------------------------------------------------------------


def theta_sweep(land: Landscape, thetas: list[float]) -> DataFrame:
    """theta, row, col, value: quality-weighted flow at several temperatures, all in one job."""
    g = land.arrays
    k = len(g.targets)
    per = max(1, -(-k // BLOCK))

    def work(g: kernels.Graph, at: np.ndarray) -> pa.Table:
        out = []
        for j in at:
            theta, block = thetas[j // per], j % per
            h = replace(g, theta=theta, w=kernels.boltzmann(g.pref, g.cost, theta))
            s = kernels.solver(h)
            targets = h.targets[block * BLOCK : (block + 1) * BLOCK]
            out.append(pa.table({"theta": np.full(h.n, float(theta)), "cell": h.cell, "value": kernels.node_flow(h, s, kernels.fundamental(h, s, targets), targets)}))
        return pa.concat_tables(out)

    flows = dealt(land.spark, g, per * len(thetas), 1, work, "theta double, cell long, value double").groupBy("theta", "cell").agg(F.sum("value").alias("value"))
    cells = land.nodes.select("cell", "row", "col")
    return flows.join(cells, "cell").select("theta", "row", "col", "value")


def calibrate(land: Landscape, target: float, low: float = 1e-3, high: float = 3.0, rounds: int = 20) -> tuple[float, float]:
    """(theta, divergence) with the squared gap of the KL divergence to ``target`` least, by golden sections."""
    def gap(theta: float) -> tuple[float, float]:
        kl = float(RspModel(land, theta).mean_kl_divergence().first()[0])
        return (kl - target) ** 2, kl

    ratio = (5**0.5 - 1) / 2
    a, b = low, high
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = gap(c), gap(d)
    for _ in range(rounds):
        if fc[0] < fd[0]:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = gap(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = gap(d)
    return (c, fc[1]) if fc[0] < fd[0] else (d, fd[1])


def coarseness_sweep(land: Landscape, theta: float, sizes: list[int], measure: str = "connected_habitat", kind: type | None = None, **options) -> DataFrame:
    """npix, ratio (total over the full model's), correlation with the full model's canvas."""
    kind = kind or RspModel
    full = getattr(kind(land, theta), measure)(**options).withColumnRenamed("value", "full")
    out = None
    for p in sizes:
        part = getattr(kind(land.with_landmarks(p), theta), measure)(**options).join(full, ["row", "col"]).where("value is not null and full is not null")
        one = part.agg(F.lit(p).alias("npix"), (F.sum("value") / F.sum("full")).alias("ratio"), F.corr("value", "full").alias("correlation"))
        out = one if out is None else out.unionByName(one)
    return out


def underestimation(part: Column, whole: Column) -> Column:
    """How far ``part`` falls short of ``whole``, in percent."""
    return (1 - part / whole) * 100


def brandes(land: Landscape) -> DataFrame:
    """row, col, value: classical shortest-path betweenness, each unordered pair counted once.

    Costs must be the same in both directions.
    """
    land.check_symmetric()
    g = land.arrays
    part = dealt(land.spark, g, g.n, 16, lambda g, at: pa.table({"cell": g.cell, "value": sum(kernels.brandes(g, int(s)) for s in at)}), "cell long, value double")
    return land.canvas(part.groupBy("cell").agg((F.sum("value") / 2).alias("value")))


def floyd_warshall(land: Landscape) -> DataFrame:
    """node, target, value: least costs between all cells of the undirected view; costs must be the same in both directions."""
    land.check_symmetric()
    every = Landscape(land.spark, land.nrows, land.ncols, land.edges, land.nodes.withColumn("is_target", F.lit(True)), land.qs, land.qt, False, land.cost_name)
    return every.least_cost_distance()


def unwrapped(model) -> Landscape:
    """The landscape of a model, or the landscape itself."""
    return getattr(model, "landscape", model)


def kl_percentage(kl: Column, largest: Column) -> Column:
    return kl / largest * 100
