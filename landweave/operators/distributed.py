"""The randomized-shortest-path model as tables: no graph in a task or on the driver.

Solves go through the separator tree of ``dissection``; ``method="series"`` sums ``graph.series`` instead, whose tables of powers
grow to all pairs of nodes that reach each other: it is a check of the tree, and the way for graphs whose edges don't stay near.
Least costs, and the trees and divergences that follow from them, come from ``tiles``.

Pairs whose entry of the fundamental matrix is below double precision have no row: their survival is 0, their distance
infinite, and they add nothing to habitats and flows.
"""

from __future__ import annotations

import math
import sys
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landweave.functions import transforms
from landweave.operators import graph, kernels, spectrum
from landweave.operators.dissection import TILE, Dissection, blocks
from landweave.operators.landscape import Landscape
from landweave.operators.tiles import SAME, Tiles
from landweave.plans.stages import written

#: Flows divide by entries of the fundamental matrix and multiply by them again; these are held times this, so that weights over the smallest ones don't overflow.
RAISED = 2.0**100


def reference_walk(land: Landscape, theta: float) -> DataFrame:
    """src, dst, affinity, cost, pref, w: each edge's share of its source's affinity, and that times exp(-theta cost)."""
    share = F.col("affinity") / F.sum("affinity").over(Window.partitionBy("src"))
    cost = F.coalesce("cost", F.lit(0.0))
    return land.edges.withColumn("pref", share).withColumn("w", F.nanvl(F.col("pref") * F.exp(-theta * cost), F.lit(0.0)))


class DistributedModel:
    """A landscape at a temperature, as tables."""

    def __init__(self, landscape: Landscape, theta: float, tol: float = 1e-8, method: str = "dissection", tile: int = TILE):
        if method not in ("dissection", "series"):
            raise ValueError("the method is 'dissection' or 'series'")
        self.landscape, self.theta, self.tol, self.method, self.tile = landscape, float(theta), tol, method, tile

    @cached_property
    def walk(self) -> DataFrame:
        """src, dst, cost, w of the steps that can be taken."""
        steps = reference_walk(self.landscape, self.theta).where("w > 0").select("src", "dst", F.coalesce("cost", F.lit(0.0)).alias("cost"), "w")
        return written(steps, "walk")

    @cached_property
    def _powers(self) -> graph.Powers:
        return graph.Powers(self.walk)

    @cached_property
    def _tree(self) -> Dissection:
        return Dissection(self.walk.select("src", "dst", "w"), *self.landscape.size, self.tile)

    def _solve(self, start: DataFrame, transposed: bool = False) -> DataFrame:
        if self.method == "series":
            return graph.series(self._powers, start, tol=self.tol, transposed=transposed)
        return self._tree.solve(start, transposed)

    @cached_property
    def z(self) -> DataFrame:
        """node, target, value of the fundamental matrix in the targets' columns."""
        cells = self.landscape.targets().select(F.col("cell").alias("node"), F.col("cell").alias("target"), F.lit(1.0).alias("value"))
        return written(self._solve(cells).where("value > 0"), "z")

    def fundamental_matrix(self) -> DataFrame:
        return self.z

    def _own(self, pairs: DataFrame) -> DataFrame:
        return pairs.where("node = target").select("target", F.col("value").alias("own"))

    def __repr__(self) -> str:
        return f"DistributedModel at theta {self.theta} of a {self.landscape!r}"

    def underflow(self) -> bool:
        """Whether some entry of the fundamental matrix is 0 (and so has no row) or below double precision."""
        nodes = self.landscape.nodes
        least, count = self.z.agg(F.min("value"), F.count(F.lit(1))).first()
        return count < nodes.count() * nodes.where("is_target").count() or least < sys.float_info.min

    def survival_probability(self) -> DataFrame:
        return self.z.join(self._own(self.z), "target").select("node", "target", (F.col("value") / F.col("own")).alias("value"))

    def power_mean_proximity(self) -> DataFrame:
        return self.survival_probability().withColumn("value", F.pow("value", F.lit(1.0 / self.theta)))

    def free_energy_distance(self) -> DataFrame:
        return self.survival_probability().withColumn("value", -F.ln("value") / self.theta + 0.0)

    @cached_property
    def _quotient(self) -> DataFrame:
        steps = self.walk.select("src", F.col("dst").alias("node"), (F.col("cost") * F.col("w")).alias("cw"))
        moved = steps.join(self.z.hint("merge"), "node").groupBy("src", "target").agg(F.sum(F.col("cw") * F.col("value")).alias("value"))
        solved = self._solve(moved.select(F.col("src").alias("node"), "target", "value")).withColumnRenamed("value", "cost")
        both = self.z.join(solved.hint("merge"), ["node", "target"], "left")
        return written(both.select("node", "target", (F.coalesce("cost", F.lit(0.0)) / F.col("value")).alias("value")), "quotient")

    def expected_cost(self) -> DataFrame:
        return self._quotient.join(self._own(self._quotient), "target").select("node", "target", (F.col("value") - F.col("own")).alias("value"))

    def proximities(self, connectivity: str = "expected_cost", transform=None, diagonal: float | None = None) -> DataFrame:
        if connectivity not in kernels.MEASURES:
            raise ValueError(f"unknown connectivity function {connectivity!r}")
        found = getattr(self, connectivity)()
        if connectivity in kernels.DISTANCES:
            if transform is None and self.landscape.cost_name is None:
                raise ValueError("no transformation to proximities is given, and none follows from a cost table")
            found = found.withColumn("value", transforms.column_form(transform or transforms.inverse(self.landscape.cost_name))(F.col("value")))
        if diagonal is not None:
            found = found.withColumn("value", F.when(F.col("node") == F.col("target"), F.lit(float(diagonal))).otherwise(F.col("value")))
        return found

    def connected_habitat(self, connectivity: str = "expected_cost", transform=None, diagonal: float | None = None) -> DataFrame:
        """row, col, value."""
        return self.landscape.habitat_of(self.proximities(connectivity, transform, diagonal))

    def habitat_of(self, proximities: DataFrame, diagonal: float | None = None) -> DataFrame:
        return self.landscape.habitat_of(proximities, diagonal)

    def quality_scaled(self, **options) -> DataFrame:
        """node, target, qs * proximity * qt."""
        nodes = self.landscape.nodes
        target = nodes.where("is_target").select(F.col("cell").alias("target"), F.coalesce("qt", F.lit(0.0)).alias("qt"))
        found = self.proximities(**options).join(nodes.select(F.col("cell").alias("node"), "qs").hint("merge"), "node").join(target, "target")
        return found.select("node", "target", (F.col("qs") * F.col("value") * F.col("qt")).alias("value"))

    def degraded(self, row: int, col: int, affinity: float = sys.float_info.min, qs: float = 0.0, qt: float = 0.0) -> DistributedModel:
        """The model after one target cell is degraded: its edges nearly closed, its qualities replaced; nothing is pruned.

        Costs follow from the new affinities where they are a function of these.
        """
        land = self.landscape
        if not affinity > 0:
            raise ValueError("the affinity of a degraded cell must be positive")
        here = (F.col("row") == row) & (F.col("col") == col)
        if land.nodes.where(here & F.col("is_target")).isEmpty():
            raise ValueError(f"({row}, {col}) is no target")
        cell = (col - 1) * land.nrows + row
        hit = (F.col("src") == cell) | (F.col("dst") == cell)
        edges = land.edges.withColumn("affinity", F.when(hit, F.lit(float(affinity))).otherwise(F.col("affinity")))
        if land.cost_name is not None:
            edges = edges.withColumn("cost", F.when(hit, transforms.named(land.cost_name).column(F.col("affinity"))).otherwise(F.col("cost")))
        put = lambda c, v: F.when(here, F.lit(float(v))).otherwise(F.col(c))
        nodes = land.nodes.withColumns({"qs": put("qs", qs), "qt": put("qt", qt)})
        other = Landscape(land.spark, land.nrows, land.ncols, edges, nodes, land.qs, land.qt, land.landmarks, land.cost_name)
        return DistributedModel(other, self.theta, self.tol, self.method, self.tile)

    def connected_habitat_degraded(self, row: int, col: int, transform=None, diagonal: float | None = None, **values) -> DataFrame:
        """The habitat canvas after one cell is degraded."""
        return self.degraded(row, col, **values).connected_habitat("expected_cost", transform, diagonal)

    def _adjoint(self, weights: DataFrame | None) -> DataFrame:
        """node, target, z, x: the adjoint solution of the weights over z less each target's own total; z is ``RAISED``, x lowered by as much."""
        nodes = self.landscape.nodes
        qs = nodes.select(F.col("cell").alias("node"), "qs")
        qt = nodes.where("is_target").select(F.col("cell").alias("target"), F.coalesce("qt", F.lit(0.0)).alias("qt"))
        z = self.z.where(F.col("value") >= sys.float_info.min).withColumn("value", F.col("value") * RAISED)
        k = z.join(qs.hint("merge"), "node").join(qt, "target").withColumn("k", F.col("qs") * F.col("qt"))
        if weights is not None:
            k = k.join(weights.withColumnRenamed("value", "p").hint("merge"), ["node", "target"]).withColumn("k", F.col("k") * F.col("p"))
        k = written(k.where("k > 0").select("node", "target", "k", "value"), "weights")
        less = k.groupBy("target").agg(F.sum("k").alias("k")).join(self._own(z), "target")
        plus = k.select("node", "target", (F.col("k") / F.col("value")).alias("value"))
        minus = less.select(F.col("target").alias("node"), "target", (F.col("k") / F.col("own")).alias("value"))
        if self.method == "series":  # which takes what isn't negative
            both = self._solve(plus, transposed=True).withColumnRenamed("value", "plus").join(self._solve(minus, transposed=True).withColumnRenamed("value", "minus").hint("merge"), ["node", "target"], "full_outer")
            x = both.select("node", "target", (F.coalesce("plus", F.lit(0.0)) - F.coalesce("minus", F.lit(0.0))).alias("x"))
        else:
            both = plus.unionByName(minus.withColumn("value", -F.col("value"))).groupBy("node", "target").agg(F.sum("value").alias("value"))
            x = self._solve(both, transposed=True).withColumnRenamed("value", "x")
        return x.join(z.withColumnRenamed("value", "z").hint("merge"), ["node", "target"], "full_outer")

    def _flow(self, survival: bool, diagonal: float | None) -> DataFrame:
        """cell, value: the flow of ``betweenness``, with a row for each cell and block of targets instead of one for each pair.

        A cell's entries for all targets of a block are one array, so that a solve takes and gives one row for each cell.
        """
        nodes, parts = self.landscape.nodes, None
        quality = nodes.where("is_target").select(F.col("cell").alias("target"), F.coalesce("qt", F.lit(0.0)).alias("qt"))
        for mine, width in blocks(self._targets()):
            unit = mine.select(F.col("target").alias("cell"), F.array("n").alias("at"), F.array(F.lit(1.0)).alias("values"))
            raised = F.expr(f"transform(values, v -> if(v < {sys.float_info.min!r}D, 0D, v * {RAISED!r}D))")
            solved = self._tree.columns(unit, width).select("cell", raised.alias("z"))
            marks = mine.select(F.col("target").alias("cell"), F.col("n").alias("here"))
            z = written(solved.join(nodes.select("cell", "qs").hint("merge"), "cell").join(F.broadcast(marks), "cell", "left"), "z")
            ordered = lambda c: F.array_sort(F.collect_list(F.struct("n", c)))[c].alias(f"all_{c}")
            own = z.where("here is not null").select(F.col("here").alias("n"), F.expr("z[here]").alias("own"))
            sizes = written(quality.join(F.broadcast(mine), "target").join(own, "n").agg(ordered("own"), ordered("qt")), "sizes")  # one row
            # by position: k = qs * qt * proximity of the pairs whose entry isn't 0
            near = "v / all_own[i]" if survival else "1D"
            if diagonal is not None:
                near = f"if(i <=> here, {float(diagonal)!r}D, {near})"
            weights = F.expr(f"transform(z, (v, i) -> if(v > 0 and qs * all_qt[i] * ({near}) > 0, qs * all_qt[i] * ({near}), 0D))")
            k = z.crossJoin(F.broadcast(sizes)).withColumn("k", weights)
            plus = k.select("cell", F.lit(None).cast("array<int>").alias("at"), F.expr("zip_with(k, z, (a, v) -> if(a > 0, a / v, 0D))").alias("values"))
            total = k.select(F.posexplode("k").alias("n", "k")).groupBy("n").agg(F.sum("k").alias("k"))
            minus = total.join(own, "n").join(mine, "n").select(F.col("target").alias("cell"), F.array("n").alias("at"), F.array(-F.col("k") / F.col("own")).alias("values"))
            x = self._tree.columns(plus.unionByName(minus), width, transposed=True)
            both = F.expr("aggregate(zip_with(values, z, (a, v) -> if(a = 0 or v = 0, 0D, a * v)), 0D, (s, y) -> s + y)")
            part = x.join(z.hint("merge"), "cell").select("cell", both.alias("value"))
            parts = part if parts is None else parts.unionByName(part).groupBy("cell").agg(F.sum("value").alias("value"))
        return parts if parts is not None else nodes.select("cell", F.lit(0.0).alias("value")).where("false")

    def betweenness(self, connectivity: str | None = None, transform=None, diagonal: float | None = None) -> DataFrame:
        """row, col, value: flow through each cell, weighted by qualities and, if one is named, by proximity."""
        if self.method != "series" and connectivity in (None, "survival_probability"):
            flow = self._flow(connectivity is not None, diagonal if connectivity else None)
        else:
            found = self._adjoint(self.proximities(connectivity, transform, diagonal) if connectivity else None)
            flow = found.where("x is not null and z is not null").groupBy(F.col("node").alias("cell")).agg(F.sum(F.col("x") * F.col("z")).alias("value"))
        every = self.landscape.nodes.select("cell").join(flow.hint("merge"), "cell", "left").select("cell", F.coalesce("value", F.lit(0.0)).alias("value"))
        return self.landscape.canvas(every)

    def edge_betweenness(self, connectivity: str | None = None, transform=None, diagonal: float | None = None) -> DataFrame:
        """src, dst, value."""
        found = written(self._adjoint(self.proximities(connectivity, transform, diagonal) if connectivity else None), "adjoint")
        x = found.where("x is not null").select(F.col("node").alias("src"), "target", "x")
        z = found.where("z is not null").select(F.col("node").alias("dst"), "target", "z")
        steps = self.walk.select("src", "dst", "w").join(x.hint("merge"), "src").join(z.hint("merge"), ["dst", "target"])
        return steps.groupBy("src", "dst").agg(F.sum(F.col("w") * F.col("x") * F.col("z")).alias("value"))

    def betweenness_qweighted(self) -> DataFrame:
        return self.betweenness()

    def betweenness_kweighted(self, connectivity: str = "expected_cost", transform=None, diagonal: float | None = None) -> DataFrame:
        return self.betweenness(connectivity, transform, diagonal)

    def edge_betweenness_qweighted(self) -> DataFrame:
        return self.edge_betweenness()

    def edge_betweenness_kweighted(self, transform=None, diagonal: float | None = None) -> DataFrame:
        return self.edge_betweenness("expected_cost", transform, diagonal)

    def mean_kl_divergence(self) -> DataFrame:
        """One row: theta times the quality-weighted sum of free energy less expected cost."""
        both = self.free_energy_distance().withColumnRenamed("value", "phi").join(self.expected_cost().hint("merge"), ["node", "target"])
        return self._weighted(both.select("node", "target", (self.theta * (F.col("phi") - F.col("value"))).alias("value")))

    def _eigen_pairs(self, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The quality-scaled proximities, those from targets, and the targets. Columns off the targets are zero, so these settle the value."""
        pairs = written(self.quality_scaled(**options).where("value > 0"), "pairs")
        targets = self.landscape.targets().select("cell")
        return pairs, written(pairs.join(targets.withColumnRenamed("cell", "node"), "node", "left_semi"), "pairs"), targets

    def _everywhere(self, found: DataFrame) -> DataFrame:
        return self.landscape.nodes.select("cell").join(found.hint("merge"), "cell", "left").select("cell", F.coalesce("value", F.lit(0.0)).alias("value"))

    def eigmax_value(self, connectivity: str = "expected_cost", transform=None, diagonal: float | None = None, tol: float = 1e-10) -> float:
        """The dominant eigenvalue of the quality-scaled proximities."""
        _, inside, targets = self._eigen_pairs(connectivity=connectivity, transform=transform, diagonal=diagonal)
        return spectrum.dominant(inside, targets, tol=tol)[0]

    def eigmax_right(self, connectivity: str = "expected_cost", transform=None, diagonal: float | None = None, tol: float = 1e-10) -> DataFrame:
        """cell, value: its right vector, of length 1."""
        pairs, inside, targets = self._eigen_pairs(connectivity=connectivity, transform=transform, diagonal=diagonal)
        return self._right(pairs, *spectrum.dominant(inside, targets, tol=tol))

    def eigmax_left(self, connectivity: str = "expected_cost", transform=None, diagonal: float | None = None, tol: float = 1e-10) -> DataFrame:
        """cell, value: its left vector, 1 at the first target (if that entry isn't 0) and 0 off the targets."""
        _, inside, targets = self._eigen_pairs(connectivity=connectivity, transform=transform, diagonal=diagonal)
        return self._left(spectrum.dominant(inside, targets, "target", "node", tol)[1])

    def eigmax(self, connectivity: str = "expected_cost", transform=None, diagonal: float | None = None, tol: float = 1e-10) -> tuple[DataFrame, float, DataFrame]:
        """(left, value, right): all three from one table of proximities."""
        pairs, inside, targets = self._eigen_pairs(connectivity=connectivity, transform=transform, diagonal=diagonal)
        value, v = spectrum.dominant(inside, targets, tol=tol)
        return self._left(spectrum.dominant(inside, targets, "target", "node", tol)[1]), value, self._right(pairs, value, v)

    def _right(self, pairs: DataFrame, value: float, v: DataFrame) -> DataFrame:
        moved = pairs.join(v.select(F.col("cell").alias("target"), F.col("value").alias("x")), "target").groupBy(F.col("node").alias("cell")).agg((F.sum(F.col("value") * F.col("x")) / value).alias("value"))
        moved = written(moved, "right")
        length = float(moved.agg(F.sqrt(F.sum(F.col("value") * F.col("value")))).first()[0])
        return self._everywhere(moved.withColumn("value", F.col("value") / length))

    def _left(self, u: DataFrame) -> DataFrame:
        first = float(u.agg(F.min_by("value", "cell")).first()[0])
        return self._everywhere(u.withColumn("value", F.col("value") / (first or 1.0)))

    # --- least costs -----------------------------------------------------------------------

    @cached_property
    def _tiles(self) -> Tiles:
        return Tiles(self.landscape.edges, *self.landscape.size)

    def _targets(self) -> DataFrame:
        return self.landscape.targets().select(F.col("cell").alias("target"))

    def least_cost_distance(self) -> DataFrame:
        """node, target, value: the least cost from the target to the node."""
        return self._tiles.least_costs(self._targets())

    def _divergence(self, targets: DataFrame) -> DataFrame:
        step = F.coalesce(-F.ln("pref"), F.lit(float("inf"))).alias("value")
        return self._tiles.summed_paths(reference_walk(self.landscape, self.theta).select(F.col("src").alias("node"), F.col("dst").alias("parent"), step), targets)

    def least_cost_kl(self) -> DataFrame:
        """node, target, value: the divergence of the least-cost path from the reference walk; of tied paths that over the least nodes."""
        return self._divergence(self._targets())

    def least_cost_kl_divergence(self, row: int, col: int) -> DataFrame:
        """The canvas of that divergence to one cell."""
        land = self.landscape
        if land.nodes.where((F.col("row") == row) & (F.col("col") == col)).isEmpty():
            raise ValueError(f"({row}, {col}) is not an active cell")
        target = land.spark.range(1).select(F.lit((col - 1) * land.nrows + row).cast("long").alias("target"))
        found = self._divergence(target)
        return land.canvas(found.select(F.col("node").alias("cell"), "value"))

    def _weighted(self, pairs: DataFrame) -> DataFrame:
        """One row: the sum over pairs, weighted by both qualities."""
        nodes = self.landscape.nodes
        both = pairs.join(nodes.select(F.col("cell").alias("node"), "qs").hint("merge"), "node").join(nodes.where("is_target").select(F.col("cell").alias("target"), "qt"), "target")
        return both.agg(F.sum(F.col("qs") * F.col("value") * F.col("qt")).alias("value"))

    def mean_lc_kl_divergence(self) -> DataFrame:
        """One row: the quality-weighted sum over sources and targets."""
        return self._weighted(self.least_cost_kl())


def theta_sweep(land: Landscape, thetas: list[float]) -> DataFrame:
    """theta, row, col, value: quality-weighted flow at several temperatures; each has a tree of its own."""
    out = None
    for theta in thetas:
        flow = DistributedModel(land, theta).betweenness()
        part = flow.where("value is not null").select(F.lit(float(theta)).alias("theta"), "row", "col", "value")
        out = part if out is None else out.unionByName(part)
    return out


def calibrate(land: Landscape, target: float, low: float = 1e-3, high: float = 3.0, tol: float = 1e-7, most: int = 40) -> tuple[float, float]:
    """(theta, divergence): the temperature between ``low`` and ``high`` at which the mean KL divergence is ``target``, within ``tol`` of it.

    A first round looks at both ends and two temperatures between them, side by side: they wait for Spark, not for each other. Then the
    logarithms are interpolated inside the bracket, through all that is known; where that leads out of it, and
    every fourth time, the bracket is halved. A target outside the reachable range raises. One factorisation for each temperature tried.
    """
    if not target > 0:
        raise ValueError("the target must be positive")
    seen: dict[float, float] = {}

    def divergence(theta: float) -> float:
        return float(DistributedModel(land, theta).mean_kl_divergence().first()[0])

    gap = lambda kl: math.log(max(kl, sys.float_info.min) / target)
    first = [low, *(low * (high / low) ** (k / 3) for k in (1, 2)), high]
    with ThreadPoolExecutor(len(first)) as pool:
        seen |= zip(first, pool.map(inheritable_thread_target(divergence), first), strict=True)
    known = [(math.log(t), gap(kl)) for t, kl in seen.items()]
    (a, fa), (b, fb) = known[0], known[-1]
    if fa * fb > 0:
        raise ValueError(f"no temperature from {low} to {high} has the divergence {target}: it is {seen[low]:.6g} and {seen[high]:.6g} there")
    for k in range(most):
        for x, f in known:
            if a < x < b:
                a, fb, b = (a, f, x) if f * fb > 0 else (x, fb, b)
        theta = min(seen, key=lambda t: abs(gap(seen[t])))
        if abs(gap(seen[theta])) <= tol or b - a <= 1e-13:
            return theta, seen[theta]
        x = _zero_of(known)
        if not a < x < b or k % 4 == 3:
            x = (a + b) / 2
        seen[math.exp(x)] = divergence(math.exp(x))
        known.append((x, gap(seen[math.exp(x)])))
    raise RuntimeError(f"no temperature found in {most} steps")


def _zero_of(known: list[tuple[float, float]]) -> float:
    """Where the polynomial through the points (f, x) is at f = 0; not a number if two have the same f."""
    if len({f for _, f in known}) < len(known):
        return math.nan
    return sum(x * math.prod(g / (g - f) for _, g in known if g != f) for x, f in known)


def undirected(land: Landscape) -> Landscape:
    """``land`` with every active cell as a target; raises unless costs are the same in both directions."""
    land.check_symmetric()
    return Landscape(land.spark, land.nrows, land.ncols, land.edges, land.nodes.withColumn("is_target", F.lit(True)), land.qs, land.qt, False, land.cost_name)


def floyd_warshall(land: Landscape) -> DataFrame:
    """node, target, value: least costs between all cells of the undirected view."""
    every = undirected(land)
    return Tiles(every.edges, *every.size).least_costs(every.targets().select(F.col("cell").alias("target")))


def brandes(land: Landscape) -> DataFrame:
    """row, col, value: classical shortest-path betweenness of the undirected view, each unordered pair counted once."""
    dist = floyd_warshall(land)
    return land.canvas(dependencies(land.edges, dist).select("cell", (F.col("value") / 2).alias("value")))


def dependencies(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """cell, value: for each cell the sum over sources of Brandes' dependencies, all sources of ``dist`` (node, target, value) at once.

    With T the edges on shortest paths from a source (ties within ``SAME``), paths are counted by sigma = sum of T^k of the source, and
    (1 + delta) / sigma = sum of the transpose's powers of 1 / sigma; both end after as many joins as the longest path has edges.
    """
    ahead = dist.select(F.col("node").alias("src"), "target", F.col("value").alias("before")).join(edges.where("cost is not null and not isnan(cost)").select("src", F.col("dst").alias("node"), "cost"), "src")
    x = F.col("before") + F.col("cost")
    near = F.abs(x - F.col("value")) <= SAME * F.greatest(F.lit(1.0), F.col("value"))
    tight = written(ahead.join(dist, ["node", "target"]).where(near & (F.col("cost") > 0)).select("target", "src", F.col("node").alias("dst")), "tight")
    roots = dist.where("node = target").select("node", "target", F.lit(1.0).alias("n"))
    sigma = written(powers(tight, roots, "src", "dst"), "sigma")
    whole = powers(tight, sigma.select("node", "target", (1 / F.col("n")).alias("n")), "dst", "src").withColumnRenamed("n", "g")
    both = sigma.join(whole, ["node", "target"]).where("node <> target")
    return both.groupBy(F.col("node").alias("cell")).agg(F.sum(F.col("n") * F.col("g") - 1).alias("value"))


def powers(tight: DataFrame, start: DataFrame, here: str, there: str, rounds: int = 100_000) -> DataFrame:
    """node, target, n: the sum of all powers of an acyclic table of steps applied to ``start`` (node, target, n)."""
    steps = tight.select("target", F.col(here).alias("node"), F.col(there).alias("next"))
    now, parts = written(start, "powers"), []
    for _ in range(rounds):
        parts.append(now)
        now = written(now.join(steps, ["node", "target"]).groupBy(F.col("next").alias("node"), "target").agg(F.sum("n").alias("n")), "powers")
        if now.isEmpty():
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.unionByName(p)
            return whole.groupBy("node", "target").agg(F.sum("n").alias("n"))
    raise RuntimeError("the steps run in a circle")
