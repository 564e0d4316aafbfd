"""A landscape: a weighted graph over raster cells, with qualities, costs and targets."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.functions import transforms
from landweave.operators import graph, kernels, raster
from landweave.operators.tiles import Tiles
from landweave.plans.stages import written

#: Edges up to which a graph is collected and broadcast to the kernels; beyond it the table operators of ``graph`` apply.
BROADCAST_EDGES = 4_000_000


class Landscape:
    """Tables of a landscape.

    ``edges``: src, dst, affinity, cost; ``nodes``: cell, row, col, qs, qt, is_target of the active cells.
    ``qs`` and ``qt`` keep the whole quality rasters, inactive cells included.
    """

    def __init__(self, spark: SparkSession, nrows: int, ncols: int, edges: DataFrame, nodes: DataFrame, qs: DataFrame, qt: DataFrame, landmarks: bool, cost_name: str | None):
        self.spark, self.nrows, self.ncols = spark, nrows, ncols
        self.edges, self.nodes, self.qs, self.qt = edges, nodes, qs, qt
        self.landmarks, self.cost_name = landmarks, cost_name

    @classmethod
    def build(
        cls, spark: SparkSession, nrows: int, ncols: int, affinities: DataFrame | None = None, *, qualities: DataFrame | None = None,
        source_qualities: DataFrame | None = None, target_qualities: DataFrame | None = None, landmarks: bool = False,
        costs: str | DataFrame | Callable[[Column], Column] = "minus_log", prune: bool = True, check: bool = True,
    ) -> Landscape:
        """``affinities`` and a cost table are (src, dst, value); qualities are rasters, 1 everywhere by default.

        With ``landmarks`` only the cells of ``target_qualities`` are targets, zeros included; otherwise
        every active cell is one. Costs are a transformation of affinities or a table.
        """
        if affinities is None:
            raise ValueError("affinities are needed")
        if landmarks and target_qualities is None:
            raise ValueError("landmarks are the cells of target_qualities")
        n = nrows * ncols
        affinities = affinities.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("value").cast("double").alias("value"))
        derived = not isinstance(costs, DataFrame)
        if check:
            cls._inside(affinities, n, nrows, ncols, "affinity")
            if not derived:
                cls._inside(costs, n, nrows, ncols, "cost")
                if not missing_affinities(affinities, costs).isEmpty():
                    raise ValueError("cost graph contains edges not present in the affinity graph")
        edges = affinities.withColumnRenamed("value", "affinity")
        if derived:
            edges = edges.withColumn("cost", transforms.column_form(costs)(F.col("affinity")))
        else:
            edges = edges.join(costs.select("src", "dst", F.col("value").cast("double").alias("cost")).hint("merge"), ["src", "dst"], "left")
        if check and not edges.where("cost < 0").isEmpty():
            raise ValueError("the cost graph can have only non-negative edge weights")
        whole = raster.cells(spark, nrows, ncols)
        ones = whole.select("row", "col", F.lit(1.0).alias("value"))
        qs = source_qualities if source_qualities is not None else qualities if qualities is not None else ones
        qt = target_qualities if target_qualities is not None else qualities if qualities is not None else ones
        nodes = whole
        if prune:
            own = edges.where("cost is not null and not isnan(cost)")
            kept = written(graph.largest_component(own), "component")
            end = lambda c: kept.select(F.col("node").alias(c)).hint("merge")
            edges = edges.join(end("dst"), "dst", "left_semi").join(end("src"), "src", "left_semi")
            nodes = whole.join(end("cell"), "cell", "left_semi")
        nodes = (
            nodes.join(qs.select("row", "col", F.col("value").alias("qs")).hint("merge"), ["row", "col"], "left")
            .join(qt.select("row", "col", F.col("value").alias("qt"), F.lit(True).alias("_t")).hint("merge"), ["row", "col"], "left")
            .select("cell", "row", "col", "qs", "qt", (F.col("_t").isNotNull() if landmarks else F.lit(True)).alias("is_target"))
        )
        return cls(spark, nrows, ncols, edges, nodes, qs, qt, landmarks, costs if isinstance(costs, str) else None)

    @staticmethod
    def _inside(edges: DataFrame, n: int, nrows: int, ncols: int, kind: str) -> None:
        lo, hi = edges.agg(F.min(F.least("src", "dst")), F.max(F.greatest("src", "dst"))).first()
        if lo is not None and (lo < 1 or hi > n):
            raise ValueError(f"grid size ({nrows}, {ncols}) is incompatible with the cells {lo} to {hi} of the {kind} graph")

    @classmethod
    def wall(cls, spark: SparkSession, nrows: int, ncols: int, *, scaling: float = 0.5, impossible: float = 1e-20, neighbors: int = 8, qualities: DataFrame | None = None, costs="minus_log", **wall) -> Landscape:
        """The permeable wall: a scaled lattice behind a wall with corridors; wall cells have quality 0."""
        stones = raster.wall_table(spark, nrows, ncols, **wall)
        edges = raster.wall_affinities(spark, nrows, ncols, scaling, impossible, neighbors, **wall)
        q = qualities if qualities is not None else raster.cells(spark, nrows, ncols).select("row", "col", F.lit(1.0).alias("value"))
        hit = stones.select("row", "col", F.lit(True).alias("_w"))
        q = q.join(hit, ["row", "col"], "left").select("row", "col", F.when(F.col("_w"), F.lit(0.0)).otherwise(F.col("value")).alias("value"))
        return cls.build(spark, nrows, ncols, edges, qualities=q, costs=costs)

    # --- structure -------------------------------------------------------------------------

    @property
    def size(self) -> tuple[int, int]:
        return self.nrows, self.ncols

    def __repr__(self) -> str:
        return f"Landscape of size {self.nrows} x {self.ncols}" + (" with landmarks" if self.landmarks else "")

    def _repr_html_(self) -> str:
        return f"<h4>{self!r}</h4><p>costs: {self.cost_name or 'a table'}</p>"

    def targets(self) -> DataFrame:
        """cell, row, col, qt of the targets among the active cells."""
        return self.nodes.where("is_target").select("cell", "row", "col", "qt")

    def is_strongly_connected(self) -> bool:
        return graph.is_strongly_connected(self.edges, self.nodes.select(F.col("cell").alias("node")))

    def largest_subgraph(self) -> Landscape:
        kept = written(graph.largest_component(self.edges.where("cost is not null")), "component")
        end = lambda c: kept.select(F.col("node").alias(c)).hint("merge")
        edges = self.edges.join(end("dst"), "dst", "left_semi").join(end("src"), "src", "left_semi")
        nodes = self.nodes.join(end("cell"), "cell", "left_semi")
        return Landscape(self.spark, self.nrows, self.ncols, edges, nodes, self.qs, self.qt, self.landmarks, self.cost_name)

    def impassable(self, cells: DataFrame, affinity: float = 1e-20, prune: bool = True) -> Landscape:
        """The landscape with some cells (row, col) nearly closed: edges into and out of them get ``affinity`` (zero removes
        them), their qualities become 0, costs follow from the new affinities, and what hangs off is pruned again."""
        if self.cost_name is None:
            raise ValueError("costs that are a table don't follow from affinities")
        walls = cells.select("row", "col").distinct()
        edges = self.edges.select("src", "dst", F.col("affinity").alias("value"))
        numbered = walls.select(((F.col("col") - 1) * self.nrows + F.col("row")).cast("long").alias("cell"))
        hit = walls.withColumn("_hit", F.lit(True))
        zeroed = lambda q: q.join(hit, ["row", "col"], "left").select("row", "col", F.when(F.col("_hit"), F.lit(0.0)).otherwise(F.col("value")).alias("value"))
        return Landscape.build(
            self.spark, self.nrows, self.ncols, raster.impassable(edges, numbered, affinity), source_qualities=zeroed(self.qs), target_qualities=zeroed(self.qt),
            landmarks=self.landmarks, costs=self.cost_name, prune=prune,
        )

    def check_symmetric(self) -> None:
        """Raise unless costs are the same in both directions."""
        e = self.edges
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("cost").alias("back"))
        if not e.join(back.hint("merge"), ["src", "dst"], "left").where("back is null or abs(back - cost) > 1e-12").isEmpty():
            raise ValueError("the view is undirected, but costs differ by direction")

    def with_landmarks(self, npix: int) -> Landscape:
        """The same landscape with the coarse-grained target qualities as landmarks."""
        qt = self.coarse_graining(npix)
        marks = qt.select("row", "col", F.col("value").alias("qt"), F.lit(True).alias("_t")).hint("merge")
        nodes = self.nodes.drop("qt", "is_target").join(marks, ["row", "col"], "left").select("cell", "row", "col", "qs", "qt", F.col("_t").isNotNull().alias("is_target"))
        return Landscape(self.spark, self.nrows, self.ncols, self.edges, nodes, self.qs, qt, True, self.cost_name)

    def coarse_graining(self, npix: int) -> DataFrame:
        return raster.coarse_graining(self.qt, self.nrows, self.ncols, npix)

    def sum_neighborhood(self, row: int, col: int, npix: int) -> DataFrame:
        return raster.neighborhood_sum(self.qt, row, col, npix)

    def canvas(self, values: DataFrame, fill: float | None = None) -> DataFrame:
        """row, col, value of all cells from (cell, value)."""
        return raster.canvas(self.spark, values, self.nrows, self.ncols, fill)

    def outdegree_map(self) -> DataFrame:
        return self.canvas(raster.outdegrees(self.edges.select("src", "dst", F.col("affinity").alias("value"))))

    def indegree_map(self) -> DataFrame:
        return self.canvas(raster.indegrees(self.edges.select("src", "dst", F.col("affinity").alias("value"))))

    # --- arrays for kernels ------------------------------------------------------------------

    @cached_property
    def arrays(self) -> kernels.Graph:
        """The graph as arrays on the driver, if it has at most BROADCAST_EDGES edges."""
        edges = self.edges.select("src", "dst", "affinity", "cost")
        table = edges.limit(BROADCAST_EDGES + 1).toArrow()
        if table.num_rows > BROADCAST_EDGES:
            raise ValueError(f"more than {BROADCAST_EDGES} edges: use DistributedModel and graph.least_cost, which keep the graph distributed")
        src, dst, affinity, cost = (table.column(c).to_numpy(zero_copy_only=False).astype(float if c in ("affinity", "cost") else int) for c in table.column_names)
        nodes = self.nodes.orderBy("cell").toPandas()
        cell = nodes["cell"].to_numpy(int)
        order = np.lexsort((dst, src))
        a, b = np.searchsorted(cell, src[order]), np.searchsorted(cell, dst[order])
        affinity, cost = affinity[order], cost[order]
        number = lambda c: nodes[c].to_numpy(float, na_value=np.nan)
        targets = np.flatnonzero(nodes["is_target"].to_numpy(bool))
        qt = number("qt")
        if self.landmarks:
            qt = np.where(nodes["is_target"].to_numpy(bool), qt, 0.0)
        return kernels.Graph(cell, nodes["col"].to_numpy(int), number("qs"), qt, targets, a, b, affinity, cost, kernels.reference_walk(len(cell), a, affinity), row=nodes["row"].to_numpy(int))

    # --- distances without a fitted model ----------------------------------------------------

    def _per_target(self, f: Callable[[kernels.Graph, int], np.ndarray], theta: float | None = None) -> DataFrame:
        from landweave.operators.rsp import pairs

        return pairs(self, f, theta)

    def least_cost_distance(self, *, theta: float | None = None, approx: bool = False) -> DataFrame:
        """node, target, value: the least cost from the target to the node."""
        if approx:
            raise ValueError("least-cost distances have no approximation")
        if theta is not None:
            raise ValueError("least-cost distances have no temperature")
        return Tiles(self.edges, *self.size).least_costs(self.targets().select(F.col("cell").alias("target")))

    def _tables(self, theta: float):
        from landweave.operators.distributed import DistributedModel

        return DistributedModel(self, _positive(theta))

    def expected_cost(self, *, theta: float, approx: bool = False, tol: float | None = None) -> DataFrame:
        """node, target, value.

        The distances solve the soft-minimum equations, as the fundamental matrix has them, so they come from the separator tree. ``approx`` is one
        sweep over the nodes in order of their least cost; with a ``tol`` sweeps go on until both distances change by less than it, relative to the largest.
        """
        return self._per_target(_Sweep(1, approx, tol or 1e-8), _positive(theta)) if approx or tol else self._tables(theta).expected_cost()

    def free_energy_distance(self, *, theta: float, approx: bool = False, tol: float | None = None) -> DataFrame:
        return self._per_target(_Sweep(0, approx, tol or 1e-8), _positive(theta)) if approx or tol else self._tables(theta).free_energy_distance()

    def survival_probability(self, *, theta: float, approx: bool = False, tol: float | None = None) -> DataFrame:
        return self.free_energy_distance(theta=theta, approx=approx, tol=tol).withColumn("value", F.exp(F.col("value") * -theta))

    def power_mean_proximity(self, *, theta: float, approx: bool = False, tol: float | None = None) -> DataFrame:
        return self.survival_probability(theta=theta, approx=approx, tol=tol).withColumn("value", F.pow("value", F.lit(1.0 / theta)))

    def connected_habitat(self, connectivity: str = "expected_cost", *, theta: float | None = None, transform=None, diagonal: float | None = None, approx: bool = False) -> DataFrame:
        """row, col, value: quality of each cell times the quality it is connected to, without a fitted model."""
        if connectivity not in kernels.MEASURES:
            raise ValueError(f"unknown connectivity function {connectivity!r}")
        if connectivity in kernels.DISTANCES and transform is None:
            if self.cost_name is None:
                raise ValueError("a distance needs a transformation to proximities")
            transform = transforms.inverse(self.cost_name)
        found = self.least_cost_distance() if connectivity == "least_cost_distance" else getattr(self, connectivity)(theta=theta, approx=approx)
        if connectivity in kernels.DISTANCES:
            found = found.withColumn("value", transforms.column_form(transform)(F.col("value")))
        return self.habitat_of(found, diagonal)

    def habitat_of(self, proximities: DataFrame, diagonal: float | None = None) -> DataFrame:
        """The habitat canvas of a table of proximities (node, target, value)."""
        value = F.col("value") if diagonal is None else F.when(F.col("node") == F.col("target"), F.lit(float(diagonal))).otherwise(F.col("value"))
        qt = self.nodes.where("is_target").select(F.col("cell").alias("target"), F.coalesce("qt", F.lit(0.0)).alias("qt"))
        reached = proximities.join(qt, "target").groupBy("node").agg(F.sum(value * F.col("qt")).alias("reached"))
        qs = self.nodes.select(F.col("cell").alias("node"), "qs")
        return self.canvas(reached.join(qs.hint("merge"), "node").select(F.col("node").alias("cell"), (F.col("qs") * F.col("reached")).alias("value")))


def _positive(theta: float | None) -> float:
    if theta is None or not theta > 0:
        raise ValueError("theta must be positive")
    return theta


class _Sweep:
    def __init__(self, which: int, approx: bool, tol: float):
        self.which, self.approx, self.tol = which, approx, tol

    def __call__(self, g: kernels.Graph, t: int) -> np.ndarray:
        return kernels.sweep_distances(g, t, self.approx, self.tol)[self.which]


def missing_affinities(affinities: DataFrame, costs: DataFrame) -> DataFrame:
    """Cost edges without an affinity edge; zeros on either side are no edges."""
    return costs.where("value <> 0").select("src", "dst").join(affinities.where("value <> 0").select("src", "dst").hint("merge"), ["src", "dst"], "left_anti")
