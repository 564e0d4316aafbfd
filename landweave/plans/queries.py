"""The registered queries: each applies one operator to a landscape made of the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landweave.functions import transforms
from landweave.operators import distributed, graph, kernels, raster, rsp
from landweave.operators.distributed import DistributedModel
from landweave.operators.landscape import Landscape, missing_affinities
from landweave.operators.rsp import RspModel
from landweave.plans import tables
from landweave.plans.stages import shared_dir, written
from landweave.plans.tables import ACTIVITY, PART, SHIP
from landweave.sources import ascgrid

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}
THETA, NPIX = 1.0, 3


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


def query(f: Query) -> Query:
    _REGISTRY[f.__name__] = f
    return f


def landmarks(npix: int) -> Callable:
    """A query (spark, sf_dir, npix) whose SQL is of landmarks under its own name, and with all active cells as targets as ``_all``."""

    def register(f: Callable) -> Callable:
        _REGISTRY[f.__name__], _REGISTRY[f"{f.__name__}_all"] = partial(f, npix=npix), partial(f, npix=None)
        return f

    return register


def everywhere(npix: int) -> Callable:
    """One without SQL: all active cells are targets under its own name, landmarks as ``_landmarks``."""

    def register(f: Callable) -> Callable:
        _REGISTRY[f.__name__], _REGISTRY[f"{f.__name__}_landmarks"] = partial(f, npix=None), partial(f, npix=npix)
        return f

    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names or ("value",)})


def log_rounded(df: DataFrame) -> DataFrame:
    """Tiny positive values by their logarithm."""
    return df.withColumn("value", F.round(F.ln("value"), 6))


def ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.value_of(tables.ship_cells(spark, sf_dir), "affinity")


def ship_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.raster_graph(ship(spark, sf_dir), *SHIP)


def model(spark: SparkSession, sf_dir: str, npix: int | None = NPIX, theta: float = THETA) -> DistributedModel:
    return DistributedModel(tables.ship_landscape(spark, sf_dir, npix), theta)


def arrays(spark: SparkSession, sf_dir: str, npix: int | None = NPIX) -> RspModel:
    """For what has no table form."""
    return RspModel(tables.ship_landscape(spark, sf_dir, npix), THETA)


# --- rasters and graphs ------------------------------------------------------------------------


@query
def raster_ship(spark, sf_dir):
    return rounded(tables.ship_cells(spark, sf_dir), "affinity", "quality", digits=9)


@query
def raster_activity(spark, sf_dir):
    return rounded(tables.activity_cells(spark, sf_dir), "affinity", digits=9)


@query
def raster_part(spark, sf_dir):
    return rounded(tables.part_cells(spark, sf_dir), "affinity", digits=9)


def _adjacency(neighbors: int, weight: str, matrix: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = raster.raster_graph(tables.value_of(tables.activity_cells(spark, sf_dir), "affinity"), *ACTIVITY, neighbors, weight, matrix)
    return rounded(edges.where("not isnan(value)"), digits=9)


for _n in (4, 8):
    for _w in raster.WEIGHTS:
        for _m in raster.MATRICES:
            _REGISTRY[f"adj_n{_n}_{_w}_{_m}"] = partial(_adjacency, _n, _w, _m)


@query
def adj_part(spark, sf_dir):
    return rounded(raster.raster_graph(tables.value_of(tables.part_cells(spark, sf_dir), "affinity"), *PART), digits=9)


def _lattice(neighbors: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform grid of the size of the parts' raster."""
    side = tables.parts_side(spark, sf_dir)
    return rounded(raster.lattice(spark, side, side, neighbors), digits=9)


_REGISTRY["lattice_n4"], _REGISTRY["lattice_n8"] = partial(_lattice, 4), partial(_lattice, 8)


@query
def stencil_n8(spark, sf_dir):
    """The stencil of 8 neighbours at every cell of the parts' raster."""
    cells, _ = tables.parts_grid(spark, sf_dir)
    return rounded(cells.select("row", "col", F.explode(raster.stencil(8)).alias("s")).select("row", "col", "s.*"), "len", digits=9)


def _cost(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.map_values(ship_edges(spark, sf_dir), transforms.named(name).column), digits=7)


for _t in transforms.REGISTRY:
    _REGISTRY[f"cost_{_t}"] = partial(_cost, _t)


@query
def transform_inverses(spark, sf_dir):
    """Each transformation of an affinity, followed by its declared inverse."""
    edges = ship_edges(spark, sf_dir)
    back: list[Column] = [F.round(transforms.named(t.inverse).column(t.column(F.col("value"))), 7).alias(t.name) for t in transforms.REGISTRY.values()]
    return edges.select("src", "dst", *back)


def _coarse(npix: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(raster.coarse_graining(tables.value_of(tables.ship_cells(spark, sf_dir), "quality"), *SHIP, npix))


for _p in (1, 2, 3, 5):
    _REGISTRY[f"coarse_graining_p{_p}"] = partial(_coarse, _p)


@query
def sum_neighborhood(spark, sf_dir):
    return rounded(raster.neighborhood_sum(tables.value_of(tables.ship_cells(spark, sf_dir), "quality"), 16, 6, 5))


@query
def sum_neighborhoods(spark, sf_dir):
    """Sums of 5 x 5 cells around every cell of the parts' raster."""
    cells, side = tables.parts_grid(spark, sf_dir)
    return rounded(raster.neighborhood_sums(tables.value_of(cells, "quality"), side, side, 5))


@query
def coarse_graining_sizes(spark, sf_dir):
    """Landmarks of the parts' raster by every block size up to 12."""
    cells, side = tables.parts_grid(spark, sf_dir)
    return rounded(raster.coarse_grainings(tables.value_of(cells, "quality"), side, side, list(range(1, 13))))


@query
def outdegree_map(spark, sf_dir):
    return rounded(tables.ship_landscape(spark, sf_dir, None).outdegree_map())


@query
def indegree_map(spark, sf_dir):
    return rounded(tables.ship_landscape(spark, sf_dir, None).indegree_map())


@query
def value_map(spark, sf_dir):
    land = tables.ship_landscape(spark, sf_dir, None)
    return rounded(land.canvas(land.nodes.select("cell", F.col("qs").alias("value"))))


def _tiled(name: str, tile: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ship landscape cut into small tiles, so that its separator tree has several levels."""
    return getattr(DistributedModel(tables.ship_landscape(spark, sf_dir, NPIX), THETA, tile=tile), name)()


_REGISTRY["separator_tree_z"] = lambda spark, sf_dir: log_rounded(_tiled("fundamental_matrix", 4, spark, sf_dir))
_REGISTRY["separator_tree_flow"] = lambda spark, sf_dir: rounded(_tiled("betweenness_qweighted", 4, spark, sf_dir))


@query
def canvas_infinite(spark, sf_dir):
    """Qualities above the middle on a canvas of infinity."""
    land = tables.ship_landscape(spark, sf_dir, None)
    return rounded(land.canvas(land.nodes.where("qs > 0.5").select("cell", F.col("qs").alias("value")), fill=float("inf")))


@query
def grid_size(spark, sf_dir):
    """Rows, columns and active cells of both landscapes."""
    out = None
    for name, land in (("ship", tables.ship_landscape(spark, sf_dir, None)), ("parts", tables.parts_landscape(spark, sf_dir))):
        one = land.nodes.agg(F.lit(name).alias("name"), F.lit(land.size[0]).cast("long").alias("rows"), F.lit(land.size[1]).cast("long").alias("cols"), F.count(F.lit(1)).alias("active"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def reprs(spark, sf_dir):
    """What a landscape, its model and the model's landscape are called."""
    m = DistributedModel(tables.parts_landscape(spark, sf_dir), THETA)
    return spark.createDataFrame([("landscape", repr(m.landscape)), ("model", repr(m)), ("unwrapped", repr(rsp.unwrapped(m)))], "name string, value string")


@query
def landscape_checks(spark, sf_dir):
    """Whether a landscape is refused, with a reason: without affinities, with cells outside its grid (in affinities, or in costs), with negative costs."""
    edges = ship_edges(spark, sf_dir)
    rows, cols = SHIP
    cases = {
        "complete": lambda: Landscape.build(spark, rows, cols, edges, prune=False), "no affinities": lambda: Landscape.build(spark, rows, cols),
        "grid too small": lambda: Landscape.build(spark, rows - 1, cols, edges, prune=False),
        "costs outside": lambda: Landscape.build(spark, rows, cols, edges, costs=edges.withColumn("dst", F.col("dst") + rows), prune=False),
        "negative costs": lambda: Landscape.build(spark, rows, cols, raster.map_values(edges, lambda v: v * 3), prune=False),
    }

    def reason(f: Callable) -> str | None:
        try:
            f()
        except ValueError as e:
            return str(e).split(" of the ")[0]
        return None

    found = [(name, reason(f)) for name, f in cases.items()]
    return spark.createDataFrame([(name, why is not None, why) for name, why in found], "name string, refused boolean, reason string")


@query
def target_nodes(spark, sf_dir):
    return rounded(tables.ship_landscape(spark, sf_dir, NPIX).targets(), "qt")


@query
def cost_validation(spark, sf_dir):
    """Edges whose cost would be rejected as negative, were affinities three times as large."""
    edges = raster.map_values(ship_edges(spark, sf_dir), lambda v: v * 3)
    return rounded(raster.map_values(edges, transforms.named("minus_log").column).where("value < 0"))


@query
def edge_containment(spark, sf_dir):
    """8-neighbour cost edges without a 4-neighbour affinity edge."""
    cells = ship(spark, sf_dir)
    return missing_affinities(raster.raster_graph(cells, *SHIP, 4), raster.raster_graph(cells, *SHIP, 8, matrix="cost"))


@query
def wall_cells(spark, sf_dir):
    """A wall across a raster of the size of the parts' one."""
    side = tables.parts_side(spark, sf_dir)
    return raster.wall_table(spark, side, side, corridor_widths=(3, 2))


@query
def wall_affinities(spark, sf_dir):
    side = tables.parts_side(spark, sf_dir)
    return rounded(raster.wall_affinities(spark, side, side, impossible=1e-3, corridor_widths=(3, 2)), digits=9)


@query
def wall_impassable(spark, sf_dir):
    """With no affinity left at the wall its edges are gone."""
    side = tables.parts_side(spark, sf_dir)
    return rounded(raster.wall_affinities(spark, side, side, impossible=0.0, corridor_widths=(3, 2)), digits=9)


@query
def wall_parts(spark, sf_dir):
    """The parts' own affinities behind a wall."""
    cells, side = tables.parts_grid(spark, sf_dir)
    edges = raster.raster_graph(tables.value_of(cells, "affinity"), side, side)
    return rounded(raster.impassable(edges, raster.wall_table(spark, side, side, corridor_widths=(3, 2)), 1e-3), digits=9)


@query
def landscape_impassable(spark, sf_dir):
    """The ship landscape with its fifteenth day closed: edges that touch it, with the quality of where they lead."""
    land = tables.ship_landscape(spark, sf_dir, None)
    closed = land.impassable(land.nodes.where("row = 15"))
    nodes = closed.nodes.select(F.col("cell").alias("dst"), "qs", "qt")
    touched = closed.edges.where("(src - 1) % 31 = 14 or (dst - 1) % 31 = 14").join(nodes, "dst")
    return rounded(touched.select("src", "dst", (F.col("affinity") * 1e20).alias("affinity"), "cost", "qs", "qt"), "affinity", "cost", "qs", "qt")


# --- a raster that grows with the tables -------------------------------------------------------------


@query
def parts_adjacency(spark, sf_dir):
    cells, side = tables.parts_grid(spark, sf_dir)
    return rounded(raster.raster_graph(tables.value_of(cells, "affinity"), side, side))


@query
def parts_outdegrees(spark, sf_dir):
    cells, side = tables.parts_grid(spark, sf_dir)
    return rounded(raster.outdegrees(raster.raster_graph(tables.value_of(cells, "affinity"), side, side)).select("cell", "value"))


@query
def parts_least_cost(spark, sf_dir):
    return rounded(tables.parts_landscape(spark, sf_dir).least_cost_distance(), digits=5)


@query
def parts_fundamental_matrix(spark, sf_dir):
    return log_rounded(DistributedModel(tables.parts_landscape(spark, sf_dir), THETA).fundamental_matrix())


@query
def parts_least_cost_kl(spark, sf_dir):
    return rounded(DistributedModel(tables.parts_landscape(spark, sf_dir), THETA).least_cost_kl(), digits=5)


@query
def parts_flow_k(spark, sf_dir):
    return rounded(DistributedModel(tables.parts_landscape(spark, sf_dir), THETA).betweenness_kweighted("survival_probability"), digits=5)


@query
def parts_habitat(spark, sf_dir):
    return rounded(DistributedModel(tables.parts_landscape(spark, sf_dir), THETA).connected_habitat("survival_probability"), digits=5)


@query
def parts_expected_cost(spark, sf_dir):
    return rounded(DistributedModel(tables.parts_landscape(spark, sf_dir), THETA).expected_cost(), digits=5)


@query
def parts_flow(spark, sf_dir):
    return rounded(DistributedModel(tables.parts_landscape(spark, sf_dir), THETA).betweenness_qweighted(), digits=5)


@query
def mask_reconcile(spark, sf_dir):
    parts = tables.value_of(tables.part_cells(spark, sf_dir), "affinity")
    return rounded(raster.reconcile(parts, tables.value_of(tables.activity_cells(spark, sf_dir), "affinity")), "a", "b", digits=9)


@query
def mask_reconcile_one_sided(spark, sf_dir):
    parts = tables.value_of(tables.part_cells(spark, sf_dir), "affinity")
    return rounded(raster.reconcile(parts, tables.value_of(tables.activity_cells(spark, sf_dir), "affinity"), both=False), "a", "b", digits=9)


@query
def clamp_negative(spark, sf_dir):
    cells = tables.ship_cells(spark, sf_dir)
    return rounded(cells.select("row", "col", transforms.clamp_negative(F.col("quality") - 0.5).alias("value")))


@query
def independent_cost(spark, sf_dir):
    return rounded(raster.map_values(ship_edges(spark, sf_dir), transforms.independent_cost))


@query
def finite_total(spark, sf_dir):
    return rounded(raster.finite_total(tables.value_of(tables.ship_cells(spark, sf_dir), "quality")))


@landmarks(NPIX)
def euclid_distance(spark, sf_dir, npix):
    land = tables.ship_landscape(spark, sf_dir, npix)
    return rounded(raster.euclidean(land.nodes, land.targets()))


@query
def ascgrid_roundtrip(spark, sf_dir):
    """The ship raster written as an ASCII grid to the shared folder and read again."""
    cells = tables.value_of(tables.ship_cells(spark, sf_dir), "affinity")
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}.asc"
    meta = ascgrid.RasterMeta(ncols=SHIP[1], nrows=SHIP[0], cellsize=1.0)
    ascgrid.write_ascgrid(cells, path, meta)
    back, found = ascgrid.read_ascgrid(spark, path)
    assert found.same_place(meta)
    return rounded(back, digits=9)


# --- graph structure ---------------------------------------------------------------------------


def strong_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade links of more than an even share."""
    return written(tables.trade_edges(spark, sf_dir).where("value > 0.06 and src <> dst"), "trade")


@query
def trade_graph(spark, sf_dir):
    return rounded(tables.trade_edges(spark, sf_dir))


@query
def scc_labels(spark, sf_dir):
    return graph.strong_components(strong_trade(spark, sf_dir))


@query
def scc_labels_distributed(spark, sf_dir):
    return graph.strong_components_by_colour(strong_trade(spark, sf_dir))


@query
def largest_subgraph(spark, sf_dir):
    return graph.largest_component(strong_trade(spark, sf_dir))


@query
def is_strongly_connected(spark, sf_dir):
    edges = strong_trade(spark, sf_dir)
    return spark.createDataFrame([(graph.is_strongly_connected(edges), graph.is_strongly_connected(tables.ship_landscape(spark, sf_dir, None).edges))], "trade boolean, ship boolean")


@landmarks(NPIX)
def least_cost_distance(spark, sf_dir, npix):
    return rounded(tables.ship_landscape(spark, sf_dir, npix).least_cost_distance())


@landmarks(5)
def least_cost_distance_distributed(spark, sf_dir, npix):
    land = tables.ship_landscape(spark, sf_dir, npix)
    return rounded(graph.least_cost(land.edges, land.targets().select(F.col("cell").alias("target"))))


@query
def floyd_warshall_undirected(spark, sf_dir):
    return rounded(distributed.floyd_warshall(tables.even_landscape(spark, sf_dir)))


@query
def brandes_undirected(spark, sf_dir):
    return rounded(distributed.brandes(tables.even_landscape(spark, sf_dir)), digits=4)


# --- the model ---------------------------------------------------------------------------------


@query
def pref(spark, sf_dir):
    return rounded(distributed.reference_walk(tables.ship_landscape(spark, sf_dir), THETA).select("src", "dst", F.col("pref").alias("value")), digits=9)


@query
def w_matrix(spark, sf_dir):
    return rounded(distributed.reference_walk(tables.ship_landscape(spark, sf_dir), THETA).select("src", "dst", F.col("w").alias("value")), digits=9)


@landmarks(NPIX)
def fundamental_matrix(spark, sf_dir, npix):
    return log_rounded(model(spark, sf_dir, npix).fundamental_matrix())


@landmarks(5)
def fundamental_matrix_distributed(spark, sf_dir, npix):
    """The same by joins and sums alone."""
    m = model(spark, sf_dir, npix)
    return log_rounded(graph.neumann(m.walk, m.landscape.targets().select(F.col("cell").alias("target"))))


@landmarks(NPIX)
def survival_probability(spark, sf_dir, npix):
    return log_rounded(model(spark, sf_dir, npix).survival_probability())


@landmarks(NPIX)
def free_energy_distance(spark, sf_dir, npix):
    return rounded(model(spark, sf_dir, npix).free_energy_distance())


@landmarks(NPIX)
def power_mean_proximity(spark, sf_dir, npix):
    return log_rounded(model(spark, sf_dir, npix, theta=2.0).power_mean_proximity())


@landmarks(NPIX)
def expected_cost(spark, sf_dir, npix):
    return rounded(model(spark, sf_dir, npix).expected_cost())


def _swept(name: str, log: bool, npix: int | None, spark: SparkSession, sf_dir: str) -> DataFrame:
    found = getattr(tables.ship_landscape(spark, sf_dir, npix), name)(theta=THETA)
    return found.withColumn("value", F.round(F.ln("value") if log else F.col("value"), 4))


_SWEPT = {"bf_expected_cost": ("expected_cost", False), "bf_free_energy": ("free_energy_distance", False), "bf_survival": ("survival_probability", True), "bf_power_mean": ("power_mean_proximity", True)}
for _b, _args in _SWEPT.items():
    _REGISTRY[_b], _REGISTRY[f"{_b}_all"] = partial(_swept, *_args, 5), partial(_swept, *_args, None)


@everywhere(5)
def bf_expected_cost_approx(spark, sf_dir, npix):
    return tables.ship_landscape(spark, sf_dir, npix).expected_cost(theta=THETA, approx=True)


@everywhere(5)
def bf_free_energy_approx(spark, sf_dir, npix):
    return tables.ship_landscape(spark, sf_dir, npix).free_energy_distance(theta=THETA, approx=True)


# --- flow --------------------------------------------------------------------------------------


@landmarks(NPIX)
def betweenness_q(spark, sf_dir, npix):
    return rounded(model(spark, sf_dir, npix).betweenness_qweighted())


@landmarks(NPIX)
def betweenness_k(spark, sf_dir, npix):
    return rounded(model(spark, sf_dir, npix).betweenness_kweighted())


@landmarks(NPIX)
def betweenness_k_survival(spark, sf_dir, npix):
    return rounded(model(spark, sf_dir, npix).betweenness_kweighted("survival_probability", diagonal=0.0))


@landmarks(NPIX)
def edge_betweenness_q(spark, sf_dir, npix):
    return rounded(model(spark, sf_dir, npix).edge_betweenness_qweighted())


@landmarks(NPIX)
def edge_betweenness_k(spark, sf_dir, npix):
    return rounded(model(spark, sf_dir, npix).edge_betweenness_kweighted())


# --- habitat and what follows ------------------------------------------------------------------


def _habitat(name: str, diagonal: float | None, npix: int | None, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(model(spark, sf_dir, npix).connected_habitat(name, diagonal=diagonal))


_HABITAT = {
    "connected_habitat_expected_cost": ("expected_cost", None), "connected_habitat_free_energy": ("free_energy_distance", None),
    "connected_habitat_survival": ("survival_probability", None), "connected_habitat_power_mean": ("power_mean_proximity", None),
    "connected_habitat_least_cost": ("least_cost_distance", None), "connected_habitat_diagonal": ("survival_probability", 0.0),
}
for _h, _args in _HABITAT.items():
    _REGISTRY[_h], _REGISTRY[f"{_h}_all"] = partial(_habitat, *_args, NPIX), partial(_habitat, *_args, None)


@landmarks(5)
def habitat_landscape_path(spark, sf_dir, npix):
    """The habitat without a fitted model."""
    return tables.ship_landscape(spark, sf_dir, npix).connected_habitat(theta=THETA).withColumn("value", F.round("value", 4))


@landmarks(NPIX)
def habitat_from_z(spark, sf_dir, npix):
    m = model(spark, sf_dir, npix)
    return rounded(m.habitat_of(m.fundamental_matrix()))


@landmarks(NPIX)
def capped_survival(spark, sf_dir, npix):
    return rounded(model(spark, sf_dir, npix).fundamental_matrix().withColumn("value", transforms.capped(F.col("value"))))


@landmarks(NPIX)
def prob_connectivity(spark, sf_dir, npix):
    land = tables.ship_landscape(spark, sf_dir, npix)
    near = lambda x: transforms.zero_preserving(x, lambda d: transforms.exp_scaled(d, 2.5))
    return rounded(land.habitat_of(land.least_cost_distance().withColumn("value", near(F.col("value")))))


@landmarks(NPIX)
def inverse_threshold_proximity(spark, sf_dir, npix):
    found = tables.ship_landscape(spark, sf_dir, npix).least_cost_distance()
    return rounded(found.withColumn("value", transforms.inverse_threshold(F.col("value"), 2.0)))


@landmarks(NPIX)
def quality_scaled(spark, sf_dir, npix):
    return rounded(model(spark, sf_dir, npix).quality_scaled(connectivity="survival_probability"), digits=8)


@landmarks(NPIX)
def mean_kl_divergence(spark, sf_dir, npix):
    return rounded(model(spark, sf_dir, npix).mean_kl_divergence())


@landmarks(NPIX)
def lc_kl_divergence(spark, sf_dir, npix):
    return rounded(model(spark, sf_dir, npix).least_cost_kl())


@query
def lc_kl_divergence_cell(spark, sf_dir):
    return rounded(model(spark, sf_dir).least_cost_kl_divergence(16, 6))


@landmarks(NPIX)
def mean_lc_kl_divergence(spark, sf_dir, npix):
    return rounded(model(spark, sf_dir, npix).mean_lc_kl_divergence())


@landmarks(NPIX)
def kl_percentage(spark, sf_dir, npix):
    m = model(spark, sf_dir, npix)
    both = m.mean_kl_divergence().withColumnRenamed("value", "kl").crossJoin(m.mean_lc_kl_divergence().withColumnRenamed("value", "most"))  # one row each
    return rounded(both.select(rsp.kl_percentage(F.col("kl"), F.col("most")).alias("value")))


@landmarks(NPIX)
def habitat_degraded_cell(spark, sf_dir, npix):
    return rounded(model(spark, sf_dir, npix).connected_habitat_degraded(14, 5))


@everywhere(5)
def criticality(spark, sf_dir, npix):
    return rounded(arrays(spark, sf_dir, npix).criticality())


def spectral(spark: SparkSession, sf_dir: str, npix: int | None):
    """By tables; by arrays where every cell is a target, as the other form's check."""
    return model(spark, sf_dir, npix) if npix else arrays(spark, sf_dir, npix)


@landmarks(NPIX)
def eigmax_value(spark, sf_dir, npix):
    return spark.createDataFrame([(spectral(spark, sf_dir, npix).eigmax_value("survival_probability"),)], "value double").withColumn("value", F.round("value", 6))


@landmarks(NPIX)
def eigmax_right(spark, sf_dir, npix):
    """The right vector, its largest entry 1."""
    right = spectral(spark, sf_dir, npix).eigmax_right("survival_probability")
    top = right.agg(F.max("value").alias("top"))  # one row
    return rounded(right.crossJoin(top).select("cell", (F.col("value") / F.col("top")).alias("value")))


@landmarks(NPIX)
def eigmax_left(spark, sf_dir, npix):
    left = spectral(spark, sf_dir, npix).eigmax_left("survival_probability")
    top = left.agg(F.max("value").alias("top"))
    return rounded(left.crossJoin(top).select("cell", (F.col("value") / F.col("top")).alias("value")))


@landmarks(NPIX)
def theta_sweep(spark, sf_dir, npix):
    return rounded(distributed.theta_sweep(tables.ship_landscape(spark, sf_dir, npix), [0.5, 1.0, 2.0]))


@query
def coarseness_corr(spark, sf_dir):
    return rounded(rsp.coarseness_sweep(tables.ship_landscape(spark, sf_dir, None), THETA, [1, 3], kind=DistributedModel, connectivity="survival_probability"), "ratio", "correlation")


@query
def underestimation(spark, sf_dir):
    """By how many percent landmarks fall short of the whole landscape's total habitat."""
    land = tables.ship_landscape(spark, sf_dir, None)
    total = lambda x, name: DistributedModel(x, THETA).connected_habitat("survival_probability").agg(F.sum("value").alias(name))
    both = total(land.with_landmarks(NPIX), "part").crossJoin(total(land, "whole"))  # one row each
    return rounded(both.select(rsp.underestimation(F.col("part"), F.col("whole")).alias("value")))


def summed(spark: SparkSession, sf_dir: str) -> DistributedModel:
    """The model by the series of powers."""
    return DistributedModel(tables.ship_landscape(spark, sf_dir, NPIX), THETA, method="series")


@query
def expected_cost_distributed(spark, sf_dir):
    return rounded(summed(spark, sf_dir).expected_cost())


@query
def connected_habitat_distributed(spark, sf_dir):
    return rounded(summed(spark, sf_dir).connected_habitat("survival_probability"))


@query
def betweenness_q_distributed(spark, sf_dir):
    return rounded(summed(spark, sf_dir).betweenness())


@query
def edge_betweenness_q_distributed(spark, sf_dir):
    return rounded(summed(spark, sf_dir).edge_betweenness())


@landmarks(5)
def theta_calibration(spark, sf_dir, npix):
    """The temperature at which the divergence is what it is at 1, found from the divergence."""
    land = tables.ship_landscape(spark, sf_dir, npix)
    land.edges, land.nodes = written(land.edges, "edges"), written(land.nodes, "nodes")
    theta, kl = distributed.calibrate(land, float(DistributedModel(land, THETA).mean_kl_divergence().first()[0]), 0.5, 2.0)
    return rounded(spark.createDataFrame([(theta, kl)], "theta double, kl double"), "theta", "kl", digits=3)


MEASURES = kernels.MEASURES
