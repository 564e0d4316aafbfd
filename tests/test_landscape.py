"""Golden values, identities and errors of the landscape operators."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from landweave.functions import transforms
from landweave.operators import graph, kernels, raster, rsp
from landweave.operators.landscape import Landscape
from landweave.operators.rsp import RspModel, brandes, calibrate, floyd_warshall, theta_sweep
from landweave.plans.stages import written
from landweave.sources.ascgrid import read_ascgrid


def grid(df):
    return df.toPandas().pivot(index="row", columns="col", values="value")


def square(df):
    return df.toPandas().pivot(index="node", columns="target", values="value").to_numpy()


def made(spark, values):
    return spark.createDataFrame([(r + 1, c + 1, float(v)) for r, line in enumerate(values) for c, v in enumerate(line)], "row int, col int, value double")


def edges(spark, d):
    return spark.createDataFrame([(a, b, float(v)) for (a, b), v in d.items()], "src long, dst long, value double")


@pytest.fixture(scope="module")
def wall(spark):
    q = raster.cells(spark, 30, 60).select("row", "col", (1800 - ((F.col("row") - 1) * 60 + (F.col("col") - 1))).cast("double").alias("value"))
    land = Landscape.wall(spark, 30, 60, corridor_widths=(3, 2), qualities=q)
    land.edges, land.nodes = written(land.edges, "e"), written(land.nodes, "n")
    return land


@pytest.fixture(scope="module")
def small(spark):
    q = raster.cells(spark, 10, 15).select("row", "col", (150 - ((F.col("row") - 1) * 15 + F.col("col") - 1)).cast("double").alias("value"))
    land = Landscape.wall(spark, 10, 15, corridor_widths=(2, 2), qualities=q)
    land.edges, land.nodes = written(land.edges, "e"), written(land.nodes, "n")
    return land


def test_unit_square(spark):
    lattice = raster.lattice(spark, 2, 2, 4)
    land = Landscape.build(spark, 2, 2, lattice, costs=lattice)
    model = RspModel(land, 2.0)
    expected = {
        "free_energy_distance": (0, 1.34197, 2.34197), "expected_cost": (0, 1.01848, 2.01848),
        "survival_probability": (1, 0.0682931, 0.00924246), "power_mean_proximity": (1, 0.261329, 0.0961377),
    }
    for name, (own, near, far) in expected.items():
        want = np.array([[own, near, near, far], [near, own, far, near], [near, far, own, near], [far, near, near, own]])
        assert np.allclose(square(getattr(model, name)()), want, atol=1e-4)
        assert np.allclose(square(getattr(land, name)(theta=2.0)), want, atol=1e-4)


def test_wall_golden(wall):
    model = RspModel(wall, 0.2)
    last = np.lexsort((wall.arrays.src, wall.arrays.dst))[-3:]
    assert wall.arrays.cost[last] == pytest.approx([1.039720770839918, 0.6931471805599453, 0.6931471805599453])
    assert model.graph.pref[last] == pytest.approx([0.10355339059327376, 0.22654091966098644, 0.22654091966098644])
    assert model.graph.w[last] == pytest.approx([0.08411148966019986, 0.19721532522049376, 0.19721532522049376])
    assert model.mean_kl_divergence().first()[0] == pytest.approx(2.4405084252728125e13, rel=1.5e-8)
    assert model.mean_lc_kl_divergence().first()[0] == pytest.approx(1.0667623231698838e14, rel=1.5e-8)
    ec = grid(model.connected_habitat(diagonal=0.0)).loc[28:30, 58:60].to_numpy().T
    assert ec.ravel() == pytest.approx([11082.654882969266, 2664.916100189486, 89.420910249988, 10340.977912804196, 2465.918728844169, 56.970111157896, 11119.132467660969, 2662.969749775032, 33.280379014217])
    fe = grid(model.connected_habitat("free_energy_distance", diagonal=0.0)).loc[28:30, 58:60].to_numpy()
    pm = grid(model.connected_habitat("power_mean_proximity", diagonal=0.0)).loc[28:30, 58:60].to_numpy()
    assert fe.ravel() == pytest.approx([93.0825, 140.907, 362.669, 41.1656, 63.2089, 159.685, 3.65643, 4.04458, 4.23555], rel=1e-3)
    assert np.allclose(fe, pm)


def test_landmark_eigenvalues(wall):
    model = RspModel(wall.with_landmarks(3), 0.2)
    want = {"expected_cost": 2.7249231390873615e7, "free_energy_distance": 2.7217089009360086e7, "survival_probability": 3.0731253357215535e7, "power_mean_proximity": 2.7217089009360246e7}
    for name, value in want.items():
        left, found, right = model.eigmax(name)
        assert found == pytest.approx(value, rel=1.5e-8)
    b = model.proximities("power_mean_proximity")
    node, target = model._qualities()
    scaled = square(b.join(node, "node").join(target, "target").select("node", "target", (F.col("qs") * F.col("value") * F.col("qt")).alias("value")))
    v = right.orderBy("cell").toPandas()["value"].to_numpy()
    at = model.graph.targets
    assert np.allclose(scaled @ v[at], found * v, rtol=1e-7, atol=1e-7 * found * np.abs(v).max())
    u = left.orderBy("cell").toPandas()["value"].to_numpy()
    assert u[at][0] == pytest.approx(1) and np.allclose(u[at] @ scaled[at], found * u[at], rtol=1e-6, atol=1e-6 * found)


def test_flow_with_landmarks(spark, wall):
    def marks(rows, cols):
        return spark.createDataFrame([(r, c, 1800.0 - ((r - 1) * 60 + (c - 1))) for r in rows for c in cols], "row int, col int, value double")

    def land(m):
        return Landscape.build(spark, 30, 60, raster.wall_affinities(spark, 30, 60, corridor_widths=(3, 2)), source_qualities=wall.qs, target_qualities=m, landmarks=True)

    few = land(marks((10, 20), (15, 45)))
    q = grid(RspModel(few, 0.2).betweenness_qweighted()).loc[9:11, 30:32].to_numpy().ravel()
    assert q == pytest.approx([1.35257193796979e9, 1.3112254944853191e9, 1.3525448385844798e9, 1.7383632661402326e9, 1.9571251417867596e9, 1.7385247019409044e9, 1.352382919812123e9, 1.3103077614483771e9, 1.3520848636655023e9])
    k = grid(RspModel(land(marks(range(1, 31, 2), range(1, 61, 2))), 0.2).betweenness_kweighted()).loc[9:11, 30:32].to_numpy().ravel()
    assert k == pytest.approx([1.6153674943888483e6, 693690.2564610258, 1.6097137526944755e6, 1.8168095466336345e6, 1.8166090537379407e6, 1.8108940319968446e6, 1.41753770380708e6, 668884.5700736387, 1.412290291817482e6])
    exact = RspModel(few, 0.2).connected_habitat().toPandas()["value"].to_numpy()
    swept = few.connected_habitat(theta=0.2).toPandas()["value"].to_numpy()
    rough = few.connected_habitat(theta=0.2, approx=True).toPandas()["value"].to_numpy()
    ok = ~np.isnan(exact)
    assert np.allclose(exact[ok], swept[ok], rtol=1e-4)
    assert np.linalg.norm(rough[ok] - exact[ok]) <= 0.8 * max(np.linalg.norm(exact[ok]), np.linalg.norm(rough[ok]))


def test_edge_flow_sums_to_node_flow(small):
    model = RspModel(small, 0.2)
    for edge, node in ((model.edge_betweenness_qweighted(), model.betweenness_qweighted()), (model.edge_betweenness_kweighted(), model.betweenness_kweighted())):
        by_source = edge.groupBy("src").agg(F.sum("value").alias("e")).toPandas().set_index("src")["e"]
        f = node.withColumn("cell", (F.col("col") - 1) * 10 + F.col("row")).toPandas().set_index("cell")["value"]
        assert np.allclose(by_source, f[by_source.index], rtol=1e-9)
    ones = model.betweenness_kweighted(transform=lambda x: np.ones_like(x)).toPandas()["value"]
    assert np.allclose(ones, model.betweenness_qweighted().toPandas()["value"])


def test_cost_table_equals_cost_function(spark, small):
    table = small.edges.select("src", "dst", F.col("cost").alias("value"))
    affinity = small.edges.select("src", "dst", F.col("affinity").alias("value"))
    other = Landscape.build(spark, 10, 15, affinity, qualities=small.qs, costs=table)
    a, b = RspModel(small, 0.2), RspModel(other, 0.2)
    assert np.allclose(a.betweenness_qweighted().toPandas()["value"], b.betweenness_qweighted().toPandas()["value"])
    assert np.allclose(a.connected_habitat().toPandas()["value"], b.connected_habitat(transform="exp_minus").toPandas()["value"])
    assert np.allclose(a.connected_habitat(transform="inv", diagonal=1.0).toPandas()["value"], b.connected_habitat(transform="inv", diagonal=1.0).toPandas()["value"])
    for f in (b.betweenness_kweighted, b.edge_betweenness_kweighted, b.connected_habitat, b.criticality):
        with pytest.raises(ValueError, match="transformation"):
            f()


def test_criticality(small):
    loss = RspModel(small, 0.2).criticality().toPandas()["value"]
    assert loss.min() >= -1e-5 and len(loss) == 150
    one = RspModel(small, 0.2)
    gone = one.connected_habitat_degraded(3, 3).agg(F.sum("value")).first()[0]
    total = one.connected_habitat().agg(F.sum("value")).first()[0]
    assert total - gone == pytest.approx(grid(one.criticality()).loc[3, 3])
    with pytest.raises(ValueError, match="positive"):
        one.criticality(avalue=0.0)


def test_pruning_and_direction(spark):
    doc = raster.raster_graph(made(spark, [[0.25, 0, 0.5, 0.25]] * 4), 4, 4)
    land = Landscape.build(spark, 4, 4, doc)
    assert square(land.least_cost_distance())[0] == pytest.approx([0.0, 0.693147, 1.38629, 2.07944, 0.693147, 1.03972, 1.73287, 2.42602], abs=1e-5)
    whole = Landscape.build(spark, 4, 4, doc, prune=False)
    assert land.is_strongly_connected() and not whole.is_strongly_connected()
    assert {r.cell for r in whole.largest_subgraph().nodes.collect()} == {r.cell for r in land.nodes.collect()}
    assert np.isnan(square(whole.least_cost_distance())[:8, 8:]).all()  # no way, no row
    two = [Landscape.build(spark, 4, 4, raster.raster_graph(made(spark, [[a, 0, 0.25, 0.25]] * 4), 4, 4)) for a in (0.25, 0.0)]
    assert two[0].nodes.count() == two[1].nodes.count() == 8
    a, b = (set(map(tuple, x.edges.collect())) for x in two)
    assert a == b
    n4 = raster.raster_graph(made(spark, [[0.25, 0, 0.5, 0.25]] * 4), 4, 4, 4)
    lc = square(Landscape.build(spark, 4, 4, n4).least_cost_distance())
    assert lc[3, 7] < lc[6, 7]
    half = square(Landscape.build(spark, 4, 4, n4, costs=raster.map_values(n4, lambda v: F.lit(0.5))).least_cost_distance())
    assert half[3, 7] == half[6, 7]


def test_least_cost_kl(spark):
    cost = {(1, 2): 1, (2, 1): 1, (2, 3): 9, (3, 2): 9, (2, 4): 3, (4, 2): 3, (3, 5): 5, (5, 3): 5, (4, 5): 4, (5, 4): 4}
    affinity = {(1, 2): 5, (2, 1): 3, (2, 3): 10, (2, 4): 17, (3, 2): 3, (3, 5): 2, (4, 2): 6, (4, 5): 19, (5, 3): 14, (5, 4): 17}
    land = Landscape.build(spark, 1, 5, edges(spark, affinity), costs=edges(spark, cost))
    want = [
        [0, 0, 1.0986122886681098, 0.5679840376059393, 0.8424208833076996], [2.3025850929940455, 0, 1.0986122886681098, 0.5679840376059393, 0.8424208833076996],
        [2.813410716760036, 0.5108256237659905, 0, 1.5170645923030852, 0.916290731874155], [3.7297014486341915, 1.4271163556401458, 1.069366720571648, 0, 0.2744368457017603],
        [4.330475309063122, 2.027890216069076, 0.7949298748698876, 0.6007738604289302, 0],
    ]
    assert np.allclose(square(RspModel(land, 1.0).least_cost_kl()), want)


def test_least_cost_kl_of_the_wall(spark):
    land = Landscape.build(spark, 30, 60, raster.wall_affinities(spark, 30, 60, corridor_widths=(3, 2)))
    found = grid(RspModel(land, 0.2).least_cost_kl_divergence(25, 50)).loc[10, 10]
    assert found == pytest.approx(80.63375074079197, rel=1.5e-8)


def test_validation(spark):
    four = raster.lattice(spark, 2, 2, 4)
    with pytest.raises(ValueError, match="affinities"):
        Landscape.build(spark, 2, 2)
    with pytest.raises(ValueError, match="incompatible"):
        Landscape.build(spark, 2, 2, raster.lattice(spark, 3, 3))
    with pytest.raises(ValueError, match="incompatible"):
        Landscape.build(spark, 2, 2, four, costs=raster.lattice(spark, 3, 3))
    with pytest.raises(ValueError, match="not present"):
        Landscape.build(spark, 2, 2, four, costs=raster.lattice(spark, 2, 2, 8))
    with pytest.raises(ValueError, match="non-negative"):
        Landscape.build(spark, 2, 2, raster.map_values(four, lambda v: v * 1.1))
    land = Landscape.build(spark, 2, 2, four)
    for bad in (lambda: land.expected_cost(theta=0.0), lambda: land.least_cost_distance(approx=True), lambda: land.least_cost_distance(theta=1.0),
                lambda: raster.raster_graph(four, 2, 2, 5), lambda: raster.raster_graph(four, 2, 2, weight="x"), lambda: transforms.named("x"),
                lambda: land.connected_habitat("x", theta=1.0), lambda: RspModel(land, None), lambda: RspModel(land, 1.0).least_cost_kl_divergence(9, 9)):
        with pytest.raises(ValueError):
            bad()


def test_transforms():
    x = np.array([0.0, 0.25, 0.5, 1.0])
    assert transforms.named("minus_log").array(x)[0] == np.inf and transforms.named("inv").array(x)[0] == np.inf
    for name, t in transforms.REGISTRY.items():
        assert transforms.inverse(t.inverse) == name or name == "inv"
    y = np.array([0.2, 0.7])
    assert np.allclose(transforms.named("exp_minus").array(transforms.named("minus_log").array(y)), y)


def test_random_landscapes_build(spark):
    rng = np.random.default_rng(3)
    r = made(spark, rng.random((4, 4)))
    for name in transforms.REGISTRY:
        a = raster.map_values(raster.raster_graph(r, 4, 4), lambda v: v * 0.4)
        if name != "odds_for":
            assert Landscape.build(spark, 4, 4, a, costs=name).nodes.count() == 16
    land = Landscape.build(spark, 4, 4, raster.raster_graph(r, 4, 4))
    model = RspModel(land, 0.7)
    default, named = (model.betweenness_kweighted(**k).toPandas()["value"] for k in ({}, {"transform": lambda t: np.exp(-t)}))
    assert np.allclose(default, named)
    phi, cost = square(model.free_energy_distance()), square(model.expected_cost())
    assert (phi - cost > -1e-9).all()
    with pytest.raises(ValueError):
        RspModel(land, 1.0).connected_habitat_degraded(9, 1)


def test_solver_blocks_equal_dense():
    rng = np.random.default_rng(5)
    n, cols = 30, np.repeat(np.arange(6), 5)
    pairs = [(i, j) for i in range(n) for j in range(n) if abs(cols[i] - cols[j]) <= 1 and rng.random() < 0.4]
    src, dst = map(np.array, zip(*pairs, strict=True))
    w = rng.random(len(src)) / 20
    dense = np.eye(n)
    dense[src, dst] -= w
    b = rng.random((n, 3))
    for col in (cols, rng.permutation(n)):
        s = kernels.Solver(n, src, dst, w, col)
        assert np.allclose(s.solve(b), np.linalg.solve(dense, b)) and np.allclose(s.solve_transposed(b), np.linalg.solve(dense.T, b))


def test_distributed_solvers_equal_kernels(spark):
    r = made(spark, np.random.default_rng(8).random((3, 3)) / 2 + 0.1)
    land = Landscape.build(spark, 3, 3, raster.map_values(raster.raster_graph(r, 3, 3), lambda v: v * 0.8))
    land.edges, land.nodes = written(land.edges, "e"), written(land.nodes, "n")
    model = RspModel(land, 1.0)
    t = land.targets().where("cell <= 3").select(F.col("cell").alias("target"))
    z = square(graph.neumann(model.walk, t, 64))
    assert np.allclose(z, square(model.fundamental_matrix())[:, :3], rtol=1e-9)
    assert np.allclose(square(graph.least_cost(land.edges, t)), square(land.least_cost_distance())[:, :3])
    cut = edges(spark, {(1, 2): 1, (2, 1): 1, (2, 3): 1, (3, 4): 1, (4, 3): 1, (5, 1): 1})
    assert {tuple(x) for x in graph.strong_components(cut).collect()} == {tuple(x) for x in graph.strong_components_by_colour(cut).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)}


def test_neumann_has_every_node_and_settles(spark):
    def walk(pairs, theta):
        d = [(i, j, 0.5**theta / len(near)) for i, near in pairs.items() for j in near]
        return written(spark.createDataFrame(d, "src long, dst long, w double"), "w"), np.linalg.inv(np.eye(len(pairs)) - sum(v * np.outer(np.arange(len(pairs)) == i, np.arange(len(pairs)) == j) for i, j, v in d))

    corner = spark.createDataFrame([(0,)], "target long")
    corridor = {i: [j for j in (i - 1, i + 1) if 0 <= j < 140] for i in range(140)}
    block = {5 * r + c: [5 * a + b for a in range(5) for b in range(5) if abs(a - r) + abs(b - c) == 1] for r in range(5) for c in range(5)}
    for pairs, theta in ((corridor, 1.0), (corridor, 0.01), (block, 0.01)):
        w, want = walk(pairs, theta)
        got = graph.neumann(w, corner).orderBy("node").toPandas()
        assert list(got["node"]) == list(range(len(pairs)))
        assert np.allclose(got["value"], want[:, 0], rtol=1e-9, atol=0)
    with pytest.raises(RuntimeError, match="settle"):
        graph.neumann(w, corner, 128)


def test_tiny_weights_stay_finite(spark):
    r = made(spark, np.full((12, 12), 1e-6))
    land = Landscape.build(spark, 12, 12, raster.raster_graph(r, 12, 12), target_qualities=made(spark, [[1.0]]), landmarks=True)
    flow = RspModel(land, 2.5).betweenness_qweighted().toPandas()["value"]
    assert np.isfinite(flow).all() and (flow >= -1e-9).all()


def test_sweeps_and_composites(spark, small):
    got = theta_sweep(small, [0.1, 0.2]).where("theta = 0.2").drop("theta").orderBy("col", "row").toPandas()["value"]
    assert np.allclose(got, RspModel(small, 0.2).betweenness_qweighted().orderBy("col", "row").toPandas()["value"])
    open_ = Landscape.build(spark, 3, 4, raster.map_values(raster.lattice(spark, 3, 4), lambda v: v * 0.5))
    assert np.allclose(square(floyd_warshall(open_)), square(floyd_warshall(open_)).T)
    b = grid(brandes(open_)).to_numpy()
    assert np.allclose(b, b[::-1]) and np.allclose(b, b[:, ::-1])
    want = RspModel(open_, 0.8).mean_kl_divergence().first()[0]
    theta, kl = calibrate(open_, want, rounds=18)
    assert kl == pytest.approx(want, rel=1e-2)
    assert "3 x 4" in repr(open_) and "theta" in RspModel(open_, 1.0)._repr_html_()
    assert not RspModel(open_, 1.0).underflow()


def test_solver_takes_the_shorter_side():
    rng = np.random.default_rng(5)
    for nrows, ncols in ((9, 4), (4, 9), (1, 7), (7, 1)):
        row, col = (x.ravel() for x in np.meshgrid(np.arange(nrows), np.arange(ncols), indexing="ij"))
        near = np.argwhere((np.abs(row[:, None] - row) <= 1) & (np.abs(col[:, None] - col) <= 1) & (rng.random((row.size, row.size)) < 0.9))
        src, dst = near.T
        w = rng.random(len(src)) / 10
        a = np.eye(row.size)
        np.subtract.at(a, (src, dst), w)
        s, b = kernels.Solver(row.size, src, dst, w, col, row), rng.random((row.size, 3))
        assert max(len(i) for i in s.inv) == min(nrows, ncols)
        assert np.allclose(s.solve(b), np.linalg.solve(a, b)) and np.allclose(s.solve_transposed(b), np.linalg.solve(a.T, b))
    s = kernels.Solver(row.size, np.array([0]), np.array([6]), np.array([0.5]), np.arange(7))  # no lattice
    assert len(s.inv) == 1 and s.solve(np.eye(7))[0, 6] == 0.5


def test_solver_is_bounded(monkeypatch):
    monkeypatch.setattr(kernels, "SOLVER_BYTES", 8 * 16 * 3)
    i = np.arange(16)
    kernels.Solver(16, i[:-1], i[1:], np.full(15, 0.1), i // 2)
    with pytest.raises(ValueError, match="DistributedModel"):
        kernels.Solver(16, i[:-1], i[1:], np.full(15, 0.1), i // 8)


@pytest.mark.parametrize("method", ["dissection", "series"])
def test_distributed_model(spark, method):
    """By tables alone, at a low temperature too."""
    from landweave.operators.distributed import DistributedModel

    q = raster.cells(spark, 3, 4).select("row", "col", (F.col("cell") / 10).alias("value"))
    land = Landscape.build(spark, 3, 4, raster.map_values(raster.lattice(spark, 3, 4), lambda v: v * 0.5), qualities=q)
    theta = 0.05
    one, two = RspModel(land, theta), DistributedModel(land, theta, method=method, tile=1)
    for name in ("expected_cost", "free_energy_distance", "power_mean_proximity"):
        a = {(r.node, r.target): r.value for r in getattr(one, name)().collect()}
        b = {(r.node, r.target): r.value for r in getattr(two, name)().collect()}
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) <= 1e-7 * max(1, abs(a[k])) for k in a)
    near = lambda x, y: np.allclose(x.orderBy("row", "col").toPandas()["value"], y.orderBy("row", "col").toPandas()["value"], rtol=1e-6)
    assert near(one.connected_habitat(diagonal=0.0), two.connected_habitat(diagonal=0.0))
    assert near(one.betweenness_kweighted(), two.betweenness("expected_cost"))
    assert one.mean_kl_divergence().first()[0] == pytest.approx(two.mean_kl_divergence().first()[0], rel=1e-5)
    edges = lambda df: {(r.src, r.dst): r.value for r in df.collect()}
    a, b = edges(one.edge_betweenness_qweighted()), edges(two.edge_betweenness())
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) <= 1e-6 * max(1, abs(a[k])) for k in a)


def test_impassable_landscape(spark):
    land = Landscape.build(spark, 3, 5, raster.map_values(raster.lattice(spark, 3, 5), lambda v: v * 0.5))
    wall = spark.createDataFrame([(r, 3) for r in (1, 2, 3)], "row int, col int")
    closed = land.impassable(wall)
    for e in closed.edges.collect():
        hit = 7 <= e.src <= 9 or 7 <= e.dst <= 9
        assert e.affinity == (1e-20 if hit else pytest.approx(e.affinity)) and (not hit or e.cost == pytest.approx(-np.log(1e-20)))
    assert {r.cell: (r.qs, r.qt) for r in closed.nodes.collect()} == {k: (0.0, 0.0) if 7 <= k <= 9 else (1.0, 1.0) for k in range(1, 16)}
    cut = land.impassable(wall, affinity=0.0)  # both halves have six cells; that of the least cell stays
    assert sorted(r.cell for r in cut.nodes.collect()) == [1, 2, 3, 4, 5, 6]


def test_directed_costs_have_no_undirected_view(spark):
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.1)], "src long, dst long, value double")
    land = Landscape.build(spark, 2, 1, edges)
    for f in (rsp.floyd_warshall, rsp.brandes):
        with pytest.raises(ValueError, match="direction"):
            f(land)


def test_sweeps_end_with_an_error(spark):
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5), (2, 3, 0.5)], "src long, dst long, value double")  # 3 has no way back
    g = Landscape.build(spark, 3, 1, edges, prune=False).arrays
    g.theta = 1.0
    with pytest.raises(ValueError, match="successor"):
        kernels.sweep_distances(g, 0)
    h = Landscape.build(spark, 2, 1, edges.where("dst < 3")).arrays
    h.theta = 1.0
    with pytest.raises(RuntimeError, match="settle"):
        kernels.sweep_distances(h, 0, most=1)


def test_landscape_of_parts_grows(spark):
    from landweave.plans import queries, tables

    sizes = []
    for sf in ("sf0.001", "sf0.01"):
        land = tables.parts_landscape(spark, f"/root/testdata/{sf}")
        sizes.append(land.nrows)
    assert sizes[1] > 2 * sizes[0]
    g = tables.parts_landscape(spark, "/root/testdata/sf0.001").arrays
    w = np.zeros((g.n, g.n))
    w[g.src, g.dst] = g.pref * np.exp(-g.cost)
    z = np.linalg.inv(np.eye(g.n) - w)[:, g.targets]
    want = g.qs * ((z / z[g.targets, np.arange(len(g.targets))]) @ g.qt[g.targets])
    got = queries.registry()["parts_habitat"](spark, "/root/testdata/sf0.001").where("value is not null and not isnan(value)").orderBy("col", "row").toPandas()["value"]
    assert np.allclose(got, want)


def test_components_of_long_and_mixed_graphs(spark):
    rng = np.random.default_rng(3)
    corridor = [(k, k + 1) for k in range(1, 400)] + [(k + 1, k) for k in range(1, 400)]
    one_way = [(400, 500), (500, 501), (501, 502), (502, 500), (502, 600), (600, 601), (601, 600), (600, 600), (700, 700)]
    mixed = [(int(a) + 1000, int(b) + 1000) for a, b in rng.integers(0, 16, (24, 2))]
    cut = spark.createDataFrame(corridor + one_way + mixed + corridor[:5], "src long, dst long")
    want = {tuple(x) for x in graph.strong_components(cut).collect()}
    got = graph.strong_components_by_colour(cut).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert {c for n, c in want if n <= 400} == {1} and (601, 600) in want and (700, 700) in want
    assert graph.strong_components_by_colour(cut.limit(0)).isEmpty()


@pytest.mark.skipif("GRID_AFFINITIES" not in os.environ, reason="GRID_AFFINITIES and GRID_QUALITIES name no 44 x 59 rasters")
def test_real_rasters_golden(spark):
    aff, meta = read_ascgrid(spark, os.environ["GRID_AFFINITIES"])
    own, _ = read_ascgrid(spark, os.environ["GRID_QUALITIES"])
    tiny = aff.where("value > 0").select("row", "col", F.lit(1e-20).alias("tiny"))
    q = own.join(tiny, ["row", "col"], "full").select("row", "col", F.coalesce("value", "tiny").alias("value"))
    model = RspModel(Landscape.build(spark, meta.nrows, meta.ncols, raster.raster_graph(aff, meta.nrows, meta.ncols), qualities=q), 0.1)
    g = model.graph
    last = np.lexsort((g.src, g.dst))[-3:]
    assert g.pref[last] == pytest.approx([0.00031266870414554466, 0.00018055948867712768, 0.0001228960184654185])
    assert g.w[last] == pytest.approx([5.521044625610329e-5, 3.300719810371289e-5, 2.1700745653826738e-5])
    assert model.mean_kl_divergence().first()[0] == pytest.approx(323895.3828183995, rel=1.5e-8)
    assert model.mean_lc_kl_divergence().first()[0] == pytest.approx(1.5660600315073947e6, rel=1.5e-8)
    flow = grid(model.betweenness_qweighted()).loc[21:23, 21:23].to_numpy()
    assert flow.ravel() == pytest.approx([1930.1334372152335, 256.91061166392745, 2866.2998374065373, 4911.996715311025, 1835.991238248377, 720.755518530375, 4641.815380725279, 3365.3296878569213, 477.1085971945757], rel=1.5e-8)
    flow = grid(model.betweenness_kweighted(transform=lambda t: np.exp(-t / 50))).loc[21:23, 31:33].to_numpy()
    assert flow.ravel() == pytest.approx([980.5828087688377, 1307.981162399926, 1602.8445739784497, 826.0710054834001, 1883.0940077789735, 1935.4450344630702, 676.9212075214159, 2228.2700913772774, 2884.0409495023364], rel=1.5e-8)
    degraded = model.connected_habitat_degraded(20, 20).agg(F.sum("value")).first()[0]
    assert degraded == pytest.approx(109.4795495188798, rel=1.5e-8)
