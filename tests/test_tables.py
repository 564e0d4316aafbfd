"""The table forms: separator tree, tiles, trees of least cost, chains, summed areas."""

import re
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from landweave.operators import dissection, distributed, graph, kernels, landscape, raster, rsp, spectrum, tiles
from landweave.operators.distributed import DistributedModel
from landweave.operators.landscape import Landscape
from landweave.operators.rsp import RspModel
from landweave.plans.stages import keep, scope, scratch, written


def lattice(rng, nrows, ncols, theta, reach=1, missing=0.1):
    """(src, dst, cost, pref, w) of a random raster graph."""
    aff, src, dst = [], [], []
    for r in range(nrows):
        for c in range(ncols):
            for a in range(-reach, reach + 1):
                for b in range(-reach, reach + 1):
                    if (a or b) and 0 <= r + a < nrows and 0 <= c + b < ncols and rng.random() > missing:
                        src.append(c * nrows + r + 1)
                        dst.append((c + b) * nrows + r + a + 1)
                        aff.append(rng.uniform(0.05, 0.5))
    src, dst, aff = np.array(src), np.array(dst), np.array(aff)
    pref = aff / np.bincount(src, weights=aff)[src]
    cost = -np.log(aff)
    return src, dst, cost, pref, pref * np.exp(-theta * cost)


def frame(spark, names, *columns):
    kinds = {"src": "long", "dst": "long", "node": "long", "target": "long", "parent": "long"}
    return spark.createDataFrame([tuple(x) for x in zip(*[c.tolist() for c in columns], strict=True)], ", ".join(f"{n} {kinds.get(n, 'double')}" for n in names.split()))


def dense(df, n, targets):
    got = df.toPandas()
    assert not got.duplicated(["node", "target"]).any()
    out = np.zeros((n, len(targets)))
    out[got.node.to_numpy() - 1, [targets.index(t) for t in got.target]] = got.value
    return out


@pytest.mark.parametrize(("nrows", "ncols", "tile", "reach", "theta"), [(13, 9, 3, 1, 1.0), (14, 11, 4, 2, 0.01)])
def test_separator_tree_equals_the_inverse(spark, monkeypatch, nrows, ncols, tile, reach, theta):
    rng = np.random.default_rng(nrows)
    src, dst, _, _, w = lattice(rng, nrows, ncols, theta, reach)
    n = nrows * ncols
    a = np.eye(n)
    a[src - 1, dst - 1] -= w
    tree = dissection.Dissection(frame(spark, "src dst w", src, dst, w), nrows, ncols, tile)
    assert tree.grid.top > 0 and tree.grid.reach == reach
    targets = sorted({1, n // 3, n // 2, n})
    rhs = np.zeros((n, len(targets)))
    rhs[[t - 1 for t in targets], range(len(targets))] = 1.0
    rhs[n // 4, 0] -= 2.5
    i, j = np.nonzero(rhs)
    start = frame(spark, "node target value", i + 1, np.array(targets)[j], rhs[i, j])
    monkeypatch.setattr(dissection, "COLUMNS", 3)  # two blocks of targets
    for transposed in (False, True):
        want = np.linalg.solve(a.T if transposed else a, rhs)
        assert np.allclose(dense(tree.solve(start, transposed), n, targets), want, rtol=1e-9, atol=1e-13)
    tree.discard()


def test_separator_tree_of_odd_graphs(spark):
    w = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.25), (8, 8, 0.5), (5, 6, 0.0)], "src long, dst long, w double")
    tree = dissection.Dissection(w, 3, 3, 1)
    start = spark.createDataFrame([(2, 7, 1.0), (8, 8, 1.0), (9, 7, 3.0)], "node long, target long, value double")
    got = {(r.node, r.target): r.value for r in tree.solve(start).collect()}
    assert got == {(1, 7): pytest.approx(4 / 7), (2, 7): pytest.approx(8 / 7), (8, 8): 2.0, (9, 7): 3.0}  # cell 9 has no edges
    assert tree.solve(start.limit(0)).collect() == []
    far = spark.createDataFrame([(1, 9, 0.5)], "src long, dst long, w double")
    tree = dissection.Dissection(far, 3, 3, 1)  # its tiles are larger
    assert tree.grid.tile == 2
    assert {r.node: r.value for r in tree.solve(spark.createDataFrame([(9, 9, 1.0)], "node long, target long, value double")).collect()} == {1: 0.5, 9: 1.0}


def graph_of(n, src, dst, cost, pref):
    by = np.lexsort((dst, src))
    none = np.zeros(0)
    return kernels.Graph(np.arange(1, n + 1), none, none, none, none, src[by] - 1, dst[by] - 1, none, cost[by], pref[by])


@pytest.mark.parametrize(("nrows", "ncols", "tile", "reach"), [(9, 7, 3, 1), (7, 9, 2, 3)])
def test_least_costs_and_trees(spark, monkeypatch, nrows, ncols, tile, reach):
    rng = np.random.default_rng(tile)
    src, dst, cost, pref, _ = lattice(rng, nrows, ncols, 1.0, reach, 0.3)
    n = nrows * ncols
    into = dst != n  # the last cell can't be reached
    src, dst, cost, pref = src[into], dst[into], cost[into], pref[into]
    monkeypatch.setattr(tiles, "BLOCK", 5)
    targets = list(range(1, n + 1, 4))
    edges = frame(spark, "src dst cost", src, dst, cost)
    marks = frame(spark, "target", np.array(targets))
    dist = written(tiles.Tiles(edges, nrows, ncols, tile).least_costs(marks), "dist")
    g = graph_of(n, src, dst, cost, pref)
    want = np.stack([kernels.dijkstra(g, t - 1)[0] for t in targets], axis=1)
    assert dist.count() == np.isfinite(want).sum()
    assert np.allclose(dense(dist, n, targets), np.where(np.isfinite(want), want, 0.0), rtol=1e-12)
    steps = frame(spark, "node parent pref", src, dst, pref)
    tree = tiles.parents(edges, dist).join(steps, ["node", "parent"], "left").withColumn("value", F.coalesce(-F.ln("pref"), F.lit(float("inf"))))
    kl = np.stack([kernels.least_cost_kl(g, t - 1, "least") for t in targets], axis=1)
    got = tiles.summed_up(tree, marks).toPandas()
    assert len(got) == (~np.isnan(kl)).sum()
    assert np.allclose(got.value, kl[got.node - 1, [targets.index(t) for t in got.target]])


def test_edges_of_no_cost_have_no_tree(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.0), (3, 2, 0.0)], "src long, dst long, cost double")
    dist = tiles.Tiles(edges, 3, 1).least_costs(spark.createDataFrame([(1,)], "target long"))
    assert sorted(map(tuple, dist.collect())) == [(1, 1, 0.0), (2, 1, 1.0), (3, 1, 1.0)]
    circle = spark.createDataFrame([(2, 1, 3, 1.0), (3, 1, 2, 1.0)], "node long, target long, parent long, value double")
    with pytest.raises(ValueError, match="circle"):
        tiles.summed_up(circle, spark.createDataFrame([(1,)], "target long"), rounds=6)


@pytest.fixture(scope="module")
def land(spark):
    rng = np.random.default_rng(4)
    cells = [(r, c, float(rng.uniform(0.1, 0.5))) for r in range(1, 6) for c in range(1, 5)]
    r = spark.createDataFrame(cells, "row int, col int, value double")
    one = Landscape.build(spark, 5, 4, raster.raster_graph(r, 5, 4), qualities=r)
    one.edges, one.nodes = written(one.edges, "e"), written(one.nodes, "n")
    return one


def pairs(df):
    return {tuple(r)[:-1]: r[-1] for r in df.collect()}


def alike(a, b, rel=1e-8):
    a, b = pairs(a), pairs(b)
    assert a.keys() == b.keys()
    assert all(a[k] is None and b[k] is None or b[k] == pytest.approx(a[k], rel=rel, abs=1e-12) for k in a)


def test_model_by_tables_equals_arrays(land):
    one, two = RspModel(land, 0.3), DistributedModel(land, 0.3, tile=2)
    for name in ("fundamental_matrix", "expected_cost", "free_energy_distance", "survival_probability", "power_mean_proximity", "betweenness_qweighted", "edge_betweenness_kweighted", "mean_kl_divergence", "quality_scaled"):
        alike(getattr(one, name)(), getattr(two, name)())
    alike(one.betweenness_kweighted("survival_probability", diagonal=0.0), two.betweenness_kweighted("survival_probability", diagonal=0.0))
    for name in kernels.MEASURES:
        alike(one.connected_habitat(name), two.connected_habitat(name))
    alike(one.least_cost_kl("least"), two.least_cost_kl())
    alike(one.least_cost_kl_divergence(3, 2, "least"), two.least_cost_kl_divergence(3, 2))
    alike(one.mean_lc_kl_divergence("least"), two.mean_lc_kl_divergence())
    alike(one.connected_habitat_degraded(3, 2), two.connected_habitat_degraded(3, 2))
    assert not two.underflow() and "theta 0.3" in repr(two) and rsp.unwrapped(two) is land and rsp.unwrapped(land) is land
    for bad in (lambda: two.degraded(9, 9), lambda: two.degraded(3, 2, affinity=0.0), lambda: two.least_cost_kl_divergence(9, 9), lambda: two.proximities("x"), lambda: DistributedModel(land, 1.0, method="x")):
        with pytest.raises(ValueError):
            bad()


def test_calibration(land):
    want = DistributedModel(land, 0.7).mean_kl_divergence().first()[0]
    theta, kl = distributed.calibrate(land, want, 0.05, 2.0)
    assert theta == pytest.approx(0.7, rel=1e-5) and kl == pytest.approx(want, rel=1e-6)
    with pytest.raises(ValueError, match="no temperature"):
        distributed.calibrate(land, 1e9, 0.05, 2.0)
    with pytest.raises(ValueError, match="positive"):
        distributed.calibrate(land, 0.0)


def test_distances_without_a_model(land):
    for name in ("expected_cost", "free_energy_distance", "survival_probability"):
        alike(getattr(land, name)(theta=0.5, tol=1e-13), getattr(land, name)(theta=0.5), rel=1e-6)


def test_sweep_by_tables(land):
    alike(rsp.theta_sweep(land, [0.2, 0.5]), distributed.theta_sweep(land, [0.2, 0.5]))


def test_undirected_views(spark):
    rng = np.random.default_rng(2)
    r = spark.createDataFrame([(a, b, float(rng.choice([0.25, 0.5]))) for a in range(1, 5) for b in range(1, 5)], "row int, col int, value double")
    even = Landscape.build(spark, 4, 4, raster.raster_graph(r, 4, 4, 4, weight="average"))  # many ties
    alike(rsp.brandes(even), distributed.brandes(even))
    d = dense(distributed.floyd_warshall(even), 16, list(range(1, 17)))
    assert np.allclose(d, d.T) and (d > 0).sum() == 16 * 15
    with pytest.raises(ValueError, match="direction"):
        distributed.brandes(Landscape.build(spark, 2, 1, spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.1)], "src long, dst long, value double")))


def components(pairs_):
    ids = sorted({x for p in pairs_ for x in p})
    at = {x: k for k, x in enumerate(ids)}
    found = kernels.strong_components(len(ids), np.array([at[a] for a, _ in pairs_], int), np.array([at[b] for _, b in pairs_], int))
    return {(x, ids[f]) for x, f in zip(ids, found, strict=True)}


def test_components_with_chains_rings_and_ends(spark):
    rng = np.random.default_rng(1)
    edges = [(k, k + 1) for k in range(1, 300)]  # a long chain
    edges += [(1000 + k, 1000 + (k + 1) % 37) for k in range(37)] + [(300, 1005)]  # a ring behind it
    edges += [(2000 + k, 2000 + k + 1) for k in range(20)] + [(2020, 2000), (2010, 2500), (2500, 2501), (2501, 2003)]  # a ring with a handle
    edges += [(int(a) + 3000, int(b) + 3000) for a, b in rng.integers(0, 40, (60, 2))]
    edges += [(5000, 5001), (5001, 5002), (5002, 5000), (5002, 5003), (7000, 7000), (2003, 3000)]
    df = spark.createDataFrame(edges, "src long, dst long")
    want = components(edges)
    for found in (graph.strong_components(df), graph.strong_components(df, part=7)):
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(want) and set(got) == want
    assert graph.strong_components(df.limit(0)).collect() == []


def test_a_long_directed_path_takes_few_rounds(spark):
    path = spark.range(1, 5_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = graph.strong_components_by_colour(path)
    assert found.where("node <> component").isEmpty() and found.count() == 5_000


def test_summed_areas(spark):
    rng = np.random.default_rng(6)
    values = rng.random((7, 5))
    values[2, 3] = np.nan
    q = spark.createDataFrame([(r + 1, c + 1, float(values[r, c])) for r in range(7) for c in range(5) if (r, c) != (4, 4)], "row int, col int, value double")
    known = np.nan_to_num(values)
    known[4, 4] = 0.0
    for p in (1, 2, 3, 9):
        lo, hi = p // 2, -(-p // 2)
        got = pairs(raster.neighborhood_sums(q, 7, 5, p))
        assert got == {(r + 1, c + 1): pytest.approx(known[max(0, r - lo) : r + hi, max(0, c - lo) : c + hi].sum()) for r in range(7) for c in range(5)}
        assert got[3, 4] == pytest.approx(raster.neighborhood_sum(q, 3, 4, p).first()[0])
    every = raster.coarse_grainings(q, 7, 5, [1, 2, 3, 6])
    for p in (1, 2, 3, 6):
        alike(raster.coarse_graining(q, 7, 5, p), every.where(F.col("npix") == p).drop("npix"))
    for bad in (lambda: raster.neighborhood_sums(q, 7, 5, 0), lambda: raster.coarse_grainings(q, 7, 5, [0])):
        with pytest.raises(ValueError):
            bad()


def test_scopes_remove_what_was_written_inside(spark):
    import os

    here = lambda df: os.path.exists(df._landweave_path.removeprefix("file://"))
    with scope(spark):
        gone, stays = written(spark.range(3), "a"), written(spark.range(4), "b")
        with scope(spark):
            inner, lifted = written(spark.range(5), "c"), keep(written(spark.range(6), "d"))
        assert not here(inner) and here(lifted)
        assert keep(stays).count() == 4
        assert here(gone)
    assert not here(gone) and not here(lifted) and here(stays)
    assert scratch(spark, "x") != scratch(spark, "x")


def matrix(spark, a):
    i, j = np.nonzero(a)
    return frame(spark, "node target value", i + 1, j + 1, a[i, j]), spark.range(1, len(a) + 1).toDF("cell")


def perron(a):
    values, vectors = np.linalg.eig(a)
    k = np.argmax(values.real)
    return values[k].real, np.abs(vectors[:, k].real)


def test_dominant_vector_of_a_table(spark):
    rng = np.random.default_rng(4)
    a = rng.random((7, 7)) * (rng.random((7, 7)) < 0.7)
    pairs, cells = matrix(spark, a)
    for size in (30, 4):  # with and without restarts
        value, v = spectrum.dominant(pairs, cells, size=size)
        want, vector = perron(a)
        assert value == pytest.approx(want, rel=1e-9)
        assert np.allclose(v.orderBy("cell").toPandas()["value"], vector, atol=1e-8)
    value, v = spectrum.dominant(pairs, cells, "target", "node")
    assert np.allclose(v.orderBy("cell").toPandas()["value"], perron(a.T)[1], atol=1e-8)


def test_dominant_vector_of_odd_tables(spark):
    pairs, cells = matrix(spark, np.array([[2.0]]))
    value, v = spectrum.dominant(pairs, cells)
    assert value == 2 and [tuple(r) for r in v.collect()] == [(1, 1.0)]
    with pytest.raises(ValueError, match="positive"):
        spectrum.dominant(pairs.limit(0), cells)
    with pytest.raises(ValueError, match="no cells"):
        spectrum.dominant(pairs, cells.limit(0))
    pairs, cells = matrix(spark, np.array([[0.0, 1.0], [1.0, 0.0]]))  # the ones are an eigenvector already; -1 is as large
    value, v = spectrum.dominant(pairs, cells)
    assert value == pytest.approx(1) and np.allclose(v.toPandas()["value"], 0.5**0.5)
    rng = np.random.default_rng(1)
    pairs, cells = matrix(spark, np.diag(np.linspace(0.9999, 1, 40)) + 1e-6 * rng.random((40, 40)))
    with pytest.raises(RuntimeError, match="settle"):
        spectrum.dominant(pairs, cells, size=2, restarts=2)


def test_eigenvectors_of_two_nearly_equal_patches(spark):
    values = np.full((3, 9), 0.3)
    values[:, 3:6] = 1e-4
    quality = np.ones((3, 9))
    quality[:, 3:6] = 1e-3
    quality[:, 6:] = 0.9999
    made = lambda v: spark.createDataFrame([(r + 1, c + 1, float(v[r, c])) for r, c in np.ndindex(*v.shape)], "row int, col int, value double")
    land = Landscape.build(spark, 3, 9, raster.raster_graph(made(values), 3, 9), qualities=made(quality))
    land.edges, land.nodes = written(land.edges, "e"), written(land.nodes, "n")
    old = RspModel(land, 1.0)
    got = old.quality_scaled(connectivity="survival_probability").toPandas()
    a = got.pivot(index="node", columns="target", values="value").to_numpy()
    spread = np.sort(np.linalg.eigvals(a).real)
    assert 0.999 < spread[-2] / spread[-1] < 1
    value, right = perron(a)
    left = perron(a.T)[1]
    for l, v, r in (DistributedModel(land, 1.0).eigmax("survival_probability"), old.eigmax("survival_probability")):
        assert v == pytest.approx(value, rel=1e-9)
        assert np.allclose(r.orderBy("cell").toPandas()["value"], right, atol=1e-8)
        assert np.allclose(l.orderBy("cell").toPandas()["value"], left / left[0], rtol=1e-7, atol=1e-8)


def test_eigenvectors_with_landmarks(spark):
    rng = np.random.default_rng(7)
    made = spark.createDataFrame([(r, c, float(rng.uniform(0.1, 0.9))) for r in range(1, 8) for c in range(1, 8)], "row int, col int, value double")
    land = Landscape.build(spark, 7, 7, raster.raster_graph(made, 7, 7), qualities=made).with_landmarks(3)
    land.edges, land.nodes = written(land.edges, "e"), written(land.nodes, "n")
    model, old = DistributedModel(land, 0.5), RspModel(land, 0.5)
    left, value, right = model.eigmax()
    l2, v2, r2 = old.eigmax()
    assert value == pytest.approx(v2, rel=1e-9)
    for mine, other in ((left, l2), (right, r2)):
        a, b = mine.orderBy("cell").toPandas(), other.orderBy("cell").toPandas()
        assert list(a["cell"]) == list(b["cell"]) and np.allclose(a["value"], b["value"], rtol=1e-7, atol=1e-9)


def test_separator_tree_is_balanced():
    """The parts' raster at 6 GB: without balance the second level's front had 8,449 cells, more than a task takes."""
    for nrows, ncols, reach in ((2684, 2684, 1), (1096, 1096, 1), (3000, 40, 1), (35, 34, 2), (34, 10, 1)):
        grid = dissection.Grid(nrows, ncols, 32, reach)
        assert reach <= grid.tile <= 32
        longest = max(nrows, ncols)
        side = grid.pitch << grid.top
        assert longest <= side - reach and side < longest + reach + (1 << grid.top)
        assert 4 * (side >> 1) * reach < dissection.FRONT  # two lines across a quarter of the raster and two beside it
        cell = np.arange(1, nrows * ncols + 1)
        assert grid.level(cell).max() == grid.top


@pytest.mark.parametrize("reach", [1, 2])
def test_strips_equal_the_inverse(reach):
    rng = np.random.default_rng(reach)
    src, dst, _, _, w = lattice(rng, 7, 9, 0.5, reach)
    a = np.eye(63)
    a[src - 1, dst - 1] -= w
    b = rng.normal(size=(63, 4))
    strips = dissection.Strips(a, [*range(0, 63, 7 * reach), 63])
    assert np.allclose(strips.solve(b), np.linalg.solve(a, b)) and np.allclose(strips.solve(b, True), np.linalg.solve(a.T, b))


@pytest.mark.parametrize(("connectivity", "diagonal"), [(None, None), ("survival_probability", 0.0)])
def test_flow_has_a_row_for_each_cell(spark, monkeypatch, connectivity, diagonal):
    """One row for each cell and block of targets, not for each pair, enters a solve; the flow is that of the pairs."""
    cells = spark.createDataFrame([(r, c, 0.1 + (r * 7 + c * 3) % 5 / 12) for r in range(1, 7) for c in range(1, 6)], "row int, col int, value double")
    land = Landscape.build(spark, 6, 5, raster.raster_graph(cells, 6, 5), qualities=cells)
    model = distributed.DistributedModel(land, 1.0)
    pairs = model._adjoint(model.proximities(connectivity, None, diagonal) if connectivity else None)
    want = {r.cell: r.v for r in pairs.groupBy(F.col("node").alias("cell")).agg(F.sum(F.col("x") * F.col("z")).alias("v")).collect()}
    monkeypatch.setattr(dissection, "COLUMNS", 16)  # two blocks of targets
    taken, columns = [], dissection.Dissection.columns
    monkeypatch.setattr(dissection.Dissection, "columns", lambda self, rows, *rest, **more: taken.append(rows.count()) or columns(self, rows, *rest, **more))
    got = {(r.col - 1) * 6 + r.row: r.value for r in model.betweenness(connectivity, diagonal=diagonal).collect()}
    assert got == pytest.approx(want, rel=1e-9, abs=1e-12)
    assert taken == [16, 30 + 16, 14, 30 + 14]


def test_calibration_takes_few_rounds(monkeypatch):
    """Four temperatures at once, then few one after another."""
    tried, together = [], threading.Barrier(4, timeout=20)

    class Stub:
        def __init__(self, land, theta):
            self.theta = theta

        def mean_kl_divergence(self):
            tried.append(self.theta)
            if len(tried) <= 4:
                together.wait()
            return self

        def first(self):
            return [5 * self.theta**-1.7 * np.exp(-0.4 * self.theta) + 0.01]

    monkeypatch.setattr(distributed, "DistributedModel", Stub)
    theta, _ = distributed.calibrate(None, 5 * np.exp(-0.4) + 0.01, 0.5, 2.0)
    assert theta == pytest.approx(1.0, abs=1e-6) and len(tried) <= 7


def test_no_table_that_grows_is_broadcast(spark, monkeypatch):
    """Well compressed files look small to Spark: what has a row for each cell or edge has to be joined by merge, or it goes through the driver."""
    cells = spark.createDataFrame([(r, c, 0.1 + (r * 7 + c * 3) % 5 / 12) for r in range(1, 9) for c in range(1, 8)], "row int, col int, value double")
    plans = []

    def noted(df, tag, write=written):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag)

    for module in (landscape, graph, dissection, distributed):
        monkeypatch.setattr(module, "written", noted)
    marks = raster.coarse_graining(cells, 8, 7, 3)
    land = Landscape.build(spark, 8, 7, raster.raster_graph(written(cells, "cells"), 8, 7), qualities=written(cells, "cells"), target_qualities=marks, landmarks=True)
    flow = distributed.DistributedModel(land, 1.0, tile=3).betweenness()
    plans.append(flow._jdf.queryExecution().executedPlan().toString())
    assert flow.where("value > 0").count() > 50
    joins = {(re.sub(r"#\d+L?", "", keys).split(",")[0], kind) for p in plans for keys, kind in re.findall(r"BroadcastHashJoin \[([^\]]*)\], \[[^\]]*\], (\w+)", p)}
    # blocks, the one largest component, a block of targets
    assert joins and {key for key, _ in joins if key != "root"} <= {"br", "component", "target", "n", "cell"} and ("root", "LeftOuter") not in joins
    on_cells = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin [cell#" in line]
    assert len(on_cells) <= 1  # the marks of a block of targets


@pytest.mark.parametrize(("front", "patch", "together"), [(8000, 3, 2), (10, 4, 32)])
def test_least_costs_by_the_tree_and_paths_by_patches(spark, monkeypatch, front, patch, together):
    """By the tree, with no round for each tile, or by hops where a front would be too large; paths are summed inside patches, then between them."""
    rng = np.random.default_rng(patch)
    src, dst, cost, pref, _ = lattice(rng, 9, 8, 1.0, 1, 0.3)
    n = 72
    into = dst != n  # the last cell can't be reached
    src, dst, cost, pref = src[into], dst[into], cost[into], pref[into]
    cost = np.where(rng.random(len(cost)) < 0.5, 1.0, cost)  # some ties
    targets = [1, 30, 33, 71]
    monkeypatch.setattr(dissection, "FRONT", front)
    monkeypatch.setattr(dissection, "COLUMNS", 3)  # two blocks of targets
    monkeypatch.setattr(tiles, "PATCH", patch)
    monkeypatch.setattr(tiles, "TOGETHER", together)
    rounds, hops = [], tiles.Tiles._by_hops
    monkeypatch.setattr(tiles.Tiles, "_by_hops", lambda self, *a: rounds.append(1) or hops(self, *a))
    found = tiles.Tiles(frame(spark, "src dst cost", src, dst, cost), 9, 8, 3)
    marks = frame(spark, "target", np.array(targets))
    g = graph_of(n, src, dst, cost, pref)
    want = np.stack([kernels.dijkstra(g, t - 1)[0] for t in targets], axis=1)
    assert np.allclose(dense(found.least_costs(marks), n, targets), np.where(np.isfinite(want), want, 0.0), rtol=1e-12)
    kl = np.stack([kernels.least_cost_kl(g, t - 1, "least") for t in targets], axis=1)
    got = found.summed_paths(frame(spark, "node parent value", src, dst, -np.log(pref)), marks).toPandas()
    assert len(got) == (~np.isnan(kl)).sum() and not got.duplicated(["node", "target"]).any()
    assert np.allclose(got.value, kl[got.node - 1, [targets.index(t) for t in got.target]])
    assert bool(rounds) == (front == 10)


@pytest.mark.parametrize("patch", [1, 8])
def test_paths_in_a_circle_are_refused(spark, monkeypatch, patch):
    """Cells 2 and 3 are each other's parents, in one patch or in two."""
    monkeypatch.setattr(tiles, "PATCH", patch)
    monkeypatch.setattr(tiles, "summed_up", lambda tree, targets, up=tiles.summed_up: up(tree, targets, rounds=5))
    edges = spark.createDataFrame([(4, 3, 1.0), (3, 2, 0.0), (2, 3, 0.0), (2, 1, 1.0)], "src long, dst long, cost double")
    with pytest.raises(ValueError, match="circle"):
        tiles.Tiles(edges, 4, 1).summed_paths(edges.select(F.col("dst").alias("node"), F.col("src").alias("parent"), "cost").withColumnRenamed("cost", "value"), spark.createDataFrame([(4,)], "target long")).collect()


def test_flow_to_the_edge_of_double_precision(spark):
    """Weights over entries near 1e-308 don't overflow: one such pair made the flow of all cells NaN."""
    cells = spark.createDataFrame([(r, c, 1e-3, 100.0 + r * c) for r in (1, 2) for c in range(1, 101)], "row int, col int, affinity double, value double")
    marks = spark.createDataFrame([(1, 2, 5e4)], "row int, col int, value double")
    land = Landscape.build(spark, 2, 100, raster.raster_graph(cells.withColumn("value", F.col("affinity")), 2, 100), qualities=cells.drop("affinity"), target_qualities=marks, landmarks=True)
    land.edges, land.nodes = written(land.edges, "e"), written(land.nodes, "n")
    model = distributed.DistributedModel(land, 1.0)

    def solve(a, b):
        a, b = a.copy(), b.copy()
        for i in range(len(b)):
            for j in np.flatnonzero(a[i + 1 :, i]) + i + 1:
                f = a[j, i] / a[i, i]
                a[j], b[j] = a[j] - f * a[i], b[j] - f * b[i]
        for i in reversed(range(len(b))):
            b[i] = (b[i] - a[i, i + 1 :] @ b[i + 1 :]) / a[i, i]
        return b

    w = model.walk.toPandas()
    a = np.eye(200, dtype=np.longdouble)
    a[w.src - 1, w.dst - 1] -= w.w.to_numpy().astype(np.longdouble)
    unit = np.zeros(200, np.longdouble)
    unit[2] = 1.0
    z = solve(a, unit)
    kept = z >= np.finfo(float).tiny
    assert 0 < kept.sum() < 200 and 5e6 / z[kept].min() > np.finfo(float).max  # it has entries above and below double precision
    cell = np.arange(200)
    k = np.where(kept, (100.0 + (cell % 2 + 1) * (cell // 2 + 1)) * 5e4, 0.0)
    x = solve(a.T.copy(), np.where(kept, k / np.where(kept, z, 1), 0) - unit * k.sum() / z[2])
    want = np.where(kept, x * z, 0).astype(float)
    got = model.betweenness_qweighted().orderBy("col", "row").toPandas().value.to_numpy()
    assert np.allclose(got, want, rtol=1e-9, atol=1e-6)
    assert model.edge_betweenness_qweighted().where("isnan(value) or abs(value) = double('infinity')").isEmpty()
