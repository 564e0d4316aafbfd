"""The registered queries with every active cell as a target, against dense inverses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from landweave.plans import queries, tables
from landweave.plans.stages import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def land(spark):
    one = tables.ship_landscape(spark, SF, None)
    one.edges, one.nodes = written(one.edges, "e"), written(one.nodes, "n")
    return one


def square(df):
    return df.toPandas().pivot(index="node", columns="target", values="value").to_numpy()


def canvas(df):
    return df.orderBy("col", "row").where("value is not null and not isnan(value)").toPandas()["value"].to_numpy()


def test_every_active_cell_is_a_target(spark, land):
    run = {name: f for name, f in queries.registry().items()}
    g = land.arrays
    n = g.n
    p, c = np.zeros((n, n)), np.zeros((n, n))
    p[g.src, g.dst], c[g.src, g.dst] = g.pref, g.cost
    w = p * np.exp(-c)
    z = np.linalg.inv(np.eye(n) - w)
    s = z / np.diag(z)
    cost = z @ (c * w) @ z / z
    cost -= np.diag(cost)
    assert np.allclose(square(run["fundamental_matrix_all"](spark, SF)), np.log(z), atol=1e-5)
    assert np.allclose(square(run["survival_probability_all"](spark, SF)), np.log(s), atol=1e-5)
    assert np.allclose(square(run["expected_cost_all"](spark, SF)), cost, atol=1e-5)
    q = g.qs
    assert np.allclose(canvas(run["connected_habitat_survival_all"](spark, SF)), q * (s @ q), atol=1e-5)
    assert np.allclose(canvas(run["connected_habitat_expected_cost_all"](spark, SF)), q * (np.exp(-cost) @ q), atol=1e-5)
    moved = (q[:, None] * q / z).T @ z - q[:, None] * q.sum() / np.diag(z)[:, None] * z
    flow = (moved.T * z).sum(axis=1)
    assert np.allclose(canvas(run["betweenness_q_all"](spark, SF)), flow, rtol=1e-5, atol=1e-5)
    assert run["eigmax_value_all"](spark, SF).first()[0] == pytest.approx(np.linalg.eigvals(q[:, None] * s * q).real.max(), rel=1e-6)
    kl = q @ (-np.log(s) - cost) @ q
    assert run["mean_kl_divergence_all"](spark, SF).first()[0] == pytest.approx(kl, rel=1e-6)


def test_criticality_covers_every_active_cell(spark, land):
    loss = queries.registry()["criticality"](spark, SF).where(F.col("value").isNotNull() & ~F.isnan("value"))
    assert loss.count() == land.arrays.n > 300
