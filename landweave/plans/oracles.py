"""DuckDB SQL of the registered queries, on the same tables.

Linear systems are summed as Neumann series by recursive queries: with affinities of at most 0.5 the
weights of a row sum to 0.5 or less, so TERMS terms leave less than 2 ** -TERMS relative to the last.
"""

from __future__ import annotations

TERMS = 130
_SQL: dict[str, str] = {}


def registry() -> dict[str, str]:
    return dict(_SQL)


def add(name: str, sql: str) -> None:
    _SQL[name] = sql


SHIP = """
ship0 AS (SELECT day(l_shipdate)::INT AS "row", month(l_shipdate)::INT AS col, count(*)::DOUBLE AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
ship AS (SELECT "row", col, 0.5 * n / max(n) OVER () AS affinity, q / max(q) OVER () AS quality FROM ship0)"""
ACTIVITY = """
act0 AS (SELECT (hour(ts) + 1)::INT AS "row", (user_id % 20 + 1)::INT AS col, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2),
act AS (SELECT "row", col, 0.5 * n / max(n) OVER () AS affinity FROM act0)"""
PART = """
part0 AS (SELECT p_size::INT AS "row", p_brand, avg(p_retailprice) AS price FROM part GROUP BY 1, 2),
prt AS (SELECT "row", dense_rank() OVER (ORDER BY p_brand)::INT AS col, 0.5 * price / max(price) OVER () AS affinity FROM part0)"""
N4 = "(-1, 0, 1.0::DOUBLE), (1, 0, 1.0), (0, -1, 1.0), (0, 1, 1.0)"
N8 = N4 + ", (-1, -1, sqrt(2)), (-1, 1, sqrt(2)), (1, -1, sqrt(2)), (1, 1, sqrt(2))"


def edges_sql(raster: str, value: str, nrows: int, ncols: int, neighbors: int = 8, weight: str = "target", matrix: str = "affinity", name: str = "edges") -> str:
    """CTEs st and ``name`` (src, dst, value)."""
    expr = {
        ("target", "affinity"): "b.v / s.len", ("target", "cost"): "b.v * s.len",
        ("average", "affinity"): "2 / ((1 / a.v + 1 / b.v) * s.len)", ("average", "cost"): "(a.v + b.v) * s.len / 2",
    }[weight, matrix]
    source = f'JOIN {name}_v a ON a."row" = b."row" - s.dr AND a.col = b.col - s.dc' if weight == "average" else ""
    return f"""
{name}_st(dr, dc, len) AS (VALUES {N8 if neighbors == 8 else N4}),
{name}_v AS (SELECT "row", col, {value} AS v FROM {raster}),
{name} AS (
  SELECT ((b.col - s.dc - 1) * {nrows} + b."row" - s.dr)::BIGINT AS src, ((b.col - 1) * {nrows} + b."row")::BIGINT AS dst, {expr} AS value
  FROM {name}_v b CROSS JOIN {name}_st s {source}
  WHERE b.v <> 0 AND b."row" - s.dr BETWEEN 1 AND {nrows} AND b.col - s.dc BETWEEN 1 AND {ncols})"""


def coarse_sql(npix: int) -> str:
    return f"""SELECT (br * {npix} + {npix // 2 + 1})::INT AS "row", (bc * {npix} + {npix // 2 + 1})::INT AS col, sum(quality) AS value
  FROM (SELECT ("row" - 1) // {npix} AS br, (col - 1) // {npix} AS bc, quality FROM ship) WHERE (br + 1) * {npix} <= 31 AND (bc + 1) * {npix} <= 12 GROUP BY br, bc HAVING sum(quality) <> 0"""


CANVAS = """grid AS (SELECT r::INT AS "row", c::INT AS col, ((c - 1) * 31 + r)::BIGINT AS cell FROM range(1, 32) a(r) CROSS JOIN range(1, 13) b(c))"""


def on_canvas(values: str, digits: int = 6) -> str:
    return f'SELECT "row", col, round(value, {digits}) AS value FROM grid LEFT JOIN ({values}) USING (cell)'


def land_sql(npix: int | None = 3, degraded: int | None = None) -> str:
    """CTEs ship, e (src, dst, affinity, cost), nodes (cell, row, col, q), targets (cell, qt), grid."""
    targets = f"SELECT n.cell, c.value AS qt FROM ({coarse_sql(npix)}) c JOIN nodes0 n USING (\"row\", col)" if npix else "SELECT cell, q AS qt FROM nodes0"
    hit = f"CASE WHEN src = {degraded} OR dst = {degraded} THEN 2.2250738585072014e-308::DOUBLE ELSE value END" if degraded else "value"
    zero = (lambda c, x: f"CASE WHEN {c} = {degraded} THEN 0 ELSE {x} END") if degraded else (lambda c, x: x)
    return f"""{SHIP}, {edges_sql('ship', 'affinity', 31, 12, name='e0')}, {CANVAS},
nodes0 AS (SELECT ((col - 1) * 31 + "row")::BIGINT AS cell, "row", col, quality AS q FROM ship),
nodes AS (SELECT cell, "row", col, {zero('cell', 'q')} AS q FROM nodes0),
targets0 AS ({targets}), targets AS (SELECT cell, {zero('cell', 'qt')} AS qt FROM targets0),
e1 AS (SELECT src, dst, {hit} AS affinity FROM e0 WHERE src IN (SELECT cell FROM nodes)),
e AS (SELECT src, dst, affinity, -ln(affinity) + 0.0 AS cost FROM e1)"""


def solve_sql(name: str, seed: str, transposed: bool = False, terms: int = TERMS) -> str:
    """CTE ``name`` (node, target, v): (I - W)^-1 of the rows (node, target, v) of ``seed``."""
    here, there = ("dst", "src") if not transposed else ("src", "dst")
    return f"""
{name}_k AS (
  SELECT 0 AS k, node, target, v FROM ({seed})
  UNION ALL
  SELECT k + 1, w.{there}, x.target, sum(w.w * x.v) FROM {name}_k x JOIN w ON w.{here} = x.node WHERE k < {terms} GROUP BY k + 1, w.{there}, x.target),
{name} AS (SELECT node, target, sum(v) AS v FROM {name}_k GROUP BY node, target)"""


def model_sql(theta: float = 1.0, npix: int | None = 3, degraded: int | None = None) -> str:
    """The landscape's CTEs, w (src, dst, pref, cost, w), z and s (node, target, v)."""
    return f"""{land_sql(npix, degraded)},
w AS (SELECT src, dst, pref, cost, pref * exp(-{theta} * cost) AS w FROM (SELECT *, affinity / sum(affinity) OVER (PARTITION BY src) AS pref FROM e)),
{solve_sql('z', 'SELECT cell AS node, cell AS target, 1.0::DOUBLE AS v FROM targets')},
zt AS (SELECT target, v FROM z WHERE node = target),
s AS (SELECT z.node, z.target, z.v / zt.v AS v FROM z JOIN zt USING (target))"""


def cost_sql() -> str:
    """CTE c (node, target, v): expected cost."""
    return f"""
cz AS (SELECT w.src AS node, z.target, sum(w.cost * w.w * z.v) AS v FROM w JOIN z ON z.node = w.dst GROUP BY 1, 2),
{solve_sql('zcz', 'SELECT node, target, v FROM cz')},
c0 AS (SELECT node, target, CASE WHEN z.v = 0 OR isnan(zcz.v / z.v) THEN 'Infinity'::DOUBLE ELSE zcz.v / z.v END AS v FROM zcz JOIN z USING (node, target)),
c AS (SELECT c0.node, c0.target, c0.v - o.v AS v FROM c0 JOIN c0 o ON o.target = c0.target AND o.node = c0.target)"""


def least_sql(hops: int = 45) -> str:
    """CTE d (node, target, v): least cost from the target to the node."""
    return f"""
d_k AS (
  SELECT 0 AS k, cell AS node, cell AS target, 0.0::DOUBLE AS v FROM targets
  UNION ALL
  SELECT k + 1, e.dst, x.target, min(x.v + e.cost) FROM d_k x JOIN e ON e.src = x.node WHERE k < {hops} GROUP BY k + 1, e.dst, x.target),
d AS (SELECT node, target, min(v) AS v FROM d_k GROUP BY node, target)"""


def flow_sql(weight: str = "1.0", joins: str = "", scale: str = "") -> str:
    """CTE f (node, target, z, x): both sides of the flow with weights q_s * ``weight`` * q_t."""
    return f"""
kk AS (SELECT z.node, z.target, n.q * ({weight}) * t.qt AS k, z.v AS z FROM z JOIN nodes n ON n.cell = z.node JOIN targets t ON t.cell = z.target {joins}),
kt AS (SELECT target, sum(k) AS k FROM kk GROUP BY target),
mm AS (SELECT kk.node, kk.target, kk.k / kk.z - CASE WHEN kk.node = kk.target THEN kt.k / kk.z ELSE 0 END AS v FROM kk JOIN kt USING (target)),
{solve_sql('xx', 'SELECT node, target, v FROM mm', transposed=True)},
f AS (SELECT z.node, z.target, z.v AS z, xx.v AS x FROM z JOIN xx USING (node, target))"""


def rec(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"


def pairs(of: str, value: str) -> str:
    return f"SELECT node, target, {value} AS value FROM {of}"


# --- rasters and graphs ------------------------------------------------------------------------

add("raster_ship", f'WITH {SHIP} SELECT "row", col, round(affinity, 9) AS affinity, round(quality, 9) AS quality FROM ship')
add("raster_activity", f'WITH {ACTIVITY} SELECT "row", col, round(affinity, 9) AS affinity FROM act')
add("raster_part", f'WITH {PART} SELECT "row", col, round(affinity, 9) AS affinity FROM prt')
for _n in (4, 8):
    for _w in ("target", "average"):
        for _m in ("affinity", "cost"):
            add(f"adj_n{_n}_{_w}_{_m}", f"WITH {ACTIVITY}, {edges_sql('act', 'affinity', 24, 20, _n, _w, _m)} SELECT src, dst, round(value, 9) AS value FROM edges")
add("adj_part", f"WITH {PART}, {edges_sql('prt', 'affinity', 50, 25)} SELECT src, dst, round(value, 9) AS value FROM edges")
SIDE = 'side AS (SELECT ceil(sqrt(max(p_partkey) + 1))::BIGINT AS s, max(p_retailprice)::DOUBLE AS top FROM part)'
_S = "(SELECT s FROM side)"
#: The grid of the parts' raster.
_GRID = f'{SIDE}, g AS (SELECT a.r::INT AS "row", b.c::INT AS col FROM range(1, {_S} + 1) a(r) CROSS JOIN range(1, {_S} + 1) b(c))'
for _n in (4, 8):
    add(f"lattice_n{_n}", f"WITH {_GRID}, {edges_sql('g', '1.0::DOUBLE', _S, _S, _n)} SELECT src, dst, round(value, 9) AS value FROM edges")
add("stencil_n8", f'WITH {SIDE} SELECT (p_partkey % s + 1)::INT AS "row", (p_partkey // s + 1)::INT AS col, dr::INT AS dr, dc::INT AS dc, round(len, 9) AS len FROM part, side, (VALUES {N8}) t(dr, dc, len)')
_SHIP_EDGES = f"WITH {SHIP}, {edges_sql('ship', 'affinity', 31, 12)}"
_FORMS = {"minus_log": "-ln(value) + 0.0", "exp_minus": "exp(-value)", "inv": "1 / value", "odds_against": "1 / value - 1", "odds_for": "value / (1 - value)"}
for _t, _e in _FORMS.items():
    add(f"cost_{_t}", f"{_SHIP_EDGES} SELECT src, dst, round({_e}, 7) AS value FROM edges")
# The odds are declared each other's inverse, which they are not.
_BACK = {t: "value" for t in ("minus_log", "exp_minus", "inv")} | {"odds_against": "(1 / value - 1) / (2 - 1 / value)", "odds_for": "(1 - value) / value - 1"}
add("transform_inverses", f"{_SHIP_EDGES} SELECT src, dst, {', '.join(f'round({f}, 7) AS {t}' for t, f in _BACK.items())} FROM edges")
for _p in (1, 2, 3, 5):
    add(f"coarse_graining_p{_p}", f'WITH {SHIP} SELECT "row", col, round(value, 6) AS value FROM ({coarse_sql(_p)})')
add("sum_neighborhood", f'WITH {SHIP} SELECT round(coalesce(sum(quality), 0), 6) AS value FROM ship WHERE "row" BETWEEN 14 AND 18 AND col BETWEEN 4 AND 8')
add("outdegree_map", rec(land_sql(None), on_canvas("SELECT src AS cell, sum(affinity) AS value FROM e GROUP BY src")))
add("indegree_map", rec(land_sql(None), on_canvas("SELECT dst AS cell, sum(affinity) AS value FROM e GROUP BY dst")))
add("value_map", rec(land_sql(None), on_canvas("SELECT cell, q AS value FROM nodes")))
add("target_nodes", rec(land_sql(3), 'SELECT cell, "row", col, round(qt, 6) AS qt FROM targets JOIN nodes USING (cell)'))
add("cost_validation", f"{_SHIP_EDGES} SELECT src, dst, round(-ln(3 * value), 6) AS value FROM edges WHERE -ln(3 * value) < 0")
add("edge_containment", f"WITH {SHIP}, {edges_sql('ship', 'affinity', 31, 12, 4, name='a')}, {edges_sql('ship', 'affinity', 31, 12, 8, matrix='cost', name='c')} SELECT src, dst FROM c WHERE value <> 0 EXCEPT SELECT src, dst FROM a")
# Corridors of 3 and 2 cells at 0.35 and 0.7 of the rows.
_WALL = f"""{_GRID}, {edges_sql('g', '1.0::DOUBLE', _S, _S)}, stones AS (SELECT s, round_even(s * 0.5 - 0.5, 0)::INT AS first, floor(s * 0.35)::INT - 2 AS a, floor(s * 0.7)::INT - 1 AS b FROM side),
wall AS (SELECT "row", col, ((col - 1) * s + "row")::BIGINT AS cell FROM g, stones WHERE col BETWEEN first AND first + 2 AND ("row" <= a OR "row" BETWEEN a + 4 AND b OR "row" >= greatest(a, b) + 3))"""
add("wall_cells", f'WITH {_WALL} SELECT cell, "row", col FROM wall')
_BLOCKED = "CASE WHEN src IN (SELECT cell FROM wall) OR dst IN (SELECT cell FROM wall) THEN {0} ELSE 0.5 * value END"
add("wall_affinities", f"WITH {_WALL} SELECT src, dst, round({_BLOCKED.format('0.001::DOUBLE')}, 9) AS value FROM edges")
add("wall_impassable", f"WITH {_WALL} SELECT src, dst, round(0.5 * value, 9) AS value FROM edges WHERE src NOT IN (SELECT cell FROM wall) AND dst NOT IN (SELECT cell FROM wall)")
_BOTH = f'WITH {PART}, {ACTIVITY}, x AS (SELECT "row", col, affinity AS a FROM prt), y AS (SELECT "row", col, affinity AS b FROM act)'
add("mask_reconcile", f'{_BOTH} SELECT "row", col, round(coalesce(a, 1e-20), 9) AS a, round(coalesce(b, 1e-20), 9) AS b FROM x FULL OUTER JOIN y USING ("row", col)')
add("mask_reconcile_one_sided", f'{_BOTH} SELECT "row", col, round(a, 9) AS a, round(CASE WHEN a > 0 THEN coalesce(b, 1e-20) ELSE b END, 9) AS b FROM x FULL OUTER JOIN y USING ("row", col)')
add("clamp_negative", f'WITH {SHIP} SELECT "row", col, round(greatest(quality - 0.5, 0), 6) AS value FROM ship')
add("independent_cost", f"{_SHIP_EDGES} SELECT src, dst, round(-ln(1 - value), 6) AS value FROM edges")
add("finite_total", f"WITH {SHIP} SELECT round(sum(quality), 6) AS value FROM ship")
add("euclid_distance", rec(land_sql(3), 'SELECT n.cell AS node, t.cell AS target, round(sqrt((n."row" - m."row") ** 2 + (n.col - m.col) ** 2), 6) AS value FROM nodes n CROSS JOIN targets t JOIN nodes m ON m.cell = t.cell'))
add("ascgrid_roundtrip", f'WITH {SHIP} SELECT "row", col, round(affinity, 9) AS value FROM ship')

# --- graph structure ---------------------------------------------------------------------------

_TRADE = """trade0 AS (SELECT (s_nationkey + 1)::BIGINT AS src, (c_nationkey + 1)::BIGINT AS dst, sum(l_extendedprice) AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
trade AS (SELECT src, dst, revenue / sum(revenue) OVER (PARTITION BY src) AS value FROM trade0),
strong AS (SELECT src, dst FROM trade WHERE value > 0.06 AND src <> dst)"""
_REACH = f"""{_TRADE}, ends AS (SELECT src AS x FROM strong UNION SELECT dst FROM strong),
reach AS (SELECT x, x AS y FROM ends UNION SELECT r.x, s.dst FROM reach r JOIN strong s ON s.src = r.y),
scc AS (SELECT a.x AS node, min(a.y) AS component FROM reach a JOIN reach b ON a.x = b.y AND a.y = b.x GROUP BY a.x)"""
add("trade_graph", f"WITH {_TRADE} SELECT src, dst, round(value, 6) AS value FROM trade")
add("scc_labels", rec(_REACH, "SELECT node, component FROM scc"))
add("scc_labels_distributed", rec(_REACH, "SELECT node, component FROM scc"))
add("largest_subgraph", rec(_REACH, "SELECT node FROM scc WHERE component = (SELECT component FROM scc GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)"))
add("is_strongly_connected", rec(_REACH, "SELECT count(DISTINCT component) <= 1 AS trade, true AS ship FROM scc"))
add("least_cost_distance", rec(f"{land_sql(3)}, {least_sql()}", pairs("d", "round(v, 6)")))
add("least_cost_distance_distributed", rec(f"{land_sql(5)}, {least_sql()}", pairs("d", "round(v, 6)")))
_OPEN = f"""{SHIP}, {edges_sql('ship', 'affinity', 31, 12, weight='average', name='e0')}, {CANVAS}, e AS (SELECT src, dst, value AS affinity, -ln(value) + 0.0 AS cost FROM e0),
targets AS (SELECT ((col - 1) * 31 + "row")::BIGINT AS cell FROM ship)"""
add("floyd_warshall_undirected", rec(f"{_OPEN}, {least_sql()}", pairs("d", "round(v, 6)")))
# Pair dependencies: sigma(s, v) * sigma(v, t) / sigma(s, t) where the distances add up; sigma counts shortest paths along tight edges.
add("brandes_undirected", rec(f"""{_OPEN}, {least_sql()},
tight AS (SELECT a.target AS root, e.src, e.dst FROM d a JOIN e ON e.src = a.node JOIN d b ON b.target = a.target AND b.node = e.dst WHERE abs(a.v + e.cost - b.v) < 1e-11),
sig_k AS (SELECT 0 AS k, cell AS root, cell AS node, 1.0::DOUBLE AS n FROM targets
  UNION ALL SELECT k + 1, s.root, t.dst, sum(s.n) FROM sig_k s JOIN tight t ON t.root = s.root AND t.src = s.node WHERE k < 45 GROUP BY k + 1, s.root, t.dst),
sig AS (SELECT root, node, sum(n) AS n FROM sig_k GROUP BY root, node),
dep AS (SELECT sv.node AS cell, sum(sv.n * vt.n / st.n) / 2 AS value FROM sig sv JOIN sig vt ON vt.root = sv.node JOIN sig st ON st.root = sv.root AND st.node = vt.node
  JOIN d a ON a.target = sv.root AND a.node = sv.node JOIN d b ON b.target = sv.node AND b.node = vt.node JOIN d c ON c.target = sv.root AND c.node = vt.node
  WHERE abs(a.v + b.v - c.v) < 1e-11 AND sv.node <> sv.root AND sv.node <> vt.node GROUP BY sv.node),
every AS (SELECT t.cell, coalesce(value, 0) AS value FROM targets t LEFT JOIN dep USING (cell))""", on_canvas("SELECT cell, value FROM every", 4)))

# --- the model ---------------------------------------------------------------------------------

add("pref", rec(model_sql(), "SELECT src, dst, round(pref, 9) AS value FROM w"))
add("w_matrix", rec(model_sql(), "SELECT src, dst, round(w, 9) AS value FROM w"))
add("fundamental_matrix", rec(model_sql(), pairs("z", "round(ln(v), 6)")))
add("fundamental_matrix_distributed", rec(model_sql(npix=5), pairs("z", "round(ln(v), 6)")))
add("survival_probability", rec(model_sql(), pairs("s", "round(ln(v), 6)")))
add("free_energy_distance", rec(model_sql(), pairs("s", "round(-ln(v) + 0.0, 6)")))
add("power_mean_proximity", rec(model_sql(2.0), pairs("s", "round(ln(v) / 2, 6)")))
add("expected_cost", rec(f"{model_sql()}, {cost_sql()}", pairs("c", "round(v, 6)")))
add("bf_expected_cost", rec(f"{model_sql(npix=5)}, {cost_sql()}", pairs("c", "round(v, 4)")))
add("bf_free_energy", rec(model_sql(npix=5), pairs("s", "round(-ln(v) + 0.0, 4)")))
add("bf_survival", rec(model_sql(npix=5), pairs("s", "round(ln(v), 4)")))
add("bf_power_mean", rec(model_sql(npix=5), pairs("s", "round(ln(v), 4)")))

# --- flow --------------------------------------------------------------------------------------

_NODE = on_canvas("SELECT node AS cell, sum(z * x) AS value FROM f GROUP BY node")
_EDGE = "SELECT w.src, w.dst, round(sum(w.w * a.z * b.x), 6) AS value FROM w JOIN f a ON a.node = w.dst JOIN f b ON b.node = w.src AND b.target = a.target GROUP BY 1, 2"
_BY_COST = flow_sql("exp(-c.v)", "JOIN c ON c.node = z.node AND c.target = z.target")
add("betweenness_q", rec(f"{model_sql()}, {flow_sql()}", _NODE))
add("betweenness_k", rec(f"{model_sql()}, {cost_sql()}, {_BY_COST}", _NODE))
add("betweenness_k_survival", rec(f"{model_sql()}, {flow_sql('CASE WHEN s.node = s.target THEN 0 ELSE s.v END', 'JOIN s ON s.node = z.node AND s.target = z.target')}", _NODE))
add("edge_betweenness_q", rec(f"{model_sql()}, {flow_sql()}", _EDGE))
add("edge_betweenness_k", rec(f"{model_sql()}, {cost_sql()}, {_BY_COST}", _EDGE))

# --- habitat and what follows ------------------------------------------------------------------


def habitat(of: str, value: str) -> str:
    return on_canvas(f"SELECT n.cell, n.q * sum({value} * t.qt) AS value FROM {of} p JOIN targets t ON t.cell = p.target JOIN nodes n ON n.cell = p.node GROUP BY n.cell, n.q")


add("connected_habitat_expected_cost", rec(f"{model_sql()}, {cost_sql()}", habitat("c", "exp(-p.v)")))
add("connected_habitat_free_energy", rec(model_sql(), habitat("s", "p.v")))
add("connected_habitat_survival", rec(model_sql(), habitat("s", "p.v")))
add("connected_habitat_power_mean", rec(model_sql(), habitat("s", "p.v")))
add("connected_habitat_diagonal", rec(model_sql(), habitat("s", "CASE WHEN p.node = p.target THEN 0 ELSE p.v END")))
add("connected_habitat_least_cost", rec(f"{land_sql(3)}, {least_sql()}", habitat("d", "exp(-p.v)")))
add("habitat_landscape_path", rec(f"{model_sql(npix=5)}, {cost_sql()}", habitat("c", "exp(-p.v)").replace("round(value, 6)", "round(value, 4)")))
add("habitat_from_z", rec(model_sql(), habitat("z", "p.v")))
add("capped_survival", rec(model_sql(), pairs("z", "round(least(1.0, v), 6)")))
add("prob_connectivity", rec(f"{land_sql(3)}, {least_sql()}", habitat("d", "CASE WHEN p.v = 0 THEN 0 ELSE exp(-p.v / 2.5) END")))
add("inverse_threshold_proximity", rec(f"{land_sql(3)}, {least_sql()}", pairs("d", "round(CASE WHEN v <= 2 THEN 1 ELSE 2 / v END, 6)")))
add("quality_scaled", rec(model_sql(), "SELECT node, target, round(n.q * s.v * t.qt, 8) AS value FROM s JOIN nodes n ON n.cell = node JOIN targets t ON t.cell = target"))
_KL = "SELECT sum(n.q * (-ln(s.v) - c.v) * t.qt) AS value FROM s JOIN c USING (node, target) JOIN nodes n ON n.cell = node JOIN targets t ON t.cell = target"
add("mean_kl_divergence", rec(f"{model_sql()}, {cost_sql()}", f"SELECT round(value, 6) AS value FROM ({_KL})"))
# The least-cost tree from each target: a node's parent is its neighbour on a tight edge. Costs are real numbers, so parents are unique.
_TREE = """
tree AS (SELECT b.node, b.target, min(e.src) AS parent FROM d a JOIN e ON e.src = a.node JOIN d b ON b.target = a.target AND b.node = e.dst
  WHERE b.node <> b.target AND abs(a.v + e.cost - b.v) < 1e-12 GROUP BY b.node, b.target),
kl_k AS (SELECT cell AS node, cell AS target, 0.0::DOUBLE AS v FROM targets
  UNION ALL SELECT t.node, t.target, k.v - ln(w.pref) FROM kl_k k JOIN tree t ON t.parent = k.node AND t.target = k.target JOIN w ON w.src = t.node AND w.dst = t.parent)"""
_LC = f"{model_sql()}, {least_sql()}, {_TREE}"
add("lc_kl_divergence", rec(_LC, pairs("kl_k", "round(v, 6)")))
add("mean_lc_kl_divergence", rec(_LC, "SELECT round(sum(n.q * k.v * t.qt), 6) AS value FROM kl_k k JOIN nodes n ON n.cell = k.node JOIN targets t ON t.cell = k.target"))
add("kl_percentage", rec(f"{_LC}, {cost_sql()}", f"SELECT round((SELECT value FROM ({_KL})) / sum(n.q * k.v * t.qt) * 100, 6) AS value FROM kl_k k JOIN nodes n ON n.cell = k.node JOIN targets t ON t.cell = k.target"))
add("lc_kl_divergence_cell", rec(_LC.replace("targets AS (SELECT cell, qt AS qt FROM targets0)", f"targets AS (SELECT {5 * 31 + 16}::BIGINT AS cell, 1.0::DOUBLE AS qt)"), on_canvas("SELECT node AS cell, v AS value FROM kl_k")))
add("habitat_degraded_cell", rec(f"{model_sql(degraded=4 * 31 + 14)}, {cost_sql()}", habitat("c", "exp(-p.v)")))
# Power iteration on the target rows; values are scaled by their largest entry in every round.
_EIG = """
b AS (SELECT s.node, s.target, n.q * s.v * t.qt AS v FROM s JOIN nodes n ON n.cell = s.node JOIN targets t ON t.cell = s.target),
p_k AS (SELECT 0 AS k, cell AS node, 1.0::DOUBLE AS v, 1.0::DOUBLE AS top FROM targets
  UNION ALL SELECT k, node, v / max(v) OVER () AS v, max(v) OVER () AS top FROM (
    SELECT p.k + 1 AS k, b.{0} AS node, sum(b.v * p.v) AS v FROM p_k p JOIN b ON b.{1} = p.node WHERE p.k < 400 AND b.node IN (SELECT cell FROM targets) GROUP BY p.k + 1, b.{0})),
last AS (SELECT * FROM p_k WHERE k = 400)"""
add("eigmax_value", rec(f"{model_sql()}, {_EIG.format('node', 'target')}", "SELECT round(max(top), 6) AS value FROM last"))
add("eigmax_right", rec(f"{model_sql()}, {_EIG.format('node', 'target')}, r AS (SELECT b.node AS cell, sum(b.v * l.v) AS v FROM b JOIN last l ON l.node = b.target GROUP BY b.node)", "SELECT cell, round(v / max(v) OVER (), 6) AS value FROM r"))
add("eigmax_left", rec(f"{model_sql()}, {_EIG.format('target', 'node')}", "SELECT n.cell, round(coalesce(l.v, 0), 6) AS value FROM nodes n LEFT JOIN last l ON l.node = n.cell"))


def _theta(theta: float) -> str:
    return f"SELECT * FROM ({rec(f'{model_sql(theta)}, {flow_sql()}', f'SELECT {theta}::DOUBLE AS theta, n.{chr(34)}row{chr(34)}, n.col, round(sum(z * x), 6) AS value FROM f JOIN nodes n ON n.cell = f.node GROUP BY ALL')})"


add("theta_sweep", " UNION ALL ".join(_theta(t) for t in (0.5, 1.0, 2.0)))


def _coarse(npix: int | None) -> str:
    return rec(model_sql(npix=npix), "SELECT n.cell, n.q * sum(p.v * t.qt) AS value FROM s p JOIN targets t ON t.cell = p.target JOIN nodes n ON n.cell = p.node GROUP BY n.cell, n.q")


add("coarseness_corr", " UNION ALL ".join(
    f"SELECT {p}::INT AS npix, round(sum(x.value) / sum(y.value), 6) AS ratio, round(corr(x.value, y.value), 6) AS correlation FROM ({_coarse(p)}) x JOIN ({_coarse(None)}) y USING (cell)" for p in (1, 3)
))
add("underestimation", f"SELECT round((1 - sum(x.value) / sum(y.value)) * 100, 6) AS value FROM ({_coarse(3)}) x FULL JOIN ({_coarse(None)}) y USING (cell)")
for _name in ("expected_cost", "betweenness_q", "edge_betweenness_q"):
    add(f"{_name}_distributed", _SQL[_name])
add("connected_habitat_distributed", _SQL["connected_habitat_survival"])
# No cell is cut off by an affinity of 1e-20, so nothing is pruned.
add("landscape_impassable", f"""WITH {SHIP}, {edges_sql('ship', 'affinity', 31, 12)}
SELECT src, dst, 1.0::DOUBLE AS affinity, round(-ln(1e-20::DOUBLE), 6) AS cost, round(q, 6) AS qs, round(q, 6) AS qt FROM edges
JOIN (SELECT ((col - 1) * 31 + "row")::BIGINT AS dst, CASE WHEN "row" = 15 THEN 0 ELSE quality END AS q FROM ship) USING (dst)
WHERE src IN (SELECT ((col - 1) * 31 + "row")::BIGINT FROM ship) AND ((src - 1) % 31 = 14 OR (dst - 1) % 31 = 14)""")
_PARTS = f"""WITH {SIDE},
cells AS (SELECT p_partkey % s + 1 AS "row", p_partkey // s + 1 AS col, 0.5 * p_retailprice::DOUBLE / top AS v FROM part, side), st(dr, dc, len) AS (VALUES {N8}),
edges AS (SELECT ((col - dc - 1) * s + "row" - dr)::BIGINT AS src, ((col - 1) * s + "row")::BIGINT AS dst, v / len AS value
  FROM cells, st, side WHERE v <> 0 AND "row" - dr BETWEEN 1 AND s AND col - dc BETWEEN 1 AND s)"""
add("parts_adjacency", f"{_PARTS} SELECT src, dst, round(value, 6) AS value FROM edges")
add("parts_outdegrees", f"{_PARTS} SELECT src AS cell, round(sum(value), 6) AS value FROM edges GROUP BY src")
add("wall_parts", f"""{_PARTS}, {_WALL.split("stones AS", 1)[1].join(["stones AS", ""]).replace("FROM g, stones", "FROM cells, stones")}
SELECT src, dst, round(CASE WHEN src IN (SELECT cell FROM wall) OR dst IN (SELECT cell FROM wall) THEN 0.001::DOUBLE ELSE value END, 9) AS value FROM edges""")


def parts_sql() -> str:
    """The parts' landscape: ``land_sql`` on a raster that grows with the tables; all its cells are connected."""
    return f"""{_PARTS.removeprefix("WITH ")}, sold AS (SELECT l_partkey AS k, sum(l_quantity)::DOUBLE AS q FROM lineitem GROUP BY 1),
grid AS (SELECT a.r::INT AS "row", b.c::INT AS col, ((b.c - 1) * {_S} + a.r)::BIGINT AS cell FROM range(1, {_S} + 1) a(r) CROSS JOIN range(1, {_S} + 1) b(c)),
nodes AS (SELECT ((p_partkey // s) * s + p_partkey % s + 1)::BIGINT AS cell, (p_partkey % s + 1)::INT AS "row", (p_partkey // s + 1)::INT AS col, coalesce(q, 0) AS q FROM part CROSS JOIN side LEFT JOIN sold ON k = p_partkey),
size AS (SELECT s, greatest(1, s // 5) AS p FROM side),
targets AS (SELECT n.cell, c.v AS qt FROM (
  SELECT br * p + p // 2 + 1 AS r, bc * p + p // 2 + 1 AS c, sum(q) AS v FROM (SELECT ("row" - 1) // p AS br, (col - 1) // p AS bc, q, p, s FROM nodes, size)
  WHERE (br + 1) * p <= s AND (bc + 1) * p <= s GROUP BY br, bc, p HAVING sum(q) <> 0) c JOIN nodes n ON n."row" = c.r AND n.col = c.c),
e AS (SELECT src, dst, value AS affinity, -ln(value) + 0.0 AS cost FROM edges WHERE src IN (SELECT cell FROM nodes))"""


_PARTS_MODEL = f"""{parts_sql()},
w AS (SELECT src, dst, pref, cost, pref * exp(-cost) AS w FROM (SELECT *, affinity / sum(affinity) OVER (PARTITION BY src) AS pref FROM e)),
{solve_sql('z', 'SELECT cell AS node, cell AS target, 1.0::DOUBLE AS v FROM targets')},
zt AS (SELECT target, v FROM z WHERE node = target),
s AS (SELECT z.node, z.target, z.v / zt.v AS v FROM z JOIN zt USING (target))"""
add("parts_fundamental_matrix", rec(_PARTS_MODEL, pairs("z", "round(ln(v), 6)")))
add("parts_habitat", rec(_PARTS_MODEL, habitat("s", "p.v").replace("round(value, 6)", "round(value, 5)")))
add("parts_expected_cost", rec(f"{_PARTS_MODEL}, {cost_sql()}", pairs("c", "round(v, 5)")))
add("parts_flow", rec(f"{_PARTS_MODEL}, {flow_sql()}", _NODE.replace("round(value, 6)", "round(value, 5)")))
add("parts_flow_k", rec(f"{_PARTS_MODEL}, {flow_sql('s.v', 'JOIN s ON s.node = z.node AND s.target = z.target')}", _NODE.replace("round(value, 6)", "round(value, 5)")))
add("parts_least_cost", rec(f"{parts_sql()}, {least_sql(100)}", pairs("d", "round(v, 5)")))
add("parts_least_cost_kl", rec(f"{_PARTS_MODEL}, {least_sql(100)}, {_TREE}", pairs("kl_k", "round(v, 5)")))
add("sum_neighborhoods", f"""WITH {parts_sql()} SELECT g."row", g.col, round(coalesce(sum(n.q), 0), 6) AS value FROM grid g
LEFT JOIN nodes n ON n."row" BETWEEN g."row" - 2 AND g."row" + 2 AND n.col BETWEEN g.col - 2 AND g.col + 2 GROUP BY g."row", g.col""")
add("coarse_graining_sizes", f"""WITH {parts_sql()}, blocks AS (
  SELECT p::INT AS npix, ("row" - 1) // p AS br, (col - 1) // p AS bc, sum(q) AS v, s FROM nodes, side, range(1, 13) t(p) GROUP BY ALL)
SELECT npix, (br * npix + npix // 2 + 1)::INT AS "row", (bc * npix + npix // 2 + 1)::INT AS col, round(v, 6) AS value FROM blocks WHERE (br + 1) * npix <= s AND (bc + 1) * npix <= s AND v <> 0""")
add("canvas_infinite", f"WITH {SHIP}, {CANVAS} SELECT g.\"row\", g.col, round(coalesce(quality, 'Infinity'::DOUBLE), 6) AS value FROM grid g LEFT JOIN ship x ON x.\"row\" = g.\"row\" AND x.col = g.col AND quality > 0.5")
add("grid_size", f"WITH {SHIP}, {SIDE} SELECT 'ship' AS name, 31::BIGINT AS rows, 12::BIGINT AS cols, count(*) AS active FROM ship UNION ALL SELECT 'parts', min(s), min(s), count(*) FROM part, side")
add("reprs", f"""WITH {SIDE}, names AS (SELECT 'Landscape of size ' || s || ' x ' || s || ' with landmarks' AS land FROM side)
SELECT 'landscape' AS name, land AS value FROM names UNION ALL SELECT 'model', 'DistributedModel at theta 1.0 of a ' || land FROM names UNION ALL SELECT 'unwrapped', land FROM names""")
add("landscape_checks", f"""{_SHIP_EDGES}, a AS (SELECT min(least(src, dst)) AS lo, max(greatest(src, dst)) AS hi, min(least(src, dst + 31)) AS clo, max(greatest(src, dst + 31)) AS chi, min(-ln(3 * value)) AS least FROM edges)
SELECT 'complete' AS name, false AS refused, NULL AS reason UNION ALL SELECT 'no affinities', true, 'affinities are needed'
UNION ALL SELECT 'grid too small', true, 'grid size (30, 12) is incompatible with the cells ' || lo || ' to ' || hi FROM a WHERE hi > 360
UNION ALL SELECT 'costs outside', true, 'grid size (31, 12) is incompatible with the cells ' || clo || ' to ' || chi FROM a WHERE chi > 372
UNION ALL SELECT 'negative costs', least < 0, 'the cost graph can have only non-negative edge weights' FROM a""")
add("separator_tree_z", _SQL["fundamental_matrix"])
add("separator_tree_flow", _SQL["betweenness_q"])
add("theta_calibration", rec(f"{model_sql(npix=5)}, {cost_sql()}", f"SELECT 1.0::DOUBLE AS theta, round(value, 3) AS kl FROM ({_KL})"))
