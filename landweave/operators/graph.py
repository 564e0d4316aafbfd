"""Graph operators on edge tables: strong components, and the distributed solvers.

Everything is a DataFrame loop whose rounds are written to the shared folder; a task holds the edges inside one range of ``PART`` ids.
Tables that grow with the graph are joined by merge: their files are so well compressed that Spark would broadcast them, through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landweave.operators import kernels
from landweave.plans.stages import discard, written

#: Ids in one range, whose inner edges a task contracts.
PART = 4096


def strong_components(edges: DataFrame, part: int = PART) -> DataFrame:
    """node, component (its least node) of every node that an edge touches.

    The same steps at every size. What is strongly connected inside a range of ids is contracted first, a task for each range (on a
    raster that is nearly all); then what edges in both directions connect; then chains, by pointer doubling, and ends, which are components of
    their own; the rest is flooded.
    """
    pairs = written(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")), "scc")

    def label(table: pa.Table) -> pa.Table:
        src, dst = table.column("src").to_numpy(), table.column("dst").to_numpy()
        ids, both = np.unique(np.concatenate([src, dst]), return_inverse=True)
        found = kernels.strong_components(len(ids), both[: len(src)], both[len(src) :])
        return pa.table({"node": ids, "root": ids[found]})

    of = lambda c: F.expr(f"{c} div {part}")
    inner = pairs.where(of("src") == of("dst")).groupBy(of("src")).applyInArrow(label, "node long, root long")
    nodes = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
    group = written(nodes.join(inner.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root")), "scc")
    # groups without an edge in, or out, are alone; on a raster these are the cells that can't be entered
    between = written(inside(contracted(pairs, group)), "scc")
    if between.isEmpty():
        return group.select("node", F.col("root").alias("component"))
    return whole(group, strong_components_by_colour(between))


def inside(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have edges in and out."""
    into, out = edges.select(F.col("dst").alias("node")).distinct(), edges.select(F.col("src").alias("node")).distinct()
    both = into.join(out.hint("merge"), "node", "left_semi").hint("merge")
    return edges.join(both.withColumnRenamed("node", "src"), "src", "left_semi").join(both.withColumnRenamed("node", "dst"), "dst", "left_semi")


def contracted(edges: DataFrame, group: DataFrame) -> DataFrame:
    """src, dst between different groups (node, root)."""
    of = lambda c, r: group.select(F.col("node").alias(c), F.col("root").alias(r)).hint("merge")
    return edges.join(of("src", "rs"), "src").join(of("dst", "rd"), "dst").where("rs <> rd").select(F.col("rs").alias("src"), F.col("rd").alias("dst")).distinct()


def whole(group: DataFrame, found: DataFrame) -> DataFrame:
    """node, component from groups (node, root) and the components (node, component) of their roots, named by the least node."""
    joined = group.join(found.withColumnRenamed("node", "root").hint("merge"), "root", "left").select("node", F.coalesce("component", "root").alias("component"))
    return joined


def chained(edges: DataFrame, rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """(inner: node, ahead, behind of every node on a chain; ring: node, component of those on a ring alone).

    A node on a chain has one edge in and one out. ``ahead`` and ``behind`` are the nodes off the chain where it comes from and leads to,
    found by pointer doubling; a chain that has none is a ring, one component.
    """
    once = lambda c, o: edges.groupBy(F.col(c).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min(o).alias(o)).where("n = 1").select("node", o)
    links = written(once("dst", "src").join(once("src", "dst").hint("merge"), "node"), "chains")
    out = None
    for end, name in (("src", "ahead"), ("dst", "behind")):
        state = written(links.select("node", F.col(end).alias("at"), F.least("node", end).alias("least"), F.lit(True).alias("on")), "chains")
        for _ in range(rounds):
            nxt = state.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("least").alias("low"), F.lit(True).alias("more"))
            moved = written(state.join(nxt.hint("merge"), "at", "left").select("node", F.coalesce("next", "at").alias("at"), F.least("least", "low").alias("least"), F.col("more").isNotNull().alias("on")), "chains")
            done = moved.where("on").isEmpty() or moved.select("node", "at", "least").where("on").exceptAll(state.select("node", "at", "least")).isEmpty()
            # on a ring the least node is known after as many rounds as its length has bits, though pointers go on
            settled = done or moved.join(state.select("node", F.col("least").alias("old")).hint("merge"), "node").where("on and least <> old").isEmpty()
            discard(state)
            state = moved
            if done or settled and _rings_only(state):
                break
        part = state.select("node", F.col("at").alias(name), F.col("least").alias(f"least_{name}"), F.col("on").alias(f"ring_{name}"))
        out = part if out is None else out.join(part.hint("merge"), "node")
    both = written(out, "chains")
    return both.where("not ring_ahead").select("node", "ahead", "behind"), both.where("ring_ahead").select("node", F.least("least_ahead", "least_behind").alias("component"))


def _rings_only(state: DataFrame) -> bool:
    """Whether all pointers that still lead to nodes on chains stay on them: then these are rings."""
    on = state.where("on").select("node", "at")
    return on.join(state.where("not on").select(F.col("node").alias("at")).hint("merge"), "at", "left_semi").isEmpty()


def joined_both_ways(edges: DataFrame) -> DataFrame:
    """node, root: nodes connected by edges that run in both directions, with the least node of their group.

    Alternating stars: every node hands its larger neighbours, then its smaller ones, to the least node that it knows, so
    the rounds grow with the logarithm of the nodes and not with the length of paths.
    """
    down = (F.col("src") > F.col("dst")).alias("down")
    pairs = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"), down)
    star = written(pairs.groupBy("u", "v").agg(F.min("down").alias("a"), F.max("down").alias("b")).where("a <> b").select("u", "v"), "scc")
    while True:
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "scc")
        ends = F.explode(F.array(F.col("u"), F.col("v"))).alias("u")
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")).hint("merge"), "u").select(ends, F.col("m").alias("v")).where("u <> v").distinct()
        small = written(small, "scc")
        settled = small.count() == star.count() and small.join(star.hint("merge"), ["u", "v"], "left_anti").isEmpty()
        discard(large)
        discard(star)
        star = small
        if settled:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))


def strong_components_by_colour(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """The same without ranges of ids: groups of two-way edges, then chains and ends, then the flood."""
    edges = written(edges.select("src", "dst").distinct(), "scc")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    group = written(nodes.join(joined_both_ways(edges).hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root")), "scc")
    between = written(contracted(edges, group), "scc")
    found = None
    if not between.isEmpty():
        found = thinned(between, rounds)
    return group.select("node", F.col("root").alias("component")) if found is None else least_named(whole(group, found))


def least_named(found: DataFrame) -> DataFrame:
    """The components by their least node."""
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least.hint("merge"), "component").select("node", F.col("least").alias("component"))


def thinned(edges: DataFrame, rounds: int) -> DataFrame:
    """node, component: chains become one edge and ends go, as long as that removes a tenth of the nodes; the rest is flooded."""
    alone, held, done = [], [], []
    size = None
    while True:
        # ends: without an edge in, or out
        sources, sinks = edges.select(F.col("src").alias("node")).distinct(), edges.select(F.col("dst").alias("node")).distinct()
        kept = written(sources.join(sinks.hint("merge"), "node", "left_semi"), "kept")
        alone.append(sources.union(sinks).distinct().join(kept.hint("merge"), "node", "left_anti").select("node", F.col("node").alias("component")))
        inside = lambda c, k=kept: k.select(F.col("node").alias(c)).hint("merge")
        edges = written(edges.join(inside("src"), "src", "left_semi").join(inside("dst"), "dst", "left_semi"), "thin")
        now = edges.count()
        if not now:
            break
        if size is not None and now > 0.9 * size:
            done.append(flooded(edges, rounds))
            break
        size = now
        chain, ring = chained(edges)
        chain = written(chain, "chain")
        held.append(chain)
        done.append(ring)
        off = written(kept.join(chain.select("node").union(ring.select("node")).hint("merge"), "node", "left_anti"), "off")
        stay = lambda c, k=off: k.select(F.col("node").alias(c)).hint("merge")
        direct = edges.join(stay("src"), "src", "left_semi").join(stay("dst"), "dst", "left_semi")
        across = chain.select(F.col("ahead").alias("src"), F.col("behind").alias("dst")).distinct()
        # a chain that comes back to where it left is one component with it
        edges = written(direct.unionByName(across.where("src <> dst")).distinct(), "thin")
        lost = written(off.join(edges.select(F.col("src").alias("node")).union(edges.select("dst")).hint("merge"), "node", "left_anti"), "lost")
        alone.append(lost.select("node", F.col("node").alias("component")))
        if edges.isEmpty():
            break
    found = alone[0]
    for part in [*alone[1:], *done]:
        found = found.unionByName(part)
    found = written(found, "found")
    for chain in reversed(held):  # a chain between two nodes of one component belongs to it
        of = lambda c, f=found: f.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")).hint("merge")
        mine = chain.join(of("ahead"), "ahead", "left").join(of("behind"), "behind", "left")
        same = F.col("of_ahead") == F.col("of_behind")
        found = written(found.unionByName(mine.select("node", F.when(same, F.col("of_ahead")).otherwise(F.col("node")).alias("component"))), "found")
    return found


def flooded(edges: DataFrame, rounds: int) -> DataFrame:
    """node, component: the largest id floods forward; what reaches its root within its colour is a component."""
    left = written(edges.distinct(), "scc")
    nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
    done = None
    for _ in range(rounds):
        colour = written(nodes.select("node", F.col("node").alias("colour")), "scc")
        while True:
            pushed = left.join(colour.withColumnRenamed("node", "src").hint("merge"), "src").select(F.col("dst").alias("node"), "colour")
            grown = written(colour.union(pushed).groupBy("node").agg(F.max("colour").alias("colour")), "scc")
            if grown.exceptAll(colour).isEmpty():
                break
            colour = grown
        same = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")).hint("merge"), "src").join(
            colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")).hint("merge"), "dst"
        ).where("cs = cd")
        same = written(same.select("src", "dst", F.col("cs").alias("colour")), "scc")
        reach = written(colour.where("node = colour").select("node", "colour"), "scc")
        while True:
            back = same.join(reach.withColumnRenamed("node", "dst").hint("merge"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour")
            grown = written(reach.union(back).distinct(), "scc")
            if grown.count() == reach.count():
                break
            reach = grown
        part = reach.select("node", F.min("node").over(Window.partitionBy("colour")).alias("component"))
        done = part if done is None else done.union(part)
        nodes = written(nodes.join(reach.select("node").hint("merge"), "node", "left_anti"), "scc")
        if nodes.isEmpty():
            return written(done, "scc")
        left = written(left.join(nodes.withColumnRenamed("node", "src").hint("merge"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst").hint("merge"), "dst", "left_semi"), "scc")
    raise RuntimeError("strong components did not settle")


def largest_component(edges: DataFrame, **options) -> DataFrame:
    """node of the component with most nodes; of equal ones that with the least node."""
    found = strong_components(edges, **options)
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "component").limit(1)
    return found.join(F.broadcast(sizes.select("component")), "component", "left_semi").select("node")  # one row is broadcast


def is_strongly_connected(edges: DataFrame, nodes: DataFrame | None = None) -> bool:
    """One component only; ``nodes`` (node) may hold nodes without edges, which then are components."""
    found = strong_components(edges)
    count = found.select("component").distinct().limit(2).count()
    if nodes is None:
        return count <= 1
    alone = nodes.join(found.hint("merge"), "node", "left_anti").limit(2).count()
    return count + alone <= 1


class Powers:
    """W, W^2, W^4, ... of a table (src, dst, w), each made once, by a join of the last one with itself."""

    def __init__(self, w: DataFrame):
        self.made = [written(w.select("src", "dst", "w").where("w > 0"), "power")]

    def of(self, k: int, transposed: bool = False) -> DataFrame:
        """W^(2^k)."""
        while len(self.made) <= k:
            last = self.made[-1]
            right = last.select(F.col("src").alias("mid"), F.col("dst").alias("to"), F.col("w").alias("b"))
            squared = last.join(right, F.col("dst") == F.col("mid")).groupBy("src", F.col("to").alias("dst")).agg(F.sum(F.col("w") * F.col("b")).alias("w")).where("w > 0")
            self.made.append(written(squared, "power"))
        found = self.made[k]
        return found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w") if transposed else found

    def discard(self) -> None:
        while self.made:
            discard(self.made.pop())


def neumann(w: DataFrame, targets: DataFrame, terms: int = 1 << 24, tol: float = 1e-8) -> DataFrame:
    """node, target, value of the fundamental matrix in the columns of ``targets`` (target)."""
    powers = Powers(w)
    try:
        return series(powers, targets.select(F.col("target").alias("node"), "target", F.lit(1.0).alias("value")), terms, tol)
    finally:
        powers.discard()


def series(powers: Powers, start: DataFrame, terms: int = 1 << 24, tol: float = 1e-8, transposed: bool = False) -> DataFrame:
    """node, target, value of (I - W)^-1 E by joins and sums alone; the tables of powers grow to all pairs of nodes.

    ``start`` is E (node, target, value), not negative. The series E + WE + W^2 E + ... is summed in doubling steps: with
    S_m its first m terms, S_2m = S_m + W^m S_m, and W^2m = W^m W^m. If W^m S_m <= e S_2m in every entry, then
    W^m S_2m <= d S_2m with d = e / (1 - e), and what is missing is at most d^2 / (1 - d^2) of each entry, so no node
    either. Raises if this does not hold for e = ``tol`` at ``terms`` terms. Values below double precision have no row.
    """
    total = written(start.select("node", "target", "value", F.lit(0.0).alias("added")), "series")
    step = 0
    while 1 << step < terms:
        moved = powers.of(step, transposed).join(total.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "target", (F.col("w") * F.col("value")).alias("value"))
        both = total.withColumn("added", F.lit(0.0)).unionByName(moved.withColumn("added", F.col("value")))
        grown = written(both.groupBy("node", "target").agg(F.sum("value").alias("value"), F.sum("added").alias("added")), "series")
        discard(total)
        total = grown
        step += 1
        if total.where((F.col("added") > tol * F.col("value")) | (F.col("value") == float("inf"))).isEmpty():
            return total.drop("added")
    raise RuntimeError(f"the series did not settle in {1 << step} terms")


def least_cost(edges: DataFrame, targets: DataFrame, rounds: int = 10_000) -> DataFrame:
    """node, target, value: least cost from each target to each node it reaches, by relaxing the frontier."""
    best = written(targets.select(F.col("target").alias("node"), "target", F.lit(0.0).alias("value")), "least")
    frontier = best
    for _ in range(rounds):
        step = frontier.join(edges.select(F.col("src").alias("node"), "dst", "cost"), "node").select(F.col("dst").alias("node"), "target", (F.col("value") + F.col("cost")).alias("value"))
        step = step.groupBy("node", "target").agg(F.min("value").alias("new"))
        better = step.join(best, ["node", "target"], "left").where("value is null or new < value").select("node", "target", F.col("new").alias("value"))
        frontier = written(better, "least")
        if frontier.isEmpty():
            return best
        best = written(best.unionByName(frontier).groupBy("node", "target").agg(F.min("value").alias("value")), "least")
    raise RuntimeError("least costs did not settle")
