"""Least costs over the tiles of a raster, and least-cost trees, as tables.

Where edges stay near, least costs come from the separator tree of ``dissection`` with least sums for sums of products: its jobs grow
with the logarithm of the raster's side, not with the tiles that a path crosses. Where they don't, so that a front of it would be too large, they go by hops: a tile
of ``tile`` x ``tile`` cells is entered over edges from other tiles. One pass over the tiles gives the least cost
from each entry through the tile and over the next edge: the hops between entries. Distances to entries are then relaxed over hops, a
round for each tile that a path crosses, and a last pass fills the tiles from their entries. No task holds more than a
tile, its entries and a block of targets; a graph whose edges don't stay near is all entries, and as right.

Trees follow from distances: a node's parent is a neighbour on an edge that closes the gap (of several the least,
within ``SAME`` of the distance). Sums along the paths of all trees come from pointer doubling, in log2(depth) steps: inside tiles of ``PATCH`` x ``PATCH`` cells
in one task each, up to the cell where a path leaves the tile, then by joins of those cells alone (``Tiles.summed_paths``). ``parents`` and ``summed_up`` do it
by joins of all pairs of nodes and targets; ``summed_up`` is what joins the cells between tiles.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.operators import dissection
from landweave.operators.dissection import Dissection, Least, blocks
from landweave.plans.stages import discard, written

TILE = 32
#: Targets that a tile is filled for at once.
BLOCK = 64
#: The side of the tiles in which paths are summed, and the targets a task looks at together.
PATCH, TOGETHER = 64, 32
#: Distances that differ by less than this share, or 1e-12, are equal.
SAME = 1e-12


def relaxed(dist: np.ndarray, src: np.ndarray, dst: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Least sums (rows x cells) from ``dist`` over edges, all rows at once, until nothing gets less."""
    if not len(src):
        return dist
    by = np.argsort(dst, kind="stable")
    src, dst, cost = src[by], dst[by], cost[by]
    to, first = np.unique(dst, return_index=True)
    left = np.arange(len(dist))
    while len(left):
        now = dist[np.ix_(left, to)]
        got = np.minimum.reduceat(dist[np.ix_(left, src)] + cost, first, axis=1)
        better = got < now
        dist[np.ix_(left, to)] = np.where(better, got, now)
        left = left[better.any(1)]
    return dist


class Tiles:
    """``edges`` is (src, dst, cost) on an nrows x ncols raster; costs aren't negative, edges without one are none."""

    def __init__(self, edges: DataFrame, nrows: int, ncols: int, tile: int = TILE):
        self.nrows, self.ncols, self.tile = nrows, ncols, tile
        self.costs = written(edges.where("cost is not null and not isnan(cost)").select("src", "dst", "cost"), "costs")

    @cached_property
    def tree(self) -> Dissection:
        return Dissection(self.costs.withColumnRenamed("cost", "w"), self.nrows, self.ncols, self.tile, Least)

    @cached_property
    def edges(self) -> DataFrame:
        return written(self.costs.select("src", "dst", "cost", self.place("src").alias("a"), self.place("dst").alias("b")), "costs")

    @property
    def inner(self) -> DataFrame:
        return self.edges.where("a = b").select("a.*", "src", "dst", "cost")

    @property
    def over(self) -> DataFrame:
        return self.edges.where("a <> b")

    def place(self, cell: str, tile: int | None = None):
        side = tile or self.tile
        return F.expr(f"struct((({cell} - 1) % {self.nrows}) div {side} as tr, (({cell} - 1) div {self.nrows}) div {side} as tc)")

    def hops(self) -> DataFrame:
        """src, dst, cost: from an entry to an entry of another tile."""
        ends = self.over.select("b.*", F.col("dst").alias("cell"), F.lit(True).alias("entry")).union(self.over.select("a.*", F.col("src").alias("cell"), F.lit(False).alias("entry"))).distinct()

        def cross(edges: pa.Table, ends: pa.Table) -> pa.Table:
            cells, entry = ends.column("cell").to_numpy(), ends.column("entry").to_numpy(zero_copy_only=False)
            src, dst, cost = (edges.column(c).to_numpy() for c in ("src", "dst", "cost"))
            every = np.unique(np.concatenate([cells, src, dst]))
            into, out = np.unique(cells[entry]), np.unique(cells[~entry])
            at = lambda x: np.searchsorted(every, x)
            dist = np.full((len(into), len(every)), np.inf)
            dist[np.arange(len(into)), at(into)] = 0.0
            found = relaxed(dist, at(src), at(dst), cost)[:, at(out)]
            i, j = np.nonzero(np.isfinite(found))
            return pa.table({"src": into[i], "out": out[j], "cost": found[i, j]})

        through = self.inner.groupBy("tr", "tc").cogroup(ends.groupBy("tr", "tc")).applyInArrow(cross, "src long, out long, cost double")
        steps = self.over.select(F.col("src").alias("out"), "dst", F.col("cost").alias("last"))
        joined = through.join(steps, "out").groupBy("src", "dst").agg(F.min(F.col("cost") + F.col("last")).alias("cost"))
        return written(joined.where("src <> dst"), "hops")

    def filled(self, start: DataFrame) -> DataFrame:
        """node, target, value: least sums inside tiles from known values (node, target, value) of some of their cells."""
        block = F.pmod(F.xxhash64("target"), F.lit(self._blocks(start))).cast("int").alias("block")
        known = start.select(self.place("node").alias("p"), block, "node", "target", "value")
        known = written(known.select("p.*", "block", "node", "target", "value"), "known")
        used = known.select("tr", "tc", F.col("block").alias("part")).distinct()
        edges = self.inner.join(used, ["tr", "tc"])

        def fill(edges: pa.Table, known: pa.Table) -> pa.Table:
            node, target, value = (known.column(c).to_numpy() for c in ("node", "target", "value"))
            src, dst, cost = (edges.column(c).to_numpy() for c in ("src", "dst", "cost"))
            every, targets = np.unique(np.concatenate([node, src, dst])), np.unique(target)
            at = lambda x: np.searchsorted(every, x)
            dist = np.full((len(targets), len(every)), np.inf)
            np.minimum.at(dist, (np.searchsorted(targets, target), at(node)), value)
            found = relaxed(dist, at(src), at(dst), cost)
            i, j = np.nonzero(np.isfinite(found))
            return pa.table({"node": every[j], "target": targets[i], "value": found[i, j]})

        return edges.groupBy("tr", "tc", "part").cogroup(known.groupBy("tr", "tc", "block")).applyInArrow(fill, "node long, target long, value double")

    @staticmethod
    def _blocks(start: DataFrame) -> int:
        return max(1, -(-start.select("target").distinct().count() // BLOCK))

    def least_costs(self, targets: DataFrame) -> DataFrame:
        """node, target, value: the least cost from each of ``targets`` (target) to each node that it reaches."""
        if self.tree.grid.front > dissection.FRONT:
            return self._by_hops(targets)
        start = targets.select(F.col("target").alias("node"), "target", F.lit(0.0).alias("value"))
        return written(self.tree.solve(start, transposed=True), "least")

    def columns(self, mine: DataFrame, width: int) -> DataFrame:
        """cell, values: the same for a block of targets (target, n), as one array for each cell, infinite where it isn't reached."""
        if self.tree.grid.front > dissection.FRONT:
            pairs = self._by_hops(mine.select("target")).join(F.broadcast(mine), "target").groupBy(F.col("node").alias("cell"))
            found = pairs.agg(F.map_from_entries(F.collect_list(F.struct("n", "value"))).alias("m"))
            whole = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(np.inf)))
            return written(found.select("cell", whole.alias("values")), "least")
        unit = mine.select(F.col("target").alias("cell"), F.array("n").alias("at"), F.array(F.lit(0.0)).alias("values"))
        return written(self.tree.columns(unit, width, transposed=True), "least")

    def _by_hops(self, targets: DataFrame, rounds: int = 100_000) -> DataFrame:
        start = written(targets.select(F.col("target").alias("node"), "target", F.lit(0.0).alias("value")), "start")
        first = written(self.filled(start), "first")
        over = self.over.select(F.col("src").alias("node"), "dst", "cost")
        step = lambda df, by: df.join(by, "node").groupBy(F.col("dst").alias("node"), "target").agg(F.min(F.col("value") + F.col("cost")).alias("value"))
        best = frontier = written(step(first, over), "entries")
        hops = self.hops().withColumnRenamed("src", "node")
        for _ in range(rounds):
            new = step(frontier, hops).withColumnRenamed("value", "new")
            better = new.join(best, ["node", "target"], "left").where("value is null or new < value").select("node", "target", F.col("new").alias("value"))
            found = written(better, "entries")
            if found.isEmpty():
                return written(self.filled(start.unionByName(best)), "least")
            grown = written(best.unionByName(found).groupBy("node", "target").agg(F.min("value").alias("value")), "entries")
            for old in {id(x): x for x in (best, frontier)}.values():
                discard(old)
            best, frontier = grown, found
        raise RuntimeError("least costs did not settle")

    def summed_paths(self, steps: DataFrame, targets: DataFrame) -> DataFrame:
        """node, target, value: the sums along least-cost paths from each node to the targets; ``steps`` (node, parent, value) are those back along
        edges, infinite where there is none.

        Raises where parents run in a circle, as edges of cost 0 in both directions make them.
        """
        at = lambda c: self.place(c, PATCH)
        into = self.costs.select(at("dst").alias("p"), F.col("dst").alias("node"), F.col("src").alias("parent"), "cost", F.lit(None).cast("double").alias("step"))
        back = steps.select(at("node").alias("p"), "node", "parent", F.lit(None).cast("double").alias("cost"), F.col("value").alias("step"))
        both = written(into.unionByName(back).select("p.*", "node", "parent", "cost", "step"), "steps")
        over = self.costs.where(at("src") != at("dst")).groupBy(F.col("src").alias("cell")).agg(F.collect_set(at("dst")).alias("next"))
        over = written(over, "over")
        out = None
        for mine, width in blocks(targets):
            part = self._summed(both, over, mine, width)
            out = part if out is None else out.unionByName(part)
        return out if out is not None else targets.select(F.col("target").alias("node"), "target", F.lit(0.0).alias("value"))

    def _summed(self, both: DataFrame, over: DataFrame, mine: DataFrame, width: int) -> DataFrame:
        ids = np.array([r.target for r in mine.orderBy("n").collect()], np.int64)  # a block of targets at most
        dist = self.columns(mine, width).join(over.hint("merge"), "cell", "left")
        here = lambda c: F.struct(self.place(c, PATCH).alias("p"), F.lit(True).alias("own"))
        there = F.transform(F.coalesce("next", F.array()), lambda p: F.struct(p.alias("p"), F.lit(False).alias("own")))
        sent = dist.select("cell", "values", F.col("next").isNotNull().alias("leaves"), F.explode(F.concat(F.array(here("cell")), there)).alias("x"))
        sent = sent.select("x.p.*", "x.own", "cell", "values", "leaves")
        tiles = both.groupBy("tr", "tc").cogroup(sent.groupBy("tr", "tc"))
        paths = written(tiles.applyInArrow(lambda edges, known: left_at(edges, known, ids), "cell long, leaves boolean, exits array<long>, values array<double>"), "paths")
        # between tiles: a row for each cell on their edges
        ends = paths.where("leaves").select(F.col("cell").alias("node"), F.posexplode(F.arrays_zip("exits", "values")).alias("n", "x")).where("x.exits is not null")
        ends = ends.join(F.broadcast(mine), "n").where("node <> target").select("node", "target", F.col("x.exits").alias("parent"), F.col("x.values").alias("value"))
        known = summed_up(ends, mine.select("target")).join(F.broadcast(mine), "target").groupBy(F.col("node").alias("cell"))
        known = known.agg(F.collect_list("n").alias("at"), F.collect_list("value").alias("values")).join(over.hint("merge"), "cell")
        known = known.select(F.explode("next").alias("p"), "cell", "at", "values").select("p.*", "cell", "at", "values")
        mine_ = paths.select(self.place("cell", PATCH).alias("p"), "cell", "exits", "values").select("p.*", "cell", "exits", "values")
        whole = mine_.groupBy("tr", "tc").cogroup(known.groupBy("tr", "tc")).applyInArrow(lambda paths, known: led_on(paths, known, ids), "cell long, values array<double>")
        flat = whole.select(F.col("cell").alias("node"), F.posexplode("values").alias("n", "value")).where("value is not null")
        return flat.join(F.broadcast(mine), "n").select("node", "target", "value")


def least_parents(dist: np.ndarray, cells: np.ndarray, own: np.ndarray, src: np.ndarray, dst: np.ndarray, cost: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """cells x targets: the edge from the least neighbour before each of a tile's own cells, or -1; edges are sorted by ``dst``, then ``src``."""
    out = np.full(dist.shape, -1)
    if not len(src):
        return out
    to, first = np.unique(dst, return_index=True)
    now = dist[dst]
    tight = (dist[src] + cost[:, None] <= now + SAME * np.maximum(1.0, now)) & (now < np.inf)
    best = np.minimum.reduceat(np.where(tight, np.arange(len(src))[:, None], len(src)), first, axis=0)
    out[to] = np.where((best < len(src)) & own[to, None] & (cells[to, None] != targets), best, -1)
    return out


def left_at(edges: pa.Table, known: pa.Table, targets: np.ndarray) -> pa.Table:
    """Where each path from a tile's cells first leaves it, or its target, and the sum up to there: cell, leaves, exits, values."""
    cells, by = np.unique(known.column("cell").to_numpy(), return_index=True)
    width = len(targets)
    dist = known.column("values").combine_chunks().flatten().to_numpy().reshape(known.num_rows, width)[by]
    own, leaves = (known.column(c).to_numpy(zero_copy_only=False)[by] for c in ("own", "leaves"))
    node, parent, cost, step = (edges.column(c).to_numpy(zero_copy_only=False) for c in ("node", "parent", "cost", "step"))
    ways = np.isin(node, cells) & np.isin(parent, cells)  # of cells that some target reaches
    place = lambda x: np.searchsorted(cells, x)
    none = edges.column("cost").is_null().to_numpy(zero_copy_only=False)  # these are the steps back
    into, back = ways & ~none, ways & none
    src, dst, cost = place(parent[into]), place(node[into]), cost[into]
    order = np.lexsort((src, dst))
    src, dst, cost = src[order], dst[order], cost[order]
    code, value = place(node[back]) * len(cells) + place(parent[back]), step[back]
    order = np.argsort(code)
    code, value = code[order], value[order]
    found = np.searchsorted(code, dst * len(cells) + src)
    there = np.minimum(found, max(len(code) - 1, 0))
    same = code[there] == dst * len(cells) + src if len(code) else np.zeros(len(src), bool)
    step = np.where(same, value[there], np.inf) if len(code) else np.full(len(src), np.inf)
    exits, sums = np.full((int(own.sum()), width), -1, np.int64), np.zeros((int(own.sum()), width))
    goes_on = leaves[own]
    for k in range(0, width, TOGETHER):
        some = slice(k, k + TOGETHER)
        best = least_parents(dist[:, some], cells, own, src, dst, cost, targets[some])
        has = best >= 0
        at = np.where(has, src[best] if len(src) else 0, np.arange(len(cells))[:, None])
        total = np.where(has, step[best] if len(src) else 0.0, 0.0)
        for _ in range(len(cells).bit_length()):
            total = total + np.take_along_axis(total, at, 0)
            at = np.take_along_axis(at, at, 0)
        circle = np.take_along_axis(has, at, 0)  # still on its way: parents run in a circle, and ``summed_up`` finds it
        stuck = ~circle & own[at] & (cells[at] != targets[some])  # no neighbour before it
        reached = (dist[:, some] < np.inf) & ~stuck
        exits[:, some], sums[:, some] = np.where(reached, cells[at], -1)[own], total[own]
        goes_on = goes_on | circle[own].any(1)
    return pa.table({"cell": cells[own], "leaves": goes_on, "exits": _lists(exits, exits < 0), "values": _lists(sums, exits < 0)})


def led_on(paths: pa.Table, known: pa.Table, targets: np.ndarray) -> pa.Table:
    """The sums to the target: those up to the exits (cell, exits, values) and those from there on (cell, at, values)."""
    width = len(targets)
    cells = paths.column("cell").to_numpy()
    flat = lambda c, none: paths.column(c).combine_chunks().flatten().fill_null(none).to_numpy().reshape(len(cells), width)
    exits, sums = flat("exits", -1), flat("values", 0.0)
    ends = np.unique(known.column("cell").to_numpy())
    more = np.full((len(ends) + 1, width), np.nan)
    for cell, at, values in zip(*(known.column(c) for c in ("cell", "at", "values")), strict=True):
        more[np.searchsorted(ends, cell.as_py()), at.values.to_numpy()] = values.values.to_numpy()
    place = np.searchsorted(ends, exits)
    place = np.where((place < len(ends)) & (np.append(ends, -1)[place] == exits), place, len(ends))
    home = exits == targets
    absent = (exits < 0) | ~(home | (place < len(ends)))
    total = sums + np.where(home, 0.0, more[place, np.arange(width)])
    return pa.table({"cell": cells, "values": _lists(total, absent)})


def _lists(x: np.ndarray, absent: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), mask=absent.ravel()))


def parents(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """node, target, parent: the least neighbour before each node on a least-cost path from the target; the target has none."""
    ahead = dist.select(F.col("node").alias("src"), "target", F.col("value").alias("before")).join(edges.where("cost is not null and not isnan(cost)").select("src", F.col("dst").alias("node"), "cost"), "src")
    x = F.col("before") + F.col("cost")
    tight = ahead.join(dist, ["node", "target"]).where((F.col("node") != F.col("target")) & (x <= F.col("value") + SAME * F.greatest(F.lit(1.0), F.col("value"))))
    return tight.groupBy("node", "target").agg(F.min("src").alias("parent"))


def summed_up(tree: DataFrame, targets: DataFrame, rounds: int = 64) -> DataFrame:
    """node, target, value: the sum of ``value`` of ``tree`` (node, target, parent, value) along each node's path to its target; the target has 0.

    Raises where parents run in a circle, as edges of cost 0 in both directions make them.
    """
    roots = targets.select(F.col("target").alias("node"), "target", F.col("target").alias("parent"), F.lit(0.0).alias("value"))
    state = written(tree.select("node", "target", "parent", "value").unionByName(roots), "paths")
    for _ in range(rounds):
        if state.where("parent <> target").isEmpty():
            return state.select("node", "target", "value")
        up = state.select(F.col("node").alias("parent"), "target", F.col("parent").alias("next"), F.col("value").alias("more"))
        longer = written(state.join(up.hint("merge"), ["parent", "target"]).select("node", "target", F.col("next").alias("parent"), (F.col("value") + F.col("more")).alias("value")), "paths")
        discard(state)
        state = longer
    raise ValueError("parents run in a circle: edges of cost 0 have no least-cost tree")
