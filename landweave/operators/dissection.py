"""Nested dissection of a raster's graph, held as tables: (I - W) X = B and its transpose without a table of all pairs.

The raster is cut into tiles of ``tile`` x ``tile`` cells at most, a power of two along its longer side so that all blocks of a level are alike, by lines as wide as the longest edge reaches. Line j (between tiles
j - 1 and j) is of level 1 + the number of times that 2 divides j, a cell of the level of the highest line it is on, 0 inside tiles. So
the lines of level k inside a block of 2^k x 2^k tiles are a cross that separates its four quarters, and blocks make a tree.

Cells are eliminated level by level, one group for each block: the block's cross, together with what its quarters have left on the
lines around them, is a dense front; the cross is eliminated and the Schur complement on the lines around the block goes to the
next level. For each front the inverse of the cross's part and its couplings are kept as a row. A solve goes up the tree (what each
block's right-hand sides leave on the lines around it) and down again (each cross from the lines around it). W is not negative
with row sums of 1 at most, so all terms of these sums have the same sign and tiny entries keep their digits.
With the ``Least`` algebra W holds costs, and the same tree gives least costs: least sums stand for sums of products.

A front of a block of side m has some 6 m cells, so a raster of side n has n^2 log n numbers of factors in all, and the largest
front 2 n cells: 32 MB at 1,000 x 1,000. ``FRONT`` bounds it. Tiles keep their edges only, in one row each, and are factorised anew in each
solve, strip by strip. Jobs grow with the levels, log2(n / tile); right-hand sides are solved in blocks of ``COLUMNS`` targets.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.plans.stages import discard, written

TILE = 32
COLUMNS = 512
#: Cells of one front at most: 8 bytes for each pair of them.
FRONT = 8000
NODE = ["level", "br", "bc"]
FACTOR = "level int, br long, bc long, own array<long>, rim array<long>, inverse binary, out binary, back binary, left binary, src binary, dst binary, w binary"
ROW = "cell long, at array<int>, values array<double>"


class Grid:
    """The tiles and lines of a raster."""

    def __init__(self, nrows: int, ncols: int, tile: int, reach: int):
        if max(nrows, ncols) > tile:
            longest = max(nrows, ncols) + reach
            halvings = (-(-longest // (tile + reach)) - 1).bit_length()
            tile = max(-(-longest // (1 << halvings)) - reach, reach)
        self.nrows, self.ncols, self.tile, self.reach, self.pitch = nrows, ncols, tile, reach, tile + reach
        lines = [max(0, -(-(n - tile) // self.pitch)) for n in (nrows, ncols)]
        tiles = [-(-n // self.pitch) for n in (nrows, ncols)]
        self.top = max(*(x.bit_length() for x in lines), *((t - 1).bit_length() for t in tiles))

    @property
    def front(self) -> int:
        """Cells of the largest front, at most: a tile with the lines around it, or the crosses of the last two levels."""
        tile = min(self.nrows, self.tile + 2 * self.reach) * min(self.ncols, self.tile + 2 * self.reach)
        return max(tile, 2 * self.reach * ((self.pitch << self.top) + 4 * self.reach) if self.top else 0)

    def place(self, cell: str) -> Column:
        """A struct of level, br, bc: the block whose cross, or tile, a cell is in."""
        at = {"r": f"((({cell} - 1) % {self.nrows}) div {self.pitch})", "c": f"((({cell} - 1) div {self.nrows}) div {self.pitch})"}
        off = {"r": f"((({cell} - 1) % {self.nrows}) % {self.pitch})", "c": f"((({cell} - 1) div {self.nrows}) % {self.pitch})"}
        line = {k: f"if({off[k]} >= {self.tile}, bit_count((({at[k]} + 1) & -({at[k]} + 1)) - 1) + 1, 0)" for k in "rc"}
        level = f"greatest({line['r']}, {line['c']})"
        return F.expr(f"struct(cast({level} as int) as level, shiftright({at['r']}, cast({level} as int)) as br, shiftright({at['c']}, cast({level} as int)) as bc)")

    def level(self, cell: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cell), int)
        for x in ((cell - 1) % self.nrows, (cell - 1) // self.nrows):
            j, on = x // self.pitch + 1, x % self.pitch >= self.tile
            out = np.maximum(out, np.where(on, np.round(np.log2(j & -j)).astype(int) + 1, 0))
        return out


def least_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least a[i, k] + b[k, j] over k, some rows at a time, which stay in a core's cache."""
    out = np.full((len(a), b.shape[1]), np.inf)
    step = max(8, 40_000 // max(1, b.shape[1]))
    for i in range(0, len(a), step):
        some, mine = out[i : i + step], a[i : i + step]
        now = np.empty_like(some)
        for k in np.flatnonzero((mine < np.inf).any(0)):
            np.add(mine[:, k, None], b[k], out=now)
            np.minimum(some, now, out=some)
    return out


def closure(a: np.ndarray, small: int = 64) -> np.ndarray:
    """Least sums along paths of any length, by halves."""
    if len(a) <= small:
        a = np.minimum(a, np.where(np.eye(len(a), dtype=bool), 0.0, np.inf))
        for k in range(len(a)):
            a = np.minimum(a, a[:, k, None] + a[k])
        return a
    h = len(a) // 2
    p = closure(a[:h, :h])
    q, r = least_sums(p, a[:h, h:]), least_sums(a[h:, :h], p)
    s = closure(np.minimum(a[h:, h:], least_sums(r, q)))
    ahead = least_sums(q, s)
    return np.block([[np.minimum(p, least_sums(ahead, r)), ahead], [least_sums(s, r), s]])


def settled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least sums ``closure(a)`` gives on ``b``, without it: each column settles its least entry, then the next."""
    d, left, columns = np.ascontiguousarray(b.T), np.ones(b.T.shape, bool), np.arange(b.shape[1])
    back = np.ascontiguousarray(a.T)
    for _ in range(len(a)):
        now = np.where(left, d, np.inf)
        k = now.argmin(1)
        least = now[columns, k]
        if not (least < np.inf).any():
            break
        left[columns, k] = False
        np.minimum(d, least[:, None] + back[k], out=d)
    return d.T


class Sums:
    """Sums of products: ``inverse`` is that of I - W, ``minus`` takes off."""

    zero, one, add, minus = 0.0, 1.0, np.add, np.subtract
    mul, inverse, total = staticmethod(np.matmul), staticmethod(np.linalg.inv), staticmethod(F.sum)
    last, last_solve = inverse, mul


class Least:
    """Least sums: ``inverse`` holds those along paths, nothing has to be taken off. The last front, the largest, is kept as it is."""

    zero, one, add, minus = np.inf, 0.0, np.minimum, np.minimum
    mul, inverse, total = staticmethod(least_sums), staticmethod(closure), staticmethod(F.min)
    last, last_solve = staticmethod(np.array), staticmethod(settled)


class Inverse:
    def __init__(self, inverse: np.ndarray, solve: Callable):
        self.inverse, self._solve = inverse, solve

    def solve(self, b: np.ndarray, transposed: bool = False) -> np.ndarray:
        return self._solve(self.inverse.T if transposed else self.inverse, b)


class Strips:
    """The factors of a matrix whose strips of rows are coupled to the next and the last one only; ``starts`` are where they begin, and the end."""

    def __init__(self, a: np.ndarray, starts: list[int], algebra: type = Sums):
        self.algebra, mul = algebra, algebra.mul
        self.at = [slice(i, j) for i, j in zip(starts, starts[1:], strict=False)]
        self.low, self.high = ([a[x, y] for x, y in both] for both in (zip(self.at[1:], self.at, strict=False), zip(self.at, self.at[1:], strict=False)))
        self.inverse = []
        for i, s in enumerate(self.at):
            d = algebra.minus(a[s, s], mul(self.low[i - 1], mul(self.inverse[-1], self.high[i - 1]))) if i else a[s, s]
            self.inverse.append(algebra.inverse(d))

    def solve(self, b: np.ndarray, transposed: bool = False) -> np.ndarray:
        low, high, inverse, mul, minus = self.low, self.high, self.inverse, self.algebra.mul, self.algebra.minus
        if transposed:
            low, high, inverse = [h.T for h in high], [x.T for x in low], [v.T for v in inverse]
        out = np.array(b)
        for i in range(1, len(self.at)):
            out[self.at[i]] = minus(out[self.at[i]], mul(low[i - 1], mul(inverse[i - 1], out[self.at[i - 1]])))
        for i in reversed(range(len(self.at))):
            ahead = mul(high[i], out[self.at[i + 1]]) if i + 1 < len(self.at) else self.algebra.zero
            out[self.at[i]] = mul(inverse[i], minus(out[self.at[i]], ahead))
        return out


class Front:
    """The matrix of a block: ``own`` cells are eliminated, ``rim`` cells are on the lines around it. Tiles go by strips, crosses by their inverse."""

    def __init__(self, grid: Grid, level: int, edges: tuple[np.ndarray, np.ndarray, np.ndarray], left: list[tuple[np.ndarray, np.ndarray]], algebra: type = Sums):
        src, dst, w = edges
        self.algebra = algebra
        cells = np.unique(np.concatenate([src, dst, *[c for c, _ in left]])).astype(np.int64)
        mine = grid.level(cells) == level
        cells = np.concatenate([cells[mine], cells[~mine]])
        if len(cells) > FRONT:
            raise ValueError(f"a front of {len(cells)} cells is too large for a task: edges reach far, or the raster is large; use the series")
        by = np.argsort(cells)
        at = lambda x: by[np.searchsorted(cells, x, sorter=by)]
        f = np.full((len(cells), len(cells)), algebra.zero)
        algebra.minus.at(f, (at(src), at(dst)), w)
        for c, m in left:
            both = np.ix_(at(c), at(c))
            f[both] = algebra.add(f[both], m)
        k = int(mine.sum())
        f[np.arange(k), np.arange(k)] = algebra.add(f[np.arange(k), np.arange(k)], algebra.one)
        self.own, self.rim = cells[:k], cells[k:]
        self.out, self.back, self.corner = f[:k, k:], f[k:, :k], f[k:, k:]  # from the cross to the rim, from the rim, and inside the rim
        if level == 0:  # cells are numbered by column, and no edge is longer than a strip is wide
            strip = (self.own - 1) // grid.nrows // grid.reach
            self._factors = Strips(f[:k, :k], [*np.flatnonzero(np.diff(strip, prepend=-1)).tolist(), k], algebra)
        else:
            make, solve = (algebra.inverse, algebra.mul) if len(self.rim) else (algebra.last, algebra.last_solve)
            self.inverse = make(f[:k, :k])
            self._factors = Inverse(self.inverse, solve)

    def solve(self, b: np.ndarray, transposed: bool = False) -> np.ndarray:
        return self._factors.solve(b, transposed)

    @property
    def left(self) -> np.ndarray:
        """What is left on the rim."""
        return self.algebra.minus(self.corner, self.algebra.mul(self.back, self.solve(self.out)))


def ends_of(edges: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    src, dst, w = (edges.column(c).to_numpy() for c in ("src", "dst", "w"))
    return src, dst, w


def row_of(f: Front, of: pa.Table, edges: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> pa.Table:
    """The factors, or with ``edges`` these."""
    keys = {c: [of.column(c)[0].as_py()] for c in NODE}
    some = {"inverse": f.inverse, "out": f.out, "back": f.back} if edges is None else dict(zip(("src", "dst", "w"), edges, strict=True))
    raw = {c: pa.array([np.ascontiguousarray(some[c]).tobytes() if c in some else None], pa.binary()) for c in ("inverse", "out", "back", "src", "dst", "w")}
    lists = {"own": pa.array([f.own], pa.list_(pa.int64())), "rim": pa.array([f.rim], pa.list_(pa.int64()))}
    types = {"level": pa.int32(), "br": pa.int64(), "bc": pa.int64()}
    raw["left"] = pa.array([np.ascontiguousarray(f.left).tobytes()], pa.binary())
    columns = {c: pa.array(keys[c], types[c]) for c in NODE} | lists | raw
    return pa.table({c.split()[0]: columns[c.split()[0]] for c in FACTOR.split(", ")})


class Stored(Inverse):
    """A front as it was written."""

    def __init__(self, row: dict, algebra: type = Sums):
        self.algebra = algebra
        self.own, self.rim = np.array(row["own"], np.int64), np.array(row["rim"], np.int64)
        k, m = len(self.own), len(self.rim)
        inverse, self.out, self.back = (np.frombuffer(row[c]).reshape(shape) for c, shape in (("inverse", (k, k)), ("out", (k, m)), ("back", (m, k))))
        super().__init__(inverse, algebra.mul if m else algebra.last_solve)


def summed(rows: pa.Table, cells: np.ndarray, width: int, algebra: type = Sums) -> np.ndarray:
    """Right-hand sides (cell, at, values) added up in the order of ``cells``; without ``at`` values are those of all columns."""
    out = np.full((len(cells), width), algebra.zero)
    by = np.argsort(cells)
    for b in rows.to_batches():
        place = by[np.searchsorted(cells, b.column("cell").to_numpy(), sorter=by)]
        values, dense = b.column("values"), b.column("at").is_null().to_numpy(zero_copy_only=False)
        lengths = np.diff(values.offsets.to_numpy())
        flat = values.flatten().to_numpy(zero_copy_only=False)
        full = np.repeat(dense, lengths)
        algebra.add.at(out, place[dense], flat[full].reshape(int(dense.sum()), width))
        if not dense.all():
            algebra.add.at(out, (np.repeat(place[~dense], lengths[~dense]), b.column("at").flatten().to_numpy()), flat[~full])
    return out


def batch_of(cells: np.ndarray, x: np.ndarray, **more) -> pa.Table:
    n = len(cells)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))
    return pa.table({"cell": pa.array(cells, pa.int64()), "at": pa.nulls(n, pa.list_(pa.int32())), "values": flat} | {k: pa.array([v] * n, pa.bool_()) for k, v in more.items()})


class Dissection:
    """The factors of I - W; ``w`` is (src, dst, w) on the cells of an nrows x ncols raster. With ``Least`` w is a cost, and an infinite one no edge."""

    def __init__(self, w: DataFrame, nrows: int, ncols: int, tile: int = TILE, algebra: type = Sums):
        self.algebra = algebra
        row = lambda c: f"(({c} - 1) % {nrows})"
        col = lambda c: f"(({c} - 1) div {nrows})"
        far = w.agg(F.max(F.expr(f"greatest(abs({row('src')} - {row('dst')}), abs({col('src')} - {col('dst')}))"))).first()[0]
        reach = max(1, far or 0)
        self.grid = Grid(nrows, ncols, max(tile, reach), reach)  # tiles are as large as the longest edge, at least
        # an edge belongs to the block that eliminates its first end
        a, b = self.grid.place("src"), self.grid.place("dst")
        placed = w.where(F.col("w") != F.lit(algebra.zero)).select("src", "dst", "w", a.alias("a"), b.alias("b"))
        self.edges = written(placed.select(F.when(F.col("a.level") <= F.col("b.level"), F.col("a")).otherwise(F.col("b")).alias("n"), "src", "dst", "w").select("n.*", "src", "dst", "w"), "edges")

    @cached_property
    def factors(self) -> dict[int, DataFrame]:
        """By level: a row for each front. Of level 0 what is left on the lines, and the edges."""
        grid, algebra, found, below = self.grid, self.algebra, {}, None

        def tile(edges: pa.Table) -> pa.Table:
            ends = ends_of(edges)
            return row_of(Front(grid, 0, ends, [], algebra), edges, ends)

        def cross(level: int) -> Callable:
            def f(edges: pa.Table, lower: pa.Table) -> pa.Table:
                left = [(np.array(c, np.int64), np.frombuffer(m).reshape(len(c), len(c))) for c, m in zip(lower.column("rim").to_pylist(), lower.column("left").to_pylist(), strict=True)]
                return row_of(Front(grid, level, ends_of(edges), left, algebra), edges if edges.num_rows else lower)

            return f

        for level in range(grid.top + 1):
            own = self.edges.where(F.col("level") == level)
            if level == 0:
                made = own.groupBy(*NODE).applyInArrow(tile, FACTOR)
            else:
                up = below.select(F.lit(level).alias("level"), F.shiftright("br", 1).alias("br"), F.shiftright("bc", 1).alias("bc"), "rim", "left")
                made = own.groupBy(*NODE).cogroup(up.groupBy(*NODE)).applyInArrow(cross(level), FACTOR)
            found[level] = below = written(made, f"fronts{level}")
        return found

    @cached_property
    def _rims(self) -> DataFrame:
        """level, br, bc, cell: the cells on the lines around each block."""
        out = None
        for f in self.factors.values():
            part = f.select(*NODE, F.explode("rim").alias("cell"))
            out = part if out is None else out.unionByName(part)
        return written(out, "rims")

    @cached_property
    def _known(self) -> DataFrame:
        """cell: those with edges, each in the one front that eliminates it."""
        out = None
        for f in self.factors.values():
            part = f.select(F.explode("own").alias("cell"))
            out = part if out is None else out.unionByName(part)
        return out

    def _fronts(self, level: int, reached: DataFrame | None = None) -> DataFrame:
        """What a solve needs of the blocks of a level, or of those in ``reached`` (br, bc)."""
        rows = self.factors[level].select("br", "bc", *(("src", "dst", "w") if level == 0 else ("own", "rim", "inverse", "out", "back")))
        return rows if reached is None else rows.join(reached, ["br", "bc"], "left_semi")

    def _step(self, level: int, work: Callable[[Front | Stored, pa.Table], pa.Table | None], fronts: DataFrame, rows: DataFrame, schema: str) -> DataFrame:
        """``work`` on each block of a level that has rows or has to be solved."""
        grid, algebra, empty = self.grid, self.algebra, pa.schema([(c.split()[0], _KINDS[c.split(" ", 1)[1]]) for c in schema.split(", ")]).empty_table()

        def f(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return empty
            row = {c: left.column(c)[0].as_py() for c in left.column_names}
            front = Stored(row, algebra) if level else Front(grid, 0, (np.frombuffer(row["src"], np.int64), np.frombuffer(row["dst"], np.int64), np.frombuffer(row["w"])), [], algebra)
            got = work(front, right)
            return empty if got is None else got.select(empty.column_names)

        return fronts.groupBy("br", "bc").cogroup(rows.groupBy("br", "bc")).applyInArrow(f, schema)

    def solve(self, start: DataFrame, transposed: bool = False) -> DataFrame:
        """node, target, value of (I - W)^-1 E, or with the transpose of W, for E = ``start`` (node, target, value); zeros (with ``Least`` what isn't reached) have no row."""
        start = written(start.select(F.col("node").cast("long").alias("cell"), "target", F.col("value").cast("double").alias("value")), "start")
        out = None
        for mine, width in blocks(start.select("target")):
            rows = start.join(F.broadcast(mine), "target").groupBy("cell").agg(F.collect_list(F.struct("n", "value")).alias("p"))
            part = self.columns(rows.select("cell", F.col("p.n").alias("at"), F.col("p.value").alias("values")), width, transposed)
            part = part.select("cell", F.posexplode("values").alias("n", "value")).where(F.col("value") != F.lit(self.algebra.zero)).join(F.broadcast(mine), "n").select(F.col("cell").alias("node"), "target", "value")
            out = part if out is None else out.unionByName(part)
        return start.select(F.col("cell").alias("node"), "target", "value").where("false") if out is None else out

    def columns(self, rows: DataFrame, width: int, transposed: bool = False) -> DataFrame:
        """cell, values of up to COLUMNS right-hand sides at once: ``rows`` (cell, at, values) have the numbers of their columns in ``at``,
        or a value for each column where it is null; several rows of a cell add up."""
        grid, algebra = self.grid, self.algebra
        rows = written(rows.join(self._known.withColumn("inside", F.lit(True)).hint("merge"), "cell", "left").withColumn("inside", F.coalesce("inside", F.lit(False))), "rows")
        placed = lambda df: df.select(grid.place("cell").alias("p"), "cell", "at", "values").select("p.*", "cell", "at", "values")
        waiting = placed(rows.where("inside"))
        lines = written(waiting.where("level > 0"), "lines")  # few: levels above don't read all rows again

        def up(f: Front | Stored, right: pa.Table) -> pa.Table | None:
            if not right.num_rows:
                return None
            r = summed(right, f.own, width, algebra)
            rim = algebra.mul(f.out.T if transposed else f.back, f.solve(r, transposed))
            some = np.flatnonzero((rim != algebra.zero).any(1))
            on = batch_of(f.rim[some], algebra.minus(algebra.zero, rim[some]), own=False)
            return pa.concat_tables([batch_of(f.own, r, own=True), on]) if isinstance(f, Stored) else on  # in tiles nothing is added to the rows that came

        own, sent = {}, [lines]
        for level in range(grid.top + 1):
            here = sent[0] if level else waiting
            for s in sent[1:]:
                here = here.unionByName(s)
            here = here.where(F.col("level") == level)
            moved = written(self._step(level, up, self._fronts(level, here.select("br", "bc").distinct()), here, f"{ROW}, own boolean"), f"up{level}")
            own[level] = moved.where("own").drop("own") if level else rows.where("inside").drop("inside")
            sent.append(placed(moved.where("not own")))

        def down(f: Front | Stored, right: pa.Table) -> pa.Table | None:
            is_own = right.column("own").to_numpy(zero_copy_only=False) if right.num_rows else np.zeros(0, bool)
            r = summed(right.filter(pa.array(is_own)), f.own, width, algebra)
            x = summed(right.filter(pa.array(~is_own)), f.rim, width, algebra)
            value = f.solve(algebra.minus(r, algebra.mul(f.back.T if transposed else f.out, x)), transposed)
            some = np.flatnonzero((value != algebra.zero).any(1))
            return batch_of(f.own[some], value[some])

        solved = None
        for level in range(grid.top, -1, -1):
            rows_ = placed(own[level]).where(F.col("level") == level).drop("level").withColumn("own", F.lit(True))
            if solved is not None:
                around = self._rims.where(F.col("level") == level).join(solved.hint("merge"), "cell").select("br", "bc", "cell", "at", "values", F.lit(False).alias("own"))
                rows_ = rows_.unionByName(around)
            x = written(self._step(level, down, self._fronts(level), rows_, ROW), f"down{level}")
            solved = x if solved is None else solved.unionByName(x)
        dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(F.try_element_at(F.map_from_arrays("at", "values"), k), F.lit(algebra.zero)))
        dense = F.when(F.col("at").isNull(), F.col("values")).otherwise(dense)
        alone = rows.where("not inside").select("cell", F.posexplode(dense).alias("n", "value")).groupBy("cell", "n").agg(algebra.total("value").alias("value"))  # cells without edges keep their value
        alone = alone.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("p")).select("cell", F.col("p.value").alias("values"))
        return solved.select("cell", "values").unionByName(alone)

    def discard(self) -> None:
        for f in [self.edges, *self.__dict__.pop("factors", {}).values()]:
            discard(f)


def blocks(targets: DataFrame) -> list[tuple[DataFrame, int]]:
    """Blocks of at most COLUMNS targets: (target, n) with n from 0, and how many there are."""
    number = F.expr("row_number() over (order by target) - 1")  # one number for each target
    numbered = written(targets.select("target").distinct().select("target", number.cast("int").alias("n")), "targets")
    count = numbered.count()
    cut = [(k, min(COLUMNS, count - k)) for k in range(0, count, COLUMNS)]
    return [(numbered.where(F.col("n").between(k, k + width - 1)).select("target", (F.col("n") - k).alias("n")), width) for k, width in cut]


_KINDS = {"long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "boolean": pa.bool_()}
