"""Rasters as rows (row, col, value), and the graphs made of them.

A missing cell is an absent row. Cells are numbered down the columns from 1:
cell = (col - 1) * nrows + row. Edges are rows (src, dst, value).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SQRT2 = math.sqrt(2.0)
#: Offsets (rows, columns) and lengths of the two stencils.
N4 = tuple((dr, dc, 1.0) for dr, dc in ((-1, 0), (1, 0), (0, -1), (0, 1)))
N8 = N4 + tuple((dr, dc, SQRT2) for dr in (-1, 1) for dc in (-1, 1))
STENCILS = {4: N4, 8: N8}
WEIGHTS, MATRICES = ("target", "average"), ("affinity", "cost")


def stencil(neighbors: int) -> Column:
    """The stencil as an array of structs, to be exploded in place: no join is needed."""
    if neighbors not in STENCILS:
        raise ValueError(f"neighbors must be 4 or 8, not {neighbors}")
    return F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(n).alias("len")) for a, b, n in STENCILS[neighbors]])


def stencil_table(spark: SparkSession, neighbors: int) -> DataFrame:
    return spark.range(1).select(F.explode(stencil(neighbors)).alias("s")).select("s.dr", "s.dc", "s.len")


def cell(row: Column | str, col: Column | str, nrows: int) -> Column:
    row, col = (F.col(x) if isinstance(x, str) else x for x in (row, col))
    return ((col - 1) * nrows + row).cast("long")


def cells(spark: SparkSession, nrows: int, ncols: int) -> DataFrame:
    """cell, row, col of the whole grid, generated in parallel."""
    ids = spark.range(1, nrows * ncols + 1)
    return ids.select(
        F.col("id").alias("cell"), ((F.col("id") - 1) % nrows + 1).cast("int").alias("row"), (F.floor((F.col("id") - 1) / nrows) + 1).cast("int").alias("col")
    )


def raster_graph(raster: DataFrame, nrows: int, ncols: int, neighbors: int = 8, weight: str = "target", matrix: str = "affinity") -> DataFrame:
    """Edges into every valid cell from each neighbouring cell, valid or not.

    Edges are generated from their target, so target weights need no join and no shuffle. Average
    weights look the source's value up; without one the edge's value is NaN, and of a zero source
    the affinity is 0.
    """
    if weight not in WEIGHTS:
        raise ValueError(f"weight must be one of {WEIGHTS}, not {weight!r}")
    if matrix not in MATRICES:
        raise ValueError(f"matrix must be one of {MATRICES}, not {matrix!r}")
    targets = raster.where("value is not null and not isnan(value) and value <> 0")
    steps = targets.withColumn("s", F.explode(stencil(neighbors))).select(
        (F.col("row") - F.col("s.dr")).alias("sr"), (F.col("col") - F.col("s.dc")).alias("sc"), cell("row", "col", nrows).alias("dst"), F.col("value").alias("b"), F.col("s.len").alias("len")
    )
    edges = steps.where(F.col("sr").between(1, nrows) & F.col("sc").between(1, ncols)).withColumn("src", cell("sr", "sc", nrows))
    if weight == "target":
        value = F.col("b") / F.col("len") if matrix == "affinity" else F.col("b") * F.col("len")
        return edges.select("src", "dst", value.alias("value"))
    sources = raster.where("value is not null and not isnan(value)").select(F.col("row").alias("sr"), F.col("col").alias("sc"), F.col("value").alias("a"))
    both = edges.join(sources.hint("merge"), ["sr", "sc"], "left")
    a = F.coalesce("a", F.lit(float("nan")))
    if matrix == "affinity":
        value = F.lit(2.0) * F.pow((F.pow(a, F.lit(-1.0)) + F.pow(F.col("b"), F.lit(-1.0))) * F.col("len"), F.lit(-1.0))
    else:
        value = (a + F.col("b")) * F.col("len") / 2
    return both.select("src", "dst", value.alias("value"))


def lattice(spark: SparkSession, nrows: int, ncols: int, neighbors: int = 8) -> DataFrame:
    """A uniform grid: weight 1 to orthogonal neighbours, 1/sqrt(2) to diagonal ones."""
    return raster_graph(cells(spark, nrows, ncols).select("row", "col", F.lit(1.0).alias("value")), nrows, ncols, neighbors)


def map_values(edges: DataFrame, f) -> DataFrame:
    """f on the value of every stored edge."""
    return edges.withColumn("value", f(F.col("value")))


def impassable(edges: DataFrame, walls: DataFrame, affinity: float = 1e-20) -> DataFrame:
    """Edges into or out of the cells of ``walls`` (cell) get a tiny affinity; zeros are dropped."""
    src, dst = (walls.select(F.col("cell").alias(c), F.lit(True).alias(f"_{c}")).distinct() for c in ("src", "dst"))
    hit = F.col("_src").isNotNull() | F.col("_dst").isNotNull()
    return (
        edges.join(src, "src", "left").join(dst, "dst", "left")
        .select("src", "dst", F.when(hit, F.lit(float(affinity))).otherwise(F.col("value")).alias("value"))
        .where("value <> 0")
    )


def coarse_graining(quality: DataFrame, nrows: int, ncols: int, npix: int) -> DataFrame:
    """Landmarks: the sum of each complete npix x npix block at its centre, zeros left out.

    Blocks tile the raster, so this is a group-by on block numbers, not a range join.
    """
    if npix < 1:
        raise ValueError("npix must be positive")
    block = lambda c: F.floor((F.col(c) - 1) / npix).cast("int")
    centre = lambda c: (F.col(c) * npix + npix // 2 + 1).cast("int")
    return (
        quality.where("value is not null and not isnan(value)").withColumns({"br": block("row"), "bc": block("col")})
        .where(((F.col("br") + 1) * npix <= nrows) & ((F.col("bc") + 1) * npix <= ncols))
        .groupBy("br", "bc").agg(F.sum("value").alias("value")).where("value <> 0")
        .select(centre("br").alias("row"), centre("bc").alias("col"), "value")
    )


def neighborhood_sum(quality: DataFrame, row: int, col: int, npix: int) -> DataFrame:
    """One row: the sum of values in the npix x npix window around (row, col)."""
    lo, hi = npix // 2, -(-npix // 2) - 1
    near = F.col("row").between(row - lo, row + hi) & F.col("col").between(col - lo, col + hi)
    return quality.where(near & F.col("value").isNotNull() & ~F.isnan("value")).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))


def summed_area(quality: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """row, col (from 0), sum: the sum of all values at or before each row and column, missing ones as 0.

    Running sums along the rows, then down the columns: a window holds one row, or one column, of the raster.
    """
    known = quality.where("value is not null and not isnan(value)").select("row", "col", "value")
    every = cells(quality.sparkSession, nrows, ncols).join(known.hint("merge"), ["row", "col"], "left").select("row", "col", F.coalesce("value", F.lit(0.0)).alias("value"))
    along = every.withColumn("part", F.sum("value").over(Window.partitionBy("row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)))
    down = along.select("row", "col", F.sum("part").over(Window.partitionBy("col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)).alias("sum"))
    return down


def area_sums(table: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and value: the sums over the boxes (keys, top, bottom, left, right; inclusive, inside the raster) from four look-ups each in a summed area table."""
    corner = lambda r, c, sign: F.struct(r.alias("row"), c.alias("col"), F.lit(sign).alias("sign"))
    up, left = F.col("top") - 1, F.col("left") - 1
    four = F.array(corner(F.col("bottom"), F.col("right"), 1.0), corner(up, F.col("right"), -1.0), corner(F.col("bottom"), left, -1.0), corner(up, left, 1.0))
    looked = boxes.select(*keys, F.explode(four).alias("c")).select(*keys, "c.*").join(table.hint("merge"), ["row", "col"], "left")  # row or column 0: nothing
    return looked.groupBy(*keys).agg(F.sum(F.col("sign") * F.coalesce("sum", F.lit(0.0))).alias("value"))


def neighborhood_sums(quality: DataFrame, nrows: int, ncols: int, npix: int) -> DataFrame:
    """row, col, value: ``neighborhood_sum`` around every cell."""
    if npix < 1:
        raise ValueError("npix must be positive")
    lo, hi = npix // 2, -(-npix // 2) - 1
    at = lambda c, d, n: F.least(F.greatest(F.col(c) + d, F.lit(1)), F.lit(n)).cast("int")
    boxes = cells(quality.sparkSession, nrows, ncols).select("row", "col", at("row", -lo, nrows).alias("top"), at("row", hi, nrows).alias("bottom"), at("col", -lo, ncols).alias("left"), at("col", hi, ncols).alias("right"))
    return area_sums(summed_area(quality, nrows, ncols), boxes.withColumnsRenamed({"row": "at_row", "col": "at_col"}), ["at_row", "at_col"]).withColumnsRenamed({"at_row": "row", "at_col": "col"})


def coarse_grainings(quality: DataFrame, nrows: int, ncols: int, sizes: list[int]) -> DataFrame:
    """npix, row, col, value: ``coarse_graining`` by each of ``sizes``, all from one summed area table; sums within rounding of 0 are left out."""
    if min(sizes) < 1:
        raise ValueError("npix must be positive")
    table = summed_area(quality, nrows, ncols)
    out = None
    for p in sizes:
        blocks = quality.sparkSession.range((nrows // p) * (ncols // p)).select(F.expr(f"cast(id div {max(ncols // p, 1)} as int)").alias("br"), F.expr(f"cast(id % {max(ncols // p, 1)} as int)").alias("bc"))
        edge = lambda c, d, p=p: (F.col(c) * p + d).cast("int")
        boxes = blocks.select(F.lit(p).alias("npix"), edge("br", p // 2 + 1).alias("at_row"), edge("bc", p // 2 + 1).alias("at_col"), edge("br", 1).alias("top"), edge("br", p).alias("bottom"), edge("bc", 1).alias("left"), edge("bc", p).alias("right"))
        out = boxes if out is None else out.unionByName(boxes)
    found = area_sums(table, out, ["npix", "at_row", "at_col"]).withColumnsRenamed({"at_row": "row", "at_col": "col"})
    return found.where("abs(value) > 1e-12")


def canvas(spark: SparkSession, values: DataFrame, nrows: int, ncols: int, fill: float | None = None) -> DataFrame:
    """row, col, value of every cell; ``values`` has (cell, value). Cells without one get ``fill``."""
    grid = cells(spark, nrows, ncols).join(values.select("cell", "value").hint("merge"), "cell", "left")
    return grid.select("row", "col", "value" if fill is None else F.coalesce("value", F.lit(float(fill))).alias("value"))


def reconcile(a: DataFrame, b: DataFrame, fill: float = 1e-20, both: bool = True) -> DataFrame:
    """row, col, a, b of cells that either raster has; a cell that one lacks gets ``fill`` there.

    With ``both=False`` only cells of ``a`` are filled in ``b``; cells that ``a`` lacks stay missing in it.
    """
    x, y = a.select("row", "col", F.col("value").alias("a")), b.select("row", "col", F.col("value").alias("b"))
    if both:
        return x.join(y, ["row", "col"], "full_outer").select("row", "col", F.coalesce("a", F.lit(fill)).alias("a"), F.coalesce("b", F.lit(fill)).alias("b"))
    filled = F.when(F.col("a") > 0, F.coalesce("b", F.lit(fill))).otherwise(F.col("b"))
    return x.join(y, ["row", "col"], "full_outer").select("row", "col", "a", filled.alias("b"))


def outdegrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("cell")).agg(F.sum("value").alias("value"))


def indegrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("cell")).agg(F.sum("value").alias("value"))


def finite_total(values: DataFrame) -> DataFrame:
    """One row: the sum of finite values."""
    return values.where("value is not null and not isnan(value) and abs(value) < double('infinity')").agg(F.sum("value").alias("value"))


def euclidean(cells_: DataFrame, targets: DataFrame) -> DataFrame:
    """Distances in cell units between all cells and the given targets (row, col), as (node, target, value).

    The targets are the stated query set; both sides carry their cell numbers in ``cell``.
    """
    t = targets.select(F.col("cell").alias("target"), F.col("row").alias("tr"), F.col("col").alias("tc"))
    return cells_.crossJoin(t).select(F.col("cell").alias("node"), "target", F.hypot(F.col("row") - F.col("tr"), F.col("col") - F.col("tc")).alias("value"))


# --- the permeable wall ----------------------------------------------------------------------


def wall_cells(nrows: int, ncols: int, width: int = 3, position: float = 0.5, corridor_widths=(3, 3), corridor_positions=(0.35, 0.7)) -> tuple[range, list[range]]:
    """(columns, row ranges) of the wall; corridors are gaps in it."""
    if len(corridor_widths) != len(corridor_positions):
        raise ValueError("corridor widths and positions differ in number")
    first = round(ncols * position - width / 2 + 1)  # half to even
    rows, at = [], 1
    for w, p in zip(corridor_widths, corridor_positions, strict=True):
        end = math.floor(nrows * p) - math.ceil(w / 2)
        rows.append(range(at, end + 1))
        at = end + 1 + w
    rows.append(range(at, nrows + 1))
    return range(first, first + width), rows


def wall_table(spark: SparkSession, nrows: int, ncols: int, **wall) -> DataFrame:
    """cell, row, col of the wall's cells."""
    columns, rows = wall_cells(nrows, ncols, **wall)
    inside = F.lit(False)
    for r in rows:
        inside = inside | F.col("row").between(r.start, r.stop - 1)
    return cells(spark, nrows, ncols).where(F.col("col").between(columns.start, columns.stop - 1) & inside)


def wall_affinities(spark: SparkSession, nrows: int, ncols: int, scaling: float = 0.5, impossible: float = 1e-20, neighbors: int = 8, **wall) -> DataFrame:
    """The scaled lattice with edges at the wall made nearly impassable."""
    open_ = map_values(lattice(spark, nrows, ncols, neighbors), lambda v: v * F.lit(float(scaling)))
    return impassable(open_, wall_table(spark, nrows, ncols, **wall), impossible)
