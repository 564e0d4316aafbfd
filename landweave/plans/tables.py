"""Landscapes made of ordinary tables: rasters by bucketing rows, graphs by trade between places."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landweave.operators import raster
from landweave.operators.landscape import Landscape
from landweave.plans.stages import written

#: (rows, columns) of the rasters.
SHIP, ACTIVITY, PART = (31, 12), (24, 20), (50, 25)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scaled(df: DataFrame, value: str, factor: float):
    return F.lit(factor) * F.col(value) / F.max(value).over(Window.partitionBy(F.lit(0)))


def ship_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row (day), col (month), affinity (share of shipments, at most 0.5) and quality (share of quantity)."""
    lines = table(spark, sf_dir, "lineitem")
    # after the aggregation there are at most 31 x 12 rows, so the window over all is small
    cells = lines.groupBy(F.dayofmonth("l_shipdate").alias("row"), F.month("l_shipdate").alias("col")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("l_quantity").alias("q"))
    return cells.select("row", "col", _scaled(cells, "n", 0.5).alias("affinity"), _scaled(cells, "q", 1.0).alias("quality"))


def activity_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    cells = events.groupBy((F.hour("ts") + 1).alias("row"), (F.col("user_id") % 20 + 1).cast("int").alias("col")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return cells.select("row", "col", _scaled(cells, "n", 0.5).alias("affinity"))


def part_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    cells = parts.groupBy(F.col("p_size").alias("row"), F.col("p_brand").alias("brand")).agg(F.avg("p_retailprice").alias("price"))
    numbered = cells.withColumn("col", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("brand")).cast("int"))
    return numbered.select("row", "col", _scaled(numbered, "price", 0.5).alias("affinity"))


def value_of(cells: DataFrame, column: str) -> DataFrame:
    return cells.select("row", "col", F.col(column).alias("value"))


def ship_landscape(spark: SparkSession, sf_dir: str, npix: int | None = 3, costs="minus_log") -> Landscape:
    """The ship calendar as a landscape, with coarse-grained landmarks unless ``npix`` is None."""
    cells = written(ship_cells(spark, sf_dir), "cells")  # building takes several jobs: the large table is read once
    quality = value_of(cells, "quality")
    edges = raster.raster_graph(value_of(cells, "affinity"), *SHIP)
    marks = {} if npix is None else {"target_qualities": raster.coarse_graining(quality, *SHIP, npix), "landmarks": True}
    return Landscape.build(spark, *SHIP, edges, qualities=quality, costs=costs, **marks)


def parts_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """row, col, affinity, quality of a square raster with a cell for each part, and its side: it grows with the tables.

    A part's affinity is its share of the dearest part's price, up to 0.5, its quality its share of the largest quantity sold.
    """
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("key"), "p_retailprice")
    top, side = parts.agg(F.max("p_retailprice")).first()[0], parts_side(spark, sf_dir)
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("long").alias("key")).agg(F.sum("l_quantity").cast("double").alias("q"))
    cells = parts.join(sold.hint("merge"), "key", "left").select(
        F.expr(f"cast(key % {side} + 1 as int)").alias("row"), F.expr(f"cast(key div {side} + 1 as int)").alias("col"),
        (0.5 * F.col("p_retailprice").cast("double") / float(top or 1.0)).alias("affinity"), F.coalesce("q", F.lit(0.0)).alias("quality"),
    )
    return cells, side


def parts_landscape(spark: SparkSession, sf_dir: str, marks: int = 5) -> Landscape:
    """The parts' raster as a landscape with about ``marks`` squared landmarks."""
    cells, side = parts_grid(spark, sf_dir)
    cells = written(cells, "cells")
    quality = value_of(cells, "quality")
    npix = max(1, side // marks)
    edges = raster.raster_graph(value_of(cells, "affinity"), side, side)
    return Landscape.build(spark, side, side, edges, qualities=quality, target_qualities=raster.coarse_graining(quality, side, side, npix), landmarks=True)


def even_landscape(spark: SparkSession, sf_dir: str) -> Landscape:
    """The ship calendar with average affinities, so that costs are the same in both directions."""
    cells = written(ship_cells(spark, sf_dir), "cells")
    edges = raster.raster_graph(value_of(cells, "affinity"), *SHIP, weight="average").where("not isnan(value)")
    return Landscape.build(spark, *SHIP, edges, qualities=value_of(cells, "quality"))


def parts_side(spark: SparkSession, sf_dir: str) -> int:
    """The side of the parts' raster."""
    return math.isqrt(table(spark, sf_dir, "part").agg(F.max(F.col("p_partkey").cast("long"))).first()[0] or 0) + 1


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, value: each supplier nation's share of revenue by customer nation, as nodes 1 to 25."""
    revenue = (
        table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy((F.col("s_nationkey") + 1).cast("long").alias("src"), (F.col("c_nationkey") + 1).cast("long").alias("dst"))
        .agg(F.sum("l_extendedprice").alias("revenue"))
    )
    return revenue.select("src", "dst", (F.col("revenue") / F.sum("revenue").over(Window.partitionBy("src"))).alias("value"))
