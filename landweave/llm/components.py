"""Connected components of an edge table by alternating large and small stars.

Each round replaces edges by edges to the least neighbour, which keeps components and ends, after a
number of rounds that grows with the logarithm of their size, in one star around each least node. A
node's neighbours are never collected: their least is an aggregate, joined back. Rounds are written
to the shared folder, so the lineage stays short and a lost executor loses nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landweave.llm.common import discard, written

ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    # every edge goes from the larger to the smaller node here
    least = _least(edges)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _print(edges: DataFrame) -> tuple:
    # bit_xor can't overflow; two different tables of one size agree by chance only
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of ``edges`` (u, v) but the roots.

    Loops are dropped, direction and repetition don't matter.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _print(now)
    for _ in range(ROUNDS):
        if not seen[0]:
            break
        before, now = now, written(_small(_large(now)), "edges")
        discard(before)
        if (mark := _print(now)) == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
