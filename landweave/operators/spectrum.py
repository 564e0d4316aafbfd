"""The dominant eigenvalue of a table of pairs and its vector, by restarted Arnoldi iterations whose basis is a table.

A row of the basis holds one cell's entries of all basis vectors, so a step is one join of the pairs with the newest vector and
two rows of sums over cells. The driver sees numbers of the small projected matrix only (``SIZE`` squared), whatever the number of cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landweave.plans.stages import discard, written

#: Basis vectors before a restart from the best vector found, and restarts before it counts as not settling.
SIZE, RESTARTS = 30, 40


def _combined(weights) -> Column:
    """The combination of a row's basis entries with the given weights; weights are data, so steps share their generated code."""
    listed = ", ".join(f"{float(x)!r}D" for x in weights)
    return F.expr(f"aggregate(zip_with(basis, array({listed}), (b, w) -> b * w), 0D, (s, x) -> s + x)")


def _sums(state: DataFrame, columns: list[Column]) -> np.ndarray:
    """Sums over all cells, one row."""
    row = state.agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return np.array([0.0 if x is None else float(x) for x in row])


def dominant(pairs: DataFrame, cells: DataFrame, to: str = "node", of: str = "target", tol: float = 1e-10, size: int = SIZE, restarts: int = RESTARTS) -> tuple[float, DataFrame]:
    """(value, vector) of the Perron root of the non-negative matrix ``pairs`` (columns ``to``, ``of``, value) over ``cells`` (cell).

    The vector (cell, value) has length 1 and no negative entry; pairs without a row are 0. The residual over the distance to the next
    value bounds the vector's error, by first order: it has to be at most ``tol``, or else 1e-6 with the residual at rounding (1e-13
    of the value). Raises if that is not reached, or if no eigenvalue is positive; so does an empty table of cells.
    """
    cells = written(cells.select("cell").distinct(), "cells")
    n = cells.count()
    if not n:
        raise ValueError("there are no cells")
    moved = cells
    state = cells.select("cell", F.array(F.lit(1.0 / np.sqrt(n))).alias("basis"))
    for _ in range(restarts):
        h = np.zeros((size + 1, size))
        for j in range(min(size, n)):
            newest = state.select(F.col("cell").alias(of), F.element_at("basis", -1).alias("x"))
            product = pairs.join(newest, of).groupBy(F.col(to).alias("cell")).agg(F.sum(F.col("value") * F.col("x")).alias("m"))
            moved, last = written(state.join(product, "cell", "left").select("cell", "basis", F.coalesce("m", F.lit(0.0)).alias("m")), "arnoldi"), moved
            discard(last)
            rest = moved.select("cell", "basis", F.col("m").alias("rest"))
            for _ in range(2):  # the second pass removes what rounding left
                *parts, square = _sums(rest, [F.col("basis")[i] * F.col("rest") for i in range(j + 1)] + [F.col("rest") * F.col("rest")])
                h[: j + 1, j] += parts
                rest = rest.withColumn("rest", F.col("rest") - _combined(parts))
            square -= np.square(parts).sum()  # what the second pass takes off is small, or else all is at rounding
            h[j + 1, j] = np.sqrt(max(square, 0.0))
            values, vectors = np.linalg.eig(h[: j + 1, : j + 1])
            k = int(np.argmax(values.real))
            value, y = float(values[k].real), vectors[:, k].real
            y = y / np.linalg.norm(y)
            gap = min((abs(x - values[k]) for i, x in enumerate(values) if i != k), default=np.inf if n == 1 else 0.0)
            residual = h[j + 1, j] * abs(y[j])
            if residual <= max(tol * gap, min(1e-13 * abs(value), 1e-6 * gap)):
                if value <= 0:
                    raise ValueError("the matrix has no positive eigenvalue")
                found = written(moved.select("cell", F.abs(_combined(y)).alias("value")), "eigenvector")
                discard(moved)
                return value, found
            if j + 1 < min(size, n):
                state = rest.select("cell", F.array_append("basis", F.col("rest") / F.lit(float(h[j + 1, j]))).alias("basis"))
            else:
                state = moved.select("cell", F.array(_combined(y)).alias("basis"))
    raise RuntimeError(f"the dominant eigenvector did not settle in {restarts} restarts")
