"""Named maps between affinities, costs, distances and proximities.

Each has a Column form (for Catalyst plans) and an array form (for kernels), and an inverse. All
are safe under ANSI arithmetic: a zero gives infinity instead of an error or null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


@dataclass(frozen=True)
class Transform:
    name: str
    column: Callable[[Column], Column]
    array: Callable[[np.ndarray], np.ndarray]
    inverse: str


def _quiet(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    def g(x):
        with np.errstate(all="ignore"):
            return f(np.asarray(x, float))

    return g


REGISTRY: dict[str, Transform] = {
    t.name: t
    for t in (
        Transform("minus_log", lambda x: F.when(x == 0, F.lit(INF)).otherwise(-F.ln(x) + F.lit(0.0)), _quiet(lambda x: -np.log(x) + 0.0), "exp_minus"),
        Transform("exp_minus", lambda x: F.exp(-x), _quiet(lambda x: np.exp(-x)), "minus_log"),
        Transform("inv", lambda x: F.pow(x, F.lit(-1.0)), _quiet(lambda x: 1.0 / x), "inv"),
        Transform("odds_against", lambda x: F.pow(x, F.lit(-1.0)) - 1, _quiet(lambda x: 1.0 / x - 1.0), "odds_for"),
        Transform("odds_for", lambda x: x * F.pow(1 - x, F.lit(-1.0)), _quiet(lambda x: x / (1.0 - x)), "odds_against"),
    )
}


def named(name: str) -> Transform:
    if name not in REGISTRY:
        raise ValueError(f"unknown transformation {name!r}; there are {', '.join(REGISTRY)}")
    return REGISTRY[name]


def inverse(name: str) -> str:
    return named(name).inverse


def array_form(t: str | Callable) -> Callable[[np.ndarray], np.ndarray]:
    """A name, or any function on arrays."""
    return named(t).array if isinstance(t, str) else t


def column_form(t: str | Callable) -> Callable[[Column], Column]:
    """A name, or any function on Columns."""
    return named(t).column if isinstance(t, str) else t


# --- further proximity maps ------------------------------------------------------------------


def exp_scaled(x: Column, scale: float) -> Column:
    """exp(-x / scale)."""
    return F.exp(-x / F.lit(float(scale)))


def inverse_threshold(x: Column, tau: float) -> Column:
    """1 up to tau, tau / x beyond."""
    return F.when(x <= tau, F.lit(1.0)).otherwise(F.lit(float(tau)) * F.pow(x, F.lit(-1.0)))


def zero_preserving(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), but 0 where x is 0."""
    return F.when(x == 0, F.lit(0.0)).otherwise(f(x))


def capped(x: Column) -> Column:
    """min(1, x)."""
    return F.least(F.lit(1.0), x)


def independent_cost(p: Column) -> Column:
    """-ln(1 - p), the cost of an affinity read as an independent probability."""
    return F.when(p >= 1, F.lit(INF)).otherwise(-F.ln(1 - p) + F.lit(0.0))


def clamp_negative(x: Column) -> Column:
    """Negative values become 0; missing ones stay."""
    return F.when(x.isNull(), None).otherwise(F.greatest(x, F.lit(0.0)))
