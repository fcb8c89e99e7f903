"""Radial kernels as Column expressions, normalised in any dimension."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ball_volume(dim: int) -> float:
    """Volume of the unit ball."""
    return math.pi ** (dim / 2) / math.gamma(dim / 2 + 1)


@dataclass(frozen=True)
class Kernel:
    """A radial kernel: profile(u, dim) for scaled distance u >= 0; reach is the scaled distance beyond which it is zero. array is
    the profile on numpy arrays, which lets sums over all pairs run in blocks; without it they are joins."""

    name: str
    profile: Callable[[Column, int], Column]
    reach: float | None = None
    array: Callable[[np.ndarray, int], np.ndarray] | None = None

    def __call__(self, u: Column, dim: int) -> Column:
        value = self.profile(u, dim)
        return F.when(u <= self.reach, value).otherwise(F.lit(0.0)) if self.reach is not None else value

    def scaled_array(self, square: np.ndarray, bandwidth: float | np.ndarray, dim: int) -> np.ndarray:
        """K(d / h) / h^dim from squared distances."""
        u = np.sqrt(square) / bandwidth
        value = self.array(u, dim)
        if self.reach is not None:
            value = np.where(u <= self.reach, value, 0.0)
        return value / bandwidth**dim

    def check_values(self, df: DataFrame, distance: str, dim: int) -> None:
        """Stop where a distance is negative or not finite, or where the kernel's value there is not finite."""
        d, k = F.col(distance).cast("double"), self(F.col(distance).cast("double"), dim)
        wrong = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        row = df.agg(F.count_if(wrong(d) | (d < 0)).alias("distances"), F.count_if(wrong(k)).alias("values")).first()
        if row["distances"] or row["values"]:
            raise ValueError(f"{row['distances']} distances are negative or not finite, {row['values']} kernel values are not finite")

    def scaled(self, distance: Column, bandwidth: Column | float, dim: int) -> Column:
        """K(d / h) / h^dim."""
        h = bandwidth if isinstance(bandwidth, Column) else F.lit(float(bandwidth))
        return self(distance / h, dim) / F.pow(h, F.lit(float(dim)))


def _constant(dim: int, numerator: float) -> float:
    return numerator / ball_volume(dim)


def _both(name: str, profile: Callable, reach: float | None = None) -> Kernel:
    """A kernel whose profile is written once, for columns (m is pyspark.sql.functions) and for arrays (m is numpy)."""
    return Kernel(name, lambda u, d: profile(u, d, F), reach, lambda u, d: profile(u, d, np))


_BUILT_IN = (
    _both("gaussian", lambda u, d, m: m.exp(-0.5 * u * u) * (2 * math.pi) ** (-d / 2)),
    _both("epanechnikov", lambda u, d, m: (1 - u * u) * _constant(d, (d + 2) / 2), 1.0),
    _both("quartic", lambda u, d, m: (1 - u * u) * (1 - u * u) * _constant(d, (d + 2) * (d + 4) / 8), 1.0),
    _both("triangular", lambda u, d, m: (1 - u) * _constant(d, d + 1), 1.0),
    _both("uniform", lambda u, d, m: 0 * u + _constant(d, 1.0), 1.0),
    _both("exponential", lambda u, d, m: m.exp(-u) * _constant(d, 1 / math.gamma(d + 1))),
)
_REGISTRY = {k.name: k for k in _BUILT_IN} | {"biweight": next(k for k in _BUILT_IN if k.name == "quartic")}


def get_kernel(kernel: str | Kernel) -> Kernel:
    """A kernel by name, in any case, or the kernel itself."""
    if isinstance(kernel, Kernel):
        return kernel
    try:
        return _REGISTRY[kernel.strip().lower()]
    except (KeyError, AttributeError):
        raise ValueError(f"unknown kernel {kernel!r}; one of {sorted(_REGISTRY)}") from None


def tail_reach(kernel: Kernel, tolerance: float) -> float:
    """The reach of a kernel; without one, the scaled distance where it falls to this share of its peak."""
    if kernel.reach is not None:
        return kernel.reach
    if kernel.name == "gaussian":
        return math.sqrt(-2 * math.log(tolerance))
    if kernel.name == "exponential":
        return -math.log(tolerance)
    raise ValueError("a tail needs a Gaussian or exponential kernel, or one with reach")


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    total = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        total = total + (x - y) * (x - y)
    return total


def array_squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two array columns."""
    gaps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x)
