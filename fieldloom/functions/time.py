"""Linear and cyclic time as Column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.kernels import Kernel, get_kernel, tail_reach

UNIT_SECONDS = {"seconds": 1.0, "minutes": 60.0, "hours": 3600.0, "days": 86400.0}


@dataclass(frozen=True)
class LinearTime:
    """Unbounded time; distance is |dt|."""

    def canonical(self, t: Column) -> Column:
        return t.cast("double")

    def distance(self, dt: Column) -> Column:
        return F.abs(dt)

    period: None = None


@dataclass(frozen=True)
class CyclicTime:
    """Time that repeats; values lie in [origin, origin + period)."""

    period: float
    origin: float = 0.0

    def __post_init__(self):
        if not (math.isfinite(self.period) and self.period > 0 and math.isfinite(self.origin)):
            raise ValueError("a cyclic domain needs a positive period and a finite origin")

    def canonical(self, t: Column) -> Column:
        return F.lit(self.origin) + F.pmod(t.cast("double") - self.origin, F.lit(self.period))

    def distance(self, dt: Column) -> Column:
        gap = F.pmod(F.abs(dt), F.lit(self.period))
        return F.least(gap, self.period - gap)


TimeDomain = LinearTime | CyclicTime


def offset(ts: Column, unit: str, origin: str) -> Column:
    """Timestamp to a number of units since origin. A timestamp without zone is taken as UTC, as is the origin."""
    if unit not in UNIT_SECONDS:
        raise ValueError(f"unit must be one of {sorted(UNIT_SECONDS)}")
    micros = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.lit(origin).cast("timestamp"))
    return micros / (1e6 * UNIT_SECONDS[unit])


def in_zone(ts: Column, zone: str) -> Column:
    """A local timestamp of a zone as UTC."""
    return F.to_utc_timestamp(ts, zone)


def images(kernel: Kernel, bandwidth: float, period: float, tolerance: float = 1e-12) -> int:
    """How many periods to either side can matter: the reach of a compact kernel, else where the tail falls below tolerance."""
    reach = tail_reach(kernel, tolerance)
    return max(1, math.ceil((reach * bandwidth + period) / period))


def temporal_kernel(kernel: str | Kernel, dt: Column, bandwidth: Column | float, domain: TimeDomain, tolerance: float = 1e-12, most: int | None = None) -> Column:
    """K(|dt| / h) / h in one dimension; on a cycle the sum over the images of every period in reach.

    `most` bounds the images of a bandwidth column; a plain number needs none.
    """
    k = get_kernel(kernel)
    if isinstance(domain, LinearTime):
        return k.scaled(F.abs(dt), bandwidth, 1)
    count = most if most is not None else images(k, float(bandwidth), domain.period, tolerance)
    base = F.pmod(dt, F.lit(domain.period))
    total = F.lit(0.0)
    for i in range(-count, count + 1):  # a handful of terms, in generated code
        total = total + k.scaled(F.abs(base + i * domain.period), bandwidth, 1)
    return total


def temporal_array(kernel: Kernel, dt: np.ndarray, bandwidth: float | np.ndarray, domain: TimeDomain, tolerance: float = 1e-12, most: int | None = None) -> np.ndarray:
    """temporal_kernel on arrays."""
    if isinstance(domain, LinearTime):
        return kernel.scaled_array(dt * dt, bandwidth, 1)
    count = most if most is not None else images(kernel, float(np.max(bandwidth)), domain.period, tolerance)
    base = np.mod(dt, domain.period)
    return sum(kernel.scaled_array((base + i * domain.period) ** 2, bandwidth, 1) for i in range(-count, count + 1))
