"""Kernel density and intensity in the plane and in any dimension."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.kernels import Kernel, get_kernel, squared_distance, tail_reach
from fieldloom.functions.normal import interval_mass, rectangle_mass
from fieldloom.operators.bandwidths import AbramsonBandwidth, BalloonKNNBandwidth, BandwidthMatrix, KNNBandwidth, positive
from fieldloom.plans.pairs import all_pairs, near_pairs, near_pairs_by_source
from fieldloom.plans.sums import Columns, pair_sums, squares
from fieldloom.sources.planar import Boundary, Events, Support, check_compatible


class NotFittedError(RuntimeError):
    """An estimator is used before fit()."""


def get_target(target: str) -> str:
    name = str(target).strip().lower()
    if name not in ("density", "intensity"):
        raise ValueError("target is density or intensity")
    return name


CORRECTIONS = {
    "none": "none", "off": "none", "renormalization": "renormalization", "renormalize": "renormalization", "renorm": "renormalization",
    "reflection": "reflection", "reflect": "reflection",
}


def normal_mass(low: Column, high: Column, at: Column, h: Column) -> Column:
    """Mass of a normal law with mean at and deviation h between low and high; Spark has no erf, so numpy takes over."""
    return F.arrow_udf(_mass, "double")(*(c.cast("double") for c in (low, high, at, h)))


def _mass(low: pa.Array, high: pa.Array, at: pa.Array, h: pa.Array) -> pa.Array:
    a, b, m, s = (x.to_numpy(zero_copy_only=False) for x in (low, high, at, h))
    return pa.array(interval_mass((a - m) / s, (b - m) / s))


def _matrix_mass(bounds: tuple[float, float, float, float], matrix: tuple[tuple[float, ...], ...]):
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(rectangle_mass(x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False), bounds, np.array(matrix)))

    return F.arrow_udf(run, "double")


@dataclass(frozen=True)
class Metric:
    """A distance of points: squared(a, b) on columns, and on lists of arrays (targets by sources) for sums in blocks."""

    name: str
    squared: Callable[[list[Column], list[Column]], Column]
    array: Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray] | None = None


EUCLIDEAN = Metric("euclidean", squared_distance, lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))


@dataclass(frozen=True)
class SpatialKDE:
    """Weighted kernel sums: density (weights sum to 1) or intensity (weights as they are).

    bandwidth: a number, a BandwidthMatrix, KNNBandwidth, AbramsonBandwidth, BalloonKNNBandwidth, or anything with
    select(events) (cross-validation). boundary_correction: none, renormalization or reflection (the latter two need a boundary), or an
    object with a name and apply(fitted) -> rows, which returns fitted.rows with column a (the weight) corrected. tail_tolerance: a
    kernel without reach is cut where it falls below this share of its peak, so that only near pairs meet; None takes all pairs.
    """

    kernel: str | Kernel = "gaussian"
    bandwidth: object = 1.0
    target: str = "density"
    boundary: Boundary | None = None
    boundary_correction: str = "none"
    cells_per_axis: int = 64
    mass_floor: float = 1e-10
    metric: Metric = EUCLIDEAN
    tail_tolerance: float | None = None

    def fit(self, events: Events) -> FittedSpatialKDE:
        kernel, target = get_kernel(self.kernel), get_target(self.target)
        correction = self.boundary_correction if hasattr(self.boundary_correction, "apply") else CORRECTIONS.get(str(self.boundary_correction).strip().lower())
        if correction is None:
            raise ValueError(f"unknown boundary correction {self.boundary_correction!r}")
        if correction != "none" and self.boundary is None:
            raise ValueError("a boundary correction needs a boundary")
        events.check().raise_for_errors()
        if self.boundary is not None and self.boundary.outside(events.df):
            raise ValueError("some events lie outside the boundary")
        h = self.bandwidth
        selection = None
        if hasattr(h, "select"):
            selection = h.select(events)
            h = selection.bandwidth
        if isinstance(h, (int, float)):
            h = positive(h)
        elif isinstance(h, BandwidthMatrix):
            if h.dim != events.dim:
                raise ValueError("the bandwidth matrix has another dimension")
        if isinstance(h, BalloonKNNBandwidth) and correction != "none":
            raise ValueError("balloon bandwidths have no boundary correction")
        if correction == "reflection" and (isinstance(h, BandwidthMatrix) or not self.boundary.is_rectangle()):
            raise ValueError("reflection needs a rectangle and no full matrix")
        rows = events.df.select("event_id", *events.coords, "weight")
        if isinstance(h, (KNNBandwidth, AbramsonBandwidth)):
            rows = rows.join(h.resolve(events), "event_id")
        total = events.total_weight()
        rows = rows.withColumn("a", F.col("weight") / total if target == "density" else F.col("weight"))
        fitted = FittedSpatialKDE(replace(self, kernel=kernel, bandwidth=h, target=target, boundary_correction=correction), events, rows, total, selection)
        return fitted._corrected()

    def fit_evaluate(self, events: Events, support: Support) -> DataFrame:
        return self.fit(events).evaluate(support)


@dataclass(frozen=True)
class FittedSpatialKDE:
    spec: SpatialKDE
    events: Events
    rows: DataFrame
    total_weight: float
    selection: object = None

    @property
    def _adaptive(self) -> bool:
        return "bandwidth" in self.rows.columns

    def _h(self) -> Column | float:
        return F.col("bandwidth") if self._adaptive else self.spec.bandwidth

    def _corrected(self) -> FittedSpatialKDE:
        how, coords = self.spec.boundary_correction, self.events.coords
        if how == "none":
            return self
        if hasattr(how, "apply"):
            return replace(self, rows=how.apply(self))
        x0, y0, x1, y1 = self.spec.boundary.bounds
        x, y = F.col(coords[0]), F.col(coords[1])
        if how == "reflection":
            xs, ys = F.array(x, 2 * x0 - x, 2 * x1 - x), F.array(y, 2 * y0 - y, 2 * y1 - y)
            rows = self.rows.withColumn(coords[0], F.explode(xs)).withColumn(coords[1], F.explode(ys))
            return replace(self, rows=rows)
        h = self.spec.bandwidth
        if self.spec.boundary.is_rectangle() and self.spec.kernel.name == "gaussian" and not isinstance(h, BandwidthMatrix):
            s = self._h() if self._adaptive else F.lit(float(h))
            mass = normal_mass(F.lit(x0), F.lit(x1), x, s) * normal_mass(F.lit(y0), F.lit(y1), y, s)
            rows = self.rows.withColumn("mass", mass)
        elif self.spec.boundary.is_rectangle() and self.spec.kernel.name == "gaussian" and self.events.dim == 2:
            rows = self.rows.withColumn("mass", _matrix_mass(self.spec.boundary.bounds, h.matrix)(x, y))
        else:
            rows = self._quadrature()
        if rows.where(F.col("mass") <= self.spec.mass_floor).limit(1).count():
            raise ValueError("an event has almost no mass inside the boundary")
        return replace(self, rows=rows.withColumn("a", F.col("a") / F.col("mass")).drop("mass"))

    def _quadrature(self) -> DataFrame:
        """Mass of each event's kernel inside the boundary, over a regular grid of cells clipped to it."""
        boundary, n, spark = self.spec.boundary, self.spec.cells_per_axis, self.rows.sparkSession
        x0, y0, x1, y1 = boundary.bounds
        if boundary.is_rectangle():
            grid = Support.grid(spark, (x0, y0, x1, y1), ((x1 - x0) / n, (y1 - y0) / n)).df.select(F.col("x").alias("t_x"), F.col("y").alias("t_y"), "measure")
        else:
            grid = spark.createDataFrame(boundary.clipped_cells(n), "t_x double, t_y double, measure double")
        # events that share a point (and a bandwidth) share their mass
        point = [*self.events.coords, *(["bandwidth"] if self._adaptive else [])]
        places = self.rows.select(*point).distinct()
        cells = grid.withColumnRenamed("measure", "a")
        if self._in_blocks:
            # here the events are the targets, so their bandwidths go with the rows
            fn = self._array_sum(list(self.events.coords), ["t_x", "t_y"], by_target=self._adaptive)
            mass = pair_sums(places, cells, point, fn, ["mass"])
        else:
            pairs = places.crossJoin(F.broadcast(cells))  # cells_per_axis squared rows
            mass = pairs.groupBy(*point).agg(F.sum(self._value(["t_x", "t_y"]) * F.col("a")).alias("mass"))
        return self.rows.join(mass, point)

    @property
    def _in_blocks(self) -> bool:
        return self.spec.kernel.array is not None and self.spec.metric.array is not None

    def _array_sum(self, t_cols: list[str], s_cols: list[str], by_target: bool):
        """Weighted kernel sums of arrays; a bandwidth column belongs to the targets or to the sources."""
        kernel, dim, h, metric = self.spec.kernel, self.events.dim, self.spec.bandwidth, self.spec.metric.array
        by_source = self._adaptive and not by_target
        whiten = np.linalg.inv(np.linalg.cholesky(np.array(h.matrix))) if isinstance(h, BandwidthMatrix) else None
        root = h.root if whiten is not None else 1.0
        euclidean = self.spec.metric is EUCLIDEAN or self.spec.metric.name == "euclidean"

        def fn(t: Columns, s: Columns):
            if whiten is not None:
                a, b = (whiten @ np.array([c[n] for n in names]) for c, names in ((t, t_cols), (s, s_cols)))
                square = sum((x[:, None] - y[None, :]) ** 2 for x, y in zip(a, b, strict=True))
            elif euclidean:
                square = squares(t, s, t_cols, s_cols)
            else:
                square = metric([t[c][:, None] for c in t_cols], [s[c][None, :] for c in s_cols])
            width = 1.0 if whiten is not None else t["bandwidth"][:, None] if by_target else s["bandwidth"][None, :] if by_source else h
            return (kernel.scaled_array(square, width, dim) @ s["a"] / root,)

        return fn

    def _value(self, t_cols: list[str]) -> Column:
        """The kernel of one pair, scaled."""
        t, s = [F.col(c) for c in t_cols], [F.col(c) for c in self.events.coords]
        h, dim = self.spec.bandwidth, self.events.dim
        if isinstance(h, BandwidthMatrix):
            return self.spec.kernel(F.sqrt(h.squared_distance(t, s)), dim) / h.root
        width = F.col("bandwidth") if self._adaptive or isinstance(h, BalloonKNNBandwidth) else h
        if self.spec.kernel.name == "gaussian" and not isinstance(width, Column):
            return F.exp(self.spec.metric.squared(t, s) * (-0.5 / width**2)) * ((2 * math.pi) ** (-dim / 2) / width**dim)
        return self.spec.kernel.scaled(F.sqrt(self.spec.metric.squared(t, s)), width, dim)

    def _reach(self) -> float | None:
        """Scaled distance beyond which the kernel counts as zero."""
        kernel, tolerance = self.spec.kernel, self.spec.tail_tolerance
        if self.spec.metric.name != "euclidean" or isinstance(self.spec.bandwidth, BandwidthMatrix):
            return None  # cells are boxes in plain distances
        if kernel.reach is None and tolerance is not None:
            return tail_reach(kernel, tolerance)
        return kernel.reach

    def evaluate(self, support: Support) -> DataFrame:
        """The support's columns with density or intensity; places without an event in reach get 0."""
        check_compatible(self.events, support).raise_for_errors()
        if self.spec.boundary is not None and self.spec.boundary.outside(support.df):
            raise ValueError("some places lie outside the boundary")
        t_cols = [f"t_{c}" for c in support.coords]
        targets = support.df.select("support_id", *[F.col(c).cast("double").alias(t) for c, t in zip(support.coords, t_cols, strict=True)])
        h, reach, sums = self.spec.bandwidth, self._reach(), None
        rows = self.rows.drop("event_id", "weight")
        coords, balloon = list(self.events.coords), isinstance(h, BalloonKNNBandwidth)
        if balloon:
            targets = targets.join(h.resolve(self.events, support), "support_id")
        if (reach is None or balloon) and self._in_blocks:
            sums = pair_sums(targets, rows, ["support_id"], self._array_sum(t_cols, coords, by_target=balloon), ["__f"])
        if sums is None:
            if reach is None or balloon:
                pairs = all_pairs(targets, rows)
            elif self._adaptive:
                pairs = near_pairs_by_source(targets, self.rows.drop("weight"), t_cols, coords, F.col("bandwidth") * reach, ["event_id"])
            else:
                pairs = near_pairs(targets, self.rows.drop("weight"), t_cols, coords, h * reach, ["event_id"])
            sums = pairs.groupBy("support_id").agg(F.sum(F.col("a") * self._value(t_cols)).alias("__f"))
        value = F.greatest(F.lit(0.0), F.coalesce("__f", F.lit(0.0)))
        return support.df.join(sums, "support_id", "left").withColumn(self.spec.target, value).drop("__f")


def integral(field: DataFrame, value: str) -> float:
    """Sum of value times measure."""
    return float(field.agg(F.sum(F.col(value) * F.col("measure")).alias("i")).first()["i"] or 0.0)


def to_grid(field: DataFrame, value: str, shape: tuple[int, ...]):
    """The field as a numpy array of the support's shape; for fields that fit the driver."""
    import numpy as np

    rows = field.select("support_id", value).orderBy("support_id").toArrow()
    return np.asarray(rows.column(value).to_numpy()).reshape(shape)


def with_wkt(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """df with its points as WKT, the text form that spatial tools read."""
    return df.withColumn("geometry", F.format_string("POINT (%s %s)", F.col(x).cast("string"), F.col(y).cast("string")))
