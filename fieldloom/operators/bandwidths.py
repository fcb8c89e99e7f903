"""Bandwidth strategies of the plane: scalar, matrix, nearest neighbours (of events or of places), and Abramson's."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.kernels import get_kernel, squared_distance
from fieldloom.plans import gauss
from fieldloom.plans.lineage import cut
from fieldloom.plans.pairs import all_pairs, near_pairs, small
from fieldloom.sources.planar import Events, Support


def positive(value: float, what: str = "bandwidth") -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value <= 0:
        raise ValueError(f"{what} must be a positive finite number")
    return float(value)


@dataclass(frozen=True)
class BandwidthMatrix:
    """A symmetric positive definite bandwidth matrix; distances are taken after solving with its Cholesky factor."""

    matrix: tuple[tuple[float, ...], ...]

    def __post_init__(self):
        h = np.array(self.matrix, dtype=float)
        if h.ndim != 2 or h.shape[0] != h.shape[1] or not np.isfinite(h).all() or not np.allclose(h, h.T, rtol=1e-10, atol=1e-12):
            raise ValueError("a bandwidth matrix is finite, square and symmetric")
        try:
            np.linalg.cholesky(h)
        except np.linalg.LinAlgError:
            raise ValueError("a bandwidth matrix is positive definite") from None

    @property
    def dim(self) -> int:
        return len(self.matrix)

    @property
    def root(self) -> float:
        """Square root of the determinant."""
        return float(np.prod(np.diag(np.linalg.cholesky(np.array(self.matrix)))))

    def squared_distance(self, a: list[Column], b: list[Column]) -> Column:
        inverse = np.linalg.inv(np.linalg.cholesky(np.array(self.matrix)))
        total = F.lit(0.0)
        for i in range(self.dim):
            z = F.lit(0.0)
            for j in range(i + 1):
                z = z + float(inverse[i, j]) * (a[j] - b[j])
            total = total + z * z
        return total


BRUTE_ROWS = 5_000


def kth_distances(
    targets: DataFrame, sources: DataFrame, t_cols: list[str], s_cols: list[str], key: str, k: int, *, other: str | None = None, brute_rows: int | None = None
) -> DataFrame:
    """(key, distance): distance of each target to its k-th nearest source; `other` names the source id to leave out itself.

    Few sources, or more than three axes: all pairs, of which Spark keeps the first k of a target before it shuffles (a group
    limit under the window). Else rounds of a cell join: the reach starts where a mean cell holds about k sources and
    doubles; a target is done as soon as k sources lie within the reach. Sources that share a point are one row with a count.
    """
    distance = F.sqrt(squared_distance([F.col(c) for c in t_cols], [F.col(c) for c in s_cols]))
    if len(t_cols) > 3 or small(sources, BRUTE_ROWS if brute_rows is None else brute_rows):
        pairs = all_pairs(targets, sources)
        if other is not None:
            pairs = pairs.where(F.col(key) != F.col(other))
        ranked = pairs.select(key, distance.alias("distance")).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("distance")))
        return ranked.where(F.col("rank") <= k).where(F.col("rank") == k).select(key, "distance")
    need = k + (other is not None)  # a target that is a source itself lies at distance 0
    points = cut(sources.groupBy(*s_cols).agg(F.count(F.lit(1)).alias("m")))
    box = points.agg(F.sum("m").alias("n"), *[(F.max(c) - F.min(c)).alias(f"d{i}") for i, c in enumerate(s_cols)]).first()
    if not box["n"] or box["n"] < need:
        raise ValueError(f"there are fewer than {need} sources")
    spans = [box[f"d{i}"] for i in range(len(s_cols)) if box[f"d{i}"]]
    ends = points.select(*[F.col(s).alias(t) for s, t in zip(s_cols, t_cols, strict=True)]).union(targets.select(*t_cols))
    corners = ends.agg(*[(F.max(c) - F.min(c)).alias(c) for c in t_cols]).first()
    if any(corners[c] is None or not math.isfinite(corners[c]) for c in t_cols):
        raise ValueError("some coordinates are not finite")
    across = math.sqrt(sum(corners[c] ** 2 for c in t_cols))  # no target is further from a source
    reach = (math.prod(spans) * need / box["n"]) ** (1 / len(spans)) if spans else 1.0
    pending, done = targets, []
    near_first = Window.partitionBy(key).orderBy("distance").rowsBetween(Window.unboundedPreceding, 0)
    while True:
        near = near_pairs(pending, points, t_cols, s_cols, reach).select(key, "m", distance.alias("distance")).where(F.col("distance") <= reach)
        # nearer sources first, until k are counted
        found = near.withColumn("seen", F.sum("m").over(near_first)).where(F.col("seen") >= need).groupBy(key).agg(F.min("distance").alias("distance"))
        found = cut(found)
        done.append(found)
        pending = cut(pending.join(found.select(key), key, "left_anti"))
        if not pending.limit(1).count():
            break
        if reach > 2 * across + 1e-300:
            raise ValueError("some targets are near no source: some coordinates are missing or not finite")
        reach *= 2
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def _floored(found: DataFrame, multiplier: float, floor: float | None) -> DataFrame:
    h = F.col("distance") * multiplier
    if floor is not None:
        h = F.greatest(h, F.lit(float(floor)))
    return found.select(found.columns[0], h.alias("bandwidth"))


@dataclass(frozen=True)
class KNNBandwidth:
    """Each event's distance to its k-th nearest other event, times a multiplier, at least a floor. Weights play no part."""

    k: int
    multiplier: float = 1.0
    minimum: float | None = None

    def resolve(self, events: Events) -> DataFrame:
        events.check().raise_for_errors()
        events.require_ids()
        n = events.df.count()
        if not 1 <= self.k <= n - 1:
            raise ValueError(f"k must be between 1 and {n - 1}")
        a = events.df.select("event_id", *[F.col(c).alias(f"t_{c}") for c in events.coords])
        b = events.df.select(F.col("event_id").alias("other_id"), *events.coords)
        found = kth_distances(a, b, [f"t_{c}" for c in events.coords], list(events.coords), "event_id", self.k, other="other_id")
        out = _floored(found, self.multiplier, self.minimum)
        if self.minimum is None and out.where("bandwidth <= 0").limit(1).count():
            raise ValueError("some k-th distances are zero; set a minimum bandwidth")
        return out


@dataclass(frozen=True)
class BalloonKNNBandwidth:
    """Each place's distance to its k-th nearest event, itself included if it is one."""

    k: int
    multiplier: float = 1.0
    minimum: float | None = None

    def resolve(self, events: Events, support: Support) -> DataFrame:
        events.check().raise_for_errors()
        support.check().raise_for_errors()
        n = events.df.count()
        if not 1 <= self.k <= n:
            raise ValueError(f"k must be between 1 and {n}")
        a = support.df.select("support_id", *[F.col(c).alias(f"t_{c}") for c in support.coords])
        found = kth_distances(a, events.df.select(*events.coords), [f"t_{c}" for c in support.coords], list(events.coords), "support_id", self.k)
        out = _floored(found, self.multiplier, self.minimum)
        if self.minimum is None and out.where("bandwidth <= 0").limit(1).count():
            raise ValueError("some k-th distances are zero; set a minimum bandwidth")
        return out


@dataclass(frozen=True)
class AbramsonBandwidth:
    """h0 * (f / g)^-alpha with a pilot density f at the events (itself included) and its weighted geometric mean g; the factor is
    clipped. The pilot bandwidth h0 is a number, or anything with select(events), such as a cross-validation."""

    pilot: object
    alpha: float = 0.5
    density_floor: float = 1e-12
    clip: tuple[float, float] = (0.2, 5.0)
    kernel: str = "gaussian"

    def resolve(self, events: Events) -> DataFrame:
        from fieldloom.operators.spatial import SpatialKDE

        events.require_ids()
        pilot = positive(self.pilot.select(events).bandwidth if hasattr(self.pilot, "select") else self.pilot, "pilot")
        places = Support(events.df.select(F.col("event_id").alias("support_id"), *events.coords), events.coords)
        field = lambda at: SpatialKDE(self.kernel, pilot).fit(events).evaluate(at)
        f = self._by_cells(events, pilot, field)
        f = field(places) if f is None else f
        f = f.select(F.col("support_id").alias("event_id"), F.greatest(F.col("density"), F.lit(self.density_floor)).alias("f"))
        rows = f.join(events.df.select("event_id", "weight"), "event_id")
        w = F.when(F.col("weight") > 0, F.col("weight"))
        mean = rows.agg(F.exp(F.sum(w * F.log("f")) / F.sum(w)).alias("g"))  # one row
        factor = F.pow(F.col("f") / F.col("g"), F.lit(-self.alpha))
        return rows.crossJoin(F.broadcast(mean)).select(
            "event_id", (pilot * F.greatest(F.lit(self.clip[0]), F.least(F.lit(self.clip[1]), factor))).alias("bandwidth")
        )

    def _by_cells(self, events: Events, pilot: float, field) -> DataFrame | None:
        """(support_id, density) at all events, where a Gaussian pilot can be summed by cells and there are many events."""
        if get_kernel(self.kernel).name != "gaussian" or events.dim > 2 or events.df.count() <= gauss.ROWS:
            return None
        events.check().raise_for_errors()
        rows = events.df.select(F.col("event_id").alias("support_id"), "weight", *events.coords)
        scale = {"density": (2 * math.pi) ** (-events.dim / 2) / pilot**events.dim / events.total_weight()}
        again = lambda at: field(Support(at.select("support_id", *events.coords), events.coords)).join(at.select("support_id", "weight"), "support_id")
        return gauss.event_sums(rows, rows, ["support_id", "weight"], [[(c, c, pilot) for c in events.coords]], scale, "weight", "weight", [False], again)
