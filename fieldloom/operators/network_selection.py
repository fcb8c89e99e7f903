"""Cross-validation on networks and in network-time: grids of candidates and bounded minimisation over distances or stretches that are
taken once."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.kernels import Kernel, get_kernel
from fieldloom.functions.time import TimeDomain, images, temporal_array, temporal_kernel
from fieldloom.operators.network import get_policy, kernel_from_stretches, location_distances, propagate, require_events, tiles
from fieldloom.operators.selection import Selection, best, bounds_of, candidates, checked, minimise_log
from fieldloom.plans.lineage import cut
from fieldloom.plans.lines import network_sums
from fieldloom.sources.network import Network


def _places(events: DataFrame, name: str) -> DataFrame:
    return events.select(F.col("event_id").alias(name), "edge_index", "offset")


@dataclass(frozen=True)
class Prepared:
    """Distances or stretches from events to targets out to the largest bandwidth, written once; kernels of any bandwidth up to it."""

    found: DataFrame
    targets: DataFrame
    kernel: Kernel
    paths: bool
    most: float

    @classmethod
    def of(cls, network: Network, events: DataFrame, targets: DataFrame, most: float, kernel: Kernel, policy: object, directed: bool | None = None) -> Prepared:
        rule = get_policy(policy)
        if rule.path_based and kernel.reach is None:
            raise ValueError("path policies need a kernel with reach")
        cutoff = most * kernel.reach if kernel.reach is not None else None
        places = _places(events, "source")
        found = propagate(network, places, cutoff, policy=rule, directed=directed) if rule.path_based else location_distances(network, places, targets, cutoff, directed=directed)
        return cls(cut(found), targets, kernel, rule.path_based, most)

    def kernels(self, h: float) -> DataFrame:
        """(source, target, k)."""
        if h > self.most * (1 + 1e-12) and self.kernel.reach is not None:
            raise ValueError("the bandwidth is above what was prepared")
        if self.paths:
            return kernel_from_stretches(self.found, self.targets, self.kernel, F.lit(float(h)))
        return self.found.select("source", "target", self.kernel.scaled(F.col("distance"), float(h), 1).alias("k"))

    def grid(self, hs: Sequence[float]) -> DataFrame:
        """(h, source, target, k) for every candidate."""
        parts = [self.kernels(h).select(F.lit(float(h)).alias("h"), "source", "target", "k") for h in hs]
        return functools.reduce(DataFrame.union, parts)


@dataclass(frozen=True)
class Tiled:
    """Events and targets in tiles of the edges, for sums of kernels along shortest paths of any bandwidth up to the largest; no pairs."""

    rows: DataFrame
    parts: int
    kernel: Kernel
    most: float

    @classmethod
    def of(cls, network: Network, events: DataFrame, targets: DataFrame | None, most: float, kernel: Kernel) -> Tiled:
        return cls(*tiles(network, events, targets, most * kernel.reach), kernel, most)

    def sums(self, by: Sequence[str], grid: Sequence[Sequence[float]], hs: Sequence[float], clock: Callable | None = None) -> DataFrame:
        """(by..., i, w_i, s) for the candidates of the grid, in the order of the sums."""
        if max(hs) > self.most * (1 + 1e-12):
            raise ValueError("the bandwidth is above what was prepared")
        found = network_sums(self.rows, self.parts, self.kernel, hs, clock)
        each = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(by, g, strict=True)], F.col("s")[i].alias("s")) for i, g in enumerate(grid)])
        return found.select(F.col("id").alias("i"), F.col("w").alias("w_i"), F.explode(each).alias("c")).select(*[f"c.{n}" for n in by], "i", "w_i", "c.s")

    def leave_one_out(self, events: DataFrame, by: Sequence[str], grid: Sequence[Sequence[float]], hs: Sequence[float], clock: Callable | None = None) -> DataFrame:
        """(by..., i, w_i, f) over all events and candidates; f is 0 where nothing is in reach."""
        total = events.agg(F.sum("weight").alias("w")).first()["w"]
        f = F.when(total - F.col("w_i") > 0, F.col("s") / (total - F.col("w_i"))).otherwise(0.0)
        return self.sums(by, grid, hs, clock).select(*by, "i", "w_i", F.greatest(F.lit(0.0), f).alias("f"))

    def field(self, events: DataFrame, hs: Sequence[float]) -> DataFrame:
        """(h, target, f): the density at targets of positive weights that sum to one."""
        total = events.agg(F.sum("weight").alias("w")).first()["w"]
        return self.sums(["h"], [(h,) for h in hs], hs).select("h", F.col("i").alias("target"), (F.col("s") / total).alias("f"))


def _lixel_places(lixels: DataFrame) -> DataFrame:
    return lixels.select(F.col("lixel_id").alias("target"), "edge_index", F.col("center_offset").alias("offset"))


def _leave_one_out(kernels: DataFrame, events: DataFrame, by: Sequence[str], grid: DataFrame) -> DataFrame:
    """(by…, i, w_i, f) over all events and candidates; f is 0 where nothing is in reach."""
    own = events.select(F.col("event_id").alias("source"), F.col("weight").alias("w_j"))
    sums = kernels.where("source <> target").join(own, "source").groupBy(*by, F.col("target").alias("i")).agg(F.sum(F.col("w_j") * F.col("k")).alias("s"))
    total = events.agg(F.sum("weight").alias("w")).first()["w"]
    rows = events.select(F.col("event_id").alias("i"), F.col("weight").alias("w_i")).crossJoin(F.broadcast(grid)).join(sums, [*by, "i"], "left")
    f = F.when(total - F.col("w_i") > 0, F.coalesce("s", F.lit(0.0)) / (total - F.col("w_i"))).otherwise(0.0)
    return rows.select(*by, "i", "w_i", F.greatest(F.lit(0.0), f).alias("f"))


def _likelihood(loo: DataFrame, by: Sequence[str], floor: float) -> DataFrame:
    return loo.groupBy(*by).agg((-F.sum(F.col("w_i") * F.log(F.greatest(F.col("f"), F.lit(floor)))) / F.sum("w_i")).alias("score"))


def _field(kernels: DataFrame, events: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., target, f): the density at targets of positive weights that sum to one."""
    total = events.agg(F.sum("weight").alias("w")).first()["w"]
    own = events.select(F.col("event_id").alias("source"), (F.col("weight") / total).alias("a"))
    return kernels.join(own, "source").groupBy(*by, "target").agg(F.sum(F.col("a") * F.col("k")).alias("f"))


def _least_squares(loo: DataFrame, field: DataFrame, measures: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., score): the sum of squares of the field (by..., cells, f) over its cells (with their measure), less twice the mean of loo."""
    keys = [c for c in measures.columns if c != "measure"]
    square = field.join(measures, keys).groupBy(*by).agg(F.sum(F.col("f") * F.col("f") * F.col("measure")).alias("square"))
    cross = loo.groupBy(*by).agg((F.sum(F.col("w_i") * F.col("f")) / F.sum("w_i")).alias("cross"))
    return cross.join(square, list(by), "left").select(*by, (F.coalesce("square", F.lit(0.0)) - 2 * F.col("cross")).alias("score"))


def check_selection(network: Network, events: DataFrame) -> None:
    """Valid events, at least two positive weights, and weight besides each event."""
    require_events(network, events)
    row = events.agg(F.count_if(F.col("weight") > 0).alias("n"), F.max("weight").alias("most"), F.sum("weight").alias("total")).first()
    if row["n"] < 2 or row["total"] - row["most"] <= 0:
        raise ValueError("selection needs at least two positive weights")


def distance_bounds(network: Network, events: DataFrame, directed: bool | None = None) -> tuple[float, float]:
    """Bounds of a bandwidth from the positive distances between all ordered pairs of events that reach each other."""
    d = location_distances(network, _places(events, "source"), _places(events, "target"), None, directed=directed)
    return bounds_of(d.where("source <> target").select("distance"))


@dataclass(frozen=True)
class NetworkBandwidthGrid:
    """Likelihood or least-squares scores of scalar bandwidths on a network."""

    hs: Sequence[float]
    objective: str = "likelihood"
    kernel: str | Kernel = "epanechnikov"
    policy: object = "simple"
    directed: bool | None = None
    floor: float = 1e-300

    def scores(self, network: Network, events: DataFrame, lixels: DataFrame | None = None, prepared: tuple[Prepared, Prepared | None] | None = None) -> DataFrame:
        """(h, score); prepared holds kernels among events and, for least squares, from events to lixels."""
        events = cut(events) if prepared is None else events
        hs = checked(self.hs)
        among, to_lixels = prepared or self.prepare(network, events, lixels, max(hs))
        if isinstance(among, Tiled):
            loo = among.leave_one_out(events, ["h"], [(h,) for h in hs], hs)
        else:
            loo = _leave_one_out(among.grid(hs), events, ["h"], candidates(events.sparkSession, hs))
        if self.objective == "likelihood":
            return _likelihood(loo, ["h"], self.floor)
        measures = lixels.select(F.col("lixel_id").alias("target"), F.col("length").alias("measure"))
        field = to_lixels.field(events, hs) if isinstance(to_lixels, Tiled) else _field(to_lixels.grid(hs), events, ["h"])
        return _least_squares(loo, field, measures, ["h"])

    def prepare(self, network: Network, events: DataFrame, lixels: DataFrame | None, most: float, over_time: bool = False) -> tuple[Prepared | Tiled, Prepared | Tiled | None]:
        """over_time: fields over lixels and time cells, which take pairs of events and lixels."""
        if self.objective not in ("likelihood", "least_squares"):
            raise ValueError("objective is likelihood or least_squares")
        if self.objective == "least_squares" and lixels is None:
            raise ValueError("least squares needs lixels")
        check_selection(network, events)
        kernel = get_kernel(self.kernel)
        if not get_policy(self.policy).path_based and not network.is_directed(self.directed) and kernel.reach is not None and kernel.array is not None:
            among = Tiled.of(network, events, None, most, kernel)
            if self.objective == "likelihood":
                return among, None
            at = _lixel_places(lixels)
            return among, Prepared.of(network, events, at, most, kernel, self.policy, self.directed) if over_time else Tiled.of(network, events, at, most, kernel)
        among = Prepared.of(network, events, _places(events, "target"), most, kernel, self.policy, self.directed)
        if self.objective == "likelihood":
            return among, None
        if among.paths:  # the same stretches serve both
            return among, replace(among, targets=_lixel_places(lixels))
        return among, Prepared.of(network, events, _lixel_places(lixels), most, kernel, self.policy, self.directed)

    def best(self, network: Network, events: DataFrame, lixels: DataFrame | None = None) -> DataFrame:
        return best(self.scores(network, events, lixels))


@dataclass(frozen=True)
class _NetworkCV:
    bounds: tuple[float, float] | None = None
    tolerance: float = 1e-5
    most: int = 200
    floor: float = 1e-300

    method = ""

    def select(
        self, network: Network, events: DataFrame, lixels: DataFrame | None = None, *, kernel: str | Kernel = "epanechnikov", policy: object = "simple", directed: bool | None = None
    ) -> Selection:
        """The scalar bandwidth of the smallest score. Distances or stretches are taken once, out to the upper bound; each evaluation is a
        job over them. Without bounds these come from the distances between all pairs of events."""
        events = cut(events)
        check_selection(network, events)
        bounds = self.bounds or distance_bounds(network, events, directed)
        grid = NetworkBandwidthGrid((bounds[1],), self.method, kernel, policy, directed, self.floor)
        prepared = grid.prepare(network, events, lixels, bounds[1])

        def score(h: float) -> float:
            return float(replace(grid, hs=(min(h, bounds[1]),)).scores(network, events, lixels, prepared).first()["score"])

        h, s, trace = minimise_log(score, bounds, self.tolerance, self.most)
        return Selection(h, s, tuple(trace), bounds, f"network_{self.method}")


@dataclass(frozen=True)
class NetworkLikelihoodCV(_NetworkCV):
    """Leave-one-out likelihood of a network bandwidth; also a bandwidth of NetworkKDE."""

    method = "likelihood"


@dataclass(frozen=True)
class NetworkLeastSquaresCV(_NetworkCV):
    """Least squares of a network bandwidth over lixels; also a bandwidth of NetworkKDE."""

    method = "least_squares"


@dataclass(frozen=True)
class NetworkTimeBandwidthExperiment:
    """Scores of pairs of network and temporal bandwidths, by leave-one-out likelihood or by least squares over arixels; the two factors
    meet once per pair of events. joint takes the smallest joint score; separate takes the best of each kind on its own and
    reports their joint score."""

    spatial: Sequence[float]
    temporal: Sequence[float]
    domain: TimeDomain
    kernel: str | Kernel = "epanechnikov"
    temporal_kernel: str | Kernel = "gaussian"
    policy: object = "continuous"
    directed: bool | None = None
    floor: float = 1e-300
    objective: str = "likelihood"
    mode: str = "joint"

    def _prepared(self, network: Network, events: DataFrame, lixels: DataFrame | None) -> tuple[Prepared, Prepared | None]:
        if self.mode not in ("joint", "separate"):
            raise ValueError("mode is joint or separate")
        grid = NetworkBandwidthGrid(self.spatial, self.objective, self.kernel, self.policy, self.directed)
        return grid.prepare(network, events, lixels, max(checked(self.spatial)), True)

    def _clock(self, dt: Column) -> Column:
        kt = get_kernel(self.temporal_kernel)
        most = max(images(kt, h, self.domain.period) for h in self.temporal) if self.domain.period else None
        return temporal_kernel(kt, dt, F.col("ht"), self.domain, most=most)

    def _clock_array(self) -> Callable:
        kt, hts, domain = get_kernel(self.temporal_kernel), checked(self.temporal), self.domain
        most = max(images(kt, h, domain.period) for h in hts) if domain.period else None
        return lambda dt: np.stack([temporal_array(kt, dt, h, domain, most=most) for h in hts])

    def scores(self, network: Network, events: DataFrame, lixels: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
        """(h, ht, score); least squares needs lixels and time cells (time_index, time, time_width)."""
        events = cut(events)
        return self._joint(events, self._prepared(network, events, lixels), lixels, cells)

    def _joint(self, events: DataFrame, prepared: tuple[Prepared, Prepared | None], lixels: DataFrame | None, cells: DataFrame | None) -> DataFrame:
        spark, hs, clock = events.sparkSession, checked(self.spatial), candidates(events.sparkSession, self.temporal, "ht")
        among, to_lixels = prepared
        own, other = (events.select(F.col("event_id").alias(n), F.col("time").alias(t)) for n, t in (("source", "s"), ("target", "t")))
        if isinstance(among, Tiled) and get_kernel(self.temporal_kernel).array is not None:
            loo = among.leave_one_out(events, ["h", "ht"], [(h, ht) for h in hs for ht in checked(self.temporal)], hs, self._clock_array())
        else:
            loo = self._paired(events, among, own, other, hs, clock)
        if self.objective == "likelihood":
            return _likelihood(loo, ["h", "ht"], self.floor)
        if cells is None:
            raise ValueError("least squares needs time cells")
        when = own.crossJoin(F.broadcast(cells)).crossJoin(F.broadcast(clock)).select("source", "ht", "time_index", self._clock(F.col("time") - F.col("s")).alias("c"))
        field = to_lixels.grid(hs).where("k <> 0").join(when, "source").withColumn("k", F.col("k") * F.col("c"))
        measures = lixels.select(F.col("lixel_id").alias("target"), "length").crossJoin(F.broadcast(cells.select("time_index", "time_width")))
        measures = measures.select("target", "time_index", (F.col("length") * F.col("time_width")).alias("measure"))
        return _least_squares(loo, _field(field, events, ["h", "ht", "time_index"]), measures, ["h", "ht"])

    def _paired(self, events, among, own, other, hs, clock) -> DataFrame:
        both = among.grid(hs).where("k <> 0").join(own, "source").join(other, "target").crossJoin(F.broadcast(clock))
        both = both.withColumn("k", F.col("k") * self._clock(F.col("t") - F.col("s")))
        return _leave_one_out(both, events, ["h", "ht"], candidates(events.sparkSession, hs).crossJoin(clock))

    def marginal_scores(self, network: Network, events: DataFrame, lixels: DataFrame | None = None, cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(h, score) by space alone and (ht, score) by time alone."""
        events = cut(events)
        return self._marginal(network, events, self._prepared(network, events, lixels), lixels, cells)

    def _marginal(self, network, events, prepared, lixels, cells):
        if self.objective == "least_squares" and isinstance(prepared[0], Tiled):
            prepared = prepared[0], Tiled.of(network, events, _lixel_places(lixels), prepared[0].most, prepared[0].kernel)
        space = NetworkBandwidthGrid(self.spatial, self.objective, self.kernel, self.policy, self.directed, self.floor).scores(network, events, lixels, prepared)
        clock = candidates(events.sparkSession, self.temporal, "ht")
        own, other = (events.select(F.col("event_id").alias(n), F.col("time").alias(t)) for n, t in (("source", "s"), ("target", "t")))
        pairs = own.crossJoin(other).crossJoin(F.broadcast(clock)).select("ht", "source", "target", self._clock(F.col("t") - F.col("s")).alias("k"))
        loo = _leave_one_out(pairs, events, ["ht"], clock)
        if self.objective == "likelihood":
            return space, _likelihood(loo, ["ht"], self.floor)
        if cells is None:
            raise ValueError("least squares needs time cells")
        when = own.crossJoin(F.broadcast(cells)).crossJoin(F.broadcast(clock)).select("ht", "source", F.col("time_index").alias("target"), self._clock(F.col("time") - F.col("s")).alias("k"))
        measures = cells.select(F.col("time_index").alias("target"), F.col("time_width").alias("measure"))
        return space, _least_squares(loo, _field(when, events, ["ht"]), measures, ["ht"])

    def run(self, network: Network, events: DataFrame, lixels: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
        """One row (h, ht, score)."""
        events = cut(events)
        prepared = self._prepared(network, events, lixels)
        joint = self._joint(events, prepared, lixels, cells)
        if self.mode == "joint":
            return best(joint, ("h", "ht"))
        space, when = self._marginal(network, events, prepared, lixels, cells)
        picks = best(space).select("h").crossJoin(best(when, ("ht",)).select("ht"))  # one row each
        return joint.join(F.broadcast(picks), ["h", "ht"])
