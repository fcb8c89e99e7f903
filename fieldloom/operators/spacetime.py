"""Kernel density and intensity in space and time, linear or cyclic."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.kernels import Kernel, get_kernel, squared_distance
from fieldloom.functions.time import LinearTime, TimeDomain, images, temporal_array, temporal_kernel
from fieldloom.operators.bandwidths import positive
from fieldloom.operators.selection import best, check_weights, checked
from fieldloom.operators.spatial import get_target
from fieldloom.plans import gauss
from fieldloom.plans.lineage import cut
from fieldloom.plans.pairs import all_pairs, near_pairs
from fieldloom.plans.sums import Columns, pair_sums, squares
from fieldloom.sources.planar import Events, Support, check_compatible


@dataclass(frozen=True)
class SpatiotemporalKDE:
    """Product kernels: K_d(distance / hs) / hs^d times the temporal kernel with ht."""

    spatial_bandwidth: float = 1.0
    temporal_bandwidth: float = 1.0
    spatial_kernel: str | Kernel = "gaussian"
    temporal_kernel: str | Kernel = "gaussian"
    target: str = "density"
    tail_tolerance: float = 1e-12

    def evaluate(self, events: Events, support: Support) -> DataFrame:
        hs, ht, target = positive(self.spatial_bandwidth), positive(self.temporal_bandwidth), get_target(self.target)
        domain = events.domain or LinearTime()
        check_compatible(events, support).raise_for_errors()
        events.check().raise_for_errors()
        total = events.total_weight() if target == "density" else 1.0
        kernel = get_kernel(self.spatial_kernel)
        t_cols = [f"t_{c}" for c in support.coords]
        targets = support.df.select("support_id", *[F.col(c).cast("double").alias(t) for c, t in zip(support.coords, t_cols, strict=True)], F.col("time").alias("t_time"))
        named = events.df.select("event_id", *events.coords, "time", (F.col("weight") / total).alias("a"))
        rows = named.drop("event_id")
        coords, clock = list(events.coords), get_kernel(self.temporal_kernel)
        # axes on which the kernels end, in units of their reach
        axes = [(t, c, hs * kernel.reach) for t, c in zip(t_cols, coords, strict=True)] if kernel.reach is not None else []
        axes += [("t_time", "time", ht * clock.reach)] if clock.reach is not None and domain.period is None else []
        sums = None
        dim, tail = events.dim, self.tail_tolerance
        if not axes and kernel.array is not None and clock.array is not None:

            def fn(t: Columns, s: Columns):
                space = kernel.scaled_array(squares(t, s, t_cols, coords), hs, dim)
                when = temporal_array(clock, t["t_time"][:, None] - s["time"][None, :], ht, domain, tail)
                return ((space * when) @ s["a"],)

            sums = pair_sums(targets, rows, ["support_id"], fn, ["__f"])
        if sums is None:
            if axes and len(axes) <= 3:
                scaled = lambda df, i: df.withColumns({f"__{i}{k}": F.col(axis[i]) / axis[2] for k, axis in enumerate(axes)})
                names = [[f"__{i}{k}" for k in range(len(axes))] for i in (0, 1)]
                pairs = near_pairs(scaled(targets, 0), scaled(named, 1), *names, 1.0, ["event_id"])
            else:
                pairs = all_pairs(targets, rows)
            d = F.sqrt(squared_distance([F.col(t) for t in t_cols], [F.col(c) for c in coords]))
            value = kernel.scaled(d, hs, events.dim) * temporal_kernel(clock, F.col("t_time") - F.col("time"), ht, domain, self.tail_tolerance)
            sums = pairs.groupBy("support_id").agg(F.sum(F.col("a") * value).alias("__f"))
        return support.df.join(sums, "support_id", "left").withColumn(target, F.greatest(F.lit(0.0), F.coalesce("__f", F.lit(0.0)))).drop("__f")


@dataclass(frozen=True)
class PairAsset:
    """Distances and signed time offsets (i, j, w_i, w_j, distance, dt) of all ordered pairs of different events, written once, with
    what they were taken from; for a number of events whose pairs are worth keeping."""

    pairs: DataFrame
    coords: tuple[str, ...]
    crs: str | None
    unit: str | None
    domain: TimeDomain
    source: str

    @classmethod
    def of(cls, events: Events) -> PairAsset:
        events.check().raise_for_errors()
        events.require_ids()
        return cls(cut(pair_table(events)), events.coords, events.crs, events.unit, events.domain or LinearTime(), events.fingerprint())

    def require(self, events: Events) -> None:
        """Stop where the asset was made from other events, coordinates or times."""
        mine = (self.coords, self.crs, self.unit, self.domain)
        if mine != (events.coords, events.crs, events.unit, events.domain or LinearTime()) or self.source != events.fingerprint():
            raise ValueError("the asset was made from other events")


def pair_table(events: Events) -> DataFrame:
    """(i, j, w_i, w_j, distance, dt) for all ordered pairs of different events."""
    a = events.df.select(F.col("event_id").alias("i"), F.col("weight").alias("w_i"), F.col("time").alias("a_t"), *[F.col(c).alias(f"a_{c}") for c in events.coords])
    b = events.df.select(F.col("event_id").alias("j"), F.col("weight").alias("w_j"), F.col("time").alias("b_t"), *[F.col(c).alias(f"b_{c}") for c in events.coords])
    d = F.sqrt(squared_distance([F.col(f"a_{c}") for c in events.coords], [F.col(f"b_{c}") for c in events.coords]))
    return a.join(b, F.col("i") != F.col("j")).select("i", "j", "w_i", "w_j", d.alias("distance"), (F.col("a_t") - F.col("b_t")).alias("dt"))


@dataclass(frozen=True)
class SpatiotemporalBandwidthExperiment:
    """Leave-one-out likelihood of every pair of candidates, in one job. joint takes the smallest joint score; separate takes
    the best spatial and the best temporal candidate on their own and reports their joint score."""

    spatial: Sequence[float]
    temporal: Sequence[float]
    mode: str = "joint"
    spatial_kernel: str | Kernel = "gaussian"
    temporal_kernel: str | Kernel = "gaussian"
    floor: float = 1e-300

    def scores(self, events: Events, asset: PairAsset | None = None) -> DataFrame:
        """(hs, ht, score, spatial_score, temporal_score). An event beside which there is no weight is an error. With an asset its
        pairs are read; without one, pairs are summed in blocks where events are few enough to send, else joined."""
        check_weights(events)
        domain, spatial, temporal = events.domain or LinearTime(), checked(self.spatial), checked(self.temporal)
        ks, kt = get_kernel(self.spatial_kernel), get_kernel(self.temporal_kernel)
        total = events.total_weight()
        if events.df.where(total - F.col("weight") <= 0).limit(1).count():
            raise ValueError("leave-one-out needs weight besides each event")
        grid = [(a, b) for a in range(len(spatial)) for b in range(len(temporal))]
        names = [f"s{a}" for a in range(len(spatial))] + [f"t{b}" for b in range(len(temporal))] + [f"b{a}_{b}" for a, b in grid]
        side = lambda n, w, p: events.df.select(F.col("event_id").alias(n), F.col("weight").alias(w), F.col("time").alias(f"{p}_t"), *[F.col(c).alias(f"{p}_{c}") for c in events.coords])
        a_cols, b_cols = ([f"{p}_{c}" for c in events.coords] for p in "ab")
        sums, dim = None, events.dim
        if asset is not None:
            asset.require(events)
        elif ks.array is not None and kt.array is not None:

            def fn(t: Columns, s: Columns):
                square, dt, own = squares(t, s, a_cols, b_cols), t["a_t"][:, None] - s["b_t"][None, :], t["i"][:, None] == s["j"][None, :]
                w = np.where(own, 0.0, s["w_j"][None, :])
                space = [w * ks.scaled_array(square, h, dim) for h in spatial]
                when = [temporal_array(kt, dt, h, domain) for h in temporal]
                both = [(x * y).sum(axis=1) for x in space for y in when]
                return [x.sum(axis=1) for x in space] + [(w * y).sum(axis=1) for y in when] + both

            targets, sources = side("i", "w_i", "a"), side("j", "w_j", "b")
            direct = lambda rows: pair_sums(rows, sources, ["i", "w_i"], fn, names)
            if ks.name == kt.name == "gaussian" and dim == 1 and domain.period is None and events.df.count() > gauss.ROWS:
                space, when = (a_cols[0], b_cols[0]), ("a_t", "b_t")
                axes = [[(*space, h)] for h in spatial] + [[(*when, h)] for h in temporal] + [[(*space, spatial[a]), (*when, temporal[b])] for a, b in grid]
                scale = {n: math.prod((2 * math.pi) ** -0.5 / x[2] for x in ax) for n, ax in zip(names, axes, strict=True)}
                sums = gauss.event_sums(targets, sources, ["i", "w_i"], axes, scale, "w_i", "w_j", [True] * len(names), direct)
            sums = direct(targets) if sums is None else sums
        if sums is None:
            pairs = asset.pairs if asset is not None else pair_table(events)
            space = [ks.scaled(F.col("distance"), h, events.dim) for h in spatial]
            when = [temporal_kernel(kt, F.col("dt"), h, domain) for h in temporal]
            values = [*space, *when, *(space[a] * when[b] for a, b in grid)]
            sums = pairs.groupBy("i", "w_i").agg(*[F.sum(F.col("w_j") * v).alias(n) for v, n in zip(values, names, strict=True)])
        log = lambda c: F.log(F.greatest(F.col(c) / (total - F.col("w_i")), F.lit(self.floor)))
        row = sums.agg(*[(-F.sum(F.col("w_i") * log(n)) / F.sum("w_i")).alias(n) for n in names])
        pick = lambda a, b: F.struct(
            F.lit(spatial[a]).alias("hs"), F.lit(temporal[b]).alias("ht"), F.col(f"b{a}_{b}").alias("score"), F.col(f"s{a}").alias("spatial_score"), F.col(f"t{b}").alias("temporal_score")
        )
        return row.select(F.explode(F.array(*[pick(a, b) for a, b in grid])).alias("r")).select("r.*")

    def run(self, events: Events) -> DataFrame:
        """One row (hs, ht, score)."""
        scores = self.scores(events)
        if self.mode == "joint":
            return best(scores.select("hs", "ht", "score"), ("hs", "ht"))
        if self.mode != "separate":
            raise ValueError("mode is joint or separate")
        picks = scores.agg(F.min_by("hs", F.struct("spatial_score", "hs")).alias("hs"), F.min_by("ht", F.struct("temporal_score", "ht")).alias("ht"))
        return scores.select("hs", "ht", "score").join(F.broadcast(picks), ["hs", "ht"])
