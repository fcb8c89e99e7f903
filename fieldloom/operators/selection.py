"""Cross-validated bandwidths: leave-one-out sums for all candidates in one job, without a table of pairs, and bounded minimisation
over log h."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.kernels import Kernel, get_kernel, squared_distance
from fieldloom.plans import gauss
from fieldloom.plans.lineage import cut
from fieldloom.plans.quantiles import pair_quantiles, quantiles
from fieldloom.plans.sums import Columns, pair_sums, squares
from fieldloom.sources.planar import Events


@dataclass(frozen=True)
class Selection:
    """The chosen bandwidth with the trace of evaluations, in order."""

    bandwidth: float
    score: float
    trace: tuple[tuple[float, float], ...]
    bounds: tuple[float, float]
    method: str

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, h, s) for i, (h, s) in enumerate(self.trace)]
        return spark.createDataFrame(rows, "evaluation int, bandwidth double, score double")


def check_weights(events: Events) -> None:
    """At least two events of positive weight, all weights finite and none negative, and ids that differ."""
    events.check().raise_for_errors()
    events.require_ids()
    if events.df.agg(F.count_if(F.col("weight") > 0).alias("n")).first()["n"] < 2:
        raise ValueError("selection needs at least two positive weights")


def _sides(events: Events) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """Events as targets (i, w_i, a_...) and as sources (j, w_j, b_...), with the names of their coordinates."""
    cols = lambda p: [F.col(c).alias(f"{p}_{c}") for c in events.coords]
    t = events.df.select(F.col("event_id").alias("i"), F.col("weight").alias("w_i"), *cols("a"))
    s = events.df.select(F.col("event_id").alias("j"), F.col("weight").alias("w_j"), *cols("b"))
    return t, s, [f"a_{c}" for c in events.coords], [f"b_{c}" for c in events.coords]


def pair_distances(events: Events) -> DataFrame:
    """(i, j, distance) with i < j: each pair of different events once, as a stream of rows that is not kept."""
    t, s, a, b = _sides(events)
    d = F.sqrt(squared_distance([F.col(c) for c in a], [F.col(c) for c in b]))
    return t.join(s, F.col("i") < F.col("j")).select("i", "j", d.alias("distance"))


SHARES = (0.05, 0.5, 0.95)


def _bounds(q: Sequence[float] | None) -> tuple[float | None, float | None]:
    if q is None:
        return None, None
    low = max(0.2 * q[0], 1e-6 * q[1])
    return low, max(2 * q[2], 10 * low)


def _bounds_row(spark: SparkSession, q: Sequence[float] | None) -> DataFrame:
    return spark.createDataFrame([_bounds(q)], "lower double, upper double")


def bandwidth_bounds(distances: DataFrame, approximate: bool = False) -> DataFrame:
    """One row (lower, upper) from the quantiles of the positive, finite distances, each pair counted once. Exact quantiles take a few
    passes over the distances, at once; approximate ones one pass, when read."""
    if not approximate:
        return _bounds_row(distances.sparkSession, quantiles(distances.select("distance"), SHARES))
    q = F.percentile_approx("distance", F.array(*map(F.lit, SHARES)), 100_000)
    low = F.greatest(0.2 * F.col("q")[0], 1e-6 * F.col("q")[1])
    found = distances.where("distance > 0 and distance < double('infinity')").agg(q.alias("q"))
    return found.select(low.alias("lower"), F.greatest(2 * F.col("q")[2], 10 * low).alias("upper"))


def event_bounds(events: Events) -> DataFrame:
    """bandwidth_bounds of the distances between all events, exact, without a row for each pair."""
    return _bounds_row(events.df.sparkSession, pair_quantiles(events.df, events.coords, SHARES))


def facts_of(events: Events) -> Row:
    """The number of events, their total weight, and the least and greatest of each coordinate."""
    row = events.df.agg(F.count(F.lit(1)).alias("n"), *gauss.box_of({f"b_{c}": c for c in events.coords}, "weight")).first()
    return Row(**{**row.asDict(), "total": float(row["total"] or 0.0)})


def leave_one_out(events: Events, kernel: Kernel, hs: Sequence[float], *, wide: bool = False, strict: bool = False, facts: Row | None = None) -> DataFrame:
    """(h, i, w_i, f): density at each event from the others; 0 without weight elsewhere, which is an error if strict. wide adds the
    weighted sum of the kernel with sqrt(2) times the bandwidth, itself included. facts: what facts_of says, if known."""
    t, s, a, b = _sides(events)
    dim, n = events.dim, len(hs)
    facts = facts or facts_of(events)
    total = facts["total"]
    names = [f"near{k}" for k in range(n)] + [f"wide{k}" for k in range(n) if wide]
    sums = None
    if kernel.array is not None:

        def fn(x: Columns, y: Columns):
            square, own = squares(x, y, a, b), x["i"][:, None] == y["j"][None, :]
            near = [np.where(own, 0.0, kernel.scaled_array(square, h, dim)) @ y["w_j"] for h in hs]
            return near + [kernel.scaled_array(square, h * math.sqrt(2), dim) @ y["w_j"] for h in hs if wide]

        direct = lambda rows: pair_sums(rows, s, ["i", "w_i"], fn, names)
        if kernel.name == "gaussian" and dim <= 2 and facts["n"] > gauss.ROWS:
            widths = [*hs, *(h * math.sqrt(2) for h in hs if wide)]
            axes = [[(x, y, h) for x, y in zip(a, b, strict=True)] for h in widths]
            scale = {m: (2 * math.pi) ** (-dim / 2) / h**dim for m, h in zip(names, widths, strict=True)}
            sums = gauss.event_sums(t, s, ["i", "w_i"], axes, scale, "w_i", "w_j", [m.startswith("near") for m in names], direct, facts)
        sums = direct(t) if sums is None else sums
    if sums is None:
        d = F.sqrt(squared_distance([F.col(c) for c in a], [F.col(c) for c in b]))
        pairs = t.crossJoin(s).withColumn("d", d)
        parts = [F.sum(F.when(F.col("i") != F.col("j"), F.col("w_j") * kernel.scaled(F.col("d"), h, dim)).otherwise(0.0)).alias(f"near{k}") for k, h in enumerate(hs)]
        parts += [F.sum(F.col("w_j") * kernel.scaled(F.col("d"), h * math.sqrt(2), dim)).alias(f"wide{k}") for k, h in enumerate(hs) if wide]
        sums = pairs.groupBy("i", "w_i").agg(*parts)
    others = total - F.col("w_i")
    if strict and events.df.where(total - F.col("weight") <= 0).limit(1).count():
        raise ValueError("leave-one-out needs weight besides each event")
    one = lambda k, h: F.struct(F.lit(float(h)).alias("h"), F.when(others > 0, F.col(f"near{k}") / others).otherwise(0.0).alias("f"), *([F.col(f"wide{k}").alias("wide")] if wide else []))
    rows = sums.select("i", "w_i", F.explode(F.array(*[one(k, h) for k, h in enumerate(hs)])).alias("r"))
    return rows.select("r.h", "i", "w_i", "r.f", *(["r.wide"] if wide else []))


def likelihood_scores(events: Events, kernel: Kernel, hs: Sequence[float], floor: float = 1e-300, facts: Row | None = None) -> DataFrame:
    """(h, score): negative leave-one-out log likelihood of every candidate, in one job."""
    loo = leave_one_out(events, kernel, checked(hs), facts=facts)
    return loo.groupBy("h").agg((-F.sum(F.col("w_i") * F.log(F.greatest(F.col("f"), F.lit(floor)))) / F.sum("w_i")).alias("score"))


def least_squares_scores(events: Events, hs: Sequence[float], facts: Row | None = None) -> DataFrame:
    """(h, score): Gaussian least-squares cross-validation; the integral of the squared density has the diagonal."""
    rows = leave_one_out(events, get_kernel("gaussian"), checked(hs), wide=True, facts=facts)
    total = F.sum("w_i")
    score = F.sum(F.col("w_i") * F.col("wide")) / (total * total) - 2 * F.sum(F.col("w_i") * F.col("f")) / total
    return rows.groupBy("h").agg(score.alias("score"))


def best(scores: DataFrame, by: Sequence[str] = ("h",)) -> DataFrame:
    """One row: the first candidate, in order, of the smallest score."""
    row = F.struct(*by, "score")
    return scores.agg(F.min_by(row, F.struct("score", *by)).alias("r")).select("r.*")


def checked(values: Sequence[float]) -> list[float]:
    """Candidate bandwidths: finite, positive, unique."""
    out = [float(v) for v in values]
    if not out or any(not math.isfinite(v) or v <= 0 for v in out) or len(set(out)) != len(out):
        raise ValueError("candidates are finite, positive and unique")
    return out


def candidates(spark: SparkSession, values: Sequence[float], name: str = "h") -> DataFrame:
    """A column of candidate bandwidths."""
    out = checked(values)
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in out])).alias(name))


def minimise_log(objective: Callable[[float], float], bounds: tuple[float, float], tolerance: float = 1e-4, most: int = 60) -> tuple[float, float, list[tuple[float, float]]]:
    """Bounded minimisation over log h: golden section steps, with parabolic ones where the fit is inside and shrinking."""
    low, high = bounds
    if not (0 < low < high < math.inf):
        raise ValueError("bounds are positive and in order")
    trace: list[tuple[float, float]] = []

    def f(x: float) -> float:
        h = math.exp(x)
        s = objective(h)
        s = s if math.isfinite(s) else sys.float_info.max
        trace.append((h, s))
        return s

    golden = (3 - math.sqrt(5)) / 2
    a, b = math.log(low), math.log(high)
    x = w = v = a + golden * (b - a)
    fx = fw = fv = f(x)
    step = before = 0.0
    while len(trace) < most:
        mid, tol = (a + b) / 2, 1.48e-8 * abs(x) + tolerance / 3
        if abs(x - mid) <= 2 * tol - (b - a) / 2:
            break
        use_golden = True
        if abs(before) > tol:
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p, q = (x - v) * q - (x - w) * r, 2 * (q - r)
            p, q = (-p, q) if q > 0 else (p, -q)
            if abs(p) < abs(0.5 * q * before) and q * (a - x) < p < q * (b - x):
                before, step = step, p / q
                u = x + step
                if u - a < 2 * tol or b - u < 2 * tol:
                    step = tol if mid >= x else -tol
                use_golden = False
        if use_golden:
            before = (b - x) if x < mid else (a - x)
            step = golden * before
        u = x + (step if abs(step) >= tol else math.copysign(tol, step))
        fu = f(u)
        if fu <= fx:
            a, b = (x, b) if u >= x else (a, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            a, b = (u, b) if u < x else (a, u)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return math.exp(x), fx, trace


@dataclass(frozen=True)
class _CrossValidation:
    bounds: tuple[float, float] | None = None
    kernel: str | Kernel = "gaussian"
    tolerance: float = 1e-4
    most: int = 60

    method = ""

    def _scores(self, events: Events, h: float, facts: Row) -> DataFrame:
        raise NotImplementedError

    def select(self, events: Events) -> Selection:
        """A few jobs per evaluation, over events that are dealt to all tasks and written once."""
        check_weights(events)
        tasks = events.df.sparkSession.sparkContext.defaultParallelism
        events = replace(events, df=cut(events.df.select("event_id", *events.coords, "weight").repartition(tasks, "event_id")))
        bounds, facts = self.bounds or _found(event_bounds(events)), facts_of(events)
        h, s, trace = minimise_log(lambda h: float(self._scores(events, h, facts).first()["score"]), bounds, self.tolerance, self.most)
        return Selection(h, s, tuple(trace), bounds, self.method)


def bounds_of(distances: DataFrame) -> tuple[float, float]:
    return _found(bandwidth_bounds(distances))


def _found(bounds: DataFrame) -> tuple[float, float]:
    row = bounds.first()
    if row["lower"] is None:
        raise ValueError("automatic bounds need two places a positive distance apart")
    return row["lower"], row["upper"]


@dataclass(frozen=True)
class LikelihoodCV(_CrossValidation):
    """Leave-one-out likelihood, any kernel."""

    method = "likelihood"

    def _scores(self, events, h, facts):
        return likelihood_scores(events, get_kernel(self.kernel), [h], facts=facts)


@dataclass(frozen=True)
class LeastSquaresCV(_CrossValidation):
    """Least squares, Gaussian kernel only."""

    method = "least_squares"

    def _scores(self, events, h, facts):
        if get_kernel(self.kernel).name != "gaussian":
            raise ValueError("least squares needs the Gaussian kernel")
        return least_squares_scores(events, [h], facts)
