"""Events, supports and boundaries of the plane, as DataFrames with checked columns."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.time import LinearTime, TimeDomain
from fieldloom.plans.lineage import cut
from fieldloom.sources import polygons


@dataclass(frozen=True)
class Issue:
    severity: str
    code: str
    message: str


@dataclass(frozen=True)
class Report:
    """Findings of a check; raise_for_errors stops at errors, warnings stay."""

    issues: tuple[Issue, ...] = ()

    @property
    def errors(self) -> tuple[Issue, ...]:
        return tuple(i for i in self.issues if i.severity == "error")

    @property
    def warnings(self) -> tuple[Issue, ...]:
        return tuple(i for i in self.issues if i.severity == "warning")

    @property
    def valid(self) -> bool:
        return not self.errors

    def combine(self, *others: Report) -> Report:
        return Report(self.issues + tuple(i for o in others for i in o.issues))

    def raise_for_errors(self) -> Report:
        if self.errors:
            raise ValueError("; ".join(f"{i.code}: {i.message}" for i in self.errors))
        return self

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i.severity, i.code, i.message) for i in self.issues], "severity string, code string, message string")


def bad(c: Column) -> Column:
    """Null, NaN or infinite."""
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def names_of(dim: int) -> tuple[str, ...]:
    return ("x", "y", "z")[:dim] if dim <= 3 else tuple(f"coord_{i}" for i in range(dim))


@dataclass(frozen=True)
class Events:
    """Weighted points: event_id, one double column per axis, weight, and for space-time a double column time."""

    df: DataFrame
    coords: tuple[str, ...] = ("x", "y")
    crs: str | None = None
    unit: str | None = None
    domain: TimeDomain | None = None
    provenance: tuple[str, ...] = field(default=())
    numbered: bool = False  # ids were made here, so they are unique

    @classmethod
    def from_frame(
        cls,
        df: DataFrame,
        coords: Sequence[str | Column],
        *,
        weight: str | Column | None = None,
        event_id: str | Column | None = None,
        mark: str | Column | None = None,
        time: str | Column | None = None,
        domain: TimeDomain | None = None,
        names: Sequence[str] | None = None,
        crs: str | None = None,
        unit: str | None = None,
    ) -> Events:
        """Project any DataFrame to events. Without an id the rows are numbered once and written, so that every reader sees the same
        numbers; rows that repeat a point stay apart."""
        col = lambda c: F.col(c) if isinstance(c, str) else c
        axes = tuple(names or names_of(len(coords)))
        if len(set(axes)) != len(axes) or len(axes) != len(coords):
            raise ValueError("coordinate names must be unique, one per coordinate")
        points = [col(c).cast("double").alias(n) for c, n in zip(coords, axes, strict=True)]
        w = (col(weight) if weight is not None else F.lit(1.0)).cast("double").alias("weight")
        ident = col(event_id) if event_id is not None else F.monotonically_increasing_id()
        more = [col(mark).cast("string").alias("mark")] if mark is not None else []
        if time is not None:
            domain = domain or LinearTime()
            more.append(domain.canonical(col(time)).alias("time"))
        rows = df.select(ident.alias("event_id"), *points, w, *more)
        return cls(rows if event_id is not None else cut(rows), axes, crs, unit, domain, numbered=event_id is None)

    @classmethod
    def from_points(cls, df: DataFrame, geometry: str = "geometry", **options) -> Events:
        """Events from a column of points: a struct with x and y, or WKT text such as POINT (1 2). Empty or other geometry is an error."""
        g = F.col(geometry)
        if dict(df.dtypes)[geometry].startswith("struct"):
            x, y = g["x"], g["y"]
        else:
            number = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"
            shape = rf"(?i)^\s*POINT\s*(?:Z\s*)?\(\s*{number}\s+{number}(?:\s+{number})?\s*\)\s*$"
            x, y = (F.regexp_extract(g, shape, i).try_cast("double") for i in (1, 2))
        if n := df.where(bad(x) | bad(y)).limit(1).count():
            raise ValueError(f"{n} or more rows hold no point")
        return cls.from_frame(df, (x, y), **options)

    @property
    def dim(self) -> int:
        return len(self.coords)

    def check(self, *, unique_ids: bool = False) -> Report:
        """One aggregate over the events: finite coordinates and times, weights at least 0 and one above, repeated points and times,
        and, if asked, ids that are there and differ."""
        axes = [*self.coords, *(["time"] if "time" in self.df.columns else [])]
        point = F.struct(*[F.col(c) for c in self.coords])
        row = self.df.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(bad(F.col(c))).alias(f"bad_{c}") for c in axes],
            F.count_if(bad(F.col("weight")) | (F.col("weight") < 0)).alias("bad_weight"),
            F.count_if(F.col("weight") > 0).alias("positive"),
            F.count_distinct(point).alias("distinct"),
            *([F.count_distinct(F.struct(*[F.col(c) for c in axes])).alias("moments")] if "time" in axes else []),
            *([F.count_distinct("event_id").alias("ids")] if unique_ids else []),
        ).first()
        found = []
        if not row["n"]:
            found.append(Issue("error", "empty", "there are no events"))
        found += [Issue("error", "non_finite", f"{row[f'bad_{c}']} values of {c} are not finite") for c in axes if row[f"bad_{c}"]]
        if row["bad_weight"]:
            found.append(Issue("error", "weights", f"{row['bad_weight']} weights are negative or not finite"))
        elif row["n"] and not row["positive"]:
            found.append(Issue("error", "weights", "no weight is positive"))
        if row["n"] > row["distinct"]:
            found.append(Issue("warning", "duplicate_coordinates", f"{row['n'] - row['distinct']} events repeat a point"))
        if "time" in axes and row["n"] > row["moments"]:
            found.append(Issue("warning", "duplicate_times", f"{row['n'] - row['moments']} events repeat a point and a time"))
        if unique_ids and row["ids"] < row["n"]:
            found.append(Issue("error", "duplicate_ids", f"{row['n'] - row['ids']} ids repeat or are missing"))
        if self.crs is None:
            found.append(Issue("warning", "missing_crs", "no coordinate system is given"))
        return Report(tuple(found))

    def require_ids(self) -> None:
        """Stop where ids repeat or are missing: joins of events with themselves need one id each."""
        if not self.numbered and self.df.groupBy("event_id").count().where("count > 1 or event_id is null").limit(1).count():
            raise ValueError("event ids must be unique and present; leave event_id out to have the rows numbered")

    def summary(self) -> DataFrame:
        """One row: events, total weight, and the least and largest value of each coordinate and of time."""
        axes = [*self.coords, *(["time"] if "time" in self.df.columns else [])]
        ends = [f(c).alias(f"{n}_{c}") for c in axes for n, f in (("min", F.min), ("max", F.max))]
        return self.df.agg(F.count(F.lit(1)).alias("n_events"), F.sum("weight").alias("total_weight"), *ends)

    def total_weight(self) -> float:
        return float(self.df.agg(F.sum("weight").alias("w")).first()["w"] or 0.0)

    def fingerprint(self) -> str:
        """A hash of the content that does not depend on the order of rows."""
        return fingerprint(self.df)

    def with_step(self, step: str) -> Events:
        return replace(self, provenance=(*self.provenance, step))


def fingerprint(df: DataFrame) -> str:
    """A hash of names, types and rows that does not depend on the order of rows. Each value counts with its place and with
    whether it is null; maps are hashed by their sorted entries. Two sums of 64-bit hashes with different seeds."""
    kinds = dict(df.dtypes)

    def value(c: str):
        col = F.col(f"`{c}`")
        return F.array_sort(F.map_entries(col)) if kinds[c].startswith("map<") else col

    cells = [x for i, c in enumerate(df.columns) for x in (F.lit(i), F.col(f"`{c}`").isNull(), value(c))]
    one, two = (F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(38,0)")) for seed in (17, 91))
    row = df.agg(F.count(F.lit(1)).alias("n"), one.alias("one"), two.alias("two")).first()
    low = lambda v: int(v or 0) & (1 << 96) - 1
    return f"{row['n']:x}-{low(row['one']):024x}-{low(row['two']):024x}-{'.'.join(f'{c}:{t}' for c, t in df.dtypes)}"


def check_compatible(events: Events, support: Support) -> Report:
    """Errors where dimension, coordinate names, coordinate systems, units or time domains of events and support differ."""
    found = []
    if len(events.coords) != len(support.coords):
        found.append(Issue("error", "dimension", f"events have {len(events.coords)} coordinates, the support {len(support.coords)}"))
    elif events.coords != support.coords:
        found.append(Issue("error", "coordinate_names", f"{events.coords} and {support.coords}"))
    for name in ("crs", "unit"):
        a, b = getattr(events, name), getattr(support, name)
        if a and b and a != b:
            found.append(Issue("error", f"{name}_mismatch", f"{a} and {b}"))
        elif (a is None) != (b is None):
            found.append(Issue("warning", f"{name}_missing", f"only one side names its {name}"))
    if (events.domain or LinearTime()) != (support.domain or LinearTime()):
        found.append(Issue("error", "time_domain", f"{events.domain} and {support.domain}"))
    return Report(tuple(found))


@dataclass(frozen=True)
class Support:
    """Places where a field is evaluated: support_id, coordinates, and `measure` where cells have a size."""

    df: DataFrame
    coords: tuple[str, ...] = ("x", "y")
    shape: tuple[int, ...] | None = None
    crs: str | None = None
    unit: str | None = None
    domain: TimeDomain | None = None

    @property
    def measured(self) -> bool:
        return "measure" in self.df.columns

    def check(self) -> Report:
        """Finite coordinates and times, ids that are there and differ, positive measures; one aggregate."""
        axes = [*self.coords, *(["time"] if "time" in self.df.columns else [])]
        row = self.df.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("support_id").alias("ids"),
            *[F.count_if(bad(F.col(c).cast("double"))).alias(f"bad_{c}") for c in axes],
            (F.count_if(bad(F.col("measure")) | (F.col("measure") <= 0)) if self.measured else F.lit(0)).alias("bad_measure"),
        ).first()
        found = [Issue("error", "non_finite", f"{row[f'bad_{c}']} values of {c} are not finite") for c in axes if row[f"bad_{c}"]]
        if row["ids"] < row["n"]:
            found.append(Issue("error", "duplicate_ids", f"{row['n'] - row['ids']} ids repeat or are missing"))
        if row["bad_measure"]:
            found.append(Issue("error", "measure", f"{row['bad_measure']} measures are not positive"))
        return Report(tuple(found))

    @classmethod
    def points(cls, df: DataFrame, coords: Sequence[str], *, support_id: str, time: str | None = None, measure: str | None = None, domain: TimeDomain | None = None, names: Sequence[str] | None = None) -> Support:
        axes = tuple(names or names_of(len(coords)))
        cols = [F.col(c).cast("double").alias(n) for c, n in zip(coords, axes, strict=True)]
        if time is not None:
            domain = domain or LinearTime()
            cols.append(domain.canonical(F.col(time)).alias("time"))
        if measure is not None:
            cols.append(F.col(measure).cast("double").alias("measure"))
        return cls(df.select(F.col(support_id).alias("support_id"), *cols), axes, domain=domain)

    @classmethod
    def grid(cls, spark: SparkSession, bounds: tuple[float, float, float, float], resolution: float | tuple[float, float], crs: str | None = None) -> Support:
        """Cell centres over (x_min, y_min, x_max, y_max), row by row, x fastest; the last cell of an axis keeps the remainder."""
        x0, y0, x1, y1 = map(float, bounds)
        dx, dy = (resolution, resolution) if isinstance(resolution, (int, float)) else resolution
        xs, ys = axis_cells(spark, x0, x1, float(dx), "x", close=True), axis_cells(spark, y0, y1, float(dy), "y", close=True)
        nx, ny = axis_count(x0, x1, float(dx), close=True), axis_count(y0, y1, float(dy), close=True)
        df = ys.crossJoin(xs).select(
            (F.col("y_index") * nx + F.col("x_index")).alias("support_id"), "x", "y", (F.col("x_width") * F.col("y_width")).alias("measure")
        )
        return cls(df, ("x", "y"), (ny, nx), crs)

    def over_time(self, spark: SparkSession, step: float, *, domain: TimeDomain | None = None, bounds: tuple[float, float] | None = None) -> Support:
        """A grid times time cells, time slowest. A cyclic domain defaults to one period."""
        domain = domain or LinearTime()
        if bounds is None:
            if domain.period is None:
                raise ValueError("linear time needs bounds")
            bounds = (domain.origin, domain.origin + domain.period)
        elif domain.period is not None and not math.isclose(bounds[1] - bounds[0], domain.period, rel_tol=1e-12, abs_tol=1e-12):
            raise ValueError("cyclic time cells must span one period")
        cells = axis_cells(spark, *map(float, bounds), float(step), "time")
        size = math.prod(self.shape) if self.shape else self.df.count()
        df = cells.crossJoin(self.df).select(
            (F.col("time_index") * size + F.col("support_id")).alias("support_id"),
            *self.coords,
            "time",
            (F.col("measure") * F.col("time_width")).alias("measure"),
        )
        return Support(df, self.coords, (axis_count(*map(float, bounds), float(step)), *(self.shape or ())), self.crs, self.unit, domain)


def _cut(ring, axis: int, at: float, side: int):
    """The part of a ring on one side of an axis-parallel line: at or above it (1), or at or below it (-1)."""
    out = []
    for p, q in zip(ring, (*ring[1:], *ring[:1]), strict=True):
        a, b = side * (p[axis] - at), side * (q[axis] - at)
        if a >= 0:
            out.append(p)
        if (a > 0 > b) or (a < 0 < b):
            t = a / (a - b)
            out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return out


def _moments(ring) -> tuple[float, float, float]:
    """Signed area of a ring and its first moments."""
    area = mx = my = 0.0
    for p, q in zip(ring, (*ring[1:], *ring[:1]), strict=True):
        cross = p[0] * q[1] - q[0] * p[1]
        area, mx, my = area + cross / 2, mx + (p[0] + q[0]) * cross / 6, my + (p[1] + q[1]) * cross / 6
    return area, mx, my


def axis_count(low: float, high: float, step: float, close: bool = False) -> int:
    """Cells of an axis: whole steps, and one more for a remainder. A remainder is none if the last whole step ends within 1e-12
    (or 1e-12 of the bound) of the bound; on axes of space (close), within 1e-8 and 1e-5 of the bound."""
    if not (math.isfinite(low) and math.isfinite(high) and high > low and step > 0):
        raise ValueError("an axis needs finite bounds in order and a positive step")
    whole = math.floor((high - low) / step)
    last = low + whole * step
    done = abs(last - high) <= 1e-8 + 1e-5 * abs(high) if close else last >= high - max(1e-12, abs(high) * 1e-12)
    return max(1, whole + (not done))


def axis_cells(spark: SparkSession, low: float, high: float, step: float, name: str, close: bool = False) -> DataFrame:
    """(name_index, name, name_width): cell centres and widths along one axis."""
    n = axis_count(low, high, step, close)
    start = F.lit(low) + F.col("id") * step
    end = F.when(F.col("id") == n - 1, F.lit(high)).otherwise(F.lit(low) + (F.col("id") + 1) * step)
    return spark.range(n).select(F.col("id").alias(f"{name}_index"), ((start + end) / 2).alias(name), (end - start).alias(f"{name}_width"))


MANY_EDGES = 64  # beyond them, a boundary is an index in the tasks instead of a term for each edge


@dataclass(frozen=True)
class Boundary:
    """A polygon, or several: rings of (x, y); holes are further rings of the same polygon. Points on an edge are inside. Polygons may
    overlap: the boundary is what any of them covers."""

    polygons: tuple[tuple[tuple[tuple[float, float], ...], ...], ...]

    @functools.cached_property
    def dissolved(self) -> Boundary:
        """The same area as polygons without common area."""
        return self if len(self.polygons) == 1 else Boundary(polygons.union(self.polygons))

    @functools.cached_property
    def _index(self) -> polygons.Edges:
        return polygons.Edges(self.polygons)

    @classmethod
    def rectangle(cls, bounds: tuple[float, float, float, float]) -> Boundary:
        x0, y0, x1, y1 = map(float, bounds)
        if x1 <= x0 or y1 <= y0:
            raise ValueError("a boundary needs a positive area")
        return cls(((((x0, y0), (x1, y0), (x1, y1), (x0, y1)),),))

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        pts = [p for polygon in self.polygons for ring in polygon for p in ring]
        return min(p[0] for p in pts), min(p[1] for p in pts), max(p[0] for p in pts), max(p[1] for p in pts)

    def is_rectangle(self) -> bool:
        if len(self.polygons) != 1 or len(self.polygons[0]) != 1:
            return False
        x0, y0, x1, y1 = self.bounds
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in self._edges())) / 2
        return abs(area - (x1 - x0) * (y1 - y0)) <= 1e-12 * max(1.0, area)

    def _edges(self, polygon: tuple | None = None):
        for rings in self.polygons if polygon is None else (polygon,):
            for ring in rings:
                yield from zip(ring, (*ring[1:], ring[0]), strict=True)

    def _asked(self, index: polygons.Edges, question: str, kind: str, x: Column, y: Column) -> Column:
        """A question to an index of edges, which goes to the tasks with the plan: it is as large as the boundary."""

        def run(px: pa.Array, py: pa.Array) -> pa.Array:
            at = (np.asarray(c.to_numpy(zero_copy_only=False), dtype=float) for c in (px, py))
            return pa.array(getattr(index, question)(*at))

        return F.arrow_udf(run, kind)(x.cast("double"), y.cast("double"))

    def covers(self, x: Column, y: Column) -> Column:
        """Whether a point is inside or on the boundary."""
        if self.is_rectangle():
            x0, y0, x1, y1 = self.bounds
            return x.between(x0, x1) & y.between(y0, y1)
        if sum(1 for _ in self._edges()) > MANY_EDGES:
            return self._asked(self._index, "covers", "boolean", x, y)
        found = F.lit(False)
        for polygon in self.polygons:
            crossings = F.lit(0)
            for (ax, ay), (bx, by) in self._edges(polygon):
                if ay != by:
                    at = (bx - ax) * (y - ay) / (by - ay) + ax
                    crossings = crossings + (((F.lit(ay) > y) != (F.lit(by) > y)) & (x < at)).cast("int")
                cross = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
                found = found | ((cross == 0) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)))
            found = found | (crossings % 2 == 1)
        return found

    def edge_distance(self, x: Column, y: Column) -> Column:
        """Distance of a point to the nearest edge of the dissolved boundary."""
        found, edges = [], list(self.dissolved._edges())
        if len(edges) > MANY_EDGES:
            return self._asked(self.dissolved._index, "distance", "double", x, y)
        for (ax, ay), (bx, by) in edges:
            dx, dy = bx - ax, by - ay
            length = dx * dx + dy * dy
            t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / length)) if length else F.lit(0.0)
            found.append(F.sqrt((x - ax - t * dx) * (x - ax - t * dx) + (y - ay - t * dy) * (y - ay - t * dy)))
        return F.least(*found) if len(found) > 1 else found[0]

    def clipped_cells(self, n: int) -> list[tuple[float, float, float]]:
        """(x, y, area) of the parts of an n x n grid over the bounds that lie inside: centroids and areas, holes taken out.

        Rings are cut to the columns, then to the cells, on the driver; there are at most n * n parts.
        """
        x0, y0, x1, y1 = self.bounds
        found = []
        for i in range(n):
            left, right = x0 + (x1 - x0) * i / n, x0 + (x1 - x0) * (i + 1) / n
            strips = [[_cut(_cut(ring, 0, left, 1), 0, right, -1) for ring in polygon] for polygon in self.dissolved.polygons]
            for j in range(n):
                low, high = y0 + (y1 - y0) * j / n, y0 + (y1 - y0) * (j + 1) / n
                area = mx = my = 0.0
                for polygon in strips:
                    for k, ring in enumerate(polygon):
                        a, bx, by = _moments(_cut(_cut(ring, 1, low, 1), 1, high, -1))
                        sign = (1 if a >= 0 else -1) * (1 if k == 0 else -1)
                        area, mx, my = area + sign * a, mx + sign * bx, my + sign * by
                if area > 1e-15:
                    found.append((mx / area, my / area, area))
        return found

    def outside(self, df: DataFrame, x: str = "x", y: str = "y") -> int:
        return df.where(~self.covers(F.col(x), F.col(y))).count()

    def report(self, df: DataFrame, x: str = "x", y: str = "y") -> Report:
        n = self.outside(df, x, y)
        return Report((Issue("warning", "outside_boundary", f"{n} points lie outside"),) if n else ())
