"""Kernel sums along networks without pairs of places.

Each edge is cut into tiles a little wider than the kernel's reach. A tile gets its targets, the sources on it and beside it, and the sources of
other edges that come in by an end of the edge, each with what it takes to that end and the offset up to which that end is its shorter
way. Compact kernels that are polynomials of the distance are then sums of powers of the offsets over runs of ordered sources: two
searches for a target and a bandwidth, so work grows with places and not with their pairs. A factor of time comes in
by the different times of the sources, as long as a tile has few. Other kernels, and tiles with more times,
are summed over all pairs of a tile, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.kernels import Kernel, get_kernel

POWERS = {"epanechnikov": (0.75, 0.0, -0.75), "quartic": (0.9375, 0.0, -1.875, 0.0, 0.9375), "triangular": (1.0, -1.0)}  # of the scaled distance, in one dimension
FEW, TIMES = 16, 256  # sources of a run that are summed one by one; different times of a tile
BLOCK, MOST = 1 << 21, 1 << 21  # pairs held at once; sources of a tile in one group


def tiled(s: DataFrame, t: DataFrame | None, ways: DataFrame, reach: float) -> tuple[DataFrame, int]:
    """The rows of tiles and how many groups a tile has, for network_sums: s (source, es, p, a, b, length, w, time) with what it takes to either end, targets t (target, et, q, length) or, for
    None, the sources themselves, and the ways between the ends of edges."""
    width = reach * (1 + 1e-9)
    of = lambda c: F.floor(c / width).cast("long")
    none, kind = F.lit(None), dict(s.dtypes)["source"] if t is None else dict(t.dtypes)["target"]
    own = ways.where("es = et").select("es", "uv")
    far = F.lit(float("inf"))
    # along its own edge a place goes straight, or round by the ends where these are nearer to one another than the edge is long
    o = s.join(F.broadcast(own), "es", "left").withColumn("k", of(F.col("p")))
    o = o.withColumn("turn", F.when(F.col("uv") < F.col("length") * (1 - 1e-12), (F.col("length") + F.col("uv")) / 2).otherwise(far))
    beside = F.filter(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1), lambda i: i.between(F.lit(0), of(F.col("length"))))
    home, named = F.col("tile") == F.col("k"), F.col("source") if t is None else none.cast(kind)
    rows = o.withColumn("tile", F.explode(beside)).select(
        F.col("es").alias("et"), "tile", F.lit(1).alias("kind"), named.alias("id"), F.col("p").alias("x"), F.col("turn").alias("y"), "w", "time", home.alias("home"), "length", "source"
    )
    round_ = o.where((F.col("turn") < far) & (F.col("uv") <= reach)).select("source", F.col("es").alias("et"), F.col("length").alias("size"), "w", "time", (F.col("b") + F.col("uv")).alias("alpha"), (F.col("a") + F.col("uv")).alias("beta"), (F.col("p") - F.col("turn")).alias("until"), (F.col("p") + F.col("turn")).alias("after"))
    sizes = (s.select(F.col("es").alias("et"), F.col("length").alias("size")) if t is None else t.select("et", F.col("length").alias("size"))).distinct()
    by = ways.where("es <> et").join(sizes, "et")
    # what it takes to the ends of the other edge, and the offset up to which u is the shorter way
    m = s.join(F.broadcast(by), "es").withColumn("alpha", F.least(F.col("a") + F.col("uu"), F.col("b") + F.col("vu"))).withColumn("beta", F.least(F.col("a") + F.col("uv"), F.col("b") + F.col("vv")))
    turn = F.when(F.col("alpha").isNull(), -far).when(F.col("beta").isNull(), far).otherwise((F.col("beta") - F.col("alpha") + F.col("size")) / 2)
    m = m.select("source", "et", "size", "w", "time", "alpha", "beta", turn.alias("until"), turn.alias("after")).union(round_)
    rest = ["w", "time", F.lit(True).alias("home"), F.col("size").alias("length"), "source"]
    u = m.where((F.col("alpha") <= reach) & (F.col("until") >= 0))
    rows = rows.union(u.select("et", F.lit(0).cast("long").alias("tile"), F.lit(2).alias("kind"), none.cast(kind).alias("id"), F.col("alpha").alias("x"), F.col("until").alias("y"), *rest))
    start = F.greatest(F.lit(0.0), F.col("after"), F.col("size") - (reach - F.col("beta")))
    v = m.where((F.col("beta") <= reach) & (F.col("after") < F.col("size"))).withColumn("tile", F.explode(F.sequence(of(start), F.greatest(of(start), of(F.col("size"))))))
    rows = rows.union(v.select("et", "tile", F.lit(3).alias("kind"), none.cast(kind).alias("id"), F.col("beta").alias("x"), F.col("after").alias("y"), *rest))
    # a crowded tile deals its sources to several groups, which all get its targets
    top = rows.groupBy("et", "tile").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    parts = max(1, math.ceil(top / MOST))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("source"), F.lit(parts)).cast("int")).withColumn("mine", F.lit(True)).drop("source")
    if t is None:
        if parts > 1:  # the targets of the other parts, which are no sources there
            again = rows.where("kind = 1 and home").withColumn("mine", F.lit(False)).withColumn("from", F.col("part")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
            rows = rows.union(again.where("part <> from").drop("from"))
        return rows, parts
    rows = rows.union(
        t.select(
            "et", of(F.col("q")).alias("tile"), F.lit(0).alias("kind"), F.col("target").alias("id"), F.col("q").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("w"), none.cast("double").alias("time"),
            F.lit(True).alias("home"), "length", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("mine"),
        )
    )
    return rows, parts


class _Runs:
    """Sums of c(|x - p|) w over runs of ordered sources, from running sums of powers."""

    def __init__(self, p: np.ndarray, powers: Sequence[float], h: float):
        self.p, self.h, self.c = p / h, h, powers
        self.held = [(-self.p) ** r for r in range(len(powers))]

    def sums(self, x: np.ndarray, low: np.ndarray, high: np.ndarray, w: np.ndarray, sign: int) -> np.ndarray:
        """For each x the sum over sources low to high (excluded), d = sign * (x - p)."""
        x, m = x / self.h, len(self.c)
        run = [np.concatenate(([0.0], np.cumsum(w * g))) for g in self.held]
        run = [g[high] - g[low] for g in run]
        out = np.zeros(len(x))
        for k in range(m):
            if self.c[k]:
                out += self.c[k] * sign**k * sum(math.comb(k, r) * x ** (k - r) * run[r] for r in range(k + 1))
        few = np.flatnonzero(high - low <= FEW)
        exact = np.zeros(len(few))
        for j in range(FEW):
            at = low[few] + j
            there = at < high[few]
            d = sign * (x[few[there]] - self.p[at[there]])
            exact[there] += w[at[there]] * sum(c * d**k for k, c in enumerate(self.c))
        out[few] = exact
        return np.maximum(out, 0) / self.h


def _sums(kernel: Kernel, hs: Sequence[float], clock: Callable[[np.ndarray], np.ndarray] | None, kind: pa.DataType):
    """Tiles to (id, w, s): s has a sum for each bandwidth and, with a clock, each bandwidth of time. The clock takes gaps of time to (bandwidths of time, ...)."""
    powers = POWERS.get(kernel.name) if kernel is get_kernel(kernel.name) else None

    def run(table: pa.Table) -> pa.Table:
        get = lambda c: table.column(c).to_numpy()
        order = np.argsort(get("x"), kind="stable")
        k, x, y, w, home, mine = (get(c)[order] for c in ("kind", "x", "y", "w", "home", "mine"))
        time = get("time")[order].astype(float) if clock else np.zeros(len(x))
        length = float(get("length")[0])
        loo = not (k == 0).any()
        goal = np.flatnonzero((k == 1) & home if loo else k == 0)
        own = np.flatnonzero((k == 1) & mine)
        q, n_t = x[goal], len(clock(np.zeros(1))) if clock else 1
        out = np.zeros((len(goal), len(hs) * n_t))
        ends = [np.flatnonzero(k == 2), np.flatnonzero(k == 3)]
        held = np.concatenate([own, *ends])
        times, of = np.unique(time[held], return_inverse=True)
        moment = np.full(len(x), -1)
        moment[held] = of
        if powers is None or len(times) > TIMES:
            _blocks(kernel, hs, clock, n_t, length, (q, time[goal], goal), (x, y, w, time), own, ends, loo, out)
        elif len(goal) and len(held):
            factor = clock(time[goal][:, None] - times[None, :]) if clock else np.ones((1, len(goal), 1))
            p, turn = x[own], y[own]
            left = right = np.searchsorted(own, goal)  # sources before the target in the order
            if loo:
                right = left + np.isin(goal, own)
            for i, h in enumerate(hs):
                cut = h * kernel.reach
                (u, v), runs = ends, []
                runs.append((_Runs(p, powers, h), q, np.clip(np.searchsorted(p, q - cut, "left"), np.searchsorted(p + turn, q, "left"), None).clip(None, left), left, own, 1))
                runs.append((_Runs(p, powers, h), q, right, np.minimum(np.searchsorted(p, q + cut, "right"), np.searchsorted(p - turn, q, "left") if np.isfinite(turn).all() else len(p)).clip(right), own, -1))
                top = np.minimum(y[u], cut - x[u])
                u, top = u[np.argsort(top, kind="stable")], np.sort(top)
                runs.append((_Runs(-x[u], powers, h), q, np.searchsorted(top, q, "left"), np.full(len(q), len(u)), u, 1))
                low = np.maximum(y[v], length - cut + x[v])
                v, low = v[np.argsort(low, kind="stable")], np.sort(low)
                runs.append((_Runs(-x[v], powers, h), length - q, np.zeros(len(q), int), np.searchsorted(low, q, "left"), v, 1))
                for r, at, a, b, who, sign in runs:
                    if not len(who):
                        continue
                    for j in range(len(times)):
                        s = r.sums(at, a, b, np.where(moment[who] == j, w[who], 0.0) if len(times) > 1 else w[who], sign)
                        for g in range(n_t):
                            out[:, i * n_t + g] += s * factor[g, :, j]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(goal) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
        ids = table.column("id").combine_chunks().take(pa.array(order[goal])).cast(kind)
        return pa.table({"id": ids, "w": pa.array(np.where(mine[goal], w[goal], 0.0)), "s": lists})

    return run


def _blocks(kernel, hs, clock, n_t, length, targets, places, own, ends, loo, out) -> None:
    """All pairs of a tile, block by block."""
    (q, when, goal), (x, y, w, time) = targets, places
    for which, some in enumerate((own, *ends)):
        step = max(1, BLOCK // max(1, min(len(q), 4096)))
        for a in range(0, len(q), 4096):
            t = slice(a, a + 4096)
            for b in range(0, len(some), step):
                j = some[b : b + step]
                at = q[t][:, None]
                if which == 0:
                    d = np.abs(at - x[j])
                    straight = (at > x[j] - y[j]) & (at <= x[j] + y[j])
                    weight = np.where(~straight | (loo & (goal[t][:, None] == j)), 0.0, w[j])
                else:
                    d = at + x[j] if which == 1 else length - at + x[j]
                    weight = np.where((at <= y[j]) == (which == 1), w[j], 0.0)
                time_factor = clock(when[t][:, None] - time[j]) if clock else [1.0]
                for i, h in enumerate(hs):
                    k = kernel.scaled_array(d * d, h, 1) * weight
                    for g in range(n_t):
                        out[t, i * n_t + g] += (k * time_factor[g]).sum(axis=1)


def network_sums(rows: DataFrame, parts: int, kernel: Kernel, hs: Sequence[float], clock: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(id, w, s) for every target of tiled rows: s lists the sums of w K(d / h) / h over the sources within reach, other than itself."""
    kind = dict(rows.dtypes)["id"]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)
    if arrow is None:
        raise ValueError("ids are integers or strings")
    found = rows.groupBy("et", "tile", "part").applyInArrow(_sums(kernel, tuple(hs), clock, arrow), f"id {kind}, w double, s array<double>")
    if parts == 1:
        return found
    n = len(hs) * (len(clock(np.zeros(1))) if clock else 1)
    return found.groupBy("id").agg(F.max("w").alias("w"), F.array(*[F.sum(F.col("s")[i]) for i in range(n)]).alias("s"))
