"""Exact quantiles without a task that holds all values, and quantiles of pair distances without all pairs.

A band is kept around each wanted rank. A pass over values counts 1,024 bins of each band and leaves the bin of the rank as the new
band, until few different values are left. Distances between places begin with cells: the least and the greatest distance of a pair of cells,
with the pairs of events in it, bound the order statistics from both sides, so pairs of cells off all bands are counted and never opened;
the others are split into the pairs of their halves, and only small ones that still meet a band are opened into pairs of places. On a line
no pairs of places are made: tasks hold the places of two cells in order, and count the pairs up to a distance by searching.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from fieldloom.functions.kernels import squared_distance
from fieldloom.plans.lineage import cut

BINS = 1024
FEW = 10_000  # different values of a band that the driver sorts
LEAF = 1 << 16  # pairs of places of a pair of cells that is not split further
RUNS = 1 << 22  # the same on a line, where the pairs are counted and not made
CUTS = 64  # distances up to which a pass counts, for each rank
WORK = 1 << 20  # pairs of places that are opened rather than split once more
LEVELS = 30  # halvings of an axis
TINY, HUGE = 1e-130, 1e150  # between them differences have squares that neither vanish nor overflow


@dataclass
class Band:
    """Two neighbouring ranks (from 0, or the same), and bounds of the values there. below: events or pairs known to lie under the band
    that are not among the rows any more."""

    position: float
    low: float
    high: float
    below: int = 0
    values: tuple[float, float] | None = None

    @property
    def ranks(self) -> tuple[int, int]:
        return math.floor(self.position), math.ceil(self.position)

    @property
    def quantile(self) -> float:
        (first, last), (a, b) = self.ranks, self.values
        return a if first == last or a == b else (last - self.position) * a + (self.position - first) * b


def _bands(shares: Sequence[float], n: int, low: float, high: float) -> list[Band]:
    return [Band(float(n - 1) * p, low, high) for p in shares]


def _bin(value: Column, band: Band) -> Column:
    """-1 below the band, BINS above it, else in order from 0."""
    width = band.high - band.low
    inside = F.least(F.lit(BINS - 1), F.floor((value - band.low) / width * BINS)).cast("int") if width > 0 else F.lit(0)
    return F.when(value < band.low, -1).when(value > band.high, BINS).otherwise(inside)


def _histograms(rows: DataFrame, bands: Sequence[Band], *values: str) -> list[list[list[Row]]]:
    """For each value column and band the bins in order, with the sum of n, the rows, and the least and greatest value."""
    spots = [F.struct(F.lit(k).alias("column"), F.lit(i).alias("band"), _bin(F.col(v), b).alias("bin"), F.col(v).alias("v")) for k, v in enumerate(values) for i, b in enumerate(bands)]
    spread = rows.select("n", F.explode(F.array(*spots)).alias("at")).groupBy("at.column", "at.band", "at.bin")
    found = spread.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("at.v").alias("least"), F.max("at.v").alias("most")).collect()  # BINS + 2 rows a band
    pick = lambda k, i: sorted((r for r in found if (r.column, r.band) == (k, i)), key=lambda r: r.bin)
    return [[pick(k, i) for i in range(len(bands))] for k in range(len(values))]


def _at(bins: list[Row], rank: int) -> Row:
    """The bin that holds the rank, counted among these rows."""
    seen = 0
    for r in bins:
        seen += r.n
        if rank < seen:
            return r
    raise ValueError("rows changed between passes")


def _settle(rows: DataFrame, bands: Sequence[Band]) -> list[float]:
    """The quantiles of all bands from rows (value, n), read once a pass."""
    while open_bands := [b for b in bands if b.values is None]:
        small = True
        for b, bins in zip(open_bands, _histograms(rows, open_bands, "value")[0], strict=True):
            first, last = (_at(bins, rank - b.below) for rank in b.ranks)
            if first.bin != last.bin:  # neighbours with nothing between them
                b.values = first.most, last.least
            elif first.least == first.most:
                b.values = first.least, first.least
            else:
                b.low, b.high, small = first.least, first.most, small and first.rows <= FEW
        left = [b for b in bands if b.values is None]
        if left and small:
            inside = reduce(lambda x, y: x | y, [F.col("value").between(b.low, b.high) for b in left])
            # rows below each band and the few rows of the bands
            under = rows.agg(*[F.sum(F.when(F.col("value") < b.low, F.col("n")).otherwise(0)).alias(f"b{i}") for i, b in enumerate(left)]).first()
            few = sorted(tuple(r) for r in rows.where(inside).groupBy("value").agg(F.sum("n").alias("n")).collect())
            for i, b in enumerate(left):
                seen, picked = b.below + under[f"b{i}"], []
                for v, n in few:
                    if b.low <= v <= b.high:
                        picked += [v for rank in b.ranks if seen <= rank < seen + n]
                        seen += n
                b.values = picked[0], picked[1]
    return [b.quantile for b in bands]


def quantiles(values: DataFrame, shares: Sequence[float]) -> list[float] | None:
    """Quantiles of the positive, finite values of the one column of values, each a straight line between neighbouring ranks, as percentile
    takes them; None if there are none. Nulls and NaN do not count. values is read several times and gives the same rows each time."""
    name = values.columns[0]
    rows = values.select(F.col(f"`{name}`").cast("double").alias("value"), F.lit(1).cast("long").alias("n")).where("value > 0 and value < double('infinity')")
    box = rows.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).first()
    return _settle(rows, _bands(shares, box["n"], box["low"], box["high"])) if box["n"] else None


def _keys(level: int, dim: int) -> Column:
    """The cell of a place after so many halvings of each axis."""
    return F.array(*[F.shiftright(f"k{i}", LEVELS - level) for i in range(dim)])


def _cells(places: DataFrame, level: int, above: int, dim: int) -> DataFrame:
    """(parent, cell, n, m, mm, lows, highs): places, events and squares of events of each cell, with the box that its places fill."""
    box = [f(f"c{i}").alias(f"{name}{i}") for i in range(dim) for name, f in (("low", F.min), ("high", F.max))]
    sums = [F.count(F.lit(1)).alias("n"), F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("mm")]
    return places.groupBy(_keys(above, dim).alias("parent"), _keys(level, dim).alias("cell")).agg(*sums, *box)


def _side(df: DataFrame, p: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])


def _cell_pairs(wanted: DataFrame, cells: DataFrame, level: int, dim: int) -> DataFrame:
    """The pairs of children of the wanted pairs (a, b) of cells, each once: (level, a, b, size, n, least, most)."""
    x, y = _side(cells, "x"), _side(cells, "y")
    both = wanted.join(x, F.col("a") == F.col("x_parent")).join(y, F.col("b") == F.col("y_parent"))
    both = both.where((F.col("a") != F.col("b")) | (F.col("x_cell") <= F.col("y_cell")))
    same, zero = F.col("x_cell") == F.col("y_cell"), [F.lit(0.0)] * dim
    gap = [F.greatest(F.lit(0.0), F.col(f"y_low{i}") - F.col(f"x_high{i}"), F.col(f"x_low{i}") - F.col(f"y_high{i}")) for i in range(dim)]
    span = [F.greatest(F.col(f"y_high{i}") - F.col(f"x_low{i}"), F.col(f"x_high{i}") - F.col(f"y_low{i}")) for i in range(dim)]
    # roundings keep order, so these bound the distances as they are computed, too
    return both.select(
        F.lit(level).alias("level"),
        F.col("x_cell").alias("a"),
        F.col("y_cell").alias("b"),
        (F.col("x_n") * F.col("y_n")).alias("size"),
        F.when(same, ((F.col("x_m") * F.col("x_m") - F.col("x_mm")) / 2).cast("long")).otherwise(F.col("x_m") * F.col("y_m")).alias("n"),
        F.sqrt(squared_distance(gap, zero)).alias("least"),
        F.sqrt(squared_distance(span, zero)).alias("most"),
    ).where("n > 0")


def _tighten(pairs: DataFrame, bands: Sequence[Band]) -> None:
    """The order statistics of least distances bound those of distances from below, those of greatest from above."""
    for b, least, most in zip(bands, *_histograms(pairs, bands, "least", "most"), strict=True):
        first, last = b.ranks
        b.low, b.high = max(b.low, _at(least, first - b.below).least), min(b.high, _at(most, last - b.below).most)


def _leaves(places: DataFrame, start: DataFrame, dim: int, bands: Sequence[Band]) -> DataFrame:
    """The pairs of cells that may hold a distance of a band and are not worth splitting: (level, a, b, ...). Narrows the bands, and
    counts below them what it leaves out."""
    level, step, wanted, leaves, leaf = 0, 8 // dim, start, None, RUNS if dim == 1 else LEAF
    while True:
        above, level = level, min(LEVELS, level + step)
        step = max(1, 4 // dim)
        pairs = cut(_cell_pairs(wanted.select("a", "b"), _cells(places, level, above, dim), level, dim))
        pairs = pairs if leaves is None else pairs.union(leaves)
        _tighten(pairs, bands)
        meets = reduce(lambda x, y: x | y, [(F.col("least") <= k.high) & (F.col("most") >= k.low) for k in bands])
        split = meets & (F.col("size") > leaf) & (F.col("level") == level) & F.lit(level < LEVELS)
        done = [F.sum(F.when(~meets & (F.col("most") < k.low), F.col("n")).otherwise(0)).alias(f"b{i}") for i, k in enumerate(bands)]
        counted = pairs.agg(*done, F.sum(F.when(meets, F.col("size"))).alias("open"), F.count_if(split).alias("more")).first()
        for i, k in enumerate(bands):
            k.below += counted[f"b{i}"]
        if not counted["more"] or counted["open"] <= WORK:
            return pairs.where(meets)
        leaves, wanted = pairs.where(meets & ~split), pairs.where(split)


def _reach(xs: np.ndarray, ys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For each x and cut, how many of the ys, which are in order and not below the xs, are at most so far away, by distances as Spark
    computes them: the search by sums may be off by roundings."""
    at = np.searchsorted(ys, xs[:, None] + cuts[None, :], side="right")
    far = lambda j: np.sqrt((xs[:, None] - ys[np.clip(j, 0, len(ys) - 1)]) ** 2)
    while (over := (at > 0) & (ys[np.clip(at - 1, 0, None)] >= xs[:, None]) & (far(at - 1) > cuts)).any():
        at -= over
    while (under := (at < len(ys)) & (far(at) <= cuts)).any():
        at += under
    return at


def _runs(table: pa.RecordBatch) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Each pair of cells: whether they are one, and the places and events of both."""
    for same, *sides in zip(*(table.column(i) for i in range(5)), strict=True):
        yield (same.as_py(), *(c.values.to_numpy(zero_copy_only=False) for c in sides))


def _counter(cuts: np.ndarray):
    """For each cut the pairs of events of a task that are at most so far apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(cuts), dtype=np.int64)
        for batch in batches:
            for same, xs, xm, ys, ym in _runs(batch):
                # below the first cut and from the last one on a pair of cells counts as a whole
                least, most = (0.0 if same else math.sqrt((xs[-1] - ys[0]) ** 2)), math.sqrt((xs[0] - ys[-1]) ** 2)
                held, own = np.r_[0, np.cumsum(ym)], np.cumsum(xm)
                first, last = np.searchsorted(cuts, least, side="left"), np.searchsorted(cuts, most, side="left")
                rest = xm.sum() * ym.sum() if not same else int((xm * (own[-1] - own)).sum())
                found[last:] += rest
                for i in range(0, len(xs), 1024):
                    if first == last:
                        break
                    seen = held[_reach(xs[i : i + 1024], ys, cuts[first:last])]
                    seen = seen - own[i : i + 1024, None] if same else seen
                    found[first:last] += (xm[i : i + 1024, None] * seen).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts))), pa.array(found)], ["cut", "n"])

    return run


def _between(spans: Sequence[tuple[float, float]]):
    """(span, value, n): the distances above the first and up to the second end of each span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, xs, xm, ys, ym in _runs(batch):
                for k, ends in enumerate(spans):
                    for i in range(0, len(xs), 1024):
                        a, m = xs[i : i + 1024], xm[i : i + 1024]
                        at = _reach(a, ys, np.array(ends))
                        at[:, 0] = np.maximum(at[:, 0], np.arange(i + 1, i + 1 + len(a))) if same else at[:, 0]
                        wide = np.maximum(at[:, 1] - at[:, 0], 0)
                        if wide.any():
                            x = np.repeat(np.arange(len(a)), wide)
                            y = np.arange(len(x)) - np.repeat(np.cumsum(wide) - wide, wide) + at[x, 0]
                            values, which = np.unique(np.sqrt((a[x] - ys[y]) ** 2), return_inverse=True)
                            n = np.zeros(len(values), dtype=np.int64)
                            np.add.at(n, which, m[x] * ym[y])
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), k)), pa.array(values), pa.array(n)], ["span", "value", "n"])

    return run


def _ranked(pairs: DataFrame, bands: Sequence[Band]) -> list[float]:
    """The quantiles of all bands from (same, xs, xm, ys, ym), the pairs of cells of a line with their places in order. A pass counts the pairs
    up to CUTS distances for each rank; the last one lists the few that are left."""
    spans = {(b.below, r): (math.nextafter(b.low, -math.inf), b.high, 0, None) for b in bands for r in b.ranks}  # above, up to, pairs up to either
    found: dict[tuple[int, int], float] = {}
    while True:
        wide = {k: s for k, s in spans.items() if math.nextafter(s[0], math.inf) < s[1] and (s[3] is None or s[3] - s[2] > FEW)}
        if not wide:
            break
        cuts = np.unique(np.concatenate([np.linspace(low, high, CUTS + 1) for low, high, *_ in wide.values()]))
        counted = pairs.mapInArrow(_counter(cuts), "cut long, n long").groupBy("cut").agg(F.sum("n").alias("n")).collect()  # the cuts
        upto = np.zeros(len(cuts), dtype=np.int64)
        upto[[r["cut"] for r in counted]] = [r["n"] for r in counted]
        for (below, rank), (low, *_) in wide.items():
            j = int(np.searchsorted(upto, rank - below, side="right"))
            if j == len(cuts):
                raise ValueError("rows changed between passes")
            spans[below, rank] = (float(cuts[j - 1]), float(cuts[j]), int(upto[j - 1]), int(upto[j])) if j else (low, float(cuts[0]), 0, int(upto[0]))
    listed = {}
    for k, (low, high, *_) in spans.items():
        if math.nextafter(low, math.inf) >= high:
            found[k] = high
        else:
            listed.setdefault((low, high), []).append(k)
    if listed:
        few = pairs.mapInArrow(_between(list(listed)), "span long, value double, n long").groupBy("span", "value").agg(F.sum("n").alias("n")).collect()  # FEW a span
        for i, (span, keys) in enumerate(listed.items()):
            mine = sorted((r["value"], r["n"]) for r in few if r["span"] == i)
            upto = np.cumsum([n for _, n in mine])
            for below, rank in keys:
                found[below, rank] = mine[int(np.searchsorted(upto, rank - below - spans[below, rank][2], side="right"))][0]
    for b in bands:
        b.values = tuple(found[b.below, r] for r in b.ranks)
    return [b.quantile for b in bands]


def pair_quantiles(rows: DataFrame, coords: Sequence[str], shares: Sequence[float]) -> list[float] | None:
    """Quantiles of the positive, finite distances between rows, each pair once; None if there are none. Rows that lack a finite
    coordinate have no such distance; rows of one place are counted together. In up to three dimensions pairs of cells are counted as a
    whole where they can be; above, and for coordinates whose squares leave the range of doubles, all pairs are computed."""
    dim, names = len(coords), [f"c{i}" for i in range(len(coords))]
    finite = reduce(lambda x, y: x & y, [(F.abs(c) < float("inf")) for c in names])
    places = rows.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(coords, names, strict=True)]).where(finite)
    places = cut(places.groupBy(*names).agg(F.count(F.lit(1)).alias("m")))
    odd = reduce(lambda x, y: x | y, [(F.abs(c) > HUGE) | ((F.abs(c) < TINY) & (F.col(c) != 0)) for c in names])
    box = places.agg(
        F.count(F.lit(1)).alias("places"), F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.count_if(odd).alias("odd"),
        *[f(c).alias(f"{k}{c}") for c in names for k, f in (("low_", F.min), ("high_", F.max))],
    ).first()
    if box["places"] < 2:
        return None
    a, b = _side(places, "x"), _side(places, "y")
    value = F.sqrt(squared_distance([F.col(f"x_{c}") for c in names], [F.col(f"y_{c}") for c in names]))
    one = F.struct(*[f"x_{c}" for c in names]) < F.struct(*[f"y_{c}" for c in names])
    if dim > 3 or box["odd"]:
        found = a.join(b, one).select(value.alias("value"), (F.col("x_m") * F.col("y_m")).alias("n")).where("value > 0 and value < double('infinity')")
        ends = found.agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).first()
        return _settle(found, _bands(shares, ends["n"], ends["low"], ends["high"])) if ends["n"] else None
    spans = [box[f"high_{c}"] - box[f"low_{c}"] for c in names]
    most = float(1 << LEVELS)
    key = lambda c, span: F.least(F.lit((1 << LEVELS) - 1), F.floor((F.col(c) - box[f"low_{c}"]) / span * most)) if span > 0 else F.lit(0)
    places = places.withColumns({f"k{i}": key(c, s).cast("long") for i, (c, s) in enumerate(zip(names, spans, strict=True))})
    total = (box["m"] * box["m"] - box["mm"]) // 2
    bands = _bands(shares, total, 0.0, math.sqrt(sum(s * s for s in spans)))
    root = F.array(*[F.lit(0).cast("long")] * dim)
    start = rows.sparkSession.range(1).select(F.lit(0).alias("level"), root.alias("a"), root.alias("b"))
    leaves = start if box["places"] ** 2 <= WORK else _leaves(places, start, dim, bands)
    used = [r["level"] for r in leaves.select("level").distinct().collect()]  # LEVELS + 1 at most
    keyed = places.select("*", F.explode(F.array(*[F.struct(F.lit(u).alias("level"), _keys(u, dim).alias("cell")) for u in used or [0]])).alias("at"))
    keyed = keyed.select("at.level", "at.cell", "m", *names)
    if dim == 1:
        runs = keyed.groupBy("level", "cell").agg(F.sort_array(F.collect_list(F.struct("c0", "m"))).alias("run"))
        runs = runs.select("level", "cell", F.col("run.c0").alias("at"), F.col("run.m").alias("m"))
        x, y = _side(runs, "x"), _side(runs, "y")
        held = leaves.select("level", "a", "b").join(x, (F.col("level") == F.col("x_level")) & (F.col("a") == F.col("x_cell")))
        held = held.join(y, (F.col("level") == F.col("y_level")) & (F.col("b") == F.col("y_cell")))
        held = held.select((F.col("a") == F.col("b")).alias("same"), "x_at", "x_m", "y_at", "y_m")
        return _ranked(cut(held.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)), bands)  # few bytes, much work: to all tasks
    x, y = _side(keyed, "x"), _side(keyed, "y")
    opened = leaves.select("level", "a", "b").join(x, (F.col("level") == F.col("x_level")) & (F.col("a") == F.col("x_cell")))
    opened = opened.join(y, (F.col("level") == F.col("y_level")) & (F.col("b") == F.col("y_cell"))).where((F.col("a") != F.col("b")) | one)
    return _settle(opened.select(value.alias("value"), (F.col("x_m") * F.col("y_m")).alias("n")), bands)
