"""Gaussian sums over all pairs by cells, so that work grows with the rows and not with their pairs.

Each axis is cut into cells two bandwidths wide. The kernel between two cells is interpolated at Chebyshev nodes of both: sources
give their weights to the nodes of their cell, nodes of cells in reach meet, and targets read the nodes of their cell. With 20 nodes an axis
a kernel of peak one is met within 1e-14, and beyond REACH bandwidths it is below 1e-21. Where a sum is so small beside the weight in reach that this
shows, which takes a row apart from all others, the sum is taken again over all sources.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from fieldloom.plans.lineage import cut

P, REACH = 20, 10.0
CELLS_BYTES = 64 << 20  # bytes of all cells that are sent to every task
ROWS = 20_000  # with fewer rows all pairs are quick
_HELD = 1 << 16
_TURN = np.pi * (2 * np.arange(P) + 1) / (2 * P)
_NODES = np.cos(_TURN)
_LAGRANGE = 2 / P * np.cos(np.arange(P)[:, None] * _TURN[None, :])
_LAGRANGE[0] = 1 / P
_CELL = "k int, c0 long, c1 long, held double, nodes array<double>"
_NAMES = ["k", "c0", "c1", "held", "nodes"]
#: A sum: for each of its one or two axes the target's column, the source's column and the bandwidth.
Axes = Sequence[tuple[str, str, float]]


def _cell_and_basis(x: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray]:
    """The cells of values and the values of the cell's interpolation polynomials there."""
    cell = np.floor(x / (2 * h))
    u = np.clip((x - (cell + 0.5) * 2 * h) / h, -1.0, 1.0)
    return cell.astype(np.int64), np.cos(np.arccos(u)[:, None] * np.arange(P)[None, :]) @ _LAGRANGE


def _at(columns: dict[str, np.ndarray], axes: Axes, side: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Cells (rows by two, the second 0 with one axis) and the bases of all axes."""
    found = [_cell_and_basis(columns[a[side]], a[2]) for a in axes]
    cells = [c for c, _ in found]
    return np.stack([*cells, *([np.zeros_like(cells[0])] * (2 - len(cells)))], axis=1), [b for _, b in found]


def _groups(cells: np.ndarray) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """Each cell with the rows in it."""
    order = np.lexsort((cells[:, 1], cells[:, 0]))
    c = cells[order]
    starts = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]).any(axis=1)])
    for a, b in zip(starts, np.r_[starts[1:], len(c)], strict=True):
        yield (int(c[a, 0]), int(c[a, 1])), order[a:b]


def _rows(found: dict) -> pa.RecordBatch:
    keys = list(found)
    return pa.RecordBatch.from_arrays(
        [*(pa.array([key[i] for key in keys], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))),
         pa.array([found[key][0] for key in keys], pa.float64()), pa.array([found[key][1] for key in keys], pa.list_(pa.float64()))], _NAMES,
    )


def _add(into: dict, key: tuple[int, int, int], held: float, nodes: np.ndarray) -> None:
    if key in into:
        into[key][0] += held
        into[key][1] += nodes
    else:
        into[key] = [held, nodes]


def _numbers(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}


def _give(sums: Sequence[Axes], weight: str):
    """Sources to the nodes of their cells: one row for each cell that a task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}

        def take(rows: list[dict[str, np.ndarray]]) -> None:
            columns = {n: np.concatenate([r[n] for r in rows]) for n in rows[0]}
            for k, axes in enumerate(sums):
                cells, bases = _at(columns, axes, 1)
                bases[0] = bases[0] * columns[weight][:, None]
                for cell, at in _groups(cells):
                    nodes = bases[0][at].sum(axis=0) if len(axes) == 1 else (bases[0][at].T @ bases[1][at]).ravel()
                    _add(found, (k, *cell), float(columns[weight][at].sum()), nodes)

        waiting, size = [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(_numbers(batch))
                size += batch.num_rows
            if size >= _HELD:
                take(waiting)
                waiting, size = [], 0
        if waiting:
            take(waiting)
        keys = list(found)
        for i in range(0, len(keys), 1024):
            yield _rows({key: found[key] for key in keys[i : i + 1024]})

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one cell, which lie in one partition, added up."""
    found: dict = {}
    for batch in batches:
        for k, a, b, held, nodes in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
            _add(found, (k, a, b), held, np.array(nodes.values.to_numpy(zero_copy_only=False), dtype=float))
    keys = list(found)
    for i in range(0, len(keys), 1024):
        yield _rows({key: found[key] for key in keys[i : i + 1024]})


def _table(cells: pa.Table, sums: Sequence[Axes]) -> list[tuple[dict, np.ndarray, np.ndarray]]:
    """For each sum: the place of each cell, the weights and the nodes."""
    out = []
    k = cells.column("k").to_numpy()
    for i, axes in enumerate(sums):
        mine = cells.filter(pa.array(k == i)).combine_chunks()
        place = {c: j for j, c in enumerate(zip(mine.column("c0").to_pylist(), mine.column("c1").to_pylist(), strict=True))}
        nodes = mine.column("nodes").combine_chunks()
        flat = nodes.values.to_numpy(zero_copy_only=False) if len(place) else np.zeros(0)
        out.append((place, mine.column("held").to_numpy(), flat.reshape(len(place), *([P] * len(axes)))))
    return out


def _meet(shared, axes_of: Sequence[int]):
    """The nodes of each target cell from those of all source cells in reach."""
    most = int(np.ceil(REACH / 2)) + 1
    between = {d: np.exp(-0.5 * (_NODES[:, None] - _NODES[None, :] + 2.0 * d) ** 2) for d in range(-most, most + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict = {}
            for k, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                place, held, nodes = shared.value[k]
                total, out = 0.0, np.zeros([P] * axes_of[k])
                for d in itertools.product(range(-most, most + 1), repeat=axes_of[k]):
                    j = place.get((a - d[0], b - d[1] if len(d) > 1 else 0))
                    if j is not None:
                        total += held[j]
                        one = between[d[0]] @ nodes[j]
                        out += one if len(d) == 1 else one @ between[d[1]].T
                found[(k, a, b)] = [total, out.ravel()]
            if found:
                yield _rows(found)

    return run


def _cells_of(rows: DataFrame, sums: Sequence[Axes], side: int) -> DataFrame:
    """(k, c0, c1): the different cells of all sums."""
    at = lambda a: F.floor(F.col(a[side]) / (2 * a[2])).cast("long")
    one = [F.struct(F.lit(k).alias("k"), at(x[0]).alias("c0"), (at(x[1]) if len(x) > 1 else F.lit(0).cast("long")).alias("c1")) for k, x in enumerate(sums)]
    return rows.select(F.explode(F.array(*one)).alias("c")).select("c.*").distinct()


def box_of(columns: dict[str, str], weight: str) -> list[Column]:
    """Aggregates: the total weight, and the least and greatest value of each column (given by the name that sums know it by)."""
    return [F.sum(weight).alias("total"), *[f(c).alias(f"{p}_{n}") for n, c in columns.items() for p, f in (("a", F.min), ("b", F.max))]]


def _within(box: Row, sums: Sequence[Axes]) -> bool:
    """Whether all cells between the least and greatest sources (a_<column>, b_<column>) may be sent: then none need be counted."""
    most = lambda x: math.prod(box[f"b_{c}"] / (2 * h) - box[f"a_{c}"] / (2 * h) + 2 for _, c, h in x)
    return sum(most(x) * 8 * P ** len(x) for x in sums) <= CELLS_BYTES


def gauss_sums(targets: DataFrame, sources: DataFrame, key: Sequence[str], sums: Sequence[Axes], names: Sequence[str], weight: str, same: Row | None = None) -> DataFrame | None:
    """(key columns, names, held_<name>): for each sum the weighted exp(-d^2 / 2), d in bandwidths, over all sources, and the weight in reach. None
    where the cells are too many to send, as with rows that are spread thin. same: the targets are the sources, which lie within this box."""
    spark = targets.sparkSession
    size = lambda df: sum(r["n"] * 8 * P ** len(sums[r["k"]]) for r in df.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect())
    if same is None or not _within(same, sums):
        at = cut(_cells_of(targets, sums, 0)).repartition(spark.sparkContext.defaultParallelism)
        if max(size(at), size(_cells_of(sources, sums, 1))) > CELLS_BYTES:
            return None
    columns = sorted({a[1] for axes in sums for a in axes} | {weight})
    given = sources.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(_give(sums, weight), _CELL)
    tasks = spark.sparkContext.defaultParallelism
    merged = given.repartition(tasks, "k", "c0", "c1").mapInArrow(_merge, _CELL).toArrow()  # within CELLS_BYTES
    if same is not None:
        at = spark.createDataFrame(merged.select(["k", "c0", "c1"]))
    shared = spark.sparkContext.broadcast(_table(merged, sums))
    met = at.mapInArrow(_meet(shared, [len(x) for x in sums]), _CELL).toArrow()  # as many
    held = spark.sparkContext.broadcast(_table(met, sums))
    kinds = dict(targets.dtypes)
    out_names = [*names, *(f"held_{n}" for n in names)]
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), *(f"`{n}` double" for n in out_names)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                batch = whole.slice(i, 2048)
                columns = _numbers(batch.select([n for n in batch.schema.names if any(n == a[0] for x in sums for a in x)]))
                values, weights = [], []
                for axes, (place, total, nodes) in zip(sums, held.value, strict=True):
                    cells, bases = _at(columns, axes, 0)
                    where = np.empty(len(cells), dtype=np.int64)
                    for cell, rows in _groups(cells):
                        where[rows] = place[cell]
                    one = np.einsum("ia,ia->i", bases[0], nodes[where]) if len(axes) == 1 else np.einsum("ib,ib->i", np.matmul(bases[0][:, None, :], nodes[where])[:, 0], bases[1])
                    values.append(one)
                    weights.append(total[where])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), *map(pa.array, values + weights)], [*key, *out_names])

    return targets.mapInArrow(read, schema)


def event_sums(targets: DataFrame, sources: DataFrame, key: Sequence[str], sums: Sequence[Axes], scale: dict[str, float], own: str, weight: str, without: Sequence[bool], direct, box: Row | None = None) -> DataFrame | None:
    """(key columns, names of scale): sums at the sources themselves times their scale, less their own weight (column own of the key) where
    `without` says so. box: what box_of says of the sources, if known. Rows whose rest is too small to be told from rounding go to direct(targets), the scaled sum over all pairs."""
    names = list(scale)
    box = box or sources.agg(*box_of({a[1]: a[1] for axes in sums for a in axes}, weight)).first()
    total = float(box["total"] or 0.0)
    found = gauss_sums(targets, sources, key, sums, names, weight, box if total else None)
    if found is None:
        return None
    rest = {n: F.col(n) - F.col(own) if less else F.col(n) for n, less in zip(names, without, strict=True)}
    faint = F.lit(False)
    for n in names:
        faint = faint | ~(rest[n] > F.greatest(F.col(f"held_{n}") * 1e-7, F.lit(total * 1e-13)))
    # written, so that sums are read from their cells once
    seen = Observation()
    held = found.select(*key, *[(rest[n] * scale[n]).alias(n) for n in names], faint.alias("faint"))
    held = cut(held.observe(seen, F.count_if("faint").alias("n")))
    plain = held.where("not faint").select(*key, *names)
    if not seen.get["n"]:
        return plain
    again = direct(targets.join(cut(held.where("faint").select(*key)), list(key), "left_semi"))
    return None if again is None else plain.union(again.select(*key, *names))
