"""Sums over all pairs of targets and sources, block by block inside tasks, so that no table of pairs is ever made.

If the sources are small (a checked number of bytes) they are sent to every task, which adds up all of them for each of its
targets: no shuffle. If the targets are small, each task adds its sources into one row per target, and the rows of the tasks
are summed. If neither is small, the caller falls back on a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.plans.lineage import cut
from fieldloom.plans.pairs import small

CELLS = 1 << 21  # pairs held at once
BLOCK = 1 << 10  # vectors of a block
Columns = dict[str, np.ndarray]
#: Sums over the sources for each target; both come as columns.
PairSum = Callable[[Columns, Columns], Sequence[np.ndarray]]


def _columns(batch: pa.RecordBatch | pa.Table) -> Columns:
    return {n: batch.column(n).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(n).to_numpy() for n in batch.schema.names}


def _blocks(columns: Columns, size: int) -> Iterator[tuple[slice, Columns]]:
    n = len(next(iter(columns.values()))) if columns else 0
    for i in range(0, n, size):
        yield slice(i, i + size), {k: v[i : i + size] for k, v in columns.items()}


def _add(into: np.ndarray, targets: Columns, sources: Columns, fn: PairSum) -> None:
    """into: one row per sum, one column per target."""
    wide = max(1, min(1024, into.shape[1]))
    for at, t in _blocks(targets, wide):
        for _, s in _blocks(sources, max(1, CELLS // wide)):
            for row, part in zip(into, fn(t, s), strict=True):
                row[at] += part


def pair_sums(targets: DataFrame, sources: DataFrame, key: Sequence[str], fn: PairSum, names: Sequence[str]) -> DataFrame | None:
    """(key columns, names): the sums of each target; None if neither side is small. All columns but the key are numbers, and
    key columns are given to fn too."""
    spark = targets.sparkSession
    kinds = dict(targets.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), *(f"`{n}` double" for n in names)])
    if small(sources):
        shared = spark.sparkContext.broadcast(_columns(sources.toArrow()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = np.zeros((len(names), batch.num_rows))
                _add(found, _columns(batch), shared.value, fn)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), *map(pa.array, found)], [*key, *names])

        return targets.mapInArrow(run, schema)
    if small(targets):
        places = targets.toArrow().combine_chunks()
        held = spark.sparkContext.broadcast((_columns(places), places.select(list(key))))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            columns, keys = held.value
            found = np.zeros((len(names), keys.num_rows))
            for batch in batches:
                _add(found, columns, _columns(batch), fn)
            table = pa.table([*keys.columns, *map(pa.array, found)], [*key, *names])
            yield from table.to_batches(max_chunksize=10_000)

        return sources.mapInArrow(partial, schema).groupBy(*key).agg(*[F.sum(n).alias(n) for n in names])
    return None


def squares(t: Columns, s: Columns, t_cols: Sequence[str], s_cols: Sequence[str]) -> np.ndarray:
    """Squared distances, targets by sources."""
    total = None
    for a, b in zip(t_cols, s_cols, strict=True):
        gap = t[a][:, None] - s[b][None, :]
        total = gap * gap if total is None else total + gap * gap
    return total


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors: ids, and the vectors one after another."""
    for whole in batches:
        for i in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(i, BLOCK)
            held = np.array(batch.column(1).to_pylist(), dtype=float)
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_pylist()], pa.list_(batch.schema.field(0).type)), pa.array([held.tobytes()], pa.binary())], ["ids", "held"])


def vector_sums(rows: DataFrame, key: str, vector: str, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(key, total): for each row the sum of kernel(squared distance) over all rows, itself included; vectors of one length, without nulls.
    Rows are packed into blocks of at most BLOCK vectors, and tasks get pairs of blocks: the work is that of all pairs, a task holds two blocks."""
    kind = dict(rows.dtypes)[key]
    kept = rows.select(F.col(key).alias("id"), vector).where(F.col(vector).isNotNull())
    packed = cut(kept.mapInArrow(_packed, f"ids array<{kind}>, held binary"))
    sides = packed.crossJoin(packed.select(F.col("held").alias("other")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].values
                a = np.frombuffer(batch.column(1)[i].as_py()).reshape(len(ids), -1)
                b = np.frombuffer(batch.column(2)[i].as_py()).reshape(-1, a.shape[1])
                square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
                yield pa.RecordBatch.from_arrays([ids, pa.array(kernel(np.maximum(square, 0.0)).sum(axis=1))], [key, "total"])

    return sides.mapInArrow(run, f"`{key}` {kind}, total double").groupBy(key).agg(F.sum("total").alias("total"))
