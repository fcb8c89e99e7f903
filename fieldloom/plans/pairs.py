"""Pairs of targets and sources: the joins behind every kernel sum.

A kernel without reach needs every pair: the smaller side is broadcast if its row count is within a checked bound, else
Spark's cartesian product deals blocks of both sides to tasks. A kernel with reach needs only near pairs: both sides
are keyed by cells as wide as the reach, one side is repeated to the neighbouring cells, and an equi-join on the cell
leaves a residual test of the distance. Per-source reaches are joined by powers of two, each with its own cell width.
Cells with many pairs are dealt in blocks: parts of their targets by parts of their sources, by the counts of both sides.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20
PAIRS = 1 << 26  # pairs of a cell that one task compares
HOT_CELLS = 100_000  # cells that are dealt, at most: their table is sent to every task


def _bytes(name: str, kind: str) -> Column:
    """Bytes of a value: measured where they vary, eight else."""
    c = F.col(f"`{name}`")
    if kind.startswith("array<"):
        return F.coalesce(F.size(c) * 8, F.lit(8))
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    return F.lit(8 if not kind.startswith(("struct", "map")) else 64)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most `rows` rows and `size` bytes, as measured on its rows: a count and a sum in each task, no rows move."""
    width = F.lit(0)
    for name, kind in df.dtypes:
        width = width + _bytes(name, kind)
    found = df.select(width.cast("long").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("b")).first()
    return found["n"] <= rows and (found["b"] or 0) <= size


def all_pairs(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Every target with every source."""
    if small(targets):
        return sources.crossJoin(F.broadcast(targets))
    if small(sources):
        return targets.crossJoin(F.broadcast(sources))
    return targets.crossJoin(sources)


def _cell(cols: list[Column], width: Column | float) -> list[Column]:
    return [F.floor(c / width).cast("long") for c in cols]


def _dealt(left: DataFrame, right: DataFrame, keys: list[str], left_counts: DataFrame, salt: list[str]) -> DataFrame:
    """left and right joined on the keys. Of a key with more than PAIRS pairs, both sides are cut into parts by a hash of their rows
    (right: of its salt columns), each part of one side is repeated for the parts of the other, and each block is a key of its own.
    The bound rises by powers of 16 until at most HOT_CELLS keys exceed it, so their table can be sent; the dealt blocks are
    then still a small share of all work. left_counts: the keys and __l, the rows of left."""
    if left.isStreaming or right.isStreaming:
        return left.join(right, keys)
    counts = left_counts.join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__r")), keys)
    work = F.col("__l").cast("double") * F.col("__r")
    bounds = [float(PAIRS) * 16**k for k in range(12)]
    found = counts.agg(*[F.count_if(work > b).alias(f"n{k}") for k, b in enumerate(bounds)]).first()
    if not found["n0"]:
        return left.join(right, keys)
    bound = next((b for k, b in enumerate(bounds) if found[f"n{k}"] <= HOT_CELLS), bounds[-1])
    parts = F.ceil(work / bound)
    of_right = F.greatest(F.lit(1), F.least(parts, F.col("__r"), F.ceil(F.sqrt(parts * F.col("__r") / F.col("__l")))))
    hot = counts.where(work > bound).withColumn("__n", of_right.cast("int")).withColumn("__m", F.least(F.ceil(parts / F.col("__n")), F.col("__l")).cast("int"))
    hot = F.broadcast(hot.select(*keys, "__m", "__n"))

    def blocks(df: DataFrame, columns: list[str], own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.coalesce(n_own, F.lit(1))).cast("int").alias(own)
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(n_other, F.lit(1)) - 1)).alias(other)
        return df.join(hot, keys, "left").select(*[F.col(f"`{c}`") for c in df.columns], part, copies)

    a = blocks(left, left.columns, "__i", "__m", "__j", "__n")
    b = blocks(right, salt or right.columns, "__j", "__n", "__i", "__m")
    return a.join(b, [*keys, "__i", "__j"]).drop("__i", "__j")


def _around(dim: int, own: str) -> Column:
    """The cells around a cell, itself included, one to a row."""
    return F.explode(F.array(*[F.struct(*[(F.col(f"{own}.k{i}") + d).alias(f"k{i}") for i, d in enumerate(step)]) for step in itertools.product((-1, 0, 1), repeat=dim)]))


def _cells(cols: list[str], width: Column | float) -> Column:
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(_cell([F.col(c) for c in cols], width))])


def near_pairs(targets: DataFrame, sources: DataFrame, t_cols: list[str], s_cols: list[str], reach: float, salt: list[str] | None = None) -> DataFrame:
    """Pairs whose coordinates differ by at most the reach on each axis (a superset of the ball); test the distance after.

    Targets are repeated to the neighbouring cells; they are usually the smaller side. Crowded cells are dealt to several tasks, by a
    hash of the salt columns of the sources, or of all.
    """
    dim = len(t_cols)
    if dim > 3:
        return all_pairs(targets, sources)
    own = targets.withColumn("__own", _cells(t_cols, reach))
    left = own.withColumn("cell", _around(dim, "__own")).drop("__own")
    n = own.groupBy("__own").agg(F.count(F.lit(1)).alias("n"))
    counts = n.select(_around(dim, "__own").alias("cell"), "n").groupBy("cell").agg(F.sum("n").alias("__l"))
    return _dealt(left, sources.withColumn("cell", _cells(s_cols, reach)), ["cell"], counts, salt or []).drop("cell")


def near_pairs_by_source(targets: DataFrame, sources: DataFrame, t_cols: list[str], s_cols: list[str], reach: Column, salt: list[str] | None = None) -> DataFrame:
    """As near_pairs, with a reach of each source: sources are graded by powers of two, targets are repeated once per grade, and the
    grade is part of the key, so there is one join whatever the grades. A reach that is not positive and finite is an error."""
    dim = len(t_cols)
    if dim > 3:
        return all_pairs(targets, sources)
    graded = sources.withColumn("__reach", reach).withColumn("grade", F.ceil(F.log2("__reach")).cast("int"))
    found = graded.agg(F.collect_set("grade").alias("grades"), F.count_if(~(F.col("__reach") > 0) | F.isnan("__reach") | (F.col("__reach") == float("inf")) | F.col("__reach").isNull()).alias("bad")).first()
    if found["bad"]:
        raise ValueError(f"{found['bad']} bandwidths are not positive and finite")
    grades = sorted(found["grades"])  # at most some 2,000 powers of two
    if not grades:
        return targets.crossJoin(sources.limit(0))
    width = F.pow(F.lit(2.0), F.col("grade"))
    own = targets.withColumn("grade", F.explode(F.array(*[F.lit(g) for g in grades]))).withColumn("__own", _cells(t_cols, width))
    left = own.withColumn("cell", _around(dim, "__own")).drop("__own")
    n = own.groupBy("grade", "__own").agg(F.count(F.lit(1)).alias("n"))
    counts = n.select("grade", _around(dim, "__own").alias("cell"), "n").groupBy("grade", "cell").agg(F.sum("n").alias("__l"))
    right = graded.withColumn("cell", _cells(s_cols, width)).drop("__reach")
    return _dealt(left, right, ["grade", "cell"], counts, salt or []).drop("grade", "cell")
