"""Incremental fields: kernel sums add up over events, so a stream of events merges into a field batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.kernels import get_kernel, squared_distance
from fieldloom.plans.pairs import all_pairs, near_pairs
from fieldloom.sources.planar import Support


def partial_sums(events: DataFrame, support: Support, kernel: str, bandwidth: float) -> DataFrame:
    """(support_id, s, w): what some events (coordinates, weight) add to each place in reach; w is their total weight."""
    k = get_kernel(kernel)
    t_cols = [f"t_{c}" for c in support.coords]
    targets = support.df.select("support_id", *[F.col(c).alias(t) for c, t in zip(support.coords, t_cols, strict=True)])
    pairs = all_pairs(targets, events) if k.reach is None else near_pairs(targets, events, t_cols, list(support.coords), bandwidth * k.reach)
    d = F.sqrt(squared_distance([F.col(t) for t in t_cols], [F.col(c) for c in support.coords]))
    return pairs.groupBy("support_id").agg(F.sum(F.col("weight") * k.scaled(d, bandwidth, len(t_cols))).alias("s"))


def field_sink(path: str, support: Support, kernel: str, bandwidth: float) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes the sums of each batch below path/batch=N. A replayed batch overwrites its own
    folder, so the field counts every event once."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        sums = partial_sums(batch, support, kernel, bandwidth)
        total = batch.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("s")).select(F.lit(-1).cast("long").alias("support_id"), "s")
        sums.select(F.col("support_id").cast("long").alias("support_id"), "s").union(total).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return write


def merged_field(support: Support, path: str) -> DataFrame:
    """The density of all batches so far."""
    spark = support.df.sparkSession
    sums = spark.read.parquet(path).groupBy("support_id").agg(F.sum("s").alias("s"))
    total = sums.where("support_id = -1").select(F.col("s").alias("w"))  # one row
    out = support.df.join(sums.where("support_id >= 0"), "support_id", "left").crossJoin(F.broadcast(total))
    return out.withColumn("density", F.coalesce(F.col("s"), F.lit(0.0)) / F.col("w")).drop("s", "w")
