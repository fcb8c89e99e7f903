"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Read one parquet table below sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def each(column: pa.Array | pa.ChunkedArray) -> Iterator:
    """The values of a column one at a time, so that Python holds one text besides the batch; Spark bounds a batch by
    spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set."""
    return (v.as_py() for v in column)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows, so that what is made of a batch is handed on piece by piece."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Hand Python at most so many rows at once from now on: for jobs of several stages, whose workers stay."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


_KEPT: dict[str, dict] = {}


def kept_for(work: str) -> dict:
    """What a worker keeps from task to task for one kind of work. Workers stay for the length of a job, so what they kept for
    another kind goes: else all stages of a job add up in each of them."""
    if work not in _KEPT:
        _KEPT.clear()
    return _KEPT.setdefault(work, {})


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a local one is made only where that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = spark.sparkContext.getCheckpointDir()
    if made is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        made = spark.sparkContext.getCheckpointDir()
    return made


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpointed_any(df: DataFrame, condition: Column | None = None) -> tuple[DataFrame, bool]:
    """A checkpoint of df, and whether any row (or any that meets the condition) went into it; seen while it is written, so it takes
    no job of its own. Tasks that are run again can only repeat what they saw."""
    scratch_dir(df.sparkSession)
    seen = Observation()
    found = F.count(F.lit(1)) if condition is None else F.count_if(condition)
    out = df.observe(seen, found.alias("n")).checkpoint(eager=True)
    return out, seen.get["n"] > 0


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = os.path.join(scratch_dir(spark), "fieldloom", spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back; for wide rows, where a checkpoint would not be compressed."""
    return _written(df, name)[0]


class Scratch:
    """Tables in the shared folder for the length of a with block; what is still needed after it must be stored or checkpointed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        found, path = _written(df, name)
        self.paths.append(path)
        return found

    def __exit__(self, *_) -> None:
        for path in self.paths:
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder by the file system that Spark reads it with."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


ROW = "__row"


def row_keyed(docs: DataFrame, id_col: str) -> DataFrame | None:
    """docs with a unique key of each row in ROW, written so that every reader sees the same one; None where the ids are such
    a key themselves: none is null and none repeats."""
    ids = docs.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    if not ids.where("n > 1 or id is null").limit(1).count():
        return None
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to add, so that clashing input columns are replaced."""
    lower = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in lower])


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """df with columns named like these renamed, and the columns that give df back from what an operator returns."""
    lower = {n.lower() for n in names}
    new = {c: f"__aside_{i}" for i, c in enumerate(df.columns) if c.lower() in lower}
    return df.withColumnsRenamed(new), [F.col(f"`{new.get(c, c)}`").alias(c) for c in df.columns]


def crc_mod(column: str, n: int) -> Column:
    """crc32 of a column as text, modulo n; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
