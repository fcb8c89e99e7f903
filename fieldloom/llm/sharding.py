"""A uniform shuffle into shards of exact size through a hypergeometric communication matrix.

Rows lie in P source parts (by a hash of their identity) and go to S shards whose sizes are fixed beforehand. How many
rows each part sends to each shard is drawn exactly, as a uniform permutation would: part by part, shard by shard, from
the hypergeometric law of what is left. Inside a part a seeded permutation decides which rows these are; rows are
exchanged; inside a shard a second seeded permutation gives the slots. The driver handles P counts and the P x S matrix
(P is at most 20,000), never rows. All row work is in DataFrame functions.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import stored

MOST_PARTS = 20_000


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(r: random.Random, total: int, marked: int, draws: int) -> int:
    """How many of `draws` rows, taken without replacement from `total`, are among the `marked`: by inversion, outward from
    the mode, in about a standard deviation of steps."""
    low, high = max(0, draws - (total - marked)), min(draws, marked)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (marked + 1) // (total + 2)))
    p = math.exp(_log_choose(marked, mode) + _log_choose(total - marked, draws - mode) - _log_choose(total, draws))
    u, up, down, p_up, p_down = r.random() - p, mode, mode, p, p
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (marked - up) * (draws - up) / ((up + 1) * (total - marked - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (total - marked - draws + down) / ((marked - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts by part and shard with the given row and column sums, distributed as under a uniform permutation."""
    r, left, out = random.Random(seed), list(shards), []
    for n in parts:
        row, total = [], sum(left)
        for s, room in enumerate(left):
            k = hypergeometric(r, total, room, n)
            total, n = total - room, n - k
            left[s] -= k
            row.append(k)
        out.append(row)
    return out


def shard_plan(docs: DataFrame, *, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard), one row per document; law is `rows`: shard sizes differ by one
    at most, the lower shards have the odd rows. size is the UTF-8 length of the text plus 1 (null: 1); text_crc32 is that
    of the text, 0 for null and empty. Slots of a shard run from 0 without gaps, in uniformly random order. Null ids are
    placed by their text; rows that repeat id and text are placed one by one. Texts of any length
    count as a whole; other columns of docs are not returned. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc")
    )
    rows = rows.withColumn("one", F.xxhash64("id", "crc", F.lit(seed))).withColumn("two", F.xxhash64("one", F.lit(seed + 1)))
    n = rows.count()
    parts = max(1, min(MOST_PARTS, math.isqrt(n)))
    rows = rows.withColumn("part", F.pmod("two", F.lit(parts)).cast("int"))
    counts = {x["part"]: x["n"] for x in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(counts)
    matrix = communication_matrix([counts[p] for p in names], [n // shards + (s < n % shards) for s in range(shards)], seed)
    ends = []
    for p, row in zip(names, matrix, strict=True):
        total, line = 0, []
        for k in row:
            total += k
            line.append(total)
        ends.append((p, line))
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("ends", T.ArrayType(T.LongType()))])
    sent = docs.sparkSession.createDataFrame(ends, schema)

    local = Window.partitionBy("part").orderBy("one", "id", "crc")
    placed = (
        rows.withColumn("rank", F.row_number().over(local) - 1)
        .join(F.broadcast(sent), "part")  # at most MOST_PARTS rows
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))))
    )
    blocks = max(1, math.isqrt(max(1, n // shards)))
    third = F.xxhash64("one", F.lit(seed + 2))
    placed = placed.select("id", "size", "crc", "shard", third.alias("third"), F.pmod(F.shiftright(third, 20), F.lit(blocks)).cast("int").alias("block"))
    placed = stored(placed, "shards")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # sqrt(rows) rows in a shard
    starts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy("third", "id", "crc")
    return (
        placed.withColumn("at", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "block"])
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("rows").alias("law"),
            "shard",
            (F.col("start") + F.col("at")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def write_shards(docs: DataFrame, plan: DataFrame, path: str, *, id_col: str = "doc_id", rows_per_file: int = 1_000_000) -> None:
    """Write docs by shard, in slot order, below path; a shard is split into runs of rows_per_file slots. Ids must be unique."""
    run = F.floor(F.col("slot") / rows_per_file).cast("long")
    rows = docs.join(plan.select(F.col(id_col), "shard", "slot", run.alias("run")), id_col)
    rows.repartition("shard", "run").sortWithinPartitions("shard", "run", "slot").write.partitionBy("shard", "run").parquet(path)
