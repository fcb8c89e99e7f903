"""Exact deduplication by distributed MSD radix partitioning.

Texts are compared on their bytes, most significant first. Each round takes the next run of bytes of every document
that is still undecided, groups by (group so far, those bytes) and keeps apart
  * groups of one document: decided, nothing equals it;
  * groups whose text ended inside the run: decided, all members are equal;
  * the rest: they go on to the next round, with a longer run.
Equality is settled on the bytes themselves; no digest takes part. A group of many rows is dealt to SALTS tasks when its rows take up
what is known of their group: rows by their id, the group's one row copied. Runs grow by a constant factor, so a text of n
bytes needs O(log n) rounds, and after the first round only documents that share a prefix with another one are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import ROW, aside, checkpointed, row_keyed, stored

SALTS, HEAVY = 64, 1000  # a group is heavy if it holds more than one in HEAVY of the rows that share a run, so there are few
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def _normalised(text):
    """UTF-8 bytes of the text less white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "").cast("binary")


def exact_groups(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] | None = None,
    first_run: int = 32,
    growth: int = 16,
) -> DataFrame:
    """Group documents whose texts are equal after deleting every character of [\\x20\\x09-\\x0D].

    Returns one row per input row: the columns named in carry (all by default) with keep_id, group_size, kept and
    text_sha256 (of the normalised text). In a group the row with the most code points in its original text stays, then
    the one with the smallest id, a null id after all others, then any one row: kept is true for exactly one row of each
    group, though ids are null or repeat; keep_id is the id of that row. A null text counts as empty; empty texts equal
    each other, and texts of any length are compared whole. Rows that repeat both id and text count separately in group_size. Input columns named like an added one are replaced. An empty table gives an empty result.
    """
    names = [c for c in (carry or docs.columns) if c.lower() not in ADDED]
    held = text_col in names  # then the bytes are cut from the text that travels anyway
    text, key = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    keyed = row_keyed(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys((*names, id_col, text_col))]), id_col)
    docs, row = (docs, F.lit(0).cast("long")) if keyed is None else (keyed, F.col(ROW))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.struct(
            (-F.length(F.coalesce(text.cast("string"), F.lit("")))).alias("n"), key.isNull().alias("no_id"), key.alias("id"), row.alias("row")
        ).alias("rank"),
        F.sha2(_normalised(text), 256).alias("sha"),
        F.lit(0).cast("long").alias("gid"),
        *([] if held else [_normalised(text).alias("rest")]),
    )
    decided, offset, run = [], 0, first_run
    while True:
        ahead = _normalised(F.col(f"row.`{text_col}`")) if held else F.col("rest")
        start = offset + 1 if held else 1
        cut = rows.withColumn("run", F.substring(ahead, start, run))
        # groups of one never meet another row: only shared runs are kept, with one row each
        groups = checkpointed(
            cut.groupBy("gid", "run")
            .agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("best"))
            .where("n > 1")
            .withColumn("next_gid", F.monotonically_increasing_id())
        )
        going = groups.where(F.length("run") == run).limit(1).count() > 0
        ended = F.length("run") < run
        shared = F.col("n").isNotNull()
        facts = groups.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
        if facts["most"] and facts["most"] > max(SALTS, facts["rows"] / HEAVY):
            least = max(SALTS, facts["rows"] / HEAVY)
            heavy = [r["h"] for r in groups.where(F.col("n") > least).select(F.xxhash64("gid", "run").alias("h")).collect()]  # at most HEAVY numbers
            is_heavy = F.xxhash64("gid", "run").isin(heavy)
            cut = cut.withColumn("salt", F.when(is_heavy, F.pmod(F.xxhash64("rank.id", "rank.row"), F.lit(SALTS))).otherwise(F.lit(0)))
            groups = groups.withColumn("salt", F.explode(F.when(is_heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        else:
            cut, groups = cut.withColumn("salt", F.lit(0)), groups.withColumn("salt", F.lit(0))
        out = cut.join(groups, ["gid", "run", "salt"], "left").select(
            "row",
            "rank",
            "sha",
            F.when(shared & ~ended, F.col("next_gid")).alias("gid"),
            F.coalesce(F.when(ended, F.col("n")), F.lit(1)).cast("long").alias("group_size"),
            F.when(ended & shared, F.col("best.id")).otherwise(F.col("rank.id")).alias("keep_id"),
            F.when(ended & shared, F.col("rank").eqNullSafe(F.col("best"))).otherwise(True).alias("kept"),
            *([] if held else [F.when(shared & ~ended, F.substring(ahead, run + 1, 2**31 - 1)).alias("rest")]),
        )
        if not going:
            decided.append(out)
            break
        out = stored(out, "radix")
        decided.append(out.where("gid is null"))
        rows = out.where("gid is not null").select("row", "rank", "sha", "gid", *([] if held else ["rest"]))
        offset, run = offset + run, run * growth

    result = None
    for part in decided:
        part = part.select(
            *[F.col(f"row.`{c}`").alias(c) for c in names],
            "keep_id",
            "group_size",
            "kept",
            F.col("sha").alias("text_sha256"),
        )
        result = part if result is None else result.unionByName(part)
    return result


def drop_exact_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with the columns of docs, whatever their names: one row of each group, as exact_groups keeps it."""
    renamed, back = aside(docs, *ADDED)
    found = exact_groups(renamed, **options)
    return found.where("kept").select(*back)
