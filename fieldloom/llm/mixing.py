"""Mixing sources to target weights by hierarchical budgets.

A token budget goes down a tree of levels (domain, language, source). At each node it is split among the children by
weight; a child that cannot use its share keeps what it can, and the shortage goes to its siblings by weight. A node never gets more
than its whole subtree can use, so a shortage reaches the next ancestor only when all siblings are full.
Each leaf then takes a prefix of tokens from a seeded order of its documents: whole epochs first, each document once an
epoch, then the head of one more epoch, the last document in part.

Prefix sums are two-level: a leaf of n documents is cut into about sqrt(n) buckets by the seeded key; only the bucket in
which the budget ends is ordered. All row work is in DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import stored

Weights = Mapping[str, float]


def _weight(level: str, weights: Weights | None) -> Column:
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for k, v in sorted(weights.items()) for x in (k, float(v))])
    return F.coalesce(F.try_element_at(table, F.col(level)), F.lit(1.0))


def _filled(nodes: DataFrame, parent: Sequence[str], level: str) -> DataFrame:
    """Split `amount` among the nodes of one parent by weight, none above its cap: nodes (…, cap, weight, amount) get `share`.

    Nodes stand in order of cap / weight. While a node's cap is at most its part of what is left, it is full; the first one
    that is not sets the rate for itself and all after it.
    """
    cap = F.when(F.col("weight") > 0, F.col("cap")).otherwise(F.lit(0)).cast("double")
    fullness = F.when(F.col("weight") > 0, cap / F.nullif(F.col("weight"), F.lit(0.0))).otherwise(F.lit(0.0))
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = group.orderBy("fullness", level)
    rows = nodes.withColumn("room", cap).withColumn("fullness", fullness)
    rows = rows.withColumn("taken", F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("left_weight", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("rate", F.coalesce(F.try_divide(F.col("amount") - F.col("taken"), F.col("left_weight")), F.lit(0.0)))
    rows = rows.withColumn("is_full", F.col("room") <= F.col("rate") * F.col("weight"))
    first = F.min(F.when(~F.col("is_full"), F.struct("fullness", level, "rate"))).over(group)
    share = F.when(F.col("is_full"), F.col("room")).otherwise(F.least(F.col("room"), F.floor(first["rate"] * F.col("weight")).cast("double")))
    return rows.withColumn("share", share.cast("long")).drop("room", "fullness", "taken", "left_weight", "rate", "is_full")


def leaf_budgets(
    leaves: DataFrame, budget: float, levels: Sequence[str], weights: Mapping[str, Weights] | None = None, max_epochs: int = 1
) -> DataFrame:
    """leaves (levels, supply, n) with `budget`, whole tokens; supply counts max_epochs times. Fractions of a token are left over."""
    weights = weights or {}
    parents: DataFrame | None = None
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        nodes = leaves.groupBy(*path).agg((F.sum("supply") * max_epochs).alias("cap")).withColumn("weight", _weight(level, weights.get(level)))
        if parents is None:
            nodes = nodes.withColumn("amount", F.least(F.lit(float(budget)), F.sum("cap").over(Window.partitionBy(F.lit(0))).cast("double")))
        else:
            nodes = nodes.join(parents, path[:-1])
        filled = _filled(nodes, path[:-1], level)
        parents = filled.select(*path, F.col("share").cast("double").alias("amount"))
    return leaves.join(parents.withColumnRenamed("amount", "budget"), list(levels)).withColumn("budget", F.col("budget").cast("long"))


def mixed(
    docs: DataFrame,
    *,
    share_of_supply: float | None = None,
    budget: float | None = None,
    levels: Mapping[str, Column] | None = None,
    weights: Mapping[str, Weights] | None = None,
    id_col: str = "doc_id",
    tokens: Column | None = None,
    carry: Sequence[str] | None = None,
    max_epochs: int = 1,
    seed: int = 17,
) -> DataFrame:
    """The documents drawn, once for each epoch that draws them: carry columns, level columns, epoch (from 0), n_tokens, take_tokens.

    The budget is given in tokens or as a share of all tokens. levels maps names to columns, from the root down; a null is a
    level of its own (empty name). weights maps level names to node weights (default 1; 0 shuts a node out). tokens
    defaults to a quarter of the text's bytes, rounded up; null texts have none, and documents without tokens are drawn
    with the prefix they fall in, taking none. take_tokens is less than n_tokens for the last document of a
    leaf only. Ties of the seeded key go by id; rows that repeat an id are drawn one by one, and a text of any length
    counts all its bytes. Carry columns named like an
    added one are replaced. An empty table gives an empty result.
    """
    tree = dict(levels or {"lang": F.col("lang"), "source": F.col("source")})
    count = tokens if tokens is not None else F.ceil(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) / 4)
    own = {x.lower() for x in (*tree, "epoch", "n_tokens", "take_tokens")}
    names = [c for c in (carry if carry is not None else docs.columns) if c.lower() not in own]
    path = [f"__{x}" for x in tree]
    inside = {f"__{k}": v for k, v in (weights or {}).items()}
    key = F.col(f"`{id_col}`")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        key.alias("id"),
        count.cast("long").alias("n_tokens"),
        *[F.coalesce(c.cast("string"), F.lit("")).alias(f"__{k}") for k, c in tree.items()],
    )
    sums = stored(rows.groupBy(*path).agg(F.sum("n_tokens").alias("supply"), F.count(F.lit(1)).alias("n")), "leaves")
    if budget is None:
        budget = float(sums.agg(F.sum("supply").alias("s")).first()["s"] or 0) * (1.0 if share_of_supply is None else share_of_supply)
    leaves = leaf_budgets(sums, budget, path, inside, max_epochs)
    full = F.when(F.col("supply") > 0, F.floor(F.col("budget") / F.col("supply"))).otherwise(F.lit(0)).cast("int")
    leaves = leaves.withColumn("full", full).withColumn("rest", F.col("budget") - F.col("full") * F.col("supply"))
    # files have a known size: the leaves are broadcast where they are small, else the join is sorted and skewed sides split
    leaves = stored(leaves.select(*path, "full", "rest", F.ceil(F.sqrt("n")).cast("long").alias("buckets")), "budgets")

    drawn = rows.join(leaves, path)
    whole = drawn.where("full > 0").select(
        "row", *path, F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("epoch"), "n_tokens", F.col("n_tokens").alias("take_tokens")
    )
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    place = F.conv(F.substring(order, 1, 8), 16, 10).cast("long")
    part = drawn.where("rest > 0").withColumn("order", order).withColumn("bucket", F.floor(place * F.col("buckets") / F.lit(1 << 32)).cast("long"))
    ahead = Window.partitionBy(*path).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # sqrt(n) rows of a leaf
    buckets = part.groupBy(*path, "bucket").agg(F.sum("n_tokens").alias("held"))
    buckets = buckets.withColumn("start", F.coalesce(F.sum("held").over(ahead), F.lit(0)))
    part = part.join(stored(buckets, "buckets"), [*path, "bucket"]).where("start < rest")
    last = F.col("start") + F.col("held") > F.col("rest")
    inner = Window.partitionBy(*path, "bucket").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, -1)
    cut = part.where(last).withColumn("before", F.col("start") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).where("before < rest")
    cut = cut.withColumn("take_tokens", F.least(F.col("n_tokens"), F.col("rest") - F.col("before")))
    out = ["row", *path, F.col("full").alias("epoch"), "n_tokens", "take_tokens"]
    result = whole.union(part.where(~last).withColumn("take_tokens", F.col("n_tokens")).select(*out)).union(cut.select(*out))
    return result.select(
        *[F.col(f"row.`{c}`").alias(c) for c in names], *[F.col(f"__{k}").alias(k) for k in tree], "epoch", "n_tokens", "take_tokens"
    )
