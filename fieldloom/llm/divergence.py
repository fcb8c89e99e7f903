"""How far the sources of a language diverge in their use of terms: an inverted index with corrections to a baseline.

Each (language, source) group gives every kept term a smoothed share p, in integer units; a term that does not occur there has the same p0
as all others. Two groups are compared by the sum of |p - q| over the V terms of their language. That sum starts at V times |p0 - q0|,
as if no term occurred in either. The postings of the terms, that is the groups in which a term occurs, then emit corrections only:

* a term that occurs in one group, as against a group in which it does not: |p - q0| - |p0 - q0|. Terms that occur equally often in a
  group have the same p, so these are added up by (group, count) before they meet the other groups;
* a term that occurs in both: what turns the sum of the two corrections above into |p - q|. Zeros are not emitted.

Counts are added up inside tasks before they are shuffled, so a source or a term that holds much of the corpus is a few rows a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import Scratch, stored

_HELD = 200_000
#: Every ASCII byte but letters turns into a space, A-Z into a-z; bytes of other code points stay.
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The runs of [^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F] in order, repeats included, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs), added up within the task every so often."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def emit() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            made = [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array([t.decode("utf-8") for t in n], pa.string())]
            yield pa.RecordBatch.from_arrays([*made, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*batch.columns, strict=True):
            n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            found, before = Counter(terms(text.as_py())), len(n)
            n.update(found)
            docs.update(found.keys())
            size += len(n) - before
            if size > _HELD:
                yield from emit()
                size = 0
    yield from emit()


def _share(n: Column, total: Column, v: Column, smoothing: int, scale: int) -> Column:
    """1 + floor(scale * (n + smoothing) / (total + smoothing * v)), exact: the product may exceed 64 bits."""
    top = (n.cast("decimal(20,0)") + F.lit(smoothing)) * F.lit(scale).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", top, total.cast("decimal(38,0)") + v * F.lit(smoothing)).cast("long")


def audit(
    docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 30, smoothing: int = 5, scale: int = 10**9, top: int = 50
) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Each language keeps the V terms that occur in at least min_docs of its documents. A group (lang, source) with n occurrences of a kept
    term, and N of all, gives it p = 1 + floor(scale * (n + smoothing) / (N + smoothing * V)); a language has such a p as well. Part
    "pair": item is each other source of the language, value the sum of |p - q| over all kept terms. Part "term": item is a term that
    occurs in the group and has a larger p there than in the language, value the difference, the first `top` only. Ranks count from 1
    per group and part, by value descending, then by item in order of UTF-8.

    A null language, source or text counts as empty, and an empty name is a group like any other, also without terms: its p are all alike.
    A language without kept terms has pairs of value 0 and no terms; one with a single source has no pairs. Rows count one by one,
    repeated ones too, and texts of any length as a whole. Other columns of docs are not read. An empty table gives an empty result.
    """
    named = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    with Scratch(docs.sparkSession) as scratch:
        counted = named.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
        counts = scratch.stored(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
        kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term", "lang_n")
        postings = scratch.stored(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "postings")
        langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
        totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        share = lambda n, total: _share(n, total, F.col("v"), smoothing, scale)
        groups = named.select("lang", "source").distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["v", "lang_total", "total"])
        groups = scratch.stored(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"))).otherwise(F.lit(0).cast("long"))), "groups")
        held = postings.join(groups, ["lang", "source"])
        shares = scratch.stored(held.select("lang", "source", "term", "n", "p0", share(F.col("n"), F.col("total")).alias("p"), share(F.col("lang_n"), F.col("lang_total")).alias("q")), "shares")

        pairs = _pairs(groups, shares)
        value = F.col("p") - F.col("q")
        over = shares.where(value > 0).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
        order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
        rank = F.row_number().over(order)
        best = over.withColumn("rank", rank).where(F.col("rank") <= top)
        return stored(pairs.withColumn("rank", rank).unionByName(best), "divergence")


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, part, item, value) of every two groups of a language, in both directions."""
    g, h = (groups.select("lang", F.col("source").alias(s), F.col("p0").alias(f"{s}0"), "v") for s in ("a", "b"))
    base = g.join(h.drop("v"), "lang").where("a <> b").select("lang", "a", "b", (F.abs(F.col("a0") - F.col("b0")) * F.col("v")).alias("value"))
    # terms of a group as against the zero of another one: one row for each count that occurs
    alike = shares.groupBy("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "p").agg(F.count(F.lit(1)).alias("times"))
    delta = F.abs(F.col("p") - F.col("b0")) - F.abs(F.col("a0") - F.col("b0"))
    single = alike.join(h.drop("v"), "lang").where("a <> b").where(delta != 0).select("lang", "a", "b", (delta * F.col("times")).alias("value"))
    single = single.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    single = single.union(single.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    # terms of both
    x, y = (shares.select("lang", "term", F.col("source").alias(s), F.col("p0").alias(f"{s}0"), F.col("p").alias(f"{s}p")) for s in ("a", "b"))
    diff = lambda m, n: F.abs(F.col(m) - F.col(n))
    delta = diff("ap", "bp") - diff("ap", "b0") - diff("a0", "bp") + diff("a0", "b0")
    both = x.join(y, ["lang", "term"]).where("a < b").where(delta != 0).groupBy("lang", "a", "b").agg(F.sum(delta).alias("value"))
    both = both.union(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    summed = base.union(single).union(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    return summed.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
