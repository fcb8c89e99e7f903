"""A corpus pipeline of five stages over documents; each stage works on all rows that its predecessor kept.

All stages take whole texts, of any length, and repeated rows one by one. A null text counts as empty, an empty table gives an empty
result, and columns that bear the name of one that an operator adds keep their own values. Stages with Python workers set the session's
rows a batch to 500, as the workers of one stage stay while the next one runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import quality
from fieldloom.llm.bpe import ByteBPE, encoded
from fieldloom.llm.common import Scratch, aside, read, small_batches
from fieldloom.llm.exact_dedup import drop_exact_copies
from fieldloom.llm.minhash import drop_near_copies
from fieldloom.llm.mixing import mixed


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject: a posterior of one half or more. A null or empty text is judged by its
    site alone, a null source or language is a site of its own; without labels of both kinds the evidence is zero and all stay."""
    small_batches(spark)
    rows, back = aside(docs, "evidence", "site_mean", "quality_score", "quality_kept")
    net = quality.train(docs, read(spark, sf_dir, "labels"))
    found = quality.judged(rows, net, quality.site_means(docs, net))
    return found.where("quality_kept").select(*back)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space: that of the most code points, then of the smallest id, null
    ids last. Null and blank texts are one group."""
    return drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, that of the smallest id, null ids last: five words, similarity 0.8 or more. Null and
    blank texts have no copies and stay."""
    small_batches(spark)
    return drop_near_copies(docs, similarity=(80, 100), n_bands=40)


def prefix_text(text: Column, tokens: Column) -> Column:
    """The first tokens of a text, four bytes each, less a code point that the cut would split."""
    whole, n = text.cast("binary"), (tokens * 4).cast("int")
    split = lambda i: F.hex(F.substring(whole, n + i, F.lit(1))).between("80", "BF")
    back = F.when(~split(1), 0).when(~split(0), 1).when(~split(-1), 2).otherwise(3)
    return F.when(n < F.octet_length(whole), F.substring(whole, F.lit(1), n - back).cast("string")).otherwise(text)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A prefix of each source, 90 percent of all tokens, by weights of language and source; each document once at most. The
    last document of a source is cut to the tokens it still gives. A null language or source is a leaf of its own, ties of the seeded
    order go by id, and documents without tokens are drawn with the prefix they fall in."""
    group = F.pmod(F.regexp_extract("source", r"(\d+)$", 1).try_cast("int"), F.lit(3))
    rows, back = aside(docs, "mix_domain", "mix_lang", "mix_source", "epoch", "n_tokens", "take_tokens")
    found = mixed(
        rows,
        share_of_supply=0.9,
        levels={"mix_domain": group, "mix_lang": F.col("lang"), "mix_source": F.col("source")},
        weights={"mix_lang": {"en": 6.0, "fr": 2.0, "de": 2.0, "es": 2.0}},
    )
    part = F.col("take_tokens") < F.col("n_tokens")
    short = prefix_text(F.col("text"), F.col("take_tokens"))
    changed = {"text": short, "n_chars": F.length(short).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return found.select(*[F.when(part, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else kept for c, kept in zip(docs.columns, back, strict=True)])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, packed, with digests of the ids and of the decoded bytes; an empty text has none. Other columns than
    doc_id, lang and source are left out."""
    import public_tokenizers

    small_batches(spark)
    coder = ByteBPE(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    found = encoded(docs.select("doc_id", "lang", "source", "text"), coder)
    return found.select(
        "doc_id",
        "lang",
        "source",
        "n_tokens",
        "token_ids",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [("quality", keep_good), ("exact", drop_copies), ("near", drop_near), ("mixing", mix), ("encode", encode)]

#: SQL cannot express the classifier, the components of near copies or the token ids; the stages are tested on their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder, read by the next, and deleted after it."""
    docs, former = read(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        with former:
            current = Scratch(spark)
            docs, former = current.stored(stage(spark, docs, sf_dir), f"stage-{name}"), current
    return STAGES[-1][1](spark, docs, sf_dir)
