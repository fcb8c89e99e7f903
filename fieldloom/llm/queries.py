"""The queries of the corpus operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import codes, divergence, imatch, langid, quality, toxicity
from fieldloom.llm.bpe import ByteBPE, encoded
from fieldloom.llm.common import read
from fieldloom.llm.exact_dedup import exact_groups
from fieldloom.llm.html_text import extracted
from fieldloom.llm.minhash import near_components
from fieldloom.llm.mixing import mixed
from fieldloom.llm.sharding import shard_plan
from fieldloom.llm.simhash import simhash_components


MIX_LEVELS = ("domain", "lang", "source")
MIX_WEIGHTS = {"domain": {"d0": 5.0, "d1": 3.0, "d2": 2.0}, "lang": {"en": 4.0, "fr": 3.0, "de": 2.0, "es": 1.0}, "source": {"src0": 3.0}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.8, 2, 17


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn to target weights: the number of a source, modulo 3, is its domain."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    number = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")
    return mixed(
        docs,
        share_of_supply=MIX_SHARE,
        levels={"domain": F.concat(F.lit("d"), F.pmod(number, F.lit(3)).cast("string")), "lang": F.col("lang"), "source": F.col("source")},
        weights=MIX_WEIGHTS,
        carry=("doc_id",),
        max_epochs=MIX_EPOCHS,
        seed=MIX_SEED,
    )


def _mixing_sql() -> str:
    """SQL of op1_mixing."""

    def weight(level: str) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS[level].items())
        return f"CASE {level} {cases} ELSE 1.0 END::DOUBLE"

    parts = [
        f"""d AS (
            SELECT doc_id, coalesce('d' || CAST(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 3 AS VARCHAR), '') AS domain,
                   coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   CAST((strlen(coalesce(text, '')) + 3) // 4 AS BIGINT) AS n_tokens
            FROM documents
        ), leaves AS (
            SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply FROM d GROUP BY ALL
        ), t0 AS (SELECT least(sum(supply)::DOUBLE * {MIX_SHARE}, sum(supply)::DOUBLE * {MIX_EPOCHS}) AS amount FROM leaves)"""
    ]
    for i, level in enumerate(MIX_LEVELS):
        path, parent = ", ".join(MIX_LEVELS[: i + 1]), ", ".join(MIX_LEVELS[:i])
        group = f"PARTITION BY {parent}" if parent else ""
        parts.append(
            f"""a{i} AS (
            SELECT {path}, sum(supply)::DOUBLE * {MIX_EPOCHS} AS cap, {weight(level)} AS w FROM leaves GROUP BY {path}
        ), b{i} AS (
            SELECT *, coalesce(sum(cap) OVER ({group} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
                   sum(w) OVER ({group} ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lw
            FROM a{i} {f"JOIN t{i} USING ({parent})" if parent else f"CROSS JOIN t{i}"}
        ), c{i} AS (
            SELECT *, (amount - taken) / lw AS rate, cap <= (amount - taken) / lw * w AS is_full FROM b{i}
        ), t{i + 1} AS (
            SELECT {path}, CASE WHEN is_full THEN cap
                   ELSE least(cap, floor(max(CASE WHEN NOT is_full THEN rate END) OVER ({group}) * w)) END AS amount
            FROM c{i}
        )"""
        )
    path = ", ".join(MIX_LEVELS)
    parts.append(
        f"""leaf AS (
            SELECT *, CASE WHEN supply > 0 THEN CAST(amount AS BIGINT) // supply ELSE 0 END AS full_epochs
            FROM leaves JOIN t{len(MIX_LEVELS)} USING ({path})
        ), e AS (
            SELECT d.*, full_epochs, CAST(amount AS BIGINT) - full_epochs * supply AS rest FROM d JOIN leaf USING ({path})
        ), o AS (
            SELECT *, coalesce(sum(n_tokens) OVER (
                PARTITION BY {path} ORDER BY md5('{MIX_SEED}:' || full_epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM e WHERE rest > 0
        )
        SELECT doc_id, {path}, CAST(i AS INT) AS epoch, n_tokens, n_tokens AS take_tokens
        FROM e JOIN (SELECT unnest(range({MIX_EPOCHS})) AS i) ON i < full_epochs
        UNION ALL
        SELECT doc_id, {path}, CAST(full_epochs AS INT), n_tokens, CAST(least(n_tokens, rest - before) AS BIGINT) FROM o WHERE before < rest"""
    )
    return "WITH " + ", ".join(parts)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the other four folds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out("doc_id", 5, 0))
    model = langid.train(docs.where("not held_out"))
    return langid.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform shuffle of all documents into eight shards of equal row counts."""
    return shard_plan(read(spark, sf_dir, "documents"), shards=8)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from two folds of three."""
    fold = langid.held_out("doc_id", 3, 1)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold)
    net = toxicity.train(docs.where("not held_out"), read(spark, sf_dir, "labels").where(~fold))
    found = toxicity.score(docs, net)
    return found.select(
        "doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"), "toxic_in_lang"
    )


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: five words, similarity 0.85."""
    return near_components(read(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and back, as digests."""
    import public_tokenizers

    coder = ByteBPE(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    found = encoded(read(spark, sf_dir, "documents").select("doc_id", "text"), coder)
    return found.select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents, white space aside."""
    return exact_groups(read(spark, sf_dir, "documents"), carry=("doc_id",))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; its source is the host, its language the path."""
    docs = read(spark, sf_dir, "documents")
    net = quality.train(docs, read(spark, sf_dir, "labels"))
    found = quality.judged(docs, net, quality.site_means(docs, net))
    return found.select("doc_id", "evidence", "site_mean", "quality_score", F.col("quality_kept").alias("kept"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extracted(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every document and of its edited text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return imatch.edited_pairs(docs, imatch.lexicon(docs))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose fingerprints differ in three bits or fewer."""
    return simhash_components(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ from one another, and by which terms from the language."""
    return divergence.audit(read(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings: eight parts, sixteen entries, six rounds."""
    coded, books = codes.compressed(read(spark, sf_dir, "embeddings"))
    found = codes.with_label_error(coded).withColumn("codebooks_sha256", F.lit(codes.digest(books)))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing, op2_language_id, op3_sharding, op4_toxicity, op5_minhash_near_dedup, op6_byte_bpe, op7_exact_dedup, op8_quality, op9_html_extraction, op10_fingerprints, op11_simhash_near_dedup, op12_source_divergence, op13_vector_codes,
    )
} | {"pipeline": corpus_pipeline.run}

def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """SQL of op13_vector_codes: one pair of tables a round."""
    steps = [
        f"""k AS (
            SELECT vec_id, label, embedding AS e FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id NOT IN (
                SELECT vec_id FROM (SELECT vec_id, unnest(embedding) AS c FROM embeddings) WHERE c IS NULL OR NOT isfinite(c))
        ), x AS MATERIALIZED (
            SELECT vec_id, (i - 1) // (len(e) // {parts}) AS part, (i - 1) % (len(e) // {parts}) AS place,
                   CAST(floor(4096 * CAST(e[i] AS DOUBLE)) AS BIGINT) AS c
            FROM (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS i FROM k)
        ), b0 AS MATERIALIZED (
            SELECT part, entry, place, c FROM x
            JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < {entries}) USING (vec_id)
        )"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""d{r} AS (
            SELECT vec_id, part, entry, CAST(sum((x.c - b.c) * (x.c - b.c)) AS BIGINT) AS d
            FROM x JOIN b{r} b USING (part, place) GROUP BY vec_id, part, entry
        ), a{r} AS MATERIALIZED (
            SELECT vec_id, part, entry, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1
        )"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} AS (
            SELECT part, entry, place, sum(c)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id, part) GROUP BY part, entry, place
        ), b{r + 1} AS MATERIALIZED (
            SELECT part, entry, place, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c
            FROM b{r} LEFT JOIN m{r} USING (part, entry, place)
        )"""
            )
    steps.append(
        f"""o AS (
            SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
            FROM a{rounds} GROUP BY vec_id
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, place)) FROM b{rounds}) AS codebooks_sha256
        FROM o JOIN k USING (vec_id)"""
    )
    return "WITH " + ", ".join(steps)


ORACLES: dict[str, str] = {
    "op13_vector_codes": _codes_sql(),
    "op12_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
        l AS (SELECT lang, count(*) AS v, sum(lang_n)::BIGINT AS lang_total FROM kept GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        m AS (
            SELECT lang, source, total, coalesce(v, 0) AS v, lang_total
            FROM g LEFT JOIN (SELECT lang, source, sum(n)::BIGINT AS total FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN l USING (lang)
        ), p AS (
            SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000 * (coalesce(n, 0) + 5) // (coalesce(total, 0) + 5 * v) AS p,
                   1 + 1000000000 * (lang_n + 5) // (lang_total + 5 * v) AS q
            FROM m JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
        ), pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
                SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
                FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
            ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        ), terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
        u AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
            FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
        )
        SELECT lang, source, part, item, value, rank FROM u WHERE part = 'pair' OR rank <= 50
    """,
    "op1_mixing": _mixing_sql(),
    "op7_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        ), g AS (
            SELECT doc_id, sha256(norm) AS text_sha256,
                   first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
    "op5_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS shingles FROM w
        ), x AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s), p AS (
            SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS met, any_value(a.n) + any_value(b.n) AS sizes
            FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
        ), e AS (SELECT i, j FROM p WHERE 100 * met >= 85 * (sizes - met)), l AS (SELECT i, j FROM e UNION ALL SELECT j, i FROM e),
        r AS (SELECT doc_id, doc_id AS reached FROM s UNION SELECT r.doc_id, l.j FROM r JOIN l ON r.reached = l.i),
        c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, len(shingles)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
    """,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
