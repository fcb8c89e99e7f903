"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd input."""

import hashlib
import html
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import bpe, common, html_text, imatch, langid, quality, sharding, toxicity
from fieldloom.llm.common import without
from fieldloom.llm.exact_dedup import drop_exact_copies, exact_groups
from fieldloom.llm.minhash import drop_near_copies, near_components, shingle_set, signature
from fieldloom.llm.mixing import leaf_budgets, mixed
from fieldloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, kept string"
ODD = [
    (1, None, "en", "s", "x"),
    (2, "", "en", "s", "x"),
    (3, " \t\n", None, None, None),
    (4, "one two", "en", "s", "x"),
    (4, "one two", "en", "s", "x"),
    (5, "one  two", "fr", "s", "x"),
    (None, "one two", "en", None, "x"),
    (6, "word " * 30000, "en", "t", "x"),
    (7, "word " * 29999 + "end ", "en", "t", "x"),
    (8, "\x1c \x85 ¿ ñ 😀 $$$", "es", "t", "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def test_exact_groups_match_brute_force(docs):
    got = {r.doc_id: r for r in exact_groups(docs, first_run=4, growth=4).collect()}
    rows = docs.select("doc_id", "text").collect()
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append((-len(r.text or ""), r.doc_id))
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep, len(members), i == keep)
            assert got[i].text_sha256 == hashlib.sha256(norm.encode()).hexdigest()
    assert len(got) == len(rows)


def test_exact_groups_on_odd_rows(odd):
    rows = exact_groups(odd).collect()
    assert len(rows) == len(ODD) and rows[0].asDict().keys() == {*without(odd, "kept").columns, "keep_id", "group_size", "kept", "text_sha256"}
    empty = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert {(r.keep_id, r.group_size) for r in empty} == {(3, 3)}
    same = [r for r in rows if r.text in ("one two", "one  two")]
    assert {(r.keep_id, r.group_size) for r in same} == {(5, 4)} and [r.doc_id for r in same if r.kept] == [5]
    assert drop_exact_copies(odd).columns == odd.columns and {r.kept for r in drop_exact_copies(odd).collect()} == {"x", None}
    assert exact_groups(odd.limit(0)).count() == 0


def test_heavy_groups_are_salted(spark):
    rows = [(i, "a" * 40 + ("" if i % 3 else "b" * (i % 5))) for i in range(900)] + [(900 + i, f"text {i}") for i in range(100)]
    found = {r.doc_id: r for r in exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), first_run=8).collect()}
    groups = {}
    for i, text in rows:
        groups.setdefault(text.replace(" ", ""), []).append(i)
    assert len(found) == len(rows)
    for members in groups.values():
        assert {(found[i].keep_id, found[i].group_size) for i in members} == {(min(members), len(members))}


def test_one_row_stays_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "no id"), (None, "no  id"), (1, "long"), (None, "lo ng"), (7, "twice"), (7, "twice"), (7, "tw ice"), (8, "alone"), (9, text), (9, text), (9, text + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = exact_groups(docs, first_run=4, growth=4).collect()
    assert len(found) == len(rows)
    groups = {}
    for r in found:
        groups.setdefault(r.text_sha256, []).append(r)
    for g in groups.values():
        best = [r for r in g if r.kept]
        assert len(best) == 1 and {r.group_size for r in g} == {len(g)} and {r.keep_id for r in g} == {best[0].doc_id}
        assert len(best[0].text) == max(len(r.text) for r in g)
    want = [(None, "lo ng"), (None, "no  id"), (7, "tw ice"), (8, "alone"), (9, text), (9, text + " end")]
    assert sorted((str(r.doc_id), r.text) for r in drop_exact_copies(docs).collect()) == sorted((str(i), t) for i, t in want)


def test_one_row_stays_of_each_component(spark):
    text, other = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(3, text), (3, text), (3, text + " end"), (3, other), (None, text), (None, other + " end"), (None, "lone words"), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_components(docs).collect()
    named = [r for r in found if r.doc_id is not None]
    assert len(found) == len(rows) and all(r.component_id is None and r.kept for r in found if r.doc_id is None)
    assert sorted(r.component_id for r in named) == [3, 3, 3, 3, 4] and sorted(r.doc_id for r in named if r.kept) == [3, 3, 4]
    stay = sorted((str(r.doc_id), (r.text or "")[:2]) for r in drop_near_copies(docs).collect())
    assert stay == [("3", "a0"), ("3", "b0"), ("4", ""), ("None", ""), ("None", "lo")]


def brute_components(rows, num=85, den=100):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_fixture():
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows, i = [], 0
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.choice([3, 6, 60, 150]))]
        for _ in range(r.choice([1, 2, 6])):
            text = list(base)
            for _ in range(r.randint(0, 4)):
                text[r.randrange(len(text))] = r.choice(words)
            rows.append((i, " ".join(text)))
            i += 1
    base = [r.choice(words) for _ in range(120)]  # a crowd of near copies, many of them not linked to each other
    for _ in range(150):
        text = list(base)
        for _ in range(r.randint(0, 3)):
            text[r.randrange(len(text))] = r.choice(words)
        rows.append((i, " ".join(text)))
        i += 1
    return rows


def test_near_components_match_brute_force(spark):
    rows = near_fixture()
    found = near_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(rows)


def matrix_components(rows, num, den):
    """Components by all pairs, counted with a product of 0/1 matrices."""
    sets = [shingle_set(t) for _, t in rows]
    column = np.unique(np.concatenate(sets), return_inverse=True)[1]
    held = np.zeros((len(sets), column.max() + 1), dtype=np.float32)
    held[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), column] = 1
    both, size = held @ held.T, held.sum(axis=1)
    linked = (both > 0) & (den * both >= num * (size[:, None] + size - both))
    label = np.arange(len(sets))
    while True:
        near = np.where(linked, label[None, :], len(sets)).min(axis=1)
        if (near == label).all():
            return {rows[i][0]: rows[label[i]][0] for i in range(len(rows))}
        label = near


def chained_copies(n, seed=11):
    """A crowd of chains: each text is a former one, a few words changed, so that the ends of a chain are far apart."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    texts = [[r.choice(words) for _ in range(140)] for _ in range(3)]
    while len(texts) < n:
        text = list(texts[r.randrange(max(0, len(texts) - 400), len(texts)) if r.random() < 0.5 else r.randrange(3)])
        for _ in range(r.randint(0, 5)):
            text[r.randrange(len(text))] = r.choice(words)
        if r.random() < 0.2:
            del text[-r.randint(1, 15) :]
        texts.append(text if len(text) > 20 else [r.choice(words) for _ in range(140)])
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("num, bands", [(80, 40), (85, 26)])
def test_chained_copies_match_all_pairs(spark, num, bands):
    rows = chained_copies(2000)
    found = near_components(spark.createDataFrame(rows, "doc_id long, text string"), similarity=(num, 100), n_bands=bands)
    assert {r.doc_id: r.component_id for r in found.collect()} == matrix_components(rows, num, 100)


def test_near_components_on_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = near_components(docs, similarity=(80, 100), n_bands=40)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(rows, 80)


def test_near_components_on_odd_rows(odd):
    rows = {(r.doc_id): r for r in near_components(odd).collect()}
    assert [rows[i].n_shingles for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1]
    assert rows[1].component_id == 1 and rows[2].kept and rows[5].component_id == 4 and not rows[5].kept
    assert rows[None].component_id is None and rows[None].kept
    assert drop_near_copies(odd).columns == odd.columns and near_components(odd.limit(0)).count() == 0


def test_signature_estimates_similarity():
    r = np.random.default_rng(1)
    for share in (0.5, 0.8):
        both = r.integers(0, 2**63, int(1000 * share), dtype=np.uint64)
        rest = r.integers(0, 2**63, (2, int(1000 * (1 - share) / 2)), dtype=np.uint64)
        a, b = (signature(np.concatenate([both, x]), 2000) for x in rest)
        assert abs((a == b).mean() - share) < 0.05
    assert len(shingle_set("A b c d e f")) == 2 and (shingle_set("A B") == shingle_set("a\tb")).all()


@pytest.fixture(scope="module")
def coder():
    import public_tokenizers as p

    with open(p.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return bpe.Coder(f.read(), p.PATTERN)


def test_bpe_matches_the_library(coder):
    import public_tokenizers as p
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    r = random.Random(2)
    signs = ["a", "b", "the", "é", "ß", " ", "\n", "\x1c", "\x85", "\xa0", "1", "'s", "!", "漢", "🙂", "\t", "ing", "aa", "<|endoftext|>"]
    for n in [3] * 200 + [40] * 200 + [400] * 50:
        text = "".join(r.choice(signs[: r.randint(2, len(signs))]) for _ in range(n)).replace(" ", "" if r.random() < 0.4 else " ")
        ids = np.frombuffer(coder.encode(text), "<u4").tolist()
        assert ids == library.encode_ordinary(text)
        assert coder.decode(coder.encode(text)) == text.encode()
    long = "ab" * 4000 + "!" * 3000
    assert np.frombuffer(coder.encode(long), "<u4").tolist() == library.encode_ordinary(long)


def test_bpe_joins_halves_anywhere(coder):
    for text in (b"internationalisation", b"aaaaaaaaaaaaaaaaaaaaaaaaaaa", "éééßßß漢漢".encode()):
        for i in range(len(text) + 1):
            halves = [coder.encode_piece(x) for x in (text[:i], text[i:])]
            assert coder.join(*halves) == coder.merge(text)


def test_bpe_columns(spark, odd):
    import public_tokenizers as p

    made = bpe.ByteBPE(spark, p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN)
    rows = bpe.encoded(odd, made).withColumn("ids", made.encode(F.col("text"))).withColumn("back", made.decode(F.col("ids"))).collect()
    for r in rows:
        assert (r.text or "") == bytes(r.decoded).decode() == r.back and r.n_tokens == len(r.ids)
        assert bytes(r.token_ids) == np.array(r.ids, "<u4").tobytes()
    assert bpe.encoded(odd.limit(0), made).count() == 0


def test_language_model_is_exact():
    """Code lengths against a plain walk down the contexts."""
    texts = [("a", "banana bandana"), ("b", "xyzzy plugh banana")]
    counts = Counter()
    for lang, t in texts:
        data = [10] * langid.ORDER + list(t.encode())
        for i in range(langid.ORDER, len(data)):
            for d in range(langid.ORDER + 1):
                counts[lang, tuple(data[i - d : i]), data[i]] += 1
    langs = ["a", "b"]
    packed = [(langs.index(k[0]), len(k[1]), int.from_bytes(bytes([*k[1], k[2]]), "big"), n) for k, n in counts.items()]
    arrays = dict(zip(("lang", "depth", "gram", "n"), (np.array(x, np.int64) for x in zip(*packed)), strict=True))
    scorer = langid._Scorer(langid.Model(langs, arrays))

    def bits(lang, context, symbol):
        seen = {s: n for (x, c, s), n in counts.items() if x == lang and c == context}
        if symbol in seen:
            return -math.log2(seen[symbol] / (sum(seen.values()) + len(seen)))
        shorter = bits(lang, context[1:], symbol) if context else 8.0
        return shorter - (math.log2(len(seen) / (sum(seen.values()) + len(seen))) if seen else 0)

    for text in ("banana plugh", "zzz bandage", "é"):
        data = [10] * langid.ORDER + list(text.encode())
        want = [sum(bits(lang, tuple(data[i - langid.ORDER : i]), data[i]) for i in range(langid.ORDER, len(data))) for lang in langs]
        assert np.allclose(scorer.lengths([text])[0], want, rtol=1e-5)


def test_language_spans_add_up(monkeypatch):
    arrays = {k: np.array(v, np.int64) for k, v in {"lang": [0, 1], "depth": [0, 0], "gram": [97, 98], "n": [3, 4]}.items()}
    scorer = langid._Scorer(langid.Model(["x", "y"], arrays))
    texts = ["ab" * 700, None, "b", "a" * 900]
    whole = scorer.lengths(texts)
    monkeypatch.setattr(langid, "_SPAN", 256)
    assert np.allclose(scorer.lengths(texts), whole)


def plain_code_lengths(training, texts, langs):
    """PPM by dictionaries: bits of each text by language, escaping from order 4 down to eight bits a byte."""
    seen = {}
    for lang, text in training:
        data = b"\n" * langid.ORDER + text.lower().encode("utf-8", "surrogatepass")
        for i in range(langid.ORDER, len(data)):
            for d in range(langid.ORDER + 1):
                seen.setdefault((lang, data[i - d : i]), Counter())[data[i]] += 1
    facts = {key: (c, sum(c.values()), len(c)) for key, c in seen.items()}
    out = []
    for text in texts:
        data = b"\n" * langid.ORDER + text.lower().encode("utf-8", "surrogatepass")
        row = []
        for lang in langs:
            total = 0.0
            for i in range(langid.ORDER, len(data)):
                for d in range(langid.ORDER, -1, -1):
                    counts, n, distinct = facts.get((lang, data[i - d : i]), ({}, 0, 0))
                    if data[i] in counts:
                        total -= math.log2(counts[data[i]] / (n + distinct))
                        break
                    total -= math.log2(distinct / (n + distinct)) if n else 0
                else:
                    total += 8
            row.append(total)
        out.append(row)
    return out


def test_languages_match_a_plain_coder(spark, docs):
    """The whole query on a small table, the sample holding all of the training rows."""
    short = docs.where("lang is not null and length(text) between 1 and 1500").select("doc_id", "text", "lang")
    fold = langid.held_out("doc_id", 5, 0)
    model = langid.train(short.where(~fold), sample=10**9)
    rows = short.withColumn("fold", fold).collect()
    tested = [r for r in rows if r.fold and any(map(str.isalpha, r.text))]
    want = plain_code_lengths([(r.lang, r.text) for r in rows if not r.fold], [r.text for r in tested], model.langs)
    got = {r.doc_id: r for r in langid.predict(short.where(fold), model).collect()}
    assert len(tested) > 10
    for r, bits in zip(tested, want, strict=True):
        low = min(bits)
        assert got[r.doc_id].lang_pred == model.langs[bits.index(low)]
        assert math.isclose(got[r.doc_id].bits_per_byte, low / len(r.text.lower().encode()), rel_tol=1e-4)


def test_two_models_in_one_session(spark):
    """Workers that stay score with the model at hand."""
    rows = spark.createDataFrame([(i, "aaaa" if i % 2 else "bbbb", "x" if i % 2 else "y") for i in range(40)], "doc_id long, text string, lang string")
    other = rows.withColumn("lang", F.when(F.col("lang") == "x", "y").otherwise("x"))
    for _ in range(2):
        for labelled in (rows, other):
            want = {r.doc_id: r.lang for r in labelled.collect()}
            assert {r.doc_id: r.lang_pred for r in langid.predict(rows, langid.train(labelled)).collect()} == want


def test_language_accuracy_and_odd_rows(spark, docs, odd):
    fold = langid.held_out("doc_id", 5, 0)
    model = langid.train(docs.where(~fold))
    found = langid.predict(docs, model).where(fold).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("ok")).first()
    assert found.ok >= 0.95
    rows = langid.predict(odd.withColumn("score", F.lit("clash")), model).collect()
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"} and all(0 <= r.score <= 1 for r in rows)
    nothing = langid.train(odd.limit(0))
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"} and langid.predict(odd.limit(0), model).count() == 0


def test_toxicity_learns_words_and_scores_long_texts():
    r = random.Random(3)
    words = [f"{a}{b}" for a in ("ba", "do", "ki", "mu") for b in ("la", "re", "ti", "so", "ne")]
    texts = [" ".join(r.choice(words) for _ in range(60)) for _ in range(300)]
    y = np.array([i % 3 == 0 for i in range(300)], dtype=np.float32)
    texts = [t.replace(" ", r.choice([" scum ", " vejuaire "]), 1) if k else t for t, k in zip(texts, y, strict=True)]
    net = toxicity.fit(texts[:200], y[:200])
    w = toxicity.Words()
    scores = net.scores(net.pooled(w, [w.ids(t) for t in texts[200:]]))
    assert ((scores >= 0.7) == (y[200:] > 0)).mean() >= 0.97
    long = " ".join(["bala"] * (toxicity._SPAN + 50))
    clean, toxic = (net.scores(net.pooled(w, [w.ids(t)]))[0] for t in (long, long + " vejuette scum"))
    assert clean < 0.7 <= toxic


def test_toxicity_frames(spark, docs, odd, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    net = toxicity.train(docs, labels, sample=200)
    rows = toxicity.score(odd.withColumn("toxicity", F.lit("clash")), net).collect()
    assert len(rows) == len(ODD) and all(0 <= r.toxicity <= 1 for r in rows)
    assert toxicity.score(odd.limit(0), net).count() == 0
    untrained = toxicity.train(docs.limit(0), labels)
    assert all(r.toxicity < 0.7 for r in toxicity.score(odd, untrained).collect())


def plain_scores(net, texts):
    """The network word by word: mean of three rows, every filter at every place, largest response."""
    out = []
    for text in texts:
        words = [w for w in ("".join(c for c in w if c.isalnum()) for w in (text or "").lower().split()) if w]
        rows = [[1 + zlib.crc32(k.encode()) % (toxicity.BUCKETS - 1) for k in (f"w:{w}", f"4:{w[:4]}", f"6:{w[:6]}")] for w in words]
        vectors = [net.emb[r].astype(float).mean(axis=0) for r in rows] + [np.zeros(toxicity.DIM)] * (max(toxicity.WIDTHS) - 1)
        pooled = []
        for kernel in net.filters:
            for f in range(toxicity.FILTERS):
                best = -math.inf
                for i in range(len(vectors)):
                    best = max(best, sum(float(vectors[i + j] @ kernel[j, :, f]) for j in range(len(kernel)) if i + j < len(vectors)))
                pooled.append(max(0.0, best + float(net.bias[len(pooled)])))
        z = float(np.dot(pooled, net.out.astype(float)) + net.base)
        out.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
    return out


def test_toxicity_query_matches_a_plain_forward_loop(spark, docs, data):
    fold = langid.held_out("doc_id", 3, 1)
    labels = spark.read.parquet(f"{data}/labels.parquet")
    net = toxicity.train(docs.where(~fold), labels.where(~fold))
    rows = {r.doc_id: r.text for r in docs.where("length(text) < 4000 or text is null").collect()}
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, net).collect() if r.doc_id in rows}
    assert len(got) > 100 and np.allclose([got[i] for i in rows], plain_scores(net, rows.values()), atol=1e-5)


def test_toxicity_words_and_steps_without_sorting():
    """Rows of words as they are defined, and tables of numbers as np.unique makes them."""
    words = toxicity.Words()
    texts = ["A b_ñandú, b_ñandú! ___ \ud800x ½ e\u0301a ²", None, "", "-- abcdefgh b_ñandú 12345678", "___"]
    for text in texts:
        plain = [re.sub(r"[\W_]+", "", w) for w in (text or "").lower().split()]
        plain = [b for b in plain if b]
        want = [[1 + zlib.crc32(k.encode("utf-8", "surrogatepass")) % (toxicity.BUCKETS - 1) for k in (f"w:{b}", f"4:{b[:4]}", f"6:{b[:6]}")] for b in plain]
        ids = words.ids(text)
        assert words.rows[ids].tolist() == want if want else ids == []
    r = np.random.default_rng(3)
    for ids in (r.integers(0, 50, 400), r.integers(0, 1000, (70, 3)), np.zeros(4, dtype=np.int32)):
        used, at = toxicity.distinct(ids)
        plain, back = np.unique(ids, return_inverse=True)
        assert np.array_equal(used, plain) and np.array_equal(at, back.reshape(ids.shape))


def test_toxicity_gradients():
    """Analytic gradients against differences of the loss, in double precision."""
    r = np.random.default_rng(3)
    net, words = toxicity.Network(), toxicity.Words()
    for name in ("emb", "bias", "out"):
        setattr(net, name, getattr(net, name).astype(float) + r.normal(0, 0.2, getattr(net, name).shape))
    net.filters, net.base = [k.astype(float) for k in net.filters], float(net.base)
    net.emb[0] = 0
    texts = ["you are a fool", "what a lovely day it is", "fool", "a day"]
    y = np.array([1.0, 0, 1, 0])
    batch = [np.array(words.ids(t) + [0] * (max(toxicity.WIDTHS) - 1)) for t in texts]

    def loss():
        total = 0.0
        for ids, label in zip(batch, y, strict=True):
            v = net.emb[words.rows[ids]].mean(axis=1)
            pooled = []
            for kernel in net.filters:
                z = [sum(v[i + j] @ kernel[j] for j in range(len(kernel)) if i + j < len(v)) for i in range(len(v))]
                pooled += list(np.max(z, axis=0))
            p = net.scores(np.maximum(np.array(pooled) + net.bias, 0)[None, :])[0]
            total -= label * np.log(p) + (1 - label) * np.log(1 - p)
        return total / len(batch) + 1e-4 / 2 * (net.out**2).sum()

    grads, base, rows, word_grad = toxicity.gradients(net, words.rows, batch, y)
    for param, grad in zip([*net.filters, net.bias, net.out], grads, strict=True):
        for at in list(np.ndindex(param.shape))[:: max(1, param.size // 12)]:
            held, param[at] = param[at], param[at] + 1e-6
            up = loss()
            param[at] = held - 1e-6
            down = loss()
            param[at] = held
            assert math.isclose((up - down) / 2e-6, grad[at], rel_tol=1e-3, abs_tol=1e-6)
    row = rows[1][0]  # one row of one word's three
    want = word_grad[(rows == row).any(axis=1)].sum(axis=0) / 3
    for k in range(toxicity.DIM):
        held, net.emb[row, k] = net.emb[row, k], net.emb[row, k] + 1e-6
        up = loss()
        net.emb[row, k] = held - 1e-6
        down = loss()
        net.emb[row, k] = held
        assert math.isclose((up - down) / 2e-6, want[k], rel_tol=1e-3, abs_tol=1e-6)


def test_classifiers_on_held_out_rows(spark):
    """Toxicity and quality of labelled rows that took no part in training, among 4,000 labels."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    fold = langid.held_out("doc_id", 3, 1)
    held = labels.where(fold)
    tox = toxicity.score(docs, toxicity.train(docs.where(~fold), labels.where(~fold))).join(held, "doc_id").where("toxic is not null")
    found = tox.agg(F.avg((F.col("toxicity") >= 0.7).cast("int")).alias("all"), F.avg(F.when(F.col("toxic") == 1, (F.col("toxicity") >= 0.7).cast("int"))).alias("caught"),
                    F.avg(F.when(F.col("toxic") == 0, (F.col("toxicity") < 0.7).cast("int"))).alias("left")).first()
    assert found.caught >= 0.8 and found.left >= 0.98
    net = quality.train(docs, labels.where(~fold))
    good = quality.judged(docs, net, quality.site_means(docs, net)).join(held, "doc_id").where("quality is not null")
    assert good.agg(F.avg((F.col("quality_kept") == (F.col("quality") == 1)).cast("int"))).first()[0] >= 0.97


def test_thresholds_split_each_language():
    cut = toxicity.thresholds(np.array([0.9, 0.6, 0.4, 0.2, 0.5]), np.array([1, 1, 0, 0, 1]), ["a", "a", "a", "a", "b"])
    assert 0.4 < cut["a"] < 0.6 and cut["b"] == 0.7


def test_quality_posterior_matches_brute_force(spark, docs, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    net = quality.train(docs, labels)
    sites = quality.site_means(docs, net)
    got = {r.doc_id: r for r in quality.judged(docs, net, sites).collect()}
    rows = docs.select("doc_id", "text", "source", "lang").collect()
    e = {r.doc_id: float(net.evidence(quality.features(r.text)[None])[0]) for r in rows}
    p = {i: 1 / (1 + math.exp(-v)) for i, v in e.items()}

    def sums(key):
        out = {}
        for r in rows:
            s, n = out.get(key(r), (0.0, 0))
            out[key(r)] = s + p[r.doc_id], n + 1
        return out

    def pseudo_count(groups, around):
        if len(groups) < 2:
            return 1.0
        total = sum(n for _, n in groups.values())
        v = sum(around(k) * (1 - around(k)) for k in groups) / len(groups)
        spread = max((sum(n * (s / n - around(k)) ** 2 for k, (s, n) in groups.items()) - v * len(groups)) / total, 1e-6)
        return min(max(v / spread - 1, 1.0), 1e6)

    by_host, by_path = sums(lambda r: r.source), sums(lambda r: (r.source, r.lang))
    mean = sum(p.values()) / len(p)
    kappa_host = pseudo_count(by_host, lambda k: mean)
    host_mean = {k: (s + kappa_host * mean) / (n + kappa_host) for k, (s, n) in by_host.items()}
    kappa = pseudo_count(by_path, lambda k: host_mean[k[0]])
    assert sites.kappa == pytest.approx(kappa, rel=1e-6) and sites.mean == pytest.approx(mean, rel=1e-9)
    for r in rows:
        total, n = by_path[r.source, r.lang]
        mean = (total - p[r.doc_id] + kappa * host_mean[r.source]) / (n - 1 + kappa)
        assert got[r.doc_id].site_mean == pytest.approx(mean, rel=1e-6)
        assert got[r.doc_id].quality_score == pytest.approx(1 / (1 + math.exp(-e[r.doc_id] - math.log(mean / (1 - mean)))), rel=1e-6)
    wrong = labels.join(quality.judged(docs, net, sites), "doc_id").where(F.col("quality") != F.col("quality_kept").cast("int")).count()
    assert wrong <= 0.02 * labels.count()


def test_pipeline_holds_one_worker_a_task_and_the_caches_of_one_stage(spark, docs, data):
    import public_tokenizers

    kept = corpus_pipeline.keep_good(spark, docs, data)
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1  # two would hold two workers a task
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        shared = type("Shared", (), {"value": f.read()})
    coder = bpe._coder(shared, public_tokenizers.PATTERN)
    assert bpe._coder(shared, public_tokenizers.PATTERN) is coder and set(common._KEPT) == {"bpe"}
    shingle_set("some words of a text")
    assert set(common._KEPT) == {"minhash"} and len(common._KEPT["minhash"]) == 5  # the coder is gone
    common._KEPT.clear()


def test_quality_on_odd_rows(spark, odd, data):
    labels = spark.createDataFrame([(4, 1), (8, 0), (None, 1)], "doc_id long, quality int")
    net = quality.train(odd, labels)
    rows = quality.judged(odd.withColumn("evidence", F.lit("clash")), net, quality.site_means(odd, net)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.quality_score <= 1 for r in rows)
    assert all(r.evidence == 0 for r in rows if not r.text)
    none = quality.train(odd.limit(0), labels)
    assert quality.judged(odd.limit(0), none, quality.site_means(odd.limit(0), none)).count() == 0


def test_main_text_of_pages(spark, data):
    for r in spark.read.parquet(f"{data}/pages.parquet").limit(60).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert html_text.main_text(r.html) == "\n".join(x for x in parts if x)


def test_main_text_leaves_the_frame_out():
    page = """<body><header><h2>Site</h2></header><div id="cookie-notice">We use cookies for this and for that.</div><main><article>
    <header><h1>Title</h1><span>By Ann</span></header><p>This is the first paragraph of a story and it is about what was in the town &amp; more.
    <div class="ad">Buy the best of all.</div><p>Short.</p><form><label>Name</label></form><script>var x = "<p>no</p>"</script>
    <section class="comments"><article><p>I like this story and the town that it is in.</p></article></section></article></main><footer>end</footer>"""
    want = "Title\nThis is the first paragraph of a story and it is about what was in the town & more.\nShort."
    assert html_text.main_text(page) == want


PROSE = "The cat is on the mat and that was it for all of us in the house with the dog. " * 4
PAGE = f"<article><h1>Title</h1><p>{PROSE}</p>%s<p>He said that it was not for them to be there. {PROSE}</p></article>"


@pytest.mark.parametrize(
    "inside, kept, lost",
    [
        ('<p title="a hidden gem">This is the gem of the whole story, and it has to stay for all to read.</p>', "gem of the whole", None),
        (f'<p data-props="{"a" * 9000}>y">This is the text that has to stay.</p>', "This is the text", 'y"'),
        (f'<p class="ad">{"<b>" * 14}buy now<div>This block is the next one and it has to be kept on the page.</div>', "the next one", "buy now"),
        ("<p>© is a sign that the law of many countries knows, and this is what the text is about.</p>", "© is a sign", None),
        ('<div class="search-of-truth"><p>This is what they found, and it was not what they had hoped for.</p></div>', "what they found", None),
        (f'<div class="legal"><p>{PROSE}Law.</p></div>', "Law.", None),
        (f'<div class="comments"><p>{PROSE}I disagree.</p></div>', None, "I disagree"),
        ('<div class="cookie-notice">We use them and you have to say yes to all of it.</div>', None, "We use"),
        ('<svg viewBox="0 0 1 1"/><p>After the picture there is text that is part of the article.</p>', "After the picture", None),
        ("<p hidden>Not for the eyes of those who read this page.</p>", None, "Not for the eyes"),
        ("<p data-hidden=1 style='color:red'>For the eyes of those who read this page.</p>", "For the eyes", None),
        ("<noscript>Turn it on to see all of this.<p>And what is after it is kept, as it was in the text.</p>", "what is after", None),
    ],
)
def test_article_text_is_kept_and_frames_are_not(inside, kept, lost):
    found = html_text.main_text(PAGE % inside)
    assert found.startswith("Title\nThe cat") and found.endswith("with the dog.") and "He said that" in found
    assert (kept is None or kept in found) and (lost is None or lost not in found)


def test_unclosed_head_ends_at_the_first_tag_of_the_body():
    assert html_text.main_text(f"<html><head><title>No</title><meta charset=utf-8><p>{PROSE}</p>") == PROSE.strip()


@pytest.mark.parametrize("bad", ['<a "', "<!--", "<b></i>", "<p a='", "<noscript>", "<", "<p>", "<div><p><b>", "<script></script ", "<td></p>", "&amp", "<a b='"])
def test_broken_markup_takes_linear_time(bad):
    def seconds(n):
        began = time.perf_counter()
        html_text.main_text(bad * n)
        return time.perf_counter() - began

    assert seconds(40_000) < 16 * max(0.05, seconds(10_000))


class Reference(HTMLParser):
    """Text outside scripts and styles, by the standard library's tokenizer."""

    def __init__(self):
        super().__init__()
        self.found, self.raw = [], 0

    def handle_starttag(self, tag, attrs):
        self.raw += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.raw -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.raw:
            self.found.append(data)


def test_tokens_match_the_standard_parser(spark, data):
    for row in spark.read.parquet(f"{data}/pages.parquet").collect():
        reference = Reference()
        reference.feed(row.html or "")
        reference.close()
        mine = [html.unescape(text) for text, name, _ in html_text._Scanner(row.html or "").tokens() if name is None]
        assert "".join("".join(mine).split()) == "".join("".join(reference.found).split())


def test_extraction_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "<p>a < b <p"), (4, "<" * 2000), (5, "<div " + "a='" * 500), (6, "<p>" + "the town is in it " * 20000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "page_id long, html string, text string")
    got = {r.page_id: r for r in html_text.extracted(df, with_blocks=True).collect()}
    assert len(got) == 6 and got[1].text == got[2].text == "" and got[1].n_chars == 0
    assert got[6].n_chars == len(("the town is in it " * 20000).strip()) and got[6].blocks[0].good
    assert html_text.extracted(df.limit(0)).count() == 0


LINK = "A paragraph that is one link and runs on for more than seventy characters in all"


@pytest.mark.parametrize(
    "inside,want",
    [
        ("<p>before <span class='ad'>BUYNOW</span> after {p}</p>", "before after {p}"),
        ("<p>{p} <span hidden>SECRET</span></p>", "{p}"),
        ("<p>{p} <svg><text>ICON</text></svg></p>", "{p}"),
        ("<p>{p} <video>no video here</video>end</p>", "{p} end"),
        ("<p>Real text. {p} <span class='ad'>x</p><p>{p} two</p>", "Real text. {p}\n{p} two"),
        ("<p>before <label>Pick <select><option>a<option>b</select></label> after {p}</p>", "before after {p}"),
        ("<p>{p} <button>Send</button>and more</p>", "{p} and more"),
        ("<p>{p}</p><div class='reader-comments'><p>{p}</p></div>", "{p}"),
        ("<p>{p}</p><div class='user-comments'><p>{p}</p></div>", "{p}"),
        ("<p>{p}</p><div class='ad-300x250'><p>{p}</p></div>", "{p}"),
        ("<div class='story with-sidebar has-comments'><p>{p}</p></div>", "{p}"),
        ("<p>{p}</p><ul><li><a href='x'>Another story that you may like to read now</a></li><li><a href='y'>One more story of this kind for you</a></li></ul>", "{p}"),
    ],
)
def test_inline_parts_marks_and_links(inside, want):
    for page in (f"<html><body><article>{inside}</article></body></html>", f"<html><body>{inside}</body></html>"):
        assert html_text.main_text(page.replace("{p}", PROSE.strip())) == want.replace("{p}", PROSE.strip())


def test_a_lone_link_stays_inside_an_article():
    assert html_text.main_text(PAGE % f"<p><a href='x'>{LINK}</a></p>").split("\n")[2] == LINK
    assert LINK not in html_text.main_text(f"<article><p>{PROSE}</p><p><a href='x'>{LINK}</a></p></article>")


def test_a_claim_stays_where_text_follows():
    prose = PROSE.strip()
    page = f"<body><p>{prose}</p><p>© marks a work whose rights are held. {prose}</p><p>{prose}</p><p>© 2024 The Site. All rights are reserved. {prose}</p></body>"
    assert html_text.main_text(page) == f"{prose}\n© marks a work whose rights are held. {prose}\n{prose}"


def test_edited_texts_and_fingerprints(docs):
    lex = imatch.lexicon(docs)
    rows = imatch.edited_pairs(docs, lex).orderBy("doc_id").collect()
    texts = [r.text or "" for r in docs.orderBy("doc_id").select("text").collect()]
    prints = {}
    for i, (r, t) in enumerate(zip(rows, texts, strict=True)):
        n, after = len(t) // 4, texts[(i + 1) % len(texts)]
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest() and r.n_chars == len(t)
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    assert np.mean([r.near_edited for r in rows]) > np.mean([r.near_next for r in rows]) + 0.2


def test_lexicon_counts_documents(docs):
    seen = Counter(t for r in docs.select("text").collect() for t in imatch.terms(r.text))
    n = docs.count()
    want = [t for t, c in seen.items() if max(2, 0.02 * n) <= c <= 0.5 * n]
    assert imatch.lexicon(docs, low=0.02, high=0.5) == sorted(want)


@pytest.mark.parametrize("per_block", [2, 3, 1000])
def test_next_document(spark, docs, per_block):
    some = docs.limit(40)
    got = {r.id: r.next_text for r in imatch.with_next(some, per_block=per_block).collect()}
    rows = some.orderBy("doc_id").select("doc_id", "text").collect()
    assert got == {r.doc_id: rows[(i + 1) % len(rows)].text for i, r in enumerate(rows)}


def test_fingerprints_on_odd_rows(odd):
    lex = imatch.lexicon(odd)
    assert imatch.edited_pairs(odd, lex).count() == len(ODD) and imatch.edited_pairs(odd.limit(0), lex).count() == 0
    assert imatch.likeness("0" * 2048, "0" * 2048) == 1.0


def test_texts_outside_the_lexicon_are_told_apart():
    printer = imatch.Printer(imatch.Lexicon.of(["known", "word", "four", "more", "terms"]))
    rare = " ".join(f"rare{i}" for i in range(40))
    texts = ["This.", "Re.", "Lllldoado.", "!!! ???", "... ---", "known this", "known that", rare, " ".join(f"odd{i}" for i in range(40))]
    prints = [printer.fingerprint(t) for t in texts]
    assert "0" * 2048 not in prints
    for a, b in itertools.combinations(prints, 2):
        assert imatch.likeness(a, b) < 0.8
    assert max(imatch.likeness(a, b) for a, b in itertools.combinations(prints[:5], 2)) == 0
    assert imatch.likeness(prints[-2], prints[-1]) == 0 and imatch.likeness(prints[0], printer.fingerprint("this")) == 1
    assert imatch.likeness(printer.fingerprint(rare), printer.fingerprint(rare.replace("rare39", "new"))) > 0.8
    assert {printer.fingerprint(t) for t in (None, "", " \n")} == {"0" * 2048}


def plain_print(text, lex, seed=1):
    """(rate, subset) to the set of terms, of both halves, by the definition."""
    found = imatch.terms(text)
    known = {t for t in found if t in lex}
    rest = found - known or ({"".join((text or "").split())} - {""} if not found else set())
    halves = []
    for some, n in ((known, imatch.SUBSETS), (rest, imatch.SUBSETS)):
        held = {}
        for t in some:
            value = imatch._values([t])
            finest = (imatch._slots(value, seed, n) if some is known else imatch._other_slots(value, seed))[0]
            for s in range(n):
                for rate in range(int(finest[s]) // n + 1):
                    held.setdefault((rate, s), set()).add(t)
        halves.append((held, n))
    return halves


def plain_likeness(a, b):
    total = weights = 0.0
    for (x, n), (y, _), w in zip(a, b, (imatch.WEIGHT, 1)):
        best = size = 0.0
        for rate in range(imatch.RATES if w == imatch.WEIGHT else imatch.OTHER_RATES):
            some = [s for s in range(n) if (rate, s) in x or (rate, s) in y]
            same = [s for s in some if x.get((rate, s)) == y.get((rate, s))]
            size += len(some) / n
            if 2 * len(some) >= n:
                best = max(best, len(same) / len(some))
        m = w * (2**size - 1)
        total, weights = total + m * best, weights + m
    return total / weights


def test_likeness_matches_sets_of_terms(docs):
    lex = imatch.lexicon(docs)
    known, printer = set(lex), imatch.Printer(imatch.Lexicon.of(lex))
    texts = [r.text for r in docs.orderBy("doc_id").limit(40).collect()] + ["This.", "!!! ???", "known this", " ".join(lex[:3]), " ".join(lex[:4])]
    pairs = list(zip(texts, texts[1:])) + [(t, t[: len(t) * 3 // 4] + " other words") for t in texts]
    for a, b in pairs:
        if printer.fingerprint(a) == printer.fingerprint(b):
            assert plain_print(a, known) == plain_print(b, known)
        else:
            assert imatch.likeness(printer.fingerprint(a), printer.fingerprint(b)) == pytest.approx(plain_likeness(plain_print(a, known), plain_print(b, known)), abs=0.02)


def test_no_number_of_lexicon_terms_changes_the_likeness_of_near_copies():
    lex = [f"term{i}" for i in range(50)]
    printer = imatch.Printer(imatch.Lexicon.of(lex))
    others = [f"other{i}" for i in range(60)]
    for n in range(12):
        text = " ".join(lex[:n] + others)
        more, word = (imatch.likeness(printer.fingerprint(text), printer.fingerprint(f"{text} {w}")) for w in (lex[n], "new"))
        assert more > 0.75 and word > 0.75


@pytest.mark.parametrize("n,per_block", [(5000, 1000), (300, 7)])
def test_ids_may_be_text(spark, n, per_block):
    some = spark.range(n).select(F.concat(F.lit("d"), F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.lit("own").alias("fingerprint_text"))
    got = {r.id: r.next_text for r in imatch.with_next(some, per_block=per_block).collect()}
    order = sorted(got)
    assert len(order) == n and all(got[a] == f"text {b[1:]}" for a, b in zip(order, order[1:] + order[:1]))
    assert imatch.fingerprints(some.limit(3), ["text"]).select("fingerprint_text").where("fingerprint_text = 'own'").count() == 0


def test_queries_leave_the_session_alone(spark, data):
    before = dict(spark.conf.getAll)
    for name in ("op9_html_extraction", "op10_fingerprints", "op11_simhash_near_dedup", "op13_vector_codes"):
        QUERIES[name](spark, data)
    assert dict(spark.conf.getAll) == before


def test_hypergeometric_law():
    r = random.Random(4)
    seen = Counter(sharding.hypergeometric(r, 12, 5, 4) for _ in range(20000))
    for k in range(5):
        p = math.comb(5, k) * math.comb(7, 4 - k) / math.comb(12, 4)
        assert abs(seen[k] / 20000 - p) < 0.015
    assert sharding.hypergeometric(r, 10, 0, 5) == 0 and sharding.hypergeometric(r, 10, 10, 5) == 5
    big = [sharding.hypergeometric(r, 10**9, 125 * 10**6, 10**6) for _ in range(50)]
    assert abs(np.mean(big) - 125000) < 300
    m = np.array(sharding.communication_matrix([3, 0, 8, 5], [4, 6, 6], 1))
    assert m.sum(axis=1).tolist() == [3, 0, 8, 5] and m.sum(axis=0).tolist() == [4, 6, 6] and (m >= 0).all()


def test_shards_are_exact_and_gapless(docs, odd, tmp_path):
    for df in (docs, odd):
        rows = sharding.shard_plan(df).collect()
        by = {}
        for r in rows:
            by.setdefault(r.shard, []).append(r.slot)
        assert len(rows) == df.count() and all(sorted(v) == list(range(len(v))) for v in by.values())
        sizes = [len(by.get(s, [])) for s in range(8)]
        assert max(sizes) - min(sizes) <= 1
    one = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_plan(docs).collect()}
    assert one == {r.doc_id: (r.shard, r.slot) for r in sharding.shard_plan(docs.repartition(7)).collect()}
    assert sharding.shard_plan(docs.limit(0)).count() == 0
    plan = sharding.shard_plan(docs)
    sharding.write_shards(docs, plan, str(tmp_path / "out"), rows_per_file=10)
    back = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.groupBy("shard", "run").count().agg(F.max("count")).first()[0] <= 10


def test_budgets_fill_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("a", "x", 10, 1), ("a", "y", 100, 1), ("b", "z", 1000, 1), ("b", "w", 1000, 1)], "d string, s string, supply long, n long"
    )
    got = {(r.d, r.s): r.budget for r in leaf_budgets(leaves, 160, ("d", "s"), {"s": {"w": 3.0}}).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 70, ("b", "z"): 20, ("b", "w"): 60}
    got = {(r.d, r.s): r.budget for r in leaf_budgets(leaves, 400, ("d", "s"), {"d": {"a": 3.0}}).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 145, ("b", "w"): 145}
    shut = {(r.d, r.s): r.budget for r in leaf_budgets(leaves, 100, ("d", "s"), {"d": {"b": 0.0}}).collect()}
    assert shut == {("a", "x"): 10, ("a", "y"): 90, ("b", "z"): 0, ("b", "w"): 0}


def test_mixing_takes_prefixes(docs, odd):
    rows = mixed(docs, share_of_supply=1.7, weights={"lang": {"en": 3.0}}, carry=("doc_id",), max_epochs=2).collect()
    total = docs.agg(F.sum(F.ceil(F.octet_length("text") / 4))).first()[0]
    assert abs(sum(r.take_tokens for r in rows) - 1.7 * total) <= 200
    assert len({(r.doc_id, r.epoch) for r in rows}) == len(rows)
    cut = Counter((r.lang, r.source) for r in rows if r.take_tokens < r.n_tokens)
    assert all(n == 1 for n in cut.values())
    assert {r.doc_id: r.take_tokens for r in mixed(docs, carry=("doc_id",)).collect()}.keys() == {r.doc_id for r in docs.select("doc_id").collect()}
    assert mixed(odd, share_of_supply=0.5).count() > 0 and mixed(odd.limit(0)).count() == 0


def test_queries_on_small_tables(spark, data):
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    for name in ("op2_language_id", "op3_sharding", "op5_minhash_near_dedup", "op6_byte_bpe", "op7_exact_dedup", "op8_quality", "op10_fingerprints"):
        assert QUERIES[name](spark, data).count() == n


def test_pipeline_stages(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    ids = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        kept = [r.doc_id for r in out.select("doc_id").collect()]
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        assert len(set(kept)) == len(kept) and set(kept) <= before
        if name == "near":
            want = brute_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 80)
            assert set(kept) == {i for i, (_, c) in want.items() if i == c}
        docs = spark.createDataFrame(out.collect(), out.schema)
        ids = set(kept)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert {r.doc_id for r in last} == ids
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(hashlib.sha256(texts[r.doc_id].encode()).hexdigest() == r.decoded_sha256 for r in last)


def test_mixing_stage_cuts_texts(spark, data):
    import corpus_pipeline

    texts = ["a" * 40, "\u00e9" * 9, "x\u20ac" * 9, "\U0001f600y" * 9, "abc"]
    rows = spark.createDataFrame([(t, n) for t in texts for n in (1, 2, 3)], "text string, n long")
    for r in rows.withColumn("cut", corpus_pipeline.prefix_text(F.col("text"), F.col("n"))).collect():
        assert r.cut == r.text.encode()[: 4 * r.n].decode(errors="ignore")
    docs = spark.createDataFrame([(i, "word " * 80, "en", "src1", 400) for i in range(1)], "doc_id long, text string, lang string, source string, n_chars long")
    (only,) = corpus_pipeline.mix(spark, docs, data).collect()
    assert only.text == ("word " * 80)[:360] and only.n_chars == 360


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """More rows of a label than any sample took, dealt to shards: a word that is in four of them only is known, and the start counts all rows."""
    r = random.Random(5)
    words = [f"{a}{b}" for a in ("ba", "do", "ki", "mu") for b in ("la", "re", "ti", "so", "ne")]
    rows = [(i, " ".join(r.choice(words) for _ in range(12)) + (" scum" if i % 3 == 0 else ""), "en" if i % 2 else "de") for i in range(9000)]
    rows = [(i, t.replace("scum", "vejuaire") if i in (0, 3, 6, 9) else t, lang) for i, t, lang in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    monkeypatch.setattr(toxicity, "SHARD", 2500)  # three shards
    starts, kept = [], toxicity.started
    monkeypatch.setattr(toxicity, "started", lambda seen, sizes, *more: starts.append((seen.copy(), sizes)) or kept(seen, sizes, *more))
    net = toxicity.train(docs, labels)
    seen, sizes = starts[-1]  # of the network of all rows
    assert sizes.tolist() == [6000, 3000]
    at = lambda w: 1 + zlib.crc32(f"w:{w}".encode()) % (toxicity.BUCKETS - 1)
    assert seen[:, at("scum")].tolist() == [0, 2996] and seen[:, at("vejuaire")].tolist() == [0, 4]
    found = toxicity.score(docs, net).join(labels, "doc_id")
    assert found.agg(F.avg(((F.col("toxicity") >= 0.7) == (F.col("toxic") == 1)).cast("int"))).first()[0] > 0.99
    assert found.where("toxic_in_lang = (toxic = 1)").count() > 0.99 * 9000 and set(net.thresholds) == {"en", "de"}
