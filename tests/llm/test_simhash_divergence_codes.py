"""SimHash components, the divergence audit and vector codes against brute force, and on odd input."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldloom.llm import codes, divergence, simhash
from fieldloom.llm.queries import QUERIES

ODD = [
    (1, None, "en", "s", "x"),
    (2, "", "en", "s", "x"),
    (3, " \t\n", None, None, None),
    (4, "one two", "en", "s", "x"),
    (4, "one two", "en", "s", "x"),
    (5, "One  two", "fr", "s", "x"),
    (None, "one two", "en", None, "x"),
    (6, "word " * 30000, "en", "t", "x"),
    (7, "word " * 29999 + "end ", "en", "t", "x"),
    (8, "\x1c \x85 ¿ ñ 😀 $$$", "es", "t", "x"),
]
CLASH = ("fingerprint", "component_id", "f", "c", "label", "kind", "key", "p", "a")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, kept string")
    return df.withColumns({c: F.lit("own") for c in CLASH})


# --- simhash


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, ids, bits=3):
    """Smallest id that each print reaches."""
    label = list(range(len(prints)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= bits:
            label[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, x in enumerate(ids):
        least[top(i)] = min(least.get(top(i), x), x)
    return [least[top(i)] for i in range(len(prints))]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 100, 8193, 8194, 8195, 20000])
def test_fingerprints_match_a_plain_count(n):
    rng = random.Random(n)
    text = " \x0b".join(rng.choice(["aé", "B", "cc", "d\x85"]) + str(rng.randrange(50)) for _ in range(n))
    assert simhash.fingerprint(text) == plain_print(text)


def test_simhash_components_match_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op11_simhash_near_dedup"](spark, data).collect()}
    prints = [plain_print(r.text) for r in rows]
    want = plain_components(prints, [r.doc_id for r in rows])
    assert len(got) == len(rows) and len(set(want)) < len(rows)
    for r, p, c in zip(rows, prints, want, strict=True):
        assert (got[r.doc_id].fingerprint, got[r.doc_id].component_id) == (f"{p:016x}", c)


def test_triples_and_fives_miss_no_pair():
    for bits in itertools.chain(itertools.combinations(range(0, 64, 8), 3), itertools.combinations(range(8), 2)):
        x = sum(1 << b for b in bits)
        same = {p for p in range(8) if not x >> (8 * p) & 0xFF}
        assert len(same) >= 5 and any(set(t) <= same for t in simhash.TRIPLES) and any(set(f) <= same for f in simhash.FIVES)


@pytest.mark.parametrize("crowd", [1, 4, 64])
def test_crowds_are_linked_exactly(spark, crowd):
    """Clouds of values around a few centres, chains among them, in postings of every size."""
    rng = random.Random(crowd)
    made = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(60):
            made.add(x)
            x = rng.choice(sorted(made))
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
                x ^= 1 << b
        y = rng.getrandbits(64)
        made.update(y ^ (1 << rng.randrange(24)) ^ (1 << rng.randrange(24)) for _ in range(60))  # three bytes only
    values = sorted(made)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "f long")
    from fieldloom.llm.common import Scratch
    from fieldloom.llm.minhash import components

    with Scratch(spark) as scratch:
        found = components(simhash.links(frame, 3, scratch, crowd))
        label = {r.id % (1 << 64): r.label for r in found.collect()}
    want = plain_components(values, list(range(len(values))))
    groups, plain = defaultdict(set), defaultdict(set)
    for v, c in zip(values, want, strict=True):
        plain[c].add(v)
        groups[label.get(v, ("alone", v))].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))
    assert max(map(len, plain.values())) > 4


@pytest.mark.parametrize("n", [500, 6000])
def test_neighbour_search_links_dense_values(n):
    values = np.sort(np.random.default_rng(n).choice(1 << 14, n, replace=False)).astype(np.uint64)
    free = (0, 1, 2)
    label = np.arange(n)
    links = list(simhash.linked(values, free, 1))
    for i, j in links:
        assert (int(values[i]) ^ int(values[j])).bit_count() == 1
        label[label == label[j]] = label[i]
    at = {int(v): i for i, v in enumerate(values)}
    for v, i in at.items():
        assert all(label[i] == label[at[v ^ (1 << b)]] for b in range(24) if v ^ (1 << b) in at)
    assert len(links) == n - len(set(label))


def test_simhash_on_odd_rows(odd):
    rows = simhash.simhash_components(odd).collect()
    assert len(rows) == len(ODD) and rows[0].asDict().keys() == {"doc_id", "fingerprint", "component_id", "kept"}
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert {by[i][0].fingerprint for i in (1, 2, 3)} == {"0" * 16} and {by[i][0].component_id for i in (1, 2, 3)} == {1}
    assert [r.component_id for i in (4, None, 5) for r in by[i]] == [4] * 4 and {r.kept for r in by[4]} == {True} and not by[None][0].kept
    assert by[6][0].fingerprint == f"{plain_print(ODD[7][1]):016x}" and by[6][0].component_id == by[7][0].component_id == 6
    assert simhash.simhash_components(odd.limit(0)).count() == 0
    nameless = simhash.simhash_components(odd.where("doc_id is null")).collect()
    assert [(r.component_id, r.kept) for r in nameless] == [(None, True)]
    texts = simhash.simhash_components(odd.withColumn("doc_id", F.col("doc_id").cast("string"))).collect()
    assert {r.component_id for r in texts if r.doc_id == "7"} == {"6"}
    with pytest.raises(ValueError):
        simhash.simhash_components(odd, bits=4)


# --- divergence


def plain_audit(rows, min_docs=30, smoothing=5, scale=10**9, top=50):
    import re

    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in word.findall(text)]
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = set()
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [s for g, s in counts if g == lang]

        def share(c, kept=kept):
            below = sum(c[u] for u in kept) + smoothing * len(kept)
            return {t: 1 + scale * (c[t] + smoothing) // below for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, s, "pair", o, v, i + 1) for i, (v, o) in enumerate(pairs)} | {(lang, s, "term", t, v, i + 1) for i, (v, t) in enumerate(terms[:top])}
    return out


@pytest.mark.parametrize("min_docs", [1, 3, 30])
def test_audit_matches_brute_force(spark, data, min_docs):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("lang", "source", "text")
    rows = rows.unionByName(spark.createDataFrame([("en", "none at all", "1 2 3"), ("xx", "s", "a"), ("xx", None, None), ("en", "tiny", "the")], rows.schema))
    got = divergence.audit(rows, min_docs=min_docs, top=7).collect()
    want = plain_audit([tuple(r) for r in rows.collect()], min_docs, top=7)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_audit_on_odd_rows(odd, spark):
    got = {tuple(r) for r in divergence.audit(odd, min_docs=1).collect()}
    assert got == plain_audit([(r[2], r[3], r[1]) for r in ODD], 1)
    assert ("fr", "s") not in {r[:2] for r in got if r[2] == "pair"}
    assert divergence.audit(odd.limit(0)).count() == 0
    none = divergence.audit(odd).collect()
    assert {(r.part, r.value) for r in none} == {("pair", 0)} and {r.source for r in none if r.lang == "en"} == {"", "s", "t"}


def test_audit_is_exact_for_large_counts(spark):
    big = 3 * 10**11  # times the scale this exceeds 64 bits
    row = spark.sql(f"select {big}L as n, {2 * big + 1}L as total, 7L as v")
    got = row.select(divergence._share(F.col("n"), F.col("total"), F.col("v"), 5, 10**9).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (big + 5) // (2 * big + 1 + 35)


# --- codes


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: (id, vector) of kept vectors, by id; codes, errors and books by plain integers."""
    import math

    x = [[math.floor(scale * c) for c in v] for _, v in rows]
    w = len(x[0]) // parts
    cut = [[r[p * w : (p + 1) * w] for p in range(parts)] for r in x]
    books = [[r[p] for r in cut[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            took = defaultdict(list)
            for r in cut:
                took[nearest(r[p], books[p])[1]].append(r[p])
            books[p] = [[sum(c) // len(took[j]) for c in zip(*took[j], strict=True)] if j in took else e for j, e in enumerate(books[p])]
    found = [[nearest(r[p], books[p]) for p in range(parts)] for r in cut]
    text = ",".join(str(c) for b in books for e in b for c in e)
    return ["".join(f"{j:02x}" for _, j in f) for f in found], [sum(d for d, _ in f) for f in found], hashlib.sha256(text.encode()).hexdigest()


def test_codes_match_plain_integers(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(9, 16))
    rows = [(i, [float(c) for c in base[i % 9] + 0.1 * rng.normal(size=16)], i % 4 or None) for i in range(150)]
    rows += [(150 + i, rows[i][1], None) for i in range(20)]
    coded, books = codes.compressed(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5))
    got = {r.id: r for r in codes.with_label_error(coded).collect()}
    code, error, sha = plain_codes([(i, v) for i, v, _ in rows])
    assert codes.digest(books) == sha and len(got) == len(rows)
    total = Counter()
    for (_, _, label), e in zip(rows, error, strict=True):
        total[label] += e
    for (i, _, label), c, e in zip(rows, code, error, strict=True):
        assert (got[i].code, got[i].error, got[i].label_error) == (c, e, total[label])


@pytest.mark.parametrize("width,size", [(1, 50), (3, 1000), (8, 3000), (8, 1 << 30), (8, 1 << 40)])
def test_filter_finds_the_nearest_entry(width, size):
    rng = np.random.default_rng(width)
    entries = rng.integers(-size, size, (16, width))
    entries[5] = entries[2]
    part = np.concatenate([rng.integers(-size, size, (200, width)), entries, entries + 1])
    at, d, tried = codes.Filter(entries).nearest(part)
    exact = ((part.astype(object)[:, None] - entries.astype(object)[None]) ** 2).sum(axis=2)
    assert at.tolist() == [r.tolist().index(min(r)) for r in exact] and [int(x) for x in d] == [min(r) for r in exact]
    assert size > 3000 or tried < 0.7 * exact.size


def test_codes_on_odd_rows(spark):
    v = [0.5, -0.25] * 8
    rows = [(1, v, "a"), (1, v, "a"), (None, v, None), (2, None, "a"), (3, [None, *v[1:]], "a"), (4, [float("nan"), *v[1:]], "a"), (5, [float("inf"), *v[1:]], "a")]
    rows += [(6, [], "a"), (7, v[:-1], "a"), (8, [-c for c in v], None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumns({c: F.lit("own") for c in ("id", "x", "code", "error", "salt", "label_error")})
    coded, books = codes.compressed(frame, rounds=2)
    got = codes.with_label_error(coded).collect()
    assert sorted((r.id or 0, r.label or "", r.error, r.label_error) for r in got) == [(0, "", 0, 0), (1, "a", 0, 0), (1, "a", 0, 0), (8, "", 0, 0)]
    assert len(books) == 8 and len(books[0]) == 4
    for empty in (frame.limit(0), frame.where("vec_id = 2"), frame.where("vec_id = 6"), frame.where("vec_id = 7")):
        coded, books = codes.compressed(empty)
        assert coded.count() == 0 and books == []
    with pytest.raises(ValueError):
        codes.compressed(frame, entries=257)
