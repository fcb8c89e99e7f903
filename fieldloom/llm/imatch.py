"""I-Match fingerprints over randomised lexicons.

The lexicon holds the terms whose document frequency lies in a chosen band of inverse document frequency, counted over all
documents. A document's terms are its distinct lexicon terms in sorted order. Random subsets of the lexicon, several at
each of several rates, are fixed by a seed; a fingerprint is one hash per subset, over the document's terms in
that subset. Two documents are as alike as the share of equal hashes, at the rate where subsets catch a term or two.

Texts of few lexicon terms are not told apart by these alone. So every fingerprint has a second, smaller half, made in the same way over the
text's terms out of the lexicon, or over the text itself if it has no term. Both halves count in proportion to the terms that
they stand for, a lexicon term as much as WEIGHT others. Only blank texts have a fingerprint of zeros.

The band is set by shares of the number of documents, so the lexicon's size is bounded by
(distinct terms of a mean document) / (lower share), however large the corpus: it can be broadcast.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import each, slices, stored, without

RATES, SUBSETS = 10, 16  # rates 1, 1/2, ..., 1/512
OTHER_RATES = 8  # of the second half, which has as many subsets
LOW, HIGH = 0.0005, 0.2  # shares of all documents
WEIGHT = 2
_HELD = 200_000


_SIGNS = "\"'.,;:!?()[]{}<>|*#$%&/\\-_=+~`"


def terms(text: str | None) -> set[str]:
    """Distinct lower-cased words, without signs at either end."""
    out = {w if w.isalpha() else w.strip(_SIGNS) for w in set((text or "").lower().split())}
    out.discard("")
    return out


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by term, added up within the task every so often."""
    held: Counter[str] = Counter()

    def emit() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["term", "n"])
        held.clear()
        return out

    for batch in batches:
        for text in each(batch.column(0)):
            held.update(terms(text))
            if len(held) > _HELD:
                yield emit()
    yield emit()


def lexicon(docs: DataFrame, *, text_col: str = "text", low: float = LOW, high: float = HIGH) -> list[str]:
    """The sorted terms in at least max(2, low * N) and at most max(2, high * N) of the N documents."""
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    n = docs.count()
    counts = texts.mapInArrow(_term_counts, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    kept = counts.where(F.col("n").between(float(max(2, low * n)), float(max(2, high * n)))).select("term").toArrow()
    return sorted(kept.column("term").to_pylist())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SALT = _mix(np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _values(found: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in found], dtype=np.uint64)


def _slots(values: np.ndarray, seed: int, subsets: int) -> np.ndarray:
    """(terms, subsets): rate * subsets + subset for the finest rate at which a subset holds a term; coarser rates hold it as well."""
    s = np.arange(subsets, dtype=np.uint64)
    u = (_mix(values[:, None] ^ (np.uint64(seed * 1000003) + s)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return (np.minimum(np.floor(-np.log2(np.maximum(u, 1e-300))), RATES - 1).astype(np.int16) * subsets + np.arange(subsets)).astype(np.int16)


_LEADING = np.array([8 - int(b).bit_length() for b in range(256)], dtype=np.int16)


def _other_slots(values: np.ndarray, seed: int) -> np.ndarray:
    """As _slots, for SUBSETS subsets and OTHER_RATES rates, from a byte of two mixed values for each subset."""
    mixed = _mix(values[:, None] ^ (np.uint64(seed * 1000003) + np.arange(1, SUBSETS // 8 + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    rate = np.minimum(_LEADING[np.ascontiguousarray(mixed).view(np.uint8).reshape(len(values), SUBSETS)], OTHER_RATES - 1)
    return rate * np.int16(SUBSETS) + np.arange(SUBSETS, dtype=np.int16)


def _hashes(values: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """(rates, SUBSETS): a hash for each rate and subset, those of the first half before those of the second, the coarsest rate first, zero
    where it holds no term. The hash of a subset's sorted terms is the sum of their values, modulo 2^64, mixed with the subset's own salt."""
    slots, n = slots.ravel(), (RATES + OTHER_RATES) * SUBSETS
    # halves of 32 bits add up exactly as doubles, up to two million terms
    low = np.bincount(slots, (values & np.uint64(0xFFFFFFFF)).astype(np.float64).repeat(SUBSETS), n).astype(np.uint64)
    high = np.bincount(slots, (values >> np.uint64(32)).astype(np.float64).repeat(SUBSETS), n).astype(np.uint64)
    sums = (low + (high << np.uint64(32))).reshape(-1, SUBSETS)
    sizes = np.bincount(slots, minlength=n).reshape(-1, SUBSETS)
    for x in (sums, sizes):
        x[:RATES], x[RATES:] = x[RATES - 1 :: -1].cumsum(axis=0)[::-1], x[: RATES - 1 : -1].cumsum(axis=0)[::-1]
    return np.where(sizes > 0, (_mix(sums ^ _SALT) >> np.uint64(32)) | np.uint64(1), np.uint64(0))


@dataclass
class Lexicon:
    """Sorted terms with their values and, for each subset, the slot of the finest rate at which it holds them."""

    terms: list[str]
    values: np.ndarray
    slots: np.ndarray
    seed: int = 1
    key: str = field(default_factory=lambda: uuid.uuid4().hex)  # tells lexicons apart in workers that stay

    @classmethod
    def of(cls, found: list[str], seed: int = 1) -> Lexicon:
        values = _values(found)
        return cls(found, values, _slots(values, seed, SUBSETS), seed)


class Printer:
    """Fingerprints by one lexicon; remembers the last text."""

    def __init__(self, lex: Lexicon):
        self.lex = lex
        self.place = {t: i for i, t in enumerate(lex.terms)}
        self.last: tuple[str, str] = ("", "")

    def fingerprint(self, text: str | None) -> str:
        """RATES * SUBSETS hashes of 8 hex digits over the lexicon terms of the text, then OTHER_RATES * SUBSETS of 6 over its other terms, or over
        the text without white space if it has no term; the finest rate last, zeros where a subset holds no term."""
        text = text or ""
        if text == self.last[0] and self.last[1]:
            return self.last[1]
        found = terms(text)
        place = self.place
        own = [t for t in found if t not in place]
        if not found and (bare := "".join(text.split())):
            own = [bare]
        at = np.sort(np.array([place[t] for t in found if t in place], dtype=np.int64))
        values = _values(own)
        slots = np.concatenate([self.lex.slots[at], _other_slots(values, self.lex.seed) + np.int16(RATES * SUBSETS)])
        hashed = _hashes(np.concatenate([self.lex.values[at], values]), slots)
        made = hashed[:RATES].astype(">u4").tobytes().hex() + hashed[RATES:].astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes().hex()
        self.last = (text, made)
        return made


def _half(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The largest share of equal hashes over the rates, and a number that grows with the terms that both stand for. Subsets without terms on
    either side do not count, and a rate needs half of its subsets to count."""
    some = ((x | y) != 0).sum(axis=1)
    same = ((x == y) & (x != 0)).sum(axis=1)
    share = np.where(2 * some >= x.shape[1], same / np.maximum(some, 1), 0.0).max()
    return float(share), 2.0 ** (some.sum() / x.shape[1]) - 1


def _parsed(made: str) -> tuple[np.ndarray, np.ndarray]:
    n, raw = RATES * SUBSETS * 4, np.frombuffer(bytes.fromhex(made), np.uint8)
    second = raw[n:].reshape(-1, 3) @ np.array([65536, 256, 1], dtype=np.uint32)
    return raw[:n].view(">u4").reshape(-1, SUBSETS), second.reshape(-1, SUBSETS)


def likeness(a: str, b: str) -> float:
    """How alike the halves of two fingerprints are, in proportion to the terms that they stand for; 1 if the fingerprints are equal."""
    if a == b:
        return 1.0
    (x, u), (y, v) = map(_parsed, (a, b))
    (s, m), (t, k) = _half(x, y), _half(u, v)
    return float((WEIGHT * m * s + k * t) / (WEIGHT * m + k))


_PRINTERS: dict[str, Printer] = {}


def _printer(lex: Lexicon) -> Printer:
    """The printer of a lexicon, made once in a worker."""
    if lex.key not in _PRINTERS:
        _PRINTERS.clear()
        _PRINTERS[lex.key] = Printer(lex)
    return _PRINTERS[lex.key]


SAMPLED = 20


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", per_block: int = 2000) -> DataFrame:
    """(id, text, next_text): each document with the next in ascending id; the last with the first. Nulls count as empty.

    Ids, of any type that has an order, are cut into blocks at quantiles of a sample, about SAMPLED ids a block, by a hash of the id; inside
    a block the next row is a window's, and the last row of a block takes the first text of the next block. Null ids come first; rows that repeat an id follow one another in
    the order of their texts. Texts of any length are taken whole; other columns are left out. An empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    n = rows.count()
    parts = max(1, min(10_000, n // per_block))
    cuts = []
    if parts > 1:
        every = max(1, n // (SAMPLED * parts))
        sample = rows.select("id").where(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(every)) == 0)).distinct()
        found = [r["id"] for r in sample.orderBy("id").collect()]  # some SAMPLED * parts ids
        cuts = [found[i] for i in sorted({i * len(found) // parts for i in range(1, parts)} - {0})]
    block = F.lit(0)
    if cuts:
        # binary search over the cuts, as array arithmetic: how many cuts are not above the id
        edges = F.array(*[F.lit(c) for c in cuts])
        block = F.when(F.col("id").isNull(), 0).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length() - 1)), F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), lambda acc, _: _halve(acc, edges), lambda acc: acc["lo"]))
    rows = rows.withColumn("block", block.cast("int"))
    order = Window.partitionBy("block").orderBy(F.col("id").asc_nulls_first(), "text")
    rows = rows.withColumn("after", F.lead("text").over(order))
    firsts = (
        docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
        .withColumn("block", block.cast("int"))
        .groupBy("block")
        .agg(F.min(F.struct(F.col("id").isNotNull().alias("k"), "id", "text")).alias("first"))
        .select("block", F.col("first.text").alias("first"))
    )
    # one row per block, so at most 10,000: a window over all of them is small
    firsts = stored(firsts, "firsts")
    ring = Window.orderBy("block")
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("block", F.coalesce(F.lead("first").over(ring), F.first("first").over(whole)).alias("wrap"))
    return rows.join(firsts, "block").select("id", "text", F.coalesce("after", "wrap").alias("next_text"))


def _halve(acc, edges):
    lo, hi = acc["lo"], acc["hi"]
    mid = F.floor((lo + hi) / 2).cast("int")
    right = F.get(edges, mid) <= F.col("id")
    go = lo < hi
    return F.struct(F.when(go & right, mid + 1).otherwise(lo).cast("int").alias("lo"), F.when(go & ~right, mid).otherwise(hi).cast("int").alias("hi"))


def fingerprints(docs: DataFrame, lex: list[str], *, text_cols: tuple[str, ...] = ("text",), seed: int = 1) -> DataFrame:
    """docs with fingerprint_<column> for each text column; a column of docs that is named like that is replaced. A null text counts as empty;
    the fingerprint of a blank text is all zeros, and of no other. Texts of any length count as a whole, repeated rows one by one, and an
    empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(Lexicon.of(lex, seed))

    def run(texts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        printer = _printer(shared.value)
        for columns in texts:
            # one text at a time: some are very long
            made = [[printer.fingerprint(c[i].as_py()) for c in columns] for i in range(len(columns[0]))]
            yield pa.StructArray.from_arrays([pa.array([m[i] for m in made], pa.string()) for i in range(len(columns))], [f"f{i}" for i in range(len(columns))])

    def single(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run((t,) for t in texts)

    kind = ", ".join(f"f{i} string" for i in range(len(text_cols)))
    if len(text_cols) == 1:
        single.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
        made = F.arrow_udf(single, kind)(F.col(f"`{text_cols[0]}`"))
    else:
        run.__annotations__ = {"texts": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
        made = F.arrow_udf(run, kind)(*[F.col(f"`{c}`") for c in text_cols])
    names = [F.col(f"`{c}`") for c in without(docs, *(f"fingerprint_{c}" for c in text_cols)).columns]
    return docs.select(*names, made.alias("__f")).select(*names, *[F.col(f"__f.f{i}").alias(f"fingerprint_{c}") for i, c in enumerate(text_cols)])


def _alike(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([likeness(x, y) for x, y in zip(each(a), each(b), strict=True)], pa.float64())


def like(a: str, b: str):
    """Column: likeness of two fingerprint columns."""
    return F.arrow_udf(_alike, "double")(F.col(a), F.col(b))


def edited_pairs(docs: DataFrame, lex: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document, of its edited text and of the next document, with their likeness.

    The edited text replaces the last floor(n_chars / 4) code points by the first as many (or all) of the next document's.
    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    An empty table gives an empty result; a single document is followed by itself.
    """
    rows = with_next(docs, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(Lexicon.of(lex))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = _printer(shared.value)
        for batch in slices(batches):
            out = []
            for text, after in zip(each(batch.column(1)), each(batch.column(2)), strict=True):
                n = len(text) // 4
                edited = text[: len(text) - n] + after[:n]
                mine, other = printer.fingerprint(text), printer.fingerprint(edited)
                digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((len(text), digest, mine, other, likeness(mine, other), likeness(mine, printer.fingerprint(after))))
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), _PAIR_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *_PAIR])

    made = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return made.withColumnRenamed("id", id_col)


_PAIR = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_PAIR_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
