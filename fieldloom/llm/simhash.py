"""SimHash near-deduplication over an inverted index of positional bytes, with count filtering.

A fingerprint of 64 bits is eight bytes at eight positions. Two fingerprints that differ in b bits share at least 8 - b of their
positional bytes, which is five for b = 3. Postings of single positional bytes would pair a fixed share of all fingerprints, so postings
bear three positional bytes: the positions are cut into two halves of four, and of any five shared positions three lie in one half; the
eight triples inside halves therefore miss no pair. Pairs of a posting are tallied: the positional bytes that they share are counted,
pairs with at least 8 - b go on, and are verified by their differing bits.

Equal fingerprints are one class, so copies cost nothing. A posting of more than CROWD classes (near copies of one text, in the main) is
never paired. Its classes go to finer postings, of five positional bytes, and to pairs again where those are no crowd. What is still a
crowd differs in three bytes only: it has at most 2^24 classes, which one task links by a search over neighbours, emitting one link for each class
it reaches. All of it is exact; the bound only says which way is taken.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import Scratch, checkpointed, stored
from fieldloom.llm.minhash import components

CROWD = 64
TRIPLES = [t for half in (range(4), range(4, 8)) for t in itertools.combinations(half, 3)]
FIVES = list(itertools.combinations(range(8), 5))


def fingerprint(text: str | None, k: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint over the k-word shingles, repeats included, of the text with A-Z lower-cased: a bit is 1 if it is set in more
    than half of their XXH64. With fewer words the whole sequence is one shingle; without words it is zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and \x20\x09-\x0D only
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    counts = np.zeros(64, np.int64)
    for start in range(0, n, 8192):  # long texts in pieces: memory stays small
        few = words[start : start + 8192 + k - 1]
        joined = memoryview(b" ".join(few))
        ends = list(itertools.accumulate(len(w) + 1 for w in few))
        starts = [0, *ends[:-1]]
        m = max(1, len(few) - k + 1)
        hashed = [xxhash.xxh64_intdigest(joined[i : j - 1], seed) for i, j in zip(starts[:m], ends[min(k, len(few)) - 1 :], strict=False)]
        bits = np.unpackbits(np.array(hashed, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _prints(k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), k, seed) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64), pa.int64())], ["id", "f"])

    return run


def _mask(positions: tuple[int, ...]) -> int:
    """The bits of some bytes, as a signed number of 64 bits."""
    made = sum(0xFF << (8 * p) for p in positions)
    return made - (1 << 64) if made >> 63 else made


def shared_bytes(x: Column) -> Column:
    """How many of the eight bytes of an exclusive or are zero."""
    one = [F.when(x.bitwiseAND(F.lit(_mask((p,)))) == 0, 1).otherwise(0) for p in range(8)]
    return sum(one[1:], one[0])


def differing_bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _neighbours(free: tuple[int, ...], bits: int) -> np.ndarray:
    """All differences of one to so many bits within some bytes."""
    places = [8 * p + i for p in free for i in range(8)]
    return np.array([sum(1 << i for i in c) for n in range(1, bits + 1) for c in itertools.combinations(places, n)], dtype=np.uint64)


def linked(values: np.ndarray, free: tuple[int, ...], bits: int) -> Iterator[tuple[int, int]]:
    """Links (index, index) that connect all distinct values, sorted ascending, that chains of up to so many differing bits connect;
    values differ in the free bytes only. Each value is reached once: the work is the number of values times that of the neighbours of one, or the values
    not yet reached, whichever is less."""
    near = _neighbours(free, bits)
    left = np.ones(len(values), bool)
    for first in range(len(values)):
        if not left[first]:
            continue
        left[first] = False
        stack = [first]
        while stack:
            i = stack.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                return
            if len(rest) <= len(near):
                found = rest[np.bitwise_count(values[rest] ^ values[i]) <= bits]
            else:
                wanted = values[i] ^ near
                at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
                found = at[(values[at] == wanted) & left[at]]
            left[found] = False
            for j in found.tolist():
                stack.append(j)
                yield i, j


def _crowds(bits: int):
    def run(table: pa.Table) -> pa.Table:
        key = FIVES[table["kind"][0].as_py()]
        free = tuple(p for p in range(8) if p not in key)
        values = np.sort(table["f"].to_numpy().view(np.uint64))
        found = np.array(list(linked(values, free, bits)), dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": values[found[:, 0]].view(np.int64), "b": values[found[:, 1]].view(np.int64)})

    return run


def _postings(prints: DataFrame, sets: list[tuple[int, ...]], wanted: Column | None = None) -> DataFrame:
    """(kind, key, f): kind numbers the sets of positions, key has the bytes of f at them."""
    made = [F.struct(F.lit(i).alias("kind"), F.col("f").bitwiseAND(F.lit(_mask(s))).alias("key")) for i, s in enumerate(sets)]
    return prints.select("f", F.explode(F.array(*made)).alias("p")).select("p.kind", "p.key", "f")


def links(prints: DataFrame, bits: int, scratch: Scratch, crowd: int = CROWD) -> DataFrame:
    """(a, b): pairs of distinct fingerprints (f) of up to so many differing bits; in crowds as many as connect what links connect."""

    def met(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Verified pairs of the postings that are no crowd, and the rows of crowds."""
        sizes = postings.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        held = scratch.stored(postings.join(sizes, ["kind", "key"]), "postings")
        few = held.where(F.col("size") <= crowd)
        a, b = few.select("kind", "key", F.col("f").alias("a")), few.select("kind", "key", F.col("f").alias("b"))
        pairs = a.join(b, ["kind", "key"]).where("a < b")
        tallied = pairs.where(shared_bytes(F.col("a").bitwiseXOR(F.col("b"))) >= 8 - bits)
        return tallied.where(differing_bits(F.col("a"), F.col("b")) <= bits).select("a", "b"), held.where(F.col("size") > crowd)

    found, crowded = met(_postings(prints, TRIPLES))
    again = _postings(crowded.select("f").distinct(), FIVES)
    finer, packed = met(again)
    rest = packed.select("kind", "key", "f").groupBy("kind", "key").applyInArrow(_crowds(bits), "a long, b long")
    return found.union(finer).union(rest).distinct()


def simhash_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42, bits: int = 3, crowd: int = CROWD
) -> DataFrame:
    """(id, fingerprint, component_id, kept), one row per document: the fingerprint in 16 hex digits, and the smallest id of its component.

    Words are the runs of [^\\x20\\x09-\\x0D], A-Z lower-cased. Documents link when their fingerprints differ in at most `bits` bits,
    three at most; links chain. Null, empty and blank texts have fingerprint zero and link like any other. Texts of any length count as a
    whole. A row with a null id has the component of its fingerprint, but gives it no id; a component of such rows only has a null
    one. Rows that repeat an id are rows one by one. kept says that the row's id is that of its component, so all
    rows that repeat that id are kept, and none with a null id, unless its component has no id at all: then all of its rows are. Other
    columns of docs are not returned. An empty table gives an empty result.
    """
    if not 0 <= bits <= 3:
        raise ValueError("bits must be between 0 and 3")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type = dict(rows.dtypes)["id"]
    prints = stored(rows.mapInArrow(_prints(k, seed), f"id {id_type}, f long"), "prints")
    with Scratch(docs.sparkSession) as scratch:
        classes = scratch.stored(prints.groupBy("f").agg(F.min("id").alias("c")), "classes")
        label = components(links(classes.select("f"), bits, scratch, crowd)).withColumnsRenamed({"id": "f"})
        least = classes.join(label, "f").groupBy("label").agg(F.min("c").alias("least"))
        of_class = checkpointed(classes.join(label.join(least, "label").select("f", "least"), "f", "left").select("f", F.coalesce("least", "c").alias("component_id")))
    # a fingerprint that many copies bear is split in the join by AQE
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    return prints.join(of_class, "f").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id", kept.alias("kept")
    )
