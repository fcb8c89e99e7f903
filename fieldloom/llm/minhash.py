"""MinHash near-deduplication with circulant permutations.

Two permutations of the 32-bit ring give all signature coordinates: sigma scatters the shingles, and coordinate k is the
smallest pi(sigma(x) + k), pi circularly shifted by k. Coordinates are banded; documents that share a band are
candidates; a link is confirmed only on the full shingle sets.

Work follows links, not pairs. Documents with equal sets form one class. In every shared band each class is compared
with a few hubs of that band, and classes linked so far become components. Bands that then hold several components go on. For
each of their classes the shingles that some other component holds as well are counted: two classes of different components can
share no more than the smaller of their counts, which bounds their similarity and the size of any partner. Rounds of hubs (the class
of the band that shares most) merge what they can. At last, classes of different components meet one by one where neither bound
nor sizes forbid a link and where they share one of their rarest shingles: of the shingles that a class shares at all, a partner must hold
one of the first few in order of frequency. Pairs inside one component need no comparison, since only reachability counts. Nothing is capped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import ROW, Scratch, checkpointed, checkpointed_any, each, kept_for, row_keyed, slices, stored

ROWS, BANDS = 5, 26  # a pair of similarity 0.85 shares no band with probability 3e-7
STEP = 1.05  # sizes of one bucket differ by less than this factor
_WORDS_HELD = 20_000


def _word_hashes(words: list[bytes]) -> np.ndarray:
    held = kept_for("minhash")
    if len(held) > _WORDS_HELD:
        held.clear()
    out = []
    for w in words:
        h = held.get(w)
        if h is None:
            h = held[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; of the whole sequence if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and \x20\x09-\x0D only
    if not words:
        return np.empty(0, np.uint64)
    h = _word_hashes(words)
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(k, len(h)), dtype=np.uint64)
    for j in range(min(k, len(h))):
        out = _mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(out)


def _ring(x: np.ndarray, seed: int) -> np.ndarray:
    """A permutation of the 32-bit ring."""
    x = x ^ np.uint32(seed)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, n: int = ROWS * BANDS, seed: int = 1) -> np.ndarray:
    """The n circulant MinHash coordinates of a non-empty set."""
    start = _ring((shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32), seed)
    shift = np.arange(n, dtype=np.uint32)[:, None]
    low = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(start), 1024):  # long texts in pieces: memory stays small
        np.minimum(low, _ring(start[None, i : i + 1024] + shift, seed + 0x5BD1E995).min(axis=1), out=low)
    return low


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band, different bands apart."""
    parts = sig.reshape(-1, rows).astype(np.uint64)
    key = np.arange(len(parts), dtype=np.uint64)
    for j in range(rows):
        key = _mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, j])
    return key.view(np.int64)


def _sketch(k: int, rows: int, n_bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, keys, found = [], [], []
            for text in each(batch.column(1)):
                s = shingle_set(text, k)
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                found.append(bands(signature(s, rows * n_bands), rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                ["id", "n", "set_key", "bands"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, k).tobytes() for t in each(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "set"])

    return run


def _confirm(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
                short, long = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(long, short)
                both = int((long[np.minimum(at, len(long) - 1)] == short).sum())
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, label, set) to one row per shingle."""
    for batch in batches:
        for i in range(batch.num_rows):
            s = np.frombuffer(batch.column(2)[i].as_buffer(), np.int64)
            at = pa.array(np.full(len(s), i, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(s)], ["c", "label", "shingle"])


def components(edges: DataFrame, id_type: str = "long") -> DataFrame:
    """Connected components of edges (a, b) as (id, label): the smallest id reachable. Labels spread to neighbours, then
    every label is replaced by its own label, so paths shorten by half or more in each round."""
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("label").alias("near"))
        )
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        step = step.join(up, "label", "left").select("id", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        new, changed = checkpointed_any(step, F.col("old") != F.col("label"))
        labels = new.select("id", "label")
        if not changed:
            return labels


def _links(texts: DataFrame, classes: DataFrame, id_type: str, k: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(a, b): confirmed links between classes (c, n, bands); as many as connect all classes that links connect at all."""
    members = classes.select("c", "n", F.explode("bands").alias("band"))
    several = members.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("band")
    shared = scratch.stored(members.join(several, "band"), "shared")
    who = F.struct("c", "n")
    hubs = shared.groupBy("band").agg(
        F.min(who).alias("low"), F.max(who).alias("high"), F.min(F.struct(F.xxhash64("c", F.lit(7)).alias("h"), "c", "n")).alias("any")
    )
    hubs = hubs.select("band", F.explode(F.array("low", "high", F.struct("any.c", "any.n"))).alias("hub"))
    tried = (
        shared.join(hubs, "band")
        .where((F.col("c") != F.col("hub.c")) & (F.least("n", "hub.n") * den >= F.greatest("n", "hub.n") * num))
        .select(F.least("c", "hub.c").alias("a"), F.greatest("c", "hub.c").alias("b"))
    )
    # one plan at every size: both sides by id
    wanted = shared.select(F.col("c").alias("id")).distinct()
    sets = scratch.stored(texts.join(wanted.hint("merge"), "id").mapInArrow(_sets(k), f"id {id_type}, set binary"), "sets")

    def confirmed(pairs: DataFrame) -> tuple[DataFrame, bool]:
        left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
        full = pairs.distinct().join(left, "a").join(right, "b").select("a", "b", "x", "y")
        return checkpointed_any(full.mapInArrow(_confirm(num, den), f"a {id_type}, b {id_type}"))

    def still_apart(held: DataFrame) -> tuple[DataFrame, bool]:
        """The rows of held (band, label, ...) in bands of several components."""
        mixed = held.groupBy("band").agg(F.min("label").alias("first"), F.max("label").alias("last")).where("first <> last").select("band")
        return checkpointed_any(held.join(mixed, "band"))

    links, _ = confirmed(tried)
    at = components(links).select(F.col("id").alias("c"), "label")
    held, apart = still_apart(checkpointed(shared.join(at, "c", "left").withColumn("label", F.coalesce("label", "c"))))
    if not apart:
        return links
    # shingles of each class that another component holds as well
    open_sets = held.select("c", "label").distinct().join(sets.withColumnRenamed("id", "c"), "c").select("c", "label", "set")
    shingles = scratch.stored(open_sets.mapInArrow(_explode, f"c {id_type}, label {id_type}, shingle long"), "shingles")
    spread = shingles.groupBy("shingle").agg(F.min("label").alias("first"), F.max("label").alias("last")).where("first <> last").select("shingle")
    common = shingles.join(spread, "shingle").groupBy("c").agg(F.count(F.lit(1)).alias("common"))
    # a partner has at least least_n and at most most_n shingles
    held = held.join(common, "c").withColumn("least_n", F.ceil(F.col("n") * num / den)).withColumn("most_n", F.floor(F.col("common") * (num + den) / num) - F.col("n"))
    held, apart = still_apart(held.where("most_n >= least_n"))

    def fits(x: str, y: str):
        part = lambda side, name: F.col(f"{side}.{name}")
        low = F.least(part(x, "common"), part(y, "common"))
        return (part(x, "label") != part(y, "label")) & (den * low >= num * (part(x, "n") + part(y, "n") - low))

    pair = F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")
    while apart:
        hub = held.groupBy("band").agg(F.max_by(F.struct("c", "n", "label", "common"), F.struct(F.col("common") / F.col("n"), "common", "c")).alias("y"))
        more, linked = confirmed(held.alias("x").join(hub, "band").where(fits("x", "y")).select(*pair))
        if not linked:
            break
        links = links.union(more)
        # components of components: only labels that were linked just now change
        label_of = held.select("c", "label").distinct()
        ends = more.join(label_of.withColumnsRenamed({"c": "a", "label": "la"}), "a").join(label_of.withColumnsRenamed({"c": "b", "label": "lb"}), "b")
        moved = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("id").alias("label"), F.col("label").alias("now"))
        held, apart = still_apart(checkpointed(held.join(moved, "label", "left").withColumn("label", F.coalesce("now", "label")).drop("now")))
    if not apart:
        return links
    # what is left meets by rare shingles and by sizes; x is the larger one, or of equal sizes either
    again = shingles.select("c", "shingle").join(held.select("c", "n", "label").distinct(), "c")
    spread = again.groupBy("shingle").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.count(F.lit(1)).alias("df"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("df", "shingle"))), lambda e: e["shingle"])  # within one text
    rare = again.join(spread.where("first <> last").select("shingle", "df"), "shingle").groupBy("c", "n", "label").agg(ordered.alias("s"))
    rare = rare.withColumn("common", F.size("s")).withColumn("least_n", F.ceil(F.col("n") * num / den))
    rare = checkpointed(rare.withColumn("most_n", F.floor(F.col("common") * (num + den) / num) - F.col("n")).where("most_n >= least_n"))
    bucket = lambda n: F.floor(F.log(n) / F.lit(math.log(STEP))).cast("int")
    sizes = lambda a, b: F.explode(F.sequence(bucket(a), bucket(b)))
    smallest = lambda b: F.ceil(F.pow(F.lit(STEP), b) - 1e-6)
    needed = F.ceil((smallest(F.col("bx")) + smallest(F.col("by"))) * num / (num + den))  # of the shingles of both
    out = "c", "n", "label", "common", "bx", "by"

    def first_few(side: DataFrame) -> DataFrame:
        side = side.withColumn("needed", needed.cast("int")).where("common >= needed")
        return side.select(*out, F.explode(F.slice("s", F.lit(1), F.col("common") - F.col("needed") + 1)).alias("shingle"))

    x = rare.withColumn("top", F.least("most_n", "n")).where("top >= least_n")
    x = first_few(x.select("*", bucket(F.col("n")).alias("bx"), sizes(F.col("least_n"), F.col("top")).alias("by")))
    y = first_few(rare.where("most_n >= n").select("*", sizes(F.col("n"), F.col("most_n")).alias("bx"), bucket(F.col("n")).alias("by")))
    rest = x.alias("x").join(y.alias("y"), ["shingle", "bx", "by"]).where(fits("x", "y") & (F.col("x.n") >= F.col("y.n"))).select(*pair)
    return links.union(confirmed(rest)[0])


def near_components(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    similarity: tuple[int, int] = (85, 100),
    rows: int = ROWS,
    n_bands: int = BANDS,
) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per document; component_id is the smallest id of the component.

    Words are the runs of [^\\x20\\x09-\\x0D], A-Z lower-cased. Documents link when their sets of distinct k-word shingles
    have similarity num/den or more; a document with fewer words has one shingle, its whole sequence. Null, empty and
    blank texts have no shingle and link with nothing. A null id is never linked: its component_id is null and it is
    kept. Rows that repeat an id are linked by their texts alone; exactly one row of each component is kept. Texts of any
    length are taken whole; other columns of docs are not returned. An empty table gives an empty result.
    """
    options = {"text_col": text_col, "k": k, "similarity": similarity, "rows": rows, "n_bands": n_bands}
    name, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    keyed = row_keyed(docs.select(name, text) if id_col != text_col else docs.select(name), id_col)
    if keyed is None:
        return _components(docs, id_col=id_col, **options)
    found = _components(keyed.withColumn(ROW, F.when(name.isNotNull(), F.col(ROW))), id_col=ROW, **options)
    found = found.join(keyed.select(ROW, name.alias("id")), ROW, "left").join(_best_rows(found, keyed, id_col), "component_id", "left")
    return found.select(
        F.col("id").alias(id_col), "n_shingles", F.col("best.id").alias("component_id"), F.coalesce(F.col(ROW) == F.col(f"best.{ROW}"), F.lit(True)).alias("kept")
    )


def _best_rows(found: DataFrame, keyed: DataFrame, id_col: str) -> DataFrame:
    """(component_id, best): the row of each component that stays, the smallest id first and null ids last."""
    name = F.col(f"`{id_col}`")
    named = found.where("component_id is not null").select(ROW, "component_id").join(keyed.select(ROW, name.isNull().alias("no_id"), name.alias("id")), ROW)
    return named.groupBy("component_id").agg(F.min(F.struct("no_id", "id", ROW)).alias("best"))


def _components(
    docs: DataFrame, *, id_col: str, text_col: str, k: int, similarity: tuple[int, int], rows: int, n_bands: int
) -> DataFrame:
    """near_components where no id repeats."""
    num, den = similarity
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type = dict(texts.dtypes)["id"]
    sketches = stored(
        texts.mapInArrow(_sketch(k, rows, n_bands), f"id {id_type}, n long, set_key binary, bands array<bigint>"), "sketch"
    )
    named = sketches.where("id is not null and set_key is not null")
    with Scratch(docs.sparkSession) as scratch:
        classes = scratch.stored(named.groupBy("set_key", "n").agg(F.min("id").alias("c"), F.first("bands").alias("bands")), "classes")
        links = _links(texts, classes, id_type, k, num, den, scratch)
        label = components(links)
        of_class = label.select(F.col("id").alias("c"), "label")
        of_set = stored(classes.select("set_key", "c").join(of_class, "c", "left").select("set_key", F.coalesce("label", "c").alias("label")), "labels")
    component = F.when(F.col("id").isNotNull(), F.coalesce("label", "id"))
    return (
        sketches.select("id", F.col("n").alias("n_shingles"), "set_key")
        .join(of_set, "set_key", "left")
        .select(
            F.col("id").alias(id_col),
            "n_shingles",
            component.alias("component_id"),
            F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
        )
    )


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that stay, one row of each component, with the columns of docs. Rows with a null id are linked as well:
    their rows are told apart by a key."""
    keyed = row_keyed(docs, id_col)
    if keyed is not None:
        found = near_components(keyed, id_col=ROW, **options)
        stay = _best_rows(found, keyed, id_col).select(f"best.{ROW}")
        return keyed.join(stay, ROW, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    found = near_components(docs, id_col=id_col, **options).where("not kept").select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(found, F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")
