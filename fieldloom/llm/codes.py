"""Product codes of vectors: exact integer k-means per part, with nearest entries found through lower bounds.

Components become integers, so that every distance, sum and comparison is exact. To find the nearest entry of a part, entries are
filtered coarse to fine. Cut a part into blocks; in each, write vector and entry as their mean plus a rest. The squared distance of a
block of m components is then m times the squared difference of the means plus that of the rests, which is at least the squared
difference of the lengths of the rests. Summed over blocks this bounds the distance from below; it grows as blocks are halved. An entry
is dropped only where its bound, less a margin for rounding, exceeds a distance that another entry has. Survivors get
exact integer distances. Codebooks are a fixed number of entries; tasks return sums per entry, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import Scratch, stored

_ROWS = 4096


class Filter:
    """The entries of one part with the sums and rest lengths of their blocks, at each level from one block to blocks of two or so."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        width, self.levels = entries.shape[1], []
        blocks = 1
        while blocks <= max(1, width // 2):
            at = np.linspace(0, width, blocks + 1).astype(int)
            self.levels.append((at, *_blocks(entries, at)))
            blocks *= 2
        self.norms = (entries.astype(np.float64) ** 2).sum(axis=1)

    def nearest(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of the nearest entry (the lower one of equals) and exact squared distance for each row; how many distances were
        computed exactly."""
        n, k = len(part), len(self.entries)
        largest = int(max(np.abs(part).max(initial=0), np.abs(self.entries).max(initial=0)))
        if 4 * largest * largest * part.shape[1] >= 1 << 62:  # squared distances may not fit 64 bits
            exact = ((part.astype(object)[:, None, :] - self.entries.astype(object)[None]) ** 2).sum(axis=2)
            at = np.array([min(range(k), key=r.__getitem__) for r in exact], dtype=np.int64).reshape(n)
            return at, np.array([r[i] for r, i in zip(exact, at, strict=True)], dtype=object), n * k
        norms = (part.astype(np.float64) ** 2).sum(axis=1)
        margin = 1.0 + 1e-9 * (norms[:, None] + self.norms[None, :])
        rows, cols, best = np.repeat(np.arange(n), k), np.tile(np.arange(k), n), None
        for at, sums, rests in self.levels:
            s, r = _blocks(part, at)
            m = np.diff(at)
            low = ((s[rows] - sums[cols]) ** 2 / m + (r[rows] - rests[cols]) ** 2).sum(axis=1)
            if best is None:  # the entry of the least bound gives a distance that can be had
                first = low.reshape(n, k).argmin(axis=1)
                best = self._exact(part, np.arange(n), first)
            keep = low - margin[rows, cols] <= best[rows]
            rows, cols = rows[keep], cols[keep]
        d = self._exact(part, rows, cols)
        table = np.full((n, k), np.iinfo(np.int64).max)
        table[rows, cols] = d
        found = table.argmin(axis=1)
        return found, table[np.arange(n), found], len(rows) + n

    def _exact(self, part: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        return ((part[rows] - self.entries[cols]) ** 2).sum(axis=1)


def _blocks(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and lengths of the rests of each block, as doubles."""
    x = x.astype(np.float64)
    sums = np.add.reduceat(x, at[:-1], axis=1)
    means = np.repeat(sums / np.diff(at), np.diff(at), axis=1)
    return sums, np.sqrt(np.add.reduceat((x - means) ** 2, at[:-1], axis=1))


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(books: list[np.ndarray], dims: int):
    """(code) to the sums of components and the number of parts that each entry takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, width = [Filter(b) for b in books], dims // len(books)
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                x = _vectors(batch.column(0).slice(start, _ROWS), dims)
                for p, f in enumerate(filters):
                    part = x[:, p * width : (p + 1) * width]
                    at, _, _ = f.nearest(part)
                    for j in np.unique(at):
                        mine = part[at == j]
                        high, low = (mine >> 32).sum(axis=0).tolist(), (mine & 0xFFFFFFFF).sum(axis=0).tolist()
                        now = total.setdefault((p, int(j)), [0, [0] * width])
                        now[0] += len(mine)
                        now[1] = [s + (h << 32) + v for s, h, v in zip(now[1], high, low, strict=True)]
        rows = [(p, j, i, n, str(s)) for (p, j), (n, sums) in total.items() for i, s in enumerate(sums)]
        names = ["part", "entry", "place", "n", "s"]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], names)

    return run


def _codes(books: list[np.ndarray], dims: int):
    """Adds the code and the error to each row; the vector is its last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, width = [Filter(b) for b in books], dims // len(books)
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                rows = batch.slice(start, _ROWS)
                x = _vectors(rows.column(rows.num_columns - 1), dims)
                found = [f.nearest(x[:, p * width : (p + 1) * width]) for p, f in enumerate(filters)]
                at = np.stack([a for a, _, _ in found], axis=1).astype(np.uint8)
                texts = [r.tobytes().hex() for r in at]
                error = [sum(int(d[i]) for _, d, _ in found) for i in range(len(x))]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(texts, pa.string()), pa.array(error, pa.int64())], [*rows.schema.names[:-1], "code", "error"])

    return run


def compressed(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> tuple[DataFrame, list[np.ndarray]]:
    """The codes (id, label, code, error) of all vectors, and the codebooks, one array of entries for each part.

    A component x becomes floor(scale * x). Vectors are cut into equal consecutive parts. Each part's codebook starts as that part of the
    vectors with the smallest ids (equal ids in the order of their vectors, null ids last); in each round every entry turns into
    floor(sum / n) of the parts nearest to it, and one that no part is nearest to stays. With fewer vectors there are fewer entries, with up to
    256 of them an index takes two hex digits. Rows whose vector is null or has null or non-finite components are dropped; so are those
    whose length differs from that of the first vector, and all if that is no positive multiple of parts. Rows that repeat count one by one. Other columns are not returned.
    Components beyond 2^62 / scale, and errors beyond 64 bits, fail the job. An empty table gives an empty result and no codebooks.
    """
    if entries > 256:
        raise ValueError("an index takes two hex digits: entries must not exceed 256")
    spark, x = vectors.sparkSession, F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), x.alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = lambda v: F.when(F.abs(v) * scale < 2.0**62, F.floor(v * scale)).otherwise(F.raise_error(F.lit("a component exceeds 2^62 / scale")).cast("long"))
    rows = rows.where(F.col("x").isNotNull() & finite)
    order = F.col("id").asc_nulls_last(), "x"
    first = rows.orderBy(*order).limit(1).select(F.size("x").alias("n")).collect()
    dims = first[0]["n"] if first else 0
    kind = f"id {dict(rows.dtypes)['id']}, label {dict(rows.dtypes)['label']}, code string, error long"
    if not dims or dims % parts:
        return spark.createDataFrame([], kind), []
    rows = rows.where(F.size("x") == dims)
    with Scratch(spark) as scratch:
        ints = scratch.stored(rows.select("id", "label", F.transform("x", whole).alias("x")), "vectors")
        width = dims // parts
        seeds = rows.orderBy(*order).limit(entries).select(F.transform("x", whole).alias("x")).collect()
        start = np.array([r["x"] for r in seeds], dtype=np.int64)
        books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
        for _ in range(rounds):
            sums = ints.select("x").mapInArrow(_sums(books, dims), "part int, entry int, place int, n long, s string")
            added = sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
            books = [b.copy() for b in books]
            for r in added.collect():  # parts x entries x width rows
                books[r["part"]][r["entry"], r["place"]] = int(r["s"]) // r["n"]
        coded = stored(ints.select("id", "label", "x").mapInArrow(_codes(books, dims), kind), "codes")
    return coded, books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def with_label_error(coded: DataFrame, *, salts: int = 32) -> DataFrame:
    """coded with label_error, the sum of error over equal labels, nulls together. A label that many rows bear is dealt out by salts."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = coded.withColumn("salt", F.pmod(F.hash("id", "code", "error"), F.lit(salts)))
    s = sums.select(F.col("label").alias("__l"), "salt", "label_error")
    return salted.join(s, (salted["salt"] == s["salt"]) & salted["label"].eqNullSafe(s["__l"])).select(*[salted[c] for c in coded.columns], "label_error")
