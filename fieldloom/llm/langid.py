"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of order 0 to 4 with counts from labelled text. A byte is coded in its longest
known context; where that context has not seen it, an escape (method C: distinct / (total + distinct)) leads to the
next shorter one, down to a uniform code of 8 bits. Counts are frozen after training, so the code length of a byte after
its context is a constant, and the length of a text under a language is an exact sum of table entries. Symbols already
ruled out by a longer context are not excluded again. A text goes to the language with the shortest code for all of it.

Training takes a bounded sample: about `sample` documents of each language. Everything after that sees whole texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import each, without

ORDER = 4
SAMPLE = 400
EVIDENCE = 32  # bytes of mean code length that score weighs
_SPAN = 1 << 19  # bytes scored at once
_EMPTY = np.uint64((1 << 64) - 1)


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte after the first ORDER: its order preceding bytes and itself, packed."""
    key = np.zeros(len(data) - ORDER, dtype=np.uint64)
    for j in range(order, -1, -1):
        key = (key << np.uint64(8)) | data[ORDER - j : len(data) - j].astype(np.uint64)
    return key


def _padded(text: str) -> np.ndarray:
    return np.frombuffer(b"\n" * ORDER + _bytes(text), np.uint8)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, depth, gram, n), added up within the task every so often."""
    held: dict[tuple[str, int], list] = {}
    size = 0

    def emit():
        for (lang, depth), parts in held.items():
            gram, n = np.unique(np.concatenate(parts), return_counts=True)
            m = len(gram)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * m, pa.string()), pa.array([depth] * m, pa.int32()), pa.array(gram.view(np.int64)), pa.array(n, pa.int64())],
                ["lang", "depth", "gram", "n"],
            )
        held.clear()

    for batch in batches:
        for lang, text in zip(each(batch.column(0)), each(batch.column(1)), strict=True):
            data = _padded(text or "")
            for depth in range(ORDER + 1):
                held.setdefault((lang, depth), []).append(_grams(data, depth))
            size += len(data)
            if size > 1 << 22:
                yield from emit()
                size = 0
    yield from emit()


class _Table:
    """Open addressing over 64-bit keys; vectorised."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, _EMPTY, dtype=np.uint64)
        self.at = np.zeros(1 << bits, dtype=np.int32)
        self.values = values
        wait, slot = np.arange(len(keys)), self._slot(keys)
        while len(wait):
            free = self.keys[slot] == _EMPTY
            first = np.unique(np.where(free, slot, -1), return_index=True)[1]
            first = first[free[first]]
            self.keys[slot[first]], self.at[slot[first]] = keys[wait[first]], wait[first]
            rest = np.ones(len(wait), bool)
            rest[first] = False
            wait, slot = wait[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is missing."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.at[slot], -1)
        wait = np.flatnonzero((held != keys) & (held != _EMPTY))
        slot = slot[wait]
        while len(wait):
            slot = (slot + 1) & self.mask
            held = self.keys[slot]
            hit = held == keys[wait]
            out[wait[hit]] = self.at[slot[hit]]
            more = ~hit & (held != _EMPTY)
            wait, slot = wait[more], slot[more]
        return out


class Model:
    """Frozen statistics: code lengths in bits by gram and language, escape lengths by context and language."""

    def __init__(self, langs: list[str], counts: dict[str, np.ndarray]):
        """counts: arrays lang (index into langs), depth, gram, n."""
        self.langs = langs
        self.key = uuid.uuid4().hex  # tells models apart in workers that stay
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        self.escapes: list[tuple[np.ndarray, np.ndarray]] = []
        for depth in range(ORDER + 1):
            mine = counts["depth"] == depth
            grams, at = np.unique(counts["gram"][mine].view(np.uint64), return_inverse=True)
            n = np.zeros((len(grams), len(langs)))
            np.add.at(n, (at, counts["lang"][mine]), counts["n"][mine])
            contexts, of = np.unique(grams >> np.uint64(8), return_inverse=True)
            total, distinct = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
            np.add.at(total, of, n)
            np.add.at(distinct, of, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                seen = -np.log2(n / (total + distinct)[of])
            shorter = np.full((len(grams), len(langs)), 8.0)
            if depth:
                keys, bits = self.tables[-1]
                shorter = bits[np.searchsorted(keys, grams & np.uint64((1 << (8 * depth)) - 1))].astype(float)
            self.tables.append((grams, np.where(n > 0, seen, escape[of] + shorter).astype(np.float32)))
            self.escapes.append((contexts, escape.astype(np.float32)))


class _Scorer:
    def __init__(self, model: Model):
        self.langs = model.langs
        self.tables = [_Table(*t) for t in model.tables]
        self.escapes = [_Table(*t) for t in model.escapes]

    def bits(self, data: np.ndarray) -> np.ndarray:
        """Bits of each byte after the first ORDER, by language."""
        keys = _grams(data, ORDER)
        out = np.zeros((len(keys), len(self.langs)), dtype=np.float32)
        wait = None
        for depth in range(ORDER, -1, -1):
            row = self.tables[depth].find(keys)
            hit = row >= 0
            if wait is None:
                out[hit] = self.tables[depth].values[row[hit]]
                wait = np.flatnonzero(~hit)
            else:
                out[wait[hit]] += self.tables[depth].values[row[hit]]
                wait = wait[~hit]
            if not len(wait):
                return out
            context = keys[~hit] >> np.uint64(8)
            row = self.escapes[depth].find(context)
            known = row >= 0
            out[wait[known]] += self.escapes[depth].values[row[known]]
            keys = keys[~hit] & np.uint64((1 << (8 * depth)) - 1)
        out[wait] += 8.0
        return out

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """Code length in bits, by text and language."""
        total = np.zeros((len(texts), len(self.langs)))
        parts: list[np.ndarray] = []
        owner: list[int] = []

        def flush():
            bits = self.bits(np.concatenate(parts))
            stops = np.cumsum([len(p) for p in parts])
            starts = stops - [len(p) for p in parts]
            for stop in stops[:-1]:
                bits[stop - ORDER : stop] = 0  # these code the padding of the next part
            np.add.at(total, owner, np.add.reduceat(bits, starts, axis=0, dtype=np.float64))
            parts.clear()
            owner.clear()

        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            data = _padded(text)
            for at in range(0, len(data) - ORDER, _SPAN):
                parts.append(data[at : at + _SPAN + ORDER])
                owner.append(i)
                size += len(parts[-1])
                if size >= _SPAN:
                    flush()
                    size = 0
        if parts:
            flush()
        return total


_SCORERS: dict[str, _Scorer] = {}


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Frozen statistics from about `sample` documents of each non-null language of `labelled`.

    Rows enter the sample by a hash of their id, so the sample is the same in each run. Rows with a null language, text
    or id are left out. The number of languages is taken to be small. No labelled row gives a model without languages.
    """
    rows = labelled.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")
    ).where("id is not null and text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        empty = np.empty(0, np.int64)
        return Model([], {"lang": empty, "depth": empty, "gram": empty, "n": empty})
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / sizes[k]))])
    place = (F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)).cast("double")
    chosen = rows.where(place < share[F.col("lang")]).select("lang", "text")
    counts = (
        chosen.mapInArrow(_count, "lang string, depth int, gram long, n long").groupBy("lang", "depth", "gram").agg(F.sum("n").alias("n"))
    ).toArrow()
    index = {k: i for i, k in enumerate(langs)}
    return Model(
        langs,
        {
            "lang": np.array([index[k] for k in counts.column("lang").to_pylist()], np.int64),
            **{c: counts.column(c).to_numpy().astype(np.int64) for c in ("depth", "gram", "n")},
        },
    )


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and bits_per_byte.

    The whole text is scored, however long; the shortest code wins, ties go to the first language in order. score is the
    probability of the predicted language, all being as likely at first, from EVIDENCE bytes of mean code length (all, if the text
    has fewer). A text that is null or has no letter, or a model without languages, gives `und`, score 0 and null bits_per_byte.
    Repeated rows are scored each. Input columns named like an added one are replaced; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    langs = model.langs

    def found(texts: list[str | None], scorer: _Scorer) -> pa.StructArray:
        scored = [t if t and langs and any(map(str.isalpha, t)) else None for t in texts]
        some = np.array([t is not None for t in scored], dtype=bool)
        bits = scorer.lengths(scored) if langs else np.zeros((len(texts), 1))
        size = np.array([max(1, len(_bytes(t))) if t is not None else 1 for t in scored], dtype=float)
        best, low = bits.argmin(axis=1), bits.min(axis=1) if len(bits) else np.zeros(0)
        weight = np.minimum(1.0, EVIDENCE / size)[:, None]
        score = 1 / np.exp2(-np.minimum((bits - low[:, None]) * weight, 1000)).sum(axis=1)
        named = [langs[b] if ok else "und" for b, ok in zip(best, some, strict=True)]
        arrays = [pa.array(named, pa.string()), pa.array(np.where(some, score, 0.0)), pa.array(low / size, pa.float64(), mask=~some)]
        return pa.StructArray.from_arrays(arrays, ["lang_pred", "score", "bits_per_byte"])

    def column(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model_now = shared.value
        if model_now.key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[model_now.key] = _Scorer(model_now)
        for batch in texts:
            parts = [found(batch.slice(i, 500).to_pylist(), _SCORERS[model_now.key]) for i in range(0, len(batch), 500)]
            yield pa.concat_arrays(parts) if parts else found([], _SCORERS[model_now.key])

    column.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    score = F.arrow_udf(column, "lang_pred string, score double, bits_per_byte double")
    base = without(docs, "lang_pred", "score", "bits_per_byte")
    names = [F.col(f"`{c}`") for c in base.columns]
    return base.select(*names, score(F.col(f"`{text_col}`").cast("string")).alias("__found")).select(*names, "__found.*")


def held_out(id_col: str, of: int, part: int) -> Column:
    """Whether crc32(id as text) mod `of` is `part`; a null id is not."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % of == part, F.lit(False))
