"""Toxicity scores from a small convolutional text classifier, trained in numpy.

A word's embedding is the mean of three rows of a hashed table: the word's own, and those of its first four and first
six letters. Filters of one, two and three words slide over the text; each filter's largest response in the whole text
feeds a logistic layer. Training takes every labelled row: embeddings start from the log odds of their words in all of them,
then all layers are fitted by Adagrad in tasks, each over the rows of one shard (SHARD rows or more, dealt evenly), and averaged by Spark:
an embedding over the shards that met it. A threshold for each language is calibrated on all labelled rows, each scored
by a network that was fitted without it (FOLDS folds by a hash of the id), in BINS bins of the score. Scores never see the language.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import checkpointed, each, without

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
SHARD, FOLDS = 16_000, 3
BINS = 4096
_PAD = max(WIDTHS) - 1
_SPAN = 1 << 17  # words convolved at once
_HELD = 200_000
_STRIP = re.compile(r"[\W_]+")
_STARTS = [zlib.crc32(k) for k in (b"w:", b"4:", b"6:")]


class Words:
    """Hashed rows of words; a worker keeps those it has met lately. Row 0 of the table is the padding."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.new: list[int] = []  # rows of the words met since rows was asked for
        self.table, self.filled = np.zeros((1024, 3), dtype=np.int32), 1

    @property
    def rows(self) -> np.ndarray:
        if self.new:
            stop = self.filled + len(self.new) // 3
            if stop > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((stop, 3), dtype=np.int32)])
            self.table[self.filled : stop] = np.array(self.new, dtype=np.int32).reshape(-1, 3)
            self.filled, self.new = stop, []
        return self.table

    def ids(self, text: str | None) -> list[int]:
        words = (text or "").lower().split()
        at = self.at
        out = list(map(at.get, words))
        if None in out:
            for k in [k for k, i in enumerate(out) if i is None]:
                i = at.get(words[k])
                out[k] = self._add(words[k]) if i is None else i
        return [i for i in out if i] if 0 in out else out

    def _add(self, word: str) -> int:
        bare = word if word.isalnum() else _STRIP.sub("", word)
        i = self.at[word] = len(self.at) + 1 if bare else 0
        if not bare:
            self.new += (0, 0, 0)
            return 0
        data = bare.encode("utf-8", "surrogatepass")
        if len(data) == len(bare):
            four, six = data[:4], data[:6]
        else:
            four, six = (bare[:n].encode("utf-8", "surrogatepass") for n in (4, 6))
        crc = zlib.crc32
        self.new += (1 + crc(data, _STARTS[0]) % (BUCKETS - 1), 1 + crc(four, _STARTS[1]) % (BUCKETS - 1), 1 + crc(six, _STARTS[2]) % (BUCKETS - 1))
        return i


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(ids, return_inverse=True) of small numbers by a table, without sorting."""
    seen = np.zeros(int(ids.max()) + 1, dtype=bool)
    seen[ids] = True
    used = np.flatnonzero(seen)
    slot = np.empty(len(seen), dtype=np.int64)
    slot[used] = np.arange(len(used))
    return used, np.take(slot, ids)


class Network:
    """Embeddings, filters and the logistic layer."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.emb = r.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.emb[0] = 0
        self.filters = [r.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.out = np.full(len(WIDTHS) * FILTERS, 0.3, dtype=np.float32)
        self.base = np.float32(-1.0)
        self.thresholds: dict[str, float] = {}

    def pooled(self, words: Words, texts: list[list[int]]) -> np.ndarray:
        """Largest responses of whole texts, long ones in overlapping spans."""
        n = len(WIDTHS) * FILTERS
        out = np.full((len(texts), n), -np.inf, dtype=np.float32)
        spans: list[list[int]] = []
        owner: list[int] = []
        size = 0

        def flush():
            stops = np.cumsum([len(s) for s in spans])
            starts = stops - [len(s) for s in spans]
            used, at = distinct(np.concatenate([np.array(s, dtype=np.int64) for s in spans]))
            vectors = self.emb[words.rows[used]].mean(axis=1)
            found = []
            for kernel in self.filters:
                z = np.take(vectors @ kernel[0], at, axis=0)
                for j in range(1, len(kernel)):
                    z[:-j] += np.take(vectors @ kernel[j], at[j:], axis=0)
                for j in range(1, _PAD + 1):
                    z[stops - j] = 0  # windows of padding alone, not of the next text
                found.append(np.maximum.reduceat(z, starts, axis=0))
            np.maximum.at(out, owner, np.hstack(found) + self.bias)
            spans.clear()
            owner.clear()

        for i, ids in enumerate(texts):
            for at in range(0, max(1, len(ids)), _SPAN):
                spans.append(ids[at : at + _SPAN + _PAD] + [0] * _PAD)
                owner.append(i)
                size += len(spans[-1])
                if size >= _SPAN:
                    flush()
                    size = 0
        if spans:
            flush()
        return np.maximum(out, 0)

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.base, -30, 30)))


def gradients(net: Network, table: np.ndarray, batch: list[np.ndarray], toxic: np.ndarray):
    """Gradients of the mean logistic loss (with 1e-4 / 2 of the squared output weights) of padded texts: of the filters, the bias and the
    output weights; of the base; the table rows of the words used; and of those words' embeddings."""
    joined = np.concatenate(batch)
    stops = np.cumsum([len(x) for x in batch])
    starts = stops - [len(x) for x in batch]
    used, at = distinct(joined)
    rows = table[used]
    vectors = net.emb[rows].mean(axis=1)
    owner = np.repeat(np.arange(len(batch)), stops - starts)
    tops, wheres = [], []
    for kernel in net.filters:
        z = np.take(vectors @ kernel[0], at, axis=0)
        for j in range(1, len(kernel)):
            z[:-j] += np.take(vectors @ kernel[j], at[j:], axis=0)
        for j in range(1, _PAD + 1):
            z[stops - j] = 0
        top = np.maximum.reduceat(z, starts, axis=0)
        where = np.full(top.shape, len(joined), dtype=np.int64)
        hit, f = np.nonzero(z == np.repeat(top, stops - starts, axis=0))
        np.minimum.at(where, (owner[hit], f), hit)
        tops.append(top)
        wheres.append(where)
    raw = np.hstack(tops) + net.bias
    pooled = np.maximum(raw, 0)
    error = (net.scores(pooled) - toxic).astype(vectors.dtype) / len(batch)
    back = error[:, None] * net.out * (raw > 0)
    filters, word_grad = [], np.zeros_like(vectors)
    for w, kernel in enumerate(net.filters):
        mine, where = back[:, w * FILTERS : (w + 1) * FILTERS], wheres[w]
        grad = np.zeros_like(kernel)
        for j in range(len(kernel)):
            place = at[np.minimum(where + j, stops[:, None] - 1)]
            for f in range(FILTERS):
                grad[j, :, f] = vectors[place[:, f]].T @ mine[:, f]
                np.add.at(word_grad, place[:, f], mine[:, f : f + 1] * kernel[j, :, f])
        filters.append(grad)
    return [*filters, back.sum(axis=0), pooled.T @ error + 1e-4 * net.out], float(error.sum()), rows, word_grad


def started(seen: np.ndarray, sizes: np.ndarray, seed: int = 7) -> Network:
    """A network that knows how much likelier a hashed row is in toxic documents: seen has the documents of each label with each row,
    sizes those of each label."""
    net = Network(seed)
    odds = np.log((seen[1] + 0.5) / (max(1, sizes[1]) + 1)) - np.log((seen[0] + 0.5) / (max(1, sizes[0]) + 1))
    net.emb[:, 0] = np.clip(np.where(seen.sum(axis=0) >= 3, odds, np.minimum(odds, 0)), -2, 4) / 2
    net.emb[0] = 0
    for kernel in net.filters:
        kernel[0, 0, 0] += 1.0
    return net


def rows_seen(words: Words, x: np.ndarray) -> np.ndarray:
    """The hashed rows of a text's words."""
    return np.unique(words.rows[np.unique(x)])


def descend(net: Network, table: np.ndarray, ids: list[np.ndarray], toxic: np.ndarray, epochs: int, rate: float, batch: int, seed: int) -> np.ndarray:
    """Adagrad over padded texts; which hashed rows it met."""
    r, met = np.random.default_rng(seed), np.zeros(BUCKETS, dtype=bool)
    params = [net.emb, *net.filters, net.bias, net.out]
    squares = [np.full(p.shape, 1e-3, dtype=np.float32) for p in params]
    base_square = 1e-3
    for _ in range(epochs):
        order = r.permutation(len(ids))
        for i in range(0, len(order), batch):
            chosen = order[i : i + batch]
            grads, base_grad, rows, row_grad_of = gradients(net, table, [ids[j] for j in chosen], toxic[chosen])
            touched, slot = distinct(rows)
            thirds = np.repeat(row_grad_of / 3, rows.shape[1], axis=0)
            row_grad = np.stack([np.bincount(slot.ravel(), thirds[:, k], len(touched)) for k in range(DIM)], axis=1).astype(np.float32)
            row_grad[touched == 0] = 0
            met[touched] = True
            squares[0][touched] += row_grad**2
            net.emb[touched] -= rate * row_grad / np.sqrt(squares[0][touched])
            for p, g, s in zip(params[1:], grads, squares[1:], strict=True):
                s += g**2
                p -= 0.5 * rate * g / np.sqrt(s)
            base_square += base_grad**2
            net.base -= np.float32(0.5 * rate * base_grad / base_square**0.5)
    return met


def fit(texts: list[str | None], toxic: np.ndarray, *, epochs: int = 8, rate: float = 0.1, batch: int = 64, seed: int = 7) -> Network:
    """Fit the network on texts with 0/1 labels; a small set is gone over more often."""
    epochs = max(epochs, min(60, 500 * batch // max(1, len(texts))))
    words = Words()
    ids = [np.array(words.ids(t) + [0] * _PAD, dtype=np.int64) for t in texts]
    if not ids:
        return Network(seed)
    seen = np.zeros((2, BUCKETS), dtype=np.float32)
    for x, y in zip(ids, toxic, strict=True):
        seen[int(y), rows_seen(words, x)] += 1
    net = started(seen, np.array([(1 - toxic).sum(), toxic.sum()]), seed)
    descend(net, words.rows, ids, toxic, epochs, rate, batch, seed)
    return net


def thresholds(scores: np.ndarray, toxic: np.ndarray, langs: list[str | None], weights: np.ndarray | None = None, default: float = 0.7) -> dict[str, float]:
    """By language, the middle of the gap that makes the fewest weighted errors; the default where a label is missing."""
    out = {}
    weights = np.ones(len(scores)) if weights is None else weights
    for lang in sorted({x for x in langs if x is not None}):
        mine = np.array([x == lang for x in langs])
        s, y, w = scores[mine], toxic[mine], weights[mine]
        if y.min() == y.max():
            out[lang] = default
            continue
        order = np.argsort(-s, kind="stable")
        s, y, w = s[order], y[order], w[order]
        errors = (w * y).sum() - np.cumsum(w * y) + np.cumsum(w * (1 - y))
        errors[:-1][s[:-1] == s[1:]] = np.inf  # no cut between equal scores
        cut = int(errors.argmin())
        out[lang] = float((s[cut] + (s[cut + 1] if cut + 1 < len(s) else 0.0)) / 2)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, y, fold) to (fold, y, row, n): the texts of a fold and label with each hashed row; all of them in row BUCKETS."""
    words, seen = Words(), np.zeros((FOLDS, 2, BUCKETS + 1), dtype=np.int64)
    for batch in batches:
        for text, y, fold in zip(each(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if len(words.at) > _HELD:
                words = Words()
            mine = seen[fold, y]
            mine[rows_seen(words, np.array(words.ids(text) + [0]))] += 1
            mine[BUCKETS] += 1
    at = np.nonzero(seen)
    yield pa.RecordBatch.from_arrays([*(pa.array(a.astype(np.int64)) for a in at), pa.array(seen[at])], ["fold", "y", "row", "n"])


def _without(seen: np.ndarray, part: int) -> Network:
    """The start of the network of all folds but one, or of all for part FOLDS."""
    kept = seen[[f for f in range(FOLDS) if f != part]].sum(axis=0).astype(np.float32)
    return started(kept[:, :BUCKETS], kept[:, BUCKETS])


def _flat(net: Network) -> np.ndarray:
    """All that is no embedding, in rows of DIM."""
    flat = np.concatenate([*(k.ravel() for k in net.filters), net.bias, net.out, [net.base]])
    return np.pad(flat, (0, -len(flat) % DIM)).reshape(-1, DIM)


def _unflat(net: Network, flat: np.ndarray) -> None:
    at, flat = 0, flat.ravel().astype(np.float32)
    for p in (*net.filters, net.bias, net.out):
        p[...] = flat[at : at + p.size].reshape(p.shape)
        at += p.size
    net.base = np.float32(flat[at])


def _fits(shared, epochs: int):
    """(text, y, part), one part a task, to (part, row, v0, ...): the rows of the network that the task's texts moved, then those of _flat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, toxic, part = Words(), [], [], None
        for batch in batches:
            for text, y, part in zip(each(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):  # noqa: B007
                ids.append(np.array(words.ids(text) + [0] * _PAD, dtype=np.int32))
                toxic.append(y)
        if ids:
            net = _without(shared.value, part)
            met = np.flatnonzero(descend(net, words.rows, ids, np.array(toxic, dtype=np.float32), epochs, 0.1, 64, 7))
            flat = _flat(net)
            values = np.concatenate([net.emb[met], flat]).astype(np.float64)
            rows = np.concatenate([met, BUCKETS + np.arange(len(flat))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), part)), pa.array(rows), *(pa.array(values[:, k]) for k in range(DIM))], ["part", "row", *(f"v{k}" for k in range(DIM))]
            )

    return run


def _judge(shared):
    """(text, y, fold, lang) to (lang, y, bin), the score by the network without the fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                batch = whole.slice(i, 64)
                if len(words.at) > _HELD:
                    words = Words()
                ids, fold = [words.ids(t) for t in each(batch.column(0))], np.array(batch.column(2).to_pylist())
                found = np.zeros(len(ids))
                for f in np.unique(fold):
                    mine = np.flatnonzero(fold == f)
                    net = shared.value[f]
                    found[mine] = net.scores(net.pooled(words, [ids[j] for j in mine]))
                bins = np.minimum(BINS - 1, np.floor(found * BINS)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(1), pa.array(bins)], ["lang", "y", "bin"])

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    label_col: str = "toxic",
    sample: int | None = None,
) -> Network:
    """A network fitted on all labelled documents; if sample is given, on about so many of each label, chosen by a hash of the id.

    Rows whose id, text or label is null are left out; so is a label other than 0 and 1. With no row left, the network is the
    untrained one and every score is low. Up to 2 * SHARD rows are gone over in one task for each network, small sets more often;
    more are dealt to shards, gone over once and averaged.
    """
    chosen = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    if sample is not None:
        sizes = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        place = (F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)).cast("double")
        share = F.when(F.col("y") == 1, min(1.0, sample / max(1, sizes.get(1, 0)))).otherwise(min(1.0, sample / max(1, sizes.get(0, 0))))
        chosen = chosen.where(place < share)
    chosen = chosen.groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")
    ).where("text is not null")
    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    chosen = F.broadcast(chosen)  # ids and labels alone, so that no text is shuffled before it is known to be labelled
    marked = texts.join(chosen, "id").select("id", "text", "y", fold, "lang")
    n = texts.select("id").join(chosen, "id").count()
    if not n:
        return Network()
    # a checkpoint keeps its partitions, so each is a shard to every network
    shards = max(1, n // SHARD)
    rows = checkpointed(marked.repartition(shards).sortWithinPartitions("id", "text", "lang"))
    spark = docs.sparkSession
    counted = rows.select("text", "y", "fold").mapInArrow(_count, "fold long, y long, row long, n long").groupBy("fold", "y", "row").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros((FOLDS, 2, BUCKETS + 1), dtype=np.int64)  # all that toArrow can hold
    seen[tuple(counted.column(c).to_numpy() for c in ("fold", "y", "row"))] = counted.column("n").to_numpy()
    epochs = max(8, min(60, 32_000 // n)) if n <= 4000 else max(1, 32_000 // n)
    parts = None
    for k in range(FOLDS + 1):
        mine = rows.where(F.col("fold") != k).select("text", "y", F.lit(k).alias("part"))
        parts = mine if parts is None else parts.union(mine)
    values = [f"v{k}" for k in range(DIM)]
    moved = parts.mapInArrow(_fits(spark.sparkContext.broadcast(seen), epochs), f"part long, row long, {', '.join(f'{v} double' for v in values)}")
    moved = moved.groupBy("part", "row").agg(*[F.avg(v).alias(v) for v in values]).toArrow()  # FOLDS + 1 networks at most
    part, row = moved.column("part").to_numpy(), moved.column("row").to_numpy()
    table = np.stack([moved.column(v).to_numpy() for v in values], axis=1)
    nets = []
    for k in range(FOLDS + 1):
        net, flat = _without(seen, k), _flat(Network())
        own = (part == k) & (row < BUCKETS)
        net.emb[row[own]] = table[own]
        own = (part == k) & (row >= BUCKETS)
        if own.any():
            flat[row[own] - BUCKETS] = table[own]
            _unflat(net, flat)
        nets.append(net)
    net = nets.pop()
    judged = rows.select("text", "y", "fold", "lang").mapInArrow(_judge(spark.sparkContext.broadcast(nets)), "lang string, y int, bin long")
    bins = judged.groupBy("lang", "y", "bin").agg(F.count(F.lit(1)).alias("n")).orderBy("lang", "y", "bin").collect()  # 2 * BINS rows a language at most
    column = lambda c: np.array([r[c] for r in bins], dtype=float)
    net.thresholds = thresholds((column("bin") + 0.5) / BINS, column("y"), [r["lang"] for r in bins], column("n"))
    return net


_WORKER: dict = {}


def score(docs: DataFrame, net: Network, *, text_col: str = "text", lang_col: str | None = "lang", default: float = 0.7) -> DataFrame:
    """docs with toxicity (0 to 1) and, if lang_col is given, toxic_in_lang (toxicity against the language's threshold).

    Whole texts are scored. A null or empty text, or one without words, gets the score of a text in which no filter
    responds. A null or unknown language takes the default threshold. Input columns named like an added one are
    replaced; repeated rows are scored each; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = _WORKER.setdefault("words", Words())
        for batch in texts:
            out = []
            for i in range(0, len(batch), 64):
                if len(words.at) > _HELD:
                    words.__init__()
                ids = [words.ids(t) for t in each(batch.slice(i, 64))]
                out.append(shared.value.scores(shared.value.pooled(words, ids)))
            yield pa.array(np.concatenate(out).astype(np.float64) if out else np.empty(0), pa.float64())

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    base = without(docs, "toxicity", "toxic_in_lang")
    scored = base.withColumn("toxicity", F.arrow_udf(run, "double")(F.col(f"`{text_col}`").cast("string")))
    if lang_col is None:
        return scored
    cut = F.lit(default)
    if net.thresholds:
        table = F.create_map(*[F.lit(x) for pair in sorted(net.thresholds.items()) for x in pair])
        cut = F.coalesce(F.try_element_at(table, F.coalesce(F.col(f"`{lang_col}`"), F.lit(""))), cut)
    return scored.withColumn("toxic_in_lang", F.col("toxicity") >= cut)
