"""Document quality by hierarchical empirical Bayes.

A logistic classifier reads plain features of the whole text and gives each document's evidence: its log odds against
the base rate. Documents come from sites (host) and parts of sites (path). The mean quality of a site is shrunk toward
the global mean, that of a path toward its site's, by a pseudo-count estimated from the spread between groups (method
of moments); a sparse group stays near what stands above it. A document's posterior joins its evidence with its path's
mean, from which its own share is taken out. Only grouped sums cross the network.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import each, kept_for, stored, without

SAMPLE = 3000
_SIGNS = [ord(c) for c in "!#$%&*|<>{}=_~^@"]
_FEATURES = 9 + len(_SIGNS)


def features(text: str | None) -> np.ndarray:
    """Shape of a text: letter cases, digits, signs, repeated words and lines, lengths."""
    out = np.zeros(_FEATURES, dtype=np.float64)
    if not text:
        return out
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    seen = np.bincount(data, minlength=256)
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    lower, upper = seen[97:123].sum(), seen[65:91].sum()
    n = max(1, len(words))
    out[0] = np.log1p(len(words))
    out[1] = min(30.0, len(text) / n)
    out[2] = upper / max(1, lower + upper)
    out[3] = seen[48:58].sum() / len(data)
    out[4] = seen[128:].sum() / len(data)
    out[5] = sum(map(operator.eq, words, words[1:])) / n
    out[6] = 1 - len(set(lines)) / max(1, len(lines))
    out[7] = (seen[44] + seen[46]) / n
    out[8] = float(len(words) < 3)
    out[9:] = np.minimum(seen[_SIGNS] / n, 1.0)
    return out


@dataclass
class Classifier:
    """Standardised logistic regression; evidence is the log odds less those of the base rate."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    base_rate: float

    def evidence(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -10, 10) @ self.weights + self.bias
        return np.clip(z, -30, 30) - np.log(self.base_rate / (1 - self.base_rate))


def fit(x: np.ndarray, y: np.ndarray, *, ridge: float = 1.0, steps: int = 60) -> Classifier:
    """Ridge logistic regression by Newton steps. Without both labels the evidence is zero."""
    if not len(y) or y.min() == y.max():
        return Classifier(np.zeros(_FEATURES), np.ones(_FEATURES), np.zeros(_FEATURES), 0.0, 0.5)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.hstack([np.clip((x - mean) / scale, -10, 10), np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(mean, scale, w[:-1], float(w[-1]), float(y.mean()))


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE
) -> Classifier:
    """A classifier fitted on about `sample` labelled documents of each label, chosen by a hash of the id.

    Rows whose id or text is null, or whose label is not 0 or 1, are left out.
    """
    marked = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = (F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)).cast("double")
    share = F.when(F.col("y") == 1, min(1.0, sample / max(1, sizes.get(1, 0)))).otherwise(min(1.0, sample / max(1, sizes.get(0, 0))))
    chosen = marked.where(place < share).groupBy("id").agg(F.min("y").alias("y"))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    made = F.arrow_udf(_feature_column, "array<double>")
    rows = texts.join(F.broadcast(chosen), "id").select("id", "y", made("text").alias("x")).toArrow().sort_by("id")  # bounded by the sample
    x = np.array(rows.column("x").to_pylist(), dtype=float).reshape(-1, _FEATURES)
    found = fit(x, np.array(rows.column("y").to_pylist(), dtype=float))
    return found


def _feature_column(texts: pa.Array) -> pa.Array:
    return pa.array([features(t) for t in each(texts)], pa.list_(pa.float64()))


def _evidence(net: Classifier, text: Column, spark) -> Column:
    shared = spark.sparkContext.broadcast(net)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept_for("quality")
        for batch in texts:
            x = np.array([features(t) for t in each(batch)]).reshape(-1, _FEATURES)
            found = shared.value.evidence(x)
            found[[not t for t in each(batch)]] = 0.0
            yield pa.array(found, pa.float64())

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # never null, and Spark is told so: a filter on what is made of it would else run it once more, in a second worker, to drop nulls
    return F.coalesce(F.arrow_udf(run, "double")(text.cast("string")), F.lit(0.0))


def _pseudo_count(groups: DataFrame, total: str, n: str, around: Column) -> float:
    """kappa of Beta(kappa m, kappa (1 - m)) by moments: what the spread of group means leaves beyond sampling."""
    mean = F.col(total) / F.col(n)
    r = groups.agg(
        F.sum(F.col(n) * (mean - around) ** 2).alias("between"), F.sum(n).alias("n"), F.count(F.lit(1)).alias("k"), F.avg(around * (1 - around)).alias("v")
    ).first()
    if not r["n"] or r["v"] is None or r["k"] < 2:
        return 1.0
    spread = max(r["between"] / r["n"] - r["v"] * r["k"] / r["n"], 1e-6)
    return float(np.clip(r["v"] / spread - 1, 1.0, 1e6))


@dataclass
class Sites:
    """Sums by path, with the shrunk mean of the site above; kappa of paths; the global mean."""

    paths: DataFrame
    kappa: float
    mean: float


def _key(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))


def site_means(
    docs: DataFrame, net: Classifier, *, text_col: str = "text", host_col: str = "source", path_col: str = "lang", prior: float = 0.5
) -> Sites:
    """Grouped sums of document probabilities over all of docs. A null host or path is a group of its own."""
    p = 1 / (1 + F.exp(-(F.col("e") + float(np.log(prior / (1 - prior))))))
    rows = docs.select(_key(host_col).alias("host"), _key(path_col).alias("path"), _evidence(net, F.col(f"`{text_col}`"), docs.sparkSession).alias("e"))
    paths = stored(rows.groupBy("host", "path").agg(F.sum(p).alias("s"), F.count(F.lit(1)).alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("host_s"), F.sum("n").alias("host_n"))
    whole = hosts.agg(F.sum("host_s").alias("s"), F.sum("host_n").alias("n")).first()
    mean = float(np.clip(whole["s"] / whole["n"], 1e-6, 1 - 1e-6)) if whole["n"] else prior
    kappa_host = _pseudo_count(hosts, "host_s", "host_n", F.lit(mean))
    hosts = hosts.select("host", ((F.col("host_s") + kappa_host * mean) / (F.col("host_n") + kappa_host)).alias("host_mean"))
    paths = stored(paths.join(hosts, "host"), "sites")
    return Sites(paths, _pseudo_count(paths, "s", "n", F.col("host_mean")), mean)


def judged(
    docs: DataFrame,
    net: Classifier,
    sites: Sites,
    *,
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    prior: float = 0.5,
    threshold: float = 0.5,
) -> DataFrame:
    """docs with evidence, site_mean, quality_score (posterior, 0 to 1) and quality_kept (posterior at or over the threshold).

    A null or empty text is no evidence: it is judged by its site alone. Texts of any length are judged as a whole. Input columns named like an added one are
    replaced; repeated rows are judged each; an empty table gives an empty result.
    """
    base = without(docs, "evidence", "site_mean", "quality_score", "quality_kept")
    names = [F.col(f"`{c}`") for c in base.columns]
    table = sites.paths.select(F.col("host").alias("__host"), F.col("path").alias("__path"), "s", "n", "host_mean")
    own = 1 / (1 + F.exp(-(F.col("evidence") + float(np.log(prior / (1 - prior))))))
    k = sites.kappa
    # the table is read from files, so its size is known when the join is planned
    joined = (
        base.select(*names, _key(host_col).alias("__host"), _key(path_col).alias("__path"))
        .withColumn("evidence", _evidence(net, F.col(f"`{text_col}`"), docs.sparkSession))
        .join(table, ["__host", "__path"], "left")
    )
    m = F.col("host_mean")
    mean = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.coalesce((F.col("s") - own + k * m) / (F.col("n") - 1 + k), F.lit(sites.mean))))
    return (
        joined.withColumn("site_mean", mean)
        .withColumn("quality_score", 1 / (1 + F.exp(-(F.col("evidence") + F.log(F.col("site_mean") / (1 - F.col("site_mean")))))))
        .select(*names, "evidence", "site_mean", "quality_score", (F.col("quality_score") >= threshold).alias("quality_kept"))
    )
