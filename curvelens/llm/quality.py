"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic regression on surface measures gives each document evidence. The evidence is summed by path and
by host; a host's mean is shrunk toward the global mean and a path's toward its host, with strengths that
the spread between hosts and between paths tells. The score joins both in log odds; a document's own
evidence is left out of the site means that it meets.
"""

from __future__ import annotations

import math
import operator
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelens.llm.common import ship, small, staged

#: Labelled rows that the classifier is fitted on, at most.
FIT_ROWS = 20_000
BINS, STEPS, RIDGE = 8, 300, 1e-3
SYMBOLS, MARKS = b"#$%&*+/<=>@\\^_`{|}~", b"!?.,;:"
LOUD = (b"!!", b"!?", b"?!", b"??")
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
PART = 4096  # bytes that the repetition of words is measured on at a time


def measures(text: str | None) -> list[float]:
    """Surface measures of a text; of an empty one all are 0."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * 12
    n, count = len(raw), len(words)
    share = lambda chars: (n - len(raw.translate(None, chars))) / n
    lines = raw.count(b"\n") + 1
    loud = re.findall(rb"[!?]{2,}", raw) if any(two in raw for two in LOUD) else []
    packed = sum(len(zlib.compress(raw[i : i + PART], 1)) for i in range(0, n, PART))
    return [
        math.log1p(n), n / count, share(SYMBOLS), share(MARKS), share(UPPER), share(DIGITS), raw.count(b" | ") / count,
        len(set(words)) / count, packed / n, count / lines, sum(map(len, loud)) / count,
        sum(map(operator.eq, words, words[1:])) / count,
    ]


@dataclass
class Classifier:
    """Logistic regression on binned measures."""

    edges: list[np.ndarray]
    weights: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        width = max(len(e) for e in self.edges) + 1
        at = np.column_stack([np.searchsorted(e, x[:, i]) + i * width for i, e in enumerate(self.edges)])
        return np.column_stack([at, np.full(len(x), len(self.edges) * width)])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.weights[self.cells(x)].sum(axis=1)))


def fit(x: np.ndarray, y: np.ndarray) -> Classifier:
    """Ridge logistic regression by accelerated gradient steps; deterministic."""
    edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]
    model = Classifier(edges, np.zeros((len(edges)) * (max(map(len, edges)) + 1) + 1))
    cells, ahead, rate = model.cells(x), np.zeros_like(model.weights), 4.0 / (x.shape[1] + 1)
    for k in range(STEPS):
        miss = 1 / (1 + np.exp(-ahead[cells].sum(axis=1))) - y
        slope = np.bincount(cells.ravel(), np.repeat(miss, cells.shape[1]), len(ahead)) / len(y) + RIDGE * ahead
        new = ahead - rate * slope
        ahead, model.weights = new + k / (k + 3) * (new - model.weights), new
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Classifier | None:
    """A classifier from at most ``rows`` labelled documents, those of the smallest hashed ids.

    None if the labels do not hold both classes.
    """
    ship(docs.sparkSession)
    known = labels.where("quality in (0, 1)").select(F.col("doc_id").alias("__id"), F.col("quality").alias("__y"))
    chosen = staged(known.distinct().orderBy(F.xxhash64("__id"), "__id", "__y").limit(rows), "quality-labels")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))

    def measured(parts):
        for part in parts:
            yield pd.DataFrame({"x": [measures(t) for t in part["text"]], "y": part["__y"].astype("int32")})

    got = staged(sample.select("text", "__y").mapInPandas(measured, "x array<double>, y int"), "quality-fit").orderBy("x", "y").collect()
    if len({r.y for r in got}) < 2:
        return None
    return fit(np.array([r.x for r in got]), np.array([r.y for r in got], float))


def evidence(text: Column, model: Classifier | None) -> Column:
    """Probability of good quality from the text alone; 0.5 without a model."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.probability(np.array([measures(t) for t in texts]).reshape(len(texts), -1)))

    return score(text)


def _spread(groups: DataFrame, up: list[str]) -> float:
    """Prior strength of group means around their parents', by moments; groups has __s, __n."""
    totals = groups.groupBy(*up).agg(F.sum("__s").alias("__us"), F.sum("__n").alias("__un"), F.count(F.lit(1)).alias("__k"))
    if up:
        both = groups.join(small(staged(totals, "site-totals")), up)
    else:  # one parent: its sums are three numbers
        both = groups.withColumns({name: F.lit(v) for name, v in totals.first().asDict().items()})
    m, mean = F.col("__us") / F.col("__un"), F.col("__s") / F.col("__n")
    x = both.agg(
        F.sum(F.col("__n") * (mean - m) ** 2).alias("between"), F.sum(F.col("__n") * m * (1 - m)).alias("within"),
        F.sum(m * (1 - m) * (1 - F.col("__n") / F.col("__un"))).alias("chance"), F.sum("__n").alias("n"),
    ).first()
    if not x.n or not x.within:
        return 1e6
    share = max((x.between - x.chance) / x.within, 0.0)
    return min(max(1 / share - 1, 1.0), 1e6) if share else 1e6


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", model: Classifier | None = None) -> DataFrame:
    """All columns, plus evidence, host_posterior, path_posterior, score (0 to 1) and rejected.

    ``host`` names the site's column, ``path`` the part of it below; null ones form groups of their own.

    * Null and empty texts get the evidence of an empty document.
    * Every row counts once, repeated rows too; null ids are only left out of the fitting.
    * Columns of the caller that bear the names of the new ones are replaced.
    * Without labels of both classes every evidence is 0.5 and nothing is rejected.
    """
    new = ["evidence", "host_posterior", "path_posterior", "score", "rejected"]
    names = [c for c in docs.columns if c not in new]
    ship(docs.sparkSession)
    model = model or train(docs, labels)
    rows = docs.select(names).withColumns({
        "__host": F.struct(F.col(host)), "__path": F.struct(F.col(path)),
    }).withColumn("evidence", evidence(F.col("text"), model))
    rows = rows.withColumns({"__host": F.xxhash64("__host"), "__path": F.xxhash64("__host", "__path")})
    paths = staged(rows.groupBy("__host", "__path").agg(F.sum("evidence").alias("__s"), F.count(F.lit(1)).alias("__n")), "paths")
    hosts = staged(paths.groupBy("__host").agg(F.sum("__s").alias("__s"), F.sum("__n").alias("__n")), "hosts")
    total = hosts.agg(F.sum("__s").alias("s"), F.sum("__n").alias("n")).first()
    mean = min(max(total.s / total.n, 1e-6), 1 - 1e-6) if total.n else 0.5
    k_host, k_path = _spread(hosts, []), _spread(paths, ["__host"])

    sites = paths.join(hosts.select("__host", F.col("__s").alias("__hs"), F.col("__n").alias("__hn")), "__host").drop("__host")
    own = F.col("evidence")
    at_host = (k_host * mean + F.col("__hs") - own) / (k_host + F.col("__hn") - 1)
    at_path = (k_path * F.col("host_posterior") + F.col("__s") - own) / (k_path + F.col("__n") - 1)
    odds = lambda p: F.ln(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))
    joined = rows.join(small(staged(sites, "sites")), "__path").withColumn("host_posterior", at_host).withColumn("path_posterior", at_path)
    scored = joined.withColumn("score", 1 / (1 + F.exp(-(odds(own) + odds(F.col("path_posterior")) - math.log(mean / (1 - mean))))))
    out = scored.withColumn("rejected", F.col("score") < 0.5) if model else scored.withColumn("rejected", F.lit(False))
    return out.select(*names, *new)
