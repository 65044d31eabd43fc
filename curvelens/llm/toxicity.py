"""Toxicity: a bidirectional gated recurrent network with attention pooling, over all overlapping windows.

A word enters with what it and its character n-grams told of toxicity in the training texts, and with a small
embedding. Two gated recurrent passes run over windows of words, attention pools their states, and a text
scores as its worst window. Labels belong to texts, so training takes the windows that score highest
just now: the worst one of a toxic text, the worst two and a random one of a clean text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelens.llm.common import body, ship, staged

#: Labelled texts that the network is fitted on, at most.
FIT_TOXIC, FIT_CLEAN = 700, 2_100
WINDOW, STRIDE, HIDDEN, EMBEDDED, FOLDS = 24, 12, 8, 4, 5
LONGEST, GRAMS = 32, (3, 4, 5)
BUCKETS, EMBEDDINGS = 1 << 18, 1 << 12
#: Share of the training texts from which a word has an embedding.
USUAL = 0.02
#: Passes over the chosen windows, and the steps that a small sample is given at least.
EPOCHS, LEAST_STEPS, BATCH, RATE = 10, 900, 128, 0.01
#: Words and windows that are worked on together.
TOGETHER, ROWS = 1_000_000, 4096
EDGES = b".,;:!?\"'()[]|"
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def split(text: str | None) -> list[bytes]:
    """Lower-cased words; one longer than LONGEST bytes counts as several."""
    words = (text or "").encode().lower().split()
    if words and max(map(len, words)) > LONGEST:
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


class Numbered(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of each word with its edges marked, padded, and the lengths."""
    marked = [b"^" + (w.strip(EDGES) or w) + b"$" for w in words]
    chars = np.frombuffer(b"".join(w.ljust(LONGEST + 2, b"\0") for w in marked), np.uint8)
    return chars.reshape(len(words), LONGEST + 2), np.fromiter(map(len, marked), np.int64, len(marked))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * K2
    return (h ^ (h >> np.uint64(29))) & np.uint64(BUCKETS - 1)


def word_buckets(chars: np.ndarray) -> np.ndarray:
    h = np.full(len(chars), 7, np.uint64)
    for i in range(chars.shape[1]):
        h = h * K1 + chars[:, i].astype(np.uint64)
    return _mixed(h).astype(np.int64)


def gram_buckets(chars: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each place and length: the words that have such an n-gram, and its bucket."""
    for n in GRAMS:
        for i in range(int(lengths.max(initial=0)) - n + 1):
            has = np.flatnonzero(lengths >= i + n)
            h = np.full(len(has), n, np.uint64)
            for k in range(n):
                h = h * K1 + chars[has, i + k].astype(np.uint64)
            yield has.astype(np.int32), _mixed(h).astype(np.int32)


def _told(toxic: np.ndarray, clean: np.ndarray, toxics: int, cleans: int) -> np.ndarray:
    """Log odds of toxicity, nearer to 0 the rarer the word."""
    toxic, clean = np.maximum(toxic, 0), np.maximum(clean, 0)
    odds = np.log((toxic + 0.5) / (toxics + 1)) - np.log((clean + 0.5) / (cleans + 1))
    return (odds * (toxic + clean) / (toxic + clean + 2) / 4).astype(np.float32)


@dataclass
class Evidence:
    """Texts of either class by bucket, of words and of n-grams."""

    texts: np.ndarray = field(default_factory=lambda: np.zeros(2, np.int64))
    words: np.ndarray = field(default_factory=lambda: np.zeros((2, BUCKETS), np.int32))
    grams: np.ndarray = field(default_factory=lambda: np.zeros((2, BUCKETS), np.int32))

    def tables(self, without: Evidence | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log odds by bucket, of words and of n-grams; without those texts, if given."""
        rest = [x - y for x, y in zip((self.texts, self.words, self.grams), (without.texts, without.words, without.grams))] if without else (self.texts, self.words, self.grams)
        return tuple(_told(c[1], c[0], *rest[0][::-1]) for c in rest[1:])


def inputs(words: list[bytes], tables: tuple[np.ndarray, np.ndarray], usual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: its own log odds, the highest, mean and lowest of its n-grams; and its embedding's row.

    Words of buckets that are not usual share row 0, so that no text is learned by heart.
    """
    chars, lengths = spelled(words)
    own = word_buckets(chars)
    high, low = np.full(len(words), -9, np.float32), np.full(len(words), 9, np.float32)
    total, count = np.zeros(len(words), np.float32), np.zeros(len(words), np.float32)
    for has, bucket in gram_buckets(chars, lengths):
        v = tables[1][bucket]
        high[has], low[has] = np.maximum(high[has], v), np.minimum(low[has], v)
        total[has] += v
        count[has] += 1
    high, low = np.where(count > 0, high, 0), np.where(count > 0, low, 0)
    return np.column_stack([tables[0][own], high, total / np.maximum(count, 1), low]).astype(np.float32), np.where(usual[own], own % (EMBEDDINGS - 1) + 1, 0)


# --- the network


def soft(x):
    return x / (1 + np.abs(x))


def _slope(x):
    return 1 / (1 + np.abs(x)) ** 2


def new_network(seed: int = 11) -> dict[str, np.ndarray]:
    rng, d, h = np.random.default_rng(seed), 4 + EMBEDDED, HIDDEN
    w = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
    net = {"E": 0.1 * w(EMBEDDINGS, EMBEDDED) * np.sqrt(EMBEDDINGS).astype(np.float32), "A": w(2 * h, h), "v": w(h, 1), "o": w(2 * h, 1), "c": np.zeros(1, np.float32)}
    for side in "fb":
        net |= {f"W{side}": w(d, 3 * h), f"U{side}": w(h, 3 * h), f"B{side}": np.zeros(3 * h, np.float32)}
    return net


def forward(net, p: dict[str, list[np.ndarray]], mask: np.ndarray, keep: bool = False):
    """Logits of windows from the projected inputs of each step, by direction; mask is (steps, windows)."""
    steps, n, h = len(mask), mask.shape[1], HIDDEN
    states, saved = np.empty((steps, n, 2 * h), np.float32), {"f": [None] * steps, "b": [None] * steps}
    for side, order, cols in (("f", range(steps), slice(0, h)), ("b", range(steps - 1, -1, -1), slice(h, 2 * h))):
        state, u = np.zeros((n, h), np.float32), net[f"U{side}"]
        for t in order:
            a, x = state @ u, p[side][t]
            gates = x[:, : 2 * h] + a[:, : 2 * h]
            zr = 0.5 + 0.5 * soft(gates)
            q = x[:, 2 * h :] + zr[:, h:] * a[:, 2 * h :]
            new = soft(q)
            out = (new + zr[:, :h] * (state - new)) * mask[t][:, None]
            if keep:
                saved[side][t] = (state, a, gates, zr, q, new)
            state = states[t, :, cols] = out
    e1 = states @ net["A"]
    e = (soft(e1) @ net["v"])[:, :, 0] + (mask - 1) * 1e4
    e = np.exp(e - e.max(axis=0))
    alpha = e / e.sum(axis=0)
    pooled = np.einsum("tn,tnk->nk", alpha, states)
    logit = (pooled @ net["o"])[:, 0] + net["c"][0]
    return (logit, (states, saved, e1, alpha, pooled)) if keep else logit


def backward(net, x: np.ndarray, mask: np.ndarray, kept, miss: np.ndarray):
    """Gradients of the parameters and of the inputs x (steps, windows, inputs), for d loss / d logit."""
    states, saved, e1, alpha, pooled = kept
    steps, n, h = len(mask), mask.shape[1], HIDDEN
    g = {"o": pooled.T @ miss[:, None], "c": np.array([miss.sum()])}
    d_pooled = miss[:, None] * net["o"][:, 0]
    d_states = alpha[:, :, None] * d_pooled
    d_alpha = np.einsum("nk,tnk->tn", d_pooled, states)
    d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
    g["v"] = np.einsum("tnk,tn->k", soft(e1), d_e)[:, None]
    d_e1 = d_e[:, :, None] * net["v"][:, 0] * _slope(e1)
    g["A"] = np.einsum("tni,tnj->ij", states, d_e1)
    d_states = d_states + d_e1 @ net["A"].T
    d_x = np.zeros_like(x)
    for side, order, cols in (("f", range(steps - 1, -1, -1), slice(0, h)), ("b", range(steps), slice(h, 2 * h))):
        u, w = net[f"U{side}"], net[f"W{side}"]
        g[f"U{side}"], g[f"W{side}"], g[f"B{side}"] = np.zeros_like(u), np.zeros_like(w), np.zeros(3 * h, np.float32)
        back = np.zeros((n, h), np.float32)
        for t in order:
            state, a, gates, zr, q, new = saved[side][t]
            d = (d_states[t, :, cols] + back) * mask[t][:, None]
            z, r = zr[:, :h], zr[:, h:]
            d_q = d * (1 - z) * _slope(q)
            d_gates = np.concatenate([d * (state - new), d_q * a[:, 2 * h :]], axis=1) * 0.5 * _slope(gates)
            d_p = np.concatenate([d_gates, d_q], axis=1)
            d_a = np.concatenate([d_gates, d_q * r], axis=1)
            g[f"U{side}"] += state.T @ d_a
            g[f"W{side}"] += x[t].T @ d_p
            g[f"B{side}"] += d_p.sum(axis=0)
            d_x[t] += d_p @ w.T
            back = d * z + d_a @ u.T
    return g, d_x


# --- windows and texts


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in the joined words, number of words and text of every window of texts that are not empty."""
    count = np.where(lengths > 0, np.maximum(-(-(lengths - WINDOW) // STRIDE), 0) + 1, 0)
    text = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    starts = np.cumsum(lengths) - lengths
    return starts[text] + nth * STRIDE, np.minimum(lengths[text] - nth * STRIDE, WINDOW), text


def _steps(start: np.ndarray, size: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and mask, (steps, windows)."""
    at = np.arange(WINDOW)[:, None]
    mask = at < size
    return np.where(mask, words[np.minimum(start + at, len(words) - 1)], 0), mask.astype(np.float32)


def window_logits(net, x: np.ndarray, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``x`` has the inputs of each distinct word, ``ids`` the words in a row."""
    projected = {s: x @ net[f"W{s}"] + net[f"B{s}"] for s in "fb"}
    out = np.empty(len(start), np.float32)
    for i in range(0, len(start), ROWS):
        at, mask = _steps(start[i : i + ROWS], size[i : i + ROWS], ids)
        out[i : i + ROWS] = forward(net, {s: [projected[s][a] for a in at] for s in "fb"}, mask)
    return out


@dataclass
class Model:
    net: dict[str, np.ndarray]
    tables: tuple[np.ndarray, np.ndarray]
    usual: np.ndarray

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        """Probability of toxicity of texts as lists of words; 0 without words."""
        numbers = Numbered()
        ids = np.array([n for words in texts for n in map(numbers.__getitem__, words)], np.int64)
        out = np.zeros(len(texts))
        if len(ids):
            told, row = inputs(list(numbers), self.tables, self.usual)
            start, size, text = windows(np.array([len(w) for w in texts]))
            logits = window_logits(self.net, np.concatenate([told, self.net["E"][row]], axis=1), ids, start, size)
            worst = np.full(len(texts), -np.inf)
            np.maximum.at(worst, text, logits)
            out = 1 / (1 + np.exp(-worst))
        return out


def fit(texts: list[str], toxic: np.ndarray, seed: int = 5) -> Model | None:
    """A network from labelled texts; None without both classes. Deterministic."""
    split_texts = [split(t) for t in texts]
    keep = [i for i, w in enumerate(split_texts) if w]
    split_texts, toxic = [split_texts[i] for i in keep], np.asarray(toxic, int)[keep]
    if len(set(toxic)) < 2:
        return None
    numbers = Numbered()
    each = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in split_texts]
    vocabulary = list(numbers)
    evidence, parts = Evidence(), [Evidence() for _ in range(FOLDS)]
    fold = np.empty(len(each), np.int64)
    for y in (0, 1):
        fold[toxic == y] = np.arange((toxic == y).sum()) % FOLDS
    chars, lengths = spelled(vocabulary)
    own = word_buckets(chars)
    of_word, of_gram = map(np.concatenate, zip(*gram_buckets(chars, lengths)))
    order = np.argsort(of_word, kind="stable")
    of_gram, ends = of_gram[order], np.searchsorted(of_word[order], np.arange(len(vocabulary) + 1))
    del of_word, order, split_texts
    for ids, y, k in zip(each, toxic, fold):
        distinct = np.unique(ids)
        found = np.unique(np.concatenate([of_gram[ends[i] : ends[i + 1]] for i in distinct]))
        for e in (evidence, parts[k]):
            e.texts[y] += 1
            e.words[y][np.unique(own[distinct])] += 1
            e.grams[y][found] += 1

    usual = evidence.words.sum(axis=0) >= max(USUAL * len(each), 10)
    # A text is learned from the evidence of the other folds.
    told, row = np.empty((FOLDS, len(vocabulary), 4), np.float32), None
    for k in range(FOLDS):
        told[k], row = inputs(vocabulary, evidence.tables(parts[k]), usual)
    ids, rng = np.concatenate(each), np.random.default_rng(seed)
    start, size, text = windows(np.array([len(e) for e in each]))
    of_class, of_fold = toxic[text], fold[text]
    net = new_network()
    moved, squared = ({k: np.zeros_like(v, np.float32) for k, v in net.items()} for _ in range(2))
    step = 0
    logits = np.empty(len(start), np.float32)
    for k in range(FOLDS):
        mine = np.flatnonzero(of_fold == k)
        at, mask = _steps(start[mine], size[mine], ids)
        logits[mine] = (told[k][:, :2].sum(axis=1)[at] * mask - (1 - mask)).max(axis=0)
    share = (toxic == 0).sum() / max((toxic == 1).sum(), 1)
    a_pass = -(-(int((toxic == 1).sum()) + 3 * int((toxic == 0).sum())) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // a_pass))
    for epoch in range(epochs):
        if epoch:
            for k in range(FOLDS):
                mine = np.flatnonzero(of_fold == k)
                x = np.concatenate([told[k], net["E"][row]], axis=1)
                logits[mine] = window_logits(net, x, ids, start[mine], size[mine])
        ranked = np.lexsort((-logits, text))
        place = np.arange(len(ranked)) - np.searchsorted(text[ranked], text[ranked])
        chosen = ranked[(place == 0) | ((place == 1) & (of_class[ranked] == 0))]
        clean = np.flatnonzero(of_class == 0)
        chosen = np.concatenate([chosen, rng.choice(clean, min(len(clean), int((toxic == 0).sum())), replace=False)])
        rng.shuffle(chosen)
        for i in range(0, len(chosen), BATCH):
            pick = chosen[i : i + BATCH]
            at, mask = _steps(start[pick], size[pick], ids)
            y = of_class[pick]
            x = np.concatenate([told[of_fold[pick], at], net["E"][row[at]]], axis=2)
            logit, kept = forward(net, {s: [v @ net[f"W{s}"] + net[f"B{s}"] for v in x] for s in "fb"}, mask, True)
            miss = (1 / (1 + np.exp(-logit)) - y) * np.where(y == 1, min(share, 4.0), 1.0) / len(pick)
            g, d_x = backward(net, x, mask, kept, miss.astype(np.float32))
            g["E"] = np.zeros_like(net["E"])
            np.add.at(g["E"], row[at].ravel(), (d_x[:, :, 4:] * mask[:, :, None]).reshape(-1, EMBEDDED))
            step += 1
            for k in net:
                moved[k] = 0.9 * moved[k] + 0.1 * g[k]
                squared[k] = 0.99 * squared[k] + 0.01 * g[k] ** 2
                rate = RATE * (1 - epoch / (epochs + 1))
                net[k] = (net[k] - rate * (moved[k] / (1 - 0.9**step)) / (np.sqrt(squared[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Model(net, evidence.tables(), usual)


def train(docs: DataFrame, labels: DataFrame, toxics: int = FIT_TOXIC, cleans: int = FIT_CLEAN) -> Model | None:
    """A model from at most ``toxics`` and ``cleans`` labelled texts, those of the smallest hashed ids.

    Texts under contradicting labels are left out. None without both classes.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min("toxic").alias("__y"), F.max("toxic").alias("__z"))
    known = known.where("__y = __z").drop("__z")
    first = lambda y, n: known.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(n)
    chosen = staged(first(1, toxics).unionByName(first(0, cleans)), "toxicity-labels")
    got = docs.select("doc_id", body().alias("__t")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    got = got.select("__id", "__y", "__t").dropDuplicates(["__id"]).orderBy(F.xxhash64("__id"), "__id").toPandas()
    return fit(got["__t"].tolist(), got["__y"].to_numpy())


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """All columns, plus toxicity (0 to 1), the score of the worst window of the text.

    * Null, empty and blank texts score 0.
    * Only texts are scored from; repeated rows and null ids score like others.
    * Without labels of both classes every text scores 0. A column named toxicity is replaced.
    """
    ship(docs.sparkSession)
    model = model or train(docs, labels)
    if model is None:
        return docs.withColumn("toxicity", F.lit(0.0))

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out, held, words = [], [], 0
            for text in part:
                held.append(split(text))
                words += len(held[-1])
                if words >= TOGETHER:
                    out.append(model.scores(held))
                    held, words = [], 0
            out.append(model.scores(held))
            yield pd.Series(np.concatenate(out))

    return docs.withColumn("toxicity", F.pandas_udf(run, "double")(F.col("text")))
