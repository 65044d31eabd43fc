"""Spelling variants against a plain version."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus_data import EDGES, documents

from curvelens.llm import queries, spelling


def plain_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    n, out = plain_words(rows), {}
    shapes = {}  # words by themselves with one place left out: near words share one
    for w in n:
        for k in range(len(w)):
            shapes.setdefault(w[:k] + w[k + 1 :], set()).add(w)
        shapes.setdefault(w, set()).add(w)
    near = {w: set() for w in n}
    for group in shapes.values():
        for a in group:
            near[a] |= {b for b in group if b != a and one_edit(a, b)}
    for w, found in near.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best and n[best] >= 10 * n[w] else None, n[w], len(found))
    def root(w):
        return root(out[w][0]) if out[w][0] else w
    return {w: (form, root(w), k, m, n[form] if form else None) for w, (form, k, m) in out.items()}


def result(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_near_is_one_edit():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(3, 7))) for _ in range(150)} | {"é" * 5, "aé" * 3})
    block = spelling.matrices(words)
    close, _ = spelling.near(block, block)
    assert np.array_equal(close, [[one_edit(a, b) for b in words] for a in words])


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_spelling_query(spark, folder):
    path = f"/root/testdata/{folder}"
    want = plain(queries.table(spark, path, "documents").select("doc_id", "text").collect())
    got = result(queries.op12_spelling(spark, path))
    assert got == want and any(r[0] for r in want.values())


def made(seed, n=120):
    """Texts of few long words and their variants, of very different counts."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(7, 40))) for _ in range(12)]
    rows = []
    for k in range(n):
        words = []
        for _ in range(60):
            w = rng.choice(base[: 1 + k % 12])
            if rng.random() < 0.1:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abc") + w[i:], w[:i] + rng.choice("abc") + w[i + 1 :]])
            words.append(w.upper() if rng.random() < 0.2 and "é" not in w else w)
        rows.append((k, " ".join(words) + rng.choice(["", ".", "2", "×", "Œ"])))
    return rows


@pytest.mark.parametrize("most, side", [(4096, 128), (60, 16)])
def test_large_groups_are_taken_apart(spark, monkeypatch, most, side):
    rows = made(most)
    monkeypatch.setattr(spelling, "SIDE", side)
    monkeypatch.setattr(spelling, "WINDOWS", 2)
    monkeypatch.setattr(spelling.meetings, "__defaults__", (most,))
    want = plain(rows)
    assert result(spelling.spelling_variants(documents(spark, rows))) == want
    assert sum(r[3] > 3 for r in want.values()) > 20


def test_tiles_span_batches(monkeypatch):
    import pandas as pd

    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab") for _ in range(8)) for _ in range(120)})
    rows = pd.DataFrame([(k // 3 % 5, w, 5, 8, 0, 8) for k, w in enumerate(words)], columns=["key", "word", "n", "size", "start", "stop"]).sort_values("key")
    whole = pd.concat(list(spelling._met(iter([rows])))).sort_values("word").reset_index(drop=True)
    parts = pd.concat(list(spelling._met(rows.iloc[k : k + 7] for k in range(0, len(rows), 7)))).sort_values("word").reset_index(drop=True)
    assert whole.equals(parts)
    keys = dict(zip(rows["word"], rows["key"]))
    for r in whole.itertuples():
        assert r.n_near == sum(one_edit(r.word, w) for w in words if keys[w] == keys[r.word])


def test_chains_lead_to_the_last_form(spark):
    n = {"wordone": 2, "wordonex": 20, "wordonexy": 200, "wordonexyz": 2000}
    rows = [(k, " ".join([w] * 2)) for w, k in n.items() for k in range(k // 2)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    want = plain(rows)
    assert result(spelling.spelling_variants(documents(spark, rows))) == want
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(9)], "word string, form string")
    assert dict(map(tuple, spelling.roots(forms).collect())) == {f"w{k}": "w9" for k in range(9)}


def test_spelling_edges(spark, edges, nothing):
    assert result(spelling.spelling_variants(edges)) == plain(EDGES)
    assert result(spelling.spelling_variants(nothing)) == {}
    long = ["q" * 50_000 + "w" * k for k in (0, 1, 2)]
    rows = [(k, f"{w} {w}") for k, w in enumerate(long)] + [(None, "abcdefgh abcdefgh"), (None, None)]
    assert result(spelling.spelling_variants(documents(spark, rows))) == plain(rows)
