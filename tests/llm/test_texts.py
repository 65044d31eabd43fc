"""BPE, fingerprints, licences, quality, toxicity and language model."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from brute import likeness, words
from corpus_data import EDGES, documents, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curvelens.llm import bpe, common, fingerprints, licenses, lm, quality, queries, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pieces():
    return bpe.PieceCache(bpe.Merges(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("block, long", [(1 << 16, 4096), (1, 3), (7, 6), (50, 40)])
def test_streamed_ids_equal_the_library(pieces, library, monkeypatch, block, long):
    monkeypatch.setattr(bpe, "BLOCK", block)
    monkeypatch.setattr(bpe, "LONG", long)
    rng = random.Random(block)
    parts = ["a", "the", " ", "  ", "\n", "'", "'re", "é", "ß", "12", "!", "--", "=", "<|endoftext|>", "<|endo", "中文", "🙂", "ing", "\t", "x" * 30]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) + rng.choice(["", "-", " ", "ha"]) * rng.randint(0, 300)
        ids = bpe.encode(text, pieces)
        assert list(memoryview(ids).cast("I")) == library.encode(text, add_special_tokens=False).ids
        assert bpe.decode(ids, pieces.merges) == text


def test_new_pieces_are_merged_together(pieces, library, monkeypatch):
    """Texts of one block: no piece is merged on its own, and the ids are those of the library."""
    rng = random.Random(5)
    text = lambda k: "".join(rng.choice("abcdeéß12 -中\n") for _ in range(40 * k))
    texts = [text(k) for k in range(30)] + [None, "", "x" * 300 + " y", "a<|endoftext|>b", "q" * 70 + "é" * 40]
    fresh = bpe.PieceCache(pieces.merges)
    with monkeypatch.context() as m:
        m.setattr(bpe.Merges, "merge", None)
        got = bpe.encode_all(texts[:30], fresh)
    got += bpe.encode_all(texts[30:], fresh)
    assert [list(memoryview(g).cast("I")) for g in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [bpe.decode(g, pieces.merges) for g in got] == [t or "" for t in texts]
    raw = [bytes(rng.choices(range(256), k=rng.randint(1, 128))) for _ in range(300)] + [b"a", b"aa" * 60]
    assert bpe.Merges(PATH).merge_all(raw) == [bpe._pack(pieces.merges.merge(r)) for r in raw]


def test_latin_texts_are_split_alike():
    rng = random.Random(6)
    signs = [chr(c) for c in range(bpe.LATIN)]
    texts = ["".join(rng.choices(signs, k=200)) for _ in range(100)] + ["".join(rng.choices("ab '\t\n\x85\xa0\x1cst1²-", k=200)) for _ in range(300)]
    assert all(bpe.split(t) == bpe.LATIN_PIECES.findall(t) == bpe.PIECES.findall(t) for t in texts)
    assert bpe.split("é 中文") == bpe.PIECES.findall("é 中文")


def test_stream_keeps_a_bounded_window(pieces):
    stream, most = bpe.PieceStream(pieces.merges), 0
    out = []
    for _ in range(300):
        out += stream.feed(b"abcdething")
        most = max(most, len(stream.data))
    assert most < 3 * pieces.merges.lookahead
    assert out + stream.finish() == pieces.merges.merge(b"abcdething" * 300)


def test_decoder_waits_for_the_rest_of_a_character(pieces, library):
    rng = random.Random(2)
    for _ in range(200):
        ids = [rng.randrange(50300) for _ in range(rng.randint(0, 9))]
        one_by_one = bpe.TextDecoder(pieces.merges)
        got = "".join(one_by_one.feed([i]) for i in ids) + one_by_one.finish()
        assert got == library.decode(ids, skip_special_tokens=False)


def test_encoded_documents(edges, nothing, library):
    rows = bpe.encode_documents(edges, PATH).collect()
    assert len(rows) == len(EDGES) and bpe.encode_documents(nothing, PATH).count() == 0
    for r in rows:
        assert list(memoryview(bytes(r.token_ids)).cast("I")) == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "")


def test_bpe_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = dict(queries.table(spark, folder, "documents").select("doc_id", "text").collect())
    for r in queries.op3_bpe(spark, folder).collect():
        ids = np.array(library.encode(texts[r.doc_id], add_special_tokens=False).ids, "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_fingerprints_of_edits(sample):
    rows = {r.doc_id: r for r in fingerprints.fingerprint_edits(sample).collect()}
    texts = sorted(sample.select("doc_id", "text").collect(), key=lambda r: -r.doc_id)
    off, next_off, by_text = [], [], {}
    for k, (i, t) in enumerate(texts):
        after, n = texts[(k + 1) % len(texts)].text, len(t)
        edited = t[: n - n // 3] + after[: n // 3]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[i].n_chars == n
        off.append(rows[i].near_edited - likeness(t, edited))
        next_off.append(rows[i].near_next - likeness(t, after))
        assert by_text.setdefault(t, rows[i].fingerprint) == rows[i].fingerprint
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.13 and abs(np.mean(next_off)) < 0.03


def test_near_copies_are_told_apart(spark):
    """Texts of likeness 0.70 and 0.80 to the next one lie on their sides of 0.75, but for a few."""
    rows = []
    for k in range(120):
        size, same = (85, 70) if k % 2 else (90, 80)  # of two texts of that many words, so many equal: 70/100 and 80/100
        rows += [(2 * k + 1, " ".join(f"w{k}x{i}" for i in range(size))), (2 * k, " ".join(f"w{k}x{i}" for i in range(size - same, 2 * size - same)))]
    texts, got = dict(rows), {r.doc_id: r.near_next for r in fingerprints.fingerprint_edits(documents(spark, rows)).collect()}
    want = {2 * k + 1: likeness(texts[2 * k + 1], texts[2 * k]) for k in range(120)}
    assert {round(v, 2) for v in want.values()} == {0.7, 0.8}
    off = np.array([got[i] - v for i, v in want.items()])
    assert abs(off.mean()) < 0.015 and off.std() < 0.05
    assert np.mean([(got[i] >= 0.75) == (v >= 0.75) for i, v in want.items()]) > 0.85


def test_weighted_words_count_repetitions(spark):
    df = spark.createDataFrame([("b a B  c-a a\ta",), ("",), ("a" * 50 + " x" * 5000,)], "t string")
    got = [Counter({r.split(" ")[0]: len(r.split(" ")) for r in row[0]}) for row in df.select(fingerprints.weighted_words(F.col("t"))).collect()]
    assert got == [Counter({"a": 3, "b": 2, "c-a": 1}), Counter(), Counter({"a" * 50: 1, "x": 5000})]


def test_words_are_counted_by_hash_alone(spark):
    """No text is joined, matched and cut again to count its words."""
    texts = ["b a B  c-a a\ta", "", "a" * 50 + " x" * 5000, "one"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fingerprints.counted_words(F.col("t")).alias("c")).collect()
    for t, counted in rows:
        want = Counter(t.lower().split())
        hashes = dict(spark.createDataFrame([(w,) for w in want], "w string").select("w", F.xxhash64("w")).collect())
        assert {r.w: r.n for r in counted} == {hashes[w]: n for w, n in want.items()} and len(counted) == len(want)
    plan = fingerprints.fingerprint_edits(documents(spark, [(1, "a b a")]))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_fingerprints_at_the_edges(spark, edges, nothing):
    rows = fingerprints.fingerprint_edits(edges).collect()
    assert len(rows) == len(EDGES) and fingerprints.fingerprint_edits(nothing).count() == 0
    by_text = {}
    for r in rows:
        by_text.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert by_text[5, len(EDGES[5][1])] == by_text[6, len(EDGES[5][1])]
    assert by_text[1, 0] == by_text[2, 0] == by_text[3, 4] == {"0" * 8 * fingerprints.SAMPLES}
    alone = fingerprints.fingerprint_edits(documents(spark, [(3, "abc def ghi")])).first()
    assert alone.near_next == 1.0
    assert fingerprints.fingerprint_edits(documents(spark, [(None, "abc"), (None, "abd")])).count() == 2


def test_fingerprints_draw_once_for_texts_that_share_a_word(spark, monkeypatch):
    texts = documents(spark, [(i, f"all of it {'twice ' * (1 + i % 2)}{i // 4}") for i in range(60)] + [(90, None), (91, ""), (None, "all")])
    got = fingerprints.fingerprint_edits(texts)
    sums = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in x and "min(" in x]
    assert sums and not any("ln(" in x for x in sums)  # drawn before the values go to their texts
    monkeypatch.setattr(fingerprints, "SHARED", 3)
    assert sorted(map(str, got.collect())) == sorted(map(str, fingerprints.fingerprint_edits(texts).collect()))


def test_large_values_are_not_drawn(spark):
    """What is told to be large without logarithms is large, and it is most of the values."""
    draws = spark.range(4000).select(F.xxhash64("id").alias("w"), F.when(F.col("id") % 4 == 0, 3.0).otherwise(1.0).alias("n"))
    once, below, likely = F.when(F.col("n") == 1, 1.0).otherwise(0.0), 0.05, F.ln(0.05 / F.lit(1.0))
    values = draws.select(
        "n", fingerprints.sample(F.col("w"), F.ln("n"), F.lit(5)).alias("v"),
        fingerprints.sample(F.col("w"), F.ln("n"), F.lit(5), below * F.col("n"), once).alias("told"), likely.alias("most"),
    ).collect()
    assert all(r.told == r.v for r in values if r.v < r.most) and any(r.v < r.most and r.n > 1 for r in values)
    assert all(r.told in (None, r.v) for r in values) and np.mean([r.told is None for r in values if r.n == 1]) > 0.85


def test_a_text_without_a_likely_value_is_no_fingerprint(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "LIKELY", 0.01)
    with pytest.raises(Exception, match="raise LIKELY"):
        fingerprints.fingerprint_edits(documents(spark, [(1, "some words of a text"), (2, "and of another")])).collect()


def test_successors_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCKS", 7)
    ids = [3 * i for i in range(100)]
    rows = fingerprints.successors(documents(spark, [(i, str(i)) for i in ids])).where("not __guest").collect()
    assert {r.text: r.next_text for r in rows} == {str(i): str(i - 3 if i else 297) for i in ids}
    assert len({r["__block"] for r in rows}) == 7


def test_licences_of_the_corpus(sample):
    texts = dict(sample.select("doc_id", "text").collect())
    rows = licenses.document_licences(sample).collect()
    assert len(rows) == len(texts)
    marks = {"MIT": "MIT License", "Apache-2.0": "Apache License", "GPL-3.0": "GNU General", "CC-BY-NC-4.0": "BY-NC"}
    for r in rows:
        assert set(filter(None, r.families.split(","))) == {f for f, m in marks.items() if m in texts[r.doc_id]}


def test_licence_edges(spark, edges, nothing):
    assert licenses.scan(nothing).count() == 0 and licenses.scan(edges).count() == 0
    rows = [
        (1, "x y\nlicensed under the apache license,  version 2.0\nz"), (1, "x y\nlicensed under the apache license,  version 2.0\nz"),
        (None, "Released under the MIT License."), (2, "This copyright line has no known wording at all"), (3, prose("p", 200)),
        (4, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."),
    ]
    got = {(r.doc_id, r.paragraph, r.family, r.confirmed) for r in licenses.scan(documents(spark, rows)).collect()}
    assert got == {(1, 1, "Apache-2.0", True), (None, 0, "MIT", True), (2, 0, "unknown", False), (4, 0, "MIT", True), (4, 1, "CC-BY-NC-4.0", True)}
    whole = Counter(tuple(r) for r in licenses.document_licences(documents(spark, [*rows, (None, "no notice"), (None, None)])).collect())
    assert whole == Counter([(1, 1, "Apache-2.0", 1), (None, 1, "MIT", 0), (2, 1, "unknown", 0), (3, 0, "", None), (4, 2, "CC-BY-NC-4.0,MIT", 0),
                             (None, 0, "", None), (None, 0, "", None)])


def test_other_versions_are_not_confirmed(spark):
    rows = [
        (1, "This work is licensed under the GNU General Public License, version 3."),
        (2, "This work is licensed under the GNU General Public License, version 2."),
        (3, "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 International License."),
        (4, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ]
    got = {r.doc_id: (r.family, r.confirmed) for r in licenses.scan(documents(spark, rows)).collect()}
    assert got == {1: ("GPL-3.0", True), 2: ("unknown", False), 3: ("unknown", False), 4: ("CC-BY-SA-4.0", True)}


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = queries.table(spark, folder, "documents"), queries.table(spark, folder, "labels")
    model = quality.train(docs, labels.where("doc_id % 4 <> 0"))
    known = quality.judge(docs, labels, model=model).join(labels.where("doc_id % 4 = 0"), "doc_id")
    x = known.agg(F.avg((F.col("rejected") == (F.col("quality") == 0)).cast("int")).alias("right"), F.sum((F.col("rejected") & (F.col("quality") == 1)).cast("int")).alias("lost")).first()
    assert x.right > 0.95 and x.lost <= 1


def test_sparse_sites_shrink_to_their_parents(spark):
    rows = [(i, "good text here") for i in range(300)]
    docs = documents(spark, rows).withColumn("source", F.when(F.col("doc_id") < 3, "few").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 3)))
    model = quality.Classifier([np.array([])] * 12, np.zeros(13))
    got = quality.judge(docs, docs.select("doc_id", F.lit(1).alias("quality")), model=model).collect()
    assert all(abs(r.host_posterior - 0.5) < 1e-6 and abs(r.score - 0.5) < 1e-6 for r in got)


def test_quality_edges(spark, edges, nothing, labels):
    got = quality.judge(edges, labels.withColumn("text", F.lit("clash")).select("doc_id", "quality")).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert quality.judge(nothing, labels).count() == 0
    assert quality.judge(edges, labels.where("quality = 1")).where("rejected").count() == 0


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = {k: v.astype(float) for k, v in toxicity.new_network().items()}
    x, mask, y = rng.normal(size=(5, 3, 4 + toxicity.EMBEDDED)), np.ones((5, 3)), np.array([1, 0, 1.0])
    mask[3:, 1] = 0
    steps = lambda net, x: {s: [v @ net["W" + s] + net["B" + s] for v in x] for s in "fb"}

    def loss(net):
        z = toxicity.forward(net, steps(net, x), mask)
        return float((np.log1p(np.exp(z)) - y * z).sum())

    z, kept = toxicity.forward(net, steps(net, x), mask, True)
    got, _ = toxicity.backward(net, x, mask, kept, 1 / (1 + np.exp(-z)) - y)
    for name in ("A", "v", "o", "Wf", "Uf", "Bf", "Wb", "Ub", "Bb"):
        at, e = tuple(rng.integers(0, s) for s in net[name].shape), 1e-2
        up, down = ({k: v.copy() for k, v in net.items()} for _ in range(2))
        up[name][at] += e
        down[name][at] -= e
        assert abs((loss(up) - loss(down)) / (2 * e) - got[name][at]) < 1e-3


def test_windows_overlap_and_cover():
    start, size, text = toxicity.windows(np.array([0, 5, 24, 25, 100]))
    assert text.tolist() == [1, 2, 3, 3] + [4] * 8
    for k, (lo, n) in enumerate(zip([0, 0, 5, 29, 54], [0, 5, 24, 25, 100])):
        covered = {i for s, z in zip(start[text == k], size[text == k]) for i in range(s, s + z)}
        assert covered == set(range(lo, lo + n))


def test_toxic_words_are_found_anywhere():
    rng = random.Random(3)
    bad = ["grubok", "grubokan", "zlydne"]

    def text(toxic, seed):
        w = prose(seed, 150).split()
        for _ in range(2 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        return " ".join(w)

    model = toxicity.fit([text(i % 2, i) for i in range(200)], np.array([i % 2 for i in range(200)]))
    held = [text(i % 2, 1000 + i) for i in range(100)]
    got = model.scores([toxicity.split(t) for t in held]) >= 0.5
    assert np.mean(got == np.array([i % 2 == 1 for i in range(100)])) > 0.95


def test_toxicity_edges(edges, nothing, labels):
    model = toxicity.fit(["some nice words", "some vile words"] * 6, np.array([0, 1] * 6))
    got = toxicity.score(edges, labels, model).collect()
    assert len(got) == len(EDGES) and all(0 <= r.toxicity <= 1 for r in got)
    assert all(r.toxicity == 0 for r in got if not words(r.text))
    assert toxicity.score(nothing, labels, model).count() == 0
    assert {r.toxicity for r in toxicity.score(edges, labels.where("toxic = 0")).collect()} == {0.0}


def test_language_model_scores(spark):
    folder = "/root/testdata/sf0.001"
    texts = dict(queries.table(spark, folder, "documents").select("doc_id", "text").collect())
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    tokens = {i: words(t) + [None] for i, t in texts.items()}
    count = Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, z = sum(count.values()), sum(count.values()) + 0.1 * (len(count) + 1)
    rows = queries.op9_lm(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens[r.doc_id]), sum(count[w] > 0 for w in tokens[r.doc_id]), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.1) / z) for w in tokens[r.doc_id]), rel_tol=1e-9)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_language_model_is_a_distribution():
    """The probabilities of all words, and of an unknown one, after the same tokens add up to 1 at most."""
    rng = np.random.default_rng(1)
    hashes = rng.integers(1, 1 << 63, 300).astype(np.uint64)
    counts = np.concatenate([rng.integers(1, 5, 200), rng.integers(16, 400, 100)])
    cells = np.bincount(lm.class_of(counts) * 256 + lm.member_of(hashes), minlength=lm.CLASSES << 8)
    coder = lm.Coder(cells.reshape(lm.CLASSES, -1))
    tables = [rng.integers(-2000, 2000, n).astype(np.int16) for n in (lm.NODES, lm.SLOTS, lm.SLOTS)]
    model = lm.Model(coder, tables, rng.normal(0.4, 0.1, (lm.GATES, lm.CONTEXTS + 1)))
    words_, c = np.append(hashes, np.uint64(5)), np.append(counts, 0)
    both = np.column_stack([np.full(301, hashes[0]), words_]).ravel()
    of = lambda h, c, size: lm.Chunk([None] * (len(h) // size), np.zeros(len(h) // size, bool), np.full(len(h) // size, size), np.ones(len(h) // size), c, h)
    alone = model.bits(of(hashes[:1], counts[:1], 1))[0]
    after = model.bits(of(both, np.column_stack([np.full(301, counts[0]), c]).ravel(), 2)) - alone
    assert 0.2 < (2.0**-after).sum() <= 1 + 1e-9


def _chunk(n, seed, texts=(0,)):
    """A chunk of texts that begin at ``texts``, its coder and random sums of choices."""
    rng = np.random.default_rng(seed)
    of = np.minimum(rng.zipf(1.3, n), 500)
    hashes = np.random.default_rng(0).integers(1, 1 << 63, 501).astype(np.uint64)[of]
    counts = 1 + 5000 // of
    cells = np.zeros((lm.CLASSES, 256), np.int64)
    np.add.at(cells, (lm.class_of(1 + 5000 // np.arange(1, 501)), lm.member_of(np.random.default_rng(0).integers(1, 1 << 63, 501).astype(np.uint64)[1:])), 1)
    sizes = np.diff([*texts, n])
    return lm.Chunk([None] * len(sizes), np.zeros(len(sizes), bool), sizes, np.ones(len(sizes)), counts, hashes), lm.Coder(cells)


def test_language_model_refines_every_block():
    """Bits of short and long texts equal those of a plain walk with a step after every 32 tokens."""
    rng = np.random.default_rng(2)
    x, coder = _chunk(6000, 1, (0, 20, 700))
    tables = [lm._values(*rng.integers(0, 9, (2, n))) for n in (lm.NODES, lm.SLOTS, lm.SLOTS)]
    model = lm.Model(coder, tables, rng.normal(0.4, 0.1, (lm.GATES, lm.CONTEXTS + 1)))
    ctx, classes, members = lm.contexts(x.hashes, x.first), lm.class_of(x.counts), lm.member_of(x.hashes)
    for got, first, size in zip(model.bits(x), x.first, x.sizes):
        want, w = -coder.shares(classes, members)[first : first + size].sum(), model.weights.astype(np.float32)
        for lo in range(first, first + size, 32):
            t = np.arange(lo, min(lo + 32, first + size))
            slope, made = np.zeros(w.shape), np.zeros(lm.GATES)
            for kind, here, node, bit in lm.paths(coder, classes[t], members[t]):
                v, gate = model.predictions(kind, [c[t][here] for c in ctx], node)
                p = 1 / (1 + np.exp(-np.clip((v * w[gate]).sum(axis=1), -14, 14)))
                want -= np.log2(np.where(bit == 1, p, 1 - p)).sum()
                np.add.at(slope, gate, (bit - p)[:, None] * v)
                np.add.at(made, gate, 1)
            w = (w + lm.RATE * slope / np.sqrt(np.maximum(made, 1))[:, None]).astype(np.float32)
        assert math.isclose(got, want, rel_tol=1e-5)


def test_language_model_starts_from_all_tokens(monkeypatch):
    x, coder = _chunk(260_000, 3)
    y, _ = _chunk(260_000, 4)
    same = 210_000
    y.hashes[:same], y.counts[:same] = x.hashes[:same], x.counts[:same]
    sums = [np.random.default_rng(5).integers(1, 50, 2 * n).astype(np.int32) for n in (lm.NODES, lm.SLOTS, lm.SLOTS)]
    tables = [lm._values(s[::2], s[1::2]) for s in sums]
    monkeypatch.setattr(lm.Chunk, "of", classmethod(lambda cls, row, buckets: row["x"]))
    part = lambda c: iter([pd.DataFrame({"x": [c]})])
    one, two = (next(lm._start(part(c), coder, tables, sums, 16))["w"][0] for c in (x, y))
    assert one != two


def test_language_model_contexts_share_no_counts(monkeypatch):
    """Each choice of each token gets the counts of its own context, over all chunks, as in a plain walk."""
    (x, coder), (y, _) = _chunk(90_000, 6, (0, 400, 60_000)), _chunk(50_000, 7, (0, 20_000))
    x.held[1] = True
    monkeypatch.setattr(lm.Chunk, "of", classmethod(lambda cls, row, buckets: row["x"]))
    monkeypatch.setattr(lm, "MERGED", 1000)
    sent = pd.concat(lm._learned(iter([pd.DataFrame({"chunk": [0, 1], "x": [x, y]})]), coder, 16, 5))
    told = pd.concat([lm._told(part) for _, part in sent.groupby("range")])
    count, walks = Counter(), []
    for c in (x, y):
        classes, members, learned = lm.class_of(c.counts), lm.member_of(c.hashes), np.repeat(~c.held, c.sizes)
        for k, ctx in enumerate(lm.contexts(c.hashes, c.first)):
            for _, here, node, bit in lm.paths(coder, classes, members):
                walks.append((c, k, here, node, bit))
                count.update(zip(ctx[here][learned[here]].tolist(), node[learned[here]].tolist(), bit[learned[here]].tolist()))
    assert len(count) > 200_000
    for chunk, c in enumerate((x, y)):
        pieces, learned = told[told["chunk"] == chunk].to_dict("records"), np.repeat(~c.held, c.sizes)
        whole, alone = (lm.Seen.of(c, coder, pieces, 5, without_own=own) for own in (False, True))
        contexts = lm.contexts(c.hashes, c.first)
        for _, k, here, node, bit in (w for w in walks if w[0] is c):
            both = np.array([[count[h, n, b] for b in (0, 1)] for h, n in zip(contexts[k][here].tolist(), node.tolist())])
            at = whole.place(whole.at[k][here], node)
            assert (whole.values.ravel()[at] == lm._values(both[:, 0], both[:, 1])).all()
            own = learned[here]
            assert (alone.values.ravel()[at][own] == lm._values(both[own, 0] - (1 - bit[own]), both[own, 1] - bit[own])).all()


def test_language_model_knows_a_phrase_among_many_contexts(spark):
    """Known phrases are told from shuffled ones, also beside more contexts than fixed tables would hold."""
    rng = np.random.default_rng(8)
    name = lambda ids: " ".join(f"w{i}" for i in ids)
    phrases = rng.integers(0, 400, (40, 60))
    rows = [(i, name(p)) for i, p in enumerate(phrases)] + [(100 + i, name(rng.integers(0, 400, 4000))) for i in range(90)]
    rows += [(1000 + i, name(p)) for i, p in enumerate(phrases)] + [(2000 + i, name(rng.permutation(p))) for i, p in enumerate(phrases)]
    got = {r.doc_id: r.score for r in lm.score(documents(spark, rows), F.col("doc_id") >= 1000).collect()}
    assert all(got[1000 + i] > got[2000 + i] + 0.2 * 60 for i in range(len(phrases)))


def test_staged_rows_of_many_megabytes_are_read_one_by_one(spark):
    """Each row is a row group of its own, the least a Parquet reader holds, and the rows stay the same."""
    rows = spark.range(7).select("id", F.repeat(F.lit("x"), 1000).alias("fat")).coalesce(1)
    again = common.staged(rows, "fat", together=1)
    assert sorted(again.collect()) == sorted(rows.collect())
    sizes = [f for file in again.inputFiles() if (f := pq.ParquetFile(file.removeprefix("file://")).metadata.num_row_groups)]
    assert sum(sizes) == 7


def test_language_model_edges(spark, edges, nothing):
    got = lm.score(edges, F.col("doc_id") == 5).collect()
    assert len(got) == len(EDGES) and sum(r.held_out for r in got) == 1
    assert all(r.score < 0 and r.n_tokens == 1 for r in got if r.doc_id in (1, 2, 3))
    assert lm.score(nothing, F.lit(False)).count() == 0
    unlearned = lm.score(documents(spark, [(1, "a b")]), F.lit(True)).first()
    assert (unlearned.train_tokens, unlearned.n_known) == (0, 0) and math.isclose(unlearned.base_score, 0.0, abs_tol=1e-12)
