"""Alignment of two tokenizers against a plain version on the libraries themselves."""

import gc
import hashlib
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from corpus_data import EDGES, documents
from tokenizers import Tokenizer

from curvelens.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_tokens(text, libraries):
    """(id, start, end) of both sides, or nothing where the bytes differ."""
    if not text:
        return [], []
    a, b = libraries
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}
    sides = []
    for ids, of in (
        (a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(byte[c] for c in a.id_to_token(i))),
        (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()),
    ):
        at, side, joined = 0, [], b""
        for i in ids:
            raw = of(i)
            side.append((i, at, at + len(raw)))
            at += len(raw)
            joined += raw
        if joined != (" " + text).encode():
            return [], []
        sides.append(side)
    return sides


def plain(rows, libraries):
    docs, holders = [], Counter()
    for doc_id, text in rows:
        a, b = plain_tokens(text, libraries)
        ends = {e for *_, e in a} & {e for *_, e in b}
        sides = []
        for side in (a, b):
            sides.append([[]])
            for i, _, e in side:
                sides[-1][-1].append(str(i))
                if e in ends:
                    sides[-1].append([])
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in zip(*sides)][:-1]
        links, k = [], 0
        for i, s, e in a:
            while k < len(b) and b[k][2] <= s:
                k += 1
            m = k
            while m < len(b) and b[m][1] < e:
                links.append((i, b[m][0]))
                m += 1
        docs.append((doc_id, len(a), len(b), groups, links))
        holders.update(set(links))
    most = {}
    for (i, _), n in holders.items():
        most[i] = max(most.get(i, 0), n)
    return Counter(
        (d, na, nb, len(g), len(ln), sum(holders[p] == most[p[0]] for p in ln), sum(holders[p] for p in ln), ";".join(g)) for d, na, nb, g, ln in docs
    )


def as_counter(df):
    return Counter(map(tuple, df.collect()))


def test_jumps_end_in_components():
    rng = random.Random(1)
    for _ in range(200):
        size = rng.randint(1, 40)
        ends = [np.array(sorted({*(rng.randint(1, size) for _ in range(rng.randint(0, size))), size})) for _ in "ab"]
        (a, b), starts = ends, [np.append(0, e[:-1]) for e in ends]
        group_a, group_b = alignment.aligned(starts[0], a, starts[1], b)
        both = np.intersect1d(a, b)
        assert np.array_equal(group_a, np.searchsorted(both, a)) and np.array_equal(group_b, np.searchsorted(both, b))
    assert alignment.jump(np.append(np.arange(1, 1000), 999)).tolist() == [999] * 1000


def test_alignment_query(spark, sample, libraries):
    rows = queries.op13_alignment(spark, "/root/testdata/sf0.001").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    want = plain(sample.select("doc_id", "text").collect(), libraries)
    digests = lambda r: (*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "")
    assert as_counter(rows) == Counter(map(digests, want))


@pytest.mark.parametrize("portion", [4 << 20, 300])
def test_odd_texts(spark, libraries, monkeypatch, portion):
    from curvelens.llm import stretches

    monkeypatch.setattr(stretches, "AT_A_TIME", portion)
    rng = random.Random(portion)
    parts = ["a", "the", " ", " ", "  ", "\n", "'re", "é", "ß", "12", "!", "<|endoftext|>", "<s>", "<0x41>", "中文", "🙂", "\t", "\x1f", "\xa0", "\x00", "▁", "ﬁ", "é", "word", "\r\n"]
    rows = [(k, "".join(rng.choice(parts if k % 2 else parts[:12]) for _ in range(rng.randint(0, 20)))) for k in range(400)]
    got, want = as_counter(alignment.align(documents(spark, rows), A, B)), plain(rows, libraries)
    assert got == want
    assert sum(r[1] == 0 for r in want) > 20 and sum(r[1] > 0 for r in want) > 200


def test_alignment_edges(spark, edges, nothing, libraries):
    assert as_counter(alignment.align(edges, A, B)) == plain(EDGES, libraries)
    assert alignment.align(nothing, A, B).count() == 0
    big = [(2**60 + 1, "one two"), (2**60 + 2, "one two"), (None, "one two")]
    assert as_counter(alignment.align(documents(spark, big), A, B)) == plain(big, libraries)


def test_a_worker_holds_little_and_keeps_nothing(monkeypatch):
    monkeypatch.setattr(alignment.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 5))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=2000)) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    align = alignment._aligner(A, B)
    rows, held = [], 0
    for row in alignment._portioned(iter([batch]), A, B, alignment.digest):
        rows.append(row)
        held = max(held, len(align.memory.now))
    assert len(rows) == -(-sum(map(len, texts)) // (1 << 20)) and held > 1000
    assert sum(r.nbytes for r in rows) < sum(map(len, texts)) // 2  # packed: links alone are several numbers a word
    assert not align.memory.now and not align.memory.old and gc.isenabled()
