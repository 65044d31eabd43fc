"""Packing: plans, cut documents and whole results against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from corpus_data import EDGES, documents
from tokenizers import Tokenizer

from curvelens.llm import packing, queries, stretches

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def best_fit_one_by_one(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plans_hold_every_document(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    low, high = rng.choice([(1, capacity), (capacity // 3, capacity), (capacity // 4, capacity // 2), (1, 5)])
    lengths = Counter(rng.randint(low, high) for _ in range(rng.choice([1, 40, 3000])))
    first = packing.best_fit(lengths, capacity)
    assert sorted(capacity - packing.fill(k) for k, n in first.items() for _ in range(n)) == best_fit_one_by_one(lengths.elements(), capacity)
    kinds = packing.local_search(first, capacity)
    held = Counter()
    for kind, times in kinds.items():
        assert 0 < packing.fill(kind) <= capacity and times > 0
        for length, n in kind:
            held[length] += n * times
    assert held == lengths
    squared = lambda plan: sum(packing.fill(k) ** 2 * n for k, n in plan.items())
    assert sum(kinds.values()) <= sum(first.values()) and squared(kinds) >= squared(first)
    least = -(-sum(n * k for n, k in lengths.items()) // capacity)
    if sum(kinds.values()) > least:  # then nothing improves any more
        under = [k for k in kinds if packing.fill(k) < capacity]
        assert not any(packing.exchange(a, b, capacity) for a in under for b in under if a != b or kinds[a] > 1)


def test_exchanges_empty_a_sequence():
    """Best fit needs four sequences of 10 where three do; the search finds an exchange that empties one."""
    found = 0
    for seed in range(400):
        rng = random.Random(seed)
        lengths = Counter(rng.randint(2, 7) for _ in range(12))
        first = packing.best_fit(lengths, 10)
        last = packing.local_search(first, 10)
        found += sum(last.values()) < sum(first.values())
    assert found > 5


def test_exchange_is_the_best_of_all_choices():
    rng = random.Random(5)
    for _ in range(300):
        a, b = (tuple(sorted(Counter(rng.randint(1, 9) for _ in range(rng.randint(1, 4))).items(), reverse=True)) for _ in "ab")
        low, high = packing.fill(a), packing.fill(b)
        if max(low, high) > 30:
            continue
        ones, twos = [[(x,) for x in Counter(dict(k)).elements()] for k in (a, b)], []
        for k in (a, b):
            e = list(Counter(dict(k)).elements())
            twos.append([(x, y) for i, x in enumerate(e) for y in e[i + 1 :]])
        ways = [(x, ()) for x in ones[0]] + [(x, y) for x in ones[0] for y in ones[1]] + [(x, y) for x in twos[0] for y in ones[1]] + [(x, y) for x in ones[0] for y in twos[1]]
        gains = [sum(x) - sum(y) for x, y in ways]
        want = max((g for g in gains if g > 0 and high + g <= 30 and high + g > low), default=None)
        got = packing.exchange(a, b, 30)
        assert (got and got[0]) == want
        if got:
            assert sum(got[1]) - sum(got[2]) == want and not Counter(got[1]) - Counter(dict(a)) and not Counter(got[2]) - Counter(dict(b))


def test_ranks_give_the_ids_of_the_library(library):
    rng = random.Random(3)
    parts = ["a", "the", " ", " ", "  ", "\n", "'", "'re", "é", "ß", "12", "½", "!", "--", "<|endoftext|>", "<|endof", "中文", "🙂", "\t", "\r\n", "\x1c", "\x1f",
             "\x85", "\xa0", "\u2028", "\u3000", "\u180e", "\u200b", "\x00", "word\n", "x" * 70, "=" * 300, "e\u0301", "Ω", "١٢"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xD7FF), rng.randrange(0x10000, 0x10FFFF)])) for _ in range(40)) for _ in range(2000)]
    for specials in (True, False):
        tokenizer = stretches.ByteLevel(PATH, specials)
        library.encode_special_tokens = not specials
        assert tokenizer.cuts
        for text in texts:
            assert tokenizer.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids, text
    library.encode_special_tokens = False


def test_stretches_are_encoded_on_their_own(library):
    rng = random.Random(4)
    parts = ["a", "the", " ", " ", "  ", "\n", "'", "'re", "é", "12", "!", "--", "中文", "\t", "\x1f", "\xa0", "word\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    tokenizer, cut = stretches.ByteLevel(PATH, False), 0
    for text in texts:
        if (found := stretches.cut(text)) is not None:
            cut += len(found) > 1
            full = [stretches.spelled(s) for s in found]
            assert "".join(full) == " " + text
            assert sum(map(tokenizer.stretch, full), []) == library.encode(" " + text, add_special_tokens=False).ids
    assert cut > 100


def test_memory_is_bounded_and_right():
    memory, made = stretches.Memory(50), []

    def fresh(new):
        made.extend(new)
        return [s.upper() for s in new]

    rng = random.Random(1)
    for _ in range(200):
        wanted = {rng.choice(["w", "x" * 80]) + str(rng.randrange(60)) for _ in range(20)}
        known = memory.learn(wanted, fresh)
        assert all(known[s] == s.upper() for s in wanted)
        assert len(memory.now) + len(memory.old) <= 2 * (50 + 20)
    assert len(made) < 200 * 20


def check(rows, texts, library, capacity=1024):
    """Every document whole, every sequence gapless and within capacity; the number of sequences."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // capacity)))
        assert all(r.length == capacity for r in mine[1:])
        at = 0
        for r in mine:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_query(spark, sample, library):
    rows = queries.op11_packing(spark, "/root/testdata/sf0.001").collect()
    n = check(rows, [(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()], library)
    assert n - -(-sum(r.length for r in rows) // 1024) <= 1


def test_packing_edges(edges, nothing, library, monkeypatch):
    monkeypatch.setattr(packing, "LEAST", 2)
    packed = packing.pack(packing.pieces(edges, PATH)).cache()
    rows = packed.collect()
    once = {1, 2, 3, 5, 6, 8, 9, 10, 11, 12, 13}
    check(rows, [(i, t) for i, t in EDGES if i in once], library)
    for doc_id, n in ((4, 2), (7, 2), (None, 2)):  # repeated rows, null ids
        assert sum(r.piece == 0 for r in rows if r.doc_id == doc_id) == n
    texts = Counter(t or "" for _, t in EDGES)
    sequences = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert all(r.n_tokens * 4 == len(r.token_ids) <= 4096 for r in sequences.values())
    got = Counter()
    for r in rows:  # the pieces stand in their sequences where they should
        part = bytes(sequences[r.sequence_id].token_ids)[4 * r.offset : 4 * (r.offset + r.length)]
        assert part == bytes(r.ids) and zlib.crc32(part) == r.ids_crc32
        if r.piece == 0 and r.length < 1024:
            got[library.decode(np.frombuffer(part, "<u4")[:-1].tolist(), skip_special_tokens=False)] += 1
    assert all(got[t] >= n for t, n in texts.items() if 0 < len(t) < 500)
    assert packing.pack(packing.pieces(nothing, PATH)).count() == 0


def test_a_hot_length_is_numbered_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "LEAST", 3)
    rows = [(1, "same text")] * 200 + [(k, "x " * (k % 7)) for k in range(100)]
    packed = packing.pack(packing.pieces(documents(spark, rows), PATH, capacity=16), 16).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) == 300
    assert len({r.sequence_id for r in packed}) <= -(-sum(r.length for r in packed) // 16) + 1
