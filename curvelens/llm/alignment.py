"""Alignment of two tokenizers by pointer jumping.

Tokens of both sides are byte ranges of one text. Every token points to its farthest-right overlapping token of the
other side if that one ends later, or ends alike and is of side B; else it points to itself. Doubling all
pointers at once until they stand still leads every token to the terminal token of its component, which
names its group.

Words repeat, so this runs on the distinct stretches of a portion of texts (``stretches.cut``), one array of
tokens for all of them; a document is the row of its stretches. How many documents hold a linked pair of ids
is summed per portion, then over the corpus by pair, and returned to the portions, each of which
lists a pair once, however often it occurs in it.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelens.llm.common import ship, staged
from curvelens.llm.planes import pack, planes, steps, unpack, unplanes, unsteps
from curvelens.llm.stretches import ByteLevel, Memory, cut, portions, spelled

PIECE_SPACE = "▁"
#: Characters of a portion, which a worker holds as arrays of links, and stretches that a task remembers in each of two generations.
AT_A_TIME, REMEMBERED = 1 << 20, 60_000
#: Bytes that the piece model gets at a time, and what it gets first.
PORTION, LEAD = 1 << 14, "a"
CHUNK = "chunk long, docs binary, pairs binary, holders binary, bounds binary, at binary, times binary"
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


# --- pointer jumping


def jump(points: np.ndarray) -> np.ndarray:
    """Where every pointer ends: successors doubled until nothing moves."""
    while True:
        further = points[points]
        if np.array_equal(further, points):
            return points
        points = further


def aligned(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each token of two gapless rows of byte ranges that end together, numbered from the left."""
    n = len(a_end)
    last_b = np.searchsorted(b_start, a_end, "left") - 1
    last_a = np.searchsorted(a_start, b_end, "left") - 1
    terminal = a_end[last_a] <= b_end
    own = np.arange(len(b_end)) + n
    label = jump(np.concatenate([last_b + n, np.where(terminal, own, last_a)])) - n
    group = np.cumsum(terminal) - 1
    return group[label[:n]], group[label[n:]]


#: What a stretch adds to a document: its groups, the numbers of its tokens A, B and groups, and its links as pairs of
#: ids in one number.
Stretch = tuple[str, int, int, int, np.ndarray]
NOTHING: Stretch = ("", 0, 0, 0, np.empty(0, np.int64))


class Aligner:
    def __init__(self, byte_level: str, piece_model: str):
        import sentencepiece

        self.a = ByteLevel(byte_level, specials=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        self.a_bytes = self.a.bytes_of
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(PIECE_SPACE, " ").encode() for i, p in enumerate(names)]
        self.lead = self.b.encode(LEAD)
        inner = any(PIECE_SPACE in p.lstrip(PIECE_SPACE) or "\n" in p for p in names)
        self.cuts = self.a.cuts and not inner
        self.ids = max(len(self.a_bytes), len(names))
        self.said = np.array([f"{i}{end}" for end in (",", "|", ";", "") for i in range(self.ids)], object)
        self.said_size = np.array(list(map(len, self.said)))
        self.b_flat = np.frombuffer(b"".join(self.b_bytes), np.uint8)
        self.a_size, self.b_size = (np.array([len(x) for x in side]) for side in (self.a_bytes, self.b_bytes))
        self.memory = Memory(REMEMBERED)

    def fresh(self, stretches: list[str]) -> list[Stretch | None]:
        """Alignments of stretches as ``cut`` gives them; None where a side does not give their bytes.

        Laid end to end, stretches are a text whose encoding is theirs end to end.
        """
        if not stretches:
            return []
        full = list(map(spelled, stretches))
        text = "".join(full)
        raw = np.frombuffer("\0".join([*full, ""]).encode(), np.uint8)  # no stretch has a zero
        ends = np.flatnonzero(raw == 0) - np.arange(len(full))
        raw = raw[raw != 0]
        a = self.a.ids(text).astype(np.int64)
        cuts = np.flatnonzero(np.diff(ends // PORTION, prepend=0)).tolist()
        parts = [LEAD + "".join(full[i:j]) for i, j in zip([0, *cuts], [*cuts, len(full)]) if i < j]
        found = self.b.encode(parts, num_threads=1)
        b = np.array(list(chain.from_iterable(x[len(self.lead):] for x in found)), np.int64)
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        # side A is byte-level: it always gives the bytes of its text
        if all(x[: len(self.lead)] == self.lead for x in found) and a_end[-1] == len(raw) and np.array_equal(self._b_text(b), raw):
            if all((e[np.searchsorted(e, ends)] == ends).all() for e in (a_end, b_end)):
                return self._split(a, b, a_end, b_end, ends)
        # the model adds a space: not part of a stretch that begins with a line feed
        b = [self.b.encode(LEAD + s)[len(self.lead):] if s[0] == "\n" else self.b.encode(s[1:]) for s in full]
        return self._matched([s.encode() for s in full], [self.a.stretch(s) for s in full], b)

    def whole(self, texts: list[str]) -> list[Stretch | None]:
        """Alignments of whole texts."""
        full = [" " + t for t in texts]
        b = self.b.encode(texts, num_threads=1) if texts else []
        return self._matched([s.encode() for s in full], [self.a.ids(s).tolist() for s in full], b)

    def _b_text(self, ids: np.ndarray) -> np.ndarray:
        size = self.b_size[ids]
        return self.b_flat[np.repeat((np.cumsum(self.b_size) - self.b_size)[ids], size) + _spread(size)]

    def _matched(self, texts: list[bytes], a_ids: list[list[int]], b_ids: list[list[int]]) -> list[Stretch | None]:
        """Alignments of texts that are encoded each for itself; None where a side does not give the bytes."""
        good = [
            b"".join([self.a_bytes[i] for i in x]) == raw == b"".join([self.b_bytes[i] for i in y])
            for raw, x, y in zip(texts, a_ids, b_ids)
        ]
        kept = [k for k, ok in enumerate(good) if ok]
        if not kept:
            return [None] * len(texts)
        a, b = (np.array(list(chain.from_iterable(side[k] for k in kept)), np.int64) for side in (a_ids, b_ids))
        ends = np.cumsum([len(texts[k]) for k in kept])
        made = iter(self._split(a, b, np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), ends))
        return [next(made) if ok else None for ok in good]

    def _split(self, a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray, ends: np.ndarray) -> list[Stretch]:
        """Alignments of two rows of tokens, for each stretch that ends at one of ``ends``."""
        a_start, b_start = a_end - self.a_size[a], b_end - self.b_size[b]
        a_group, b_group = aligned(a_start, a_end, b_start, b_end)

        first = np.searchsorted(b_end, a_start, "right")
        each = np.searchsorted(b_start, a_end, "left") - first
        links = (np.repeat(a, each) << 32) | b[_spread(each) + np.repeat(first, each)]

        ids, side = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        group = np.concatenate([a_group, b_group])
        order = np.argsort(2 * group + side, kind="stable")
        ids, side, group = ids[order], side[order], group[order]
        to_a, to_b = np.searchsorted(a_end, ends, "right"), np.searchsorted(b_end, ends, "right")
        stop = to_a + to_b
        turn, over = np.append(side[1:] != side[:-1], False), np.append(group[1:] != group[:-1], False)
        end = np.where(over, 2, turn)
        end[stop - 1] = 3
        word = end * self.ids + ids
        chars = np.append(0, np.cumsum(self.said_size[word]))[np.append(0, stop)].tolist()
        said = "".join(self.said[word].tolist())
        n_groups = np.diff(group[stop - 1] + 1, prepend=0)
        to_link = np.append(0, np.append(0, np.cumsum(each))[to_a]).tolist()
        n_a, n_b = np.diff(to_a, prepend=0).tolist(), np.diff(to_b, prepend=0).tolist()
        return [
            (said[i:j], x, y, z, links[k:m])
            for i, j, x, y, z, k, m in zip(chars, chars[1:], n_a, n_b, n_groups.tolist(), to_link, to_link[1:])
        ]

    def documents(self, texts: list[str]) -> tuple[list[np.ndarray], list[Stretch]]:
        """The stretches of the texts, and each text as places in that list; a text without tokens has none."""
        parts = [cut(t) if t and self.cuts else None for t in texts]
        distinct = list(dict.fromkeys(chain.from_iterable(filter(None, parts))))
        known = self.memory.learn(distinct, self.fresh)
        held = [known[p] for p in distinct]
        bad = {p for p, found in zip(distinct, held) if found is None}
        place = dict(zip(distinct, range(len(distinct))))
        out = [np.fromiter(map(place.__getitem__, part or ()), np.int64, len(part or ())) for part in parts]
        odd = [k for k, part in enumerate(parts) if texts[k] and (part is None or bad and not bad.isdisjoint(part))]
        for k, found in zip(odd, self.whole([texts[k] for k in odd])):
            out[k] = np.array([len(held)] if found else [], np.int64)
            held.append(found)
        return out, [x or NOTHING for x in held]


@cache
def _aligner(byte_level: str, piece_model: str) -> Aligner:
    return Aligner(byte_level, piece_model)


# --- portions of documents


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. of each of some rows of values laid end to end."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def linked_pairs(docs: list[np.ndarray], held: list[Stretch]) -> tuple[np.ndarray, ...]:
    """Distinct pairs, how many documents hold each, and by document: bounds, places of its pairs, times."""
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    flat = np.concatenate([*docs, np.empty(0, np.int64)])
    code, often = np.unique(owner * max(len(held), 1) + flat, return_counts=True)  # each stretch of a document once
    owner, flat = np.divmod(code, max(len(held), 1))
    sizes = np.array([len(s[4]) for s in held], np.int64)
    pairs, where = np.unique(np.concatenate([s[4] for s in held]) if held else np.empty(0, np.int64), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    each = sizes[flat]
    pair = where[np.repeat(begin[flat], each) + _spread(each)]
    code = np.repeat(owner, each) * max(len(pairs), 1) + pair
    order = np.argsort(code, kind="stable")
    code = code[order]
    new = np.append(True, code[1:] != code[:-1]) if len(code) else np.empty(0, bool)
    times = np.add.reduceat(np.repeat(often, each)[order], np.flatnonzero(new)) if len(code) else np.empty(0, np.int64)
    owner, at = np.divmod(code[new], max(len(pairs), 1))
    bounds = np.searchsorted(owner, np.arange(len(docs) + 1))
    return pairs, np.bincount(at, minlength=len(pairs)), bounds, at, times


def digest(groups: str) -> str:
    return hashlib.sha256(groups.encode()).hexdigest() if groups else ""


def _portioned(batches: Iterator[pa.RecordBatch], byte_level: str, piece_model: str, say) -> Iterator[pa.RecordBatch]:
    align, n = _aligner(byte_level, piece_model), TaskContext.get().partitionId() << 32
    gc.disable()  # what is remembered has no cycles, and is large to look through
    try:
        for batch, texts in portions(batches, AT_A_TIME):
            yield _portion(align, n, batch, texts, say)
            n += 1
    finally:  # a worker lives on and serves later stages
        align.memory.clear()
        gc.enable()
        gc.collect()


def _portion(align: Aligner, n: int, batch: pa.RecordBatch, texts: list[str], say) -> pa.RecordBatch:
    docs, held = align.documents(texts)
    counts = np.array([(x, y, z, len(links)) for _, x, y, z, links in held], np.int64).reshape(-1, 4)
    sums = np.array([counts[d].sum(axis=0) for d in docs], np.int64).reshape(-1, 4)
    said = [s[0] for s in held]
    groups = [";".join(map(said.__getitem__, d.tolist())) for d in docs]
    named = pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), *(pa.array(sums[:, k]) for k in range(4)),
         pa.array(list(map(say, groups)), pa.string())],
        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"],
    )
    pairs, holders, bounds, at, times = linked_pairs(docs, held)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, named.schema) as out:
        out.write_batch(named)
    row = (pack(sink.getvalue().to_pybytes()), steps(pairs), planes(holders.astype(np.int32)), steps(bounds), steps(at.astype(np.int32)), planes(times.astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [pa.array([n], pa.int64()), *(pa.array([x], pa.binary()) for x in row)],
        names=["chunk", "docs", "pairs", "holders", "bounds", "at", "times"],
    )


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        for chunk, pairs, holders in zip(part["chunk"], part["pairs"], part["holders"]):
            pairs = unsteps(pairs, np.int64)
            yield pd.DataFrame({"chunk": chunk, "i": np.arange(len(pairs)), "a": pairs >> 32, "b": pairs & 0xFFFFFFFF, "n": unplanes(holders, np.int32)})


def _judged(portion: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    row = portion.iloc[0]
    with pa.ipc.open_stream(pa.py_buffer(unpack(row["docs"], np.uint8))) as stream:
        out = stream.read_all()
    bounds, at, times = unsteps(row["bounds"], np.int64), unsteps(row["at"], np.int32), unplanes(row["times"], np.int32).astype(np.int64)
    holders, best = np.zeros((2, len(counts)), np.int64)
    holders[counts["i"]], best[counts["i"]] = counts["holders"], counts["best"]
    sums = [np.append(0, np.cumsum(times * v[at]))[bounds] for v in (best, holders)]
    ids = out["doc_id"].to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)  # exact beside nulls
    frame = out.drop_columns(["doc_id"]).to_pandas()
    frame.insert(0, "doc_id", ids)
    frame["n_best"], frame["count_sum"] = (np.diff(s) for s in sums)
    return frame[[c.split(" ")[0] for c in OUT.split(", ")]]


def align(docs: DataFrame, byte_level: str, piece_model: str, digests: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every document.

    ``groups`` reads ``a1,a2|b1;a3|b2,b3``: the ids of both sides in order. With ``digests`` it is the SHA-256 of
    that, which is much shorter than the text; '' stays ''.

    * Texts that are null or empty, or whose joined bytes differ from space and text on either side, have no
      tokens: zeros and ''.
    * Repeated rows and null ids keep a row each, and count each as a document that holds its pairs.
    * Extra columns are ignored; an empty table gives an empty result.
    """
    ship(docs.sparkSession)

    say = digest if digests else str

    def run(batches):
        return _portioned(batches, byte_level, piece_model, say)

    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = staged(table.mapInArrow(run, CHUNK), "aligned")
    listed = chunks.select("chunk", "pairs", "holders").mapInPandas(_listed, "chunk long, i int, a int, b int, n int")
    sums = staged(listed.groupBy("a", "b").agg(F.sum("n").alias("holders")), "pair-counts")
    most = sums.groupBy("a").agg(F.max("holders").alias("most"))  # at most the ids of side A
    judged = sums.join(F.broadcast(most), "a").select("a", "b", "holders", (F.col("holders") == F.col("most")).cast("int").alias("best"))
    # Merged at every size, so that adaptive execution can split a pair that every portion lists.
    known = listed.select("chunk", "i", "a", "b").join(judged.hint("merge"), ["a", "b"]).select("chunk", "i", "holders", "best")
    portion = chunks.select("chunk", "docs", "bounds", "at", "times")
    return portion.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(_judged, OUT)
