"""Byte-level BPE as a bounded-lookahead streaming transducer, and its decoding.

Any stretch of a BPE encoding is itself the encoding of its bytes, so the encodings of all prefixes of a
piece form a tree: a prefix extends the encoding of a shorter one by its last token, and that token is at
most ``lookahead`` bytes long, the longest token that the merge list can build. Later prefixes can only
hang on prefixes that end within the last ``lookahead`` bytes. The tokens on their common path are
therefore final and are emitted; nothing but that window and the path to it is kept.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from curvelens.llm.common import ship

#: The published pattern of this tokenizer family (fixed value).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CLASSES = [regex.compile(p) for p in (r"\s+", r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+")]

#: Texts of these characters are split by a pattern of the standard library that lists the letters, numbers and spaces.
LATIN = 0x250


def _latin_pattern() -> re.Pattern:
    def members(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(LATIN) if regex.match(kind, chr(c)))

    space, letter, number = map(members, (r"\s", r"\p{L}", r"\p{N}"))
    # Only the contractions and the run of other signs can begin alike, so letters and numbers may stand first.
    return re.compile(
        f" ?[{letter}]+| ?[{number}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


LATIN_PIECES, BEYOND_LATIN = _latin_pattern(), re.compile(f"[^\0-{chr(LATIN - 1)}]")

#: Characters read at a time, and the length from which a piece is streamed before its end is known.
#: A piece that another one follows may still change while the two have fewer than HOLD characters.
BLOCK, LONG, HOLD = 1 << 16, 4096, 16
CACHED = 300_000
NEVER = 1 << 60
OUT_BYTES = 8 << 20
#: Characters of texts whose new pieces are merged together, pieces in one table, and ids from which arrays pay.
TOGETHER, ROWS, MANY = 1 << 19, 4096, 64
NO_RANK = np.int32((1 << 31) - 1)


def split(text: str) -> list[str]:
    """The pieces of a text, by PIECES."""
    return PIECES.findall(text) if BEYOND_LATIN.search(text) else LATIN_PIECES.findall(text)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself, or the next code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merge list of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: raw(t) for t, i in vocab.items()}
        self.of_byte = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {(vocab[left], vocab[right]): rank for rank, (left, right) in enumerate(merges)}
        self.built = [vocab[left + right] for left, right in merges]
        built = {*self.built, *self.of_byte}
        #: Bytes after which no token can reach back any more.
        self.lookahead = max(len(self.bytes_of[i]) for i in built)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.ending: dict = {}  # built tokens by their bytes from the end, as nested dicts
        for i in built:
            node = self.ending
            for b in reversed(self.bytes_of[i]):
                node = node.setdefault(b, {})
            node[-1] = i
        self._stays: dict[tuple[int, int], bool] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals."""
        ids, rank = [self.of_byte[b] for b in piece], self.ranks.get
        found = [rank(p, NEVER) for p in zip(ids, ids[1:])]
        while found and (best := min(found)) != NEVER:
            at = found.index(best)
            ids[at : at + 2] = [self.built[best]]
            del found[at]
            if at < len(found):
                found[at] = rank((ids[at], ids[at + 1]), NEVER)
            if at:
                found[at - 1] = rank((ids[at - 1], ids[at]), NEVER)
        return ids

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of ids as sorted numbers, the rank of each, and the ranks of pairs of bytes (256: no byte)."""
        pairs = np.array([left << 32 | right for left, right in self.ranks], np.int64)
        order = np.argsort(pairs)
        ranks = np.fromiter(self.ranks.values(), np.int32, len(pairs))
        of_bytes = np.full((257, 257), NO_RANK)
        byte_of = {i: b for b, i in enumerate(self.of_byte)}
        for (left, right), rank in self.ranks.items():
            if left in byte_of and right in byte_of:
                of_bytes[byte_of[left], byte_of[right]] = rank
        return pairs[order], ranks[order], of_bytes

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs, ranks, _ = self._pairs
        want = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(pairs, want), len(pairs) - 1)
        return np.where(pairs[at] == want, ranks[at], NO_RANK)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """``merge`` of many pieces at once, packed: a table with a piece in each row takes one merge of every row at a time."""
        if not self.ranks:
            return [_pack(self.merge(p)) for p in pieces]
        out, order = [b""] * len(pieces), sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        for k in range(0, len(order), ROWS):
            some = order[k : k + ROWS]
            for i, ids in zip(some, self._merge_table([pieces[i] for i in some])):
                out[i] = ids
        return out

    def _merge_table(self, pieces: list[bytes]) -> list[bytes]:
        built, of_bytes = np.array(self.built, np.int32), self._pairs[2]
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        wide = int(n.max()) + 1  # a column without bytes at the end
        column = np.arange(wide)
        raw = np.full((len(pieces), wide), 256, np.int16)
        raw[column < n[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.append(np.array(self.of_byte, np.int32), np.int32(-1))[raw]
        rank = of_bytes[raw[:, :-1], raw[:, 1:]]
        final, size, row = np.full(ids.shape, -1, np.int32), n.copy(), np.arange(len(pieces))
        while len(row):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(row)), at]
            if (done := best == NO_RANK).any():
                final[row[done]], size[row[done]] = ids[done], n[done]
                ids, rank, n, row, at, best = (x[~done] for x in (ids, rank, n, row, at, best))
                if not len(row):
                    break
            every = np.arange(len(row))
            # The right token of the pair goes, and with it one of the ranks; the last columns hold none.
            ids[:, :-1] = np.where(column[:-1] > at[:, None], ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(column[:-2] >= at[:, None], rank[:, 1:], rank[:, :-1])
            made = ids[every, at] = built[best]
            rank[every, at] = self._ranks_of(made, ids[every, at + 1])
            inner = np.flatnonzero(at)
            rank[inner, at[inner] - 1] = self._ranks_of(ids[inner, at[inner] - 1], made[inner])
            n = n - 1
        flat, cuts = final[column < size[:, None]].tobytes(), [0, *(4 * np.cumsum(size)).tolist()]
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    @cached_property
    def _spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and the begin and length of each id's."""
        each = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of, default=-1) + 1)]
        length = np.fromiter(map(len, each), np.int64, len(each))
        return np.frombuffer(b"".join(each), np.uint8), np.cumsum(length) - length, length

    def spell(self, ids) -> bytes:
        """The bytes of the ids; unknown ids have none."""
        if len(ids) < MANY:
            return b"".join([self.bytes_of.get(i, b"") for i in ids])
        spelled, begin, length = self._spelled
        ids = np.asarray(ids)
        ids = ids[ids < len(length)]
        n = length[ids]
        at = np.repeat(begin[ids] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return spelled[at].tobytes()

    def stays(self, left: int, right: int) -> bool:
        """Whether the two tokens stand side by side in an encoding."""
        if (known := self._stays.get((left, right))) is None:
            if len(self._stays) > CACHED:
                self._stays.clear()
            known = self._stays[left, right] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known


class PieceStream:
    """Encodes one piece from its bytes as they come."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.data = bytearray()  # bytes since the last final boundary
        self.last = [-1]  # last[i]: the token that ends the encoding of the first i of them; at 0 the final one

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for b in data:
            self.data.append(b)
            self.last.append(self._ending())
            if len(self.data) % self.merges.lookahead == 0:
                out += self._final()
        return out

    def finish(self) -> list[int]:
        return self._emit(len(self.data))

    def _ending(self) -> int:
        node, at = self.merges.ending, len(self.data)
        while at and (node := node.get(self.data[at - 1])) is not None:
            at -= 1
            if (token := node.get(-1)) is not None and (self.last[at] < 0 or self.merges.stays(self.last[at], token)):
                return token
        raise AssertionError("every prefix has an encoding")

    def _before(self, at: int) -> int:
        return at - len(self.merges.bytes_of[self.last[at]])

    def _final(self) -> list[int]:
        open_ = set(range(max(0, len(self.data) - self.merges.lookahead + 1), len(self.data) + 1))
        while len(open_) > 1:
            at = max(open_)
            open_.remove(at)
            open_.add(self._before(at))
        return self._emit(open_.pop())

    def _emit(self, until: int) -> list[int]:
        out, at = [], until
        while at:
            out.append(self.last[at])
            at = self._before(at)
        if until:
            del self.data[:until]
            del self.last[:until]
        return out[::-1]


class TextEncoder:
    """Encodes a text from blocks of it; returns ids as little-endian unsigned 32-bit integers."""

    def __init__(self, pieces: PieceCache):
        self.pieces, self.merges = pieces, pieces.merges
        self.held = ""
        self.open: PieceStream | None = None  # a long piece whose end has not come
        self.of: regex.Pattern | None = None

    def feed(self, block: str, last: bool = False) -> Iterator[bytes]:
        text, self.held = self.held + block, ""
        while found := [(k, name) for name in self.merges.special if (k := text.find(name)) >= 0]:
            at, name = min(found)
            yield from self._plain(text[:at], True)
            yield _pack([self.merges.special[name]])
            text = text[at + len(name):]
        begun = 0 if last else self._begun(text)
        yield from self._plain(text[: len(text) - begun], last)
        self.held += text[len(text) - begun:]

    def _begun(self, text: str) -> int:
        """Characters at the end that may be the first ones of a special token."""
        return max([0, *(k for name in self.merges.special for k in range(1, len(name)) if text.endswith(name[:k]))])

    def _plain(self, text: str, ended: bool) -> Iterator[bytes]:
        if self.open:
            run = m.end() if (m := self.of.match(text)) else 0
            if run == len(text) and not ended:
                yield _pack(self.open.feed(text[:-1].encode()))
                self.held = text[-1:]
                return
            if self.of is CLASSES[0] and run < len(text):
                run = max(run - 1, 0)  # the last space belongs to what follows
            yield _pack(self.open.feed(text[:run].encode()) + self.open.finish())
            self.open, text = None, text[run:]
        pieces = split(text)
        if not ended and pieces:
            held = pieces.pop()
            if len(held) > LONG:
                yield b"".join(map(self.pieces.__getitem__, pieces))
                self.of = next(c for c in CLASSES if c.match(held[-1]))
                self.open = PieceStream(self.merges)
                yield _pack(self.open.feed(held[:-1].encode()))
                self.held = held[-1]
                return
            while pieces and len(held) < HOLD:
                held = pieces.pop() + held
            self.held = held
        yield b"".join(map(self.pieces.__getitem__, pieces))


class PieceCache(dict):
    """Packed ids by piece, of two generations so that the memory stays bounded."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges, self.old = merges, {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is None:
            raw = piece.encode()
            if len(raw) <= self.merges.lookahead:  # nothing is final before its end
                ids = _pack(self.merges.merge(raw))
            else:
                stream = PieceStream(self.merges)
                ids = _pack(stream.feed(raw) + stream.finish())
        self._keep(piece, ids)
        return ids

    def _keep(self, piece: str, ids: bytes) -> None:
        if len(piece) <= 64:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[piece] = ids

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Packed ids of pieces that ``get`` does not know; those to be merged are merged together."""
        ids = {p: i for p in pieces if (i := self.old.get(p)) is not None}
        new = {p: r for p in pieces if p not in ids and len(r := p.encode()) <= self.merges.lookahead}
        ids |= zip(new, self.merges.merge_all(list(new.values())))
        for p, i in ids.items():
            self._keep(p, i)
        return ids | {p: self[p] for p in pieces if p not in ids}


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class TextDecoder:
    """Turns ids into text as they come: a state of at most three bytes waits for the rest of its character.

    Malformed bytes become U+FFFD, one for each maximal part of a character; unknown ids are skipped.
    """

    def __init__(self, merges: Merges):
        self.merges, self.wait = merges, b""

    def feed(self, ids) -> str:
        data = self.wait + self.merges.spell(ids)
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            b = data[-back]
            if b >= 0xC0:
                if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4):
                    cut -= back
                break
            if b < 0x80:
                break
        self.wait = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.wait = self.wait.decode("utf-8", "replace"), b""
        return out


@cache
def _pieces(path: str) -> PieceCache:
    return PieceCache(Merges(path))


def encode(text: str | None, pieces: PieceCache) -> bytes:
    text, coder = text or "", TextEncoder(pieces)
    out = [b for at in range(0, len(text), BLOCK) for b in coder.feed(text[at : at + BLOCK], at + BLOCK >= len(text))]
    return b"".join(out)


def encode_all(texts: list[str | None], pieces: PieceCache) -> list[bytes]:
    """``encode`` of each text; what is new in the texts of one block is merged together."""
    found, new, out = [], set(), []
    for text in texts:
        if len(text or "") > BLOCK or any(name in (text or "") for name in pieces.merges.special):
            found.append(None)
            continue
        parts = split(text or "")
        ids = list(map(pieces.get, parts))
        open_ = [k for k, i in enumerate(ids) if i is None] if None in ids else []
        names = [parts[k] for k in open_]
        new.update(names)
        found.append((ids, open_, names))
    learned = pieces.learn(new)
    for text, part in zip(texts, found):
        if part is None:
            out.append(encode(text, pieces))
            continue
        ids, open_, names = part
        for k, name in zip(open_, names):
            ids[k] = learned[name]
        out.append(b"".join(ids))
    return out


def decode(ids: bytes, merges: Merges) -> str:
    coder, view = TextDecoder(merges), np.frombuffer(ids, "<u4")
    return "".join([coder.feed(view[at : at + BLOCK]) for at in range(0, len(view), BLOCK)]) + coder.finish()


def _together(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts, some at a time: TOGETHER characters, or one text."""
    some, held = [], 0
    for text in texts:
        some.append(text.as_py())
        held += len(some[-1] or "")
        if held >= TOGETHER:
            yield some
            some, held = [], 0
    yield some


def _with_ids(batches: Iterator[pa.RecordBatch], path: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    pieces = _pieces(path)
    for batch in batches:
        at, ids, back, held = 0, [], [], 0
        for texts in _together(batch.column("text")):
            for coded in encode_all(texts, pieces):
                ids.append(coded)
                back.append(decode(coded, pieces.merges))
                held += 2 * len(coded)
                i = at + len(ids) - 1
                if held > OUT_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(at, i + 1 - at)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in columns), pa.array(ids, pa.binary()), pa.array(back, pa.string())],
                        names=[*columns, "token_ids", "decoded"],
                    )
                    at, ids, back, held = i + 1, [], [], 0


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """All columns, plus token_ids (binary, little-endian unsigned 32-bit) and decoded (the text read back).

    ``path`` is a tokenizer file that every executor has. A null text encodes like an empty one, to no
    ids. Rows are independent: repeated rows and null ids pass through. Columns of the caller named
    token_ids or decoded are replaced.
    """
    columns = [c for c in docs.columns if c not in ("token_ids", "decoded")]
    docs = docs.select(columns)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "token_ids binary", "decoded string"])

    ship(docs.sparkSession)

    def run(batches):
        return _with_ids(batches, path, columns)

    return docs.mapInArrow(run, schema)
