"""Stretches of a text that a tokenizer encodes on their own, and a bounded memory of their encodings.

Cut before every single space or line feed that stands between two other characters, byte-level BPE with
the published split pattern (``bpe.PIECES``) and sentence pieces without inner spaces or line feeds give the
concatenated encodings of the stretches: no token of theirs reaches over such a place, and no choice on
one side depends on the other. Words repeat, so most stretches need encoding once only. Texts with other
white space are encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from curvelens.llm.bpe import PIECES, byte_alphabet

#: Characters of the longest stretch that is remembered, and of text handled at a time.
LONGEST, AT_A_TIME = 64, 4 << 20


def cut(text: str) -> list[str] | None:
    """The stretches of a text, those but the first without the space they begin with; None if it has to stay whole."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\0" in text or text[:1].isspace() or text[-1:].isspace():
        return None
    if len("".join(text.split())) + text.count(" ") + text.count("\n") != len(text):  # other white space
        return None
    return text.replace("\n", " \n").split(" ")


def spelled(stretch: str) -> str:
    """A stretch with its space."""
    return stretch if stretch[:1] == "\n" else " " + stretch


class Memory:
    """Values by stretch, of two generations so that it stays bounded."""

    def __init__(self, remembered: int):
        self.remembered = remembered
        self.clear()

    def clear(self) -> None:
        self.now, self.old, self.long = {}, {}, []

    def learn(self, stretches: Iterable[str], fresh: Callable[[list[str]], Iterable]) -> dict:
        """Values of some stretches; ``fresh`` makes those that are not known."""
        for p in self.long:
            del self.now[p]
        if len(self.now) > self.remembered:
            self.now, self.old = {}, self.now
        now, old, new = self.now, self.old, []
        for p in stretches:
            if p not in now:
                if p in old:
                    now[p] = old[p]
                else:
                    new.append(p)
        now.update(zip(new, fresh(new)))
        self.long = [p for p in new if len(p) > LONGEST]
        return now


def library(path: str):
    """The tokenizer of a file, on one thread, neither cutting nor filling up."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class ByteLevel:
    """The tokenizer of a byte-level file.

    A file with the published pattern on unchanged text, whose ids follow its merge list, is encoded by ranks,
    which gives the same ids in a third of the time; any other by its own library.
    """

    def __init__(self, path: str, specials: bool):
        self.tokenizer = library(path)
        self.tokenizer.encode_special_tokens = not specials
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        alphabet = byte_alphabet()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"].get("merges", [])]
        vocab = spec["model"]["vocab"]
        made = [vocab[left + right] for left, right in merges]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cuts = (
            spec.get("normalizer") is None and spec.get("post_processor") is None and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space") and made == sorted(made)
            and not any(" " in t or "\n" in t for t in added)
        )
        self.bytes_of = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        if self.cuts:
            import tiktoken

            ranks = {self.bytes_of[i]: i for t, i in vocab.items() if t not in added}
            self.ranked = tiktoken.Encoding("ranks", pat_str=PIECES.pattern, mergeable_ranks=ranks, special_tokens=added)
            self.allowed = set(added) if specials else set()

    def ids(self, text: str) -> np.ndarray:
        if self.cuts:
            return self.ranked.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def stretch(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        return self.ranked.encode_ordinary(text) if self.cuts else self.ids(text).tolist()


def portions(batches: Iterator[pa.RecordBatch], at_a_time: int | None = None) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with the strings of column ``text`` (null: empty), at least so many characters (AT_A_TIME) or one row each."""
    enough = at_a_time or AT_A_TIME
    for batch in batches:
        texts, start, held = batch.column("text"), 0, 0
        part: list[str] = []
        for i in range(batch.num_rows):
            part.append(texts[i].as_py() or "")
            held += len(part[-1])
            if held >= enough or i == batch.num_rows - 1:
                yield batch.slice(start, i + 1 - start), part
                start, held, part = i + 1, 0, []
