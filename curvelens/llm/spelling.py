"""Spelling variants by dense prefix-suffix tiling.

Two words of which the longer has M code points are one edit apart if their common prefix and suffix
together reach M - 1. The edit then lies at the end of the common prefix, inside one window of the M places,
and what stands before and after that window is equal. So words meet by (M, window, what stands around
it). Blocks of words that meet are laid out as padded matrices of code points, once from the front and once from
the back, and every block is compared with itself or with the other blocks of its group at once: place by place,
common prefixes and suffixes grow for all pairs of a tile. A pair counts in the window of its own edit only.

A window of one place has at most one word for each letter, and one without. Groups that are too large are
therefore taken apart by halving their windows, which ends in groups that the alphabet bounds, whatever the input.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelens.llm.common import let, ship, small, staged

#: Code points of a word at least, and occurrences; how much more frequent a form is than its variant.
LENGTH, TIMES, RATIO = 7, 2, 10
#: A run loses a code point where this divides its hash.
MODULUS = 31
#: Places of a window, windows of a word at most, words of a group at most, words of a tile's side, cells of a tile.
WINDOW, WINDOWS, GROUP, SIDE, CELLS = 3, 8, 4096, 128, 1 << 22
#: Distinct words a task holds before it passes their counts on.
HELD = 200_000

RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LENGTH)


# --- words


def runs(doc_id, text: str) -> Iterator[tuple[str, int]]:
    """Long lower-cased runs of a text with their number, after the deletions that their hashes ask for."""
    begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    low = text.encode().lower().decode()  # of bytes: A-Z only
    for run, n in Counter(RUN.findall(low)).items():
        h = zlib.crc32(run.encode(), begun)
        if h % MODULUS == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LENGTH:
                continue
        yield run, n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            for run, n in runs(doc_id.as_py(), text.as_py() or ""):
                held[run] += n
            if len(held) > HELD:
                yield out()
                held.clear()
    yield out()


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of the words with at least TIMES occurrences, staged."""
    ship(docs.sparkSession)
    counts = docs.select("doc_id", "text").mapInArrow(_counted, "word string, n long")
    return staged(counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES), "words")


# --- where words meet


def _key(word: Column, size: Column, start: Column, stop: Column) -> Column:
    """Names the group of a word: the longer word's size, the window, and what stands around it."""
    tail = size - stop
    return F.xxhash64(size, start, stop, F.substring(word, F.lit(1), start), F.substring(word, F.char_length(word) - tail + 1, tail))


def windowed(words: DataFrame) -> DataFrame:
    """(word, n, size, start, stop) for each window, as the longer or equal word and as the shorter one."""
    size = F.explode(F.array(F.char_length("word"), F.char_length("word") + 1)).alias("size")
    wide = F.greatest(F.lit(WINDOW), F.ceil(F.col("size") / WINDOWS).cast("int"))
    starts = let(wide, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / w).cast("int")), lambda i: F.struct(
        (i * w).alias("start"), F.least((i + 1) * w, F.col("size")).alias("stop"))))
    return words.select("word", "n", size).select("word", "n", "size", F.explode(starts).alias("w")).select("word", "n", "size", "w.start", "w.stop")


def halved(rows: DataFrame) -> DataFrame:
    """Each window as its two halves."""
    middle = ((F.col("start") + F.col("stop")) / 2).cast("int")
    sides = F.array(F.struct(F.col("start"), middle.alias("stop")), F.struct(middle.alias("start"), F.col("stop")))
    return rows.select("word", "n", "size", F.explode(sides).alias("w")).select("word", "n", "size", "w.start", "w.stop")


def meetings(words: DataFrame, most: int = GROUP) -> DataFrame:
    """(key, word, n, size, start, stop): groups of at most ``most`` words, or with a window of one place."""
    done, rows = None, windowed(words)
    while True:
        rows = staged(rows.withColumn("key", _key(F.col("word"), F.col("size"), F.col("start"), F.col("stop"))), "meetings")
        wide = rows.where("stop - start > 1").groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > most)
        wide = small(staged(wide.select("key"), "large-groups"))
        if wide.isEmpty():
            return rows if done is None else done.unionByName(rows)
        kept = rows.join(wide, "key", "left_anti")
        done = kept if done is None else done.unionByName(kept)
        rows = halved(rows.join(wide, "key", "left_semi").where("stop - start > 1"))


# --- tiles


def matrices(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points from the front and from the back, padded with -1, and the lengths."""
    n = np.array([len(t) for t in texts])
    front = np.full((len(texts), max(n)), -1, np.int32)
    front[np.arange(front.shape[1]) < n[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), np.int32)
    back = np.full_like(front, -1)
    back[np.arange(front.shape[1]) < n[:, None]] = np.frombuffer("".join(t[::-1] for t in texts).encode("utf-32-le"), np.int32)
    return front, back, n


def common(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Length of the common start of every row of a with every row of b; ``n``: the shorter length of each pair."""
    alive = np.ones((len(a), len(b)), bool)
    out = np.zeros((len(a), len(b)), np.int32)
    for x, y in zip(a.T[: b.shape[1]], b.T):
        alive &= x[:, None] == y
        if not alive.any():
            break
        out += alive
    return np.minimum(out, n)  # padding equals padding


def near(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For two blocks of words: which are exactly one edit apart, and the place of the edit."""
    longer, shorter = np.maximum(a[2][:, None], b[2]), np.minimum(a[2][:, None], b[2])
    prefix, suffix = common(a[0], b[0], shorter), common(a[1], b[1], shorter)
    equal = (prefix == shorter) & (longer == shorter)
    return (prefix + suffix >= longer - 1) & (longer - shorter <= 1) & ~equal, prefix


class Block:
    """Rows of some groups, in the order of their keys, and their matrices."""

    def __init__(self, rows: dict[str, np.ndarray], start: int, stop: int):
        self.rows = {name: column[start:stop] for name, column in rows.items()}
        self.codes = matrices(self.rows["word"].tolist())


def _tile(x: Block, y: Block) -> tuple[np.ndarray, ...]:
    """(word, near word, its n), both ways, of the pairs of two blocks whose edit lies in the window of their group."""
    close, at = near(x.codes, y.codes)
    a, b = x.rows, y.rows
    if x is y:
        close &= np.tri(len(close), k=-1, dtype=bool).T
    close &= a["key"][:, None] == b["key"]
    close &= np.maximum(x.codes[2][:, None], y.codes[2]) == a["size"][:, None]  # else they meet as shorter words only
    close &= (at >= a["start"][:, None]) & (at < a["stop"][:, None])
    i, j = np.nonzero(close)
    u, v = a["word"][i], b["word"][j]
    return np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([b["n"][j], a["n"][i]])


def tiles(table: pd.DataFrame) -> Iterator[tuple[np.ndarray, ...]]:
    """Near pairs of whole groups in the order of their keys: small groups share a tile, large ones take several."""
    keys = table["key"].to_numpy()
    first = np.append(True, keys[1:] != keys[:-1])
    alone = first & np.append(first[1:], True)
    table = table[~alone]
    if table.empty:
        return
    rows = {name: table[name].to_numpy() for name in table.columns}
    side = max(1, min(SIDE, CELLS // int(table["word"].str.len().max())))
    edges = np.append(np.flatnonzero(first[~alone]), len(table))
    at = 0
    for k, (start, stop) in enumerate(zip(edges, edges[1:])):
        if stop - start > side:
            blocks = [Block(rows, i, min(i + side, stop)) for i in range(start, stop, side)]
            for i, x in enumerate(blocks):
                for y in blocks[i:]:
                    yield _tile(x, y)
            at = stop
        elif k + 2 == len(edges) or edges[k + 2] - at > side:  # the next group no longer fits
            block = Block(rows, at, stop)
            yield _tile(block, block)
            at = stop


def _best(pairs: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    """Of each word: how many are near, and the best form among them."""
    found = pd.DataFrame(dict(zip(("word", "form", "form_n"), map(np.concatenate, zip(*pairs)))))
    found = found.sort_values(["word", "form_n", "form"], ascending=[True, False, True])
    found["n_near"] = found.groupby("word", sort=False)["form"].transform("size")
    return found.drop_duplicates("word")[["word", "n_near", "form", "form_n"]]


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of sorted keys; the last group of a batch waits for the next one."""
    rest = pd.DataFrame()
    for part in batches:
        rows = pd.concat([rest, part], ignore_index=True)
        cut = int(np.searchsorted(rows["key"].to_numpy(), rows["key"].iloc[-1])) if len(rows) else 0
        rest = rows.iloc[cut:]
        if cut and (found := list(tiles(rows.iloc[:cut]))):
            yield _best(found)
    if len(rest) and (found := list(tiles(rest.reset_index(drop=True)))):
        yield _best(found)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of the words with near words; the form is the most frequent, ties the smallest."""
    met = meetings(words)
    met = met.repartition("key").sortWithinPartitions("key")
    found = met.mapInPandas(_met, "word string, n_near long, form string, form_n long")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("b"))
    return best.select("word", "n_near", "b.form", (-F.col("b.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table of (word, form): forms are followed to the last, doubling the steps.

    Counts grow tenfold along a form, so a chain is as long as the digits of a count at most.
    """
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the documents.

    * Null and empty texts have no words; an empty table gives an empty result.
    * A null id counts as empty text in the hash. Repeated rows count each.
    * Very long runs are words like others; extra columns are ignored.
    """
    counted = words(docs)
    joined = counted.join(staged(neighbours(counted), "neighbours"), "word", "left")
    is_form = F.col("form_n") >= RATIO * F.col("n")
    out = joined.select(
        "word", F.when(is_form, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("form_n")).alias("form_n"),
    )
    out = staged(out, "forms")
    found = roots(out.where("form is not null"))
    return out.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
