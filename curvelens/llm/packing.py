"""Best-fit packing with swap-based local search.

Sequences that hold documents of the same lengths are alike, so the search works on kinds of sequences and
how often each occurs. A kind is known by the lengths in it; a plan needs the number of documents of each
length only, at most ``capacity`` numbers for a corpus of any size, and it has at most a few kinds for
each length. Best fit by decreasing length gives the first plan. Then documents move, or are exchanged one for
one, two for one or one for two, between underfull sequences wherever that increases the sum of squared
fills; all sequences of two kinds do so at once. Emptier sequences get emptier, until they vanish. The search
ends when nothing improves, or when no plan can have fewer sequences.

On the cluster the documents are counted by length, numbered within their length, and looked up in the plan.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvelens.llm.common import ship, staged
from curvelens.llm.stretches import ByteLevel, portions

CAPACITY, END = 1024, 2
#: Groups in which documents of one length are numbered: about so many in all, and rows of the smallest.
GROUPS, LEAST = 16_384, 64

#: A kind of sequence: (length, how many), longest first.
Kind = tuple[tuple[int, int], ...]


# --- the plan


def fill(kind: Kind) -> int:
    return sum(length * n for length, n in kind)


def changed(kind: Kind, out: tuple[int, ...], into: tuple[int, ...]) -> Kind:
    """The kind after documents of some lengths left it and others came."""
    now = Counter(dict(kind))
    now.subtract(out)
    now.update(into)
    return tuple(sorted(((length, n) for length, n in now.items() if n), reverse=True))


def best_fit(lengths: dict[int, int], capacity: int) -> Counter[Kind]:
    """Longest documents first, each into the fullest sequence that still takes it; equal ones together."""
    free: dict[int, Counter[Kind]] = {}  # sequences by the room left in them

    def put(room: int, kind: Kind, times: int) -> None:
        if times:
            free.setdefault(room, Counter())[kind] += times

    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            room = min((r for r, kinds in free.items() if r >= length and kinds), default=capacity)
            kind, times = free[room].popitem() if free.get(room) else ((), left)
            most = room // length  # documents that one of them takes
            whole, rest = divmod(min(left, times * most), most)
            put(room - most * length, changed(kind, (), (length,) * most), whole)
            if rest:
                put(room - rest * length, changed(kind, (), (length,) * rest), 1)
            if kind:
                put(room, kind, times - whole - bool(rest))
            left -= whole * most + rest
    return sum(free.values(), Counter())


@cache
def _choices(kind: Kind) -> tuple[dict[int, tuple[int, ...]], dict[int, tuple[int, ...]]]:
    """Single documents, and pairs of them, by their joint length."""
    one = {length: (length,) for length, _ in kind}
    two = {a + b: (a, b) for i, (a, n) in enumerate(kind) for b, _ in kind[i if n > 1 else i + 1:]}
    return one, two


def _bits(values) -> int:
    out = 0
    for v in values:
        out |= 1 << v
    return out


def exchange(giver: Kind, taker: Kind, capacity: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
    """What brings the taker closest to full: (gain in length, documents given, documents returned).

    None if no move or exchange makes the sum of squared fills larger.
    """
    low, high = fill(giver), fill(taker)
    room, least = capacity - high, max(low - high, 0) + 1  # the taker must end fuller than the giver was
    if least > room:
        return None
    (one, two), (back_one, back_two) = _choices(giver), _choices(taker)
    singles, both = _bits(one), _bits(one) | _bits(two)
    ways = [((), singles)] + [(y, both) for y in back_one.values()] + [(y, singles) for y in back_two.values()]
    gain, back = 0, ()
    for y, given in ways:
        reached = (given >> sum(y)) & ((1 << (room + 1)) - 1)  # bit d: some choice gains d
        if (most := reached.bit_length() - 1) > gain:
            gain, back = most, y
            if gain == room:
                break
    if gain < least:
        return None
    whole = gain + sum(back)
    return gain, one.get(whole) or two[whole], back


def local_search(kinds: Counter[Kind], capacity: int) -> Counter[Kind]:
    """Moves and exchanges between underfull sequences until none improves or no plan can be shorter."""
    kinds = Counter(kinds)
    least = -(-sum(fill(k) * n for k, n in kinds.items()) // capacity)
    full = sum(n for k, n in kinds.items() if fill(k) == capacity)
    underfull = Counter({k: n for k, n in kinds.items() if fill(k) < capacity})
    done = Counter({k: n for k, n in kinds.items() if fill(k) == capacity})
    hopeless: set[tuple[Kind, Kind]] = set()

    def step() -> tuple[Kind, Kind, tuple[int, ...], tuple[int, ...]] | None:
        by_fill = sorted(underfull, key=lambda k: (fill(k), k))
        for giver in by_fill:
            for taker in reversed(by_fill):
                if (giver, taker) in hopeless or (giver == taker and underfull[giver] < 2):
                    continue
                if found := exchange(giver, taker, capacity):
                    return giver, taker, found[1], found[2]
                hopeless.add((giver, taker))
        return None

    while full + sum(underfull.values()) > least and (found := step()):
        giver, taker, given, back = found
        times = underfull[giver] // 2 if giver == taker else min(underfull[giver], underfull[taker])
        for old, new in ((giver, changed(giver, given, back)), (taker, changed(taker, back, given))):
            underfull[old] -= times
            if not underfull[old]:
                del underfull[old]
            if fill(new) == capacity:
                done[new] += times
                full += times
            elif new:
                underfull[new] += times
    return done + underfull


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> Counter[Kind]:
    """Kinds of sequences, and how many of each, that hold so many documents of each length."""
    return local_search(best_fit(lengths, capacity), capacity)


def slots(kinds: Counter[Kind]) -> pd.DataFrame:
    """Where documents of a length go by their number: a row for each length in each kind, in that order."""
    rows, used, sequence = [], Counter(), 0
    for kind, times in sorted(kinds.items()):
        place = 0
        for length, n in kind:
            rows.append((length, used[length], n, sequence, place))
            used[length] += n * times
            place += n * length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "number", "each", "sequence", "place"]).astype("int64").sort_values(["length", "number"])


# --- documents


@cache
def _tokenizer(path: str) -> ByteLevel:
    return ByteLevel(path, specials=True)


def _cut_up(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    tokenizer, last = _tokenizer(path), np.array([end], "<u4").tobytes()
    for batch, texts in portions(batches):
        rows: list[tuple] = []
        for row, text in enumerate(texts):
            ids = tokenizer.ids(text).astype("<u4", copy=False).tobytes() + last
            n = len(ids) // 4
            first = n if n <= capacity else (n - 1) % capacity + 1
            for piece, stop in enumerate(range(first, n + 1, capacity)):
                start = 0 if piece == 0 else stop - capacity
                part = ids[4 * start : 4 * stop]
                rows.append((row, piece, start, stop - start, zlib.crc32(part), *([part] if with_ids else [])))
        row, piece, start, length, crc, *ids = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
             pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *(pa.array(x, pa.binary()) for x in ids)],
            names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])],
        )


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) of every document, staged.

    A document is its ids and then ``end``; null and empty texts are ``end`` alone. Documents of more than
    ``capacity`` tokens are cut so that all pieces but the first are full. ``ids`` are little-endian
    unsigned 32-bit integers. Repeated rows are cut each for itself, null ids stay null, extra columns are ignored.
    """
    ship(docs.sparkSession)
    table = docs.select("doc_id", "text")
    schema = f"doc_id {table.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches):
        return _cut_up(batches, path, capacity, end, with_ids)

    return staged(table.mapInArrow(run, schema), "pieces")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A staged table with a column ``length`` (1 to ``capacity``), with the columns sequence_id and offset.

    Pieces of one length are interchangeable, so they are numbered in any fixed order: within groups of bounded
    size, from the groups' sums. Equal rows get a place each; an empty table stays empty. Columns of the
    caller named sequence_id or offset are replaced.
    """
    spark = pieces.sparkSession
    found = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = max(LEAST, sum(found.values()) // GROUPS)
    places = slots(plan(found, capacity))
    key = (places["length"].to_numpy() << 48) | places["number"].to_numpy()
    number, per, sequence, place = (places[c].to_numpy() for c in ("number", "each", "sequence", "place"))

    @F.pandas_udf("sequence_id long, offset long")
    def lookup(length: pd.Series, nth: pd.Series) -> pd.DataFrame:
        size, nth = length.to_numpy(np.int64), nth.to_numpy(np.int64)
        at = np.searchsorted(key, (size << 48) | nth, "right") - 1
        copy, inside = np.divmod(nth - number[at], per[at])
        return pd.DataFrame({"sequence_id": sequence[at] + copy, "offset": place[at] + inside * size})

    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    # at most capacity rows
    groups = F.broadcast(spark.createDataFrame([(n, -(-times // each)) for n, times in found.items()], "__length long, __groups long"))
    rows = pieces.select(*columns, F.struct("_metadata.file_name", "_metadata.row_index").alias("__row"))
    rows = rows.join(groups, F.col("length") == F.col("__length")).withColumn("__group", F.pmod(F.xxhash64("__row"), "__groups"))
    sums = staged(rows.groupBy("__length", "__group").agg(F.count(F.lit(1)).alias("__n")), "length-groups")
    before = Window.partitionBy("__length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    # at most GROUPS + capacity rows
    opened = F.broadcast(sums.select("__length", "__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    inside = Window.partitionBy("__length", "__group").orderBy("__row")
    counted = rows.withColumn("__nth", F.row_number().over(inside) - 1).join(opened, ["__length", "__group"])
    return counted.withColumn("__to", lookup("length", F.col("__before") + F.col("__nth"))).select(*columns, "__to.*")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, token_ids) from packed pieces with ``ids``: the training sequences themselves."""
    held = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(held, F.lit(b""), lambda so_far, x: F.concat(so_far, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("token_ids"))
