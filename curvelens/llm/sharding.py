"""Sharding by sampled splitters.

Rows are ordered by (hash of the text, doc_id): equal texts lie together, and a group of copies that is
too large for a shard is cut inside. A size-weighted sample of the keys gives quantile boundaries of many
small ranges. Exact sums per range place every row on the byte line, and the shards are equal pieces of
that line; a range that a shard border crosses, or that came out overfull, is subdivided.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvelens.llm.common import body, staged

#: Ranges per shard, and sampled keys per range.
RANGES, KEYS = 32, 8
CELL_BITS = 12


def record_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 8) and unsigned CRC of the text, with the key columns."""
    text = body()
    return docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("__h"), F.monotonically_increasing_id().alias("__tie"),
    )


def _ranges(rows: DataFrame, total: int, ranges: int) -> DataFrame:
    """Rows with __range, the number of sampled splitters at or below their key."""
    key = F.struct("__h", "doc_id", "__tie")
    chance = F.col("size") * (ranges * KEYS / max(total, 1))
    drawn = (F.xxhash64("__h", "doc_id", "__tie", F.lit("draw")).bitwiseAND(0xFFFFFF) + 0.5) / float(1 << 24)
    sample = rows.where(drawn < chance).select(key.alias("__key"))
    nth = sample.withColumn("__n", F.row_number().over(Window.orderBy("__key"))).where(F.col("__n") % KEYS == 0)
    cell = F.shiftright(F.col("__key.__h"), 64 - CELL_BITS)
    cuts = nth.groupBy(cell.alias("__cell")).agg(F.array_sort(F.collect_list("__key")).alias("__cuts"))
    cells = rows.sparkSession.range(-(1 << CELL_BITS - 1), 1 << CELL_BITS - 1, numPartitions=1).toDF("__cell").join(cuts, "__cell", "left")
    counted = F.coalesce(F.size("__cuts"), F.lit(0))
    below = F.sum(counted).over(Window.orderBy("__cell")) - counted
    cells = cells.select("__cell", "__cuts", F.greatest(below, F.lit(0)).alias("__below"))
    # 2 ** CELL_BITS rows and about ``ranges`` splitters, whatever the input
    placed = rows.withColumn("__cell", F.shiftright("__h", 64 - CELL_BITS)).join(F.broadcast(staged(cells, "splitters")), "__cell")
    inside = F.coalesce(F.size(F.filter("__cuts", lambda c: c <= key)), F.lit(0))
    return placed.withColumn("__range", (F.col("__below") + F.greatest(inside, F.lit(0))).cast("int")).drop("__cell", "__cuts", "__below")


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every row.

    The law is ``bytes``: a row goes to the shard in which the middle of its bytes falls, so a shard
    differs from an equal share by one row's size at most. Slots number a shard's rows from 0.

    * A null text has no bytes and the CRC of an empty one.
    * Null and repeated doc_ids keep a row each; rows alike in all columns are interchangeable.
    * An empty table gives an empty result, and few rows may leave shards empty.
    """
    rows = staged(record_sizes(docs), "record-sizes")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    ranged = _ranges(rows, total, shards * RANGES)
    # A range beyond twice its due size is cut again, by a hash of its rows.
    due = max(2 * total // (shards * RANGES), 1)
    sums = staged(ranged, "ranged").groupBy("__range").agg(F.sum("size").alias("__bytes"))
    ranged = staged(
        ranged.join(F.broadcast(staged(sums.select("__range", F.ceil(F.col("__bytes") / due).alias("__pieces")), "range-pieces")), "__range")
        .withColumn("__piece", F.pmod(F.xxhash64("__tie"), "__pieces")).drop("__pieces"),
        "pieces",
    )
    order = Window.orderBy("__range", "__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("__range", "__piece").agg(F.sum("size").alias("__b"), F.count(F.lit(1)).alias("__c"))
        .select("__range", "__piece", *[F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"{c}0") for c in ("__b", "__c")])
    )
    inside = Window.partitionBy("__range", "__piece").orderBy("__h", "doc_id", "__tie")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(staged(starts, "range-starts")), ["__range", "__piece"]).select(
        "doc_id", "size", "text_crc32",
        (F.col("__b0") + F.coalesce(F.sum("size").over(before), F.lit(0))).alias("__before"),
        (F.col("__c0") + F.row_number().over(inside) - 1).alias("__row"),
    )
    at = F.floor((F.col("__before") * 2 + F.col("size")) * shards / (2 * max(total, 1))).cast("int")
    placed = staged(placed.withColumn("shard", F.least(at, F.lit(shards - 1))), "shards")
    first = placed.groupBy("shard").agg(F.min("__row").alias("__first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("__row") - F.col("__first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
