"""Streaming front end: raw swaps as a stream, staged like the batch tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curvelens.operators.staging import stage_swaps

WATERMARK = "10 minutes"
#: Columns in which a row delivered twice agrees with itself, and legs of one transaction do not.
SAME_TRADE = [
    "tx_hash", "block_number", "tx_index", "curve_address", "trader_address", "trade_type", "base_asset_amount",
    "token_amount",
]


def stream_table(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    files: str = "*.parquet",
    max_files: int | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", files)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def staged_stream(raw: DataFrame, to_swaps: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Staged swaps from a raw stream; the staging rules are those of the batch tables."""
    return stage_swaps(to_swaps(raw) if to_swaps else raw)


def delivered(rows: DataFrame, folder: str, arrival: str, parts: int, rows_per_file: int = 1_000_000) -> int:
    """Writes a table to files in the order of a column of arrival times, as a stream would find them.

    The time from the first to the last arrival is cut into ``parts`` equal parts. Returns the files of a part; the
    column of arrivals is left out.
    """
    start, end, n = rows.agg(F.min(arrival), F.max(arrival), F.count(F.lit(1))).first()
    files = max(1, -(-n // (parts * rows_per_file)))
    for k in range(parts):
        low, high = (F.lit(start + (end - start) * i / parts) for i in (k, k + 1))
        inside = (F.col(arrival) >= low) & ((F.col(arrival) < high) | F.lit(k == parts - 1))
        rows.where(inside).drop(arrival).repartition(files).write.mode("append").parquet(folder)
    return files
