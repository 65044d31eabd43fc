"""Readers of the raw tables and writers of the marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from curvelens import contracts


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Batch scan under a declared schema; nothing is inferred."""
    return spark.read.schema(schema).format(fmt).load(path)


def read_swaps(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, contracts.RAW_SWAPS, fmt)


def read_curve_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, contracts.RAW_CURVE_EVENTS, fmt)


def read_transfers(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, contracts.RAW_TRANSFERS, fmt)


def read_chain_swaps(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, contracts.CHAIN_SWAPS, fmt)


def read_chain_curves(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_table(spark, path, contracts.CHAIN_CURVES, fmt)


def write_mart(df: DataFrame, path: str, partition_by: str | None = None, dynamic: bool = False) -> None:
    """Full refresh of one mart as Parquet; ``dynamic`` replaces only the partitions present in ``df``.

    A partitioned mart is first rebalanced by its partition column: adaptive execution gives a large
    day as many tasks as its bytes ask for, and puts small days together.
    """
    writer = df.hint("rebalance", partition_by) if partition_by else df
    out = writer.write.mode("overwrite")
    if partition_by:
        out = out.partitionBy(partition_by)
    if dynamic:
        out = out.option("partitionOverwriteMode", "dynamic")
    out.parquet(path)
