"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 128


def spread_join(
    many: DataFrame, few: DataFrame, on: list[str], by: str, how: str = "inner", buckets: int = BUCKETS
) -> DataFrame:
    """Joins many rows per key with one or few rows per key.

    A shuffle on the key alone would bring all rows of a hot curve into one task, and a following
    aggregate or window on the same key would keep them there. So each key is split into buckets by a
    hash of the column ``by``, and the few rows are repeated for every bucket. A bucket that is still
    large is an ordinary skewed join partition, which adaptive execution splits. Nothing is broadcast
    unless Spark finds the small side to be small.
    """
    split = many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(buckets)))
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    return split.join(copies, [*on, "_salt"], how).drop("_salt")
