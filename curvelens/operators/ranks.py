"""Ranks of all rows without gathering them in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, by: list[str], buckets: list[Column], order: list[Column], name: str) -> DataFrame:
    """Adds the place of every row (from 1) among the rows of its key ``by``.

    ``buckets`` rise with the place, so a row's place is the number of rows in the buckets before
    its own plus its place inside. Buckets are nested: the rows before a bucket are counted level by level,
    among the buckets that share the ones above it. Without a key, one task sees the first level only, so
    its values have to be few, whatever the number of rows.
    """
    marks = [f"_bucket_{i}" for i in range(len(buckets))]
    marked = rows.withColumns(dict(zip(marks, buckets)))
    counts = marked.groupBy(*by, *marks).agg(F.count(F.lit(1)).alias("_rows"))
    before, sums = counts.drop("_rows"), []
    for i, mark in enumerate(marks):
        above = [*by, *marks[:i]]
        along = Window.partitionBy(*above).orderBy(mark).rowsBetween(Window.unboundedPreceding, -1)
        level = counts.groupBy(*above, mark).agg(F.sum("_rows").alias("_rows"))
        sums.append(F.coalesce(F.col(f"_before_{i}"), F.lit(0)))
        before = before.join(level.withColumn(f"_before_{i}", F.sum("_rows").over(along)).drop("_rows"), [*above, mark])
    before = before.select(*by, *marks, reduce(Column.__add__, sums).alias("_before"))
    inside = Window.partitionBy(*by, *marks).orderBy(*order)
    return (
        marked.join(before, [*by, *marks])
        .withColumn(name, (F.col("_before") + F.row_number().over(inside)).cast("int"))
        .drop("_before", *marks)
    )
