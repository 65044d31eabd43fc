"""Reading, staging and word expressions shared by the operators.

Operators keep their own working columns under names that start with two underscores, so extra
columns of a caller's table pass through or are ignored without clashing.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import curvelens
from curvelens.session import shared_dir

SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Tables up to this many rows may be sent to every executor; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once for a Spark application."""
    context = spark.sparkContext
    if getattr(context, "_curvelens_shipped", False):
        return
    package = Path(curvelens.__file__).parent
    target = Path(tempfile.mkdtemp(prefix="curvelens-")) / "curvelens.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, str(file.relative_to(package.parent)))
    context.addPyFile(str(target))
    context._curvelens_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, purpose: str, together: int | None = None) -> DataFrame:
    """The same rows, written to the cluster's shared folder and read again.

    Cuts the lineage and survives lost executors. The folder is the one in ``spark.checkpoint.dir``.
    At most ``together`` rows are read into memory at once, for rows of many megabytes.
    """
    spark = df.sparkSession
    folder = shared_dir(spark, purpose)
    writer = df.write if together is None else df.write.option("parquet.block.row.count.limit", together)
    writer.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table, marked for broadcast only if a count proves it small."""
    return F.broadcast(df) if df.count() <= limit else df


def body(text: str | Column = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z as a-z, other letters as they are; a text of ASCII alone takes the faster way, with the same result."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Lower-cased words between runs of white space."""
    return F.array_remove(F.split(ascii_lower(text), SPACE), "")


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, also where it is used inside another lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def shingles(tokens: Column, width: int = 5) -> Column:
    """Distinct 64-bit hashes of the runs of ``width`` words.

    Fewer words make one shingle of the whole sequence, no words none.
    """

    def of(t: Column) -> Column:
        run = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(t) - (width - 1), F.lit(1))),
            lambda i: F.xxhash64(*[F.get(t, i + (k - 1)) for k in range(width)]),
        )
        return F.when(F.size(t) > 0, F.array_distinct(run)).otherwise(F.array().cast("array<bigint>"))

    return let(tokens, of)


def each_shingle(docs: DataFrame, key: str, tokens: Column, width: int = 5) -> DataFrame:
    """``key`` and __shingle, a row for every place in the list of words; the values are those of ``shingles``.

    A shingle that a text repeats comes again. The hashes are taken after the places are rows, in compiled code. A text
    without words has one null.
    """
    listed = docs.select(key, tokens.alias("__words"))
    last = F.greatest(F.size("__words") - width, F.lit(0))
    places = listed.select(key, "__words", F.explode(F.sequence(F.lit(0), last)).alias("__i"))
    words_at = [F.get("__words", F.col("__i") + k) for k in range(width)]
    return places.select(key, F.when(words_at[0].isNotNull(), F.xxhash64(*words_at)).alias("__shingle"))
