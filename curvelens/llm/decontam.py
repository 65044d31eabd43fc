"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is sketched by k of its five-word shingles, the smallest in an order of all shingles: those of
few items first, then by hash. A document is the large set in which the sketch is looked up. Items are partitioned by size, and a partition whose largest
item has q shingles takes k = floor(q * (1 - t)) + 1: an item contained to the share t lacks fewer
shingles than its sketch has, so every such document meets the sketch, whatever the order. Wording that many
items share stands last in it and leads to no candidates. Candidates are then verified by
exact shingle containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from curvelens.llm.common import body, each_shingle, shingles, small, staged, words

CONTAINMENT = 0.75
WIDTH = 5


def item_shingles(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, __shingles, n_item_shingles), rows without words left out."""
    rows = items.select("item_id", F.array_sort(shingles(words(body()), width)).alias("__shingles"))
    return rows.withColumn("n_item_shingles", F.size("__shingles")).where("n_item_shingles > 0").distinct()


def sketches(sets: DataFrame, share: float = CONTAINMENT) -> DataFrame:
    """(item_id, __shingle) of the bottom-k sketches; sizes are partitioned at powers of two."""
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.col("n_item_shingles"))))
    k = F.floor(upper * (1 - share) + 1e-9).cast("int") + 1
    return sets.select("item_id", F.explode(F.slice("__shingles", F.lit(1), k)).alias("__shingle"))


def rare_first(sets: DataFrame, key: str) -> DataFrame:
    """The items with their shingles in the order of the sketches."""
    each = sets.select(key, F.explode("__shingles").alias("__shingle"))
    items = each.groupBy("__shingle").agg(F.count(F.lit(1)).alias("__n"))
    ordered = each.join(items, "__shingle").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__n", "__shingle"))).alias("__s"))
    return sets.drop("__shingles").join(ordered, key).withColumn("__shingles", F.col("__s.__shingle")).drop("__s")


def _row() -> Column:
    """The key of a document: rows of one id and text are the same document, other texts are others."""
    return F.xxhash64("doc_id", body())


def _found(docs: DataFrame, items: DataFrame, share: float, width: int) -> DataFrame:
    """__row and the columns of ``leaks``."""
    sets = staged(
        item_shingles(items, width).withColumn("__item", F.xxhash64("item_id", "__shingles")), "items"
    )
    marks = staged(
        sketches(rare_first(sets.withColumn("item_id", F.col("__item")), "__item"), share).groupBy("__shingle")
        .agg(F.collect_set("item_id").alias("__items")), "sketches",
    )
    hits = each_shingle(docs.withColumn("__row", _row()), "__row", words(body()), width).join(small(marks), "__shingle")
    found = staged(hits.select("__row", F.explode("__items").alias("__item")).distinct(), "leak-candidates")

    # Documents that met a sketch are read again; their shingles are compared with whole items.
    wanted = small(found.select("__row").distinct())
    again = docs.select(_row().alias("__row"), "doc_id", body().alias("text")).join(wanted, "__row", "left_semi")
    held = again.select("__row", "doc_id", F.explode(shingles(words(F.col("text")), width)).alias("__shingle")).distinct()
    whole = sets.select("__item", F.explode("__shingles").alias("__shingle"))
    shared = held.join(small(staged(whole, "item-shingles")), "__shingle")
    counted = shared.groupBy("__row", "doc_id", "__item").agg(F.count(F.lit(1)).alias("n_shared")).join(found, ["__row", "__item"], "left_semi")
    fullest = Window.partitionBy("__row", "item_id").orderBy(F.desc("containment"), F.desc("n_item_shingles"))
    return (
        counted.join(small(sets.select("__item", "item_id", "n_item_shingles")), "__item")
        .withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))
        .where(F.col("n_shared") >= F.ceil(F.col("n_item_shingles") * share - 1e-9))
        .withColumn("__n", F.row_number().over(fullest)).where("__n = 1")
        .select("__row", "doc_id", "item_id", "n_item_shingles", "n_shared", "containment")
    )


def leaks(docs: DataFrame, items: DataFrame, share: float = CONTAINMENT, width: int = WIDTH) -> DataFrame:
    """One row per document and item whose shingles lie in the document to at least ``share``.

    Columns: doc_id, item_id, n_item_shingles, n_shared, containment.

    * A null or empty text, of a document or an item, contains nothing and is contained nowhere.
    * An item of fewer words than ``width`` is one shingle, met only by a document of just these words.
    * Rows of one doc_id (or of none) with different texts are documents of their own, each reported under
      that id; rows with the same id and text are reported once. Rows of one item_id with different texts
      are searched apart and reported if one of them is found, the fullest first.
    * Extra columns are ignored.
    """
    return _found(docs, items, share, width).drop("__row")


def without_leaks(docs: DataFrame, items: DataFrame, share: float = CONTAINMENT, width: int = WIDTH) -> DataFrame:
    """The documents that contain no item; ids follow the rules of ``leaks``."""
    bad = staged(_found(docs, items, share, width).select("__row").distinct(), "leaking")
    return docs.withColumn("__row", _row()).join(bad, "__row", "left_anti").select(docs.columns)
