"""Line dedup by overlapping windows of three lines.

Every three consecutive lines are hashed. The first occurrence of a window, by document id and
position, stays; the lines that later occurrences cover are removed, overlapping covers merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelens.llm.common import body, staged

WINDOW = 3


def _key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def _gaps(lines: Column, covered: Column) -> Column:
    """The lines between covered positions, in one pass over both."""
    edges = F.concat(F.array(F.lit(-1)), covered, F.array(F.size(lines)))
    runs = F.transform(
        F.sequence(F.lit(1), F.size(edges) - 1),
        lambda i: F.slice(lines, F.get(edges, i - 1) + 2, F.get(edges, i) - F.get(edges, i - 1) - 1),
    )
    return F.flatten(runs)


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(__key, __at) of every window that occurred before, by doc_id, row key and position.

    Documents without ``window`` lines have none. A null text has one empty line.
    """
    rows = docs.select(F.col("doc_id").alias("__doc"), body().alias("__text"))
    lines = rows.select("__doc", _key(F.col("__doc"), F.col("__text")).alias("__key"), F.split("__text", "\n").alias("__l"))
    at = lines.where(F.size("__l") >= window).select(
        "__doc", "__key",
        F.posexplode(F.transform(
            F.sequence(F.lit(0), F.size("__l") - window),
            lambda i: F.struct(*[F.xxhash64(F.lit(s), *[F.get("__l", i + k) for k in range(window)]).alias(f"h{s}") for s in (0, 1)]),
        )).alias("__at", "__w"),
    ).select("__doc", "__key", "__at", "__w.h0", "__w.h1")
    place = F.struct(F.col("__doc").isNull().alias("last"), F.col("__doc").alias("doc"), F.col("__key").alias("key"), F.col("__at").alias("at"))
    at = staged(at, "line-windows")
    first = (
        at.groupBy("h0", "h1").agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("__n"))
        .where("__n > 1").drop("__n")
    )
    first = staged(first, "line-firsts")
    later = at.join(first, ["h0", "h1"])
    return later.where((F.col("__first.key") != F.col("__key")) | (F.col("__first.at") != F.col("__at"))).select("__key", "__at")


def remove_repeated_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with repeated passages cut out, plus n_lines and n_removed.

    * Null text stays null and counts as one empty line; a document that loses all lines keeps an
      empty text.
    * Rows that agree in doc_id and text are one document: they lose the same lines, and the first
      occurrence stays in each of them. Other rows under one doc_id are told apart by their text.
    * Rows without doc_id come after all others.
    * Other columns pass unchanged; n_chars, if there, becomes the new length.
    """
    covered = (
        repeated_windows(docs, window).groupBy("__key").agg(F.collect_set("__at").alias("__starts"))
        .select("__key", F.array_sort(F.array_distinct(F.flatten(
            F.transform("__starts", lambda p: F.array(*[p + k for k in range(window)]))
        ))).alias("__covered"))
    )
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(names).withColumn("__key", _key(F.col("doc_id"), body()))
    # Merged at every size: the covers grow with the corpus.
    joined = rows.join(staged(covered, "line-covers").hint("merge"), "__key", "left").withColumn("__lines", F.split(body(), "\n"))
    hit = F.col("__covered").isNotNull()
    out = joined.withColumns({
        "text": F.when(hit, F.array_join(_gaps(F.col("__lines"), F.col("__covered")), "\n")).otherwise(F.col("text")),
        "n_lines": F.size("__lines"),
        "n_removed": F.when(hit, F.size("__covered")).otherwise(F.lit(0)),
    })
    if "n_chars" in names:
        kept = F.when(hit, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", kept.cast(docs.schema["n_chars"].dataType))
    return out.select(*names, "n_lines", "n_removed")
