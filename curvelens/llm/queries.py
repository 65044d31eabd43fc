"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelens.llm import (
    alignment, bpe, decontam, fingerprints, jaccard_join, licenses, line_dedup, lm, packing, quality, sharding, spelling, sql, toxicity,
)
from curvelens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(spark: SparkSession) -> str:
    """The tokenizer file, from ``spark.curvelens.tokenizer`` or the installed public package."""
    if found := spark.conf.get("spark.curvelens.tokenizer", None):
        return found
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_path(spark: SparkSession) -> str:
    """The sentence piece model, from ``spark.curvelens.pieces`` or the installed public package."""
    if found := spark.conf.get("spark.curvelens.pieces", None):
        return found
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs.select("doc_id", "text"), labels.where(_fold(5) != 0))
    score = F.round("toxicity", 9)
    return scored.select(
        "doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), score.alias("score"),
        F.when(score >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *[F.round(c, 6).alias(c) for c in ("evidence", "host_posterior", "path_posterior", "score")], "rejected")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(spark))
    return coded.select(
        "doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.document_licences(table(spark, sf_dir, "documents"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), _fold(10) == 0)
    return scored.select("*").withColumn("bits_per_byte", F.round("bits_per_byte", 6))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path(spark), with_ids=False)
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(spark), pieces_path(spark), digests=True)
    return found.withColumnRenamed("groups", "groups_sha256")


OPERATORS = (
    op1_toxicity, op2_quality, op3_bpe, op4_fingerprints, op5_jaccard_join, op6_line_dedup, op7_sharding, op8_licences, op9_lm,
    op10_decontamination, op11_packing, op12_spelling, op13_alignment,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": sql.LINE_DEDUP, "op10_decontamination": sql.LEAKS}
