"""Joins on hot keys: same rows as a plain join, keys spread over several partitions."""

from curvelens.operators.skew import spread_join
from pyspark.sql import functions as F


def test_same_rows_as_a_plain_join(spark):
    many = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        F.when(F.col("id") % 50 != 0, F.col("id")).alias("id"),
    )
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("none", 4)], "k string, v int")
    for how in ("inner", "left"):
        got = spread_join(many, few, ["k"], by="id", how=how, buckets=5)
        want = many.join(few, "k", how)
        assert sorted(map(str, got.select("k", "id", "v").collect())) == sorted(map(str, want.select("k", "id", "v").collect()))


def test_hot_key_is_spread(spark):
    many = spark.range(2000).select(F.lit("hot").alias("k"), "id")
    few = spark.createDataFrame([("hot", 1)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = spread_join(many, few, ["k"], by="id").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["count"] for r in parts) == 2000
    assert len(parts) > 1 and max(r["count"] for r in parts) < 1500
