"""Adversarial risk: supply bought by early blocks, and creator sales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelens.contracts import Thresholds
from curvelens.functions.scalars import first_match, is_buy, is_sell, ratio, steady, sum_if


def bought_by_block(swaps: DataFrame) -> DataFrame:
    """Tokens bought per curve and block, and the time of the last buy."""
    return swaps.where(is_buy()).groupBy("curve_address", "block_number").agg(
        F.sum("token_amount").alias("tokens"), F.max("block_timestamp").alias("last_buy")
    )


def launch_blocks(meta: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """The first blocks of each launch; a block that several launches of a curve share stands once."""
    first_blocks = F.sequence("creation_block", F.col("creation_block") + thresholds.sniper_blocks)
    return meta.select(
        "token_address", "curve_address", "initial_token_supply", F.explode(first_blocks).alias("block_number")
    ).distinct()


def sniper_penetration(swaps: DataFrame, meta: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Percent of each token's supply bought in blocks 0 to 2 of its launch.

    Counts gross buys of swaps whose own block lies in that range. Buys are summed per curve and
    block first; each launch then meets its three blocks by an equality join.
    """
    return penetration(bought_by_block(swaps), meta, thresholds)


def penetration(blocks: DataFrame, meta: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """:func:`sniper_penetration` from buys by block."""
    pct = F.col("penetration_pct")
    return (
        launch_blocks(meta, thresholds).join(blocks, ["curve_address", "block_number"], "left")
        .groupBy("token_address", "curve_address", "initial_token_supply")
        .agg(F.coalesce(F.sum("tokens"), F.lit(0.0)).alias("tokens_bought_early"), F.max("last_buy").alias("last_early_buy"))
        .withColumn("penetration_pct", steady(ratio("tokens_bought_early", "initial_token_supply") * 100.0, 4))
        .withColumn(
            "risk_tag",
            first_match(
                [(pct > thresholds.sniper_emergency, "EMERGENCY"), (pct > thresholds.sniper_orange, "ORANGE")],
                "NORMAL",
            ),
        )
    )


def dev_activity(tracked_states: DataFrame) -> DataFrame:
    """Trades of each curve's creator with running balance and running sales.

    Needs states built with ``track_creator=True``.
    """
    return tracked_states.where("by_creator").select(
        "tx_hash", "block_number", "block_timestamp", "tx_index", "token_address", "curve_address",
        "creator_address", "trade_type", "token_amount", "curve_fill_pct",
        F.col("creator_balance_after").alias("creator_balance"),
        F.col("creator_sold_after").alias("creator_tokens_sold"),
        F.col("creator_sold_before").alias("creator_sold_before"),
    )


def dump_risk(activity: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Creators who sold more than 10 % of their initial allocation before 80 % fill.

    The initial allocation is what the creator bought before the first sale.
    """
    early = is_sell() & (F.col("curve_fill_pct") < thresholds.dump_fill_limit)
    limit = F.col("initial_allocation") * thresholds.dump_share_of_allocation
    return (
        activity.groupBy("token_address", "curve_address", "creator_address")
        .agg(
            sum_if(is_buy() & (F.col("creator_sold_before") == 0), "token_amount").alias("initial_allocation"),
            sum_if(is_sell(), "token_amount").alias("tokens_sold"),
            sum_if(early, "token_amount").alias("tokens_sold_early"),
        )
        .withColumn(
            "risk_flag", F.when(F.col("tokens_sold_early") > limit, "High Dump Risk").otherwise("NONE")
        )
    )
