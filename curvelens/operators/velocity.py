"""Token velocity: daily, on the decoded log, rolling 24 hours; buyer retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelens.contracts import TOKEN_VELOCITY, VELOCITY_PROFILE, Thresholds
from curvelens.functions.scalars import (
    day_start, day_text, first_match, from_minute_index, hour_index, is_buy, position, ratio, rounded, signed,
    spot_price, steady,
)
from curvelens.operators.curve import status_label

DAY_KEY = ["token_address", "curve_address", "trade_date"]


def velocity_index(volume: str, market_cap: Column) -> Column:
    return F.when(market_cap > 0, rounded(F.col(volume) / market_cap, 4)).otherwise(F.lit(0.0))


def velocity_tier(index: str, thresholds: Thresholds) -> Column:
    v = F.col(index)
    return first_match(
        [
            (v >= thresholds.velocity_hyper, "HYPER_VELOCITY"),
            (v >= thresholds.velocity_healthy, "HEALTHY_CIRCULATION"),
            (v >= thresholds.velocity_moderate, "MODERATE_VELOCITY"),
        ],
        "STAGNANT_LIQUIDITY",
    )


def transactions(trades: DataFrame, by: list[str]) -> DataFrame:
    """Distinct transaction hashes by key as ``tx_count``; missing hashes count nothing.

    Two levels of plain aggregates: a hash is kept once per key, also if it was mined again in a later block.
    """
    return trades.select(*by, "tx_hash").distinct().groupBy(*by).agg(F.count("tx_hash").alias("tx_count"))


def trader_days(states: DataFrame, close: str = "max") -> DataFrame:
    """Trades summed per token, curve, day and trader.

    Everything downstream of a day works on these rows: traders are counted without a distinct
    aggregate.
    """
    extra = []
    if close == "last":
        extra = [
            F.max(position()).alias("last_position"),
            F.max_by("spot_price_after_trade", position()).alias("last_price"),
        ]
    return states.groupBy(
        "token_address", "curve_address", day_text("block_timestamp").alias("trade_date"), "trader_address"
    ).agg(
        F.sum("base_asset_amount").alias("volume"),
        F.sum("token_amount").alias("tokens"),
        F.sum("spot_price_after_trade").alias("price_sum"),
        F.count("spot_price_after_trade").alias("price_count"),
        F.max("spot_price_after_trade").alias("price_max"),
        F.max("curve_fill_pct").alias("fill_max"),
        F.max("graduated").alias("graduated"),
        *extra,
    )


def merged_trader_days(days: DataFrame, close: str = "max") -> DataFrame:
    """:func:`trader_days` from partial rows of the same days."""
    extra = [F.max("last_position").alias("last_position"), F.max_by("last_price", "last_position").alias("last_price")]
    return days.groupBy(*DAY_KEY, "trader_address").agg(
        *[F.sum(c).alias(c) for c in ("volume", "tokens", "price_sum", "price_count")],
        *[F.max(c).alias(c) for c in ("price_max", "fill_max", "graduated")],
        *(extra if close == "last" else []),
    )


def _day_measures(close: str) -> list[Column]:
    price = F.max("price_max") if close == "max" else F.max_by("last_price", "last_position")
    return [
        F.count("trader_address").alias("unique_active_traders"),
        F.sum("volume").alias("daily_volume_base"),
        F.sum("tokens").alias("daily_tokens_traded"),
        F.sum("price_sum").alias("price_sum"),
        F.sum("price_count").alias("price_count"),
        price.alias("close_price"),
        F.max("fill_max").alias("end_of_day_curve_fill_pct"),
        F.max("graduated").alias("graduated"),
    ]


def _with_transactions(days: DataFrame, trades: DataFrame) -> DataFrame:
    """Adds the day's distinct transactions as ``tx_count``; days without an address or date count too."""
    counted = transactions(trades, DAY_KEY).withColumnsRenamed({name: f"_{name}" for name in DAY_KEY})
    same_day = reduce(Column.__and__, [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in DAY_KEY])
    return days.join(counted, same_day).drop(*[f"_{name}" for name in DAY_KEY])


def daily_velocity(
    days: DataFrame,
    trades: DataFrame,
    meta: DataFrame,
    thresholds: Thresholds = Thresholds(),
    close: str = "max",
    more: list[Column] | None = None,
) -> DataFrame:
    """Velocity metrics per curve and day from :func:`trader_days`; ``more`` adds aggregates.

    ``trades`` are the same trades by themselves, from which transactions are counted.

    ``close='max'`` takes the day's highest price as its close (the published definition),
    ``'last'`` the price after the last trade.
    """
    supplies = meta.groupBy("token_address", "curve_address").agg(
        F.max("initial_token_supply").alias("total_token_supply")
    )
    cap = F.col("total_token_supply") * F.col("close_price")
    measured = days.groupBy(*DAY_KEY).agg(*_day_measures(close), *(more or []))
    return (
        _with_transactions(measured, trades.withColumn("trade_date", day_text("block_timestamp")))
        .join(supplies.drop("token_address"), "curve_address")
        .withColumns(
            {
                "avg_daily_price": ratio("price_sum", "price_count"),
                "curve_status": status_label("graduated"),
                "implied_market_cap_base": rounded(cap, 4),
                "turnover_rate_pct": steady(ratio("daily_tokens_traded", "total_token_supply") * 100.0, 4),
                "token_velocity_index": velocity_index("daily_volume_base", cap),
            }
        )
        .withColumn("velocity_health_tier", velocity_tier("token_velocity_index", thresholds))
    )


def token_velocity(
    states: DataFrame, swaps: DataFrame, meta: DataFrame, thresholds: Thresholds = Thresholds(), close: str = "max"
) -> DataFrame:
    return daily_velocity(trader_days(states, close), swaps, meta, thresholds, close).select(*TOKEN_VELOCITY)


def velocity_profile(log: DataFrame, curves: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Daily velocity at the unweighted average execution price, from the decoded logs, newest first.

    Trades are summed per trader first and transactions counted by themselves, so nothing is expanded.
    """
    dated = log.withColumn("trade_date", day_start("block_time"))
    price = ratio("base_asset_amount", "token_amount")
    per_trader = dated.groupBy(*DAY_KEY, "trader_address").agg(
        F.sum("base_asset_amount").alias("volume"), F.sum("token_amount").alias("tokens"),
        F.sum(price).alias("price_sum"), F.count(price).alias("price_count"),
    )
    days = _with_transactions(
        per_trader.groupBy(*DAY_KEY).agg(
            F.count("trader_address").alias("active_traders_count"),
            F.sum("volume").alias("volume"),
            F.sum("tokens").alias("tokens"),
            ratio(F.sum("price_sum"), F.sum("price_count")).alias("average_price"),
        ),
        dated,
    )
    cap = F.col("initial_token_supply") * F.col("average_price")
    v = F.col("token_velocity")
    return (
        days.join(curves.select("curve_address", "initial_token_supply"), "curve_address")
        .withColumns(
            {
                "volume_base": rounded("volume", 4),
                "market_cap_base": rounded(cap, 4),
                "turnover_pct": steady(ratio("tokens", "initial_token_supply") * 100.0, 4),
                "token_velocity": velocity_index("volume", cap),
            }
        )
        .withColumn(
            "velocity_profile",
            first_match(
                [
                    (v > thresholds.velocity_hyper, "HYPER_VELOCITY (HIGH SPECULATION / BOT CHURN)"),
                    (v >= thresholds.velocity_healthy, "ORGANIC_LIQUID_VELOCITY"),
                    (v >= thresholds.velocity_moderate, "LOW_VELOCITY (ACCUMULATION PHASE)"),
                ],
                "STAGNANT (LIQUIDITY RISK)",
            ),
        )
        .orderBy(F.desc("trade_date"), F.desc("volume"), "curve_address")
        .select(*VELOCITY_PROFILE)
    )


def velocity_24h(swaps: DataFrame, meta: DataFrame) -> DataFrame:
    """Volume of the last 24 hour buckets over the circulating market cap, at every hour with trades.

    Circulating supply is what the curve has sold on balance; price is the spot price at the end of
    the hour. The windows run over hours, not trades.
    """
    hours = swaps.groupBy("curve_address", hour_index("block_timestamp").alias("hour")).agg(
        F.sum("base_asset_amount").alias("volume"),
        F.sum(signed("base_asset_amount")).alias("net_base"),
        F.sum(signed("token_amount")).alias("net_tokens"),
    )
    tape = Window.partitionBy("curve_address").orderBy("hour")
    so_far = tape.rowsBetween(Window.unboundedPreceding, 0)
    circulating = F.col("circulating_supply")
    spot = spot_price(
        F.col("virtual_base_reserves") + F.col("base"), F.col("virtual_token_reserves") - circulating
    )
    cap = circulating * F.col("spot_price")
    return (
        hours.withColumns(
            {
                "volume_24h": F.sum("volume").over(tape.rangeBetween(-23, 0)),
                "base": F.sum("net_base").over(so_far),
                "circulating_supply": F.sum("net_tokens").over(so_far),
            }
        )
        .join(meta, "curve_address")
        .withColumn("spot_price", spot)
        .select(
            "token_address", "curve_address", from_minute_index(F.col("hour") * 60).alias("hour_start"),
            "volume_24h", "circulating_supply", "spot_price", cap.alias("circulating_market_cap"),
            velocity_index("volume_24h", cap).alias("velocity_24h"),
        )
    )


def retention(swaps: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Share of each token's first-time buyers who trade again exactly N days after their first buy.

    Trades shrink to one row per token, wallet and day before anything else, so a wallet's window
    holds at most its days.
    """
    day = F.to_date("block_timestamp")
    days = swaps.groupBy("token_address", "trader_address", day.alias("day")).agg(
        F.max(F.when(is_buy(), 1).otherwise(0)).alias("bought")
    )
    wallet = Window.partitionBy("token_address", "trader_address")
    first_buy = F.min(F.when(F.col("bought") == 1, F.col("day"))).over(wallet)
    since = F.date_diff(F.col("day"), F.col("cohort_day"))
    wallets = (
        days.withColumn("cohort_day", first_buy)
        .where(F.col("cohort_day").isNotNull())
        .groupBy("token_address", "trader_address", "cohort_day")
        .agg(*[F.max(F.when(since == n, 1).otherwise(0)).alias(f"d{n}") for n in thresholds.retention_days])
    )
    kept = [f"d{n}" for n in thresholds.retention_days]
    return (
        wallets.groupBy("token_address", "cohort_day")
        .agg(F.count("trader_address").alias("buyers"), *[F.sum(d).alias(f"{d}_retained") for d in kept])
        .select(
            "token_address", F.col("cohort_day").cast("string").alias("cohort_day"), "buyers",
            *[F.col(f"{d}_retained") for d in kept],
            *[rounded(ratio(f"{d}_retained", "buyers") * 100.0, 2).alias(f"{d}_retention_pct") for d in kept],
        )
    )
