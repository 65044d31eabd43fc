"""Dashboard datasets and protocol KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelens.contracts import Thresholds
from curvelens.functions.scalars import count_if, day_text, flag, minutes_between, position, ratio, rounded, steady
from curvelens.operators.velocity import DAY_KEY, velocity_index


def dash_active_curves(dim_tokens: DataFrame) -> DataFrame:
    return dim_tokens.select(
        "token_address", "curve_fill_pct", "current_base_in_curve", "graduation_threshold_base", "curve_status",
        "sniper_volume_penetration_pct", "total_snipers_detected",
    ).orderBy(F.desc("curve_fill_pct"), "token_address")


def dash_daily_velocity(fct_curve_daily: DataFrame) -> DataFrame:
    return fct_curve_daily.select(
        "trade_date", "token_address", "daily_volume_base", "token_velocity_index", "turnover_rate_pct",
        "velocity_health_tier",
    ).orderBy(F.desc("trade_date"), "token_address")


def dash_wallet_segments(dim_wallets: DataFrame) -> DataFrame:
    return (
        dim_wallets.groupBy("primary_wallet_segment")
        .agg(
            F.count("*").alias("total_wallets"),
            rounded(F.sum("lifetime_base_invested"), 2).alias("total_volume_base"),
            rounded(F.avg("lifetime_net_pnl_base"), 2).alias("avg_pnl_base"),
        )
        .orderBy(F.desc("total_volume_base"), "primary_wallet_segment")
    )


def kpi_summary(
    states: DataFrame, meta: DataFrame, thresholds: Thresholds = Thresholds(), close: str = "max"
) -> DataFrame:
    """The four headline numbers of the dashboard in one row, from one pass over the trade states.

    Each row of a day and trader counts once for its day and once for its wallet; the two kinds are told apart
    by a tag and summed by the same aggregates.
    """
    last = close == "last"
    price = F.max_by("spot_price_after_trade", position()) if last else F.max("spot_price_after_trade")
    days = states.groupBy(*DAY_KEY[:2], day_text("block_timestamp").alias("trade_date"), "trader_address").agg(
        F.sum("base_asset_amount").alias("volume"), price.alias("price"),
        *([F.max(position()).alias("at")] if last else []), F.max("cumulative_base_collected").alias("collected"),
    )
    none = F.lit(None).cast("string")
    kinds = F.array(
        F.struct(F.lit(True).alias("daily"), *DAY_KEY, none.alias("trader_address")),
        F.struct(F.lit(False).alias("daily"), *[none.alias(c) for c in DAY_KEY], F.col("trader_address")),
    )
    measures = [c for c in days.columns if c not in (*DAY_KEY, "trader_address")]
    tagged = days.select(F.explode(kinds).alias("k"), *measures).groupBy("k").agg(
        F.sum("volume").alias("volume"), (F.max_by("price", "at") if last else F.max("price")).alias("price"),
        F.max("collected").alias("collected"),
    ).select("k.*", "volume", "price", "collected")
    launches = meta.groupBy("token_address", "curve_address").agg(
        F.max("initial_token_supply").alias("supply"), F.count(F.lit(1)).alias("launches")
    )
    supplies = launches.select("curve_address", "supply")
    index = velocity_index("volume", F.col("supply") * F.col("price"))
    tokens = (
        tagged.join(supplies, "curve_address", "left").withColumn("index", F.when(F.col("daily"), index))
        .groupBy("daily", "token_address", "curve_address")
        .agg(
            F.sum("index").alias("index_sum"), F.count("index").alias("index_count"), F.max("collected").alias("collected"),
            F.count(F.lit(1)).alias("rows"),
        )
        .join(launches.drop("supply"), ["token_address", "curve_address"], "left")
    )
    locked = F.when(F.col("daily"), steady(F.coalesce("collected", F.lit(0.0)), 4) * F.col("launches"))
    known = meta.agg(F.count("token_address").alias("n"), F.count(F.lit(1)).alias("rows")).select(F.struct("n", "rows")).scalar()
    return tokens.agg(
        known["n"].alias("monitored_launches"),
        F.coalesce(F.sum(locked), F.when(known["rows"] > 0, 0.0)).alias("total_base_locked"),
        F.coalesce(F.sum(F.when(~F.col("daily"), F.col("rows"))), F.lit(0)).alias("tracked_wallets"),
        ratio(F.sum("index_sum"), F.sum("index_count")).alias("avg_token_velocity_index"),
    )


def protocol_kpis(swaps: DataFrame, meta: DataFrame, graduations: DataFrame, as_of=None) -> DataFrame:
    """Command-centre row: curve counts, graduation rate and time, and activity of the last 24 hours.

    ``as_of`` defaults to the last trade of the tape; the window is (as_of - 24 h, as_of]. A curve
    that has ever graduated is not active.
    """
    end = F.lit(as_of).cast("timestamp_ntz") if as_of is not None else swaps.agg(F.max("block_timestamp")).scalar()
    recent = swaps.where(
        (F.col("block_timestamp") > end - F.expr("interval 24 hours")) & (F.col("block_timestamp") <= end)
    )
    last_day = (
        recent.groupBy("trader_address")
        .agg(F.sum("protocol_fee_amount").alias("fees"), F.sum("base_asset_amount").alias("volume"))
        .agg(
            F.struct(
                F.coalesce(F.sum("fees"), F.lit(0.0)).alias("fees"),
                F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
                F.count("trader_address").alias("traders"),
            )
        )
        .scalar()
    )
    done = F.col("graduated_at").isNotNull()
    curves = meta.join(
        graduations.select("token_address", "curve_address", "graduated_at"), ["token_address", "curve_address"], "left"
    )
    return (
        curves.withColumns(
            {
                "minutes": minutes_between("creation_timestamp", "graduated_at"),
                "new": flag(F.to_date("creation_timestamp") == F.to_date(end)),
            }
        )
        .agg(
            F.count("*").alias("created_curves"),
            count_if(~done).alias("active_curves"),
            F.coalesce(F.sum("new"), F.lit(0)).cast("long").alias("created_today"),
            count_if(done).alias("graduated_curves"),
            F.avg("minutes").alias("avg_minutes_to_graduate"),
        )
        .withColumn("graduation_rate_pct", rounded(ratio("graduated_curves", "created_curves") * 100.0, 2))
        .withColumn("day", last_day)
        .select(
            "created_curves", "active_curves", "created_today", "graduated_curves", "graduation_rate_pct",
            "avg_minutes_to_graduate", F.col("day.fees").alias("fees_24h"), F.col("day.volume").alias("volume_24h"),
            F.col("day.traders").alias("traders_24h"),
        )
    )


def rollup_5m(swaps: DataFrame) -> DataFrame:
    """Volume, fees, trades and traders in tumbling 5-minute windows, summed per trader first."""
    return (
        swaps.groupBy(F.window("block_timestamp", "5 minutes").alias("w"), "trader_address")
        .agg(
            F.sum("base_asset_amount").alias("volume"),
            F.sum("protocol_fee_amount").alias("fees"),
            F.count("*").alias("n"),
        )
        .groupBy("w")
        .agg(
            F.sum("volume").alias("volume_base"),
            F.sum("fees").alias("fees_base"),
            F.sum("n").alias("trades"),
            F.count("trader_address").alias("traders"),
        )
        .select(F.col("w.start").alias("window_start"), "volume_base", "fees_base", "trades", "traders")
    )
