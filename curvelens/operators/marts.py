"""Star schema: trade and daily facts, token dimension (the wallet dimension is in ``wallets``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelens.contracts import DIM_TOKENS, FCT_CURVE_DAILY, FCT_TRADES, Thresholds
from curvelens.functions.scalars import count_if, rounded, share_pct, steady, sum_if
from curvelens.operators.curve import status_label
from curvelens.operators.velocity import daily_velocity, trader_days, transactions
from curvelens.operators.wallets import WALLET_KEY, is_sniper

TOKEN_KEY = ["token_address", "curve_address"]


def fct_trades(states: DataFrame, wallets: DataFrame) -> DataFrame:
    """Every trade with the cohort and flags of its wallet.

    The join key is the wallet, so a hot curve spreads over its wallets; a single hot wallet is a
    skewed partition of the left side of a left join, which adaptive execution splits.
    """
    labels = wallets.select(
        *WALLET_KEY, F.col("behavioral_cohort").alias("trader_cohort"), "is_sniper", "is_creator"
    )
    return states.join(labels, WALLET_KEY, "left").select(*FCT_TRADES)


def fct_curve_daily(
    states: DataFrame,
    swaps: DataFrame,
    wallets: DataFrame,
    meta: DataFrame,
    thresholds: Thresholds = Thresholds(),
    close: str = "max",
) -> DataFrame:
    """Velocity metrics and sniper volume (by cohort) per curve and day.

    The metrics come from the trades alone. Cohorts are joined to wallet-day sums; a wallet with a
    row for each of two creators counts for both, as in the trade fact.
    """
    return daily_fact(trader_days(states, close), swaps, wallets, meta, thresholds, close)


def daily_fact(
    days: DataFrame,
    swaps: DataFrame,
    wallets: DataFrame,
    meta: DataFrame,
    thresholds: Thresholds = Thresholds(),
    close: str = "max",
) -> DataFrame:
    """:func:`fct_curve_daily` from trader-days; ``swaps`` serve to count transactions."""
    snipers = wallets.where(F.col("behavioral_cohort") == "SNIPER").groupBy(*WALLET_KEY).agg(F.count(F.lit(1)).alias("as_sniper"))
    marked = days.join(snipers, WALLET_KEY, "left").withColumn("sniped", F.col("volume") * F.coalesce("as_sniper", F.lit(0)))
    return (
        daily_velocity(marked, swaps, meta, thresholds, close, more=[F.sum("sniped").alias("sniper_volume_base")])
        .withColumn("sniper_volume_share_pct", share_pct("sniper_volume_base", "daily_volume_base"))
        .select(*FCT_CURVE_DAILY)
    )


def dim_tokens(
    states: DataFrame,
    swaps: DataFrame,
    wallet_rows: DataFrame,
    meta: DataFrame,
    thresholds: Thresholds = Thresholds(),
    totals: str = "fact",
) -> DataFrame:
    """Every launched token with its lifetime totals and high-water marks.

    One aggregate per wallet serves trader counts, sniper statistics (by flag) and lifetime totals;
    trades are not joined to wallets. Collected base, fill and status are maxima over the life of the
    curve. Curves without trades keep zeros. ``totals='fact'`` sums amounts as in the trade fact, where
    the trades of a curve with two creators stand once for each (``wallet_rows`` are the wallet
    clusters that the fact joins); ``'states'`` sums each state once.
    """
    return token_rows(token_wallets(states), transactions(swaps, TOKEN_KEY), wallet_rows, meta, thresholds, totals)


def token_wallets(states: DataFrame) -> DataFrame:
    """What each wallet adds to its token: one mergeable row per wallet."""
    return states.groupBy(*WALLET_KEY).agg(
        F.min("block_number").alias("first_block"),
        F.min("creation_block").alias("creation_block"),
        F.sum("base_asset_amount").alias("volume"),
        F.sum("protocol_fee_amount").alias("fees"),
        F.max("cumulative_base_collected").alias("collected"),
        F.max("curve_fill_pct").alias("fill"),
        F.max("graduated").alias("graduated"),
        F.max("spot_price_after_trade").alias("price"),
    )


def merged_token_wallets(rows: DataFrame) -> DataFrame:
    """:func:`token_wallets` from partial rows of the same wallets."""
    return rows.groupBy(*WALLET_KEY).agg(
        *[F.min(c).alias(c) for c in ("first_block", "creation_block")], *[F.sum(c).alias(c) for c in ("volume", "fees")],
        *[F.max(c).alias(c) for c in ("collected", "fill", "graduated", "price")],
    )


def token_rows(
    wallets: DataFrame,
    counted: DataFrame,
    wallet_rows: DataFrame,
    meta: DataFrame,
    thresholds: Thresholds = Thresholds(),
    totals: str = "fact",
) -> DataFrame:
    """:func:`dim_tokens` from one row per wallet and the number of transactions of each token."""
    wallets = wallets.withColumn("blocks_since_curve_creation", F.col("first_block") - F.col("creation_block")).drop("creation_block")
    if totals == "fact":
        copies = wallet_rows.groupBy(*WALLET_KEY).agg(F.count(F.lit(1)).alias("copies"))
        times = F.coalesce("copies", F.lit(1))
        wallets = wallets.join(copies, WALLET_KEY, "left").withColumns({c: F.col(c) * times for c in ("volume", "fees")})
    elif totals != "states":
        raise ValueError(f"unknown totals: {totals}")
    known = F.col("trader_address").isNotNull() & F.col("token_address").isNotNull()
    sniper = is_sniper(thresholds) & known
    lifetime = wallets.groupBy(*TOKEN_KEY).agg(
        F.count("trader_address").alias("traders"),
        F.sum("volume").alias("volume"),
        F.sum("fees").alias("fees"),
        F.max("collected").alias("collected"),
        F.max("fill").alias("fill"),
        F.max("graduated").alias("graduated"),
        F.max("price").alias("price"),
        count_if(sniper).alias("snipers"),
        sum_if(sniper, "volume").alias("sniper_volume"),
    )
    zero = F.lit(0.0)
    return (
        meta.join(lifetime, TOKEN_KEY, "left")
        .join(counted, TOKEN_KEY, "left")
        .withColumns(
            {
                "total_trades": F.coalesce("tx_count", F.lit(0).cast("long")),
                "total_unique_traders": F.coalesce("traders", F.lit(0).cast("long")),
                "lifetime_volume_base": steady(F.coalesce("volume", zero), 4),
                "lifetime_protocol_fees_base": steady(F.coalesce("fees", zero), 4),
                "current_base_in_curve": steady(F.coalesce("collected", zero), 4),
                "curve_fill_pct": F.coalesce("fill", zero),
                "curve_status": status_label("graduated"),
                "all_time_high_price": rounded(F.coalesce("price", zero), 8),
                "total_snipers_detected": F.coalesce("snipers", F.lit(0).cast("long")),
                "sniper_volume_penetration_pct": share_pct("sniper_volume", "volume"),
            }
        )
        .select(*DIM_TOKENS)
    )
