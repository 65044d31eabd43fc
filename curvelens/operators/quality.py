"""Data-quality checks. Each returns one row: check_name, rows_tested, violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvelens.contracts import GRAINS, Thresholds
from curvelens.functions.scalars import count_if
from curvelens.operators.skew import spread_join
from curvelens.operators.wallets import is_sniper


def _report(df: DataFrame, name: str, violated: Column) -> DataFrame:
    return df.agg(F.count("*").alias("rows_tested"), count_if(violated).alias("violations")).select(
        F.lit(name).alias("check_name"), "rows_tested", "violations"
    )


def check_graduation(dim_tokens: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """A token is GRADUATED exactly when its fill reached 100 %, and no fill leaves [0, 100]."""
    fill = F.col("curve_fill_pct")
    agree = (fill >= thresholds.graduated_fill) == (F.col("curve_status") == "GRADUATED")
    return _report(dim_tokens, "graduation", ~agree | (fill < 0) | (fill > 100))


def check_snipers(wallets: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Wallets of blocks 0 to 2 carry the flag, and the cohort SNIPER unless they are the creator."""
    early = is_sniper(thresholds)
    wrong = (F.col("is_sniper") != 1) | ~F.col("behavioral_cohort").isin("SNIPER", "DEV_TEAM")
    return _report(wallets.where(early), "snipers", wrong)


def check_whales(dim_wallets: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Wallets above the lifetime limit that are neither creator nor sniper are segmented WHALE."""
    large = (
        (F.col("lifetime_base_invested") >= thresholds.whale_lifetime_invested)
        & (F.col("is_protocol_or_dev") == 0) & (F.col("ever_sniped") == 0)
    )
    # the stored amount is rounded: within half a unit of the limit the segment may go either way
    edge = F.abs(F.col("lifetime_base_invested") - thresholds.whale_lifetime_invested) < 1e-4
    return _report(dim_wallets.where(large), "whales", (F.col("primary_wallet_segment") != "WHALE") & ~edge)


def check_velocity(token_velocity: DataFrame) -> DataFrame:
    """Velocity and turnover exist and are not negative."""
    v, t = F.col("token_velocity_index"), F.col("turnover_rate_pct")
    return _report(token_velocity, "velocity", v.isNull() | t.isNull() | (v < 0) | (t < 0))


def check_wallet_grain(swaps: DataFrame, meta: DataFrame, dim_wallets: DataFrame) -> DataFrame:
    """Every trader of a known curve has one row in the wallet dimension."""
    pairs = swaps.select("curve_address", "trader_address").distinct()
    known = meta.select("curve_address").distinct()
    traders = (
        spread_join(pairs, known, ["curve_address"], by="trader_address")
        .select("trader_address").distinct()
        .select("trader_address", F.lit(1).alias("expected"))
    )
    rows = dim_wallets.groupBy("trader_address").agg(F.count("*").alias("rows"))
    return _report(
        traders.join(rows, traders.trader_address.eqNullSafe(rows.trader_address), "full"),
        "wallet_grain",
        F.col("expected").isNull() | F.col("rows").isNull() | (F.col("rows") > 1),
    )


def check_grain(tables: dict[str, DataFrame], grains: dict[str, list[str]] = GRAINS) -> DataFrame:
    """Surplus rows per declared grain, one row per table.

    Counting keys is a map-side combined aggregate, so even one key with most of the rows is cheap.
    """
    def one(name: str) -> DataFrame:
        n = F.col("n")
        return (
            tables[name].groupBy(*grains[name]).agg(F.count("*").alias("n"))
            .agg(
                F.coalesce(F.sum(n), F.lit(0).cast("long")).alias("rows_tested"),
                F.coalesce(F.sum(n - 1), F.lit(0).cast("long")).alias("violations"),
            )
            .select(F.lit(f"grain_{name}").alias("check_name"), "rows_tested", "violations")
        )

    return reduce(DataFrame.unionByName, [one(name) for name in tables])
