"""Curve state per trade and current state per curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelens.contracts import CURVE_MONITOR, CURVE_STATE, Thresholds
from curvelens.functions.scalars import (
    fill_pct, first_match, flag, from_minute_index, is_buy, is_sell, minute_index, minutes_between, position, ratio,
    rounded, signed, spot_price,
)
from curvelens.operators.ranks import ranked
from curvelens.operators.running import Attached, SliceSpec, running_totals
from curvelens.operators.skew import spread_join

# Running totals of a curve that the streaming job carries from batch to batch.
RUNNING = ["base", "tokens", "creator_balance", "creator_sold"]


# --------------------------------------------------------------------------- per trade

def _launches(meta: DataFrame) -> DataFrame:
    """Launch parameters by curve; ``launch_copy`` numbers repeated CurveCreated events of one curve."""
    by_curve = Window.partitionBy("curve_address").orderBy("creation_block", "creation_timestamp", "token_address")
    return meta.withColumn("launch_copy", F.row_number().over(by_curve)).drop("token_address")


def trade_states(
    swaps: DataFrame,
    meta: DataFrame,
    spec: SliceSpec = SliceSpec(),
    thresholds: Thresholds = Thresholds(),
    track_creator: bool = False,
    status: str = "instant",
    opening: DataFrame | None = None,
    only: str | None = None,
) -> DataFrame:
    """Staged swaps with the reserves, prices, fill and status of their curve after each of them.

    The launch parameters are joined by curve after the running sums, so swaps on unknown curves
    drop out and a curve created twice yields its trades twice. ``track_creator`` adds the
    creator's running balance and sales. ``status='sticky'`` keeps a curve graduated after its first
    graduation; the default follows each trade. ``opening`` holds one row of running totals per
    curve (``base``, ``tokens``, ...) from which the trades continue, as in the streaming job.
    ``only`` leaves out slices of the tape without trades of interest: ``'creator'`` keeps those with a trade of the
    creator (and needs ``track_creator``), ``'graduated'`` those in which the curve may be full.
    """
    if only not in (None, "creator", "graduated") or only == "creator" and not track_creator or only and opening is not None:
        raise ValueError(f"unknown or unfit choice of slices: {only}")
    launches = _launches(meta)
    if opening is not None:
        launches = launches.join(opening.withColumn("opened", F.lit(True)).withColumnsRenamed(
            {name: f"opening_{name}" for name in RUNNING}
        ).select("curve_address", "opened", *[f"opening_{name}" for name in RUNNING]), "curve_address", "left")
    attached = Attached(launches, "launch_copy")
    if track_creator:
        own = F.when(F.col("trader_address") == F.col("creator_address"), F.col("token_amount")).otherwise(F.lit(0.0))
        creators = meta.selectExpr("curve_address", "creator_address", "creator_address as trader_address").distinct()
        attached = Attached(
            launches, "launch_copy",
            deltas={
                "creator_balance": signed(own),
                "creator_sold": F.when(is_sell(), own).otherwise(F.lit(0.0)),
            },
            contributors=spread_join(swaps, creators, ["curve_address", "trader_address"], by="tx_hash"),
            link=("creator_address",),
        )
    deltas = {"base": signed("base_asset_amount"), "tokens": signed("token_amount")}
    # the most that the curve can hold inside the slice, free of summing noise
    most = (F.col("_sum_base") + F.col("_gross_base")) * (1 + 1e-9) + 1e-9
    kept = {
        "creator": F.col("_contributes"),
        "graduated": (fill_pct(most, "graduation_threshold_base") >= thresholds.graduated_fill)
        | (F.col("graduation_threshold_base") < 0),
    }.get(only)
    walked = running_totals(swaps, deltas, spec, attached=attached, only=kept).withColumnRenamed("first_of_key", "first_of_curve")
    if opening is not None:
        names = RUNNING if track_creator else RUNNING[:2]
        walked = walked.withColumns(
            {"first_of_curve": F.col("first_of_curve") & F.col("opened").isNull()}
            | {
                f"{name}_{end}": F.col(f"{name}_{end}") + F.coalesce(f"opening_{name}", F.lit(0.0))
                for name in names
                for end in ("before", "after")
            }
        ).drop("opened", *[f"opening_{name}" for name in RUNNING])
    if track_creator:
        walked = walked.withColumn("by_creator", F.col("trader_address").eqNullSafe(F.col("creator_address")))
    x, y = F.col("virtual_base_reserves"), F.col("virtual_token_reserves")
    spot_before = spot_price(x + F.col("base_before"), y - F.col("tokens_before"))
    states = walked.withColumns(
        {
            "base_reserve": x + F.col("base_after"),
            "token_reserve": y - F.col("tokens_after"),
            "cumulative_base_collected": F.col("base_after"),
            "spot_price_before_trade": F.when(~F.col("first_of_curve"), spot_before),
            "curve_fill_pct": fill_pct("base_after", "graduation_threshold_base"),
            "fill_before_pct": F.when(
                ~F.col("first_of_curve"), fill_pct("base_before", "graduation_threshold_base")
            ),
        }
    )
    before = F.col("spot_price_before_trade")
    gap = F.abs(F.col("execution_price") - before)
    states = states.withColumns(
        {
            "spot_price_after_trade": spot_price(F.col("base_reserve"), F.col("token_reserve")),
            "slippage_pct": F.when(before > 0, rounded(gap / before * 100.0, 4)).otherwise(F.lit(0.0)),
            "graduated": flag(F.col("curve_fill_pct") >= thresholds.graduated_fill),
        }
    )
    if status == "sticky":
        since = states.where(F.col("graduated") == 1).groupBy("curve_address").agg(F.min(position()).alias("since"))
        states = states.join(since, "curve_address", "left").withColumn(
            "graduated", flag(position() >= F.col("since"))
        )
    return states.withColumn("curve_status", status_label("graduated"))


def status_label(graduated: str) -> Column:
    return F.when(F.col(graduated) == 1, "GRADUATED").otherwise("ACTIVE")


def curve_state(states: DataFrame) -> DataFrame:
    return states.select(*CURVE_STATE)


def curve_reserves(states: DataFrame) -> DataFrame:
    """Virtual reserves after each trade and their product."""
    return states.select(
        "tx_hash", "curve_address", "block_number", "tx_index", "base_reserve", "token_reserve",
        (F.col("base_reserve") * F.col("token_reserve")).alias("invariant_k"), "spot_price_after_trade",
    )


def time_to_graduation(states: DataFrame) -> DataFrame:
    """Completed minutes from launch to the first trade that fills the curve."""
    return (
        states.where(F.col("graduated") == 1)
        .groupBy("token_address", "curve_address")
        .agg(
            F.min("creation_timestamp").alias("creation_timestamp"),
            F.min("block_timestamp").alias("graduated_at"),
        )
        .withColumn("minutes_to_graduate", minutes_between("creation_timestamp", "graduated_at"))
    )


# --------------------------------------------------------------------------- current state

def current_reserves(swaps: DataFrame, meta: DataFrame) -> DataFrame:
    """Reserves of every traded curve after its last trade.

    The last running sum of a curve is the sum of all its deltas, so this is one map-side combined
    aggregate: no window, and a hot curve costs no more than any other.
    """
    totals = swaps.groupBy("curve_address").agg(
        F.sum(signed("base_asset_amount")).alias("base_collected"),
        F.sum(signed("token_amount")).alias("tokens_sold"),
        F.max("block_timestamp").alias("last_trade_time"),
    )
    return totals.join(meta, "curve_address").withColumns(
        {
            "base_reserve": F.col("virtual_base_reserves") + F.col("base_collected"),
            "token_reserve": F.col("virtual_token_reserves") - F.col("tokens_sold"),
            "curve_fill_pct": fill_pct("base_collected", "graduation_threshold_base"),
        }
    )


def curve_monitor(log: DataFrame, curves: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Latest state of every curve from the decoded on-chain logs, fullest first."""
    buy = F.col("is_buy")
    totals = log.groupBy("curve_address").agg(
        F.sum(signed("base_asset_amount", buy)).alias("base"),
        F.sum(signed("token_amount", buy)).alias("tokens"),
        F.max("block_time").alias("last_trade_time"),
    )
    first_launch = Window.partitionBy("curve_address").orderBy("creation_time", "token_address")
    launches = curves.withColumn("_nth", F.row_number().over(first_launch)).where(F.col("_nth") == 1)
    threshold = F.col("graduation_threshold_base")
    price = spot_price(F.col("virtual_base_reserves") + F.col("base"), F.col("virtual_token_reserves") - F.col("tokens"))
    fill = F.col("curve_fill_pct")
    return (
        totals.join(launches, "curve_address")
        # on this engine's dialect a missing threshold leaves the fill unknown
        .withColumn("curve_fill_pct", F.when(F.nullif(threshold, F.lit(0.0)).isNotNull(), fill_pct("base", threshold)))
        .withColumns(
            {
                "curve_age_minutes": minutes_between("creation_time", "last_trade_time"),
                "spot_price_base": rounded(price, 8),
                "total_base_locked": rounded("base", 4),
                "graduation_target_base": rounded(threshold, 4),
                "base_remaining_to_graduate": rounded(threshold - F.col("base"), 4),
                "lifecycle_status": first_match(
                    [
                        (fill >= thresholds.graduated_fill, "GRADUATED_TO_DEX"),
                        (fill >= thresholds.high_fill, "HIGH_GRADUATION_VELOCITY"),
                        (fill >= thresholds.accumulating_fill, "ACCUMULATING"),
                    ],
                    "EARLY_STAGE",
                ),
            }
        )
        .select(*CURVE_MONITOR)
        .orderBy(F.desc("curve_fill_pct"), F.desc("total_base_locked"), "curve_address")
    )


def graduation_radar(monitor: DataFrame) -> DataFrame:
    """Curves close to graduation: the highest band below 100 %."""
    return monitor.where(F.col("lifecycle_status") == "HIGH_GRADUATION_VELOCITY").select(
        "token_address", "curve_address", "curve_fill_pct", "total_base_locked", "base_remaining_to_graduate",
        "last_trade_time",
    )


def depth_matrix(swaps: DataFrame, meta: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Expected outcome of buy orders of a few sizes against each curve (x*y = k, fees ignored)."""
    x, y, d = F.col("base_reserve"), F.col("token_reserve"), F.col("order_base")
    sizes = F.array(*[F.lit(size) for size in thresholds.depth_orders])
    return (
        current_reserves(swaps, meta)
        .withColumn("order_base", F.explode(sizes))
        .select(
            "token_address", "curve_address", "order_base", "base_reserve", "token_reserve",
            ratio(y * d, x + d).alias("tokens_out"),
            ratio(x + d, y).alias("average_price"),
            rounded(ratio(d, x) * 100.0, 4).alias("slippage_pct"),
        )
    )


def graduation_eta(swaps: DataFrame, meta: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Forecast of minutes to graduation at the end of every minute with trades.

    Inflow is net (buys less sells) over the last 15 minute buckets. The estimate is 0 once nothing
    remains to collect and NULL while the curve is not filling. Trades are first summed per curve
    and minute, so the windows run over minutes and do not grow with the trade count.
    """
    width = thresholds.eta_window_minutes
    minutes = (
        swaps.groupBy("curve_address", minute_index("block_timestamp").alias("minute"))
        .agg(F.sum(signed("base_asset_amount")).alias("net"))
    )
    tape = Window.partitionBy("curve_address").orderBy("minute")
    # Running sums of doubles leave noise near zero; nine places remove it from the sign tests.
    remaining = rounded(F.col("graduation_threshold_base") - F.col("collected"), 9)
    inflow = rounded("inflow", 9)
    rate = inflow / width
    return (
        minutes.withColumns(
            {
                "collected": F.sum("net").over(tape.rowsBetween(Window.unboundedPreceding, 0)),
                "inflow": F.sum("net").over(tape.rangeBetween(-(width - 1), 0)),
            }
        )
        .join(meta, "curve_address")
        .select(
            "token_address", "curve_address", from_minute_index("minute").alias("minute_start"),
            F.col("collected").alias("base_collected"), remaining.alias("base_remaining"),
            rate.alias("inflow_per_minute"),
            F.when(remaining <= 0, F.lit(0.0)).when(inflow > 0, remaining / rate).alias("est_minutes_to_graduate"),
        )
    )


def inflow_15m(swaps: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Net and gross inflow per curve in windows of 15 minutes that start every minute."""
    window = F.window("block_timestamp", f"{thresholds.eta_window_minutes} minutes", "1 minute")
    minutes = (
        swaps.groupBy("curve_address", F.date_trunc("minute", "block_timestamp").cast("timestamp_ntz").alias("block_timestamp"))
        .agg(
            F.sum(signed("base_asset_amount")).alias("net"),
            F.sum("base_asset_amount").alias("gross"),
            F.count("*").alias("n"),
        )
    )
    return (
        minutes.groupBy("curve_address", window.alias("w"))
        .agg(F.sum("net").alias("net_inflow_base"), F.sum("gross").alias("volume_base"), F.sum("n").alias("trades"))
        .select("curve_address", F.col("w.start").alias("window_start"), "net_inflow_base", "volume_base", "trades")
    )


def fill_leaderboard(swaps: DataFrame, meta: DataFrame, minutes: int = 1440, top: int | None = None) -> DataFrame:
    """Curves ranked by how much they filled over the last ``minutes`` of the tape; the first ``top`` if given.

    Ranks come from counts by gain and by the beginning of the address. Gains have two decimals between -100 and
    100, so at most 20,001 counts are summed up in one place.
    """
    as_of = swaps.agg(F.max("block_timestamp")).scalar()
    recent = F.col("block_timestamp") > as_of - F.make_dt_interval(mins=F.lit(minutes))
    net = signed("base_asset_amount")
    now = fill_pct("collected", "graduation_threshold_base")
    then = fill_pct(F.col("collected") - F.col("gained"), "graduation_threshold_base")
    gain = rounded(now - then, 2)
    gains = (
        swaps.groupBy("curve_address")
        .agg(F.sum(net).alias("collected"), F.sum(F.when(recent, net).otherwise(F.lit(0.0))).alias("gained"))
        .join(meta, "curve_address")
        .select(
            "token_address", "curve_address", now.alias("curve_fill_pct"),
            gain.alias("fill_gain_pct"), rounded(gain / minutes, 6).alias("fill_pct_per_minute"),
        )
    )
    buckets = [-F.col("fill_gain_pct"), F.substring("curve_address", 1, 5)]
    board = ranked(gains, [], buckets, [F.col("curve_address").asc()], "position")
    return board.where(F.col("position") <= top) if top else board
