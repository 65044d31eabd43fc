"""Alert rows. Delivery to chat channels is left to whoever reads the table or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvelens.contracts import ALERTS, Thresholds
from curvelens.functions.scalars import from_minute_index, hour_index, is_buy, is_sell, position, ratio, rounded


def _alert(kind: str, severity: str, metric: Column, threshold: Column | float) -> Column:
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.struct(
        F.lit(kind).alias("alert_type"), F.lit(severity).alias("severity"),
        metric.cast("double").alias("metric_value"), limit.cast("double").alias("threshold"),
    )


def trade_alerts(tracked_states: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    return keyed_trade_alerts(tracked_states, thresholds).select(*ALERTS)


def keyed_trade_alerts(tracked_states: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Whale inflow, dev dumping and imminent graduation, in one pass over the trades.

    * whale inflow: a buy above 15 % of what remained to collect before it;
    * dev dumping: the sale that takes the creator over 5 % of supply on a curve not graduated;
    * imminent graduation: the first trade that lifts the fill to 90 %.

    ``alert_key`` names a trade of which each raises its own alert; it is empty where a curve raises one.
    """
    t = thresholds
    base, supply = F.col("base_asset_amount"), F.col("initial_token_supply")
    remaining = rounded(F.col("graduation_threshold_base") - F.col("base_before"), 9)  # free of summing noise
    inflow_limit = remaining * t.whale_inflow_share
    whale = is_buy() & (remaining > 0) & (base > inflow_limit)
    sold, sold_before = F.col("creator_sold_after"), F.col("creator_sold_before")
    dump_limit = supply * t.dev_dump_supply_pct / 100.0
    dump = (
        F.col("by_creator") & is_sell() & (F.col("graduated") == 0)
        & (sold > dump_limit) & (sold_before <= dump_limit)
    )
    fill = F.col("curve_fill_pct")
    reaches = (fill >= t.imminent_fill) & (F.coalesce("fill_before_pct", F.lit(0.0)) < t.imminent_fill)
    candidates = F.array(
        F.when(whale, _alert("WHALE_INFLOW", "Medium", base, inflow_limit)),
        F.when(dump, _alert("DEV_DUMPING", "Critical", ratio(sold, supply) * 100.0, t.dev_dump_supply_pct)),
        F.when(reaches, _alert("IMMINENT_GRADUATION", "Info", fill, t.imminent_fill)),
    )
    raised = tracked_states.where(whale | dump | reaches).select(
        "token_address", "curve_address", F.col("block_timestamp").alias("event_ts"), "tx_hash", "block_number",
        "tx_index", "trader_address", "base_asset_amount", "token_amount", F.explode(F.array_compact(candidates)).alias("alert"),
    )
    # A fill can cross 90 % again after a sale; only the first crossing of a curve counts. Whale rows
    # carry their trade in the key, so each raises its alert and they are never gathered by curve.
    trade = F.concat_ws("|", "block_number", "tx_index", "tx_hash", "trader_address", "base_asset_amount", "token_amount")
    once = F.when(F.col("alert.alert_type") == "WHALE_INFLOW", trade).otherwise(F.lit(""))
    first = Window.partitionBy("curve_address", "alert.alert_type", "alert_key").orderBy(position())
    return (
        raised.withColumn("alert_key", once)
        .withColumn("nth", F.row_number().over(first))
        .where(F.col("nth") == 1)
        .select("alert.*", "token_address", "curve_address", "event_ts", "tx_hash", "alert_key")
        .select(*ALERTS, "alert_key")
    )


def sniper_hijack(penetration: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Curves where blocks 0 to 2 bought more than 35 % of supply; no single transaction is to blame."""
    return penetration.where(F.col("penetration_pct") > thresholds.sniper_hijack).select(
        F.lit("SNIPER_HIJACK").alias("alert_type"), F.lit("High").alias("severity"), "token_address",
        "curve_address", F.col("last_early_buy").alias("event_ts"), F.lit(None).cast("string").alias("tx_hash"),
        F.col("penetration_pct").alias("metric_value"), F.lit(thresholds.sniper_hijack).alias("threshold"),
    )


def alerts(tracked_states: DataFrame, penetration: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    return trade_alerts(tracked_states, thresholds).unionByName(sniper_hijack(penetration, thresholds))


def hourly_fees(swaps: DataFrame) -> DataFrame:
    return swaps.groupBy(hour_index("block_timestamp").alias("hour")).agg(
        F.sum("protocol_fee_amount").alias("hourly_fees")
    )


def fee_spike(hours: DataFrame, thresholds: Thresholds = Thresholds(), since: int | None = None) -> DataFrame:
    """Hours (from :func:`hourly_fees`) whose fees exceed three times the mean of the 168 before them.

    Hours without trades count as zero; the first 168 hours raise nothing. The window holds one row
    per hour of the tape (under 9,000 a year), whatever the number of trades. ``since`` is the first hour
    of the tape where ``hours`` begin later.
    """
    n = thresholds.fee_spike_hours
    tape = Window.orderBy("hour")
    mean = F.coalesce(F.sum("hourly_fees").over(tape.rangeBetween(-n, -1)), F.lit(0.0)) / n
    first = F.min("hour").over(tape.rowsBetween(Window.unboundedPreceding, 0)) if since is None else F.lit(since)
    history = F.col("hour") - first
    return (
        hours.withColumns({"trailing_mean": mean, "history": history})
        .select(
            from_minute_index(F.col("hour") * 60).alias("hour_start"), "hourly_fees", "trailing_mean",
            ((F.col("history") >= n) & (F.col("hourly_fees") > F.col("trailing_mean") * thresholds.fee_spike_factor))
            .alias("is_spike"),
        )
    )


def fee_alerts(spikes: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """The spikes of :func:`fee_spike` as alert rows."""
    text = F.lit(None).cast("string")
    return spikes.where("is_spike").select(
        F.lit("FEE_SPIKE").alias("alert_type"), F.lit("Info").alias("severity"), text.alias("token_address"),
        text.alias("curve_address"), F.col("hour_start").alias("event_ts"), text.alias("tx_hash"),
        F.col("hourly_fees").alias("metric_value"),
        (F.col("trailing_mean") * thresholds.fee_spike_factor).alias("threshold"),
    )
