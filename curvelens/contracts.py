"""Table contracts (schemas, output columns, grains) and the tunable thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in columns.items()])


_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampNTZType()
_WEI = T.DecimalType(38, 0)

# --------------------------------------------------------------------------- raw inputs

RAW_SWAPS = _schema(
    tx_hash=_S, block_number=_L, block_timestamp=_TS, token_address=_S, curve_address=_S, trader_address=_S,
    trade_type=_S, base_asset_amount=_D, token_amount=_D, protocol_fee_amount=_D, gas_price_gwei=_D, tx_index=_L,
)

RAW_CURVE_EVENTS = _schema(
    event_id=_S, tx_hash=_S, block_number=_L, block_timestamp=_TS, token_address=_S, curve_address=_S,
    event_type=_S, creator_address=_S, initial_token_supply=_D, virtual_base_reserves=_D,
    virtual_token_reserves=_D, graduation_threshold_base=_D,
)

RAW_TRANSFERS = _schema(
    tx_hash=_S, block_number=_L, block_timestamp=_TS, token_address=_S, from_address=_S, to_address=_S, amount=_D,
)

# Decoded on-chain logs: integer amounts in wei.
CHAIN_SWAPS = _schema(
    evt_tx_hash=_S, evt_block_number=_L, evt_block_time=_TS, contract_address=_S, token_address=_S, trader=_S,
    is_buy=T.BooleanType(), base_asset_amount=_WEI, token_amount=_WEI, fee_amount=_WEI, gas_price=_WEI,
)

CHAIN_CURVES = _schema(
    contract_address=_S, token_address=_S, creator=_S, evt_block_number=_L, evt_block_time=_TS,
    initial_token_supply=_WEI, virtual_base_reserves=_WEI, virtual_token_reserves=_WEI,
    graduation_threshold_base=_WEI,
)

# --------------------------------------------------------------------------- output columns
# Column names and order of the published tables.

CURVE_STATE = """
tx_hash block_number block_timestamp token_address curve_address creator_address creation_timestamp creation_block
trader_address trade_type base_asset_amount token_amount protocol_fee_amount gas_price_gwei tx_index execution_price
spot_price_before_trade spot_price_after_trade slippage_pct cumulative_base_collected graduation_threshold_base
curve_fill_pct curve_status
""".split()

WALLET_CLUSTERS = """
token_address curve_address trader_address first_trade_timestamp last_trade_timestamp first_trade_block
curve_creation_block blocks_since_curve_creation buy_count sell_count total_base_invested total_base_realized
current_token_balance max_gas_gwei avg_gas_gwei creator_address is_creator is_sniper is_accumulator
behavioral_cohort net_realized_pnl_base
""".split()

TOKEN_VELOCITY = """
token_address curve_address trade_date tx_count unique_active_traders daily_volume_base daily_tokens_traded
avg_daily_price close_price end_of_day_curve_fill_pct curve_status total_token_supply implied_market_cap_base
turnover_rate_pct token_velocity_index velocity_health_tier
""".split()

FCT_TRADES = """
tx_hash block_number block_timestamp token_address curve_address trader_address trader_cohort is_sniper is_creator
trade_type base_asset_amount token_amount protocol_fee_amount gas_price_gwei tx_index execution_price
spot_price_after_trade slippage_pct cumulative_base_collected curve_fill_pct curve_status
""".split()

FCT_CURVE_DAILY = """
token_address curve_address trade_date tx_count unique_active_traders daily_volume_base sniper_volume_base
sniper_volume_share_pct daily_tokens_traded avg_daily_price close_price implied_market_cap_base
end_of_day_curve_fill_pct token_velocity_index turnover_rate_pct velocity_health_tier curve_status
""".split()

DIM_WALLETS = """
trader_address unique_curves_traded unique_tokens_traded wallet_first_active_time wallet_last_active_time
lifetime_buy_count lifetime_sell_count lifetime_base_invested lifetime_base_realized lifetime_net_pnl_base
ever_sniped is_protocol_or_dev primary_wallet_segment profitability_status
""".split()

DIM_TOKENS = """
token_address curve_address creator_address creation_timestamp creation_block initial_token_supply
graduation_threshold_base total_trades total_unique_traders lifetime_volume_base lifetime_protocol_fees_base
current_base_in_curve curve_fill_pct curve_status all_time_high_price total_snipers_detected
sniper_volume_penetration_pct
""".split()

CURVE_MONITOR = """
token_address curve_address creator_address creation_time last_trade_time curve_age_minutes spot_price_base
total_base_locked graduation_target_base base_remaining_to_graduate curve_fill_pct lifecycle_status
""".split()

SUPPLY_CONCENTRATION = """
token_address curve_address unique_holders sniper_count top_10_supply_pct concentration_hhi distribution_health
""".split()

VELOCITY_PROFILE = """
trade_date token_address curve_address tx_count active_traders_count volume_base market_cap_base turnover_pct
token_velocity velocity_profile
""".split()

ALERTS = "alert_type severity token_address curve_address event_ts tx_hash metric_value threshold".split()

# Declared grains of raw tables and marts.
GRAINS = {
    "raw_swaps": ["tx_hash"],
    "raw_curve_events": ["event_id"],
    "fct_trades": ["tx_hash"],
    "fct_curve_daily": ["curve_address", "trade_date"],
    "dim_wallets": ["trader_address"],
    "dim_tokens": ["token_address"],
}


# --------------------------------------------------------------------------- thresholds

@dataclass(frozen=True)
class Thresholds:
    """Limits used by the classifications; the defaults are the published ones (fixed values)."""

    # wallet cohorts per curve
    sniper_blocks: int = 2
    whale_invested: float = 10.0
    swing_buys: int = 2
    swing_sells: int = 2
    # lifetime wallet segments
    whale_lifetime_invested: float = 25.0
    frequent_buys: int = 5
    frequent_sells: int = 5
    # daily velocity tiers
    velocity_hyper: float = 2.0
    velocity_healthy: float = 0.5
    velocity_moderate: float = 0.1
    # curve lifecycle bands, percent filled
    graduated_fill: float = 100.0
    high_fill: float = 80.0
    accumulating_fill: float = 30.0
    # forensic cohorts
    mev_blocks: int = 1
    early_bot_blocks: int = 5
    whale_supply_share: float = 0.02
    forensic_frequent_buys: int = 2
    forensic_frequent_sells: int = 2
    top_holders: int = 10
    # concentration bands, Herfindahl-Hirschman index
    hhi_high: float = 2500.0
    hhi_moderate: float = 1500.0
    # sniper penetration, percent of supply
    sniper_orange: float = 25.0
    sniper_emergency: float = 40.0
    sniper_hijack: float = 35.0
    # creator sales
    dump_share_of_allocation: float = 0.10
    dump_fill_limit: float = 80.0
    dev_dump_supply_pct: float = 5.0
    # other alerts
    imminent_fill: float = 90.0
    whale_inflow_share: float = 0.15
    fee_spike_factor: float = 3.0
    fee_spike_hours: int = 168
    # dashboards
    depth_orders: tuple[float, ...] = (0.5, 2.0, 10.0)
    eta_window_minutes: int = 15
    retention_days: tuple[int, ...] = (1, 3, 7)


# A stricter published variant with one whale limit for cohort and segment.
STRICT_WHALES = Thresholds(whale_invested=20.0, whale_lifetime_invested=20.0)
