"""Launch data derived from a generic ``events`` table (FIXTURES.md, section 3).

purchase / click / error events become swaps, the first event of each of the 20 curves its
creation, sign-ups fee events, views token transfers. Every row of ``events`` is read; amounts are
scaled so that all cohorts, tiers and alerts occur.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CURVES = 20
WALLETS = 150

_CURVE = f"cast(get_json_object(props, '$.k') as bigint) % {CURVES}"
_HOUR = "unix_date(date(ts)) * 24L + hour(ts)"  # one-hour blocks, independent of the session time zone
_SUPPLY_COLUMNS = [
    "initial_token_supply", "virtual_base_reserves", "virtual_token_reserves", "graduation_threshold_base",
]


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/events.parquet")


def _of_type(events: DataFrame, *types: str) -> DataFrame:
    listed = ", ".join(f"'{t}'" for t in types)
    return events.where(f"event_type in ({listed})").selectExpr("*", f"{_CURVE} as c", f"{_HOUR} as block_number")


def swaps(events: DataFrame) -> DataFrame:
    """The event number is the tape index."""
    return _of_type(events, "purchase", "click", "error").selectExpr(
        "concat('0xSW_', event_id) as tx_hash",
        "block_number",
        "ts as block_timestamp",
        "concat('0xTOK_', c) as token_address",
        "concat('0xCURVE_', c) as curve_address",
        "concat('0xUSER_', user_id) as trader_address",
        "if(event_type = 'error', 'sell', 'buy') as trade_type",
        "value / 20 as base_asset_amount",
        "value * 1000 * (1 + event_id % 7) as token_amount",
        "value / 2000 as protocol_fee_amount",
        "cast(10 + event_id % 200 as double) as gas_price_gwei",
        "cast(event_id as bigint) as tx_index",
    )


def curve_events(events: DataFrame) -> DataFrame:
    # min_by over fixed-width columns keeps this a hash aggregate
    first = (
        events.selectExpr("event_id", "ts", "user_id", f"{_CURVE} as c")
        .groupBy("c")
        .agg(F.expr("min(event_id) as event_id"), F.expr("min_by(ts, event_id) as ts"),
             F.expr("min_by(user_id, event_id) as user_id"))
    )
    created = first.selectExpr(
        "concat('evt_', event_id) as event_id",
        "concat('0xEV_', event_id) as tx_hash",
        f"{_HOUR} as block_number",
        "ts as block_timestamp",
        "concat('0xTOK_', c) as token_address",
        "concat('0xCURVE_', c) as curve_address",
        "'CurveCreated' as event_type",
        "concat('0xUSER_', user_id) as creator_address",
        "5e5 * power(4, c % 5) as initial_token_supply",
        "15000D as virtual_base_reserves",
        "1.073e9D as virtual_token_reserves",
        "cast(25 + 20 * c as double) as graduation_threshold_base",
    )
    fees = _of_type(events, "signup").selectExpr(
        "concat('fee_', event_id) as event_id",
        "concat('0xEV_', event_id) as tx_hash",
        "block_number",
        "ts as block_timestamp",
        "concat('0xTOK_', c) as token_address",
        "concat('0xCURVE_', c) as curve_address",
        "'FeeCollected' as event_type",
        "concat('0xUSER_', user_id) as creator_address",
        *[f"cast(null as double) as {name}" for name in _SUPPLY_COLUMNS],
    )
    return created.unionByName(fees)


def transfers(events: DataFrame) -> DataFrame:
    return _of_type(events, "view").selectExpr(
        "concat('0xTR_', event_id) as tx_hash",
        "block_number",
        "ts as block_timestamp",
        "concat('0xTOK_', c) as token_address",
        "concat('0xUSER_', user_id) as from_address",
        f"concat('0xUSER_', event_id % {WALLETS}) as to_address",
        "value * 1000 as amount",
    )


def _wei(name: str, alias: str | None = None, scale: str = "1e18D") -> str:
    return f"cast({name} * {scale} as decimal(38, 0)) as {alias or name}"


def chain_swaps(events: DataFrame) -> DataFrame:
    """The same swaps as a decoded on-chain log in wei."""
    return swaps(events).selectExpr(
        "tx_hash as evt_tx_hash",
        "block_number as evt_block_number",
        "block_timestamp as evt_block_time",
        "curve_address as contract_address",
        "token_address",
        "trader_address as trader",
        "trade_type = 'buy' as is_buy",
        _wei("base_asset_amount"),
        _wei("token_amount"),
        _wei("protocol_fee_amount", "fee_amount"),
        _wei("gas_price_gwei", "gas_price", "1e9D"),
    )


def chain_curves(events: DataFrame) -> DataFrame:
    return (
        curve_events(events)
        .where("event_type = 'CurveCreated'")
        .selectExpr(
            "curve_address as contract_address",
            "token_address",
            "creator_address as creator",
            "block_number as evt_block_number",
            "block_timestamp as evt_block_time",
            *[_wei(name) for name in _SUPPLY_COLUMNS],
        )
    )


class EventTape:
    """The raw tables of an ``events`` folder, each built when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self._events = read_events(spark, folder)

    swaps = cached_property(lambda self: swaps(self._events))
    curve_events = cached_property(lambda self: curve_events(self._events))
    transfers = cached_property(lambda self: transfers(self._events))
    chain_swaps = cached_property(lambda self: chain_swaps(self._events))
    chain_curves = cached_property(lambda self: chain_curves(self._events))
