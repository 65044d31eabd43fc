"""Decoded on-chain logs (wei integers, ``evt_*`` names) brought to plain units and names."""

from __future__ import annotations

from pyspark.sql import DataFrame

WEI = 1e18
GWEI = 1e9


def _units(name: str, alias: str | None = None, scale: float = WEI) -> str:
    """Integer amount as double. Strings are accepted too: 256-bit amounts do not fit DECIMAL(38,0)."""
    return f"cast({name} as double) / {scale}D as {alias or name}"


def decode_swaps(chain_swaps: DataFrame) -> DataFrame:
    return chain_swaps.selectExpr(
        "evt_tx_hash as tx_hash",
        "evt_block_number as block_number",
        "evt_block_time as block_time",
        "contract_address as curve_address",
        "token_address",
        "trader as trader_address",
        "is_buy",
        _units("base_asset_amount"),
        _units("token_amount"),
        _units("fee_amount", "protocol_fee"),
        _units("gas_price", "gas_price_gwei", GWEI),
    )


def decode_curves(chain_curves: DataFrame) -> DataFrame:
    amounts = ["initial_token_supply", "virtual_base_reserves", "virtual_token_reserves", "graduation_threshold_base"]
    return chain_curves.selectExpr(
        "contract_address as curve_address",
        "token_address",
        "creator as creator_address",
        "evt_block_number as creation_block",
        "evt_block_time as creation_time",
        *[_units(a) for a in amounts],
    )


def to_raw_swaps(decoded: DataFrame) -> DataFrame:
    """Decoded swaps under the raw swap contract, for the staging-based pipeline.

    The log carries no transaction index, so trades of one block are ordered by transaction hash.
    """
    return decoded.selectExpr(
        "tx_hash", "block_number", "block_time as block_timestamp", "token_address", "curve_address",
        "trader_address", "if(is_buy, 'BUY', 'SELL') as trade_type", "base_asset_amount", "token_amount",
        "protocol_fee as protocol_fee_amount", "gas_price_gwei", "cast(null as bigint) as tx_index",
    )


def to_raw_curve_events(decoded: DataFrame) -> DataFrame:
    return decoded.selectExpr(
        "concat('created_', curve_address) as event_id", "cast(null as string) as tx_hash",
        "creation_block as block_number", "creation_time as block_timestamp", "token_address", "curve_address",
        "'CurveCreated' as event_type", "creator_address", "initial_token_supply", "virtual_base_reserves",
        "virtual_token_reserves", "graduation_threshold_base",
    )
