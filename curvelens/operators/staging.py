"""Typed, normalised and validated inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _select(raw: DataFrame, changed: dict[str, str]) -> list[str]:
    return [f"{changed[c]} as {c}" if c in changed else c for c in raw.columns]


def _lowered(*names: str) -> dict[str, str]:
    return {name: f"lower({name})" for name in names}


def _as(dtype: str, *names: str) -> dict[str, str]:
    return {name: f"cast({name} as {dtype})" for name in names}


def stage_swaps(raw: DataFrame) -> DataFrame:
    """Swaps with a positive token amount and a non-negative base amount, plus their execution price."""
    amounts = ["base_asset_amount", "token_amount", "protocol_fee_amount", "gas_price_gwei"]
    changed = (
        _as("double", *amounts) | _as("bigint", "tx_index")
        | _lowered("token_address", "curve_address", "trader_address") | {"trade_type": "upper(trade_type)"}
    )
    return (
        raw.selectExpr(*_select(raw, changed))
        .where("token_amount > 0 and base_asset_amount >= 0")
        .selectExpr("*", "base_asset_amount / token_amount as execution_price")
    )


def stage_curve_events(raw: DataFrame) -> DataFrame:
    changed = _lowered("token_address", "curve_address", "creator_address") | _as(
        "double", "initial_token_supply", "virtual_base_reserves", "virtual_token_reserves",
        "graduation_threshold_base",
    )
    return raw.selectExpr(*_select(raw, changed))


def stage_transfers(raw: DataFrame) -> DataFrame:
    """Transfers of a positive amount between two different addresses (case ignored)."""
    changed = _as("double", "amount") | _lowered("token_address", "from_address", "to_address")
    return raw.selectExpr(*_select(raw, changed)).where("amount > 0 and from_address != to_address")


def curve_meta(curve_events: DataFrame) -> DataFrame:
    """Launch parameters: one row per CurveCreated event."""
    return curve_events.where("event_type = 'CurveCreated'").selectExpr(
        "token_address", "curve_address", "creator_address", "initial_token_supply", "virtual_base_reserves",
        "virtual_token_reserves", "graduation_threshold_base", "block_timestamp as creation_timestamp",
        "block_number as creation_block",
    )
