"""Hand-made launches and trades, and helpers to build tables of them."""

from datetime import datetime, timedelta

from curvelens import RawTables
from curvelens.contracts import RAW_CURVE_EVENTS, RAW_SWAPS, RAW_TRANSFERS

T0 = datetime(2026, 9, 10, 12, 0, 0)


def created(token, creator, block, after, n, **change):
    row = dict(
        event_id=f"evt_{n}", tx_hash=f"0x10{n}", block_number=block, block_timestamp=T0 + after,
        token_address=f"0x{token}", curve_address=f"0xcurve_{token}", event_type="CurveCreated",
        creator_address=creator, initial_token_supply=1e9, virtual_base_reserves=30.0,
        virtual_token_reserves=1.073e9, graduation_threshold_base=85.0,
    )
    return row | change


def swap(n, block, after, token, trader, kind, base, tokens, gas=30.0, index=1, **change):
    row = dict(
        tx_hash=f"0xsw_{n}", block_number=block, block_timestamp=T0 + after, token_address=f"0x{token}",
        curve_address=f"0xcurve_{token}", trader_address=trader, trade_type=kind, base_asset_amount=float(base),
        token_amount=float(tokens), protocol_fee_amount=base / 100.0, gas_price_gwei=float(gas), tx_index=index,
    )
    return row | change


def _min(n):
    return timedelta(minutes=n)


# Two launches, nine swaps (FIXTURES.md, section 2).
LAUNCHES = [
    created("nova", "0xcreator_alice", 1000, _min(0), 1),
    created("phantom", "0xcreator_bob", 2000, _min(120), 2),
]
SWAPS = [
    swap(1, 1001, timedelta(seconds=12), "nova", "0xsniper_1", "BUY", 10, 150e6, 150),
    swap(2, 1002, timedelta(seconds=24), "nova", "0xsniper_2", "BUY", 15, 200e6, 180),
    swap(3, 1020, _min(5), "nova", "0xretail_1", "BUY", 2, 25e6, 30, index=2),
    swap(4, 1040, _min(10), "nova", "0xretail_2", "BUY", 3, 35e6),
    swap(5, 1060, _min(15), "nova", "0xsniper_1", "SELL", 8, 80e6, 40),
    swap(6, 1100, _min(60), "nova", "0xwhale_1", "BUY", 65, 300e6, 50),
    swap(7, 2001, timedelta(hours=2, seconds=12), "phantom", "0xsniper_1", "BUY", 12, 180e6, 140),
    swap(8, 2050, _min(135), "phantom", "0xretail_3", "BUY", 5, 60e6),
    swap(9, 2100, _min(165), "phantom", "0xcreator_bob", "BUY", 20, 220e6, 35),
]


def raw_tables(spark, swaps, launches, transfers=()):
    def frame(rows, schema):
        return spark.createDataFrame([[r[f] for f in schema.names] for r in rows], schema)

    return RawTables(
        swaps=frame(swaps, RAW_SWAPS), curve_events=frame(launches, RAW_CURVE_EVENTS),
        transfers=frame(list(transfers), RAW_TRANSFERS), **chain_tables(spark, swaps, launches),
    )


def chain_tables(spark, swaps, launches):
    from decimal import Decimal

    from curvelens.contracts import CHAIN_CURVES, CHAIN_SWAPS

    def wei(x, scale=10**18):
        return None if x is None else Decimal(round(Decimal(repr(x)) * scale))

    log = [
        (s["tx_hash"], s["block_number"], s["block_timestamp"], s["curve_address"], s["token_address"],
         s["trader_address"], (s["trade_type"] or "").upper() == "BUY", wei(s["base_asset_amount"]),
         wei(s["token_amount"]), wei(s["protocol_fee_amount"]), wei(s["gas_price_gwei"], 10**9))
        for s in swaps
    ]
    curves = [
        (e["curve_address"], e["token_address"], e["creator_address"], e["block_number"], e["block_timestamp"],
         wei(e["initial_token_supply"]), wei(e["virtual_base_reserves"]), wei(e["virtual_token_reserves"]),
         wei(e["graduation_threshold_base"]))
        for e in launches if e["event_type"] == "CurveCreated"
    ]
    return dict(
        chain_swaps=spark.createDataFrame(log, CHAIN_SWAPS), chain_curves=spark.createDataFrame(curves, CHAIN_CURVES)
    )


def rows(df, *key):
    """Rows as dicts, sorted by the key columns."""
    return sorted((r.asDict() for r in df.collect()), key=lambda r: [str(r[k]) for k in key])
