"""Edge cases of the semantics ledger."""

from datetime import timedelta

import pytest
from launch_data import LAUNCHES, SWAPS, _min, created, raw_tables, rows, swap

from curvelens import Pipeline

ZERO = timedelta(0)


def states(spark, swaps, launches, **options):
    return {r["tx_hash"]: r for r in Pipeline(raw_tables(spark, swaps, launches), **options).curve_state.collect()}


def test_staging_rules(spark):
    swaps = [
        swap(1, 1, ZERO, "MiXed", "0xAB", "buy", 1, 10),
        swap(2, 1, ZERO, "mixed", "0xab", None, 1, 10),
        swap(3, 1, ZERO, "mixed", "0xab", "BUY", 1, 0),
        swap(4, 1, ZERO, "mixed", "0xab", "BUY", 1, -5),
        swap(5, 1, ZERO, "mixed", "0xab", "BUY", -1, 5),
        swap(6, 1, ZERO, "mixed", "0xab", "BUY", 0, 5),
        swap(7, 1, ZERO, "mixed", "0xab", "BUY", 1, 5, token_amount=None),
    ]
    got = rows(Pipeline(raw_tables(spark, swaps, [])).swaps, "tx_hash")
    assert [r["tx_hash"] for r in got] == ["0xsw_1", "0xsw_2", "0xsw_6"]
    assert (got[0]["curve_address"], got[0]["trader_address"], got[0]["trade_type"]) == ("0xcurve_mixed", "0xab", "BUY")
    assert (got[0]["execution_price"], got[2]["execution_price"]) == (0.1, 0.0)


def test_transfer_rules(spark):
    from launch_data import T0

    t = dict(tx_hash="0x1", block_number=1, block_timestamp=T0, token_address="0xT", from_address="0xA",
             to_address="0xB", amount=1.0)
    transfers = [t, t | {"to_address": "0xa"}, t | {"amount": 0.0}, t | {"from_address": None}]
    (row,) = Pipeline(raw_tables(spark, [], [], transfers)).transfers.collect()
    assert (row["token_address"], row["from_address"], row["to_address"]) == ("0xt", "0xa", "0xb")


@pytest.mark.parametrize("threshold", [0.0, None])
def test_missing_threshold_never_fills(spark, threshold):
    launch = created("nova", "0xc", 1000, ZERO, 1, graduation_threshold_base=threshold)
    got = states(spark, SWAPS[:2], [launch])
    assert {(r["curve_fill_pct"], r["curve_status"]) for r in got.values()} == {(0.0, "ACTIVE")}


def test_empty_token_reserve_has_no_price(spark):
    launch = created("nova", "0xc", 1000, ZERO, 1, virtual_token_reserves=100.0)
    swaps = [swap(1, 1001, _min(1), "nova", "0xa", "BUY", 1, 100), swap(2, 1002, _min(2), "nova", "0xa", "BUY", 1, 5)]
    got = states(spark, swaps, [launch])
    assert got["0xsw_1"]["spot_price_after_trade"] is None
    assert got["0xsw_2"]["spot_price_before_trade"] is None and got["0xsw_2"]["slippage_pct"] == 0.0


def test_status_follows_each_trade(spark):
    swaps = [
        swap(1, 1001, _min(1), "nova", "0xa", "BUY", 85, 10), swap(2, 1002, _min(2), "nova", "0xa", "SELL", 5, 10),
        swap(3, 1003, _min(3), "nova", "0xa", None, 1, 10),
    ]
    p = Pipeline(raw_tables(spark, swaps, LAUNCHES[:1]))
    got = {r["tx_hash"]: r for r in p.curve_state.collect()}
    assert [got[f"0xsw_{i}"]["curve_status"] for i in (1, 2, 3)] == ["GRADUATED", "ACTIVE", "ACTIVE"]
    assert got["0xsw_3"]["cumulative_base_collected"] == 79.0  # a missing type counts as a sale
    (token,) = p.dim_tokens.collect()
    assert (token["curve_status"], token["current_base_in_curve"]) == ("GRADUATED", 85.0)
    (wallet,) = p.wallet_clusters.collect()
    assert (wallet["sell_count"], wallet["total_base_realized"]) == (1, 5.0)


def test_unknown_and_untraded_curves(spark):
    p = Pipeline(raw_tables(spark, SWAPS[:6] + [swap(99, 1, ZERO, "lost", "0xz", "BUY", 1, 1)], LAUNCHES))
    assert "0xz" not in {r["trader_address"] for r in p.dim_wallets.collect()}
    assert p.fct_trades.count() == 6
    phantom = rows(p.dim_tokens, "token_address")[1]
    assert (phantom["total_trades"], phantom["curve_status"], phantom["sniper_volume_penetration_pct"]) == (0, "ACTIVE", 0.0)
    assert phantom["lifetime_volume_base"] == 0.0


def test_zero_supply(spark):
    p = Pipeline(raw_tables(spark, SWAPS[:2], [created("nova", "0xc", 1000, ZERO, 1, initial_token_supply=0.0)]))
    (row,) = p.token_velocity.collect()
    assert (row["turnover_rate_pct"], row["token_velocity_index"]) == (None, 0.0)
    assert row["velocity_health_tier"] == "STAGNANT_LIQUIDITY"


def test_launch_created_twice_doubles_its_trades(spark):
    again = created("nova", "0xcreator_alice", 1000, ZERO, 7)
    p = Pipeline(raw_tables(spark, SWAPS[:6], [LAUNCHES[0], again]))
    assert p.curve_state.count() == 12
    (day,) = p.token_velocity.collect()
    assert (day["tx_count"], day["daily_volume_base"]) == (6, 206.0)
    whale = {r["trader_address"]: r for r in p.wallet_clusters.collect()}["0xwhale_1"]
    assert (whale["buy_count"], whale["total_base_invested"]) == (2, 130.0)
    grain = {r["check_name"]: r["violations"] for r in p.check("grain").collect()}
    assert grain["grain_fct_trades"] == 6 and grain["grain_dim_tokens"] == 1 and grain["grain_raw_swaps"] == 0


def test_two_creators_of_one_curve(spark):
    again = created("nova", "0xcreator_carol", 1000, ZERO, 7)
    raw = raw_tables(spark, SWAPS[:6], [LAUNCHES[0], again])
    p = Pipeline(raw)
    (day,) = p.fct_curve_daily.collect()
    assert (day["tx_count"], day["daily_volume_base"]) == (6, 206.0)
    assert (day["sniper_volume_base"], day["sniper_volume_share_pct"]) == (132.0, 64.08)
    assert p.fct_trades.count() == 24
    assert {r["lifetime_volume_base"] for r in p.dim_tokens.collect()} == {412.0}
    assert {r["lifetime_volume_base"] for r in Pipeline(raw, totals="states").dim_tokens.collect()} == {206.0}
    (early,) = p.sniper_penetration.collect()
    assert (early["penetration_pct"], early["risk_tag"]) == (35.0, "ORANGE")
    assert p.alerts.where("alert_type = 'SNIPER_HIJACK'").count() == 0


def test_each_large_buy_of_a_transaction_raises_an_alert(spark):
    legs = [swap(1, 1001, _min(1), "nova", "0xwhale_1", "BUY", base, 1e6) for base in (20.0, 30.0)]
    p = Pipeline(raw_tables(spark, legs, LAUNCHES[:1]))
    assert sorted(r["metric_value"] for r in p.alerts.where("alert_type = 'WHALE_INFLOW'").collect()) == [20.0, 30.0]


def test_all_holders_are_ranked(spark):
    swaps = [swap(i, 1001 + i, _min(1), "nova", f"0xw{i:02}", "BUY", 1, 1000.0 * (1 + i % 7)) for i in range(40)]
    got = Pipeline(raw_tables(spark, swaps, LAUNCHES[:1])).raw
    from curvelens.operators.wallets import holder_ranks

    held = got.swaps.selectExpr(
        "curve_address", "token_address", "trader_address", "token_amount as current_token_balance", "1d as pct_supply_held", "'x' as wallet_cohort"
    )
    ranks = {r["trader_address"]: r["holder_rank"] for r in holder_ranks(held).collect()}
    want = sorted(((-1000.0 * (1 + i % 7), f"0xw{i:02}") for i in range(40)))
    assert ranks == {w: n for n, (_, w) in enumerate(want, 1)}


def test_trades_before_launch_and_creator_in_first_block(spark):
    swaps = [swap(1, 990, _min(-1), "nova", "0xearly", "BUY", 1, 10), swap(2, 1000, ZERO, "nova", "0xcreator_alice", "BUY", 1, 10)]
    p = Pipeline(raw_tables(spark, swaps, LAUNCHES[:1]))
    got = {r["trader_address"]: r for r in p.wallet_clusters.collect()}
    assert (got["0xearly"]["blocks_since_curve_creation"], got["0xearly"]["is_sniper"]) == (-10, 1)
    creator = got["0xcreator_alice"]
    assert (creator["is_sniper"], creator["is_creator"], creator["behavioral_cohort"]) == (1, 1, "DEV_TEAM")
    (day,) = p.fct_curve_daily.collect()
    assert day["sniper_volume_base"] == 1.0  # by cohort
    (token,) = p.dim_tokens.collect()
    assert (token["total_snipers_detected"], token["sniper_volume_penetration_pct"]) == (2, 100.0)  # by flag
    (early,) = p.sniper_penetration.collect()
    assert early["tokens_bought_early"] == 10.0  # blocks 0 to 2 only


def test_days_are_split_at_midnight(spark):
    swaps = SWAPS[:2] + [swap(50, 9000, timedelta(hours=12), "nova", "0xsniper_1", "SELL", 1, 10)]
    got = rows(Pipeline(raw_tables(spark, swaps, LAUNCHES[:1])).token_velocity, "trade_date")
    assert [(r["trade_date"], r["tx_count"]) for r in got] == [("2026-09-10", 2), ("2026-09-11", 1)]


def test_missing_trader_has_no_cohort(spark):
    swaps = SWAPS[:1] + [swap(50, 1001, _min(1), "nova", None, "BUY", 1, 10)]
    p = Pipeline(raw_tables(spark, swaps, LAUNCHES[:1]))
    facts = {r["tx_hash"]: r for r in p.fct_trades.collect()}
    assert facts["0xsw_50"]["trader_cohort"] is None and facts["0xsw_1"]["trader_cohort"] == "SNIPER"
    (token,) = p.dim_tokens.collect()
    assert (token["total_trades"], token["total_unique_traders"], token["total_snipers_detected"]) == (2, 1, 1)


def test_dev_dumping(spark):
    alice = "0xcreator_alice"
    swaps = [
        swap(1, 1001, _min(1), "nova", alice, "BUY", 1, 200e6),
        swap(2, 1002, _min(2), "nova", alice, "SELL", 0.5, 40e6),
        swap(3, 1003, _min(3), "nova", alice, "SELL", 0.5, 20e6),
        swap(4, 1004, _min(4), "nova", alice, "SELL", 0.1, 20e6),
    ]
    p = Pipeline(raw_tables(spark, swaps, LAUNCHES))
    dumps = [r for r in p.alerts.collect() if r["alert_type"] == "DEV_DUMPING"]
    assert [(r["tx_hash"], r["metric_value"]) for r in dumps] == [("0xsw_3", pytest.approx(6.0))]
    got = rows(p.dev_activity, "tx_hash")
    assert [r["creator_balance"] for r in got] == [200e6, 160e6, 140e6, 120e6]
    assert [r["creator_tokens_sold"] for r in got] == [0, 40e6, 60e6, 80e6]
    (risk,) = p.dump_risk.collect()
    assert (risk["initial_allocation"], risk["tokens_sold_early"], risk["risk_flag"]) == (200e6, 80e6, "High Dump Risk")


def test_graduation_is_announced_once(spark):
    swaps = [
        swap(1, 1001, _min(1), "nova", "0xa", "BUY", 80, 10), swap(2, 1002, _min(2), "nova", "0xa", "SELL", 20, 10),
        swap(3, 1003, _min(3), "nova", "0xa", "BUY", 20, 10),
    ]
    got = Pipeline(raw_tables(spark, swaps, LAUNCHES[:1])).alerts.collect()
    assert [r["tx_hash"] for r in got if r["alert_type"] == "IMMINENT_GRADUATION"] == ["0xsw_1"]


def test_fee_spike(spark):
    quiet = [swap(i, 1000 + i, timedelta(hours=i), "nova", "0xa", "BUY", 1, 10) for i in range(200)]
    spike = swap(500, 1199, timedelta(hours=199, minutes=1), "nova", "0xa", "BUY", 1, 10, protocol_fee_amount=1.0)
    got = rows(Pipeline(raw_tables(spark, quiet + [spike], LAUNCHES)).fee_spike, "hour_start")
    assert [r["is_spike"] for r in got] == [False] * 199 + [True]
    assert got[199]["trailing_mean"] == pytest.approx(0.01)


def test_retention(spark):
    def buy(n, day, who, kind="BUY"):
        return swap(n, n, timedelta(days=day), "nova", who, kind, 1, 10)

    swaps = [buy(1, 0, "0xa"), buy(2, 1, "0xa", "SELL"), buy(3, 7, "0xa"), buy(4, 0, "0xb"), buy(5, 0, "0xb"),
             buy(6, 0, "0xc", "SELL"), buy(7, 3, "0xc"), buy(8, 4, "0xc")]
    got = rows(Pipeline(raw_tables(spark, swaps, LAUNCHES)).retention, "cohort_day")
    assert [(r["cohort_day"], r["buyers"], r["d1_retained"], r["d3_retained"], r["d7_retained"]) for r in got] == [
        ("2026-09-10", 2, 1, 0, 1), ("2026-09-13", 1, 1, 0, 0),
    ]
    assert got[0]["d1_retention_pct"] == 50.0


def test_graduation_eta(spark):
    swaps = [swap(1, 1, _min(0), "nova", "0xa", "BUY", 15, 10), swap(2, 2, _min(14), "nova", "0xa", "BUY", 15, 10),
             swap(3, 3, _min(16), "nova", "0xa", "SELL", 30, 10), swap(4, 4, _min(60), "nova", "0xa", "BUY", 85, 10)]
    got = rows(Pipeline(raw_tables(spark, swaps, LAUNCHES[:1])).graduation_eta, "minute_start")
    assert [r["est_minutes_to_graduate"] for r in got] == [70.0, 27.5, None, 0.0]


def test_from_chain_logs(spark):
    from curvelens import RawTables

    raw = raw_tables(spark, SWAPS, LAUNCHES)
    p = Pipeline(RawTables.from_chain(raw.chain_swaps, raw.chain_curves))
    nova, phantom = rows(p.dim_tokens, "token_address")
    assert (nova["curve_status"], phantom["curve_fill_pct"]) == ("GRADUATED", 43.53)


def test_chain_amounts_beyond_decimal(spark):
    from curvelens.sources.chain import decode_swaps

    row = spark.createDataFrame(
        [("0x1", 1, "0xc", "0xt", "0xa", True, "9" * 45, "1" + "0" * 40, "0", "7000000000")],
        "evt_tx_hash string, evt_block_number long, contract_address string, token_address string, trader string,"
        "is_buy boolean, base_asset_amount string, token_amount string, fee_amount string, gas_price string",
    ).selectExpr("*", "timestamp_ntz '2026-01-01 00:00:00' as evt_block_time")
    (got,) = decode_swaps(row).collect()
    assert got["base_asset_amount"] == pytest.approx(1e27)
    assert (got["token_amount"], got["gas_price_gwei"]) == (pytest.approx(1e22), 7.0)


def test_unknown_options_are_rejected(spark):
    raw = raw_tables(spark, SWAPS, LAUNCHES)
    for option in ({"close": "first"}, {"status": "never"}):
        with pytest.raises(ValueError):
            Pipeline(raw, **option)
    with pytest.raises(ValueError):
        Pipeline(raw).supply_concentration("other")
    with pytest.raises(ValueError):
        Pipeline(raw).check("nothing")


def test_checks_report_violations(spark):
    p = Pipeline(raw_tables(spark, SWAPS + [SWAPS[0]], LAUNCHES))
    grain = {r["check_name"]: (r["rows_tested"], r["violations"]) for r in p.check("grain").collect()}
    assert grain["grain_raw_swaps"] == (10, 1)
    for name in ("graduation", "snipers", "whales", "velocity", "wallet_grain"):
        (row,) = p.check(name).collect()
        assert row["violations"] == 0 and row["rows_tested"] > 0
