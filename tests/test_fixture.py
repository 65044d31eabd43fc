"""Published and hand-computed values of the two-launch fixture."""

from launch_data import LAUNCHES, SWAPS, raw_tables, rows

from curvelens import Pipeline, Thresholds
from curvelens.contracts import (
    CURVE_STATE, DIM_TOKENS, DIM_WALLETS, FCT_CURVE_DAILY, FCT_TRADES, STRICT_WHALES, TOKEN_VELOCITY, WALLET_CLUSTERS,
)
from pytest import approx


def test_curve_state(fixture_pipeline):
    df = fixture_pipeline.curve_state
    assert df.columns == CURVE_STATE
    got = rows(df, "tx_hash")
    assert [r["execution_price"] for r in got] == approx(
        [6.666666666666667e-08, 7.5e-08, 8e-08, 8.571428571428572e-08, 1e-07, 2.1666666666666667e-07,
         6.666666666666667e-08, 8.333333333333334e-08, 9.090909090909091e-08]
    )
    spot = [4.333694474539545e-08, 7.607192254495159e-08, 8.166189111747852e-08, 9.049773755656108e-08,
            6.998654104979812e-08, 2.641083521444695e-07, 4.7032474804031354e-08, 5.6422569027611044e-08,
            1.0929853181076673e-07]
    assert [r["spot_price_after_trade"] for r in got] == approx(spot)
    assert [r["spot_price_before_trade"] for r in got[:6]] == [None, *[approx(s) for s in spot[:5]]]
    assert [r["spot_price_before_trade"] for r in got[6:]] == [None, approx(spot[6]), approx(spot[7])]
    assert [r["slippage_pct"] for r in got] == [0.0, 73.0625, 5.1636, 4.9624, 10.5, 209.5833, 0.0, 77.1825, 61.1219]
    assert [r["cumulative_base_collected"] for r in got] == [10, 25, 27, 30, 22, 87, 12, 17, 37]
    assert [r["curve_fill_pct"] for r in got] == [11.76, 29.41, 31.76, 35.29, 25.88, 100.0, 14.12, 20.0, 43.53]
    assert [r["curve_status"] for r in got] == ["ACTIVE"] * 5 + ["GRADUATED"] + ["ACTIVE"] * 3


def test_wallet_clusters(fixture_pipeline):
    df = fixture_pipeline.wallet_clusters
    assert df.columns == WALLET_CLUSTERS
    got = {(r["curve_address"][8:], r["trader_address"][2:]): r for r in rows(df, "trader_address")}
    fields = ["blocks_since_curve_creation", "buy_count", "sell_count", "total_base_invested", "total_base_realized",
              "current_token_balance", "is_creator", "is_sniper", "is_accumulator", "behavioral_cohort",
              "net_realized_pnl_base"]
    want = {
        ("nova", "sniper_1"): (1, 1, 1, 10, 8, 70e6, 0, 1, 0, "SNIPER", -2),
        ("nova", "sniper_2"): (2, 1, 0, 15, 0, 200e6, 0, 1, 1, "SNIPER", -15),
        ("nova", "retail_1"): (20, 1, 0, 2, 0, 25e6, 0, 0, 1, "DIAMOND_HANDS", -2),
        ("nova", "retail_2"): (40, 1, 0, 3, 0, 35e6, 0, 0, 1, "DIAMOND_HANDS", -3),
        ("nova", "whale_1"): (100, 1, 0, 65, 0, 300e6, 0, 0, 1, "WHALE", -65),
        ("phantom", "sniper_1"): (1, 1, 0, 12, 0, 180e6, 0, 1, 1, "SNIPER", -12),
        ("phantom", "retail_3"): (50, 1, 0, 5, 0, 60e6, 0, 0, 1, "DIAMOND_HANDS", -5),
        ("phantom", "creator_bob"): (100, 1, 0, 20, 0, 220e6, 1, 0, 1, "DEV_TEAM", -20),
    }
    assert {k: tuple(r[f] for f in fields) for k, r in got.items()} == want


def test_daily(fixture_pipeline):
    velocity, daily = fixture_pipeline.token_velocity, fixture_pipeline.fct_curve_daily
    assert velocity.columns == TOKEN_VELOCITY and daily.columns == FCT_CURVE_DAILY
    nova, phantom = rows(velocity, "token_address")
    assert (nova["trade_date"], nova["tx_count"], nova["unique_active_traders"]) == ("2026-09-10", 6, 5)
    assert (nova["daily_volume_base"], nova["daily_tokens_traded"]) == (103, 790e6)
    assert nova["avg_daily_price"] == approx(1.0427723152644239e-07)
    assert nova["close_price"] == approx(2.641083521444695e-07)
    assert (nova["implied_market_cap_base"], phantom["implied_market_cap_base"]) == (264.1084, 109.2985)
    assert (nova["turnover_rate_pct"], phantom["turnover_rate_pct"]) == (79.0, 46.0)
    assert (nova["token_velocity_index"], phantom["token_velocity_index"]) == (0.39, 0.3385)
    assert {nova["velocity_health_tier"], phantom["velocity_health_tier"]} == {"MODERATE_VELOCITY"}
    assert (nova["end_of_day_curve_fill_pct"], nova["curve_status"]) == (100.0, "GRADUATED")
    assert (phantom["end_of_day_curve_fill_pct"], phantom["curve_status"]) == (43.53, "ACTIVE")
    nova, phantom = rows(daily, "token_address")
    assert (nova["sniper_volume_base"], nova["sniper_volume_share_pct"]) == (33, 32.04)
    assert (phantom["sniper_volume_base"], phantom["sniper_volume_share_pct"]) == (12, 32.43)


def test_facts_and_dimensions(fixture_pipeline):
    assert fixture_pipeline.fct_trades.columns == FCT_TRADES
    facts = rows(fixture_pipeline.fct_trades, "tx_hash")
    assert [r["trader_cohort"] for r in facts] == [
        "SNIPER", "SNIPER", "DIAMOND_HANDS", "DIAMOND_HANDS", "SNIPER", "WHALE", "SNIPER", "DIAMOND_HANDS", "DEV_TEAM",
    ]
    assert fixture_pipeline.dim_wallets.columns == DIM_WALLETS
    wallets = {r["trader_address"][2:]: r for r in rows(fixture_pipeline.dim_wallets, "trader_address")}
    fields = ["unique_curves_traded", "lifetime_buy_count", "lifetime_sell_count", "lifetime_base_invested",
              "lifetime_base_realized", "lifetime_net_pnl_base", "primary_wallet_segment", "profitability_status"]
    assert {k: tuple(r[f] for f in fields) for k, r in wallets.items()} == {
        "sniper_1": (2, 2, 1, 22, 8, -14, "SNIPER", "UNPROFITABLE"),
        "sniper_2": (1, 1, 0, 15, 0, -15, "SNIPER", "UNPROFITABLE"),
        "retail_1": (1, 1, 0, 2, 0, -2, "ACCUMULATOR", "UNPROFITABLE"),
        "retail_2": (1, 1, 0, 3, 0, -3, "ACCUMULATOR", "UNPROFITABLE"),
        "retail_3": (1, 1, 0, 5, 0, -5, "ACCUMULATOR", "UNPROFITABLE"),
        "whale_1": (1, 1, 0, 65, 0, -65, "WHALE", "UNPROFITABLE"),
        "creator_bob": (1, 1, 0, 20, 0, -20, "DEV_TEAM", "UNPROFITABLE"),
    }
    assert fixture_pipeline.dim_tokens.columns == DIM_TOKENS
    fields = ["total_trades", "total_unique_traders", "lifetime_volume_base", "lifetime_protocol_fees_base",
              "current_base_in_curve", "curve_fill_pct", "curve_status", "all_time_high_price",
              "total_snipers_detected"]
    nova, phantom = rows(fixture_pipeline.dim_tokens, "token_address")
    assert tuple(nova[f] for f in fields) == (6, 5, 103.0, 1.03, 87.0, 100.0, "GRADUATED", 2.6e-07, 2)
    assert tuple(phantom[f] for f in fields) == (3, 3, 37.0, 0.37, 37.0, 43.53, "ACTIVE", 1.1e-07, 1)
    assert phantom["sniper_volume_penetration_pct"] == 32.43


def test_monitoring_queries(fixture_pipeline):
    nova, phantom = fixture_pipeline.curve_monitor.collect()  # fullest first
    assert nova["token_address"] == "0xnova"
    assert (nova["curve_age_minutes"], phantom["curve_age_minutes"]) == (60, 45)
    assert (nova["spot_price_base"], phantom["spot_price_base"]) == (2.6e-07, 1.1e-07)
    assert (nova["total_base_locked"], nova["base_remaining_to_graduate"]) == (87, -2)
    assert (phantom["total_base_locked"], phantom["base_remaining_to_graduate"]) == (37, 48)
    assert (nova["lifecycle_status"], phantom["lifecycle_status"]) == ("GRADUATED_TO_DEX", "ACCUMULATING")

    nova, phantom = fixture_pipeline.supply_concentration().collect()
    assert (nova["unique_holders"], nova["sniper_count"], nova["top_10_supply_pct"]) == (5, 2, 63.0)
    assert (phantom["unique_holders"], phantom["sniper_count"], phantom["top_10_supply_pct"]) == (3, 1, 46.0)
    assert (nova["concentration_hhi"], phantom["concentration_hhi"]) == (1367.5, 844.0)
    assert nova["distribution_health"] == phantom["distribution_health"] == "HEALTHY_DECENTRALIZED_DISTRIBUTION"

    by_token = {r["token_address"]: r for r in fixture_pipeline.velocity_profile.collect()}
    nova, phantom = by_token["0xnova"], by_token["0xphantom"]
    assert (nova["market_cap_base"], phantom["market_cap_base"]) == (104.0079, 80.303)
    assert (nova["token_velocity"], phantom["token_velocity"]) == (0.9903, 0.4608)
    assert nova["velocity_profile"] == "ORGANIC_LIQUID_VELOCITY"
    assert phantom["velocity_profile"] == "LOW_VELOCITY (ACCUMULATION PHASE)"


def test_concentration_of_circulating_supply(fixture_pipeline):
    nova, phantom = rows(fixture_pipeline.supply_concentration("circulating"), "token_address")
    assert nova["top_10_supply_pct"] == approx(100.0) and phantom["top_10_supply_pct"] == approx(100.0)
    assert nova["concentration_hhi"] == approx(1367.5 / 0.63**2, abs=0.05)
    assert nova["distribution_health"].startswith("HIGH_CENTRALIZATION_RISK")


def test_alerts_and_kpis(fixture_pipeline):
    got = rows(fixture_pipeline.alerts, "alert_type", "tx_hash")
    assert [(r["alert_type"], r["tx_hash"]) for r in got] == [
        ("IMMINENT_GRADUATION", "0xsw_6"), ("WHALE_INFLOW", "0xsw_2"), ("WHALE_INFLOW", "0xsw_6"),
        ("WHALE_INFLOW", "0xsw_9"),
    ]
    assert [r["threshold"] for r in got[1:]] == approx([11.25, 9.45, 10.2])
    tags = {r["token_address"]: (r["penetration_pct"], r["risk_tag"]) for r in fixture_pipeline.sniper_penetration.collect()}
    assert tags == {"0xnova": (35.0, "ORANGE"), "0xphantom": (18.0, "NORMAL")}
    (kpi,) = fixture_pipeline.protocol_kpis.collect()
    assert (kpi["created_curves"], kpi["active_curves"], kpi["graduation_rate_pct"]) == (2, 1, 50.0)
    assert (kpi["avg_minutes_to_graduate"], kpi["created_today"]) == (60, 2)
    (grad,) = fixture_pipeline.time_to_graduation.collect()
    assert (grad["token_address"], grad["minutes_to_graduate"]) == ("0xnova", 60)


def test_depth_matrix(fixture_pipeline):
    got = {(r["token_address"], r["order_base"]): r for r in fixture_pipeline.depth_matrix.collect()}
    row = got["0xphantom", 2.0]  # x = 67, y = 613e6
    assert row["slippage_pct"] == approx(2 / 67 * 100, abs=1e-4)
    assert row["tokens_out"] == approx(613e6 * 2 / 69)
    assert row["average_price"] == approx(69 / 613e6)
    assert len(got) == 6


def test_threshold_sets(spark):
    raw = raw_tables(spark, SWAPS, LAUNCHES)
    strict = {r["trader_address"]: r["behavioral_cohort"] for r in Pipeline(raw, STRICT_WHALES).wallet_clusters.collect()}
    assert strict["0xwhale_1"] == "WHALE"
    high = Thresholds(whale_invested=70.0, whale_lifetime_invested=70.0)
    assert {r["trader_address"]: r["behavioral_cohort"] for r in Pipeline(raw, high).wallet_clusters.collect()}[
        "0xwhale_1"
    ] == "DIAMOND_HANDS"


def test_last_price_and_sticky_status(spark):
    from launch_data import _min, swap

    sold = swap(10, 1200, _min(70), "nova", "0xwhale_1", "SELL", 40, 100e6)
    raw = raw_tables(spark, SWAPS + [sold], LAUNCHES)
    plain, other = Pipeline(raw), Pipeline(raw, close="last", status="sticky")
    after = lambda p: {r["tx_hash"]: r for r in p.curve_state.collect()}["0xsw_10"]
    assert after(plain)["curve_status"] == "ACTIVE" and after(other)["curve_status"] == "GRADUATED"
    close = lambda p: {r["token_address"]: r for r in p.token_velocity.collect()}["0xnova"]["close_price"]
    assert close(plain) == approx(2.641083521444695e-07)
    assert close(other) == approx(after(plain)["spot_price_after_trade"])
