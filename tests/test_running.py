"""Sliced running totals against a plain window, for ordinary and over-full slices."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from launch_data import created, raw_tables, rows, swap

from curvelens import Pipeline
from curvelens.operators.running import SliceSpec, running_totals
from curvelens.operators.staging import stage_swaps
from curvelens.sources import event_tape
from pyspark.sql import functions as F


def tape(seed=7, n=400):
    """One hot curve with a hot block, a quiet one, an unknown one; ties, missing positions."""
    rng, out = random.Random(seed), []
    for i in range(n):
        token = rng.choices(["hot", "quiet", "unknown"], [8, 1, 1])[0]
        block = 1007 if rng.random() < 0.4 else rng.randint(1000, 1040)
        s = swap(i, block, timedelta(minutes=block - 1000), token, f"0xu{rng.randint(0, 9)}",
                 rng.choice(["BUY", "buy", "SELL", None]), rng.randint(0, 50) / 8, rng.randint(1, 9) * 1e3,
                 index=rng.randint(0, 30))
        if rng.random() < 0.03:
            s["tx_index"] = None
        if rng.random() < 0.02:
            s["block_number"] = None
        out.append(s)
    return out


LAUNCHES = [created("hot", "0xu1", 1000, timedelta(0), 1), created("quiet", "0xu2", 1003, timedelta(minutes=3), 2)]


def brute(swaps):
    """Reserves walked in plain Python: (tx_hash -> collected, sold, previous tx in the curve)."""
    big = 10**9
    order = sorted(swaps, key=lambda s: (
        big if s["block_number"] is None else s["block_number"], big if s["tx_index"] is None else s["tx_index"], s["tx_hash"]
    ))
    base, tokens, last, out = defaultdict(float), defaultdict(float), {}, {}
    for s in order:
        c, sign = s["curve_address"], 1 if (s["trade_type"] or "").upper() == "BUY" else -1
        base[c] += sign * s["base_asset_amount"]
        tokens[c] += sign * s["token_amount"]
        out[s["tx_hash"]] = (base[c], tokens[c], last.get(c))
        last[c] = s["tx_hash"]
    return out


@pytest.mark.parametrize("spec", [
    SliceSpec(), SliceSpec(blocks=4), SliceSpec(blocks=4, max_rows=10, tx_run=8), SliceSpec(blocks=64, max_rows=1, tx_run=1),
])
def test_equals_plain_walk(spark, spec):
    swaps = tape()
    p = Pipeline(raw_tables(spark, swaps, LAUNCHES), slices=spec)
    want = brute(swaps)
    got = {r["tx_hash"]: r for r in p.states.collect()}
    assert set(got) == {s["tx_hash"] for s in swaps if s["token_address"] != "0xunknown"}
    spot = {h: (30.0 + want[h][0]) / (1.073e9 - want[h][1]) for h in got}
    for h, r in got.items():
        base, tokens, before = want[h]
        assert r["cumulative_base_collected"] == pytest.approx(base, abs=1e-9)
        assert r["tokens_after"] == pytest.approx(tokens, abs=1e-6)
        assert r["spot_price_after_trade"] == pytest.approx(spot[h])
        assert r["spot_price_before_trade"] == (None if before is None else pytest.approx(spot[before]))


def test_one_transaction_with_several_rows_counts_once(spark):
    shared = [swap(1, 1001, timedelta(minutes=1), "hot", f"0xu{i}", "BUY", 1, 1e3, index=3) for i in range(3)]
    other = swap(2, 1001, timedelta(minutes=1), "hot", "0xu1", "BUY", 1, 1e3, index=4)
    again = swap(2, 1900, timedelta(minutes=9), "hot", "0xu1", "BUY", 0, 1e3, index=1)  # mined once more
    none = swap(3, 1901, timedelta(minutes=9), "hot", "0xu1", "BUY", 0, 1e3, tx_hash=None)
    p = Pipeline(raw_tables(spark, shared + [other, again, none], LAUNCHES), slices=SliceSpec(blocks=1, max_rows=1, tx_run=1))
    (row,) = p.token_velocity.collect()
    assert (row["tx_count"], row["unique_active_traders"], row["daily_volume_base"]) == (2, 3, 4.0)
    assert {r["token_address"]: r["total_trades"] for r in p.dim_tokens.collect()}["0xhot"] == 2


def test_last_running_total_is_the_sum(spark, folder):
    from curvelens import RawTables

    p = Pipeline(RawTables.from_events(spark, folder), slices=SliceSpec(blocks=24, max_rows=5, tx_run=50))
    last = p.states.groupBy("curve_address").agg(
        F.max_by("cumulative_base_collected", F.struct("block_number", "tx_index")).alias("last"),
        F.sum(F.when(F.col("trade_type") == "BUY", F.col("base_asset_amount")).otherwise(-F.col("base_asset_amount")))
        .alias("total"),
    )
    assert last.where(F.abs(F.col("last") - F.col("total")) > 1e-6).count() == 0


def test_sliced_reports_agree(spark, folder):
    """Everything built on the states is the same whatever the slicing."""
    from curvelens import RawTables

    raw = RawTables.from_events(spark, folder)
    fine = Pipeline(raw, slices=SliceSpec(blocks=24, max_rows=3, tx_run=40))
    plain = Pipeline(raw)
    for stage, key in [("dim_tokens", ["token_address"]), ("fct_curve_daily", ["curve_address", "trade_date"])]:
        for a, b in zip(rows(getattr(fine, stage), *key), rows(getattr(plain, stage), *key), strict=True):
            assert {k: pytest.approx(v) if isinstance(v, float) else v for k, v in b.items()} == a


@pytest.mark.parametrize("spec", [SliceSpec(), SliceSpec(blocks=24, max_rows=5, tx_run=50), SliceSpec(blocks=2, max_rows=1, tx_run=1)])
def test_slices_left_out_change_nothing(spark, folder, spec):
    """Creator trades and graduations from the slices that matter, against all states."""
    from curvelens import RawTables
    from curvelens.operators import curve, risk

    p = Pipeline(RawTables.from_events(spark, folder), slices=spec)
    for got, want, key in [
        (p.dev_activity, risk.dev_activity(p.tracked_states), ["tx_hash"]),
        (p.time_to_graduation, curve.time_to_graduation(p.states), ["curve_address"]),
    ]:
        got, want = rows(got, *key), rows(want, *key)
        assert len(got) == len(want) > 0
        for g, w in zip(got, want, strict=True):
            assert {k: pytest.approx(v, abs=1e-6) if isinstance(v, float) else v for k, v in w.items()} == g
    if spec.blocks == 24:
        every = p.states.count()
        for only, creator in [("creator", True), ("graduated", False)]:
            some = curve.trade_states(p.swaps, p.meta, spec, p.thresholds, track_creator=creator, only=only)
            assert 0 < some.count() < every


def exchanged(plan):
    """For every exchange of a plan printout: its line and the line of its child."""
    lines = plan.splitlines()
    return [(line, lines[i + 1]) for i, line in enumerate(lines[:-1]) if "Exchange hashpartitioning" in line]


def plan_of(spark, df):
    """Physical plan as for large inputs: no side is small enough to broadcast by estimate."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("stage", ["curve_state", "alerts", "dim_tokens"])
def test_plan_shuffles_whole_trades_once(spark, folder, stage):
    from curvelens import RawTables

    plan = plan_of(spark, getattr(Pipeline(RawTables.from_events(spark, folder)), stage))
    wide = [e for e, child in exchanged(plan) if "tx_hash" in child and "tx_index" in child and "ReusedExchange" not in e]
    by_slice = [e for e in wide if "_bin" in e and "_run" in e]
    assert len(by_slice) == 1
    # without broadcasts, trades also meet the short list of over-full slices
    assert all("_bin" in e for e in wide) and len(wide) <= 2
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "ReusedExchange" in plan


def test_plan_has_no_whole_curve_window_over_trades(spark, folder):
    from curvelens import RawTables

    plan = plan_of(spark, Pipeline(RawTables.from_events(spark, folder)).curve_state)
    windows = [line for line in plan.splitlines() if "Window [" in line and "tx_index" in line]
    assert windows and all("_bin" in w and "_run" in w for w in windows)


def test_holders_of_a_curve_are_dealt_into_parts(spark, folder):
    from curvelens import RawTables

    plan = plan_of(spark, Pipeline(RawTables.from_events(spark, folder)).supply_concentration())
    windows = [line for line in plan.splitlines() if "Window [" in line and "current_token_balance" in line]
    assert windows and all("_part" in w for w in windows)
    assert plan.count("FileScan") == 2 and "Expand" not in plan


def test_running_totals_on_other_keys(spark):
    rows_ = [("a", 1, 1, "t1", 2.0), ("a", 1, 2, "t2", 3.0), ("b", 5, 1, "t3", 4.0)]
    df = spark.createDataFrame(rows_, "k string, block_number long, tx_index int, tx_hash string, v double")
    got = running_totals(df, {"v": F.col("v")}, SliceSpec(blocks=1, max_rows=1, tx_run=1), key="k").collect()
    assert {r["tx_hash"]: (r["v_before"], r["v_after"], r["first_of_key"]) for r in got} == {
        "t1": (0.0, 2.0, True), "t2": (2.0, 5.0, False), "t3": (0.0, 4.0, True),
    }


def test_event_numbers_beyond_32_bits_keep_their_order(spark):
    first = 2**31 - 2
    made = [(first + k, datetime(2024, 1, 1, 0, k), 1, "purchase", 10.0 + k, '{"k": 3}') for k in range(4)]
    events = spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    staged = stage_swaps(event_tape.swaps(events)).orderBy("tx_index").collect()
    assert [r.tx_hash for r in staged] == [f"0xSW_{first + k}" for k in range(4)]
    assert [r.tx_index for r in staged] == [first + k for k in range(4)]
