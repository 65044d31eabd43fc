"""Streams against the batch operators, over several micro-batches with disorder and late rows."""

from datetime import timedelta

import pytest
from launch_data import LAUNCHES, SWAPS, T0, raw_tables, rows, swap

from curvelens import Pipeline, RawTables
from curvelens.contracts import CURVE_STATE, RAW_SWAPS
from curvelens.operators.running import SliceSpec
from curvelens.streaming import marts as live_marts
from curvelens.streaming import rollups
from curvelens.streaming.live import LiveCurves
from curvelens.streaming.sources import staged_stream, stream_table
from pyspark.sql import functions as F


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and a == pytest.approx(b, abs=1e-9))


def assert_same(got, want, *key):
    got, want = rows(got, *key), rows(want, *key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(close(g[k], w[k]) for k in w), (g, w)


def write_batches(spark, swaps, folder, parts):
    """One file per part, in order; the stream reads one file per micro-batch."""
    raw = raw_tables(spark, swaps, LAUNCHES).swaps
    for i, hashes in enumerate(parts):
        raw.where(F.col("tx_hash").isin(hashes)).coalesce(1).write.mode("append").parquet(str(folder))
    return raw


@pytest.fixture()
def tape(spark, folder):
    return Pipeline(RawTables.from_events(spark, folder))


@pytest.fixture()
def files(spark, folder, tmp_path, tape):
    """Raw swaps of the event tape in three files by time; neighbours overlap by a few minutes."""
    start, end = tape.raw.swaps.agg(F.min("block_timestamp"), F.max("block_timestamp")).first()
    step = (end - start) / 3
    target = tmp_path / "swaps"
    shift = F.when(F.abs(F.hash("tx_hash")) % 3 == 0, F.expr("interval 5 minutes")).otherwise(F.expr("interval 0 minutes"))
    arrival = tape.raw.swaps.withColumn("arrival", F.col("block_timestamp") + shift)
    for i in range(3):
        low, high = start + step * i, start + step * (i + 1) + (timedelta(days=1) if i == 2 else timedelta(0))
        part = arrival.where((F.col("arrival") >= low) & (F.col("arrival") < high)).drop("arrival")
        part.coalesce(1).write.mode("append").parquet(str(target))
    return str(target)


def test_live_states_equal_batch(spark, tmp_path, tape, files):
    stream = staged_stream(stream_table(spark, files, RAW_SWAPS, max_files=1))
    live = LiveCurves(
        spark, str(tmp_path / "live"), lambda: tape.meta, slices=SliceSpec(blocks=24, max_rows=5, tx_run=50),
        with_marts=False, with_alerts=False,
    )
    live.start(stream).awaitTermination()
    assert live._last_batch() == 2
    assert live.late().count() == 0
    assert_same(live.states().select(*CURVE_STATE), tape.curve_state, "tx_hash")


def test_legs_and_missing_times_are_kept(spark, tmp_path, tape):
    from launch_data import LAUNCHES, SWAPS, raw_tables, swap

    from curvelens import Pipeline

    minute = timedelta(minutes=1)
    legs = [swap(70, 1200, minute * 70, "nova", "0xleg", "BUY", base, 1e6) for base in (1.0, 2.0)]
    odd = dict(swap(71, 1201, minute, "nova", "0xodd", "BUY", 1.0, 1e6), block_timestamp=None)
    batches = [SWAPS[:3] + legs[:1], [legs[1], odd, legs[0]], SWAPS[3:6]]
    raw = raw_tables(spark, SWAPS[:6] + legs + [odd], LAUNCHES[:1])
    p = Pipeline(raw)
    live = LiveCurves(spark, str(tmp_path / "legs"), lambda: p.meta, delay="300 minutes", with_marts=False, with_alerts=False)
    for number, rows in enumerate(batches):
        live.process(Pipeline(raw_tables(spark, rows, LAUNCHES[:1])).swaps, number)
    assert live.states().count() + live.late().count() == p.curve_state.count() == 9


def test_late_trades_go_to_the_side_table(spark, tmp_path):
    late = swap(50, 1003, timedelta(minutes=1), "nova", "0xlate", "BUY", 1, 10)
    again = SWAPS[2]
    parts = [["0xsw_1", "0xsw_2"], ["0xsw_3", "0xsw_4", "0xsw_5"], ["0xsw_6", "0xsw_50"], ["0xsw_3", "0xsw_7"]]
    write_batches(spark, SWAPS[:7] + [late], tmp_path / "in", parts)
    meta = Pipeline(raw_tables(spark, SWAPS, LAUNCHES)).meta
    live = LiveCurves(spark, str(tmp_path / "live"), lambda: meta, with_marts=False, with_alerts=False)
    live.start(staged_stream(stream_table(spark, str(tmp_path / "in"), RAW_SWAPS, max_files=1))).awaitTermination()
    assert {r["tx_hash"] for r in live.late().collect()} <= {"0xsw_50", again["tx_hash"]}
    assert "0xsw_50" in {r["tx_hash"] for r in live.late().collect()}
    want = Pipeline(raw_tables(spark, SWAPS[:7], LAUNCHES)).curve_state
    assert_same(live.states().select(*CURVE_STATE), want, "tx_hash")


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    p = Pipeline(raw_tables(spark, SWAPS, LAUNCHES))
    live = LiveCurves(spark, str(tmp_path / "live"), lambda: p.meta, with_marts=False)
    first, second = p.swaps.where(F.col("token_address") == "0xnova"), p.swaps.where(F.col("token_address") != "0xnova")
    for batch, number in [(first, 0), (second, 1), (second, 1)]:
        live.process(batch, number)
    assert_same(live.states().select(*CURVE_STATE), p.curve_state, "tx_hash")
    assert live.alerts().where(F.col("alert_type") == "WHALE_INFLOW").count() == 2  # 0xsw_9 is still inside the delay


def test_empty_first_batch(spark, tmp_path):
    p = Pipeline(raw_tables(spark, SWAPS, LAUNCHES))
    live = LiveCurves(spark, str(tmp_path / "live"), lambda: p.meta)
    live.process(p.swaps.where("false"), 0)
    live.process(p.swaps, 1)
    assert_same(live.states().select(*CURVE_STATE), p.curve_state, "tx_hash")


def test_launches_and_labels_are_found_once_a_batch(spark, tmp_path, monkeypatch):
    p, asked, seen = Pipeline(raw_tables(spark, SWAPS, LAUNCHES)), [], []
    live = LiveCurves(spark, str(tmp_path / "live"), lambda: asked.append(1) or p.meta)
    for module, name in [(live_marts.marts, "fct_trades"), (live_marts.marts, "daily_fact")]:
        made = getattr(module, name)
        place = 1 if name == "fct_trades" else 2
        monkeypatch.setattr(module, name, lambda *a, made=made, place=place: seen.append(a[place]) or made(*a))
    live.process(p.swaps, 0)
    assert len(asked) == 1
    live.process(p.swaps.where("false"), 1, ending=True)
    assert len(asked) == 2
    assert len(seen) == 4 and not any("Join" in d._jdf.queryExecution().optimizedPlan().toString() for d in seen)
    assert_same(live.marts.dim_wallets(), p.dim_wallets, "trader_address")
    assert_same(live.marts.dim_tokens(), p.dim_tokens, "token_address")
    assert_same(live.marts.fct_trades(), p.fct_trades, "tx_hash")


def test_live_fee_spike(spark, tmp_path):
    quiet = [swap(i, 1000 + i, timedelta(hours=i), "nova", "0xa", "BUY", 1, 10) for i in range(200)]
    spike = swap(500, 1199, timedelta(hours=199, minutes=1), "nova", "0xa", "BUY", 1, 10, protocol_fee_amount=1.0)
    after = swap(501, 1201, timedelta(hours=201), "nova", "0xa", "BUY", 1, 10)
    swaps = Pipeline(raw_tables(spark, quiet + [spike, after], LAUNCHES)).swaps
    live = LiveCurves(spark, str(tmp_path / "live"), lambda: Pipeline(raw_tables(spark, [], LAUNCHES)).meta, with_marts=False)
    cut = F.lit(T0 + timedelta(hours=199, minutes=30)).cast("timestamp_ntz")
    live.process(swaps.where(F.col("block_timestamp") < cut), 0)
    assert live.alerts().where(F.col("alert_type") == "FEE_SPIKE").count() == 0
    live.process(swaps.where(F.col("block_timestamp") >= cut), 1)
    (row,) = live.alerts().where(F.col("alert_type") == "FEE_SPIKE").collect()
    assert row["metric_value"] == pytest.approx(1.01)



def test_live_windows_equal_batch(spark, tmp_path, tape, files):
    live, key = rollups.LiveRollup(spark, str(tmp_path / "inflow"), rollups.INFLOW_15M, fan=2), ["curve_address", "window_start"]
    live.start(staged_stream(stream_table(spark, files, RAW_SWAPS, max_files=1))).awaitTermination()
    assert live._last_batch() == 2 and live.late().count() == 0
    assert_same(live.current(), tape.inflow_15m, *key)
    end = tape.swaps.agg(F.max("block_timestamp")).first()[0] - timedelta(minutes=25)
    assert_same(live.final(), tape.inflow_15m.where(F.col("window_start") <= F.lit(end)), *key)


@pytest.mark.parametrize("windows, stage, key", [
    (rollups.ROLLUP_5M, "rollup_5m", ["window_start"]), (rollups.INFLOW_15M, "inflow_15m", ["curve_address", "window_start"]),
])
def test_late_trades_correct_their_windows(spark, tmp_path, windows, stage, key):
    """Late, repeated and early trades over several batches: what is shown is the batch roll-up of all of them."""
    late = [swap(50, 1003, timedelta(minutes=1), "nova", "0xlate", "BUY", 1, 10), swap(51, 1003, timedelta(minutes=3), "nova", "0xsniper_1", "SELL", 1, 10)]
    batches = [SWAPS[:5] + SWAPS[:1], SWAPS[5:6] + late + late[:1], [], SWAPS[6:] + late[1:] + SWAPS[2:3]]
    live, seen = rollups.LiveRollup(spark, str(tmp_path / "live"), windows, fan=2), []
    for number, part in enumerate(batches):
        for x in part:
            seen += [x] if x not in seen else []
        batch = Pipeline(raw_tables(spark, part, LAUNCHES)).swaps
        live.process(batch, number)
        if number == 1:
            live.process(batch, number)  # a batch may be run again
        if number in (1, 3):
            assert_same(live.current(), getattr(Pipeline(raw_tables(spark, seen, LAUNCHES)), stage), *key)
    assert sorted(r["tx_hash"] for r in live.late().collect()) == ["0xsw_50", "0xsw_51"]


def test_segments_hold_every_batch_in_few_files(spark, tmp_path):
    from curvelens.streaming.segments import SegmentTable

    plain = SegmentTable(spark, str(tmp_path / "rows"), fan=3)
    sums = SegmentTable(spark, str(tmp_path / "sums"), lambda r: r.groupBy("k").agg(F.sum("v").alias("v")), partition="k", fan=3)
    for n in range(20):
        batch = spark.createDataFrame([(n, n % 4)] if n % 5 else [], "v long, k int").coalesce(1)
        for table in (plain, sums):
            for _ in range(1 + (n in (8, 17))):  # merges are repeated too
                table.write(batch, n)
        if n in (0, 1, 8, 9, 17, 19):
            want = [k for k in range(n + 1) if k % 5]
            assert sorted(r.v for r in plain.read(n).collect()) == want
            assert {r.k: r.v for r in sums.read(n).collect()} == {k: sum(v for v in want if v % 4 == k) for k in {v % 4 for v in want}}
            assert len(plain.segments(n)) <= 2 * 3
    folders = [p for p in (tmp_path / "rows").glob("level=*/segment=*")]
    assert len(folders) <= 2 * 3 * 3  # at most two generations of each level


def test_segment_numbers_cover_all_batches():
    from curvelens.streaming.segments import SegmentTable

    for fan in (2, 3, 8):
        table = SegmentTable(None, "x", fan=fan)
        for n in range(-1, 1000):
            covered = [b for level, k in table.segments(n) for b in range(k * fan**level, (k + 1) * fan**level)]
            assert covered == list(range(n + 1))
            assert len(table.segments(n)) <= (fan - 1) * 10


def test_marts_written(spark, tmp_path, tape):
    tape.write_marts(str(tmp_path / "marts"), str(tmp_path / "states"))
    for name, key in [("fct_trades", ["tx_hash"]), ("fct_curve_daily", ["curve_address", "trade_date"]),
                      ("dim_wallets", ["trader_address"]), ("dim_tokens", ["token_address"])]:
        got = spark.read.parquet(str(tmp_path / "marts" / name))
        if "trade_date" in got.columns:
            got = got.withColumn("trade_date", F.col("trade_date").cast("string"))
        if name == "fct_trades":
            day = got.where("trade_date = '2024-01-05'")
            assert "PartitionFilters: [isnotnull(trade_date" in day._jdf.queryExecution().toString()
            got = got.drop("trade_date")
        assert_same(got, getattr(tape, name), *key)
    tape.register_views()
    assert spark.sql("select count(*) from dim_tokens where curve_status = 'GRADUATED'").first()[0] == 2
