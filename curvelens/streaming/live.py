"""Live curve state: the batch operator applied to every micro-batch, continued from stored balances.

A keyed stateful operator would send all trades of a hot launch to one task for as long as the
launch is hot. Instead each micro-batch runs the sliced running totals of the batch pipeline, and
only one small row per curve (its balances) is carried to the next batch.

Trades wait in a pending table until the watermark passes them, so they are processed in tape
order. Trades at or before the previous watermark come too late: they go to a side table for the
next batch rebuild.

Everything a batch writes depends on its input and on the tables of the batch before, and is
overwritten when the batch is repeated; so a batch that fails half-way is simply run again.

Alerts have an identity: their kind, curve and, where each trade may raise one, the trade. The table of
alerts holds one row for each. A trade alert stays as it was first raised; a sniper alert is raised once the
limit is passed and follows the buys of the launch blocks as they come.

Tables under the folder (``SegmentTable``: few files after any number of batches):
  states/   per-trade states, by trade_date      late/      trades behind the watermark
  alerts/   alert rows by identity               hours/     hourly fees
  carry/    launches, balances, buys of launch blocks, pending trades and clock, touched days and labels;
            of the last batches only
  partial/, marts/  see ``streaming.marts``
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelens.contracts import ALERTS, Thresholds
from curvelens.functions.scalars import day_text, hour_index, is_sell, signed, sum_if
from curvelens.operators import alerts, curve, risk
from curvelens.operators.running import SliceSpec
from curvelens.operators.skew import spread_join
from curvelens.streaming.marts import BUCKETS, LiveMarts
from curvelens.streaming.segments import FAN, SegmentTable, remove
from curvelens.streaming.sources import SAME_TRADE


#: Batches whose carried state is kept; the last one may be run again and needs the one before it.
KEPT = 3


@dataclass(frozen=True)
class _Carry:
    newest: datetime
    first_hour: int | None
    pending: DataFrame
    balances: DataFrame
    early: DataFrame


def _by_identity(rows: DataFrame) -> DataFrame:
    """One row per alert: followed ones as of the last batch, others as first raised."""
    batch, followed = F.col("batch_id"), F.col("alert_type").isin("SNIPER_HIJACK", "FEE_SPIKE")
    order = F.when(followed, -batch).otherwise(batch)
    key = ["alert_type", "token_address", "curve_address", "alert_key"]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def _hour_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("hour").agg(F.sum("hourly_fees").alias("hourly_fees"))


class LiveCurves:
    """Processes micro-batches of staged swaps. ``launches`` returns the launch parameters as of now."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        launches: Callable[[], DataFrame],
        delay: str = "10 minutes",
        thresholds: Thresholds = Thresholds(),
        slices: SliceSpec = SliceSpec(),
        with_marts: bool = True,
        with_alerts: bool = True,
        fan: int = FAN,
        buckets: int = BUCKETS,
    ):
        self.spark, self.folder, self._source, self._known = spark, folder.rstrip("/"), launches, None
        self.delay, self.thresholds, self.slices, self.with_alerts = delay, thresholds, slices, with_alerts
        self.state_table = SegmentTable(spark, f"{self.folder}/states", partition="trade_date", fan=fan)
        self.late_table = SegmentTable(spark, f"{self.folder}/late", fan=fan)
        self.alert_table = SegmentTable(spark, f"{self.folder}/alerts", _by_identity, fan=fan)
        self.hour_table = SegmentTable(spark, f"{self.folder}/hours", _hour_sums, fan=fan)
        self.marts = LiveMarts(spark, self.folder, self.launches, self.state_table, thresholds, fan, buckets) if with_marts else None

    # ------------------------------------------------------------------ driving
    def start(self, swaps: DataFrame, trigger: dict | None = None):
        """Starts the query; by default it processes what is available now and ends."""
        return (
            swaps.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.folder}/checkpoint")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def finish(self, swaps: DataFrame) -> None:
        """Processes the trades that still wait, after the stream has ended for good. ``swaps``: any staged swaps."""
        self.process(swaps.where("false"), self._last_batch() + 1, ending=True)

    def process(self, batch: DataFrame, batch_id: int, ending: bool = False) -> None:
        # stored once for the batch: its steps ask for them many times, and all see the same ones
        known, path = self._source(), f"{self.folder}/carry/batch={batch_id}/launches"
        known.write.mode("overwrite").parquet(path)
        self._known = self.spark.read.schema(known.schema).parquet(path)
        try:
            self._process(batch, batch_id, ending)
        finally:
            self._known = None

    def launches(self) -> DataFrame:
        """Launch parameters: as of the batch in process, else as of now."""
        return self._source() if self._known is None else self._known

    def _process(self, batch: DataFrame, batch_id: int, ending: bool) -> None:
        carry = self._carry(batch_id - 1)
        # newest block time ever seen; one row reaches the driver
        newest = batch.agg(F.max("block_timestamp").alias("newest")).first()["newest"]
        if carry and (newest is None or newest < carry.newest):
            newest = carry.newest

        time = F.col("block_timestamp")
        waiting, late = batch, batch.where("false")
        if carry:
            # trades without a time are never late
            passed = F.coalesce(time <= self._mark(carry.newest), F.lit(False))
            late = batch.where(passed)
            waiting = batch.where(~passed).unionByName(carry.pending)
        self.late_table.write(late, batch_id)
        here = f"{self.folder}/carry/batch={batch_id}"
        ready = F.lit(True) if ending else F.coalesce(time <= self._mark(newest), F.lit(True))
        (
            # a log row may be delivered twice; legs of one transaction differ in trader, side or amounts
            waiting.dropDuplicates(SAME_TRADE).withColumn("ready", ready).write.mode("overwrite").parquet(f"{here}/trades")
        )
        ready = self.spark.read.parquet(f"{here}/trades").where("ready").drop("ready")

        keyed = self._states(ready, carry).withColumn("trade_date", day_text("block_timestamp"))
        stored = self.state_table.write(keyed, batch_id)
        self._store_balances(ready, carry, batch_id)
        first_hour = carry.first_hour if carry else None
        if self.with_alerts:
            first_hour = self._store_alerts(stored, ready, carry, newest, batch_id, ending)
        if self.marts:
            self.marts.update(stored, ready, batch_id)
        clock = self.spark.createDataFrame([(newest, first_hour)], "newest timestamp_ntz, first_hour long")
        clock.write.mode("overwrite").parquet(f"{here}/clock")
        if batch_id >= KEPT:
            remove(self.spark, f"{self.folder}/carry/batch={batch_id - KEPT}")

    def _mark(self, newest) -> Column:
        """Watermark: the newest block time less the allowed delay."""
        return F.lit(newest).cast("timestamp_ntz") - F.expr(f"interval {self.delay}")

    # ------------------------------------------------------------------ results
    def states(self) -> DataFrame:
        """Stored states and provisional ones for the trades still inside the watermark delay."""
        last = self._last_batch()
        stored, carry = self.state_table.read(last).drop("trade_date"), self._carry(last)
        return stored.unionByName(self._states(carry.pending, carry)) if carry else stored

    def alerts(self) -> DataFrame:
        return self.alert_table.read(self._last_batch()).select(*ALERTS)

    def late(self) -> DataFrame:
        return self.late_table.read(self._last_batch())

    # ------------------------------------------------------------------ carried state
    def _last_batch(self) -> int:
        """Newest finished batch: its clock is written last. Reads the folder names only."""
        done = self.spark.read.parquet(f"{self.folder}/carry/batch=*/clock").select(F.input_file_name().alias("file"))
        found = done.select(F.regexp_extract("file", r"batch=(\d+)/clock", 1).cast("int").alias("batch"))
        return found.agg(F.max("batch")).first()[0]

    def _carry(self, batch_id: int) -> _Carry | None:
        if batch_id < 0:
            return None
        base = f"{self.folder}/carry/batch={batch_id}"
        newest, first_hour = self.spark.read.parquet(f"{base}/clock").first()
        if newest is None:  # only empty batches so far
            return None
        read = self.spark.read.parquet
        early = read(f"{base}/early") if self.with_alerts else None
        return _Carry(newest, first_hour, read(f"{base}/trades").where("not ready").drop("ready"), read(f"{base}/balances"), early)

    def _states(self, ready: DataFrame, carry: _Carry | None) -> DataFrame:
        return curve.trade_states(
            ready, self.launches(), self.slices, self.thresholds, track_creator=True,
            opening=carry.balances if carry else None,
        )

    def _store_balances(self, ready: DataFrame, carry: _Carry | None, batch_id: int) -> None:
        """Balances per curve after this batch: sums of all trades, known curve or not."""
        creators = self.launches().select("curve_address", F.col("creator_address").alias("trader_address")).distinct()
        own = spread_join(ready, creators, ["curve_address", "trader_address"], by="tx_hash")
        creator = own.groupBy("curve_address").agg(
            F.sum(signed("token_amount")).alias("creator_balance"), sum_if(is_sell(), "token_amount").alias("creator_sold")
        )
        moved = ready.groupBy("curve_address").agg(
            F.sum(signed("base_asset_amount")).alias("base"), F.sum(signed("token_amount")).alias("tokens")
        )
        balances = moved.join(creator, "curve_address", "left").select(
            "curve_address", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in curve.RUNNING]
        )
        if carry:
            balances = balances.unionByName(carry.balances).groupBy("curve_address").agg(
                *[F.sum(name).alias(name) for name in curve.RUNNING]
            )
        balances.write.mode("overwrite").parquet(f"{self.folder}/carry/batch={batch_id}/balances")

    # ------------------------------------------------------------------ alerts
    def _store_alerts(
        self, stored: DataFrame, ready: DataFrame, carry: _Carry | None, newest, batch_id: int, ending: bool
    ) -> int | None:
        """Alerts of this batch by identity; returns the first hour of the tape."""
        none = F.lit("").alias("alert_key")
        raised = alerts.keyed_trade_alerts(stored, self.thresholds)
        hijacks = self._hijacks(ready, carry, batch_id).select(*ALERTS, none)
        first_hour, spikes = self._spikes(ready, carry, newest, batch_id, ending)
        spikes = spikes.select(*ALERTS, F.col("event_ts").cast("string").alias("alert_key"))
        rows = raised.unionByName(hijacks).unionByName(spikes)
        self.alert_table.write(rows.withColumn("batch_id", F.lit(batch_id)), batch_id)
        return first_hour

    def _hijacks(self, ready: DataFrame, carry: _Carry | None, batch_id: int) -> DataFrame:
        """Curves whose launch blocks are over the limit, where this batch changed what is known of them.

        The buys of launch blocks so far are carried on: at most a few rows per curve.
        """
        keys, launches = ["curve_address", "block_number"], self.launches()
        blocks = risk.bought_by_block(ready).join(risk.launch_blocks(launches, self.thresholds).select(*keys).distinct(), keys)
        if carry:
            blocks = blocks.unionByName(carry.early).groupBy(*keys).agg(
                F.sum("tokens").alias("tokens"), F.max("last_buy").alias("last_buy")
            )
        path = f"{self.folder}/carry/batch={batch_id}/early"
        blocks.write.mode("overwrite").parquet(path)
        now = alerts.sniper_hijack(risk.penetration(self.spark.read.parquet(path), launches, self.thresholds), self.thresholds)
        if carry:
            before = alerts.sniper_hijack(risk.penetration(carry.early, launches, self.thresholds), self.thresholds)
            now = now.join(before, ["token_address", "curve_address", "event_ts", "metric_value"], "left_anti")
        return now

    def _spikes(self, ready: DataFrame, carry: _Carry | None, newest, batch_id: int, ending: bool) -> tuple[int | None, DataFrame]:
        """Alerts for the hours that have just closed on a spike, and the first hour of the tape.

        Of earlier hours only those are read that a closing hour is compared with.
        """
        now = self.hour_table.write(alerts.hourly_fees(ready), batch_id)
        known = [h for h in (now.agg(F.min("hour")).first()[0], carry.first_hour if carry else None) if h is not None]
        end = F.col("hour_start") + F.expr("interval 1 hour") + F.expr(f"interval {self.delay}")
        closed = F.lit(True) if ending else end <= F.lit(newest).cast("timestamp_ntz")
        hours = self.hour_table.read(batch_id)
        if carry:
            closed &= end > F.lit(carry.newest).cast("timestamp_ntz")
            oldest = F.lit(carry.newest).cast("timestamp_ntz") - F.expr(f"interval {self.delay}")
            hours = hours.where(F.col("hour") >= hour_index(oldest) - self.thresholds.fee_spike_hours - 1)
        spikes = alerts.fee_spike(hours, self.thresholds, since=min(known, default=0)).where(closed)
        return min(known, default=None), alerts.fee_alerts(spikes, self.thresholds)
