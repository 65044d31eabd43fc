"""Windowed aggregates on the swap stream, corrected when trades come late.

A windowed aggregate of the streaming engine drops what comes behind its watermark, and keeps a busy window in
one task. Here each micro-batch is split at the watermark. Trades wait until it passes them; then a trade is
stored once, and a window is computed by the batch operator once the watermark has passed its end. A
trade behind the watermark goes to the side table of late trades, and the windows it belongs to are computed
again from the stored trades of their hours. Results carry the batch they come from; the last one of a window
counts. So what the roll-up shows is always the batch roll-up of all trades delivered so far.

Only closing and corrected windows are computed in a batch, from the trades of the hours they cover.

Tables under the folder (segments of ``SegmentTable``):
  trades/   stored trades, by hour       late/     late trades, with the batch they came in
  windows/  results, by batch            carry/    waiting trades and clock of each batch
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelens.operators import curve, kpis
from curvelens.streaming.segments import FAN, SegmentTable, remove
from curvelens.streaming.sources import SAME_TRADE, WATERMARK


@dataclass(frozen=True)
class Windows:
    """A roll-up: its batch operator, what names a window, and its length and slide in minutes.

    The operator makes rows with ``keys`` and window_start from swaps. Windows start at multiples of the slide.
    """

    operator: Callable[[DataFrame], DataFrame]
    minutes: int
    slide: int
    keys: tuple[str, ...] = ()

    @property
    def grain(self) -> list[str]:
        return [*self.keys, "window_start"]

    def of(self, trades: DataFrame) -> DataFrame:
        """The windows that the trades belong to."""
        seconds = 60 * self.slide
        last = F.floor(F.unix_seconds(F.col("block_timestamp").cast("timestamp")) / seconds) * seconds
        starts = F.transform(F.sequence(F.lit(0), F.lit(self.minutes // self.slide - 1)), lambda k: last - k * seconds)
        # one row per minute and key before a minute is copied into its windows
        some = trades.groupBy(*self.keys, last.alias("__minute")).agg(F.min("block_timestamp").alias("block_timestamp"))
        return some.select(*self.keys, F.explode(starts).alias("__start")).distinct().select(
            *self.keys, F.timestamp_seconds("__start").cast("timestamp_ntz").alias("window_start")
        )


ROLLUP_5M = Windows(kpis.rollup_5m, 5, 5)
INFLOW_15M = Windows(curve.inflow_15m, 15, 1, ("curve_address",))


class LiveRollup:
    """Keeps one roll-up up to date; ``delay`` is how long trades are waited for."""

    def __init__(self, spark: SparkSession, folder: str, windows: Windows, delay: str = WATERMARK, fan: int = FAN):
        self.spark, self.folder, self.windows, self.delay = spark, folder.rstrip("/"), windows, delay
        self.trades = SegmentTable(spark, f"{self.folder}/trades", partition="hour", fan=fan)
        self.late_trades = SegmentTable(spark, f"{self.folder}/late", fan=fan)
        self.results = SegmentTable(spark, f"{self.folder}/windows", self._latest, fan=fan)

    def _latest(self, rows: DataFrame) -> DataFrame:
        """Of every window, the result of the last batch that computed it."""
        grain = self.windows.grain
        return rows.groupBy(*grain).agg(F.max_by(F.struct(*rows.columns), "batch_id").alias("r")).select("r.*")

    def start(self, swaps: DataFrame, trigger: dict | None = None):
        """Starts the query; by default it processes what is available now and ends."""
        return (
            swaps.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.folder}/checkpoint")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def process(self, batch: DataFrame, batch_id: int) -> None:
        before = self._clock(batch_id - 1)
        time = F.col("block_timestamp")
        batch = batch.where(time.isNotNull())  # a trade without a time belongs to no window
        newest = max((t for t in (batch.agg(F.max(time)).first()[0], before) if t is not None), default=None)
        here = f"{self.folder}/carry/batch={batch_id}"
        passed = time <= self._mark(before) if before else F.lit(False)
        waiting = batch.where(~passed)
        if batch_id:
            waiting = waiting.unionByName(self._waiting(batch_id - 1))
        final = time <= self._mark(newest) if newest else F.lit(False)
        waiting.dropDuplicates(SAME_TRADE).withColumn("ready", final).write.mode("overwrite").parquet(f"{here}/trades")
        ready = self.spark.read.parquet(f"{here}/trades").where("ready").drop("ready")

        late = self.late_trades.write(self._new(batch.where(passed), batch_id).withColumn("batch_id", F.lit(batch_id)), batch_id)
        hour = F.date_trunc("hour", time).cast("string")
        self.trades.write(ready.unionByName(late.drop("batch_id")).withColumn("hour", hour), batch_id)
        self.results.write(self._computed(late, before, newest, batch_id), batch_id)
        clock = self.spark.createDataFrame([(newest,)], "newest timestamp_ntz")
        clock.write.mode("overwrite").parquet(f"{here}/clock")
        if batch_id > 2:
            remove(self.spark, f"{self.folder}/carry/batch={batch_id - 3}")

    # ------------------------------------------------------------------ results
    def final(self) -> DataFrame:
        """Windows behind the watermark, late trades included."""
        return self.results.read(self._last_batch()).drop("batch_id")

    def current(self) -> DataFrame:
        """Final windows, and provisional ones with the trades that still wait."""
        last = self._last_batch()
        final, waiting = self.final(), self._waiting(last)
        newest = self._clock(last)
        if newest is None:
            return final
        since = self._mark(newest) - F.expr(f"interval {self.windows.minutes} minutes")
        open_ = self._hours(last, since).where(F.col("block_timestamp") > since).unionByName(waiting)
        return final.unionByName(self._windows(open_).where(~self._closed(newest)).select(final.columns))

    def late(self) -> DataFrame:
        return self.late_trades.read(self._last_batch())

    # ------------------------------------------------------------------ steps
    def _mark(self, newest: datetime) -> Column:
        return F.lit(newest).cast("timestamp_ntz") - F.expr(f"interval {self.delay}")

    def _closed(self, newest: datetime) -> Column:
        return F.col("window_start") + F.expr(f"interval {self.windows.minutes} minutes") <= self._mark(newest)

    def _windows(self, trades: DataFrame) -> DataFrame:
        return self.windows.operator(trades)

    def _hours(self, batch_id: int, since: Column) -> DataFrame:
        """Stored trades of the hours from ``since`` on."""
        return self.trades.read(batch_id).where(F.col("hour") >= F.date_trunc("hour", since).cast("string")).drop("hour")

    def _new(self, late: DataFrame, batch_id: int) -> DataFrame:
        """Late trades that were not stored before: a trade may also be delivered again."""
        late = late.dropDuplicates(SAME_TRADE)
        if not batch_id:
            return late
        hour = F.date_trunc("hour", "block_timestamp").cast("string")
        hours = late.select(hour.alias("hour")).distinct()
        stored = self.trades.read(batch_id - 1).join(hours, "hour", "left_semi").select(*[F.col(c).alias(f"_{c}") for c in SAME_TRADE])
        same = None
        for c in SAME_TRADE:
            equal = F.col(c).eqNullSafe(F.col(f"_{c}"))
            same = equal if same is None else same & equal
        return late.join(stored, same, "left_anti")

    def _computed(self, late: DataFrame, before: datetime | None, newest: datetime | None, batch_id: int) -> DataFrame:
        """Windows that close in this batch, and closed ones that late trades change."""
        length = F.expr(f"interval {self.windows.minutes} minutes")
        trades = self.trades.read(batch_id)
        if newest is None:
            return self._windows(trades.drop("hour")).withColumn("batch_id", F.lit(batch_id)).where("false")
        closes = self._closed(newest)
        recent = trades
        if before:
            closes &= ~self._closed(before)
            recent = trades.where(F.col("hour") >= F.date_trunc("hour", self._mark(before) - length).cast("string"))
        closing = self._windows(recent.drop("hour")).where(closes)
        changed = self.windows.of(late)
        if before:
            changed = changed.where(self._closed(before))
        hours = F.sequence(
            F.date_trunc("hour", "window_start"), F.date_trunc("hour", F.col("window_start") + length), F.expr("interval 1 hour")
        )
        hours = changed.select(F.explode(hours.cast("array<string>")).alias("hour")).distinct()
        again = trades.join(hours, "hour", "left_semi").drop("hour")
        corrected = self._windows(again).join(changed, self.windows.grain, "left_semi")
        return closing.unionByName(corrected.select(closing.columns)).withColumn("batch_id", F.lit(batch_id))

    # ------------------------------------------------------------------ carried state
    def _last_batch(self) -> int:
        """Newest finished batch: its clock is written last. Reads the folder names only."""
        done = self.spark.read.parquet(f"{self.folder}/carry/batch=*/clock").select(F.input_file_name().alias("file"))
        return done.agg(F.max(F.regexp_extract("file", r"batch=(\d+)/clock", 1).cast("int"))).first()[0]

    def _clock(self, batch_id: int) -> datetime | None:
        return self.spark.read.parquet(f"{self.folder}/carry/batch={batch_id}/clock").first()[0] if batch_id >= 0 else None

    def _waiting(self, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/carry/batch={batch_id}/trades").where("not ready").drop("ready")
