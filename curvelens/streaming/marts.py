"""The four marts, kept up to date by micro-batches.

Each batch adds mergeable partial rows: a wallet's measures, what a wallet adds to its token, trader-days and
distinct transaction hashes. Sums, minima and maxima of partial rows are those of all trades, and traders and
curves are counted on keys that stand once after merging, so distinct counts need no trade again.

A batch then writes the partitions of the marts that it touches, whole, from the partial rows as of this
batch. A wallet that gets another cohort or flag also touches the days it traded on. Trades are read again
for touched days only. A batch that is run again writes the same partitions with the same rows.

Launch parameters are expected to be known before the trades of their curve.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvelens.contracts import DIM_TOKENS, DIM_WALLETS, FCT_CURVE_DAILY, FCT_TRADES, Thresholds
from curvelens.functions.scalars import day_text
from curvelens.operators import marts, velocity, wallets
from curvelens.operators.wallets import WALLET_KEY
from curvelens.sources.tables import write_mart
from curvelens.streaming.segments import FAN, SegmentTable

#: Partitions of the dimensions and of the partial rows behind them, unless the job asks for others.
BUCKETS = 16
LABELS = ["behavioral_cohort", "is_sniper", "is_creator"]


def _same(a: list[str], b: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b)])


def _of_keys(rows: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """Rows whose key, nulls included, stands in ``keys``."""
    wanted = keys.select(*[F.col(c).alias(f"_{c}") for c in names]).distinct()
    return rows.join(wanted, _same(names, [f"_{c}" for c in names]), "left_semi")


def _on_days(rows: DataFrame, days: DataFrame) -> DataFrame:
    """Rows of some days, and those without a day."""
    return rows.join(days, "trade_date", "left_semi").unionByName(rows.where(F.col("trade_date").isNull()))


class LiveMarts:
    """Marts under ``folder``/marts; ``states`` is the table of stored trade states, by trade_date."""

    def __init__(
        self, spark: SparkSession, folder: str, launches: Callable[[], DataFrame], states: SegmentTable,
        thresholds: Thresholds = Thresholds(), fan: int = FAN, buckets: int = BUCKETS,
    ):
        self.spark, self.folder, self.launches, self.states = spark, f"{folder.rstrip('/')}/marts", launches, states
        self.thresholds, self.buckets, self.carry = thresholds, buckets, f"{folder.rstrip('/')}/carry"

        def table(name: str, merge, partition: str) -> SegmentTable:
            return SegmentTable(spark, f"{folder.rstrip('/')}/partial/{name}", merge, partition, fan)

        hashes = [*marts.TOKEN_KEY, "tx_hash"]
        by_wallet = lambda rows: rows.groupBy("bucket", *WALLET_KEY).agg(*wallets.merged_measures())
        self.measures = table("wallets", lambda r: by_wallet(r).select(*[c for c in r.columns if c != "bucket"], "bucket"), "bucket")
        self.lives = table("token_wallets", lambda r: marts.merged_token_wallets(r).withColumn("bucket", self._bucket("curve_address")), "bucket")
        self.days = table("trader_days", lambda r: self._day_last(velocity.merged_trader_days(r)), "trade_date")
        self.hashes = table("transactions", lambda r: r.select(*hashes, "bucket").distinct(), "bucket")

    # ------------------------------------------------------------------ results
    def fct_trades(self) -> DataFrame:
        return self._mart("fct_trades", FCT_TRADES)

    def fct_curve_daily(self) -> DataFrame:
        return self._mart("fct_curve_daily", FCT_CURVE_DAILY)

    def dim_wallets(self) -> DataFrame:
        return self._mart("dim_wallets", DIM_WALLETS)

    def dim_tokens(self) -> DataFrame:
        """Tokens of touched partitions as written, launches of the others with zeros."""
        written = self._mart("dim_tokens", DIM_TOKENS)
        none = self._token_rows(self.lives.read(-1), self.hashes.read(-1), self.launches())
        return written.unionByName(none.join(written.select(*marts.TOKEN_KEY), marts.TOKEN_KEY, "left_anti"))

    def _mart(self, name: str, columns: list[str]) -> DataFrame:
        found = self.spark.read.parquet(f"{self.folder}/{name}")
        if "trade_date" in columns:
            found = found.withColumn("trade_date", F.col("trade_date").cast("string"))
        return found.select(*columns)

    # ------------------------------------------------------------------ one batch
    def update(self, stored: DataFrame, ready: DataFrame, batch_id: int) -> None:
        """``stored``: the batch's states with their trade_date; ``ready``: its staged swaps."""
        self._add(stored, ready, batch_id)
        touched = ready.select(*WALLET_KEY).distinct()
        relabelled = self._relabelled(touched, batch_id)
        moved = _of_keys(self.days.read(batch_id), relabelled, WALLET_KEY).select("trade_date")
        days = stored.select("trade_date").union(moved).distinct()
        labels = wallets.wallet_clusters(self._classified(self.measures.read(batch_id))).select(*WALLET_KEY, *LABELS)
        # both facts read them
        self._write_facts(self._stored(days, "days", batch_id), self._stored(labels, "labels", batch_id), batch_id)
        self._write_wallets(touched, batch_id)
        self._write_tokens(touched, batch_id)

    def _add(self, stored: DataFrame, ready: DataFrame, batch_id: int) -> None:
        measured = ready.groupBy(*WALLET_KEY).agg(
            *wallets.wallet_measures(), F.sum("gas_price_gwei").alias("gas_sum"), F.count("gas_price_gwei").alias("gas_count")
        ).drop("avg_gas_gwei")
        self.measures.write(measured.withColumn("bucket", self._bucket("trader_address")), batch_id)
        self.lives.write(marts.token_wallets(stored).withColumn("bucket", self._bucket("curve_address")), batch_id)
        self.days.write(self._day_last(velocity.trader_days(stored)), batch_id)
        hashes = ready.select(*marts.TOKEN_KEY, "tx_hash").distinct()
        self.hashes.write(hashes.withColumn("bucket", self._bucket("curve_address")), batch_id)

    @staticmethod
    def _day_last(days: DataFrame) -> DataFrame:
        return days.select(*[c for c in days.columns if c != "trade_date"], "trade_date")

    def _classified(self, measures: DataFrame) -> DataFrame:
        mean = F.when(F.col("gas_count") > 0, F.col("gas_sum") / F.col("gas_count"))
        rows = measures.withColumn("avg_gas_gwei", mean).drop("gas_sum", "gas_count", "bucket")
        return wallets.classified(rows, self.launches(), self.thresholds)

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _in_buckets(self, rows: DataFrame, key: str, touched: DataFrame) -> DataFrame:
        buckets = touched.select(self._bucket(key).alias("bucket")).distinct()  # a row for each bucket at most
        return rows.join(F.broadcast(buckets), "bucket", "left_semi")

    def _relabelled(self, touched: DataFrame, batch_id: int) -> DataFrame:
        """Wallets with earlier trades whose cohort or flags change with this batch."""
        if not batch_id:
            return touched.where("false")

        def labels(upto: int) -> DataFrame:
            rows = _of_keys(self._in_buckets(self.measures.read(upto), "trader_address", touched), touched, WALLET_KEY)
            return self._classified(rows).select(*WALLET_KEY, "creator_address", *LABELS)

        before = labels(batch_id - 1)
        old = before.select(*[F.col(c).alias(f"_{c}") for c in before.columns])
        key = [*WALLET_KEY, "creator_address"]
        both = labels(batch_id).join(old, _same(key, [f"_{c}" for c in key]))
        return both.where(~_same(LABELS, [f"_{c}" for c in LABELS])).select(*WALLET_KEY)

    def _stored(self, rows: DataFrame, name: str, batch_id: int) -> DataFrame:
        path = f"{self.carry}/batch={batch_id}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _write_facts(self, days: DataFrame, labels: DataFrame, batch_id: int) -> None:
        states = _on_days(self.states.read(batch_id), days)
        trades = marts.fct_trades(states, labels).withColumn("trade_date", day_text("block_timestamp"))
        write_mart(trades, f"{self.folder}/fct_trades", partition_by="trade_date", dynamic=True)
        rows = _on_days(self.days.read(batch_id), days)
        daily = marts.daily_fact(rows, states.drop("trade_date"), labels, self.launches(), self.thresholds)
        write_mart(daily, f"{self.folder}/fct_curve_daily", partition_by="trade_date", dynamic=True)

    def _write_wallets(self, touched: DataFrame, batch_id: int) -> None:
        rows = self._in_buckets(self.measures.read(batch_id), "trader_address", touched)
        segments = wallets.dim_wallets(self._classified(rows), self.thresholds)
        write_mart(segments.withColumn("bucket", self._bucket("trader_address")), f"{self.folder}/dim_wallets", "bucket", dynamic=True)

    def _token_rows(self, lives: DataFrame, hashes: DataFrame, launches: DataFrame) -> DataFrame:
        counted = hashes.groupBy(*marts.TOKEN_KEY).agg(F.count("tx_hash").alias("tx_count"))
        copies = lives.select(*WALLET_KEY).join(wallets.creators(launches).select("curve_address"), "curve_address")
        return marts.token_rows(lives.drop("bucket"), counted, copies, launches, self.thresholds)

    def _write_tokens(self, touched: DataFrame, batch_id: int) -> None:
        pick = lambda rows: self._in_buckets(rows, "curve_address", touched)
        launches = pick(self.launches().withColumn("bucket", self._bucket("curve_address"))).drop("bucket")
        rows = self._token_rows(pick(self.lives.read(batch_id)), pick(self.hashes.read(batch_id)), launches)
        write_mart(rows.withColumn("bucket", self._bucket("curve_address")), f"{self.folder}/dim_tokens", "bucket", dynamic=True)
