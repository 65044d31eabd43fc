"""The whole dependency graph: raw tables -> staging -> curve state -> wallets, velocity -> marts -> reports.

Every stage is a lazy DataFrame, built once per pipeline. Nothing runs until a result is written or
collected, and a query plans only the columns and stages it uses.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from curvelens.contracts import GRAINS, Thresholds
from curvelens.functions.scalars import day_text
from curvelens.operators import alerts, curve, kpis, marts, quality, risk, staging, velocity, wallets
from curvelens.operators.running import SliceSpec
from curvelens.session import shared_dir
from curvelens.sources import chain
from curvelens.sources.event_tape import EventTape
from curvelens.sources.tables import write_mart


@dataclass(frozen=True)
class RawTables:
    """Raw inputs. The on-chain logs are optional: only the log-based queries read them."""

    swaps: DataFrame
    curve_events: DataFrame
    transfers: DataFrame | None = None
    chain_swaps: DataFrame | None = None
    chain_curves: DataFrame | None = None

    @staticmethod
    def from_events(spark: SparkSession, folder: str) -> EventTape:
        """Launch data derived from a generic event table, with the same attributes."""
        return EventTape(spark, folder)

    @classmethod
    def from_chain(cls, chain_swaps: DataFrame, chain_curves: DataFrame) -> RawTables:
        """Raw contracts derived from decoded on-chain logs alone."""
        return cls(
            swaps=chain.to_raw_swaps(chain.decode_swaps(chain_swaps)),
            curve_events=chain.to_raw_curve_events(chain.decode_curves(chain_curves)),
            chain_swaps=chain_swaps,
            chain_curves=chain_curves,
        )


class Pipeline:
    """Named stages over one set of raw tables.

    ``close`` ('max' or 'last') picks the daily closing price, ``status`` ('instant' or 'sticky')
    whether a curve can fall back from GRADUATED; the defaults are the published definitions.
    """

    def __init__(
        self,
        raw: RawTables | EventTape,
        thresholds: Thresholds = Thresholds(),
        slices: SliceSpec = SliceSpec(),
        close: str = "max",
        status: str = "instant",
        totals: str = "fact",
    ):
        if close not in ("max", "last"):
            raise ValueError(f"unknown close: {close}")
        if status not in ("instant", "sticky"):
            raise ValueError(f"unknown status: {status}")
        self.raw, self.thresholds, self.slices = raw, thresholds, slices
        self.close, self.status, self.totals = close, status, totals

    # ------------------------------------------------------------------ staging
    @cached_property
    def swaps(self) -> DataFrame:
        return staging.stage_swaps(self.raw.swaps)

    @cached_property
    def curve_events(self) -> DataFrame:
        return staging.stage_curve_events(self.raw.curve_events)

    @cached_property
    def transfers(self) -> DataFrame:
        return staging.stage_transfers(self.raw.transfers)

    @cached_property
    def meta(self) -> DataFrame:
        return staging.curve_meta(self.curve_events)

    @cached_property
    def log(self) -> DataFrame:
        return chain.decode_swaps(self.raw.chain_swaps)

    @cached_property
    def log_curves(self) -> DataFrame:
        return chain.decode_curves(self.raw.chain_curves)

    # ------------------------------------------------------------------ curve
    @cached_property
    def states(self) -> DataFrame:
        return curve.trade_states(self.swaps, self.meta, self.slices, self.thresholds, status=self.status)

    @cached_property
    def tracked_states(self) -> DataFrame:
        return curve.trade_states(
            self.swaps, self.meta, self.slices, self.thresholds, track_creator=True, status=self.status
        )

    @cached_property
    def curve_state(self) -> DataFrame:
        return curve.curve_state(self.states)

    @cached_property
    def curve_reserves(self) -> DataFrame:
        return curve.curve_reserves(self.states)

    @cached_property
    def time_to_graduation(self) -> DataFrame:
        some = self._some_states("graduated") if self.status == "instant" else self.states
        return curve.time_to_graduation(some)

    def _some_states(self, only: str) -> DataFrame:
        """States of the slices that matter; all of them where they have been written already."""
        stored, creator = self.__dict__.get("states"), only == "creator"
        if stored is not None and stored is self.__dict__.get("tracked_states"):
            return stored
        return curve.trade_states(
            self.swaps, self.meta, self.slices, self.thresholds, track_creator=creator, status=self.status, only=only
        )

    @cached_property
    def curve_monitor(self) -> DataFrame:
        return curve.curve_monitor(self.log, self.log_curves, self.thresholds)

    @cached_property
    def graduation_radar(self) -> DataFrame:
        return curve.graduation_radar(self.curve_monitor)

    @cached_property
    def depth_matrix(self) -> DataFrame:
        return curve.depth_matrix(self.swaps, self.meta, self.thresholds)

    @cached_property
    def graduation_eta(self) -> DataFrame:
        return curve.graduation_eta(self.swaps, self.meta, self.thresholds)

    @cached_property
    def inflow_15m(self) -> DataFrame:
        return curve.inflow_15m(self.swaps, self.thresholds)

    @cached_property
    def fill_leaderboard(self) -> DataFrame:
        return curve.fill_leaderboard(self.swaps, self.meta)

    # ------------------------------------------------------------------ wallets
    @cached_property
    def wallet_base(self) -> DataFrame:
        return wallets.wallet_base(self.swaps, self.meta, self.thresholds)

    @cached_property
    def wallet_clusters(self) -> DataFrame:
        return wallets.wallet_clusters(self.wallet_base)

    @cached_property
    def wallet_forensics(self) -> DataFrame:
        return wallets.wallet_forensics(self.log, self.log_curves, self.thresholds)

    @cached_property
    def holder_rank(self) -> DataFrame:
        return wallets.holder_ranks(self.wallet_forensics)

    def supply_concentration(self, denominator: str = "total") -> DataFrame:
        return wallets.supply_concentration(self.wallet_forensics, self.thresholds, denominator)

    @cached_property
    def organic_bot_share(self) -> DataFrame:
        return wallets.organic_bot_share(self.wallet_base, self.thresholds)

    # ------------------------------------------------------------------ risk and alerts
    @cached_property
    def sniper_penetration(self) -> DataFrame:
        return risk.sniper_penetration(self.swaps, self.meta, self.thresholds)

    @cached_property
    def dev_activity(self) -> DataFrame:
        return risk.dev_activity(self._some_states("creator"))

    @cached_property
    def dump_risk(self) -> DataFrame:
        return risk.dump_risk(self.dev_activity, self.thresholds)

    @cached_property
    def alerts(self) -> DataFrame:
        return alerts.alerts(self.tracked_states, self.sniper_penetration, self.thresholds)

    @cached_property
    def fee_spike(self) -> DataFrame:
        return alerts.fee_spike(alerts.hourly_fees(self.swaps), self.thresholds)

    # ------------------------------------------------------------------ velocity
    @cached_property
    def token_velocity(self) -> DataFrame:
        return velocity.token_velocity(self.states, self.swaps, self.meta, self.thresholds, self.close)

    @cached_property
    def velocity_profile(self) -> DataFrame:
        return velocity.velocity_profile(self.log, self.log_curves, self.thresholds)

    @cached_property
    def velocity_24h(self) -> DataFrame:
        return velocity.velocity_24h(self.swaps, self.meta)

    @cached_property
    def retention(self) -> DataFrame:
        return velocity.retention(self.swaps, self.thresholds)

    # ------------------------------------------------------------------ marts
    @cached_property
    def fct_trades(self) -> DataFrame:
        return marts.fct_trades(self.states, self.wallet_clusters)

    @cached_property
    def fct_curve_daily(self) -> DataFrame:
        return marts.fct_curve_daily(
            self.states, self.swaps, self.wallet_clusters, self.meta, self.thresholds, self.close
        )

    @cached_property
    def dim_wallets(self) -> DataFrame:
        return wallets.dim_wallets(self.wallet_base, self.thresholds)

    @cached_property
    def dim_tokens(self) -> DataFrame:
        return marts.dim_tokens(
            self.states, self.swaps, self.wallet_clusters, self.meta, self.thresholds, self.totals
        )

    # ------------------------------------------------------------------ dashboards
    @cached_property
    def dash_active_curves(self) -> DataFrame:
        return kpis.dash_active_curves(self.dim_tokens)

    @cached_property
    def dash_daily_velocity(self) -> DataFrame:
        return kpis.dash_daily_velocity(self.fct_curve_daily)

    @cached_property
    def dash_wallet_segments(self) -> DataFrame:
        return kpis.dash_wallet_segments(self.dim_wallets)

    @cached_property
    def kpi_summary(self) -> DataFrame:
        return kpis.kpi_summary(self.states, self.meta, self.thresholds, self.close)

    @cached_property
    def protocol_kpis(self) -> DataFrame:
        return kpis.protocol_kpis(self.swaps, self.meta, self.time_to_graduation)

    @cached_property
    def rollup_5m(self) -> DataFrame:
        return kpis.rollup_5m(self.swaps)

    # ------------------------------------------------------------------ quality
    def tables(self) -> dict[str, DataFrame]:
        """Tables with a declared grain."""
        found = {
            "raw_swaps": self.raw.swaps,
            "raw_curve_events": self.raw.curve_events,
            "fct_trades": self.fct_trades,
            "fct_curve_daily": self.fct_curve_daily,
            "dim_wallets": self.dim_wallets,
            "dim_tokens": self.dim_tokens,
        }
        return {name: found[name] for name in GRAINS}

    def check(self, name: str) -> DataFrame:
        if name == "graduation":
            return quality.check_graduation(self.dim_tokens, self.thresholds)
        if name == "snipers":
            return quality.check_snipers(self.wallet_clusters, self.thresholds)
        if name == "whales":
            return quality.check_whales(self.dim_wallets, self.thresholds)
        if name == "velocity":
            return quality.check_velocity(self.token_velocity)
        if name == "wallet_grain":
            return quality.check_wallet_grain(self.swaps, self.meta, self.dim_wallets)
        if name == "grain":  # all marts at once, from one build of what they share
            return quality.check_grain(self.materialised().tables())
        raise ValueError(f"unknown check: {name}")

    CHECKS = ("graduation", "snipers", "whales", "velocity", "wallet_grain", "grain")

    # ------------------------------------------------------------------ materialisation
    def register_views(self) -> None:
        """Staging, intermediate and mart stages as temporary views for SQL users."""
        views = {
            "stg_swaps": self.swaps, "stg_curve_events": self.curve_events,
            "curve_state": self.curve_state, "wallet_clusters": self.wallet_clusters,
            "token_velocity": self.token_velocity, "fct_trades": self.fct_trades,
            "fct_curve_daily": self.fct_curve_daily, "dim_wallets": self.dim_wallets, "dim_tokens": self.dim_tokens,
        }
        if self.raw.transfers is not None:
            views["stg_transfers"] = self.transfers
        for name, df in views.items():
            df.createOrReplaceTempView(name)

    def materialised(self, path: str | None = None) -> Pipeline:
        """The same pipeline with the per-trade states and the wallet rows written once and read back.

        For jobs that need several results: they share these two stages. The tables lie in the cluster's
        shared folder, so a lost executor costs only its own tasks.
        """
        spark = self.raw.swaps.sparkSession
        path = (path or shared_dir(spark, "trade-states")).rstrip("/")
        self.tracked_states.write.mode("overwrite").parquet(path)
        self.wallet_base.write.mode("overwrite").parquet(f"{path}-wallets")
        same = Pipeline(self.raw, self.thresholds, self.slices, self.close, self.status, self.totals)
        same.tracked_states = same.states = spark.read.parquet(path)
        same.wallet_base = spark.read.parquet(f"{path}-wallets")
        return same

    def write_marts(self, folder: str, states_path: str | None = None) -> None:
        """Full refresh of the four marts; the facts are partitioned by day (``trade_date``)."""
        ready = self.materialised(states_path)
        folder = folder.rstrip("/")
        trades = ready.fct_trades.withColumn("trade_date", day_text("block_timestamp"))
        write_mart(trades, f"{folder}/fct_trades", partition_by="trade_date")
        write_mart(ready.fct_curve_daily, f"{folder}/fct_curve_daily", partition_by="trade_date")
        write_mart(ready.dim_wallets, f"{folder}/dim_wallets")
        write_mart(ready.dim_tokens, f"{folder}/dim_tokens")
