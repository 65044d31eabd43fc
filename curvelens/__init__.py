"""Analytics for tokens launched on bonding curves, written as Spark DataFrame operations."""

from curvelens.contracts import Thresholds
from curvelens.plans.pipeline import Pipeline, RawTables

__all__ = ["Pipeline", "RawTables", "Thresholds"]
