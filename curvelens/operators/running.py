"""Running totals along the tape of each curve, without a whole curve in one task.

A plain window per curve puts all trades of a hot launch into one task. Here the tape is cut into
bounded slices and summed on two levels:

* ordinary slices hold ``blocks`` consecutive blocks of a curve;
* a slice with more than ``max_rows`` trades is cut further, at block borders and at every
  ``tx_run`` transaction positions inside a block.

Per-slice sums (map-side combined) give each slice its opening balance. Launch parameters join those
sums, not the trades. The trades are shuffled once, by slice; they meet their slice's row in a
shuffled hash join (the slice side holds one short row per slice) and the window runs inside the
slice. The list of over-full slices is as long as (all trades / ``max_rows``) at most; whether it is
broadcast is left to the planner.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SliceSpec:
    blocks: int = 1024
    max_rows: int = 1_000_000
    tx_run: int = 1_000_000


# Rows without a block or transaction number come last, as NULLS LAST would put them.
_NO_BLOCK = 2**62
_NO_INDEX = 2**62

TAPE_ORDER = ("block_number", "tx_index", "tx_hash")


def tape_order() -> list[Column]:
    return [F.col(name).asc_nulls_last() for name in TAPE_ORDER]


@dataclass(frozen=True)
class Attached:
    """Rows joined to every slice of their key, and totals that depend on them.

    ``copy`` tells several rows of one key apart. ``deltas`` may use columns of ``rows``;
    ``contributors`` are the trades for which they are not zero, already joined to ``rows`` by an
    equality that includes ``link``.
    """

    rows: DataFrame
    copy: str
    deltas: dict[str, Column] = field(default_factory=dict)
    contributors: DataFrame | None = None
    link: tuple[str, ...] = ()


def _opening(name: str, window) -> Column:
    return F.coalesce(F.sum(name).over(window), F.lit(0.0))


def _placed(trades: DataFrame, spec: SliceSpec) -> DataFrame:
    block = f"coalesce(block_number, {_NO_BLOCK}L)"
    index = f"coalesce(cast(tx_index as bigint), {_NO_INDEX}L)"
    # coalesced to be known as not null: no null filters then set equal aggregates apart
    return trades.selectExpr(
        "*", f"coalesce({block} div {spec.blocks}, 0L) as _bin", f"{block} as _block",
        f"coalesce({index} div {spec.tx_run}, 0L) as _run",
    )


def _sums(deltas: dict[str, Column]) -> list[Column]:
    return [F.sum(delta).alias(f"_sum_{name}") for name, delta in deltas.items()]


def running_totals(
    trades: DataFrame,
    deltas: dict[str, Column],
    spec: SliceSpec = SliceSpec(),
    key: str = "curve_address",
    attached: Attached | None = None,
    only: Column | None = None,
) -> DataFrame:
    """Adds ``<name>_before`` and ``<name>_after`` for every delta, and ``first_of_key``.

    With ``attached``, only trades of its keys remain, once per copy. ``only`` picks the slices whose trades are
    wanted; the others are summed but not walked. It may use the columns of ``attached.rows``, the opening
    balances ``_sum_<name>``, the positive deltas of the slice ``_gross_<name>``, and ``_contributes``: whether
    the slice has contributors.
    """
    moves = _placed(trades.where(F.col(key).isNotNull()), spec)
    late = attached.deltas if attached else {}
    names = [*deltas, *late]
    sums = [f"_sum_{name}" for name in names]
    copies = [attached.copy] if attached else []
    slice_key = [key, "_bin", "_block", "_run"]
    gross = [F.sum(F.greatest(delta, F.lit(0.0))).alias(f"_gross_{name}") for name, delta in deltas.items()] if only is not None else []
    bounds = [f"_gross_{name}" for name in deltas] if gross else []
    if late:  # summed once, by the finest slices
        link = list(attached.link)
        finest = _placed(attached.contributors, spec).groupBy(*slice_key, *link).agg(*_sums(late))

    def with_late_sums(totals: DataFrame, grain: list[str]) -> DataFrame:
        if not late:
            return totals
        own = finest
        if grain != slice_key:
            own = finest.groupBy(*grain, *link).agg(*[F.sum(f"_sum_{name}").alias(f"_sum_{name}") for name in late])
        own = own.withColumn("_contributes", F.lit(True))
        zeros = {f"_sum_{name}": F.coalesce(f"_sum_{name}", F.lit(0.0)) for name in late}
        return totals.join(own, [*grain, *link], "left").withColumns(zeros)

    bins = moves.groupBy(key, "_bin").agg(F.count("*").alias("_rows"), *_sums(deltas), *gross)
    over_full = F.col("_rows") > spec.max_rows
    # The NULL tests never fail. They keep the sums in this plan, so that it is the same aggregate as
    # the one for the balances and Spark computes it once.
    summed = [F.col(f"_sum_{name}").isNotNull() for name in deltas]
    full = bins.where(reduce(Column.__and__, summed, over_full)).select(key, "_bin", F.lit(True).alias("_full"))

    # opening balance of every slice
    along_key = Window.partitionBy(key, *copies).orderBy("_bin")
    before = along_key.rowsBetween(Window.unboundedPreceding, -1)
    per_copy = bins.join(attached.rows, key) if attached else bins
    opened = with_late_sums(per_copy, [key, "_bin"]).withColumns(
        {"_opens_key": F.row_number().over(along_key) == 1} | {s: _opening(s, before) for s in sums}
    )
    whole = opened.where(~over_full).selectExpr("*", "0L as _block", "0L as _run")
    cuts = moves.join(full, [key, "_bin"]).groupBy(*slice_key).agg(*_sums(deltas), *gross)
    along_bin = Window.partitionBy(key, "_bin", *copies).orderBy("_block", "_run")
    before_cut = along_bin.rowsBetween(Window.unboundedPreceding, -1)
    opened_bins = opened.where(over_full).drop("_contributes", *bounds).withColumnsRenamed({s: f"_bin{s}" for s in sums})
    cut = with_late_sums(cuts.join(opened_bins, [key, "_bin"]), slice_key).withColumns(
        {"_opens_key": F.col("_opens_key") & (F.row_number().over(along_bin) == 1)}
        | {s: F.col(f"_bin{s}") + _opening(s, before_cut) for s in sums}
    )
    extra = [c for c in attached.rows.columns if c != key] if attached else []
    columns = [*slice_key, *extra, "_opens_key", *sums]
    told = [*columns, *bounds, *(["_contributes"] if late else [])]
    slices = whole.select(*told).unionByName(cut.select(*told))
    slices = (slices if only is None else slices.where(only)).select(*columns)

    # the trades, shuffled once by slice
    sliced = moves.join(full, [key, "_bin"], "left").withColumns(
        {c: F.when(F.col("_full"), F.col(c)).otherwise(F.lit(0)) for c in ("_block", "_run")}
    )
    inside = Window.partitionBy(*slice_key, *copies).orderBy(*tape_order())
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    moved = {f"_d_{name}": delta for name, delta in (deltas | late).items()}
    walked = sliced.join(slices.hint("shuffle_hash"), slice_key).withColumns(moved).select(
        *trades.columns, *extra, "_opens_key", *sums,
        F.row_number().over(inside).alias("_nth"),
        *[F.sum(f"_d_{name}").over(upto).alias(f"_upto_{name}") for name in names],
        *[_opening(f"_d_{name}", earlier).alias(f"_earlier_{name}") for name in names],
    )
    return walked.selectExpr(
        *trades.columns, *extra,
        "_nth = 1 and _opens_key as first_of_key",
        *[f"_sum_{n} + _earlier_{n} as {n}_before" for n in names],
        *[f"_sum_{n} + _upto_{n} as {n}_after" for n in names],
    )
