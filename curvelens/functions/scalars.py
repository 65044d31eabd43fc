"""Column expressions shared by the operators. All stay inside JVM code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_MINUTE = 60_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """Quotient that is NULL, not an error, for a zero denominator."""
    return col(numerator) / F.nullif(col(denominator), F.lit(0.0))


def rounded(value: str | Column, places: int) -> Column:
    """Value at a number of decimal places, halves away from zero.

    The half is judged on the scaled double, as the SQL engines of the published results do; Spark's
    own ``round`` judges it on the decimal text and so differs on values such as 6.94875.
    """
    scale = float(10**places)
    return F.round(col(value) * scale, 0) / scale


def steady(value: str | Column, places: int) -> Column:
    """:func:`rounded` for a ratio of sums, with the same outcome on every run.

    The order in which a cluster adds doubles varies, which moves a sum in its last bits and can tip a
    value that lies on a rounding tie. Nine places first remove that noise.
    """
    return rounded(rounded(value, 9), places)


def first_match(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """Label of the first rule that holds."""
    out = F
    for condition, label in rules:
        out = out.when(condition, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def is_buy() -> Column:
    return F.col("trade_type") == "BUY"


def is_sell() -> Column:
    return F.col("trade_type") == "SELL"


def signed(amount: str | Column, into_curve: Column | None = None) -> Column:
    """Amount counted positive for a BUY and negative for any other trade type, NULL included."""
    into_curve = is_buy() if into_curve is None else into_curve
    return F.when(into_curve, col(amount)).otherwise(-col(amount))


def sum_if(condition: Column, amount: str | Column) -> Column:
    return F.sum(F.when(condition, col(amount)).otherwise(F.lit(0.0)))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def fill_pct(collected: str | Column, threshold: str | Column) -> Column:
    """Percent of the graduation threshold collected, in [0, 100], two places.

    ``least``/``greatest`` skip NULLs, so a zero or missing threshold yields 0.
    """
    share = ratio(collected, threshold) * 100.0
    return rounded(F.least(F.lit(100.0), F.greatest(F.lit(0.0), share)), 2)


def spot_price(base_reserve: Column, token_reserve: Column) -> Column:
    return ratio(base_reserve, token_reserve)


def share_pct(part: str | Column, whole: str | Column, places: int = 2) -> Column:
    """``part`` as percent of ``whole``; 0 when the whole is not positive."""
    return F.when(col(whole) > 0, rounded(col(part) / col(whole) * 100.0, places)).otherwise(F.lit(0.0))


# --------------------------------------------------------------------------- time
# Timestamps are zone-free (TIMESTAMP_NTZ); none of these depends on the session time zone.

def day_text(ts: str | Column) -> Column:
    """Calendar day as 'YYYY-MM-DD'."""
    return F.to_date(col(ts)).cast("string")


def day_start(ts: str | Column) -> Column:
    return F.to_date(col(ts)).cast("timestamp_ntz")


def hour_index(ts: str | Column) -> Column:
    """Whole hours since 1970."""
    return F.unix_date(F.to_date(col(ts))).cast("long") * 24 + F.hour(col(ts))


def minute_index(ts: str | Column) -> Column:
    return hour_index(ts) * 60 + F.minute(col(ts))


def epoch_micros(ts: str | Column) -> Column:
    seconds = F.date_part(F.lit("SECOND"), col(ts))
    return minute_index(ts) * MICROS_PER_MINUTE + (seconds * 1_000_000).cast("long")


def minutes_between(start: str | Column, end: str | Column) -> Column:
    """Completed minutes from start to end, truncated toward zero."""
    return ((epoch_micros(end) - epoch_micros(start)) / MICROS_PER_MINUTE).cast("long")


def from_minute_index(minutes: str | Column) -> Column:
    """Inverse of :func:`minute_index` as TIMESTAMP_NTZ."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(mins=col(minutes).cast("int"))


def position() -> Column:
    """Place of a trade on the tape, comparable across the rows of one curve."""
    return F.struct("block_number", "tx_index", "tx_hash")
