"""Derived columns of a flow record, all as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_UNIT = 1_000_000


def idiv(a: Column, b: Column | int) -> Column:
    """Integer division that stays in bigint."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def start_ms() -> Column:
    return F.col("first") * 1000 + F.col("first_ms")


def end_ms() -> Column:
    return F.col("last") * 1000 + F.col("last_ms")


def duration_ms() -> Column:
    """Milliseconds between first and last packet; a one-packet flow has none."""
    return F.when(F.col("packets") == 1, F.lit(0).cast("long")).otherwise(end_ms() - start_ms())


def rate_bps() -> Column:
    """Whole bits per second, 0 for a flow without duration."""
    d = duration_ms()
    return F.when(d == 0, F.lit(0).cast("long")).otherwise(idiv(F.col("octets") * 8000, d))


def rate_micro_rest() -> Column:
    """What `rate_bps` cuts off, in millionths of a bit per second; summing both parts stays exact in bigint."""
    d = duration_ms()
    rest = (F.col("octets") * 8000) % d
    return F.when(d == 0, F.lit(0).cast("long")).otherwise(idiv(rest * US_PER_UNIT, d))


def x_column(x_value: str) -> Column:
    """The feature a histogram is keyed by."""
    return {
        "length": lambda: F.col("packets"),
        "size": lambda: F.col("octets"),
        "duration": duration_ms,
        "rate": rate_bps,
    }[x_value]()


def log_bin_width(x: Column, bin_exp: int) -> Column:
    """Power-of-two width that leaves `bin_exp` significant bits of `x`."""
    shift = F.greatest(F.lit(0), F.length(F.bin(x)) - F.lit(bin_exp))
    return F.call_function("shiftleft", F.lit(1).cast("long"), shift)


def bin_low(x: Column, bin_exp: int) -> Column:
    """Lower edge of the bin of `x`; unit bins when `bin_exp` is 0."""
    if bin_exp == 0:
        return x.cast("long")
    width = log_bin_width(x, bin_exp)
    return x - x % width


def bin_width(low: Column, bin_exp: int) -> Column:
    """Width of a bin from its lower edge (same number of bits as every value in the bin)."""
    if bin_exp == 0:
        return F.lit(1).cast("long")
    return log_bin_width(low, bin_exp)


def max_log_bins(bin_exp: int) -> int:
    """Largest possible number of log bins over non-negative bigints: the bound behind single-task windows on them."""
    return (1 << bin_exp) + (63 - bin_exp) * (1 << max(0, bin_exp - 1))
