"""Histograms of flow length, size, duration and rate."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions import flowcols as fc


def _extra_sum(name: str) -> Column:
    if name == "duration":
        return F.sum(fc.duration_ms())
    if name == "rate":
        return F.sum(fc.rate_bps()) + fc.idiv(F.sum(fc.rate_micro_rest()), fc.US_PER_UNIT)
    return F.sum(name)


def hist(flows: DataFrame, x_value: str = "length", bin_exp: int = 0, additional: Sequence[str] = (),
         where: str | Column | None = None) -> DataFrame:
    """Flows, packets and octets per bin of `x_value`: one partial/final hash aggregate on the bin itself.

    `bin_exp` keeps that many leading bits of the value (0 = bins of width 1). `additional` may name duration,
    rate and aggs. Sums are exact integers.
    """
    rows = flows if where is None else flows.filter(where)
    return (
        rows.groupBy(fc.bin_low(fc.x_column(x_value), bin_exp).alias("bin_lo"))
        .agg(
            F.count("*").alias("flows_sum"),
            F.sum("packets").alias("packets_sum"),
            F.sum("octets").alias("octets_sum"),
            *[_extra_sum(a).alias(f"{a}_sum") for a in additional],
        )
        .withColumn("bin_hi", F.col("bin_lo") + fc.bin_width(F.col("bin_lo"), bin_exp))
        .select("bin_lo", "bin_hi", "flows_sum", "packets_sum", "octets_sum", *[f"{a}_sum" for a in additional])
    )


def _sum_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith("_sum")]


def combine(histograms: Iterable[DataFrame]) -> DataFrame:
    """Add up partial histograms made with the same bins."""
    parts = list(histograms)
    union = reduce(lambda a, b: a.unionByName(b), parts)
    sums = _sum_columns(parts[0])
    return union.groupBy("bin_lo", "bin_hi").agg(*[F.sum(c).alias(c) for c in sums]).select(parts[0].columns)


def rebin(histogram: DataFrame, bin_exp: int) -> DataFrame:
    """Coarsen a histogram of unit bins into log bins."""
    sums = _sum_columns(histogram)
    return (
        histogram.groupBy(fc.bin_low(F.col("bin_lo"), bin_exp).alias("bin_lo"))
        .agg(*[F.sum(c).alias(c) for c in sums])
        .withColumn("bin_hi", F.col("bin_lo") + fc.bin_width(F.col("bin_lo"), bin_exp))
        .select("bin_lo", "bin_hi", *sums)
    )


def detect_x_value(histogram: DataFrame) -> str:
    """Tell a length histogram (starts at 1 packet) from a size histogram (starts at 64 bytes)."""
    low = histogram.agg(F.min("bin_lo")).first()[0]
    if low == 1:
        return "length"
    if low == 64:
        return "size"
    raise ValueError(f"cannot tell the kind of a histogram that starts at {low}")
