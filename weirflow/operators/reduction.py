"""Flow table reduction against traffic coverage for predicted flow sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.distribution import gap_index, interpolate, points_frame
from weirflow.session import freeze

# Thresholds are 64-byte units times 2^0 .. 2^24
SIZE_UNIT = 64
OCTAVES = 24


def thresholds(n: int | None = None) -> list[float]:
    """The 25 octaves, or `n` log-spaced values over the same range."""
    if n is None:
        return [float(SIZE_UNIT << i) for i in range(OCTAVES + 1)]
    return [2.0 ** (OCTAVES * i / (n - 1)) * SIZE_UNIT for i in range(n)]


def reduction_curve(flows: DataFrame, predicted: str = "predicted", cuts: Sequence[float] | None = None,
                    octets: str = "octets", by: Sequence[str] = ()) -> DataFrame:
    """`(threshold, coverage, reduction)` when flows predicted above the threshold are selected.

    Flows are summed once per interval between thresholds; suffix sums over these intervals give all thresholds.
    Thresholds that select nothing are left out.
    """
    cuts = list(cuts or thresholds())
    per_gap = flows.groupBy(*by, gap_index(F.col(predicted), cuts).alias("i")).agg(
        F.count("*").alias("n"), F.sum(octets).alias("o"))
    suffix = Window.partitionBy(*by).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    ends = points_frame(flows, [*cuts, cuts[-1]], "threshold")
    if by:
        # every group has all thresholds: at most groups * thresholds rows, from the per-interval sums, which are read
        # more than once and so written: the flows are summed once
        per_gap = freeze(per_gap)
        ends = per_gap.select(*by).distinct().withColumn(
            "t", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(len(cuts))).alias("i"),
                                        F.array(*[F.lit(c) for c in [*cuts, cuts[-1]]]).alias("threshold")))
        ).select(*by, "t.i", "t.threshold")
    rows = ends.join(per_gap, [*by, "i"], "left").select(
        *by, "i", "threshold",
        F.sum("n").over(suffix).alias("selected"), F.sum("o").over(suffix).alias("covered"),
        F.sum("n").over(whole).alias("all_n"), F.sum("o").over(whole).alias("all_o"),
    )
    return rows.filter((F.col("i") < len(cuts)) & (F.col("selected") > 0)).select(
        *by, "threshold", (F.col("covered") / F.col("all_o")).alias("coverage"),
        (F.col("all_n") / F.col("selected")).alias("reduction"))


def coverage_grid() -> list[float]:
    """50.0, 50.1 .. 100.9 percent."""
    return [(500 + i) / 10.0 for i in range(510)]


def interpolate_reduction(curve: DataFrame, points: Sequence[float], scale: float = 100.0,
                          close: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Reduction on a coverage grid, per group `by`: null left of the curve, last value right of it.

    `close` adds the point where everything is covered and nothing is reduced.
    """
    knots = curve.select(*by, (F.col("coverage") * scale).alias("x"), "reduction")
    groups = knots.select(*by).distinct() if by else knots.sparkSession.range(1).select()
    if close:
        knots = knots.unionByName(groups.select(*by, F.lit(scale).alias("x"), F.lit(1.0).alias("reduction")))
    knots = knots.groupBy(*by, "x").agg(F.min("reduction").alias("reduction"))
    grid = groups.withColumn("x", F.explode(F.array(*[F.lit(float(p)) for p in points])))
    return interpolate(knots, grid, "x", ["reduction"], by, right="clamp")


def reduction_scores(flows: DataFrame, predicted: str, by: Sequence[str], coverage: float = 0.8) -> DataFrame:
    """`by…, score`: `reduction_score` of every group, from one aggregate."""
    curve = reduction_curve(flows, predicted, by=by)
    return interpolate_reduction(curve, [coverage], 1.0, False, by).select(*by, F.col("reduction").alias("score"))


def reduction_score(flows: DataFrame, predicted: str = "predicted", coverage: float = 0.8) -> DataFrame:
    """Reduction at a traffic coverage of 80 %; null when the curve does not start left of it."""
    curve = reduction_curve(flows, predicted)
    return interpolate_reduction(curve, [coverage], scale=1.0, close=False).select(
        F.col("x").alias("coverage"), F.col("reduction").alias("score"))
