"""Reduction and coverage curves of flow table policies from fitted mixtures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.operators.coverage import MIN_PACKET, _finish, level_thresholds, probabilities
from weirflow.operators.distribution import gap_sums, points_frame
from weirflow.operators.mixture import Mixture, mix_cdf
from weirflow.session import spread

# Size of the integration grid; rows of it that stand for one-packet flows when x is a size
STEPS = 262144
ONE_PACKET_ROWS = 64
CURVE_POINTS, CURVE_OCTAVES, CURVE_FROM = 1024, 32, 0.4

Mixtures = dict[str, tuple[int, Mixture]]
METRICS = ("flows", "packets", "octets")


def reduction_mixture(spark: SparkSession, mixtures: Mixtures) -> DataFrame:
    """`(threshold, coverage, reduction)` of perfectly predicted sizes, where more than 40 % is covered."""
    units = spark.range(CURVE_POINTS).select(
        F.rint(F.pow(F.lit(2.0), F.col("id") * CURVE_OCTAVES / (CURVE_POINTS - 1.0))).cast("long").alias("u")).distinct()
    x = units.select((F.col("u") * MIN_PACKET).alias("threshold"))
    return x.select(
        "threshold",
        (1 - mix_cdf(mixtures["octets"][1], F.col("threshold").cast("double"))).alias("coverage"),
        F.try_divide(F.lit(1.0), 1 - mix_cdf(mixtures["flows"][1], F.col("threshold").cast("double"))).alias("reduction"),
    ).filter(F.col("coverage") > CURVE_FROM)


def _grid(spark: SparkSession, mixtures: Mixtures, low: int, high: int) -> DataFrame:
    """Integration grid: CDF and probability of each step. At most STEPS rows, which bounds its windows."""
    x = spark.range(STEPS).select(
        F.rint(F.lit(float(low)) * F.pow(F.lit(high / low), F.col("id") / (STEPS - 1.0))).cast("long").alias("bin_lo")).distinct()
    at = spread(x).select("bin_lo", *[mix_cdf(mixtures[m][1], F.col("bin_lo").cast("double")).alias(f"{m}_cdf") for m in METRICS])
    w = Window.orderBy("bin_lo")
    return at.select(
        "bin_lo", (F.row_number().over(w) - 1).alias("i"), *[f"{m}_cdf" for m in METRICS],
        (F.col("bin_lo") - F.coalesce(F.lag("bin_lo").over(w), F.lit(0))).alias("gap"),
        *[(F.col(f"{m}_cdf") - F.coalesce(F.lag(f"{m}_cdf").over(w), F.lit(0.0))).alias(f"{m}_sum") for m in METRICS])


def coverage_mixture(spark: SparkSession, mixtures: Mixtures, method: str, x_value: str = "length",
                     ps: Sequence[float] | None = None) -> DataFrame:
    """Curve of one policy (`first`, `threshold`, `sampling`) with the columns of the histogram curves."""
    ps = list(ps or probabilities())
    points = level_thresholds(ps, x_value)
    if method == "first":
        at = points_frame_of(spark, points)
        rest = {m: 1 - mix_cdf(mixtures[m][1], F.col("x").cast("double")) for m in METRICS}
        wide = at.select("x", *[c.alias(m) for m, c in rest.items()])
        return _finish(wide, {"flows": F.col("flows"), "packets": F.col("packets"), "fraction": F.col("flows"), "octets": F.col("octets")}, ["x"])
    grid = _grid(spark, mixtures, points[0], points[-1])
    if method == "threshold":
        sums = {m: F.col(f"{m}_sum") for m in METRICS} | {f"{m}_per": F.col(f"{m}_sum") / F.col("bin_lo") for m in METRICS}
        g = gap_sums(grid, points, sums)

        def left(m: str) -> Column:
            return 1 - (F.col(f"{m}_upto") + F.col("x") * F.col(f"{m}_per_after"))

        flows = 1 - mix_cdf(mixtures["flows"][1], F.col("x").cast("double"))  # at x itself, not at the grid's step before
        return _finish(g, {"flows": flows, "packets": left("packets"), "fraction": left("flows"),
                           "octets": left("octets")}, ["x"])
    if method != "sampling":
        raise ValueError(f"unknown method {method}")
    return _sampling(grid, mixtures, x_value, ps)


def points_frame_of(spark: SparkSession, points: Sequence[int]) -> DataFrame:
    return points_frame(spark.range(1), points).select("x")


def _sampling(grid: DataFrame, mixtures: Mixtures, x_value: str, ps: Sequence[float]) -> DataFrame:
    suffix = Window.orderBy(F.desc("bin_lo")).rowsBetween(Window.unboundedPreceding, 0)
    x = F.col("bin_lo").cast("double")
    steps = grid.select("*", *[(F.sum(F.col(f"{m}_sum") / x).over(suffix) * F.col("gap")).alias(f"{m}_step") for m in METRICS])
    if x_value == "size":
        # bytes of one-packet flows count at the first row beyond them
        early = F.col("i") < ONE_PACKET_ROWS
        whole = Window.partitionBy()
        steps = steps.select(
            *[c for c in steps.columns if not c.endswith("_step")],
            *[F.when(early, 0.0).when(F.col("i") == ONE_PACKET_ROWS, F.col(f"{m}_step") + F.sum(F.when(early, F.col(f"{m}_step"))).over(whole))
              .otherwise(F.col(f"{m}_step")).alias(f"{m}_step") for m in METRICS])
        size = F.try_divide(F.col("octets_cdf"), F.col("packets_cdf")) * F.lit(mixtures["octets"][0] / mixtures["packets"][0])
        steps = steps.withColumn("_packets", F.least(F.greatest(x / size, F.lit(1.0)), F.floor(x / MIN_PACKET).cast("double")))
        steps = steps.withColumn("_size", F.when(early, x).otherwise(size))
    rows = spread(steps).withColumn("p", F.explode(F.array(*[F.lit(p) for p in ps])))
    if x_value == "size":
        missed = F.pow(1 - F.least(F.col("p") * F.col("_size") / MIN_PACKET, F.lit(1.0)), F.col("_packets"))
    else:
        missed = F.pow(1 - F.col("p"), x)
    rows = rows.withColumn("_missed", missed)
    sums = rows.groupBy("p").agg(
        (1 - F.sum(F.col("_missed") * F.col("flows_sum"))).alias("flows"),
        *[(1 - F.sum(F.col("_missed") * F.col(f"{m}_step"))).alias(n) for n, m in (("packets", "packets"), ("fraction", "flows"), ("octets", "octets"))])
    return _finish(sums, {w: F.col(w) for w in ("flows", "packets", "fraction", "octets")}, ["p"])
