"""Distribution functions over a histogram.

Where values are wanted at given points, histogram rows are first summed per gap between points. That needs one
hash aggregate with a handful of groups, whatever the size of the histogram; windows then run over the points.
Windows over bins bound themselves: a histogram with more bins than one window may take, as with unit bins, is cut into
buckets along its bins (`self_bucketed`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions import flowcols as fc
from weirflow.operators.positions import prefix_sums, self_bucketed, with_neighbours
from weirflow.session import spread

METRICS = ["flows", "packets", "octets"]
LINE_POINTS = 128
GRID_CELLS = 64


def unit_bucket(bin_exp: int = 12) -> Column:
    """Bucket of a unit bin: a bounded number of buckets, each a bounded share of its octave."""
    return fc.bin_low(F.col("bin_lo"), bin_exp)


def cdf(histogram: DataFrame, metrics: Sequence[str] = METRICS, bucket: Column | None = None) -> DataFrame:
    """Empirical CDF per bin; `bucket` overrides the buckets that a large histogram gets."""
    if bucket is None:
        histogram, bucket = self_bucketed(histogram.select("bin_lo", *[f"{m}_sum" for m in metrics]), "bin_lo")
    out = prefix_sums(histogram, "bin_lo", {f"_c_{m}": f"{m}_sum" for m in metrics}, bucket)
    return out.select("bin_lo", *[(F.col(f"_c_{m}") / F.col(f"_c_{m}_total")).alias(f"{m}_cdf") for m in metrics])


def points_frame(df: DataFrame, points: Sequence[float], name: str = "x") -> DataFrame:
    """Literal points as a frame `(i, x)`."""
    items = F.array(*[F.lit(p) for p in points])
    return df.sparkSession.range(1).select(F.posexplode(items).alias("i", name))


CODEGEN_POINTS = 32  # longer comparison chains outgrow the generated method


def gap_index(x: Column, points: Sequence[float]) -> Column:
    """Number of points below `x`; points ascend.

    Never null, so that a join on it adds no null filter, into which the optimiser would inline the whole chain.
    """
    if len(points) > CODEGEN_POINTS:
        return F.size(F.filter(F.array(*[F.lit(p) for p in points]), lambda p: p < x))
    out = F.lit(0)
    for p in points:
        out = out + (x > F.lit(p)).cast("int")
    return F.coalesce(out, F.lit(0))


def gap_sums(histogram: DataFrame, points: Sequence[int], sums: dict[str, Column]) -> DataFrame:
    """Histogram sums up to each point, with the neighbouring bins.

    Columns: `i, x`, `{n}_upto` (bins <= x), `{n}_after`, `{n}_next` (value in the next bin), `{n}_total`,
    `prev_x` and `next_x`.
    """
    cols = [c.alias(n) for n, c in sums.items()]
    rows = histogram.select("bin_lo", *cols).withColumn("i", gap_index(F.col("bin_lo"), points))
    per_gap = rows.groupBy("i").agg(
        F.max("bin_lo").alias("hi"),
        F.min_by(F.struct("bin_lo", *sums), "bin_lo").alias("lo"),
        *[F.sum(n).alias(n) for n in sums],
    )
    grid = points_frame(histogram, [*points, points[-1]])  # the last row stands for everything above all points
    up = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    out = grid.join(per_gap, "i", "left").select(
        "i", "x",
        F.last("hi", ignorenulls=True).over(up).alias("prev_x"),
        F.last("lo", ignorenulls=True).over(above).alias("nxt"),
        *[F.coalesce(F.sum(n).over(up), F.lit(0)).alias(f"{n}_upto") for n in sums],
        *[F.coalesce(F.sum(n).over(above), F.lit(0)).alias(f"{n}_after") for n in sums],
        *[F.sum(n).over(whole).alias(f"{n}_total") for n in sums],
    )
    return out.filter(F.col("i") < len(points)).select(
        "*", F.col("nxt.bin_lo").alias("next_x"), *[F.col(f"nxt.{n}").alias(f"{n}_next") for n in sums]
    ).drop("nxt")


def inside() -> Column:
    """The point lies between the first and the last bin."""
    return F.col("prev_x").isNotNull() & ((F.col("prev_x") == F.col("x")) | F.col("next_x").isNotNull())


def cdf_at(histogram: DataFrame, points: Sequence[int], how: str = "linear",
           metrics: Sequence[str] = METRICS) -> DataFrame:
    """CDF at ascending points, `linear` or `previous`, and the totals; null outside of the histogram."""
    g = gap_sums(histogram, points, {m: F.col(f"{m}_sum") for m in metrics})
    out = []
    for m in metrics:
        at = F.col(f"{m}_upto") / F.col(f"{m}_total")
        if how == "linear":
            after = (F.col(f"{m}_upto") + F.col(f"{m}_next")) / F.col(f"{m}_total")
            x, x0, x1 = F.col("x"), F.col("prev_x"), F.col("next_x")
            value = F.when(x0 == x, at).otherwise(at + (x - x0) * (after - at) / (x1 - x0))
        else:
            value = at
        out.append(F.when(inside(), value).alias(f"{m}_cdf"))
    return g.select("i", "x", *out, *[f"{m}_total" for m in metrics])


def log_points(low: float, high: float, n: int = LINE_POINTS) -> list[int]:
    """Up to `n` distinct whole points, evenly spaced on a log scale."""
    ratio = high / low
    return sorted({round(low * ratio ** (i / (n - 1))) for i in range(n)} | {round(low), round(high)})


def line_points(histogram: DataFrame, n: int = LINE_POINTS) -> list[int]:
    low, high = histogram.agg(F.min("bin_lo"), F.max("bin_lo")).first()
    return log_points(low, high, n)


def pdf_from_cdf(histogram: DataFrame, points: Sequence[int], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Slope of the interpolated CDF between points; the first value is the CDF itself."""
    w = Window.orderBy("i")
    at = cdf_at(histogram, points, "linear", metrics)
    return at.select("x", *[
        F.coalesce((F.col(f"{m}_cdf") - F.lag(f"{m}_cdf").over(w)) / (F.col("x") - F.lag("x").over(w)),
                   F.col(f"{m}_cdf")).alias(f"{m}_pdf")
        for m in metrics
    ], *[f"{m}_total" for m in metrics])


def avg_line(histogram: DataFrame, points: Sequence[int], what: str = "octets") -> DataFrame:
    """Average of `what` per flow along points: ratio of the two interpolated densities, scaled by the totals."""
    pdf = pdf_from_cdf(histogram, points, ["flows", what])
    scale = F.col(f"{what}_total") / F.col("flows_total")
    return pdf.select("x", F.try_divide(scale * F.col(f"{what}_pdf"), F.col("flows_pdf")).alias(f"{what}_avg"))


def pdf_points(histogram: DataFrame, normalize: bool = True, bin_exp: int = 0,
               metrics: Sequence[str] = METRICS) -> DataFrame:
    """Share of the total per bin; normalised by the distance to the next bin so that log bins compare.

    The last bin takes the distance before it, cut down to a bin edge of exponent `bin_exp`.
    """
    totals = histogram.agg(*[F.sum(f"{m}_sum").alias(f"_t_{m}") for m in metrics])
    share = {m: F.col(f"{m}_sum") for m in metrics}
    df = histogram.join(F.broadcast(totals))  # one row
    if normalize:
        df, bucket = self_bucketed(df, "bin_lo")
        df = with_neighbours(df, "bin_lo", bucket)
        last = fc.bin_low(F.col("bin_lo") + (F.col("bin_lo") - F.col("_previous")), bin_exp)
        df = df.withColumn("_gap", F.coalesce(F.col("_next"), last) - F.col("bin_lo"))
        share = {m: c / F.col("_gap") for m, c in share.items()}
    return df.select("bin_lo", "flows_sum", *[
        (share[m] / F.col(f"_t_{m}")).alias(f"{m}_pdf") for m in metrics])


def avg_per_bin(histogram: DataFrame) -> DataFrame:
    """Packets and octets per flow, packet size and (with durations) packet inter-arrival time of each bin."""
    cols = [
        (F.col("packets_sum") / F.col("flows_sum")).alias("packets_avg"),
        (F.col("octets_sum") / F.col("flows_sum")).alias("octets_avg"),
        (F.col("octets_sum") / F.col("packets_sum")).alias("packet_size"),
    ]
    if "duration_sum" in histogram.columns:
        cols.append((F.col("duration_sum") / F.col("packets_sum")).alias("packet_iat"))
    return histogram.select("bin_lo", *cols)


def packet_ranges(histogram: DataFrame) -> DataFrame:
    """Least, overall and greatest packet size and packet inter-arrival time over bins."""
    out = []
    for name, total in (("packet_size", "octets_sum"), ("packet_iat", "duration_sum")):
        if total in histogram.columns:
            ratio = F.col(total) / F.col("packets_sum")
            out.append(F.struct(F.lit(name).alias("what"), F.min(ratio).alias("low"),
                                (F.sum(total) / F.sum("packets_sum")).alias("mean"), F.max(ratio).alias("high")))
    return histogram.agg(F.array(*out).alias("r")).select(F.inline("r"))


def summary_stats(histogram: DataFrame) -> DataFrame:
    """Totals and averages of a histogram that has the additional duration and rate columns, or without them."""
    names = {"packets_sum": "avg_length", "octets_sum": "avg_size", "duration_sum": "avg_duration", "rate_sum": "avg_rate"}
    return histogram.agg(
        F.sum("flows_sum").alias("flows"), F.sum("packets_sum").alias("packets"), F.sum("octets_sum").alias("octets"),
        *[(F.sum(c) / F.sum("flows_sum")).alias(n) for c, n in names.items() if c in histogram.columns],
        (F.sum("octets_sum") / F.sum("packets_sum")).alias("avg_packet_size"),
    )


def summary_cdf(histogram: DataFrame, x_value: str) -> DataFrame:
    """Percentage of flows, packets and octets in flows of up to 2^0 .. 2^24 packets (or 64-byte units)."""
    unit = {"length": 1, "size": 64}[x_value]
    points = [unit << i for i in range(25)]
    at = cdf_at(histogram, points, "linear")
    return at.select("x", *[(F.col(f"{m}_cdf") * 100).alias(f"{m}_pct") for m in METRICS])


def value_ranges(frames: Sequence[DataFrame], x: str, ys: Sequence[str]) -> DataFrame:
    """Least and greatest x and y over several frames."""
    rows = None
    for df in frames:
        part = df.agg(
            F.min(x).alias("xmin"), F.max(x).alias("xmax"),
            F.least(*[F.min(y) for y in ys]).alias("ymin") if len(ys) > 1 else F.min(ys[0]).alias("ymin"),
            F.greatest(*[F.max(y) for y in ys]).alias("ymax") if len(ys) > 1 else F.max(ys[0]).alias("ymax"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows.agg(F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"),
                    F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax"))


def log_edges(low: float, high: float, n: int = GRID_CELLS) -> list[float]:
    ratio = high / low
    return [float(low), *[low * ratio ** (i / (n - 1)) for i in range(1, n - 1)], float(high)]


def hist2d(points: DataFrame, x: str, y: str, weight: str, edges: int = GRID_CELLS) -> DataFrame:
    """Weighted counts in log-spaced cells `(ix, iy)`; cells below 1 are left out, the last edge is inclusive."""
    pts = points.filter((F.col(x) > 0) & (F.col(y) > 0))
    xmin, xmax, ymin, ymax = pts.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()

    def cell(col: str, low, high):
        inner = F.array(*[F.lit(e) for e in log_edges(low, high, edges)[1:-1]])
        return F.size(F.filter(inner, lambda e: e <= F.col(col)))

    return (
        pts.groupBy(cell(x, xmin, xmax).alias("ix"), cell(y, ymin, ymax).alias("iy"))
        .agg(F.sum(weight).alias("weight")).filter(F.col("weight") >= 1)
    )


KDE_POINTS = 1024  # points that meet the grid at once


def kde_grid(points: DataFrame, x: str, y: str, weight: str, n: int = GRID_CELLS) -> DataFrame:
    """Weighted Gaussian density of log10 points on an n x n log grid `(ix, iy, x, y, density)`.

    Bandwidth by Scott's factor on the effective sample size. One pass for the moments, whose few scalars fix the
    grid; then each task sums its points into a grid of its own, and the grids are added. No points give no rows.
    """
    pts = points.filter((F.col(x) > 0) & (F.col(y) > 0)).select(
        F.log10(x).alias("u"), F.log10(y).alias("v"), F.col(weight).cast("double").alias("w"))
    m = pts.agg(
        F.sum("w").alias("w"), F.sum(F.expr("w*w")).alias("w2"), F.sum(F.expr("w*u")).alias("u"),
        F.sum(F.expr("w*v")).alias("v"), F.sum(F.expr("w*u*u")).alias("uu"), F.sum(F.expr("w*u*v")).alias("uv"),
        F.sum(F.expr("w*v*v")).alias("vv"), F.min("u").alias("umin"), F.max("u").alias("umax"),
        F.min("v").alias("vmin"), F.max("v").alias("vmax"),
    ).first()
    if m["w"] is None:
        return points.sparkSession.createDataFrame([], "ix int, iy int, x double, y double, density double")
    total = m["w"]
    mu, mv = m["u"] / total, m["v"] / total
    unbias = 1 - m["w2"] / total**2
    scott2 = (total**2 / m["w2"]) ** (-1 / 3)
    cuu = (m["uu"] / total - mu * mu) / unbias * scott2
    cuv = (m["uv"] / total - mu * mv) / unbias * scott2
    cvv = (m["vv"] / total - mv * mv) / unbias * scott2
    det = cuu * cvv - cuv * cuv
    norm = total * 2 * math.pi * math.sqrt(det)
    du, dv = (m["umax"] - m["umin"]) / (n - 1), (m["vmax"] - m["vmin"]) / (n - 1)
    gu, gv = m["umin"] + du * np.repeat(np.arange(n), n), m["vmin"] + dv * np.tile(np.arange(n), n)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(n * n)
        for part in batches:
            for k in range(0, len(part), KDE_POINTS):
                u, v, w = (part[c].to_numpy()[k:k + KDE_POINTS] for c in "uvw")
                a, b = gu - u[:, None], gv - v[:, None]
                out += w @ np.exp(-(a * a * cvv - 2 * cuv * a * b + b * b * cuu) / (2 * det))
        yield pd.DataFrame({"c": np.arange(n * n), "s": out})

    cells = spread(pts).mapInPandas(partial, "c int, s double")
    return cells.groupBy("c").agg((F.sum("s") / F.lit(norm)).alias("density")).select(
        (F.col("c") / n).cast("int").alias("ix"), (F.col("c") % n).alias("iy"),
        F.pow(F.lit(10.0), F.lit(m["umin"]) + (F.col("c") / n).cast("int") * F.lit(du)).alias("x"),
        F.pow(F.lit(10.0), F.lit(m["vmin"]) + (F.col("c") % n) * F.lit(dv)).alias("y"),
        "density",
    )


def interpolate(knots: DataFrame, points: DataFrame, x: str, ys: Sequence[str], by: Sequence[str] = (),
                right: str = "null") -> DataFrame:
    """Linear interpolation of curve columns `ys` at `points` (columns `by`, `x`), per group `by`.

    For curves, whose size is bounded by their thresholds. Left of a curve is null; right of it null or, with
    right="clamp", the last value.
    """
    value = F.struct(F.col(x).cast("double").alias("x"), *ys)
    rows = knots.select(*by, F.col(x).cast("double").alias(x), value.alias("k")).unionByName(
        points.select(*by, F.col(x).cast("double").alias(x)), allowMissingColumns=True
    ).withColumn("is_point", F.col("k").isNull())
    up = Window.partitionBy(*by).orderBy(x, "is_point").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by).orderBy(F.desc(x), F.desc("is_point")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.last("k", ignorenulls=True).over(up).alias("a"),
                       F.last("k", ignorenulls=True).over(down).alias("b")).filter("is_point")
    out = []
    for y in ys:
        a, b = F.col(f"a.{y}"), F.col(f"b.{y}")
        mid = a + (F.col(x) - F.col("a.x")) * (b - a) / (F.col("b.x") - F.col("a.x"))
        beyond = a if right == "clamp" else F.lit(None)
        out.append(F.when(F.col("a.x") == F.col(x), a).when(F.col("b").isNull(), beyond)
                   .when(F.col("a").isNotNull(), mid).alias(y))
    return rows.select(*by, x, *out)
