"""Coverage, operations and occupancy of flow table policies, from a histogram or from flow rows.

Policies: `first` takes a flow on its first packet when its size is known to exceed the level; `threshold` after so
many packets; `sampling` with a probability on each packet. Levels are packets (x = length) or bytes (x = size).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.distribution import gap_index, gap_sums, inside, interpolate, points_frame
from weirflow.operators.positions import prefix_sums, self_bucketed, with_neighbours
from weirflow.session import spread

# Probabilities 1/2^0 .. 1/2^24, their reciprocals as thresholds, the least packet of 64 bytes
LEVELS = 25
BATCH_ROWS = 8192  # flows that meet all levels at once
MIN_PACKET = 64
WHAT = ["flows", "packets", "fraction", "octets"]


def probabilities() -> list[float]:
    return [1.0 / (1 << i) for i in range(LEVELS)]


def level_thresholds(ps: Sequence[float], x_value: str) -> list[int]:
    unit = MIN_PACKET if x_value == "size" else 1
    return sorted({round(1 / p) * unit for p in ps})


def _finish(df: DataFrame, covered: dict[str, Column], by: Sequence = ()) -> DataFrame:
    """Percentages, and the two reductions as reciprocals."""
    return df.select(
        *by,
        *[(covered[w] * 100).alias(f"{w}_mean") for w in WHAT],
        F.try_divide(F.lit(1.0), covered["flows"]).alias("operations_mean"),
        F.try_divide(F.lit(1.0), covered["fraction"]).alias("occupancy_mean"),
    )


def coverage_first(histogram: DataFrame, x_value: str = "length", ps: Sequence[float] | None = None) -> DataFrame:
    """Share beyond each threshold: one minus the CDF."""
    points = level_thresholds(ps or probabilities(), x_value)
    g = gap_sums(histogram, points, {m: F.col(f"{m}_sum") for m in ("flows", "packets", "octets")})

    def beyond(m: str) -> Column:
        return F.when(inside(), 1 - F.col(f"{m}_upto") / F.col(f"{m}_total"))

    covered = {"flows": beyond("flows"), "packets": beyond("packets"), "fraction": beyond("flows"), "octets": beyond("octets")}
    return _finish(g, covered, ["x"])


def coverage_threshold(histogram: DataFrame, x_value: str = "length", ps: Sequence[float] | None = None) -> DataFrame:
    """Share left after the first `x` packets (bytes) of every flow.

    A bin at v loses min(1, x/v) of its traffic, so bins up to x count whole and larger ones with x/v: two sums per
    gap between thresholds, and no order over bins.
    """
    points = level_thresholds(ps or probabilities(), x_value)
    sums = {m: F.col(f"{m}_sum") for m in ("flows", "packets", "octets")}
    sums |= {f"{m}_per": F.col(f"{m}_sum") / F.col("bin_lo") for m in ("flows", "packets", "octets")}
    g = gap_sums(histogram, points, sums)

    def left(m: str) -> Column:
        lost = F.col(f"{m}_upto") + F.col("x") * F.col(f"{m}_per_after")
        return F.when(inside(), 1 - lost / F.col(f"{m}_total"))

    beyond = F.when(inside(), 1 - F.col("flows_upto") / F.col("flows_total"))
    return _finish(g, {"flows": beyond, "packets": left("packets"), "fraction": left("flows"), "octets": left("octets")}, ["x"])


def coverage_sampling(histogram: DataFrame, x_value: str = "length", ps: Sequence[float] | None = None,
                      bucket: Column | None = None) -> DataFrame:
    """Expected share after the packet that is sampled with probability p.

    Sums over bins once in order, in buckets if there are more bins than one window may take; then every bin meets
    every probability, and is summed map-side.
    """
    metrics = ("flows", "packets", "octets")
    h = histogram.select("bin_lo", *[f"{m}_sum" for m in metrics], *[(F.col(f"{m}_sum") / F.col("bin_lo")).alias(f"{m}_per") for m in metrics])
    if bucket is None:
        h, bucket = self_bucketed(h, "bin_lo")
    h = prefix_sums(h, "bin_lo", {f"{m}_rest": f"{m}_per" for m in metrics}, bucket, descending=True)
    h = prefix_sums(h, "bin_lo", {"octets_upto": "octets_sum", "packets_upto": "packets_sum", "flows_upto": "flows_sum"}, bucket)
    h = with_neighbours(h, "bin_lo", bucket).withColumn("_gap", F.col("bin_lo") - F.coalesce("_previous", F.lit(0)))
    x = F.col("bin_lo").cast("double")
    rows = spread(h).withColumn("p", F.explode(F.array(*[F.lit(p) for p in ps or probabilities()])))
    if x_value == "length":
        missed = F.pow(1 - F.col("p"), x)
    else:
        packet = F.col("octets_upto") / F.col("packets_upto")
        packets = F.least(F.greatest(x / packet, F.lit(1.0)), F.floor(x / MIN_PACKET).cast("double"))
        missed = F.pow(1 - F.least(F.col("p") * packet / MIN_PACKET, F.lit(1.0)), packets)
    rows = rows.withColumn("_missed", missed)

    def expect(m: str) -> Column:
        return 1 - F.sum(F.col("_missed") * F.col(f"{m}_rest") * F.col("_gap")) / F.max(f"{m}_upto_total")

    sums = rows.groupBy("p").agg(
        (1 - F.sum(F.col("_missed") * F.col("flows_sum")) / F.max("flows_upto_total")).alias("flows"),
        expect("packets").alias("packets"), expect("flows").alias("fraction"), expect("octets").alias("octets"))
    return _finish(sums, {w: F.col(w) for w in WHAT}, ["p"])


def _sampled_sizes(ps: Sequence[float]):
    """Sums per task and level of what `sampling` by bytes covers; a batch meets all levels as a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, total = np.array(ps)[:, None], np.zeros((7, len(ps)))
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                p, o = (batch.column(c).slice(start, BATCH_ROWS).to_numpy(zero_copy_only=False) for c in ("p", "o"))
                q = np.minimum(level * o / p / MIN_PACKET, 1.0)
                added = 1 - (1 - q) ** p
                share = 1 - (1 - q) * added / q / p
                total += np.stack([np.full(len(ps), len(p)), np.full(len(ps), p.sum()), np.full(len(ps), o.sum()),
                                   added.sum(axis=1), share @ p, share.sum(axis=1), share @ o])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.array(ps), *total)], ["level", "n", "pk", "oc", "added", "packets", "share", "octets"])

    return run


def coverage_records(flows: DataFrame, x_value: str = "length", ps: Sequence[float] | None = None) -> DataFrame:
    """The three policies applied to flow rows, `(method, level, …)`, without random numbers.

    For `first` and `threshold` flows are summed per interval between levels. `sampling` uses the exact expectation:
    a flow of P packets sampled with p is added with 1 - q^P and P - q(1 - q^P)/p of its packets are covered.
    """
    ps = list(ps or probabilities())
    levels = level_thresholds(ps, x_value)
    p_, o_ = F.col("packets"), F.col("octets")
    size = x_value == "size"
    x = o_ if size else p_
    per_gap = flows.groupBy(gap_index(x, levels).alias("i")).agg(
        F.count("*").alias("n"), F.sum(p_).alias("pk"), F.sum(o_).alias("oc"),
        # packets, fraction and octets lost per unit of the level
        F.sum(p_ / o_ if size else F.lit(1.0)).alias("pk_per"),
        F.sum(F.lit(1.0) / x).alias("fr_per"),
        F.sum(F.lit(1.0) if size else o_ / p_).alias("oc_per"),
    )
    suffix = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    sums = ["n", "pk", "oc", "pk_per", "fr_per", "oc_per"]
    rows = points_frame(flows, [*levels, levels[-1]]).join(per_gap, "i", "left").select(
        "i", F.col("x").cast("double").alias("level"),
        *[F.coalesce(F.sum(c).over(suffix), F.lit(0)).alias(c) for c in sums],
        *[F.sum(c).over(whole).alias(f"all_{c}") for c in ("n", "pk", "oc")],
    ).filter(F.col("i") < len(levels))
    n, pk, oc = F.col("all_n"), F.col("all_pk"), F.col("all_oc")
    lv = F.col("level")
    first = _finish(rows, {"flows": F.col("n") / n, "packets": F.col("pk") / pk, "fraction": F.col("n") / n,
                           "octets": F.col("oc") / oc}, [F.lit("first").alias("method"), "level"])
    threshold = _finish(rows, {
        "flows": F.col("n") / n,
        "packets": (F.col("pk") - lv * F.col("pk_per")) / pk,
        "fraction": (F.col("n") - lv * F.col("fr_per")) / n,
        "octets": (F.col("oc") - lv * F.col("oc_per")) / oc,
    }, [F.lit("threshold").alias("method"), "level"])

    if size:  # nearly every flow has its own pair of packets and octets: summed per batch, without a row per level
        s = flows.select(p_.cast("double").alias("p"), o_.cast("double").alias("o")).mapInArrow(_sampled_sizes(ps), "level double, n double, pk double, oc double, added double, packets double, share double, octets double")
    else:
        groups = spread(flows.groupBy("packets").agg(F.count("*").alias("n"), F.sum("octets").alias("oc")))
        s = groups.withColumn("level", F.explode(F.array(*[F.lit(p) for p in ps])))
        added = 1 - F.pow(1 - F.col("level"), p_.cast("double"))
        share = 1 - (1 - F.col("level")) * added / F.col("level") / p_
        s = s.select("level", "n", (F.col("n") * p_).alias("pk"), "oc", (F.col("n") * added).alias("added"), (F.col("n") * p_ * share).alias("packets"),
                     (F.col("n") * share).alias("share"), (F.col("oc") * share).alias("octets"))
    s = s.groupBy("level").agg(
        (F.sum("added") / F.sum("n")).alias("flows"), (F.sum("packets") / F.sum("pk")).alias("packets"),
        (F.sum("share") / F.sum("n")).alias("fraction"), (F.sum("octets") / F.sum("oc")).alias("octets"))
    sampling = _finish(s, {w: F.col(w) for w in WHAT}, [F.lit("sampling").alias("method"), "level"])
    return first.unionByName(threshold).unionByName(sampling)


def curve_at(curves: DataFrame, points: Sequence[float], x: str = "octets_mean",
             ys: Sequence[str] = ("occupancy_mean", "operations_mean"), by: Sequence[str] = ("method",)) -> DataFrame:
    """Curve values at selected coverages, per method."""
    knots = curves.filter(F.col(x).isNotNull()).groupBy(*by, x).agg(*[F.max(y).alias(y) for y in ys])
    grid = knots.select(*by).distinct().withColumn(x, F.explode(F.array(*[F.lit(float(p)) for p in points])))
    return interpolate(knots, grid, x, list(ys), by)


def relative_to(curves: DataFrame, method: str, points: Sequence[float], x: str = "octets_mean",
                ys: Sequence[str] = ("occupancy_mean", "operations_mean")) -> DataFrame:
    """Curve values of every method divided by those of `method`."""
    at = curve_at(curves, points, x, ys)
    w = Window.partitionBy(x)  # one row per method
    base = {y: F.max(F.when(F.col("method") == method, F.col(y))).over(w) for y in ys}
    return at.select("method", x, *[F.try_divide(F.col(y), base[y]).alias(y) for y in ys])
