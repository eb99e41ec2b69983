"""Flows and traffic in a flow table per second."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.flowcols import idiv
from weirflow.operators.positions import dense_rank, prefix_sums

DAY = 86_400
MICRO = 1_000_000


MOST_SECONDS = 20 * 366 * DAY  # a span beyond this comes from a broken time rather than from a table of flows


def _placed(flows: DataFrame, pps: int | None, fps: int | None, timeout: int, seconds: int | None) -> tuple[DataFrame, int, int]:
    """Flows with their first second `_s` and their length `_e`, the origin of time and the number of seconds."""
    elapsed = F.col("last") - F.col("first") + 1 if pps is None else idiv(F.col("packets"), pps) + 1
    if fps is None:
        placed = flows.select("*", F.col("first").alias("_s"))
    else:
        placed = dense_rank(flows, "pos", "_r").withColumn("_s", idiv(F.col("_r"), fps))
    placed = placed.withColumn("_e", elapsed)
    origin, end = placed.agg(F.min("_s"), F.max(F.col("_s") + F.col("_e"))).first()
    origin = origin or 0
    span = seconds if seconds is not None else (end or 0) - origin + (timeout if end is not None else 0)
    if span > MOST_SECONDS:
        raise ValueError(f"flows span {span} seconds from {origin} on: mend their times or ask for a window by `seconds`")
    return placed, origin, span


def _steps(placed: DataFrame, origin: int, span: int, timeout: int, keep: Sequence[Column]) -> DataFrame:
    """What a flow adds at its start, its end and its timeout, as differences `second, df, do` beside `keep`."""
    start = F.col("_s") - F.lit(origin)
    # only flows with a step inside the span are spread: few of them where a short window of a day is asked for
    placed = placed.filter(F.least(start, start + F.col("_e"), start + F.col("_e") + timeout) < span)
    rate = idiv(F.col("octets") * MICRO, F.col("_e"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    return placed.select(*keep, F.explode(F.array(
        F.struct(start.alias("second"), one.alias("df"), rate.alias("do")),
        F.struct((start + F.col("_e")).alias("second"), zero.alias("df"), (-rate).alias("do")),
        F.struct((start + F.col("_e") + timeout).alias("second"), (-one).alias("df"), zero.alias("do")),
    )).alias("d")).select(*_names(keep), "d.*").filter(F.col("second") < span)


def _names(columns: Sequence) -> list[str]:
    return [f"m{i}" for i in range(len(columns))]


def _running(per_second: DataFrame, span: int, levels: Sequence[int]) -> DataFrame:
    """`level, second, flows, _octets`: differences per level and second, summed up along every second of the span."""
    grid = per_second.sparkSession.range(span).select(
        F.col("id").alias("second"), F.explode(F.array(*[F.lit(i) for i in levels])).alias("level"))
    filled = grid.join(per_second, ["level", "second"], "left").fillna(0, ["df", "do"])
    sums = prefix_sums(filled, "second", {"flows": "df", "_octets": "do"}, idiv(F.col("second"), DAY), by=["level"])
    return sums.select("level", "second", "flows", "_octets")


def occupancy(flows: DataFrame, mask: Column | str | None = None, pps: int | None = None, fps: int | None = None,
              timeout: int = 15, seconds: int | None = None) -> DataFrame:
    """`(second, flows, octets)`: active flows over [start, end + timeout) and bytes per second over [start, end).

    Seconds count from the first flow to the end of the last one, or to `seconds` if a window is asked for. Starts come
    from the times or from `fps` flows per second in the order of `pos` (of which a part of a table has no holes),
    durations from the times or from `pps` packets per second. A flow adds differences, summed per second map-side;
    they are summed up inside days and by days. Rates are summed in millionths, so exactly. A span of more than
    `MOST_SECONDS` is an error.
    """
    placed, origin, span = _placed(flows, pps, fps, timeout, seconds)
    rows = placed if mask is None else placed.filter(mask)
    per_second = _steps(rows, origin, span, timeout, []).groupBy("second").agg(F.sum("df").alias("df"), F.sum("do").alias("do"))
    out = _running(per_second.withColumn("level", F.lit(0)), span, [0])
    return out.select("second", "flows", (F.col("_octets") / MICRO).alias("octets"))


ALL = -1  # the level of the series over all flows


def occupancy_levels(flows: DataFrame, level: Column, levels: int, pps: int | None = None, fps: int | None = None,
                     timeout: int = 15, seconds: int | None = None) -> DataFrame:
    """`(level, second, flows, octets)`: for each i below `levels` the occupancy by flows whose `level` is above i, and by all.

    With the number of thresholds below a prediction as `level`, these are the series of all thresholds. Differences are
    summed once per (level, second), whatever the number of levels; sums along the seconds, then down the levels, give
    the series. Null levels count as 0; the series over all flows has level `ALL`.
    """
    placed, origin, span = _placed(flows, pps, fps, timeout, seconds)
    steps = _steps(placed, origin, span, timeout, [F.least(F.greatest(F.coalesce(level, F.lit(0)), F.lit(0)), F.lit(levels)).cast("int").alias("m0")])
    per = steps.groupBy(F.col("m0").alias("level"), "second").agg(F.sum("df").alias("df"), F.sum("do").alias("do"))
    run = _running(per, span, range(levels + 1))
    down = Window.partitionBy("second").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)  # levels + 1 rows
    return run.select((F.col("level") - 1).alias("level"), "second", F.sum("flows").over(down).alias("flows"),
                      (F.sum("_octets").over(down) / MICRO).alias("octets"))


def occupancy_masks(flows: DataFrame, masks: Sequence[Column], pps: int | None = None, fps: int | None = None,
                    timeout: int = 15, seconds: int | None = None) -> DataFrame:
    """`(level, second, flows, octets)`: the occupancy by the flows of each mask (level: its place), and by all (`ALL`).

    One scan and one aggregate: a flow adds its differences to each level whose mask it meets.
    """
    placed, origin, span = _placed(flows, pps, fps, timeout, seconds)
    met = F.array_compact(F.array(F.lit(ALL), *[F.when(m, F.lit(i)) for i, m in enumerate(masks)]))
    steps = _steps(placed.withColumn("_met", met), origin, span, timeout, [F.col("_met").alias("m0")])
    per = steps.groupBy("m0", "second").agg(F.sum("df").alias("df"), F.sum("do").alias("do"))  # sets of levels are few beside the flows
    per = per.select(F.explode("m0").alias("level"), "second", "df", "do").groupBy("level", "second").agg(F.sum("df").alias("df"), F.sum("do").alias("do"))
    out = _running(per, span, range(ALL, len(masks)))
    return out.select("level", "second", "flows", (F.col("_octets") / MICRO).alias("octets"))


def _ratios(pairs: DataFrame, start: int, end: int, by: Sequence[str]) -> DataFrame:
    window = (F.col("second") >= start) & (F.col("second") < end)
    j = pairs.select("*", F.when(window, F.try_divide("bf", "mf")).alias("r"), F.when(window, F.try_divide("mo", "bo")).alias("c"))
    return j.groupBy(*by).agg(
        F.min("c").alias("min_coverage"), F.avg("c").alias("mean_coverage"), F.max("c").alias("max_coverage"),
        F.min("r").alias("min_reduction"), F.avg("r").alias("mean_reduction"), F.max("r").alias("max_reduction"),
        F.try_divide(F.sum("mo"), F.sum("bo")).alias("total_coverage"),
        F.try_divide(F.sum("bf"), F.sum("mf")).alias("total_reduction"),
    )


def occupancy_ratio(base: DataFrame, masked: DataFrame, start: int = 300, end: int = 720) -> DataFrame:
    """One row: flow table reduction and traffic coverage per second, least / mean / greatest on [start, end) and
    over all seconds."""
    return _ratios(base.select("second", F.col("flows").alias("bf"), F.col("octets").alias("bo")).join(
        masked.select("second", F.col("flows").alias("mf"), F.col("octets").alias("mo")), "second"), start, end, [])


def occupancy_ratios(series: DataFrame, start: int = 300, end: int = 720) -> DataFrame:
    """`occupancy_ratio` of every level of `occupancy_levels` or `occupancy_masks` to the series over all flows."""
    base = series.filter(F.col("level") == ALL).select("second", F.col("flows").alias("bf"), F.col("octets").alias("bo"))
    part = series.filter(F.col("level") != ALL).select("level", "second", F.col("flows").alias("mf"), F.col("octets").alias("mo"))
    return _ratios(part.join(base, "second"), start, end, ["level"])
