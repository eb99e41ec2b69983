"""Per-second time series of flows, packets and octets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions import flowcols as fc
from weirflow.functions.flowcols import idiv

DAY = 86400
METRICS = ["flows", "packets", "octets"]


def _by_day(per_second: DataFrame, metrics: list[str]) -> DataFrame:
    return per_second.select(
        idiv(F.col("_s"), DAY).alias("day"), (F.col("_s") % DAY).cast("int").alias("second"), *metrics
    )


def arrival_series(flows: DataFrame) -> DataFrame:
    """Flows started per second."""
    per_second = flows.groupBy(F.col("first").alias("_s")).agg(F.count("*").alias("flows"))
    return _by_day(per_second, ["flows"])


def traffic_series(flows: DataFrame, first_n: int | None = None) -> DataFrame:
    """Flows, packets and octets per second, the packets of a flow being spread evenly over its duration.

    Packet n of P starts `n * duration / P` after the flow; cumulative octets after k packets are `k * octets // P`,
    so sizes are integers and add up. A flow contributes one row per packet or one per second, whichever is less,
    and these rows are summed map-side. With `first_n` only the first N packets of each flow count.
    """
    if first_n is not None and first_n <= 0:
        flows, first_n = flows.filter(F.lit(False)), None
    p = F.col("packets")
    base = flows.select(
        "first",
        F.col("first_ms").cast("long").alias("f"),
        p.alias("p"),
        fc.duration_ms().alias("d"),
        (p if first_n is None else F.least(p, F.lit(first_n).cast("long"))).alias("m"),
        idiv(F.col("octets"), p).alias("q"),
        (F.col("octets") % p).alias("r"),
    ).withColumn("last_s", F.expr("(f * p + (m - 1) * d) div (1000 * p)"))
    rows = base.withColumn("i", F.explode(F.expr("sequence(0L, least(m - 1, last_s))")))
    per_packet = F.expr("m <= last_s + 1")

    def packets_up_to(second: str):
        """Packets that start before the end of `second`, counted from the second in which the flow starts."""
        border = f"(({second} + 1) * 1000 * p - f * p)"
        return F.expr(f"case when d = 0 then m else least(m, ({border} + d - 1) div d) end")

    rows = (
        rows.withColumn("_s", F.col("first") + F.when(per_packet, F.expr("(f * p + i * d) div (1000 * p)")).otherwise(F.col("i")))
        .withColumn("k1", F.when(per_packet, F.col("i") + 1).otherwise(packets_up_to("i")))
        .withColumn("k0", F.when(per_packet | (F.col("i") == 0), F.col("i")).otherwise(packets_up_to("(i - 1)")))
    )
    per_second = rows.groupBy("_s").agg(
        F.sum(F.when(F.col("i") == 0, 1).otherwise(0)).alias("flows"),
        F.sum(F.expr("k1 - k0")).alias("packets"),
        F.sum(F.expr("(k1 - k0) * q + (k1 * r) div p - (k0 * r) div p")).alias("octets"),
    )
    return _by_day(per_second, METRICS)


def touched_days(flows: DataFrame) -> DataFrame:
    """Days between the start and the end of any flow."""
    end = F.when(F.col("packets") == 1, F.col("first")).otherwise(F.col("last"))
    days = F.sequence(idiv(F.col("first"), DAY), idiv(end, DAY))
    return flows.select(days.alias("d")).distinct().select(F.explode("d").alias("day")).distinct()


def dense(series: DataFrame, days: DataFrame) -> DataFrame:
    """Every second of every day in `days`, zero where nothing happened."""
    metrics = [c for c in series.columns if c not in ("day", "second")]
    seconds = days.select("day", F.explode(F.sequence(F.lit(0), F.lit(DAY - 1))).alias("second"))
    return seconds.join(series, ["day", "second"], "left").select(
        "day", "second", *[F.coalesce(F.col(m), F.lit(0).cast("long")).alias(m) for m in metrics]
    )


def rolling_mean(dense_series: DataFrame, rows: int = 30) -> DataFrame:
    """Trailing mean over `rows` seconds in each day (a day has 86400 rows); octets are shown as bits."""
    w = Window.partitionBy("day").orderBy("second").rowsBetween(-(rows - 1), 0)
    metrics = [c for c in dense_series.columns if c not in ("day", "second")]
    out = []
    for m in metrics:
        if m == "octets":
            out.append(F.avg(F.col(m) * 8).over(w).alias("bits_mean"))
        else:
            out.append(F.avg(m).over(w).alias(f"{m}_mean"))
    return dense_series.select("day", "second", *out)


def daily_totals(series: DataFrame) -> DataFrame:
    """Sums per day with the calendar date; octets also as bits."""
    metrics = [c for c in series.columns if c not in ("day", "second")]
    out = series.groupBy("day").agg(*[F.sum(m).alias(m) for m in metrics])
    out = out.withColumn("date", F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd"))
    return out.withColumn("bits", F.col("octets") * 8) if "octets" in metrics else out
