"""Row positions, ranks and prefix sums without ever ordering a whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.flowcols import bin_low, idiv, log_bin_width, max_log_bins
from weirflow.session import freeze

ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits
POS_BUCKET = 1 << 20


def number_rows(df: DataFrame, name: str = "pos") -> DataFrame:
    """Number the rows of `df` from 0 in partition order.

    Partition id and row number are written out first, so that a lost executor cannot renumber them. The offsets
    have one row per partition, which bounds the broadcast.
    """
    frozen = freeze(
        df.withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        frozen.groupBy("_part").agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        frozen.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_row"))
        .select(*df.columns, name)
    )


def rank_rows(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Global rank from 0 under a total order: one range exchange plus partition offsets."""
    return number_rows(df.orderBy(*order), name)


def dense_rank(df: DataFrame, pos: str = "pos", name: str = "rank", width: int = POS_BUCKET // 16) -> DataFrame:
    """Rank from 0 of the unique non-negative integer column `pos`, also where it has holes.

    Rows are numbered inside buckets of `width` positions, which bounds every window, and moved by the number of rows
    in the buckets before.
    """
    b = df.withColumn("_b", idiv(F.col(pos), width))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    moved = b.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inner = b.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy(pos)) - 1)
    return inner.join(moved, "_b").select(*df.columns, (F.col("_o") + F.col("_i")).alias(name))


def nth_positions(df: DataFrame, ks: Sequence[int], pos: str = "pos", width: int = POS_BUCKET) -> list[int | None]:
    """Value of the unique non-negative integer column `pos` in the k-th row by `pos`, for each k from 0; None beyond the end."""
    found = nth_positions_by(df.withColumn("_all", F.lit(0)), "_all", [(0, k) for k in ks], pos, width)
    return [found.get((0, k)) for k in ks]


def nth_positions_by(df: DataFrame, by: str, wanted: Sequence[tuple[int, int]], pos: str = "pos",
                     width: int = POS_BUCKET) -> dict[tuple[int, int], int]:
    """`pos` of the k-th row by `pos` among those with `by` = v, for all pairs (v, k) together.

    Many order statistics by simultaneous refinement, in two passes whatever their number. First: rows per value and
    bucket of `width` positions, combined map-side. Second: only the buckets that hold an answer, which have at most
    `width` rows each because positions are unique. Pairs beyond the last row are left out.
    """
    wanted = sorted({(v, k) for v, k in wanted if k >= 0})
    if not wanted:
        return {}
    rows = df.filter(F.col(by).isin(sorted({v for v, _ in wanted}))).select(
        F.col(by).alias("_v"), F.col(pos).alias("_p"), idiv(F.col(pos), width).alias("_b"))
    targets = rows.sparkSession.createDataFrame(wanted, "_v long, _k long")  # one row per wanted position
    running = rows.groupBy("_v", "_b").agg(F.count("*").alias("_n")).withColumn(
        "_upto", F.sum("_n").over(Window.partitionBy("_v").orderBy("_b")))
    hits = running.join(F.broadcast(targets), "_v").filter(
        (F.col("_upto") > F.col("_k")) & (F.col("_upto") - F.col("_n") <= F.col("_k"))
    ).select("_v", "_b", "_k", (F.col("_k") - (F.col("_upto") - F.col("_n"))).alias("_i")).collect()
    if not hits:
        return {}
    buckets = rows.sparkSession.createDataFrame(sorted({(h["_v"], h["_b"]) for h in hits}), "_v long, _b long")
    inside = rows.join(F.broadcast(buckets), ["_v", "_b"]).withColumn("_i", F.row_number().over(Window.partitionBy("_v", "_b").orderBy("_p")) - 1)
    places = rows.sparkSession.createDataFrame([tuple(h) for h in hits], "_v long, _b long, _k long, _i long")
    found = inside.join(F.broadcast(places), ["_v", "_b", "_i"]).select("_v", "_k", "_p").collect()
    return {(r["_v"], r["_k"]): r["_p"] for r in found}


def prefix_sums(df: DataFrame, order: str, sums: dict[str, str], bucket: Column | None = None,
                descending: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sums {new column: summed column} along `order` (unique per row), and `{new}_total`.

    With `bucket`, `by` names groups whose sums run apart.

    Without `bucket` one window sorts the frame in one task: only for frames of bounded size (curves, log-binned
    histograms). With `bucket`, an expression that never decreases along `order` and takes a bounded number of
    values, sums run inside buckets and bucket totals are added.
    """
    direction = F.desc if descending else F.asc
    if bucket is None:
        w = Window.orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
        totals = df.agg(*[F.sum(c).alias(f"{n}_total") for n, c in sums.items()])
        return df.select("*", *[F.sum(c).over(w).alias(n) for n, c in sums.items()]).join(F.broadcast(totals))
    b = df.withColumn("_bucket", bucket)
    w_in = Window.partitionBy(*by, "_bucket").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    w_out = Window.partitionBy(*by).orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    per_bucket = b.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_b_{n}") for n, c in sums.items()])
    offsets = per_bucket.select(
        *by, "_bucket",
        *[F.coalesce(F.sum(f"_b_{n}").over(w_out), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_b_{n}").over(whole).alias(f"{n}_total") for n in sums])
    inner = b.select("*", *[F.sum(c).over(w_in).alias(n) for n, c in sums.items()])
    return inner.join(offsets, [*by, "_bucket"]).select(
        *df.columns, *[(F.col(n) + F.col(f"_o_{n}")).alias(n) for n in sums], *[f"{n}_total" for n in sums])


COARSE_EXP = 12
WINDOW_ROWS = max_log_bins(COARSE_EXP)  # rows that one window may take: all bins of a fine log-binned histogram


def self_bucketed(df: DataFrame, order: str, limit: int | None = None) -> tuple[DataFrame, Column | None]:
    """`df`, written once, and buckets along the unique non-negative integer column `order` if one window must not take it.

    One aggregate counts the rows of coarse log bins, of which there are at most `WINDOW_ROWS`. Neighbouring ones
    share a bucket until it has `limit` rows (`WINDOW_ROWS` by default); one with more is cut into equal stretches. Buckets never decrease along
    `order`, and there are about `rows / limit` of them. None for the buckets: the frame fits a single window.
    """
    frozen, limit = freeze(df), limit or WINDOW_ROWS
    if frozen.count() <= limit:
        return frozen, None
    per = frozen.groupBy(bin_low(F.col(order), COARSE_EXP).alias("_coarse")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    large = F.col("_n") > limit
    stretch = F.greatest(F.lit(1).cast("long"), idiv(log_bin_width(F.col("_coarse"), COARSE_EXP), idiv(F.col("_n"), limit)))
    plan = per.select("_coarse", idiv(F.coalesce(F.sum("_n").over(before), F.lit(0)), limit).alias("_slot"),
                      F.when(large, stretch).alias("_stretch"))
    inside = F.when(F.col("_stretch").isNull(), F.lit(0).cast("long")).otherwise(1 + idiv(F.col(order) - F.col("_coarse"), F.col("_stretch")))
    placed = frozen.withColumn("_coarse", bin_low(F.col(order), COARSE_EXP)).join(F.broadcast(plan), "_coarse")
    return placed.withColumn("_at", F.col("_slot") * (1 << 40) + inside).select(*df.columns, "_at"), F.col("_at")


def with_neighbours(df: DataFrame, order: str, bucket: Column | None = None) -> DataFrame:
    """Values of `order` in the rows before and after, as `_previous` and `_next`.

    With `bucket` they are looked up inside buckets, and carried over bucket edges from one row per bucket.
    """
    if bucket is None:
        w = Window.orderBy(order)
        return df.withColumn("_previous", F.lag(order).over(w)).withColumn("_next", F.lead(order).over(w))
    b = df.withColumn("_bucket", bucket)
    w = Window.orderBy("_bucket")
    edges = b.groupBy("_bucket").agg(F.min(order).alias("_min"), F.max(order).alias("_max")).select(
        "_bucket", F.lag("_max").over(w).alias("_left"), F.lead("_min").over(w).alias("_right"))
    inner = Window.partitionBy("_bucket").orderBy(order)
    b = b.withColumn("_previous", F.lag(order).over(inner)).withColumn("_next", F.lead(order).over(inner))
    return b.join(edges, "_bucket").select(
        *df.columns, F.coalesce("_previous", "_left").alias("_previous"), F.coalesce("_next", "_right").alias("_next"))
