"""Merging of flow records that the exporter split at its active timeout.

Per key and in time order a record can be continued only if it lasted at least `active - inactive` seconds (a
candidate). The next record of the key continues it when it starts later than it ended and less than `inactive`
after; overlapping a waiting record is a collision that drops both. Everything is computed by window functions
over the key, so the plan has one exchange. Keys with more rows than one task should hold take a second path, where
the rows are cut into range chunks and only what a chunk leaves behind is carried to the next one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions import flowcols as fc
from weirflow.functions.flowcols import idiv
from weirflow.schema import FIELDS, KEY_FIELDS, as_flows
from weirflow.session import broadcast_if, freeze

ORDER = ["start_ms", "end_ms", "pos"]


@dataclass(frozen=True)
class Timeouts:
    inactive_ms: int
    active_ms: int

    @classmethod
    def of(cls, inactive_s: float, active_s: float) -> Timeouts:
        return cls(round(inactive_s * 1000), round(active_s * 1000))

    def candidate(self) -> Column:
        """Long enough, in whole seconds, to have been cut by the active timeout."""
        seconds = idiv(F.col("end_ms"), 1000) - idiv(F.col("start_ms"), 1000)
        return seconds * 1000 >= self.active_ms - self.inactive_ms


def _overlap(df: DataFrame, t: Timeouts, w, carried_end: Column | None) -> DataFrame:
    previous = F.lag("end_ms").over(w)
    if carried_end is not None:
        previous = F.coalesce(previous, carried_end)
    return (
        df.withColumn("_prev_end", previous)
        .withColumn("_ov", F.coalesce(F.col("start_ms") <= F.col("_prev_end"), F.lit(False)))
        .withColumn("_cand", t.candidate())
    )


def _waiting(df: DataFrame, by: Sequence[str], w) -> DataFrame:
    """`_st`: the record waits for a continuation after it was seen.

    Inside a run of overlapping candidates the state alternates, because each one collides with a waiting
    predecessor or starts to wait after a collision. `_seen` counts run starts, `_nth` is the place in the run.
    """
    in_run = F.col("_ov") & F.col("_cand")
    wr = Window.partitionBy(*by, "_seen").orderBy(*ORDER)
    return (
        df.withColumn("_seen", F.sum(F.when(in_run, 0).otherwise(1)).over(w))
        .withColumn("_nth", F.row_number().over(wr))
        .withColumn("_open", F.first(F.col("_cand") & ~F.col("_ov")).over(wr))
        .withColumn("_st", F.col("_open") == (F.col("_nth") % 2 == 1))
    )


def _collide(df: DataFrame, t: Timeouts, w, carried_state: Column) -> DataFrame:
    return (
        df.withColumn("_pst", F.coalesce(F.lag("_st").over(w), carried_state))
        .withColumn("_bad", F.col("_ov") & F.col("_pst"))
        .withColumn("_joined", F.coalesce(
            F.col("_pst") & ~F.col("_ov") & (F.col("start_ms") - F.col("_prev_end") < t.inactive_ms), F.lit(False)))
        .withColumn("_head", F.last(F.when(~F.col("_joined"), F.col("pos")), ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_killed", F.lead("_bad").over(w))
    )


def _flag_by_key(rec: DataFrame, keys: Sequence[str], t: Timeouts) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    out = _collide(_waiting(_overlap(rec, t, w, None), keys, w), t, w, F.lit(False))
    return out.withColumn("_killed", F.coalesce("_killed", F.lit(False)))


def _flag_by_chunk(rec: DataFrame, keys: Sequence[str], t: Timeouts, chunks: int, hot_keys: int) -> DataFrame:
    """The same flags for keys too large for one task.

    A range exchange on (key, time, pos) splits such a key into even chunks. A chunk needs four things from its
    neighbours: the end of the record before it, whether that record waits, the island it belongs to, and whether
    the first record after the chunk collides. Each comes from a summary with one row per (key, chunk), at most
    chunks + keys rows, and is broadcast while that is small.
    """
    by = [*keys, "_chunk"]
    bound = chunks + hot_keys
    w = Window.partitionBy(*by).orderBy(*ORDER)
    wc = Window.partitionBy(*keys).orderBy("_chunk")
    place = F.struct(*ORDER)
    rows = freeze(rec.repartitionByRange(chunks, *keys, *ORDER).withColumn("_chunk", F.spark_partition_id()))

    ends = rows.groupBy(*by).agg(F.max_by("end_ms", place).alias("_e"))
    ends = ends.select(*by, F.lag("_e").over(wc).alias("_carry_end"))
    x = _waiting(_overlap(rows.join(broadcast_if(ends, bound), by), t, w, F.col("_carry_end")), by, w)

    states = x.groupBy(*by).agg(
        F.max("_seen").alias("_breaks"), F.max_by("_st", place).alias("_last_st"), F.count("*").alias("_n"))
    whole = F.col("_breaks") == 0
    wg = Window.partitionBy(*keys, "_g").orderBy("_chunk")
    states = (
        states.withColumn("_g", F.sum(F.when(whole, 0).otherwise(1)).over(wc))
        .withColumn("_base", F.first(F.when(whole, F.lit(False)).otherwise(F.col("_last_st"))).over(wg))
        .withColumn("_flips", F.sum(F.when(whole, F.col("_n")).otherwise(0)).over(wg))
        .withColumn("_out", F.col("_base") != (F.col("_flips") % 2 == 1))
        .select(*by, F.coalesce(F.lag("_out").over(wc), F.lit(False)).alias("_in_st"))
    )
    x = x.join(broadcast_if(states, bound), by).withColumn(
        "_st", F.when(F.col("_seen") == 0, F.col("_in_st") != (F.col("_nth") % 2 == 1)).otherwise(F.col("_st")))
    x = _collide(x, t, w, F.col("_in_st"))

    edges = x.groupBy(*by).agg(F.max_by("_head", place).alias("_h"), F.min_by("_bad", place).alias("_b"))
    edges = edges.select(
        *by,
        F.last("_h", ignorenulls=True).over(wc.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry_head"),
        F.lead("_b").over(wc).alias("_next_bad"),
    )
    return (
        x.join(broadcast_if(edges, bound), by)
        .withColumn("_head", F.coalesce("_head", "_carry_head"))
        .withColumn("_killed", F.coalesce("_killed", "_next_bad", F.lit(False)))
    )


def _flag(rec: DataFrame, keys: Sequence[str], t: Timeouts, hot_rows: int | None) -> list[DataFrame]:
    if not hot_rows:
        return [_flag_by_key(rec, keys, t)]
    counts = freeze(rec.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > hot_rows))
    hot_keys, total = counts.agg(F.count("*"), F.sum("_rows")).first()
    if not hot_keys:
        return [_flag_by_key(rec, keys, t)]
    hot = broadcast_if(counts.select(*keys), hot_keys)
    chunks = max(2, -(-total // hot_rows))
    return [
        _flag_by_key(rec.join(hot, list(keys), "left_anti"), keys, t),
        _flag_by_chunk(rec.join(hot, list(keys), "left_semi"), keys, t, chunks, hot_keys),
    ]


def _islands(flagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    first_aggs = F.max(F.when(F.col("pos") == F.col("_head"), F.when(F.col("aggs") == 0, 1).otherwise(F.col("aggs"))))
    return flagged.groupBy(*keys, F.col("_head").alias("pos")).agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.sum("packets").alias("packets"),
        F.sum("octets").alias("octets"),
        (first_aggs + F.count("*") - 1).cast("long").alias("aggs"),
        F.sum(F.col("_bad").cast("int")).alias("_wrong"),
        F.sum(F.col("_joined").cast("int")).alias("_merged"),
        F.bool_or(F.col("_bad") | F.col("_killed")).alias("_dropped"),
    )


def _merged_islands(rec: DataFrame, keys, inactive_s, active_s, hot_rows) -> DataFrame:
    parts = [_islands(f, keys) for f in _flag(rec, keys, Timeouts.of(inactive_s, active_s), hot_rows)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_records(rec: DataFrame, keys: Sequence[str], inactive_s: float = 15.0, active_s: float = 300.0,
                  hot_rows: int | None = 5_000_000) -> DataFrame:
    """Merge records with columns `keys, pos, start_ms, end_ms, packets, octets, aggs`.

    `pos` of a merged record is that of its first piece. `hot_rows` is the largest number of rows of one key that a
    single task sorts; finding larger keys costs one combined count, None skips it.
    """
    out = _merged_islands(rec, keys, inactive_s, active_s, hot_rows)
    return out.filter(~F.col("_dropped")).drop("_wrong", "_merged", "_dropped")


def merge_stats(rec: DataFrame, keys: Sequence[str], inactive_s: float = 15.0, active_s: float = 300.0,
                hot_rows: int | None = 5_000_000) -> DataFrame:
    """One row: collisions (`wrong`), continuations (`merged`) and emitted records (`written`)."""
    return _merged_islands(rec, keys, inactive_s, active_s, hot_rows).agg(
        F.coalesce(F.sum("_wrong"), F.lit(0)).alias("wrong"),
        F.coalesce(F.sum("_merged"), F.lit(0)).alias("merged"),
        F.coalesce(F.sum(F.when(F.col("_dropped"), 0).otherwise(1)), F.lit(0)).alias("written"),
    )


def to_records(flows: DataFrame) -> DataFrame:
    return flows.select(*KEY_FIELDS, "pos", fc.start_ms().alias("start_ms"), fc.end_ms().alias("end_ms"),
                        "packets", "octets", "aggs")


def merge_flows(flows: DataFrame, inactive_s: float = 15.0, active_s: float = 300.0,
                hot_rows: int | None = 5_000_000) -> DataFrame:
    """Merge a flow table (with `pos`) on its 14 key fields."""
    merged = merge_records(to_records(flows), KEY_FIELDS, inactive_s, active_s, hot_rows)
    return as_flows(
        merged.withColumn("first", idiv(F.col("start_ms"), 1000)).withColumn("first_ms", F.col("start_ms") % 1000)
        .withColumn("last", idiv(F.col("end_ms"), 1000)).withColumn("last_ms", F.col("end_ms") % 1000)
        .select(*FIELDS, "pos")
    )
