"""Stored decisions: bit-packed blocks, one row per model, fold, level and block of positions."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions.flowcols import idiv

WORD = 64
WORDS = 1024  # words of a block, so 65536 positions


def pack_decisions(rows: DataFrame, decisions: Sequence[Column], pos: str = "pos", by: Sequence[str] = ()) -> DataFrame:
    """`by…, level, block, present, decided`: the decisions of every level (its place in the list), packed by blocks.

    Bit `pos % 64` of word `pos / 64 % WORDS` stands for a position; `present` has the bits of the positions that the
    rows hold, so tables with holes come back as they were. All levels' words are built by one bitwise aggregate,
    map-side first, and only these are spread over levels; a block's at most `WORDS` words are then put in order. Null
    decisions count as false, rows without `pos` are left out.
    """
    names = [f"d{i}" for i in range(len(decisions))]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(pos), F.lit(WORD)).cast("int"))
    own = rows.filter(F.col(pos).isNotNull()).select(
        *by, idiv(F.col(pos), WORD).alias("_w"), bit.alias("_bit"), *[d.alias(n) for d, n in zip(decisions, names)])
    words = own.groupBy(*by, "_w").agg(
        F.bit_or("_bit").alias("present"), *[F.bit_or(F.when(F.col(n), F.col("_bit")).otherwise(F.lit(0).cast("long"))).alias(n) for n in names])
    words = words.select(*by, "_w", "present", F.posexplode(F.array(*names)).alias("level", "decided"))
    words = words.withColumn("block", idiv(F.col("_w"), WORDS)).withColumn("_i", (F.col("_w") % WORDS).cast("int"))
    blocks = words.groupBy(*by, "level", "block").agg(F.map_from_entries(F.collect_list(F.struct(
        "_i", F.struct("present", "decided").alias("w")))).alias("m"))

    def dense(field: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("m"))), lambda i: F.coalesce(F.col("m")[i][field], F.lit(0).cast("long")))

    return blocks.select(*by, "level", "block", dense("present").alias("present"), dense("decided").alias("decided"))


def unpack_decisions(packed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """`by…, level, pos, decision`: the packed rows again."""
    words = packed.select(*by, "level", "block", F.posexplode(F.arrays_zip("present", "decided")).alias("_i", "_w"))
    bits = words.filter(F.col("_w.present") != 0).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))))

    def bit(field: str) -> Column:
        return F.call_function("getbit", F.col(f"_w.{field}"), F.col("_b")) == 1

    pos = (F.col("block") * WORDS + F.col("_i")) * WORD + F.col("_b")
    return bits.filter(bit("present")).select(*by, "level", pos.alias("pos"), bit("decided").alias("decision"))


def write_decisions(packed: DataFrame, path: str, model: dict[str, object] | None = None) -> None:
    """Parquet in a partition folder of its own per model, so that a model written again replaces itself."""
    folder = "".join(f"/{k}={quote(str(v), safe='')}" for k, v in (model or {}).items())
    packed.write.mode("overwrite").parquet(f"{path}{folder}")


def read_decisions(spark: SparkSession, path: str, by: Sequence[str] = ("algo", "prep", "mode", "fold", "kind")) -> DataFrame:
    return unpack_decisions(spark.read.parquet(path), by)
