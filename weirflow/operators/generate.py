"""Synthetic flows that follow a histogram or a mixture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions.flowcols import idiv
from weirflow.functions.hashing import uniform
from weirflow.operators.mixture import Mixture, mix_average, sample
from weirflow.operators.positions import WINDOW_ROWS, prefix_sums, self_bucketed
from weirflow.schema import FIELDS, as_flows
from weirflow.session import broadcast_if

# Packet sizes are kept between these
MIN_PACKET, MAX_PACKET = 64, 1522
ROWS_PER_TASK = 5_000_000
CHUNK = 10_000


def _tasks(spark: SparkSession, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def complete_flow(x: Column, packet_size: Column, x_value: str, u: Column) -> tuple[Column, Column]:
    """Whole packets and octets of a flow from its length or size and mean packet size.

    The side that is not given is rounded up or down at random, in proportion to its fraction, so means are kept.
    """
    if x_value == "length":
        octets = x * F.least(F.greatest(packet_size, F.lit(float(MIN_PACKET))), F.lit(float(MAX_PACKET)))
        return x.cast("long"), _round_at_random(octets, u)
    if x_value == "size":
        packets = x / packet_size
        packets = F.when(x / F.ceil(packets) < MIN_PACKET, F.floor(packets).cast("double")).otherwise(packets)
        return _round_at_random(F.greatest(packets, F.lit(1.0)), u), x.cast("long")
    raise ValueError(f"cannot generate flows by {x_value}")


def _round_at_random(value: Column, u: Column) -> Column:
    low = F.floor(value)
    return F.when(u + low >= value, low).otherwise(low + 1).cast("long")


def sample_histogram(histogram: DataFrame, n: int, x_value: str = "length", seed: int = 0,
                     bucket: Column | None = None) -> DataFrame:
    """`n` flows `(id, packets, octets)` drawn from the bins with replacement, by their number of flows.

    A hash gives every id a place on the line of running flow counts. The line is cut into equal stretches and each
    bin listed in the stretches it covers, so an id meets one or two bins in an equi-join whose keys are uniform
    whatever the histogram. The bin side is broadcast while it is small.
    """
    spark = histogram.sparkSession
    histogram = histogram.filter("flows_sum > 0")
    bins, total = histogram.agg(F.count("*"), F.sum("flows_sum")).first()
    if not bins:
        return spark.range(0).select("id", F.lit(0).cast("long").alias("packets"), F.lit(0).cast("long").alias("octets"))
    stretches = 1 << max(bins - 1, 1).bit_length()
    width = max(1, -(-total // stretches))
    if bucket is None and bins > WINDOW_ROWS:
        histogram, bucket = self_bucketed(histogram, "bin_lo")
    line = prefix_sums(histogram, "bin_lo", {"_hi": "flows_sum"}, bucket).select(
        F.col("bin_lo").alias("x"), (F.col("octets_sum") / F.col("packets_sum")).alias("packet_size"),
        (F.col("_hi") - F.col("flows_sum")).alias("_lo"), "_hi")
    line = line.filter(F.col("_hi") > F.col("_lo")).withColumn(
        "_stretch", F.explode(F.sequence(idiv(F.col("_lo"), width), idiv(F.col("_hi") - 1, width))))
    line = broadcast_if(line, bins + stretches)
    ids = spark.range(0, n, 1, _tasks(spark, n))
    drawn = ids.withColumn("_t", F.floor(uniform(seed, F.col("id")) * F.lit(total))).withColumn("_stretch", idiv(F.col("_t"), width))
    rows = drawn.join(line, "_stretch").filter((F.col("_t") >= F.col("_lo")) & (F.col("_t") < F.col("_hi")))
    packets, octets = complete_flow(F.col("x"), F.col("packet_size"), x_value, uniform(f"{seed}r", F.col("id")))
    return rows.select("id", packets.alias("packets"), octets.alias("octets"))


def expand_histogram(histogram: DataFrame, x_value: str = "length", seed: int = 0) -> DataFrame:
    """Every bin as many times as it has flows: `(x, copy, packets, octets)`.

    Bins are cut into chunks before the exchange, so that a bin with a third of all flows is made by many tasks.
    """
    spark = histogram.sparkSession
    histogram = histogram.filter("flows_sum > 0")
    total = histogram.agg(F.sum("flows_sum")).first()[0] or 0
    chunks = histogram.select(
        F.col("bin_lo").alias("x"), (F.col("octets_sum") / F.col("packets_sum")).alias("packet_size"), "flows_sum",
        F.explode(F.sequence(F.lit(0).cast("long"), idiv(F.col("flows_sum") - 1, CHUNK))).alias("chunk"))
    chunks = chunks.repartition(_tasks(spark, total), "x", "chunk")
    first = F.col("chunk") * CHUNK
    rows = chunks.withColumn("copy", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("flows_sum")) - 1)))
    packets, octets = complete_flow(F.col("x"), F.col("packet_size"), x_value, uniform(seed, F.col("x"), F.col("copy")))
    return rows.select("x", "copy", packets.alias("packets"), octets.alias("octets"))


def sample_mixture(spark: SparkSession, mixtures: dict[str, tuple[int, Mixture]], n: int, x_value: str = "length",
                   seed: int = 0) -> DataFrame:
    """`n` flows `(id, packets, octets)` from the `flows` mixture, packet sizes from `octets` and `packets`."""
    x = sample(spark, mixtures["flows"][1], n, x_value, seed)
    sized = x.withColumn("packet_size", mix_average(mixtures, F.col("x").cast("double"), "packet_size", x_value))
    sized = sized.withColumn("packet_size", F.coalesce("packet_size", F.lit(float(MIN_PACKET))))
    packets, octets = complete_flow(F.col("x"), F.col("packet_size"), x_value, uniform(f"{seed}r", F.col("id")))
    return sized.select("id", packets.alias("packets"), octets.alias("octets"))


def to_flows(generated: DataFrame) -> DataFrame:
    """Generated packets and octets as flow records, all other fields 0."""
    return as_flows(generated.select(*[F.lit(0).alias(f) for f in FIELDS if f not in ("packets", "octets")], "packets", "octets"))
