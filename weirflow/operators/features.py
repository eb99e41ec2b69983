"""Classifier inputs from the 5-tuple, and their entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Order of the inputs and their widths in bytes; bytes of a value go from low to high.
INPUTS = [("sp", 2), ("sa3", 4), ("da3", 4), ("dp", 2), ("prot", 1)]


def byte_columns() -> list[Column]:
    return [
        F.shiftright(F.col(name).cast("long"), 8 * i).bitwiseAND(F.lit(255)).cast("int")
        for name, width in INPUTS for i in range(width)
    ]


def bit_array(kind: str = "int") -> Column:
    """Bits of the same bytes, high bit of each byte first, as numbers of the given type.

    Bytes are looked up in a constant table: 104 shift expressions would make a method too long to be compiled to
    machine code.
    """
    table = F.expr("array(" + ", ".join("array(" + ", ".join(f"{v:08b}") + ")" for v in range(256)) + ")").cast(f"array<array<{kind}>>")
    return F.flatten(F.array(*[F.get(table, b) for b in byte_columns()]))


def feature_array(kind: str) -> Column:
    """The inputs as one array: 5 raw values, 13 bytes or 104 bits."""
    if kind == "raw":
        return F.array(*[F.col(name).cast("long") for name, _ in INPUTS])
    return {"bytes": lambda: F.array(*byte_columns()), "bits": bit_array}[kind]()


def with_features(flows: DataFrame, kind: str = "raw", name: str = "features") -> DataFrame:
    """Add the inputs as an ML vector."""
    from pyspark.ml.functions import array_to_vector

    values = bit_array("double") if kind == "bits" else feature_array(kind).cast("array<double>")
    return flows.withColumn(name, array_to_vector(values))


def _byte_counts(flows: DataFrame) -> DataFrame:
    """Rows per byte place and value: at most 13 * 256 groups, combined map-side."""
    return flows.select(F.posexplode(F.array(*byte_columns())).alias("place", "value")).groupBy("place", "value").agg(
        F.count("*").alias("n"))


def _entropy(n: str, by: str) -> Column:
    """Base-2 entropy of counts `n`: log2(N) - sum(n log2 n) / N."""
    return F.log2(F.sum(n)) - F.sum(F.col(n) * F.log2(n)) / F.sum(n)


def entropy_bytes(flows: DataFrame) -> DataFrame:
    return _byte_counts(flows).groupBy("place").agg(_entropy("n", "place").alias("entropy"))


def entropy_bits(flows: DataFrame) -> DataFrame:
    """Entropy of each bit, counted from the byte counts instead of from the flows."""
    bits = _byte_counts(flows).select(
        "place", "n", F.posexplode(F.array(*[F.shiftright("value", 7 - i).bitwiseAND(F.lit(1)) for i in range(8)])).alias("bit", "v"))
    per_value = bits.groupBy((F.col("place") * 8 + F.col("bit")).alias("place"), "v").agg(F.sum("n").alias("n"))
    return per_value.groupBy("place").agg(_entropy("n", "place").alias("entropy"))
