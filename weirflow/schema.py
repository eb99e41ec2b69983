"""The flow record."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names, their order and their storage codes are the interchange format.
# B = unsigned 8 bit, H = unsigned 16 bit, I = unsigned 32 bit, Q = unsigned 64 bit, little-endian.
FIELD_CODES = {
    "af": "B", "prot": "B", "inif": "H", "outif": "H",
    "sa0": "I", "sa1": "I", "sa2": "I", "sa3": "I",
    "da0": "I", "da1": "I", "da2": "I", "da3": "I",
    "sp": "H", "dp": "H",
    "first": "I", "first_ms": "H", "last": "I", "last_ms": "H",
    "packets": "Q", "octets": "Q", "aggs": "I",
}

FIELDS = list(FIELD_CODES)
KEY_FIELDS = FIELDS[: FIELDS.index("first")]

SPARK_TYPES = {"B": T.IntegerType(), "H": T.IntegerType(), "I": T.LongType(), "Q": T.LongType()}

FLOW_SCHEMA = T.StructType([T.StructField(name, SPARK_TYPES[code]) for name, code in FIELD_CODES.items()])

HIST_COLUMNS = ["bin_lo", "bin_hi", "flows_sum", "packets_sum", "octets_sum"]

X_VALUES = ("length", "size", "duration", "rate")


def as_flows(df):
    """Cast and order the columns of `df` to the flow schema; further columns (such as `pos`) follow."""
    extra = [c for c in df.columns if c not in FIELD_CODES]
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in FLOW_SCHEMA], *extra)
