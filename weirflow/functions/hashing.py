"""Deterministic pseudo-random numbers from row ids: equal on every run, partitioning and retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 52  # what a double holds exactly


def hash_bits(seed: int | str, *ids: Column) -> Column:
    """52 pseudo-random bits as bigint."""
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in ids])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def uniform(seed: int | str, *ids: Column) -> Column:
    """Uniform double in [0, 1)."""
    return hash_bits(seed, *ids) / F.lit(float(1 << HASH_BITS))
