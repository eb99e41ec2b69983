"""Connected components of an edge table, by alternating star contractions on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import forest, freeze


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning stars of each batch: never more rows than came in, and far fewer inside dense groups."""
    for part in batches:
        u, v = forest(part["u"].to_numpy(), part["v"].to_numpy())
        yield pd.DataFrame({"u": u, "v": v})


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    lower = e.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """`node, root` for every node of `edges(u, v)` (long) that is not the smallest node of its component.

    Each round links every node to the smallest of its neighbours (a large star, then a small star). The least
    neighbour is a map-side combined minimum, and the joins back are plain equi-joins whose hot side adaptive execution
    may split, so a giant component has no single task. Rounds are written to the checkpoint folder; their number
    grows with the logarithm of the longest path. Nulls and self-loops in `edges` are ignored; no edges give no rows.
    """
    e = edges.filter("u is not null and v is not null and u <> v").mapInPandas(_local, "u long, v long")
    e = freeze(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        seen = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == before or not seen[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = seen
        e = freeze(_small_star(_large_star(e).distinct()).distinct())
