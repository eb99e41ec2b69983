"""Inputs with a row position: list order of the files, then row order in the file."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.session import broadcast_if


def read_parquet(spark: SparkSession, paths: str | Sequence[str], pos: str = "pos") -> DataFrame:
    """Parquet with `pos`, the global row number: inputs in list order, files of a folder sorted by path.

    The row number in a file is scan metadata, so nothing is sorted or shuffled. Only for several files is there a
    join, with one offset row per file, broadcast while there are not too many.
    """
    inputs = [paths] if isinstance(paths, str) else list(paths)
    parts = []
    for i, path in enumerate(inputs):
        df = spark.read.option("recursiveFileLookup", "true").parquet(path)
        parts.append((i, df, df.inputFiles()))
    total = sum(len(files) for _, _, files in parts)
    if total == 1:
        df = next(df for _, df, files in parts if files)
        return df.select("*", F.col("_metadata.row_index").alias(pos))
    tagged = [
        df.select("*", F.lit(i).alias("_input"), F.col("_metadata.file_path").alias("_file"),
                  F.col("_metadata.row_index").alias("_row"))
        for i, df, _ in parts
    ]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    before = Window.orderBy("_input", "_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_input", "_file").agg(F.count("*").alias("_n")).select(
        "_input", "_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        rows.join(broadcast_if(offsets, total), ["_input", "_file"])
        .withColumn(pos, F.col("_offset") + F.col("_row"))
        .drop("_input", "_file", "_row", "_offset")
    )


def list_inputs(paths: Sequence[str]) -> list[str]:
    """Expand folders into their files (recursive, sorted); list order is kept and a missing path is an error."""
    files: list[str] = []
    for p in paths:
        if os.path.isdir(p):
            files += sorted(os.path.join(root, n) for root, _, names in os.walk(p) for n in names)
        elif os.path.isfile(p):
            files.append(p)
        else:
            raise FileNotFoundError(p)
    return files
