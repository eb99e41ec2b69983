"""Decisions about rows, for tables whose ids may be null or shared and whose columns may have any names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import freeze


def unused(docs: DataFrame, name: str) -> str:
    """`name`, with a number behind it if `docs` has such a column (names are compared without case)."""
    taken = {c.lower() for c in docs.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(len(taken) + 1))) if n.lower() not in taken)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a number per row, written once so that numbers last, and the name of that column."""
    name = unused(docs, "row")
    return freeze(docs.withColumn(name, F.monotonically_increasing_id())), name


def without(rows: DataFrame, name: str, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """The numbered rows but those whose number is a `key` of `gone`, and without the number."""
    return rows.join(gone.select(F.col(key).alias(name)), name, "left_anti").select(*[f"`{c}`" for c in rows.columns if c != name])
