"""Sorting by key fields, stable in `pos`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.operators.positions import number_rows


def _order(keys: Sequence[str], reverse: bool, pos: str):
    direction = F.desc if reverse else F.asc
    return [direction(k) for k in [*keys, pos]]


def sort_flows(flows: DataFrame, keys: Sequence[str], reverse: bool = False, pos: str = "pos") -> DataFrame:
    """Range-partitioned total order; a reversed sort also reverses ties. Write it out to keep the order."""
    return flows.orderBy(*_order(keys, reverse, pos))


def sort_ranked(flows: DataFrame, keys: Sequence[str], reverse: bool = False, pos: str = "pos") -> DataFrame:
    """The rows with their `rank` in the order of `sort_flows`: the permutation joined back, so rows are moved once and
    not written."""
    return apply_index(flows, sort_index(flows, keys, reverse, pos), pos).select(*flows.columns, "rank")


def sort_index(flows: DataFrame, keys: Sequence[str], reverse: bool = False, pos: str = "pos") -> DataFrame:
    """The permutation `(rank, pos)`: key columns and `pos` are moved, and only `pos` is written with its place."""
    slim = flows.select(*dict.fromkeys([*keys, pos])).orderBy(*_order(keys, reverse, pos)).select(pos)
    return number_rows(slim, "rank").select("rank", pos)


def apply_index(df: DataFrame, index: DataFrame, pos: str = "pos") -> DataFrame:
    """Put any columns that carry `pos` into the order of a stored permutation (both sides are unique in `pos`)."""
    return df.join(index, pos)
