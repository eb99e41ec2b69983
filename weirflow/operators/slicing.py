"""Filter and slices by row position (`pos` counts from 0 over all inputs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.operators.positions import nth_positions


def slice_in(df: DataFrame, skip: int = 0, count: int | None = None, pos: str = "pos") -> DataFrame:
    """Rows `skip .. skip+count-1` of the input as a range filter on `pos`: no sort, prunes row groups.

    A negative skip is 0; a count of 0 or less gives no rows; no count gives all.
    """
    low = max(skip or 0, 0)
    out = df.filter(F.col(pos) >= low) if low else df
    if count is not None:
        out = out.filter(F.col(pos) < low + max(count, 0))
    return out


def slice_out(df: DataFrame, skip: int = 0, count: int | None = None, pos: str = "pos") -> DataFrame:
    """The same slice counted over the rows that are left in `df` (after a filter).

    The slice borders are turned into two positions by a counting pass, and the rows come from a range filter.
    """
    low = max(skip or 0, 0)
    if count is not None and count <= 0:
        return df.filter(F.lit(False))
    wanted = [low] if low else []
    if count is not None:
        wanted.append(low + count)
    borders = dict(zip(wanted, nth_positions(df, wanted, pos)))
    out = df
    if low:
        if borders[low] is None:
            return df.filter(F.lit(False))
        out = out.filter(F.col(pos) >= borders[low])
    if count is not None and borders[low + count] is not None:
        out = out.filter(F.col(pos) < borders[low + count])
    return out


def convert(df: DataFrame, skip_in: int = 0, count_in: int | None = None, where: str | Column | None = None,
            skip_out: int = 0, count_out: int | None = None, fields: list[str] | None = None,
            pos: str = "pos") -> DataFrame:
    """Input slice, filter, output slice and projection; the sink is any writer."""
    out = slice_in(df, skip_in, count_in, pos)
    if where is not None:
        out = out.filter(where)
    out = slice_out(out, skip_out, count_out, pos)
    return out.select(*fields) if fields else out


def cut_range(skip_in: int = 0, count_in: int | None = None, skip_out: int = 0,
              count_out: int | None = None) -> tuple[int, int | None]:
    """Fold an output slice into the input slice (possible because nothing is filtered in between)."""
    first, skip_out = max(skip_in or 0, 0), max(skip_out or 0, 0)
    left = None if count_in is None else max(max(count_in, 0) - skip_out, 0)
    if count_out is not None:
        left = max(count_out, 0) if left is None else min(left, max(count_out, 0))
    return first + skip_out, left


def cut(df: DataFrame, skip_in: int = 0, count_in: int | None = None, skip_out: int = 0,
        count_out: int | None = None, pos: str = "pos") -> DataFrame:
    """Unfiltered slice: one position range, also understood by the array source as a read range."""
    return slice_in(df, *cut_range(skip_in, count_in, skip_out, count_out), pos)


def slice_fraction(df: DataFrame, skip: int | float = 0, count: int | float | None = None,
                   pos: str = "pos") -> DataFrame:
    """Slice where a float is a share of the row count; count 0 or None keeps everything after `skip`."""
    if isinstance(skip, float) or isinstance(count, float):
        total = df.count()
        skip = int(total * skip) if isinstance(skip, float) else skip
        count = int(total * count) if isinstance(count, float) and count else count
    return slice_in(df, skip, count or None, pos)
