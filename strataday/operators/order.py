"""Sorting and display order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def arrange(df: DataFrame, *keys: str, ties: Sequence[str] = ()) -> DataFrame:
    """Global sort, NULLs last.

    ``ties`` are further columns for a total order. They make the result
    repeatable and let the range partitioner cut through a key that very many
    rows share. Use it at the sink only: rows have no order in between.
    """
    return df.orderBy(*[F.asc_nulls_last(k) for k in (*keys, *ties)])


def category_ordinal(category: Column | str, levels: Sequence[str]) -> Column:
    """1-based position in a fixed display order; NULL for a value not listed."""
    value = F.col(category) if isinstance(category, str) else category
    position = F.array_position(F.array(*[F.lit(x) for x in levels]), value)
    return F.nullif(position, F.lit(0)).cast("int")
