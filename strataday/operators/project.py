"""Projection operators: positions, renames and column-wise maps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import named

EPSG_WGS84 = 4326


def select_positions(df: DataFrame, *spec: int | tuple[int, int]) -> DataFrame:
    """Select, and thereby reorder, by 1-based position or inclusive ``(from, to)`` range."""
    positions: list[int] = []
    for item in spec:
        positions.extend(range(item[0], item[1] + 1) if isinstance(item, tuple) else [item])
    bad = [p for p in positions if not 1 <= p <= len(df.columns)]
    if bad:
        raise ValueError(f"positions {bad} are outside 1..{len(df.columns)}")
    return df.select(*[named(df.columns[p - 1]) for p in positions])


def rename_positions(df: DataFrame, names: Mapping[int, str]) -> DataFrame:
    """Rename by 1-based position."""
    bad = [p for p in names if not 1 <= p <= len(df.columns)]
    if bad:
        raise ValueError(f"positions {bad} are outside 1..{len(df.columns)}")
    return df.toDF(*[names.get(i, c) for i, c in enumerate(df.columns, start=1)])


def map_columns(df: DataFrame, columns: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply ``fn`` to the named columns in place."""
    return df.withColumns({c: fn(F.col(c)) for c in columns})


def map_columns_if(
    df: DataFrame, predicate: Callable[[T.DataType], bool], fn: Callable[[Column], Column]
) -> DataFrame:
    """Apply ``fn`` to every column whose type satisfies ``predicate``."""
    chosen = [f.name for f in df.schema.fields if predicate(f.dataType)]
    return map_columns(df, chosen, fn) if chosen else df


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def with_point(
    df: DataFrame, lon: str, lat: str, name: str = "geometry", srid: int = EPSG_WGS84
) -> DataFrame:
    """Replace a lon/lat pair by a point struct and its coordinate-system tag."""
    return df.withColumns({
        name: F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat")),
        "srid": F.lit(srid),
    }).drop(lon, lat)
