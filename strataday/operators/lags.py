"""Lagged copies of variables inside a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.values import lag_name, named
from .joins import left_join
from .numbering import default_parts, ranges


def lag_columns(variable: str, window: WindowSpec, n: int = 6) -> list[Column]:
    """Row lags 1..n of one variable, named ``<variable>_lag<k>``."""
    return [F.lag(named(variable), k).over(window).alias(lag_name(variable, k)) for k in range(1, n + 1)]


def _fail_when(df: DataFrame, condition: Column, what: str) -> DataFrame:
    error = F.raise_error(F.lit(what)).cast("boolean")
    return (
        df.withColumn("__bad", condition)
        .where(F.when(F.col("__bad"), error).otherwise(F.lit(True)))
        .drop("__bad")
    )


def add_lags(
    df: DataFrame, variables: Sequence[str], n: int = 6, group: str = "County", date: str = "Date"
) -> DataFrame:
    """Lags by row position inside a group, in date order.

    All variables share one exchange and one sort. A repeated (group, date)
    fails the query; the check rides on the same sort, and it is also what
    bounds a group: it cannot hold more rows than there are days. Groups with
    repeated days go to :func:`add_lags_blocked`.
    """
    window = Window.partitionBy(group).orderBy(F.asc_nulls_last(date))
    lagged = df.select(
        "*", *[c for v in variables for c in lag_columns(v, window, n)],
        F.row_number().over(window).alias("__row"), F.lag(date, 1).over(window).alias("__previous"),
    )
    repeated = (F.col("__row") > 1) & F.col("__previous").eqNullSafe(F.col(date))
    return _fail_when(lagged, repeated, f"duplicate ({group}, {date})").drop("__row", "__previous")


def add_lags_blocked(
    df: DataFrame, variables: Sequence[str], n: int, group: str, order: Sequence[str],
    block: Column,
) -> DataFrame:
    """Row-position lags for groups too large for one task.

    ``block`` must be non-decreasing along ``order``: the date itself, its month, or, where a
    single day is too large, the date together with a coarse cut of the next order key.
    Lags are taken inside (group, block). Only the first ``n`` rows of a block
    can reach further back, and everything they can reach lies in the first or
    last ``n`` rows of a block, so a second window over just those edge rows
    gives their lags exactly.
    """
    cols = [named(c) for c in df.columns]
    keys = [F.asc_nulls_last(c) for c in order]
    inside = Window.partitionBy(group, "__block").orderBy(*keys)
    whole = Window.partitionBy(group, "__block")
    placed = df.withColumn("__block", block).select(
        *cols, "__block",
        *[c for v in variables for c in lag_columns(v, inside, n)],
        F.row_number().over(inside).alias("__rank"),
        F.count(F.lit(1)).over(whole).alias("__size"),
    )
    names = [named(lag_name(v, k)) for v in variables for k in range(1, n + 1)]
    body = placed.where(F.col("__rank") > n).select(*cols, *names)
    edges = placed.where(
        (F.col("__rank") <= n) | (F.col("__rank") > F.col("__size") - n)
    ).select(*cols, "__rank", "__block")
    across = Window.partitionBy(group).orderBy(*keys)
    heads = edges.select(
        "*", *[c for v in variables for c in lag_columns(v, across, n)],
        F.lag("__block", 1).over(across).alias("__before"),
    )
    heads = _fail_when(
        heads, F.coalesce(F.col("__before") > F.col("__block"), F.lit(False)),
        "block must not decrease along the order",
    ).where(F.col("__rank") <= n).select(*cols, *names)
    return body.unionByName(heads)


def add_lags_ranged(
    df: DataFrame, variables: Sequence[str], n: int, group: str, order: Sequence[str], parts: int | None = None
) -> DataFrame:
    """Row-position lags for groups of any size, in any order.

    The rows are cut into ranges of (group, order) of about equal size, several a task, whatever share of them a group
    or a day holds; within a range lags are taken directly, and the first rows of a range take
    theirs from the last rows of those before. ``order`` should be total; rows equal in all of it share a range.
    """
    cut = ranges(df, [group, *order], parts or 4 * default_parts(df))
    return add_lags_blocked(cut, variables, n, group, order, F.col("__range")).drop("__range")


def add_calendar_lags(
    df: DataFrame, variables: Sequence[str], n: int = 6, group: str = "County", date: str = "Date",
    on_dup: str = "error",
) -> DataFrame:
    """Lags by calendar day: the value exactly k days earlier, NULL if that day is absent.

    With ``on_dup="keep"`` a day's value is the largest of its rows: days are
    reduced to one row first, so that a group stays bounded by the calendar, and
    the lags are joined back. A row without a date has no lags.
    """
    if on_dup == "keep":
        daily = df.groupBy(group, date).agg(*[F.max(named(v)).alias(v) for v in variables])
        lagged = add_calendar_lags(daily, variables, n, group, date).drop(*variables)
        return left_join(df, lagged, (date, group))
    window = Window.partitionBy(group).orderBy(F.unix_date(date))
    lagged = df.select(
        "*",
        *[
            # A NULL date is its own peer in a range frame, at any distance.
            F.when(
                F.col(date).isNotNull(), F.max(named(v)).over(window.rangeBetween(-k, -k))
            ).alias(lag_name(v, k))
            for v in variables for k in range(1, n + 1)
        ],
        F.count(F.lit(1)).over(window.rangeBetween(0, 0)).alias("__same_day"),
    )
    return _fail_when(lagged, F.col("__same_day") > 1, f"duplicate ({group}, {date})").drop(
        "__same_day"
    )
