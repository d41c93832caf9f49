"""Long/wide reshaping, row expansion and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import epoch_day
from ..functions.values import named

#: Copies that one piece of a row stands for at most.
PIECE = 4_096


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Stack tables by column name; columns a table lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def to_long(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str
) -> DataFrame:
    """Wide to long for a handful of columns; NULL cells stay as rows."""
    return df.unpivot(list(ids), list(columns), name, value)


def dates_to_long(
    df: DataFrame, ids: Sequence[str], date: str = "Date", value: str = "HeatIndex",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Wide to long for thousands of columns headed by epoch days.

    One array per row is exploded with its position, so the plan holds one
    generator rather than one projection per column. A header that is not a
    number gives a NULL date; NULL cells stay as rows.
    """
    heads = list(columns) if columns is not None else [c for c in df.columns if c not in set(ids)]
    cells = F.posexplode(F.array(*[named(c).cast("double") for c in heads]))
    names = F.array(*[F.lit(h) for h in heads])
    long = df.select(*ids, cells.alias("__pos", value))
    return long.select(
        *ids, epoch_day(F.element_at(names, F.col("__pos") + 1)).alias(date), value
    )


def flags_wide(
    df: DataFrame, category: str, values: Sequence[str], flag: Column | None = None,
    fill: int | None = 0,
) -> DataFrame:
    """Long to wide when each row already is its own output row.

    No grouping is needed, so there is no shuffle: every value in the fixed
    list becomes a column holding ``flag`` on its own rows and ``fill`` elsewhere.
    """
    flag = F.lit(1) if flag is None else flag
    filler = F.lit(fill).cast("int")
    keep = [c for c in df.columns if c != category]
    return df.select(
        *keep, *[F.when(F.col(category) == v, flag).otherwise(filler).alias(v) for v in values]
    )


def pivot_values(
    df: DataFrame, ids: Sequence[str], category: str, values: Sequence[str], value: str
) -> DataFrame:
    """Long to wide with a fixed column list; a cell with several rows takes the smallest value."""
    return df.groupBy(*ids).pivot(category, list(values)).agg(F.min(value))


def checked_count(column: str) -> Column:
    """The count itself, or a query error for a NULL or negative count."""
    n = F.col(column)
    return F.when(
        n.isNull() | (n < 0),
        F.raise_error(F.lit(f"{column}: counts must be non-negative and not NULL")).cast("long"),
    ).otherwise(n.cast("long"))


def replicate(df: DataFrame, count: str, index: str) -> DataFrame:
    """As many copies of a row as its count says, in place: for counts known to be small."""
    copies = F.posexplode(F.array_repeat(F.lit(True), F.col(count).cast("int")))
    others = [named(c) for c in df.columns if c != count]
    return df.select(*others, copies.alias(index, "__copy")).drop("__copy")


def spread(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Hash rows over the whole cluster ahead of a step that multiplies them.

    The explicit partition count keeps adaptive execution, which only sees how small
    the rows are now, from packing them into a few tasks.
    """
    spark = df.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(wanted, spark.sparkContext.defaultParallelism), *columns)


def pieces_of(count: Column, size: int = PIECE) -> Column:
    """Numbers of the pieces of at most ``size`` that a count is cut into; none for 0."""
    last = F.floor((count - 1) / size).cast("long")
    return F.when(count > 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))


def uncount(df: DataFrame, count: str, index: str = "replicate", size: int = PIECE) -> DataFrame:
    """One output row per unit of ``count``; ``index`` is the 0-based replicate.

    Zero counts give no row, NULL counts fail the query. Every row is cut into pieces of at most ``size``
    copies, most into one, and the pieces are spread over the cluster before they are written out, so that
    one row of very many copies and very many rows of one take the same way and no task
    holds much more than its share.
    """
    checked = df.withColumn(count, checked_count(count))
    pieces = checked.withColumn("__piece", F.explode(pieces_of(F.col(count), size)))
    others = [named(c) for c in df.columns if c != count]
    spread_out = spread(pieces, F.xxhash64(*[named(c) for c in df.columns], "__piece"))
    first = F.col("__piece") * size
    held = F.least(F.lit(size).cast("long"), F.col(count) - first)
    return replicate(spread_out.select(*others, first.alias("__first"), held.alias("__held")), "__held", "__at").select(
        *others, (F.col("__first") + F.col("__at")).alias(index)
    )


def replicate_offsets(df: DataFrame, lo: int, hi: int, index: str = "index") -> DataFrame:
    """Every row once per integer in ``lo..hi``."""
    return df.withColumn(index, F.explode(F.sequence(F.lit(lo), F.lit(hi))))
