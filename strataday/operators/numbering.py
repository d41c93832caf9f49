"""Sequential numbers without sorting the table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written

_BEFORE = Window.unboundedPreceding, -1


def default_parts(df: DataFrame) -> int:
    """The session's shuffle partitions, or its cores if those are more."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def ranges(df: DataFrame, order: Sequence[str], parts: int | None = None, name: str = "__range") -> DataFrame:
    """The rows with the number of the range of the order that they fall into, NULLs last.

    Ranges hold about equally many rows whatever the values are. They come from a sample, so the rows are
    written with their number, which then is the same for all that reads them. Rows equal in
    the whole order share a range.
    """
    keys = [F.asc_nulls_last(c) for c in order]
    cut = df.repartitionByRange(parts or default_parts(df), *keys)
    return written(cut.withColumn(name, F.spark_partition_id()), "ranges")


def block_by_rank(df: DataFrame, column: str, blocks: int | None = None) -> Column:
    """Block of a whole number such that blocks hold about equally many rows, however the numbers are spaced.

    The cuts are approximate quantiles, from one aggregate that runs now.
    """
    blocks = min(blocks or default_parts(df), 256)
    shares = [k / blocks for k in range(1, blocks)]
    cuts = df.agg(F.percentile_approx(column, shares, 100 * blocks)).first()[0] if shares else None
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(column)))


def dense_rank(df: DataFrame, column: str, rank: str = "rank", parts: int | None = None) -> DataFrame:
    """(column, rank): the ordinal, from 1, of every distinct value other than NULL, of any ordered type.

    The distinct values are cut into ranges; a range is numbered on its own, and the values of the ranges before
    it are added. Dates, of which there are as many as days, are numbered by one window instead.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    if isinstance(df.schema[column].dataType, T.DateType):
        return values.withColumn(rank, F.row_number().over(Window.orderBy(column)))
    cut = ranges(values, [column], parts)
    sizes = cut.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    # one row a range
    before = sizes.select(
        F.col("__range").alias("__r"), F.coalesce(F.sum("__size").over(Window.orderBy("__range").rowsBetween(*_BEFORE)), F.lit(0)).alias("__before"),
    )
    own = cut.withColumn("__own", F.row_number().over(Window.partitionBy("__range").orderBy(column)))
    return own.join(before, F.col("__range") == F.col("__r")).select(column, (F.col("__before") + F.col("__own")).alias(rank))


def with_position(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a file scan with their 0-based place in the files, these in the order of their paths.

    A split of a file is read in order by one task, which numbers its rows; rows per split are counted by a
    second pass over the files that reads no column, and the rows of the splits before are added.
    ``rows`` has to be the scan itself.
    """
    own = rows.columns
    placed = rows.select(
        "*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__no"),
    )
    splits = placed.groupBy(F.col("__path").alias("__p"), F.col("__start").alias("__s")).agg(
        F.min("__no").alias("__first"), F.count(F.lit(1)).alias("__rows")
    )
    # one row a split of a file
    order = Window.orderBy("__p", "__s").rowsBetween(*_BEFORE)
    bases = splits.select("__p", "__s", "__first", F.coalesce(F.sum("__rows").over(order), F.lit(0)).alias("__base"))
    joined = placed.join(bases, (F.col("__path") == F.col("__p")) & (F.col("__start") == F.col("__s")))
    return joined.select(*[F.col(f"`{c}`") for c in own], (F.col("__base") + F.col("__no") - F.col("__first")).alias(name))


def running_base(
    cells: DataFrame, count: str, block: str, order: Sequence[str], base: str = "id_base",
    source: DataFrame | None = None, check: bool = False,
) -> DataFrame:
    """Exclusive running sum of ``count`` in the order (block, *order), NULLs last.

    Two levels: totals per block are summed up over the blocks, and inside a
    block a window runs over its cells. (block, *order) must be unique; ``check`` fails the query if it isn't. With a date as
    block there is one total per calendar date, so the single-partition window
    over the totals and their broadcast are bounded by the calendar. Any other
    block is joined as its measured size suggests.

    ``source`` are rows of any grain that add up to ``cells``; the totals are then taken
    straight from them, with one row per task and block to shuffle. A filter on
    the block put on the result moves below the inner window on its own, while
    the totals still cover every block.
    """
    by_block = Window.orderBy(F.asc_nulls_last("__block")).rowsBetween(*_BEFORE)
    totals = (
        (cells if source is None else source)
        .groupBy(F.col(block).alias("__block"))
        .agg(F.sum(count).alias("__total"))
        .select("__block", F.coalesce(F.sum("__total").over(by_block), F.lit(0)).alias("__before"))
    )
    if isinstance(cells.schema[block].dataType, T.DateType):
        totals = F.broadcast(totals)
    ordered = Window.partitionBy(block).orderBy(*[F.asc_nulls_last(c) for c in order])
    local = cells.withColumn("__local", F.coalesce(F.sum(count).over(ordered.rowsBetween(*_BEFORE)), F.lit(0)))
    if check:
        key = F.struct(*order)
        repeated = (F.row_number().over(ordered) > 1) & F.lag(key).over(ordered).eqNullSafe(key)
        error = F.raise_error(F.lit(f"{list(order)} must be unique")).cast("boolean")
        local = local.withColumn("__repeated", repeated).where(F.when(F.col("__repeated"), error).otherwise(F.lit(True))).drop("__repeated")
    return (
        local.join(totals, F.col(block).eqNullSafe(F.col("__block")), "left")
        .withColumn(base, F.col("__before") + F.col("__local"))
        .drop("__block", "__before", "__local")
    )
