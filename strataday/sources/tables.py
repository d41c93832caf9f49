"""Delimited-text and Parquet sources and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import with_position
from ..operators.order import arrange
from ..schemas import ADMISSION_TYPES, SMOKE_PM_TYPES

NA = "NA"


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file, from its first line."""
    return spark.read.option("header", True).csv(path).columns


def read_csv(
    spark: SparkSession, path: str, types: Mapping[str, T.DataType] | None = None,
    default: T.DataType | None = None, position: str | None = None,
) -> DataFrame:
    """CSV with a header line and ``NA`` for NULL.

    ``position`` names a column to add: the row's 0-based place in the file, or in the files of a
    folder in the order of their paths.

    The column list comes from the header, the types from ``types`` and
    ``default`` (text if not given). Nothing is inferred from the data, so the
    file is scanned once and only for the columns a query uses.
    """
    types = dict(types or {})
    default = default or T.StringType()
    schema = T.StructType(
        [T.StructField(c, types.get(c, default)) for c in csv_header(spark, path)]
    )
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("nullValue", NA)
        .csv(path)
    )
    return with_position(rows, position) if position else rows


def read_admissions(
    spark: SparkSession, path: str, total_position: int = 4, position: str | None = None
) -> DataFrame:
    """Admission counts. The total is known by its position only, so it is typed by it."""
    total = csv_header(spark, path)[total_position - 1]
    return read_csv(spark, path, {**ADMISSION_TYPES, total: T.IntegerType()}, position=position)


def read_smoke(spark: SparkSession, path: str) -> DataFrame:
    """Daily smoke panel."""
    return read_csv(spark, path, SMOKE_PM_TYPES)


def read_heat_wide(spark: SparkSession, path: str, county: str = "county") -> DataFrame:
    """Wide heat-index file: a county code and one column per day."""
    return read_csv(spark, path, {county: T.IntegerType()}, default=T.DoubleType())


def write_csv(df: DataFrame, path: str, sort: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """CSV with a header line, NULL written as ``NA``."""
    out = arrange(df, *sort) if sort else df
    out.write.mode(mode).option("header", True).option("nullValue", NA).option(
        "emptyValue", ""
    ).csv(path)


def write_partitioned(
    df: DataFrame, path: str, by: str, run: str | None = None, compact: bool = True,
    mode: str = "errorifexists",
) -> str:
    """Parquet, one directory per value of ``by``, below a run label if given.

    ``compact`` asks adaptive execution to rebalance on ``by`` first: small
    values end up in few files and a value holding much of the data is split
    over several tasks.
    """
    target = f"{path}/run={run}" if run else path
    out = df.hint("rebalance", F.col(by)) if compact else df
    out.write.mode(mode).partitionBy(by).parquet(target)
    return target


def replace_days(df: DataFrame, path: str, by: str = "Date", compact: bool = True) -> str:
    """Snapshot of the days that occur in ``df``: their directories are replaced, all others stay as they are.

    The new files are written beside the old ones and moved into place when the job commits,
    so a run that dies leaves the snapshot unchanged and a rerun gives the same one. Days that ``df``
    doesn't hold are never touched; a day that lost all its rows has to be removed by its directory.
    """
    out = df.hint("rebalance", F.col(by)) if compact else df
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return path


def read_outcome_tables(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_outcome_tables` wrote; a filter on ``out_name`` opens its directory only."""
    return spark.read.parquet(path)


def write_outcome_tables(strata: DataFrame, path: str, run: str, **kw) -> str:
    """All per-diagnosis tables as one dataset, one directory per diagnosis."""
    return write_partitioned(strata, path, "out_name", run=run, **kw)


def read_monitor_daily(
    df: DataFrame, parameter: str, begin, end, states: Sequence[int]
) -> DataFrame:
    """Rows of an exported daily air-quality table for a parameter, date range and states.

    Plain comparisons on stored columns, so all three reach the scan, whether the
    day is stored as a date or as ISO text.
    """
    day = F.col("date_local")
    return df.where(
        (F.col("parameter_code") == parameter)
        & F.col("state_code").isin([int(s) for s in states])
        & (day >= F.lit(str(begin)))
        & (day <= F.lit(str(end)))
    )
