"""Intermediate tables in the folder that the session shares with its executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder the session names in ``spark.checkpoint.dir``.

    A session without that setting gets a folder below its warehouse, which all
    executors share as well. :func:`drop_scratch` removes what was handed out.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").rstrip("/") + "/_scratch"
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    (_handed_out if _passing.get() is None else _passing.get()).append(path)
    return path


_handed_out: list[str] = []
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def _removed(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def passing_scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the folders that :func:`scratch_path` handed out within, to this thread.

    For an operator whose result depends on one last table, with a path from before.
    """
    own: list[str] = []
    token = _passing.set(own)
    try:
        yield
    finally:
        _passing.reset(token)
        for path in own:
            _removed(spark, path)


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def drop_scratch(spark: SparkSession) -> int:
    """Remove every folder that :func:`scratch_path` handed out in this process; how many there were.

    For the end of a run: frames read from these folders can't be used any more.
    """
    dropped = 0
    while _handed_out:
        dropped += _removed(spark, _handed_out.pop())
    return dropped


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame written below the scratch folder and read again, so that what follows
    neither works it out twice nor depends on executors that may go."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
