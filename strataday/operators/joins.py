"""Left joins on NULL-matching keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import named


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail the query when a key occurs twice.

    Done as an aggregate so that copies of one key already collapse before
    the shuffle, however many there are.
    """
    others = [c for c in df.columns if c not in set(keys)]
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), *[F.any_value(named(c)).alias(c) for c in others]
    )
    duplicate = F.raise_error(F.lit(f"duplicate key in {list(keys)}")).cast("boolean")
    return (
        counted.where(F.when(F.col("__n") > 1, duplicate).otherwise(F.lit(True)))
        .select(*[named(c) for c in df.columns])
    )


def left_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], on_dup: str = "keep"
) -> DataFrame:
    """Left equi-join in which NULL keys match NULL keys.

    Catalyst keeps the null-safe comparison an equi-join, and adaptive execution
    picks broadcast or sort-merge from the measured size of the right side.
    ``on_dup="error"`` rejects a right side that would multiply rows.
    """
    if on_dup not in ("keep", "error"):
        raise ValueError("on_dup must be 'keep' or 'error'")
    if on_dup == "error":
        right = require_unique(right, keys)
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = None
    for k in keys:
        match = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        condition = match if condition is None else condition & match
    return left.join(renamed, condition, "left").drop(*[f"__r_{k}" for k in keys])
