"""NULL handling, recoding and scaling expressions."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def named(column: str) -> Column:
    """The column of exactly this name, which may hold dots."""
    return F.col(f"`{column}`")


def zero_if_null(c: ColumnLike) -> Column:
    return F.coalesce(_col(c), F.lit(0))


def strict_sum(c: ColumnLike) -> Column:
    """Sum that is NULL as soon as one input is NULL."""
    value = _col(c)
    return F.when(F.count(F.when(value.isNull(), 1)) == 0, F.sum(value))


def count_values(c: ColumnLike) -> Column:
    """Number of distinct values in the group, NULL counted as one value."""
    value = _col(c)
    return F.count_distinct(value) + F.max(value.isNull().cast("int"))


def has_both_flags(c: ColumnLike) -> Column:
    """Aggregate: a 0/1/NULL flag takes exactly two values in the group.

    Same answer as ``count_values(c) == 2`` for such a flag, from three
    fixed-size partial aggregates instead of a distinct expansion.
    """
    value = _col(c)
    lo, hi = F.min(value), F.max(value)
    kinds = (
        lo.isNotNull().cast("int")
        + F.coalesce((lo != hi).cast("int"), F.lit(0))
        + F.max(value.isNull().cast("int"))
    )
    return kinds == 2


def recode(c: ColumnLike, mapping: Mapping, default: str = "null") -> Column:
    """Dictionary recode held in the plan, for maps of a few hundred entries.

    ``default="null"`` turns unmatched keys into NULL (numeric code to text),
    ``default="keep"`` leaves them as they are (text to text).
    """
    if default not in ("null", "keep"):
        raise ValueError("default must be 'null' or 'keep'")
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    found = F.try_element_at(lookup, _col(c))
    return found if default == "null" else F.coalesce(found, _col(c))


def scale_to_domain(c: ColumnLike, lo: float, hi: float, reverse: bool = False) -> Column:
    """Position of a value inside [lo, hi] as 0..1; NULL outside the domain."""
    value = _col(c).cast("double")
    position = (value - F.lit(float(lo))) / F.lit(float(hi) - float(lo))
    if reverse:
        position = F.lit(1.0) - position
    return F.when(value.between(float(lo), float(hi)), position)


def steps(lo: float, hi: float, by: float) -> Column:
    """Array ``lo, lo + by, ...`` up to ``hi``."""
    count = F.sequence(F.lit(0), F.lit(int((hi - lo) // by)))
    return F.transform(count, lambda k: F.lit(float(lo)) + k * F.lit(float(by)))


def lag_name(variable: str, k: int) -> str:
    return f"{variable}_lag{k}"
