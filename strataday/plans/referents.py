"""Case-crossover referent dates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_date, in_study, month_text, shift_weeks, year_text, zero_if_null
from ..operators import map_columns, replicate_offsets, union_by_name
from ..schemas import FIRE_APR_SEP, OUTCOMES, REFERENT_WEEKS, STUDY_START


def study_cases(
    df: DataFrame, months: Iterable[int] = FIRE_APR_SEP, start: dt.date | None = STUDY_START,
    date: str = "Date",
) -> DataFrame:
    """Rows in season and after the (exclusive) study start."""
    return df.where(in_study(date, months, start))


def add_referents(
    cases: DataFrame, weeks: int = REFERENT_WEEKS, months: Iterable[int] = FIRE_APR_SEP,
    start: dt.date | None = STUDY_START, date: str = "Date", recompute_calendar: bool = False,
    include_case: bool = False,
) -> DataFrame:
    """Same weekday, up to ``weeks`` before and after, in season, after the start.

    Map-side only: the offsets are generated, shifted and filtered in one
    generated-code stage, and the unfiltered expansion never exists as a table.
    ``Year`` and ``Month`` stay those of the case unless ``recompute_calendar``.
    """
    months = tuple(months)
    shifted = replicate_offsets(cases, -weeks, weeks, "index").withColumn(
        date, shift_weeks(date, "index")
    )
    kept = shifted.where(in_study(date, months, start))
    if recompute_calendar:
        kept = kept.withColumns({"Year": year_text(date), "Month": month_text(date)})
    return kept if include_case else kept.where(F.col("index") != 0).drop("index")


def has_referent(
    date: str, weeks: int, months: Iterable[int], start: dt.date | None
) -> Column:
    """Whether a date has any referent at all, without expanding it.

    A day of a month in season always has the same weekday a week earlier or later in
    that month, so beyond the first week of the study the answer is yes.
    The offsets are only tried, nearest first, for the other dates.
    """
    months = tuple(months)
    if weeks < 1:
        return F.lit(False)
    offsets = F.array(*[F.lit(k) for n in range(1, weeks + 1) for k in (-n, n)])
    tried = F.exists(offsets, lambda k: in_study(F.date_add(F.col(date), k * 7), months, start))
    settled = None if start is None else as_date(start) + dt.timedelta(days=7)
    return in_study(date, months, settled) | tried


def cross_cases(cases: DataFrame, flags: Sequence[str] = OUTCOMES, **options) -> DataFrame:
    """Cases and referents from one pass over the cases, flags 0 on referent dates.

    Same rows as :func:`case_crossover` of the cases and their referents, which
    reads the cases twice.
    """
    crossed = add_referents(cases, include_case=True, **options)
    own = {c: F.when(F.col("index") == 0, zero_if_null(c)).otherwise(0) for c in flags}
    return crossed.withColumns(own).drop("index")


def case_crossover(
    cases: DataFrame, referents: DataFrame, flags: Sequence[str] = OUTCOMES
) -> DataFrame:
    """Cases and referents in one table, missing flags set to 0."""
    return map_columns(union_by_name(cases, referents), flags, zero_if_null)
