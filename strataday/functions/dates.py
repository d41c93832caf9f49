"""Date parsing, labelling and calendar predicates (Column -> Column)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _by_shape(text: ColumnLike, layouts: dict[str, str]) -> Column:
    # the shape picks the layout, so that text of another shape costs no failed parse;
    # try_to_date then gives NULL for days that do not exist
    trimmed = F.trim(_col(text))
    return F.coalesce(*[
        F.when(trimmed.rlike(shape), F.try_to_date(trimmed, layout))
        for shape, layout in layouts.items()
    ])


def parse_dmy(text: ColumnLike) -> Column:
    """Day-month-year text such as ``01JAN2016``; NULL when it cannot be read."""
    return _by_shape(text, {
        r"^\d{1,2}[A-Za-z]{3}\d{4}$": "dMMMyyyy",
        r"^\d{1,2}-[A-Za-z]{3}-\d{4}$": "d-MMM-yyyy",
        r"^\d{1,2} [A-Za-z]{3} \d{4}$": "d MMM yyyy",
        r"^\d{1,2}/\d{1,2}/\d{4}$": "d/M/yyyy",
        r"^\d{1,2}-\d{1,2}-\d{4}$": "d-M-yyyy",
    })


def parse_ymd(text: ColumnLike) -> Column:
    """Year-month-day text; NULL when it cannot be read."""
    return _by_shape(text, {
        r"^\d{4}-\d{1,2}-\d{1,2}$": "yyyy-M-d",
        r"^\d{4}/\d{1,2}/\d{1,2}$": "yyyy/M/d",
        r"^\d{8}$": "yyyyMMdd",
    })


def parse_mdy(text: ColumnLike) -> Column:
    """Month-day-year text; NULL when it cannot be read."""
    return _by_shape(text, {
        r"^\d{1,2}/\d{1,2}/\d{4}$": "M/d/yyyy",
        r"^\d{1,2}-\d{1,2}-\d{4}$": "M-d-yyyy",
        r"^\d{8}$": "MMddyyyy",
    })


def iso_date(text: ColumnLike) -> Column:
    """ISO text to date, NULL when malformed."""
    return F.try_to_date(_col(text), "yyyy-MM-dd")


def epoch_day(number: ColumnLike) -> Column:
    """Days since 1970-01-01, given as a number or as text, to a date."""
    return F.date_from_unix_date(_col(number).try_cast("int"))


def year_text(date: ColumnLike) -> Column:
    return F.date_format(_col(date), "yyyy")


def month_text(date: ColumnLike) -> Column:
    """Zero-padded month."""
    return F.date_format(_col(date), "MM")


def day_label(date: ColumnLike) -> Column:
    """``04-06-2022`` style label."""
    return F.date_format(_col(date), "MM-dd-yyyy")


def quarter_text(date: ColumnLike) -> Column:
    return F.concat(F.lit("Q"), F.quarter(_col(date)).cast("string"))


def shift_weeks(date: ColumnLike, weeks: ColumnLike) -> Column:
    return F.date_add(_col(date), _col(weeks) * 7)


def in_months(date: ColumnLike, months: Iterable[int]) -> Column:
    """Season test. A NULL date is not in any season."""
    return F.month(_col(date)).isin([int(m) for m in months])


def date_text_matches(date: ColumnLike, pattern: str) -> Column:
    """Regular-expression test on the ISO text of a date."""
    return _col(date).cast("string").rlike(pattern)


def as_date(bound: dt.date | str) -> dt.date:
    return dt.date.fromisoformat(bound) if isinstance(bound, str) else bound


def after(date: ColumnLike, bound: dt.date | str) -> Column:
    """Strictly later than ``bound``."""
    return _col(date) > F.lit(as_date(bound))


def in_study(date: ColumnLike, months: Iterable[int], start: dt.date | str | None) -> Column:
    """In season and after the (exclusive) study start."""
    keep = in_months(date, months)
    return keep if start is None else keep & after(date, start)
