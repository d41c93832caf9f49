"""Column expressions. Everything here runs on built-in Spark functions."""

from .dates import (
    after, as_date, date_text_matches, day_label, epoch_day, in_months, in_study, iso_date,
    month_text, parse_dmy, parse_mdy, parse_ymd, quarter_text, shift_weeks, year_text,
)
from .text import join_text, paste, remove_text, slice_text
from .values import (
    count_values, has_both_flags, lag_name, named, recode, scale_to_domain, steps, strict_sum,
    zero_if_null,
)

__all__ = [
    "after", "as_date", "count_values", "date_text_matches", "day_label", "epoch_day",
    "has_both_flags", "in_months", "in_study", "iso_date", "join_text", "lag_name",
    "month_text", "named", "parse_dmy", "parse_mdy", "parse_ymd", "paste", "quarter_text",
    "recode", "remove_text", "scale_to_domain", "shift_weeks", "slice_text",
    "steps", "strict_sum", "year_text", "zero_if_null",
]
