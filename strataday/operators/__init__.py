"""DataFrame operators."""

from .groups import (
    distinct_sorted, informative_strata, keep_first, keep_groups, outcome_table, rank_dates,
)
from .joins import left_join, require_unique
from .lags import add_calendar_lags, add_lags, add_lags_blocked, add_lags_ranged, lag_columns
from .numbering import block_by_rank, dense_rank, ranges, running_base, with_position
from .order import arrange, category_ordinal
from .project import (
    is_numeric, map_columns, map_columns_if, rename_positions, select_positions, with_point,
)
from .reshape import (
    checked_count, dates_to_long, flags_wide, pieces_of, pivot_values, replicate, replicate_offsets,
    spread, to_long, uncount, union_by_name,
)

__all__ = [
    "add_calendar_lags", "add_lags", "add_lags_blocked", "add_lags_ranged", "arrange", "block_by_rank",
    "category_ordinal", "checked_count", "dates_to_long", "dense_rank",
    "distinct_sorted", "flags_wide",
    "informative_strata", "is_numeric", "keep_first", "keep_groups", "lag_columns",
    "left_join", "map_columns", "map_columns_if", "outcome_table", "pieces_of", "pivot_values",
    "ranges", "rank_dates", "replicate", "rename_positions", "replicate_offsets", "require_unique", "running_base",
    "select_positions", "spread", "to_long", "uncount", "union_by_name", "with_point", "with_position",
]
