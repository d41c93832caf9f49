"""Sources and sinks."""

from ..scratch import drop_scratch, passing_scratch, path_exists, scratch_path, written
from .ledger import PolygonLedger
from .polygons import (
    collect_polygons, collection_report, daily_path, file_date, file_verdicts, list_files,
    names_match, polygon_line, read_boundary, scan_lines,
)
from .tables import (
    csv_header, read_admissions, read_csv, read_heat_wide, read_monitor_daily, read_outcome_tables, read_smoke,
    replace_days, write_csv, write_outcome_tables, write_partitioned,
)

__all__ = [
    "PolygonLedger", "collect_polygons", "collection_report", "csv_header", "daily_path", "drop_scratch",
    "file_date", "file_verdicts", "list_files", "names_match", "passing_scratch", "path_exists", "polygon_line",
    "read_admissions", "read_boundary", "read_csv", "read_heat_wide", "read_monitor_daily", "read_outcome_tables", "read_smoke", "replace_days",
    "scan_lines", "scratch_path", "write_csv", "write_outcome_tables", "write_partitioned", "written",
]
