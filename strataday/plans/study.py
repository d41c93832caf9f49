"""The studies from files to files."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions import parse_mdy, parse_ymd, quarter_text
from ..operators import add_lags
from ..schemas import (
    FIRE_APR_AUG, FIRE_APR_SEP, FRAME_FIRST_DAY, FRAME_FIRST_NUMBER, FRAME_LAST_DAY, LAG_DAYS, MULTI_FLAG_LABELS,
    MULTI_FLAGS, PM25_PARAMETER, REFERENT_WEEKS, STATE_FIPS, STUDY_START,
)
from ..sources import (
    collect_polygons, csv_header, read_admissions, read_boundary, read_csv, read_heat_wide, read_monitor_daily,
    read_smoke, write_csv, write_outcome_tables, write_partitioned,
)
from .admissions import annual_summary, clean_admissions
from .casecross import (
    attach_exposure, case_crossover_from_cases, case_crossover_tables, full_dataset, outcome_tables,
)
from .exposure import clean_heat, clean_smoke, exposure_panel
from .frames import frame_layers, frame_manifest, standardise_monitors
from .referents import cross_cases, study_cases


def run_case_crossover(
    spark: SparkSession, admissions_path: str, smoke_path: str, out: str, run: str,
    heat_path: str | None = None, smoke_layout: str = "ymd",
    months: Iterable[int] = FIRE_APR_SEP, start: dt.date | None = STUDY_START,
    weeks: int = REFERENT_WEEKS, lags: int = LAG_DAYS, mode: str = "row", file_order: bool = False,
    sort: Sequence[str] = (), all_flags: bool = False,
) -> dict[str, str]:
    """Admissions and exposures to the full dataset, the analysis tables and the yearly totals.

    With ``file_order`` episodes are numbered by the place of their row in the admissions file instead of by date and
    county. ``sort`` orders the rows of the full dataset, ``all_flags`` keeps all flags in the analysis tables.

    Cleaned admissions and the lagged panel are written first and read back as typed
    tables: the later steps each read them, and a lost executor then costs no
    more than its own tasks.
    """
    base = f"{out}/run={run}"
    heat = None
    if heat_path:
        wide = read_heat_wide(spark, heat_path)
        # whatever comes before the county column is a row index
        heat = clean_heat(wide, drop=wide.columns[: wide.columns.index("county")])
    smoke = clean_smoke(read_smoke(spark, smoke_path), smoke_layout)
    paths = {
        "admissions": f"{base}/admissions", "panel": f"{base}/panel",
        "annual_summary": f"{base}/annual_summary", "full_dataset": f"{base}/full_dataset",
    }
    place = "Position" if file_order else None
    raw = read_admissions(spark, admissions_path, position=place)
    clean_admissions(raw, keep=[place] if place else ()).write.parquet(paths["admissions"])
    exposure_panel(smoke, heat, lags=lags, mode=mode).write.parquet(paths["panel"])
    admissions = spark.read.parquet(paths["admissions"])
    # a small panel is sent out by its measured bytes, under adaptive execution
    panel = spark.read.parquet(paths["panel"])
    options = {"months": tuple(months), "start": start, "weeks": weeks, "file_order": place}
    write_csv(annual_summary(admissions), paths["annual_summary"], sort=["Year"])
    write_csv(full_dataset(admissions, panel, **options), paths["full_dataset"], sort=sort)
    tables = outcome_tables if all_flags else case_crossover_tables
    paths["tables"] = write_outcome_tables(tables(admissions, panel, **options), f"{out}/tables", run)
    return paths


def run_flagged_study(
    spark: SparkSession, cases_path: str, panel_path: str, out: str, run: str,
    flags: Sequence[str] = tuple(MULTI_FLAGS), labels: Mapping[str, str] = MULTI_FLAG_LABELS,
    id_col: str = "hfdrepisode", county: str = "county", months: Iterable[int] = FIRE_APR_AUG,
    start: dt.date | None = STUDY_START, weeks: int = REFERENT_WEEKS, layout: str = "ymd",
    variables: Sequence[str] | None = None, lags: int = 0,
) -> dict[str, str]:
    """Episodes with several flags and a county-day panel, both CSV, to the full dataset and the analysis tables.

    The panel is joined by county, date and quarter of the year. Its ``variables``, by default all its columns but the date and
    the county, are numbers and get ``lags`` row lags. NULL flags count as 0.
    """
    types = {c: T.IntegerType() for c in flags}
    parse = {"ymd": parse_ymd, "mdy": parse_mdy}[layout]
    cases = read_csv(spark, cases_path, types).withColumn("Date", parse("Date"))
    heads = csv_header(spark, panel_path)
    variables = [c for c in heads if c not in ("Date", county)] if variables is None else list(variables)
    panel = read_csv(spark, panel_path, {c: T.DoubleType() for c in variables}).select(
        parse("Date").alias("Date"), county, *variables
    )
    if lags:
        panel = add_lags(panel, variables, lags, county)
    paths = {k: f"{out}/run={run}/{k}" for k in ("cases", "panel", "full_dataset")}
    cases.write.parquet(paths["cases"])
    panel.withColumn("quarter", quarter_text("Date")).write.parquet(paths["panel"])
    cases, panel = spark.read.parquet(paths["cases"]), spark.read.parquet(paths["panel"])
    keys = (county, "Date", "quarter")
    options = {"months": tuple(months), "start": start}
    rows = cross_cases(study_cases(cases, **options), flags, weeks=weeks, **options)
    full = attach_exposure(rows.withColumn("quarter", quarter_text("Date")), panel, keys, on_dup="error")
    write_csv(full, paths["full_dataset"], sort=(county, "Date"))
    tables = case_crossover_from_cases(
        cases, panel, flags, labels, id_col, keys, {"quarter": quarter_text("Date")}, weeks, **options
    )
    paths["tables"] = write_outcome_tables(tables, f"{out}/tables", run)
    return paths


def run_frames(
    spark: SparkSession, polygon_root: str, monitor_daily: DataFrame, boundary_path: str, out: str,
    first: dt.date = FRAME_FIRST_DAY, last: dt.date = FRAME_LAST_DAY,
    first_number: int = FRAME_FIRST_NUMBER, collect_first: dt.date | None = None,
    collect_last: dt.date | None = None, by: str = "date", parameter: str = PM25_PARAMETER,
    states: Iterable[int] = (STATE_FIPS,),
) -> dict[str, str]:
    """Polygon files and monitor readings to the map layers of every frame.

    Layers are collected from ``collect_first`` to ``collect_last``, by default the whole calendar
    years of the frames, since matching by rank counts the days before the first frame.
    """
    begin = collect_first or first.replace(month=1, day=1)
    end = collect_last or last.replace(month=12, day=31)
    paths = {"polygons": f"{out}/polygons", "frames": f"{out}/frames"}
    write_partitioned(collect_polygons(spark, polygon_root, begin, end), paths["polygons"], "Date")
    polygons = spark.read.parquet(paths["polygons"])
    monitors = standardise_monitors(
        read_monitor_daily(monitor_daily, parameter, begin, end, tuple(states))
    )
    layers = frame_layers(
        frame_manifest(spark, first, last, first_number), polygons, monitors,
        read_boundary(spark, boundary_path), by,
    )
    write_partitioned(layers, paths["frames"], "frame_no")
    return paths
