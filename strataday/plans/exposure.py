"""Exposure panels with lags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse_mdy, parse_ymd, recode
from ..operators import (
    add_calendar_lags, add_lags, add_lags_blocked, add_lags_ranged, dates_to_long, left_join,
)
from ..schemas import COUNTY_ALIASES, COUNTY_STATE_FIPS, LAG_DAYS

PANEL_KEYS = ("Date", "County")


def clean_smoke(
    raw: DataFrame, layout: str = "ymd", aliases: Mapping[str, str] = COUNTY_ALIASES,
    variables: Sequence[str] = ("smokepm25", "totalpm25"),
) -> DataFrame:
    """Daily smoke panel: dates parsed, county spellings folded onto one form."""
    parse = {"ymd": parse_ymd, "mdy": parse_mdy}[layout]
    return raw.select(
        parse("Date").alias("Date"), recode("County", aliases, "keep").alias("County"), *variables
    )


def clean_heat(
    wide: DataFrame, county_map: Mapping[int, str] = COUNTY_STATE_FIPS, county: str = "county",
    drop: Sequence[str] = (), value: str = "HeatIndex",
) -> DataFrame:
    """Wide heat-index file to (County, Date, value)."""
    named = wide.drop(*drop).withColumn(county, recode(F.col(county).cast("int"), county_map))
    return dates_to_long(named.withColumnRenamed(county, "County"), ["County"], value=value)


def exposure_panel(
    smoke: DataFrame, heat: DataFrame | None = None,
    variables: Sequence[str] | None = None, lags: int = LAG_DAYS, mode: str = "row",
    on_dup: str = "error", ties: Sequence[str] = (), block: Column | None = None,
) -> DataFrame:
    """(Date, County) panel with lags 1..n of every variable.

    Lags are taken over the whole panel, before any season filter. ``mode="row"`` counts
    rows back, ``mode="calendar"`` counts days. With ``on_dup="keep"`` repeated
    days stay; ``ties`` then fixes their order and the lags run in ranges of about equal size,
    or in the blocks of ``block`` if given.
    """
    joined = smoke if heat is None else left_join(smoke, heat, PANEL_KEYS, on_dup=on_dup)
    if variables is None:
        variables = [c for c in joined.columns if c not in (*PANEL_KEYS, *ties)]
    if mode == "calendar":
        return add_calendar_lags(joined, variables, lags, on_dup=on_dup)
    if mode != "row":
        raise ValueError("mode must be 'row' or 'calendar'")
    if on_dup == "error":
        return add_lags(joined, variables, lags)
    if block is None:
        return add_lags_ranged(joined, variables, lags, "County", ["Date", *ties])
    return add_lags_blocked(joined, variables, lags, "County", ["Date", *ties], block)
