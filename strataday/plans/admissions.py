"""Admission counts: cleaning, annual summary, daily display series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import month_text, parse_dmy, recode, strict_sum, year_text
from ..operators import category_ordinal, rename_positions, select_positions, to_long
from ..schemas import COUNTY_FIPS, FACET_ORDER, OUTCOME_SOURCES, OUTCOMES


def clean_admissions(
    raw: DataFrame, county_map: Mapping[int, str] = COUNTY_FIPS,
    sources: Mapping[str, str] = OUTCOME_SOURCES, total_position: int = 4, keep: Sequence[str] = (),
) -> DataFrame:
    """Project, rename, decode the county and parse the date.

    The total has no fixed name in the file and is taken by position. Unknown
    county codes and unreadable dates become NULL. A date column that is typed
    already, as in a stored table, is kept as it is, and so are the columns of ``keep``.
    """
    total = select_positions(raw, total_position).columns[0]
    picked = raw.select("Admission_Date", "Patient_Resi_County_FIPS_Cd", total, *sources, *keep)
    named = rename_positions(picked, {1: "Date", 2: "County", 3: "Total_Cases"}).withColumnsRenamed(
        dict(sources)
    )
    typed = isinstance(raw.schema["Admission_Date"].dataType, T.DateType)
    return named.withColumns({
        "Date": F.col("Date") if typed else parse_dmy("Date"),
        "County": recode("County", county_map),
    })


def annual_summary(admissions: DataFrame, outcomes: Sequence[str] = FACET_ORDER) -> DataFrame:
    """Yearly totals per outcome; a year with a NULL count gets a NULL total."""
    return (
        admissions.withColumn("Year", year_text("Date"))
        .groupBy("Year")
        .agg(*[strict_sum(c).alias(c) for c in outcomes])
    )


def facet_series(
    admissions: DataFrame, outcomes: Sequence[str] = OUTCOMES,
    order: Sequence[str] = FACET_ORDER, ids: Sequence[str] = ("Date", "County"),
) -> DataFrame:
    """Long daily series with the display position of each outcome.

    One point per source row and outcome; nothing is aggregated.
    """
    long = to_long(admissions, ids, outcomes, "Primary_dx", "Count")
    return long.withColumn("facet_ord", category_ordinal("Primary_dx", order))


def yearly_scatter(panel: DataFrame, value: str = "smokepm25") -> DataFrame:
    """Daily exposure points with the year as facet."""
    return panel.select(
        year_text("Date").alias("Year"), month_text("Date").alias("Month"), "Date", "County",
        F.col(value),
    )
