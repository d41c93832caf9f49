"""Daily map layers: monitors, smoke polygons and boundary per frame."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import day_label, iso_date, join_text, scale_to_domain
from ..operators import rank_dates, union_by_name, with_point
from ..schemas import (
    FRAME_FIRST_DAY, FRAME_FIRST_NUMBER, FRAME_LAST_DAY, PALETTE_DOMAIN, PM25_STANDARD,
)
from ..sources.polygons import geometry_json


def standardise_monitors(
    daily: DataFrame, standard: str = PM25_STANDARD, pollutant: str = "PM2.5"
) -> DataFrame:
    """Daily monitor means as points, one standard only."""
    kept = daily.where(F.col("pollutant_standard") == standard)
    return with_point(kept, "longitude", "latitude").select(
        "geometry", "srid", "state_code", "county_code", "site_number",
        iso_date(F.col("date_local").cast("string")).alias("Date"),
        F.lit(pollutant).alias("Pollutant"),
        F.col("arithmetic_mean").alias("Concentration"),
    )


def date_spine(spark: SparkSession, first: dt.date, last: dt.date, date: str = "Date") -> DataFrame:
    """One row per day from ``first`` to ``last``."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias(date))


def frame_manifest(
    spark: SparkSession, first: dt.date = FRAME_FIRST_DAY, last: dt.date = FRAME_LAST_DAY,
    first_number: int = FRAME_FIRST_NUMBER,
) -> DataFrame:
    """Frame number, date, label and file name. Order frames by number, not by file name."""
    days = spark.range(1).select(
        F.posexplode(F.sequence(F.lit(first), F.lit(last))).alias("__pos", "Date")
    )
    return days.select(
        (F.col("__pos") + first_number).alias("frame_no"),
        "Date",
        day_label("Date").alias("label"),
        join_text(F.col("__pos") + first_number, F.lit("_map.png")).alias("file_name"),
    )


def attach_layer(manifest: DataFrame, layer: DataFrame, by: str = "date") -> DataFrame:
    """Frames joined to the rows of a dated layer, whose date becomes ``layer_date``.

    ``by="date"`` matches the calendar. ``by="rank"`` matches frame *k* with the
    *k*-th distinct date of the layer, which slips when a day is missing. A manifest has one frame
    a day, so that frames and their dates are bounded by the calendar and sent out; the layer stays where it is.
    """
    if by not in ("date", "rank"):
        raise ValueError("by must be 'date' or 'rank'")
    frames = manifest.select("frame_no", "label", "Date")
    rows = layer.withColumnRenamed("Date", "layer_date")
    if by == "date":
        dated = frames.withColumnRenamed("Date", "layer_date")
    else:
        ranked = rank_dates(layer, "Date", "frame_no").withColumnRenamed("Date", "layer_date")
        dated = ranked.join(F.broadcast(frames.drop("Date")), "frame_no")
    features = [c for c in rows.columns if c != "layer_date"]
    return rows.join(F.broadcast(dated), "layer_date").select("frame_no", "label", "layer_date", *features)


def _geometry_as_text(df: DataFrame) -> DataFrame:
    if isinstance(df.schema["geometry"].dataType, T.StringType):
        return df
    fields = df.schema["geometry"].dataType.fieldNames()
    return df.withColumn("geometry", geometry_json("geometry") if "coordinates" in fields else F.to_json("geometry"))


def frame_layers(
    manifest: DataFrame, smoke: DataFrame, monitors: DataFrame, boundary: DataFrame | None = None,
    by: str = "date",
) -> DataFrame:
    """Long layer table: one row per frame and feature.

    Layers are stacked rather than joined to each other, so a frame with s
    polygons and m monitors has s + m rows. ``smoke`` and ``monitors`` bring ``Date`` and
    ``geometry``, monitors also ``Concentration``; further columns stay, NULL in
    the other layers. Geometries become text, as polygons and points have different
    types. ``boundary`` has the few features of one place, added to every frame.
    """
    parts = [
        attach_layer(manifest, _geometry_as_text(rows), by).withColumn("layer", F.lit(name))
        for name, rows in (("smoke", smoke), ("monitor", monitors))
    ]
    if boundary is not None:
        shape = _geometry_as_text(boundary)
        # a scalar subquery over the features, so there is no join
        all_ = shape.select(F.collect_list(F.struct(*shape.columns)).alias("shapes")).scalar()
        parts.append(
            manifest.select("frame_no", "label", F.lit("boundary").alias("layer"), F.explode(all_).alias("__b"))
            .select("frame_no", "label", "layer", "__b.*")
        )
    lo, hi = PALETTE_DOMAIN
    return union_by_name(*parts).withColumn(
        "shade", scale_to_domain("Concentration", lo, hi, reverse=True)
    )


def daily_counts(layer: DataFrame, date: str = "Date") -> DataFrame:
    """Rows per day, the sizes of the per-day split."""
    return layer.groupBy(date).agg(F.count(F.lit(1)).alias("n_rows"))
