"""Sources and sinks, written to and read back from the shared scratch folder."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataday.functions import recode
from strataday.plans import build_episodes, date_spine
from strataday.schemas import COUNTY_FIPS, SMOKE_PM_TYPES
from strataday.sources import (
    PolygonLedger, collect_polygons, collection_report, polygon_line, read_boundary, read_csv, replace_days,
    scratch_path, write_csv, write_outcome_tables, write_partitioned,
)

from . import reshaping  # noqa: F401
from .crossover import q_informative_strata
from .registry import ORACLES, query
from .views import admission_rows, ctes, heat_wide, month_heads, smoke_raw, table


@query("csv_roundtrip", sql=ctes("fips", "pm") + """
    SELECT strftime("Date", '%Y-%m-%d') AS "Date", replace("County", 'ñ', 'n') AS "County",
           smokepm25, totalpm25 FROM pm""")
def q_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "smoke-csv")
    write_csv(smoke_raw(spark, sf), path)
    return read_csv(spark, path, SMOKE_PM_TYPES)


@query("csv_sorted_roundtrip", sql=ctes("fips") + """
    SELECT s_suppkey, name AS "County", s_acctbal FROM supplier LEFT JOIN fips ON code = s_nationkey""")
def q_csv_sorted_roundtrip(spark, sf):
    rows = table(spark, sf, "supplier").select(
        "s_suppkey", recode("s_nationkey", COUNTY_FIPS).alias("County"), "s_acctbal"
    )
    path = scratch_path(spark, "supplier-csv")
    write_csv(rows, path, sort=("County", "s_suppkey"))
    return read_csv(spark, path, {"s_suppkey": T.LongType(), "s_acctbal": T.DoubleType()})


@query("file_positions", sql="""
    SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS place, o_orderkey, o_orderpriority FROM orders""")
def q_file_positions(spark, sf):
    """The place of each row in the files it was written to in order."""
    path = scratch_path(spark, "orders-csv")
    write_csv(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), path, sort=("o_orderkey",))
    return read_csv(spark, path, {"o_orderkey": T.LongType()}, position="place")


@query("episode_ids_from_file", sql=ORACLES["episode_ids_file_order"])
def q_episode_ids_from_file(spark, sf):
    """Episodes numbered by the place of their row in the file."""
    path = scratch_path(spark, "admission-rows-csv")
    rows = admission_rows(spark, sf)
    write_csv(rows, path, sort=("o_orderkey",))
    types = {"Date": T.DateType(), "County": T.StringType(), "o_orderkey": T.LongType()}
    back = read_csv(spark, path, types, T.IntegerType(), position="place")
    return build_episodes(back, file_order="place")


@query("wide_csv_roundtrip", sql=f"""
    WITH v AS (SELECT s_nationkey + 35000 AS county,
                      CAST(date_trunc('month', l_shipdate) AS DATE) - DATE '1970-01-01' AS h,
                      CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / 100 AS v
               FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
    SELECT county, {", ".join(f'max(v) FILTER (WHERE h = {h}) AS "{h}"' for h in month_heads())},
           CAST(1.0 AS DOUBLE) AS note
    FROM v GROUP BY county""")
def q_wide_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "heat-csv")
    write_csv(heat_wide(spark, sf), path)
    return read_csv(spark, path, {"county": T.IntegerType()}, default=T.DoubleType())


@query("partitioned_sink", sql="""
    SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS "Date" FROM events""")
def q_partitioned_sink(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "value", F.col("ts").cast("date").alias("Date")
    )
    path = write_partitioned(rows, scratch_path(spark, "daily"), "Date")
    return spark.read.parquet(path)


@query("outcome_sink", sql=ORACLES["informative_strata"])
def q_outcome_sink(spark, sf):
    path = scratch_path(spark, "outcomes")
    return spark.read.parquet(write_outcome_tables(q_informative_strata(spark, sf), path, "apr-sep"))


_DRIFT_DAY, _BROKEN_DAY = 13, 21


def _polygon_rows(spark, sf, several: bool = False, density=None):
    """One line of text per event, with the file of its day.

    The 13th lacks a column and the 21st holds an unreadable line, as a collection meets them. With ``several``
    clicks have two polygons.
    """
    day = F.col("ts").cast("date")
    ring = F.array(
        F.array(F.col("value"), F.col("user_id").cast("double")),
        F.array(F.col("value") + 1, F.col("user_id").cast("double")),
        F.array(F.col("value"), F.col("user_id").cast("double") + 1),
        F.array(F.col("value"), F.col("user_id").cast("double")),
    )
    geometry = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    if several:
        both = F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring), F.array(ring, ring)).alias("coordinates"))
        geometry = F.when(F.col("event_type") == "click", F.to_json(both)).otherwise(geometry)
    geometry = F.from_json(geometry, "type string, coordinates string")
    if density is None:
        density = F.when(F.col("value") < 20, "Light").when(F.col("value") < 60, "Medium").otherwise("Heavy")
    start = F.date_format("ts", "HHmm")
    raw = F.struct(geometry["type"].alias("type"), F.parse_json(geometry["coordinates"]).alias("coordinates"))
    whole = polygon_line(F.col("event_type"), start, start, density, raw)
    drifted = F.to_json(F.struct(F.col("event_type").alias("Satellite"), raw.alias("geometry")))
    return table(spark, sf, "events").select(
        F.when(F.dayofmonth(day) == _DRIFT_DAY, drifted)
        .when((F.dayofmonth(day) == _BROKEN_DAY) & (F.col("event_type") == "error"), "{unreadable")
        .otherwise(whole).alias("value"),
        F.concat(F.lit("hms_smoke"), F.date_format(day, "yyyyMMdd")).alias("file"), day.alias("day"),
    )


def _write_polygon_files(spark, sf, **options) -> str:
    """Polygon files of every day of ``events``."""
    path = scratch_path(spark, "polygons")
    compression = "gzip" if options.get("several") else "none"
    rows = _polygon_rows(spark, sf, **options).drop("day")
    rows.write.partitionBy("file").option("compression", compression).text(path)
    return path


@query("polygon_collect", sql=f"""
    SELECT CAST(ts AS DATE) AS "Date", event_type AS "Satellite", strftime(ts, '%H%M') AS "Start",
           strftime(ts, '%H%M') AS "End",
           CASE WHEN value < 20 THEN 'Light' WHEN value < 60 THEN 'Medium' ELSE 'Heavy' END AS "Density",
           value AS lon, CAST(user_id AS DOUBLE) AS lat, 4 AS n_points
    FROM events
    WHERE day(ts) <> {_DRIFT_DAY} AND CAST(ts AS DATE) NOT IN (
        SELECT CAST(ts AS DATE) FROM events WHERE day(ts) = {_BROKEN_DAY} AND event_type = 'error')""")
def q_polygon_collect(spark, sf):
    polygons = collect_polygons(spark, _write_polygon_files(spark, sf))
    ring = F.col("geometry.coordinates")[0][0]
    return polygons.select(
        "Date", "Satellite", "Start", "End", "Density", ring[0][0].alias("lon"),
        ring[0][1].alias("lat"), F.size(ring).alias("n_points"),
    )


@query("polygon_multipart", sql=f"""
    SELECT CAST(ts AS DATE) AS "Date", event_type AS "Satellite", strftime(ts, '%H%M') AS "Start",
           CASE WHEN event_type = 'click' THEN 'MultiPolygon' ELSE 'Polygon' END AS type,
           CASE WHEN event_type = 'click' THEN 2 ELSE 1 END AS n_parts,
           CASE WHEN event_type = 'click' THEN 3 ELSE 1 END AS n_rings,
           value AS lon, CAST(user_id AS DOUBLE) AS lat
    FROM events
    WHERE day(ts) <> {_DRIFT_DAY} AND CAST(ts AS DATE) NOT IN (
        SELECT CAST(ts AS DATE) FROM events WHERE day(ts) = {_BROKEN_DAY} AND event_type = 'error')""")
def q_polygon_multipart(spark, sf):
    """Gzip files with geometries of one and of several parts."""
    polygons = collect_polygons(spark, _write_polygon_files(spark, sf, several=True))
    parts = F.col("geometry.coordinates")
    return polygons.select(
        "Date", "Satellite", "Start", "geometry.type", F.size(parts).alias("n_parts"),
        F.size(F.flatten(parts)).alias("n_rings"), parts[0][0][0][0].alias("lon"), parts[0][0][0][1].alias("lat"),
    )


_LATER, _MENDED = dt.date(2024, 1, 15), dt.date(2024, 1, 5)


def _updated_collection(spark, sf) -> PolygonLedger:
    """A collection after three updates: the first days; later days and one that changed; no change."""
    root, ledger = scratch_path(spark, "polygon-root"), PolygonLedger(spark, scratch_path(spark, "collection"))
    rows = _polygon_rows(spark, sf)
    later = F.col("day") >= F.lit(_LATER)
    put = lambda df, mode: df.drop("day").write.mode(mode).option(
        "partitionOverwriteMode", "dynamic").partitionBy("file").text(root)
    put(rows.where(~later), "append")
    ledger.update(root)
    put(rows.where(later), "append")
    put(_polygon_rows(spark, sf, density=F.lit("Mended")).where(F.col("day") == F.lit(_MENDED)), "overwrite")
    ledger.update(root)
    ledger.update(root)
    return ledger


@query("polygon_ledger", sql=f"""
    SELECT CAST(ts AS DATE) AS "Date", event_type AS "Satellite", strftime(ts, '%H%M') AS "Start",
           CASE WHEN CAST(ts AS DATE) = DATE '{_MENDED}' THEN 'Mended' WHEN value < 20 THEN 'Light'
                WHEN value < 60 THEN 'Medium' ELSE 'Heavy' END AS "Density",
           value AS lon, CAST(user_id AS DOUBLE) AS lat
    FROM events
    WHERE day(ts) <> {_DRIFT_DAY} AND CAST(ts AS DATE) NOT IN (
        SELECT CAST(ts AS DATE) FROM events WHERE day(ts) = {_BROKEN_DAY} AND event_type = 'error')""")
def q_polygon_ledger(spark, sf):
    ring = F.col("geometry.coordinates")[0][0]
    return _updated_collection(spark, sf).polygons().select(
        "Date", "Satellite", "Start", "Density", ring[0][0].alias("lon"), ring[0][1].alias("lat")
    )


@query("polygon_ledger_opened", sql=f"""
    SELECT CASE WHEN d < DATE '{_LATER}' THEN 1 ELSE 2 END AS number, d AS "Date", n_lines
    FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n_lines FROM events GROUP BY 1)
    UNION ALL
    SELECT 2, DATE '{_MENDED}', count(*) FROM events WHERE CAST(ts AS DATE) = DATE '{_MENDED}' HAVING count(*) > 0""")
def q_polygon_ledger_opened(spark, sf):
    """Days whose files each update opened, with their lines."""
    opened = _updated_collection(spark, sf).entries().where(~F.col("gone"))
    return opened.groupBy("number", "Date").agg(F.sum("n_lines").alias("n_lines"))


@query("snapshot_rerun", sql=f"""
    SELECT event_id, CAST(ts AS DATE) AS "Date",
           CASE WHEN CAST(ts AS DATE) = DATE '{_MENDED}' THEN value + 1 ELSE value END AS value
    FROM events""")
def q_snapshot_rerun(spark, sf):
    """A dated snapshot, one day of which is written again, twice."""
    rows = table(spark, sf, "events").select("event_id", "value", F.col("ts").cast("date").alias("Date"))
    path = replace_days(rows, scratch_path(spark, "snapshot"))
    mended = rows.where(F.col("Date") == F.lit(_MENDED)).withColumn("value", F.col("value") + 1)
    for _ in range(2):
        replace_days(mended, path)
    return spark.read.parquet(path)


@query("polygon_report", sql=f"""
    SELECT CAST(d AS DATE) AS "Date",
           CASE WHEN count(event_id) = 0 THEN 'missing'
                WHEN day(d) = {_DRIFT_DAY} OR (day(d) = {_BROKEN_DAY}
                     AND count(*) FILTER (WHERE event_type = 'error') > 0) THEN 'rejected'
                ELSE 'accepted' END AS status,
           count(event_id) AS n_lines
    FROM generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY) AS s(d)
    LEFT JOIN events ON CAST(ts AS DATE) = CAST(d AS DATE) GROUP BY d""")
def q_polygon_report(spark, sf):
    expected = date_spine(spark, dt.date(2023, 12, 25), dt.date(2024, 2, 5))
    return collection_report(spark, _write_polygon_files(spark, sf), expected)


@query("boundary_layer", sql="""
    SELECT min(s_acctbal) AS lon, max(s_acctbal) AS lat, 'Polygon' AS type FROM supplier
    GROUP BY s_nationkey""")
def q_boundary_layer(spark, sf):
    lo, hi = F.min("s_acctbal"), F.max("s_acctbal")
    ring = F.array(F.array(lo, hi), F.array(hi, hi), F.array(hi, lo), F.array(lo, hi))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    shapes = table(spark, sf, "supplier").groupBy("s_nationkey").agg(geometry.alias("geometry"))
    path = scratch_path(spark, "boundary")
    shapes.select(F.to_json(F.struct("geometry")).alias("value")).write.text(path)
    corner = F.col("geometry.coordinates")[0][0][0]
    return read_boundary(spark, path).select(
        corner[0].alias("lon"), corner[1].alias("lat"), "geometry.type"
    )
