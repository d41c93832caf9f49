"""Map frames and monitors."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from strataday.functions import zero_if_null
from strataday.operators import dense_rank, rank_dates
from strataday.plans import frame_layers, frame_manifest, standardise_monitors
from strataday.schemas import FRAME_FIRST_NUMBER
from strataday.sources import read_monitor_daily

from .registry import query
from .views import FIRST, LAST, ctes, monitor_daily, table

_MANIFEST_SQL = f"""manifest AS (
        SELECT CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS frame_no, CAST(d AS DATE) AS "Date",
               strftime(d, '%m-%d-%Y') AS label
        FROM generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY) AS s(d))"""


@query("frame_manifest", sql=f"""WITH {_MANIFEST_SQL}
    SELECT frame_no + {FRAME_FIRST_NUMBER - 1} AS frame_no, "Date", label,
           (frame_no + {FRAME_FIRST_NUMBER - 1}) || '_map.png' AS file_name,
           count(l_orderkey) AS n_features
    FROM manifest LEFT JOIN lineitem ON CAST(l_shipdate AS DATE) = "Date" GROUP BY ALL""")
def q_frame_manifest(spark, sf):
    daily = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_shipdate").cast("date").alias("Date"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frames = frame_manifest(spark, FIRST, LAST).join(daily, "Date", "left")
    return frames.select(
        "frame_no", "Date", "label", "file_name", zero_if_null("n").alias("n_features")
    )


def _layers(spark, sf, by):
    day = F.col("l_shipdate").cast("date")
    smoke = table(spark, sf, "lineitem").select(
        day.alias("Date"), F.col("l_orderkey").alias("feature_id"),
        F.format_string("POINT(%d %d)", "l_partkey", "l_suppkey").alias("geometry"),
    )
    monitors = table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("date").alias("Date"), F.col("o_orderkey").alias("feature_id"),
        F.format_string("POINT(%d %d)", "o_custkey", "o_orderkey").alias("geometry"),
        (F.col("o_totalprice") / F.lit(5000.0)).alias("Concentration"),
    )
    boundary = table(spark, sf, "supplier").agg(
        F.count(F.lit(1)).alias("feature_id"),
        F.format_string("BOX(%d %d)", F.min("s_suppkey"), F.max("s_suppkey")).alias("geometry"),
    )
    return frame_layers(frame_manifest(spark, FIRST, LAST, 1), smoke, monitors, boundary, by)


def _layers_sql(smoke_on: str, monitor_on: str) -> str:
    shade = """CASE WHEN "Concentration" BETWEEN -3 AND 67 THEN 1 - ("Concentration" - (-3)) / 70 END"""
    return f"""WITH {_MANIFEST_SQL},
    sm AS (SELECT CAST(l_shipdate AS DATE) AS d, l_orderkey AS feature_id,
                  'POINT(' || l_partkey || ' ' || l_suppkey || ')' AS geometry FROM lineitem),
    mo AS (SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey AS feature_id,
                  'POINT(' || o_custkey || ' ' || o_orderkey || ')' AS geometry,
                  o_totalprice / 5000 AS "Concentration" FROM orders),
    smr AS (SELECT d, row_number() OVER (ORDER BY d) AS k FROM (SELECT DISTINCT d FROM sm)),
    mor AS (SELECT d, row_number() OVER (ORDER BY d) AS k FROM (SELECT DISTINCT d FROM mo)),
    layers AS (
        SELECT frame_no, label, sm.d AS layer_date, 'smoke' AS layer, feature_id, geometry,
               CAST(NULL AS DOUBLE) AS "Concentration"
        FROM manifest JOIN smr {smoke_on} JOIN sm ON sm.d = smr.d
        UNION ALL
        SELECT frame_no, label, mo.d, 'monitor', feature_id, geometry, "Concentration"
        FROM manifest JOIN mor {monitor_on} JOIN mo ON mo.d = mor.d
        UNION ALL
        SELECT frame_no, label, NULL, 'boundary', n, box, NULL FROM manifest, (
            SELECT count(*) AS n, 'BOX(' || min(s_suppkey) || ' ' || max(s_suppkey) || ')' AS box
            FROM supplier))
    SELECT *, {shade} AS shade FROM layers"""


@query("frame_layers_date", sql=_layers_sql('ON smr.d = "Date"', 'ON mor.d = "Date"'))
def q_frame_layers_date(spark, sf):
    return _layers(spark, sf, "date")


@query("frame_layers_rank", sql=_layers_sql("ON smr.k = frame_no", "ON mor.k = frame_no"))
def q_frame_layers_rank(spark, sf):
    return _layers(spark, sf, "rank")


@query("layer_dates_by_rank", sql="""
    SELECT a.rank, a."Date" AS smoke_date, b."Date" AS monitor_date
    FROM (SELECT "Date", row_number() OVER (ORDER BY "Date") AS rank FROM (
            SELECT DISTINCT CAST(l_shipdate AS DATE) AS "Date" FROM lineitem)) a
    JOIN (SELECT "Date", row_number() OVER (ORDER BY "Date") AS rank FROM (
            SELECT DISTINCT CAST(o_orderdate AS DATE) AS "Date" FROM orders)) b
    ON a.rank = b.rank""")
def q_layer_dates_by_rank(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("Date"))
    orders = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("Date"))
    smoke_days = rank_dates(lines).withColumnRenamed("Date", "smoke_date")
    monitor_days = rank_dates(orders).withColumnRenamed("Date", "monitor_date")
    return smoke_days.join(monitor_days, "rank").withColumn("rank", F.col("rank").cast("long"))


@query("timestamps_ranked", sql="""
    SELECT ts, row_number() OVER (ORDER BY ts) AS rank FROM (SELECT DISTINCT ts FROM events)""")
def q_timestamps_ranked(spark, sf):
    return dense_rank(table(spark, sf, "events"), "ts")


@query("events_by_rank", sql="""
    SELECT a.rank, a.ts, b.o_orderkey
    FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS rank FROM (SELECT DISTINCT ts FROM events)) a
    JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rank FROM (
            SELECT DISTINCT o_orderkey FROM orders)) b ON a.rank = b.rank""")
def q_events_by_rank(spark, sf):
    """The k-th distinct time joined to the k-th distinct order."""
    return dense_rank(table(spark, sf, "events"), "ts").join(
        dense_rank(table(spark, sf, "orders"), "o_orderkey"), "rank"
    )


_STATES = (1, 3, 5, 6, 7, 9, 11, 13)
_BEGIN, _END = dt.date(1996, 1, 1), dt.date(1999, 12, 31)


@query("monitors_standard", sql=ctes("oc") + f"""
    SELECT -c_acctbal AS lon, c_acctbal AS lat, 4326 AS srid, c_nationkey AS state_code,
           c_mktsegment AS county_code, CAST(o_custkey AS VARCHAR) AS site_number, "Date",
           'PM2.5' AS "Pollutant", o_totalprice AS "Concentration"
    FROM oc WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND c_nationkey IN {_STATES}
      AND "Date" BETWEEN DATE '{_BEGIN}' AND DATE '{_END}'""")
def q_monitors_standard(spark, sf):
    daily = read_monitor_daily(monitor_daily(spark, sf), "1-URGENT", _BEGIN, _END, _STATES)
    return standardise_monitors(daily, standard="F").select(
        "geometry.lon", "geometry.lat", "srid", "state_code", "county_code", "site_number",
        "Date", "Pollutant", "Concentration",
    )
