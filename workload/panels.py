"""Exposure joins and lags."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataday.functions import quarter_text, recode
from strataday.operators import add_lags, add_lags_ranged, left_join
from strataday.plans import exposure_panel
from strataday.schemas import COUNTY_FIPS

from .registry import query
from .views import PANEL_SQL, ctes, heat, lag_sql, orders_with_customer, smoke, table


@query("exposure_join", sql=ctes("fips", "oc", "pm", "heat", "expo") + "SELECT * FROM expo")
def q_exposure_join(spark, sf):
    return left_join(smoke(spark, sf), heat(spark, sf), ("Date", "County"), on_dup="error")


@query("exposure_join_3key", sql=ctes("fips", "oc", "pm") + """
    SELECT o_orderkey, oc."Date", f.name AS "County", 'Q' || quarter(oc."Date") AS quarter,
           smokepm25, totalpm25
    FROM oc LEFT JOIN fips f ON f.code = c_nationkey
    LEFT JOIN pm ON pm."Date" = oc."Date" AND pm."County" IS NOT DISTINCT FROM f.name""")
def q_exposure_join_3key(spark, sf):
    rows = orders_with_customer(spark, sf).select(
        "o_orderkey", "Date", recode("c_nationkey", COUNTY_FIPS).alias("County"),
        quarter_text("Date").alias("quarter"),
    )
    panel = smoke(spark, sf).withColumn("quarter", quarter_text("Date"))
    return left_join(rows, panel, ("County", "Date", "quarter"))


@query("lag_rows", sql=ctes("fips", "oc", "pm", "heat", "expo", extra=PANEL_SQL) + "SELECT * FROM panel")
def q_lag_rows(spark, sf):
    return exposure_panel(smoke(spark, sf), heat(spark, sf))


@query("lag_calendar", sql=ctes("fips", "pm") + """
    SELECT a."Date", a."County", a.smokepm25, a.totalpm25, """ + ", ".join(
        f"b{k}.{v} AS {v}_lag{k}" for v in ("smokepm25", "totalpm25") for k in range(1, 6)
    ) + " FROM pm a " + " ".join(
        f"""LEFT JOIN pm b{k} ON b{k}."Date" = a."Date" - {k}
        AND b{k}."County" IS NOT DISTINCT FROM a."County" """ for k in range(1, 6)
    ))
def q_lag_calendar(spark, sf):
    return exposure_panel(smoke(spark, sf), mode="calendar")


_UNDATED = """undated AS (
        SELECT * FROM pm UNION ALL
        SELECT NULL, "County", min(smokepm25), max(totalpm25) FROM pm GROUP BY "County")"""


@query("lag_calendar_undated", sql=ctes("fips", "pm", extra=_UNDATED) + """
    SELECT a."Date", a."County", a.smokepm25, a.totalpm25, """ + ", ".join(
        f"b{k}.{v} AS {v}_lag{k}" for v in ("smokepm25", "totalpm25") for k in range(1, 6)
    ) + " FROM undated a " + " ".join(
        f"""LEFT JOIN pm b{k} ON b{k}."Date" = a."Date" - {k}
        AND b{k}."County" IS NOT DISTINCT FROM a."County" """ for k in range(1, 6)
    ))
def q_lag_calendar_undated(spark, sf):
    """A row without a date in every county: it has no lags and gives none."""
    daily = smoke(spark, sf)
    undated = daily.groupBy("County").agg(F.min("smokepm25").alias("smokepm25"), F.max("totalpm25").alias("totalpm25"))
    rows = daily.unionByName(undated.withColumn("Date", F.lit(None).cast("date")))
    return exposure_panel(rows, mode="calendar")


_WEATHER = ["mean_relh", "mean_tmpf", "max_tmpf"]


@query("lag_weather", sql="""
    SELECT *, """ + lag_sql(_WEATHER, 6, "user_id", '"Date"') + """
    FROM (SELECT user_id, CAST(ts AS DATE) AS "Date", count(*) AS mean_relh,
                 min(value) AS mean_tmpf, max(value) AS max_tmpf FROM events GROUP BY ALL)""")
def q_lag_weather(spark, sf):
    daily = (
        table(spark, sf, "events")
        .groupBy("user_id", F.col("ts").cast("date").alias("Date"))
        .agg(F.count(F.lit(1)).alias("mean_relh"), F.min("value").alias("mean_tmpf"),
             F.max("value").alias("max_tmpf"))
    )
    return add_lags(daily, _WEATHER, group="user_id")


_TIES = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey",
         "l_quantity", "l_discount", "l_tax"]


@query("lag_rows_repeated_days", sql="""
    SELECT l_returnflag, """ + ", ".join(_TIES) + ", " + lag_sql(
        ["l_discount", "l_quantity"], 5, "l_returnflag", ", ".join(_TIES)) + """
    FROM lineitem""")
def q_lag_rows_repeated_days(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_returnflag", *_TIES)
    return add_lags_ranged(lines, ["l_discount", "l_quantity"], 5, "l_returnflag", _TIES)
