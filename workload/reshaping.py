"""Reshaping, numbering, grouping and distinct."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataday.functions import count_values, strict_sum, year_text
from strataday.operators import (
    distinct_sorted, keep_first, keep_groups, pivot_values, rank_dates, to_long, uncount, union_by_name,
)
from strataday.plans import (
    annual_summary, build_episodes, clean_heat, daily_counts, explode_outcomes, widen_episodes,
)
from strataday.plans.episodes import case_cells
from strataday.schemas import COUNTY_STATE_FIPS, FACET_ORDER, OUTCOMES

from .registry import query
from .views import admission_rows, admissions, ctes, heat_wide, month_heads, table


@query("unpivot_outcomes", sql=ctes("fips", "oc", "adm") + f"""
    SELECT "Date", "County", "Total_Cases", "Primary_dx", "Count"
    FROM adm UNPIVOT INCLUDE NULLS ("Count" FOR "Primary_dx" IN ({", ".join(OUTCOMES)}))""")
def q_unpivot_outcomes(spark, sf):
    return to_long(
        admissions(spark, sf), ["Date", "County", "Total_Cases"], OUTCOMES, "Primary_dx", "Count"
    )


_HEADS = ", ".join(f"({h})" for h in month_heads())


@query("heat_long", sql=ctes("fips") + f""",
    v AS (SELECT s_nationkey AS code,
                 CAST(date_trunc('month', l_shipdate) AS DATE) AS m,
                 CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / 100 AS v
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
    grid AS (SELECT code, m FROM (SELECT DISTINCT code FROM v), (
                 SELECT DATE '1970-01-01' + h AS m FROM (VALUES {_HEADS}) AS t(h)))
    SELECT name AS "County", grid.m AS "Date", v.v AS "HeatIndex"
    FROM grid LEFT JOIN v ON v.code = grid.code AND v.m = grid.m
    LEFT JOIN fips ON fips.code = grid.code
    UNION ALL
    SELECT name, NULL, 1.0 FROM (SELECT DISTINCT code FROM v) c LEFT JOIN fips ON fips.code = c.code""")
def q_heat_long(spark, sf):
    return clean_heat(heat_wide(spark, sf), COUNTY_STATE_FIPS)


@query("uncount_episodes", sql=ctes("fips", "oc", "adm", "cells", "eplong") + """
    SELECT "Date", "County", dx AS "Primary_dx", k AS replicate
    FROM eplong, unnest(range(0, n)) AS t(k)""")
def q_uncount_episodes(spark, sf):
    rows = explode_outcomes(case_cells(admissions(spark, sf)))
    return uncount(rows.drop("first_id", "dx_ord"), "n", "replicate")


@query("episode_ids", sql=ctes("fips", "oc", "adm", "cells", "eplong", "ep") + """
    SELECT "Date", "County", dx AS "Primary_dx", 1 AS "Episode", "Patient_ID" FROM ep""")
def q_episode_ids(spark, sf):
    return build_episodes(admissions(spark, sf))


@query("episode_ids_file_order", sql=ctes("fips", "oc", "epfile") + """
    SELECT "Date", "County", dx AS "Primary_dx", 1 AS "Episode", "Patient_ID" FROM ep""")
def q_episode_ids_file_order(spark, sf):
    return build_episodes(admission_rows(spark, sf), file_order="o_orderkey")


@query("pivot_episodes", sql=ctes("fips", "oc", "adm", "cells", "eplong", "ep") + f"""
    SELECT "Date", strftime("Date", '%Y') AS "Year", strftime("Date", '%m') AS "Month", "County",
           "Patient_ID", substr(dx, 1, 4) AS "Prim_dx",
           {", ".join(f"CASE WHEN dx = '{c}' THEN 1 ELSE 0 END AS {c}" for c in OUTCOMES)}
    FROM ep""")
def q_pivot_episodes(spark, sf):
    return widen_episodes(build_episodes(admissions(spark, sf)), keep_prefix=True)


@query("pivot_values", sql="""
    SELECT "Date", max(n) FILTER (WHERE event_type = 'view') AS "view",
           max(n) FILTER (WHERE event_type = 'click') AS click,
           max(n) FILTER (WHERE event_type = 'error') AS error,
           max(n) FILTER (WHERE event_type = 'signup') AS signup,
           max(n) FILTER (WHERE event_type = 'purchase') AS purchase,
           max(n) FILTER (WHERE event_type = 'absent') AS absent
    FROM (SELECT CAST(ts AS DATE) AS "Date", event_type, count(*) AS n FROM events GROUP BY ALL)
    GROUP BY ALL""")
def q_pivot_values(spark, sf):
    daily = (
        table(spark, sf, "events")
        .groupBy(F.col("ts").cast("date").alias("Date"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return pivot_values(daily, ["Date"], "event_type", ["view", "click", "error", "signup", "purchase", "absent"], "n")


_LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity",
               "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query("keep_first", sql=f"""
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {", ".join(_LINE_ORDER)}) AS rn
        FROM lineitem) WHERE rn = 1""")
def q_keep_first(spark, sf):
    return keep_first(table(spark, sf, "lineitem"), ["l_partkey"], _LINE_ORDER)


@query("keep_groups", sql="""
    SELECT * FROM orders WHERE o_custkey IN (
        SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 2)""")
def q_keep_groups(spark, sf):
    return keep_groups(table(spark, sf, "orders"), ["o_custkey"], count_values("o_orderstatus") == 2)


@query("count_values", sql="""
    SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n_segments,
           count(DISTINCT nullif(c_mktsegment, 'FURNITURE'))
           + max(CASE WHEN c_mktsegment = 'FURNITURE' THEN 1 ELSE 0 END) AS n_with_null
    FROM customer GROUP BY ALL""")
def q_count_values(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(
        count_values("c_mktsegment").alias("n_segments"),
        count_values(F.nullif(F.col("c_mktsegment"), F.lit("FURNITURE"))).alias("n_with_null"),
    )


@query("annual_summary", sql=ctes("fips", "oc", "adm") + f"""
    SELECT strftime("Date", '%Y') AS "Year",
           {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in FACET_ORDER)}
    FROM adm GROUP BY 1""")
def q_annual_summary(spark, sf):
    return annual_summary(admissions(spark, sf, text_dates=True))


@query("annual_summary_strict", sql=ctes("fips", "oc", "adm") + """
    SELECT strftime("Date", '%Y') AS "Year", CASE WHEN count(*) = count(n)
           THEN CAST(sum(n) AS BIGINT) END AS n
    FROM (SELECT "Date", nullif("Total_Cases", 4) AS n FROM adm) GROUP BY 1""")
def q_annual_summary_strict(spark, sf):
    holed = admissions(spark, sf).select(
        year_text("Date").alias("Year"), F.nullif(F.col("Total_Cases"), F.lit(4)).alias("n")
    )
    return holed.groupBy("Year").agg(strict_sum("n").alias("n"))


@query("union_by_name", sql="""
    SELECT CAST(o_orderdate AS DATE) AS "Date", o_orderkey AS id, o_totalprice AS price,
           CAST(NULL AS DOUBLE) AS quantity FROM orders
    UNION ALL SELECT CAST(l_shipdate AS DATE), l_orderkey, NULL, l_quantity FROM lineitem
    UNION ALL SELECT CAST(ts AS DATE), event_id, NULL, NULL FROM events""")
def q_union_by_name(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderdate").cast("date").alias("Date"), F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("price"),
    )
    lines = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("quantity"), F.col("l_orderkey").alias("id"),
        F.col("l_shipdate").cast("date").alias("Date"),
    )
    events = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("date").alias("Date")
    )
    return union_by_name(orders, lines, events)


@query("distinct_dates_ranked", sql="""
    SELECT "Date", row_number() OVER (ORDER BY "Date") AS rank
    FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS "Date" FROM orders)""")
def q_distinct_dates_ranked(spark, sf):
    days = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("Date"))
    return rank_dates(days).withColumn("rank", F.col("rank").cast("long"))


@query("distinct_sorted", sql="""
    SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 7 <> 0""")
def q_distinct_sorted(spark, sf):
    """Distinct values in order; NULLs are left out."""
    keys = table(spark, sf, "orders").select(F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey"))
    return distinct_sorted(keys, "o_custkey")


@query("daily_split", sql="""
    SELECT CAST(ts AS DATE) AS "Date", count(*) AS n_rows FROM events GROUP BY 1""")
def q_daily_split(spark, sf):
    return daily_counts(table(spark, sf, "events").withColumn("Date", F.col("ts").cast("date")))
