"""Projections, recodes, date and string functions, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataday.functions import (
    date_text_matches, day_label, epoch_day, iso_date, join_text, month_text, paste,
    parse_dmy, parse_mdy, parse_ymd, quarter_text, recode, remove_text, scale_to_domain,
    slice_text, steps, year_text, zero_if_null,
)
from strataday.operators import (
    arrange, is_numeric, left_join, map_columns_if, rename_positions, select_positions, with_point,
)
from strataday.plans import add_referents, date_spine, facet_series, study_cases, yearly_scatter
from strataday.schemas import (
    COUNTY_ASCII, COUNTY_FIPS, FACET_ORDER, FIRE_APR_AUG, FIRE_APR_SEP, OFF_SEASON, OUTCOMES, PALETTE_DOMAIN,
)
from strataday.sources import daily_path, file_date

from .registry import query
from .views import (
    FIRST, LAST, START, admissions, ctes, heat, smoke, table,
)


@query("select_positions", sql="""
    SELECT o_orderkey, o_totalprice, o_orderdate, o_orderpriority, o_custkey FROM orders""")
def q_select_positions(spark, sf):
    return select_positions(table(spark, sf, "orders"), 1, (4, 6), 2)


@query("rename_outcomes", sql="""
    SELECT o_orderkey AS "Patient_ID", o_orderdate AS "Date", o_totalprice AS outcome,
           'orders' AS out_name FROM orders""")
def q_rename_outcomes(spark, sf):
    picked = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    named = rename_positions(picked, {1: "Patient_ID"})
    return named.withColumnsRenamed({"o_orderdate": "Date", "o_totalprice": "outcome"}).withColumn(
        "out_name", F.lit("orders")
    )


@query("admissions_clean", sql=ctes("fips", "oc", "adm") + """
    SELECT * FROM adm""")
def q_admissions_clean(spark, sf):
    return admissions(spark, sf, text_dates=True)


@query("recode_default_null", sql=ctes("fips") + """
    SELECT c_custkey, c_nationkey, name AS "County" FROM customer LEFT JOIN fips ON code = c_nationkey""")
def q_recode_default_null(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", "c_nationkey", recode("c_nationkey", COUNTY_FIPS).alias("County")
    )


@query("recode_keep", sql=ctes("fips") + """
    SELECT s_suppkey, CASE WHEN name = 'Doña Ana' THEN 'Dona Ana' ELSE name END AS "County"
    FROM supplier LEFT JOIN fips ON code = s_nationkey""")
def q_recode_keep(spark, sf):
    named = table(spark, sf, "supplier").select(
        "s_suppkey", recode("s_nationkey", COUNTY_FIPS).alias("County")
    )
    return named.withColumn("County", recode("County", COUNTY_ASCII, "keep"))


@query("parse_dates", sql="""
    SELECT o_orderkey,
           CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS dmy,
           CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) END AS ymd,
           CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderdate AS DATE) END AS mdy,
           CAST(o_orderdate AS DATE) AS iso
    FROM orders""")
def q_parse_dates(spark, sf):
    day = F.col("o_orderdate").cast("date")
    broken = F.lit("not a date")
    text = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", broken)
        .otherwise(F.upper(F.date_format(day, "ddMMMyyyy"))).alias("dmy"),
        F.when(F.col("o_orderstatus") == "O", broken)
        .otherwise(F.date_format(day, "yyyy-M-d")).alias("ymd"),
        F.when(F.col("o_orderstatus") == "F", broken)
        .otherwise(F.date_format(day, "M/d/yyyy")).alias("mdy"),
        day.cast("string").alias("iso"),
    )
    return text.select(
        "o_orderkey", parse_dmy("dmy").alias("dmy"), parse_ymd("ymd").alias("ymd"),
        parse_mdy("mdy").alias("mdy"), iso_date("iso").alias("iso"),
    )


@query("epoch_header_dates", sql="""
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE WHEN l_returnflag <> 'N' THEN CAST(l_shipdate AS DATE) END AS "Date"
    FROM lineitem""")
def q_epoch_header_dates(spark, sf):
    head = F.unix_date(F.col("l_shipdate").cast("date")).cast("string")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        epoch_day(F.when(F.col("l_returnflag") == "N", "note").otherwise(head)).alias("Date"),
    )


@query("calendar_labels", sql="""
    SELECT o_orderkey, strftime(o_orderdate, '%Y') AS "Year", strftime(o_orderdate, '%m') AS "Month",
           strftime(o_orderdate, '%m-%d-%Y') AS label, 'Q' || quarter(o_orderdate) AS quarter
    FROM orders""")
def q_calendar_labels(spark, sf):
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select(
        "o_orderkey", year_text(day).alias("Year"), month_text(day).alias("Month"),
        day_label(day).alias("label"), quarter_text(day).alias("quarter"),
    )


@query("string_ops", sql="""
    SELECT p_partkey, substr(p_name, 1, 4) AS prefix, substr(p_brand, 6, 2) AS slice,
           replace(CAST(d AS VARCHAR), '-', '') AS compact,
           'hms/' || substr(CAST(d AS VARCHAR), 1, 4) || '/' || f AS path,
           substr(p_name, 1, 4) || ' ' || coalesce(f, 'NA') AS pasted,
           p_size || '_map.png' AS file_name
    FROM (SELECT *, DATE '1995-01-01' + p_size AS d,
                 CASE WHEN p_type <> 'PROMO' THEN p_type END AS f FROM part)""")
def q_string_ops(spark, sf):
    part = table(spark, sf, "part").withColumns({
        "d": F.date_add(F.lit(START), F.col("p_size")),
        "f": F.when(F.col("p_type") != "PROMO", F.col("p_type")),
    })
    return part.select(
        "p_partkey", slice_text("p_name", 1, 4).alias("prefix"),
        slice_text("p_brand", 6, 7).alias("slice"), remove_text("d", "-").alias("compact"),
        join_text(F.lit("hms"), slice_text("d", 1, 4), "f", sep="/").alias("path"),
        paste(slice_text("p_name", 1, 4), "f").alias("pasted"),
        join_text("p_size", F.lit("_map.png")).alias("file_name"),
    )


@query("daily_paths", sql="""
    SELECT event_id, 'smoke/' || strftime(ts, '%Y/%m') || '/hms_smoke' || strftime(ts, '%Y%m%d') AS path,
           CAST(ts AS DATE) AS "Date" FROM events""")
def q_daily_paths(spark, sf):
    path = daily_path(F.col("ts").cast("date"), "smoke")
    return table(spark, sf, "events").select(
        "event_id", path.alias("path"), file_date(path).alias("Date")
    )


@query("scale_to_domain", sql="""
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
           CASE WHEN l_quantity BETWEEN 3 AND 40 THEN (l_quantity - 3) / 37 END AS shade,
           CASE WHEN l_quantity BETWEEN 3 AND 40 THEN 1 - (l_quantity - 3) / 37 END AS shade_reversed
    FROM lineitem""")
def q_scale_to_domain(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
        scale_to_domain("l_quantity", 3, 40).alias("shade"),
        scale_to_domain("l_quantity", 3, 40, reverse=True).alias("shade_reversed"),
    )


@query("palette_steps", sql="""
    SELECT l_orderkey, l_linenumber, l_partkey, v,
           CASE WHEN v BETWEEN -3 AND 67 THEN CAST(floor((v + 3) / 5) AS INTEGER) + 1 END AS step_no,
           CASE WHEN v BETWEEN -3 AND 67 THEN -3 + 5 * floor((v + 3) / 5) END AS step
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS DOUBLE) * 2 - 10 AS v FROM lineitem)""")
def q_palette_steps(spark, sf):
    """The step of the palette's domain that each value falls on."""
    lo, hi = PALETTE_DOMAIN
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity").cast("double") * 2 - 10).alias("v")
    )
    reached = F.filter(steps(lo, hi, 5), lambda s: s <= F.col("v"))
    inside = F.col("v").between(lo, hi)
    return rows.select(
        "*", F.when(inside, F.size(reached)).alias("step_no"), F.when(inside, F.array_max(reached)).alias("step")
    )


@query("with_point", sql="""
    SELECT c_custkey, 4326 AS srid, -c_acctbal AS lon, c_acctbal AS lat FROM customer""")
def q_with_point(spark, sf):
    placed = table(spark, sf, "customer").select(
        "c_custkey", (-F.col("c_acctbal")).alias("x"), F.col("c_acctbal").alias("y")
    )
    return with_point(placed, "x", "y").select("c_custkey", "srid", "geometry.lon", "geometry.lat")


@query("date_spine", sql="""
    SELECT CAST(d AS DATE) AS "Date", count(o_orderkey) AS n_orders
    FROM generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY) AS s(d)
    LEFT JOIN orders ON CAST(o_orderdate AS DATE) = CAST(d AS DATE) GROUP BY 1""")
def q_date_spine(spark, sf):
    daily = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("Date"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return date_spine(spark, FIRST, LAST).join(daily, "Date", "left").select(
        "Date", zero_if_null("n").alias("n_orders")
    )


def _season_sql(months) -> str:
    return f"""
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS "Date" FROM orders
    WHERE month(o_orderdate) IN {tuple(months)} AND CAST(o_orderdate AS DATE) > DATE '1995-01-01'"""


def _dated_orders(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("Date")
    )


@query("season_filter", sql=_season_sql(FIRE_APR_SEP))
def q_season_filter(spark, sf):
    return study_cases(_dated_orders(spark, sf), FIRE_APR_SEP, START)


@query("season_filter_apr_aug", sql=_season_sql(FIRE_APR_AUG))
def q_season_filter_apr_aug(spark, sf):
    return _dated_orders(spark, sf).where(
        date_text_matches("Date", "-04-|-05-|-06-|-07-|-08-") & (F.col("Date") > "1995-01-01")
    )


@query("off_season_filter", sql=_season_sql(OFF_SEASON))
def q_off_season_filter(spark, sf):
    return study_cases(_dated_orders(spark, sf), OFF_SEASON, START)


@query("standard_filter", sql="""
    SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'""")
def q_standard_filter(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT")


@query("fill_numeric", sql=ctes("fips", "oc", "pm", "heat", "expo") + """
    SELECT "Date", "County", smokepm25, totalpm25, coalesce("HeatIndex", 0) AS "HeatIndex" FROM expo""")
def q_fill_numeric(spark, sf):
    joined = left_join(smoke(spark, sf), heat(spark, sf), ("Date", "County"))
    return map_columns_if(joined, is_numeric, zero_if_null)


@query("facet_series", sql=ctes("fips", "oc", "adm") + """
    SELECT "Date", "County", o.dx AS "Primary_dx", o.n AS "Count", CAST(o.ord AS INTEGER) AS facet_ord
    FROM (SELECT "Date", "County", unnest([""" + ", ".join(
        f"{{'ord': {FACET_ORDER.index(dx) + 1}, 'dx': '{dx}', 'n': {dx}}}" for dx in OUTCOMES
    ) + """]) AS o FROM adm)""")
def q_facet_series(spark, sf):
    return facet_series(admissions(spark, sf))


@query("yearly_scatter", sql=ctes("fips", "pm") + """
    SELECT strftime("Date", '%Y') AS "Year", strftime("Date", '%m') AS "Month", "Date", "County",
           smokepm25 FROM pm""")
def q_yearly_scatter(spark, sf):
    return yearly_scatter(smoke(spark, sf))


@query("sorted_panel", sql=ctes("fips", "pm") + """
    SELECT * FROM pm ORDER BY "Date" NULLS LAST, "County" NULLS LAST""")
def q_sorted_panel(spark, sf):
    return arrange(smoke(spark, sf), "Date", "County")


def _referents_sql(months, year: str, month: str) -> str:
    return f"""
    SELECT o_orderkey, {year} AS "Year", {month} AS "Month", shifted AS "Date"
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d,
                 CAST(o_orderdate AS DATE) + 7 * CAST(w AS INTEGER) AS shifted, w
          FROM orders, generate_series(-26, 26) AS g(w)
          WHERE month(o_orderdate) IN {tuple(months)}
            AND CAST(o_orderdate AS DATE) > DATE '1995-01-01')
    WHERE w <> 0 AND month(shifted) IN {tuple(months)} AND shifted > DATE '1995-01-01'"""


def _order_cases(spark, sf, months):
    day = F.col("o_orderdate").cast("date")
    cases = table(spark, sf, "orders").select(
        "o_orderkey", year_text(day).alias("Year"), month_text(day).alias("Month"),
        day.alias("Date"),
    )
    return study_cases(cases, months, START)


@query("referent_dates", sql=_referents_sql(FIRE_APR_SEP, "strftime(d, '%Y')", "strftime(d, '%m')"))
def q_referent_dates(spark, sf):
    return add_referents(_order_cases(spark, sf, FIRE_APR_SEP), months=FIRE_APR_SEP, start=START)


# the same rows by another definition: all other dates of the season with the case's weekday
@query("referent_dates_same_season", sql="""
    WITH days AS (
        SELECT CAST(d AS DATE) AS day
        FROM generate_series(DATE '1995-01-02', DATE '2001-12-31', INTERVAL 1 DAY) AS s(d)
        WHERE month(d) BETWEEN 4 AND 9)
    SELECT o_orderkey, strftime(o_orderdate, '%Y') AS "Year", strftime(o_orderdate, '%m') AS "Month",
           day AS "Date"
    FROM orders JOIN days ON year(day) = year(o_orderdate) AND dayofweek(day) = dayofweek(o_orderdate)
    WHERE month(o_orderdate) BETWEEN 4 AND 9 AND day <> CAST(o_orderdate AS DATE)""")
def q_referent_dates_same_season(spark, sf):
    return q_referent_dates(spark, sf)


@query("referent_dates_off_season", sql=_referents_sql(
    OFF_SEASON, "strftime(shifted, '%Y')", "strftime(shifted, '%m')"))
def q_referent_dates_off_season(spark, sf):
    cases = _order_cases(spark, sf, OFF_SEASON)
    return add_referents(cases, months=OFF_SEASON, start=START, recompute_calendar=True)
