"""Study-shaped inputs derived from the supplied tables, in Spark and in SQL.

``orders`` joined to ``customer`` plays the admissions, ``lineitem`` joined to ``supplier``
the exposure panel, ``events`` the smoke-polygon files. The nation key stands in
for the county code; codes outside the county map become a NULL county, which
then is the largest group by far.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strataday.functions import recode
from strataday.plans import clean_admissions, clean_smoke
from strataday.schemas import COUNTY_FIPS, MULTI_FLAGS, OUTCOME_SOURCES, OUTCOMES

START = dt.date(1995, 1, 1)
FIRST, LAST = dt.date(1995, 1, 1), dt.date(2001, 12, 31)

# one rule per stand-in diagnosis, valid in both dialects
RULES = {
    "resp_prim": "o_orderpriority = '1-URGENT'",
    "asthma_prim": "o_orderpriority = '1-URGENT' AND c_mktsegment = 'AUTOMOBILE'",
    "copd_prim": "o_orderpriority = '1-URGENT' AND c_mktsegment = 'BUILDING'",
    "pneu_prim": "o_orderpriority = '1-URGENT' AND c_mktsegment = 'FURNITURE'",
    "bron_prim": "o_orderpriority = '1-URGENT' AND c_mktsegment = 'HOUSEHOLD'",
    "cardio_prim": "o_orderpriority = '2-HIGH'",
    "cardiac_prim": "o_orderpriority = '2-HIGH' AND c_mktsegment = 'AUTOMOBILE'",
    "arrythmia_prim": "o_orderpriority = '2-HIGH' AND c_mktsegment = 'BUILDING'",
    "heartfail_prim": "o_orderpriority = '2-HIGH' AND c_mktsegment = 'FURNITURE'",
    "ischemic_prim": "o_orderpriority = '2-HIGH' AND c_mktsegment = 'HOUSEHOLD'",
    "mi_prim": "o_orderpriority = '2-HIGH' AND c_mktsegment = 'MACHINERY'",
    "cerebro_prim": "o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F'",
}
FLAG_RULES = {
    "asthma": RULES["asthma_prim"],
    "copd": RULES["copd_prim"],
    "pneumonia": RULES["pneu_prim"],
    "bronchitis": RULES["bron_prim"],
    "respiratory": RULES["resp_prim"],
    "arrythmia": RULES["arrythmia_prim"],
    "cerebrovascular": RULES["cerebro_prim"],
    "heartfailure": RULES["heartfail_prim"],
    "ischemic": RULES["ischemic_prim"],
    "myocardial": RULES["mi_prim"],
    "cardiovascular": RULES["cardio_prim"],
    "heatillness": "o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'O'",
    "forearmfracture": "o_orderpriority = '5-LOW' AND o_orderstatus = 'P'",
    "cardiorespiratory": "o_orderpriority IN ('1-URGENT', '2-HIGH')",
}
assert list(FLAG_RULES) == MULTI_FLAGS and list(RULES) == list(OUTCOME_SOURCES)


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables. Its schema is read from the file footer once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def cents(column: str) -> Column:
    """Two-decimal amount as whole cents, so that sums are exact in any order."""
    return F.rint(F.col(column) * 100).cast("long")


def orders_with_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).withColumn(
        "Date", F.col("o_orderdate").cast("date")
    )


def admissions_raw(spark: SparkSession, sf_dir: str, text_dates: bool = False) -> DataFrame:
    """County-day counts laid out like the admissions file, or like its stored form with real dates."""
    counts = (
        orders_with_customer(spark, sf_dir)
        .groupBy("Date", "c_nationkey")
        .agg(
            F.count(F.lit(1)).alias("All_Admissions"),
            *[F.count_if(F.expr(rule)).alias(c) for c, rule in RULES.items()],
        )
    )
    return counts.select(
        (F.upper(F.date_format("Date", "ddMMMyyyy")) if text_dates else F.col("Date")).alias(
            "Admission_Date"
        ),
        F.col("c_nationkey").alias("Patient_Resi_County_FIPS_Cd"),
        F.dayofweek("Date").alias("Weekday"),
        "All_Admissions",
        *RULES,
    )


def admissions(spark: SparkSession, sf_dir: str, text_dates: bool = False) -> DataFrame:
    return clean_admissions(admissions_raw(spark, sf_dir, text_dates))


def admission_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source row per order, with its position, for numbering in file order."""
    return orders_with_customer(spark, sf_dir).select(
        "Date", recode("c_nationkey", COUNTY_FIPS).alias("County"), "o_orderkey",
        *[F.expr(RULES[src]).cast("int").alias(dx) for src, dx in OUTCOME_SOURCES.items()],
    )


def smoke_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """County-day exposure with text dates and the unaccented county spelling."""
    spelled = {**COUNTY_FIPS, 13: "Dona Ana"}
    places = table(spark, sf_dir, "supplier").select(
        "s_suppkey", recode("s_nationkey", spelled).alias("County")
    )
    lines = table(spark, sf_dir, "lineitem").join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    return (
        lines.groupBy(F.col("l_shipdate").cast("date").alias("day"), "County")
        .agg(
            (F.sum(cents("l_discount")) / F.lit(100.0)).alias("smokepm25"),
            F.sum(F.col("l_quantity").cast("long")).cast("double").alias("totalpm25"),
        )
        .select(F.col("day").cast("string").alias("Date"), "County", "smokepm25", "totalpm25")
    )


def smoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_smoke(smoke_raw(spark, sf_dir))


def heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """County-day heat index on other days than the smoke panel."""
    places = table(spark, sf_dir, "customer").select(
        "c_custkey", recode("c_nationkey", COUNTY_FIPS).alias("County")
    )
    return (
        table(spark, sf_dir, "orders")
        .join(places, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("o_orderdate").cast("date").alias("Date"), "County")
        .agg((F.sum(cents("o_totalprice")) / F.lit(100.0)).alias("HeatIndex"))
    )


def month_heads() -> list[str]:
    """Epoch day of the first of every month the tables can hold."""
    epoch = dt.date(1970, 1, 1)
    return [str((dt.date(y, m, 1) - epoch).days) for y in range(1992, 2006) for m in range(1, 13)]


def heat_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat index with one column per month, headed by epoch days, and one stray column."""
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")
    )
    month = F.unix_date(F.trunc(F.col("l_shipdate").cast("date"), "MM")).cast("string")
    cells = lines.groupBy((F.col("s_nationkey") + 35000).alias("county"), month.alias("head")).agg(
        (F.sum(cents("l_tax")) / F.lit(100.0)).alias("v")
    )
    return (
        cells.groupBy("county")
        .pivot("head", month_heads())
        .agg(F.max("v"))
        .withColumn("note", F.lit(1.0))
    )


def multi_flag_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per episode with several flags; unset flags are NULL."""
    return orders_with_customer(spark, sf_dir).select(
        F.col("o_orderkey").cast("string").alias("hfdrepisode"),
        recode("c_nationkey", COUNTY_FIPS).alias("county"),
        "Date",
        *[F.when(F.expr(rule), 1).alias(c) for c, rule in FLAG_RULES.items()],
    )


def monitor_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily monitor table in its exported layout."""
    return orders_with_customer(spark, sf_dir).select(
        F.col("o_orderpriority").alias("parameter_code"),
        F.col("c_nationkey").alias("state_code"),
        F.col("c_mktsegment").alias("county_code"),
        F.col("o_custkey").cast("string").alias("site_number"),
        F.col("o_orderstatus").alias("pollutant_standard"),
        (-F.col("c_acctbal")).alias("longitude"),
        F.col("c_acctbal").alias("latitude"),
        F.col("Date").alias("date_local"),
        F.col("o_totalprice").alias("arithmetic_mean"),
    )


# --------------------------------------------------------------------------
# the same views as SQL
# --------------------------------------------------------------------------

FIPS_SQL = "(VALUES " + ", ".join(f"({c}, '{n}')" for c, n in COUNTY_FIPS.items()) + ")"

_SUMS = ", ".join(
    f"count(*) FILTER (WHERE {RULES[src]}) AS {dx}" for src, dx in OUTCOME_SOURCES.items()
)
_RESUMS = ", ".join(f"CAST(sum({dx}) AS BIGINT) AS {dx}" for dx in OUTCOMES)
_LIST = ", ".join(f"{{'ord': {i}, 'dx': '{dx}', 'n': {dx}}}" for i, dx in enumerate(OUTCOMES))

_HITS = ", ".join(
    f"{{'ord': {i}, 'dx': '{dx}', 'hit': {RULES[src]}}}"
    for i, (src, dx) in enumerate(OUTCOME_SOURCES.items())
)

SQL = {
    "fips": f"fips(code, name) AS (SELECT * FROM {FIPS_SQL} AS v(code, name))",
    "oc": """oc AS (
        SELECT *, CAST(o_orderdate AS DATE) AS "Date"
        FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "adm": f"""adm AS (
        SELECT a."Date", f.name AS "County", a.* EXCLUDE ("Date", code) FROM (
            SELECT "Date", c_nationkey AS code, count(*) AS "Total_Cases", {_SUMS}
            FROM oc GROUP BY ALL) a LEFT JOIN fips f ON a.code = f.code)""",
    "cells": f"""cells AS (
        SELECT "Date", "County", {_RESUMS} FROM adm GROUP BY "Date", "County")""",
    "eplong": f"""eplong AS (
        SELECT "Date", "County", o.ord AS ord, o.dx AS dx, o.n AS n
        FROM (SELECT "Date", "County", unnest([{_LIST}]) AS o FROM cells))""",
    "ep": """ep AS (
        SELECT "Date", "County", dx, substr(dx, 1, 4) || ' ' || row_number() OVER (
            ORDER BY "Date" NULLS LAST, "County" NULLS LAST, ord, k) AS "Patient_ID"
        FROM eplong, unnest(range(1, 1 + n)) AS t(k))""",
    "epfile": f"""ep AS (
        SELECT "Date", "County", o.dx AS dx, substr(o.dx, 1, 4) || ' ' || row_number() OVER (
            ORDER BY o_orderkey, o.ord) AS "Patient_ID"
        FROM (SELECT "Date", name AS "County", o_orderkey, unnest([{_HITS}]) AS o
              FROM oc LEFT JOIN fips ON code = c_nationkey)
        WHERE o.hit)""",
    "pm": """pm AS (
        SELECT CAST(l_shipdate AS DATE) AS "Date", f.name AS "County",
               CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / 100 AS smokepm25,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS totalpm25
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        LEFT JOIN fips f ON f.code = s_nationkey GROUP BY ALL)""",
    "heat": """heat AS (
        SELECT "Date", f.name AS "County",
               CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS "HeatIndex"
        FROM oc LEFT JOIN fips f ON f.code = c_nationkey GROUP BY ALL)""",
    "expo": """expo AS (
        SELECT pm."Date", pm."County", smokepm25, totalpm25, "HeatIndex" FROM pm LEFT JOIN heat
        ON pm."Date" IS NOT DISTINCT FROM heat."Date"
        AND pm."County" IS NOT DISTINCT FROM heat."County")""",
}


def lag_sql(variables, n: int, partition: str = '"County"', order: str = '"Date"') -> str:
    return ", ".join(
        f'lag({v}, {k}) OVER (PARTITION BY {partition} ORDER BY {order}) AS "{v.strip(chr(34))}_lag{k}"'
        for v in variables for k in range(1, n + 1)
    )


def ctes(*names: str, extra: str = "") -> str:
    parts = [SQL[n] for n in names]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n"


PANEL_SQL = (
    "panel AS (SELECT *, "
    + lag_sql(["smokepm25", "totalpm25", '"HeatIndex"'], 5)
    + " FROM expo)"
)
