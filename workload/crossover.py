"""The case-crossover pipelines end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataday.functions import quarter_text, zero_if_null
from strataday.operators import map_columns, union_by_name
from strataday.plans import (
    add_referents, attach_exposure, build_episodes, case_crossover, case_crossover_from_cases,
    case_crossover_tables, cross_cases, exposure_panel, full_dataset, outcome_dataset, outcome_tables,
    strata_tables, study_cases, tables_by_outcome, widen_episodes,
)
from strataday.schemas import (
    FIRE_APR_AUG, FIRE_APR_SEP, MULTI_FLAG_LABELS, MULTI_FLAGS, OUTCOMES,
)

from strataday.sources import read_outcome_tables, scratch_path, write_outcome_tables

from .registry import ORACLES, query
from .views import (
    FLAG_RULES, PANEL_SQL, START, admission_rows, admissions, ctes, heat, multi_flag_cases,
    orders_with_customer, smoke,
)

_EXPOSED = ["smokepm25", "totalpm25", '"HeatIndex"']
_LAGGED = [
    *_EXPOSED, *[f'"{v.strip(chr(34))}_lag{k}"' for v in _EXPOSED for k in range(1, 6)]
]
_PM_LAGGED = [
    "smokepm25", "totalpm25",
    *[f"{v}_lag{k}" for v in ("smokepm25", "totalpm25") for k in range(1, 6)],
]


def _crossed_sql(months) -> str:
    """Cases and referents of the episodes, ``w`` = 0 for the case itself."""
    return f"""crossed AS (
        SELECT * FROM (
            SELECT "Date" + 7 * CAST(w AS INTEGER) AS "Date", strftime("Date", '%Y') AS "Year",
                   strftime("Date", '%m') AS "Month", "County", "Patient_ID", dx, w
            FROM ep, generate_series(-26, 26) AS g(w)
            WHERE month("Date") IN {tuple(months)} AND "Date" > DATE '1995-01-01')
        WHERE month("Date") IN {tuple(months)} AND "Date" > DATE '1995-01-01')"""


def _flag(c: str) -> str:
    return f"CASE WHEN w = 0 AND dx = '{c}' THEN 1 ELSE 0 END"


_EP = ("fips", "oc", "adm", "cells", "eplong", "ep")
_ALL = (*_EP, "pm", "heat", "expo")
_FLAGS = ", ".join(f"{_flag(c)} AS {c}" for c in OUTCOMES)
_FULL_JOIN = """ FROM crossed c LEFT JOIN panel p ON p."Date" IS NOT DISTINCT FROM c."Date"
        AND p."County" IS NOT DISTINCT FROM c."County" """
_HEAD = 'c."Date", c."Year", c."Month", c."County", c."Patient_ID"'


@query("case_referent_union", sql=ctes(*_EP, extra=_crossed_sql(FIRE_APR_SEP)) + f"""
    SELECT "Date", "Year", "Month", "County", "Patient_ID", {_FLAGS} FROM crossed""")
def q_case_referent_union(spark, sf):
    return full_dataset(admissions(spark, sf), None, start=START)


@query("case_referent_union_steps", sql=ORACLES["case_referent_union"])
def q_case_referent_union_steps(spark, sf):
    """The same from episode rows, step by step."""
    episodes = widen_episodes(build_episodes(admissions(spark, sf)))
    cases = study_cases(episodes, FIRE_APR_SEP, START)
    referents = add_referents(
        cases.select("Date", "Year", "Month", "County", "Patient_ID"), start=START
    )
    return case_crossover(cases, referents)


@query("full_dataset", sql=ctes(*_ALL, extra=PANEL_SQL + ",\n" + _crossed_sql(FIRE_APR_SEP)) + f"""
    SELECT {_HEAD}, {_FLAGS}, {", ".join(_LAGGED)} {_FULL_JOIN}""")
def q_full_dataset(spark, sf):
    panel = exposure_panel(smoke(spark, sf), heat(spark, sf))
    return full_dataset(admissions(spark, sf), panel, start=START)


# strata by their definition: both outcome values occur under the ID
_STRATA = """, strata AS (
        SELECT "Patient_ID" AS id FROM crossed GROUP BY 1
        HAVING count(DISTINCT CASE WHEN w = 0 THEN 1 ELSE 0 END) = 2)"""


def _tables_sql(months, exposures, *names: str, extra: str) -> str:
    return ctes(*names, extra=extra + ",\n" + _crossed_sql(months)) + _STRATA + f"""
    SELECT {_HEAD}, CASE WHEN w = 0 THEN 1 ELSE 0 END AS outcome, {", ".join(exposures)},
           replace(dx, '_dx', '') AS out_name {_FULL_JOIN}
    WHERE c."Patient_ID" IN (SELECT id FROM strata)"""


@query("casecross_all", sql=_tables_sql(FIRE_APR_SEP, _LAGGED, *_ALL, extra=PANEL_SQL))
def q_casecross_all(spark, sf):
    panel = exposure_panel(smoke(spark, sf), heat(spark, sf))
    return case_crossover_tables(admissions(spark, sf), panel, start=START)


_PM_PANEL_SQL = PANEL_SQL[: PANEL_SQL.index(', lag("HeatIndex"')] + " FROM pm)"


@query("casecross_apr_aug", sql=_tables_sql(
    FIRE_APR_AUG, _PM_LAGGED, *_EP, "pm", extra=_PM_PANEL_SQL))
def q_casecross_apr_aug(spark, sf):
    panel = exposure_panel(smoke(spark, sf))
    return case_crossover_tables(admissions(spark, sf), panel, months=FIRE_APR_AUG, start=START)


@query("casecross_file_order", sql=_tables_sql(
    FIRE_APR_AUG, _PM_LAGGED, "fips", "oc", "epfile", "pm", extra=_PM_PANEL_SQL))
def q_casecross_file_order(spark, sf):
    return case_crossover_tables(
        admission_rows(spark, sf), exposure_panel(smoke(spark, sf)), months=FIRE_APR_AUG,
        start=START, file_order="o_orderkey",
    )


_OTHERS = ", ".join(
    f"{_flag(c)} AS {'outcome' if c == 'asthma_dx' else c}" for c in OUTCOMES
)


@query("casecross_asthma", sql=ctes(
    *_ALL, extra=PANEL_SQL + ",\n" + _crossed_sql(FIRE_APR_SEP)) + _STRATA + f"""
    SELECT {_HEAD}, {_OTHERS}, {", ".join(_LAGGED)}, 'asthma' AS out_name {_FULL_JOIN}
    WHERE dx = 'asthma_dx' AND c."Patient_ID" IN (SELECT id FROM strata)""")
def q_casecross_asthma(spark, sf):
    panel = exposure_panel(smoke(spark, sf), heat(spark, sf))
    return outcome_dataset(admissions(spark, sf), panel, "asthma_dx", start=START)


_OWN = ", ".join(f"CASE WHEN dx <> '{c}' THEN 0 END AS {c}" for c in OUTCOMES)


@query("outcome_tables_all", sql=ctes(
    *_ALL, extra=PANEL_SQL + ",\n" + _crossed_sql(FIRE_APR_SEP)) + _STRATA + f"""
    SELECT {_HEAD}, {_OWN}, {", ".join(_LAGGED)}, CASE WHEN w = 0 THEN 1 ELSE 0 END AS outcome,
           replace(dx, '_dx', '') AS out_name {_FULL_JOIN}
    WHERE c."Patient_ID" IN (SELECT id FROM strata)""")
def q_outcome_tables_all(spark, sf):
    """All twelve tables written at once and read one by one, each in its layout of 36 columns."""
    panel = exposure_panel(smoke(spark, sf), heat(spark, sf))
    long = outcome_tables(admissions(spark, sf), panel, start=START)
    path = write_outcome_tables(long, scratch_path(spark, "outcome-tables"), "apr-sep")
    return union_by_name(*tables_by_outcome(read_outcome_tables(spark, path)).values())


_MULTI = ", ".join(
    f"CASE WHEN w = 0 AND {rule} THEN 1 ELSE 0 END AS {c}" for c, rule in FLAG_RULES.items()
)


@query("casecross_multi_flag", sql=ctes("fips", "oc", "pm") + f""",
    crossed AS (
        SELECT * EXCLUDE (d) FROM (
            SELECT CAST(o_orderkey AS VARCHAR) AS hfdrepisode, f.name AS county, "Date" AS d,
                   "Date" + 7 * CAST(w AS INTEGER) AS "Date", {_MULTI}
            FROM oc LEFT JOIN fips f ON f.code = c_nationkey, generate_series(-26, 26) AS g(w)
            WHERE month("Date") BETWEEN 4 AND 8 AND "Date" > DATE '1995-01-01')
        WHERE month("Date") BETWEEN 4 AND 8 AND "Date" > DATE '1995-01-01'),
    full_rows AS (
        SELECT c.*, 'Q' || quarter(c."Date") AS quarter, smokepm25, totalpm25 FROM crossed c
        LEFT JOIN pm ON pm."Date" = c."Date" AND pm."County" IS NOT DISTINCT FROM c.county)
    """ + " UNION ALL ".join(f"""
    SELECT *, {flag} AS outcome, '{label}' AS out_name FROM full_rows WHERE hfdrepisode IN (
        SELECT hfdrepisode FROM full_rows GROUP BY 1 HAVING count(DISTINCT {flag}) = 2)"""
        for flag, label in MULTI_FLAG_LABELS.items()))
def q_casecross_multi_flag(spark, sf):
    panel = smoke(spark, sf).withColumnRenamed("County", "county").withColumn(
        "quarter", quarter_text("Date")
    )
    return case_crossover_from_cases(
        multi_flag_cases(spark, sf), panel, MULTI_FLAGS, MULTI_FLAG_LABELS, "hfdrepisode",
        keys=("county", "Date", "quarter"), derived={"quarter": quarter_text("Date")},
        months=FIRE_APR_AUG, start=START, unique_ids=True,
    )


@query("casecross_multi_flag_steps", sql=ORACLES["casecross_multi_flag"])
def q_casecross_multi_flag_steps(spark, sf):
    cases = study_cases(multi_flag_cases(spark, sf), FIRE_APR_AUG, START)
    rows = cross_cases(cases, MULTI_FLAGS, months=FIRE_APR_AUG, start=START).withColumn(
        "quarter", quarter_text("Date")
    )
    panel = smoke(spark, sf).withColumnRenamed("County", "county").withColumn(
        "quarter", quarter_text("Date")
    )
    full = attach_exposure(rows, panel, ("county", "Date", "quarter"))
    return strata_tables(full, MULTI_FLAG_LABELS, "hfdrepisode")


@query("fill_flags", sql=ctes("fips", "oc") + f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS hfdrepisode, name AS county, "Date",
           {", ".join(f"CASE WHEN {rule} THEN 1 ELSE 0 END AS {c}" for c, rule in FLAG_RULES.items())}
    FROM oc LEFT JOIN fips ON code = c_nationkey""")
def q_fill_flags(spark, sf):
    return map_columns(multi_flag_cases(spark, sf), MULTI_FLAGS, zero_if_null)


_STRATA_FLAGS = ", ".join(f"CASE WHEN {FLAG_RULES[c]} THEN 1 ELSE 0 END AS {c}" for c in MULTI_FLAG_LABELS)


@query("informative_strata", sql=ctes("fips", "oc") + f""",
    flags AS (SELECT c_custkey AS id, o_orderkey, {_STRATA_FLAGS} FROM oc)
    """ + " UNION ALL ".join(f"""
    SELECT *, {flag} AS outcome, '{label}' AS out_name FROM flags WHERE id IN (
        SELECT id FROM flags GROUP BY id HAVING count(DISTINCT {flag}) = 2)"""
        for flag, label in MULTI_FLAG_LABELS.items()))
def q_informative_strata(spark, sf):
    flagged = orders_with_customer(spark, sf).select(
        F.col("c_custkey").alias("id"), "o_orderkey",
        *[F.when(F.expr(FLAG_RULES[c]), 1).otherwise(0).alias(c) for c in MULTI_FLAG_LABELS],
    )
    return strata_tables(flagged, MULTI_FLAG_LABELS, "id")
