"""Behaviour that is easy to get wrong and has no other test of its own."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from strataday.operators import arrange, keep_first, left_join, outcome_table
from strataday.plans import (
    build_episodes, case_crossover_tables, clean_admissions, exposure_panel, full_dataset,
    strata_tables, study_cases,
)
from strataday.schemas import FIRE_APR_SEP, OUTCOME_SOURCES, OUTCOMES
from strataday.sources import scratch_path, write_csv

D = dt.date


def counts(spark, *cells):
    """cells: (date, county, {outcome: n})"""
    data = [(d, c, *[n.get(o, 0) for o in OUTCOMES]) for d, c, n in cells]
    return spark.createDataFrame(
        data, "Date date, County string, " + ", ".join(f"{o} int" for o in OUTCOMES)
    )


def test_first_day_of_the_season_has_lags_from_before_it(spark):
    panel = exposure_panel(spark.createDataFrame(
        [(D(2022, 3, 31), "Taos", 7.0), (D(2022, 4, 1), "Taos", 8.0)],
        "Date date, County string, smokepm25 double",
    ), lags=1)
    out = case_crossover_tables(counts(spark, (D(2022, 4, 1), "Taos", {"asthma_dx": 1})), panel)
    row = out.where("outcome = 1").first()
    assert (row["Date"], row["smokepm25"], row["smokepm25_lag1"]) == (D(2022, 4, 1), 8.0, 7.0)


def test_ids_are_not_renumbered_by_the_season(spark):
    adm = counts(
        spark, (D(2022, 1, 5), "Taos", {"asthma_dx": 4}), (D(2022, 5, 4), "Taos", {"asthma_dx": 1})
    )
    kept = study_cases(build_episodes(adm), FIRE_APR_SEP)
    assert [r["Patient_ID"] for r in kept.collect()] == ["asth 5"]


def test_shared_prefix_keeps_ids_apart(spark):
    adm = counts(spark, (D(2022, 5, 4), "Taos", {"cardiovascular_dx": 1, "cardiacarrest_dx": 1}))
    got = {(r["Primary_dx"], r["Patient_ID"]) for r in build_episodes(adm).collect()}
    assert got == {("cardiovascular_dx", "card 1"), ("cardiacarrest_dx", "card 2")}


def test_one_admission_in_two_columns_is_two_episodes(spark):
    adm = counts(spark, (D(2022, 5, 4), "Taos", {"respiratory_dx": 1, "asthma_dx": 1}))
    assert build_episodes(adm).select("Patient_ID").distinct().count() == 2


def test_total_is_kept_when_cleaning_and_dropped_from_episodes(spark):
    raw = spark.createDataFrame(
        [("04MAY2022", 55, "x", 9, *[1] * 12)],
        "Admission_Date string, Patient_Resi_County_FIPS_Cd int, r string, n int, "
        + ", ".join(f"{c} int" for c in OUTCOME_SOURCES),
    )
    clean = clean_admissions(raw)
    assert clean.first()["Total_Cases"] == 9
    episodes = build_episodes(clean)
    assert episodes.columns == ["Date", "County", "Primary_dx", "Episode", "Patient_ID"]
    assert episodes.count() == 12


def test_season_months_of_the_variants_differ_in_september(spark):
    panel = exposure_panel(spark.createDataFrame([], "Date date, County string, smokepm25 double"))
    adm = counts(spark, (D(2022, 9, 7), "Taos", {"asthma_dx": 1}))
    assert case_crossover_tables(adm, panel).count() == 26
    assert case_crossover_tables(adm, panel, months=(4, 5, 6, 7, 8)).count() == 0


def test_sort_order_is_a_choice_of_the_sink(spark):
    df = spark.createDataFrame(
        [("b", D(2022, 1, 1)), ("a", D(2022, 1, 2)), (None, D(2022, 1, 1))], "County string, Date date"
    )
    by_date = [tuple(r) for r in arrange(df, "Date", "County").collect()]
    by_county = [tuple(r) for r in arrange(df, "County", "Date").collect()]
    assert by_date == [("b", D(2022, 1, 1)), (None, D(2022, 1, 1)), ("a", D(2022, 1, 2))]
    assert by_county == [("a", D(2022, 1, 2)), ("b", D(2022, 1, 1)), (None, D(2022, 1, 1))]
    path = scratch_path(spark, "t")
    write_csv(df.coalesce(1), path, sort=("County", "Date"))
    lines = spark.read.text(path).where(F.col("value") != "County,Date")
    assert sorted(r[0] for r in lines.collect()) == ["NA,2022-01-01", "a,2022-01-02", "b,2022-01-01"]


def test_variables_may_have_dots_in_their_names(spark):
    name = "ARITHMETIC.MEAN"
    panel = spark.createDataFrame(
        [(D(2022, 5, 3), "Taos", 1.0), (D(2022, 5, 4), "Taos", 2.0)], ["Date", "County", name]
    ).withColumn("Date", F.to_date("Date"))
    for mode, on_dup in (("row", "error"), ("row", "keep"), ("calendar", "error"), ("calendar", "keep")):
        lagged = exposure_panel(panel, lags=1, mode=mode, on_dup=on_dup)
        got = {r["Date"]: (r[name], r[f"{name}_lag1"]) for r in lagged.collect()}
        assert got == {D(2022, 5, 3): (1.0, None), D(2022, 5, 4): (2.0, 1.0)}
    out = case_crossover_tables(counts(spark, (D(2022, 5, 4), "Taos", {"asthma_dx": 1})), lagged)
    row = out.where("outcome = 1").first()
    assert (row[name], row[f"{name}_lag1"]) == (2.0, 1.0)
    strata = strata_tables(
        full_dataset(counts(spark, (D(2022, 5, 4), "Taos", {"asthma_dx": 1})), lagged)
    )
    assert outcome_table(strata, "asthma_dx", "asthma").where("outcome = 1").first()[name] == 2.0
    joined = left_join(panel, panel.withColumnRenamed(name, "B.C"), ["Date", "County"], on_dup="error")
    assert joined.columns == ["Date", "County", name, "B.C"] and joined.count() == 2
    assert keep_first(panel, ["County"], ["Date"]).first()[name] == 1.0


def test_calendar_lags_of_a_missing_date_are_null(spark):
    from strataday.operators.lags import add_calendar_lags

    df = spark.createDataFrame(
        [("2020-01-01", "A", 1.0), ("2020-01-02", "A", 2.0), (None, "A", 99.0)], "d string, County string, pm double"
    ).selectExpr("cast(d as date) AS Date", "County", "pm")
    for mode in ("error", "keep"):
        got = {str(r.Date): (r.pm, r[3], r[4]) for r in add_calendar_lags(df, ["pm"], 2, on_dup=mode).collect()}
        assert got == {"2020-01-01": (1.0, None, None), "2020-01-02": (2.0, 1.0, None), "None": (99.0, None, None)}


def test_outcome_table_without_the_flag_keeps_outcome(spark):
    from strataday.operators.groups import outcome_table

    df = spark.createDataFrame([(1, 0, "asthma"), (2, 1, "other")], "id int, outcome int, out_name string")
    got = outcome_table(df, "asthma_flag", "asthma")
    assert got.columns == ["id", "outcome", "out_name"] and [tuple(r) for r in got.collect()] == [(1, 0, "asthma")]
