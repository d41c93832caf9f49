from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from . import brute
from strataday.operators import outcome_table
from strataday.plans import (
    add_referents, annual_summary, attach_exposure, build_episodes, case_crossover,
    case_crossover_from_cases, case_crossover_tables, clean_admissions, clean_heat, clean_smoke,
    cross_cases, exposure_panel, facet_series, full_dataset, has_referent, outcome_dataset, outcome_tables,
    strata_tables,
    study_cases, tables_by_outcome, widen_episodes, yearly_scatter,
)
from strataday.functions import quarter_text
from strataday.schemas import (
    EXPOSURES, FACET_ORDER, FIRE_APR_AUG, FIRE_APR_SEP, OFF_SEASON, OUTCOME_SOURCES, OUTCOMES,
    OUTPUT_ORDER, STUDY_START, output_name,
)

D = dt.date
SHORT = ["respiratory_dx", "cardiovascular_dx", "cardiacarrest_dx"]


def admissions_frame(spark, cells, outcomes):
    data = [(d, c, *[n.get(o, 0) for o in outcomes]) for (d, c), n in cells.items()]
    return spark.createDataFrame(
        data, "Date date, County string, " + ", ".join(f"{o} int" for o in outcomes)
    )


def panel_frames(spark, panel):
    pm = [(d, c, v["smokepm25"], v["totalpm25"]) for (d, c), v in panel.items()]
    heat = [(d, c, v["HeatIndex"]) for (d, c), v in panel.items() if v["HeatIndex"] is not None]
    return (
        spark.createDataFrame(pm, "Date date, County string, smokepm25 double, totalpm25 double"),
        spark.createDataFrame(heat, "Date date, County string, HeatIndex double"),
    )


def random_study(seed, outcomes, days=400, start=D(2020, 3, 1), n_cells=25):
    rng = random.Random(seed)
    counties = ["Taos", "Doña Ana", None]
    cells = {}
    for _ in range(n_cells):
        key = (start + dt.timedelta(days=rng.randrange(days)), rng.choice(counties))
        cells[key] = {o: rng.choice([0, 0, 1, 2, 5]) for o in outcomes}
    cells[None, "Taos"] = {outcomes[0]: 2}
    panel = {
        (start + dt.timedelta(days=i), c): {
            "smokepm25": rng.random(), "totalpm25": rng.random(),
            "HeatIndex": rng.random() if rng.random() > 0.3 else None,
        }
        for i in range(days) for c in counties if rng.random() > 0.2
    }
    return cells, panel


def as_set(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


# --- admissions -----------------------------------------------------------


def raw_admissions(spark):
    columns = ["Admission_Date", "Patient_Resi_County_FIPS_Cd", "Region", "All_Cases", *OUTCOME_SOURCES]
    zeros = [0] * 12
    data = [
        ("15APR2022", 13, "S", 3, 2, 1, *zeros[:3], 1, *zeros[:6]),
        ("01JAN2016", 6, "N", 1, *zeros),
        ("31FEB2016", 28, "N", 1, 1, *zeros[:11]),
        ("30SEP2020", 2, "X", 0, *zeros),
        ("01OCT2020", None, "X", 0, *zeros),
    ]
    types = ["string", "int", "string", "int", *["int"] * 12]
    return spark.createDataFrame(data, ", ".join(f"{c} {t}" for c, t in zip(columns, types)))


def test_clean_admissions(spark):
    df = clean_admissions(raw_admissions(spark))
    assert df.columns == ["Date", "County", "Total_Cases", *OUTCOMES]
    assert {tuple(r)[:3] for r in df.collect()} == {
        (D(2022, 4, 15), "Doña Ana", 3), (D(2016, 1, 1), "Cibola", 1), (None, "Los Alamos", 1),
        (D(2020, 9, 30), None, 0), (D(2020, 10, 1), None, 0),
    }


def test_clean_admissions_keeps_a_typed_date(spark):
    raw = raw_admissions(spark).withColumn("Admission_Date", F.lit(D(2022, 4, 15)))
    assert clean_admissions(raw).select("Date").distinct().first()[0] == D(2022, 4, 15)


def test_annual_summary(spark):
    df = spark.createDataFrame(
        [(D(2016, 5, 1), 1, 2), (D(2016, 6, 1), 3, None), (D(2017, 1, 1), 5, 6), (None, 7, 8)],
        "Date date, a int, b int",
    )
    assert as_set(annual_summary(df, ["a", "b"])) == {("2016", 4, None), ("2017", 5, 6), (None, 7, 8)}
    assert annual_summary(clean_admissions(raw_admissions(spark))).columns == ["Year", *FACET_ORDER]


def test_facet_series_is_one_point_per_row(spark):
    out = facet_series(clean_admissions(raw_admissions(spark)))
    assert out.count() == 5 * 12
    order = {r["Primary_dx"]: r["facet_ord"] for r in out.collect()}
    assert [order[c] for c in FACET_ORDER] == list(range(1, 13))


def test_yearly_scatter(spark):
    df = spark.createDataFrame([(D(2016, 5, 1), "Taos", 1.5)], "Date date, County string, smokepm25 double")
    assert tuple(yearly_scatter(df).first()) == ("2016", "05", D(2016, 5, 1), "Taos", 1.5)


# --- episodes -------------------------------------------------------------


def test_example_day_gives_four_episodes(spark):
    df = clean_admissions(raw_admissions(spark)).where("Date = '2022-04-15'")
    got = sorted(tuple(r) for r in build_episodes(df).collect())
    day, county = D(2022, 4, 15), "Doña Ana"
    assert got == [
        (day, county, "asthma_dx", 1, "asth 3"), (day, county, "cardiovascular_dx", 1, "card 4"),
        (day, county, "respiratory_dx", 1, "resp 1"), (day, county, "respiratory_dx", 1, "resp 2"),
    ]


@pytest.mark.parametrize("size", [2, 1000])
def test_episodes_match_brute_force(spark, size):
    cells, _ = random_study(3, SHORT)
    got = build_episodes(admissions_frame(spark, cells, SHORT), SHORT, size)
    want = brute.episodes(cells, SHORT)
    assert as_set(got.drop("Episode")) == set(want)
    numbers = sorted(int(pid.split()[1]) for *_, pid in want)
    assert numbers == list(range(1, sum(sum(n.values()) for n in cells.values()) + 1))


def test_repeated_county_day_rows_number_like_one(spark):
    cells = {(D(2022, 4, 1), "Taos"): {SHORT[0]: 5}, (D(2022, 4, 2), "Taos"): {SHORT[0]: 1}}
    split = spark.createDataFrame(
        [(D(2022, 4, 1), "Taos", 2, 0, 0), (D(2022, 4, 1), "Taos", 3, 0, 0), (D(2022, 4, 2), "Taos", 1, 0, 0)],
        "Date date, County string, " + ", ".join(f"{o} int" for o in SHORT),
    )
    assert as_set(build_episodes(split, SHORT).drop("Episode")) == set(brute.episodes(cells, SHORT))


def test_numbering_in_file_order(spark):
    data = [(3, D(2022, 4, 1), "Taos", 1, 0, 2), (1, D(2022, 4, 9), "Taos", 2, 1, 0), (2, None, None, 0, 0, 1)]
    df = spark.createDataFrame(
        data, "pos long, Date date, County string, " + ", ".join(f"{o} int" for o in SHORT)
    )
    got = {(r["Date"], r["Patient_ID"]) for r in build_episodes(df, SHORT, file_order="pos").collect()}
    assert got == {
        (D(2022, 4, 9), "resp 1"), (D(2022, 4, 9), "resp 2"), (D(2022, 4, 9), "card 3"), (None, "card 4"),
        (D(2022, 4, 1), "resp 5"), (D(2022, 4, 1), "card 6"), (D(2022, 4, 1), "card 7"),
    }
    panel = spark.createDataFrame([], "Date date, County string, smokepm25 double")
    out = case_crossover_tables(df, panel, SHORT, file_order="pos")
    assert {r[0] for r in out.select("Patient_ID").collect()} == {pid for d, pid in got if d}


def test_sparse_positions_number_like_dense_ones(spark):
    data = [(k, D(2022, 4, 1), "Taos", k % 3, 1, 0) for k in range(1000)]
    df = spark.createDataFrame(data, "pos long, Date date, County string, " + ", ".join(f"{o} int" for o in SHORT))
    apart = df.withColumn("pos", F.col("pos") * 2_000_000)
    ids = lambda d: sorted(map(str, build_episodes(d, SHORT, file_order="pos").collect()))
    assert ids(apart) == ids(df)
    with pytest.raises(Exception, match="must be unique"):
        build_episodes(df.unionAll(df.limit(1)), SHORT, file_order="pos").collect()


def test_all_tables_with_all_flags(spark):
    cells, panel = random_study(31, SHORT)
    smoke, heat = panel_frames(spark, panel)
    adm, exposure = admissions_frame(spark, cells, SHORT), exposure_panel(smoke, heat)
    long = outcome_tables(adm, exposure, SHORT, start=D(2020, 3, 15))
    plain = case_crossover_tables(adm, exposure, SHORT, start=D(2020, 3, 15))
    assert as_set(long.select(*plain.columns)) == as_set(plain) and long.count() == plain.count()
    for flag, table in tables_by_outcome(long, {c: output_name(c) for c in SHORT}).items():
        want = outcome_dataset(adm, exposure, f"{flag}_dx", SHORT, start=D(2020, 3, 15))
        assert table.columns == want.columns and as_set(table) == as_set(want)


def test_file_order_tables_equal_ordered_tables_up_to_ids(spark):
    cells, panel = random_study(23, SHORT, n_cells=12)
    smoke, heat = panel_frames(spark, panel)
    adm, exposure = admissions_frame(spark, cells, SHORT), exposure_panel(smoke, heat)
    # every county-day split over two source rows
    halves = [F.floor(F.col(o) / 2).cast("int").alias(o) for o in SHORT]
    rest = [(F.col(o) - F.floor(F.col(o) / 2)).cast("int").alias(o) for o in SHORT]
    rows = adm.select("Date", "County", *halves, F.lit(0).alias("half")).unionByName(
        adm.select("Date", "County", *rest, F.lit(1).alias("half")))
    rows = rows.withColumn("pos", F.xxhash64("Date", "County", "half") % 1_000_000_000).drop("half")
    kinds = lambda df: sorted(map(str, df.drop("Patient_ID").collect()))
    for size in (2, 1000):
        ordered = case_crossover_tables(adm, exposure, SHORT)
        by_file = case_crossover_tables(rows, exposure, SHORT, file_order="pos", size=size)
        assert by_file.columns == ordered.columns
        assert kinds(by_file) == kinds(ordered)
        ids = by_file.where("outcome = 1").select("Patient_ID")
        assert ids.distinct().count() == ids.count()


def test_null_count_is_rejected(spark):
    df = spark.createDataFrame(
        [(D(2022, 4, 1), "Taos", None, 0, 0)],
        "Date date, County string, " + ", ".join(f"{o} int" for o in SHORT),
    )
    with pytest.raises(Exception, match="counts must be non-negative"):
        build_episodes(df, SHORT).collect()


def test_widen_episodes(spark):
    cells, _ = random_study(4, SHORT)
    wide = widen_episodes(build_episodes(admissions_frame(spark, cells, SHORT), SHORT), SHORT, True)
    assert wide.columns == ["Date", "Year", "Month", "County", "Patient_ID", "Prim_dx", *SHORT]
    for r in wide.collect():
        assert sum(r[o] for o in SHORT) == 1 and r["Patient_ID"].startswith(r["Prim_dx"] + " ")
        assert r["Year"] == (f"{r['Date']:%Y}" if r["Date"] else None)
    assert wide.select("Patient_ID").distinct().count() == wide.count()


# --- referents ------------------------------------------------------------


@pytest.mark.parametrize("months,sizes", [(FIRE_APR_SEP, {25, 26}), (FIRE_APR_AUG, {20, 21})])
def test_fire_season_referents_are_the_other_same_weekdays(spark, months, sizes):
    days = [D(2016, 1, 2) + dt.timedelta(days=i) for i in range(2556)]
    cases = spark.createDataFrame([(d,) for d in days if d.month in months], "Date date").withColumn(
        "case", F.col("Date")
    )
    out = add_referents(cases, months=months)
    got = {}
    for r in out.collect():
        got.setdefault(r["case"], set()).add(r["Date"])
    for day in days:
        if day.month in months:
            assert got[day] == {
                d for d in days
                if d.year == day.year and d.month in months and d.weekday() == day.weekday() and d != day
            }
    assert {len(v) for v in got.values()} == sizes


def test_referents_keep_or_recompute_the_calendar(spark):
    case = spark.createDataFrame([(D(2016, 12, 30), "2016", "12")], "Date date, Year string, Month string")
    kept = add_referents(case, months=OFF_SEASON)
    assert {(r["Year"], r["Month"]) for r in kept.collect()} == {("2016", "12")}
    moved = add_referents(case, months=OFF_SEASON, recompute_calendar=True)
    assert all(r["Year"] == f"{r['Date']:%Y}" and r["Month"] == f"{r['Date']:%m}" for r in moved.collect())
    assert {r["Year"] for r in moved.collect()} == {"2016", "2017"}


@pytest.mark.parametrize("months,weeks,start", [
    (FIRE_APR_SEP, 26, D(2016, 4, 25)), ((4,), 1, D(2016, 4, 25)), ((2,), 1, D(2016, 2, 20)),
    (OFF_SEASON, 3, D(2016, 10, 30)), ((4,), 0, D(2016, 1, 1)), ((12,), 2, None),
])
def test_has_referent_equals_expansion(spark, months, weeks, start):
    days = spark.sql("select explode(sequence(date'2016-01-01', date'2017-12-31')) as Date")
    days = days.withColumn("case", F.col("Date"))
    found = {r[0] for r in add_referents(days, weeks, months, start).select("case").distinct().collect()}
    assert {r[0] for r in days.where(has_referent("Date", weeks, months, start)).select("case").collect()} == found


def test_study_start_is_exclusive(spark):
    df = spark.createDataFrame([(D(2016, 1, 1),), (D(2016, 1, 2),), (None,)], "Date date")
    assert [r[0] for r in study_cases(df, OFF_SEASON).collect()] == [D(2016, 1, 2)]
    case = spark.createDataFrame([(D(2016, 1, 8),)], "Date date")
    assert add_referents(case, months=OFF_SEASON).where(F.col("Date") <= STUDY_START).count() == 0


def test_case_crossover_union_equals_single_pass(spark):
    cells, _ = random_study(6, SHORT)
    wide = widen_episodes(build_episodes(admissions_frame(spark, cells, SHORT), SHORT), SHORT)
    cases = study_cases(wide)
    refs = add_referents(cases.select("Date", "Year", "Month", "County", "Patient_ID"))
    union = case_crossover(cases, refs, SHORT)
    assert as_set(union) == as_set(cross_cases(cases, SHORT))


# --- exposure -------------------------------------------------------------


def test_clean_smoke_layouts_and_aliases(spark):
    schema = "Date string, County string, smokepm25 double, totalpm25 double"
    ymd = spark.createDataFrame([("2022-04-01", "Dona Ana", 1.0, 2.0), ("bad", None, None, 3.0)], schema)
    assert as_set(clean_smoke(ymd)) == {(D(2022, 4, 1), "Doña Ana", 1.0, 2.0), (None, None, None, 3.0)}
    mdy = spark.createDataFrame([("4/1/2022", "Taos", 1.0, 2.0)], schema)
    assert clean_smoke(mdy, "mdy").first()["Date"] == D(2022, 4, 1)


def test_clean_heat(spark):
    wide = spark.createDataFrame(
        [(1, 35013, 90.5, None), (2, 35002, 80.0, 81.0)], "row int, county int, `16801` double, `16802` double"
    )
    assert as_set(clean_heat(wide, drop=["row"])) == {
        ("Doña Ana", D(2016, 1, 1), 90.5), ("Doña Ana", D(2016, 1, 2), None),
        (None, D(2016, 1, 1), 80.0), (None, D(2016, 1, 2), 81.0),
    }


def test_exposure_panel(spark):
    _, panel = random_study(7, SHORT, days=60)
    smoke, heat = panel_frames(spark, panel)
    out = exposure_panel(smoke, heat)
    assert len(out.columns) == 20
    want = brute.lags(panel, EXPOSURES, 5)
    names = [c for c in out.columns if c not in ("Date", "County")]
    assert {(r["Date"], r["County"]): {n: r[n] for n in names} for r in out.collect()} == want


def test_exposure_panel_with_repeated_days(spark):
    smoke = spark.createDataFrame(
        [(D(2022, 4, 1), "Taos", 1.0, 1), (D(2022, 4, 1), "Taos", 2.0, 2), (D(2022, 5, 2), "Taos", 3.0, 1)],
        "Date date, County string, smokepm25 double, ord int",
    )
    out = exposure_panel(smoke, lags=2, on_dup="keep", ties=["ord"])
    assert as_set(out.select("smokepm25", "smokepm25_lag1", "smokepm25_lag2")) == {
        (1.0, None, None), (2.0, 1.0, None), (3.0, 2.0, 1.0),
    }
    with pytest.raises(Exception, match="duplicate"):
        exposure_panel(smoke.drop("ord"), lags=2).collect()


def test_duplicate_heat_rows_are_rejected(spark):
    smoke = spark.createDataFrame([(D(2022, 4, 1), "Taos", 1.0)], "Date date, County string, smokepm25 double")
    heat = spark.createDataFrame([(D(2022, 4, 1), "Taos", 1.0)] * 2, "Date date, County string, HeatIndex double")
    with pytest.raises(Exception, match="duplicate key"):
        exposure_panel(smoke, heat).collect()


# --- analysis tables ------------------------------------------------------


@pytest.mark.parametrize("seed,months,weeks,size", [
    (11, FIRE_APR_SEP, 26, 1000), (12, FIRE_APR_AUG, 26, 3), (13, OFF_SEASON, 26, 1), (14, (4,), 1, 1000),
    (15, (2,), 5, 2),
])
def test_tables_match_brute_force(spark, seed, months, weeks, size):
    cells, panel = random_study(seed, SHORT)
    smoke, heat = panel_frames(spark, panel)
    start = D(2020, 3, 15)
    got = case_crossover_tables(
        admissions_frame(spark, cells, SHORT), exposure_panel(smoke, heat), SHORT,
        months=months, start=start, weeks=weeks, size=size,
    )
    want = brute.tables(cells, panel, SHORT, months, start, EXPOSURES, weeks=weeks)
    assert want and as_set(got) == set(want)


def test_golden_tables(spark):
    """Two counties, three dates, April only, one week either way; every row by hand."""
    cells = {
        (D(2022, 4, 6), "Taos"): {"asthma_dx": 1},
        (D(2022, 4, 13), "Taos"): {"respiratory_dx": 2},
        (D(2022, 4, 27), "Doña Ana"): {"cerebrovascular_dx": 1},
    }
    panel = spark.createDataFrame(
        [(D(2022, 4, 5), "Taos", 1.0), (D(2022, 4, 6), "Taos", 2.0), (D(2022, 4, 13), "Taos", 3.0),
         (D(2022, 4, 20), "Doña Ana", 4.0)],
        "Date date, County string, smokepm25 double",
    )
    got = case_crossover_tables(
        admissions_frame(spark, cells, OUTCOMES), exposure_panel(panel, lags=1), months=(4,), weeks=1
    )
    a6, a13, a20, a27 = D(2022, 4, 6), D(2022, 4, 13), D(2022, 4, 20), D(2022, 4, 27)
    assert as_set(got) == {
        (a6, "2022", "04", "Taos", "asth 1", 1, 2.0, 1.0, "asthma"),
        (a13, "2022", "04", "Taos", "asth 1", 0, 3.0, 2.0, "asthma"),
        (a13, "2022", "04", "Taos", "resp 2", 1, 3.0, 2.0, "respiratory"),
        (a6, "2022", "04", "Taos", "resp 2", 0, 2.0, 1.0, "respiratory"),
        (a20, "2022", "04", "Taos", "resp 2", 0, None, None, "respiratory"),
        (a13, "2022", "04", "Taos", "resp 3", 1, 3.0, 2.0, "respiratory"),
        (a6, "2022", "04", "Taos", "resp 3", 0, 2.0, 1.0, "respiratory"),
        (a20, "2022", "04", "Taos", "resp 3", 0, None, None, "respiratory"),
        (a27, "2022", "04", "Doña Ana", "cere 4", 1, None, None, "cerebrovascular"),
        (a20, "2022", "04", "Doña Ana", "cere 4", 0, 4.0, None, "cerebrovascular"),
    }


def test_routes_agree(spark):
    cells, panel = random_study(21, OUTCOMES, n_cells=12)
    smoke, heat = panel_frames(spark, panel)
    adm, exposure = admissions_frame(spark, cells, OUTCOMES), exposure_panel(smoke, heat)
    fused = full_dataset(adm, exposure)
    assert len(fused.columns) == 35
    cases = study_cases(widen_episodes(build_episodes(adm)))
    refs = add_referents(cases.select("Date", "Year", "Month", "County", "Patient_ID"))
    steps = attach_exposure(case_crossover(cases, refs), exposure)
    assert as_set(fused) == as_set(steps.select(*fused.columns))
    long = strata_tables(steps)
    shared = [c for c in case_crossover_tables(adm, exposure).columns]
    assert as_set(long.select(*shared)) == as_set(case_crossover_tables(adm, exposure))
    by_name = tables_by_outcome(long)
    assert list(by_name) == OUTPUT_ORDER and all(len(t.columns) == 36 for t in by_name.values())
    one = outcome_dataset(adm, exposure, "asthma_dx")
    assert one.columns == by_name["asthma"].columns
    assert as_set(one) == as_set(by_name["asthma"]) == as_set(outcome_table(long, "asthma_dx", "asthma"))


def test_each_stratum_has_one_case_and_one_table(spark):
    cells, panel = random_study(22, OUTCOMES, n_cells=10)
    smoke, _ = panel_frames(spark, panel)
    out = case_crossover_tables(admissions_frame(spark, cells, OUTCOMES), exposure_panel(smoke))
    per_id = out.groupBy("Patient_ID").agg(
        F.sum("outcome").alias("cases"), F.count("*").alias("n"), F.count_distinct("out_name").alias("tables")
    )
    assert per_id.where("cases <> 1 or n < 2 or tables <> 1").count() == 0


@pytest.mark.parametrize("repeat_ids", [False, True])
def test_case_level_route_equals_steps(spark, repeat_ids):
    rng = random.Random(31)
    flags, labels = ["a", "b", "c"], {"a": "A", "b": "B"}
    data = [
        (f"id{rng.randrange(15) if repeat_ids else i}", rng.choice(["Taos", None]),
         D(2022, 3, 1) + dt.timedelta(days=rng.randrange(60)), *[rng.choice([None, 0, 1]) for _ in flags])
        for i in range(40)
    ]
    cases = spark.createDataFrame(data, "id string, county string, Date date, a int, b int, c int").dropDuplicates()
    panel = spark.createDataFrame(
        [(c, D(2022, 3, 1) + dt.timedelta(days=i), rng.random()) for i in range(200) for c in ("Taos", None)],
        "county string, Date date, pm double",
    ).withColumn("quarter", quarter_text("Date"))
    keys = ("county", "Date", "quarter")
    for months, weeks in ((FIRE_APR_AUG, 26), ((4,), 1)):
        fused = case_crossover_from_cases(
            cases, panel, flags, labels, "id", keys, {"quarter": quarter_text("Date")}, weeks, months
        )
        crossed = cross_cases(study_cases(cases, months), flags, weeks=weeks, months=months)
        full = attach_exposure(crossed.withColumn("quarter", quarter_text("Date")), panel, keys)
        steps = strata_tables(full, labels, "id")
        want = sorted(map(str, steps.collect()))
        assert want and sorted(map(str, fused.select(*steps.columns).collect())) == want
        if not repeat_ids:
            alone = case_crossover_from_cases(
                cases, panel, flags, labels, "id", keys, {"quarter": quarter_text("Date")}, weeks, months,
                unique_ids=True,
            )
            assert sorted(map(str, alone.select(*steps.columns).collect())) == want


def test_empty_inputs(spark):
    cells, panel = random_study(41, SHORT, n_cells=2)
    smoke, heat = panel_frames(spark, panel)
    adm = admissions_frame(spark, cells, SHORT)
    assert case_crossover_tables(adm.where("false"), exposure_panel(smoke, heat), SHORT).count() == 0
    no_panel = case_crossover_tables(adm, exposure_panel(smoke.where("false"), heat), SHORT, months=range(1, 13))
    assert no_panel.where("smokepm25 is not null").count() == 0
    assert no_panel.count() > 0


def test_one_county_day_holding_most_episodes_is_spread(spark):
    hot = {(D(2022, 5, 3), "Taos"): {SHORT[0]: 20_000}, (D(2022, 5, 4), "Taos"): {SHORT[0]: 3}}
    smoke = spark.createDataFrame(
        [(D(2022, 5, 3), "Taos", 1.0)], "Date date, County string, smokepm25 double"
    )
    out = case_crossover_tables(
        admissions_frame(spark, hot, SHORT), exposure_panel(smoke, lags=1), SHORT, weeks=2, size=500
    )
    parts = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 20_003 * 5
    assert max(parts) < 0.5 * sum(parts)
    assert out.where("outcome = 1").select("Patient_ID").distinct().count() == 20_003
