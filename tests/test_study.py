"""The studies end to end, from files on disk."""

from __future__ import annotations

import datetime as dt
import json
import random

from . import brute
from strataday.plans import run_case_crossover, run_flagged_study, run_frames
from strataday.schemas import COUNTY_FIPS, EXPOSURES, FIRE_APR_SEP, OUTCOME_SOURCES, OUTCOMES

D = dt.date


def na(v):
    return "NA" if v is None else str(v)


def test_case_crossover_from_files(spark, tmp_path):
    rng = random.Random(77)
    codes = {"Taos": 55, "Doña Ana": 13}
    cells = {
        (D(2021, 3, 20) + dt.timedelta(days=rng.randrange(250)), c): {o: rng.choice([0, 0, 0, 1, 2]) for o in OUTCOMES}
        for c in codes for _ in range(8)
    }
    days = [D(2021, 3, 1) + dt.timedelta(days=i) for i in range(300)]
    panel = {
        (d, c): {"smokepm25": round(rng.random(), 3), "totalpm25": round(rng.random(), 3),
                 "HeatIndex": rng.choice([None, 90.5, 101.25])}
        for d in days for c in codes if rng.random() > 0.1
    }
    header = ["Admission_Date", "Patient_Resi_County_FIPS_Cd", "Region", "All_Cases", *OUTCOME_SOURCES]
    lines = [",".join(header)]
    for (d, c), n in cells.items():
        counts = [n[o] for o in OUTCOMES]
        lines.append(",".join([f"{d:%d%b%Y}".upper(), str(codes[c]), "x", str(sum(counts)), *map(str, counts)]))
    (tmp_path / "adm.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    lines = ["Date,County,smokepm25,totalpm25"]
    for (d, c), v in panel.items():
        lines.append(f"{d:%Y-%m-%d},{c.replace('ñ', 'n')},{v['smokepm25']},{v['totalpm25']}")
    (tmp_path / "pm.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    heads = [(d - D(1970, 1, 1)).days for d in days]
    lines = ["row,county," + ",".join(map(str, heads))]
    for i, (c, code) in enumerate(codes.items()):
        cells_of = [na(panel.get((d, c), {}).get("HeatIndex")) for d in days]
        lines.append(f"{i},{35000 + code}," + ",".join(cells_of))
    (tmp_path / "heat.csv").write_text("\n".join(lines) + "\n")

    paths = run_case_crossover(
        spark, str(tmp_path / "adm.csv"), str(tmp_path / "pm.csv"), str(tmp_path / "out"), "apr-sep",
        heat_path=str(tmp_path / "heat.csv"),
    )
    names = [*EXPOSURES, *[f"{v}_lag{k}" for v in EXPOSURES for k in range(1, 6)]]
    got = spark.read.parquet(paths["tables"]).select(
        "Date", "Year", "Month", "County", "Patient_ID", "outcome", *names, "out_name"
    )
    want = brute.tables(cells, panel, OUTCOMES, FIRE_APR_SEP, D(2016, 1, 1), EXPOSURES)
    assert want and {tuple(r) for r in got.collect()} == set(want)
    full = spark.read.option("header", True).option("nullValue", "NA").csv(paths["full_dataset"])
    assert len(full.columns) == 35 and full.count() == len(want)
    yearly = spark.read.option("header", True).csv(paths["annual_summary"]).collect()
    assert [r["Year"] for r in yearly] == ["2021"]
    assert int(yearly[0]["asthma_dx"]) == sum(n["asthma_dx"] for n in cells.values())
    assert set(codes) <= set(COUNTY_FIPS.values())


def test_case_crossover_from_files_in_file_order_with_all_flags(spark, tmp_path):
    header = ["Admission_Date", "Patient_Resi_County_FIPS_Cd", "Region", "All_Cases", *OUTCOME_SOURCES]
    lines = [",".join(header)]
    # out of order in the file: the second row comes first by date
    for day, code, first, last in (("09MAY2021", 55, 2, 0), ("03MAY2021", 13, 1, 1), ("09MAY2021", 55, 0, 1)):
        lines.append(",".join([day, str(code), "x", "9", str(first), *["0"] * 10, str(last)]))
    (tmp_path / "adm.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "pm.csv").write_text("Date,County,smokepm25,totalpm25\n2021-05-09,Taos,1.5,2.5\n", encoding="utf-8")
    paths = run_case_crossover(
        spark, str(tmp_path / "adm.csv"), str(tmp_path / "pm.csv"), str(tmp_path / "out"), "r", file_order=True,
        sort=("County", "Date", "Patient_ID"), all_flags=True,
    )
    tables = spark.read.parquet(paths["tables"])
    assert set(OUTCOMES) < set(tables.columns)
    cases = tables.where("outcome = 1").select("Patient_ID", "Date", "County", "out_name").collect()
    assert {tuple(r) for r in cases} == {
        ("resp 1", D(2021, 5, 9), "Taos", "respiratory"), ("resp 2", D(2021, 5, 9), "Taos", "respiratory"),
        ("resp 3", D(2021, 5, 3), "Doña Ana", "respiratory"), ("cere 4", D(2021, 5, 3), "Doña Ana", "cerebrovascular"),
        ("cere 5", D(2021, 5, 9), "Taos", "cerebrovascular"),
    }
    files = sorted((tmp_path / "out" / "run=r" / "full_dataset").glob("*.csv"))
    held = [tuple(x.split(",")[k] for k in (3, 0, 4)) for f in files for x in f.read_text(encoding="utf-8").splitlines()[1:]]
    assert len(held) == tables.count() and held == sorted(held)


def test_flagged_study_from_files(spark, tmp_path):
    rng = random.Random(5)
    lines = ["hfdrepisode,county,Date,asthma,copd,other"]
    for i in range(40):
        day = D(2021, 3, 25) + dt.timedelta(days=rng.randrange(180))
        flags = [rng.choice(["NA", "1", "0"]) for _ in range(2)]
        lines.append(f"e{i % 35},{rng.choice(['Taos', 'Eddy', 'NA'])},{day:%Y-%m-%d},{flags[0]},{flags[1]},z")
    (tmp_path / "cases.csv").write_text("\n".join(lines) + "\n")
    lines = ["Date,county,temp"]
    for i in range(250):
        for county in ("Taos", "Eddy"):
            if rng.random() < 0.9:
                lines.append(f"{D(2021, 3, 1) + dt.timedelta(days=i):%Y-%m-%d},{county},{rng.randrange(90)}")
    (tmp_path / "panel.csv").write_text("\n".join(lines) + "\n")
    labels = {"asthma": "asthma", "copd": "lung"}
    paths = run_flagged_study(
        spark, str(tmp_path / "cases.csv"), str(tmp_path / "panel.csv"), str(tmp_path / "out"), "r",
        flags=("asthma", "copd"), labels=labels, weeks=3, lags=2,
    )
    head, *rows = [r[0].split(",") for r in spark.read.text(paths["full_dataset"]).where("value not like 'hfdr%'").collect()] or [[]]
    rows = [head, *rows]
    names = spark.read.option("header", True).csv(paths["full_dataset"]).columns
    assert {"temp", "temp_lag1", "temp_lag2", "quarter"} < set(names)
    full = [dict(zip(names, r)) for r in rows]
    want = []
    for flag, label in labels.items():
        values = {}
        for r in full:
            values.setdefault(r["hfdrepisode"], set()).add(r[flag])
        want += [
            (r["hfdrepisode"], r["county"], r["Date"], r["temp"], r["temp_lag2"], r["asthma"], r["copd"], r[flag], label)
            for r in full if len(values[r["hfdrepisode"]]) == 2
        ]
    columns = ["hfdrepisode", "county", "Date", "temp", "temp_lag2", "asthma", "copd", "outcome", "out_name"]
    got = [tuple("NA" if v is None else str(v) for v in r) for r in spark.read.parquet(paths["tables"]).select(*columns).collect()]
    assert want and sorted(got) == sorted(want)


def test_frames_from_files(spark, tmp_path):
    shape = {"type": "Polygon", "coordinates": [[[-106.0, 34.0], [-105.0, 34.0], [-106.0, 34.0]]]}
    feature = {"Satellite": "GOES", "Start": "1", "End": "2", "Density": "Light", "geometry": shape}
    (tmp_path / "files").mkdir()
    for i in range(120):
        day = D(2022, 1, 1) + dt.timedelta(days=i)
        if day != D(2022, 2, 1):  # a missing day
            (tmp_path / "files" / f"hms_smoke{day:%Y%m%d}.json").write_text(json.dumps(feature) + "\n")
    (tmp_path / "boundary").write_text(json.dumps({"geometry": shape}) + "\n")
    monitors = spark.createDataFrame(
        [("88101", 35, "1", "2", "PM25 Annual 2012", -106.6, 35.1, D(2022, 1, 1) + dt.timedelta(days=i), 8.0)
         for i in range(100)],
        "parameter_code string, state_code int, county_code string, site_number string, pollutant_standard string, "
        "longitude double, latitude double, date_local date, arithmetic_mean double",
    )
    for by, smoke_day in (("date", D(2022, 4, 6)), ("rank", D(2022, 4, 7))):
        paths = run_frames(
            spark, str(tmp_path / "files"), monitors, str(tmp_path / "boundary"), str(tmp_path / by), by=by
        )
        frames = spark.read.parquet(paths["frames"])
        first = {r["layer"]: r for r in frames.where("frame_no = 96").collect()}
        assert first["smoke"]["layer_date"] == smoke_day and first["smoke"]["label"] == "04-06-2022"
        assert first["monitor"]["layer_date"] == D(2022, 4, 6)
        assert frames.where("layer = 'boundary'").count() == 138
