from __future__ import annotations

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataday.plans import clean_admissions, clean_heat, clean_smoke, date_spine
from strataday.schemas import ADMISSION_TYPES, OUTCOME_SOURCES, SMOKE_PM_TYPES
from strataday.sources import (
    collect_polygons, collection_report, daily_path, file_date, file_verdicts, list_files,
    drop_scratch, names_match, read_boundary, read_csv, read_monitor_daily, replace_days, scan_lines, scratch_path,
    write_csv, write_outcome_tables, write_partitioned, written,
)
from strataday.sources.polygons import geometry_json

D = dt.date


def test_csv_roundtrip_keeps_nulls_and_accents(spark, rows):
    df = spark.createDataFrame(
        [("2022-04-01", "Doña Ana", 1.5, None), ("2022-04-02", None, None, 2.0)],
        "Date string, County string, smokepm25 double, totalpm25 double",
    )
    path = scratch_path(spark, "t")
    write_csv(df, path)
    back = read_csv(spark, path, SMOKE_PM_TYPES)
    assert back.schema == df.schema and rows(back) == rows(df)
    text = "\n".join(r[0] for r in spark.read.text(path).collect())
    assert "NA" in text and "Date,County,smokepm25,totalpm25" in text


def test_csv_sorted(spark):
    path = scratch_path(spark, "t")
    write_csv(spark.createDataFrame([(2, "b"), (None, "c"), (1, "a")], "k int, v string"), path, sort=["k"])
    files = spark.read.text(path).select("value", "_metadata.file_path").collect()
    assert {r[0] for r in files} == {"k,v", "1,a", "2,b", "NA,c"}


def test_admissions_file_end_to_end(spark, tmp_path):
    header = ["Admission_Date", "Patient_Resi_County_FIPS_Cd", "Unused", "Any_Name", *OUTCOME_SOURCES, "More"]
    lines = [",".join(header), "01JAN2016,13,x,3," + ",".join(["1"] * 12) + ",y",
             "02JAN2016,NA,x,NA," + ",".join(["0"] * 12) + ",y"]
    (tmp_path / "adm.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    raw = read_csv(spark, str(tmp_path / "adm.csv"), ADMISSION_TYPES)
    clean = clean_admissions(raw)
    got = sorted((r["Date"], r["County"], r["Total_Cases"], r["asthma_dx"]) for r in clean.collect())
    assert got == [(D(2016, 1, 1), "Doña Ana", "3", 1), (D(2016, 1, 2), None, None, 0)]


def test_row_positions_of_files_in_many_splits(spark, tmp_path):
    n = 5_000
    for k in range(3):
        lines = [f"{k * n + i},{'x' * (i % 17)}" for i in range(n)]
        (tmp_path / f"part{k}.csv").write_text("id,v\n" + "\n".join(lines) + "\n")
    (tmp_path / "part3.csv").write_text("id,v\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        df = read_csv(spark, str(tmp_path), {"id": T.LongType()}, position="place")
        assert df.columns == ["id", "v", "place"]
        assert df.where("id <> place").count() == 0 and df.agg(F.countDistinct("place")).first()[0] == 3 * n
        assert df.where("id = 7777").first()["place"] == 7777
        assert spark.read.csv(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert read_csv(spark, str(tmp_path / "part3.csv"), position="place").count() == 0


def test_snapshot_days_are_replaced_alone(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, D(2022, 4, 6)), (2, D(2022, 4, 7)), (3, D(2022, 4, 7))], "v int, Date date")
    path = str(tmp_path / "snap")
    replace_days(df, path)
    files = lambda day: {p.name: p.stat().st_mtime_ns for p in (tmp_path / "snap" / f"Date={day}").iterdir()}
    first, second = files("2022-04-06"), files("2022-04-07")
    for _ in range(2):
        replace_days(df.where("v = 2").withColumn("v", F.lit(9)), path)
    assert files("2022-04-06") == first and files("2022-04-07") != second
    assert rows(spark.read.parquet(path), "v", "Date") == [(1, D(2022, 4, 6)), (9, D(2022, 4, 7))]
    replace_days(df.where("false"), path)
    assert spark.read.parquet(path).count() == 2


def test_scratch_folders_are_dropped(spark):
    kept = written(spark.range(3).toDF("v"), "t")
    assert kept.count() == 3 and drop_scratch(spark) >= 1
    with pytest.raises(Exception):
        kept.count()
    assert drop_scratch(spark) == 0


def test_csv_header_mismatch_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n3,4\n")
    with pytest.raises(Exception):
        read_csv(spark, str(tmp_path), {"x": T.IntegerType(), "y": T.IntegerType()}).collect()


def test_wide_heat_file(spark, tmp_path):
    heads = [str(16801 + i) for i in range(2557)]
    body = ["row,county," + ",".join(heads)]
    for i, county in enumerate((35001, 35013)):
        body.append(f"{i},{county}," + ",".join("NA" if j == 3 else str(j + i) for j in range(2557)))
    (tmp_path / "heat.csv").write_text("\n".join(body) + "\n")
    wide = read_csv(spark, str(tmp_path / "heat.csv"), {"row": T.IntegerType(), "county": T.IntegerType()}, T.DoubleType())
    long = clean_heat(wide, drop=["row"])
    assert long.count() == 2 * 2557
    row = long.where((F.col("County") == "Doña Ana") & (F.col("Date") == D(2016, 1, 11))).first()
    assert row["HeatIndex"] == 11.0
    assert long.where("HeatIndex is null").count() == 2


def test_smoke_file_with_row_index(spark, tmp_path):
    (tmp_path / "pm.csv").write_text('"",Date,County,smokepm25,totalpm25\n1,1/2/2016,Dona Ana,0.5,NA\n', encoding="utf-8")
    out = clean_smoke(read_csv(spark, str(tmp_path / "pm.csv"), SMOKE_PM_TYPES), "mdy")
    assert tuple(out.first()) == (D(2016, 1, 2), "Doña Ana", 0.5, None)


def test_partitioned_sinks(spark, rows):
    df = spark.createDataFrame([("p", 1, "asthma"), ("q", 0, "copd")], "id string, outcome int, out_name string")
    path = scratch_path(spark, "t")
    first = write_outcome_tables(df, path, "apr-sep")
    second = write_outcome_tables(df.where("false").unionByName(df.limit(1)), path, "apr-aug")
    assert first != second and rows(spark.read.parquet(first), *df.columns) == rows(df)
    assert spark.read.parquet(first).where("out_name = 'copd'").count() == 1
    with pytest.raises(Exception):
        write_outcome_tables(df, path, "apr-sep")
    dated = df.withColumn("Date", F.lit(D(2022, 4, 6)))
    plain = write_partitioned(dated, scratch_path(spark, "t"), "Date", compact=False)
    assert spark.read.parquet(plain).first()["Date"] == D(2022, 4, 6)


def test_outcome_directories_prune(spark, plan):
    df = spark.createDataFrame([("p", "asthma"), ("q", "copd")], "id string, out_name string")
    path = write_outcome_tables(df, scratch_path(spark, "t"), "r")
    text = plan(spark.read.parquet(path).where("out_name = 'asthma'"))
    assert "PartitionFilters: [isnotnull(out_name" in text


class FakeSession:
    """Just the settings scratch_path looks at."""

    def __init__(self, settings):
        self.conf = settings


def test_scratch_path_follows_the_session(spark):
    assert scratch_path(FakeSession({"spark.checkpoint.dir": "/shared/x"}), "t").startswith("/shared/x/t-")
    unset = FakeSession({"spark.sql.warehouse.dir": "hdfs://host/warehouse"})
    assert scratch_path(unset, "t").startswith("hdfs://host/warehouse/_scratch/t-")
    assert scratch_path(unset, "t") != scratch_path(unset, "t")
    assert scratch_path(spark, "t").startswith(spark.conf.get("spark.checkpoint.dir"))


# --- polygons -------------------------------------------------------------

GOOD = {"Satellite": "GOES", "Start": "1", "End": "2", "Density": "Light",
        "geometry": {"type": "Polygon", "coordinates": [[[-106.0, 34.0], [-105.0, 34.0], [-106.0, 34.0]]]}}


@pytest.fixture
def polygon_root(tmp_path):
    def put(day, *lines):
        folder = tmp_path / day[:4] / day[4:6]
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"hms_smoke{day}.json").write_text("\n".join(lines) + "\n")

    put("20220406", json.dumps(GOOD), json.dumps({**GOOD, "Density": "Heavy"}))
    put("20220407", json.dumps({**GOOD, "Density": None}))
    put("20220409", json.dumps(GOOD), json.dumps({k: v for k, v in GOOD.items() if k != "Density"}))
    put("20220410", json.dumps(GOOD), "{broken")
    put("20220411", json.dumps(dict(reversed(GOOD.items()))))
    (tmp_path / "notes.txt").write_text("no day in this name\n")
    return str(tmp_path)


def test_collect_polygons(spark, polygon_root):
    out = collect_polygons(spark, polygon_root)
    assert out.columns == ["Satellite", "Start", "End", "Density", "geometry", "Date"]
    assert sorted((r["Date"], str(r["Density"])) for r in out.collect()) == [
        (D(2022, 4, 6), "Heavy"), (D(2022, 4, 6), "Light"), (D(2022, 4, 7), "None"),
    ]
    assert out.first()["geometry"]["coordinates"][0][0][0] == [-106.0, 34.0]


def test_lines_are_not_shuffled(spark, polygon_root, plan):
    out = collect_polygons(spark, polygon_root)
    out.collect()
    tree = plan(out).split("\n\n")[0]
    # what is left are the paths of rejected files; the lines stay where they are
    assert "BroadcastHashJoin" in tree and " Exchange" not in tree and "from_json" not in plan(out)


def test_collection_report(spark, polygon_root, rows):
    days = date_spine(spark, D(2022, 4, 6), D(2022, 4, 11))
    assert rows(collection_report(spark, polygon_root, days)) == [
        (D(2022, 4, 6), "accepted", 2), (D(2022, 4, 7), "accepted", 1), (D(2022, 4, 8), "missing", 0),
        (D(2022, 4, 9), "rejected", 2), (D(2022, 4, 10), "rejected", 2), (D(2022, 4, 11), "rejected", 1),
    ]
    verdicts = file_verdicts(scan_lines(spark, polygon_root))
    assert verdicts.where("accepted").count() == 2 and verdicts.count() == 5


def test_unreadable_and_empty_files(spark, tmp_path, rows):
    (tmp_path / "hms_smoke20220406.json").write_text(json.dumps(GOOD) + "\n")
    (tmp_path / "hms_smoke20220407.json.gz").write_bytes(b"this is not gzip")
    (tmp_path / "hms_smoke20220408.json").write_text("")
    days = date_spine(spark, D(2022, 4, 6), D(2022, 4, 9))
    assert rows(collection_report(spark, str(tmp_path), days)) == [
        (D(2022, 4, 6), "accepted", 1), (D(2022, 4, 7), "rejected", 0), (D(2022, 4, 8), "missing", 0),
        (D(2022, 4, 9), "missing", 0),
    ]
    assert collect_polygons(spark, str(tmp_path)).count() == 1
    assert list_files(spark, str(tmp_path)).count() == 2


def test_damaged_gzip_is_rejected_whole(spark, tmp_path, rows):
    whole = gzip.compress("".join(json.dumps({**GOOD, "Start": str(k)}) + "\n" for k in range(4000)).encode())
    (tmp_path / "hms_smoke20220406.json.gz").write_bytes(whole)
    (tmp_path / "hms_smoke20220407.json.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "hms_smoke20220408.json").write_text(json.dumps(GOOD) + "\r\n" + json.dumps(GOOD))
    (tmp_path / "hms_smoke20220409.json").write_text(json.dumps(GOOD) + "\n" + json.dumps(GOOD)[:-30])
    root = str(tmp_path)
    days = date_spine(spark, D(2022, 4, 6), D(2022, 4, 9))
    assert [r[1] for r in rows(collection_report(spark, root, days))] == ["accepted", "rejected", "accepted", "rejected"]
    got = collect_polygons(spark, root).groupBy("Date").count()
    assert rows(got) == [(D(2022, 4, 6), 4000), (D(2022, 4, 8), 2)]


def test_polygons_of_several_parts(spark, tmp_path):
    ring = GOOD["geometry"]["coordinates"][0]
    several = {"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}

    def put(day, geometry):
        (tmp_path / f"hms_smoke{day}.json").write_text(json.dumps({**GOOD, "geometry": geometry}) + "\n")

    put("20220406", several)
    put("20220407", None)
    put("20220408", {"type": "Point", "coordinates": [1.0, 2.0]})
    put("20220409", {"type": "Polygon", "coordinates": [1.0, 2.0]})
    put("20220410", {"type": "Polygon", "coordinates": [[ring]]})
    got = {r["Date"].day: r["geometry"] for r in collect_polygons(spark, str(tmp_path)).collect()}
    assert sorted(got) == [6, 7] and got[7] is None
    assert got[6]["coordinates"] == several["coordinates"]
    shapes = collect_polygons(spark, str(tmp_path)).select(geometry_json("geometry").alias("g"))
    assert json.loads(shapes.where("g is not null").first()["g"]) == several


def test_only_files_of_the_days_are_read(spark, polygon_root, rows):
    out = collect_polygons(spark, polygon_root, D(2022, 4, 7), D(2022, 4, 8))
    assert [r["Date"] for r in out.collect()] == [D(2022, 4, 7)]
    lines = scan_lines(spark, polygon_root, D(2022, 4, 7), D(2022, 4, 8))
    assert lines.select("path").distinct().count() == 1


def test_gate_and_paths(spark):
    df = spark.createDataFrame([(json.dumps(GOOD),), ("[]",), ("nonsense",), (None,)], "l string")
    assert [r[0] for r in df.select(names_match("l")).collect()] == [True, False, False, False]
    day = spark.createDataFrame([(D(2022, 4, 6),), (None,)], "d date")
    paths = [r[0] for r in day.select(daily_path("d", "base")).collect()]
    assert paths == ["base/2022/04/hms_smoke20220406", None]
    assert day.select(file_date(F.lit("/x/20991231/hms_smoke20220406/part-12345678.txt"))).first()[0] == D(2022, 4, 6)
    assert day.select(file_date(F.lit("/x/20991231.txt"))).first()[0] is None


def test_boundary(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"geometry": GOOD["geometry"]}) + "\n")
    assert read_boundary(spark, str(tmp_path / "b.json")).first()["geometry"]["type"] == "Polygon"
    (tmp_path / "c.json").write_text(json.dumps({"geometry": {"type": "Point", "coordinates": [1, 2]}}) + "\n")
    with pytest.raises(Exception, match="a boundary needs polygons"):
        read_boundary(spark, str(tmp_path / "c.json")).collect()


# --- monitors -------------------------------------------------------------


def test_monitor_filter_reaches_the_scan(spark, plan, rows):
    df = spark.createDataFrame(
        [("88101", 35, D(2022, 4, 6)), ("88101", 8, D(2022, 4, 6)), ("42101", 35, D(2022, 4, 6)),
         ("88101", 35, D(2023, 1, 1)), ("88101", None, None)],
        "parameter_code string, state_code int, date_local date",
    )
    for day in ("date", "string"):
        path = scratch_path(spark, "t")
        df.withColumn("date_local", F.col("date_local").cast(day)).write.parquet(path)
        out = read_monitor_daily(spark.read.parquet(path), "88101", D(2022, 1, 1), D(2022, 12, 31), [35])
        assert [(r[0], r[1], str(r[2])) for r in out.collect()] == [("88101", 35, "2022-04-06")]
        pushed = next(line for line in plan(out).splitlines() if "PushedFilters" in line)
        assert "EqualTo(parameter_code,88101)" in pushed and "GreaterThanOrEqual(date_local" in pushed
        assert "state_code" in pushed
