"""A third of all rows under one key: joins split it, aggregates collapse it."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strataday.functions import count_values
from strataday.operators import informative_strata, keep_first, keep_groups, left_join, require_unique

ROWS = 300_000
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def skewed(spark):
    """Half the rows under id 0, the rest spread, over several input partitions."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark.range(0, ROWS, 1, 8).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 5_000).alias("k"),
        (F.col("id") % 2).cast("int").alias("flag"),
        F.col("id").alias("n"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    )
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df, capsys) -> str:
    df.collect()
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_group_filter_splits_a_hot_group(skewed, capsys):
    out = keep_groups(skewed, ["k"], count_values("flag") == 1)
    assert "skew=true" in final_plan(out, capsys)
    assert out.count() == ROWS


def test_strata_split_a_hot_id(skewed, capsys):
    hot = skewed.withColumn("flag", F.when(F.col("k") == 0, (F.col("n") % 4 / 2).cast("int")).otherwise(F.col("flag")))
    out = informative_strata(hot, {"flag": "f"}, "k")
    assert "skew=true" in final_plan(out, capsys)
    assert out.count() == ROWS // 2 and out.where("k <> 0").count() == 0


def test_left_join_splits_a_hot_key(skewed, capsys):
    right = skewed.select("k").distinct().withColumn("v", F.col("k") + 1)
    out = left_join(skewed, require_unique(right, ["k"]), ["k"])
    assert "skew=true" in final_plan(out, capsys)
    assert out.where("v = k + 1").count() == ROWS


def test_first_row_of_a_hot_key_is_found_before_the_shuffle(skewed, capsys):
    out = keep_first(skewed, ["k"], ["n"])
    got = {r["k"]: r["n"] for r in out.collect()}
    assert got[0] == 0 and got[1] == 1 and len(got) == 2_501
    assert "partial_min_by" in final_plan(out, capsys)


def test_dated_hot_place(skewed, spark, capsys):
    """Half of all cases on one place and day."""
    from strataday.plans import case_crossover_from_cases

    day = dt.date(2022, 5, 4)
    cases = skewed.select(
        F.col("n").cast("string").alias("id"), F.lit("Taos").alias("County"),
        F.date_add(F.lit(day), (F.col("k") % 40).cast("int")).alias("Date"), F.lit(1).alias("a"), "payload",
    )
    panel = spark.createDataFrame([(day, "Taos", 1.0)], "Date date, County string, pm double")
    out = case_crossover_from_cases(cases, panel, ["a"], {"a": "a"}, "id", weeks=1, unique_ids=True)
    assert "skew=true" in final_plan(out.agg(F.max("payload"), F.max("id")), capsys)
    counts = {r["outcome"]: r["count"] for r in out.groupBy("outcome").count().collect()}
    assert counts == {1: ROWS, 0: 2 * ROWS}
