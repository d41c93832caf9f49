"""Physical plans: what is shuffled, broadcast and pushed down."""

from __future__ import annotations

import os
import re

import pytest

from workload.registry import QUERIES, load_all

load_all()

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables not present")


def nodes(text: str, name: str) -> int:
    return len(re.findall(rf"^\(\d+\) {name}", text, flags=re.M))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_and_no_python(spark, plan, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval", "MapInPandas", "MapInArrow", "FlatMapGroups"):
        assert bad not in text


@pytest.mark.parametrize("name", [
    "referent_dates", "referent_dates_off_season", "season_filter", "unpivot_outcomes", "calendar_labels",
])
def test_map_side_only(spark, plan, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    exchanges = nodes(text, "Exchange")
    assert exchanges == (1 if name == "unpivot_outcomes" else 0)  # the county-day counts themselves


@pytest.mark.parametrize("name", ["referent_dates", "season_filter"])
def test_study_start_reaches_the_scan(spark, plan, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "GreaterThanOrEqual(o_orderdate,1995-01-02" in text


def test_columns_are_pruned(spark, plan):
    text = plan(QUERIES["annual_summary"](spark, SF_DIR))
    reads = re.findall(r"ReadSchema: struct<(.*?)>", text)
    assert all("o_totalprice" not in r and "c_name" not in r for r in reads)


def test_lags_add_one_shuffle(spark, plan):
    joined = plan(QUERIES["exposure_join"](spark, SF_DIR))
    lagged = plan(QUERIES["lag_rows"](spark, SF_DIR))
    assert nodes(lagged, "Exchange") == nodes(joined, "Exchange") + 1


def test_only_bounded_single_partition_windows(spark, plan):
    """Single-partition exchanges carry one row per calendar date, never episodes."""
    text = plan(QUERIES["casecross_all"](spark, SF_DIR))
    singles = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: SinglePartition", text)
    assert singles and all(s.startswith("__block#") and s.count("#") == 2 for s in singles)


def test_a_small_panel_is_joined_where_the_dates_are(spark, plan):
    """A hint on the panel reaches the join, and then no episode or date is shuffled."""
    from pyspark.sql import functions as F

    from strataday.plans import case_crossover_tables
    from workload.views import START, admissions, smoke

    panel = F.broadcast(smoke(spark, SF_DIR))
    adm = admissions(spark, SF_DIR)
    hinted = plan(case_crossover_tables(adm, panel, start=START))
    assert nodes(hinted, "SortMergeJoin") == 0
    after = hinted[hinted.index("== Physical Plan =="):].split("\n\n")[0]
    light = after.split("BroadcastHashJoin LeftOuter BuildRight")[0]
    assert "Exchange" not in light and "Generate" in light
