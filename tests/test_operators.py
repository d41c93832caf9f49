from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strataday.functions import count_values, zero_if_null
from strataday.operators import (
    add_calendar_lags, add_lags, add_lags_blocked, add_lags_ranged, arrange, block_by_rank, category_ordinal,
    dates_to_long, dense_rank, distinct_sorted, flags_wide, informative_strata, is_numeric, keep_first,
    keep_groups, left_join, map_columns, map_columns_if, outcome_table, pieces_of, pivot_values, ranges, rank_dates,
    rename_positions, replicate, replicate_offsets, require_unique, running_base, select_positions, to_long,
    uncount, union_by_name, with_point,
)

D = dt.date


# --- projections ----------------------------------------------------------


def test_select_positions(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert select_positions(df, 4, (1, 2)).columns == ["d", "a", "b"]
    with pytest.raises(ValueError):
        select_positions(df, 5)


def test_rename_positions(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert rename_positions(df, {3: "Total_Cases"}).columns == ["a", "b", "Total_Cases"]
    with pytest.raises(ValueError):
        rename_positions(df, {0: "x"})


def test_map_columns(spark):
    df = spark.createDataFrame([(None, None, None)], "a int, b double, c string")
    assert map_columns(df, ["a"], zero_if_null).first()["a"] == 0
    row = map_columns_if(df, is_numeric, zero_if_null).first()
    assert (row["a"], row["b"], row["c"]) == (0, 0.0, None)
    text = df.select("c")
    assert map_columns_if(text, is_numeric, zero_if_null).columns == ["c"]


def test_with_point(spark):
    df = spark.createDataFrame([("s", -106.0, 34.3), ("t", None, None)], "s string, x double, y double")
    out = with_point(df, "x", "y")
    assert out.columns == ["s", "geometry", "srid"]
    assert tuple(out.first()["geometry"]) == (-106.0, 34.3) and out.first()["srid"] == 4326


# --- reshaping ------------------------------------------------------------


def test_to_long_keeps_nulls(spark, rows):
    df = spark.createDataFrame([(1, 5, None)], "id int, a int, b int")
    assert rows(to_long(df, ["id"], ["a", "b"], "k", "v")) == [(1, "a", 5), (1, "b", None)]
    assert to_long(df.where("false"), ["id"], ["a", "b"], "k", "v").count() == 0


def test_dates_to_long(spark, rows):
    df = spark.createDataFrame(
        [("Taos", 1.5, None, 9.0)], "County string, `16801` double, `16802` double, note double"
    )
    assert rows(dates_to_long(df, ["County"])) == [
        ("Taos", D(2016, 1, 1), 1.5), ("Taos", D(2016, 1, 2), None), ("Taos", None, 9.0),
    ]


def test_dates_to_long_full_width(spark):
    heads = [str(16801 + i) for i in range(2557)]
    wide = spark.range(2).select(
        F.col("id").cast("string").alias("County"),
        *[(F.col("id") + i).cast("double").alias(h) for i, h in enumerate(heads)],
    )
    long = dates_to_long(wide, ["County"])
    row = long.agg(
        F.count("*").alias("n"), F.min("Date").alias("lo"), F.max("Date").alias("hi"),
        F.sum("HeatIndex").alias("s"),
    ).first()
    assert (row["n"], row["lo"], row["hi"]) == (5114, D(2016, 1, 1), D(2022, 12, 31))
    assert row["s"] == sum(i + j for i in range(2557) for j in range(2))


def test_flags_wide_inverts_to_long(spark, rows):
    df = spark.createDataFrame([("p1", "a"), ("p2", "b")], "id string, dx string")
    wide = flags_wide(df, "dx", ["a", "b", "c"])
    assert rows(wide) == [("p1", 1, 0, 0), ("p2", 0, 1, 0)]
    back = to_long(wide, ["id"], ["a", "b", "c"], "dx", "v").where("v = 1").drop("v")
    assert rows(back) == rows(df)
    assert flags_wide(df, "dx", ["a"], fill=None).where("a is null").count() == 1


def test_flags_wide_agrees_with_pivot(spark, rows):
    df = spark.createDataFrame([("p1", "a", 1), ("p2", "b", 1)], "id string, dx string, e int")
    pivoted = pivot_values(df, ["id"], "dx", ["a", "b", "c"], "e").na.fill(0)
    assert rows(flags_wide(df.drop("e"), "dx", ["a", "b", "c"])) == rows(pivoted)
    assert pivoted.columns == ["id", "a", "b", "c"]


def test_uncount(spark, rows):
    df = spark.createDataFrame([("x", 0), ("y", 1), ("z", 3)], "k string, n int")
    assert rows(uncount(df, "n")) == [("y", 0), ("z", 0), ("z", 1), ("z", 2)]
    assert uncount(df.where("false"), "n").count() == 0


@pytest.mark.parametrize("bad", [None, -1])
def test_uncount_rejects_bad_counts(spark, bad):
    df = spark.createDataFrame([("x", bad)], "k string, n int")
    with pytest.raises(Exception, match="counts must be non-negative"):
        uncount(df, "n").collect()


@pytest.mark.parametrize("size", [1, 7, 100])
def test_uncount_cut_equals_plain(spark, rows, size):
    df = spark.createDataFrame([("x", 0), ("y", 23), ("z", 8), ("z", 7)], "k string, n int")
    assert rows(uncount(df, "n", size=size)) == rows(
        replicate(df, "n", "replicate").withColumn("replicate", F.col("replicate").cast("long"))
    )


def test_one_huge_count_and_many_small_ones_share_a_plan(spark, plan):
    hot = spark.createDataFrame([("hot", 200_000), ("cold", 3)], "k string, n int")
    out = uncount(hot, "n", size=1_000)
    sizes = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 200_003
    assert max(sizes) < 100_000
    assert out.where("k = 'hot'").select("replicate").distinct().count() == 200_000
    ones = spark.range(20_000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("n"))
    sizes = [r[1] for r in uncount(ones, "n").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 10_000
    tree = plan(out).split("\n\n")[0]
    assert "Union" not in tree and tree.count("Exchange") == 1


def test_pieces_of_a_count(spark):
    df = spark.createDataFrame([(0,), (1,), (10,), (11,), (None,)], "n long")
    assert [r[0] for r in df.select(pieces_of(F.col("n"), 10)).collect()] == [[], [0], [0], [0, 1], []]


def test_replicate_offsets(spark):
    df = spark.createDataFrame([("a",)], "k string")
    assert [r["index"] for r in replicate_offsets(df, -26, 26).collect()] == list(range(-26, 27))


def test_union_by_name(spark, rows):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([("y",)], "s string")
    c = spark.createDataFrame([(2.0, 3)], "d double, i int")
    assert rows(union_by_name(a, b, c), "i", "s", "d") == [(1, "x", None), (3, None, 2.0), (None, "y", None)]


# --- joins ----------------------------------------------------------------


def test_left_join_matches_null_keys(spark, rows):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, l string")
    right = spark.createDataFrame([(1, 10), (None, 20)], "k int, r int")
    out = left_join(left, right, ["k"])
    assert out.columns == ["k", "l", "r"]
    assert rows(out) == [(1, "a", 10), (3, "c", None), (None, "b", 20)]


def test_left_join_duplicates(spark):
    left = spark.createDataFrame([(1, "a")], "k int, l string")
    right = spark.createDataFrame([(1, 10), (1, 11)], "k int, r int")
    assert left_join(left, right, ["k"]).count() == 2
    with pytest.raises(Exception, match="duplicate key"):
        left_join(left, right, ["k"], on_dup="error").collect()
    with pytest.raises(ValueError):
        left_join(left, right, ["k"], on_dup="first")


def test_require_unique_keeps_rows_and_columns(spark, rows):
    df = spark.createDataFrame([(1, "a", None), (None, "b", 2)], "k int, s string, v int")
    assert rows(require_unique(df, ["k"])) == rows(df)
    assert require_unique(df, ["k"]).columns == df.columns
    with pytest.raises(Exception, match="duplicate key"):
        require_unique(df.union(df), ["k"]).collect()


def test_null_safe_join_stays_an_equi_join(spark, plan):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(10).withColumn("k", F.col("id") % 3)
        right = spark.range(10).select((F.col("id") % 3).alias("k"), F.lit(1).alias("v"))
        text = plan(left_join(left, right, ["k"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "NestedLoop" not in text and "Cartesian" not in text


# --- lags -----------------------------------------------------------------


def panel(spark, days, county="Taos"):
    return spark.createDataFrame(
        [(county, D(2022, 4, d), float(d)) for d in days], "County string, Date date, v double"
    )


def test_row_lags_ignore_file_order_and_skip_gaps(spark, rows):
    out = add_lags(panel(spark, [5, 1, 2, 4]), ["v"], 2)
    assert out.columns == ["County", "Date", "v", "v_lag1", "v_lag2"]
    assert rows(out, "v", "v_lag1", "v_lag2") == [
        (1.0, None, None), (2.0, 1.0, None), (4.0, 2.0, 1.0), (5.0, 4.0, 2.0),
    ]


def test_calendar_lags_respect_gaps(spark, rows):
    out = add_calendar_lags(panel(spark, [5, 1, 2, 4]), ["v"], 2)
    assert rows(out, "v", "v_lag1", "v_lag2") == [
        (1.0, None, None), (2.0, 1.0, None), (4.0, None, 2.0), (5.0, 4.0, None),
    ]


def test_row_and_calendar_lags_agree_without_gaps(spark, rows):
    df = panel(spark, range(1, 25)).unionByName(panel(spark, range(3, 20), None))
    assert rows(add_lags(df, ["v"], 5)) == rows(add_calendar_lags(df, ["v"], 5))


def test_default_number_of_lags(spark):
    assert add_lags(panel(spark, [1]), ["v"]).columns[-1] == "v_lag6"


def test_lags_reject_repeated_days(spark):
    df = panel(spark, [1, 2]).unionByName(panel(spark, [2]))
    with pytest.raises(Exception, match="duplicate"):
        add_lags(df, ["v"], 1).collect()
    with pytest.raises(Exception, match="duplicate"):
        add_calendar_lags(df, ["v"], 1).collect()


def test_calendar_lags_with_repeated_days(spark, rows):
    df = panel(spark, [1, 2, 2]).unionByName(panel(spark, [2, 3], None))
    df = df.withColumn("v", F.col("v") + F.monotonically_increasing_id() * 0)
    out = add_calendar_lags(df, ["v"], 1, on_dup="keep")
    assert rows(out, "County", "v", "v_lag1") == [
        ("Taos", 1.0, None), ("Taos", 2.0, 1.0), ("Taos", 2.0, 1.0), (None, 2.0, None), (None, 3.0, 2.0),
    ]


def test_lags_allow_a_null_date_and_county(spark):
    df = spark.createDataFrame(
        [(None, None, 1.0), (None, D(2022, 4, 1), 2.0)], "County string, Date date, v double"
    )
    assert add_lags(df, ["v"], 1).count() == 2


def test_all_lags_share_one_shuffle(spark, plan):
    df = panel(spark, [1, 2]).withColumn("w", F.col("v"))
    tree = plan(add_lags(df, ["v", "w"], 5)).split("\n\n")[0]
    assert tree.count("Exchange") == 1 and tree.count("Sort (") == 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_blocked_lags_equal_one_window(spark, rows, seed):
    rng = random.Random(seed)
    data = [
        (rng.choice(["a", "b", None]), D(2022, 1, 1) + dt.timedelta(days=rng.randrange(40)), i, rng.random())
        for i in range(300)
    ]
    df = spark.createDataFrame(data, "County string, Date date, tie int, v double")
    blocked = add_lags_blocked(df, ["v"], 3, "County", ["Date", "tie"], F.col("Date"))
    monthly = add_lags_blocked(df, ["v"], 3, "County", ["Date", "tie"], F.trunc("Date", "MM"))
    from pyspark.sql import Window

    w = Window.partitionBy("County").orderBy("Date", "tie")
    plain = df.select("*", *[F.lag("v", k).over(w).alias(f"v_lag{k}") for k in (1, 2, 3)])
    assert rows(blocked) == rows(plain)
    assert rows(monthly) == rows(plain)


def test_blocked_lags_reject_a_block_against_the_order(spark):
    df = panel(spark, range(1, 9))
    with pytest.raises(Exception, match="block must not decrease"):
        add_lags_blocked(df, ["v"], 1, "County", ["Date"], -F.dayofmonth("Date")).collect()


# --- numbering ------------------------------------------------------------


def test_running_base_matches_a_global_window(spark):
    rng = random.Random(5)
    cells = {
        (D(2022, 1, 1) + dt.timedelta(days=rng.randrange(9)) if rng.random() > 0.1 else None,
         rng.choice(["a", "b", "c", None])): rng.randrange(5)
        for _ in range(60)
    }
    df = spark.createDataFrame([(d, c, n) for (d, c), n in cells.items()], "Date date, County string, n long")
    got = {(r["Date"], r["County"]): r["b"] for r in running_base(df, "n", "Date", ["County"], "b").collect()}
    running, want = 0, {}
    for key in sorted(cells, key=lambda k: (k[0] is None, k[0] or D(1, 1, 1), k[1] is None, k[1] or "")):
        want[key] = running
        running += cells[key]
    assert got == want


def test_running_base_over_row_blocks(spark):
    counts = [i * 7 % 5 for i in range(200)]
    df = spark.createDataFrame([(i, i // 16, n) for i, n in enumerate(counts)], "pos long, part long, n long")
    got = {r["pos"]: r["id_base"] for r in running_base(df, "n", "part", ["pos"]).collect()}
    assert got == {i: sum(counts[:i]) for i in range(200)}


# --- groups ---------------------------------------------------------------


def test_keep_first(spark, rows):
    df = spark.createDataFrame(
        [("a", 2, "x"), ("a", 1, "y"), ("a", None, "z"), (None, 5, "n"), ("b", None, None)],
        "k string, o int, v string",
    )
    assert rows(keep_first(df, ["k"], ["o"])) == [("a", 1, "y"), ("b", None, None), (None, 5, "n")]
    assert keep_first(df, ["k"], ["o"]).columns == df.columns


def test_distinct_and_rank(spark):
    df = spark.createDataFrame([(D(2022, 1, 3),), (D(2022, 1, 1),), (D(2022, 1, 3),), (None,)], "Date date")
    assert [r[0] for r in distinct_sorted(df, "Date").collect()] == [D(2022, 1, 1), D(2022, 1, 3)]
    assert sorted(tuple(r) for r in rank_dates(df).collect()) == [(D(2022, 1, 1), 1), (D(2022, 1, 3), 2)]


def test_keep_groups(spark, rows):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (None, 0), (None, None)], "id int, f int")
    assert rows(keep_groups(df, ["id"], count_values("f") == 2)) == [(1, 0), (1, 1), (None, 0), (None, None)]


def test_informative_strata(spark, rows):
    df = spark.createDataFrame(
        [("p", 1, 1, 0), ("p", 2, 0, 0), ("q", 3, 1, 1), ("q", 4, 0, 0), ("r", 5, 1, 1), (None, 6, 0, 1), (None, 7, 1, 1)],
        "id string, n int, a int, b int",
    )
    out = informative_strata(df, {"a": "A", "b": "B"}, "id")
    assert out.columns == ["id", "n", "a", "b", "outcome", "out_name"]
    assert rows(out, "n", "outcome", "out_name") == [
        (1, 1, "A"), (2, 0, "A"), (3, 1, "A"), (3, 1, "B"), (4, 0, "A"), (4, 0, "B"), (6, 0, "A"), (7, 1, "A"),
    ]
    table = outcome_table(out, "b", "B")
    assert table.columns == ["id", "n", "a", "outcome", "out_name"] and table.count() == 2


def test_strata_with_null_flags_count_null_as_a_value(spark, rows):
    df = spark.createDataFrame([("p", 1), ("p", None), ("q", 1), ("q", 0), ("q", None)], "id string, a int")
    out = informative_strata(df, {"a": "A"}, "id")
    assert rows(out, "id", "outcome") == [("p", 1), ("p", None)]


# --- order ----------------------------------------------------------------


def test_arrange_nulls_last(spark):
    df = spark.createDataFrame([(None, "a"), (2, None), (2, "b"), (1, "c")], "x int, y string")
    assert [tuple(r) for r in arrange(df, "x", "y").collect()] == [
        (1, "c"), (2, "b"), (2, None), (None, "a"),
    ]


def test_category_ordinal(spark):
    df = spark.createDataFrame([("b",), ("a",), ("z",), (None,)], "c string")
    assert [r[0] for r in df.select(category_ordinal("c", ["a", "b"])).collect()] == [2, 1, None, None]


# --- ranges ---------------------------------------------------------------


def test_ranges_follow_the_order_and_are_alike(spark):
    df = spark.range(20_000, numPartitions=5).select((F.col("id") * F.col("id")).alias("v"), F.lit(1).alias("g"))
    cut = ranges(df, ["g", "v"], 8)
    sizes = {r["__range"]: (r.n, r.lo, r.hi) for r in cut.groupBy("__range").agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    assert max(n for n, _, _ in sizes.values()) < 2 * 20_000 / 8
    bounds = [x for k in sorted(sizes) for x in sizes[k][1:]]
    assert bounds == sorted(bounds)


@pytest.mark.parametrize("kind", ["long", "timestamp", "string", "double", "date"])
def test_dense_rank_of_any_ordered_type(spark, kind):
    values = [random.Random(3).randrange(10**9) if k % 3 else k for k in range(3000)] + [None, None]
    df = spark.createDataFrame([(v,) for v in values], "n long").repartition(5)
    cast = F.timestamp_seconds("n") if kind == "timestamp" else F.date_add(F.lit(D(1970, 1, 1)), (F.col("n") % 9000).cast("int")) if kind == "date" else F.col("n").cast(kind)
    df = df.select(cast.alias("v"))
    got = sorted(tuple(r) for r in dense_rank(df, "v", "k", 7).collect())
    want = sorted({r.v for r in df.collect() if r.v is not None})
    assert got == [(v, i) for i, v in enumerate(want, 1)]
    assert dense_rank(df.where("false"), "v").count() == 0


def test_ranked_values_are_numbered_in_many_tasks(spark):
    df = spark.range(30_000).select(F.timestamp_seconds(F.col("id") * 7).alias("ts"))
    out = dense_rank(df, "ts", "k", 12)
    assert out.agg(F.max("k")).first()[0] == 30_000
    parts = [r[1] for r in ranges(df.distinct(), ["ts"], 12).groupBy("__range").count().collect()]
    assert len(parts) > 8 and max(parts) < 6_000


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_ranged_lags_equal_plain_lags(spark, rows, parts):
    r = random.Random(8)
    data = [(r.choice(["hot"] * 9 + ["a", None]), D(2022, 4, 1 + r.randrange(3)) if r.random() < 0.95 else None, k, r.random()) for k in range(400)]
    df = spark.createDataFrame(data, "g string, Date date, tie int, v double").repartition(3)
    got = rows(add_lags_ranged(df, ["v"], 4, "g", ["Date", "tie"], parts))
    by = {}
    for row in sorted(data, key=lambda t: (t[1] is None, t[1] or D(1, 1, 1), t[2])):
        by.setdefault(row[0], []).append(row)
    want = [
        (*row, *[own[i - k][3] if i >= k else None for k in range(1, 5)]) for own in by.values() for i, row in enumerate(own)
    ]
    assert got == sorted(want, key=lambda t: [(v is None, str(v)) for v in t])
    assert add_lags_ranged(df.where("false"), ["v"], 2, "g", ["Date", "tie"]).count() == 0


def test_blocks_by_rank_of_sparse_positions(spark):
    df = spark.range(1_000).select((F.col("id") * 2_000_000).alias("p"))
    sizes = [r[1] for r in df.groupBy(block_by_rank(df, "p", 8)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 150
    one = spark.createDataFrame([(5,), (None,)], "p long")
    assert one.select(block_by_rank(one.where("false"), "p")).count() == 2
