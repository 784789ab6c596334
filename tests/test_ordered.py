"""Cutting hot keys into chunks must not change any result."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from touchline.operators import features as ft
from touchline.operators.ordered import Feature, Rolling, Running, as_of, first_per_key, point_in_time, top_per_key


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def skewed(tables):
    # one side holds most rows, like a hot key would
    team = tables.team
    return team.withColumn("team", F.when(F.col("match_id") % 3 > 0, F.lit("hot")).otherwise(F.col("team"))).withColumn(
        "match_id", F.col("match_id") * 2 + F.col("is_home")
    )


def test_chunks_do_not_change_windows(skewed):
    features = [
        ft.rolling_mean(["goals_for", "corners_for"], 20),
        ft.rolling_density(5),
        ft.rest_days(),
        ft.home_advantage(),
        Feature(running={"best": Running("max", F.col("goals_for")), "least": Running("min", F.col("shots_for"))}),
        Feature(rolling={"incl": Rolling(3, F.sum("goals_for"), include_current=True)}),
        Feature(running={"upto": Running("sum", F.col("goals_for"), include_current=True)}),
    ]
    args = (skewed, ["team"], ["match_date", "match_id"], features)
    plain = rows(point_in_time(*args, split_hot_keys=False))
    assert rows(point_in_time(*args, chunk_rows=9)) == plain
    assert rows(point_in_time(*args, chunk_rows=100)) == plain
    assert rows(point_in_time(*args)) == plain


@pytest.mark.parametrize("build", [ft.streaks, ft.congestion, ft.season_goal_difference])
def test_chunks_do_not_change_features(skewed, build):
    assert rows(build(skewed, chunk_rows=11)) == rows(build(skewed, split_hot_keys=False))


@pytest.mark.parametrize("decay", [0.5, 0.9])
def test_form_matches_the_recurrence_when_cut(skewed, decay):
    got = {(r.team, r.match_id): r.form for r in ft.form(skewed, decay=decay, chunk_rows=50).collect()}
    data = {}
    for r in sorted(skewed.select("team", "match_date", "match_id", "points").collect(), key=lambda r: (r.match_date, r.match_id)):
        data.setdefault(r.team, []).append((r.match_id, r.points))
    for team, matches in data.items():
        state = None
        for match_id, points in matches:
            assert got[team, match_id] == pytest.approx(1.5 if state is None else state, abs=1e-9)
            state = float(points) if state is None else decay * state + (1 - decay) * points


def test_form_does_not_depend_on_chunks(tables):
    whole = {(r.team, r.match_id): r.form for r in ft.form(tables.team, split_hot_keys=False).collect()}
    cut = {(r.team, r.match_id): r.form for r in ft.form(tables.team, chunk_rows=7).collect()}
    assert whole.keys() == cut.keys() and all(whole[k] == pytest.approx(cut[k], abs=1e-9) for k in whole)


def test_no_leak_from_the_future(tables):
    """Changing a match must not change features at or before it."""
    team = tables.team
    cut = team.agg(F.expr("percentile(unix_micros(match_date), 0.5)").alias("c")).first().c
    late = F.unix_micros("match_date") >= cut
    changed = team.withColumn("goals_for", F.when(late, F.lit(99)).otherwise(F.col("goals_for"))).withColumn(
        "points", F.when(late, F.lit(0)).otherwise(F.col("points"))
    )
    keep = ["match_id", "is_home", "goals_for_avg5", "home_advantage", "win_streak", "form"]

    def build(df):
        out = ft.add_features(df, [ft.rolling_mean(["goals_for"], 5), ft.home_advantage()])
        out = ft.form(ft.streaks(out))
        first_late = out.filter(late).groupBy("team").agg(F.min("match_date").alias("d"))
        return rows(out.join(first_late, "team").filter(F.col("match_date") <= F.col("d")).select(*keep))

    assert build(team) == build(changed)


def test_partitioning_does_not_matter(tables):
    f = [ft.rolling_mean(["goals_for"], 5), ft.rest_days()]
    assert rows(ft.add_features(tables.team.repartition(13), f)) == rows(ft.add_features(tables.team.coalesce(1), f))


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5.0, 1), ("a", 10.0, 2), ("a", 1.0, 3), ("b", 7.0, 4), ("c", 1.0, 5)], "k string, t double, id long")
    right = spark.createDataFrame([("a", 5.0, "x"), ("a", 8.0, "y"), ("b", 9.0, "z")], "k string, t double, v string")
    kw = dict(right_tie=["v"])
    got = {r.id: r.v for r in as_of(left, right, ["k"], "t", ["v"], **kw).collect()}
    assert got == {1: "x", 2: "y", 3: None, 4: None, 5: None}
    got = {r.id: r.v for r in as_of(left, right, ["k"], "t", ["v"], strict=True, default_first=True, **kw).collect()}
    assert got == {1: "x", 2: "y", 3: "x", 4: "z", 5: None}
    hot = as_of(left, right, ["k"], "t", ["v"], chunk_rows=1, **kw)
    assert {r.id: r.v for r in hot.collect()} == {1: "x", 2: "y", 3: None, 4: None, 5: None}


def test_top_and_first(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    top = top_per_key(df, ["k"], [F.col("id").desc()], 3, F.col("id"))
    assert rows(top) == sorted([(0, 998), (0, 996), (0, 994), (1, 999), (1, 997), (1, 995)], key=str)
    assert rows(first_per_key(df, ["k"], [F.col("id")])) == [(0, 0), (1, 1)]


def test_congestion_counts_a_row_once(spark, tables):
    """A frame with both ends over the days is counted anew for each row, so its time grows with the square of a side."""
    plan = ft.side_history(tables.team, ["goals_for"])._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame" in plan and str(7 * 86_400_000_000 - 1) not in plan
    times = {0: None, 1: dt.datetime(2024, 1, 1), 2: dt.datetime(2024, 1, 4), 3: dt.datetime(2024, 1, 8)}
    when = spark.createDataFrame(list(times.items()), "match_id long, match_date timestamp")
    made = tables.team.filter("match_id < 4").withColumn("team", F.lit("A")).drop("match_date").join(when, "match_id")
    found = ft.side_history(made, ["goals_for"]).select("match_id", "congestion").collect()
    # Rows without a time count each other, the others those strictly within seven days.
    assert sorted(map(tuple, found)) == [(0, 2), (0, 2), (1, 0), (1, 0), (2, 2), (2, 2), (3, 2), (3, 2)]
