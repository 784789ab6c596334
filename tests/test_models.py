"""Fits and prices against independent numpy computations."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from touchline.functions import scalars as x
from touchline.operators import boosting, fits
from touchline.operators import learning as ml
from touchline.operators import metrics as g
from touchline.operators import pricing as pr


def pooled(p, y):
    """Pool adjacent violators over sorted distinct scores."""
    values = sorted(set(p))
    blocks = [[v, v, sum(b for a, b in zip(p, y) if a == v), sum(1 for a in p if a == v)] for v in values]
    out = []
    for b in blocks:
        out.append(list(b))
        while len(out) > 1 and out[-2][2] / out[-2][3] >= out[-1][2] / out[-1][3]:
            last = out.pop()
            out[-1] = [out[-1][0], last[1], out[-1][2] + last[2], out[-1][3] + last[3]]
    return [(lo, hi, s / n) for lo, hi, s, n in out]


@pytest.fixture(scope="module")
def settled(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.uniform(0.05, 0.95, 600), 2)
    y = (rng.uniform(size=600) < p**2).astype(float)
    rows = [("a", float(a), float(b)) for a, b in zip(p, y)] + [("one", 0.5, 1.0), ("one", 0.6, 1.0)]
    return spark.createDataFrame(rows, "market string, probability double, hit double"), p, y


def test_calibrators(settled):
    df, p, y = settled
    fitted = ml.fit_calibrators(df)
    (c,) = fitted.chosen.collect()  # one class only: no calibrator
    assert (c.market, c.n) == ("a", 600)
    want = pooled(list(p), list(y))
    assert [(r.x, r.y) for r in fitted.knots.orderBy("x").collect()] == [pytest.approx(k) for k in dict.fromkeys((x, v) for lo, hi, v in want for x in (lo, hi))]
    if c.kind == "isotonic":
        scored = {r.probability: r.calibrated for r in ml.apply_calibrators(df.filter("market = 'a'"), fitted).distinct().collect()}
        for lo, hi, v in want:
            for score in {lo, hi}:
                assert scored[score] == pytest.approx(min(max(v, 1e-6), 1 - 1e-6), abs=1e-9)
    missing = ml.apply_calibrators(df.filter("market = 'one'"), fitted).select("calibrated").first()
    assert missing.calibrated is None


def test_calibration_slope(settled):
    df, p, y = settled
    z = np.log(np.clip(p, 0.01, 0.99) / (1 - np.clip(p, 0.01, 0.99)))
    design, beta = np.column_stack([np.ones_like(z), z]), np.zeros(2)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-design @ beta))
        beta += np.linalg.solve(design.T @ (design * (mu * (1 - mu))[:, None]), design.T @ (y - mu))
    got = ml.calibration_slopes(df.filter("market = 'a'")).first()
    assert got.slope == pytest.approx(beta[1], rel=1e-4)


def test_isotonic_in_ranges_of_scores(spark, monkeypatch):
    """Many scores in one market, pooled range by range: the same levels as one pass over all of them."""
    rng = np.random.default_rng(7)
    score = np.sort(rng.uniform(size=100_000))
    hit = (rng.uniform(size=100_000) < 0.2 + 0.5 * score**2).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"market": "m", "x": score, "n": 1.0, "pos": hit}))
    want, stack = [], []
    for v, h in zip(score, hit):
        stack.append([v, v, 1.0, h])
        while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
            last = stack.pop()
            stack[-1] = [stack[-1][0], last[1], stack[-1][2] + last[2], stack[-1][3] + last[3]]
    want = [tuple(b) for b in stack]
    for rows in (200_000, 100):
        monkeypatch.setattr(fits, "POOL_ROWS", rows)
        got = [tuple(r)[1:] for r in fits.isotonic_levels(df, "market").orderBy("lo").collect()]
        assert got == want
    two = df.union(df.withColumn("market", F.lit("k"))).union(spark.createDataFrame([(None, 0.5, 1.0, 1.0)], df.schema))
    assert fits.isotonic_levels(two, "market").groupBy("market").count().filter(F.col("market").isNotNull()).select("count").distinct().first()[0] == len(want)


def test_calibrators_of_odd_tables(spark):
    kind = "market string, probability double, hit double"
    rows = [("one", 0.5, 1.0), ("two", 0.5, 1.0), ("two", 0.5, 0.0), ("two", None, 1.0), (None, 0.4, 1.0), ("up", 0.2, 0.0), ("up", 0.8, 1.0)]
    df = spark.createDataFrame(rows, kind)
    fitted = ml.fit_calibrators(df)
    assert {r.market for r in fitted.chosen.collect()} == {"two", "up"}
    got = {(r.market, r.probability): r.calibrated for r in ml.apply_calibrators(df, fitted).collect()}
    assert got["one", 0.5] is None and got["two", None] is None and got[None, 0.4] is None
    assert got["two", 0.5] == pytest.approx(0.5) and got["up", 0.8] > 0.5 > got["up", 0.2]
    assert ml.apply_calibrators(df, fitted).count() == len(rows)
    assert ml.fit_calibrators(spark.createDataFrame([], kind)).chosen.count() == 0
    table = spark.createDataFrame([("a", 0.2, 0.1), ("a", 0.6, 0.5)], "market string, x double, y double")
    probes = spark.createDataFrame([("a", v) for v in (0.0, 0.2, 0.3, 0.6, 0.9)] + [("b", 0.3)], "market string, probability double")
    for rows in (2, 1000):
        out = {(r.market, r.probability): r.calibrated for r in g.apply_calibrator(probes, table, chunk_rows=rows).collect()}
        assert [out["a", v] for v in (0.0, 0.2, 0.3, 0.6, 0.9)] == pytest.approx([0.1, 0.1, 0.2, 0.5, 0.5]) and out["b", 0.3] is None


@pytest.mark.parametrize("cells", [2_000_000, 7])
def test_refits_equal_separate_fits(spark, monkeypatch, cells):
    """All refits at once against a Newton fit of its own for each, and against the library's single fit."""
    monkeypatch.setattr(fits, "CELLS", cells)
    rng = np.random.default_rng(9)
    n, reg = 300, 0.01
    a, b = rng.normal(2, 3, n), rng.uniform(size=n)
    a[rng.uniform(size=n) < 0.1] = np.nan
    at = np.sort(rng.integers(-1, 5, n))
    y = rng.poisson(np.exp(0.2 + 0.1 * np.nan_to_num(a) - 0.4 * b)).astype(float)
    z = rng.poisson(1.1, n).astype(float)
    rows = [(int(c), None if np.isnan(u) else float(u), float(v), float(w), float(x)) for c, u, v, w, x in zip(at, a, b, y, z)]
    rows += [(-1, 1.0, 1.0, None, 2.0)]
    df = spark.createDataFrame(rows, "at long, a double, b double, y double, z double").repartition(4)
    got = fits.poisson_refits(df, "at", 6, ["a", "b"], ["y", "z"], reg, 0.05)
    for k in range(6):
        seen = at < k
        if not seen.any():
            assert np.allclose(got[:, k, 0], math.log(0.05))
            continue
        mean, spread = (np.array([f(a[seen & ~np.isnan(a)]), f(b[seen])]) for f in (np.mean, np.std))
        design = np.column_stack([np.ones(seen.sum()), (np.column_stack([np.nan_to_num(a), b])[seen] - mean) / spread])
        for t, goals in enumerate((y[seen], z[seen])):
            beta, ridge = np.r_[math.log(goals.mean()), 0, 0], reg * goals.sum() * np.diag([0, 1, 1])
            for _ in range(60):
                mu = np.exp(design @ beta)
                beta += np.linalg.solve(design.T @ (design * mu[:, None]) + ridge, design.T @ (goals - mu) - ridge @ beta)
            raw = np.r_[beta[0] - (beta[1:] * mean / spread).sum(), beta[1:] / spread]
            assert np.allclose(got[t, k], raw, atol=1e-8)
    single = ml.fit_poisson(df.filter("at < 3 and y is not null"), ["a", "b"], "y", ["at"], reg)
    assert np.array(single.coefficients) / np.array(single.stds) == pytest.approx(got[0, 3, 1:], rel=1e-4)


def plain_trees(bins, y, base, rounds, depth, step):
    """Boosting by trying every split of every node on the rows themselves."""
    margins, deviance = np.full(len(y), base), []
    loss = lambda m: 2 * np.mean(np.where(y > 0, y * (np.log(np.maximum(y, 1e-300)) - m), 0) - (y - np.exp(m)))
    for _ in range(rounds):
        deviance.append(loss(margins))
        g, h = np.exp(margins) - y, np.exp(margins)
        leaves, change = [np.arange(len(y))], np.zeros(len(y))
        for _ in range(depth):
            following = []
            for rows in leaves:
                best = (boosting.LEAST_GAIN, None)
                for j in range(bins.shape[1]):
                    for b in range(bins[:, j].max() + 1):
                        left, right = rows[bins[rows, j] <= b], rows[bins[rows, j] > b]
                        if len(left) and len(right):
                            part = lambda r: g[r].sum() ** 2 / (h[r].sum() + boosting.RIDGE)
                            gain = part(left) + part(right) - part(rows)
                            if gain > best[0] + 1e-12:
                                best = (gain, (left, right))
                if best[1]:
                    for r in best[1]:
                        change[r] = step * np.clip(-g[r].sum() / (h[r].sum() + boosting.RIDGE), -boosting.MOST_STEP, boosting.MOST_STEP)
                    following += best[1]
            leaves = following
        margins = margins + change
    return margins, [*deviance, loss(margins)]


def test_boosting_passes_over_blocks_and_few_trees(spark, tmp_path, monkeypatch):
    """A record per row, and ten trees walked through at every level, made a pass cost several times its sums."""
    records, most, made = [], [0], boosting._histogram
    monkeypatch.setattr(boosting, "_histogram", lambda tree, active, waiting, width: most.append(len(waiting)) or made(tree, active, waiting, width))
    monkeypatch.setattr(boosting, "cut_lineage", lambda df, cut=boosting.cut_lineage: records.append(cut(df)) or records[-1])
    df = spark.range(30_000).selectExpr("id % 7 AS a", "id % 5 AS b", "(id % 7 + id % 3) % 4 AS y").repartition(2)
    model = boosting.fit_poisson_trees(df, ["a", "b"], "y", rounds=5, depth=2, step=0.3)
    assert len(model.trees) == 5 and model.deviance[-1] < model.deviance[0]
    assert max(most) <= 2 and records[-1].count() < 20


def test_boosting_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BINS", 8)
    monkeypatch.setattr(boosting, "KEEP", 2)
    rng = np.random.default_rng(21)
    n = 240
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 4, n).astype(float), rng.uniform(size=n)])
    x[rng.uniform(size=n) < 0.1, 0] = np.nan
    y = rng.poisson(np.exp(0.3 + 0.4 * np.nan_to_num(x[:, 0]) - 0.3 * (x[:, 1] > 1))).astype(float)
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows + [(n, 0.1, 1.0, 0.5, None)], "id long, a double, b double, c double, y double").repartition(3)
    model = boosting.fit_poisson_trees(df, ["a", "b", "c"], "y", rounds=6, depth=3, step=0.3)
    bins = np.column_stack([np.where(np.isnan(x[:, j]), 0, np.searchsorted(model.cuts[j], x[:, j], "right") + 1) for j in range(3)])
    margins, deviance = plain_trees(bins, y, math.log(y.mean()), 6, 3, 0.3)
    assert model.deviance == pytest.approx(deviance)
    assert all(b < a for a, b in zip(model.deviance, model.deviance[1:]))
    got = {r.id: r.predicted for r in model.predict(df).collect()}
    assert [got[i] for i in range(n)] == pytest.approx(np.exp(margins)) and got[n] > 0
    flat = boosting.fit_poisson_trees(df.withColumn("y", F.lit(2.0)), ["a"], "y", rounds=5)
    assert not flat.trees and flat.predict(df).first().predicted == pytest.approx(2.0)
    with pytest.raises(ValueError):
        boosting.fit_poisson_trees(df.filter("y is null"), ["a"], "y")


def test_poisson_fit(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=500), rng.uniform(size=500)
    y = rng.poisson(np.exp(0.3 + 0.4 * a - 0.5 * b))
    df = spark.createDataFrame([(i, float(u), float(v), float(w)) for i, (u, v, w) in enumerate(zip(a, b, y))], "id long, a double, b double, y double")
    model = ml.fit_poisson(df, ["a", "b"], "y", ["id"])
    design = np.column_stack([np.ones(500), a, b])
    beta = np.zeros(3)
    for _ in range(50):
        mu = np.exp(design @ beta)
        beta += np.linalg.solve(design.T @ (design * mu[:, None]), design.T @ (y - mu))
    got = np.array([r.m for r in df.orderBy("id").select(model.rate().alias("m")).collect()])
    assert np.allclose(got, np.clip(np.exp(design @ beta), 0.05, 15), rtol=1e-5)


def test_scaling_anchor(spark):
    df = spark.range(1000).select("id", F.col("id").cast("double").alias("v"), (F.col("id") % 3).cast("double").alias("y"))
    means, stds = ml._scaling(df, ["v"], ["id"])
    assert means[0] == pytest.approx(499.5)
    means, stds = ml._scaling(df, ["v"], ["id"], anchor_rows=400)
    last = np.arange(600, 1000)
    assert means[0] == pytest.approx(last.mean()) and stds[0] == pytest.approx(last.std())


def test_negative_binomial(spark):
    rng = np.random.default_rng(8)
    y = rng.negative_binomial(4, 0.4, 800)
    df = spark.createDataFrame([(i, 1.0 + i % 3, float(v)) for i, v in enumerate(y)], "id long, a double, y double")
    model = ml.fit_negative_binomial(df, ["a"], "y", ["id"])
    assert model.alpha == pytest.approx(0.25, abs=0.08)
    row = df.limit(1).select(model.range_probability(0, 3, F.lit(6.0)).alias("p")).first()
    n, mu = 1 / model.alpha, 6.0
    q = n / (n + mu)
    want = sum(math.exp(math.lgamma(k + n) - math.lgamma(n) - math.lgamma(k + 1)) * q**n * (1 - q) ** k for k in range(4))
    assert row.p == pytest.approx(want, rel=1e-9)
    with pytest.raises(ValueError):
        model.range_probability(3, 1, F.lit(1.0))


def test_three_way_split(spark):
    def sizes(n):
        df = spark.range(n).withColumn("t", F.col("id").cast("double"))
        out = ml.split_by_fraction(df, ["t", "id"], test=0.2, validation=0.2)
        return {r.split: r["count"] for r in out.groupBy("split").count().collect()}

    assert sizes(10) == {"train": 6, "validation": 2, "test": 2}
    assert sizes(3) == {"train": 1, "validation": 1, "test": 1}
    with pytest.raises(ValueError):
        sizes(2)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.tuples(hs.floats(0.1, 5.0), hs.floats(0.1, 5.0)), min_size=1, max_size=8))
def test_goal_prices_are_coherent(spark, rates):
    df = spark.createDataFrame(rates, "home_xg double, away_xg double")
    for r in pr.price_goals(df).collect():
        assert 0.97 <= r.home_win + r.draw + r.away_win <= 1.03
        assert r.over_1_5 >= r.over_2_5 - 1e-9 and r.under_3_5 >= r.under_2_5 - 1e-9
        assert all(0.05 <= v <= 0.92 for k, v in r.asDict().items() if not k.endswith("xg"))


def test_quantiles_and_auc_with_many_values(spark):
    rng = np.random.default_rng(11)
    v, hit = np.round(rng.normal(size=400), 2), rng.integers(0, 2, 400)
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(v, hit)], "market string, probability double, hit double")
    for rows in (7, 10_000):  # chunked and plain
        q = g.exact_quantiles(df, "market", "probability", {"a": 0.25, "b": 0.9}, chunk_rows=rows).first()
        assert q.a == pytest.approx(np.quantile(v, 0.25)) and q.b == pytest.approx(np.quantile(v, 0.9))
        pos, neg = v[hit == 1], v[hit == 0]
        want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
        assert g.auc(df, "market", chunk_rows=rows).first().auc == pytest.approx(want)
        share = g.distribution(df, F.col("probability"), chunk_rows=rows).orderBy("value").collect()
        assert share[-1].cumulative == pytest.approx(1.0)


def test_ece_conventions(spark):
    rows = [(p, h) for p, h in ((0.0, 1.0), (0.3, 0.0), (0.30000000000000004, 1.0), (1.0, 0.0))]
    df = spark.createDataFrame(rows, "probability double, hit double")
    bins = {c: [r.b for r in df.select(g.bin_of(F.col("probability"), c).alias("b")).collect()] for c in "abcde"}
    assert bins == {
        "a": [0, 2, 3, None],
        "b": [None, 2, 2, 9],
        "c": [0, 2, 2, 9],
        "d": [0, 2, 3, 9],
        "e": [0, 3, 3, 9],
    }


def test_scalars(spark):
    df = spark.createDataFrame([(" FC Köln  ",), ("Atlético ĲSS",), (None,), ("Saint-Étienne AS",)], "n string")
    assert [r.v for r in df.select(x.join_name("n").alias("v")).collect()] == ["KOLN", "ATLETICO IJSS", "", "SAINT-ETIENNE"]
    df = spark.createDataFrame([("E0_2425",), ("2019_2020",), ("E0_2423",), ("E0_9900",)], "n string")
    got = df.select(x.season_from_file("n", F.lit("2024-03-01").cast("date")).alias("s")).collect()
    assert [r.s for r in got] == ["2024-25", "2019-20", "2023-24", "2023-24"]
    df = spark.createDataFrame([("31/12/2023",), ("01/02/24",), ("2024-03-04",), ("x",)], "n string")
    got = df.select(F.date_format(x.parse_day_first("n"), "yyyy-MM-dd").alias("d")).collect()
    assert [r.d for r in got] == ["2023-12-31", "2024-02-01", "2024-03-04", None]
