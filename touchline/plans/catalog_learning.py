"""Queries over splits, calibrators, count models and the end-to-end flows."""

from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import learning as ml
from ..operators import metrics as g
from ..session import cut_lineage
from . import flows
from .catalog_features import SOS, tw
from .catalog_joins import RESOLVE
from .catalog_metrics import BIN
from .registry import query, r6, rounded

ORDER = ["match_date", "match_id"]
INPUTS = ["home_goals_for_avg5", "home_goals_against_avg5", "away_goals_for_avg5", "away_goals_against_avg5", "home_rest_days", "h2h_avg_goals"]


def matrix(t, *inputs):
    """The matches with the fits' inputs as a written table, so fits do not replay its windows."""
    return cut_lineage(flows.feature_matrix(t.contests, ordered=False).select(*t.contests.columns, *(inputs or INPUTS)))


@query(
    "match_features",
    f"""WITH {SOS}, x AS (SELECT r.match_id, r.is_home, r.f, r.f - o.a AS att, o.f - r.a AS def FROM r JOIN r o ON r.match_id = o.match_id AND r.is_home <> o.is_home)
SELECT h.match_id, round(h.f, 6) AS home_goals_for_avg5, round(a.f, 6) AS away_goals_for_avg5, round(h.att, 6) AS home_sos_attack, round(a.def, 6) AS away_sos_defence, round(h.f - a.f, 6) AS delta_goals_for_avg5,
 round(h.att - a.att, 6) AS delta_sos_attack FROM x h JOIN x a ON h.match_id = a.match_id WHERE h.is_home = 1 AND a.is_home = 0""",
)
def _(t):
    names = ["home_goals_for_avg5", "away_goals_for_avg5", "home_sos_attack", "away_sos_defence", "delta_goals_for_avg5", "delta_sos_attack"]
    return rounded(flows.feature_matrix(t.contests, ordered=False).select("match_id", *names), *names)


@query(
    "feature_matrix_profile",
    f"""WITH q AS (SELECT is_home, avg(corners_for) OVER ({tw(10)}) AS c, avg(shots_for) OVER ({tw(5)}) AS s FROM team)
SELECT (SELECT count(*) FROM contests) AS matches, round(avg(c) FILTER (is_home = 1), 6) AS home_corners, round(avg(s) FILTER (is_home = 0), 6) AS away_shots FROM q""",
)
def _(t):
    out = flows.feature_matrix(t.contests, ordered=False).agg(
        F.count(F.lit(1)).alias("matches"), F.avg("home_corners_for_avg10").alias("home_corners"), F.avg("away_shots_for_avg5").alias("away_shots")
    )
    return rounded(out, "home_corners", "away_shots")


@query(
    "settlement_drift",
    f"""WITH {RESOLVE}, e AS (SELECT p.bet_id, l.league, p.p AS probability, CASE WHEN state = 'WON' THEN 1.0e0 ELSE 0.0e0 END AS hit FROM s JOIN p ON s.bet_id = p.bet_id JOIN ledger l ON s.bet_id = l.bet_id WHERE state IN ('WON', 'LOST')),
b AS (SELECT league, {BIN['c']} AS bin, count(*) AS n, sum(probability) AS p, sum(hit) AS y FROM e GROUP BY ALL), a AS (SELECT * FROM b UNION ALL SELECT 'GLOBAL', bin, sum(n), sum(p), sum(y) FROM b GROUP BY bin),
z AS (SELECT league, CAST(sum(n) AS BIGINT) AS n, sum(y) / sum(n) AS hr, sum(abs(p - y)) / sum(n) AS ece, sum(p) / sum(n) AS mc FROM a GROUP BY 1)
SELECT league, n, round(hr, 6) AS hit_rate, round(ece, 6) AS ece, CASE WHEN hr < 0.7 OR ece > 0.044 + 0.03 OR mc > 0.559 + 0.05 THEN 'STOP' ELSE 'GO' END AS status FROM z""",
)
def _(t):
    p = F.when(F.col("bet_id") % 29 == 0, F.lit(None)).when(F.col("bet_id") % 31 == 0, 1.5).otherwise(F.col("probability"))
    preds = t.ledger.select(
        "bet_id",
        "league",
        F.when(F.col("bet_id") % 41 != 0, F.col("match_id")).alias("match_hash"),
        F.col("market_key").alias("market"),
        p.alias("probability"),
        F.expr("CASE WHEN bet_id % 5 = 0 THEN ts + INTERVAL 40 YEAR ELSE ts END").alias("kickoff"),
    )
    results = t.contests.filter("match_id % 2 = 0").withColumnRenamed("match_id", "match_hash")
    _, state = flows.settle(preds, results, ["bet_id"])
    return rounded(state.select("league", "n", "hit_rate", "ece", "status"), "hit_rate", "ece")


@query(
    "c01_time_split",
    """WITH r AS (SELECT match_id, row_number() OVER (ORDER BY match_date, match_id) AS rn, count(*) OVER () AS n FROM contests)
SELECT match_id, CASE WHEN rn <= CAST(floor(n * (1 - 0.2)) AS BIGINT) THEN 'train' ELSE 'test' END AS two, CASE WHEN rn <= n - 2 * CAST(round(n * 0.15) AS BIGINT) THEN 'train' WHEN rn <= n - CAST(round(n * 0.15) AS BIGINT) THEN 'validation' ELSE 'test' END AS three FROM r""",
)
def _(t):
    two = ml.split_by_fraction(t.contests, ORDER, test=0.2).select("match_id", F.col("split").alias("two"))
    three = ml.split_by_fraction(t.contests, ORDER, test=0.15, validation=0.15).select("match_id", F.col("split").alias("three"))
    return two.join(three, "match_id")


@query(
    "c01_season_split",
    "SELECT o_orderkey, CASE WHEN year(o_orderdate) <= 1999 THEN 'train' WHEN year(o_orderdate) = 2000 THEN 'validation' ELSE 'test' END AS split FROM orders",
)
def _(t):
    # the split years are fixed; the test orders are 22 years older
    rows = t("orders").withColumn("season_year", F.year("o_orderdate") + 22)
    return ml.split_by_season(rows).select("o_orderkey", "split")


def newton_sql(counts: str, state: str, penalty: float, steps: int = 14) -> str:
    """Newton steps of a logistic line per market as one common table expression each; the last is ``{state}{steps}``."""
    texts = [f"{state}0 AS (SELECT market, ln(sum(pos) / (sum(n) - sum(pos))) AS a, 0.0e0 AS b FROM {counts} GROUP BY 1 HAVING sum(pos) > 0 AND sum(pos) < sum(n))"]
    for i in range(steps):
        texts.append(
            f"""{state}{i}s AS (SELECT c.market, a, b, sum(pos - n * p) AS g0, sum((pos - n * p) * x) - {penalty} * b AS g1, sum(n * p * (1 - p)) AS h0, sum(n * p * (1 - p) * x) AS h1, sum(n * p * (1 - p) * x * x) + {penalty} AS h2
 FROM (SELECT c.*, a, b, 1 / (1 + exp(-(a + b * x))) AS p FROM {counts} c JOIN {state}{i} s ON c.market = s.market) c GROUP BY c.market, a, b),
{state}{i + 1} AS (SELECT market, a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS a, b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b FROM {state}{i}s)"""
        )
    return ",\n".join(texts)


SETTLED = "SELECT market, probability, CASE WHEN outcome = 'WON' THEN 1.0e0 ELSE 0.0e0 END AS hit FROM ledger WHERE outcome <> 'VOID'"


@query(
    "c02_fit_calibrators",
    # The isotonic level of the i-th score is the largest, over starts up to i, of the least mean that a run from there to
    # i or beyond can have.
    f"""WITH q AS ({SETTLED}), c AS (SELECT market, probability AS x, CAST(count(*) AS DOUBLE) AS n, sum(hit) AS pos FROM q GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM c WINDOW w AS (PARTITION BY market ORDER BY x)),
r AS (SELECT f.market, f.i AS f, t.i AS t, (t.cp - f.cp + f.pos) / (t.cn - f.cn + f.n) AS m FROM o f JOIN o t ON f.market = t.market AND f.i <= t.i),
l AS (SELECT market, f, t, min(m) OVER (PARTITION BY market, f ORDER BY t DESC) AS least FROM r), y AS (SELECT market, t AS i, max(least) AS y FROM l GROUP BY 1, 2),
iso AS (SELECT o.*, greatest(least(y, 1 - 1e-6), 1e-6) AS iso, abs(coalesce(y - lag(y) OVER v, 1)) > 1e-12 AS opens, abs(coalesce(lead(y) OVER v - y, 1)) > 1e-12 AS closes FROM o JOIN y USING (market, i) WINDOW v AS (PARTITION BY market ORDER BY i)),
{newton_sql("c", "s", 1.0)},
e AS (SELECT iso.*, greatest(least(1 / (1 + exp(-(a + b * greatest(least(x, 1 - 1e-6), 1e-6)))), 1 - 1e-6), 1e-6) AS line FROM iso JOIN s14 USING (market)),
u AS (SELECT market, 'iso' AS kind, iso AS probability, n, pos FROM e UNION ALL SELECT market, 'line', line, n, pos FROM e),
b AS (SELECT market, kind, {BIN['a']} AS bin, sum(n) AS n, sum(probability * n) AS p, sum(pos) AS y FROM u GROUP BY ALL),
k AS (SELECT market, kind, coalesce(sum(CASE WHEN bin IS NOT NULL THEN abs(p - y) END), 0) / sum(n) AS ece FROM b GROUP BY ALL),
z AS (SELECT market, max(CASE WHEN kind = 'iso' THEN ece END) AS iso_ece, max(CASE WHEN kind = 'line' THEN ece END) AS line_ece FROM k GROUP BY 1),
a AS (SELECT market, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CAST(opens OR closes AS INT)) AS INT) AS knots, sum(iso * n) / sum(n) AS iso, sum(line * n) / sum(n) AS line FROM e GROUP BY 1)
SELECT market, CASE WHEN line_ece < iso_ece THEN 'platt' ELSE 'isotonic' END AS kind, n, round(least(line_ece, iso_ece), 6) AS ece, CASE WHEN line_ece < iso_ece THEN 0 ELSE knots END AS knots,
 round(CASE WHEN line_ece < iso_ece THEN line ELSE iso END, 6) AS mean_calibrated FROM z JOIN a USING (market)""",
)
def _(t):
    fitted = ml.fit_calibrators(g.settled(t.ledger))
    out = ml.apply_calibrators(g.settled(t.ledger), fitted)
    mean = out.groupBy("market").agg(F.avg("calibrated").alias("mean_calibrated"))
    return rounded(ml.calibrator_table(fitted).join(mean, "market"), "ece", "mean_calibrated")


@query("c07_fit_poisson")
def _(t):
    rows = matrix(t)
    model = ml.fit_poisson(rows, INPUTS, "home_goals", ORDER, reg=0.01)
    return rounded(rows.select("match_id", model.rate().alias("home_rate")), "home_rate")


@query("c08_fit_negative_binomial")
def _(t):
    inputs = ["home_corners_for_avg5", "away_corners_against_avg5"]
    rows = matrix(t, *inputs)
    model = ml.fit_negative_binomial(rows, inputs, "home_corners", ORDER)
    scored = rows.withColumn("rate", model.rate())
    out = scored.select("match_id", "rate", model.range_probability(0, 5, F.col("rate")).alias("p_0_5"), model.range_probability(6, 12, F.col("rate")).alias("p_6_12"))
    return rounded(out, "rate", "p_0_5", "p_6_12")


def zeros(*names):
    """A fit is convex, so scores of 0 say that it is the optimum; the rows counted are those with a target."""
    listed = ", ".join(f"('{n}')" for n in names)
    return "SELECT input, 0.0e0 AS score, (SELECT count({target}) FROM contests) AS matches FROM (VALUES " + listed + ") v(input)"


def scores(rows, model, target, reg=0.0, **options):
    out = ml.optimality(model, rows, target, reg, **options)
    matches = rows.agg(F.count(target).alias("n")).scalar()
    return out.select("input", F.abs(F.round("score", 4)).alias("score"), matches.alias("matches"))


@query("c07_optimality", zeros("intercept", *INPUTS).format(target="home_goals"))
def _(t):
    rows = matrix(t)
    return scores(rows, ml.fit_poisson(rows, INPUTS, "home_goals", ORDER, reg=0.01), "home_goals", 0.01)


@query("c08_optimality", zeros("intercept", "home_corners_for_avg5", "away_corners_against_avg5", "dispersion").format(target="home_corners"))
def _(t):
    inputs = ["home_corners_for_avg5", "away_corners_against_avg5"]
    rows = matrix(t, *inputs)
    return scores(rows, ml.fit_negative_binomial(rows, inputs, "home_corners", ORDER), "home_corners", dispersion=True)


@query("c09_boosted_counts")
def _(t):
    rows = matrix(t)
    out = ml.fit_boosted(rows.filter("season <> 'S3'"), rows.filter("season = 'S3'"), INPUTS, "home_goals", rounds=20, depth=4, step=0.1)
    return rounded(out, "mae", "rmse", "r2", "bias", "scored_brier")


@query("c09_outcome_model")
def _(t):
    h, a = F.col("home_goals"), F.col("away_goals")
    rows = matrix(t).withColumn("actual", F.when(h > a, "H").when(h == a, "D").otherwise("A"))
    _, out = ml.fit_outcome(rows.filter("season <> 'S3'"), rows.filter("season = 'S3'"), INPUTS, trees=40)
    return rounded(out, "accuracy", "log_loss", "brier")


@query("c11_walk_forward")
def _(t):
    rows = matrix(t)
    # A refit per day of the test season.
    scored = ml.walk_forward(rows, INPUTS, ORDER, F.col("season") == "S3", period=F.to_date("match_date"))
    h, a = F.col("home_goals"), F.col("away_goals")
    from ..functions.scalars import multiclass_brier, outcome_of

    scored = scored.withColumns(
        {"actual": F.when(h > a, "H").when(h == a, "D").otherwise("A"), "pick": outcome_of("home_win", "draw", "away_win")}
    )
    wilson = g.wilson(scored, F.col("actual") == F.col("pick"), "actual")
    brier = scored.agg(F.avg(multiclass_brier("home_win", "draw", "away_win", "actual")).alias("brier")).scalar()
    return rounded(wilson.withColumn("brier", brier), "accuracy", "baseline", "low", "high", "brier")


@query(
    "c12_calibration_slope",
    f"""WITH q AS ({SETTLED}), h AS (SELECT market, 0.5e0 + 0.3e0 * (probability - 0.5e0) AS p, hit, probability FROM q),
c AS (SELECT market, ln(greatest(least(p, 0.99e0), 0.01e0) / (1 - greatest(least(p, 0.99e0), 0.01e0))) AS x, CAST(count(*) AS DOUBLE) AS n, sum(hit) AS pos FROM h GROUP BY 1, 2),
{newton_sql("c", "s", 0.0)},
m AS (SELECT market, avg((p - hit) * (p - hit)) AS brier, avg((probability - hit) * (probability - hit)) AS now FROM h GROUP BY 1)
SELECT market, round(b, 6) AS slope, round(brier, 6) AS brier, round(now - brier, 6) AS gain, now - brier >= 0.001 AND b BETWEEN 0.8 AND 1.2 AS adopted FROM m JOIN s14 USING (market)""",
)
def _(t):
    rows = g.settled(t.ledger)
    shrunk = rows.withColumn("probability", 0.5 + 0.3 * (F.col("probability") - 0.5))
    out = ml.adopt(ml.calibration_slopes(shrunk), g.brier(rows, ["market"]))
    return rounded(out.select("market", "slope", "brier", "gain", "adopted"), "slope", "brier", "gain")


@query(
    "c13_training_sets",
    """SELECT coalesce(league, 'GLOBAL') AS league, count(*) AS rows, count(*) FILTER (home_corners IS NOT NULL AND referee IS NOT NULL) AS usable, count(*) >= 1000 AS trainable FROM contests GROUP BY ROLLUP (league)""",
)
def _(t):
    return ml.training_sets(t.contests, ["home_corners", "referee"])


@query("u03_python_model", "SELECT match_id, round(exp(0.1 + 0.05 * home_shots - 0.02 * away_shots), 6) AS prediction FROM contests")
def _(t):
    import numpy as np

    rows = t.contests.select("match_id", "home_shots", "away_shots")
    out = ml.score_batches(rows, lambda x: np.exp(0.1 + 0.05 * x["home_shots"] - 0.02 * x["away_shots"]), ["home_shots", "away_shots"])
    return out.select("match_id", r6("prediction").alias("prediction"))


@query(
    "u04_custom_aggregates",
    """WITH s AS (SELECT market, probability, CASE WHEN outcome = 'WON' THEN 1.0e0 ELSE 0.0e0 END AS hit FROM ledger WHERE outcome <> 'VOID')
SELECT market, count(*) AS n, round(avg((probability - hit) * (probability - hit)), 6) AS brier, round(avg(probability) - avg(hit), 6) AS gap FROM s GROUP BY 1""",
)
def _(t):
    rows = g.settled(t.ledger)
    out = g.brier(rows, ["market"]).select("market", "n", "brier").join(g.ece(rows, ["market"], "a").select("market", "gap"), "market")
    return rounded(out, "brier", "gap")
