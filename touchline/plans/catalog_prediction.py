"""The prediction flow, from features to gated predictions, held against one SQL text."""

from pyspark.sql import functions as F

from ..operators import metrics as g
from ..operators import pricing as pr
from ..operators import selection as k
from . import flows
from .catalog_features import tw
from .catalog_matrix import MEANS
from .catalog_metrics import OFFSETS
from .catalog_pricing import CORNER_VIEW, GOAL_VIEW, H2H, INTENSE, POIS, ZIP_VIEW
from .registry import query, rounded


def _case(column, table, other):
    return f"CASE {column} " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in table.items()) + f" ELSE {other} END"


def _limits(low, value, high):
    return f"greatest(least({value}, {high}), {low})"


# rr: both models' rates joined, counts adjusted; the views of the single operators then read it in place of ``rates``
RATES = f"""
side AS (SELECT match_id, is_home, {", ".join(f"avg({c}) OVER ({tw(w)}) AS {c}_avg{w}" for w in (5, 10) for c in flows.RATES)} FROM team),
gaps AS (SELECT match_id, sum({" + ".join(f"CAST({c} IS NULL AS INT)" for c in MEANS)}) AS miss FROM side GROUP BY 1),
two AS (SELECT r.match_id, mu_home_corners, mu_away_corners, mu_cards, {_limits(0.05, "home_xg", 4.0)} AS h1, {_limits(0.05, "away_xg", 4.0)} AS a1,
  {_limits(0.05, "(coalesce(h.goals_for_avg5, 1.35) + coalesce(a.goals_against_avg5, 1.35)) / 2", 4.0)} AS h2,
  {_limits(0.05, "(coalesce(a.goals_for_avg5, 1.35) + coalesce(h.goals_against_avg5, 1.35)) / 2", 4.0)} AS a2
  FROM rates r JOIN side h ON r.match_id = h.match_id AND h.is_home = 1 JOIN side a ON r.match_id = a.match_id AND a.is_home = 0),
b1 AS (SELECT h.*, {_limits(0.05, "0.6 * h1 + 0.4 * h2", 4.0)} AS lh, {_limits(0.05, "0.6 * a1 + 0.4 * a2", 4.0)} AS la,
  mu_home_corners * exp(coalesce(x.home_corners_bias, 0)) AS mh, mu_away_corners * exp(coalesce(y.away_corners_bias, 0)) AS ma,
  mu_cards * exp(coalesce(x.home_cards_bias, 0) + coalesce(y.away_cards_bias, 0)) AS mc
  FROM h2h h JOIN two ON h.match_id = two.match_id LEFT JOIN o x ON h.league = x.league AND h.home_team = x.team LEFT JOIN o y ON h.league = y.league AND h.away_team = y.team),
b2 AS (SELECT *, {INTENSE} AS hot, CASE WHEN n >= 2 THEN least((1 - least(n / 5, 0.4)) * (mh + ma) + least(n / 5, 0.4) * avg_corners, mh + ma + 2) / (mh + ma) ELSE 1 END AS s,
  CASE WHEN n >= 3 AND 0.77 > cards_rate + 0.2 THEN least((1 - least(n / 5, 0.6)) * 0.77 + least(n / 5, 0.6) * cards_rate, 0.77 + CASE WHEN n >= 8 THEN 0.1 ELSE 0.05 END) END AS cap FROM b1),
rr AS (SELECT match_id, lh AS home_xg, la AS away_xg, mh * s AS mu_home_corners, ma * s AS mu_away_corners, CASE WHEN hot THEN 1.3 * {pr.INTENSITY} ELSE 1.3e0 END AS spread,
  CASE WHEN n >= 2 THEN (1 - least(n / 5, 0.5)) * mc + least(n / 5, 0.5) * avg_cards ELSE mc END AS mu_cards, cap FROM b2 WHERE league <> 'click')"""

_OWN = lambda text: text.replace("FROM rates", "FROM rr")
CORNERS = _OWN(CORNER_VIEW).replace("_corners * 1.3 *", "_corners * spread *")

PRICES = f"""
p1 AS (SELECT g.*, r.home_xg AS lh, r.away_xg AS la, n, o25_rate AS rate, (1 - least(n / 5, 0.5)) * over_2_5 + least(n / 5, 0.5) * o25_rate AS bl, CASE WHEN n >= 8 THEN 0.1e0 ELSE 0.05e0 END AS ml
  FROM g JOIN rr r ON g.match_id = r.match_id JOIN h2h ON g.match_id = h2h.match_id),
p2 AS (SELECT *, CASE WHEN n >= 6 AND abs(over_2_5 - rate) > 0.15 THEN CASE WHEN bl - over_2_5 > ml THEN over_2_5 + ml ELSE bl END ELSE over_2_5 END AS ov FROM p1),
p3 AS (SELECT *, least(ov / over_2_5, 1) AS f, CASE WHEN abs(home_win + draw + away_win - 1) > 0.05 THEN home_win + draw + away_win ELSE 1 END AS dv FROM p2),
p4 AS (SELECT match_id, home_win, draw, away_win, over_1_5 * greatest(f, 0.85) AS o15r, least((1 - ov) + 0.25 * ({POIS.format(r='lh + la')}) - (1 - ov)), 0.66) AS u25,
  least((1 - (1 - under_3_5) * f) + 0.25 * ({POIS.format(r='lh + la')} + pow(lh + la, 3) / 6) - (1 - (1 - under_3_5) * f)), 0.85) AS u35,
  least(btts_yes * greatest(f, 0.9) + 0.25 * ((1 - exp(-lh)) * (1 - exp(-la)) - btts_yes * greatest(f, 0.9)), 0.65) AS btts, least(home_under_1_5, 0.8) AS home_u15, least(away_under_1_5, 0.8) AS away_u15,
  least((home_win + draw) / dv, 1) AS dc_1x, least((draw + away_win) / dv, 1) AS dc_x2, least((home_win + away_win) / dv, 1) AS dc_12 FROM p3),
p5 AS (SELECT p4.*, 1 - u25 AS o25, 1 - btts AS btts_no, greatest(o15r, 1 - u25) AS o15, home_u15 AS home_under_1_5, away_u15 AS away_under_1_5, corners_under_11_5, corners_over_7_5,
  coalesce(rr.cap, z.cards_over_2_5) AS cards_over_2_5, cards_under_4_5, cards_under_5_5 FROM p4 JOIN co ON p4.match_id = co.match_id JOIN z ON p4.match_id = z.match_id JOIN rr ON p4.match_id = rr.match_id),
mr AS ({" UNION ALL ".join(f"SELECT match_id, '{m}' AS market, {c} AS p FROM p5" for c, m in flows.PREDICTED.items())})"""

ZERO = 1 - pr.CARD_ZERO_MASS
GATES = f"""
c1 AS (SELECT mr.match_id, mr.market, p, h.league, c.match_date, n, days, miss, coalesce(nullif(trim(c.referee), ''), 'UNKNOWN') <> 'UNKNOWN' AS known,
  CASE WHEN market LIKE 'corn%' THEN mu_home_corners + mu_away_corners WHEN market LIKE 'card%' THEN mu_cards * {ZERO} ELSE home_xg + away_xg END AS mu,
  CASE WHEN market LIKE 'corn%' THEN (mu_home_corners + mu_away_corners) * spread WHEN market LIKE 'card%' THEN mu_cards * {ZERO} * (1 + {pr.CARD_ZERO_MASS} * mu_cards) ELSE home_xg + away_xg END AS vr,
  {_case("market", pr.BASELINES, "0.5e0")} AS base FROM mr JOIN rr ON mr.match_id = rr.match_id JOIN h2h h ON mr.match_id = h.match_id JOIN gaps ON mr.match_id = gaps.match_id JOIN contests c ON mr.match_id = c.match_id),
c2 AS (SELECT *, 1 - exp(-sqrt(vr) / greatest(mu, 0.01)) AS u,
  CASE WHEN n = 0 AND miss >= 3 THEN 0.3 ELSE {_limits(0.3, "0.4 * CASE WHEN n >= 5 THEN least(n / 10, 1) WHEN n > 0 THEN 0.6 * n / 5 ELSE 0 END + 0.3 * CASE WHEN days >= 0 THEN exp(-days / 365) ELSE 1 END + 0.3 * exp(-0.35 * miss)", 1)} END AS drs,
  {_limits(0.5, _case("market", pr.MARKET_STABILITY, "0.75") + " - CASE WHEN NOT known AND market LIKE '%card%' THEN 0.15 ELSE 0 END", 1)} AS mss,
  {_limits(0.4, "1 - (0.6 * (greatest(p, base, 0.5) - least(p, base, 0.5)) + 0.4 * list_stddev_pop([p, base, 0.5e0]))", 1)} AS mas FROM c1),
c3 AS (SELECT *, pow(drs * mss * mas * exp(-0.5) * (1 - u), 0.85) AS confidence FROM c2),
c4 AS (SELECT *, CASE WHEN market LIKE 'corn%' THEN least(p, {_limits(0.72, "0.75 + 0.15 * confidence", 0.82)}) WHEN market LIKE 'card%' THEN least(p, {_limits(0.72, "0.70 + 0.18 * confidence", 0.82)}) ELSE p END AS q FROM c3),
c5 AS (SELECT *, match_id || '-' || market AS prediction_id, CASE WHEN market LIKE '%card%' THEN 0.70 WHEN market LIKE '%corn%' THEN 0.85 WHEN market LIKE '%double%' THEN 0.77
  WHEN market IN ('home_win', 'draw', 'away_win') THEN 0.73 WHEN market LIKE '%goals%' OR market LIKE '%over%' OR market LIKE '%under%' OR market LIKE '%btts%' THEN 0.74 ELSE 0.75 END AS fl,
  q - CASE WHEN market LIKE '%double_chance%' THEN {k.DOUBLE_CHANCE_BASELINE} ELSE {_case("market", k.GATE_BASELINES, k.UNKNOWN_BASELINE)} END AS e FROM c4),
c6 AS (SELECT *, CASE WHEN q < fl THEN 'GATE_2_PROB_FLOOR' WHEN e < 0.08 THEN 'GATE_3_LOW_EDGE' END AS st, q * (1 + e) AS score FROM c5),
c7 AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY st IS NOT NULL, score DESC, prediction_id) AS rm FROM c6),
c8 AS (SELECT *, row_number() OVER (PARTITION BY CAST(match_date AS DATE) ORDER BY st IS NOT NULL OR rm > 1, score DESC, prediction_id) AS rt FROM c7)"""


@query(
    "prediction_flow",
    f"""WITH {H2H}, {OFFSETS.format(src='contests', team='team')}, {RATES}, {_OWN(GOAL_VIEW)}, {CORNERS}, {_OWN(ZIP_VIEW)}, {PRICES}, {GATES}
SELECT match_id, market, round(p, 6) AS raw_probability, round(q, 6) AS probability, round(confidence, 6) AS confidence,
 CASE WHEN confidence >= 0.8 THEN 'AUTO_BET' WHEN confidence >= 0.7 THEN 'REDUCED_STAKE' WHEN confidence >= 0.6 THEN 'MANUAL_REVIEW' ELSE 'NO_BET' END AS action_tier,
 round(CASE WHEN st IS NULL THEN score END, 6) AS gate_score,
 coalesce(st, CASE WHEN rm > 1 THEN 'GATE_5_CORRELATION_BLOCK' WHEN rt > {k.DAILY_LIMIT} THEN 'GATE_6_DAILY_LIMIT' ELSE 'PASSED' END) AS stage FROM c8""",
)
def _(t):
    """All matches as fixtures of their day; one league is stopped, the others take the state of all together."""
    out = flows.predict(fixtures(t), g.team_offsets(t.contests), stopped(t), ("home_xg", "away_xg"), ("trail_home", "trail_away"), "slate")
    names = ["raw_probability", "probability", "confidence", "gate_score"]
    return rounded(out.select("match_id", "market", *names, "action_tier", "stage"), *names)


def fixtures(t):
    """Matrix rows with a model's rates, and a second model that reads trailing means of the matrix."""
    matrix = flows.feature_matrix(t.contests, impute=True, ordered=False)
    trail = {f"trail_{a}": (F.col(f"{a}_goals_for_avg5") + F.col(f"{b}_goals_against_avg5")) / 2 for a, b in (("home", "away"), ("away", "home"))}
    return matrix.withColumns({**trail, "slate": F.to_date("match_date")}).join(t.rates.drop("league"), "match_id")


def stopped(t):
    own = t.contests.filter(F.col("league") == "click").select("league").distinct().withColumn("status", F.lit("STOP"))
    every = t.contests.agg(F.lit("GLOBAL").alias("league"), F.lit("GO").alias("status"))
    return own.unionByName(every)
