"""The whole feature matrix, every column of it held against SQL."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flows
from .catalog_features import tw
from .registry import query

# Shrunk means often end in a 5 at the seventh digit; this pushes both sides over it alike, whatever their last bit.
TIE = 3.14159e-8
PAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
MEANS = [f"{c}_avg{w}" for w in (5, 10) for c in flows.RATES]
SIDE = MEANS + ["sos_attack", "sos_defence", "rest_days", "clean_sheet_rate", "goals_dominance", "shots_dominance", "pressure_index"]
SIDE += ["home_advantage", *(f"{c}_season" for c in flows.RATES), "season_goal_diff", "form", "win_streak", "unbeaten_streak", "congestion"]
H2H = ["h2h_count", "h2h_avg_goals", "h2h_avg_cards", "h2h_avg_corners"]
H2H += ["h2h_over_2_5_rate", "h2h_btts_rate", "h2h_cards_over_2_5_rate", "h2h_corners_under_11_5_rate"]
MATCH_TEXTS = ["league", "season", "home_team", "away_team", "referee", "status", "referee_key", "season_phase"]
MATCH_NUMBERS = [f"{side}_{m}" for side in ("home", "away") for m in ("goals", "corners", "cards", "shots")]
MATCH_NUMBERS += ["referee_card_rate", *H2H, "days_since_h2h", "day_of_week", "season_progress", "is_weekend"]


def _numbers():
    """Output name of every number and its SQL over the joined sides ``h`` and ``a`` and the match ``m``."""
    out = {name: f"m.{name}" for name in MATCH_NUMBERS}
    for side in ("home", "away"):
        out |= {f"{side}_{c}": f"{side[0]}.{c}" for c in SIDE}
        out |= {f"{side}_{c}_missing": f"CAST({side[0]}.{c} IS NULL AS INT)" for c in MEANS}
    for c in SIDE:
        out[f"delta_{c}"] = f"h.{c} - a.{c}"
        out[f"abs_delta_{c}"] = f"abs(h.{c} - a.{c})"
    return out


TIMES = {"match_date": "m.match_date", "home_max_source_date5": "h.source", "away_max_source_date5": "a.source"}


def _season(c):
    prev = f"coalesce(z.p_{c}, g.m_{c})"
    return f"CASE WHEN n_{c} = 0 THEN {prev} ELSE (coalesce(s_{c}, 0) + {prev} * 5) / (n_{c} + 5) END AS {c}_season"


SIDES = f"""
n AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY match_date, match_id) AS rn FROM team),
k AS (SELECT a.match_id, a.is_home, count(b.match_id) AS congestion FROM team a LEFT JOIN team b ON a.team = b.team
 AND b.match_date < a.match_date AND b.match_date > a.match_date - INTERVAL 7 DAY GROUP BY 1, 2),
g AS (SELECT {", ".join(f"avg({c}) AS m_{c}" for c in flows.RATES)} FROM team),
y AS (SELECT team, season, {", ".join(f"avg({c}) AS y_{c}" for c in flows.RATES)} FROM team GROUP BY 1, 2),
z AS (SELECT team, season, {", ".join(f"lag(y_{c}) OVER (PARTITION BY team ORDER BY season) AS p_{c}" for c in flows.RATES)} FROM y),
w AS (SELECT match_id, is_home, team, season, {", ".join(f"avg({c}) OVER w{w} AS {c}_avg{w}" for w in (5, 10) for c in flows.RATES)},
 max(match_date) OVER w5 AS source,
 least(coalesce(floor((epoch_us(match_date) - epoch_us(lag(match_date) OVER (PARTITION BY team ORDER BY match_date, match_id))) / 86400000000), 7), 21) AS rest_days,
 coalesce(avg(CAST(goals_against = 0 AS INT)) OVER w5, 0) AS clean_sheet_rate,
 coalesce(sum(goals_for) OVER w5 / nullif(sum(goals_for) OVER w5 + sum(goals_against) OVER w5, 0), 0.5) AS goals_dominance,
 coalesce(sum(shots_for) OVER w5 / nullif(sum(shots_for) OVER w5 + sum(shots_against) OVER w5, 0), 0.5) AS shots_dominance,
 avg(shots_for) OVER w5 - avg(shots_against) OVER w5 AS ds, avg(corners_for) OVER w5 - avg(corners_against) OVER w5 AS dc,
 coalesce(avg(CASE WHEN is_home = 1 THEN goals_for END) OVER wt, 1.5) - coalesce(avg(CASE WHEN is_home = 0 THEN goals_for END) OVER wt, 1.0) AS home_advantage,
 list(CAST(points AS DOUBLE)) OVER wt AS l,
 rn - 1 - coalesce(max(CASE WHEN points < 3 THEN rn END) OVER wt, 0) AS win_streak,
 rn - 1 - coalesce(max(CASE WHEN points < 1 THEN rn END) OVER wt, 0) AS unbeaten_streak,
 coalesce(sum(goals_for - goals_against) OVER ws, 0) AS season_goal_diff,
 {", ".join(f"sum({c}) OVER ws AS s_{c}, count({c}) OVER ws AS n_{c}" for c in flows.RATES)}
 FROM n WINDOW w5 AS ({tw(5)}), w10 AS ({tw(10)}), wt AS (PARTITION BY team ORDER BY match_date, match_id {PAST}),
 ws AS (PARTITION BY team, season ORDER BY match_date, match_id {PAST})),
o AS (SELECT match_id, 1 - is_home AS is_home, goals_for_avg5 AS of, goals_against_avg5 AS oa FROM w),
e AS (SELECT w.*, goals_for_avg5 - o.oa AS sos_attack, o.of - goals_against_avg5 AS sos_defence, coalesce(ds + 0.7 * dc, dc) AS pressure_index,
 CASE WHEN l IS NULL OR len(l) = 0 THEN 1.5 ELSE list_reduce(l, lambda q, x: q * 0.9 + x * 0.1) END AS form, k.congestion,
 {", ".join(_season(c) for c in flows.RATES)}
 FROM w JOIN o USING (match_id, is_home) JOIN k USING (match_id, is_home) JOIN z USING (team, season) CROSS JOIN g)"""

MATCHES = f"""
c AS (SELECT *, least(home_team, away_team) || '__vs__' || greatest(home_team, away_team) AS pair, home_goals + away_goals AS tg,
 home_cards + away_cards AS tk, coalesce(home_corners, 0) + coalesce(away_corners, 0) AS tc,
 coalesce(nullif(trim(referee), ''), 'UNKNOWN') AS referee_key FROM contests),
v AS (SELECT avg(home_cards) + avg(away_cards) AS mk, avg(home_corners) + avg(away_corners) AS mc, avg(tk) AS mr FROM c),
j AS (SELECT *, count(*) OVER p AS h2h_count, count(*) OVER (PARTITION BY pair) AS meetings, sum(tg) OVER p AS sg, sum(tk) OVER p AS sk,
 sum(tc) OVER p AS sc, coalesce(sum(CAST(tg > 2.5 AS INT)) OVER p, 0) AS h1,
 coalesce(sum(CAST(home_goals > 0 AND away_goals > 0 AS INT)) OVER p, 0) AS h2, coalesce(sum(CAST(tk > 2.5 AS INT)) OVER p, 0) AS h3,
 coalesce(sum(CAST(tc < 11.5 AS INT)) OVER p, 0) AS h4,
 floor((epoch_us(match_date) - epoch_us(lag(match_date) OVER (PARTITION BY pair ORDER BY match_date, match_id))) / 86400000000) AS days_since_h2h,
 avg(tk) OVER (PARTITION BY referee_key ORDER BY match_date, match_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS rr,
 isodow(match_date) - 1 AS day_of_week, ((month(match_date) - 8 + 12) % 12) / 12 AS season_progress
 FROM c WINDOW p AS (PARTITION BY pair ORDER BY match_date, match_id {PAST})),
m AS (SELECT *, coalesce(rr, mr) AS referee_card_rate, coalesce(sg / nullif(h2h_count, 0), 2.5) AS h2h_avg_goals,
 coalesce(sk / nullif(h2h_count, 0), mk) AS h2h_avg_cards, coalesce(sc / nullif(h2h_count, 0), mc) AS h2h_avg_corners,
 CASE WHEN meetings > 1 THEN h1 / (h2h_count + 1) ELSE 0.53 END AS h2h_over_2_5_rate,
 CASE WHEN meetings > 1 THEN h2 / (h2h_count + 1) ELSE 0.54 END AS h2h_btts_rate,
 CASE WHEN meetings > 1 THEN h3 / (h2h_count + 1) ELSE 0.77 END AS h2h_cards_over_2_5_rate,
 CASE WHEN meetings > 1 THEN h4 / (h2h_count + 1) ELSE 0.72 END AS h2h_corners_under_11_5_rate, CAST(day_of_week >= 5 AS INT) AS is_weekend,
 CASE WHEN season_progress <= 0.33 THEN 'early' WHEN season_progress <= 0.66 THEN 'mid' ELSE 'late' END AS season_phase FROM j CROSS JOIN v)"""


def rounded6(x):
    """``round(x, 6)`` of a double, which makes a decimal number of each; beyond the whole numbers of a double it still does."""
    return F.when(F.abs(x) < 1e9, F.rint(x * 1e6) / 1e6).otherwise(F.round(x, 6))


@query(
    "feature_matrix_full",
    f"WITH {SIDES}, {MATCHES} SELECT m.match_id, {', '.join(f'm.{c}' for c in MATCH_TEXTS)}, "
    + "".join(f"CAST(epoch_us({sql}) AS DOUBLE) AS {name}, " for name, sql in TIMES.items())
    + ", ".join(f"round(CAST({sql} AS DOUBLE) + {TIE}, 6) AS {name}" for name, sql in _numbers().items())
    + " FROM m JOIN e h ON m.match_id = h.match_id AND h.is_home = 1 JOIN e a ON m.match_id = a.match_id AND a.is_home = 0",
)
def _(t):
    """Every column; times as microseconds, all numbers but the id as doubles, so that one rule rounds both sides."""
    out = flows.feature_matrix(t.contests)

    def shown(f):
        if f.name == "match_id" or isinstance(f.dataType, T.StringType):
            return F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            return F.unix_micros(f.name).cast("double").alias(f.name)
        return rounded6(F.col(f.name).cast("double") + F.lit(TIE)).alias(f.name)

    return out.select(*[shown(f) for f in out.schema])
