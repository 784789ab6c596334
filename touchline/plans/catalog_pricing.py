"""Queries over prices and price adjustments."""

from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import joins as j
from ..operators import metrics as g
from ..operators import pricing as pr
from .catalog_metrics import OFFSETS
from .registry import query, r6, rounded

# Brute-force grids: every cell of the score matrix, grouped by match.
GRID = """gp AS (SELECT match_id, greatest(least(home_xg, 3.5), 0.2) AS lh, greatest(least(away_xg, 3.5), 0.2) AS la, home_xg, away_xg FROM rates),
gc AS (SELECT match_id, lh, la, h, a, exp(-lh) * pow(lh, h) / factorial(CAST(h AS INT)) * exp(-la) * pow(la, a) / factorial(CAST(a AS INT)) *
  CASE WHEN h = 0 AND a = 0 THEN 1 - lh * la * -0.13 WHEN h = 1 AND a = 0 THEN 1 + la * -0.13 WHEN h = 0 AND a = 1 THEN 1 + lh * -0.13 WHEN h = 1 AND a = 1 THEN 1.13 ELSE 1 END AS p
  FROM gp, range(0, 11) th(h), range(0, 11) ta(a)),
gs AS (SELECT match_id, sum(p) AS z, sum(CASE WHEN h > a THEN p ELSE 0 END) AS hw, sum(CASE WHEN h = a THEN p ELSE 0 END) AS d, sum(CASE WHEN h < a THEN p ELSE 0 END) AS aw,
  sum(CASE WHEN h + a > 2.5 THEN p ELSE 0 END) AS o25, sum(CASE WHEN h + a > 1.5 THEN p ELSE 0 END) AS o15, sum(CASE WHEN h + a < 3.5 THEN p ELSE 0 END) AS u35,
  sum(CASE WHEN h > 0 AND a > 0 THEN p ELSE 0 END) AS b, sum(CASE WHEN h <= 1 THEN p ELSE 0 END) AS hu, sum(CASE WHEN a <= 1 THEN p ELSE 0 END) AS au FROM gc GROUP BY 1)"""


def damp(e, alpha=0.8, to="0.5"):
    return f"({to} + {alpha} * (({e}) - {to}))"


def bound(e, hi=0.92):
    return f"greatest(least({e}, {hi}), 0.05)"


THIRD = "(1.0e0 / 3)"
GOAL_SQL = {
    "home_win": bound(damp("hw / z", 0.8, THIRD)),
    "draw": bound(damp("d / z", 0.8, THIRD)),
    "away_win": bound(damp("aw / z", 0.8, THIRD)),
    "over_2_5": bound(damp("o25 / z")),
    "under_2_5": bound(f"1 - {damp('o25 / z')}"),
    "over_1_5": bound(damp("o15 / z", 0.85)),
    "under_3_5": bound(damp("u35 / z", 0.85)),
    "btts_yes": bound(damp("b / z")),
    "btts_no": bound(f"1 - {damp('b / z')}"),
    "home_under_1_5": bound(damp("hu / z")),
    "away_under_1_5": bound(damp("au / z")),
}
GOAL_VIEW = GRID + ", g AS (SELECT match_id, " + ", ".join(f"{e} AS {n}" for n, e in GOAL_SQL.items()) + " FROM gs)"


def pick(names, src):
    return "SELECT match_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in names) + f" FROM {src}"


@query("m01_price_goals", f"WITH {GOAL_VIEW} {pick(GOAL_SQL, 'g')}")
def _(t):
    return rounded(pr.price_goals(t.rates).select("match_id", *GOAL_SQL), *GOAL_SQL)


def nb_sql(src, size, prefix):
    """Cells of two negative binomials; columns mh, vh, ma, va in src. The pmf is a running product."""
    return f"""{prefix}v AS (SELECT match_id, mh, ma, CASE WHEN vh <= mh THEN mh * 1.05 ELSE vh END AS vh, CASE WHEN va <= ma THEN ma * 1.05 ELSE va END AS va FROM {src}),
{prefix}n AS (SELECT match_id, mh / vh AS ph, mh * (mh / vh) / (1 - mh / vh) AS nh, ma / va AS pa, ma * (ma / va) / (1 - ma / va) AS na FROM {prefix}v),
{prefix}k AS (SELECT match_id, k, exp(lgamma(k + nh) - lgamma(nh) - lgamma(k + 1) + nh * ln(ph) + k * ln(1 - ph)) AS qh, exp(lgamma(k + na) - lgamma(na) - lgamma(k + 1) + na * ln(pa) + k * ln(1 - pa)) AS qa
  FROM {prefix}n, range(0, {size + 1}) r(k)),
{prefix}c AS (SELECT x.match_id, x.k AS h, y.k AS a, x.qh * y.qa AS p, x.qh, y.qa FROM {prefix}k x JOIN {prefix}k y ON x.match_id = y.match_id)"""


CORNER_SRC = """cs AS (SELECT match_id, mu_home_corners AS mh, mu_away_corners AS ma, mu_home_corners * 1.3 * (1 + 0.5 / (1 + exp(1.5 * (mu_home_corners + mu_away_corners - 8.5)))) AS vh,
  mu_away_corners * 1.3 * (1 + 0.5 / (1 + exp(1.5 * (mu_home_corners + mu_away_corners - 8.5)))) AS va FROM rates)"""
CORNER_NAMES = ["corners_home_win", "corners_draw", "corners_away_win", "corners_under_11_5", "corners_over_11_5", "corners_over_7_5"]
LINES = [(s, ln) for s in ("home", "away") for ln in (2, 3, 4, 5)]
LINE_NAMES = [f"corners_{s}_{d}_{ln}_5" for s, ln in LINES for d in ("under", "over")]
CORNER_VIEW = f"""{CORNER_SRC}, {nb_sql('cs', 25, 'c')},
ca AS (SELECT match_id, sum(p) AS z, sum(CASE WHEN h > a THEN p ELSE 0 END) AS hw, sum(CASE WHEN h = a THEN p ELSE 0 END) AS d, sum(CASE WHEN h < a THEN p ELSE 0 END) AS aw,
  sum(CASE WHEN h + a < 11.5 THEN p ELSE 0 END) AS u11, sum(CASE WHEN h + a > 7.5 THEN p ELSE 0 END) AS o7 FROM cc GROUP BY 1),
cl AS (SELECT match_id, {', '.join(f"sum(CASE WHEN k <= {ln} THEN q{s[0]} ELSE 0 END) AS {s}{ln}" for s, ln in LINES)} FROM ck GROUP BY 1),
cb AS (SELECT match_id, {bound(damp('hw / z', 0.8, THIRD))} AS x, {bound(damp('d / z', 0.8, THIRD))} AS y, {bound(damp('aw / z', 0.8, THIRD))} AS w, u11, o7, z FROM ca),
co AS (SELECT cb.match_id, x / (x + y + w) AS corners_home_win, y / (x + y + w) AS corners_draw, w / (x + y + w) AS corners_away_win, {bound(damp('u11 / z', 0.9))} AS corners_under_11_5,
  {bound('1 - ' + damp('u11 / z', 0.9))} AS corners_over_11_5, {bound(damp('o7 / z', 0.85))} AS corners_over_7_5,
  {', '.join(f"{bound(damp(s + str(ln)))} AS corners_{s}_under_{ln}_5, {bound('1 - ' + damp(s + str(ln)))} AS corners_{s}_over_{ln}_5" for s, ln in LINES)} FROM cb JOIN cl ON cb.match_id = cl.match_id)"""


@query("m02_price_corners", f"WITH {CORNER_VIEW} {pick(CORNER_NAMES + LINE_NAMES, 'co')}")
def _(t):
    names = CORNER_NAMES + LINE_NAMES
    return rounded(pr.price_corners(t.rates).select("match_id", *names), *names)


ZIP_NAMES = ["cards_under_4_5", "cards_over_4_5", "cards_over_2_5", "cards_under_5_5"]
ZIP_VIEW = f"""zk AS (SELECT match_id, k, 0.97 * exp(-mu_cards) * pow(mu_cards, k) / factorial(CAST(k AS INT)) + CASE WHEN k = 0 THEN 0.03 ELSE 0 END AS p FROM rates, range(0, 16) r(k)),
zs AS (SELECT match_id, sum(CASE WHEN k <= 4 THEN p ELSE 0 END) AS u4, sum(CASE WHEN k <= 5 THEN p ELSE 0 END) AS u5, sum(CASE WHEN k >= 3 THEN p ELSE 0 END) AS o2 FROM zk GROUP BY 1),
z AS (SELECT match_id, {bound(damp('u4', 0.88))} AS cards_under_4_5, {bound('1 - ' + damp('u4', 0.88))} AS cards_over_4_5, {bound(damp('o2', 0.9))} AS cards_over_2_5, {bound(damp('u5', 0.88), 0.88)} AS cards_under_5_5 FROM zs)"""


@query("m03_price_cards_zip", f"WITH {ZIP_VIEW} {pick(ZIP_NAMES, 'z')}")
def _(t):
    return rounded(pr.price_cards_zip(t.rates).select("match_id", *ZIP_NAMES), *ZIP_NAMES)


NB_NAMES = ["nb_cards_over_2_5", "nb_cards_under_4_5", "nb_cards_under_5_5"]


@query(
    "m04_price_cards_nb",
    f"""WITH ds AS (SELECT match_id, mu_cards * 0.45 AS mh, mu_cards * 0.45 * 1.3 AS vh, mu_cards * 0.55 AS ma, mu_cards * 0.55 * 0.9 AS va FROM rates), {nb_sql('ds', 15, 'd')},
da AS (SELECT match_id, sum(p) AS z, sum(CASE WHEN h + a > 2.5 THEN p ELSE 0 END) AS o2, sum(CASE WHEN h + a < 4.5 THEN p ELSE 0 END) AS u4, sum(CASE WHEN h + a < 5.5 THEN p ELSE 0 END) AS u5 FROM dc GROUP BY 1),
o AS (SELECT match_id, {bound(damp('o2 / z', 0.85))} AS nb_cards_over_2_5, {bound(damp('u4 / z', 0.85))} AS nb_cards_under_4_5, {bound(damp('u5 / z', 0.85))} AS nb_cards_under_5_5 FROM da) {pick(NB_NAMES, 'o')}""",
)
def _(t):
    h, a = F.col("mu_cards") * 0.45, F.col("mu_cards") * 0.55
    return rounded(pr.price_cards_nb(t.rates, h, h * 1.3, a, a * 0.9).select("match_id", *NB_NAMES), *NB_NAMES)


DERIVED = ["dc_1x", "dc_x2", "dc_12", "poisson_btts_no", "poisson_u25", "poisson_u35"]
POIS = "exp(-({r})) * (1 + ({r}) + pow({r}, 2) / 2"


@query(
    "m05_price_derived",
    f"""WITH {GOAL_VIEW}, x AS (SELECT g.match_id, home_win AS h, draw AS d, away_win AS a, CASE WHEN abs(home_win + draw + away_win - 1) > 0.05 THEN home_win + draw + away_win ELSE 1 END AS s, home_xg AS lh, away_xg AS la FROM g JOIN rates r ON g.match_id = r.match_id)
SELECT match_id, round(least((h + d) / s, 1), 6) AS dc_1x, round(least((d + a) / s, 1), 6) AS dc_x2, round(least((h + a) / s, 1), 6) AS dc_12, round(exp(-lh) + exp(-la) - exp(-lh - la), 6) AS poisson_btts_no,
 round({POIS.format(r='lh + la')}), 6) AS poisson_u25, round({POIS.format(r='lh + la')} + pow(lh + la, 3) / 6), 6) AS poisson_u35 FROM x""",
)
def _(t):
    return rounded(pr.price_derived(pr.price_goals(t.rates)).select("match_id", *DERIVED), *DERIVED)


@query(
    "m06_price_handicap",
    """WITH q AS (SELECT match_id, home_xg AS lh, away_xg AS la, h, a, exp(-home_xg) * pow(home_xg, h) / factorial(CAST(h AS INT)) * exp(-away_xg) * pow(away_xg, a) / factorial(CAST(a AS INT)) AS p FROM rates, range(0, 11) th(h), range(0, 11) ta(a)),
s AS (SELECT match_id, lh, la, sum(CASE WHEN lh < la AND h + 2 > a OR lh >= la AND a + 2 > h THEN p ELSE 0 END) AS p FROM q GROUP BY 1, 2, 3)
SELECT match_id, round(CASE WHEN abs(lh - la) < 0.6 OR p > 0.85 THEN 0 ELSE p END, 6) AS eh_plus, CASE WHEN lh < la THEN 'home' ELSE 'away' END AS underdog FROM s""",
)
def _(t):
    return rounded(pr.price_handicap(t.rates).select("match_id", "eh_plus", "underdog"), "eh_plus")


@query(
    "m07_ensemble",
    """WITH q AS (SELECT match_id, greatest(least(home_xg, 4.0), 0.05) AS h1, greatest(least(away_xg, 4.0), 0.05) AS a1, greatest(least(mu_home_corners / 3, 4.0), 0.05) AS h2, greatest(least(mu_away_corners / 2, 4.0), 0.05) AS a2 FROM rates)
SELECT match_id, round(0.6 * h1 + 0.4 * h2, 6) AS home_lambda, round(0.6 * a1 + 0.4 * a2, 6) AS away_lambda, round(greatest(abs(h1 - h2) / greatest(h1, h2), abs(a1 - a2) / greatest(a1, a2)), 6) AS divergence,
 greatest(abs(h1 - h2) / greatest(h1, h2), abs(a1 - a2) / greatest(a1, a2)) > 0.2 AS diverges FROM q""",
)
def _(t):
    rows = t.rates.withColumns({"h2": F.col("mu_home_corners") / 3, "a2": F.col("mu_away_corners") / 2})
    out = pr.ensemble(rows, ("home_xg", "away_xg"), ("h2", "a2")).select("match_id", "home_lambda", "away_lambda", "divergence", "diverges")
    return rounded(out, "home_lambda", "away_lambda", "divergence")


H2H = """hc AS (SELECT match_id, match_date, league, home_team, away_team, least(home_team, away_team) || '__vs__' || greatest(home_team, away_team) AS pair, home_goals + away_goals AS g, home_cards + away_cards AS k, coalesce(home_corners, 0) + coalesce(away_corners, 0) AS c FROM contests),
hm AS (SELECT avg(home_cards) + avg(away_cards) AS mk, avg(home_corners) + avg(away_corners) AS mc FROM contests),
hq AS (SELECT match_id, league, home_team, away_team, count(*) OVER w AS n, count(*) OVER (PARTITION BY pair) AS meetings, sum(k) OVER w AS sk, sum(c) OVER w AS sc, coalesce(sum(CAST(g > 2.5 AS INT)) OVER w, 0) AS h1,
  coalesce(sum(CAST(k > 2.5 AS INT)) OVER w, 0) AS h3, floor((epoch_us(match_date) - epoch_us(lag(match_date) OVER (PARTITION BY pair ORDER BY match_date, match_id))) / 86400000000) AS days FROM hc
  WINDOW w AS (PARTITION BY pair ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h2h AS (SELECT match_id, league, home_team, away_team, n, days, coalesce(sk / nullif(n, 0), mk) AS avg_cards, coalesce(sc / nullif(n, 0), mc) AS avg_corners, CASE WHEN meetings > 1 THEN h1 / (n + 1) ELSE 0.53e0 END AS o25_rate,
  CASE WHEN meetings > 1 THEN h3 / (n + 1) ELSE 0.77e0 END AS cards_rate FROM hq, hm)"""

FINAL = ["o15", "o25", "u25", "u35", "btts", "btts_no_final", "home_u15", "away_u15"]


def with_history(t):
    history = ft.head_to_head(t.contests).select(
        "match_id", "home_team", "away_team", "h2h_count", "h2h_over_2_5_rate", "h2h_avg_cards", "h2h_avg_corners", "h2h_cards_over_2_5_rate"
    )
    return t.rates.join(history, "match_id")


@query(
    "m08_adjust_goals",
    f"""WITH {GOAL_VIEW}, {H2H},
x1 AS (SELECT g.*, r.home_xg AS lh, r.away_xg AS la, n, o25_rate AS rate, (1 - least(n / 5, 0.5)) * over_2_5 + least(n / 5, 0.5) * o25_rate AS bl, CASE WHEN n >= 8 THEN 0.1e0 ELSE 0.05e0 END AS ml FROM g JOIN rates r ON g.match_id = r.match_id JOIN h2h ON g.match_id = h2h.match_id),
x2 AS (SELECT *, CASE WHEN n >= 6 AND abs(over_2_5 - rate) > 0.15 THEN CASE WHEN bl - over_2_5 > ml THEN over_2_5 + ml ELSE bl END ELSE over_2_5 END AS o FROM x1),
x3 AS (SELECT *, least(o / over_2_5, 1) AS f FROM x2),
x4 AS (SELECT match_id, over_1_5 * greatest(f, 0.85) AS o15r, least((1 - o) + 0.25 * ({POIS.format(r='lh + la')}) - (1 - o)), 0.66) AS u25,
  least((1 - (1 - under_3_5) * f) + 0.25 * ({POIS.format(r='lh + la')} + pow(lh + la, 3) / 6) - (1 - (1 - under_3_5) * f)), 0.85) AS u35,
  least(btts_yes * greatest(f, 0.9) + 0.25 * ((1 - exp(-lh)) * (1 - exp(-la)) - btts_yes * greatest(f, 0.9)), 0.65) AS btts, least(home_under_1_5, 0.8) AS home_u15, least(away_under_1_5, 0.8) AS away_u15 FROM x3),
x5 AS (SELECT *, 1 - u25 AS o25, 1 - btts AS btts_no_final, greatest(o15r, 1 - u25) AS o15 FROM x4) {pick(FINAL, 'x5')}""",
)
def _(t):
    out = pr.adjust_goals(pr.price_goals(with_history(t)))
    return rounded(out.select("match_id", *FINAL), *FINAL)


RATE_NAMES = ["adj_home_corners", "adj_away_corners", "var_home_corners", "adj_cards"]
INTENSE = "(upper(league || ' ' || home_team || ' ' || away_team) SIMILAR TO '.*(CUP|POKAL|COPA|TROPHY|SUPER).*' OR coalesce(n >= 3 AND (cards_rate >= 0.7 OR avg_cards >= 5 OR coalesce(days <= 45 AND (cards_rate >= 0.6 OR avg_cards >= 4.5), false)), false))"


@query(
    "m09_adjust_counts",
    f"""WITH {H2H}, {OFFSETS.format(src='contests', team='team')},
x1 AS (SELECT h.match_id, n, avg_corners, avg_cards, cards_rate, mu_home_corners * exp(coalesce(a.home_corners_bias, 0)) AS mh, mu_away_corners * exp(coalesce(b.away_corners_bias, 0)) AS ma, mu_cards * exp(coalesce(a.home_cards_bias, 0) + coalesce(b.away_cards_bias, 0)) AS mc
  FROM h2h h JOIN rates r ON h.match_id = r.match_id LEFT JOIN o a ON h.league = a.league AND h.home_team = a.team LEFT JOIN o b ON h.league = b.league AND h.away_team = b.team),
x2 AS (SELECT *, CASE WHEN n >= 2 THEN least((1 - least(n / 5, 0.4)) * (mh + ma) + least(n / 5, 0.4) * avg_corners, mh + ma + 2) / (mh + ma) ELSE 1 END AS s FROM x1)
SELECT match_id, round(mh * s, 6) AS adj_home_corners, round(ma * s, 6) AS adj_away_corners, round(mh * s * 1.3, 6) AS var_home_corners, round(CASE WHEN n >= 2 THEN (1 - least(n / 5, 0.5)) * mc + least(n / 5, 0.5) * avg_cards ELSE mc END, 6) AS adj_cards,
 round(coalesce(CASE WHEN n >= 3 AND 0.77 > cards_rate + 0.2 THEN least((1 - least(n / 5, 0.6)) * 0.77 + least(n / 5, 0.6) * cards_rate, 0.77 + CASE WHEN n >= 8 THEN 0.1 ELSE 0.05 END) END, -1), 6) AS card_o25_cap FROM x2""",
)
def _(t):
    offsets = g.team_offsets(t.contests)
    out = pr.adjust_card_rate(pr.adjust_corner_rates(with_history(t), offsets), offsets)
    out = out.withColumn("card_o25_cap", F.coalesce("card_o25_cap", F.lit(-1.0)))
    return rounded(out.select("match_id", *RATE_NAMES, "card_o25_cap"), *RATE_NAMES, "card_o25_cap")


@query("m10_high_intensity", f"WITH {H2H} SELECT match_id, {INTENSE} AS intense FROM h2h")
def _(t):
    out = ft.days_since_meeting(ft.head_to_head(t.contests).drop("pair"))
    return out.select("match_id", pr.high_intensity().alias("intense"))


CONF = """b AS (SELECT league, avg(CAST(home_goals + away_goals > 2.5 AS INT)) AS o25, avg(CAST(home_goals > 0 AND away_goals > 0 AS INT)) AS yes FROM contests GROUP BY 1),
q AS (SELECT match_id, league, CASE match_id % 4 WHEN 0 THEN 'goals_o25' WHEN 1 THEN 'btts_yes' WHEN 2 THEN 'card_o25' ELSE 'corn_o75' END AS market, 0.3e0 + (match_id % 60) / 100 AS p, match_id % 12 AS n, CAST(match_id % 500 - 5 AS DOUBLE) AS days,
  match_id % 4 AS miss, match_id % 3 = 0 AS known, (match_id % 11) / 10 AS vol FROM rates),
c AS (SELECT q.*, coalesce(CASE market WHEN 'goals_o25' THEN b.o25 WHEN 'btts_yes' THEN b.yes END, CASE market WHEN 'card_o25' THEN 0.6 WHEN 'corn_o75' THEN 0.65 END) AS base, CASE WHEN q.league LIKE 'c%' AND market = 'btts_yes' AND p >= 0.5 AND p < 0.6 THEN 0.02 ELSE 0.1 END AS ece,
  1 - exp(-sqrt(greatest(0.5, p * (1 - p) * 2)) / greatest(p * 3, 0.01)) AS u FROM q LEFT JOIN b ON q.league = b.league),
d AS (SELECT *, CASE WHEN n = 0 AND miss >= 3 THEN 0.3 ELSE greatest(least(0.4 * CASE WHEN n >= 5 THEN least(n / 10, 1) WHEN n > 0 THEN 0.6 * n / 5 ELSE 0 END + 0.3 * CASE WHEN days >= 0 THEN exp(-days / 365) ELSE 1 END + 0.3 * exp(-0.35 * miss), 1), 0.3) END AS drs,
  greatest(CASE market WHEN 'goals_o25' THEN 0.9 WHEN 'btts_yes' THEN 0.8 WHEN 'card_o25' THEN 0.6 ELSE 0.7 END - CASE WHEN NOT known AND market = 'card_o25' THEN 0.15 ELSE 0 END - CASE WHEN vol > 0.7 THEN 0.08 ELSE 0 END, 0.5) AS mss,
  greatest(1 - (0.6 * (greatest(p, base, 0.5) - least(p, base, 0.5)) + 0.4 * list_stddev_pop([p, base, 0.5e0])), 0.4) AS mas, exp(-ece * 5) AS hce FROM c),
conf AS (SELECT *, pow(drs * mss * mas * hce * (1 - u), 0.85) AS confidence FROM d)"""


def confidence_rows(t):
    p = 0.3 + (F.col("match_id") % 60) / 100
    names = F.array(*[F.lit(m) for m in ("goals_o25", "btts_yes", "card_o25", "corn_o75")])
    rows = t.rates.select(
        "match_id", "league", F.get(names, (F.col("match_id") % 4).cast("int")).alias("market"), p.alias("probability")
    )
    rates = pr.to_market_rows(g.base_rates(t.contests), {"goals_o25": "goals_o25", "btts_yes": "btts_yes"}, ["league"])
    rates = rates.withColumnRenamed("probability", "baseline")
    buckets = t.contests.filter("league LIKE 'c%'").select("league").distinct().select(
        "league", F.lit("btts_yes").alias("market"), F.lit("0.50-0.60").alias("bucket"), F.lit(0.02).alias("ece")
    )
    x = F.col("probability")
    return pr.confidence(
        rows,
        rates,
        buckets,
        mu=x * 3,
        variance=F.greatest(F.lit(0.5), x * (1 - x) * 2),
        h2h_count=F.col("match_id") % 12,
        days_since_h2h=(F.col("match_id") % 500 - 5).cast("double"),
        missing=F.col("match_id") % 4,
        referee_known=F.col("match_id") % 3 == 0,
        team_volatility=(F.col("match_id") % 11) / 10,
    )


@query(
    "m11_confidence",
    f"""WITH {CONF} SELECT match_id, round(drs, 6) AS drs, round(CAST(mss AS DOUBLE), 6) AS mss, round(mas, 6) AS mas, round(hce, 6) AS hce, round(u, 6) AS uncertainty, round(confidence, 6) AS confidence,
 CASE WHEN confidence >= 0.8 THEN 'AUTO_BET' WHEN confidence >= 0.7 THEN 'REDUCED_STAKE' WHEN confidence >= 0.6 THEN 'MANUAL_REVIEW' ELSE 'NO_BET' END AS action_tier FROM conf""",
)
def _(t):
    names = ["drs", "mss", "mas", "hce", "uncertainty", "confidence"]
    return rounded(confidence_rows(t).select("match_id", *names, "action_tier"), *names)


@query(
    "m12_soft_cap",
    """SELECT bet_id, round(CASE bet_id % 3 WHEN 0 THEN least(probability, greatest(least(0.75 + 0.15 * ((bet_id % 101) / 100), 0.82), 0.72)) WHEN 1 THEN least(probability, greatest(least(0.7 + 0.18 * ((bet_id % 101) / 100), 0.82), 0.72)) ELSE probability END, 6) AS capped FROM ledger""",
)
def _(t):
    kind = F.col("bet_id") % 3
    market = F.when(kind == 0, "CORNERS_O7.5").when(kind == 1, "card_u55").otherwise("btts_yes")
    return t.ledger.select("bet_id", r6(pr.soft_cap(F.col("probability"), (F.col("bet_id") % 101) / 100, market)).alias("capped"))


@query(
    "m13_price_from_history",
    """WITH h AS (SELECT match_id, avg(home_goals) OVER w AS m, count(*) OVER w AS n FROM contests WINDOW w AS (PARTITION BY league, home_team ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
a AS (SELECT match_id, avg(away_goals) OVER w AS m, count(*) OVER w AS n FROM contests WINDOW w AS (PARTITION BY league, away_team ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
x AS (SELECT h.match_id, (CASE WHEN h.n >= 3 THEN h.m ELSE 1.3 END + CASE WHEN a.n >= 3 THEN a.m ELSE 1.2 END) / 2 AS r FROM h JOIN a ON h.match_id = a.match_id),
tc AS (SELECT match_id, is_home, avg(corners_for + corners_against) OVER w AS c, count(*) OVER w AS n FROM team WINDOW w AS (PARTITION BY team ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
e AS (SELECT p.match_id, CASE WHEN p.n >= 3 AND q.n >= 3 THEN (p.c + q.c) / 2 ELSE 10.5 END AS e FROM tc p JOIN tc q ON p.match_id = q.match_id WHERE p.is_home = 1 AND q.is_home = 0)
SELECT x.match_id, round(least(exp(-r) + r * exp(-r), 0.99), 6) AS home_u15, round(CAST(CASE WHEN e < 9 THEN 0.8 WHEN e < 10 THEN 0.7 WHEN e < 11 THEN 0.6 WHEN e < 12 THEN 0.5 ELSE 0.35 END AS DOUBLE), 6) AS corners_u115 FROM x JOIN e ON x.match_id = e.match_id""",
)
def _(t):
    from ..operators.ordered import Feature, Rolling

    c = t.contests
    out = c.select("match_id", "league", "home_team", "away_team", "match_date")
    args = dict(n=5, min_rows=3)
    out = j.last_n_before(out, c, ["league", "home_team"], "match_date", "match_id", "home_goals", default=1.3, name="hs", **args)
    out = j.last_n_before(out, c, ["league", "away_team"], "match_date", "match_id", "away_goals", default=1.2, name="as_", **args)
    total = Feature(
        rolling={
            "corners5": Rolling(5, F.avg(F.col("corners_for") + F.col("corners_against"))),
            "games": Rolling(5, F.count(F.lit(1))),
        }
    )
    sides = ft.reassemble(out, ft.add_features(t.team, [total]), ["corners5", "games"])
    enough = (F.col("home_games") >= 3) & (F.col("away_games") >= 3)
    expected = F.when(enough, (F.col("home_corners5") + F.col("away_corners5")) / 2).otherwise(10.5)
    return sides.select(
        "match_id",
        r6(pr.price_from_history(F.col("hs"), F.col("as_"))).alias("home_u15"),
        r6(pr.corner_step(expected)).alias("corners_u115"),
    )


LONG = {"home_win": "home_win", "draw": "draw", "away_win": "away_win", "over_2_5": "goals_over_2_5", "btts_yes": "btts_yes"}


@query(
    "m14_market_rows",
    f"WITH {GOAL_VIEW} "
    + " UNION ALL ".join(f"SELECT match_id, '{m}' AS market, round({c}, 6) AS probability FROM g WHERE match_id % 10 > 0 OR '{c}' <> 'draw'" for c, m in LONG.items()),
)
def _(t):
    wide = pr.price_goals(t.rates).withColumn("draw", F.when(F.col("match_id") % 10 > 0, F.col("draw")))
    return rounded(pr.to_market_rows(wide, LONG, ["match_id"]), "probability")


@query(
    "u05_price_table_function",
    f"WITH {ZIP_VIEW} " + " UNION ALL ".join(f"SELECT match_id, '{n}' AS market, round({n}, 6) AS probability FROM z" for n in ZIP_NAMES),
)
def _(t):
    return rounded(pr.to_market_rows(pr.price_cards_zip(t.rates), {n: n for n in ZIP_NAMES}, ["match_id"]), "probability")


def priced_by_sql(t, text):
    pr.register_table_functions(t.spark)
    names, prices = (f"array({', '.join(q + n + q for n in ZIP_NAMES)})" for q in ("'", ""))
    priced = pr.price_cards_zip(t.rates).select("match_id", *ZIP_NAMES)
    return rounded(t.spark.sql(text.format(priced="{priced}", args=f"{names}, {prices}"), priced=priced), "probability")


U05 = f"WITH {ZIP_VIEW} " + " UNION ALL ".join(f"SELECT match_id, '{n}' AS market, round({n}, 6) AS probability FROM z" for n in ZIP_NAMES)


@query("u05_sql_table_function", U05)
def _(t):
    return priced_by_sql(t, "SELECT match_id, market, probability FROM {priced}, LATERAL market_rows({args})")


@query("u05_sql_inline_function", U05)
def _(t):
    return priced_by_sql(t, "SELECT match_id, inline(entries) FROM (SELECT match_id, market_entries({args}) AS entries FROM {priced})")


AUDIT = {
    "home_win": ("hw", "home_goals > away_goals"),
    "draw": ("d", "home_goals = away_goals"),
    "away_win": ("aw", "home_goals < away_goals"),
    "over_2_5": ("o25", "home_goals + away_goals > 2.5"),
    "under_2_5": ("o25", "home_goals + away_goals < 2.5"),
    "under_3_5": ("u35", "home_goals + away_goals < 3.5"),
    "btts_yes": ("b", "home_goals > 0 AND away_goals > 0"),
    "home_under_1_5": ("hu", "home_goals < 1.5"),
    "away_under_1_5": ("au", "away_goals < 1.5"),
}


def base_rate_audit(df, by="league"):
    """Observed rate against the model's price at the mean, per market."""
    observed = {m: F.avg(F.expr(cond).cast("double")).alias(f"base_{m}") for m, (_, cond) in AUDIT.items()}
    corner_base = {
        "corners_home_win": F.avg((F.col("home_corners") > F.col("away_corners")).cast("double")),
        "corners_under_11_5": F.avg((F.col("home_corners") + F.col("away_corners") < 11.5).cast("double")),
    }
    cards = F.coalesce("home_cards", F.lit(0)) + F.coalesce("away_cards", F.lit(0))
    card_base = {"cards_over_2_5": cards > 2.5, "cards_under_4_5": cards < 4.5, "cards_under_5_5": cards < 5.5}
    both = F.col("home_corners").isNotNull() & F.col("away_corners").isNotNull()
    corner = lambda agg, c: agg(F.when(both, F.col(c)))
    one = df.groupBy(by).agg(
        *observed.values(),
        *[c.alias(f"base_{n}") for n, c in corner_base.items()],
        *[F.avg(c.cast("double")).alias(f"base_{n}") for n, c in card_base.items()],
        F.avg("home_goals").alias("home_xg"),
        F.avg("away_goals").alias("away_xg"),
        corner(F.avg, "home_corners").alias("mu_home_corners"),
        corner(F.avg, "away_corners").alias("mu_away_corners"),
        corner(F.var_samp, "home_corners").alias("v_home"),
        corner(F.var_samp, "away_corners").alias("v_away"),
        F.avg(cards).alias("mu_cards"),
    )
    priced = pr.price_cards_zip(pr.price_corners(pr.price_goals(one), var_home=F.col("v_home"), var_away=F.col("v_away")))
    markets = [*AUDIT, *corner_base, *card_base]
    rows = F.array(*[F.struct(F.lit(m).alias("market"), F.col(f"base_{m}").alias("base_rate"), F.col(m).alias("model")) for m in markets])
    out = priced.select(by, F.inline(rows)).withColumn("gap", F.col("model") - F.col("base_rate"))
    size = F.abs("gap")
    return out.withColumn("status", F.when(size > 0.10, "ALERT").when(size > 0.05, "WARN").otherwise("OK"))


@query(
    "g03_base_rate_audit",
    f"""WITH rates0 AS (SELECT league AS match_id, avg(home_goals) AS home_xg, avg(away_goals) AS away_xg, """
    + ", ".join(f"avg(CAST({c} AS INT)) AS base_{m}" for m, (_, c) in AUDIT.items())
    + f""" FROM contests GROUP BY 1), {GRID.replace('FROM rates', 'FROM rates0')}, g AS (SELECT match_id, {', '.join(f'{e} AS {n}' for n, e in GOAL_SQL.items())} FROM gs),
u AS ("""
    + " UNION ALL ".join(f"SELECT g.match_id AS league, '{m}' AS market, base_{m} AS base_rate, {m} AS model FROM g JOIN rates0 r ON g.match_id = r.match_id" for m in AUDIT)
    + """) SELECT league, market, round(base_rate, 6) AS base_rate, round(model, 6) AS model, round(model - base_rate, 6) AS gap, CASE WHEN abs(model - base_rate) > 0.1 THEN 'ALERT' WHEN abs(model - base_rate) > 0.05 THEN 'WARN' ELSE 'OK' END AS status FROM u""",
)
def _(t):
    out = base_rate_audit(t.contests).filter(F.col("market").isin(*AUDIT))
    return rounded(out, "base_rate", "model", "gap")


COUNT_AUDIT = {
    "corners_home_win": ("corners_home_win", "base_chw"),
    "corners_under_11_5": ("corners_under_11_5", "base_cu"),
    "cards_over_2_5": ("cards_over_2_5", "base_o2"),
    "cards_under_4_5": ("cards_under_4_5", "base_u4"),
    "cards_under_5_5": ("cards_under_5_5", "base_u5"),
}


@query(
    "g03_base_rate_audit_counts",
    f"""WITH rates0 AS (SELECT league AS match_id, avg(home_corners) AS mh, avg(away_corners) AS ma, var_samp(home_corners) * (1 + 0.5 / (1 + exp(1.5 * (avg(home_corners) + avg(away_corners) - 8.5)))) AS vh,
  var_samp(away_corners) * (1 + 0.5 / (1 + exp(1.5 * (avg(home_corners) + avg(away_corners) - 8.5)))) AS va, avg(CAST(home_corners > away_corners AS INT)) AS base_chw, avg(CAST(home_corners + away_corners < 11.5 AS INT)) AS base_cu,
  avg(home_cards + away_cards) AS mu_cards, avg(CAST(home_cards + away_cards > 2.5 AS INT)) AS base_o2, avg(CAST(home_cards + away_cards < 4.5 AS INT)) AS base_u4, avg(CAST(home_cards + away_cards < 5.5 AS INT)) AS base_u5 FROM contests GROUP BY 1),
{nb_sql('rates0', 25, 'c')}, ca AS (SELECT match_id, sum(p) AS z, sum(CASE WHEN h > a THEN p ELSE 0 END) AS hw, sum(CASE WHEN h = a THEN p ELSE 0 END) AS d, sum(CASE WHEN h < a THEN p ELSE 0 END) AS aw, sum(CASE WHEN h + a < 11.5 THEN p ELSE 0 END) AS u11 FROM cc GROUP BY 1),
cb AS (SELECT match_id, {bound(damp('hw / z', 0.8, THIRD))} AS x, {bound(damp('d / z', 0.8, THIRD))} AS y, {bound(damp('aw / z', 0.8, THIRD))} AS w, {bound(damp('u11 / z', 0.9))} AS corners_under_11_5 FROM ca), {ZIP_VIEW.replace('FROM rates,', 'FROM rates0,')},
m AS (SELECT r.*, x / (x + y + w) AS corners_home_win, corners_under_11_5, cards_over_2_5, cards_under_4_5, cards_under_5_5 FROM rates0 r JOIN cb ON r.match_id = cb.match_id JOIN z ON r.match_id = z.match_id),
u AS ("""
    + " UNION ALL ".join(f"SELECT match_id AS league, '{n}' AS market, {b} AS base_rate, {m} AS model FROM m" for n, (m, b) in COUNT_AUDIT.items())
    + """) SELECT league, market, round(base_rate, 6) AS base_rate, round(model, 6) AS model, round(model - base_rate, 6) AS gap, CASE WHEN abs(model - base_rate) > 0.1 THEN 'ALERT' WHEN abs(model - base_rate) > 0.05 THEN 'WARN' ELSE 'OK' END AS status FROM u""",
)
def _(t):
    out = base_rate_audit(t.contests).filter(~F.col("market").isin(*AUDIT))
    return rounded(out, "base_rate", "model", "gap")
