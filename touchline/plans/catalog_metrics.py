"""Queries over aggregates, calibration measures and standings."""

import datetime as dt

from pyspark.sql import functions as F

from ..operators import metrics as g
from ..operators import standings as st
from .registry import micros, query, r6, rounded

S = "s AS (SELECT *, CASE WHEN outcome = 'WON' THEN 1.0e0 ELSE 0.0e0 END AS hit FROM ledger WHERE outcome IN ('WON', 'LOST'))"


@query(
    "g01_profile",
    """SELECT count(*) AS matches, round(avg(home_goals + away_goals), 6) AS avg_goals, round(avg(home_corners + away_corners), 6) AS avg_corners,
 round(avg(home_cards + away_cards), 6) AS avg_cards, round(avg(home_shots + away_shots), 6) AS avg_shots,
 round(avg(CAST(home_goals > away_goals AS INT)), 6) AS home_rate, round(avg(CAST(home_goals = away_goals AS INT)), 6) AS draw_rate,
 round(avg(CAST(home_goals < away_goals AS INT)), 6) AS away_rate FROM contests""",
)
def _(t):
    out = g.profile(t.contests)
    return rounded(out, *[c for c in out.columns if c != "matches"])


@query(
    "g02_base_rates",
    """SELECT league, count(*) AS matches, round(avg(CAST(home_goals + away_goals > 2.5 AS INT)), 6) AS goals_o25, round(1 - avg(CAST(home_goals + away_goals > 2.5 AS INT)), 6) AS goals_u25,
 round(avg(CAST(home_goals > 0 AND away_goals > 0 AS INT)), 6) AS btts_yes, round(1 - avg(CAST(home_goals > 0 AND away_goals > 0 AS INT)), 6) AS btts_no,
 round(avg(CAST(home_corners + away_corners > 7.5 AS INT)), 6) AS corn_o75, round(avg(CAST(home_corners + away_corners < 11.5 AS INT)), 6) AS corn_u11,
 round(avg(CAST(home_cards + away_cards > 2.5 AS INT)), 6) AS card_o25 FROM contests GROUP BY league HAVING count(*) >= 10""",
)
def _(t):
    out = g.base_rates(t.contests)
    return rounded(out, *[c for c in out.columns if c not in ("league", "matches")])


@query(
    "g04_weighted_rate",
    """WITH s AS (SELECT league, season, count(*) AS n, avg(CAST(home_goals > away_goals AS INT)) AS hw, avg(CAST(home_goals = away_goals AS INT)) AS d,
  avg(CAST(home_goals < away_goals AS INT)) AS aw FROM contests GROUP BY 1, 2)
SELECT league, CAST(sum(n) AS BIGINT) AS matches, round(sum(hw * n) / sum(n), 6) AS home_rate, round(sum(d * n) / sum(n), 6) AS draw_rate, round(sum(aw * n) / sum(n), 6) AS away_rate FROM s GROUP BY 1""",
)
def _(t):
    return rounded(g.weighted_rate(t.contests), "home_rate", "draw_rate", "away_rate")


@query(
    "g05_distribution",
    """WITH h AS (SELECT league, CAST(home_cards + away_cards AS DOUBLE) AS value, count(*) AS n FROM contests GROUP BY 1, 2)
SELECT league, value, n, round(n / sum(n) OVER (PARTITION BY league), 6) AS share, round(sum(n) OVER (PARTITION BY league ORDER BY value) / sum(n) OVER (PARTITION BY league), 6) AS cumulative FROM h""",
)
def _(t):
    return rounded(g.distribution(t.contests, F.col("home_cards") + F.col("away_cards"), ["league"]), "share", "cumulative")


@query(
    "g06_brier",
    f"""WITH {S} SELECT league, market, count(*) AS n, round(avg((probability - hit) * (probability - hit)), 6) AS brier, round(avg(probability), 6) AS mean_predicted, round(avg(hit), 6) AS mean_actual FROM s GROUP BY 1, 2""",
)
def _(t):
    return rounded(g.brier(g.settled(t.ledger), ["league", "market"]), "brier", "mean_predicted", "mean_actual")


@query(
    "g07_accuracy",
    f"""WITH {S} SELECT model_version, market, count(*) AS n, round(avg(CAST((probability >= 0.5) = (hit >= 0.5) AS INT)), 6) AS accuracy, round(avg((probability - hit) * (probability - hit)), 6) AS brier FROM s GROUP BY 1, 2""",
)
def _(t):
    return rounded(g.accuracy(g.settled(t.ledger), ["model_version", "market"]), "accuracy", "brier")


EDGE_LIST = "[0.0e0, 0.1e0, 0.2e0, 0.30000000000000004e0, 0.4e0, 0.5e0, 0.6000000000000001e0, 0.7000000000000001e0, 0.8e0, 0.9e0, 1.0e0]"
LOW = f"len(list_filter({EDGE_LIST}, lambda e: probability >= e)) - 1"
UP = f"len(list_filter({EDGE_LIST}, lambda e: probability > e)) - 1"
BIN = {
    "a": f"CASE WHEN probability BETWEEN 0 AND 1 AND {LOW} < 10 THEN {LOW} END",
    "b": f"CASE WHEN probability BETWEEN 0 AND 1 AND {UP} >= 0 THEN {UP} END",
    "c": f"greatest({UP}, 0)",
    "d": f"CASE WHEN probability BETWEEN 0 AND 1 THEN least({LOW}, 9) END",
    "e": "CASE WHEN probability BETWEEN 0 AND 1 THEN CASE WHEN probability = 1 THEN 9 ELSE CAST(floor(probability * 10) AS INT) END END",
}


def ece_sql(convention, by, src="s", p="probability"):
    b = BIN[convention].replace("probability", p)
    return f"""(SELECT {by}, sum(n) AS n, coalesce(sum(CASE WHEN bin IS NOT NULL THEN abs(sp - sy) END), 0) / sum(n) AS ece, (sum(sp) - sum(sy)) / sum(n) AS gap
 FROM (SELECT {by}, {b} AS bin, count(*) AS n, sum({p}) AS sp, sum(hit) AS sy FROM {src} GROUP BY ALL) GROUP BY ALL)"""


@query(
    "g08_ece",
    f"WITH {S} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS convention, market, CAST(n AS BIGINT) AS n, round(ece, 6) AS ece, round(gap, 6) AS gap, "
        f"CASE WHEN gap > 0 THEN 'overconfident' WHEN gap < 0 THEN 'underconfident' ELSE 'balanced' END AS state FROM {ece_sql(c, 'market')}"
        for c in "abcde"
    ),
)
def _(t):
    rows = g.settled(t.ledger)
    out = None
    for c in "abcde":
        part = g.ece(rows, ["market"], c).withColumn("convention", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return rounded(out, "ece", "gap")


@query(
    "g09_reliability",
    f"""WITH {S}, b AS (SELECT market, league, {BIN['d']} AS bin, count(*) AS n, avg(probability) AS p, avg(hit) AS y FROM s GROUP BY ALL),
m AS (SELECT market, league, max(abs(p - y)) AS dev FROM b GROUP BY 1, 2), k AS (SELECT m.*, bin FROM m, range(0, 10) r(bin))
SELECT k.market, k.league, CAST(k.bin AS INT) AS bin, coalesce(n, 0) AS n, round(p, 6) AS predicted, round(y, 6) AS actual, round(p - y, 6) AS gap, round(dev, 6) AS max_deviation, dev > 0.1 AS miscalibrated
FROM k LEFT JOIN b ON k.market = b.market AND k.league = b.league AND k.bin = b.bin""",
)
def _(t):
    return rounded(g.reliability(g.settled(t.ledger)), "predicted", "actual", "gap", "max_deviation")


@query(
    "g10_calibration_buckets",
    f"""WITH {S} SELECT CASE WHEN probability < 0.4 THEN 'low' WHEN probability < 0.55 THEN 'medium' WHEN probability < 0.7 THEN 'high' ELSE 'very_high' END AS bucket,
 count(*) AS n, round(avg(probability), 6) AS mean_predicted, round(avg(hit), 6) AS mean_actual, round(avg(probability) - avg(hit), 6) AS gap FROM s GROUP BY 1""",
)
def _(t):
    return rounded(g.calibration_buckets(g.settled(t.ledger)), "mean_predicted", "mean_actual", "gap")


@query(
    "g11_league_calibration",
    f"""WITH {S}, e AS {ece_sql('b', 'league')}, m AS (SELECT league, avg((probability - hit) * (probability - hit)) AS brier, avg(probability) AS mp, avg(hit) AS f, stddev_samp(probability) AS sd FROM s GROUP BY 1)
SELECT e.league, CAST(n AS BIGINT) AS n, round(ece, 6) AS ece, round(gap, 6) AS gap, round(brier, 6) AS brier, round(mp, 6) AS mean_predicted, round(f, 6) AS frequency, round(sd, 6) AS predicted_std,
 CASE WHEN ece > 0.1 THEN 'EXCLUDE' WHEN ece < 0.02 THEN 'BOOST' WHEN ece < 0.05 THEN 'ELIGIBLE' ELSE 'NEUTRAL' END AS status FROM e JOIN m ON e.league = m.league WHERE n >= 30""",
)
def _(t):
    out = g.league_calibration(g.settled(t.ledger))
    return rounded(out, "ece", "gap", "brier", "mean_predicted", "frequency", "predicted_std")


AS_OF = dt.datetime(2024, 1, 25, tzinfo=dt.UTC)
TABLE = """p AS (SELECT * FROM team WHERE match_date < TIMESTAMP '2024-01-25 00:00:00'),
r AS (SELECT *, row_number() OVER (PARTITION BY league, season, team ORDER BY match_date DESC, match_id DESC) AS rn FROM p),
a AS (SELECT league, season, team, count(*) AS played, sum(points) AS points, sum(goals_for - goals_against) AS gd, sum(goals_for) AS gs,
  sum(CASE WHEN rn <= 5 THEN points END) / count(*) FILTER (rn <= 5) - sum(points) / count(*) AS d, sum(CASE WHEN rn <= 5 THEN points END) / count(*) FILTER (rn <= 5) AS rp,
  count(*) FILTER (rn <= 5) AS rc FROM r GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY league, season ORDER BY points DESC, gd DESC, gs DESC, team) AS rank, count(*) OVER (PARTITION BY league, season) AS size FROM a)"""
BAND = """CASE WHEN rc < 3 THEN 'INSUFFICIENT_DATA' WHEN d >= 0.6 THEN 'STRONG_POSITIVE' WHEN d >= 0.2 THEN 'MILD_POSITIVE' WHEN d <= -0.6 THEN 'STRONG_NEGATIVE'
 WHEN d <= -0.2 THEN 'MILD_NEGATIVE' ELSE 'STABLE' END"""
STATUS = "CASE WHEN rank <= 4 THEN 'TOP' WHEN rank >= size - 2 THEN 'LOW' ELSE 'MID' END"


@query(
    "g12_standings",
    f"""WITH {TABLE} SELECT league, season, team, CAST(rank AS INT) AS rank, CAST(played AS BIGINT) AS played, CAST(points AS BIGINT) AS points, CAST(gd AS BIGINT) AS gd,
 CAST(gs AS BIGINT) AS gs, round(points / played, 2) AS season_ppg, round(rp, 2) AS recent_ppg FROM k""",
)
def _(t):
    out = st.standings(t.team, AS_OF)
    return out.select("league", "season", "team", "rank", "played", "points", "gd", "gs", "season_ppg", "recent_ppg")


@query(
    "g13_bands",
    f"WITH {TABLE} SELECT league, season, team, {BAND} AS momentum_band, {STATUS} AS status_band, size AS league_size FROM k",
)
def _(t):
    return st.standings(t.team, AS_OF).select("league", "season", "team", "momentum_band", "status_band", "league_size")


@query(
    "j13_with_standings",
    """WITH c AS (SELECT * FROM contests WHERE event_ok), k AS (SELECT DISTINCT league, season, match_date FROM c),
st AS (SELECT league, season, team, match_date, count(*) OVER w AS played, sum(points) OVER w AS points, sum(goals_for - goals_against) OVER w AS gd, sum(goals_for) OVER w AS gs,
  count(*) OVER l AS rc, sum(points) OVER l AS rp FROM team WINDOW w AS (PARTITION BY league, season, team ORDER BY match_date, match_id),
  l AS (PARTITION BY league, season, team ORDER BY match_date, match_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
p AS (SELECT k.league, k.season, k.match_date, s.team FROM k JOIN (SELECT DISTINCT league, season, team FROM team) s ON k.league = s.league AND k.season = s.season),
a AS (SELECT p.league, p.season, p.match_date, p.team, st.points, st.gd, st.gs, st.rc, st.rp / st.rc - st.points / st.played AS d FROM p ASOF JOIN st
  ON p.league = st.league AND p.season = st.season AND p.team = st.team AND p.match_date > st.match_date),
r AS (SELECT *, row_number() OVER (PARTITION BY league, season, match_date ORDER BY points DESC, gd DESC, gs DESC, team) AS rank, count(*) OVER (PARTITION BY league, season, match_date) AS size FROM a),
x AS (SELECT *, BAND AS momentum_band, STATUS AS status_band FROM r)
SELECT c.match_id, CAST(coalesce(h.rank, -1) AS INT) AS home_rank, CAST(coalesce(a.rank, -1) AS INT) AS away_rank, coalesce(h.status_band, '-') AS home_status_band, coalesce(a.momentum_band, '-') AS away_momentum_band
FROM c LEFT JOIN x h ON c.league = h.league AND c.season = h.season AND c.match_date = h.match_date AND c.home_team = h.team
LEFT JOIN x a ON c.league = a.league AND c.season = a.season AND c.match_date = a.match_date AND c.away_team = a.team""".replace("BAND AS", BAND + " AS")
    .replace("STATUS AS", STATUS + " AS")
    .replace(" WHERE event_ok", ""),
)
def _(t):
    out = st.with_standings(t.contests, t.team, ["rank", "status_band", "momentum_band"])
    return out.select(
        "match_id",
        F.coalesce("home_rank", F.lit(-1)).alias("home_rank"),
        F.coalesce("away_rank", F.lit(-1)).alias("away_rank"),
        F.coalesce("home_status_band", F.lit("-")).alias("home_status_band"),
        F.coalesce("away_momentum_band", F.lit("-")).alias("away_momentum_band"),
    )


OFFSETS = """l AS (SELECT league, avg(home_corners) AS hc, avg(away_corners) AS ac, avg(home_cards) AS hk, avg(away_cards) AS ak FROM {src} GROUP BY 1),
q AS (SELECT t.league, t.team, count(*) AS matches, 0.7 * least(count(*) / 200, 1.0) AS f, avg(CASE WHEN is_home = 1 THEN corners_for END) AS thc, avg(CASE WHEN is_home = 0 THEN corners_for END) AS tac,
  avg(CASE WHEN is_home = 1 THEN cards_for END) AS thk, avg(CASE WHEN is_home = 0 THEN cards_for END) AS tak FROM {team} t GROUP BY 1, 2),
o AS (SELECT q.league, team, matches, coalesce((thc - hc) * f, 0) AS home_corners_bias, coalesce((tac - ac) * f, 0) AS away_corners_bias, coalesce((thk - hk) * f, 0) AS home_cards_bias,
  coalesce((tak - ak) * f, 0) AS away_cards_bias FROM q JOIN l ON q.league = l.league)"""
BIASES = ["home_corners_bias", "away_corners_bias", "home_cards_bias", "away_cards_bias"]


@query(
    "g14_team_offsets",
    f"""WITH {OFFSETS.format(src='contests', team='team')},
l2 AS (SELECT league, avg(home_corners) AS hc, avg(away_corners) AS ac, avg(home_cards) AS hk, avg(away_cards) AS ak FROM contests WHERE season = 'S1' GROUP BY 1),
q2 AS (SELECT t.league, t.team, count(*) AS matches, 0.7 * least(count(*) / 200, 1.0) AS f, avg(CASE WHEN is_home = 1 THEN corners_for END) AS thc, avg(CASE WHEN is_home = 0 THEN corners_for END) AS tac,
  avg(CASE WHEN is_home = 1 THEN cards_for END) AS thk, avg(CASE WHEN is_home = 0 THEN cards_for END) AS tak FROM team t WHERE season = 'S1' GROUP BY 1, 2),
o2 AS (SELECT q2.league, team, matches, coalesce((thc - hc) * f, 0) AS home_corners_bias, coalesce((tac - ac) * f, 0) AS away_corners_bias, coalesce((thk - hk) * f, 0) AS home_cards_bias,
  coalesce((tak - ak) * f, 0) AS away_cards_bias, team LIKE '%-7' AS frozen FROM q2 JOIN l2 ON q2.league = l2.league),
j AS (SELECT o.*, o2.team IS NOT NULL AND (o2.frozen OR o.matches - o2.matches < 20) AS old, o2.matches AS m2, o2.frozen, """
    + ", ".join(f"o2.{b} AS {b}2" for b in BIASES)
    + """ FROM o LEFT JOIN o2 ON o.league = o2.league AND o.team = o2.team)
SELECT league, team, CASE WHEN old THEN m2 ELSE matches END AS matches, """
    + ", ".join(f"round(CASE WHEN old THEN {b}2 ELSE {b} END, 6) AS {b}" for b in BIASES)
    + ", CASE WHEN old THEN frozen ELSE false END AS frozen, CASE WHEN old THEN m2 ELSE matches END >= 15 AS valid FROM j",
)
def _(t):
    first = g.team_offsets(t.contests.filter("season = 'S1'")).drop("valid").withColumn("frozen", F.col("team").endswith("-7"))
    return rounded(g.team_offsets(t.contests, first), *BIASES)


@query(
    "g15_consolidate",
    f"""WITH {OFFSETS.format(src='contests', team='team')}, n AS (SELECT *, regexp_replace(team, '[0-9]$', '') AS key FROM o)
SELECT league, key, max(matches) AS matches, arg_max(team, (matches, team)) AS team FROM n GROUP BY 1, 2""",
)
def _(t):
    rows = g.team_offsets(t.contests).select("league", F.regexp_replace("team", "[0-9]$", "").alias("key"), "matches", "team")
    return g.consolidate(rows, ["league", "key"], "matches")


@query(
    "g16_volatility",
    """WITH s AS (SELECT team, stddev_samp(goals_for + goals_against) AS sd FROM team GROUP BY 1 HAVING count(*) >= 2),
v AS (SELECT team, (sd - min(sd) OVER ()) / (max(sd) OVER () - min(sd) OVER ()) AS v FROM s)
SELECT c.match_id, round((coalesce(h.v, 0.5) + coalesce(a.v, 0.5)) / 2, 6) AS team_volatility FROM contests c LEFT JOIN v h ON c.home_team = h.team LEFT JOIN v a ON c.away_team = a.team""",
)
def _(t):
    out = g.pair_volatility(t.contests, g.volatility(t.contests))
    return rounded(out.select("match_id", "team_volatility"), "team_volatility")


PROFIT = "CASE WHEN outcome IN ('WON', 'LOST') AND probability > 0 THEN CASE WHEN outcome = 'WON' THEN 1 / probability - 1 ELSE -1.0 END END"


@query(
    "g17_performance_report",
    f"""WITH x AS (SELECT *, {PROFIT} AS profit, {BIN['e']} AS bin FROM ledger),
a AS (SELECT CASE WHEN grouping(market) = 0 THEN 'market' WHEN grouping(league) = 0 THEN 'league' WHEN grouping(bin) = 0 THEN 'bin' ELSE 'total' END AS level,
  coalesce(market, league, CAST(bin AS VARCHAR), 'all') AS name, count(*) FILTER (outcome <> 'VOID') AS bets, count(*) FILTER (outcome = 'WON') AS wins, count(*) FILTER (outcome = 'VOID') AS voids,
  coalesce(sum(profit), 0) AS profit FROM x GROUP BY GROUPING SETS ((), (market), (league), (bin)))
SELECT level, name, bets, wins, voids, round(profit, 6) AS profit, round(wins / bets, 6) AS win_rate, round(profit / bets * 100, 6) AS roi_pct FROM a WHERE bets > 0 AND (level <> 'bin' OR bets >= 10)""",
)
def _(t):
    return rounded(g.performance_report(t.ledger), "profit", "win_rate", "roi_pct")


PNL = "CASE outcome WHEN 'WON' THEN stake * (odds - 1) WHEN 'LOST' THEN -stake END"


@query(
    "g18_roi",
    f"""WITH b AS (SELECT tier, stake, {PNL} AS pnl, CASE outcome WHEN 'WON' THEN 'WIN' WHEN 'LOST' THEN 'LOSS' ELSE '' END AS o FROM ledger)
SELECT tier, count(*) AS total_bets, count(*) FILTER (o <> '') AS settled_bets, count(*) FILTER (o = 'WIN') AS wins, round(count(*) FILTER (o = 'WIN') / count(*) FILTER (o <> ''), 6) AS win_rate,
 round(sum(stake), 6) AS staked, round(sum(pnl) FILTER (o <> ''), 6) AS pnl, round(sum(pnl) FILTER (o <> '') / sum(stake) * 100, 6) AS roi_pct FROM b GROUP BY 1""",
)
def _(t):
    bets = t.ledger.select(
        "tier",
        "stake",
        F.expr(PNL).alias("pnl"),
        F.when(F.col("outcome") == "WON", "WIN").when(F.col("outcome") == "LOST", "LOSS").otherwise("").alias("outcome"),
    )
    return rounded(g.roi(bets, ["tier"]), "win_rate", "staked", "pnl", "roi_pct")


@query(
    "g19_value_counts",
    """SELECT 'tier' AS field, tier AS value, count(*) AS n FROM ledger GROUP BY 2 UNION ALL SELECT 'market', market, count(*) FROM ledger GROUP BY 2 UNION ALL SELECT 'outcome', outcome, count(*) FROM ledger GROUP BY 2""",
)
def _(t):
    return g.value_counts(t.ledger, ["tier", "market", "outcome"])


@query(
    "g20_event_metrics",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, count(*) FILTER (event_type = 'purchase') AS predictions,
 round(avg(value) FILTER (event_type = 'purchase'), 6) AS avg_confidence, round(count(*) FILTER (event_id % 9 = 0) / count(*), 6) AS fallback_rate FROM events GROUP BY 1""",
)
def _(t):
    out = g.event_metrics(t("events"), F.date_format("ts", "yyyy-MM-dd"), prediction="purchase", confidence="value", fallback=F.col("event_id") % 9 == 0)
    return rounded(out, "avg_confidence", "fallback_rate")


@query(
    "g21_ece_buckets",
    f"""WITH {S}, b AS (SELECT league, market, CASE WHEN probability < 0.5 THEN '0.00-0.50' WHEN probability < 0.6 THEN '0.50-0.60' WHEN probability < 0.7 THEN '0.60-0.70' WHEN probability < 0.8 THEN '0.70-0.80'
  WHEN probability < 0.9 THEN '0.80-0.90' ELSE '0.90-1.00' END AS bucket, count(*) AS n, abs(avg(probability) - avg(hit)) AS ece FROM s GROUP BY 1, 2, 3)
SELECT league, market, bucket, n, round(ece, 6) AS ece, CASE WHEN ece > 0.1 THEN 'BAD' WHEN ece > 0.05 THEN 'WARN' ELSE 'GOOD' END AS grade FROM b WHERE n >= 10""",
)
def _(t):
    return rounded(g.ece_buckets(g.settled(t.ledger)), "ece")


@query(
    "g22_structural_drift",
    """WITH m AS (SELECT max(match_date) - INTERVAL 10 DAY AS c FROM contests), a AS (SELECT avg(home_goals) + avg(away_goals) AS hg, avg(home_corners) + avg(away_corners) AS hc FROM contests),
r AS (SELECT avg(home_goals) + avg(away_goals) AS rg, avg(home_corners) + avg(away_corners) AS rc, count(*) AS n FROM contests, m WHERE match_date > c)
SELECT round(hg, 6) AS hist_goals, round(hc, 6) AS hist_corners, round(rg, 6) AS recent_goals, round(rc, 6) AS recent_corners, n AS sample_size, round(abs(rg - hg) / hg, 6) AS goals_shift, round(abs(rc - hc) / hc, 6) AS corners_shift FROM a, r""",
)
def _(t):
    out = g.structural_drift(t.contests, 10)
    return rounded(out, *[c for c in out.columns if c != "sample_size"])


@query(
    "g23_market_leaderboard",
    """SELECT market, count(*) FILTER (outcome = 'WON') AS wins, count(*) FILTER (outcome = 'LOST') AS losses, round(count(*) FILTER (outcome = 'WON') / count(*) FILTER (outcome <> 'VOID'), 6) AS win_rate FROM ledger GROUP BY 1""",
)
def _(t):
    return rounded(g.market_leaderboard(t.ledger), "win_rate")


@query(
    "g24_failure_report",
    """WITH x AS (SELECT CASE WHEN home_goals IS NULL OR away_goals IS NULL OR (m LIKE '%corn%' AND (home_corners IS NULL OR away_corners IS NULL)) OR (m LIKE '%card%' AND (home_cards IS NULL OR away_cards IS NULL)) THEN 'DATA_ILLUSION'
  WHEN abs(l.bet_id % 13 / 100) > 0.05 THEN 'ADJUSTMENT_INFLATION' WHEN m = 'u25' AND probability > 0.67 OR m IN ('home_under_1_5', 'card_o25') AND probability > 0.81 OR m = 'btts_yes' AND probability > 0.66 THEN 'ENFORCEMENT_BUG'
  ELSE 'LEGITIMATE_VARIANCE' END AS category FROM (SELECT *, CASE bet_id % 5 WHEN 0 THEN 'u25' WHEN 1 THEN 'btts_yes' WHEN 2 THEN 'corn_o75' WHEN 3 THEN 'card_o25' ELSE 'home_win' END AS m FROM ledger) l
  LEFT JOIN contests c ON l.match_id = c.match_id WHERE outcome = 'LOST' AND probability >= 0.7)
SELECT category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM x GROUP BY 1""",
)
def _(t):
    names = F.array(*[F.lit(m) for m in ("u25", "btts_yes", "corn_o75", "card_o25", "home_win")])
    lost = t.ledger.filter("outcome = 'LOST'").select(
        "match_id", "probability", F.get(names, (F.col("bet_id") % 5).cast("int")).alias("market"), (F.col("bet_id") % 13 / 100).alias("h2h_lift")
    )
    facts = t.contests.select("match_id", "home_goals", "away_goals", "home_corners", "away_corners", "home_cards", "away_cards")
    return rounded(g.failure_report(lost.join(facts, "match_id", "left")), "share")


@query(
    "g26_percentile_tiers",
    """WITH l AS (SELECT market, league, probability, row_number() OVER (PARTITION BY market, league ORDER BY ts DESC, bet_id DESC) AS rl, row_number() OVER (PARTITION BY market ORDER BY ts DESC, bet_id DESC) AS rg FROM ledger),
a AS (SELECT market, league, count(*) AS n, quantile_cont(probability, 0.8) AS l80, quantile_cont(probability, 0.9) AS l90, quantile_cont(probability, 0.95) AS l95 FROM l WHERE rl <= 2000 GROUP BY 1, 2),
b AS (SELECT market, quantile_cont(probability, 0.8) AS g80, quantile_cont(probability, 0.9) AS g90, quantile_cont(probability, 0.95) AS g95 FROM l WHERE rg <= 5000 GROUP BY 1),
w AS (SELECT a.*, b.* EXCLUDE market, CASE WHEN n < 100 THEN 0.3e0 WHEN n < 500 THEN 0.7e0 ELSE 1.0e0 END AS w FROM a JOIN b ON a.market = b.market),
q AS (SELECT market, league, n, w * l80 + (1 - w) * g80 AS q80, w * l90 + (1 - w) * g90 AS q90, w * l95 + (1 - w) * g95 AS q95 FROM w)
SELECT bet_id, CASE WHEN n < 50 THEN 'NO_BET' WHEN probability >= q95 THEN 'TIER_A' WHEN probability >= q90 THEN 'TIER_B' WHEN probability >= q80 THEN 'TIER_C' ELSE 'NO_BET' END AS action_tier
FROM ledger x JOIN q ON x.market = q.market AND x.league = q.league""",
)
def _(t):
    tiers = g.percentile_tiers(t.ledger, [F.col("ts").desc(), F.col("bet_id").desc()], F.col("bet_id"))
    out = t.ledger.join(tiers, ["market", "league"], "left")
    return out.select("bet_id", g.tier_of(F.col("probability")).alias("action_tier"))


@query(
    "g27_wilson",
    """WITH c AS (SELECT league, CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' ELSE 'D' END AS actual, CASE WHEN home_shots > away_shots THEN 'H' WHEN home_shots < away_shots THEN 'A' ELSE 'D' END AS pick FROM contests),
a AS (SELECT league, count(*) AS n, avg(CAST(actual = pick AS INT)) AS acc, greatest(count(*) FILTER (actual = 'H'), count(*) FILTER (actual = 'D'), count(*) FILTER (actual = 'A')) / count(*) AS b FROM c GROUP BY 1),
z AS (SELECT *, 1.959963984540054e0 AS z FROM a), w AS (SELECT *, 1 + z * z / n AS den, acc + z * z / (2 * n) AS cen, z * sqrt(acc * (1 - acc) / n + z * z / (4 * n * n)) AS mar FROM z)
SELECT league, n, round(acc, 6) AS accuracy, round(b, 6) AS baseline, round(cen / den - mar / den, 6) AS low, round(cen / den + mar / den, 6) AS high FROM w""",
)
def _(t):
    code = lambda h, a: F.when(F.col(h) > F.col(a), "H").when(F.col(h) < F.col(a), "A").otherwise("D")
    rows = t.contests.select("league", code("home_goals", "away_goals").alias("actual"), code("home_shots", "away_shots").alias("pick"))
    return rounded(g.wilson(rows, F.col("actual") == F.col("pick"), "actual", ["league"]), "accuracy", "baseline", "low", "high")


@query(
    "g28_feature_baselines",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75 FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
)
def _(t):
    out = g.feature_baselines(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(out, "mean", "std", "q25", "q50", "q75")


@query(
    "g30_backtest_calibration",
    """WITH r AS (SELECT *, (match_id % 100) / 100.0e0 AS ph, (match_id % 41) / 100.0e0 AS pd, (match_id % 83) / 100.0e0 AS pa, (match_id % 97) / 100.0e0 AS po, (match_id % 89) / 100.0e0 AS pb FROM contests),
x AS (SELECT 'home' AS outcome, ph AS p, home_goals > away_goals AS h FROM r UNION ALL SELECT 'draw', pd, home_goals = away_goals FROM r UNION ALL SELECT 'away', pa, home_goals < away_goals FROM r
  UNION ALL SELECT 'over_2_5', po, home_goals + away_goals > 2.5 FROM r UNION ALL SELECT 'btts', pb, home_goals > 0 AND away_goals > 0 FROM r),
b AS (SELECT outcome, p, CAST(h AS INT) AS h, CASE WHEN outcome IN ('home', 'draw', 'away') THEN CASE WHEN p < 0.25 THEN '0.00-0.25' WHEN p < 0.35 THEN '0.25-0.35' WHEN p < 0.45 THEN '0.35-0.45' WHEN p < 0.55 THEN '0.45-0.55'
  WHEN p < 0.7 THEN '0.55-0.70' WHEN p < 1 THEN '0.70-1.00' END ELSE CASE WHEN p < 0.3 THEN '0.00-0.30' WHEN p < 0.45 THEN '0.30-0.45' WHEN p < 0.55 THEN '0.45-0.55' WHEN p < 0.65 THEN '0.55-0.65' WHEN p < 0.8 THEN '0.65-0.80' WHEN p < 1 THEN '0.80-1.00' END END AS bucket FROM x)
SELECT outcome, bucket, count(*) AS n, round(avg(p), 6) AS mean_predicted, round(avg(h), 6) AS hit_rate, abs(avg(h) - avg(p)) < 0.1 AS ok FROM b WHERE bucket IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    p = lambda m: (F.col("match_id") % m) / 100.0
    rows = t.contests.withColumns({"pred_home": p(100), "pred_draw": p(41), "pred_away": p(83), "pred_o25": p(97), "pred_btts": p(89)})
    return rounded(g.backtest_calibration(rows), "mean_predicted", "hit_rate")


# ---- calibration measures -------------------------------------------------------------------------------


@query(
    "c03_apply_calibrator",
    """WITH k AS (SELECT * FROM (VALUES (0.1e0, 0.15e0), (0.4e0, 0.35e0), (0.7e0, 0.72e0), (0.9e0, 0.8e0)) v(x, y)),
q AS (SELECT bet_id, greatest(least(probability, 1 - 1e-6), 1e-6) AS p FROM ledger),
j AS (SELECT bet_id, p, max(CASE WHEN x <= p THEN x END) AS lx, max(CASE WHEN x <= p THEN y END) AS ly, min(CASE WHEN x > p THEN x END) AS hx, min(CASE WHEN x > p THEN y END) AS hy FROM q, k GROUP BY 1, 2),
c AS (SELECT bet_id, CASE WHEN lx IS NULL THEN hy WHEN hx IS NULL THEN ly ELSE ly + (hy - ly) * (p - lx) / (hx - lx) END AS c FROM j)
SELECT bet_id, round(c, 6) AS calibrated, round(-ln(1 - c), 6) AS rate FROM c""",
)
def _(t):
    knots = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.1, 0.15), (0.4, 0.35), (0.7, 0.72), (0.9, 0.8))])
    table = t.ledger.select("market").distinct().select("market", F.inline(knots))
    out = g.apply_calibrator(t.ledger, table)
    return out.select("bet_id", r6("calibrated").alias("calibrated"), r6(g.rate_from_probability(F.col("calibrated"))).alias("rate"))


@query(
    "c04_calibration_validation",
    f"""WITH {S}, b AS (SELECT market, {BIN['a']} AS bin, count(*) AS n, avg(probability) AS p, avg(hit) AS y, sum(probability) AS sp, sum(hit) AS sy FROM s GROUP BY ALL)
SELECT b.market, CAST(sum(n) AS BIGINT) AS n, round(sum(CASE WHEN bin IS NOT NULL THEN abs(sp - sy) END) / sum(n), 6) AS ece,
 round(CASE WHEN count(*) FILTER (bin IS NOT NULL AND n >= 10) >= 3 THEN regr_slope(y, p) FILTER (bin IS NOT NULL AND n >= 10) ELSE 0 END, 6) AS slope, round(sum(sp) / sum(n), 6) AS mean_conf, round(sum(sy) / sum(n), 6) AS mean_hit,
 round(max(sd), 6) AS std FROM b JOIN (SELECT market, stddev_pop(probability) AS sd FROM s GROUP BY 1) d ON b.market = d.market GROUP BY b.market""",
)
def _(t):
    return rounded(g.calibration_validation(g.settled(t.ledger), ["market"]), "ece", "slope", "mean_conf", "mean_hit", "std")


@query(
    "c05_sharpness",
    f"""WITH {S}, r AS (SELECT market, hit, probability, rank() OVER (PARTITION BY market ORDER BY probability) + (count(*) OVER (PARTITION BY market, probability) - 1) / 2.0 AS r FROM s),
a AS (SELECT market, count(*) AS n, stddev_pop(probability) AS sd, (sum(CASE WHEN hit = 1 THEN r END) - sum(hit) * (sum(hit) + 1) / 2) / (sum(hit) * (count(*) - sum(hit))) AS auc FROM r GROUP BY 1)
SELECT market, n, round(auc, 6) AS auc, round(sd, 6) AS std, CASE WHEN auc < 0.55 OR sd < 0.06 THEN 'DISABLED' ELSE 'ACTIVE' END AS status FROM a""",
)
def _(t):
    return rounded(g.sharpness(g.settled(t.ledger)), "auc", "std")


@query(
    "c06_adjust_alpha",
    f"""WITH {S}, e AS {ece_sql('a', 'market')}, a AS (SELECT market, CASE WHEN market LIKE '1%' THEN 0.98e0 WHEN market LIKE '2%' THEN 0.02e0 ELSE 0.8e0 END AS al FROM e)
SELECT e.market, round(ece, 6) AS ece, round(al, 6) AS alpha_before, round(CASE WHEN ece > 0.03 AND gap > 0 THEN greatest(al - 0.05, 0) WHEN ece > 0.03 AND gap < 0 THEN least(al + 0.05, 1) ELSE al END, 6) AS alpha_after
FROM e JOIN a ON e.market = a.market""",
)
def _(t):
    measured = g.ece(g.settled(t.ledger), ["market"], "a")
    known = t.ledger.filter("market LIKE '1%' OR market LIKE '2%'").select("market").distinct()
    alphas = known.withColumn("alpha", F.when(F.col("market").startswith("1"), 0.98).otherwise(0.02))
    out = g.adjust_alpha(measured, alphas).select("market", "ece", "alpha_before", "alpha_after")
    return rounded(out, "ece", "alpha_before", "alpha_after")


@query(
    "c10_metric_table",
    f"""WITH {S}, r AS (SELECT model_version, count(*) AS n, avg(abs(odds - stake)) AS mae, sqrt(avg((odds - stake) * (odds - stake))) AS rmse FROM s GROUP BY 1),
c AS (SELECT model_version, avg(CAST((probability >= 0.5) = (hit >= 0.5) AS INT)) AS acc, avg(-(hit * ln(greatest(least(probability, 1 - 1e-15), 1e-15)) + (1 - hit) * ln(1 - greatest(least(probability, 1 - 1e-15), 1e-15)))) AS ll,
  avg((probability - hit) * (probability - hit)) AS brier FROM s GROUP BY 1)
SELECT r.model_version, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(acc, 6) AS accuracy, round(ll, 6) AS log_loss, round(brier, 6) AS brier FROM r JOIN c ON r.model_version = c.model_version""",
)
def _(t):
    rows = g.settled(t.ledger)
    reg = g.regression_metrics(rows, "odds", "stake", ["model_version"]).select("model_version", "n", "mae", "rmse")
    cls = g.classification_metrics(rows, ["model_version"])
    return rounded(reg.join(cls, "model_version"), "mae", "rmse", "accuracy", "log_loss", "brier")
