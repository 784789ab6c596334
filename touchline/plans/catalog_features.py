"""Queries over the point-in-time features."""

from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators.ordered import first_per_key, top_per_key
from .registry import micros, query, r6, rounded

SIDE = ["match_id", "is_home"]
TW = "PARTITION BY team ORDER BY match_date, match_id ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING"


def tw(w):
    return TW.format(w=w)


WIDTHS = (3, 5, 10, 20)
MEANS = ["goals_for", "goals_against", "corners_for", "corners_against", "cards_for", "shots_for"]


@query(
    "w01_rolling_mean",
    "SELECT match_id, is_home, "
    + ", ".join(f"round(avg({c}) OVER ({tw(w)}), 6) AS {c}_avg{w}" for w in WIDTHS for c in MEANS)
    + " FROM team",
)
def _(t):
    out = ft.add_features(t.team, [ft.rolling_mean(MEANS, w) for w in WIDTHS])
    names = [f"{c}_avg{w}" for w in WIDTHS for c in MEANS]
    return rounded(out.select(*SIDE, *names), *names)


@query(
    "w02_rolling_density",
    f"""WITH f AS (SELECT match_id, is_home, count(*) OVER ({tw(10)}) AS n,
 floor((epoch_us(max(match_date) OVER ({tw(10)})) - epoch_us(min(match_date) OVER ({tw(10)}))) / 86400000000) AS span FROM team)
SELECT match_id, is_home, CAST(n AS BIGINT) AS games10, round(n / 10, 6) AS confidence10,
 CAST(span AS DOUBLE) AS span_days10, round(n / (span + 1), 6) AS density10 FROM f""",
)
def _(t):
    out = ft.add_features(t.team, [ft.rolling_density(10)])
    out = out.select(*SIDE, "games10", "confidence10", F.col("span_days10").cast("double"), "density10")
    return rounded(out, "confidence10", "density10")


@query(
    "w03_rolling_source_date",
    f"SELECT match_id, is_home, CAST(epoch_us(max(match_date) OVER ({tw(5)})) AS DOUBLE) AS source_us FROM team",
)
def _(t):
    out = ft.add_features(t.team, [ft.rolling_source_date(5)])
    return out.select(*SIDE, micros("max_source_date5").cast("double").alias("source_us"))


@query(
    "w04_season_blend",
    """WITH s AS (SELECT team, season, avg(goals_for) AS mean FROM team GROUP BY team, season),
p AS (SELECT team, season, lag(mean) OVER (PARTITION BY team ORDER BY season) AS prev FROM s),
g AS (SELECT avg(goals_for) AS m FROM team),
x AS (SELECT t.match_id, t.is_home, coalesce(p.prev, g.m) AS prev,
  count(goals_for) OVER w AS n, coalesce(sum(goals_for) OVER w, 0) AS s
  FROM team t JOIN p ON t.team = p.team AND t.season = p.season CROSS JOIN g
  WINDOW w AS (PARTITION BY t.team, t.season ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT match_id, is_home, round(CASE WHEN n = 0 THEN prev ELSE (s + prev * 5) / (n + 5) END, 6) AS goals_for_season FROM x""",
)
def _(t):
    out = ft.season_blend(t.team, ["goals_for"], k=5)
    return rounded(out.select(*SIDE, "goals_for_season"), "goals_for_season")


@query(
    "w05_form",
    """WITH q AS (SELECT match_id, is_home, list(CAST(points AS DOUBLE)) OVER (PARTITION BY team ORDER BY match_date, match_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM team)
SELECT match_id, is_home, round(CASE WHEN l IS NULL OR len(l) = 0 THEN 1.5 ELSE
 list_reduce(l, lambda a, x: a * 0.9 + x * 0.1) END, 6) AS form FROM q""",
)
def _(t):
    return rounded(ft.form(t.team).select(*SIDE, "form"), "form")


@query(
    "w06_rest_days",
    """SELECT match_id, is_home, CAST(least(coalesce(floor((epoch_us(match_date) - epoch_us(lag(match_date) OVER
 (PARTITION BY team ORDER BY match_date, match_id))) / 86400000000), 7), 21) AS BIGINT) AS rest_days FROM team""",
)
def _(t):
    return ft.add_features(t.team, [ft.rest_days()]).select(*SIDE, F.col("rest_days").cast("long"))


@query(
    "w07_season_goal_difference",
    """SELECT match_id, is_home, CAST(coalesce(sum(goals_for - goals_against) OVER (PARTITION BY team, season
 ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS season_goal_diff FROM team""",
)
def _(t):
    return ft.season_goal_difference(t.team).select(*SIDE, "season_goal_diff")


@query(
    "w08_missing_flags",
    f"""SELECT match_id, is_home, CAST(avg(corners_for) OVER ({tw(3)}) IS NULL AS INT) AS corners_for_avg3_missing,
 CAST(avg(goals_for) OVER ({tw(5)}) IS NULL AS INT) AS goals_for_avg5_missing FROM team""",
)
def _(t):
    out = ft.add_features(t.team, [ft.rolling_mean(["corners_for"], 3), ft.rolling_mean(["goals_for"], 5)])
    out = ft.missing_flags(out, ["corners_for_avg3", "goals_for_avg5"])
    return out.select(*SIDE, "corners_for_avg3_missing", "goals_for_avg5_missing")


SOS = f"""r AS (SELECT match_id, is_home, avg(goals_for) OVER ({tw(5)}) AS f, avg(goals_against) OVER ({tw(5)}) AS a FROM team)"""


@query(
    "w09_schedule_strength",
    f"""WITH {SOS} SELECT r.match_id, r.is_home, round(r.f - o.a, 6) AS sos_attack, round(o.f - r.a, 6) AS sos_defence
FROM r JOIN r o ON r.match_id = o.match_id AND r.is_home <> o.is_home""",
)
def _(t):
    out = ft.add_features(t.team, [ft.rolling_mean(["goals_for", "goals_against"], 5)])
    out = ft.schedule_strength(out, "goals_for_avg5", "goals_against_avg5")
    return rounded(out.select(*SIDE, "sos_attack", "sos_defence"), "sos_attack", "sos_defence")


@query(
    "w10_streaks",
    """WITH q AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY match_date, match_id) AS rn FROM team)
SELECT match_id, is_home,
 CAST(rn - 1 - coalesce(max(CASE WHEN points < 3 THEN rn END) OVER w, 0) AS BIGINT) AS win_streak,
 CAST(rn - 1 - coalesce(max(CASE WHEN points < 1 THEN rn END) OVER w, 0) AS BIGINT) AS unbeaten_streak
FROM q WINDOW w AS (PARTITION BY team ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def _(t):
    return ft.streaks(t.team).select(*SIDE, "win_streak", "unbeaten_streak")


@query(
    "w11_dominance",
    f"""WITH q AS (SELECT match_id, is_home, avg(CAST(goals_against = 0 AS INT)) OVER w AS cs, sum(goals_for) OVER w AS gf,
 sum(goals_against) OVER w AS ga, sum(shots_for) OVER w AS sf, sum(shots_against) OVER w AS sa FROM team WINDOW w AS ({tw(5)}))
SELECT match_id, is_home, round(coalesce(cs, 0), 6) AS clean_sheet_rate,
 round(coalesce(gf / nullif(gf + ga, 0), 0.5), 6) AS goals_dominance,
 round(coalesce(sf / nullif(sf + sa, 0), 0.5), 6) AS shots_dominance FROM q""",
)
def _(t):
    out = ft.add_features(t.team, [ft.clean_sheets(5), ft.dominance("goals"), ft.dominance("shots")])
    names = ["clean_sheet_rate", "goals_dominance", "shots_dominance"]
    return rounded(out.select(*SIDE, *names), *names)


@query(
    "w12_pressure",
    f"""WITH q AS (SELECT match_id, is_home, avg(shots_for) OVER w - avg(shots_against) OVER w AS s,
 avg(corners_for) OVER w - avg(corners_against) OVER w AS c FROM team WINDOW w AS ({tw(5)}))
SELECT match_id, is_home, round(coalesce(s + 0.7 * c, c), 6) AS pressure_index FROM q""",
)
def _(t):
    return rounded(ft.add_features(t.team, [ft.pressure(5)]).select(*SIDE, "pressure_index"), "pressure_index")


@query(
    "w13_home_advantage",
    """SELECT match_id, is_home, round(coalesce(avg(CASE WHEN is_home = 1 THEN goals_for END) OVER w, 1.5)
 - coalesce(avg(CASE WHEN is_home = 0 THEN goals_for END) OVER w, 1.0), 6) AS home_advantage
FROM team WINDOW w AS (PARTITION BY team ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def _(t):
    return rounded(ft.add_features(t.team, [ft.home_advantage()]).select(*SIDE, "home_advantage"), "home_advantage")


@query(
    "w14_head_to_head",
    """WITH c AS (SELECT match_id, match_date, least(home_team, away_team) || '__vs__' || greatest(home_team, away_team) AS pair,
  home_goals + away_goals AS g, home_cards + away_cards AS k, coalesce(home_corners, 0) + coalesce(away_corners, 0) AS c,
  home_goals > 0 AND away_goals > 0 AS b FROM contests),
m AS (SELECT avg(home_cards) + avg(away_cards) AS mk, avg(home_corners) + avg(away_corners) AS mc FROM contests),
q AS (SELECT match_id, pair, count(*) OVER w AS n, count(*) OVER (PARTITION BY pair) AS meetings,
  sum(g) OVER w AS sg, sum(k) OVER w AS sk, sum(c) OVER w AS sc,
  coalesce(sum(CAST(g > 2.5 AS INT)) OVER w, 0) AS h1, coalesce(sum(CAST(b AS INT)) OVER w, 0) AS h2,
  coalesce(sum(CAST(k > 2.5 AS INT)) OVER w, 0) AS h3, coalesce(sum(CAST(c < 11.5 AS INT)) OVER w, 0) AS h4
  FROM c WINDOW w AS (PARTITION BY pair ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT match_id, pair, n AS h2h_count, round(coalesce(sg / nullif(n, 0), 2.5), 6) AS h2h_avg_goals,
 round(coalesce(sk / nullif(n, 0), mk), 6) AS h2h_avg_cards, round(coalesce(sc / nullif(n, 0), mc), 6) AS h2h_avg_corners,
 round(CASE WHEN meetings > 1 THEN h1 / (n + 1) ELSE 0.53 END, 6) AS h2h_over_2_5_rate,
 round(CASE WHEN meetings > 1 THEN h2 / (n + 1) ELSE 0.54 END, 6) AS h2h_btts_rate,
 round(CASE WHEN meetings > 1 THEN h3 / (n + 1) ELSE 0.77 END, 6) AS h2h_cards_over_2_5_rate,
 round(CASE WHEN meetings > 1 THEN h4 / (n + 1) ELSE 0.72 END, 6) AS h2h_corners_under_11_5_rate FROM q CROSS JOIN m""",
)
def _(t):
    out = ft.head_to_head(t.contests)
    rates = [c for c in out.columns if c.startswith("h2h_") and c != "h2h_count"]
    return rounded(out.select("match_id", "pair", "h2h_count", *rates), *rates)


@query(
    "w15_referee_rate",
    """WITH q AS (SELECT match_id, coalesce(nullif(trim(referee), ''), 'UNKNOWN') AS referee_key, match_date,
 home_cards + away_cards AS k FROM contests)
SELECT match_id, referee_key, round(coalesce(avg(k) OVER (PARTITION BY referee_key ORDER BY match_date, match_id
 ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), (SELECT avg(k) FROM q)), 6) AS referee_card_rate FROM q""",
)
def _(t):
    out = ft.referee_rate(t.contests)
    return rounded(out.select("match_id", "referee_key", "referee_card_rate"), "referee_card_rate")


@query(
    "w16_congestion",
    """SELECT a.match_id, a.is_home, count(b.match_id) AS congestion FROM team a LEFT JOIN team b ON a.team = b.team
 AND b.match_date < a.match_date AND b.match_date > a.match_date - INTERVAL 7 DAY GROUP BY 1, 2""",
)
def _(t):
    return ft.congestion(t.team).select(*SIDE, "congestion")


@query(
    "w17_context",
    """WITH q AS (SELECT match_id, CAST(isodow(match_date) - 1 AS INT) AS day_of_week, ((month(match_date) - 8 + 12) % 12) / 12 AS p FROM contests)
SELECT match_id, day_of_week, CAST(day_of_week >= 5 AS INT) AS is_weekend, round(p, 6) AS season_progress,
 CASE WHEN p <= 0.33 THEN 'early' WHEN p <= 0.66 THEN 'mid' ELSE 'late' END AS season_phase FROM q""",
)
def _(t):
    out = ft.context(t.contests)
    return rounded(out.select("match_id", "day_of_week", "is_weekend", "season_progress", "season_phase"), "season_progress")


@query(
    "w18_matchup_deltas",
    f"""WITH {SOS} SELECT h.match_id, round(h.f - a.f, 6) AS delta_goals_for_avg5, round(h.a - a.a, 6) AS delta_goals_against_avg5,
 round(abs(h.f - a.f), 6) AS abs_delta_goals_for_avg5, round(abs(h.a - a.a), 6) AS abs_delta_goals_against_avg5
FROM r h JOIN r a ON h.match_id = a.match_id WHERE h.is_home = 1 AND a.is_home = 0""",
)
def _(t):
    names = ["goals_for_avg5", "goals_against_avg5"]
    team = ft.add_features(t.team, [ft.rolling_mean(["goals_for", "goals_against"], 5)])
    out = ft.deltas(ft.reassemble(t.contests.select("match_id"), team, names), names)
    cols = [c for c in out.columns if "delta" in c]
    return rounded(out.select("match_id", *cols), *cols)


@query(
    "w19_impute_priors",
    f"""SELECT match_id, is_home, round(coalesce(avg(goals_for) OVER ({tw(5)}), 1.35), 6) AS goals_for_avg5,
 round(coalesce(avg(corners_for) OVER ({tw(5)}), 4.5), 6) AS corners_for_avg5,
 round(coalesce(avg(cards_for) OVER ({tw(5)}), 2.2), 6) AS cards_for_avg5,
 round(coalesce(avg(shots_for) OVER ({tw(5)}), 1.35), 6) AS shots_for_avg5 FROM team""",
)
def _(t):
    base = ["goals_for", "corners_for", "cards_for", "shots_for"]
    names = [f"{c}_avg5" for c in base]
    out = ft.impute_priors(ft.add_features(t.team, [ft.rolling_mean(base, 5)]), names)
    return rounded(out.select(*SIDE, *names), *names)


@query(
    "w20_team_rows",
    "SELECT match_id, team, opponent, is_home, goals_for, goals_against, CAST(corners_for AS DOUBLE) AS corners_for, points FROM team",
)
def _(t):
    return t.team.select(
        "match_id", "team", "opponent", "is_home", "goals_for", "goals_against", F.col("corners_for").cast("double"), "points"
    )


@query(
    "w21_prioritised_dedup",
    """WITH d AS (SELECT o_custkey AS match_key, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FT' WHEN 'O' THEN 'SCHEDULED' ELSE 'LIVE' END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS score, o_orderdate FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY match_key ORDER BY CASE WHEN status IN ('FT', 'FINISHED') THEN 0 WHEN status = 'LIVE' THEN 1
  WHEN status IN ('SCHEDULED', 'TBD') THEN 2 ELSE 3 END, CASE WHEN score IS NULL THEN 1 ELSE 0 END, o_orderdate DESC NULLS LAST, o_orderkey) AS rn FROM d)
SELECT match_key, o_orderkey, status, score FROM r WHERE rn = 1""",
)
def _(t):
    status = F.when(F.col("o_orderstatus") == "F", "FT").when(F.col("o_orderstatus") == "O", "SCHEDULED").otherwise("LIVE")
    copies = t("orders").select(
        F.col("o_custkey").alias("match_key"),
        "o_orderkey",
        status.alias("status"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("score"),
        F.col("o_orderdate").cast("timestamp").alias("match_date"),
    )
    return dedup_matches(copies, "match_key", tie="o_orderkey").select("match_key", "o_orderkey", "status", "score")


def dedup_matches(df, key, status="status", score="score", time="match_date", tie="match_id"):
    """Best copy of a match: finished before live before scheduled, scored, latest."""
    rank = (
        F.when(F.col(status).isin("FT", "FINISHED"), 0)
        .when(F.col(status) == "LIVE", 1)
        .when(F.col(status).isin("SCHEDULED", "TBD"), 2)
        .otherwise(3)
    )
    newest = F.coalesce(-F.unix_micros(time), F.lit(2**62))
    return first_per_key(df, [key], [rank, F.col(score).isNull(), newest, F.col(tie)])


@query(
    "w22_first_wins_dedup",
    """WITH r AS (SELECT o_custkey, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority
 ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END, o_orderdate, o_orderkey) AS rn FROM orders)
SELECT o_custkey, o_orderpriority, o_orderkey FROM r WHERE rn = 1""",
)
def _(t):
    source_rank = F.when(F.col("o_orderstatus") == "F", 0).otherwise(1)
    rows = t("orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate", source_rank.alias("source_rank"))
    out = first_per_key(rows, ["o_custkey", "o_orderpriority"], [F.col("source_rank"), F.col("o_orderdate"), F.col("o_orderkey")])
    return out.select("o_custkey", "o_orderpriority", "o_orderkey")


def rolling_brier(evaluations, baselines, keys, order, width=30, tolerance=1.15, spread="bet_id"):
    """Brier score of the last ``width`` settled rows per key; breach when the frame is full and worse than baseline."""
    last = top_per_key(evaluations, keys, order, width, F.col(spread))
    error = F.pow(F.col("probability") - F.col("hit"), F.lit(2))
    out = last.groupBy(*keys).agg(F.avg(error).alias("rolling_brier"), F.count(F.lit(1)).alias("n"))
    out = out.join(baselines, keys, "left")
    breach = (F.col("n") == width) & (F.col("rolling_brier") > F.col("baseline") * tolerance)
    return out.withColumn("breach", F.coalesce(breach, F.lit(False)))


@query(
    "w23_rolling_brier",
    """WITH s AS (SELECT league, market, bet_id, ts, probability, CASE WHEN outcome = 'WON' THEN 1.0 ELSE 0.0 END AS hit FROM ledger WHERE outcome <> 'VOID'),
b AS (SELECT league, market, avg((probability - hit) * (probability - hit)) AS baseline FROM s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY league, market ORDER BY ts DESC, bet_id DESC) AS rn FROM s),
a AS (SELECT league, market, avg((probability - hit) * (probability - hit)) AS rb, count(*) AS n FROM r WHERE rn <= 30 GROUP BY 1, 2)
SELECT a.league, a.market, round(rb, 6) AS rolling_brier, n, round(baseline, 6) AS baseline, n = 30 AND rb > baseline * 1.15 AS breach
FROM a JOIN b ON a.league = b.league AND a.market = b.market""",
)
def _(t):
    settled = settled_rows(t.ledger)
    error = F.pow(F.col("probability") - F.col("hit"), F.lit(2))
    base = settled.groupBy("league", "market").agg(F.avg(error).alias("baseline"))
    out = rolling_brier(settled, base, ["league", "market"], [F.col("ts").desc(), F.col("bet_id").desc()])
    return rounded(out.select("league", "market", "rolling_brier", "n", "baseline", "breach"), "rolling_brier", "baseline")


def settled_rows(ledger):
    return ledger.filter(F.col("outcome") != "VOID").withColumn("hit", (F.col("outcome") == "WON").cast("double"))


@query(
    "w24_latest_per_scope",
    """SELECT league, model_version, arg_max(bet_id, (ts, bet_id)) AS bet_id, epoch_us(max(ts)) AS ts_us FROM ledger GROUP BY 1, 2""",
)
def _(t):
    rows = t.ledger.select("league", "model_version", "bet_id", "ts")
    out = first_per_key(rows, ["league", "model_version"], [F.col("ts"), F.col("bet_id")], descending=True)
    return out.select("league", "model_version", "bet_id", micros("ts").alias("ts_us"))


@query(
    "w25_days_since_meeting",
    """SELECT match_id, CAST(floor((epoch_us(match_date) - epoch_us(lag(match_date) OVER (PARTITION BY least(home_team, away_team),
 greatest(home_team, away_team) ORDER BY match_date, match_id))) / 86400000000) AS DOUBLE) AS days_since_h2h FROM contests""",
)
def _(t):
    return ft.days_since_meeting(t.contests).select("match_id", F.col("days_since_h2h").cast("double"))
