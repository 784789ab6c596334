"""Queries over joins, sets, keyed writes, labels and settlement."""

from pyspark.sql import functions as F

from ..operators import joins as j
from ..operators import labels as lab
from ..operators import validate as v
from ..operators.names import weighted_candidates
from ..operators.ordered import as_of
from .registry import micros, query, r6, rounded

MARKETS = lab.default_markets()
BASIC = "home_goals, away_goals, home_corners, away_corners, home_cards, away_cards"


@query(
    "j01_join_labels",
    "SELECT l.bet_id, c.home_goals > c.away_goals AS home_win FROM ledger l JOIN contests c ON l.match_id = c.match_id",
)
def _(t):
    facts = t.contests.select("match_id", (F.col("home_goals") > F.col("away_goals")).alias("home_win"))
    return j.join_labels(t.ledger, facts, "match_id").select("bet_id", "home_win")


@query(
    "j02_join_many_to_one",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY league, market ORDER BY ts, bet_id) AS rn FROM ledger)
SELECT l.bet_id, r.bet_id AS first_bet FROM ledger l JOIN r ON l.league = r.league AND l.market = r.market AND rn = 1""",
)
def _(t):
    right = t.ledger.select("league", "market", "ts", F.col("bet_id").alias("first_bet"))
    out = j.join_many_to_one(t.ledger.drop("ts"), right, ["league", "market"], [F.col("ts"), F.col("first_bet")])
    return out.select("bet_id", "first_bet")


@query(
    "j03_reassemble",
    """SELECT h.match_id, h.points AS home_points, a.points AS away_points, h.goals_for AS home_goals_for, a.goals_for AS away_goals_for
FROM team h JOIN team a ON h.match_id = a.match_id WHERE h.is_home = 1 AND a.is_home = 0""",
)
def _(t):
    from ..operators.features import reassemble

    return reassemble(t.contests.select("match_id"), t.team, ["points", "goals_for"])


@query(
    "j04_with_opponent",
    """SELECT t.match_id, t.is_home, o.points AS opp_points, CAST(o.corners_for AS DOUBLE) AS opp_corners_for FROM team t
JOIN team o ON t.match_id = o.match_id AND t.team = o.opponent AND t.is_home <> o.is_home""",
)
def _(t):
    from ..operators.features import with_opponent

    out = with_opponent(t.team, ["points", "corners_for"])
    return out.select("match_id", "is_home", "opp_points", F.col("opp_corners_for").cast("double"))


@query(
    "j05_enrich_left",
    """WITH e AS (SELECT match_id, arg_max(probability, (ts, bet_id)) AS xg FROM ledger GROUP BY match_id)
SELECT c.match_id, e.xg FROM contests c LEFT JOIN e ON c.match_id = e.match_id""",
)
def _(t):
    extra = t.ledger.select("match_id", F.col("probability").alias("xg"), "ts", "bet_id")
    out = j.enrich_left(t.contests, extra, ["match_id"], ["xg", "absent"], [F.col("ts"), F.col("bet_id")])
    return out.select("match_id", "xg")


@query(
    "j06_enrich_missing",
    """SELECT c.match_id, c.home_corners IS NULL AND s.day IS NOT NULL AS enriched,
 CAST(CASE WHEN c.home_corners IS NULL AND s.day IS NOT NULL THEN s.hc ELSE c.home_corners END AS DOUBLE) AS home_corners,
 CASE WHEN c.home_corners IS NULL AND s.day IS NOT NULL THEN coalesce(s.hk, 0) ELSE c.home_cards END AS home_cards,
 CAST(CASE WHEN c.home_corners IS NULL AND s.day IS NOT NULL THEN s.hc + s.ac ELSE c.home_corners + c.away_corners END AS DOUBLE) AS total_corners
FROM contests c LEFT JOIN (SELECT strftime(match_date, '%Y-%m-%d') AS day, home_team, away_team, arg_max(home_shots, match_id) AS hc,
  arg_max(away_shots, match_id) AS ac, nullif(arg_max(CASE WHEN match_id % 4 = 0 THEN -1 ELSE home_cards END, match_id), -1) AS hk
  FROM contests GROUP BY 1, 2, 3 HAVING count(*) = 1) s
 ON strftime(c.match_date, '%Y-%m-%d') = s.day AND c.home_team = s.home_team AND c.away_team = s.away_team""",
)
def _(t):
    c = t.contests
    day = F.date_format("match_date", "yyyy-MM-dd")
    stats = (
        c.withColumn("day", day)
        .groupBy("day", F.concat(F.lit("fc "), F.lower("home_team")).alias("home"), F.col("away_team").alias("away"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max_by("home_shots", "match_id").alias("home_corners"),
            F.max_by("away_shots", "match_id").alias("away_corners"),
            F.nullif(
                F.max_by(F.when(F.col("match_id") % 4 == 0, F.lit(-1)).otherwise(F.col("home_cards")), "match_id"), F.lit(-1)
            ).alias("home_cards"),
            F.max_by("away_cards", "match_id").alias("away_cards"),
        )
        .filter("n = 1")
    )
    rows = c.withColumn("total_corners", F.col("home_corners") + F.col("away_corners"))
    out = j.enrich_missing(rows, stats)
    return out.select(
        "match_id",
        "enriched",
        F.col("home_corners").cast("double"),
        "home_cards",
        F.col("total_corners").cast("double"),
    )


@query(
    "j07_in_universe",
    """SELECT c.match_id, epoch_us(p.t) AS first_us FROM contests c JOIN (SELECT match_id, min(ts) AS t FROM ledger GROUP BY 1) p ON c.match_id = p.match_id""",
)
def _(t):
    return j.in_universe(t.contests, t.ledger, "match_id", "ts").select("match_id", micros("first_prediction").alias("first_us"))


LATE = "CASE WHEN match_id % 7 = 0 THEN ts + INTERVAL 30 YEAR ELSE ts END"


@query(
    "j08_temporal_violations",
    f"""SELECT c.match_id, epoch_us(p.t) AS first_us FROM contests c JOIN (SELECT match_id, min({LATE}) AS t FROM ledger GROUP BY 1) p
ON c.match_id = p.match_id WHERE c.match_date < p.t""",
)
def _(t):
    preds = t.ledger.select("match_id", F.expr(LATE).alias("made"))
    out = j.temporal_violations(t.contests, preds, "match_id", "match_date", "made")
    return out.select("match_id", micros("first_prediction").alias("first_us"))


@query("j09_unseen", "SELECT match_id FROM contests WHERE match_id NOT IN (SELECT match_id FROM ledger)")
def _(t):
    return j.unseen(t.contests, t.ledger, "match_id").select("match_id")


@query(
    "j10_join_with_fallback",
    """WITH p AS (SELECT match_id, CASE WHEN match_id % 3 = 0 THEN -match_id - 1 ELSE match_id END AS pid, strftime(match_date, '%Y-%m-%d') AS day, upper(home_team) AS home_team, away_team FROM contests),
r AS (SELECT match_id AS pid, strftime(match_date, '%Y-%m-%d') AS day, home_team, away_team, home_goals FROM contests),
n AS (SELECT day, lower(home_team) AS h, lower(away_team) AS a, arg_min(home_goals, pid) AS home_goals FROM r GROUP BY 1, 2, 3)
SELECT p.match_id, coalesce(r.home_goals, n.home_goals) AS home_goals, CASE WHEN r.pid IS NOT NULL THEN 'id' ELSE 'teams' END AS matched_by FROM p
LEFT JOIN r ON p.pid = r.pid LEFT JOIN n ON p.day = n.day AND lower(p.home_team) = n.h AND lower(p.away_team) = n.a WHERE r.pid IS NOT NULL OR n.day IS NOT NULL""",
)
def _(t):
    base = t.contests.withColumn("day", F.date_format("match_date", "yyyy-MM-dd"))
    pid = F.when(F.col("match_id") % 3 == 0, -F.col("match_id") - 1).otherwise(F.col("match_id"))
    preds = base.select("match_id", pid.alias("pid"), "day", F.upper("home_team").alias("home_team"), "away_team")
    results = base.select(F.col("match_id").alias("pid"), "day", "home_team", "away_team", "home_goals")
    out = j.join_with_fallback(preds, results, "pid", ["day", "home_team", "away_team"], ["home_goals"])
    return out.select("match_id", "home_goals", "matched_by")


@query(
    "j11_as_of",
    """WITH l AS (SELECT * FROM events WHERE event_id % 3 = 0), r AS (SELECT * FROM events WHERE event_id % 3 = 1)
SELECT l.event_id, coalesce(max((r.ts, r.event_id, r.value)) FILTER (r.ts <= l.ts), min((r.ts, r.event_id, r.value)))[3] AS snapshot
FROM l LEFT JOIN r ON l.user_id = r.user_id GROUP BY l.event_id""",
)
def _(t):
    events = t("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    left = events.filter("event_id % 3 = 0").select("event_id", "user_id", "ts")
    right = events.filter("event_id % 3 = 1").select("user_id", "ts", F.col("event_id").alias("snapshot_id"), F.col("value").alias("snapshot"))
    out = as_of(left, right, ["user_id"], "ts", ["snapshot"], right_tie=["snapshot_id"], default_first=True)
    return out.select("event_id", "snapshot")


@query(
    "j12_last_n_before",
    """WITH h AS (SELECT league, home_team, match_date, match_id, avg(home_goals) OVER w AS m, count(*) OVER w AS n FROM contests
 WINDOW w AS (PARTITION BY league, home_team ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT match_id, round(CASE WHEN n >= 3 THEN m ELSE 1.3 END, 6) AS home_scored FROM h""",
)
def _(t):
    c = t.contests
    probes = c.select("match_id", "league", "home_team", "match_date")
    out = j.last_n_before(probes, c, ["league", "home_team"], "match_date", "match_id", "home_goals", 5, 3, 1.3, "home_scored")
    return rounded(out.select("match_id", "home_scored"), "home_scored")


@query(
    "j15_canonical_market",
    """SELECT bet_id, CASE market_key WHEN 'over_2_5' THEN 'goals_over_2_5' WHEN 'corn_o75' THEN 'corners_over_7_5' ELSE market_key END AS label FROM ledger""",
)
def _(t):
    return t.ledger.select("bet_id", lab.canonical_market("market_key").alias("label"))


# ---- sets and keyed writes ------------------------------------------------------------------------------


@query(
    "s01_union_all",
    """SELECT c_custkey AS id, c_name AS name, coalesce(c_mktsegment, '-') AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, '-' FROM supplier""",
)
def _(t):
    a = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = t("supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return j.union_all([a, b]).withColumn("segment", F.coalesce("segment", F.lit("-")))


@query("s02_common_keys", "SELECT match_id FROM contests INTERSECT SELECT match_id FROM ledger")
def _(t):
    return j.common_keys(t.contests, t.ledger, ["match_id"])


@query(
    "s03_key_diff",
    """SELECT o_custkey, 'lost' AS side FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
UNION ALL SELECT o_custkey, 'gained' FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def _(t):
    o = t("orders")
    return j.key_diff(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), ["o_custkey"])


@query("s04_team_counts", "SELECT league, team, count(*) AS matches FROM team GROUP BY 1, 2")
def _(t):
    return j.team_counts(t.contests)


@query(
    "s05_supersede",
    """WITH f AS (SELECT league, season, match_id, status FROM contests WHERE status = 'FT' AND season <> 'S3'),
u AS (SELECT league, season, match_id, status FROM contests WHERE status = 'SCHEDULED')
SELECT * FROM f UNION ALL SELECT * FROM u WHERE (league, season) NOT IN (SELECT league, season FROM f)""",
)
def _(t):
    c = t.contests.select("league", "season", "match_id", "status")
    return j.supersede(c.filter("status = 'FT' AND season <> 'S3'"), c.filter("status = 'SCHEDULED'"), ["league", "season"])


@query(
    "io03_quarantine",
    """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 'bad' ELSE 'good' END AS part FROM events""",
)
def _(t):
    from ..functions.scalars import parse_day_first
    from ..operators.validate import split_invalid

    text = F.when(F.col("event_id") % 5 == 4, "not a day").otherwise(F.date_format("ts", "dd/MM/yyyy"))
    good, bad = split_invalid(t("events").select("event_id", text.alias("day")), parse_day_first("day").isNotNull())
    return good.select("event_id", F.lit("good").alias("part")).unionByName(bad.select("event_id", F.lit("bad").alias("part")))


@query(
    "io06_attach_odds",
    """WITH o AS (SELECT upper(home_team) || ' vs ' || upper(away_team) AS k, min(1.5 + (match_id % 40) / 20) AS p FROM contests WHERE match_id % 23 = 0 GROUP BY 1),
f AS (SELECT match_id, upper(home_team) || CASE WHEN match_id % 9 = 0 THEN 'X' ELSE '' END AS h, upper(away_team) AS a FROM contests),
hp AS (SELECT h, arg_min(p, k) AS p FROM (SELECT DISTINCT h FROM f) JOIN o ON contains(k, h) GROUP BY h)
SELECT f.match_id, round(coalesce(o.p, hp.p, 1.9), 6) AS price, CASE WHEN o.k IS NOT NULL THEN 'exact' WHEN hp.h IS NOT NULL THEN 'home' ELSE 'default' END AS odds_source
FROM f LEFT JOIN o ON f.h || ' vs ' || f.a = o.k LEFT JOIN hp ON f.h = hp.h""",
)
def _(t):
    c = t.contests
    key = F.concat(F.upper("home_team"), F.lit(" vs "), F.upper("away_team"))
    price = F.min(1.5 + (F.col("match_id") % 40) / 20)
    odds = c.filter("match_id % 23 = 0").groupBy(key.alias("fixture")).agg(price.alias("p"))
    odds = odds.select("fixture", F.create_map(F.lit("goals_o25"), "p").alias("markets"))
    tail = F.when(F.col("match_id") % 9 == 0, "X").otherwise("")
    fixtures = c.select("match_id", F.concat(F.upper("home_team"), tail).alias("home_team"), F.upper("away_team").alias("away_team"))
    out = j.attach_odds(fixtures, odds, {"goals_o25": 1.90})
    return out.select("match_id", r6(F.try_element_at("markets", F.lit("goals_o25"))).alias("price"), "odds_source")


@query(
    "io09_append_new",
    """WITH e AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT o_custkey FROM e) GROUP BY 1""",
)
def _(t):
    o = t("orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    out = j.append_new(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus <> 'F'"), ["o_custkey"], [F.col("o_orderkey")])
    return out.select("o_custkey", "o_orderkey")


@query(
    "io10_upsert",
    """WITH e AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
n AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT coalesce(e.o_custkey, n.o_custkey) AS o_custkey, coalesce(n.k, e.k) AS o_orderkey,
 CASE WHEN e.k IS NULL THEN 'inserted' WHEN n.k IS NULL THEN 'kept' ELSE 'updated' END AS change FROM e FULL JOIN n ON e.o_custkey = n.o_custkey""",
)
def _(t):
    o = t("orders")
    existing = o.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    incoming = o.filter("o_orderstatus = 'O'").select("o_custkey", "o_orderkey")
    return j.upsert(existing, incoming, ["o_custkey"], [-F.col("o_orderkey")])


@query(
    "g29_overlap",
    """SELECT (SELECT count(DISTINCT match_id) FROM contests) AS in_a, (SELECT count(DISTINCT match_id) FROM ledger) AS in_b,
 (SELECT count(DISTINCT match_id) FROM contests WHERE match_id IN (SELECT match_id FROM ledger)) AS in_both""",
)
def _(t):
    return j.overlap(t.contests, t.ledger, ["match_id"])


NAMES = """names AS (SELECT DISTINCT league, season, upper(trim(CASE match_id % 5 WHEN 0 THEN ' ' || home_team || ' ' WHEN 1 THEN home_team || 'x' WHEN 2 THEN 'the ' || home_team
 WHEN 3 THEN substring(home_team, 2) ELSE 'A' || home_team END)) AS name FROM contests),
m AS (SELECT DISTINCT league, season, upper(away_team) AS team FROM contests WHERE match_id % 7 <> 0 AND season <> 'S1'),
al AS (SELECT DISTINCT league, upper('the ' || home_team) AS name, upper(home_team) AS team FROM contests WHERE match_id % 2 = 0)"""


@query(
    "x04_resolve_names",
    f"""WITH {NAMES}, sc AS (SELECT n.league, n.season, n.name, m.league AS ml, m.season AS ms, m.team,
  100.0 * (1 - CAST(levenshtein(n.name, m.team) AS DOUBLE) / greatest(length(n.name), length(m.team))) AS score FROM names n, m),
f4 AS (SELECT league, season, name, min(team) AS team FROM (SELECT *, rank() OVER (PARTITION BY league, season, name ORDER BY score DESC) AS r FROM sc
  WHERE ml = league AND ms = season AND score >= 85 - 1e-9) WHERE r = 1 GROUP BY 1, 2, 3),
f6 AS (SELECT name, min(team) AS team FROM (SELECT name, team, rank() OVER (PARTITION BY name ORDER BY score DESC) AS r FROM sc WHERE score >= 85 - 1e-9) WHERE r = 1 GROUP BY 1),
a2 AS (SELECT league, name, min(team) AS team FROM al GROUP BY 1, 2),
a5 AS (SELECT name, min(team) AS team FROM (SELECT team AS name, team FROM m UNION ALL SELECT name, team FROM al) GROUP BY 1)
SELECT n.league, n.season, n.name, coalesce(s1.team, a2.team, s3.team, f4.team, a5.team, f6.team, n.name) AS team,
 CASE WHEN s1.team IS NOT NULL THEN 'season' WHEN a2.team IS NOT NULL THEN 'alias' WHEN s3.team IS NOT NULL THEN 'other season' WHEN f4.team IS NOT NULL THEN 'fuzzy'
  WHEN a5.team IS NOT NULL THEN 'other league' WHEN f6.team IS NOT NULL THEN 'fuzzy other league' ELSE 'unresolved' END AS via
FROM names n LEFT JOIN m s1 ON n.league = s1.league AND n.season = s1.season AND n.name = s1.team
LEFT JOIN a2 ON n.league = a2.league AND n.name = a2.name LEFT JOIN (SELECT DISTINCT league, team FROM m) s3 ON n.league = s3.league AND n.name = s3.team
LEFT JOIN f4 ON n.league = f4.league AND n.season = f4.season AND n.name = f4.name LEFT JOIN a5 ON n.name = a5.name LEFT JOIN f6 ON n.name = f6.name""",
)
def _(t):
    c = t.contests
    raw = F.expr(
        "CASE match_id % 5 WHEN 0 THEN ' ' || home_team || ' ' WHEN 1 THEN home_team || 'x' WHEN 2 THEN 'the ' || home_team "
        "WHEN 3 THEN substring(home_team, 2) ELSE 'A' || home_team END"
    )
    names = c.select("league", "season", raw.alias("name"))
    members = c.filter("match_id % 7 <> 0 AND season <> 'S1'").select("league", "season", F.col("away_team").alias("team"))
    aliases = c.filter("match_id % 2 = 0").select(
        "league", F.concat(F.lit("the "), "home_team").alias("alias"), F.col("home_team").alias("team")
    ).distinct()
    return j.resolve_names(names, members, aliases)


VARIED = """CASE match_id % 5 WHEN 0 THEN split_part(home_team, '-', 2) || ' ' || league WHEN 1 THEN substring(league, 1, 4) || ' ' || split_part(home_team, '-', 2)
 WHEN 2 THEN 'FC ' || home_team WHEN 3 THEN home_team || ' ' || league ELSE league END"""


def word_sql(name, frame):
    words = f"unnest(regexp_split_to_array({name}, '[^\\p{{L}}\\p{{N}}]+')) AS word"
    return f"SELECT DISTINCT * FROM (SELECT league, season, {name}, {words} FROM {frame}) WHERE word <> ''"


@query(
    "x04_weighted_names",
    f"""WITH nm AS (SELECT DISTINCT league, season, upper({VARIED}) AS name FROM contests), m AS (SELECT DISTINCT league, season, upper(away_team) AS team FROM contests WHERE match_id % 7 <> 0),
sz AS (SELECT league, season, count(*) AS n FROM m GROUP BY 1, 2), mw AS ({word_sql('team', 'm')}), nw AS ({word_sql('name', 'nm')}),
df AS (SELECT league, season, word, count(*) AS having_it FROM mw GROUP BY 1, 2, 3),
tw AS (SELECT mw.*, ln(1 + n / having_it) AS w FROM mw JOIN sz USING (league, season) JOIN df USING (league, season, word)),
qw AS (SELECT nw.*, ln(1 + n / coalesce(having_it, 1)) AS w FROM nw JOIN sz USING (league, season) LEFT JOIN df USING (league, season, word)),
p AS (SELECT t.league, t.season, name, team, q.word AS q, q.w AS qw, t.word AS t, t.w AS tw,
  CASE WHEN q.word = t.word THEN 1.0e0 WHEN least(length(q.word), length(t.word)) >= 3 AND (starts_with(q.word, t.word) OR starts_with(t.word, q.word)) THEN 0.9e0 ELSE 0.0e0 END AS alike
  FROM qw q JOIN tw t ON q.league = t.league AND q.season = t.season),
a AS (SELECT league, season, name, team, sum(w * best) AS met, sum(w) AS whole FROM (SELECT league, season, name, team, t, any_value(tw) AS w, max(alike) AS best FROM p GROUP BY ALL) GROUP BY ALL),
b AS (SELECT league, season, name, team, sum(CASE WHEN best = 0 THEN w ELSE 0 END) AS strange FROM (SELECT league, season, name, team, q, any_value(qw) AS w, max(alike) AS best FROM p GROUP BY ALL) GROUP BY ALL)
SELECT league, season, name, team, round(100 * met / (whole + strange), 6) AS score FROM a JOIN b USING (league, season, name, team) WHERE round(100 * met / (whole + strange), 9) >= 85""",
)
def _(t):
    names = t.contests.select("league", "season", F.upper(F.expr(VARIED)).alias("name"))
    members = t.contests.filter("match_id % 7 <> 0").select("league", "season", F.upper("away_team").alias("team"))
    return rounded(weighted_candidates(names, members, ["league", "season"]), "score")


# ---- labels and settlement ------------------------------------------------------------------------------

TC = [(f"{s}_corners_{d}_{str(x).replace('.', '_')}", f"{s}_corners {'<' if d == 'under' else '>'} {x}") for s in ("home", "away") for x in (2.5, 3.5, 4.5, 5.5, 6.5) for d in ("under", "over")]
PREDICATES = {
    "home_win": "home_goals > away_goals",
    "draw": "home_goals = away_goals",
    "away_win": "away_goals > home_goals",
    "goals_over_2_5": "home_goals + away_goals > 2.5",
    "goals_under_2_5": "home_goals + away_goals <= 2.5",
    "home_goals_under_1_5": "home_goals < 1.5",
    "away_goals_under_1_5": "away_goals < 1.5",
    "btts_yes": "home_goals > 0 AND away_goals > 0",
    "btts_no": "NOT (home_goals > 0 AND away_goals > 0)",
    "corners_under_11_5": "home_corners + away_corners <= 11.5",
    "corners_over_9_5": "home_corners + away_corners > 9.5",
    "corners_over_7_5": "home_corners + away_corners > 7.5",
    "corners_home_win": "home_corners > away_corners",
    "corners_draw": "home_corners = away_corners",
    "corners_away_win": "away_corners > home_corners",
    "home_cards_over_1_5": "home_cards > 1.5",
    "away_cards_over_1_5": "away_cards > 1.5",
    "cards_under_4_5": "home_cards + away_cards < 4.5",
    "cards_under_5_5": "home_cards + away_cards <= 5.5",
    "cards_over_2_5": "home_cards + away_cards > 2.5",
    "cards_over_3_5": "home_cards + away_cards > 3.5",
    "home_dc": "home_goals >= away_goals",
    "away_dc": "away_goals >= home_goals",
    **dict(TC),
}


def label_sql(names=None):
    return ", ".join(f"CAST({PREDICATES[n]} AS DOUBLE) AS {n}" for n in (names or PREDICATES))


@query("l01_label_matrix", f"SELECT match_id, {label_sql()} FROM contests")
def _(t):
    return lab.label_matrix(t.contests, MARKETS).select("match_id", *MARKETS.markets)


@query(
    "l02_label_incremental",
    f"SELECT match_id, {label_sql(['home_win', 'draw', 'away_win', 'btts_yes', 'corners_over_7_5'])} FROM contests",
)
def _(t):
    names = ["home_win", "draw", "away_win", "btts_yes", "corners_over_7_5"]
    few = lab.MarketRegistry({n: MARKETS.markets[n] for n in names})
    old = lab.label_matrix(t.contests.filter("match_id % 2 = 0"), few, names[:3]).select("match_id", *names[:3])
    return lab.label_incremental(t.contests, old, few)


@query(
    "l03_double_chance_targets",
    """SELECT match_id, CAST(home_goals >= away_goals AS DOUBLE) AS target_1x, CAST(away_goals >= home_goals AS DOUBLE) AS target_x2, CAST(home_goals <> away_goals AS DOUBLE) AS target_12
FROM (SELECT match_id, CASE WHEN status = 'FT' THEN home_goals END AS home_goals, away_goals FROM contests)""",
)
def _(t):
    played = t.contests.withColumn("home_goals", F.when(F.col("status") == "FT", F.col("home_goals")))
    names = ["target_1x", "target_x2", "target_12"]
    return lab.double_chance_targets(played).select("match_id", *[F.col(n).cast("double") for n in names])


@query(
    "l04_training_targets",
    """SELECT match_id, least(home_shots % 9, 6) AS home_goals_capped, least(away_goals, 6) AS away_goals_capped,
 CAST(home_shots % 9 > 6 AS INT) + CAST(away_goals > 6 AS INT) AS capped,
 CASE WHEN home_shots % 9 < away_goals THEN 0 WHEN home_shots % 9 = away_goals THEN 1 ELSE 2 END AS outcome_code, CAST(year(match_date) AS INT) AS season_year FROM contests""",
)
def _(t):
    rows = t.contests.withColumns({"home_goals": F.col("home_shots") % 9, "season": F.concat(F.year("match_date").cast("string"), F.lit("-25"))})
    out = lab.training_targets(rows)
    return out.select("match_id", "home_goals_capped", "away_goals_capped", "capped", "outcome_code", "season_year")


RESOLVE = """p AS (SELECT bet_id, match_id, market_key, CASE WHEN bet_id % 29 = 0 THEN NULL WHEN bet_id % 31 = 0 THEN 1.5 ELSE probability END AS p,
  CASE WHEN bet_id % 41 = 0 THEN NULL ELSE match_id END AS k, CASE WHEN bet_id % 5 = 0 THEN ts + INTERVAL 40 YEAR ELSE ts END AS kickoff FROM ledger),
v AS (SELECT *, coalesce(p BETWEEN 0 AND 1, FALSE) AS ok FROM p),
d AS (SELECT *, CASE WHEN ok AND k IS NOT NULL THEN row_number() OVER (PARTITION BY ok AND k IS NOT NULL, k, market_key ORDER BY bet_id) END AS rn FROM v),
x AS (SELECT d.*, c.match_id AS found, c.match_date, CASE market_key WHEN 'home_win' THEN home_goals > away_goals WHEN 'draw' THEN home_goals = away_goals
  WHEN 'away_win' THEN away_goals > home_goals WHEN 'over_2_5' THEN home_goals + away_goals > 2.5 WHEN 'btts_yes' THEN home_goals > 0 AND away_goals > 0
  WHEN 'corn_o75' THEN home_corners + away_corners > 7.5 END AS lab FROM d LEFT JOIN contests c ON d.k = c.match_id AND c.match_id % 2 = 0),
s AS (SELECT bet_id, CASE WHEN NOT ok THEN 'INVALID_PROBABILITY' WHEN k IS NULL THEN 'INVALID_KEY' WHEN rn > 1 THEN 'DUPLICATE' WHEN found IS NULL THEN 'UNMATCHED'
  WHEN match_date < kickoff THEN 'TIME_TRAVEL' WHEN lab IS NULL THEN 'VOID' WHEN lab THEN 'WON' ELSE 'LOST' END AS state FROM x)"""


def resolved(t):
    p = F.when(F.col("bet_id") % 29 == 0, F.lit(None)).when(F.col("bet_id") % 31 == 0, 1.5).otherwise(F.col("probability"))
    late = F.expr("CASE WHEN bet_id % 5 = 0 THEN ts + INTERVAL 40 YEAR ELSE ts END")
    preds = t.ledger.select(
        "bet_id",
        F.when(F.col("bet_id") % 41 != 0, F.col("match_id")).alias("match_hash"),
        F.col("market_key").alias("market"),
        p.alias("probability"),
        late.alias("kickoff"),
    )
    results = t.contests.filter("match_id % 2 = 0").withColumnRenamed("match_id", "match_hash")
    return lab.resolve(preds, results, MARKETS, order=["bet_id"])


@query("l05_resolve", f"WITH {RESOLVE} SELECT bet_id, state FROM s")
def _(t):
    return resolved(t).select("bet_id", "state")


NATURAL = "substring(md5(league || strftime(match_date, '%Y%m%d') || upper(home_team) || upper(away_team)), 1, 16)"


@query(
    "l05_resolve_repaired",
    f"""WITH c AS (SELECT *, {NATURAL} AS hash FROM contests),
p AS (SELECT l.bet_id, l.market_key, l.probability, CASE WHEN l.bet_id % 11 = 0 THEN NULL ELSE c.hash END AS k, l.bet_id % 3 = 0 AS late, c.match_date AS d
 FROM ledger l JOIN c ON l.match_id = c.match_id),
f AS (SELECT hash, min(match_date) AS t, arg_min(home_goals > away_goals, (match_date, away_goals, home_goals)) AS home, arg_min(home_goals = away_goals, (match_date, away_goals, home_goals)) AS draw FROM c GROUP BY 1),
n AS (SELECT *, row_number() OVER (PARTITION BY k IS NULL, k, market_key ORDER BY bet_id) AS rn FROM p WHERE market_key IN ('home_win', 'draw'))
SELECT bet_id, CASE WHEN k IS NULL THEN 'INVALID_KEY' WHEN rn > 1 THEN 'DUPLICATE' WHEN late AND t < d + INTERVAL 1 DAY THEN 'TIME_TRAVEL'
 WHEN CASE market_key WHEN 'home_win' THEN home ELSE draw END THEN 'WON' ELSE 'LOST' END AS state FROM n LEFT JOIN f ON n.k = f.hash""",
)
def _(t):
    """Keys that are malformed or missing are rebuilt; results come twice; without a league no key can be built."""
    hashed = v.repair_key(t.contests.withColumn("match_hash", F.lit("")), date="match_date")
    bets = t.ledger.select("bet_id", "match_id", F.col("market_key").alias("market"), "probability").filter("market in ('home_win', 'draw')")
    bets = bets.join(hashed.select("match_id", "match_hash", "league", "match_date", "home_team", "away_team"), "match_id")
    broken = F.when(F.col("bet_id") % 4 == 0, "XYZ").when(F.col("bet_id") % 4 == 1, F.lit(None)).otherwise(F.col("match_hash"))
    preds = bets.withColumns(
        {
            "match_hash": F.when(F.col("bet_id") % 11 == 0, "bad").otherwise(broken),
            "league": F.when(F.col("bet_id") % 11 > 0, F.col("league")),
            "kickoff": F.when(F.col("bet_id") % 3 == 0, F.col("match_date") + F.expr("INTERVAL 1 DAY")).otherwise(F.expr("timestamp'1990-01-01'")),
        }
    )
    results = hashed.select("match_hash", "match_date", *lab.GOALS, *lab.CORNERS, *lab.CARDS)
    return lab.resolve(preds, results.union(results), MARKETS, order=["bet_id"], natural_date="match_date").select("bet_id", "state")


@query("g25_resolution_stats", f"WITH {RESOLVE} SELECT state, count(*) AS n FROM s GROUP BY state")
def _(t):
    return resolved(t).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


ALIASED = """CASE market_key WHEN 'home_win' THEN home_goals > away_goals WHEN 'draw' THEN home_goals = away_goals
  WHEN 'away_win' THEN away_goals > home_goals WHEN 'over_2_5' THEN home_goals + away_goals > 2.5 WHEN 'btts_yes' THEN home_goals > 0 AND away_goals > 0
  WHEN 'corn_o75' THEN home_corners + away_corners > 7.5 END"""


@query(
    "l06_backfill_void",
    f"""WITH x AS (SELECT l.bet_id, l.outcome, {ALIASED} AS lab FROM ledger l LEFT JOIN contests c ON l.match_id = c.match_id)
SELECT bet_id, CASE WHEN outcome <> 'VOID' THEN outcome WHEN lab IS NULL THEN 'VOID' WHEN lab THEN 'WON' ELSE 'LOST' END AS outcome FROM x""",
)
def _(t):
    rows = t.ledger.select("bet_id", "match_id", F.col("market_key").alias("market"), "outcome")
    return lab.backfill_void(rows, t.contests, MARKETS).select("bet_id", "outcome")


@query(
    "l07_evaluate",
    """WITH x AS (SELECT l.bet_id, probability, CASE market_key WHEN 'home_win' THEN home_goals > away_goals WHEN 'draw' THEN home_goals = away_goals
  WHEN 'away_win' THEN away_goals > home_goals WHEN 'btts_yes' THEN home_goals > 0 AND away_goals > 0 END AS y FROM ledger l JOIN contests c ON l.match_id = c.match_id
  WHERE market_key IN ('home_win', 'draw', 'away_win', 'btts_yes'))
SELECT bet_id, CAST(y AS DOUBLE) AS actual, round(probability - CAST(y AS DOUBLE), 6) AS error, round(abs(probability - CAST(y AS DOUBLE)), 6) AS abs_error FROM x""",
)
def _(t):
    rows = t.ledger.select("bet_id", "match_id", F.col("market_key").alias("market"), "probability")
    out = lab.evaluate(rows, t.contests, MARKETS).select("bet_id", "actual", "error", "abs_error")
    return rounded(out, "error", "abs_error")


SLIP_MARKETS = ["HOME_TG_U1.5", "AWAY_TG_U1.5", "CORNERS_U11.5", "CORNERS_O9.5", "CARDS_U5.5", "BTTS_YES", "GOALS_O2.5", "GOALS_U2.5", "OTHER"]


@query(
    "l08_settle_slips",
    """WITH x AS (SELECT l.bet_id // 4 AS slip_id, CASE WHEN c.status IS NULL OR c.status NOT IN ('FINISHED', 'FT') THEN 'PENDING' ELSE CASE (l.bet_id // 3) % 9
  WHEN 0 THEN CASE WHEN home_goals <= 1 THEN 'WIN' ELSE 'LOSS' END WHEN 1 THEN CASE WHEN away_goals <= 1 THEN 'WIN' ELSE 'LOSS' END
  WHEN 2 THEN CASE WHEN coalesce(home_corners, 0) + coalesce(away_corners, 0) <= 11 THEN 'WIN' ELSE 'LOSS' END
  WHEN 3 THEN CASE WHEN coalesce(home_corners, 0) + coalesce(away_corners, 0) >= 10 THEN 'WIN' ELSE 'LOSS' END
  WHEN 4 THEN CASE WHEN home_cards + away_cards <= 5 THEN 'WIN' ELSE 'LOSS' END WHEN 5 THEN CASE WHEN home_goals > 0 AND away_goals > 0 THEN 'WIN' ELSE 'LOSS' END
  WHEN 6 THEN CASE WHEN home_goals + away_goals >= 3 THEN 'WIN' ELSE 'LOSS' END WHEN 7 THEN CASE WHEN home_goals + away_goals <= 2 THEN 'WIN' ELSE 'LOSS' END ELSE 'PENDING' END END AS leg
 FROM ledger l LEFT JOIN contests c ON l.match_id = c.match_id)
SELECT slip_id, count(*) AS legs, count(*) FILTER (leg = 'WIN') AS legs_won,
 CASE WHEN bool_and(leg = 'WIN') THEN 'WIN' WHEN bool_or(leg = 'LOSS') THEN 'LOSS' ELSE 'PENDING' END AS result FROM x GROUP BY 1""",
)
def _(t):
    names = F.array(*[F.lit(m) for m in SLIP_MARKETS])
    market = F.get(names, (F.floor(F.col("bet_id") / 3) % 9).cast("int"))
    legs = t.ledger.select(F.floor(F.col("bet_id") / 4).alias("slip_id"), "match_id", market.alias("market"))
    return lab.settle_slips(legs, t.contests, ["match_id"])


@query(
    "l09_parse_market",
    """SELECT bet_id, CASE bet_id % 6 WHEN 0 THEN 'corners' WHEN 1 THEN 'corners' WHEN 2 THEN 'cards' WHEN 3 THEN 'goals' WHEN 4 THEN 'result' ELSE 'btts' END AS kind,
 CASE bet_id % 6 WHEN 0 THEN 'home' WHEN 1 THEN 'total' WHEN 2 THEN 'total' WHEN 3 THEN 'away' WHEN 4 THEN 'home' ELSE 'total' END AS side,
 CASE bet_id % 6 WHEN 0 THEN 'over' WHEN 1 THEN 'under' WHEN 2 THEN 'over' WHEN 3 THEN 'under' ELSE '-' END AS direction,
 CASE bet_id % 6 WHEN 0 THEN 4.5e0 WHEN 1 THEN 11.5e0 WHEN 2 THEN 2.5e0 WHEN 3 THEN 1.5e0 END AS line FROM ledger""",
)
def _(t):
    names = F.array(*[F.lit(m) for m in ("corn_home_o45", "corn_u11", "cards_over_2_5", "away_under_1_5", "home_win", "btts_yes")])
    m = F.get(names, (F.col("bet_id") % 6).cast("int"))
    out = t.ledger.select("bet_id", F.inline(F.array(lab.parse_market(m))))
    return out.withColumn("direction", F.coalesce("direction", F.lit("-")))


@query(
    "u01_custom_market",
    "SELECT match_id, CAST(home_goals + away_goals > 4 AS DOUBLE) AS goals_over_4 FROM contests",
)
def _(t):
    own = MARKETS.with_market("goals_over_4", lambda: F.col("home_goals") + F.col("away_goals") > 4, ("home_goals", "away_goals"))
    return lab.label_matrix(t.contests, own, ["goals_over_4"]).select("match_id", "goals_over_4")


@query(
    "u06_outcome_functions",
    """SELECT l.bet_id, CAST(CASE WHEN market_key = 'draw' THEN home_goals = away_goals ELSE home_corners > 6 END AS DOUBLE) AS hit FROM ledger l JOIN contests c ON l.match_id = c.match_id
 WHERE market_key IN ('draw', 'corn_o75') AND (market_key = 'draw' OR home_corners IS NOT NULL)""",
)
def _(t):
    own = lab.MarketRegistry(
        {
            "draw": MARKETS.markets["draw"],
            "corn_o75": (lambda: F.col("home_corners") > 6, ("home_corners",)),
        }
    )
    rows = t.ledger.select("bet_id", "match_id", F.col("market_key").alias("market"), "probability")
    return lab.evaluate(rows, t.contests, own).select("bet_id", F.col("actual").alias("hit"))
