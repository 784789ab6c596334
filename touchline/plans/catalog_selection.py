"""Queries over selection, stakes, combinations and drift."""

import datetime as dt

from pyspark.sql import functions as F

from ..operators import drift as d
from ..operators import metrics as g
from ..operators import pricing as pr
from ..operators import selection as k
from ..operators import standings as st
from .catalog_metrics import BIN, S, ece_sql
from .catalog_pricing import GOAL_VIEW
from .registry import micros, query, r6, rounded

EDGE = """e AS (SELECT *, CASE WHEN o IS NOT NULL AND o > 1 AND p BETWEEN 0 AND 1 THEN p - 1 / o END AS edge, CASE WHEN o IS NOT NULL AND o > 1 AND p BETWEEN 0 AND 1 THEN p * o - 1 END AS ev,
 CASE WHEN p IS NULL OR NOT (p BETWEEN 0 AND 1) THEN 'INVALID_PROBABILITY' WHEN o IS NULL THEN 'MISSING_ODDS' WHEN o <= 1 THEN 'INVALID_ODDS' WHEN p - 1 / o < 0 THEN 'EDGE_TOO_LOW' WHEN p * o - 1 < 0.02 THEN 'EV_TOO_LOW' ELSE 'VALUE_OK' END AS value_reason
 FROM (SELECT bet_id, market, ts, CASE WHEN bet_id % 53 = 0 THEN 1.4 ELSE probability END AS p, CASE WHEN bet_id % 47 = 0 THEN NULL ELSE odds END AS o FROM ledger))"""


def priced(t):
    p = F.when(F.col("bet_id") % 53 == 0, 1.4).otherwise(F.col("probability"))
    rows = t.ledger.withColumns({"probability": p, "odds": F.when(F.col("bet_id") % 47 != 0, F.col("odds"))})
    return k.edge(rows)


@query("k01_edge", f"WITH {EDGE} SELECT bet_id, round(edge, 9) AS edge, round(ev, 6) AS ev, value_reason FROM e")
def _(t):
    return rounded(priced(t).select("bet_id", F.round("edge", 9).alias("edge"), "ev", "value_reason"), "ev")


@query(
    "k02_value_rank",
    f"""WITH {EDGE} SELECT bet_id, row_number() OVER (PARTITION BY market ORDER BY CASE WHEN value_reason = 'VALUE_OK' THEN 0 ELSE 1 END, coalesce(-edge, 'inf'::DOUBLE), coalesce(-ev, 'inf'::DOUBLE), -p, bet_id) AS value_rank FROM e""",
)
def _(t):
    return k.value_rank(priced(t), ["market"], "bet_id", conf="probability").select("bet_id", "value_rank")


GATE = """q AS (SELECT bet_id, match_id, league, market_key AS market, ts, CASE WHEN bet_id % 59 = 0 THEN NULL ELSE probability END AS p FROM ledger),
b AS (SELECT *, CASE WHEN market LIKE '%corn%' THEN 0.85 WHEN market IN ('home_win', 'draw', 'away_win') THEN 0.73 WHEN market LIKE '%over%' OR market LIKE '%btts%' THEN 0.74 ELSE 0.75 END AS fl,
  p - CASE market WHEN 'home_win' THEN 0.38 WHEN 'away_win' THEN 0.30 WHEN 'draw' THEN 0.28 WHEN 'over_2_5' THEN 0.50 WHEN 'btts_yes' THEN 0.52 ELSE 0.50 END AS e FROM q),
s AS (SELECT *, CASE WHEN p IS NULL THEN 'GATE_1_MODEL_ELIGIBILITY' WHEN p < fl THEN 'GATE_2_PROB_FLOOR' WHEN e < 0.08 THEN 'GATE_3_LOW_EDGE' WHEN league = 'BUILDING' THEN 'GATE_4_DRIFT_BLOCKED' END AS st, p * (1 + e) AS score FROM b),
m AS (SELECT *, row_number() OVER (PARTITION BY ts, match_id ORDER BY score DESC, bet_id) AS rm FROM s WHERE st IS NULL),
t5 AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, bet_id) AS rt FROM m WHERE rm = 1),
f AS (SELECT s.bet_id, s.ts, coalesce(s.st, CASE WHEN m.rm > 1 THEN 'GATE_5_CORRELATION_BLOCK' WHEN t5.rt > 5 THEN 'GATE_6_DAILY_LIMIT' ELSE 'PASSED' END) AS stage, CASE WHEN s.st IS NULL THEN s.score END AS score
  FROM s LEFT JOIN m ON s.bet_id = m.bet_id LEFT JOIN t5 ON s.bet_id = t5.bet_id)"""


def gated(t):
    p = F.when(F.col("bet_id") % 59 != 0, F.col("probability"))
    preds = t.ledger.select("bet_id", "match_id", "league", F.col("market_key").alias("market"), "ts", p.alias("probability"))
    status = t.ledger.select("league").distinct().withColumn("status", F.when(F.col("league") == "BUILDING", "STOP").otherwise("GO"))
    return k.selection_gate(preds, status, "ts")


@query("k03_selection_gate", f"WITH {GATE} SELECT bet_id, stage, round(score, 6) AS gate_score FROM f")
def _(t):
    return rounded(gated(t).select("bet_id", "stage", "gate_score"), "gate_score")


@query("k03_gate_counts", f"WITH {GATE} SELECT epoch_us(ts) AS ts_us, stage, count(*) AS n FROM f GROUP BY 1, 2")
def _(t):
    return k.gate_counts(gated(t), "ts").select(micros("ts").alias("ts_us"), "stage", "n")


def wide_prices(t):
    goals = pr.price_goals(t.rates)
    cards = pr.price_cards_zip(goals)
    u = (F.col("match_id") * 7919 % 1001) / 1000
    return cards.select(
        "match_id",
        F.when(F.col("match_id") % 4 == 0, "BL1").when(F.col("match_id") % 4 == 1, "PD").otherwise("PL").alias("league"),
        *[c for c in goals.columns if c in ("home_win", "draw", "away_win", "over_1_5", "over_2_5", "under_2_5", "btts_yes", "btts_no", "home_under_1_5", "away_under_1_5")],
        F.col("under_3_5").alias("goals_under_3_5"),
        F.col("cards_under_4_5").alias("card_u45"),
        F.col("cards_under_5_5").alias("card_u55"),
        "cards_over_2_5",
        F.least(F.col("home_win") + F.col("draw"), F.lit(1.0)).alias("dc_1x"),
        F.least(F.col("away_win") + F.col("draw"), F.lit(1.0)).alias("dc_x2"),
        (0.4 + u / 2).alias("corners_over_7_5"),
        F.when(F.col("match_id") % 5 > 0, 0.5 + u / 2).alias("corn_u11"),
        F.when(F.col("match_id") % 3 > 0, u).alias("corners_home_win"),
        F.when(F.col("match_id") % 3 > 0, 1 - u).alias("corners_away_win"),
        *[
            F.when(F.col("match_id") % 6 > 0, F.get(F.array(*[F.lit(b) for b in bands]), ((F.col("match_id") * m) % len(bands)).cast("int"))).alias(n)
            for n, m, bands in (
                ("home_status_band", 1, ("TOP", "MID", "LOW")),
                ("away_status_band", 5, ("MID", "LOW", "TOP")),
                ("home_momentum_band", 7, ("STRONG_NEGATIVE", "STABLE", "STRONG_POSITIVE", "NEUTRAL", "MILD_NEGATIVE")),
                ("away_momentum_band", 3, ("STRONG_POSITIVE", "STABLE", "STRONG_NEGATIVE", "MILD_POSITIVE", "STABLE")),
            )
        ],
    )


def _band(name, m, bands):
    return "CASE WHEN x.match_id % 6 > 0 THEN " + "[" + ", ".join(f"'{b}'" for b in bands) + f"][CAST((x.match_id * {m}) % {len(bands)} AS INT) + 1] END AS {name}"


GATES_SQL = "CASE type " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in k.HARD_GATES.items()) + " END"
CANDIDATES = f"""{GOAL_VIEW}, zk AS (SELECT match_id, k, 0.97 * exp(-mu_cards) * pow(mu_cards, k) / factorial(CAST(k AS INT)) + CASE WHEN k = 0 THEN 0.03 ELSE 0 END AS p FROM rates, range(0, 16) r(k)),
zs AS (SELECT match_id, greatest(least(0.5 + 0.88 * (sum(CASE WHEN k <= 4 THEN p ELSE 0 END) - 0.5), 0.92), 0.05) AS card_u45, greatest(least(0.5 + 0.88 * (sum(CASE WHEN k <= 5 THEN p ELSE 0 END) - 0.5), 0.88), 0.05) AS card_u55,
  greatest(least(0.5 + 0.9 * (sum(CASE WHEN k >= 3 THEN p ELSE 0 END) - 0.5), 0.92), 0.05) AS cards_over_2_5 FROM zk GROUP BY 1),
w AS (SELECT x.*, card_u45, card_u55, cards_over_2_5, (x.match_id * 7919 % 1001) / 1000.0e0 AS u, CASE x.match_id % 4 WHEN 0 THEN 'BL1' WHEN 1 THEN 'PD' ELSE 'PL' END AS league,
  {_band('hs', 1, ('TOP', 'MID', 'LOW'))}, {_band('as_', 5, ('MID', 'LOW', 'TOP'))}, {_band('hm', 7, ('STRONG_NEGATIVE', 'STABLE', 'STRONG_POSITIVE', 'NEUTRAL', 'MILD_NEGATIVE'))},
  {_band('am', 3, ('STRONG_POSITIVE', 'STABLE', 'STRONG_NEGATIVE', 'MILD_POSITIVE', 'STABLE'))} FROM g x JOIN zs ON x.match_id = zs.match_id),
v AS (SELECT *, 0.4 + u / 2 AS o75, home_win > away_win AS hf, hs IS NOT NULL AS known FROM w),
y AS (SELECT *, known AND CASE WHEN hf THEN hs = 'TOP' AND hm = 'STRONG_NEGATIVE' ELSE as_ = 'TOP' AND am = 'STRONG_NEGATIVE' END AS trap, known AND (hs = 'LOW' AND hm = 'STRONG_POSITIVE' OR as_ = 'LOW' AND am = 'STRONG_POSITIVE') AS relief,
  known AND CASE WHEN hf THEN as_ = 'TOP' AND hs IN ('LOW', 'MID') ELSE hs = 'TOP' AND as_ IN ('LOW', 'MID') END AS upset, CASE league WHEN 'BL1' THEN least(over_1_5 + 0.05, 1) WHEN 'PD' THEN over_1_5 - 0.02 ELSE over_1_5 END AS o15,
  match_id % 3 > 0 AS corner, u > 1 - u AS ch FROM v),
n AS (SELECT *, CASE WHEN o15 >= 0.70 THEN 'STABLE' WHEN o15 <= 0.55 THEN 'LOW_EVENT' ELSE 'NORMAL' END AS pace, NOT trap AND corner AND u <> 0 AND ch <> hf AS dissonance FROM y WHERE o15 > 0.55 AND o75 > 0.45),
c AS (SELECT match_id, dissonance, relief, CASE WHEN o75 < 0.65 THEN pace WHEN pace = 'NORMAL' THEN 'HIGH_TEMPO' ELSE pace || '/HIGH_TEMPO' END AS tempo_status, unnest([
  CASE WHEN NOT trap THEN {{'type': '1X2', 'market_name': CASE WHEN hf THEN 'HOME_WIN' ELSE 'AWAY_WIN' END, 'conf': CASE WHEN hf THEN home_win ELSE away_win END}} END,
  CASE WHEN match_id % 5 > 0 THEN {{'type': 'CORNERS', 'market_name': 'CORNERS_U11.5', 'conf': 0.5 + u / 2}} END, {{'type': 'CORNERS_O75', 'market_name': 'CORNERS_O7.5', 'conf': o75}},
  {{'type': 'CARDS', 'market_name': 'CARDS_U4.5', 'conf': card_u45}}, {{'type': 'CARDS_O25', 'market_name': 'CARDS_O2.5', 'conf': cards_over_2_5}}, {{'type': 'CARDS_U55', 'market_name': 'CARDS_U5.5', 'conf': card_u55}},
  CASE WHEN CASE WHEN hf THEN away_win ELSE home_win END < 0.35 AND CASE WHEN hf THEN away_under_1_5 ELSE home_under_1_5 END > 0.6 AND NOT upset THEN {{'type': 'UND_U15', 'market_name': CASE WHEN hf THEN 'AWAY_TG_U1.5' ELSE 'HOME_TG_U1.5' END, 'conf': CASE WHEN hf THEN away_under_1_5 ELSE home_under_1_5 END}} END,
  {{'type': 'GOALS_O15', 'market_name': 'GOALS_O1.5', 'conf': over_1_5}}, {{'type': 'GOALS_O25', 'market_name': 'GOALS_O2.5', 'conf': over_2_5}}, {{'type': 'GOALS_U25', 'market_name': 'GOALS_U2.5', 'conf': under_2_5}}, {{'type': 'GOALS_U35', 'market_name': 'GOALS_U3.5', 'conf': under_3_5}},
  CASE WHEN corner AND u <> 0 THEN {{'type': '1X2_CORNERS', 'market_name': CASE WHEN ch THEN 'HOME_CORNERS_WIN' ELSE 'AWAY_CORNERS_WIN' END, 'conf': greatest(u, 1 - u)}} END,
  CASE WHEN draw > 0.26 OR known AND (hm IN ('NEUTRAL', 'NEGATIVE') OR am = 'STRONG_POSITIVE') THEN {{'type': 'DOUBLE_CHANCE', 'market_name': 'HOME_DC', 'conf': least(home_win + draw, 1)}} END,
  CASE WHEN draw > 0.26 OR known AND (am IN ('NEUTRAL', 'NEGATIVE') OR hm = 'STRONG_POSITIVE') THEN {{'type': 'DOUBLE_CHANCE', 'market_name': 'AWAY_DC', 'conf': least(away_win + draw, 1)}} END,
  {{'type': 'BTTS', 'market_name': 'BTTS_YES', 'conf': btts_yes}}, {{'type': 'BTTS', 'market_name': 'BTTS_NO', 'conf': btts_no}}]) AS m FROM n),
z AS (SELECT match_id, dissonance, relief, tempo_status, m.type AS type, m.market_name AS market_name, m.conf AS conf FROM c WHERE m IS NOT NULL),
r AS (SELECT *, CASE WHEN relief AND type IN ('CORNERS', 'CARDS', 'CARDS_O25', 'BTTS', 'GOALS_O15', 'GOALS_O25', 'GOALS_U25') THEN greatest({GATES_SQL} - 0.06, 0.60) ELSE {GATES_SQL} END AS gate FROM z)"""


@query(
    "k04_candidates",
    f"""WITH {CANDIDATES} SELECT match_id, type, market_name, round(conf, 6) AS conf, dissonance, tempo_status,
 CAST(CASE WHEN type IN ('1X2', '1X2_CORNERS', 'CARDS_O25', 'GOALS_O15', 'GOALS_O25') AND conf >= 0.75 AND NOT dissonance THEN 1 WHEN conf >= 0.70 THEN 2 ELSE 3 END AS INT) AS tier FROM r WHERE conf >= gate""",
)
def _(t):
    out = k.candidates(wide_prices(t))
    return rounded(out.select("match_id", "type", "market_name", "conf", "dissonance", "tempo_status", "tier"), "conf")


KELLY = """CASE WHEN odds BETWEEN 1.30 AND 6.00 AND probability * odds - 1 >= CASE tier WHEN 'TIER_A' THEN 0.05 WHEN 'TIER_B' THEN 0.08 ELSE 0.12 END THEN
 round(1000 * greatest(least((probability * odds - 1) / (odds - 1), 0.015), 0) * CASE tier WHEN 'TIER_A' THEN 1.0 WHEN 'TIER_B' THEN 0.6 WHEN 'TIER_C' THEN 0.4 ELSE 0 END, 2) ELSE 0 END"""


@query("k05_kelly", f"SELECT bet_id, round({KELLY}, 2) AS kelly_stake FROM ledger")
def _(t):
    return k.kelly(t.ledger).select("bet_id", "kelly_stake")


@query(
    "k06_exposure_cap",
    f"""WITH q AS (SELECT bet_id, strftime(ts, '%Y-%m') AS month, market, CAST({KELLY} AS DOUBLE) AS s FROM ledger), c AS (SELECT *, coalesce(sum(s) OVER (PARTITION BY month, market ORDER BY bet_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM q)
SELECT bet_id, round(least(70.0, b + s) - least(70.0, b), 6) AS capped_stake FROM c""",
)
def _(t):
    # the test bets are spread thin, so a month stands in for the day
    rows = k.kelly(t.ledger).withColumn("month", F.date_format("ts", "yyyy-MM"))
    out = k.exposure_cap(rows, ["month", "market"], ["bet_id"], bucket=F.floor(F.col("bet_id") / 1000))
    return rounded(out.select("bet_id", "capped_stake"), "capped_stake")


NAMES8 = ["HOME_TG_U1.5", "CORNERS_U11.5", "CORNERS_O7.5", "CARDS_O2.5", "CARDS_U5.5", "CARDS_U4.5", "BTTS_NO", "HOME_WIN"]
W8 = [1.00, 0.95, 0.90, 0.80, 0.85, 0.85, 0.85, 0.85]
V8 = [0.12, 0.15, 0.22, 0.25, 0.18, 0.20, 0.20, 0.20]
M8 = [0.90, 1.15, 1.10, 1.00, 1.05, 1.05, 1.10, 1.00]


def _arr(xs):
    return "[" + ", ".join(f"{x}e0" for x in xs) + "]"


LEGS = f"""lg AS (SELECT match_id AS leg_id, match_id // 2 AS match_id, league, match_date, epoch_us(match_date) // 14400000000 AS slate, (match_id * 7919 % 1001) / 1000.0e0 AS p,
  {_arr(W8)}[CAST(match_id % 8 AS INT) + 1] AS w, {_arr(V8)}[CAST(match_id % 8 AS INT) + 1] AS v, {_arr(M8)}[CAST(match_id % 8 AS INT) + 1] AS mw, match_id % 8 AS kind FROM contests),
ls AS (SELECT *, greatest(1e-10, p * w * (1 - (0.5 * (1 - p) + 0.5 * v))) AS s FROM lg)"""


def legs(t):
    names = F.array(*[F.lit(n) for n in NAMES8])
    p = (F.col("match_id") * 7919 % 1001) / 1000
    return t.contests.select(
        F.col("match_id").alias("leg_id"),
        F.floor(F.col("match_id") / 2).alias("match_id"),
        "league",
        "match_date",
        F.floor(F.unix_micros("match_date") / 14_400_000_000).alias("slate"),
        p.alias("probability"),
        p.alias("confidence"),
        F.get(names, (F.col("match_id") % 8).cast("int")).alias("market_name"),
    )


@query(
    "k07_combo_score",
    f"""WITH {LEGS}, c AS (SELECT *, leg_id // 4 AS combo_id FROM ls), pc AS (SELECT a.combo_id, sum(exp(-0.3 * abs(epoch_us(a.match_date) - epoch_us(b.match_date)) / 3600000000)) AS corr FROM c a JOIN c b ON a.combo_id = b.combo_id AND a.leg_id < b.leg_id AND a.league = b.league GROUP BY 1),
g AS (SELECT combo_id, count(*) AS legs, exp(sum(ln(s))) AS st, product(1 - p) AS f FROM c GROUP BY 1), r AS (SELECT g.*, coalesce(corr, 0) AS corr, st * exp(-0.15 * coalesce(corr, 0)) * (1 - f) AS score FROM g LEFT JOIN pc ON g.combo_id = pc.combo_id)
SELECT combo_id, legs, round(st, 6) AS stability, round(corr, 6) AS correlation, round(score, 6) AS score, CASE WHEN score >= 0.45 THEN 'VERY LOW' WHEN score >= 0.3 THEN 'LOW' WHEN score >= 0.2 THEN 'MEDIUM' ELSE 'HIGH' END AS risk FROM r""",
)
def _(t):
    rows = legs(t).withColumn("combo_id", F.floor(F.col("leg_id") / 4))
    return rounded(k.combo_score(rows), "stability", "correlation", "score")


CORR = "CASE WHEN {a}.league = {b}.league THEN exp(-0.3 * abs(epoch_us({a}.match_date) - epoch_us({b}.match_date)) / 3600000000) ELSE 0 END"


def _combo(n):
    legs_ = [f"x{i}" for i in range(n)]
    pairs = [(legs_[i], legs_[j]) for i in range(n) for j in range(i + 1, n)]
    corr = " + ".join(CORR.format(a=a, b=b) for a, b in pairs)
    joins = " JOIN ".join(["pl x0"] + [f"pl {legs_[i]} ON {legs_[i]}.slate = x0.slate AND {legs_[i]}.leg_id > {legs_[i - 1]}.leg_id" + "".join(f" AND {legs_[i]}.match_id <> {legs_[q]}.match_id" for q in range(i)) for i in range(1, n)])
    return f"""SELECT x0.slate, {n} AS n, [{', '.join(x + '.leg_id' for x in legs_)}] AS ids, {' * '.join(x + '.a' for x in legs_)} AS prod, {' * '.join('(1 - ' + x + '.p)' for x in legs_)} AS f, {corr} AS corr FROM {joins}"""


@query(
    "k08_best_slip",
    f"""WITH {LEGS}, pl AS (SELECT *, s * mw AS a FROM ls WHERE p >= 0.65 AND kind <> 7), u AS ({_combo(2)} UNION ALL {_combo(3)} UNION ALL {_combo(4)}),
sc AS (SELECT *, prod * exp(-0.15 * corr) * (1 - f) AS score FROM u WHERE corr <= 1), b AS (SELECT *, row_number() OVER (PARTITION BY slate ORDER BY round(score, 12) DESC, n, ids) AS rn FROM sc WHERE score >= 0.18)
SELECT CAST(slate AS BIGINT) AS slate, array_to_string(ids, ',') AS legs, round(corr, 6) AS correlation, round(score, 6) AS score, CASE WHEN score >= 0.45 THEN 'VERY LOW' WHEN score >= 0.3 THEN 'LOW' WHEN score >= 0.2 THEN 'MEDIUM' ELSE 'HIGH' END AS risk FROM b WHERE rn = 1""",
)
def _(t):
    out = k.best_slip(legs(t), ["slate"])
    text = F.array_join(F.transform("leg_ids", lambda x: x.cast("string")), ",")
    return rounded(out.select("slate", text.alias("legs"), "correlation", "score", "risk"), "correlation", "score")


@query(
    "k09_refresh_weights",
    f"""WITH {S}, a AS (SELECT CASE market_key WHEN 'corn_o75' THEN 'CORNERS_O7.5' WHEN 'btts_yes' THEN NULL WHEN 'over_2_5' THEN 'CARDS_O2.5' WHEN 'unknown_mkt' THEN 'TG_U1.5' ELSE '1X2' END AS weight_key, market_key, count(*) AS n,
  avg(CAST((probability >= 0.5) = (hit >= 0.5) AS INT)) AS acc FROM s GROUP BY 1, 2 HAVING count(*) >= 200), p AS (SELECT weight_key, sum(acc * n) / sum(n) AS accuracy, CAST(sum(n) AS BIGINT) AS n FROM a WHERE weight_key IS NOT NULL GROUP BY 1)
SELECT weight_key, round(accuracy, 6) AS accuracy, n, round(1.0 - 0.25 * CASE WHEN count(*) OVER () > 1 THEN (row_number() OVER (ORDER BY accuracy DESC, weight_key) - 1) / (count(*) OVER () - 1) ELSE 0 END, 4) AS weight FROM p""",
)
def _(t):
    names = {"corn_o75": "corners_o7.5", "over_2_5": "Cards O2.5", "unknown_mkt": "home tg_u1.5", "home_win": "home_win", "draw": "DRAW", "away_win": "away win", "btts_yes": "btts_yes"}
    label = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    rows = g.accuracy(g.settled(t.ledger), ["market_key"]).withColumn("market", F.try_element_at(label, "market_key"))
    return rounded(k.refresh_weights(rows), "accuracy")


@query("k13_top_n", "SELECT bet_id, round(odds, 6) AS odds FROM ledger ORDER BY odds DESC, bet_id LIMIT 25")
def _(t):
    return rounded(k.top_n(t.ledger.select("bet_id", "odds"), [F.col("odds").desc(), F.col("bet_id")], 25), "odds")


@query("k14_canonical_sort", "SELECT league, season, match_id FROM contests ORDER BY league, season, match_date, match_id")
def _(t):
    return k.canonical_sort(t.contests, ["league", "season", "match_date", "match_id"]).select("league", "season", "match_id")


@query(
    "k16_summary",
    f"""WITH {GOAL_VIEW}, q AS (SELECT match_id, home_win AS h, draw AS d, away_win AS a, CASE WHEN match_id % 3 = 0 THEN NULL ELSE btts_yes END AS b, over_2_5 AS o, (match_id % 100) / 100 AS co, (match_id % 70) / 100 AS ca, match_id % 9 AS n0, least(5, match_id % 9) AS n FROM g),
r AS (SELECT *, greatest(h, d, a, coalesce(b, 0), o, co, ca) AS c, floor(h * n) AS fh, floor(d * n) AS fd, floor(a * n) AS fa FROM q),
l AS (SELECT *, greatest(n - fh - fd - fa, 0) AS rest, h * n - fh AS rh, d * n - fd AS rd, a * n - fa AS ra FROM r)
SELECT match_id, round(c, 6) AS confidence, CASE WHEN c >= 0.65 THEN 'HIGH' WHEN c >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_tier,
 CAST(fh + CASE WHEN n > 0 AND CAST(rd > rh AS INT) + CAST(ra > rh AS INT) < rest THEN 1 ELSE 0 END AS BIGINT) AS h2h_home,
 CAST(fd + CASE WHEN n > 0 AND CAST(rh >= rd AS INT) + CAST(ra > rd AS INT) < rest THEN 1 ELSE 0 END AS BIGINT) AS h2h_draws,
 CAST(fa + CASE WHEN n > 0 AND CAST(rh >= ra AS INT) + CAST(rd >= ra AS INT) < rest THEN 1 ELSE 0 END AS BIGINT) AS h2h_away FROM l""",
)
def _(t):
    wide = pr.price_goals(t.rates).select(
        "match_id",
        "home_win",
        "draw",
        "away_win",
        F.when(F.col("match_id") % 3 > 0, F.col("btts_yes")).alias("btts_yes"),
        "over_2_5",
        ((F.col("match_id") % 100) / 100).alias("corn_o75"),
        ((F.col("match_id") % 70) / 100).alias("card_u45"),
        (F.col("match_id") % 9).alias("h2h_match_count"),
    )
    out = k.summary(wide).select("match_id", "confidence", "confidence_tier", "h2h_home", "h2h_draws", "h2h_away")
    return rounded(out, "confidence")


VALUE = """q AS (SELECT bet_id, match_id, CASE bet_id % 4 WHEN 0 THEN 'goals_u25' WHEN 1 THEN 'goals_o25' WHEN 2 THEN 'btts_yes' ELSE 'btts_no' END AS market, probability AS p, CASE WHEN bet_id % 11 = 0 THEN NULL ELSE 0.05 + 0.9 * probability END AS cal,
  (bet_id * 31 % 100) / 100.0e0 AS conf, CASE WHEN bet_id % 13 = 0 THEN NULL ELSE odds END AS o, bet_id % 17 = 0 AS dull, bet_id % 5 = 0 AS stopped, market AS slate FROM ledger),
v AS (SELECT *, CASE WHEN dull THEN 'SHARPNESS_DISABLED' WHEN cal IS NULL THEN 'CALIBRATOR_DISABLED' WHEN conf < 0.6 THEN 'LOW_TIER' WHEN o IS NULL OR o <= 1 THEN 'ODDS_SANITY' WHEN cal - 1 / o < 0 OR cal * o - 1 < 0.02 THEN 'EV_FAIL' WHEN stopped THEN 'DRIFT_FREEZE' END AS reason FROM (SELECT * REPLACE (market AS market) FROM q))"""


@query(
    "k17_value_opportunities",
    f"""WITH {VALUE}, k AS (SELECT bet_id, row_number() OVER (PARTITION BY slate ORDER BY -(cal - 1 / o), -(cal * o - 1), -conf, bet_id) AS value_rank FROM v WHERE reason IS NULL)
SELECT v.bet_id, coalesce(reason, 'KEPT') AS reason, coalesce(value_rank, 0) AS value_rank FROM v LEFT JOIN k ON v.bet_id = k.bet_id""",
)
def _(t):
    kind = F.get(F.array(*[F.lit(m) for m in ("goals_u25", "goals_o25", "btts_yes", "btts_no")]), (F.col("bet_id") % 4).cast("int"))
    conf = (F.col("bet_id") * 31 % 100) / 100
    preds = t.ledger.select(
        "bet_id",
        F.col("market").alias("slate"),
        kind.alias("market"),
        F.col("probability").alias("p_raw"),
        F.when(F.col("bet_id") % 11 > 0, 0.05 + 0.9 * F.col("probability")).alias("calibrated"),
        conf.alias("confidence"),
        F.when(conf >= 0.6, "MANUAL_REVIEW").otherwise("NO_BET").alias("action_tier"),
        F.when(F.col("bet_id") % 13 > 0, F.col("odds")).alias("odds"),
        F.when(F.col("bet_id") % 17 == 0, "DISABLED").otherwise("ACTIVE").alias("sharpness"),
        F.when(F.col("bet_id") % 5 == 0, "STOP").otherwise("GO").alias("drift"),
    )
    kept, rejected = k.value_opportunities(preds, ["slate"], "bet_id")
    out = kept.select("bet_id", F.lit("KEPT").alias("reason"), "value_rank")
    return out.unionByName(rejected.select("bet_id", "reason", F.lit(0).cast("long").alias("value_rank")))


# ---- drift ----------------------------------------------------------------------------------------------

STATE = f"""{S}, bn AS (SELECT league, {BIN['c']} AS bin, count(*) AS n, sum(probability) AS p, sum(hit) AS y FROM s GROUP BY ALL), al AS (SELECT * FROM bn UNION ALL SELECT 'GLOBAL', bin, sum(n), sum(p), sum(y) FROM bn GROUP BY bin),
st AS (SELECT league, CAST(sum(n) AS BIGINT) AS n, sum(y) / sum(n) AS hit_rate, sum(abs(p - y)) / sum(n) AS ece, sum(p) / sum(n) AS mean_conf FROM al GROUP BY 1)"""
BASE_LINES = {"hit_rate": 0.48, "ece": 0.1, "mean_conf": 0.43}


@query(
    "d01_drift_state",
    f"""WITH {STATE} SELECT league, n, round(hit_rate, 6) AS hit_rate, round(ece, 6) AS ece, round(mean_conf, 6) AS mean_conf, CASE WHEN hit_rate < 0.48 - 0.05 OR ece > 0.1 + 0.03 OR mean_conf > 0.43 + 0.05 THEN 'STOP' ELSE 'GO' END AS status,
 concat_ws('; ', CASE WHEN hit_rate < 0.43 THEN 'HIT_RATE_DRIFT: ' || printf('%.2f', hit_rate) || ' (Baseline 0.48)' END, CASE WHEN ece > 0.13 THEN 'CALIBRATION_DRIFT: ' || printf('%.3f', ece) || ' (Baseline 0.1)' END,
 CASE WHEN mean_conf > 0.48 THEN 'CONFIDENCE_INFLATION: ' || printf('%.2f', mean_conf) || ' (Baseline 0.43)' END) AS alerts FROM st""",
)
def _(t):
    out = d.drift_state(g.settled(t.ledger), BASE_LINES).withColumn("alerts", F.array_join("alerts", "; "))
    return rounded(out, "hit_rate", "ece", "mean_conf")


@query(
    "d02_market_drift",
    f"""WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY ts DESC, bet_id DESC) AS rn, count(*) OVER (PARTITION BY market) AS n FROM s),
a AS (SELECT market, max(n) AS n, avg(probability) AS mc, avg(hit) AS hr, count(*) AS rc, count(*) FILTER (tier = 'TIER_A') AS na, count(*) FILTER (tier = 'TIER_B') AS nb, avg(hit) FILTER (tier = 'TIER_A') AS ha, avg(hit) FILTER (tier = 'TIER_B') AS hb FROM r WHERE rn <= 300 GROUP BY 1),
v AS (SELECT *, CASE WHEN n < 100 THEN 'WATCH' WHEN mc - hr > 0.04 OR (rc >= 300 AND na >= 20 AND nb >= 20 AND ha < hb) THEN 'STOP' ELSE 'GO' END AS status FROM a)
SELECT market, n, round(mc, 6) AS mean_conf, round(hr, 6) AS hit_rate, status, CASE WHEN status = 'STOP' THEN CASE WHEN mc - hr > 0.04 THEN 'overconfidence_drift' ELSE 'tier_inversion' END ELSE '' END AS reason FROM v""",
)
def _(t):
    out = d.market_drift(g.settled(t.ledger), [F.col("ts").desc(), F.col("bet_id").desc()], F.col("bet_id"))
    return rounded(out, "mean_conf", "hit_rate")


LIVE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "d03_feature_drift",
    """WITH b AS (SELECT avg(l_quantity) AS m1, stddev_samp(l_quantity) AS s1, avg(l_extendedprice) AS m2, stddev_samp(l_extendedprice) AS s2, avg(l_discount) AS m3, stddev_samp(l_discount) AS s3 FROM lineitem WHERE l_linestatus = 'F'),
q AS (SELECT l_orderkey, l_linenumber, l_quantity * CASE WHEN l_orderkey % 7 = 0 THEN 9 ELSE 1 END AS x1, l_extendedprice AS x2, l_discount AS x3, CASE WHEN l_orderkey % 5 = 0 THEN 0.5 ELSE 0.08 END AS x4 FROM lineitem),
f AS (SELECT l_orderkey, l_linenumber, CAST(abs(x1 - m1) / s1 > 3 AS INT) AS f1, CAST(abs(x2 - m2) / s2 > 3 AS INT) AS f2, CAST(abs(x3 - m3) / s3 > 3 AS INT) AS f3, CAST(abs(x4 - 0.08) > 1e-5 AS INT) AS f4 FROM q, b)
SELECT l_orderkey, l_linenumber, f1 + f2 + f3 + f4 AS flagged, round((f1 + f2 + f3 + f4) / 4, 6) AS flagged_share, CASE WHEN (f1 + f2 + f3 + f4) / 4 > 0.05 THEN 'CRITICAL' WHEN f1 + f2 + f3 + f4 > 0 THEN 'WARNING' ELSE 'OK' END AS status FROM f""",
)
def _(t):
    items = t("lineitem")
    base = g.feature_moments(items.filter("l_linestatus = 'F'"), ["l_quantity", "l_extendedprice", "l_discount"]).select("feature", "mean", "std")
    constant = items.agg(F.lit("l_tax").alias("feature"), F.lit(0.08).alias("mean"), F.lit(0.0).alias("std"))
    live = items.withColumns(
        {
            "l_quantity": F.col("l_quantity") * F.when(F.col("l_orderkey") % 7 == 0, 9).otherwise(1),
            "l_tax": F.when(F.col("l_orderkey") % 5 == 0, 0.5).otherwise(0.08),
        }
    )
    out = d.feature_drift(live, base.unionByName(constant), LIVE, ["l_orderkey", "l_linenumber"])
    return rounded(out.withColumn("flagged", F.size("flagged")), "flagged_share")


@query(
    "d04_shadow_compare",
    f"""WITH {S}, sh AS (SELECT *, greatest(least(probability * 0.8 + (bet_id % 7) / 50, 1), 0) AS q FROM s), l AS {ece_sql('a', 'league, market', 'sh')}, w AS {ece_sql('a', 'league, market', 'sh', 'q')}
SELECT l.league, l.market, round(l.ece, 6) AS live_ece, round(w.ece, 6) AS shadow_ece, round(l.ece - w.ece, 6) AS delta, CASE WHEN w.ece < l.ece - 0.005 THEN 'PROMOTE' WHEN abs(w.ece - l.ece) <= 0.005 THEN 'HOLD' ELSE 'REVERT' END AS verdict
FROM l JOIN w ON l.league = w.league AND l.market = w.market""",
)
def _(t):
    live = g.settled(t.ledger).select(F.col("bet_id").alias("match_id"), "league", "market", "probability", "hit")
    guess = F.greatest(F.least(F.col("probability") * 0.8 + (F.col("match_id") % 7) / 50, F.lit(1.0)), F.lit(0.0))
    shadow = live.select("match_id", "league", "market", guess.alias("probability"))
    return rounded(d.shadow_compare(live, shadow), "live_ece", "shadow_ece", "delta")


@query(
    "d06_volume_check",
    """WITH c AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS picks FROM orders GROUP BY 1), p AS (SELECT quantile_cont(picks, 0.95) AS p FROM c)
SELECT day, picks, CAST(floor(p * 1.5) AS BIGINT) AS "limit", CASE WHEN picks > floor(p * 1.5) THEN 'WATCH' ELSE 'GO' END AS status FROM c, p""",
)
def _(t):
    return d.volume_check(t("orders"), F.date_format("o_orderdate", "yyyy-MM-dd"))


@query(
    "d07_refit_due",
    f"""WITH {S}, e AS {ece_sql('a', 'market')}, c AS (SELECT market, count(*) AS bets FROM s GROUP BY 1) SELECT c.market, bets, round(ece, 6) AS ece, bets % 2 = 0 AND ece > 0.03 AS refit FROM c JOIN e ON c.market = e.market""",
)
def _(t):
    rows = g.settled(t.ledger)
    return rounded(d.refit_due(rows, g.ece(rows, ["market"], "a"), every=2), "ece")


@query(
    "d08_alert_rows",
    f"""WITH {STATE}, a AS (SELECT league, 'hit_rate_drift' AS type, 'hit_rate' AS metric, 0 AS o, printf('%.2f', hit_rate) AS v, 0.48e0 AS threshold FROM st WHERE hit_rate < 0.43
 UNION ALL SELECT league, 'calibration_drift', 'ece', 0 + CAST(hit_rate < 0.43 AS INT), printf('%.3f', ece), 0.1e0 FROM st WHERE ece > 0.13
 UNION ALL SELECT league, 'confidence_inflation', 'mean_conf', CAST(hit_rate < 0.43 AS INT) + CAST(ece > 0.13 AS INT), printf('%.2f', mean_conf), 0.43e0 FROM st WHERE mean_conf > 0.48),
p AS (SELECT *, v || ' (Baseline ' || CAST(threshold AS VARCHAR) || ')' AS details FROM a),
j AS (SELECT *, '{{"alert":"' || upper(type) || ': ' || details || '","details":"' || details || '","ordinal":' || o || ',"status":"STOP"}}' AS payload FROM p)
SELECT type, league, 'CRITICAL' AS severity, metric, CAST(v AS DOUBLE) AS value, threshold, sha256(type || '|' || league || '||2024-02-01T00:00:00+00:00|' || payload) AS event_id FROM j""",
)
def _(t):
    state = d.drift_state(g.settled(t.ledger), BASE_LINES).select("league", F.lit(None).cast("string").alias("market"), "status", "alerts")
    out = d.alert_rows(state, dt.datetime(2024, 2, 1, tzinfo=dt.UTC))
    return out.select("type", "league", "severity", "metric", "value", "threshold", "event_id")


@query(
    "d09_stop_transitions",
    """WITH h AS (SELECT user_id, ts, event_id, CASE WHEN value > 80 THEN 'STOP' WHEN value > 50 THEN 'WATCH' ELSE 'GO' END AS status FROM events), p AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM h)
SELECT user_id, event_id, coalesce(prev, '-') AS previous_status FROM p WHERE status = 'STOP' AND (prev IS NULL OR prev <> 'STOP')""",
)
def _(t):
    status = F.when(F.col("value") > 80, "STOP").when(F.col("value") > 50, "WATCH").otherwise("GO")
    history = t("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", status.alias("status"))
    out = d.stop_transitions(history, ["user_id"], ["ts", "event_id"])
    return out.select("user_id", "event_id", F.coalesce("previous_status", F.lit("-")).alias("previous_status"))
