"""Edges, gates, candidates, stakes and combinations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clamp
from ..session import cut_lineage
from .ordered import Feature, Running, counted, first_per_key, hot_keys, point_in_time, sequence, top_per_key
from .pricing import soft_cap

# Gates, baselines, weights and limits.
MIN_EV, MIN_EDGE = 0.02, 0.0
FLOORS = {"cards": 0.70, "corners": 0.85, "double_chance": 0.77, "over_1_5": 0.76, "1x2": 0.73, "goals": 0.74, "default": 0.75}
GATE_EDGE = 0.08
GATE_BASELINES = {
    "home_win": 0.38,
    "away_win": 0.30,
    "draw": 0.28,
    "over_2_5": 0.50,
    "under_2_5": 0.50,
    "btts_yes": 0.52,
    "double_chance": 0.66,
    "home_under_1_5": 0.60,
    "away_under_1_5": 0.60,
    "corners_under_11_5": 0.65,
    "cards_over_2_5": 0.55,
    "cards_under_5_5": 0.78,
}
DOUBLE_CHANCE_BASELINE, UNKNOWN_BASELINE = 0.70, 0.50
DAILY_LIMIT = 5
HARD_GATES = {
    "1X2": 0.70,
    "CORNERS": 0.70,
    "1X2_CORNERS": 0.70,
    "CARDS": 0.65,
    "CARDS_O25": 0.60,
    "UND_U15": 0.64,
    "BTTS": 0.70,
    "GOALS_O15": 0.70,
    "GOALS_O25": 0.65,
    "GOALS_U25": 0.65,
    "DOUBLE_CHANCE": 0.75,
    "CARDS_U55": 0.75,
    "CORNERS_O75": 0.70,
    "GOALS_U35": 0.70,
}
MOMENTUM_TYPES = ["CORNERS", "CARDS", "CARDS_O25", "BTTS", "GOALS_O15", "GOALS_O25", "GOALS_U25"]
ANCHOR_TYPES = ["1X2", "1X2_CORNERS", "CARDS_O25", "GOALS_O15", "GOALS_O25"]
MOMENTUM_RELIEF, GATE_MINIMUM = 0.06, 0.60
UNDERDOG_MAX_WIN, UNDERDOG_MIN_U15 = 0.35, 0.60
RISKY_DRAW = 0.26
TIER_1, TIER_2 = 0.75, 0.70
TEMPO = {"o15_stable": 0.70, "o15_low": 0.55, "o75_high": 0.65, "o75_slow": 0.45}
LEAGUE_TEMPO = {"BL1": (0.05, 0.0), "FL1": (0.06, 0.0), "PD": (-0.02, 0.0)}
MAX_STAKE_FRACTION, MARKET_EXPOSURE, BANKROLL = 0.015, 0.07, 1000.0
TIER_MULTIPLIERS = {"TIER_A": 1.0, "TIER_B": 0.6, "TIER_C": 0.4, "NO_BET": 0.0}
TIER_MIN_EV = {"TIER_A": 0.05, "TIER_B": 0.08, "TIER_C": 0.12}
ODDS_LOW, ODDS_HIGH = 1.30, 6.00
STABILITY_WEIGHTS = {"TG_U1.5": 1.00, "CORNERS_U11.5": 0.95, "CORNERS_O7.5": 0.90, "DC": 0.88, "1X2": 0.75, "CARDS_U5.5": 0.85, "CARDS_O2.5": 0.80}
STABILITY_DEFAULT = 0.85
VOLATILITY = {"TG_U1.5": 0.12, "CORNERS_U11.5": 0.15, "CORNERS_O7.5": 0.22, "CARDS_U5.5": 0.18, "CARDS_O2.5": 0.25, "1X2": 0.30}
VOLATILITY_DEFAULT = 0.20
SLIP_WEIGHTS = {
    "CORNERS_U11.5": 1.15,
    "CORNERS_O7.5": 1.10,
    "BTTS_NO": 1.10,
    "GOALS_U3.5": 1.10,
    "CARDS_U5.5": 1.05,
    "CARDS_U4.5": 1.05,
    "CARDS_O2.5": 1.00,
    "TG_U1.5": 0.90,
}
SLIP_MARKETS = ["TG_U1.5", "CORNERS_U11.5", "CORNERS_O7.5", "CARDS_O2.5", "CARDS_U5.5", "CARDS_U4.5", "BTTS_NO", "GOALS_U3.5"]
SLIP_MIN_P, SLIP_MIN_SCORE, SLIP_MIN_CONFIDENCE = 0.65, 0.18, 0.32
SLIP_MARKET_CONFIDENCE = {"CORNERS_O7.5": 0.25, "CARDS_U5.5": 0.28}
CORRELATION_COST, HOUR_DECAY, MAX_CORRELATION = 0.15, 0.3, 1.0
FLOOR = 1e-10
WEIGHT_KEYS = {
    "HOMEWIN": "1X2",
    "AWAYWIN": "1X2",
    "DRAW": "1X2",
    "ONEXTWO": "1X2",
    "1X2": "1X2",
    "DOUBLECHANCE": "DC",
    "DC": "DC",
    "TGU15": "TG_U1.5",
    "CORNERSU115": "CORNERS_U11.5",
    "CORNERSO75": "CORNERS_O7.5",
    "CARDSU55": "CARDS_U5.5",
    "CARDSO25": "CARDS_O2.5",
}


def _lookup(values: dict, key: Column, default) -> Column:
    pairs = F.create_map(*[F.lit(v) for kv in values.items() for v in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def _contains(values: dict, text: Column, default: float) -> Column:
    """Value of the first key that occurs in the text."""
    chain = reduce(
        lambda c, kv: F.when(text.contains(kv[0]), kv[1]) if c is None else c.when(text.contains(kv[0]), kv[1]), values.items(), None
    )
    return chain.otherwise(default)


def edge(df: DataFrame, p: str = "probability", odds: str = "odds", min_ev: float = MIN_EV, min_edge: float = MIN_EDGE) -> DataFrame:
    """Implied probability, edge, expected value and why a price is or is not worth it (K1)."""
    prob, price = F.col(p), F.col(odds)
    ok_p = F.coalesce(prob.between(0, 1) & ~F.isnan(prob), F.lit(False))
    priced = ok_p & price.isNotNull() & (price > 1.0)
    out = df.withColumns(
        {
            "implied": F.when(priced, 1.0 / price),
            "edge": F.when(priced, prob - 1.0 / price),
            "ev": F.when(priced, prob * price - 1.0),
            "priced": F.coalesce(priced, F.lit(False)),
        }
    )
    reason = (
        F.when(~ok_p, "INVALID_PROBABILITY")
        .when(price.isNull(), "MISSING_ODDS")
        .when(price <= 1.0, "INVALID_ODDS")
        .when(F.col("edge") < min_edge, "EDGE_TOO_LOW")
        .when(F.col("ev") < min_ev, "EV_TOO_LOW")
        .otherwise("VALUE_OK")
    )
    return out.withColumn("value_reason", reason).withColumn("passes", F.col("value_reason") == "VALUE_OK")


def value_rank(df: DataFrame, slate: list[str], tie: str, conf: str = "confidence", **kw) -> DataFrame:
    """Rank within the slate: passing first, then edge, EV and confidence, nulls last (K2).

    Hot slates are cut by edge, and what has neither edge nor EV by confidence.
    """
    last = F.lit(float("inf"))
    keys = {
        "_o1": F.when(F.col("passes"), 0.0).otherwise(1.0),
        "_o2": F.coalesce(-F.col("edge"), last),
        "_o3": F.coalesce(-F.col("ev"), last),
        "_o4": F.coalesce(-F.col(conf), last),
    }
    unpriced = (F.col("_o2") == last) & (F.col("_o3") == last)
    by_confidence = 300_000 + F.floor(clamp(F.col("_o4"), -1.0, 1.0) * 50_000)
    steps = F.when(unpriced, by_confidence).otherwise(F.floor(clamp(F.col("_o2"), -2.0, 2.0) * 100_000))
    out = sequence(df.withColumns(keys), slate, [*keys, tie], "value_rank", bucket=F.col("_o1") * 1_000_000 + steps, **kw)
    return out.drop(*keys)


def market_type(market: str = "market") -> Column:
    """Category of a market name, first rule that holds (K3)."""
    m = F.lower(F.col(market))
    return (
        F.when(m.contains("card"), "cards")
        .when(m.contains("corn"), "corners")
        .when(m.contains("double"), "double_chance")
        .when(m.contains("over_1_5") | m.contains("o1.5"), "over_1_5")
        .when(m.isin("home_win", "away_win", "draw"), "1x2")
        .when(m.contains("goals") | m.contains("over") | m.contains("under") | m.contains("btts"), "goals")
        .otherwise("default")
    )


def selection_gate(df: DataFrame, drift: DataFrame, slate: str, row_id: str = "bet_id", match: str = "match_id", limit: int = DAILY_LIMIT) -> DataFrame:
    """Every prediction with the gate that stopped it, or PASSED (K3).

    Floor by market type, edge over the market's baseline, drift stop of the league, one per match and the
    ``limit`` best of the slate. The two collection gates reduce with combinable aggregates and salted tops and
    are joined back by id, so a big slate is never gathered. Rows that an earlier gate stopped are not shuffled.
    ``drift``: league, status. ``df`` is read three times.
    """
    p, m = F.col("probability"), F.col("market")
    base = F.when(m.contains("double_chance"), DOUBLE_CHANCE_BASELINE).otherwise(_lookup(GATE_BASELINES, m, UNKNOWN_BASELINE))
    rows = df.withColumns({"_floor": _lookup(FLOORS, market_type(), FLOORS["default"]), "_edge": p - base})
    rows = rows.join(counted(drift.select("league", F.col("status").alias("_status"))), "league", "left")
    ok = F.coalesce(F.col("_status"), F.lit("OK")).isin("OK", "GO", "WATCH", "WARN")
    stage = (
        F.when(p.isNull() | F.isnan(p), "GATE_1_MODEL_ELIGIBILITY")
        .when(p < F.col("_floor"), "GATE_2_PROB_FLOOR")
        .when(F.col("_edge") < GATE_EDGE, "GATE_3_LOW_EDGE")
        .when(~ok, "GATE_4_DRIFT_BLOCKED")
    )
    rows = rows.withColumns({"_stage": stage, "gate_score": F.when(stage.isNull(), p * (1 + F.col("_edge")))})
    alive = rows.filter(F.col("_stage").isNull()).select(slate, match, row_id, "gate_score")
    best = first_per_key(alive, [slate, match], [-F.col("gate_score"), F.col(row_id)])
    order = [F.col("gate_score").desc(), F.col(row_id)]
    taken = top_per_key(best, [slate], order, limit, F.col(row_id)).select(row_id, F.lit(True).alias("_taken"))
    marks = cut_lineage(best.select(row_id, F.lit(True).alias("_best")).join(taken, row_id, "left"), free_shuffles=True)
    stopped, reached = (rows.filter(F.col("_stage").isNotNull()), rows.filter(F.col("_stage").isNull()))
    # An id that several matches or slates share has a mark in each, and its rows meet all of them.
    if (shared := hot_keys(marks, [row_id], 1)) is not None:
        reached = reached.unionByName(stopped.join(shared, row_id, "left_semi"))
        stopped = stopped.join(shared, row_id, "left_anti")
    final = F.coalesce(
        F.col("_stage"),
        F.when(F.col("_taken"), "PASSED").when(F.col("_best"), "GATE_6_DAILY_LIMIT").otherwise("GATE_5_CORRELATION_BLOCK"),
    )
    ended = stopped.withColumn("stage", F.col("_stage")), reached.join(marks, row_id, "left").withColumn("stage", final)
    return reduce(DataFrame.unionByName, [e.select(*df.columns, "gate_score", "stage") for e in ended])


def gate_counts(gated: DataFrame, slate: str) -> DataFrame:
    """Rows per slate and gate (K3)."""
    return gated.groupBy(slate, "stage").agg(F.count(F.lit(1)).alias("n"))


def candidates(df: DataFrame) -> DataFrame:
    """Qualified markets of each match with tier, dissonance and tempo (K4).

    ``df``: one row per match with prices and, where known, home_/away_status_band and _momentum_band. All rules
    look at one match, so this is a projection and an explode.
    """
    c = F.col
    have = {f.name for f in df.schema.fields}

    def price(name: str) -> Column:
        return c(name).cast("double") if name in have else F.lit(None).cast("double")

    zero = lambda name: F.coalesce(price(name), F.lit(0.0))
    ph, pa = zero("home_win"), zero("away_win")
    known = c("home_status_band").isNotNull() & c("away_status_band").isNotNull()
    fav = F.when(ph > pa, "HOME").otherwise("AWAY")
    dog = F.when(ph > pa, "AWAY").otherwise("HOME")
    side = lambda which, band: F.when(which == "HOME", c(f"home_{band}")).otherwise(c(f"away_{band}"))
    surging = lambda s: (c(f"{s}_status_band") == "LOW") & (c(f"{s}_momentum_band") == "STRONG_POSITIVE")
    df = df.withColumns({"_known": known, "_fav": fav, "_dog": dog})
    trap = (side(c("_fav"), "status_band") == "TOP") & (side(c("_fav"), "momentum_band") == "STRONG_NEGATIVE")
    df = df.withColumns(
        {
            "_trap": c("_known") & F.coalesce(trap, F.lit(False)),
            "_relief": c("_known") & F.coalesce(surging("home") | surging("away"), F.lit(False)),
            "_upset": c("_known")
            & F.coalesce((side(c("_dog"), "status_band") == "TOP") & side(c("_fav"), "status_band").isin("LOW", "MID"), F.lit(False)),
        }
    )
    entries: list[Column] = []

    def add(kind: str, name: Column | str, conf: Column, when: Column) -> None:
        label = F.lit(name) if isinstance(name, str) else name
        valid = when & conf.between(0, 1)
        entries.append(F.when(valid, F.struct(F.lit(kind).alias("type"), label.alias("market_name"), conf.alias("conf"))))

    some = lambda name: price(name).isNotNull() & (price(name) != 0)
    fav_p = F.when(c("_fav") == "HOME", ph).otherwise(pa)
    dog_p = F.when(c("_fav") == "HOME", pa).otherwise(ph)
    add("1X2", F.concat("_fav", F.lit("_WIN")), fav_p, ~c("_trap"))
    for kind, name, column in (
        ("CORNERS", "CORNERS_U11.5", "corn_u11"),
        ("CORNERS_O75", "CORNERS_O7.5", "corners_over_7_5"),
        ("CARDS", "CARDS_U4.5", "card_u45"),
        ("CARDS_O25", "CARDS_O2.5", "cards_over_2_5"),
        ("CARDS_U55", "CARDS_U5.5", "card_u55"),
        ("GOALS_O15", "GOALS_O1.5", "over_1_5"),
        ("GOALS_O25", "GOALS_O2.5", "over_2_5"),
        ("GOALS_U25", "GOALS_U2.5", "under_2_5"),
        ("GOALS_U35", "GOALS_U3.5", "goals_under_3_5"),
        ("BTTS", "BTTS_YES", "btts_yes"),
        ("BTTS", "BTTS_NO", "btts_no"),
    ):
        add(kind, name, price(column), some(column))
    dog_u15 = F.when(c("_dog") == "HOME", zero("home_under_1_5")).otherwise(zero("away_under_1_5"))
    add(
        "UND_U15",
        F.concat("_dog", F.lit("_TG_U1.5")),
        dog_u15,
        (dog_p < UNDERDOG_MAX_WIN) & (dog_u15 > UNDERDOG_MIN_U15) & ~c("_upset"),
    )
    ch, ca = zero("corners_home_win"), zero("corners_away_win")
    corner_side = F.when(ch > ca, "HOME").otherwise("AWAY")
    add("1X2_CORNERS", F.concat(corner_side, F.lit("_CORNERS_WIN")), F.greatest(ch, ca), some("corners_home_win"))
    for name, own, other in (("dc_1x", "home", "away"), ("dc_x2", "away", "home")):
        shaky = F.coalesce(
            c(f"{own}_momentum_band").isin("NEUTRAL", "NEGATIVE") | (c(f"{other}_momentum_band") == "STRONG_POSITIVE"), F.lit(False)
        )
        use = (zero(name) > 0) & ((zero("draw") > RISKY_DRAW) | (c("_known") & shaky))
        add("DOUBLE_CHANCE", f"{own.upper()}_DC", zero(name), use)

    league = c("league")
    shift = lambda i: _lookup({k: v[i] for k, v in LEAGUE_TEMPO.items()}, league, 0.0)
    adjusted = lambda name, i: F.when(league.isin(*LEAGUE_TEMPO), clamp(zero(name) + shift(i), 0.0, 1.0)).otherwise(zero(name))
    o15, o75 = adjusted("over_1_5", 0), adjusted("corners_over_7_5", 1)
    pace = F.when(o15 >= TEMPO["o15_stable"], "STABLE").when(o15 <= TEMPO["o15_low"], "LOW_EVENT").otherwise("NORMAL")
    fast = F.when(pace == "NORMAL", "HIGH_TEMPO").otherwise(F.concat(pace, F.lit("/HIGH_TEMPO")))
    tempo = F.when(o75 >= TEMPO["o75_high"], fast).otherwise(pace)
    suppressed = (o15 <= TEMPO["o15_low"]) | (o75 <= TEMPO["o75_slow"])
    both = ~c("_trap") & fav_p.between(0, 1) & some("corners_home_win") & F.greatest(ch, ca).between(0, 1)

    keep = [n for n in ("match_id", "league", "match_date", "season") if n in have]
    rows = (
        df.withColumns({"tempo_status": tempo, "dissonance": both & (corner_side != c("_fav"))})
        .filter(~suppressed)
        .select(*keep, "tempo_status", "dissonance", "_relief", F.inline(F.array(*entries)))
        .filter(c("type").isNotNull())
    )
    gate = _lookup(HARD_GATES, c("type"), 1.0)
    relieved = F.greatest(gate - MOMENTUM_RELIEF, F.lit(GATE_MINIMUM))
    gate = F.when(c("_relief") & c("type").isin(*MOMENTUM_TYPES), relieved).otherwise(gate)
    tier = F.when(c("type").isin(*ANCHOR_TYPES) & (c("conf") >= TIER_1) & ~c("dissonance"), 1).when(c("conf") >= TIER_2, 2).otherwise(3)
    return rows.filter(c("conf") >= gate).withColumn("tier", tier).drop("_relief")


def kelly(df: DataFrame, bankroll: float = BANKROLL, p: str = "probability") -> DataFrame:
    """Capped fractional Kelly stake, scaled by tier, zero outside the odds bounds or under the tier's EV (K5)."""
    prob, odds, tier = F.col(p), F.col("odds"), F.col("tier")
    ev = F.when(odds > 1.0, prob * odds - 1).otherwise(0.0)
    allowed = odds.between(ODDS_LOW, ODDS_HIGH) & (ev >= _lookup(TIER_MIN_EV, tier, 0.12))
    fraction = F.greatest(F.least((prob * odds - 1) / (odds - 1), F.lit(MAX_STAKE_FRACTION)), F.lit(0.0))
    stake = F.round(bankroll * fraction * _lookup(TIER_MULTIPLIERS, tier, 0.0), 2)
    return df.withColumn("kelly_stake", F.when(F.coalesce(allowed, F.lit(False)), stake).otherwise(0.0))


def exposure_cap(df: DataFrame, keys: list[str], order: list[str], stake: str = "kelly_stake", bankroll: float = BANKROLL, **kw) -> DataFrame:
    """Stakes cut so that a day's stakes per market stay within the limit, first come first served (K6).

    With every stake recorded, the part of a stake under the cap is min(cap, sum so far + stake) - min(cap, sum so far).
    """
    before = Feature(running={"_before": Running("sum", F.col(stake))})
    cap = F.lit(bankroll * MARKET_EXPOSURE)
    so_far = F.coalesce(F.col("_before"), F.lit(0.0))
    before.finish = {"capped_stake": F.least(cap, so_far + F.col(stake)) - F.least(cap, so_far)}
    return point_in_time(df, keys, order, [before], **kw)


# ---- combinations ---------------------------------------------------------------------------------------


def leg_score(conf: Column, weight: Column, volatility: Column) -> Column:
    """Stability of one leg: p * weight * (1 - mean of (1 - p) and the market's volatility)."""
    return F.greatest(conf * weight * (1 - (0.5 * (1 - conf) + 0.5 * volatility)), F.lit(FLOOR))


def _decay(a: Column, b: Column) -> Column:
    hours = F.abs(F.unix_micros(a) - F.unix_micros(b)) / 3_600_000_000
    return F.coalesce(F.exp(-HOUR_DECAY * hours), F.lit(1.0))


def risk_band(score: Column) -> Column:
    return F.when(score >= 0.45, "VERY LOW").when(score >= 0.30, "LOW").when(score >= 0.20, "MEDIUM").otherwise("HIGH")


def combo_score(legs: DataFrame, combo: str = "combo_id") -> DataFrame:
    """Survivability score of given combinations of a few legs (K7).

    ``legs``: combo, confidence, market_name, league, match_date. A combination has at most a handful of legs,
    which are gathered in one array per combination for the pairwise correlation.
    """
    m, p = F.col("market_name"), F.col("confidence")
    s = leg_score(p, _contains(STABILITY_WEIGHTS, m, STABILITY_DEFAULT), _contains(VOLATILITY, m, VOLATILITY_DEFAULT))
    grouped = legs.withColumn("_s", s).groupBy(combo).agg(
        F.count(F.lit(1)).alias("legs"),
        F.exp(F.sum(F.log("_s"))).alias("stability"),
        F.product(1 - p).alias("_fail"),
        F.sort_array(F.collect_list(F.struct("match_date", "league"))).alias("_legs"),
    )
    pair = lambda a, b: F.when(a["league"] == b["league"], _decay(a["match_date"], b["match_date"])).otherwise(0.0)
    inner = lambda a, i: F.aggregate(
        F.slice("_legs", i + 2, F.size("_legs")), F.lit(0.0), lambda acc, b: acc + pair(a, b)
    )
    correlation = F.aggregate(F.transform("_legs", inner), F.lit(0.0), lambda acc, x: acc + x)
    out = grouped.withColumn("correlation", correlation)
    score = F.col("stability") * F.exp(-CORRELATION_COST * F.col("correlation")) * (1 - F.col("_fail"))
    out = out.withColumn("score", score)
    return out.withColumn("risk", risk_band(F.col("score"))).drop("_fail", "_legs")


def slip_pool(cands: DataFrame) -> DataFrame:
    """Candidates allowed in slips, with their weighted leg score (K8)."""
    m, p = F.col("market_name"), F.col("confidence")
    enough = _lookup(SLIP_MARKET_CONFIDENCE, m, SLIP_MIN_CONFIDENCE)
    allowed = reduce(lambda a, b: a | b, [m.contains(v) for v in SLIP_MARKETS])
    pool = cands.filter((F.col("probability") >= SLIP_MIN_P) & (p >= enough) & allowed)
    pool = pool.withColumns(
        {
            "_w": _contains(STABILITY_WEIGHTS, m, STABILITY_DEFAULT),
            "_v": _contains(VOLATILITY, m, VOLATILITY_DEFAULT),
            "_m": _contains(SLIP_WEIGHTS, m, 1.0),
        }
    )
    return pool.withColumn("_a", leg_score(p, F.col("_w"), F.col("_v")) * F.col("_m"))


def best_slip(cands: DataFrame, slate: list[str], leg: str = "leg_id") -> DataFrame:
    """Best combination of 2 to 4 legs per slate (J14, K8), exact and without listing all combinations.

    Score of a combination: product of weighted leg scores * exp(-0.15 * correlation) * (1 - product of (1 - p)).
    1. Legs of one league, kickoff and weight class differ only in p, and the score rises with p; at most three
       other legs can occupy matches, so the four best matches of a class are all an optimum can need.
    2. The best pair with the slate's best leg bounds the optimum from below; a leg, pair or triple whose
       product cannot reach it with the best possible completion is dropped.
    3. What is left grows leg by leg in id order. Ties go to fewer legs, then to the smallest ids.
    """
    pool = slip_pool(cands)
    clazz = [*slate, "league", "match_date", "_w", "_v", "_m"]
    cols = [*clazz, "match_id", leg, "confidence", "_a"]
    one = first_per_key(pool.select(*cols), [*clazz, "match_id"], [-F.col("confidence"), F.col(leg)])
    legs = top_per_key(one, clazz, [F.col("confidence").desc(), F.col(leg)], 4, F.col(leg))
    legs = legs.select(*slate, leg, "match_id", "league", "match_date", F.col("confidence").alias("p"), F.col("_a").alias("a"))

    # the best partner of the slate's best leg, a linear pass, gives a score that can be reached
    first = first_per_key(legs, slate, [-F.col("a"), F.col(leg)])
    first = first.select(*slate, *[F.col(c).alias(f"_1{c}") for c in ("match_id", "league", "match_date", "p", "a")])
    partner = legs.join(first, slate).filter(F.col("match_id") != F.col("_1match_id"))
    near = F.when(F.col("league") == F.col("_1league"), _decay(F.col("match_date"), F.col("_1match_date"))).otherwise(0.0)
    reach = F.col("a") * F.col("_1a") * F.exp(-CORRELATION_COST * near) * (1 - (1 - F.col("p")) * (1 - F.col("_1p")))
    low = partner.groupBy(*slate).agg(F.max(reach).alias("_low"))
    top = legs.groupBy(*slate).agg(F.greatest(F.max("a"), F.lit(1.0)).alias("_up"), F.max("a").alias("_best"))
    bounds = low.join(top, slate).withColumn("_low", F.greatest(F.col("_low"), F.lit(SLIP_MIN_SCORE)) * (1 - 1e-9))
    # a further leg multiplies a score by at most max(1, best leg); two legs at least are needed
    up = F.col("_up")
    legs = cut_lineage(legs.join(bounds, slate).filter(F.col("a") * F.col("_best") * up * up >= F.col("_low")))

    flat = lambda n: legs.select(
        *slate, F.struct(F.col(leg).alias("id"), "match_id", "league", "match_date").alias(f"l{n}"), F.col("a").alias(f"a{n}"), F.col("p").alias(f"p{n}")
    )
    grown = legs.select(
        *slate,
        F.array(F.struct(F.col(leg).alias("id"), "match_id", "league", "match_date")).alias("legs"),
        F.col("a").alias("prod"),
        (1 - F.col("p")).alias("fail"),
        F.lit(0.0).alias("corr"),
        "_low",
        "_up",
    )
    levels = []
    for n in (2, 3, 4):
        new = F.col(f"l{n}")
        joined = grown.join(flat(n), slate).filter(new["id"] > F.element_at("legs", -1)["id"])
        joined = joined.filter(F.col("prod") * F.col(f"a{n}") * F.pow(F.col("_up"), F.lit(4 - n)) >= F.col("_low"))
        joined = joined.filter(~F.exists("legs", lambda x: x["match_id"] == F.col(f"l{n}.match_id")))
        added = F.aggregate(
            "legs",
            F.lit(0.0),
            lambda acc, x: acc
            + F.when(x["league"] == F.col(f"l{n}.league"), _decay(x["match_date"], F.col(f"l{n}.match_date"))).otherwise(0.0),
        )
        grown = (
            joined.withColumn("corr", F.col("corr") + added)
            .filter(F.col("corr") <= MAX_CORRELATION)
            .select(
                *slate,
                F.concat("legs", F.array(f"l{n}")).alias("legs"),
                (F.col("prod") * F.col(f"a{n}")).alias("prod"),
                (F.col("fail") * (1 - F.col(f"p{n}"))).alias("fail"),
                "corr",
                "_low",
                "_up",
            )
        )
        grown = cut_lineage(grown) if n < 4 else grown
        score = F.col("prod") * F.exp(-CORRELATION_COST * F.col("corr")) * (1 - F.col("fail"))
        levels.append(grown.select(*slate, F.transform("legs", lambda x: x["id"]).alias("ids"), "corr", score.alias("score")))
    every = reduce(lambda a, b: a.unionByName(b), levels).filter(F.col("score") >= SLIP_MIN_SCORE)
    # scores equal to twelve digits are ties: products of the same legs may differ in the last place
    order = F.struct((-F.round("score", 12)).alias("s"), F.size("ids").alias("n"), F.col("ids"))
    best = every.groupBy(*slate).agg(F.min_by(F.struct("ids", "corr", "score"), order).alias("_b"))
    out = best.select(*slate, F.col("_b.ids").alias("leg_ids"), F.col("_b.corr").alias("correlation"), F.col("_b.score").alias("score"))
    return out.withColumn("risk", risk_band(F.col("score")))


def refresh_weights(accuracy: DataFrame, min_n: int = 200) -> DataFrame:
    """New stability weights: count-weighted accuracy of well-sampled markets, best to worst over the old span (K9).

    ``accuracy``: market, n, accuracy. There are as many keys as weights, so the ranking is over a handful of rows.
    """
    label = F.upper(F.regexp_replace("market", "[^A-Za-z0-9]", ""))
    exact = F.try_element_at(F.create_map(*[F.lit(v) for kv in WEIGHT_KEYS.items() for v in kv]), label)
    plain = {name: "".join(ch for ch in name if ch.isalnum()) for name in STABILITY_WEIGHTS}
    key = F.coalesce(exact, *[F.when(label.contains(part), name) for name, part in plain.items()])
    pooled = (
        accuracy.filter((F.col("n") >= min_n) & F.col("accuracy").isNotNull())
        .withColumn("weight_key", key)
        .filter(F.col("weight_key").isNotNull())
        .groupBy("weight_key")
        .agg((F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))
    )
    high, low = max(STABILITY_WEIGHTS.values()), min(STABILITY_WEIGHTS.values())
    whole = Window.partitionBy(F.lit(0))
    place = F.row_number().over(whole.orderBy(F.col("accuracy").desc(), "weight_key")) - 1
    size = F.count(F.lit(1)).over(whole)
    share = F.when(size > 1, place / (size - 1)).otherwise(0.0)
    return pooled.withColumn("weight", F.round(high - (high - low) * share, 4))


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Ordered listing of ``n`` rows, taken per partition before they meet."""
    return df.orderBy(*order).limit(n)


def canonical_sort(df: DataFrame, columns: list[str], partitions: int | None = None) -> DataFrame:
    """Total order over files: range partitions, each sorted."""
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *columns)
    return ranged.sortWithinPartitions(*columns)


def summary(df: DataFrame) -> DataFrame:
    """One display row per match from wide predictions."""
    have = set(df.columns)

    def first(*names: str) -> Column:
        present = [F.col(n).cast("string").try_cast("double") for n in names if n in have]
        return F.coalesce(*present) if present else F.lit(None).cast("double")

    zero = lambda *names: F.coalesce(first(*names), F.lit(0.0))
    home, draw, away = zero("home", "home_win"), zero("draw"), zero("away", "away_win")
    corners = F.greatest(*[zero(n) for n in ("corn_o75", "corn_u11", "corn_1x2_h", "corn_1x2_d", "corn_1x2_a")])
    cards = F.greatest(*[zero(n) for n in ("card_o25", "card_u45", "card_u55")])
    btts, over = first("btts", "btts_yes"), first("o25", "over_2_5")
    eh, ea = first("expected_home_goals", "goal_model_home_lambda"), first("expected_away_goals", "goal_model_away_lambda")
    df = df.withColumns(
        {
            "home_prob": home,
            "draw_prob": draw,
            "away_prob": away,
            "btts_prob": btts,
            "over25_prob": over,
            "corners_prob": corners,
            "cards_prob": cards,
            "expected_goals": F.when(eh.isNotNull() | ea.isNotNull(), F.coalesce(eh, F.lit(0.0)) + F.coalesce(ea, F.lit(0.0))),
            "_n": F.least(F.lit(5), F.coalesce(first("h2h_match_count").cast("int"), F.lit(0))),
        }
    )
    # a null among the candidates counts as 0, as greatest skips it and home_prob is never null
    overall = F.greatest("home_prob", "draw_prob", "away_prob", "btts_prob", "over25_prob", "corners_prob", "cards_prob")
    df = df.withColumn("confidence", overall)
    tier = F.when(F.col("confidence") >= 0.65, "HIGH").when(F.col("confidence") >= 0.5, "MEDIUM").otherwise("LOW")
    return largest_remainder(df.withColumn("confidence_tier", tier), ["home_prob", "draw_prob", "away_prob"], "_n", ["h2h_home", "h2h_draws", "h2h_away"]).drop("_n")


def largest_remainder(df: DataFrame, shares: list[str], total: str, names: list[str]) -> DataFrame:
    """Split a whole number by shares: floors, then one each to the largest remainders, earlier columns first."""
    whole = {i: F.floor(F.col(s) * F.col(total)) for i, s in enumerate(shares)}
    df = df.withColumns({f"_f{i}": w for i, w in whole.items()})
    df = df.withColumns({f"_r{i}": F.col(s) * F.col(total) - F.col(f"_f{i}") for i, s in enumerate(shares)})
    rest = F.col(total) - reduce(lambda a, b: a + b, [F.col(f"_f{i}") for i in whole])
    out = {}
    for i, name in enumerate(names):
        mine = F.col(f"_r{i}")
        ahead = [(F.col(f"_r{k}") >= mine if k < i else F.col(f"_r{k}") > mine).cast("int") for k in whole if k != i]
        extra = (F.col(total) > 0) & (reduce(lambda a, b: a + b, ahead) < F.col("_rest"))
        out[name] = F.col(f"_f{i}") + extra.cast("int")
    df = df.withColumn("_rest", rest).withColumns(out)
    return df.drop("_rest", *[f"_{x}{i}" for x in "fr" for i in whole])


def value_opportunities(preds: DataFrame, slate: list[str], tie: str, **kw) -> tuple[DataFrame, DataFrame]:
    """(kept and ranked, rejected with the first reason).

    ``preds`` carries market, p_raw, sharpness, calibrated (null: no calibrator), confidence, action_tier, odds
    and drift status, joined from their tables by the caller.
    """
    capped = preds.withColumn("probability", soft_cap(F.col("calibrated"), F.col("confidence"), F.col("market")))
    priced = edge(capped)
    stopped = F.coalesce(F.col("drift"), F.lit("GO")) == "STOP"
    reason = (
        F.when(F.col("sharpness") == "DISABLED", "SHARPNESS_DISABLED")
        .when(F.col("calibrated").isNull(), "CALIBRATOR_DISABLED")
        .when(F.col("action_tier") == "NO_BET", "LOW_TIER")
        .when(~F.col("priced"), "ODDS_SANITY")
        .when(~F.col("passes"), "EV_FAIL")
        .when(stopped, "DRIFT_FREEZE")
    )
    details = (
        F.when(reason == "LOW_TIER", F.format_string("confidence=%.3f", "confidence"))
        .when(reason == "ODDS_SANITY", F.col("value_reason"))
        .when(reason == "EV_FAIL", F.format_string("%s: edge=%.3f ev=%.3f", "value_reason", "edge", "ev"))
        .otherwise("")
    )
    tagged = priced.withColumns({"reason": reason, "details": details})
    kept = value_rank(tagged.filter(F.col("reason").isNull()).drop("reason", "details"), slate, tie, **kw)
    return kept, tagged.filter(F.col("reason").isNotNull())
