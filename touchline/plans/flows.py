"""End-to-end flows: the feature matrix, priced slates, and settlement with its state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import drift as d
from ..operators import features as ft
from ..operators import joins as j
from ..operators import labels as lab
from ..operators import metrics as g
from ..operators import pricing as pr
from ..operators import selection as sel
from ..operators.ordered import CHUNK_ROWS, counted, hot_keys
from ..session import cut_lineage, release

RATES = ["goals_for", "goals_against", "corners_for", "corners_against", "cards_for", "shots_for"]


def side_features(team: DataFrame, widths: tuple[int, ...] = (5, 10), **kw) -> DataFrame:
    """Every window feature of a side in one pass over the team key."""
    parts = [ft.rolling_mean(RATES, w) for w in widths]
    parts += [ft.rolling_density(5), ft.rolling_source_date(5), ft.rest_days(), ft.clean_sheets(5)]
    parts += [ft.dominance("goals"), ft.dominance("shots"), ft.pressure(5), ft.home_advantage()]
    return ft.add_features(team, parts, **kw)


def feature_matrix(contests: DataFrame, widths: tuple[int, ...] = (5, 10), impute: bool = False, ordered: bool = True) -> DataFrame:
    """One row per match with both sides' features, deltas, head-to-head, referee and calendar columns.

    Beside the window features of a side: season blends, season goal difference, form, streaks and congestion, and a
    missing flag for each rolling mean. ``impute`` fills those means with the priors of their family afterwards.
    ``ordered=False`` leaves season blends, goal difference, form, streaks and congestion out. Sides are counted first: if
    none is hot, all their features share one shuffle on the side, and a pair's one on the pair; otherwise each operator
    cuts the hot keys by itself. Matches are counted too: if no id repeats, columns that nobody reads are not made. Write
    the result as a table before fitting on it.
    """
    team = ft.team_rows(contests)
    # Sides are counted once. If none is hot, no season of a side and no pair is, and they need no count of their own.
    hot = hot_keys(team, ft.TEAM_KEY, CHUNK_ROWS) is not None
    calm = {} if hot else {"split_hot_keys": False}
    team = side_features(team, widths, **calm)
    means = [f"{c}_avg{w}" for w in widths for c in RATES]
    names = means + ["sos_attack", "sos_defence", "rest_days", "clean_sheet_rate", "goals_dominance", "shots_dominance"]
    names += ["pressure_index", "home_advantage"]
    if ordered:
        if hot:
            team = ft.congestion(ft.streaks(ft.form(ft.season_goal_difference(ft.season_blend(team, RATES)))))
        else:
            team = ft.side_history(team, RATES)
        names += [*(f"{c}_season" for c in RATES), "season_goal_diff", "form", "win_streak", "unbeaten_streak", "congestion"]
    team = ft.schedule_strength(team, "goals_for_avg5", "goals_against_avg5")
    base = ft.referee_rate(contests)  # blank names share a key of their own, so it is counted there
    base = ft.days_since_meeting(ft.head_to_head(base, **calm), pair="pair", **calm).drop("pair")
    out = ft.reassemble(base, team, [*names, "max_source_date5"], unique=hot_keys(contests, ["match_id"], 1) is None)
    rolling = [f"{side}_{c}" for side in ("home", "away") for c in means]
    out = ft.missing_flags(ft.deltas(out, names), rolling)
    return ft.context(ft.impute_priors(out, rolling) if impute else out)


def price_fixtures(fixtures: DataFrame, home_rate: str, away_rate: str) -> DataFrame:
    """Rates to coherent goal prices, derived markets and the handicap."""
    priced = pr.price_goals(fixtures, home_rate, away_rate)
    return pr.price_handicap(pr.price_derived(priced, home_rate, away_rate), home_rate, away_rate)


# Price column and market name of a prediction's rows.
PREDICTED = {
    **{c: c for c in ("home_win", "draw", "away_win", "btts_no", "home_under_1_5", "away_under_1_5")},
    **{"o15": "goals_o15", "o25": "goals_o25", "u25": "goals_u25", "u35": "goals_u35", "btts": "btts_yes"},
    **{"dc_1x": "double_chance_1x", "dc_x2": "double_chance_x2", "dc_12": "double_chance_12"},
    **{"corners_under_11_5": "corn_u11", "corners_over_7_5": "corn_o75"},
    **{"cards_over_2_5": "card_o25", "cards_under_4_5": "card_u45", "cards_under_5_5": "card_u55"},
}

# Columns of a fixture that prices and confidence read, beside its ids and the models' rates.
READ = ["h2h_count", "h2h_avg_corners", "h2h_avg_cards", "h2h_over_2_5_rate", "h2h_cards_over_2_5_rate", "days_since_h2h"]
READ += ["mu_home_corners", "mu_away_corners", "mu_cards"]


def price_all(fixtures: DataFrame, offsets: DataFrame, first: tuple[str, str], second: tuple[str, str], cards: str = "zip") -> DataFrame:
    """Every price of a fixture from two models' goal rates and the count means.

    ``fixtures``: matrix rows with both models' rates and ``mu_home_corners, mu_away_corners, mu_cards``. ``offsets``: a
    row per side, counted, and broadcast if few, so that fixtures are not shuffled for it; all else is a projection.
    ``cards``: "zip" or "nb" (M3 or M4); with "nb" the sides take 45 and 55 % of the mean, with a variance 1.3 and 0.9
    times theirs.
    """
    rates = ("home_lambda", "away_lambda")
    offsets = counted(offsets)
    df = pr.ensemble(fixtures, first, second).withColumn("high_intensity", pr.high_intensity())
    df = pr.adjust_card_rate(pr.adjust_corner_rates(df, offsets, F.col("high_intensity")), offsets)
    corners = ("adj_home_corners", "adj_away_corners")
    df = pr.price_corners(df, *corners, F.col("var_home_corners"), F.col("var_away_corners"))
    if cards == "nb":
        home, away = F.col("adj_cards") * 0.45, F.col("adj_cards") * 0.55
        df = pr.price_cards_nb(df, home, home * 1.3, away, away * 0.9)
        df = df.withColumnsRenamed({f"nb_cards_{c}": f"cards_{c}" for c in ("over_2_5", "under_4_5", "under_5_5")})
    else:
        df = pr.price_cards_zip(df, "adj_cards")
    df = df.withColumn("cards_over_2_5", F.coalesce("card_o25_cap", "cards_over_2_5"))
    df = pr.adjust_goals(price_fixtures(df, *rates), *rates)
    finals = {"btts_no": "btts_no_final", "home_under_1_5": "home_u15", "away_under_1_5": "away_u15"}
    return df.withColumns({name: F.col(c) for name, c in finals.items()}).drop(*finals.values())


def predict(
    fixtures: DataFrame,
    offsets: DataFrame,
    drift: DataFrame,
    first: tuple[str, str],
    second: tuple[str, str],
    slate: str,
    *,
    baselines: DataFrame | None = None,
    buckets: DataFrame | None = None,
    volatility: str | None = None,
    cards: str = "zip",
) -> DataFrame:
    """Matrix rows to gated predictions, one row per fixture and market; checkpointed a row per fixture, before and after pricing.

    ``drift`` (league, status; ``GLOBAL`` for leagues without a state of their own, none at all lets through): fixtures of
    a stopped league are not priced. Then prices (``price_all``), a row per market (M14), confidence (M11), soft ceilings
    (M12) and the gates (K3) within ``slate``. Returns the fixture's ids, ``prediction_id, market, raw_probability,
    probability, confidence, action_tier, stake_share, gate_score, stage``.
    """
    everywhere = drift.filter(F.col("league") == "GLOBAL").agg(F.max("status").alias("s")).scalar()
    own = counted(drift.filter(F.col("league") != "GLOBAL").select("league", F.col("status").alias("_own")))
    baselines, buckets = (None if t is None else counted(t) for t in (baselines, buckets))
    open_ = fixtures.join(own, "league", "left").withColumn("_state", F.coalesce("_own", everywhere, F.lit("GO")))
    ids = ["match_id", "league", "home_team", "away_team", slate]
    flags = [F.col(c) for c in fixtures.columns if c.endswith("_missing")]
    known = {
        "missing_": sum(flags, F.lit(0)),
        "known_": F.col("referee_key") != "UNKNOWN",
        "vol_": F.col(volatility) if volatility else F.lit(0.0),
    }
    read = dict.fromkeys([*ids, *READ, *first, *second])
    # The shuffles behind the fixtures go before there are prices, so the disks never hold both.
    slim = open_.filter(F.col("_state") != "STOP").select(*read, *[value.alias(name) for name, value in known.items()])
    slim = cut_lineage(slim, free_shuffles=True)
    df = price_all(slim, offsets, first, second, cards)

    goals = F.col("home_lambda") + F.col("away_lambda")
    zero = pr.CARD_ZERO_MASS
    df = df.withColumns(
        {
            # mean and variance of what a family of markets counts: Poisson, two negative binomials, zero-inflated Poisson
            "_goals": F.struct(goals.alias("mu"), goals.alias("var")),
            "_corners": F.struct(
                (F.col("adj_home_corners") + F.col("adj_away_corners")).alias("mu"), (F.col("var_home_corners") + F.col("var_away_corners")).alias("var")
            ),
            "_cards": F.struct(
                (F.col("adj_cards") * (1 - zero)).alias("mu"), (F.col("adj_cards") * (1 - zero) * (1 + zero * F.col("adj_cards"))).alias("var")
            ),
        }
    )
    keep = [*ids, "h2h_count", "days_since_h2h", *known, "_goals", "_corners", "_cards"]
    # The gates read the rows three times. They must not price the fixtures as often, and what is kept for them is a row per
    # fixture: one per market takes several times the disk. Price columns hold the same names as some markets, so the rows
    # are made from copies.
    priced = cut_lineage(df.select(*keep, *[F.col(c).alias(f"_price_{c}") for c in PREDICTED]), free_shuffles=True)
    release(slim)
    rows = pr.to_market_rows(priced, {f"_price_{c}": m for c, m in PREDICTED.items()}, keep)
    m = F.col("market")
    family = F.when(m.startswith("corn"), F.col("_corners")).when(m.startswith("card"), F.col("_cards")).otherwise(F.col("_goals"))
    rows = rows.withColumn("count_", family)
    rows = pr.confidence(
        rows.drop("_goals", "_corners", "_cards"),
        baselines,
        buckets,
        mu=F.col("count_.mu"),
        variance=F.col("count_.var"),
        h2h_count=F.col("h2h_count"),
        days_since_h2h=F.col("days_since_h2h"),
        missing=F.col("missing_"),
        referee_known=F.col("known_"),
        team_volatility=F.col("vol_"),
    )
    rows = rows.withColumnRenamed("probability", "raw_probability")
    rows = rows.withColumns(
        {
            "probability": pr.soft_cap(F.col("raw_probability"), F.col("confidence"), m),
            "prediction_id": F.concat_ws("-", "match_id", "market"),
        }
    )
    made = ["prediction_id", "market", "raw_probability", "probability", "confidence", "action_tier", "stake_share"]
    rows = rows.select(*ids, *made)
    # A league in the state table by way of GLOBAL needs no state here: stopped ones are gone.
    gated = sel.selection_gate(rows, own.withColumnRenamed("_own", "status"), slate, row_id="prediction_id")
    return gated.select(*ids, *made, "gate_score", "stage")


def settle(
    preds: DataFrame, results: DataFrame, order: list[str], seen: DataFrame | None = None, natural_date: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(outcomes to append, drift state per league) of a prediction log.

    With ``natural_date`` (the log's date column) malformed keys are rebuilt before they meet the results.
    """
    resolved = lab.resolve(preds, results, lab.default_markets(), order=order, seen=seen, natural_date=natural_date)
    outcomes = lab.outcome_rows(resolved)
    return outcomes, d.drift_state(g.settled(outcomes))


def select_slate(preds: DataFrame, drift_state: DataFrame, slate: str) -> DataFrame:
    """Predictions through all gates, blocked leagues taken from the drift state."""
    return sel.selection_gate(preds, drift_state.select("league", "status"), slate)


def refresh_results(master: DataFrame, fetched: DataFrame, key: list[str], order: list) -> DataFrame:
    """New results not yet in the master, to append."""
    return j.append_new(master, fetched, key, order)
