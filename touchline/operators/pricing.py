"""Market probabilities from count models, as projections without a shuffle.

Goal and card grids need few cells in closed form, so they are plain arithmetic inside whole-stage code.
Negative binomial grids come from one small Arrow-batched helper.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clamp, dampen
from .metrics import MARKET_CAPS

# Fixed values of the models.
MAX_GOALS, MAX_CORNERS, MAX_CARDS = 10, 25, 15
RHO = -0.13
P_LOW, P_HIGH = 0.05, 0.92
CARD_ZERO_MASS, CARD_CEILING = 0.03, 0.88
ENSEMBLE_WEIGHTS = (0.6, 0.4)
RATE_LOW, RATE_HIGH = 0.05, 4.0
DIVERGENCE_LIMIT = 0.20
LIFT_DEFAULT, LIFT_LARGE, LARGE_SAMPLE = 0.05, 0.10, 8
BTTS_LEAGUE_CAPS = {"BL1": 0.58}
INTENSITY = 1.6
# The rate cap reads an under-2.5 price the card model never gives; its default is 0.23.
CARD_OVER_DEFAULT = 1 - 0.23
BASELINES = {
    "goals_u25": 0.45,
    "goals_o25": 0.55,
    "u25": 0.45,
    "o25": 0.55,
    "btts": 0.50,
    "btts_yes": 0.50,
    "btts_no": 0.50,
    "corn_o75": 0.65,
    "corn_u11": 0.70,
    "card_o25": 0.60,
}
MARKET_STABILITY = {
    "goals_u25": 0.90,
    "goals_o25": 0.90,
    "u25": 0.90,
    "o25": 0.90,
    "u35": 0.90,
    "home_under_1_5": 0.70,
    "away_under_1_5": 0.70,
    "btts": 0.80,
    "btts_yes": 0.80,
    "btts_no": 0.80,
    "corn_o75": 0.70,
    "corn_u11": 0.70,
    "card_o25": 0.60,
    "card_u55": 0.60,
    "card_u45": 0.60,
}
TIER_STAKES = {"AUTO_BET": 1.0, "REDUCED_STAKE": 0.6, "MANUAL_REVIEW": 0.3, "NO_BET": 0.0}
CUP_WORDS = "CUP|POKAL|COPA|TROPHY|SUPER"


def _map(values: dict, key: Column, default: Column) -> Column:
    pairs = F.create_map(*[F.lit(v) for kv in values.items() for v in kv])
    return F.coalesce(F.try_element_at(pairs, key), default)


def _sum(parts) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _poisson(rate: Column, k: int) -> Column:
    return F.exp(-rate) * F.pow(rate, F.lit(float(k))) / float(math.factorial(k))


def _bound(p: Column) -> Column:
    return clamp(p, P_LOW, P_HIGH)


def _goal_grid(df: DataFrame, home: Column, away: Column) -> DataFrame:
    """Marginals _h0.._h10 and _a0.._a10 and their running sums _ch, _ca, as SQL text: one call per column."""
    df = df.withColumns({"_lh": home, "_la": away})
    n = range(MAX_GOALS + 1)
    mass = {f"_{s}{k}": F.expr(f"exp(-_l{s}) * pow(_l{s}, {k}.0D) / {math.factorial(k)}.0D") for s in "ha" for k in n}
    upto = {f"_c{s}{k}": F.expr(" + ".join(f"_{s}{i}" for i in range(k + 1))) for s in "ha" for k in n}
    return df.withColumns(mass).withColumns(upto)


def _drop_temp(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def price_goals(df: DataFrame, home: str = "home_xg", away: str = "away_xg") -> DataFrame:
    """Goal markets of a Dixon-Coles corrected Poisson grid 0..10, shrunk and bounded (M1)."""
    df = _goal_grid(df, clamp(F.col(home), 0.2, 3.5), clamp(F.col(away), 0.2, 3.5))
    # what the correction adds to the four low scores
    df = df.withColumns(
        {
            "_d00": F.expr(f"_h0 * _a0 * (-_lh * _la * {RHO}D)"),
            "_d10": F.expr(f"_h1 * _a0 * (_la * {RHO}D)"),
            "_d01": F.expr(f"_h0 * _a1 * (_lh * {RHO}D)"),
            "_d11": F.expr(f"_h1 * _a1 * ({-RHO}D)"),
        }
    )
    n = MAX_GOALS
    low = "_d00 + _d10 + _d01 + _d11"
    add = lambda parts: " + ".join(parts)
    diagonal = lambda s: add(f"_h{h} * _a{s - h}" for h in range(s + 1))
    raw = {
        "_z": f"_ch{n} * _ca{n} + {low}",
        "_home": add(f"_h{k} * _ca{k - 1}" for k in range(1, n + 1)) + " + _d10",
        "_draw": add(f"_h{k} * _a{k}" for k in range(n + 1)) + " + _d00 + _d11",
        "_away": add(f"_a{k} * _ch{k - 1}" for k in range(1, n + 1)) + " + _d01",
        "_t1": f"{diagonal(0)} + {diagonal(1)} + _d00 + _d10 + _d01",
        "_t2": f"{diagonal(2)} + _d11",
        "_t3": diagonal(3),
        "_both": f"(_ch{n} - _h0) * (_ca{n} - _a0) + _d11",
        "_hu": f"_ch1 * _ca{n} + {low}",
        "_au": f"_ca1 * _ch{n} + {low}",
    }
    df = df.withColumns({name: F.expr(text) for name, text in raw.items()})
    p = lambda name: F.col(name) / F.col("_z")
    under25 = (F.col("_t1") + F.col("_t2")) / F.col("_z")
    df = df.withColumns({"_o25": dampen(1 - under25), "_btts": dampen(p("_both"))})
    third = 1 / 3
    out = {
        "home_win": _bound(dampen(p("_home"), 0.80, third)),
        "draw": _bound(dampen(p("_draw"), 0.80, third)),
        "away_win": _bound(dampen(p("_away"), 0.80, third)),
        "over_2_5": _bound(F.col("_o25")),
        "under_2_5": _bound(1 - F.col("_o25")),
        "over_1_5": _bound(dampen(1 - p("_t1"), 0.85)),
        "under_3_5": _bound(dampen((F.col("_t1") + F.col("_t2") + F.col("_t3")) / F.col("_z"), 0.85)),
        "btts_yes": _bound(F.col("_btts")),
        "btts_no": _bound(1 - F.col("_btts")),
        "home_under_1_5": _bound(dampen(p("_hu"))),
        "away_under_1_5": _bound(dampen(p("_au"))),
    }
    return _drop_temp(df.withColumns(out))


def _nb_pmf(mu: np.ndarray, variance: np.ndarray, size: int) -> np.ndarray:
    """P(0..size) per row; a variance at or below the mean becomes 1.05 times the mean."""
    variance = np.where(variance <= mu, mu * 1.05, variance)
    p = mu / variance
    n = mu * p / (1 - p)
    out = np.empty((len(mu), size + 1))
    out[:, 0] = p**n
    for k in range(1, size + 1):
        out[:, k] = out[:, k - 1] * (k - 1 + n) / k * (1 - p)
    return out


def nb_grid_sums(size: int, totals: list[int], lines: list[int]):
    """Arrow-batched helper: sums over the grid of two negative binomials.

    Higher-order functions would build and copy boxed arrays row by row, some fifteen times slower. Returns total
    mass z, home / draw / away mass, P(sum <= t) as t<t> and each side's P(X <= k) as h<k>, a<k>, not normalised.
    """
    names = ["z", "home", "draw", "away", *[f"t{t}" for t in totals], *[f"{s}{k}" for s in "ha" for k in lines]]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def sums(mu_h: pd.Series, var_h: pd.Series, mu_a: pd.Series, var_a: pd.Series) -> pd.DataFrame:
        h, a = (_nb_pmf(m.to_numpy(float), v.to_numpy(float), size) for m, v in ((mu_h, var_h), (mu_a, var_a)))
        upto_h, upto_a = h.cumsum(axis=1), a.cumsum(axis=1)
        out = {
            "z": upto_h[:, -1] * upto_a[:, -1],
            "home": (h[:, 1:] * upto_a[:, :-1]).sum(axis=1),
            "draw": (h * a).sum(axis=1),
            "away": (a[:, 1:] * upto_h[:, :-1]).sum(axis=1),
        }
        out |= {f"t{t}": (h[:, : t + 1] * upto_a[:, t::-1]).sum(axis=1) for t in totals}
        out |= {f"{s}{k}": c[:, k] for s, c in (("h", upto_h), ("a", upto_a)) for k in lines}
        return pd.DataFrame(out)[names]

    return sums


def price_corners(
    df: DataFrame,
    mu_home: str = "mu_home_corners",
    mu_away: str = "mu_away_corners",
    var_home: Column | None = None,
    var_away: Column | None = None,
) -> DataFrame:
    """Corner markets of two negative binomials with a variance boost for quiet matches (M2)."""
    mh, ma = F.col(mu_home), F.col(mu_away)
    vh = mh * 1.3 if var_home is None else var_home
    va = ma * 1.3 if var_away is None else var_away
    boost = 1.0 + 0.5 / (1 + F.exp(1.5 * (mh + ma - 8.5)))
    df = df.withColumn("_g", nb_grid_sums(MAX_CORNERS, [7, 11], [2, 3, 4, 5])(mh, vh * boost, ma, va * boost))
    g = lambda name: F.col(f"_g.{name}")
    third = 1 / 3
    df = df.withColumns({f"_p{s}": _bound(dampen(g(s) / g("z"), 0.80, third)) for s in ("home", "draw", "away")})
    whole = F.col("_phome") + F.col("_pdraw") + F.col("_paway")
    under = dampen(g("t11") / g("z"), 0.90)
    out = {
        "corners_home_win": F.col("_phome") / whole,
        "corners_draw": F.col("_pdraw") / whole,
        "corners_away_win": F.col("_paway") / whole,
        "corners_under_11_5": _bound(under),
        "corners_over_11_5": _bound(1 - under),
        "corners_over_7_5": _bound(dampen(1 - g("t7") / g("z"), 0.85)),
    }
    for side in ("home", "away"):
        for line in (2, 3, 4, 5):
            below = dampen(g(f"{side[0]}{line}"))
            out[f"corners_{side}_under_{line}_5"] = _bound(below)
            out[f"corners_{side}_over_{line}_5"] = _bound(1 - below)
    return _drop_temp(df.withColumns(out))


def price_cards_zip(df: DataFrame, mu: str = "mu_cards", variance_factor: Column | float = 1.0) -> DataFrame:
    """Total-card markets of a zero-inflated Poisson (M3)."""
    factor = F.lit(variance_factor) if isinstance(variance_factor, float) else variance_factor
    df = df.withColumn("_mu", F.col(mu) * factor)
    mass = lambda lo, hi: (1 - CARD_ZERO_MASS) * _sum([_poisson(F.col("_mu"), k) for k in range(lo, hi + 1)])
    df = df.withColumns({"_u4": CARD_ZERO_MASS + mass(0, 4), "_u5": CARD_ZERO_MASS + mass(0, 5), "_o2": mass(3, MAX_CARDS)})
    under = dampen(F.col("_u4"), 0.88)
    out = {
        "cards_under_4_5": _bound(under),
        "cards_over_4_5": _bound(1 - under),
        "cards_over_2_5": _bound(dampen(F.col("_o2"), 0.90)),
        "cards_under_5_5": clamp(dampen(F.col("_u5"), 0.88), P_LOW, CARD_CEILING),
    }
    return _drop_temp(df.withColumns(out))


def price_cards_nb(df: DataFrame, mu_home: Column, var_home: Column, mu_away: Column, var_away: Column) -> DataFrame:
    """Total-card markets of two negative binomials (M4)."""
    df = df.withColumn("_g", nb_grid_sums(MAX_CARDS, [2, 4, 5], [])(mu_home, var_home, mu_away, var_away))
    at_most = lambda k: F.col(f"_g.t{k}") / F.col("_g.z")
    out = {
        "nb_cards_over_2_5": _bound(dampen(1 - at_most(2), 0.85)),
        "nb_cards_under_4_5": _bound(dampen(at_most(4), 0.85)),
        "nb_cards_under_5_5": _bound(dampen(at_most(5), 0.85)),
    }
    return _drop_temp(df.withColumns(out))


def poisson_at_most(rate: Column, k: int) -> Column:
    return _sum([_poisson(rate, i) for i in range(k + 1)])


def price_derived(df: DataFrame, home: str = "home_xg", away: str = "away_xg") -> DataFrame:
    """Double chance from 1X2 (normalised if off by more than 0.05), both-score closed form, under lines (M5)."""
    total = F.col("home_win") + F.col("draw") + F.col("away_win")
    scale = F.when(F.abs(total - 1) > 0.05, total).otherwise(1.0)
    lh, la = F.col(home), F.col(away)
    one = lambda p: F.least(p, F.lit(1.0))
    none = F.exp(-lh) + F.exp(-la) - F.exp(-lh) * F.exp(-la)
    out = {
        "dc_1x": one((F.col("home_win") + F.col("draw")) / scale),
        "dc_x2": one((F.col("draw") + F.col("away_win")) / scale),
        "dc_12": one((F.col("home_win") + F.col("away_win")) / scale),
        "poisson_btts_no": clamp(none, 0.0, 1.0),
        "poisson_u25": clamp(poisson_at_most(lh + la, 2), 0.0, 1.0),
        "poisson_u35": clamp(poisson_at_most(lh + la, 3), 0.0, 1.0),
    }
    return df.withColumns(out)


def price_handicap(df: DataFrame, home: str = "home_xg", away: str = "away_xg", handicap: int = 2) -> DataFrame:
    """P(underdog plus ``handicap`` beats the favourite); 0 for close matches and for prices above 0.85 (M6)."""
    df = _goal_grid(df, F.col(home), F.col(away))
    n = MAX_GOALS

    def wins(own: str, other: str) -> Column:
        return F.expr(" + ".join(f"_{own}{k} * _c{other}{min(k + handicap - 1, n)}" for k in range(n + 1)))

    df = df.withColumn("_p", F.when(F.col("_lh") < F.col("_la"), wins("h", "a")).otherwise(wins("a", "h")))
    close = F.abs(F.col("_lh") - F.col("_la")) < 0.6
    price = F.when(close | (F.col("_p") > 0.85), 0.0).otherwise(F.col("_p"))
    dog = F.when(F.col("_lh") < F.col("_la"), "home").otherwise("away")
    return _drop_temp(df.withColumns({"eh_plus": price, "underdog": dog}))


def ensemble(df: DataFrame, first: tuple[str, str], second: tuple[str, str], weights: tuple[float, float] = ENSEMBLE_WEIGHTS) -> DataFrame:
    """Weighted mean of two models' clamped rates and their relative divergence (M7)."""
    w = (weights[0] / sum(weights), weights[1] / sum(weights)) if sum(weights) > 0 else ENSEMBLE_WEIGHTS
    rate = lambda c: clamp(F.col(c), RATE_LOW, RATE_HIGH)
    apart = lambda a, b: F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))
    out, gaps = {}, []
    for side, a, b in zip(("home", "away"), first, second, strict=True):
        out[f"{side}_lambda"] = clamp(w[0] * rate(a) + w[1] * rate(b), RATE_LOW, RATE_HIGH)
        gaps.append(apart(rate(a), rate(b)))
    out["divergence"] = F.greatest(*gaps)
    return df.withColumns(out).withColumn("diverges", F.col("divergence") > DIVERGENCE_LIMIT)


def lift_cap(raw: Column, adjusted: Column, meetings: Column) -> Column:
    """An upward adjustment ends at five points, ten with eight meetings; downward ones are free."""
    most = F.when(meetings >= LARGE_SAMPLE, LIFT_LARGE).otherwise(LIFT_DEFAULT)
    return F.when(adjusted - raw > most, raw + most).otherwise(adjusted)


def adjust_goals(df: DataFrame, home: str = "home_xg", away: str = "away_xg") -> DataFrame:
    """Head-to-head blend, coherent goal lines, pull to the Poisson-implied price, ceilings (M8).

    Reads the M1 columns plus h2h_count and h2h_over_2_5_rate; writes o15, o25, u25, u35, btts, btts_no and the
    capped team lines.
    """
    n, rate, raw = F.col("h2h_count"), F.col("h2h_over_2_5_rate"), F.col("over_2_5")
    weight = F.least(n / 5, F.lit(0.5))
    blended = lift_cap(raw, (1 - weight) * raw + weight * rate, n)
    use = (n >= 6) & rate.isNotNull() & (F.abs(raw - rate) > 0.15)
    df = df.withColumn("_o25", F.when(use, blended).otherwise(raw))
    df = df.withColumn("_f", F.when(raw <= 1e-6, 1.0).otherwise(F.least(F.col("_o25") / raw, F.lit(1.0))))
    df = df.withColumns(
        {
            "_o35": (1 - F.col("under_3_5")) * F.col("_f"),
            "_o15": F.col("over_1_5") * F.greatest(F.col("_f"), F.lit(0.85)),
            "_yes": F.col("btts_yes") * F.greatest(F.col("_f"), F.lit(0.9)),
        }
    )
    lh, la = F.col(home), F.col(away)
    pull = lambda p, implied: p + 0.25 * (implied - p)
    cap = lambda p, m: F.least(p, F.lit(MARKET_CAPS[m]))
    yes = pull(F.col("_yes"), (1 - F.exp(-lh)) * (1 - F.exp(-la)))
    for league, ceiling in BTTS_LEAGUE_CAPS.items():
        yes = F.when(F.col("league") == league, F.least(yes, F.lit(ceiling))).otherwise(yes)
    df = df.withColumns(
        {
            "u25": cap(pull(1 - F.col("_o25"), poisson_at_most(lh + la, 2)), "u25"),
            "u35": cap(pull(1 - F.col("_o35"), poisson_at_most(lh + la, 3)), "u35"),
            "btts": cap(yes, "btts_yes"),
            "home_u15": cap(F.col("home_under_1_5"), "home_under_1_5"),
            "away_u15": cap(F.col("away_under_1_5"), "away_under_1_5"),
        }
    )
    df = df.withColumns({"o25": 1 - F.col("u25"), "btts_no_final": 1 - F.col("btts")})
    return _drop_temp(df.withColumn("o15", F.greatest(F.col("_o15"), F.col("o25"))))


def adjust_corner_rates(df: DataFrame, offsets: DataFrame, intense: Column | None = None) -> DataFrame:
    """Corner means times e^offset, blended with head-to-head, lifted by at most two; spread 1.3, 1.6-fold if intense (M9)."""
    df = _join_offsets(df, offsets, "corners")
    n, seen = F.col("h2h_count"), F.col("h2h_avg_corners")
    df = df.withColumns(
        {"_h": F.col("mu_home_corners") * F.exp("_home_bias"), "_a": F.col("mu_away_corners") * F.exp("_away_bias")}
    )
    total = F.col("_h") + F.col("_a")
    weight = F.least(n / 5, F.lit(0.4))
    blended = F.least((1 - weight) * total + weight * seen, total + 2.0)
    scale = F.when((n >= 2) & seen.isNotNull() & (total > 0), blended / total).otherwise(1.0)
    df = df.withColumn("_s", scale)
    spread = F.lit(1.3) if intense is None else F.when(intense, 1.3 * INTENSITY).otherwise(1.3)
    df = df.withColumns({"adj_home_corners": F.col("_h") * F.col("_s"), "adj_away_corners": F.col("_a") * F.col("_s")})
    df = df.withColumns({"var_home_corners": F.col("adj_home_corners") * spread, "var_away_corners": F.col("adj_away_corners") * spread})
    return _drop_temp(df)


def adjust_card_rate(df: DataFrame, offsets: DataFrame) -> DataFrame:
    """Card mean times e^(both offsets), blended with head-to-head up to one half, and the rate-capped over price (M9)."""
    df = _join_offsets(df, offsets, "cards")
    n, seen, rate = F.col("h2h_count"), F.col("h2h_avg_cards"), F.col("h2h_cards_over_2_5_rate")
    mu = F.col("mu_cards") * F.exp(F.col("_home_bias") + F.col("_away_bias"))
    weight = F.least(n / 5, F.lit(0.5))
    use = (n >= 2) & seen.isNotNull()
    blend = F.least(n / 5, F.lit(0.6))
    capped = lift_cap(F.lit(CARD_OVER_DEFAULT), (1 - blend) * CARD_OVER_DEFAULT + blend * rate, n)
    trigger = use & rate.isNotNull() & (n >= 3) & (F.lit(CARD_OVER_DEFAULT) > rate + 0.20)
    df = df.withColumns(
        {"adj_cards": F.when(use, (1 - weight) * mu + weight * seen).otherwise(mu), "card_o25_cap": F.when(trigger, capped)}
    )
    return _drop_temp(df)


def _join_offsets(df: DataFrame, offsets: DataFrame, metric: str) -> DataFrame:
    for side in ("home", "away"):
        part = offsets.select("league", F.col("team").alias(f"{side}_team"), F.col(f"{side}_{metric}_bias").alias(f"_{side}_bias"))
        df = df.join(part, ["league", f"{side}_team"], "left").fillna({f"_{side}_bias": 0.0})
    return df


def high_intensity(derby: str | None = None) -> Column:
    """Cup words, a derby flag or heated recent meetings."""
    name = F.upper(F.concat_ws(" ", "league", "home_team", "away_team"))
    n, rate, avg, days = F.col("h2h_count"), F.col("h2h_cards_over_2_5_rate"), F.col("h2h_avg_cards"), F.col("days_since_h2h")
    heated = (rate >= 0.70) | (avg >= 5.0) | ((days <= 45) & ((rate >= 0.60) | (avg >= 4.5)))
    out = name.rlike(CUP_WORDS) | F.coalesce((n >= 3) & heated, F.lit(False))
    if derby:
        flag = F.lower(F.trim(F.col(derby).cast("string")))
        out |= F.coalesce(flag.isin("true", "1", "yes", "y") | (flag.try_cast("double") > 0), F.lit(False))
    return out


def confidence(
    df: DataFrame,
    rates: DataFrame | None = None,
    buckets: DataFrame | None = None,
    *,
    mu: Column,
    variance: Column,
    h2h_count: Column,
    days_since_h2h: Column,
    missing: Column,
    referee_known: Column,
    team_volatility: Column,
    days_since_calibration: Column | None = None,
) -> DataFrame:
    """(reliability * stability * agreement * calibration * certainty)^0.85, action tier, stake share.

    ``rates``: league, market, baseline. ``buckets``: league, market, bucket, ece (from G21).
    """
    m, p = F.col("market"), F.col("probability")
    df = df.withColumns({"_mu": mu, "_var": variance, "_n": h2h_count, "_days": days_since_h2h, "_miss": missing, "_vol": team_volatility})
    if rates is not None:
        df = df.join(rates.select("league", "market", F.col("baseline").alias("_base")), ["league", "market"], "left")
    else:
        df = df.withColumn("_base", F.lit(None).cast("double"))
    bucket = (
        F.when(p < 0.50, "0.00-0.50").when(p < 0.60, "0.50-0.60").when(p < 0.70, "0.60-0.70").when(p < 0.80, "0.70-0.80").when(p < 0.90, "0.80-0.90").otherwise("0.90-1.00")
    )
    df = df.withColumn("bucket", bucket)
    if buckets is not None:
        df = df.join(buckets.select("league", "market", "bucket", F.col("ece").alias("_ece")), ["league", "market", "bucket"], "left")
    else:
        df = df.withColumn("_ece", F.lit(None).cast("double"))

    cv = F.sqrt(F.greatest(F.col("_var"), F.lit(0.0))) / F.greatest(F.col("_mu"), F.lit(0.01))
    uncertainty = F.when(F.col("_mu") > 0, clamp(1 - F.exp(-cv), 0.0, 1.0)).otherwise(0.3)
    n = F.col("_n")
    sample = F.when(n >= 5, F.least(n / 10, F.lit(1.0))).when(n > 0, 0.6 * (n / 5)).otherwise(0.0)
    recency = F.when(F.col("_days") >= 0, F.exp(-F.col("_days") / 365)).otherwise(1.0)
    drs = F.when((n == 0) & (F.col("_miss") >= 3), 0.3).otherwise(
        clamp(0.4 * sample + 0.3 * recency + 0.3 * F.exp(-0.35 * F.col("_miss")), 0.3, 1.0)
    )
    base = _map(MARKET_STABILITY, m, F.lit(0.75))
    base = base - F.when(~referee_known & m.contains("card"), 0.15).otherwise(0.0)
    over = m.contains("_o") | m.contains("over") | m.contains("btts_yes")
    mss = clamp(base - F.when((F.col("_vol") > 0.7) & over, 0.08).otherwise(0.0), 0.5, 1.0)
    baseline = F.coalesce(F.col("_base"), _map(BASELINES, m, F.lit(0.50)))
    df = df.withColumns({"uncertainty": uncertainty, "drs": drs, "mss": mss, "_b": baseline})
    mean = (p + F.col("_b") + 0.5) / 3
    std = F.sqrt((F.pow(p - mean, F.lit(2)) + F.pow(F.col("_b") - mean, F.lit(2)) + F.pow(0.5 - mean, F.lit(2))) / 3)
    spread = F.greatest(p, F.col("_b"), F.lit(0.5)) - F.least(p, F.col("_b"), F.lit(0.5))
    ece = F.coalesce(F.col("_ece"), F.lit(0.10))
    if days_since_calibration is not None:
        ece = ece * F.when(days_since_calibration > 0, F.exp(-days_since_calibration / 180)).otherwise(1.0)
    df = df.withColumns({"mas": clamp(1 - (0.6 * spread + 0.4 * std), 0.4, 1.0), "hce": clamp(F.exp(-ece * 5.0), 0.0, 1.0)})
    raw = F.col("drs") * F.col("mss") * F.col("mas") * F.col("hce") * (1 - F.col("uncertainty"))
    df = df.withColumn("confidence", clamp(F.pow(raw, F.lit(0.85)), 0.0, 1.0))
    c = F.col("confidence")
    tier = F.when(c >= 0.80, "AUTO_BET").when(c >= 0.70, "REDUCED_STAKE").when(c >= 0.60, "MANUAL_REVIEW").otherwise("NO_BET")
    df = df.withColumn("action_tier", tier)
    return _drop_temp(df.withColumn("stake_share", _map(TIER_STAKES, F.col("action_tier"), F.lit(0.0))))


def soft_cap(p: Column, conf: Column, market: Column) -> Column:
    """Confidence-dependent ceiling for corner and card markets, itself between 0.72 and 0.82."""
    m = F.lower(market)
    ceiling = F.when(m.startswith("corn"), clamp(0.75 + 0.15 * conf, 0.72, 0.82)).when(
        m.startswith("card"), clamp(0.70 + 0.18 * conf, 0.72, 0.82)
    )
    return F.least(p, F.coalesce(ceiling, F.lit(1.0)))


def price_from_history(home_scored: Column, away_scored: Column) -> Column:
    """P(home side scores at most once) from two trailing means."""
    rate = (home_scored + away_scored) / 2
    return F.least(F.exp(-rate) + rate * F.exp(-rate), F.lit(0.99))


def corner_step(expected: Column) -> Column:
    """Step price of under 11.5 corners from the expected total."""
    return F.when(expected < 9, 0.80).when(expected < 10, 0.70).when(expected < 11, 0.60).when(expected < 12, 0.50).otherwise(0.35)


def to_market_rows(df: DataFrame, names: dict[str, str], keep: list[str]) -> DataFrame:
    """Wide prices to one row per market, nulls skipped."""
    pairs = F.array(*[F.struct(F.lit(m).alias("market"), F.col(c).cast("double").alias("probability")) for c, m in names.items()])
    return df.select(*keep, F.inline(pairs)).filter(F.col("probability").isNotNull() & ~F.isnan("probability"))


class MarketRows:
    """One row per market of a row's prices, nulls skipped: the table function behind ``market_rows``."""

    def eval(self, names: list[str], prices: list[float]):
        for name, price in zip(names or [], prices or []):
            if price is not None and price == price:
                yield name, price


def register_table_functions(spark: SparkSession) -> None:
    """Make ``market_rows(names, prices)`` and ``market_entries(names, prices)`` known to SQL.

    ``FROM prices, LATERAL market_rows(array('draw'), array(p_draw))`` runs in Arrow batches beside the rows, without a
    shuffle. ``SELECT id, inline(e) FROM (SELECT id, market_entries(...) AS e FROM prices)`` gives the same rows and
    stays in the JVM, so prefer it on large tables. (Spark takes no SQL function inside a generator, and plans a table
    function written in SQL as a join on its arguments.)
    """
    spark.udtf.register("market_rows", F.udtf(MarketRows, returnType="market string, probability double", useArrow=True))
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION market_entries(names ARRAY<STRING>, prices ARRAY<DOUBLE>)
        RETURNS ARRAY<STRUCT<market: STRING, probability: DOUBLE>>
        RETURN filter(transform(names, (n, i) -> named_struct('market', n, 'probability', get(prices, i))),
          e -> e.probability IS NOT NULL AND NOT isnan(e.probability))"""
    )
