"""Performance, calibration and profile aggregates. All are combinable before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import Feature, Running, as_of, point_in_time, top_per_key

# Bin edges as doubles, names and limits.
EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]
CONFIDENCE_BUCKETS = [(0.0, 0.40, "low"), (0.40, 0.55, "medium"), (0.55, 0.70, "high"), (0.70, 1.01, "very_high")]
ECE_BUCKETS = [(0.50, 0.60), (0.60, 0.70), (0.70, 0.80), (0.80, 0.90), (0.90, 1.00)]
OUTCOME_BUCKETS = [(0.0, 0.25), (0.25, 0.35), (0.35, 0.45), (0.45, 0.55), (0.55, 0.70), (0.70, 1.0)]
BINARY_BUCKETS = [(0.0, 0.30), (0.30, 0.45), (0.45, 0.55), (0.55, 0.65), (0.65, 0.80), (0.80, 1.0)]
WILSON_Z = 1.959963984540054


def settled(ledger: DataFrame) -> DataFrame:
    """Won and lost rows with a numeric ``hit``."""
    return ledger.filter(F.col("outcome").isin("WON", "LOST")).withColumn("hit", (F.col("outcome") == "WON").cast("double"))


def profile(df: DataFrame) -> DataFrame:
    """Mean counts per match and result rates over all rows (G1)."""
    h, a = F.col("home_goals"), F.col("away_goals")
    n = F.count(F.lit(1))
    means = {f"avg_{m}": F.avg(F.col(f"home_{m}") + F.col(f"away_{m}")) for m in ("goals", "corners", "cards", "shots")}
    rates = {"home_rate": F.count_if(h > a) / n, "draw_rate": F.count_if(h == a) / n, "away_rate": F.count_if(h < a) / n}
    return df.agg(n.alias("matches"), *[c.alias(k) for k, c in {**means, **rates}.items()])


def base_rates(df: DataFrame, by: str = "league", min_n: int = 10) -> DataFrame:
    """Market hit rates per league with complements, null where too few rows carry the counts."""
    goals = F.col("home_goals") + F.col("away_goals")
    corners = F.col("home_corners") + F.col("away_corners")
    cards = F.col("home_cards") + F.col("away_cards")
    rate = lambda cond: F.avg(cond.cast("double"))
    gated = lambda c, cond: F.when(F.count(c) >= min_n, rate(cond))
    played = df.filter(goals.isNotNull())
    out = played.groupBy(by).agg(
        F.count(F.lit(1)).alias("matches"),
        rate(goals > 2.5).alias("goals_o25"),
        rate((F.col("home_goals") > 0) & (F.col("away_goals") > 0)).alias("btts_yes"),
        gated(corners, corners > 7.5).alias("corn_o75"),
        gated(corners, corners < 11.5).alias("corn_u11"),
        gated(cards, cards > 2.5).alias("card_o25"),
    )
    out = out.filter(F.col("matches") >= min_n)
    return out.withColumns({"goals_u25": 1 - F.col("goals_o25"), "btts_no": 1 - F.col("btts_yes")})


def weighted_rate(df: DataFrame) -> DataFrame:
    """League rate as the match-weighted mean of season rates."""
    h, a = F.col("home_goals"), F.col("away_goals")
    season = df.groupBy("league", "season").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((h > a).cast("double")).alias("hw"),
        F.avg((h == a).cast("double")).alias("d"),
        F.avg((h < a).cast("double")).alias("aw"),
    )
    n = F.sum("n")
    return season.groupBy("league").agg(
        n.alias("matches"),
        (F.sum(F.col("hw") * F.col("n")) / n).alias("home_rate"),
        (F.sum(F.col("d") * F.col("n")) / n).alias("draw_rate"),
        (F.sum(F.col("aw") * F.col("n")) / n).alias("away_rate"),
    )


def distribution(df: DataFrame, value: Column, by: list[str] | None = None, **kw) -> DataFrame:
    """Counts per numeric value, share and cumulative share (G5). Running sums go over the histogram, in chunks
    if it has very many values."""
    keys = by or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    hist = rows.groupBy(*keys, value.cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = hist.groupBy(*keys).agg(F.sum("n").alias("_total"))
    upto = Feature(running={"upto": Running("sum", F.col("n"), include_current=True)})
    out = point_in_time(hist, keys, ["value"], [upto], **kw).join(total, keys)
    out = out.withColumns({"share": F.col("n") / F.col("_total"), "cumulative": F.col("upto") / F.col("_total")})
    return out.drop("_all", "_total", "upto")


def _squared_error() -> Column:
    return F.pow(F.col("probability") - F.col("hit"), F.lit(2))


def brier(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Brier score, size and means, overall or by group."""
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(_squared_error()).alias("brier"),
        F.avg("probability").alias("mean_predicted"),
        F.avg("hit").alias("mean_actual"),
    )


def accuracy(df: DataFrame, by: list[str]) -> DataFrame:
    """Share on the right side of one half, and Brier score."""
    right = (F.col("probability") >= 0.5) == (F.col("hit") >= 0.5)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("accuracy"), F.avg(_squared_error()).alias("brier")
    )


def bin_of(p: Column, convention: str) -> Column:
    """Bin 0..9 or null, by one of the five conventions in use.

    a: [lo, hi), 1.0 in no bin; b: (lo, hi], 0 in no bin; c: (lo, hi] with 0 in the first, clipped;
    d: [lo, hi) with the last bin closed; e: int(p * 10) with 1.0 in the last.
    """
    inside = p.between(0, 1)
    if convention == "e":
        return F.when(inside, F.when(p == 1.0, 9).otherwise(F.floor(p * 10).cast("int")))
    if convention == "c":
        p = F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0))
    lower = reduce(lambda x, y: x + y, [(p >= e).cast("int") for e in EDGES]) - 1
    upper = reduce(lambda x, y: x + y, [(p > e).cast("int") for e in EDGES]) - 1
    if convention == "a":
        return F.when(inside & (lower < 10), lower)
    if convention == "b":
        return F.when(inside & (upper >= 0), upper)
    if convention == "c":
        return F.greatest(upper, F.lit(0))
    return F.when(inside, F.least(lower, F.lit(9)))


def ece(df: DataFrame, by: list[str] | None = None, convention: str = "a", p: str = "probability", hit: str = "hit") -> DataFrame:
    """Expected calibration error per group and the direction of the mean gap.

    Rows are reduced to ten bins per group first; rows in no bin stay in the denominator.
    """
    by = by or []
    value = F.greatest(F.least(F.col(p), F.lit(1.0)), F.lit(0.0)) if convention == "c" else F.col(p)
    bins = df.groupBy(*by, bin_of(F.col(p), convention).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_p"), F.sum(hit).alias("_y")
    )
    miss = F.when(F.col("_bin").isNotNull(), F.abs(F.col("_p") - F.col("_y")))
    gap = (F.sum("_p") - F.sum("_y")) / F.sum("_n")
    out = bins.groupBy(*by).agg(
        F.sum("_n").alias("n"),
        (F.coalesce(F.sum(miss), F.lit(0.0)) / F.sum("_n")).alias("ece"),
        gap.alias("gap"),
    )
    state = F.when(F.col("gap") > 0, "overconfident").when(F.col("gap") < 0, "underconfident").otherwise("balanced")
    return out.withColumn("state", state)


def reliability(df: DataFrame, limit: float = 0.10) -> DataFrame:
    """Ten bins per (market, league), empty ones included, with the group's worst gap."""
    league = F.when(F.length(F.trim("league")) > 0, F.col("league")).otherwise("Global")
    clipped = F.greatest(F.least(F.col("probability"), F.lit(1.0)), F.lit(0.0))
    rows = df.withColumns({"league": league, "probability": clipped})
    bins = rows.groupBy("market", "league", bin_of(F.col("probability"), "d").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("probability").alias("predicted"), F.avg("hit").alias("actual")
    )
    # at most ten structs per group, so gathering them is bounded
    cell = F.struct("n", "predicted", "actual")
    groups = bins.groupBy("market", "league").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", cell.alias("cell")))).alias("cells"),
        F.max(F.abs(F.col("predicted") - F.col("actual"))).alias("max_deviation"),
    )
    out = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("cell", F.try_element_at("cells", "bin"))
    return out.select(
        "market",
        "league",
        "bin",
        F.coalesce("cell.n", F.lit(0)).alias("n"),
        F.col("cell.predicted"),
        F.col("cell.actual"),
        (F.col("cell.predicted") - F.col("cell.actual")).alias("gap"),
        "max_deviation",
        (F.col("max_deviation") > limit).alias("miscalibrated"),
    )


def bucket_label(p: Column, buckets: list[tuple], names: list[str]) -> Column:
    label = F.when((p >= buckets[0][0]) & (p < buckets[0][1]), names[0])
    for (lo, hi, *_), name in zip(buckets[1:], names[1:], strict=True):
        label = label.when((p >= lo) & (p < hi), name)
    return label


def calibration_buckets(df: DataFrame) -> DataFrame:
    """Predicted against actual in four named confidence buckets."""
    name = bucket_label(F.col("probability"), CONFIDENCE_BUCKETS, [b[2] for b in CONFIDENCE_BUCKETS])
    out = df.withColumn("bucket", name).filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.avg("probability").alias("mean_predicted"), F.avg("hit").alias("mean_actual")
    )
    return out.withColumn("gap", F.col("mean_predicted") - F.col("mean_actual"))


def league_calibration(df: DataFrame, min_n: int = 30) -> DataFrame:
    """Brier, ECE (convention b), means, spread and status per league with enough rows."""
    basic = df.groupBy("league").agg(
        F.avg(_squared_error()).alias("brier"),
        F.avg("probability").alias("mean_predicted"),
        F.avg("hit").alias("frequency"),
        F.stddev_samp("probability").alias("predicted_std"),
    )
    out = ece(df, ["league"], "b").filter(F.col("n") >= min_n).join(basic, "league")
    status = (
        F.when(F.col("ece") > 0.10, "EXCLUDE").when(F.col("ece") < 0.02, "BOOST").when(F.col("ece") < 0.05, "ELIGIBLE").otherwise("NEUTRAL")
    )
    return out.withColumn("status", status).drop("state")


def team_offsets(df: DataFrame, prev: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Shrunk deviation of each side's mean corners and cards from the league's.

    (team mean - league mean) * 0.7 * min(matches / 200, 1). A previous row stays if it is frozen or fewer
    than 20 matches were added. ``prev``: league, team, the four biases, matches, frozen.
    """
    side = F.inline(
        F.array(
            F.struct(F.col("home_team").alias("team"), F.lit("home").alias("side"), F.col("home_corners").alias("corners"), F.col("home_cards").alias("cards")),
            F.struct(F.col("away_team").alias("team"), F.lit("away").alias("side"), F.col("away_corners").alias("corners"), F.col("away_cards").alias("cards")),
        )
    )
    rows = df.select("league", side)
    names = [(s, m) for s in ("home", "away") for m in ("corners", "cards")]
    mean = lambda s, m: F.avg(F.when(F.col("side") == s, F.col(m)))
    team = rows.groupBy("league", "team").agg(F.count(F.lit(1)).alias("matches"), *[mean(s, m).alias(f"_t_{s}_{m}") for s, m in names])
    league = rows.groupBy("league").agg(*[mean(s, m).alias(f"_l_{s}_{m}") for s, m in names])
    factor = 0.7 * F.least(F.col("matches") / 200, F.lit(1.0))
    bias = {f"{s}_{m}_bias": F.coalesce((F.col(f"_t_{s}_{m}") - F.col(f"_l_{s}_{m}")) * factor, F.lit(0.0)) for s, m in names}
    out = team.join(league, "league").select("league", "team", "matches", *[c.alias(n) for n, c in bias.items()])
    out = out.withColumn("frozen", F.lit(False))
    if prev is not None:
        values = ["matches", *bias, "frozen"]
        old = prev.select("league", "team", F.struct(*values).alias("_old"))
        new = out.select("league", "team", F.struct(*values).alias("_new"))
        both = new.join(old, ["league", "team"], "full_outer")
        stale = F.col("_old.frozen") | (F.col("_new.matches") - F.col("_old.matches") < 20)
        keep_old = F.col("_new").isNull() | (F.col("_old").isNotNull() & stale & F.lit(not force))
        out = both.select("league", "team", F.when(keep_old, F.col("_old")).otherwise(F.col("_new")).alias("_row"))
        out = out.select("league", "team", "_row.*")
    return out.withColumn("valid", F.col("matches") >= 15)


def consolidate(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Per normalised key the row with the most matches."""
    from .ordered import first_per_key

    rest = [c for c in df.columns if c not in keys and c != weight]
    return first_per_key(df, keys, [F.col(weight), *[F.col(c) for c in rest]], descending=True)


def volatility(df: DataFrame) -> DataFrame:
    """Spread of match goals per side scaled to 0..1 over all sides with two matches."""
    rows = df.select(
        F.explode(F.array("home_team", "away_team")).alias("team"), (F.col("home_goals") + F.col("away_goals")).alias("goals")
    ).filter(F.col("goals").isNotNull())
    std = rows.groupBy("team").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("goals").alias("std")).filter("n >= 2")
    low = std.agg(F.min("std").alias("x")).scalar()
    high = std.agg(F.max("std").alias("x")).scalar()
    spread = F.when(high > low, high - low).otherwise(1.0)
    return std.withColumn("volatility", F.greatest(F.least((F.col("std") - low) / spread, F.lit(1.0)), F.lit(0.0)))


def pair_volatility(df: DataFrame, teams: DataFrame, default: float = 0.5) -> DataFrame:
    """Mean volatility of both sides, 0.5 for an unknown one."""
    home = teams.select(F.col("team").alias("home_team"), F.col("volatility").alias("_h"))
    away = teams.select(F.col("team").alias("away_team"), F.col("volatility").alias("_a"))
    out = df.join(home, "home_team", "left").join(away, "away_team", "left")
    both = (F.coalesce("_h", F.lit(default)) + F.coalesce("_a", F.lit(default))) / 2
    return out.withColumn("team_volatility", both).drop("_h", "_a")


def performance_report(ledger: DataFrame, min_bin: int = 10) -> DataFrame:
    """Total, by market, by league and by probability bin in one pass over grouping sets.

    Profit is at fair odds: 1/p - 1 on a win, -1 on a loss; rows without p > 0 count but add nothing. VOID rows
    only count as voids. Bins need ``min_bin`` rows.
    """
    p = F.col("probability")
    fields = {c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("UNKNOWN")) for c in ("market", "league")}
    rows = ledger.withColumns({**fields, "_bin": F.coalesce(bin_of(p, "e"), F.lit(-1))})
    live = F.col("outcome").isin("WON", "LOST")
    won = F.col("outcome") == "WON"
    profit = F.when(live & (p > 0), F.when(won, 1 / p - 1).otherwise(-1.0))
    out = rows.groupingSets([[], ["market"], ["league"], ["_bin"]], "market", "league", "_bin").agg(
        F.grouping_id().alias("_level"),
        F.count_if(live).alias("bets"),
        F.count_if(won).alias("wins"),
        F.count_if(F.col("outcome") == "VOID").alias("voids"),
        F.coalesce(F.sum(profit), F.lit(0.0)).alias("profit"),
    )
    level = F.when(F.col("_level") == 7, "total").when(F.col("_level") == 3, "market").when(F.col("_level") == 5, "league").otherwise("bin")
    name = F.when(level == "total", "all").otherwise(F.coalesce("market", "league", F.col("_bin").cast("string")))
    out = out.withColumns({"level": level, "name": name}).filter(
        (F.col("bets") > 0) & ((F.col("level") != "bin") | ((F.col("bets") >= min_bin) & (F.col("name") != "-1")))
    )
    rates = {"win_rate": F.col("wins") / F.col("bets"), "roi_pct": F.col("profit") / F.col("bets") * 100}
    return out.withColumns(rates).select("level", "name", "bets", "wins", "voids", "profit", "win_rate", "roi_pct")


def roi(bets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Return on all money staked; profit and win rate over settled bets only."""
    done = F.col("outcome").isNotNull() & (F.col("outcome") != "")
    staked, pnl = F.sum("stake"), F.coalesce(F.sum(F.when(done, F.col("pnl"))), F.lit(0.0))
    wins = F.count_if(done & (F.col("outcome") == "WIN"))
    return bets.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_bets"),
        F.count_if(done).alias("settled_bets"),
        wins.alias("wins"),
        F.coalesce(F.try_divide(wins, F.count_if(done)), F.lit(0.0)).alias("win_rate"),
        staked.alias("staked"),
        pnl.alias("pnl"),
        F.when(staked > 0, pnl / staked * 100).otherwise(0.0).alias("roi_pct"),
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts per value of each column from one scan."""
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def event_metrics(df: DataFrame, day: Column, kind: str = "event_type", prediction: str = "prediction", confidence: str = "confidence", fallback: Column | None = None) -> DataFrame:
    """Predictions, their mean confidence and the share of fallback events per day."""
    is_prediction = F.col(kind) == prediction
    return df.groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(is_prediction).alias("predictions"),
        F.avg(F.when(is_prediction, F.col(confidence))).alias("avg_confidence"),
        (F.count_if(F.coalesce(fallback, F.lit(False))) / F.count(F.lit(1))).alias("fallback_rate"),
    )


def ece_buckets(df: DataFrame, min_n: int = 10) -> DataFrame:
    """|mean p - hit rate| per (league, market, bucket) with enough rows, graded."""
    p = F.col("probability")
    names = [f"{lo:.2f}-{hi:.2f}" for lo, hi in ECE_BUCKETS]
    name = F.coalesce(bucket_label(p, ECE_BUCKETS, names), F.when(p >= 1.0, names[-1]).otherwise("0.00-0.50"))
    out = df.withColumn("bucket", name).groupBy("league", "market", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.abs(F.avg("probability") - F.avg("hit")).alias("ece")
    )
    grade = F.when(F.col("ece") > 0.10, "BAD").when(F.col("ece") > 0.05, "WARN").otherwise("GOOD")
    return out.filter(F.col("n") >= min_n).withColumn("grade", grade)


def structural_drift(df: DataFrame, days: int = 30, time: str = "match_date") -> DataFrame:
    """Relative shift of mean goals and corners in the last ``days`` before the latest match."""
    latest = df.agg(F.max(time).alias("t")).scalar()
    recent = F.col(time) > latest - F.expr(f"INTERVAL {days} DAYS")
    mean = lambda m, cond=None: sum(
        F.avg(F.col(f"{s}_{m}") if cond is None else F.when(cond, F.col(f"{s}_{m}"))) for s in ("home", "away")
    )
    out = df.agg(
        mean("goals").alias("hist_goals"),
        mean("corners").alias("hist_corners"),
        mean("goals", recent).alias("recent_goals"),
        mean("corners", recent).alias("recent_corners"),
        F.count_if(recent).alias("sample_size"),
    )
    shift = lambda m: F.when(F.col(f"hist_{m}") > 0, F.abs(F.col(f"recent_{m}") - F.col(f"hist_{m}")) / F.col(f"hist_{m}")).otherwise(0.0)
    return out.withColumns({"goals_shift": shift("goals"), "corners_shift": shift("corners")})


def market_leaderboard(df: DataFrame) -> DataFrame:
    """Wins, losses and win rate per market, best first."""
    won, lost = F.count_if(F.col("outcome") == "WON"), F.count_if(F.col("outcome") == "LOST")
    out = df.groupBy("market").agg(won.alias("wins"), lost.alias("losses"))
    rate = F.coalesce(F.try_divide(F.col("wins"), F.col("wins") + F.col("losses")), F.lit(0.0))
    return out.withColumn("win_rate", rate).orderBy(F.col("win_rate").desc(), "market")


# Probability ceilings per market and the allowed lift.
MARKET_CAPS = {
    "u25": 0.66,
    "btts_yes": 0.65,
    "btts_no": 0.55,
    "u35": 0.85,
    "home_under_1_5": 0.80,
    "away_under_1_5": 0.80,
    "card_o25": 0.80,
}
MAX_LIFT = 0.05


def failure_class(market: str = "market", p: str = "probability", lift: str = "h2h_lift") -> Column:
    """Why a confident prediction lost, first cause that holds."""
    m = F.col(market)
    cap = F.try_element_at(F.create_map(*[F.lit(v) for kv in MARKET_CAPS.items() for v in kv]), m)
    missing = F.col("home_goals").isNull() | F.col("away_goals").isNull()
    missing |= m.contains("corn") & (F.col("home_corners").isNull() | F.col("away_corners").isNull())
    missing |= m.contains("card") & (F.col("home_cards").isNull() | F.col("away_cards").isNull())
    return (
        F.when(missing, "DATA_ILLUSION")
        .when(F.abs(F.col(lift)) > MAX_LIFT, "ADJUSTMENT_INFLATION")
        .when(F.col(p) > cap + 0.01, "ENFORCEMENT_BUG")
        .otherwise("LEGITIMATE_VARIANCE")
    )


def failure_report(losers: DataFrame, min_p: float = 0.70) -> DataFrame:
    """Counts and shares of failure classes among losers at or above ``min_p``."""
    out = losers.filter(F.col("probability") >= min_p).groupBy(failure_class().alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def percentile_tiers(
    preds: DataFrame, order: list[Column], spread: Column, local: int = 2000, overall: int = 5000, min_local: int = 50
) -> DataFrame:
    """q80/q90/q95 of the latest predictions per (market, league), blended with the market's.

    Under 100 local rows weigh 0.3, under 500 0.7, else local only; under 50 there is no tier. The tails are cut
    in salted tasks first and hold at most ``overall`` rows per market.
    """
    qs = {"q80": 0.8, "q90": 0.9, "q95": 0.95}

    def tail(keys: list[str], n: int, prefix: str) -> DataFrame:
        last = top_per_key(preds, keys, order, n, spread)
        return last.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"{prefix}n"), *[F.expr(f"percentile(probability, {q})").alias(f"{prefix}{k}") for k, q in qs.items()]
        )

    out = tail(["market", "league"], local, "").join(tail(["market"], overall, "_g"), "market")
    weight = F.when(F.col("n") < 100, 0.3).when(F.col("n") < 500, 0.7).otherwise(1.0)
    blended = {k: weight * F.col(k) + (1 - weight) * F.col(f"_g{k}") for k in qs}
    return out.withColumns(blended).withColumn("usable", F.col("n") >= min_local).select("market", "league", "n", *qs, "usable")


def tier_of(p: Column) -> Column:
    return (
        F.when(~F.coalesce(F.col("usable"), F.lit(False)), "NO_BET")
        .when(p >= F.col("q95"), "TIER_A")
        .when(p >= F.col("q90"), "TIER_B")
        .when(p >= F.col("q80"), "TIER_C")
        .otherwise("NO_BET")
    )


def wilson(df: DataFrame, right: Column, actual: str, by: list[str] | None = None) -> DataFrame:
    """Accuracy with its Wilson 95 % interval and the majority-class baseline."""
    by = by or []
    classes = df.groupBy(*by, actual).agg(F.count(F.lit(1)).alias("_n"), F.count_if(right).alias("_right"))
    out = classes.groupBy(*by).agg(
        F.sum("_n").alias("n"), (F.sum("_right") / F.sum("_n")).alias("accuracy"), (F.max("_n") / F.sum("_n")).alias("baseline")
    )
    n, acc, z = F.col("n"), F.col("accuracy"), WILSON_Z
    denominator = 1 + z * z / n
    center = (acc + z * z / (2 * n)) / denominator
    margin = z * F.sqrt(acc * (1 - acc) / n + z * z / (4 * n * n)) / denominator
    return out.withColumns({"low": center - margin, "high": center + margin})


def long_values(df: DataFrame, columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(F.inline(pairs)).filter(F.col(value).isNotNull() & ~F.isnan(value))


def _ranked(df: DataFrame, key: str, value: str, **kw) -> DataFrame:
    """Distinct values with their number ``n``, the number of smaller ones ``before``, and the key's ``total``.

    Rows are counted once; all else works on the counts. Running counts are chunked for a key with many values.
    """
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(key).agg(F.sum("n").alias("total"))
    running = point_in_time(counts, [key], [value], [Feature(running={"before": Running("sum", F.col("n"))})], **kw)
    # totals has one row per feature or market
    return running.withColumn("before", F.coalesce("before", F.lit(0))).join(totals, key)


def _quantile(q: float, value: str) -> Column:
    """Interpolated quantile over the rows of ``_ranked``: which value sits at each wanted rank."""
    at = (F.col("total") - 1) * q
    low, high = F.floor(at), F.ceil(at)
    hit = lambda rank: (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
    lo, hi = F.max(F.when(hit(low), F.col(value))), F.max(F.when(hit(high), F.col(value)))
    return lo + (hi - lo) * F.max(at - low)


def exact_quantiles(df: DataFrame, key: str, value: str, qs: dict[str, float], **kw) -> DataFrame:
    """Interpolated quantiles per key without holding a key's values in one task."""
    return _ranked(df, key, value, **kw).groupBy(key).agg(*[_quantile(q, value).alias(name) for name, q in qs.items()])


def feature_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, mean and spread per feature in one pass (D3)."""
    rows = long_values(df, columns)
    return rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def feature_baselines(df: DataFrame, columns: list[str], **kw) -> DataFrame:
    """Mean, spread and exact quartiles per feature (G28): one pass for the moments, one for the counted values."""
    quartiles = exact_quantiles(long_values(df, columns), "feature", "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, **kw)
    return feature_moments(df, columns).join(quartiles, "feature")


def backtest_calibration(df: DataFrame) -> DataFrame:
    """Per outcome and probability bucket: rows, mean prediction, hit rate.

    ``df`` has pred_home, pred_draw, pred_away, pred_o25, pred_btts and actual goals.
    """
    h, a = F.col("home_goals"), F.col("away_goals")
    outcomes = {
        "home": ("pred_home", h > a),
        "draw": ("pred_draw", h == a),
        "away": ("pred_away", h < a),
        "over_2_5": ("pred_o25", h + a > 2.5),
        "btts": ("pred_btts", (h > 0) & (a > 0)),
    }
    rows = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("outcome"), F.col(p).alias("p"), hit.cast("double").alias("hit"))
                    for n, (p, hit) in outcomes.items()
                ]
            )
        )
    )
    multi = F.col("outcome").isin("home", "draw", "away")
    label = lambda buckets: bucket_label(F.col("p"), buckets, [f"{lo:.2f}-{hi:.2f}" for lo, hi in buckets])
    bucket = F.when(multi, label(OUTCOME_BUCKETS)).otherwise(label(BINARY_BUCKETS))
    out = rows.withColumn("bucket", bucket).filter(F.col("bucket").isNotNull()).groupBy("outcome", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_predicted"), F.avg("hit").alias("hit_rate")
    )
    return out.withColumn("ok", F.abs(F.col("hit_rate") - F.col("mean_predicted")) < 0.10)


def calibration_validation(df: DataFrame, by: list[str]) -> DataFrame:
    """ECE (a), slope of hit rate on mean prediction over bins of ten rows, means, population spread (C4)."""
    bins = df.groupBy(*by, bin_of(F.col("probability"), "a").alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("probability").alias("_p"),
        F.avg("hit").alias("_y"),
        F.sum("probability").alias("_sp"),
        F.sum(F.col("probability") * F.col("probability")).alias("_spp"),
        F.sum("hit").alias("_sy"),
    )
    big = F.col("_bin").isNotNull() & (F.col("_n") >= 10)
    x, y = F.when(big, F.col("_p")), F.when(big, F.col("_y"))
    n = F.sum("_n")
    out = bins.groupBy(*by).agg(
        n.alias("n"),
        (F.sum(F.when(F.col("_bin").isNotNull(), F.abs(F.col("_sp") - F.col("_sy")))) / n).alias("ece"),
        F.when(F.count_if(big) >= 3, F.regr_slope(y, x)).otherwise(0.0).alias("slope"),
        (F.sum("_sp") / n).alias("mean_conf"),
        (F.sum("_sy") / n).alias("mean_hit"),
    )
    spread = df.groupBy(*by).agg(F.stddev_pop("probability").alias("std"))
    return out.join(spread, by)


def auc(df: DataFrame, by: str, p: str = "probability", hit: str = "hit", **kw) -> DataFrame:
    """Exact area under the ROC curve per group by mid-ranks.

    Rows are counted per distinct score; a running count of negatives below each score, chunked for a group
    with many scores, gives the Mann-Whitney statistic.
    """
    scores = df.groupBy(by, p).agg(F.sum(hit).alias("pos"), F.sum(1 - F.col(hit)).alias("neg"))
    scores = point_in_time(scores, [by], [p], [Feature(running={"below": Running("sum", F.col("neg"))})], **kw)
    won = F.sum(F.col("pos") * (F.coalesce("below", F.lit(0.0)) + F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return scores.groupBy(by).agg(F.coalesce(F.try_divide(won, pairs), F.lit(0.5)).alias("auc"))


def sharpness(df: DataFrame, by: str = "market", min_auc: float = 0.55, min_std: float = 0.06, **kw) -> DataFrame:
    """ACTIVE unless a market does not discriminate."""
    spread = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("probability").alias("std"))
    out = auc(df, by, **kw).join(spread, by)
    status = F.when((F.col("auc") < min_auc) | (F.col("std") < min_std), "DISABLED").otherwise("ACTIVE")
    return out.withColumn("status", status)


def adjust_alpha(metrics: DataFrame, alphas: DataFrame, limit: float = 0.03, step: float = 0.05, default: float = 0.80) -> DataFrame:
    """Dampening one step down for overconfident markets and up for underconfident ones."""
    out = metrics.join(alphas, "market", "left").withColumn("alpha_before", F.coalesce("alpha", F.lit(default)))
    off = F.col("ece") > limit
    after = (
        F.when(off & (F.col("state") == "overconfident"), F.greatest(F.col("alpha_before") - step, F.lit(0.0)))
        .when(off & (F.col("state") == "underconfident"), F.least(F.col("alpha_before") + step, F.lit(1.0)))
        .otherwise(F.col("alpha_before"))
    )
    return out.withColumn("alpha_after", after).drop("alpha")


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """MAE, RMSE, R2 and bias."""
    y, x = F.col(actual).cast("double"), F.col(predicted)
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(y - x)).alias("mae"),
        F.sqrt(F.avg(F.pow(y - x, F.lit(2)))).alias("rmse"),
        (1 - F.sum(F.pow(y - x, F.lit(2))) / (F.var_pop(y) * F.count(y))).alias("r2"),
        F.avg(x - y).alias("bias"),
    )


def classification_metrics(df: DataFrame, by: list[str] | None = None, eps: float = 1e-15) -> DataFrame:
    """Accuracy, log-loss and Brier of binary probabilities."""
    p = F.greatest(F.least(F.col("probability"), F.lit(1 - eps)), F.lit(eps))
    loss = -(F.col("hit") * F.log(p) + (1 - F.col("hit")) * F.log(1 - p))
    right = (F.col("probability") >= 0.5) == (F.col("hit") >= 0.5)
    return df.groupBy(*(by or [])).agg(
        F.avg(right.cast("double")).alias("accuracy"), F.avg(loss).alias("log_loss"), F.avg(_squared_error()).alias("brier")
    )


def multiclass_metrics(df: DataFrame, eps: float = 1e-15) -> DataFrame:
    """Accuracy, log-loss and Brier of home/draw/away probabilities against ``actual`` in H, D, A."""
    cols = {"H": "p_home", "D": "p_draw", "A": "p_away"}
    top = F.greatest(*cols.values())
    right = F.when(F.col("actual") == "H", F.col("p_home")).when(F.col("actual") == "D", F.col("p_draw")).otherwise(F.col("p_away"))
    error = reduce(lambda a, b: a + b, [F.pow(F.col(c) - (F.col("actual") == k).cast("double"), F.lit(2)) for k, c in cols.items()])
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((right == top).cast("double")).alias("accuracy"),
        F.avg(-F.log(F.greatest(right, F.lit(eps)))).alias("log_loss"),
        F.avg(error).alias("brier"),
    )


def apply_calibrator(df: DataFrame, table: DataFrame, by: str = "market", p: str = "probability", eps: float = 1e-6, **kw) -> DataFrame:
    """Piecewise-linear calibration from a table (market, x, y) of increasing x, ends held constant.

    Every knot carries the next one along, and a row takes the last knot at or before its score by an as-of join on
    (market, score): one shuffle, hot markets cut along the score. Markets without a table, and null scores, give null.
    """
    following = Window.partitionBy(by).orderBy("x")
    knots = table.filter(F.col(by).isNotNull()).select(
        by, F.col("x").alias("_x"), F.col("x").alias("_kx"), F.col("y").alias("_ky"), F.lead("x").over(following).alias("_nx"), F.lead("y").over(following).alias("_ny")
    )
    x = F.greatest(F.least(F.col(p), F.lit(1 - eps)), F.lit(eps))
    able = F.col(by).isNotNull() & F.col(p).isNotNull()
    rows = df.drop("calibrated")
    met = as_of(rows.filter(able).withColumn("_x", x), knots, [by], "_x", ["_kx", "_ky", "_nx", "_ny"], right_tie=["_ky"], default_first=True, **kw)
    inside = F.col("_ky") + (F.col("_ny") - F.col("_ky")) * (F.col("_x") - F.col("_kx")) / (F.col("_nx") - F.col("_kx"))
    value = F.when((F.col("_x") <= F.col("_kx")) | F.col("_nx").isNull(), F.col("_ky")).otherwise(inside)
    value = F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(1 - eps)), F.lit(eps)))
    out = met.withColumn("calibrated", value).drop("_x", "_kx", "_ky", "_nx", "_ny")
    return out.unionByName(rows.filter(~able).withColumn("calibrated", F.lit(None).cast("double")))


def rate_from_probability(p: Column) -> Column:
    """Poisson rate whose P(Y > 0) is p, for calibrated count models."""
    return -F.log(1 - p)
